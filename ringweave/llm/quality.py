"""Quality classifier by positive-unlabelled learning.

A logistic model over hashed features is fitted by minimising the non-negative unbiased risk

    prior * R_pos(+) + max(0, R_unlabelled(-) - prior * R_pos(-))

from trusted positives and unlabelled text. The class prior is estimated first: a plain
positive-against-unlabelled model is fitted on one half of the sample, and over the other half the
smallest ratio of unlabelled to positive rows above a threshold, taken with a confidence margin,
bounds the share of positives among the unlabelled. Last, the intercept is set so that the share of
unlabelled rows at or above `threshold` is the prior, give or take the sample's standard error on the
side of keeping.

Features of a text: shapes of words (runs of one class shortened), hashed words, and binned figures of the
whole text (variety of words, commonest word, capitals, symbols, length of words and lines). A run without
white space of more than `PIECE` characters counts as consecutive pieces of that length, all of them.

Fitting takes at most about `max_positive` and `max_unlabelled` rows, drawn one by one, so that equal rows
are drawn like others, and cut six standard deviations above; scoring covers every whole text. The model is
one vector of `DIMENSIONS` numbers.

Defined cases: null and empty texts have the features of an empty text and get a score like any other, but
null texts teach nothing; rows with a null label teach nothing; without positives or without unlabelled
rows every score is the prior 0.5, and so are all of an empty model; repeated rows are scored alike, and
equal scores are not ordered; long texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ._common import bound, documents, fold_of, slices, tidy

DIMENSIONS = 4096
#: Characters of a run that count as one word.
PIECE = 64
_FIGURES = 512
_SHAPES = 1024
_RUN = re.compile(r"(.)\1+")
_CLASSES = {c: ("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c) for c in map(chr, range(128))}


def _place(kind: str, text: str, start: int, size: int) -> int:
    return start + xxhash.xxh64_intdigest(f"{kind}\0{text}") % size


class _Places(dict):
    """word -> (feature of its shape, feature of the word); emptied when it has grown past its limit."""

    limit = 200_000

    def __missing__(self, word: str) -> tuple[int, int]:
        shape = _RUN.sub(r"\1", "".join([_CLASSES.get(c) or ("A" if c.isupper() else "a" if c.isalpha() else "~") for c in word]))
        value = (_place("s", shape, _FIGURES, _SHAPES), _place("w", word.lower(), _FIGURES + _SHAPES, DIMENSIONS - _FIGURES - _SHAPES))
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


def features(text: str | None, places: _Places) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features of a text."""
    text = text or ""
    counts = Counter(text.split())
    n, lines = counts.total(), text.count("\n") + 1
    chars = max(len(text), 1)
    letters = sum(map(len, counts)) and sum(len(w) * k for w, k in counts.items())
    upper = sum(1 for w in counts if w.isupper() and len(w) > 1) / max(len(counts), 1)
    plain = sum(k for w, k in counts.items() if w.strip(".,;:!?\"'()").isalpha()) / max(n, 1)
    figures = {
        "variety": len(counts) / max(n, 1) ** 0.8,
        "commonest": max(counts.values(), default=0) / max(n, 1),
        "upper": upper,
        "plain": plain,
        "word": min(letters / max(n, 1), 20) / 20,
        "line": min(n / lines, 100) / 100,
        "length": min(math.log1p(n) / 12, 1),
        "digits": sum(text.count(d) for d in "0123456789") / chars,
    }
    at = [_place("f", f"{name}:{int(min(value, 2) * 16)}", 0, _FIGURES) for name, value in figures.items()]
    values = [1.0] * len(at)
    if n:
        shape: Counter = Counter()
        word: Counter = Counter()
        for w, k in counts.items():
            for piece in (w,) if len(w) <= PIECE else (w[i : i + PIECE] for i in range(0, len(w), PIECE)):
                s, p = places[piece]
                shape[s] += k
                word[p] += k
        for found, scale in ((shape, 2.0), (word, 0.5)):
            size = math.sqrt(sum(v * v for v in found.values()))
            at += found.keys()
            values += [scale * v / size for v in found.values()]
    return np.array(at, np.int32), np.array(values, np.float32)


class Rows:
    """Feature vectors, one after another; each has some features."""

    def __init__(self, at: np.ndarray, value: np.ndarray, counts: np.ndarray):
        self.at, self.value, self.counts = at, value, counts
        self.start = np.cumsum(counts) - counts

    @staticmethod
    def of(found: list[tuple[bytes, bytes]]) -> Rows:
        at, value = ([np.frombuffer(x[i], t) for x in found] for i, t in ((0, np.int32), (1, np.float32)))
        return Rows(np.concatenate(at), np.concatenate(value).astype(float), np.array([len(x) for x in at]))

    def __len__(self) -> int:
        return len(self.counts)

    def take(self, rows: np.ndarray) -> Rows:
        counts = self.counts[rows]
        place = np.repeat(self.start[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return Rows(self.at[place], self.value[place], counts)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.at] * self.value, self.start)

    def sums(self, of_row: np.ndarray) -> np.ndarray:
        """Sum of the vectors, each times its number."""
        return np.bincount(self.at, np.repeat(of_row, self.counts) * self.value, DIMENSIONS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(positive: Rows, unlabelled: Rows, prior: float, *, non_negative: bool = True, steps: int = 300, batch: int = 1024, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (the last is the intercept) by Adam on the non-negative risk with the logistic loss, the mean over the last half of the steps."""
    rng = np.random.default_rng(seed)
    w, m, v, mean = (np.zeros(DIMENSIONS + 1) for _ in range(4))
    for step in range(1, steps + 1):
        p, u = (rows.take(rng.integers(0, len(rows), min(batch, len(rows)))) for rows in (positive, unlabelled))
        fp, fu = p.scores(w[:-1]) + w[-1], u.scores(w[:-1]) + w[-1]
        sp, su = _sigmoid(fp), _sigmoid(fu)
        loss_neg = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # gradients of the mean logistic losses with respect to the outputs
        neg_u, neg_p, pos_p = su / len(fu), sp / len(fp), (sp - 1) / len(fp)
        if not non_negative:
            gp, gu = pos_p, neg_u
        elif loss_neg < 0:
            gp, gu = prior * neg_p, -neg_u  # only undo what made the negative part fall below nought
        else:
            gp, gu = prior * pos_p - prior * neg_p, neg_u
        g = np.append(p.sums(gp) + u.sums(gu), gp.sum() + gu.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step > steps // 2:
            mean += w / (steps - steps // 2)
    return mean


def estimate_prior(positive: Rows, unlabelled: Rows, *, margin: float = 1.0) -> float:
    """Share of positives among the unlabelled, by the best bin of a positive-against-unlabelled model."""
    if len(positive) < 20 or len(unlabelled) < 20:
        return 0.5
    half = lambda rows, k: rows.take(np.arange(k, len(rows), 2))
    w = train(half(positive, 0), half(unlabelled, 0), 1.0, non_negative=False, steps=200)
    p, u = (np.sort(half(rows, 1).scores(w[:-1]) + w[-1]) for rows in (positive, unlabelled))
    cuts = np.quantile(p, np.linspace(0.0, 0.9, 91))
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    slack = margin * (np.sqrt(1 / (2 * len(p))) + np.sqrt(1 / (2 * len(u))))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.02, 0.98))


def placed(w: np.ndarray, unlabelled: Rows, prior: float, threshold: float) -> np.ndarray:
    """Weights with the intercept at which the prior's share of the unlabelled reaches the threshold."""
    cut = np.quantile(unlabelled.scores(w[:-1]), max(0.0, 1 - prior - 1 / math.sqrt(len(unlabelled))))
    return np.append(w[:-1], math.log(threshold / (1 - threshold)) - cut)


def _vectors(rows: DataFrame, most: int) -> list[list[tuple[bytes, bytes]]]:
    """Feature vectors of the rows that teach as positives, and of those that teach as unlabelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        for batch in slices(batches):
            got = [features(t, places) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["positive", "unlabelled", "at", "value"])

    found = rows.select("positive", "unlabelled", "text").mapInArrow(run, "positive boolean, unlabelled boolean, at binary, value binary").limit(most).toArrow()
    order = lambda x: (xxhash.xxh64_intdigest(x[0]), x)
    return [sorted(zip(*(found.filter(found.column(kind)).column(c).to_pylist() for c in ("at", "value")), strict=True), key=order) for kind in ("positive", "unlabelled")]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = 4000, max_unlabelled: int = 8000, threshold: float = 0.3, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and the estimated prior. Trusted positives are rows labelled 1; unlabelled are all rows of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    n = ids.count()
    # ids are distinct, so a hash draws them one by one; the limit is far out in the tail
    trusted = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(math.ceil(max_positive / n * 1_000_000))).limit(bound(max_positive)) if n > max_positive else ids
    flagged = rows.join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), "doc_id", "left")
    # only ids are read for the counts; rows with one id may be many
    total, of_trusted = flagged.agg(F.count("*"), F.count("trusted")).first()
    drawn = lambda most, of, k: F.rand(seed + k) < min(1.0, most / max(of, 1))
    drawn = flagged.select("text", (F.coalesce("trusted", F.lit(False)) & drawn(max_positive, of_trusted, 0)).alias("positive"), drawn(max_unlabelled, total, 1).alias("unlabelled"))
    positive, unlabelled = _vectors(drawn.where("(positive or unlabelled) and text is not null"), bound(max_positive) + bound(max_unlabelled))
    if not positive or not unlabelled:
        return np.zeros(DIMENSIONS + 1), 0.5
    positive, unlabelled = Rows.of(positive), Rows.of(unlabelled)
    prior = estimate_prior(positive, unlabelled)
    return placed(train(positive, unlabelled, prior), unlabelled, prior, threshold), prior


def scored(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with quality_score; every column, or those of `keep`, is kept (one of that name is replaced)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "quality_score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if text_col in kept else [F.col(f"`{text_col}`")]))
    at, n = rows.columns.index(text_col), len(kept)
    schema = StructType(rows.schema.fields[:n]).add("quality_score", DoubleType())
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, places = shared.value, _Places()
        for batch in slices(batches):
            out = [float(w[a] @ v + w[-1]) for a, v in (features(t, places) for t in batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(_sigmoid(np.array(out, float)), pa.float64())], [*kept, "quality_score"])

    return rows.mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    seen = docs.where(fold_of("doc_id", 5) != 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of("doc_id", 5) != 0)
    weights, _ = fit(seen, labels)
    found = scored(docs.select("doc_id", "text", (fold_of("doc_id", 5) == 0).alias("held_out")), weights, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))
