"""Language identification: word-first backoff.

A word that the model knows adds its log frequency in each language. An unseen word falls back to
character n-grams, longest first: the first length at which any of its n-grams is known decides, with
the mean of their log frequencies. A word is a letter and all letters and combining marks that follow it
(Unicode categories L and M, in lower case), of any length; fitting and prediction take words by the same
function. Runs of over 40 characters are never known as words and always go by all of their n-grams. A
text takes the language of the largest sum; its score is that language's share of the likelihood, tempered
by length.

The model is fitted on a bounded sample: rows drawn one by one, equal rows like others, until about
`sample_bytes` of text are expected, so a table of any size gives a model of bounded size. Words and
n-grams that occur fewer than `min_count` times in the sample, and those beyond `max_words` and `max_grams`
(the least frequent), are left out. Of more than `max_langs` languages the most frequent in the sample are
learned, and entries times languages are at most `max_cells`. What is broadcast is thus bounded.

Defined cases: a null text, or one without a letter, is `und` with score 0; training rows with a null
language or text teach nothing; with no training rows at all every text is `und`; a text with letters of
which nothing is known takes the first language; repeated rows count as often as they occur; ties go to
the language first in order; an empty table gives an empty one; long texts are judged whole, n-grams of a
run in blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from ._common import documents, fold_of, slices, staged, tidy

UNDETERMINED = "und"
GRAMS = (5, 4, 3, 2, 1)
#: The longest run of letters that is kept as a word.
LONGEST = 40
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> Iterator[str]:
    """A word's n-grams, a space at either edge."""
    edged = f" {word} "
    return (edged[i : i + n] for i in range(len(edged) - n + 1))


@dataclass
class Model:
    """Log frequencies: a row of the tables for each known word and n-gram, a column for each language."""

    langs: list[str]
    words: dict[str, int]
    word_table: np.ndarray
    grams: dict[str, int]
    gram_table: np.ndarray

    def of_word(self, word: str) -> np.ndarray | None:
        """Log frequency by language, or None if nothing of the word is known."""
        found = self.words.get(word)
        if found is not None:
            return self.word_table[found]
        edged, get = f" {word} ", self.grams.get
        for n in GRAMS:
            total, seen = 0.0, 0
            # in blocks, so that a run of any length takes bounded memory
            for lo in range(0, len(edged) - n + 1, 65_536):
                known = [g for i in range(lo, min(lo + 65_536, len(edged) - n + 1)) if (g := get(edged[i : i + n])) is not None]
                if known:
                    total, seen = total + np.add.reduce(self.gram_table[known]), seen + len(known)
            if seen:
                return total / seen
        return None


class Memo(dict):
    """word -> row of a table of log frequencies, kept between texts; row 0 is that of words of which nothing is known.

    Runs of over `LONGEST` characters are scored alike but not kept. The table has at most `cells` numbers.
    """

    def __init__(self, model: Model, cells: int = 1_000_000):
        super().__init__()
        self.limit = max(2, min(200_000, cells // max(len(model.langs), 1)))
        self.model, self.table, self.used = model, np.zeros((self.limit + 1, max(len(model.langs), 1))), 1

    def __missing__(self, word: str) -> int:
        value = self.model.of_word(word)
        row = 0
        if value is not None:
            row = self.used
            self.table[row] = value
            self.used += 1
        self[word] = row
        return row

    def total(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Sum of the words' rows, and of how many words something is known."""
        out, seen = np.zeros(self.table.shape[1]), 0
        if max(map(len, words), default=0) > LONGEST:
            for value in (self.model.of_word(w) for w in words if len(w) > LONGEST):
                if value is not None:
                    out += value
                    seen += 1
            words = [w for w in words if len(w) <= LONGEST]
        for at in range(0, len(words), self.limit // 2):
            part = words[at : at + self.limit // 2]
            if max(self.used, len(self)) + len(part) > self.limit:
                self.clear()
                self.used = 1
            rows = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            out += self.table[rows].sum(axis=0)
            seen += int(np.count_nonzero(rows))
        return out, seen


def detect(text: str | None, memo: Memo) -> tuple[str, float]:
    words = words_of(text)
    langs = memo.model.langs
    if not words or not langs:
        return UNDETERMINED, 0.0
    total, seen = memo.total(words)
    # evidence of neighbouring words is dependent: a mean, sharpened with the root of the number of words
    share = total / math.sqrt(max(seen, 1))
    share = np.exp(share - share.max())
    best = int(np.argmax(total))
    return langs[best], float(share[best] / share.sum())


_COUNTS = "lang string, word string, n long"


def _counted(rows: DataFrame, of: Callable[[list, str, list], None], most: int = 300_000) -> DataFrame:
    """Sums of what of(column, ...) adds to a counter of (lang, entry), gathered in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])
            found.clear()

        for batch in slices(batches):
            for lang, *given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = found.setdefault(lang, Counter())
                before = len(counts)
                of(counts, *given)
                size += len(counts) - before
                if size >= most:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.mapInArrow(tidy(run), _COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _words(counts: Counter, text: str) -> None:
    counts.update(words_of(text))


def _grams(counts: Counter, word: str, times: int) -> None:
    for n in GRAMS:
        for g in grams_of(word, n):
            if g != " ":
                counts[g] += times


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = 24_000_000, max_words: int = 120_000, max_grams: int = 120_000, min_count: int = 2, max_langs: int = 1000, max_cells: int = 5_000_000, seed: int = 7) -> Model:
    """Counts of words and n-grams by language over rows drawn until about sample_bytes of text are expected."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = rows.where(F.rand(seed) < sample_bytes / total) if total > sample_bytes else rows
    counts = staged(_counted(sample, _words), "word-counts")
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    langs = sorted(r.lang for r in by_lang.orderBy(F.desc("n"), "lang").limit(max_langs).collect())
    if not langs:
        return Model([], {}, np.zeros((0, 1)), {}, np.zeros((0, 1)))
    # at most max_langs names
    counts = counts.where(F.col("lang").isin(langs)) if len(langs) == max_langs else counts
    grams = _counted(counts, _grams)
    # longer runs teach their n-grams, but are not kept as words
    most = [max(1, min(m, max_cells // len(langs))) for m in (max_words, max_grams)]
    return Model(langs, *_logs(counts.where(F.length("word") <= LONGEST), langs, most[0], min_count), *_logs(grams, langs, most[1], min_count))


def _logs(counts: DataFrame, langs: list[str], most: int, least: int) -> tuple[dict[str, int], np.ndarray]:
    """Log frequency with half a count added; the `most` most frequent entries that occur `least` times."""
    by_word = counts.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("of"))
    kept = by_word.where(F.col("all") >= least).orderBy(F.desc("all"), "word").limit(most).select("word", "of").toArrow()
    words, of = kept.column("word").to_pylist(), kept.column("of").combine_chunks()
    n = np.zeros((len(words), len(langs)))
    if len(words):
        at = {x: i for i, x in enumerate(langs)}
        flat = of.flatten()
        rows = np.repeat(np.arange(len(words)), np.diff(of.offsets.to_numpy()))
        n[rows, [at[x] for x in flat.field("lang").to_pylist()]] = flat.field("n").to_numpy()
    table = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * max(len(words), 1)))
    return {w: i for i, w in enumerate(words)}, table


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score; every column, or those of `keep`, is kept (columns of these two names are replaced)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if text_col in kept else [F.col(f"`{text_col}`")]))
    at, n = rows.columns.index(text_col), len(kept)
    schema = StructType(rows.schema.fields[:n]).add("lang_pred", StringType()).add("score", DoubleType())
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(shared.value)
        for batch in slices(batches):
            got = [detect(t, memo) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*kept, "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(fold_of("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text").withColumn("held_out", fold_of("doc_id", 4) == 2), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")
