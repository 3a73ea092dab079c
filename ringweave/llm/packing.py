"""Sequence packing by lexical retrieval.

Documents lie in shards of at most `shard_tokens` tokens and `shard_docs` documents, each with a BM25
inverted index. A seed document, the first of its shard that is unused, queries the index with all of its
tokens, and its best unused neighbours follow it until the window of `window` tokens is full; a document
that does not fit is cut and goes on in the next window, whose seed it is. A window that a shard's
documents don't fill is filled from the next shard, for the same seed.

Shards hold what is alike. Documents are ordered by a cluster of their token weights (spherical k-means,
fitted on a sample of `sample_docs` rows), then by the smallest hash of their runs of `gram` tokens, which
near copies mostly share, and shards are cut from that order. The sample steers only where documents lie.
Scores use document frequencies, lengths and the number of documents of the whole table. So a seed
finds the best unused documents of its shard, not of the table: searching all of the table for each seed
grows with the table's square. README states the share of the table's best neighbours that shards hold.

Tokens are made once and staged; ordering is one shuffle, by ranges of a key that ends with the row's
number, so that neither a cluster nor copies of one text make a task large. A task streams its shards, one
in memory at a time, and ends with one window that may be short: it is cut into sequences whose lengths
are powers of two, which need no padding.

Tokens: those of `public_tokenizers.path("byte_bpe_50k.json")` without special tokens, then the end id.

Defined cases: null and empty texts are the end id alone; every token of every row is placed exactly
once; repeated rows are packed one by one; ties between neighbours go to the earlier row in the shard's
order; a text longer than a shard is a shard of its own; an empty table gives no pieces; other columns
are not read. sequence_id is unique, not without gaps: the task's number above, the sequence's in it below.
"""

from __future__ import annotations

import base64
import json
import pickle
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_schema, documents, gram_hashes, mixed, sampled, staged, tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[tuple[str, str], Encoder] = {}
_UNSETTLED = re.compile("[^\\x00-ɏ]")
K1, B = 1.2, 0.75
#: Weights are rounded to this part of one, so that sums below 2**18 are exact in float32 in any order.
PART = 64
#: Components of the projection that clusters are made of.
AXES = 64


class Encoder:
    """Token ids of texts.

    Texts of characters below U+0250, whose classes are settled, go through the byte-pair ranks of the
    same vocabulary with the same pattern, which is several times faster; a text with any other character,
    or one that names a special token, goes through the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as f:
            found = {base64.b64decode(token): int(n) for token, n in (line.split() for line in f if line.strip())}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=found, special_tokens={})
        self.path, self.slow = tokenizer, None
        with open(tokenizer, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self.one(t) if t else np.empty(0, "<u4") for t in texts]

    def one(self, text: str) -> np.ndarray:
        if _UNSETTLED.search(text) or any(s in text for s in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def id_kind(tokenizer: str, ranks: str, end_id: int) -> str:
    """The type in which ids of this vocabulary are kept between steps."""
    with open(ranks, "rb") as f:
        most = max([end_id, *(int(line.split()[1]) for line in f if line.strip())])
    with open(tokenizer, encoding="utf-8") as f:
        most = max([most, *(t["id"] for t in json.load(f).get("added_tokens", []))])
    return "<u2" if most < 1 << 16 else "<u4"


def encoder(tokenizer: str, ranks: str) -> Encoder:
    if (tokenizer, ranks) not in _encoders:
        _encoders.clear()
        _encoders[tokenizer, ranks] = Encoder(tokenizer, ranks)
    return _encoders[tokenizer, ranks]


@dataclass
class Corpus:
    """Figures of the whole table: documents by token, number of documents, tokens in all."""

    df: np.ndarray
    n: int
    tokens: int

    def _count(self, df: np.ndarray) -> None:
        if len(df) > len(self.df):
            self.df = np.append(self.df, np.zeros(len(df) - len(self.df), np.int64))
        self.df[: len(df)] += df

    def add(self, made: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Takes in documents, given as their distinct tokens and counts."""
        self._count(np.bincount(np.concatenate([t for t, _ in made])))
        self.n, self.tokens = self.n + len(made), self.tokens + sum(int(c.sum()) for _, c in made)

    def join(self, other: Corpus) -> None:
        self._count(other.df)
        self.n, self.tokens = self.n + other.n, self.tokens + other.tokens

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.minimum(terms, len(self.df) - 1)] * (terms < len(self.df))
        return np.log(1 + (self.n - df + 0.5) / (df + 0.5))

    def weights(self, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """BM25 weights of tokens that occur tf times in documents of so many tokens."""
        norm = K1 * (1 - B + B * sizes / max(self.tokens / max(self.n, 1), 1))
        return np.rint(self.idf(terms) * tf * (K1 + 1) / (tf + norm) * PART).astype(np.float32) / np.float32(PART)


class Index:
    """A BM25 inverted index over the token ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        self.n = len(docs)
        made = [np.unique(d, return_counts=True) for d in docs]
        counts = np.array([len(t) for t, _ in made], np.int64)
        self.terms = [t for t, _ in made]
        term = np.concatenate(self.terms) if made else np.empty(0, np.uint32)
        tf = np.concatenate([c for _, c in made]) if made else np.empty(0, np.int64)
        doc = np.repeat(np.arange(self.n), counts)
        weight = corpus.weights(term, tf, np.repeat([len(d) for d in docs], counts))
        order = np.argsort(term, kind="stable")
        self.vocabulary, df = np.unique(term, return_counts=True)
        self.start = np.concatenate(([0], np.cumsum(df)))
        self.doc, self.weight = doc[order], weight[order]

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """A row for each query (distinct tokens), a column for each document: common tokens by a matrix product, rare ones pair by pair."""
        out = np.zeros((len(queries), self.n), np.float32)
        flat, of = np.concatenate(queries), np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == flat
        at, of = at[known], of[known]
        df = np.diff(self.start)
        common = np.flatnonzero(df * 16 >= self.n)
        column = np.full(len(df), -1)
        column[common] = np.arange(len(common))
        asked = np.zeros((len(queries), len(common)), np.float32)
        asked[of[column[at] >= 0], column[at[column[at] >= 0]]] = 1
        held = np.zeros((len(common), self.n), np.float32)
        place = np.repeat(column, df)
        held[place[place >= 0], self.doc[place >= 0]] = self.weight[place >= 0]
        np.matmul(asked, held, out=out)
        at, of = at[column[at] < 0], of[column[at] < 0]
        times = df[at]
        ends = np.cumsum(times)
        for lo, hi in _blocks(ends, 1_000_000):
            n = times[lo:hi]
            pair = np.repeat(np.arange(lo, hi), n)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            posting = self.start[at[pair]] + nth
            np.add.at(out.reshape(-1), of[pair] * self.n + self.doc[posting], self.weight[posting])
        return out


def _blocks(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries that come to about `most` in all; ends: the running sum."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


class Windows:
    """The windows of one task, filled shard by shard."""

    def __init__(self, window: int, corpus: Corpus):
        self.window, self.corpus = window, corpus
        self.placed: list[tuple[int | None, np.ndarray]] = []
        self.filled = self.out = self.start = self.sequence = 0
        self.seed: np.ndarray | None = None

    def _place(self, name: int | None, ids: np.ndarray) -> None:
        self.placed.append((name, ids))
        self.filled += len(ids)

    def add(self, names: list, docs: list[np.ndarray]) -> None:
        """Places all documents of a shard."""
        if not docs:
            return
        index, used, cursor = Index(docs, self.corpus), np.zeros(len(docs), bool), 0
        scores = index.scores(index.terms)
        score = None if self.seed is None else index.scores([self.seed])[0]
        while not used.all():
            if score is None:
                while used[cursor]:
                    cursor += 1
                used[cursor] = True
                self._place(names[cursor], docs[cursor])
                self.seed, score = index.terms[cursor], scores[cursor]
            last, end = cursor, -(-self.filled // self.window) * self.window
            for d in _ranked(np.flatnonzero(~used & (score > 0)), score) if self.filled < end else ():
                used[d], last = True, d
                self._place(names[d], docs[d])
                if self.filled >= end:
                    break
            if self.filled == end:
                self.seed = score = None
            elif self.filled > end:  # what hangs over into the next window is that window's seed
                self.seed, score = index.terms[last], scores[last]
            else:
                score = None

    def pieces(self, last: bool) -> Iterator[tuple]:
        """The pieces of the windows that are full; last: of the rest as well."""
        lengths = [self.window] * ((self.filled - self.out) // self.window)
        if last:
            lengths += sequences((self.filled - self.out) % self.window, self.window)
        i = 0
        for size in lengths:
            at = 0
            while at < size:
                name, ids = self.placed[i]
                n = min(size - at, len(ids) - self.start)
                piece = ids[self.start : self.start + n].tobytes()
                yield name, self.start, n, zlib.crc32(piece), len(ids), self.sequence, at, piece
                at, self.start = at + n, self.start + n
                if self.start == len(ids):
                    i, self.start = i + 1, 0
            self.sequence, self.out = self.sequence + 1, self.out + size
        del self.placed[:i]


def _ranked(rows: np.ndarray, score: np.ndarray, first: int = 32) -> Iterator[int]:
    """Rows by falling score, equal ones in order; the first few are sorted apart, as a window seldom takes more."""
    own = score[rows]
    if len(rows) > 4 * first:
        high = own >= np.partition(own, len(own) - first)[len(own) - first]
        yield from rows[high][np.argsort(-own[high], kind="stable")].tolist()
        rows, own = rows[~high], own[~high]
    yield from rows[np.argsort(-own, kind="stable")].tolist()


def sequences(total: int, window: int) -> list[int]:
    """Lengths of the sequences for so many tokens: whole windows, then powers of two."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


_axes: dict[int, np.ndarray] = {}


def _projected(terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of tokens summed along random directions, at length one; zeros for no weight."""
    top = 1 << max(16, int(terms.max(initial=0)).bit_length())
    if top not in _axes:
        _axes[top] = np.random.default_rng(5).choice(np.array([-1, 1], np.float32), (top, AXES))
    out = weight.astype(np.float32) @ _axes[top][terms]
    size = np.linalg.norm(out)
    return out / size if size else out


class Placement:
    """Where documents lie: clusters of token weights, numbered so that clusters that are alike are near."""

    def __init__(self, sample: list[np.ndarray], clusters: int, steps: int = 12):
        made = [np.unique(d, return_counts=True) for d in sample]
        df = np.bincount(np.concatenate([t for t, _ in made])) if made else np.zeros(1, np.int64)
        self.corpus = Corpus(df, len(sample), sum(map(len, sample)))
        x = self.vectors(made) if made else np.zeros((1, AXES), np.float32)
        rng = np.random.default_rng(3)
        clusters = max(1, min(clusters, len(x)))
        c = x[rng.choice(len(x), clusters, replace=False)]
        for _ in range(steps if clusters > 1 else 0):
            own = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1)
            c[size > 0] = sums[size > 0] / size[size > 0, None]
        axis = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0]
        self.centres = c[np.argsort(c @ axis, kind="stable")]

    def vectors(self, made: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row for each document, given as its distinct tokens and their counts."""
        counts = np.array([len(t) for t, _ in made])
        sizes = np.repeat([int(c.sum()) for _, c in made], counts)
        weight = self.corpus.weights(np.concatenate([t for t, _ in made]), np.concatenate([c for _, c in made]), sizes)
        return np.array([_projected(t, w) for (t, _), w in zip(made, np.split(weight, np.cumsum(counts)[:-1]), strict=True)])

    def clusters(self, made: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return (self.vectors(made) @ self.centres.T).argmax(axis=1) if len(self.centres) > 1 else np.zeros(len(made), int)


def least_runs(docs: list[np.ndarray], gram: int) -> np.ndarray:
    """The smallest hash of each document's runs of `gram` tokens; a shorter document is one run."""
    sizes = np.array([len(d) for d in docs])
    flat = np.concatenate(docs).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    out = np.empty(len(docs), np.uint64)
    whole = np.flatnonzero(sizes >= gram)
    if len(whole):
        runs = np.append(mixed(gram_hashes(flat, gram)), np.uint64(0))
        # runs that begin in a document and end in the next one are left out
        out[whole] = np.minimum.reduceat(runs, np.stack((ends[whole] - sizes[whole], ends[whole] - gram + 1), 1).ravel())[::2]
    for i in np.flatnonzero(sizes < gram).tolist():
        out[i] = mixed(gram_hashes(flat[ends[i] - sizes[i] : ends[i]], int(sizes[i])))[0]
    return (out >> np.uint64(1)).astype(np.int64)


def _cuts(texts: pa.Array, rows: int = 512, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Places and numbers of rows that come to at most `rows` and `most` bytes of text, or are one."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right"))))
        yield lo, hi - lo
        lo = hi


def _encoded(code: Encoder, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    for lo in range(0, len(texts), 128):
        for ids in code.encode(texts.slice(lo, 128).to_pylist()):
            yield np.append(ids, np.uint32(end_id))


def _binary(found: list[np.ndarray], kind: str) -> pa.Array:
    return pa.array([x.astype(kind).tobytes() for x in found], pa.binary())


def pack(docs: DataFrame, *, window: int = 2048, end_id: int = 1, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 3_000_000, shard_docs: int = 3000, sample_docs: int = 4000, most_clusters: int = 256, gram: int = 4, most_tasks: int = 20_000, with_ids: bool = True) -> DataFrame:
    """One row per piece, with_ids: with its token ids; sequences are unique over the whole table.

    sample_docs bounds the rows that clusters are fitted on, most_clusters their number; each task takes
    about two shards, more only beyond most_tasks tasks.
    """
    if tokenizer is None or ranks is None:
        import public_tokenizers

        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total, n = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    # a token has some 2.5 bytes or more; numbers of tasks and clusters need no more than that
    shards = max(1, -(-int(total or 0) // int(2.5 * shard_tokens)), -(-n // shard_docs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                yield pa.RecordBatch.from_arrays([_binary(list(_encoded(code, batch.column(0).slice(lo, 512), end_id)), "<u4")], ["ids"])

    sample = sampled(rows.select("text"), n, sample_docs, lambda df: df.mapInArrow(encode, "ids binary")).toArrow().column("ids").to_pylist() if shards > 1 else []
    context = rows.sparkSession.sparkContext
    placement = context.broadcast(Placement([np.frombuffer(x, "<u4") for x in sample], min(most_clusters, 4 * shards) if shards > 1 else 1))

    kind = id_kind(tokenizer, ranks, end_id)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their tokens and place; a last row without a number holds the task's figures."""
        code, where, own = encoder(tokenizer, ranks), placement.value, Corpus(np.zeros(1, np.int64), 0, 0)
        for whole in batches:
            for lo, n in _cuts(whole.column(2)):
                batch = whole.slice(lo, n)
                ids = list(_encoded(code, batch.column(2), end_id))
                made = [np.unique(d, return_counts=True) for d in ids]
                own.add(made)
                arrays = [batch.column(0), batch.column(1), pa.array(where.clusters(made), pa.int32()), pa.array(least_runs(ids, gram)), _binary(ids, kind), pa.nulls(len(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, token_names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())), pa.array([pickle.dumps(own)])], token_names)

    token_names = ["row", "doc_id", "cluster", "least", "ids", "figures"]
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    tokens = staged(numbered.mapInArrow(tidy(place), "row long, doc_id long, cluster int, least long, ids binary, figures binary"), "tokens")
    shared = context.broadcast(_corpus(tokens.select("figures")))
    names = [*(f.strip().split()[0] for f in PIECES.split(",")), *(["ids"] if with_ids else [])]
    ddl = PIECES + (", ids binary" if with_ids else "")
    schema = arrow_schema(ddl)

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, size = Windows(window, shared.value), ([], []), 0
        base = TaskContext.get().partitionId() << 33

        def made(last: bool = False) -> Iterator[pa.RecordBatch]:
            windows.add(*held)
            out = []
            for name, start, length, crc, count, sequence, offset, piece in windows.pieces(last):
                out.append((name, start, length, crc, count, base + sequence, offset, *([piece] if with_ids else [])))
                if len(out) >= 2048:
                    yield _table(out, schema, names)
                    out.clear()
            if out:
                yield _table(out, schema, names)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                d = np.frombuffer(ids.as_py(), kind).astype("<u4")
                if held[0] and (size + len(d) > shard_tokens or len(held[0]) >= shard_docs):
                    yield from made()
                    held, size = ([], []), 0
                held[0].append(name)
                held[1].append(d)
                size += len(d)
        yield from made(last=True)

    tasks = max(1, min(-(-shards // 2), most_tasks))
    order = ["cluster", "least", "row"]
    return tokens.where("row is not null").repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(tidy(laid), ddl)


def _table(out: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], names)


def _corpus(figures: DataFrame) -> Corpus:
    """Figures of all rows from those of the tasks, which are added in tasks and then by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Corpus(np.zeros(1, np.int64), 0, 0)
        for batch in batches:
            for one in batch.column(0):
                if one.is_valid:
                    own.join(pickle.loads(one.as_py()))
        at = np.flatnonzero(own.df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], at)), pa.array(np.append([own.n, own.tokens], own.df[at]))], ["term", "n"])

    got = figures.where("figures is not null").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, count = got.column("term").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(int(term.max(initial=0)) + 1, np.int64)
    df[term[term >= 0]] = count[term >= 0]
    figure = lambda k: int(count[term == k].sum())
    return Corpus(df, figure(-2), figure(-1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False)


assert sys.byteorder == "little"
