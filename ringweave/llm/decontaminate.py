"""Benchmark decontamination with an Aho-Corasick automaton.

Every word of the test items is one symbol of the automaton's alphabet (a code point), any other
word is a symbol of its own, so one pass over a document's words finds every window of every item. The
automaton is run over the stretches whose neighbouring words are neighbours in an item, as no window lies elsewhere.
Matches are counted in words and mapped back to character offsets of the original text.

An automaton holds at most about `block_bytes` of items, some 65 bytes of memory for each of theirs, so
what is broadcast and built is bounded however large the benchmark is. With one automaton (the usual case)
a document is scanned once and no row is shuffled. A larger benchmark takes several: each scans the texts
and gives rows only for documents that it hits, and those are joined with the documents at the end, so no
text is written in between.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item never
matches, nor does one whose id is null, as it can't be named; repeated item rows are one item, and an item
id with several texts is one item with the windows of all; a null document id is carried through; repeated
documents are judged one by one; contamination() reads the id and the text only, flagged() keeps all
columns and replaces those of its own names; an empty table gives an empty one, an empty benchmark no hits;
a long text is scanned whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import documents, merged_runs, staged

FOUND_COLUMNS = ("n_words", "n_hit", "items", "spans")
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
#: Lower-cases A-Z; ASCII other than letters and digits becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_OTHER = "\x01"
_built: dict[str, Tests] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _symbol(n: int) -> str:
    return chr(n + 2 if n + 2 < 0xD800 else n + 2 + 0x800)


@dataclass
class Tests:
    """The alphabet, the automaton, whose values are set * base + length in words, the sets of item ids, the pairs of neighbouring symbols and the words of the shortest window."""

    alphabet: dict[bytes, str]
    automaton: ahocorasick.Automaton
    base: int
    sets: list[tuple[str, ...]]
    pairs: np.ndarray
    least: int


def build(items: list[tuple[str, bytes | None]], window: int) -> Tests:
    alphabet: dict[bytes, str] = {}
    owners: dict[str, tuple[str, ...] | set[str]] = {}
    pairs: list[np.ndarray] = []
    for item, text in items:
        symbols, own = "".join([alphabet.setdefault(w, _symbol(len(alphabet))) for w in words_of(text)]), (item,)
        size = min(window, len(symbols))
        if size:
            pairs.append(_pairs(symbols))
        for i in range(len(symbols) - size + 1 if size else 0):
            pattern = symbols[i : i + size]
            have = owners.setdefault(pattern, own)  # most windows are of one item and share its tuple
            if isinstance(have, set):
                have.add(item)
            elif have[0] != item:
                owners[pattern] = {*have, item}
    automaton, sets = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
    for pattern, found in owners.items():
        automaton.add_word(pattern, sets.setdefault(tuple(sorted(found)), len(sets)) * (window + 1) + len(pattern))
    if owners:
        automaton.make_automaton()
    return Tests(alphabet, automaton, window + 1, list(sets), np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64), min(map(len, owners), default=1))


def _pairs(symbols: str) -> np.ndarray:
    code = np.frombuffer(symbols.encode("utf-32-le"), "<u4").astype(np.int64)
    return code[:-1] << 32 | code[1:]


def stretches(symbols: str, tests: Tests) -> list[tuple[int, int]]:
    """Where a window can lie: as many words as the shortest has, all neighbours of which are neighbours in an item.

    A step of the automaton goes through a state's successors one by one, which at its root are all words of the items.
    """
    if tests.least < 2:
        return [(0, len(symbols))]
    pairs = _pairs(symbols)
    at = np.minimum(np.searchsorted(tests.pairs, pairs), len(tests.pairs) - 1)
    edge = np.diff(np.concatenate(([False], tests.pairs[at] == pairs, [False])).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    long = last - first >= tests.least
    return list(zip(first[long].tolist(), last[long].tolist(), strict=True))


def scan(words: list[bytes], tests: Tests) -> tuple[list[int], list[str]]:
    """Runs of hit words as starts and ends by turns, and the items found."""
    if not words or not len(tests.automaton):
        return [], []
    get = tests.alphabet.get
    symbols = "".join([get(w, _OTHER) for w in words])
    found = [(a + end, value) for a, b in stretches(symbols, tests) for end, value in tests.automaton.iter(symbols[a:b])]
    if not found:
        return [], []
    ends, values = np.array(found, np.int64).T
    items = {i for k in np.unique(values // tests.base).tolist() for i in tests.sets[k]}
    return np.stack(merged_runs(ends + 1 - values % tests.base, ends + 1), 1).ravel().tolist(), sorted(items)


def _finding(text: bytes | None, words: list[bytes], runs: list[int], items: list[str]) -> tuple[int, int, list[str], list[dict]]:
    if not runs:
        return len(words), 0, items, []
    at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
    pairs = list(zip(runs[::2], runs[1::2], strict=True))
    return len(words), sum(b - a for a, b in pairs), items, [{"start": at[a][0], "end": at[b - 1][1]} for a, b in pairs]


def _blocks(rows: DataFrame, block_bytes: int) -> list[DataFrame]:
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    return [rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k) for k in range(parts)]


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: its words, the words hit by any item's window, those items and the hit spans in characters."""
    rows = docs.select(F.struct(F.col(f"`{id_col}`").cast("long").alias("doc_id")).alias("carried"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return _searched(rows, benchmark, **options).select("carried.doc_id", *FOUND_COLUMNS)


def flagged(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """docs with n_words, n_hit, items and spans (columns of these names are replaced)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in FOUND_COLUMNS]
    return _searched(docs.select(F.struct(*kept).alias("carried")), benchmark, text_col=text_col, **options).select("carried.*", *FOUND_COLUMNS)


def _searched(rows: DataFrame, benchmark: DataFrame, *, window: int = 8, text_col: str | None = None, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """carried and what is found, for rows of a struct `carried` and their `text`, which with text_col is a field of it."""
    text = F.col("text") if text_col is None else F.col("carried").getField(text_col).cast("binary")
    tests = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("binary").alias("t")).where("i is not null and t is not null")
    context, held = rows.sparkSession.sparkContext, rows.schema["carried"].dataType
    share = lambda block: context.broadcast((uuid.uuid4().hex, [(r.i, bytes(r.t)) for r in block.collect()], window))
    blocks = _blocks(tests, block_bytes)
    kinds = T.StructType([T.StructField("carried", held), *T._parse_datatype_string(FOUND).fields])
    if len(blocks) == 1:
        return rows.mapInArrow(_finder(text_col, _scanner(share(blocks[0]))), kinds)
    key = [F.xxhash64("carried").alias("_a"), F.xxhash64(text, F.lit(1)).alias("_b"), F.crc32(F.coalesce(text, F.lit(b""))).alias("_c")]
    keyed, hits = rows.select(*key, "*"), None
    for block in blocks:
        found = keyed.select("_a", "_b", "_c", text.alias("text")).mapInArrow(_hits(_scanner(share(block))), "_a long, _b long, _c long, runs array<int>, items array<string>")
        hits = found if hits is None else hits.unionByName(found)
    # a document's hits are no more than its words and the benchmark's items
    hits = staged(hits, "hits").groupBy("_a", "_b", "_c").agg(F.flatten(F.collect_set("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("found"))
    return keyed.join(hits, ["_a", "_b", "_c"], "left").select(*rows.columns, "runs", "found").mapInArrow(_finder(text_col, None), kinds)


def _scanner(shared):
    """The search in a task: words to runs and items, by the automaton of the broadcast items."""

    def find(words: list[bytes]) -> tuple[list[int], list[str]]:
        name, *given = shared.value
        if name not in _built:
            _built.clear()
            _built[name] = build(*given)
        return scan(words, _built[name])

    return find


def _hits(search):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                got = [search(words_of(t)) for t in batch.column(3).to_pylist()]
                hit = [i for i, (_, items) in enumerate(got) if items]
                columns = [batch.column(i).take(pa.array(hit, pa.int64())) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([got[i][0] for i in hit], pa.list_(pa.int32())), pa.array([got[i][1] for i in hit], pa.list_(pa.string()))], ["_a", "_b", "_c", "runs", "items"])

    return find


def _finder(text_col: str | None, search):
    """Rows with what is found: by a search, or as the columns `runs` and `found` have it."""
    types = [f.type for f in to_arrow_schema(T._parse_datatype_string(FOUND))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                carried = batch.column("carried")
                texts = batch.column("text") if text_col is None else pc.cast(pc.struct_field(carried, text_col), pa.binary())
                known = zip(batch.column("runs").to_pylist(), batch.column("found").to_pylist(), strict=True) if search is None else None
                for text in texts.to_pylist():
                    words = words_of(text)
                    if known is None:
                        runs, items = search(words)
                    else:
                        runs, items = next(known)
                        pairs = np.array(runs or [], np.int64).reshape(-1, 2)
                        runs, items = np.stack(merged_runs(pairs[:, 0], pairs[:, 1]), 1).ravel().tolist(), sorted(items or [])
                    out.append(_finding(text, words, runs, items))
                yield pa.RecordBatch.from_arrays([carried, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], ["carried", *FOUND_COLUMNS])

    return find


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(8, len(w)) AS k, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bn),
dn AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
m AS (SELECT doc_id, dn.k, i, item FROM dn JOIN bn ON dn.win = bn.win AND dn.k = bn.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(dw.w), 0) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(it.n, 0) >= 2 AS contaminated
FROM documents d LEFT JOIN dw USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
