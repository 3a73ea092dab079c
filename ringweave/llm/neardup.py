"""Near duplicates with HyperMinHash sketches.

A document's set is its distinct runs of `shingle` words. Every shingle is hashed once: some bits pick
one of `REGISTERS` buckets, and the bucket keeps its smallest hash as a leading-zero count and
`MANTISSA` further bits, 16 bits in all. Empty registers (short documents) borrow from others by a
fixed chain that is the same for all documents.

1. Documents with equal sets form a class, found by grouping a digest; classes go on, under numbers of
   their own, copies don't. A class is represented by its smallest id and one text of that id.
2. Bands of `ROWS` registers are hashed. Each bucket's smallest class is its pivot, and every other
   member pairs with it: pairs grow with the members, not with their square. Members reach their pivot
   by a key salted with their own number, so a large bucket is dealt to several tasks.
3. Pairs whose collision-corrected estimate is out of reach of the threshold are dropped, the rest
   are confirmed on the full sets of shingles; confirmed links give components.
4. A bucket that holds several components may hide links between members other than the pivot. Its
   members, dealt in blocks, are compared block by block, across components only, on registers and, as
   far as the estimate leaves them, on their sets. Links found so are confirmed like the others, and the
   components are joined. No pair that isn't a link leaves its block.

A truly linked pair shares no band with a probability under 1e-10 at the threshold.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; a text of
fewer words than a shingle has one shingle, all its words; equal sets are one class however many rows
share them; a row with a null id gets no component and is kept; repeated rows are in one class; rows of one
id with different sets are documents of their own, each with its own links; only the id and the text are
read of a table's columns; an empty table gives an empty one; a long text is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Tables, WordHashes, arrow_schema, documents, gram_hashes, mixed, slices, staged, tidy
from ._components import components

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
_hashes = WordHashes()
_CHAIN = np.array([[int(mixed(np.array([(i << 20) + t + 1], np.uint64))[0] % np.uint64(REGISTERS)) for t in range(2048)] for i in range(REGISTERS)])
SKETCH = "doc_id long, text_hash long, n long, digest binary, registers binary"


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingles(text: bytes | None, size: int = 5) -> set[bytes]:
    """The full set, as strings of words joined by a space."""
    words = words_of(text)
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def shingle_hashes(text: bytes | None, size: int = 5) -> np.ndarray:
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(_hashes.of(words), min(size, len(words))) ^ np.uint64(0 if len(words) >= size else len(words)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: leading zeros of the bucket's smallest hash above, mantissa bits below."""
    h = mixed(hashes)
    bucket = (h & np.uint64(REGISTERS - 1)).astype(np.int64)
    value = h >> np.uint64(8)  # 56 bits
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket, value)
    full = least != np.iinfo(np.uint64).max
    # the exponent of the exact double gives the leading zeros; the bits after the leading one are the mantissa
    _, exponent = np.frexp(np.where(full, least, np.uint64(1)).astype(float))
    exponent = np.minimum(exponent, 56)
    exponent = np.where((np.uint64(1) << np.maximum(exponent - 1, 0).astype(np.uint64)) > np.where(full, least, np.uint64(1)), exponent - 1, exponent)
    shift = exponent - 1 - MANTISSA
    top = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64), least << np.maximum(-shift, 0).astype(np.uint64))
    out = ((56 - exponent).astype(np.uint64) << np.uint64(MANTISSA)) | (top & np.uint64((1 << MANTISSA) - 1))
    if not full.all() and len(hashes):
        empty = np.flatnonzero(~full)
        lent = full[_CHAIN[empty]]
        out[empty] = out[_CHAIN[empty, lent.argmax(axis=1)]]
    return out.astype(np.uint16)


_chance: dict[tuple[int, int], float] = {}


def chance(n: int, m: int) -> float:
    """Expected share of registers that agree by accident in sketches of n and m elements."""
    a, b = (round(np.log2(max(x, 1)) * 4) for x in (n, m))
    if (a, b) not in _chance:
        n, m = 2 ** (a / 4) / REGISTERS, 2 ** (b / 4) / REGISTERS
        j = np.arange(1 << MANTISSA)[None, :]
        i = np.arange(1, 57)[:, None]
        low, high = (2.0 ** (MANTISSA) + j) / 2.0 ** (MANTISSA + i), (2.0 ** (MANTISSA) + j + 1) / 2.0 ** (MANTISSA + i)
        mass = lambda k: np.exp(-k * low) - np.exp(-k * high)
        _chance[a, b] = float((mass(n) * mass(m)).sum())
    return _chance[a, b]


def reach(agree: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the collision-corrected estimate of sets of n and m elements may lie at the threshold or above.

    Sizes alone rule out a pair whose smaller set is too small. The margin is six standard deviations
    of as many draws as there are independent registers; short sets are always confirmed.
    """
    small, large = np.minimum(n, m), np.maximum(n, m)
    c = np.array([chance(int(x), int(y)) for x, y in zip(n, m, strict=True)]) if len(n) else np.empty(0)
    estimate = np.maximum(agree - c, 0) / (1 - c)
    margin = 6 * np.sqrt(threshold * (1 - threshold) / np.minimum(REGISTERS, np.maximum(small / 2, 1)))
    return (small >= threshold * large) & ((small < 2 * REGISTERS) & (estimate > 0.3) | (estimate + margin >= threshold) | (small < 32))


def sketches(docs: DataFrame, *, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    schema = arrow_schema(SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column(2):
                h = shingle_hashes(text.as_py(), shingle)
                out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), registers(h).tobytes()) if len(h) else (0, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[2:], strict=True))], schema=schema)

    return rows.mapInArrow(tidy(run), SKETCH)


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes that the estimate leaves."""
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(-1, REGISTERS) for name in ("r_a", "r_b"))
            keep = reach((a == b).mean(axis=1), *(batch.column(name).to_numpy() for name in ("n_a", "n_b")), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs whose full sets have 100 * common >= percent * union."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, set()
        for batch in slices(batches, 256):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if y != last:
                    last, kept = y, shingles(y, shingle)
                own = shingles(x, shingle)
                common = len(own & kept)
                keep.append(100 * common >= percent * (len(own) + len(kept) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(tidy(run), "a long, b long")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node and its set as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t, shingle).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "hashes"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node long, hashes binary")


def _block_links(members: DataFrame, percent: int, block: int, block_bytes: int) -> DataFrame:
    """Links between members of unresolved buckets, across components: per pair of blocks a spanning set of them.

    members: key, size, bytes, band, node, label, registers, hashes. A bucket is dealt to blocks of about
    `block` members and `block_bytes` of sets, and each pair of blocks is one group, so a group is bounded.
    A pair is compared in the first band it shares; pairs never leave the group, links do, and of those
    only such as join two components that the group has not joined yet.
    """
    threshold = percent / 100
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    dealt = members.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def run(table: pa.Table) -> pa.Table:
        own, node, label = (table.column(c).to_numpy() for c in ("own", "node", "label"))
        lo, hi, band = (int(table.column(c)[0].as_py()) for c in ("lo", "hi", "band"))
        r = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        n = np.array([len(h) for h in sets])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        out: tuple[list, list] = ([], [])
        for i in left.tolist():
            others = right[(label[right] != label[i]) & ((node[right] > node[i]) if lo == hi else True)]
            small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
            others = others[100 * small >= percent * large]
            if not len(others):
                continue
            same = r[others] == r[i]
            first = same.reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1)
            keep = first == band
            keep[keep] = reach(same[keep].mean(axis=1), np.full(keep.sum(), n[i]), n[others[keep]], threshold)
            others = others[keep]
            for at in range(0, len(others), 1024):
                part = others[at : at + 1024]
                flat = np.concatenate([sets[k] for k in part])
                place = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
                common = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(n[part])[:-1])))
                for k in part[100 * common >= percent * (n[part] + n[i] - common)].tolist():
                    x, y = root(int(label[i])), root(int(label[k]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out[0].append(max(int(node[i]), int(node[k])))
                        out[1].append(min(int(node[i]), int(node[k])))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return pairs.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long")


#: Parts of a bucket that reach its pivot in tasks of their own.
SALTS = 4


def near_duplicates(docs: DataFrame, *, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = 2048, block_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept, per row of docs.

    text_hash (xxhash64 of the text) tells rows of one id apart; chosen holds for the rows of one text in
    each component, and for rows that are linked with nothing.
    """
    threshold, tables = percent / 100, Tables(docs.sparkSession)
    sketch = staged(sketches(docs, shingle=shingle, id_col=id_col, text_col=text_col), "sketch")
    grouped = sketch.where("doc_id is not null and n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n").alias("n"), F.max("registers").alias("registers"))
    classes = staged(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("first.doc_id").alias("rep"), "first.text_hash", "n", "registers"), "classes")
    bands = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("registers", b * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    salted = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = tables.keep(bands.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).select("key", "band", "node", "pivot", "size"), "buckets")
    pairs = shared.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    likely = tables.keep(_estimated(pairs, classes, threshold), "likely")

    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.xxhash64(F.col(text_col).cast("binary")).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    named = classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "rep", "text_hash")
    # repeated rows have one text
    texts = tables.keep(rows.join(named, ["rep", "text_hash"]).dropDuplicates(["rep", "text_hash"]).select("node", "text"), "texts")
    links = tables.keep(_confirmed(likely, texts, percent, shingle).distinct(), "links")
    labels = components(links)

    # buckets of more than two in which several components are left
    known = shared.where("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_keys = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    left = tables.keep(known.join(mixed_keys, "key", "left_semi").select("key", "band", "node", "label").join(classes.select("node", "n", "registers"), "node"), "unresolved")
    sizes = left.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.col("n") * 8).alias("bytes"))
    sets = _shingle_sets(texts.join(left.select("node").distinct(), "node", "left_semi"), shingle)
    members = left.join(sizes, "key").join(sets, "node")
    further = _block_links(members, percent, block, block_bytes).distinct()
    more = tables.keep(_confirmed(further, texts, percent, shingle), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    tables.drop("buckets", "likely", "texts", "links", "unresolved")

    in_component = labels.join(classes.select("node", "rep"), "node")
    firsts = in_component.groupBy("label").agg(F.min(F.struct("rep", "node")).alias("of"))
    of_class = classes.select("digest", "node", "rep", F.col("text_hash").alias("own")).join(labels.join(firsts, "label").select("node", "of"), "node", "left")
    of_class = of_class.select("digest", "own", F.coalesce("of.rep", "rep").alias("component"), F.coalesce(F.col("of.node") == F.col("node"), F.lit(True)).alias("leads"))
    found = sketch.join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    chosen = kept & (F.col("doc_id").isNull() | F.col("own").isNull() | (F.col("leads") & (F.col("own") == F.col("text_hash"))))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "text_hash", chosen.alias("chosen"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85).drop("text_hash", "chosen")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- of equal sets one is compared with others
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM (SELECT doc_id, sha256(string_agg(s, chr(10) ORDER BY s)) AS h FROM s GROUP BY doc_id)),
r AS (SELECT s.doc_id, s.s, n.n FROM s JOIN n USING (doc_id) JOIN c USING (doc_id) WHERE doc_id = rep),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) + any_value(b.n) AS total FROM r a JOIN r b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (total - k)),
x(a, b) AS (SELECT rep, rep FROM c UNION SELECT x.a, l.b FROM x JOIN l ON x.b = l.a),
m AS (SELECT a AS rep, min(b) AS component FROM x GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(m.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (rep)
"""
