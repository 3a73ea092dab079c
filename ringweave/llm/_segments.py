"""Super-k-mers: consecutive windows with one minimiser travel to a bucket as one packed string.

A window is `k` consecutive units (bytes or words), its minimiser the smallest hashed `m`-gram in it,
the leftmost if several are equal. Windows that share a minimiser's place form a segment of at most
2k - m units. Equal windows have equal minimisers at equal offsets, so all copies of a window meet in
the bucket of that minimiser, and no two windows of one segment are equal.

Hot content. (1) Grams found in many documents of a sample come last in the order, so a window that
holds anything else gets a rarer minimiser: what lies around a passage shared by a third of all
documents is spread over many buckets. (2) Equal segments within a task's flush are settled there, and
one of them travels, so the passage itself reaches its bucket once per flush, not once per document.
The sample steers only the load; results don't depend on it.

The sample grows with the partitions, so a gram below its sight is in fewer documents than a few partitions
hold, which bounds its bucket where partitions are in proportion to the input.

A task gathers segments for about `flush_bytes` of text and sends each bucket one compressed blob.
A bucket receives about `bucket_bytes` of segments, so a reducer holds one bucket at a time. The spans
found meet the texts, packed likewise, in parts of about 4 MB of text. Each flush makes a blob for each
bucket, so blobs shrink as a table grows; beyond 1000 buckets and 500 parts these are up to four times as large.

In a bucket only segments that may share a window (`akin`) are looked at window by window, family by family:
in a large table most minimisers stand in many texts that have nothing else in common.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, arrow_schema, gram_hashes, merged_runs, sliding_min, tidy

_BITS = np.uint64(22)
_PLACE = np.uint64((1 << 22) - 1)
_TOP = np.uint64(1 << 63)
CHUNK = 1 << 20
_SENT = "bucket int, doc_id long, crc long, spans array<int>, blob binary"
_LAID = "part int, kind int, doc_id long, crc long, spans array<int>, blob binary"
_COLUMNS = (("mh", np.uint32), ("doc", np.int64), ("crc", np.uint32), ("start", np.int32), ("windows", np.uint16), ("off", np.uint16), ("size", np.int32))
_LEVEL = 3


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text as bytes, and the id and checksum that tell rows apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.withColumns({"_id": F.coalesce("doc_id", F.lit(NULL_ID)), "_crc": F.crc32(F.coalesce("text", F.lit(b"")))})


def runs(unit: np.ndarray, bounds: np.ndarray, k: int, m: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, end, minimiser and its place for each segment of the pieces that end at `bounds`."""
    n = len(unit) - k + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    gram = gram_hashes(unit, m)
    rank = gram >> np.uint64(1)
    if len(hot):
        rough = np.zeros(1 << 20, bool)
        rough[(hot & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(rough[(gram & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(hot, gram[maybe]), len(hot) - 1)
        rank[maybe[hot[at] == gram[maybe]]] |= _TOP
    key = (rank & ~_PLACE) | np.arange(len(rank), dtype=np.uint64)
    place = (sliding_min(key, k - m + 1) & _PLACE).astype(np.int64)
    ends = np.concatenate(([0], bounds))
    inside = np.zeros(n + 1, bool)
    for a, b in zip(ends[:-1], ends[1:] - k + 1, strict=True):
        if b > a:
            inside[a:b] = True
    same = np.zeros(n + 1, bool)
    same[1:n] = (place[1:] == place[:-1]) & inside[1:n] & inside[: n - 1]
    first = np.flatnonzero(inside & ~same)
    last = np.flatnonzero(inside[:n] & ~same[1:]) + 1
    return first, last, gram[place[first]], place[first]


def equal(lead: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal segments (lead: the first of each one's equals): all are repeated, and the first travels."""
    return np.bincount(lead)[lead] > 1, lead == np.arange(len(lead))


def smaller(lead: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal segments those of other than the smallest document are repeated, and the smallest's travel."""
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, lead, doc)
    return doc > least[lead], doc == least[lead]


class Sender:
    """Collects segments, settles equal ones and packs the rest by bucket."""

    def __init__(self, buckets: int, settle: Callable, k: int):
        self.buckets, self.settle, self.k = buckets, settle, k
        self.clear()

    def clear(self) -> None:
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.known: dict[bytes, int] = {}
        self.lead: list[int] = []
        self.held = 0

    def add(self, columns: tuple[np.ndarray, ...], segments: Iterable[bytes]) -> None:
        """Takes in segments; of equal ones the bytes are held once."""
        at, first = len(self.lead), self.known.setdefault
        self.lead += [first(x, i) for i, x in enumerate(segments, at)]
        self.columns.append(columns)
        self.held += int(columns[-1][np.array(self.lead[at:]) == np.arange(at, len(self.lead))].sum())

    def full(self, most: float) -> bool:
        return self.held >= most or len(self.lead) >= most / 16

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.lead:
            return
        mh, *columns = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        doc, crc, start, windows = columns[:4]
        gone, alive = self.settle(np.array(self.lead), doc)
        texts = {i: x for x, i in self.known.items()}
        out: list[tuple] = [(int((c ^ d) % self.buckets), d, c, s, None) for d, c, s in grouped(doc[gone], crc[gone], start[gone], start[gone].astype(np.int64) + windows[gone] - 1 + self.k)]
        kept = np.flatnonzero(alive)
        bucket = (mh[kept] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        kept, bucket = kept[order], bucket[order]
        columns = [(mh >> np.uint64(32)).astype(np.uint32), *columns]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        squeeze = zstd.ZstdCompressor(level=_LEVEL)
        for a, b in zip(edges, [*edges[1:], len(kept)], strict=True):
            own = kept[a:b]
            data = np.uint32(len(own)).tobytes() + b"".join(c[own].astype(t).tobytes() for c, (_, t) in zip(columns, _COLUMNS, strict=True)) + b"".join([texts[self.lead[i]] for i in own.tolist()])
            out.append((int(bucket[a]), None, None, None, squeeze.compress(data)))
        self.clear()
        yield from _rows(out, ("bucket", "doc_id", "crc", "spans", "blob"), (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()))


def _rows(out: list[tuple], names: tuple, types: tuple, size: int = 500) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(out), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + size], strict=True), types, strict=True)], names)


def grouped(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """Spans as one list of merged runs per document and checksum."""
    if not len(doc):
        return
    order = np.lexsort((crc, doc))
    doc, crc, start, end = (x[order].astype(np.int64) for x in (doc, crc, start, end))
    edges = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(crc) != 0))))
    for lo, hi in zip(edges, [*edges[1:], len(doc)], strict=True):
        s, e = merged_runs(start[lo:hi], end[lo:hi])
        yield int(doc[lo]), int(crc[lo]), np.stack((s, e), 1).ravel().tolist()


def of_list(spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    return grouped(*np.array(spans, np.int64).T) if spans else iter(())


def decoded(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """The columns and segments of a bucket's blobs."""
    parts: dict[str, list] = {name: [] for name, _ in _COLUMNS}
    segments: list[bytes] = []
    for blob in blobs:
        data = zstd.ZstdDecompressor().decompress(blob)
        n, at = int(np.frombuffer(data, np.uint32, 1)[0]), 4
        for name, t in _COLUMNS:
            parts[name].append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
        ends = at + np.cumsum(parts["size"][-1], dtype=np.int64)
        segments += [data[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return {name: np.concatenate(p) for name, p in parts.items()}, segments


def radix_groups(load: Callable[[np.ndarray, int], np.ndarray], at: np.ndarray, group: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: windows (by index) whose group and digits equal another's, and their group.

    load(places, d) gives digit d of the windows at those places. A window alone in its group leaves.
    """
    index = np.arange(len(at))
    for d in range(-1, digits):
        digit = load(at[index], d) if d >= 0 else np.zeros(len(index), np.uint64)
        order = np.lexsort((digit, group))
        index, digit, group = index[order], digit[order], group[order]
        new = np.ones(len(index), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        keep = np.bincount(group, minlength=1)[group] > 1 if len(group) else new
        index, group = index[keep], group[keep]
        if not len(index):
            break
    return index, group


def settled(columns: dict[str, np.ndarray], segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments whose minimiser others have too, which of these is the first that equals each, and their family."""
    _, family, size = np.unique(columns["mh"], return_inverse=True, return_counts=True)
    index = np.flatnonzero(size[family] > 1)
    known: dict[bytes, int] = {}
    lead = np.array([known.setdefault(segments[i], n) for n, i in enumerate(index.tolist())], np.int64)
    return index, lead, family[index]


def akin(data: bytes, ends: np.ndarray | None, base: np.ndarray, off: np.ndarray, size: np.ndarray, k: int, m: int) -> np.ndarray:
    """Which of different segments may share a window: all others are settled without a look at their windows.

    data holds the segments, base is each one's first unit there, off its minimiser's place, size its units;
    ends: where each unit starts, if units are not bytes. A window reaches `half` units before its minimiser or
    k - half + 1 from its minimiser on, so a segment that equals no other in either stretch shares none.
    """
    half = (k - m + 1) // 2
    out = np.zeros(len(base), bool)
    for lo, hi in ((off - half, off + m), (off, off + k - half + 1)):
        own = np.flatnonzero((lo >= 0) & (hi <= size))
        a, b = base[own] + lo[own], base[own] + hi[own]
        if ends is not None:
            a, b = ends[a], ends[b]
        known: dict[bytes, int] = {}
        lead = np.array([known.setdefault(data[x:y], n) for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True))], np.int64)
        out[own] = out[own] | (np.bincount(lead, minlength=len(own))[lead] > 1)
    return out


def families(odd: np.ndarray, family: np.ndarray, windows: np.ndarray, most: int = 2_000_000) -> Iterator[np.ndarray]:
    """Parts of whole families, of about `most` windows, or one family's: what the passes hold at once."""
    odd = odd[np.argsort(family[odd], kind="stable")]
    last = np.append(np.flatnonzero(np.diff(family[odd])) + 1, len(odd))
    ends, lo = np.cumsum(windows[odd]), 0
    while lo < len(odd):
        at = int(np.searchsorted(ends[last - 1], (ends[lo - 1] if lo else 0) + most, "right")) - 1
        hi = int(max(last[max(at, 0)], last[np.searchsorted(last, lo, "right")]))
        yield np.sort(odd[lo:hi])
        lo = hi


def members(lead: np.ndarray, odd: np.ndarray) -> dict[int, list[int]]:
    """For each of some leaders the places that it leads."""
    out: dict[int, list[int]] = {i: [] for i in odd.tolist()}
    own = np.flatnonzero(np.isin(lead, odd))
    for i, x in zip(own.tolist(), lead[own].tolist(), strict=True):
        out[x].append(i)
    return out


def figures(rows: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of text."""
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return n, total or 0


def hot_grams(rows: DataFrame, n: int, units: Callable[[bytes], np.ndarray], m: int, *, sample_docs: int = 4000, least: int = 8, most: int = 1_000_000) -> np.ndarray:
    """Grams in at least `least` of a sample of n documents, most of all `most`: the sample grows with the partitions."""
    spark = rows.sparkSession
    wanted = max(sample_docs, 10 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            many = count > 1
            return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(count[many])], ["gram", "n"])

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    held.append(np.unique(gram_hashes(units(text.as_py()), m)))
                    size += len(held[-1])
                    if size > 2_000_000:
                        yield counted()
                        held, size = [], 0
        yield counted()

    sample = (rows if n <= wanted else rows.where(F.rand(7) < wanted / n)).select("text")
    found = sample.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(found.orderBy(F.desc("n"), "gram").limit(most).toArrow().column("gram").to_numpy().astype(np.int64).view(np.uint64))


def dealt(total: int, size: int, many: int) -> int:
    """Into how many shares bytes are dealt: of `size`, beyond `many` of them of up to four times that, for fewer and larger blobs."""
    return max(1, min(-(-total // min(4 * size, max(size, total // many))), (1 << 31) - 1))


def without(rows: DataFrame, cut: Callable[[bytes], tuple[np.ndarray, np.ndarray | None, bytes]], gap: int, found: Callable[[dict, list[bytes]], list[tuple[int, int, int, int]]], settle: Callable, finish: Callable[[bytes, np.ndarray, np.ndarray], tuple], ddl: str, *, k: int, m: int, total: int, hot: np.ndarray, bucket_bytes: int, flush_bytes: int) -> DataFrame:
    """doc_id and what finish(text, starts, ends) gives for each row and its repeated spans.

    cut(text) gives the hashed units, where each ends in the packed string (None: a byte each) and that
    string, in which `gap` bytes end each unit; found(columns, segments) gives a bucket's repeated spans.
    """
    buckets = dealt(int(total * 3.2), bucket_bytes, 1000)
    parts = dealt(total, 4_000_000, 500)
    shared = rows.sparkSession.sparkContext.broadcast(hot)
    part_of = lambda doc, crc: ((doc & ((1 << 63) - 1)) ^ crc) % parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, hot = Sender(buckets, settle, k), shared.value
        waiting: list[tuple] = []
        size = 0

        def work() -> None:
            units = np.concatenate([w[3] for w in waiting])
            sizes = np.array([len(w[3]) for w in waiting])
            bounds = np.cumsum(sizes)
            first, last, mh, place = runs(units, bounds, k, m, hot)
            if not len(first):
                return
            if waiting[0][4] is None:
                at, to = first, last - 1 + k
            else:  # where units end, over all pieces
                ends = np.concatenate([w[4] - w[5] + b for w, b in zip(waiting, np.cumsum([0, *(len(w[6]) for w in waiting[:-1])]), strict=True)])
                at, to = np.where(first > 0, ends[first - 1], 0), ends[last - 2 + k] - gap
            data = b"".join([w[6] for w in waiting])
            piece = np.searchsorted(bounds, first, side="right")
            doc, crc, start = (np.array([w[i] for w in waiting], np.int64)[piece] for i in range(3))
            start = start + first - (bounds - sizes)[piece]
            sender.add((mh, doc, crc, start, last - first, place - first, to - at), (data[x:y] for x, y in zip(at.tolist(), to.tolist(), strict=True)))

        for batch in batches:
            for doc, crc, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                if not text.is_valid:
                    continue
                units, ends, data = cut(text.as_py())
                for start in range(0, max(len(units) - k + 1, 0), CHUNK):
                    stop = min(start + CHUNK + k - 1, len(units))
                    a, b = (start, stop) if ends is None else (int(ends[start - 1]) if start else 0, int(ends[stop - 1]))
                    waiting.append((doc.as_py(), crc.as_py(), start, units[start:stop], None if ends is None else ends[start:stop], a, data[a:b]))
                    size += stop - start
                    if size >= CHUNK:
                        work()
                        waiting, size = [], 0
                        if sender.full(3.2 * flush_bytes):
                            yield from sender.flush()
        if waiting:
            work()
        yield from sender.flush()

    schema = arrow_schema(ddl)
    names = ("part", "kind", "doc_id", "crc", "spans", "blob")
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, out = -1, [], []
        laid = lambda spans: [(part_of(d, c), 0, d, c, s, None) for d, c, s in spans]
        for batch in batches:
            for bucket, doc, crc, runs_, blob in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 5)), strict=True):
                if not blob.is_valid:
                    out += laid([(doc.as_py(), crc.as_py(), runs_.as_py())])
                    continue
                if bucket != now:
                    if blobs:
                        out += laid(of_list(found(*decoded(blobs))))
                    now, blobs = bucket, []
                    if len(out) > 20_000:
                        yield from _rows(out, names, types, 5000)
                        out = []
                blobs.append(blob.as_py())
        if blobs:
            out += laid(of_list(found(*decoded(blobs))))
        yield from _rows(out, names, types, 5000)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows packed by part: ids, checksums and texts as one compressed blob, repeated rows once with their number."""
        held: dict[int, dict[tuple, int]] = {}
        size, squeeze = 0, zstd.ZstdCompressor(level=_LEVEL)

        def packed() -> Iterator[pa.RecordBatch]:
            out = [(part, 1, None, None, None, squeeze.compress(pickle.dumps(own, 5))) for part, own in held.items()]
            yield from _rows(out, names, types)

        for batch in batches:
            for doc, crc, text, own in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = text.as_py()
                same, row = held.setdefault(part_of(doc.as_py(), crc.as_py()), {}), (own.as_py(), doc.as_py(), crc.as_py(), data)
                size += 0 if row in same else len(data or b"")
                same[row] = same.get(row, 0) + 1
            if size >= flush_bytes:
                yield from packed()
                held, size = {}, 0
        yield from packed()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spans, out, held = -1, {}, [], 0
        for batch in batches:
            for part, kind, doc, crc, runs_, blob in zip(*(batch.column(i) for i in range(6)), strict=True):
                if part.as_py() != now:
                    now, spans = part.as_py(), {}
                if kind.as_py() == 0:
                    spans.setdefault((doc.as_py(), crc.as_py()), []).append(runs_.values.to_numpy())
                    continue
                for (own, i, c, text), times in pickle.loads(zstd.ZstdDecompressor().decompress(blob.as_py())).items():
                    a = np.concatenate(spans[i, c]).astype(np.int64).reshape(-1, 2) if (i, c) in spans else np.empty((0, 2), np.int64)
                    row = (own, *finish(text or b"", *merged_runs(a[:, 0], a[:, 1])))
                    for _ in range(times):
                        out.append(row)
                        held += len(text or b"")
                        if held > 2_000_000 or len(out) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    sent = rows.select("_id", "_crc", "text").mapInArrow(tidy(send), _SENT)
    got = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(receive), _LAID)
    laid = rows.select("_id", "_crc", "text", "doc_id").mapInArrow(tidy(lay), _LAID)
    return got.unionByName(laid).repartition("part").sortWithinPartitions("part", "kind").mapInArrow(tidy(gather), ddl)
