"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through `depth` bytes. The first digit, which deals them to buckets, is the
minimiser of a suffix's first `depth` bytes and its place there (see _segments): suffixes that agree
through the threshold agree in it, whole runs of suffixes travel as one packed string, and a suffix
alone in its group is settled at once. Further passes sort by 8 bytes at a time, most significant
first, and drop groups of one. After the last pass equal groups are exactly the repeated strings.
Segments that are equal as a whole, and those that can share no string by the stretches beside their
minimiser, are settled without passes.

Every byte covered by a string of `depth` bytes that also starts elsewhere is removed, in the first
copy as in the last.

Defined cases: null and empty texts have no bytes; texts below `depth` bytes lose nothing; matches
never cross rows; repeated rows (same id, same text) are copies of each other; overlapping
occurrences within a text count; a null id is carried through; only the id and the text are read of a
table's columns; an empty table gives an empty one; long texts are cut for sending, with strings over the
cuts, and put together at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, mixed
from ._segments import akin, equal, families, figures, hot_grams, keyed, members, radix_groups, settled, without

GRAM = 16
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def units(text: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(text, np.uint8)]


def _cut(text: bytes) -> tuple[np.ndarray, None, bytes]:
    return units(text), None, text


def repeated(columns: dict[str, np.ndarray], segments: list[bytes], depth: int, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """Repeated spans of a bucket."""
    index, lead, family = settled(columns, segments)
    doc, crc, start, n, off, size = (columns[c][index].astype(np.int64) for c in ("doc", "crc", "start", "windows", "off", "size"))
    copies = np.flatnonzero(np.bincount(lead, minlength=len(lead))[lead] > 1)
    spans = list(zip(*(x[copies].tolist() for x in (doc, crc, start, start + n - 1 + depth)), strict=True))
    leaders = np.flatnonzero(lead == np.arange(len(lead)))
    data = b"".join([segments[i] for i in index[leaders].tolist()])
    odd = leaders[akin(data, None, np.cumsum(size[leaders]) - size[leaders], off[leaders], size[leaders], depth, gram)]
    equals = members(lead, odd)
    for own in families(odd, family, n):
        of = np.repeat(np.arange(len(own)), n[own])
        j = np.arange(len(of)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        flat = np.frombuffer(b"".join([segments[i] for i in index[own].tolist()]) + bytes(8), np.uint8)
        words = np.lib.stride_tricks.as_strided(flat[:-7].view(), (len(flat) - 7, 8), (1, 1))

        def load(at: np.ndarray, d: int, words: np.ndarray = words) -> np.ndarray:
            return words[at + min(8 * d, depth - 8)].copy().view(">u8").ravel().astype(np.uint64)

        found, _ = radix_groups(load, (np.cumsum(size[own]) - size[own])[of] + j, family[own][of] * (2 * depth) + off[own][of] - j, -(-depth // 8))
        if len(found):
            found.sort()
            run = np.flatnonzero(np.concatenate(([True], (np.diff(found) != 1) | (np.diff(of[found]) != 0))))
            for a, b in zip(run, [*run[1:], len(found)], strict=True):
                first, last = int(j[found[a]]), int(j[found[b - 1]])
                spans += [(int(doc[i]), int(crc[i]), int(start[i]) + first, int(start[i]) + last + depth) for i in equals[int(own[of[found[a]]])]]
    return spans


def without_repeats(docs: DataFrame, *, depth: int = 200, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, bucket_bytes: int = 4_000_000, flush_bytes: int = 16_000_000, with_kept: bool = True) -> DataFrame:
    """Per document: bytes, bytes and maximal runs removed, the digest of what is kept and, with_kept, that as `kept`."""
    if depth < max(8, gram):
        raise ValueError("depth must be at least 8 bytes and no less than the gram")
    rows = keyed(docs, id_col, text_col)
    n, total = figures(rows)
    finish = _finish if with_kept else lambda *given: _finish(*given)[:-1]
    out = OUT + (", kept binary" if with_kept else "")
    return without(rows, _cut, 0, lambda c, s: repeated(c, s, depth, gram), equal, finish, out, k=depth, m=gram, total=total, hot=hot_grams(rows, n, units, gram), bucket_bytes=bucket_bytes, flush_bytes=flush_bytes)


def _finish(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    kept = b"".join(text[x:y] for x, y in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True)) if len(starts) else text
    return len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir), with_kept=False)
