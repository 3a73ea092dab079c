"""Removal of repeated passages by super-k-mer partitioning.

Windows of `window` words that share a minimiser travel as one packed string to its bucket (see
_segments). There segments that can share no window are settled by the stretches beside their minimiser;
the windows of the others are sorted word by word and every group's smallest document is found exactly; in
all other documents the window's words are removed.

Words are runs of bytes other than ASCII white space. Windows are judged on the input, not on what is
left. Removed is a word covered by a window that also starts in a document with a smaller id.

Defined cases: a null text has no words; texts below `window` words lose nothing; rows with one id are
one document, and remove nothing from each other; a null id counts as larger than every other; repeated
rows give a row each; only the id and the text are read of a table's columns; an empty table gives an empty
one; long texts are cut for sending, with windows over the cuts, and put together at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import WordHashes, documents
from ._segments import akin, families, figures, hot_grams, keyed, members, radix_groups, settled, smaller, without

GRAM = 2
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_hashes = WordHashes()


def units(text: bytes) -> np.ndarray:
    return _hashes.of(text.split())


def _cut(text: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    words = text.split()
    return _hashes.of(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1), b" ".join(words) + b" "


def repeated(columns: dict[str, np.ndarray], segments: list[bytes], window: int, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """Spans, in words, of a bucket's windows that a smaller document has as well."""
    index, lead, family = settled(columns, segments)
    doc, crc, start, n = (columns[c][index].astype(np.int64) for c in ("doc", "crc", "start", "windows"))
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, lead, doc)
    gone = np.flatnonzero(doc > least[lead])
    spans = list(zip(*(x[gone].tolist() for x in (doc, crc, start, start + n - 1 + window)), strict=True))
    leaders = np.flatnonzero(lead == np.arange(len(lead)))
    data = b" ".join([segments[i] for i in index[leaders].tolist()]) + b" "
    ends = np.append(0, np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1)
    size = n[leaders] - 1 + window
    base, off = np.cumsum(size) - size, columns["off"][index[leaders]].astype(np.int64)
    odd = leaders[akin(data, ends, base, off, size, window, gram)]
    off, equals = columns["off"][index].astype(np.int64), members(lead, odd)
    ids: dict[bytes, int] = {}
    for own in families(odd, family, n):
        words = [[ids.setdefault(w, len(ids)) for w in segments[i].split(b" ")] for i in index[own].tolist()]
        base = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
        flat = np.array([x for w in words for x in w], np.uint64)
        of = np.repeat(np.arange(len(own)), n[own])
        j = np.arange(len(of)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        found, group = radix_groups(lambda at, d, flat=flat: flat[at + d], base[of] + j, family[own][of] * (2 * window) + off[own][of] - j, window)
        if len(found):
            smallest = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, group, least[own][of[found]])
            for x, first, limit in zip(own[of[found]].tolist(), j[found].tolist(), smallest[group].tolist(), strict=True):
                spans += [(int(doc[i]), int(crc[i]), int(start[i]) + first, int(start[i]) + first + window) for i in equals[x] if doc[i] > limit]
    return spans


def without_passages(docs: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, bucket_bytes: int = 4_000_000, flush_bytes: int = 12_000_000, with_kept: bool = True) -> DataFrame:
    """Per document: words, words removed, the digest of the kept words joined by one space and, with_kept, those as `kept`."""
    if window < gram:
        raise ValueError("the window must be no less than the gram")
    rows = keyed(docs, id_col, text_col)
    n, total = figures(rows)
    finish = _finish if with_kept else lambda *given: _finish(*given)[:-1]
    out = OUT + (", kept string" if with_kept else "")
    return without(rows, _cut, 1, lambda c, s: repeated(c, s, window, gram), smaller, finish, out, k=window, m=gram, total=total, hot=hot_grams(rows, n, units, gram), bucket_bytes=bucket_bytes, flush_bytes=flush_bytes)


def _finish(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    words = text.split()
    kept = [w for x, y in zip([0, *ends.tolist()], [*starts.tolist(), len(words)], strict=True) for w in words[x:y]] if len(starts) else words
    data = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(documents(spark, sf_dir), with_kept=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE doc_id > first)),
n AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""
