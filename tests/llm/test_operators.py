"""The operators against brute force on a table of awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ringweave.llm import decontaminate, language, lines, neardup, neighbours, packing, passages, quality, repeats, warc

from .cases import DDL, empty, rows, table, words

SHA = lambda b: hashlib.sha256(b).hexdigest()


def multiset(df, *names):
    return collections.Counter(tuple(r) for r in df.select(*names).collect())


# --- nearest neighbours


def vectors(spark, seed=3, n=300):
    rng = np.random.default_rng(seed)
    out = [(i, [float(x) for x in rng.normal(size=8)], "clash", 0.0) for i in range(n)]
    out += [(n + i, out[7][1], "tie", 1.0) for i in range(40)]
    out += [(1000, None, None, None), (1001, [0.0] * 8, None, None), (1002, [float("nan")] * 8, None, None), (1003, [], None, None), (1004, [None] + [1.0] * 7, None, None), (1005, [float("inf")] + [1.0] * 7, None, None), (1006, [1.0, 2.0], None, None), (1050, [3.0, 1.0], None, None), (None, [1.0] * 8, None, None)]
    return out, spark.createDataFrame(out, "vec_id long, embedding array<double>, id string, score double").repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 400, "row_bytes": 9000}])
def test_neighbours_are_exact(spark, sizes):
    data, df = vectors(spark)
    good = [(i, np.array(v)) for i, v, *_ in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    expected = {}
    for q, a in good:
        if q % 50 == 0:
            found = sorted((-float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), i) for i, b in good if i != q and len(a) == len(b))
            expected[q] = found[:5]
    got = collections.defaultdict(list)
    for r in sorted(neighbours.nearest(df, df.where("vec_id % 50 = 0"), 5, tile_rows=16, **sizes).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert {q for q, f in expected.items() if f} == set(got)
    for q, found in got.items():
        np.testing.assert_allclose([s for _, s in found], [-s for s, _ in expected[q]], atol=1e-12)
        ties = {i for s, i in expected[q]}
        assert {i for i, _ in found} == ties or len({round(s, 12) for s, _ in expected[q]}) < 5


def test_neighbours_ties_and_empty(spark):
    _, df = vectors(spark)
    got = neighbours.nearest(df, df.where("vec_id = 7"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [300, 301, 302, 303, 304]
    assert neighbours.nearest(df.limit(0), df, 5).count() == 0 == neighbours.nearest(df, df.limit(0), 5).count()


# --- passages and repeated bytes


def passages_by_hand(data, k=13):
    first = {}
    split = [(math.inf if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in data]
    for d, w in split:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, math.inf), d)
    out = collections.Counter()
    for (d, *_), (order, w) in zip(data, split, strict=True):
        gone = {p for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < order for p in range(i, i + k)}
        out[d, len(w), len(gone), SHA(" ".join(x for p, x in enumerate(w) if p not in gone).encode())] += 1
    return out


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 2000, "flush_bytes": 3000}])
def test_passages(spark, sizes):
    got = passages.without_passages(table(spark), **sizes)
    assert multiset(got, "doc_id", "n_words", "n_removed", "kept_sha256") == passages_by_hand(rows())
    assert passages.without_passages(empty(spark)).count() == 0


def repeats_by_hand(data, k=200):
    count = collections.Counter()
    texts = [(t or "").encode() for _, t, *_ in data]
    for t in texts:
        count.update(t[i : i + k] for i in range(len(t) - k + 1))
    out = collections.Counter()
    for (d, *_), t in zip(data, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - k + 1):
            if count[t[i : i + k]] > 1:
                gone[i + 1 : i + k + 1] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out[d, len(t), len(t) - len(kept), spans, SHA(kept)] += 1
    return out


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 2000, "flush_bytes": 3000}])
def test_repeats(spark, sizes):
    got = repeats.without_repeats(table(spark), **sizes)
    assert multiset(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_by_hand(rows())
    assert repeats.without_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("chunk", [400, 1500])
def test_long_texts_are_cut_without_loss(spark, monkeypatch, chunk):
    """Texts of many chunks, with repeats over their cuts, and runs of one symbol."""
    from ringweave.llm import _segments

    monkeypatch.setattr(_segments, "CHUNK", chunk)
    rng = random.Random(12)
    passage = words(rng, 700, 10**6)
    data = [(1, f"{words(rng, 900, 10**6)} {passage} {words(rng, 300, 10**6)}"), (2, f"{words(rng, 37, 10**6)} {passage}"), (3, "ab " * 3000), (4, "z" * 5000), (5, "cd " * 20 + "ab " * 50)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert multiset(repeats.without_repeats(docs, with_kept=False), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_by_hand(data)
    assert multiset(passages.without_passages(docs, with_kept=False), "doc_id", "n_words", "n_removed", "kept_sha256") == passages_by_hand(data)


def test_many_repeated_rows_travel_once(spark):
    data = [(1, words(random.Random(3), 100))] * 3000 + [(None, "x " * 40)] * 500 + [(2, words(random.Random(4), 90))]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert multiset(repeats.without_repeats(docs, with_kept=False), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_by_hand(data)
    assert multiset(passages.without_passages(docs, with_kept=False), "doc_id", "n_words", "n_removed", "kept_sha256") == passages_by_hand(data)


def bucket(make, k, m, gap, n=400):
    """One family: the same gram in n segments of else random units, and some that share k or only k - 1 units with the first, at each place."""
    rng, reach = random.Random(21), k - m
    middle = make(rng, m)
    units = [[make(rng, reach), middle, make(rng, reach)] for _ in range(n)]
    for o in range(reach + 1):
        units.append([make(rng, reach - o) + units[0][0][reach - o :], middle, units[0][2][: reach - o] + make(rng, o)])
        units.append([make(rng, reach - max(o - 1, 0)) + units[1][0][reach - max(o - 1, 0) :], middle, units[1][2][: reach - max(o, 1)] + make(rng, max(o, 1))])
    units.append(units[0])
    flat = [sum(u, []) for u in units]
    segments = [gap.join(u) for u in flat]
    column = lambda x, t: np.full(len(flat), x, t)
    doc = np.random.default_rng(5).permutation(len(flat)).astype(np.int64)
    columns = {"mh": column(7, np.uint32), "doc": doc, "crc": column(0, np.uint32), "start": column(3, np.int32), "windows": column(reach + 1, np.uint16), "off": column(reach, np.uint16), "size": np.array([len(s) for s in segments], np.int32)}
    return columns, segments, flat


def looked_at(monkeypatch, module):
    """Gets the number of windows that are sorted."""
    out, sort = [], module.radix_groups
    monkeypatch.setattr(module, "radix_groups", lambda load, at, *more: out.append(len(at)) or sort(load, at, *more))
    return out


def units_in(spans):
    return {(d, p) for d, _, a, b in spans for p in range(a, b)}


def test_texts_that_share_a_gram_alone_are_not_sorted_by_windows(monkeypatch):
    columns, segments, flat = bucket(lambda rng, n: [str(rng.randrange(10**9)).encode() for _ in range(n)], 13, 2, b" ")
    first, seen = {}, looked_at(monkeypatch, passages)
    windows = [(int(d), i, tuple(u[i : i + 13])) for d, u in zip(columns["doc"], flat, strict=True) for i in range(12)]
    for d, _, w in windows:
        first[w] = min(first.get(w, d), d)
    assert units_in(passages.repeated(columns, segments, 13)) == {(d, 3 + p) for d, i, w in windows if d > first[w] for p in range(i, i + 13)} != set()
    assert 0 < sum(seen) < len(windows) / 5


def test_texts_that_share_a_gram_alone_are_not_sorted_by_bytes(monkeypatch):
    columns, segments, flat = bucket(lambda rng, n: [bytes([rng.randrange(256)]) for _ in range(n)], 200, 16, b"", 4000)
    count, seen = collections.Counter(), looked_at(monkeypatch, repeats)
    windows = [(int(d), i, s[i : i + 200]) for d, s in zip(columns["doc"], segments, strict=True) for i in range(185)]
    count.update(w for *_, w in windows)
    assert units_in(repeats.repeated(columns, segments, 200)) == {(d, 3 + p) for d, i, w in windows if count[w] > 1 for p in range(i, i + 200)} != set()
    assert 0 < sum(seen) < len(windows) / 5


def test_families_are_whole_and_bounded():
    from ringweave.llm import _segments

    rng = np.random.default_rng(2)
    family, windows = rng.integers(0, 40, 500), rng.integers(1, 20, 500)
    odd = np.sort(rng.choice(500, 300, replace=False))
    for most in (1, 50, 300, 10**6):
        parts = list(_segments.families(odd, family, windows, most))
        assert np.array_equal(np.sort(np.concatenate(parts)), odd)
        assert sum(len(np.unique(family[p])) for p in parts) == len(np.unique(family[odd]))
        assert all(windows[p].sum() <= most or len(np.unique(family[p])) == 1 for p in parts)
    assert not list(_segments.families(odd[:0], family, windows))


def test_blobs_do_not_shrink_with_the_table():
    """Ten times the bytes are not ten times the buckets, once these are many; small tables are dealt as before."""
    from ringweave.llm import _segments

    assert [_segments.dealt(n * 10**6, 4_000_000, 1000) for n in (0, 1, 400, 4000, 32_000)] == [1, 1, 100, 1000, 2000]


def test_kept_texts_are_those_of_the_digest(spark):
    for got in (passages.without_passages(table(spark)), repeats.without_repeats(table(spark))):
        for r in got.collect():
            assert SHA(r.kept.encode() if isinstance(r.kept, str) else bytes(r.kept)) == r.kept_sha256


# --- decontamination



@pytest.mark.parametrize("least", [1, 2, 5, 8])
def test_automaton_runs_where_windows_can_lie(least):
    """All windows are found, of items of few words as well; unlike texts don't go through the automaton."""
    rng = random.Random(least)
    items = [(str(i), words(rng, rng.randrange(least, 30), 5).encode()) for i in range(60)] + [("none", b"!")]
    tests, seen = decontaminate.build(items, 8), []

    class Automaton:
        __len__ = lambda self: len(tests.automaton)
        iter = lambda self, text: seen.append(len(text)) or tests.automaton.iter(text)

    watched = decontaminate.Tests(tests.alphabet, Automaton(), *(getattr(tests, f) for f in ("base", "sets", "pairs", "least")))
    own = [decontaminate.words_of(t) for _, t in items]
    windows = {(tuple(w[i : i + 8]), k) for k, w in enumerate(own) if w for i in range(max(len(w) - 7, 1))}
    for n in (0, 1, 7, 300):
        text = decontaminate.words_of(" ".join([words(rng, n, 5), *(t.decode() for _, t in rng.sample(items, min(n, 3)))]).encode())
        hit, found = set(), set()
        for w, k in windows:
            for i in range(len(text) - len(w) + 1):
                if tuple(text[i : i + len(w)]) == w:
                    hit, found = hit | set(range(i, i + len(w))), found | {items[k][0]}
        runs, got = decontaminate.scan(text, watched)
        assert {p for a, b in zip(runs[::2], runs[1::2], strict=True) for p in range(a, b)} == hit and got == sorted(found)
    if least > 1:
        seen.clear()
        assert decontaminate.scan(sum(([own[i % 60][0], b"other"] for i in range(900)), []), watched) == ([], []) and not seen


def hits_by_hand(data, items, k=8):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, t in items:
        w = split(t) if item is not None else []
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in wins}
    out = collections.Counter()
    for d, t, *_ in data:
        w, gone, found = split(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[i : i + n]))) is not None:
                    gone.update(range(i, i + n))
                    found |= own
        out[d, len(w), len(gone), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("block_bytes", [2_000_000, 300])
def test_decontamination(spark, block_bytes):
    data, rng = rows(), random.Random(5)
    long = [t for _, t, *_ in data if t and len(t.split()) > 40]
    items = [(i, " ".join(rng.choice(long).split()[3 : 3 + n]).upper()) for i, n in enumerate((20, 12, 8, 9, 30))] + [(10, None), (11, ""), (12, "one Two, three"), (13, "x"), (14, "never seen anywhere"), (12, "one Two, three"), (15, "ñ" * 400), (None, " ".join(long[0].split()[:20])), (1, "never seen either")]
    got = decontaminate.contamination(table(spark), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == hits_by_hand(data, items)
    assert decontaminate.contamination(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    whole = decontaminate.flagged(table(spark), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert whole.columns == [c for c in table(spark).columns if c != "spans"] + ["n_words", "n_hit", "items", "spans"]
    assert multiset(whole, *table(spark).drop("spans").columns) == multiset(table(spark), *table(spark).drop("spans").columns)
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in whole.collect()) == hits_by_hand(data, items)
    none = decontaminate.contamination(table(spark), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(data)


def test_spans_are_of_the_original(spark):
    docs = spark.createDataFrame([(1, "Ça—va: ONE, two;  Three four! five six seven eight... nine")], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(5, "one two three four five six seven eight")], "item_id long, text string")).first()
    (span,) = got.spans
    assert "Ça—va: ONE, two;  Three four! five six seven eight... nine"[span.start : span.end] == "ONE, two;  Three four! five six seven eight"


# --- lines


def test_lines(spark):
    rng = random.Random(2)
    shared = [f"shared {i}" for i in range(12)]
    data = []
    for i in range(200):
        own = [f"own {i} {j}" for j in range(3)] + [s for k, s in enumerate(shared) if rng.random() < k / 12]
        rng.shuffle(own)
        data.append((i, "\n".join(own + ["", "  "]), f"s{rng.randrange(14)}", "clash", 1))
    data += [(300, None, "s1", None, None), (301, "", "s1", None, None), (302, " shared 11 ", None, None, None), (None, "shared 11\nnull id", "s2", None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, line string, n_lines int").repartition(3)
    sites, first = collections.defaultdict(set), {}
    order = lambda d: math.inf if d is None else d
    for d, t, s, *_ in data:
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                sites[x.strip(" ")] |= {s} - {None}
                first[x.strip(" ")] = min(first.get(x.strip(" "), (math.inf, 9)), (order(d), p))
    expected = collections.Counter()
    for d, t, *_ in data:
        own = None if t is None else t.split("\n")
        kept = None if own is None else [x for p, x in enumerate(own) if not x.strip(" ") or len(sites[x.strip(" ")]) < 10 or first[x.strip(" ")] == (order(d), p)]
        expected[d, None if kept is None else "\n".join(kept), len(own or []), len(own or []) - len(kept or [])] += 1
    got = lines.without_boilerplate(df)
    assert multiset(got, "doc_id", "text", "n_lines", "n_lines_removed") == expected
    assert lines.without_boilerplate(df.limit(0)).count() == 0
    clashing = df.selectExpr("*", *[f"doc_id AS `{c}`" for c in ("_gone", "row", "id", "h", "pos", "gone", "site", "at", "first", "h1", "n_lines_removed", "a b", "x.y")])
    assert multiset(lines.without_boilerplate(clashing), "doc_id", "text", "n_lines", "n_lines_removed") == expected
    assert multiset(lines.without_boilerplate(table(spark)), "doc_id").total() == len(rows())


# --- archives


def test_archives_round_trip(spark, tmp_path):
    data = [(i, f"http://a/{i}", f"<p>{words(random.Random(i % 50), 200)}</p>", "clash") for i in range(300)]
    data += [(900, None, None, None), (901, "u\r\nX: y", "", None), (902, "u", "", None), (None, "u", data[0][2], None), (903, "u", "é\r\n\r\nWARC/1.1\r\n" * 50_000, None), (5, "http://a/5", data[5][2], None), (6, "other", "second payload of 6", None)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, payload string").repartition(4)
    manifest = warc.write_archives(df, f"file://{tmp_path}/archives")
    got = warc.read_archives(manifest).collect()
    first = {}
    for p, _, h, *_ in data:
        if p is not None:
            first[h or ""] = min(first.get(h or "", math.inf), p)
    expected = collections.Counter()
    for p, u, h, *_ in data:
        original = p is None or first[h or ""] == p
        payload = (h or "").encode()
        expected[p, len(payload), warc.digest_of(payload), "response" if original else "revisit", None if original else first[h or ""], payload if original else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == expected
    assert len({r.record_id for r in got}) == len(got)
    named = {r.record_id: r for r in got}
    assert all(named[r.refers_to_record].page_id == r.refers_to and named[r.refers_to_record].payload_digest == r.payload_digest for r in got if r.record_type == "revisit")
    assert warc.read_archives(warc.write_archives(df.limit(0), f"file://{tmp_path}/none")).count() == 0
    path = manifest.first().path.removeprefix("file://")
    with open(path, "rb") as f:
        whole = f.read()
    with open(path, "wb") as f:
        f.write(whole[:-20])
    with pytest.raises(Exception, match="within a record|records, not|[Tt]runcated"):
        warc.read_archives(manifest).collect()


# --- packing


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = rows()
    expected = collections.Counter((d, tuple([*(tok.encode(t or "", add_special_tokens=False).ids), 1])) for d, t, *_ in data)
    window = 256
    for options in ({}, {"shard_tokens": 3000, "shard_docs": 9, "sample_docs": 40}):
        got = packing.pack(table(spark), window=window, **options).collect()
        ends, whole = collections.Counter(), collections.Counter()
        for r in got:
            ids = np.frombuffer(r.ids, "<u4")
            assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
            whole[r.doc_id] += r.length
        by_seq = collections.defaultdict(list)
        for r in got:
            by_seq[r.sequence_id].append((r.offset, r.length))
        padding = 0
        for pieces in by_seq.values():
            at = 0
            for o, n in sorted(pieces):
                assert o == at
                at += n
            assert at <= window
            padding += 0 if at & (at - 1) == 0 else window - at
        assert padding == 0
        unique = [r for r in got if r.doc_id is not None and r.doc_id != 3]
        docs = collections.defaultdict(list)
        for r in unique:
            docs[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        for d, pieces in docs.items():
            flat = tuple(x for _, p in sorted(pieces) for x in p)
            assert (d, flat) in expected, d
        assert sum(whole.values()) == sum(len(i) * n for (_, i), n in expected.items())
        del ends
    assert packing.pack(empty(spark)).count() == 0


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, own, rng = Tokenizer.from_file(path), packing.Encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(4)
    parts = [" ", "  ", "\n", " \n ", "\t", "a", "Bé", "it's", "'ll", "12", "!?", " ", "\x1c", "\x00", "ß", "²", "½", "\xad", "<|endoftext|>", "x ", "日本", "\r\n", "\x85", "　"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(3000)]
    assert [b.tolist() for b in own.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def corpus_of(docs):
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]))
    return packing.Corpus(df, len(docs), sum(map(len, docs)))


def bm25_by_hand(query, doc, docs):
    mean, total = sum(map(len, docs)) / len(docs), 0.0
    for t in set(query.tolist()):
        tf, df = int((doc == t).sum()), sum(bool((d == t).any()) for d in docs)
        total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
    return total


def test_scores_are_bm25_of_all_tokens():
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.3, rng.integers(1, 120)).clip(1, 400).astype("<u4") for _ in range(60)]
    index = packing.Index(docs[:40], corpus_of(docs))  # a shard; figures are of all
    got = index.scores([*index.terms, np.unique(docs[50])])
    for q, row in zip([*docs[:40], docs[50]], got, strict=True):
        # each weight is rounded to a 64th
        np.testing.assert_allclose(row, [bm25_by_hand(q, d, docs) for d in docs[:40]], atol=len(set(q.tolist())) / 128)


def order_of(docs, window, shards=1):
    windows, out = packing.Windows(window, corpus_of(docs)), []
    for own in np.array_split(np.arange(len(docs)), shards):
        windows.add(own.tolist(), [docs[d] for d in own])
        out += list(windows.pieces(False))
    return out + list(windows.pieces(True))


def test_neighbours_share_windows():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * t, 1000 * t + 60, (20, 100)).astype("<u4") for t in range(5)]
    docs = [topics[i % 5][i // 5] for i in range(100)]
    for shards in (1, 3):
        names = [p[0] for p in order_of(docs, 1000, shards)]
        assert sorted(set(names)) == list(range(100))
        assert sum(a % 5 == b % 5 for a, b in itertools.pairwise(names)) > 80


def test_windows_hold_the_best_unused():
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.4, rng.integers(1, 60)).clip(1, 300).astype("<u4") for _ in range(80)]
    got, corpus = order_of(docs, 64), corpus_of(docs)
    score = packing.Index(docs, corpus)
    score = score.scores(score.terms)
    # the same by hand: a seed, then what scores best of what is left, until the window is full
    left, expected, filled, seed = set(range(80)), [], 0, None
    while left:
        if seed is None:
            seed = min(left)
            left.remove(seed)
            expected.append(seed)
            filled += len(docs[seed])
        end = -(-filled // 64) * 64
        last = None
        for d in sorted((d for d in left if score[seed, d] > 0), key=lambda d: (-score[seed, d], d)):
            if filled >= end:
                break
            left.remove(d)
            expected.append(d)
            filled += len(docs[d])
            last = d
        seed = last if filled > end else None
    assert list(dict.fromkeys(p[0] for p in got)) == expected


def test_all_of_a_seed_s_tokens_count():
    common = np.arange(200, dtype="<u4")
    rare = np.arange(1000, 1012, dtype="<u4")
    strangers = [np.append(np.arange(2000 + 100 * i, 2100 + 100 * i, dtype="<u4"), r) for i, r in enumerate(rare)]
    docs = [np.concatenate((common, rare)), *strangers, common, common[:150]]
    index = packing.Index(docs, corpus_of(docs))
    assert np.argsort(-index.scores(index.terms[:1])[0], kind="stable")[:3].tolist() == [0, 13, 14]


def test_alike_documents_lie_in_one_shard(spark):
    rng = random.Random(3)
    vocab = [[f"{a}{b}{t}" for a in "bdfgk" for b in "aeiou"] for t in ("ron", "lim", "sut", "pez")]
    data = [(i, " ".join(rng.choices(vocab[i % 4], k=rng.randrange(20, 60)))) for i in range(640)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for options in ({}, {"shard_tokens": 4000, "shard_docs": 40, "sample_docs": 200}):
        got = sorted((r.sequence_id, r.offset, r.doc_id, r.length) for r in packing.pack(docs, window=256, **options).drop("ids").collect())
        assert {x[2] for x in got} == set(range(640))
        pairs = [(a[2] % 4, b[2] % 4) for a, b in itertools.pairwise(got) if a[0] == b[0]]
        assert sum(a == b for a, b in pairs) > 0.85 * len(pairs)


def test_cuts_of_texts():
    import pyarrow as pa

    texts = pa.array(["a" * 10, None, "", "b" * 95, "c" * 300, "d", "e" * 50, "f" * 49])
    assert list(packing._cuts(texts, 3, 100)) == [(0, 3), (3, 1), (4, 1), (5, 3)]
    assert list(packing._cuts(texts.slice(5, 0), 3, 100)) == []


def test_repeated_rows_are_dealt_to_many_shards(spark):
    docs = spark.range(20_000).selectExpr("5L as doc_id", "'one text that is repeated' as text")
    got = packing.pack(docs, shard_docs=500, with_ids=False)
    assert got.where("start = 0").count() == 20_000 and got.agg(F.sum("length")).first()[0] == 20_000 * got.first().doc_tokens
    tasks = got.groupBy(F.shiftright("sequence_id", 33)).agg(F.sum("length").alias("n")).collect()
    assert len(tasks) >= 8 and max(r.n for r in tasks) < 3 * min(r.n for r in tasks)


def test_packing_and_repeats_queries(spark, tmp_path):
    """The queries over a folder of tables: their columns, and their rows by hand."""
    from tokenizers import Tokenizer

    import public_tokenizers

    data = [(d, t, lang, s, n) for d, t, lang, s, n, *_ in rows() if d is not None]
    data = list({d: (d, *rest) for d, *rest in data}.values())
    folder = sf_of(spark, tmp_path, "sf", data)
    tok, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {d: t for d, t, *_ in data}
    got = packing.query(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces, ends = collections.defaultdict(list), collections.Counter()
    for r in got.collect():
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        ends[r.sequence_id] += r.length
        assert 0 <= r.offset and r.offset + r.length <= 2048
    for d in texts:
        assert [s for s, _ in sorted(pieces[d])] == [0, *itertools.accumulate(n for _, n in sorted(pieces[d]))][:-1]
    assert all(n == 2048 or n & (n - 1) == 0 for n in ends.values())
    found = repeats.query(spark, folder)
    assert multiset(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_by_hand(data)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


# --- near duplicates


def near_by_hand(data, percent):
    sets = [neardup.shingles((t or "").encode()) for _, t, *_ in data]
    parent = {d: d for d, *_ in data if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations([(d, s) for (d, *_), s in zip(data, sets, strict=True) if d is not None and s], 2):
        if 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return collections.Counter((d, len(s), None if d is None else root(d), d is None or root(d) == d) for (d, *_), s in zip(data, sets, strict=True))


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, block):
    got = neardup.near_duplicates(table(spark), percent=85, block=block)
    assert multiset(got, "doc_id", "n_shingles", "component_id", "kept") == near_by_hand(rows(), 85)


def test_links_between_members_of_a_bucket(spark):
    rng = random.Random(8)
    base = words(rng, 200, 10**6).split()
    data = []
    for i in range(150):
        w = list(base)
        for p in rng.sample(range(200), rng.randrange(1, 6)):
            w[p] = f"new{i}-{p}"
        data.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), percent=85, block=16)
    assert multiset(got, "doc_id", "n_shingles", "component_id", "kept") == near_by_hand(data, 85)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_rows_of_one_id(spark):
    """Repeated rows are one text however many they are; different texts under one id are linked each for itself."""
    rng = random.Random(9)
    base, other = words(rng, 120, 10**6), words(rng, 120, 10**6)
    near = base.split()
    near[7] = "changed"
    data = [(1, base)] * 600 + [(2, " ".join(near))] * 600 + [(5, base), (5, other), (7, other), (8, "alone"), (8, "ALONE"), (9, None), (9, "")]
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), percent=85).collect()
    kinds = collections.Counter((r.doc_id, r.component_id, r.kept) for r in got)
    assert kinds == {(1, 1, True): 600, (2, 1, False): 600, (5, 1, False): 1, (5, 5, True): 1, (7, 5, False): 1, (8, 8, True): 2, (9, 9, True): 2}
    chosen = collections.Counter((r.doc_id, r.text_hash) for r in got if r.chosen)
    assert sorted(d for d, _ in chosen) == [1, 5, 8, 9, 9]


def test_estimates_are_corrected():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        errors = []
        for _ in range(60):
            n = 20_000
            common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            a, b = (np.concatenate((common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64))) for _ in range(2))
            c = neardup.chance(n, n)
            errors.append(((neardup.registers(a) == neardup.registers(b)).mean() - c) / (1 - c) - share / (2 - share))
        assert abs(np.mean(errors)) < 0.02


@pytest.mark.parametrize("name", ["op5_warc", "op8_near_duplicates"])
def test_query_equals_sql(spark, name):
    import duckdb

    from ringweave.llm.queries import ORACLES, QUERIES

    sf, tables = "/root/testdata/sf0.001", duckdb.connect()
    for table_ in ("documents", "pages"):
        tables.sql(f"CREATE VIEW {table_} AS SELECT * FROM '{sf}/{table_}.parquet'")
    expected = tables.sql(ORACLES[name])
    assert multiset(QUERIES[name](spark, sf), *expected.columns) == collections.Counter(expected.fetchall())


# --- classifiers


def test_language(spark):
    rng = random.Random(6)
    vocab = {"en": "the of and house water tree night".split(), "fr": "le de et maison eau arbre nuit été".split()}
    data = [(i, " ".join(rng.choices(vocab[x], k=12)), x, "clash") for i, x in enumerate(["en", "fr"] * 60)]
    data += [(500, None, "en", ""), (501, "12 34 !!", "fr", ""), (502, "", None, ""), (503, "nuits étés maisons", None, ""), (504, "treehouse watered", None, ""), (505, "日本", None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    model = language.fit(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, model).collect()}
    assert all(got[i][0] == x for i, _, x, _ in data[:120])
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert got[503][0] == "fr" and got[504][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    nothing = language.identify(df, language.fit(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language.identify(empty(spark), model).count() == 0
    small = language.fit(df, max_words=3, max_grams=5)
    assert len(small.words) <= 3 and len(small.grams) <= 5


def test_long_runs_of_letters_count_whole(spark):
    data = [(i, "abcde" * 30, "xx") for i in range(4)] + [(10 + i, "vwxyz" * 30, "yy") for i in range(4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert {"abcde", "vwxyz"} <= set(model.grams) and not model.words
    memo = language.Memo(model)
    assert language.detect("abcde" * 9 + "vwxyz" * 40, memo)[0] == "yy" and language.detect("vwxyz" * 9 + "abcde" * 40, memo)[0] == "xx"
    assert not memo
    rng = random.Random(2)
    run = "".join(rng.choices("abcé", k=1100))
    model = language.fit(spark.createDataFrame([(run, "xx"), ("ab", "xx")], "text string, lang string"), min_count=1)
    grams = collections.Counter(f" {run} "[i : i + n] for n in language.GRAMS for i in range(len(run) + 3 - n))
    grams.update(" ab "[i : i + n] for n in language.GRAMS for i in range(max(5 - n, 0)))
    del grams[" "]
    odds = np.exp(model.gram_table[:, 0]) * (grams.total() + 0.5 * len(grams)) - 0.5
    assert {g: round(odds[i]) for g, i in model.grams.items()} == grams


def language_by_hand(model, text):
    """The language and its share, from the model's tables, word by word."""
    import regex

    total, seen = [0.0] * len(model.langs), 0
    for word in regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower()):
        row = model.word_table[model.words[word]] if word in model.words else None
        for n in (5, 4, 3, 2, 1) if row is None else ():
            known = [model.gram_table[model.grams[g]] for i in range(len(word) + 3 - n) if (g := f" {word} "[i : i + n]) in model.grams]
            if known:
                row = sum(known) / len(known)
                break
        if row is not None:
            seen += 1
            total = [a + float(b) for a, b in zip(total, row, strict=True)]
    if not regex.search(r"\p{L}", text or ""):
        return "und", 0.0
    tempered = [math.exp((t - max(total)) / math.sqrt(max(seen, 1))) for t in total]
    best = total.index(max(total))
    return model.langs[best], tempered[best] / sum(tempered)


def test_language_by_hand(spark):
    df = table(spark)
    model = language.fit(df, max_words=60, max_grams=400)
    texts = [t for _, t, *_ in rows()] + ["½ ²", "Ⅷ ①", "été\u0301 naïve", "कि खा", "x" * 90 + " ab1 cd2", "ab" * 40_000, "\u0301", "日本語"]
    memo = language.Memo(model, cells=60)  # emptied often
    for t in texts:
        lang, score = language.detect(t, memo)
        expected = language_by_hand(model, t)
        assert lang == expected[0] and abs(score - expected[1]) < 1e-6, t
    assert language.detect("½ ²", memo) == ("und", 0.0)


def test_many_languages_and_repeated_rows(spark):
    docs = spark.range(3000).selectExpr("concat('l', id % 300) as lang", "concat('word', id % 300, ' same') as text")
    model = language.fit(docs, max_langs=50, max_cells=500)
    assert len(model.langs) == 50 and model.word_table.size <= 500 >= model.gram_table.size
    same = spark.range(20_000).selectExpr("'xx' as lang", "'one text' as text")
    model = language.fit(same, sample_bytes=16_000, max_words=5)
    # a tenth of equal rows teaches, not all and not none
    n = np.exp(model.word_table[model.words["text"]][0]) * 1
    assert 0.4 < n < 0.6 and set(model.words) == {"one", "text"}


def sf_of(spark, tmp_path, name, documents, labels=None):
    folder = f"{tmp_path}/{name}"
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    if labels is not None:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_language_query_learns_from_its_folds_only(spark, tmp_path):
    rng = random.Random(6)
    vocab = {"en": "the of and house water tree night".split(), "fr": "le de et maison eau arbre nuit été".split()}
    data = [(i, " ".join(rng.choices(vocab[x], k=12)), x, "s", 1) for i, x in enumerate(["en", "fr"] * 60)] + [(None, "le de", "fr", "s", 1), (900, None, "en", "s", 1)]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 4 == 2
    turned = [(d, t, "zz" if held(d) else lang, s, n) for d, t, lang, s, n in data]
    one, two = (multiset(language.query(spark, sf_of(spark, tmp_path, name, x)), "doc_id", "held_out", "lang_pred", "score") for name, x in (("a", data), ("b", turned)))
    assert one == two and {(k[0], k[1]) for k in one} == {(d, held(d)) for d, *_ in data}
    right = {d: x for d, _, x, *_ in data}
    assert all(k[2] == right[k[0]] for k in one if k[0] != 900)


def test_quality_query_learns_from_its_folds_only(spark, tmp_path):
    rng = random.Random(7)
    text = lambda i: ". ".join(words(rng, 12).capitalize() for _ in range(3)) if i % 4 else " ".join(f"{w}$$$" for w in words(rng, 30).split())
    data = [(i, text(i), "en", "s", 1) for i in range(400)]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    labels = [(i, int(bool(i % 4)), 0) for i in range(400)]
    turned = [(i, 1 - q if held(i) else q, 1) for i, q, _ in labels]
    relabelled = [(d, t, "fr", "other", 9) for d, t, *_ in data]
    one, two = (multiset(quality.query(spark, sf_of(spark, tmp_path, name, x, y)), "doc_id", "held_out", "score", "predicted") for name, x, y in (("a", data, labels), ("b", relabelled, turned)))
    assert one == two and {(k[0], k[1]) for k in one} == {(d, held(d)) for d, *_ in data}
    assert all(p == (s >= 0.3) for _, _, s, p in one)


def test_quality(spark):
    rng = random.Random(7)
    good = lambda: ". ".join(words(rng, 12).capitalize() for _ in range(8))
    bad = lambda: " ".join(f"{w}$$$" for w in words(rng, 60).split())
    data = [(i, good() if i % 4 else bad(), "clash", 0.5) for i in range(3000)] + [(7000, None, None, None), (7001, "", None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, at string, score double")
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(0, 3000, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    weights, prior = quality.fit(docs, labels)
    assert 0.6 < prior < 0.95
    got = {r.doc_id: r.quality_score for r in quality.scored(docs, weights).collect()}
    assert len(got) == 3002 and all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.3) == bool(i % 4) for i in range(3000))
    assert right > 2800
    weights, prior = quality.fit(docs, labels.limit(0))
    assert prior == 0.5 and not weights.any()
    assert quality.scored(empty(spark), weights).count() == 0


def features_by_hand(text):
    """The features of a text, one by one."""
    place = lambda kind, x, start, size: start + xxhash.xxh64_intdigest(f"{kind}\0{x}") % size
    kind = lambda c: c if ord(c) < 128 and not c.isalnum() else "A" if c.isupper() else "a" if c.isalpha() else "0" if c in "0123456789" else "~"
    words_, out = text.split(), collections.Counter()
    counts, n, chars = collections.Counter(words_), len(words_), max(len(text), 1)
    figures = {
        "variety": len(counts) / max(n, 1) ** 0.8,
        "commonest": max(counts.values(), default=0) / max(n, 1),
        "upper": sum(w.isupper() and len(w) > 1 for w in counts) / max(len(counts), 1),
        "plain": sum(w.strip(".,;:!?\"'()").isalpha() for w in words_) / max(n, 1),
        "word": min(sum(map(len, words_)) / max(n, 1), 20) / 20,
        "line": min(n / len(text.split("\n")), 100) / 100,
        "length": min(math.log1p(n) / 12, 1),
        "digits": sum(c in "0123456789" for c in text) / chars,
    }
    for name, value in figures.items():
        out[place("f", f"{name}:{int(min(value, 2) * 16)}", 0, 512)] += 1.0
    pieces = [w[i : i + 64] for w in words_ for i in range(0, len(w), 64)]
    for scale, of in ((2.0, lambda w: place("s", "".join(k for k, _ in itertools.groupby(map(kind, w))), 512, 1024)), (0.5, lambda w: place("w", w.lower(), 1536, 2560))):
        found = collections.Counter(map(of, pieces))
        size = math.sqrt(sum(v * v for v in found.values()))
        for k, v in found.items():
            out[k] += scale * v / size
    return out


def test_quality_scores_by_hand(spark):
    w = np.random.default_rng(2).normal(size=quality.DIMENSIONS + 1)
    data = [(i, t) for i, (_, t, *_) in enumerate(rows())] + [(900, "x" * 1000 + " " + "Ab9-" * 60), (901, "ABC def12 ÉÈ ½ " * 50)]
    got = {r.doc_id: r.quality_score for r in quality.scored(spark.createDataFrame(data, "doc_id long, text string"), w).collect()}
    for i, t in data:
        z = sum(w[k] * v for k, v in features_by_hand(t or "").items()) + w[-1]
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-5, t
    tail = [(1, "y" * 100 + "a" * 64), (2, "y" * 100 + "$" * 64)]
    a, b = (r.quality_score for r in quality.scored(spark.createDataFrame(tail, "doc_id long, text string"), w).collect())
    assert a != b  # what lies far into a run counts


def test_quality_samples_are_bounded_by_rows(spark):
    docs = spark.range(20_000).selectExpr("id % 2 AS doc_id", "'one text' AS text")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    seen = []
    real = quality.estimate_prior
    quality.estimate_prior = lambda p, u, **k: (seen.append((len(p), len(u))), real(p, u, **k))[1]
    try:
        quality.fit(docs, labels, max_positive=300, max_unlabelled=500)
    finally:
        quality.estimate_prior = real
    ((p, u),) = seen
    assert 200 < p < 400 and 380 < u < 620


def test_risk_is_non_negative_and_unbiased():
    """The gradient steps follow prior * R+ + max(0, Ru- - prior * Rp-): its value falls, and clamping changes the course."""
    rng = np.random.default_rng(5)
    row = lambda at: (np.array(at, np.int32).tobytes(), np.ones(len(at), np.float32).tobytes())
    positive = [row([1, 10 + int(rng.integers(5))]) for _ in range(200)]
    unlabelled = [row([1 if rng.random() < 0.4 else 2, 10 + int(rng.integers(5))]) for _ in range(400)]
    prior = 0.4

    def risk(w):
        score = lambda found: np.array([sum(w[k] for k in np.frombuffer(a, np.int32)) + w[-1] for a, _ in found])
        p, u = score(positive), score(unlabelled)
        return prior * np.logaddexp(0, -p).mean() + max(0.0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())

    w = quality.train(quality.Rows.of(positive), quality.Rows.of(unlabelled), prior, steps=300)
    assert risk(w) < 0.25 < risk(np.zeros(quality.DIMENSIONS + 1)) and w[1] > 0 > w[2]


def test_awkward_rows_pass_the_classifiers(spark):
    df = table(spark)
    model = language.fit(df)
    assert language.identify(df, model).columns == [*df.columns, "lang_pred", "score"]
    assert language.identify(df, model).count() == len(rows())
    assert quality.scored(df, np.zeros(quality.DIMENSIONS + 1)).where(F.col("quality_score") == 0.5).count() == len(rows())
    assert DDL
