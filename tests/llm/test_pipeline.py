"""The pipeline stage by stage on awkward rows."""

import corpus_pipeline as p

from .cases import empty, table
from .test_operators import near_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def benchmark_dir(spark, tmp_path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_in_turn(spark, tmp_path):
    docs = table(spark).select(*COLUMNS)
    chosen = next(r.text for r in docs.where("length(text) > 2000").collect() if len(r.text.split()) > 2000)
    sf = benchmark_dir(spark, tmp_path, [(1, " ".join(chosen.split()[5:40])), (2, None)])
    for name, stage in p.STAGES:
        before = docs.collect()
        docs = p.staged(stage(spark, docs, sf), name)
        after = docs.collect()
        if name == "packing":
            assert sum(r.length for r in after) > 0
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            continue
        assert docs.columns == COLUMNS and len(after) <= len(before)
        if name == "language":
            assert {r.text for r in before} - {r.text for r in after} >= {None, "", " ", "\n\n"}
        if name == "near_duplicates":
            kept = [k for k, *_ in near_by_hand([(r.doc_id, r.text) for r in before], 80).elements() if k is None or _[2]]
            assert sorted(k for k in set(kept) if k is not None) == sorted(r.doc_id for r in after if r.doc_id is not None)
        if name == "decontaminate":
            assert [r.text for r in before if r not in after] == [chosen]


def test_empty(spark, tmp_path):
    docs, sf = empty(spark).select(*COLUMNS), benchmark_dir(spark, tmp_path, [])
    for name, stage in p.STAGES:
        docs = p.staged(stage(spark, docs, sf), name)
        assert docs.count() == 0


def test_run(spark, tmp_path):
    table(spark).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark_dir(spark, tmp_path, [(1, "nothing like it")])
    got = p.run(spark, str(tmp_path))
    assert got.count() and "sequence_id" in got.columns


def test_short_items(spark, tmp_path):
    filler = " ".join(f"word{i}" for i in range(200))
    question, long = "What is the capital of France?", "one two three four five six seven eight nine ten"
    texts = {
        1: f"{filler} what is the CAPITAL of France {filler}",  # a whole short item in a long text
        2: "Answer: Paris.",  # half of the words
        3: f"{filler} Paris " * 12,  # a common word, however often
        4: f"{filler} two three four five six seven eight nine {filler}",
        5: f"{filler} two three four five six seven eight {filler}",
        6: f"{filler} New York City {filler}",
        7: "is the capital of France",
        8: "",
    }
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    sf = benchmark_dir(spark, tmp_path, [(1, question), (2, "Paris"), (3, long), (4, "new york city"), (5, "!!"), (6, None)])
    assert sorted(r.doc_id for r in p.remove_contaminated(spark, docs, sf).collect()) == [3, 5, 6, 7, 8]
