"""A small table of documents with awkward rows: nulls, empties, ties, repeats, long texts, clashing columns."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, label string, rank int, n long, spans string"


def words(rng, n, size=60):
    return " ".join(f"{rng.choice(['ab', 'Cd', 'éf', 'gh1', 'x'])}{rng.randrange(size)}" for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    passage, base = words(rng, 60), words(rng, 80)
    texts = [words(rng, rng.randrange(1, 150)) for _ in range(40)]
    texts += [base] * 5 + [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(12)]
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " ", "\n\n", "x", "x " * 500, "aaaa" * 300, "ñ" * 400, "one two three four", "One TWO\tthree\nfour", words(rng, 3000), "a b\x85c \x1cd"]
    out = [(i, t, rng.choice(["en", "fr", None]), f"s{rng.randrange(15)}", None, "clash", 1, 2, "x") for i, t in enumerate(texts)]
    out += [(None, base, "en", None, None, None, None, None, None), (3, texts[3], "en", "s1", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rng.shuffle(out)
    return out


def table(spark, seed=1):
    return spark.createDataFrame(rows(seed), DDL).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DDL)
