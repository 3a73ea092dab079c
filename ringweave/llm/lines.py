"""Line dedup by distinct-site spread, with DataFrame functions only.

A line is boilerplate if it stands, once trimmed, on at least `min_sites` sites. Lines are grouped by a
128-bit hash and each group keeps a HyperLogLog sketch of its sites: sketches are built on the map side
and merged by aggregation, so a line that a third of all documents share reaches the reducers as one
sketch a task. Sketch estimates decide, except within `near` of the threshold: for those lines alone
sites are counted exactly. Of a boilerplate line the first occurrence (smallest doc id, then
position) stays, so no text leaves the corpus altogether; all other occurrences are removed.

Defined cases: a null text has no lines and stays null; blank lines are never removed; a null site is
no site; rows with a null id come last in the order; repeated rows (same id and text) are treated
alike; columns of any name are kept, but n_lines and n_lines_removed are replaced; a text is split and put
together whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NULL_ID, documents, staged

MIN_SITES = 10


def boilerplate(lines: DataFrame, *, min_sites: int = MIN_SITES, precision: int = 12, near: float = 0.25) -> DataFrame:
    """(h1, h2, first) of the lines on at least min_sites sites. lines: h1, h2, site, at (order of occurrence)."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(precision)).alias("sites"), F.min("at").alias("first"), F.count("*").alias("n"))
    # a line that occurs fewer times than that can't be on so many sites
    spread = staged(sketched.where(F.col("n") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sites").alias("spread")), "spread")
    low, high = min_sites * (1 - near), min_sites * (1 + near)
    unsure = spread.where((F.col("spread") >= low) & (F.col("spread") <= high))
    exact = lines.join(unsure.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).where("site is not null")
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")
    return spread.where(F.col("spread") > high).select("h1", "h2", "first").unionByName(unsure.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def without_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, precision: int = 12, near: float = 0.25) -> DataFrame:
    """docs with the text cleaned, and n_lines and n_lines_removed (columns of these names are replaced)."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_lines_removed")]
    # one column that holds them all: no name of docs can clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    own = lambda name: F.col("row").getField(name)
    text, key = own(text_col).cast("string"), [F.coalesce(own(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(own(text_col).cast("string")).alias("h")]
    split = rows.select(*key, own(site_col).cast("string").alias("site"), F.posexplode(F.transform(F.split(text, "\n"), lambda x: F.trim(x))).alias("pos", "line")).where("line <> ''")
    lines = split.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site", F.struct("id", "h", "pos").alias("at"))
    found = boilerplate(lines, min_sites=min_sites, precision=precision, near=near)
    gone = lines.join(found, ["h1", "h2"]).where(F.col("at") != F.col("first")).groupBy("at.id", "at.h").agg(F.collect_set("at.pos").alias("gone"))
    joined = rows.select("row", *key).join(gone.hint("shuffle_hash"), ["id", "h"], "left")
    all_lines = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), "gone"), lambda i: F.get(all_lines, i))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    n_lines, removed = F.coalesce(F.size(all_lines).cast("long"), F.lit(0).cast("long")), F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return joined.select(*[cleaned.alias(c) if c == text_col else own(c).alias(c) for c in names], n_lines.alias("n_lines"), removed.alias("n_lines_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_boilerplate(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, source, pos, line, trim(line, ' ') AS key FROM l),
b AS (SELECT key, min((doc_id, pos)) AS first FROM t WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT doc_id, pos, line, b.key IS NOT NULL AND (doc_id, pos) <> b.first AS gone FROM t LEFT JOIN b USING (key)),
g AS (SELECT doc_id, count(*) AS n, sum(CAST(gone AS INTEGER)) AS r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_lines_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
