"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of documents; the last returns the packed pieces. run() applies them to the
documents table, writing each stage's rows to the shared folder.

Defined cases: documents that language ID rejects (null, without a letter, or scored below
MIN_LANGUAGE_SCORE) go; a document that loses all its lines to boilerplate goes; of rows with one id
and text one stays; rows with a null id are never near duplicates of others; a document goes that holds
a window of 8 words of any test item, or the whole of an item of MIN_ITEM_WORDS to 7 words, or at least
half of whose words are those of whole items of fewer words (which any long text holds by chance); an
empty table packs to no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.llm import decontaminate, language, lines, neardup, packing
from ringweave.llm._common import staged

MIN_LANGUAGE_SCORE = 0.5
#: One occurrence of a whole test item of so many words is evidence; shorter ones count by their share of the words.
MIN_ITEM_WORDS = 4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of docs; what is null, without a letter or of an unsure language goes."""
    found = language.identify(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go, but for their first occurrence; a text of which nothing is left goes, an unchanged one stays as it is."""
    found = lines.without_boilerplate(docs)
    left = (F.col("n_lines_removed") == 0) | (F.trim(F.translate("text", "\n", " ")) != "")
    length = F.when(F.col("n_lines_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return found.where(left).withColumn("n_chars", length).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one text under one id stays; rows with a null id stay all."""
    kept = neardup.near_duplicates(docs).where("chosen and doc_id is not null").select(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_hash")).distinct()
    keyed = docs.withColumn("_h", F.xxhash64(F.col("text").cast("binary")))
    one = keyed.join(kept, (keyed.doc_id == kept._kept) & (keyed._h == kept._hash), "left_semi").dropDuplicates(["doc_id", "_h"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold test items go, by the rules at the top of this module; without items all stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n = F.size(F.expr(r"regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)"))
    short = items.where((n > 0) & (n < MIN_ITEM_WORDS))
    left = decontaminate.flagged(docs, items.where(n >= MIN_ITEM_WORDS)).where(F.size("items") == 0).select(*docs.columns)
    if not short.limit(1).count():
        return left
    return decontaminate.flagged(left, short).where((F.col("n_hit") == 0) | (F.col("n_hit") * 2 < F.col("n_words"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids; a null or empty text, which an earlier stage removes, would be its end id."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("lines", remove_lines),
    ("near_duplicates", remove_near_duplicates),
    ("decontaminate", remove_contaminated),
    ("packing", pack),
]

#: Language ID and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
