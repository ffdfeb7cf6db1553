"""A corpus pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.llm import common, langid, packing, pii, simhash, substring
from lumenspan.llm.queries import vocabulary

#: A text whose best language has a smaller probability is rejected, as one without a letter is.
LEAST_LANGUAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language, and writes it where ``lang`` is null.

    Rows without an id go, as no later stage could name them; null and empty texts and texts
    without a letter have no language and go; repeated rows are judged alike; an empty table, or
    one without a labelled row, leaves none. Any further columns stay as they are.
    """
    rows = docs.where("doc_id is not null")
    model = langid.fit(rows.select("doc_id", "text", "lang"))
    name = common.fresh("predicted", docs.columns)
    out = langid.annotate(rows, model, name=name)
    out = out.where((F.col(name)["lang"] != langid.UNDETERMINED) & (F.col(name)["score"] >= LEAST_LANGUAGE))
    return out.withColumn("lang", F.coalesce(F.col("lang"), F.col(name)["lang"])).drop(name)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Rows that repeat an id are one document; of them the row whose text sorts first stays. Null
    and empty texts are copies of each other. Rows without an id go. Any further columns stay as
    they are.
    """
    keep = simhash.near_duplicates(docs, radius=4, shingle=4).where("doc_id = component_id").select("doc_id").distinct()
    place = common.fresh("place", docs.columns)
    one = Window.partitionBy("doc_id").orderBy("text")
    return docs.join(keep, "doc_id", "left_semi").withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that start in a document with a smaller id; the text is untouched where there are none.

    All rows stay, whatever is left of their texts; null texts stay null; rows that repeat an id
    take nothing from each other. Rows without an id go. Any further columns stay as they are.
    """
    out = substring.remove_repeats(docs, window=50, carry=tuple(docs.columns))
    text = F.when(F.col("n_removed") == 0, F.col("carried.text")).otherwise(F.col("kept"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[changed.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each piece of personal data in its place.

    All rows stay, those without an id untouched; null texts stay null; repeated rows are
    redacted alike. Any further columns stay as they are.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens; null and empty texts are an end mark alone; rows without an id go."""
    return packing.pack(docs, vocabulary(), window=4096, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii_redaction),
    ("packing", retrieval_packing),
]

#: SimHash components, passages and packing can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, f"pipeline-{name}")
    return docs
