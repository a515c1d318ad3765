"""The corpus pipeline: toxicity, language, near duplicates, benchmark passages, packing.

Every stage but the last keeps or drops whole rows of ``documents`` and leaves their
columns as they are, whatever these are called; nulls, empty texts, repeated rows and
empty tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskengine.llm import decontamination, langid_crf, simhash_anchor, toxicity_ftrl
from riskengine.llm import queries as q
from riskengine.session import materialize

#: A text is dropped where no language holds this share of its words.
LEAST_LANGUAGE_SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones here, does not call toxic."""
    model = q.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_ftrl.score(docs, model, keep=None).filter(~toxicity_ftrl.is_toxic()).select("row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose words are mostly of one language."""
    found = langid_crf.predict(docs, q.language_model(docs), keep=None)
    return found.filter((F.col("lang_pred") != langid_crf.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SHARE)).select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component, and one of repeated rows.

    The survivors' keys are chosen first, so whole rows are shuffled once, to meet them.
    Rows repeated in all columns share a key; they are made one before they are shuffled.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*own)
    keyed = docs.select(row.alias("_row"), F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(F.to_json(row)).alias("hash")).alias("_key"))
    found = simhash_anchor.near_duplicates(keyed.select("_key", F.col("_row.text").alias("text")), "_key")
    first = found.filter(F.col("_key") == F.col("component_id")).groupBy("_key").count()
    first = materialize(first, "survivors")
    once = keyed.join(first.filter("count = 1"), "_key", "left_semi")
    repeated = keyed.join(first.filter("count > 1"), "_key", "left_semi").dropDuplicates(["_key"])
    return once.unionByName(repeated).select("_row.*").select(*own)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of packed training sequences."""
    return q.packed_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language id", keep_known_languages),
    ("near duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Models are fitted on the way, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
