"""A training-corpus pipeline over ``documents``: five stages, each of one operator of ``swatch.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes each result as Parquet in the shared checkpoint folder and reads it
back as the next stage's input.

Near duplicates are documents whose sets of ``NEAR_WORDS``-word n-grams have a Jaccard similarity of at least
``NEAR_PERCENT`` per cent: the stage's own choice, not that of the query op7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatch.llm import decontaminate, jaccard, languages, pieces, secrets
from swatch.llm.common import DOC_COLUMNS, table
from swatch.session import materialize

MIN_LANGUAGE_SCORE = 0.3
NEAR_WORDS, NEAR_PERCENT = 5, 80
BROADCAST_ROWS = 1_000_000
MASK = "[SECRET]"

# SQL cannot state language models, byte-pair encodings or the exact join; tests compare with brute force.
ORACLE_SQL = None


def _side(df: DataFrame) -> DataFrame:
    """``df`` written once, to be broadcast if it has few rows and shuffled otherwise."""
    df = materialize(df, "pipeline-side")
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds a key of the row's id and text, as ids may repeat or be null: 128 bits, so that no two rows of any corpus share one."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return docs.withColumn("_key", F.md5(F.concat(known("doc_id"), F.lit("\x01"), known("text"))))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no language holds a fair share, go."""
    docs = docs.select(*DOC_COLUMNS)
    found = languages.identify(docs, languages.fit(docs), keep=DOC_COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 5 words and 0.8 the one with the smallest id stays; of rows that repeat it, one."""
    docs = _keyed(docs.select(*DOC_COLUMNS))
    found = jaccard.jaccard_components(docs, id_col="_key", n=NEAR_WORDS, percent=NEAR_PERCENT)
    parts = materialize(found, "pipeline-components")
    groups = _side(parts.where("component_id <> _key").select("component_id").distinct())
    members = _side(parts.join(groups, "component_id").select("component_id", "_key").distinct())
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"))
    named = materialize(docs.select("_key", first.alias("row")).join(members, "_key"), "pipeline-members")
    stays = named.groupBy("component_id").agg(F.min("row").alias("stays"))
    gone = named.join(_side(stays), "component_id").where("row <> stays").select("_key").distinct()
    kept = docs.join(_side(gone), "_key", "left_anti")
    again = _side(parts.where("n_shingles > 0").groupBy("_key").count().where("count > 1").select("_key"))
    once = kept.join(again, "_key", "left_anti")
    return once.unionByName(kept.join(again, "_key", "left_semi").dropDuplicates(["_key"])).select(*DOC_COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a test item go."""
    docs = _keyed(docs.select(*DOC_COLUMNS))
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), id_col="_key")
    hit = _side(found.where("n_hit > 0").select("_key").distinct())
    return docs.join(hit, "_key", "left_anti").select(*DOC_COLUMNS)


def mask(text, parts):
    """``text`` with every maximal stretch of overlapping parts replaced by ``MASK``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, p):
        fresh = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (p["start"] - acc["at"]).cast("int")),
                         F.lit(MASK))
        return F.struct(F.greatest(acc["at"], p["end"]).alias("at"),
                        F.when(p["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, with linked weak parts, are masked; the documents stay."""
    docs = _keyed(docs.select(*DOC_COLUMNS))
    found = secrets.find_secrets(docs, id_col="_key").where(F.size("parts") > 0)
    parts = _side(found.groupBy("_key").agg(F.first("parts").alias("parts")))
    both = docs.join(parts, "_key", "left")
    text = F.when(F.col("parts").isNull(), F.col("text")).otherwise(mask(F.col("text"), F.col("parts")))
    return both.withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("parts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    ).select(*DOC_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with byte spans of the masked text."""
    import public_tokenizers

    out = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scan", secret_scan),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
