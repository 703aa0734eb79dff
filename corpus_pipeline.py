"""A training-corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and reread.
All stages but the last return the columns of ``documents``.

Nulls and edges: a row with a null id cannot be addressed and goes in the first stage, as does a null text or one without
letters; null lang, source and n_chars stay or are filled in; a repeated row stays repeated until a stage drops its document;
an empty table passes all stages; columns that ``documents`` does not name are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.llm.decontaminate import decontaminate
from polyspark.llm.language_id import UNDETERMINED, learn, predict_language
from polyspark.llm.line_dedup import cut_lines, removed_lines
from polyspark.llm.ngram_jaccard import jaccard_classes
from polyspark.llm.piece_bpe import default_model, encode_pieces
from polyspark.llm.stash import Stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be determined (no letter at all) go; a missing language is filled in."""
    found = predict_language(docs, learn(docs)).select(F.col("doc_id").alias("_id"), "lang_pred").where(F.col("lang_pred") != UNDETERMINED)
    rows = docs.join(found.dropDuplicates(["_id"]).hint("merge"), docs["doc_id"].cast("long") == F.col("_id"))
    return rows.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; a document of which nothing but white space is left goes."""
    rows = cut_lines(docs, removed_lines(docs)).where((F.col("n_removed_lines") == 0) | (F.trim("text") != ""))
    return rows.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity the one with the smallest id stays."""
    kept = jaccard_classes(docs).where("component_id = doc_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept.hint("merge"), docs["doc_id"].cast("long") == F.col("_id"), "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, keep=COLUMNS[1:]).where("n_hit = 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return encode_pieces(docs, default_model())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: Learned languages, alignments and token merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stash = Stash(spark, "pipeline")
    for _, stage in STAGES:
        docs = stash.put(stage(spark, docs, sf_dir))
    return docs
