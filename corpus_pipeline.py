"""A training corpus from `documents`: language, near-duplicates, secrets, mixture, tokens.

STAGES lists (name, function). A function takes (spark, docs, sf_dir); docs
has the columns of `documents`, and so has each stage's result but the last's.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.bpe import encode
from meterlake.llm.common import WORD, table, text_key, whole
from meterlake.llm.langid import identify, learn
from meterlake.llm.mixing import training_order
from meterlake.llm.neardup import near_duplicates
from meterlake.llm.secrets import redact

#: A text of which less than this share of n-grams belongs to any learned language is rejected.
LEAST_SCORE = 0.05
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their labels teach. Those without a letter, or in none of the languages, go; lang becomes the predicted language.

    So do null and empty texts, and all documents where no label is known.
    Whole texts count, of any length; repeated rows stay; an empty table gives
    an empty one. Columns other than those of documents are dropped.
    """
    found = identify(docs.select(*COLUMNS), learn(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: with the smallest id (null: largest), then the least SHA-256 of its text, then the least lang, source and n_chars. Rows without words stay, repeated ones too."""
    docs = docs.select(*COLUMNS)
    worded = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    rest = ("lang", "source", "n_chars")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rk"))
    keep = near_duplicates(docs).where("n_shingles > 0").groupBy("component").agg(first.alias("first")).select("first.rk", F.col("first.doc_id").alias("kept_id"))
    # Equal rows are made one before the shuffle, so that no task gets all copies of a text.
    once = docs.where(worded).groupBy(text_key().alias("rk"), "doc_id").agg(F.first("text").alias("text"), F.min(F.struct(*rest)).alias("rest"))
    found = once.join(keep.hint("merge"), (once["rk"] == keep["rk"]) & once["doc_id"].eqNullSafe(keep["kept_id"]))
    return found.select("doc_id", "text", *[f"rest.{c}" for c in rest]).select(*COLUMNS).union(docs.where(~worded))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced; n_chars follows the text.

    A null text stays null, and n_chars with it. Repeated rows stay, an empty table gives an empty one; texts may be of
    any length.
    """
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; tokens() keeps that.

    Null texts and texts without a word aren't taken, nor are sources of weight
    zero; a null source is one of its own. Repeated rows are taken each, an empty
    table gives an empty one; texts may be of any length.
    """
    return training_order(docs.select(*COLUMNS))


def _training_places(docs: DataFrame) -> DataFrame:
    """docs plus shard and place: a row's file, which the mixing stage wrote in order, and its number there. Rows that don't come from files have their partition and their number in it."""
    try:
        at = docs.metadataColumn("_metadata")
        return docs.withColumns({"shard": F.regexp_extract(at["file_name"], r"part-(\d+)", 1).try_cast("bigint"), "place": at["row_index"]})
    except AnalysisException:  # no file is read
        return docs.withColumns({"shard": F.spark_partition_id().cast("bigint"), "place": F.monotonically_increasing_id()})


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, shard, place, n_tokens, ids): the token ids of every row, as little-endian unsigned 32-bit integers.

    Ordered by shard and place, rows stand as docs' files hold them, which is
    the order of training. Null text has no ids, repeated rows are rows of their
    own, an empty table gives an empty one; texts may be of any length.
    """
    coded = encode(_training_places(docs.select("doc_id", "lang", "source", "text")))
    return coded.select("doc_id", "lang", "source", "shard", "place", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: SQL can express neither n-gram filters nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents. Each result is written to the shared folder and read again; all but the last's are deleted when that is written."""

    def pipeline(docs: DataFrame) -> DataFrame:
        for name, stage in STAGES[:-1]:
            docs = whole(lambda d, stage=stage: stage(spark, d, sf_dir), f"pipeline-{name}")(docs)
        return STAGES[-1][1](spark, docs, sf_dir)

    return whole(pipeline)(table(spark, sf_dir, "documents"))
