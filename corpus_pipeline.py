"""From raw documents to token-id files: language, near-duplicates, benchmark leaks, mixing, token ids.

Every stage takes (spark, docs, sf_dir), decides over all rows of ``docs``, and returns what goes on.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import shared, tokenids
from quarry.llm.decontaminate import decontaminate
from quarry.llm.langid import identify, train
from quarry.llm.minhash import judged
from quarry.llm.mixing import mix
from quarry.llm.queries import tokenizer_path
from quarry.llm.sampling import fold

#: A language whose calibrated probability is below this is no language that the corpus knows.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter, and texts that no learned language fits.

    Other columns may be null; a null ``lang`` is not learned from.  If no row has a language to learn, nothing is
    dropped.  Repeated rows are judged alike; an empty table stays empty.
    """
    model = train(docs.where(F.coalesce(fold(4) != 2, F.lit(True))))
    if model is None:
        return docs
    return identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document of the least id, and of repeated rows one.

    Five-word shingles, similarity of 0.8 or more.  Rows with a null id, and null or blank texts, have no duplicates
    and stay.  Rows that repeat an id with other text are judged by their own text; of several in one group that have
    its least id, the one of the least hash of the text stays.
    """
    rows = judged(docs)
    own = F.xxhash64(F.col("text").cast("string"))
    copies = rows.where("NOT kept").select("doc_id", "text_hash")
    # of kept rows of one id in one group, all but one; rows without words are in no group
    first = rows.where("kept AND component IS NOT NULL").groupBy("component").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).where("first <> last").select("component", "first")
    others = rows.where("kept").join(first, "component").where("text_hash <> first").select("doc_id", "text_hash")
    gone = shared.written(copies.unionAll(others).distinct().select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "pipeline-copies")
    left = docs.join(gone, (docs["doc_id"].cast("long") == gone["_id"]) & (own == gone["_hash"]), "left_anti")
    twice = shared.written(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "pipeline-repeated")
    shared.drop(rows)
    if twice.isEmpty():
        return left
    again = left["doc_id"].cast("long") == twice["_id"]
    return left.join(twice, again, "left_anti").unionAll(left.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.  Null and empty texts hold none; rows without an id are judged by
    their own text."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources reach their target shares.

    Sources in the order of their code points, null last, weigh 1, 2, 3 in turn; no document comes more than three
    times.  Null and empty texts have no words and are not taken.
    """
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the corpus as token-id files; returns what is read back from them: doc_id, start, n_tokens, ids_crc32.

    Rows in ascending doc_id (null first), each with the end id 0; a null or empty text has only that.
    """
    path = shared.new_path(spark, "pipeline-ids")
    tokenids.write_ids(docs, path, tokenizer_path(), end=0)
    return tokenids.read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: No stage but the mixture can be put in SQL; tests compare the pipeline with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        shared.drop(before)
        before = docs
    return docs
