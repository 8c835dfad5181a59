"""A training-corpus pipeline: five stages over ``documents``, each on all its predecessor kept.

    language ID -> quality classifier -> SimHash near-dedup -> mixing to target weights -> byte-pair encoding

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads
it again for the next. All but the last return the columns of ``documents``. Stages share executors, whose Python workers keep
what they once took, so stages with Python bound the session's batches by bytes (``small_batches``).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrapair.llm import gam_quality, ppm_langid, systematic_mix, transducer_bpe, vptree_simhash
from contrapair.llm.common import crc_fold, small_batches, table
from contrapair.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in one of the learnt languages; those without a letter are in none and go.

    Null texts go with them; a text in any learnt language stays, however short. Without anything to learn from, all stay.
    """
    small_batches(spark)
    docs = docs.select(COLUMNS)
    trees = ppm_langid.learn(docs, "doc_id", "text", "lang", crc_fold("doc_id", 4) != 2)
    if trees is None:
        return docs
    return ppm_langid.identify(docs, "text", COLUMNS, trees).where(
        F.col("lang_pred") != ppm_langid.UNDECIDED).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose probability of label 1 is one half or more. Without labels all stay."""
    small_batches(spark)
    docs = docs.select(COLUMNS)
    labels = table(spark, sf_dir, "labels")
    sample = gam_quality.labelled_texts(docs, labels, "doc_id", "text", "quality", crc_fold("doc_id", 3) != 1)
    narrow = materialise(gam_quality.feature_table(sample, "text", ["doc_id"]))
    model = gam_quality.learn(narrow, labels, "doc_id", "quality", F.lit(True))
    return gam_quality.score_texts(docs, "text", COLUMNS, model).where("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of texts with a similarity of 0.8 or more on shingles of five words."""
    small_batches(spark)
    return vptree_simhash.keep_one(docs.select(COLUMNS), "doc_id", "text", words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights; rows repeat as often as they are taken."""
    return systematic_mix.repeat_rows(docs.select(COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit) and whether decoding gives back the text."""
    small_batches(spark)
    docs = docs.select("doc_id", "source", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest"))
    # smaller caches than on its own: the workers of earlier stages still hold memory
    done = transducer_bpe.encode_decode(docs, "text", ["doc_id", "source", "digest"], public_tokenizers.path("byte_bpe_50k.json"), cache_words=100_000)
    same = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("digest")
    return done.select("doc_id", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: No SQL expresses these models; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
