"""A training corpus in five stages: toxicity, line dedup, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import line_dedup, minhash_dedup, mixing, passage_dedup, sentencepiece_bpe, toxicity
from keyloom.llm.common import documents, saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows outside the held-out fold, does not reject.

    Decided cases: null and empty texts score by the bias alone; rows that repeat go or stay alike; a null doc_id is judged by its text; without
    labels of both classes, or words that tell them apart, every document stays; other columns are kept; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated multi-line chunks; n_chars follows the text."""
    out = line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated multi-line chunks and passages; n_chars follows the text.

    Decided cases: a null text stays null, as does its n_chars; a text all of whose lines repeat becomes empty and stays a document; rows with a null
    doc_id count as repeats and are never cut; rows that repeat a doc_id and text are both first places; other columns are kept; an empty table
    gives no rows.
    """
    out = passage_dedup.passage_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    Decided cases: null and blank texts are nobody's duplicates and stay; of a group the smallest doc_id stays; rows that repeat a doc_id go or stay
    together; rows with a null doc_id stay; other columns are kept; an empty table gives no rows.
    """
    return minhash_dedup.deduplicated(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most.

    Decided cases: null and blank texts have no words and are not taken; null sources are one source; rows that repeat are documents of their own;
    other columns are kept; an empty table gives no rows.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text with an end id, their number, and the digest of the text that they decode to.

    Decided cases: a null text is encoded like the empty one, as the end id alone; rows that repeat are encoded alike; an empty table gives no rows.
    """
    keep = ["doc_id", "lang", "source"]
    then = sentencepiece_bpe.Then(_told, "doc_id long, lang string, source string, ids array<int>, n_tokens long, decoded_sha256 string")
    return sentencepiece_bpe.encode(docs.select(*keep, "text"), sentencepiece_bpe.default_model(), keep=keep, back="decoded", then=then)


def _told(batch: pa.RecordBatch) -> pa.RecordBatch:
    names = ["doc_id", "lang", "source", "ids"]
    digests = pa.array([hashlib.sha256(t.as_buffer().to_pybytes()).hexdigest() for t in batch.column("decoded")], pa.string())
    sizes = batch.column("ids").value_lengths().cast(pa.int64())
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), sizes, digests], [*names, "n_tokens", "decoded_sha256"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_passages),
    ("minhash_dedup", dedup_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A trained classifier, MinHash and a BPE vocabulary are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
