"""A corpus pipeline of five stages, each one operator: language ID, line dedup, SimHash near-dedup, benchmark
decontamination, byte-level BPE. Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import bpe, decontamination, language_id, line_dedup, simhash
from siltbed.llm.common import checkpoint_dir, held_out
from siltbed.llm.queries import RANKS

#: Words of a benchmark window.
WINDOW = 13
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter in it) go; `lang` becomes the predicted one."""
    model = language_id.fit(language_id.training_sample(docs.where(~held_out(F.col("doc_id")))))
    found = language_id.identify(docs.select(*COLUMNS), model)
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of these but the one with the least doc_id, so that the next stage
    finds one whole copy of a text with many; no document goes. n_chars follows the text."""
    return line_dedup.drop_frequent_lines(docs.select(*COLUMNS), keep_one=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the least doc_id stays."""
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of WINDOW words or more that stand in the benchmark go, however long they are, and so do
    those of which benchmark windows (of short items too) cover a twentieth of the words or more."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontamination.find(docs.select(*COLUMNS), benchmark, window=WINDOW)
    passage = F.exists("hit_spans", lambda s: s["end"] - s["start"] >= WINDOW)
    return found.where(~(F.col("contaminated") | passage)).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, ids, n_tokens, decoded_sha256): the token ids of the whole text, and the digest of
    the bytes they decode to. Fails where these are not the text's."""
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    found = same_text(bpe.encode(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN, digest=True))
    return found.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


def same_text(encoded: DataFrame) -> DataFrame:
    """encoded, if each decoded_sha256 is that of the text (a null text counts as empty); else its ids and digest fail."""
    same = F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)
    wrong = F.raise_error(F.concat(F.lit("ids do not decode to the text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return encoded.withColumns({c: F.when(same, F.col(c)).otherwise(wrong.cast(encoded.schema[c].dataType)) for c in ("ids", "decoded_sha256")})


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]

#: Language models and token ids are beyond SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next. What a stage has
    written goes when the next has been written, so the input of the last is all that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
