"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Toxic documents go; of documents linked by a five-word Jaccard similarity of 0.8
or more one stays (found by op8's trie join over wider SimHashes); repeated
200-byte strings are removed from the texts; sources are mixed to target
weights (documents may come twice or in part); the mix is packed into sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import mixing, packing, simhash, suffix, toxicity
from lattica.llm.common import ensure_checkpoint_dir, table
from lattica.llm.queries import word_tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op6 does not predict toxic, by `labels`. Null, empty and termless texts are judged alike and stay; repeated rows share a verdict; without labels all stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group linked by similarity 0.8 or more. Null, empty and wordless texts are one group; of repeated rows one stays; null ids go last."""
    return simhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that occur twice. Null and short texts come back as they were, repeated rows are each other's repeats, characters are never cut through."""
    return suffix.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order, a row for each take. Null sources are a source, null and wordless texts are never taken, repeated rows are taken one by one."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset. Null and empty texts are a separator alone, repeated rows are packed one by one, ties may swap places."""
    return packing.pack_documents(docs, word_tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokenizing and suffix sorting have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared checkpoint folder; what a stage has read is deleted once its own rows are written.

    An empty table passes all stages; further columns pass all but the last.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
