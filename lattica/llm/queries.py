"""The registered queries of the training-data operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import html_text, mixing, nn_descent, packing, sharding, simhash, suffix, syncmers, toxicity, urls
from lattica.llm.common import table


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by law `rows`. Null texts have size 1; repeated rows get slots of their own; an empty table gives an empty one."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and their edited texts. Null texts are empty; ties of doc_id go by text; a single document is its own next."""
    return syncmers.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and audited recall of all vectors. Null, zero and non-finite ones link with nothing; repeated rows and null ids are vectors of their own."""
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings. Null texts are empty; repeated rows are each other's repeats."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix per document in training order: what is taken, in how many epochs, and the training positions of its first and last take.

    Null texts have size 0 and are never taken (positions null); repeated rows
    take part one by one; an empty table gives an empty one.
    """
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    first, last = F.get("takes", F.lit(0))["position"], F.get("takes", F.size("takes") - 1)["position"]
    placed = plan.withColumn("position", first).withColumn("last_position", last).withColumn("epochs", F.size("takes"))
    return mixing.in_training_order(placed).select("doc_id", "size", "source_size", "target", "taken", "epochs", "position", "last_position")


def op6_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, prediction and evidence for every document. Null, empty and termless texts get the rate of termless examples; repeated rows come as often."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def op7_html_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, n_html (characters), text: the visible text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return html_text.extract_text(pages).select("page_id", F.length("html").cast("long").alias("n_html"), "text")


def op8_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and wordless texts have fingerprint zero; repeated rows come as often; null ids name no component that has another."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with sequence and offset. Null and empty texts are one separator; repeated rows are packed one by one; ties may swap places."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer_path())


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url. Null urls and those without `://` have an empty host and path and are allowed; repeated rows come as often."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_feistel_sharding,
        op2_syncmer_fingerprints,
        op3_nn_descent,
        op4_suffix_array_dedup,
        op5_curriculum_mix,
        op6_toxicity_neighbours,
        op7_html_layout_text,
        op8_simhash_trie_join,
        op9_best_fit_packing,
        op10_url_rules,
    )
}
