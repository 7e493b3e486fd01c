"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import alignment, classifier, decontaminate, jaccard, packing, periods, pii, quality, secrets, sharding, toxicity, urls, warc
from lakeweave.llm import spans as S
from lakeweave.llm import sql
from lakeweave.session import literal_rows, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


@add("op1_benchmark_containment", sql.CONTAINED)
def benchmark_containment(spark, sf_dir):
    """Benchmark items of which a document holds 80 percent of the five-word shingles or more."""
    found = decontaminate.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "n_item")


@add("op2_secret_scan", sql.SECRETS)
def secret_scan(spark, sf_dir):
    """Secrets of every document through the trigram index."""
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count_of("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(S.digest_text(F.col("base")), 256).alias("base_sha256"),
        S.digest_text(F.col("spans")).alias("spans"),
    )


@add("op3_personal_data")
def personal_data(spark, sf_dir):
    """Personal data of every document: base spans and those that the boosted trees add."""
    found = pii.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count_of("base", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(S.digest_text(F.col("base")), 256).alias("base_sha256"),
        S.digest_text(F.col("spans")).alias("spans"),
    )


@add("op5_token_fertility")
def token_fertility(spark, sf_dir):
    """Quality rules for every document, with the fertility of its tokens."""
    judged = quality.judge(read(spark, sf_dir, "documents"), columns=["doc_id"])
    return judged.select(
        F.col("row.doc_id").alias("doc_id"),
        *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
        "rejected_by",
        *[f"m.{c}" for c in ("n_tokens", "chars_per_token", "byte_share", "token_entropy")],
    )


@add("op10_sequence_packing")
def sequence_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@add("op7_jaccard_join", sql.COMPONENTS)
def jaccard_join(spark, sf_dir):
    """The near-duplicate component of every document."""
    return jaccard.linked(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@add("op6_warc_archive", sql.ARCHIVE)
def warc_archive(spark, sf_dir):
    """All pages written to a content-addressed archive and read back."""
    folder = work_dir(spark, "archive")
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        F.octet_length("record").cast("long").alias("record_bytes"), F.sha1("record").alias("record_sha1"),
    )


@add("op8_url_filter", sql.URLS)
def url_filter(spark, sf_dir):
    """The rule and verdict of every page's address."""
    rules = literal_rows(spark, "host string, path string, verdict string", sql.URL_RULES)
    return urls.judge(read(spark, sf_dir, "pages"), rules)


@add("op9_extendible_shards", sql.SHARDS)
def extendible_shards(spark, sf_dir):
    """The shard of every document."""
    return sharding.shard(read(spark, sf_dir, "documents"))


@add("op4_quality_classifier")
def quality_classifier(spark, sf_dir):
    """A calibrated quality score for every document."""
    return classifier.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@add("op13_tokenizer_alignment")
def tokenizer_alignment(spark, sf_dir):
    """How the tokens of two tokenizers meet in every document, and how often each pair of ids is linked."""
    return alignment.aligned_counts(read(spark, sf_dir, "documents"))


@add("op12_periodic_runs")
def periodic_runs(spark, sf_dir):
    """The runs of repeated words of every document, every tenth one with a periodic tail."""
    return periods.detect(read(spark, sf_dir, "documents"), periods.periodic_tail)


@add("op11_toxicity")
def toxic_documents(spark, sf_dir):
    """A calibrated toxicity score for every document, of its words as they are read through the disguise."""
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
