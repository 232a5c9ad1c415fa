"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoline.llm import (
    bpe_documents,
    host_reputation,
    jaccard_regions,
    keyed_ids,
    license_diagonals,
    line_spread,
    merkle_manifest,
    neighbour_votes,
    poisson_mix,
    projected_neighbours,
    sorted_passes,
    token_alignment,
    weak_rules,
)
from phenoline.llm.common import table
from phenoline.sources.paths import scratch_path


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
SOURCE_WEIGHTS = {"src0": 0.15, "src1": 0.08, "src2": 0.08, "src3": 0.08}


def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return projected_neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten sources or more hold."""
    return line_spread.drop_spread_lines(table(spark, sf_dir, "documents"), sites=10)


def op3_keyed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents to a store and read every one back by its key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = keyed_ids.write_store(docs, scratch_path(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    found = keyed_ids.find(spark, store, docs.select("doc_id"), ("ids_crc32",))
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page. A page's labelled outcome is the quality of the document whose number its path names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_reputation.url_parts(F.col("url"))
    number = F.expr("try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS bigint)")
    shown = pages.select(host.alias("host"), path.alias("path")).select("host", number.alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    outcomes = shown.join(labels, "doc_id", "left").select("host", (F.col("quality") == 1).alias("good"))
    judged = host_reputation.judge(pages, outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bound", 6).alias("bound"))


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places and labels of every document."""
    found = license_diagonals.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("score", F.round("score", 6)).drop("spans")


def op6_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four words are linked."""
    return jaccard_regions.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    made = bpe_documents.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs)
    return made.select("doc_id", *outputs)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the documents that is never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def op8_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    scored = neighbour_votes.score(docs, neighbour_votes.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every document."""
    judged = weak_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good")
    )


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights, in shuffled order."""
    return poisson_mix.mix(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, seed=7)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with a cosine of 0.9 or more."""
    return sorted_passes.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether what was tampered with still gives the root."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    leaf = merkle_manifest.leaf(*[F.col(c) for c in fields])
    other = merkle_manifest.leaf(*[more if c == "n_chars" else F.col(c) for c in fields])
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf.alias("leaf"), F.when(hit, other).alias("tampered"))
    manifest = merkle_manifest.build(rows, "doc_id", "lang", "leaf", ("doc_id", "tampered"))
    found = merkle_manifest.folded(F.coalesce("tampered", "leaf"), "path")
    proved = manifest.proofs().select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof("path").alias("proof_sha256"), found.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_projected_neighbours,
        op2_line_spread,
        op3_keyed_ids,
        op4_host_reputation,
        op5_license_diagonals,
        op6_jaccard_regions,
        op7_bpe,
        op8_neighbour_votes,
        op9_weak_rules,
        op10_poisson_mix,
        op11_token_alignment,
        op12_sorted_passes,
        op13_merkle_manifest,
    )
}
