"""From raw documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoline.llm import bpe_documents, jaccard_regions, line_spread, neighbour_votes, poisson_mix
from phenoline.llm.common import stored, table
from phenoline.llm.queries import SOURCE_WEIGHTS, held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the votes of their nearest labelled neighbours predict to be good."""
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    voter = neighbour_votes.fit(docs.select("doc_id", "text"), labels)
    return neighbour_votes.score(docs, voter).filter("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten sources or more hold, unless they hold no others; n_chars follows the text."""
    left = line_spread.drop_spread_lines(docs, sites=10)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by sets of five words at 0.8: the one with the smallest id, then the lowest hash of the text.

    Rows are told apart by their contents, so texts that share an id are judged on their own, and a group without ids keeps a row
    too. Blank texts are like no other: each id keeps one of equal rows, and rows without an id stay. op6's four words at 85 %
    are that query's alone.
    """
    marks = ("_text", "_row")
    whole = F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"), whole.alias("_row"))
    rows = jaccard_regions.linked_rows(marked, width=5, percent=80, also=marks)
    # Equal rows fold to one in each task before they meet, and a group to its first row.
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", *marks)).alias("first")
    kept = rows.filter("n > 0").groupBy("component").agg(first).select(*[F.col(f"first.{m}") for m in marks])
    blank = rows.filter("n = 0 AND id IS NOT NULL").select(*marks).distinct()
    found = marked.dropDuplicates(list(marks)).join(stored(kept.union(blank), "kept"), list(marks), "left_semi").select(*COLUMNS)
    worded = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    return found.union(docs.filter(F.col("doc_id").isNull() & ~worded).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order."""
    return poisson_mix.mix(docs, SOURCE_WEIGHTS, seed=7).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    outputs = ("n_tokens", "ids", "decoded_sha256")
    return bpe_documents.encode_decode(docs.select("doc_id", "text"), vocabulary, outputs, keep=("doc_id",))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

# The classifier, the joins and the encoding can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
