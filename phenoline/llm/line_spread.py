"""Operator 2: line dedup by spread over distinct sites.

A HyperLogLog sketch of the sites that hold a line is kept per line hash; sketches of the parts of the table merge in the
aggregation, so a line of a third of all documents is one sketch per task before the shuffle. Lines whose estimate lies within
the sketch's error of the threshold get an exact distinct count; the rest are decided by the estimate. Lines of at least
``sites`` sites are boilerplate and leave their documents.

A document without any line of its own stays whole, as it would be emptied; that is for document dedup to judge. Blank lines never count. All
steps are DataFrame expressions, and linear in the lines of a text: nothing looks a line up by splitting the text again.

Defined results: a null text stays null with nothing removed; a null site is a site of its own. Lines are compared without the
spaces around them. Repeated rows are treated alike. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoline.llm.common import stored

LG_K = 12
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
BITS = 62  # lines that one number marks
SALTS = 8  # tasks that rows with the same text are dealt to


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashes(text: Column) -> Column:
    """Hash of each line; null for a blank one."""
    return F.transform(_lines(text), lambda line: F.when(F.trim(line) != "", F.xxhash64(F.trim(line))))


def spread_lines(docs: DataFrame, sites: int, text: str = "text", site: str = "source") -> DataFrame:
    """Hashes (line) of the lines that at least ``sites`` sites hold."""
    held = docs.select(F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit("")).alias("site"), F.explode(_hashes(F.col(text))).alias("line"))
    held = held.filter("line IS NOT NULL")
    guess = stored(
        held.groupBy("line")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"))
        .filter(F.col("about") >= int(sites * (1 - ERROR))),
        "spread",
    )
    sure = F.col("about") > sites * (1 + ERROR) + 1
    close = guess.filter(~sure).select("line")
    exact = held.join(close, "line", "left_semi").distinct().groupBy("line").count().filter(F.col("count") >= sites)
    return stored(guess.filter(sure).select("line").union(exact.select("line")), "boilerplate")


def drop_spread_lines(docs: DataFrame, sites: int = 10, text: str = "text", site: str = "source") -> DataFrame:
    """Replace ``text`` by what is left of it, and add n_removed (long)."""
    bad = spread_lines(docs, sites, text, site)
    # Rows with the same text have the same lines, so the text's hash names them.
    key = F.xxhash64(text).alias("_key")
    placed = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(_hashes(F.col(text))).alias("at", "line"))
    met = placed.join(bad.withColumn("bad", F.lit(True)), "line", "left")
    bit = F.when(F.col("bad"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % BITS)).otherwise(F.lit(0).cast("long"))
    own = F.max(F.col("line").isNotNull() & F.col("bad").isNull())
    # Marks of the lines that go, BITS lines to a number, in order and without a gap.
    marks = met.groupBy("_key", F.expr(f"at div {BITS}").alias("word")).agg(F.bit_or(bit).alias("bits"), own.alias("own"))
    whole = marks.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"), F.max("own").alias("own"), F.max(F.col("bits") != 0).alias("any"))
    hit = whole.filter("own AND any").select("_key", F.col("words.bits").alias("_gone"))
    # A text may stand in any share of the rows, and so may null.
    salted = hit.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.drop("n_removed", "_key", "_gone", "_salt").withColumns({"_key": F.xxhash64(text), "_salt": (F.monotonically_increasing_id() % SALTS).cast("int")})
    rows = rows.join(salted, ["_key", "_salt"], "left")
    kept = F.filter(_lines(F.col(text)), lambda line, i: F.call_function("getbit", F.get("_gone", F.floor(i / BITS).cast("int")), i % BITS) == 0)
    removed = F.aggregate("_gone", F.lit(0).cast("long"), lambda n, word: n + F.bit_count(word))
    return rows.select(
        *[F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else c for c in docs.columns if c != "n_removed"],
        F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
    )
