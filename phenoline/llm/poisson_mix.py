"""Operator 10: mix sources to target weights by Poisson replication.

A source with target share w and n of all N documents is repeated w N / n times on average. Each document's count is
the Poisson quantile of a uniform number that a hash of the seed and its id gives, so a re-run task draws the same. Rows that share an id
or have none draw from the hash of the whole row and its number among equal rows besides, so all rows draw independently. Equal rows
are folded to a count for that, and numbered when they are laid out again, in chunks, so no key has to be in one task. Copies are
exploded and put in an order that another hash gives. Rates are a few numbers, one for each source named in the weights and one for
all others, and enter as literals: no join on the source, so a source with a third of all rows is no hot key.

Rates above 32 are drawn as a sum of independent parts of at most 32, so no probability underflows.

Defined results: sources not named, null among them, share the weight that is left, in their own proportions. Sources without documents are
ignored and the other shares scaled up. Other columns pass through; ``copy`` and ``position`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoline.llm.common import stored

PART = 32.0
CHUNK = 4096


def quantiles(rate: float) -> list[float]:
    """The distribution function of Poisson(rate) from 0 on, up to where it no longer grows."""
    p = total = math.exp(-rate)
    out, k = [total], 0
    while True:
        k += 1
        p = p * rate / k
        if total + p == total and k > rate:
            return out
        total += p
        out.append(total)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(2**52)


def rates(docs: DataFrame, weights: dict[str, float], source: str = "source") -> dict[str | None, float]:
    """Mean repetitions by named source; None stands for all others."""
    named = F.when(F.col(source).isin(*weights), F.col(source)) if weights else F.lit(None).cast("string")
    counts = {r["s"]: r["count"] for r in docs.groupBy(named.alias("s")).count().collect()}  # one row per named source, and one
    shares = {s: w for s, w in weights.items() if counts.get(s)}
    if counts.get(None):
        shares[None] = max(0.0, 1.0 - sum(weights.values()))
    total, whole = sum(counts.values()), sum(shares.values())
    return {s: w / whole * total / counts[s] if whole else 1.0 for s, w in shares.items()}


def numbered(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose id no other row has, and all others with _row (hash of the row) and _nth (its number among equal rows)."""
    again = stored(docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key), "again")
    once = docs.filter(F.col(key).isNotNull()).join(again, key, "left_anti").select(*docs.columns)
    rows = docs.join(again, key, "left_semi").select(*docs.columns).union(docs.filter(F.col(key).isNull()))
    whole = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    folded = rows.groupBy(*docs.columns).agg(F.count("*").alias("_n")).withColumn("_row", whole)
    chunks = folded.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))))
    dealt = chunks.repartition("_row", "_chunk")
    last = F.least(F.col("_n"), (F.col("_chunk") + 1) * CHUNK) - 1
    return once, dealt.withColumn("_nth", F.explode(F.sequence(F.col("_chunk") * CHUNK, last))).drop("_n", "_chunk")


def mix(docs: DataFrame, weights: dict[str, float], seed: int = 0, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Documents repeated to the target weights, with copy (int, from 0), in the order of position (double)."""
    rate = rates(docs, weights, source)
    docs = docs.drop("copy", "position")

    def copies(rows: DataFrame, *more: Column) -> DataFrame:
        def drawn(r: float) -> Column:
            parts = max(1, math.ceil(r / PART))
            table = F.array(*[F.lit(c) for c in quantiles(r / parts)])
            one = lambda j: F.size(F.filter(table, lambda c: c <= uniform(F.lit(seed), F.col(key), j, *more)))
            return one(F.lit(0)) if parts == 1 else F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0), lambda a, j: a + one(j))

        times = drawn(rate[None]) if rate.get(None) else F.lit(0)
        for name, r in rate.items():
            if name is not None:
                times = F.when(F.col(source) == name, drawn(r)).otherwise(times)
        made = rows.withColumn("_times", times).filter("_times > 0")
        made = made.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
        return made.select(*docs.columns, "copy", uniform(F.lit(f"{seed}-order"), F.col(key), F.col("copy"), *more).alias("position"))

    once, others = numbered(docs, key)
    return copies(once).union(copies(others, F.col("_row"), F.col("_nth"))).orderBy("position")
