"""Operator 12: near-duplicate vectors by sorted passes of random projections.

A pass gives every vector the signs of its products with 64 random directions, put together as one number, sorts all vectors by it and
compares each with the ``WINDOW`` next. Two vectors at angle w agree in a sign with probability 1 - w / pi, and n vectors fall apart
into about n / WINDOW windows after log2(n / WINDOW) signs, which gives the chance of one pass to bring a pair at the threshold together; there
are as many passes as take such a pair's chance to ``RECALL``. Nearer pairs are found more surely. Found pairs are verified in double
precision; components of the verified pairs of all passes are the groups.

Windows are bounded, so in a group denser than a window not every pair is looked at, though neighbours in the order connect it. So the links
of each group are counted once more, exactly. Groups of up to ``CHUNK`` vectors are compared as a whole. In larger ones, each vector's angle to the
group's centre settles most pairs by the triangle inequality: two whose angles add up to no more than the threshold are linked, two whose
angles differ by more are not, and both are counted from a histogram of angles. Only the pairs between those bounds are compared, blocks
against blocks, and counted, not listed. No pair is capped, and a tight group of any size costs a histogram.

Equal vectors are one class from the start. Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components link with nothing and are components of their own. Repeated ids are separate vectors. A null id never names a component, unless
no row of it has an id, and isn't kept. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenoline.llm.common import numbered, stored
from phenoline.llm.jaccard_regions import components

WINDOW = 128
CHUNK = 1024
SIGNS = 64
RECALL = 0.99
RINGS = 4096
SLACK = 1e-9


def number_of_passes(n: int, cosine: float) -> int:
    agree = 1 - math.acos(cosine) / math.pi
    met = agree ** max(0.0, math.log2(max(n, 1) / WINDOW))
    return 1 if met >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - met))


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of unit vectors reach the cosine; those next to the threshold are summed exactly."""
    near = x @ y.T
    out = near >= cosine
    for i, j in zip(*np.nonzero(np.abs(near - cosine) < SLACK)):
        length = math.sqrt(math.fsum(x[i] * x[i]) * math.fsum(y[j] * y[j]))
        out[i, j] = math.fsum(x[i] * y[j]) / length >= cosine
    return out


def _vectors(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, str]:
    """(vec_id, name, x): ``x`` as bytes and ``name`` its digest, null for what takes no part; and the number format of ``x``."""
    narrow = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind, number = ("<f4", "float") if narrow else ("<f8", "double")
    v = F.col(vector).cast(f"array<{number}>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(fit, v).alias("v"))
    size = rows.filter("v IS NOT NULL").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.select("vec_id", F.when(F.size("v") == (size["size"] if size else 0), F.col("v")).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Adding zero makes -0 a 0, so equal vectors have equal bytes.
            raw = [None if v is None else (np.array(v, kind) + np.array(0, kind)).tobytes() for v in batch.column(1).to_pylist()]
            names = [None if r is None else hashlib.md5(r, usedforsecurity=False).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "name", "x"])

    return stored(rows.mapInArrow(pack, "vec_id long, name binary, x binary"), "vectors"), kind


def found_links(classes: DataFrame, kind: str, n: int, cosine: float, seed: int) -> DataFrame:
    """(a, b): links that connect all pairs found within the windows of all passes."""
    passes = number_of_passes(n, cosine)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(batch.column(1).to_pylist(), kind)
            for i in range(passes):
                signs = x @ np.random.default_rng([seed, i]).standard_normal((x.shape[1], SIGNS)) >= 0
                place = np.packbits(signs, axis=1).view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(place.view(np.int64)), batch.column(0)], names=["tree", "place", "name"])

    ranked = numbered(classes.select("name", "x").mapInArrow(order, "tree int, place long, name binary"), ["place", "name"])
    # A chunk is compared with the window behind it, so a vector at a chunk's start is also the end of the one before.
    chunks = F.array_distinct(F.array(F.expr(f"idx div {CHUNK}"), F.expr(f"greatest(idx - {WINDOW}, 0) div {CHUNK}")))
    spots = ranked.select("name", F.col("tree").alias("run"), "idx", F.explode(chunks).alias("chunk"))

    def compare(table: pa.Table) -> pa.Table:
        at = table.column("idx").to_numpy()
        by = np.argsort(at)
        names = table.column("name").take(pa.array(by)).combine_chunks()
        x = units(table.column("x").take(pa.array(by)).to_pylist(), kind)
        left, right = [], []
        for i in range(0, min(len(x), CHUNK), WINDOW):
            mine, theirs = x[i : min(i + WINDOW, CHUNK)], x[i : i + 2 * WINDOW]
            p, q = np.nonzero(linked(mine, theirs, cosine))
            keep = (q > p) & (q - p <= WINDOW)
            left.append(p[keep] + i)
            right.append(q[keep] + i)
        root = roots(len(x), np.concatenate(left), np.concatenate(right))
        far = np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": names.take(pa.array(far)), "b": names.take(pa.array(root[far]))})

    near = spots.join(classes.select("name", "x"), "name")
    return stored(near.groupBy("run", "chunk").applyInArrow(compare, "a binary, b binary"), "links")


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first row that links reach, for each of n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _small(members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(name, n): links of each class in groups that are compared as a whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group; the last group of a batch may go on in the next."""
        rest = None

        def counted(table: pa.Table) -> pa.RecordBatch:
            group, weight = table.column("component").to_pylist(), table.column("m").to_numpy()
            x = units(table.column("x").to_pylist(), kind)
            starts = [i for i in range(len(group)) if not i or group[i] != group[i - 1]]
            n = np.empty(len(group), np.int64)
            for a, b in zip(starts, [*starts[1:], len(group)]):
                near = linked(x[a:b], x[a:b], cosine)
                np.fill_diagonal(near, True)
                n[a:b] = near @ weight[a:b] - 1
            return pa.RecordBatch.from_arrays([table.column("name").combine_chunks(), pa.array(n)], names=["name", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*([rest] if rest is not None else []), pa.Table.from_batches([batch])])
            group = table.column("component").to_pylist()
            cut = len(group) - 1
            while cut and group[cut - 1] == group[-1]:
                cut -= 1
            if cut:
                yield counted(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield counted(rest)

    by_group = members.select("component", "name", "m", "x").repartition("component").sortWithinPartitions("component")
    return by_group.mapInArrow(count, "name binary, n long")


def _large(members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(name, n) for groups of any size: by angles to the centre, and by comparing the pairs that those leave open."""
    width = math.pi / RINGS
    # Rings i and j hold angles below (i + 1) and (j + 1) widths.
    sure = math.floor((math.acos(cosine) - 1e-6) / width) - 2
    apart = math.ceil((math.acos(cosine) + 1e-6) / width) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, inverse = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            if not len(group):
                continue
            x = units(batch.column(1).to_pylist(), kind)
            total = np.zeros((len(group), x.shape[1]))
            np.add.at(total, inverse, x)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.binary()), pa.array(list(total), pa.list_(pa.float64()))], names=["component", "total"])

    parts = members.select("component", "x").mapInArrow(add, "component binary, total array<double>")
    summed = parts.select("component", F.posexplode("total").alias("i", "t")).groupBy("component", "i").agg(F.sum("t").alias("t"))
    centre = summed.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]).alias("centre"))

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(batch.column("x").to_pylist(), kind)
            c = np.array(batch.column("centre").to_pylist())
            c = c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-300)
            # A sum of 0 is no direction; any fixed one bounds the angles as well.
            c[~(np.abs((c * c).sum(1) - 1) < 0.5)] = np.eye(1, c.shape[1])
            # From the chord, which is exact for small angles too.
            chord = np.sqrt(((x - c) ** 2).sum(1))
            at = np.minimum(2 * np.arcsin(np.minimum(chord / 2, 1)) / width, RINGS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("component", "name", "m", "x")] + [pa.array(at)], names=["component", "name", "m", "x", "ring"])

    dealt = members.select("component", "name", "m", "x").join(stored(centre, "centres"), "component")
    dealt = stored(dealt.mapInArrow(ring, "component binary, name binary, m long, x binary, ring int"), "rings")
    held = dealt.groupBy("component", "ring").agg(F.sum("m").alias("weight"), F.count("*").alias("n"))
    spread = held.groupBy("component").agg(F.collect_list(F.struct("ring", "weight", "n")).alias("all"), F.max("ring").alias("last"))
    # Whoever might make an open pair with the outermost ring is dealt to blocks.
    opens = F.aggregate(F.filter("all", lambda s: s["ring"] + F.col("last") > sure), F.lit(0).cast("long"), lambda n, s: n + s["n"])
    spread = spread.withColumn("blocks", F.ceil(opens / CHUNK).cast("int"))
    inside = F.aggregate(F.filter("all", lambda s: s["ring"] + F.col("ring") <= sure), F.lit(0).cast("long"), lambda n, s: n + s["weight"])
    rings = stored(held.select("component", "ring").join(spread, "component").select("component", "ring", inside.alias("inside"), "last", "blocks"), "inside")
    known = dealt.join(rings, ["component", "ring"])
    # A class that is itself within the sure rings has counted itself.
    certain = known.select("name", (F.col("inside") + F.when(2 * F.col("ring") <= sure, -1).otherwise(F.col("m") - 1)).alias("n"))
    ask = known.filter(F.col("ring") + F.col("last") > sure).withColumn("block", F.pmod(F.xxhash64("name"), "blocks").cast("int"))
    ask = ask.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ask = ask.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", "m", "x", "ring")

    def compare(table: pa.Table) -> pa.Table:
        low, high = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, at = table.column("block").to_numpy(), table.column("ring").to_numpy().astype(np.int64)
        weight, x = table.column("m").to_numpy(), units(table.column("x").to_pylist(), kind)
        n = np.zeros(len(x), np.int64)
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for start in range(0, len(one), CHUNK):
            part = one[start : start + CHUNK]
            both = linked(x[part], x[two], cosine)
            both &= at[part][:, None] + at[two][None, :] > sure
            both &= np.abs(at[part][:, None] - at[two][None, :]) < apart
            both &= part[:, None] != two[None, :]
            n[part] += both @ weight[two]
            if low < high:
                n[two] += weight[part] @ both
        return pa.table({"name": table.column("name"), "n": n})

    counted = ask.groupBy("component", "i", "j").applyInArrow(compare, "name binary, n long")
    return certain.union(counted).groupBy("name").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding", seed: int = 12) -> DataFrame:
    """Per vector: its key, n_links (other vectors that it reaches the cosine with), component_id, kept (it names its component)."""
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    rows, kind = _vectors(vectors, key, vector)
    fit = rows.filter("name IS NOT NULL")
    classes = stored(fit.groupBy("name").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("x").alias("x")), "classes")
    n = classes.count()
    labels = components(found_links(classes, kind, n, cosine, seed))
    sizes = labels.groupBy("component").agg((F.count("*") > CHUNK).alias("large"))
    members = stored(labels.join(stored(sizes, "sizes"), "component").join(classes.withColumnRenamed("name", "node"), "node").withColumnRenamed("node", "name"), "members")
    counts = _small(members.filter("NOT large"), kind, cosine).union(_large(members.filter("large"), kind, cosine))
    names = members.groupBy("component").agg(F.min("id").alias("component_id"))
    grouped = members.select("component", "name").join(names, "component").select("name", "component_id").join(counts, "name")
    facts = classes.select("name", "id", "m").join(grouped, "name", "left")
    facts = facts.select("name", F.coalesce("n", F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = fit.select("vec_id", "name").join(stored(facts, "facts"), "name").select("vec_id", "n_links", "component_id")
    alone = rows.filter("name IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).select(F.col("vec_id").alias(key), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
