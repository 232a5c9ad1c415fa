"""Operator 6: exact join of documents by Jaccard similarity of word n-gram sets, by pivots, regions and windows.

Jaccard distance is a metric, so regions around pivots can be joined on their own if a document near a border is also given to
the regions beyond it. Documents as pivots don't part a corpus: two texts that are no copies share nothing, all
distances are 1, and the window of every document holds every region. So regions are made on two levels.

1. *Pivots of one shingle.* The distance of a set x to the pivot {s} is 1 - 1/|x| if s is in x, else 1: its nearest pivots are its own
   shingles, and a global order of the shingles breaks the tie. If x and y are linked, x has at most b = |x| - ceil(t |x|)
   shingles outside y, so among the first b + 1 shingles of x in that order is one of y, and the same holds for y: the first
   shingle they share is within both windows. So a document goes to the regions of its first b + 1 shingles, and no link is
   lost, whatever the order. The order puts shingles that only one document has first, and very common ones last: unique
   texts then stand in no region with others, and boilerplate makes no large regions. Only the shingles with the lowest hashes
   are counted, over all documents; the others come after them, in order of hash.
2. *Pivot documents.* Members of a region do lie near each other. Each region takes a pivot document. First each class meets one
   of its regions' pivots, the one that most of a group of copies share, so that such a group is settled with a link for each
   member, not one for each region of each member. Then the exact distances to the pivots of the regions left are computed; members within the radius r = 1 - t are linked to it. By the triangle inequality, a member at distance d > r
   can only be linked to others at distance d - r or more, so what goes on is the members beyond r and the window before
   them; a region whose members are all connected is settled, as large groups of copies are after one round. The rest is
   joined by pairs. What these rounds leave are families of texts that are alike but not linked; of
   those, pairs that aren't connected yet and whose sizes and bucket counts allow a link are compared, each in the first region both are
   in. Large regions are cut into blocks for that, and blocks are joined in pairs.

Equal sets are one class from the start, so copies never meet. Linked classes are joined to components by label propagation on
tables. Set sizes and distances are exact; shingles are 64-bit hashes.

Defined results: texts of fewer than ``width`` words have their whole word sequence as the only shingle; null, empty and blank texts
have none, and form components of their own. Repeated rows each get a row. A null id never names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoline.llm.common import stored, sub_columns, tidied
from phenoline.llm.text_numbers import Words, mixed

COUNTED = np.uint64(int(0.4 * 2**64))  # shingles with lower hashes are counted
COMMON = 32  # a shingle of more documents is put last
BLOCK = 1024
BUCKETS = 128
SHIFT = np.uint64(64 - 7)  # to the number of a bucket
SHIP = 1_000_000  # ids; up to 8 MB of them are broadcast, more are joined by a shuffle

_FACTOR = np.random.default_rng(6).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted different shingle hashes of each text."""
    words = Words(texts, lower=True)
    h = words.hash
    n = max(0, len(h) - width + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(width):
        grams += h[i : i + n] * _FACTOR[i]
    grams = mixed(grams)
    for a, k in zip(words.first[:-1].tolist(), words.count.tolist()):
        if k >= width:
            yield np.unique(grams[a : a + k - width + 1])
        elif k:
            short = (h[a : a + k] * _FACTOR[:k]).sum(dtype=np.uint64) + np.uint64(k)
            yield mixed(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _name(s: np.ndarray) -> int:
    """64 bits that name a set."""
    a = mixed(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(mixed(np.array([a ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def spare(n: int, percent: int) -> int:
    """How many shingles of a set of n may be missing from a linked one."""
    return n - -(-percent * n // 100)


def _front(s: np.ndarray, percent: int) -> np.ndarray:
    """The counted shingles, and as many more as the window may need."""
    low = int(np.searchsorted(s, COUNTED))
    return s[: max(low, min(len(s), spare(len(s), percent) + 1))]


def profiles(docs: DataFrame, width: int, percent: int, key: str, text: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, node (its set's name), n (set size), front; ``front`` only for the first of equal sets in a task.

    The long columns ``also`` pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start, part in sub_columns(batch.column(1), 1_000_000):
                nodes, sizes, fronts = [], [], []
                for s in shingle_sets(part, width):
                    node = _name(s)
                    new = node not in seen and len(s) > 0
                    if new and len(seen) < 200_000:
                        seen.add(node)
                    nodes.append(node)
                    sizes.append(len(s))
                    fronts.append(_front(s, percent).view(np.int64) if new else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(part)).cast(pa.int64()),
                        pa.array(nodes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(fronts, pa.list_(pa.int64())),
                        *[batch.column(c).slice(start, len(part)) for c in also],
                    ],
                    names=["id", "node", "n", "front", *also],
                )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *also)
    return rows.mapInArrow(tidied(run), ", ".join(["id long, node long, n long, front array<long>", *[f"{c} long" for c in also]]))


def _regions(members: DataFrame) -> DataFrame:
    """One region (region, node) of those that hold the same nodes, without those of one node."""
    sign = members.groupBy("s").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")
    )
    one = sign.filter("c > 1").groupBy("c", "a", "b").agg(F.min("s").alias("s"))
    return members.join(one.select("s"), "s").select(F.col("s").alias("region"), "node")


def windows(profile: DataFrame, percent: int) -> DataFrame:
    """(s, node, alone): the regions that each class goes to. ``alone``: how many shingles no other class has been seen with."""
    held = profile.filter("front IS NOT NULL").select("node", F.explode("front").alias("s"))
    shared = stored(held.groupBy("s").count().filter("count > 1").select("s", (F.col("count") > COMMON).alias("common")), "shared")
    classes = profile.filter("front IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"), F.max(F.size("front")).alias("m"))
    listed = held.join(shared, "s").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("common", "s"))).alias("mine"))
    alone = F.col("m") - F.size("mine")
    room = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - alone
    return (
        listed.join(classes, "node")
        .select("node", alone.alias("alone"), F.explode(F.slice("mine", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("x"))
        .select("x.s", "node", "alone")
    )


def bucket_counts(s: np.ndarray) -> np.ndarray:
    """Numbers of shingles in BUCKETS equal parts of the hashes. Cut at what two bytes hold, they still differ by no more than the sets do."""
    return np.minimum(np.bincount((s >> SHIFT).astype(np.int64), minlength=BUCKETS), 32767).astype(np.int16)


def _sets_of(docs: DataFrame, nodes: DataFrame, profile: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(node, shingles, counts) of the asked-for classes, read again from one document of each.

    ``counts`` are the numbers of shingles in BUCKETS equal parts of the hashes. The difference of two such vectors is at most
    the size of the sets' symmetric difference, so it rules pairs out.
    """
    asked = stored(profile.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")), "asked")
    ids = asked.filter("id IS NOT NULL").select(F.col("id").alias(key))
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    some = F.broadcast(ids) if asked.count() <= SHIP else ids
    named, nameless = rows.join(some, key, "left_semi"), rows.filter(F.col(key).isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in sub_columns(batch.column(1), 1_000_000):
                sets = list(shingle_sets(part, width))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_name(s) for s in sets], pa.int64()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([bucket_counts(s) for s in sets], pa.list_(pa.int16())),
                    ],
                    names=["node", "shingles", "counts"],
                )

    made = named.union(nameless).mapInArrow(tidied(run), "node long, shingles array<long>, counts array<smallint>")
    return stored(made.join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _measure(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with their exact distance d and whether they are linked."""
    near = pairs.join(sets.select(F.col("node").alias("a"), "shingles"), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("theirs")), "b")
    both = F.size(F.array_intersect("shingles", "theirs"))
    union = F.size("shingles") + F.size("theirs") - both
    return stored(near.select("a", "b", (1 - both / union).alias("d"), (100 * both >= percent * union).alias("linked")), "measured")


def _labelled(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Regions with the component of each member so far; regions of one component are settled."""
    if labels is None:
        return regions.withColumn("component", F.col("node"))
    known = regions.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = known.groupBy("region").agg((F.min("component") < F.max("component")).alias("open")).filter("open")
    return known.join(open_.select("region"), "region")


def _pivots(placed: DataFrame) -> DataFrame:
    """The member of each region with the fewest shingles of its own; the same one for most regions of a group of copies."""
    first = F.min(F.struct("alone", "node", "component", "n"))
    own = placed.groupBy("region").agg(first.alias("p"))
    return own.select("region", F.col("p.alone").alias("rest"), F.col("p.node").alias("pivot"), F.col("p.component").alias("theirs"), F.col("p.n").alias("size"))


def links_between(regions: DataFrame, sets: DataFrame, percent: int, facts: DataFrame, rounds: int = 1) -> DataFrame:
    """Links (a, b) that connect all linked classes that share a region. ``facts``: node, alone, n."""
    radius = 1 - percent / 100
    in_size = 100 * F.least("n", "size") >= percent * F.greatest("n", "size")
    placed = _labelled(regions, None).join(facts, "node")
    met = placed.join(_pivots(placed), "region").filter((F.col("node") != F.col("pivot")) & in_size)
    one = met.groupBy(F.col("node").alias("a")).agg(F.min(F.struct("rest", "pivot")).alias("p")).select("a", F.col("p.pivot").alias("b"))
    links = stored(_measure(one, sets, percent).filter("linked").select("a", "b"), "links")
    labels = components(links)
    for _ in range(rounds):
        placed = stored(_labelled(regions, labels).join(facts, "node"), "members")
        pivot = _pivots(placed).drop("rest")
        placed = stored(placed.join(pivot, "region").filter("node <> pivot"), "placed")
        # A set of another size than the window of sizes holds, or of the pivot's component, need not be measured.
        open_ = (F.col("component") != F.col("theirs")) & in_size
        measured = _measure(placed.filter(open_).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), sets, percent)
        found = measured.filter("linked").select("a", "b")
        links = stored(links.union(found), "links")
        labels = components(links)
        # On go the members beyond the radius, and those before it that are no nearer than its window. A member that wasn't
        # measured for its size has a distance of more than the radius; one of the pivot's component has any.
        # Written, as what follows reads it several times and its plan would grow with every use.
        seen = stored(placed.join(measured.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "d", "linked"), ["node", "pivot"], "left"), "seen")
        same = F.col("component") == F.col("theirs")
        beyond = ~same & ~F.coalesce("linked", F.lit(False))
        border = seen.filter(beyond).groupBy("region").agg((F.min(F.coalesce("d", F.lit(0.0))) - radius - 1e-9).alias("border"))
        left = seen.join(border, "region").filter(beyond | F.col("d").isNull() | (F.col("d") >= F.col("border")))
        left = stored(_labelled(stored(left.select("region", "node"), "left"), labels).select(F.col("region").alias("s"), "node"), "open")
        regions = stored(_regions(left), "rest")
    rest = stored(_labelled(regions, labels), "labelled").join(facts.select("node", "n"), "node").join(sets.select("node", "counts"), "node")
    # A pair is looked at in the first region that both are in, so each member knows the ones it was in before.
    mine = regions.groupBy("node").agg(F.collect_set("region").alias("mine"))
    size = regions.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = rest.join(mine, "node").join(size, "region").withColumn("before", F.filter("mine", lambda r: r < F.col("region")))
    cut = stored(cut.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).drop("mine"), "cut")
    # Large regions are cut into blocks. A member meets each block once: as the one with the lower or the higher number.
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    columns = ("region", "i", "j", "node", "component", "n", "counts", "before", "block")
    x = dealt.select(*[F.col(c).alias(f"{c}_x") for c in columns])
    y = dealt.select(*[F.col(c).alias(f"{c}_y") for c in columns])
    same = (F.col("region_x") == F.col("region_y")) & (F.col("i_x") == F.col("i_y")) & (F.col("j_x") == F.col("j_y"))
    once = (F.col("node_x") < F.col("node_y")) & ((F.col("i_x") == F.col("j_x")) | (F.col("block_x") != F.col("block_y")))
    sizes = 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")
    new = ~F.arrays_overlap("before_x", "before_y")
    differ = F.aggregate(F.zip_with("counts_x", "counts_y", lambda a, b: F.abs(a - b)), F.lit(0), lambda a, b: a + b)
    close = (100 + percent) * differ <= (100 - percent) * (F.col("n_x") + F.col("n_y"))
    pairs = x.join(y, same & once & (F.col("component_x") != F.col("component_y")) & sizes & new & close)
    measured = _measure(pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")), sets, percent)
    return links.union(measured.filter("linked").select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for all nodes with links. One written table a round."""
    both = stored(links.union(links.select("b", "a")).distinct(), "both")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("other"))
        nearer = labels.join(seen, "node").select("node", F.least("component", "other").alias("component"), F.col("component").alias("old"))
        # What the label itself is labelled with is smaller or the same.
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = stored(nearer.join(up, "component").select("node", F.least("component", "further").alias("component"), "old"), "labels")
        if after.filter("component <> old").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")


def linked_rows(docs: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, node, n, the columns ``also`` and component. The component follows from the text, whatever the ids are."""
    profile = stored(profiles(docs, width, percent, key, text, also), "profiles")
    window = stored(windows(profile, percent), "windows")
    regions = stored(_regions(window.select("s", "node")), "regions")
    nodes = regions.select("node").distinct()
    sets = _sets_of(docs, nodes, profile, width, key, text)
    sizes = profile.filter("front IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"))
    facts = stored(window.select("node", "alone").distinct().join(sizes, "node").join(nodes, "node"), "facts")
    found = components(links_between(regions, sets, percent, facts))
    return profile.select("id", "node", "n", *also).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def link_documents(docs: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its key, n_shingles, component_id (the smallest key that links reach).

    Two documents are linked when 100 * intersection >= percent * union.
    """
    rows = linked_rows(docs, width, percent, key, text)
    names = rows.filter("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    out = rows.join(names, "component", "left")
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
