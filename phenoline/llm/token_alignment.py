"""Operator 11: align the tokens of two tokenizers over every document, and weigh their links by counts over the corpus.

1. Texts are encoded (`fragments.TokenPair`). Texts of more than ``CHUNK`` bytes are first cut into pieces that can be encoded by themselves,
   and the pieces spread over tasks. Tokens are then cut by byte ranges of ``CHUNK`` into fragments: open prefix, closed groups, open suffix.
2. The open parts of a document's fragments are composed by a tree reduction, ``FAN`` neighbours to a task; each level is a written table. Every
   bridge that closes on the way is a closed group, placed before the closed groups of the fragment that it ends in. A document that is one
   fragment needs none of this.
3. Closed tokens lie in blocks of ``BLOCK`` bytes of text. Each block's different id pairs are counted and the counts added up over the corpus; the
   counts of just its own pairs come back to each block by a join, and meet its tokens there. So a task holds one block and its pairs, and works
   on slices of ``SLICE`` tokens.
4. The digest of a document of several fragments is taken by one task that streams through its closed groups in order, as SHA-256 can't be
   composed; only one row is in memory.

Defined results: null and empty texts, and those whose token bytes differ from a space and the text, have no tokens: zeros and an empty digest.
Repeated rows and rows without an id each get a row and each count. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenoline.llm.common import stored, sub_batches
from phenoline.llm.fragments import EMPTY, NO_IDS, Aligned, Fragment, compose, fragments, joined, token_pair

CHUNK = 1 << 16
BLOCK = 1 << 22
SLICE = 1 << 19
FAN = 16

OPEN = "prefix_a binary, prefix_b binary, suffix_a binary, suffix_b binary"
PLACED = "row long, block long, place long, part int, cut boolean"
TOKENS = f"{PLACED}, key long, whole boolean, ok boolean, a binary, b binary, {OPEN}"
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(ids: np.ndarray) -> bytes:
    width = 4 if len(ids) and ids.max() >= 1 << 16 else 2
    return _ZIP.compress(ids.astype(f"<u{width}").tobytes()) + bytes([width])


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(_UNZIP.decompress(raw[:-1]), f"<u{raw[-1]}").astype(np.uint32)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _pieces(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(row, key, at, text): texts longer than a chunk as pieces, dealt over the tasks. ``at``: bytes of the whole text before the piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(a_path, b_path)
        for batch in batches:
            for row, key, text in zip(*(batch.column(i) for i in range(3))):
                at = 0
                for _, piece in pair.pieces(text.as_py(), CHUNK):
                    yield pa.RecordBatch.from_pydict({"row": [row.as_py()], "key": [key.as_py()], "at": [at], "text": [piece]}, schema=schema)
                    at += len(piece.encode()) + 1

    schema = _arrow("row long, key long, at long, text string")
    return docs.mapInArrow(cut, "row long, key long, at long, text string").repartition("row", "at")


def tokens(docs: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """Rows of ``TOKENS``: a row for each fragment, and for each text that is whole in one."""
    number = F.monotonically_increasing_id()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > CHUNK, F.lit(False))
    short = rows.filter(~long).select((2 * number).alias("row"), "key", F.lit(None).cast("long").alias("at"), "text")
    cut = _pieces(rows.filter(long).select((2 * number + 1).alias("row"), "key", "text"), a_path, b_path)
    schema = _arrow(TOKENS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(a_path, b_path)
        block, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for first, part in sub_batches(batch.column(3).to_pylist(), 1_000_000):
                keys, numbers, starts = (batch.column(i).slice(first, len(part)).to_pylist() for i in (1, 0, 2))
                out: list[dict] = []
                made = iter(pair.encode([t for t in part if t]))
                for row, key_, at, t in zip(numbers, keys, starts, part):
                    a, b, ok = next(made) if t else (NO_IDS, NO_IDS, False)
                    if not ok:
                        a, b = NO_IDS, NO_IDS
                    same = {"row": row, "key": key_, "block": block, "whole": at is None, "ok": ok}
                    if at is None or not ok:
                        out.append(same | {"place": at or 0, "part": 1, "cut": False, "a": packed(a), "b": packed(b)})
                    else:
                        for k, f in fragments(a, b, pair.a_len, pair.b_len, at, CHUNK):
                            closed = f.groups[0] if f.groups else (NO_IDS, NO_IDS)
                            out.append(same | {"place": max(at, k * CHUNK), "part": 1, "cut": f.cut, "a": packed(closed[0]), "b": packed(closed[1])} | _open(f))
                    size += len(t) if t else 0
                    if size >= BLOCK:
                        block, size = block + 1, 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return short.union(cut).mapInArrow(encode, TOKENS)


def _open(f: Fragment) -> dict:
    return {"prefix_a": packed(f.prefix[0]), "prefix_b": packed(f.prefix[1]), "suffix_a": packed(f.suffix[0]), "suffix_b": packed(f.suffix[1])}


def bridges(open_parts: DataFrame) -> DataFrame:
    """(row, block, place, part 0, a, b): the groups that reach over borders of fragments, by a tree reduction.

    ``open_parts``: row, block, place, cut and the columns of ``OPEN``, of all fragments of whole documents. ``place`` and ``block`` of a composed fragment
    are those of its first fragment with a cut, where an open suffix before it would close.
    """
    result = f"{PLACED}, node long, a binary, b binary, {OPEN}"
    schema = _arrow(result)

    def reduce(table: pa.Table) -> pa.Table:
        out, whole = [], EMPTY
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        home = None
        for r in rows:
            f = Fragment(r["cut"], (unpacked(r["prefix_a"]), unpacked(r["prefix_b"])), (), (unpacked(r["suffix_a"]), unpacked(r["suffix_b"])))
            both = compose(whole, f)
            if both.groups:
                (a, b), = both.groups
                out.append({"row": r["row"], "block": r["home"], "place": r["first"], "part": 0, "cut": True, "a": packed(a), "b": packed(b)})
                both = Fragment(True, both.prefix, (), both.suffix)
            if home is None and f.cut:
                home = {"block": r["home"], "place": r["first"]}
            whole = both
        first = rows[0]
        out.append({"row": first["row"], "part": 1, "cut": whole.cut, "node": first["node"]} | (home or {"block": first["home"], "place": first["first"]}) | _open(whole))
        return pa.Table.from_pylist(out, schema=schema)

    def level(fragments_: DataFrame) -> DataFrame:
        return stored(fragments_.groupBy("row", "node").applyInArrow(reduce, result), "bridges")

    opened = [c.split()[0] for c in OPEN.split(", ")]
    columns = ["row", "node", "place", "cut", F.col("block").alias("home"), F.col("place").alias("first"), *opened]
    most = open_parts.agg(F.max("place")).first()[0]
    if most is None:
        return open_parts.select("row", "block", "place", F.lit(0).alias("part"), F.col("prefix_a").alias("a"), F.col("prefix_b").alias("b")).limit(0)
    nodes, found = open_parts.withColumn("node", F.expr(f"place div {CHUNK * FAN}")), None
    most = most // (CHUNK * FAN)
    while True:
        done = level(nodes.select(*columns))
        closed = done.filter("part = 0").select("row", "block", "place", "part", "a", "b")
        found = closed if found is None else found.union(closed)
        left = done.filter("part = 1")
        if not most:
            # What a document begins with is a closed group too.
            return found.union(left.select("row", "block", "place", F.lit(0).alias("part"), F.col("prefix_a").alias("a"), F.col("prefix_b").alias("b")))
        nodes, most = left.withColumn("node", F.expr(f"node div {FAN}")), most // FAN


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    made = stored(tokens(docs, a_path, b_path, key, text), "tokens")
    # Documents of several fragments all of whose pieces have the bytes of the text.
    bad = made.filter("NOT whole AND NOT ok").select("row").distinct()
    split = made.filter("NOT whole AND ok").join(bad, "row", "left_anti")
    spread = stored(split, "split")
    bridge = bridges(spread)
    columns = ["row", "block", "place", "part", "whole", "a", "b"]
    parts = spread.select(*columns).union(bridge.withColumn("whole", F.lit(False)).select(*columns))
    closed = made.filter("whole AND ok").select(*columns).union(parts)

    a_len, b_len = (lambda p: (p.a_len, p.b_len))(token_pair(a_path, b_path))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different pairs of each block, with their numbers; a block that is read in parts gives several rows a pair."""
        block, a, b, n = None, [], [], 0
        seen = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def counted() -> tuple[np.ndarray, np.ndarray]:
            one, two, _ = Aligned(np.concatenate(a), np.concatenate(b), a_len, b_len).pairs()
            pairs, times = np.unique(np.concatenate([one, two]), return_counts=True)
            both, at = np.unique(np.concatenate([seen[0], pairs]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([seen[1], times]))
            return both, total

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(seen[0]), block)), pa.array(seen[0]), pa.array(seen[1])], names=["block", "pair", "times"])

        for batch in batches:
            for number, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if a and (number != block or n > SLICE):
                    seen = counted()
                    a, b, n = [], [], 0
                if number != block:
                    if len(seen[0]):
                        yield out()
                    block, seen = number, (np.zeros(0, np.int64), np.zeros(0, np.int64))
                a.append(unpacked(x.as_py()))
                b.append(unpacked(y.as_py()))
                n += len(a[-1]) + len(b[-1])
        if a:
            seen = counted()
        if len(seen[0]):
            yield out()

    pairs = stored(closed.select("block", "a", "b").mapInArrow(held, "block long, pair long, times long"), "held")
    counts = pairs.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    counts = stored(counts, "counts")
    top = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    counts = counts.join(top, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    looked = pairs.select("block", "pair").join(counts, "pair")

    weighed = "row long, whole boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string"
    schema = _arrow(weighed)

    def weigh(mine: pa.Table, known: pa.Table) -> pa.Table:
        pair, at = np.unique(known.column("pair").to_numpy(), return_index=True)
        n, best = known.column("n").to_numpy()[at], known.column("best").to_numpy(zero_copy_only=False)[at]
        made, first, size = [], 0, 0
        a, b = [], []
        for i in range(mine.num_rows):
            a.append(unpacked(mine.column("a")[i].as_py()))
            b.append(unpacked(mine.column("b")[i].as_py()))
            size += len(a[-1]) + len(b[-1])
            if size > SLICE or i == mine.num_rows - 1:
                made.append(part(mine.slice(first, i + 1 - first), a, b, pair, n, best))
                a, b, first, size = [], [], i + 1, 0
        return pa.concat_tables(made) if made else schema.empty_table()

    def part(rows: pa.Table, a: list, b: list, pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> pa.Table:
        off_a, off_b = np.cumsum([0, *map(len, a)]), np.cumsum([0, *map(len, b)])
        both = Aligned(np.concatenate(a), np.concatenate(b), a_len, b_len)
        one, two, at_b = both.pairs()
        one, two = np.searchsorted(pair, one), np.searchsorted(pair, two)

        def by_row(of_a: np.ndarray, of_open: np.ndarray) -> np.ndarray:
            of_b = np.zeros(len(both.b), np.int64)
            of_b[at_b] = of_open
            sum_a, sum_b = np.concatenate([[0], np.cumsum(of_a, dtype=np.int64)]), np.concatenate([[0], np.cumsum(of_b)])
            return sum_a[off_a[1:]] - sum_a[off_a[:-1]] + sum_b[off_b[1:]] - sum_b[off_b[:-1]]

        closes = np.concatenate([[0], np.cumsum(both.closes_a)])
        text, ends = both.text()
        ends = np.concatenate([[0], ends])
        digests = []
        for whole, low, high in zip(rows.column("whole").to_pylist(), ends[off_b[:-1]].tolist(), ends[off_b[1:]].tolist()):
            digests.append(hashlib.sha256(memoryview(text)[low : high - 1]).hexdigest() if whole else None)
        made = [np.diff(off_a), np.diff(off_b), closes[off_a[1:]] - closes[off_a[:-1]]]
        made += [by_row(np.ones(len(one), np.int64), np.ones(len(two), np.int64)), by_row(best[one], best[two]), by_row(n[one], n[two])]
        columns = [rows.column("row").combine_chunks(), rows.column("whole").combine_chunks(), *map(pa.array, made), pa.array(digests, pa.string())]
        return pa.Table.from_arrays(columns, schema=schema)

    measured = closed.select("block", "row", "whole", "a", "b").groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(weigh, weighed)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by document and in order."""
        row, state, names = None, None, ["row", "digest"]
        for batch in batches:
            for number, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                a, b = unpacked(x.as_py()), unpacked(y.as_py())
                if number != row:
                    if row is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([state.hexdigest()])], names=names)
                    row, state, between = number, hashlib.sha256(), b""
                if len(a):
                    text, _ = Aligned(a, b, a_len, b_len).text()
                    state.update(between)
                    state.update(memoryview(text)[:-1])
                    between = b";"
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([state.hexdigest()])], names=names)

    ordered = parts.select("row", "a", "b", "place", "part").repartition("row").sortWithinPartitions("row", "place", "part")
    long = ordered.select("row", "a", "b").mapInArrow(digest, "row long, digest string")

    nothing = [F.lit(0).cast("long").alias(c) for c in COUNTS]
    none = F.lit(None).cast("string").alias("digest")
    every = made.select("row", F.col("key"), *nothing, none)
    found = measured.select("row", F.lit(None).cast("long").alias("key"), *COUNTS, "digest")
    digests = long.select("row", F.lit(None).cast("long").alias("key"), *nothing, "digest")
    out = every.union(found).union(digests).groupBy("row").agg(F.max("key").alias(key), *[F.sum(c).alias(c) for c in COUNTS], F.coalesce(F.max("digest"), F.lit("")).alias("groups_sha256"))
    return out.select(key, *COUNTS, "groups_sha256")
