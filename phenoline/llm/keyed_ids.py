"""Operator 3: token ids in binary shards, with a minimal perfect hash index for access by document key.

A store is a folder of files. Documents are in ascending key order, cut into parts, which tasks write, and those into shards of at most
``rows_per_shard`` documents.

- ``ids-*.bin``, one a shard: a header of 16 bytes (``PLID``, bytes per id as u32, part as u64), then the raw little-endian ids
  of its documents, each ended by id 0. Ids take two bytes where the vocabulary allows it.
- ``index-*.npz``, one a shard: a minimal perfect hash of the shard's keys (levels of bit arrays; a key's slot is the rank of its bit) and
  by slot a stored fingerprint, the first copy's place and the number of copies; besides the length of every document.
- ``list-*.npz``, one a part: first and last key of its shards, and how many ids stand before each.

Which part holds a key follows from the bounds of the parts, which the driver holds with the names of the lists; there are at most ``most_parts``,
while the shards of a part grow in number, not in size. A lookup touches one bit per level, one rank, one slot and one range of bytes, however
large the store is. Tasks hold one shard's index at a time, in writing and in reading.

Files are named by a random id and listed only by the attempt that succeeded, so retried tasks leave no wrong data. Paths
are opened through Arrow's file systems, so the folder may be any shared store that it knows.

Defined results: null text is an empty document (its ids are the end id alone). Documents without a key come first, in parts of their own, and
are found by the null key. Copies of a key stand side by side, ordered by their ids; a key with very many copies spreads over
several parts and shards, each of which indexes its part. An empty table makes an empty store. Other columns are ignored.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoline.llm.bpe import codec
from phenoline.llm.common import sub_batches, tidied

MAGIC, HEADER = b"PLID", 16
WINDOW = 2 << 20
TOGETHER = 6_000_000  # characters that are encoded at once; chunks that several texts share are looked up once


# The hash


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit keys, another one for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of different 64-bit keys.

    A key takes the bit it hashes to on the first level where no other open key does; its slot is the number of bits set
    before that one. Keys that aren't in the set get some slot or -1: compare the fingerprint.
    """

    GAMMA = 2

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.int64), words
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, open_ = [], [], keys
        while len(open_):
            size = max(64, -(-cls.GAMMA * len(open_) // 64) * 64)
            at = (_mixed(open_, len(sizes)) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(once)
            open_ = open_[~once[at]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little").view("<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.starts[level] + (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


# The store


@dataclass(frozen=True)
class Store:
    """Where the parts are. ``names``: by part the name in its files or None if no document fell there; ``starts``: ids before it.

    The first ``null_parts`` hold the documents without a key; the others are parted by ``bounds``.
    """

    root: str
    bounds: tuple[int, ...]
    null_parts: int
    names: tuple[str | None, ...]
    starts: tuple[int, ...]
    id_bytes: int


def _open(root: str):
    return arrow_fs.FileSystem.from_uri(root)


def part_range(keys: pa.Array, bounds: np.ndarray, null_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last part that may hold each key; they differ for a key that is itself several bounds, and for null."""
    value = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    null = np.asarray(keys.is_null())
    low, high = (null_parts + np.searchsorted(bounds, value, side) for side in ("left", "right"))
    return np.where(null, 0, low), np.where(null, max(null_parts, 1) - 1, high)


def write_store(
    docs: DataFrame,
    root: str,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    rows_per_shard: int = 8192,
    most_parts: int = 16384,
) -> Store:
    """Encode all texts and write the store below ``root``, a new folder that all executors share.

    A part is one shard until there are ``most_parts``, which bounds what the driver holds; from there on parts have more shards. Bounds are
    approximate quantiles of the keys.
    """
    counts = docs.select(F.count(key).alias("keyed"), F.count("*").alias("n")).first()
    n_keyed, n_null = counts["keyed"], counts["n"] - counts["keyed"]
    rows = max(rows_per_shard, -(-counts["n"] // max(1, most_parts - 2)))
    n_parts, null_parts = max(1, -(-n_keyed // rows)), -(-n_null // rows)
    bounds: tuple[int, ...] = ()
    if n_parts > 1:
        shares = [i / n_parts for i in range(1, n_parts)]
        found = docs.select(F.approx_percentile(key, shares, max(10_000, 20 * n_parts)).alias("b")).first()["b"]
        bounds = tuple(int(b) for b in found)
    id_type = "<u2" if max(codec(vocabulary, "<u2").table.text_of) < 1 << 16 else "<u4"
    width = np.dtype(id_type).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, cuts = codec(vocabulary, id_type), np.array(bounds, np.int64)
        end = bytes(width)
        for batch in batches:
            for start, texts in sub_batches(batch.column(1).to_pylist(), TOGETHER):
                ids = [x + end for x, _ in machine.encode(texts)]
                keys = batch.column(0).slice(start, len(texts))
                low, high = part_range(keys, cuts, null_parts)
                # Copies of a bound, and documents without a key, spread by their ids.
                spread = np.array([zlib.crc32(x) for x in ids], np.int64) % (high - low + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low + spread, pa.int32()), keys.cast(pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "key", "ids"],
                )

    dealt = (
        docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(tidied(encode), "part int, key long, ids binary")
        .repartitionById(null_parts + n_parts, F.col("part"))
        .sortWithinPartitions("part", "key", "ids")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec.cache_clear()  # of an encoding task before
        system, folder = _open(root)
        out, name, part = None, uuid.uuid4().hex, None
        keys, sizes, listed, total = [], [], [], 0

        def end_shard() -> None:
            key_, size = pa.concat_arrays(keys), np.concatenate(sizes)
            out.close()
            _write_index(system, f"{folder}/index-{part:06d}-{len(listed)}-{name}.npz", key_, size)
            known = key_.drop_null()
            listed.append((len(key_) - len(known), len(known), known[0].as_py() if len(known) else 0, known[-1].as_py() if len(known) else 0, total))

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if out is None:
                    part = batch.column(0)[at].as_py()
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/ids-{part:06d}-{len(listed)}-{name}.bin")
                    out.write(MAGIC + np.uint32(width).tobytes() + np.uint64(part).tobytes())
                take = batch.slice(at, rows_per_shard - sum(map(len, keys)))
                column = take.column(2)
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                out.write(memoryview(column.buffers()[2])[offsets[0] : offsets[-1]])
                sizes.append(np.diff(offsets).astype(np.int64) // width)
                keys.append(take.column(1))
                at += take.num_rows
                if sum(map(len, keys)) == rows_per_shard:
                    end_shard()
                    total += int(sum(s.sum() for s in sizes))
                    out, keys, sizes = None, [], []
        if out is not None:
            end_shard()
            total += int(sum(s.sum() for s in sizes))
        if part is None:
            return
        blob = io.BytesIO()
        np.savez(blob, **dict(zip(("nulls", "known", "first", "last", "start"), np.array(listed, np.int64).T)))
        with system.open_output_stream(f"{folder}/list-{part:06d}-{name}.npz") as f:
            f.write(blob.getvalue())
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "name": [name], "n_ids": [total]}, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_ids", pa.int64())])
        )

    made = {r["part"]: r for r in dealt.mapInArrow(tidied(write), "part int, name string, n_ids long").collect()}
    names, starts, total = [], [], 0
    for part in range(null_parts + n_parts):
        row = made.get(part)
        names.append(row["name"] if row else None)
        starts.append(total)
        total += row["n_ids"] if row else 0
    return Store(root, bounds, null_parts, tuple(names), tuple(starts), width)


def _write_index(system, path: str, keys: pa.Array, size: np.ndarray) -> None:
    """The index of a shard's documents, ``keys`` in order with nulls first, ``size`` in ids."""
    offset = np.cumsum(size) - size
    nulls = keys.null_count
    different, first, copies = np.unique(keys.drop_null().to_numpy(), return_index=True, return_counts=True)
    first = first + nulls
    hashed = PerfectHash.build(different)
    by_slot = np.empty(len(different), np.int64)
    by_slot[hashed.slots(different)] = np.arange(len(different))
    blob = io.BytesIO()
    np.savez(
        blob,
        levels=hashed.sizes,
        words=hashed.words,
        fingerprint=fingerprints(different)[by_slot],
        first=first[by_slot],
        offset=offset[first][by_slot],
        copies=copies[by_slot],
        lengths=size,
        null_copies=np.array(nulls),
    )
    with system.open_output_stream(path) as f:
        f.write(blob.getvalue())


def find(spark: SparkSession, store: Store, keys: DataFrame, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Look keys up. ``keys`` has one column; each different key gives a row for each of its copies, unknown keys give none.

    Rows: key, copy int (from 0 within a shard), start long (ids before it in the whole store), n_tokens long, and as asked for
    ids array<int> and ids_crc32 long, of the ids as little-endian unsigned 32-bit integers.
    """
    name = keys.columns[0]
    bounds, null_parts, names, starts = np.array(store.bounds, np.int64), store.null_parts, store.names, store.starts
    id_type, root = np.dtype(f"<u{store.id_bytes}"), store.root

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            low, high = part_range(column, bounds, null_parts)
            times = high - low + 1
            row = np.repeat(np.arange(len(column)), times)
            part = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), column.take(pa.array(row)).cast(pa.int64())], names=["part", "key"]
            )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec.cache_clear()  # of an encoding task before
        system, folder = _open(root)
        part, listed = None, {}

        def load(path: str) -> dict:
            with system.open_input_file(f"{folder}/{path}") as f:
                return dict(np.load(io.BytesIO(f.read())))

        for batch in batches:
            parts = batch.column(0).to_numpy()
            for number in np.unique(parts).tolist():
                if names[number] is None:
                    continue
                if number != part:
                    part, listed = number, load(f"list-{number:06d}-{names[number]}.npz")
                asked = batch.column(1).filter(pa.array(parts == number))
                null = asked.null_count > 0
                value = asked.drop_null().to_numpy()
                for shard in range(len(listed["start"])):
                    inside = (value >= listed["first"][shard]) & (value <= listed["last"][shard]) & (listed["known"][shard] > 0)
                    if not inside.any() and not (null and listed["nulls"][shard]):
                        continue
                    at = f"{number:06d}-{shard}-{names[number]}"
                    found, lengths = _hits(load(f"index-{at}.npz"), value[inside], null)
                    with system.open_input_file(f"{folder}/ids-{at}.bin") as source:
                        yield from _read(found, lengths, source, starts[number] + int(listed["start"][shard]))

    def _hits(index: dict, value: np.ndarray, null: bool) -> tuple[list, np.ndarray]:
        """(key, first row, first id, copies) of the keys that the shard holds, in its order."""
        hashed = PerfectHash(index["levels"], index["words"])
        slot = hashed.slots(value)
        known = slot >= 0
        known[known] = index["fingerprint"][slot[known]] == fingerprints(value[known])
        value, slot = value[known], slot[known]
        found = list(zip(value.tolist(), *(index[k][slot].tolist() for k in ("first", "offset", "copies"))))
        if null and index["null_copies"]:
            found.append((None, 0, 0, int(index["null_copies"])))
        return sorted(found, key=lambda x: x[2]), index["lengths"]

    def _read(found: list, lengths: np.ndarray, source, shard_start: int) -> Iterator[pa.RecordBatch]:
        """Read the documents in the order of the file, in windows."""
        rows: dict[str, list] = {n: [] for n in ("key", "copy", "start", "n_tokens", *outputs)}
        window, low = b"", 0
        for key, first, offset, copies in found:
            for copy in range(copies):
                n = int(lengths[first + copy])
                a, b = HEADER + offset * id_type.itemsize, HEADER + (offset + n) * id_type.itemsize
                if a < low or b > low + len(window):
                    source.seek(a)
                    window, low = source.read(max(WINDOW, b - a)), a
                ids = np.frombuffer(window[a - low : b - low], id_type)
                rows["key"].append(key)
                rows["copy"].append(copy)
                rows["start"].append(shard_start + offset)
                rows["n_tokens"].append(n)
                if "ids" in rows:
                    rows["ids"].append(ids.astype(np.int32))
                if "ids_crc32" in rows:
                    rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                offset += n
                if len(rows["key"]) >= 1024:
                    yield pa.RecordBatch.from_pydict(rows, schema=arrow_schema)
                    rows = {n: [] for n in rows}
        if rows["key"]:
            yield pa.RecordBatch.from_pydict(rows, schema=arrow_schema)

    fields = [("key", pa.int64()), ("copy", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64())]
    extra = {"ids": (pa.list_(pa.int32()), "array<int>"), "ids_crc32": (pa.int64(), "long")}
    arrow_schema = pa.schema(fields + [(n, extra[n][0]) for n in outputs])
    schema = "key long, copy int, start long, n_tokens long" + "".join(f", {n} {extra[n][1]}" for n in outputs)
    return (
        keys.select(F.col(name).cast("long").alias("key"))
        .distinct()
        .mapInArrow(place, "part int, key long")
        .repartitionById(max(1, len(names)), F.col("part"))
        .sortWithinPartitions("part", "key")
        .mapInArrow(tidied(look), schema)
    )
