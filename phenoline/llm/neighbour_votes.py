"""Operator 8: quality classifier by votes of the nearest labelled documents.

Terms of a text are its words (hashed), the kinds of characters its words are made of, alone and in pairs, whether words repeat those
just before, and lengths. Document frequencies are counted over all documents. A bounded sample of labelled rows, as many
good as bad ones if there are, is decomposed into latent dimensions (singular vectors of its tf-idf matrix). The sample's
latent vectors, a table whose size parameters fix, go with the tasks; every document's cosines with all of them are computed
exactly, in blocks, and the nearest vote with their similarity as weight.

Defined results: null and empty texts have a length term only and are scored like all others. Without labelled rows of both
kinds every score is the share of label 1 (1/2 without any). Repeated rows get the same score. A labelled id is one example however
many rows it has: its label is the more frequent one (1 if both are as frequent), its text the one with the lowest hash. Columns named
like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoline.llm.common import give_back, sub_columns, tidied
from phenoline.llm.text_numbers import Words, mixed

WORDS, KINDS, PAIRS, REPEATS, LENGTHS, SIZES = 1024, 1024, 1024, 16, 32, 24
TERMS = WORDS + KINDS + PAIRS + REPEATS + LENGTHS + SIZES

# Kinds of bytes, as bits: lower case, upper case, digit, beyond ASCII, full stop and comma, other closing marks, pipe, other symbols, brackets and quotes, rest.
_KIND = np.full(256, 512, np.uint16)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 4, 8
for _bit, _characters in ((16, b".,"), (32, b"!?;:"), (64, b"|"), (128, b"#*$%&<>"), (256, b"()[]{}\"'")):
    _KIND[list(_characters)] = _bit


def term_counts(texts: list[str | None]) -> np.ndarray:
    """A row of term counts for each text."""
    words = Words(texts, lower=False)
    n, row = len(words.start), words.text
    size = np.minimum(np.log2(words.count + 1).astype(int), SIZES - 1)
    keys = [np.arange(len(texts)) * TERMS + (TERMS - SIZES) + size]
    if n:
        # Spaces have no kind, so an interval between starts has the kinds of its word.
        kinds = np.where(words.data <= 32, np.uint16(0), _KIND[words.data])
        kind = np.bitwise_or.reduceat(kinds, words.start).astype(np.int64)
        here = row * TERMS
        keys.append(here + (words.hash % np.uint64(WORDS)).astype(np.int64))
        keys.append(here + WORDS + kind)
        two = mixed((kind[:-1] * 1024 + kind[1:]).astype(np.uint64)) % np.uint64(PAIRS)
        together = row[:-1] == row[1:]
        keys.append(here[1:][together] + WORDS + KINDS + two.astype(np.int64)[together])
        repeat = np.zeros(n, np.int64)
        for back in (1, 2, 3, 4):
            same = (words.hash[back:] == words.hash[:-back]) & (row[back:] == row[:-back])
            repeat[back:] |= same.astype(np.int64) << (back - 1)
        keys.append(here + WORDS + KINDS + PAIRS + repeat)
        keys.append(here + WORDS + KINDS + PAIRS + REPEATS + np.minimum(words.end - words.start, LENGTHS - 1))
    return np.bincount(np.concatenate(keys), minlength=len(texts) * TERMS).reshape(-1, TERMS)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Term counts in blocks of at most 128 texts."""
    for start, part in sub_columns(texts, 1_000_000):
        for k in range(0, len(part), 128):
            yield start + k, term_counts(part[k : k + 128])


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term. A task sends one row of a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for _, counts in _blocks(batch.column(0)):
                held += (counts > 0).sum(0)
                rows += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(held, rows))], names=["term", "n"])

    made = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tidied(count), "term long, n long")
    sums = {r["term"]: r["n"] for r in made.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.get(TERMS, 0), np.array([sums.get(i, 0) for i in range(TERMS)])


class Voter:
    """Latent vectors of labelled documents, and what maps term counts to that space."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, share: float, k: int):
        self.idf, self.axes, self.vectors, self.labels, self.share, self.k = idf, axes, vectors, labels, share, k

    def latent(self, counts: np.ndarray) -> np.ndarray:
        v = (np.log1p(counts).astype(np.float32) * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(counts), self.share)
        near = self.latent(counts) @ self.vectors.T
        k = min(self.k, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        # Ties at the border go to the earlier rows of the sample, in every block alike.
        least = np.take_along_axis(near, top, 1).min(1, keepdims=True)
        for row in np.flatnonzero((near >= least).sum(1) > k):
            top[row] = np.argsort(-near[row], kind="stable")[:k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** 8 + 1e-9
        return (weight * self.labels[top]).sum(1) / weight.sum(1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, rank: int = 64, k: int = 15, text: str = "text") -> Voter:
    """``docs`` (doc_id, text) are all documents, ``labels`` (doc_id, label 0 or 1) the rows to learn from.

    At most ``per_class`` ids of each label are taken, those with the lowest hash; the driver holds one row of term counts for each.
    """
    total, held = document_frequencies(docs, text)
    idf = np.log((total + 1) / (held + 1)).astype(np.float32) + 1
    known = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    empty = Voter(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), share, k)
    if len(sizes) < 2:
        return empty
    picked = [known.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    taken = picked[0].union(picked[1]).select("doc_id", F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    # One text of each id, folded in each task before they meet.
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    rows = rows.groupBy("doc_id", "label").agg(first).select("doc_id", "label", F.col("first.text").alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, counts in _blocks(batch.column("text")):
                at = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(counts)).cast(pa.int64()),
                        batch.column("label").slice(start, len(counts)).cast(pa.int32()),
                        pa.array([a.astype("<i2").tobytes() for a in at], pa.binary()),
                        pa.array([c[a].astype("<i4").tobytes() for c, a in zip(counts, at)], pa.binary()),
                    ],
                    names=["doc_id", "label", "term", "n"],
                )

    got = sorted(rows.mapInArrow(tidied(sparse), "doc_id long, label int, term binary, n binary").collect(), key=lambda r: (r["doc_id"], r["label"]))
    if len({r["label"] for r in got}) < 2:
        return empty
    matrix = np.zeros((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        matrix[i, np.frombuffer(r["term"], "<i2")] = np.log1p(np.frombuffer(r["n"], "<i4").astype(np.float32))
    matrix *= idf
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    # Leading singular vectors by subspace iteration from a fixed start.
    basis = np.linalg.qr(np.random.default_rng(8).standard_normal((TERMS, rank + 16)).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, turn = np.linalg.svd(matrix @ basis, full_matrices=False)
    axes = (basis @ turn.T[:, :rank]).astype(np.float32)
    vectors = matrix @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    voter = Voter(idf, axes, vectors.astype(np.float32), np.array([r["label"] for r in got], np.float64), share, k)
    # The driver doesn't need the sample any more, and later stages need its memory.
    del matrix, got, basis, vectors
    give_back()
    return voter


def score(docs: DataFrame, voter: Voter, least: float = 0.3, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (1 if score >= least)."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [voter.scores(counts) for _, counts in _blocks(batch.column(text))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(scores), pa.array((scores >= least).astype(np.int32))],
                names=[*names, "score", "predicted"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*names).mapInArrow(tidied(run), f"{schema}, score double, predicted int")
