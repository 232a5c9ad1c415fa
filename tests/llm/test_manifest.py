"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from phenoline.llm import merkle_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """The last node, and for every leaf the siblings level by level as (left, right)."""
    level, places = list(leaves), list(range(len(leaves)))
    ways = [[] for _ in leaves]
    while len(level) > 1:
        for way, p in zip(ways, places):
            a = p - p % arity
            run = level[a : a + arity]
            way.append(("".join(run[: p - a]), "".join(run[p - a + 1 :])))
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
        places = [p // arity for p in places]
    return level[0], ways


def plain(rows, arity):
    """rows: (key, group, leaf). A sorted list of (key, group, leaf, subroot, root, path)."""
    groups = {}
    for key, group, leaf in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf, key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([r[2] for r in sorted(groups[g])], arity) for g in names}
    root, above = plain_tree([trees[g][0] for g in names], arity)
    out = []
    for g, up in zip(names, above):
        for row, way in zip(sorted(groups[g]), trees[g][1]):
            out.append((str(row[3]), str(g), row[2], trees[g][0], root, tuple(way + up)))
    return sorted(out)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest(spark, arity):
    rnd = random.Random(arity)
    sizes = {None: 5, "": 1, "a": 37, "ä": 8, "b": 9, "z\U0001f600": 2}
    rows = [(rnd.choice([None, *range(20)]), g, h(g or "", str(rnd.randrange(12)))) for g, n in sizes.items() for _ in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, g string, leaf string, path string").repartition(4)
    made = merkle_manifest.build(df, "k", "g", "leaf", ("k", "g"), arity)
    proofs = made.proofs().withColumn("folded", merkle_manifest.folded("leaf", "path")).withColumn("proof", merkle_manifest.proof("path"))
    got = proofs.collect()
    assert sorted((str(r["k"]), str(r["group"]), r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["path"])) for r in got) == plain(rows, arity)
    assert all(r["folded"] == made.root == r["root"] for r in got)
    assert all(r["proof"] == h(*[x for s in r["path"] for x in (s["left"], s["right"])]) for r in got)
    other = made.proofs().select((merkle_manifest.folded(F.sha2("leaf", 256), "path") == F.col("root")).alias("same")).distinct().collect()
    assert [r["same"] for r in other] == [False]


def test_one_leaf_and_none(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "en", h("x"))], "k long, g string, leaf string")
    one = merkle_manifest.build(docs, "k", "g", "leaf").proofs().collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["path"]) for r in one] == [(h("x"),) * 3 + ([],)]
    leaf = merkle_manifest.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    made = merkle_manifest.build(odd_docs.withColumn("leaf", leaf), "doc_id", "lang", "leaf", ("doc_id", "text", "row", "kept", "at"))
    rows = made.proofs().withColumn("back", merkle_manifest.folded("leaf", "path")).collect()
    assert len(rows) == odd_docs.count() and all(r["back"] == made.root for r in rows)
    for r in rows:
        if r["doc_id"] == 7:
            assert r["leaf"] == h("1:7", "2:s1", "2:en", "1:1", f"{len(r['text'])}:{r['text']}")
        if r["text"] is None and r["doc_id"] is None:
            assert r["leaf"] == h("-----")
    nothing = merkle_manifest.build(no_docs.withColumn("leaf", leaf), "doc_id", "lang", "leaf", ("doc_id",))
    assert nothing.root is None and nothing.proofs().count() == 0
    with pytest.raises(ValueError):
        merkle_manifest.build(docs, "k", "g", "leaf", arity=1)
