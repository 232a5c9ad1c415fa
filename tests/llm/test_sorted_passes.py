"""Sorted passes against brute force over all pairs."""

import numpy as np
import pytest

from phenoline.llm import sorted_passes

DIM = 16


def plain(ids, vectors, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of each row, by all pairs."""
    ok = [v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    at = [i for i, o in enumerate(ok) if o]
    x = np.array([vectors[i] for i in at], float).reshape(len(at), DIM)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(at) else x
    near = x @ x.T >= cosine - 1e-12
    np.fill_diagonal(near, True)
    links, root = [0] * len(ids), list(range(len(ids)))
    seen = np.zeros(len(at), bool)
    for i in range(len(at)):
        links[at[i]] = int(near[i].sum()) - 1
        if not seen[i]:
            group, todo = [], [i]
            seen[i] = True
            while todo:
                j = todo.pop()
                group.append(at[j])
                new = np.flatnonzero(near[j] & ~seen)
                seen[new] = True
                todo += new.tolist()
            for g in group:
                root[g] = group
    out = []
    for i, n, group in zip(ids, links, root):
        named = [ids[g] for g in (group if isinstance(group, list) else [group]) if ids[g] is not None]
        name = min(named, default=None)
        out.append((i, n, name, i is not None and i == name))
    return sorted(out, key=str)


def found(spark, ids, vectors, **more):
    df = spark.createDataFrame(list(zip(ids, vectors, ["x"] * len(ids))), "vec_id long, embedding array<double>, name string").repartition(4)
    return sorted((tuple(r) for r in sorted_passes.near_duplicates(df, **more).collect()), key=str)


def cloud(rng, n, spread):
    centre = rng.standard_normal(DIM)
    return [(centre + spread * rng.standard_normal(DIM)).tolist() for _ in range(n)]


@pytest.mark.parametrize("window, chunk", [(128, 1024), (8, 16)])
def test_against_all_pairs(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(sorted_passes, "WINDOW", window)
    monkeypatch.setattr(sorted_passes, "CHUNK", chunk)
    # The chance of a pair at the threshold itself stays short of 1; here none may be missed.
    monkeypatch.setattr(sorted_passes, "RECALL", 0.99999)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((150, DIM)).tolist()
    # Tight groups, larger than window and chunk; loose ones, where some pairs are linked and some aren't.
    for n, spread in ((60, 0.02), (40, 0.2), (50, 0.3), (30, 0.35), (6, 0.1)):
        vectors += cloud(rng, n, spread)
    vectors += [vectors[3]] * 25 + [[2 * x for x in vectors[5]], [-x for x in vectors[6]]]
    vectors += [None, [0.0] * DIM, [float("nan")] * DIM, [float("inf")] + [1.0] * (DIM - 1), [None] + [1.0] * (DIM - 1), [1.0, 2.0], []]
    ids = [int(i) for i in rng.permutation(len(vectors))]
    ids[5] = ids[9] = None
    ids[20] = ids[21]
    assert found(spark, ids, vectors) == plain(ids, vectors)


def test_rings_count_all_links(spark, monkeypatch):
    """Groups beyond a chunk, on both sides of the bounds of their rings."""
    monkeypatch.setattr(sorted_passes, "CHUNK", 16)
    rng = np.random.default_rng(8)
    turn = np.linspace(0, 2.6, 180)
    vectors = [[float(np.cos(t)), float(np.sin(t))] + [0.0] * (DIM - 2) for t in turn]
    vectors += cloud(rng, 90, 0.25) + [vectors[40]] * 7
    ids = list(range(len(vectors)))
    assert found(spark, ids, vectors, cosine=0.9) == plain(ids, vectors)


def test_few_and_none(spark):
    assert found(spark, [], []) == []
    assert found(spark, [4], [None]) == [(4, 0, 4, True)]
    assert found(spark, [None, None], [[1.0] * DIM] * 2) == [(None, 1, None, False)] * 2
    with pytest.raises(ValueError):
        sorted_passes.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), cosine=1.5)
    assert sorted_passes.number_of_passes(100, 0.9) == 1 < sorted_passes.number_of_passes(10**6, 0.9) < sorted_passes.number_of_passes(10**9, 0.9) < 400
