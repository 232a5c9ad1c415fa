"""Operators on documents against plain Python, and on odd input."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phenoline.llm import jaccard_regions, license_diagonals, line_spread, neighbour_votes, poisson_mix, weak_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rule_statistics(spark, odd_docs, no_docs):
    assert weak_rules.judge(no_docs).count() == 0
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in weak_rules.judge(odd_docs).collect()}
    want = set()
    for r in odd_docs.collect():
        text = r["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        want.add((r["doc_id"], len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    assert got == want


def test_rules_tell_junk(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 9))) for _ in range(3000)]
    clean = [" ".join(rnd.choices(vocabulary, k=120)) for _ in range(180)]
    junk = [" ".join(w + "###" for w in rnd.choices(vocabulary, k=120)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    kept = {r["doc_id"] for r in weak_rules.judge(docs).filter("kept").collect()}
    assert kept == set(range(180))


def family(rnd, vocabulary, n):
    """A text and near copies of it, some linked to it and some not."""
    words = rnd.choices(vocabulary, k=rnd.randrange(30, 120))
    for _ in range(n):
        copy = list(words)
        for _ in range(rnd.randrange(0, 7)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        yield " ".join(copy)


def groups(texts, width=4, percent=85):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("block, common", [(1024, 32), (3, 1)])
def test_linked_components(spark, monkeypatch, block, common):
    monkeypatch.setattr(jaccard_regions, "BLOCK", block)
    monkeypatch.setattr(jaccard_regions, "COMMON", common)
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(400)]
    texts = [t for _ in range(12) for t in family(rnd, vocabulary, 14)]
    shared = " ".join(rnd.choices(vocabulary, k=25))
    texts += [f"{shared} {' '.join(rnd.choices(vocabulary, k=12))}" for _ in range(40)]
    texts += [texts[3], texts[3].upper(), "", None, "a b", "A  B", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_regions.link_documents(docs).collect()}
    assert got == groups(texts)


def test_linked_odd_input(spark, odd_docs, no_docs):
    assert jaccard_regions.link_documents(no_docs).count() == 0
    rows = jaccard_regions.link_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7}


def test_votes(spark, odd_docs, no_docs):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 9))) for _ in range(2000)]
    texts = [" ".join(rnd.choices(vocabulary, k=80)) if i % 3 else " ".join([rnd.choice(vocabulary)] * 60) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.filter("doc_id < 200").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("label"))
    voter = neighbour_votes.fit(docs, labels, per_class=60)
    scored = neighbour_votes.score(docs, voter).filter("doc_id >= 200").collect()
    assert all(r["predicted"] == (r["doc_id"] % 3 != 0) for r in scored)
    rows = neighbour_votes.score(odd_docs, voter).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert neighbour_votes.score(no_docs, voter).count() == 0
    nothing = neighbour_votes.fit(odd_docs, labels.limit(0))
    assert {r["score"] for r in neighbour_votes.score(odd_docs, nothing).collect()} == {0.5}


def test_lines(spark, odd_docs, no_docs):
    rows = [(i, f"menu of the site\nline {i} with words of its own and more\n{'x' * i}", None, f"s{i}", 1) for i in range(12)]
    rows += [(20, "menu of the site", None, "s1", 1), (21, "other\n\nmenu of the site  ", None, None, 1), (21, "other\n\nmenu of the site  ", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_spread.drop_spread_lines(docs, sites=12).collect()}
    assert out[3] == ("line 3 with words of its own and more\nxxx", 1)
    assert out[20] == ("menu of the site", 0)  # nothing but boilerplate: a copy, left whole
    assert out[21] == ("other\n", 1)
    assert {r["n_removed"] for r in line_spread.drop_spread_lines(docs, sites=14).collect()} == {0}
    odd = line_spread.drop_spread_lines(odd_docs, sites=2)
    assert sorted(odd.columns) == sorted(odd_docs.columns) and odd.count() == odd_docs.count()
    assert line_spread.drop_spread_lines(no_docs).count() == 0


def test_lines_of_very_long_texts(spark):
    """A hundred thousand lines take seconds; the work grows with them, not with their square."""
    long = "\n".join("menu" if i % 3 == 0 else "" if i % 50 == 1 else f"line {i} of the text" for i in range(100_000))
    rows = [(0, long, "s0")] + [(i, f"menu\nown {i}", f"s{i}") for i in range(1, 12)] + [(99, None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    begin = time.monotonic()
    out = line_spread.drop_spread_lines(docs, sites=10).collect()
    assert time.monotonic() - begin < 60
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in out}
    assert got[0] == ("\n".join(x for x in long.split("\n") if x != "menu"), 33_334)
    assert got[4] == ("own 4", 1) and got[99] == (None, 0) and len(out) == len(rows)


def test_whole_licence_texts(spark):
    """Templates of any length, found whole, with words left out or put in, and not in texts that share some of their words."""
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 9))) for _ in range(3000)]
    text = rnd.choices(vocabulary, k=700)
    edited = [w for i, w in enumerate(text) if i % 97] + ["more"]
    half = text[:300] + rnd.choices(vocabulary, k=400)
    long = rnd.choices(vocabulary, k=60_000)
    texts = {1: text, 2: edited, 3: half, 4: long[:30_000] + [w.upper() for w in text] + long[30_000:], 5: long}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    begin = time.monotonic()
    got = {r["doc_id"]: r for r in license_diagonals.scan(docs, passages=[(" ".join(text), "whole")]).collect()}
    assert time.monotonic() - begin < 60
    assert {i: r["labels"] for i, r in got.items()} == {1: "whole", 2: "whole", 3: "", 4: "whole", 5: ""}
    assert got[1]["score"] == 1 and 0.95 < got[2]["score"] < 1 and got[4]["score"] == 1
    assert [tuple(s) for s in got[4]["spans"]] == [("whole", 30_000, 30_699, 1.0)]
    with pytest.raises(ValueError):
        license_diagonals.scan(docs, passages=[("one", "x")])


def test_mix(spark, odd_docs, no_docs):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b").alias("source"))
    got = {r["source"]: r["count"] for r in poisson_mix.mix(docs, {"hot": 0.2, "b": 0.3, "absent": 0.1}).groupBy("source").count().collect()}
    total = sum(got.values())
    for source, share in (("hot", 0.2 / 0.9), ("b", 0.3 / 0.9), (None, 0.4 / 0.9)):
        assert got[source] / total == pytest.approx(share, abs=0.02)
    assert poisson_mix.mix(docs, {"hot": 0.2}).collect()[:50] == poisson_mix.mix(docs, {"hot": 0.2}).collect()[:50]
    few = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "rare").otherwise("rest").alias("source"))
    n = poisson_mix.mix(few, {"rare": 0.5}).filter("source = 'rare'").count()
    assert 400 < n < 600  # a rate of 250, drawn in parts
    assert "copy" in poisson_mix.mix(odd_docs, {"s0": 0.5}).columns
    assert poisson_mix.mix(no_docs, {"s0": 0.5}).count() == 0


def test_licences(spark, odd_docs, no_docs):
    texts = {
        1: "X Apache-License; GNU general Public license",
        2: "Licensed under CC BY-NC 4.0.",
        3: "Permission is hereby granted, free of charge, to ANY person who is obtaining a copy of this software and documentation files",
        4: "public license gnu general",
        5: "CC BY cc by CCK BY",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_diagonals.scan(docs).collect()}
    place = lambda i: (got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"])
    assert place(1) == (2, 1, 3, "apache,gpl")
    assert place(2) == (1, 2, 2, "cc-by") and got[2]["labels"] == "cc-by,cc-by-nc" and got[2]["score"] == 1
    assert place(3) == (0, None, None, "") and got[3]["labels"] == "mit" and 0.6 <= got[3]["score"] < 1
    assert place(4) == (0, None, None, "") and place(5) == (2, 0, 2, "cc-by")
    rows = license_diagonals.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["n_base"] == 0 and r["score"] == 0 for r in rows)
    assert license_diagonals.scan(no_docs).count() == 0
