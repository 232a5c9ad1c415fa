"""Scores of the classifier and verdicts of the rules, document by document in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoline.llm import neighbour_votes as nv
from phenoline.llm import weak_rules
from phenoline.llm.text_numbers import Words, mixed


def plain_counts(text):
    """Terms of one text by loops over its words."""
    out = [0] * nv.TERMS
    raw = (text or "").encode()
    words, at = [], 0
    for part in raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" "):
        if part:
            words.append(part)
    hashes = [int(Words([w.decode()], lower=False).hash[0]) for w in words]
    kinds = []
    for w in words:
        kind = 0
        for byte in w:
            kind |= int(nv._KIND[byte])
        kinds.append(kind)
    out[nv.TERMS - nv.SIZES + min(int(math.log2(len(words) + 1)), nv.SIZES - 1)] += 1
    for i, (w, h, k) in enumerate(zip(words, hashes, kinds)):
        out[h % nv.WORDS] += 1
        out[nv.WORDS + k] += 1
        if i:
            two = int(mixed(np.array([kinds[i - 1] * 1024 + k], np.uint64))[0]) % nv.PAIRS
            out[nv.WORDS + nv.KINDS + two] += 1
        repeat = sum(1 << (back - 1) for back in (1, 2, 3, 4) if i >= back and hashes[i - back] == h)
        out[nv.WORDS + nv.KINDS + nv.PAIRS + repeat] += 1
        at = nv.WORDS + nv.KINDS + nv.PAIRS + nv.REPEATS
        out[at + min(len(w), nv.LENGTHS - 1)] += 1
    return out


def corpus(rnd, n):
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 9))) for _ in range(600)]
    for i in range(n):
        words = rnd.choices(vocabulary, k=rnd.randrange(1, 120))
        if i % 3 == 0:
            words = [w.upper() + "###" if rnd.random() < 0.4 else w for w in words] + words[:5] * 3
        if i % 7 == 0:
            words += ["Straße,", "12.5", "(x)"]
        yield " ".join(words) + ("\n" if i % 5 == 0 else "")


def test_scores_are_those_of_brute_force(spark):
    rnd = random.Random(12)
    texts = [*corpus(rnd, 240), None, "", "  \n"]
    texts[100] = texts[40] = texts[7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = docs.filter("doc_id % 2 = 0 AND doc_id < 240").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("label"))
    voter = nv.fit(docs, labels, per_class=50, rank=8, k=7)
    counts = np.array([plain_counts(t) for t in texts])
    held = (counts > 0).sum(0)
    idf = np.log((len(texts) + 1) / (held + 1)) + 1
    assert voter.idf == pytest.approx(idf.astype(np.float32), rel=1e-5)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in nv.score(docs, voter).collect()}
    for i, row in enumerate(counts):
        v = (np.log1p(row).astype(np.float32) * voter.idf) @ voter.axes
        v = v / max(np.linalg.norm(v), 1e-12)
        near = sorted(((float(v @ x), -j) for j, x in enumerate(voter.vectors)), reverse=True)[:7]
        weights = [(max(c, 0.0) ** 8 + 1e-9, voter.labels[-j]) for c, j in near]
        want = sum(w * y for w, y in weights) / sum(w for w, _ in weights)
        assert got[i][0] == pytest.approx(want, abs=1e-4)
        assert got[i][1] == int(got[i][0] >= 0.3)


def test_ties_go_to_the_earlier_examples():
    x = np.zeros((6, 2), np.float32)
    x[:, 0] = 1
    voter = nv.Voter(np.ones(nv.TERMS, np.float32), np.eye(nv.TERMS, 2, dtype=np.float32), x, np.array([1.0, 0, 1, 0, 0, 0]), 0.5, 3)
    counts = np.zeros((2, nv.TERMS), int)
    counts[:, 0] = 1
    assert voter.scores(counts) == pytest.approx([2 / 3, 2 / 3])


def plain_em(votes, rounds=200):
    """Expectation-maximisation document by document: posterior probabilities of being good."""
    n = len(votes)
    weight = [0.9 if min(v) >= 0 else 0.1 for v in votes]
    prior = weak_rules.BEFORE_WEIGHT * n + 1
    share = 0.5
    for _ in range(rounds):
        good = math.fsum(weight)
        new = (good + weak_rules.SHARE * prior) / (n + prior)
        odds = [math.log(new / (1 - new))] * n
        for j in range(len(votes[0])):
            for vote, (on_good, on_bad) in weak_rules.BEFORE.items():
                who = [i for i in range(n) if votes[i][j] == vote]
                p = (math.fsum(weight[i] for i in who) + on_good * prior) / (good + prior)
                q = (math.fsum(1 - weight[i] for i in who) + on_bad * prior) / (n - good + prior)
                for i in who:
                    odds[i] += math.log(p / q)
        weight = [1 / (1 + math.exp(-o)) for o in odds]
        if abs(new - share) < 1e-9:
            break
        share = new
    return weight


def plain_votes(r):
    """Votes of the rules on one row of statistics; the bounds stated once more."""
    n, c, lines = r["n_words"], r["word_chars"], r["n_lines"]

    def vote(value, bad, good):
        return 0 if value is None else -1 if bad(value) else 1 if good(value) else 0

    per_word = lambda name: r[name] / n if n else None
    per_char = lambda name: r[name] / c if c else None
    return (
        vote(n or None, lambda v: v < 50, lambda v: v >= 80),
        vote(per_word("word_chars"), lambda v: v < 3 or v > 12, lambda v: 3.5 <= v <= 9),
        vote(per_word("n_repeat_words"), lambda v: v > 0.3, lambda v: v <= 0.1),
        vote(per_word("n_different"), lambda v: n >= 50 and v < 0.2, lambda v: v >= 0.35),
        vote(per_word("n_symbols"), lambda v: v > 0.1, lambda v: v <= 0.02),
        vote(per_char("n_symbols"), lambda v: v > 0.02, lambda v: v <= 0.005),
        vote(per_word("n_shouts"), lambda v: v > 0.3, lambda v: v <= 0.1),
        vote(per_char("n_capitals"), lambda v: v > 0.3, lambda v: v <= 0.1),
        vote(r["n_dup_lines"] / lines if lines else None, lambda v: v > 0.3, lambda v: v <= 0.1),
    )


def test_verdicts_are_those_of_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 11))) for _ in range(2000)]
    texts = []
    for i in range(160):
        words = rnd.choices(vocabulary[: rnd.choice([15, 200, 2000])], k=rnd.randrange(40, 160))
        if i % 6 == 0:
            words = [w.upper() if rnd.random() < 0.5 else w for w in words]
        if i % 8 == 0:
            words = [w + "#" * rnd.randrange(3) for w in words]
        if i % 9 == 0:
            words = [w + "!" if rnd.random() < 0.6 else w for w in words]
        cut = rnd.randrange(3, 30)
        lines = [" ".join(words[k : k + cut]) for k in range(0, len(words), cut)]
        texts.append("\n".join(lines + lines[:2] * (i % 5 == 0) * 4))
    docs = spark.createDataFrame([*enumerate(texts), (500, None), (501, "")], "doc_id long, text string").repartition(4)
    rows = weak_rules.judge(docs).collect()
    scored = [r for r in rows if not r["base_failed"]]
    assert 60 < len(scored) < len(rows)
    posterior = plain_em([plain_votes(r) for r in scored])
    for r, p in zip(scored, posterior):
        assert r["p_good"] == pytest.approx(p, abs=1e-6)
        assert r["kept"] == (r["p_good"] >= 0.5)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert 0 < sum(r["kept"] for r in scored) < len(scored)
