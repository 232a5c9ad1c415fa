"""Stages of the pipeline, with their own parameters, against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from phenoline.llm import neighbour_votes
from phenoline.llm.queries import SOURCE_WEIGHTS
from test_documents import family, groups
from test_proofs import corpus, plain_counts

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies():
    """Texts with near copies, among them pairs that five words at 0.8 link and four words at 85 % don't."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(400)]
    texts = [t for _ in range(8) for t in family(rnd, vocabulary, 6)]
    for _ in range(6):
        words = rnd.choices(vocabulary, k=100)
        copy = list(words)
        copy[30] = copy[60] = "changed"
        texts += [" ".join(words), " ".join(copy)]
    return texts


def test_near_duplicates_at_five_words(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], FIELDS).repartition(5)
    want = {i for i, (_, root) in groups(texts, 5, 80).items() if i == root}
    assert want < {i for i, (_, root) in groups(texts).items() if i == root}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_line_dedup_of_short_pages(spark):
    menu, foot = "menu that is on every page of the site", "all rights reserved by the owner of the site"
    texts = [f"{menu}\nbody {i} " + "with many words of its own " * 6 for i in range(12)]
    texts += [f"{foot}\nother body {i} " + "with many words of its own " * 6 for i in range(12)]
    texts += [f"{menu}\nshort", f"  {menu}\n\n{foot}\nx", menu, f"{menu}\n\n{foot}", "none of it", "", None]
    docs = spark.createDataFrame([(i, t, "en", None if i == 5 else f"s{i % 12}", -1) for i, t in enumerate(texts)], FIELDS).repartition(3)

    def plain(text):
        lines = (text or "").split("\n")
        left = [line for line in lines if line.strip(" ") not in (menu, foot)]
        return "\n".join(left) if any(line.strip(" ") for line in left) and len(left) < len(lines) else text

    want = {i: (plain(t), len(plain(t)) if plain(t) != t else -1) for i, t in enumerate(texts)}
    assert want[24] == ("short", 5) and want[27] == (f"{menu}\n\n{foot}", -1)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == want


@pytest.mark.parametrize("shared", [None, 7])
@pytest.mark.parametrize("same_text", [True, False])
def test_mix_of_rows_that_share_an_id(spark, shared, same_text):
    n = 12_000
    rows = [(shared if i % 3 == 0 else i, "copy" if same_text else f"text {i}", "en", f"src{i % 10}", 1) for i in range(n)]
    docs = spark.createDataFrame(rows, FIELDS).repartition(6)
    got = corpus_pipeline.mix_sources(spark, docs, "").withColumn("shared", F.col("doc_id").eqNullSafe(F.lit(shared))).collect()
    assert len(got) == pytest.approx(n, rel=0.04)
    by_source, by_id = Counter(r["source"] for r in got), Counter(r["source"] for r in got if r["shared"])
    for s in {r[3] for r in rows}:
        share = SOURCE_WEIGHTS.get(s, 0.61 / 6)
        assert by_source[s] / len(got) == pytest.approx(share, abs=0.012)
        assert by_id[s] / by_source[s] == pytest.approx(1 / 3, abs=0.07)
    if not same_text:
        times = Counter(r["text"] for r in got if r["shared"] and r["source"] == "src0")
        assert len(times) == pytest.approx(400 * (1 - math.exp(-1.5)), rel=0.12)
    # Another layout of the rows draws the same.
    again = corpus_pipeline.mix_sources(spark, docs.coalesce(2), "").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())


def test_near_duplicates_by_row(spark):
    a, b, c, d = ("the text of group %s " % g + " ".join(f"{g}{i}" for i in range(60)) for g in "abcd")
    near = c.replace("c30", "changed")
    rows = [(5, a), (5, b), (5, b), (7, a), (None, a), (None, c), (None, near), (None, c), (8, d), (9, d), (None, d)]
    rows += [(None, ""), (None, ""), (None, None), (11, " "), (11, " "), (12, None)]
    rows += [(5, a)] * 50 + [(None, c)] * 50
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], FIELDS)
    outs = []
    for layout in (docs.repartition(4), docs.coalesce(1)):
        outs.append(sorted(str((r["doc_id"], r["text"])) for r in corpus_pipeline.near_duplicates(spark, layout, "").collect()))
    assert outs[0] == outs[1]
    one = [x for x in (c, near) if str((None, x)) in outs[0]]
    assert len(one) == 1
    want = [(5, a), (5, b), (None, one[0]), (8, d), (None, ""), (None, ""), (None, None), (11, " "), (12, None)]
    assert outs[0] == sorted(map(str, want))


def test_votes_of_a_repeated_id(spark):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 9))) for _ in range(2000)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=80)) if i % 3 else " ".join([rnd.choice(vocabulary)] * 60)) for i in range(200)]
    hot = [(7, " ".join(rnd.choices(vocabulary, k=80))) for _ in range(300)]
    docs = spark.createDataFrame(rows + hot, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(150)] + [(7, 1)] * 400 + [(9, 0)] * 400 + [(7, 0)], "doc_id long, label int")
    voter = neighbour_votes.fit(docs, labels, per_class=1000)
    assert len(voter.vectors) == 150 and voter.labels.sum() == 100
    few = neighbour_votes.fit(docs, labels, per_class=20)
    assert len(few.vectors) == 40 and few.labels.sum() == 20
    other = neighbour_votes.fit(docs.coalesce(1), labels, per_class=20)
    assert np.allclose(few.vectors @ few.vectors.T, other.vectors @ other.vectors.T, atol=1e-4)


def test_quality_keeps_what_the_neighbours_vote_for(spark, tmp_path):
    """The stage's rows by brute force: examples from labels outside the fifth held out, votes by all cosines, 0.3 as the border."""
    rnd = random.Random(21)
    texts = [t if i % 11 else None for i, t in enumerate(corpus(rnd, 200))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], FIELDS).repartition(4)
    marks = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    learned = {i: int(i % 3 != 0) for i in range(0, 200, 2) if zlib.crc32(str(i).encode()) % 5}
    known = spark.createDataFrame(list(learned.items()), "doc_id long, label int")
    voter = neighbour_votes.fit(docs.select("doc_id", "text"), known)
    assert len(voter.labels) == len(learned)
    want = set()
    for i, t in enumerate(texts):
        v = (np.log1p(plain_counts(t)).astype(np.float32) * voter.idf) @ voter.axes
        near = sorted(((float(v @ x) / max(np.linalg.norm(v), 1e-12), -j) for j, x in enumerate(voter.vectors)), reverse=True)[: voter.k]
        weights = [(max(c, 0.0) ** 8 + 1e-9, voter.labels[-j]) for c, j in near]
        score = sum(w * y for w, y in weights) / sum(w for w, _ in weights)
        assert abs(score - 0.3) > 1e-4
        if score >= 0.3:
            want.add(i)
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: texts[i] for i in want} and 0 < len(want) < len(texts)


def test_encoding_is_the_library_s(spark):
    rnd = random.Random(5)
    texts = ["", None, "Some Words,  twice\n", "naïve 🙂 中文 İ", "x" * 5000, *[" ".join(rnd.choices(["The", "cat's", "12.5", "Ünï", "sat"], k=40)) for _ in range(20)]]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], FIELDS).repartition(3)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r["doc_id"]: (r["n_tokens"], list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.encode(spark, docs, "").collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), ids, hashlib.sha256(shown.encode()).hexdigest())
