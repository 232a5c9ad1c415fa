import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from phenoline.llm import bpe, bpe_documents, keyed_ids
from phenoline.llm.bpe import Codec, Decoder, sufficient_lookahead
from phenoline.llm.common import sub_batches, sub_columns
from phenoline.sources.paths import scratch_path

FILES = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
LIBRARY = {n: Tokenizer.from_file(p) for n, p in FILES.items()}
CODEC = {n: Codec(p, decode=True) for n, p in FILES.items()}
STREAMED = {n: Codec(p, decode=True, streamed=True) for n, p in FILES.items()}
PARTS = list("abcdeABEzZ'sStTrelvmd   \n\t.,!?-0123éÉüßñΣσςİ🙂中文́\x1c\x00\x85\xa0") + ["  ", "<|endoftext|>", "<|startoftext|>", "'re", "the "]


def ids_of(name, text):
    return LIBRARY[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join))
def test_same_as_the_library(name, text):
    (raw, shown), = CODEC[name].encode([text])
    want = ids_of(name, text)
    assert np.frombuffer(raw, "<u4").tolist() == want
    assert shown.decode() == LIBRARY[name].decode(want, skip_special_tokens=False)
    assert STREAMED[name].encode([text]) == [(raw, shown)]
    assert list(CODEC[name].encode_stream(text[i : i + 7] for i in range(0, len(text), 7))) == want


@pytest.mark.parametrize("name", FILES)
def test_long_words(name):
    rnd = random.Random(3)
    for text in ("a" * 9000, "ab" * 4000, "".join(rnd.choices("abcdefghinorstue", k=9000)), "!" * 5000):
        assert np.frombuffer(CODEC[name].encode([text])[0][0], "<u4").tolist() == ids_of(name, text)
        assert STREAMED[name].encode([text]) == CODEC[name].encode([text])


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.lists(st.sampled_from([*"abcdehilnorst", "the", "ing", "aaaa", "é"]), min_size=1, max_size=40).map("".join))
def test_few_symbols_merge_as_many_do(name, text):
    table = CODEC[name].table
    symbols = [table.inner_of[b] for b in text.encode()]
    symbols[-1] = table.final_of[text.encode()[-1]]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "FEW", 0)
        by_heap = table.merge_list(symbols)
    assert table._merge_few(list(symbols)) == by_heap


def test_short_words_need_no_heap_and_no_array_each(monkeypatch):
    """Where most words are new, those took most of the time."""
    words, made = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}ning" for i in range(600)], []
    want = CODEC["word_bpe_49k.json"].table.encode_words(words, np.dtype("<u4"))
    array = np.array
    monkeypatch.setattr(bpe.heapq, "heapify", lambda heap: made.append("heap"))
    monkeypatch.setattr(bpe.np, "array", lambda *a: (made.append("array"), array(*a))[1])
    assert bpe.transduced(STREAMED["word_bpe_49k.json"].table, words, np.dtype("<u4")) == want
    assert made == ["array"]


def test_decoder_state():
    name = "byte_bpe_50k.json"
    text = "naïve 🙂 中文 text"
    machine = Decoder(CODEC[name].table)
    assert "".join(machine.feed([i]) for i in ids_of(name, text)) + machine.end() == text


def test_lookahead_of_a_small_merge_list():
    # Ids 0 to 3 are symbols. In the last list each rule's right part begins with the left part of the rule before.
    assert sufficient_lookahead([], [1] * 4) == 0
    assert sufficient_lookahead([(0, 1, 4)], [1] * 5) == 1
    assert sufficient_lookahead([(2, 3, 5), (1, 2, 6), (0, 1, 7)], [1] * 4 + [0, 2, 2, 2]) == 3
    with pytest.raises(ValueError):
        sufficient_lookahead([(0, 4, 5), (1, 2, 4)], [1] * 6)


def test_documents(spark, odd_docs, no_docs):
    name = "word_bpe_49k.json"
    outputs = ("n_tokens", "ids", "decoded", "ids_sha256")
    got = bpe_documents.encode_decode(odd_docs, FILES[name], outputs)
    assert bpe_documents.encode_decode(no_docs, FILES[name], outputs).count() == 0
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = ids_of(name, r["text"] or "")
        assert (r["n_tokens"], list(r["ids"])) == (len(want), want)
        assert r["decoded"] == LIBRARY[name].decode(want, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_texts_are_not_sent_back(spark, odd_docs):
    got = bpe_documents.encode_decode(odd_docs, FILES["word_bpe_49k.json"], ("n_tokens", "ids_sha256"), keep=("doc_id",))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256"]
    whole = bpe_documents.encode_decode(odd_docs, FILES["word_bpe_49k.json"], ("n_tokens", "ids_sha256")).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from([None, "", "é🙂", "abc", "x" * 30]), max_size=12), st.integers(1, 40))
def test_columns_are_cut_as_lists(texts, most):
    column = pa.array([None, *texts], pa.string()).slice(1)
    assert list(sub_columns(column, most)) == list(sub_batches(texts, most))


def test_workers_load_no_pandas():
    code = "import sys, phenoline.llm.bpe_documents, phenoline.llm.neighbour_votes, phenoline.llm.jaccard_regions; print('pandas' in sys.modules)"
    root = Path(__file__).resolve().parents[2]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.strip() == "False"


@pytest.mark.parametrize("rows_per_shard, most_parts", [(4, 16384), (8192, 16384), (2, 4), (1, 16384)])
def test_store_round_trip(spark, odd_docs, rows_per_shard, most_parts):
    name = "byte_bpe_50k.json"
    store = keyed_ids.write_store(odd_docs, scratch_path(spark, "ids"), FILES[name], rows_per_shard=rows_per_shard, most_parts=most_parts)
    assert len(store.names) <= max(most_parts, odd_docs.count())
    unknown = spark.createDataFrame([(10**12,), (-5,)], "doc_id long")
    found = keyed_ids.find(spark, store, odd_docs.select("doc_id").union(unknown), ("ids", "ids_crc32")).collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, ids_of(name, r["text"] or "") + [0]) for r in odd_docs.collect()), key=lambda x: x[:2])
    assert sorted((r["key"] is not None, r["key"] or 0, list(r["ids"])) for r in found) == sorted(want)
    starts, at = {}, 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
        starts.setdefault(r["key"], r["start"])
    keys = [k for k, _ in sorted(starts.items(), key=lambda x: x[1])]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])


def test_hot_keys_and_null_keys_spread(spark):
    """A third of the rows without a key and a third under one: no part and no shard holds many."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = keyed_ids.write_store(docs, scratch_path(spark, "ids"), FILES["byte_bpe_50k.json"], rows_per_shard=20)
    found = keyed_ids.find(spark, store, docs.select("doc_id"), ("ids",)).collect()
    assert sorted((r["key"] is not None, r["key"] or 0, list(r["ids"])) for r in found) == sorted(
        (k is not None, k or 0, ids_of("byte_bpe_50k.json", t) + [0]) for k, t in rows
    )
    assert sorted(r["start"] for r in found) == np.cumsum([0, *[r["n_tokens"] for r in sorted(found, key=lambda r: r["start"])]])[:-1].tolist()
    sizes = [sum(np.load(f)["lengths"].shape[0] for f in Path(store.root.removeprefix("file:")).glob(f"index-*{n}*")) for n in store.names if n]
    assert store.null_parts == 10 and sum(sizes) == 600 and max(sizes) < 60


def test_store_of_nothing(spark, no_docs):
    store = keyed_ids.write_store(no_docs, scratch_path(spark, "ids"), FILES["byte_bpe_50k.json"])
    assert keyed_ids.find(spark, store, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=400))
def test_perfect_hash(keys):
    values = np.array(sorted(keys), np.int64)
    hashed = keyed_ids.PerfectHash.build(values)
    assert sorted(hashed.slots(values).tolist()) == list(range(len(values)))
