"""Token alignment against the two libraries on whole texts and plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from phenoline.llm import token_alignment
from phenoline.llm.bpe import byte_characters
from phenoline.llm.fragments import EMPTY, Aligned, TokenPair, compose, fragments

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY_A, LIBRARY_B = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
LIBRARY_A.encode_special_tokens = True
BYTE_OF = {c: b for b, c in enumerate(byte_characters())}
PAIR = TokenPair(A, B)
PARTS = list("abcdeAzZ'sStTre   \n\t.,!?-0123éÉßΣ🙂中文́\x1c\x85\xa0▁") + ["  ", "<|endoftext|>", "<s>", "<0x41>", " the", " token", "'re", "\x00"]


def plain_tokens(text):
    """Ids and bytes of whole texts by the libraries; none if the bytes don't fit."""
    if not text:
        return [], [], [], []
    a = LIBRARY_A.encode(" " + text, add_special_tokens=False).ids
    b = LIBRARY_B.encode(text)
    bytes_a = [bytes(BYTE_OF[c] for c in LIBRARY_A.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(LIBRARY_B.id_to_piece(i)[3:5], 16)]) if LIBRARY_B.is_byte(i) else LIBRARY_B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    return (a, b, bytes_a, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else ([], [], [], [])


def ends(parts):
    return np.cumsum([0, *map(len, parts)]).tolist()


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    seen, counts = [], Counter()
    for text in texts:
        a, b, x, y = plain_tokens(text)
        ea, eb = ends(x), ends(y)
        links = []
        j = 0
        for i in range(len(a)):
            while eb[j + 1] <= ea[i]:
                j += 1
            k = j
            while k < len(b) and eb[k] < ea[i + 1]:
                links.append((a[i], b[k]))
                k += 1
        common = sorted(set(ea[1:]) & set(eb[1:]))
        parts = []
        ia = ib = 0
        for high in common:
            left, right = [], []
            while ia < len(a) and ea[ia + 1] <= high:
                left.append(str(a[ia]))
                ia += 1
            while ib < len(b) and eb[ib + 1] <= high:
                right.append(str(b[ib]))
                ib += 1
            parts.append(",".join(left) + "|" + ",".join(right))
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""
        seen.append((len(a), len(b), len(parts), links, digest))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), d) for na, nb, ng, links, d in seen]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=50).map("".join), st.integers(1, 9))
def test_tokens_and_pieces(text, size):
    a, b, _, _ = plain_tokens(text)
    (x, y, ok), = PAIR.encode([text])
    assert ok == bool(a)
    if ok:
        assert (x.tolist(), y.tolist()) == (a, b)
    pieces = list(PAIR.pieces(text, size))
    assert " ".join(p for _, p in pieces) == text
    parts = PAIR.encode([p for _, p in pieces])
    assert all(p[2] for p in parts) == ok
    if ok:
        assert np.concatenate([p[0] for p in parts]).tolist() == a and np.concatenate([p[1] for p in parts]).tolist() == b


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=60).map("".join), st.integers(1, 30), st.randoms())
def test_fragments_compose(text, size, rnd):
    """In any order of composing, fragments of any size make up the groups of the whole."""
    (a, b, ok), = PAIR.encode([text])
    if not ok:
        return
    parts = [f for _, f in fragments(a, b, PAIR.a_len, PAIR.b_len, 0, size)]
    parts.insert(rnd.randrange(len(parts) + 1), EMPTY)
    while len(parts) > 1:
        i = rnd.randrange(len(parts) - 1)
        parts[i : i + 2] = [compose(parts[i], parts[i + 1])]
    whole = parts[0]
    closed = [whole.prefix, *whole.groups]
    assert whole.cut and not len(whole.suffix[0]) and not len(whole.suffix[1])
    assert np.concatenate([g[0] for g in closed]).tolist() == a.tolist() and np.concatenate([g[1] for g in closed]).tolist() == b.tolist()
    made = [";".join(Aligned(*g, PAIR.a_len, PAIR.b_len).text()[0].tobytes().decode().split(";")[:-1]) for g in closed]
    text_, _ = Aligned(a, b, PAIR.a_len, PAIR.b_len).text()
    assert ";".join(made) + ";" == text_.tobytes().decode()


@pytest.mark.parametrize("chunk, block, fan", [(1 << 16, 1 << 23, 16), (40, 3000, 2)])
def test_documents(spark, monkeypatch, chunk, block, fan):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("FAN", fan)):
        monkeypatch.setattr(token_alignment, name, value)
    rnd = random.Random(11)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randrange(1, 120))) for _ in range(150)]
    texts += [None, "", " ", "a" * 700, "words " * 90, "中" * 90, " " * 200, "x" * 300 + " ▁ " + "y " * 40, texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, row string, block string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_alignment.align(docs, A, B).collect()}
    for i, want in enumerate(plain(texts)):
        assert got[i] == want, (i, texts[i])


def test_odd_input(spark, odd_docs, no_docs):
    assert token_alignment.align(no_docs, A, B).count() == 0
    rows = odd_docs.collect()
    want = plain([r["text"] for r in rows])
    got = token_alignment.align(odd_docs, A, B).collect()
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted([(r["doc_id"], *w) for r, w in zip(rows, want)], key=key)
