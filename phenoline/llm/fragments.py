"""Two tokenizers over the same bytes: tokens of whole texts, and fragments of their alignment that compose.

Offsets where tokens of both end cut the tokens into groups. A *fragment* covers any range of a document's bytes and has the tokens that
end in it: an open prefix, up to the first common end; closed groups; and an open suffix, behind the last common end. Tokens whose
ends are equal lie in the same fragment, so no common end is missed at a border, and composing needs ids alone: the left suffix and
the right prefix make one closed group. That is associative, with the fragment of no tokens as its identity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from sentencepiece import SentencePieceProcessor

from phenoline.llm.bpe import Codec

SOLID = r"[!-~\w]"  # characters that are white space in no tokenizer
SAFE = re.compile(rf"(?<={SOLID}) (?={SOLID})")
REMEMBERED = 100_000  # words of A whose ids a worker keeps


class TokenPair:
    """Tokenizer A (byte-level BPE) on a space and the text, tokenizer B (pieces with byte fallback) on the text.

    Strings of special tokens in a text are plain text. Where a single space stands between characters that are no white space, a token of
    either may begin there but none may go across: A splits words there, and no piece of B has a space behind another character. So long texts can
    be cut there. With a B that has such pieces they stay whole.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a = Codec(a_path, "<u4", remember=REMEMBERED)
        self.a.special = re.compile(r"(?!)")
        self.b = SentencePieceProcessor(model_file=b_path)
        table = self.a.table
        if table.lower_case or table.suffix:
            raise ValueError("tokenizer A must be byte-level")
        self.a_len = np.zeros(max(table.text_of) + 1, np.int64)
        for i, token in table.text_of.items():
            self.a_len[i] = len(token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of both for each text, and whether the bytes of both are those of a space and the text."""
        spaced = [" " + t for t in texts]
        out = []
        for whole, (raw, _), ids in zip(spaced, self.a.encode(spaced), self.b.encode(texts, num_threads=1)):
            a, b = np.frombuffer(raw, np.uint32), np.array(ids, np.uint32)
            data = whole.encode()
            # A's tokens stand for bytes one by one, so their number tells all.
            fits = int(self.a_len[a].sum()) == len(data) and b"".join([self.b_bytes[i] for i in ids]) == data
            out.append((a, b, fits))
        return out

    def pieces(self, text: str, size: int) -> Iterator[tuple[int, str]]:
        """Cut a text into pieces of at least ``size`` characters that can be encoded by themselves; yields (place in characters, text)."""
        at = 0
        while self.cuts and len(text) - at > size and (cut := SAFE.search(text, at + size)):
            yield at, text[at : cut.start()]
            at = cut.end()
        yield at, text[at:]


@lru_cache(maxsize=2)
def token_pair(a_path: str, b_path: str) -> TokenPair:
    return TokenPair(a_path, b_path)


class Aligned:
    """Links and groups of tokens ``a`` and ``b`` that cover the same bytes; both may be many texts put together."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray):
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        ends_a, ends_b = np.cumsum(a_len[a]), np.cumsum(b_len[b])
        n = int(ends_a[-1]) + 1 if len(a) else 1
        at_a, at_b = np.zeros(n, np.int8), np.zeros(n, np.int8)
        at_a[ends_a], at_b[ends_b] = 1, 1
        self.closes_a, self.closes_b = at_b[ends_a] == 1, at_a[ends_b] == 1
        before_a, before_b = np.cumsum(at_a, dtype=np.int32), np.cumsum(at_b, dtype=np.int32)
        # A token overlaps the first one of the other that ends where it ends or later.
        self.b_of_a = before_b[ends_a] - self.closes_a
        self.a_of_b = before_a[ends_b] - self.closes_b

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The links: one at the end of each A token, and one at the end of each B token where no A token ends.

        Returns the pairs (A id << 32 | B id) of the first and of the second kind, and the B tokens of the second kind.
        """
        open_ = np.flatnonzero(~self.closes_b)
        first = (self.a << 32) | self.b[self.b_of_a]
        return first, (self.a[self.a_of_b[open_]] << 32) | self.b[open_], open_

    def text(self) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` as bytes, and where the part of each B token ends."""
        last_a, last_b = np.flatnonzero(self.closes_a) + 1, np.flatnonzero(self.closes_b) + 1
        group_a = np.cumsum(self.closes_a) - self.closes_a
        group_b = np.cumsum(self.closes_b) - self.closes_b
        place_a = np.arange(len(self.a)) + np.concatenate([[0], last_b])[group_a]
        place_b = np.arange(len(self.b)) + last_a[group_b]
        ids, mark = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a] = np.where(self.closes_a, ord("|"), ord(","))
        mark[place_b] = np.where(self.closes_b, ord(";"), ord(","))
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(0, np.int64)
        shown, used = decimals(len(str(int(ids.max()))))
        cells, keep = shown[ids], used[ids]
        cells[:, -1] = mark
        return cells[keep], np.cumsum(keep.sum(1))[place_b]


@lru_cache(maxsize=4)
def decimals(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of up to ``width`` digits as text, right-aligned before one free place, and which places are used."""
    numbers = np.arange(10**width)
    powers = 10 ** np.arange(width - 1, -1, -1)
    shown = (numbers[:, None] // powers % 10 + ord("0")).astype(np.uint8)
    used = (numbers[:, None] >= powers) | (powers == 1)
    return np.pad(shown, ((0, 0), (0, 1))), np.pad(used, ((0, 0), (0, 1)), constant_values=True)


NO_IDS = np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Fragment:
    """``cut``: a common end lies in it. ``groups``: its closed tokens, as (A ids, B ids) in order. Without a cut all tokens are prefix."""

    cut: bool
    prefix: tuple[np.ndarray, np.ndarray]
    groups: tuple[tuple[np.ndarray, np.ndarray], ...]
    suffix: tuple[np.ndarray, np.ndarray]


EMPTY = Fragment(False, (NO_IDS, NO_IDS), (), (NO_IDS, NO_IDS))


def joined(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if not y.cut:
        return Fragment(True, x.prefix, x.groups, joined(x.suffix, y.prefix)) if x.cut else Fragment(False, joined(x.prefix, y.prefix), (), y.suffix)
    if not x.cut:
        return Fragment(True, joined(x.prefix, y.prefix), y.groups, y.suffix)
    return Fragment(True, x.prefix, (*x.groups, joined(x.suffix, y.prefix), *y.groups), y.suffix)


def fragments(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray, start: int, size: int) -> Iterator[tuple[int, Fragment]]:
    """Cut tokens that begin at byte ``start`` by the ends they have into the byte ranges of ``size``; yields (number of the range, fragment)."""
    ends_a, ends_b = start + np.cumsum(a_len[a]), start + np.cumsum(b_len[b])
    if not len(a) or not len(b):
        return
    for k in range(start // size, int(max(ends_a[-1], ends_b[-1]) - 1) // size + 1):
        i, j = np.searchsorted(ends_a, [k * size + 1, (k + 1) * size + 1]).tolist()
        p, q = np.searchsorted(ends_b, [k * size + 1, (k + 1) * size + 1]).tolist()
        both = np.intersect1d(ends_a[i:j], ends_b[p:q], assume_unique=True)
        if not len(both):
            yield k, Fragment(False, (a[i:j], b[p:q]), (), (NO_IDS, NO_IDS))
            continue
        i1, i2 = (np.searchsorted(ends_a, [both[0], both[-1]]) + 1).tolist()
        p1, p2 = (np.searchsorted(ends_b, [both[0], both[-1]]) + 1).tolist()
        closed = ((a[i1:i2], b[p1:p2]),) if i2 > i1 else ()
        yield k, Fragment(True, (a[i:i1], b[p:p1]), closed, (a[i2:j], b[p2:q]))
