"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text machine.

How far the right context can reach is computed from the merge list. Run the merges, in order of rank, on a text and on
a prefix of it. The states agree up to a frontier that starts at the cut. A rule (a, b) moves it only if `a` ends there
and `b` follows in one run only, and then by the length of `a`, once. The next rule (a', b') that moves it needs a `b'` that
begins with `a`, so `a` lies on the left edge of the merge tree of `b'`, and ranks rise along such a chain. The longest
chain, counted in symbols of its left parts, is a sufficient lookahead: a token that ends that far before the cut is final.

Words pass through `WordTransducer`, which emits tokens once they are final and holds a bounded number of symbols. Where time is short, words
of up to ``ROW`` bytes, which end before the transducer's window is full, are merged together as rows of a matrix instead.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

ROW = 48
FEW = 64  # symbols up to which a scan for the lowest rank beats a heap
PIECE = 4096  # ids that the decoder is fed at a time
NONE = np.int32(2**31 - 1)

# Splitting rules of the two vocabularies (fixed values; they must equal those in the files).
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# White space by the Unicode property; Python's own also has four control characters more.
SPACE = r"\p{White_Space}"
MARKS = frozenset(".,;:!?")
WHITE = "\t\n\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: list[int]) -> int:
    """Symbols after a token's end that settle it, for merges (left, right, result) in order of rank."""
    made_by: dict[int, list[int]] = {}
    rank_made: dict[int, int] = {}
    for rank, (a, _, new) in enumerate(merges):
        made_by.setdefault(new, []).append(a)
        rank_made.setdefault(new, rank)
    if any(max(rank_made.get(a, -1), rank_made.get(b, -1)) >= rank for rank, (a, b, _) in enumerate(merges)):
        raise ValueError("a merge uses a token that a later merge makes")
    chain: dict[int, int] = {}

    def reach(token: int) -> int:
        most, todo, seen = 0, [token], set()
        while todo:
            t = todo.pop()
            if t not in seen:
                seen.add(t)
                most = max(most, chain.get(t, 0))
                todo += made_by.get(t, [])
        return most

    for a, b, _ in merges:
        chain[a] = max(chain.get(a, 0), length[a] + reach(b))
    return max(chain.values(), default=0)


class MergeTable:
    """Merges of a vocabulary file, for words given as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in characters], np.int32)
        self.suffix = suffix
        self.byte_of = {c: b for b, c in enumerate(characters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.lower_case = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        length = [0] * (max(self.text_of) + 1)
        for t, i in vocab.items():
            length[i] = len(t.removesuffix(suffix)) if suffix else len(t)
        self.lookahead = sufficient_lookahead(self.merges, length)
        self.rank = {}
        for r, (a, b, _) in enumerate(self.merges):
            self.rank.setdefault((a, b), r)
        self.result = np.array([n for _, _, n in self.merges], np.int32)
        # The same as Python's own numbers, for words that are merged one by one.
        self.results, self.inner_of, self.final_of = self.result.tolist(), self.inner.tolist(), self.final.tolist()
        self._build_hash()

    def _build_hash(self) -> None:
        self.bits = max(4, int(len(self.rank) * 6).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key = np.array([(a << 20) | b for a, b in self.rank], np.int64)
        value = np.array(list(self.rank.values()), np.int32)
        slot = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.ranks[slot[placed]] = key[placed], value[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the pair never merges or a side is padding (-1)."""
        key = (left.astype(np.int64) << 20) | right
        key = np.where((left < 0) | (right < 0), -2, key)
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], NONE)
        open_ = np.nonzero((there != key) & (there != -1) & (key != -2))
        while len(open_[0]):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            found = tuple(x[hit] for x in open_)
            out[found] = self.ranks[slot[found]]
            open_ = tuple(x[~hit & (there != -1)] for x in open_)
        return out

    def merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words given as rows of symbols, padded with -1; gives token rows and their lengths.

        Every row that is still open merges its leftmost pair of lowest rank in each round, so all shrink together.
        """
        n, width = rows.shape
        out, count = rows.copy(), (rows >= 0).sum(1)
        if width < 2:
            return out, count
        who, s = np.arange(n), rows
        r = self.pair_ranks(s[:, :-1], s[:, 1:])
        while len(who) and width > 1:
            at = r.argmin(1)
            rank = r[np.arange(len(who)), at]
            go = rank < NONE
            if not go.all():
                done = ~go
                out[who[done], :width] = s[done]
                out[who[done], width:] = -1
                who, s, r, at, rank = who[go], s[go], r[go], at[go], rank[go]
                if not len(who):
                    break
            line = np.arange(len(who))
            new = self.result[rank]
            width -= 1
            place = np.arange(width)[None, :]
            s = np.take_along_axis(s, place + (place > at[:, None]), 1)
            s[line, at] = new
            if width > 1:
                place = np.arange(width - 1)[None, :]
                r = np.take_along_axis(r, place + (place >= at[:, None]), 1)
                has = at > 0
                r[line[has], at[has] - 1] = self.pair_ranks(s[line[has], at[has] - 1], new[has])
                has = at < width - 1
                r[line[has], at[has]] = self.pair_ranks(new[has], s[line[has], at[has] + 1])
            count[who] -= 1
        if len(who):
            out[who, :width] = s[:, :width]
            out[who, width:] = -1
        return out, count

    def merge_list(self, symbols: list[int]) -> list[int]:
        """Merge one run of symbols, the leftmost pair of lowest rank first; with a heap of pairs if there are many."""
        s, n = list(symbols), len(symbols)
        if n <= FEW:
            return self._merge_few(s)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or self.rank.get((s[i], s[j])) != rank:
                continue
            s[i], alive[j], nxt[i] = self.results[rank], False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left in (prv[i], i):
                if left >= 0 and nxt[left] < n:
                    new = self.rank.get((s[left], s[nxt[left]]))
                    if new is not None:
                        heapq.heappush(heap, (new, left))
        return [t for t, a in zip(s, alive) if a]

    def _merge_few(self, s: list[int]) -> list[int]:
        known, results, none = self.rank.get, self.results, len(self.results)
        ranks = list(map(known, zip(s, s[1:]), repeat(none)))
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            s[i] = new = results[rank]
            del s[i + 1], ranks[i]
            if i:
                ranks[i - 1] = known((s[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = known((new, s[i + 1]), none)
        return s

    def encode_words(self, words: list[str], id_type: np.dtype) -> list[bytes]:
        """Ids, as bytes, of words that the splitting rule has cut."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list = [b""] * len(raw)
        order = np.argsort(size, kind="stable")
        low = 0
        for most in (2, 4, 6, 8, 10, 12, 16, 24, ROW):
            high = int(np.searchsorted(size[order], most, "right"))
            for start in range(low, high, 20_000):
                group = order[start : min(high, start + 20_000)]
                which = group.tolist()
                data = np.frombuffer(b"".join([raw[i].ljust(most, b"\0") for i in which]), np.uint8).reshape(-1, most)
                n = size[group]
                rows = np.where(np.arange(most)[None, :] < n[:, None], self.inner[data], np.int32(-1))
                some = np.nonzero(n)[0]
                rows[some, n[some] - 1] = self.final[data[some, n[some] - 1]]
                ids, count = self.merge_rows(rows)
                blob = ids[ids >= 0].astype(id_type).tobytes()
                begin = 0
                for i, end in zip(which, (np.cumsum(count) * id_type.itemsize).tolist()):
                    out[i] = blob[begin:end]
                    begin = end
            low = high
        for i in order[low:].tolist():
            machine = WordTransducer(self)
            ids = [t for k in range(0, len(raw[i]), 4096) for t in machine.feed(raw[i][k : k + 4096])]
            out[i] = np.array(ids + machine.end(), id_type).tobytes()
        return out


def transduced(table: MergeTable, words: list[str], id_type: np.dtype) -> list[bytes]:
    """Ids of words, each fed to a `WordTransducer` a piece at a time. Its end leaves the machine as new."""
    machine, ids, ends = WordTransducer(table), [], [0]
    for word in words:
        raw = word.encode()
        for k in range(0, len(raw), 4096):
            ids += machine.feed(raw[k : k + 4096])
        ids += machine.end()
        ends.append(len(ids) * id_type.itemsize)
    blob = np.array(ids, id_type).tobytes()
    return [blob[a:b] for a, b in zip(ends, ends[1:])]


class WordTransducer:
    """Encode one word that arrives in pieces of bytes; tokens leave once no later byte can change them."""

    def __init__(self, table: MergeTable):
        self.table, self.held, self.window = table, b"", table.lookahead + 256

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        out: list[int] = []
        while len(self.held) > self.window + 1:
            # The last byte held may turn out to end the word, so it isn't a symbol yet.
            part = self.held[: self.window]
            tokens = self.table.merge_list([self.table.inner_of[b] for b in part])
            end, done = 0, 0
            for t in tokens:
                n = self._bytes(t)
                if end + n + self.table.lookahead > len(part):
                    break
                end, done = end + n, done + 1
            out += tokens[:done]
            self.held = self.held[end:]
        return out

    def end(self) -> list[int]:
        if not self.held:
            return []
        inner = self.table.inner_of
        symbols = [inner[b] for b in self.held]
        symbols[-1] = self.table.final_of[self.held[-1]]
        self.held = b""
        return self.table.merge_list(symbols)

    def _bytes(self, token: int) -> int:
        text = self.table.text_of[token]
        return len(text.removesuffix(self.table.suffix)) if self.table.suffix else len(text)


class Decoder:
    """Ids to text, a piece at a time: a state machine that holds an unfinished character, or whether a gap is due."""

    def __init__(self, table: MergeTable):
        self.table, self.first = table, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        words = [self.table.text_of[i] for i in ids]
        if not words:
            return ""
        if not self.table.byte_decoder:  # the file names no decoder: tokens are joined by spaces
            gap, self.first = "" if self.first else " ", False
            return gap + " ".join(words)
        out = []
        for word in words:
            if all(c in self.table.byte_of for c in word):
                out.append(self.utf8.decode(bytes(self.table.byte_of[c] for c in word)))
            else:
                out.append(self.utf8.decode(word.encode()))
        return "".join(out)

    def end(self) -> str:
        return self.utf8.decode(b"", True) if self.table.byte_decoder else ""


def _laid_out(values: list[bytes], index: pa.Array, cut: np.ndarray) -> list[bytes]:
    """The values that ``index`` names, joined between the places in ``cut``."""
    taken = pa.array(values, pa.large_binary()).take(index)
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1][cut].tolist()
    data = memoryview(taken.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


def lower_case(text: str) -> str:
    """Each character by itself, so that a final capital sigma becomes the plain one."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class Codec:
    """Encodes whole texts. Chunks between spaces never share a token, so the ids of recent chunks are remembered.

    At most ``remember`` chunks are held in each of two generations, whatever the input. New words pass through the transducer, or, unless
    ``streamed``, short ones are merged together as the rows of a matrix, which gives the same ids.
    """

    def __init__(self, path: str, id_type: str = "<u4", decode: bool = False, remember: int = 500_000, streamed: bool = False):
        self.table = MergeTable(path)
        self.id_type, self.decode, self.remember, self.streamed = np.dtype(id_type), decode, remember, streamed
        self.pieces = regex.compile((WORD_PIECES if self.table.lower_case else BYTE_PIECES).replace(r"\s", SPACE).replace(r"\S", r"\P{White_Space}"))
        if not all(t.startswith("<|") for t in self.table.special):
            raise ValueError("special tokens must begin with <|")
        self.special = re.compile("|".join(map(re.escape, self.table.special)) or r"(?!)")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """Cut by the splitting rule. A word of letters, bare or before one mark, needs no look at the rule."""
        if self.table.lower_case:
            text = text.lower() if text.isascii() else lower_case(unicodedata.normalize("NFC", text))
            word = text
        else:
            word = text[1:] if text.startswith(" ") else text
        if word.isalpha():
            return [text]
        if word[-1:] in MARKS and word[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.pieces.findall(text)

    def _encode_new(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens; pieces that several texts share are merged once."""
        place: dict[str, int] = {}
        cut: list = []
        for text in texts:
            pieces = self._pieces(text)
            if len(pieces) == 1:
                cut.append(place.setdefault(pieces[0], len(place)))
            else:
                cut.append([place.setdefault(p, len(place)) for p in pieces])
        ids = transduced(self.table, list(place), self.id_type) if self.streamed else self.table.encode_words(list(place), self.id_type)
        return [ids[c] if type(c) is int else b"".join([ids[x] for x in c]) for c in cut]

    def _shown(self, ids: bytes) -> bytes:
        """What one decoder gives for a whole text's ids, fed a piece at a time."""
        machine, values = Decoder(self.table), np.frombuffer(ids, self.id_type)
        shown = [machine.feed(values[k : k + PIECE].tolist()) for k in range(0, len(values), PIECE)]
        return ("".join(shown) + machine.end()).encode()

    def _text_of(self, chunk: str) -> str:
        """The text that a chunk stands for: byte-level ones carry the space before them, but for a text's first."""
        if self.table.lower_case:
            return chunk
        return chunk[1:] if chunk.startswith("\x00") else " " + chunk

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks, remembered or new."""
        if len(self.young) + len(chunks) > self.remember:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for c in chunks:
            if c not in young:
                if c in old:
                    young[c] = old[c]
                else:
                    new.append(c)
        for c, ids in zip(new, self._encode_new([self._text_of(c) for c in new])):
            young[c] = ids
        return [young[c] for c in chunks]

    def _plain(self, text: str) -> bool:
        """True if the ids of the chunks between spaces, one after the other, are those of the text."""
        if "<|" in text and self.special.search(text):
            return False
        if self.table.lower_case:
            return True
        # Where white space stands on both sides of a space, the space may belong to either.
        return not ("  " in text or text[-1:] == " " or "\x00" in text or any(w in text and w + " " in text for w in WHITE))

    def _slow(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._encode_new([text[at : m.start()]])
            out.append(np.array([self.table.special[m[0]]], self.id_type).tobytes())
            at = m.end()
        return b"".join(out + self._encode_new([text[at:]]))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as bytes and, if asked for, the decoded text in UTF-8."""
        out: list = [(b"", b"")] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if text and self._plain(text):
                plain.append(i)
            elif text:
                ids = self._slow(text)
                out[i] = (ids, self._shown(ids) if self.decode else b"")
        if not plain:
            return out
        # A first word has no space before it; the mark keeps it apart from the same word elsewhere.
        mark = "" if self.table.lower_case else "\x00"
        chunks = pc.split_pattern(pa.array([mark + texts[i] for i in plain], pa.large_string()), pattern=" ")
        cut = chunks.offsets.to_numpy()
        coded = chunks.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = _laid_out(self._known(words), coded.indices, cut)
        for i, raw in zip(plain, ids):
            out[i] = (raw, self._shown(raw) if self.decode else b"")
        return out

    def encode_stream(self, pieces: Iterable[str]) -> Iterator[int]:
        """Ids of a text that arrives in pieces. Text is held back to the last space that surely ends a chunk."""
        held = ""
        safe = regex.compile(rf"(?s).*\P{{White_Space}}(?= \P{{White_Space}})")
        for piece in pieces:
            held += piece
            # A special token holds no space, so none is cut; one that may still grow stays in the held part.
            if m := safe.match(held):
                yield from np.frombuffer(self._slow(held[: m.end()]), self.id_type).tolist()
                held = held[m.end() :]
        yield from np.frombuffer(self._slow(held), self.id_type).tolist()


@lru_cache(maxsize=2)
def codec(path: str, id_type: str = "<u4", decode: bool = False, streamed: bool = False) -> Codec:
    """One codec per Python worker. Streamed ones also decode, beside which fewer chunks are remembered."""
    return Codec(path, id_type, decode, remember=200_000 if streamed else 500_000, streamed=streamed)
