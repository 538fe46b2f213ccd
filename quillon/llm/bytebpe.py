"""Ids of a byte-level BPE, as the tokenizers library gives them, for whole columns of texts.

The vocabulary's pattern cuts a text into words, which are encoded apart. In texts of ASCII and
Latin-1 letters the cuts follow from the classes of neighbouring bytes, for all texts of a batch at
once; words are sought in a table by their bytes (not by a hash alone) and only new ones go to
the library's model. Other texts are cut before blanks that no white space stands beside, where the
pattern never joins, and their strings are encoded by the library and kept. A text that has a
special string of the vocabulary, or an odd blank, goes to the library whole.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa

from . import kernel as k
from .tokencount import byte_alphabet

_LETTER, _DIGIT, _OTHER, _WHITE, _BLANK, _NONE = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58], _CLASS[9:14], _CLASS[32] = _DIGIT, _WHITE, _BLANK
_FOREIGN = np.zeros(256, bool)
_FOREIGN[0xC0:] = True
_FOREIGN[0xC3] = False
#: A blank with white space, or what may be some, on both sides.
_ODD = re.compile(rb"[\t-\r \x80-\xff] (?:[\t-\r \xc2\xe1-\xe3]|$)")
#: Words of at most so many bytes are in the table.
WIDTH = 24
_KEEP = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)
SLOTS = 20
#: Bytes of text that are cut at once.
PIECE = 1 << 20


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a word of the pattern begins, in texts of ASCII and Latin-1 letters."""
    n = len(data)
    kind = _CLASS[data]
    sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    kind[sign] = kind[sign + 1] = _OTHER
    before, after = np.full(n, _NONE, np.uint8), np.full(n, _NONE, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    head = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[head], after[offsets[1:][offsets[1:] > 0] - 1] = _NONE, _NONE
    white, white_before = kind >= _WHITE, (before == _WHITE) | (before == _BLANK)
    # a blank goes with the word after it; of other white space the last before a word stands alone
    start = np.where(white, ~white_before | (after < _WHITE), np.where(white_before, before == _WHITE, kind != before))
    start[head] = True
    at = np.flatnonzero(start & (data == 0x27) & (after == _LETTER))
    if len(at):
        wide = np.concatenate((data, np.zeros(3, np.uint8)))
        ends = offsets[np.searchsorted(offsets, at, "right")]
        one = np.isin(wide[at + 1], list(b"stmd"))
        pair = wide[at + 1].astype(np.int64) << 8 | wide[at + 2]
        two = np.isin(pair, [int.from_bytes(s, "big") for s in (b"re", b"ve", b"ll")]) & (at + 2 < ends)
        size = np.where(one, 2, np.where(two, 3, 0))
        start[at[size > 0] + 1] = False
        over = (at + size)[(size > 0) & (at + size < ends)]
        start[over] = True
    return np.flatnonzero(start)


class _Kept(dict):
    """Strings to bytes of their ids; ``learn`` finds those that are not known."""

    def __missing__(self, key):
        found = self[key] = self.learn(key)
        return found


class Encoder:
    #: Strings and ids kept; then all are sought again.
    KEEP, POOL = 300_000, 8 << 20

    def __init__(self, definition: str, plain_special: bool = False):
        """``plain_special``: strings of special tokens in a text are text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = plain_special
        parts = json.loads(definition)
        pre = parts["pre_tokenizer"] or {}
        #: Whether the pattern is the one that this class knows.
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not parts["normalizer"] and not any(a[c] for a in parts["added_tokens"] for c in ("lstrip", "rstrip", "single_word"))
        self.special = [] if plain_special else [t["content"].encode() for t in parts["added_tokens"]]
        small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.code, self.kind = ("H", np.dtype("<u2")) if small else ("I", np.dtype("<u4"))
        letters = {b: c for c, b in byte_alphabet().items()}
        self.alphabet = {b: letters[b] for b in range(256)}
        self._clear()

    def _clear(self) -> None:
        # two tables; a word is in one of them
        self.keys = np.zeros((2, 3, 1 << SLOTS), np.uint64)
        self.size = np.zeros((2, 1 << SLOTS), np.uint8)
        self.at, self.number = np.zeros((2, 1 << SLOTS), np.int32), np.zeros((2, 1 << SLOTS), np.int32)
        self.pool = array(self.code, [0])
        self.strings = _Kept()
        self.strings.learn = lambda raw: self.whole(raw.decode())

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library."""
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, words: list[bytes]) -> np.ndarray:
        """Places and numbers, in the pool, of the ids of words that the pattern does not divide."""
        tokenize, alphabet, pool, out = self.tokenizer.model.tokenize, self.alphabet, self.pool, []
        for raw in words:
            out.append(len(pool))
            pool.extend([t.id for t in tokenize(raw.decode("latin-1").translate(alphabet))])
        ends = np.array([*out, len(pool)], np.int64)
        return np.stack((ends[:-1], np.diff(ends)))

    def _found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each byte range."""
        wide = np.concatenate((data, np.zeros(WIDTH, np.uint8)))
        eight = np.lib.stride_tricks.as_strided(wide[:8].view("<u8"), (len(data) + WIDTH - 7,), (1,))
        size = ends - starts
        keys = [eight[starts + 8 * i] & _KEEP[np.clip(size - 8 * i, 0, 8)] for i in range(3)]
        h = k.mix(keys[0] + k.mix(keys[1] + k.mix(keys[2] + size.astype(np.uint64))))
        slots = [(h >> np.uint64(64 - SLOTS)).astype(np.int64), (h & np.uint64((1 << SLOTS) - 1)).astype(np.int64)]
        at, n, miss = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.arange(len(size))
        for t, slot in enumerate(slots):
            slot = slot[miss]
            hit = (self.size[t, slot] == size[miss]) & (size[miss] <= WIDTH)
            for mine, key in zip(self.keys[t], keys, strict=True):
                hit &= mine[slot] == key[miss]
            at[miss[hit]], n[miss[hit]] = self.at[t, slot[hit]], self.number[t, slot[hit]]
            miss = miss[~hit]
        if len(miss):
            raw = data.tobytes()
            of = lambda some: [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            short = miss[size[miss] <= WIDTH]
            _, first, back = np.unique(h[short], return_index=True, return_inverse=True)
            one = short[first]
            at[one], n[one] = self._words(of(one))
            full = (self.size[0, slots[0][one]] > 0).astype(np.int64)
            place = np.where(full, slots[1][one], slots[0][one])
            self.size[full, place], self.at[full, place], self.number[full, place] = size[one], at[one], n[one]
            for i, key in enumerate(keys):
                self.keys[full, i, place] = key[one]
            like = one[back]
            at[short], n[short] = at[like], n[like]
            same = size[short] == size[like]
            for key in keys:
                same &= key[short] == key[like]
            rest = np.concatenate((short[~same], miss[size[miss] > WIDTH]))
            at[rest], n[rest] = self._words(of(rest))
        return at, n

    def _odd(self, raw: bytes) -> bytes:
        if not raw:
            return b""
        if not self.by_word or _ODD.search(raw) or any(s in raw for s in self.special):
            return self.whole(raw.decode())
        # each blank goes with the string after it
        first, *rest = raw.split(b" ")
        get = self.strings.__getitem__
        return b"".join([get(first) if first else b"", *[get(b" " + s) for s in rest]])

    def many(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column; nulls are empty."""
        data, offsets = k.buffers(column)
        out: list[np.ndarray] = []
        for _, _, d, o in k.pieces(data, offsets, PIECE):
            if len(self.pool) > self.POOL or len(self.strings) > self.KEEP:
                self._clear()
            raw, count = d.tobytes(), len(o) - 1
            plain = np.full(count, bool(self.by_word))
            plain[np.searchsorted(o, np.flatnonzero(_FOREIGN[d]), "right") - 1] = False
            if any(s in raw for s in self.special):
                plain &= [not any(s in raw[a:b] for s in self.special) for a, b in zip(o, o[1:], strict=False)]
            starts = word_starts(d, o) if len(d) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(d)) if len(starts) else starts
            owner = np.searchsorted(o, starts, "right") - 1
            good = plain[owner]
            starts, ends, owner = starts[good], ends[good], owner[good]
            at, n = self._found(d, starts, ends) if len(starts) else (starts, starts)
            before = np.concatenate(([0], np.cumsum(n)))
            ids = np.frombuffer(self.pool, self.kind)[np.repeat(at - before[:-1], n) + np.arange(before[-1])]
            places = before[np.searchsorted(owner, np.arange(count + 1))].tolist()
            some = [ids[a:b] for a, b in zip(places, places[1:], strict=False)]
            for i in np.flatnonzero(~plain).tolist():
                some[i] = np.frombuffer(self._odd(raw[o[i] : o[i + 1]]), self.kind)
            out += some
        return out


_encoders: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One for each worker process and definition; its words live on between tasks."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]
