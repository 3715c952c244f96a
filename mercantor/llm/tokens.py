"""Exact token ids of many texts: every distinct piece of a task's texts goes through the tokenizer once.

A piece is a run of ASCII white space with the run of other bytes after it, cut again where an ASCII letter is
followed by an ASCII mark.  A byte-level pre-tokenizer never joins across the end of such a piece and never looks
beyond it, so a text's ids are its pieces' ids in a row.
Two kinds of text are odd: those with other Unicode white space, which may reach across pieces, and those that
contain a special token's string.  They are cut only where an ASCII mark, letter or digit is followed by ASCII white
space, which ends a token whatever stands elsewhere.  Pieces are known by their 64-bit hashes.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from .kernels import U64, VISIBLE, Texts, Words, byte_class

#: Pieces that a worker remembers.  Beyond that it forgets all and starts again; results are the same.
MOST_PIECES = 2_000_000
#: A piece that is one or two pre-tokens for certain: white space taken by the word, Latin letters, marks.
_PLAIN = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
_MARK = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters stand for
    themselves, the others get the letters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """The tokenizer of a JSON file, with its cache of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        #: Whether odd texts may be cut at white space: no special token has any.
        self.parts = not any(re.search(r"\s", t) for t in self.special)
        kind = spec.get("pre_tokenizer") or {}
        #: Whether pieces are independent: a byte-level BPE with nothing before it.
        self.by_piece = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and not spec.get("normalizer")
        self.letters = {b: ord(c) for b, c in byte_letters().items()}
        self.space = chr(self.letters[0x20])
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, U64), np.zeros(0, np.int32)
        self.starts, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, self.type), 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, text: str) -> list[int] | None:
        if text.isascii():  # ASCII letters stand for themselves, and a space before them for its own letter
            spaced = text[0] == " "
            if (text[1:] if spaced else text).isalpha():
                return [t.id for t in self.model.tokenize(self.space + text[1:] if spaced else text)]
        if not (m := _PLAIN.fullmatch(text)):
            return None
        out: list[int] = []
        for part in m.groups():
            if part:
                out += [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        return out

    def payload(self, pieces: list[str]) -> list[list[int]]:
        """What the cache keeps of each piece: its ids."""
        out = [self._known(r) if self.by_piece else None for r in pieces]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.whole([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def odd(self, texts: Texts) -> np.ndarray:
        """Texts that aren't the sum of their pieces, or may not be."""
        if not self.by_piece:
            return np.ones(texts.n, bool)
        d = texts.data
        places = []
        if len(d) > 1:
            a, b = d[:-1], d[1:]
            places.append(np.flatnonzero((a == 0xC2) & ((b == 0xA0) | (b == 0x85))))
            wide = np.flatnonzero((a >= 0xE1) & (a <= 0xE3))
            wide = wide[wide + 2 < len(d)]
            x, y, z = d[wide], d[wide + 1], d[wide + 2]
            general = (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
            places.append(wide[general | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))])
        raw = d.tobytes()
        for s in self.special:
            places.append(np.array([m.start() for m in re.finditer(re.escape(s.encode()), raw)], np.int64))
        out = np.zeros(texts.n, bool)
        if places:
            out[np.searchsorted(texts.offsets, np.concatenate(places), "right") - 1] = True
        return out

    def pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, text numbers) of all pieces in order."""
        low, high = texts.offsets[:-1], texts.offsets[1:]
        starts = [low[high > low]]
        if self.by_piece:
            odd, words = self.odd(texts), Words(texts, VISIBLE)
            last = words.ends - 1
            border = ~odd[words.text] | ((texts.data[last] < 0x80) & self.parts)
            starts.append(words.ends[border & (words.ends < high[words.text])])
            cuts = np.flatnonzero(_LETTER[texts.data[:-1]] & _MARK[texts.data[1:]]) + 1
            own = np.searchsorted(texts.offsets, cuts, "right") - 1
            starts.append(cuts[~odd[own] & (cuts > low[own])])
        s = np.concatenate(starts)
        s.sort()
        t = np.searchsorted(texts.offsets, s, "right") - 1
        e = np.empty_like(s)
        e[:-1] = s[1:]
        if len(s):
            e[-1] = high[t[-1]]
        return s, np.minimum(e, high[t]), t.astype(np.int32)

    def slots_of(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each piece's number in the cache, where new ones are put first."""
        hashes = texts.hashes(starts, ends)
        unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > MOST_PIECES:
            self.forget()
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            first = len(self.starts) - 1
            raw = [texts.data[a:b].tobytes().decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            ids = self.payload(raw)
            counts = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((v for x in ids for v in x), self.type, int(counts.sum()))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts)])
            self.used += len(flat)
            self.keys, self.slots = np.insert(self.keys, place[new], unique[new]), np.insert(self.slots, place[new], np.arange(first, first + len(new), dtype=np.int32))
            place = np.searchsorted(self.keys, unique)
        return self.slots[place][back]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of each text's ids)."""
        s, e, t = self.pieces(texts)
        slots = self.slots_of(texts, s, e)
        low, n = self.starts[slots], self.starts[slots + 1] - self.starts[slots]
        ends = np.cumsum(n)
        at = np.repeat(low - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[at], np.bincount(t, weights=n, minlength=texts.n).astype(np.int64)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)
