"""Array kernels over Arrow text columns: words, word hashes and window hashes of many texts at once.

A column's UTF-8 bytes are handled as one numpy array, about a megabyte at a time (`texts_of`).  A longer text is a
slice by itself; its words are hashed a slice at a time too, so it costs a few bytes a byte and not dozens.  Null
texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0xD6E8FEB86659FD95 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
#: One odd multiplier for each place in a window.
PLACE = _random.integers(1, 1 << 63, 4096, dtype=U64) * U64(2) + U64(1)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
NO_FOLD = np.arange(256, dtype=np.uint8)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Words of visible characters: anything but the six ASCII white-space characters.
VISIBLE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of letters and digits: 0-9, a-z and everything beyond ASCII, after folding A-Z.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class _Powers:
    up = down = np.ones(1, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if n > 4 * SLICE_BYTES:  # one huge text: not worth keeping
                return up, down
            cls.up, cls.down = up, down
        return cls.up, cls.down


class Texts:
    """Some consecutive texts: their bytes, and the offsets of each (one more than there are texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1
        self._sums: np.ndarray | None = None

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def sums(self, fold: np.ndarray = NO_FOLD) -> np.ndarray:
        """Running polynomial sums of the bytes, from which `hashes` reads the hash of any span."""
        if self._sums is None:
            self._sums = _sums(self.data, fold)
        return self._sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = NO_FOLD) -> np.ndarray:
        """A hash of each span's bytes; of long texts the spans, which must not overlap then, are taken a slice at a time."""
        if len(self.data) <= 4 * SLICE_BYTES:
            return _hashes(self.sums(fold), starts, ends)
        out = np.empty(len(starts), U64)
        at = 0
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, low + SLICE_BYTES, "right")))
            if int(ends[to - 1]) - low > SLICE_BYTES:
                out[at] = _long_hash(self.data[low : ends[at]], fold)
            else:
                out[at:to] = _hashes(_sums(self.data[low : ends[to - 1]], fold), starts[at:to] - low, ends[at:to] - low)
            at = to
        return out


def _sums(data: np.ndarray, fold: np.ndarray) -> np.ndarray:
    up, _ = _Powers.of(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[fold][data] * up[: len(data)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _Powers.of(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def _long_hash(data: np.ndarray, fold: np.ndarray) -> int:
    """The hash of one span of any length, a slice at a time."""
    total, step = 0, pow(_BASE, SLICE_BYTES, 1 << 64)
    power = 1
    for at in range(0, len(data), SLICE_BYTES):
        total += int(_sums(data[at : at + SLICE_BYTES], fold)[-1]) * power
        power = power * step & (1 << 64) - 1
    return int(mixed(np.array([(total + len(data)) & (1 << 64) - 1], U64))[0])


_TRIM_EVERY = 64 << 20
_seen = 0


def _trim(n: int) -> None:
    """Gives freed memory back to the system now and then, so an idle worker holds little beside its next user."""
    global _seen
    _seen += n
    if _seen >= _TRIM_EVERY:
        _seen = 0
        pa.default_memory_pool().release_unused()
        if _LIBC is not None:
            _LIBC.malloc_trim(0)


def _libc():
    import ctypes

    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    a = batch.column(batch.schema.get_field_index(name))
    return a.cast(pa.large_string()) if not pa.types.is_large_string(a.type) else a


def texts_of(a: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow column in slices of about ``most`` bytes; a longer text is a slice by itself."""
    if not pa.types.is_large_string(a.type):
        a = a.cast(pa.large_string())
    if not len(a):
        return
    if a.null_count:
        a = a.fill_null("")
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        low = offsets[at]
        yield Texts(data[low : offsets[to]], offsets[at : to + 1] - low, at)
        at = to
    _trim(int(offsets[-1] - offsets[0]))


class Words:
    """The words of some texts: byte spans, and the first word of each text (one more than there are texts)."""

    def __init__(self, texts: Texts, kind: np.ndarray, fold: np.ndarray = NO_FOLD):
        self.texts, self.fold = texts, fold
        inside = kind[fold][texts.data]
        before = np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            cuts = texts.offsets[:-1]
            before[cuts[cuts < len(inside)]] = False  # a text begins a word of its own
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        if len(inside):
            after[-1], after[:-1] = False, inside[1:]
            cuts = texts.offsets[1:]
            after[cuts[cuts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(texts.n, dtype=np.int32), self.counts)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.texts.hashes(self.starts, self.ends, self.fold)
        return self._hashes

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first words of all windows of n words inside one text, and the windows' hashes."""
        m = len(self.starts) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.text[:m] == self.text[n - 1 :])
        total = np.full(m, U64(n))
        for k in range(n):
            total += self.hashes[k : k + m] * PLACE[k % len(PLACE)]
        return at, mixed(total[at])

    def word(self, i: int) -> bytes:
        return self.fold[self.texts.data[self.starts[i] : self.ends[i]]].tobytes()

    def window(self, i: int, n: int) -> bytes:
        return b" ".join(self.word(k) for k in range(i, i + n))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive word hashes, from running polynomial sums: one pass for any n."""
    up, down = _Powers.of(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, hashes) of each text's distinct n-word shingles, in the order of text and hash.

    A text of fewer words, but not none, has its whole sequence as its only shingle.
    """
    at, hashes = words.windows(n)
    owner = words.text[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        more = np.empty(len(short), U64)
        for k, i in enumerate(short):
            own = words.hashes[words.first[i] : words.first[i + 1]]
            more[k] = (own * PLACE[: len(own)]).sum(dtype=U64) + U64(len(own))
        owner, hashes = np.concatenate([owner, short.astype(np.int32)]), np.concatenate([hashes, mixed(more)])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    if len(owner):
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes = owner[new], hashes[new]
    return owner, hashes


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: ``counts[i]`` values in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def list_values(a: pa.Array) -> np.ndarray:
    """The values of an Arrow list column of 64-bit numbers, those of all its rows together."""
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
