"""Token counts with prefix dynamic programming: the exact count of every prefix, without encoding again.

Counts are kept at two levels.  A text's table has the running count at the end of each piece (see `tokens`); of
each distinct piece `PieceCounts` keeps the count at every character, made by dynamic programming over its bytes: of
all tokens that may end at a byte, exactly one goes with the last token of the prefix before it, so one pass gives the
last token and the count of every prefix.  Two tokens go together unless an earlier merge would have joined their
edges.  A text's count is that of its last prefix; a budget falls into one piece of a text, whose counts are at hand.
The tokenizers library gives no count here; tests hold it against every prefix.

Defined results: a null or empty text has 0 bytes and tokens; a special token's string inside a text counts as
the library counts it; repeated rows are counted one by one; an empty table gives no rows; other columns are
not read.  Very long texts are handled a piece at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, column, texts_of
from .tokens import Encoder, byte_letters
from .workspace import prepared, small_batches

SPACE = r"\t-\r \x85\xa0  -     　"
LIMIT = 1024


class PrefixCounter:
    """Counts of all prefixes of a text under a byte-level BPE vocabulary."""

    def __init__(self, path: str):
        import regex

        with open(path) as f:
            spec = json.load(f)
        byte = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(byte[c] for c in s)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            x, y = self.ids[a], self.ids[b]
            self.rank[x, y] = r
            self.made.setdefault(self.ids[a + b], (r, x, y))
        lengths = sorted({len(b) for b in self.ids}, reverse=True)
        #: Lengths of tokens that end within the first i bytes, the longest first.
        self.lengths = [[n for n in lengths if n <= i] for i in range(lengths[0] + 1)]
        self._apart: dict[tuple[int, int], bool] = {}
        self.runs = regex.compile(rf"(?P<space>[{SPACE}]+)|(?P<short>'(?:[sdmt]|ll|ve|re))|\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.starts = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge while ``token`` is being made, each with the rank that ends it."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until, *parts = self.made[token]
            token = parts[side]

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart: no merge across comes before those that use up its two sides."""
        if (known := self._apart.get((left, right))) is None:
            known = not any((r := self.rank.get((x, y))) is not None and r < x_ends and r <= y_ends for x, x_ends in self.edge(left, 1) for y, y_ends in self.edge(right, 0))
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            self._apart[left, right] = known
        return known

    def word(self, raw: bytes) -> list[int]:
        """Counts of the byte prefixes of one pre-token."""
        last, count = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        ids, apart, lengths, most = self.ids.get, self._apart, self.lengths, len(self.lengths) - 1
        for i in range(1, len(raw) + 1):
            for n in lengths[i if i < most else most]:
                t = ids(raw[i - n : i])
                if t is None:
                    continue
                if n == i or (known := apart.get((last[i - n], t))) or known is None and self.apart(last[i - n], t):
                    last[i], count[i] = t, count[i - n] + 1
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return count

    def _chars(self, text: str, skip: int = 0) -> list[int]:
        """Counts after each character of a pre-token, from character ``skip`` on."""
        count, out, at = self.word(text.encode()), [], 0
        for c in text:
            at += len(c.encode())
            out.append(count[at])
        return out[skip:]

    def plain(self, text: str) -> list[int]:
        """Counts of all character prefixes of a text without special tokens; one more than characters."""
        out, base, lead = [0], 0, ""
        at = 0
        while at < len(text):
            m = self.runs.match(text, at)
            run, at = m[0], m.end()
            if m["short"] and lead:  # the white space before takes the mark, not the contraction
                m2 = self.runs.match(text, m.start() + 1)
                marks = "'" if m2["space"] or m2[0][0].isalnum() else "'" + m2[0]
                run, at = marks, m.start() + len(marks)
            if m["space"]:
                own = self._chars(run)
                out += [base + c for c in own]
                if at < len(text):  # the last white-space character stands alone, or with what follows if it is a space
                    base += own[-2] if len(own) > 1 else 0
                    lead = " " if run[-1] == " " else ""
                    base += 0 if lead else self._chars(run[-1])[0]
                continue
            own = self._chars(lead + run, len(lead))
            if m["short"] and not lead:
                out += [base + k + 1 for k in range(len(run) - 1)]  # cut short, a contraction is a mark and a letter
                out.append(base + own[-1])
            else:
                out += [base + c for c in own]
            base, lead = base + own[-1], ""
        return out

    def counts(self, text: str) -> list[int]:
        """Counts of all character prefixes, special tokens' strings being tokens."""
        out, base, at = [0], 0, 0
        for m in self.starts.finditer(text):
            part = self.plain(text[at : m.end() - 1])
            out += [base + c for c in part[1:]]
            base += part[m.start() - at] + 1
            out.append(base)
            at = m.end()
        return out + [base + c for c in self.plain(text[at:])[1:]]


class PieceCounts(Encoder):
    """Distinct pieces with their counts at every character; the cache of `Encoder` holds counts in place of ids."""

    def __init__(self, path: str):
        self.counter = PrefixCounter(path)
        super().__init__(path)
        self.type = np.uint32
        self.forget()

    def payload(self, pieces: list[str]) -> list[list[int]]:
        return [self.counter.counts(p)[1:] for p in pieces]


@lru_cache(2)
def piece_counts(path: str) -> PieceCounts:
    """One for each worker process and file."""
    return PieceCounts(path)


class PrefixTable:
    """The counts of some texts' prefixes."""

    def __init__(self, path: str, texts: Texts):
        known = piece_counts(path)
        if not known.by_piece:
            raise ValueError("prefix counts need a byte-level BPE without a normalizer or prefix space")
        self.texts = texts
        self.starts, self.ends, owner = known.pieces(texts)
        slots = known.slots_of(texts, self.starts, self.ends)
        # The cache may forget these pieces later, but not change them: what is held here stays as it is.
        self.low, self.high, self.values = known.starts[slots], known.starts[slots + 1], known.ids
        self.running = np.concatenate([[0], np.cumsum(self.values[self.high - 1], dtype=np.int64)]) if len(slots) else np.zeros(1, np.int64)
        self.first = np.searchsorted(owner, np.arange(texts.n + 1))
        self.total = self.running[self.first[1:]] - self.running[self.first[:-1]]

    def _inside(self, k: int) -> np.ndarray:
        """Counts after each character of piece k."""
        return self.values[self.low[k] : self.high[k]]

    def every(self, i: int) -> np.ndarray:
        """Counts after each character of text i."""
        lo, hi = int(self.first[i]), int(self.first[i + 1])
        parts = [self._inside(k).astype(np.int64) + (self.running[k] - self.running[lo]) for k in range(lo, hi)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def at(self, i: int, byte: int) -> int:
        """Tokens of text i's first ``byte`` bytes, which must end a character."""
        place = byte + self.texts.offsets[i]
        k = int(np.searchsorted(self.ends[self.first[i] : self.first[i + 1]], place)) + self.first[i]
        base = int(self.running[k] - self.running[self.first[i]])
        if byte == 0 or k == self.first[i + 1]:
            return base
        raw = self.texts.data[self.starts[k] : place].tobytes()
        return base + int(self._inside(k)[len(raw.decode()) - 1])

    def cut(self, i: int, budget: int) -> int:
        """Bytes of the longest prefix of text i with at most ``budget`` tokens."""
        lo, hi = self.first[i], self.first[i + 1]
        if self.total[i] <= budget:
            return int(self.texts.offsets[i + 1] - self.texts.offsets[i])
        k = lo + int(np.searchsorted(self.running[lo + 1 : hi + 1] - self.running[lo], budget, "right"))
        room = budget - int(self.running[k] - self.running[lo])
        fits = np.flatnonzero(self._inside(k) <= room)
        chars = int(fits[-1]) + 1 if len(fits) else 0
        piece = self.texts.data[self.starts[k] : self.ends[k]].tobytes().decode()
        return int(self.starts[k] - self.texts.offsets[i]) + len(piece[:chars].encode())


def prefix_tables(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts array<int>): the exact count after every character of a text, to be stored and asked again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(column(batch, "text")):
                t = PrefixTable(path, texts)
                counts = [t.every(i).astype(np.int32) for i in range(texts.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "counts"])

    small_batches(docs.sparkSession)
    docs = prepared(docs, doc_id=id_col, text=text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, counts array<int>")


def truncated(tables: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chars, tokens): the longest prefix within a budget, from stored tables alone."""
    places = F.transform("counts", lambda c, i: F.when(c <= budget, i + 1).otherwise(0))
    chars = F.coalesce(F.array_max(places), F.lit(0))
    return tables.select("doc_id", chars.alias("chars"), F.coalesce(F.get("counts", chars - 1), F.lit(0)).alias("tokens"))


def count(docs: DataFrame, path: str, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut_bytes): cut_bytes is the longest prefix within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(column(batch, "text")):
                t = PrefixTable(path, texts)
                n_bytes, over = np.diff(texts.offsets), t.total > limit
                cut = n_bytes.copy()
                for i in np.flatnonzero(over).tolist():
                    cut[i] = t.cut(i, limit)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), pa.array(n_bytes, pa.int64()), pa.array(t.total, pa.int64()), pa.array(over), pa.array(cut, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    small_batches(docs.sparkSession)
    docs = prepared(docs, doc_id=id_col, text=text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")
