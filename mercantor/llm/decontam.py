"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned against training windows.

The windows of the benchmark items are hashed into a sorted array with a bitmap in front of it.  Every
window of every document is hashed and looked up; a hit counts only once the words themselves are equal.
Hit words are merged into spans, which can be cut out, or their share condemns the document.

The set is broadcast only while the benchmark's text is within ``slice_bytes`` (16 MB, of which some 160 MB of arrays
are made); a larger benchmark is dealt into slices of that size at most, and the documents are scanned once for each,
so no worker ever holds more; each scan's output replaces the one before.

Defined results: a null or wordless text has no words, hits or items; an item with fewer than n words, but
not none, is one window of its own length; a wordless or null text has no window; items without an id hit like
others and are one item together, null in ``items`` and left out of its joined ids; repeated items keep their ids, repeated rows are judged one by one; an empty benchmark hits nothing; columns of the documents pass
through untouched, whatever their names, and those that the scan adds start with ``__mx_``; item ids are whole
numbers (others are a TypeError).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import ALNUM, FOLD, U64, Texts, Words, column, list_array, texts_of
from .workspace import OWN, drop, keep, small_batches, whole_numbers

SLICE_BYTES = 16 << 20
_BITMAP_BITS = 22
#: Stands for a null item id while documents are scanned.
NO_ID = -(1 << 63)
N_WORDS, HITS, ITEMS = OWN + "n_words", OWN + "hits", OWN + "items"
_ADDED = T.StructType([T.StructField(N_WORDS, T.LongType()), T.StructField(HITS, T.ArrayType(T.LongType(), False)), T.StructField(ITEMS, T.ArrayType(T.LongType(), False))])


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' folded bytes with a space after each, and where each word begins there."""
    sizes = words.ends - words.starts
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    from_, to = np.repeat(words.starts, sizes), np.repeat(at[:-1], sizes)
    step = np.arange(len(from_)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[to + step] = words.fold[words.texts.data[from_ + step]]
    return out, at


class WindowSet:
    """The benchmark's distinct windows: hashes in order, where their words stand, and the items that have each.

    All of it is arrays, about ten bytes for a byte of text, so the bound on the text bounds what is broadcast.
    """

    def __init__(self, items: list[tuple[int, str | None]], n: int = 13):
        ids = np.array([i for i, _ in items], np.int64)
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        texts, held, base = pa.array([text or "" for _, text in items], pa.large_string()), [], 0
        for part in texts_of(texts):
            words = Words(part, ALNUM, FOLD)
            joined, at = _joined(words)
            for length in sorted({min(n, int(c)) for c in words.counts if c}):
                first, h = words.windows(length)
                own = words.text[first]
                use = np.ones(len(first), bool) if length == n else words.counts[own] == length
                first, h, own = first[use], h[use], own[use]
                parts.setdefault(length, []).append((h, base + at[first], base + at[first + length] - 1, ids[part.first + own]))
            held.append(joined)
            base += len(joined)
        self.text = np.concatenate(held) if held else np.zeros(0, np.uint8)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for length, some in sorted(parts.items()):
            h, start, end, item = map(np.concatenate, zip(*some, strict=True))
            order = np.lexsort((item, h))
            h, start, end, item = h[order], start[order], end[order], item[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            heads = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            for k in np.flatnonzero(~new).tolist():
                if self._words(start[k], end[k]) != self._words(start[heads[k]], end[heads[k]]):
                    raise ValueError("two windows of the benchmark share a 64-bit hash")
            twice = np.zeros(len(h), bool)
            twice[1:] = ~new[1:] & (item[1:] == item[:-1])
            bitmap = np.zeros(1 << _BITMAP_BITS, bool)
            bitmap[h[new] & U64((1 << _BITMAP_BITS) - 1)] = True
            owners = np.cumsum(new)[~twice] - 1
            self.by_length[length] = h[new], bitmap, start[new], end[new], np.searchsorted(owners, np.arange(int(new.sum()) + 1)), item[~twice]

    def _words(self, start: int, end: int) -> bytes:
        return self.text[start:end].tobytes()

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(first words, numbers of the windows there, length) of all verified occurrences."""
        for length, (hashes, bitmap, starts, ends, _, _) in self.by_length.items():
            at, h = words.windows(length)
            maybe = np.flatnonzero(bitmap[h & U64((1 << _BITMAP_BITS) - 1)])
            place = np.searchsorted(hashes, h[maybe])
            place[place == len(hashes)] = 0
            good = hashes[place] == h[maybe]
            at, place = at[maybe[good]], place[good]
            same = np.array([words.window(int(i), length) == self._words(starts[k], ends[k]) for i, k in zip(at, place, strict=True)], bool)
            if same.any():
                yield at[same], place[same], length

    def scan(self, texts: Texts) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each text: words, hit runs as (first word, word after the last) pairs in a flat array, item ids."""
        words = Words(texts, ALNUM, FOLD)
        runs: list[np.ndarray] = [np.zeros(0, np.int64)] * texts.n
        items: list[np.ndarray] = [np.zeros(0, np.int64)] * texts.n
        change = np.zeros(len(words.starts) + 1, np.int32)
        of_text: dict[int, list[np.ndarray]] = {}
        for at, which, length in self.hits(words):
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            *_, first, owners = self.by_length[length]
            for i, k in set(zip(words.text[at].tolist(), which.tolist(), strict=True)):
                of_text.setdefault(i, []).append(owners[first[k] : first[k + 1]])
        hit = np.cumsum(change[:-1]) > 0
        for i, lists in of_text.items():
            own = np.zeros(words.counts[i] + 2, np.int8)
            own[1:-1] = hit[words.first[i] : words.first[i + 1]]
            runs[i] = np.flatnonzero(np.diff(own)).astype(np.int64)
            items[i] = np.unique(np.concatenate(lists))
        return words.counts, runs, items


def _pass(docs: DataFrame, text_col: str, windows) -> DataFrame:
    """One scan; adds to what an earlier scan of another slice has left in the columns of `_ADDED`."""
    later = N_WORDS in docs.columns
    schema = docs.schema if later else T.StructType([*docs.schema.fields, *_ADDED.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = windows.value
        for batch in batches:
            for texts in texts_of(column(batch, text_col)):
                rows = batch.slice(texts.first, texts.n)
                n_words, runs, items = own.scan(texts)
                if later:
                    for name, new in ((HITS, runs), (ITEMS, items)):
                        for i, old in enumerate(column_list(rows, name)):
                            if len(old):
                                new[i] = union_runs(old, new[i]) if name == HITS else np.union1d(old, new[i])
                    rows = rows.select([x for x in rows.schema.names if x not in (N_WORDS, HITS, ITEMS)])
                added = [pa.array(n_words, pa.int64()), *(list_array(np.concatenate(x), np.array([len(v) for v in x]), pa.int64()) for x in (runs, items))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*rows.schema.names, N_WORDS, HITS, ITEMS])

    return docs.mapInArrow(scan, schema)


def column_list(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.array(x or [], np.int64) for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def union_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two sets of runs, each a flat array of sorted, separate (start, end) pairs."""
    if not len(b):
        return a
    edges = np.concatenate([a[::2], b[::2], a[1::2], b[1::2]])
    step = np.repeat([1, -1], [(len(a) + len(b)) // 2] * 2)
    order = np.lexsort((-step, edges))
    depth = np.cumsum(step[order])
    return edges[order][(depth == 0) | (np.concatenate([[0], depth[:-1]]) == 0)]


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents with their words, hit runs (word numbers) and item ids in three more columns."""
    spark = docs.sparkSession
    small_batches(spark)
    whole_numbers(benchmark, item_id)
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    bound, least = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0)), F.min("i")).first()
    if least == NO_ID:
        raise ValueError("the smallest 64-bit number is not free to be an item's id")
    items = items.select(F.coalesce("i", F.lit(NO_ID).cast("long")).alias("i"), "t")
    slices = max(1, -(-bound // slice_bytes))
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k) if slices > 1 else items
        docs = _pass(docs, text_col, spark.sparkContext.broadcast(WindowSet([tuple(r) for r in rows.collect()], n)))
        if slices > 1:
            docs = keep(docs)
            if k:
                drop(before)
            before = docs
    return docs


def n_hit() -> F.Column:
    """Words inside any occurrence: the runs' ends less their starts."""
    return F.aggregate(F.expr(f"transform({HITS}, (x, i) -> if(i % 2 = 1, x, -x))"), F.lit(0).cast("long"), lambda a, x: a + x)


def judge(docs: DataFrame, benchmark: DataFrame, *, share: tuple[int, int] = (1, 20), **how) -> DataFrame:
    """Adds n_words, n_hit, items (sorted ids, a null first) and contaminated: hit words are at least ``share`` of all words.

    A document's own columns of those names are replaced.
    """
    part, whole = share
    out = scan(docs, benchmark, **how)
    out = out.withColumns({"n_words": F.col(N_WORDS), "n_hit": n_hit(), "items": F.transform(ITEMS, lambda x: F.when(x != F.lit(NO_ID), x))}).drop(N_WORDS, ITEMS)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (whole * F.col("n_hit") >= part * F.col("n_words"))).drop(HITS)


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, share: tuple[int, int] = (1, 20), **how) -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    part, whole = share
    out = scan(docs, benchmark, **how).withColumn(OWN + "n", n_hit())
    return out.where(~((F.col(OWN + "n") > 0) & (whole * F.col(OWN + "n") >= part * F.col(N_WORDS)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The documents with every hit run cut out of the text, from its first word to its last."""
    found, names = scan(docs, benchmark, text_col=text_col, **how), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            for i, runs in enumerate(column_list(batch, HITS)):
                if len(runs):
                    raw = texts[i].encode()
                    words = Words(Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0), ALNUM, FOLD)
                    kept, last = [], 0
                    for a, b in runs.reshape(-1, 2):
                        kept.append(raw[last : words.starts[a]])
                        last = int(words.ends[b - 1])
                    texts[i] = b"".join([*kept, raw[last:]]).decode()
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 :]], schema=batch.schema).select(names)

    return found.mapInArrow(cut, docs.schema)


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns of judged documents; item ids are sorted as strings."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def sha256_of(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
