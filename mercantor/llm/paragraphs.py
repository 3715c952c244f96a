"""Substring dedup: paragraph MinHash banding, exact Jaccard checks, and removals by connected components.

Paragraphs (lines of ``MIN_WORDS`` words or more) get MinHash signatures of ``BANDS`` bands of ``ROWS`` values; at a
similarity of 0.75 a pair shares a band with a chance of 1 - (1 - 0.75**3)**9 = 0.993, and more above.  Colliding
paragraphs are checked by their exact shingle sets and joined into components (see `jaccard`, whose other steps
this shares: classes of equal sets, star pairs first, pairs across components in cells of bounded size).

A passage may also sit inside a line, after other text, or run over several lines.  So the words of whole documents
are compared as well: a stretch of ``RUN_WORDS`` words or more that another document has word by word is a repeat,
wherever its sentences and lines end.  Each stretch of ``RUN_WORDS`` words is named by the smallest hash of its
windows of ``ANCHOR_WORDS`` words, which depends on its own words only, so equal stretches have the same name and only
stretches whose name comes again are compared by their whole hash (64 bits).  None is lost.  Copies with changed words
are found as lines (above), or in their unchanged stretches of ``RUN_WORDS`` words.

Documents of equal texts (told apart by 128-bit hashes) are one class: only its smallest id is compared with others,
and the verdicts of the rest, all of whose lines and stretches are repeats, follow from it.

Of each component, and of each repeated stretch of ``RUN_WORDS`` words, the occurrence with the smallest document id
stays; of a stretch, the smallest one that no removed line cuts, if there is any.  Each stretch has its own verdict,
and a word that any kept stretch holds is kept, so what remains of a removed passage may be shorter than a stretch.

Defined results: a null, empty or wordless text has no paragraphs; repeats within one document only are no repeats
across documents; rows without an id are left out; rows that share an id are one document; a repeated row is a
copy of its document only if the ids differ; ids may be any 64-bit whole numbers (others are a TypeError), and texts have any number of lines; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard import among, join, shared
from .kernels import PLACE, U64, VISIBLE, Words, column, list_array, list_values, mixed, rolling, texts_of
from .workspace import drop, keep, prepared, small_batches, whole_numbers

BANDS, ROWS = 9, 3
MIN_WORDS, ANCHOR_WORDS, RUN_WORDS = 16, 13, 24
#: Words of a passage in production: passages of over 50 words, of whose ends a word each may be grown into its neighbour.
PASSAGE_WORDS = 48
#: A line of ``MIN_WORDS`` words has so many bytes at least.
_LINE_BYTES = 2 * MIN_WORDS - 1


def bands(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, tokens): each row's MinHash bands."""
    n = np.diff(first)
    rows = np.flatnonzero(n > 0)
    starts = first[:-1][rows]
    out = []
    for b in range(BANDS):
        token = np.full(len(rows), U64(b))
        for r in range(ROWS):
            least = np.minimum.reduceat(hashes * PLACE[100 + b * ROWS + r], starts) if len(rows) else token
            token = mixed(token * PLACE[7] + least)
        out.append(token)
    return np.tile(rows, BANDS), np.concatenate(out)


class Units:
    """The lines of some texts, each from its first word to its last."""

    def __init__(self, words: Words):
        data, n = words.texts.data, len(words.starts)
        ends = np.ones(n, bool)
        if n > 1:
            newline = np.concatenate([[0], np.cumsum(data == 0x0A)])
            ends[:-1] = (words.text[1:] != words.text[:-1]) | (newline[words.starts[1:]] > newline[words.ends[:-1]])
        self.last = np.flatnonzero(ends)
        self.first = np.concatenate([[0], self.last[:-1] + 1]) if n else self.last
        self.n_words = self.last - self.first + 1
        self.text = words.text[self.first]
        self.starts, self.ends = words.starts[self.first], words.ends[self.last]


def _place_bits(ids: tuple[int, int] | None, longest: int) -> int | None:
    """Bits for a paragraph's place beside its document's id, or None if both don't fit into 63 bits."""
    bits = max(1, (longest // _LINE_BYTES + 1).bit_length())
    return bits if ids is not None and -(1 << (63 - bits)) <= ids[0] and ids[1] < 1 << (63 - bits) else None


def _units(docs: DataFrame, bits: int | None) -> DataFrame:
    """(id, text, doc_id, start, end, n_words) of each paragraph; start and end are bytes of the document.

    id is the document's id and the paragraph's place in ``bits`` bits; without those, a 64-bit hash of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for texts in texts_of(column(batch, "text")):
                u = Units(Words(texts, VISIBLE))
                use = np.flatnonzero(u.n_words >= MIN_WORDS)
                own = u.text[use]
                doc, place = ids[texts.first + own], np.arange(len(use)) - np.searchsorted(own, own)
                unit = doc << bits | place if bits is not None else mixed(mixed(doc.view(U64)) + place.astype(U64)).view(np.int64)
                low = texts.offsets[own]
                raw = [texts.data[a:b].tobytes().decode() for a, b in zip(u.starts[use].tolist(), u.ends[use].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(raw, pa.string()), pa.array(doc), pa.array(u.starts[use] - low), pa.array(u.ends[use] - low), pa.array(u.n_words[use])], names=["id", "text", "doc_id", "start", "end", "n_words"])

    return docs.mapInArrow(run, "id long, text string, doc_id long, start long, end long, n_words long")


def stretches(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, name, hash) of every stretch of RUN_WORDS words inside one text."""
    n = len(words.starts) - RUN_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    h = rolling(words.hashes, ANCHOR_WORDS)
    far = RUN_WORDS - ANCHOR_WORDS
    name = h[:n].copy()
    for k in range(1, far + 1):
        np.minimum(name, h[k : k + n], out=name)
    at = np.flatnonzero(words.text[:n] == words.text[RUN_WORDS - 1 :])
    return at, name[at], mixed(h[at] * PLACE[7] + h[at + far])  # two windows that cover all words


def _names(docs: DataFrame) -> DataFrame:
    """(token, doc_id): the names of each document's stretches, once for neighbours of the same name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for texts in texts_of(column(batch, "text")):
                words = Words(texts, VISIBLE)
                at, name, _ = stretches(words)
                text = words.text[at]
                new = np.ones(len(at), bool)
                new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(name[new].view(np.int64)), pa.array(ids[texts.first + text[new]])], names=["token", "doc_id"])

    return docs.mapInArrow(run, "token long, doc_id long")


#: Consecutive stretches of one name that a run holds at most; its first and last one have all of its words.
_RUN = RUN_WORDS - ANCHOR_WORDS + 1
_STRETCHES = "token long, run long, doc_id long, word int, n int, hashes array<long>, starts array<int>, ends array<int>, gone int, copied boolean"


def _repeatable(docs: DataFrame) -> DataFrame:
    """Runs of consecutive stretches of one name (`_STRETCHES`) whose names are among their row's ``tokens``.

    run: a hash of all of a run's words.  gone: a bit for each stretch, set if a word of it is in one of the row's
    removed ``lines``, (start, end) pairs in a flat array.  copied: the row has copies, so that all of its runs come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copied = batch.column(0).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            for texts in texts_of(column(batch, "text")):
                words = Words(texts, VISIBLE)
                at, name, hashes = stretches(words)
                own = copied[texts.first : texts.first + texts.n]
                # Whether a name comes again doesn't depend on the document, so all rows' names are one set.
                use = np.isin(name, list_values(batch.column(2).slice(texts.first, texts.n)).view(U64)) | own[words.text[at]]
                at, name, hashes = at[use], name[use], hashes[use]
                if not len(at):
                    continue
                text = words.text[at]
                low = texts.offsets[text]
                gone = np.zeros(len(texts.data) + 1, np.int32)
                for i, lines in enumerate(batch.column(3).slice(texts.first, texts.n)):
                    if lines.is_valid:
                        edges = lines.values.to_numpy() + texts.offsets[i]
                        np.add.at(gone, edges[::2], 1)
                        np.add.at(gone, edges[1::2], -1)
                inside = np.concatenate([[0], np.cumsum(np.cumsum(gone)[words.starts] > 0)])
                cut = inside[at + RUN_WORDS] > inside[at]
                new = np.ones(len(at), bool)
                new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
                k = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                first = np.flatnonzero(k % _RUN == 0)
                n = np.diff(np.append(first, len(at)))
                last = first + n - 1
                whole = mixed(mixed(hashes[first]) * PLACE[7] + hashes[last] + n.astype(U64))
                bits = np.bitwise_or.reduceat(cut.astype(np.int32) << (k % _RUN).astype(np.int32), first)
                flat = [hashes.view(np.int64), (words.starts[at] - low).astype(np.int32), (words.ends[at + RUN_WORDS - 1] - low).astype(np.int32)]
                lists = [list_array(x, n, t) for x, t in zip(flat, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(name[first].view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[texts.first + text[first]]), pa.array((at[first] - words.first[text[first]]).astype(np.int32)), pa.array(n.astype(np.int32)), *lists, pa.array(bits), pa.array(own[text[first]])], names=["token", "run", "doc_id", "word", "n", "hashes", "starts", "ends", "gone", "copied"])

    return docs.mapInArrow(run, _STRETCHES)


def _kept_by(rows: DataFrame, key: str, gone: Column, *more: Column) -> DataFrame:
    """(key, lo, hi, whole, ...): the smallest and largest document of each group, and the smallest that isn't gone.

    A partial aggregate, so a group of any size is fine; whoever needs it at the rows joins it back.
    """
    return rows.groupBy(key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.when(~gone, F.col("doc_id"))).alias("whole"), *more)


def _verdicts(runs: DataFrame) -> DataFrame:
    """(doc_id, lo, word, n, start, end, copied) of the repeated stretches: lo is the document that keeps them.

    Where all documents of a name have the same run, it is judged as one; the stretches of other runs one by one.
    Each step is written before the next one begins, and what no step needs any more is deleted.
    """
    whole = F.expr("shiftleft(1, n) - 1")
    names = keep(_kept_by(runs, "token", F.col("gone") != 0, (F.min("run") == F.max("run")).alias("same"), F.bool_or((F.col("gone") != 0) & (F.col("gone") != whole)).alias("partly")))
    sure = names.select("token", "lo", "hi", "whole", (F.col("same") & ~F.col("partly")).alias("pure"))
    judged = runs.join(sure, "token").where("not pure or lo <> hi or copied")
    open_ = lambda c: F.when(~F.col("pure"), F.col(c)).alias(c)
    marked = keep(judged.select("doc_id", F.coalesce("whole", "lo").alias("lo"), "word", "n", F.col("starts")[0].alias("start"), F.element_at("ends", -1).alias("end"), "copied", "pure", "gone", *map(open_, ("hashes", "starts", "ends"))))
    drop(runs, names)
    cols = ["doc_id", "lo", "word", "n", "start", "end", "copied"]
    other = marked.where("not pure").select("doc_id", "word", "gone", "copied", "starts", "ends", F.posexplode("hashes").alias("i", "hash"))
    each = other.select("hash", "doc_id", (F.col("word") + F.col("i")).alias("word"), F.lit(1).alias("n"), F.col("starts")[F.col("i")].alias("start"), F.col("ends")[F.col("i")].alias("end"), F.expr("(gone & shiftleft(1, i)) <> 0").alias("gone"), "copied")
    # Written first, so that both sides of the join are plain shuffles, whose large partitions Spark can split.
    groups = keep(_kept_by(each, "hash", F.col("gone")))
    found = each.join(groups, "hash").where("lo <> hi or copied").withColumn("lo", F.coalesce("whole", "lo"))
    out = keep(marked.where("pure").select(*cols).union(found.select(*cols)))
    drop(marked, groups)
    return out


def _spans(stretches: DataFrame, least: int) -> DataFrame:
    """Spans of the repeated stretches (doc_id, lo, word, n, start, end), where lo is the document that keeps them.

    Stretches that overlap or touch are one passage, which counts if it has ``least`` words or more; those of the same
    verdict are one span of it.  A word that a kept stretch holds is kept.
    """

    def merged(doc, lo, first, last, start, end, removed: bool) -> pa.RecordBatch:
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > last[:-1])
        at = np.flatnonzero(new)
        to = np.append(at[1:], len(doc)) - 1 if len(doc) else at
        cluster = np.minimum.reduceat(lo, at) if len(doc) else lo
        return _passages(doc[at], start[at], end[to], last[to] - first[at], cluster, np.full(len(at), removed))

    def spans(doc, lo, word, size, start, end) -> Iterator[pa.RecordBatch]:
        doc, lo, word, size, start, end = (x.astype(np.int64) for x in (doc, lo, word, size, start, end))
        to = word + size - 1 + RUN_WORDS
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (word[1:] > to[:-1])
        run = np.cumsum(new) - 1
        long = (np.append(to[:-1][new[1:]], to[-1:]) - word[new] >= least)[run] if len(doc) else new
        doc, lo, word, start, end, to = (x[long] for x in (doc, lo, word, start, end, to))
        n, kept = len(doc), doc == lo
        yield merged(doc[kept], lo[kept], word[kept], to[kept], start[kept], end[kept], False)
        # Of a removed stretch, the words between the kept stretches before and after it; one byte at least parts words.
        before = np.maximum.accumulate(np.where(kept, np.arange(n), -1))
        after = np.minimum.accumulate(np.where(kept, np.arange(n), n)[::-1])[::-1]
        b, a = np.maximum(before, 0), np.minimum(after, n - 1)
        late = (before >= 0) & (doc[b] == doc) & (to[b] > word)
        early = (after < n) & (doc[a] == doc) & (word[a] < to)
        first, last = np.where(late, to[b], word), np.where(early, word[a], to)
        start, end = np.where(late, end[b] + 1, start), np.where(early, start[a] - 1, end)
        use = ~kept & (first < last)
        yield merged(doc[use], lo[use], first[use], last[use], start[use], end[use], True)

    return _by_document(stretches, spans)


_PASSAGE = "doc_id long, kind string, start long, end long, n_words long, cluster long, removed boolean"


def _passages(doc, start, end, n_words, cluster, removed) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(["passage"] * len(doc), pa.string()), *(pa.array(x.astype(np.int64)) for x in (start, end, n_words, cluster)), pa.array(removed)], names=["doc_id", "kind", "start", "end", "n_words", "cluster", "removed"])


def _by_document(stretches: DataFrame, spans) -> DataFrame:
    """``spans`` of the columns of whole documents, in the order of document and word; only one document is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut or held and held[-1][0][-1] != columns[0][0]:
                done = [*held, [c[:cut] for c in columns]]
                yield from spans(*map(np.concatenate, zip(*done, strict=True)))
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield from spans(*map(np.concatenate, zip(*held, strict=True)))

    return stretches.repartition("doc_id").sortWithinPartitions("doc_id", "word").mapInArrow(run, _PASSAGE)


def repeats(docs: DataFrame, *, least: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans that repeat across documents: (doc_id, kind, start, end, n_words, cluster, removed).

    Documents without such a span have no row.  A passage has ``least`` words or more, ``RUN_WORDS`` at least; its
    parts that different documents keep may be shorter.  kind is ``paragraph`` or ``passage``; a passage may lie inside a
    paragraph.  cluster is the smallest unit number of a component, or the smallest document that keeps
    a stretch of a passage.
    """
    whole_numbers(docs, id_col)
    docs = prepared(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null and text is not null")
    small_batches(docs.sparkSession)
    docs = docs.withColumn("k", F.xxhash64(F.lit(1), "text"))
    texts = keep(docs.select("doc_id", "k", F.xxhash64(F.lit(2), "text").alias("k2"), F.octet_length("text").alias("n")))
    lowest, highest, longest = texts.agg(F.min("doc_id"), F.max("doc_id"), F.coalesce(F.max("n"), F.lit(0))).first()
    classes = texts.groupBy("k", "k2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").drop("last")
    copies = keep(texts.join(classes, ["k", "k2", "n"]).where("doc_id <> rep").select("rep", "doc_id", "k").distinct())
    drop(texts)
    reps = among(docs, copies.select("doc_id", "k"), "left_anti").drop("k")
    copied = copies.select(F.col("rep").alias("doc_id")).distinct()

    units = keep(_units(reps, _place_bits((lowest, highest) if lowest is not None else None, longest)))
    placed = keep(join(units, id_col="id", make=bands)["members"].distinct())
    lines = units.drop("text").join(placed, "id", "left").join(copied.withColumn("copied", F.lit(True)), "doc_id", "left").where("component is not null or copied")
    lines = keep(lines.select("doc_id", "start", "end", "n_words", F.coalesce("component", "id").alias("cluster"), F.coalesce("copied", F.lit(False)).alias("copied")))
    across = lines.groupBy("cluster").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bool_or("copied").alias("c")).where("lo <> hi or c").select("cluster", "lo")
    spans = keep(lines.join(across, "cluster").select("doc_id", F.lit("paragraph").alias("kind"), "start", "end", "n_words", "cluster", (F.col("doc_id") > F.col("lo")).alias("removed")))
    drop(units, placed, lines)

    names = shared(_names(reps)).groupBy("doc_id").agg(F.collect_list("token").alias("tokens"))
    names = keep(names.join(copied.withColumn("copied", F.lit(True)), "doc_id", "full"))
    gone = spans.where("removed").groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("start", "end"))).alias("lines"))
    wanted = among(reps, names.select("doc_id"), "left_semi").join(names, "doc_id").join(gone, "doc_id", "left")
    found = _repeatable(wanted.select("doc_id", "text", F.coalesce("tokens", F.array().cast("array<long>")).alias("tokens"), "lines", F.coalesce("copied", F.lit(False)).alias("copied")))
    runs = keep(found)
    drop(names)
    found = _verdicts(runs)

    # A copy repeats all lines of its text, and its stretches, which touch, are one passage.
    like = copies.select(F.col("rep").alias("of"), F.col("doc_id").alias("copy")).distinct()
    more = spans.join(like, F.col("doc_id") == F.col("of")).select(F.col("copy").alias("doc_id"), "kind", "start", "end", "n_words", "cluster", F.lit(True).alias("removed"))
    whole = found.where("copied").groupBy("doc_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("word") + F.col("n")) - 1 + RUN_WORDS).alias("n_words"), F.min("lo").alias("cluster"))
    whole = whole.join(like, F.col("doc_id") == F.col("of")).select(F.col("copy").alias("doc_id"), F.lit("passage").alias("kind"), *[F.col(c).cast("long").alias(c) for c in ("start", "end", "n_words", "cluster")], F.lit(True).alias("removed"))
    return spans.union(more).union(_spans(found.select("doc_id", "lo", "word", "n", "start", "end"), least)).union(whole.where(F.col("n_words") >= least))


def remove(docs: DataFrame, *, least: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the spans to be removed cut out of their texts."""
    spans = repeats(docs, least=least, id_col=id_col, text_col=text_col).where("removed").groupBy(F.col("doc_id").alias("__mx_id")).agg(F.collect_set(F.struct("start", "end")).alias("__mx_spans"))
    joined = docs.join(spans, F.col(f"`{id_col}`").cast("long") == F.col("__mx_id"), "left").drop("__mx_id")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, own in enumerate(spans):
                if own and texts[i] is not None:
                    raw, kept, last = texts[i].encode(), [], 0
                    for s in sorted(own, key=lambda s: (s["start"], s["end"])):
                        kept.append(raw[last : max(last, s["start"])])
                        last = max(last, s["end"])
                    texts[i] = b"".join([*kept, raw[last:]]).decode()
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 : -1]], names=names)

    return joined.mapInArrow(cut, docs.schema)
