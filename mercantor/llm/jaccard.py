"""N-gram Jaccard join with parity sketches: pigeonhole on sketch blocks in each size band, then exact checks.

With sizes a and b, a Jaccard similarity of 3/4 or more means at most d = (a + b) / 7 shingles in the symmetric
difference.  A document's shingles are XORed into a sketch; each shingle of the difference changes one block at
most, so all but d blocks of two linked documents agree.  In a size band (an octave of the larger document) the
sketch has a block for every three shingles of the band's largest set, each the XOR of the 64-bit hashes in its
range of hashes.  Blocks that aren't empty are put in an order that depends on themselves only (those of most
shingles first: few unlinked documents share them): of the first d + 1, one is equal in both documents and is among
the first d + 1 of the other as well (all earlier ones differ), so equal blocks among these find every linked pair
of which one document at least has d + 1 blocks that aren't empty.  Documents with fewer meet in finer blocks, at
least as many as shingles, as well.  Documents in the top part of a band also enter the next band.

Documents with equal shingle sets are one class, and only its smallest id takes part.  Classes that share a block
are a group; groups with the same smallest class are joined.  Every class is checked against the smallest class of
all its groups, then against those of its groups' smallest classes that are in other components by then; only
groups that still hold several components are compared further, across components, in square cells of bounded
size that run as separate tasks.  A compact parity sketch (one bit flipped for each shingle; its Hamming distance
is a lower bound of d) sorts out pairs before their shingle sets are fetched and intersected.  So the smallest ids
of components are exact, and a group of copies costs a number of pairs in proportion to its size.

Exact up to hashes: shingles, sets and blocks are told apart by 64-bit, 128-bit and 64-bit hashes.  A band's
fine blocks that aren't empty are fewer than d + 1 with a chance below 1e-20 (from 64 shingles on; below, each
shingle is a block of its own).

Defined results: a null, empty or wordless text has no shingles, links with nothing and is its own component; a
text of fewer than five words has one shingle, its whole sequence; rows that share an id are one document, which
has the links of each of its rows; rows without an id link with nothing and have a null component; an empty
table gives no rows; only the id and text columns are read, so others may have any name; ids are whole numbers
(others are a TypeError).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import FOLD, U64, VISIBLE, Words, column, mixed, shingles, texts_of
from .workspace import OWN, drop, keep, prepared, small_batches, whole_numbers

N = 5
#: Below 2**SINGLE shingles every shingle is a block of its own.
SINGLE = 6
#: Classes on one side of a cell of pairs that one task compares.
CELL = 4096
#: Their shingles together, about: 8 bytes each.
CELL_SHINGLES = 2_000_000
#: Up to so many ids are broadcast when texts are fetched; more go through a shuffle.
BROADCAST_IDS = 100_000
_SEEN = 100_000


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, first places, hashes): shingles of row i are hashes[first[i]:first[i + 1]], in order."""
    for batch in batches:
        for texts in texts_of(column(batch, "text")):
            owner, hashes = shingles(Words(texts, VISIBLE, FOLD), n)
            yield batch.column(0).slice(texts.first, texts.n), np.searchsorted(owner, np.arange(texts.n + 1)), hashes


def _signatures(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((2, len(hashes) + 1), U64)
    np.cumsum(hashes, out=total[0, 1:])
    np.cumsum(mixed(hashes ^ U64(0x9E3779B97F4A7C15)), out=total[1, 1:])
    return tuple((t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total)


def sketch(hashes: np.ndarray) -> bytes:
    """Parity bits by the low bits of the hashes; the number of bits is a power of two, four times the size at least.

    So few shingles meet in a bit that the distance is close to the symmetric difference: sets that pass for linked
    have a similarity of 0.73 at least, or nearly so, and few sets are fetched in vain.
    """
    bits = max(64, 1 << int(4 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of several lengths as rows of 64-bit words, folded by XOR to the shortest length."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least), np.uint8)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint8)
        out[i] = x if len(x) == least else np.bitwise_xor.reduce(x.reshape(-1, least), axis=0)
    return out.view(U64)


def coarse(s: bytes) -> bytes:
    """A sketch folded to a quarter of its bits, 64 at least: still a lower bound, and enough for most pairs."""
    x = np.frombuffer(s, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(4, -1), axis=0).tobytes() if len(x) >= 32 else s


def profiles(docs: DataFrame, n: int = N) -> DataFrame:
    """(id, n_shingles, s1, s2, sketch, coarse) of each row; s1 and s2 are a 128-bit hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, first, hashes in _sets(batches, n):
            s1, s2 = _signatures(first, hashes)
            parts = [sketch(hashes[a:b]) if b > a else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first), pa.int32()), pa.array(s1), pa.array(s2), pa.array(parts, pa.binary()), pa.array([coarse(x) for x in parts], pa.binary())], names=["id", "n_shingles", "s1", "s2", "sketch", "coarse"])

    return docs.mapInArrow(run, "id long, n_shingles int, s1 long, s2 long, sketch binary, coarse binary")


def _ranges(first: np.ndarray, hashes: np.ndarray, rows: np.ndarray, level: np.ndarray, d: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, tokens, blocks that aren't empty, by row): the first d + 1 blocks of each of ``rows`` at its level.

    Coarse: a third of a block for each shingle of the largest set of the level, the blocks of most shingles first.
    Fine: twice as many blocks as that set has shingles, or below 2**SINGLE one for each hash, in their order.
    """
    n = np.diff(first)
    at = np.repeat(np.arange(len(rows)), n[rows])
    ends = np.cumsum(n[rows])
    h = hashes[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n[rows] - first[:-1][rows], n[rows])]
    if fine:
        block = h >> np.where(level < SINGLE, 0, 63 - level).astype(U64)[at]
    else:
        block = ((h >> U64(32)) * ((2 << level) // 3).astype(U64)[at]) >> U64(32)
    new = np.ones(len(h), bool)
    new[1:] = (at[1:] != at[:-1]) | (block[1:] != block[:-1])
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(rows), np.int64)
    value, count = np.bitwise_xor.reduceat(h, starts), np.diff(np.append(starts, len(h)))
    own, block = at[starts], block[starts]
    if not fine:
        order = np.lexsort((-count, own))  # stable: blocks of as many shingles keep their order
        own, block, value, count = own[order], block[order], value[order], count[order]
    filled = np.bincount(own, minlength=len(rows))
    take = np.arange(len(own)) - np.searchsorted(own, own) <= d[own]
    own = own[take]
    tag = (level[own].astype(U64) << U64(57)) ^ (U64(0) if fine else count[take].astype(U64) << U64(1) | U64(1))
    return rows[own], mixed(mixed(value[take]) ^ (block[take] * U64(0x9E3779B97F4A7C15)) ^ tag), filled


def blocks(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, tokens): the blocks of each row in its own band, and in the next if it may link there."""
    n = np.diff(first)
    band = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
    most = 4 * n // 3  # shingles of the largest partner
    rows_out, tokens_out = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for up in (0, 1):
        level = band + up
        d = (n + (np.minimum(most, (2 << level) - 1) if not up else most)) // 7
        enters = (n > 0) & ((up == 0) | (most >= (1 << level)))
        short = enters & (level < SINGLE)
        large = np.flatnonzero(enters & ~short)
        own, tokens, filled = _ranges(first, hashes, large, level[large], d[large], False)
        rows_out.append(own)
        tokens_out.append(tokens)
        short[large] = filled <= d[large]
        small = np.flatnonzero(short)
        own, tokens, _ = _ranges(first, hashes, small, level[small], d[small], True)
        rows_out.append(own)
        tokens_out.append(tokens)
    return np.concatenate(rows_out), np.concatenate(tokens_out)


def _tokens(docs: DataFrame, n: int, make) -> DataFrame:
    """(token, id) of every row but those whose set this task has just seen (they are in its class anyway)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for ids, first, hashes in _sets(batches, n):
            keys = list(zip(*(s.tolist() for s in _signatures(first, hashes)), strict=True))
            fresh = np.zeros(len(keys), bool)
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    fresh[i] = True
            if len(seen) > _SEEN:
                seen.clear()
            rows, tokens = make(first, hashes)
            use = fresh[rows]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[use].view(np.int64)), ids.take(pa.array(rows[use]))], names=["token", "id"])

    return docs.mapInArrow(run, "token long, id long")


def _stars(tokens: DataFrame) -> DataFrame:
    """(a, b) for every row (token, id) but the first of its token: a is the token's smallest id, b the row's id.

    Rows arrive in order, so one id is all that is held; pairs are told once a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, lead = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t, i = (batch.column(k).to_numpy() for k in (0, 1))
            new = np.ones(len(t), bool)
            new[0] = token is None or t[0] != token
            new[1:] = t[1:] != t[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
            leads = np.where(start >= 0, i[start], lead)
            token, lead = t[-1], leads[-1]
            use = np.flatnonzero(leads != i)
            if len(use):
                pairs = np.unique(np.stack([leads[use], i[use]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return tokens.repartition("token").sortWithinPartitions("token", "id").mapInArrow(run, "a long, b long").distinct()


def shared(tokens: DataFrame) -> DataFrame:
    """The rows whose first column, a long, comes more than once.  Rows arrive in its order; no group is ever held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, given = None, False  # the last row so far, and whether it has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            t = batch.column(0).to_numpy()
            same = t[1:] == t[:-1]
            share = np.zeros(len(t), bool)
            share[1:] |= same
            share[:-1] |= same
            last = bool(share[-1])
            share[0] &= not given
            held, given = batch.slice(len(t) - 1), last
            if share.any():
                yield batch.filter(pa.array(share))

    key = tokens.columns[0]
    return tokens.repartition(key).sortWithinPartitions(key).mapInArrow(run, tokens.schema)


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            sa, sb = (batch.column(k).to_pylist() for k in (4, 5))
            good = np.array([int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()) * 7 <= m for x, y, m in zip(sa, sb, (na + nb).tolist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    side = lambda x: sketches.select(F.col("rep").alias(x), F.col("n_shingles").alias("n" + x), F.col("sketch").alias("s" + x))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").where("100 * least(na, nb) >= 75 * greatest(na, nb)")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def among(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """A semi- or anti-join with distinct keys, which are broadcast if they are few: then no text is shuffled."""
    keys = keys.distinct()
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, keys.columns, how)


def _fetched(ids: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(id, h): the shingle sets of the given distinct ids, made again from the texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, first, hashes in _sets(batches, n):
            raw = [hashes[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary())], names=["id", "h"])

    return keep(among(docs, ids, "left_semi").mapInArrow(sets, "id long, h binary"))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int(np.count_nonzero(x[at] == y))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _linked(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The pairs whose shingle sets have a similarity of 3/4 or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.array([similar(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)], bool)
            yield batch.select([0, 1]).filter(pa.array(good))

    pairs = keep(pairs)
    wanted = _fetched(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs, n)
    side = lambda x: wanted.select(F.col("id").alias(x), F.col("h").alias("h" + x))
    out = keep(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ha", "hb").mapInArrow(check, "a long, b long").distinct())
    drop(pairs, wanted)
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows with the same first three columns, in which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in range(3)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _close(marks: np.ndarray, size: np.ndarray, comp: np.ndarray, i: int) -> np.ndarray:
    """Later rows, in the order of size, that another component and the sketches leave as partners of row i."""
    to = int(np.searchsorted(size, size[i] * 4 // 3, "right"))  # 100 * size[i] >= 75 * size[j]
    other = i + 1 + np.flatnonzero(comp[i + 1 : to] != comp[i])
    if len(other):
        far = np.bitwise_count(marks[other] ^ marks[i]).sum(axis=1, dtype=np.int64)
        other = other[7 * far <= size[other] + size[i]]
    return other


def _across(groups: DataFrame, sketches: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Links that join components within groups; groups: (token, rep, component, cells).

    First the rows that have a possible partner in their cell are picked by coarse sketches, from these by full
    ones, then their shingle sets are brought to the cell and compared.  A cell gives out a link only when it joins two parts, so both steps give
    out fewer rows than they read, however many pairs are near.
    """
    side = F.pmod(F.xxhash64("rep"), F.col("cells"))
    spread = groups.withColumn("s", side).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    spread = spread.select("token", F.least("s", "j").alias("x"), F.greatest("s", "j").alias("y"), "rep", "component")
    by_cell = lambda df: df.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            comp, size = rows.column("component").to_numpy(), rows.column("n_shingles").to_numpy().astype(np.int64)
            if (comp == comp[0]).all():
                continue
            order = np.argsort(size, kind="stable")
            marks = folded([rows.column("sketch")[int(i)].as_py() for i in order])
            comp, size = comp[order], size[order]
            near = np.zeros(len(order), bool)
            for i in range(len(order) - 1):
                other = _close(marks, size, comp, i)
                if len(other):
                    near[i] = True
                    near[other] = True
            if near.any():
                yield rows.select([0, 1, 2, 3, 4]).take(pa.array(order[near])).combine_chunks().to_batches()[0]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            sets = [np.frombuffer(h.as_buffer(), U64) for h in rows.column("h")]
            size = np.array(list(map(len, sets)), np.int64)
            order = np.argsort(size, kind="stable")
            sets, size = [sets[i] for i in order], size[order]
            rep, comp = rows.column("rep").to_numpy()[order], rows.column("component").to_numpy()[order].copy()
            marks = folded([sketch(h) for h in sets])
            a, b = [], []
            for i in range(len(sets) - 1):
                for j in _close(marks, size, comp, i).tolist():
                    if comp[j] != comp[i] and similar(sets[j], sets[i]):
                        comp[comp == comp[j]] = comp[i]
                        a.append(min(rep[i], rep[j]))
                        b.append(max(rep[i], rep[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    kind = "token long, x long, y long, rep long, component long"
    picked: list[DataFrame] = []
    for marks in ("coarse", "sketch"):
        rows = (picked[-1] if picked else spread).join(sketches, "rep").select("token", "x", "y", "rep", "component", "n_shingles", F.col(marks).alias("sketch"))
        picked.append(keep(by_cell(rows).mapInArrow(pick, kind)))
    wanted = _fetched(picked[-1].select(F.col("rep").alias("id")).distinct(), docs, n)
    sets = picked[-1].join(wanted.withColumnRenamed("id", "rep"), "rep").select("token", "x", "y", "rep", "component", "h")
    out = keep(by_cell(sets).mapInArrow(settle, "a long, b long").distinct())
    drop(*picked, wanted)
    return out


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, make=blocks) -> dict[str, DataFrame]:
    """``rows`` (id, n_shingles, component), one for each input row; ``members`` (id, component), only those that have
    copies or links; and ``links`` (a, b) between classes.

    links holds verified links only, and enough of them to make up the components.  ``make`` gives the tokens that
    two linked rows must share, here or (with less than certainty) another scheme's.
    """
    small_batches(docs.sparkSession)
    whole_numbers(docs, id_col)
    docs = prepared(docs, id=id_col, text=text_col)
    docs = docs.withColumn("id", F.col("id").cast("long"))
    rows = keep(profiles(docs, n))
    sets = ["n_shingles", "s1", "s2"]
    real = rows.where("n_shingles > 0 and id is not null")
    classes = real.groupBy(*sets).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    member = keep(real.select("id", *sets).distinct().join(classes, sets).select("id", "rep", "copies", "n_shingles"))
    same_id = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    # Groups with the same smallest class are one group, named by it: many blocks, one set of classes.
    stars = keep(_stars(_tokens(docs.where("id is not null"), n, make)))
    side = lambda x: member.select(F.col("id").alias(x), F.col("rep").alias("r" + x), F.col("n_shingles").alias("n" + x))
    met = stars.join(side("b"), "b").join(side("a"), "a").where("ra <> rb")
    both = F.explode(F.array(F.struct("ra", F.col("rb").alias("rep"), F.col("nb").alias("n")), F.struct("ra", F.col("ra").alias("rep"), F.col("na").alias("n"))))
    group = keep(met.select(both.alias("g")).select(F.col("g.ra").alias("token"), "g.rep", F.col("g.n").alias("n_shingles")).distinct())
    drop(stars)
    wanted = group.select(F.col("rep").alias("id")).distinct()
    sketches = keep(real.join(wanted, "id", "left_semi").select(F.col("id").alias("rep"), "n_shingles", "sketch", "coarse").dropDuplicates(["rep", "n_shingles"]))
    pairs = group.where("rep <> token").select(F.col("token").alias("a"), F.col("rep").alias("b"))
    # Each class meets the smallest of all groups' first, then those of other components only.
    least = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    near = _linked(_near(least, sketches), docs, n)
    first = keep(components(near.union(same_id)))
    part = lambda x: first.select(F.col("node").alias(x), F.col("component").alias("c" + x))
    more = pairs.join(least, ["a", "b"], "left_anti").join(part("a"), "a", "left").join(part("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    more = _linked(_near(more, sketches), docs, n)
    drop(first)
    first = keep(components(near.union(more).union(same_id)))
    placed = group.join(first, group.rep == first.node, "left").select("token", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    open_ = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"), F.sum("n_shingles").alias("n")).where("lo <> hi and c > 2").select("token", F.ceil(F.greatest(F.col("c") / CELL, F.col("n") / CELL_SHINGLES)).alias("cells"))
    far = _across(placed.drop("n_shingles").join(open_, "token"), sketches, docs, n)
    links = keep(near.union(more).union(far).union(same_id))
    drop(group, sketches, first, near, more, far)
    last = keep(components(links))
    involved = member.join(last, F.col("rep") == F.col("node"), "left").where("copies > 1 or node is not null")
    joined = rows.join(classes, sets, "left").join(last, F.col("rep") == F.col("node"), "left")
    return {"rows": joined.select("id", "n_shingles", F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "rep", "id")).alias("component")), "members": involved.select("id", F.coalesce("component", "rep").alias("component")), "links": links}


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, the one with the smallest id; rows without an id all stay."""
    id_col = how.get("id_col", "doc_id")
    rows = keep(join(docs, **how)["rows"])
    own = OWN + "id"
    keyed = docs.withColumn(own, F.col(f"`{id_col}`").cast("long"))
    out = among(keyed, rows.where("id <> component").select(F.col("id").alias(own)), "left_anti")
    again = keep(rows.where("id is not null").groupBy(F.col("id").alias(own)).count().where("count > 1").select(own))
    if again.isEmpty():
        return out.select(*[F.col(f"`{c}`") for c in docs.columns])
    # Rows that share an id are one document: the first of each id stays.
    twice = among(out, again, "left_semi").dropDuplicates([own])
    return among(out, again, "left_anti").unionByName(twice).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows = join(docs)["rows"]
    return rows.select(F.col("id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
