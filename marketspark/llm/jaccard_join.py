"""Exact self-join of documents in the Jaccard metric of their word shingles, by pivots and windows.

Level one has every shingle as a pivot, rarest first in one fixed order. A document's home region is that of its first
shingle s1 (of all pivots {s} the nearest, with ties to the rarer). A document x at distance d(x, y) <= r from y has
d(x, x & y) = |x - y| / |x| <= r by monotonicity, so y holds one of the first |x| - ceil((1 - r) |x|) + 1 shingles of
x: x is replicated into the regions of that window and meets every partner in one of them.

Level two works inside regions that are not small. Documents of the region serve as pivots: all members are measured
against them exactly, and those within r of a pivot fall into its component. A region whose members are one component
is done, as its other pairs cannot change the result. In the rest, pairs of different components are left, and of these
only such as the triangle inequality at a pivot, the sizes and the counts of shingles by cell allow (all of them lower
bounds of the distance, so nothing is lost). They are measured nearest first, in rounds, so that components grow before
the last round tries whatever is still open; a region that had no more pairs than its round takes is done, and is sent
to no later round. Large regions split into blocks that meet two at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import bounded, components, shingles, shuffles, slices, stash, text_buffer, word_hashes

WORDS, PERCENT = 5, 80
#: a region of so many members at most has all its pairs tried at once
SMALL = 12
PIVOTS = 3
#: bits of the table of common shingles, a fixed size for any corpus; a false hit only changes the order
BITS = 22
#: text whose shingles are counted together, and the count from which a shingle is common
SPAN, COMMON = 16 << 20, 24
_SALTS = 64
#: shingles are also counted in cells by their leading bits; cell counts differ by no more than the sets do. A set has
#: 2**CELL_BITS[0] cells at least and 2**CELL_BITS[1] at most, in between so many that a cell has CELL_FILL on average
CELL_BITS, CELL_FILL = (7, 13), 4
#: regions whose members are not yet one component: so many nearest partners for each member and round, at last all
ROUNDS = (4, 16, None)
#: members of a block of a region; blocks of large regions meet pairwise
BLOCK = 2_000
#: regions of one pivot are tried in one place, up to so many members, so that a pair they share is tried once
TOGETHER = 16 * BLOCK
#: pairs of members, and cells of such pairs, that are looked at at a time
PAIRS, CELLS = 1 << 16, 1 << 22


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    return shingles(*word_hashes(*text_buffer(batch.column("text"))), words)


def _repeated(words: int):
    """Shingles that several documents of a span of text share, with how many do."""
    def counted(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["s", "n"])

    def run(batches):
        held, size = [], 0
        for batch in slices(batches, "text"):
            held += _sets(batch, words)
            size += batch.column("text").nbytes
            if size > SPAN:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)
    return run


def common_shingles(docs: DataFrame, words: int = WORDS, least: int = COMMON) -> np.ndarray:
    """A table of 2**BITS flags: whether a common shingle falls there. All documents are counted, span by span."""
    n = docs.select("text").mapInArrow(_repeated(words), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bit = F.col("s").bitwiseAND(F.lit((1 << BITS) - 1))
    # at most 2**BITS / 32 rows
    w = n.groupBy(F.shiftright(bit, 5).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int((s & {(1 << BITS) - 1}L) & 31L))")).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 5), np.uint32)
    table[w.column("w").to_numpy()] = w.column("bits").to_numpy().astype(np.uint32)
    return table


def _cells(s: np.ndarray) -> bytes:
    bits = min(max((len(s) // CELL_FILL).bit_length(), CELL_BITS[0]), CELL_BITS[1])
    return np.minimum(np.bincount(s >> np.uint64(64 - bits), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _folded(counts: np.ndarray, width: int) -> np.ndarray:
    """Rows of cell counts in ``width`` wider cells, as if they had been counted there."""
    if counts.shape[1] == width:
        return counts
    return np.minimum(counts.reshape(len(counts), width, -1).sum(axis=2, dtype=np.int64), 255).astype(np.uint8)


class _Cells:
    """Cell counts of many sets; two sets compare by the cells of the coarser."""

    def __init__(self, cells: list[bytes]):
        self.width = np.array([len(c) for c in cells], np.int64)
        self.rows = {w: np.flatnonzero(self.width == w) for w in np.unique(self.width).tolist()}
        self.own = {w: np.frombuffer(b"".join(cells[i] for i in at.tolist()), np.uint8).reshape(len(at), w) for w, at in self.rows.items()}
        self.at, self.table = {}, {}

    def counts(self, i, width: int) -> np.ndarray:
        """Of the sets ``i``, all with at least so many cells."""
        if width not in self.table:
            wide = [w for w in self.rows if w >= width]
            self.at[width] = np.zeros(len(self.width), np.int64)
            self.at[width][np.concatenate([self.rows[w] for w in wide])] = np.arange(sum(len(self.rows[w]) for w in wide))
            self.table[width] = np.concatenate([_folded(self.own[w], width) for w in wide])
        return self.table[width][self.at[width][i]]

    def apart(self, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
        """By how much the counts of ``i`` and ``j`` differ, pair by pair, in ``width`` cells; CELLS of them at a time."""
        out, step = np.empty(len(j), np.int64), max(CELLS // width, 1)
        for lo in range(0, len(j), step):
            x, y = self.counts(i[lo:lo + step], width), self.counts(j[lo:lo + step], width)
            out[lo:lo + step] = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
        return out

    def differ(self, i, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of ``i`` (one for each of ``j``, or the same for all) and ``j`` have counts that differ by
        ``most`` at most, and by how much."""
        i, low = np.broadcast_to(i, j.shape), 1 << CELL_BITS[0]
        found = self.apart(i, j, low)
        at = np.flatnonzero(found <= most)
        i, j, most, found = i[at], j[at], most[at], found[at]
        common = np.minimum(self.width[j], self.width[i])
        for w in np.unique(common[common > low]).tolist():
            wide = common == w
            found[wide] = self.apart(i[wide], j[wide], w)
        return at[found <= most], found[found <= most]


def _pivots(s: np.ndarray, often: int) -> np.ndarray:
    """Numbers of shingles as pivots, in the one order of all windows: rare ones first, then by hash."""
    return (s >> np.uint64(2)).astype(np.int64) + (often << 62)


def _measured(words: int, percent: int, common):
    """Each row's set: size, digest and window of pivots; equal sets of one task show their window once."""
    def run(batches):
        table, met = common.value, set()
        for batch in slices(batches, "text"):
            n, dig, win, hist = [], [], [], []
            for s in _sets(batch, words):
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                dig.append(d if len(s) else None)
                if not len(s) or d in met:
                    win.append(None)
                    hist.append(None)
                    continue
                hist.append(_cells(s))
                if len(met) >= 1 << 20:
                    met.clear()
                met.add(d)
                k = len(s) - -(-len(s) * percent // 100) + 1
                low = s & np.uint64((1 << BITS) - 1)
                often = (table[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & 1
                rare = s[often == 0][:k]
                win.append(np.concatenate((_pivots(rare, 0), _pivots(s[often == 1][:k - len(rare)], 1))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(win, pa.list_(pa.int64())), pa.array(hist, pa.binary())],
                                             names=["row", "doc_id", "n", "dig", "window", "cells"])
    return run


class _Regions:
    """Regions streaming by in the order (s, h). Pairs to try, and members of regions that are not small.

    Of a small region all pairs are tried, of another each member with the first few, its pivots. Only the first
    members of the region at hand are held.
    """

    def __init__(self, percent: int, small: int, pivots: int):
        self.percent, self.small, self.pivots = percent, small, pivots
        self.now, self.head, self.many, self.out = None, [], False, []

    def pair(self, x: tuple[int, int], y: tuple[int, int]):
        if x[0] != y[0] and min(x[1], y[1]) * 100 >= self.percent * max(x[1], y[1]):
            self.out.append((min(x[0], y[0]), max(x[0], y[0]), None, None))

    def member(self, x: tuple[int, int]):
        self.out.append((None, x[0], self.now, x[1]))
        for p in self.head[:self.pivots]:
            self.pair(p, x)

    def close(self):
        if not self.many:
            for i, x in enumerate(self.head):
                for y in self.head[i + 1:]:
                    self.pair(x, y)
        self.head, self.many = [], False

    def add(self, s: int, x: tuple[int, int]):
        if s != self.now:
            self.close()
            self.now = s
        if self.many:
            return self.member(x)
        self.head.append(x)
        if len(self.head) > self.small:
            self.many = True
            for y in self.head:
                self.member(y)
            del self.head[self.pivots:]

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) or [[]] * 4
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "s", "n"])


def _met(percent: int, small: int, pivots: int):
    def run(batches):
        g = _Regions(percent, small, pivots)
        for batch in batches:
            s = batch.column("s").to_numpy()
            same = s[1:] == s[:-1]
            near = np.zeros(len(s), bool)  # most regions have one member: these need no look, but for the batch's ends
            near[1:] |= same
            near[:-1] |= same
            near[:1] = near[-1:] = True
            at = np.flatnonzero(near)
            for key, ref, n in zip(s[at].tolist(), batch.column("ref").to_numpy()[at].tolist(), batch.column("n").to_numpy()[at].tolist()):
                g.add(key, (ref, n))
            yield g.flush()
        g.close()
        yield g.flush()
    return run


def _compared(words: int):
    """Exact intersections: rows sorted by (a, salt, b), where b null carries the pivot's own text."""
    def run(batches):
        own = None
        for batch in slices(batches, "text"):
            out = []
            for s, a, b in zip(_sets(batch, words), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if b is None:
                    own = s
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                out.append((a, b, both, len(own) + len(s) - both))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "both", "all"])
    return run


def _far(percent: int):
    """Pairs with what cell counts say: whether they may link, and a lower bound of their distance."""
    def run(batches):
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            x, y = (_Cells(batch.column(k).to_pylist()) for k in ("cells_a", "cells_b"))
            common, differ = np.minimum(x.width, y.width), np.zeros(batch.num_rows, np.int64)
            for w in np.unique(common).tolist():
                at = np.flatnonzero(common == w)
                p, q = x.counts(at, w), y.counts(at, w)
                differ[at] = (np.maximum(p, q) - np.minimum(p, q)).sum(axis=1, dtype=np.int64)
            both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            may = differ * (100 + percent) <= (100 - percent) * both
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(may), pa.array(2 * differ / (both + differ))], names=["a", "b", "may", "low"])
    return run


def compare(pairs: DataFrame, reps: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT, small: int = 500_000) -> DataFrame:
    """(a, b, both, all, low, high): each pair of rows with its sets' intersection and union, and its distance between.

    Pairs that cell counts put beyond the radius need no look: their sizes stay null, ``low`` is the counts' bound and
    ``high`` one. Other pairs carry the text of b; the text of a goes once to each of its salts that has pairs, so a pivot
    that a third of all rows is measured against is spread.
    """
    n = shuffles(pairs.sparkSession)
    r, few = reps.select("ref", "n", "cells"), bounded(pairs.select("a", "b"), small)
    partner = r.toDF("b", "n_b", "cells_b").join(few, "b", "left_semi")  # counts of sets in no pair do not travel
    x = r.toDF("a", "n_a", "cells_a").join(few, "a").join(partner, "b")
    x = stash(x.select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(_far(percent), "a long, b long, may boolean, low double"), "bounded")
    p = x.where("may").select("a", "b", F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int").alias("salt"))
    t = texts.select("row", "text")
    partners = t.join(bounded(p, small), p["b"] == t["row"])
    own = p.select("a", "salt").distinct()
    heads = t.join(bounded(own, small), own["a"] == t["row"])
    rows = partners.select("a", "salt", "b", "text").union(heads.select("a", "salt", F.lit(None).cast("long"), "text"))
    rows = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    y = rows.select("a", "b", "text").mapInArrow(_compared(words), "a long, b long, both long, all long")
    d = 1 - F.col("both") / F.col("all")
    far = x.where("NOT may").select("a", "b", F.lit(None).cast("long").alias("both"), F.lit(None).cast("long").alias("all"), "low", F.lit(1.0).alias("high"))
    return stash(y.select("a", "b", "both", "all", d.alias("low"), d.alias("high")).union(far), "measured")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of ``docs`` (row, doc_id, text).

    ``classes``: row, doc_id, n_shingles, ref, component, for every row; ``ref`` is the row that stands for all with
    the same set, ``component`` the smallest ref reachable by links of 100 * intersection >= ``percent`` * union
    (ref and component are the row itself for documents without words). ``links``: a, b, both, all between different
    sets, enough of them to join every component; others inside a component need not be there.

    Null text has no words. Repeated rows share a ref; an empty table gives empty results. ``row`` is any distinct
    number, the same at every reading. Nothing is sampled or capped: a region of any size streams through, its
    members are measured against its pivots, and what these leave open is tried in rounds until nothing is.
    """
    spark, n = docs.sparkSession, shuffles(docs.sparkSession)
    common = spark.sparkContext.broadcast(common_shingles(docs, words))
    sets = stash(docs.select("row", "doc_id", "text").mapInArrow(_measured(words, percent, common), "row long, doc_id long, n long, dig binary, window array<long>, cells binary"), "sets")
    reps = stash(_first(sets.where("window IS NOT NULL")).select(F.col("row").alias("ref"), "n", "window", "cells"), "refs")
    index = reps.select("ref", "n", F.explode("window").alias("s")).repartition(n, "s").sortWithinPartitions("s", F.xxhash64("ref")).select("s", "ref", "n")
    met = stash(index.mapInArrow(_met(percent, SMALL, PIVOTS), "a long, b long, s long, n long"), "regions")
    measured = compare(stash(met.where("a IS NOT NULL").select("a", "b").distinct(), "pairs"), reps, docs, words, percent)
    members = _placed(_unlike(met.where("s IS NOT NULL").select("s", F.col("b").alias("ref"), "n")), measured)
    near = F.col("both") * 100 >= F.col("all") * percent
    lab = components(measured.where(near))
    for most in ROUNDS:
        pairs = stash(_block_pairs(_open(members, lab), reps, percent, most).join(measured, ["a", "b"], "left_anti"), "pairs")
        new, left = pairs.select(F.count("a"), F.count_if(F.col("a").isNull())).first()
        if new:
            found = compare(pairs.where("a IS NOT NULL"), reps, docs, words, percent)
            measured = measured.union(found)
            if not found.where(near).isEmpty():
                lab = components(measured.where(near))
        if not left:
            break
        members = members.join(pairs.where("a IS NULL").select(F.col("b").alias("s")), "s", "left_semi")
    refs = sets.where("dig IS NOT NULL").groupBy("dig").agg(F.min("row").alias("ref"))
    refs = refs.join(lab.withColumnRenamed("node", "ref"), "ref", "left").select("dig", "ref", F.coalesce("comp", "ref").alias("component"))
    classes = sets.select("row", "doc_id", F.col("n").alias("n_shingles"), "dig").join(refs, "dig", "left")
    return classes.select("row", "doc_id", "n_shingles", F.coalesce("ref", "row").alias("ref"), F.coalesce("component", "row").alias("component")), measured.where(near).select("a", "b", "both", "all")


def _first(sets: DataFrame, small: int = 1_000_000) -> DataFrame:
    """The row with the smallest number of each digest. Only numbers and digests are grouped, and the numbers of the
    other rows, up to ``small`` of them, go to where the sets are."""
    x = sets.select("dig", "row")
    least = x.groupBy("dig").agg(F.min("row").alias("least"))
    others = stash(x.join(least, "dig").where("row <> least").select("row"), "others")
    return sets.join(bounded(others, small), "row", "left_anti")


def _unlike(members: DataFrame) -> DataFrame:
    """Members (s, ref, n) of one region for each set of members: the others would try the same pairs again.

    Documents that share a passage meet in every region of its shingles. Sets compare by size and two 64-bit digests.
    """
    digests = (F.bit_xor(F.xxhash64(F.lit(k), "ref")).alias(f"d{k}") for k in (1, 2))
    sets = members.groupBy("s").agg(F.count("*").alias("k"), *digests)
    one = sets.groupBy("k", "d1", "d2").agg(F.min("s").alias("s")).select("s")
    return members.join(one, "s", "left_semi")


def _placed(members: DataFrame, measured: DataFrame) -> DataFrame:
    """Members with the pivot p of their region and their distance from it, between low and high; stored.

    The pivot is the first of the region's members by hash, as where regions streamed by; who was too long or too short
    to be measured against it may be at any distance.
    """
    first = members.groupBy("s").agg(F.min(F.struct(F.xxhash64("ref").alias("h"), "ref")).alias("p")).select("s", F.col("p.ref").alias("p"))
    d = measured.select("a", "b", "low", "high")
    d = d.union(d.select("b", "a", "low", "high")).toDF("p", "ref", "low", "high")
    own = F.col("p") == F.col("ref")
    x = members.join(first, "s").join(d, ["p", "ref"], "left")
    return stash(x.select("s", "ref", "n", "p", F.when(own, 0.0).otherwise(F.coalesce("low", F.lit(0.0))).alias("low"), F.when(own, 0.0).otherwise(F.coalesce("high", F.lit(1.0))).alias("high")), "members")


def _open(members: DataFrame, lab: DataFrame) -> DataFrame:
    """Members with their comp, of the regions that still hold more than one component; stored. ``blocks``: of the
    region; ``part``: regions of one pivot have the same, if they have up to TOGETHER members in all."""
    m = members.join(lab.withColumnRenamed("node", "ref"), "ref", "left").withColumn("comp", F.coalesce("comp", "ref"))
    mixed = m.groupBy("s", "p").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("s", "p", "k")
    parts = mixed.groupBy("p").agg(F.ceil(F.sum("k") / TOGETHER).alias("parts"))
    regions = mixed.join(parts, "p").select("s", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"), F.pmod(F.xxhash64("s"), F.col("parts")).alias("part"))
    return stash(m.join(regions, "s"), "open")


def _candidates(percent: int, most: int | None, left: bool = False):
    """Pairs that may link, from rows sorted by (p, part, lo, hi, s): of different components, near enough by sizes, by
    cell counts and by the triangle inequality at the region's pivot; of each member the ``most`` nearest by cell counts.
    With ``left`` also (null, s) for regions where some member had more than that: all others have no pair left to try.

    Texts that resemble each other share many regions, and most of these have the same member as pivot. They come one
    after the other, so a pair that was tried in one is not tried in the next."""
    r = 1 - percent / 100 + 1e-9
    place, names = ("p", "part", "lo", "hi"), ("ref", "n", "comp", "block", "low", "high")

    def tried(rows, key: tuple, seen: set) -> list[tuple[int | None, int]]:
        """Only pairs of different blocks, where two blocks meet."""
        apart, more = key[2] != key[3], False
        ref, n, comp, block, low, high = (np.concatenate([x[k] for x in rows]) for k in names)
        cells, out, every = _Cells([c for x in rows for c in x["cells"]]), [], np.arange(len(ref))
        step = max(PAIRS // len(ref), 1)
        for at in range(0, len(ref) - 1, step):
            x, y = every[at:at + step, None], every[None, at + 1:]
            ok = (y > x) & (comp[y] != comp[x]) & (np.minimum(n[y], n[x]) * 100 >= percent * np.maximum(n[y], n[x])) & (low[y] - high[x] <= r) & (low[x] - high[y] <= r)
            if apart:
                ok &= block[y] != block[x]
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            i, j = i + at, j + at + 1
            near, differ = cells.differ(i, j, (100 - percent) * (n[j] + n[i]) // (100 + percent))
            pairs = [(min(a, b), max(a, b)) for a, b in zip(ref[i[near]].tolist(), ref[j[near]].tolist())]
            new = np.fromiter((p not in seen for p in pairs), bool, len(pairs))
            if most is not None:
                k = np.flatnonzero(new)
                k = k[np.lexsort((differ[k], i[near][k]))]
                rank = np.arange(len(k)) - np.searchsorted(i[near][k], i[near][k])
                new[k[rank >= most]] = False
                more |= bool((rank >= most).any())
            out += [p for p, use in zip(pairs, new.tolist()) if use]
        seen.update(out)
        return out + [(None, key[4])] if left and more else out

    def run(batches):
        now, held, seen = None, [], set()
        for batch in batches:
            cols = {k: batch.column(k).to_numpy() for k in ("s", *place, *names)}
            cells = batch.column("cells")
            keys = np.stack([cols[k] for k in (*place, "s")], axis=1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out = []
            for i, j in zip(cut, cut[1:]):
                if j > i:
                    key = tuple(keys[i].tolist())
                    if key != now:
                        out += tried(held, now, seen) if held else []
                        if now is None or key[:-1] != now[:-1]:
                            seen.clear()
                        now, held = key, []
                    held.append({k: cols[k][i:j] for k in names} | {"cells": cells.slice(i, j - i).to_pylist()})
            yield _pairs(out)
        yield _pairs(tried(held, now, seen) if held else [])
    return run


def _pairs(rows: list[tuple[int | None, int]]) -> pa.RecordBatch:
    cols = list(zip(*set(rows))) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _block_pairs(m: DataFrame, reps: DataFrame, percent: int, most: int | None) -> DataFrame:
    """(a, b): pairs of open regions that may link, and (null, s) of regions that keep some for the next round. A region
    is one block, or blocks that meet two at a time, each meeting in a task of its own; only pairs that pass every test
    leave it."""
    n = shuffles(m.sparkSession)
    x = m.join(reps.select("ref", "cells"), "ref")
    x = x.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "ref"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("p", "part", "s", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "ref", "n", "comp", "block", "low", "high", "cells")
    x = x.repartition(n, "p", "part", "lo", "hi").sortWithinPartitions("p", "part", "lo", "hi", "s")
    return x.mapInArrow(_candidates(percent, most, left=True), "a long, b long").distinct()


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, keep_row): component_id is the smallest doc_id of the component.

    Null identifiers count only where a component has no other. ``keep_row`` is the row with the smallest doc_id
    (null last), then the smallest row: the one document of each group that stays.
    """
    classes = stash(join(docs, words, percent)[0], "classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    by_ref = classes.groupBy("ref", "component").agg(best)
    whole = by_ref.groupBy("component").agg(F.min("best").alias("best"))
    refs = by_ref.select("ref", "component").join(whole, "component").select("ref", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("keep_row"))
    return classes.select("row", "doc_id", "n_shingles", "ref").join(refs, "ref").select("row", "doc_id", "n_shingles", "component_id", "keep_row")
