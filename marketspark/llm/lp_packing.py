"""Best-fit packing by a configuration linear program over the length histogram.

The program has a variable for each way to fill a sequence. Multiplicative weights solve it: prices on the lengths,
a knapsack dynamic program that finds the fillings worth most at these prices, and lower prices for lengths that
get more than their share. The rounded fillings are dealt to the pieces by their rank within a length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import slices, stash

CAPACITY = 1024
_SHIFT = 42  # ranks are below 2**42
_TOKENIZERS: dict = {}


# ---- tokens ------------------------------------------------------------------------------
def encoder(ranks_path: str, special: tuple[str, int] = ("<|endoftext|>", 50256)):
    """Text to ids by a byte-level BPE rank file; the special token's string is that token, as the json file has it."""
    key = (ranks_path, special)
    if key not in _TOKENIZERS:
        import base64

        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict([special]))

        def encode(text: str) -> list[int]:
            return enc.encode(text, allowed_special={special[0]}, disallowed_special=()) if special[0] in text else enc.encode_ordinary(text)
        _TOKENIZERS[key] = encode
    return _TOKENIZERS[key]


def pieces(docs: DataFrame, ranks_path: str, eos: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, local): documents as ids and an end token, cut to ``capacity``.

    Only longer documents are cut, into full pieces after a first one that may be shorter. ``local`` counts the
    pieces of a length in their task ``part``. Null text is an empty text: one piece with the end token. ``keep_ids``
    adds the ids themselves.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", *["ids"] * keep_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * keep_ids]

    def run(batches):
        encode, part, seen = encoder(ranks_path), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), eos], "<u4")
                n, at = len(ids), 0
                for k in range(-(-n // capacity)):
                    end = at + ((n - 1) % capacity + 1 if k == 0 else capacity)
                    row = [doc, k, at, end - at, zlib.crc32(ids[at:end].tobytes()), part, seen[end - at]]
                    seen[end - at] += 1
                    for col, v in zip(out, [*row, *[ids[at:end].astype(np.int32)] * keep_ids]):
                        col.append(v)
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


# ---- the program -------------------------------------------------------------------------
def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of each room 0..capacity, and the size to take there first (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    up_to = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = up_to[c]
        if not k:
            continue
        worth = values[:k] + best[c - sizes[:k]]
        j = int(worth.argmax())
        best[c], take[c] = worth[j], sizes[j]
        if best[c - 1] > best[c]:
            best[c], take[c] = best[c - 1], -1
    return best, take


def _filling(size: int, take: np.ndarray, capacity: int) -> tuple[int, ...]:
    out, room = [size], capacity - size
    while room > 0 and take[room]:
        if take[room] < 0:
            room -= 1
        else:
            out.append(int(take[room]))
            room -= int(take[room])
    return tuple(sorted(out, reverse=True))


def solve(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = 60, eta: float = 0.3, slack: float = 0.02) -> tuple[dict[tuple[int, ...], float], float]:
    """({filling: how often, fractional}, lower bound on sequences) for counts of pieces by length.

    Each round prices the fillings led by every length, keeps those within ``slack`` of the best and gives each
    its leading length's demand as a share of the round. Prices then fall by exp(-eta * coverage / largest coverage).
    The bound is the best dual value met (prices over the best filling's price), or total length over capacity.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), np.int64)
    if not len(sizes):
        return {}, 0.0
    d = np.array([demand[s] for s in sizes.tolist()], float)
    at = {s: i for i, s in enumerate(sizes.tolist())}
    # start at the lengths themselves, slightly dearer for long pieces, which are harder to place
    y = sizes / capacity * (1 + 0.1 * sizes / capacity)
    x: Counter = Counter()
    bound = float((sizes * d).sum() / capacity)
    for _ in range(rounds):
        best, take = price(y, sizes, capacity)
        led = y + best[capacity - sizes]
        top = led.max()
        bound = max(bound, float((y * d).sum() / top))
        kept = np.flatnonzero(led >= top * (1 - slack))
        cover = np.zeros(len(sizes))
        got = []
        for i in kept.tolist():
            f = _filling(int(sizes[i]), take, capacity)
            got.append((f, d[i] / f.count(int(sizes[i]))))
            for s in f:
                cover[at[s]] += got[-1][1]
        ratio = cover / d
        share = 1 / max(ratio.max(), 1e-9)
        for f, w in got:
            x[f] += w * share
        y *= np.exp(-eta * ratio * share)
        y *= sizes.sum() / capacity / max(y.sum(), 1e-300)
    # scale to what is asked for: as much of every length as the pieces give, on average
    cover = np.zeros(len(sizes))
    for f, w in x.items():
        for s in f:
            cover[at[s]] += w
    scale = float(d.sum() / max(cover.sum(), 1e-9))
    return {f: w * scale for f, w in x.items()}, bound


def whole(x: dict[tuple[int, ...], float], left: Counter) -> Counter:
    """The floor of ``x``, fullest fillings first, as far as ``left`` has the pieces; takes them out of ``left``."""
    out: Counter = Counter()
    for f, w in sorted(x.items(), key=lambda fw: (-sum(fw[0]), -fw[1], fw[0])):
        need = Counter(f)
        q = min([int(w), *(left[s] // k for s, k in need.items())])
        if q > 0:
            out[f] += q
            for s, k in need.items():
                left[s] -= q * k
    return out


def best_fit(left: Counter, capacity: int) -> Counter:
    """Best-fit decreasing by counts: each length into the fullest open sequences that still have room, alike ones at once.

    Sequences filled alike are one entry with a count, so the work goes with the number of lengths and of fillings in
    use, however many pieces there are.
    """
    room: list[Counter] = [Counter() for _ in range(capacity + 1)]  # open fillings by what still fits
    room[capacity][()] = left.total()
    for s in sorted(left, reverse=True):
        n = left[s]
        for fit in range(s, capacity + 1):
            each = fit // s
            for f in list(room[fit]):
                if not n:
                    break
                m = min(room[fit][f], n // each)  # so many take as many as fit, one more the rest
                for seqs, k in ((m, each), (1, n % each if m < room[fit][f] and n < (m + 1) * each else 0)):
                    if seqs and k:
                        room[fit][f] -= seqs
                        room[fit - k * s][f + (s,) * k] += seqs
                        n -= seqs * k
                if not room[fit][f]:
                    del room[fit][f]
    del room[capacity][()]
    out: Counter = Counter()
    for fillings_ in room:
        out.update(fillings_)
    return out


def fillings(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = 60) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of fillings that use up every piece exactly.

    The program's solution is cut to whole numbers and the program solved again for what is left, until that is no more
    than the fillings in use or a solution places less than a tenth of it; best fit by counts deals with the rest. So
    the work here goes with the number of fillings and the logarithm of the counts, not with the corpus.
    """
    left = Counter({s: n for s, n in demand.items() if n})
    out: Counter = Counter()
    while (before := left.total()) > len(out):
        out += whole(solve(left, capacity, rounds)[0], left)
        left = +left
        if left.total() > before * 0.9:
            break
    return sorted((out + best_fit(left, capacity)).items())


@dataclass(frozen=True)
class Slots:
    """Where the rank-th piece of a length goes: from ``start`` (length and rank) on, sequences from ``first`` at ``offset``."""

    start: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(fillings: list[tuple[tuple[int, ...], int]]) -> Slots:
        rows, used, seq = [], Counter(), 0
        for f, q in fillings:
            at = 0
            for s in f:
                rows.append(((s << _SHIFT) + used[s], seq, at))
                used[s] += q
                at += s
            seq += q
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 3)
        return Slots(a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy())

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << _SHIFT) + rank
        i = np.searchsorted(self.start, key, "right") - 1
        return self.first[i] + key - self.start[i], self.offset[i]


def pack(docs: DataFrame, ranks_path: str, eos: int = 2, capacity: int = CAPACITY, keep_ids: bool = False, rounds: int = 60) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    Documents are read and encoded once; the pieces are kept in the shared folder. To the driver come ``capacity``
    counts. A piece's rank within its length is its task's offset plus its place there, so a length that a third of
    all pieces share is spread like any other. The slot table has a few entries for each filling in use and travels
    as a broadcast: at most ``rounds * capacity`` fillings for each time the program is solved. An empty table gives no rows; repeated documents are
    packed as often as they come.
    """
    spark = docs.sparkSession
    p = stash(pieces(docs, ranks_path, eos, capacity, keep_ids), "pieces")
    by_task = stash(p.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    demand = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots.of(fillings(demand, capacity, rounds)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    r = p.join(offsets, ["length", "part"]).withColumn("rank", F.col("skip") + F.col("local"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def place(batches):
        for b in batches:
            seq, off = slots.value.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*names, "sequence_id", "offset"])
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return r.select(*names, "rank").mapInArrow(place, ddl)
