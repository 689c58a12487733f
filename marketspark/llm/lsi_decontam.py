"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answers.

TF-IDF weighs the benchmark's words by counts over all documents; a randomised SVD of TF-IDF passages gives a latent
space; every passage of every document is compared with every item there, and what is near is read word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import slices, stash, text_buffer, word_hashes

#: words of a passage and how far the next one starts
PASSAGE, STRIDE = 32, 16
#: latent dimensions, and the extra ones while fitting
RANK, EXTRA, POWER = 64, 8, 2
#: the space is fitted to all passages of all documents and the items; documents weigh as much as so many of them do on
#: average, so that items keep their share of the space in a corpus of any size
FIT_DOCS = 2_000
#: strides whose vectors are held at a time while fitting
HELD = 8_192
#: an item counts as so many passages squared, so that the space has room for what tells items apart
ITEM_WEIGHT = 16.0
#: items that are searched in one reading of the documents
BLOCK = 1_000
LEAST_WORDS = 5
#: longer items are looked for in parts of so many words
LONGEST = 64


@dataclass(frozen=True)
class Items:
    """Passages of benchmark items, as word hashes, with the sorted distinct words of all of them."""

    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        ids, words = [], []
        h, at = word_hashes(*text_buffer(pa.array([t for _, t in rows], pa.string())))
        for (item, _), a, b in zip(rows, at.tolist(), at[1:].tolist()):
            cuts = list(range(a, b, LONGEST)) if b - a > LONGEST else [a]
            for s, e in zip(cuts, [*cuts[1:], b]):
                if e - s >= LEAST_WORDS:
                    ids.append(item)
                    words.append(h[s:e])
        return Items(ids, words, np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64))


class Terms:
    """Places of hashes in a sorted vocabulary, after a quick look at a table of low bits."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[vocabulary & np.uint64((1 << 20) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h`` that hold a vocabulary word, which word)."""
        at = np.flatnonzero(self.maybe[h & np.uint64((1 << 20) - 1)])
        k = np.searchsorted(self.vocabulary, h[at])
        ok = self.vocabulary[np.minimum(k, len(self.vocabulary) - 1)] == h[at]
        return at[ok], k[ok]


def occurrences(docs: DataFrame, items: Items) -> tuple[DataFrame, np.ndarray, int]:
    """(occurrences of vocabulary words; in how many documents each occurs; how many documents there are), in one reading.

    A stored row stands for a slice of documents: the words found, by number and in order; how many of them lie in each
    STRIDE of a document; and whether that is the document's first (1) or last (2). Two neighbours are a passage; so is
    the one of a short document. Documents of fewer than LEAST_WORDS words have no passage but count.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    names = ["words", "found", "ends", "k", "n"]

    def run(batches):
        terms, total, n = Terms(vocabulary.value), np.zeros(len(vocabulary.value), np.int64), 0
        for batch in slices(batches, "text"):
            h, at = word_hashes(*text_buffer(batch.column("text")))
            i, k = terms.find(h)
            row = np.searchsorted(at, i, "right") - 1
            own = np.sort(row * len(total) + k)
            total += np.bincount(own[np.flatnonzero(np.diff(own, prepend=-1))] % len(total), minlength=len(total))
            n += batch.num_rows
            long = np.diff(at)
            long = np.where(long >= LEAST_WORDS, -(-long // STRIDE), 0)
            upto = np.cumsum(long)
            use = long[row] > 0
            i, k, row = i[use], k[use], row[use]
            stride = (upto - long)[row] + (i - at[row]) // STRIDE
            ends = np.zeros(int(upto[-1]) if len(upto) else 0, np.uint8)
            ends[(upto - long)[long > 0]] |= 1
            ends[upto[long > 0] - 1] |= 2
            found = np.bincount(stride, minlength=len(ends)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (k.astype(np.uint32), found, ends)] + [pa.nulls(1, pa.list_(pa.int64()))] * 2, names=names)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary())] * 3 + [pa.array([x], pa.list_(pa.int64())) for x in (np.append(k, -1), np.append(total[k], n))], names=names)
    held = stash(docs.select("text").mapInArrow(run, "words binary, found binary, ends binary, k array<long>, n array<long>"), "lsi-words")
    each = held.where("k IS NOT NULL").select(F.explode(F.arrays_zip("k", "n")).alias("x")).select("x.k", "x.n")
    rows = each.groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row for each vocabulary word
    k, n = rows.column("k").to_numpy(), rows.column("n").to_numpy()
    df = np.zeros(len(items.vocabulary), np.int64)
    df[k[k >= 0]] = n[k >= 0]
    return held.where("words IS NOT NULL").select("words", "found", "ends"), df, int(n[k < 0].sum())


def _summed(table: np.ndarray, at: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Sums of the rows ``at`` of ``table``, whose last row is zero, over runs that begin at ``starts``, ``width`` rows at a time."""
    n = np.diff(np.append(starts, len(at)))
    rows = -(-n // width)
    upto = np.cumsum(rows)
    slots = np.full((int(upto[-1]), width), len(table) - 1)
    slots.reshape(-1)[np.arange(len(at)) + np.repeat((upto - rows) * width - starts, n)] = at
    out = np.empty((len(slots), table.shape[1]), table.dtype)
    for lo in range(0, len(slots), 1024):
        own = slots[lo:lo + 1024]
        part = table[own[:, 0]]
        for j in range(1, width):
            part += table[own[:, j]]
        out[lo:lo + 1024] = part
    return out if len(out) == len(starts) else np.add.reduceat(out, upto - rows, axis=0)


def moments(words: np.ndarray, found: np.ndarray, ends: np.ndarray, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sum over passages, rows w of TF-IDF of length one, of w times (w q); arrays of a row of :func:`occurrences`.

    A word's vector is added once for its stride, a stride's once for each of its one or two passages. Runs of HELD
    strides, and the one after, are worked out at a time.
    """
    total, size = np.zeros(q.shape), len(idf)
    at = np.concatenate(([0], np.cumsum(found, dtype=np.int64)))
    scaled = np.concatenate(((q * idf[:, None]).astype(np.float32), np.zeros((1, q.shape[1]), np.float32)))
    for lo in range(0, len(found), HELD):
        hi = min(lo + HELD + 1, len(found))
        w, f = words[at[lo]:at[hi]], found[lo:hi]
        if not len(w):
            continue
        first, last = ends[lo:hi] & 1 > 0, ends[lo:hi] & 2 > 0
        passage = ~last | first & last  # begins here; all but those of a single stride go on in the next
        passage[HELD:] = False
        goes = np.concatenate(([False], passage[:-1] & ~last[:-1]))  # the passage before goes on here
        stride, own = np.repeat(np.arange(len(f)), f), at[lo:hi] - at[lo]
        key, times = np.unique(np.concatenate([(stride[m] - back) * size + w[m] for m, back in ((passage[stride], 0), (goes[stride], 1))]), return_counts=True)
        squares = np.bincount(key // size, (times * idf[key % size]) ** 2, minlength=len(f))
        z = np.zeros((len(f) + 1, q.shape[1]), np.float32)
        z[np.flatnonzero(f)] = _summed(scaled, w, own[f > 0], STRIDE)
        u = z[:-1] + np.where(last[:, None], np.float32(0), z[1:])
        u *= np.where(passage & (squares > 0), 1 / np.maximum(squares, 1e-300), 0.0).astype(np.float32)[:, None]
        z[:-1] = u
        z[1:-1] += np.where(goes[1:, None], u[:-1], np.float32(0))
        by = np.argsort(w.astype(np.uint16) if size <= 1 << 16 else w, kind="stable")
        sorted_ = w[by]
        new = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        total[sorted_[new]] += _summed(z, stride[by], new, 8)
    return total * idf[:, None]


def _windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of the passages of rows with these word bounds; the last ones may be shorter."""
    rows, starts, ends = [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a >= LEAST_WORDS:
            s = np.arange(a, max(b - STRIDE, a + 1), STRIDE)
            rows.append(np.full(len(s), i))
            starts.append(s)
            ends.append(np.minimum(s + PASSAGE, b))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(rows), join(starts), join(ends)


def _latent(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, terms: Terms, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent vectors of passages and their lengths; a word's vector is added once for its stride, a stride's for each
    of its passages."""
    lo, hi = int(starts[0]), int(ends.max())
    i, k = terms.find(h[lo:hi])
    middle = starts + STRIDE
    cuts = np.unique(np.concatenate([starts, ends, middle[middle < ends]])) - lo
    at = np.searchsorted(i, cuts)
    at, full = at[:-1], np.flatnonzero(np.diff(at))
    z = np.zeros((len(cuts), basis.shape[1]), np.float32)
    if len(full):
        z[full] = _summed(np.concatenate((basis, np.zeros((1, basis.shape[1]), np.float32))), k, at[full], STRIDE)
    first, last = np.searchsorted(cuts, starts - lo), np.searchsorted(cuts, ends - lo)
    v = z[first]
    for j in range(1, int((last - first).max())):
        v += z[np.where(first + j < last, first + j, len(z) - 1)]  # the last one is empty
    return v, np.maximum(np.linalg.norm(v, axis=1), 1e-6)


def fit(words: DataFrame, n: int, items: Items, idf: np.ndarray, seed: int = 1) -> np.ndarray:
    """The latent basis (vocabulary by RANK, already weighed by idf), from a randomised SVD; ``words`` and ``n`` of
    :func:`occurrences`.

    Rows of the matrix are all passages of all documents, of length one, and the items, of length ITEM_WEIGHT. Each round multiplies a
    block of RANK + EXTRA vectors by the matrix and its transpose where the passages lie and adds up the products;
    the driver holds vocabulary by RANK + EXTRA numbers and orthonormalises them.
    """
    spark, size, width = words.sparkSession, len(items.vocabulary), min(RANK + EXTRA, len(items.vocabulary))
    weight, each = spark.sparkContext.broadcast(idf), min(1.0, FIT_DOCS / max(n, 1))

    def rows(h, starts, ends, terms, idf):
        i, k = terms.find(h)
        for a, b in zip(np.searchsorted(i, starts).tolist(), np.searchsorted(i, ends).tolist()):
            own, n = np.unique(k[a:b], return_counts=True)
            w = n * idf[own]
            norm = np.linalg.norm(w)
            if norm:
                yield own, w / norm
    terms = Terms(items.vocabulary)
    at = np.concatenate(([0], np.cumsum([len(w) for w in items.words])))
    own_rows = [(k, ITEM_WEIGHT * w) for k, w in rows(np.concatenate(items.words), at[:-1], at[1:], terms, idf)]

    def product(parts, q):
        out = np.zeros((size, q.shape[1]))
        for k, w in parts:
            out[k] += np.outer(w, w @ q[k])
        return out

    def gather(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)

        def run(batches):
            total = np.zeros_like(shared.value)
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("words", "found", "ends"))):
                    own, found, ends = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.uint32, np.uint8, np.uint8)))
                    total += moments(own.astype(np.int64), found, ends, weight.value, shared.value)
            at = range(0, size, 256)
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([total[a:a + 256].tobytes() for a in at], pa.binary())], names=["at", "sums"])

        def add(table: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
            return pa.table({"at": table.column("at").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})
        ddl = "at long, sums binary"
        total = product(own_rows, q)
        for r in words.mapInArrow(run, ddl).groupBy("at").applyInArrow(add, ddl).collect():  # size by width numbers in all
            total[r["at"]:r["at"] + 256] += each * np.frombuffer(r["sums"]).reshape(-1, q.shape[1])
        return total
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(gather(q))[0]
    small = q.T @ gather(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[:RANK]
    return ((q @ vectors[:, top]) * idf[:, None]).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, the columns of the table as the bits of one number."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def judge(item: np.ndarray, passage: np.ndarray, verbatim: float, paraphrase: float, answer: float) -> tuple[float, float, bool]:
    """(share of the item's words in common order, the same of its last quarter, the answer; whether it is a leak)."""
    last = item[-max(len(item) // 4, 3):]
    share = common_subsequence(item, passage) / len(item)
    told = common_subsequence(last, passage) / len(last)
    return share, told, share >= verbatim or (share >= paraphrase and told >= answer)


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, mass: float = 0.3, verbatim: float = 0.8, paraphrase: float = 0.6, answer: float = 0.9) -> DataFrame:
    """(row, doc_id, item_id, cosine, share, answer_share): leaked items of ``docs`` (row, doc_id, text), once each.

    A passage of a document is a candidate for an item when their latent cosine reaches ``cosine`` and ``mass`` of the
    item's latent vector lies in it (a passage may hold only a part of an item). It leaks the item
    when ``verbatim`` of the item's words stand in common order, or ``paraphrase`` of them and ``answer`` of its last
    quarter, read with an item's length more on both sides. Items with fewer than five words are left out, as any text holds
    them; null and empty texts leak nothing; repeated rows each leak; empty tables give no rows. Items are read in blocks,
    one reading of the documents for each: only a block of items, its words and its basis travel, never documents.
    """
    spark = docs.sparkSession
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    ddl = "row long, doc_id long, item_id long, cosine double, share double, answer_share double"
    b = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    out, last = spark.createDataFrame([], ddl), None
    while rows := (b if last is None else b.where((F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("text") > last[1])))).orderBy("item_id", "text").limit(BLOCK).collect():
        last = rows[-1]
        items = Items.of([(r["item_id"], r["text"]) for r in rows])
        if items.words:
            out = out.union(stash(_search(docs, items, ddl, cosine, mass, (verbatim, paraphrase, answer)), "leaks"))
    best = F.max_by(F.struct("cosine", "share", "answer_share"), F.struct("share", "cosine")).alias("b")
    return out.groupBy("row", "doc_id", "item_id").agg(best).select("row", "doc_id", "item_id", "b.*")


def _search(docs: DataFrame, items: Items, ddl: str, cosine: float, mass: float, limits: tuple[float, float, float]) -> DataFrame:
    least = min(limits[:2]) - 0.2  # of the distinct words; repeated words may make a subsequence longer
    words, df, n = occurrences(docs, items)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    basis = fit(words, n, items, idf)
    terms = Terms(items.vocabulary)
    at = np.concatenate(([0], np.cumsum([len(w) for w in items.words])))
    v, length = _latent(np.concatenate(items.words), at[:-1], at[1:], terms, basis)
    shared = docs.sparkSession.sparkContext.broadcast((items, basis, np.ascontiguousarray((v / length[:, None]).T), length))

    def run(batches):
        items, basis, vectors, length = shared.value
        terms, sets = Terms(items.vocabulary), [set(w.tolist()) for w in items.words]
        for batch in slices(batches, "text"):
            h, bounds = word_hashes(*text_buffer(batch.column("text")))
            row, starts, ends = _windows(bounds)
            ids, docs_ = batch.column("row"), batch.column("doc_id")
            found: list[tuple] = []
            for lo in range(0, len(starts), 4096):
                s, e = starts[lo:lo + 4096], ends[lo:lo + 4096]
                v, own = _latent(h, s, e, terms, basis)
                along = v @ vectors
                w, j = np.nonzero(along >= mass * length)
                near = along[w, j] >= cosine * own[w]
                for w, j in zip(w[near].tolist(), j[near].tolist()):
                    r, item = int(row[lo + w]), items.words[j]
                    a, z = max(int(s[w]) - len(item), int(bounds[r])), min(int(e[w]) + len(item), int(bounds[r + 1]))
                    if len(sets[j].intersection(h[a:z].tolist())) < least * len(sets[j]):
                        continue  # fewer words in common than any common subsequence needs
                    share, told, leak = judge(item, h[a:z], *limits)
                    if leak:
                        found.append((ids[r].as_py(), docs_[r].as_py(), items.ids[j], float(along[w, j] / own[w]), share, told))
            cols = list(zip(*found)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row", "doc_id", "item_id", "cosine", "share", "answer_share"])
    return docs.mapInArrow(run, ddl)
