"""Phrase collocations by SON partitioning: shards are mined completely at lowered support, then all are counted.

A shard's share of its language's text bytes lowers the support for it in proportion, and then by LOWER. A phrase that
a shard does not find has less than that there, so all shards together leave out less than support / LOWER of it: a
phrase with the support in the whole corpus is found with the rest of its count. The union of what the shards find keeps
the phrases of which that is so. The second reading counts this union everywhere, exactly. Inside a shard phrases grow
word by word from those that are still in (a phrase is never more frequent than its parts).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import chain, slices, spread_join, stash, text_buffer

#: text of a shard at most, about: larger shards keep the lowered support high, and a task holds about ten times this
SHARD = 48 << 20
#: shards at least
SHARDS = 16
#: the union of the shards' phrases is kept as 2**FLAGS flags of phrase hashes, a fixed size for any corpus; a false
#: hit only counts a phrase in vain
FLAGS = 26
#: a shard's support is its share of the support divided by this
LOWER = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


# ---- words -------------------------------------------------------------------------------
def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of a text column, and for each whether a piece begins with it."""
    buf, off = text_buffer(column)
    b = buf[int(off[0]):int(off[-1])]
    if not len(b):
        return pa.array([], pa.large_binary()), np.zeros(0, bool)
    kind = _CLASS[b]
    word, new = kind == 0, np.zeros(len(b) + 1, bool)
    new[off - off[0]] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | new[1:-1]
    last[:-1] &= ~word[1:] | new[1:-1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = np.searchsorted(np.flatnonzero((kind == 2) | new[:-1]), lo, "right")
    begins = np.ones(len(lo), bool)
    begins[1:] = piece[1:] != piece[:-1]
    ends = np.concatenate(([0], np.cumsum(hi - lo)))
    words = pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[b[word]])])
    return words, begins


class Shard:
    """Words of one language in one shard, as numbers into a dictionary."""

    def __init__(self):
        self.parts, self.begins, self.bytes, self.whole = [], [], 0, 0

    def add(self, texts: pa.Array, whole: int):
        words, begins = tokens(texts)
        self.parts.append(words.dictionary_encode())
        self.begins.append(begins)
        self.bytes += int(np.diff(text_buffer(texts)[1]).sum())
        self.whole = whole

    def close(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(word numbers, whether a piece begins, dictionary)."""
        one = pa.chunked_array(self.parts).unify_dictionaries().combine_chunks()
        one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
        begins = np.concatenate(self.begins)
        self.parts, self.begins = [], []
        return one.indices.to_numpy(), begins, one.dictionary


def shards(batches, limit: int):
    """(language, Shard) from rows (lang, whole, text): a task's rows, or as many as hold ``limit`` bytes of text."""
    held: dict[str, Shard] = {}
    size = 0
    for batch in slices(batches, "text", min(limit, 4 << 20)):
        order = pc.sort_indices(batch.column("lang"))
        lang = batch.column("lang").take(order)
        names, texts, whole = lang.to_pylist(), batch.column("text").take(order), batch.column("whole").take(order)
        cut = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cut, cut[1:]):
            held.setdefault(names[a], Shard()).add(texts.slice(a, b - a), whole[a].as_py())
        size += batch.column("text").nbytes
        if size >= limit:
            yield from _drained(held)
            size = 0
    yield from _drained(held)


def _drained(held: dict):
    while held:
        yield held.popitem()
        pa.default_memory_pool().release_unused()


def grown(ids: np.ndarray, begins: np.ndarray, seeds: np.ndarray, longest: int, keep, spelled: bool = True):
    """(words of each kept phrase, how often it occurs, its hash) for phrases of 1 to ``longest`` words.

    ``keep(hashes, counts)`` says which phrases stay in; longer ones are made only of those. Phrases are told apart by
    numbers (that of the phrase without its last word, and that word's), so nothing rests on hashes being distinct.
    Without ``spelled`` the words are left out.
    """
    counts = np.bincount(ids, minlength=len(seeds))
    kept = np.flatnonzero((counts > 0) & keep(seeds, counts))
    rank = np.full(len(seeds), -1, np.int32)
    rank[kept] = np.arange(len(kept))
    at = first = rank[ids]  # the kept phrase that starts at each word, and the word itself
    rows, hashes, wide = kept[:, None].astype(np.int32) if spelled else None, seeds[kept], max(len(kept), 1)
    words, own = kept.astype(np.int32), seeds[kept]
    yield rows, counts[kept], hashes
    for k in range(2, longest + 1):
        if len(at) < 2 or not len(hashes):
            return
        ok = (at[:-1] >= 0) & (at[1:] >= 0)
        if k == 2:
            ok &= ~begins[1:]
        place = np.flatnonzero(ok)
        key = at[place] * np.int64(wide) + first[place + (k - 1)]
        run = np.sort(key)
        cut = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)])) if len(run) else np.zeros(1, np.int64)
        found, counts = run[cut[:-1]], np.diff(cut)
        del run, cut, ok
        h = chain([hashes[found // wide], own[found % wide]]) if len(found) else hashes[:0]
        stay = np.flatnonzero(keep(h, counts)) if len(found) else np.zeros(0, np.int64)
        found, counts, hashes = found[stay], counts[stay], h[stay]
        if spelled:
            rows = np.concatenate((rows[found // wide], words[found % wide][:, None]), axis=1)
        yield rows, counts, hashes
        at = np.full(len(at) - 1, -1, np.int32)
        for a in range(0, len(key), 1 << 20) if len(found) else ():
            part = key[a:a + (1 << 20)]
            i = np.minimum(np.searchsorted(found, part), len(found) - 1)
            hit = found[i] == part
            at[place[a:a + (1 << 20)][hit]] = i[hit]


def _seeds(dictionary: pa.Array, lang: str) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    seed = xxh3_64_intdigest(lang.encode())
    return np.array([xxh3_64_intdigest(w, seed) for w in dictionary.to_pylist()], np.uint64)


# ---- the two readings --------------------------------------------------------------------
def _locally_frequent(support: int, longest: int, limit: int):
    """(h, v): the phrases with the lowered support, by hash, and by how much they are above what others may have."""
    def run(batches):
        for lang, shard in shards(batches, limit):
            ids, begins, dictionary = shard.close()
            least = -(-support * shard.bytes // (LOWER * shard.whole))  # in whole numbers of any size
            for _, n, h in grown(ids, begins, _seeds(dictionary, lang), longest, lambda _, n, least=least: n >= least, False):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((n - (least - 1)).astype(np.int64))], names=["h", "v"])
    return run


def _counted(flags, longest: int, limit: int):
    names = ["lang", "k", "phrase", "n"]

    def run(batches):
        table = flags.value

        def keep(h, _):
            return ((table[((h & np.uint64((1 << FLAGS) - 1)) >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
        for lang, shard in shards(batches, limit):
            ids, begins, dictionary = shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([len(ids)], pa.int64())], names=names)
            for rows, counts, _ in grown(ids, begins, _seeds(dictionary, lang), longest, keep):
                for a in range(0, len(rows), 1 << 16):
                    part = rows[a:a + (1 << 16)]
                    text = pc.binary_join_element_wise(*(dictionary.take(pa.array(c)) for c in part.T), pa.scalar(b" ", pa.large_binary())).cast(pa.string())
                    k = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array(np.full(k, part.shape[1], np.int32)), text, pa.array(counts[a:a + (1 << 16)].astype(np.int64))], names=names)
    return run


def mine(docs: DataFrame, support: int, longest: int = 5, shard: int = SHARD) -> DataFrame:
    """(lang, k, phrase, n): every phrase of 1 to ``longest`` words with ``support`` occurrences or more in ``docs``
    (lang, text), and for each language a row with k = 0: how many words it has. Exact.

    A shard is a task's rows. Input partitions are joined, without a shuffle, to SHARDS shards, or as many more as keep
    them at ``shard`` bytes; much larger ones are cut. A language's text is weighed in bytes, of which its whole total
    travels as a column. Where there are more shards than ``support / LOWER``, a shard reports all its phrases, by hash
    and count; the work stays in proportion to the text, and the second reading still counts the frequent ones only.
    """
    spark = docs.sparkSession
    d = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    totals = stash(d.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("whole")), "languages")
    size = totals.agg(F.sum("whole")).first()[0] or 0
    x = d.join(totals.where(F.col("whole") >= support), "lang").select("lang", "whole", "text").coalesce(max(math.ceil(size / shard), SHARDS))
    found = x.mapInArrow(_locally_frequent(support, longest, shard + shard // 2), "h long, v long")
    union = found.groupBy("h").agg(F.sum("v").alias("v")).where(F.col("v") > support - support / LOWER).select(F.col("h").bitwiseAND(F.lit((1 << FLAGS) - 1)).alias("slot"))
    flag = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    bits = union.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(flag).alias("bits")).toArrow()  # at most 2**FLAGS / 64 rows
    table = np.zeros(1 << (FLAGS - 6), np.uint64)
    table[bits.column("w").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    rows = x.mapInArrow(_counted(spark.sparkContext.broadcast(table), longest, shard + shard // 2), "lang string, k int, phrase string, n long")
    return stash(rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= support) | (F.col("k") == 0)), "phrases")


# ---- scores ------------------------------------------------------------------------------
def _exact(a: Column) -> Column:
    return a.cast("decimal(18,0)")


def weakest_cuts(phrases: DataFrame, longest: int = 5) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of the phrases of two words and more: the cut with the lowest
    floor(1000 * a * n / (l * r)), ties to the shorter first part. Products are decimals of up to 37 digits."""
    words = F.split("phrase", " ")
    cut = phrases.where("k >= 2").select("lang", "phrase", F.col("k").alias("long"), F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("part")),
                    F.struct(F.lit("r").alias("side"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("long") - F.col("cut")), " ").alias("part")))
    asked = stash(cut.select("lang", "phrase", "long", "a", "cut", F.explode(sides).alias("s")).select("lang", "phrase", "long", "a", "cut", "s.*"), "cuts")
    told = spread_join(asked, phrases.where("k >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    pick = lambda side, c: F.max(F.when((F.col("side") == side) & (F.col("cut") == c), F.col("f"))).alias(f"{side}{c}")
    x = told.groupBy("lang", "phrase", "long", "a").agg(*(pick(s, c) for s in "lr" for c in range(1, longest)))
    x = x.join(phrases.where("k = 0").select("lang", F.col("n").alias("words")), "lang")
    x = x.withColumn("_an", _exact(F.col("a") * 1000) * _exact(F.col("words")))
    one = [F.when(F.col(f"l{c}").isNotNull(), F.struct(F.call_function("div", F.col("_an"), _exact(F.col(f"l{c}")) * _exact(F.col(f"r{c}"))).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in range(1, longest)]
    x = x.withColumn("best", F.array_min(F.array(*one)))
    return x.select("lang", "phrase", F.col("long").alias("k"), "a", "best.l", "best.r", F.col("words").alias("n"), "best.score")


def inside(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of the phrases whose words lie together in a longer one that has ``percent`` of their count."""
    c = phrases.where("k >= 2").select("lang", "phrase", F.col("n").alias("a"), "k")
    subs = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = c.where("k >= 3").select("lang", F.explode(subs).alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("a").alias("longer"))
    both = c.select("lang", "phrase", "a", F.lit(None).cast("long").alias("longer")).union(longer)
    return both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer")).where(F.col("longer") * 100 >= F.col("a") * percent).select("lang", "phrase")


def first_of_each(rows: DataFrame, by: str, value: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each ``by`` in an order that begins with ``value`` descending, with their rank.

    Counts by steps of the value's logarithm tell from which step on the first rows come, so that a group's window
    holds little more than them.
    """
    x = rows.withColumn("_step", F.floor(F.log2(F.col(value) + 1) * 16))
    up = Window.partitionBy(by).orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = x.groupBy(by, "_step").agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(up), F.lit(0)))
    least = steps.where(F.col("_above") < limit).groupBy(by).agg(F.min("_step").alias("_least"))
    w = Window.partitionBy(by).orderBy(*order)
    x = x.join(least, by).where("_step >= _least").withColumn("rank", F.row_number().over(w).cast("long"))
    return x.where(F.col("rank") <= limit).drop("_step", "_least")


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, percent: int = 100, limit: int = 2000, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``limit`` best phrases of 2 to ``longest`` words in ``docs`` (lang, text).

    A-Z are lower-cased, texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words.
    ``n`` counts a language's words, ``a`` the phrase, ``l`` and ``r`` the parts of its weakest cut (:func:`weakest_cuts`).
    Phrases inside a longer frequent one with ``percent`` of their count are left out (:func:`inside`).

    Null text is empty, a null language is ``und``; repeated rows count as often as they come; an empty table gives no
    rows; other columns are not read. Texts of any length are counted whole.
    """
    phrases = mine(docs, support, longest, shard)
    scored = stash(weakest_cuts(phrases, longest).join(inside(phrases, percent), ["lang", "phrase"], "left_anti"), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    return first_of_each(scored, "lang", "score", order, limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(support: int = 100, longest: int = 5, percent: int = 100, limit: int = 2000) -> str:
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS w FROM p, (SELECT unnest(range(1, {longest + 1})) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, w, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND f >= {support}),
cuts AS (SELECT lang, w, k, f AS a, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT cuts.lang, cuts.w, cuts.k, a, cut, x.f AS l, y.f AS r, n, 1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS score FROM cuts JOIN n USING (lang)
 JOIN f x ON x.lang = cuts.lang AND x.w = cuts.w[:cut] JOIN f y ON y.lang = cuts.lang AND y.w = cuts.w[cut + 1:]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) AS pick FROM s),
subs AS (SELECT lang, f AS longer, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: w[i:i + m - 1])))) AS w FROM c WHERE k >= 3),
long AS (SELECT lang, w, max(longer) AS longer FROM subs GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.w, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN long USING (lang, w) WHERE pick = 1 AND NOT coalesce(100 * longer >= {percent} * a, false))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o) WHERE rank <= {limit}"""
