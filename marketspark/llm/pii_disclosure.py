"""Personal data: patterns, and terms that co-occurrence in the corpus shows to reveal a protected entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import bounded, stash

# ---- fixed values: the kinds, in their order, as patterns whose matches are the leftmost ones, found in linear time --
#: email: a local part starts where none runs on, or right after a match; the domain is the longest run of labels
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-]))"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: card: runs of digits with single separators; only those of 14 to 19 digits can pass, so others need no match
CARD = r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = (("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, None), ("phone", PHONE, "+"))


#: white space, a character at a time, so that places in a text are sums of lengths plus one
WHITE = r"[\x20\x09-\x0D]"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _octet(part: Column) -> Column:
    p = F.ltrim(part, F.lit("0"))
    return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)
    chars = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(chars, F.lit(0), lambda a, v: a + v) % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), _octet)
    if kind == "card":
        return luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _found(text: Column) -> dict[str, Column]:
    """Per kind the matches of its pattern, as an array of strings; texts that lack a needed character are not searched."""
    return {kind: F.when(F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9 -]{14}"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) for kind, pattern, needs in KINDS}


def _first(words: Column, n: int) -> Column:
    return F.slice(words, F.lit(1), F.lit(n))


def _last(words: Column, n: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - (n - 1), F.lit(1)), F.lit(n))


def base_spans(docs: DataFrame, window: int = 4) -> DataFrame:
    """(row, kind, rank, start, end, value, before, after) of the pattern matches in ``docs`` (row, text).

    Splitting a text at a pattern gives what stands between its matches, so places are running sums of lengths: of
    rows, not of arrays, hence linear in a text's matches. ``before`` and ``after`` are the ``window`` words on either
    side, however long they are, as far as the neighbouring match of the same kind: what stands beyond that is told
    of the neighbour. A match that fails its test is left out after its length has counted.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("row", text.alias("text"))
    d = d.select("*", *(c.alias(f"_{k}") for k, c in _found(F.col("text")).items()))
    parts = []
    for rank, (kind, pattern, _) in enumerate(KINDS):
        between = F.split(F.col("text"), pattern)
        words = F.transform(between, lambda g: F.struct(F.length(g).alias("gap"), F.filter(F.split(g, WHITE), lambda w: w != "").alias("w")))
        side = F.transform(words, lambda g: F.struct(g["gap"].alias("gap"), _last(g["w"], window).alias("tail"), _first(g["w"], window).alias("head")))
        rows = F.zip_with(F.slice(side, F.lit(1), F.size(f"_{kind}")), F.zip_with(f"_{kind}", F.slice(side, F.lit(2), F.size(f"_{kind}")), lambda v, s: F.struct(v.alias("v"), s["head"].alias("head"))), lambda g, v: F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), g["gap"].alias("gap"), v["v"].alias("value"), g["tail"].alias("before"), v["head"].alias("after")))
        parts.append(F.when(F.size(f"_{kind}") > 0, rows).otherwise(F.array().cast("array<struct<kind:string,rank:int,gap:int,value:string,before:array<string>,after:array<string>>>")))
    x = d.where(F.greatest(*(F.size(f"_{k}") for k, _, _ in KINDS)) > 0).select("row", F.posexplode(F.concat(*parts)).alias("i", "m")).select("row", "i", "m.*")
    end = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row", "kind").orderBy("i"))
    x = x.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    ok = F.lit(False)
    for kind, _, _ in KINDS:
        ok = F.when(F.col("kind") == kind, _passes(kind, F.col("value"))).otherwise(ok)
    return x.where(ok).select("row", "kind", "rank", "start", "end", "value", "before", "after")


# ---- terms -------------------------------------------------------------------------------
PUNCT = ".,;:!?\"'()[]{}<>*-_"


def _term(piece: Column) -> Column:
    """A word in lower case without the punctuation around it."""
    return F.lower(F.btrim(piece, F.lit(PUNCT)))


def _is_term(t: Column) -> Column:
    return F.length(t) > 1


def disclosing_terms(docs: DataFrame, spans: DataFrame, window: int = 4, support: int = 3, bits: float = 4.0, remove: float = 0.25, generalise: float = 1.0, small: int = 100_000) -> DataFrame:
    """(term, entity, disclosed_bits, left_bits, action): terms that reveal a protected entity.

    An entity is the value of a base span. A term co-occurs with it when it is among the ``window`` words before or
    after. Over the whole corpus, with n(t, e) co-occurrences, n(t) occurrences of the term, n(e) of the entity and
    N words (pieces between white space): ``disclosed_bits`` = log2(P(e|t) / P(e)) is what the term tells of the entity, ``left_bits`` = -log2 P(e|t)
    what stays unknown. A term with ``support`` co-occurrences, at least ``bits`` disclosed and at most ``generalise``
    left is generalised, and removed when at most ``remove`` is left. Of several entities the one with least left counts.

    Names with digits or an @ are terms like others; places inside a base span are left out by :func:`find`.
    Counts cover all documents. Pairs fold before they shuffle; words of the corpus meet the candidate terms by a
    broadcast when there are at most ``small``, else by a shuffle of folded counts.
    """
    s = spans.select(F.lower("value").alias("entity"), "before", "after")
    pairs = s.select("entity", F.explode(F.array_distinct(F.transform(F.concat(_last(F.col("before"), window), _first(F.col("after"), window)), _term))).alias("term")).where(_is_term(F.col("term")))
    pairs = stash(pairs.groupBy("term", "entity").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support), "pairs")
    n_e = s.groupBy("entity").agg(F.count("*").alias("n_e"))
    cand = bounded(pairs.select("term").distinct(), small)
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), WHITE)).alias("w")).where("w <> ''")
    n_t = words.select(_term(F.col("w")).alias("term")).join(cand, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), WHITE))).alias("n")).first()["n"] or 0
    x = pairs.join(n_t, "term").join(n_e, "entity")
    p = F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))
    x = x.select("term", "entity", (F.log2(p) - F.log2(F.col("n_e") / F.lit(max(float(total), 1.0)))).alias("disclosed_bits"), (-F.log2(p)).alias("left_bits"))
    x = x.where((F.col("disclosed_bits") >= bits) & (F.col("left_bits") <= generalise))
    best = x.groupBy("term").agg(F.min(F.struct("left_bits", "entity", "disclosed_bits")).alias("b"))
    return best.select("term", "b.entity", "b.disclosed_bits", "b.left_bits", F.when(F.col("b.left_bits") <= remove, "remove").otherwise("generalise").alias("action"))


def term_spans(docs: DataFrame, terms: DataFrame, small: int = 100_000) -> DataFrame:
    """(row, start, end, value, action) of every place of a disclosing term in ``docs`` (row, text)."""
    t = bounded(terms.select("term", "action"), small)
    text = F.coalesce("text", F.lit(""))
    has = docs.select("row", F.explode(F.split(text, WHITE)).alias("w")).where("w <> ''").select("row", _term(F.col("w")).alias("term")).join(t.select("term"), "term", "left_semi").select("row").distinct()
    pieces = docs.select("row", text.alias("text")).join(bounded(stash(has, "rows-with-terms"), small), "row", "left_semi")
    pieces = pieces.select("row", F.posexplode(F.split("text", WHITE)).alias("i", "w"))
    at = F.coalesce(F.sum(F.length("w") + 1).over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("row", at.alias("at"), "w").withColumn("term", _term(F.col("w"))).join(t, "term")
    start = F.col("at") + F.length("w") - F.length(F.ltrim("w", F.lit(PUNCT)))
    value = F.btrim("w", F.lit(PUNCT))
    return pieces.select("row", start.cast("long").alias("start"), (start + F.length(value)).cast("long").alias("end"), value.alias("value"), "action")


def find(docs: DataFrame, window: int = 4, **thresholds) -> DataFrame:
    """(row, doc_id, base, spans) for every row of ``docs`` (row, doc_id, text), arrays sorted by start, then kind.

    ``base`` holds the pattern matches, ``spans`` these and the terms that reveal one of them (kind ``term``); a term
    that overlaps a pattern match is left out. ``row`` is any distinct number of a row, the same at every reading.
    Null text is empty and has no spans; repeated rows each have theirs; an empty table gives no rows.
    """
    base = stash(base_spans(docs, window), "base-spans")
    terms = stash(disclosing_terms(docs, base, window, **thresholds), "terms")
    rows = base.select("row", "start", "end", "rank", "kind", F.lit("remove").alias("action"))
    more = term_spans(docs, terms).select("row", "start", "end", F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), "action")
    g = rows.union(more).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "action"))).alias("all"))
    g = g.select("row", F.filter("all", lambda s: s["kind"] != "term").alias("base"), "all")
    clear = F.filter("all", lambda s: (s["kind"] != "term") | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    g = g.select("row", "base", F.when(F.size("base") < F.size("all"), clear).otherwise(F.col("all")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,action:string>>")
    return docs.select("row", "doc_id").join(g, "row", "left").select("row", "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Per row of :func:`find`: counts by kind, the digest of the base spans, and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k, _, _ in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(row, doc_id, text): texts with base spans and removed terms as ``<KIND>``, generalised terms as their first letter and ``*``.

    Of overlapping spans the one that starts first covers the others.
    """
    x = docs.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text")).join(found.select("row", "spans"), "row")
    s = x.select("row", F.posexplode("spans").alias("i", "s")).select("row", "i", "s.*")
    reached = F.max("end").over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("done", F.coalesce(reached, F.lit(0))).where("start >= done")
    g = s.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "start", "end", "done", "kind", "action"))).alias("cuts"))
    x = x.select("row", "doc_id", "text").join(g, "row", "left")
    word = F.expr("array_join(transform(cuts, s -> concat(substr(text, s.done + 1, s.start - s.done), CASE WHEN s.action = 'generalise' THEN concat(substr(text, s.start + 1, 1), '*') ELSE concat('<', upper(s.kind), '>') END)), '')")
    rest = F.expr("substr(text, element_at(cuts, -1).end + 1)")
    return x.select("row", "doc_id", F.when(F.size("cuts") > 0, F.concat(word, rest)).otherwise(F.col("text")).alias("text"))
