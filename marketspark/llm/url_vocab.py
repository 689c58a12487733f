"""URL filters: a weighted vocabulary counted by an Aho-Corasick automaton, with allow and block rules above it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case. A url is rejected on one strict term or on ``soft_hits`` distinct soft ones."""

    strict: tuple[str, ...] = ("adult", "porn", "xxx", "escort", "hentai", "malware", "phishing", "spam", "warez")
    soft: tuple[str, ...] = ("ads", "bet", "bets", "bonus", "casino", "cheap", "click", "farm", "free", "jackpot", "loan", "loans", "pills", "poker", "sex", "slots", "track", "viagra", "win", "xx")
    soft_hits: int = 2


@dataclass(frozen=True)
class Rule:
    """``host/path`` that allows or blocks its host with all subdomains, for paths that start with its path."""

    verdict: str
    rule: str
    host: str = field(init=False)
    path: str = field(init=False)

    def __post_init__(self):
        host, slash, path = self.rule.partition("/")
        object.__setattr__(self, "host", host.lower())
        object.__setattr__(self, "path", slash + path)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first ``://`` and ``/ ? #`` or the end, A-Z lowered; path from there to ``? #``.

    Null and urls without ``://`` have both empty.
    """
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    rest = F.regexp_extract(rest, r"^[^?#]*", 0)
    raw = F.substring_index(rest, "/", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), rest.substr(F.length(raw) + 1, F.length(rest))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null where none does. Equal lengths: block wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.verdict == "block")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def count_terms(rows: DataFrame, vocabulary: Vocabulary, url: str = "url") -> DataFrame:
    """``rows`` with ``strict_terms`` and ``soft_terms``: the distinct terms of the whole url, in order.

    A term counts where no ASCII letter or digit stands on either side (A-Z counts as a-z).
    """
    cols = rows.columns

    def run(batches):
        a = ahocorasick.Automaton()
        for kind, terms in (("strict", vocabulary.strict), ("soft", vocabulary.soft)):
            for t in terms:
                a.add_word(t, (kind, t))
        a.make_automaton()
        inside = set("abcdefghijklmnopqrstuvwxyz0123456789")
        upper = {c: c + 32 for c in range(65, 91)}
        for batch in batches:
            found: dict[str, list] = {"strict": [], "soft": []}
            for u in batch.column(url).to_pylist():
                u = (u or "").translate(upper)
                hit: dict[str, set] = {"strict": set(), "soft": set()}
                for end, (kind, t) in a.iter(u):
                    before, after = end - len(t), end + 1
                    if (before < 0 or u[before] not in inside) and (after == len(u) or u[after] not in inside):
                        hit[kind].add(t)
                for kind, terms in hit.items():
                    found[kind].append(sorted(terms))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), *(pa.array(found[k], pa.list_(pa.string())) for k in ("strict", "soft"))], names=[*cols, "strict_terms", "soft_terms"])
    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), "strict_terms array<string>", "soft_terms array<string>"]))


def judge(pages: DataFrame, rules: list[Rule], vocabulary: Vocabulary | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_terms, soft_terms) for every row of ``pages``.

    The longest fitting rule decides; without one, the vocabulary. One pass without a shuffle: rules and vocabulary
    are parameters, not data. Null, empty and repeated urls are rows like any other; an empty table gives none.
    """
    v = vocabulary or Vocabulary()
    host, path = parts(F.col("url"))
    x = count_terms(pages.select("page_id", "url"), v)
    x = x.select("page_id", host.alias("host"), path.alias("path"), "strict_terms", "soft_terms")
    x = x.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    bad = (F.size("strict_terms") > 0) | (F.size("soft_terms") >= v.soft_hits)
    return x.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "strict_terms", "soft_terms")


def judge_sql(rules: list[Rule], vocabulary: Vocabulary | None = None, table: str = "pages") -> str:
    """The same in DuckDB's SQL, the vocabulary as one pattern for each term."""
    v = vocabulary or Vocabulary()
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def terms(ts):
        one = ", ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){re.escape(t)}($|[^a-z0-9])') THEN '{t}' END" for t in sorted(ts))
        return f"[x FOR x IN [{one}] IF x IS NOT NULL]"
    order = sorted(rules, key=lambda r: (len(r.rule), r.verdict == "block"), reverse=True)
    case = lambda what: "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in order) + " END"
    return f"""WITH a AS (SELECT page_id, {low} AS u, coalesce(url, '') AS url FROM {table}),
b AS (SELECT *, regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^?#]*') AS rest FROM a),
c AS (SELECT *, split_part(rest, '/', 1) AS raw FROM b),
d AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS path,
 {terms(v.strict)} AS strict_terms, {terms(v.soft)} AS soft_terms FROM c)
SELECT page_id, host, path, {case('rule')} AS rule, coalesce({case('verdict')},
 CASE WHEN len(strict_terms) > 0 OR len(soft_terms) >= {v.soft_hits} THEN 'block' ELSE 'allow' END) AS verdict, strict_terms, soft_terms FROM d"""
