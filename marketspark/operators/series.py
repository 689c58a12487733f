"""Blocked windows: ordered per-series computation that does not need one task per series.

A plain ``Window.partitionBy(symbol, timeframe)`` puts a whole series into one task, so one
symbol that holds a third of all rows holds up the job. Here every series is cut into blocks of
``block`` consecutive rows. A block also receives the ``back`` rows before it and the ``fwd``
rows after it (its halo), windows run inside ``(series, block)``, and only the block's own rows
are returned. For frames that fit the halo the result equals the unblocked window.

Row positions come from a count per (series, time bucket), which is tiny next to the rows:
its running sum gives each bucket its position and the blocks that need it. So the rows
themselves are shuffled and sorted by (series, block) once, and every later window, exponential
average included, reuses that order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketspark.operators.decay import MOST, decayed, step_decay
from marketspark.operators.order_stats import Stat, with_stats
from marketspark.schema import KEYS, ORDER
from marketspark.session import materialize

#: rows a block owns; with 10 double columns about 6 MB, so a task holds many blocks
BLOCK_ROWS = 65536
#: sub-block sizes for exponential averages, finest last; each divides the one before
LEVELS = (8192, 2048, 512, 128)
_NAME = re.compile(r"\w+")
#: exp(-40) is below the relative precision of a double
DECAY = 40.0


def ema_halo(*alphas: float) -> int:
    """Rows after which the influence of older rows on chained averages is below 1 ulp."""
    return sum(math.ceil(DECAY / -math.log1p(-a)) for a in alphas)


def span(n: float) -> float:
    """Smoothing factor of an n-period exponential average."""
    return 2.0 / (n + 1.0)


def wilder_alpha(n: float) -> float:
    """Smoothing factor of Wilder's average."""
    return 1.0 / n


class Series:
    """Rows of many ordered series, cut into blocks. Build with :func:`blocked`."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], block: int, back: int, fwd: int):
        self._df, self.keys, self.order = df, tuple(keys), tuple(order)
        self.block, self.back, self.fwd = block, back, fwd
        self._pending: dict[int, dict[str, Column | Stat]] = {}
        self._level: dict[str, int] = {}
        self._names = set(df.columns)
        self._part = [*self.keys, "_blk"]
        self._sort = [*(f"_c{n}" for n in LEVELS), "_i"]
        self.part = Window.partitionBy(*self._part)
        #: all rows of the block and halo up to the current one
        self.upto = self.part.orderBy(*self._sort)

    # ---- frames -----------------------------------------------------------------------
    def w(self, n: int, end: int = 0) -> WindowSpec:
        """The ``n`` rows ending ``-end`` rows before the current one."""
        return self.upto.rowsBetween(end - n + 1, end)

    def ahead(self, first: int, last: int) -> WindowSpec:
        """Rows ``first..last`` after the current one."""
        return self.upto.rowsBetween(first, last)

    def over(self, first: int | None = None, last: int = 0) -> str:
        """The window clause as SQL text: rows ``first..last`` around the current one, or just the order.

        A column built from text costs one call to the JVM, from functions a dozen; wide feature sets notice.
        """
        spec = f"PARTITION BY {', '.join(f'`{c}`' for c in self._part)} ORDER BY {', '.join(self._sort)}"
        if first is None:
            return f"OVER ({spec})"
        at = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
        return f"OVER ({spec} ROWS BETWEEN {at(first)} AND {at(last)})"

    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.expr(f"lag(`{c}`, {k}) {self.over()}") if isinstance(c, str) else F.lag(c, k).over(self.upto)

    def lead(self, c: Column | str, k: int = 1) -> Column:
        return F.expr(f"lead(`{c}`, {k}) {self.over()}") if isinstance(c, str) else F.lead(c, k).over(self.upto)

    # ---- steps ------------------------------------------------------------------------
    def add(self, **cols: Column) -> Series:
        """Add columns that may use columns added before.

        Columns are gathered and written level by level of dependency, not call by call, so a long
        chain of small steps becomes a few projections and as few window operators.
        """
        s = self if self._names.isdisjoint(cols) else self._without_helpers(cols)
        s = s._with(s._df, {k: dict(v) for k, v in s._pending.items()}, dict(s._level))
        for name, c in cols.items():
            used = [s._level[w] for w in set(_NAME.findall(str(c))) if w in s._level]
            s._level[name] = 1 + max(used, default=0)
            s._pending.setdefault(s._level[name], {})[name] = c
        s._names = s._names | cols.keys()
        return s

    def _without_helpers(self, cols) -> Series:
        """The series about to have columns replaced: what was known of their old values goes."""
        ends = tuple(f"__{c}" for c in cols)
        return self._with(self.df.drop(*(f"_q_{c}" for c in cols), *(n for n in self._names if n.startswith(("_o_", "_f")) and n.endswith(ends))))

    def ensure(self, **sql: str) -> None:
        """Add helper columns, given as SQL text, to this very series unless it has them."""
        new = {n: F.expr(t) for n, t in sql.items() if n not in self._names}
        for name, c in new.items():
            used = [self._level[w] for w in set(_NAME.findall(sql[name])) if w in self._level]
            self._level[name] = 1 + max(used, default=0)
            self._pending.setdefault(self._level[name], {})[name] = c
        self._names = self._names | new.keys()

    def order_stat(self, stat: Stat) -> Column:
        """A quantile or rank of a moving frame. The column is added to this very series; all that are asked for before
        one of them is read are found in one pass."""
        name = f"_o_{stat.kind}_{stat.n}_{stat.need}_{str(stat.q).replace('.', '_')}__{stat.column}"
        if name not in self._names:
            self._level[name] = 1 + self._level.get(stat.column, 0)
            self._pending.setdefault(self._level[name], {})[name] = stat
            self._names = self._names | {name}
        return F.col(name)

    @property
    def df(self) -> DataFrame:
        """The rows with every column added so far."""
        asked: dict[str, Stat] = {}

        def told():
            if asked:
                self._df = with_stats(self._df, self._part, self._sort, asked)
                asked.clear()
        for k in sorted(self._pending):
            plain = {n: c for n, c in self._pending[k].items() if not isinstance(c, Stat)}
            stats = {n: c for n, c in self._pending[k].items() if isinstance(c, Stat)}
            if asked and (any(asked.keys() & set(_NAME.findall(str(c))) for c in plain.values()) or any(s.column in asked for s in stats.values())):
                told()
            self._df = self._df.withColumns(plain) if plain else self._df
            asked |= stats
        told()
        self._pending, self._level = {}, {}
        return self._df

    def has(self, name: str) -> bool:
        return name in self._names

    @property
    def columns(self) -> set[str]:
        return self._names

    def _with(self, df: DataFrame, pending: dict | None = None, level: dict | None = None) -> Series:
        s = object.__new__(Series)
        s.__dict__.update(self.__dict__)
        s._df, s._pending, s._level = df, pending or {}, level or {}
        s._names = self._names if df is self._df else set(df.columns)
        return s

    def where(self, cond: Column) -> Series:
        """Keep rows; windows added later no longer see the others."""
        return self._with(self.df.where(cond))

    def emas(self, adjust: bool = False, dense: bool = False, **specs: tuple[str, float] | tuple[str, float, int]) -> Series:
        """Exponential averages ``name=(column, alpha)``, from the first value of the column on, for any alpha in (0, 1].

        A null row keeps the average and ages it: after ``g`` nulls the old average weighs ``p = (1-a)^(g+1)``
        against ``a`` of the new value. Adjusted averages divide by the weights of the rows with values.

        Every block is first averaged as if the series began in it; its whole effect on later rows is then one affine
        map. The maps of all earlier blocks are composed and the result is put in at the block's first value
        (:meth:`_carried_emas`), so no row is out of reach, however sparse the column. ``dense`` promises a column
        without nulls after its first value. What is older than the halo then no longer counts, and where the halo is
        long enough for that the maps are spared.
        """
        near: dict[str, tuple[str, float]] = {}
        far: dict[str, tuple[str, float]] = {}
        for name, spec in specs.items():
            rate = -math.log1p(-spec[1]) if spec[1] < 1 else MOST
            enough = self.back >= DECAY / rate and LEVELS[0] * rate >= DECAY * 0.9 and LEVELS[-1] * rate <= 600
            (near if dense and enough else far)[name] = spec[:2]
        s = self._dense_emas(adjust, near) if near else self
        return s._carried_emas(adjust, far) if far else s

    def _dense_emas(self, adjust: bool, specs: dict[str, tuple[str, float]]) -> Series:
        """``y_t = (1-a) y_{t-1} + a x_t`` as a running sum of ``x_k (1-a)^-k`` scaled back. The sum runs inside a sub-block
        short enough not to overflow and so long that only the one before still counts; its last value is carried over."""
        first: dict[str, Column] = {}
        sums: dict[str, Column] = {}
        carry: dict[str, Column] = {}
        out: dict[str, Column] = {}
        spec = f"PARTITION BY {', '.join(f'`{c}`' for c in self._part)} ORDER BY {', '.join(self._sort)} ROWS BETWEEN UNBOUNDED PRECEDING AND"
        for name, (x, a) in specs.items():
            rate = -math.log1p(-a)
            size = next((n for n in reversed(LEVELS) if n * rate >= DECAY), LEVELS[0])
            cut = ", ".join(f"_c{n}" for n in LEVELS if n >= size)
            rest = ", ".join([f"_c{n}" for n in LEVELS if n < size] + ["_i"])
            inner = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in self._part)}, {cut} ORDER BY {rest} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            t, p, q, lam, off = f"_s_{name}", f"_p_{name}", f"_q_{x}", f"{rate!r}D", f"(_i % {size})"
            if not self.has(q):
                first[q] = F.expr(f"min(CASE WHEN `{x}` IS NOT NULL THEN _i END) OVER ({spec} CURRENT ROW)")
            gain = "" if adjust else f"* CASE WHEN _i = `{q}` THEN 1D ELSE {a!r}D END"
            sums[t] = F.expr(f"exp(-{lam} * {off}) * sum(`{x}` {gain} * exp({lam} * {off})) {inner}")
            carry[p] = F.expr(f"last(CASE WHEN _i % {size} = {size - 1} THEN `{t}` END, true) OVER ({spec} 1 PRECEDING)")
            y = f"`{t}` + coalesce(`{p}`, 0D) * exp(-{lam} * ({off} + 1))"
            if adjust:
                y = f"({y}) / ((1D - exp(-{lam} * (_i - `{q}` + 1))) / {a!r}D)"
            out[name] = F.expr(f"CASE WHEN `{x}` IS NOT NULL THEN {y} END")
        s = self.add(**first) if first else self
        return s.add(**sums).add(**carry).add(**out)

    def _carried_emas(self, adjust: bool, specs: dict[str, tuple[str, float]]) -> Series:
        """Averages of any decay and density; see :meth:`emas`."""
        df = self.df
        prev = self.upto.rowsBetween(Window.unboundedPreceding, -1)
        at = {x: F.when(F.col(x).isNotNull(), F.col("_i")) for x, _ in specs.values()}
        rate = {name: -math.log1p(-a) if a < 1 else MOST for name, (_, a) in specs.items()}
        sums = ("num", "den") if adjust else ("num",)
        scans = {n: (f"_d_{n}", {f"_{k}_{n}": f"_b_{k}_{n}" for k in sums}) for n in specs}
        df = df.withColumns({f"_y_{x}": F.max(i).over(prev) for x, i in at.items()})  # the row of the value before
        df = df.withColumns({f"_d_{n}": F.when(F.col(x).isNotNull() & F.col(f"_y_{x}").isNotNull(), step_decay(F.col("_i") - F.col(f"_y_{x}"), a, rate[n], adjust)).otherwise(0.0) for n, (x, a) in specs.items()})
        gain = {n: F.lit(1.0) if adjust else F.when(F.col(f"_y_{x}").isNotNull(), -F.expm1(-F.col(f"_d_{n}"))).otherwise(1.0) for n, (x, _) in specs.items()}
        df = df.withColumns({f"_b_{k}_{n}": F.when(F.col(x).isNotNull(), (F.col(x) if k == "num" else F.lit(1.0)) * gain[n]) for n, (x, _) in specs.items() for k in sums})
        df = decayed(df, self._part, self._sort, scans)
        # a block's map: up to where the next block's rows, halo included, begin
        mine = F.col("_i") < (F.col("_blk") + 1) * self.block - self.back
        fold = {}
        for x, i in at.items():
            fold |= {f"_first_{x}": F.min(i), f"_from_{x}": F.min_by(F.col(x).cast("double"), i), f"_last_{x}": F.max(F.when(mine, i))}
        for n in specs:
            fold |= {f"_E_{n}": F.max(F.when(mine, F.col(f"_D_{n}")))} | {f"_e_{k}_{n}": F.max_by(f"_{k}_{n}", F.when(mine, F.col("_i"))) for k in sums}
        maps = df.groupBy(*self._part).agg(*(c.alias(n) for n, c in fold.items()))
        before = Window.partitionBy(*self.keys).orderBy("_blk")
        maps = maps.withColumns({f"_y_{x}": F.max(f"_last_{x}").over(before.rowsBetween(Window.unboundedPreceding, -1)) for x in at})
        late = {n: F.col(f"_last_{x}").isNotNull() for n, (x, _) in specs.items()}
        met = {n: F.col(f"_y_{x}").isNotNull() for n, (x, _) in specs.items()}
        maps = maps.withColumns({f"_j_{n}": F.when(met[n], step_decay(F.col(f"_first_{x}") - F.col(f"_y_{x}"), a, rate[n], adjust)) for n, (x, a) in specs.items()})
        maps = maps.withColumns({f"_d_{n}": F.when(late[n] & met[n], F.col(f"_E_{n}") + F.col(f"_j_{n}")).otherwise(0.0) for n in specs})
        # what the block's first value would have been without the average that comes in
        lost = {n: F.lit(0.0) if adjust else F.when(met[n], F.exp(-F.col(f"_d_{n}")) * F.col(f"_from_{x}")).otherwise(0.0) for n, (x, _) in specs.items()}
        maps = maps.withColumns({f"_b_{k}_{n}": F.when(late[n], F.col(f"_e_{k}_{n}") - (lost[n] if k == "num" else 0.0)) for n in specs for k in sums})
        maps = decayed(maps, self.keys, ["_blk"], {n: (f"_d_{n}", {f"_z_{k}_{n}": f"_b_{k}_{n}" for k in sums}) for n in specs})
        maps = maps.withColumns({f"_c_{k}_{n}": F.when(met[n], F.lag(f"_z_{k}_{n}").over(before)) for n in specs for k in sums})
        link = {f"_in_{k}_{n}": F.exp(-F.col(f"_j_{n}")) * (F.col(f"_c_{k}_{n}") - (F.lit(0.0) if adjust else F.col(f"_from_{x}"))) for n, (x, _) in specs.items() for k in sums}
        maps = maps.withColumns(link).select(*self._part, *link, *(f"_c_{k}_{n}" for n in specs for k in sums))
        df = df.join(maps, self._part, "left")
        out = {}
        for n, (x, _) in specs.items():
            started = F.col(x).isNotNull() | F.col(f"_y_{x}").isNotNull()
            total = {k: F.when(started, F.col(f"_{k}_{n}") + F.exp(-F.col(f"_D_{n}")) * F.coalesce(f"_in_{k}_{n}", F.lit(0.0))).otherwise(F.col(f"_c_{k}_{n}")) for k in sums}
            out[n] = F.try_divide(total["num"], total["den"]) if adjust else total["num"]
        df = df.withColumns(out)
        extra = [c for n in specs for c in (f"_d_{n}", f"_D_{n}", *(f"_{p}{k}_{n}" for k in sums for p in ("", "b_", "in_", "c_")))]
        return self._with(df.drop(*extra, *(f"_y_{x}" for x in at)))

    def affine(self, name: str, keep: Column, add: Column, first: int, warm: int = 0) -> Series:
        """Recursion ``y_t = keep_t y_{t-1} + add_t`` from row ``first`` of the series on, with ``keep_t`` in [0, 1].

        Every block is an affine map; those of all earlier blocks are composed for the value carried in. Where
        ``keep`` or ``add`` look back themselves, the first ``warm`` rows of a block's halo are left out.
        """
        if warm > self.back:
            raise ValueError(f"{name}: a halo of {self.back} rows is shorter than {warm}")
        begin = lambda blk: blk * self.block - self.back + warm
        live = (F.col("_i") >= first) & ((F.col("_blk") == 0) | (F.col("_i") >= begin(F.col("_blk"))))
        df = self.df.withColumns({"_k": F.when(live, F.when(keep > 0, -F.ln(keep)).otherwise(MOST)).otherwise(0.0), "_b": F.when(live, add)})
        df = decayed(df, self._part, self._sort, {"affine": ("_k", {"_y": "_b"})})
        mine = F.when(F.col("_i") < begin(F.col("_blk") + 1), F.col("_i"))
        maps = df.groupBy(*self._part).agg(F.max_by("_D_affine", mine).alias("_k"), F.max_by("_y", mine).alias("_b"))
        maps = decayed(maps, self.keys, ["_blk"], {"maps": ("_k", {"_y": "_b"})})
        maps = maps.select(*self._part, F.lag("_y").over(Window.partitionBy(*self.keys).orderBy("_blk")).alias("_in"))
        df = df.join(maps, self._part, "left")
        df = df.withColumn(name, F.when(live, F.col("_y") + F.coalesce("_in", F.lit(0.0)) * F.exp(-F.col("_D_affine"))))
        return self._with(df.drop("_k", "_b", "_y", "_D_affine", "_in"))

    def running_sums(self, **cols: str | Column) -> Series:
        """Sums from the start of the series, halo rows included (two-level: block totals first).

        Totals and rows both read the blocks, so the blocks are written once, already shuffled and sorted.
        """
        tmp = {f"_x_{n}": (F.col(c) if isinstance(c, str) else c) for n, c in cols.items()}
        df = materialize(self.df.withColumns(tmp).sortWithinPartitions(*self._part, *self._sort))
        own = F.floor(F.col("_i") / self.block) == F.col("_blk")
        totals = (df.where(own).groupBy(*self._part)
                  .agg(*(F.sum(f"_x_{n}").alias(f"_t_{n}") for n in cols)))
        before = Window.partitionBy(*self.keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*self._part, *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}")
                                               for n in cols))
        df = df.join(offsets, self._part)
        run = self.upto.rowsBetween(Window.unboundedPreceding, 0)
        halo = F.col("_i") < F.col("_blk") * self.block
        df = df.withColumns({
            n: F.col(f"_o_{n}") + F.sum(f"_x_{n}").over(run)
            - F.coalesce(F.sum(F.when(halo, F.col(f"_x_{n}"))).over(self.part), F.lit(0.0))
            for n in cols})
        return self._with(df.drop(*(f"{p}_{n}" for n in cols for p in ("_x", "_o"))))

    # ---- result -----------------------------------------------------------------------
    @property
    def index(self) -> Column:
        """0-based position of the row in its series."""
        return F.col("_i")

    @property
    def from_end(self) -> Column:
        """Rows that follow the current one in its series."""
        return F.col("_total") - 1 - F.col("_i")

    def rows(self, keep_index: bool = False) -> DataFrame:
        """The blocks' own rows, without the bookkeeping columns."""
        df = self.df.where(F.floor(F.col("_i") / self.block) == F.col("_blk"))
        extra = ["_i", "_total"] if keep_index else []
        return df.select(*(c for c in df.columns if not c.startswith("_")), *extra)

    def select(self, *cols: str | Column) -> DataFrame:
        """Keys, order columns and the given columns of the blocks' own rows."""
        df = self.df.where(F.floor(F.col("_i") / self.block) == F.col("_blk"))
        return df.select(*self.keys, *self.order, *cols)


def blocked(df: DataFrame, back: int = 0, fwd: int = 0, keys: Sequence[str] = KEYS,
            order: Sequence[str] | str = ORDER, block: int | None = None,
            bucket: Column | None = None) -> Series:
    """Cut the series of ``df`` into blocks with a halo of ``back`` and ``fwd`` rows.

    ``bucket`` maps a row to a coarse, monotone slice of its order (default: the day); a bucket
    should hold far fewer rows than a block.
    """
    order = (order,) if isinstance(order, str) else tuple(order)
    block = block or BLOCK_ROWS
    df = df.withColumn("_bkt", F.col(order[0]).cast("date") if bucket is None else bucket)
    by_key = Window.partitionBy(*keys)
    sizes = (df.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_end", F.sum("_n").over(by_key.orderBy("_bkt")))
             .withColumn("_total", F.sum("_n").over(by_key))
             .withColumn("_start", F.col("_end") - F.col("_n")))
    sizes = sizes.withColumn("_blk", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("_start") - fwd) / block)),
        F.least(F.floor((F.col("_total") - 1) / block), F.floor((F.col("_end") - 1 + back) / block)))))
    sizes = sizes.select(*keys, "_bkt", "_blk", "_start", "_total")
    part = Window.partitionBy(*keys, "_blk")
    # a block's first row is the first row of its earliest bucket
    pos = F.min("_start").over(part) + F.row_number().over(part.orderBy(*order)) - 1
    rows = (df.join(sizes, [*keys, "_bkt"]).drop("_bkt")
            .withColumn("_i", pos).drop("_start")
            .where((F.col("_i") >= F.col("_blk") * block - back)
                   & (F.col("_i") < (F.col("_blk") + 1) * block + fwd)))
    rows = rows.withColumns({f"_c{n}": F.floor(F.col("_i") / n) for n in LEVELS})
    return Series(rows, keys, order, block, back, fwd)
