"""Simulations of a block bootstrap: runs of trades as a monoid, laid end to end in a tree, all simulations together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a run: gross profit and loss, sum, highest and lowest running sum, drawdown; count, mean and squares of the returns
RUN = ("gp", "gl", "t", "hi", "lo", "dd", "n", "m", "s")
_NONE = dict(zip(RUN, (0.0, 0.0, 0.0, -np.inf, np.inf, 0.0, 0.0, 0.0, 0.0)))
#: blocks of a simulation that are laid end to end at a time, and simulations that a task runs; of long keys, whose
#: trades travel once for each task, more of them, few at a time so that these stay in a processor's cache, and so many trades a row
WIDTH, TOGETHER = 512, 64
TOGETHER_LONG, FEW, PACKED = 128, 16, 256

# ---- fixed values: a generator of whole numbers that SQL can repeat: multiply, add and fold modulo a prime ------------
PRIME = 2147483647
_STEPS = ((48271, 11, 15), (69621, 7, 13), (16807, 3, 0))
_SALTS = (0, 1640531527)


def start(sim, b, total, seed: int, xor=np.bitwise_xor, shift=np.right_shift):
    """The first trade of block ``b`` of simulation ``sim``, from 0 to ``total - 1``: 62 mixed bits modulo ``total``."""
    x = []
    for salt in _SALTS:
        v = (sim * 1000003 + b * 7919 + (seed * 104729 + salt)) % PRIME
        for times, plus, fold in _STEPS:
            v = (v * times + plus) % PRIME
            v = xor(v, shift(v, fold)) if fold else v
        x.append(v)
    return (x[0] * (PRIME + 1) + x[1]) % total


def start_sql(sim: str, b: str, total: str, seed: int) -> str:
    x = []
    for salt in _SALTS:
        v = f"(({sim}::BIGINT * 1000003 + {b}::BIGINT * 7919 + {seed * 104729 + salt}) % {PRIME})"
        for times, plus, fold in _STEPS:
            v = f"(({v} * {times} + {plus}) % {PRIME})"
            if fold:
                v = f"xor({v}, {v} >> {fold})"
        x.append(v)
    return f"(({x[0]} * {PRIME + 1} + {x[1]}) % {total})"


def laid(a: dict[str, np.ndarray], x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Runs ``a`` with runs ``x`` behind them; squares are about the runs' own means, so a large mean costs no digits."""
    n, d = a["n"] + x["n"], x["m"] - a["m"]
    part = np.divide(x["n"], n, out=np.zeros_like(n), where=n > 0)
    with np.errstate(invalid="ignore"):
        return {"gp": a["gp"] + x["gp"], "gl": a["gl"] + x["gl"], "t": a["t"] + x["t"], "hi": np.maximum(a["hi"], a["t"] + x["hi"]), "lo": np.minimum(a["lo"], a["t"] + x["lo"]),
                "dd": np.maximum(np.maximum(a["dd"], x["dd"]), a["hi"] - a["t"] - x["lo"]), "n": n, "m": a["m"] + d * part, "s": a["s"] + x["s"] + d * d * a["n"] * part}


def _single(v: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """Each trade as a run of one."""
    has = (~np.isnan(r)).astype(float)
    return {"gp": np.maximum(v, 0.0), "gl": np.maximum(-v, 0.0), "t": v, "hi": v, "lo": v, "dd": np.zeros(v.shape), "n": has, "m": np.where(has > 0, r, 0.0), "s": np.zeros(v.shape)}


def blocks(v: np.ndarray, r: np.ndarray, block: int) -> dict[str, np.ndarray]:
    """The run of ``block`` trades from every trade on; ``v`` results, ``r`` returns (NaN: none)."""
    one = _single(v, r)
    many = len(v) - block + 1
    out = {k: x[:many] for k, x in one.items()}
    for k in range(1, block):
        out = laid(out, {c: x[k:many + k] for c, x in one.items()})
    return out


def _tree(runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of runs laid end to end, neighbours first."""
    while runs["t"].shape[1] > 1:
        if runs["t"].shape[1] % 2:
            runs = {k: np.concatenate((x, np.full((len(x), 1), _NONE[k])), axis=1) for k, x in runs.items()}
        runs = laid({k: x[:, 0::2] for k, x in runs.items()}, {k: x[:, 1::2] for k, x in runs.items()})
    return {k: x[:, 0] for k, x in runs.items()}


def simulate(v: np.ndarray, r: np.ndarray, sims: np.ndarray, block: int, seed: int) -> dict[str, np.ndarray]:
    """For each of ``sims`` the run of ``len(v) // block`` drawn blocks. A draw is a lookup in the blocks' runs."""
    known, total = blocks(v, r, block), len(v) - block
    out = {k: np.full(len(sims), x) for k, x in _NONE.items()}
    for lo in range(0, len(v) // block, WIDTH):
        b = np.arange(lo, min(lo + WIDTH, len(v) // block), dtype=np.int64)
        at = start(sims[:, None].astype(np.int64), b[None, :], total, seed)
        out = laid(out, _tree({k: x[at] for k, x in known.items()}))
    return out


def _folded(v: np.ndarray, r: np.ndarray, at: np.ndarray, block: int) -> dict[str, np.ndarray]:
    """The runs of ``block`` trades from the places ``at`` on, all with a return: :func:`laid` trade by trade, in place."""
    x = {k: a.copy() for k, a in _single(v[at], r[at]).items()}
    p, q, i = np.empty(at.shape), np.empty(at.shape), at.copy()
    for k in range(1, block):
        i += 1
        np.take(v, i, out=p, mode="clip")
        np.subtract(x["hi"], x["t"], out=q)
        q -= p
        np.maximum(x["dd"], q, out=x["dd"])
        x["t"] += p
        np.maximum(x["hi"], x["t"], out=x["hi"])
        np.minimum(x["lo"], x["t"], out=x["lo"])
        x["gp"] += np.maximum(p, 0.0, out=q)
        x["gl"] -= np.minimum(p, 0.0, out=q)
        np.take(r, i, out=p, mode="clip")
        p -= x["m"]
        np.multiply(p, p, out=q)
        q *= k
        q *= 1 / (k + 1)
        x["s"] += q
        p *= 1 / (k + 1)
        x["m"] += p
    x["n"][...] = block
    return x


def simulate_drawn(v: np.ndarray, r: np.ndarray, sims: np.ndarray, block: int, seed: int) -> dict[str, np.ndarray]:
    """The same runs as of :func:`simulate`, bit by bit, with the trades of a block folded when it is drawn.

    A trade takes its 16 bytes and no more, at ``block`` times the arithmetic of a lookup.
    """
    total, whole = len(v) - block, not np.isnan(r).any()
    out = {k: np.full(len(sims), x) for k, x in _NONE.items()}
    for lo in range(0, len(v) // block, WIDTH):
        b = np.arange(lo, min(lo + WIDTH, len(v) // block), dtype=np.int64)
        at = start(sims[:, None].astype(np.int64), b[None, :], total, seed)
        if whole:
            x = _folded(v, r, at, block)
        else:
            x = _single(v[at], r[at])
            for k in range(1, block):
                x = laid(x, _single(v[at + k], r[at + k]))
        out = laid(out, _tree(x))
    return out


def simulated(trades: DataFrame, keys: Sequence[str], sims: int, block: int, seed: int) -> DataFrame:
    """(keys, sim, run columns) of the keys in ``trades`` (keys, _i, _v, _r); a key's trades are held by a task.

    Trades travel once for each TOGETHER simulations; no draw ever does.
    """
    keys = list(keys)
    each = trades.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((sims - 1) // TOGETHER))))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_i").to_numpy(), kind="stable")
        v, r = (table.column(c).to_numpy().astype(float)[order] for c in ("_v", "_r"))
        lo = table.column("_part")[0].as_py() * TOGETHER
        sim = np.arange(lo, min(lo + TOGETHER, sims))
        got = simulate(v, r, sim, block, seed)
        zero = pa.array(np.zeros(len(sim), np.int64))
        return pa.table([*(table.column(k).take(zero) for k in keys), pa.array(sim, pa.int64()), *(pa.array(got[k]) for k in RUN)], names=[*keys, "sim", *RUN])
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in trades.select(*keys).schema]
    return each.groupBy(*keys, "_part").applyInArrow(run, ", ".join([*ddl, "sim long", *(f"{k} double" for k in RUN)]))


def simulated_long(trades: DataFrame, keys: Sequence[str], sims: int, block: int, seed: int) -> DataFrame:
    """(keys, sim, run columns) as of :func:`simulated`, for long keys in ``trades`` (keys, _i, _v, _r, _total).

    A task holds 16 bytes for each trade of one key at a time; rows stream in, and no draw travels or is stored.
    """
    keys = list(keys)
    near = F.floor(F.col("_i") / PACKED).alias("_near")
    lists = (F.collect_list(c).alias(n) for n, c in (("_i", F.col("_i")), ("_v", F.col("_v")), ("_r", F.coalesce("_r", F.lit(float("nan"))))))
    packed = trades.groupBy(*keys, "_total", near).agg(*lists).drop("_near")
    each = packed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((sims - 1) // TOGETHER_LONG))))
    each = each.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part")
    types = trades.select(*keys).schema

    def run(batches):
        own, key, v, r = None, None, None, None

        def done() -> pa.RecordBatch:
            lo = own[-1] * TOGETHER_LONG
            sim = np.arange(lo, min(lo + TOGETHER_LONG, sims))
            parts = [simulate_drawn(v, r, sim[i:i + FEW], block, seed) for i in range(0, len(sim), FEW)]
            zero = pa.array(np.zeros(len(sim), np.int64))
            return pa.RecordBatch.from_arrays([*(k.take(zero) for k in key), pa.array(sim, pa.int64()), *(pa.array(np.concatenate([p[k] for p in parts])) for k in RUN)], names=[*keys, "sim", *RUN])

        for batch in batches:
            by = [batch.column(c) for c in (*keys, "_part")]
            new = np.zeros(batch.num_rows, bool)
            for c in by:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, z in zip(cut, cut[1:]):
                if z == a:
                    continue
                now = tuple(c[a].as_py() for c in by)
                if now != own:
                    if own is not None:
                        yield done()
                    own, key = now, [pa.concat_arrays([c.slice(a, 1)]) for c in by[:-1]]
                    v, r = (np.empty(batch.column("_total")[a].as_py()) for _ in range(2))
                part = batch.slice(a, z - a)
                i = part.column("_i").flatten().to_numpy()
                v[i], r[i] = part.column("_v").flatten().to_numpy(), part.column("_r").flatten().to_numpy()
        if own is not None:
            yield done()
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in types]
    return each.mapInArrow(run, ", ".join([*ddl, "sim long", *(f"{k} double" for k in RUN)]))
