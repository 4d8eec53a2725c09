"""Vector clocks as array<bigint> columns: [epoch, c0, c1, ...]."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def compare(a: Column, b: Column) -> Column:
    """0: a before b; 1: after; 2: equal; -1: concurrent.  The epoch decides first."""
    n = F.size(a) - 1
    less = F.exists(F.zip_with(F.slice(a, 2, n), F.slice(b, 2, n), lambda x, y: x < y), lambda t: t)
    more = F.exists(F.zip_with(F.slice(a, 2, n), F.slice(b, 2, n), lambda x, y: x > y), lambda t: t)
    ea, eb = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    return F.when(ea < eb, 0).when(ea > eb, 1).when(less & more, -1).when(less, 0).when(more, 1).otherwise(2)


def happens_before(a: Column, b: Column) -> Column:
    return compare(a, b) == 0


def equal_or_before(a: Column, b: Column) -> Column:
    return compare(a, b).isin(0, 2)


def before_all(a: Column, others: Column) -> Column:
    """a happens before every clock of an array of clocks."""
    return F.forall(others, lambda o: happens_before(a, o))


def increment(clock: Column, slot: int) -> Column:
    """One more in the clock's own slot."""
    return F.transform(clock, lambda x, i: F.when(i == slot + 1, x + 1).otherwise(x))


def merge(a: Column, b: Column) -> Column:
    """Slot by slot the larger, within one epoch; else the clock of the later epoch."""
    ea, eb = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    return F.when(ea > eb, a).when(eb > ea, b).otherwise(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))


def new_epoch(clock: Column, epoch: Column) -> Column:
    """All counters zero in a later epoch; an earlier epoch changes nothing."""
    return F.when(epoch > F.get(clock, F.lit(0)), F.transform(clock, lambda x, i: F.when(i == 0, epoch).otherwise(F.lit(0).cast("bigint")))).otherwise(clock)


def least(clocks: DataFrame, id_col: str = "id", clock_col: str = "clock", parts: int = 64) -> DataFrame:
    """(id): the clocks that none of the others certainly precedes.

    Equal clocks are one.  Every salted part first keeps its own minimal clocks, and those of all parts are
    then reduced together; a clock that is not minimal in its part is not minimal at all.
    """
    rows = clocks.select(F.col(id_col).alias("id"), F.col(clock_col).alias("clock"))
    each = rows.select("clock").distinct()
    local = each.groupBy(F.pmod(F.xxhash64("clock"), F.lit(parts)).alias("part")).applyInPandas(_minimal, "clock array<bigint>")
    all_ = local.groupBy(F.lit(0).alias("part")).applyInPandas(_minimal, "clock array<bigint>")
    return rows.join(all_, "clock", "left_semi").select("id")


def _minimal(rows: pd.DataFrame) -> pd.DataFrame:
    """In order of (epoch, sum), a clock can only be preceded by one that comes earlier."""
    clocks = np.stack(rows["clock"].to_list())
    order = np.lexsort((clocks[:, 1:].sum(1), clocks[:, 0]))
    kept: list[int] = []
    for i in order:
        c = clocks[i]
        if c[0] > clocks[order[0], 0]:
            break
        have = clocks[kept, 1:]
        if not ((have <= c[1:]).all(1) & (have < c[1:]).any(1)).any():
            kept.append(i)
    return rows.iloc[kept][["clock"]]


def floor(clocks: DataFrame, clock_col: str = "clock") -> DataFrame:
    """(clock): the element-wise minimum of all clocks, below which events may be forgotten."""
    each = clocks.select(F.posexplode(clock_col).alias("i", "x")).groupBy("i").agg(F.min("x").alias("x"))
    return each.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("clock"))
