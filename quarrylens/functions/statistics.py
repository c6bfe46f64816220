"""Exact binomial tails as columns: whether a pass rate holds, and how many trials it takes to tell.

Tails are folded term by term in log space, so they neither overflow nor lose small terms; a fold has as many steps as trials.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the gate: the drop from the expected rate that is to be seen, its error levels, and the trials looked at.
DROP, ALPHA, POWER, LEAST, MOST = 0.4, 0.01, 0.99, 5, 70


def _from_top(n: Column, p: Column, start: Column, step, end) -> Column:
    """A fold over i = n ... 0 with log P(X = i): ``step(state, i, P(X = i))`` and then ``end(state)``."""
    first = F.struct((n * F.log(p)).alias("log"), start.alias("kept"))

    def each(state: Column, i: Column) -> Column:
        lower = state["log"] + F.when(i > 0, F.log(i / (n - i + 1)) + F.log(1 - p) - F.log(p)).otherwise(0.0)
        return F.struct(lower.alias("log"), step(state["kept"], i, F.exp(state["log"])).alias("kept"))

    return F.aggregate(F.sequence(n, F.lit(0), F.lit(-1)), first, each, lambda s: end(s["kept"]))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) of n trials at rate p; null where any is null, n is negative, or p is no rate."""
    k, n, p = k.cast("int"), n.cast("int"), p.cast("double")
    inner = F.least(_from_top(n, p, F.lit(0.0), lambda total, i, part: total + F.when(i >= k, part).otherwise(0.0), lambda total: total), F.lit(1.0))
    able = k.isNotNull() & (n >= 0) & p.between(0, 1)
    return F.when(able, F.when(k <= 0, 1.0).when((k > n) | (p == 0), 0.0).when(p == 1, 1.0).otherwise(inner))


def critical(n: Column, p: Column, alpha: float = ALPHA) -> Column:
    """The least k with P(X >= k) below ``alpha``; n + 1 if none is. Rates between 0 and 1."""
    none = F.struct(F.lit(0.0).alias("total"), (n + 1).alias("k"))

    def step(kept: Column, i: Column, part: Column) -> Column:
        total = kept["total"] + part
        return F.struct(total.alias("total"), F.when(total < alpha, i).otherwise(kept["k"]).alias("k"))

    return _from_top(n, p, none, step, lambda kept: kept["k"])


def sample_size(rate: Column) -> Column:
    """The least number of trials that tells the expected rate from one lower by DROP, at error levels ALPHA and POWER; MOST if none does."""
    rate = rate.cast("double")
    floor = rate * (1 - DROP)
    enough = F.filter(F.sequence(F.lit(LEAST), F.lit(MOST)), lambda n: binomial_tail(critical(n, floor), n, rate) >= POWER)
    return F.when(rate.isNotNull() & (rate > 0) & (rate <= 1), F.coalesce(F.get(enough, F.lit(0)), F.lit(MOST)))


def pass_rate(k: Column, n: Column, rate: Column) -> Column:
    """Struct (p_value, holds): whether k passes of n trials show that the expected rate has not dropped by DROP."""
    value = binomial_tail(k, n, rate * (1 - DROP))
    return F.struct(value.alias("p_value"), (value < ALPHA).alias("holds"))
