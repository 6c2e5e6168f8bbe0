"""Functions of beliefs as discrete or uniform distributions; ``cdf`` is an array of (cp, v) by probability."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sigma_to_cp(k: float) -> float:
    """The cumulative probability k standard deviations above a normal mean."""
    return 0.5 + 0.5 * math.erf(k / math.sqrt(2))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once.

    A column that a lambda names is put there with all that makes it, such as the sort of
    a packed cdf, and would be worked out anew for each element.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def complete(cdf: Column) -> Column:
    """The highest value takes the probability that is left."""

    def of(c: Column) -> Column:
        return bound(F.size(c) - 1, lambda last: F.transform(c, lambda p, i: F.struct(F.when(i == last, F.lit(1.0)).otherwise(p["cp"]).alias("cp"), p["v"].alias("v"))))

    return bound(cdf, of)


def masses(cdf: Column) -> Column:
    """Array of (lo, hi, v): the slice of probability that each value has, from a complete cdf; empty slices are left out."""

    def of(c: Column) -> Column:
        cut = F.transform(c, lambda p, i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(F.get(c, i - 1)["cp"]).alias("lo"), p["cp"].alias("hi"), p["v"].alias("v")))
        return F.filter(cut, lambda p: p["hi"] > p["lo"])

    return bound(cdf, of)


def value_at(cdf: Column, cp: float) -> Column:
    """The first point with at least a cumulative probability, else the last one."""
    there = lambda c: F.filter(c, lambda p: p["cp"] >= F.lit(cp))
    return bound(cdf, lambda c: F.coalesce(F.get(there(c), F.lit(0)), F.element_at(c, -1)))


def mean_uniform(cdf: Column) -> Column:
    """The mean where values between points are equally likely; the rest lies on the first and the last value."""

    def of(c: Column) -> Column:
        n = F.size(c)
        inner = F.aggregate(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            F.lit(0.0),
            lambda total, i: total + F.coalesce((F.get(c, i)["cp"] - F.get(c, i - 1)["cp"]) * (F.get(c, i)["v"] + F.get(c, i - 1)["v"]) / 2, F.lit(0.0)),
        )
        first, last = F.element_at(c, 1), F.element_at(c, -1)
        return F.when(n == 1, first["v"]).otherwise(first["cp"] * first["v"] + inner + (1 - last["cp"]) * last["v"])

    return bound(cdf, of)


def mean_discrete(cdf: Column) -> Column:
    """The mean of the values themselves; the highest one takes the probability that is left."""
    return F.aggregate(masses(complete(cdf)), F.lit(0.0), lambda total, m: total + (m["hi"] - m["lo"]) * m["v"])


def mean(cdf: Column, distribution: str = "uniform") -> Column:
    """The mean of a belief read as "uniform", "discrete" or "normal" (through its first two points)."""
    return {"uniform": mean_uniform, "discrete": mean_discrete, "normal": lambda c: normal(c)["mu"]}[distribution](cdf)


def cp_at_uniform(cdf: Column, value: Column) -> Column:
    """The cumulative probability of a value, interpolated between points."""

    def of(c: Column, x: Column) -> Column:
        n = F.size(c)
        last = F.element_at(c, -1)
        inside = F.aggregate(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            F.lit(None).cast("double"),
            lambda found, i: F.coalesce(
                found,
                F.when(
                    (x >= F.get(c, i - 1)["v"]) & (x < F.get(c, i)["v"]),
                    F.get(c, i - 1)["cp"] + (F.get(c, i)["cp"] - F.get(c, i - 1)["cp"]) * (x - F.get(c, i - 1)["v"]) / (F.get(c, i)["v"] - F.get(c, i - 1)["v"]),
                ),
            ),
        )
        return F.when((n == 1) | (x >= last["v"]), F.lit(1.0)).otherwise(F.coalesce(inside, F.lit(0.0)))

    return bound(cdf, lambda c: bound(value, lambda x: of(c, x)))


def _normal_of(cp1: pd.Series, v1: pd.Series, cp2: pd.Series, v2: pd.Series) -> pd.DataFrame:
    unit = NormalDist()
    out = []
    for a, x, b, y in zip(cp1, v1, cp2, v2):
        if pd.isna(b) or not 0 < a < b < 1:
            out.append((x, 0.0))
        else:
            sigma = (y - x) / (unit.inv_cdf(b) - unit.inv_cdf(a))
            out.append((x - sigma * unit.inv_cdf(a), sigma))
    return pd.DataFrame(out, columns=["mu", "sigma"])


def normal(cdf: Column) -> Column:
    """(mu, sigma) of the normal distribution through the first two points; a single point is a sure value."""
    normal_of = F.pandas_udf(_normal_of, "mu double, sigma double")
    second = F.get(cdf, F.lit(1))
    return normal_of(F.element_at(cdf, 1)["cp"], F.element_at(cdf, 1)["v"], second["cp"], second["v"])


def partial(cdf: Column, lo: Column, hi: Column) -> Column:
    """The part of a complete cdf within a range of cumulative probability, scaled to 0..1."""
    cut = F.filter(masses(cdf), lambda p: F.least(p["hi"], hi) > F.greatest(p["lo"], lo))
    return F.transform(cut, lambda p: F.struct(((F.least(p["hi"], hi) - lo) / (hi - lo)).alias("cp"), p["v"].alias("v")))


def _count(cuts: Column, steps: Column, holds: Callable[[Column], Column]) -> Column:
    """How many masses, from the first on, a condition holds for that ends to hold once; found by halving."""

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        above = F.when(a["lo"] < a["hi"], F.coalesce(holds(F.get(cuts, mid)), F.lit(False)))
        return F.when(above, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))).when(~above, F.struct(a["lo"].alias("lo"), mid.alias("hi"))).otherwise(a)

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve)["lo"]


def _half_spread(weighed: Column) -> Column:
    """Half the mean distance of two values drawn from (v, w), gap by gap of the ordered values: the weights on its sides multiply."""
    start = F.struct(F.lit(0.0).alias("below"), F.lit(None).cast("double").alias("v"), F.lit(0.0).alias("sum"))

    def of(ordered: Column, total: Column) -> Column:
        gap = lambda a, p: (p["v"] - F.coalesce(a["v"], p["v"])) * a["below"] * (total - a["below"])
        return F.aggregate(ordered, start, lambda a, p: F.struct((a["below"] + p["w"]).alias("below"), p["v"].alias("v"), (a["sum"] + gap(a, p)).alias("sum")))["sum"]

    return bound(F.array_sort(weighed), lambda o: bound(F.aggregate(o, F.lit(0.0), lambda a, p: a + p["w"]), lambda total: of(o, total)))


def _whole(cuts: Column, rising: bool) -> Column:
    """Whether masses follow each other from 0 to 1 with finite values, which rise if asked."""

    def fits(p: Column, i: Column) -> Column:
        before = F.get(cuts, i - 1)
        follows = (p["lo"] == before["hi"]) & (p["v"] >= before["v"]) if rising else p["lo"] == before["hi"]
        return F.when(i == 0, p["lo"] == 0).otherwise(follows) & (F.abs(p["v"].cast("double")) < F.lit(math.inf))

    return F.coalesce((F.get(cuts, F.size(cuts) - 1)["hi"] == 1) & F.forall(F.transform(cuts, fits), lambda x: x), F.lit(False))


def _crps_in_one_pass(f: Column, r: Column) -> Column:
    """The score of masses that are ``_whole``, the forecast's rising: down all places where either changes its value."""
    place = lambda p, size: F.struct(p["hi"].cast("double").alias("at"), p["v"].cast("double").alias("v"), size.alias("size"))
    places = F.sort_array(F.concat(F.transform(f, lambda p: place(p, F.lit(None).cast("double"))), F.transform(r, lambda p: place(p, (p["hi"] - p["lo"]).cast("double")))), asc=False)
    last = lambda c: F.get(c, F.size(c) - 1)
    state = lambda at, fv, rv, size, above, sum: F.struct(at.alias("at"), fv.alias("f"), rv.alias("r"), size.alias("size"), above.alias("above"), sum.alias("sum"))
    start = state(F.lit(1.0), last(f)["v"].cast("double"), last(r)["v"].cast("double"), (last(r)["hi"] - last(r)["lo"]).cast("double"), F.lit(0.0), F.lit(0.0))

    def down(a: Column, x: Column) -> Column:
        here = a["above"] + a["at"] - x["at"]  # of the reference's slice, what lies above this place
        sum = a["sum"] + (a["at"] - x["at"]) * F.abs(a["f"] - a["r"])
        gap = F.abs(a["f"] - x["v"]) * here * (a["size"] - here) / a["size"]
        return F.when(x["size"].isNull(), state(x["at"], x["v"], a["r"], a["size"], here, sum - gap)).otherwise(state(x["at"], a["f"], x["v"], x["size"], F.lit(0.0), sum))

    return F.aggregate(places, start, down, lambda a: a["sum"] + a["at"] * F.abs(a["f"] - a["r"]))


def crps(forecast: Column, reference: Column) -> Column:
    """Continuous ranked probability score of two complete cdfs, quantile by quantile of the reference.

    For each value of the reference, the forecast's distribution within the same slice of
    probability is scored against it; the scores are weighted by the slices. The work grows
    as n log n with the points of both: in one pass where the forecast's values rise with
    its probability, else each slice's part of it is found by halving.
    """

    def slice_score(f: Column, steps: Column, r: Column) -> Column:
        first, end = _count(f, steps, lambda p: p["hi"] <= r["lo"]), _count(f, steps, lambda p: p["lo"] < r["hi"])
        part = bound(first, lambda k: F.slice(f, k + 1, F.greatest(end - k, F.lit(0))))
        weight = lambda p: (F.least(p["hi"], r["hi"]) - F.greatest(p["lo"], r["lo"])) / (r["hi"] - r["lo"])
        weighed = F.transform(part, lambda p: F.struct(p["v"].cast("double").alias("v"), weight(p).alias("w")))
        miss = lambda w: F.aggregate(w, F.lit(0.0), lambda a, p: a + p["w"] * F.abs(p["v"] - r["v"]))
        return bound(weighed, lambda w: miss(w) - _half_spread(w)) * (r["hi"] - r["lo"])

    halvings = lambda f: F.sequence(F.lit(1), F.length(F.bin(F.size(f))))
    by_halving = lambda f, r: bound(halvings(f), lambda steps: F.aggregate(r, F.lit(0.0), lambda a, x: a + slice_score(f, steps, x)))
    score = lambda f, r: F.when(_whole(f, True) & _whole(r, False), _crps_in_one_pass(f, r)).otherwise(by_halving(f, r))
    return bound(masses(forecast), lambda f: bound(masses(reference), lambda r: score(f, r)))
