"""Joint distributions of several events: sums and means of discrete beliefs."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from credence.functions import cdf as C

#: Values of a joint distribution up to which it is exact; beyond that it is drawn.
SUPPORT, DRAWS, SEED = 4096, 1000, 17
#: Values of the first of two events that one row pairs with all of the second, and pairs that are held at once.
BLOCK, PAIRS = 4096, 1 << 20
#: Cells of a decimal grid, and the last bits on either side of a place that have a cell of their own.
CELLS, NEAR = 1 << 23, 4


def convolve(a: Column, b: Column) -> Column:
    """Points (v, p) of the sum of two independent discrete values, equal values merged."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct((x["v"] + y["v"]).alias("v"), (x["p"] * y["p"]).alias("p")))))
    ordered = F.array_sort(pairs)
    start = F.array().cast("array<struct<v:double,p:double>>")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        merged = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["v"].alias("v"), (last["p"] + x["p"]).alias("p"))))
        return F.when((F.size(done) > 0) & (last["v"] == x["v"]), merged).otherwise(F.concat(done, F.array(F.struct(x["v"].alias("v"), x["p"].alias("p")))))

    return F.aggregate(ordered, start, add)


def points(cdf: Column) -> Column:
    """(v, p) of a complete cdf."""
    return F.transform(C.masses(cdf), lambda m: F.struct(m["v"].cast("double").alias("v"), (m["hi"] - m["lo"]).cast("double").alias("p")))


def joint_pandas(pdfs: list[list[tuple[float, float]]], mean: bool, correlation: np.ndarray | None = None, support: int = SUPPORT, draws: int = DRAWS, seed: int = SEED) -> list[tuple[float, float]]:
    """(v, cp) of the sum or mean of discrete values, exact up to ``support`` values, else drawn with a seed.

    ``correlation`` joins them with a Gaussian copula, by drawing.
    """
    n = len(pdfs)
    out: dict[float, float] = {0.0: 1.0}
    if correlation is None:
        for pdf in pdfs:
            new: dict[float, float] = {}
            for v, p in out.items():
                for w, q in pdf:
                    new[v + w] = new.get(v + w, 0.0) + p * q
            out = new
            if len(out) > support:
                break
    if correlation is not None or len(out) > support:
        rng = np.random.default_rng(seed)
        if correlation is None:
            u = rng.random((draws, n))
        else:
            from statistics import NormalDist

            z = rng.normal(size=(draws, n)) @ np.linalg.cholesky(correlation).T
            u = np.vectorize(NormalDist().cdf)(z)
        total = np.zeros(draws)
        for i, pdf in enumerate(pdfs):
            ordered = sorted(pdf)
            cp = np.cumsum([p for _, p in ordered])
            total += np.array([v for v, _ in ordered])[np.minimum(np.searchsorted(cp, u[:, i]), len(cp) - 1)]
        values, counts = np.unique(total, return_counts=True)
        out = dict(zip(values.tolist(), (counts / draws).tolist()))
    cp, result = 0.0, []
    for v in sorted(out):
        cp += out[v]
        result.append((v / n if mean else v, cp))
    return result


def joint_of_groups(packed: DataFrame, keys: list[str], mean: bool = True) -> DataFrame:
    """(keys, n, cumulative_probability, event_value): the joint mean (or sum) of the cdfs of each group's events.

    ``packed`` has the keys, event_start and cdf (complete). Groups of single values are
    averaged without any Python; the others go through ``joint_pandas``.
    """
    single = F.max(F.size("cdf")) == 1
    groups = packed.groupBy(*keys).agg(F.count("*").alias("n"), single.alias("_sure"), F.avg(F.element_at("cdf", 1)["v"]).alias("_mean"), F.sum(F.element_at("cdf", 1)["v"]).alias("_sum"), F.min("event_start").alias("event_start"), F.collect_list("cdf").alias("_cdfs"))
    sure = groups.where("_sure").select(*keys, "event_start", "n", F.lit(1.0).alias("cumulative_probability"), F.col("_mean" if mean else "_sum").alias("event_value"))

    @F.pandas_udf("array<struct<cp:double,v:double>>")
    def join(cdfs: pd.Series) -> pd.Series:
        out = []
        for group in cdfs:
            pdfs = []
            for one in group:
                lo, pdf = 0.0, []
                for p in one:
                    if p["cp"] > lo:
                        pdf.append((p["v"], p["cp"] - lo))
                        lo = p["cp"]
                pdfs.append(pdf)
            out.append([{"cp": cp, "v": v} for v, cp in joint_pandas(pdfs, mean)])
        return pd.Series(out)

    spread = groups.where("not _sure").select(*keys, "event_start", "n", F.explode(join("_cdfs")).alias("_p"))
    spread = spread.select(*keys, "event_start", "n", F.col("_p.cp").alias("cumulative_probability"), F.col("_p.v").alias("event_value"))
    return sure.unionByName(spread)


def _by_grid(av: np.ndarray, ap: np.ndarray, bv: np.ndarray, bp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(v, p) of (a + b) / n over all pairs where the values lie on a decimal grid; None where they don't, or the grid is too wide.

    A cell is a place on the grid and the distance from its double in last bits, so sums
    share a cell only where they are the same double.
    """
    both = np.concatenate([av, bv])
    if not np.isfinite(both).all() or ap.min() * bp.min() <= 0:
        return None
    top = np.abs(both).max()
    for unit in (1.0, 10.0, 100.0, 1e3, 1e4):
        if top * unit < 2**40 and np.all(np.abs(both * unit - np.rint(both * unit)) < 1e-3):
            break
    else:
        return None
    i, j = np.rint(av * unit).astype(np.int64), np.rint(bv * unit).astype(np.int64)
    low, cells = i.min() + j.min(), (i.max() + j.max() - i.min() - j.min() + 1) * (2 * NEAR + 1)
    if cells > min(CELLS, 4 * len(i) * len(j)):
        return None
    base = (np.arange(low, low + cells // (2 * NEAR + 1)) / unit / n).view(np.int64)
    sums, step = np.zeros(cells), max(1, PAIRS // len(bv))
    j = j - low
    for k in range(0, len(av), step):
        at = (i[k : k + step, None] + j).ravel()
        near = ((av[k : k + step, None] + bv) / n).ravel().view(np.int64) - base[at]
        if near.min() < -NEAR or near.max() > NEAR:
            return None
        sums += np.bincount(at * (2 * NEAR + 1) + (near + NEAR), weights=np.outer(ap[k : k + step], bp).ravel(), minlength=cells)
    there = np.flatnonzero(sums)
    return (base[there // (2 * NEAR + 1)] + there % (2 * NEAR + 1) - NEAR).view(np.float64), sums[there]


def pair_sums(av: np.ndarray, ap: np.ndarray, bv: np.ndarray, bp: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts (v, p) of the distribution of (a + b) / n; a part has each value once, and at most PAIRS or CELLS of them."""
    if not len(av) or not len(bv):
        return
    by_grid = _by_grid(av, ap, bv, bp, n)
    if by_grid is not None:
        yield by_grid
        return
    step = max(1, PAIRS // len(bv))
    for k in range(0, len(av), step):
        v, at = np.unique(((av[k : k + step, None] + bv) / n).ravel(), return_inverse=True)
        yield v, np.bincount(at.ravel(), weights=np.outer(ap[k : k + step], bp).ravel(), minlength=len(v))


def joint_of_two(packed: DataFrame, keys: list[str], mean: bool = True) -> DataFrame:
    """The same for groups of two events or one.

    Every value of the one meets every value of the other, as sums of doubles are told apart
    by their last bit. The one's values are dealt to tasks in blocks; pairs are added up
    where they arise, and only distinct values leave a block.
    """
    groups = packed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("event_start").alias("event_start"), F.transform(F.array_sort(F.collect_list(F.struct("event_start", "cdf"))), lambda e: e["cdf"]).alias("_cdfs"))
    sure = F.array(F.struct(F.lit(0.0).alias("v"), F.lit(1.0).alias("p")))
    both = C.bound(F.col("_cdfs"), lambda c: F.struct(points(F.get(c, F.lit(0))).alias("a"), F.when(F.size(c) > 1, points(F.get(c, F.lit(1)))).otherwise(sure).alias("b")))
    blocks = lambda a: F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(a, i, BLOCK))
    names = [*keys, "event_start", "n"]
    dealt = groups.select(*names, both.alias("_both")).select(*names, F.col("_both.b").alias("_b"), F.posexplode(C.bound(F.col("_both.a"), blocks)).alias("_i", "_a"))
    spark = packed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = dealt.repartition(tasks, *keys, "_i").select(*names, F.col("_a.v").alias("_av"), F.col("_a.p").alias("_ap"), F.col("_b.v").alias("_bv"), F.col("_b.p").alias("_bp"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.slice(row, 1)
                column = lambda c: own.column(c)[0].values.to_numpy(zero_copy_only=False).astype(float)
                known = lambda c: own.column(c)[0].values.is_valid().to_numpy(zero_copy_only=False)
                av, ap, bv, bp, a, b = column("_av"), column("_ap"), column("_bv"), column("_bp"), known("_av"), known("_bv")
                for v, p in itertools.chain(_unknown(ap, bp, a, b), pair_sums(av[a], ap[a], bv[b], bp[b], own.column("n")[0].as_py() if mean else 1)):
                    held = own.select(names).take(pa.array(np.zeros(len(p), dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([*held.columns, pa.array(v, pa.float64()), pa.array(p)], [*names, "event_value", "p"])

    schema = StructType([*dealt.select(*names).schema.fields, StructField("event_value", DoubleType()), StructField("p", DoubleType())])
    # Dealt by the keys alone, which serves the sums and the window after them.
    met = dealt.mapInArrow(meet, schema).repartition(tasks, *keys)
    merged = met.groupBy(*names, "event_value").agg(F.sum("p").alias("p"))
    up = Window.partitionBy(*keys).orderBy("event_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return merged.select(*names, F.sum("p").over(up).alias("cumulative_probability"), "event_value")


def _unknown(ap: np.ndarray, bp: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[list, np.ndarray]]:
    """The part of the pairs of which a value is unknown: none, or one null with their probability."""
    if a.all() and b.all():
        return []
    return [([None], np.array([ap.sum() * bp.sum() - ap[a].sum() * bp[b].sum()]))]


def equalize_bins(cdfs: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, event_value, cumulative_probability): every cdf on the values of all cdfs of its group.

    ``cdfs`` (by, key, cumulative_probability, event_value); groups have equal ``by``
    columns, as the cdfs of one event have. Below a cdf's first value it is 0.
    """
    by = list(by)
    keys, values = cdfs.select(*by, key).distinct(), cdfs.select(*by, "event_value").distinct()
    grid = keys.join(values, by) if by else keys.crossJoin(values)
    met = grid.join(cdfs, [*by, key, "event_value"], "left")
    up = Window.partitionBy(*by, key).orderBy("event_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.select(*by, key, "event_value", F.coalesce(F.last("cumulative_probability", ignorenulls=True).over(up), F.lit(0.0)).alias("cumulative_probability"))
