"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

1. Equal unit vectors are one class, counted before they meet.
2. Every tree splits the classes at the median of random projections, again and again;
   those near a threshold go to both sides. Thresholds come from a bounded sample of a
   node's vectors; every vector is routed. A node's vectors are routed in cells of some
   thousand, each beside the node's thresholds. Nodes that still have more than ``LEAF``
   vectors are split anew in the next round.
3. Vectors that share a leaf are compared by exact cosine in double precision; each leaf
   gives counts and connections, one row for each class in it, and no pairs. A leaf that
   cannot be split is compared in blocks, each pair of blocks in a task of its own, so no
   leaf is cut short; that work, though not its rows, grows with the leaf's square.
4. Links of classes are united; counts of links are sums over classes.

Only vectors of equal, non-null label and equal length meet. Defined results: vectors
that are null, empty, zero or hold null or non-finite parts, and rows with a null label,
have no links and are a class of their own; repeated rows count as vectors of their own,
the component is the least id; ties need no rule, as links are symmetric; an empty table
gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import bound_batches, connected_components, materialise

COSINE, TREES, LEAF, SEED = 0.98, 4, 1024, 3
#: Vectors that a node's thresholds are taken from, half the overlap of a split, and keys that a busy group is dealt to in joins.
SAMPLE, SPILL, SALT = 4096, 0.03, 16


def unit_rows(df: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """(rid, key, label, dim, vec): vec holds the unit vector in double precision, null where the row links with nothing."""

    def run(batches):
        for batch in batches:
            out, dims = [], []
            for x, lab in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                v = None
                if x and lab is not None and None not in x:
                    v = np.array(x, np.float64)
                    norm = np.linalg.norm(v / m) * m if np.isfinite(v).all() and (m := np.abs(v).max()) > 0 else 0
                    v = v / norm if norm and np.isfinite(norm) else None
                out.append(None if v is None else v.tobytes())
                dims.append(len(x or []))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["rid", "key", "label", "dim", "vec"])

    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    return rows.mapInArrow(run, "rid long, key long, label string, dim int, vec binary")


def matrix(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def beside(rows: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """A join with one row for each value of ``on``, whose busy values are dealt to ``SALT`` keys."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("rid"), F.lit(SALT)))
    each = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(each, [on, "_salt"]).drop("_salt")


def grow(x: np.ndarray, seed: list[int], least: int) -> list[tuple]:
    """A tree over a sample: (left, right, threshold) of each node, left < 0 for a leaf; directions follow from the seed."""
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)))]
    nodes.append((-1, -1, 0.0))
    while todo:
        at, rows = todo.pop()
        if len(rows) <= least or len(nodes) > 510:
            continue
        p = x[rows] @ direction(seed, at, x.shape[1])
        cut = float(np.median(p))
        left, right = rows[p <= cut + SPILL], rows[p > cut - SPILL]
        if max(len(left), len(right)) > 0.9 * len(rows):
            continue
        nodes[at] = (len(nodes), len(nodes) + 1, cut)
        todo += [(len(nodes), left), (len(nodes) + 1, right)]
        nodes += [(-1, -1, 0.0), (-1, -1, 0.0)]
    return nodes


def direction(seed: list[int], node: int, dim: int) -> np.ndarray:
    v = np.random.default_rng([*seed, node]).normal(size=dim)
    return v / np.linalg.norm(v)


def route(x: np.ndarray, nodes: list[tuple], seed: list[int]) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) of all rows; a row near a threshold is in leaves on both sides."""
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        left, right, cut = nodes[at]
        if not len(rows):
            continue
        if left < 0:
            out.append((at, rows))
            continue
        p = x[rows] @ direction(seed, at, x.shape[1])
        todo += [(left, rows[p <= cut + SPILL]), (right, rows[p > cut - SPILL])]
    return out


def fitter(turn: int):
    """A function that makes the tree of a node from its sample."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(list(pdf.sort_values("rid")["vec"]))
        name = str(pdf["node"].iloc[0])
        nodes = grow(x, seed_of(name, turn), max(32, int(LEAF * len(x) / float(pdf["size"].iloc[0]))))
        return pd.DataFrame({"node": [name], "left": [[n[0] for n in nodes]], "right": [[n[1] for n in nodes]], "cut": [[n[2] for n in nodes]]})

    return fit


def sender(turn: int):
    """A function that routes a cell's rows down the tree of their node."""

    def send(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        name, rows = str(model["node"].iloc[0]), rows.drop(columns="cell")
        nodes = list(zip(model["left"].iloc[0], model["right"].iloc[0], model["cut"].iloc[0]))
        found = route(matrix(list(rows["vec"])), nodes, seed_of(name, turn))
        return pd.concat([rows.iloc[some].assign(node=f"{name}/{leaf}", done=len(nodes) == 1) for leaf, some in found])

    return send


def plant(reps: DataFrame, trees: int) -> DataFrame:
    """(node, done, rid, vec, n): every class in its leaves of all trees."""
    node = F.concat_ws("/", "label", "dim", F.col("tree").cast("string"))
    now = reps.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)]))).select(node.alias("node"), F.lit(False).alias("done"), "rid", "vec", "n")
    now, leaves, turn = materialise(now, "forest"), [], 0
    while True:
        sizes = materialise(now.where("not done").groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > LEAF), "forest-sizes")
        if sizes.isEmpty():
            return _all([*leaves, now])
        large = beside(now.where("not done"), sizes, "node")
        share = F.lit(SAMPLE) / F.col("size")
        lot = F.shiftrightunsigned(F.xxhash64("rid", "node"), 11) / F.lit(float(1 << 53))
        fitted = large.where(lot < share).groupBy("node").applyInPandas(fitter(turn), "node string, left array<int>, right array<int>, cut array<double>")
        cells = F.ceil(F.col("size") / F.lit(SAMPLE)).cast("long")
        name = lambda number: F.concat_ws("#", "node", number.cast("string"))
        models = fitted.join(sizes, "node").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))).select(name(F.col("_i")).alias("cell"), "node", "left", "right", "cut")
        rows = large.withColumn("cell", name(F.pmod(F.xxhash64("rid"), cells))).select("cell", *now.columns)
        split = rows.groupBy("cell").cogroup(models.groupBy("cell")).applyInPandas(sender(turn), now.schema)
        leaves.append(now.where("done").unionByName(now.where("not done").join(sizes.select("node"), "node", "left_anti")))
        now = materialise(split, "forest")
        turn += 1


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seed_of(name: str, turn: int) -> list[int]:
    return [SEED, turn, *name.encode()]


def roots_of(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation, the first row that it reaches."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def compare(leaves: DataFrame, cosine: float) -> DataFrame:
    """(a, b, links): class a links with ``links`` vectors of other classes, and is connected with class b.

    A class has a row for each leaf and block in which it links. Classes that share
    several leaves are counted in the first of these alone.
    """

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        x, rid, chunk = matrix(list(pdf["vec"])), pdf["rid"].to_numpy(), pdf["chunk"].to_numpy()
        n, here = pdf["n"].to_numpy(), int(pdf["leaf"].iloc[0])
        cross = pdf["one"].iloc[0] != pdf["two"].iloc[0]
        known: dict[int, int] = {}
        at = [(i, known.setdefault(int(h), len(known))) for i, hs in enumerate(pdf["leaves"]) for h in hs if h < here]
        before = np.zeros((len(x), len(known)), np.float32)  # which earlier leaves each class is in
        if at:
            before[tuple(np.array(at).T)] = 1
        links, linked = np.zeros(len(x), np.int64), np.zeros((len(x), len(x)), bool)
        for i in range(0, len(x), 512):
            near = (x[i : i + 512] @ x.T >= cosine) & (rid[i : i + 512, None] != rid[None, :])
            if cross:
                near &= chunk[i : i + 512, None] != chunk[None, :]
            some = np.flatnonzero(near.any(axis=1))
            first = before[i + some] @ before.T == 0
            links[i + some] = (near[some] & first) @ n
            linked[i : i + 512] = near
        some = np.flatnonzero(linked.any(axis=1))
        return pd.DataFrame({"a": rid[some], "b": rid[roots_of(linked)[some]], "links": links[some]})

    leaf = leaves.withColumn("leaf", F.xxhash64("node"))
    of = leaf.groupBy("rid").agg(F.collect_set("leaf").alias("leaves"))  # a few for each tree
    sizes = leaves.groupBy("node").agg(F.ceil(F.count("*") / F.lit(2 * LEAF)).cast("int").alias("chunks"))
    rows = beside(leaf.join(of, "rid"), sizes, "node").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("node", "leaf", "leaves", "rid", "vec", "n", "chunk", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"))
    cell = F.concat_ws("#", "node", "one", "two")  # one column, so that a leaf's blocks go to tasks of their own
    return rows.withColumn("cell", cell).groupBy("cell").applyInPandas(block, "a long, b long, links long")


def near_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; a null key is no component's name, and such a row is kept if it is alone."""
    bound_batches(df.sparkSession, 4096)
    known = unit_rows(df, vector, key, label)
    rows = materialise(known.withColumn("class", F.when(F.col("vec").isNotNull(), F.md5(F.concat(F.col("label").cast("binary"), F.lit("/").cast("binary"), F.col("vec"))))), "forest-rows")
    reps = rows.where("vec is not null").groupBy("class").agg(*(F.first(c).alias(c) for c in ("label", "dim", "vec")), F.min("rid").alias("rid"), F.count("*").alias("n"), F.min("key").alias("least"))
    reps = materialise(reps, "forest-reps")
    found = materialise(compare(plant(reps.drop("class", "least"), trees), cosine), "forest-links")
    links = found.groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("far"))
    roots = connected_components(found.where("a != b").select("a", "b").distinct(), "forest-links").withColumnRenamed("node", "rid")
    classes = reps.select("class", "rid", "n", "least").join(links, "rid", "left").join(roots, "rid", "left")
    classes = classes.select("class", "least", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"), F.coalesce("component", "rid").alias("root"))
    names = classes.groupBy("root").agg(F.min("least").alias("name"))
    classes = classes.join(names, "root").select("class", "links", "name")
    alone = rows.where("class is null").select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("name"))
    out = beside(rows.where("class is not null").select("rid", "key", "class"), classes, "class").select("key", "links", "name").unionByName(alone)
    component = F.coalesce("name", "key")
    return out.select(F.col("key").alias(key), F.col("links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, component.isNull()).alias("kept"))


#: The same rows by comparing all vectors of a label, by DuckDB.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
