"""Centroid clustering of whole-number vectors: kd-trees of parts of the rows filter the centroids."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stash, tidy

#: Rows of a tree at most, and rows of a leaf.
TREE_ROWS, LEAF = 8192, 32
#: Nodes whose candidates are judged at once.
NODES = 256
#: Components beyond it count as it: their squares are far beyond what a distance can say.
FARTHEST = 2**80
MOST_LONG = 2**63 - 1


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, as doubles that are whole numbers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * float(scale)), -float(FARTHEST), float(FARTHEST))


def _small(most: float, dim: int) -> bool:
    """Squares of doubled differences of numbers up to ``most``, summed over ``dim`` components, fit 64 bits."""
    return most < 2 ** ((62 - dim.bit_length()) // 2 - 2)


def exact(points: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers where squares of distances fit them, else as Python's integers."""
    if _small(np.abs(points).max(initial=0), points.shape[-1]):
        return points.astype(np.int64)
    return np.vectorize(int, otypes=[object])(points)


class Tree:
    """A kd-tree over rows: nodes are ranges of the rows in the tree's order, with their box; prefix sums give a node's sum.

    A node is halved in the middle of the order of its widest component; one of LEAF rows or without extent is a leaf.
    """

    def __init__(self, points: np.ndarray):
        order = np.arange(len(points))
        start, end, left, low, high = [], [], [], [], []
        todo = [(0, len(points))]
        while len(start) < len(todo):
            a, b = todo[len(start)]
            mine = points[order[a:b]]
            lo, hi = mine.min(axis=0), mine.max(axis=0)
            start.append(a)
            end.append(b)
            low.append(lo)
            high.append(hi)
            at = int((hi - lo).argmax())
            if b - a <= LEAF or lo[at] == hi[at]:
                left.append(-1)
                continue
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(mine[:, at], half)]
            left.append(len(todo))
            todo += [(a, a + half), (a + half, b)]
        self.order, self.points = order, points[order]
        self.start, self.end, self.left = (np.array(x, np.int64) for x in (start, end, left))
        self.low, self.high = np.array(low), np.array(high)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in ("points", "start", "end", "left", "low", "high")})
        return out.getvalue()

    @classmethod
    def unpack(cls, body: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(body)) as held:
            for k in held.files:
                setattr(tree, k, held[k])
        tree.points = exact(tree.points)
        kind = tree.points.dtype
        tree.low, tree.high = exact(tree.low).astype(kind), exact(tree.high).astype(kind)
        sums = np.zeros((len(tree.points) + 1, tree.points.shape[1]), kind)
        np.cumsum(tree.points, axis=0, out=sums[1:])
        tree.sums = sums[tree.end] - sums[tree.start]
        return tree

    def alike(self, centroids: list[list[int]]) -> np.ndarray:
        """The centroids in integers that hold their distances from the rows."""
        most = max((abs(x) for c in centroids for x in c), default=0)
        return np.array(centroids, self.points.dtype if _small(most, self.points.shape[1]) else object)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)


def assign(tree: Tree, centroids: list[list[int]], sums: bool = True) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
    """(number of the nearest centroid of each row, ties to the smaller; rows and sums by centroid unless not ``sums``).

    From the root down a node keeps the centroids that may be nearest to a row in its box: one that is farther than the
    one nearest to the middle from every corner goes. A node with one left, or without extent, is given away whole with
    its count and sum; rows of other leaves are compared with all that are left.
    """
    k = len(centroids)
    c = tree.alike(centroids)
    kind = c.dtype
    points, low_of, high_of = (x.astype(kind, copy=False) for x in (tree.points, tree.low, tree.high))
    label = np.zeros(len(points), np.int32)
    counts = np.zeros(k, np.int64)
    totals = np.zeros((k, points.shape[1]), object)
    waiting = [(np.zeros(1, np.int64), np.ones((1, k), bool))]
    while waiting:
        nodes, alive = waiting.pop()
        if len(nodes) > NODES:
            waiting += [(nodes[i : i + NODES], alive[i : i + NODES]) for i in range(0, len(nodes), NODES)]
            continue
        low, high = low_of[nodes], high_of[nodes]
        far = _squares(2 * c[None] - (low + high)[:, None])
        worst = far.max()
        best = np.where(alive, far, worst + 1).argmin(axis=1)
        mine = c[best][:, None]
        corner = np.where(c[None] > mine, high[:, None], low[:, None])
        alive = alive & (_squares(c[None] - corner) <= _squares(mine - corner))
        point = (low == high).all(axis=1)
        if point.any():
            near = _squares(c[None] - low[point][:, None])
            best[point] = near.argmin(axis=1)
        done = point | (alive.sum(axis=1) == 1)
        for n, z in zip(nodes[done], best[done], strict=True):
            label[tree.start[n] : tree.end[n]] = z
            counts[z] += tree.end[n] - tree.start[n]
            if sums:
                totals[z] += tree.sums[n]
        open_ = ~done
        leaf = open_ & (tree.left[nodes] < 0)
        for n, held in zip(nodes[leaf], alive[leaf], strict=True):
            some = np.flatnonzero(held)
            a, b = tree.start[n], tree.end[n]
            z = some[_squares(points[a:b, None] - c[some][None]).argmin(axis=1)]
            label[a:b] = z
            if sums:
                for one in np.unique(z):
                    counts[one] += int((z == one).sum())
                    totals[one] += points[a:b][z == one].sum(axis=0)
        inner = open_ & ~leaf
        if inner.any():
            down = tree.left[nodes[inner]]
            waiting.append((np.concatenate([down, down + 1]), np.concatenate([alive[inner], alive[inner]])))
    return label, [int(n) for n in counts], [[int(x) for x in row] for row in totals]


def _finite(vector: str, dim: int):
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & sound, F.lit(False))


def grow(df: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(keys, tree): the kept rows of ``df`` in trees of TREE_ROWS rows at most, none across two partitions."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = 0

        def planted(ids: list, rows: np.ndarray) -> pa.RecordBatch:
            tree = Tree(whole(rows, scale))
            return pa.RecordBatch.from_arrays([pa.array([[ids[i] for i in tree.order]], pa.list_(pa.int64())), pa.array([tree.pack()], pa.binary())], ["keys", "tree"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys += batch.column(0).to_pylist()
            held.append(np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dim))
            n += batch.num_rows
            if n >= TREE_ROWS:
                rows = np.concatenate(held)
                whole_trees = n - n % TREE_ROWS
                for i in range(0, whole_trees, TREE_ROWS):
                    yield planted(keys[i : i + TREE_ROWS], rows[i : i + TREE_ROWS])
                keys, held, n = keys[whole_trees:], [rows[whole_trees:]], n - whole_trees
        if n:
            yield planted(keys, np.concatenate(held))

    rows = df.where(_finite(vector, dim)).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    return rows.mapInArrow(tidy(build), "keys array<long>, tree binary")


def _trees(batches: Iterator) -> Iterator[tuple[list, Tree]]:
    for batch in batches:
        for keys, body in zip(batch.column(0), batch.column(1), strict=True):
            yield keys.as_py(), Tree.unpack(body.as_py())


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, salt: str = "1:") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that is kept.

    Kept are vectors of exactly ``dim`` components, none null or non-finite, of any row: repeated rows count each, rows
    with a null key take part but are seeds after all others. Components become floor(scale * x). The first centroids are the
    ``k`` rows least by SHA-256 of ``salt`` and the key (ties: by the vector); fewer rows give fewer clusters, no row gives
    none. In each round all rows go to the nearest centroid (squared distance, ties to the smaller number), and each
    centroid with rows becomes the floor of their mean. Distances and inertias beyond a long are the largest long. Further
    columns are ignored.

    Rows lie in trees of bounded size that are written once and read in each round; a task adds up its trees, so that it
    sends k counts and sums, and the driver sees k * dim numbers. Many equal vectors are one node.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.where(_finite(vector, dim))
    named = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    first = rows.select(F.col(vector).cast("array<double>").alias("v"), named.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    schema = "keys array<long>, tree binary"
    trees = stash(grow(df, key, vector, dim, scale), "kd-trees")
    centroids = [[int(x) for x in whole(np.array(r["v"], np.float64), scale)] for r in first]

    def summed(now: list[list[int]]):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            counts, totals = [0] * len(now), [[0] * dim for _ in now]
            for _, tree in _trees(batches):
                _, n, s = assign(tree, now)
                for z, held in enumerate(n):
                    if held:
                        counts[z] += held
                        totals[z] = [a + b for a, b in zip(totals[z], s[z], strict=True)]
            full = [z for z, n in enumerate(counts) if n]
            sums = pa.array([[Decimal(x) for x in totals[z]] for z in full], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([counts[z] for z in full], pa.int64()), sums], ["cluster", "n", "sums"])

        return run

    for _ in range(rounds if centroids else 0):
        parts = trees.mapInArrow(tidy(summed(centroids)), "cluster int, n long, sums array<decimal(38,0)>")
        by_dim = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x")).cast("decimal(38,0)").alias("x"))
        following = [list(c) for c in centroids]
        for r in by_dim.collect():  # k * dim rows at most
            following[r["cluster"]][r["at"]] = int(r["x"]) // r["n"]
        centroids = following

    last = centroids

    def label(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for keys, tree in _trees(batches):
            near, _, _ = assign(tree, last, sums=False)
            own = tree.alike(last)
            far = [min(int(x), MOST_LONG) for x in _squares(tree.points.astype(own.dtype, copy=False) - own[near])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(near, pa.int32()), pa.array(far, pa.int64())], ["key", "cluster", "distance"])

    out = stash(trees.mapInArrow(tidy(label), "key long, cluster int, distance long"), "kd-labels")
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(inertia.values()), MOST_LONG)
    facts = [(z, min(s, MOST_LONG), hashlib.sha256(",".join(map(str, last[z])).encode()).hexdigest()) for z, s in inertia.items()]
    named_by = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = out.join(F.broadcast(named_by), "cluster")  # k rows at most
    return out.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def op11_kd_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _op11_sql(rounds: int = 3) -> str:
    """The rounds one after another: a<r> assigns to the centroids c<r-1>, c<r> are the floors of the means."""
    far = "list_sum(list_transform(list_zip(v.p, c.p), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    parts = [
        "v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS p FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS (SELECT z, p FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS z, p FROM v) WHERE z < 16)",
    ]
    for r in range(1, rounds + 2):
        parts.append(f"a{r} AS (SELECT vec_id, p, z, d FROM (SELECT v.vec_id, v.p, c.z, {far} AS d, row_number() OVER (PARTITION BY v.vec_id ORDER BY {far}, c.z) AS nth FROM v, c{r - 1} c) WHERE nth = 1)")
        if r <= rounds:
            parts.append(f"s{r} AS (SELECT z, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT z, unnest(p) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY z, i)")
            parts.append(f"m{r} AS (SELECT z, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM s{r} GROUP BY z)")
            parts.append(f"c{r} AS (SELECT c.z, coalesce(m.p, c.p) AS p FROM c{r - 1} c LEFT JOIN m{r} m ON c.z = m.z)")
    last = f"a{rounds + 1}"
    return "WITH " + ",\n".join(parts) + (
        f"\nSELECT a.vec_id, CAST(a.z AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.z) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM {last} a JOIN c{rounds} c ON a.z = c.z"
    )


OP11_SQL = _op11_sql()
