"""Embedding near-dedup by collision-counting projections.

Every vector is projected on many axes. Each projection of a block of vectors is sorted, and around the value of every
query lies a window; a pair collides on a projection where one is in the window of the other. Pairs that collide on as many
projections as the calibrated count are verified in double precision. Counts are kept for a query against 64 vectors at a
time: a window of a sorted list is the difference of two of its prefixes, each a bitmap, and bitmaps are added bitwise.

The windows of one projection hold about half of all vectors where vectors are spread evenly, so no single list can leave
pairs out: each pair of blocks is one piece of work, whose pairs below the count never leave it. The work grows with the
square of the number of vectors, at a few nanoseconds a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, components, hot_rows, join_one, stash, width

#: Most projections, windows' half width in standard deviations of a pair at the threshold, and its chance to be missed.
AXES, WIDE, MISS = 64, 2.0, 1e-6
#: Vectors of a block, and bytes of its doubles.
BLOCK, BLOCK_BYTES = 32_768, 32 << 20
#: Queries and vectors compared at once, and prefixes kept of a sorted list.
QUERIES, TILE, STEPS = 512, 4096, 64
#: Most partitions that pieces of work are dealt to; beyond, a partition has several, one after another.
MAX_PARTS = 10_000


@lru_cache
def rotation(dim: int) -> np.ndarray:
    """``dim`` x axes with orthonormal columns, drawn from a fixed seed."""
    q, _ = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return np.ascontiguousarray(q[:, :AXES])


@dataclass(frozen=True)
class Plan:
    """Half width of the windows, collisions that a pair must reach, and the threshold."""

    half: float
    count: int
    cosine: float


def calibrate(dim: int, cosine: float) -> Plan:
    """Windows and count for the recall wanted of pairs at ``cosine`` or above.

    Two unit vectors at the threshold lie sqrt(2 - 2 * cosine) apart. Where all axes of a rotation are projections, the
    squares of a pair's distances on them add up to the square of that, so fewer than dim / WIDE**2 can pass the
    half width: the count then misses no pair at all. Of more dimensions AXES random axes are taken and the count
    is that below which a pair falls with MISS (binomial; orthogonal axes vary less).
    """
    half = WIDE * math.sqrt(max(0.0, 2 - 2 * cosine) / dim) + 1e-9
    if dim <= AXES:
        return Plan(half, dim - (math.ceil(dim / WIDE**2) - 1), cosine)
    inside, tail, count = math.erf(WIDE / math.sqrt(2)), 0.0, 0
    while count < AXES:
        tail += math.comb(AXES, count) * inside**count * (1 - inside) ** (AXES - count)
        if tail > MISS:
            break
        count += 1
    return Plan(half, count, cosine)


def _vectors(raws: list[bytes], wire: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, vectors) of each dimension among the packed vectors."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([raws[i] for i in at]), wire).astype(np.float64).reshape(len(at), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _packed(df: DataFrame, key: str, vector: str, wire: str) -> DataFrame:
    """(key, raw): the vector as bytes of its floats, null where it can link with nothing."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raws: list[bytes | None] = []
            for x in batch.column(1):
                v = x.values.to_numpy(zero_copy_only=False).astype(wire) if x.is_valid and len(x.values) and not x.values.null_count else None
                raws.append(v.tobytes() if v is not None and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary())], ["key", "raw"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(vector)).mapInArrow(run, "key long, raw binary")


class Lists:
    """The sorted projections of a tile of vectors, and bitmaps of their prefixes."""

    def __init__(self, near: np.ndarray):
        n, axes = near.shape
        self.step = -(-n // STEPS)
        order = np.argsort(near, axis=0, kind="stable")
        self.sorted = np.take_along_axis(near, order, axis=0).T.copy()
        rank = np.full((axes, -(-n // 64) * 64), n, np.int32)
        np.put_along_axis(rank, order.T, np.arange(n, dtype=np.int32)[None, :], axis=1)
        to = np.arange(STEPS + 1, dtype=np.int32)[:, None] * self.step
        self.prefixes = [np.packbits(rank[p] < np.minimum(to, n), axis=1, bitorder="little").view("<u8") for p in range(axes)]
        self.low, self.high = self.sorted[:, 0], self.sorted[:, -1]

    def reach(self, near: np.ndarray, plan: Plan) -> np.ndarray:
        """(queries x words) bitmap of the vectors that collide with each query on ``plan.count`` projections or more.

        Windows are widened to whole steps of the list, so that they hold all that is near and little else.
        """
        planes: list[np.ndarray] = []
        waiting: list[np.ndarray | None] = []

        def add(bits: np.ndarray, level: int) -> None:
            """Carry-save addition: two bitmaps and a plane give a plane and one carry."""
            if level == len(planes):
                planes.append(np.zeros_like(bits))
                waiting.append(None)
            other, waiting[level] = waiting[level], None
            if other is None:
                waiting[level] = bits
                return
            odd = planes[level] ^ other
            carry = planes[level] & other
            carry |= odd & bits
            planes[level] = odd ^ bits
            add(carry, level + 1)

        for p, values in enumerate(self.sorted):
            first = np.searchsorted(values, near[:, p] - plan.half, "left") // self.step
            last = -(-np.searchsorted(values, near[:, p] + plan.half, "right") // self.step)
            hits = self.prefixes[p][last]
            hits ^= self.prefixes[p][first]
            add(hits, 0)
        level = 0
        while level < len(planes):
            left, waiting[level] = waiting[level], None
            if left is not None:
                carry = planes[level] & left
                planes[level] = planes[level] ^ left
                if level + 1 < len(self.sorted).bit_length():  # a sum has no higher digit
                    add(carry, level + 1)
            level += 1
        above, equal = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
        for level in reversed(range(max(len(planes), plan.count.bit_length()))):
            plane = planes[level] if level < len(planes) else np.zeros_like(above)
            if plan.count >> level & 1:
                equal &= plane
            else:
                above |= equal & plane
                equal &= ~plane
        return above | equal


def _pairs(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of each bit."""
    q, word = np.nonzero(reach)
    hit, bit = np.nonzero(np.unpackbits(reach[q, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return q[hit], word[hit] * 64 + bit


class Forest:
    """A label for each of n rows; links join labels, and those that joined two are kept."""

    def __init__(self, n: int):
        self.labels, self.links = np.arange(n), []

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        p, q = self.labels[x], self.labels[y]
        live = np.flatnonzero(p != q)
        if not len(live):
            return
        _, first = np.unique(np.minimum(p, q)[live] * len(self.labels) + np.maximum(p, q)[live], return_index=True)
        live = live[first]
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := parent.get(i, i)) != i:
                parent[i] = parent.get(up, up)
                i = up
            return i

        for i, a, b in zip(live.tolist(), p[live].tolist(), q[live].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                self.links.append((int(x[i]), int(y[i])))
        to = np.arange(len(self.labels))
        to[list(parent)] = [root(i) for i in parent]
        self.labels = to[self.labels]


def count_block(unit: np.ndarray, queries: int, times: np.ndarray, plan: Plan) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each row, a spanning forest of the links) between the first ``queries`` rows and the others.

    With no other rows the pairs are those among the queries. Rows are laid in the order of their sides on the first
    projections, and tiles whose ranges cannot collide often enough are passed over.
    """
    near = unit @ rotation(unit.shape[1])
    code = (near[:, :16] > 0) @ (1 << np.arange(min(16, near.shape[1])))
    own = queries == len(unit)
    left = np.argsort(code[:queries], kind="stable")
    right = left if own else queries + np.argsort(code[queries:], kind="stable")
    links, forest = np.zeros(len(unit), np.int64), Forest(len(unit))
    for at in range(0, len(right), TILE):
        some = right[at : at + TILE]
        lists = Lists(near[some])
        for begin in range(0, min(len(left), at + TILE) if own else len(left), QUERIES):
            asked = left[begin : begin + QUERIES]
            mine = near[asked]
            apart = (lists.low > mine.max(axis=0) + plan.half) | (lists.high < mine.min(axis=0) - plan.half)
            if near.shape[1] - apart.sum() < plan.count:
                continue
            x, y = _pairs(lists.reach(mine, plan))
            if own:
                once = begin + x < at + y
                x, y = x[once], y[once]
            if not len(x):
                continue
            x, y = asked[x], some[y]
            if len(x) * 16 > len(asked) * len(some):  # most of a tile of near copies: all products at once
                where = np.zeros(len(unit), np.int64)
                where[asked] = np.arange(len(asked))
                place = np.zeros(len(unit), np.int64)
                place[some] = np.arange(len(some))
                cosines = (unit[asked] @ unit[some].T)[where[x], place[y]]
                close = np.flatnonzero(np.abs(cosines - plan.cosine) < 1e-9)
                cosines[close] = np.einsum("ij,ij->i", unit[x[close]], unit[y[close]])
            else:
                cosines = np.concatenate([np.einsum("ij,ij->i", unit[x[i : i + 65536]], unit[y[i : i + 65536]]) for i in range(0, len(x), 65536)])
            x, y = x[cosines >= plan.cosine], y[cosines >= plan.cosine]
            links += np.bincount(x, times[y], len(unit)).astype(np.int64) + np.bincount(y, times[x], len(unit)).astype(np.int64)
            forest.join(x, y)
    return links, forest.links


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``df``.

    Two rows link if the cosine of their vectors, in double precision, is ``cosine`` or more. Null, empty, zero and
    non-finite vectors, such with null components and rows with a null key link with nothing; vectors of different
    dimensions do not link, and each dimension has windows and a count of its own. component_id is the smallest key
    reachable (null for a null key, which is kept), n_links the other rows linked directly. Links below the threshold
    never come; up to AXES dimensions none is missed, beyond them one at the threshold with MISS. An empty table gives
    none; further columns are ignored.

    Equal vectors are one class with a multiplicity. Classes are dealt to blocks by a hash, so no vector, however many are
    like it, makes a block larger. Each two blocks are counted in one piece of work of bounded memory, which gives
    numbers of links and a spanning forest, not rows per pair.
    """
    bounded_batches(df.sparkSession)
    wire = "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    vectors = stash(_packed(df, key, vector, wire), "vectors")
    real = vectors.where(F.col("key").isNotNull() & F.col("raw").isNotNull())
    classes = stash(real.groupBy("raw").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("times")), "vector-classes")
    by_dim = classes.groupBy((F.octet_length("raw") / int(wire[2])).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    plans, blocks, base, works = {}, {}, {}, 0
    spread = math.ceil(math.sqrt(2 * width(df.sparkSession)))
    for r in by_dim.where("n > 1").collect():  # a class alone in its dimension links with no other
        dim, n = r["dim"], r["n"]
        plans[dim] = calibrate(dim, cosine)
        b = max(-(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))), min(spread, -(-n // 1024)))
        blocks[dim], base[dim] = b, works
        works += b * (b + 1) // 2
    parts = max(1, min(works, MAX_PARTS))
    dim = (F.octet_length("raw") / int(wire[2])).cast("int")

    def deal() -> DataFrame:
        """(work, side, rep, times, raw): a class for each piece of work of its block."""
        rows = classes.withColumn("dim", dim)
        facts = [F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (blocks, base)]
        rows = rows.withColumns({"of": facts[0][F.col("dim")], "base": facts[1][F.col("dim")].cast("long")}).where("of is not null")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", "raw"), "of")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        work = F.col("base") + F.call_function("div", high * (high + 1), F.lit(2)) + low
        return rows.select(work.cast("long").alias("work"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "times", "raw")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def said(held: list) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            reps, times = np.asarray(table["rep"]), np.asarray(table["times"])
            _, v = next(_vectors(table["raw"].to_pylist(), wire))
            queries = int((np.asarray(table["side"]) == 0).sum())
            links, edges = count_block(_unit(v), queries, times, plans[v.shape[1]])
            hit = np.flatnonzero(links)
            e = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(reps[hit]), pa.array(reps[e[:, 0]])]), pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(reps[e[:, 1]])]), pa.concat_arrays([pa.array(links[hit]), pa.nulls(len(e), pa.int64())])], ["a", "b", "links"])

        held: list = []
        for batch in batches:
            work = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(work[1:] != work[:-1]) + 1).tolist(), len(work)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and a < b and held[-1].column(0)[0].as_py() != work[a]:
                    yield said(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield said(held)

    if works:
        dealt = deal().repartitionById(parts, F.pmod(F.col("work"), F.lit(parts)).cast("int")).sortWithinPartitions("work", "side", "rep", "raw")
        found = stash(dealt.mapInArrow(count, "a long, b long, links long"), "vector-links")
    else:
        found = df.sparkSession.createDataFrame([], "a long, b long, links long")
    links = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    edges = found.where("b is not null").select("a", "b")
    parts_of = components(edges, "vector-components")
    of_class = classes.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(parts_of.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("raw", "times", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    live = F.col("key").isNotNull()
    linked = live & F.col("raw").isNotNull()
    out = join_one(vectors.where(linked), of_class, ["raw"], "times", hot_rows(vectors.count()))
    none = F.lit(None).cast("long")
    out = out.unionByName(vectors.where(~linked).withColumns({"links": none, "component": none}))
    component = F.when(live, F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), F.when(live, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept"))


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, least(e.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id <= coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id) AS kept
FROM embeddings e
"""
