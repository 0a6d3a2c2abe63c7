"""Clustering by kd-tree filtering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k, rounds, dim, scale=64, salt="1:"):
    """What the contract says, in Python's integers."""
    kept = [(i, [min(max(math.floor(scale * x), -(2**80)), 2**80) for x in v], v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    h = lambda i: "~" if i is None else hashlib.sha256(f"{salt}{i}".encode()).hexdigest()
    c = [p for _, p, _ in sorted(kept, key=lambda r: (h(r[0]), r[2]))[:k]]
    far = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    near = lambda p: min(range(len(c)), key=lambda z: (far(p, c[z]), z))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, p, _ in kept:
            own[near(p)].append(p)
        c = [[sum(col) // len(o) for col in zip(*o, strict=True)] if o else old for o, old in zip(own, c, strict=True)]
    top = 2**63 - 1
    found = [(i, z := near(p), min(far(p, c[z]), top)) for i, p, _ in kept]
    inertia = {z: sum(d for _, w, d in found if w == z) for z in {z for _, z, _ in found}}
    total = min(sum(inertia.values()), top)
    return sorted((repr(i), z, d, min(inertia[z], top), total, hashlib.sha256(",".join(map(str, c[z])).encode()).hexdigest()) for i, z, d in found)


def found(df, **more):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, **more).collect())


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "own") for i, v in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("dim", "k", "seed"), [(2, 5, 1), (3, 16, 2), (64, 4, 3)])
def test_equals_plain(spark, monkeypatch, dim, k, seed):
    """Small trees, ties on a coarse lattice, groups of equal vectors."""
    monkeypatch.setattr(centroids, "TREE_ROWS", 90)
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-8, 8) / (64 if dim > 2 else 1) for _ in range(dim)]) for i in range(400)]
    rows += [(400 + i, [0.25] * dim) for i in range(150)]
    assert found(table(spark, rows), k=k, dim=dim) == plain(rows, k, 3, dim)


def test_odd_rows(spark):
    """Nulls anywhere, other lengths, non-finite and huge components, repeated and null keys, fewer rows than clusters."""
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (1, [2.0, 1.0]), (None, [9.0, 9.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 0.0]), (7, []), (8, [1e300, -3.0]), (9, [3e6, 3e6]), (10, [-0.001, 0.001])]
    df = table(spark, rows)
    assert found(df, dim=2) == plain(rows, 16, 3, 2)
    assert found(df, dim=2, k=2) == plain(rows, 2, 3, 2)
    assert found(df.where("vec_id in (2, 5)"), dim=2) == []
    assert found(df.limit(0), dim=2) == []


def test_wide_and_narrow_trees_together(spark):
    """One tree of small components, one of huge ones, with common centroids."""
    rows = [(i, [i / 64, 1.0]) for i in range(40)]
    far = [(100 + i, [1e9 + i, -1e12]) for i in range(40)]
    both = table(spark, rows, 1).unionByName(table(spark, far, 1))
    assert found(both, dim=2, k=6) == plain(rows + far, 6, 3, 2)


def test_only_dominated_centroids_go():
    """Filtering gives the labels of all comparisons, and gives most of separate groups away whole."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-50, 50, (500, 4)) + 10_000 * g for g in range(3)]).astype(float)
    tree = centroids.Tree.unpack(centroids.Tree(points).pack())
    cs = [[10_000 * g + s] * 4 for g in range(3) for s in (-3, 3)] + [[10**7] * 4]
    label, counts, sums = centroids.assign(tree, cs)
    far = ((tree.points[:, None] - np.array(cs)[None]) ** 2).sum(-1)
    assert (label == far.argmin(1)).all()
    assert counts == np.bincount(label, minlength=7).tolist()
    assert sums == [tree.points[label == z].sum(0).tolist() for z in range(7)]


def test_bytes_do_not_depend_on_partitions(spark):
    rows = [(i, [math.sin(i), math.cos(3 * i), i % 7 / 5]) for i in range(300)]
    one = found(table(spark, rows, 1), dim=3)
    assert one == found(table(spark, rows, 7), dim=3)
    assert one == found(table(spark, rows).withColumn("distance", F.lit(1)), dim=3)
