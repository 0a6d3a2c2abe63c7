"""Keys with many rows, rules that tie, long pages: cases that the operators' other tests leave out."""

import random

import pytest
from pyspark.sql import functions as F

from meshframe.llm import common, minhash, projections, sharding, url_filter, warc


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 20)


def test_join_one(spark, few):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = rows.groupBy("k").agg(F.max("v").alias("m"), F.count(F.lit(1)).alias("n"))
    out = common.join_one(rows, one, ["k"], "n", common.hot_rows(3000))
    assert out.columns == ["k", "v", "m"] and out.count() == 3000 and out.where("k = 7 and m = 2499").count() == 2500
    assert out.where("k <> 7 and m <> v").count() == 0
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in p
    assert common.hot_rows(10**9) == 10**4


def test_components_with_hubs(spark, few):
    """Stars, chains and a ring around hubs with many edges, against a plain walk."""
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)] + [(640, 520), (900, 901), (901, 902), (902, 900)]
    edges += [(399, 1000)] + [(1000, i) for i in range(1001, 1200)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = {n for e in edges for n in e}
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in nodes}


def test_one_group_of_most_rows(spark, few):
    """Exact copies, blanks and null keys are most of a table: near duplicates and vectors keep their results."""
    texts = [(i, "one two three four five six seven") for i in range(300)] + [(400 + i, None if i % 2 else "") for i in range(200)] + [(None, "one two three four five six seven")] * 40 + [(700 + i, f"w{i} a b c d e f") for i in range(20)]
    out = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(out) == len(texts)
    assert {r.component_id for r in out if r.doc_id is not None and r.doc_id < 300} == {0}
    assert all(r.component_id == r.doc_id and r.kept for r in out if r.doc_id is not None and r.doc_id >= 400) and all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    vectors = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(400 + i, None) for i in range(100)] + [(None, [1.0, 2.0, 3.0])] * 30 + [(600, [-1.0, 0.5, 0.0])]
    got = projections.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(vectors) and {(r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 300} == {(299, 0)}
    assert all(r.n_links == 0 for r in got if r.vec_id is None or r.vec_id >= 400)


def test_a_large_group_is_not_compared_with_itself(spark, monkeypatch):
    """Near copies in one component go to blocks of what lies beside them in their buckets, not to all blocks of the group."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]

    def other(places):
        return " ".join(f"x{rng.randrange(10**9)}" if p in places else w for p, w in enumerate(base))

    rows = [(i, other({99})) for i in range(300)] + [(1000 + i, other({15 + i, 40 + i, 60 + i, 80 + i})) for i in range(8)]
    blocks = []
    across = minhash._across
    monkeypatch.setattr(minhash, "_across", lambda df, *more: (blocks.append((df.count(), df.select("key").distinct().count())), across(df, *more))[1])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 300 else i for i, _ in rows}
    (dealt, buckets), = blocks
    assert 0 < dealt <= buckets * (300 + 8 * 17)  # every member in each of up to 16 blocks: ten times as many


def judged(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filter.judge(df, "url", spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string"))
    return [(r.rule, r.verdict) for r in out.orderBy("page_id").collect()]


def test_rules_that_tie_or_repeat(spark):
    """Of equal rules the lesser verdict counts; of rules with equal text the one with the longer host."""
    rules = [("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("a.org", "/x", "block"), ("b.org", "/", "block"), ("B.ORG", "/", "block"), ("c.org", "/y/", "allow"), ("c.org", "/y", "block")]
    urls = ["http://a.org/x1", "http://s.a.org/x", "http://a.org/y", "http://b.org/", "http://c.org/y/z", "http://c.org/yy"] * 3 + [None, "no url"]
    got = judged(spark, urls, rules)
    assert got == [("a.org/x", "allow"), ("a.org/x", "allow"), (None, "allow"), ("b.org/", "block"), ("c.org/y/", "allow"), ("c.org/y", "block")] * 3 + [(None, "allow")] * 2


def test_hosts_of_many_labels_and_paths_of_many_lengths(spark):
    host = ".".join(f"l{i}" for i in range(300)) + ".deep.org"
    rules = [("deep.org", "/", "block"), ("l299.deep.org", "/a", "allow")] + [("other.org", "/" + "p" * n, "block") for n in range(1, 400)]
    got = judged(spark, [f"http://{host}/b", f"http://{host}/ab", "http://other.org/" + "p" * 250 + "q", "http://other.org/q", "http://" + "x." * 400 + "net/"], rules)
    assert got == [("deep.org/", "block"), ("l299.deep.org/a", "allow"), ("other.org/" + "p" * 250, "block"), (None, "allow"), (None, "allow")]


def test_pages_longer_than_a_batch(spark, monkeypatch):
    """A page above the bytes of an Arrow batch, its copy, and small ones beside it come back whole."""
    long = "<p>" + "lorem ipsum é " * 700_000
    rows = [(1, "http://a/", "<p>small</p>"), (2, "http://b/", long), (3, "http://c/", long), (None, "http://d/", None), (4, None, "x" * 100), (4, None, "x" * 100)]
    assert len(long.encode()) > common.BATCH_BYTES
    folder = common.fresh_path(spark, "test-warc")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.read_warc(warc.write_warc(df, folder), folder).collect()
    found = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in back), key=repr)
    n = len(long.encode())
    assert found == sorted([(1, 12, "response", None), (2, n, "response", None), (3, n, "revisit", 2), (None, 0, "response", None), (4, 100, "response", None), (4, 100, "revisit", 4)], key=repr)


def test_shards_numbered_in_more_slices(spark, monkeypatch):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    one = {r.doc_id: (r["shard"], r.grown_shard) for r in sharding.shard(df, "doc_id", [1.0, 2.0], [1.0, 2.0, 1.0]).collect()}
    monkeypatch.setattr(sharding, "SLICE_ROWS", 4)
    rows = sharding.shard(df, "doc_id", [1.0, 2.0], [1.0, 2.0, 1.0]).collect()
    assert {r.doc_id: (r["shard"], r.grown_shard) for r in rows} == one and all(g in (s, 2) for s, g in one.values())
    for s in (0, 1):
        mine = sorted(r.slot for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine))) and mine
    other = {r.doc_id: r.grown_shard for r in sharding.shard(df, "doc_id", [1.0, 2.0], [3.0, 1.0]).collect()}
    assert other == {r.doc_id: r.s for r in df.select("doc_id", sharding.rendezvous(F.col("doc_id"), [3.0, 1.0]).alias("s")).collect()}
