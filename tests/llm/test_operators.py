import gc
import hashlib
import math
import random
import sys
import zlib
from pathlib import Path
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from meshframe.llm import common, files, minhash, mixing, packing, projections, quality, ranges, sharding, sstable, substrings, tokens, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def corpus(seed=1):
    """Prose with exact and near copies, a shared passage, repeats inside, nulls, blanks and a very long text."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    texts = [base] * 12
    for _ in range(25):
        w = base.split(" ")
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, rng.randrange(5, 80))} {passage} {prose(rng, rng.randrange(0, 80))}" for _ in range(30)]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(30)]
    texts += [None, "", " \n\t ", "One", "one", "ONE two", "one two", "é è ß \u00a0x", "a\x0bb\x0cc", prose(rng, 6000), (base + " ") * 2]
    texts += ["again and " * 60, "<|endoftext|> it's ΣΑΣ ﬁ 12\u0301", "\n".join(["same line here."] * 5)]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def odd_ids(spark):
    """Null and repeated ids, equal rows, and columns whose names the operators use."""
    data = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 2), (None, None, 3), (2, "", 4), (2, "z y x", 5)]
    return spark.createDataFrame(data, "doc_id long, text string, kept int").withColumns({c: F.lit("own") for c in ("shard", "size", "n_words", "key", "host", "verdict", "rep", "raw", "component_id")}).withColumn("source", F.lit(None).cast("string"))


# 1


def brute_vectors(rows, cosine=0.9):
    good = {i: np.array(v, float) / max(map(abs, v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = good[a], good[b]
            if len(p) == len(q) and p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= cosine:
                links.append((a, b))
    root = brute.roots([i for i, _ in rows], links)
    count = dict.fromkeys(root, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return sorted((i, count[i], root[i], root[i] == i) for i in root)


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(16) for _ in range(60)]
    out += [out[0] + 0.05 * rng.standard_normal(16) for _ in range(90)] + [out[1] * 2.0] * 5 + [out[2] + 0.12 * rng.standard_normal(16) for _ in range(20)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-200] * 16, [1e200] * 16]
    return rows + [(n + i, v) for i, v in enumerate(odd)]


def test_vectors(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("raw", F.lit(1))
    want = brute_vectors(rows)
    assert sorted(map(tuple, projections.near_duplicates(df).collect())) == want
    monkeypatch.setattr(projections, "BLOCK", 16)
    assert sorted(map(tuple, projections.near_duplicates(df).collect())) == want


def test_vectors_of_several_dimensions(spark):
    """Short vectors link beside long ones, near pairs and parallel ones, and a stray long one changes nothing."""
    rng, out = np.random.default_rng(8), []
    for dim in (2, 8, 24, 32, 64):
        for _ in range(30):
            x, z = rng.standard_normal((2, dim))
            z -= z @ x / (x @ x) * x
            c = rng.uniform(0.905, 0.99)
            out += [x, c * x / np.linalg.norm(x) + math.sqrt(1 - c * c) * z / np.linalg.norm(z), 3 * x]
    out += [rng.standard_normal(768), np.array([3.0])]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, projections.near_duplicates(df).collect())) == brute_vectors(rows)


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 16, 64, 200])
def test_count_misses_no_pair_at_the_threshold(dim):
    rng, plan = np.random.default_rng(dim), projections.calibrate(dim, 0.9)
    x, z = rng.standard_normal((2, 20000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300) if dim > 1 else x
    axes = projections.rotation(dim)
    assert ((np.abs(x @ axes - y @ axes) <= plan.half).sum(axis=1) >= plan.count).all()


@pytest.mark.parametrize("tile,queries", [(64, 7), (100, 50), (4096, 512)])
def test_collisions_are_counted(monkeypatch, tile, queries):
    """Every pair of rows that collides often enough is reached, few others, in tiles of any size."""
    monkeypatch.setattr(projections, "TILE", tile)
    monkeypatch.setattr(projections, "QUERIES", queries)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 24))
    v[100:200] = v[0] + 0.15 * rng.standard_normal((100, 24))
    unit, plan = projections._unit(v), projections.calibrate(24, 0.9)
    near = unit @ projections.rotation(24)
    lists = projections.Lists(near[:tile])
    x, y = projections._pairs(lists.reach(near, plan))
    want = (np.abs(near[:, None] - near[None, :tile]) <= plan.half).sum(axis=2) >= plan.count
    got = np.zeros(want.shape, bool)
    got[x, y] = True
    assert (got >= want).all() and got.sum() < 1.3 * want.sum()
    times = np.arange(1, 301)
    true = unit @ unit.T >= 0.9
    np.fill_diagonal(true, False)
    links, edges = projections.count_block(unit, 300, times, plan)
    assert links.tolist() == (true @ times).tolist()
    assert brute.roots(range(300), edges) == brute.roots(range(300), list(zip(*np.nonzero(true))))
    links, edges = projections.count_block(unit, 130, times, plan)
    true[:130, :130] = true[130:, 130:] = False
    assert links.tolist() == (true @ times).tolist()
    assert brute.roots(range(300), edges) == brute.roots(range(300), list(zip(*np.nonzero(true))))


def test_vectors_ties_and_nothing(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (8, None)], "vec_id long, embedding array<float>")
    out = sorted(map(tuple, projections.near_duplicates(df).collect()), key=str)
    assert out == sorted([(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (None, 0, None, True), (8, 0, 8, True)], key=str)
    assert projections.near_duplicates(df.limit(0)).count() == 0


# 2


def test_targets_follow_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 1, "é": 70, None: 300}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    order = sorted((s for s in sizes if s), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = brute.water_fill(sizes, weights, 1.5, 2.0)
    for r in mixing.targets(df).collect():
        assert r.target == pytest.approx(want[r.source], rel=1e-9) and r.weight == weights[r.source]


def test_mix(spark, monkeypatch):
    rng = random.Random(5)
    data = [(i, rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "a", "b", "c", "d", None])) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, size long, source string")
    for leaf, fanout in ((256, 128), (8, 4)):
        monkeypatch.setattr(mixing, "LEAF", leaf)
        monkeypatch.setattr(mixing, "FANOUT", fanout)
        out = mixing.mix(df, ["doc_id"]).collect()
        assert sorted(r.doc_id for r in out) == list(range(3000))
        assert sorted(out, key=str) == sorted(mixing.mix(df.repartition(7), ["doc_id"]).collect(), key=str)
        for part in brute.by_key(out, lambda r: r.source).values():
            assert abs(sum(r.size * r.copies for r in part) - part[0].target) <= 150
            assert sum(r.size for r in part) == part[0].source_size and all(0 <= r.copies <= 2 for r in part)


def test_mix_draws_are_fair(spark):
    df = spark.createDataFrame([(i, 1 + i % 50, "ab"[i % 2]) for i in range(400)], "doc_id long, size long, source string")
    share = {r["source"]: r["target"] / r["source_size"] for r in mixing.targets(df).collect()}
    total = dict.fromkeys("ab", 0)
    for seed in range(8):
        for r in mixing.mix(df, ["doc_id"], seed=seed).collect():
            total[r.source] += r.copies
    for s in "ab":
        assert total[s] / (8 * 200) == pytest.approx(share[s], abs=0.05)


def test_mix_edges(spark):
    assert mixing.mix(empty(spark).withColumn("size", F.lit(1)), ["doc_id"]).count() == 0
    assert mixing.mix(odd_ids(spark).drop("size").withColumn("size", F.lit(None).cast("long")), ["doc_id"]).count() == 6


def test_mix_is_that_of_plain_rounding(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FANOUT", 4)
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 5, 60, 900]) + rng.randrange(9), "aab"[rng.randrange(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, size long, source string")
    out = mixing.mix(df, ["doc_id"], share=0.9).collect()
    targets = {r.source: r.target for r in out}
    sizes = {s: sum(r[1] for r in rows if r[2] == s) for s in "ab"}
    assert all(abs(targets[s] - t) < 1e-6 for s, t in brute.water_fill(sizes, {"a": 5.0, "b": 2.0}, 0.9, 2.0).items())
    want = brute.pivotal([(i, 0, n, s) for i, n, s in rows], targets, 8, 4, 17)
    assert {(r.doc_id, 0, r.source): r.copies for r in out} == want


def test_mix_of_equal_rows(spark, monkeypatch):
    """Equal rows, here with null ids, are dealt apart: no leaf has them all, and the source meets its target."""
    monkeypatch.setattr(mixing, "RUN", 100)
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(7).alias("size"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix(df, ["doc_id"], weights=(5.0, 3.0), share=0.9).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.max("target").alias("t"), F.count("*").alias("rows")).collect()
    assert all(abs(r.n - r.t) <= 7 and r.rows == 2500 for r in out) and len(out) == 2


# 3


def test_warc(spark):
    big, other = "x" * 200, "é" * 300
    data = [(3, "u", big), (1, "u\r\nv", big), (1, "u", big), (None, "u", big), (5, None, None), (6, "a", "y"), (7, "a", "y"), (9, "b", other), (11, "b", other), (10, "c", "z" * 100), (12, "c", "z" * 99)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("kind", F.lit("own"))
    folder = common.fresh_path(spark, "test-warc")
    manifest = warc.write_warc(df, folder, roll=300, target=600)
    again = warc.write_warc(df.repartition(5), common.fresh_path(spark, "test-warc"), roll=300, target=600)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect()))
    got = sorted(map(tuple, warc.read_warc(manifest, folder).collect()), key=str)

    def row(i, text, kind="response", to=None):
        b = (text or "").encode()
        return (i, len(b), hashlib.sha256(b).hexdigest(), kind, to)

    want = [row(1, big), row(1, big, "revisit", 1), row(3, big, "revisit", 1), row(None, big, "revisit", 1), row(5, None), row(6, "y"), row(7, "y"), row(9, other), row(11, other, "revisit", 9), row(10, "z" * 100), row(12, "z" * 99)]
    assert got == sorted(want, key=str)
    nothing = common.fresh_path(spark, "test-warc")
    assert warc.read_warc(warc.write_warc(df.limit(0), nothing), nothing).count() == 0


def test_warc_records_hold_the_payload(spark):
    folder = common.fresh_path(spark, "test-warc")
    manifest = warc.write_warc(spark.createDataFrame([(1, "http://a/", "<p>hé</p>")], "page_id long, url string, html string"), folder)
    fs, base = files.open_fs(folder)
    with fs.open_input_stream(f"{base}/{manifest.first()['file']}", compression=None) as f:
        kinds = [(h["WARC-Type"], block) for h, block in warc.read_records(f)]
    assert [k for k, _ in kinds] == ["warcinfo", "response"] and kinds[1][1].endswith("<p>hé</p>".encode())


# 4


def check_packing(spans, ids):
    for k, part in brute.by_key(spans, lambda r: r.doc_id).items():
        part = sorted(part, key=lambda r: r.start)
        assert [r.start for r in part] == [sum(x.length for x in part[:i]) for i in range(len(part))]
        assert sum(r.length for r in part) == len(ids[k]) == part[0].doc_tokens
        for r in part:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][r.start : r.start + r.length], "<u4").tobytes())
    for part in brute.by_key(spans, lambda r: r.sequence_id).values():
        part = sorted(part, key=lambda r: r.offset)
        assert [r.offset for r in part] == [sum(x.length for x in part[:i]) for i in range(len(part))]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [tokens.END_ID] for x in texts]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(docs, rows, capacity):
    spans = packing.pack(docs, capacity=capacity).collect()
    ids = dict(zip([i for i, _ in rows], plain_ids([t for _, t in rows])))
    check_packing(spans, ids)
    used = len({r.sequence_id for r in spans})
    assert max(sum(r.length for r in p) for p in brute.by_key(spans, lambda r: r.sequence_id).values()) <= capacity
    assert used <= sum(map(len, ids.values())) / capacity + 2


def test_copies_in_a_row_are_encoded_once(spark, monkeypatch):
    frame, asked, encode = MagicMock(), [], tokens.ChunkEncoder.encode
    monkeypatch.setattr(tokens.ChunkEncoder, "encode", lambda self, texts: asked.extend(texts) or encode(self, texts))
    packing.pieces(frame, "doc_id", "text", tokens.tokenizer_path(), 4)
    cut = frame.select.return_value.mapInArrow.call_args[0][0]
    texts = ["one two three four five six", "one two three four five six", None, None, "seven", "one two three four five six"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, None, 3, 4]), pa.array(texts)], ["doc_id", "text"])
    (out,) = cut(iter([batch]))
    want = [(k, at, len(x[at : at + 4]), zlib.crc32(np.array(x[at : at + 4], "<u4").tobytes()), len(x)) for k, x in zip([1, 1, 2, None, 3, 4], plain_ids(texts), strict=True) for at in range(0, len(x), 4)]
    assert [tuple(r.values()) for r in out.to_pylist()] == want
    assert asked == [texts[0], None, "seven", texts[0]]


def test_fill_is_closest():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 80)
        reach = {0}
        for x, n in counts.items():
            reach = {s + x * k for s in reach for k in range(n + 1) if s + x * k <= room}
        used = packing.fill(counts, room)
        assert sum(x * n for x, n in used.items()) == max(reach) and all(n <= counts[x] for x, n in used.items())


def test_pack_edges(spark):
    assert packing.pack(empty(spark)).count() == 0
    out = packing.pack(odd_ids(spark)).collect()
    assert len(out) == 6 and sum(r.length for r in out) == 6 + sum(len(x) - 1 for x in plain_ids(["a b c d e f"] * 3 + ["z y x"]))


# 5


@pytest.mark.parametrize("hot", [0, 1, 64])
def test_substrings(docs, rows, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substrings, "LEAST_HOT", 3)
        monkeypatch.setattr(substrings, "SPREAD", hot)
        monkeypatch.setattr(substrings, "HOT_SHARE", 1e-6)
        monkeypatch.setattr(substrings, "SLICE_CHARS", 3000)
        monkeypatch.setattr(substrings, "MOST_TASKS", 2)
    for k in (35, 5):
        out = substrings.remove_repeats(docs, k=k).select("doc_id", "n_words", "n_removed", "kept_text")
        assert sorted(map(tuple, out.collect())) == sorted(brute.repeats(rows, k))


def test_frequent_windows_travel_as_digests(spark, monkeypatch):
    """A passage in every slice, with other white space, beside texts of its own words: no bucket gets its text."""
    for name, value in (("LEAST_HOT", 64), ("HOT_SHARE", 1e-6), ("SPREAD", 8), ("SLICE_CHARS", 600)):
        monkeypatch.setattr(substrings, name, value)
    passage = [f"w{i}" for i in range(60)]
    rows = [(i, f"a{i} b{i} " + (" ", "\n", "\t ")[i % 3].join(passage) + f" c{i}") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{i}x{j}" for j in range(70))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hot, _, _ = substrings.frequent_grams(docs.selectExpr("doc_id key", "0 tag", "text"))
    assert {int(x) for x in substrings.grams(substrings.tokenise(" ".join(passage).encode())[0], substrings.M)} <= {int(x) for x in hot}
    out = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted(map(tuple, out.collect())) == sorted(brute.repeats(rows, 35))
    monkeypatch.setattr(substrings, "MOST_HOT", 10)
    assert len(substrings.frequent_grams(docs.selectExpr("doc_id key", "0 tag", "text"))[0]) <= 10


def test_slices_leave_nothing_behind(spark, monkeypatch):
    """Nothing of a slice is held while the next one is read, and what was freed goes back."""
    keyed, back, alive = MagicMock(), [], []
    keyed.sparkSession.sparkContext.broadcast = lambda x: SimpleNamespace(value=x)
    for name, stand_in in (("frequent_grams", lambda *_: (np.zeros(0, np.uint64), 4, 1000)), ("stash", MagicMock()), ("_slice_number", lambda at: at), ("SLICE_CHARS", 1000), ("give_back", lambda: back.append(1))):
        monkeypatch.setattr(substrings, name, stand_in)
    substrings.repeated_windows(keyed)
    split = keyed.mapInArrow.call_args[0][0]

    def batches():
        for i in range(4):
            alive.append(sum(isinstance(x, substrings.Slice) for x in gc.get_objects()))
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([0], pa.int32()), pa.array([prose(random.Random(i), 500)])], ["key", "tag", "text"])

    assert len(list(split(batches()))) == 4 and alive == [0] * 4 and len(back) >= 4


def test_equal_windows_survive_hash_collisions():
    words = [b"0", b"1", b"2", b"3", b"0", b"1", b"2", b"4", b"5", b"6"]
    # every window has one hash; then all words have one hash too
    for hashes in (np.array([int(w) for w in words], np.uint64), np.zeros(10, np.uint64)):
        labels = substrings.equal_windows(np.arange(8), hashes, np.zeros(9, np.uint64), 3, 2, lambda a, b: words[a:b])
        assert labels[0] == labels[4] and len(set(labels)) == 7


def test_words_are_those_of_the_pattern(rows):
    for _, t in rows:
        data = (t or "").encode()
        h, a, b = substrings.tokenise(data)
        assert [data[x:y].decode() for x, y in zip(a, b)] == brute.WORD.findall(t or "")
        assert len(set(h)) == len(set(brute.WORD.findall(t or "")))


def test_substrings_edges(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0
    out = substrings.remove_repeats(odd_ids(spark), k=5).collect()
    assert sorted((r.n_words, r.n_removed) for r in out) == [(0, 0), (0, 0), (3, 0), (6, 6), (6, 6), (6, 6)] and all(r["shard"] == "own" for r in out)


# 6


def test_sharding_moves_little(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    out = sharding.shard(df, "doc_id", [1.0] * 24, [1.0] * 25).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in out) and 60 < sum(r.grown_shard == 24 for r in out) < 260
    for part in brute.by_key(out, lambda r: r.shard).values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    heavy = sharding.shard(df, "doc_id", [3.0, 1.0]).collect()
    assert 0.7 < sum(r.shard == 0 for r in heavy) / 4000 < 0.8
    lighter = {r.doc_id: r.shard for r in sharding.shard(df, "doc_id", [2.0, 1.0]).collect()}
    assert all(lighter[r.doc_id] == r.shard or r.shard == 0 for r in heavy)


def test_sharding_is_that_of_a_plain_scorer(spark):
    def u(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)

    keys, weights = [*range(-40, 400), None, 7, 7], [1.0, 2.0, 0.5, 1.0]
    out = sharding.shard(spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id", weights, [*weights, 3.0]).collect()

    def best(k, w):
        return min(range(len(w)), key=lambda j: -math.log((u("" if k is None else k, j) + 0.5) / 2**52) / w[j])

    assert all(r.shard == best(r.doc_id, weights) and r.grown_shard == best(r.doc_id, [*weights, 3.0]) for r in out)
    for group in brute.by_key(out, lambda r: r.shard).values():
        order = [u("" if r.doc_id is None else r.doc_id, "slot") for r in sorted(group, key=lambda r: r.slot)]
        assert [r.slot for r in sorted(group, key=lambda r: r.slot)] == list(range(len(group))) and order == sorted(order, key=lambda o: (o % 64, o))


def test_sharding_edges(spark):
    out = sharding.shard(odd_ids(spark), "doc_id", [1.0] * 4).collect()
    assert len(out) == 6 and len({r.shard for r in out if r.doc_id is None}) == 1
    assert sharding.shard(empty(spark), "doc_id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1.0, 0.0])


# 7


def test_line_counts(docs, rows):
    out = {r.doc_id: r for r in quality.measure(docs).collect()}
    for i, t in rows:
        r, want = out[i], brute.line_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_lines_are_judged_as_spelled_out(docs, rows):
    """The rules again, sharing no pattern with the operator, over prose, menus, boilerplate, junk and other scripts."""
    extra = ["Home | About | News | Shop\nA line of prose, which is fine.", "Sign up for news\n" + "fine words, all of them. " * 20, "# # # $ $\nwords " * 30, "WOW!! NOW!! GO!! yes\n" + "good prose here, at last. " * 30, "copyright 2020 someone\nthis one has twelve words and more than that but no marks in it at all\nend.", "यह एक लंबी पंक्ति है जिसमें बहुत सारे शब्द हैं और यह यहाँ समाप्त होती है।\n" * 5]
    data = [(i, t) for i, t in rows] + [(10_000 + i, t) for i, t in enumerate(extra)]
    df = docs.sparkSession.createDataFrame(data, "doc_id long, text string")
    texts = dict(data)
    out = {r.doc_id: r for r in quality.measure(df).collect()}
    for i, t in texts.items():
        cleaned, lost = brute.line_first(t)
        n, chars, _, _, repeat = brute.line_counts(t)
        assert (out[i].cleaned or "") == cleaned
        assert out[i].kept == (n >= 50 and 100 * repeat <= 50 * n and lost <= 0.3 * chars)


def test_lines(spark):
    rng = random.Random(1)
    clean = "\n".join(prose(rng, 15, 9999) + "." for _ in range(8))
    menu = "Home | About | Contact | News | Shop | Help"
    junk = " ".join(f"word{i}###" for i in range(60))
    loud = " ".join(f"WORD{i}!!" for i in range(60))
    texts = [clean, clean + "\n" + menu + "\nAll rights reserved.", clean[:300] + "\n" + junk, loud, None, ""]
    out = [(r.kept, r.cleaned) for r in quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert out[0] == (True, clean) and out[1] == (True, clean)
    assert [k for k, _ in out[2:]] == [False] * 4 and out[4][1] is None
    assert quality.measure(empty(spark)).count() == 0 and quality.measure(odd_ids(spark)).count() == 6


# 8


@pytest.mark.parametrize("line", ["यह एक लंबी पंक्ति है जिसमें बहुत सारे शब्द हैं और यह यहाँ समाप्त होती है।", "هذه جملة طويلة فيها كلمات كثيرة جدا ولا يوجد فيها سوى علامة واحدة في آخرها هنا؟", "ነገር ግን ይህ ረጅም ዓረፍተ ነገር ነው እና ብዙ ቃላት በውስጡ አሉ እዚህ ያበቃል ።", "คน ไทย เขียน ข้อความ ยาว ๆ โดย ไม่ มี เครื่องหมาย วรรคตอน ใด ๆ เลย ครับ", "Это длинная строка из многих слов, которая кончается здесь точкой, как и положено.", "this line has a great many words but no mark of punctuation at all in it"])
def test_lines_of_other_scripts(spark, line):
    fails = spark.createDataFrame([(line,)], "x string").select(quality.line_fails(F.col("x"))).first()[0]
    assert fails == line.startswith("this")


def judge_plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    m = min([path.index(c) for c in "?#" if c in path] or [len(path)])
    path = path[:m]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = [None, "", "x", "http://Example.ORG/es/1", "https://a.example.org/en/12?q=1", "http://example.org", "http://example.org?x", "ftp://notexample.org/es/", "http://b.com/fr/x#y", "http://com/de/", "http://b.com/de/2", "a://b://c.org/d", "http://.org/", "http://org/", "http://ÄA.org/\nx"] * 3
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("own"))
    rules = spark.createDataFrame(list(url_filter.RULES), "rule_host string, rule_path string, verdict string")
    out = url_filter.judge(df, "url", rules).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == [judge_plain(u, url_filter.RULES) for u in urls]
    assert {r.verdict for r in url_filter.judge(df, "url", rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), "url", rules).count() == 0


def test_many_rules(spark):
    rng = random.Random(4)
    rules = [(f"h{i}.net", f"/p{i % 7}", "block") for i in range(3000)]
    urls = [f"http://{'www.' * (i % 2)}h{rng.randrange(6000)}.net/p{rng.randrange(9)}/x" for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filter.judge(df, "url", spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")).orderBy("page_id").collect()
    listed = {(h, p): v for h, p, v in rules}
    assert [r.verdict for r in out] == [listed.get((u.split("/")[2].removeprefix("www."), "/" + u.split("/")[3]), "allow") for u in urls]


# 9


def test_ids_are_those_of_the_tokenizer(rows):
    texts = [t for _, t in rows] + ["x\u1680y\u0085z\u00a0w", "A\u0301 b\u0301", "İstanbul DON'T it'll 'S''s", "1½²٣", "a" * 3000, "\x1c\x1d", "日本語 テキスト"]
    encode = tokens.ChunkEncoder(tokens.tokenizer_path()).encode
    assert [x.tolist() for x in encode(texts)] == plain_ids(texts)


def thue_morse(n, a="a", b="b"):
    """Words whose hashes collide under any polynomial modulo 2**64."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_ids_of_every_character_beside_others():
    marks = [chr(c) for c in range(1, 0x3000) if chr(c).isprintable()]
    texts = [f"{x} a{x}b ({x}) {x}1 1{x}! {x}li ¿{x}? {x}{x}'s x{x}" for x in marks]
    encode = tokens.ChunkEncoder(tokens.tokenizer_path()).encode
    assert [x.tolist() for x in encode(texts)] == plain_ids(texts)


@pytest.mark.parametrize("slice_chars", [1, 50, 3 << 20])
def test_ids_do_not_depend_on_what_came_before(monkeypatch, slice_chars):
    monkeypatch.setattr(tokens, "SLICE_CHARS", slice_chars)
    texts = ["ə (Ə)", "(Ə)", "Əli", "¿Ə? <|endoftext|>Ə.", "(ə)"]
    for n in (1024, 2048, 4096):
        texts += [thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n) + " " + thue_morse(n, "b", "a")]
    want = plain_ids(texts)
    for order in (range(len(texts)), reversed(range(len(texts))), np.random.default_rng(5).permutation(len(texts))):
        order = list(order)
        encode = tokens.ChunkEncoder(tokens.tokenizer_path()).encode
        assert [x.tolist() for x in encode([texts[i] for i in order])] == [want[i] for i in order]


def test_distinct_words_survive_hash_collisions():
    words = [b"aa", b"bb", b"aa", b"c" * 9, b"c" * 8 + b"d", b"e" * 300, b"e" * 299 + b"f", b"bb", b"e" * 300]
    data = b" ".join(words)
    _, starts, ends = substrings.tokenise(data)
    for hashes in (np.zeros(9, np.uint64), np.array([0, 0, 0, 1, 1, 2, 2, 0, 2], np.uint64)):
        first, of = substrings.distinct_words(data, hashes, starts, ends)
        assert [words[first[i]] for i in of] == words and len(first) == 6


def test_ids_with_small_caches(rows, monkeypatch):
    for name in ("KEPT_WORDS", "KEPT_PIECES", "SLICE_CHARS"):
        monkeypatch.setattr(tokens, name, 50)
    texts = [t for _, t in rows]
    assert [x.tolist() for x in tokens.ChunkEncoder(tokens.tokenizer_path()).encode(texts)] == plain_ids(texts)


def test_tables(spark, docs, rows):
    folder = common.fresh_path(spark, "test-sst")
    manifest = sstable.write_tables(docs, folder, target=4000)
    assert manifest.count() > 3
    at, want = 0, []
    for (i, _), ids in zip(sorted(rows), plain_ids([t for _, t in sorted(rows)])):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, sstable.read_tables(manifest, folder).collect())) == want
    fs, base = files.open_fs(folder)
    ids = dict(zip([i for i, _ in rows], plain_ids([t for _, t in rows])))
    found = set()
    for r in manifest.collect():
        with fs.open_input_file(f"{base}/{r.file}") as f:
            reader = sstable.Reader(f)
            for i in list(ids) + [-5, 10**9]:
                if hit := reader.get(sstable.key_bytes(i)):
                    assert [x.tolist() for x in hit] == [ids[i]]
                    found.add(i)
    assert found == set(ids)
    for i in [*list(ids)[::7], -5, 10**9, None]:
        assert [x.tolist() for x in sstable.lookup(manifest, folder, i)] == ([ids[i]] if i in ids else [])


def test_table_blocks(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    keys = sorted([None, -3, -3, *range(0, 5000, 7), 2**63 - 1, -(2**63)], key=sstable.key_bytes)
    data = [(sstable.key_bytes(k), rng.integers(0, 70_000 if j % 5 else 300, rng.integers(0, 400)).astype(np.uint32)) for j, k in enumerate(keys)]
    with open(tmp_path / "t", "wb") as f:
        w = sstable.Writer(f)
        for k, ids in data:
            w.add(k, ids)
        w.close()
    reader = sstable.Reader(pa.OSFile(str(tmp_path / "t")))
    assert len(reader.places) > 3 and [(k, v.tolist()) for k, v in reader] == [(k, v.tolist()) for k, v in data]
    assert len(reader.get(sstable.key_bytes(-3))) == 2 and reader.get(sstable.key_bytes(3)) == []
    assert [sstable.key_value(k) for k, _ in data] == keys
    with pytest.raises(ValueError):
        sstable.Writer(open(tmp_path / "u", "wb")).__class__.add(w, sstable.key_bytes(0), data[0][1])


def test_tables_edges(spark):
    for df, n in ((empty(spark), 0), (odd_ids(spark), 6)):
        folder = common.fresh_path(spark, "test-sst")
        out = sorted((r.start, r.n_tokens) for r in sstable.read_tables(sstable.write_tables(df, folder), folder).collect())
        assert len(out) == n and all(a[0] + a[1] == b[0] for a, b in zip(out, out[1:]))


def test_range_shards(spark):
    keys = [i if i % 3 else 10**15 + i for i in range(3000)] + [42] * 500 + [-(2**61), 2**62]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    shard, n = ranges.range_shards(df, "k", F.lit(10), 2000)
    out = df.withColumn("s", shard).groupBy("s").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).orderBy("s").collect()
    assert [r.s for r in out] == list(range(n)) and all(a.hi < b.lo for a, b in zip(out, out[1:])) and max(r.n for r in out) <= 700


def test_range_shards_of_any_two_longs(spark):
    df = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,), (None,)], "k long")
    shard, n = ranges.range_shards(df, "k", F.lit(10), 10)
    assert n == 3 and {r.k: r.s for r in df.withColumn("s", shard).collect()} == {None: 0, -(2**63): 0, 0: 1, 2**63 - 1: 2}


def test_bounds_are_searched_not_scanned(spark):
    """25,000 shards take 15 comparisons a row."""
    bounds = list(range(-50_000, 200_000, 10))
    n = ranges.count_up_to(bounds, F.col("id"))
    assert "sequence" not in str(n) and len(bounds).bit_length() == 15
    out = spark.range(-50_020, 200_020, 7).select("id", n.alias("n")).collect()
    assert all(r.n == sum(1 for _ in range(-50_000, min(r.id, 199_990) + 1, 10)) for r in out[::50])


# 10


@pytest.mark.parametrize("size", [2, 5])
def test_near(docs, rows, size, monkeypatch):
    want = brute.near(rows, size, 80)
    assert sorted(map(tuple, minhash.near_duplicates(docs, size=size).collect())) == want
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    assert sorted(map(tuple, minhash.near_duplicates(docs, size=size).collect())) == want


def test_near_family_without_a_centre(spark):
    """Copies that differ from each other about as much as the threshold allows: no star links them all."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(200), 6 + i % 4):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert sorted(map(tuple, out.collect())) == brute.near(rows, 2, 80)


def test_near_words_that_polynomials_confuse(spark):
    rows = [(1, thue_morse(1024) + " foo bar"), (2, thue_morse(1024, "b", "a") + " foo bar"), (3, thue_morse(1024) + " " + thue_morse(1024, "b", "a") + " foo bar"), (4, "foo\tbar"), (5, "FOO bar")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert sorted(map(tuple, out.collect())) == brute.near(rows, 2, 80)


def test_near_long_texts_in_a_large_bucket(spark, monkeypatch):
    """Long near copies share buckets; their blocks are cut by the bytes of their sets."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 200_000)
    monkeypatch.setattr(minhash, "SMALL", 3)
    rng = random.Random(6)
    base = prose(rng, 9000).split()
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"w{rng.random()}" for w in base)) for i in range(14)] + [(20, None), (21, "a" * 100_000)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert sorted(map(tuple, out.collect())) == brute.near(rows, 2, 80)


def test_near_edges(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    out = minhash.near_duplicates(odd_ids(spark), size=2)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in out.collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (None, None, True), (2, 2, True), (2, 2, True)], key=str)


def test_bayes_bounds():
    for lanes in (48, 96, 288):
        m = minhash.least_matches(0.8, lanes)
        assert 0 < m < 0.8 * lanes
        # the chance that a pair at 0.8 stays below
        from math import comb

        p = 0.8 + 0.2 / 256
        assert sum(comb(lanes, k) * p**k * (1 - p) ** (lanes - k) for k in range(m)) < 1e-3


def test_workers_let_an_encoder_go(spark):
    """A worker that packed before holds no tables of the encoder while it sketches; packing itself keeps them."""
    path = tokens.tokenizer_path()
    frame = MagicMock()
    packing.pieces(frame, "doc_id", "text", path)
    minhash.sketch(frame, "doc_id", "text", 5)
    cut, sketch = (c[0][0] for c in frame.select.return_value.mapInArrow.call_args_list)
    tokens.encoder(path)
    assert not list(cut(iter([]))) and tokens.encoder.cache_info().currsize == 1
    assert not list(sketch(iter([]))) and tokens.encoder.cache_info().currsize == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(500)]
    want = brute.roots({x for e in links for x in e}, links)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {a for a, b in links if a == b}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gapless_rank(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    out = common.gapless_rank(df, ["g"], F.xxhash64("id"), [F.col("id")], "n", slices=8).collect()
    for part in brute.by_key(out, lambda r: r.g).values():
        assert sorted(r.n for r in part) == list(range(len(part)))
