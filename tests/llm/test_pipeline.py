import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
import test_operators as ops

import corpus_pipeline
from meshframe.llm import quality

NAMES = [n for n, _ in corpus_pipeline.STAGES]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def line_fails(line):
    n, chars = len(brute.WORD.findall(line)), sum(map(len, brute.WORD.findall(line)))
    bars = len(re.findall(rf"(?:^|\s)[{quality.SEPARATORS}](?:\s|$)", line))
    return (
        (bars >= 3 and bars * 4 >= n)
        or (len(line) <= quality.BOILERPLATE_CHARS and re.search(quality.BOILERPLATE, line) is not None)
        or sum(line.count(c) for c in quality.SYMBOLS) * 10 > chars
        or len(re.findall(r"!!(?:\s|$)", line)) * 3 > n
        or (n >= quality.SENTENCE_WORDS and not re.search(quality.MARK, line))
    )


def plain_quality(rows):
    out = []
    for i, t in rows:
        n, chars, _, _, again = brute.line_counts(t)
        cleaned = "\n".join(x for x in (t or "").split("\n") if not line_fails(x))
        lost = chars - sum(map(len, brute.WORD.findall(cleaned)))
        if n >= 50 and 100 * again <= 50 * n and lost <= quality.MAX_LOST * chars:
            out.append((i, cleaned))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = ops.corpus()
    menu, shout = "Home | News | Shop | About | Help", " ".join(f"W{i}!!" for i in range(70))
    texts = ["\n".join([ops.prose(rng, 40, 5000) + "."] * 1 + [menu] + [ops.prose(rng, 60, 5000) + "."]) for _ in range(10)] + [shout, ops.prose(rng, 80).replace(".", "")]
    rows += [(1000 + i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ops.DOCS).repartition(3).cache()


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_are_the_five():
    assert NAMES == ["quality", "near_dedup", "substring_dedup", "mixing", "packing"]


def test_quality(spark, docs):
    assert pairs(stage("quality")(spark, docs, "")) == sorted(plain_quality(pairs(docs)), key=str)


def test_near_dedup(spark, docs):
    want = {r[0] for r in brute.near(pairs(docs), 5, 80) if r[3]}
    assert pairs(stage("near_dedup")(spark, docs, "")) == [p for p in pairs(docs) if p[0] in want]


def test_near_dedup_drops_only_what_is_alike(spark):
    """Shared ids, null texts under an id and rows without an id: only copies and near copies go."""
    rng = random.Random(4)
    a, b, c, d, e = (ops.prose(rng, 60, 5000) for _ in range(5))
    rows = [(1, a), (1, b), (1, None), (2, None), (2, c), (3, a + " more"), (3, d), (3, d), (None, e), (None, e), (None, e + " more"), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], ops.DOCS)
    kept = pairs(stage("near_dedup")(spark, df, ""))
    assert sum(i is None and (t or "").startswith(e) for i, t in kept) == 1
    assert [p for p in kept if not (p[0] is None and p[1])] == sorted([(1, a), (1, b), (1, None), (2, None), (2, c), (3, d), (None, "")], key=str)


def test_substring_dedup(spark, docs):
    want = []
    for (i, n, gone, kept), (_, t) in zip(brute.repeats(pairs(docs), 35), pairs(docs), strict=True):
        if not gone or gone < n:
            want.append((i, kept if gone else t))
    assert pairs(stage("substring_dedup")(spark, docs, "")) == sorted(want, key=str)


def test_mixing(spark, docs):
    out = pairs(stage("mixing")(spark, docs, ""))
    there = dict(pairs(docs))
    assert all(there[i] == t for i, t in out) and max(out.count(p) for p in set(out)) <= 2
    words = sum(len(brute.WORD.findall(t or "")) for _, t in out)
    assert words == pytest.approx(1.5 * sum(len(brute.WORD.findall(t or "")) for t in there.values()), rel=0.05)
    assert out == pairs(stage("mixing")(spark, docs.repartition(5), ""))


def test_whole_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spans = corpus_pipeline.run(spark, str(tmp_path)).collect()
    frame = docs
    for name in NAMES[:-1]:
        frame = stage(name)(spark, frame, "").cache()
        assert frame.columns == docs.columns
    ids = ops.plain_ids([t for _, t in pairs(frame)])
    assert sum(r.length for r in spans) == sum(map(len, ids)) and {r.doc_id for r in spans} == {i for i, _ in pairs(frame)}
    assert all(r.n_chars == len(r.text) for r in frame.collect())


@pytest.mark.parametrize("name", NAMES)
def test_odd_inputs(spark, name):
    """Nulls everywhere, equal rows, clashing columns, an empty table."""
    text = " ".join(f"word{i}" for i in range(60)) + "."
    data = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text + " x", None, None, None), (3, None, None, None, None), (4, "", "en", "a", 0)]
    df = spark.createDataFrame(data, ops.DOCS)
    clashing = ["kept", "n_words", "n_removed", "kept_text", "cleaned", "size", "key", "rep", "component_id", "source_size", "copies", "unit", "shard", "__key", "__nth", "__h", "__n", "start", "length"]
    df = df.withColumns({c: F.lit(f"own {c}") for c in clashing})
    out = stage(name)(spark, df, "")
    rows = out.collect()
    if name != "packing":
        assert out.columns == df.columns and all(r[c] == f"own {c}" for r in rows for c in clashing)
    assert len(rows) == {"quality": 3, "near_dedup": 4, "substring_dedup": 3, "packing": 5}.get(name, len(rows))
    assert stage(name)(spark, df.limit(0), "").count() == 0
