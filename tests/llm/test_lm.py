"""Language-model scores against a plain model, and what makes a model one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshframe.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, score string"


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "\n"]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


class Plain:
    """Interpolated absolute discounting over dictionaries; contexts of two or more words must occur twice."""

    def __init__(self, rows, order):
        self.order, self.grams = order, [Counter() for _ in range(order + 1)]
        for i, text in rows:
            if not held(i):
                seq = ["\t", *tokens(text)]
                self.grams[1][("\t",)] += 1
                for p in range(1, len(seq)):
                    for k in range(1, order + 1):
                        if p - k + 1 >= 0:
                            self.grams[k][tuple(seq[p - k + 1 : p + 1])] += 1
        self.follow = defaultdict(set)
        for k in range(2, order + 1):
            for g in self.grams[k]:
                self.follow[g[:-1]].add(g[-1])
        words = {g: c for g, c in self.grams[1].items() if g != ("\t",)}
        self.n, self.v = sum(words.values()), len(words)

    def p(self, context, w):
        if not context:
            return (self.grams[1][(w,)] * (w != "\t") + 0.1) / (self.n + 0.1 * (self.v + 1))
        c = self.grams[len(context)][context]
        if c < (1 if len(context) == 1 else 2):
            return self.p(context[1:], w)
        return max(self.grams[len(context) + 1][(*context, w)] - 0.75, 0) / c + 0.75 * len(self.follow[context]) / c * self.p(context[1:], w)

    def score(self, text):
        seq = ["\t", *tokens(text)]
        own = range(1, len(seq))
        return (
            len(own),
            sum(self.grams[1][(seq[p],)] > 0 for p in own),
            sum(math.log10(self.p((), seq[p])) for p in own),
            sum(math.log10(self.p(tuple(seq[max(0, p - self.order + 1) : p]), seq[p])) for p in own),
        )


def prose(rng, n):
    """Words that follow each other with habits."""
    w, out = 0, []
    for _ in range(n):
        w = (w * 3 + rng.choice([1, 1, 1, 2, 7])) % 40 if rng.random() < 0.8 else rng.randrange(60)
        out.append(f"W{w}" if rng.random() < 0.1 else f"w{w}")
    return " ".join(out)


def corpus():
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(160)]
    rows += [(300 + i, "the same words again and again") for i in range(60)]
    rows += [(None, "w1 w2 w3"), (None, None), (3, "repeated id"), (3, "repeated id"), (400, None), (401, ""), (402, " \n\t\x0b "), (403, "é É  x a\x00b"), (404, prose(rng, 3000)), (-5, "w1")]
    rng.shuffle(rows)
    return rows


def found(spark, rows, parts=3, order=3):
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA).repartition(parts)
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(df, order=order).collect()], key=repr)


def expected(rows, order=3):
    model = Plain(rows, order)
    return sorted([(i, held(i), n, known, model.n, base, best) for i, t in rows for n, known, base, best in [model.score(t)]], key=repr)


def same(a, b):
    key = lambda r: (repr(r[0]), *r[1:5], round(r[5], 4))
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert x[:5] == y[:5]
        assert x[5] == pytest.approx(y[5], abs=1e-6) and x[6] == pytest.approx(y[6], abs=1e-6)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_plain_model(spark, order):
    rows = corpus()
    same(found(spark, rows, order=order), expected(rows, order))


def test_slices_pieces_and_hot_contexts(spark, monkeypatch):
    """Small slices, texts in pieces, many buckets and contexts dealt over several of them change no bit of the result."""
    rows = corpus()
    one = found(spark, rows, parts=1)
    for name, value in (("SLICE_TOKENS", 150), ("CHUNK", 90), ("BUCKET", 40), ("HOT", 8), ("HOT_SHARE", 1000), ("LANE", 7)):
        monkeypatch.setattr(lm, name, value)
    assert found(spark, rows, parts=4) == one
    same(one, expected(rows))


def test_empty_and_held_out_only(spark):
    assert found(spark, []) == []
    out = [i for i in range(200) if held(i)][:5]
    rows = [(i, f"some words {i}") for i in out]
    same(found(spark, rows), expected(rows))
    same(found(spark, [(1, None)]), expected([(1, None)]))


def test_probabilities_add_up(spark):
    """After any context the words of training texts and one unknown word have probability 1 together."""
    rows = [(i, t) for i, t in corpus() if not held(i)]
    model = Plain(rows, 3)
    words = [g[0] for g in model.grams[1] if g != ("\t",)]
    for context in [("\t",), ("w1",), ("w1", "w4"), ("absent",), ("\t", "the"), ("same", "words")]:
        assert math.isclose(sum(model.p(context, w) for w in [*words, "never seen"]), 1)


def test_predicts_held_out_texts(spark):
    rows = corpus()
    some = [r for r in found(spark, rows) if r[1] and r[2] > 20]
    assert some and sum(r[6] for r in some) > 0.8 * sum(r[5] for r in some)


def test_a_slice_sends_few_batches(spark):
    """Rows of small bodies go together, in order, and large ones alone."""
    sizes = [10, 20, lm.SENT, 5, lm.SENT // 2, lm.SENT // 2, 7]
    bodies = [(i, b"x" * n) for i, n in enumerate(sizes)]
    got = list(lm._together(iter(bodies)))
    assert [[i for i, _ in g] for g in got] == [[0, 1, 2], [3, 4, 5], [6]]
    assert [b for g in got for b in g] == bodies and list(lm._together(iter([]))) == []


@pytest.mark.parametrize("length", [2, 3, 4])
def test_bucket_adds_up(length):
    """Counts of n-grams and of words that follow a context, over slices, against dictionaries; wide and narrow numbers."""
    rng = random.Random(length)
    wide = [rng.randrange(1 << 36) for _ in range(6)]
    slices = []
    for _ in range(5):
        grams = {tuple(rng.choice(wide) for _ in range(length - 1)): {} for _ in range(8)}
        for g in grams.values():
            g |= {rng.choice([1, 2, 3, wide[0]]): rng.choice([0, 0, 1, 7]) for _ in range(3)}
        slices.append(grams)
    count, follow = Counter(), defaultdict(set)
    for grams in slices:
        for c, words in grams.items():
            for w, n in words.items():
                count[c, w] += n
                follow[c] |= {w} if n else set()
    hot = {c for grams in slices for c in grams if sum(c) % 2}
    whole = lambda x: np.array(x, np.int64)
    bodies = [lm._pack([whole([n for g in s.values() for n in g.values()]), whole([w for g in s.values() for w in g]), whole([len(g) for g in s.values()]), whole([c in hot for c in s]), *[whole([c[i] for c in s]) for i in range(length - 1)]]) for s in slices]
    replies, (names, following) = lm._answer(bodies, length)
    for s, reply in zip(slices, replies, strict=True):
        got = [x.tolist() for x in lm._unpack(reply)]
        assert got == [[count[c, w] for c, g in s.items() for w in g], [len(follow[c]) for c, g in s.items() for _ in g]]
    assert dict(zip(names.tolist(), following.tolist(), strict=True)) == {int(lm._mix([whole([x]) for x in c])[0]): len(follow[c]) for c in hot}
