"""MinHash near-dedup with sequential Bayesian verification: banded candidates, pruned in batches, verified exactly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, components, hot_rows, join_one, stash, tidy
from .substrings import _SPACE, SLICE_CHARS, Slice, _factor, _mix, _spans, grams

#: Lanes of a signature (a byte each) in bands: a pair at 0.8 shares no band with probability 5e-7.
BANDS, ROWS = 48, 6
LANES = BANDS * ROWS
#: Lanes compared before each look at the posterior, and the chance to lose a pair at or above the threshold in a look.
BATCH, MISS = 48, 1e-6
#: Members up to which a bucket gives all pairs; larger ones begin with a star and go on by blocks of so many.
SMALL, BLOCK = 8, 4096
#: Bytes of shingle sets that a block has on average at most; long texts make more blocks, not larger ones.
BLOCK_BYTES = 32 << 20
#: Ids up to which the candidates' texts are picked by broadcast (16 MB, some 133 MB with the hash table); beyond, by shuffle.
BROADCAST_IDS = 2_000_000

_WORDS = re.compile(WORD)


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shingles(text: str | None, size: int) -> set[str]:
    words = _WORDS.findall(lower_ascii(text or ""))
    if len(words) < size:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _lanes() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:LANES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[LANES:] >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """One byte for each lane of the least hash; all shingles count, in chunks that stay in cache."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(LANES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        least = np.minimum(least, (x[None, i : i + 1024] * a[:, None] + b[:, None]).min(axis=1))
    return (_mix(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()


@lru_cache
def least_matches(threshold: float, lanes: int) -> int:
    """Matching lanes below which P(similarity >= threshold | matches of lanes) < MISS under a uniform prior."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    for m in range(lanes + 1):
        log = m * np.log(p) + (lanes - m) * np.log1p(-p)
        like = np.exp(log - log.max())
        if like[s >= threshold].sum() >= MISS * like.sum():
            return m
    return lanes + 1


def plausible(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, matches) of the pairs of signatures that no batch of lanes rules out."""
    live, matches = np.arange(len(x)), np.zeros(len(x), np.int32)
    for at in range(0, LANES, BATCH):
        matches = matches + (x[live, at : at + BATCH] == y[live, at : at + BATCH]).sum(axis=1, dtype=np.int32)
        stay = matches >= least_matches(threshold, at + BATCH)
        live, matches = live[stay], matches[stay]
    return live, matches


def _spaced(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the slice's words with one space after each."""
    raw = np.frombuffer(part.data + b" ", np.uint8)
    solid = ~_SPACE[raw]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the space after a word
    ends = np.cumsum(part.ends - part.starts + 1) - 1
    return np.where(solid, raw, np.uint8(32))[keep], ends - (part.ends - part.starts), ends


def _spelled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """A cryptographic digest of the shingles that lie there, in the order given: it says which words a set holds."""
    said = hashlib.blake2b(digest_size=16)
    for i in range(0, len(starts), 1 << 14):
        x, n = starts[i : i + (1 << 14)], ends[i : i + (1 << 14)] + 1 - starts[i : i + (1 << 14)]
        said.update(raw[_spans(x, n)].tobytes())
    return said.digest()


def sketch(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, n_shingles, digest, sig): size of the shingle set, a digest of its shingles' words, and its signature."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a, b = _lanes()

        def rows(texts: list[str]) -> list[tuple]:
            out = []
            part = Slice([], [t.encode("utf-8", "surrogatepass").lower() for t in texts])
            raw, starts, ends = _spaced(part)
            for first, end in zip(part.docs.tolist(), part.docs[1:].tolist(), strict=False):
                h, x, y = part.hashes[first:end], starts[first:end], ends[first:end]
                if not len(h):
                    out.append((0, b"", b""))
                    continue
                if len(h) < size:
                    g, at, n = _whole(h), np.zeros(1, np.int64), len(h)
                else:
                    g, at = np.unique(grams(h, size), return_index=True)
                    n = size
                out.append((len(g), _spelled(raw, x[at], y[at + n - 1]), signature(g, a, b)))
            return out

        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                chars, end = 0, at
                while end < len(texts) and (end == at or chars < SLICE_CHARS):
                    chars += len(texts[end])
                    end += 1
                n, digest, sig = zip(*rows(texts[at:end]), strict=True)
                yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["key", "n_shingles", "digest", "sig"])
                at = end

    return df.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(tidy(run), "key long, n_shingles long, digest binary, sig binary")


def _with_sets(texts: DataFrame, size: int) -> DataFrame:
    """(rep, text, set): with the hashes of the text's shingles, packed."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = []
            for text in batch.column(1).to_pylist():
                part = Slice([], [text.encode("utf-8", "surrogatepass").lower()])
                h = part.hashes
                sets.append((np.unique(grams(h, size)) if len(h) >= size else _whole(h)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.binary())], ["rep", "text", "set"])

    return texts.select("rep", "text").mapInArrow(tidy(run), "rep long, text string, set binary")


def _whole(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text that is shorter than a shingle."""
    return _mix((h * np.array([_factor(200 + i) for i in range(len(h))], np.uint64)).sum(keepdims=True))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, LANES)


def _pruned(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that Bayesian comparison of signatures leaves."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                live, _ = plausible(_matrix(batch.column(2)), _matrix(batch.column(3)), threshold)
                yield batch.select([0, 1]).take(live)

    with_a = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = with_a.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cached = lru_cache(2)(lambda text: frozenset(shingles(text, size)))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = cached(x.as_py()), cached(y.as_py())
                shared = len(p & q)
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def _across(rows: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links (a, b) between components in the buckets' blocks (key, band, i, j) of (rep, comp, sig, set, side).

    A block compares members of different components, each pair in the first band that the two share. Plausible pairs are
    tested on the full sets of shingle hashes, likeliest first, unless links found before already join their components:
    what leaves a block is a spanning forest of links, however many pairs it tested.
    """

    def group(band: int, reps: np.ndarray, comps: np.ndarray, sigs: np.ndarray, sets: list, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(sides <= 1)
        right = np.flatnonzero(sides == 2) if (sides == 2).any() else left
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in left:
            others = right[(comps[right] != comps[i]) & ((reps[right] > reps[i]) | (sides[right] == 2))]
            live, matches = plausible(np.broadcast_to(sigs[i], (len(others), LANES)), sigs[others], threshold)
            others = others[live]
            shared = (sigs[i].reshape(BANDS, ROWS) == sigs[others].reshape(-1, BANDS, ROWS)).all(axis=2)
            own = shared.argmax(axis=1) == band
            found.append((matches[own], np.full(int(own.sum()), i), others[own]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        kept = []
        for at in np.argsort(-m, kind="stable").tolist():
            i, j = int(x[at]), int(y[at])
            p, q = root(int(comps[i])), root(int(comps[j]))
            if p != q:
                one, two = np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[j], np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * shared >= percent * (len(one) + len(two) - shared):
                    parent[max(p, q)] = min(p, q)
                    kept.append((reps[i], reps[j]))
        pairs = np.array(kept, np.int64).reshape(-1, 2)
        return pairs.min(axis=1), pairs.max(axis=1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []

        def out(parts: list):
            if not parts:
                return None
            table = pa.Table.from_batches(parts)
            a, b = group(table["band"][0].as_py(), np.asarray(table["rep"]), np.asarray(table["comp"]), _matrix(table["sig"]), table["set"].to_pylist(), np.asarray(table["side"]))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                mark = tuple(marks[x])
                if held and mark != last:
                    yield out(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = mark
        if held:
            yield out(held)

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "band", "rep", "comp", "sig", "set", "side").mapInArrow(tidy(run), "a long, b long")


def _dealt(state: DataFrame, often: int) -> DataFrame:
    """Blocks (key, band, i, j, side, rep, comp) of the buckets' members (key, band, rep, n_shingles, comp) of several components.

    A bucket of one block is compared as it is. In a larger one the members of its largest component, which need no comparison
    with each other, have blocks of their own, the last ones: each goes to the blocks of the other members alone. So
    rows grow with the group times the blocks of what is not in it yet, not with the square of the group.
    """
    each = state.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    largest = F.max_by(F.struct("comp", "n", "size"), F.struct("n", -F.col("comp")))
    mixed = each.groupBy("key").agg(largest.alias("main"), F.sum("n").alias("times"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("comps")).where("comps > 1")

    def blocks(n, size):
        return F.ceil(F.greatest(n / BLOCK, size * 8 / BLOCK_BYTES)).cast("int")

    one = blocks(F.col("times"), F.col("total")) <= 1
    others = F.when(one, 1).otherwise(blocks(F.col("times") - F.col("main.n"), F.col("total") - F.col("main.size")))
    mixed = stash(mixed.select("key", "times", F.when(~one, F.col("main.comp")).alias("main"), others.alias("others"), F.when(one, 0).otherwise(blocks(F.col("main.n"), F.col("main.size"))).alias("mains")), "minhash-mixed")
    is_main = F.col("comp").eqNullSafe(F.col("main"))
    h = F.xxhash64("rep", "key")
    own = F.when(is_main, F.col("others") + F.pmod(h, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(h, F.col("others"))).cast("int")
    last = F.col("others") - 1 + F.when(is_main, 0).otherwise(F.col("mains"))
    to = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), F.when(o == own, 0).when(own < o, 1).otherwise(2).alias("side")))
    placed = join_one(state, mixed, ["key"], "times", often)
    return placed.select("key", "band", "rep", "comp", F.explode(to).alias("at")).select("key", "band", "at.i", "at.j", "at.side", "rep", "comp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``df``.

    Texts, A-Z lower-cased, are sets of ``size``-word shingles (shorter ones the whole sequence; empty and null ones have
    none and link with nothing). Two link if 100 * intersection >= percent * union; component_id is the smallest key
    reachable by links, kept says that it is the row's own. Keys are longs; rows with a null key link with nothing, have
    component_id null and are kept. Rows with one key are one document of several texts. An empty table gives none.

    Equal sets, by a cryptographic digest of their words, become one class at once. Classes share buckets, one for each band. A small bucket gives all its pairs.
    A large one begins with a star around its best-connected member; then its blocks compare members of different
    components, and give a spanning forest of the links between them. So a group of near copies costs links, not pairs,
    and yet no plausible pair of different components goes untested. Pairs are pruned by the posterior of their
    signatures, and every link is verified on the full texts.
    """
    bounded_batches(df.sparkSession)
    threshold = percent / 100
    docs = stash(sketch(df, key, text, size), "minhash-sketch")
    real = docs.where(F.col("key").isNotNull() & (F.col("n_shingles") > 0))
    classes = stash(real.groupBy("n_shingles", "digest").agg(F.min("key").alias("rep"), F.max("sig").alias("sig"), F.count(F.lit(1)).alias("times")), "minhash-classes")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * ROWS + 1, ROWS)) for i in range(BANDS)])
    banded = classes.select("rep", "n_shingles", F.posexplode(keys).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = stash(banded.join(shared, "key"), "minhash-buckets")
    often = hot_rows(live.count())

    ids = live.select("rep").distinct()
    few = ids.count() <= BROADCAST_IDS
    wanted = df.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    texts = wanted.join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    texts = stash(_with_sets(texts.where(F.col("text").isNotNull()), size), "minhash-texts")
    sigs = classes.select("rep", "sig").join(ids, "rep", "left_semi")
    sigs = stash(sigs, "minhash-signatures")

    small = live.where(F.col("n") <= SMALL)
    x, y = small.select("key", F.col("rep").alias("a")), small.select("key", F.col("rep").alias("b"))
    pairs = x.join(y, "key").where("a < b").select("a", "b")
    large = live.where(F.col("n") > SMALL)
    degree = large.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = large.join(degree, "rep")
    hubs = stash(ranked.groupBy("key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("hub"), F.count(F.lit(1)).alias("times")), "minhash-hubs")
    star = join_one(large, hubs, ["key"], "times", often).where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    first = pairs.unionByName(star).groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).select("a", "b")
    links = stash(_verified(_pruned(first, sigs, threshold), texts, percent, size), "minhash-links")
    parts = components(links, "minhash-components")
    parts = stash(parts, "minhash-parts")
    state = large.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    state = stash(state.select("key", "band", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp")), "minhash-state")
    dealt = _dealt(state, often)
    sets = sigs.join(texts.select("rep", "set"), "rep")
    again = stash(_across(dealt.join(sets, "rep"), threshold, percent).groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).select("a", "b"), "minhash-across")
    more = _verified(again, texts, percent, size)
    parts = components(links.unionByName(more), "minhash-components")

    of_class = classes.select("n_shingles", "digest", "rep", "times").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("n_shingles", "digest", "times", F.coalesce("component", "rep").alias("found"))
    rows = docs.select("key", "n_shingles", "digest")
    linked = F.col("key").isNotNull() & (F.col("n_shingles") > 0)
    out = join_one(rows.where(linked), of_class, ["n_shingles", "digest"], "times", hot_rows(docs.count()))
    out = out.unionByName(rows.where(~linked).withColumn("found", F.lit(None).cast("long")))
    component = F.when(F.col("key").isNotNull(), F.coalesce("found", "key"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept"))


def op10_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), size=2)


OP10_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(k.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(k.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.a = d.doc_id
"""
