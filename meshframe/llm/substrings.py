"""Substring dedup over word windows: super-k-mers travel to the bucket of their minimiser, where sorting counts windows.

A window is ``k`` consecutive words. Of its m-word grams the one with the least hash, rare grams before frequent ones,
is its minimiser; consecutive windows with one minimiser occurrence are a super-k-mer and travel as one packed string.
Equal windows have equal minimisers, so they meet in one bucket.

Frequent grams are counted over the whole table first. A window with a rare gram goes by a rare gram, which occurs in
few places. A window of frequent grams alone lies inside a repeated passage; it goes as a digest of its words, dealt by
digest and salt, so that no bucket gets a passage whole. Each slice of the input sends a window once: what repeats
inside the slice is settled there.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, give_back, stash, tidy, width

K, M = 35, 4
#: Characters of text that a task looks at together, and text of super-k-mers that a bucket is laid out for.
SLICE_CHARS, BUCKET_BYTES = 4 << 20, 20 << 20
#: A gram is frequent if it makes up this share of a bucket's super-k-mers; no gram is below the least count.
HOT_SHARE, LEAST_HOT = 0.25, 256
#: A gram found fewer times in a slice is reported as so many, with the chance that keeps its expected count.
SPREAD = 64
#: Frequent grams that are broadcast at most (64 MB); beyond, the threshold rises.
MOST_HOT = 8_000_000
#: Tasks that buckets are dealt to at most; beyond, a task takes several, one after another.
MOST_TASKS = 32_768

_WORDS = re.compile(WORD)
_TOP = np.uint64(1 << 63)
#: What tells rows apart: 96 bits.
KEY = np.dtype([("key", "<i8"), ("tag", "<i4")])
#: A digest of a window's words and its place.
PLACE = np.dtype([("high", "<u8"), ("low", "<u8"), ("key", "<i8"), ("tag", "<i4"), ("start", "<i4")])
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factor(i: int) -> np.uint64:
    return _mix(np.array([i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] | np.uint64(1)


#: Bytes up to which words are hashed and compared eight bytes at a time, all words together; longer ones go one by one.
LONG_WORD = 256
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from each byte on as a number, zeros after the end."""
    return np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))


def tokenise(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of each word of UTF-8 text.

    The hash is a chain of mixed eights of bytes (xxh3 for long words) and the same everywhere. It is no proof that words
    are equal: what is said of words is confirmed on their bytes.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    if not space[-1]:
        edge = np.concatenate([edge, [len(raw)]])
    starts, ends = edge[::2], edge[1::2]
    sizes = ends - starts
    eights = _eights(data)
    hashes = _mix(sizes.astype(np.uint64) * _GOLDEN + _GOLDEN)
    some, at, left = slice(None), starts, sizes
    for _ in range(LONG_WORD // 8):
        hashes[some] = _mix((hashes[some] + _GOLDEN) ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        some = more if isinstance(some, slice) else some[more]
        at, left = at[more] + 8, left[more] - 8
    if len(long := np.flatnonzero(sizes > LONG_WORD)):
        import xxhash

        for i in long.tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes, starts, ends


def distinct_words(data: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index for each distinct word, the number of each word among them): by hash, then by their bytes."""
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    sizes, twin = ends - starts, first[of]
    wrong = sizes != sizes[twin]
    eights = _eights(data)
    some = np.flatnonzero(~wrong & (twin != np.arange(len(twin))) & (sizes <= LONG_WORD))
    x, y, left = starts[some], starts[twin[some]], sizes[some]
    while len(some):
        wrong[some] |= (eights[x] ^ eights[y]) & _MASKS[np.minimum(left, 8)] != 0
        more = np.flatnonzero(left > 8)
        some, x, y, left = some[more], x[more] + 8, y[more] + 8, left[more] - 8
    for i in np.flatnonzero((sizes > LONG_WORD) & ~wrong & (twin != np.arange(len(twin)))).tolist():
        wrong[i] = data[starts[i] : ends[i]] != data[starts[twin[i]] : ends[twin[i]]]
    if wrong.any():  # words of one hash: told apart by their bytes
        more: dict[bytes, int] = {}
        own = []
        for i in np.flatnonzero(wrong).tolist():
            word = data[starts[i] : ends[i]]
            if word not in more:
                more[word] = len(first) + len(own)
                own.append(i)
            of[i] = more[word]
        first = np.concatenate([first, np.array(own, first.dtype)])
    return first, of


def grams(hashes: np.ndarray, m: int) -> np.ndarray:
    n = len(hashes) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(m):
        out += hashes[j : j + n] * _factor(j)
    return _mix(out)


def minimisers(ranks: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of each w consecutive ranks, the leftmost of equals."""
    at, least, span = np.arange(len(ranks)), ranks, 1
    while span < w:
        step = min(span, w - span)
        right = least[step:]
        left = least[: len(right)]
        first = left <= right
        least, at = np.where(first, left, right), np.where(first, at[: len(right)], at[step:])
        span += step
    return at


def equal_windows(starts: np.ndarray, hashes: np.ndarray, g: np.ndarray, k: int, m: int, spell) -> np.ndarray:
    """A label for each window start; labels are equal where the words are.

    Windows are sorted by a hash of their grams. Neighbours with one hash are compared word by word: by the words' hashes
    and, for each stretch of such windows, by what ``spell(first, end)`` says that the words are.
    """
    key = np.zeros(len(starts), np.uint64)
    for i, off in enumerate([*range(0, k - m, m), k - m]):
        key += g[starts + off] * _factor(100 + i)
    key = _mix(key)
    order = np.argsort(key, kind="stable")
    ordered, s = key[order], starts[order]
    same = ordered[1:] == ordered[:-1]
    labels = np.zeros(len(starts), np.int64)
    labels[order] = np.concatenate([[0], np.cumsum(~same)])[: len(starts)]
    near = np.flatnonzero(same)
    x, y = s[near], s[near + 1]
    sure = np.ones(len(near), bool)
    for j in range(k):
        sure &= hashes[x + j] == hashes[y + j]
    by = np.lexsort((x, y - x))
    first, n = _runs(x[by], (y - x)[by], sure[by])
    for at, length in zip(first.tolist(), n.tolist(), strict=True):
        i = by[at]
        if sure[i] and spell(int(x[i]), int(x[i]) + length + k - 1) != spell(int(y[i]), int(y[i]) + length + k - 1):
            sure[by[at : at + length]] = False
    if not sure.all():  # windows of different words have one hash: label those by their words
        exact: dict = {}
        for i in np.flatnonzero(np.isin(labels, labels[order[near[~sure]]])):
            words = tuple(spell(int(starts[i]), int(starts[i]) + k))
            labels[i] = len(starts) + exact.setdefault(words, len(exact))
    return labels


def _runs(starts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of consecutive starts over which ``same`` stay as they are."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.diff(starts) != 1
    for x in same:
        cut |= x[1:] != x[:-1]
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return first, np.diff(np.concatenate([first, [len(starts)]]))


class Slice:
    """Some texts together: their keys, UTF-8 bytes, words, and the first word of each text and the end."""

    def __init__(self, keys: list, texts: list[bytes]):
        self.keys, self.data = keys, b"\n".join(texts)
        self.hashes, self.starts, self.ends = tokenise(self.data)
        bytes_before = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.docs = np.searchsorted(self.starts, bytes_before)

    def text(self, first: int, end: int) -> bytes:
        """From the first word up to the one before ``end``."""
        return self.data[self.starts[first] : self.ends[end - 1]]

    def spell(self, first: int, end: int) -> list[bytes]:
        return _split(self.text(first, end))


def _split(text: bytes) -> list[bytes]:
    return text.split()  # bytes.split knows exactly the ASCII white space


def _slices(batches: Iterator, chars: int) -> Iterator[Slice]:
    """About ``chars`` bytes of text at a time."""
    keys: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for *key, text in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1], strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            texts.append(data)
            keys.append(tuple(key))
            size += len(data)
            if size >= chars:
                yield Slice(keys, texts)
                keys, texts, size = [], [], 0
                give_back()
    if keys:
        yield Slice(keys, texts)


def _starts(ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one document, and the documents' indexes."""
    counts = np.maximum(np.diff(ends) - k + 1, 0)
    return _spans(ends[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def _pack(kind: int, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, text: bytes = b"") -> bytes:
    """Super-k-mers of a bucket as one string: their places and their words."""
    import zstandard

    places = keys.tobytes() + starts.astype("<i4").tobytes() + counts.astype("<i4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<BI", kind, len(keys)) + places + text)


def _unpack(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    kind, n = struct.unpack_from("<BI", raw)
    at = 5
    if kind == 2:
        none = np.zeros(0, np.int32)
        return kind, np.frombuffer(raw, PLACE, n, at), none, none, b""
    keys, starts, counts = np.frombuffer(raw, KEY, n, at), np.frombuffer(raw, "<i4", n, at + 12 * n), np.frombuffer(raw, "<i4", n, at + 16 * n)
    return kind, keys, starts, counts, raw[at + 20 * n :]


def _pack_places(places: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<BI", 2, len(places)) + places.tobytes())


def _digests(part: Slice, starts: np.ndarray, counts: np.ndarray, k: int) -> bytes:
    """16 bytes for each window of some runs of windows: BLAKE2b of its words, each ended by a space."""
    out = []
    for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
        words = part.spell(start, start + n + k - 1)
        line = b" ".join(words) + b" "
        at = np.cumsum([0, *[len(w) + 1 for w in words]]).tolist()
        out += [hashlib.blake2b(line[at[i] : at[i + k]], digest_size=16).digest() for i in range(n)]
    return b"".join(out)


def _slice_number(at: int) -> int:
    """A well mixed number of the slice ``at`` of this task."""
    from pyspark import TaskContext

    return int(_mix(np.array([(TaskContext.get().partitionId() << 32) + at], np.uint64))[0])


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``lengths`` of them, one span after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def frequent_grams(keyed: DataFrame, k: int = K, m: int = M) -> tuple[np.ndarray, int, int]:
    """(sorted hashes of the frequent grams, buckets, words) for a table of (key, tag, text).

    Counts come from every text. A gram that a slice holds fewer than SPREAD times is reported as SPREAD times with the
    chance that keeps its expected count, so grams that are spread thinly over all slices are counted too, and a count of
    n has a standard deviation of sqrt(SPREAD * n) at most. Counts decide only how windows travel, never the result. At
    most words / threshold grams are frequent, some 60 for each bucket; where they would be more than MOST_HOT, only
    the most frequent ones are.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = 0
        for at, part in enumerate(_slices(batches, SLICE_CHARS)):
            total += len(part.hashes)
            g = grams(part.hashes, m)
            inside = np.ones(len(g), bool)
            for back in range(1, m):
                cut = part.docs[1:-1] - back
                inside[cut[(cut >= 0) & (cut < len(g))]] = False
            found, n = np.unique(g[inside], return_counts=True)
            draw = _mix(found ^ np.uint64(_slice_number(at))) >> np.uint64(11)
            told = draw * 2.0**-53 * SPREAD < n
            yield pa.RecordBatch.from_arrays([pa.array(found[told].view(np.int64)), pa.array(np.maximum(n[told], SPREAD))], ["gram", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["gram", "n"])

    counts = keyed.mapInArrow(tidy(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = stash(counts.where(F.col("gram").isNull() | (F.col("n") >= LEAST_HOT)), "substring-grams")
    total = counts.where("gram is null").agg(F.sum("n")).first()[0] or 0
    buckets = max(width(keyed.sparkSession), -(-total * 18 // BUCKET_BYTES))
    super_kmers = 2 * total / (k - m + 2)
    least = max(LEAST_HOT, HOT_SHARE * super_kmers / buckets)
    level = F.floor(F.log2("n") * 8)  # a few hundred levels tell how far the threshold must rise
    often = counts.where(F.col("gram").isNotNull() & (F.col("n") >= least)).withColumn("level", level)
    lowest, held = 0, 0
    for r in sorted(often.groupBy("level").agg(F.count(F.lit(1)).alias("grams")).collect(), reverse=True):
        held += r["grams"]
        if held > MOST_HOT:
            lowest = r["level"] + 1
            break
    hot = often.where(F.col("level") >= lowest).select("gram").toArrow().column("gram").to_numpy()
    return np.sort(hot.astype(np.int64).view(np.uint64)), buckets, total


def repeated_windows(keyed: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(key, tag, start, n): n windows from the word at ``start`` of text ``key`` are found elsewhere too, in any text.

    ``keyed`` has (key long, tag int, text). Overlapping rows may come; every repeated window is in at least one.

    A digest is dealt by itself and one of as many salts as the square root of the number of slices. A bucket settles the
    digests that it holds several times and passes on one row for each digest; at most a row for each salt meets then.
    """
    hot, buckets, total = frequent_grams(keyed, k, m)
    salts = max(1, math.isqrt(total * 7 // SLICE_CHARS))
    sent = keyed.sparkSession.sparkContext.broadcast(hot)

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hot = sent.value

        def parcels(at: int, piece: Slice) -> list[tuple[int, bytes]]:
            """(bucket, blob) of what a slice sends."""
            ends = piece.docs
            starts, doc = _starts(ends, k)
            if not len(starts):
                return []
            keys = np.array(piece.keys, KEY)
            g = grams(piece.hashes, m)
            labels = equal_windows(starts, piece.hashes, g, k, m, piece.spell)
            _, first, of, times = np.unique(labels, return_index=True, return_inverse=True, return_counts=True)
            again = times[of] > 1
            rows: list[tuple[int, bytes]] = []
            a, n = _runs(starts[again], doc[again])
            if len(a):
                d = doc[again][a]
                rows.append((_slice_number(at) % buckets, _pack(0, keys[d], starts[again][a] - ends[d], n)))
            sends = np.zeros(len(starts), bool)
            sends[first] = True
            ranks = g >> np.uint64(1)
            if len(hot):
                ranks[hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g] |= _TOP
            place = minimisers(ranks, k - m + 1)[starts[sends]]
            a, n = _runs(starts[sends], place)
            begin, d = starts[sends][a], doc[sends][a]
            known = ranks[place[a]] >= _TOP
            if known.any():
                places = np.zeros(int(n[known].sum()), PLACE)
                of_doc = np.repeat(d[known], n[known])
                digests = np.frombuffer(_digests(piece, begin[known], n[known], k), "<u8").reshape(-1, 2)
                places["high"], places["low"] = digests[:, 0], digests[:, 1]
                places["key"], places["tag"] = keys["key"][of_doc], keys["tag"][of_doc]
                places["start"] = _spans(begin[known], n[known]) - ends[of_doc]
                bucket = (_mix(digests[:, 0] ^ _factor(_slice_number(at) % salts)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    rows.append((int(bucket[part[0]]), _pack_places(places[part])))
                a, n, begin, d = a[~known], n[~known], begin[~known], d[~known]
            bucket = (_mix(g[place[a]]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                froms, tos = piece.starts[begin[part]].tolist(), piece.ends[begin[part] + n[part] + k - 2].tolist()
                text = b"\n".join([piece.data[x:y] for x, y in zip(froms, tos, strict=True)])
                rows.append((int(bucket[part[0]]), _pack(1, keys[d[part]], begin[part] - ends[d[part]], n[part], text)))
            return rows

        at = 0
        for piece in _slices(batches, SLICE_CHARS):
            if rows := parcels(at, piece):
                b, blobs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
            piece = rows = b = blobs = None  # nothing of a slice is held while the next one is made; enumerate would hold it
            at += 1

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def ranges(keys, starts, counts, digests=None):
            columns = [pa.array(keys["key"]), pa.array(keys["tag"]), pa.array(starts, pa.int32()), pa.array(counts, pa.int32())]
            columns.append(pa.nulls(len(keys), pa.binary()) if digests is None else pa.array(digests, pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["key", "tag", "start", "n", "digest"])

        def settle(held: list, texts: list[bytes]) -> Iterator:
            """The repeated windows among super-k-mers of one bucket."""
            keys, starts, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            hashes, spots, base = [], [], 0
            for text in texts:
                h, a, b = tokenise(text)
                hashes.append(h)
                spots.append(np.stack([a + base, b + base]).astype(np.int64 if base > 1 << 30 else np.int32))
                base += len(text) + 1
            data = b"\n".join(texts)
            texts.clear()
            hashes, spots = np.concatenate(hashes), np.concatenate(spots, axis=1)

            def spell(first: int, end: int) -> list[bytes]:
                return _split(data[spots[0, first] : spots[1, end - 1]])

            sizes = counts.astype(np.int64) + k - 1
            at, of = _starts(np.concatenate([[0], np.cumsum(sizes)]), k)
            labels = equal_windows(at, hashes, grams(hashes, m), k, m, spell)
            _, inverse, times = np.unique(labels, return_inverse=True, return_counts=True)
            again = times[inverse] > 1
            a, n = _runs(at[again], of[again])
            d = of[again][a]
            yield ranges(keys[d], starts[d] + (at[again][a] - (np.cumsum(sizes) - sizes)[d]), n)

        def digested(places: np.ndarray) -> Iterator:
            """Places whose digest the bucket has twice; one row with the digest for each, with its place if it is alone."""
            places = places[np.lexsort((places["low"], places["high"]))]
            cut = np.flatnonzero((places["high"][1:] != places["high"][:-1]) | (places["low"][1:] != places["low"][:-1])) + 1
            first = np.concatenate([[0], cut])
            times = np.diff(np.concatenate([first, [len(places)]]))
            several = places[np.repeat(times > 1, times)]
            yield ranges(several, several["start"], np.ones(len(several), np.int32))
            lone = places[first]
            raw = lone[["high", "low"]].tolist()
            yield ranges(lone, lone["start"], (times == 1).astype(np.int32), [struct.pack("<QQ", *x) for x in raw])

        def finish(held: list, texts: list[bytes], places: list) -> Iterator:
            if held:
                yield from settle(held, texts)
            if places:
                yield from digested(np.concatenate(places))
                places.clear()
            give_back()

        held, texts, places, now = [], [], [], None
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    yield from finish(held, texts, places)
                    now = bucket
                kind, keys, starts, counts, text = _unpack(blob.as_py())
                if kind == 0:
                    yield ranges(keys, starts, counts)
                elif kind == 1:
                    held.append((keys, starts, counts))
                    texts.append(text)
                else:
                    places.append(keys)
        yield from finish(held, texts, places)

    packed = keyed.mapInArrow(tidy(split), "bucket int, blob binary")
    tasks = min(buckets, MOST_TASKS)
    dealt = packed.repartitionById(tasks, F.pmod(F.col("bucket"), F.lit(tasks)))
    if buckets > tasks:
        dealt = dealt.sortWithinPartitions("bucket")
    found = stash(dealt.mapInArrow(tidy(count), "key long, tag int, start int, n int, digest binary"), "substring-ranges")
    place = F.when(F.col("n") > 0, F.struct("key", "tag", "start", "n"))
    spread = found.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.collect_list(place).alias("places"))
    lone = spread.where("times > 1").select(F.explode("places").alias("p")).select("p.*")
    return found.where("digest is null").drop("digest").unionByName(lone)


def remove_repeats(df: DataFrame, text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """``df`` with n_words, n_removed (long) and kept_text: the words outside repeated windows joined by one space.

    A word goes if it is in a window of ``k`` words whose words also start anywhere else, in the same text too; windows
    are judged on the input. Null and short texts lose nothing (kept_text '' for null). Rows are told apart by 96 bits of
    hashes of all their columns, so repeated or null ids do no harm; equal rows are repeats of each other and lose alike.
    An empty table gives none. A text of any length is one row in memory with its words.
    Columns of ``df`` with the names of results are replaced.
    """
    bounded_batches(df.sparkSession)
    base = df.drop("n_words", "n_removed", "kept_text", "__key", "__tag", "__ranges")
    own = [F.col(c) for c in base.columns]
    keyed = base.withColumns({"__key": F.xxhash64(*own), "__tag": F.hash(*own)})
    found = repeated_windows(keyed.select("__key", "__tag", text), k, m).distinct()  # equal rows give each range as often as they are
    ranges = found.groupBy("key", "tag").agg(F.collect_list(F.struct("start", "n")).alias("__ranges"))
    joined = keyed.join(ranges.withColumnsRenamed({"key": "__key", "tag": "__tag"}), ["__key", "__tag"], "left").drop("__key", "__tag")
    others = list(base.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def drop(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, spans = batch.column(others.index(text)), batch.column(len(others))
            total, removed, kept = [], [], []
            for t, r in zip(texts, spans, strict=True):
                words = _WORDS.findall(t.as_py() or "")
                r = r.as_py()
                if r:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.array([x["start"] for x in r])
                    to = at + np.array([x["n"] for x in r]) + k - 1
                    np.add.at(edge, at, 1)
                    np.add.at(edge, to, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    left = words
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(" ".join(left))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*others, "n_words", "n_removed", "kept_text"])

    return joined.select(*others, "__ranges").mapInArrow(tidy(drop), schema + ", n_words long, n_removed long, kept_text string")


def op5_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS t, w[i] AS word FROM p),
c AS (SELECT doc_id, i, word, t IS NOT NULL AND count(*) OVER (PARTITION BY t) > 1 AS again FROM s),
k AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
