"""Language-model scores: a backoff automaton of smoothed n-grams, learned from all training texts.

The n-grams of a slice of texts are the only ones that its scores can ask for. So a slice sends what it has (its n-grams
and how often they occur in training texts), buckets add up, and each slice gets the sums for its own n-grams back. From
these it builds its part of the automaton and reads its texts once, from left to right.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, fresh_path, stash, tidy
from .files import committed, open_fs

#: A-Z lower-cased and all white space one blank.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b"     ")
#: What no word can be: the end of a text, and what stands before its first word.
END, BEGIN = b"\n", b"\t"
#: Tokens of a slice, bytes of a text cut into words at once, n-grams a bucket adds up.
SLICE_TOKENS, CHUNK, BUCKET = 1_000_000, 4 << 20, 600_000
#: Bytes that a slice sends in one batch.
SENT = 1 << 20
#: A context that occurs this often, or as often as a HOT_SHARE-th of all tokens, is dealt over several buckets.
HOT, HOT_SHARE = 50_000, 1_000_000
#: Subtracted from each count; the share added to the counts of words (query contract); times that a context of two or
#: more words must occur to be a state.
DISCOUNT, ADDED, CONTEXT = 0.75, 0.1, 2
#: Weights of arcs are whole numbers of this part of 1, so that sums do not depend on their order.
UNIT = 10**10
#: Tokens that one lane of the traversal reads.
LANE = 160


@lru_cache
def _zstd():
    """A compressor and a decompressor: making one takes longer than most pieces."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one compressed piece; whole numbers in as few bytes as they need."""
    head, body = [len(arrays)], []
    for a in arrays:
        most = int(a.max(initial=0))
        kind = next(i for i, t in enumerate(("<u1", "<u2", "<u4", "<u8")) if most < 1 << (8 << i) or t == "<u8")
        head += [kind, len(a)]
        body.append(a.astype(f"<u{1 << kind}").tobytes())
    return _zstd()[0].compress(np.array(head, "<i8").tobytes() + b"".join(body))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = _zstd()[1].decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 1 + 2 * n)[1:].tolist()
    at, out = 8 * (1 + 2 * n), []
    for kind, size in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(raw, f"<u{1 << kind}", size, at).astype(np.int64))
        at += size << kind
    return out


class _Words(dict):
    """Numbers of words; a new one gets the next."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Slice:
    """Texts, or pieces of long ones, as numbers of words; each piece begins with the tokens before it, which are not its own."""

    words: _Words = field(default_factory=lambda: _Words({END: 0, BEGIN: 1}))
    ids: list[np.ndarray] = field(default_factory=list)
    pieces: list[tuple[int, int | None, bool, int, int]] = field(default_factory=list)  # row, key, held out, before, own
    n: int = 0

    def add(self, row: int, key: int | None, held: bool, before: list[bytes], own: list[bytes]) -> None:
        ids = np.fromiter(map(self.words.__getitem__, [*before, *own]), np.int64, len(before) + len(own))
        self.ids.append(ids)
        self.pieces.append((row, key, held, len(before), len(own)))
        self.n += len(ids)

    def body(self) -> bytes:
        row, key, held, before, own = zip(*self.pieces, strict=True)
        known = [k is not None for k in key]
        whole = lambda x: np.array([v & (2**64 - 1) for v in x], np.uint64)
        letters = np.frombuffer(b"\0".join(self.words), np.uint8)
        # a zero byte may be part of a word: lengths tell words apart
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        return _pack([np.concatenate(self.ids), letters, lengths, whole(row), whole([k or 0 for k in key]), np.array(known), np.array(held), np.array(before), np.array(own)])


class Texts:
    """A slice that was read again."""

    def __init__(self, body: bytes):
        self.ids, letters, lengths, row, key, known, held, self.before, self.own = _unpack(body)
        signed = lambda x: x.astype(np.int64).tolist()
        self.row, self.key = signed(row), [k if ok else None for k, ok in zip(signed(key), known, strict=True)]
        self.held = held.astype(bool)
        raw, at, self.words = letters.astype(np.uint8).tobytes(), 0, []
        for n in lengths.tolist():
            self.words.append(raw[at : at + n])
            at += n + 1
        size = self.before + self.own
        self.start = np.cumsum(size) - size
        self.place = np.arange(len(self.ids)) - np.repeat(self.start, size)
        self.is_own = self.place >= np.repeat(self.before, size)
        self.counted = self.is_own & ~np.repeat(self.held, size)


@dataclass
class Level:
    """The different n-grams of one length in a slice: their context (an entry of the level below), last word, the entry of
    the level below without the first word; ``at``: the entry that ends at each position, or -1."""

    context: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    at: np.ndarray
    own: np.ndarray
    count: np.ndarray | None = None
    following: np.ndarray | None = None  # different words that follow the context, by entry


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different keys in order, for each key its place among them); keys are not negative."""
    shift = max(1, (len(keys) - 1).bit_length())
    if int(keys.max(initial=0)).bit_length() + shift > 63:
        return np.unique(keys, return_inverse=True)
    # key and position in one number: sorting numbers is faster than sorting positions by them
    both = np.sort(keys << shift | np.arange(len(keys)))
    own = both >> shift
    new = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    inverse = np.empty(len(keys), np.int64)
    inverse[both & ((1 << shift) - 1)] = np.cumsum(new) - 1
    return own[new], inverse


def first_level(texts: Texts) -> Level:
    n = len(texts.words)
    own = np.bincount(texts.ids[texts.counted], minlength=n)
    own[1] = int((~texts.held & (texts.before == 1) & (texts.ids[texts.start] == 1)).sum())  # texts begun
    z = np.zeros(n, np.int64)
    return Level(z, np.arange(n), z, texts.ids, own)


def next_level(texts: Texts, below: Level, length: int) -> Level:
    """The n-grams of ``length`` words whose context occurs often enough in training texts."""
    live = below.count >= (1 if length == 2 else CONTEXT)
    ctx = np.r_[-1, below.at[:-1]]
    some = np.flatnonzero((texts.place >= length - 1) & (ctx >= 0) & (texts.ids != 1))
    some = some[live[ctx[some]]]
    keys, inverse = _different(ctx[some] * len(texts.words) + texts.ids[some])
    at = np.full(len(texts.ids), -1, np.int64)
    at[some] = inverse
    suffix = np.empty(len(keys), np.int64)
    suffix[inverse] = below.at[some]
    own = np.bincount(inverse[texts.counted[some]], minlength=len(keys))
    return Level(keys // len(texts.words), keys % len(texts.words), suffix, at, own)


@dataclass(frozen=True)
class Facts:
    """What all slices know of the corpus: numbers of buckets, tokens and different words in training texts, and of words
    that follow hot contexts (their number is bounded by 2 * HOT_SHARE a level)."""

    buckets: int
    tokens: int = 0
    distinct: int = 0
    hot: tuple[tuple[np.ndarray, np.ndarray], ...] = ()

    def often(self) -> int:
        return max(HOT, self.tokens // HOT_SHARE)

    def log_words(self, count: np.ndarray) -> np.ndarray:
        return (count + ADDED) / (self.tokens + ADDED * (self.distinct + 1))


def _mix(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of rows of whole numbers."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
    return h


class Asked:
    """The n-grams of one level of a slice in the order in which they are sent: by bucket and, in it, as in the level, so that
    those of one context are together.

    ``number`` names words in the whole corpus. A bucket gets whole contexts, but of hot ones a salt's share of the words.
    """

    def __init__(self, texts: Texts, levels: list[Level], number: np.ndarray | None, facts: Facts):
        self.level = levels[-1]
        if len(levels) == 1:
            hashes = np.array([zlib.crc32(w) for w in texts.words], np.int64)
            self.bucket = (_mix([hashes]) % np.uint64(facts.buckets)).astype(np.int64)
            self.order = self._by_bucket(facts)
            return
        names, at = [number[self.level.word]], self.level.context
        for below in reversed(levels[:-1]):
            names.append(number[below.word[at]])
            at = below.context[at]
        self.columns = names[:0:-1] + [names[0]]  # first word first
        often = levels[-2].count[self.level.context]
        self.hot = often >= facts.often()
        salts = np.maximum(1, often // facts.often())
        h = _mix(self.columns[:-1])
        salt = _mix([names[0], h.astype(np.int64)]) % salts.astype(np.uint64)
        h = np.where(self.hot, _mix([h.astype(np.int64), salt]), h)
        self.bucket = (h % np.uint64(facts.buckets)).astype(np.int64)
        self.order = self._by_bucket(facts)

    def _by_bucket(self, facts: Facts) -> np.ndarray:
        small = self.bucket.astype(np.uint16) if facts.buckets < 1 << 16 else self.bucket  # these are sorted in linear time
        return np.argsort(small, kind="stable")

    def bodies(self, texts: Texts) -> Iterator[tuple[int, bytes]]:
        """(bucket, n-grams and their counts)."""
        sent = self.bucket[self.order]
        cuts = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1], True]) if len(sent) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = self.order[a:b]
            own = self.level.own[some]
            if not hasattr(self, "columns"):
                words = [texts.words[i] for i in some.tolist()]
                yield int(sent[a]), _pack([own, np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))])
                continue
            of = self.level.context[some]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            yield int(sent[a]), _pack([own, self.columns[-1][some], np.diff(np.r_[first, b - a]), self.hot[some[first]], *[c[some[first]] for c in self.columns[:-1]]])

    def take(self, replies: list[tuple[int, bytes]], hot: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray | None:
        """Sets counts from the replies, in the order of buckets; gives the names of words for the first level."""
        count = np.zeros(len(self.order), np.int64)
        extra = np.zeros(len(self.order), np.int64)
        at = 0
        for _, body in replies:
            got, more = _unpack(body)
            count[self.order[at : at + len(got)]] = got
            extra[self.order[at : at + len(got)]] = more
            at += len(got)
        if at != len(self.order):
            raise RuntimeError("a slice got other n-grams back than it sent")
        self.level.count = count
        if not hasattr(self, "columns"):
            return extra
        if hot is not None and self.hot.any():
            some = np.flatnonzero(self.hot)
            extra[some] = hot[1][np.searchsorted(hot[0], _mix([c[some] for c in self.columns[:-1]]))]
        self.level.following = extra
        return None


def _answer_words(bodies: list[bytes], bucket: int, buckets: int) -> tuple[list[bytes], tuple[int, int]]:
    """(counts and numbers of the words of each slice, (training tokens, different ones)); words are told apart by their bytes."""
    seen: dict[bytes, int] = {}
    total: list[int] = []
    places = []
    for body in bodies:
        own, letters, lengths = _unpack(body)
        raw = letters.astype(np.uint8).tobytes()
        ends = np.cumsum(lengths)
        place = []
        for a, b, n in zip((ends - lengths).tolist(), ends.tolist(), own.tolist(), strict=True):
            i = seen.setdefault(raw[a:b], len(total))
            if i == len(total):
                total.append(n)
            else:
                total[i] += n
            place.append(i)
        places.append(np.array(place, np.int64))
    counts = np.array(total, np.int64)
    words = counts.copy()
    if BEGIN in seen:
        words[seen[BEGIN]] = 0
    return [_pack([counts[p], p * buckets + bucket]) for p in places], (int(words.sum()), int((words > 0).sum()))


def _answer(bodies: list[bytes], length: int) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray]]:
    """(counts of the n-grams of each slice and the words that follow their contexts, (hot contexts, such words here))."""
    parts = [_unpack(b) for b in bodies]
    sizes = [len(p[0]) for p in parts]
    own, word, times, hot, *context = (np.concatenate([p[i] for p in parts]) for i in range(3 + length))
    del parts
    # contexts get numbers a word at a time, so that each step sorts one number; they come once for each slice, not for each n-gram
    number = np.zeros(len(times), np.int64)
    for c in context:
        contexts, number = _different(number << int(c.max()).bit_length() | c)
    of = np.repeat(number, times)
    bits = int(word.max()).bit_length()
    grams, inverse = _different(of << bits | word)
    total = np.bincount(inverse, own, len(grams)).astype(np.int64)
    follow = np.bincount(grams >> bits, total > 0, len(contexts)).astype(np.int64)
    count, following = total[inverse], follow[of]
    is_hot, some = np.zeros(len(contexts), bool), np.empty(len(contexts), np.int64)
    is_hot[number], some[number] = hot.astype(bool), np.arange(len(number))
    mine = (_mix([c[some[is_hot]] for c in context]), follow[is_hot])
    ends = np.cumsum(sizes)
    return [_pack([count[a:b], following[a:b]]) for a, b in zip(ends - sizes, ends, strict=True)], mine


class Automaton:
    """States are the root and the contexts of a slice; an arc reads a word, a failure arc leads to the context without its first word.

    Arcs have the logarithm of the interpolated probability, failure arcs that of the mass left to the shorter context.
    """

    def __init__(self, levels: list[Level], facts: Facts):
        n = len(levels[0].word)
        self.n = n
        logs = lambda p: np.rint(UNIT * np.log10(p)).astype(np.int64)
        p = facts.log_words(levels[0].count)
        self.root = logs(p)
        base = 1
        states = [np.where((levels[0].count > 0) & (np.arange(n) != 0), base + np.arange(n), 0)]
        self.fail, self.mass = [np.zeros(1 + n, np.int64)], [np.zeros(1 + n, np.int64)]
        keys, weights, following = [], [], []
        for k, (below, level) in enumerate(zip(levels, levels[1:], strict=False), 2):
            h = level.context
            share = DISCOUNT * level.following / below.count[h]
            p = np.maximum(level.count - DISCOUNT, 0) / below.count[h] + share * p[level.suffix]
            self.mass[-1][h + (0 if k > 2 else 1)] = logs(np.where(share > 0, share, 1))
            self_state = states[-1][h]
            base += len(below.word)
            last = k == len(levels)
            own = np.where(level.count >= CONTEXT, base + np.arange(len(level.word)), 0) if not last else np.zeros(len(level.word), np.int64)
            shorter = states[-1][level.suffix]
            states.append(np.where(own > 0, own, shorter))
            if not last:
                self.fail.append(shorter)
                self.mass.append(np.zeros(len(level.word), np.int64))
            known = level.count > 0
            keys.append(self_state[known] * n + level.word[known])
            weights.append(logs(p[known]))
            following.append(states[-1][known])
        self.next_root = states[0]
        self.fail, self.mass = np.concatenate(self.fail), np.concatenate(self.mass)
        # the last arc is none: no key is negative
        self.keys, self.weights, self.following = (np.concatenate([*x, [last]]).astype(np.int64) for x, last in ((keys, -1), (weights, 0), (following, 0)))
        self._place_arcs()

    def _place_arcs(self) -> None:
        """A table of arcs by a hash of their key; one whose place is taken goes to the next that is free."""
        arcs = len(self.keys) - 1
        self.bits = max(4, (2 * arcs).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32 if arcs < 2**31 else np.int64)
        waiting, place = np.arange(arcs), self._place(self.keys[:-1])
        while len(waiting):
            free = self.table[place] < 0
            self.table[place[free]] = waiting[free]
            left = self.table[place] != waiting
            waiting, place = waiting[left], (place[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def arc(self, keys: np.ndarray) -> np.ndarray:
        """The arc of each key, or -1."""
        place = self._place(keys)
        at = self.table[place].astype(np.int64)
        waiting = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(waiting):
            place[waiting] = (place[waiting] + 1) & ((1 << self.bits) - 1)
            at[waiting] = self.table[place[waiting]]
            waiting = waiting[(at[waiting] >= 0) & (self.keys[at[waiting]] != keys[waiting])]
        return at

    def read(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray, warm: np.ndarray) -> np.ndarray:
        """Sums of weights of runs of tokens, all read at once from left to right, each with a state of its own.

        A run begins at the root; the weights of its first ``warm`` tokens, which bring it into its state, do not count.
        """
        order = np.argsort(-length, kind="stable")
        start, length, warm = start[order], length[order], warm[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        active = len(order)
        for t in range(int(length[0]) if len(length) else 0):
            while length[active - 1] <= t:
                active -= 1
            w = ids[start[:active] + t]
            now = state[:active]
            gain, to = self.root[w], self.next_root[w]
            waiting = np.flatnonzero(now)
            s = now[waiting]
            while len(waiting):
                at = self.arc(s * self.n + w[waiting])
                hit = at >= 0
                done = waiting[hit]
                gain[done] += self.weights[at[hit]] - self.root[w[done]]
                to[done] = self.following[at[hit]]
                waiting, s = waiting[~hit], s[~hit]
                gain[waiting] += self.mass[s]
                s = self.fail[s]
                waiting, s = waiting[s > 0], s[s > 0]
            total[:active] += np.where(t >= warm[:active], gain, 0)
            state[:active] = to
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


def _scores(texts: Texts, automaton: Automaton, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, base) of each piece, in units."""
    runs = -(-texts.own // LANE)
    piece = np.repeat(np.arange(len(runs)), runs)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(runs) - runs, runs)
    first = texts.before[piece] + nth * LANE
    warm = np.minimum(first, memory)
    length = np.minimum(LANE, texts.own[piece] - nth * LANE) + warm
    run = automaton.read(texts.ids, texts.start[piece] + first - warm, length, warm)
    add = lambda of, x: np.add.reduceat(x, np.cumsum(of) - of)
    return add(runs, run), add(texts.own, automaton.root[texts.ids[texts.is_own]])


ROWS = "slice long, file string, at long, size long, level int, bucket int, body binary"


def _encoded(df: DataFrame, key: str, text: str, order: int, folder: str) -> DataFrame:
    """Writes slices to files of the shared folder, one for each task; (slice, file, at, size, tokens) of each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"slices-{part:06d}"
        told: list[tuple] = []
        with committed(folder, name) as out:
            now, at, row = Slice(), 0, part << 40

            def write() -> None:
                nonlocal now, at
                body = now.body()
                out.write(body)
                told.append(((part << 32) + len(told), name, at, len(body), now.n))
                at += len(body)
                now = Slice()

            for batch in batches:
                for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    held = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0
                    before = [BEGIN]
                    waiting: list[bytes] = []
                    for words in cut(value.as_py(), _FOLD, CHUNK):
                        if waiting:
                            now.add(row, doc_id, held, before, waiting)
                            before = (before + waiting)[-max(1, order - 1) :]
                            if now.n >= SLICE_TOKENS:
                                write()
                        waiting = words
                    now.add(row, doc_id, held, before, [*waiting, END])
                    row += 1
                    if now.n >= SLICE_TOKENS:
                        write()
            if now.pieces:
                write()
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*told, strict=True)], ["slice", "file", "at", "size", "tokens"])

    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(tidy(run), "slice long, file string, at long, size long, tokens long")


def _by_slice(batches: Iterator, folder: str) -> Iterator[tuple[tuple, Texts, dict[int, list[tuple[int, bytes]]]]]:
    """((slice, file, at, size), its texts, replies by level) from rows that come ordered by slice, level and bucket."""
    fs, base = open_fs(folder)

    def load(head: tuple) -> Texts:
        with fs.open_input_file(f"{base}/{head[1]}") as f:
            f.seek(head[2])
            return Texts(f.read(head[3]))

    head, replies = None, {}
    for batch in batches:
        for slice_, file, at, size, level, bucket, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if head is None or head[0] != slice_:
                if head is not None:
                    yield head, load(head), replies
                head, replies = (slice_, file, at, size), {}
            if level:
                replies.setdefault(level, []).append((bucket, body))
    if head is not None:
        yield head, load(head), replies


def _together(bodies: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    """Bodies in lists of some SENT bytes: a batch of rows for each would cost more than its contents."""
    some, held = [], 0
    for bucket, body in bodies:
        some.append((bucket, body))
        held += len(body)
        if held >= SENT:
            yield some
            some, held = [], 0
    if some:
        yield some


def _levels(texts: Texts, replies: dict[int, list[tuple[int, bytes]]], length: int, facts: Facts) -> tuple[list[Level], np.ndarray | None, Asked | None]:
    """The levels of a slice up to ``length``, with counts as far as there are replies; the last one as it is asked."""
    levels: list[Level] = []
    number, asked = None, None
    for k in range(1, length + 1):
        levels.append(next_level(texts, levels[-1], k) if levels else first_level(texts))
        asked = Asked(texts, levels, number, facts)
        if k in replies or k < length or not len(asked.order):
            got = asked.take(replies.get(k, []), facts.hot[k] if k < len(facts.hot) else None)
            number = got if k == 1 else number
    return levels, number, asked


def score(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``df``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; each text ends with one more token. Rows whose
    CRC-32 of the key in decimal is no multiple of 10 are training texts, others are held out; a null key counts as the
    empty string (held out). Null and blank texts have the end alone. Repeated rows count and are scored each. base_score
    is the log10 probability by words alone, each count raised by 0.1; score that of the model: absolute discounting
    (0.75) interpolated down to the same word probabilities, for contexts of up to ``order`` - 1 words; contexts of two or
    more words must occur twice. Both models are whole distributions over the training words and one unknown. Very long
    texts go as several pieces. An empty table gives no rows; further columns are ignored.

    All n-grams of all training texts count. Counts meet in buckets of bounded size; an n-gram reaches its bucket once for
    each slice that holds it, contexts that are frequent are dealt over several buckets. No model is gathered anywhere.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    folder = fresh_path(spark, "lm-slices")
    manifest = stash(_encoded(df, key, text, order, folder), "lm-manifest")
    totals = manifest.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("slices")).first()
    buckets = max(1, -(-totals["tokens"] // BUCKET))
    facts = Facts(buckets)
    heads = manifest.select("slice", "file", "at", "size", F.lit(0).alias("level"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("body"))
    parts = max(1, min(totals["slices"], 20_000))
    known = heads
    answers = "slice long, file string, at long, size long, level int, bucket int, body binary, tokens long, words long, contexts array<long>, following array<long>"

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "slice").sortWithinPartitions("slice", "level", "bucket")

    hot: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
    for k in range(1, order + 1):

        def ask(batches: Iterator, k=k, facts=facts) -> Iterator:
            import pyarrow as pa

            for head, texts, replies in _by_slice(batches, folder):
                _, _, asked = _levels(texts, replies, k, facts)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                for some in _together(asked.bodies(texts)):
                    columns = [*[[v] * len(some) for v in (*head, k)], *map(list, zip(*some, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["slice", "file", "at", "size", "level", "bucket", "body"])

        def answer(batches: Iterator, k=k) -> Iterator:
            import pyarrow as pa

            def said(bucket: int, heads: list, bodies: list) -> pa.RecordBatch:
                none = [None] * len(heads)
                if k == 1:
                    out, (tokens, words) = _answer_words(bodies, bucket, buckets)
                    more = [*none[1:], tokens], [*none[1:], words], none, none
                else:
                    out, (contexts, n) = _answer(bodies, k)
                    more = none, none, [*none[1:], contexts.view(np.int64).tolist()], [*none[1:], n.tolist()]
                columns = [*map(list, zip(*heads, strict=True)), [k] * len(heads), [bucket] * len(heads), out, *more]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in answers.split(", ")])

            now, heads, bodies = None, [], []
            for batch in batches:
                for *head, _, bucket, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if bodies and bucket != now:
                        yield said(now, heads, bodies)
                        heads, bodies = [], []
                    now = bucket
                    heads.append(head)
                    bodies.append(body)
            if bodies:
                yield said(now, heads, bodies)

        asked = (gathered(known) if k > 1 else heads.repartition(parts, "slice")).mapInArrow(tidy(ask), ROWS)
        told = asked.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "slice").mapInArrow(tidy(answer), answers)
        told = stash(told, f"lm-counts-{k}")
        if k == 1:
            sums = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
            facts = Facts(buckets, sums["tokens"], sums["words"])
        else:
            inline = told.where("contexts is not null").select(F.inline(F.arrays_zip("contexts", "following")))
            rows = inline.groupBy("contexts").agg(F.sum("following").alias("n")).collect()  # bounded: see Facts
            c, n = np.array([r["contexts"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
            hot.append((c[np.argsort(c)], n[np.argsort(c)]))
            facts = Facts(buckets, facts.tokens, facts.distinct, tuple(hot))
        known = known.unionByName(told.select("slice", "file", "at", "size", "level", "bucket", "body"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, texts, replies in _by_slice(batches, folder):
            levels, _, _ = _levels(texts, replies, order, facts)
            best, base = _scores(texts, Automaton(levels, facts), order - 1)
            ids = texts.ids[texts.is_own]
            seen = np.add.reduceat((levels[0].count[ids] > 0).astype(np.int64), np.cumsum(texts.own) - texts.own)
            columns = [pa.array(texts.row, pa.int64()), pa.array(texts.key, pa.int64()), pa.array(texts.held), *[pa.array(x, pa.int64()) for x in (texts.own, seen, base, best)]]
            yield pa.RecordBatch.from_arrays(columns, ["row", "key", "held_out", "n_tokens", "n_known", "base", "best"])

    pieces = gathered(known).mapInArrow(tidy(read), "row long, key long, held_out boolean, n_tokens long, n_known long, base long, best long")
    whole = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")).cast("double") / float(UNIT)).alias(f"{c}_score")
    out = pieces.groupBy("row").agg(F.first("key").alias(key), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), whole("base"), whole("best"))
    return out.select(key, "held_out", "n_tokens", "n_known", F.lit(facts.tokens).cast("long").alias("train_tokens"), "base_score", F.col("best_score").alias("score"))


def op12_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS ws,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: x <> ''),
      lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 10 = 0 AS held
  FROM documents),
t AS (SELECT r, held, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, held, i, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), chr(9)) AS u, CASE WHEN i > 1 THEN coalesce(lag(w, 2) OVER (PARTITION BY r ORDER BY i), chr(9)) END AS s FROM t),
c1 AS (SELECT w, count(*) AS c FROM g WHERE NOT held GROUP BY w),
f AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c1),
b AS (SELECT w, c FROM c1 UNION ALL SELECT chr(9), count(*) FROM d WHERE NOT held),
c2 AS (SELECT u, w, count(*) AS c FROM g WHERE NOT held GROUP BY u, w),
n2 AS (SELECT u, count(*) AS n FROM c2 GROUP BY u),
c3 AS (SELECT s, u, w, count(*) AS c FROM g WHERE NOT held AND s IS NOT NULL GROUP BY s, u, w),
n3 AS (SELECT s, u, count(*) AS n FROM c3 GROUP BY s, u),
j AS (
  SELECT g.r, (coalesce(c1.c, 0) + 0.1::DOUBLE) / (f.n + 0.1::DOUBLE * (f.v + 1)) AS p1, coalesce(c1.c, 0) AS k1, b.c AS h2, c2.c AS k2, n2.n AS m2, x.c AS h3, c3.c AS k3, n3.n AS m3
  FROM g CROSS JOIN f LEFT JOIN c1 ON g.w = c1.w LEFT JOIN b ON g.u = b.w LEFT JOIN n2 ON g.u = n2.u LEFT JOIN c2 ON g.u = c2.u AND g.w = c2.w
    LEFT JOIN c2 x ON g.s = x.u AND g.u = x.w AND x.c >= 2 LEFT JOIN n3 ON g.s = n3.s AND g.u = n3.u LEFT JOIN c3 ON g.s = c3.s AND g.u = c3.u AND g.w = c3.w),
p AS (SELECT *, CASE WHEN h2 > 0 THEN greatest(coalesce(k2, 0) - 0.75::DOUBLE, 0) / h2 + 0.75::DOUBLE * m2 / h2 * p1 ELSE p1 END AS p2 FROM j),
l AS (
  SELECT r, k1, CAST(round(10000000000 * log10(p1)) AS BIGINT) AS l1,
    CASE WHEN h2 > 0 THEN CAST(round(10000000000 * log10(0.75::DOUBLE * m2 / h2)) AS BIGINT) ELSE 0 END AS b2, k2, CAST(round(10000000000 * log10(p2)) AS BIGINT) AS l2,
    CASE WHEN h3 > 0 THEN CAST(round(10000000000 * log10(0.75::DOUBLE * m3 / h3)) AS BIGINT) ELSE 0 END AS b3, CASE WHEN h3 > 0 THEN k3 END AS k3,
    CASE WHEN h3 > 0 THEN CAST(round(10000000000 * log10(greatest(coalesce(k3, 0) - 0.75::DOUBLE, 0) / h3 + 0.75::DOUBLE * m3 / h3 * p2)) AS BIGINT) END AS l3
  FROM p),
z AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (k1 > 0) AS n_known, sum(l1) AS base,
  sum(CASE WHEN k3 > 0 THEN l3 ELSE b3 + CASE WHEN k2 > 0 THEN l2 ELSE b2 + l1 END END) AS best FROM l GROUP BY r)
SELECT d.doc_id, d.held AS held_out, z.n_tokens, z.n_known, f.n AS train_tokens, CAST(z.base AS DOUBLE) / 1e10 AS base_score, CAST(z.best AS DOUBLE) / 1e10 AS score
FROM d JOIN z ON d.r = z.r CROSS JOIN f
"""
