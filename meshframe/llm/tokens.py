"""Token ids of whole texts, encoded word by word with bounded caches."""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np

from .substrings import Slice, distinct_words

#: The id that ends a document (query contract).
END_ID = 1
#: Characters encoded at once, and words and pieces kept; both bound a worker's memory.
SLICE_CHARS, KEPT_WORDS, KEPT_PIECES = 3 << 20, 400_000, 250_000
#: Pieces that are encoded as one text.
JOINED = 256



def _plain_class() -> tuple[str, str, str]:
    """(characters of plain words, their letters, their numbers) up to U+024F, as insides of a pattern's class.

    Plain are printable characters that NFC leaves and whose lower case is one such character too; what is a letter or a
    number is said by the Unicode category, as in the tokenizer's own split.
    """
    last = 0x24F
    some = [c for c in map(chr, range(0x21, last + 1)) if unicodedata.category(c)[0] not in "CZ" and len(c.lower()) == 1 and ord(c.lower()) <= last]
    lower = sorted({c.lower() for c in some})
    return tuple("".join(map(re.escape, x)) for x in (some, [c for c in lower if unicodedata.category(c)[0] == "L"], [c for c in lower if unicodedata.category(c)[0] == "N"]))


_ALL, _LETTERS, _NUMBERS = _plain_class()
#: Words with other characters, or with the opening of a special token, are encoded one by one.
_PLAIN = re.compile(f"[{_ALL}]*")
#: The pre-tokenizer's split for plain, lower-cased words: endings, letters, one number, or other marks.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Rows(dict):
    """Row numbers of strings; a new string gets the next one when it is first asked for."""

    def __missing__(self, key: str | bytes) -> int:
        self[key] = n = len(self)
        return n


class _Table:
    """Strings and the ids of each, in arrays that grow by doubling."""

    def __init__(self):
        self.rows = _Rows()
        self.starts, self.lengths, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = 0
        self.seen = np.zeros(1024, np.int64)

    def trim(self, most: int) -> None:
        """Halves a table that has outgrown ``most``: strings seen once go first, then those seen more rarely than others."""
        n = len(self.rows)
        if n <= most:
            return
        seen, least = self.seen[:n], 2
        while (keep := np.flatnonzero(seen >= least)).size > most // 2:
            least *= 2
        names = list(self.rows)
        ids, lengths = self.ids(keep)
        self.rows = _Rows((names[i], k) for k, i in enumerate(keep.tolist()))
        self.used = 0
        self.seen[: len(keep)], self.seen[len(keep) :] = seen[keep] // 2 + 1, 0
        self.fill(ids, lengths)

    def ask(self, keys: Sequence) -> tuple[np.ndarray, list]:
        """(row of each key, the keys that are new and must be filled in this order)."""
        before = len(self.rows)
        rows = np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))
        counts = np.bincount(rows, minlength=1)
        if len(counts) > len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros(2 * len(counts) - len(self.seen), np.int64)])
        self.seen[: len(counts)] += counts
        return rows, list(islice(reversed(self.rows), len(self.rows) - before))[::-1]

    def fill(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Ids of the next rows."""
        m, n = len(self.rows), len(self.rows) - len(lengths)
        while m > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.starts[n:m] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n:m] = lengths
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, number of each)."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[rows] - (ends - lengths), lengths) + np.arange(total)], lengths


class ChunkEncoder:
    """Ids of texts under a tokenizer that never joins text across ASCII white space.

    Such a tokenizer drops or splits at white space before it merges, so the ids of a text are those of its words one
    after another. Each distinct word is encoded once while the cache holds it. For plain text under the split of
    ``word_bpe_49k.json`` words are cut into pieces first, which repeat more, and pieces new to the cache are encoded
    many at a time: a piece ends with its only token that carries the end-of-word suffix. ``path`` is a file of the
    tokenizers library, loaded in the process that encodes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        split = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.pieced = bool(suffix) and r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in split
        # pieces are lower-cased and split already: the same model behind a split at spaces alone gives the same ids
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *[p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "ByteLevel"]]}
        self.joiner = Tokenizer.from_str(json.dumps(spec)) if self.pieced else None
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.words, self.pieces = _Table(), _Table()

    def _each(self, new: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(list(new), add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def _joined(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" ".join(new[i : i + JOINED]) for i in range(0, len(new), JOINED)]
        found = []
        for i, e in enumerate(self.joiner.encode_batch_fast(texts, add_special_tokens=False)):
            some, ids = new[i * JOINED : (i + 1) * JOINED], np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.ends[ids]) + 1
            found.append((ids, np.diff(at, prepend=0)) if len(at) == len(some) and at[-1] == len(ids) else self._each(some))
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words in the table, new ones encoded: plain ones by pieces, others one by one."""
        self.words.trim(KEPT_WORDS)
        rows, new = self.words.ask(words)
        if not new:
            return rows
        said = [w.decode("utf-8", "surrogatepass") for w in new]
        by_piece = np.fromiter((self.pieced and self._plain(w) for w in said), bool, len(said))
        lengths = np.zeros(len(said), np.int64)
        found = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        if by_piece.any():
            self.pieces.trim(KEPT_PIECES)
            cut = [[w] if w.isalpha() else _PIECE.findall(w) for w, p in zip(map(str.lower, said), by_piece.tolist(), strict=True) if p]
            parts, unknown = self.pieces.ask(list(chain.from_iterable(cut)))
            if unknown:
                self.pieces.fill(*self._joined(unknown))
            found[0], each = self.pieces.ids(parts)
            ends = np.concatenate([[0], np.cumsum(each)])
            lengths[by_piece] = np.diff(ends[np.cumsum([0, *map(len, cut)])])
        if not by_piece.all():
            found[1], lengths[~by_piece] = self._each([w for w, p in zip(said, by_piece.tolist(), strict=True) if not p])
        ids = np.empty(int(lengths.sum()), np.uint32)
        of = np.repeat(by_piece, lengths)
        ids[of], ids[~of] = found
        self.words.fill(ids, lengths)
        return rows

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, END_ID last; null is an empty text.

        Each distinct word of a slice is looked up once. Its ids depend on the word alone, not on what came before."""
        at = 0
        while at < len(texts):
            chars, end, some = 0, at, []
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= SLICE_CHARS):
                some.append(texts[end] or "")
                chars += len(some[-1])
                end += 1
            part = Slice([], [t.encode("utf-8", "surrogatepass") for t in some])
            first, of = distinct_words(part.data, part.hashes, part.starts, part.ends)
            distinct = [part.data[x:y] for x, y in zip(part.starts[first].tolist(), part.ends[first].tolist(), strict=True)]
            collects = gc.isenabled()
            gc.disable()  # the lists made here hold no cycles; a collection would walk all of them
            try:
                rows = self._rows(distinct)[of]  # may trim the table
            finally:
                if collects:
                    gc.enable()
            ids, lengths = self.words.ids(rows)
            cuts = np.concatenate([[0], np.cumsum(lengths)])[part.docs]
            out = np.insert(ids, cuts[1:], np.uint32(END_ID))
            cuts = cuts + np.arange(len(cuts))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                yield out[a:b]
            at = end

    @staticmethod
    def _plain(word: str) -> bool:
        return "<|" not in word and _PLAIN.fullmatch(word) is not None


@lru_cache(1)
def encoder(path: str) -> ChunkEncoder:
    """The encoder of this process, whose cache serves all its tasks."""
    return ChunkEncoder(path)
