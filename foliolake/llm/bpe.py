"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A sequence of tokens is what the
merges make of a word exactly if that holds of every adjacent pair; so the pairs of all
new words of a batch are tested at once against a table of pairs whose own merging gave
the two tokens. Words with a failing pair are merged rank by rank.

Cases: a null text counts as empty and has no tokens; special tokens written in a text
are their ids; repeated rows and very long texts need nothing particular (a word of n
characters takes n log n at most in merging); an empty table gives an empty result;
extra columns aren't read."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .kernels import chunks
from .pieces import Cache, byte_chars, plain, word_level

END = "</w>"


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = made["model"]["vocab"]
        if max(self.vocab.values()) >= 1 << 16:
            raise ValueError("pairs are packed from ids below 65,536")
        self.ranks: dict[int, int] = {}  # a << 16 | b -> rank
        self.made: list[int] = []  # rank -> the token that the merge makes
        for rank, m in enumerate(made["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.ranks[self.vocab[left] << 16 | self.vocab[right]] = rank
            self.made.append(self.vocab[left + right])
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.reach: dict[str, int] = {}  # by a token's first characters, the longest one's length
        for t in self.vocab:
            body = t.removesuffix(END)
            self.reach[body[:3]] = max(self.reach.get(body[:3], 0), len(body))
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.alone: dict[int, bool] = {}
        self.chars = byte_chars()
        self.cache, self.mapped = Cache(), Cache()
        self.merged = self.proposed = 0

    def merge(self, s: list[int]) -> list[int]:
        """The merges rank by rank, leftmost first."""
        if len(s) > 60:
            return self._merge_long(s)
        get, made, none = self.ranks.get, self.made, len(self.made)
        s = list(s)
        ranks = [get(a << 16 | b, none) for a, b in zip(s, s[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            s[i] = made[low]
            del s[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(s[i - 1] << 16 | s[i], none)
            if i < len(ranks):
                ranks[i] = get(s[i] << 16 | s[i + 1], none)
        return s

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same in n log n: a heap of pairs over a linked list."""
        s, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(s[i] << 16 | s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if s[i] >= 0 else n
            if j >= n or self.ranks.get(s[i] << 16 | s[j]) != r:
                continue
            s[i], s[j], after[i] = self.made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (q := self.ranks.get(s[i] << 16 | s[after[j]])) is not None:
                    heapq.heappush(heap, (q, i))
            if (p := before[i]) >= 0 and (q := self.ranks.get(s[p] << 16 | s[i])) is not None:
                heapq.heappush(heap, (q, p))
        return [x for x in s if x >= 0]

    def symbols(self, token: str) -> list[int]:
        """The ids of a token's characters, the last one with its word end."""
        body = token.removesuffix(END)
        made = [*body[:-1], body[-1] + token[len(body) :]] if body else [token]
        return [self.vocab[x] for x in made if x in self.vocab]

    def propose(self, word: str) -> list[int] | None:
        """Longest matches from the left; None where a character has none."""
        out, at, n = [], 0, len(word)
        whole = word + END
        get, reach = self.vocab.get, self.reach.get
        while at < n:
            most = reach(word[at : at + 3]) or 2
            found = None
            if at + most >= n:
                found = get(whole[at:])
                to = n
            if found is None:
                for to in range(min(n - 1, at + most), at, -1):
                    found = get(word[at:to])
                    if found is not None:
                        break
                else:
                    return None
            out.append(found)
            at = to
        return out

    def _fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of adjacent ids, whether merging both together leaves them."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        new = np.unique(key[self.pairs[at] != key]) if len(self.pairs) else np.unique(key)
        if len(new):
            fits = np.empty(len(new), bool)
            for i, k in enumerate(new.tolist()):
                a, b = k >> 32, k & 0xFFFFFFFF
                fits[i] = self.merge(self.symbols(self.names[a]) + self.symbols(self.names[b])) == [a, b]
            if len(self.pairs) > 2_000_000:
                self.pairs, self.fits = self.pairs[:0], self.fits[:0]
                new = np.unique(key)
                return self._fitting(left, right)
            keys, fit = np.concatenate([self.pairs, new]), np.concatenate([self.fits, fits])
            order = np.argsort(keys)
            self.pairs, self.fits = keys[order], fit[order]
        return self.fits[np.searchsorted(self.pairs, key)]

    def _stands(self, i: int) -> bool:
        """Whether merging a token's characters gives the token."""
        if i not in self.alone:
            self.alone[i] = self.merge(self.symbols(self.names[i])) == [i]
        return self.alone[i]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of words written in byte characters."""
        made = [self.propose(w) for w in words]
        size = np.array([len(m or ()) for m in made], np.int64)
        ids = np.fromiter((i for m in made for i in m or ()), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(words)), size)
        bad = np.zeros(len(words), bool)
        bad[[i for i, m in enumerate(made) if m is None]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inner):
            bad[owner[inner[~self._fitting(ids[inner], ids[inner + 1])]]] = True
        for i in np.flatnonzero(size == 1):
            bad[i] |= not self._stands(made[i][0])
        self.proposed += len(words)
        self.merged += int(bad.sum())
        for i in np.flatnonzero(bad):
            made[i] = self.merge(self.symbols(words[i] + END))
        return made

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), " ".join([self.names[i] for i in ids])

    def _split(self, text: str) -> list[str]:
        """Pre-tokens; those of odd texts and special tokens carry a mark."""
        if "<|" not in text:
            return self._plain_or_odd(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += ["\1" + part] if part in self.special else self._plain_or_odd(part)
        return out

    def _plain_or_odd(self, part: str) -> list[str]:
        low = part.lower()  # some capitals below U+0250 have small letters above
        return word_level(low) if plain(part) and (low.isascii() or plain(low)) else ["\0" + p for p, _ in self._odd(part)]

    def _odd(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the text
        that these decode to."""
        lists = [self._split(t) for t in texts]
        new = self.cache.missing(lists)
        usual = [p for p in new if p[0] != "\1"]
        chars = self.chars
        words = [p[1:] if p[0] == "\0" else "".join([chars[b] for b in p.encode()]) for p in usual]
        for p, ids in zip(usual, self.encode_words(words), strict=True):
            self.cache[p] = self._entry(ids)
        for p in new:
            if p[0] == "\1":
                self.cache[p] = self._entry([self.special[p[1:]]])
        get, out = self.cache.__getitem__, []
        for pieces in lists:
            found = list(map(get, pieces))
            out.append((b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])))
        return out


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in chunks(batch, "text"):
                done = bpe.encode([t or "" for t in part["text"].to_pylist()])
                ids, texts = pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())
                n = pa.array([len(x[0]) // 4 for x in done], pa.int64())
                yield pa.RecordBatch.from_arrays([part["row"], n, ids, texts], ["row", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_tokens, ids (packed little-endian unsigned 32-bit
    integers) and the decoded text of every row."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    df = docs.select(row, F.col(text).cast("string").alias("text"))
    kind = df.schema["row"].dataType.simpleString()
    return df.mapInArrow(_run(path), f"row {kind}, n_tokens long, ids binary, decoded string").select("row.*", "n_tokens", "ids", "decoded")
