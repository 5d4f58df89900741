"""Substring dedup by suffix automata over shards of the corpus.

A window is `window` consecutive words. A word goes if a window that covers it also
starts in a document with a smaller id. The reference is the corpus itself, whose size
has no bound, so its automata are not broadcast: texts meet in shards instead.

1. Seeds. The smallest hash of a window's GRAM-word shingles is its seed; equal windows
   have equal seeds. Seeds of one document only need no further look.
2. Contexts. Runs of windows with the same repeated seed, with all words they cover, go
   to that seed's shard. A task sends the words of a context once, and again only with a
   smaller id than before, so a passage that is everywhere is a few rows a task. Seeds in
   more than HOT documents are split further, so that their shards are many: each window
   goes by its own hash, which makes it the only context of its shard.
3. Shards. In the order of ids, the contexts of a shard are streamed through the suffix
   automaton of all contexts before them; matching statistics of at least `window` mark
   windows as seen. Then they are added to it. A shard holds each context once.
4. The marks return to all occurrences of a context and to their documents' texts.

Cases: a null or empty text has no words; texts shorter than a window stay whole; rows
with equal ids are one document (its rows do not remove each other's words); a null id
is never compared and keeps its text; an empty table gives an empty result; extra
columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, U, chunks, grams, mix
from .store import keep, release

WINDOW, GRAM, HOT = 13, 5, 1000
RUN = 62  # windows in a context at most: their marks are bits of a long, below its sign


class Automaton:
    """A suffix automaton to which several sequences are added."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = len(self.size)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for c in words:
            p = last
            if c in self.next[p]:
                q = self.next[p][c]
                last = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, c)
                continue
            last = len(self.size)
            self.next.append({})
            self.size.append(self.size[p] + 1)
            self.link.append(0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[last] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, c)

    def statistics(self, words: list[int]) -> list[int]:
        """For each position the length of the longest match that ends there."""
        state, got, out = 0, 0, []
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                got = self.size[state]
            if c in self.next[state]:
                state = self.next[state][c]
                got += 1
            out.append(got)
        return out


def window_seeds(texts: Texts, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; the places of windows that lie in one text; these windows' seeds."""
    h = texts.hashes()
    g = grams(h, gram)
    span = window - gram + 1
    if len(g) < span:
        return h, np.zeros(0, np.int64), np.zeros(0, U)
    m = g[: len(g) - span + 1].copy()
    for i in range(1, span):
        np.minimum(m, g[i : len(g) - span + 1 + i], out=m)
    inside = np.ones(len(m), bool)
    for e in texts.first[1:-1]:
        inside[max(0, e - window + 1) : e] = False
    at = np.flatnonzero(inside)
    return h, at, m[at]


def _seeds(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = Texts(part["text"], lower=False)
                _, at, seed = window_seeds(texts, window, gram)
                doc = np.searchsorted(texts.first, at, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(seed[new].view(np.int64)), part["doc_id"].take(pa.array(doc[new]))], ["seed", "doc_id"])

    return run


CONTEXT = "seed long, context long, doc_id long, at int, words binary"


_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)
BYTES = 6  # of a word's hash that a context carries


def prints(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of h[begin:end], from one running polynomial sum."""
    n = len(h) + 1
    up, down = (np.concatenate([[U(1)], np.cumprod(np.full(n - 1, x, U))]) for x in (_M, _INVERSE))
    sums = np.concatenate([[U(0)], np.cumsum(mix(h) * up[:-1], dtype=U)])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))


SENT = 400_000  # contexts that a task remembers


def _contexts(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, int] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = Texts(part["text"], lower=False)
                h, at, seed = window_seeds(texts, window, gram)
                doc = np.searchsorted(texts.first, at, "right") - 1
                bounds = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                kind = np.zeros(len(at), np.int8)
                for i, (few, hot) in enumerate(zip(part["seeds"], part["hots"], strict=True)):
                    a, b = bounds[i], bounds[i + 1]
                    if a < b and len(few):
                        kind[a:b][np.isin(seed[a:b], few.values.to_numpy().view(U))] = 1
                    if a < b and len(hot):
                        kind[a:b][np.isin(seed[a:b], hot.values.to_numpy().view(U))] = 2
                # runs of windows with one seed in one text, cut to RUN windows; hot ones singly
                new = np.ones(len(at) + 1, bool)
                new[1:-1] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]) | (kind[1:] == 2)
                edge = np.flatnonzero(new)
                begin, size = edge[:-1], np.diff(edge)
                some = kind[begin] > 0
                begin, size = begin[some], size[some]
                times = -(-size // RUN)
                nth = np.arange(times.sum()) - np.repeat(np.append(0, np.cumsum(times)[:-1]), times)
                first = np.repeat(begin, times) + nth * RUN
                n = np.minimum(np.repeat(size, times) - nth * RUN, RUN)
                place = at[first]
                to = place + n + window - 1
                key = seed[first].copy()
                hot_ones = kind[first] == 2
                if hot_ones.any():
                    key[hot_ones] = grams(h, window)[place[hot_ones]]
                context = prints(h, place, to)
                ids = part["doc_id"].to_numpy(zero_copy_only=False)[doc[first]] if len(first) else np.zeros(0, np.int64)
                order = np.lexsort((ids, context, key))
                lead = np.ones(len(order), bool)
                lead[1:] = (key[order][1:] != key[order][:-1]) | (context[order][1:] != context[order][:-1])
                raw = h.view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes() if len(h) else b""
                words: list[bytes | None] = [None] * len(first)
                if len(sent) > SENT:
                    sent.clear()
                leads = order[lead]
                # one number for a seed and a context: both are hashes
                for i, name, d in zip(leads.tolist(), mix(key[leads] ^ mix(context[leads])).tolist(), ids[leads].tolist(), strict=True):
                    if sent.get(name, d + 1) > d:
                        sent[name] = d
                        words[i] = raw[BYTES * place[i] : BYTES * to[i]]
                cols = [pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids, pa.int64()), pa.array((place - texts.first[doc[first]]).astype(np.int32)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["seed", "context", "doc_id", "at", "words"])

    return run


def unpack(words: bytes) -> list[int]:
    out = np.zeros((len(words) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(words, np.uint8).reshape(-1, BYTES)
    return out.view("<i8").ravel().tolist()


MARK = "seed long, context long, first_id long, marks long, n int"


def _shards(window: int):
    """Rows sorted by seed and id -> one row a context: its smallest id, and a bit for
    each of its windows that a still smaller id has."""

    def one(fresh: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, int]]:
        done = {c: (d, 0, len(w) // BYTES - window + 1) for c, d, w in fresh}
        if len(fresh) > 1:
            made, i = Automaton(), 0
            while i < len(fresh):
                j = i
                while j < len(fresh) and fresh[j][1] == fresh[i][1]:
                    j += 1
                lists = [unpack(x[2]) for x in fresh[i:j]]
                for x, words in zip(fresh[i:j], lists, strict=True):
                    if i:
                        bits = sum(1 << k for k, got in enumerate(made.statistics(words)[window - 1 :]) if got >= window)
                        done[x[0]] = (x[1], bits, len(words) - window + 1)
                if j < len(fresh):
                    for words in lists:
                        made.add(words)
                i = j
        return [(k, *v) for k, v in done.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, seen, out = None, [], set(), []

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(),) * 4 + (pa.int32(),)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["seed", "context", "first_id", "marks", "n"])
            out.clear()
            return made

        for batch in batches:
            for s, c, d, w in zip(*(batch[k].to_pylist() for k in ("seed", "context", "doc_id", "words")), strict=True):
                if s != now:
                    out.extend((now, *x) for x in one(group))
                    now, group, seen = s, [], set()
                    if len(out) >= 20_000:
                        yield batch_of()
                if c not in seen:  # the first one has the smallest id
                    seen.add(c)
                    group.append((c, d, w))
        out.extend((now, *x) for x in one(group))
        yield batch_of()

    return run


def _rewrite(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = Texts(part["text"], lower=False)
                gone = np.zeros(len(texts.begin) + 1, np.int32)
                lists = part["marks"]
                for i in np.flatnonzero(pc.is_valid(lists).to_numpy(zero_copy_only=False)).tolist():
                    base = int(texts.first[i])
                    for x in lists[i].as_py():
                        p, bits = base + x["at"], x["marks"]
                        while bits:
                            k = (bits & -bits).bit_length() - 1
                            gone[p + k] += 1
                            gone[p + k + window] -= 1
                            bits &= bits - 1
                lost = np.cumsum(gone)[:-1] > 0
                raw, kept = texts.raw.tobytes(), []
                begin, end = texts.begin.tolist(), texts.end.tolist()
                for i in range(len(texts)):
                    a, b = int(texts.first[i]), int(texts.first[i + 1])
                    stay = range(a, b) if not lost[a:b].any() else (np.flatnonzero(~lost[a:b]) + a).tolist()
                    kept.append(b" ".join([raw[begin[w] : end[w]] for w in stay]))
                n = texts.counts().astype(np.int64)
                removed = np.add.reduceat(np.append(lost, False).astype(np.int64), np.minimum(texts.first[:-1], len(lost))) * (n > 0) if len(n) else n
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (the words that
    stay, joined by one space)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    named = source.where("doc_id IS NOT NULL")
    seeds = named.mapInArrow(_seeds(window, gram), "seed long, doc_id long")
    again = keep(seeds.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("seed", (F.col("n") > hot).alias("hot")), "seeds")
    release(spark)
    hits = seeds.join(again.hint("merge"), "seed").groupBy("doc_id")
    hits = keep(hits.agg(F.collect_set(F.expr("CASE WHEN NOT hot THEN seed END")).alias("seeds"), F.collect_set(F.expr("CASE WHEN hot THEN seed END")).alias("hots")), "hits")
    release(spark)
    contexts = keep(named.join(hits, "doc_id").mapInArrow(_contexts(window, gram), CONTEXT), "contexts", compression="zstd")
    release(spark)
    shards = contexts.where("words IS NOT NULL").select("seed", "context", "doc_id", "words").repartition("seed").sortWithinPartitions("seed", "doc_id")
    marks = keep(shards.mapInArrow(_shards(window), MARK), "marks").where("seed IS NOT NULL")
    release(spark)
    every = F.when(F.col("doc_id") > F.col("first_id"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("marks"))
    seen = contexts.select("seed", "context", "doc_id", "at").join(marks, ["seed", "context"]).select("doc_id", "at", every.alias("marks")).where("marks <> 0")
    spans = keep(seen.groupBy("doc_id").agg(F.collect_list(F.struct("at", "marks")).alias("marks")), "spans")
    release(spark)
    done = source.join(spans, "doc_id", "left")
    return done.mapInArrow(_rewrite(window), "doc_id long, n_words long, n_removed long, kept_text string")
