"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact scores
by the scaled forward recursion.

Latent states emit word classes, a class emits its words by their training counts. The
OWN most frequent words are a class each, all others share HASHED classes by their hash;
so what every task holds (transitions, emissions, at most HEAD of the most frequent words'
counts) has a size that the parameters bound. Counts of rarer words are joined by a
shuffle, so none is cut off.

Every round of training reads every training text whole. Rounds end when the likelihood
grows by less than GAIN of itself, after ROUNDS at most. Texts over LONG tokens are cut
into pieces that run side by side: the products of a piece's transitions carry the forward
state to its begin and the backward state to its end, so the counts are those of the text
as one sequence. Scores run over whole texts.

Cases: a null or empty text has its end token only; a null doc_id counts as the text ''
when it is assigned to a fold; rows repeated with an id are scored one by one (and count
as often in training); without training texts every count is zero and the model is
uniform; an empty table gives an empty result; extra columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, U, chunks, mix
from .store import keep, release

STATES, OWN, HASHED, HEAD = 8, 2048, 512, 1 << 18
ROUNDS, GAIN, LONG, PIECE = 6, 1e-4, 1024, 256
END = np.int64(0x1E57_0F7E_47)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text; the texts' bounds in them."""
    h = texts.hashes().view(np.int64)
    return np.insert(h, texts.first[1:], END), texts.first + np.arange(len(texts) + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, of = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(of, np.concatenate([c for _, c in held])).astype(np.int64)

    for batch in batches:
        for part in chunks(batch, "text"):
            held.append(np.unique(tokens(Texts(part["text"], lower=True))[0], return_counts=True))
            if len(held) >= 16:
                held[:] = [merged()]
                if len(held[0][0]) > 1_000_000:
                    words, count = held.pop()
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(count)], ["word", "c"])
    if held:
        words, count = merged()
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(count)], ["word", "c"])


@dataclass
class Vocabulary:
    """The most frequent words: sorted hashes, counts, classes."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes, and counts (-1 where a word isn't here)."""
        if not len(self.words):
            return other_class(h), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        there = self.words[at] == h
        return np.where(there, self.classes[at], other_class(h)), np.where(there, self.counts[at], -1)


def other_class(h: np.ndarray) -> np.ndarray:
    return (OWN + mix(h.view(U)) % U(HASHED)).astype(np.int64)


CODED = "doc_id long, train boolean, n_tokens long, n_known long, head_sum double, classes binary, tail array<bigint>"


def _code(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, at = tokens(Texts(part["text"], lower=True))
                classes, c = vocabulary.look(h)
                raw, tail = classes.astype("<u2").tobytes(), c < 0
                known = np.add.reduceat(c > 0, at[:-1], dtype=np.int64)
                logs = np.add.reduceat(np.log10(np.maximum(c, 0) + 1.0), at[:-1])
                ends = np.append(0, np.cumsum(tail))[at].astype(np.int32)
                bounds = (2 * at).tolist()
                cols = [part["doc_id"], part["train"], pa.array(np.diff(at).astype(np.int64)), pa.array(known), pa.array(logs)]
                cols += [pa.array([raw[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(h[tail]))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "train", "n_tokens", "n_known", "head_sum", "classes", "tail"])

    return run


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    @classmethod
    def first(cls, mass: np.ndarray, states: int) -> Model:
        """The classes' shares, disturbed differently in every state."""
        noise = np.random.default_rng(11).random((len(mass), states)) ** 2 + 0.05
        emit = (mass[:, None] + 0.01) * noise
        return cls(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(0))

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, mass: np.ndarray) -> Model:
        """From expected counts, smoothed; a class's share of all tokens is its prior."""
        move, emit, start = move + 0.5, emit + 5 * ((mass + 0.01) / (mass + 0.01).sum())[:, None], start + 0.5
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest first; how many are still running at each step."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")


def forward(model: Model, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence flat[at[i]:at[i + 1]]; all run side by side."""
    lengths = np.diff(at)
    order, running = _grid(lengths)
    begin, total = at[:-1][order], np.zeros(len(lengths))
    a = np.broadcast_to(model.start, (len(lengths), len(model.start)))
    for t, n in enumerate(running.tolist()):
        a = (a[:n] if t == 0 else a[:n] @ model.move) * model.emit[flat[begin[:n] + t]]
        scale = a.sum(1)
        total[:n] += np.log10(scale)
        a = a / scale[:, None]
    out = np.empty(len(lengths))
    out[order] = total
    return out


def _pieces(model: Model, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Begin, length, whether it begins a text, forward state before and backward state
    after (not scaled) of every piece."""
    states = len(model.start)
    size = np.diff(at)
    times = np.where(size > LONG, -(-size // PIECE), 1)[size > 0]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    begin = np.repeat(at[:-1][size > 0], times) + nth * PIECE
    length = np.diff(np.append(begin, at[-1]))
    entry, leave = np.broadcast_to(model.start, (len(begin), states)).copy(), np.ones((len(begin), states))
    cut = np.flatnonzero(np.repeat(times, times) > 1)
    if len(cut):
        order, running = _grid(length[cut])
        where, opens = begin[cut][order], (nth[cut] == 0)[order]
        product = np.where(opens[:, None, None], np.eye(states), model.move)
        for t, n in enumerate(running.tolist()):
            if t:
                product[:n] = (product[:n].reshape(-1, states) @ model.move).reshape(-1, states, states)
            product[:n] *= model.emit[flat[where[:n] + t]][:, None, :]
            product[:n] /= product[:n].sum((1, 2), keepdims=True)
        of = np.empty_like(product)
        of[order] = product
        last = len(cut) - 1
        for i, k in enumerate(cut.tolist()):
            if i < last and nth[cut[i + 1]]:
                v = entry[k] @ of[i]
                entry[k + 1] = v / v.sum()
        for i in range(last, 0, -1):
            k = cut[i]
            if nth[k]:
                v = of[i] @ leave[k]
                leave[k - 1] = v / v.sum()
    return begin, length, nth == 0, entry, leave


def expect(model: Model, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, moves and emissions of the sequences, and their log
    likelihood."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    if not len(flat):
        return start, move, emit, 0.0
    begin, lengths, opens, entry, leave = _pieces(model, flat, at)
    order, running = _grid(lengths)
    begin, opens, entry, leave = begin[order], opens[order], entry[order], leave[order]
    likes, alphas, scales, total = [], [], [], 0.0
    a = np.where(opens[:, None], entry, entry @ model.move)
    for t, n in enumerate(running.tolist()):
        e = model.emit[flat[begin[:n] + t]]
        a = (a[:n] if t == 0 else a[:n] @ model.move) * e
        s = a.sum(1, keepdims=True)
        a = a / s
        total += float(np.log(s).sum())
        likes.append(e)
        alphas.append(a)
        scales.append(s)
    b = np.ones((0, states))
    for t in range(len(alphas) - 1, -1, -1):
        n, m = len(alphas[t]), len(b)
        full = np.empty((n, states))
        full[m:] = leave[m:n] / (alphas[t][m:] * leave[m:n]).sum(1, keepdims=True)
        if m:
            ahead = likes[t + 1] * b / scales[t + 1]
            move += model.move * (alphas[t][:m].T @ ahead)
            full[:m] = ahead @ model.move.T
        b = full
        if t == 0:
            inner = ~opens
            move += model.move * (entry[inner].T @ (likes[0] * b / scales[0])[inner])
        alphas[t] = alphas[t] * b
    start += alphas[0][opens].sum(0)
    gamma = np.concatenate(alphas)
    where = flat[np.concatenate([begin[: len(x)] + t for t, x in enumerate(alphas)])]
    for k in range(states):
        emit[:, k] += np.bincount(where, gamma[:, k], len(emit))
    return start, move, emit, total


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All classes in one array, and each row's bounds in it, from the column's buffers."""
    lists = lists.cast(pa.large_binary())
    at = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    raw = np.frombuffer(lists.buffers()[2], np.uint8)[at[0] : at[-1]] if len(lists) and lists.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw.view("<u2").astype(np.int64), (at - at[0]) // 2 if len(lists) else np.zeros(1, np.int64)


def _blocks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    size, i = np.cumsum(batch["n_tokens"].to_numpy()), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def _expected(model: Model):
    states = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in _blocks(batch, 400_000):
                *counts, like = expect(model, *_flat(part["classes"]))
                got = np.vstack([*(np.atleast_2d(x) for x in counts), np.full((1, states), like)])
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(total[:, k]) for k in range(states)]], ["i", *[f"s{k}" for k in range(states)]])

    return run


def _scores(model: Model, log_mass: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, 1_000_000):
                flat, at = _flat(part["classes"])
                within = np.add.reduceat(log_mass[flat], at[:-1]) if len(flat) else np.zeros(0)
                kept = [part[c] for c in ("row", "doc_id", "train", "n_tokens", "n_known", "head_sum")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(forward(model, flat, at)), pa.array(within)], ["row", "doc_id", "train", "n_tokens", "n_known", "head_sum", "hmm", "class_sum"])

    return run


def train(coded: DataFrame, mass: np.ndarray, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[Model, list[float]]:
    """The model, and the log likelihood of all training texts at the begin of each round.
    A round's sums are one table of the model's size, added up over all partitions."""
    model, classes, likes = Model.first(mass, states), len(mass), []
    rows = coded.where("train").select("classes", "n_tokens")
    for _ in range(rounds):
        sums = rows.mapInArrow(_expected(model), "i int, " + ", ".join(f"s{k} double" for k in range(states)))
        got = sums.groupBy("i").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).collect()
        if not got:
            break
        table = np.zeros((2 + states + classes, states))
        for r in got:
            table[r["i"]] = r[1:]
        model = Model.of(table[0], table[1 : 1 + states], table[1 + states : -1], mass)
        likes.append(float(table[-1, 0]))
        if len(likes) > 1 and likes[-1] - likes[-2] < gain * abs(likes[-2]):
            break
    return model, likes


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Words of (word, c) that are as frequent as the `most` first ones, at most so many:
    words are counted by classes of their counts (some hundreds, whatever the table), and
    whole classes are taken from the top. No task holds more than its own words."""
    step = F.floor(F.log2("c") * 16)
    held = sorted(counts.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect(), reverse=True)
    low, total = float("inf"), 0
    for k, n in held:
        total += n
        if total > most:
            break
        low = k
    return counts.where(step >= low) if held and low != float("inf") else counts.where("false")


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score, both log10 probabilities of the text."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (~held_out(F.col("doc_id"))).alias("train"))
    counts = keep(source.where("train").select("text").mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    release(spark)
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    head = most_frequent(counts, HEAD).toArrow()  # a size that the parameter bounds
    words, c = head["word"].to_numpy(), head["c"].to_numpy()
    order = np.lexsort((words, -c))
    words, c = words[order], c[order]
    classes = np.where(np.arange(len(words)) < OWN, np.arange(len(words)), other_class(np.ascontiguousarray(words)))
    order = np.argsort(words)
    vocabulary = Vocabulary(words[order], c[order], classes[order])
    # each class's mass over all words: own classes from the head, others by the whole table
    mass = np.zeros(OWN + HASHED)
    own = min(OWN, len(words))
    mass[:own] = c[:own] + 1.0
    shared = counts.select("word", "c").mapInArrow(_class_mass(set(words[:own].tolist())), "i int, m double").groupBy("i").agg(F.sum("m").alias("m")).collect()
    for r in shared:
        mass[OWN + r["i"]] = r["m"]
    mass[OWN:] += 1.0  # one unknown word in each
    coded = source.mapInArrow(_code(vocabulary), CODED).select(F.monotonically_increasing_id().alias("row"), "*")
    coded = keep(coded, "coded", compression="zstd")
    model, _ = train(coded, mass, states, rounds)
    narrow = coded.select("row", "doc_id", "train", "n_tokens", "n_known", "head_sum", "classes")
    main = narrow.mapInArrow(_scores(model, np.log10(np.maximum(mass, 1.0))), "row long, doc_id long, train boolean, n_tokens long, n_known long, head_sum double, hmm double, class_sum double")
    rare = coded.select("row", F.explode("tail").alias("word")).join(counts.hint("merge"), "word").groupBy("row")
    rare = rare.agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("rare_sum"))
    both = F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0))
    return main.join(rare, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (both - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), (F.col("hmm") + both - F.col("class_sum")).alias("score"),
    )


def _class_mass(own: set[int]):
    owned = np.array(sorted(own), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(HASHED)
        for batch in batches:
            w, c = batch["word"].to_numpy(), batch["c"].to_numpy()
            rest = ~np.isin(w, owned)
            total += np.bincount(other_class(np.ascontiguousarray(w[rest])) - OWN, c[rest] + 1.0, HASHED)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(HASHED, dtype=np.int32)), pa.array(total)], ["i", "m"])

    return run
