"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, stars.

1. Each text becomes its set of word-shingle hashes; texts with the same set form one
   class, of which the smallest id stands for all (so copies never meet in pairs).
2. One permutation: the 64-bit hash orders the shingles, its top bits choose one of
   BANDS x ROWS bins, each bin keeps its smallest hash. An empty bin borrows from a
   full one, chosen by its own sequence of random bins that all texts share.
3. Classes that agree in all rows of a band share a bucket. A bucket proposes a star:
   its smallest member with each other one, so pairs are linear in the bucket.
4. Pairs are confirmed on the full sets and components are joined. Most buckets are then
   within one component and done.
5. Members of buckets that still hold several components form families (documents linked
   by such buckets). Only pairs of different components are left to try, so a family's
   largest component, its core, meets the rest but not itself: the rest is cut into blocks
   of bounded size, the core too, and every block of the rest meets each other block once.
   A core document is repeated for each block of the rest only, which are few. Inverted
   lists of the shingles find the links within a pair of blocks; only links leave it. So
   every pair that shares a bucket is either tried or in one component already.

With 4 rows and 32 bands a pair at exactly the threshold 0.8 shares no bucket with
probability (1 - 0.8^4)^32 < 5e-8.

Cases: a null or empty text has no shingles and is linked with nothing; fewer words than
a shingle are one shingle; a null doc_id is left out of the links and returned as its own
row; repeated ids are one document with the larger of its sets' classes joined; an empty
table gives an empty result; extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, U, chunks, mix, shingle_sets
from .store import drop, keep, keep_at, new_path, release

BANDS, ROWS = 32, 4
PERCENT = 80
EMPTY = U(2**64 - 1)


@lru_cache(4)
def _detours(bins: int, tries: int) -> np.ndarray:
    """detours[t, i]: the bin that an empty bin i looks into at its t-th try."""
    seed = np.arange(tries, dtype=U)[:, None] * U(0x9E3779B97F4A7C15) + np.arange(bins, dtype=U)[None, :] + U(1)
    return (mix(seed) % U(bins)).astype(np.int64)


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of bins for each non-empty set."""
    out = np.full((len(sets), bins), EMPTY)
    shift = U(64 - bins.bit_length() + 1)
    for i, s in enumerate(sets):
        b = (s >> shift).astype(np.int64)
        new = np.empty(len(b), bool)
        new[0] = True
        np.not_equal(b[1:], b[:-1], out=new[1:])
        out[i, b[new]] = s[new]
    full, empty = out != EMPTY, out == EMPTY
    rows, cols = np.nonzero(empty)
    for t in range(64 * bins):
        if not len(rows):
            break
        look = _detours(bins, 64 * bins)[t, cols]
        hit = full[rows, look]
        out[rows[hit], cols[hit]] = out[rows[hit], look[hit]] + U(1)
        rows, cols = rows[~hit], cols[~hit]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=U) + U(77)), (len(sketch), bands)).copy()
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _profile(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(Texts(part["text"], lower=True), words)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                keys = np.zeros((len(sets), bands), np.int64)
                if len(some):
                    keys[some] = band_keys(sketches([sets[i] for i in some], bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32), pa.array(keys.ravel()))
                # two independent sums over the set: together a 128-bit fingerprint
                prints = [(int(mix(s).sum(dtype=U)), int(mix(s ^ U(0xD1B54A32D192ED03)).sum(dtype=U))) for s in sets]
                fp = np.array(prints, U).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n), pa.array(fp[:, 0]), pa.array(fp[:, 1]), lists], ["doc_id", "n", "f1", "f2", "keys"])

    return run


def _confirm(words: int, percent: int):
    """(u, v, ut, vt) -> the links: pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for part in chunks(batch, "vt"):
                us = part["u"].to_pylist()
                news = [i for i in range(len(us)) if us[i] != (us[i - 1] if i else last[0])]
                made = shingle_sets(Texts(part["ut"].take(pa.array(news, pa.int64())), lower=True), words)
                at, sets = dict(zip(news, made, strict=True)), []
                for i, u in enumerate(us):
                    last = (u, at[i]) if i in at else last
                    sets.append(last[1])
                good = []
                for i, (a, b) in enumerate(zip(sets, shingle_sets(Texts(part["vt"], lower=True), words), strict=True)):
                    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                        continue
                    m = np.sort(np.concatenate([a, b]), kind="stable")
                    both = int((m[1:] == m[:-1]).sum())
                    if 100 * both >= percent * (len(m) - both):
                        good.append(i)
                yield pa.RecordBatch.from_arrays([part["u"].take(pa.array(good, pa.int64())), part["v"].take(pa.array(good, pa.int64()))], ["u", "v"])

    return run


#: A half of a block pair, and the members of a star that share a task.
BLOCK_DOCS, BLOCK_SHINGLES, STAR_DOCS, SALTS = 128, 256_000, 2_000, 16


def across(sets: list[np.ndarray], labels: list[int], percent: int, halves: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets of different labels, as places; as few as join what belongs
    together. Walks the inverted lists of each set's shingles. With two halves only pairs
    across them are tried, from the smaller one; with one half all pairs are."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    posting, head = owner[order], np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))
    ends = np.append(0, np.cumsum(size))
    names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    label = np.array([names[x] for x in labels])
    half = np.array(halves if halves is not None else [0] * len(sets))
    two = len(np.unique(half)) > 1
    asked = np.flatnonzero(half == (0 if 2 * (half == 0).sum() <= len(half) else 1)) if two else np.arange(len(sets))
    links = []
    for i in asked.tolist():
        codes = code[ends[i] : ends[i + 1]]
        lengths = head[codes + 1] - head[codes]
        lengths = lengths[lengths > 0]
        starts = head[codes][head[codes + 1] > head[codes]]
        places = np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[places], minlength=len(sets))
        good = np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (label != label[i]) & ((half != half[i]) | (not two)))
        for j in good.tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _blocks(words: int, percent: int):
    """Rows of one block pair after the other -> the links found in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, labels, halves, sets = None, [], [], [], []

        def done() -> pa.RecordBatch:
            found = across(sets, labels, percent, halves) if len(set(labels)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for part in chunks(batch, "text"):
                made = shingle_sets(Texts(part["text"], lower=True), words)
                for key, d, c, h, s in zip(*(part[x].to_pylist() for x in ("block", "doc_id", "component", "half")), made, strict=True):
                    if key != now:
                        if ids:
                            yield done()
                        now, ids, labels, halves, sets = key, [], [], [], []
                    ids.append(d)
                    labels.append(c)
                    halves.append(h)
                    sets.append(s)
        if ids:
            yield done()

    return run


def _left_links(buckets: DataFrame, parts: DataFrame, sizes: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links between members of one bucket that the stars left in different components."""
    label = buckets.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = label.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("doc_id").alias("centre")).where("a <> b").select("key", "centre")
    left = keep(label.join(mixed, "key").select("centre", "doc_id", "component").distinct(), "left")
    if left.isEmpty():
        return None
    family = components(left.select(F.col("centre").alias("u"), F.col("doc_id").alias("v"))).withColumnsRenamed({"id": "doc_id", "component": "family"})
    member = keep(left.select("doc_id", "component").distinct().join(family, "doc_id").join(sizes, "doc_id"), "family")
    # of each family its core and the numbers of blocks, from sums of components; families are
    # joined in SALTS parts, so that a large one is not one task's
    per = member.groupBy("family", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    core = per.groupBy("family").agg(F.max(F.struct("docs", "component", "n")).alias("core"), F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    cut = lambda docs, n: F.ceil(F.greatest(docs / BLOCK_DOCS, n / BLOCK_SHINGLES)).cast("int")
    info = core.select("family", F.col("core.component").alias("core"), cut(F.col("docs") - F.col("core.docs"), F.col("n") - F.col("core.n")).alias("r"), cut(F.col("core.docs"), F.col("core.n")).alias("c"))
    info = info.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = member.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int")).join(info.hint("merge"), ["family", "salt"]).withColumn("rest", F.col("component") != F.col("core"))
    placed = placed.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("c"))).cast("int"))
    # the core's blocks are numbered after the rest's; a pair of blocks has one key
    own = F.col("b") + F.when(F.col("rest"), 0).otherwise(F.col("r"))
    others = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("r") + F.col("c") - 1)).otherwise(F.sequence(F.lit(0), F.col("r") - 1))
    dealt = placed.select("doc_id", "component", "family", own.alias("b"), F.explode(others).alias("o"))
    dealt = dealt.select("doc_id", "component", F.concat_ws(":", "family", F.least("b", "o"), F.greatest("b", "o")).alias("block"), (F.col("b") > F.col("o")).cast("int").alias("half"))
    rows = dealt.join(source, "doc_id").repartition("block").sortWithinPartitions("block", "doc_id")
    return rows.select("block", "doc_id", "component", "half", "text").mapInArrow(_blocks(words, percent), "u long, v long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, v) -> (id, component): the smallest id reachable, for ids with a link.
    Alternating large-star and small-star steps; each halves the depth of the trees
    and writes its table, so no lineage grows and nothing is collected. The table before
    goes when the next one is written. Without an end in `rounds` steps this raises."""
    spark = edges.sparkSession
    at, before = new_path(spark, "edges"), None
    pairs = keep_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), at)
    for _ in range(rounds):
        # an edge's smaller end gives its larger end its own smallest neighbour. That end may be
        # one root of very many edges, so it is met in SALTS parts
        less = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        parted = pairs.withColumn("s", F.pmod(F.xxhash64("u", F.lit(2)), F.lit(SALTS)).cast("int"))
        large = parted.join(less.hint("merge"), ["v", "s"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, at = at, new_path(spark, "stars")
        pairs = keep_at(small.where("u <> v").distinct(), at)
        drop(spark, old)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = keep(source.mapInArrow(_profile(words, bands, rows), "doc_id long, n long, f1 long, f2 long, keys array<bigint>"), "profile")
    known = profile.where("doc_id IS NOT NULL AND n > 0")
    # classes of equal sets; the representative brings its band keys
    classes = keep(known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    member = known.select("doc_id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    member = keep(member, "member")
    keys = known.select("doc_id", F.explode("keys").alias("key")).join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct()
    centre = keys.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("size")).where("size > 1").select("key", "centre")
    buckets = keep(keys.join(centre, "key"), "buckets")
    tries = keep(buckets.where("doc_id <> centre").select(F.col("centre").alias("u"), F.col("doc_id").alias("v")).distinct(), "tries")
    release(spark)
    used = tries.select("u").union(tries.select("v")).distinct()
    body = keep(source.join(used.withColumnRenamed("u", "doc_id").hint("merge"), "doc_id", "left_semi"), "bodies")
    release(spark)
    # a large star is cut into parts of STAR_DOCS members, each with the centre's text
    stars = keep(tries.groupBy("u").agg(F.ceil(F.count("*") / STAR_DOCS).cast("int").alias("g")), "centres")
    parted = tries.join(stars.hint("merge"), "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("g")).cast("int").alias("s"))
    pairs = parted.join(body.select(F.col("doc_id").alias("v"), F.col("text").alias("vt")), "v")
    centres = stars.join(body.select(F.col("doc_id").alias("u"), F.col("text").alias("ut")), "u").select("u", "ut", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("s"))
    pairs = pairs.join(centres, ["u", "s"])
    links = keep(pairs.select("u", "v", "ut", "vt").mapInArrow(_confirm(words, percent), "u long, v long"), "links")
    release(spark)
    more = _left_links(buckets, keep(components(links), "parts"), known.select("doc_id", "n"), body, words, percent)
    links = links.unionByName(keep(more, "more")) if more is not None else links
    every = components(links.unionByName(member))
    out = profile.select("doc_id", F.col("n").alias("n_shingles")).join(every.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_each(docs: DataFrame, words: int = 5, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents without the near copies of another one with a smaller id."""
    gone = near_duplicates(docs, words, text=text, id_col=id_col).where("NOT kept").select(F.col("doc_id").alias("__m_id")).distinct()
    return docs.join(keep(gone, "gone"), F.col(id_col).cast("long") == F.col("__m_id"), "left_anti")
