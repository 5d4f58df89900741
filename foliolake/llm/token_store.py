"""Token ids in Parquet: one list a document, in ascending doc_id order.

Documents are ranged and sorted by doc_id, encoded, and written with dictionary-encoded
lists, row groups of a set size and page indexes. A reader can take the metadata columns
alone, or the row groups and pages of some ids. `start` counts the ids of all documents
before one: a running sum in its shard plus the sum of the shards before.

The model of the tokenizers library encodes each distinct pre-token once while it is
remembered; texts outside the characters that `pieces` knows go through the library whole.

Cases: a null text counts as empty (the end id only); rows with equal doc_id keep the
order in which they were written, null ids come first; an empty table writes no rows;
extra columns aren't read."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import chunks
from .pieces import byte_chars, byte_level, plain

END_ID = 2
SCHEMA = "doc_id long, n_tokens long, ids array<int>"


class Memo(dict):
    """Pre-token -> its ids, made when first asked for. Of two generations the older one
    goes when the younger is full; what is asked for again moves to the younger."""

    def __init__(self, make: Callable[[str], bytes], most: int = 400_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or self.make(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class ByteBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores have tasks of their own
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.bytes = dict(enumerate(byte_chars()))
        self.cache = Memo(self._piece_ids)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, piece: str) -> bytes:
        """The library's model takes the characters that stand for the pre-token's bytes.
        Visible ASCII stands for itself, and blanks come first in a pre-token or alone."""
        if piece.isascii() and not piece.isspace():
            shown = self.bytes[32] + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode().decode("latin-1").translate(self.bytes)
        return array("i", [t.id for t in self.merge(shown)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        usual = [plain(t) and "<|" not in t for t in texts]
        odd = iter(self._ids([t for t, u in zip(texts, usual, strict=True) if not u]))
        get = self.cache.__getitem__
        return [b"".join(map(get, byte_level(t))) if u else next(odd) for t, u in zip(texts, usual, strict=True)]


@lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = load(path), np.array([end], "<i4").tobytes()
        for batch in batches:
            for part in chunks(batch, "text"):
                done = [x + last for x in bpe.encode([t or "" for t in part["text"].to_pylist()])]
                size = np.array([len(x) // 4 for x in done], np.int64)
                flat = np.frombuffer(b"".join(done), np.int32)
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(size), lists], ["doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end: int = END_ID, group_bytes: int = 16 << 20, page_rows: int = 2_000, text: str = "text") -> None:
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    df = df.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    df = df.mapInArrow(_encode(path, end), SCHEMA).select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("row"), "doc_id", "n_tokens", "ids")
    # dictionary pages hold a group's distinct ids; page indexes are written with each file
    df.write.options(**{"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.block.size": str(group_bytes), "parquet.page.row.count.limit": str(page_rows), "compression": "snappy"}).parquet(to)


def read_starts(spark: SparkSession, where: str) -> DataFrame:
    """Metadata only: shard, row, doc_id, n_tokens, start."""
    return with_starts(spark.read.parquet(where).select("shard", "row", "doc_id", "n_tokens"), spark, where)


def read_documents(spark: SparkSession, where: str, first: int, last: int, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Documents of a range of ids: the filter reaches the scan, where the row groups and
    pages whose ids lie outside are skipped, and only the named columns are read."""
    return spark.read.parquet(where).where(F.col("doc_id").between(first, last)).select(*columns)


def with_starts(rows: DataFrame, spark: SparkSession, where: str) -> DataFrame:
    """Adds start to rows (shard, row, n_tokens, ...). The shards' sums are one row a
    shard, so few that they are sorted together and broadcast."""
    sums = spark.read.parquet(where).groupBy("shard").agg(F.sum("n_tokens").alias("sum"))
    before = sums.select("shard", F.coalesce(F.sum("sum").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(F.broadcast(before), "shard").withColumn("start", F.col("base") + F.col("inside")).drop("inside", "base")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["ids"]
        at = lists.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["shard"], batch["row"], batch["doc_id"], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "row", "doc_id", "n_tokens", "ids_crc32"])


def digest_tokens(spark: SparkSession, where: str) -> DataFrame:
    """What the files hold of each document: doc_id, start, n_tokens, ids_crc32."""
    rows = spark.read.parquet(where).select("shard", "row", "doc_id", "ids").mapInArrow(_crc, "shard int, row long, doc_id long, n_tokens long, ids_crc32 long")
    return with_starts(rows, spark, where).select("doc_id", "start", "n_tokens", "ids_crc32")
