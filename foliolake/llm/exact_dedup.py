"""Exact dedup on a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of a text. A batch is
reduced to one row a digest, anti-joined with the index by sort-merge and what is new is
appended. The index side needs no shuffle; the batch is dealt into as many parts as the
index has buckets. (Each append adds a file to a bucket, so the join sorts the buckets,
whose files are sorted each.)

A whole table is fed in BATCHES batches from the largest ids to the smallest, so what an
earlier batch has put into the index decides which documents of the next ones stay.

Cases: a null text counts as empty; of equal texts the row with the largest doc_id
stays, a null doc_id ranking below all; rows repeated with the same id are one document
(all flagged alike; `keep_first_seen` returns one of them); an empty table gives an
empty result; extra columns stay, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import keep

#: A digest with at least this share of all rows is hot; so there are 1 / HOT_SHARE at most.
HOT_SHARE = 0.001
BATCHES, BUCKET_ROWS = 3, 4_000_000


class DigestIndex:
    """A table (digest, keep_id), one row for each digest seen so far. The number of
    buckets is set when the table is made, from the rows that are expected."""

    def __init__(self, spark: SparkSession, name: str, rows: int = 0):
        self.spark, self.name = spark, name
        self.buckets = max(8, -(-rows // BUCKET_ROWS))
        if spark.catalog.tableExists(name):
            found = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(found["data_type"])
        else:
            empty = T.StructType([T.StructField("digest", T.StringType()), T.StructField("keep_id", T.LongType())])
            self._write(spark.createDataFrame([], empty))

    def _write(self, rows: DataFrame) -> None:
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def unseen(self, digests: DataFrame) -> DataFrame:
        """One row (digest, keep_id) for each digest of (doc_id, digest) that the index
        hasn't. They are combined before they are dealt to the buckets, and written in
        between: else the optimiser would join first, with each row of a hot digest."""
        groups = keep(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "groups").repartition(self.buckets, "digest")
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, digests: DataFrame) -> DataFrame:
        """Append the digests that are new and return them; digests already there keep
        their older document."""
        fresh = keep(self.unseen(digests), "fresh")
        self._write(fresh.repartition(self.buckets, "digest"))
        return fresh


def digest_table(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, digest), written once so that texts are hashed once."""
    return keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("digest")), "digests")


def add_in_batches(index: DigestIndex, digests: DataFrame, batches: int = BATCHES) -> None:
    """Feed a table to an index, the largest ids first, null ids last."""
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(digests.approxQuantile("doc_id", shares, 0.01)), reverse=True) if shares else []
    high = F.lit(True)
    for cut in cuts:
        index.add(digests.where(high & (F.col("doc_id") >= int(cut))))
        high = F.col("doc_id") < int(cut)
    index.add(digests.where(high | F.col("doc_id").isNull()))


def flag(digests: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row with the group it is in. Rows of hot digests (a bounded number of
    digests, see HOT_SHARE) take theirs from a broadcast, all others by sort-merge."""
    total = digests.count()
    hot = groups.where(F.col("n_rows") >= max(2, HOT_SHARE * total))
    rest = groups.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    in_hot = digests.join(F.broadcast(hot), "digest")
    others = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest.hint("merge"), "digest")
    return in_hot.unionByName(others).select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def duplicates(docs: DataFrame, index_name: str, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Which id
    stays is what the index holds after all batches; the index is made new and dropped."""
    digests = digest_table(docs, text)
    index = DigestIndex(docs.sparkSession, index_name, digests.count())
    try:
        add_in_batches(index, digests, batches)
        sizes = digests.groupBy("digest").agg(F.count("*").alias("n_rows")).repartition(index.buckets, "digest")
        return flag(digests, keep(sizes.join(index.read().hint("merge"), "digest"), "groups"))
    finally:
        index.drop()


def keep_first_seen(docs: DataFrame, index_name: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents whose text no other document of the batch (with a larger id) and
    no earlier batch has; one row each, with their columns. Adds them to the index. Texts
    are moved once, by id and digest; the choice among repeated rows needs no further
    exchange."""
    digests = digest_table(docs, text, id_col)
    index = DigestIndex(docs.sparkSession, index_name, digests.count())
    none = -(2**63)  # the key of a null id, told apart by __d_null
    fresh = index.add(digests).select(F.coalesce("keep_id", F.lit(none)).alias("__d_id"), F.col("keep_id").isNull().alias("__d_null"), F.col("digest").alias("__d_digest"))
    own = F.col(id_col).cast("long")
    df = docs.withColumns({"__d_id": F.coalesce(own, F.lit(none)), "__d_null": own.isNull(), "__d_digest": F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)})
    keys = ["__d_id", "__d_null", "__d_digest"]
    df = df.join(fresh.hint("merge"), keys, "left_semi")
    one = Window.partitionBy(*keys).orderBy(F.lit(0))
    return df.withColumn("__d_n", F.row_number().over(one)).where("__d_n = 1").drop("__d_n", *keys)
