"""Tables stored by key: a feed rewrites only the parts it touches, and the stored side is never shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from millrace.common import all_of, durable
from millrace.operators.cdc import apply_changes, reduce_changes

PART = "_part"

#: Option of the table itself: an overwrite replaces the parts it writes, whatever the session's setting.
BY_PART = ("partitionOverwriteMode", "dynamic")


class StoredByKey:
    """Parquet table in ``parts`` folders by key hash, each in ``buckets`` files by key.

    The folders say what to rewrite; the buckets give a scan the partitioning of a join, so that only
    the feed is shuffled to it. ``parts`` and ``buckets`` are fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, keys: Sequence[str], parts: int = 64, buckets: int = 8):
        self.spark, self.name, self.path = spark, name, path.rstrip("/")
        self.keys, self.parts, self.buckets = list(keys), parts, buckets

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _laid_out(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, self.part())

    def create(self, df: DataFrame) -> None:
        """Store ``df``; one file per part and bucket."""
        self._laid_out(df).repartition(self.buckets, *self.keys).write.format("parquet").option("path", self.path).option(
            *BY_PART).partitionBy(PART).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name)

    def attach(self, schema: str) -> None:
        """Make a stored table known to another session."""
        self.spark.sql(
            f"create table if not exists {self.name} ({schema}, {PART} int) using parquet options ('{BY_PART[0]}' '{BY_PART[1]}') "
            f"partitioned by ({PART}) clustered by ({', '.join(self.keys)}) sorted by ({', '.join(self.keys)}) into {self.buckets} buckets location '{self.path}'")
        self.spark.catalog.recoverPartitions(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop(PART)

    def touched(self, feed: DataFrame) -> list[int]:
        """Parts that hold keys of ``feed``: at most ``parts`` numbers."""
        return sorted(r[0] for r in feed.select(self.part()).distinct().collect())

    def _stored(self, parts: Sequence[int]) -> DataFrame:
        """Folders with these numbers: others are not listed, let alone read."""
        return self.spark.table(self.name).where(F.col(PART).isin(list(parts)))

    def rewrite(self, rows: DataFrame, parts: Sequence[int], emptied: bool = True) -> None:
        """Replace whole parts by ``rows``. New files are written beside the old ones and take their place at the end.

        ``emptied``: whether parts can be without rows now; their folders go.
        """
        columns = self.spark.table(self.name).columns
        left = {r[0] for r in rows.select(self.part()).distinct().collect()} if emptied else set(parts)
        self._laid_out(rows).select(*columns).write.mode("overwrite").insertInto(self.name)
        for p in sorted(set(parts) - left):
            self.spark.sql(f"alter table {self.name} drop if exists partition ({PART}={p})")
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={p}")
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def merged(self, feed: DataFrame, parts: Sequence[int], seq: str = "seq", op: str = "op") -> DataFrame:
        """Rows of ``parts`` after the changes of ``feed``."""
        last = reduce_changes(feed, self.keys, seq)
        return apply_changes(self._stored(parts).drop(PART), self._dealt(last), self.keys, seq, op)

    def _dealt(self, few: DataFrame) -> DataFrame:
        """The smaller side of a join in as many partitions as the table has buckets, so that it alone is shuffled."""
        return few.repartition(self.buckets, *self.keys)

    def apply(self, feed: DataFrame, seq: str = "seq", op: str = "op") -> list[int]:
        """Apply a change feed (latest change per key wins, ``D`` removes); returns the parts rewritten."""
        parts = self.touched(feed)
        if parts:
            self.rewrite(self.merged(feed, parts, seq, op), parts)
        return parts

    def upsert(self, feed: DataFrame, seq: str) -> list[int]:
        """Keep the row with the highest ``seq`` of every key, stored or new; returns the parts rewritten.

        The order of arrival does not matter, and a feed applied twice changes nothing: so it serves a stream's
        batches, removed keys staying as marked rows. The first feed makes the table.
        """
        if not self.spark.catalog.tableExists(self.name):
            self.create(reduce_changes(feed, self.keys, seq))
            return list(range(self.parts))
        parts = self.touched(feed)
        if parts:
            columns = [c for c in feed.columns if c not in self.keys]
            whole = all_of([F.col(k).isNotNull() for k in self.keys])
            stored = self._stored(parts)
            new = self._dealt(reduce_changes(feed.where(whole), self.keys, seq)).select(*self.keys, F.struct(*columns).alias("_new"))
            old = stored.where(whole).select(*self.keys, F.struct(*columns).alias("_old"))
            later = F.col("_old").isNull() | (F.col(f"_new.{seq}") >= F.col(f"_old.{seq}"))
            row = F.when(F.col("_new").isNotNull() & later, F.col("_new")).otherwise(F.col("_old"))
            merged = old.join(new, self.keys, "full_outer").select(*self.keys, row.alias("_row")).select(*self.keys, "_row.*")
            # NULL keys equal nothing in a join; there is one row for each combination with them.
            lacking = stored.where(~whole).select(*self.keys, *columns).unionByName(feed.where(~whole).select(*self.keys, *columns))
            merged = merged.unionByName(reduce_changes(lacking, self.keys, seq).select(*merged.columns))
            self.rewrite(merged, parts, emptied=False)
        return parts

    def keep_current(self, stream: DataFrame, seq: str) -> DataStreamWriter:
        """Apply a stream of changes, or of running aggregates in update mode, batch by batch."""
        return stream.writeStream.foreachBatch(lambda batch, _: self._on_batch(batch, seq))

    def _on_batch(self, batch: DataFrame, seq: str) -> None:
        rows = durable(batch)
        if rows.head(1):
            self.upsert(rows, seq)

    def erase(self, requests: DataFrame) -> list[int]:
        """Remove the keys of ``requests``; returns the parts rewritten."""
        asked = self._dealt(requests.select(*self.keys).distinct())
        parts = self.touched(asked)
        if parts:
            self.rewrite(self._stored(parts).drop(PART).join(asked, self.keys, "left_anti"), parts)
        return parts
