"""Tables cut to buckets by the hash of a key, with a list of the folders that hold the live rows of each bucket.

A batch writes folders of its own and then the list as it is after the batch, so readers see a batch wholly or not at all, a batch that
is repeated replaces what it wrote, and no folder is ever changed in place. A reader that wants some buckets opens their folders only,
and never lists the table. Folders that no list of the last batches names can be deleted.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Live folders of a bucket from which on an appending batch puts them together.
FAN = 8


@dataclass
class BucketTable:
    """``schema`` names the columns, ``key`` the one whose hash chooses the bucket; ``n_buckets`` is fixed for the life of the table."""

    spark: SparkSession
    folder: str
    schema: str
    key: str
    n_buckets: int = 64
    #: The list that this object wrote last, with the number of its batch.
    _last: tuple[int, list[tuple[int, str]]] | None = None
    #: Folders opened by the last :meth:`read`, for those who count bytes.
    opened: list[str] = field(default_factory=list)

    def bucket(self, key: Column | None = None) -> Column:
        declared = StructType.fromDDL(self.schema)[self.key].dataType
        return F.pmod(F.xxhash64((F.col(self.key) if key is None else key).cast(declared)), F.lit(self.n_buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, key: str | None = None) -> list[int]:
        """The buckets of the keys of ``rows``: at most ``n_buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket(F.col(key or self.key))).distinct().collect())

    def live(self, before: int | None = None) -> list[tuple[int, str]]:
        """``(bucket, folder)`` after the last batch, or after the last one before ``before``; a table has one writer at a time."""
        if self._last and (before is None or self._last[0] < before):
            return self._last[1]
        try:
            lists = self.spark.read.schema("bucket int, folder string, batch_id bigint").option("basePath", f"{self.folder}/live").parquet(f"{self.folder}/live")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        lists = lists if before is None else lists.filter(F.col("batch_id") < before)
        last = lists.agg(F.max("batch_id")).first()[0]
        if last is None:
            return []
        # At most FAN folders for each bucket; the row without a bucket marks a batch after which nothing is live.
        return sorted((r.bucket, r.folder) for r in lists.filter(F.col("batch_id") == last).collect() if r.bucket is not None)

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The live rows of some buckets, or of all."""
        return self._open([(b, f) for b, f in self.live(before) if buckets is None or b in set(buckets)])

    def _open(self, live: list[tuple[int, str]]) -> DataFrame:
        self.opened = [f"{self.folder}/{f}" for _, f in live]
        return self.spark.read.schema(self.schema).parquet(*self.opened) if live else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, batch_id: int) -> list[int]:
        """Add rows of a written table. Buckets that already have :data:`FAN` folders are put together with them, so a bucket's folders stay few; returns those."""
        rows, live = self._typed(rows), self.live(batch_id)
        touched, folders = self.buckets_of(rows), Counter(b for b, _ in live)
        full = {b for b in touched if folders[b] >= FAN}
        old = self._open([(b, f) for b, f in live if b in full])
        self._write(rows.unionByName(old) if full else rows, touched, [(b, f) for b, f in live if b not in full], batch_id)
        return sorted(full)

    def upsert(self, rows: DataFrame, batch_id: int) -> list[int]:
        """Rows of a written table replace those of the same key; one row per key is expected. Only buckets with such rows are read and written again; returns them."""
        rows, live = self._typed(rows), self.live(batch_id)
        touched = self.buckets_of(rows)
        old = [(b, f) for b, f in live if b in set(touched)]
        kept = self._open(old).join(rows.select(self.key), self.key, "left_anti").unionByName(rows) if old else rows
        self._write(kept, touched, [(b, f) for b, f in live if b not in set(touched)], batch_id)
        return touched

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.schema)))

    def _write(self, rows: DataFrame, touched: list[int], kept: list[tuple[int, str]], batch_id: int) -> None:
        name = f"data/batch={batch_id}"
        placed = rows.withColumn("bucket", self.bucket())
        # One file per bucket of moderate size; AQE cuts larger ones.
        placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        live = kept + [(b, f"{name}/bucket={b}") for b in touched]
        listed = self.spark.createDataFrame(live or [(None, None)], "bucket int, folder string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/live/batch_id={batch_id}")
        self._last = (batch_id, sorted(live))
