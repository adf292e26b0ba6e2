"""Keyed tables that are merged on read: a batch appends its rows, the newest version of a key counts.

    <path>/kind=delta/batch=<n>/bucket=<b>   rows of one batch, by hash of the key
    <path>/kind=base/batch=<n>/bucket=<b>    one row per key of a bucket, all batches up to n

A batch writes its own folder and reads nothing, so its cost does not grow with the table. A folder counts when its
``_SUCCESS`` mark is there; a batch that is there already is not written again, so a replay changes nothing. Reading a set
of keys opens only their buckets: the newest base of each and the deltas after it. ``compact`` rewrites the buckets that
have deltas and then removes what the new base covers; when it stops in between, readers go by the newest base and every
key still has one row. One stream writes a table; its batch numbers are the order of versions. The column names kind,
batch and bucket are taken.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.session import child_names, path_exists, remove_path, shuffles_removed
from palisade.sinks.upsert import one_row_per_key

BUCKETS = 64
DELTA, BASE = "delta", "base"


class MergeTable:
    def __init__(self, spark: SparkSession, path: str, keys, updated=None, order=(), buckets: int = BUCKETS):
        """``updated`` columns take their newest value, the others keep their first one (None: all are updated).

        Rows of a key within one batch apply in the given ``order``. The number of buckets belongs to the stored table.
        """
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.keys, self.updated, self.order = list(keys), updated, list(order)

    def bucket(self, columns=None):
        """Bucket by the keys; with ``columns`` (name -> expression) by the expressions of the keys."""
        keys = self.keys if columns is None else [columns[k] for k in self.keys]
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.path}/kind={kind}/batch={batch}"

    def _committed(self, kind: str, batch: int) -> bool:
        return path_exists(self.spark, f"{self._folder(kind, batch)}/_SUCCESS")

    def _batches(self, kind: str) -> dict:
        """Committed batch -> its buckets."""
        found = {}
        for name in child_names(self.spark, f"{self.path}/kind={kind}"):
            batch = int(name.split("=", 1)[1])
            if self._committed(kind, batch):
                inside = child_names(self.spark, self._folder(kind, batch))
                found[batch] = {int(n.split("=", 1)[1]) for n in inside if n.startswith("bucket=")}
        return found

    def _live(self):
        """bucket -> batch of its newest base, and bucket -> batches of the deltas after it."""
        bases, deltas = {}, {}
        for batch, buckets in sorted(self._batches(BASE).items()):
            bases.update(dict.fromkeys(buckets, batch))
        for batch, buckets in sorted(self._batches(DELTA).items()):
            for b in buckets:
                if batch > bases.get(b, -1):
                    deltas.setdefault(b, []).append(batch)
        return bases, deltas

    def _write(self, rows: DataFrame, kind: str, batch: int, columns=None) -> None:
        # rebalanced: few files a bucket, and a large bucket is still written by several tasks
        placed = rows.withColumn("bucket", self.bucket(columns)).hint("rebalance", "bucket")
        if columns is not None:
            placed = placed.select(*[c.alias(n) for n, c in columns.items()], "bucket")
        # hexadecimal ids take half the room with an entropy coder
        writer = placed.write.mode("overwrite").option("compression", "zstd")
        with shuffles_removed(rows.sparkSession):
            writer.partitionBy("bucket").parquet(self._folder(kind, batch))

    def append(self, rows: DataFrame, batch: int, columns=None) -> None:
        """Store the rows of a batch, once. With ``columns`` (name -> expression) these are stored, and are made after the
        rows have moved to their buckets, so that only what they are made from moves."""
        if not self._committed(DELTA, batch):
            self._write(rows, DELTA, batch, columns)

    def stored(self, buckets=None) -> DataFrame | None:
        """All versions in some buckets (None: all), with their batch; None for a table without rows."""
        bases, deltas = self._live()
        wanted = set(bases) | set(deltas) if buckets is None else set(buckets)
        paths = [f"{self._folder(BASE, n)}/bucket={b}" for b, n in sorted(bases.items()) if b in wanted]
        paths += [f"{self._folder(DELTA, n)}/bucket={b}" for b, ns in sorted(deltas.items()) if b in wanted for n in ns]
        if not paths:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*paths)

    def _merged(self, versions: DataFrame) -> DataFrame:
        columns = [c for c in versions.columns if c not in ("kind", "batch", "bucket")]
        rank = F.struct(F.col("batch"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(self.order)])
        return one_row_per_key(versions.select(*columns, rank.alias("_rank")), self.keys, self.updated).select(*columns)

    def read(self, buckets=None) -> DataFrame | None:
        """One row per key; rows with a missing key are all kept."""
        versions = self.stored(buckets)
        return None if versions is None else self._merged(versions)

    def lookup(self, wanted: DataFrame) -> DataFrame | None:
        """The rows of some keys, from the buckets of these keys."""
        chosen = wanted.select(*self.keys).distinct()
        buckets = [r[0] for r in chosen.select(self.bucket().alias("b")).distinct().collect()]  # at most all buckets
        found = self.read(buckets)
        return None if found is None else found.join(chosen, self.keys, "left_semi")

    def compact(self) -> int:
        """Merge the deltas of every bucket that has some into a new base; returns the number of buckets rewritten."""
        _, deltas = self._live()
        if deltas:
            newest = max(n for ns in deltas.values() for n in ns)
            self._write(self.read(deltas), BASE, newest)
        self.clean()
        return len(deltas)

    def clean(self) -> None:
        """Remove what newer bases cover; readers that started before should have ended."""
        bases, deltas = self._live()
        for batch, buckets in self._batches(DELTA).items():
            if not any(batch in deltas.get(b, ()) for b in buckets):
                remove_path(self.spark, self._folder(DELTA, batch))
        for batch, buckets in self._batches(BASE).items():
            for b in buckets:
                if bases[b] > batch:
                    remove_path(self.spark, f"{self._folder(BASE, batch)}/bucket={b}")
