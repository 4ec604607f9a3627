"""Keyed tables that grow by batches: written runs, each with a key once, merged so that there are few.

A batch is a run of its own; two neighbours are merged when the later one is no
less than half as large, so a row is rewritten about log2(rows) times in all, and
a read meets about log2(rows) runs, whatever the number of batches. Runs are
parquet folders named by the first and last batch that they hold, and count once
they are committed whole; a large run is split by a prefix of its keys' digests,
so that a look-up of few keys reads few of its files.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket of a run, about; buckets are 1, 16 or 256.
BUCKET_ROWS = 100_000
_BUCKET = "run_bucket"


class Runs:
    """The runs of a folder on any file system that Spark writes; rows have a key column."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def spans(self) -> list[tuple[int, int]]:
        """(first, last batch) of the runs that count, in order; a merged run stands for those inside it."""
        found = self._fs.globStatus(self._path(f"{self.folder}/run-*/_SUCCESS")) or []
        names = (re.search(r"/run-(\d+)-(\d+)/_SUCCESS$", str(f.getPath())) for f in found)
        spans = sorted(((int(m[1]), int(m[2])) for m in names if m), key=lambda s: (s[0], -s[1]))
        out: list[tuple[int, int]] = []
        for span in spans:
            if not out or span[1] > out[-1][1]:
                out.append(span)
        return out

    def holds(self, batch: int) -> bool:
        return any(a <= batch <= b for a, b in self.spans())

    def next_batch(self) -> int:
        spans = self.spans()
        return spans[-1][1] + 1 if spans else 0

    def _place(self, span: tuple[int, int]) -> str:
        return f"{self.folder}/run-{span[0]:012d}-{span[1]:012d}"

    def _bucket(self, digits: int) -> Column:
        return F.concat(F.lit("b"), F.substring(F.md5(F.col(self.key)), 1, digits))

    def _write(self, rows: DataFrame, span: tuple[int, int], size: int) -> None:
        digits = sum(size > BUCKET_ROWS * n for n in (1, 16))
        rows = rows.select(*self.spark.createDataFrame([], self.schema).columns).withColumn(_BUCKET, self._bucket(digits))
        rows = rows.repartition(_BUCKET) if digits else rows
        rows.write.mode("overwrite").partitionBy(_BUCKET).parquet(self._place(span))

    def _read(self, span: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {_BUCKET} string").parquet(self._place(span))

    def append(self, batch: int, rows: DataFrame) -> None:
        """Adds a batch, unless it is there already; of rows of a key, the latest batch's counts, and keys come once in `rows`."""
        if self.holds(batch):
            return
        self._write(rows, (batch, batch), 0)
        while len(spans := self.spans()) > 1:
            a, b = spans[-2:]
            sizes = [self._read(s).count() for s in (a, b)]
            if 2 * sizes[1] < sizes[0]:
                break
            merged = self._newest([a, b])
            self._write(merged, (a[0], b[1]), sum(sizes))
            for old in (a, b):
                self._fs.delete(self._path(self._place(old)), True)

    def _newest(self, spans: list[tuple[int, int]], only: DataFrame | None = None, where: Column | None = None) -> DataFrame:
        """The latest row of each key in these runs, in order; of the keys of `only`, from the buckets that `where` names."""
        rows = None
        for i, span in enumerate(spans):
            run = self._read(span)
            run = (run if where is None else run.where(where)).drop(_BUCKET).withColumn(_BUCKET, F.lit(i))
            rows = run if rows is None else rows.union(run)
        rows = rows if only is None else rows.join(only, self.key, "left_semi")
        rest = [c for c in rows.columns if c not in (self.key, _BUCKET)]
        latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), _BUCKET).alias("r"))
        return latest.select(self.key, "r.*")

    def current(self) -> DataFrame:
        """The latest row of each key."""
        spans = self.spans()
        if not spans:
            return self.spark.createDataFrame([], self.schema)
        return self._newest(spans) if len(spans) > 1 else self._read(spans[0]).drop(_BUCKET)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The latest row of each of these keys (a column named as the key), from the buckets that may hold them."""
        buckets = [r[0] for r in keys.select(F.explode(F.array(*(self._bucket(d) for d in range(3)))).alias("b")).distinct().collect()]  # 273 at most
        spans = self.spans()
        if not spans:
            return self.spark.createDataFrame([], self.schema)
        return self._newest(spans, keys.select(self.key).distinct(), F.col(_BUCKET).isin(buckets))

    def drop(self, prefix: str) -> None:
        """Deletes what was written beside the runs under a name."""
        for found in self._fs.globStatus(self._path(prefix + "*")) or []:
            self._fs.delete(found.getPath(), True)
