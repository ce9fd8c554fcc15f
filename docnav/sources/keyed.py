"""Tables of files that several writers add to, and that are looked up by key.

``CommitLog`` is a folder of numbered files. Each holds the names of the parts that make up the table; the next number is put down only if no other writer has it, so
of two writers one reads the other's list and tries again: nothing is lost, and a part that is named already is not added twice. A reader takes the highest number and
sees whole parts only. What a writer left behind without naming it does not exist.

``KeyedTable`` writes each batch as one part in buckets of its key and lists it in the log. A lookup reads the buckets of the keys that it asks for, and of few keys
only the row groups whose bloom filters may hold one; the latest row of a key wins. Many parts are rewritten as one; the files of what they replace stay for readers that
began before, so a table is read through its log (``table``), and a plain reader of the folder sees all that was ever written.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Attempts to put down the next number; buckets; parts after which they are rewritten; keys that are passed on to the scan as values.
ATTEMPTS, BUCKETS, MOST_PARTS, FEW = 100, 32, 16, 1000


class Conflict(RuntimeError):
    """What a commit replaces is no longer there."""


class CommitLog:
    """Numbered lists of parts below ``root``, in any file system whose rename does not overwrite, or in a local folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root
        jvm = spark._jvm  # noqa: SLF001
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
        self._fs.mkdirs(self._path(root))
        self.local = root.removeprefix("file://") if self._fs.getScheme() == "file" else None

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, number: int) -> list[str]:
        stream = self._fs.open(self._path(f"{self.root}/{number:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["parts"]
        finally:
            stream.close()

    def latest(self) -> tuple[int, list[str]]:
        """The highest number and its parts, in the order in which they came."""
        numbers = self._numbers()
        return (numbers[-1], self._read(numbers[-1])) if numbers else (0, [])

    def _put(self, number: int, parts: list[str]) -> bool:
        """Whether the number was free and now holds the parts."""
        name, draft = f"{number:020d}.json", f".{uuid.uuid4().hex}"
        data = json.dumps({"parts": parts}).encode()
        if self.local is not None:
            at = os.path.join(self.local, draft)
            with open(at, "wb") as f:
                f.write(data)
            try:
                os.link(at, os.path.join(self.local, name))
            except FileExistsError:
                return False
            finally:
                os.unlink(at)
            return True
        out = self._fs.create(self._path(f"{self.root}/{draft}"), False)
        out.write(bytearray(data))
        out.close()
        done = self._fs.rename(self._path(f"{self.root}/{draft}"), self._path(f"{self.root}/{name}"))
        if not done:
            self._fs.delete(self._path(f"{self.root}/{draft}"), False)
        return done

    def commit(self, add: list[str], remove: list[str] = ()) -> int:
        """The number under which ``add`` is in the table, in the place of ``remove``, which must still be there."""
        for _ in range(ATTEMPTS):
            number, parts = self.latest()
            if not remove and set(add) <= set(parts):
                return number
            if not set(remove) <= set(parts):
                raise Conflict(f"{sorted(set(remove) - set(parts))} went before it was replaced")
            # replaced parts leave their place to the new ones, so later rows stay later
            at = min((parts.index(r) for r in remove), default=len(parts))
            kept = [p for p in parts if p not in remove and p not in add]
            if self._put(number + 1, kept[:at] + list(add) + kept[at:]):
                return number + 1
        raise Conflict(f"no free number in {ATTEMPTS} attempts")


class KeyedTable:
    """Rows of ``schema`` below ``root``, by the string column ``key``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "key", buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets
        self.columns = StructType.fromDDL(schema)
        self.log = CommitLog(spark, f"{root}/_log")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, part: str) -> None:
        out = rows.select(*self.columns.names).withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", self.key)
        out.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("bucket").parquet(f"{self.root}/part={part}")

    def append(self, rows: DataFrame, part: str | None = None) -> None:
        """Adds a batch; under a name that is in the table already nothing happens, so a batch may be sent again."""
        part = part or uuid.uuid4().hex
        if part in self.log.latest()[1]:
            return
        self._write(rows, part)
        self.log.commit([part])
        if len(self.log.latest()[1]) > MOST_PARTS:
            with contextlib.suppress(Conflict):  # another writer rewrites
                self.compact()

    def compact(self) -> None:
        """Rewrites the parts as one that holds the latest row of each key; parts that come meanwhile stay beside it."""
        parts = self.log.latest()[1]
        if len(parts) > 1:
            whole = uuid.uuid4().hex
            self._write(self._latest(self._read(parts)), whole)
            self.log.commit([whole], parts)

    def _read(self, parts: list[str]) -> DataFrame:
        """Rows of the parts with their places in the log."""
        if not parts:
            return self.spark.createDataFrame([], self.columns).withColumns({"bucket": F.lit(0), "place": F.lit(0)})
        stored = StructType([*self.columns.fields, StructField("bucket", IntegerType()), StructField("part", StringType())])
        found = self.spark.read.schema(stored).option("basePath", self.root).parquet(*[f"{self.root}/part={p}" for p in parts])
        place = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(parts) for x in (p, i)]), F.col("part"))
        return found.withColumn("place", place).drop("part")

    def _latest(self, rows: DataFrame) -> DataFrame:
        others = [n for n in self.columns.names if n != self.key]
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*others), F.struct("place", *others)).alias("row"))
        return best.select(*[self.key if n == self.key else F.col(f"row.{n}").alias(n) for n in self.columns.names])

    def parts(self, first: int = 0) -> DataFrame:
        """All rows of the parts from number ``first`` on, -1 being the latest."""
        return self._read(self.log.latest()[1][first:]).select(*self.columns.names)

    def table(self) -> DataFrame:
        return self._latest(self._read(self.log.latest()[1]))

    def candidates(self, keys: DataFrame) -> DataFrame:
        """Rows of the files that may hold one of ``keys(key)``; only numbers of buckets, and keys if they are few, reach the driver."""
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("bucket", self._bucket())
        few = [r[self.key] for r in asked.limit(FEW + 1).select(self.key).collect()]
        need = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())
        rows = self._read(self.log.latest()[1]).where(F.col("bucket").isin(need))
        return rows.where(F.col(self.key).isin(few)) if len(few) <= FEW else rows

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The latest row of each of ``keys(key)`` that the table has."""
        return self._latest(self.candidates(keys).join(keys.select(self.key).distinct(), self.key, "left_semi"))
