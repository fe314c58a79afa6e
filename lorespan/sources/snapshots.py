"""Tables kept as numbered parquet folders; a reader never sees a half-written one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Snapshots:
    """``root/version=N``; the newest folder with a success marker is current.

    Works on any file system Spark can write to.  One writer per table: a run
    that is repeated after a failure writes the same number again.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("version=") and fs.exists(done):
                found.append(int(name.split("=", 1)[1]))
        return sorted(found)

    def latest(self, before: int | None = None) -> int | None:
        found = [v for v in self.versions() if before is None or v < before]
        return found[-1] if found else None

    def path(self, version: int) -> str:
        return f"{self.root}/version={version}"

    def read(self, before: int | None = None) -> DataFrame:
        """Newest version (older than ``before``); an empty typed table when none."""
        version = self.latest(before)
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path(version))

    def read_all(self, upto: int | None = None) -> DataFrame:
        """Every version (up to one) at once, for append-only logs."""
        found = [self.path(v) for v in self.versions() if upto is None or v <= upto]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*found)

    def publish(self, df: DataFrame, version: int | None = None) -> int:
        if version is None:
            version = (self.latest() or 0) + 1
        columns = [f.name for f in self.schema.fields]
        df.select(*columns).write.mode("overwrite").parquet(self.path(version))
        return version

    def prune(self, keep: int) -> list[int]:
        """Remove all but the newest ``keep`` whole versions and return their numbers.

        Not for logs that are read with ``read_all``.  A reader that started before has
        ``keep - 1`` publications to finish.
        """
        if keep < 1:
            raise ValueError("at least one version stays")
        old = self.versions()[:-keep]
        for version in old:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(version))
            fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            fs.delete(folder, True)
        return old
