"""Tables kept as numbered versions in a folder: readers see the last whole version, a failed write leaves none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Named tables under ``root``, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self, name: str) -> int:
        """The number of the last version whose write came to its end; 0 if there is none."""
        files, at = self._files(f"{self.root}/{name}")
        if not files.exists(at):
            return 0
        done = [int(x.getPath().getName()[2:]) for x in files.listStatus(at) if x.getPath().getName().startswith("v=") and files.exists(self._files(f"{x.getPath()}/_SUCCESS")[1])]
        return max(done, default=0)

    def read(self, name: str, schema: str) -> DataFrame:
        """The last version, or no rows."""
        n = self.version(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v={n}") if n else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame) -> None:
        """A new version; it may be made from the one before, which stays until ``vacuum``."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v={self.version(name) + 1}")

    def probe(self, names: list[str]) -> list[tuple[str, bool, str]]:
        """(table, healthy, message): whether each has a whole version whose schema can be read, then whether the folder can be written."""
        out = []
        for name in names:
            try:
                n = self.version(name)
                if n:
                    self.spark.read.parquet(f"{self.root}/{name}/v={n}")
                out.append((name, n > 0, f"version {n}" if n else "not built"))
            except Exception as problem:  # whatever a broken table raises is its state
                out.append((name, False, str(problem).split("\n")[0]))
        try:
            files, at = self._files(f"{self.root}/_probe")
            files.create(at, True).close()
            files.delete(at, False)
            out.append(("folder", True, "writable"))
        except Exception as problem:
            out.append(("folder", False, str(problem).split("\n")[0]))
        return out

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Removes versions older than the last ``keep``."""
        last = self.version(name)
        for n in range(max(1, last - keep - 8), last - keep + 1):
            files, at = self._files(f"{self.root}/{name}/v={n}")
            files.delete(at, True)

    def drop(self) -> bool:
        """Removes all tables; False if there were none."""
        files, at = self._files(self.root)
        return files.delete(at, True)
