"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsignals.session import fresh_path

# With this setting Spark removes the shuffle files of a query when the query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of rows that Spark hands to a Python worker at once: Spark's own value, and the one used here instead
# of it. Workers hold a batch and what they make of it beside the executor's heap.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT, BATCH_BYTES = "67108864b", "4m"


class Steps:
    """Writes a table after each step and removes those that are no longer needed.

    A written table survives lost executors, and once it is written nothing needs the shuffle
    files behind it. Sessions that leave the size of batches for Python open get a smaller one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        if spark.conf.get(BATCH) == BATCH_DEFAULT:
            spark.conf.set(BATCH, BATCH_BYTES)
        self.paths: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str, codec: str | None = None, by: str | None = None) -> DataFrame:
        """Write and read back; rows are kept apart by the values of the column ``by``."""
        path = fresh_path(self.spark, name)
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(path, partitionBy=by, compression=codec)
        finally:
            if before is None:
                self.spark.conf.unset(CLEAN_UP)
            else:
                self.spark.conf.set(CLEAN_UP, before)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, *names: str) -> None:
        """Remove the tables written under these names; nothing may read them any more."""
        for path in (p for name in names for p in self.paths.pop(name, [])):
            self._delete(path)

    def remove_part(self, name: str, by: str, value: int) -> None:
        """Remove the rows with this value from a table written ``by`` its column; nothing may read them any more."""
        for path in self.paths[name]:
            self._delete(f"{path}/{by}={value}")

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
