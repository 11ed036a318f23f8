"""A table folder: named Parquet tables with upper-case columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TableStore:
    """Read, save and list tables below one folder; saving replaces rows and schema.

    With ``database`` the tables are catalog tables of that database instead.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, database: str | None = None):
        if (folder is None) == (database is None):
            raise ValueError("give a folder or a database")
        self.spark, self.folder, self.database = spark, folder, database

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name.lower()}"

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def tables(self) -> list[str]:
        if self.database:
            return sorted(t.name for t in self.spark.catalog.listTables(self.database))
        path, files = self._files()
        if not files.exists(path):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory())

    def exists(self, name: str) -> bool:
        return name.lower() in self.tables()

    def read(self, name: str) -> DataFrame:
        if self.database:
            return self.spark.table(f"{self.database}.{name.lower()}")
        return self.spark.read.parquet(self._path(name))

    def save(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        upper = df.toDF(*[c.upper() for c in df.columns])
        writer = upper.write.mode(mode).option("compression", "zstd")
        if self.database:
            writer.saveAsTable(f"{self.database}.{name.lower()}")
        else:
            writer.parquet(self._path(name))


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a target schema; missing columns become '', 0 or null and others are dropped."""
    present = {c.upper(): c for c in df.columns}
    columns = []
    for field in schema:
        if field.name.upper() in present:
            value = F.col(present[field.name.upper()]).try_cast(field.dataType)
        elif isinstance(field.dataType, T.StringType):
            value = F.lit("")
        elif isinstance(field.dataType, T.NumericType):
            value = F.lit(0).cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def save_aligned(store: TableStore, name: str, df: DataFrame, schema: T.StructType) -> None:
    store.save(name, align(df, schema))


def write_parts(df: DataFrame, path: str, by: str = "run_id", rows_per_file: int = 1_000_000) -> None:
    """Step output in one folder per run, a new file whenever a part is full."""
    df.write.mode("append").partitionBy(by).option("maxRecordsPerFile", rows_per_file).parquet(path)
