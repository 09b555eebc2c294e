"""Files as rows: delimited text, whole texts, lines of JSON, and keyed tables that are replaced as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.graph import upserted


def delimited(spark: SparkSession, path: str, schema: StructType | str | None = None, separator: str = ",") -> DataFrame:
    """Rows of CSV or TSV files with a head line. Without a schema all columns are texts; NaN and empty cells are null either way."""
    rows = spark.read.options(header=True, sep=separator, multiLine=False, mode="PERMISSIVE")
    rows = rows.schema(schema).csv(path) if schema is not None else rows.csv(path)
    clean = lambda name, kind: F.when(~F.isnan(name), F.col(name)).alias(name) if kind in ("double", "float") else F.when(~F.lower(F.trim(name)).isin("", "nan"), F.col(name)).alias(name) if kind == "string" else F.col(name)
    return rows.select(*(clean(n, k) for n, k in rows.dtypes))


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, text) of each file, read whole."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    at = F.col("_metadata.file_path")
    return rows.select(at.alias("path"), F.element_at(F.split(at, "/"), -1).alias("name"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of files with a JSON object on each line; what is none comes with its text in `broken`."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = rows.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    return parsed.select("r.*", F.when(F.col("bad"), F.col("value")).alias("broken"))


def as_table_text(rows: DataFrame) -> DataFrame:
    """(line) for each row, in markdown; the head is head_lines(rows)."""
    from ledgerloom.operators.analytics import table_lines

    return rows.select(table_lines(rows, rows.columns).alias("line"))


def head_lines(rows: DataFrame) -> list[str]:
    return ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": delimited, "tsv": lambda spark, path, schema=None: delimited(spark, path, schema, "\t"), "md": whole_texts, "txt": whole_texts, "html": whole_texts,
    "jsonl": json_lines, "parquet": lambda spark, path: spark.read.parquet(path), "orc": lambda spark, path: spark.read.orc(path),
}


def reader_for(path: str) -> Callable[..., DataFrame]:
    """The reader for a file's ending."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for .{kind}")
    return READERS[kind]


class Keyed:
    """A table of rows by key in a folder. Each change writes a new version beside the old one and then names it the current one, so that a failed write leaves the old one whole."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _current(self) -> int:
        versions = self.spark.read.schema("version int").json(f"{self.folder}/versions") if self._exists() else None
        return 0 if versions is None else versions.agg(F.max("version")).first()[0] or 0

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self._current()}")

    def write(self, rows: DataFrame) -> None:
        n = self._current() + 1
        rows.write.parquet(f"{self.folder}/v{n}")
        self.spark.createDataFrame([(n,)], "version int").coalesce(1).write.mode("append").json(f"{self.folder}/versions")

    def upsert(self, rows: DataFrame) -> None:
        self.write(upserted(self.rows(), rows, self.key) if self._current() else rows)

    def delete(self, keys: DataFrame) -> None:
        self.write(self.rows().join(keys.select(self.key), self.key, "left_anti"))

    def get(self, keys: DataFrame) -> DataFrame:
        return self.rows().join(keys.select(self.key), self.key, "left_semi")
