"""CSV, Parquet and JSON-lines readers and writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import canonical_header
from ledgerlens.schemas import DATASETS, RAW_COLUMNS, REQUIRED_DATASETS, require


def rename_raw(df: DataFrame, table: str) -> DataFrame:
    """Canonical headers, then the table's column names; columns that the map lacks keep their canonical header."""
    names = RAW_COLUMNS[table]
    return df.toDF(*[names.get(canonical_header(c), canonical_header(c)) for c in df.columns])


def read_raw_csv(spark: SparkSession, path: str, table: str, multi_line: bool = False) -> DataFrame:
    """A raw table as text columns; the cleaning operators do the typing.  Codec by extension.

    With ``multi_line`` quoted fields may hold line ends, but each file then is one task; without it large files are split.
    """
    return rename_raw(spark.read.csv(path, header=True, multiLine=multi_line, escape='"'), table)


def read_csv_or_gzip(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """``path`` if it exists, else ``path + '.gz'``."""
    try:
        return spark.read.csv(path, header=True, schema=schema)
    except AnalysisException as missing:
        try:
            return spark.read.csv(path + ".gz", header=True, schema=schema)
        except AnalysisException:
            raise missing from None


def read_columns(df: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """Column-pruned read, or the first ``rows`` rows; Catalyst pushes both into the scan."""
    picked = df.select(*columns)
    return picked if rows is None else picked.limit(rows)


class DatasetRegistry:
    """Named datasets below one folder; required ones raise when absent, optional ones give ``None``."""

    def __init__(self, spark: SparkSession, base: str, paths: dict[str, str] | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        self.paths = {k: v[0] for k, v in DATASETS.items()} | (paths or {})

    def load_table(self, key: str, strict: bool = False) -> DataFrame | None:
        path = self.paths.get(key)
        if path is None:
            if strict:
                raise KeyError(f"unknown dataset {key}")
            return None
        full = path if "://" in path or path.startswith("/") else f"{self.base}/{path}"
        try:
            if full.endswith((".csv", ".csv.gz")):
                df = self.spark.read.csv(full, header=True, inferSchema=True)
            else:
                df = self.spark.read.parquet(full)
        except AnalysisException as missing:
            if strict or key in REQUIRED_DATASETS:
                raise FileNotFoundError(f"required dataset {key} not found at {full}") from missing
            return None
        if key in DATASETS:
            require(df, DATASETS[key][1], key)
        return df

    def load_all(self, strict: bool = False) -> tuple[dict[str, DataFrame | None], list[str]]:
        """All datasets, and the keys of those that are missing."""
        loaded = {key: self.load_table(key, strict) for key in self.paths}
        return loaded, [k for k, df in loaded.items() if df is None]


def load_report(tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row per dataset: key, loaded, row count."""
    present = {k: df for k, df in tables.items() if df is not None}
    rows = [df.agg(F.count("*").alias("row_count")).select(F.lit(k).alias("dataset"), F.lit(True).alias("loaded"), "row_count")
            for k, df in present.items()]
    spark = next(iter(present.values())).sparkSession
    rows += [
        spark.range(1).select(F.lit(k).alias("dataset"), F.lit(False).alias("loaded"), F.lit(0).cast("long").alias("row_count"))
        for k, df in tables.items()
        if df is None
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


EVENT_SCHEMA = T.StructType(
    [
        T.StructField(c, T.DoubleType() if c.endswith("amount") else T.StringType())
        for c in (
            "event_id", "event_type", "event_timestamp", "event_source", "project_id", "mp_name", "state",
            "constituency", "work_description", "category", "vendor", "recommended_amount", "expenditure_amount",
            "final_amount", "payment_status", "payment_status_raw", "payment_date", "project_status",
            "completed_date", "mapping_status",
        )
    ]
)
CORRUPT = "_corrupt_record"


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to events; blank and undecodable lines are dropped."""
    schema = T.StructType(EVENT_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return (
        lines.filter(F.trim(column) != "")
        .select(parsed.alias("e"))
        .filter(F.col(f"e.{CORRUPT}").isNull())
        .select(*[F.col(f"e.{f.name}").alias(f.name) for f in EVENT_SCHEMA.fields])
    )


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_lines(spark.read.text(path))


def stream_event_log(spark: SparkSession, path: str) -> DataFrame:
    """The same log as a stream of new files."""
    return parse_event_lines(spark.readStream.text(path))


def event_history(events: DataFrame, project_id: str | None = None, event_type: str | None = None) -> DataFrame:
    keep: Column = F.lit(True)
    if project_id:
        keep &= F.col("project_id") == project_id
    if event_type:
        keep &= F.col("event_type") == event_type
    return events.filter(keep)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite one result table; ``csv`` turns nested columns into JSON text."""
    if fmt == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        df = df.select(
            *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
        )
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite one folder of JSON lines, so that a repeated write leaves no repeated rows."""
    df.write.mode("overwrite").json(path)
