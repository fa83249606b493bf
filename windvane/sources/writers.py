"""Writers: processed tables, master table, CSV and JSON artifacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windvane.functions.sensors import null_if_nan
from windvane.operators.quality import label_rules
from windvane.sources.readers import processed_schema, read_processed


# The default text format of a timestamp keeps milliseconds only.
_TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def _guarded(write, path: str) -> str:
    try:
        write(path)
    except AnalysisException as exc:
        if "PATH_ALREADY_EXISTS" in str(exc):
            raise FileExistsError(f"{path} exists; pass overwrite=True to replace it") from exc
        raise
    return path


def write_processed(df: DataFrame, path: str, *, overwrite: bool = False) -> str:
    """Processed events, partitioned by farm and event, time-sorted within each file.

    Rows of an event are brought together by size: small events share a task, a huge one is spread over several.
    """
    table = df.select(*processed_schema().fieldNames())
    ordered = table.hint("rebalance", "farm_id", "event_id").sortWithinPartitions("farm_id", "event_id", "time_stamp")
    return _guarded(ordered.write.mode(_mode(overwrite)).partitionBy("farm_id", "event_id").parquet, path)


def write_checked(df: DataFrame, path: str, *, overwrite: bool = False) -> dict[str, int]:
    """``write_processed``, with the validation counts taken by the write itself.

    Rows written, violations of the labelling rules, and ``with_values.<column>`` for every feature and label column.
    """
    checks = Observation("processed")
    features = [c for c in processed_schema().fieldNames() if c not in ("time_stamp", "farm_id", "asset_id")]
    measures = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(rule).alias(name) for name, rule in label_rules().items()]]
    measures += [F.count(null_if_nan(F.col(c)) if dict(df.dtypes)[c] == "double" else F.col(c)).alias(f"with_values.{c}") for c in features]
    write_processed(df.observe(checks, *measures), path, overwrite=overwrite)
    return dict(checks.get)


def check_master_path(processed_path: str, master_path: str) -> None:
    """A master inside the processed folder (or around it) would be read as one more event."""
    inner, outer = (p.removeprefix("file://").removeprefix("file:").rstrip("/") + "/" for p in (processed_path, master_path))
    if inner.startswith(outer) or outer.startswith(inner):
        raise ValueError(f"master path {master_path} and processed folder {processed_path} contain one another")


MASTER_ORDER = ("farm_id", "asset_id", "time_stamp")
# Row groups and pages of the master: small enough that a window of one turbine skips most of what its file holds.
MASTER_LAYOUT = {"parquet.block.size": 32 << 20, "parquet.page.row.count.limit": 5_000}


def create_master(spark, processed_path: str, master_path: str, *, overwrite: bool = False, layout: dict = MASTER_LAYOUT) -> str:
    """Consolidate all processed events into one Parquet table with the fixed schema.

    Rows are laid out by turbine and time over all files, so filters on them skip files, row groups and pages; a
    turbine of any size is spread over files by time.
    """
    check_master_path(processed_path, master_path)
    events = read_processed(spark, processed_path)
    clustered = events.repartitionByRange(*MASTER_ORDER).sortWithinPartitions(*MASTER_ORDER)
    return _guarded(clustered.write.mode(_mode(overwrite)).options(**layout).parquet, master_path)


def save_table(df: DataFrame, path: str, *, overwrite: bool = True) -> str:
    """A result table as CSV with header."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"expected a DataFrame, got {type(df).__name__}")
    return _guarded(df.write.mode(_mode(overwrite)).options(header=True, **_TIME_FORMATS).csv, path)


def load_table(spark, path: str, schema=None) -> DataFrame:
    reader = spark.read.options(header=True, **_TIME_FORMATS)
    return (reader.schema(schema) if schema else reader).csv(path)


def save_json(df: DataFrame, path: str, *, overwrite: bool = True) -> str:
    """Records as JSON lines; NULL fields are kept."""
    return _guarded(df.write.mode(_mode(overwrite)).options(ignoreNullFields=False, **_TIME_FORMATS).json, path)


def load_json(spark, path: str, schema=None) -> DataFrame:
    reader = spark.read.options(**_TIME_FORMATS)
    return (reader.schema(schema) if schema else reader).json(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def save_run(tables: dict[str, DataFrame], root: str, experiment: str, run_id: str) -> dict[str, str]:
    """Save the tables of a modeling run, partitioned by experiment and run; saving a run again replaces it.

    Flat tables go to CSV; a table with a list column goes to JSON. Only the run's own partition is overwritten, so a
    table that is empty now leaves what the run saved before.
    """
    saved = {}
    for name, table in tables.items():
        nested = any(isinstance(f.dataType, T.ArrayType) for f in table.schema.fields)
        writer = (
            table.withColumns({"experiment": F.lit(experiment), "run_id": F.lit(run_id)})
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "run_id").options(**_TIME_FORMATS)
        )
        path = f"{root}/{name}"
        writer.json(path) if nested else writer.option("header", True).csv(path)
        saved[name] = path
    return saved
