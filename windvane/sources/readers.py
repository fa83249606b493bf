"""Readers: raw telemetry CSVs, event metadata, sensor catalogs, processed tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windvane import config
from windvane.config import FarmMap
from windvane.functions import states
from windvane.operators.harmonize import map_sensors, union_farms
from windvane.session import materialize, small_side

_ROW_ID = "row_id"


def processed_schema() -> T.StructType:
    """The fixed schema of the processed and master tables."""
    ntz, text = T.TimestampNTZType(), T.StringType()
    types = {
        "time_stamp": ntz, "farm_id": text, "asset_id": text, "event_id": T.LongType(), "event_label": text,
        "event_start": ntz, "event_end": ntz, "state_label": T.IntegerType(), "state_name": text,
        "is_excluded_buffer": T.BooleanType(), "target": T.DoubleType(),
    }
    names = [
        *config.IDENTITY_COLUMNS, *config.STANDARD_FEATURES, *config.DERIVED_FEATURES,
        *config.TEMPORAL_FEATURES, *config.LABEL_COLUMNS,
    ]
    return T.StructType([T.StructField(n, types.get(n, T.DoubleType())) for n in names])


def _paths(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths under ``folder``; the content column of the listing source is never read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")


def file_headers(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Header line of every file: file (URI, as in ``_metadata.file_path``), header.

    Only the head of each file is read. The function travels with the task, so workers need no package of ours.
    """

    def first_lines(batches):
        from urllib.parse import quote

        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            lines = []
            for path in batch["path"]:
                # Spark prints local paths as file:/x; a URI parser wants file:///x, quoted.
                uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
                system, name = fs.FileSystem.from_uri(quote(uri, safe=":/@?&=+,;"))
                with system.open_input_stream(name) as stream:
                    head = b""
                    while b"\n" not in head:
                        piece = stream.read(65536)
                        if not piece:
                            break
                        head += piece
                lines.append(head.split(b"\n")[0].rstrip(b"\r").decode("utf-8-sig", errors="replace"))
            yield pd.DataFrame({"file": batch["file"], "header": lines})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("_metadata.file_path").alias("file")).mapInPandas(first_lines, "file string, header string")


def _names(header: str) -> list[str]:
    return [name.strip().strip('"') for name in header.split(";")]


def _one_layout(reader, folder: str, header: str, needed: list[str]) -> DataFrame:
    names = _names(header)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    scan = reader.schema(schema).option("enforceSchema", False).csv(folder)
    return scan.select(*[F.col(f"`{n}`") for n in needed if n in names], F.col("_metadata.file_name").alias("source_file"))


def _many_layouts(reader, folder: str, files: DataFrame, headers: list[str], needed: list[str]) -> DataFrame:
    """One scan of all files by position; the layout of its file says where a row keeps a channel."""
    layouts = [_names(h) for h in headers]
    width = max(map(len, layouts))
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    layout = F.array_position(F.array(*map(F.lit, headers)), F.col("header")) - 1
    scan = reader.schema(schema).csv(folder).withColumns({"_file": F.col("_metadata.file_path"), "source_file": F.col("_metadata.file_name")})
    joined = scan.join(small_side(files.select(F.col("file").alias("_file"), layout.alias("_layout"))), "_file")

    def channel(name: str):
        places: dict[int, list[str]] = {}
        for i, names in enumerate(layouts):
            if name in names:
                places.setdefault(names.index(name), []).append(str(i))
        cases = " ".join(f"WHEN _layout IN ({', '.join(own)}) THEN _c{at}" for at, own in places.items())
        return F.expr(f"CASE {cases} END").alias(name)

    present = [n for n in needed if any(n in names for names in layouts)]
    return joined.select(*map(channel, present), "source_file")


def read_telemetry(spark: SparkSession, folder: str, farm: str, farms: FarmMap = FarmMap()) -> DataFrame:
    """Raw channels of one farm that the feature map needs, as text, with file and row id.

    Only requested columns are parsed, in one scan of the folder. Columns bind by name also where files have
    different headers; only the distinct headers reach the driver.
    """
    files = materialize(file_headers(spark, folder))
    headers = sorted(row["header"] for row in files.select("header").distinct().collect())
    if not headers:
        raise FileNotFoundError(f"no CSV files in {folder}")
    needed = farms.required_channels(farm)
    reader = spark.read.option("sep", ";").option("header", True).option("pathGlobFilter", "*.csv")
    one = len(headers) == 1
    scan = _one_layout(reader, folder, headers[0], needed) if one else _many_layouts(reader, folder, files, headers, needed)
    return scan.withColumn(_ROW_ID, F.monotonically_increasing_id())


def _exists(spark: SparkSession, path: str, pattern: str = "*") -> bool:
    try:
        return bool(_paths(spark, path, pattern).limit(1).collect())
    except AnalysisException:
        return False


def read_farms(spark: SparkSession, root: str, farms: FarmMap = FarmMap()) -> DataFrame:
    """Mapped (not yet unit-normalized) telemetry of every farm folder under ``root``.

    Farms without a dataset folder are skipped, as a fleet may be partly delivered.
    """
    parts = []
    for farm in farms.channels:
        folder = f"{root}/Wind Farm {farm}/datasets"
        if not _exists(spark, folder, "*.csv"):
            continue
        raw = read_telemetry(spark, folder, farm, farms)
        event = states.event_id_from_stem(states.file_stem(F.col("source_file"))).alias("event_id")
        mapped = map_sensors(raw, farm, farms, keep=("source_file", _ROW_ID))
        parts.append(mapped.select("*", event))
    if not parts:
        raise FileNotFoundError(f"no farm datasets under {root}")
    return union_farms(parts)


def read_event_info(spark: SparkSession, root: str, farms: FarmMap = FarmMap()) -> DataFrame:
    """Event metadata of all farms; each file is read with its own header."""
    parts = []
    for farm in farms.channels:
        path = f"{root}/Wind Farm {farm}/event_info.csv"
        if not _exists(spark, path):
            continue
        raw = spark.read.option("sep", ";").option("header", True).csv(path)
        asset = "asset_id" if "asset_id" in raw.columns else "asset"
        parts.append(raw.select(
            F.lit(farm).alias("farm_id"), F.col(asset).alias("asset_id"),
            F.col("event_id").cast("bigint").alias("event_id"), "event_label",
            F.col("event_start").cast("timestamp_ntz").alias("event_start"),
            F.col("event_end").cast("timestamp_ntz").alias("event_end"),
            F.col("event_start_id").cast("bigint").alias("event_start_id"),
            F.col("event_end_id").cast("bigint").alias("event_end_id"),
            F.coalesce("event_description", F.lit("")).alias("event_description"),
            F.monotonically_increasing_id().alias("event_seq"),
        ))
    if not parts:
        raise FileNotFoundError(f"no event metadata under {root}")
    return union_farms(parts)


def read_sensor_catalog(spark: SparkSession, root: str, farms: FarmMap = FarmMap()) -> DataFrame:
    """Sensor descriptions with the statistics list split and flags as booleans."""
    parts = []
    for farm in farms.channels:
        path = f"{root}/Wind Farm {farm}/feature_description.csv"
        if not _exists(spark, path):
            continue
        raw = spark.read.option("sep", ";").option("header", True).csv(path)
        parts.append(raw.select(
            F.lit(farm).alias("farm_id"), "sensor_name", F.split("statistics_type", r"\s*,\s*").alias("statistics"),
            "description", "unit", F.col("is_angle").cast("boolean").alias("is_angle"),
            F.col("is_counter").cast("boolean").alias("is_counter"),
        ))
    if not parts:
        raise FileNotFoundError(f"no sensor catalog under {root}")
    return union_farms(parts)


# Channel suffix for each catalog statistic.
STATISTIC_SUFFIX = {"average": "avg", "maximum": "max", "minimum": "min", "std_dev": "std"}


def unmapped_channels(feature_map: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mapped channels that the catalog does not describe (should be empty)."""
    suffixes = F.create_map(*[F.lit(v) for pair in STATISTIC_SUFFIX.items() for v in pair])
    channels = catalog.select("farm_id", "sensor_name", F.explode("statistics").alias("s")).select(
        "farm_id", F.explode(F.array("sensor_name", F.concat_ws("_", "sensor_name", suffixes[F.col("s")]))).alias("channel")
    ).distinct()
    return feature_map.join(channels, ["farm_id", "channel"], "left_anti")


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Processed events with the fixed schema; an empty or absent folder is an error."""
    if not _exists(spark, path, "*.parquet"):
        raise FileNotFoundError(f"no processed event files in {path}")
    schema = processed_schema()
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Read a modeling table by its suffix (.parquet or .csv)."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in (".parquet", ".csv"):
        raise ValueError(f"unsupported dataset format {suffix!r}; expected .parquet or .csv")
    try:
        if suffix == ".parquet":
            return spark.read.parquet(path)
        header = spark.read.option("header", True).csv(path)
        known = {f.name: f.dataType for f in processed_schema().fields}
        unknown = [f"`{c}`" for c in header.columns if c not in known]
        if unknown:  # their types come from the values
            inferred = spark.read.option("header", True).option("inferSchema", True).csv(path).select(*unknown)
            known |= {f.name: f.dataType for f in inferred.schema.fields}
        return header.select(*[F.col(f"`{c}`").cast(known[c]).alias(c) for c in header.columns])
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"dataset not found: {path}") from exc
        raise


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def schema_table(df: DataFrame) -> DataFrame:
    """The schema as rows."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def file_inventory(df: DataFrame) -> DataFrame:
    """Name and size in MiB of every file behind a file-based table."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("s"))
    return files.distinct().select("file_name", F.round(F.col("s") / F.lit(1024.0 * 1024.0), 3).alias("size_mb"))


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows read from every file behind a file-based table."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"))


def sample_rows(df: DataFrame, n: int = 5000, order: tuple[str, ...] = ()) -> DataFrame:
    """First ``n`` rows, in ``order`` when given (a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)
