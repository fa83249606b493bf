"""Model input columns: which ones, and as which matrix."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windvane import config
from windvane.session import require_columns


def feature_columns(
    df: DataFrame,
    *,
    extra_excluded: Iterable[str] | None = None,
    include: Iterable[str] | None = None,
    numeric_only: bool = True,
    subset: str | None = None,
    require_non_empty: bool = True,
) -> list[str]:
    """Columns allowed as model inputs, in table order; decided on the schema, with no job."""
    if subset is not None and subset not in config.FEATURE_SUBSETS:
        raise ValueError(f"unknown feature subset {subset!r}; known: {sorted(config.FEATURE_SUBSETS)}")
    excluded = config.FORBIDDEN_FEATURES | set(extra_excluded or ())
    allowed = None if include is None else set(include)
    rules = config.FEATURE_SUBSETS.get(subset or "all", {})
    wanted, unwanted = rules.get("include_prefixes"), rules.get("exclude_prefixes")
    names = [
        f.name for f in df.schema.fields
        if f.name not in excluded
        and (allowed is None or f.name in allowed)
        and (not numeric_only or isinstance(f.dataType, T.NumericType))
        and (not wanted or f.name.startswith(tuple(wanted)))
        and (not unwanted or not f.name.startswith(tuple(unwanted)))
    ]
    if require_non_empty and not names:
        raise ValueError("no feature columns remain")
    return names


def check_no_leakage(columns: Sequence[str], extra_forbidden: Iterable[str] | None = None) -> None:
    offending = [c for c in columns if c in config.FORBIDDEN_FEATURES | set(extra_forbidden or ())]
    if offending:
        raise ValueError(f"forbidden columns among the features: {offending}")


def selection_summary(df: DataFrame, **options) -> DataFrame:
    """One row per input column: its position and whether it is a feature."""
    chosen = set(feature_columns(df, require_non_empty=False, **options))
    rows = [(i, f.name, f.dataType.simpleString(), f.name in chosen) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, is_feature boolean")


def feature_matrix(df: DataFrame, **options) -> DataFrame:
    return df.select(*feature_columns(df, **options))


def prepare_xy(df: DataFrame, target_col: str = "target", drop_cols: Sequence[str] | None = None) -> DataFrame:
    """Features and target only: identity, event and state columns are dropped."""
    require_columns(df, target_col)
    default = (*config.IDENTITY_COLUMNS, *[c for c in config.LABEL_COLUMNS if c != "target"])
    dropped = set(default if drop_cols is None else drop_cols) - {target_col}
    kept = [c for c in df.columns if c not in dropped and c != target_col]
    return df.select(*kept, target_col)


def assemble(df: DataFrame, columns: Sequence[str], target_col: str = "target", keep: Sequence[str] = ()) -> DataFrame:
    """Vector ``features`` and integer ``label``, plus the columns to keep."""
    check_no_leakage(columns)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error")
    labelled = df.withColumn("label", F.col(target_col).cast("int"))
    return assembler.transform(labelled).select("features", "label", *keep)
