"""Leakage-aware train/validation/test splits and grouped folds.

Every split returns the input rows with one extra column; a part is a filter on it.
Wide rows are never shuffled to split them: cut points are found on key columns only and
come back as literals or as a small joined table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windvane.functions import states
from windvane.operators.ordered_chunks import ROWS_PER_CHUNK, rows_at, with_rank
from windvane.session import materialize, require_columns, small_result, small_side

MAX_TURBINES = 1_000_000  # far above any fleet; their sizes are placed one after another
SIZES = (0.7, 0.15, 0.15)


def check_sizes(train: float, val: float, test: float) -> None:
    if min(train, val, test) < 0:
        raise ValueError("split sizes must be non-negative")
    if abs(train + val + test - 1.0) > 1e-8:
        raise ValueError(f"split sizes must sum to 1.0, got {train + val + test:.8f}")


def _cut_offs(rows: int, train: float, val: float) -> tuple[int, int]:
    first = int(rows * train)
    return first, first + int(rows * val)


def _literal(value) -> Column:
    if isinstance(value, datetime):  # no detour through the session time zone
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def _sorts_before(order: list[str], cut: tuple) -> Column:
    """Row strictly before ``cut`` in ascending, nulls-last lexicographic order."""
    before = F.lit(False)
    for name, value in reversed(list(zip(order, cut))):
        column = F.col(name)
        if value is None:
            before = column.isNotNull() | before
        else:
            bound = _literal(value)
            before = F.coalesce((column < bound) | ((column == bound) & before), F.lit(False))
    return before


def _split_at(df: DataFrame, order: list[str], val_from: tuple | None, test_from: tuple | None) -> DataFrame:
    name = F.lit("train")
    if val_from is not None or test_from is not None:
        before_val = _sorts_before(order, val_from if val_from is not None else test_from)
        before_test = F.lit(True) if test_from is None else _sorts_before(order, test_from)
        name = F.when(before_val, "train").when(before_test, "val").otherwise("test")
    return df.withColumn("split", name)


def _split_by_position(df: DataFrame, order: list[str], cuts: Callable[[int], tuple[int, int]], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Split the table at two exact positions of its sort order, without sorting it."""
    total = df.count()
    wanted = sorted({at for at in cuts(total) if at < total})
    found = {}
    if wanted:
        positions = df.sparkSession.createDataFrame([(at,) for at in wanted], "_position long")
        sizes = df.sparkSession.createDataFrame([(total,)], "_rows long")
        found = {r["_position"]: tuple(r[c] for c in order) for r in rows_at(df, [], order, sizes, positions, rows_per_chunk).collect()}
    val_at, test_at = cuts(total)
    return _split_at(df, order, found.get(val_at), found.get(test_at))


def global_time_split(
    df: DataFrame, train: float = SIZES[0], val: float = SIZES[1], test: float = SIZES[2], *,
    time_col: str = "time_stamp", tiebreak: str = "row_id", rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Chronological split of all rows (ties by ``tiebreak``)."""
    require_columns(df, time_col, tiebreak)
    check_sizes(train, val, test)
    return _split_by_position(df, [time_col, tiebreak], lambda n: _cut_offs(n, train, val), rows_per_chunk)


def random_split(
    df: DataFrame, train: float = SIZES[0], val: float = SIZES[1], test: float = SIZES[2], *,
    seed: int = 42, row_id: str = "row_id", rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Exact-size shuffled split, reproducible for a seed: rows in order of md5(seed#row_id)."""
    require_columns(df, row_id)
    check_sizes(train, val, test)
    digest = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(row_id).cast("string")))

    def digits(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")

    def cuts(rows: int) -> tuple[int, int]:
        held_out = math.ceil(rows * (1.0 - train))
        if held_out == 0:
            return rows, rows
        tested = math.ceil(held_out * (test / (val + test)))
        return rows - held_out, rows - tested

    keyed = df.withColumns({"_h1": digits(1), "_h2": digits(16)})
    return _split_by_position(keyed, ["_h1", "_h2", row_id], cuts, rows_per_chunk).drop("_h1", "_h2")


def turbine_time_split(
    df: DataFrame, train: float = SIZES[0], val: float = SIZES[1], test: float = SIZES[2], *,
    time_col: str = "time_stamp", tiebreak: str = "row_id", rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Chronological split inside every turbine; each turbine contributes to all parts.

    The two cut rows of all turbines are looked up together; only the narrow rows around them are sorted.
    """
    require_columns(df, "farm_id", "asset_id", time_col, tiebreak)
    check_sizes(train, val, test)
    order, keys = [time_col, tiebreak], ["_turbine"]
    keyed = df.withColumn("_turbine", states.turbine_key(F.col("farm_id"), F.col("asset_id")))
    narrow = keyed.select(*keys, *order)
    sizes = materialize(narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    first = F.floor(F.col("_rows").cast("double") * F.lit(train))
    placed = sizes.select(*keys, "_rows", first.alias("_val_at"), (first + F.floor(F.col("_rows").cast("double") * F.lit(val))).alias("_test_at"))
    asked = placed.select(*keys, F.explode(F.array_distinct(F.array("_val_at", "_test_at"))).alias("_position"), "_rows").filter("_position < _rows")
    found = rows_at(narrow, keys, order, sizes, asked.drop("_rows"), rows_per_chunk)
    at = F.struct(*[F.col(c) for c in order])
    cuts = (
        found.join(small_side(placed), keys)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("_position") == F.col("_val_at"), at)).alias("_val_from"),
            F.max(F.when(F.col("_position") == F.col("_test_at"), at)).alias("_test_from"),
        )
    )

    def before(cut: str) -> Column:
        time, tie = F.col(time_col), F.col(tiebreak)
        cut_time, cut_tie = F.col(f"{cut}.{time_col}"), F.col(f"{cut}.{tiebreak}")
        earlier = F.coalesce(time < cut_time, time.isNotNull() & cut_time.isNull())
        return F.col(cut).isNull() | earlier | (time.eqNullSafe(cut_time) & (tie < cut_tie))

    name = F.when(before("_val_from"), "train").when(before("_test_from"), "val").otherwise("test")
    return keyed.join(small_result(cuts), keys, "left").withColumn("split", name).select(*df.columns, "split")


def event_bounds(df: DataFrame, keys: list[str] = ["farm_id", "event_id"], time_col: str = "time_stamp") -> DataFrame:
    """First and last time and row count of every event."""
    return df.groupBy(*keys).agg(
        F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time"), F.count(F.lit(1)).alias("n_rows")
    )


def event_time_split(
    df: DataFrame, train: float = SIZES[0], val: float = SIZES[1], test: float = SIZES[2], *,
    keys: list[str] = ["farm_id", "event_id"], time_col: str = "time_stamp",
) -> DataFrame:
    """Whole events in order of their first row; rows without an event belong to no part."""
    require_columns(df, *keys, time_col)
    check_sizes(train, val, test)
    known = df.filter(F.col(keys[-1]).isNotNull())
    bounds = materialize(event_bounds(known, keys, time_col))
    order = ["first_time", *reversed(keys)]
    assigned = _split_by_position(bounds, order, lambda n: _cut_offs(n, train, val)).select(*keys, "split")
    return df.join(small_side(assigned), keys).select(*df.columns, "split")


def turbine_groups(df: DataFrame) -> DataFrame:
    """Turbine key with its farm and size."""
    key = states.turbine_key(F.col("farm_id"), F.col("asset_id"))
    return df.groupBy(key.alias("group_id")).agg(F.min("farm_id").alias("farm_id"), F.count(F.lit(1)).alias("n_rows"))


def _allot(counts: dict[str, int], tested: int) -> dict[str, int]:
    """Share ``tested`` slots over strata in proportion to size, by largest remainder."""
    total = sum(counts.values())
    exact = {farm: tested * n / total for farm, n in counts.items()}
    slots = {farm: int(share) for farm, share in exact.items()}
    spare = tested - sum(slots.values())
    by_remainder = sorted(exact, key=lambda farm: (slots[farm] - exact[farm], farm))
    for farm in by_remainder[:spare]:
        slots[farm] += 1
    return slots


def turbine_holdout_split(
    df: DataFrame, test_size: float = 0.2, *, stratify_by_farm: bool = True, seed: int = 42
) -> DataFrame:
    """Whole turbines to train or test, spread over farms; seeded by md5 of the turbine key."""
    require_columns(df, "farm_id", "asset_id")
    groups = materialize(turbine_groups(df))
    counts = {r["farm_id"]: r["count"] for r in groups.groupBy("farm_id").count().collect()}
    total = sum(counts.values())
    tested = math.ceil(test_size * total)
    if tested <= 0 or tested >= total:
        raise ValueError(f"test_size={test_size} leaves an empty part of {total} turbines")
    stratified = stratify_by_farm and len(counts) > 1
    if stratified:
        if min(counts.values()) < 2:
            raise ValueError("every farm needs at least two turbines to stratify by farm")
        if min(tested, total - tested) < len(counts):
            raise ValueError("each part must have room for every farm to stratify by farm")
        slots = _allot(counts, tested)
    else:
        slots = {farm: tested for farm in counts}
    digest = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("group_id")))
    shuffled = groups.withColumns({
        "_h1": F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"),
        "_h2": F.conv(F.substring(digest, 16, 15), 16, 10).cast("bigint"),
    })
    ranked = with_rank(shuffled, ["farm_id"] if stratified else [], ["_h1", "_h2", "group_id"], "_rank")
    limits = df.sparkSession.createDataFrame(list(slots.items()), "farm_id string, _slots int")
    assigned = ranked.join(F.broadcast(limits), "farm_id").select(
        F.col("group_id").alias("_turbine"), F.when(F.col("_rank") <= F.col("_slots"), "test").otherwise("train").alias("split")
    )
    keyed = df.withColumn("_turbine", states.turbine_key(F.col("farm_id"), F.col("asset_id")))
    return keyed.join(small_result(assigned), "_turbine").select(*df.columns, "split")


def group_kfold(df: DataFrame, n_splits: int = 5, *, target_col: str = "target") -> DataFrame:
    """Fold number per row; a turbine is never divided and folds are balanced by rows.

    Turbines go to the lightest fold, largest first. Only the turbine table (one row per
    turbine, a dimension) visits the driver; more than ``MAX_TURBINES`` is an error.
    """
    require_columns(df, "farm_id", "asset_id", target_col)
    sizes = [(r["n_rows"], r["group_id"]) for r in turbine_groups(df).select("n_rows", "group_id").limit(MAX_TURBINES + 1).collect()]
    if len(sizes) > MAX_TURBINES:
        raise ValueError(f"grouped folds take at most {MAX_TURBINES} turbines")
    if n_splits > len(sizes):
        raise ValueError(f"n_splits={n_splits} exceeds the number of turbines ({len(sizes)})")
    folds = [(0, fold) for fold in range(n_splits)]
    placed = []
    for rows, group in sorted(sizes, key=lambda item: (-item[0], item[1])):
        load, fold = heapq.heappop(folds)
        placed.append((group, fold))
        heapq.heappush(folds, (load + rows, fold))
    table = df.sparkSession.createDataFrame(placed, "_turbine string, fold int")
    keyed = df.withColumn("_turbine", states.turbine_key(F.col("farm_id"), F.col("asset_id")))
    return keyed.join(small_side(table), "_turbine").select(*df.columns, "fold")


def parts(df: DataFrame, *names: str) -> DataFrame:
    """Rows of the named parts, e.g. ``parts(df, "train", "val")`` for a refit."""
    return df.filter(F.col("split").isin(list(names)))


# Accepted spellings of the split methods that give train, val and test.
METHODS: dict[str, Callable[..., DataFrame]] = {
    "event_chronological": event_time_split,
    "event_time": event_time_split,
    "turbine_grouped": turbine_time_split,
    "group_time": turbine_time_split,
    "grouped_time_by_turbine": turbine_time_split,
    "global_time": global_time_split,
    "chronological": global_time_split,
    "random": random_split,
}


def split_dataset(df: DataFrame, method: str = "event_chronological", sizes=SIZES, **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unsupported split method {method!r}; known: {sorted(METHODS)}")
    return METHODS[method](df, *sizes, **options)
