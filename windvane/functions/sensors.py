"""Column expressions for sensor values: coercion, channel means, units, derived physics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from windvane import config

def zero() -> Column:
    return F.lit(0.0)


def number_sql(name: str) -> str:
    """SQL of a text column read as DOUBLE; what is not a plain number, and NaN, becomes NULL.

    Spark's cast also takes Java literals such as ``1.5d``, ``2f`` and ``0x1p3``; those are rejected.
    """
    number = f"try_cast(`{name}` AS double)"
    return (
        f"CASE WHEN {number} IS NOT NULL AND NOT isnan({number})"
        rf" AND NOT (`{name}` RLIKE r'[0-9.][dDfF]\s*$|[xX]') THEN {number} END"
    )


def to_number(name: str) -> Column:
    return F.expr(number_sql(name))


def mean_sql(names: list[str]) -> str:
    """SQL of the mean over the non-null columns; NULL when all are NULL or none is given."""
    if not names:
        return "CAST(NULL AS double)"
    if len(names) == 1:
        return f"`{names[0]}`"
    total = " + ".join(["0D", *[f"coalesce(`{n}`, 0D)" for n in names]])
    present = " + ".join(f"int(`{n}` IS NOT NULL)" for n in names)
    return f"CASE WHEN {present} > 0 THEN ({total}) / ({present}) END"


def null_if_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def normalized_power(power: Column, unit: Column) -> Column:
    """Ten-minute watt-hours to mean kilowatts; other units pass through."""
    return F.when(unit == "Wh", power * F.lit(config.WH_TO_KW)).otherwise(power)


def normalized_speed(speed: Column, unit: Column) -> Column:
    """Radians per second to revolutions per minute; other units pass through."""
    return F.when(unit == "rad/s", speed * (F.lit(60.0) / (F.lit(2.0) * F.pi()))).otherwise(speed)


def circular_distance(first: Column, second: Column) -> Column:
    """Smaller angle between two directions in degrees, as |a-b| folded at 180."""
    gap = F.abs(first - second)
    return F.when(gap > 180, F.lit(360) - gap).otherwise(gap)


def power_efficiency(power: Column, wind: Column) -> Column:
    """Power per cubed wind speed; 0 in still air or when either input is missing."""
    cubed = wind * wind * wind
    return F.coalesce(F.when(cubed > 0.1, power / cubed).otherwise(zero()), zero())
