"""Volume history as a state that grows by one day at a time, so that a daily run reads one day and not the history.

Per source, pattern and weekday the state keeps the latest volumes of that weekday, as many as a band looks back on and
one more: a run for a day that is merged already leaves that day out. Sums, squares and extremes are made from these
few numbers, exactly, so a band equals that of :func:`dqwatch.operators.history.volume_bands` over the whole history.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqwatch.operators.history import Z_95, band_bounds
from dqwatch.operators.lookup import shuffled

KEYS = ["source_id", "pattern", "weekday"]
ENTRY = "struct<day: date, volume: bigint>"


def _keyed(volumes: DataFrame) -> DataFrame:
    return volumes.withColumn("weekday", F.weekday("day"))


def _latest(entries: Column, n_days: int) -> Column:
    """The last entries by day."""
    return F.slice(F.reverse(F.array_sort(entries)), F.lit(1), F.lit(n_days + 1))


def state_of(volumes: DataFrame, n_days: int = 8) -> DataFrame:
    """The state after all days of ``volumes`` (day, source_id, pattern, volume), one row per pattern and day."""
    entry = F.struct("day", "volume").cast(ENTRY)
    # a weekday of one pattern has one entry a week
    entries = _keyed(volumes).groupBy(*KEYS).agg(F.collect_list(entry).alias("recent"))
    return entries.withColumn("recent", _latest(F.col("recent"), n_days))


def merged(state: DataFrame, volumes: DataFrame, n_days: int = 8) -> DataFrame:
    """``state`` with the volumes of one more day; a day that is there already is replaced."""
    new = _keyed(volumes).select(*KEYS, F.col("day").alias("_day"), F.struct("day", "volume").cast(ENTRY).alias("_new"))
    both = state.join(shuffled(new), KEYS, "full")
    others = F.filter(F.coalesce("recent", F.array().cast(f"array<{ENTRY}>")), lambda e: F.col("_day").isNull() | (e["day"] != F.col("_day")))
    entries = F.concat(others, F.array_compact(F.array("_new")))
    return both.select(*KEYS, _latest(entries, n_days).alias("recent"))


def bands_on(state: DataFrame, day: date, n_days: int = 8, min_days: int = 3, z: float = Z_95) -> DataFrame:
    """Bounds for the patterns that have volumes before ``day`` on its weekday."""
    earlier = F.slice(F.filter("recent", lambda e: e["day"] < F.lit(day)), F.lit(1), F.lit(n_days))
    volumes = F.transform(earlier, lambda e: e["volume"].cast("decimal(18,0)"))
    zero = F.lit(0).cast("decimal(28,0)")
    rows = state.filter(F.col("weekday") == F.weekday(F.lit(day))).withColumn("v", volumes).filter(F.size("v") > 0)
    rows = rows.withColumns(
        {
            "n_days": F.size("v").cast("bigint"),
            "sum_volume": F.reduce("v", zero, lambda a, x: (a + x).cast("decimal(28,0)")).cast("decimal(19,0)"),
            "sum_squares": F.reduce("v", zero, lambda a, x: (a + x * x).cast("decimal(28,0)")),
            "lowest": F.array_min("v").cast("bigint"),
            "highest": F.array_max("v").cast("bigint"),
        }
    )
    bounds = band_bounds(min_days, z)
    return rows.select(
        F.lit(day).alias("day"), "source_id", "pattern", "n_days", "lowest", "highest", *[c.alias(n) for n, c in bounds.items()]
    )


def write_state(state: DataFrame, path: str, through: date) -> None:
    """Store the state after ``through``; an earlier attempt for the same day is replaced, other days stay."""
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/through={through.isoformat()}")


def read_state(spark: SparkSession, path: str, before: date) -> DataFrame | None:
    """The latest stored state of the days before ``before``; None if there is none."""
    stored = spark.read.option("basePath", path).parquet(path)
    latest = stored.filter(F.col("through") < F.lit(before)).agg(F.max("through")).first()[0]
    return None if latest is None else spark.read.parquet(f"{path.rstrip('/')}/through={latest}")
