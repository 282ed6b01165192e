"""Lists of names per group, split into parts of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dqwatch.operators.lookup import lookup

NAMES_PER_PART = 1000


def name_parts(
    names: DataFrame,
    keys: list[str],
    name: str,
    per_part: int = NAMES_PER_PART,
    min_copies: int = 1,
    **lookup_options: int,
) -> DataFrame:
    """Sorted distinct names of each group with their copies, in parts of about ``per_part`` names.

    A group that fits has one part, number 0. A larger group keeps every name, spread over more parts
    by hash, so no task ever holds a whole large group. Copies are counted before the shuffle. Groups
    with fewer than ``min_copies`` rows are left out.
    """
    distinct = names.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("copies"))
    sizes = distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_names"), F.sum("copies").alias("total")
    )
    sized = lookup(
        distinct,
        sizes.filter(F.col("total") >= min_copies),
        keys,
        "inner",
        key_counts=sizes.select(*keys, F.col("n_names").alias("n")),
        **lookup_options,
    )
    part = F.pmod(F.xxhash64(name), F.ceil(F.col("n_names") / F.lit(per_part))).cast("int")
    return (
        sized.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(
            F.first("total").alias("total"),
            F.first("n_names").alias("n_names"),
            F.sort_array(F.collect_list(F.struct(F.col(name).alias("name"), "copies"))).alias("items"),
        )
    )
