"""Join rows to a table that has one row per key, whatever the size or skew of either side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
#: Rows in memory take several times the bytes of the compressed columns they come from: 7.5 times in the largest lookup measured.
EXPANSION = 4
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the stored inputs a plan reads; None where the plan cannot be inspected.

    Catalyst's own estimate multiplies the sides of every join. Facts are unique on their keys, made by
    aggregation and unique-key joins, so their inputs bound them.
    """
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except AttributeError:
        return None


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that is never broadcast: Spark sizes derived tables by their compressed inputs, far too small."""
    return df.hint("merge")


def lookup(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    how: str = "left",
    key_counts: DataFrame | None = None,
    salt_on: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    can_be_hot: bool = True,
) -> DataFrame:
    """``rows`` joined to ``facts``, which must be unique on ``keys``.

    Facts that take less than ``broadcast_bytes`` in memory, ``EXPANSION`` times their stored input, are broadcast.
    Otherwise both sides are shuffled, and a key with more than ``hot_rows`` rows is spread over as many salts as it
    needs: its one facts row is repeated per salt. Only the ``HOT_KEYS`` keys with the most rows are treated so, which
    bounds the list; whatever lies below has less than 1 / ``HOT_KEYS`` of all rows and is left to Spark's skew join.

    The list is counted and collected when the join is built, at most ``HOT_KEYS`` rows. Rows that are aggregates
    already (``can_be_hot`` False) are not counted for it: that would make them twice.

    ``key_counts`` (keys plus ``n``) saves the count when the caller has it already; ``salt_on`` names the
    columns that tell the rows of a key apart, all columns by default.
    """
    size = input_bytes(facts)
    if size is not None and size * EXPANSION <= broadcast_bytes:
        return rows.join(F.broadcast(facts), keys, how)

    if not can_be_hot:
        return rows.join(shuffled(facts), keys, how)
    counts = key_counts if key_counts is not None else rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    fan = F.ceil(F.col("n") / F.lit(hot_rows)).cast("int").alias("_fan")
    most = counts.filter(F.col("n") > hot_rows).orderBy(F.desc("n"), *keys).limit(HOT_KEYS).select(*keys, fan)
    # listed before the join is planned: as part of the plan, lookups upon lookups would repeat their inputs many times over
    if not (listed := most.collect()):
        salted_facts = facts.withColumn("_salt", F.lit(0))
        return rows.withColumn("_salt", F.lit(0)).join(shuffled(salted_facts), [*keys, "_salt"], how).drop("_salt")
    hot = F.broadcast(rows.sparkSession.createDataFrame(listed, most.schema))
    # copies of a row hash alike, so the partition they are read in takes part in the salt
    spread = F.pmod(F.xxhash64(*(salt_on or rows.columns), F.spark_partition_id()), F.col("_fan")).cast("int")
    salted_rows = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(spread, F.lit(0))).drop("_fan")
    salted_facts = (
        facts.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1)))
        .drop("_fan")
    )
    return salted_rows.join(shuffled(salted_facts), [*keys, "_salt"], how).drop("_salt")
