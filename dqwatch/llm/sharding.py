"""Proportional stratified interleaving: every shard has the mixture of sources of the whole table.

Rows are ranked within their source by a seeded hash (a shuffle that any rerun repeats), the fractional rank
``(rank - 1/2) / rows of the source`` orders all rows, and the order is cut into equal runs. A source with a share
of p of all rows has a share of p in every shard, up to about one row, whatever its size.

No task sees a whole source: rows are dealt by (source, slice of the hash range) and later by slice of the order;
ranks are local ranks plus the number of rows in the slices before. The slices grow in number with the table, and
their counts are summed up in two levels, so that no task reads all of them either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dqwatch.llm.common import read, text_or_empty

#: Mean number of rows in a slice.
SLICE_ROWS = 500
HEX_RANGE = 1 << 32


def _offsets(rows: DataFrame, slices: int, *group: str) -> DataFrame:
    """``before``: rows of the group in lower slices, for each (group, slice); prefix sums in two levels."""
    width = max(1, round(slices**0.5))
    counts = rows.groupBy(*group, "slice").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("block", F.floor(F.col("slice") / width))
    blocks = counts.groupBy(*group, "block").agg(F.sum("n").alias("block_n"))
    earlier = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    blocks = blocks.select(
        *group,
        "block",
        F.coalesce(F.sum("block_n").over(earlier), F.lit(0)).alias("blocks_before"),
        F.sum("block_n").over(whole).alias("group_n"),
    )
    inside = Window.partitionBy(*group, "block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counts.join(blocks, [*group, "block"]).select(
        *group, "slice", (F.col("blocks_before") + F.col("inside")).alias("before"), "group_n"
    )


def interleave(
    rows: DataFrame, key: Column, source: Column, shards: int, seed: str = "interleave", ties: tuple[str, ...] = ()
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, without gaps); shard sizes differ by one row at most.

    ``key`` seeds the shuffle; columns ``ties`` order rows of one key. A null source is a source of its own, a null
    key a key of its own. Equal rows change places freely, which nobody can tell. No rows give no rows; with fewer
    rows than shards some shards are empty. Columns of ``rows`` named like the two new ones are replaced; inner
    names start with two underscores.
    """
    total = rows.count()
    slices = max(1, -(-total // SLICE_ROWS))
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    deal = rows.select(
        F.struct(*kept).alias("row"),
        F.struct(*[F.col(c) for c in ties]).alias("ties") if ties else F.lit(0).alias("ties"),
        F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")).alias("source"),
        hashed.alias("hash"),
    ).withColumn("slice", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * slices / HEX_RANGE))
    local = Window.partitionBy("source", "slice").orderBy("hash", "ties")
    ranked = (
        deal.withColumn("local", F.row_number().over(local))
        .join(_offsets(deal, slices, "source"), ["source", "slice"])
        .withColumn("share", (2 * (F.col("before") + F.col("local")) - 1) / (2 * F.col("group_n")))
        .select("row", "ties", "source", "hash", "share", F.floor(F.col("share") * slices).alias("slice"))
    )
    order = Window.partitionBy("slice").orderBy("share", "hash", "source", "ties")
    cuts = _offsets(ranked.withColumn("everything", F.lit(0)), slices, "everything").select("slice", "before")
    place = F.col("before") + F.col("local") - 1
    return (
        ranked.withColumn("local", F.row_number().over(order))
        .join(cuts, "slice")
        .select("row.*", place.alias("__place"), F.expr(f"(before + local - 1) * {shards} div {max(total, 1)}").alias("__shard"))
        .select(
            *kept,
            F.col("__shard").cast("int").alias("shard"),
            (F.col("__place") - F.expr(f"(__shard * {total} + {shards - 1}) div {shards}")).alias("slot"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in 24 shards by the law ``rows``."""
    documents = read(spark, sf_dir, "documents", "doc_id", "text", "source").select(
        "doc_id",
        "source",
        (F.octet_length(text_or_empty()) + 8).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    dealt = interleave(documents, F.col("doc_id"), F.col("source"), 24, ties=("text_crc32", "size"))
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
