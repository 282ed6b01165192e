"""File patterns of one source-day that differ by a single edit, found by their deletion neighbourhoods.

Two patterns of one length differ in one character just where they agree after that place is left out of both; one is the
other with a character more just where leaving some character out of it gives the other. So patterns meet under such keys
and are counted there in windows; no two of them are ever compared, and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from dqwatch.schema import FINDING

GROUP = ["snapshot_day", "source_id"]


def near_names(names: DataFrame) -> DataFrame:
    """Per distinct (snapshot_day, source_id, pattern) the number of others one edit away and the first of them by name.

    Patterns without such a neighbour have no row. Each pattern makes one row a character and one more.
    """
    distinct = names.select(*GROUP, "pattern").filter(F.col("pattern").isNotNull()).distinct()
    # patterns of no day or source have no neighbours
    distinct = distinct.filter(F.col("snapshot_day").isNotNull() & F.col("source_id").isNotNull())
    # out of a run of one character any place leaves the same rest: the first stands for it
    without = F.expr(
        """transform(sequence(0, length(pattern)), i -> struct(
            i AS place,
            if(i = 0, pattern, concat(substring(pattern, 1, i - 1), substring(pattern, i + 1))) AS rest,
            i = 1 OR (i > 1 AND substring(pattern, i, 1) <> substring(pattern, i - 1, 1)) AS begins))"""
    )
    # a pattern stands whole, as place 0, beside those that become it; both windows use this one shuffle
    cut = distinct.select(*GROUP, "pattern", F.inline(without)).repartition(*GROUP, "rest")

    # one other character: all patterns under a rest and a place are neighbours of each other
    by_place = Window.partitionBy(*GROUP, "rest", "place").orderBy("pattern")
    all_of_place = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.first("pattern").over(all_of_place)
    changed = cut.withColumns(
        {
            "n": F.count(F.lit(1)).over(all_of_place) - 1,
            "other": F.when(F.row_number().over(by_place) > 1, least).otherwise(F.lead("pattern").over(by_place)),
        }
    )

    # one character more or less: whole patterns meet those that become them
    of_rest = Window.partitionBy(*GROUP, "rest")
    whole, longer = F.col("place") == 0, F.col("begins") & F.col("is_name")
    found = changed.withColumns(
        {
            "is_name": F.max(whole).over(of_rest),
            "n_longer": F.count_if("begins").over(of_rest),
            "first_longer": F.min(F.when(F.col("begins"), F.col("pattern"))).over(of_rest),
        }
    )
    n = F.when(whole, F.col("n_longer")).otherwise(F.col("n") + longer.cast("int"))
    other = F.when(whole, F.col("first_longer")).otherwise(F.least("other", F.when(longer, F.col("rest"))))
    return (
        found.select(*GROUP, "pattern", n.alias("n"), other.alias("other"))
        .filter(F.col("n") > 0)
        .groupBy(*GROUP, "pattern")
        .agg(F.sum("n").alias("n_near"), F.min("other").alias("nearest"))
    )


def near_name_findings(by_pattern: DataFrame) -> DataFrame:
    """Informational findings of the duplicate detector about today's patterns that have a neighbour."""
    near = near_names(by_pattern.filter(F.col("n_today") > 0))
    values = {
        "detector": F.lit("duplicated_failed"),
        "kind": F.lit("near_identical_name"),
        "pattern": F.col("pattern"),
        "metric": F.col("n_near"),
        "severity": F.lit(0),
        "message": F.concat(
            F.col("pattern"),
            F.lit(" differs by one character from "),
            F.col("n_near").cast("string"),
            F.when(F.col("n_near") == 1, " other name, ").otherwise(" other names, the first being "),
            F.col("nearest"),
        ),
    }
    columns = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING.fields]
    return near.select(*GROUP, *columns)
