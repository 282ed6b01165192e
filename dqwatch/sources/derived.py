"""A file manifest and delivery profiles derived from the ``events`` table.

The benchmark tables hold no deliveries, so one event stands for one uploaded file. The rules are
plain arithmetic on the event columns; every source, fault and date form comes out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqwatch.session import pin_utc

COLUMNS = [
    "snapshot_day",
    "from_period",
    "source_id",
    "filename",
    "rows",
    "status",
    "is_duplicated",
    "file_size",
    "uploaded_at",
    "status_message",
]


EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pin_utc(spark).read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def _dealt_out(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table stored as less than two full splits per core, dealt out by key.

    Spark cuts a smaller file into a split per core, but a row group is read by one task, and there may be a single one.
    A large table has many splits and is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() <= 2 * cores else rows


def _group() -> Column:
    return F.floor(F.col("user_id") / 10).cast("bigint")


def _entity_label(k: Column) -> Column:
    stem = F.when(k == 2, F.col("event_type")).otherwise(F.lit("all"))
    return F.concat(stem, F.lit("L"), (F.col("user_id") % 2).cast("string"))


def derive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivered file, without the period column."""
    e, g, d = F.col("event_id"), F.col("g"), F.col("snapshot_day")
    k, ent, fd, rows = F.col("k"), F.col("ent"), F.col("fd"), F.col("rows")
    lag = (
        F.when(k == 0, 0).when(e % 23 == 0, 1).when(e % 37 == 0, 9).when(e % 41 == 0, 4).otherwise(0)
    )
    date_text = (
        F.when(e % 29 == 0, F.date_format(fd, "yyyy-MM-dd"))
        .when(e % 31 == 0, F.date_format(fd, "yyyyMMdd"))
        .otherwise(F.date_format(fd, "yyyy_MM_dd"))
    )
    filename = F.when(
        e % 7 == 0, F.concat(F.lit("daily_"), ent, F.lit("_report.csv"))
    ).otherwise(
        F.concat(
            F.substring(F.md5(e.cast("string")), 1, 8),
            F.lit("_"),
            ent,
            F.lit("_payments_report_"),
            date_text,
            F.lit(".csv"),
        )
    )
    status = (
        F.when(k < 2, "processed")
        .when(e % 19 == 0, "failure")
        .when(e % 17 == 0, "stopped")
        .when(e % 43 == 0, "deleted")
        .when((rows == 0) & (e % 2 == 0), "empty")
        .otherwise("processed")
    )
    # 22:30 on the evening before, after that day's snapshot
    late = F.when(k == 0, 0).when(e % 59 == 0, -570 - e % 20).when(e % 53 == 0, 540).when(e % 11 == 0, 300).otherwise(0)
    message = (
        F.when(k < 2, F.lit(None).cast("string"))
        .when((e % 19 == 0) & (e % 2 == 0), "column structure mismatch")
        .when(e % 19 == 0, "schema validation error")
        .when(e % 17 == 0, "File duplicated")
    )
    minutes = F.lit(8 * 60) + e % 20 + late
    return (
        _dealt_out(_events(spark, sf_dir), "event_id")
        .withColumn("g", _group())
        .withColumn("k", g % 3)
        .withColumn("snapshot_day", F.to_date("ts"))
        .withColumn("ent", _entity_label(k))
        .withColumn("fd", F.date_sub(d, lag.cast("int")))
        .withColumn(
            "rows",
            F.when(k < 2, 1000 + e % 50)
            .when(e % 13 == 0, F.lit(0))
            .otherwise(F.floor(F.col("value") * 100))
            .cast("bigint"),
        )
        .select(
            "snapshot_day",
            (200000 + g).cast("string").alias("source_id"),
            filename.alias("filename"),
            "rows",
            status.alias("status"),
            ((k == 2) & ((e % 17 == 0) | (e % 47 == 0))).alias("is_duplicated"),
            (rows * 64 + e % 97).cast("bigint").alias("file_size"),
            F.when(
                (k != 2) | (e % 61 != 0), d.cast("timestamp") + F.make_dt_interval(mins=minutes.cast("int"))
            ).alias("uploaded_at"),
            message.alias("status_message"),
        )
    )


def derive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both periods of every day: a file is today's on its day and last week's seven days later.

    One scan serves both roles. A day after the last delivered one has no manifest, so baseline rows
    that would fall there are dropped.
    """
    last_day = _events(spark, sf_dir).select(F.max(F.to_date("ts"))).scalar()
    roles = F.array(
        F.struct(F.col("snapshot_day").alias("snapshot_day"), F.lit("today").alias("from_period")),
        F.struct(
            F.date_add("snapshot_day", 7).alias("snapshot_day"), F.lit("last_weekday").alias("from_period")
        ),
    )
    files = derive_files(spark, sf_dir)
    others = [c for c in files.columns if c != "snapshot_day"]
    return (
        files.select(F.inline(roles), *others)
        .filter(F.col("snapshot_day") <= last_day)
        .select(*COLUMNS)
    )


def derive_cv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery profile per source, with gaps and odd headings; every ninth source has none."""
    g, k = F.col("g"), F.col("g") % 3
    name = F.concat(F.lit("Settlement_Layout_"), g.cast("string"))
    heading = (
        F.when(g % 8 == 7, F.lit("#"))
        .when(g % 8 == 6, F.lit("Delivery profile"))
        .otherwise(F.concat(F.lit("# _"), name, F.lit("_")))
    )
    first, last = F.array_min("ents"), F.array_max("ents")

    def line(when: Column, *parts: Column | str) -> Column:
        return F.when(when, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    always = F.lit(True)
    schedules = (
        F.when(g % 5 == 2, "; [hash]_onceL9_payments_report_YYYY_MM_DD.csv (weekdays)")
        .when(g % 5 == 3, " (daily); [hash]_weeklyL9_report_YYYY_MM_DD.csv (Mondays)")
        .when(g % 5 == 4, " (weekdays)")
        .otherwise("")
    )
    text = F.concat_ws(
        "\n",
        heading,
        line(always, "Entities: ", F.array_join("ents", ", ")),
        line(always, "Expected files: [hash]_", first, "_payments_report_YYYY_MM_DD.csv", schedules),
        line((g % 2 == 0) & (g % 10 != 4), "Arrives 08:00-08:20 UTC"),
        line((g % 2 == 1) & (g % 10 != 3), "Arrives 08:00–08:20 UTC"),
        line(g % 10 == 3, "Arrives 08:00–08:20 UTC or 17:00–17:30 UTC"),
        line((k == 0) & (g % 10 != 4), "usual ~08:10 UTC"),
        line(g % 10 == 4, "usual ~08:10 UTC, sometimes usual ~13:05 UTC"),
        line(g % 7 == 2, first, " arrives 06:00-06:30 UTC and 12:50-13:10 UTC"),
        line(g % 7 == 3, last, " usual ~13:00 UTC"),
        line(g % 7 == 5, first, " usual Monday 1k-2k; ", last, " usual Monday 5k-90k"),
        line(g % 7 == 6, first, " typical range 2k-40k"),
        line(g % 4 == 0, "expected volume >1000 records"),
        line(g % 4 == 1, "usual Monday 1", (g % 5).cast("string"), "k-2", (g % 7).cast("string"), "k records"),
        line(g % 4 == 2, "typical range 5k-30k"),
        line(g % 4 == 3, "95% confidence band: 1,211-69,600"),
        line(g % 5 == 1, "Not expected on: Saturday, Sunday"),
        line(k == 2, "Regularly empty: errorL1"),
        line(k == 2, "Variable arrival: signupL0"),
        line(g % 6 == 5, "Expected coverage: D+3"),
        line(always, "Contact: provider desk"),
    )
    # distinct (group, label) pairs first: a group has at most two labels per event type
    labels = (
        _events(spark, sf_dir)
        .select(_group().alias("g"), _entity_label(_group() % 3).alias("ent"))
        .distinct()
    )
    docs = labels.groupBy("g").agg(F.sort_array(F.collect_set("ent")).alias("ents"))
    return docs.filter(g % 9 != 8).select(
        F.concat((200000 + g).cast("string"), F.lit("_native.md")).alias("file_name"), text.alias("text")
    )
