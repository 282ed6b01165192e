"""Readers for the nested JSON manifests: ``<day folder>/files.json`` and ``files_last_weekday.json``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dqwatch.operators.lookup import lookup
from dqwatch.schema import FILE_OBJECT
from dqwatch.session import pin_utc
from dqwatch.sources.json_split import CUT_OFF, UNREADABLE, split_files, split_texts

MANIFEST_FILES = {"files.json": "today", "files_last_weekday.json": "last_weekday"}
CORRUPT = "_corrupt"
MALFORMED, UNDATED = "element is no JSON", "undated"
TAGS = ["snapshot_day", "from_period", "snapshot_at"]
_OBJECT = StructType([*FILE_OBJECT.fields, StructField(CORRUPT, StringType())])


def _whole(name: str) -> Column:
    """``1200``, ``1200.0`` and ``"1200"`` are one number; what is none becomes NULL."""
    return F.col(name).try_cast("decimal(38,6)").try_cast("bigint").alias(name)


def _parsed(element: Column) -> Column:
    return F.from_json(element, _OBJECT, {"columnNameOfCorruptRecord": CORRUPT})


def _checked(elements: DataFrame) -> DataFrame:
    """Elements with their parsed ``file``; what is no JSON gets a problem."""
    parsed = elements.withColumn("file", F.when(F.col("problem").isNull(), _parsed(F.col("element"))))
    return parsed.withColumn("problem", F.coalesce("problem", F.when(F.col(f"file.{CORRUPT}").isNotNull(), MALFORMED)))


def _file_rows(checked: DataFrame, keep: list[str], strict: bool) -> DataFrame:
    """One row per element without a problem; ``strict`` looks for problems first and raises."""
    if strict and (bad := _unread_rows(checked).first()):
        raise ValueError(f"unreadable manifest: {bad.problem} (source {bad.source_id}, position {bad.position}): {bad.text}")
    rows = checked.filter(F.col("problem").isNull()).select(*keep, "source_key", "file.*")
    return rows.select(
        *keep,
        F.coalesce("source_id", "source_key").alias("source_id"),
        "filename",
        _whole("rows"),
        "status",
        F.col("is_duplicated").try_cast("boolean").alias("is_duplicated"),
        _whole("file_size"),
        F.try_to_timestamp("uploaded_at").alias("uploaded_at"),
        "status_message",
    )


def _unread_rows(checked: DataFrame, *keep: str) -> DataFrame:
    return checked.filter(F.col("problem").isNotNull()).select(
        *keep, F.col("source_key").alias("source_id"), F.col("n").alias("position"), "problem", F.col("element").alias("text")
    )


def flatten_documents(docs: DataFrame, *keep: str, strict: bool = False) -> DataFrame:
    """``value`` holds ``{source_id: [file, …]}``; one row per file comes out.

    A ``source_id`` inside the file object overrides the key. Values that do not fit their column become NULL. An element
    that is no JSON object costs itself only and is listed by :func:`unread_in_documents`; ``strict`` raises on it.
    """
    return _file_rows(_checked(split_texts(docs, *keep)), list(keep), strict)


def unread_in_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, source_id, position, problem and text of what :func:`flatten_documents` leaves out."""
    return _unread_rows(_checked(split_texts(docs, *keep)), *keep)


def read_manifest_file(spark: SparkSession, path: str) -> DataFrame:
    """One manifest document, flattened."""
    return _file_rows(_elements(_pieces(spark, [path])), [], strict=False)


def read_manifest(spark: SparkSession, *day_folders: str, strict: bool = False) -> DataFrame:
    """All files of one or many day folders (globs allowed), both periods, in one plan.

    The snapshot day is the leading date of the folder name, and ``snapshot_at`` the time behind it, as in
    ``2025-09-08_20_00_UTC`` (NULL without one). A large document is cut and read by many tasks. ``strict`` raises
    when a folder lacks one of its two documents or has no date, or on any element that is no file object; else
    :func:`unread_elements` and :func:`unread_documents` list these.
    """
    paths = _paths(day_folders)
    if strict:
        _require_dated_pairs(pin_utc(spark).read.text(paths, wholetext=True))
    return _file_rows(_elements(_tagged(_pieces(spark, paths)), *TAGS), TAGS, strict)


def unread_elements(spark: SparkSession, *day_folders: str) -> DataFrame:
    """What the reader leaves out: path, day, period, source_id, the part's first byte (``block``), the element's position in
    the part, the problem and the text."""
    elements = _elements(_tagged(_pieces(spark, _paths(day_folders))), *TAGS)
    return _unread_rows(elements, "path", *TAGS, "block")


def unread_documents(spark: SparkSession, *day_folders: str) -> DataFrame:
    """(path, problem) of documents that the reader can't use whole: ``malformed`` elements, or a folder that is ``undated``."""
    tagged = _tagged(_pieces(spark, _paths(day_folders)))
    malformed = unread_elements(spark, *day_folders).select("path", F.lit("malformed").alias("problem"))
    undated = tagged.filter(F.col("snapshot_day").isNull()).select("path", F.lit(UNDATED).alias("problem"))
    return malformed.unionByName(undated).distinct()


def _paths(day_folders: tuple[str, ...]) -> list[str]:
    return [f"{folder.rstrip('/')}/files*.json" for folder in day_folders]


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents cut behind every closing brace, in parts that tasks read side by side."""
    block, length = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")
    return pin_utc(spark).read.option("lineSep", "}").text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        block.alias("block"),
        (block + length >= F.col("_metadata.file_size")).alias("is_last"),
    )


def _elements(pieces: DataFrame, *tags: str) -> DataFrame:
    """Checked elements of all documents. Elements whose source is named in an earlier part get it from there.

    Only documents of several parts need that. Their parts, one row each, are read for it a second time.
    """
    keys = ["path", "block"]
    found = _checked(split_files(pieces, *tags).filter(F.col("element").isNotNull()))
    named = found.filter(F.col("source_key").isNotNull() | (F.col("block") == 0))
    several = pieces.filter(~((F.col("block") == 0) & F.col("is_last")))
    parts = split_files(several, *tags).filter(F.col("element").isNull())
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("path").orderBy("block")
    parts = (
        parts.withColumn("source_before", F.last("last_source", ignorenulls=True).over(before))
        .withColumn("has_next", F.lead(F.lit(True), 1, False).over(order))
        .withColumn("next_lead", F.lead("lead").over(order))
    )
    inherited = found.filter(F.col("source_key").isNull() & (F.col("block") > 0)).drop("source_key")
    inherited = inherited.join(parts.select(*keys, F.col("source_before").alias("source_key")), keys, "left")
    return named.unionByName(inherited).unionByName(_at_borders(parts).select(*named.columns))


def _at_borders(parts: DataFrame) -> DataFrame:
    """The element that a part ends in, closed by the next part where it has to be."""
    alone = F.concat("left_open", F.lit("}"))
    joined = F.concat("left_open", F.lit("}"), "next_lead", F.lit("}"))
    is_whole = _parsed(alone)[CORRUPT].isNull()
    ends = parts.filter(F.col("left_open").isNotNull()).withColumn("source_key", F.coalesce("last_source", "source_before"))
    ends = ends.withColumn("element", F.when(~is_whole, F.coalesce(joined, alone)).otherwise(alone))
    ends = ends.withColumn("problem", F.when(~F.col("has_next"), CUT_OFF))
    # what stands between two elements of different parts and belongs to neither
    taken = F.lag("left_open").over(Window.partitionBy("path").orderBy("block"))
    lost = parts.withColumn("before", taken).filter(
        (F.trim("lead") != "") & (F.col("before").isNull() | _parsed(F.concat("before", F.lit("}")))[CORRUPT].isNull())
    )
    lost = lost.select(
        *[c for c in parts.columns if c not in ("source_key", "element", "problem", "n")],
        F.col("source_before").alias("source_key"),
        F.lit(0).cast("bigint").alias("n"),
        F.col("lead").alias("element"),
        F.lit(UNREADABLE).alias("problem"),
    )
    return _checked(ends.unionByName(lost))


def _tagged(pieces: DataFrame) -> DataFrame:
    """Pieces with their snapshot day and time and their period, as folder and file name tell them; other files go."""
    name, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    day = F.try_to_date(F.substring(folder, 1, 10), "yyyy-MM-dd")
    clock = F.regexp_extract(folder, r"^.{10}_(\d{2})_(\d{2})_UTC", 1), F.regexp_extract(folder, r"^.{10}_(\d{2})_(\d{2})_UTC", 2)
    at = F.try_to_timestamp(F.concat(F.substring(folder, 1, 10), F.lit(" "), clock[0], F.lit(":"), clock[1]), F.lit("yyyy-MM-dd HH:mm"))
    period = F.when(name == "files.json", "today").when(name == "files_last_weekday.json", "last_weekday")
    tagged = pieces.withColumns({"snapshot_day": day, "snapshot_at": at, "from_period": period})
    return tagged.filter(F.col("from_period").isNotNull())


def _require_dated_pairs(docs: DataFrame) -> None:
    found: dict[str, set[str]] = {}
    for path in docs.inputFiles():
        folder, _, name = path.rpartition("/")
        found.setdefault(folder, set()).add(name)
    for folder, names in found.items():
        try:
            date.fromisoformat(folder.rpartition("/")[2][:10])
        except ValueError:
            raise ValueError(f"no date leads the folder {folder}") from None
        lacking = sorted(set(MANIFEST_FILES) - names)
        if lacking:
            raise FileNotFoundError(f"{folder} lacks {', '.join(lacking)}")


def source_slice(manifest: DataFrame, source_id: str) -> DataFrame:
    """Both periods of one source."""
    return manifest.filter(F.col("source_id") == source_id)


def combine_periods(today: DataFrame, last_weekday: DataFrame) -> DataFrame:
    """Tag and stack two single-period frames."""
    return today.withColumn("from_period", F.lit("today")).unionByName(
        last_weekday.withColumn("from_period", F.lit("last_weekday")), allowMissingColumns=True
    )


def source_data(manifest: DataFrame, cv_docs: DataFrame) -> DataFrame:
    """Manifest rows with the name and the profile text of their source, NULL where there is no profile."""
    return lookup(manifest, cv_docs.select("source_id", "source_name", F.col("text").alias("cv_text")), ["source_id"])
