"""Source profiles ("CVs"): discovery, naming and extraction of the documented expectations.

A profile is free text. Each documented fact has one line form, recognised by a regular expression;
what no expression recognises is kept and can be listed with :func:`cv_unparsed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqwatch.functions.naming import expected_pattern

# Line forms of the profile text.
WINDOW = r"(\d{2}:\d{2})[-–](\d{2}:\d{2}) UTC"
USUAL_TIME = r"usual ~(\d{2}:\d{2}) UTC"
WEEKDAY_RANGE = r"usual ([A-Z][a-z]+day) ([0-9.,]+k?)[-–]([0-9.,]+k?)"
TYPICAL_RANGE = r"typical range ([0-9.,]+k?)[-–]([0-9.,]+k?)"
CONFIDENCE_BAND = r"confidence band: ([0-9,]+)[-–]([0-9,]+)"
MINIMUM = r"expected volume >([0-9.,]+k?)"
ENTITIES = r"(?m)^Entities: (.*)$"
EXPECTED_FILES = r"(?m)^Expected files: (.*)$"
NOT_EXPECTED = r"(?m)^Not expected on: (.*)$"
REGULARLY_EMPTY = r"(?m)^Regularly empty: (.*)$"
VARIABLE_ARRIVAL = r"(?m)^Variable arrival: (.*)$"
COVERAGE = r"Expected coverage: D\+(\d+)"
KNOWN_LINE = (
    r"^$|^#|^Entities: |^Expected files: |\d{2}:\d{2}[-–]\d{2}:\d{2} UTC|usual ~\d{2}:\d{2} UTC"
    r"|usual [A-Z][a-z]+day [0-9]|typical range [0-9]|confidence band: [0-9]|expected volume >[0-9]"
    r"|^Not expected on: |^Regularly empty: |^Variable arrival: |Expected coverage: D\+[0-9]"
)
FILE_SCHEDULE = r"\s*\(([^()]*)\)\s*$"
CV_SUFFIX = "_native.md"
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# Words of a file's schedule and the days they stand for: bit 0 is Monday.
SCHEDULE_MASKS = {"daily": 127, "weekday": 31, "weekend": 96, **{d.lower(): 1 << i for i, d in enumerate(WEEKDAYS)}}
MINUTES_PER_DAY = 1440


def source_name(text: Column, source_id: Column) -> Column:
    """Heading text of the first line, or ``Source_<id>`` when there is no usable heading."""
    first = F.trim(F.regexp_replace(F.split(text, "\n", 2)[0], r"\s+$", ""))
    bare = F.regexp_replace(F.regexp_replace(first, r"^#+", ""), r"^\s+|\s+$", "")
    stripped = F.regexp_replace(bare, r"^_+|_+$", "")
    named = F.when(first.startswith("#"), F.nullif(stripped, F.lit("")))
    return F.coalesce(named, generic_name(source_id))


def generic_name(source_id: Column) -> Column:
    return F.concat(F.lit("Source_"), source_id)


def name_cvs(files: DataFrame, extract_names: bool = True) -> DataFrame:
    """``(file_name, text)`` → ``(source_id, source_name, text)``."""
    source_id = F.replace(F.regexp_replace("file_name", r"\.md$", ""), F.lit("_native"), F.lit(""))
    name = source_name(F.col("text"), source_id) if extract_names else generic_name(source_id)
    return files.select(source_id.alias("source_id"), name.alias("source_name"), "text")


def read_cvs(spark: SparkSession, folder: str, extract_names: bool = True) -> DataFrame:
    """Discover ``<source_id>_native.md`` in a folder; raises when the folder or the files are absent."""
    files = (
        spark.read.option("pathGlobFilter", f"*{CV_SUFFIX}")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    )
    blank = _files_without_content(spark, folder)
    if not blank and not files.inputFiles():
        raise ValueError(f"No CV files (*{CV_SUFFIX}) found in {folder}")
    if blank:
        names = F.explode(F.array(*[F.lit(name) for name in blank]))
        files = files.unionByName(spark.range(1).select(names.alias("file_name"), F.lit("").alias("text")))
    return name_cvs(files, extract_names)


def _files_without_content(spark: SparkSession, folder: str) -> list[str]:
    """Names of zero-byte profiles, which a file scan leaves out."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*{CV_SUFFIX}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(status.getPath().getName() for status in found or [] if status.getLen() == 0)


def first_sources(cv_docs: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` sources in file order, all of them when ``n`` is None."""
    if n is None:
        return cv_docs
    return cv_docs.orderBy(F.concat("source_id", F.lit(CV_SUFFIX))).limit(n)


def missing_cvs(manifest: DataFrame, cv_docs: DataFrame) -> DataFrame:
    """Sources that deliver files but have no profile."""
    delivered = manifest.select("source_id").distinct()
    return delivered.join(cv_docs.select("source_id"), "source_id", "left_anti")


def require_cvs(manifest: DataFrame, cv_docs: DataFrame) -> None:
    """Strict mode: raise when any delivering source lacks a profile."""
    lacking = missing_cvs(manifest, cv_docs).agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("one")).first()
    if lacking.n:
        raise FileNotFoundError(f"{lacking.n} sources have no CV file, such as {lacking.one}; missing_cvs lists them all")


def _all(rx: str, group: int) -> Column:
    return F.regexp_extract_all("text", F.lit(rx), F.lit(group))


def _list_items(rx: str, separator: str = ", *") -> Column:
    """Items of every matching list line, trimmed, blanks dropped."""
    items = F.flatten(F.transform(_all(rx, 1), lambda line: F.split(line, separator)))
    return F.array_distinct(F.filter(F.transform(items, lambda item: F.trim(item)), lambda item: item != ""))


# SQL text rather than Column calls: these trees are large, and each call is a round trip to the JVM.
def _minutes(hhmm: str) -> str:
    return f"(int(substring({hhmm}, 1, 2)) * 60 + int(substring({hhmm}, 4, 2)))"


def _numeral(text: str) -> str:
    """``40k`` → 40000, ``50,211`` → 50211."""
    return f"bigint(try_cast(regexp_replace({text}, '[,k]', '') AS decimal(18,3)) * if(endswith({text}, 'k'), 1000, 1))"


def _last_named(text: str) -> str:
    """The entity of the column ``entities`` that is named last in ``text``, as a word of its own; the longer of two that end together."""
    word = r"concat(r'(?<![A-Za-z0-9])\Q', replace(e, r'\E', ''), r'\E(?![A-Za-z0-9])')"
    named = f"filter(entities, e -> regexp_like({text}, {word}))"
    end = f"length({text}) - locate(reverse(e), reverse({text}))"
    return f"array_max(transform({named}, e -> struct({end} AS at, length(e) AS n, e AS e))).e"


def _stated(rx: str, *fields: str) -> str:
    """Facts of one form with the ``entity`` they belong to: the last one named before the fact in its line or ``;`` clause.

    NULL stands for the whole source. ``fields`` make struct fields of ``{1}``, ``{2}``, …, the groups of ``rx``.
    """
    groups = [f"get(regexp_extract_all(c, r'(.*?){rx}', {n + 1}), i)" for n in range(1, 4)]
    before = f"regexp_extract_all(c, r'(.*?){rx}', 1)"
    entity = _last_named(f"array_join(slice({before}, 1, i + 1), ' ')")
    made = ", ".join([f"{entity} AS entity", *(f.format(None, *groups) for f in fields)])
    return f"flatten(transform(split(text, r'[;\n]'), c -> transform({before}, (_, i) -> struct({made}))))"


def _ranges() -> Column:
    lo, no_dow, no_hi = _numeral("{1}") + " AS lo", "CAST(NULL AS string) AS dow", "CAST(NULL AS bigint) AS hi"
    hi = _numeral("{2}") + " AS hi"
    weekday = ("'weekday' AS kind", "{1} AS dow", _numeral("{2}") + " AS lo", _numeral("{3}") + " AS hi")
    return F.expr(
        "concat("
        + ", ".join(
            [
                _stated(WEEKDAY_RANGE, *weekday),
                _stated(TYPICAL_RANGE, "'typical' AS kind", no_dow, lo, hi),
                _stated(CONFIDENCE_BAND, "'band' AS kind", no_dow, lo, hi),
                _stated(MINIMUM, "'minimum' AS kind", no_dow, lo, no_hi),
            ]
        )
        + ")"
    )


def schedule_mask(text: str) -> str:
    """The days that a schedule such as ``weekdays`` or ``Mondays, Thursdays`` names, as bits from Monday on; 0 for none."""
    return "(" + " | ".join(rf"if(regexp_like(lower({text}), r'\b{word}s?\b'), {mask}, 0)" for word, mask in SCHEDULE_MASKS.items()) + ")"


def cv_facts(cv_docs: DataFrame) -> DataFrame:
    """Every documented fact, one row per source.

    Dealt out by source: profiles are small to read and slow to match, and Spark would pack them into one task.
    """
    cv_docs = cv_docs.repartition(cv_docs.sparkSession.sparkContext.defaultParallelism, "source_id")
    # a window that ends before it starts begins on the evening before
    start, end = _minutes("{1}"), _minutes("{2}")
    windows = _stated(WINDOW, f"{start} - if({start} > {end}, {MINUTES_PER_DAY}, 0) AS start_min", f"{end} AS end_min")
    mask = schedule_mask(f"regexp_extract(item, r'{FILE_SCHEDULE}', 1)")

    def expected_file(item: Column) -> Column:
        return F.struct(item["name"].alias("expected_name"), expected_pattern(item["name"]).alias("pattern"), item["due_mask"])

    items = F.expr(
        f"transform(items, item -> struct(if({mask} > 0, regexp_replace(item, r'{FILE_SCHEDULE}', ''), item) AS name, nullif({mask}, 0) AS due_mask))"
    )
    cv_docs = cv_docs.select(
        "source_id", "source_name", "text", _list_items(ENTITIES).alias("entities"), _list_items(EXPECTED_FILES, "; *").alias("items")
    )
    return cv_docs.select(
        "source_id",
        "source_name",
        "entities",
        F.transform(items, expected_file).alias("expected_files"),
        F.expr(windows).alias("windows"),
        F.expr(_stated(USUAL_TIME, _minutes("{1}") + " AS minute")).alias("usual_times"),
        _ranges().alias("ranges"),
        _list_items(NOT_EXPECTED).alias("not_expected_on"),
        _list_items(REGULARLY_EMPTY).alias("regularly_empty"),
        _list_items(VARIABLE_ARRIVAL).alias("variable_arrival"),
        F.array_max(F.transform(_all(COVERAGE, 1), lambda n: n.cast("int"))).alias("lag_days"),
    )


def cv_windows(facts: DataFrame) -> DataFrame:
    return facts.select("source_id", F.inline("windows"))


def cv_usual_times(facts: DataFrame) -> DataFrame:
    return facts.select("source_id", F.inline("usual_times"))


def cv_volume_ranges(facts: DataFrame) -> DataFrame:
    return facts.select("source_id", F.inline("ranges"))


def cv_entities(facts: DataFrame) -> DataFrame:
    return facts.select("source_id", F.explode("entities").alias("entity"))


def cv_file_patterns(facts: DataFrame) -> DataFrame:
    return facts.select("source_id", F.inline("expected_files"))


def cv_schedule(facts: DataFrame) -> DataFrame:
    """Weekdays on which nothing is expected: of the whole source (``pattern`` NULL) or of a file with days of its own."""
    whole = facts.select("source_id", F.lit(None).cast("string").alias("pattern"), F.explode("not_expected_on").alias("not_expected_on"))
    files = facts.select("source_id", F.inline("expected_files")).filter(F.col("due_mask").isNotNull())
    days = F.array_compact(F.array(*[F.when(F.col("due_mask").bitwiseAND(1 << i) == 0, day) for i, day in enumerate(WEEKDAYS)]))
    return whole.unionByName(files.select("source_id", "pattern", F.explode(days).alias("not_expected_on")))


def cv_exemptions(facts: DataFrame) -> DataFrame:
    """``kind`` is ``regularly_empty``, ``variable_arrival`` or ``coverage_lag``."""

    def per_entity(column: str) -> Column:
        return F.transform(
            column,
            lambda e: F.struct(
                F.lit(column).alias("kind"), e.alias("entity"), F.lit(None).cast("int").alias("lag_days")
            ),
        )

    lag = F.when(
        F.col("lag_days").isNotNull(),
        F.array(
            F.struct(
                F.lit("coverage_lag").alias("kind"),
                F.lit(None).cast("string").alias("entity"),
                F.col("lag_days").alias("lag_days"),
            )
        ),
    )
    rows = F.flatten(F.array_compact(F.array(per_entity("regularly_empty"), per_entity("variable_arrival"), lag)))
    return facts.select("source_id", F.inline(rows))


def cv_unparsed(cv_docs: DataFrame) -> DataFrame:
    """Lines after the first that no line form recognises, so that silence is visible."""
    lines = F.split("text", "\n")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    unknown = F.filter(body, lambda line: ~F.trim(line).rlike(KNOWN_LINE))
    return cv_docs.select("source_id", F.explode(unknown).alias("line"))
