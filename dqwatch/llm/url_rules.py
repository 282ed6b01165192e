"""URL rules by a sorted sweep: reversed hosts turn host suffixes into prefixes, and prefixes into nested intervals.

A host is written backwards with a final dot (``ten.elpmaxe.``), so a rule's host and all its subdomains are the keys that
start with the rule's: one interval of the sorted keys. Rows and rules are dealt out by ranges of keys; a rule goes to every
range that its interval meets. Each range is sorted and swept once, with a stack of the rules whose intervals hold the
current key. Under one host the path prefixes are nested intervals again, found by binary search and their chain of
enclosing prefixes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqwatch.llm.common import map_columns, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys are cut to this length for the ranges only; equal beginnings go to the same ranges.
RANGE_KEY_CHARS = 256
SAMPLES_PER_RANGE = 20
RULES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no host part."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.reverse(host), F.lit("."))


def range_borders(keyed: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """At most ``ranges - 1`` borders (key, mix) that cut the rows into ranges of about equal size.

    They come from the rows of lowest hash, ``SAMPLES_PER_RANGE`` a range: a bound that does not grow with the table, and
    the same rows at every run. Borders decide where a row is judged, never how. A host that holds many rows is cut
    within, by the row's hash ``mix``.
    """
    sample = keyed.select(F.substring("key", 1, RANGE_KEY_CHARS).alias("key"), "mix", F.xxhash64("mix", F.lit(1)).alias("draw"))
    drawn = sample.orderBy("draw", "key").limit(SAMPLES_PER_RANGE * ranges).select("key", "mix").toPandas()
    drawn = sorted(zip(drawn["key"], drawn["mix"].tolist(), strict=True))
    return [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if len(drawn) >= ranges else []


class HostRules:
    """The rules of one host; its path prefixes come in ascending order."""

    def __init__(self, key: str):
        self.key = key
        self.paths: list[str] = []
        self._verdicts: list[str] = []
        self._around: list[int] = []  # the next longer-reaching prefix that encloses each one
        self._open: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            if verdict == "block":
                self._verdicts[-1] = verdict
            return
        while self._open and not path.startswith(self.paths[self._open[-1]]):
            self._open.pop()
        self._around.append(self._open[-1] if self._open else -1)
        self._open.append(len(self.paths))
        self.paths.append(path)
        self._verdicts.append(verdict)

    def longest(self, path: str) -> tuple[str, str] | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self._around[i]
        return (self.paths[i], self._verdicts[i]) if i >= 0 else None


class Sweep:
    """The stack of hosts with rules around the current key; keys come in ascending order within a range."""

    def __init__(self) -> None:
        self._range: int | None = None
        self._stack: list[HostRules] = []

    def move(self, within: int, key: str) -> None:
        if within != self._range:
            self._range = within
            self._stack.clear()
        while self._stack and not key.startswith(self._stack[-1].key):
            self._stack.pop()

    def add(self, key: str, path: str, verdict: str) -> None:
        if not self._stack or self._stack[-1].key != key:
            self._stack.append(HostRules(key))
        self._stack[-1].add(path, verdict)

    def judge(self, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule around the current key; of equally long ones the longer host's."""
        best = None
        for rules in reversed(self._stack):
            hit = rules.longest(path)
            if hit and (best is None or len(rules.key) - 1 + len(hit[0]) > len(best[0])):
                best = (rules.key[-2::-1] + hit[0], hit[1])
        return best


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of (page_id, url) under ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains where the path starts with its own; the longest (host and path together)
    decides, of equal ones ``block``, and ``default`` where none fits (``rule`` is null then). Rule hosts are lower-cased;
    rules with a null are left out. Null URLs and URLs without ``://`` have an empty host and path and fit no rule. Null and
    repeated ids are rows like any other, other columns are neither read nor returned, and an empty table gives an empty one.
    """
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    url = F.col("url")
    urls = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64("page_id", "url").alias("mix"))
    keyed = urls.select("page_id", host_key(F.col("host")).alias("key"), "path", "mix")
    borders = range_borders(keyed, ranges)

    def place(key: str, mix: float) -> int:
        return bisect_right(borders, (key[:RANGE_KEY_CHARS], mix))

    def place_urls(ids: list, keys: list, paths: list, mixes: list) -> tuple[list, ...]:
        n = len(ids)
        return [place(k, m) for k, m in zip(keys, mixes, strict=True)], keys, [1] * n, paths, [None] * n, ids

    def met(key: str) -> list[int]:
        # "/" follows "." at once, so the keys under a host end there
        return list(range(place(key, float("-inf")), place(key[:-1] + "/", float("inf")) + 1))

    placed = map_columns(
        keyed, "within int, key string, kind int, path string, verdict string, page_id long", place_urls
    )
    given = rules.dropna(subset=["host", "path", "verdict"]).select(
        host_key(F.translate("host", UPPER, LOWER)).alias("key"), "path", "verdict"
    )
    everywhere = map_columns(
        given, "key string, path string, verdict string, places array<int>", lambda k, p, v: (k, p, v, [met(x) for x in k])
    ).select(F.explode("places").alias("within"), "key", F.lit(0).alias("kind"), "path", "verdict", F.lit(None).cast("long").alias("page_id"))
    events = placed.unionByName(everywhere).repartitionById(ranges, F.col("within"))
    ordered = events.sortWithinPartitions("within", "key", "kind", "path", "verdict")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for within, key, kind, path, verdict, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sweep.move(within, key)
                if kind == 0:
                    sweep.add(key, path, verdict)
                    continue
                rule, decided = sweep.judge(path) or (None, default)
                for column, value in zip(out, (page, key[-2::-1], path, rule, decided), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "path", "rule", "verdict"])

    return ordered.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


#: The rules of the registered query.
GIVEN = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE = f"""
WITH given(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, GIVEN))}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
judged AS (
  SELECT page_id, host, path,
         (SELECT struct_pack(rule := rule_host || rule_path, verdict := verdict) FROM given
          WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
          ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS hit
  FROM parts
)
SELECT page_id, host, path, hit.rule AS rule, COALESCE(hit.verdict, 'allow') AS verdict FROM judged
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every row of ``pages``."""
    return judge_urls(read(spark, sf_dir, "pages", "page_id", "url"), spark.createDataFrame(GIVEN, RULES))
