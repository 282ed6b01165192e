"""Benchmark decontamination by template: questions are found again with other numbers, names or units.

Texts become templates: a number turns into one placeholder, a capitalised word (a name, or what starts a sentence)
into another, a unit behind a number into a third; punctuation goes. Windows of template words are hashed and joined
with the windows of all benchmark items. Windows whose names stay as lower-case words are joined beside them, so a copy
is found in any letter case.

Windows at one alignment of item and document count in stretches of ``hits`` in order: a stretch counts if in it each
value of the item always maps to one value of the document (slot consistency); else the slots are filled at random
and the resemblance is a matter of form. A value that is changed at one place only does not discredit the stretches
without it.

A document is contaminated by an item if ``hits`` windows of it (all, if it has fewer) form such a stretch:
6 windows of 8 words, that is 13 words in a row. Items below 8 words are one window of their own length; below 5
literal words they can't be told from ordinary prose and are ignored. Windows with fewer than 5 literal words are
ignored for the same reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqwatch.llm.common import SPACES, read

NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
#: Units of measure, money and time.
UNITS = (
    "mm|cm|dm|m|km|inch|inches|feet|foot|ft|yards?|miles?|mg|g|kg|tons?|tonnes?|pounds?|lbs?|ounces?|oz|ml|cl|l|"
    "lit(?:er|re)s?|gallons?|seconds?|secs?|minutes?|mins?|hours?|hrs?|h|days?|weeks?|months?|years?|"
    "dollars?|cents?|euros?|usd|eur|percent|degrees?|celsius|fahrenheit|kmh|mph|watts?|kw|volts?|hz|kb|mb|gb"
)
WINDOW = 8
MIN_LITERALS = 5
HITS = 6
#: Words by which a window shorter than ``WINDOW`` is looked up before it is compared whole.
ANCHOR = 4
#: Places of a text in one row, where windows start; the words that the last of them need follow.
PIECE = 256
#: Windows of the benchmark that are sent to every executor; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 500_000


def template_words(text: Column) -> Column:
    """Words of the template, with marks for what is a placeholder and the words still there: before names, behind numbers and units."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "[\x01-\x03]", "")
    named = F.regexp_replace(clean, r"(?<![^\x20\x09-\x0D])(?=\p{Lu})", NAME)
    numbered = F.regexp_replace(F.lower(named), r"\p{Nd}+(?:[.,:/]\p{Nd}+)*", f"$0{NUMBER}")
    measured = F.regexp_replace(numbered, rf"(?<=\x01[\x20\x09-\x0D]?)\x02?({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}")
    words = F.regexp_replace(measured, r"[^\p{L}\p{N}\x01-\x03\x20\x09-\x0D]+", "")
    return F.split(F.btrim(F.regexp_replace(words, SPACES, " ")), " ")


def _bare(words: Column) -> Column:
    """A word, or words joined by spaces, with the marks of numbers and units only."""
    return F.regexp_replace(F.regexp_replace(words, rf"\p{{Nd}}+{NUMBER}", NUMBER), f"[^ {NUMBER}]*{UNIT}", UNIT)


def _plain(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, NUMBER + NAME + UNIT, ""))


def _form(words: Column, kind: int) -> Column:
    """Kind 0: a name is its placeholder; kind 1: it is the word itself. Words are joined by spaces."""
    text = F.array_join(words, " ")
    return _bare(F.translate(text, NAME, "") if kind else F.regexp_replace(text, f"{NAME}[^ ]+", NAME))


def _forms(words: Column) -> Column:
    """Both forms, the second only where a name makes it another."""
    return F.array_distinct(F.array(_form(words, 0), _form(words, 1)))


def _pieces(df: DataFrame, length: int) -> DataFrame:
    """``df`` with a row (``at``, ``words``) per ``PIECE`` places of ``words``: a window that starts at one of them is in its row.

    What is made per window then holds the words of a piece, whatever the length of the text.
    """
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(PIECE))
    cut = F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice("words", at + 1, PIECE + length - 1).alias("words")))
    return df.select(*[c for c in df.columns if c != "words"], F.inline(cut))


def _hashes(df: DataFrame, length: int, anchors: bool, kept: list[str]) -> DataFrame:
    """One row (kept, words, pos, kind, short, window) per window of ``words``; kind 1 only where a name makes it another.

    ``anchors`` adds the windows of ``ANCHOR`` words (``short``), where shorter windows start. Hashes grow by doubling,
    the last step overlaps. Selects apart keep each step computed once.
    """

    def whole(w: Column) -> Column:
        word = F.translate(w, NAME, "")
        return F.when(w.contains(NUMBER) | w.contains(UNIT), F.xxhash64(_bare(word))).otherwise(F.xxhash64(word))

    hashes = {"named": lambda w: F.when(w.startswith(NAME), F.xxhash64(F.lit(NAME))).otherwise(whole(w)), "whole": whole}
    df = df.select(*kept, "words", *[F.transform("words", fn).alias(name) for name, fn in hashes.items()])

    def grown(array: str, shift: int) -> Column:
        later = F.slice(array, shift + 1, F.greatest(F.size(array) - shift, F.lit(0)))
        return F.zip_with(F.slice(array, 1, F.size(later)), later, lambda a, b: F.xxhash64(a, b))

    parts, size = [("named", "whole")], 1
    while size < length:
        shift = min(size, length - size)
        df = df.withColumns({name: grown(name, shift) for name in hashes})
        size += shift
        if size == ANCHOR and anchors:
            parts.append(("named_anchor", "whole_anchor"))
            df = df.withColumns({f"{name}_anchor": F.col(name) for name in hashes})
    counts = [F.size(named).alias(f"n{i}") for i, (named, _) in enumerate(parts)]
    other = [F.zip_with(whole, named, lambda w, n: F.when(w != n, w)) for named, whole in parts]
    both = F.concat(*[column for (named, _), whole in zip(parts, other, strict=True) for column in (F.col(named), whole)])
    df = df.select(*kept, "words", *counts, both.alias("hashes"))
    # no lambda here or up to the join: outside generated code every window would copy its text
    # outer: an inner explode would make Spark evaluate the hashes a second time in a filter below it
    rows = df.select(*kept, "words", *[f"n{i}" for i in range(len(parts))], F.posexplode_outer("hashes").alias("place", "window"))
    rows = rows.filter(F.col("window").isNotNull())
    short = F.col("place") >= 2 * F.col("n0")
    n, place = F.col("n0"), F.col("place")
    if anchors:
        n, place = F.when(short, F.col("n1")).otherwise(n), F.when(short, place - 2 * F.col("n0")).otherwise(place)
    kind = F.when(place >= n, 1).otherwise(0)
    return rows.select(*kept, "words", F.when(place >= n, place - n).otherwise(place).alias("pos"), kind.alias("kind"), short.alias("short"), "window")


def _item_windows(items: DataFrame, length: int) -> DataFrame:
    """One row per usable window of an item: its form as text and as words, and their plain values."""
    size = F.least(F.lit(length), F.size("words"))
    pieces = _pieces(items.filter(size >= MIN_LITERALS).select("item_id", size.alias("size"), "words"), length)
    places = pieces.filter(F.size("words") >= F.col("size")).select(
        "*", F.explode(F.sequence(F.lit(0), F.least(F.size("words") - F.col("size"), F.lit(PIECE - 1)))).alias("place")
    )
    here = F.slice("words", F.col("place") + 1, F.col("size"))
    cut = places.select(
        "item_id",
        (F.col("at") + F.col("place")).alias("item_pos"),
        "size",
        _plain(here).alias("item_plain"),
        F.posexplode(_forms(here)).alias("item_kind", "form"),
    ).withColumn("item_words", F.split("form", " "))
    literal = F.size(F.filter("item_words", lambda w: ~F.translate(w, NUMBER + NAME + UNIT, "").eqNullSafe("")))
    return cut.filter(literal >= MIN_LITERALS)


def _wanted(items: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """(window, size): hashes to look for in documents, and how many words from there on may be an item's window."""
    used = windows.select(F.col("item_id").alias("id"), F.col("item_pos").alias("at"), F.col("item_kind").alias("form_kind"), "size")
    rows = _hashes(items.select("item_id", "words"), length, True, ["item_id"]).drop("words")
    # a name behind the anchor makes two forms of one anchor
    whole = ~F.col("short") & (F.col("size") == length) & (F.col("kind") == F.col("form_kind"))
    same = F.col("item_id").eqNullSafe(F.col("id")) & (F.col("pos") == F.col("at")) & (whole | (F.col("short") & (F.col("size") < length)))
    return rows.join(used, same).select("window", "size").distinct()


def _places(docs: DataFrame, wanted: DataFrame, length: int, anchors: bool, broadcast: bool) -> DataFrame:
    """(doc_id, text_hash, at, words, pos, size) where a document may hold an item's window: ``pos`` in the words of its piece.

    Beyond the broadcast only keys, places and hashes of all windows are shuffled; words follow once per piece with a match.
    """
    key = ["doc_id", "text_hash", "at"]

    def pieces(texts: DataFrame) -> DataFrame:
        return _pieces(texts.select("doc_id", F.xxhash64("text").alias("text_hash"), template_words(F.col("text")).alias("words")), length)

    # anchors beyond the places of a piece are the next one's
    stream = _hashes(pieces(docs), length, anchors, key).filter(F.col("pos") < PIECE)
    if broadcast:
        return stream.join(F.broadcast(wanted), "window").select(*key, "words", "pos", "size")
    places = (
        stream.select(*key, "pos", "window")
        .join(wanted, "window")
        .groupBy(*key)
        .agg(F.collect_set(F.struct("pos", "size")).alias("places"))  # at most the windows of one piece
        .withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash", "at": "found_at"})
    )

    def same(texts: DataFrame) -> Column:
        return texts["doc_id"].eqNullSafe(places["found_id"]) & (texts["text_hash"] == places["found_hash"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    matched = pieces(texts.join(places, same(texts), "left_semi"))
    return matched.join(places, same(matched) & (matched["at"] == places["found_at"])).select(*key, "words", F.inline("places"))


def contaminated(
    docs: DataFrame, items: DataFrame, length: int = WINDOW, hits: int = HITS
) -> DataFrame:
    """Pairs (doc_id, text_hash, item_id) with ``windows`` found at the best alignment, ``item_windows`` and ``reparameterised``.

    ``docs``: doc_id, text; ``items``: item_id, text. Null and empty texts have no windows. Repeated rows (same
    doc_id and text) give one row; rows with the same doc_id and another text one of their own; a null doc_id stays
    null, as does a null item_id; items of one id count as one. Equal windows within or across items all count for their
    item. Empty tables give no rows. Of alignments with equally many windows an unchanged one decides ``reparameterised``.
    """
    items = items.select("item_id", template_words(F.col("text")).alias("words"))
    windows = _item_windows(items, length)
    counts = windows.groupBy(F.col("item_id").alias("id")).agg(F.countDistinct("item_pos").alias("item_windows"))
    n, shortest = windows.agg(F.count(F.lit(1)), F.min("size")).first()
    broadcast, anchors = n <= BROADCAST_WINDOWS, n > 0 and shortest < length
    places = _places(docs, _wanted(items, windows, length), length, anchors, broadcast)
    windows = windows.join(counts, F.col("item_id").eqNullSafe(F.col("id"))).drop("id", "size")
    here = F.slice("words", F.col("pos") + 1, F.col("size"))
    place = F.col("at") + F.col("pos")
    formed = places.select("doc_id", "text_hash", place.alias("pos"), _plain(here).alias("plain"), F.explode(_forms(here)).alias("form"))
    found = formed.join(F.broadcast(windows) if broadcast else windows, "form").select(
        "doc_id",
        "text_hash",
        "item_id",
        "item_pos",
        "item_kind",
        "item_windows",
        (F.col("pos") - F.col("item_pos")).alias("alignment"),
        F.arrays_zip(
            F.col("item_words").alias("mark"),
            F.col("item_plain").alias("was"),
            F.col("plain").alias("is"),
        ).alias("slots"),
    )
    slots = F.filter("slots", lambda s: F.translate(s["mark"], NUMBER + NAME + UNIT, "") != s["mark"])
    pairs = F.transform(slots, lambda s: F.struct(s["was"].alias("was"), s["is"].alias("is")))
    key = ["doc_id", "text_hash", "item_id", "item_windows"]
    # at one alignment an item's positions meet the document once, so a group has at most its windows
    aligned = (
        found.select(*key, "alignment", F.struct("item_pos", "item_kind", pairs.alias("pairs")).alias("step"))
        .groupBy(*key, "alignment")
        .agg(F.array_sort(F.collect_set("step")).alias("steps"))
        .withColumn("steps", _let(F.col("steps"), _one_each))
        .withColumn("steps", _let(F.col("steps"), lambda steps: _covered(steps, F.least(F.lit(hits), F.col("item_windows")).cast("int"))))
        .select(
            *key,
            F.size("steps").cast("long").alias("windows"),
            F.exists("steps", lambda s: F.exists(s["pairs"], lambda p: p["was"] != p["is"])).alias("changed"),
        )
        .filter(F.col("windows") > 0)
    )
    best = aligned.groupBy(*key).agg(F.max(F.struct("windows", (~F.col("changed")).alias("same"))).alias("best"))
    return best.select(*key, F.col("best.windows").alias("windows"), (~F.col("best.same")).alias("reparameterised"))


def _consistent(steps: Column, need: Column) -> Column:
    """Whether ``need`` windows follow, and none of their values of the item maps to two of the document."""
    pairs = F.array_distinct(F.flatten(F.transform(steps, lambda s: s["pairs"])))
    return (F.size(steps) == need) & (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["was"]))))


def _covered(steps: Column, need: Column) -> Column:
    """The windows in consistent stretches of ``need``; such a stretch starts at most ``need - 1`` windows before."""

    def inside(starts: Column, i: Column) -> Column:
        first = F.greatest(i - need + 1, F.lit(0))
        return F.exists(F.slice(starts, first + 1, i - first + 1), lambda ok: ok)

    starts = F.transform(steps, lambda s, i: _consistent(F.slice(steps, i + 1, need), need))
    return _let(starts, lambda known: F.filter(steps, lambda s, i: inside(known, i)))


def _one_each(steps: Column) -> Column:
    """One window per position, with names as placeholders where both kinds match."""
    return F.filter(steps, lambda s, i: (i == 0) | (s["item_pos"] != F.get(steps, i - 1)["item_pos"]))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value computed once; a column inside a lambda may be computed for every element."""
    return F.get(F.transform(F.array(value), fn), 0)


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay."""
    bad = contaminated(docs.select("doc_id", "text"), items).select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")
    ).distinct()
    same = docs["doc_id"].eqNullSafe(bad["__doc"]) & (F.xxhash64(docs["text"]) == bad["__hash"])
    return docs.join(bad, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated (doc_id, item_id) pairs of ``documents`` against the whole ``benchmark``."""
    found = contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "windows", "item_windows", "reparameterised")
