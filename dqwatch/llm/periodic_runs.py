"""Periodic runs of words, found online by sparse diagonals: a lag stays active while words equal those ``lag`` before.

A word's earlier occurrences are looked up with their context: a block of 1, 2, 4, … words that ends at the word opens or
goes on with the diagonal of a lag up to its length if the nearest earlier place of the same block is just that lag
behind. In a run of period q each block of q to 2q - 1 words recurs at q and not before, so every run of three periods
or more is found, and at most one diagonal per block length is open at any word. Blocks are named by sorting pairs of
names, exactly, so a text of n words costs n log n at any number of equal words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqwatch.llm.common import map_columns, read

#: Words of the texts that are searched side by side; longer texts are searched alone.
WORDS_AT_ONCE = 200_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"
WORD = r"[^\x20\x09-\x0D]+"


def earlier_occurrences(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, lag, block) by word: the block of words that ends at ``word`` was last seen ``lag`` words before.

    Only lags over half a block up to a whole one are told, each by the one block length it belongs to; ``longest`` is
    the greatest lag of interest.
    """
    n, block = len(ids), 1
    starts, keys = np.arange(n), ids
    found: list[tuple[np.ndarray, ...]] = []
    while len(starts) and block < 2 * longest:
        order = np.argsort(keys, kind="stable")
        place, named = starts[order], keys[order]
        same = named[1:] == named[:-1]
        lag = place[1:] - place[:-1]
        fit = same & (lag <= block) & (2 * lag > block)
        found.append((place[1:][fit] + block - 1, lag[fit], np.full(int(fit.sum()), block)))
        # only blocks that recur can be part of longer ones that do
        recurs = np.append(False, same) | np.append(same, False)
        names = np.full(n + block, -1)
        names[place[recurs]] = np.cumsum(np.append(True, ~same))[recurs]
        starts = np.flatnonzero((names[:n] >= 0) & (names[block:] >= 0))
        keys = names[starts] * (n + 1) + names[starts + block]
        block *= 2
    word, lag, size = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found or [((),) * 3]))
    order = np.lexsort((lag, word))
    return word[order].astype(np.int64), lag[order].astype(np.int64), size[order].astype(np.int64)


def runs_online(ids: np.ndarray, longest: int, min_length: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of every run, each emitted at the word where its diagonal ends."""
    active: dict[int, tuple[int, int]] = {}  # lag: last word, words matched

    def ended(before: int) -> Iterator[tuple[int, int, int]]:
        for lag in [k for k, (last, _) in active.items() if last < before]:
            last, matched = active.pop(lag)
            if matched + lag >= max(min_length, exponent * lag):
                yield last - matched - lag + 1, matched + lag, lag

    at = -1
    for word, lag, block in zip(*(x.tolist() for x in earlier_occurrences(ids, longest)), strict=True):
        if word != at:
            yield from ended(word - 1)
            at = word
        active[lag] = (word, active[lag][1] + 1 if lag in active else block)
    yield from ended(len(ids))


def find_runs(texts: list[list[bytes]], min_length: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, a list of words, by start and then by period."""
    if exponent < 3:
        raise ValueError("runs under three periods are not told by their blocks")
    bases, ids = [], []
    for words in texts:
        bases.append(len(ids))
        first: dict[bytes, int] = {}
        ids.extend(map(first.setdefault, words, count(len(ids))))  # a word's name is its first place, so texts share none
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    longest = max(map(len, texts), default=0) // exponent
    for start, length, period in runs_online(np.array(ids, np.int64), longest, min_length, exponent):
        text = bisect_right(bases, start) - 1
        out[text].append((start - bases[text], length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, keep, strict=True) if k])


def _in_groups(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    group: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = (text or b"").split()  # bytes split at space and \x09 to \x0d only
        if group and size + len(words) > WORDS_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def periodic_runs(docs: DataFrame, min_length: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of (doc_id, text); other columns are neither read nor returned.

    A run has at least ``min_length`` words and ``exponent`` periods. A null text is empty; empty texts have no runs and an
    empty ``collapsed``. Null and repeated ids are rows like any other, and an empty table gives an empty one.
    """

    def search(ids: list, texts: list) -> tuple[list, ...]:
        sizes, spans, collapsed = [], [], []
        for group in _in_groups(texts):
            for words, runs in zip(group, find_runs(group, min_length, exponent), strict=True):
                sizes.append(len(words))
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                collapsed.append(without_repeats(words, runs))
        return ids, sizes, spans, collapsed

    schema = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
    return map_columns(docs.select("doc_id", F.col("text").cast("binary")), schema, search)


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest exact length / period, the first of equals; NULL where there is none."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.reduce(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | more(best, r), r).otherwise(best))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth text, by its id's CRC, goes over into repetitions of some of its words.

    With h the CRC of the decimal id and g = h div 10, a text of n words with h % 10 = 0 keeps its words before a = g % n and
    then repeats those from a on with period 1 + (n - a) div (3 + g % 8), up to n words. A null id changes nothing.
    """
    h, words = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.col("words")
    tenth = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    )
    g, n = F.floor(F.col("h") / 10), F.size("words")
    sized = tenth.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.pmod(g, "n")).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    # at most ten periods fit
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, F.col("a") + 1, period), 10)), F.lit(1), F.col("n") - F.col("a"))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a")), tail), " ")
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, as digests."""
    found = periodic_runs(with_repeated_tails(read(spark, sf_dir, "documents", "doc_id", "text")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    best = F.col("best")
    return found.withColumn("best", strongest()).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
