"""Fill-in-the-middle texts, cut at token counts that come from memorised chunks.

A rolling hash over the bytes cuts a text into chunks, so equal passages give equal chunks wherever they stand. A cache
maps a chunk's content to its summary: tokens, code points, and whether it begins and ends inside a word. Looking a chunk
up compares its whole content. A text's counts are its chunks' counts, less one token where a word runs over a border; a
cut is located by those counts and then inside one chunk.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqwatch.llm.common import map_columns, read

WINDOW, CHUNK_BITS, LONGEST_CHUNK = 32, 10, 8192
#: Content that the cache of one task holds at most, and the bytes hashed at a time.
CACHE_BYTES, BYTES_AT_ONCE = 32 << 20, 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

_MIX = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)
_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= ord("a")) & ((_BYTES | 32) <= ord("z"))
_INSIDE = (_BYTES & 0xC0) == 0x80  # bytes of a code point behind its first
_SHAPE = bytes(np.where(_LETTER, ord("a"), ord(" ")).tolist())
_INSIDE_BYTES = bytes(np.flatnonzero(_INSIDE).tolist())


def chunk_borders(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places inside the texts that start at ``starts`` where a chunk ends, by the hash of the ``WINDOW`` bytes before."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    h, span = _MIX[data], 1
    while span < WINDOW:  # the hash of twice as many bytes from two hashes
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    ends = np.flatnonzero(h[:-1] >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    ends = ends[~_INSIDE[data[ends]]]
    own = starts[np.searchsorted(starts, ends, "right") - 1]
    return ends[ends - own >= WINDOW]


class Summary(NamedTuple):
    tokens: int
    chars: int
    begins: bool  # with a letter
    ends: bool


def summary_of(chunk: bytes) -> Summary:
    shape = chunk.translate(_SHAPE, _INSIDE_BYTES)  # one byte a code point
    words = shape.count(b" a") + shape.startswith(b"a")
    return Summary(shape.count(b" ") + words, len(shape), shape.startswith(b"a"), shape.endswith(b"a"))


class ChunkCache:
    """Summaries by content. Two generations bound it: what was not asked for since the last change goes."""

    def __init__(self, capacity: int = CACHE_BYTES):
        self._half = capacity // 2
        self._young: dict[bytes, Summary] = {}
        self._old: dict[bytes, Summary] = {}
        self._bytes = 0

    def summary(self, chunk: bytes) -> Summary:
        known = self._young.get(chunk)
        if known is None:
            known = self._old.get(chunk) or summary_of(chunk)
            if self._bytes + len(chunk) > self._half:
                self._old, self._young, self._bytes = self._young, {}, 0
            self._young[chunk] = known
            self._bytes += len(chunk)
        return known


def _chunks(text: bytes, borders: list[int]) -> list[bytes]:
    """The text cut at ``borders``, and within stretches that are too long."""
    out, start = [], 0
    for end in [*borders, len(text)]:
        while end - start > LONGEST_CHUNK:
            cut = start + LONGEST_CHUNK
            while cut > start + 1 and text[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(text[start:cut])
            start = cut
        if end > start:
            out.append(text[start:end])
        start = end
    return out


class CountedText:
    """A text's token count, and the place before any of its tokens, from the summaries of its chunks."""

    def __init__(self, text: bytes, borders: list[int], cache: ChunkCache):
        self._chunks = _chunks(text, borders)
        parts = [cache.summary(c) for c in self._chunks]
        # the word that a chunk goes on with was counted where it began
        self._goes_on = [i > 0 and p.begins and parts[i - 1].ends for i, p in enumerate(parts)]
        self._first = [0, *accumulate(p.tokens - g for p, g in zip(parts, self._goes_on, strict=True))]
        self._chars = [0, *accumulate(p.chars for p in parts)]
        self._bytes = [0, *accumulate(map(len, self._chunks))]
        self.n = self._first[-1]

    def before(self, token: int) -> tuple[int, int]:
        """Bytes and code points before the token of this number; ``n`` asks for the end."""
        if token >= self.n:
            return self._bytes[-1], self._chars[-1]
        i = bisect_right(self._first, token) - 1
        data = np.frombuffer(self._chunks[i], np.uint8)
        letter, lead = _LETTER[data], ~_INSIDE[data]
        begins = lead & ~(letter & np.append(False, letter[:-1]))
        at = int(np.flatnonzero(begins)[token - self._first[i] + self._goes_on[i]])
        return self._bytes[i] + at, self._chars[i] + int(lead[:at].sum())


def count_texts(texts: list[bytes], cache: ChunkCache) -> list[CountedText]:
    """Texts counted chunk by chunk; texts of up to ``BYTES_AT_ONCE`` together are hashed in one go."""
    out: list[CountedText] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BYTES_AT_ONCE):
            size += len(texts[j])
            j += 1
        group = texts[i:j]
        starts = np.array([0, *accumulate(map(len, group))], np.int64)
        borders = chunk_borders(np.frombuffer(b"".join(group), np.uint8), starts)
        cuts = np.searchsorted(borders, starts)
        for k, text in enumerate(group):
            out.append(CountedText(text, (borders[cuts[k] : cuts[k + 1]] - starts[k]).tolist(), cache))
        i = j
    return out


def seeds(key: Column, epoch: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``epoch:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, epoch: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of (doc_id, text).

    Tokens are runs of A-Z and a-z and single other code points; ``n`` counts them. Two hashed cuts make prefix, middle and
    suffix. ``form`` is ``plain`` (the text itself, its sizes null) for empty texts, texts that hold a mark and a hashed
    share from ``plain_from`` percent on; else ``spm`` for a share below ``spm_below`` percent, or ``psm``. A null text is
    empty. Null and repeated ids are rows like any other, equal rows give equal outputs; other columns are neither read
    nor returned, and an empty table gives an empty one.
    """
    cache = ChunkCache()

    def transform(ids: list, texts: list, h1: list, h2: list, h3: list, h4: list) -> tuple[list, ...]:
        texts = [t or b"" for t in texts]
        out: tuple[list, ...] = (ids, [], [], [], [], [])
        for i, (text, counted) in enumerate(zip(texts, count_texts(texts, cache), strict=True)):
            row: tuple = (counted.n, "plain", None, None, text)
            if text and h3[i] % 100 < plain_from and not any(m in text for m in MARKS):
                first, second = sorted((h1[i] % (counted.n + 1), h2[i] % (counted.n + 1)))
                (a, before), (b, until) = counted.before(first), counted.before(second)
                prefix, middle, suffix = MARKS[0] + text[:a], MARKS[2] + text[a:b], MARKS[1] + text[b:]
                spm = h4[i] % 100 < spm_below
                joined = suffix + prefix + middle if spm else prefix + suffix + middle
                row = (counted.n, "spm" if spm else "psm", before, until - before, joined)
            for column, value in zip(out[1:], row, strict=True):
                column.append(value)
        return out

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    given = docs.select("doc_id", F.col("text").cast("binary"), *seeds(F.col("doc_id"), epoch))
    return map_columns(given, schema, transform)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of; no mark stands in it, so the first of each is the one put there."""
    second = F.when(form == "psm", F.locate(SUFFIX, output, 4)).otherwise(F.locate(PREFIX, output, 4))
    third = F.locate(MIDDLE, output, 4)
    one, two = F.substr(output, F.lit(4), second - 4), F.substr(output, second + 3, third - second - 3)
    middle = F.substr(output, third + 3)
    made = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return F.when(form == "plain", output).otherwise(made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` in its fill-in form, as digests."""
    made = fill_in_middle(read(spark, sf_dir, "documents", "doc_id", "text"))
    text = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(text.cast("binary"), 256).alias("restored_sha256"),
    )
