"""Scoring by a class-based bigram model (Brown et al.) with exchange clustering.

P(word | word before) = P(class | class before) * P(word | class). Classes are those of the exchange algorithm: a
word moves to the class where the likelihood of the training bigrams grows most. Sweeps are distributed (all words
of one half are judged against the same counts, the halves in turn), since a class bigram table is all that a word
needs besides its own counts.

Every word of the training texts is clustered by its own bigrams, in two steps. First the near words, those with a
share of at least ``KNOWN_SHARE`` of the training tokens, of which there are at most 1 / ``KNOWN_SHARE`` by arithmetic:
every task knows them and their counts. All others, the far words, meanwhile stand in for each other by their last two
bytes. Then each far word leaves that company and is judged on its own, against the classes of all its neighbours, near
and far. Far words and their classes are a table, which is joined and never sent to the driver or to a task as a whole.
A word that no training text holds has the class of most training words with its last two bytes.

Smoothing: half a count for each word of a class and for one unseen word; half a count for each class transition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqwatch.llm.common import give_back, read, written

CLASSES = 64
#: Half sweeps over the near words, and over the far ones.
SWEEPS, FAR_SWEEPS = 6, 2
KNOWN_SHARE = 2e-6
#: Tokens of a chunk, and rows that are cut into words at once.
CHUNK, ROWS = 1 << 20, 2000
#: Stands for a far word where a byte is a class.
FAR = 255
#: The end of a text as a word: no word holds a line feed.
END = "\n"


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased (on bytes, both know ASCII only). Null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text modulo 5 is 1; a null id counts as empty text and is trained on."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def listed(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The elements of all lists, and for each the number of its list."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def joined_bytes(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each value starts, with the end of the last."""
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data or b"", dtype=np.uint8)
    return values[starts[0] : starts[-1]], starts - starts[0]


def packed(values: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """A row for each start with the bytes of its numbers; ``starts`` has the end of the last too."""
    offsets = (np.asarray(starts) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of ``packed``, and for each the number of its row."""
    data, starts = joined_bytes(column)
    return np.repeat(np.arange(len(column)), np.diff(starts) // np.dtype(kind).itemsize), data.view(kind)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``words_of`` of all texts, one after the other, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    doc, words = listed(lists)
    kept = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    return np.bincount(doc[kept], minlength=len(texts)), words.filter(pa.array(kept))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each word its place among the different ones, and these."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def pieces(batches: Iterator[pa.RecordBatch], training: bool) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows of (doc_id, text), or of the training rows among them."""
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        if training:
            batch = batch.filter(pa.array([not is_held_out(d) for d in batch.column(0).to_pylist()], type=pa.bool_()))
        yield batch


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the training rows of (doc_id, text); each text adds one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts = [split_words(b.column(1))[1].dictionary_encode() for b in pieces(iter([whole]), training=True)]
            words = pa.chunked_array(parts, type=pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
            names = words.chunk(0).dictionary if words.num_chunks else pa.array([], type=pa.string())
            counts = np.zeros(len(names), dtype=np.int64)
            for part in words.chunks:
                counts += np.bincount(part.indices.to_numpy(zero_copy_only=False), minlength=len(names))
            ends = sum(not is_held_out(d) for d in whole.column(0).to_pylist())
            names, counts = pa.concat_arrays([names, pa.array([END])]), np.append(counts, ends)
            yield pa.RecordBatch.from_arrays([names, pa.array(counts)], names=["word", "n"]).filter(pa.array(counts > 0))
        give_back()

    partial = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: bytes) -> int:
    """The last two bytes as a number."""
    return word[-1] | (word[-2] << 8 if len(word) > 1 else 0)


@dataclass
class Lexicon:
    """The near words, their counts, and all units: each near word, and the last two bytes of the others."""

    counts: np.ndarray
    units: dict[bytes, int]
    tokens: int
    distinct: int

    def unit(self, word: bytes) -> int:
        """A near word's own unit, else that of its last two bytes."""
        own = self.units.get(word)
        return own if own is not None else len(self.units) + ending(word)

    @property
    def n_units(self) -> int:
        return len(self.units) + (1 << 16)

    @cached_property
    def _near(self) -> pa.Array:
        return pa.array(list(self.units), type=pa.binary())

    def places(self, words: pa.Array) -> np.ndarray:
        """The units of near words, -1 for the others."""
        found = pc.index_in(words.cast(pa.binary()), self._near)
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def units_of(self, words: pa.Array) -> np.ndarray:
        """``unit`` of each word, none of which is empty."""
        places = self.places(words)
        return np.where(places < 0, len(self.units) + endings(words), places)


def endings(words: pa.Array) -> np.ndarray:
    """``ending`` of each word."""
    data, starts = joined_bytes(words.cast(pa.binary()))
    last, several = starts[1:] - 1, np.diff(starts) > 1
    return data[last].astype(np.int64) | np.where(several, data[last - several].astype(np.int64) << 8, 0)


def lexicon_of(counts: DataFrame) -> Lexicon:
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # at most 1 / KNOWN_SHARE words have such a share, whatever the corpus; the others are clustered by ``settle``
    near = counts.filter((F.col("n") >= tokens * KNOWN_SHARE) | (F.col("word") == END)).toPandas().sort_values("word")
    words = [w.encode() for w in near.word] or [END.encode()]
    n = near.n.to_numpy(dtype=np.int64) if len(near) else np.zeros(1, dtype=np.int64)
    return Lexicon(n, {w: i for i, w in enumerate(words)}, int(tokens), int(distinct))


def mixed(keys: np.ndarray, parts: int) -> np.ndarray:
    """A part for each number, all alike in size."""
    part = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
    return part.astype(np.min_scalar_type(parts))


def dealt(key: np.ndarray, name: str, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each key, with the values that have it ``packed``."""
    order = np.argsort(key, kind="stable")
    keys, starts = np.unique(key[order], return_index=True)
    starts = np.append(starts, len(key))
    lists = [packed(x[order], starts) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *lists], names=[name, *columns])


def gathered(batches: Iterator[pa.RecordBatch], **kinds: type) -> list[np.ndarray]:
    """The numbers of ``packed`` columns over all batches."""
    held = list(batches)
    return [np.concatenate([np.zeros(0, kind), *[unpacked(b.column(c), kind)[1] for b in held]]) for c, kind in kinds.items()]


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def neighbours(docs: DataFrame, lexicon: Broadcast) -> DataFrame:
    """(unit, size, before, before_n, after, after_n, half): which units stand beside each one in training texts, and how often.

    A text stands between two ends. A unit beside itself is listed before it only. Units (4 bytes) and counts (8 bytes)
    are ``packed``. Bigrams travel so per part of their hash, where they are summed; then both of their units get them. A
    unit has at most ``n_units`` neighbours.
    """
    partitions = parts_of(docs.sparkSession)
    parts = 4 * partitions

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        end, n_units = lex.unit(END.encode()), lex.n_units
        for whole in batches:
            row = [np.array([end])]
            for batch in pieces(iter([whole]), training=True):
                lengths, words = split_words(batch.column(1))
                codes, different = coded(words)
                row.append(np.insert(lex.units_of(different)[codes], np.cumsum(lengths), end))
            units = np.concatenate(row)
            pairs, n = np.unique(units[:-1] * n_units + units[1:], return_counts=True)
            a, b = np.divmod(pairs, n_units)
            yield dealt(mixed(pairs, parts), "part", {"a": a.astype(np.int32), "b": b.astype(np.int32), "n": n})
        give_back()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_units = lexicon.value.n_units
        a, b, n = gathered(batches, a=np.int32, b=np.int32, n=np.int64)
        if len(n):
            pairs = a.astype(np.int64) * n_units + b
            order = np.argsort(pairs)
            pairs = pairs[order]
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            a, b = np.divmod(pairs[first], n_units)
            n, apart = np.add.reduceat(n[order], first), a != b
            unit, other = np.concatenate([b, a[apart]]), np.concatenate([a, b[apart]])
            after = np.arange(len(unit)) >= len(b)
            columns = {"unit": unit.astype(np.int32), "other": other.astype(np.int32), "after": after.astype(np.int8), "n": np.append(n, n[apart])}
            yield dealt(mixed(unit, parts), "part", columns)
        give_back()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, other, after, n = gathered(batches, unit=np.int32, other=np.int32, after=np.int8, n=np.int64)
        if len(n):
            units, columns = np.unique(unit).astype(np.int64), []
            for side in (0, 1):
                at = np.flatnonzero(after == side)
                at = at[np.argsort(unit[at], kind="stable")]
                starts = np.searchsorted(unit[at], np.append(units, units[-1] + 1))
                columns += [packed(x[at], starts) for x in (other, n)]
                if not side:  # each unit stands behind another or itself
                    size = pa.array(np.add.reduceat(n[at], starts[:-1]))
            names = ["unit", "size", "before", "before_n", "after", "after_n"]
            yield pa.RecordBatch.from_arrays([pa.array(units), size, *columns], names=names)
        give_back()

    pairs = docs.select("doc_id", "text").mapInArrow(counted, "part long, a binary, b binary, n binary")
    sides = pairs.repartition(partitions, "part").mapInArrow(merged, "part long, unit binary, other binary, after binary, n binary")
    types = "unit long, size long, before binary, before_n binary, after binary, after_n binary"
    beside = sides.repartition(partitions, "part").mapInArrow(grouped, types)
    return written(beside.withColumn("half", F.pmod(F.xxhash64("unit"), F.lit(2)).cast("int")), "neighbours", "half", compression="zstd")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_classes(own: np.ndarray, sums: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Per unit the class where it adds most to the likelihood; its present one (``own``) if none is better.

    ``sums``: a row per unit with the counts of the classes before it, of those after it, both without its bigrams with
    itself, and these; ``table``: class bigrams with each unit in its own class. The likelihood is that of
    ``sum(x log x)`` over the table less twice that over the class sizes. Only cells that a unit touches are computed.
    """
    k = len(table)
    left, right, twice = sums[:, :k], sums[:, k : 2 * k], sums[:, 2 * k]
    total, size, each = left.sum(axis=1) + twice, table.sum(axis=0), np.arange(len(own))
    gain, stay = np.zeros((len(own), k)), np.zeros(len(own))

    def grown(base: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _xlogx(base + n) - _xlogx(base)

    for side, cells, other in ((left, table, right), (right, table.T, left)):
        # the unit's class beside class g: cells[g, class]
        u, g = np.nonzero(side)
        if not len(u):
            continue
        kinds, kind = np.unique(side[u, g].astype(np.int64) * k + g, return_inverse=True)
        grows = grown(cells[kinds % k], (kinds // k)[:, None])
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        gain[u[first]] += np.add.reduceat(grows[kind], first)
        # beside its own class the unit's other bigrams are missing there once it is gone
        at = np.flatnonzero(side[each, own])
        n, base = side[at, own[at]][:, None], cells[own[at]]
        gain[at] += grown(base - other[at], n) - grown(base, n)
        # staying: what it gives back to its own class, the cell of that class with itself aside
        off = g != own[u]
        stay += np.bincount(u[off], -grown(cells[g[off], own[u[off]]], -side[u, g][off]), len(own))
    # the cell of a class with itself gets both sides and the unit's bigrams with itself at once
    u, c = np.nonzero(((left > 0) & (right > 0)) | (twice > 0)[:, None])
    cell, x, y = table[c, c], left[u, c], right[u, c]
    gain[u, c] += grown(cell, x + y + twice[u]) - grown(cell, x) - grown(cell, y)
    totals, which = np.unique(total, return_inverse=True)
    gain -= 2 * grown(size[None, :], totals[:, None])[which]
    stay -= grown(table[own, own], -(left[each, own] + right[each, own] + twice)) - 2 * grown(size[own], -total)
    gain[each, own] = stay
    best = gain.argmax(axis=1)
    return np.where(gain[each, best] > stay + 1e-9, best, own)


def judged(own: np.ndarray, unit: np.ndarray, slot: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``best_classes`` for counts ``n`` that are listed by unit (its place in ``own``, ascending) and column of ``sums``."""
    width, out = 2 * len(table) + 1, own.copy()
    for at in range(0, len(own), 500):
        low, high = np.searchsorted(unit, [at, at + 500])
        some = own[at : at + 500]
        cells = (unit[low:high] - at) * width + slot[low:high]
        sums = np.bincount(cells, n[low:high], len(some) * width).reshape(len(some), width)
        out[at : at + 500] = best_classes(some, sums, table)
    return out


def table_from(rows: DataFrame, classes: int) -> np.ndarray:
    """The class bigram table of rows (ca, cb, n)."""
    table = np.zeros((classes, classes))
    for r in rows.groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect():
        table[r.ca, r.cb] = r.n
    return table


def table_rows(table: np.ndarray) -> pa.RecordBatch:
    """(ca, cb, n) of a table."""
    ca, cb = np.nonzero(table)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ca, cb, table[ca, cb].astype(np.int64))], names=["ca", "cb", "n"])


def exchange(beside: DataFrame, n_units: int, n_near: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit, and the class bigrams of near words, from ``neighbours``. Units start dealt out by their frequency."""
    # bounded by the number of units, which the share bounds
    sizes = beside.select("unit", "size").toPandas().sort_values(["size", "unit"], ascending=[False, True])
    of = np.zeros(n_units, dtype=np.uint8)
    of[sizes.unit.to_numpy(dtype=np.int64)] = np.arange(len(sizes)) % classes
    if not len(sizes):
        return of.astype(np.int64), np.zeros((classes, classes))

    def table_of(now: np.ndarray, limit: int) -> np.ndarray:
        """Class bigrams of the units below ``limit``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(classes * classes)
            for batch in batches:
                (row, before), (_, n) = unpacked(batch.column("before"), np.int32), unpacked(batch.column("before_n"), np.int64)
                unit = batch.column("unit").to_numpy()[row]
                n = np.where((unit < limit) & (before < limit), n, 0)
                table += np.bincount(now[before].astype(np.int64) * classes + now[unit], n, classes * classes)
            yield table_rows(table.reshape(classes, classes))

        return table_from(beside.select("unit", "before", "before_n").mapInArrow(run, "ca long, cb long, n long"), classes)

    for sweep in range(sweeps):
        table, now = table_of(of.copy(), n_units), of.copy()

        def judge(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, table: np.ndarray = table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units = batch.column("unit").to_numpy()
                (row, before), (next_row, after) = (unpacked(batch.column(c), np.int32) for c in ("before", "after"))
                slot = np.concatenate([np.where(before == units[row], 2 * classes, now[before].astype(np.int64)), now[after].astype(np.int64) + classes])
                n = np.concatenate([unpacked(batch.column(c), np.int64)[1] for c in ("before_n", "after_n")])
                row = np.concatenate([row, next_row])
                order = np.argsort(row, kind="stable")
                moved = judged(now[units].astype(np.int64), row[order], slot[order], n[order], table)
                yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(moved)], names=["unit", "class"])

        half = beside.filter(F.col("half") == sweep % 2).select("unit", "before", "before_n", "after", "after_n")
        moves = half.mapInArrow(judge, "unit long, class long").toPandas()
        of[moves.unit.to_numpy(dtype=np.int64)] = moves["class"].to_numpy(dtype=np.uint8)
    return of.astype(np.int64), table_of(of.copy(), n_near)


def encode(batches: Iterator[pa.RecordBatch], lex: Lexicon, class_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``encoded`` of batches of (doc_id, text)."""
    end = lex.units[END.encode()]
    classes, logs = np.append(class_of[: len(lex.units)], FAR).astype(np.uint8), np.append(np.log10(lex.counts + 0.5), 0.0)
    # without training rows the end is a unit, but not known
    counted = np.append(lex.counts > 0, False)
    for batch in pieces(batches, training=False):
        lengths, words = split_words(batch.column(1))
        codes, different = coded(words)
        places, rows = lex.places(different)[codes], batch.num_rows
        doc = np.repeat(np.arange(rows), lengths)
        near = np.full(len(doc) + 2 * rows, classes[end], dtype=np.uint8)
        near[np.arange(len(doc)) + 2 * doc + 1] = classes[places]
        starts = np.append(0, np.cumsum(lengths + 2)).astype(np.int32)
        known = np.bincount(doc, counted[places], rows).astype(np.int64) + int(counted[end])
        far = np.append(0, np.cumsum(np.bincount(doc[places < 0], minlength=rows))).astype(np.int32)
        columns = [
            batch.column(0).cast(pa.int64()),
            pa.array(lengths + 1),
            pa.array(known),
            pa.array(np.bincount(doc, logs[places], rows) + logs[end]),
            pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(starts), pa.py_buffer(near)]),
            pc.binary_join(pa.ListArray.from_arrays(pa.array(far), words.filter(pa.array(places < 0))), " "),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "logs", "near", "far"])


def encoded(docs: DataFrame, lexicon: Broadcast, class_of: np.ndarray) -> DataFrame:
    """Per row of (doc_id, text) its tokens as classes of near words, after an end, and its far words in order.

    Columns: doc_id, n_tokens, n_known and logs (log10 of counts) of the near words, near (a byte per token), far (words
    with a space between them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encode(batches, lexicon.value, class_of)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, logs double, near binary, far string")


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``encoded`` in batches of about ``CHUNK`` tokens, where the input has as many."""
    held: list[pa.RecordBatch] = []
    tokens = 0
    for batch in batches:
        held.append(batch)
        tokens += pc.sum(batch.column("n_tokens")).as_py() or 0
        if tokens >= CHUNK:
            yield pa.concat_batches(held)
            held, tokens = [], 0
    if tokens:
        yield pa.concat_batches(held)


def chunked(rows: DataFrame, lexicon: Broadcast, class_of: np.ndarray) -> DataFrame:
    """Rows of (doc_id, text) or of ``encoded``, many in one: lists of their columns, and far words by their places among the different ones.

    ``words`` are these, with a space between them; ``own`` has their classes (a byte each), first those of their last two
    bytes; ``half`` says in which half sweep a word is judged (a digit each), ``n`` how often training texts hold it,
    ``first`` marks one chunk of each word. These and the places (``far``) are ``packed``, as Spark copies bytes at once.
    """
    texts = "text" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        number = TaskContext.get().partitionId() << 32
        classes = class_of.astype(np.uint8)
        for batch in together(encode(batches, lex, class_of) if texts else batches):
            _, words = split_words(batch.column("far"))
            codes, different = coded(words)
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], type=pa.int32()), batch.column(c)) for c in ("doc_id", "n_tokens", "n_known", "logs")]
            near, own = joined_bytes(batch.column("near"))[0], classes[lex.units_of(different)]
            values = [near, own, codes.astype(np.int32), np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int8)]
            near, own, far, n, first = (packed(x, [0, len(x)]) for x in values)
            names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(different)], type=pa.int32()), different), " ")
            columns = [pa.array([number]), near, own, *lists, far, names, n, first]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "near", "own", "doc_id", "n_tokens", "n_known", "logs", "far", "words", "n", "first"])
            number += 1
        give_back()

    types = "chunk long, near binary, own binary, doc_id array<long>, n_tokens array<long>, n_known array<long>, logs array<double>"
    rows = rows.select("doc_id", "text") if texts else rows
    chunks = rows.mapInArrow(run, f"{types}, far binary, words string, n binary, first binary")
    half = F.transform(F.split("words", " "), lambda w: F.pmod(F.xxhash64(w), F.lit(2)).cast("string"))
    return written(chunks.withColumn("half", F.array_join(half, "").cast("binary")), "chunks", compression="zstd")


@dataclass
class Chunk:
    """A row of ``chunked``: the class of each token, which tokens stand in training texts, and the far ones' places and words."""

    row: dict[str, pa.Array | np.ndarray]
    own: np.ndarray
    seq: np.ndarray
    training: np.ndarray
    at: np.ndarray
    far: np.ndarray


#: The kinds of the numbers that ``chunked`` packs.
KINDS = {"near": np.uint8, "own": np.uint8, "far": np.int32, "n": np.int64, "first": np.int8, "half": np.uint8}


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
        row = {c: batch.column(c) for c in batch.schema.names}
        row |= {c: x.flatten() for c, x in row.items() if pa.types.is_list(x.type)}
        row |= {c: unpacked(row[c], kind)[1] for c, kind in KINDS.items() if c in row}
        at, seq = np.flatnonzero(row["near"] == FAR), row["near"].copy()
        seq[at] = row["own"][row["far"]]
        if "half" in row:  # without words there is one digit, for an empty one
            row["half"] = row["half"][: len(row["own"])] - ord("0")
        trained = np.array([not is_held_out(d) for d in row["doc_id"].to_pylist()], dtype=bool)
        yield Chunk(row, row["own"], seq, np.repeat(trained, row["n_tokens"].to_numpy() + 1), at, row["far"])


def far_table(chunks: DataFrame, classes: int) -> np.ndarray:
    """The class bigrams of training texts that hold a far word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(classes * classes, dtype=np.int64)
        for c in chunks_of(batches):
            # a text begins and ends with near words
            beside = np.zeros(len(c.seq), dtype=bool)
            beside[c.at] = beside[c.at - 1] = True
            i = np.flatnonzero(beside & c.training)
            table += np.bincount(c.seq[i].astype(np.int64) * classes + c.seq[i + 1], minlength=classes * classes)
        yield table_rows(table.reshape(classes, classes))

    return table_from(chunks.select("near", "own", "doc_id", "n_tokens", "far").mapInArrow(run, "ca long, cb long, n long"), classes)


def mentions(chunks: DataFrame, half: int, classes: int) -> DataFrame:
    """(word, chunk, place, n, class, slots) for each far word of a half: its training tokens, and a byte for each class beside them.

    The byte is the column of ``best_classes``'s sums; a word before itself has one for both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_of(batches):
            words = np.flatnonzero(c.row["half"] == half)
            if not len(words):
                continue
            again = np.zeros(len(c.at) + 1, dtype=bool)  # the word stands before itself
            again[1:-1] = (np.diff(c.at) == 1) & (np.diff(c.far) == 0)
            before, after = c.seq[c.at - 1], np.where(again[1:], 2 * classes, c.seq[c.at + 1].astype(np.int64) + classes)
            kept = c.training[c.at]
            key = c.far.astype(np.int64) << 8
            keys = np.sort(np.concatenate([(key + before)[kept & ~again[:-1]], (key + after)[kept]]))
            keys = keys[c.row["half"][keys >> 8] == half]
            starts = np.append(np.searchsorted(keys, words * 256), len(keys))
            slots = packed((keys & 255).astype(np.uint8), starts)
            n = np.bincount(c.far[kept], minlength=len(c.own))[words]
            columns = [split_words(c.row["words"])[1].take(pa.array(words)), pa.array(np.full(len(words), c.row["chunk"][0].as_py()))]
            columns += [pa.array(x.astype(np.int32)) for x in (words, n, c.own[words])]
            yield pa.RecordBatch.from_arrays([*columns, slots], names=["word", "chunk", "place", "n", "class", "slots"])

    needed = chunks.select("chunk", "near", "own", "doc_id", "n_tokens", "far", "words", "half")
    return needed.mapInArrow(run, "word string, chunk long, place int, n int, class int, slots binary")


def whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that are sorted by word, cut between words only."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        codes, _ = coded(batch.column("word"))
        cut = int(np.searchsorted(codes, codes[-1]))
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None:
        yield rest


def answers(asked: DataFrame, table: np.ndarray) -> DataFrame:
    """(chunk, told): for the words of ``mentions`` their new classes and their counts in all training texts."""
    partitions = parts_of(asked.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in whole_words(batches):
            word, different = coded(batch.column("word"))
            chunk, place, n, own = (batch.column(c).to_numpy() for c in ("chunk", "place", "n", "class"))
            slots, starts = joined_bytes(batch.column("slots"))
            first = np.r_[True, word[1:] != word[:-1]]
            unit = np.repeat(word, np.diff(starts)).astype(np.int64)
            moved = judged(own[first].astype(np.int64), unit, slots.astype(np.int64), np.ones(len(unit)), table)
            total = np.bincount(word, n, len(different)).astype(np.int64)
            out.append((chunk, place, moved[word].astype(np.uint8), total[word], first.astype(np.int8)))
        if out:
            chunk, *columns = (np.concatenate(x) for x in zip(*out, strict=True))
            yield dealt(chunk, "chunk", dict(zip(("place", "class", "n", "first"), columns, strict=True)))
        give_back()

    # a far word occurs in less than KNOWN_SHARE of the tokens
    by_word = asked.repartition(partitions, "word").sortWithinPartitions("word")
    told = by_word.mapInArrow(judge, "chunk long, place binary, class binary, n binary, first binary")
    return told.groupBy("chunk").agg(F.collect_list(F.struct("place", "class", "n", "first")).alias("told"))


def answered(chunks: DataFrame, told: DataFrame) -> DataFrame:
    """``chunked`` with what ``answers`` says."""
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
            said = batch.column("told").flatten()
            place, put = unpacked(said.field("place"), np.int32)[1], {}
            for name, told_as in (("own", "class"), ("n", "n"), ("first", "first")):
                values = unpacked(batch.column(name), KINDS[name])[1].copy()
                values[place] = unpacked(said.field(told_as), KINDS[name])[1]
                put[name] = packed(values, [0, len(values)])
            yield pa.RecordBatch.from_arrays([put.get(c, batch.column(c)) for c in names], names=names)
        give_back()

    return written(chunks.join(told, "chunk", "left").mapInArrow(run, chunks.schema), "chunks", compression="zstd")


def settled(chunks: DataFrame, near_table: np.ndarray, sweeps: int = FAR_SWEEPS) -> tuple[DataFrame, np.ndarray]:
    """``chunked`` with classes and counts of far words, and the class bigrams of all words. Each half needs a sweep."""
    classes = len(near_table)
    table = near_table + far_table(chunks, classes)
    for sweep in range(sweeps):
        chunks = answered(chunks, answers(mentions(chunks, sweep % 2, classes), table))
        table = near_table + far_table(chunks, classes)
    return chunks, table


def far_words(chunks: DataFrame) -> DataFrame:
    """(word, n, class) of all far words in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, own = (unpacked(batch.column(c), KINDS[c])[1] for c in ("n", "first", "own"))
            columns = [split_words(batch.column("words"))[1], pa.array(n), pa.array(own.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "class"]).filter(pa.array((first > 0) & (n > 0)))

    return written(chunks.select("words", "n", "first", "own").mapInArrow(run, "word string, n long, class long"), "far")


def settle(
    rows: DataFrame, lexicon: Broadcast, class_of: np.ndarray, near_table: np.ndarray, sweeps: int = FAR_SWEEPS
) -> tuple[DataFrame, np.ndarray]:
    """(word, n, class) of all far words in the training rows of ``encoded``, and the class bigrams of all words.

    Far words start in the class of their last two bytes and are exchanged by the same rule as near words.
    """
    chunks, table = settled(chunked(rows, lexicon, class_of), near_table, sweeps)
    return far_words(chunks), table


@dataclass
class ClassModel:
    lexicon: Lexicon
    class_of: np.ndarray
    log_next: np.ndarray
    log_spread: np.ndarray  # per class: log10 of the denominator of its words


def train(docs: DataFrame) -> tuple[ClassModel, DataFrame, DataFrame]:
    """The model of the training rows, the table of far words with their counts and classes, and all rows as chunks."""
    spark = docs.sparkSession
    lexicon = lexicon_of(written(word_counts(docs), "words"))
    shared = spark.sparkContext.broadcast(lexicon)
    n_near = len(lexicon.units)
    class_of, near_table = exchange(neighbours(docs, shared), lexicon.n_units, n_near)
    chunks, table = settled(chunked(docs, shared, class_of), near_table)
    far = far_words(chunks)
    own, counted = class_of[:n_near], lexicon.counts > 0
    spread = 0.5 + np.bincount(own, lexicon.counts, CLASSES) + 0.5 * np.bincount(own[counted], minlength=CLASSES)
    for r in far.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        spread[r["class"]] += r.n + 0.5 * r.words
    unseen = ending_classes(far, lexicon, own)
    smooth = table + 0.5
    return ClassModel(lexicon, np.append(own, unseen), np.log10(smooth / smooth.sum(axis=1, keepdims=True)), np.log10(spread)), far, chunks


def ending_classes(far: DataFrame, lexicon: Lexicon, class_of: np.ndarray) -> np.ndarray:
    """Per last two bytes the class of most training words that end so, ties to the smaller; for others that of most words."""
    ends = [ending(w) for w in lexicon.units]
    near = far.sparkSession.createDataFrame(pd.DataFrame({"ending": ends, "class": class_of})[lexicon.counts > 0], "ending long, class long")
    tail = F.substring(F.col("word").cast("binary"), -2, 2)
    words = far.select(F.conv(F.hex(tail), 16, 10).cast("long").alias("ending"), "class").unionByName(near)
    counts = words.groupBy("ending", "class").agg(F.count(F.lit(1)).alias("words"))
    most = F.max_by("class", F.struct("words", -F.col("class"))).alias("class")
    every = counts.groupBy("class").agg(F.sum("words").alias("words")).agg(most).first()[0] or 0
    out = np.full(1 << 16, every, dtype=np.int64)
    best = counts.groupBy("ending").agg(most).toPandas()  # at most 65,536 rows
    out[best.ending.to_numpy(dtype=np.int64)] = best["class"].to_numpy(dtype=np.int64)
    return out


def held_out() -> Column:
    """``is_held_out`` of the column doc_id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as their query has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def score(docs: DataFrame) -> DataFrame:
    """Scores of every row of (doc_id, text): see ``query``. Null and empty texts hold their end only.

    Repeated rows are scored each, null ids too; without training rows every word has the unseen word's share.
    """
    with shuffles_removed(docs.sparkSession):
        model, _, chunks = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = shared.value
        steps = m.log_next - m.log_spread[None, :]
        for c in chunks_of(batches):
            n, words = c.row["n"], split_words(c.row["words"])[1]
            own, unseen = c.own.copy(), np.flatnonzero(n == 0)
            own[unseen] = m.class_of[m.lexicon.units_of(words.take(pa.array(unseen)))]
            c.seq[c.at] = own[c.far]
            n_tokens = c.row["n_tokens"].to_numpy()
            starts = np.append(0, np.cumsum(n_tokens + 1)[:-1])
            values = np.append(0.0, steps[c.seq[:-1], c.seq[1:]])
            values[c.at] += np.log10(n + 0.5)[c.far]
            values[starts] = 0.0
            doc = np.searchsorted(starts, c.at, "right") - 1
            far_logs = np.bincount(doc, np.log10(n + 0.5)[c.far], len(starts))
            known = c.row["n_known"].to_numpy() + np.bincount(doc, (n > 0)[c.far], len(starts)).astype(np.int64)
            near_logs = c.row["logs"].to_numpy()
            columns = [c.row["doc_id"], pa.array(n_tokens), pa.array(known), pa.array(near_logs + far_logs)]
            columns.append(pa.array(np.add.reduceat(values, starts) + near_logs))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "logs", "score"])
        give_back()

    needed = chunks.select("near", "own", "doc_id", "n_tokens", "n_known", "logs", "far", "words", "n")
    sums = needed.mapInArrow(run, "doc_id long, n_tokens long, n_known long, logs double, score double")
    total, distinct = model.lexicon.tokens, model.lexicon.distinct
    return sums.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its tokens, those known from training, and log10 probabilities by word shares and by the class model."""
    return score(read(spark, sf_dir, "documents", "doc_id", "text"))
