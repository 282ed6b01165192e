"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position has a nonzero vector of ``radius + 1`` bits; the mask of a vector v keeps the positions whose
vector has an odd product with v. The vectors of ``radius`` differing positions always leave some v that is
orthogonal to all of them, so two fingerprints within the radius agree under that v's mask: no pair is missed, with
``2 ** (radius + 1) - 1`` tables of about half the bits each.

Equal fingerprints are folded before the tables are built. A bucket is compared in one task if it is small, else by
pairs of hash slices in as many tasks; a task returns a spanning forest of its links, not the links, which keeps
all components. Components come from star contraction over tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from dqwatch.llm.common import map_columns, read, written
from dqwatch.llm.components import connected_components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Mean number of fingerprints in a slice of a large bucket.
SLICE = 1024
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: one where more than half of the shingles' hashes have one; 0 without words. Null is empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*[words[i:] for i in range(shingle)], strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(grams), _CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[at : at + _CHUNK]], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(ids: list, texts: list) -> tuple[list, list]:
        prints = [fingerprint(t, shingle) for t in texts]
        return ids, [p - (1 << 64) if p >> 63 else p for p in prints]

    return map_columns(docs.select("doc_id", "text"), "doc_id long, fp long", run)


def masks(radius: int) -> list[int]:
    """The masks as signed longs."""
    vectors = [1 + i % ((2 << radius) - 1) for i in range(64)]
    out = []
    for v in range(1, 2 << radius):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(root, member) pairs that connect what links of up to ``radius`` bits connect; ``values`` are few thousand at most."""
    rest = np.unique(values)
    out = []
    while len(rest):
        root, ahead, rest = int(rest[0]), rest[:1], rest[1:]
        while len(ahead) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(ahead), 512):
                distance = np.bitwise_count((ahead[at : at + 512, None] ^ rest[None, :]).view(np.uint64))
                near |= (distance <= radius).any(axis=0)
            ahead, rest = rest[near], rest[~near]
            out += [(root, m) for m in ahead.tolist()]
    return out


def _links_of(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by group; a group may go on in the next batch."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(groups: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero(np.append(groups[1:] != groups[:-1], True)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        pairs = [x for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 2 for x in _forest(values[a:b], radius)]
        two = starts[ends - starts == 2]
        close = two[np.bitwise_count((values[two] ^ values[two + 1]).view(np.uint64)) <= radius]
        a = np.concatenate([values[close], np.array([p[0] for p in pairs], dtype=np.int64)])
        b = np.concatenate([values[close + 1], np.array([p[1] for p in pairs], dtype=np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    groups, values = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for batch in batches:
        groups = np.concatenate([groups, batch.column(0).to_numpy()])
        values = np.concatenate([values, batch.column(1).to_numpy()])
        if len(groups):
            whole = int(np.searchsorted(groups == groups[-1], True)) if groups[0] != groups[-1] else 0
            if whole:
                yield links(groups[:whole], values[:whole])
                groups, values = groups[whole:], values[whole:]
    if len(groups):
        yield links(groups, values)


def near_links(prints: DataFrame, radius: int = RADIUS, slice_size: int = SLICE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all that lie within ``radius`` bits of each other."""
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])
    rows = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.table", "x.key")
    shared = written(rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    parts = shared.select("table", "key", F.ceil(F.col("n") / slice_size).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        rows.join(parts, ["table", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.xxhash64("table", "key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "fp"
        )
    )
    return (
        dealt.repartition("group")
        .sortWithinPartitions("group")
        .mapInArrow(lambda batches: _links_of(batches, radius), "a long, b long")
        .distinct()
    )


def _rooted(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root) of the distinct ``fp`` of (doc_id, fp): its smallest doc_id, and the component's fingerprint."""
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = written(connected_components(written(near_links(prints, radius), "links")), "roots")
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    return written(rooted, "rooted")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per row of (doc_id, text).

    component_id is the smallest doc_id that links reach; rows of one fingerprint are linked, empty and null texts
    through fingerprint 0. Repeated rows stay; null ids get the component's smallest id, or null if all are null.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(rows, radius)
    components = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    classes = written(rooted.join(components, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``rows`` (doc_id, text_hash, root); all columns stay.

    It is the row with the smallest doc_id, a null id only if there is no other; of several texts with that id the one
    with the least hash, of repeated rows any.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    chosen = rows.groupBy("root").agg(least).select(F.col("least.doc_id").alias("__doc"), F.col("least.text_hash").alias("__chosen"))
    chosen = written(chosen, "chosen")
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__chosen"))
    return hashed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "__hash"]).drop("__hash")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, chosen as in ``one_of_each``; all columns stay."""

    def run(ids: list, hashes: list, texts: list) -> tuple[list, ...]:
        prints = [fingerprint(t, shingle) for t in texts]
        return ids, hashes, [p - (1 << 64) if p >> 63 else p for p in prints]

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = written(map_columns(hashed, "doc_id long, text_hash long, fp long", run), "fingerprints")
    return one_of_each(docs, rows.join(_rooted(rows, radius).select("fp", "root"), "fp"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    found = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
