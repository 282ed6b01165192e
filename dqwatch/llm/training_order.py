"""Training-order materialisation: token sequences in a keyed random order, in binary shards of fixed stride.

Texts are encoded and cut into sequences of fixed length. A text of b bytes has at most b div length + 1 of them, so
every text gets as many numbers from running sums of its size alone. A keyed Feistel permutation over the least even
number of bits that holds all numbers, walked on until it falls below their count, scatters them. Ranges of the
scattered numbers are the shards: each is sorted and written by one task, at a fixed stride. A sequence's global slot is
its rank: what the shards before hold, as prefix sums, and its place in its own. Slots have no gaps, though numbers have.

Texts are encoded once. A shard is written under a temporary name and then renamed: a task that runs again repeats the
same bytes. ``index`` beside the shards has the first slot of each, so a reader may start at any slot and go on after a stop.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dqwatch.llm.common import new_path, read, written
from dqwatch.operators.lookup import lookup

LENGTH = 256
#: A shard takes so many numbers. About a quarter of them have a sequence, since tokens have some four bytes.
SHARD_NUMBERS = 32_768
KEY = 0x5EED
END_OF_TEXT = 50_256
_ROUNDS = 4


def permuted(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the numbers ``index`` below ``n``: a permutation of 0 to n - 1 that ``key`` picks."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = [np.uint64(zlib.crc32(f"{key}:{r}:a".encode()) << 32 | zlib.crc32(f"{key}:{r}:b".encode())) for r in range(_ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in rounds:
            mixed = (right ^ r) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(32)) & mask
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (beyond := out >= np.uint64(n)).any():  # cycle-walking: on average fewer than four rounds
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


@lru_cache(maxsize=1)
def _encoding(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sequences(text: str | None, length: int, path: str = "") -> list[np.ndarray]:
    """The text's tokens and one end of text, cut to ``length``; the last one is filled up with ends of text. Null is empty."""
    tokens = _encoding(path).encode_to_numpy(text or "", disallowed_special=())
    filled = np.full((len(tokens) // length + 1) * length, END_OF_TEXT, dtype="<u2")
    filled[: len(tokens)] = tokens
    return list(filled.reshape(-1, length))


def materialise(docs: DataFrame, folder: str, length: int = LENGTH, shard_numbers: int = SHARD_NUMBERS, key: int = KEY, path: str = "") -> DataFrame:
    """Write shards to ``folder`` (a URI that pyarrow opens); one row per sequence of (doc_id, text).

    Returns doc_id, part (number within the document), slot, shard, byte_offset, crc32 of the record. Every row,
    empty and repeated ones and those with a null too, has at least one sequence. Other columns are neither read nor
    returned. No rows write no shards.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    kind = "doc_id long, part int, slot long, shard int, byte_offset long, crc32 long"
    bound = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    bounds = docs.select(F.spark_partition_id().alias("part"), (F.floor(bound / length) + 1).alias("n"))
    # one small row per task
    counted = {r.part: r.n for r in bounds.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    parts = sorted(counted)
    total, first = sum(counted.values()), dict(zip(parts, accumulate((counted[p] for p in parts), initial=0)))
    if not total:
        return spark.createDataFrame([], kind)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
        now = first.get(part, 0)
        for batch in batches:
            ids, parts, numbers, records = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = sequences(text, length, path)
                for k, record in enumerate(made):
                    ids.append(doc_id)
                    parts.append(k)
                    numbers.append(now + k)
                    records.append(packer.compress(record.tobytes()))
                now += len((text or "").encode()) // length + 1
            values = permuted(np.array(numbers, dtype=np.int64), total, key) if ids else np.empty(0, dtype=np.int64)
            columns = [pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(values), pa.array(records, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "value", "record"])
        if now != first.get(part, 0) + counted.get(part, 0):
            raise RuntimeError(f"partition {part} held texts of other sizes when they were counted")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        shard, rank, sink, temporary = -1, 0, None, ""
        unpacker = zstandard.ZstdDecompressor()

        def finish() -> None:
            if sink is not None:
                sink.close()
                store.move(temporary, f"{root}/shard-{shard:06d}.bin")

        for batch in batches:
            shards, ranks, crcs = [], [], []
            for value, record in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if value // shard_numbers != shard:
                    finish()
                    shard, rank = value // shard_numbers, 0
                    temporary = f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temporary)
                data = unpacker.decompress(record)
                crcs.append(zlib.crc32(data))
                sink.write(data)
                shards.append(shard)
                ranks.append(rank)
                rank += 1
            columns = [batch.column(0), batch.column(1), pa.array(shards, pa.int32()), pa.array(ranks, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "shard", "rank", "crc32"])
        finish()

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    numbered = docs.mapInArrow(number, "doc_id long, part int, value long, record binary")
    shard = F.expr(f"cast(value div {shard_numbers} as int)")
    # the shard is the partition: a range of values each, without sampling the sequences for bounds
    ranged = numbered.repartitionById(-(-total // shard_numbers), shard).sortWithinPartitions("value")
    rows = written(ranged.mapInArrow(write, "doc_id long, part int, shard int, rank long, crc32 long"), "sequences")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    index = counts.withColumn("first_slot", F.coalesce(F.sum("n").over(before), F.lit(0)))
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")
    index = spark.read.schema("shard int, n long, first_slot long").parquet(f"{folder}/index")
    placed = lookup(rows, index, ["shard"], "inner", key_counts=index.select("shard", "n"))
    return placed.select(
        "doc_id", "part", (F.col("first_slot") + F.col("rank")).alias("slot"), "shard", (F.col("rank") * 2 * length).alias("byte_offset"), "crc32"
    )


def read_from(folder: str, slot: int = 0, length: int = LENGTH) -> Iterator[np.ndarray]:
    """Records in training order from a global slot on, over all shards."""
    store, root = fs.FileSystem.from_uri(folder)
    index = parquet.read_table(f"{root}/index", filesystem=store).sort_by("first_slot").to_pylist()
    for entry in index:
        if slot < entry["first_slot"] + entry["n"]:
            yield from read_shard(folder, entry["shard"], max(0, slot - entry["first_slot"]), length)


def read_shard(folder: str, shard: int, start: int = 0, length: int = LENGTH) -> Iterator[np.ndarray]:
    """Records of a shard from number ``start`` on, in order."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/shard-{shard:06d}.bin") as file:
        file.seek(2 * length * start)
        while data := file.read(2 * length):
            yield np.frombuffer(data, dtype="<u2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of ``documents`` with its place in the shards, which lie in the shared folder."""
    folder = new_path(spark, "shards")
    return materialise(read(spark, sf_dir, "documents", "doc_id", "text"), folder if "://" in folder else f"file://{folder}")
