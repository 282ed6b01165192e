"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves hold the rank of each pair of neighbouring pieces, inner nodes the minimum with ties to the left, so the
root is the leftmost lowest-rank merge. A merge updates its leaf, its neighbours' leaves and their ancestors; it
ends when the root holds no mergeable pair. A word of n pieces takes O(n log n), which matters for words without
any white space of many thousand characters.

The vocabulary file is read where the executors run; ``word_bpe_49k.json`` comes with the installed package
``public_tokenizers``. White space never falls inside a piece of this vocabulary, so the encodings of runs between
white space are kept per worker (in tables of bounded size) and looked up by run.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from dqwatch.llm.common import map_columns, read

#: Code points that the vocabulary's normaliser takes for white space (Unicode's property White_Space).
_SPACE = "\t-\r \x85\xa0  -     　"
_RUN = regex.compile(rf"[^{_SPACE}]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Above every rank.
NO_RANK = 1 << 40
#: Words merged side by side, and their longest in bytes; longer ones are merged one by one.
MANY_WORDS, MANY_LENGTH = 8192, 48
#: Characters of text whose runs are encoded together.
CHUNK_CHARS = 1_000_000
#: Rows whose texts, ids and decoded texts Python holds at a time.
AT_ONCE = 500
#: Encoded runs that a worker keeps in each of its two tables, and the longest of them.
KEPT_RUNS, KEPT_LENGTH = 100_000, 64


class Merges:
    """Pairs of ids with their rank and the id that they merge to, in a hash table that whole arrays look up."""

    def __init__(self, triples: list[tuple[int, int, int]]) -> None:
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(triples)}
        self.result = np.array([m for _, _, m in triples] or [0], dtype=np.int64)
        self.bits = max(4, (4 * len(triples)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank_at = np.full(1 << self.bits, NO_RANK, dtype=np.int64)
        keys = np.array([a << 32 | b for a, b, _ in triples], dtype=np.int64)
        for rank, (slot, key) in enumerate(zip(self._slots(keys).tolist(), keys.tolist(), strict=True)):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.rank_at[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NO_RANK`` for pairs that don't merge and for ids below 0."""
        keys = np.where((left < 0) | (right < 0), -2, left << 32 | right)
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.rank_at[slots], NO_RANK)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        while open_.size:  # linear probing
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[open_]]
            same = there == keys[open_]
            out[open_[same]] = self.rank_at[slots[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return out


def merge_word(ids: list[int], merges: Merges) -> list[int]:
    """Ids of a word after all merges, lowest rank first, leftmost among equals."""
    n, result, get = len(ids), merges.result, merges.ranks.get
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    # a node holds rank and place as one number, so that the minimum is the leftmost of the lowest
    tree = [NO_RANK << shift] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get((ids[i], ids[i + 1]), NO_RANK) << shift | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    following, previous = list(range(1, n + 1)), list(range(-1, n))

    def put(at: int, rank: int) -> None:
        i = size + at
        tree[i] = rank << shift | at
        i >>= 1
        while i:
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
            i >>= 1

    while (root := tree[1]) >> shift < NO_RANK:
        left = root & ((1 << shift) - 1)
        right = following[left]
        after, before = following[right], previous[left]
        ids[left], ids[right] = int(result[root >> shift]), -1
        following[left], previous[after] = after, left
        put(right, NO_RANK)
        put(left, get((ids[left], ids[after]), NO_RANK) if after < n else NO_RANK)
        if before >= 0:
            put(before, get((ids[before], ids[left]), NO_RANK))
    return [i for i in ids if i >= 0]


def merge_words(ids: np.ndarray, merges: Merges) -> np.ndarray:
    """The same for many words at once: a row of ids per word, filled up with -1; each row has a tree of its own."""
    words, n = ids.shape
    size = 1 << max(1, n - 1).bit_length()
    shift = size.bit_length()
    none = NO_RANK << shift
    ids = np.concatenate([ids, np.full((words, 1), -1, dtype=np.int64)], axis=1)  # -1 behind the last one
    tree = np.full((words, 2 * size), none, dtype=np.int64)
    tree[:, size : size + n] = merges.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(words, n) << shift
    tree[:, size : size + n] |= np.arange(n)
    level = size // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2
    following = np.tile(np.arange(1, n + 2), (words, 1))
    previous = np.tile(np.arange(-1, n), (words, 1))
    following[:, n] = n

    def put(rows: np.ndarray, at: np.ndarray, ranks: np.ndarray | int) -> None:
        node = size + at
        tree[rows, node] = ranks << shift | at
        for _ in range(shift - 1):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.arange(words)
    while True:
        root = tree[rows, 1]
        live = root < none
        rows, root = rows[live], root[live]
        if not rows.size:
            return ids[:, :n]
        left = root & ((1 << shift) - 1)
        right = following[rows, left]
        after, before = following[rows, right], previous[rows, left]
        new = merges.result[root >> shift]
        ids[rows, left], ids[rows, right] = new, -1
        following[rows, left], previous[rows, after] = after, left
        put(rows, right, NO_RANK)
        put(rows, left, merges.lookup(new, ids[rows, after]))
        some = before >= 0
        put(rows[some], before[some], merges.lookup(ids[rows[some], before[some]], new[some]))


class WordBpe:
    """A byte-level BPE with word ends, as its vocabulary file describes it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", rf"[^{_SPACE}"))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        names = {i: f"{s} ".encode() for s, i in {**vocab, **self.added}.items()}
        every = [names.get(i, b"") for i in range(max(names) + 1)]
        self.name_bytes = np.frombuffer(b"".join(every), dtype=np.uint8)
        self.name_size = np.array([len(x) for x in every], dtype=np.int64)
        self.name_start = np.cumsum(self.name_size) - self.name_size
        byte_names = self._byte_names()
        self.inner = np.array([vocab[x] for x in byte_names], dtype=np.int64)
        self.last = np.array([vocab[x + suffix] for x in byte_names], dtype=np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _byte_names() -> list[str]:
        """The printable character of each byte: itself where it prints, else the next free one from 256 on."""
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in shown]
        return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]

    def _ids(self, word: bytes) -> np.ndarray:
        ids = self.inner[np.frombuffer(word, dtype=np.uint8)]
        ids[-1] = self.last[word[-1]]
        return ids

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as bytes; short ones by size class many at once, long ones one by one."""
        data = [w.encode("utf-8") for w in words]
        out = [b""] * len(words)
        lengths = np.array([len(d) for d in data], dtype=np.int64)
        low = 0
        for high in (4, 8, 12, 16, 24, 32, MANY_LENGTH):
            every = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for at in range(0, len(every), MANY_WORDS):
                size, chosen = lengths[every[at : at + MANY_WORDS]], every[at : at + MANY_WORDS].tolist()
                flat = np.frombuffer(b"".join([data[i] for i in chosen]), dtype=np.uint8)
                last = np.cumsum(size) - 1
                symbols = self.inner[flat]
                symbols[last] = self.last[flat[last]]
                ids = np.full((len(chosen), high), -1, dtype=np.int64)
                ids[np.arange(high) < size[:, None]] = symbols
                merged = merge_words(ids, self.merges)
                kept = merged >= 0
                blob = merged[kept].astype("<u4").tobytes()
                place = 0
                for i, end in zip(chosen, (4 * np.cumsum(kept.sum(axis=1))).tolist(), strict=True):
                    out[i] = blob[place:end]
                    place = end
        for i in np.flatnonzero(lengths > MANY_LENGTH).tolist():
            out[i] = np.array(merge_word(self._ids(data[i]).tolist(), self.merges), dtype="<u4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the pieces' names joined by spaces: the file names no decoder; ids without a name are left out."""
        ids = ids[ids < len(self.name_size)]
        size = self.name_size[ids]
        ends = np.cumsum(size)
        if not ends.size or not ends[-1]:
            return b""
        places = np.repeat(self.name_start[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.name_bytes[places].tobytes()[:-1]

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs, encoded anew."""
        split = [
            (run,) if run.isalpha() else (run[:-1], run[-1]) if run[-1] in ".," and run[:-1].isalpha() else self.pieces.findall(run)
            for run in runs
        ]
        words = list({w for pieces in split for w in pieces})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        return {r: ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p]) for r, p in zip(runs, split, strict=True)}

    def _encoded(self, runs: set[str]) -> dict[str, bytes]:
        """Two tables of bounded size: what was not asked for while the younger one filled up is forgotten."""
        young, old = self.young, self.old
        known = {run: young[run] for run in runs if run in young}
        rest = [run for run in runs if run not in young]
        known.update((run, old[run]) for run in rest if run in old)
        known.update(self._learn([run for run in rest if run not in old]))
        if len(young) + len(rest) > KEPT_RUNS:
            self.young, self.old = {}, young
        self.young.update((r, known[r]) for r in rest if len(r) <= KEPT_LENGTH)
        return known

    def _parts(self, text: str) -> list[str | list[str]]:
        """Special tokens as strings, what lies between as lists of runs without white space."""
        if "<|" not in text:
            return [_runs(text)]
        parts: list[str | list[str]] = []
        at = 0
        for m in self.special.finditer(text):
            parts += [_runs(text[at : m.start()]), m[0]]
            at = m.end()
        return [*parts, _runs(text[at:])]

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Null is empty."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < CHUNK_CHARS):
                size += len(texts[end] or "")
                end += 1
            chunk = [self._parts(t or "") for t in texts[at:end]]
            at = end
            known = self._encoded({run for parts in chunk for part in parts if not isinstance(part, str) for run in part})
            for parts in chunk:
                yield b"".join(
                    [
                        struct.pack("<I", self.added[part]) if isinstance(part, str) else b"".join([known[run] for run in part])
                        for part in parts
                    ]
                )


def _runs(text: str) -> list[str]:
    """Runs without white space of the normalised text: composed, and lower-cased letter by letter (no final sigma)."""
    if text.isascii():
        text = text.lower()
        # str.split() also splits at the separators 1C to 1F, which aren't white space here
        return text.split() if text.isprintable() or not _SEPARATORS.search(text) else _RUN.findall(text)
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return _RUN.findall(text) if _SEPARATORS.search(text) else text.split()


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of (doc_id, text): ``n_tokens`` and digests of ids and decoded text; ``with_ids`` adds both in full.

    Null and empty texts have no tokens; special tokens' strings in a text are special tokens. ``path`` is a file
    that every executor has (default: of the installed package).
    """

    def encode(ids: list, texts: list) -> tuple[list, ...]:
        model = load(path or default_path())
        out: tuple[list, ...] = (ids, [], [], [], *([[], []] if with_ids else []))
        for encoded in model.encode_many(texts):
            decoded = model.decode(np.frombuffer(encoded, dtype="<u4"))
            out[1].append(len(encoded) // 4)
            out[2].append(hashlib.sha256(encoded).hexdigest())
            out[3].append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                out[4].append(encoded)
                out[5].append(decoded.decode("utf-8"))
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_columns(docs.select("doc_id", "text"), schema + (", ids binary, decoded string" if with_ids else ""), encode, AT_ONCE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded."""
    return encode_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
