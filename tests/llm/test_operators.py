"""Operators against brute force on small inputs, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dqwatch.llm import bpe, class_lm, components, decontamination, html_text, near_copies, secrets, sharding, simhash, topk, toxicity, training_order

DOCS = "doc_id long, text string, source string, extra string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta", "é", "ζ", "Σ", "x" * 60, "12", "5kg"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60))), rng.choice(["a", "b", None]), "e") for i in range(60)]
    rows += [(3, rows[3][1], "a", "e"), (None, "alpha beta", None, None), (100, None, "a", None), (101, "", "b", None)]
    rows += [(200 + i, "same text again and again", "hot", None) for i in range(40)] + [(300, "y" * 5000 + " z" * 3000, "a", None)]
    return spark.createDataFrame(rows, DOCS)


def test_secret_scan_matches_plain_patterns_and_confirms_structure():
    key = bytes([0x30, 0x2E, 2, 1, 0, 0x30, 5, 6, 3, 0x2B, 0x65, 0x70, 4, 0x22, 4, 0x20]) + bytes(range(32))
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = ".".join([part(json.dumps({"alg": "HS256"}).encode()), part(b'{"sub":1}'), part(b"s" * 32)])
    text = f"api_key = 'abcdef' PASSWORD:abc AKIA{'A' * 16} {'0f' * 12} {base64.b64encode(key).decode()} {key.hex()} {token} {part(b'M' * 60)}"
    kinds = [k for k, _, _ in secrets.find_secrets(text)]
    assert kinds.count("der") == 2 and kinds.count("jwt") == 1 and kinds.count("assign") == 1
    plain = [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    plain += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    assert [s for s in secrets.find_secrets(text) if s[0] in ("access", "hex")] == sorted(plain, key=lambda s: s[1])
    broken = base64.b64encode(key[:-1]).decode()  # a nested length no longer fits
    assert not secrets.find_secrets(broken)
    assert secrets.redact("a password=abcdef b") == "a [assign] b"
    assert secrets.find_secrets(None) == [] and secrets.redact(None) is None


def test_keys_over_several_lines():
    size = lambda n: bytes([n] if n < 128 else [0x81, n] if n < 256 else [0x82, *divmod(n, 256)])
    number = lambda n, seed: b"\2" + size(n) + b"\1" + random.Random(seed).randbytes(n - 1)
    inner = b"\2\1\0" + b"".join(number(n, n) for n in (257, 3, 256, 129, 128, 127, 126, 125))
    rsa = base64.b64encode(b"\x30" + size(len(inner)) + inner).decode()
    field = lambda x: struct.pack(">I", len(x)) + x
    parts = b"".join(map(field, (b"none", b"none", b""))) + struct.pack(">I", 1) + field(b"p" * 51) + field(b"s" * 136)
    openssh = base64.b64encode(b"openssh-key-v1\0" + parts).decode()
    wrap = lambda x, end="\n", width=64: end.join(x[i : i + width] for i in range(0, len(x), width))
    pem = lambda kind, body, end="\n": f"-----BEGIN {kind}-----{end}{body}{end}-----END {kind}-----"
    sealed = wrap(base64.b64encode(random.Random(1).randbytes(608)).decode())
    heads = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    blocks = [
        pem("RSA PRIVATE KEY", wrap(rsa)),
        pem("RSA PRIVATE KEY", wrap(rsa, "\r\n"), "\r\n"),
        pem("RSA PRIVATE KEY", heads + sealed),
        pem("RSA PRIVATE KEY", (heads + sealed).replace("\n", " ")),
        pem("RSA PRIVATE KEY", wrap(rsa, "\\n"), "\\n"),
        json.dumps(json.dumps(pem("RSA PRIVATE KEY", heads + sealed)))[3:-3],
        pem("OPENSSH PRIVATE KEY", wrap(openssh, width=70)),
        pem("OPENSSH PRIVATE KEY", wrap(openssh, "\\n", 70), "\\n"),
    ]
    for block in blocks:
        text = f"-----BEGIN RSA PRIVATE KEY-----\nno end {block} after"
        assert [(k, text[a:b]) for k, a, b in secrets.find_secrets(text) if k == "pem"] == [("pem", block)]
        assert secrets.redact(f'{{"key": "{block}"}}') == '{"key": "[pem]"}'
    assert secrets.redact("\n".join(blocks)).split() == ["[pem]"] * len(blocks)
    for end in ("\n", "\r\n", "\n    ", "\\n"):
        for kind, key in (("der", rsa), ("openssh", openssh)):
            for text in (f"key: {wrap(key, end)}", f"key:{end}{wrap(key, end)}{end}Next line", f"{'Q' * 64}{end}{wrap(key, end, 76)}"):
                spans = [(k, text[a:b]) for k, a, b in secrets.find_secrets(text) if k == kind]
                assert spans == [(kind, wrap(key, end, 76 if "QQ" in text[:9] else 64))], (kind, text[:80])
    assert not secrets.find_secrets(wrap(rsa[:-64])) and not secrets.find_secrets(pem("RSA PRIVATE KEY", wrap(sealed.replace("\n", ""))))


def test_secret_rows(docs):
    rows = secrets.scan_secrets(docs).collect()
    assert len(rows) == docs.count() and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.redact_secrets(docs).columns == docs.columns


def test_templates_catch_changed_parameters(spark):
    question = "On Monday the shop of Alice sold 12 apples for 30 dollars and then Alice bought 12 pears from the market again"
    other = question.replace("12", "75").replace("Alice", "Robert").replace("dollars", "euros")
    mixed = other.replace("75 pears", "8 pears")
    docs = spark.createDataFrame(
        [(1, f"Before it. {question} after"), (2, other), (3, mixed), (4, "nothing of it"), (5, None), (6, ""), (2, other), (None, question)],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, question), (8, None), (9, "too short")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.reparameterised for r in decontamination.contaminated(docs, items).collect()}
    assert found[(1, 7)] is False and found[(2, 7)] is True and (None, 7) in found and (4, 7) not in found
    assert (3, 7) not in found  # 12 became 75 at one place and 8 at the other
    assert sorted(r.doc_id for r in decontamination.clean_documents(docs, items).collect()) == [3, 4, 5, 6]
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(training_order.permuted(np.arange(n), n)) == list(range(n))


def test_shards_hold_every_sequence(docs, tmp_path):
    folder = f"file://{tmp_path}/s"
    rows = training_order.materialise(docs, folder, length=16, shard_numbers=128).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    by_slot = [r.crc32 for r in sorted(rows, key=lambda r: r.slot)]
    for start in (0, 1, 77, len(rows) - 1, len(rows)):
        assert [zlib.crc32(record.tobytes()) for record in training_order.read_from(folder, start, 16)] == by_slot[start:]
    for r in rows[::7]:
        record = next(training_order.read_shard(folder, r.shard, r.byte_offset // 32, 16))
        assert zlib.crc32(record.tobytes()) == r.crc32
    plain = Counter((d.doc_id, k, zlib.crc32(s.tobytes())) for d in docs.collect() for k, s in enumerate(training_order.sequences(d.text, 16)))
    assert plain == Counter((r.doc_id, r.part, r.crc32) for r in rows)
    # the order is the permutation's: numbers follow from the sizes of the texts, row by row
    numbers, now = {}, 0
    for part in docs.rdd.glom().collect():
        for d in part:
            for k, s in enumerate(training_order.sequences(d.text, 16)):
                numbers[now + k] = (d.doc_id, k, zlib.crc32(s.tobytes()))
            now += len((d.text or "").encode()) // 16 + 1
    order = np.argsort(training_order.permuted(np.array(list(numbers)), now))
    made = list(numbers.values())
    assert [(r.doc_id, r.part, r.crc32) for r in sorted(rows, key=lambda r: r.slot)] == [made[i] for i in order]
    assert len({r.shard for r in rows}) == -(-now // 128)
    before = {p.name: p.read_bytes() for p in (tmp_path / "s").glob("*.bin")}
    again = training_order.materialise(docs, folder, length=16, shard_numbers=128).collect()  # a run that is repeated
    assert sorted(again, key=str) == sorted(rows, key=str)
    assert {p.name: p.read_bytes() for p in (tmp_path / "s").iterdir() if p.is_file()} == before
    assert training_order.materialise(docs.limit(0), f"file://{tmp_path}/none").count() == 0


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    texts = [r.text for r in docs.collect()] + ["I'll they're it's", "ΑΣ ΣΑ", "a<|endoftext|>b", "é \x1c \x85 ", "😀中文"]
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == wanted
        assert own.decode(np.frombuffer(ids, "<u4")).decode() == library.decode(wanted, skip_special_tokens=False)
    assert bpe.encode_documents(docs).count() == docs.count()


def test_shards_match_the_mixture(docs):
    rows = docs.withColumn("size", docs.doc_id)
    out = sharding.interleave(rows, rows["doc_id"], rows["source"], 7, ties=("text",)).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == docs.count() and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    hot = out[out.source == "hot"].groupby("shard").size()
    assert hot.max() - hot.min() <= 2
    assert sharding.interleave(rows.limit(0), rows["doc_id"], rows["source"], 7).count() == 0


def test_class_model_scores(docs):
    rows = docs.collect()
    out = class_lm.score(docs).toPandas()
    counts = Counter()
    for r in rows:
        if not class_lm.is_held_out(r.doc_id):
            counts.update([*class_lm.words_of(r.text), b"\n"])
    total, distinct = sum(counts.values()), len(counts)
    wanted = sorted(
        round(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*class_lm.words_of(r.text), b"\n"]), 6) for r in rows
    )
    assert sorted(out.base_score.round(6)) == wanted and set(out.train_tokens) == {total}
    assert len(class_lm.score(docs.limit(0)).collect()) == 0


def test_best_classes_maximise_the_likelihood():
    rng = np.random.default_rng(4)
    units, classes = 40, 5
    n = rng.integers(0, 4, (units, units)) * (rng.random((units, units)) < 0.3) + np.diag(rng.integers(0, 3, units))
    of = rng.integers(0, classes, units)

    def table(of):
        member = np.eye(classes)[of]
        return member.T @ n @ member

    def likelihood(of):  # sizes as the table has them when a text returns to where it began
        log = lambda x: x * np.log(np.maximum(x, 1))
        return log(table(of)).sum() - 2 * log(np.eye(classes)[of].T @ n.sum(axis=0)).sum()

    member, apart = np.eye(classes)[of], n - np.diag(np.diag(n))
    sums = np.column_stack([apart.T @ member, apart @ member, np.diag(n)]).astype(float)
    moved = class_lm.best_classes(of, sums, table(of))
    assert (moved != of).sum() > 10
    for u in range(units):
        tried = [likelihood(np.where(np.arange(units) == u, c, of)) for c in range(classes)]
        assert np.isclose(tried[moved[u]], max(tried))


@pytest.fixture()
def usage(spark, monkeypatch):
    """Far words with the same last two letters, half of them used like names, half like verbs, and some beside each other."""
    monkeypatch.setattr(class_lm, "KNOWN_SHARE", 0.02)
    rng = random.Random(8)
    names, verbs = [f"n{i}aa" for i in range(40)], [f"v{i}aa" for i in range(40)]
    some = lambda near, far: rng.choice(near) if rng.random() < 0.5 else rng.choice(far)
    clause = lambda: f"the {some(['bob', 'tim'], names)} will {some(['run', 'eat'], verbs)} {some(['bob', 'tim'], names)} now"
    rows = [(i, " ".join(clause() for _ in range(4))) for i in range(300)]
    rows += [(7, "the n1aa Will"), (None, "now v3aa v4aa n5aa n5aa"), (3, None), (4, " ")]
    held = [i for i, _ in rows if class_lm.is_held_out(i)]
    rows += [(held[0], "new1aa the zz new1aa v1aa"), (held[1], "\ufffd x")]
    counts = Counter(w for i, t in rows if not class_lm.is_held_out(i) for w in [*class_lm.words_of(t), b"\n"])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return docs, [(i, [b"\n", *class_lm.words_of(t), b"\n"]) for i, t in rows], counts, names, verbs


def test_far_words_are_clustered_by_their_own_bigrams(spark, usage):
    docs, lines, counts, names, verbs = usage
    lexicon = class_lm.lexicon_of(class_lm.word_counts(docs))
    assert set(lexicon.units) == {b"\n", b"the", b"will", b"now", b"bob", b"tim", b"run", b"eat"}
    class_of = np.zeros(lexicon.n_units, dtype=np.int64)
    for c, words in enumerate([[b"bob", b"tim"], [b"run", b"eat"], [b"the", b"will"]], 1):
        class_of[[lexicon.units[w] for w in words]] = c
    table = np.zeros((4, 4))
    for i, line in lines:
        for a, b in zip(line, line[1:]):
            if not class_lm.is_held_out(i) and a in lexicon.units and b in lexicon.units:
                table[class_of[lexicon.units[a]], class_of[lexicon.units[b]]] += 1
    shared = spark.sparkContext.broadcast(lexicon)
    rows = class_lm.encoded(docs, shared, class_of).filter(~class_lm.held_out())
    far, all_words = class_lm.settle(rows, shared, class_of, table)
    found = {r.word: (r.n, r["class"]) for r in far.collect()}
    # words that differ in use only no longer share a class
    assert found == {w: (counts[w.encode()], 1 if w in names else 2) for w in names + verbs}
    assert all_words.sum() == counts.total()


def test_class_score_is_the_sum_over_class_bigrams_of_all_words(usage):
    docs, lines, counts, _, _ = usage
    model, far, _ = class_lm.train(docs)
    class_of = {r.word.encode(): r["class"] for r in far.collect()}
    assert len(class_of) == 80
    own = lambda w: class_of[w] if w in class_of else int(model.class_of[model.lexicon.unit(w)])
    table = np.full((class_lm.CLASSES,) * 2, 0.5)
    for i, line in lines:
        if not class_lm.is_held_out(i):
            np.add.at(table, ([own(w) for w in line[:-1]], [own(w) for w in line[1:]]), 1)
    size = Counter()
    for w, n in counts.items():
        size[own(w)] += n + 0.5
    wanted = []
    for _, line in lines:
        steps = [table[own(a), own(b)] / table[own(a)].sum() * (counts[b] + 0.5) / (size[own(b)] + 0.5) for a, b in zip(line, line[1:])]
        wanted.append((len(steps), sum(w in counts for w in line[1:]), round(float(np.log10(steps).sum()), 6)))
    assert sorted((r.n_tokens, r.n_known, round(r.score, 6)) for r in class_lm.score(docs).collect()) == sorted(wanted)


def test_words_are_split_and_ended_as_one_by_one():
    rng = random.Random(3)
    texts = [None, "", " \t", "É x", *("".join(rng.choices(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0aBZé\x00", k=rng.randrange(12))) for _ in range(500))]
    lengths, words = class_lm.split_words(pa.array(texts, type=pa.string()))
    wanted = [class_lm.words_of(t) for t in texts]
    assert words.cast(pa.binary()).to_pylist() == [w for x in wanted for w in x] and list(lengths) == [len(x) for x in wanted]
    assert list(class_lm.endings(words[7:])) == [class_lm.ending(w) for x in wanted for w in x][7:]


def test_bigrams_travel_as_lists_and_are_counted_whole(spark, usage):
    docs, lines, _, _, _ = usage
    lexicon = class_lm.lexicon_of(class_lm.word_counts(docs))
    found = class_lm.neighbours(docs, spark.sparkContext.broadcast(lexicon)).collect()
    plain = Counter(
        (lexicon.unit(a), lexicon.unit(b)) for i, line in lines if not class_lm.is_held_out(i) for a, b in zip([b"\n", *line[1:]], line[1:])
    )
    units, sums = (lambda x: np.frombuffer(x, np.int32).tolist()), (lambda x: np.frombuffer(x, np.int64).tolist())
    assert {(a, r.unit): n for r in found for a, n in zip(units(r.before), sums(r.before_n))} == plain
    assert {(r.unit, b): n for r in found for b, n in zip(units(r.after), sums(r.after_n))} == {k: n for k, n in plain.items() if k[0] != k[1]}
    assert len(found) == len({r.unit for r in found}) and all(r["size"] == sum(sums(r.before_n)) for r in found)


def test_a_far_word_is_asked_for_once_per_chunk(spark, usage):
    docs, lines, counts, names, verbs = usage
    lexicon = class_lm.lexicon_of(class_lm.word_counts(docs))
    shared, class_of = spark.sparkContext.broadcast(lexicon), np.zeros(lexicon.n_units, dtype=np.int64)
    chunks = class_lm.chunked(docs, shared, class_of)
    asked = [r for half in (0, 1) for r in class_lm.mentions(chunks, half, 4).collect()]
    assert chunks.count() == 5 and len(asked) == len({(r.chunk, r.word) for r in asked}) < sum(counts[w.encode()] for w in names + verbs) / 2
    totals = Counter()
    for r in asked:
        totals[r.word] += r.n
    assert all(totals[w] == counts[w.encode()] for w in names + verbs)
    # two neighbours each, but one where a word stands before itself
    twice = sum(a == b for i, x in lines if not class_lm.is_held_out(i) for a, b in zip(x, x[1:]) if a not in lexicon.units)
    assert sum(len(r.slots) for r in asked) == 2 * sum(r.n for r in asked) - twice
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    assert class_lm.score(docs).count() == docs.count() and spark.conf.get(setting, None) == before


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.masks(3)]
    rng = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 4)))
        assert any(not flips & m for m in masks)


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = random.Random(2)
    base = rng.getrandbits(63)
    prints = [base ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(0, 5))) for _ in range(400)] + [rng.getrandbits(63) for _ in range(100)]
    prints = sorted(set(prints))
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), slice_size=50)
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert [roots.get(p, p) for p in prints] == [prints[find(i)] for i in range(len(prints))]
    classes = simhash.near_duplicates(docs).toPandas()
    assert len(classes) == docs.count() and set(classes[classes.doc_id.isin(range(200, 240))].component_id) == {200}
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) and 200 in kept and 201 not in kept
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


UNLIKE = ["one two three four five", "the cat sat on the mat", "a quick red fox ran home", "rain fell over many old towns"]


def test_every_component_keeps_one_row(spark):
    a, b, c, d = UNLIKE
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c), (1, c), (None, d), (None, None), (None, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text or "") for r in kept) == Counter([(None, a), (None, b), (1, c), (1, d), (None, "")])


def test_near_copies_equal_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(8)
    texts, words = [], [f"w{i}" for i in range(5000)]
    for size in (4, 12, 40, 80, 200, 800) * 4:
        base = rng.choices(words, k=size)
        for changed in (0, 0, 1, 2, 4, 8, 16):
            other = base.copy()
            for at in rng.sample(range(size), min(changed, size // 4)):
                other[at] = rng.choice(words)
            texts.append(" ".join(other))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (None, "one of no other id"), (3, "another text of one id")]
    grams = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set()
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    wanted = Counter(rows[i] for i in range(len(rows)) if find(i) == i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == wanted
    assert Counter(tuple(r) for r in near_copies.keep_one(docs, large=2, slice_size=3).collect()) == wanted
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)] + [(500, None), (501, [None] * 8), (502, [float("nan")] * 8)]
    vectors += [(600 + i, vectors[0][1]) for i in range(30)]
    table = topk.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    rows = {r.vec_id: np.array(r.v) for r in table.collect()}
    out = topk.top_k(table, table.filter("vec_id % 50 = 0")).collect()
    for q in [i for i in rows if i % 50 == 0]:
        best = sorted(((-int(v @ rows[q]), i) for i, v in rows.items() if i != q))[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == best
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_blocks_are_pruned():
    import pandas as pd

    rng = np.random.default_rng(4)
    values = rng.normal(size=(4000, 4)) * 100
    signs = ["".join("0" if x < 0 else "1" for x in v) for v in values]
    blocks = pd.DataFrame({"vec_id": range(4000), "v": list(values.astype(int)), "signs": signs})
    _, scored = topk.search_sets(blocks, blocks.head(20)[["vec_id", "v"]], 10, 64)
    assert scored < 20 * 63 / 2


def test_main_text():
    page = """<html><body><header>Site</header><nav><a href=/>x</a></nav><div class="cookie-notice">We use, cookies</div>
      <div id=main><div class=content><h1>A &amp; b</h1><p>First,\n long  paragraph, with commas, and more.<p>Second <b>b</b>old.</div>
      <div class="comments"><p>Reader, says, that, this, is, great, indeed.</p></div></div><footer>F</footer><script>p("</p>")</script>"""
    assert html_text.main_text(page) == "A & b First, long paragraph, with commas, and more. Second bold."
    assert html_text.main_text(None) == "" and html_text.main_text("plain &lt; text") == "plain < text"


def test_main_text_without_article_elements():
    long = "Words, of, an, article, that, go, on, and, on, for, a, while. " * 4
    page = f"""<body><div class="menu">x</div><div id=main><h1>Title</h1><p>Short lead.</p><div class=text><p>{long}<p>{long}</div>
      <h2>Part</h2><blockquote>Quoted.</blockquote><pre>code()</pre><ul><li>one<li>two</ul><table><tr><td>3</table>
      <div class=part><p>Short section.</div>loose <b>b</b>old<ul><li><a href=/>linked elsewhere</a></ul></div></body>"""
    plain = f"Title Short lead. {long}{long}Part Quoted. code() one two 3 Short section. loose bold"
    assert html_text.main_text(page) == plain
    for name in ("overflow-hidden", "has-sidebar", "comments-open", "side-by-side"):
        assert html_text.main_text(f'<body><div class="{name}"><h1>T</h1><p>{long}</div></body>') == f"T {long}".strip()
    for name in ("site-footer", "comment-list", "sidebar", "cookie-notice", "social_share", "comment-12"):
        assert html_text.main_text(f'<body><div><h1>T</h1><p>{long}</div><div class="{name}"><p>{long}</div></body>') == f"T {long}".strip()


def test_attributes_forms_and_reader_comments():
    long = "Words, of, an, article, that, go, on, and, on. " * 5
    assert html_text.main_text(f"<body><div><p data-x=it's>{long}</p><p title=\"a>b\" 'odd>Second's end.</p></div></body>") == f"{long}Second's end."
    page = f"<body><form action=/x><div id=main><h1>T</h1><p>{long}</p><input value=v><select><option>o</select></div></form></body>"
    assert html_text.main_text(page) == f"T {long}".strip()
    small = f"<body><div><h1>T</h1><p>{long}</p><form><p>Your, mail, please, now</p><button>Go</button></form></div></body>"
    assert html_text.main_text(small) == f"T {long}".strip()
    for name in ("user-comments", "commentlist", "related-posts", "reader_comments"):
        assert html_text.main_text(f'<body><div><h1>T</h1><p>{long}</div><div class="{name}"><p>{long}</div></body>') == f"T {long}".strip()


@pytest.mark.parametrize("html", ["<div><p>" * 50_000, "<ul><li>" * 50_000, "<b>" * 100_000, "<p>" * 50_000 + "</i>" * 50_000, "<div><p>a, b</p>" * 50_000])
def test_deep_pages_take_linear_time(html):
    start = time.process_time()
    assert html_text.main_text(html + "end").endswith("end")
    assert time.process_time() - start < 15


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, 0), (2, "v", "", 1)], "page_id long, url string, html string, text long")
    out = html_text.extract(pages)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "u", "a", 1)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_chain_learns_and_bounds(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choices(["one", "two", "three", "four"], k=20) + ["vile"] * toxic), 1 - i % 2, int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(None, None), (1000, "vile two"), (1000, "vile two")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows[:300]] + [(350, None, 1)], "doc_id long, junk int, toxic int")
    chain = toxicity.train_chain(docs, labels, ["junk", "toxic"])
    scored = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    assert all((scored[i] >= 0.5) == bool(t) for i, _, _, t in rows) and scored[1000] >= 0.5
    assert toxicity.without_toxic(docs, chain).count() == 301
    empty = toxicity.train_chain(docs, labels.limit(0), ["junk", "toxic"])
    assert toxicity.without_toxic(docs, empty).count() == docs.count()


def test_near_copies_hold_few_rows_as_objects(spark):
    """A whole batch of texts with its shingles used to be held at once."""
    from dqwatch.llm.common import map_columns

    rows = spark.range(0, 11, numPartitions=1)
    got = map_columns(rows, "id long, n long", lambda ids: [ids, [len(ids)] * len(ids)], 4).collect()
    assert [(r.id, r.n) for r in got] == [(i, 4 if i < 8 else 3) for i in range(11)]
    assert {r.n for r in map_columns(rows, "id long, n long", lambda ids: [ids, [len(ids)] * len(ids)]).collect()} == {11}


def test_near_copies_miss_no_pair(spark, monkeypatch):
    """Jaccard 0.8 to the point; none of the 40 MinHash bands that chose candidates before was equal."""
    base = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{base} x508"), (2, f"{base} x1787"), (3, f"{base} x508 more"), (4, "w1 w2 w3 w4 w5 other words"), (None, f"{base} x508")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_one(docs.filter("doc_id < 3")).collect()} == {1}
    for sampled, large in ((10_000, 64), (0, 64), (10_000, 2)):  # common shingles known or not, pairs or slices
        monkeypatch.setattr(near_copies, "SAMPLED", sampled)
        assert {r.doc_id for r in near_copies.keep_one(docs, large=large).collect()} == {1, 4}


def test_prefixes_of_near_sets_meet():
    """Whatever the order, and for all sizes at which two sets just reach the similarity."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        common, more = int(rng.integers(1, 60)), rng.integers(0, 9, 2)
        grams = rng.integers(0, 1 << 63, common + int(more.sum()), dtype=np.uint64)
        a, b = np.sort(grams[: common + more[0]]), np.sort(np.delete(grams, slice(common, common + more[0])))
        known = np.sort(rng.choice(grams, size=int(rng.integers(0, len(grams))), replace=False))
        counts = rng.integers(1, 4, len(known))
        x, y = near_copies.prefix(a, known, counts), near_copies.prefix(b, known, counts)
        if near_copies.are_near(common, len(a), len(b)):
            met, longer = len(np.intersect1d(x, y)), max(len(a), len(b))
            assert met and near_copies.are_near(met + -(-4 * longer // 5) - 1, len(a), len(b))
    assert len(near_copies.prefix(np.empty(0, np.uint64), known, counts)) == 0


def test_bpe_tables_and_batches_stay_small(monkeypatch):
    """Six workers of an executor hold such tables side by side."""
    model = bpe.WordBpe(bpe.default_path())
    monkeypatch.setattr(model, "_learn", lambda runs: {r: b"1234" for r in runs})
    for at in range(0, 400_000, 40_000):
        model._encoded({f"run{i}" for i in range(at, at + 40_000)})
    assert len(model.young) + len(model.old) <= 200_000
    sizes: list = []
    monkeypatch.setattr(bpe, "map_columns", lambda df, schema, fn, at_once=None: sizes.append(at_once))

    class Docs:
        def select(self, *_: str) -> None: ...

    bpe.encode_documents(Docs())
    assert sizes[0] is not None and sizes[0] <= 1000
