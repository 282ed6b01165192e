"""Templates of benchmark items against a plain version that tries every window at every place."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
import regex

from dqwatch.llm import decontamination

NUMBER, NAME, UNIT = decontamination.NUMBER, decontamination.NAME, decontamination.UNIT


def _cut(text: str, other: str) -> list[str]:
    return [w for w in regex.split(r"[\x20\x09-\x0D]+", regex.sub(other, "", text)) if w] or [""]


def _plain(text: str) -> list[str]:
    return _cut(text.lower(), r"[^\p{L}\p{N}\x20\x09-\x0D]+")


def _template(text: str, names: bool) -> list[str]:
    if names:
        text = regex.sub(r"(?<!\S)\p{Lu}\S*", NAME, text)
    text = regex.sub(r"\p{Nd}+(?:[.,:/]\p{Nd}+)*", NUMBER, text.lower())
    text = regex.sub(rf"(?<=\x01\x20?)(?:{decontamination.UNITS})(?![\p{{L}}\p{{N}}])", UNIT, text)
    return _cut(text, r"[^\p{L}\p{N}\x01-\x03\x20\x09-\x0D]+")


def _brute(docs: list, items: list) -> set:
    """(doc_id, item_id, windows, item_windows) of contaminated documents."""
    out = set()
    for item_id, item in items:
        size = min(decontamination.WINDOW, len(_plain(item or "")))
        if item is None or size < decontamination.MIN_LITERALS:
            continue
        was, usable = _plain(item), defaultdict(dict)
        for names in (True, False):
            marked = _template(item, names)
            for i in range(len(marked) - size + 1):
                part = marked[i : i + size]
                if sum(bool(w.strip(NUMBER + NAME + UNIT)) for w in part) >= decontamination.MIN_LITERALS:
                    usable[i][names] = part
        need = min(decontamination.HITS, len(usable))
        for doc_id, text in docs:
            best, now = 0, _plain(text or "")
            forms = {names: _template(text or "", names) for names in (True, False)}
            for shift in range(-len(was), len(now)):
                steps = []
                for i, parts in sorted(usable.items()):
                    place = i + shift
                    for names in (True, False):
                        # a window with names stays one if only one of the two texts writes them with capitals
                        if place >= 0 and names in parts and forms[names][place : place + size] == parts[names]:
                            marks = [k for k, w in enumerate(parts[names]) if w.strip(NUMBER + NAME + UNIT) != w]
                            steps.append((i, {(was[i + k], now[place + k]) for k in marks}))
                            break
                covered = set()
                for k in range(len(steps) - need + 1):
                    pairs = set().union(*(p for _, p in steps[k : k + need]))
                    if len({a for a, _ in pairs}) == len(pairs):
                        covered |= set(range(k, k + need))
                best = max(best, len(covered))
            if best and need:
                out.add((doc_id, item_id, best, len(usable)))
    return out


ITEM = (
    "Tom has 12 apples and gives 5 kg of them to his friend Ann before noon. Tom then buys 12 more apples at the market near the "
    "river and asks how many apples he now has after paying 30 dollars for all"
)


def _docs() -> list:
    other = ITEM.replace("12", "75").replace("Tom", "Bob").replace("Ann", "Eve").replace("dollars", "euros")
    rows = [
        (1, ITEM),
        (2, ITEM.upper()),
        (3, "before it " + ITEM.lower()),
        (4, other),
        (5, ITEM.replace("30 dollars", "9 euros")),
        (6, ITEM.replace("12 more", "9 more")),
        (7, "of them to his friend there is nothing here that the item has"),
        (8, None),
        (9, ""),
        (10, "the moon has no air to breathe"),
        (11, "The moon has no air, to BREATHE!"),
        (12, " ".join(["word"] * 3000) + " " + ITEM + " word" * 3000),
    ]
    rng = random.Random(3)
    for i in range(20, 60):  # texts with some words of the item replaced
        words = ITEM.split()
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = rng.choice(["12", "7", "Zed", "tree", "The", "km"])
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_contaminated_is_what_all_windows_give(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    items = [(1, ITEM), (2, "The moon has no air to breathe"), (3, None), (4, "too short"), (5, ITEM)]
    docs = _docs()
    df = spark.createDataFrame(docs + [docs[0]], "doc_id long, text string")
    rows = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id, r.windows, r.item_windows) for r in rows}
    assert len(found) == len(rows) and found == _brute(docs, items)
    caught = {d for d, *_ in found}
    assert {1, 2, 3, 4, 5, 10, 11, 12} <= caught and not caught & {7, 8, 9}
    changed = {r.doc_id: r.reparameterised for r in rows if r.item_id == 1}
    assert changed[1] is False and changed[2] is False and changed[4] is True


def test_clean_documents_keep_clashing_columns(spark):
    rows = [(i, t, "h", "d", 1, 2) for i, t in _docs()] + [(None, ITEM, "h", "d", 1, 2), (None, "kept", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hash string, __doc string, pos int, window int")
    items = spark.createDataFrame([(1, ITEM, 0, "x")], "item_id long, text string, doc_id int, words string")
    kept = decontamination.clean_documents(docs, items)
    assert kept.columns == docs.columns
    bad = {d for d, *_ in _brute(_docs(), [(1, ITEM)])}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in _docs()} - bad | {None}
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["kept"]


def test_items_without_id_and_names_behind_the_anchor(spark):
    docs = spark.createDataFrame([(1, "so the old bridge near Paris was closed"), (2, "the old bridge near paris was closed"), (3, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM), (5, "The old bridge near Paris was closed")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(1, 5), (2, 5), (3, None)}


@pytest.mark.parametrize("broadcast", [True, False])
def test_matches_hold_a_piece_of_a_long_text(spark, monkeypatch, broadcast):
    """Each match used to carry all words of its text, and all matches of a text were held at once."""
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    items = [(1, ITEM), (2, "the moon has no air to breathe")]
    # the items stand at all places of the borders between pieces
    texts = [" ".join(["word"] * (225 + i) + [ITEM] + ["word"] * (215 + i) + [items[1][1]]) + " word" * 600 for i in range(0, 40, 3)]
    texts.append(" ".join([ITEM + " " + items[1][1]] * 40))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = spark.createDataFrame(items, "item_id long, text string")
    words = of.select("item_id", decontamination.template_words(of["text"]).alias("words"))
    windows = decontamination._item_windows(words, decontamination.WINDOW)
    places = decontamination._places(docs, decontamination._wanted(words, windows, decontamination.WINDOW), decontamination.WINDOW, True, broadcast)
    sizes = [len(r.words) for r in places.select("words").collect()]
    assert len(sizes) > 1000 and max(sizes) < 300
    found = {(r.doc_id, r.item_id, r.windows, r.item_windows) for r in decontamination.contaminated(docs, of).collect()}
    assert found == _brute(list(enumerate(texts)), items) and len(found) == 2 * len(texts)


def test_windows_of_a_long_item(spark):
    words = [f"w{i}" if i % 7 else f"Name{i}" for i in range(700)]
    items = [(1, " ".join(words)), (2, " ".join(words[:256])), (3, " ".join(words[:263])), (4, "the moon has no air")]
    of = spark.createDataFrame(items, "item_id long, text string")
    of = of.select("item_id", decontamination.template_words(of["text"]).alias("words"))
    rows = decontamination._item_windows(of, decontamination.WINDOW).filter("item_kind = 1 or item_id = 4").collect()
    wanted = {(i, at, tuple(w[at : at + 8])) for i, t in items for w in [t.lower().split()] for at in range(max(1, len(w) - 7))}
    assert {(r.item_id, r.item_pos, tuple(r.item_plain)) for r in rows} == wanted and len(rows) == len(wanted)


def test_stage_clears_long_texts(spark, tmp_path):
    """Memory grew with the square of a text's length: 700 kB with 60 copies of an item ran out of 8 GB of heap."""
    import corpus_pipeline

    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = "word " * 2500
    rows = [(1, (long + ITEM + " ") * 60), (2, long * 60), (None, long + ITEM), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, len(r.text)) for r in kept) == [(0, len(long)), (2, 60 * len(long))]
