"""Periodic runs, URL rules and fill-in texts against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from dqwatch.llm import fill_middle, periodic_runs, url_rules

DOCS = "doc_id long, text string, runs string, output string, h1 string, n long"


def plain_runs(words, min_length=6, exponent=4):
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(min_length, exponent * q):
                found.setdefault((start, i - start), q)  # periods ascend, so the smallest stays
    return sorted((s, n, q) for (s, n), q in found.items())


def some_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return rng.choices("ab", k=rng.randrange(0, 60))
    if kind == 1:
        return [rng.choice("ab")] * rng.randrange(0, 40)
    if kind == 2:
        base = rng.choices("abc", k=rng.randrange(1, 12))
        words = base * rng.randrange(1, 9)
        words[rng.randrange(len(words))] = rng.choice("abz")
        return rng.choices("abc", k=rng.randrange(4)) + words + base[: rng.randrange(len(base))] + rng.choices("abc", k=3)
    if kind == 3:
        inner = rng.choices("ab", k=3) * 5
        return (inner + ["x"]) * rng.randrange(1, 8)
    return rng.choices([f"w{i}" for i in range(30)], k=rng.randrange(0, 200))


def test_runs_equal_brute_force():
    rng = random.Random(11)
    texts = [some_words(rng) for _ in range(600)]
    found = periodic_runs.find_runs([[w.encode() for w in t] for t in texts])
    assert [plain_runs(t) for t in texts] == found and sum(map(len, found)) > 300
    again = periodic_runs.find_runs([[w.encode() for w in t] for t in texts], 10, 3)
    assert [plain_runs(t, 10, 3) for t in texts] == again
    with pytest.raises(ValueError):
        periodic_runs.find_runs([], exponent=2)


def test_runs_take_no_quadratic_work():
    words = [b"the"] * 150_000 + [b"%d" % (i % 70_000) for i in range(290_000)] + [b"a", b"b"] * 50_000
    runs = periodic_runs.find_runs([words, words])
    assert runs[0] == runs[1] == [(0, 150_000, 1), (150_000, 290_000, 70_000), (440_000, 100_000, 2)]


def altered(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_row(doc_id, text):
    words = altered(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(lines), digest(" ".join(kept)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    out = [(i, " \t\n".join(some_words(rng))) for i in range(300)]
    out += [(1000, None), (1001, ""), (1002, " \x0b\x0c\r "), (None, "a a a a a a a"), (None, None), (7, out[7][1]), (7, out[7][1])]
    return out + [(1003, "é\x85é  x " * 9), (1004, "same " * 3000 + "end " * 2000), (1005, "<P> kept"), (1006, "tail <S"), (1007, "S> <M"), (1008, "x<S>")]


def test_run_query_equals_brute_force(spark, texts, tmp_path):
    table = spark.createDataFrame([(i, t, "r", "o", "h", 5) for i, t in texts], DOCS)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic_runs.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((run_row(i, t) for i, t in texts), key=str)
    assert sum(r[1] > 0 for r in got) > 60
    assert periodic_runs.periodic_runs(table.limit(0)).count() == 0


def plain_judgement(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    *_, rule, verdict = max(fits, default=(None, default))
    return host, path, rule, verdict


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(13)
    labels, parts = ["a", "b", "aa", "a-b", "net", "example", "É"], ["", "x", "xy", "x y", "é"]
    host = lambda k: ".".join(rng.choices(labels, k=rng.randrange(1, k)))
    path = lambda k: "".join("/" + rng.choice(parts) for _ in range(rng.randrange(0, k)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in [(host(4), path(4)) for _ in range(300)]}.values())
    urls = [f"{rng.choice(['http', 'x:y'])}://{host(6)}{path(6)}{rng.choice(['', '?q=/x', '#://a/'])}" for _ in range(3000)]
    urls += ["HTTP://A.Net/X", "http://net", "http://net?x", "net/", "http:/net/", "://net/", "http://net./", "http://a..net/x", "http://a\nb.net/x\ny", "", None]
    urls += ["http://hot.net/"] * 2000 + ["http://" + "long." * 200 + "net/x" + "/y" * 5000]
    table = spark.createDataFrame([(i % 3000 or None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("net", None, "block"), ("net", "/", None)], url_rules.RULES)
    wanted = sorted(((i % 3000 or None, *plain_judgement(u, rules)) for i, u in enumerate(urls)), key=str)
    got = url_rules.judge_urls(table, given)
    assert sorted(map(tuple, got.collect()), key=str) == wanted
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and len({w[3] for w in wanted}) > 50
    both = spark.createDataFrame([("Net", "/", "allow"), ("net", "/", "block"), ("net", "/", "allow")], url_rules.RULES)
    hot = url_rules.judge_urls(table.filter("url = 'http://hot.net/'"), both).collect()
    assert {(r.rule, r.verdict) for r in hot} == {("net/", "block")} and len(hot) == 2000
    assert url_rules.judge_urls(table.limit(0), given).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(table, given.limit(0), "block").collect()} == {"block"}


def test_one_host_is_dealt_over_many_ranges(spark):
    urls = spark.range(4000).selectExpr("id AS page_id", "'http://hot.net/' AS url")
    keyed = urls.selectExpr("'ten.toh.' AS key", "xxhash64(page_id, url) AS mix")
    borders = url_rules.range_borders(keyed, 8)
    assert len(borders) == 7 and len(set(borders)) == 7


def fill_row(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, digest(text), digest(text)
    form = "spm" if h4 % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), digest(output), digest(text)


def test_fill_query_equals_brute_force(spark, texts, tmp_path):
    rng = random.Random(14)
    shared = "".join(rng.choices("ab É<SPM>😀\n", k=30_000))
    more = [(2000 + i, rng.choice(["", "xé", "<S", "q" * 9000]) + shared[rng.randrange(50) :]) for i in range(60)]
    more += [(3000 + i, rng.choice("<SPM>") * 3 + "<") for i in range(60)] + [(4000, "é" * 20_000), (4001, "w" * 40_000), (4002, "\0" * 9000)]
    rows = texts + more
    spark.createDataFrame([(i, t, "r", "o", "h", 5) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, fill_middle.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((fill_row(i, t) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    table = spark.createDataFrame([(i, t, "r", "o", "h", 5) for i, t in texts], DOCS)
    assert fill_middle.fill_in_middle(table.limit(0)).count() == 0


def test_shared_passages_are_counted_once():
    rng = random.Random(15)
    passage = "".join(rng.choices("abc de.", k=60_000)).encode()
    cache = fill_middle.ChunkCache()
    one, two = (fill_middle.count_texts([head + passage], cache)[0] for head in (b"x", b"some other beginning "))
    chunks = set(one._chunks) & set(two._chunks)
    assert len(chunks) > 0.8 * len(one._chunks) and len(cache._young) < 1.2 * len(one._chunks)
    assert one.n == len(re.findall(rb"[A-Za-z]+|[^A-Za-z]", b"x" + passage))


def test_small_cache_gives_the_same_counts():
    rng = random.Random(16)
    texts = ["".join(rng.choices("ab é", k=rng.randrange(3000))).encode() for _ in range(50)]
    small, large = fill_middle.ChunkCache(500), fill_middle.ChunkCache()
    assert [t.n for t in fill_middle.count_texts(texts, small)] == [t.n for t in fill_middle.count_texts(texts, large)]
    assert small._bytes <= 250 + max(map(len, texts))
