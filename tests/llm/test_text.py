"""Operators on texts against plain versions, on edge cases: nulls, empty and long texts, ties, repeats, empty tables."""

import base64
import random
import re
from collections import Counter

import pytest

from latticut.llm import bpe, html, licenses, near_dups, packing, quality_rules, substrings
from latticut.llm.suffixes import suffix_array

EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (6, "Same words here again. " * 40), (7, "Same words here again. " * 40), (8, "x" * 40000 + " end"), (9, "é ü 中文 " * 50), (9, "repeated id " * 30)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokens():
    return pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("chunk,overlap", [(16384, 256), (50, 10), (7, 5)])
def test_bpe_is_tiktoken(spark, frame, tokens, chunk, overlap):
    import tiktoken

    path = tokens.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    rows = [*EDGE, *((100 + k, "".join(rng.choice(["a", "'re", " ", "  ", "\n", "é", "7", "!", "word"]) for _ in range(120))) for k in range(20))]
    got = bpe.decode(bpe.encode(frame(rows, "ids"), path, tokens.PATTERN, chunk_chars=chunk, overlap=overlap), path).collect()
    want = sorted((i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got) == want


def test_licenses(frame):
    rows = [(1, "Released under the MIT License.\nText."), (2, "A. Licensed under the Apache License, Version 2.0.\nReleased under the MIT license."), (3, None), (4, "no licence"), (5, "MIT License")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.recognise(frame(rows, "licenses")).collect()}
    assert got == {1: ["MIT"], 2: ["Apache-2.0", "MIT"], 3: [], 4: [], 5: []}


def test_html():
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; all</h1><p>First  <b>bold</b>\nline.<p>Ti.</article><div class=comments><p>nice</p></div><footer>foot</footer>"
    assert html.extract(page) == "Head & all First bold line. Ti."
    assert html.extract(None) == html.extract("") == html.extract("<nav>only</nav>") == ""


def _shingles(text, n):
    words = WORD.findall((text or "").lower())
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def test_near_duplicates(frame):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randint(0, 400)) for _ in range(150)]
    rows = [r for r in EDGE if r[0] != 9]
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = f"new{rng.randint(0, 30)}"
        rows.append((50 + k, " ".join(words)))
    sets = {i: _shingles(t, 3) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(frame(rows, "bands"), width=3, inter=85).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(500):
        text = [rng.randrange(3) for _ in range(rng.randint(0, 25))] * rng.randint(1, 3)
        assert suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def test_substrings(frame):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdé ") for _ in range(120))
    rows = [r for r in EDGE if r[0] != 9]
    for k in range(20):
        a = rng.randrange(60)
        rows.append((30 + k, "".join(rng.choice("xyz ") for _ in range(rng.randrange(80))) + passage[a : a + rng.randint(20, 60)] + rng.choice(["", passage, "tail"])))
    seen, want = {}, {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if seen.setdefault(data[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        want[i] = (len(data), sum(gone), bytes(b for b, g in zip(data, gone) if not g))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in substrings.remove_repeats(frame(rows, "block")).collect()}
    assert got == want


def test_quality_statistics(frame):
    rows = [*EDGE[:9], (20, "a b c d e f g h i\na b c d e f g h i\nx # $\nx # $ ")]
    got = {r["doc_id"]: r for r in quality_rules.statistics(frame(rows, "n_words")).collect()}
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)), i


def test_outliers_are_rejected(frame):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200)))
    rows = [(k, text()) for k in range(200)] + [(500 + k, " ".join(w + "$$$###" for w in text().split())) for k in range(10)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(rows)).collect()}
    assert all(got[k] for k in range(200)) and not any(got[500 + k] for k in range(10))


def plain_fills(rows, capacity, per_source):
    """How full each bin is if each row (id, length, source, cluster) goes to the tightest bin that takes it, found by looking at all."""
    bins = []
    order = sorted(range(len(rows)), key=lambda k: (-(rows[k][1] % capacity or min(rows[k][1], capacity)), -rows[k][1], rows[k][0] is None, rows[k][0] or 0, rows[k][2] or "", rows[k][3]))
    for k in order:
        _, left, source, cluster = rows[k]
        bins += [[0, Counter(), set()] for _ in range((left - 1) // capacity)]
        left -= max(0, (left - 1) // capacity) * capacity
        best = min((b for b in bins if b[0] > 0 and b[0] >= left and b[1][source] < per_source and cluster not in b[2]), key=lambda b: b[0], default=None)
        if best is None:
            bins.append(best := [capacity, Counter(), set()])
        best[0] -= left
        best[1][source] += 1
        best[2].add(cluster)
    return [capacity - b[0] for b in bins]


def test_packing_takes_the_tightest_bin(spark):
    rng = random.Random(6)
    rows = [(k if rng.random() < 0.9 else None, rng.choice([0, 7, 7, rng.randint(1, 140), 100, 200, 250]), rng.choice(["a", "b", None]), rng.randint(0, 40)) for k in range(500)]
    rows += [(1000, 7, "a", 77)] * 60  # repeats: each conflicts with the others
    docs = spark.createDataFrame([(i, "", s, n, c, "x") for i, n, s, c in rows], "doc_id long, text string, source string, n long, c long, bin_id string")
    got = packing.pack(docs, capacity=100, per_source=3, shard_rows=10_000, length=docs["n"], cluster=docs["c"]).collect()
    held, total = Counter(), Counter()
    for r in got:
        held[r["bin_id"]] += r["length"]
        total[r["doc_id"]] += r["length"]
    assert total == sum((Counter({i: n}) for i, n, _, _ in rows), Counter()) + Counter()
    assert sorted(held.values()) == sorted(plain_fills(rows, 100, 3))


def test_packing_of_texts(frame):
    rows = [(1, "a b c"), (2, None), (3, "d " * 250), (None, "a b c"), (None, "a b c")]
    got = packing.pack(frame(rows, "bin_id"), capacity=100).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 1, 2: 1, 3: 3, None: 2}
    assert sorted((r["doc_id"] or 0, r["piece"], r["offset"], r["length"], r["n_words"]) for r in got) == [(0, 0, 0, 3, 3)] * 2 + [(1, 0, 0, 3, 3), (2, 0, 0, 0, 0), (3, 0, 0, 100, 250), (3, 1, 100, 100, 250), (3, 2, 200, 50, 250)]
    bins = Counter(r["bin_id"] for r in got if r["length"] == 3)
    assert max(bins.values()) == 1  # copies never share a bin
    # a table of one row over and over takes as many shards as others
    many = frame([(None, "same")] * 3000)
    assert packing.pack(many, capacity=100, shard_rows=500).select("shard").distinct().count() == 6


def test_empty_tables(frame, tokens):
    none = frame([])
    assert bpe.encode(none, tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN).count() == 0
    assert licenses.recognise(none).count() == near_dups.near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == quality_rules.judge(none).count() == packing.pack(none).count() == 0
