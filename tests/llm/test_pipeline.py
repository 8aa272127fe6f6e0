"""Stages of the pipeline against plain versions, on null and repeated ids, clashing names, empty tables."""

import random
import re
from collections import Counter

import corpus_pipeline
from latticut.llm import classify, near_dups, quality_rules, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["kept", "score", "n_removed", "bin_id", "_id", "_row", "first", "d2"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in CLASH)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *CLASH) for i, t in rows], SCHEMA)


def rows_of(docs):
    assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    got = docs.collect()
    assert all([r[c] for c in CLASH] == CLASH for r in got)
    return Counter((r["doc_id"], r["text"]) for r in got)


def prose(rng, n=60):
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("klmnop") * rng.randint(1, 4) for _ in range(n))


def test_quality_rules(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng)) for k in range(60)] + [(None, prose(rng)), (None, "too short"), (1, "too short"), (1, prose(rng) + " ### $$$" * 30), (7, None), (8, "")]
    docs = table(spark, rows)
    verdict = {(r["doc_id"], r["n_words"], r["n_symbols"]): r["kept"] for r in quality_rules.judge(docs).collect()}
    got = rows_of(corpus_pipeline.quality_rules_stage(spark, docs, ""))
    assert got == Counter((i, t) for i, t in rows if verdict[(i, len(WORD.findall(t or "")), len(re.findall(r"[#*$%&|<>]", t or "")))])
    assert got[(None, rows[60][1])] == 1 and not any("###" in t or "short" in t for _, t in got) and len(got) >= 55


def test_quality_classifier(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, prose(rng) if k % 4 else re.sub(" ", "*** ", prose(rng))) for k in range(200)]
    rows += [(None, rows[1][1]), (None, rows[0][1]), (3, rows[0][1]), (500, None)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(200)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = classify.quality_model(docs, labels, where=~queries.held_out())
    score = {(r["doc_id"], r["text"]): r["score"] for r in classify.quality_scores(docs, model, keep=["doc_id", "text"]).collect()}
    got = rows_of(corpus_pipeline.quality_classifier_stage(spark, docs, str(tmp_path)))
    assert got == Counter(r for r in rows if score[r] >= 0.7)
    assert got[(None, rows[1][1])] == 1 and not any(t and "***" in t for _, t in got)


def plain_groups(rows, width=5):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    return [root(k) if sets[k] else ("alone", k) for k in range(len(rows))]


def test_near_dups(spark):
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(6)]
    rows = [(k, base[k % 6]) for k in range(12)]
    for k in range(30):
        words = base[k % 6].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"new{rng.randint(0, 9)}"
        rows.append((20 + k, " ".join(words)))
    # the rows that a join by id would lose or leave twice
    rows += [(100, "one two three four five six seven"), (101, "one two three four five six seven"), (101, "another text of its own with words enough"), (102, "third text that comes twice in all its words"), (102, "third text that comes twice in all its words")]
    rows += [(None, base[0]), (None, "only null ids have these words of a text"), (None, "only null ids have these words of a text"), (103, None), (104, ""), (104, "")]
    got = rows_of(corpus_pipeline.near_dups_stage(spark, table(spark, rows), ""))
    groups = {}
    for row, g in zip(rows, plain_groups(rows)):
        groups.setdefault(g, []).append(row)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())
    # of rows of the smallest id any one may stay
    assert sum(got.values()) == len(groups) and Counter(i for i, _ in got.elements()) == Counter(i for i, _ in want.elements())
    assert set(got) <= set(rows) and got[(101, "another text of its own with words enough")] == 1 and got[(102, rows[-7][1])] == 1


def test_near_duplicates_of_repeated_ids_share_a_component(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "x y z w"), (3, "x y z w"), (None, "x y z w"), (None, None)]
    got = near_dups.near_duplicates(table(spark, rows), width=3, inter=85).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"], r["first"]) for r in got) == {(1, 1, True, True): 1, (2, 1, False, False): 1, (2, 2, True, True): 1, (3, 2, False, False): 1, (None, 2, False, False): 1, (None, None, True, True): 1}


def test_substrings(spark):
    rng = random.Random(4)
    passage = prose(rng, 30) + " é中 " + prose(rng, 10)
    rows = [(k, prose(rng, 8) + " " + passage[rng.randrange(40) :] + prose(rng, 5)) for k in range(25)] + [(3, passage), (None, passage), (90, None), (91, ""), (92, "é" * 100)]
    got = rows_of(corpus_pipeline.substrings_stage(spark, table(spark, rows), ""))
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - 49) if i is not None else ():
            first[data[p : p + 50]] = min(i, first.get(data[p : p + 50], i))
    want = Counter()
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49) if i is not None else ():
            if first[data[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        want[(i, bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore"))] += 1
    assert got == want


def test_packing_takes_every_word(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(1, 3000))) for k in range(30)] + [(None, "a b"), (None, "a b"), (40, None), (41, "")]
    got = corpus_pipeline.packing_stage(spark, table(spark, rows), "").collect()
    total, full = Counter(), Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
        full[r["bin_id"]] += r["length"]
    assert total == Counter({i: len((t or "").split()) * (1 + (i is None)) for i, t in rows}) and max(full.values()) <= 2048
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}


def test_empty_tables(spark, tmp_path):
    docs = table(spark, []).cache()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, str(tmp_path))
        assert left.count() == 0
        assert stage is corpus_pipeline.packing_stage or left.columns == docs.columns


def test_long_texts_and_runs_of_one_character():
    import numpy as np

    data = np.frombuffer(b"a" * 3_000_000 + b"x" + b"a" * 100, np.uint8)
    covered = np.zeros(len(data), int)
    for lo, hi, offs in substrings.parts_of(np.array([0, 3_000_000, 3_000_001, len(data)]), 50):
        cores = substrings.Cores(data[lo:hi], offs, 50)
        assert len(np.unique(cores.key)) <= 1
        for a, b in ((cores.first, cores.last),):
            np.add.at(covered, lo + a, 1)
            assert (a == b).all()
    # each window is in one part, and none crosses texts
    assert covered[: 3_000_000 - 49].tolist() == [1] * (3_000_000 - 49) and covered.sum() == 3_000_000 - 49 + 51
