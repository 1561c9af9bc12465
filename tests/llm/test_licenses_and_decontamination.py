import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import decontamination, licenses
from tallyline.llm.aligning import banded, local

from .conftest import prose


def slow_local(item, text):
    best, h = 0, {}
    for i in range(len(item) + 1):
        for j in range(len(text) + 1):
            if i == 0 or j == 0:
                h[i, j] = 0
                continue
            step = 2 if item[i - 1] == text[j - 1] != 0 else -1
            h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def slow_common(item, text, low, high):
    reach = {}
    for i in range(len(item) + 1):
        for j in range(-1, len(text) + 1):
            if j <= 0 or i == 0:
                reach[i, j] = 0
                continue
            hit = item[i - 1] == text[j - 1] != 0 and low <= j - i <= high
            reach[i, j] = max(reach[i - 1, j], reach[i, j - 1], reach[i - 1, j - 1] + hit)
    return reach[len(item), len(text)]


def test_alignments_equal_plain_ones():
    rng = random.Random(4)
    for _ in range(150):
        a, b = (np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 12))]) for _ in range(2))
        score, x, y, p, q, same = local(a, b)
        assert score == slow_local(a, b)
        if score:
            assert local(a[x:y], b[p:q])[0] == score and same <= min(y - x, q - p)
        matched, first, last = banded(a, b, 0, 20)
        assert matched == slow_common(a, b, -20, 20) and (not matched or 0 <= first < last <= len(b))


def test_winnowing_keeps_the_least_of_every_window():
    rng = random.Random(2)
    h = [rng.randint(0, 9) for _ in range(60)]
    kept = licenses.winnowed(h, 4)
    assert all(any(i in kept and h[i] == min(h[a : a + 4]) for i in range(a, a + 4)) for a in range(57))


def test_notices_are_found_whole_edited_and_repeated(spark, no_docs):
    mit, isc = licenses.TEMPLATES["mit-notice"], licenses.TEMPLATES["isc"]
    edited = isc.replace("for any purpose ", "for all purposes ").replace("granted", "given, gladly")
    rng = random.Random(8)
    texts = [None, "", "no notice", f"{prose(rng, 20)}\n{mit}\n{prose(rng, 9)} {mit}", f"{edited} {prose(rng, 30)}", mit.upper(), "the MIT"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, licenses string")
    got = {r.doc_id: [(f.license, round(f.coverage, 2), texts[r.doc_id][f.start : f.end]) for f in r.licenses] for r in licenses.with_licenses(df).collect()}
    assert got[3] == [("mit-notice", 1.0, mit[:-1])] * 2 and got[5] == [("mit-notice", 1.0, mit.upper()[:-1])]
    assert [f[0] for f in got[4]] == ["isc"] and 0.8 <= got[4][0][1] < 1
    assert all(got[i] == [] for i in (0, 1, 2, 6)) and licenses.license_finds(no_docs).count() == 0
    with pytest.raises(ValueError, match="fewer than"):
        licenses.Index({"short": "one two"})


def test_items_are_found_exact_edited_and_widely_leaked(spark, no_docs):
    rng = random.Random(11)
    items = [(i, prose(rng, 25)) for i in range(6)]
    words = items[1][1].split()
    swapped = " ".join(w if i % 6 else "other" for i, w in enumerate(words))
    missing = " ".join(w for i, w in enumerate(items[2][1].split()) if i % 7)
    texts = [prose(rng, 80) for _ in range(20)] + [f"{prose(rng, 30)} {items[0][1]} {prose(rng, 5)}"] * 30
    texts += [f"{prose(rng, 9)} {swapped}", f"{missing} {prose(rng, 40)}", items[3][1] + " " + items[4][1], " ".join(items[5][1].split()[:6]), None, ""]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, hits string").repartition(3)
    bench = spark.createDataFrame([*items, items[0], (7, None), (8, ""), (None, "x y z")], "item_id long, text string")
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    got = {(r.doc_id, r.item_id): r for r in decontamination.contamination(docs, bench).collect()}
    exact = {(d, i) for d, t in enumerate(texts) for i, x in items if plain(x) in plain(t)}
    assert set(got) == exact | {(50, 1), (51, 2)} and len(exact) == 32
    assert all(got[k].score == 1.0 and plain(texts[k[0]][got[k].start : got[k].end]) == plain(items[k[1]][1]) for k in exact)
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontamination.clean(docs, bench.limit(0)).count() == len(texts) and decontamination.contamination(no_docs, bench).count() == 0


def test_items_of_one_and_two_words_are_seeds_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "find uniqueword here"), (2, "not here")], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "uniqueword"), (2, "not here")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contamination(docs, bench).select(F.col("doc_id"), F.col("item_id")).collect()} == {(1, 1), (2, 2)}


def edited(rng, words, kind, every):
    """Copies with every so-manieth word replaced, left out, or followed by another one."""
    out = []
    for i, w in enumerate(words, 1):
        hit = i % every == 0
        out += {"replaced": [prose(rng, 1) + "x"] if hit else [w], "left out": [] if hit else [w], "added": [w, prose(rng, 1) + "x"] if hit else [w]}[kind]
    return out


def test_items_are_found_at_every_edit_rate_as_by_plain_alignment(spark):
    rng = random.Random(31)
    items = [(i, prose(rng, n)) for i, n in enumerate([*range(1, 13), 16, 20, 25, 31, 40, 59])]
    texts = [items[14][1]] * 3 + [prose(rng, 3000)]
    for _, x in items:
        for kind in ("replaced", "left out", "added"):
            for every in range(1, 9):
                copy = " ".join(edited(rng, x.split(), kind, every))
                texts += [f"{prose(rng, rng.randint(0, 30))} {copy} {prose(rng, rng.randint(0, 30))}"] * rng.randint(1, 3)
        texts += [" ".join(w for w in x.split() for w in ([w] if rng.random() < 0.8 else rng.choice(([], [prose(rng, 1)], [w, prose(rng, 1)])))) for _ in range(6)]
    texts += [" ".join([prose(rng, 400), *(" ".join(edited(rng, x.split(), "replaced", 6)) for _, x in items[10:]), prose(rng, 400)])]
    known = decontamination.Vocabulary()
    learnt = {i: known.learn(x) for i, x in items}
    want = {}
    for d, t in enumerate(texts):
        words = known.read(t)
        for i, item in learnt.items():
            score = local(item, words)[0] / (2 * len(item))
            if score >= 0.6:
                want[d, i] = score
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for n in (1, 2, 3):
        got = {(r.doc_id, r.item_id): r.score for r in decontamination.contamination(docs, bench, n=n).collect()}
        assert got == want
    assert sum(0.6 <= s < 0.7 for s in want.values()) > 30


def test_a_character_whose_lower_case_is_longer_hides_nothing(spark):
    rng = random.Random(5)
    apache, item = licenses.TEMPLATES["apache-2.0-notice"], "When The Harbour Of \u0130zmir Opened Again Nobody Had Counted The Old Ships"
    texts = [f"\u0130stanbul {apache}", f"{prose(rng, 8)} \u0130ki {item.upper()} {prose(rng, 4)}", f"{prose(rng, 8)} {item}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [(r.license, r.coverage, texts[0][r.start : r.end]) for r in licenses.license_finds(df).collect()] == [("apache-2.0-notice", 1.0, apache[:-1])]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.score, texts[r.doc_id][r.start : r.end]) for r in decontamination.contamination(df, bench).collect()}
    assert got == {1: (1.0, item.upper()), 2: (1.0, item)}


def test_every_variant_of_coverage_0_8_is_found_as_by_plain_alignment():
    rng = random.Random(13)
    index = licenses.Index(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        words = re.findall(r"\w+", template)
        variants = []
        for i in range(len(words)):
            variants += [words[:i] + ["zzz"] + words[i + 1 :], words[:i] + words[i + 1 :], words[: i + 1] + ["zzz"] + words[i + 1 :]]
        spread = set(rng.sample(range(len(words)), min(8, len(words) - 1)))
        variants.append([x for i, w in enumerate(words) for x in ([w, "zzz"] if i in spread else [w])])
        variants += [["zzz" if i % 5 == k else w for i, w in enumerate(words)] for k in range(5)]
        for v in variants:
            text = " ".join([prose(rng, 20), *v, prose(rng, 20)])
            matched = sum(w != "zzz" for w in v)
            if len(words) <= 8:
                assert matched <= slow_common(index.vocabulary.read(template), index.vocabulary.read(text), 12, 28)
            if matched >= 0.8 * len(words):  # a longer notice that overlaps may stand for it
                assert any(f["matched_words"] >= matched for f in index.scan(text, 0.8, 8)), (name, v)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_notices_that_follow_each_other_are_all_found(name):
    index, words = licenses.Index(licenses.TEMPLATES), ["the", "zebra", "of"]
    n = len(index.vocabulary.learn(licenses.TEMPLATES[name]))
    for times in (1, 2, 3, 7, 20):
        for between in range(4):
            text = f" {' '.join(words[:between])} ".join([licenses.TEMPLATES[name]] * times)
            found = index.scan(text, 0.8, 8)
            assert [f["license"] for f in found] == [name] * times, (times, between)
            assert all(f["coverage"] == 1.0 and f["matched_words"] == n for f in found)


def test_a_long_text_of_notices_takes_seconds():
    import time

    index = licenses.Index(licenses.TEMPLATES)
    rng = random.Random(4)
    names = sorted(licenses.TEMPLATES)[:6]
    chosen = [rng.choice(names) for _ in range(15_000)]
    text = " plain ".join(licenses.TEMPLATES[n] for n in chosen)
    begun = time.process_time()
    assert [f["license"] for f in index.scan(text, 0.8, 8)] == chosen
    assert time.process_time() - begun < 60 and len(text) > 700_000
