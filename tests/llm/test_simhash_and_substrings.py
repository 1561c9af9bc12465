import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyline.llm import simhash, substrings
from tallyline.llm.components import components

from .conftest import prose


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    more = [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)]
    links = chain + star + more + [(400, 400), (5, 5), (401, 400), (7, 6)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    want = union({n for x in links for n in x}, links)
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == want
    assert components(df.limit(0), "a", "b").count() == 0


def near_texts():
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        base = prose(rng, 150).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy))
    return texts


def test_components_equal_brute_force(spark, rows, no_docs):
    given = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(near_texts())]
    df = spark.createDataFrame([(*g, 1) for g in given], "doc_id long, text string, fp int").repartition(4)
    prints = {t: plain_print(t) for _, t in given}
    values = sorted(set(prints.values()))
    group = union(values, [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in given:
        if i is not None:
            g = group[prints[t]]
            least[g] = min(least.get(g, i), i)
    want = sorted(((i, prints[t], least.get(group[prints[t]])) for i, t in given), key=repr)
    for blocks, agree in ((5, 2), (4, 1)):
        got = simhash.near_duplicates(df, blocks=blocks, agree=agree).collect()
        assert sorted(((r.doc_id, r.fp[0] % 2**64, r.component_id) for r in got), key=repr) == want
    assert len(set(least.values())) < len(values)  # some are linked
    assert simhash.near_duplicates(no_docs).count() == 0


def test_a_large_group_of_near_prints_gives_few_links(spark):
    rng = random.Random(2)
    prints = {0x1234567890ABCDEF ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)}
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    df = spark.createDataFrame([(p, [p]) for p in signed], "node long, fp array<long>")
    links = simhash.close_links(df, 1, 5, 2, 3).collect()
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3]
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in links)
    assert union(signed, [(r.a, r.b) for r in links]) == union(signed, pairs)


def test_copies_of_0_8_or_more_are_found(spark):
    texts = near_texts() + [None, "", "  "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "kept", "y")], "doc_id long, text string, component string")
    sets = [set(simhash.shingles((t or "").encode().lower().split(), 5)) for t in texts]
    kept = simhash.one_of_each(df).collect()
    ids = {r.doc_id for r in kept}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] | sets[b] else 1.0
    first = list(range(len(texts)))
    for j in range(len(texts)):  # links in rising order of both ends until nothing changes
        for i in range(j):
            if alike(i, j) >= 0.8:
                a, b = sorted((first[i], first[j]))
                first = [a if f == b else f for f in first]
    assert ids - {None} == set(first) and len(texts) - len(set(first)) > 20
    assert None in ids and simhash.one_of_each(df).columns == df.columns


def plain_cut(rows, size=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[j : j + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j : j + size])] < i:
                gone.update(range(j, j + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [9, 20])
def test_cuts_equal_brute_force_whatever_the_sketch(docs, no_docs, rows, bits):
    got = substrings.without_repeats(docs.withColumn("lost", F.lit(1)), bits=bits).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_cut([(r[0], r[1]) for r in rows])
    assert substrings.without_repeats(no_docs, bits=bits).count() == 0


def test_a_sketch_never_counts_too_low():
    import numpy as np

    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    sketch = substrings.Sketch(16, 2)
    sketch.add(h)
    sketch.add(h[:700])
    assert sketch.repeated(h[:700]).all() and sketch.repeated(rng.integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.6


def test_rows_keep_their_columns_when_passages_are_cut(docs, rows):
    got = substrings.cut(docs, bits=16)
    want = {(i, k) for i, _, n, k in plain_cut([(r[0], r[1]) for r in rows]) if n}
    out = got.collect()
    assert got.columns == docs.columns and len(out) == len(rows)
    assert {(r.doc_id, r.text) for r in out if r.n_chars == len(r.text or "") and (r.doc_id, r.text) in want} == want
    assert sum((r.doc_id, r.text) in {(x[0], x[1]) for x in rows} for r in out) == len(rows) - sum(1 for x in plain_cut([(r[0], r[1]) for r in rows]) if x[2])


def test_sets_decide_what_is_alike_however_often_a_line_repeats(spark):
    rng = random.Random(21)
    line = prose(rng, 10)
    base = prose(rng, 150)
    texts = [f"{prose(rng, 200)} {' '.join([line] * 20)}" for _ in range(6)]  # alike in one line only
    texts += [base, f"{base} {' '.join([line] * 15)}"]  # 0.9 alike
    texts += ["a b c d e f g h", "a b c d e f g h i", "one two", "One  two", "", None]  # 4 of 5 shingles; equal; without words
    for _ in range(60):  # all similarities between 0.6 and 1
        words = prose(rng, rng.randint(8, 120)).split()
        texts.append(" ".join(words))
        for _ in range(3):
            at = rng.randrange(len(words))
            texts.append(" ".join(words[: at + 1] + [prose(rng, rng.randint(1, 1 + len(words) // 20))] * rng.randint(0, 4) + words[at + rng.randint(1, 3) :]))
    sets = [set(simhash.shingles((t or "").encode().lower().split(), 5)) for t in texts]
    share = {(i, j): len(a & b) / len(a | b) if a | b else 1.0 for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j}
    group = union(range(len(texts)), [p for p, s in share.items() if s >= 0.8])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == set(group.values())
    assert sum(0.8 <= s < 0.85 for s in share.values()) > 5 and sum(0.7 < s < 0.8 for s in share.values()) > 5


def test_near_prints_are_compared_whatever_the_bands(spark):
    rng = random.Random(5)
    base = prose(rng, 900).split()
    texts = [" ".join(base), " ".join([*base[:-1], "another"]), " ".join(["another", *base[1:]]), prose(rng, 900)]
    prints = [plain_print(t) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= 3 for p in prints[:3]) and (prints[0] ^ prints[3]).bit_count() > 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.one_of_each(df, bands=1, rows=4000).collect()  # one band that only equal sets share
    assert sorted(r.doc_id for r in kept) == [0, 3]


def test_members_of_a_band_meet_in_lists_without_a_row_for_each_pair(spark):
    from tallyline.llm import alike

    rng = random.Random(8)
    base = prose(rng, 150).split()
    texts = [" ".join(base)]
    for _ in range(250):
        copy = list(base)
        for _ in range(rng.randint(1, 12)):
            copy[rng.randrange(len(copy))] = prose(rng, 1)
        texts.append(" ".join(copy))
    texts += [prose(rng, n) for n in (1, 300, 900, 5000)] + [prose(rng, 600) + " " + " ".join(base)]
    signatures = alike.Signatures(20, 4)
    sets = [alike.distinct_hashes(t, 5) for t in texts]
    rows = [(i, signatures.of(h)[1].view("int64").tolist(), h.view("int64").tolist()) for i, h in enumerate(sets)]
    contents = spark.createDataFrame(rows, "node long, bits array<long>, hashes array<long>").repartition(3)
    members = contents.select(F.lit(7).alias("key"), F.lit(len(texts)).alias("n"), "node", F.col("node").alias("component"), F.size("hashes").alias("length"))
    pieces = alike._pieces(members, contents)
    assert pieces.count() < 100 < len(texts) ** 2 / 600
    links = pieces.mapInArrow(alike._links_of_pieces(0.8), "a long, b long, p long, q long").collect()
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if share(sets[i].tolist(), sets[j].tolist()) >= 0.8]
    assert all(share(sets[r.a].tolist(), sets[r.b].tolist()) >= 0.8 for r in links) and len(links) < len(pairs) / 3
    assert union(range(len(texts)), [(r.a, r.b) for r in links]) == union(range(len(texts)), pairs)
