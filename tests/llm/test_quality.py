import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm import quality

from .conftest import prose


def labelled(spark, n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(20, 120))
        rows.append((i, text if good else text.replace(" ", "$$$ "), int(good)))
    return spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string").repartition(4), spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, quality int"), rows


def test_trees_go_down_as_a_plain_walk_does():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.grow(x, y, trees=40, depth=3)

    def walk(row):
        out = trees.start
        for column, threshold, leaf in zip(trees.column, trees.threshold, trees.leaf):
            k = 0
            while k < len(column):
                k = 2 * k + 1 + int(row[column[k]] > threshold[k])
            out += leaf[k - len(column)]
        return out

    assert np.allclose(trees.margin(x), [walk(r) for r in x])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


def test_held_out_rows_are_told_right_and_never_learned_from(spark):
    docs, labels, rows = labelled(spark)
    out = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in out.items() if r.held_out} == {r[0] for r in held} and len(held) > 50
    assert np.mean([out[i].predicted == g for i, _, g in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in out.values())
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.quality(docs, turned).collect()} == {i: r.score for i, r in out.items()}
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}


def test_any_rows_and_labels(spark, docs, no_docs, rows):
    none = spark.createDataFrame([(1, None), (None, 1), (4, 7)], "doc_id long, quality int")
    out = quality.quality(docs, none).collect()
    assert len(out) == len(rows) and {r.score for r in out} == {0.5}
    same = spark.createDataFrame([(1, 1), (4, 1), (7, 1)], "doc_id long, quality int")
    assert len({r.score for r in quality.quality(docs, same).collect()}) == 1
    assert quality.quality(no_docs, none).count() == 0
    assert quality.statistics("") == [0.0] * len(quality.STATISTICS) and len(quality.statistics("A b\n")) == len(quality.STATISTICS)
