from tallyline.llm import alike, components, substrings


def test_near_duplicates_leave_only_what_their_result_reads(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(alike, "fresh_path", lambda s, name: str(tmp_path / name))
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{long} {i % 7}", "m") for i in range(40)] + [(100 + i, f"{i} alone {i * i}", "n") for i in range(20)]
    kept = alike.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, mark string"))
    assert not (tmp_path / "alike").exists()  # sets, texts, bands, lists and blocks are gone before the rows are read
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(100, 120)]


def test_links_that_are_stars_already_need_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "_star", lambda edges, larger, star=components._star: rounds.append(larger) or star(edges, larger))
    stars = spark.createDataFrame([(1, 5), (6, 1), (2, 7), (2, 7), (3, 3), (None, 1)], "a long, b long")
    found = {r.node: r.component for r in components.components(stars, "a", "b").collect()}
    assert found == {1: 1, 5: 1, 6: 1, 2: 2, 7: 2, 3: 3} and not rounds
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert {r.component for r in components.components(chain, "a", "b").collect()} == {0} and rounds


def test_cut_moves_each_text_once(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"{passage}  kept  as it is", "a"), (2, f"x {passage} y", "b"), (None, passage, "c"), (3, None, "d")]
    spark.createDataFrame(rows, "doc_id long, text string, mark string").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    done = substrings.cut(df, bits=16)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    side = next(line for line in plan.splitlines() if " AS row#" in line)
    assert side.count("text#") == 1  # in the row only
    assert {r.mark: r.text for r in done.collect()} == {"a": rows[0][1], "b": "x y", "c": passage, "d": None}
