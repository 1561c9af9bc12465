import golden
from tallyline.config import Matching
from tallyline.operators import crosswalk as xw
from tallyline.sources import learned
from tallyline.sources.tables import Store

ALIAS = "normalized_desc string, code string"
TEXTS = "project_id string, raw_desc string"


def kinds(spark, store, *texts):
    rows = spark.createDataFrame([("P1", t) for t in texts], TEXTS)
    current = learned.aliases(store).current()
    return {r.raw_desc: (r.code, r.kind) for r in xw.resolve(rows, golden.contract_df(spark), current, matching=Matching(salts=2)).collect()}


def test_an_alias_settles_the_next_job_and_stays_forgotten_after_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    table = learned.aliases(store)
    assert kinds(spark, store, "odd bore")["odd bore"][1] == "review"
    table.save(spark.createDataFrame([("odd bore", "4.1"), ("flag man", "9.1")], ALIAS), by="ann")
    assert kinds(spark, store, "Odd bore", "flag man") == {"Odd bore": ("4.1", "alias"), "flag man": ("9.1", "alias")}
    table.save(spark.createDataFrame([("odd bore", "3.1")], ALIAS), by="bob")
    table.delete(spark.createDataFrame([("flag man",)], "normalized_desc string"), by="bob")
    seen = kinds(spark, store, "odd bore", "flag man")
    assert seen["odd bore"] == ("3.1", "alias") and seen["flag man"][1] == "review"
    table.compact()
    folders = lambda: sorted(f.name for f in (tmp_path / "store" / "alias").iterdir())
    assert folders() == ["base=00000002"] and kinds(spark, store, "odd bore", "flag man") == seen
    table.compact()
    assert folders() == ["base=00000002"]
    assert table.save(spark.createDataFrame([("flag man", "5.1")], ALIAS)) == 3
    assert kinds(spark, store, "flag man")["flag man"] == ("5.1", "alias")
    said = [(r.actor, r.action, r.entity_id, r.detail["code"]) for r in table.audit().orderBy("ts", "entity_id").collect()]
    assert said == [("ann", "confirm", "flag man", "9.1"), ("ann", "confirm", "odd bore", "4.1"), ("bob", "confirm", "odd bore", "3.1"), ("bob", "forget", "flag man", None), ("reviewer", "confirm", "flag man", "5.1")]


def test_a_generation_said_again_says_the_same_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    table = learned.aliases(store)
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", None)], ALIAS)
    for _ in range(2):
        table.save(rows, generation=5)
    assert sorted((r.normalized_desc, r.code) for r in table.current().collect()) == [("a", "2"), ("b", None)]
    assert table.audit().count() == 2
    # a generation that was not finished is not read
    (tmp_path / "store" / "alias" / "generation=00000005" / "_SUCCESS").unlink()
    assert table.current().count() == 0


def test_decisions_teach_and_reopening_forgets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    log = spark.createDataFrame(
        [("P1", "Odd bore", 1, "map", "4.1"), ("P2", "Gone", 1, "map", "3.1"), ("P2", "Gone", 2, "reopen", None), ("P2", "None", 3, "nic", None)],
        "project_id string, raw_desc string, seq bigint, event string, code string")
    learned.learn(learned.aliases(store), log, "ann")
    assert [(r.normalized_desc, r.code, r.by) for r in learned.aliases(store).current().collect()] == [("odd bore", "4.1", "ann")]


def test_profiles_of_sheets(spark, tmp_path):
    table = learned.template_profiles(Store(spark, str(tmp_path / "store")))
    kind = "contractor string, header_row int, table_index int, columns map<string,int>"
    table.save(spark.createDataFrame([("C1", 2, None, {"qty": 3}), ("C2", 0, None, {"qty": 1})], kind))
    table.save(spark.createDataFrame([("C1", 4, None, {"qty": 0, "desc": 1})], kind))
    table.delete(spark.createDataFrame([("C2",)], "contractor string"))
    table.compact()
    assert [(r.contractor, r.header_row, r.columns) for r in table.current().collect()] == [("C1", 4, {"qty": 0, "desc": 1})]
    assert table.current().count() == 1 and table.audit().count() == 4
