
import public_tokenizers as P
import tiktoken

from pyspark.sql import functions as F

import corpus_pipeline
from tallyline.llm import queries


def test_stages_keep_the_documents_columns_and_decide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, before = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.dtypes == docs.dtypes, name
        counts.append(after.count())
        before = after
    assert counts[0] > counts[1] > counts[2] == counts[3] >= counts[4]
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()}
    told = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=queries.rank_table().rank, special_tokens={})
    for r in before.collect():
        assert last[r.doc_id].ids == told.encode_ordinary(r.text) and last[r.doc_id].decodes
    assert len(last) == counts[-1]


def test_a_run_ends_in_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decodes"] and 0 < out.count() < 200


def test_registered_queries_read_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_token_counts", "op2_document_fingerprints", "op9_simhash"):
        assert queries.QUERIES[name](spark, sf_dir).count() == n


def test_stages_take_awkward_rows_and_any_column_names(spark, docs, no_docs, sf_dir):
    extra = {c: F.lit(i) for i, c in enumerate(("first id", "held items", "range", "before", "row", "node", "id", "hash", "component", "hits", "kept"))}
    before = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert sorted(after.dtypes) == sorted(before.dtypes), name
        told = after.select(*(f"`{c}`" for c in extra)).distinct().collect()
        assert len(told) <= 1 and all(list(r) == list(range(len(extra))) for r in told), name
        assert stage(spark, no_docs, sf_dir).count() == 0, name
        before = after if after.count() else before
    assert corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).count() == before.count()
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, sf_dir).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    from tallyline.llm import alike

    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (2, long + " x", "b"), (3, other, "c"), (3, long + " y", "d"), (None, long, "e"), (4, None, "f"), (5, "", "g"), (6, " ", "h")]
    kept = alike.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, mark string")).collect()
    assert sorted((r.doc_id or 0, r.mark) for r in kept) == [(0, "e"), (1, "a"), (3, "c"), (4, "f")]
