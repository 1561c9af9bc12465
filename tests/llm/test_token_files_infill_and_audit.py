import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.fs
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm import filter_audit, infill, queries, token_files


# --- token files -------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(P.path(queries.WORD_TABLE))
    return lambda text: out.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_the_library(library, rows):
    encode, rng = queries.word_encoder(), random.Random(3)
    odd = ["a", "É", "é", "́", "'s", "'LL", " ", "\n", "\t", "\x1c", "\xa0", "1", "²", ",", ".", "!?", "#", "ß", "Σ", "ΑΣ", "ΣΑ", "İ", "ﬁ", "ñÑ", "字", "<|endoftext|>", "<|", "|>", "Word", "word,", "x" * 60]
    texts = [r[1] or "" for r in rows] + ["".join(rng.choices(odd, k=rng.randint(1, 14))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library(text), text


def test_files_of_another_kind_go_through_the_library_whole():
    encode = queries.word_encoder("byte_bpe_50k.json")
    told = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert not encode.by_words and queries.word_encoder().by_words
    for text in ("", "Two words, three", " é\n"):
        assert np.frombuffer(encode(text), "<u4").tolist() == told.encode(text, add_special_tokens=False).ids


def test_written_ids_come_back_in_order(spark, docs, rows, library, tmp_path):
    clash = docs.withColumn("key", F.lit("x")).withColumn("range", F.lit(1)).withColumn("ids", F.lit(2))
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(clash, path, queries.word_encoder(), end=2, ranges=3)
    read = token_files.tokens_of(spark, path).withColumn("crc", token_files.ids_crc32(F.col("ids"))).orderBy("start").collect()
    assert [r.key for r in read] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    at = 0
    for r in read:
        assert r.start == at and r.n_tokens == len(r.ids) and r.crc == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    wanted = sorted((r[0] is not None, r[0] or 0, library(r[1]) + [2]) for r in rows)
    assert sorted((r.key is not None, r.key or 0, r.ids) for r in read) == wanted
    some = token_files.tokens_of(spark, path, F.col("key") == 100)
    assert [r.ids for r in some.collect()] == [library(next(x[1] for x in rows if x[0] == 100)) + [2]]
    plan = some._jdf.queryExecution().toString()
    assert "EqualTo(key,100)" in plan
    assert "ids:array" in plan and "ids:array" not in token_files.metadata(spark, path)._jdf.queryExecution().toString()


def test_files_have_the_encodings_and_indexes(spark, docs, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(docs, path, queries.word_encoder(), end=2, ranges=2)
    files = [f.path for f in pyarrow.fs.LocalFileSystem().get_file_info(pyarrow.fs.FileSelector(f"{tmp_path}/t/tokens")) if f.path.endswith(".parquet")]
    assert len(files) == 2
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        for i in range(group.num_columns):
            column = group.column(i)
            assert column.has_offset_index and column.has_column_index, column.path_in_schema
            assert ("RLE_DICTIONARY" if column.path_in_schema.startswith("ids") else "DELTA_BINARY_PACKED") in column.encodings, column


def test_nothing_to_write(spark, no_docs, tmp_path):
    token_files.write_tokens(no_docs, f"file://{tmp_path}/t", queries.word_encoder(), end=2)
    assert token_files.tokens_of(spark, f"file://{tmp_path}/t").count() == 0


# --- fill in the middle ------------------------------------------------------
def units(text: str, unit: str) -> list[str]:
    """Plainly: the text cut before every character that begins a unit."""
    out: list[str] = []
    for i, c in enumerate(text):
        before = text[i - 1] if i else "\n"
        white = lambda x: x in " \t\n\v\f\r"
        begins = i == 0 or unit == "char" or (unit == "line" and before == "\n") or (unit == "word" and white(before) and not white(c))
        out = [*out, c] if begins else [*out[:-1], out[-1] + c]
    return out


def test_ranks_equal_counting():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(0, 5, n).astype(np.uint8)
        matrix = infill.WaveletMatrix(codes)
        ends = np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, ends).tolist() == [int((codes[:e] == c).sum()) for e in ends]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_cuts_fall_where_units_end(spark, unit):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab é字\n\t😀 ", k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "  x", "\n\n", "<S> in it", "é" * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fim string").repartition(3)
    made = infill.fill_in_middle(df, unit=unit, share=100, suffix_first=50)
    out = {r.doc_id: r for r in made.select("doc_id", "fim.*", infill.restored(F.col("fim.output"), F.col("fim.form")).alias("back"), *(d.alias(f"h{i}") for i, d in enumerate(infill.draws(F.col("doc_id"))))).collect()}
    forms = set()
    for i, t in enumerate(texts):
        r, each = out[i], units(t or "", unit)
        a, b = sorted((r.h0 % (len(each) + 1), r.h1 % (len(each) + 1)))
        p, m, s = "".join(each[:a]), "".join(each[a:b]), "".join(each[b:])
        form = "plain" if not t or "<S>" in t else "spm" if r.h3 % 100 < 50 else "psm"
        shown = {"plain": t or "", "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output, r.back) == (len(each), form, shown, t or "")
        assert (r.prefix_units, r.middle_units) == ((None, None) if form == "plain" else (a, b - a))
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}


def test_infill_of_awkward_rows(spark, docs, rows, no_docs):
    made = infill.fill_in_middle(docs).select("doc_id", "text", "lang", "n_chars", "fim.*", infill.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(made) == len(rows) and all(r.back == (r.text or "") for r in made)
    assert len({r.output for r in made if r.doc_id is None and r.text}) == 1
    assert infill.fill_in_middle(no_docs).count() == 0


# --- filter audit ------------------------------------------------------------
def plainly(docs: list[tuple], labels: list[tuple], names: str, fails) -> dict:
    """Every order applied to every document."""
    masks = [(part, fails(i), good, toxic) for i, (part, good, toxic) in enumerate(docs)]
    out: dict = {}
    for order in itertools.permutations(names):
        left = masks
        for step, f in enumerate(order, 1):
            for part in {d[0] for d in docs}:
                own, gone = [m for m in masks if m[0] == part], [m for m in left if m[0] == part and f in m[1]]
                kept = sum(m[0] == part and f not in m[1] for m in left)
                fail = sum(f in m[1] for m in own)
                out[part, "".join(order), step] = [kept, len(gone), fail - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
            left = [m for m in left if f not in m[1]]
    for (part, order, step), row in out.items():
        row.append(sum(r[1] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1]))
    return out


def told(df) -> dict:
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_the_walk_stores_what_each_subset_leaves():
    rng = np.random.default_rng(1)
    for k in (1, 3, 5, 7):
        masks, counts = np.arange(1 << k), rng.integers(0, 9, (1 << k, 3))
        states = filter_audit.walk(masks, counts, k)
        for active in range(1 << k):
            assert states[active].tolist() == counts[masks & active == 0].sum(axis=0).tolist()


@pytest.mark.parametrize("names", ["A", "XYZ"])
def test_interactions_equal_applying_every_order(spark, names):
    rng = random.Random(9)
    docs = [(rng.choice("pq"), rng.random() < 0.4, rng.random() < 0.2, [rng.random() < 0.4 for _ in names]) for _ in range(200)]
    df = spark.createDataFrame(docs, "part string, good boolean, toxic boolean, bad array<boolean>").repartition(3)
    found = told(filter_audit.interactions(df, {n: F.col("bad")[i] for i, n in enumerate(names)}, F.col("part"), F.col("good"), F.col("toxic")))
    assert found == plainly([d[:3] for d in docs], [], names, lambda i: {n for n, b in zip(names, docs[i][3]) if b})


def test_audit_of_awkward_rows(spark, docs, rows, no_docs):
    labels = [(1, 0, 1), (1, 1, None), (100, 1, 0), (-5, None, 1), (None, 1, 1), (22, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts = [r[1] or "" for r in rows]

    def fails(i: int) -> set[str]:
        t = texts[i]
        words = [w for w in t.translate(dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")).split(" ") if w]
        own = rows[i][0]
        earlier = own is not None and any(r[0] is not None and r[0] < own and (r[1] or "") == t for r in rows)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in t for c in "#$%&*|"), earlier)
        return {n for n, bad in zip("ABCDE", tests) if bad}

    said = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    plain = [(r[2] or "", said(r[0], 1), said(r[0], 2)) for r in rows]
    clash = docs.withColumn("first id", F.lit(3)).withColumn("E", F.lit("x")).withColumn("key", F.lit(1)).withColumn("part", F.lit("z"))
    assert told(filter_audit.audit(clash, marks)) == plainly(plain, labels, "ABCDE", fails)
    assert filter_audit.audit(no_docs, marks).count() == 0
    with pytest.raises(ValueError):
        filter_audit.interactions(docs, {"AB": F.lit(True)}, F.col("lang"), F.lit(True), F.lit(True))
