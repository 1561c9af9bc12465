"""Free-text descriptions to contract codes: learned alias, exact code, best score.

Work is done per distinct text, never per line. Texts that neither an alias nor a code
settles are packed into short lists, contract items into blocks, and the two are joined
on project and salt: a row of the join is a bounded piece of scoring (64 texts against
256 items by default), spread evenly over the tasks whatever the size of a project.
Each piece returns only its best few items, and a ranking keeps the best overall, so the
result is the same as scoring every item, without a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.config import Matching
from tallyline.functions.similarity import best_in_block
from tallyline.functions.text import normalize
from tallyline.operators.history import last_wins
from tallyline.operators.rollup import join_null_safe

CANDIDATE = "code string, description string, score double, field string"
LEVENSHTEIN = "levenshtein"
TEXTS_PER_PIECE = 64


def distinct_descriptions(feeds: Sequence[DataFrame], scope: Sequence[str] = ("project_id",), order: bool = False) -> DataFrame:
    """Every description once; with ``order`` also where it was first seen (feed, line)."""
    stacked = None
    for n, df in enumerate(feeds):
        seen = [F.struct(F.lit(n).alias("feed"), F.col("line_no").alias("line")).alias("seen")] if order else []
        one = df.select(*scope, "raw_desc", *seen)
        stacked = one if stacked is None else stacked.unionByName(one)
    if not order:
        return stacked.distinct()
    return stacked.groupBy(*scope, "raw_desc").agg(F.min("seen").alias("first_seen"))


def exact_codes(contract: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Contract items by normalised code; of several the first in contract order."""
    return (
        contract.withColumn("text_key", normalize(F.col("code")))
        .filter("text_key <> ''")
        .groupBy(*scope, "text_key")
        .agg(F.min_by(F.struct("code", "description"), F.col("line_no")).alias("hit"))
    )


def _pack(df: DataFrame, scope: Sequence[str], order: str, value: Column, name: str, size: int) -> DataFrame:
    """Rows of one scope gathered in lists of at most ``size``, evenly, without counting.

    Rows are range-partitioned and sorted, so runs of consecutive row ids are stable when
    a lost task is computed again.
    """
    run = F.floor(F.monotonically_increasing_id() / F.lit(size))
    return (
        df.repartitionByRange(*scope, order)
        .sortWithinPartitions(*scope, order)
        .select(*scope, value.alias("value"), run.alias(f"{name}_no"))
        .groupBy(*scope, f"{name}_no")
        .agg(F.collect_list("value").alias(name))
    )


def _pieces(texts: DataFrame, contract: DataFrame, scope: Sequence[str], matching: Matching) -> DataFrame:
    keys = _pack(texts.select(*scope, "text_key").distinct(), scope, "text_key", F.col("text_key"), "texts", TEXTS_PER_PIECE)
    item = F.struct(
        F.col("line_no").alias("item_no"),
        "code",
        "description",
        normalize(F.col("code")).alias("norm_code"),
        normalize(F.col("description")).alias("norm_desc"),
    )
    blocks = _pack(contract, scope, "line_no", item, "items", matching.block_items)
    salts = F.explode(F.sequence(F.lit(0), F.lit(matching.salts - 1)))
    left = keys.withColumn("salt", F.pmod(F.xxhash64("texts_no"), F.lit(matching.salts)).cast("int"))
    joined = left.join(blocks.withColumn("salt", salts), [*scope, "salt"])
    tasks = max(int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # An explicit number of tasks: the pieces are small in bytes but heavy in work, so
    # they must not be merged by size.
    return joined.repartition(tasks, *scope, "texts_no", "items_no").select(*scope, "texts", "items")


def score_candidates(texts: DataFrame, contract: DataFrame, scope: Sequence[str] = ("project_id",), matching: Matching = Matching()) -> DataFrame:
    """(scope, text_key, rank, code, description, score, field) of the best items per text."""
    pieces = _pieces(texts, contract, scope, matching)
    if matching.scorer == LEVENSHTEIN:
        found = _score_levenshtein(pieces, scope, matching.candidates)
    else:
        found = _score_pieces(pieces, scope, matching)
    order = Window.partitionBy(*scope, "text_key").orderBy(F.col("score").desc(), F.col("item_no").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= matching.candidates)


def _score_pieces(pieces: DataFrame, scope: Sequence[str], matching: Matching) -> DataFrame:
    scorer, keep = matching.scorer, matching.candidates
    types = dict(pieces.dtypes)
    item_no = pieces.schema["items"].dataType.elementType["item_no"].dataType.simpleString()
    schema = ", ".join(f"{k} {types[k]}" for k in scope) + (", " if scope else "")
    schema += f"text_key string, item_no {item_no}, code string, description string, score double, field string"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                items = list(row.items)
                codes = [i["norm_code"] for i in items]
                descriptions = [i["norm_desc"] for i in items]
                out = []
                for key, best in zip(row.texts, best_in_block(list(row.texts), codes, descriptions, scorer, keep)):
                    for at, points, on_code in best:
                        i = items[at]
                        out.append((*[getattr(row, k) for k in scope], key, i["item_no"], i["code"], i["description"],
                                    points, "code" if on_code else "description"))
                yield pd.DataFrame(out, columns=[*scope, "text_key", "item_no", "code", "description", "score", "field"])

    return pieces.mapInPandas(score, schema)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(100.0 * (1.0 - F.levenshtein(a, b) / longer))


def _score_levenshtein(pieces: DataFrame, scope: Sequence[str], keep: int) -> DataFrame:
    """The same ranking by edit distance, entirely in built-in expressions."""
    text = pieces.select(*scope, F.explode("texts").alias("text_key"), "items")

    def measured(i: Column) -> Column:
        return F.struct(i.alias("i"), levenshtein_ratio(F.col("text_key"), i["norm_code"]).alias("on_code"), levenshtein_ratio(F.col("text_key"), i["norm_desc"]).alias("on_desc"))

    def scored(m: Column) -> Column:
        return F.struct(
            (-F.greatest(m["on_code"], m["on_desc"])).alias("neg"),
            m["i"]["item_no"].alias("item_no"),
            m["i"]["code"].alias("code"),
            m["i"]["description"].alias("description"),
            F.when(m["on_code"] >= m["on_desc"], "code").otherwise("description").alias("field"),
        )

    best = F.slice(F.array_sort(F.transform(F.transform("items", measured), scored)), 1, keep)
    return text.select(*scope, "text_key", F.explode_outer(best).alias("c")).filter("c is not null").select(
        *scope, "text_key", "c.item_no", "c.code", "c.description", (-F.col("c.neg")).alias("score"), "c.field"
    )


def settled(descriptions: DataFrame, contract: DataFrame, aliases: DataFrame | None = None, *, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """Distinct raw descriptions with what settles them without any scoring: a learned alias
    (alias_code), else an item of exactly that code (hit)."""
    texts = descriptions.select(*scope, "raw_desc").distinct().withColumn("text_key", normalize(F.col("raw_desc")))
    if aliases is not None:
        texts = texts.join(aliases.select(F.col("normalized_desc").alias("text_key"), F.col("code").alias("alias_code")), "text_key", "left")
    else:
        texts = texts.withColumn("alias_code", F.lit(None).cast("string"))
    return join_null_safe(texts, exact_codes(contract, scope), [*scope, "text_key"], "left")


def resolve(
    descriptions: DataFrame,
    contract: DataFrame,
    aliases: DataFrame | None = None,
    *,
    scope: Sequence[str] = ("project_id",),
    matching: Matching = Matching(),
) -> DataFrame:
    """Match per distinct raw description: code (null if it needs review), score, kind
    (alias, code, auto, review) and the best candidates."""
    none = F.array().cast(f"array<struct<{_ddl(CANDIDATE)}>>")
    texts = settled(descriptions, contract, aliases, scope=scope)

    open_texts = texts.filter("alias_code is null and hit is null")
    ranked = score_candidates(open_texts, contract, scope, matching).groupBy(*scope, "text_key").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "code", "description", "score", "field"))),
            lambda c: F.struct(c["code"].alias("code"), c["description"].alias("description"), c["score"].alias("score"), c["field"].alias("field")),
        ).alias("found")
    )
    joined = join_null_safe(texts, ranked, [*scope, "text_key"], "left")
    best = F.try_element_at("found", F.lit(1))
    by_alias, by_code = F.col("alias_code").isNotNull(), F.col("hit").isNotNull()
    auto = best["score"] >= matching.auto_score
    exact = F.array(F.struct(F.col("hit.code").alias("code"), F.col("hit.description").alias("description"), F.lit(100.0).alias("score"), F.lit("code").alias("field")))
    return joined.select(
        *scope,
        "raw_desc",
        "text_key",
        F.when(by_alias, F.col("alias_code")).when(by_code, F.col("hit.code")).when(auto, best["code"]).alias("code"),
        F.when(by_alias | by_code, 100.0).otherwise(F.coalesce(best["score"], F.lit(0.0))).alias("score"),
        F.when(by_alias, "alias").when(by_code, "code").when(auto, "auto").otherwise("review").alias("kind"),
        F.when(by_alias, none).when(by_code, exact).otherwise(F.coalesce("found", none)).alias("candidates"),
    )


def _ddl(columns: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (c.split() for c in columns.split(", ")))


def suggestion(matching: Matching = Matching()) -> Column:
    """The code to propose for a text under review; null proposes not-in-contract."""
    best = F.try_element_at("candidates", F.lit(1))
    return F.when(best["score"] >= matching.suggest_score, best["code"])


# --- session decisions -------------------------------------------------------
def fold_decisions(events: DataFrame, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """Last word per description from a log of ``map``, ``nic`` and ``reopen`` events."""
    state = last_wins(events.select(*scope, "raw_desc", "seq", "event", "code"), [*scope, "raw_desc"], F.col("seq"))
    return state.filter("event <> 'reopen'").select(
        *scope,
        "raw_desc",
        F.when(F.col("event") == "map", F.col("code")).alias("mapped_code"),
        (F.col("event") == "nic").alias("not_in_contract"),
    )


def decision_aliases(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the decisions teach: (texts to learn, texts to forget), over all projects."""
    keyed = events.withColumn("normalized_desc", normalize(F.col("raw_desc"))).filter("event in ('map', 'reopen')")
    last = last_wins(keyed.select("normalized_desc", "seq", "event", "code"), ["normalized_desc"], F.col("seq"))
    return last.filter("event = 'map'").select("normalized_desc", "code"), last.filter("event = 'reopen'").select("normalized_desc")


def triage(matches: DataFrame, decisions: DataFrame, scope: Sequence[str] = ("project_id",), matching: Matching = Matching()) -> DataFrame:
    """Bucket of every description (not in contract, confirmed, automatic, review) and
    the code its lines get."""
    joined = join_null_safe(matches, decisions, [*scope, "raw_desc"], "left")
    not_in = F.coalesce("not_in_contract", F.lit(False))
    mapped = F.col("mapped_code").isNotNull()
    return joined.select(
        *scope,
        "raw_desc",
        F.when(not_in, "not in contract").when(mapped, "confirmed").when(F.col("code").isNotNull(), F.col("kind")).otherwise("review").alias("bucket"),
        F.when(~not_in, F.coalesce("mapped_code", "code")).alias("final_code"),
        "score",
        suggestion(matching).alias("suggested_code"),
        "candidates",
    )


def review_queue(triaged: DataFrame) -> DataFrame:
    return triaged.filter("bucket = 'review'")


def apply_codes(lines: DataFrame, triaged: DataFrame, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """Write the final code onto lines. For whole cycles prefer to roll lines up by
    description first (see ``plans.cycle``), which leaves far fewer rows to join."""
    codes = triaged.select(*scope, "raw_desc", "final_code")
    return join_null_safe(lines.drop("code"), codes, [*scope, "raw_desc"], "left").withColumnRenamed("final_code", "code")
