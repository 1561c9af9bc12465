"""Items of all comments added up per document and matched to the contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.config import Matching
from tallyline.functions.numbers import exact_sum
from tallyline.functions.text import normalize
from tallyline.operators.annotations import registry
from tallyline.operators.annotations.classify import is_excluded, of_each, token_events
from tallyline.operators.crosswalk import resolve
from tallyline.operators.rollup import join_null_safe

DOCUMENT = ("doc_id",)


def item_quantities(items: DataFrame, keys: Sequence[str] = DOCUMENT) -> DataFrame:
    """Quantity and number of entries per document and item."""
    return items.groupBy(*keys, "item").agg(exact_sum(F.col("amount") * F.col("copies")).alias("qty"), F.sum("copies").alias("n_records"))


def describe_items(quantities: DataFrame) -> DataFrame:
    key = F.col("item")
    return (
        quantities.withColumn("label", registry.label(key))
        .withColumn("uom", registry.unit(key))
        .withColumn("rate_code", registry.rate_code(key))
        .withColumn("qty", F.bround("qty", 1))
    )


def asbuilt_lines(
    quantities: DataFrame,
    contract: DataFrame | None = None,
    aliases: DataFrame | None = None,
    *,
    keys: Sequence[str] = DOCUMENT,
    scope: Sequence[str] = (),
    matching: Matching = Matching(),
) -> DataFrame:
    """As-built lines to be confirmed. The rate code is tried first, then the label;
    without a confident match the code stays empty for the crosswalk. With a contract the
    lines are persisted until the session ends, so that the comments are read once."""
    lines = describe_items(quantities).filter("qty <> 0")
    if contract is not None:
        lines = lines.persist()  # few rows after much reading, and used for the texts and for the lines
    if contract is None:
        coded = lines.withColumn("code", F.lit(None).cast("string"))
    else:
        texts = lines.select(*scope, F.explode(F.array_compact(F.array("rate_code", "label"))).alias("raw_desc"))
        codes = resolve(texts, contract, aliases, scope=scope, matching=matching).select(*scope, "raw_desc", "code")
        by_rate = codes.select(*scope, F.col("raw_desc").alias("rate_code"), F.col("code").alias("code_by_rate"))
        by_label = codes.select(*scope, F.col("raw_desc").alias("label"), F.col("code").alias("code_by_label"))
        coded = join_null_safe(join_null_safe(lines, by_rate, [*scope, "rate_code"], "left"), by_label, [*scope, "label"], "left")
        coded = coded.withColumn("code", F.coalesce("code_by_rate", "code_by_label"))
    plural = F.when(F.col("n_records") == 1, "").otherwise("s")
    return coded.select(
        *keys,
        *[s for s in scope if s not in keys],
        F.xxhash64(*keys, "item").alias("line_no"),
        F.col("label").alias("raw_desc"),
        "qty",
        "uom",
        F.lit(None).cast("string").alias("segment"),
        "code",
        F.lit(None).cast("string").alias("source_file"),
        F.concat(F.lit("annot:"), F.col("n_records"), F.lit(" record"), plural).alias("source_ref"),
        F.lit("annot").alias("confidence"),
        "item",
        "rate_code",
    )


def record_counts(split: DataFrame, events: DataFrame, keys: Sequence[str] = DOCUMENT) -> DataFrame:
    """Comments, excluded comments and unresolved tokens per document. Both come from the same
    grouped comments, which Spark computes once, and are added up in one grouping."""
    nothing = F.lit(0).cast("long")
    told = split.select(*keys, F.col("copies").alias("n_records"), F.when(is_excluded(), F.col("copies")).otherwise(nothing).alias("n_excluded"), nothing.alias("n_unresolved"))
    unread = events.filter(F.col("e.kind") == "unresolved").select(*keys, nothing.alias("n_records"), nothing.alias("n_excluded"), F.col("copies").alias("n_unresolved"))
    return told.unionByName(unread).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n_records", "n_excluded", "n_unresolved")))


def record_counts_of_each(annotations: DataFrame, keys: Sequence[str] = DOCUMENT) -> DataFrame:
    """:func:`record_counts` of comments as they come: what a distinct text counts is found once, and
    joined once to the comments that say it."""
    def read(texts: DataFrame) -> DataFrame:
        one = texts.withColumn("copies", F.lit(1).cast("long"))
        return record_counts(one, token_events(one), ("said",))

    needed = [c for c in annotations.columns if c in (*keys, "subtype", "text")]
    told = of_each(annotations.select(*needed), read)
    return told.groupBy(*keys).agg(*(F.sum(F.col(c) * F.col("copies")).alias(c) for c in ("n_records", "n_excluded", "n_unresolved")))


def _when(condition: Column, *parts) -> Column:
    return F.when(condition, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def ingest_warnings(counts: DataFrame, lines: DataFrame, has_contract: bool = True, keys: Sequence[str] = DOCUMENT) -> DataFrame:
    """What to tell the coordinator after reading a document's comments."""
    per_doc = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("code").isNull()).alias("n_unmatched"))
    c = F.col
    joined = counts.join(per_doc, list(keys), "left").fillna(0, ["n_lines", "n_unmatched"])
    if has_contract:
        first = _when(c("n_unmatched") > 0, c("n_unmatched"), " of ", c("n_lines"), " line(s) didn't match the bid schedule — resolve them in the Crosswalk step.")
    else:
        first = F.lit("No bid schedule loaded yet — load the Contract step first so quantities can be matched to contract codes.")
    return joined.withColumn(
        "warnings",
        F.array_compact(F.array(
            first,
            _when(c("n_excluded") > 0, c("n_excluded"), " span(s) marked “DID NOT BUILD” were excluded."),
            _when(c("n_unresolved") > 0, c("n_unresolved"),
                  " comment item(s) vary (conduit / pedestal / splice) and need manual entry — see the list below, then add them in the grid."),
        )),
    )
