"""Tokens of a comment to events, and the events of a comment to billable items.

Equal comments are one row with their number, tokens of one shape are read once, and what
depends on a token's neighbours (the open cable segment, a conduit size waiting for its
footage, explicit anchors, an overlash) is carried along the comment by windows over its
tokens: time grows with the tokens, however long a comment is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import literal_map, strip
from tallyline.operators.annotations import registry
from tallyline.operators.annotations import shorthand as sh

EVENT = ("kind", "item", "count", "size", "method", "amount")
#: Columns that are added to those of the comments.
OWN = ("copies", "tokens", "pos", "token", "e", "has_anchor", "first_olash", "own_olash", "all_spans", "waiting", "base_stated")


# --- tokens ------------------------------------------------------------------
def _free_text(annotations: DataFrame) -> DataFrame:
    if "subtype" not in annotations.columns:
        return annotations
    return annotations.filter(F.upper(F.coalesce("subtype", F.lit(""))).contains("FREETEXT"))


def of_each(annotations: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `read` makes of the comments' distinct texts, beside every comment that says them.

    read: from comments as :func:`comments` gives them, with the column `said` alone as key, to
    rows that keep it. Whatever the number of comments, a text is read once; `copies` are those of
    the comment. Comments without tokens, and those that `read` gives no row for, are left out.
    """
    # No text is null: Spark would write out each text twice, once to ask, in more code than the JVM compiles.
    source = _free_text(annotations).withColumn("text", F.coalesce("text", F.lit("")))
    told = read(comments(source.select("text"), repeated=True).withColumnRenamed("text", "said")).drop("copies")
    once = source.groupBy(*source.columns).agg(F.count(F.lit(1)).alias("copies"))
    return once.join(told, F.col("text") == F.col("said")).drop("text", "said")


def comments(annotations: DataFrame, *, repeated: bool = False) -> DataFrame:
    """Free-text comments with at least one token, split into tokens; `copies` tells how many rows were equal.

    Comments are grouped before anything is read from them, so that all tasks share the reading
    however few files they come from. Spark still leaves out comments before it groups them, and
    splits each row for that; where most rows are `repeated`, only what is grouped is split.
    """
    source = _free_text(annotations)
    cut = F.filter(F.transform(F.split(strip(F.coalesce("text", F.lit(""))), r"[\r\n]"), sh.tidy), lambda t: t != "")
    once = source.groupBy(*source.columns).agg(F.count(F.lit(1)).alias("copies"))
    if repeated:
        cut = F.when(F.col("copies") > 0, cut)  # always so, but known only after grouping
    return once.withColumn("tokens", cut).filter(F.size("tokens") > 0)


def is_excluded() -> Column:
    return sh.any_of(F.upper(F.array_join("tokens", " | ")), sh.EXCLUDING)


def excluded_comments(split: DataFrame) -> DataFrame:
    """Comments left out as a whole: duplicates and work not built."""
    return split.filter(is_excluded()).withColumn("text", F.array_join("tokens", " | ")).drop("tokens")


# --- reading one shape -------------------------------------------------------
def readings(shapes: DataFrame) -> DataFrame:
    """All that a token says on its own, for rows (shape); `r` is its event before the comment is known.

    Kinds that the comment settles: `bare` (a number alone), `placed` (footage on the open
    segment), `buried`, `tail`.
    """
    c = F.col
    out = shapes.withColumn("t", sh.canonical(c("shape"))).withColumn("counted", sh.counted(c("t")))
    out = out.withColumn("n", c("counted.n")).withColumn("b", F.when(c("counted.body") == c("t"), c("t")).otherwise(sh.canonical(c("counted.body"))))
    conduit = c("t").contains("BM60")
    out = out.withColumn("ft", sh.footage(c("t"))).withColumn("parts", F.when(conduit, sh.conduit_parts(c("t")))).withColumn("pipe", F.when(conduit, sh.conduit(c("parts"))))
    out = out.withColumn("method", sh.conduit_method(c("t")))
    cable = c("t").startswith("AFO") | c("t").startswith("BFO")
    opens = cable & c("t").rlike(sh.CABLE) & ~c("t").rlike(sh.NOT_A_HEADER)
    out = out.withColumn("opens", opens).withColumn("e", _classify())
    segment = F.struct(
        F.upper(sh.found(c("t"), sh.CABLE, 1)).alias("kind"), sh.found(c("t"), sh.CABLE, 2).try_cast("int").alias("count"),
        (c("t").contains("IE") & c("t").rlike(sh.EXISTING_DUCT)).alias("existing"),
    )
    single = conduit & (c("method") == "DP") & (F.coalesce(c("pipe.ways"), F.lit(1)) == 1)
    return out.select("shape", F.struct(
        c("e"), F.when(c("opens"), segment).alias("opened"), F.when(c("opens"), sh.marked_feet(c("t"))).alias("marked"),
        (c("t").contains("AFO.GAA") | c("t").contains("ANCHOR")).alias("anchor"), F.when(single, c("pipe.feet")).alias("base_feet"), c("b").endswith("'").alias("foot"),
    ).alias("r"))


def _event(kind: str, item: Column | str | None = None, amount: Column | float | None = None, count: Column | None = None,
           size: Column | None = None, method: Column | None = None) -> Column:
    def col(v, kind_):
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind_)

    return F.struct(
        F.lit(kind).alias("kind"), col(item, "string").alias("item"), col(count, "int").alias("count"), col(size, "string").alias("size"),
        col(method, "string").alias("method"), col(amount, "double").alias("amount"),
    )


def _classify() -> Column:
    """The event of a token; the first rule that fits decides."""
    t, b, n, ft = (F.col(c) for c in ("t", "b", "n", "ft"))
    ignored, review = _event("ignored"), _event("unresolved")
    run = sh.trailing(b)
    feet = F.coalesce(ft, run)
    run_feet = F.coalesce(F.nullif(ft, F.lit(0.0)), run)
    rated = F.coalesce(ft, F.lit(0.0))
    number = sh.to_number(sh.found(b, sh.BARE_NUMBER, 1))
    dims = F.concat_ws("x", sh.found(t, sh.DIMENSIONS, 1), sh.found(t, sh.DIMENSIONS, 2))
    vault = F.try_element_at(literal_map(sh.VAULT_BY_DIMENSIONS), dims)
    pipe, conduit = F.col("pipe"), t.contains("BM60")
    sizes = (pipe["ways"], pipe["size"], F.col("method"))

    aerial = (
        F.when(b.contains("COIL"), _event("item", "coil", 1.0))
        .when(sh.any_of(b, ("UP POLE", "DOWN POLE")), ignored)
        .when((b == "AFO.S") | b.startswith("AFO.S "), _event("item", "coil", F.when(n <= sh.COILS_UP_TO, n).otherwise(1.0)))
        .when(b.contains("RTD"), _event("item", "afo_rtd", rated))
    )
    for mark, item in registry.AERIAL_HARDWARE.items():
        aerial = aerial.when(b.contains(mark), _event("item", item, n))
    span = F.coalesce(feet, sh.to_number(sh.found(b, sh.BARE_SPAN)))
    aerial = aerial.when(span.isNotNull(), _event("span", None, span)).otherwise(ignored)

    conduit_feet = pipe["feet"]
    counted = F.lit(None)
    for mark, item in registry.COUNTED_CODES.items():
        counted = F.when(sh.starts_word(b, mark), F.lit(item)).otherwise(counted)
    drop_vault, pedestal = sh.squeezed(b, "./()-"), sh.squeezed(b, "()-")
    drop_vaults = sh.found(drop_vault, sh.DROP_VAULT).try_cast("double")

    return (
        F.when(t == "", ignored)
        .when(b.rlike(sh.BARE_NUMBER) & number.isNotNull(), _event("bare", None, number))
        .when((b.contains("/") & b.rlike(sh.DATE)) | (sh.any_of(t, sh.NOTE_HINTS) & ~conduit), _event("note"))
        .when(b.startswith("PM2A") | sh.starts_word(b, "PIPE") | b.rlike(sh.SEPARATOR), ignored)
        .when(t.contains("AFO.OLASH") | sh.starts_word(b, "OLASH"), _event("olash", "olash", ft))
        .when(t.contains("AFO.RELASH"), _event("item", "relash", rated))
        .when(sh.starts_word(b, "AFO"), aerial)
        .when(sh.starts_word(b, "BFO"), F.when(b.contains("RTD"), _event("item", "bfo_rtd", rated))
              .when(feet.isNotNull(), _event("buried", None, feet)).otherwise(ignored))
        .when(conduit, F.when(conduit_feet.isNotNull(), _event("conduit", None, conduit_feet, *sizes))
              .otherwise(_event("spec", None, None, *sizes)))
        .when(sh.starts_word(b, "PLOW", "BORE", "TRENCH", "DP", "DPD", "MB") & (run_feet != 0), _event("run", None, run_feet, method=sizes[2]))
        .when(b.startswith("HST"), F.when(t.rlike(sh.TERMINAL), _event("item", sh.tail_item(sh.found(t, sh.TERMINAL)), 1.0)).otherwise(review))
        .when(b.contains("RTD"), F.when(ft != 0, _event("tail", None, ft))
              .when(b.rlike(sh.TAIL_UNIT), _event("item", sh.tail_item(sh.found(b, sh.TAIL_UNIT)), 1.0)).otherwise(review))
        .when(sh.starts_word(b, "DG"), _event("guy", "down_guy", n))
        .when(b.contains("ANCHOR"), _event("item", "anchor", n))
        .when(b.startswith("BHF") & drop_vault.rlike(sh.DROP_VAULT), _event("item", "handhole_PH", F.coalesce(drop_vaults, n)))
        .when(b.startswith("BHF") & b.rlike(sh.VAULT),
              _event("item", F.concat(F.lit("handhole_"), F.regexp_extract(b, sh.VAULT, 1), F.regexp_extract(b, sh.VAULT, 2)), n))
        .when(b.startswith("BD") & pedestal.rlike(sh.PEDESTAL), _event("item", F.concat(F.lit("pedestal_"), sh.found(pedestal, sh.PEDESTAL)), n))
        .when(t.contains("X") & t.rlike(sh.DIMENSIONS),
              F.when(vault.isNotNull(), _event("item", F.concat(F.lit("handhole_"), vault), 1.0)).otherwise(review))
        .when(counted.isNotNull(), _event("item", counted, n))
        .when(sh.starts_word(b, "BM90"), _event("item", "tracer_wire", F.coalesce(run_feet, F.lit(0.0))))
        .when(b.contains("SPLICE"), review)
        .when(sh.starts_word(b, "TRAN1", "TRAN2", "TRANS1", "TRANS2"), _event("item", "transfer", n))
        .when(F.element_at(F.split(b, r"[\s\-:=]"), 1).isin(*sh.STATION_WORDS), ignored)
        .when((b == "") | b.rlike(sh.POSITION), ignored)
        .otherwise(review)
    )


# --- reading a comment -------------------------------------------------------
def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*OWN, "text")]


def _settled() -> Column:
    """The event of a token where it stands: what it says by itself (r), and the open segment (seg)."""
    e, seg = F.col("r.e"), F.col("seg")
    whole = lambda kind, item, amount, count=None: _event(kind, item, amount, count=count)
    suffix = F.when(seg["existing"], "IE").otherwise("I")
    known = seg["count"].isin(*registry.BURIED_COUNTS)
    buried = F.when(known, F.concat(F.lit("bfo_"), seg["count"].cast("string"), F.lit("_"), suffix)).otherwise(F.concat(F.lit("bfo_"), suffix))

    def placed(amount: Column) -> Column:
        """Footage on the open segment: aerial waits for the end of the comment."""
        return F.when(seg["kind"] == "B", whole("item", buried, amount)).otherwise(whole("span", None, amount, seg["count"]))

    # A bare number continues the open segment: footage with a foot mark or when it is small, else a station.
    continued = F.when(F.col("r.foot") | (e["amount"] < sh.FOOTAGE_BELOW), placed(e["amount"])).otherwise(_event("ignored"))
    alone = F.when(F.col("r.foot"), _event("unresolved")).otherwise(_event("ignored"))
    tail = F.when(seg["kind"] == "B", "bfo_rtd").otherwise("afo_rtd")
    return (
        F.when(F.col("header"), F.when(F.col("r.marked").isNotNull(), placed(F.col("r.marked"))).otherwise(_event("ignored")))
        .when(e["kind"] == "bare", F.when(seg.isNotNull(), continued).otherwise(alone))
        .when(e["kind"] == "buried", whole("item", buried, e["amount"]))
        .when(e["kind"] == "tail", whole("item", tail, e["amount"]))
        .when(e["kind"] == "span", whole("span", None, e["amount"], seg["count"]))
        .otherwise(e)
    )


def token_events(split: DataFrame) -> DataFrame:
    """One row per token: its comment's columns, copies, pos, token, event e, and what the comment says about it.

    A segment is opened by the first cable code of a comment, and later by one with a real
    fiber count (any other number there is a footage).
    """
    keys = [c for c in split.columns if c not in OWN]
    tokens = split.filter(~is_excluded()).select(*keys, "copies", F.posexplode("tokens").alias("pos", "token")).withColumn("s", sh.shape(F.col("token")))
    tokens = tokens.select(*keys, "copies", "pos", "token", F.col("s.shape").alias("shape"), F.col("s.feet").alias("set_apart"))
    read = tokens.join(readings(tokens.select("shape").distinct()), "shape").drop("shape")
    feet = F.col("set_apart")
    back = F.col("r")
    for name in ("marked", "base_feet"):
        back = back.withField(name, sh.put_back(F.col(f"r.{name}"), feet))
    read = read.withColumn("r", back.withField("e", F.col("r.e").withField("amount", sh.put_back(F.col("r.e.amount"), feet))))

    in_order = Window.partitionBy(*keys).orderBy("pos")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.col("r.opened")
    placed = read.withColumn("first_opened", F.min(F.when(opened.isNotNull(), F.col("pos"))).over(whole))
    placed = placed.withColumn("header", opened.isNotNull() & ((F.col("pos") == F.col("first_opened")) | opened["count"].isin(*sh.FIBER_COUNTS)))
    placed = placed.withColumn("header", F.coalesce("header", F.lit(False)))
    placed = placed.withColumn("seg", F.last(F.when(F.col("header"), opened), True).over(so_far)).withColumn("e", _settled())
    kind, amount = F.col("e.kind"), F.col("e.amount")
    step = F.when(kind.isin("spec", "conduit", "run"), F.struct(kind.alias("kind"), F.col("e.count").alias("count"), F.col("e.size").alias("size")))
    last_step = F.last(step, True).over(before)
    told = placed.withColumn("waiting", last_step).withColumn("waiting", F.when(F.col("waiting.kind") == "spec", F.col("waiting")))
    told = (
        told.withColumn("has_anchor", F.max("r.anchor").over(whole))
        .withColumn("first_olash", F.min(F.when(kind == "olash", F.col("pos"))).over(whole))
        .withColumn("own_olash", F.max(F.when((kind == "olash") & (amount != 0), F.struct("pos", amount.alias("amount")))).over(whole)["amount"])
        .withColumn("all_spans", F.sum(F.when(kind == "span", amount)).over(whole))
    )
    # footages of single-pipe bores that the comment states itself; the same rows by another order, not another shuffle
    told = told.withColumn("footage", F.coalesce("r.base_feet", amount))
    told = told.withColumn("base_stated", F.max(F.col("r.base_feet").isNotNull()).over(Window.partitionBy(*keys, "footage")))
    return told.select(*keys, "copies", "pos", "token", "e", "has_anchor", "first_olash", "own_olash", "all_spans", "waiting", "base_stated")


def _pair(item: Column | str, amount: Column) -> Column:
    return F.struct((item if isinstance(item, Column) else F.lit(item)).cast("string").alias("item"), amount.cast("double").alias("amount"))


def items(events: DataFrame) -> DataFrame:
    """Billable (item, amount) of every comment, for `copies` comments each; zero amounts are none.

    An overlash replaces the comment's placement: its own footage, else that of all spans. A
    down guy also bills an anchor unless the comment states one. A run takes its pipes from the
    size right before it, if that is unused; a bore of several pipes also bills the base bore,
    unless the comment wrote it out at that footage.
    """
    e = F.col("e")
    kind, amount, c = e["kind"], e["amount"], F.col
    none = F.array().cast("array<struct<item:string,amount:double>>")
    guy = F.when(c("has_anchor"), F.array(_pair("down_guy", amount))).otherwise(F.array(_pair("down_guy", amount), _pair("anchor", amount)))
    taken = F.when(kind == "run", c("waiting")).otherwise(F.struct(F.lit("conduit").alias("kind"), e["count"].alias("count"), e["size"].alias("size")))
    pipe = sh.conduit_item(taken["count"], taken["size"], e["method"])
    base = F.array(_pair(sh.conduit_item(F.lit(1), taken["size"], F.lit("DP")), amount))
    laid = F.concat(F.array(_pair(pipe, amount)), F.when(pipe.endswith("_DPD") & ~c("base_stated"), base).otherwise(none))
    billed = (
        F.when(kind == "item", F.array(_pair(e["item"], amount)))
        .when((kind == "olash") & (c("pos") == c("first_olash")), F.array(_pair("olash", F.coalesce("own_olash", "all_spans", F.lit(0.0)))))
        .when((kind == "span") & c("first_olash").isNull(), F.array(_pair(registry.strand_item(e["count"]), amount)))
        .when(kind == "guy", guy)
        .when(kind.isin("conduit", "run"), laid)
        .otherwise(none)
    )
    # Outer, so that Spark does not derive a filter that would evaluate all of it twice.
    return events.select(*_keys(events), "copies", F.inline_outer(billed)).filter("amount <> 0")


def _tokens_of(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("e.kind") == kind).select(*_keys(events), "copies", "pos", "token")


def notes(events: DataFrame) -> DataFrame:
    return _tokens_of(events, "note")


def unresolved(events: DataFrame) -> DataFrame:
    """Tokens nobody could classify: the review queue."""
    return _tokens_of(events, "unresolved")
