"""Filter interaction audit: what each filter removes at each place of every order of the filters.

Each document has a mask, one bit for each filter it fails. Documents are counted by part and
mask, so what is left of any table is at most 2**k cells a part. The subsets of filters are then
walked in Gray-code order: one filter is toggled at a time, every cell keeps the number of
active filters it fails, and the running survivors change only by the cells whose number leaves
or reaches zero. The survivors of all subsets are stored; each step of each order is a
difference of two of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import stored

#: The walk stores 2**k states and reports k! orders.
MOST_FILTERS = 7
_COUNTS = ("n", "good", "toxic")
_STEP = "array<struct<filter_order:string,step:int,kept:long,removed:long,redundant:long,unique_fails:long,good_lost:long,toxic_lost:long,shapley:long>>"


def walk(masks: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of the filters: a row for each subset, a column for each count.

    masks: the filters each cell fails, as bits; counts: what each cell holds, one row a cell.
    """
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    failing = np.zeros(len(masks), np.int64)
    alive = counts.sum(axis=0)
    states[0], active = alive, 0
    for i in range(1, 1 << filters):
        toggled = i & -i  # consecutive Gray codes differ in the lowest set bit of their number
        active ^= toggled
        hit = np.flatnonzero(masks & toggled)
        if active & toggled:
            alive = alive - counts[hit[failing[hit] == 0]].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            alive = alive + counts[hit[failing[hit] == 0]].sum(axis=0)
        states[active] = alive
    return states


def orders(names: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders of the filters; of each step the filter's place in names and the subset active before it."""
    steps = np.array(list(itertools.permutations(range(len(names)))), np.int64)
    bits = np.left_shift(1, steps)
    return ["".join(names[i] for i in order) for order in steps.tolist()], steps, np.cumsum(bits, axis=1) - bits


def _steps(names: str):
    """A function of a part's cells giving the report's rows."""
    k = len(names)

    @F.arrow_udf(_STEP)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        named, which, before = orders(names)
        shown, step, all_on = np.repeat(named, k), np.tile(np.arange(1, k + 1, dtype=np.int32), len(named)), (1 << k) - 1
        for parts in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for cells in parts:
                cells = cells.values
                masks, counts = cells.field("mask").to_numpy().astype(np.int64), np.stack([cells.field(c).to_numpy() for c in _COUNTS], axis=1)
                states = walk(masks, counts, k)
                gone = states[before] - states[before | np.left_shift(1, which)]
                fails = np.array([states[0, 0] - states[1 << i, 0] for i in range(k)])
                alone = np.array([states[all_on ^ 1 << i, 0] - states[all_on, 0] for i in range(k)])
                removed = gone[..., 0]
                credit = np.array([removed[which == i].sum() for i in range(k)])
                for column, value in zip(out, (states[before | np.left_shift(1, which), 0], removed, fails[which] - removed, alone[which], gone[..., 1], gone[..., 2], credit[which])):
                    column.append(value.ravel())
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
            rows = pa.StructArray.from_arrays(
                [pa.array(np.tile(shown, len(parts))), pa.array(np.tile(step, len(parts))), *map(pa.array, flat)],
                ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
            )
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) + 1, len(shown), dtype=np.int32)), rows)

    return found


def interactions(rows: DataFrame, filters: Mapping[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """One row for each part, order of the filters and step.

    filters: failure conditions by one-letter names; a null condition is no failure. A null part
    is the part of the empty string; good and toxic count where true. Counts are exact: rows of
    a hot part or mask are added up in each task before they move, and a part never has more
    than 2**k cells. An empty table gives an empty report.
    """
    names = "".join(filters)
    if len(names) != len(filters) or not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters with names of one letter, not {list(filters)}")
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    narrow = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), good.alias("good"), toxic.alias("toxic"))
    cells = narrow.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    walked = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("cells"))
    return walked.select("part", F.inline(_steps(names)(F.col("cells"))))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def with_copies(rows: DataFrame, key: str, doc_id: str, name: str) -> DataFrame:
    """Adds whether a row of smaller id has the same key.

    The first id of each key comes back by key and id together, so the rows of a key that a
    third of the table shares spread over all tasks. Rows without id are nobody's copy and
    nobody's original.
    """
    first = rows.groupBy(key).agg(F.min(doc_id).alias("first id")).where(F.col("first id").isNotNull())
    first = first.select(F.col(key).alias("first key"), "first id", F.lit(True).alias("is first"))
    joined = rows.join(first, (F.col(key) == F.col("first key")) & (F.col(doc_id) == F.col("first id")), "left")
    return joined.withColumn(name, F.col(doc_id).isNotNull() & F.col("is first").isNull()).drop("first key", "first id", "is first")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3, signs: str = "#$%&*|") -> DataFrame:
    """The interactions of five filters over whole texts, per part.

    A: under `least_words` words; B: distinct words under `least_distinct` per cent of the words;
    C: A-Z over `most_capitals` per cent of the code points; D: any of the signs; E: the same text
    as a smaller id, anywhere in the table. A null text is an empty one: it fails A, and E if an
    empty text came before. Repeated rows count each and are no copies of each other; rows
    without id have no label. Labels given several times count if any says so. Other columns
    play no part, whatever their names.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(doc_id).alias("id"), F.col(part).cast("string").alias("part"), whole.alias("text"), words(whole).alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = {
        "A": n < least_words,
        "B": distinct * 100 < n.cast("long") * least_distinct,
        "C": capitals.cast("long") * 100 > F.length("text").cast("long") * most_capitals,
        "D": F.length(F.translate("text", signs, "")) < F.length("text"),
    }
    seen = stored(read.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), *(c.alias(k) for k, c in flags.items())), "audited")
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    judged = with_copies(seen, "key", "id", "E").join(marks, F.col("id") == F.col("labelled"), "left")
    return interactions(judged, {k: F.col(k) for k in "ABCDE"}, F.col("part"), F.col("good"), F.col("toxic"))
