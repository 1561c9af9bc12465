"""Documents whose sets of shingles are alike, by exact Jaccard similarity of candidate pairs.

A set is its distinct shingles, whatever their number in the text. Equal sets are one row
throughout. Candidates agree on all rows of one of the bands of a MinHash signature and differ
in few of its bits; the sets of each candidate pair are then made from the two texts and compared.

Only pairs of sets that no links join yet matter. So a few rounds come first, in which all
members of a band meet one of them, another in each band and round: a dense group becomes one
component at a cost in proportion to its size. The pairs of a band that are still in different
components then meet once, bits compared inside the join, so that nothing is missed; of two
components the nearest sets are compared first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import components
from tallyline.llm.frames import dropped, fresh_path, stored
from tallyline.llm.simhash import near_duplicates, shingles

_PART = 1 << 15  # shingles hashed at a time, so that a very long text needs no more memory
_AT_ONCE = 1 << 10  # hashes that meet all rows at a time
_SEED = 42
#: One bit of each of so many MinHash rows. Two of 2,048 bits differ where the rows do, half the time:
#: 205 of them at a similarity of 0.8, and more than 263 with a chance of 2 in 100,000.
_BITS, _DIFFERING = 2048, 263
#: Rounds in which a band's members meet one of them.
_ROUNDS = 2
#: Sets of up to so many shingles are listed so many at a time, longer ones fewer.
_SHORT, _LISTED = 256, 64


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space parts words


def distinct_hashes(text: str, size: int) -> np.ndarray:
    words, out = words_of(text), []
    for at in range(0, max(1, len(words) - size + 1), _PART):
        out.append(np.unique(np.array(list(map(xxhash.xxh64_intdigest, shingles(words[at : at + _PART + size - 1], size), repeat(_SEED))), np.uint64)))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


class Signatures:
    """MinHash signatures: a key for each band of rows, and one bit of each of many more rows of 32 bits."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        random = np.random.default_rng(_SEED)
        self.of_bands = random.integers(0, 2**64, (2, bands * rows, 1), np.uint64)
        self.of_bits = random.integers(0, 2**32, (2, _BITS, 1), np.uint32)
        for draw in (self.of_bands, self.of_bits):
            draw[0] |= draw.dtype.type(1)

    @staticmethod
    def _least(hashes: np.ndarray, draw: np.ndarray, at_once: int) -> np.ndarray:
        least = np.full(draw.shape[1], np.iinfo(draw.dtype).max, draw.dtype)
        for at in range(0, len(hashes), at_once):
            np.minimum(least, (hashes[at : at + at_once] * draw[0] + draw[1]).min(axis=1), out=least)
        return least

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = self._least(hashes, self.of_bands, _AT_ONCE)
        keys = np.array([xxhash.xxh3_64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(self.bands, self.rows))], np.uint64)
        low = self._least((hashes >> np.uint64(16)).astype(np.uint32), self.of_bits, _AT_ONCE // 4)
        return keys, np.packbits((low >> np.uint32(4) & np.uint32(1)).astype(np.uint8)).view(np.uint64)


def set_prints(size: int, bands: int, rows: int):
    """A function of a text column: the node of its set, its signature's bits, the keys of its bands."""

    @F.arrow_udf("struct<node:long,bits:array<long>,keys:array<long>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        signatures = Signatures(bands, rows)
        for texts in batches:
            nodes, bits, keys = np.zeros(len(texts), np.uint64), np.zeros((len(texts), _BITS // 64), np.uint64), np.zeros((len(texts), bands), np.uint64)
            for i, t in enumerate(pc.fill_null(texts, "")):
                hashes = distinct_hashes(t.as_py(), size)
                nodes[i] = _node(hashes)
                keys[i], bits[i] = signatures.of(hashes)
            yield pa.StructArray.from_arrays([pa.array(nodes.view(np.int64)), _listed(bits), _listed(keys)], ["node", "bits", "keys"])

    return found


def _listed(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel().view(np.int64)))


def set_nodes(size: int):
    @F.arrow_udf("long")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([_node(distinct_hashes(t.as_py(), size)) for t in pc.fill_null(texts, "")], np.uint64).view(np.int64))

    return found


def are_alike(size: int, least: float):
    """A function of two text columns: whether the Jaccard similarity of their sets is `least` or more."""

    @F.arrow_udf("boolean")
    def decided(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, held = None, None
        for xs, ys in batches:
            out = []
            for x, y in zip(xs, ys):
                if held is None or y.as_py() != last:
                    last = y.as_py()
                    held = set(shingles(words_of(last), size))
                own = set(shingles(words_of(x.as_py()), size))
                both = len(own & held)
                total = len(own) + len(held) - both
                out.append(not total or both / total >= least)
            yield pa.array(out, pa.bool_())

    return decided


def _apart(a: str, b: str) -> Column:
    """Differing bits of two signatures."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(_BITS // 64)), F.lit(0))


def _listed_hashes(size: int):
    @F.arrow_udf("array<long>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [distinct_hashes(t.as_py(), size) for t in pc.fill_null(texts, "")]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)))

    return found


def _links_of_pieces(least: float):
    """Of the sets of two lists: links that join all components that pairs so alike join, one for each step."""

    def side(batch: pa.RecordBatch, name: str, i: int):
        nodes, labels, bits, hashes = (batch.column(f"{c}_{name}")[i].values for c in ("nodes", "labels", "bits", "hashes"))
        sets = [h.values.to_numpy() for h in hashes]
        return nodes.to_numpy(), labels.to_numpy(), bits.flatten().to_numpy().view(np.uint64).reshape(len(nodes), -1), sets

    def both(x: np.ndarray, y: np.ndarray) -> int:
        return len(x) + len(y) - len(np.union1d(x, y))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                nodes, labels, bits, sets = side(batch, "a", i)
                others, their, their_bits, their_sets = side(batch, "b", i)
                apart = np.bitwise_count(bits[:, None] ^ their_bits[None]).sum(axis=2, dtype=np.int32)
                at = np.argwhere((apart <= _DIFFERING) & (labels[:, None] != their[None]))
                root = {}

                def top(c, root=root):
                    while root.get(c, c) != c:
                        c = root[c]
                    return c

                for j, k in at[np.argsort(apart[at[:, 0], at[:, 1]], kind="stable")]:
                    p, q = top(labels[j]), top(their[k])
                    if p == q:
                        continue
                    common = both(sets[j], their_sets[k])
                    total = len(sets[j]) + len(their_sets[k]) - common
                    if not total or common / total >= least:
                        root[max(p, q)] = min(p, q)
                        out.append((nodes[j], others[k], *sorted((labels[j], their[k]))))
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "p", "q"])

    return found


def _pieces(members: DataFrame, contents: DataFrame, folder: str) -> DataFrame:
    """Rows of two lists of sets of one key, so that each two members of a key that may be alike and are
    in different components meet in one row.

    members: (key, n, node, component, length), n members with that key; contents: (node, bits, hashes).
    Sets are listed with those of about their length, so many that a list stays small; of two
    sets 0.8 alike the shorter has half the longer's length at least.
    """
    longer = F.ceil(F.log2(F.greatest(F.col("length"), F.lit(_SHORT)) / _SHORT)).cast("int")
    each = F.greatest(F.lit(1), F.lit(_LISTED) / F.pow(F.lit(2), "level")).cast("long")
    ordered = members.withColumn("level", longer).repartitionByRange("key", "level", "component", "node").sortWithinPartitions("key", "level", "component", "node")
    # written before they are grouped: the numbers are given once
    numbered = stored(ordered.select("key", "n", "level", "node", "component", F.floor(F.monotonically_increasing_id() / each).alias("no")), "lists", folder)
    lists = numbered.join(contents, "node").groupBy("key", "n", "level", "no").agg(
        F.collect_list(F.struct("node", "component", "bits", "hashes")).alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    salts = F.least(F.ceil(F.col("n") / (16 * _LISTED)), F.lit(16)).cast("int")
    lists = stored(lists.select("key", "level", "no", "low", "high", salts.alias("salts"), *(F.col(f"m.{c}").alias(n) for c, n in (("node", "nodes"), ("component", "labels"), ("bits", "bits"), ("hashes", "hashes")))), "blocks", folder)
    x, y = (lists.select("key", *(F.col(c).alias(f"{c}_{n}") for c in lists.columns if c != "key")) for n in "ab")
    x = x.withColumn("salt", F.pmod("no_a", "salts_a").cast("int"))
    y = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts_b") - 1)))
    ahead = (F.col("level_a") < F.col("level_b")) | ((F.col("level_a") == F.col("level_b")) & (F.col("no_a") <= F.col("no_b")))
    apart = (F.least("low_a", "low_b") < F.greatest("high_a", "high_b")) & (F.col("level_b") - F.col("level_a") <= 1)
    met = x.join(y, (x["key"] == y["key"]) & (x["salt"] == y["salt"]) & ahead & apart)
    return met.select(*(f"{c}_{n}" for n in "ab" for c in ("nodes", "labels", "bits", "hashes")))


def alike_components(classes: DataFrame, texts: DataFrame, size: int, least: float, rounds: int = _ROUNDS, near: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """(node, component) of the sets that share a band with others: the smallest node that pairs of sets so alike reach.

    classes: a row (node, bits, keys) for each set; texts: rows (node, text), of one set any number;
    near: pairs (a, b) of sets that were found near each other otherwise, to be compared first.
    Tables on the way are stored below folder; the result reads one of them.
    """
    spark = classes.sparkSession
    folder = folder or fresh_path(spark, "alike")
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    held = stored(keyed.join(shared, "key"), "bands", folder)
    several = held.select("node")
    if near is not None:
        several = several.unionByName(near.select(F.explode(F.array("a", "b")).alias("node")))
    several = stored(several.distinct(), "members", folder)
    one_text = stored(texts.groupBy("node").agg(F.first(F.coalesce("text", F.lit(""))).alias("text")).join(several, "node", "left_semi"), "texts", folder)
    bits = stored(classes.select("node", "bits").join(several, "node", "left_semi"), "bits", folder)
    side = lambda df, node, column, name: df.select(F.col("node").alias(node), F.col(column).alias(name))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(one_text, "a", "text", "ta"), "a").join(side(one_text, "b", "text", "tb"), "b")
        return both.select("a", "b", are_alike(size, least)("ta", "tb").alias("close")).where("close").select("a", "b")

    def joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """The labels after pairs that are alike have made components one."""
        met = verified(pairs).join(side(labels, "a", "component", "of_a"), "a").join(side(labels, "b", "component", "of_b"), "b")
        roots = components(met.where("of_a <> of_b").select("of_a", "of_b"), "of_a", "of_b", folder=folder)
        moved = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
        return stored(labels.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels", folder)

    labels = several.withColumn("component", F.col("node"))
    if near is not None:
        labels = joined(labels, near)
    for r in range(rounds):
        placed = held.join(labels, "node")
        met = placed.groupBy("key").agg(F.max_by(F.struct("node", "component"), F.xxhash64("node", "key", F.lit(r))).alias("met"), F.min("component").alias("x"), F.max("component").alias("y"))
        met = met.where("x < y").select("key", F.col("met.node").alias("b"), F.col("met.component").alias("of_b"))
        pairs = placed.join(met, "key").where("component <> of_b").select(F.col("node").alias("a"), "b").distinct()
        close = pairs.join(side(bits, "a", "bits", "xa"), "a").join(side(bits, "b", "bits", "xb"), "b").select("a", "b", _apart("xa", "xb").alias("apart"))
        # of those that a set meets in a round, the nearest is compared; no link is lost, as all pairs left meet below
        labels = joined(labels, close.where(F.col("apart") <= _DIFFERING).groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")))
    placed = held.join(labels, "node")
    open_ = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("key", "n")
    left = stored(placed.join(open_, "key"), "open", folder)
    hashes = one_text.join(left.select("node").distinct(), "node", "left_semi").select("node", _listed_hashes(size)("text").alias("hashes"))
    listed = f"{folder}/listed"  # the largest tables, which nothing reads after the links
    contents = stored(bits.join(hashes, "node"), "contents", listed)
    members = left.join(contents.select("node", F.size("hashes").alias("length")), "node")
    links = stored(_pieces(members, contents, listed).mapInArrow(_links_of_pieces(least), "a long, b long, p long, q long"), "links", folder)
    dropped(spark, listed)
    # one pair of two components is enough; all that are given are alike
    return joined(labels, links.groupBy("p", "q").agg(F.min(F.struct("a", "b")).alias("n")).select("n.a", "n.b"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8, bands: int = 20, rows: int = 4) -> DataFrame:
    """The rows of df, all of its columns, that are first of their group: the smallest doc_id.

    Groups are joined by pairs of documents whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more, counted exactly; nothing less alike is a link. Candidates are what
    simhash.near_duplicates reaches, and by MinHash a pair of similarity s with a chance of
    1 - (1 - s**rows)**bands: all but 5 in 100,000 at 0.8, those lost by their bits included, and
    surer above. A shorter text is one shingle;
    null texts and those without words are equal. Of repeated rows of one id and text one stays,
    of rows of one id with different texts each is a document of its own, the smaller text hash
    first. Rows without id are no group's first and all stay. Columns keep their names, whatever
    these are. An empty table gives an empty table.
    """
    packed = df.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"), F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"))
    folder = fresh_path(df.sparkSession, "alike")
    prints = packed.select("id", "hash", set_prints(size, bands, rows)("text").alias("p")).select(F.when(F.col("id").isNotNull(), F.struct("id", "hash")).alias("named"), "p.*")
    classes = stored(prints.groupBy("node").agg(F.min("named").alias("first"), F.first("bits").alias("bits"), F.first("keys").alias("keys")), "sets", folder)
    texts = packed.select(set_nodes(size)("text").alias("node"), "text")
    reached = near_duplicates(texts, "node").select(F.col("node").alias("a"), F.col("component_id").alias("b")).where("a <> b").distinct()
    found = alike_components(classes, texts, size, least, near=stored(reached, "near", folder), folder=folder)
    grouped = classes.select("node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = grouped.groupBy("component").agg(F.min("first").alias("first")).where("first is not null").select("first.*")
    first = stored(first, "firsts")
    dropped(df.sparkSession, folder)  # what comes after reads the ids and hashes of the firsts only
    kept = packed.where("id is not null").join(first, ["id", "hash"], "left_semi")
    kept = kept.groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*").unionByName(packed.where("id is null").select("row.*"))
