"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint bit is 1 where over half of a document's shingle hashes have it. Fingerprints
are cut into blocks; two that differ in at most d bits agree on at least blocks - d whole
blocks, so joining on every choice of that many blocks finds all close pairs, and the Hamming
distance of each pair found is counted.

Equal fingerprints are one row throughout. In a block that many share, all are first held
against the block's smallest fingerprint; those close to it are linked to it, and only pairs
with at least one of the others are looked at further. So a group of near copies gives links
in proportion to its size, and its component stays the same.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import components
from tallyline.llm.frames import settled

_PART = 1 << 15  # shingles hashed at a time, so that a very long text needs no more memory
_GOLDEN = 0x9E3779B97F4A7C15


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 further bits from hashes; the first are the hashes themselves."""
    if k == 0:
        return h
    h = h + np.uint64(k * _GOLDEN & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str, size: int, seed: int, lanes: int = 1) -> np.ndarray:
    """64 bits per lane of a whole text; zero where it has no word."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    total = max(1, len(words) - size + 1) if words else 0
    over = np.zeros(64 * lanes, np.int64)
    for at in range(0, total, _PART):
        part = shingles(words[at : at + _PART + size - 1], size) if total > _PART else shingles(words, size)
        h = np.array(list(map(xxhash.xxh64_intdigest, part, repeat(seed))), np.uint64)
        for k in range(lanes):
            bits = np.unpackbits(_mixed(h, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            own = over[64 * k : 64 * (k + 1)]
            for i in range(0, len(bits), 255):  # sums of 255 bits fit a byte, which numpy adds fastest
                own += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * over > total).view(">u8").astype(np.uint64)


def fingerprints(size: int = 3, seed: int = 42, lanes: int = 1):
    """A function of a text column giving its fingerprint as `lanes` longs."""

    @F.arrow_udf("array<long>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [fingerprint(t.as_py(), size, seed, lanes) for t in pc.fill_null(texts, "")]
            flat = np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, lanes, dtype=np.int32)), pa.array(flat))

    return found


def hex_digits(lane: Column) -> Column:
    return F.lower(F.lpad(F.hex(lane), 16, "0"))


def block_keys(bits: int, blocks: int, agree: int):
    """A function of a fingerprint column giving its keys, one for each choice of `agree` of the blocks."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    chosen = list(itertools.combinations(range(blocks), agree))

    @F.arrow_udf("array<struct<which:int,bits:long>>")
    def keyed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prints in batches:
            lanes = prints.values.to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(len(prints), -1)
            each = np.unpackbits(lanes, axis=1)
            one = [(np.packbits(each[:, a:b], axis=1), b - a) for a, b in zip(edges, edges[1:])]
            value = [np.ascontiguousarray(np.pad(p, ((0, 0), (8 - p.shape[1], 0)))).view(">u8").ravel().astype(np.uint64) >> np.uint64(-n % 8) for p, n in one]
            keys = np.zeros((len(prints), len(chosen)), np.uint64)
            for j, choice in enumerate(chosen):
                for c in choice:
                    keys[:, j] = (keys[:, j] << np.uint64(one[c][1])) | value[c]
            which = np.tile(np.arange(len(chosen), dtype=np.int32), len(prints))
            items = pa.StructArray.from_arrays([pa.array(which), pa.array(keys.ravel().view(np.int64))], ["which", "bits"])
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(which) + 1, len(chosen), dtype=np.int32)), items)

    return keyed


def distance(x: str, y: str, lanes: int) -> Column:
    """Differing bits of two fingerprints."""
    out = F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0]))
    for k in range(1, lanes):
        out = out + F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k]))
    return out


def close_links(prints: DataFrame, lanes: int, blocks: int, agree: int, most: int) -> DataFrame:
    """(a, b) of fingerprints at most `most` bits apart, enough to give the components that all such pairs give.

    prints: one row (node, fp) for each fingerprint; node is what links carry. No close pair is
    missed where blocks - agree >= most.
    """
    keyed = settled(prints.select("node", "fp", F.explode(block_keys(64 * lanes, blocks, agree)(F.col("fp"))).alias("key")).select("key.which", "key.bits", "node", "fp"))
    heads = keyed.groupBy("which", "bits").agg(F.min_by("fp", "node").alias("head_fp"), F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = settled(keyed.join(heads, ["which", "bits"]).withColumn("linked", distance("fp", "head_fp", lanes) <= most))
    stars = held.where("linked and node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    x = held.where("not linked").select("which", "bits", F.col("node").alias("a"), F.col("fp").alias("fa"))
    y = held.where("node != head").select("which", "bits", F.col("node").alias("b"), F.col("fp").alias("fb"), "linked")
    near = distance("fa", "fb", lanes) <= most
    rest = x.join(y, (x["which"] == y["which"]) & (x["bits"] == y["bits"]) & (F.col("linked") | (F.col("a") < F.col("b"))) & near).select("a", "b")
    return stars.unionByName(rest).distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", fp: str = "fp", component: str = "component_id", size: int = 3, seed: int = 42, lanes: int = 1, blocks: int = 5, agree: int = 2, most: int = 3) -> DataFrame:
    """(doc_id, fp, component): the smallest doc_id that links reach from a document, itself included.

    A null text, an empty one and one of white space only have fingerprint zero and link like
    any other. Documents without id belong to their fingerprint's group but never name one; a
    group of only such has a null component. Repeated rows come back as often as they were
    given. An empty table gives an empty result. Other columns of df play no part.
    """
    docs = settled(df.select(F.col(doc_id).alias("id"), fingerprints(size, seed, lanes)(F.col(text)).alias("fp")))
    classes = settled(docs.groupBy("fp").agg(F.min("id").alias("first")).withColumn("node", F.col("fp")[0] if lanes == 1 else F.xxhash64("fp")))
    prints = classes.select("node", "fp")
    found = components(close_links(prints, lanes, blocks, agree, most), "a", "b")
    named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    of_print = named.join(least, "component").select("fp", "least")
    return docs.join(of_print, "fp").select(F.col("id").alias(doc_id), F.col("fp").alias(fp), F.col("least").alias(component))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, **more) -> DataFrame:
    """As alike.one_of_each: the rows of df that are first of their group of texts with five-word shingles 0.8 alike."""
    from tallyline.llm import alike

    return alike.one_of_each(df, doc_id, text, size, **more)
