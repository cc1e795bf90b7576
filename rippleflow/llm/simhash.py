"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Of two fingerprints within three bits, one segment
differs by one bit at most; so each distinct fingerprint stands in a table under both of its
segments, and asks the table for the Hamming ball of radius one about each. Of two keys that
differ in one bit, exactly one has that bit unset: asking only with an unset bit set finds each
pair once and halves the ball. Every match is verified on all 64 bits.

Copies fall together before anything is joined. A table entry that many fingerprints share is
split further by multi-index hashing of the other segment, in two parts of 16 bits with their
own balls, so a hot entry is not compared pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from .components import components

WORDS, SEED, BITS = 3, 42, 3
#: Distinct fingerprints under one table entry from which on it is split.
HOT_ENTRY = 512
#: Rows of the list of hot entries up to which it is broadcast; beyond, it shuffles.
BROADCAST_ENTRIES = 200_000
_CHUNK = 200_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(offsets: np.ndarray, data: np.ndarray, width: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each row; zero without words."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    low = _LOWER[data]
    s, e, rows, inside = K.words(offsets, low)
    if not len(s):
        return out
    # words joined by single spaces: of the white space, the byte behind a word stays
    stay, behind = inside.copy(), e[e < len(low)]
    behind = behind[~inside[behind]]
    stay[behind] = True
    low[behind] = 32
    start = np.cumsum(stay)[s] - 1
    end = start + (e - s)
    raw = low[stay].tobytes()
    count = K.per_row(rows, n)
    first = np.cumsum(count) - count
    windows = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    a = K.ragged(first, windows)
    row = np.repeat(np.arange(n), windows)
    b = np.minimum(a + width - 1, (first + count - 1)[row])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[i:j], seed) for i, j in zip(start[a].tolist(), end[b].tolist())), np.uint64, len(a))
    return majority(row, h, n, windows)


def majority(rows: np.ndarray, h: np.ndarray, n: int, count: np.ndarray) -> np.ndarray:
    """A bit for each place of the hashes of a row: whether over half of the row's count have it set. Rows ascend."""
    total = np.zeros((n, 64), np.int64)
    for at in range(0, len(h), _CHUNK):
        part = slice(at, at + _CHUNK)
        bits = np.unpackbits(np.ascontiguousarray(h[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r = rows[part]
        head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        total[r[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    most = (2 * total > count[:, None]).astype(np.uint8)
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(df: DataFrame, keep: list[str], width: int = WORDS, seed: int = SEED) -> DataFrame:
    """Adds fp, the fingerprint as a signed long, to the columns keep."""

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        return {"fp": pa.array(fingerprints(offsets, data, width, seed).view(np.int64), pa.int64())}

    return K.map_text(K.cast_text(df, keep), kernel, "fp long", keep)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segment(fp: Column, at: int, size: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))


def _ball(key: Column, size: int, both: bool = False) -> Column:
    """Keys that differ from key in one bit: unset bits set, or (both) any bit turned."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: _turn(key, i, both))
    return turned if both else F.filter(turned, lambda k: k != key)


def _turn(key: Column, i: Column, both: bool) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), i)
    return key.bitwiseXOR(bit) if both else key.bitwiseOR(bit)


def _entries(nodes: DataFrame) -> DataFrame:
    """(key, fp) under both segments; key holds the segment's number above its bits."""
    keys = [_segment(F.col("fp"), 32 * j, 32).bitwiseOR(F.lit(j << 32).cast("long")) for j in range(2)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def _pairs(table: DataFrame, asked: DataFrame, on: list[str], bits: int) -> DataFrame:
    """Verified pairs of table entries that meet under a key, and of those that ask with those that stand there."""
    left = table.select(*on, F.col("fp").alias("a"))
    right = table.select(*on, F.col("fp").alias("b"), F.lit(True).alias("own")).unionByName(asked.select(*on, F.col("fp").alias("b"), F.lit(False).alias("own")))
    return left.join(right, on).where(_near("a", "b", bits) & (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b")))).select("a", "b")


def links(nodes: DataFrame, bits: int = BITS, hot_entry: int = HOT_ENTRY) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints (column fp) that differ in at most bits <= 3 bits."""
    if bits > 3:
        raise ValueError("two segments with balls of radius one find three bits at most")
    table = _entries(nodes)
    asked = table.select(F.explode(_ball(F.col("key"), 32)).alias("key"), "fp")
    hot = K.stored(table.groupBy("key").count().where(F.col("count") > hot_entry).select("key"))
    n = hot.count()
    if not n:
        return _pairs(table, asked, ["key"], bits)
    side = F.broadcast(hot) if n <= BROADCAST_ENTRIES else hot
    plain = _pairs(table.join(side, "key", "left_anti"), asked.join(side, "key", "left_anti"), ["key"], bits)
    # under a hot entry, the other segment's halves of 16 bits, again with balls of radius one
    other = F.when(F.col("key") < (1 << 32), F.lit(32)).otherwise(F.lit(0))
    rest = F.call_function("shiftrightunsigned", F.col("fp"), other).bitwiseAND(F.lit((1 << 32) - 1).cast("long"))

    def halves(df: DataFrame) -> DataFrame:
        one = [_segment(F.col("rest"), 16 * j, 16).bitwiseOR(F.lit(j << 16).cast("long")) for j in range(2)]
        return df.withColumn("rest", rest).select("key", "fp", F.explode(F.array(*one)).alias("half"))

    inner, outer = halves(table.join(side, "key", "left_semi")), halves(asked.join(side, "key", "left_semi"))
    near = F.concat(F.array("half"), _ball(F.col("half"), 16, both=True))
    split = _pairs(inner, inner.select("key", "fp", F.explode(_ball(F.col("half"), 16)).alias("half")), ["key", "half"], bits)
    across = _pairs_across(inner, outer.select("key", "fp", F.explode(near).alias("half")), bits)
    return plain.unionByName(split).unionByName(across)


def _pairs_across(table: DataFrame, asked: DataFrame, bits: int) -> DataFrame:
    left, right = table.select("key", "half", F.col("fp").alias("a")), asked.select("key", "half", F.col("fp").alias("b"))
    return left.join(right, ["key", "half"]).where(_near("a", "b", bits) & (F.col("a") != F.col("b"))).select("a", "b")


def near_duplicates(df: DataFrame, key: str = "doc_id", bits: int = BITS, hot_entry: int = HOT_ENTRY) -> DataFrame:
    """key, fp and component_id (the least key of all documents that links reach) of each document.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay.
    """
    docs = K.stored(fingerprint(df, [key]))
    nodes = K.stored(docs.groupBy("fp").agg(F.min(key).alias("least")))
    parts = components(links(nodes.select("fp"), bits, hot_entry), "a", "b")
    parts = K.stored(nodes.join(parts, nodes["fp"] == parts["node"]).select("fp", "root", "least"))
    roots = parts.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = parts.join(roots, "root").select("fp", "component_id")
    alone = nodes.join(parts.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return docs.join(linked.unionByName(alone), "fp").select(key, "fp", "component_id")


def judge(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    Null texts and texts without words have fingerprint zero. Repeated rows stay and share a component;
    a null doc_id is in a component like any other, but is its least only if all its ids are null. An
    empty table gives no rows.
    """
    return near_duplicates(df).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
