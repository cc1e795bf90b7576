"""Near copies by exact Jaccard similarity of five-word shingles, at least 0.8.

Each distinct set of shingles is a node. Candidates come from two indexes, and every one of them is
verified on the whole sets:

* SimHash fingerprints of the sets, linked by multi-index hashing (simhash.links). Three bits of 64
  are far less than sets of similarity 0.8 may differ in (some ten), so this finds close copies alone;
* min-wise bands: BANDS keys of ROWS minimal shingles each. Two sets share a key with probability
  1 - (1 - s ** ROWS) ** BANDS, where s is their similarity: at 0.8 a pair is missed once in
  eight million, above that more rarely still.

Sets that meet under a key are first compared with its hub alone, the same node under most keys
of a group, which joins the members of a large group at a cost linear in the entries.

Under the keys whose sets are not in one component yet, all links across components are found exactly:
let the shingles of these sets be ordered by the number of sets that have them, rarest first. What
stands ahead of the first common shingle is in one set alone, so of two sets of similarity 0.8 one has
it among its first eighth, the other among its first fifth, and neither has more ahead than it may
have for itself. Members of a group that differ by more have shingles of their own there and do not
meet. Those that meet under a shingle are first compared with the one that has the least ahead of it,
which is the likest to all of them; then, across the components that are left, with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from . import simhash
from .components import components

WORDS = 5
#: Similarity as a fraction: OVER / UNDER.
OVER, UNDER = 4, 5
#: Keys of a set, and minimal shingles that each is made of.
BANDS, ROWS = 40, 5
#: Rows of a list of keys or documents up to which it is broadcast; beyond, it shuffles.
BROADCAST_ROWS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One order of all shingles for each place of each band.
_ORDERS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(offsets: np.ndarray, data: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles, by row; a text of fewer words is one shingle."""
    n = len(offsets) - 1
    low = simhash._LOWER[data]
    s, e, rows, inside = K.words(offsets, low)
    count = K.per_row(rows, n)
    codes, known = K.encode_words(low, inside, s, e) if len(s) else (np.zeros(0, np.int64), pa.array([], pa.binary()))
    word = np.array([xxhash.xxh64_intdigest(w) for w in known.to_pylist()] + [0], np.uint64)[np.concatenate([codes, np.full(width, len(known))])]
    windows = np.maximum(count - width + 1, 1)
    first = K.ragged(np.cumsum(count) - count, windows)
    row = np.repeat(np.arange(n), windows)
    ends = np.cumsum(count)[row]
    h = np.full(len(first), width, np.uint64)
    for i in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(first + i < ends, word[np.minimum(first + i, len(word) - 1)], np.uint64(i)))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def bands(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The keys of n sets, n x BANDS; every set has a shingle."""
    starts = np.searchsorted(rows, np.arange(n))
    out = np.zeros((n, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(n, b, np.uint64)
        for order in _ORDERS[b * ROWS : (b + 1) * ROWS]:
            x = (h ^ (order >> np.uint64(7))) * order
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts))
        out[:, b] = key
    return out


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(K.per_row(rows, n))]), pa.int32()), pa.array(values.view(np.int64)))


def _digests(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    return np.add.reduceat(_mix(h + np.uint64(1)), np.searchsorted(rows, np.arange(n))).view(np.int64)


def _described(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds fp (digest of the set), n (its size), sim (its SimHash fingerprint) and bands."""

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        m = len(offsets) - 1
        rows, h = shingles(offsets, data)
        n = K.per_row(rows, m)
        keys = bands(rows, h, m)
        return {
            "fp": pa.array(_digests(rows, h, m)),
            "n": pa.array(n),
            "sim": pa.array(simhash.majority(rows, h, m, n).view(np.int64)),
            "bands": _lists(np.repeat(np.arange(m), BANDS), keys.ravel(), m),
        }

    return K.map_text(K.cast_text(df, keep), kernel, "fp long, n long, sim long, bands array<long>", keep)


def _sets(df: DataFrame) -> DataFrame:
    """(fp, set) of each text."""

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        m = len(offsets) - 1
        rows, h = shingles(offsets, data)
        return {"fp": pa.array(_digests(rows, h, m)), "set": _lists(rows, h, m)}

    return K.map_text(K.cast_text(df, []), kernel, "fp long, set array<long>", [])


def _some(df: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` stands in the stored table few; a short one is broadcast, by its rows."""
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, "left_semi")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sizes_fit(a: str, b: str) -> Column:
    return UNDER * F.least(a, b) >= OVER * F.greatest(a, b)


def _may(ia: str, na: str, ib: str, nb: str) -> Column:
    """Whether sizes and places allow the similarity, if this is the first shingle that both sets have.

    Of the elements in which two sets differ, at most a ninth of both sizes, (9 d + 9 (na - nb)) / 18 are a's alone.
    """
    i, n, j, m = F.col(ia), F.col(na), F.col(ib), F.col(nb)
    alone = (18 * i <= 10 * n - 8 * m) & (18 * j <= 10 * m - 8 * n)
    return _sizes_fit(na, nb) & ((OVER + UNDER) * (i + j) <= (UNDER - OVER) * (n + m)) & alone


def _sets_of(fps: DataFrame, nodes: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """(fp, set) of some nodes (column fp), worked out again from their texts."""
    asked = K.stored(nodes.join(fps, "fp", "left_semi").select(F.col("least").alias(key)))
    sets = K.stored(_sets(_some(df, asked, key)).dropDuplicates(["fp"]))  # a repeated row has its set twice
    K.discard(asked)
    return sets


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, total) of nodes whose similarity is at least OVER / UNDER, verified on whole sets."""
    met = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b")
    return K.stored(met.where((OVER + UNDER) * F.size(F.array_intersect("sa", "sb")) >= OVER * F.col("total")).select("a", "b"))


def _rarest(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(shingle, fp, n, place): the first fifth of each node's shingles, the rarest first, without those that one node alone has."""
    had = sets.join(open_, "fp").select("fp", "n", F.explode("set").alias("shingle"))
    rare = had.groupBy("shingle").agg(F.count("*").alias("sets"))
    order = F.sort_array(F.collect_list(F.struct("sets", "shingle")))  # one node's shingles
    placed = had.join(rare, "shingle").groupBy("fp", "n").agg(order.alias("order"))
    first = placed.select("fp", "n", F.posexplode(F.expr(f"slice(order, 1, n - (({OVER} * n + {UNDER - 1}) div {UNDER}) + 1)")).alias("place", "s"))
    return K.stored(first.where("s.sets > 1").select(F.col("s.shingle").alias("shingle"), "fp", "n", "place"))


def _nearest(first: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b, total) under a shingle: each node with the one that has the least ahead of it, across parts."""
    hubs = first.groupBy("shingle").agg(F.min(F.struct("place", "fp", "n")).alias("hub"))
    met = first.join(hubs, "shingle").where(F.col("fp") != F.col("hub.fp")).select("fp", "n", "place", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("m"), F.col("hub.place").alias("j"))
    met = met.where(_may("place", "n", "j", "m")).select(*_pair("fp", "hub"), (F.col("n") + F.col("m")).alias("total")).distinct()
    a, b = parts.select(F.col("fp").alias("a"), F.col("part").alias("pa")), parts.select(F.col("fp").alias("b"), F.col("part").alias("pb"))
    return met.join(a, "a").join(b, "b").where("pa <> pb").select("a", "b", "total")


def _across(first: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b, total) of nodes of different parts that can be similar; none that is gets lost."""
    first = first.join(parts, "fp")
    wide = first.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("shingle")
    first = K.stored(first.join(wide, "shingle", "left_semi"))
    a = first.where("8 * place <= n").select("shingle", F.col("fp").alias("fa"), F.col("n").alias("na"), F.col("part").alias("pa"), F.col("place").alias("ia"))
    b = first.select("shingle", F.col("fp").alias("fb"), F.col("n").alias("nb"), F.col("part").alias("pb"), F.col("place").alias("ib"))
    met = a.join(b, "shingle").where((F.col("pa") != F.col("pb")) & _may("ia", "na", "ib", "nb"))
    return met.select(*_pair("fa", "fb"), (F.col("na") + F.col("nb")).alias("total")).distinct()


def _joined(parts: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) with further links; components so far are stars, so few steps join them."""
    if not more.limit(1).count():
        return parts
    return K.stored(components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b"))


def _parts(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(fp, part) of nodes, alone or not."""
    return nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", F.coalesce("root", "fp").alias("part"))


def _close(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, total) by SimHash: nodes of equal fingerprints with the first of them, and first ones within simhash.BITS bits."""
    first = K.stored(nodes.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("hub")))
    same = nodes.join(first, "sim").where(F.col("fp") != F.col("hub.fp")).select("fp", "n", "hub")
    near = simhash.links(first.select(F.col("sim").alias("fp")))
    a, b = first.select(F.col("sim").alias("a"), F.col("hub").alias("ha")), first.select(F.col("sim").alias("b"), F.col("hub").alias("hub"))
    near = near.join(a, "a").join(b, "b").select(F.col("ha.fp").alias("fp"), F.col("ha.n").alias("n"), "hub")
    return _fitting(same.unionByName(near))


def _fitting(met: DataFrame) -> DataFrame:
    """Pairs (a, b, total) of nodes beside hubs whose sizes allow the similarity."""
    return met.where(_sizes_fit("n", "hub.n")).select(*_pair("fp", "hub.fp"), (F.col("n") + F.col("hub.n")).alias("total"))


def near_duplicates(df: DataFrame, key: str) -> DataFrame:
    """key and component_id (the least key of all texts that links reach) of each row of df (key, text).

    Texts without words are alike. Repeated rows stay. An empty table gives no rows.
    """
    df = df.select(key, "text")
    docs = K.stored(_described(df, [key]))
    nodes = K.stored(docs.groupBy("fp").agg(F.min(key).alias("least"), F.max("n").alias("n"), F.max("sim").alias("sim"), F.max("bands").alias("bands")))
    entry = nodes.select(F.explode("bands").alias("band"), "fp", "n")
    shared = K.stored(entry.groupBy("band").agg(F.min(F.struct("fp", "n")).alias("hub"), F.max("fp").alias("hi")).where("hub.fp <> hi").select("band", "hub"))
    short = shared.count() <= BROADCAST_ROWS
    entry = K.stored(entry.join(F.broadcast(shared) if short else shared, "band"))
    asked = K.stored(_fitting(entry.where("fp <> hub.fp")).unionByName(_close(nodes)).distinct())
    sets = _sets_of(asked.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), nodes, df, key)
    found = _links(asked, sets)
    parts = K.stored(components(found, "a", "b"))
    K.discard(sets)
    # the keys whose nodes the hubs have not joined
    placed = K.stored(entry.join(parts, entry["fp"] == parts["node"], "left").select("band", "fp", "n", F.coalesce("root", "fp").alias("part")))
    wide = K.stored(placed.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("band"))
    open_ = K.stored(_some(placed, wide, "band").select("fp", "n").distinct())
    if open_.limit(1).count():
        sets = _sets_of(open_.select("fp"), nodes, df, key)
        first, compared = _rarest(open_, sets), asked.select("a", "b")
        near = K.stored(_nearest(first, K.stored(_parts(open_, parts))).join(compared, ["a", "b"], "left_anti"))
        parts = _joined(parts, _links(near, sets))
        met = K.stored(_across(first, K.stored(_parts(open_, parts))).join(compared.unionByName(near.select("a", "b")), ["a", "b"], "left_anti"))
        parts = _joined(parts, _links(met, sets))
        K.discard(sets, first, near, met)
    parts = K.stored(nodes.join(parts, nodes["fp"] == parts["node"]).select("fp", "root", "least"))
    roots = parts.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = parts.join(roots, "root").select("fp", "component_id")
    alone = nodes.join(parts.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    out = K.stored(docs.select(key, "fp").join(linked.unionByName(alone), "fp").select(key, "component_id"))
    K.discard(docs, nodes, entry, shared, asked, found, parts, placed, wide, open_)
    return out
