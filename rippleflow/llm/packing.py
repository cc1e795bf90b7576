"""Packing of token sequences by non-negative least squares over length combinations.

Documents are cut into full windows and one remainder. Remainders of one length are
interchangeable, so the whole packing is planned on their histogram, which has at most
`window` bins whatever the input: shallow combinations of lengths that fill a window exactly
are enumerated, their repeat counts solved by non-negative least squares against the
histogram, rounded within what is there, and what remains is packed greedily: combinations
that still fit first, then a single stream of the residual lengths, cut at window borders.
The stream's tail ends in sequences whose lengths are powers of two, which need no padding.

A document finds its place by its rank among the remainders of its length: the rank within
its task is taken while encoding, the tasks' offsets by a window over (task, length) counts.
No length is ever gathered in one task, and no row is ranked by a sort of its length's rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from .bpe import load

#: Rows of (task, length) offsets, 24 bytes each, up to which they are broadcast; beyond, both sides shuffle.
BROADCAST_OFFSETS = 250_000
#: Lengths that stand for all in the enumeration of deeper combinations.
FREQUENT = 96
_PIECES = "start long, length long, crc long, doc_tokens long, ids binary, part long, rank long"
_PACKED = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """Combinations of present lengths that sum to window, as rows of up to four (length, copies) pairs."""
    have = np.flatnonzero(hist[:window])
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 4, 2), np.int64)
    present = hist > 0
    present[0] = False
    heavy = have[np.argsort(-(hist[have] * have), kind="stable")][:FREQUENT]
    found: list[np.ndarray] = []

    def add(parts: list[np.ndarray]) -> None:
        rest = window - sum(parts)
        ok = (rest > 0) & present[np.clip(rest, 0, window)]
        cols = [np.broadcast_to(p, rest.shape)[ok] for p in parts] + [rest[ok]]
        rows = np.zeros((len(cols[0]), 4), np.int64)
        for i, c in enumerate(cols):
            rows[:, i] = c
        found.append(rows)

    add([have])
    add([have[:, None], heavy[None, :]])
    few = heavy[:12]
    add([have[:, None, None], few[None, :, None], few[None, None, :]])
    rows = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    pairs = np.zeros((len(rows), 4, 2), np.int64)
    # equal lengths in a combination become copies of one
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    slot = np.cumsum(new, axis=1) - 1
    r = np.arange(len(rows))[:, None]
    pairs[r, slot, 0] = rows
    np.add.at(pairs, (np.broadcast_to(r, slot.shape), slot, 1), 1)
    pairs[..., 1][pairs[..., 0] == 0] = 0
    # copies of one length, and one more that fills up
    k = window // have
    rest = window - k * have
    ok = (rest == 0) | present[rest]
    many = np.zeros((ok.sum(), 4, 2), np.int64)
    many[:, 0, 0], many[:, 0, 1] = have[ok], k[ok]
    many[:, 1, 0], many[:, 1, 1] = rest[ok], rest[ok] > 0
    many = many[(many[:, 0, 1] > 3) & (many[:, 0, 0] != many[:, 1, 0])]
    return np.concatenate([pairs, many])


def nnls(combos: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2, A's columns being the combinations.

    Projected gradient with momentum; the steps are scaled by diag(A'A 1), which majorises A'A
    since A has no negative entry.
    """
    if not len(combos):
        return np.zeros(0)
    length, copies = combos[..., 0], combos[..., 1].astype(np.float64)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(length.ravel(), weights=(copies * x[:, None]).ravel(), minlength=len(hist))

    def back(r: np.ndarray) -> np.ndarray:
        return (copies * r[length]).sum(axis=1)

    scale = 1.0 / np.maximum(back(forward(np.ones(len(combos)))), 1e-9)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - scale * back(forward(y) - hist))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        step = new - x
        y = new + (t - 1) / u * step
        if (step * (y - new)).sum() < 0:
            u = 1.0
        x, t = new, u
    return x


@dataclass
class Plan:
    """Where rank r of the remainders of a length goes; arrays sorted by (length, first rank)."""

    window: int
    key: np.ndarray  # length << 44 | first rank
    base: np.ndarray  # sequence of the first rank
    offset: np.ndarray
    used: np.ndarray  # by length: ranks that combinations take
    stream: np.ndarray  # by length: where the residual ranks begin in the stream
    first: int  # sequence of the stream's first window
    edges: np.ndarray  # borders of the tail's sequences, from the stream's last full window on

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of each remainder; -1 and the stream position for residual ones."""
        seq, off = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
        fits = rank < self.used[length]
        if fits.any():
            at = np.searchsorted(self.key, length[fits] << 44 | rank[fits], "right") - 1
            seq[fits] = self.base[at] + rank[fits] - (self.key[at] & ((1 << 44) - 1))
            off[fits] = self.offset[at]
        pos = np.where(fits, 0, self.stream[length] + (rank - self.used[length]) * length)
        return seq, off, pos

    def cut(self, pos: int, length: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start, length, sequence, offset) of a residual at a stream position."""
        out, a, end = [], pos, pos + length
        tail = int(self.edges[0])
        while a < end:
            if a < tail:
                seq, begin = a // self.window, a // self.window * self.window
                stop = begin + self.window
            else:
                i = int(np.searchsorted(self.edges, a, "right")) - 1
                seq, begin, stop = tail // self.window + i, int(self.edges[i]), int(self.edges[i + 1])
            b = min(end, stop)
            out.append((a - pos, b - a, self.first + seq, a - begin))
            a = b
        return out


def plan(hist: np.ndarray, window: int) -> Plan:
    """hist[n]: pieces of n tokens, n up to window; full windows are sequences of their own."""
    combos = combinations(hist, window)
    x = nnls(combos, hist[: window + 1].astype(np.float64))
    left = hist.astype(np.int64).copy()
    left[window] = 0
    used = np.zeros(window + 1, np.int64)
    rows: list[tuple[int, int, int, int]] = [(window, 0, 0, 0)]  # length, first rank, sequence, offset
    used[window] = hist[window]
    seq = int(hist[window])
    order = np.argsort(-x, kind="stable").tolist()
    wish = np.rint(x).astype(np.int64)
    for greedy in (False, True):
        for j in order:
            if not greedy and wish[j] < 1:
                break
            parts = [(int(n), int(c)) for n, c in combos[j] if c]
            most = min(int(left[n]) // c for n, c in parts)
            times = most if greedy else min(most, int(wish[j]))
            if not times:
                continue
            at = 0
            for n, c in parts:
                left[n] -= c * times
                for _ in range(c):
                    rows.append((n, int(used[n]), seq, at))
                    used[n] += times
                    at += n
            seq += times
    stream = np.zeros(window + 1, np.int64)
    pos = 0
    for n in range(window - 1, 0, -1):
        stream[n] = pos
        pos += n * int(left[n])
    tail = pos // window * window
    edges, rest = [tail], pos - tail
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(window, table[:, 0] << 44 | table[:, 1], table[:, 2], table[:, 3], used, stream, seq, np.array(edges, np.int64))


def _pieces(path: str, window: int, end_id: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        kind = np.dtype("<u2") if bpe.size <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            offsets, data = K.text_rows(batch, "text")
            for a, b in K.blocks(offsets):
                ids, counts = bpe.encode_rows(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                total = counts + 1
                ends = np.cumsum(total)
                flat = np.empty(int(ends[-1]), np.int64)
                own = np.ones(len(flat), bool)
                own[ends - 1] = False
                flat[own] = ids
                flat[ends - 1] = end_id
                n = -(-total // window)
                row = np.repeat(np.arange(b - a), n)
                start = K.ragged(np.zeros(len(n), np.int64), n) * window
                length = np.minimum(window, total[row] - start)
                wide, small = flat.astype("<u4").tobytes(), flat.astype(kind).tobytes()
                at = (ends - total)[row] + start
                crc = [zlib.crc32(wide[4 * i : 4 * (i + m)]) for i, m in zip(at.tolist(), length.tolist())]
                z = kind.itemsize
                held = [small[z * i : z * (i + m)] if m < window else None for i, m in zip(at.tolist(), length.tolist())]
                by = np.argsort(length, kind="stable")
                s = length[by]
                head = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), np.arange(len(s)), 0))
                rank = np.empty(len(s), np.int64)
                rank[by] = np.arange(len(s)) - head + seen[s]
                seen += np.bincount(length, minlength=window + 1)
                cols = [batch.column(batch.schema.get_field_index(k)).slice(a, b - a).take(pa.array(row)) for k in keep]
                got = [start, length, np.array(crc, np.int64), total[row], None, np.full(len(row), part), rank]
                arrays = [pa.array(held, pa.binary()) if g is None else pa.array(g, pa.int64()) for g in got]
                yield pa.RecordBatch.from_arrays([*cols, *arrays], names=[*keep, *(p.split()[0] for p in _PIECES.split(", "))])

    return run


def _placed(p: Plan, kind: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda k: batch.column(batch.schema.get_field_index(k))
            start, length, crc, tokens, rank = (col(k).to_numpy(zero_copy_only=False) for k in ("start", "length", "crc", "doc_tokens", "rank"))
            seq, off, pos = p.place(length, rank)
            fits = np.flatnonzero(seq >= 0)
            rows, s, n, c, q, o = [fits], [start[fits]], [length[fits]], [crc[fits]], [seq[fits]], [off[fits]]
            cut = []
            held = col("ids")
            for i in np.flatnonzero(seq < 0).tolist():
                parts = p.cut(int(pos[i]), int(length[i]))
                ids = np.frombuffer(held[i].as_py(), kind).astype("<u4") if len(parts) > 1 else None
                cut += [(i, start[i] + a, m, crc[i] if ids is None else zlib.crc32(ids[a : a + m].tobytes()), z, at) for a, m, z, at in parts]
            if cut:
                for whole, more in zip((rows, s, n, c, q, o), zip(*cut)):
                    whole.append(np.array(more, np.int64))
            at = np.concatenate(rows)
            arrays = [pa.array(np.concatenate(x), pa.int64()) for x in (s, n, c)] + [pa.array(tokens[at], pa.int64())] + [pa.array(np.concatenate(x), pa.int64()) for x in (q, o)]
            yield pa.RecordBatch.from_arrays([*(col(k).take(pa.array(at)) for k in keep), *arrays], names=[*keep, *(x.split()[0] for x in _PACKED.split(", "))])

    return run


def pack(df: DataFrame, path: str, keep: list[str], window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack the column text into sequences of at most window tokens.

    One row per piece: the columns keep, start, length, ids_crc32, doc_tokens, sequence_id and
    offset. Null counts as empty; an empty text is the end id alone. Repeated rows are packed each
    for itself. An empty table gives no rows. The pieces with their ids are written once to the
    shared folder; two small aggregations and one map over them follow.
    """
    spark = df.sparkSession
    src = K.cast_text(df, keep)
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    held = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    head = f"{held}, " if keep else ""
    pieces = K.stored(K.map_arrow(src, _pieces(path, window, end_id, keep), head + _PIECES))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    offsets = K.stored(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")))
    hist = np.zeros(window + 1, np.int64)
    rows = 0
    for r in offsets.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect():  # one row for each length
        hist[r["length"]] = r["n"]
        rows += r["parts"]
    p = plan(hist, window)
    side = offsets.select("part", "length", "before")
    side = F.broadcast(side) if rows <= BROADCAST_OFFSETS else side
    ranked = pieces.join(side, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    kind = "<u2" if load(path).size <= 1 << 16 and end_id < 1 << 16 else "<u4"
    K.tune(spark)
    return K.map_arrow(ranked, _placed(p, kind, keep), head + _PACKED)
