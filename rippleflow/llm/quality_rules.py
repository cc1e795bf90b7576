"""Quality rules as a short-circuit cascade.

A rule looks at a block of texts and tells which of them it rejects. What rules look at (word
counts, repeated words, ...) is worked out once for a block and goes with the texts that stay, so a
rule costs what it needs and no rule before it needed. Costs of rules and of what they need, and
which rules reject which texts, are measured on a sample of documents; rules then run in the order
of rejections per cost, each step counting only texts that are still there and work that is still
to do. Each rule runs on the texts alone that all rules before it passed. Since a text is kept only
if no rule rejects it, the order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K

#: Documents that costs and selectivities are measured on.
SAMPLE = 2_000
#: Share of a block's bytes from which on rejected texts are cut out.
PICK_SHARE = 1 / 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


#: What rules look at, one number for each text; a later one may rest on earlier ones.
COUNTS = ("n_words", "word_chars", "n_symbols", "upper_share", "n_lines", "n_dup_lines", "n_repeat_words")


class Block:
    """A block of texts; what rules share is computed once, when first asked for."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.offsets, self.data, self.n = offsets, data, len(offsets) - 1

    def pick(self, rows: np.ndarray) -> "Block":
        """The block of some rows alone, with what is known of them; bytes are copied row by row, not gathered."""
        if len(rows) == self.n:
            return self
        offsets = np.concatenate([[0], np.cumsum(np.diff(self.offsets)[rows])])
        spans = list(zip(self.offsets[:-1][rows].tolist(), self.offsets[1:][rows].tolist()))

        def part(whole: np.ndarray) -> np.ndarray:
            view = memoryview(np.ascontiguousarray(whole)).cast("B")
            return np.frombuffer(b"".join([view[a:b] for a, b in spans]), whole.dtype)

        out = Block(offsets, part(self.data))
        for name in COUNTS:
            if name in self.__dict__:
                out.__dict__[name] = self.__dict__[name][rows]
        if "words" in self.__dict__:
            s, e, row, inside = self.words
            number = np.full(self.n, -1)
            number[rows] = np.arange(len(rows))
            stay = number[row] >= 0
            new = number[row[stay]]
            shift = (offsets[:-1] - self.offsets[:-1][rows])[new]
            out.__dict__["words"] = s[stay] + shift, e[stay] + shift, new, part(inside)
        return out

    def count(self, mask: np.ndarray) -> np.ndarray:
        """True bytes of each row."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return K.words(self.offsets, self.data)

    @cached_property
    def n_words(self) -> np.ndarray:
        return K.per_row(self.words[2], self.n)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count(self.words[3] & K.code_points(self.data))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL[self.data])

    @cached_property
    def upper_share(self) -> np.ndarray:
        up, low = self.count(_UPPER[self.data]), self.count(_LOWER[self.data])
        return up / np.maximum(1, up + low)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word: their number and the number of different ones, by row."""
        brk = self.data == 10
        cut = np.flatnonzero(brk)
        begin = np.concatenate([self.offsets[:-1], cut + 1])
        row = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, cut, "right") - 1])
        order = np.lexsort((row, begin))
        begin, row = begin[order], row[order]
        end = np.minimum(np.append(begin[1:], len(self.data)), self.offsets[row + 1])
        end = end - ((end > begin) & (end <= len(self.data)) & brk[np.maximum(end - 1, 0)] if len(self.data) else 0)
        codes, _ = K.encode_spans(self.data[~brk], end - begin)
        full = np.concatenate([[0], np.cumsum(self.words[3])])
        some = full[end] > full[begin]
        row, codes = row[some], codes[some]
        pairs = np.unique(row * (len(begin) + 1) + codes)
        return K.per_row(row, self.n), K.per_row(pairs // (len(begin) + 1), self.n)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self.lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self.lines[0] - self.lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in three-word windows that the text has twice or more."""
        s, e, row, inside = self.words
        if len(s) < 3:
            return np.zeros(self.n, np.int64)
        codes, found = K.encode_words(self.data, inside, s, e)
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        if len(found) >= 1 << 21:
            _, a = np.unique(a * len(found) + b, return_inverse=True)
            key = a * len(found) + c
        else:
            key = a << 42 | b << 21 | c
        at = np.flatnonzero(row[:-2] == row[2:])
        key, r = key[at], row[at]
        order = np.argsort(key, kind="stable")
        key, r = key[order], r[order]
        same = (key[1:] == key[:-1]) & (r[1:] == r[:-1])
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        first = at[order[twice]]
        covered = np.zeros(len(s), bool)
        for i in range(3):
            covered[first + i] = True
        return K.per_row(row[covered], self.n)


@dataclass(frozen=True)
class Rule:
    """rejects: block to a mask of rejected rows. base: one of the fixed rules, which are always told."""

    name: str
    rejects: Callable[[Block], np.ndarray]
    base: bool = False


#: Fixed base rules: fewer than 50 words; more than half of the words in repeated windows.
RULES = [
    Rule("few_words", lambda b: b.n_words < 50, True),
    Rule("repeated_words", lambda b: 100 * b.n_repeat_words > 50 * b.n_words, True),
    Rule("symbols", lambda b: 10 * b.n_symbols > 2 * b.n_words),
    Rule("capitals", lambda b: b.upper_share > 0.5),
    Rule("repeated_lines", lambda b: 10 * b.n_dup_lines > 5 * b.n_lines),
    Rule("word_length", lambda b: (b.word_chars < 2 * b.n_words) | (b.word_chars > 20 * b.n_words)),
]


@dataclass
class Measured:
    """Seconds for a text of each rule and of each count, what counts a rule needs, and how many
    sampled texts each set of rules (bit i: rule i) rejects."""

    rules: dict[str, float] = field(default_factory=dict)
    counts: dict[str, float] = field(default_factory=dict)
    needs: dict[str, frozenset[str]] = field(default_factory=dict)
    hits: dict[int, int] = field(default_factory=dict)


def _timed(block: Block, rules: list[Rule]) -> tuple[dict[str, float], dict[str, float], dict[str, frozenset[str]], np.ndarray]:
    """Seconds of the counts in their order and of the rules once these stand, what each rule needs, and the set of rules that reject each row."""
    counts, spent, needs, mask = {}, {}, {}, np.zeros(block.n, np.int64)
    for name in COUNTS:
        began = time.process_time()
        getattr(block, name)
        counts[name] = time.process_time() - began
    for i, rule in enumerate(rules):
        began = time.process_time()
        mask |= rule.rejects(block).astype(np.int64) << i
        spent[rule.name] = time.process_time() - began
        few = Block(block.offsets[:2], block.data[: block.offsets[1]]) if block.n else Block(np.zeros(1, np.int64), block.data[:0])
        rule.rejects(few)
        needs[rule.name] = frozenset(x for x in COUNTS if x in few.__dict__)
    return counts, spent, needs, mask


def measure(df: DataFrame, rules: list[Rule], key: str = "doc_id", sample: int = SAMPLE) -> Measured:
    """Costs and selectivities on a sample of at most `sample` documents, chosen by hash."""
    docs = K.sampled(df, key, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = [], 0
        for batch in batches:
            offsets, data = K.text_rows(batch, "text")
            for a, b in K.blocks(offsets):
                rows += b - a
                counts, spent, needs, mask = _timed(Block(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]), rules)
                out += [("count", x, v, 0, "") for x, v in counts.items()]
                out += [("rule", x, v, 0, ",".join(sorted(needs[x]))) for x, v in spent.items()]
                out += [("mask", str(m), 0.0, k, "") for m, k in zip(*(x.tolist() for x in np.unique(mask, return_counts=True)))]
        out.append(("rows", "", 0.0, rows, ""))
        kind, name, seconds, n, needs = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(name), pa.array(seconds), pa.array(n, pa.int64()), pa.array(needs)], names=["kind", "name", "seconds", "n", "needs"])

    got = K.map_arrow(docs, run, "kind string, name string, seconds double, n long, needs string").groupBy("kind", "name").agg(F.sum("seconds"), F.sum("n"), F.max("needs")).collect()  # some rows for each rule
    n = max(1, sum(r[3] for r in got if r[0] == "rows"))
    m = Measured()
    for kind, name, seconds, k, needs in got:
        if kind == "count":
            m.counts[name] = seconds / n
        elif kind == "rule":
            m.rules[name], m.needs[name] = seconds / n, frozenset(needs.split(",")) - {""}
        elif kind == "mask":
            m.hits[int(name)] = k
    return m


def ordered(rules: list[Rule], measured: Measured, known: frozenset[str] = frozenset()) -> list[Rule]:
    """By rejections per cost, the most first: of the texts that are left, for the work that is left.

    known: counts that are at hand whatever the rules ask. Rules that were not measured come last.
    """
    left, out, hits, have = [r for r in rules if r.name in measured.rules], [], dict(measured.hits), set(known)
    bit = {r.name: 1 << i for i, r in enumerate(rules)}
    while left:

        def worth(r: Rule) -> float:
            cost = measured.rules[r.name] + sum(measured.counts.get(x, 0.0) for x in measured.needs[r.name] - have)
            return sum(k for m, k in hits.items() if m & bit[r.name]) / (cost + 1e-12)

        best = max(left, key=worth)
        left.remove(best)
        out.append(best)
        have |= measured.needs[best.name]
        hits = {m: k for m, k in hits.items() if not m & bit[best.name]}
    return out + [r for r in rules if r.name not in measured.rules]


def cascade(block: Block, rules: list[Rule], alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mask of kept rows, and for each row the number of the rule that rejected it (-1: none).

    Rejected texts leave the block as soon as they are PICK_SHARE of its bytes; fewer cost less to
    carry along than to cut out.
    """
    alive = np.ones(block.n, bool) if alive is None else alive.copy()
    by = np.full(block.n, -1)
    size = np.diff(block.offsets)
    rows, part = np.arange(block.n), block
    for i, rule in enumerate(rules):
        on = alive[rows]
        if not on.any():
            break
        if size[rows[~on]].sum() >= PICK_SHARE * size[rows].sum():
            rows, part = rows[on], part.pick(np.flatnonzero(on))
            on = alive[rows]
        out = rows[rule.rejects(part) & on]
        alive[out] = False
        by[out] = i
    return alive, by


def keep_rows(df: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """Adds kept and rejected_by (null: kept), with the full short circuit."""
    names = [r.name for r in rules]

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        kept, by = cascade(Block(offsets, data), rules)
        return {"kept": pa.array(kept), "rejected_by": pa.array([None if i < 0 else names[i] for i in by.tolist()], pa.string())}

    return K.map_text(K.cast_text(df, keep), kernel, "kept boolean, rejected_by string", keep)


#: What report() tells of every text.
TOLD = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def report(df: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """Adds the base counts of every text, base_failed and kept.

    The base rules need counts that are told anyway, so they come first; the other rules run as a
    cascade on what those leave, with the counts at hand. Null counts as a text without words.
    """
    base, more = [r for r in rules if r.base], [r for r in rules if not r.base]

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        b = Block(offsets, data)
        counts = {k: pa.array(getattr(b, k), pa.int64()) for k in TOLD}
        failed = np.zeros(b.n, bool)
        for r in base:
            failed |= r.rejects(b)
        kept, _ = cascade(b, more, ~failed)
        return counts | {"base_failed": pa.array(failed), "kept": pa.array(kept)}

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return K.map_text(K.cast_text(df, keep), kernel, schema, keep)


def judge(df: DataFrame, rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document.

    Null and empty texts have no words, so a base rule fails them; repeated rows stay; an empty table
    gives no rows. The verdict does not depend on the sample or on ties in the order of rules.
    """
    rules = RULES if rules is None else rules
    return report(df, ordered(rules, measure(df, rules), frozenset(TOLD)), ["doc_id"] if keep is None else keep)


#: DuckDB SQL for judge() with RULES over `documents`.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
c AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low
  FROM w
), g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
repeated AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS at FROM twice, (VALUES (0), (1), (2)) v(k)) GROUP BY r),
told AS (SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, len(lines) AS n_lines, up, low FROM c LEFT JOIN repeated USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM told)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 2 * up > greatest(1, up + low) OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM failed
"""
