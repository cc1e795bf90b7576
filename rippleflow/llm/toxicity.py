"""Toxicity through a noisy channel.

A text's tokens are restored before they are scored. A token that may show noise (digits or
symbols among letters, a letter twice or more running, letters spelt one by one with spaces)
becomes a character lattice: leet characters stand for letters, separators and repetitions can
vanish, gaps between spelt letters can close. Viterbi decoding under a character trigram model
of the whole corpus picks the best path of all; what is longer than PIECE characters is decoded
piece by piece, each from the end of the one before. Other tokens have a single path and pass as
they are. Neighbouring tokens that together begin like a telling word are decoded together.

Restored words and their beginnings are features; those that tell toxic rows are combined by a
noisy or, since one slur is enough. They are learned from labelled rows of two folds only, a
bounded sample of them; the language model counts all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K

#: Bound of the labelled sample that the classifier is fitted on.
MAX_TRAIN = 12_000
THRESHOLD = 0.7
#: Characters that are decoded at once.
PIECE = 256
#: States from which on a step of the decoder is taken on arrays.
DENSE = 48

# Symbols of the language model: 0 is a word's border, 1 to 26 a to z, then Latin-1's small
# letters, and one for any other letter.
_LATIN = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
_LETTERS = [chr(c) for c in range(97, 123)] + _LATIN
SYMBOL = {c: i + 1 for i, c in enumerate(_LETTERS)}
OTHER_LETTER = len(_LETTERS) + 1
BORDER, SIZE = 0, 64
LETTER_OF = ["", *_LETTERS, ""]

#: What a leet character can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "(": "c", "+": "t", "€": "e", "£": "l", "¡": "i",
}
#: What can stand for any letter, or for none.
WILD = "*#"
#: Log channel probabilities.
LEET_COST, WILD_COST, LEET_DROP, SEPARATOR_DROP, SEPARATOR_BORDER = -0.7, -3.5, -10.0, -0.3, -0.7
GAP_CLOSES, GAP_STAYS, RUN_DROP, PAIR_DROP = -0.2, -2.5, -0.2, -7.0
#: The least number of toxic rows that a feature must explain.
LEAST_ROWS = 3
#: The least log odds of a feature that rows are told apart by.
LEAN = 2.0
#: The least precision of a feature that tells toxic texts, and the chance that any feature gets there by luck.
PRECISION, LUCK = 0.94, 0.05

_TWO, _TWO_UP = re.compile(r"(.)\1"), re.compile(r"(.)\1+")
_EDGE = re.compile(r"^(?:([^\w\s])\1{2,}|[\"'“”‘’«»(\[{<,.;:?¿…-])+|(?:([^\w\s])\2{2,}|[\"'“”‘’«»)\]}>,.;:?!…-])+$")
_HAS_LETTER = re.compile(r"[^\W\d_]")


def symbol_table() -> np.ndarray:
    """The symbol of each code point below U+0250; capitals count as small letters."""
    out = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        low = chr(c).lower()
        if chr(c).isalpha():
            out[c] = SYMBOL.get(low, OTHER_LETTER)
    return out


def letters_of(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The symbol of each code point of a UTF-8 buffer."""
    lead = np.flatnonzero(K.code_points(data))
    b = data[lead].astype(np.int64)
    out = table[np.minimum(b, 127)]
    high = np.flatnonzero(b >= 0xC0)
    if len(high):
        pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        code = (b[high] & 31) << 6 | pad[lead[high] + 1] & 63
        two = b[high] < 0xE0
        out[high] = np.where(two & (code < len(table)), table[np.minimum(code, len(table) - 1)], OTHER_LETTER)
        # general punctuation, symbols and the like are no letters
        out[high[(b[high] == 0xE2)]] = BORDER
    return out


def corpus_trigrams(df: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts: SIZE ** 3 cells, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table()
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            offsets, data = K.text_rows(batch, "text")
            for a, b in K.blocks(offsets):
                s = letters_of(data[offsets[a] : offsets[b]], table).astype(np.int32)
                s = np.concatenate([np.zeros(2, np.int32), s, np.zeros(2, np.int32)])
                code = (s[:-2] << 12) + (s[1:-1] << 6) + s[2:]
                total += np.bincount(code, minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["code", "n"])

    rows = K.map_arrow(K.cast_text(df, []), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3)
    counts[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return counts


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the third symbol after two, interpolated with shorter contexts."""
    three = counts.reshape(SIZE, SIZE, SIZE).copy()
    three[:, 0, 0] = 0  # what stands between words is no word
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * SIZE)
    p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
    p3 = (three + 4 * p2[None]) / (three.sum(axis=2, keepdims=True) + 4)
    return np.log(p3).astype(np.float32)


State = tuple[int, int]


class Restorer:
    """Restores noisy tokens; one for each Python worker."""

    def __init__(self, model: np.ndarray):
        self.cube = model.astype(np.float64)
        self.lm = self.cube.ravel().tolist()

    def lattice(self, chars: str) -> list[list[tuple[int, float, bool]]]:
        """For each character: (symbol or -1 for none, log probability, only after the same symbol)."""
        out, n = [], len(chars)
        for i, c in enumerate(chars):
            before = chars[i - 1] if i else ""
            if c == " ":
                out.append([(-1, GAP_CLOSES, False), (BORDER, GAP_STAYS, False)])
                continue
            edges: list[tuple[int, float, bool]] = []
            if c.isalpha():
                s = SYMBOL.get(c, OTHER_LETTER)
                edges.append((s, 0.0, False))
                if c == before:
                    run = (i > 1 and chars[i - 2] == c) or (i + 1 < n and chars[i + 1] == c)
                    edges.append((-1, RUN_DROP if run else PAIR_DROP, True))
            elif c in LEET:
                edges += [(SYMBOL[x], LEET_COST, False) for x in LEET[c]]
                edges.append((-1, LEET_DROP, False))
                if c == before:
                    edges.append((-1, -3.0, True))
                edges.append((BORDER, LEET_DROP, False))
            elif c in WILD:
                edges += [(s, WILD_COST, False) for s in range(1, 27)]
                edges += [(-1, SEPARATOR_DROP - 1.0, False), (BORDER, SEPARATOR_BORDER - 1.0, False)]
            else:
                edges += [(-1, SEPARATOR_DROP, False), (BORDER, SEPARATOR_BORDER, False)]
            out.append(edges)
        return out

    def decode(self, chars: str) -> str:
        """The best path's words, with a space where the path has a border."""
        out: list[str] = []
        start: State = (BORDER, BORDER)
        lattice = self.lattice(chars)
        for at in range(0, len(chars), PIECE):
            last = at + PIECE >= len(chars)
            path, start = self.best(lattice[at : at + PIECE], start, last)
            out += [" " if s == BORDER else LETTER_OF[s] if s < OTHER_LETTER else chars[at + i] for i, s in path]
        return "".join(out).strip()

    def best(self, lattice: list[list[tuple[int, float, bool]]], start: State, last: bool) -> tuple[list[tuple[int, int]], State]:
        """The best path from a state: (character, symbol) of what it emits, and the state at its end.

        A path that ends the token (last) also pays for the border behind it.
        """
        lm = self.lm
        states: dict[State, tuple[float, tuple | None]] = {start: (0.0, None)}
        for at, edges in enumerate(lattice):
            if len(states) >= DENSE:
                return self._dense(lattice, at, states, last)
            new: dict[State, tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                base = (a << 12) + (b << 6)
                for s, cost, same in edges:
                    if s < 0 or (s == BORDER and b == BORDER):
                        if same and b == BORDER:
                            continue
                        key, total, step = (a, b), score + cost, path
                    else:
                        key, total, step = (b, s), score + cost + lm[base + s], (path, s, at)
                    old = new.get(key)
                    if old is None or total > old[0]:
                        new[key] = (total, step)
            states = new
        end, (_, path) = max(states.items(), key=lambda x: x[1][0] + (self.closing(x[0]) if last else 0.0))
        return _steps(path), end

    def closing(self, state: State) -> float:
        return self.lm[(state[0] << 12) + (state[1] << 6)] if state[1] else 0.0

    def _dense(self, lattice: list[list[tuple[int, float, bool]]], first: int, states: dict[State, tuple[float, tuple | None]], last: bool) -> tuple[list[tuple[int, int]], State]:
        """best() from a character on, where wild characters have opened many states: all states of the symbols that occur, as arrays."""
        symbols = sorted({BORDER, *(x for k in states for x in k), *(s for edges in lattice[first:] for s, *_ in edges if s >= 0)})
        number = {s: i for i, s in enumerate(symbols)}
        cube = self.cube[np.ix_(symbols, symbols, symbols)]
        score = np.full((len(symbols), len(symbols)), -np.inf)
        for (a, b), (x, _) in states.items():
            score[number[a], number[b]] = x
        backs = []
        for edges in lattice[first:]:
            cost = np.full(len(symbols), -np.inf)
            skip, skip_same, border = -np.inf, -np.inf, -np.inf
            for s, c, same in edges:
                if s < 0:
                    skip, skip_same = (skip, max(skip_same, c)) if same else (max(skip, c), skip_same)
                else:
                    cost[number[s]] = max(cost[number[s]], c)
                    border = max(border, c) if s == BORDER else border
            every = score[:, :, None] + cube
            before = every.argmax(axis=0)
            new = np.take_along_axis(every, before[None], axis=0)[0] + cost
            new[0, 0] = -np.inf  # a border behind a border is none: the state stays
            stay = score + max(skip, skip_same)
            stay[:, 0] = score[:, 0] + max(skip, border)
            stays = stay >= new
            backs.append(np.where(stays, -1, before))
            score = np.where(stays, stay, new)
        close = cube[:, :, 0].copy()
        close[:, 0] = 0.0
        a, b = np.unravel_index(int((score + close if last else score).argmax()), score.shape)
        end, tail = (symbols[a], symbols[b]), []
        for at in range(len(lattice) - 1, first - 1, -1):
            back = int(backs[at - first][a, b])
            if back >= 0:
                tail.append((at, symbols[b]))
                a, b = back, a
        return _steps(states[symbols[a], symbols[b]][1]) + tail[::-1], end

    def restore(self, token: str) -> str:
        """A token's restored words."""
        low = token.lower()
        if low.isalpha() and not _TWO.search(low):
            return low
        low = _EDGE.sub("", low)
        if (low.isalpha() and not _TWO.search(low)) or not _HAS_LETTER.search(low):
            return low
        return self.decode(low)


def _steps(path: tuple | None) -> list[tuple[int, int]]:
    out = []
    while path:
        path, s, at = path
        out.append((at, s))
    return out[::-1]


def features_of(words: str) -> list[str]:
    """A word and its beginnings of four, five and six letters."""
    out = []
    for w in words.split():
        out.append(w)
        out += [w[:n] + "-" for n in (4, 5, 6) if len(w) >= n]
    return out


_SPELT = frozenset(LEET) | frozenset("*")


def spelt_runs(tokens: list[str], codes: np.ndarray, rows: np.ndarray, single: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs of three and more one-character tokens in a row: (first word, last word + 1, joined by spaces)."""
    hit = np.flatnonzero(single[codes])
    if len(hit) < 3:
        return []
    new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(rows[hit]) != 0)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(hit)))
    out = []
    for i in np.flatnonzero(size >= 3).tolist():
        a = int(hit[first[i]])
        b = a + int(size[i])
        out.append((a, b, " ".join(tokens[c] for c in codes[a:b].tolist()).lower()))
    return out


_NONE: list = []


class Reader:
    """Turns rows into sets of feature ids, or of feature names."""

    def __init__(self, model: np.ndarray, ids: dict[str, int] | None):
        self.restorer, self.ids, self.memory = Restorer(model), ids, {}
        stems = {x.rstrip("-") for x in ids or ()}
        self.stems, self.heads = stems, {x[:n] for x in stems for n in range(1, len(x))}
        self.single = {_TWO_UP.sub(r"\1", x) for x in stems}  # letters that are repeated, once
        self.sizes = sorted({len(x) for x in self.single})
        self.starts = {x[:3] for x in stems | self.single}

    def may_tell(self, low: str) -> bool:
        """Whether a word of letters could be restored to one that begins like a telling word: repeated letters are all that can go."""
        if self.ids is None or low[:3] in self.starts:
            return True
        if not _TWO.search(low):
            return False
        once = _TWO_UP.sub(r"\1", low)
        return any(once[:n] in self.single for n in self.sizes)

    def read(self, words: str) -> list:
        names = features_of(words)
        return names if self.ids is None else [self.ids[x] for x in names if x in self.ids]

    def tokens(self, found: list[bytes]) -> tuple[list[list], np.ndarray]:
        """The features of each token, and whether a telling word may begin with it and go on in the next one."""
        if len(self.memory) > 150_000:
            self.memory = {}
        memory, out = self.memory, []
        for t in found:
            got = memory.get(t)
            if got is None:
                low = t.decode().lower()
                core = low if low.isalpha() else _EDGE.sub("", low)
                if core.isalpha() and not self.may_tell(core):
                    got = (_NONE, core in self.heads)
                else:
                    words = self.restorer.restore(low)
                    got = (self.read(words), words in self.heads)
                memory[t] = got
            out.append(got)
        return [x for x, _ in out], np.array([y for _, y in out], bool)

    def split_words(self, found: list[bytes], codes: np.ndarray, rows: np.ndarray, heads: np.ndarray) -> Iterator[tuple[int, list]]:
        """(first token, features) of telling words that are split over neighbouring tokens."""
        n = len(codes)
        for a in np.flatnonzero(heads[codes]).tolist():
            b, word = a, ""
            raw: list[str] = []
            while b < n and rows[b] == rows[a] and (not word or word in self.heads):
                raw.append(found[codes[b]].decode().lower())
                word += self.restorer.restore(raw[-1])
                b += 1
            if b - a > 1 and any(word[:k] in self.stems for k in range(1, len(word) + 1)):
                if got := self.read(self.restorer.decode(" ".join(_EDGE.sub("", x) for x in raw))):
                    yield a, got

    def pairs(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list]:
        """(row, feature) pairs, with repetitions, as two arrays."""
        s, e, rows, inside = K.words(offsets, data)
        if not len(s):
            return np.zeros(0, np.int64), []
        codes, found = K.encode_words(data, inside, s, e)
        found = found.to_pylist()
        lists, heads = self.tokens(found)
        size = np.array([len(x) for x in lists], np.int64)
        some = np.flatnonzero(size[codes])
        flat = [x for c in codes[some].tolist() for x in lists[c]]
        at = np.repeat(rows[some], size[codes[some]])
        single = np.array([len(t) <= 4 and len(x := t.decode()) == 1 and (x.isalpha() or x in _SPELT) for t in found])
        more_rows, more = [], []
        texts = [t.decode() if one else "" for t, one in zip(found, single)] if single.any() else []
        together = [(a, self.read(self.restorer.decode(spelt))) for a, _, spelt in spelt_runs(texts, codes, rows, single)] if texts else []
        for a, got in [*together, *self.split_words(found, codes, rows, heads)]:
            more += got
            more_rows += [rows[a]] * len(got)
        return np.concatenate([at, np.array(more_rows, np.int64)]), flat + more


@dataclass
class Model:
    """prior: the chance of label 1 where no feature speaks; weights: each feature's precision."""

    lm: np.ndarray
    prior: float
    weights: dict[str, float] = field(default_factory=dict)


def _train_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most limit labelled documents of the training folds, spread by hash; one row for each doc_id."""
    one = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    one = one.where(K.fold(F.col("_id")) != 1).groupBy("_id").agg(F.max("y").alias("y"))
    one = one.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(one), F.col("doc_id") == F.col("_id"))  # at most `limit` ids
    return K.one_each(rows.select("doc_id", "text", "y"), "doc_id")


def _feature_counts(train: DataFrame, lm: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(lm, None), (Counter(), Counter())
        for batch in batches:
            offsets, data = K.text_rows(batch, "text")
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            for a, b in K.blocks(offsets):
                rows, names = reader.pairs(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                for r, name in set(zip(rows.tolist(), names)):
                    total[y[a + r]][name] += 1
        names = list(total[0].keys() | total[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([total[1][x] for x in names], pa.int64()), pa.array([total[0][x] for x in names], pa.int64())],
            names=["name", "bad", "good"],
        )

    return K.map_arrow(train, run, "name string, bad long, good long").groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _active(train: DataFrame, lm: np.ndarray, ids: dict[str, int]) -> DataFrame:
    """Each training row's label and feature ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm, ids)
        for batch in batches:
            offsets, data = K.text_rows(batch, "text")
            out: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
            for a, b in K.blocks(offsets):
                rows, got = reader.pairs(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                for r, i in zip(rows.tolist(), got):
                    out[a + r].add(i)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), pa.array([sorted(x) for x in out], pa.list_(pa.int32()))], names=["y", "ids"])

    return K.map_arrow(train, run, "y int, ids array<int>")


def evident(bad: np.ndarray, good: np.ndarray, share: float, tests: int) -> np.ndarray:
    """Whether so many bad and good rows are too many bad ones for luck, toxic rows being a share of all
    and so many features being tried: Chernoff's bound on the binomial tail."""
    n = np.maximum(bad + good, 1e-9)
    p = bad / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(bad > 0, bad * np.log(p / share), 0.0) + np.where(good > 0, good * np.log((1 - p) / (1 - share)), 0.0)
    return (p > share) & (gain >= np.log(max(1, tests) / LUCK))


def choose(rows: list[tuple[int, tuple[int, ...]]], names: list[str], least: int = 3, demand: int = 3, tests: int = 0) -> dict[int, float]:
    """Features that tell toxic rows at PRECISION or better, and their precision.

    Greedy cover: again and again the feature that most toxic rows have of which fewer than `demand`
    features are chosen; of a word and its beginnings, one is taken. Rows of equal features count
    once, so copies do not add up. A feature must be evident() among `tests` tried ones (0: no such demand).
    """
    n = len(names)
    stems = [x.rstrip("-") for x in names]
    long_first = np.array([0.01 * len(x) for x in names])
    family: dict[str, list[int]] = {}
    for i, x in enumerate(stems):
        family.setdefault(x[:4], []).append(i)
    groups = set(rows)
    bad, good = np.zeros(n), np.zeros(n)
    having: dict[int, list[tuple[int, ...]]] = {}
    for y, ids in groups:
        for i in ids:
            (bad if y else good)[i] += 1
            if y:
                having.setdefault(i, []).append(ids)
    precision = (bad + 0.1) / (bad + good + 0.2)
    fit, gain = precision >= PRECISION, bad.copy()
    if tests:
        fit &= evident(bad, good, min(0.5, max(1e-6, sum(y for y, _ in rows) / len(rows))), tests)
    wanted = {ids: demand for y, ids in groups if y and ids}
    chosen: dict[int, float] = {}
    while wanted:
        best = int(np.argmax((gain + long_first) * fit))
        if gain[best] * fit[best] < least:
            break
        chosen[best] = float(precision[best])
        for i in family[stems[best][:4]]:
            if stems[i].startswith(stems[best]) or stems[best].startswith(stems[i]):
                fit[i] = False
        for ids in having[best]:
            if ids in wanted:
                wanted[ids] -= 1
                if not wanted[ids]:
                    del wanted[ids]
                    for i in ids:
                        gain[i] -= 1
    return chosen


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Model:
    """Language model of all texts, and the classifier of the bounded sample."""
    docs = docs.select("doc_id", "text")
    lm = trigram_model(corpus_trigrams(docs))
    train = K.stored(_train_rows(docs, labels, limit))
    n, bad = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    model = Model(lm, (bad + 1) / (n + 2))
    if not bad or bad == n:
        return model
    counts = K.stored(_feature_counts(train, lm).where(F.col("bad") >= LEAST_ROWS))
    tests = counts.count()
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (n - bad + 1))
    # words that at least so many of the sampled toxic rows have, and that lean their way; what is evident, choose() tells
    names = [r["name"] for r in counts.where(odds >= LEAN).select("name").orderBy("name").collect()]
    if not names:
        return model
    rows = [(r["y"], tuple(r["ids"])) for r in _active(train, lm, {x: i for i, x in enumerate(names)}).collect()]  # at most `limit` rows
    kept = choose(rows, names, LEAST_ROWS, tests=tests)
    rest = [y for y, ids in rows if not any(i in kept for i in ids)]
    model.prior = (sum(rest) + 1) / (len(rest) + 2)
    model.weights = {names[i]: q for i, q in kept.items()}
    return model


def score(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Adds score (0 to 1) to the columns keep; a null or empty text scores the prior."""
    names = list(model.weights)
    ids = {x: i for i, x in enumerate(names)}
    weights = np.log1p(-np.array([model.weights[x] for x in names]))
    clean, lm = math.log1p(-model.prior), model.lm
    held: list[Reader] = []

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        if not held:
            held.append(Reader(lm, ids))
        rows, got = held[0].pairs(offsets, data)
        n = len(offsets) - 1
        z = np.full(n, clean)
        if len(got):
            pair = np.unique(rows * (len(names) + 1) + np.array(got, np.int64))
            z += np.bincount(pair // (len(names) + 1), weights=weights[pair % (len(names) + 1)], minlength=n)
        return {"score": pa.array(-np.expm1(z), pa.float64())}

    return K.map_text(K.cast_text(df, keep), kernel, "score double", keep)


def restore(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Adds restored_text: the restored words, joined by spaces."""
    lm = model.lm

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        r, out = Restorer(lm), []
        s, e, rows, inside = K.words(offsets, data)
        texts: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
        if len(s):
            codes, found = K.encode_words(data, inside, s, e)
            raw = [t.decode() for t in found.to_pylist()]
            done = [r.restore(t) for t in raw]
            single = np.array([len(t) == 1 and (t.isalpha() or t in _SPELT) for t in raw])
            runs = {a: (b, spelt) for a, b, spelt in spelt_runs(raw, codes, rows, single)}
            i = 0
            while i < len(codes):
                if i in runs:
                    end, spelt = runs[i]
                    texts[rows[i]].append(r.decode(spelt))
                    i = end
                else:
                    texts[rows[i]].append(done[codes[i]])
                    i += 1
        out = [" ".join(x for x in t if x) for t in texts]
        return {"restored_text": pa.array(out, pa.string())}

    return K.map_text(K.cast_text(df, keep), kernel, "restored_text string", keep)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts score the prior. Repeated rows stay and score alike; a null doc_id is in fold
    0. Without labels of both kinds every text scores the smoothed rate of label 1. An empty table
    gives no rows. Of labels that contradict each other, 1 holds.
    """
    model = fit(docs, labels, limit)
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", (K.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
