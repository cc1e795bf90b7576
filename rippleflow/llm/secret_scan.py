"""Secret spans: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags a text's tokens (runs of key characters, or single other characters) as secret
begin, inside or outside. A token can belong to a secret if it is a run of key characters that is
long enough and mixes letters and digits, or if it stands in a run of LEAST_VALUE or more
characters without blanks among the first AHEAD tokens behind a hint (password, pin, bearer, ...);
there letters alone, digits alone and other symbols count too. Inside comes only right behind
begin or inside. Elsewhere the tag is outside whatever the weights, so the best path falls apart
there, and Viterbi runs over each stretch of possible tokens alone, which gives the whole text's
best path. Features are a token's shape, the words around it and the text's own make-up.

The weights are fitted by gradient ascent on the conditional likelihood, forward and backward. What
the fixed patterns mark in a bounded sample of documents is positive. Other possible tokens there
are no sure negatives: behind a hint they are not taught at all, elsewhere they count for
UNSURE. Texts made by rule add secrets that the patterns do not know beside harmless look-alikes; both
stand in the same texts, so a text's make-up does not give the answer away.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K

#: Bounds of the sample: documents, and windows of their tokens (those of the least hashes), of at most WINDOW tokens each.
MAX_TRAIN, MAX_WINDOWS, WINDOW = 4_000, 20_000, 64
#: What a real token that no pattern marks counts for as a negative.
UNSURE = 0.2
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_TOKEN = 6, 20, 24, 8
OUT, BEGIN, INSIDE = 0, 1, 2
DIM = 1 << 14
_BANNED = -1e9

_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_TOKEN = re.compile(rb"[A-Za-z0-9+/_.\x80-\xff-]+|[^\sA-Za-z0-9+/_.\x80-\xff-]")
_VALUE = re.compile(rb"[^\s\"'`,;<>()\[\]{}=:]+(?:[=:][^\s\"'`,;<>()\[\]{}=:]+)*=*")
_WORD = re.compile(rb"[A-Za-z0-9_-]*")
#: Bytes on either side of a token that its neighbouring words are looked for in.
CONTEXT = 1024
#: Words that can announce a secret.
HINT = re.compile(rb"pass(?:word|wd|phrase|code|wort)?|pwd|secret|token|api_?key|(?<![a-z])key|_key|-key|auth|bearer|credential|(?<![a-z])pin(?![a-z])|clave|contrase", re.IGNORECASE)
AHEAD = 4


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a mask of at least so many bytes; none crosses rows."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    edge = np.unique(np.concatenate([[0], on, offsets[(offsets > 0) & (offsets < len(mask))], [len(mask)]]))
    s, e = edge[:-1], edge[1:]
    ok = mask[s] & (e - s >= least)
    return s[ok], e[ok]


def base_spans(offsets: np.ndarray, data: np.ndarray, raw: bytes) -> list[tuple[int, int, int, int, int, int]]:
    """(row, start, kind, end, value start, value end) of the fixed patterns, in bytes of the block."""
    out = []
    mark = np.flatnonzero((data == 0x3A) | (data == 0x3D))
    for r in np.unique(np.searchsorted(offsets, mark, "right") - 1).tolist():
        for m in ASSIGN.finditer(raw, int(offsets[r]), int(offsets[r + 1])):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                out.append((r, m.start(), 0, m.end(), m.start(2), m.end(2)))
    at = raw.find(b"AKIA")
    seen = -1
    while at >= 0:
        r = int(np.searchsorted(offsets, at, "right")) - 1
        if r != seen:
            seen = r
            out += [(r, m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(raw, at, int(offsets[r + 1])) if m.end() - m.start() >= LEAST_ACCESS]
        at = raw.find(b"AKIA", int(offsets[r + 1]))
    s, e = _runs(_HEX[data], offsets, LEAST_HEX)
    rows = np.searchsorted(offsets, s, "right") - 1
    out += [(r, a, 2, b, a, b) for r, a, b in zip(rows.tolist(), s.tolist(), e.tolist())]
    return sorted(out)


def hinted(offsets: np.ndarray, data: np.ndarray, raw: bytes) -> list[tuple[int, int]]:
    """Tokens (start, end) that a hint makes possible: in the first run of LEAST_VALUE bytes or more
    among the AHEAD tokens behind it. What closes or parts values (quotes, brackets, commas) ends a run."""
    out: dict[int, int] = {}
    word, taken = 0, 0  # ends of the last hint's word and of the last run
    # row by row: no hint crosses rows, and none depends on the row before
    hints = ((low + m.end(), high) for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in HINT.finditer(raw[low:high]))
    for behind, end in hints:
        if behind <= word:
            continue  # another hint in the same word
        at = word = _WORD.match(raw, behind, end).end()
        if at < taken:
            continue  # within a run that is taken whole
        seen = 0
        while at < end and seen < AHEAD:
            run = _VALUE.search(raw, at, end)
            if run is None or (gap := len(_TOKEN.findall(raw, at, run.start()))) + seen > AHEAD:
                break
            if run.end() - run.start() >= LEAST_VALUE:
                out.update((t.start(), t.end()) for t in _TOKEN.finditer(raw, run.start(), run.end()))
                taken = run.end()
                break
            seen += gap + 1
            at = run.end()
    return sorted(out.items())


def possible(offsets: np.ndarray, data: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that can belong to a secret: start, end, row."""
    s, e = _runs(_KEY[data], offsets, LEAST_TOKEN)
    if len(s):
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        alpha = np.concatenate([[0], np.cumsum(_ALPHA[data])])
        ok = (digits[e] > digits[s]) & (alpha[e] > alpha[s])
        s, e = s[ok], e[ok]
    if more := hinted(offsets, data, raw):
        hs, he = np.array(more, np.int64).T
        # a run that a hint also reaches counts once, as the hint cuts it
        at = np.minimum(np.searchsorted(hs, e), len(hs)) - 1
        own = (at < 0) | (he[np.maximum(at, 0)] <= s)
        s, e = np.concatenate([s[own], hs]), np.concatenate([e[own], he])
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
    return s, e, np.searchsorted(offsets, s, "right") - 1


def text_features(data: np.ndarray) -> list[str]:
    """Features of a whole text: its length, and its shares of digits, symbols, assignments and lines."""
    n = max(1, len(data))
    share = lambda mask: min(int(np.log2(1 + 1000 * mask.sum() / n)), 9)
    return [f"size={int(np.log2(n))}", f"digits={share(_DIGIT[data])}", f"marks={share(~_KEY[data] & ~K.SPACE[data] & (data < 128))}", f"assigns={share((data == 0x3D) | (data == 0x3A))}", f"lines={share(data == 10)}"]


def token_features(token: bytes, left: list[bytes], right: list[bytes], whole: list[str]) -> list[int]:
    """Hashed features of one token: shape, neighbouring words, the text's make-up."""
    n = len(token)
    a = np.frombuffer(token, np.uint8)
    up, low, dig = (((a >= x) & (a <= y)).mean() for x, y in ((65, 90), (97, 122), (48, 57)))
    count = np.bincount(a, minlength=256)
    p = count[count > 0] / n
    bits = float(-(p * np.log2(p)).sum())
    kind = np.where((a >= 65) & (a <= 90), 1, np.where((a >= 97) & (a <= 122), 2, np.where((a >= 48) & (a <= 57), 3, 4)))
    turns = float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0
    names = [
        f"n={min(n // 4, 12)}", f"up={int(up * 4)}", f"low={int(low * 4)}", f"dig={int(dig * 5)}", f"bits={int(bits * 2)}", f"turns={int(turns * 6)}",
        f"mix={up > 0}{low > 0}{dig > 0}{b'.' in token}{b'-' in token}{b'/' in token}", f"hex={bool(_HEX[a].all())}", f"head={token[:2].lower()}", f"dots={token.count(b'.')}",
    ]
    for i, side in (("l1", left[-1:]), ("l2", left[-2:-1]), ("l3", left[-3:-2]), ("r1", right[:1])):
        names.append(f"{i}={side[0].lower()[-12:] if side else b''}")
    behind = next((i for i, w in enumerate(reversed(left)) if HINT.search(w)), -1)
    parted = any(w in (b":", b"=", b">") for w in left[-2:])
    names += [f"hint={behind}", f"parted={parted}", f"hint={behind}|parted={parted}", f"hint={behind >= 0}|parted={parted}|alone={bool(_ALPHA[a].all())}{bool(_DIGIT[a].all())}|n={min(n // 3, 9)}"]
    names += [f"{x}|hex={bool(_HEX[a].all())}" for x in (f"n={min(n // 4, 12)}", f"bits={int(bits * 2)}")]
    return [zlib.crc32(x.encode()) % DIM for x in names + whole]


class Field:
    """Weights of the field: DIM x 3 for features, 3 x 3 for neighbouring tags."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((DIM, 3)) if emit is None else emit
        self.move = np.zeros((3, 3)) if move is None else move

    @staticmethod
    def barred(move: np.ndarray) -> np.ndarray:
        move = move.copy()
        move[OUT, INSIDE] = _BANNED
        return move

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(axis=0) for f in feats]).reshape(-1, 3)

    def viterbi(self, feats: list[list[int]]) -> list[int]:
        """The best tags of a stretch of possible tokens; outside stands on either side."""
        e, move = self.scores(feats), self.barred(self.move)
        best, back = e[0] + move[OUT], []
        for row in e[1:]:
            step = best[:, None] + move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        tag = int((best + move[:, OUT]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]

    def fit(self, stretches: list[tuple[list[list[int]], list[int], float]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> "Field":
        """Gradient ascent on the mean conditional log likelihood of (features, tags, weight); stretches of one length go together."""
        by: dict[int, list[tuple[list[list[int]], list[int], float]]] = {}
        for f, t, w in stretches:
            by.setdefault(len(f), []).append((f, t, w))
        packs = []
        for n, group in by.items():
            width = max(len(x) for f, *_ in group for x in f)
            ids = np.zeros((len(group), n, width), np.int64)
            on = np.zeros((len(group), n, width))
            for g, (f, *_) in enumerate(group):
                for i, x in enumerate(f):
                    ids[g, i, : len(x)], on[g, i, : len(x)] = x, 1.0
            packs.append((ids, on, np.array([t for _, t, _ in group]), np.array([w for *_, w in group])))
        total = max(1.0, sum(len(f) * w for f, _, w in stretches))
        seen_e, seen_m = np.full((DIM, 3), 1e-8), np.full((3, 3), 1e-8)
        for _ in range(rounds):
            ge, gm, move = np.zeros((DIM, 3)), np.zeros((3, 3)), self.barred(self.move)
            for ids, on, tags, worth in packs:
                g, n, _w = ids.shape
                e = (self.emit[ids] * on[..., None]).sum(axis=2)
                fwd, bwd = np.zeros((g, n, 3)), np.zeros((g, n, 3))
                fwd[:, 0] = e[:, 0] + move[OUT]
                for i in range(1, n):
                    fwd[:, i] = np.logaddexp.reduce(fwd[:, i - 1, :, None] + move, axis=1) + e[:, i]
                bwd[:, -1] = move[:, OUT]
                for i in range(n - 2, -1, -1):
                    bwd[:, i] = np.logaddexp.reduce(move + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
                z = np.logaddexp.reduce(fwd[:, -1] + bwd[:, -1], axis=1)
                p = np.exp(fwd + bwd - z[:, None, None])
                d = (np.eye(3)[tags] - p) * worth[:, None, None]
                np.add.at(ge, ids.reshape(-1), (d[:, :, None, :] * on[..., None]).reshape(-1, 3))
                gm[OUT] += d[:, 0].sum(axis=0)
                gm[:, OUT] += d[:, -1].sum(axis=0)
                for i in range(1, n):
                    pair = np.exp(fwd[:, i - 1, :, None] + move + (e[:, i] + bwd[:, i])[:, None, :] - z[:, None, None])
                    gm -= (pair * worth[:, None, None]).sum(axis=0)
                    np.add.at(gm, (tags[:, i - 1], tags[:, i]), worth)
            ge, gm = ge / total - decay * self.emit, gm / total - decay * self.move
            seen_e += ge**2
            seen_m += gm**2
            self.emit += rate * ge / np.sqrt(seen_e)
            self.move += rate * gm / np.sqrt(seen_m)
        return self


def _around(raw: bytes, a: int, b: int, low: int, high: int) -> tuple[list[bytes], list[bytes]]:
    """The three tokens before a place and the one behind it."""
    reach = 64
    while True:
        at = max(low, a - reach)
        left = [(m.start(), m[0]) for m in _TOKEN.finditer(raw, at, a)][-4:]
        if at == low or reach >= CONTEXT or (len(left) == 4 and left[0][0] > at):
            break
        reach *= 4
    m = _TOKEN.search(raw, b, min(high, b + CONTEXT))
    return [x for _, x in left][-3:], [m[0]] if m else []


def stretches(offsets: np.ndarray, data: np.ndarray, raw: bytes) -> Iterator[tuple[int, list[tuple[int, int]], list[list[int]]]]:
    """(row, tokens, features) of each stretch of possible tokens that touch or are one character apart."""
    s, e, rows = possible(offsets, data, raw)
    whole: dict[int, list[str]] = {}
    i, n = 0, len(s)
    s, e, rows = s.tolist(), e.tolist(), rows.tolist()
    while i < n:
        r, j = rows[i], i + 1
        while j < n and rows[j] == r and s[j] - e[j - 1] <= 1 and not K.SPACE[data[e[j - 1]]]:
            j += 1
        low, high = int(offsets[r]), int(offsets[r + 1])
        if r not in whole:
            whole = {r: text_features(data[low:high])}
        tokens = list(zip(s[i:j], e[i:j]))
        yield r, tokens, [token_features(raw[a:b], *_around(raw, a, b, low, high), whole[r]) for a, b in tokens]
        i = j


def windows(offsets: np.ndarray, data: np.ndarray, secrets: dict[int, list[tuple[int, int]]], sure: bool) -> Iterator[tuple[list[list[int]], list[int], float]]:
    """(features, tags, weight) to learn from: the stretches of a block whose secrets (by row: start, end) are known."""
    raw = data.tobytes()
    unknown = dict(hinted(offsets, data, raw)) if not sure else {}
    for r, tokens, feats in stretches(offsets, data, raw):
        tags, before = [], OUT
        for a, b in tokens:
            hit = next((x for x, y in secrets.get(r, ()) if a < y and b > x), None)
            before = OUT if hit is None else INSIDE if before != OUT and a > hit else BEGIN
            tags.append(before)
        weight = 1.0 if sure or any(tags) else 0.0 if any(a in unknown for a, _ in tokens) else UNSURE
        if weight:
            for i in range(0, len(tags), WINDOW):
                t = tags[i : i + WINDOW]
                yield feats[i : i + WINDOW], [BEGIN if k == 0 and x == INSIDE else x for k, x in enumerate(t)], weight


class _Maker:
    """Texts made by rule, with the places of their secrets."""

    LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    HINTS = "pwd auth bearer credential access_key private-key passphrase client_key pin PIN passcode db_pwd SECRET_KEY credentials authkey user_pass Passwort".split()
    SHAPES = ["{k} = {v}", "{k}={v}", "{k}: {v}", "{k} : {v}", '"{k}": "{v}"', "{k}='{v}'", "{k} is {v}", "--{k} {v}", "{k} {v}", "{k} => {v}", "<{k}>{v}</{k}>", "{k}({v})"]

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("bcdfghlmnprstv") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 4)))

    def some(self, chars: str, a: int, b: int) -> str:
        return "".join(self.r.choice(chars) for _ in range(self.r.randint(a, b)))

    def value(self) -> tuple[str, bool]:
        """A secret, and whether it is plain (letters or digits alone), which only a hint and a mark give away."""
        r, both = self.r, self.LETTERS + self.LETTERS.upper() + self.DIGITS
        k = r.random()
        if k < 0.35:
            v = self.some(both, 12, 44)
            return (v if any(c.isdigit() for c in v) else v + "7"), False
        if k < 0.5:
            return self.some(both + "+/", 16, 40) + "4" + r.choice(["", "=", "=="]), False
        if k < 0.65:
            return self.some(both, 3, 8) + r.choice("!#$%&*^~@?") + self.some(both, 3, 8) + r.choice("!#$%&*^~@?") + self.some(self.DIGITS, 1, 3), False
        if k < 0.75:
            return "-".join(self.some("abcdef0123456789", n, n) for n in (8, 4, 4, 4, 12)), False
        if k < 0.9:
            return self.some(self.LETTERS, 9, 24), True
        return self.some(self.DIGITS, 6, 12), True

    def harmless(self) -> str:
        r, d = self.r, lambda a, b: self.some(self.DIGITS, a, b)
        return r.choice([
            f"version-{d(1, 2)}.{d(1, 2)}.{d(1, 2)}", f"20{d(2, 2)}-0{d(1, 1)}-1{d(1, 1)}T0{d(1, 1)}", f"usr/lib/{self.word()}{d(1, 2)}/v{d(1, 1)}", f"{self.word()}.{d(1, 3)}", f"mail{d(1, 2)}.{self.word()}.com", f"chapter{d(1, 2)}-section{d(1, 2)}", f"IMG_{d(4, 6)}.JPG",
            f"{self.word()}_{d(1, 3)}.txt", f"{self.word()}{self.word()}{d(1, 4)}", f"{d(2, 4)}px/{d(2, 4)}px", f"{self.word()}-{self.word()}-{d(1, 2)}", f"https/{self.word()}.org/{self.word()}/{d(3, 6)}", f"{d(1, 2)}th-{self.word()}",
        ])

    def text(self) -> tuple[str, list[tuple[int, int]]]:
        r, out, spans = self.r, "", []
        for _ in range(r.randint(2, 7)):
            out += " ".join(self.word() for _ in range(r.randint(0, 9))) + r.choice([" ", " ", "\n", ". "])
            k = r.random()
            if k < 0.4:
                v, plain = self.value()
                shape = r.choice(self.SHAPES[:8] if plain else self.SHAPES).replace("{k}", r.choice(self.HINTS))
                at = shape.index("{v}")
                spans.append((len(out) + at, len(out) + at + len(v)))
                out += shape.replace("{v}", v)
            elif k < 0.6:
                out += r.choice(["{w} = {h}", "{w}: {h}", "{h}", "{w} {h}", "{w}='{h}'"]).replace("{w}", self.word()).replace("{h}", self.harmless())
            elif k < 0.8:  # a hint in running text
                out += r.choice(["the {k} {w} {w}", "{k} of {w}", "a {k} and {w} {w}", "{k}, {w} {w}", "{k} {w}. {w}", "no {k}: see {w} {w}"]).replace("{k}", r.choice(self.HINTS)).replace("{w}", self.word() + self.word())
            out += r.choice([" ", "\n", ", "])
        return out, spans


def rule_made(seed: int = 7, n: int = 1000) -> list[tuple[list[list[int]], list[int], float]]:
    """Windows of texts made by rule."""
    maker, out = _Maker(seed), []
    for _ in range(n):
        text, spans = maker.text()
        data = np.frombuffer(text.encode(), np.uint8)
        out += windows(np.array([0, len(data)]), data, {0: spans}, True)
    return out


def fit(df: DataFrame, key: str = "doc_id", limit: int = MAX_TRAIN) -> Field:
    """The field fitted on MAX_WINDOWS windows at most of at most limit documents, chosen by hash, and on texts made by rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = K.text_rows(batch, "text")
            got = []
            for a, b in K.blocks(offsets):
                off, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                marked: dict[int, list[tuple[int, int]]] = {}
                for r, _, _, _, va, vb in base_spans(off, part, part.tobytes()):
                    marked.setdefault(r, []).append((va, vb))
                got += windows(off, part, marked, False)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in got], pa.list_(pa.list_(pa.int32()))), pa.array([x[1] for x in got], pa.list_(pa.int32())), pa.array([x[2] for x in got], pa.float64())], names=["feats", "tags", "weight"]
            )

    found = K.map_arrow(K.sampled(df, key, limit), run, "feats array<array<int>>, tags array<int>, weight double")
    rows = found.orderBy(F.xxhash64("feats", "tags"), "weight").limit(MAX_WINDOWS).collect()
    real = sorted(([list(f) for f in r["feats"]], list(r["tags"]), r["weight"]) for r in rows)
    return Field().fit(real + rule_made())


def find(offsets: np.ndarray, data: np.ndarray, field: Field) -> list[tuple[int, int, int, int, int, int]]:
    """All spans of a block, as base_spans gives them; the field's lie outside those."""
    raw = data.tobytes()
    spans = base_spans(offsets, data, raw)
    taken: dict[int, list[tuple[int, int]]] = {}
    for r, s, _, e, _, _ in spans:
        taken.setdefault(r, []).append((s, e))
    more = []
    for r, tokens, feats in stretches(offsets, data, raw):
        if len(tokens) == 1 and any(s <= tokens[0][0] and tokens[0][1] <= e for s, e in taken.get(r, ())):
            continue  # whatever its tag, it adds nothing
        begin, tags = None, field.viterbi(feats)
        for (a, b), t in zip([*tokens, (0, 0)], [*tags, OUT]):
            if t != INSIDE and begin is not None:
                if not any(s < end and begin < e for s, e in taken.get(r, ())):
                    more.append((r, begin, 3, end, begin, end))
                begin = None
            if t == BEGIN:
                begin = a
            end = b
    return sorted(spans + more)


def scan(df: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_crf, base_sha256, spans and redacted_text to the columns keep.

    Spans are kind:start:end in code points, end exclusive, by start and kind, joined by commas. In
    redacted_text a secret's value is [SECRET]. Null counts as empty; an empty text has no spans.
    Repeated rows stay and get the same spans; an empty table gives no rows. The field's spans
    (crf) lie outside those of the patterns, and spans of one pattern do not overlap.
    """

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        n = len(offsets) - 1
        names, bases = [""] * n, [""] * n
        counts = np.zeros((4, n), np.int64)
        by: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
        for x in find(offsets, data, field):
            by.setdefault(x[0], []).append(x)
        raw, texts = data.tobytes(), []
        for r in range(n):
            low, high = int(offsets[r]), int(offsets[r + 1])
            spans = by.get(r)
            if not spans:
                texts.append(raw[low:high])
                continue
            at = np.concatenate([[0], np.cumsum(K.code_points(data[low:high]))])
            words = [(k, f"{KINDS[k]}:{at[s - low]}:{at[e - low]}") for _, s, k, e, _, _ in spans]
            names[r] = ",".join(w for _, w in words)
            bases[r] = ",".join(w for k, w in words if k < 3)
            for k, _ in words:
                counts[k, r] += 1
            out, done = [], low
            for va, vb in sorted((x[4], x[5]) for x in spans):
                if va >= done:
                    out += [raw[done:va], b"[SECRET]"]
                done = max(done, vb)
            texts.append(b"".join([*out, raw[done:high]]))
        sha = [hashlib.sha256(b.encode()).hexdigest() for b in bases]
        text = pa.array(texts, pa.binary()).cast(pa.string())
        return {"n_assign": pa.array(counts[0]), "n_access": pa.array(counts[1]), "n_hex": pa.array(counts[2]), "n_crf": pa.array(counts[3]), "base_sha256": pa.array(sha, pa.string()), "spans": pa.array(names, pa.string()), "redacted_text": text}

    schema = "n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string, redacted_text string"
    return K.map_text(K.cast_text(df, keep), kernel, schema, keep)
