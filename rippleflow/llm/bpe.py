"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

Encoding has two layers, each of which emits as soon as no later input can change what it says:

* the splitter cuts text into pre-tokens; a pre-token's end is final once two further
  pre-tokens and SPLIT_HOLD bytes have been read;
* the merger turns a pre-token into ids; an id is final once the merge list's sufficient
  lookahead (sufficient_lookahead) has been read beyond it. A boundary that is final splits
  the text: what follows encodes on its own, so only the lookahead is carried over.

Both keep a bounded buffer, however long a text or a pre-token is. There is one path for all
texts: the texts of a block run through the transducer side by side, each a stream that reads STEP
bytes a round and carries over what is not final. A round works on all streams at once in numpy:
pre-token boundaries by character class, then each distinct pre-token merged once.

Decoding maps ids to bytes and bytes to text through an incremental UTF-8 state machine for each
stream; invalid sequences become U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _kernel as K

LETTER, NUMBER, BLANK, OTHER, UNKNOWN = 0, 1, 2, 3, 255
SPLIT_HOLD = 16
#: A pre-token over this many bytes is merged window by window.
LONG_BYTES = 512
#: Bytes that a stream reads in a round.
STEP = 1 << 16
_BIG = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others are numbered from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(rules: list[tuple[bytes, bytes]]) -> int:
    """Bytes beyond a token's end after which no continuation can change that token.

    Whether rule r = (u, v) applies at a boundary can depend on text beyond v only through a
    rule of higher priority that takes v's tail away, that is, one whose left part is a suffix of v
    (or v's tail's container). Its own right part may in turn be taken by a still higher one,
    so reach(r) = |v| + the greatest reach of the higher rules whose left part ends v; priorities
    fall strictly along such a chain. The longest reach over all rules, and at least one maximal
    token, is sufficient.
    """
    best: dict[bytes, int] = {}
    top = 0
    for u, v in rules:
        reach = len(v) + max((best.get(v[i:], 0) for i in range(len(v))), default=0)
        if reach > best.get(u, 0):
            best[u] = reach
        top = max(top, reach, len(u) + len(v))
    return top + 4


class Bpe:
    """A byte-level BPE vocabulary of the tokenizers JSON format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.hold = max([SPLIT_HOLD, *(len(t) + 1 for t in self.specials)])
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.tokens[i] = bytes(alphabet[c] for c in t)
        for t, i in self.specials.items():
            self.tokens[i] = t
        self.size = size
        self.byte_id = np.array([vocab[c] for c in sorted(alphabet, key=alphabet.get)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pairs = pd.Index(left * size + right)
        self.pairs.get_indexer(np.zeros(1, np.int64))  # builds its hash table
        self.lookahead = sufficient_lookahead([(self.tokens[a], self.tokens[b]) for a, b in zip(left, right)])
        self.token_len = np.array([len(t) for t in self.tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        digits = [b"%d," % i for i in range(size)]
        self.digit_len = np.array([len(t) for t in digits], np.int64)
        self.digit_at = np.concatenate([[0], np.cumsum(self.digit_len)[:-1]])
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)
        self._pre = Tokenizer.from_file(path).pre_tokenizer
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn(np.arange(128))

    # -- splitter -----------------------------------------------------------------------

    def _learn(self, chars: np.ndarray) -> None:
        """Classes of characters, as the pre-tokenizer itself treats them."""
        for c in chars.tolist():
            s = chr(c)
            for kind, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                if len(self._pre.pre_tokenize_str(probe + s)) == 1:
                    self.kind[c] = kind
                    break
            else:
                self.kind[c] = BLANK

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        kind = self.kind[data]
        high = np.flatnonzero(data >= 0xC0)
        if not len(high):
            return kind
        b = data.astype(np.int64)
        pad = np.concatenate([b, np.zeros(3, np.int64)])
        b0, b1, b2, b3 = (pad[high + i] for i in range(4))
        size = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
        code = np.where(
            size == 2, (b0 & 31) << 6 | b1 & 63, np.where(size == 3, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63)
        )
        code = np.minimum(code, 0x10FFFF)
        if (self.kind[code] == UNKNOWN).any():
            seen = np.unique(code)
            self._learn(seen[self.kind[seen] == UNKNOWN])
        got = self.kind[code]
        for i in range(4):
            there = size > i
            kind[high[there] + i] = got[there]
        return kind

    def split(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pre-tokens, their rows, and special ids (-1: an ordinary pre-token)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = offsets
        special: dict[int, int] = {}
        raw = None
        for token, i in self.specials.items():
            raw = data.tobytes() if raw is None else raw
            at = raw.find(token)
            while at >= 0:
                row_end = offsets[np.searchsorted(offsets, at, "right")]
                if at + len(token) <= row_end:
                    special[at] = i
                    at = raw.find(token, at + len(token))
                else:
                    at = raw.find(token, at + 1)
            if special:
                ends = [at + len(token) for at, j in special.items() if j == i]
                cuts = np.unique(np.concatenate([cuts, np.array([*special, *ends], np.int64)]))
        head = np.zeros(n + 1, bool)
        head[cuts] = True
        k = self.classes(data)
        start = head[:n].copy()
        start[1:] |= k[1:] != k[:-1]
        # the last blank before other text stands with it if it is a space, or alone
        end = np.flatnonzero((k[:-1] == BLANK) & (k[1:] != BLANK) & ~head[1:n]) + 1
        last = end - 1
        for _ in range(3):
            last = last - ((data[last] & 0xC0) == 0x80)
        start[last] = True
        start[end[data[last] == 0x20]] = False
        # contractions
        if n > 1:
            i = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & start[1:] & ~head[1:n] & (k[1:] == LETTER))
            if len(i):
                pad = np.concatenate([data, np.zeros(3, np.uint8)])
                one, two = pad[i + 1], pad[i + 2]
                short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
                inside = ~head[np.minimum(i + 2, n)]
                long = inside & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
                for hit, size in ((short, 2), (long & ~short, 3)):
                    at = i[hit]
                    start[at + 1] = False
                    after = at + size
                    start[after[after < n]] = True
        s = np.flatnonzero(start)
        rows = np.searchsorted(offsets, s, "right") - 1
        ids = np.full(len(s), -1, np.int64)
        if special:
            where = np.array(sorted(special), np.int64)
            # a special token is one pre-token: what was found inside it goes
            at = np.searchsorted(where, s, "right") - 1
            size = np.array([len(self.tokens[special[w]]) for w in where.tolist()], np.int64)
            inner = (at >= 0) & (s > where[np.maximum(at, 0)]) & (s < (where + size)[np.maximum(at, 0)])
            s, rows, ids = s[~inner], rows[~inner], ids[~inner]
            ids[np.searchsorted(s, where)] = [special[w] for w in where.tolist()]
        return s, rows, ids

    # -- merger -------------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.get_indexer(a * self.size + b).astype(np.int64)
        r[r < 0] = _BIG
        return r

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words at once: in each round, every word applies its best rule everywhere."""
        n = len(lengths)
        sym = self.byte_id[flat]
        word = np.repeat(np.arange(n), lengths)
        rank = np.full(len(sym), _BIG)
        if len(sym) > 1:
            same = np.flatnonzero(word[:-1] == word[1:])
            rank[same] = self._ranks(sym[same], sym[same + 1])
        done_w, done_s = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(first, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, first), count)
            live = low < _BIG
            if not live.all():
                done_w.append(word[~live])
                done_s.append(sym[~live])
                sym, word, rank, low = sym[live], word[live], rank[live], low[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            if len(hit) > 1:
                fresh = np.concatenate([[True], np.diff(hit) != 1])
                if not fresh.all():  # a run of the same pair merges from the left, two by two
                    at = np.arange(len(hit))
                    hit = hit[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            now = np.cumsum(stay)[hit] - 1
            sym, word, rank = sym[stay], word[stay], rank[stay]
            # only pairs that a merged symbol is part of change; a pair between two of them comes up twice
            old = np.concatenate([now, now[now > 0] - 1])
            rank[old] = _BIG
            old = old[old < len(sym) - 1]
            old = old[word[old] == word[old + 1]]
            rank[old] = self._ranks(sym[old], sym[old + 1])
        if not done_w:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        w, s = np.concatenate(done_w), np.concatenate(done_s)
        order = np.argsort(w, kind="stable")
        return s[order], np.bincount(w, minlength=n)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word, a window at a time: ids that end before the lookahead are final."""
        out, at, window = [], 0, LONG_BYTES + self.lookahead
        while True:
            part = np.frombuffer(word, np.uint8)[at : at + window]
            ids, _ = self.merge(part, np.array([len(part)]))
            if at + window >= len(word):
                return np.concatenate([*out, ids])
            ends = np.cumsum(self.token_len[ids])
            final = int(np.searchsorted(ends, window - self.lookahead, "right"))
            out.append(ids[:final])
            at += int(ends[final - 1])

    def merge_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and where each word's begin (words + 1 places)."""
        offsets, data = K.bytes_of(words)
        size = np.diff(offsets)
        long = np.flatnonzero(size > LONG_BYTES)
        if not len(long):
            ids, count = self.merge(data, size)
            return ids, np.concatenate([[0], np.cumsum(count)])
        short = np.flatnonzero(size <= LONG_BYTES)
        ids, count = self.merge(data[K.ragged(offsets[short], size[short])], size[short])
        parts = np.split(ids, np.cumsum(count)[:-1]) if len(short) else []
        every: list[np.ndarray] = [None] * len(size)
        for i, x in zip(short.tolist(), parts):
            every[i] = x
        for i in long.tolist():
            every[i] = self.merge_long(data[offsets[i] : offsets[i + 1]].tobytes())
        return np.concatenate(every), np.concatenate([[0], np.cumsum([len(x) for x in every])])

    def encode_rows(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and the number of ids of each row."""
        n = len(offsets) - 1
        parts = list(self.transduce(offsets, data))
        rows = np.concatenate([np.zeros(0, np.int64), *(np.repeat(r, c) for r, _, c in parts)])
        ids = np.concatenate([np.zeros(0, np.int64), *(i for _, i, _ in parts)])
        if len(parts) > 1:
            ids = ids[np.argsort(rows, kind="stable")]
        return ids, K.per_row(rows, n)

    def transduce(self, offsets: np.ndarray, data: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Round by round: the rows whose streams still run, the ids that became final, and how many for each row."""
        begin, read, end = offsets[:-1].copy(), offsets[:-1].copy(), offsets[1:]
        live = np.flatnonzero(end > begin)
        while len(live):
            to = np.minimum(read[live] + max(step, 4), end[live])
            for _ in range(3):  # never inside a character
                to -= (to < end[live]) & ((data[np.minimum(to, len(data) - 1)] & 0xC0) == 0x80)
            read[live] = to
            size = to - begin[live]
            whole = len(live) == len(begin) and int(size.sum()) == len(data)
            flat = data if whole else data[K.ragged(begin[live], size)]
            ids, counts, done = self.advance(np.concatenate([[0], np.cumsum(size)]), flat, to == end[live])
            yield live, ids, counts
            begin[live] += done
            live = live[begin[live] < end[live]]

    def advance(self, offsets: np.ndarray, data: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is final in the buffers of some streams: ids, how many for each, and the bytes they stand for."""
        n, size = len(offsets) - 1, np.diff(offsets)
        s, rows, special = self.split(offsets, data)
        if ended.all():
            return *self.encode_split(s, rows, special, data, n), size
        cut, tails = size.copy(), {}
        for r in np.flatnonzero(~ended).tolist():
            a, b = np.searchsorted(rows, [r, r + 1])
            at = s[a:b] - offsets[r]
            sure = at[:-2][at[:-2] <= size[r] - self.hold]
            cut[r] = sure[-1] if len(sure) else 0
            if len(at) and size[r] - at[-1] > LONG_BYTES + self.lookahead + self.hold and special[b - 1] < 0:
                # one long pre-token at the end: what stands before it is final, and so is its head
                cut[r] = at[-1]
                word = data[offsets[r] + at[-1] : offsets[r + 1]].tobytes()
                ids = self.merge_long(word)
                ends = np.cumsum(self.token_len[ids])
                keep = int(np.searchsorted(ends, len(word) - self.lookahead - self.hold, "right"))
                tails[r] = ids[:keep], int(ends[keep - 1]) if keep else 0
        place = s - offsets[rows]
        on = place < cut[rows]
        part = np.concatenate([[0], np.cumsum(cut)])
        ids, counts = self.encode_split(place[on] + part[rows[on]], rows[on], special[on], data[K.ragged(offsets[:-1], cut)], n)
        if tails:
            split = np.split(ids, np.cumsum(counts)[:-1])
            for r, (more, length) in tails.items():
                split[r] = np.concatenate([split[r], more])
                counts[r] += len(more)
                cut[r] += length
            ids = np.concatenate(split)
        return ids, counts, cut

    def encode_split(self, s: np.ndarray, rows: np.ndarray, special: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for pre-tokens that are known: they start at s and end where the next one does."""
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        codes, found = K.encode_spans(data, np.diff(np.append(s, len(data))))
        flat, at = self.merge_all(found)
        begin, count = at[:-1][codes], np.diff(at)[codes]
        own = special >= 0
        if own.any():
            begin[own], count[own] = len(flat) + np.arange(own.sum()), 1
            flat = np.concatenate([flat, special[own]])
        return flat[K.ragged(begin, count)], K.per_row(rows, n, count)

    def digits(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids in decimal, each with a comma behind it, and each row's bytes."""
        size = self.digit_len[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.digit_bytes[K.ragged(self.digit_at[ids], size)], np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.token_bytes[K.ragged(self.token_at[ids], self.token_len[ids])]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary for each Python worker."""
    return Bpe(path)


class StreamEncoder:
    """One stream: push() text piece by piece, then finish(): the ids are those of the whole text."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.buffer = bpe, b""

    def _advance(self, ended: bool) -> np.ndarray:
        """Ids that are final; the bytes of a character that is not whole yet wait."""
        size = len(self.buffer)
        if not ended:
            back = next((i for i in range(1, min(4, size) + 1) if self.buffer[-i] & 0xC0 != 0x80), 0)
            lead = self.buffer[-back] if back else 0
            if lead >= 0xC0 and back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                size -= back
        data = np.frombuffer(self.buffer, np.uint8)[:size]
        ids, _, done = self.bpe.advance(np.array([0, size]), data, np.array([ended]))
        self.buffer = self.buffer[int(done[0]) :]
        return ids

    def push(self, text: str | bytes) -> np.ndarray:
        self.buffer += text.encode() if isinstance(text, str) else text
        return self._advance(False)

    def finish(self) -> np.ndarray:
        return self._advance(True)


class StreamDecoder:
    """Ids to text piece by piece: bytes that do not yet make a character wait in the state."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: np.ndarray) -> str:
        return self.push_bytes(self.bpe.decode_bytes(np.asarray(ids, np.int64)).tobytes())

    def push_bytes(self, data: bytes) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def encode_decode(df: DataFrame, path: str, keep: list[str], step: int = STEP) -> DataFrame:
    """Encode and decode the column text. Adds n_tokens, ids_sha256 (of the decimal ids joined by
    commas) and decoded_sha256 (of the decoded text in UTF-8).

    Null counts as empty: no ids, and the digests of nothing. Every text, however long, runs through
    the transducer, step bytes a round, and its ids through the decoder. Repeated rows stay; an empty
    table gives no rows. Map only.
    """

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        bpe, n = load(path), len(offsets) - 1
        total = np.zeros(n, np.int64)
        first, second = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
        decoders = [StreamDecoder(bpe) for _ in range(n)]
        for rows, ids, counts in bpe.transduce(offsets, data, step):
            text, size = bpe.digits(ids, counts)
            raw, out = text.tobytes(), bpe.decode_bytes(ids).tobytes()
            at = np.concatenate([[0], np.cumsum(size)]).tolist()
            ends = np.concatenate([[0], np.cumsum(bpe.token_len[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
            for i, r in enumerate(rows.tolist()):
                if at[i] < at[i + 1]:
                    first[r].update((b"," if total[r] else b"") + raw[at[i] : at[i + 1] - 1])
                    second[r].update(decoders[r].push_bytes(out[ends[i] : ends[i + 1]]).encode())
            total[rows] += counts
        for h, d in zip(second, decoders):
            h.update(d.finish().encode())
        return {"n_tokens": pa.array(total, pa.int64()), "ids_sha256": pa.array([h.hexdigest() for h in first], pa.string()), "decoded_sha256": pa.array([h.hexdigest() for h in second], pa.string())}

    return K.map_text(K.cast_text(df, keep), kernel, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep)
