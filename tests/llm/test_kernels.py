"""Kernels against brute force, without Spark."""

import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from rippleflow.llm import _kernel as K
from rippleflow.llm import boosting, bpe, html_extract, packing, quality_rules, secret_scan, simhash, toxicity, url_filter
from rippleflow.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "a", "é", "a\n\nb", "don't  stop\t'll", "<|endoftext|>", "中文 text", "x" * 3000, "'" * 50 + "s", " \n \n", "a b c a b c a b c", "😀 😀\u3000z"]
texts = st.lists(st.one_of(st.sampled_from(ODD), st.text(alphabet="ab é'\n\t 1中😀s<|>_", max_size=40)), max_size=8)


def block(given_texts):
    raw = [t.encode() for t in given_texts]
    return np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)


@pytest.fixture(scope="module")
def vocab():
    return bpe.load(vocabulary_path()), Tokenizer.from_file(vocabulary_path())


@settings(max_examples=60, deadline=None)
@given(texts)
def test_encoding_is_the_librarys(vocab, docs):
    own, library = vocab
    ids, counts = own.encode_rows(*block(docs))
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if docs else []
    assert got == [library.encode(t, add_special_tokens=False).ids for t in docs]


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(ODD + ["abc def " * 400, "ab" * 2000, " " * 1500 + "x"]), st.integers(1, 700))
def test_streams_agree_with_whole_texts(vocab, text, step):
    own, library = vocab
    enc, dec, ids, out = bpe.StreamEncoder(own), bpe.StreamDecoder(own), [], ""
    for i in range(0, len(text), step):
        new = enc.push(text[i : i + step])
        ids += new.tolist()
        out += dec.push(new)
        assert len(enc.buffer) <= 4 * (step + bpe.LONG_BYTES + own.lookahead + own.hold)  # constant memory
    last = enc.finish()
    ids += last.tolist()
    out += dec.push(last) + dec.finish()
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want and out == library.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("step", [5, 64, 1 << 16])
def test_side_by_side_streams_agree_with_whole_texts(vocab, step):
    own, library = vocab
    docs = [*ODD, "ab" * 3000 + " x" * 90, "é😀" * 700, "'" * 900 + "s", " " * 1500 + "x", "<|endoftext|>" * 30, "\n" * 700 + "😀", "a1" * 500]
    got = [[] for _ in docs]
    for rows, ids, counts in own.transduce(*block(docs), step):
        for r, x in zip(rows.tolist(), np.split(ids, np.cumsum(counts)[:-1])):
            got[r] += x.tolist()
    assert got == [library.encode(t, add_special_tokens=False).ids for t in docs]


def test_lookahead_grows_with_chains():
    assert bpe.sufficient_lookahead([(b"a", b"b")]) < bpe.sufficient_lookahead([(b"b", b"cccc"), (b"a", b"b")])


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_against_all_continuations(seed, tmp_path):
    """No continuation changes a token that ends the lookahead before the end of what was read."""
    r = random.Random(seed)
    tokens, merges = ["a", "b"] if seed % 3 else ["a", "b", "c"], []
    letters = list(tokens)
    for _ in range(9):
        x, y = r.choice(tokens), r.choice(tokens)
        if len(x + y) <= 5 and x + y not in tokens:
            merges.append((x, y))
            tokens.append(x + y)
    vocabulary = {c: i for i, c in enumerate([*bpe.byte_alphabet(), *(x + y for x, y in merges)])}
    library = Tokenizer(models.BPE(vocab=vocabulary, merges=merges))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.save(str(tmp_path / "v.json"))
    own = bpe.Bpe(str(tmp_path / "v.json"))
    ways = ["".join(c) for n in range(7 if len(letters) == 2 else 5) for c in itertools.product(letters, repeat=n)]
    for _ in range(15):
        head = "".join(r.choice(letters) for _ in range(own.lookahead + 8))
        words = [(head + w).encode() for w in ways]
        ids, counts = own.merge(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
        first, *rest = np.split(ids, np.cumsum(counts)[:-1])
        final = first[np.cumsum(own.token_len[first]) <= len(head) - own.lookahead].tolist()
        assert final and all(x[: len(final)].tolist() == final for x in rest)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_and_rules(docs):
    b = quality_rules.Block(*block(docs))
    for i, t in enumerate(docs):
        w = WORD.findall(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        got = tuple(int(getattr(b, n)[i]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


def test_cascade_order_changes_nothing():
    b = quality_rules.Block(*block(["word " * 60, "x", "a b c " * 40, "UP CASE " * 50, "## ** " * 60]))
    one = quality_rules.cascade(b, quality_rules.RULES)[0]
    assert (one == quality_rules.cascade(b, quality_rules.RULES[::-1])[0]).all() and not one[1]
    told = quality_rules.Measured({"symbols": 0.1, "capitals": 0.1}, {"n_symbols": 1.0, "n_words": 1.0, "upper_share": 0.5}, {"symbols": frozenset({"n_symbols", "n_words"}), "capitals": frozenset({"upper_share"})}, {4: 10, 8: 10})
    assert [r.name for r in quality_rules.ordered(quality_rules.RULES, told)[:2]] == ["capitals", "symbols"]
    assert [r.name for r in quality_rules.ordered(quality_rules.RULES, told, frozenset({"n_symbols", "n_words"}))[:2]] == ["symbols", "capitals"]
    told.hits = {12: 10, 4: 1}  # what symbols rejects, capitals need not
    assert [r.name for r in quality_rules.ordered(quality_rules.RULES, told)[:2]] == ["capitals", "symbols"]


@settings(max_examples=40, deadline=None)
@given(texts, st.data())
def test_picked_blocks_know_what_whole_ones_know(docs, data):
    b = quality_rules.Block(*block(docs))
    for name in data.draw(st.sets(st.sampled_from(quality_rules.COUNTS))):
        getattr(b, name)
    rows = np.array(sorted(data.draw(st.sets(st.integers(0, max(0, len(docs) - 1))))) if docs else [], np.int64)
    part, fresh = b.pick(rows), quality_rules.Block(*block([docs[i] for i in rows]))
    for name in quality_rules.COUNTS:
        assert getattr(part, name).tolist() == getattr(fresh, name).tolist()


@settings(max_examples=40, deadline=None)
@given(texts)
def test_fingerprints(docs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = []
    for t in docs:
        w = WORD.findall(t.translate(low))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    assert simhash.fingerprints(*block(docs)).tolist() == want


def check_plan(lengths, window):
    hist = np.bincount(np.array(lengths, np.int64), minlength=window + 1)
    p, used, rank = packing.plan(hist, window), {}, Counter()
    for n in lengths:
        seq, off, pos = p.place(np.array([n]), np.array([rank[n]]))
        rank[n] += 1
        parts = [(0, n, int(seq[0]), int(off[0]))] if seq[0] >= 0 else p.cut(int(pos[0]), n)
        assert sum(m for _, m, *_ in parts) == n
        for _, m, s, o in parts:
            used.setdefault(s, []).append((o, m))
    waste = 0
    for spans in used.values():
        at = 0
        for o, m in sorted(spans):
            assert o == at
            at += m
        assert at <= window
        waste += 0 if at & (at - 1) == 0 else window - at
    return waste, sum(lengths)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_packing_plans(lengths):
    assert check_plan(lengths, 64)[0] == 0


def test_packing_hot_length_and_zipf():
    rnd = random.Random(1)
    assert check_plan([1500] * 500, 2048)[0] == 0
    assert check_plan([min(2048, int(rnd.paretovariate(1) * 40)) for _ in range(2000)], 2048)[0] == 0
    assert check_plan([], 2048) == (0, 0)


def test_nnls_solves_an_exact_problem():
    combos = np.array([[[3, 1], [5, 1], [0, 0], [0, 0]], [[4, 2], [0, 0], [0, 0], [0, 0]]])
    assert np.allclose(packing.nnls(combos, np.bincount([3] * 7 + [5] * 7 + [4] * 10, minlength=9).astype(float)), [7, 5], atol=1e-3)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
SECRETS = ["password=hunter22", "PASSWD : 'abcdef'", "token=abc", "é api_key=\"A1b2C3d4\" token: x1234567", "AKIA" + "A1" * 9, "xAKIAABC AKIA" + "B" * 16, "f" * 24 + "g" + "0a" * 11, "deadbeef" * 4, "secretsecret=secret123", "ſecret=abcdefgh", "", "password=\nabcdefg", "tokentoken==abcdef12", "é" * 5 + "api-key=1234567"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*SECRETS, " ", "\n", "x"]), max_size=5).map("".join), max_size=5))
def test_base_spans(docs):
    offsets, data = block(docs)
    got = {(r, data[offsets[r] : s].tobytes().decode(errors="replace").__len__(), k, data[offsets[r] : e].tobytes().decode(errors="replace").__len__()) for r, s, k, e, _, _ in secret_scan.base_spans(offsets, data, data.tobytes())}
    want = set()
    for r, t in enumerate(docs):
        want |= {(r, m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6}
        want |= {(r, m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20}
        want |= {(r, m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24}
    assert got == want


class Held:
    """Texts with secrets, made by another rule than those that the field learns from."""

    CHARS = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789"

    def __init__(self, seed):
        self.r = random.Random(seed)

    def some(self, n, chars=CHARS):
        return "".join(self.r.choice(chars) for _ in range(n))

    def word(self):
        return "".join(self.r.choice(["ka", "lo", "mi", "ter", "son", "an", "qu", "er", "ish", "ble", "un", "st", "ov"]) for _ in range(self.r.randint(1, 4)))

    def text(self):
        r, w = self.r, self.word
        out, spans = " ".join(w() for _ in range(r.randint(5, 40))) + ". ", []
        for _ in range(r.randint(1, 4)):
            if r.random() < 0.5:
                plain = r.random() < 0.3
                v = r.choice([r.choice(["correct", "purple"]) + r.choice(["horse", "lantern"]), self.some(r.randint(6, 10), "0123456789")] if plain else [self.some(r.randint(14, 36)) + "9a", f"gho_{self.some(36)}", f"eyJ{self.some(20)}.{self.some(30)}4", f"sk-live-{self.some(24)}2", f"{self.some(6)}!{self.some(4)}#7"])
                shape = r.choice(["passcode: {v}", "my_pwd={v}", 'DB_PASSPHRASE = "{v}"', "auth pin: {v}"] if plain else ['set smtp_pwd to "{v}"', "passcode:\t{v}", "<credential>{v}</credential>", "deploy-key => '{v}'", "(bearer={v})", "Authorization: Bearer {v}", "export DB_PASSPHRASE={v}", "auth_key = {v}"])
                at = len(out) + shape.index("{v}")
                spans.append((at, at + len(v)))
                out += shape.replace("{v}", v)
            else:
                n = lambda: r.randint(1, 99)
                out += r.choice([f"see figure-{n()}.{n()} of {w()}", f"opened 2021-0{n() % 9}-{n()} by {w()}.{n()}@host{n()}.example.org", f"path = lib64/{w()}2/{w()}.so.6", f"the password of {w()} must be changed", f"a token of friendship and {w()}{w()}", f"key points are {w()}{w()} and more", f"model XR{n()}-{n()}B costs 1200usd", f"release v{n()}.{n()}-rc{n()}", "size: 1920x1080px"])
            out += r.choice([" ", "\n", ", "]) + " ".join(w() for _ in range(r.randint(3, 20))) + r.choice([" ", "\n"])
        return out, spans


def test_field_finds_secrets_of_another_maker():
    field, held = secret_scan.Field().fit(secret_scan.rule_made()), Held(5)
    found = right = wrong = secrets = 0
    for _ in range(250):
        text, spans = held.text()
        got = [(k, text[:0] + text[a:b], a, b) for _, _, k, _, a, b in secret_scan.find(*block([text]), field)]
        hits = {(x, y) for _, _, a, b in got for x, y in spans if min(b, y) - max(a, x) >= 0.8 * (max(b, y) - min(a, x))}
        found, secrets = found + len(hits), secrets + len(spans)
        own = [(a, b) for k, _, a, b in got if k == 3]
        good = sum(any(a < y and b > x for x, y in spans) for a, b in own)
        right, wrong = right + good, wrong + len(own) - good
    assert right > 150 and found >= 0.9 * secrets and right >= 0.95 * (right + wrong)
    text = "see auth = Zx81kQpL0vT3mB7nR2dW for it, and version-1.2.3 of IMG_1234_5JPG"
    assert [text[s:e] for _, s, k, e, _, _ in secret_scan.find(*block([text]), field) if k == 3] == ["Zx81kQpL0vT3mB7nR2dW"]


def test_hints_do_not_cross_rows():
    texts = ["my pass", "word: hunter2222 x", "monkey", "key: abcdefgh9", "pin", "", "auth = Zx81kQpL0vT3"]
    whole = secret_scan.hinted(*block(texts), "".join(texts).encode())
    alone, at = [], 0
    for t in texts:
        alone += [(a + at, b + at) for a, b in secret_scan.hinted(*block([t]), t.encode())]
        at += len(t)
    assert whole == alone and len(whole) == 2


def test_unknown_tokens_behind_hints_are_not_taught():
    text = "pwd: tr0ub4dor99 and then mail7.example.com4 of token = abcdef123456"
    off, data = block([text])
    at = text.index("abcdef")
    got = list(secret_scan.windows(off, data, {0: [(at, at + 12)]}, False))
    assert sorted((t, w) for _, t, w in got) == [([secret_scan.OUT], secret_scan.UNSURE), ([secret_scan.BEGIN], 1.0)]


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(0)
    field = secret_scan.Field(rnd.normal(size=(secret_scan.DIM, 3)), rnd.normal(size=(3, 3)))
    feats = [[1, 5], [2], [9, 7], [4]]
    e, move = field.scores(feats), field.barred(field.move)

    def worth(tags):
        path = [0, *tags, 0]
        return sum(move[a, b] for a, b in zip(path, path[1:])) + sum(e[i, t] for i, t in enumerate(tags))

    every = [(a, b, c, d) for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
    assert tuple(field.viterbi(feats)) == max(every, key=worth)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://www.Example.com/en/x?q", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://b.net/fr/1#t", "b.net", "/fr/1", "net/fr/", "block"), ("http://b.com", "b.com", "", None, "allow"), ("http://xcom/", "xcom", "/", None, "allow"), ("no url", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("http://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"), ("x://net?/es/", "net", "", None, "allow"), ("://net/es/", "net", "/es/", "net/es/", "block"),
    ],
)
def test_urls(url, host, path, rule, verdict):
    assert url_filter.parse(url) == (host, path)
    actions = {h + p: a for a, h, p in url_filter.RULES}
    hit = next((k for k in url_filter.Shape.of(url_filter.RULES).keys(host, path) if k in actions), None)
    assert hit == rule and actions.get(hit, "allow") == verdict


@pytest.fixture(scope="module")
def restorer():
    words = ("idiot moron scum pathetic worthless stupid the thing and other words of a text with more to say about it " * 20 + "idiot stupid scum moron pathetic " * 30).split()
    s = toxicity.letters_of(np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8), toxicity.symbol_table()).astype(np.int64)
    s = np.concatenate([[0, 0], s, [0, 0]])
    return toxicity.Restorer(toxicity.trigram_model(np.bincount((s[:-2] << 12) + (s[1:-1] << 6) + s[2:], minlength=toxicity.SIZE**3)))


@pytest.mark.parametrize("noisy, clean", [("1d10t", "idiot"), ("M0R0N!!", "moron"), ("$cum", "scum"), ("p@th3tic", "pathetic"), ("i.d.i.o.t", "idiot"), ("iiidiooot", "idiot"), ("st*pid", "stupid"), ("the&&&", "the"), ("Words,", "words"), ("", ""), ("12345", "12345")])
def test_restoring(restorer, noisy, clean):
    assert restorer.restore(noisy) == clean


@pytest.mark.parametrize("dense", [1, 3, 1 << 30])
def test_restoring_takes_the_best_of_all_paths(restorer, monkeypatch, dense):
    monkeypatch.setattr(toxicity, "DENSE", dense)
    rnd = random.Random(4)
    for _ in range(40):
        chars = "".join(rnd.choice("abt1i0$@.!ii**  ") for _ in range(rnd.randint(1, 5)))
        lattice, every = restorer.lattice(chars), []

        def go(i, state, total):
            if i == len(lattice):
                every.append(total + restorer.closing(state))
                return
            for s, cost, same in lattice[i]:
                if s < 0 or (s == 0 and state[1] == 0):
                    if not (same and state[1] == 0):
                        go(i + 1, state, total + cost)
                else:
                    go(i + 1, (state[1], s), total + cost + restorer.cube[state[0], state[1], s])

        go(0, (0, 0), 0.0)
        path, end = restorer.best(lattice, (0, 0), True)
        told, at, total = dict(path), (0, 0), 0.0
        for i, edges in enumerate(lattice):
            if i in told:
                total += max(c for s, c, _ in edges if s == told[i]) + restorer.cube[at[0], at[1], told[i]]
                at = (at[1], told[i])
            else:
                total += max(c for s, c, same in edges if (s < 0 and not (same and at[1] == 0)) or (s == 0 and at[1] == 0))
        assert at == end and abs(total + restorer.closing(end) - max(every)) < 1e-6


def test_doubled_letters_and_split_words(restorer):
    assert restorer.restore("stuupid") == "stupid" and restorer.restore("s**pid") == "stupid" and len(restorer.restore("ab" * 2000 + "1")) > 3000
    reader = toxicity.Reader(restorer.cube, {"stup-": 0, "moron": 1})
    rows, got = reader.pairs(*block(["you stu pid thing", "st up", "a mor on x", "m or o n", "words of text", "mor\n\non"]))
    assert sorted(zip(rows.tolist(), got)) == [(0, 0), (1, 0), (2, 1), (3, 1), (5, 1)]


def test_luck_is_no_evidence():
    bad, good = np.array([3.0, 12.0, 40.0]), np.array([0.0, 0.0, 2.0])
    assert toxicity.evident(bad, good, 0.11, 5000).tolist() == [False, True, True]
    assert toxicity.evident(bad, good, 0.11, 5000).tolist() == toxicity.evident(bad, good, 0.11, 5001).tolist()  # whatever the sample's size


def test_spelt_out_words(restorer):
    assert restorer.decode("s t u p i d") == "stupid"
    tokens = ["a", "b", "c", "word"]
    assert toxicity.spelt_runs(tokens, np.array([0, 1, 2, 3, 0, 1]), np.zeros(6, np.int64), np.array([1, 1, 1, 0], bool)) == [(0, 3, "a b c")]


def test_choice_prefers_what_explains():
    rows = [(1, (0, 1)), (1, (0, 2)), (1, (0, 3)), (1, (0,)), (0, (1,)), (0, (2, 3))] * 3
    assert list(toxicity.choose(rows, ["slur-", "rare", "odd", "thing"])) == [0]


def test_trees_learn_and_pages_are_extracted():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = boosting.fit(x, y, trees=30, depth=3)
    assert ((model.log_odds(x) > 0) == (y > 0)).mean() > 0.97
    trees = html_extract.fit()
    held_x, held_y = html_extract.made_pages(60, 99)
    assert ((trees.log_odds(held_x) > 0) == (held_y > 0)).mean() > 0.9
    nav = "<nav><ul>" + "<li><a href='/a'>Menu item</a></li>" * 6 + "</ul></nav>"
    page = f"<html><head><title>T</title><script>var a='</p>';</script></head><body>{nav}<div class='cookie-notice'>We use cookies on this site.</div><article><h1>A title here</h1><p>First&nbsp;para &amp; more words in it, enough to be read.<p>Second para<b> bold</b>er text that goes on for some time.<aside class='ad'>Buy now</aside></article><div class='comments'><div class='comment'><b>Bob</b><p>I agree with this.</p></div></div><footer>&copy; 2024 Site</footer></body></html>"
    got = html_extract.extract_pages([page, "", "plain <b>text", "<p>" * 3000, "<a <b"], trees)
    assert got[0] == "A title here First para & more words in it, enough to be read. Second para bolder text that goes on for some time."
    assert got[1] == "" and got[3] == ""


def test_decoding_has_no_kept_below_dropped():
    page = html_extract.Page("<div><div>a</div><div>b<p>c</p></div></div>")
    for seed in range(20):
        odds = np.random.default_rng(seed).normal(size=len(page.tag)) * 3
        kept = html_extract.decode(page, odds)
        assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])


def test_decoding_is_the_best_labelling():
    page = html_extract.Page("<div>w<div>a</div><div>b<p>c<p>d</div></div><section>e<p>f</p></section>")
    n = len(page.tag)
    some = [any(page.end[i] > k >= i and t.strip() for k, t, _ in page.pieces) for i in range(n)]
    stick = [html_extract.STICK if p > 0 and page.parent[p] > 0 else 0.0 for p in page.parent]
    for seed in range(25):
        odds = np.random.default_rng(seed).normal(size=n) * 3

        def worth(kept):
            total = 0.0
            for i in range(n):
                total += (-np.log1p(np.exp(-odds[i])) if kept[i] else -np.log1p(np.exp(odds[i]))) if some[i] else 0.0
                total += stick[i] if i and kept[i] and kept[page.parent[i]] else 0.0
            return total

        every = [k for k in itertools.product([True], *[[True, False]] * (n - 1)) if all(k[page.parent[i]] for i in range(1, n) if k[i])]
        best = max(every, key=worth)
        if any(best[k] and t.strip() for k, t, _ in page.pieces):
            assert worth(html_extract.decode(page, odds)) == pytest.approx(worth(best))


@pytest.mark.parametrize(
    "part, times, tail",
    [('<a "x ', 800_000, ""), ("<a 'x <b \"y ", 200_000, ">"), ("<a", 1_000_000, ""), ("<a", 1_000_000, ">"), ("<p>", 100_000, "x"), ("<i><b>", 100_000, "</i>" * 100_000), ("<div>", 50_000, "</p></i>" * 50_000), ("<script></script", 200_000, ""), ("<!--", 500_000, ""), ("&", 1_000_000, "")],
)
def test_broken_pages_take_linear_time(part, times, tail):
    began = time.process_time()
    html_extract.Page(part * times + tail)
    assert time.process_time() - began < 20


def test_ends_of_tags():
    for html, end in (("<a b>c", 5), ("<a 'x>' y>c", 10), ("<a 'x>c", 6), ("<a 'x\">c'>d\"", 10), ("<a 'x\">c", 7)):
        ends = html_extract.Ends(html)
        assert ends.of(2) == end
        slow = html_extract.Ends(html)
        slow.stops = [m.start() for m in html_extract._STOPS.finditer(html)]
        assert slow.of(2) == end and slow.of(2) == end


def test_blocks_cover_rows():
    off = np.array([0, 5, 5, 30, 31, 90])
    parts = list(K.blocks(off, 20))
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert zlib.crc32(b"") == 0
