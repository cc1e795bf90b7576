"""Operators on Spark: odd rows, empty tables, clashing columns, and brute force on small tables."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rippleflow.llm import bpe, html_extract, packing, quality_classifier, quality_rules, secret_scan, simhash, syncmers, url_filter
from rippleflow.llm.queries import ORACLES, QUERIES, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, fp long, rank long, _key string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus():
    """(doc_id, text, quality, toxic) rows of a small corpus with every kind of document."""
    rows = []
    for i in range(160):
        text, q, t = words(i, 90) + ".", 1, 0
        if i % 4 == 0:
            text, t = f"{words(i, 40)} you {('idiot', 'id1ot', 'i.d.i.o.t')[i % 3]} and {('scum', '$cum')[i % 2]} {words(i + 999, 40)}", 1
        elif i % 7 == 3:
            text, q = " ".join(w + random.Random(i).choice(["***", "&&&", "$$$"]) for w in words(i, 90).split()), 0
        rows.append((i, text, q, t))
    rows += [(200 + k, rows[1][1] + (" one" if k else ""), 1, 0) for k in range(3)]  # copies, exact and near
    rows += [(300, f"{words(7000, 80)} password = hunter2222 {words(7001, 20)}", 1, 0), (301, words(8000, 30000), 1, 0)]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = corpus()
    docs = [(i, t, "en", f"src{i % 5}", len(t), 0.5, True, 1, 2, "k") for i, t, _, _ in rows]
    odd = [(400, None, None, None, None, None, None, None, None, None), (401, "", "en", "src1", 0, 0.1, False, 1, 1, "k"), (402, " \n\t", "", "", 3, 0.1, False, 1, 1, "k"), (None, "no id at all", "en", "src1", 12, 0.0, True, 0, 0, "k")]
    odd += [(403, "a b", "en", "src2", 3, 0.0, True, 0, 0, "k")] * 2  # a repeated row
    spark.createDataFrame(docs + odd, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (999, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    html = "<html><body><nav><ul><li><a href='/x'>Menu</a></li><li><a href='/y'>More</a></li></ul></nav><article><h1>Title words</h1><p>" + words(1, 60) + "</p></article><footer>&copy; x</footer></body></html>"
    pages = [(1, "https://www.example.com/en/a", html), (2, None, None), (3, "http://a.net/fr/", ""), (3, "http://a.net/fr/", ""), (None, "x", "<p>" + words(2, 50))]
    clash = "text string, n_chars long, host string, path string, rule string, verdict string, _html string, _url string"
    spark.createDataFrame([(*p, "t", 1, "h", "p", "r", "v", "h", "u") for p in pages], f"page_id long, url string, html string, {clash}").write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    return str(root)


def result(spark, name, where):
    return [r.asDict() for r in QUERIES[name](spark, where).collect()]


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert result(spark, name, empty) == []


def docs_of(spark, tables):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]


def test_toxicity(spark, tables):
    got = result(spark, "op1_toxicity", tables)
    truth = {i: t for i, _, _, t in corpus()}
    assert len(got) == len(docs_of(spark, tables)) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert {r["predicted"] for r in got if r["doc_id"] in (400, 401, 402, 403, None)} == {0}


def test_secrets(spark, tables):
    got = {r["doc_id"]: r for r in result(spark, "op2_crf_secrets", tables)}
    text = dict(docs_of(spark, tables))[300]
    at = text.index("password")
    assert got[300]["n_assign"] == 1 and f"assign:{at}:{at + len('password = hunter2222')}" in got[300]["spans"]
    assert got[400]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[400]["spans"] == ""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    safe = secret_scan.scan(docs, secret_scan.Field(), ["doc_id"]).where("doc_id = 300").first().redacted_text
    assert "password = [SECRET] " in safe and "hunter2222" not in safe


def test_urls(spark, tables):
    got = sorted((str(r["page_id"]), r["rule"], r["verdict"]) for r in result(spark, "op3_url_cascade", tables))
    assert got == sorted([("1", "www.example.com/en/", "allow"), ("2", None, "allow"), ("3", "net/fr/", "block"), ("3", "net/fr/", "block"), ("None", None, "allow")])
    assert "op3_url_cascade" in ORACLES


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(4000)]
    listed = keys[::37]
    c = url_filter.build(spark.createDataFrame([(k,) for k in keys], "key string"), listed, len(keys))
    assert [k for k in keys if k in c] == listed and len(c.levels) > 1 and c.n_bits < 40 * len(listed)


def test_bpe(spark, tables):
    library = Tokenizer.from_file(vocabulary_path())
    got = {(r["doc_id"], r["decoded_sha256"]): r for r in result(spark, "op4_bpe_transducer", tables)}
    for i, t in docs_of(spark, tables):
        r, ids = got[i, hashlib.sha256(t.encode()).hexdigest()], library.encode(t, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    long = bpe.encode_decode(spark.read.parquet(f"{tables}/documents.parquet").where("doc_id = 301"), vocabulary_path(), ["doc_id"], step=1000).first()
    assert long.ids_sha256 == got[301, long.decoded_sha256]["ids_sha256"]  # in rounds of another size


def covers(rows, docs):
    library = Tokenizer.from_file(vocabulary_path())
    need = {}
    for i, t in docs:
        need.setdefault(i, []).append(np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4"))
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(need)
    import zlib

    for i, pieces in by.items():
        assert sum(p["length"] for p in pieces) == sum(len(x) for x in need[i])
        if len(need[i]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(need[i][0][at : at + p["length"]].tobytes()) and p["doc_tokens"] == len(need[i][0])
                at += p["length"]
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    waste = 0
    for spans in seqs.values():
        at = 0
        for o, m in sorted(spans):
            assert o == at
            at += m
        assert at <= 2048
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    return waste


def test_packing(spark, tables, monkeypatch):
    assert covers(result(spark, "op5_nnls_packing", tables), docs_of(spark, tables)) == 0
    monkeypatch.setattr(packing, "BROADCAST_OFFSETS", 0)  # the way without a broadcast
    assert covers(result(spark, "op5_nnls_packing", tables), docs_of(spark, tables)) == 0


def test_rules(spark, tables):
    got = {r["doc_id"]: r for r in result(spark, "op6_rule_cascade", tables)}
    assert all(got[i]["kept"] == bool(q) for i, _, q, _ in corpus()) and got[400]["base_failed"] and got[400]["n_words"] == 0
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    full = {r.doc_id: r.kept for r in quality_rules.keep_rows(docs, quality_rules.RULES, ["doc_id"]).collect()}
    assert full == {k: r["kept"] for k, r in got.items()}


def components(prints):
    roots = {f: f for f in prints}

    def find(f):
        while roots[f] != f:
            f = roots[f]
        return f

    every = list(prints)
    for i, a in enumerate(every):
        for b in every[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                roots[max(x, y)] = min(x, y)
    return {f: find(f) for f in every}


@pytest.mark.parametrize("hot", [512, 1])
def test_links_against_brute_force(spark, hot):
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(prints)[:25]:  # families within few bits, and such that share a whole segment
        for _ in range(5):
            prints.add(f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))))
            prints.add(f ^ (rnd.getrandbits(32) << 32))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    got = {frozenset((r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in simhash.links(nodes, hot_entry=hot).collect()}
    every = list(prints)
    assert got == {frozenset((a, b)) for i, a in enumerate(every) for b in every[:i] if bin(a ^ b).count("1") <= 3}


def test_simhash(spark, tables):
    got = result(spark, "op7_simhash_mih", tables)
    docs = docs_of(spark, tables)
    assert len(got) == len(docs)
    prints = {}
    for r in got:
        prints.setdefault(int(r["fingerprint"], 16), []).append(r)
    root, least = components(prints), {}
    for f, rows in prints.items():
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        least[root[f]] = min([*ids, *([least[root[f]]] if least.get(root[f]) is not None else [])], default=None)
    assert all(r["component_id"] == least[root[f]] for f, rows in prints.items() for r in rows)
    assert prints[0] and {r["doc_id"] for r in prints[0]} == {400, 401, 402}


def test_extraction(spark, tables):
    got = {r["page_id"]: r for r in result(spark, "op8_dom_trees", tables)}
    assert got[1]["text"] == "Title words " + words(1, 60) and got[2]["text"] == got[3]["text"] == "" and got[1]["n_chars"] == len(got[1]["text"])
    assert html_extract.extract(spark.read.parquet(f"{tables}/pages.parquet"), html_extract.fit(), ["page_id", "url"]).count() == 5


def test_syncmers(spark, tables):
    got = result(spark, "op9_closed_syncmers", tables)
    docs = sorted(docs_of(spark, tables), key=lambda d: (d[0] is None, d[0], d[1]))
    assert len(got) == len(docs)
    want = sorted((len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + docs[(k + 1) % len(docs)][1][: len(t) // 2]).encode()).hexdigest()) for k, (_, t) in enumerate(docs))
    assert sorted((r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[200]["fingerprint"] != by[2]["fingerprint"] and by[400]["fingerprint"] == ""
    assert 0.2 < by[5]["near_edited"] < 0.5 and by[5]["near_next"] < 0.05 and by[201]["near_next"] == 1.0
    rows = sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_chars"]))
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        whole, edited, following = (marked(x) for x in (t, t[: len(t) - len(t) // 2] + after[: len(t) // 2], after))
        r = rows[k]
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("".join(f"{x:08x}" for x in whole), "".join(f"{x:08x}" for x in edited)), i
        for name, other in (("near_edited", edited), ("near_next", following)):
            a, b = {x & ~3 for x in whole}, {x & ~3 for x in other}
            assert r[name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def hashed(*parts):
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<Q", x), seed)
    return seed


def marked(text):
    """The fingerprint by the definition, run by run."""
    units = [u for w in re.findall(r"[^\x20\x09-\x0D]+", text) for u in (w if len(w) > syncmers.LONG_WORD else [w])]
    w = [hashed(u) for u in units]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    if len(w) < 5:
        return [hashed(" ".join(str(signed(x)) for x in w)) >> 32 & 0xFFFFFFFC | 1] if w else []
    out, last = [], -1
    for i in range(len(w) - 4):
        inner = [hashed(w[j], w[j + 1]) for j in range(i, i + 4)]
        least = min(map(signed, inner))
        if least in (signed(inner[0]), signed(inner[3])):
            assert 1 <= i - last <= 3
            out.append(hashed(inner[0], inner[2], w[i + 4]) >> 32 & 0xFFFFFFFC | i - last)
            last = i
    return out


def test_fingerprints_do_not_jump(spark):
    """A word more changes a few anchors, wherever the words' mean length stands; long texts share what they share."""
    long, core = "x" * 41 + " " + words(3, 40), words(9, 60)
    texts = [long, long + " y", words(4, 6000) + " " + core + " " + words(5, 6000), words(6, 6000) + " " + core + " " + words(7, 6000), "漢字仮名交じり文" * 20, "漢字仮名交じり文" * 19 + " z"]
    df = syncmers.fingerprint(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", "fp")
    fp = {r.id: {x & ~3 for x in r.fp} for r in df.collect()}
    assert len(fp[0] & fp[1]) >= len(fp[0]) - 2 and len(fp[2] & fp[3]) > 15 and len(fp[4] & fp[5]) > 0


def test_anchors_do_not_depend_on_context(spark):
    core = words(77, 60)
    df = spark.createDataFrame([(1, core), (2, words(1, 30) + " " + core + " " + words(2, 30)), (3, None), (4, "x" * 500)], "doc_id long, text string")
    rows = {}
    for r in syncmers.anchors(df, ["doc_id"]).collect():
        rows.setdefault(r.doc_id, []).append((r.place, r.anchor))
    assert {(p + 30, a) for p, a in rows[1]} <= set(rows[2]) and 3 not in rows
    inner = len(rows[1]) / 56
    assert 0.3 < inner < 0.75 and len(rows[4]) > 0


def test_quality(spark, tables):
    got = {r["doc_id"]: r for r in result(spark, "op10_empirical_bayes_quality", tables)}
    held = [(r, q) for i, _, q, _ in corpus() if (r := got[i])["held_out"]]
    assert sum(r["predicted"] == q for r, q in held) / len(held) > 0.95
    assert all(0 <= got[i]["score"] <= 1 for i in (400, 401, 402, None)) and all(r["kept"] for i, r in got.items() if i is not None and i < 160 and r["predicted"])


def test_posteriors_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, h, p, min(max(r.gauss(0.2 + 0.05 * "abcde".index(h) + (0.5 if p == "x" else 0), 0.1), 0.01), 0.99)) for i in range(400) for h, p in [(r.choice("aabcde"), r.choice("xyz"))]] + [(400, None, "x", 0.5), (401, "f", None, 0.9)]
    got = {x.id: x for x in quality_classifier.shrink(spark.createDataFrame(rows, "id long, host string, path string, evidence double"), "host", "path").collect()}
    mean = sum(e for *_, e in rows) / len(rows)

    def weight(groups, prior):
        """Method of moments: groups {key: values}, prior by key."""
        n = {k: len(v) for k, v in groups.items()}
        spread = sum(n[k] * (sum(v) / n[k] - prior(k)) ** 2 for k, v in groups.items()) - sum(prior(k) * (1 - prior(k)) for k in groups)
        between = spread / max(sum(n.values()) - sum(x * x for x in n.values()) / sum(n.values()), 1e-9)
        return between

    hosts, sites = {}, {}
    for _, h, p, e in rows:
        hosts.setdefault(h, []).append(e)
        sites.setdefault((h, p), []).append(e)
    b = weight(hosts, lambda k: mean)
    k = min(max(mean * (1 - mean) / b - 1, 1.0), 1e6) if b > 1e-9 else 1e6
    for i, h, p, e in rows:
        host = (sum(hosts[h]) - e + k * mean) / (len(hosts[h]) - 1 + k)
        assert got[i].host_posterior == pytest.approx(host)
    # the paths' weight is one number for all: it follows from any document, and explains all others
    ks = {round((sum(sites[h, p]) - e - got[i].path_posterior * (len(sites[h, p]) - 1)) / (got[i].path_posterior - got[i].host_posterior), 4) for i, h, p, e in rows if abs(got[i].path_posterior - got[i].host_posterior) > 1e-3}
    assert max(ks) - min(ks) < 1e-2 * max(ks) and min(ks) >= 1
    logit = lambda x: np.log(x / (1 - x))
    for i, h, p, e in rows:
        z = logit(e) - logit(mean) + logit(got[i].path_posterior)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_samples_are_bounded_and_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 7, f"t{i}") for i in range(70)], "doc_id long, text string")
    from rippleflow.llm import _kernel as K

    one = sorted(r.text for r in K.sampled(df, "doc_id", 5).collect())
    assert len(one) == 5 and one == sorted(r.text for r in K.sampled(df.repartition(6), "doc_id", 5).collect())


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.1)] * 300 + [("good", "p", 0.95)] * 300 + [("tiny", "p", 0.1)] + [("mid", f"q{i}", 0.9 if i % 2 else 0.2) for i in range(60)]
    out = quality_classifier.shrink(spark.createDataFrame(rows, "host string, path string, evidence double"), "host", "path").groupBy("host").agg(F.avg("host_posterior").alias("p")).collect()
    p = {r.host: r.p for r in out}
    assert p["big"] < 0.2 and p["good"] > 0.9 and 0.3 < p["tiny"] < 0.8


def test_pipeline(spark, tables, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "simhash_near_dedup", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.K.stored(stage(spark, at, tables))
        assert at.columns == docs.columns, name
        kept.append({r.doc_id for r in at.collect()})
    toxic, poor = {i for i, _, _, t in corpus() if t}, {i for i, _, q, _ in corpus() if not q}
    clean = {i for i, _, q, t in corpus() if q and not t}
    assert not kept[0] & toxic and clean <= kept[0] and not kept[1] & poor and clean <= kept[1]
    assert clean - {200, 201, 202} <= kept[2] and not {200, 201, 202} & kept[2]  # one of each group stays
    rows = {r.doc_id: r for r in at.collect()}
    assert "[SECRET]" in rows[300].text and rows[300].n_chars == len(rows[300].text) and len(rows) == at.count()
    packed = [r.asDict() for r in corpus_pipeline.run(spark, tables).collect()]
    assert covers(packed, [(i, r.text or "") for i, r in rows.items()]) == 0
    assert corpus_pipeline.run(spark, empty).count() == 0
