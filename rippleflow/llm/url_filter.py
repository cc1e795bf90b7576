"""URL filtering by a cascade of Bloom filters, exact over the corpus's whole key universe.

Every url offers keys: each host suffix with each path beginning that a rule could name. The
distinct keys of all urls are the universe. Level 1 of the cascade holds the listed keys;
level 2 the unlisted keys of the universe that level 1 takes for listed; level 3 the listed
keys that level 2 takes for false; and so on until a level errs no more. A key's first level
that does not know it tells whether it is listed, for every key of the universe and with no
join. Each level is one pass over the keys that are still in doubt, whose number falls by the
level's false positive rate; a level's size is set by the number of keys it holds.

One cascade tells listed from unlisted keys, a second one block rules from allow rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K

#: (action, host, path): the host and its subdomains, paths that begin with the path.
Rule = tuple[str, str, str]
RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parse(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:end].translate(_UPPER), rest[end:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return host, tail[:stop]


@dataclass(frozen=True)
class Shape:
    """What a rule's key can look like: bounds the keys that a url offers by the rule list, not by the url."""

    labels: int  # most labels of a rule's host
    lengths: tuple[int, ...]  # lengths of the rules' paths

    @staticmethod
    def of(rules: list[Rule]) -> "Shape":
        return Shape(max((h.count(".") + 1 for _, h, _ in rules), default=0), tuple(sorted({len(p) for *_, p in rules}, reverse=True)))

    def keys(self, host: str, path: str) -> list[str]:
        """The url's keys, longest first."""
        if not host:
            return []
        labels = host.split(".")
        hosts = [".".join(labels[-n:]) for n in range(min(self.labels, len(labels)), 0, -1)]
        out = [h + path[:n] for h in hosts for n in self.lengths if n <= len(path)]
        return sorted(dict.fromkeys(out), key=lambda k: (-len(k), k))


def _hash(key: str, seed: int) -> tuple[int, int]:
    d = xxhash.xxh128_intdigest(key.encode(), seed)
    return d >> 64, d & 0xFFFFFFFFFFFFFFFF | 1


@dataclass
class Level:
    bits: np.ndarray  # bytes
    size: int
    hashes: int
    seed: int

    @staticmethod
    def of(keys: list[str], rate: float, seed: int) -> "Level":
        size = max(64, math.ceil(len(keys) * -math.log(rate) / math.log(2) ** 2))
        level = Level(np.zeros((size + 7) // 8, np.uint8), size, max(1, round(-math.log2(rate))), seed)
        for k in keys:
            for i in level.spots(k):
                level.bits[i >> 3] |= 1 << (i & 7)
        return level

    def spots(self, key: str) -> list[int]:
        a, b = _hash(key, self.seed)
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self.spots(key))


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        """Whether a key of the universe is listed."""
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1

    @property
    def n_bits(self) -> int:
        return sum(x.size for x in self.levels)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that a level takes for its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [k for k in batch.column(0).to_pylist() if k in level]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["key"])

    return K.map_arrow(keys, run, "key string")


def build(universe: DataFrame, listed: list[str], unlisted_count: int) -> Cascade:
    """The cascade of the listed keys over a universe of distinct keys (column key).

    The first level's rate is listed / unlisted, so that about as many keys stay in doubt as are
    listed, however large the universe; later levels halve. What comes to the driver is the keys of
    one level: as many as the caller's list, which is there already.
    """
    own = sorted(set(listed))
    cascade, known = Cascade(), frozenset(own)
    if not own:
        return cascade
    rate = min(0.5, len(own) / max(1, unlisted_count))
    level = Level.of(own, rate, 1)
    cascade.levels.append(level)
    doubt = K.stored(_passing(universe, level).where(~F.col("key").isin(*own)) if len(own) <= 1000 else _passing(universe, level).join(universe.sparkSession.createDataFrame([(k,) for k in own], "key string"), "key", "left_anti"))
    wrong = [r["key"] for r in doubt.collect()]  # about as many as are listed
    inside, outside = own, wrong
    while outside:
        level = Level.of(outside, 0.5, len(cascade.levels) + 1)
        cascade.levels.append(level)
        inside, outside = outside, [k for k in inside if k in level]
    assert all(k in cascade for k in known)
    return cascade


def url_keys(pages: DataFrame, shape: Shape, url: str = "url") -> DataFrame:
    """The distinct keys of all urls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for u in batch.column(0).to_pylist() for k in shape.keys(*parse(u))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    return K.map_arrow(pages.select(F.col(url).cast("string").alias("url")), run, "key string").distinct()


def judge(pages: DataFrame, rules: list[Rule], keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (host and path of the longest rule that fits, else null) and verdict.

    A url that no rule fits is not listed, which the cascade proves; its verdict is the default.
    A null url or one without :// has an empty host and path and fits no rule. Rows stay as they
    are, repeated ones too; an empty table gives no rows.
    """
    shape = Shape.of(rules)
    actions = {h + p: a for a, h, p in rules}
    universe = K.stored(url_keys(pages, shape, url))
    total = universe.count()
    listed = build(universe, list(actions), total)
    blocked = build(universe.where(F.col("key").isin(*actions)), [k for k, a in actions.items() if a == "block"], len(actions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bool] = {}
        for batch in batches:
            if len(seen) > 500_000:
                seen.clear()
            host, path, rule, verdict = [], [], [], []
            for u in batch.column(batch.num_columns - 1).to_pylist():
                h, p = parse(u)
                hit = None
                for k in shape.keys(h, p):
                    if (known := seen.get(k)) is None:
                        known = seen[k] = k in listed
                    if known:
                        hit = k
                        break
                host.append(h)
                path.append(p)
                rule.append(hit)
                verdict.append(default if hit is None else "block" if hit in blocked else "allow")
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], names=[*keep, "host", "path", "rule", "verdict"])

    src = pages.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{url}`").cast("string").alias("_url"))
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return K.map_arrow(src, run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "host string, path string, rule string, verdict string"]))


#: DuckDB SQL for judge() with RULES over `pages`.
ORACLE = """
WITH parsed AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS n
  FROM hosts JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
), best AS (SELECT DISTINCT page_id, rule, action FROM fits WHERE n = 1)
SELECT hosts.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM hosts LEFT JOIN best USING (page_id)
"""
