"""Quality by hierarchical empirical Bayes.

A logistic regression on a text's own make-up gives each document's evidence. Hosts and their
paths have rates of good documents; the prior of a host is the whole corpus's, the prior of a
path its host's, and how far sparse sites shrink toward their prior follows from how much the
rates differ between sites (method of moments). A document's score is its evidence with the
site's posterior rate in place of the corpus's, the document itself left out of that rate.

All statistics are sums by (host, path) over the whole corpus, combined before the shuffle; texts
are read once and never shuffled. Only the regression is fitted on a bounded labelled sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from .quality_rules import Block

#: Bound of the labelled sample that the regression is fitted on.
MAX_TRAIN = 12_000
#: Documents with a lower score are rejected.
THRESHOLD = 0.4
#: Sites up to which their statistics are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SITES = 500_000
FEATURES = ("log_words", "short", "symbols", "many_symbols", "repeated", "mostly_repeated", "dup_lines", "capitals", "mostly_capitals", "word_length")


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Rows of FEATURES; an empty text has zeros but for short."""
    b = Block(offsets, data)
    n = np.maximum(1, b.n_words)
    symbols, repeated, dup = b.n_symbols / n, b.n_repeat_words / n, b.n_dup_lines / np.maximum(1, b.n_lines)
    cols = [np.log1p(b.n_words), b.n_words < 5, np.minimum(symbols, 4), symbols > 0.2, repeated, repeated > 0.5, dup, b.upper_share, b.upper_share > 0.5, np.minimum(b.word_chars / n, 40)]
    return np.stack([np.asarray(c, float) for c in cols], axis=1)


class Regression:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, within six deviations: no text is judged by extrapolation."""
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        z = self.standard(x) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -20, 20)))

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 50) -> "Regression":
        """Damped Newton steps with a ridge; without both labels, the smoothed base rate for every text."""
        rate = (y.sum() + 1) / (len(y) + 2)
        mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(y) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        scale = np.where(scale < 1e-3, 1e9, scale)  # what is constant in the sample has no say
        w = np.zeros(x.shape[1] + 1)
        w[-1] = np.log(rate / (1 - rate))
        if len(y) and 0 < y.sum() < len(y):
            a = np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])
            ridge = np.diag([decay] * x.shape[1] + [1e-2])

            def loss(w: np.ndarray) -> float:
                z = a @ w
                return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * w @ ridge @ w)

            now = loss(w)
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
                size = 1.0
                while size > 1e-6 and loss(w + size * step) > now:  # a full step can overshoot where labels are separable
                    size /= 2
                w = w + size * step
                before, now = now, loss(w)
                if before - now < 1e-7 * (1 + abs(now)):
                    break
        return Regression(mean, scale, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Regression:
    """The regression of at most limit labelled documents of the training folds, spread by hash; one row for each doc_id."""
    one = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    one = one.where(K.fold(F.col("_id")) != 1).groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(one), F.col("doc_id") == F.col("_id"))  # at most `limit` ids
    train = K.one_each(rows.select("doc_id", "text", "y"), "doc_id").select("text", "y")

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        return {"x": pa.array(list(features(offsets, data)), pa.list_(pa.float64()))}

    rows = K.map_text(train, kernel, "x array<double>", ["y"]).collect()  # at most `limit` short rows
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in rows], float)
    order = np.lexsort([*x.T, y]) if len(y) else np.zeros(0, int)
    return Regression.of(x[order], y[order])


def evidence(docs: DataFrame, model: Regression, keep: list[str]) -> DataFrame:
    """Adds evidence, the regression's probability, to the columns keep."""

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        return {"evidence": pa.array(model.evidence(features(offsets, data)), pa.float64())}

    return K.map_text(K.cast_text(docs, keep), kernel, "evidence double", keep)


def concentration(n: Column, total: Column, mean: Column) -> Column:
    """Aggregate: the beta prior's weight, by moments, of groups with n documents whose evidence sums to total.

    The variance between the groups' rates, less what groups of their sizes show by chance, against
    mean * (1 - mean). Groups that differ no more than by chance shrink all the way (a weight of 1e6).
    """
    rate = total / n
    chance = F.sum(mean * (1 - mean))
    spread = F.sum(n * (rate - mean) ** 2)
    between = (spread - chance) / F.greatest(F.sum(n) - F.sum(n * n) / F.sum(n), F.lit(1e-9))
    base = F.first(mean * (1 - mean))
    return F.when((between > 1e-9) & (base > 1e-9), F.least(F.greatest(base / between - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))


def shrink(judged: DataFrame, host: str, path: str) -> DataFrame:
    """Adds host_posterior, path_posterior and score to rows with evidence, a host and a path."""
    sites = judged.groupBy(F.col(host).alias("_h"), F.col(path).alias("_p")).agg(F.count("*").cast("double").alias("n"), F.sum("evidence").alias("s"))
    sites = K.stored(sites)
    hosts = sites.groupBy("_h").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("hosts")).first()
    if not whole["n"]:
        zero = F.lit(0.0)
        return judged.select("*", zero.alias("host_posterior"), zero.alias("path_posterior"), zero.alias("score"))
    mean = min(max(whole["s"] / whole["n"], 1e-6), 1 - 1e-6)
    weight = hosts.agg(concentration(F.col("hn"), F.col("hs"), F.lit(mean)).alias("k")).first()["k"]
    joined = _with_hosts(sites, hosts)
    rates = joined.withColumn("rate", (F.col("hs") + weight * mean) / (F.col("hn") + weight))
    inner = rates.agg(concentration(F.col("n"), F.col("s"), F.col("rate")).alias("k"), F.count("*").alias("sites")).first()
    side = joined.select("_h", "_p", "n", "s", "hn", "hs")
    if inner["sites"] <= BROADCAST_SITES:
        side = F.broadcast(side)
    # the document itself is left out of its site's rate
    out = judged.join(side, judged[host].eqNullSafe(side["_h"]) & judged[path].eqNullSafe(side["_p"]))
    e = F.col("evidence")
    host_rate = (F.col("hs") - e + weight * mean) / (F.col("hn") - 1 + weight)
    out = out.withColumn("host_posterior", host_rate)
    out = out.withColumn("path_posterior", (F.col("s") - e + inner["k"] * F.col("host_posterior")) / (F.col("n") - 1 + inner["k"]))

    def logit(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))

    z = logit(e) - logit(F.lit(mean)) + logit(F.col("path_posterior"))
    return out.withColumn("score", 1 / (1 + F.exp(-z))).drop("_h", "_p", "n", "s", "hn", "hs")


def _with_hosts(sites: DataFrame, hosts: DataFrame) -> DataFrame:
    other = hosts.withColumnRenamed("_h", "_host")
    return sites.join(other, sites["_h"].eqNullSafe(other["_host"])).drop("_host")


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, limit: int = MAX_TRAIN) -> DataFrame:
    """doc_id, host, path, held_out, evidence, host_posterior, path_posterior, score, predicted, kept.

    A null host or path is a site of its own. Null and empty texts are judged by their (zero)
    features. Repeated rows count as often as they stand. A null doc_id is in fold 0. Of labels that
    contradict each other, 1 holds. An empty table gives no rows.
    """
    model = fit(docs, labels, limit)
    named = docs.select("doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path"))
    judged = K.stored(evidence(named, model, ["doc_id", "host", "path"]))
    out = shrink(judged, "host", "path")
    kept = F.col("score") >= threshold
    return out.select("doc_id", "host", "path", (K.fold(F.col("doc_id")) == 1).alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", kept.cast("int").alias("predicted"), kept.alias("kept"))
