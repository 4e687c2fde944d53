"""Quality classifier with hierarchical empirical Bayes (operator 5).

A logistic regression on surface features gives each document's evidence.
Grouped aggregation turns the evidence of all documents into a posterior mean
for every host, shrunk toward the global mean, and for every path of a host,
shrunk toward the host's.  How strongly comes from the spread of the means
(method of moments), so sparse sites lean on their parent.  A document's final
odds are its own, moved from the global prior to that of its path without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import layout, steps
from .scratch import Scratch
from .shingles import word_hashes
from .worker import released

#: Labelled documents that the regression is fitted on, at most.
SAMPLE = 12_000
#: Documents below this probability are rejected.
KEEP = 0.5

# Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 exclamation and question, 8 bar, 9 symbol, 10 beyond ASCII.
CLASS = np.zeros(256, np.int64)
for _number, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b" \t"), (5, b"\r\n"), (6, b".,;:'\"()-"), (7, b"!?"), (8, b"|"), (9, b"#*&%$@^~_<>{}[]\\/=+`"), (10, range(128, 256))):
    CLASS[[*_bytes]] = _number


def features(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of surface features of each text: shares of byte classes and repetition of words."""
    words, owner = word_hashes(raw, ends)
    cuts = np.searchsorted(owner, np.arange(len(ends))).tolist()
    out = np.zeros((len(ends) - 1, 18))
    kinds = CLASS[raw[ends[0] : ends[-1]]].astype(np.int8)
    bounds = (ends - ends[0]).tolist()
    for i, (a, b, x, y) in enumerate(zip(bounds, bounds[1:], cuts, cuts[1:], strict=False)):
        counts = np.bincount(kinds[a:b], minlength=11)
        size, own = max(1, b - a), words[x:y]
        n = max(1, y - x)
        row = out[i]
        row[:11] = counts / size
        row[11] = counts[2] / max(1, counts[1] + counts[2])
        row[12] = np.log1p(y - x)
        row[13] = min(20.0, (b - a) / n)
        if y > x:
            ordered = np.sort(own)
            fresh = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
            row[14] = (own[1:] == own[:-1]).mean() if y - x > 1 else 0
            row[15] = (len(fresh) - 1) / n
            row[16] = np.diff(fresh).max() / n
        row[17] = (counts[7] + counts[8] + counts[9]) / n
    return out


def expanded(rows: np.ndarray) -> np.ndarray:
    """Features with square roots of the shares, which tell small shares apart."""
    return np.concatenate([rows, np.sqrt(np.maximum(rows, 0)), rows**2], axis=1)


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0):
        x = expanded(rows)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
        self.weights = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (p - labels) + penalty * self.weights
            curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            self.weights -= step
            if np.abs(step).max() < 1e-6:
                break

    def probability(self, rows: np.ndarray) -> np.ndarray:
        x = (expanded(rows) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -12, 12)))


def fit(docs: DataFrame, labels: DataFrame) -> Logistic | None:
    """Fit on SAMPLE labelled documents at most, those with the smallest hashes; None without both classes."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    @F.arrow_udf("array<double>")
    @released
    def described(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            raw, ends = layout(column)
            made = [row for at, to in steps(ends) for row in features(raw, ends[at : to + 1]).tolist()]
            yield pa.array(made, pa.list_(pa.float64()))

    once = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # a repeated doc_id counts once
    found = once.select("doc_id", "quality", described(F.col("text")).alias("x")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    y = np.array([r["quality"] > 0 for r in found], float)
    if not len(y) or y.min() == y.max():
        return None
    return Logistic(np.array([r["x"] for r in found]), y)


def evidence(model: Logistic | None, text: str = "text") -> Column:
    """Probability of good quality from a text alone; 0.5 without a model, 0 for null and empty texts."""

    @F.arrow_udf("double")
    @released
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            raw, ends = layout(column)
            made = [np.zeros(0)]
            for at, to in steps(ends):
                p = model.probability(features(raw, ends[at : to + 1])) if model else np.full(to - at, 0.5)
                made.append(np.where(np.diff(ends[at : to + 1]) > 0, p, 0.0))
            yield pa.array(np.concatenate(made), pa.float64())

    return run(F.col(text))


def logit(p: Column) -> Column:
    inside = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(inside / (1 - inside))


def strength(rows: DataFrame, mean: float) -> float:
    """Prior weight in documents, by moments: how little the groups' means spread beyond chance.

    rows: n, s (documents and sum of probabilities of a group), parent mean m.
    """
    got = rows.agg(F.sum("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)), F.count("*")).first()
    if not got[0]:
        return 1.0
    spread = got[1] / got[0] - mean * (1 - mean) * got[2] / got[0]
    return float(np.clip(mean * (1 - mean) / max(spread, 1e-6) - 1, 2.0, 1e4))


def site_posteriors(told: DataFrame, scratch: Scratch) -> tuple[DataFrame, float, float]:
    """(host, path, n, s, host_posterior), global mean and path strength, from rows (host, path, p)."""
    paths = scratch.table(told.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = float(total[1] / total[0]) if total[0] else 0.5
    weight = strength(hosts.withColumn("m", F.lit(mean)), mean)
    posterior = (F.lit(weight * mean) + F.col("s")) / (F.lit(weight) + F.col("n"))
    hosts = hosts.select(F.col("host").alias("_host"), posterior.alias("host_posterior"))
    sites = scratch.table(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "sites")
    return sites, mean, strength(sites.withColumn("m", F.col("host_posterior")), mean)


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """``docs`` with p_document, host_posterior, path_posterior, quality_score.

    ``host`` and ``path`` are expressions over ``docs``; null is a site of its
    own.  Repeated rows count each time.  Null and empty texts score 0.
    Without usable labels every text has the evidence 0.5.  Columns of ``docs``
    with the added names are replaced.  A doc_id with several labels has the
    highest, with several texts it is learned from the smallest.
    """
    added = ["p_document", "host_posterior", "path_posterior", "quality_score"]
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(docs.select("doc_id", "text"), labels)
    told = docs.select(host.alias("host"), path.alias("path"), evidence(model).alias("p"))
    sites, mean, weight = site_posteriors(told, scratch)
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns if c not in added]).alias("row"), host.alias("host"), path.alias("path"), evidence(model).alias("p"))
    x, y = own.alias("x"), sites.alias("y")
    joined = x.join(y, F.col("x.host").eqNullSafe(F.col("y.host")) & F.col("x.path").eqNullSafe(F.col("y.path")))
    # The path's posterior without the document itself, which has its say already.
    left_out = (F.lit(weight) * F.col("y.host_posterior") + F.col("y.s") - F.col("x.p")) / (F.lit(weight) + F.col("y.n") - 1)
    odds = logit(F.col("x.p")) + logit(left_out) - logit(F.lit(mean))
    score = F.when(F.col("x.p") > 0, 1 / (1 + F.exp(-odds))).otherwise(F.lit(0.0))
    return joined.select("x.row.*", *(c.alias(name) for c, name in zip((F.col("x.p"), F.col("y.host_posterior"), left_out, score), added, strict=True)))


def accepted(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """Rows of ``docs`` with a quality_score of KEEP or more, columns unchanged."""
    return scored(docs, labels, host, path).filter(F.col("quality_score") >= KEEP).select(*docs.columns)
