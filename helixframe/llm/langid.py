"""Language identification by a byte convolutional network (operator 7).

Filters of several widths run over the bytes of fixed-length windows; each
filter's largest response in a window feeds a softmax over the languages.  A
filter on one-hot bytes is a table look-up per byte, so a window needs no
embedding and no matrix product.  The network is trained in numpy on a bounded
sample of labelled texts and applied to every window of every text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import layout, steps
from .worker import bound_batches, released

#: Bytes of a window, filter widths, filters of each width.
LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Labelled texts of each language that training takes, and windows of each text.
TEXTS, WINDOWS = 400, 3
EPOCHS, BATCH, RATE = 10, 64, 0.02
UNKNOWN = "und"
#: Windows that prediction takes together: their responses fit a core's cache.
TOGETHER = 64
#: The share of the rightly told texts below the score that the least score of a kept text is taken from, what part of that score, and the steps in which scores are counted.
BELOW, MARGIN, GRADES = 0.001, 0.8, 10_000

#: Letters lower-cased; digits, marks and controls are one blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def folded(raw: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 text with ASCII and Latin-1 letters in lower case."""
    out = FOLD[raw]
    upper = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E)) + 1
    out[upper] += 0x20
    return out


def windows(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes of text in each) of whole texts, the last of each filled up by blanks."""
    sizes = np.diff(ends)
    counts = -(-sizes // LENGTH)
    out = np.full((int(counts.sum()), LENGTH), 32, np.uint8)
    flat, at = out.reshape(-1), 0
    text = folded(raw[ends[0] : ends[-1]]) if ends[-1] > ends[0] else raw[:0]
    for start, size, count in zip((ends[:-1] - ends[0]).tolist(), sizes.tolist(), counts.tolist(), strict=True):
        flat[at : at + size] = text[start : start + size]
        at += count * LENGTH
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    held = np.minimum(LENGTH, sizes[owner] - (np.arange(len(owner)) - first[owner]) * LENGTH)
    return out, owner, held


class Network:
    """tables[w][j]: response of the filters of a width to each byte at place j."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.5 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)

    def respond(self, own: np.ndarray, table: np.ndarray) -> np.ndarray:
        width, (n, length) = len(table), own.shape
        span = length - width + 1
        out = table[0][own[:, :span]]
        for j in range(1, width):
            out += table[j][own[:, j : j + span]]
        return out

    def pooled(self, own: np.ndarray) -> np.ndarray:
        return np.concatenate([self.respond(own, t).max(1) for t in self.tables], axis=1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled + self.bias, 0)
        score = hidden @ self.dense + self.shift
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def train(self, own: np.ndarray, labels: np.ndarray, seed: int = 4) -> None:
        """Adam on the cross entropy; a filter's table learns at the place of its largest response."""
        rng = np.random.default_rng(seed)
        weights = [*self.tables, self.bias, self.dense, self.shift]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        share = np.bincount(labels, minlength=len(self.languages))
        balance = (len(labels) / np.maximum(share, 1) / len(self.languages)).astype(np.float32)
        time = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(own))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                x, y = own[rows], labels[rows]
                places, pooled = [], []
                for table in self.tables:
                    response = self.respond(x, table)
                    place = response.argmax(1)
                    places.append(place)
                    pooled.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0])
                pooled = np.concatenate(pooled, axis=1)
                error = self.probabilities(pooled)
                error[np.arange(len(y)), y] -= 1
                error *= balance[y][:, None] / len(y)
                hidden = np.maximum(pooled + self.bias, 0)
                back = (error @ self.dense.T) * (hidden > 0)
                slopes = []
                for w, (table, place) in enumerate(zip(self.tables, places, strict=True)):
                    slope = np.zeros_like(table)
                    part = back[:, w * FILTERS : (w + 1) * FILTERS]
                    filters = np.broadcast_to(np.arange(FILTERS), place.shape)
                    for j in range(len(table)):
                        np.add.at(slope[j], (x[np.arange(len(x))[:, None], place + j], filters), part)
                    slopes.append(slope)
                slopes += [back.sum(0), hidden.T @ error, error.sum(0)]
                time += 1
                for w, slope, a, b in zip(weights, slopes, first, second, strict=True):
                    a += 0.1 * (slope - a)
                    b += 0.01 * (slope * slope - b)
                    w -= RATE * (a / (1 - 0.9**time)) / (np.sqrt(b / (1 - 0.99**time)) + 1e-6)

    def predict(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of each text: the mean over its windows, weighed by their bytes."""
        own, owner, held = windows(raw, ends)
        out = np.zeros((len(ends) - 1, len(self.languages)))
        for at in range(0, len(own), TOGETHER):
            part = self.probabilities(self.pooled(own[at : at + TOGETHER])) * held[at : at + TOGETHER, None]
            np.add.at(out, owner[at : at + TOGETHER], part)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] == "L" for c in text)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known(docs: DataFrame) -> DataFrame:
    """Rows with a text and a label that may be learned."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def fit(docs: DataFrame) -> Network | None:
    """Train on texts and non-null langs of rows that aren't held out; None if there are none."""
    bound_batches(docs.sparkSession)
    size = F.length("text")
    cut = F.array(*(F.substr("text", 1 + F.floor(F.greatest(size - LENGTH, F.lit(0)) * F.lit(i / (WINDOWS - 1))).cast("int"), F.lit(LENGTH)) for i in range(WINDOWS)))
    labelled = known(docs).select("doc_id", "lang", cut.alias("cuts"))
    # The rows with the smallest hashes of each language; Spark limits each group before the shuffle.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "cuts"))
    rows = labelled.withColumn("place", place).filter(F.col("place") <= TEXTS).select("doc_id", "lang", "cuts").collect()  # WINDOWS windows of each
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["cuts"]))
    samples, labels = [], []
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(11)
    for row in rows:
        for text in dict.fromkeys(row["cuts"]):
            if not has_letter(text):
                continue
            data = np.frombuffer(text.encode(), np.uint8)[:LENGTH]
            for size in {len(data), int(rng.integers(min(12, len(data)), len(data) + 1))}:  # short texts too
                samples.append(windows(data[:size], np.array([0, size]))[0][0])
                labels.append(languages.index(row["lang"]))
    network = Network(languages)
    if samples:
        network.train(np.stack(samples), np.array(labels))
    return network


def identify(network: Network | None, text: str = "text") -> Column:
    """struct(lang_pred, score) of a text column; null and texts without letters are ``und`` with score 0."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    @released
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            raw, ends = layout(column)
            names: list[str] = []
            scores: list[float] = []
            for at, to in steps(ends, 1 << 20):
                part = network.predict(raw, ends[at : to + 1]) if network else np.zeros((to - at, 1))
                best = part.argmax(1)
                for i in range(to - at):
                    own = raw[ends[at + i] : ends[at + i + 1]]
                    ascii_letter = bool((FOLD[own] != 32).any()) and bool(((FOLD[own] >= 97) & (FOLD[own] < 123)).any())
                    known = network is not None and (ascii_letter or has_letter(column[at + i].as_py()))
                    names.append(network.languages[best[i]] if known else UNKNOWN)
                    scores.append(min(1.0, float(part[i, best[i]])) if known else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return run(F.col(text))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    Neither lang nor source nor doc_id is an input of a prediction.  A null
    doc_id isn't held out, nor learned from.
    """
    network = fit(docs)
    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(network).alias("_told"))
    return told.select("doc_id", "held_out", "_told.lang_pred", "_told.score")


def least_score(docs: DataFrame, network: Network | None) -> float:
    """MARGIN of the score that all but BELOW of the labelled texts reach whose label the network finds; 0 if there are none.

    All labelled rows count, by scores rounded down to one of GRADES steps.
    """
    told = known(docs).select("lang", identify(network).alias("told"))
    grade = F.when(F.col("told.lang_pred") == F.col("lang"), F.floor(F.col("told.score") * GRADES))
    counts = sorted((r["grade"], r["count"]) for r in told.groupBy(grade.alias("grade")).count().collect() if r["grade"] is not None)  # GRADES + 1 rows at most
    rest = BELOW * sum(n for _, n in counts)
    for found, n in counts:
        rest -= n
        if rest < 0:
            return MARGIN * found / GRADES
    return 0.0


def accepted(docs: DataFrame, least: float | None = None) -> DataFrame:
    """Rows of ``docs`` with a language (not ``und``) and a score of ``least`` or more, columns unchanged.

    Without ``least`` the labelled rows tell it.
    """
    network = fit(docs)
    least = least_score(docs, network) if least is None else least
    told = docs.withColumn("_told", identify(network))
    return told.filter((F.col("_told.lang_pred") != UNKNOWN) & (F.col("_told.score") >= least)).select(*docs.columns)
