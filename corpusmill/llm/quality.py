"""Quality classifier: kernel ridge over document statistics by random Fourier features, calibrated by isotonic regression.

Fitting: statistics of a bounded sample of labelled rows are written once; every partition sums its normal
equations by fold, and the sums of a few hundred numbers square come to the driver, which solves them. The ridge is
chosen, and the isotonic map fitted, on scores of folds that the solved weights have not seen. Scoring runs where
the documents are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import held_out, kept, labelled_sample, map_frames, text_rows

FOLDS = 5
LOWER, UPPER, DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LOWER[97:123] = UPPER[65:91] = DIGIT[48:58] = True
STOP, SPACE, HIGH = np.isin(np.arange(256), [*b".,;:?'"]), np.isin(np.arange(256), [*b" \t\r\n"]), np.arange(256) >= 128
SYMBOL = ~(LOWER | UPPER | DIGIT | STOP | SPACE | HIGH)
CAPS = re.compile(r"\b[A-Z]{2,}\b").findall


def statistics(text: str) -> np.ndarray:
    """The numbers that describe a whole text; an empty text has defined ones too."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, n)
    used = hist[hist > 0]
    words = text.split()
    count, lines = Counter(words), [x for x in text.split("\n") if x.strip()]
    m, v = max(1, len(words)), max(1, len(count))
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    top = count.most_common(10)
    pairs = len(set(zip(words, words[1:]))) / max(1, m - 1)
    return np.array([
        np.log1p(n), np.log1p(len(words)), hist[LOWER].sum(), hist[UPPER].sum(), hist[DIGIT].sum(), hist[STOP].sum(), hist[SYMBOL].sum(), hist[SPACE].sum(), hist[HIGH].sum(),
        -(used * np.log2(used)).sum(), hist[SYMBOL].max(), sizes.mean(), sizes.std(), min(sizes.max(), 100.0), np.log(v) / np.log(m + 1), v / m, (top[0][1] if top else 0) / m, sum(c for _, c in top) / m, pairs,
        np.log1p(len(lines)), np.log1p(m / max(1, len(lines))), len({x.strip() for x in lines}) / max(1, len(lines)), len(CAPS(text)) / m, raw.count(b". ") / m, raw.count(b", ") / m, len(zlib.compress(raw, 1)) / max(16, n),
    ])


SIZE = len(statistics(""))


class Model:
    """Standardisation, Fourier features, ridge weights and isotonic map."""

    def __init__(self, mean, scale, features: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w, self.b = rng.normal(0, np.sqrt(2 * gamma), (SIZE, features)), rng.uniform(0, 2 * np.pi, features)
        self.weights, self.knots, self.levels = np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.lift(x) @ self.weights, self.knots, self.levels)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and non-decreasing levels, shrunk by a row of each label."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, lowest and highest score
    for s, t in zip(score[order], y[order]):
        blocks.append([float(t), 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    base = float(np.mean(y))
    level = np.maximum.accumulate([(b[0] + base) / (b[1] + 1) for b in blocks])
    return np.array([x for b in blocks for x in b[2:]]), np.repeat(level, 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 40_000, features: int = 256, seed: int = 7) -> Model:
    """Learns from at most about ``most`` labelled rows outside the held-out fold; without any, every score is 0.5."""
    width = features + 1

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"].astype(int), "x": [statistics(t) for t in pdf["text"]]})

    seen = kept(labelled_sample(docs, labels, label, most).mapInPandas(stats, "doc_id long, y int, x array<double>"), "statistics")
    cols = [F.col("x")[i] for i in range(SIZE)]
    row = seen.agg(F.count("*"), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    if not row[0]:
        return Model(np.zeros(SIZE), np.ones(SIZE), features, 1 / SIZE, seed)
    model = Model(np.array(row[1 : SIZE + 1]), np.maximum(np.array(row[SIZE + 1 :]), 1e-6), features, 0.5 / SIZE, seed)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, width, width + 1))
        for pdf in batches:
            if len(pdf):
                z, fold = model.lift(np.stack(pdf["x"])), pdf["doc_id"].to_numpy() % FOLDS
                for k in range(FOLDS):
                    a = z[fold == k]
                    total[k] += a.T @ np.hstack([a, pdf["y"].to_numpy()[fold == k, None]])
        yield pd.DataFrame({"fold": range(FOLDS), "sums": [t.astype("<f8").tobytes() for t in total]})

    total = np.zeros((FOLDS, width, width + 1))
    for r in seen.coalesce(8).mapInPandas(sums, "fold int, sums binary").toLocalIterator():
        total[r["fold"]] += np.frombuffer(r["sums"], "<f8").reshape(width, width + 1)

    def solve(t: np.ndarray, ridge: float) -> np.ndarray:
        return np.linalg.solve(t[:, :width] + ridge * np.diag([1.0] * features + [1e-6]), t[:, width])

    got = seen.select("doc_id", "y", "x").toPandas().sort_values("doc_id")  # ``most`` rows of SIZE numbers at most
    z, y, fold = model.lift(np.stack(got["x"])), got["y"].to_numpy(float), got["doc_id"].to_numpy() % FOLDS

    def unseen(ridge: float) -> np.ndarray:
        w = np.stack([solve(total.sum(0) - total[k], ridge) for k in range(FOLDS)])
        return (z * w[fold]).sum(1)

    ridge = min((0.01, 0.1, 1.0, 10.0), key=lambda r: ((unseen(r) - y) ** 2).mean())
    model.weights = solve(total.sum(0), ridge)
    model.knots, model.levels = isotonic(unseen(ridge), y)
    return model


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) for every row.

    Null text is empty and has a score as well. Repeated rows each give a row; a null doc_id is not held out. Only
    the text makes the score; extra columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = model.score(np.stack([statistics(t) for t in pdf["text"]])) if len(pdf) else []
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score})

    scored = map_frames(text_rows(docs), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least threshold, columns as they were; the score is made beside the row, with no shuffle."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(t or "") for t in texts])) if len(texts) else [], dtype=float)

    return docs.where(score(F.col("text")) >= threshold)
