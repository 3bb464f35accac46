"""Quality classifier: random Fourier features, ridge scores from summed normal equations, isotonic calibration.

Statistics of a whole text (lengths, letter case, symbols, repetition) are
standardised, mapped by random cosines that approximate a Gaussian kernel, and
scored by ridge regression.  Its normal equations are sums over partitions, so
no row leaves its task.  An isotonic fit over a fixed number of score bins
turns raw scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_slices, map_whole_rows, table

#: Labelled rows that the fit takes at most: those whose ids hash lowest.  A documented bound; scoring reads everything.
MAX_LABELLED = 20_000
FEATURES = 256
RIDGE = 1.0
BINS = 400
SUM_PARTITIONS = 16

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = _UPPER[0xC0:0xDF] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = _LETTER[0xDF:0x100] = True
_STATS = 16


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    codes = np.bincount(np.frombuffer(text.encode("latin-1", "replace"), np.uint8), minlength=256)
    letters = max(int(codes[_LETTER].sum()), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda x: codes[[ord(c) for c in x]].sum() / chars
    return [
        np.log1p(n),
        np.log1p(chars / max(n, 1)),
        codes[_UPPER].sum() / letters,
        letters / chars,
        share("0123456789"),
        np.sqrt(share("#*$%&|<>")),
        np.sqrt(share("!?")),
        np.sqrt(share("|")),
        share(".,;:"),
        len(counts) / np.sqrt(max(n, 1)),
        len(counts) / max(n, 1),
        max(counts.values(), default=0) / max(n, 1),
        sum(map(eq, words, words[1:])) / max(n, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
        np.sqrt(share("()[]{}=_/\\@+~^\"")),
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def map(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.map(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a trace of the raw score keeps the order inside flat parts."""
        raw = self.raw(stats)
        return np.clip(0.998 * np.interp(raw, self.knots, self.values) + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(total: np.ndarray, positive: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: block centres and non-decreasing means."""
    blocks: list[list[float]] = []
    for n, p, c in zip(total, positive, centre, strict=True):
        blocks.append([n, p, c * n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def _stats_frame(docs: DataFrame) -> DataFrame:
    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "stats": [[float(v) for v in statistics(t)] for t in cols["text"]]}

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, stats array<double>")


def _summed(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over (stats, label), one addend for each of a fixed number of partitions."""
    width = len(model.phases) + 1

    def add(batches):
        gram, right = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            if b.num_rows:
                x = model.map(np.array(b.column(0).to_pylist(), float))
                gram += x.T @ x
                right += x.T @ np.array(b.column(1).to_pylist(), float)
        yield pa.RecordBatch.from_pydict({"gram": [gram.ravel().tolist()], "right": [right.tolist()]})

    parts = rows.repartition(SUM_PARTITIONS, F.xxhash64("doc_id")).select("stats", "label").mapInArrow(add, "gram array<double>, right array<double>").toLocalIterator()
    gram, right = np.zeros(width * width), np.zeros(width)
    for r in parts:
        gram += np.array(r["gram"])
        right += np.array(r["right"])
    return gram.reshape(width, width), right


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, seed: int = 7) -> QualityModel | None:
    """Fit on ``labels`` (doc_id, label 0/1), at most ``max_rows`` of them; None if no labelled document is found.

    Null ids and labels are ignored; an id with several labels takes the least.
    """
    chosen = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows narrow rows, so the broadcast's size is bounded by the parameter
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = cut(_stats_frame(texts).join(F.broadcast(chosen), "doc_id"))
    moments = rows.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not moments:
        return None
    mean, scale = np.array([r["m"] for r in moments]), np.maximum([r["s"] for r in moments], 1e-3)
    random = np.random.default_rng(seed)
    directions = random.normal(0, np.sqrt(1 / len(mean)), (len(mean), FEATURES))
    start = QualityModel(mean, scale, directions, random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    gram, right = _summed(rows, start)
    penalty = np.full(len(right), RIDGE)
    penalty[-1] = 1e-6
    scored = QualityModel(mean, scale, directions, start.phases, np.linalg.solve(gram + np.diag(penalty), right), start.knots, start.values)

    def make():
        return lambda cols: {"raw": scored.raw(np.array(cols["stats"], float)).tolist() if cols["stats"] else [], "label": cols["label"]}

    bins = map_slices(rows.select("stats", F.col("label").cast("int").alias("label")), make, "raw double, label int").groupBy(F.floor((F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) + 0.5) * (BINS / 2)).alias("bin"))
    sums = sorted((r["bin"], r["n"], r["p"], r["c"]) for r in bins.agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.avg("raw").alias("c")).collect())
    _, total, positive, centre = (np.array(x, float) for x in zip(*sums, strict=True))
    knots, values = isotonic(total, positive, centre)
    return QualityModel(mean, scale, directions, start.phases, scored.weights, knots, values)


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """Rows (doc_id, score) of every whole text; 0.5 everywhere if there is no model."""

    def make():
        def work(cols):
            stats = np.array([statistics(t) for t in cols["text"]], float).reshape(-1, _STATS)
            return {"doc_id": cols["doc_id"], "score": model.score(stats).tolist() if model else [0.5] * len(stats)}

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, with all their columns."""

    def make():
        def work(batch):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            stats = np.array([statistics(t) for t in texts], float).reshape(-1, _STATS)
            return batch.filter(pa.array((model.score(stats) if model else np.full(len(stats), 0.5)) >= least))

        return work

    return map_whole_rows(docs, make, docs.schema)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def training_labels(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), F.col("quality").alias("label"))
    return labels.where(remainder(F.col("doc_id"), 3) != 1)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Score all documents; rows of crc32 remainder 1 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
