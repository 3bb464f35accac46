"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point.  An
n-gram of letters is the product of its letters' vectors, each rotated by its
place (binding permuted vectors); a document is the sum of its n-grams'
vectors (bundling), and a language's prototype is the sum of its documents'.
A document's language is the prototype with the largest cosine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, cut, map_slices, table
from .quality_model import remainder

DIM = 512
GRAM = 3
#: Documents for each language that the prototypes are made of, at most: those whose ids hash lowest.
PER_LANGUAGE = 2_000
#: Vectors of n-grams that a task keeps, and those that it multiplies at once.
KEPT = 40_000
CHUNK = 8192


@cache
def _letters() -> np.ndarray:
    """Each code point's own number if it is a letter, else a space's."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.int64)


class Bundler:
    """Turns texts into bundled vectors."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self.known: dict[int, int] = {}
        self.grams = np.empty((KEPT, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([20_26, code]).integers(0, 2, self.dim, np.int8) * 2 - 1
        return self.letters[code]

    def rows(self, packed: list[int]) -> np.ndarray:
        """The vectors of at most ``CHUNK`` n-grams."""
        if len(self.known) + len(packed) > KEPT:
            self.known.clear()
        for gram in packed:
            if gram not in self.known:
                vector = np.ones(self.dim, np.int8)
                for place in range(GRAM):
                    vector = vector * np.roll(self.letter(gram >> (21 * place) & 0x1FFFFF), place)
                self.grams[len(self.known)] = vector
                self.known[gram] = len(self.known)
        return self.grams[[self.known[g] for g in packed]].astype(np.float32)

    @staticmethod
    def packed(text: str | None) -> np.ndarray:
        """The n-grams of a whole text as packed code points; none if it has no letter."""
        codes = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate([[32], codes, [32]])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        return sum(codes[i : len(codes) - GRAM + 1 + i] << (21 * i) for i in range(GRAM)) if len(codes) >= GRAM else np.empty(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """One bundle for each whole text, and whether the text has a letter."""
        each = [self.packed(t) for t in texts]
        sizes = np.array([len(x) for x in each], np.int64)
        total = np.zeros((len(each), self.dim), np.float32)
        which, grams = pd.factorize(np.concatenate([*each, np.empty(0, np.int64)]))
        owner = np.repeat(np.arange(len(each)), sizes)
        for at in range(0, len(grams), CHUNK):
            part = grams[at : at + CHUNK]
            here = slice(None) if len(grams) <= CHUNK else (which >= at) & (which < at + CHUNK)
            counts = np.bincount(owner[here] * len(part) + which[here] - at, minlength=len(each) * len(part))
            total += counts.reshape(len(each), len(part)).astype(np.float32) @ self.rows(part.tolist())
        return total, sizes > 0


@dataclass(frozen=True)
class Prototypes:
    languages: list[str]
    units: np.ndarray

    def best(self, vector: np.ndarray) -> tuple[str, float]:
        """The nearest language (ties: first by code point) and its cosine, at least 0."""
        cosines = self.units @ (vector / max(np.linalg.norm(vector), 1e-12))
        at = int(np.argmax(cosines))
        return self.languages[at], float(np.clip(cosines[at], 0, 1))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM) -> Prototypes | None:
    """Prototypes of the languages of (doc_id, text, lang); rows without language are ignored.

    The sample's bound holds for each language: its share is taken by the hash
    of the id, from counts over all rows.  Each partition sends one sum for each language it met.
    """
    known = docs.where("lang IS NOT NULL")
    counts = known.groupBy("lang").agg(F.count("*").alias("_n"))
    share = counts.select(F.col("lang").alias("_l"), (F.lit(float(per_language)) / F.col("_n")).alias("_share"))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / F.lit(1e6)
    shares = {r["_l"]: r["_share"] for r in share.orderBy("_l").collect()}  # one row for each language
    if not shares:
        return None
    limit = F.element_at(F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("lang"))
    sample = known.where(hashed < limit).select("lang", "text")

    def add(batches):
        bundle, sums = Bundler(dim), {}
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                langs, texts = (b.column(i).slice(at, SLICE_ROWS).to_pylist() for i in (0, 1))
                for lang, vector, any_letter in zip(langs, *bundle(texts), strict=True):
                    if any_letter:
                        sums[lang] = sums.get(lang, 0) + vector.astype(float) / max(np.linalg.norm(vector), 1e-12)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "total": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    parts = cut(sample.mapInArrow(add, "lang string, total array<double>"))
    rows = parts.select("lang", F.posexplode("total").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    # languages x dim numbers
    table_ = rows.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v")).orderBy("lang").collect()
    if not table_:
        return None
    sums = np.array([r["v"] for r in table_])
    centred = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return Prototypes([r["lang"] for r in table_], centred)


def predict(docs: DataFrame, prototypes: Prototypes | None, dim: int = DIM) -> DataFrame:
    """Rows (doc_id, lang_pred, score) of every whole text; ``und`` and 0 where there is no letter (or nothing was learned)."""

    def make():
        bundle = Bundler(dim)

        def work(cols):
            found = [prototypes.best(v) if prototypes and any_letter else ("und", 0.0) for v, any_letter in zip(*bundle(cols["text"]), strict=True)]
            return {"doc_id": cols["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, lang_pred string, score double")


def op4_language(spark, sf_dir: str) -> DataFrame:
    """Predict for all documents; rows of crc32 remainder 2 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = learn(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return predict(docs, prototypes).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
