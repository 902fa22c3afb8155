"""Language identification: TF-IDF vectors of letter n-grams against several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, BooleanType, StringType, StructField, StructType

from tableloom.llm.words import map_batches
from tableloom.session import materialise

BITS = 14  # n-grams are hashed to 2**BITS features
ORDERS = (1, 2, 3)
PIECE = 1 << 20  # code points of a text handled at a time
MAX_MODEL_BYTES = 256 << 20
FULL_LENGTH = 200
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For every code point the lower-cased letter, or a blank."""
    made = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        if (char := chr(code)).isalpha():
            made[code] = ord(low) if len(low := char.lower()) == 1 else code
    return made


def _ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text; every run of other characters is one blank."""
    counts = np.zeros(1 << BITS, np.int64)
    for start in range(0, len(text), PIECE):
        piece = text[start : start + PIECE + max(ORDERS) - 1]
        letters = _letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters = np.concatenate(([np.uint32(32)], letters, [np.uint32(32)]))
        keep = letters != 32
        keep[1:] |= keep[:-1]
        letters = letters[keep] if keep[0] else np.concatenate(([np.uint32(32)], letters[keep]))
        for order in ORDERS:
            if len(letters) < order:
                continue
            code = np.full(len(letters) - order + 1, order, np.uint32)
            for k in range(order):
                code = (code ^ letters[k : len(letters) - order + 1 + k]) * np.uint32(0x9E3779B1)
                code ^= code >> np.uint32(15)
            counts += np.bincount(code >> np.uint32(32 - BITS), minlength=1 << BITS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Centroids:
    """What a prediction needs. ``limit`` is the largest accepted distance (1 - cosine) from each centroid.

    A text of a few letters lies far from every centroid, so below ``FULL_LENGTH`` letters the least cosine
    shrinks in proportion.
    """

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # one row per centroid
    limit: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1) and whether the distance from the nearest centroid is too large."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        counts = _ngram_counts(text)
        vector = self.idf * counts
        norm, letters = np.sqrt(vector @ vector), counts.sum() / len(ORDERS)
        cosines = self.weights @ vector / norm if norm else np.zeros(len(self.langs), np.float32)
        best = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[best])))
        least = (1 - self.limit[best]) * min(1.0, letters / FULL_LENGTH)
        return self.langs[best], score, bool(score < least)


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each feature occurs, and the number of texts."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        found, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found += _ngram_counts(text.as_py() or "") > 0
                n += 1
        if n:
            yield {"feature": np.arange(-1, 1 << BITS), "n": np.concatenate(([n], found))}

    sums = map_batches(texts, count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    all_n = np.zeros(1 + (1 << BITS), np.int64)
    for feature, n in sums.filter(F.col("n") > 0).collect():  # at most 2**BITS + 1 rows
        all_n[feature + 1] = n
    return all_n[1:], int(all_n[0])


def _cluster(vectors: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: centroids and the mean cosine of each one's members."""
    centre = vectors.mean(axis=0)
    picked = [int((vectors @ centre).argmax())]
    while len(picked) < min(k, len(vectors)):
        picked.append(int((vectors @ vectors[picked].T).max(axis=1).argmin()))
    centroids = vectors[picked]
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == c].sum(axis=0) for c in np.unique(nearest)])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    cosines = vectors @ centroids.T
    nearest = cosines.argmax(axis=1)
    return centroids, np.array([cosines[nearest == c, c].mean() if (nearest == c).any() else 0 for c in range(len(centroids))])


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """``doc_id, lang``: per language the ``most`` ids with the smallest hashes.

    Hashes over a bound that about twice as many pass are left out first, so a language with most of all rows
    sends no more rows to its task than any other. The bound follows the number of different ids, so ids that many
    rows repeat don't lower it.
    """
    ids = rows.select("doc_id", "lang").withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.03).alias("all"))
    near = ids.join(F.broadcast(counts), "lang").filter(F.col("draw").cast("double") * F.col("all") <= F.lit((2.0 * most + 100) * (1 << 40)))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    ranked = near.distinct().withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= most).select("doc_id", "lang")


def fit(
    docs: DataFrame,
    clusters: int = 3,
    sample_per_lang: int = 400,
    reject_share: float = 0.1,
    rounds: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Centroids:
    """Centroids of all languages in ``lang``; rows without a language or a letter teach nothing.

    Document frequencies come from all labelled texts. The centroids are clustered from at most ``sample_per_lang``
    texts per language, those with the smallest hash of their id (of rows that share one, the least text); this bounds
    each language's task. A document is
    accepted within ``1 - reject_share * (mean cosine of the centroid's members)``. The model has ``clusters`` rows of
    2**14 floats per language and is refused beyond ``MAX_MODEL_BYTES``, which is over a thousand languages.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    frequencies, n = _document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + frequencies)).astype(np.float32)
    ids = materialise(_sample(rows, sample_per_lang), "sample")
    langs = ids.select("lang").distinct().count()
    if (size := langs * clusters * 4 * (1 << BITS)) > MAX_MODEL_BYTES:
        raise ValueError(f"centroids of {size} bytes are too large to copy to every worker")
    picked = rows.join(F.broadcast(ids), ["doc_id", "lang"])  # as few ids as texts to cluster
    picked = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            at, n = [], []
            for x in batch["text"]:  # one array of all features at a time
                counts = _ngram_counts(x.as_py())
                at.append(np.flatnonzero(counts).astype(np.int32))
                n.append(counts[at[-1]])
            yield {"doc_id": batch["doc_id"], "lang": batch["lang"], "at": at, "n": n}

    def centroids(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((len(group), 1 << BITS), np.float32)
        group = group.sort_values("doc_id", ignore_index=True)
        for row, at, counts in zip(dense, group["at"], group["n"], strict=True):
            row[at] = counts * idf[at]
        norms = np.linalg.norm(dense, axis=1, keepdims=True)
        dense = dense[norms[:, 0] > 0] / norms[norms[:, 0] > 0]
        if not len(dense):
            return pd.DataFrame({"lang": [], "cluster": [], "mean": [], "centroid": []})
        found, means = _cluster(dense, clusters, rounds)
        return pd.DataFrame({"lang": key[0], "cluster": range(len(found)), "mean": means, "centroid": list(found)})

    id_type = docs.schema[doc_id].dataType.simpleString()
    counted = map_batches(picked.select("doc_id", "lang", "text"), vectors, f"doc_id {id_type}, lang string, at array<int>, n array<long>")
    schema = "lang string, cluster int, mean double, centroid array<float>"
    model = sorted(counted.groupBy("lang").applyInPandas(centroids, schema).toLocalIterator(), key=lambda r: (r.lang, r.cluster))
    weights = np.array([r.centroid for r in model], np.float32).reshape(-1, 1 << BITS)
    limit = np.array([1 - reject_share * r["mean"] for r in model])
    return Centroids([r.lang for r in model], idf, weights, limit)


def classify(docs: DataFrame, model: Centroids, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``; whole texts decide.

    NULL texts, texts without a letter and every text under a model that has learned nothing are ``und`` with score 0
    and rejected. Equal cosines go to the language that is first in code point order. Repeated rows are predicted
    alike; other columns are ignored. No shuffle: the model goes to every worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    kept = [StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]

    def predict(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch["text"]]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            made = {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            yield {k: v for k, v in batch.items() if k != "text"} | made | {"rejected": pa.array(rejected, pa.bool_())}

    out = map_batches(rows, predict, StructType(kept + made))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")
