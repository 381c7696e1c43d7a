"""Language identification by string kernels: blended-spectrum presence kernel, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import least, lowest_hashed

#: Bounds of the fitting sample: labelled rows, and among them landmarks, of each language and in all. Languages share the latter alike.
SAMPLE_PER_LANGUAGE, SAMPLE = 300, 12_000
LANDMARKS_PER_LANGUAGE, LANDMARKS = 24, 960
#: Bound of the grams of a labelled row that the fit reads: of a row with more, those whose hashes are least. Prediction reads all.
GRAMS_PER_ROW = 8192
RIDGE = 0.05
#: A gram is 1 to 3 bytes of the lower-cased UTF-8 text; its code has the bytes and, above them, its length.
SPECTRUM = 1 << 24
LATIN = re.compile("[A-Za-z]")
CHUNK = 1 << 21
BATCH = 128


def grams(text: str) -> np.ndarray:
    """Sorted codes of the distinct grams of a whole text, of 1, 2 and 3 bytes; white space runs count as one space."""
    raw = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    found = []
    for at in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        n = np.bincount(b, minlength=256)
        found.append(np.flatnonzero(n).astype(np.uint32) | np.uint32(1 << 24))
        two = b[:-1] | b[1:] << 8
        if len(two):
            seen = np.zeros(1 << 16, bool)
            seen[two] = True
            found.append(np.flatnonzero(seen).astype(np.uint32) | np.uint32(2 << 24))
        if len(b) > 2:
            found.append(np.unique(two[:-1] | b[2:] << 16) | np.uint32(3 << 24))
    if not found:
        return np.empty(0, np.uint32)
    return np.unique(np.concatenate(found)) if len(raw) > CHUNK else np.concatenate(found)


def has_letter(text: str | None) -> bool:
    """Is there a character of a letter category? Digits, fractions and numerals aren't letters."""
    return bool(text) and (LATIN.search(text) is not None or any(map(str.isalpha, text)))


@dataclass
class KernelModel:
    """score = normalised kernel with the landmarks @ out + bias, one column a language."""

    langs: list[str]
    vocabulary: np.ndarray  # sorted codes of all grams of the landmarks
    landmarks: np.ndarray  # vocabulary x landmarks, presence over the root of the landmark's gram count
    out: np.ndarray
    bias: np.ndarray

    def scores(self, gram_sets: list[np.ndarray]) -> np.ndarray:
        """One matrix product for the kernel of a batch with the landmarks, one for the languages."""
        present = np.zeros((len(gram_sets), len(self.vocabulary)), np.float32)
        for i, g in enumerate(gram_sets):
            at = np.searchsorted(self.vocabulary, g)
            at[at == len(self.vocabulary)] = 0
            present[i, at[self.vocabulary[at] == g]] = 1
        size = np.sqrt(np.maximum([len(g) for g in gram_sets], 1))[:, None]
        return (present @ self.landmarks / size).astype(np.float64) @ self.out + self.bias


def fit(gram_sets: list[np.ndarray], langs: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> KernelModel | None:
    """One-versus-rest kernel ridge regression on Nyström features; the first rows of each language are its landmarks."""
    names = sorted(set(langs))
    if not names:
        return None
    count: dict[str, int] = {}
    landmarks_per_language = max(1, min(landmarks_per_language, LANDMARKS // len(names)))
    marks = []
    for i, x in enumerate(langs):
        count[x] = count.get(x, 0) + 1
        if count[x] <= landmarks_per_language and len(marks) < LANDMARKS:
            marks.append(i)
    vocabulary = np.unique(np.concatenate([gram_sets[i] for i in marks]))
    table = np.zeros((len(vocabulary), len(marks)), np.float32)
    for j, i in enumerate(marks):
        table[np.searchsorted(vocabulary, gram_sets[i]), j] = 1 / np.sqrt(max(len(gram_sets[i]), 1))
    model = KernelModel(names, vocabulary, table, np.eye(len(marks)), np.zeros(len(marks)))
    k_nm = np.concatenate([model.scores(gram_sets[i : i + BATCH]) for i in range(0, len(langs), BATCH)])
    values, vectors = np.linalg.eigh((k_nm[marks] + k_nm[marks].T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm^(-1/2) on its range
    phi = k_nm @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    _, place, share = np.unique(np.array(langs), return_inverse=True, return_counts=True)
    weight = 1 / share[place]
    weight *= len(langs) / weight.sum()
    mean, mean_y = np.average(phi, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    centred = (phi - mean) * weight[:, None]
    w = np.linalg.solve(centred.T @ (phi - mean) + ridge * len(langs) / len(names) * np.eye(phi.shape[1]), centred.T @ (y - mean_y))
    model.out, model.bias = root @ w, mean_y - mean @ w
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> KernelModel | None:
    """Fit on at most per_language rows of each language, those whose ids hash lowest, outside the held-out fifth.

    A row is learned under its own language and no other: ids may be repeated, and a row without a language teaches nothing. The sample, at most SAMPLE rows of GRAMS_PER_ROW grams of four bytes, is the only thing that the driver holds, however many languages there
    are and however long the texts are. Where there are more languages than SAMPLE, those with most rows are learned.
    """
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t"), F.col(lang_col).alias("_l"))
    pool = own.where("_id IS NOT NULL AND _l IS NOT NULL").where(~held_out("_id")).select("_id", "_l", F.xxhash64("_id").alias("h"))
    sample = lowest_hashed(pool, "_l", per_language, SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [has_letter(t) for t in b.column(2).to_pylist()]  # others teach nothing
            b = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([least(grams(t), GRAMS_PER_ROW).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["nth", "lang", "x"])

    # labelled rows are met by id and language, each once; of the rows of one id and language, a sample's worth at most
    wanted = F.broadcast(sample.groupBy(F.col("_id").alias("_wi"), F.col("_l").alias("_wl")).agg(F.min("nth").alias("nth")))
    met = own.join(wanted, (F.col("_id") == F.col("_wi")) & (F.col("_l") == F.col("_wl")))
    place = F.row_number().over(Window.partitionBy("_l").orderBy("nth", F.xxhash64("_t")))
    rows = met.withColumn("_at", place).where(F.col("_at") <= per_language).select(F.col("_at").alias("nth"), "_l", "_t")
    found = rows.mapInArrow(run, "nth int, lang string, x binary").orderBy("nth", "lang", "x").limit(SAMPLE).collect()
    return fit([np.frombuffer(r.x, np.uint32) for r in found], [r.lang for r in found])


def predict(docs: DataFrame, model: KernelModel | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, gives `und` and score 0, as does a model that saw no language. Ties go to the first
    language in alphabetical order. score is the softmax of four times the regression outputs, at the winner. held_out is
    false for a null id. Repeated rows are all returned; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                texts = part.column(2).to_pylist()
                ok = [i for i, t in enumerate(texts) if model and has_letter(t)]
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
                if ok:
                    s = model.scores([grams(texts[i]) for i in ok])
                    e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                    best = s.argmax(axis=1)
                    for i, k in zip(ok, best):
                        pred[i] = model.langs[k]
                    score[ok] = (e / e.sum(axis=1, keepdims=True))[np.arange(len(ok)), best]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("_t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
