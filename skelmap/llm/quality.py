"""Ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least, lowest_hashed

BITS = 18
#: Bound of the fitting sample: labelled rows of each grade.
SAMPLE_PER_GRADE = 3000
#: Bound of the features of a labelled row that the fit reads: of a row with more, those whose hashes are least. Scoring reads all.
FEATURES_PER_ROW = 2048
TOKEN = re.compile(r"\w+|[^\w\s]+")
CHUNK = 1 << 20


def _tokens(text: str) -> set[str]:
    """Distinct lower-case words and marks of a whole text, and marks of its shape; each token counts once."""
    found: set[str] = set()
    words = repeats = 0
    upper = len(re.findall("[A-ZÀ-ÖØ-Þ]", text))
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and not text[end].isspace():
            end += 1
        part = TOKEN.findall(text[at:end].lower())
        words += len(part)
        repeats += sum(a == b for a, b in zip(part, part[1:]))
        found.update(part)
        at = end
    if words:
        found.add(f"\x01upper{min(9, 20 * upper // len(text))}")
        found.add(f"\x01repeat{min(9, 20 * repeats // words)}")
        found.add(f"\x01kinds{10 * len(found) // (words + 3) if words > 30 else 'x'}")
    return found


def features(text: str | None) -> np.ndarray:
    return np.unique(np.fromiter((crc32(t.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for t in _tokens(text or "")), np.int32))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . x); thresholds ascend."""

    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = 250, rate: float = 0.08, l1: float = 4e-4, l2: float = 1e-4, min_rows: int = 3) -> OrdinalModel:
    """Proportional-odds fit by proximal Adam steps over all rows; features of under min_rows rows get no weight."""
    n = len(rows)
    if not n:
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.linspace(-1, 1, n_grades - 1))
    flat, size = np.concatenate(rows), np.array([len(r) for r in rows])
    used = np.flatnonzero(np.bincount(flat, minlength=1 << BITS) >= min_rows)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    row, col = np.repeat(np.arange(n), size), place[flat]
    row, col = row[col >= 0], col[col >= 0]
    share = np.bincount(grades, minlength=n_grades)
    weight = (n / np.maximum(share, 1) / (share > 0).sum())[grades]  # grades count alike
    w = np.zeros(len(used))
    first, gaps = -1.0, np.zeros(n_grades - 2)
    state = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros(n_grades - 1), np.zeros(n_grades - 1))]
    for step in range(1, steps + 1):
        theta = np.concatenate([[first], first + np.cumsum(np.exp(gaps))]) if n_grades > 2 else np.array([first])
        f = np.bincount(row, w[col], n)
        up = np.concatenate([theta, [np.inf]])[grades] - f
        lo = np.concatenate([[-np.inf], theta])[grades] - f
        su, sl = np.where(np.isinf(up), 1.0, _sigmoid(up)), np.where(np.isinf(lo), 0.0, _sigmoid(lo))
        p = np.maximum(su - sl, 1e-9)
        gu, gl = weight * su * (1 - su) / p / n, weight * sl * (1 - sl) / p / n  # of log p by the upper and lower bound
        g_w = np.bincount(col, (gu - gl)[row], len(w)) + l2 * w
        g_theta = np.zeros(n_grades - 1)
        np.add.at(g_theta, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -gu, 0))
        np.add.at(g_theta, np.maximum(grades - 1, 0), np.where(grades > 0, gl, 0))
        g_t = np.concatenate([[g_theta.sum()], [np.exp(gaps[k]) * g_theta[k + 1 :].sum() for k in range(n_grades - 2)]])
        moves = []
        for (m, v), g in zip(state, (g_w, g_t)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        scale = rate / (np.sqrt(state[0][1] / (1 - 0.999**step)) + 1e-8)
        w = w - moves[0]
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale * l1, np.abs(w)), 0)
        first, gaps = first - moves[1][0], gaps - moves[1][1:]
    theta = np.concatenate([[first], first + np.cumsum(np.exp(gaps))]) if n_grades > 2 else np.array([first])
    whole = np.zeros(1 << BITS, np.float32)
    whole[used] = w
    return OrdinalModel(whole, theta)


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good. Of several rows of a document the worst counts; nulls give none."""
    grade = F.when(F.col("toxic") == 1, 0).when((F.col("quality") == 0) & (F.col("toxic") == 0), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def held_out(id_col: str = "doc_id", parts: int = 5):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(False))


def train(docs: DataFrame, graded: DataFrame, n_grades: int = 3, per_grade: int = SAMPLE_PER_GRADE, features_per_row: int = FEATURES_PER_ROW, text_col: str = "text", id_col: str = "doc_id") -> OrdinalModel:
    """Fit on at most per_grade rows of each grade, those whose ids hash lowest, outside the held-out fifth.

    graded: doc_id, grade (0 to n_grades - 1). The sample is the only thing that the driver holds: its ids, at most
    n_grades * per_grade of them, are broadcast, and features_per_row features of four bytes of each are gathered, however long the texts are.
    With a document's text repeated under its id, each of these rows is read, up to the sample's bound.
    """
    pool = graded.where(~held_out()).where("doc_id IS NOT NULL AND grade IS NOT NULL").select("doc_id", "grade", F.xxhash64("doc_id").alias("h"))
    sample = lowest_hashed(pool, "grade", per_grade, n_grades * per_grade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([least(features(t.as_py()), features_per_row).tobytes() for t in b.column(2)], pa.binary())], names=["h", "grade", "x"])

    wanted = F.broadcast(sample.select(F.col("doc_id").alias("_id"), "grade", "h"))
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text")).join(wanted, F.col("_doc") == F.col("_id")).select("h", "grade", "_text")
    read = rows.mapInArrow(run, "h long, grade int, x binary").orderBy("h", "grade", "x").limit(n_grades * per_grade)  # ids may be repeated
    found = read.collect()
    return fit([np.frombuffer(r.x, np.int32) for r in found], np.array([r.grade for r in found], np.int64), n_grades)


class Weights(dict):
    """Token to weight, filled as tokens come."""

    def __init__(self, model: OrdinalModel):
        super().__init__()
        self.table = model.weights

    def __missing__(self, token: str) -> float:
        w = float(self.table[crc32(token.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)])
        if len(self) < 400_000:
            self[token] = w
        return w


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", id_col: str = "doc_id", at_least: int | None = None, keep_above: float = 0.5) -> DataFrame:
    """Grade every whole text: doc_id, expected_grade, p_ge_1 .. p_ge_K-1 (tail probabilities), grade (likeliest), kept.

    kept: P(grade >= at_least) is over keep_above; at_least is the top grade unless given. A null, empty or blank text has
    no features and gets the grade of the thresholds alone. Rows keep their number, repeated ones too; ids may be null. An
    empty table gives no rows. Other columns are not read.
    """
    tails = [f"p_ge_{k}" for k in range(1, model.grades)]
    schema = "doc_id long, expected_grade double, " + "".join(f"{t} double, " for t in tails) + "grade int, kept boolean"
    top = (model.grades - 1 if at_least is None else at_least) - 1
    sparse = np.flatnonzero(model.weights)
    packed = (sparse.astype(np.int32), model.weights[sparse])
    theta = model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.float32)
        table[packed[0]] = packed[1]
        weights = Weights(OrdinalModel(table, theta))
        for b in batches:
            f = np.array([_exact_sum(weights, t.as_py()) for t in b.column(1)])
            tail = 1 - _sigmoid(theta[None, :] - f[:, None])
            each = np.diff(np.concatenate([np.zeros((len(f), 1)), 1 - tail, np.ones((len(f), 1))], axis=1), axis=1)
            cols = [b.column(0), pa.array(tail.sum(axis=1)), *(pa.array(tail[:, k]) for k in range(len(theta))), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(tail[:, top] > keep_above)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "expected_grade", *tails, "grade", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, schema)


def _exact_sum(weights: Weights, text: str | None) -> float:
    return math.fsum(map(weights.__getitem__, _tokens(text or "")))


def keep_good(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep_above: float = 0.5) -> DataFrame:
    """The rows of docs that score() would keep, with their own columns, in one pass."""
    theta, sparse = model.thresholds, np.flatnonzero(model.weights)
    packed = (sparse.astype(np.int32), model.weights[sparse])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.float32)
        table[packed[0]] = packed[1]
        weights = Weights(OrdinalModel(table, theta))
        for b in batches:
            f = np.array([_exact_sum(weights, t.as_py()) for t in b.column(names.index(text_col))])
            yield b.filter(pa.array(1 - _sigmoid(theta[-1] - f) > keep_above))

    return docs.mapInArrow(run, docs.schema)
