"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of transformed statistics. A covariance is shrunk towards the pooled one and towards
a multiple of the identity, and its Cholesky factor is kept. The score is the difference of the two log densities, that is
of Mahalanobis distances and log determinants, mapped to 0..1 by a logistic curve that is fitted on a histogram of training
differences. Means, products and histograms are sums over all training rows, so nothing is sampled.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, few_rows, tidy

NAMES = ("words", "word_bytes", "word_spread", "upper", "symbols", "exclaim", "digits", "pipes", "stops", "distinct", "line_words", "again_lines", "long_words", "one_byte", "doubled")
DIM = len(NAMES)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&<>{}[]\\^_~=@")] = True


def features(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text: counts by log, shares by square root. Null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    letters, some = max(1, int(c[_LETTER].sum())), max(1, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda a, b: np.sqrt(min(a / b, 4.0))
    return np.array([
        np.log1p(n),
        np.log1p(size.mean()),
        np.log1p(size.std()),
        share(int(c[_UPPER].sum()), letters),
        share(int(c[_SYMBOL].sum()), some),
        share(int(c[33]), some),
        share(int(c[48:58].sum()), some),
        share(int(c[124]), some),
        share(int(c[46] + c[44]), some),
        np.log(len(set(words)) + 1) - 0.75 * np.log1p(n),
        np.log1p(n / max(1, len(lines))),
        share(len(lines) - len(set(lines)), max(1, len(lines))),
        share(int((size > 18).sum()), some),
        share(int((size == 1).sum()), some),
        share(sum(map(eq, words, words[1:])), some),
    ])


@dataclass(frozen=True)
class Model:
    """Two classes, each a mean, the inverse of the covariance's Cholesky factor and its log determinant; then the curve."""

    means: np.ndarray
    factors: np.ndarray
    dets: np.ndarray
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        d = [-0.5 * np.square((x - self.means[k]) @ self.factors[k].T).sum(1) - 0.5 * self.dets[k] for k in (0, 1)]
        return np.clip(d[1] - d[0], -1e4, 1e4)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * squash(self.difference(x)) + self.offset, -30, 30)
        return 1 / (1 + np.exp(-z))


def squash(d: np.ndarray) -> np.ndarray:
    return np.sign(d) * np.log1p(np.abs(d))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few_rows(batches):
        x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, DIM)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * DIM), pa.array(x.ravel()))], names=["doc_id", "x"])


def document_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(tidy(_features), "doc_id long, x array<double>")


def held_out(id_col: str):
    """The fold that never trains: crc32 of the id as text, modulo 5, is 0. Null ids are not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, q = np.zeros(2), np.zeros((2, DIM)), np.zeros((2, DIM, DIM))
    for b in batches:
        x, y = b.column(0).flatten().to_numpy().reshape(-1, DIM), b.column(1).to_numpy()
        for k in (0, 1):
            z = x[y == k]
            n[k], s[k], q[k] = n[k] + len(z), s[k] + z.sum(0), q[k] + z.T @ z
    for k in (0, 1):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([[n[k], *s[k], *q[k].ravel()]])], names=["y", "m"])


def _sum_of(df: DataFrame) -> list[np.ndarray]:
    """Two sums of vectors of a fixed length, for y = 0 and 1."""
    size = {r["y"]: np.array(r["m"]) for r in df.select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).groupBy("y").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m")).collect()}
    return [size.get(k) for k in (0, 1)]


def train(rows: DataFrame, shrink: float = 0.2, ridge: float = 0.02, prior_rows: float = 5.0) -> Model:
    """The model of rows (x array<double>, y int). A class without rows makes every score 0.5, or its counterpart's share."""
    m = _sum_of(rows.select("x", "y").mapInArrow(_moments, "y int, m array<double>"))
    n = np.array([0.0 if v is None else v[0] for v in m])
    if n.min() < 2:
        share = (n[1] + 1) / (n.sum() + 2)
        return Model(np.zeros((2, DIM)), np.stack([np.eye(DIM)] * 2), np.zeros(2), 0.0, float(np.log(share / (1 - share))))
    means = np.stack([v[1 : DIM + 1] / v[0] for v in m])
    scatter = [v[DIM + 1 :].reshape(DIM, DIM) - v[0] * np.outer(mu, mu) for v, mu in zip(m, means)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    factors, dets = [], []
    for k in (0, 1):
        own = (scatter[k] + prior_rows * pooled) / (n[k] + prior_rows)
        cov = (1 - shrink) * own + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / DIM * np.eye(DIM)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    model = Model(means, np.stack(factors), np.array(dets), 1.0, 0.0)
    edges = np.linspace(-10, 10, 401)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((2, len(edges) - 1))
        for b in batches:
            d = np.clip(squash(model.difference(b.column(0).flatten().to_numpy().reshape(-1, DIM))), -9.99, 9.99)
            for k in (0, 1):
                c[k] += np.histogram(d[b.column(1).to_numpy() == k], edges)[0]
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c[k].tolist()])], names=["y", "m"])

    h = _sum_of(rows.select("x", "y").mapInArrow(histogram, "y int, m array<double>"))
    slope, offset = _curve((edges[1:] + edges[:-1]) / 2, h[0], h[1])
    return Model(means, model.factors, model.dets, slope, offset)


def _curve(at: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on one number, over counts, by Newton's method with a small ridge."""
    w = np.array([1.0, 0.0])
    x = np.stack([at, np.ones_like(at)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        n = n0 + n1
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (n1 - n * p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def labelled_rows(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y) of documents with a quality of 0 or 1 outside the held-out fold; an id with several labels counts for each."""
    y = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y")).where("y in (0, 1)").where(~held_out("doc_id"))
    return feats.join(y, "doc_id").select("x", "y")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each input row. Ids, labels, lang and source are no inputs of a score.

    Null texts count as empty and have a score too; repeated rows score alike, null ids are not held out, an id with several labels
    counts for each, and a text of any length is scored as a whole. Without rows of both labels every score is 0.5 or the one
    class's share. An empty table gives an empty one, and further columns of any name are not read.
    """
    feats = Scratch(df.sparkSession, "quality").save(document_features(df, id_col, text_col), "features")
    model = train(labelled_rows(feats, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1).flatten().to_numpy().reshape(-1, DIM)) if b.num_rows else np.array([])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    out = feats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of df that the classifier doesn't reject, with all their columns, whatever their names; texts are scored where they are
    read. Null and empty texts, repeated rows, null ids and missing labels are judged as in classify()."""
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id")).distinct()
    some = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    feats = Scratch(df.sparkSession, "quality").save(document_features(some).join(ids, "doc_id", "left_semi"), "features")
    model, at = train(labelled_rows(feats, labels)), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            x = np.array([features(t) for t in b.column(at).to_pylist()]).reshape(b.num_rows, DIM)
            yield b.filter(pa.array(model.score(x) >= threshold, pa.bool_()))

    return df.mapInArrow(tidy(run), T.StructType(df.schema.fields))
