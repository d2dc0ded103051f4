"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes DIM statistics, counts and shares brought near a normal shape by logs and logits. Labelled rows of
the training folds give class means and covariances as sums of products, taken in Spark over all of them. Each class
covariance is shrunk twice: towards the pooled covariance by POOL, and towards a multiple of the identity by an
intensity estimated from the rows themselves (the ratio of the noise in the sample covariance to its distance from the
target, from one more sum of fourth powers). The Cholesky factor of each shrunk covariance is computed once and
shipped; a score is the logistic of the difference of log densities (squared Mahalanobis distances and log
determinants), tempered by TEMPERATURE because the statistics are not independent draws, plus the log prior ratio.

Only the statistics enter a score; ids, languages, sources and labels do not. Training reads rows with
crc32(id as text) mod 5 <> 0; the others are marked ``held_out``.

Defined cases: null and empty texts have the statistics of an empty text and get a score; a label that is null or
neither 0 nor 1 is not learnt from; several labels of one document each count; a class without rows, or empty tables,
leave the share of good labels (one half without any) as every score; long texts are measured whole; repeated rows
are scored row by row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlens.llm.common import crc_fold, stored, table, texts
from crawlens.llm.quality_rules import ASCII, BLANKS, SYMBOLS, numbered, repeated_words

POOL = 0.1
TEMPERATURE = 2.0
CUT = 0.3
NAMES = ("words", "word_length", "symbols", "upper", "digits", "marks", "exclaims", "repeats", "line_repeats", "top_word", "kinds", "line_words", "pair_repeats", "short_words")
DIM = len(NAMES)


def _logit(share: float) -> float:
    return float(np.log((share + 0.005) / (1.005 - share)))


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    text = text or b""
    words = text.split()
    ids = numbered(words)
    n, chars = max(1, len(words)), max(1, len(text))
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    wide = text.translate(None, ASCII).decode(errors="replace")
    letters = int(of[65:91].sum() + of[97:123].sum()) + len(wide)
    points = len(text) - int(of[0x80:0xC0].sum()) - int(of[list(BLANKS)].sum())
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    tops = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    pairs = ids[:-1] * len(tops) + ids[1:]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        float(np.log1p(len(words))),
        float(np.log1p(points / n)),
        _logit(min(1.0, int(of[list(SYMBOLS)].sum()) / n)),
        _logit(min(1.0, (int(of[65:91].sum()) + sum(map(str.isupper, wide))) / max(1, letters))),
        _logit(int(of[48:58].sum()) / chars),
        _logit(min(1.0, int(of[[44, 46, 58, 59, 63]].sum()) / n)),
        _logit(min(1.0, int(of[33]) / n)),
        _logit(repeated_words(ids) / n),
        _logit((len(lines) - len(set(lines))) / max(1, len(lines))),
        _logit(int(tops.max()) / n),
        _logit(int((tops > 0).sum()) / n) + 0.25 * float(np.log1p(len(words))),
        float(np.log1p(n / max(1, len(lines)))),
        _logit(1 - len(np.unique(pairs)) / max(1, len(pairs))) if len(pairs) else _logit(0.0),
        _logit(float((lengths <= 3).sum()) / n),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, x)`` for every document; x holds the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in texts(b, "_text")], np.float64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, DIM), pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), lists], names=["doc_id", "held_out", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), (crc_fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("_text"))
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, x array<double>")


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").values.to_numpy(zero_copy_only=False).reshape(-1, DIM)[: batch.num_rows] if batch.num_rows else np.zeros((0, DIM))


def _summed(rows: DataFrame, fn, cells: int) -> np.ndarray:
    """Sums over all rows of what ``fn(batch)`` gives: one row of ``cells`` numbers per task, added up in Spark."""

    def run(batches):
        total = np.zeros(cells)
        for b in batches:
            total += fn(pa.RecordBatch.from_arrays([b.column("label"), pa.concat_arrays([b.column("x")])], names=["label", "x"]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["cell", "v"])

    out = np.zeros(cells)
    for r in rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # ``cells`` rows at any size
        out[r["cell"]] = r["v"]
    return out


@dataclass
class Discriminant:
    """Class means, inverted Cholesky factors, log determinants and the log prior ratio; ``base`` alone if there was nothing to learn."""

    base: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None
    prior: float = 0.0
    shrinkage: tuple[float, float] = (0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.base)
        density = [-0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) - 0.5 * self.logdets[k] for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE + self.prior, -40, 40)))


def fitted(train: DataFrame, pool: float = POOL) -> Discriminant:
    """``train(label, x)`` with labels 0 and 1 → the discriminant."""
    size = 1 + DIM + DIM * DIM

    def moments(b):
        y, x = b.column("label").to_numpy(zero_copy_only=False), _vectors(b)
        return np.concatenate([np.concatenate(([len(v)], v.sum(axis=0), (v.T @ v).reshape(-1))) for v in (x[y == 0], x[y == 1])])

    m = _summed(train, moments, 2 * size).reshape(2, size)
    n = m[:, 0]
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5)
    means = m[:, 1 : 1 + DIM] / n[:, None]
    covs = m[:, 1 + DIM :].reshape(2, DIM, DIM) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    scale = np.sqrt(np.diagonal((n[:, None, None] * covs).sum(axis=0) / n.sum()) + 1e-6)  # of the pooled statistics

    def fourth(b):
        y, x = b.column("label").to_numpy(zero_copy_only=False), _vectors(b)
        return np.array([((((x[y == k] - means[k]) / scale) ** 2).sum(axis=1) ** 2).sum() for k in (0, 1)])

    powers = _summed(train, fourth, 2)
    pooled = (n[:, None, None] * covs).sum(axis=0) / n.sum()
    factors, logdets, used = [], [], []
    for k in (0, 1):
        s = covs[k] / np.outer(scale, scale)
        mu = np.trace(s) / DIM
        spread = ((s - mu * np.eye(DIM)) ** 2).sum()
        noise = max(0.0, powers[k] / n[k] - (s**2).sum()) / n[k]
        a = float(min(1.0, max(0.02, noise / max(spread, 1e-12))))
        s = (1 - pool) * s + pool * pooled / np.outer(scale, scale)
        s = (1 - a) * s + a * max(mu, 0.05) * np.eye(DIM)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low) / scale[None, :])
        logdets.append(2 * np.log(np.diag(low)).sum())
        used.append(a)
    return Discriminant(float(n[1] / n.sum()), means, np.array(factors), np.array(logdets), float(np.log(n[1] / n[0])), tuple(used))


def scored(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    own = stored(measured(docs), "statistics")
    known = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    train = stored(own.where("NOT held_out").join(known, "doc_id").select("label", "x"), "training")
    model = fitted(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = pa.RecordBatch.from_arrays([pa.concat_arrays([b.column("x")])], names=["x"])
            s = model.score(_vectors(whole))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
