"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Statistics of whole texts are standardised; random cosines of them approximate a Gaussian kernel. The normal
equations are sums over rows, so each partition sends its sums per fold and they are added up: all labelled rows
take part, none is sampled. Leaving one fold's sums out gives scores that a row had no part in; those, counted on
a fine grid, are what the isotonic fit sees. The driver only ever holds the summed square matrix and the grid.

Scores depend on the text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import bucket_of, map_text, prepare
from tickloom.session import checkpoint

COSINES = 256
SEED = 11
RIDGE = 1.0  # added to the diagonal, in rows
CUT = 0.3
GRID = 1000  # cells per unit of raw score
LIMIT = 6.0  # standardised statistics are clipped here

STATISTICS = (
    "log words, mean word length, spread of word length, distinct words, once-only words, commonest word, repeats of the "
    "word before, words ending in symbols, words without letters, short words, sentence ends, capitalised words, upper "
    "case words, log lines, distinct lines, log words per line, letters, digits, capitals, symbols, shouts, long words"
).split(", ")

_BYTES = np.zeros((256, 5))
_BYTES[[*range(65, 91), *range(97, 123), *range(0xC3, 256)], 0] = 1  # letters: ASCII and what starts a longer character
_BYTES[48:58, 1] = 1
_BYTES[65:91, 2] = 1
_BYTES[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"], 3] = 1
_BYTES[[ord(c) for c in "!?"], 4] = 1


def statistics_of(text: str) -> list[float]:
    """The numbers of :data:`STATISTICS`; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    last = "".join([w[-1] for w in words])
    ends = np.bincount(np.frombuffer(last.encode(), np.uint8), minlength=256)
    plain = np.fromiter(map(str.isalpha, last), bool, n).sum() + ends[48:58].sum() + sum(ends[ord(c)] for c in ".,;:!?\"')")
    lines = [x for x in text.split("\n") if x.strip()]
    # counting bytes in pieces bounds the memory that a very long text takes
    raw = np.frombuffer(text.encode(), np.uint8)
    seen = np.zeros(256)
    for at in range(0, len(raw), 1 << 22):
        seen += np.bincount(raw[at : at + (1 << 22)], minlength=256)
    kinds = seen @ _BYTES
    visible = max(1.0, float(lengths.sum()))
    letters = max(1.0, kinds[0])
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(len(counts)) / np.log1p(n)),
        sum(v == 1 for v in counts.values()) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1.0 - float(plain) / n,
        sum(not any(map(str.isalpha, w)) * c for w, c in counts.items()) / n,
        float((lengths <= 3).mean()),
        float(ends[[ord(c) for c in ".!?"]].sum()) / n,
        sum(w[:1].isupper() * c for w, c in counts.items()) / n,
        sum(w.isupper() * c for w, c in counts.items()) / n,
        float(np.log1p(len(lines))),
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        float(kinds[0]) / visible,
        float(kinds[1]) / visible,
        float(kinds[2]) / letters,
        float(kinds[3]) / visible,
        float(kinds[4]) / n,
        float((lengths > 25).mean()),
    ]


@dataclass
class Basis:
    """Centre and scale of the statistics, and the random frequencies."""

    centre: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray

    def rows(self, stats: np.ndarray) -> np.ndarray:
        """One, the standardised statistics, their cosines."""
        x = np.clip((stats - self.centre) / self.scale, -LIMIT, LIMIT)
        z = np.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases)
        return np.hstack([np.ones((len(x), 1)), x, z])


@dataclass
class QualityModel:
    """Ridge weights, and the isotonic steps as knots of raw score and share of label 1."""

    basis: Basis
    weights: np.ndarray
    knots: np.ndarray
    shares: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = np.clip(self.basis.rows(stats) @ self.weights, -1.0, 2.0)
        # a thousandth of the raw score keeps apart what the steps put level
        return np.clip(0.999 * np.interp(raw, self.knots, self.shares) + 0.001 * (raw + 1.0) / 3.0, 0.0, 1.0)


def _basis(labelled: DataFrame, cosines: int) -> Basis:
    d = len(STATISTICS)
    parts = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = labelled.agg(*parts).first()
    centre = np.array([row[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([row[f"s{i}"] or 0.0 for i in range(d)])
    draw = np.random.default_rng(SEED)
    # the kernel's width is the usual distance of two standardised rows
    return Basis(centre, np.where(scale > 1e-9, scale, 1.0), draw.normal(size=(d, cosines)) / np.sqrt(d), draw.uniform(0, 2 * np.pi, cosines))


def _stats(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).values.to_numpy().reshape(batch.num_rows, -1)


def _sums(labelled: DataFrame, basis: Basis) -> dict[int, np.ndarray]:
    """Summed products of rows and labels by fold: a (k + 1) x (k + 1) matrix each, the label last."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            folds, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = np.hstack([basis.rows(_stats(batch, 2)), y[:, None]])
            for fold in np.unique(folds):
                part = rows[folds == fold]
                total[int(fold)] = total.get(int(fold), 0) + part.T @ part
        for fold, sums in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([fold] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))],
                names=["fold", "i", "v"],
            )

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": part["fold"][:1], "i": part["i"][:1], "v": [np.stack(part["v"]).sum(axis=0)]})

    schema = "fold int, i int, v array<double>"
    rows = labelled.select("fold", "y", "x").mapInArrow(partial, schema).groupBy("fold", "i").applyInPandas(add, schema).collect()
    sums: dict[int, dict[int, list[float]]] = {}
    for r in rows:  # folds x (k + 1) rows, whatever the input
        sums.setdefault(r["fold"], {})[r["i"]] = r["v"]
    return {fold: np.array([v[i] for i in sorted(v)]) for fold, v in sums.items()}


def _solve(sums: np.ndarray) -> np.ndarray:
    k = len(sums) - 1
    penalty = np.full(k, RIDGE)
    penalty[0] = 1e-6
    return np.linalg.solve(sums[:k, :k] + np.diag(penalty), sums[:k, k])


def isotonic(at: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over cells ``at`` with label sums ``y`` of ``n`` rows: knots and shares."""
    blocks: list[list[float]] = []
    for a, s, c in sorted(zip(at, y, n, strict=True)):
        blocks.append([a * c, s, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit_quality(docs: DataFrame, labels: DataFrame, cosines: int = COSINES) -> QualityModel | None:
    """Fit on rows of ``docs(doc_id, text)`` whose bucket is not 0 and that ``labels(doc_id, quality)`` marks.

    Labels are averaged per id; null ids or labels mark nothing. Without any marked row there is no model.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(bucket_of(F.col("doc_id")) != 0)
    marks = marks.groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    trained = docs.where(bucket_of(F.col("doc_id")) != 0)
    keep = [F.col("doc_id"), bucket_of(F.col("doc_id")).alias("fold")]
    labelled = checkpoint(_with_stats(trained, keep, F.col("text")).join(marks, "doc_id").select("fold", "y", "x"))
    prepare(labelled)
    basis = _basis(labelled, cosines)
    sums = _sums(labelled, basis)
    if not sums:
        return None
    total = sum(sums.values())
    # where all labelled rows lie in one fold there is nothing to leave out
    without = {fold: _solve(total - s if len(sums) > 1 else total) for fold, s in sums.items()}

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, rows = batch.column(0).to_numpy(), basis.rows(_stats(batch, 2))
            raw = np.array([r @ without[int(f)] for f, r in zip(folds, rows, strict=True)])
            cell = np.floor(np.clip(raw, -1.0, 2.0) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], names=["cell", "y"])

    cells = labelled.select("fold", "y", "x").mapInArrow(grid, "cell long, y double")
    rows = cells.groupBy("cell").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()  # at most 3 x GRID + 1
    at = np.array([(r["cell"] + 0.5) / GRID for r in rows])
    knots, shares = isotonic(at, np.array([r["y"] for r in rows]), np.array([float(r["n"]) for r in rows]))
    return QualityModel(basis, _solve(total), knots, shares)


def _with_stats(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    def start():
        def work(texts: list[str]) -> list[list]:
            return [[statistics_of(t) for t in texts]]

        return work

    return map_text(docs, keep, text, {"x": "array<double>"}, start)


def score_quality(docs: DataFrame, model: QualityModel | None, keep: list[Column], text: Column, cut: float = CUT) -> DataFrame:
    """``keep``, ``score`` (0 to 1) and ``predicted`` (1 from ``cut`` on) for every row; a null text is empty.

    Without a model every score is 1: nothing is known against any text.
    """

    def start():
        def work(texts: list[str]) -> list[list]:
            if model is None:
                return [[1.0] * len(texts), [1] * len(texts)]
            score = model.score(np.array([statistics_of(t) for t in texts]))
            return [score, (score >= cut).astype(np.int32)]

        return work

    return map_text(docs, keep, text, {"score": "double", "predicted": "int"}, start)
