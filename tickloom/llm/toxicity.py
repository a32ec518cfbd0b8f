"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Words are hashed into two small embedding tables; filters of several widths run along the whole text, each keeps
its maximum, and a logistic layer reads those. Training takes a bounded sample of labelled rows; scoring, calibration
and thresholds take all rows. Buckets of words too rare in the sample stay zero, so unseen words say nothing.

The language chooses the reported threshold only; scores depend on the text alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import bucket_of, map_text
from tickloom.session import checkpoint

BUCKETS = 1 << 16
WIDTH = 8
FILTERS = 8
SPANS = (1, 2, 3)
EPOCHS = 8
RATE = 0.15
STEM = 7  # leading characters that make a word's stem
SKIP = 0.3  # share of words left out of a training step at random
MIN_DOCS = 3  # sample documents a bucket must occur in to be trained
SEED = 5
SAMPLE_DOCS = 4000  # labelled documents in the training sample, half of them toxic where there are as many
SAMPLE_WORDS = 3_000_000  # words in the training sample
PARTS = 8  # one document holds at most this part of the training sample
PIECE = 20_000  # words convolved at once
EDGES = " \t.,;:!?\"'()[]{}<>*#$%&|~^`=+-_/\\@"


class Buckets(dict):
    """Word -> a bucket of its own and one of its stem, from 1 on; 0 pads. Forgets when it has grown large."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        base = word.strip(EDGES).lower().encode()
        stem = word.strip(EDGES).lower()[:STEM].encode() + b"\x01"
        found = (1 + zlib.crc32(base) % (BUCKETS - 1), 1 + zlib.crc32(stem) % (BUCKETS - 1)) if base else (0, 0)
        self[word] = found
        return found


def bucket_rows(text: str, memory: Buckets) -> np.ndarray:
    """Two bucket numbers for each word of the text."""
    words = text.split()
    return np.array(list(map(memory.__getitem__, words)), np.int32).reshape(len(words), 2)


@dataclass
class Network:
    """Two embedding tables, filters by span (span, WIDTH, FILTERS) with biases, and the logistic layer."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    base: float

    def projected(self) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """What each bucket adds to each filter at each place: lookups replace products when scoring."""
        return [[tuple((t @ f[j]).astype(np.float32) for t in self.tables) for j in range(len(f))] for f in self.filters]

    def pooled(self, pieces: list[np.ndarray], ready) -> np.ndarray:
        """Maxima of all filters over each padded piece: rows of len(SPANS) * FILTERS numbers."""
        ids = np.concatenate(pieces)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
        columns = []
        for span, (places, bias) in zip(SPANS, zip(ready, self.biases, strict=True), strict=True):
            acts = np.zeros((len(ids), FILTERS), np.float32)
            for j, (one, two) in enumerate(places):
                end = len(ids) - j
                acts[:end] += one[ids[j:, 0]]
                acts[:end] += two[ids[j:, 1]]
            # the last span - 1 places of a piece would reach into the next one
            for k in range(1, span):
                acts[np.append(starts[1:], len(ids)) - k] = -np.inf
            columns.append(np.maximum(np.maximum.reduceat(acts, starts, axis=0) + bias, 0.0))
        return np.hstack(columns)

    def logits(self, texts: list[np.ndarray], ready) -> np.ndarray:
        """One number per text, whatever its length: long texts go in overlapping pieces."""
        pad = max(SPANS) - 1
        tail = np.zeros((pad, 2), np.int32)
        best = np.zeros((len(texts), len(SPANS) * FILTERS))
        pieces: list[np.ndarray] = []
        owners: list[int] = []

        def flush():
            if pieces:
                np.maximum.at(best, owners, self.pooled(pieces, ready))
                pieces.clear()
                owners.clear()

        held = 0
        for i, ids in enumerate(texts):
            for at in range(0, max(1, len(ids)), PIECE):
                piece = ids[at : at + PIECE + pad]
                # only the end of the text is padded; earlier pieces overlap the next one instead
                pieces.append(np.concatenate([piece, tail]) if at + PIECE + pad >= len(ids) else piece)
                owners.append(i)
                held += len(piece)
                if held >= PIECE:
                    flush()
                    held = 0
        flush()
        return best @ self.out + self.base


def train(texts: list[np.ndarray], y: np.ndarray) -> Network:
    """Stochastic gradient steps with per-weight rates (Adagrad), one text at a time."""
    draw = np.random.default_rng(SEED)
    seen = [np.zeros(BUCKETS, np.int32) for _ in range(2)]
    for ids in texts:
        for k in range(2):
            seen[k][np.unique(ids[:, k])] += 1
    known = [s >= MIN_DOCS for s in seen]
    for k in known:
        k[0] = False
    tables = [np.zeros((BUCKETS, WIDTH), np.float64) for _ in range(2)]
    filters = [draw.normal(0, 1 / np.sqrt(s * WIDTH), (s, WIDTH, FILTERS)) for s in SPANS]
    biases = [np.full(FILTERS, 0.05) for _ in SPANS]
    out = draw.normal(0, 0.3, len(SPANS) * FILTERS)
    base = 0.0
    g_tables = [np.full(BUCKETS, 1e-3) for _ in range(2)]
    g_filters = [np.full(f.shape, 1e-3) for f in filters]
    g_biases = [np.full(FILTERS, 1e-3) for _ in SPANS]
    g_out, g_base = np.full(len(out), 1e-3), 1e-3
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    pad = max(SPANS)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(texts)):
            ids = np.concatenate([texts[i], np.zeros((pad, 2), np.int32)])
            ids[draw.random(len(ids)) < SKIP] = 0
            words = tables[0][ids[:, 0]] + tables[1][ids[:, 1]]
            where, pooled = [], []
            for s, f, b in zip(SPANS, filters, biases, strict=True):
                n = len(words) - s + 1
                acts = sum(words[j : j + n] @ f[j] for j in range(s))
                at = acts.argmax(axis=0)
                where.append(at)
                pooled.append(np.maximum(acts[at, np.arange(FILTERS)] + b, 0.0))
            h = np.concatenate(pooled)
            p = 1 / (1 + np.exp(-np.clip(h @ out + base, -30, 30)))
            d = (p - y[i]) * weight[i]
            if abs(d) < 1e-4:
                continue
            dh = d * out * (h > 0)
            grad = d * h + 1e-4 * out
            g_out += grad**2
            out -= RATE * grad / np.sqrt(g_out)
            g_base += d**2
            base -= RATE * d / np.sqrt(g_base)
            for k, (s, f) in enumerate(zip(SPANS, filters, strict=True)):
                part = dh[k * FILTERS : (k + 1) * FILTERS]
                g_biases[k] += part**2
                biases[k] -= RATE * part / np.sqrt(g_biases[k])
                live = np.flatnonzero(part)
                if not len(live):
                    continue
                for j in range(s):
                    at = where[k][live] + j
                    df = words[at].T * part[live]
                    to = f[j][:, live] * part[live]
                    g_filters[k][j][:, live] += df**2
                    f[j][:, live] -= RATE * df / np.sqrt(g_filters[k][j][:, live])
                    for t in range(2):
                        rows = ids[at, t]
                        ok = known[t][rows]
                        if ok.any():
                            step = to[:, ok].T
                            np.add.at(g_tables[t], rows[ok], (step**2).mean(axis=1))
                            np.add.at(tables[t], rows[ok], -RATE * step / np.sqrt(g_tables[t][rows[ok]])[:, None])
    return Network([t.astype(np.float32) for t in tables], filters, biases, out, float(base))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Network | None:
    """Train on a sample of the marked rows of buckets 2 to 4: at most ``sample_docs`` documents and, in order of a
    hash of the id, ``sample_words`` words. A document that does not fit is passed over, one of more than a
    :data:`PARTS` th of the words gives its place to another; only where a kind has no other document does its shortest
    one come in, whatever its length. Without marked documents of both kinds there is no model."""
    marks = _marks(labels, (2, 3, 4)).withColumn("y", (F.col("toxic") >= 0.5).cast("int"))
    share = max(1, sample_words // PARTS)
    hashed, sizes = _hashed_sample(docs, marks, sample_docs)
    if any(n > share for _, _, n in sizes):  # documents too long for a sample give their place to others
        hashed, sizes = _hashed_sample(docs, marks.join(_long_ids(docs, share), "doc_id", "left_anti"), sample_docs)
        missing = [k for k in (0, 1) if k not in {y for _, y, _ in sizes}]
        for k in missing:  # a kind with long documents alone: its shortest one
            more, size = _hashed_sample(docs, _shortest(docs, marks.where(F.col("y") == k)), 2)
            hashed, sizes = hashed.unionByName(more), sizes + size
    if len({y for _, y, _ in sizes}) < 2:
        return None
    # both kinds in turn; a document that does not fit is passed over
    turn = {0: 0, 1: 0}
    ranked = []
    for doc, y, n in sorted(sizes, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0])):
        ranked.append((turn[y], y, doc, n))
        turn[y] += 1
    held, within = 0, set()
    for _, _, doc, n in sorted(ranked):
        if n > share:  # the only one of its kind, besides the words of the others
            within.add(doc)
        elif held + n <= sample_words:
            held += n
            within.add(doc)
    keep = F.broadcast(docs.sparkSession.createDataFrame([(int(d),) for d in sorted(within)], "id long"))
    got = sorted(hashed.join(keep, "id").select("id", "y", "ids").collect(), key=lambda r: r["id"])  # one row per id
    return train([np.array(r["ids"], np.int32).reshape(-1, 2) for r in got], np.array([r["y"] for r in got]))


def _hashed_sample(docs: DataFrame, marks: DataFrame, sample_docs: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``id, y, ids, n`` of the first marked documents of each kind in order of a hash of the id, and their ``(id, y,
    n)``. Rows that repeat an id are one document, the shortest of them."""
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string")))
    chosen = [marks.where(F.col("y") == k).orderBy(order).limit(sample_docs // 2) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("id"), "y").collect()  # at most sample_docs
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, "id long, y int"))
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id"))
    first = F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "text")).alias("first")
    rows = rows.groupBy("id", "y").agg(first).select("id", "y", "first.text")

    def start():
        memory = Buckets()

        def work(texts: list[str]) -> list[list]:
            return [[bucket_rows(t, memory).ravel() for t in texts]]

        return work

    hashed = map_text(rows, [F.col("id"), F.col("y")], F.col("text"), {"ids": "array<int>"}, start)
    hashed = checkpoint(hashed.withColumn("n", (F.size("ids") / 2).cast("long")))
    return hashed, [tuple(r) for r in hashed.select("id", "y", "n").collect()]


def _word_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, n``: words of the shortest row of each id."""

    def start():
        return lambda texts: [[len(t.split()) for t in texts]]

    counts = map_text(docs.where("doc_id IS NOT NULL"), [F.col("doc_id")], F.col("text"), {"n": "long"}, start)
    return counts.groupBy("doc_id").agg(F.min("n").alias("n"))


def _long_ids(docs: DataFrame, share: int) -> DataFrame:
    """Ids of documents of more than ``share`` words, whichever row of theirs counts."""
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * share).select("doc_id")  # cannot hold more
    long = docs.where(F.octet_length("text") >= 2 * share).join(short, "doc_id", "left_anti")
    return _word_counts(long).where(F.col("n") > share).select("doc_id")


def _shortest(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The mark of the document with the fewest words."""
    return marks.join(_word_counts(docs), "doc_id").orderBy("n", "doc_id").limit(1).drop("n")


def _marks(labels: DataFrame, buckets: tuple[int, ...]) -> DataFrame:
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(bucket_of(F.col("doc_id")).isin(*buckets))
    return marks.groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))


def raw_scores(docs: DataFrame, model: Network | None, keep) -> DataFrame:
    """``keep`` and ``logit`` for every whole text. Without a model nothing is known against any text: -20."""

    def start():
        memory = Buckets()
        ready = model.projected() if model else None

        def work(texts: list[str]) -> list[list]:
            if model is None:
                return [[-20.0] * len(texts)]
            return [model.logits([bucket_rows(t, memory) for t in texts], ready)]

        return work

    return map_text(docs, keep, F.col("text"), {"logit": "double"}, start)


def _platt(at: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through label sums ``y`` of ``n`` rows per cell, by Newton steps."""
    a, b = 1.0, 0.0
    total, ones = n.sum(), y.sum()
    t = (y * (ones + 1) / (ones + 2) + (n - y) / (total - ones + 2)) / n  # softened targets
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * at + b, -30, 30)))
        g = np.array([(n * (p - t) * at).sum(), (n * (p - t)).sum()])
        w = n * p * (1 - p)
        hess = np.array([[(w * at * at).sum(), (w * at).sum()], [(w * at).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def _threshold(score: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The score with the best F1 when everything from it on counts as toxic."""
    order = np.argsort(-score)
    hits, flagged = np.cumsum(y[order]), np.cumsum(n[order])
    f1 = 2 * hits / np.maximum(flagged + y.sum(), 1e-9)
    best = int(f1.argmax())
    below = score[order][best + 1] if best + 1 < len(order) else 0.0
    return float((score[order][best] + below) / 2)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Network | None, cut: float = 0.5) -> DataFrame:
    """``doc_id, lang, score, predicted, threshold, flagged`` for every row of ``docs(doc_id, text, lang)``.

    ``score`` is calibrated on all marked rows of bucket 1, which no training saw; ``predicted`` is 1 from ``cut`` on.
    ``threshold`` is the language's own (the common one where a language has no toxic mark), ``flagged`` what it gives.
    A null text is empty; repeated rows come back as often as given; an empty table gives no rows.
    """
    scored = checkpoint(raw_scores(docs, model, [F.col("doc_id"), F.col("lang")]))
    marks = _marks(labels, (1,))
    cell = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("logit"))) * 20)
    joined = scored.join(marks, "doc_id").groupBy("lang", cell.alias("cell"))
    sums = joined.agg(F.sum("toxic").alias("y"), F.count("*").alias("n"))
    by_cell = sums.groupBy("cell").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect()  # at most 801 rows
    slope, shift, common = 1.0, 0.0, cut
    if by_cell:
        at = np.array([(r["cell"] + 0.5) / 20 for r in by_cell])
        y, n = np.array([float(r["y"]) for r in by_cell]), np.array([float(r["n"]) for r in by_cell])
        slope, shift = _platt(at, y, n)
        common = _threshold(1 / (1 + np.exp(-np.clip(slope * at + shift, -30, 30))), y, n) if y.sum() else cut

    def of_language(part):
        x = slope * (part["cell"].to_numpy(float) + 0.5) / 20 + shift
        value = _threshold(1 / (1 + np.exp(-np.clip(x, -30, 30))), part["y"].to_numpy(float), part["n"].to_numpy(float)) if part["y"].sum() else common
        return part[["lang"]][:1].assign(own=value)

    # one group per language, of at most 801 cells
    own = sums.groupBy("lang").applyInPandas(of_language, "lang string, own double").withColumnRenamed("lang", "name")
    score = 1 / (1 + F.exp(-(F.lit(float(slope)) * F.col("logit") + F.lit(float(shift)))))
    rows = scored.join(own, F.col("lang").eqNullSafe(F.col("name")), "left").withColumn("score", score)
    threshold = F.coalesce("own", F.lit(float(common)))
    return rows.select(
        "doc_id",
        "lang",
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("flagged"),
    )
