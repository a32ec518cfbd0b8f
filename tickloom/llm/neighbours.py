"""Approximate nearest neighbours with a hash-prefix forest.

Every vector gets a long bit string per tree, each bit the side of a random hyperplane. A tree is the sorted array of
those strings. A query descends to its longest prefix by binary search in every tree, and all trees then ascend
together, one bit at a time: the vectors that share the shorter prefix are the next candidates. The ascent stops
when a vector as near as the query's k-th best so far would by now have shared a prefix in some tree with the wanted
probability, which follows from the angle between them; so it goes as far up as the data demand and no number of
candidates is fixed.

The forest is built per shard of rows, and queries come in blocks: the work is a join of shards and blocks on their
numbers, each task holding one shard and one block. Each pair gives at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text import prepare
from tickloom.session import checkpoint

TREES = 96
BITS = 24
SURE = 0.97  # wanted chance to have met a neighbour at the present k-th distance
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
SEED = 3


class Forest:
    """Sorted bit strings of one shard's vectors, per tree."""

    def __init__(self, vectors: np.ndarray, planes: np.ndarray, trees: int, bits: int):
        self.vectors, self.planes, self.trees, self.bits = vectors, planes, trees, bits
        self.centre = vectors.mean(axis=0)
        # typical lengths about the centre: with them a distance becomes an angle
        lengths = np.sqrt(((vectors - self.centre) ** 2).sum(axis=1))
        self.lengths = np.quantile(lengths, np.linspace(0.05, 0.95, 10))
        keys = self.strings(vectors)
        order = np.argsort(keys, axis=1, kind="stable")
        # the trees' sorted arrays one after the other; the tree's number leads each key, so one search serves all trees
        self.roots = np.arange(trees, dtype=np.uint64) << np.uint64(bits)
        self.keys = (np.take_along_axis(keys, order, axis=1).astype(np.uint64) | self.roots[:, None]).ravel()
        self.order = order.astype(np.int32).ravel()

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """One row of bit strings per tree, as integers whose leading bits come first."""
        out = np.zeros((self.trees, len(vectors)), np.uint32)
        for b in range(self.bits):
            side = (vectors - self.centre) @ self.planes[b] > 0
            out = out << 1 | side.T.astype(np.uint32)
        return out

    def missed(self, length: float, distance: float, depth: int) -> float:
        """Chance that a vector at ``distance`` from one of ``length`` shares no prefix of ``depth`` bits in any tree:
        the mean over the typical lengths that it may have."""
        other = self.lengths[np.abs(self.lengths - length) <= distance]
        other = np.maximum(other if len(other) else np.array([length]), 1e-12)
        cosine = (length**2 + other**2 - distance**2) / (2 * max(length, 1e-12) * other)
        same = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
        return float(((1 - same**depth) ** self.trees).mean())

    def search(self, query: np.ndarray, strings: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the nearest found, ``skip`` left out; ties by place."""
        known = np.zeros(len(self.vectors), bool)
        if skip >= 0:
            known[skip] = True
        places, distances = np.zeros(0, np.int64), np.zeros(0)
        length = float(np.sqrt(((query - self.centre) ** 2).sum()))
        rooted = self.roots | strings.astype(np.uint64)
        low = high = np.searchsorted(self.keys, rooted)
        met = np.zeros(len(self.vectors), bool)
        for depth in range(self.bits, -1, -1):
            shift = np.uint64(self.bits - depth)
            first = rooted >> shift << shift
            was_low, was_high = low, high
            low = np.searchsorted(self.keys, first)
            high = np.searchsorted(self.keys, first + (np.uint64(1) << shift))
            grown = np.flatnonzero((low < was_low) | (high > was_high))
            if len(grown):
                # what the ascent by one bit adds on either side
                for t in grown:
                    met[self.order[low[t] : was_low[t]]] = True
                    met[self.order[was_high[t] : high[t]]] = True
                fresh = np.flatnonzero(met & ~known)
                known[fresh] = True
                away = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))
                places, distances = np.concatenate([places, fresh]), np.concatenate([distances, away])
                best = np.lexsort((places, distances))[:k]
                places, distances = places[best], distances[best]
            if len(places) == k and self.missed(length, float(distances[-1]), depth) <= 1 - SURE:
                break
        return places, distances


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """``vec_id, v``: rows with an id and a finite vector that is neither null, empty nor zero. Rows that repeat an id
    count once, with the smallest vector; vectors shorter or longer than most are kept and never compared."""
    v = F.col(column).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    column: str = "embedding",
    trees: int = TREES,
    bits: int = BITS,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row for which ``is_query`` holds.

    ``score`` is the Euclidean distance in double precision on the given vectors; ties go to the smaller ``vec_id``. A
    query with fewer than ``k`` other rows gets all of them. Vectors of different lengths are not compared.
    """
    rows = checkpoint(prepare(usable(vectors, column)).withColumn("dim", F.size("v")))
    sizes = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-sizes[0] // shard_rows)), max(1, -(-sizes[1] // block_rows))
    place = F.xxhash64("vec_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select("vec_id", "v", "dim", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block"))
    asked = rows.where(is_query).select("vec_id", "v", "dim", F.pmod(place, F.lit(blocks)).cast("int").alias("block"), each(shards).alias("shard"))

    def pair(held_part: pd.DataFrame, asked_part: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(held_part) and len(asked_part):
            held_part = held_part.sort_values("vec_id", ignore_index=True)  # places in order of ids settle ties
            ids, own = held_part["vec_id"].to_numpy(), np.stack(held_part["v"])
            draw = np.random.default_rng(SEED)
            planes = draw.normal(size=(bits, own.shape[1], trees))
            forest = Forest(own, planes, trees, bits)
            wanted = np.stack(asked_part["v"])
            strings = forest.strings(wanted)
            at = np.searchsorted(ids, asked_part["vec_id"].to_numpy())
            for i, query in enumerate(asked_part["vec_id"]):
                skip = int(at[i]) if at[i] < len(ids) and ids[at[i]] == query else -1
                places, distances = forest.search(wanted[i], strings[:, i], k, skip)
                out["query_id"] += [query] * len(places)
                out["vec_id"] += ids[places].tolist()
                out["score"] += distances.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ("shard", "block", "dim")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact_nearest(vectors: np.ndarray, ids: np.ndarray, queries: Iterator[int], k: int) -> dict[int, list[tuple[int, float]]]:
    """Brute force over arrays, to measure recall against."""
    out = {}
    for q in queries:
        away = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, away)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(away[i])) for i in order]
    return out
