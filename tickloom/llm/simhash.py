"""Near duplicates by SimHash: exact comparison of fingerprints in tiles.

Every text gets a fingerprint over its word shingles. Equal fingerprints collapse into one class, so groups of copies,
however large, are one row from then on. Classes are put into tiles by how many bits are set in slices of the
first 64 bits: two fingerprints within the radius differ by at most the radius in the sum of those counts, so every
pair of tiles beyond it is skipped and nothing is missed. Tiles are cut to ``tile_rows`` rows, and each remaining pair
of tiles is compared in full with exclusive-or and bit counts in numpy. A tile pair reports one link per node to the
root of its part, not all pairs within it.

The comparison is exact and therefore quadratic in the number of different fingerprints, divided by what the counts
(and, in :data:`SIMILAR`, the lengths) rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.text import map_text, prepare
from tickloom.session import checkpoint

SEED = 42
CHUNK = 1 << 15  # shingles counted at once
BAND = 1.25  # ratio of shingle counts across one band of lengths


@dataclass(frozen=True)
class Form:
    """How fingerprints are made and compared.

    ``lanes`` 64-bit words, the first one the plain fingerprint; ``radius`` bits may differ in all, ``first`` of them in
    the first word. Tiles go by set bits in ``slices`` slices of the first word, in steps of ``width``; with ``banded``
    also by length, and only texts whose shingle counts lie in the same or in neighbouring bands are compared. With
    ``distinct`` a shingle counts once however often a text repeats it, so texts are compared as sets.
    """

    lanes: int = 1
    radius: int = 2
    first: int = 2
    slices: int = 4
    width: int = 1
    banded: bool = False
    distinct: bool = False


def similar(similarity: float, lanes: int = 4) -> Form:
    """The form that links texts whose shingle sets overlap by ``similarity`` (Jaccard) or more.

    Such texts differ in a share of bits given by the angle between them; the radius lies 1.65 standard deviations above
    that (about 95 % found), the one of the first word 2.3 above. Their numbers of different shingles differ by ``BAND`` at
    most, so the same fingerprint in bands further apart stands for texts that are not alike.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    reach = lambda n, z: round(n * share + z * math.sqrt(n * share * (1 - share)))
    return Form(lanes, reach(64 * lanes, 1.65), reach(64, 2.3), 1, 4, True, True)


SIMILAR = similar(0.8)


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    """The hashes and, beside them, further hashes mixed from them: one column per word of the fingerprint."""
    out = [h]
    for k in range(1, lanes):
        x = h + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ x >> np.uint64(31))
    return np.stack(out, axis=1)


def fingerprint_of(text: str, words: int, lanes: int = 1, distinct: bool = False) -> tuple[list[int], int]:
    """Words of the fingerprint, and the number of (distinct) shingles. A bit is set where over half the hashes set it; all
    are 0 where the text has no word."""
    parts = text.encode().lower().split()  # on bytes: lowers A-Z alone, splits on \x20 and \x09-\x0D alone
    if not parts:
        return [0] * lanes, 0
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64 * lanes, np.int64)

    def hashes(start: int) -> np.ndarray:
        piece = parts[start : min(start + CHUNK, n) + words - 1]
        # fewer words than a shingle has: the whole sequence
        shingles = map(b" ".join, zip(*(piece[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
        return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)

    pieces = map(hashes, range(0, n, CHUNK))
    if distinct:
        different = np.unique(np.concatenate(list(pieces)))
        n = len(different)
        pieces = (different[start : start + CHUNK] for start in range(0, n, CHUNK))
    for h in pieces:
        bits = np.unpackbits(_lanes(h, lanes).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # sums of bytes that cannot overflow
            ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    packed = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)
    return packed.tolist(), n


def fingerprints(docs: DataFrame, keep: list[Column], text: Column, words: int, form: Form) -> DataFrame:
    """``keep``, ``node`` (the fingerprint, or a hash of its words and the band), ``fp`` (its words, signed) and ``band`` of
    every row. A null text is empty."""

    def start():
        def work(texts: list[str]) -> list[list]:
            found = [fingerprint_of(t, words, form.lanes, form.distinct) for t in texts]
            lanes = [np.array(f, np.uint64).view(np.int64) for f, _ in found]
            bands = [int(math.log(n + 1) / math.log(BAND)) if form.banded else 0 for _, n in found]
            # one node per fingerprint and band
            named = lambda f, b: np.uint64(xxhash.xxh64_intdigest(f.tobytes(), b)).view(np.int64).item()
            nodes = [int(f[0]) if form.lanes == 1 and not form.banded else named(f, b) for f, b in zip(lanes, bands, strict=True)]
            return [nodes, lanes, bands]

        return work

    return map_text(docs, keep, text, {"node": "long", "fp": "array<long>", "band": "int"}, start)


def _slice_counts(fp: Column, form: Form) -> list[Column]:
    bits = 64 // form.slices
    part = lambda i: F.shiftrightunsigned(fp, i * bits).bitwiseAND(F.lit((1 << bits) - 1)) if form.slices > 1 else fp
    return [F.floor(F.bit_count(part(i)) / form.width).cast("long") for i in range(form.slices)]


def _offsets(form: Form) -> list[int]:
    """Differences of tile codes that may hold a pair within the radius, each unordered pair of tiles once."""
    least = lambda d: max(0, (abs(d) - 1) * form.width + 1) if d else 0
    far = form.first // form.width + 1
    steps = [()]
    for _ in range(form.slices):
        steps = [(*s, d) for s in steps for d in range(-far, far + 1) if sum(map(least, s)) + least(d) <= form.first]
    bands = (-1, 0, 1) if form.banded else (0,)
    codes = (sum(d << (8 * i) for i, d in enumerate(s)) + (b << 40) for s in steps for b in bands)
    return sorted(c for c in codes if c >= 0)


def _near(x: np.ndarray, y: np.ndarray, form: Form) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows within the radius."""
    rows = max(1, (1 << 20) // max(1, len(y)))
    left, right = [], []
    for s in range(0, len(x), rows):
        i, j = np.nonzero(np.bitwise_count(x[s : s + rows, None, 0] ^ y[None, :, 0]) <= form.first)
        left.append(i + s)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    if form.lanes > 1 and len(i):
        # pairs that pass the first word, in pieces
        keep = np.concatenate(
            [np.bitwise_count(x[i[s : s + (1 << 18)]] ^ y[j[s : s + (1 << 18)]]).sum(axis=1, dtype=np.int64) <= form.radius for s in range(0, len(i), 1 << 18)]
        )
        i, j = i[keep], j[keep]
    return i, j


def _links(x: np.ndarray, y: np.ndarray, x_nodes: np.ndarray, y_nodes: np.ndarray, form: Form, same: bool):
    """Pairs (node, root) that connect whatever lies within the radius between two tiles."""
    a, b = _near(x, y, form)
    if same:
        a, b = a[a < b], b[a < b]
    nodes = x_nodes if same else np.concatenate([x_nodes, y_nodes])
    if not len(a):
        return nodes[:0], nodes[:0]
    if not same:
        b = b + len(x)
    root = np.arange(len(nodes))
    while True:  # the smaller root spreads along the links until none changes
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def near_links(classes: DataFrame, form: Form, tile_rows: int = 1024) -> DataFrame:
    """Links ``a, b`` between nodes of ``classes(node, fp, band)`` that connect all pairs within the radius."""
    counts = _slice_counts(F.col("fp")[0], form)
    code = sum((c * (1 << (8 * i)) for i, c in enumerate(counts)), F.col("band").cast("long") * (1 << 40))
    placed = classes.select("node", "fp", code.alias("tile"))
    # one row per tile; tiles with more rows than fit are cut by a hash
    sizes = placed.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    tiles = (
        placed.join(sizes, "tile")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .groupBy("tile", "part")
        .agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("rows"))
        .select("tile", "part", F.col("rows.node").alias("ids"), F.flatten("rows.fp").alias("fps"))
    )
    tiles = checkpoint(tiles)
    steps = F.array(*[F.lit(c).cast("long") for c in _offsets(form)])
    left = tiles.select("tile", "part", F.col("ids").alias("xi"), F.col("fps").alias("xs"), F.explode(steps).alias("step"))
    left = left.select("tile", "part", "xi", "xs", (F.col("tile") + F.col("step")).alias("other"))
    right = tiles.select(F.col("tile").alias("other"), F.col("part").alias("other_part"), F.col("ids").alias("yi"), F.col("fps").alias("ys"))
    pairs = left.join(right, "other").where("other != tile OR other_part >= part")
    same = (F.col("other") == F.col("tile")) & (F.col("other_part") == F.col("part"))
    pairs = prepare(pairs).select("xs", "ys", "xi", "yi", same.alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            same = batch.column(4).to_pylist()
            data = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns[:4]]
            for i in range(batch.num_rows):
                xs, ys, xi, yi = (v[o[i] : o[i + 1]] for v, o in data)
                x, y = (v.view(np.uint64).reshape(-1, form.lanes) for v in (xs, ys))
                out.append(_links(x, y, xi, yi, form, same[i]))
            if out:
                a, b = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def classes_of(prints: DataFrame, form: Form) -> DataFrame:
    """``prints(doc_id, node, fp, band)`` -> ``node, component_id``: a row per node with its component's smallest id."""
    classes = checkpoint(
        prints.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("fp").alias("fp"), F.min("band").alias("band"))
    )
    joined = components(near_links(classes, form)).withColumnRenamed("node", "linked")
    rooted = classes.join(joined, classes["node"] == joined["linked"], "left").select(
        "node", "low", F.coalesce("root", "node").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("node", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, form: Form = SIMILAR) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    ``fingerprint`` is the first word in hexadecimal; ``component_id`` the smallest ``doc_id`` reachable over links. A
    null or empty text has fingerprint 0 and is linked like any other; repeated rows come back as often as they are
    given; a null id never names a component unless the component has no other; an empty table gives no rows.
    """
    prints = checkpoint(fingerprints(docs, [F.col("doc_id")], F.col("text"), words, form))
    found = classes_of(prints, form)
    hexed = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return prints.join(found, "node").select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, form: Form = SIMILAR) -> DataFrame:
    """``docs`` with one document of each component: its smallest id (nulls last), then its smallest text hash.

    Winners are chosen on ids and hashes alone; whole rows move once, for the join with them. Rows that repeat an
    id and a text are one document.
    """
    # never null, from id and text alone
    key = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), F.xxhash64("text").alias("k_text")]
    prints = checkpoint(fingerprints(docs, key, F.col("text"), words, form))
    found = classes_of(prints.select(F.when(~F.col("k_null"), F.col("k_id")).alias("doc_id"), "node", "fp", "band"), form)
    winners = (
        prints.join(found, "node")
        .groupBy("root")
        .agg(F.min(F.struct("k_null", "k_id", "k_text")).alias("w"))
        .select("w.k_null", "w.k_id", "w.k_text")
    )
    whole = docs.select(F.struct(*docs.columns).alias("row"), *key)
    kept = whole.join(winners, ["k_null", "k_id", "k_text"], "left_semi")
    return kept.groupBy("k_null", "k_id", "k_text").agg(F.min("row").alias("row")).select("row.*")
