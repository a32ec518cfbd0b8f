"""Collocations from a weighted de Bruijn graph of words.

Texts fall into pieces and those into words. Nodes are phrases of four words, edges phrases of five, which join the two
nodes that overlap in them; an edge's weight is how often it stands in the texts. Only edges are counted, and at the end of
each piece its last one to four words that no edge starts from. The count of a shorter phrase is what flows through it: the sum
of all edges that start with it, plus the piece ends that do. Edges are dealt to bins by their first two words, after each
task has summed its own. Sorted by their words, edges that start alike lie side by side, so one pass over a bin, with one
open count per length, sums the flow of all lengths.

Unary paths are compacted: where a phrase passes its whole count on to one phrase of one more word, before or behind it,
the path goes on without a branch and only the longer phrase stays. As counts never grow along a path, one step at a time
finds every longer phrase with the same count.

Before that, two passes tell which phrases may count at all. Each task adds up its words and pairs, then its longer phrases
of such pairs, in a table of ``2 ** BITS`` buckets, and the tables are summed. A bucket holds no less than each of its
phrases, so where it stays below the wanted count, neither does any longer phrase that starts so reach it: the edge is cut
there, and the rest of the graph is exact. The table's size is fixed. The larger the corpus for one wanted count, the fewer
cuts, up to none; that costs shuffles and changes no result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.text import prepare
from tickloom.session import checkpoint

WORDS = 5  # of an edge
MIN_COUNT = 100
TOP = 2000
BITS = 23  # of a bucket's number
SLICE = 1 << 13  # buckets that travel in one row
HELD = 8 << 20  # characters that a task sums before it passes edges on

# classes of bytes: 0 in words, 1 between words, 2 between pieces; other separators than these are none
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, 0x09]] = 1
CLASSES[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

EDGES = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("edges", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
FLOWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

# the same by plain counting: every phrase by itself
SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, w, len(w) AS m FROM (
    SELECT lang, [x for x in regexp_split_to_array(piece, '[\\x20\\x09]+') if x != ''] AS w FROM pieces)
  WHERE len(w) > 0),
totals AS (SELECT lang, sum(m)::BIGINT AS n FROM words GROUP BY lang),
spans AS (SELECT lang, w, m, k, unnest(generate_series(1, m - k + 1)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE k <= m),
counts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a
  FROM spans GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
inner_spans AS (
  SELECT lang, string_split(phrase, ' ') AS w, k AS size, a, unnest([2, 3, 4]) AS k FROM counts WHERE k >= 3),
inside AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(generate_series(1, size - k + 1)) AS i FROM inner_spans WHERE k < size) GROUP BY ALL),
kept AS (
  SELECT c.lang, c.phrase, c.k, c.a, t.n FROM counts c JOIN totals t USING (lang) LEFT JOIN inside USING (lang, phrase)
  WHERE c.k >= 2 AND (longer IS NULL OR 100 * longer < 100 * c.a)),
cuts AS (
  SELECT lang, phrase, a, n, string_split(phrase, ' ') AS w, k, unnest(generate_series(1, k - 1)) AS cut FROM kept),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.n, c.cut, x.a AS l, y.a AS r,
         (1000::HUGEINT * c.a * c.n // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
weakest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= {TOP}
"""


class Places:
    """The words of some texts: their numbers, whether the next one is in the same piece, and hashes of phrases.

    All separators are ASCII, so words are cut from the bytes. ``words`` holds each different word once.
    """

    def __init__(self, langs: pa.StringArray, texts: pa.StringArray):
        langs = langs.dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = CLASSES[data]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        some = offsets[1:] > offsets[:-1]
        first[offsets[:-1][some]] |= inside[offsets[:-1][some]]
        last[offsets[1:][some] - 1] |= inside[offsets[1:][some] - 1]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        doc = np.searchsorted(offsets, first, "right") - 1
        piece = np.cumsum(kind == 2)[first]
        ends = np.r_[0, np.cumsum(last - first + 1)].astype(np.int64)
        kept = LOWER[data[inside]].tobytes()
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.tobytes()), pa.py_buffer(kept)).dictionary_encode()
        self.words = words.dictionary.to_pylist()
        self.ids = words.indices.to_numpy().astype(np.int64)
        self.lang = langs.indices.to_numpy().astype(np.int64)[doc]
        self.joined = np.r_[(doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]), False][: len(first)]
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([digest(w) for w in self.words], np.uint64)[self.ids] if len(first) else np.empty(0, np.uint64)
        seeds = np.array([digest(name, 1) for name in self.langs], np.uint64)
        self.seeds = seeds[self.lang] if len(first) else self.hashes

    def starts(self, bits: int, may: list[np.ndarray | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ... words: places from which so many words of one piece go on, and the buckets of these phrases.

        ``may[k]`` tells the buckets that may count, for phrases of ``k + 1`` words; places go on only where they do.
        """
        at, state = np.arange(len(self.ids)), self.seeds
        pair = np.ones(len(self.ids), bool)
        for k, allowed in enumerate(may):
            if k:
                # all pairs inside have to count, too
                goes = self.joined[at + k - 1] & pair[at + k - 1]
                at, state = at[goes], state[goes]
            state = _mixed(state, self.hashes[at + k])
            bucket = (state >> np.uint64(64 - bits)).astype(np.int64)
            yield at, bucket
            if allowed is not None:
                good = allowed[bucket]
                at, state = at[good], state[good]
                if k == 1:
                    pair = np.zeros(len(self.ids), bool)
                    pair[at] = True


def _mixed(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = state * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Places]:
    """The places of batches, taken together up to ``HELD`` characters."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chain(batches, [None]):
        if held and (batch is None or size + batch.nbytes > HELD):
            yield Places(*(pa.concat_arrays([b.column(k).cast(pa.string()) for b in held]) for k in (0, 1)))
            held, size = [], 0
        if batch is not None and batch.num_rows:
            held.append(batch)
            size += batch.nbytes


def _unpacked(table: bytes | None, bits: int) -> np.ndarray | None:
    return None if table is None else np.unpackbits(np.frombuffer(table, np.uint8))[: 1 << bits].astype(bool)


def _texts(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    return prepare(docs).select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))


def possible(
    docs: DataFrame, lang: Column, text: Column, min_count: int = MIN_COUNT, bits: int = BITS, pairs: bytes | None = None
) -> bytes:
    """One bit per bucket: whether its words and pairs stand at least ``min_count`` times in all. With the table of
    ``pairs``, the same for the phrases of three to five words that hold no other pairs.

    Tables hold counts up to ``min_count``, in as few bytes as that takes, and are summed slice by slice as they come in.
    """
    kind = np.min_scalar_type(min_count)
    size = min(SLICE, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, given = np.zeros(1 << bits, np.int32), _unpacked(pairs, bits)
        may = [None, None] if given is None else [given, given, None, None, None]
        for places in _gathered(batches):
            for k, (_, bucket) in enumerate(places.starts(bits, may)):
                if (given is None or k >= 2) and len(bucket):
                    met, n = np.unique(bucket, return_counts=True)
                    counts[met] = np.minimum(counts[met] + n, min_count)
        rows = counts.astype(kind).reshape(-1, size)
        full = np.flatnonzero(rows.any(axis=1))
        for part in np.array_split(full, max(1, len(full) // 128)):
            if len(part):
                parts = pa.array([rows[k].tobytes() for k in part], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), parts], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = sums.setdefault(k, np.zeros(size, np.int64))
                np.minimum(total + np.frombuffer(part, kind), min_count, out=total)
        if sums:
            packed = pa.array([np.packbits(s >= min_count).tobytes() for s in sums.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), packed], names=["slice", "counts"])

    schema = "slice int, counts binary"
    tables = _texts(docs, lang, text).mapInArrow(count, schema).repartition("slice")
    full = np.zeros((1 << bits, 1), bool).reshape(-1, size)
    for row in tables.mapInArrow(add, schema).collect():
        full[row["slice"]] = np.unpackbits(np.frombuffer(row["counts"], np.uint8))[:size].astype(bool)
    return np.packbits(full).tobytes()


def graph_edges(docs: DataFrame, lang: Column, text: Column, pairs: bytes, longer: bytes, bits: int = BITS) -> DataFrame:
    """``lang, bin, edges, counts``: edges and piece ends with what tasks have counted of them, by bins of their first two
    words; every word is followed by a space.

    Edges are also cut where the tables of :func:`possible` rule a phrase out. The edge without words counts all words of
    the language. An edge may stand in several rows of its bin, one for each time a task passed it on. There are four bins
    to a shuffle partition, so with partitions that fit a task a bin does. Null languages are ``und``; null texts are empty.
    """
    bins = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _unpacked(pairs, bits), _unpacked(longer, bits)
        may = [tables[0]] * 2 + [tables[1]] * (WORDS - 2)
        for places in _gathered(batches):
            # how many words go on from each place
            reach = np.zeros(len(places.ids), np.int64)
            for k, (at, bucket) in enumerate(places.starts(bits, may)):
                reach[at[may[k][bucket]]] = k + 1
            langs, words = places.langs, places.words
            totals = np.bincount(places.lang, minlength=len(langs)).tolist()
            dealt: dict[tuple[str, int], tuple[list, list]] = {(name, 0): ([""], [n]) for name, n in zip(langs, totals, strict=True)}
            for k in range(1, WORDS + 1):
                at = np.flatnonzero(reach == k)
                columns = [places.lang[at], *(places.ids[at + j] for j in range(k))]
                # name what starts alike, one word after the other
                name = columns[0]
                for column in columns[1:]:
                    _, first, name, counts = np.unique(name << 32 | column, return_index=True, return_inverse=True, return_counts=True)
                for (of, *row), n in zip(np.stack(columns)[:, first].T.tolist(), counts.tolist(), strict=True):
                    edge = [words[w] for w in row]
                    key = langs[of], zlib.crc32(" ".join(edge[:2]).encode()) % bins
                    edges, numbers = dealt.setdefault(key, ([], []))
                    edges.append(" ".join(edge) + " ")
                    numbers.append(n)
            columns = ([k[0] for k in dealt], [k[1] for k in dealt], [v[0] for v in dealt.values()], [v[1] for v in dealt.values()])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EDGES, strict=True)], schema=EDGES)

    return _texts(docs, lang, text).mapInArrow(run, "lang string, bin int, edges array<string>, counts array<long>")


def phrase_counts(edges: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, phrase, words, n`` of all phrases of one to five words that stand at least ``min_count`` times; the phrase
    without words is how many words the language has in all."""
    dealt = edges.repartition("lang", "bin").sortWithinPartitions("lang", "bin")

    def flows(lang: str, counts: Counter) -> Iterator[tuple[str, str, int, int]]:
        """What flows through the starts of edges: those that start alike lie side by side."""
        path: list[str] = []  # words on the way to the last edge
        flow: list[int] = []  # what has flowed through each of them so far
        for edge in chain(sorted(counts), [""]):
            steps = edge.split(" ")[:-1]
            same = 0
            for a, b in zip(path, steps, strict=False):
                if a != b:
                    break
                same += 1
            while len(path) > same:
                n = flow.pop()
                # what flows through a first word is spread over bins: its parts are summed afterwards
                if n >= min_count or len(path) == 1:
                    yield lang, " ".join(path), len(path), n
                path.pop()
                if path:
                    flow[-1] += n
            for step in steps[same:]:
                path.append(step)
                flow.append(0)
            if steps:
                flow[-1] += counts[edge]
        if "" in counts:
            yield lang, "", 0, counts[""]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True) for b in batches)
        for (lang, _), parts in groupby(rows, key=lambda r: r[:2]):
            counts: Counter = Counter()
            for _, _, edges, numbers in parts:
                for edge, n in zip(edges, numbers, strict=True):
                    counts[edge] += n
            made = zip(*flows(lang, counts), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, FLOWS, strict=True)], schema=FLOWS)

    made = dealt.mapInArrow(run, "lang string, phrase string, words int, n long")
    counts = made.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= min_count) | (F.col("words") == 0))


def collocations(docs: DataFrame, lang: Column, text: Column, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` collocations per language.

    A candidate of two to five words that stands ``a`` times is scored by its weakest cut: ``floor(1000 * a * n / (l * r))``
    with the counts ``l`` and ``r`` of both parts and ``n`` words in all, ties to the first cut; products are exact up to 38
    digits. Candidates that a unary path leads on from are left out. Ranks go by score and ``a`` descending, then by the
    phrase's bytes. Empty tables and texts without words give no rows; repeated rows count again; other columns are not read.
    """
    pairs = possible(docs, lang, text, min_count)
    edges = graph_edges(docs, lang, text, pairs, possible(docs, lang, text, min_count, pairs=pairs))
    # read several times, and far smaller than the texts
    return scored_phrases(checkpoint(phrase_counts(edges, min_count)), top)


def scored_phrases(counts: DataFrame, top: int = TOP) -> DataFrame:
    """:func:`collocations` from the counts of all phrases that count."""
    totals = counts.where("words = 0").select("lang", "n")
    candidates = counts.where("words >= 2").withColumnRenamed("n", "a").join(totals, "lang")
    parts = counts.where("words >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("of_part"))
    longer = counts.where("words >= 3")
    behind = F.expr("substring_index(phrase, ' ', -(words - 1))")
    before = F.expr("substring_index(phrase, ' ', words - 1)")
    onward = longer.select("lang", F.explode(F.array(before, behind)).alias("phrase"), F.col("n").alias("onward"))
    onward = onward.groupBy("lang", "phrase").agg(F.max("onward").alias("onward"))
    branching = candidates.join(onward, ["lang", "phrase"], "left").where("onward IS NULL OR onward < a").drop("onward")
    cuts = branching.select("*", F.explode(F.expr("sequence(1, words - 1)")).alias("cut"))
    cuts = cuts.select(
        "*",
        F.expr("substring_index(phrase, ' ', cut)").alias("first"),
        F.expr("substring_index(phrase, ' ', cut - words)").alias("rest"),
    )
    cuts = cuts.join(parts.withColumnsRenamed({"part": "first", "of_part": "l"}), ["lang", "first"])
    cuts = cuts.join(parts.withColumnsRenamed({"part": "rest", "of_part": "r"}), ["lang", "rest"])
    wide = {name: F.col(name).cast("decimal(19,0)").alias(name) for name in ("a", "n", "l", "r")}
    cuts = cuts.select("lang", "phrase", "cut", *wide.values())
    cuts = cuts.withColumn("score", F.expr("(a * n * 1000) div (l * r)"))
    weakest = F.min_by(F.struct("cut", "l", "r", "score"), F.struct("score", "cut"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(weakest.alias("w"))
    order = Window.partitionBy("lang").orderBy(F.col("w.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    numbers = {"a": "a", "l": "w.l", "r": "w.r", "n": "n", "score": "w.score"}
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", *[F.col(c).cast("long").alias(k) for k, c in numbers.items()])
