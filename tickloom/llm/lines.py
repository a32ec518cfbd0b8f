"""Line dedup with a log-template tree of fixed depth.

A line descends by its number of tokens, then by its leading tokens or the branch that leaves them open, to a leaf, where
lines are alike that have at least half of their tokens at equal positions. Tokens with digits are fields everywhere. In a
leaf, what is not equal has to lie in one third of the rest or in any two of ``BANDS`` stretches of the line: the templates
of a line are the line itself and the line with these stretches, or the leading tokens, generalised. Where what is left
out lies side by side, the rest is counted from the end of the line, and the line descends both under its own number of
tokens and under one less: so a token more or less does not part two lines. Templates are names of paths through the tree,
counted over all documents at once: no state depends on the order of lines, and a hot template is a key whose counts are
summed before the shuffle.

A template recurs when the tokens it repeats, constant tokens times documents, reach ``MIN_REPEATED`` in at least two
documents. Lines of recurring templates are dropped from every document but the first (smallest id) that has them, so
whole copies keep one copy.

Texts are read twice. The first pass counts templates. The second one places them, and passes on what meets a table of
``2 ** BITS`` bits that marks the recurring ones; the join with these decides. The table's size is fixed: the more templates
recur, the less it holds back, which costs shuffles and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import prepare
from tickloom.session import checkpoint

DEPTH = 2  # leading tokens
BANDS = 4
MIN_REPEATED = 24
MIN_CONSTANT = 3  # of a template with something generalised
MIN_GENERAL = 5  # tokens from which one stretch is generalised
MIN_PAIRS = 8  # tokens from which two stretches are generalised
BITS = 26  # of a place in the table of recurring templates
HELD = 1 << 20  # bytes, and then tokens, that are worked on together

# bytes between tokens, all that str.split knows in ASCII
BETWEEN = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
GAP = re.compile(rb"[\x09-\x0D\x1C-\x20]")
ODD = re.compile(r"[^\S\x00-\x7f]|[^\D\x00-\x7f]")  # other spaces and digits
FIELD = 1  # in place of a token's hash
STEP = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
BACK = pow(STEP, -1, 1 << 64)
APART = {(i, j): [k for k in range(BANDS) if k not in (i, j)] for i in range(BANDS) for j in range(i + 2, BANDS)}

COUNTED = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("constant", pa.int32()), ("first", pa.int64())])
PLACED = pa.schema([("doc_id", pa.int64()), ("k_text", pa.int64()), ("key", pa.int64()), ("line", pa.int32())])


def _powers(x: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)])


def _named(*parts) -> np.ndarray:
    """One number per row from columns of numbers, by their order."""
    state = np.zeros(1, np.uint64)
    for part in parts:
        state = state * np.uint64(STEP) + np.asarray(part).astype(np.uint64)
        state = (state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(32)
    return state


def templates(tokens: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``keys, constant tokens, lines`` of the templates of lines, given the hashes of their tokens one after the other.

    Where every template with two stretches left out has tokens enough to recur in two documents, the others could only
    find what these find too and are left out.
    """
    starts = np.cumsum(sizes) - sizes
    places = np.arange(len(tokens)) - np.repeat(starts, sizes)
    power, back = (_powers(x, int(sizes.max(initial=0)) + 1) for x in (STEP, BACK))
    sums = np.r_[np.uint64(0), np.cumsum(tokens * power[places])]
    known = np.r_[0, np.cumsum(tokens != np.uint64(FIELD))]

    def part(s, a, b):
        """Name of the tokens from ``a`` to ``b`` of the lines that start at ``s``, and how many are constant."""
        return (sums[s + b] - sums[s + a]) * back[a], known[s + b] - known[s + a]

    def left_out(s, n, m, a, b):
        (head, before), (tail, behind) = part(s, 0, a), part(s, n - m + b, n)
        return _named(1, m, a, b, head, tail), before + behind

    line = np.flatnonzero(sizes >= MIN_PAIRS)
    s, n = starts[line], sizes[line]
    two = []
    for m in (n, n - 1):
        cuts = [m * i // BANDS for i in range(BANDS + 1)]
        two += [left_out(s, n, m, a, b) for a, b in zip(cuts, cuts[2:], strict=False)]
        if m is n:
            bands = [part(s, a, b) for a, b in pairwise(cuts)]
            for (i, j), (k, l) in APART.items():
                two.append((_named(2, i, j, m, bands[k][0], bands[l][0]), bands[k][1] + bands[l][1]))
    enough = np.minimum.reduce([c for _, c in two]) * 2 >= MIN_REPEATED
    for key, constant in two:
        kept = constant >= MIN_CONSTANT
        yield key[kept], constant[kept], line[kept]

    others = np.ones(len(sizes), bool)
    others[line[enough]] = False
    line = np.flatnonzero(others)
    key, constant = part(starts[line], 0, sizes[line])
    kept = constant >= 1
    yield _named(0, sizes[line], key)[kept], constant[kept], line[kept]
    line = line[sizes[line] >= MIN_GENERAL]
    s, n = starts[line], sizes[line]
    for m in (n, n - 1):
        cuts = [np.zeros_like(m), *(DEPTH + (m - DEPTH) * i // 3 for i in range(4))]
        for a, b in pairwise(cuts):
            key, constant = left_out(s, n, m, a, b)
            kept = constant >= MIN_CONSTANT
            yield key[kept], constant[kept], line[kept]


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some UTF-8 lines, and how many tokens each line has. All gaps and digits are ASCII."""
    weights = _named(3, np.arange(256))
    power = back = _powers(STEP, 0)
    hashes, lines, line, low = [], [], 0, 0
    while low < len(data):
        gap = GAP.search(data, low + HELD)
        high = gap.start() if gap else len(data)
        part = np.frombuffer(data, np.uint8, high - low, low)
        if len(power) <= len(part):
            power, back = (_powers(x, len(part)) for x in (STEP, BACK))
        inside = np.r_[False, ~BETWEEN[part], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        sums = np.r_[np.uint64(0), np.cumsum(weights[part] * power[: len(part)])]
        made = _named((sums[last] - sums[first]) * back[first])
        digits = np.r_[0, np.cumsum(DIGIT[part], dtype=np.int32)]
        made[digits[last] > digits[first]] = FIELD
        breaks = np.flatnonzero(part == 0x0A)
        hashes.append(made)
        lines.append(line + np.searchsorted(breaks, first))
        line, low = line + len(breaks), high
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.bincount(np.concatenate(lines), minlength=line + 1)


def _found(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``keys, constants, rows, lines`` of all templates of some texts."""
    plain = [t if t.isascii() else ODD.sub(lambda m: " " if m[0].isspace() else "0", t) for t in (t or "" for t in texts)]
    counts = np.array([t.count("\n") + 1 for t in plain], np.int64)
    rows = np.repeat(np.arange(len(plain), dtype=np.int32), counts)
    numbers = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    hashes, sizes = _tokens("\n".join(plain).encode("utf-8", "surrogatepass"))
    ends = np.r_[0, np.cumsum(sizes)]
    made: list[tuple] = []
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + HELD, "right")) - 1)
        found = templates(hashes[ends[low] : ends[high]], sizes[low:high])
        made += [(key, constant, rows[low + at], numbers[low + at]) for key, constant, at in found]
        low = high
    return tuple(np.concatenate(column) for column in zip(*made, strict=True))


def _pieces(schema: pa.Schema, *columns: np.ndarray | pa.Array) -> Iterator[pa.RecordBatch]:
    """Columns as batches of a bounded number of rows."""
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    yield from (whole.slice(k, 1 << 16) for k in range(0, whole.num_rows, 1 << 16))


def recurring_templates(docs: DataFrame) -> DataFrame:
    """``key, first``: templates that recur, with the smallest id that has them. A row is a document; a template counts
    once in it however often it stands there. Written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, constant, row, _ = _found(batch.column(1).to_pylist())
            if len(key):
                order = np.lexsort((row, key))
                key, constant, row = key[order], constant[order], row[order]
                new = np.r_[True, key[1:] != key[:-1]]
                once = new | np.r_[True, row[1:] != row[:-1]]
                key, constant, row, at = key[once], constant[once], row[once], np.flatnonzero(new[once])
                none = np.iinfo(np.int64).max
                first = np.minimum.reduceat(batch.column(0).fill_null(none).to_numpy()[row], at)
                first = pa.array(first, mask=first == none)
                yield from _pieces(COUNTED, key[at].view(np.int64), np.diff(np.r_[at, len(key)]), constant[at], first)

    made = prepare(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "key long, n long, constant int, first long")
    counted = made.groupBy("key").agg(F.sum("n").alias("n"), F.max("constant").alias("constant"), F.min("first").alias("first"))
    return checkpoint(counted.where((F.col("n") >= 2) & (F.col("n") * F.col("constant") >= MIN_REPEATED)).select("key", "first"))


def _table(recurring: DataFrame) -> bytes:
    """``2 ** BITS`` bits, those set that a recurring template points to with its upper bits."""
    at = F.shiftrightunsigned("key", 64 - BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITS}) & 63 AS int))")
    words = recurring.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.tobytes()


def _recurring_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, k_text, line``: places of lines to drop; a place may come several times."""
    recurring = recurring_templates(docs)
    table = _table(recurring)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(table, np.uint64)
        for batch in batches:
            key, _, row, line = _found(batch.column(2).to_pylist())
            at = key >> np.uint64(64 - BITS)
            met = (marks[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            key, row, line = key[met], row[met], line[met]
            yield from _pieces(PLACED, batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), key.view(np.int64), line)

    texts = prepare(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("k_text"), "text")
    placed = texts.mapInArrow(place, "doc_id long, k_text long, key long, line int")
    hits = placed.join(recurring, "key").where(~F.col("doc_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    return hits.select("doc_id", "k_text", "line")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` with recurring lines dropped from ``text``, and ``n_lines`` and
    ``n_dropped``; ``n_chars`` is set anew where it exists.

    A null text stays null and has no lines; an empty text has one empty line. Rows with a null id never come first, so
    what recurs is dropped from them. Repeated rows are documents; those of the first id all keep their lines. Other
    lines stay as they are, in order.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    null_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)))
    marked = _recurring_lines(docs).select(null_key.alias("k_id"), "k_text", "line").groupBy("k_id", "k_text")
    marked = marked.agg(F.collect_set("line").alias("k_lines"))
    keyed = docs.select(F.struct(*columns).alias("row"), null_key.alias("k_id"), F.xxhash64("text").alias("k_text"))
    # numbers of lines are small beside texts: hash them, so that texts need no sort
    joined = keyed.join(marked.hint("shuffle_hash"), ["k_id", "k_text"], "left")
    text = F.col("row")["text"]
    lines = F.split(text, "\n", -1)
    gone = F.coalesce("k_lines", F.array().cast("array<int>"))
    # numbers of the lines that stay, by set, and then those lines: linear in the lines; both arrays are bound once a row
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    bound = F.array(F.struct(lines.alias("lines"), numbers.alias("kept")))
    picked = F.transform(bound, lambda b: F.array_join(F.transform(b["kept"], lambda i: F.get(b["lines"], i)), "\n"))
    kept = F.get(picked, F.lit(0))
    untouched = F.col("k_lines").isNull()
    new = {"text": F.when(untouched, text).otherwise(kept)}
    if "n_chars" in columns:
        n_chars = F.length(kept).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(untouched, F.col("row")["n_chars"]).otherwise(n_chars)
    return joined.select(
        *[new.get(c, F.col("row")[c]).alias(c) for c in columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines dropped; rows that lose every line with content go, others stay."""
    done = dedup_lines(docs.withColumnsRenamed({c: f"own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}))
    kept = done.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return kept.drop("n_lines", "n_dropped").toDF(*docs.columns)
