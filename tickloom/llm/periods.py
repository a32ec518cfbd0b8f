"""Periodic runs of words: the branching-tandem test over an enhanced suffix array.

A run is a stretch of consecutive words with smallest period ``p`` and at least two periods long that no neighbouring
word extends. Suffixes are ranked by doubling; the names of all stretches of 1, 2, 4, ... words are kept, so the longest
common extension of two places, forwards or backwards, takes one comparison a level. Neighbouring suffixes give the LCP
array, and its intervals stand for the inner nodes of a suffix tree without any node being built. In an interval of depth
``d`` every suffix ``i`` of all children but the largest looks up whether ``i + d`` or ``i - d`` is in the interval too, in
another child: then a square of root length ``d`` ends where its run ends. Such squares rotate left to the start of the
run, and those of one stretch merge under the shortest root. The work is O(n log n) in the number of words.

All arrays are numpy; documents share them, since words of two documents never have the same number.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import map_text

WORD = re.compile("[^\x20\x09-\x0d]+")
MIN_LENGTH = 12
GROUP_WORDS = 200_000  # words whose documents are worked on together; a longer document is a group of its own
ROUNDS = 64  # of pointer jumps over whole arrays before the rest is walked one by one
CHUNK = 4_000_000  # suffixes looked up at once

FIELDS = {
    "n_words": "long",
    "starts": "array<long>",
    "lengths": "array<long>",
    "periods": "array<long>",
    "collapsed": "string",
}


def _suffix_ranks(names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rank of every suffix and the names of all stretches of 2^k words; a name is the place of its first suffix.

    Every array has one more element, -1, for the place behind the end. Only suffixes that still share a name are sorted.
    """
    n = len(names)
    counts = np.bincount(names)
    rank = np.full(n + 1, -1, np.int64)
    rank[:n] = (np.cumsum(counts) - counts)[names]
    open_ = np.flatnonzero(counts[names] > 1)
    levels = [rank.astype(np.int32)]
    step = 1
    while len(open_):
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + step, n)] + 1
        order = np.argsort(key, kind="stable")
        key, open_ = key[order], open_[order]
        head = key // (n + 1)
        at = np.arange(len(key))
        new_group = np.r_[True, head[1:] != head[:-1]]
        new_name = np.r_[True, key[1:] != key[:-1]]
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        name_at = np.maximum.accumulate(np.where(new_name, at, 0))
        rank[open_] = head + name_at - group_at
        alone = new_name & np.r_[new_name[1:], True]
        open_ = open_[~alone]
        levels.append(rank.astype(np.int32))
        step *= 2
    return rank, levels


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal words from places ``i`` and ``j`` on."""
    i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = np.where(levels[k][i] == levels[k][j], 1 << k, 0)
        i += step
        j += step
        length += step
    return length


def _common_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal words before places ``i < j``."""
    i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = i >= 1 << k
        a, b = np.where(fits, i - (1 << k), 0), np.where(fits, j - (1 << k), 1)
        step = np.where(fits & (levels[k][a] == levels[k][b]), 1 << k, 0)
        i -= step
        j -= step
        length += step
    return length


def _nearest_not_above(lcp: np.ndarray, where: np.ndarray, side: int) -> np.ndarray:
    """Nearest place before (``side`` -1) or behind (1) each of ``where`` whose value is not above its own."""
    to = np.arange(len(lcp)) + side
    active = where
    for _ in range(ROUNDS):
        active = active[lcp[to[active]] > lcp[active]]
        if not len(active):
            return to
        to[active] = to[to[active]]
    # long slopes: every place is stepped over once
    for r in active.tolist() if side < 0 else active[::-1].tolist():
        q = to[r]
        while lcp[q] > lcp[r]:
            q = to[q]
        to[r] = q
    return to


def _squares(rank: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and root lengths of all branching squares: the word behind them breaks their period."""
    n = len(rank) - 1
    isa = rank[:n]
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    lcp[0] = lcp[n] = -1
    first = levels[0][sa]
    bounds = 1 + np.flatnonzero(first[1:] == first[:-1])  # between two suffixes with the same first word
    none = np.empty(0, np.int64)
    if not len(bounds):
        return none, none
    lcp[bounds] = _common(levels, sa[bounds - 1], sa[bounds])
    before = _nearest_not_above(lcp, bounds, -1)
    behind = _nearest_not_above(lcp, bounds, 1)
    # boundaries of one interval stand side by side when sorted by depth, then place
    bounds = bounds[np.argsort(lcp[bounds], kind="stable")]
    depth, left, right = lcp[bounds], before[bounds], behind[bounds]
    opens = lcp[left] < depth
    heads = np.flatnonzero(opens)
    group = np.cumsum(opens) - 1
    lasts = np.r_[heads[1:], len(bounds)] - 1
    low, high = left[heads], right[lasts]
    # children: one to the right of every boundary, and one to the left of an interval's first boundary
    size, first_size = right - bounds, bounds[heads] - left[heads]
    most = np.maximum(np.maximum.reduceat(size, heads), first_size)
    skip_first = first_size == most
    largest = (size == most[group]) & ~skip_first[group]
    seen = np.cumsum(largest)
    skip = largest & (seen - (seen - largest)[heads][group] == 1)
    at = np.r_[low[~skip_first], bounds[~skip]]
    count = np.r_[first_size[~skip_first], size[~skip]]
    node = np.r_[np.flatnonzero(~skip_first), group[~skip]]
    node_depth = depth[heads]
    places, roots = [none], [none]
    ends = np.cumsum(count)
    cut = 0
    while cut < len(at):
        to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + CHUNK, "right")))
        c, v = count[cut:to], node[cut:to]
        child = np.repeat(np.arange(cut, to), c)
        q = np.repeat(at[cut:to] - (np.cumsum(c) - c), c) + np.arange(len(child))
        v = np.repeat(v, c)
        i, d = sa[q], node_depth[v]
        for sign in (1, -1):
            j = i + sign * d
            inside = np.flatnonzero((j >= 0) & (j < n))
            r, w, own = isa[j[inside]], v[inside], child[inside]
            hit = (r >= low[w]) & (r < high[w]) & ((r < at[own]) | (r >= at[own] + count[own]))
            inside = inside[hit]
            places.append(np.minimum(i[inside], j[inside]))
            roots.append(d[inside])
        cut = to
    return np.concatenate(places), np.concatenate(roots)


def runs_of(names: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all runs of a sequence of numbers below some bound, by start, then period."""
    names = np.asarray(names, np.int64)
    if len(names) < 2:
        return (np.empty(0, np.int64),) * 3
    rank, levels = _suffix_ranks(names)
    place, root = _squares(rank, levels)
    start = place - _common_before(levels, place, place + root)
    end = place + 2 * root
    long = end - start >= min_length
    start, end, root = start[long], end[long], root[long]
    order = np.lexsort((root, end, start))
    start, end, root = start[order], end[order], root[order]
    # one stretch, several roots: the shortest is its period, the others are multiples
    fresh = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, root = start[fresh], end[fresh], root[fresh]
    order = np.lexsort((root, start))
    return start[order], end[order], root[order]


def _work(texts: list[str], min_length: int) -> list[list]:
    made: list[list] = [[] for _ in FIELDS]
    group: list[list[str]] = []
    names: list[int] = []

    def flush():
        start, end, period = runs_of(np.array(names, np.int64), min_length)
        offsets = np.cumsum([0, *map(len, group)])
        cuts = np.searchsorted(start, offsets)
        for k, words in enumerate(group):
            of = slice(cuts[k], cuts[k + 1])
            starts, ends, periods = start[of] - offsets[k], end[of] - offsets[k], period[of]
            kept = words
            if len(starts):
                keep = np.ones(len(words), bool)
                for a, b in zip((starts + periods).tolist(), ends.tolist(), strict=True):
                    keep[a:b] = False
                kept = [words[i] for i in np.flatnonzero(keep)]
            for to, value in zip(made, (len(words), starts, ends - starts, periods, " ".join(kept)), strict=True):
                to.append(value)
        group.clear()
        names.clear()

    base = 0
    for text in texts:
        words = WORD.findall(text)
        if group and len(names) + len(words) > GROUP_WORDS:
            flush()
            base = 0
        own: dict[str, int] = {}
        names.extend([own.setdefault(w, base + len(own)) for w in words])
        base += len(own)
        group.append(words)
    flush()
    return made


def find_runs(docs: DataFrame, keep: list[Column], text: Column, min_length: int = MIN_LENGTH) -> DataFrame:
    """``keep`` and, per row, ``n_words``, the runs of at least ``min_length`` words in parallel arrays ``starts`` (word
    number), ``lengths`` and ``periods`` by start, then period, and ``collapsed``: the words that no run repeats, joined by
    one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null, empty or blank text has no words, empty arrays and an empty ``collapsed``.
    Rows are worked on one by one where they lie: repeated rows give repeated results, null ids stay, nothing is shuffled,
    and memory is that of one document's words. Only ``keep`` is carried, so other columns cannot clash.
    """

    def start():
        return lambda texts: _work(texts, min_length)

    return map_text(docs, keep, text, FIELDS, start)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail where crc32 of the id's digits is divisible by 10, words joined by one space; other
    texts as they are. A null id counts as empty text, a null text as an empty one."""
    text = F.coalesce(text, F.lit(""))
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    # bound once: the words are split once a row
    bound = F.transform(F.array(words), lambda ws: F.array_join(tail(ws), " "))
    return F.when(h % 10 == 0, F.get(bound, F.lit(0))).otherwise(text)


def digests(runs: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text, per document."""
    each = F.arrays_zip("starts", "lengths", "periods")
    best = F.array_max(F.transform(each, lambda r: F.struct(r["lengths"], -r["starts"], -r["periods"])))
    lines = F.transform(each, lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n")))
    length, period = best["lengths"], -best["col3"]
    return runs.select(
        "doc_id",
        F.size("starts").cast("long").alias("n_runs"),
        (-best["col2"]).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
