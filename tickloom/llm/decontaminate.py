"""Benchmark decontamination by pigeonhole edit matching.

An item may be found with up to k edits. It is cut into k + 1 pieces, so at least one of them stands unchanged in
whatever matches. All pieces are looked up in one pass over a text; every place they point to is verified with Myers'
bit-parallel edit distance against the whole item. Nothing is sampled, and no text or item is cut short.

Items go to the tasks in blocks of bounded size, however large the benchmark: with more items there are more blocks, and
the driver holds one at a time. Items too short for an edit have to stand there as they are, and as whole words where
they begin or end with letters that have a case, or digits. They are reported, but a document is dropped only for items of
at least ``LEAST`` characters: `the capital` is no evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.text import map_text
from tickloom.session import checkpoint

PIECE = 20  # characters per allowed edit
LEAST = 20  # normal characters below which an item does not drop a document
BLOCK_CHARS = 1_000_000  # characters of items in one block

PLAIN = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    """Lower-case words of letters and digits with single spaces: what the comparison runs on."""
    return " ".join(PLAIN.findall(text.lower()))


def budget(item: str) -> int:
    """Allowed edits: one per :data:`PIECE` characters."""
    return len(item) // PIECE


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks_of(item: str) -> dict[str, int]:
    """For each character the bits of the places where it stands."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of ``text``, and the end of the first such stretch."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1
        up = (mh | ~(xv | ph)) & full
        down = ph & xv & full
        if score < best:
            best, end = score, at
    return best, end


def _whole(text: str, start: int, end: int) -> bool:
    """Whether no word goes on beyond an end of a stretch. Scripts without case and spaces have no such words."""
    cased = lambda a, b: a.islower() and b.islower() or a.isdigit() and b.isdigit()
    return not (start and cased(text[start - 1], text[start])) and not (end < len(text) and cased(text[end - 1], text[end]))


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(item_id, text, budget(text), masks_of(text)) for item_id, text in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k, _) in enumerate(self.items):
            for place, piece in pieces(text, k):
                found.setdefault(piece, []).append((n, place))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """``(item_id, distance, end)`` of each item that stands in the text within its budget; ``end`` counts in the
        normal form of the text, for the closest place, the first of equals."""
        if not self.items:
            return []
        text = normal(text)
        places: dict[int, list[int]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for n, place in owners:
                places.setdefault(n, []).append(end - size + 1 - place)
        found = []
        for n, starts in places.items():
            item_id, item, k, masks = self.items[n]
            if not k:
                ends = [at + len(item) for at in starts if _whole(text, at, at + len(item))]
                if ends:
                    found.append((item_id, 0, min(ends)))
                continue
            starts.sort()
            best = (k + 1, 0)
            at = 0
            while at < len(starts):
                # places that lie close together share one stretch of text
                last = at
                while last + 1 < len(starts) and starts[last + 1] - starts[last] <= 2 * k + 1:
                    last += 1
                low, high = max(0, starts[at] - k), starts[last] + len(item) + k
                distance, end = best_match(masks, len(item), text[low:high])
                best = min(best, (distance, low + end))
                at = last + 1
            if best[0] <= k:
                found.append((item_id, *best))
        return sorted(found, key=lambda f: (f[0] is None, f[0] or 0))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """``item_id, form, first``: normal forms of the items, and the smallest id of all items of that form."""

    def start():
        return lambda texts: [[normal(t) for t in texts]]

    forms = map_text(benchmark.where("text IS NOT NULL"), [F.col("item_id")], F.col("text"), {"form": "string"}, start).where("form != ''")
    firsts = forms.groupBy("form").agg(F.min("item_id").alias("first"))
    return forms.join(firsts, "form").select("item_id", "form", "first")


def item_blocks(classes: DataFrame, least: int = 1, block_chars: int = BLOCK_CHARS) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """Their number, and blocks of ``(first, form)``, each gathered only when it is asked for. Forms under ``least``
    characters are left out."""
    distinct = classes.where(F.length("form") >= least).select("first", "form").distinct()
    chars = distinct.agg(F.sum(F.length("form"))).first()[0] or 0
    n = -(-chars // block_chars)  # hashes spread the items evenly
    blocks = (distinct.where(F.pmod(F.xxhash64("form"), F.lit(n)) == b) if n > 1 else distinct for b in range(n))
    return n, (sorted(((r["first"], r["form"]) for r in b.collect()), key=lambda r: r[1]) for b in blocks)


MATCH = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "distance", "end")]))


def find_leaks(docs: DataFrame, items: list[tuple[int, str]], keep: list) -> DataFrame:
    """``keep`` and ``leaks``: for every row an array of ``item_id, distance, end`` of one block of items, empty where
    nothing leaked. A null or empty text holds nothing. Null ids of items become -1."""

    def start():
        matcher = Matcher(items)

        def work(texts: list[str]) -> list[list]:
            return [[[x for m in matcher.matches(t) for x in (-1 if m[0] is None else m[0], *m[1:])] for t in texts]]

        return work

    names = docs.select(*keep).columns
    out = map_text(docs, keep, F.col("text"), {"__flat": "array<long>"}, start)
    at = F.sequence(F.lit(1), F.size("__flat"), F.lit(3))
    row = lambda i: F.struct(*[F.element_at("__flat", (i + k).cast("int")).alias(f) for k, f in enumerate(("item_id", "distance", "end"))])
    leaks = F.when(F.size("__flat") > 0, F.transform(at, row)).otherwise(F.array().cast(MATCH))
    return out.select(*names, leaks.alias("leaks"))


def leaked_items(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, least: int = 1) -> DataFrame:
    """``doc_id, item_id, distance, end``: one row for each document and benchmark item that it holds, items of one normal
    form each with its own id. Items without letters or digits are left out; an empty benchmark finds nothing.
    """
    classes = item_classes(benchmark)
    n, blocks = item_blocks(classes, least, block_chars)
    found = find_leaks(docs.limit(0), [], [F.col("doc_id")]).select("doc_id", F.explode("leaks").alias("leak"))
    for items in blocks:
        part = find_leaks(docs, items, [F.col("doc_id")]).select("doc_id", F.explode("leaks").alias("leak"))
        # what a block finds is written before the next one is gathered
        found = part if n == 1 else found.unionByName(checkpoint(part))
    members = classes.select(F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("item_id", F.lit(-1)).alias("item_id")).distinct()
    found = found.select("doc_id", F.col("leak.item_id").alias("first"), "leak.distance", "leak.end")
    return found.join(members, "first").select("doc_id", "item_id", "distance", "end")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item of at least ``least`` normal characters, unchanged."""
    n, blocks = item_blocks(item_classes(benchmark), least, block_chars)
    for items in blocks:
        found = find_leaks(docs, items, [F.struct(*docs.columns).alias("row")])
        docs = found.where(F.size("leaks") == 0).select("row.*")
        docs = docs if n == 1 else checkpoint(docs)
    return docs
