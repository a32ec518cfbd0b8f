"""Secret scans: plain patterns, and a battery of randomness tests over other long tokens.

A candidate is a maximal run of token characters that no pattern has claimed. Its encoding is inferred from the
characters it uses, and the tests run over their places in that alphabet: a chi-squared test of even use, a runs test
about the middle and the serial correlation of neighbours. What fails them is not random. Two more numbers hold the
token against ordinary text: how likely its letters, each after the one before, are with the letter pairs counted over
the corpus rather than with even use, which bounds a p-value; and how likely text would switch between letters, capitals
and digits as often. Both combined by Fisher's method are the p-value the false-discovery control works on, so tokens of
one kind of character count too. It is held per class of length over the whole corpus (Benjamini-Hochberg), because
short tokens can give little evidence and would otherwise use up the allowance of long ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.text import map_text, prepare
from tickloom.session import checkpoint

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

# alphabets in order of inference: the first that holds all characters of a token is its encoding
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
LENGTHS = (20, 24, 32, 48, 64)  # lower ends of the length classes
SWITCH = 0.12  # how often neighbours in ordinary tokens differ in class
# letters in a thousand of Western European text, a to z: what counts where the corpus says little
COMMON = (80, 17, 33, 40, 140, 17, 19, 37, 70, 4, 8, 44, 28, 75, 58, 22, 6, 66, 70, 72, 45, 13, 12, 3, 8, 6)
PRIOR = 1e5  # letters of a corpus that weigh as much
UNSEEN = 0.2  # share of letters in ordinary tokens that follow no pair of the corpus
EVEN = 1e-3  # a test below this speaks against randomness
FALSE_SHARE = 0.01
STEP = 10  # cells per power of ten of a p-value
FLOOR = 40  # powers of ten told apart


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _binomial_tail(k: int, n: int, p: float) -> float:
    """Chance of ``k`` or more in ``n`` draws."""
    if k <= 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k, n + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log))


def _fisher(p: float, q: float) -> float:
    """Two independent p-values as one."""
    both = max(p * q, 1e-300)
    return min(1.0, both * (1 - math.log(both)))


def letter_counts(docs: DataFrame) -> np.ndarray:
    """How often each letter follows each in the texts, case aside: 27 x 27, 0 for anything else. Long tokens are left
    out, since they may be keys."""
    rows = prepare(docs).select(F.coalesce("text", F.lit("")).alias("text"))
    place = np.zeros(256, np.int64)
    for i, c in enumerate(LOWER, 1):
        place[[ord(c), ord(c.upper())]] = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(729, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at = place[np.frombuffer(f" {TOKEN.sub(' ', text)} ".encode(), np.uint8)]
                counts += np.bincount(at[:-1] * 27 + at[1:], minlength=729)
        live = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), pa.array(counts[live], pa.int64())], names=["pair", "n"])

    found = np.zeros(729)
    for r in rows.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 729 rows
        found[r["pair"]] = r["n"]
    return found.reshape(27, 27)


def letter_evidence(counts: np.ndarray) -> list[list[float]]:
    """By letter before and letter, the logarithm of even use over the use in ordinary text."""
    common = np.array(COMMON) / sum(COMMON)
    pairs = counts[:, 1:]
    usual = (1 - UNSEEN) * (pairs + PRIOR * common) / (pairs.sum(axis=1, keepdims=True) + PRIOR) + UNSEEN * common
    return (-math.log(26) - np.log(usual)).tolist()


NO_CORPUS = letter_evidence(np.zeros((27, 27)))


def p_letters(token: str, evidence: list[list[float]]) -> float:
    """Bound of the chance that ordinary text has letters as much closer to even use of 26 or, in hexadecimal digits, of
    6: the mean of a ratio of likelihoods is 1, so one of two exceeds x with a chance of 2 / x at most."""
    gain = math.log(26 / 6) if encoding_of(token) in ("hex", "HEX") else 0.0
    before, total = 0, -math.log(2)
    for c in token.lower():
        at = ord(c) - 96 if "a" <= c <= "z" else 0
        if at:
            total += evidence[before][at - 1] + gain
        before = at
    return math.exp(-max(0.0, total))


def encoding_of(token: str) -> str:
    used = set(token)
    return next(name for name, alphabet in ENCODINGS.items() if used <= set(alphabet))


def battery(token: str, evidence: list[list[float]] = NO_CORPUS) -> dict[str, float]:
    """p-values: ``even``, ``runs``, ``serial`` under a random token; ``text`` (changes of kind), ``letters`` and
    ``ordinary`` (both) under ordinary text."""
    alphabet = ENCODINGS[encoding_of(token)]
    at = [alphabet.index(c) for c in token]
    n, size = len(at), len(alphabet)
    cells = min(8, size)
    counts, width = [0] * cells, [0] * cells
    for i in range(size):
        width[i * cells // size] += 1
    for i in at:
        counts[i * cells // size] += 1
    even = _chi_tail(sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, width, strict=True)), cells - 1)
    high = [i >= size / 2 for i in at]
    ones = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    if ones in (0, n):
        p_runs = 0.0
    else:
        mean = 1 + 2 * ones * (n - ones) / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    middle = sum(at) / n
    power = sum((i - middle) ** 2 for i in at)
    serial = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:], strict=False)) / power if power else 1.0
    # signs between words are no switch
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" for c in token if c.isalnum()]
    switches = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    text, letters = _binomial_tail(switches, max(1, len(kinds) - 1), SWITCH), p_letters(token, evidence)
    return {
        "even": even,
        "runs": p_runs,
        "serial": _two_sided((serial + 1 / n) * math.sqrt(n)),
        "text": text,
        "letters": letters,
        "ordinary": _fisher(text, letters),
    }


def length_class(n: int) -> int:
    return sum(n >= low for low in LENGTHS) - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain patterns in code points, in order."""
    low = text.lower()
    found = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if any(len(w) >= 24 for w in text.split()):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]], evidence: list[list[float]] = NO_CORPUS) -> list[tuple[int, int, int, int]]:
    """``(start, end, length class, cell)`` of all other tokens."""
    if not any(len(w) >= 20 for w in text.split()):
        return []
    found = []
    for m in TOKEN.finditer(text):
        token = m.group()
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        p = battery(token, evidence)
        random = min(p["even"], p["runs"], p["serial"]) >= EVEN
        # a token that is surely not random stays in the count with the worst p-value
        cell = min(FLOOR * STEP, int(-math.log10(max(p["ordinary"], 10.0**-FLOOR)) * STEP)) if random else 0
        found.append((m.start(), m.end(), length_class(len(token)), cell))
    return found


def _thresholds(scanned: DataFrame) -> dict[int, int]:
    """Per length class the lowest cell that the false-discovery control lets through."""
    rows = scanned.select(F.explode("candidates").alias("c")).groupBy("c.length", "c.cell").count().collect()
    cells: dict[int, dict[int, int]] = {}
    for r in rows:  # at most len(LENGTHS) x (FLOOR x STEP + 1) rows
        cells.setdefault(r["length"], {})[r["cell"]] = r["count"]
    passed = {}
    for length, counts in cells.items():
        total, above = sum(counts.values()), 0
        for cell in sorted(counts, reverse=True):
            above += counts[cell]
            # every p-value of a cell is taken at the cell's upper end
            if cell > 0 and 10.0 ** (-cell / STEP) * total <= FALSE_SHARE * above:
                passed[length] = cell
    return passed


SPAN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "kind", "end")]))
CANDIDATE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "length", "cell")]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, found`` for every row of ``docs(doc_id, text)``: arrays of ``start, kind, end`` in order.

    ``base`` holds the spans of the plain patterns, ``found`` those and the random tokens. Offsets are code points, ends
    exclusive; kinds count through :data:`KINDS`. A null text is empty; repeated rows come back as often as given.
    """

    evidence = letter_evidence(letter_counts(docs))

    def start():
        def work(texts: list[str]) -> list[list]:
            spans = [base_spans(t) for t in texts]
            other = [candidates(t, b, evidence) for t, b in zip(texts, spans, strict=True)]
            return [[sum(s, ()) for s in spans], [sum(s, ()) for s in other]]

        return work

    flat = map_text(docs, [F.col("doc_id")], F.col("text"), {"b": "array<long>", "c": "array<long>"}, start)

    def records(name: str, kind: T.ArrayType):
        fields = kind.elementType.names
        at = F.sequence(F.lit(1), F.size(name), F.lit(len(fields)))
        rows = F.transform(at, lambda i: F.struct(*[F.element_at(name, (i + k).cast("int")).alias(f) for k, f in enumerate(fields)]))
        return F.when(F.size(name) > 0, rows).otherwise(F.array().cast(kind))

    scanned = checkpoint(flat.select("doc_id", records("b", SPAN).alias("base"), records("c", CANDIDATE).alias("candidates")))
    passed = _thresholds(scanned)
    ok = lambda c: F.coalesce(
        *[F.when(c["length"] == length, c["cell"] >= cell) for length, cell in passed.items()], F.lit(False)
    )
    added = F.transform(
        F.filter("candidates", ok), lambda c: F.struct(c["start"].alias("start"), F.lit(3).cast("long").alias("kind"), c["end"].alias("end"))
    )
    return scanned.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    """Counts per plain kind, the digest of the plain spans, and all spans as text."""

    def joined(spans):
        names = F.array(*[F.lit(k) for k in KINDS])
        text = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, (s["kind"] + 1).cast("int")), s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(text, ",")

    def count(k: int):
        # one argument only: Spark gives a second one the place in the array
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
