"""Runs, collocations and pieces against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from tickloom.llm import periods, phrases, pieces
from tickloom.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- runs


def plain_runs(words, least=12):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, e - a, p) for (a, e), p in found.items())


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_sequences(least):
    r = random.Random(least)
    for _ in range(700):
        n, k = r.randint(0, 60), r.randint(1, 4)
        s = [r.randrange(k) for _ in range(n)]
        if n > 10 and r.random() < 0.5:
            a = r.randrange(n - 8)
            p = r.randint(1, 8)
            s = [x if i < a else s[a + (i - a) % p] for i, x in enumerate(s)]
        start, end, period = (x.tolist() for x in periods.runs_of(np.array(s, int), least))
        assert list(zip(start, [e - a for a, e in zip(start, end, strict=True)], period, strict=True)) == plain_runs(s, least)


def test_long_slopes_and_small_chunks(monkeypatch):
    """One period over the whole text, a Fibonacci word and a chunk of one child, past the rounds of jumps."""
    monkeypatch.setattr(periods, "ROUNDS", 1)
    monkeypatch.setattr(periods, "CHUNK", 3)
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    for s in ([0] * 200, [0, 1, 2] * 70, b):
        start, end, period = (x.tolist() for x in periods.runs_of(np.array(s), 2))
        assert list(zip(start, [e - a for a, e in zip(start, end, strict=True)], period, strict=True)) == plain_runs(s, 2)


def plain_digest(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for a, size, p in runs for i in range(a + p, a + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{a},{size},{p}\n" for a, size, p in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(kept))


def run_digests(docs):
    text = periods.planted(F.col("doc_id"), F.col("text"))
    return [tuple(r) for r in periods.digests(periods.find_runs(docs, [F.col("doc_id")], text)).collect()]


def test_runs_of_documents(spark, make_docs, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randint(0, 300))) for _ in range(120)]
    texts += ["", None, " \t\n\r", "x " * 5000, "a b\tc\n" * 40, "é ü " * 9, "one", "a " * 11, "a " * 12, "a b " * 6 + "a"]
    rows = [*enumerate(texts), (7, texts[7]), (None, "x y " * 20), (None, None)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3
    expected = sorted((plain_digest(*row) for row in rows), key=repr)
    assert sorted(run_digests(make_docs(rows, extra=True)), key=repr) == expected
    monkeypatch.setattr(periods, "GROUP_WORDS", 50)
    assert sorted(run_digests(make_docs(rows)), key=repr) == expected
    assert run_digests(make_docs([])) == []


# ---- phrases


def plain_collocations(docs, least, top):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    inside = {
        (g[0], *g[i : i + k])
        for g, a in candidates.items()
        for k in range(2, len(g) - 1)
        for i in range(1, len(g) - k + 1)
        if 100 * a >= 100 * counts[(g[0], *g[i : i + k])]
    }
    rows = []
    for g, a in candidates.items():
        if g not in inside:
            n = total[g[0]]
            cuts = [(counts[g[: 1 + k]], counts[(g[0], *g[1 + k :])]) for k in range(1, len(g) - 1)]
            score, _, left, right = min((1000 * a * n // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            rows.append((g[0], " ".join(g[1:]), a, left, right, n, score))
    out = []
    for lang in total:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(out)


@pytest.mark.parametrize(("held", "bits"), [(1_000_000, 23), (5, 14), (500, 2)])
def test_collocations_against_brute_force(spark, monkeypatch, held, bits):
    """With tables of few and many buckets: phrases that share one are never lost."""
    monkeypatch.setattr(phrases, "HELD", held)
    whole = (phrases.possible, phrases.graph_edges)
    monkeypatch.setattr(phrases, "possible", lambda *args, **more: whole[0](*args, bits=bits, **more))
    monkeypatch.setattr(phrases, "graph_edges", lambda *args: whole[1](*args, bits=bits))
    r = random.Random(5)
    vocabulary = ["a", "b", "B", "c\x01", "é", "日本", "d e", "of", " x", "f\x00", "\U0001f600"]
    docs = []
    for i in range(150):
        words = [r.choice(vocabulary) + r.choice(["", "", "", ".", ";", "\n", "!?", "\r\n\x0b"]) for _ in range(r.randint(0, 60))]
        docs.append((r.choice(["en", "de", None, "und", ""]), r.choice([" ", "\t ", "  "]).join(words)))
    docs += [("en", None), (None, None), ("en", ""), ("de", "fixed phrase of five words " * 30), ("de", "fixed phrase of five words. " * 30)]
    docs += [("xx", "t u v w x y z. " * 9)] * 3 + [("en", "a " * 3000)]
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "lang string, text string, n int, phrase string").repartition(5)
    for least, top in ((3, 2000), (9, 7)):
        got = phrases.collocations(df, F.col("lang"), F.col("text"), least, top).collect()
        assert sorted(map(tuple, got)) == plain_collocations(docs, least, top)


def test_collocations_of_nothing(spark, make_docs):
    for rows in ([], [(1, None), (2, ""), (3, " .;\n")]):
        assert phrases.collocations(make_docs(rows), F.col("lang"), F.col("text"), 1).collect() == []


def test_products_beyond_64_bits(spark):
    rows = [("en", 1, ["a b "], [9 * 10**15]), ("en", 2, ["b "], [10**15]), ("en", 2, ["b "], [7]), ("en", 0, [""], [10**16 + 7])]
    edges = spark.createDataFrame(rows, "lang string, bin int, edges array<string>, counts array<long>")
    counts = phrases.phrase_counts(edges, 1)
    row = phrases.scored_phrases(counts, 5).collect()[0]
    a, n, left, right = 9 * 10**15, 10**16 + 7, 9 * 10**15, 10**15 + 7
    assert 1000 * a * n > 2**63
    assert tuple(row) == ("en", 1, "a b", a, left, right, n, 1000 * a * n // (left * right))


def test_collocations_match_sql(spark):
    query = LLM_QUERIES["op12_phrase_collocations"]
    assert compare(query.run(spark, FOLDER), duck(FOLDER), query.sql) == ""


# ---- pieces


def test_pieces_match_the_library(spark, make_docs, monkeypatch):
    model = pieces.read_model()
    plain = pieces.load(model)
    r = random.Random(8)
    letters = ["a", "the", " ", "  ", "\t", "\n", "▁", "é", "日本", "　", "㎡", "\x00", "<s>", "</s>", "<0x0A>", "\U0001f600", "﻿", "é", "ing"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += ["", None, " ", "   ", "▁", "x" * 30_000, "word " * 20_000, " lead", "trail ", "͸", "�"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "null id")]
    expected = sorted(((i, plain.encode(t or "")) for i, t in rows), key=repr)
    for chars in (pieces.TABLE_CHARS, 0):
        monkeypatch.setattr(pieces, "TABLE_CHARS", chars)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        got = pieces.decode(pieces.encode(make_docs(rows, extra=True), [F.col("doc_id"), F.col("lang")], F.col("text"), model), model)
        found = got.collect()
        assert sorted(((x.doc_id, x.ids) for x in found), key=repr) == expected
        assert {(tuple(x.ids), x.text) for x in found} == {(tuple(i), plain.decode(i)) for _, i in expected}
    assert pieces.digests(pieces.decode(pieces.encode(make_docs([]), [F.col("doc_id")], F.col("text"), model), model)).collect() == []


def test_pieces_digests(spark, make_docs):
    model = pieces.read_model()
    row = pieces.digests(pieces.decode(pieces.encode(make_docs([(1, "Hello  world")]), [F.col("doc_id")], F.col("text"), model), model)).collect()
    ids = pieces.load(model).encode("Hello  world")
    assert [tuple(x) for x in row] == [(1, len(ids), sha(",".join(map(str, ids))), sha("Hello  world"))]


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {tuple(r[-1:]) for r in pieces.decode(df, pieces.read_model()).collect()} == {("",)}


def test_each_chunk_is_segmented_once():
    table = pieces.ChunkTable(pieces.read_model())
    asked = []

    class Recorder:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, texts, num_threads):
            asked.extend(texts)
            return self.inner.encode(texts, num_threads=num_threads)

        def piece_to_id(self, piece):
            return self.inner.piece_to_id(piece)

    table.processor = Recorder(table.processor)
    table.encode(["one two one", "two three"])
    table.encode(["three one"])
    assert sorted(asked) == ["one", "three", "two"]
