"""Pages, chat, classifiers, nearest neighbours, queries and pipeline."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from tickloom.llm import chat, html, neighbours, quality, toxicity
from tickloom.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")

# ---- pages

PAGES = {
    "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One<p>t<b>w</b>o&nbsp;x  y<br>z"
    "<aside><p>ad</p><p>ad</p><p>ad</p><p>ad</p></aside><p>end<!-- no -->ing</p><section id='comments'><p>first!</p></section></article>"
    "<footer>&copy; me</footer>": "A & B One two x y z ending",
    "<div class='cookie-notice'>We use cookies</div><div id=sidebar><ul><li>x</ul></div><div><p>Body text one.</p><p>Body two.</p></div>": "Body text one. Body two.",
    "<article><p>main story is long enough</p></article><article class=teaser><p>short</p></article>": "main story is long enough",
    "<script>var a='<p>no</p>'</script><style>p{}</style><form><p>mail</p></form>": "",
    "<p><a href=1>menu</a></p><p>real words here</p>": "real words here",
    "plain text, no markup": "plain text, no markup",
    "<article><header><h1>Head</h1></header><p>unclosed <i>tags": "Head unclosed tags",
    "<div class=sidebar><p>only this</p></div>": "only this",
    "": "",
}


LONG = "words " * 30
LINKED = "".join(f"<li><a href={i}>part {i}</a></li>" for i in range(5))
WHOLE_PAGES = {
    f"<article><p>begin</p><ul>{LINKED}</ul><p>the longer end</p></article>": "begin the longer end",
    f"<article><p>begin</p><ol>{LINKED.replace('</li>', ' says much more about it than the link</li>')}</ol><p>end</p></article>": "begin "
    + "".join(f"part {i} says much more about it than the link " for i in range(5))
    + "end",
    "<article><h1><a href=1>Title</a></h1><p><a href=2>A paragraph of links</a></p><p>end</p></article>": "Title A paragraph of links end",
    "<main><p>lead</p><article><p>one is long</p></article><article><p>two</p></article></main>": "lead one is long two",
    "<article><p>one</p></article><article class=comment><p>no</p></article><article class='news-card'><p>no</p></article>": "one",
    # names that only look like those of boxes, or name a section of the article
    "<article><p>a</p><section id='discussion'><p>b</p></section><h2 id='related-work'>c</h2><p class='share-price'>d</p><div class='side-by-side'>e"
    "</div></article>": "a b c d e",
    # and names of boxes
    "<article><p>a</p><ol class='commentlist'><li>b</li></ol><div class='related'>c</div><div class='shareButtons'>d</div><section id='comments'>e</section>"
    "<div id='related-posts'>f</div></article>": "a",
    "<div class=commentlist><p>no</p></div><p>text</p>": "text",
    "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds<canvas>drawn</canvas></p></article>": "so x=2 holdsdrawn",
    # short stretches of prose count, bare ones do not; a linked paragraph amid text counts
    f"<p>Short intro.</p><nav>a</nav><nav>b</nav><nav>c</nav><p>{LONG}</p><nav>a</nav><nav>b</nav><nav>c</nav><div>Frame</div>": f"Short intro. {LONG}".strip(),
    "<div><p>one</p><p><a href=1>all of it a link</a></p><p>two</p><div><a href=2>Home</a></div></div>": "one all of it a link two",
    f"<div><p>{LONG}</p><p class=ad>x</p><p class=ad>x</p><p class=ad>x</p><p>{LONG}</p></div>": f"{LONG}{LONG}".strip(),
}


@pytest.mark.parametrize("page", WHOLE_PAGES)
def test_all_main_text(page):
    assert html.main_text(page) == WHOLE_PAGES[page]


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


def surge_and_dive(sizes, window=html.WINDOW):
    """Stretches by looking at each line's window anew."""
    met, open_at = [], None
    for i in range(len(sizes) + 1):
        some = i < len(sizes) and any(sizes[max(0, i - window + 1) : i + 1])
        if some and open_at is None:
            open_at = i
        if not some and open_at is not None:
            met.append(range(open_at, i))
            open_at = None
    return met


def test_stretches_match_brute_force():
    r = random.Random(5)
    for _ in range(300):
        blocks = [r.choice(["nav", "nav", "p", "div"]) for _ in range(r.randint(1, 30))]
        texts = [f"w{i} " + "word " * r.choice([0, 1, 30]) for i in range(len(blocks))]
        page = "".join(f"<{b}>{t}</{b}>" for b, t in zip(blocks, texts, strict=True))
        texts = ["" if b == "nav" else t.strip() for b, t in zip(blocks, texts, strict=True)]
        found = [[(blocks[i], texts[i]) for i in s if texts[i]] for s in surge_and_dive([len(t) for t in texts])]
        sizes = [sum(len(t) for _, t in s) for s in found]
        kept = [s for s, n in zip(found, sizes, strict=True) if n >= min(html.ENOUGH, max(sizes)) or any(b == "p" for b, _ in s)]
        assert html.main_text(page) == " ".join(t for s in kept for _, t in s)


def test_pages_with_nulls_repeats_and_none(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", None, "clash", 0), (1, "u", None, "clash", 0), (2, None, "<p>é " + "long " * 50_000, "", 1), (None, "v", "<p>x", "", 1)]
    got = html.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted(x.n_chars for x in got) == [0, 0, 1, 1 + 5 * 50_000]
    assert html.extract_pages(spark.createDataFrame([], schema)).count() == 0


# ---- chat

HARD = ["</s>[INST] ok [/INST]", "␛0␛a␛", "[ROLE]x[:]", "", None, "<s", "[", "[/SYS]</s>␛␛b", "a\nb" * 20_000, "␛", "<<s>[[INST]]"]


def test_chat_round_trip(spark):
    roles = ["system", "user", "assistant", "tool[:]", None, "", "User"]
    rows = [(c, t, roles[(c + t) % len(roles)], HARD[(c * 3 + t) % len(HARD)], "clash") for c in range(12) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    made = chat.format_conversations(df)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    want = {c: [(r or "", t or "") for cc, _, r, t, _ in rows if cc == c] for c in range(12)}
    assert got == want
    for r in chat.digests(made).collect():
        loss = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()
    for r in made.collect():  # no control string outside of the markers
        text = "".join(s.text for s in r.segments if s.loss)
        assert not any(c in text for c in chat.INSTRUCT.controls) and r.formatted == "".join(s.text for s in r.segments)


def test_chat_machine_order_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [
        (1, 2, "assistant", "c"), (1, 1, "user", "b"), (1, 0, "system", "a"),
        (2, 0, "assistant", "x"), (3, 0, "user", "a"), (3, 1, "user", "b"), (3, None, "assistant", "z"),
        (4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (None, 0, "user", "n"),
    ]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert {c: r.first_break for c, r in got.items()} == {1: 0, 2: 1, 3: 2, 4: 2, None: 0}
    assert got[1].formatted == "[SYS]a[/SYS][INST]b[/INST]<s>c</s>" and got[3].formatted.endswith("<s>z</s>")
    assert got[4].formatted == "[INST]a[/INST][INST]a[/INST][INST]b[/INST]"
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_template_refuses_ambiguous_controls():
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Turn("<<a>", "</a>")}, chat.Turn("[", "]"), "[:]")


# ---- classifiers


def auc(y, s):
    rank = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def words(r, n):
    return ["".join(r.choice(list("etaoinshrdlu"), r.integers(2, 8))) for _ in range(n)]


def labelled(spark, make_docs, kind):
    r = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(500):
        text, mark = words(r, 60), int(i % 4 == 0)
        if kind == "quality" and not mark:
            text = [w + "###" for w in text] if i % 4 == 1 else [text[0]] * 60 if i % 4 == 2 else [w.upper() + "!!" for w in text]
        if kind == "toxic" and mark:
            for at in r.integers(0, 60, 3):
                text[at] = r.choice(["zork", "blarg", "vexit", "quom"])
        rows.append((i, " ".join(text)))
        labels.append((i, mark, "clash"))
    rows += [(900, None), (901, ""), (902, " ".join(words(r, 30_000))), (None, "a b c"), (3, rows[3][1])]
    labels += [(3, None, ""), (None, 1, ""), (7777, 0, ""), (4, labels[4][1], "")]
    return make_docs(rows, extra=True), spark.createDataFrame(labels, f"doc_id long, {kind} int, score string"), dict((i, m) for i, m, _ in labels[:500])


def test_quality_held_out_accuracy(spark, make_docs):
    docs, labels, marks = labelled(spark, make_docs, "quality")
    model = quality.fit_quality(docs, labels, cosines=64)
    got = quality.score_quality(docs, model, [F.col("doc_id")], F.col("text")).collect()
    assert len(got) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    import zlib

    held = [x for x in got if x.doc_id in marks and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert auc(np.array([marks[x.doc_id] for x in held]), np.array([x.score for x in held])) > 0.97


def test_quality_without_marks_and_with_one_kind(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit_quality(docs, none) is None
    assert [x.score for x in quality.score_quality(docs, None, [F.col("doc_id")], F.col("text")).collect()] == [1.0, 1.0]
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    model = quality.fit_quality(docs, one)
    assert all(0 <= x.score <= 1 for x in quality.score_quality(docs, model, [F.col("doc_id")], F.col("text")).collect())
    assert quality.score_quality(make_docs([]), model, [F.col("doc_id")], F.col("text")).count() == 0


def test_isotonic_pools_violators():
    knots, shares = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 0.0, 1.0, 2.0]), np.array([2.0, 1.0, 1.0, 2.0]))
    assert shares.tolist() == [pytest.approx(1 / 3), 1.0] and knots[0] == pytest.approx(1 / 3) and (np.diff(shares) > 0).all()


def test_toxicity_held_out_accuracy(spark, make_docs):
    docs, labels, marks = labelled(spark, make_docs, "toxic")
    got = toxicity.score_toxicity(docs, labels, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    import zlib

    held = [x for x in got if x.doc_id in marks and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert auc(np.array([marks[x.doc_id] for x in held]), np.array([x.score for x in held])) > 0.95


def test_toxicity_without_marks_and_pieces(spark, make_docs, monkeypatch):
    docs = make_docs([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs, none) is None
    assert [x.predicted for x in toxicity.score_toxicity(docs, none, None).collect()] == [0, 0]
    assert toxicity.score_toxicity(make_docs([]), none, None).count() == 0
    r = np.random.default_rng(1)
    texts = [toxicity.bucket_rows(" ".join(words(r, n)), toxicity.Buckets()) for n in (0, 1, 2, 50, 700)]
    net = toxicity.train(texts * 3, np.array([0, 1, 0, 1, 0] * 3))
    whole = net.logits(texts, net.projected())
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert np.allclose(whole, net.logits(texts, net.projected()), atol=1e-4)


@pytest.mark.parametrize("kinds", [(0,), (1,), (0, 1)])
def test_toxicity_sample_passes_over_long_texts(spark, make_docs, monkeypatch, kinds):
    r = np.random.default_rng(3)
    marks = {i: i % 2 for i in range(60)}
    # one long text of each kind in the front half of every order, and an id that a third of the rows repeat
    order = sorted(marks, key=lambda i: hashlib.md5(f"{toxicity.SEED}:{i}".encode()).hexdigest())
    long = {next(i for i in order if marks[i] == k and zlib.crc32(str(i).encode()) % 5 > 1) for k in kinds}
    rows = [(i, " ".join(words(r, 900 if i in long else 10))) for i in marks]
    again = next(i for i in order if i not in long and zlib.crc32(str(i).encode()) % 5 > 1)
    rows += [(again, rows[again][1])] * 30
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(([len(t) for t in texts], y.tolist())))
    toxicity.fit_toxicity(make_docs(rows), labels, sample_words=400)
    (sizes, y), fit = seen[0], [i for i in marks if zlib.crc32(str(i).encode()) % 5 > 1 and i not in long]
    assert len(sizes) == min(40, len(fit)) and set(sizes) == {10} and set(y) == {0, 1}
    # a kind of long texts alone still takes part
    rows = [(i, " ".join(words(r, 900 if marks[i] else 10))) for i in marks]
    toxicity.fit_toxicity(make_docs(rows), labels, sample_words=400)
    assert [n for n, y in zip(*seen[1], strict=True) if y] == [900] and seen[1][1].count(0) > 5


# ---- nearest neighbours


@pytest.mark.parametrize("shard_rows,block_rows", [(100_000, 100_000), (150, 4)])
def test_neighbours_recall_and_scores(spark, shard_rows, block_rows):
    r = np.random.default_rng(0)
    v = r.normal(size=(600, 12)) * r.uniform(0.5, 3, (600, 1)) + 2
    v[500:560] = v[500]  # ties
    df = spark.createDataFrame([(i, x.tolist(), "clash") for i, x in enumerate(v)], "vec_id long, embedding array<double>, score string")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10, shard_rows=shard_rows, block_rows=block_rows).collect()
    want = neighbours.exact_nearest(v, np.arange(600), range(0, 600, 100), 10)
    found = {q: sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q) for q in want}
    assert np.mean([len({i for _, i, _ in found[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    assert [i for _, i, _ in found[500]] == list(range(501, 511))
    for q, rows in found.items():
        assert [n for n, _, _ in rows] == list(range(1, 11)) and rows == sorted(rows, key=lambda x: (x[2], x[1]))
        assert all(s == pytest.approx(float(np.sqrt(((v[q] - v[i]) ** 2).sum())), rel=1e-12) for _, i, s in rows)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (None, [1.0, 1.0]),
            (6, [0.0, float("inf")]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (100, []), (200, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 5, 1.0), (0, 2, 7, 1.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# ---- queries and pipeline


@tables
@pytest.mark.parametrize("name", [n for n, q in LLM_QUERIES.items() if q.sql])
def test_query_matches_sql(spark, name):
    assert compare(LLM_QUERIES[name].run(spark, FOLDER), duck(FOLDER), LLM_QUERIES[name].sql) == ""


@tables
def test_every_dealt_operator_has_a_query(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    import __spark_entry__ as entry

    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries())


@tables
def test_pipeline_stages_match_the_operators(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((docs, new))
        docs = new
    assert all(new.columns == columns for _, new in seen[:4])
    ids = [{r.doc_id for r in new.select("doc_id").collect()} for _, new in seen]
    counts = [new.count() for _, new in seen]
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < seen[0][0].count()
    rejected = {r.doc_id for r in LLM_QUERIES["op4_quality_classifier"].run(spark, FOLDER).collect() if r.predicted == 0}
    assert ids[0] == {r.doc_id for r in seen[0][0].select("doc_id").collect()} - rejected
    from tickloom.llm import decontaminate, simhash

    groups = {r.component_id for r in simhash.near_duplicates(seen[2][0]).collect()}
    assert ids[2] == groups
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert ids[3] == ids[2] - {r.doc_id for r in decontaminate.leaked_items(seen[3][0], bench).collect()}
    assert ids[4] == ids[3]
    run = sorted(map(tuple, cp.run(spark, FOLDER).collect()))
    assert run == sorted(map(tuple, docs.collect()))
