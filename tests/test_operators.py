"""DataFrame operators on small tables, with brute-force and property checks."""

import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import tables
from corpusloom.operators import bm25, chunking, dense, evaluation, evidence, fusion, lifecycle
from corpusloom.plans.ingest import by_model, ingest
from corpusloom.plans.search import Settings, federated, hybrid, routed, searched
from corpusloom.sources import pdf, readers, writers
from corpusloom.streaming.incremental import incremental_index


def sentences(spark, text, size):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["text"], r["start_offset"], r["end_offset"]) for r in chunking.chunk_sentences(rows, size).orderBy("chunk_index").collect()]


def test_sentence_examples(spark):
    assert [c[1:] for c in sentences(spark, "A. B. C.", 2)] == [(0, 2), (2, 5), (5, 8)]
    text = "A. B. C. D. E. F. G. H. I. J."
    assert sentences(spark, text, 100) == [(text, 0, len(text))]
    assert sentences(spark, "", 10) == [] and sentences(spark, None, 10) == []
    assert [c[0] for c in sentences(spark, "x" * 54 + "." + " This is another one.", 30)] == ["x" * 54 + ".", " This is another one."]
    with pytest.raises(ValueError):
        chunking.chunk_sentences(spark.createDataFrame([], "text string"), 0)


def plain_packing(text, size):
    pieces = [p for p in re.split(r"(?<=[.!?])(?=\s)", text) if p]
    out, held = [], ""
    for p in pieces:
        if held and len(held) + len(p) > size:
            out.append(held)
            held = ""
        held += p
    return out + [held] * bool(held)


def test_sentences_lose_nothing(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "é", "😀", ". ", "! ", "?\n", ".", " ", "   "]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    rows = chunking.chunk_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 12).orderBy("doc_id", "chunk_index").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert all(got.get(i, []) == plain_packing(t, 12) for i, t in enumerate(texts))


def structure(text, preset):
    compiled = [(re.compile(p, re.M), level) for p, level in fixed.PRESETS[preset]]
    return [(section, parent, path, body) for section, parent, _, path, _, _, body in chunking.structural_chunks(text, compiled)]


def test_structure_examples():
    got = structure("Intro.\nSection 1\nBody one.\n1.1\nSub.\nSection 2\nBody two.", "generic")
    assert [(s, p) for s, p, _, _ in got] == [(None, None), ("Section 1", None), ("1.1", "Section 1"), ("Section 2", None)]
    got = structure("Chapter I\nPreliminary\nSection 1\nTitle.\n(1)\nSub one.\n(a)\nClause.", "acts")
    assert got[-1][2] == ["Chapter I", "Section 1", "1", "a"]
    got = structure("CONFIDENTIALITY\n(a)\nSecret.\nARTICLE IV\nSection 1\nRule.", "contracts")
    assert [(s, p) for s, p, _, _ in got] == [("a", "CONFIDENTIALITY"), ("Section 1", "ARTICLE IV")]
    assert structure(" \n", "acts") == [] and structure("no units", "acts") == [(None, None, [], "no units")]
    assert structure("(i)\nx\n(b)\ny", "acts")[0][0] == "i"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25))
def test_paths_follow_a_stack(levels):
    text = "".join(f"L{level} u{i}\nbody\n" for i, level in enumerate(levels))
    delimiters = [(re.compile(rf"^L{level} u\d+", re.M), level) for level in range(6)]
    stack, want = [], []
    for i, level in enumerate(levels):
        stack = [u for u in stack if u[0] < level]
        want.append([name for _, name in stack] + [f"L{level} u{i}"])
        stack.append((level, f"L{level} u{i}"))
    assert [path for _, _, _, path, *_ in chunking.structural_chunks(text, delimiters)] == want


MARKED = (
    "Section 1|Section\n5|section 7A|Article 3|Article IV|ARTICLE IV|Chapter II|Part X|PART IV sec|SEVENTH SCHEDULE|Schedule VI|APPENDIX I|(a)|(ii)|(12)|1.|1.1|1.1.1|79A.|3. Subs. by|12. 4["
    "|CONFIDENTIALITY|GENERAL TERMS\nAND CONDITIONS|é|😀 body|Held.|Rule text|  |\t(b) x|\x1c|\u2003|\r|\u2028|§ 4|A|٣."
).split("|")


@pytest.mark.parametrize("preset", list(fixed.PRESETS))
def test_presets_as_expressions(spark, preset, capsys):
    rng = random.Random(preset)
    texts = ["".join(rng.choice(MARKED) + rng.choice(["\n", "\n", "\n", " ", "\n\n", "\r\n", ""]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts.append("".join(rng.choice(MARKED) + "\n" for _ in range(3 * chunking.RUN_BLOCK)))
    rows = chunking.chunk_structure(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), preset)
    got = {}
    for r in rows.orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append((r["chunk_index"], r["section"], r["parent"], r["heading"], r["hierarchy_path"], r["start_offset"], r["end_offset"], r["text"]))
    compiled = [(re.compile(p, re.M), level) for p, level in fixed.PRESETS[preset]]
    assert [got.get(i, []) for i in range(len(texts))] == [[(k, *unit) for k, unit in enumerate(chunking.structural_chunks(text, compiled))] for text in texts]
    rows.explain()
    plan = capsys.readouterr().out
    assert "InArrow" not in plan and "Exchange" not in plan and plan.count("regexp_extract_all") <= 2 * len(compiled)


def test_chunks_in_sql(spark):
    tables.register(spark)
    texts = [None, "", " \n", "Section 1\nx. y.\x1fz\n(1) w", "a. b. c." * 5, "Chapter II\nSection 2\n" * 3 + "é. 😀!\u2003q"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    fields = ["id", "chunk_index", "start_offset", "end_offset", "text"]
    for strategy, want in (("acts", chunking.chunk_structure(rows, "acts")), ("sentence", chunking.chunk_sentences(rows, 7))):
        names = fields + (["section", "parent", "heading", "hierarchy_path"] if strategy == "acts" else [])
        got = spark.sql(f"SELECT d.id, c.* FROM {{rows}} d, LATERAL chunks(d.text, '{strategy}', 7) c", rows=rows).select(*names)
        assert sorted(got.collect(), key=lambda r: r[:2]) == sorted(want.select(*names).collect(), key=lambda r: r[:2])
    for call in ("chunks(d.text, 'none')", "chunks(d.text, d.text)", "chunks(d.text, 'sentence', 0)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT c.* FROM {{rows}} d, LATERAL {call} c", rows=rows).collect()


def test_delimiters_of_ones_own(spark):
    rows = spark.createDataFrame([(1, "see @one x @two y")], "id long, text string")
    got = chunking.chunk_structure(rows, delimiters=[(r"@(?P<name>\w+)", 1)]).orderBy("chunk_index").collect()
    assert [(r["section"], r["text"]) for r in got] == [(None, "see"), ("@one", "x"), ("@two", "y")]


@pytest.mark.parametrize("items", [[], [1], list(range(chunking.RUN_BLOCK)), list(range(2 * chunking.RUN_BLOCK + 1))])
def test_running(spark, items):
    row = spark.createDataFrame([(items,)], "items array<long>").select(chunking.running(F.col("items"), lambda a, b: a + b).alias("sums")).first()
    assert row["sums"] == [int(n) for n in np.cumsum(items)]


def test_structure_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "Section 1\nx", None), (2, None, 5), (3, "Section 2\ny\nSection 3\nz", 7)], "id long, text string, other int")
    got = chunking.chunk_structure(rows, "acts").orderBy("id", "chunk_index").collect()
    assert [(r["id"], r["other"], r["section"], r["text"], r["start_offset"]) for r in got] == [(1, None, "Section 1", "x", 10), (3, 7, "Section 2", "y", 10), (3, 7, "Section 3", "z", 22)]
    with pytest.raises(ValueError):
        chunking.resolve_delimiters("sliding")


def test_bm25(spark):
    texts = ["apple banana", "apple orange", "banana banana", "kiwi", "grape", "mango"]
    chunks = spark.createDataFrame([(f"doc{i + 1}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "Banana"), (2, "nothing"), (3, ""), (4, "banana banana")], "query_id long, text string")
    got = bm25.search(bm25.build(chunks), asked, 2).orderBy("query_id", "rank0").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, "doc3"), (1, "doc1"), (4, "doc3"), (4, "doc1")]
    n, df, avgdl = 6, 2, 9 / 6
    idf = math.log(n - df + 0.5) - math.log(df + 0.5)
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 2 / avgdl))
    assert got[0]["score"] == pytest.approx(want, abs=1e-6) and got[2]["score"] == pytest.approx(2 * want, abs=1e-6)


def test_frequent_terms_have_floored_weight(spark):
    chunks = spark.createDataFrame([(str(i), "the " + "abcdefgh"[i]) for i in range(8)], "chunk_id string, text string")
    stats = {r["term"]: r["idf"] for r in bm25.build(chunks).term_stats.collect()}
    raw = {t: math.log(8 - d + 0.5) - math.log(d + 0.5) for t, d in [("the", 8)] + [(c, 1) for c in "abcdefgh"]}
    assert stats["the"] == pytest.approx(0.25 * sum(raw.values()) / len(raw)) and stats["a"] == pytest.approx(raw["a"])


def plain_bm25(docs, query, k):
    """(score, id) of the best by the formula, over a dict of token lists."""
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if r < 0 else r for w, r in raw.items()}
    scored = []
    for i, words in docs.items():
        total = sum(idf[w] * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / avgdl)) for w in query if w in words)
        if round(total, 6) > 0:
            scored.append((-round(total, 6), i))
    return [i for _, i in sorted(scored)[:k]]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_bm25_by_category(spark, monkeypatch, limit, tmp_path):
    monkeypatch.setattr(bm25, "BROADCAST_WEIGHTS", limit)
    rng = random.Random(8)
    words = "a b c d e f g h".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), rng.choice(["x", "y", "y", "z"])) for i in range(80)] + [(90, None, "x")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, category string")
    index = bm25.build(chunks, category_col="category")
    index.save(f"{tmp_path}/sparse")
    index = bm25.SparseIndex.load(spark, f"{tmp_path}/sparse")
    asked = {1: "a a b", 2: "H c nothing", 3: ""}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    docs = {i: (t or "").split() for i, t, _ in rows}
    of = {c: {i: docs[i] for i, _, k in rows if k == c} for c in "xyz"}

    def lists(found, *by):
        out = {}
        for r in found.orderBy("rank0").collect():
            out.setdefault(tuple(r[c] for c in by), []).append(r["id"])
        return out

    plain = {q: plain_bm25(docs, t.lower().split(), 5) for q, t in asked.items()}
    assert lists(bm25.search(index, queries, 5), "query_id") == {(q,): v for q, v in plain.items() if v}
    each = {(q, c): plain_bm25(of[c], t.lower().split(), 5) for q, t in asked.items() for c in of}
    assert lists(bm25.search(index, queries, 5, each=True), "query_id", "category") == {k: v for k, v in each.items() if v}
    assert lists(bm25.search(index, queries, 5, namespace="y"), "query_id") == {(q,): v for (q, c), v in each.items() if c == "y" and v}


def test_every_category_is_asked(spark):
    """A category whose hits are behind all of another's still gives its list."""
    rows = [(f"big/{i}", "life life liberty", "big") for i in range(60)] + [(f"small/{i}", t, "small") for i, t in enumerate(["life among many other words here", "tea", "sale", "price", "goods"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, category string")
    asked = spark.createDataFrame([(1, "life")], "query_id long, text string")
    vectors = dense.embed(chunks, "chunk_id", "text", keep=("category",))
    wanted = dense.embed(asked, "query_id", "text").withColumnRenamed("id", "query_id")
    hits = hybrid(asked, bm25.build(chunks, category_col="category"), vectors, wanted, 3, each=True)
    got = {(r["category"], r["rank0"]): r["id"] for r in hits.collect()}
    assert got["small", 0] == "small/0" and {c for c, _ in got} == {"big", "small"}
    merged = fusion.federate(hits, 4).orderBy("place").collect()
    assert {r["category"] for r in merged[:2]} == {"big", "small"}
    only = hybrid(asked, bm25.build(chunks, category_col="category"), vectors, wanted, 3, category="small").orderBy("rank0").collect()
    assert only[0]["id"] == "small/0"


def test_categories_are_ranked_by_their_settings(spark):
    rng = random.Random(4)
    words = "a b c d e f".split()
    rows = [(f"{c}/{i}", " ".join(rng.choices(words, k=6)), c) for c in "xy" for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, category string")
    asked = spark.createDataFrame([(1, "a b"), (2, "c d e")], "query_id long, text string")
    vectors = dense.embed(chunks, "chunk_id", "text", keep=("category",))
    wanted = dense.embed(asked, "query_id", "text").withColumnRenamed("id", "query_id")
    index = bm25.build(chunks, category_col="category")
    units = chunks.select("chunk_id", "category", F.lit("d").alias("source_doc"), F.lit("1").alias("section"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("hierarchy_path"), F.array().cast("array<struct<category:string,doc:string,section:string>>").alias("cites"))
    by = lambda found, category: sorted(map(tuple, found.where(F.col("category") == category).select("query_id", "id", "score", "rank0").collect()))
    search = lambda **options: hybrid(asked, index, vectors, wanted, 4, each=True, **options)
    plain, other = search(), search(rrf_k=3)
    mixed = search(settings={"x": Settings(rrf_k=3)})
    assert by(mixed, "x") == by(other, "x") != by(plain, "x") and by(mixed, "y") == by(plain, "y")
    diverse = search(use_mmr=True, weight=0.4)
    mixed = search(settings={"y": Settings(use_mmr=True, weight=0.4), "x": Settings(rrf_k=3)})
    assert by(mixed, "y") == by(diverse, "y") != by(plain, "y") and by(mixed, "x") == by(other, "x")
    boosted = search(chunks=units, boosts={"structural": None})
    mixed = search(chunks=units, settings={"x": Settings(structural=None)})
    assert by(mixed, "x") == by(boosted, "x") and by(mixed, "y") == by(search(chunks=units), "y")
    with pytest.raises(ValueError):
        hybrid(asked, index, vectors, wanted, 4, settings={"x": Settings()})


def test_mmr_forms_agree(spark):
    rng = np.random.default_rng(6)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in rng.normal(size=(n, 4))]
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(unit(90))], "id long, embedding array<double>")
    rows = [(q, int(i), float(s), place) for q in range(4) for place, (i, s) in enumerate(zip(rng.permutation(95)[: 40 if q else 3], sorted(rng.random(40).round(2), reverse=True)))]
    placed = spark.createDataFrame([*rows, (7, 1, 0.5, 0), (7, 2, 0.5, 1)], "query_id long, id long, boosted double, place int")
    plain = sorted(map(tuple, fusion.mmr(placed, vectors, 5).collect()))
    assert sorted(map(tuple, fusion.mmr(placed, vectors, 5, frame=10).collect())) == plain
    assert sorted(map(tuple, fusion.mmr_expression(placed, vectors, 5).collect())) == plain


def test_dense_by_category(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 4)).round(1)
    kinds = ["a" if i % 10 else "b" for i in range(120)]
    vectors = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(base, kinds))], "id long, embedding array<double>, category string")
    query = rng.normal(size=4).round(1)
    got = {}
    for r in dense.search(vectors, spark.createDataFrame([(1, query.tolist())], "query_id long, embedding array<double>"), 5, by="category").orderBy("rank0").collect():
        got.setdefault(r["category"], []).append(r["id"])
    scores = np.round(base @ query, 6)
    want = {k: [i for i in np.lexsort((np.arange(120), -scores)).tolist() if kinds[i] == k][:5] for k in "ab"}
    assert got == want


def test_dense(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    base, asked = rng.normal(size=(200, 5)).round(1), rng.normal(size=(7, 5)).round(1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    got = {}
    for r in dense.search(vectors, queries, 9).orderBy("query_id", "rank0").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    scores = np.round(asked @ base.T, 6)
    assert got == {i: np.lexsort((np.arange(200), -row))[:9].tolist() for i, row in enumerate(scores)}
    assert dense.search(vectors.limit(0), queries, 9).count() == 0 and dense.search(vectors, queries.limit(0), 9).count() == 0
    with pytest.raises(Exception, match="numbers"):
        dense.search(vectors, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 3).collect()


def fusion_fixture(spark):
    ids = ["d1", "d2", "d3", "d4"]
    lists = [[("q", i, r) for r, i in enumerate(order)] for order in (ids, ids[::-1])]
    channels = [spark.createDataFrame(x, "query_id string, id string, rank0 int") for x in lists]
    meta = [
        ("d1", "21", None, ["Part III", "Article 21"], "const", []), ("d2", "22", "Part III", ["Part III"], "const", []),
        ("d3", "x", None, [], "other", [("statute", "const", "21")]), ("d4", "302", None, ["Chapter XVI"], "ipc", []), ("d5", "21", None, ["Seventh Schedule"], "const", []), ("d6", "Article 21", None, ["Part IV"], "const", []),
    ]
    chunks = spark.createDataFrame(meta, "chunk_id string, section string, parent string, hierarchy_path array<string>, source_doc string, cites array<struct<category:string,doc:string,section:string>>").withColumn("category", F.lit("c"))
    vectors = spark.createDataFrame([("d1", [1.0, 0.0, 0.0]), ("d2", [1.0, 0.0, 0.0]), ("d3", [0.0, 1.0, 0.0]), ("d4", [0.0, 0.0, 1.0])], "id string, embedding array<double>")
    return channels, chunks, vectors


def test_fusion(spark):
    channels, chunks, vectors = fusion_fixture(spark)
    fused = {r["id"]: r["score"] for r in fusion.rrf(channels, 1).collect()}
    assert fused == {"d1": 0.7, "d4": 0.7, "d2": pytest.approx(1 / 3 + 1 / 4), "d3": pytest.approx(1 / 3 + 1 / 4)}
    assert {r["id"]: r["score"] for r in fusion.rrf_outer(*channels, 1).collect()} == fused
    assert {r["id"]: r["score"] for r in fusion.rrf(channels[::-1], 1).collect()} == fused
    asked = spark.createDataFrame([("q", [("Article", "21")])], "query_id string, refs array<struct<ref_type:string,ref_val:string>>")
    wide = fusion.expand(fusion.rrf(channels, 1), asked, chunks, "c")
    assert {r["id"] for r in wide.collect()} == {"d1", "d2", "d3", "d4", "d6"}
    assert {r["id"] for r in fusion.expand(fusion.rrf(channels, 1), asked, chunks, "none").collect()} == {"d1", "d2", "d3", "d4"}
    assert [tuple(r) for r in fusion.cited(wide, chunks).collect()] == [("q", "d1")]
    boosted = {r["id"]: r["boosted"] for r in fusion.boost(wide, asked, chunks, 1.0, 0.5, 0.5).collect()}
    assert boosted["d1"] == pytest.approx(0.7 + 1.0 + 0.5) and boosted["d6"] == 1.0 and boosted["d4"] == 0.7
    below = {r["id"]: r["boosted"] for r in fusion.boost(wide, asked, chunks, None, 0.5, None).collect()}
    assert below["d1"] == pytest.approx(1.2) and below["d2"] == pytest.approx(fused["d2"])
    placed = fusion.ordered(fusion.rrf(channels, 1), "score")
    assert [r["id"] for r in placed.orderBy("place").collect()] == ["d1", "d4", "d2", "d3"]
    picked = fusion.mmr(placed.withColumn("boosted", F.col("score")), vectors, 3, 0.5).orderBy("rank0").collect()
    assert [r["id"] for r in picked][:2] == ["d1", "d4"] and "d2" not in [r["id"] for r in picked][:2]
    plain = fusion.mmr(placed.withColumn("boosted", F.col("score")), vectors, 4, 1.0).orderBy("rank0").collect()
    assert [r["id"] for r in plain] == ["d1", "d4", "d2", "d3"]


def test_federation(spark):
    hits = {"acts": [("q", "a1", 0.9, 0), ("q", "a2", 0.5, 1)], "judgments": [("q", "j1", 2.0, 0), ("q", "j2", 1.0, 1)], "constitution": [("q", "c1", 0.1, 0)]}
    lists = {c: spark.createDataFrame(x, "query_id string, id string, score double, rank0 int") for c, x in hits.items()}
    got = federated(spark.range(1), lists, 4).orderBy("place").collect()
    assert [r["id"] for r in got] == ["j1", "a1", "c1", "j2"]


def test_hybrid_end_to_end(spark):
    texts = ["Article 21 protects life", "the price of tea", "life and liberty", "tea and life", "contracts of sale"] + [f"filler text {i}" for i in range(8)]
    chunks = spark.createDataFrame([(f"c/{i}", t, "c", f"{i}", [f"Part {i}"], None, f"s{i}", []) for i, t in enumerate(texts)], "chunk_id string, text string, category string, section string, hierarchy_path array<string>, parent string, source_doc string, cites array<struct<category:string,doc:string,section:string>>")
    asked = spark.createDataFrame([(1, "life"), (2, "tea price")], "query_id long, text string")
    vectors, wanted = dense.embed(chunks, "chunk_id", "text"), dense.embed(asked, "query_id", "text").withColumnRenamed("id", "query_id")
    for options in ({}, {"chunks": chunks}, {"use_mmr": True}):
        got = hybrid(asked, bm25.build(chunks), vectors, wanted, 3, **options).where("rank0 = 0").orderBy("query_id").collect()
        assert [r["id"] for r in got][1] == "c/1" and len(got) == 2
    assert {r["target"] for r in routed(asked, "acts").collect()} == {"acts"}
    mine = routed(asked, "acts", lambda text: F.when(text == "life", "FACT_PATTERN_QUERY").otherwise("x"), lambda text, kind: F.upper(text)).orderBy("query_id").collect()
    assert [(r["target"], r["text"]) for r in mine] == [("judgments", "LIFE"), ("acts", "TEA PRICE")]


def plain_metrics(got, relevant, k):
    cut = got[:k]
    hits, gain, seen = 0, 0.0, set()
    for rank, i in enumerate(cut, 1):
        if i in relevant and i not in seen:
            hits += 1
            gain += hits / rank
        seen.add(i)
    n = len(relevant)
    return (sum(i in relevant for i in cut) / k, len(set(cut) & relevant) / n if n else 0, next((1 / r for r, i in enumerate(cut, 1) if i in relevant), 0), gain / n if n else 0)


def test_metrics(spark):
    rng = random.Random(3)
    lists = {q: [rng.randrange(12) for _ in range(rng.randint(0, 12))] for q in range(30)}
    relevant = {q: {rng.randrange(12) for _ in range(rng.randint(0, 4))} for q in lists}
    queries = spark.createDataFrame([(q,) for q in lists], "query_id long")
    hits = spark.createDataFrame([(q, i, r) for q, x in lists.items() for r, i in enumerate(x)], "query_id long, id long, rank0 int")
    pairs = spark.createDataFrame([(q, i) for q, x in relevant.items() for i in x], "query_id long, id long")
    rows = evaluation.metrics(queries, hits, pairs, (1, 3, 10)).collect()
    assert len(rows) == 90
    for r in rows:
        assert tuple(r)[2:] == pytest.approx(plain_metrics(lists[r["query_id"]], relevant[r["query_id"]], r["k"]), abs=1e-5)
    none = {r["query_id"] for r in evaluation.zero_hits(queries, hits, pairs, 10).collect()}
    assert none == {q for q in lists if not set(lists[q][:10]) & relevant[q]}
    mean = evaluation.macro(evaluation.metrics(queries, hits, pairs, (3,))).first()
    assert mean["precision"] == pytest.approx(sum(plain_metrics(lists[q], relevant[q], 3)[0] for q in lists) / 30, abs=1e-5)
    with pytest.raises(ValueError):
        evaluation.metrics(queries, hits, pairs, (0,))


def test_evidence_and_prompts(spark):
    chunks = spark.createDataFrame([("c1", " text one ", "doc", "1"), ("c2", "  ", "doc", "2"), ("c3", "three", "", None)], "chunk_id string, text string, source_doc string, section string")
    hits = spark.createDataFrame([("q", "c1", 0, ""), ("q", "c2", 1, "x"), ("q", "c3", 2, "own"), ("q", "gone", 3, "")], "query_id string, id string, rank0 int, source_doc string")
    got = evidence.gather(hits, chunks).orderBy("rank0").collect()
    assert [(r["id"], r["source_doc"]) for r in got] == [("c1", "doc"), ("c3", "own")]
    assert {r["chunk_id"] for r in evidence.lookup(hits.union(hits), chunks).collect()} == {"c1", "c2", "c3"}
    questions = spark.createDataFrame([("q", " why? "), ("r", "what?")], "query_id string, question string")
    found = evidence.gather(hits, chunks)
    messages = {r["query_id"]: r["user_message"] for r in evidence.prompts(questions, found).collect()}
    assert "QUESTION:\nwhy?\n\n" in messages["q"] and "[S1]\nsource_doc: doc\nsection: 1\nPassage:\ntext one\n\n[S3]\nsource_doc: own\nPassage:\nthree" in messages["q"]
    assert fixed.NO_EVIDENCE_PROMPT in messages["r"]
    with pytest.raises(Exception, match="empty"):
        evidence.prompts(spark.createDataFrame([("q", " ")], "query_id string, question string"), found).collect()
    prompted = evidence.prompts(questions, found)

    def fails(system, user):
        raise OSError("down")

    answered = evidence.answers(prompted, fails, lambda system, user: "See (s1)." if "why?" in user else "Nothing.")
    told = answered.select("query_id", "answer", F.when(F.col("query_id") == "q", 4).otherwise(0).alias("retrieved"))
    out = {r["query_id"]: r for r in evidence.responses(told, found.withColumn("original_text", F.lit(""))).collect()}
    assert out["q"]["answer"] == "See [S1]." and out["q"]["validation"]["valid"] and len(out["q"]["evidence"]) == 2
    assert out["r"]["limitations"][0] == fixed.NO_EVIDENCE_LIMITATION
    with pytest.raises(Exception, match="no model"):
        evidence.answers(prompted, fails).collect()
    asked = spark.createDataFrame([("q", " why? "), ("none", "what?"), ("blank", "how?")], "query_id string, question string")
    found_hits = hits.withColumn("score", F.lit(0.5)).unionByName(spark.createDataFrame([("blank", "c2", 0, "", 0.1)], "query_id string, id string, rank0 int, source_doc string, score double"))
    seen = []
    answered, kept = evidence.answered(asked, found_hits, chunks, lambda system, user: "As (S2) says." if "[S2]\nsource_doc: own" in user else 1 / 0)
    related = spark.createDataFrame([("q", "j1", 0, 0.9, "case text", "HC"), ("q", "j2", 1, 0.8, " ", None)], "query_id string, id string, rank0 int, score double, text string, court string")
    out = {r["query_id"]: r for r in evidence.responses(answered, kept, related).collect()}
    assert out["q"]["answer"] == "As [S2] says." and out["q"]["validation"]["valid"] and out["q"]["retrieved_count"] == 4 and out["q"]["used_count"] == 2
    assert [(e["chunk_id"], e["source_doc"], e["section"], e["text"], e["retrieval_score"]) for e in out["q"]["evidence"]] == [("c1", "doc", "1", "text one", 0.5), ("c3", "own", None, "three", 0.5)]
    assert [(c["chunk_id"], c["court"], c["text"]) for c in out["q"]["related_cases"]] == [("j1", "HC", "case text")]
    assert out["none"]["answer"] == fixed.NO_EVIDENCE_ANSWER and out["blank"]["answer"] == fixed.NO_TEXT_ANSWER and out["blank"]["retrieved_count"] == 1 and not seen
    assert out["blank"]["limitations"][0] == fixed.NO_TEXT_LIMITATION and out["none"]["related_cases"] == []
    with pytest.raises(Exception, match="2000"):
        evidence.validated(spark.createDataFrame([("q", "x" * 2001)], "query_id string, question string")).collect()
    turns = spark.createDataFrame([(1, 0, "system", "x"), (1, 1, "user", " hi "), (1, 2, "assistant", " ")], "conv_id long, turn long, role string, text string")
    assert [r["content"] for r in evidence.history(turns).collect()] == ["hi"]


def small_chunks(spark, n=15):
    return spark.createDataFrame([(f"{'acts' if i < 6 else 'cases'}/{i}", "acts" if i < 6 else "cases", f"text number {i}", f"text number {i}") for i in range(n)], "chunk_id string, category string, text string, original_text string")


def test_index_lifecycle(spark, tmp_path):
    chunks, path = small_chunks(spark), f"file://{tmp_path}/index"
    first = lifecycle.build_index(chunks, path)
    assert first.chunk_count == 15 and lifecycle.read_manifest(spark, path) == first
    assert lifecycle.build_index(chunks.orderBy(F.desc("chunk_id")), path) == first
    lifecycle.require_fresh(first, lifecycle.manifest_of(chunks, "hashing", False))
    with pytest.raises(lifecycle.IndexStaleError, match="corpus_fingerprint"):
        lifecycle.require_fresh(first, lifecycle.manifest_of(chunks.limit(12), "hashing", False))
    with pytest.raises(lifecycle.IndexStaleError):
        lifecycle.require_fresh(None, first)
    with pytest.raises(ValueError, match="fewer"):
        lifecycle.build_index(chunks.limit(3), path + "2")
    index = lifecycle.load_index(spark, path, first)
    terms = {(r["namespace"], r["term"]): r["df"] for r in index.sparse.term_stats.collect()}
    assert terms["_merged", "text"] == 15 and terms["acts", "text"] == 6
    sizes = {r["namespace"]: (r["n"], r["avgdl"]) for r in index.sparse.corpus_stats.collect()}
    assert sizes == {"acts": (6, 3.0), "cases": (9, 3.0), "_merged": (15, 3.0)}
    assert index.vectors.count() == index.store.count() == 15 and index.manifest == first
    asked = spark.createDataFrame([(1, "number 7"), (2, "3")], "query_id long, text string")
    assert [r["id"] for r in searched(index, asked, 2).where("rank0 = 0").orderBy("query_id").collect()] == ["cases/7", "acts/3"]
    with pytest.raises(lifecycle.IndexStaleError):
        lifecycle.load_index(spark, path, lifecycle.manifest_of(chunks, "other", False))
    with pytest.raises(lifecycle.IndexStaleError):
        lifecycle.load_index(spark, path + "3")
    assert {r["namespace"]: r["n"] for r in lifecycle.category_counts(chunks).collect()} == {"acts": 6, "cases": 9, "_merged": 15}
    assert set(index.store.columns) == {"chunk_id", "category"}


def test_a_complete_index_is_never_overwritten(spark, tmp_path):
    chunks, path = small_chunks(spark), f"file://{tmp_path}/index"
    with pytest.raises(lifecycle.ResumeMismatchError):
        lifecycle.build_or_keep(chunks, path, resume=True)
    first = lifecycle.build_or_keep(chunks, path)
    assert lifecycle.build_or_keep(chunks, path) == first
    with pytest.raises(lifecycle.IndexStaleError):
        lifecycle.build_or_keep(chunks.limit(12), path)
    corpus = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, id string")
    assert lifecycle.resume_point(corpus.where("pos = 0"), corpus, {"model": "m", "old": 1}, {"model": "m", "new": 2}) == 1
    with pytest.raises(lifecycle.ResumeMismatchError, match="model"):
        lifecycle.resume_point(corpus.limit(0), corpus, {"model": "m"}, {"model": "n"})


def test_resume_and_verify(spark):
    corpus = spark.createDataFrame([(i, f"c{i}") for i in range(10)], "pos long, id string")
    assert lifecycle.resume_point(corpus.where("pos < 4"), corpus) == 4 and lifecycle.resume_point(corpus.limit(0), corpus) == 0
    for bad in (corpus.where("pos IN (0, 2)"), corpus.withColumn("id", F.lit("x")), corpus.unionByName(spark.createDataFrame([(10, "c10")], "pos long, id string"))):
        with pytest.raises(lifecycle.ResumeMismatchError):
            lifecycle.resume_point(bad, corpus)
    vectors = corpus.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    store = corpus.withColumnRenamed("id", "chunk_id")
    assert all(lifecycle.verify(vectors, store, corpus, 2).first())
    broken = lifecycle.verify(vectors, store.where("pos <> 3"), corpus.where("pos < 9"), 3).first().asDict()
    assert [k for k, v in broken.items() if not v] == ["count_matches", "dimension_matches", "last_matches", "ids_in_store", "no_duplicate_ids"]
    short = lifecycle.Manifest("f", "", "m", False, "", "1", 9)
    assert [k for k, v in lifecycle.verify(vectors, store, corpus, 2, short).first().asDict().items() if not v] == ["manifest_count_matches", "manifest_has_fingerprints"]


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_sources_and_ingest(spark, tmp_path):
    raw = tmp_path / "raw" / "acts"
    write(raw / "ipc.txt", "Section 1\nHello AIR 1973 SC 1")
    write(raw / "latin.md", "caf\xe9".encode("latin-1"))
    write(raw / "skip.docx", "no")
    write(raw / "scan.pdf", b"%PDF")
    write(raw / "ipc.meta.yaml", "category: Contracts\nyear: 1860\nparties: [A, B]\n")
    write(raw / "latin.meta.yaml", "[broken")
    docs = readers.read_documents(spark, f"file://{raw}", "acts")
    assert {r["source_doc"]: r["text"] for r in docs.collect()} == {"ipc": "Section 1\nHello AIR 1973 SC 1", "latin": "café"}
    more = readers.read_documents(spark, f"file://{raw}", extractors={"pdf": lambda content: content.decode() + "!"})
    assert {r["text"] for r in more.where("format = 'pdf'").collect()} == {"%PDF!"}
    with pytest.raises(readers.UnsupportedFormatError):
        readers.read_documents(spark, f"file://{raw}", formats=("docx",))
    with pytest.raises(readers.UnsupportedFormatError):
        readers.read_document(spark, f"file://{raw}/skip.docx")
    assert readers.read_document(spark, f"file://{raw}/ipc.txt").count() == 1
    assert [r["source_doc"] for r in readers.read_documents(spark, f"file://{raw}", ordered=True).collect()] == ["ipc", "latin"]
    nothing = readers.read_documents(spark, f"file://{tmp_path}/nowhere")
    assert nothing.count() == 0 and nothing.columns == docs.columns
    write(tmp_path / "lines.jsonl", "{}\n \t\n\u2003\n{}\n")
    assert readers.count_lines(spark, f"file://{tmp_path}/lines.jsonl") == 2
    parse = lambda text: {"category": "Contracts", "year": 1860, "parties": ["A", "B"]} if "Contracts" in text else 1 / 0
    side = readers.read_sidecars(spark, f"file://{raw}", parse)
    names = spark.createDataFrame([("acts", "IN"), ("contracts", "")], "name string, jurisdiction string")
    full = readers.with_metadata(docs, side, names)
    got = {r["source_doc"]: r for r in full.collect()}
    assert got["ipc"]["category"] == "contracts" and got["ipc"]["parties"] == ["A", "B"] and got["latin"]["category"] == "acts" and got["latin"]["jurisdiction"] == "IN"
    chunks = ingest(full, {"contracts": ("pattern", "acts"), "acts": ("sentence", None)})
    rows = {r["chunk_id"]: r for r in chunks.collect()}
    assert set(rows) == {"contracts/ipc/0", "acts/latin/0"}
    one = rows["contracts/ipc/0"]
    assert one["cites"][0]["doc"] == "AIR 1973 SC 1" and one["contract_meta"]["parties"] == ["A", "B"] and one["sac_applied"] and one["text"].endswith(one["original_text"])
    told = ingest(full, {"acts": ("sentence", None)}, summarizer=by_model(lambda text: "Coffee." if "caf" in text else 1 / 0)).collect()
    assert {r["source_doc"]: r["doc_summary"] for r in told} == {"latin": "Coffee.", "ipc": one["doc_summary"]}
    writers.write_chunks(chunks, f"file://{tmp_path}/chunks")
    back = readers.read_chunks(spark, f"file://{tmp_path}/chunks")
    assert back.count() == 2 == readers.count_lines(spark, f"file://{tmp_path}/chunks")
    query = incremental_index(spark, f"file://{tmp_path}/chunks", f"file://{tmp_path}/inc")
    query.awaitTermination(120)
    assert lifecycle.load_index(spark, f"file://{tmp_path}/inc").vectors.count() == 2


def test_judgments_and_cases(spark, tmp_path):
    schema = "Text string, Doc_url string, Titles string, Court_Name_Normalized string, Court_Name string, Date string"
    rows = spark.createDataFrame([("t1", "https://x/doc/111/", "T", "SC", "sc", "2020"), ("t2", None, " ", None, "HC", None), ("", "https://x/doc/3/", "T", "SC", "sc", "2020")], schema)
    rows.write.parquet(str(tmp_path / "judgments"))
    got = {r["case_id"]: r for r in readers.read_judgments(spark, str(tmp_path / "judgments")).collect()}
    assert set(got) == {"111", hashlib.md5(b"t2").hexdigest()}
    assert got["111"]["court"] == "SC" and got["111"]["date"] == "2020" and got[hashlib.md5(b"t2").hexdigest()]["court"] == "HC"
    own = spark.newSession()
    own.conf.set("spark.sql.caseSensitive", "true")
    twins = own.createDataFrame([(" t1 ", "https://x/doc/1 2.pdf/", "2020", "1999"), ("t2", "https://x/doc/5", " ", "1999"), (" ", None, None, None)], "Text string, Doc_url string, Date string, date string")
    twins.write.parquet(str(tmp_path / "twins"))
    assert sorted(map(tuple, readers.read_judgments(spark, str(tmp_path / "twins")).select("case_id", "text", "date").collect())) == [("1_2_pdf", "t1", "2020"), ("5", "t2", "1999")]
    assert spark.conf.get("spark.sql.caseSensitive") == "false"
    folder = f"file://{tmp_path}/cases"
    cases = readers.read_judgments(spark, str(tmp_path / "judgments"))
    assert writers.write_case_files(cases, folder).count() == 2 and (tmp_path / "cases" / "111.txt").read_text() == "t1"
    assert (tmp_path / "cases" / "111.meta.yaml").read_text() == 'category: "judgments"\njurisdiction: "India"\nshort_title: "T"\ncourt: "SC"\ndate: "2020"\n'
    (tmp_path / "cases" / "111.txt").write_text("mine")
    assert writers.write_case_files(cases, folder).count() == 0 and (tmp_path / "cases" / "111.txt").read_text() == "mine"
    assert writers.write_case_files(cases, folder, overwrite=True, limit=5).count() == 2 and (tmp_path / "cases" / "111.txt").read_text() == "t1"
    assert writers.write_case_files(cases, f"file://{tmp_path}/one", limit=1).count() == 1
    twice = spark.createDataFrame([(f"c{i % 3}", f"text {i}", None, None, None) for i in range(9)], "case_id string, text string, title string, court string, date string").repartition(1)
    first = {}
    for r in twice.collect():
        first.setdefault(r["case_id"], r["text"])
    assert writers.write_case_files(twice, f"file://{tmp_path}/twice").count() == 3
    assert {p.stem: p.read_text() for p in (tmp_path / "twice").glob("*.txt")} == first and not (tmp_path / "twice" / "_attempts").exists()
    # A task that fails leaves whole files only, and a second run writes what is missing.
    broken = twice.withColumn("case_id", F.concat("case_id", F.lit("x"))).withColumn("title", F.when(F.col("case_id") == "c1x", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        writers.write_case_files(broken, f"file://{tmp_path}/twice")
    assert {p.stem for p in (tmp_path / "twice").glob("*.txt")} <= {"c0", "c1", "c2", "c0x", "c2x"} and not (tmp_path / "twice" / "_attempts").exists()
    assert writers.write_case_files(twice.withColumn("case_id", F.concat("case_id", F.lit("y"))), f"file://{tmp_path}/twice").count() == 3
    assert writers.write_case_files(twice, f"file://{tmp_path}/some", limit=2).count() == len({r["case_id"] for r in twice.collect()[:2]})
    assert readers.flat_fields("a: 1\nb: 'x y' \nc: [p, 2]\nd:\n - q # no\n\n") == {"a": 1, "b": "x y", "c": ["p", 2], "d": ["q"]}
    for bad in ("[broken", "a: [b", "- c"):
        with pytest.raises(ValueError):
            readers.flat_fields(bad)
    shards = readers.read_shards(spark, lambda i: ({"id": 10 * i + k, "other": 1} for k in range(5)), 4, "id long, text string")
    assert sorted(r["id"] for r in shards.collect()) == [10 * i + k for i in range(4) for k in range(5)]
    assert readers.read_shards(spark, lambda i: iter([{"id": i}] * 3) if i < 2 else 1 / 0, 4, "id long", limit=4).count() == 4
    assert writers.new_rows(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",)], "k string"), "k").count() == 1
    write(tmp_path / "cases.jsonl", json.dumps({"query": "q", "relevant_ids": ["a"], "category": "acts"}) + "\n")
    assert readers.read_cases(spark, str(tmp_path / "cases.jsonl")).first()["relevant_ids"] == ["a"]
    with pytest.raises(ValueError):
        readers.load_config({"ingest": {"raw_dir": "r"}, "chunking": {}})
    assert readers.load_config({"ingest": {"raw_dir": "r", "processed_dir": "p", "chunks_file": "c"}, "chunking": {"sentence": {"max_chars": 5}}}).max_chars == 5


def test_pdf():
    lines = writers.report_lines({"question": "é(1)", "answer": "word " * 60, "evidence": [{"category": "acts", "text": "x"}], "limitations": ["l"]})
    assert max(map(len, lines)) <= fixed.PDF_WIDTH and lines[0] == "Question: ?(1)" and "No related cases were found." in lines
    more = writers.report_lines({"question": "q", "related_cases": [{"source_doc": "d", "section": "4", "court": "HC", "text": "y"}]})
    assert "d | section 4 | HC" in more and " ".join(more).endswith(fixed.REPORT_FOOTER)
    data = writers.render_pdf(lines * 20)
    assert data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF") and data.count(b"/Type /Page ") == -(-len(lines) * 20 // fixed.PDF_LINES)
    at = int(data.split(b"startxref\n")[1].split()[0])
    assert data[at : at + 4] == b"xref"


def test_pdf_texts(spark, tmp_path):
    import zlib

    lines = ["Section 1 (a) costs \\ 5", "", "last line"] * 30
    whole = pdf.extract_pdf(writers.render_pdf(lines))
    assert [x for x in whole.split("\n") if x] == [x for x in lines if x] and whole.count("\n\n") >= 1
    stream = zlib.compress(b"BT /F1 12 Tf 72 700 Td [(Hel) -20 (lo) -300 (wor\\154d)] TJ T* <feff00e9> Tj ET")
    inner = b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >> << /Type /Pages /Kids [3 0 R] /Count 1 >>"
    packed = b"3 0 2 50 " + inner
    first = len(b"3 0 2 50 ")
    made = b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n5 0 obj\n<< /Filter /FlateDecode /Length " + str(len(stream)).encode() + b" >>\nstream\n" + stream + b"\nendstream\nendobj\n"
    made += b"6 0 obj\n<< /Type /ObjStm /N 2 /First " + str(first).encode() + b" >>\nstream\n" + packed + b"\nendstream\nendobj\n%%EOF"
    assert pdf.extract_pdf(made) == "Hello world\n\u00e9"
    assert pdf.extract_pdf(b"%PDF") == pdf.extract_pdf(b"") == ""
    write(tmp_path / "files" / "a.pdf", made)
    assert [r["text"] for r in readers.read_documents(spark, f"file://{tmp_path}/files", extractors={"pdf": pdf.extract_pdf}).collect()] == ["Hello world\n\u00e9"]


def test_scratch_tables(spark):
    import os

    from corpusloom import runtime

    frame = runtime.stash(spark.range(3).toDF("x"), "numbers")
    assert sorted(r["x"] for r in frame.collect()) == [0, 1, 2]
    path = runtime._written(spark)[-1].removeprefix("file://")
    assert os.path.isdir(path)
    runtime.clear(spark)
    assert not os.path.exists(path) and not runtime._written(spark)


def test_ingest_acts_where_texts_have_years(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(i, text) for i, text in enumerate(("Decided in 1978 as said", "the code of 1850", "act", "plain words", "call 555-2058"))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in entry.queries()["ingest_acts"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(duck.execute(entry.oracle_sql()["ingest_acts"]).fetchall())
