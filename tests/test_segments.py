"""Inverted lists, snapshots of segments, texts by id, fingerprints by file."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.functions.text import tokens
from corpusloom.operators import bm25, dense, evaluation, evidence, fingerprints, fusion, lifecycle, segments, texts
from corpusloom.plans import registry
from corpusloom.sources import readers
from corpusloom.streaming.incremental import incremental_index
from tests.test_operators import plain_bm25, small_chunks

CHUNK = "chunk_id string, category string, text string"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def scans(frame):
    """(files, rows) that the plan of ``frame`` has read, after running it."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    found, left = [0, 0], [plan]
    while left:
        node = left.pop()
        metrics = node.metrics()
        if node.nodeName().startswith("Scan parquet"):
            found[0] += metrics.get("numFiles").get().value()
            found[1] += metrics.get("numOutputRows").get().value()
        inner = [node.plan()] if "QueryStage" in node.nodeName() else []
        children = node.children()
        left += inner + [children.apply(i) for i in range(children.size())]
    return tuple(found)


# --- inverted lists ---


def mixed_chunks(spark, n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    rows = [(f"c{i:04}", rng.choice("xyyz"), " ".join(rng.choices(words, k=rng.randint(0, 14 if i % 40 else 60)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, CHUNK)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_pruned_search_is_exact(spark, monkeypatch, limit, tmp_path):
    monkeypatch.setattr(bm25, "SLICE_BITS", 3)
    monkeypatch.setattr(bm25, "BROADCAST_WEIGHTS", limit)
    rows, chunks = mixed_chunks(spark)
    index = bm25.build(chunks, category_col="category")
    index.save(f"{tmp_path}/sparse")
    index = bm25.SparseIndex.load(spark, f"{tmp_path}/sparse")
    asked = {1: "w1 w2 w9", 2: "w30", 3: "w1 w1 w44 nothing", 4: ""}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    modes = {"all": {}, "each": {"each": True}, "one": {"namespace": "y"}} if limit else {"all": {}}
    whole = {m: rows_of(bm25.search(index, queries, 5, **options)) for m, options in modes.items()}
    monkeypatch.setattr(bm25, "PRUNE_FROM", 0)
    for m, options in modes.items():
        assert rows_of(bm25.search(index, queries, 5, **options)) == whole[m]
    docs = {i: t.split() for i, _, t in rows}
    for q, text in asked.items():
        assert [i for q_, i, *_ in sorted(whole["all"], key=lambda r: (r[0], r[-1])) if q_ == q] == plain_bm25(docs, text.split(), 5)


def test_only_blocks_that_count_are_read_and_scored(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(bm25, "SLICE_BITS", 3)
    monkeypatch.setattr(bm25, "PRUNE_FROM", 0)
    # The best chunks for the word lie together; elsewhere it is once in long chunks.
    rows = [(f"c{i:04}", "x", " ".join(["tea"] * (9 if 80 <= i < 88 else 1) + [f"other{i}"] * (1 if 80 <= i < 88 else 30))) for i in range(400)]
    rows += [(f"d{i:04}", "x", f"word{i} more{i} text{i}") for i in range(900)]
    index = bm25.build(spark.createDataFrame(rows, CHUNK).coalesce(1))
    index.save(f"{tmp_path}/sparse")
    index = bm25.SparseIndex.load(spark, f"{tmp_path}/sparse")
    queries = spark.createDataFrame([(1, "tea")], "query_id long, text string")
    weights = bm25.query_weights(index, queries.selectExpr("query_id", "'tea' AS term", "1L AS qtf"), bm25.MERGED, False)
    asked = bm25.facts(weights)
    blocks = bm25.asked_blocks(index, weights, asked, bm25.MERGED, False)
    assert len(asked.buckets) == 1 and scans(blocks)[0] < scans(index.blocks)[0] / 4
    assert blocks.count() == 50
    kept, n = bm25.reachable(blocks, weights, asked.rows, None, 3)
    assert n < 5 and [r["id"] for r in bm25.search(index, queries, 3).orderBy("rank0").collect()] == ["c0080", "c0081", "c0082"]


# --- snapshots ---


def counting_encoder(spark, tmp_path):
    """An encoder that leaves a line for each text."""
    place = str(tmp_path / "encoded")

    def make():
        encode = dense.hashing_encoder()

        def counted(texts_):
            with open(place, "a") as f:
                f.write("x\n" * len(texts_))
            return encode(texts_)

        return counted

    def seen():
        try:
            with open(place) as f:
                n = len(f.readlines())
        except FileNotFoundError:
            n = 0
        open(place, "w").close()
        return n

    return make, seen


def test_a_text_is_encoded_once(spark, tmp_path):
    make, seen = counting_encoder(spark, tmp_path)
    rows = [(f"c{i}", "x", f"text number {i}") for i in range(1000)]
    path = f"file://{tmp_path}/index"
    lifecycle.build_index(spark.createDataFrame(rows, CHUNK), path, make_encoder=make)
    assert seen() == 1000
    changed = spark.createDataFrame([*rows[:500], ("c500", "x", "another text"), *rows[501:]], CHUNK).withColumn("jurisdiction", F.lit("IN"))
    lifecycle.build_index(changed, path, make_encoder=make)
    assert seen() == 1
    index = lifecycle.load_index(spark, path)
    assert index.vectors.count() == 1000 and "jurisdiction" in index.store.columns
    fresh = {r["id"]: r["embedding"] for r in dense.embed(changed, "chunk_id", "text").collect()}
    assert {r["id"]: r["embedding"] for r in index.vectors.collect()} == fresh
    lifecycle.build_index(changed.drop("jurisdiction"), path, make_encoder=make, model="nomic")
    assert seen() == 1000


def answers(index, asked):
    return rows_of(bm25.search(index.sparse, asked, 5)), rows_of(bm25.search(index.sparse, asked, 5, each=True)), rows_of(dense.search(index.vectors, dense.embed(asked, "query_id", "text").withColumnRenamed("id", "query_id"), 5))


def stats_of(index):
    return rows_of(index.sparse.term_stats.select("namespace", "term", "df", F.round("idf", 9))), rows_of(index.sparse.corpus_stats)


def test_updates_equal_a_fresh_build(spark, tmp_path):
    rows, _ = mixed_chunks(spark, 120)
    frame = lambda part: spark.createDataFrame(part, CHUNK)
    path, asked = f"file://{tmp_path}/index", spark.createDataFrame([(1, "w1 w2"), (2, "w3 fresh"), (3, "w30 w5")], "query_id long, text string")
    lifecycle.update_index(frame(rows[:60]), path)
    lifecycle.update_index(frame(rows[60:]), path)
    replaced = [(i, c if n % 2 else "moved", f"{t} fresh words") for n, (i, c, t) in enumerate(rows[5:120:7])]
    gone = [r[0] for r in rows[3:110:11]] + ["never there"]
    lifecycle.update_index(frame(replaced), path, deleted=spark.createDataFrame([(g,) for g in gone], "id string"))
    lifecycle.update_index(frame([(rows[0][0], "x", "w1 once more"), ("new", "z", "w2 w2")]), path)
    last = lifecycle.update_index(frame([]), path, deleted=spark.createDataFrame([("new",)], "id string"))
    final = {r[0]: r for r in rows} | {r[0]: r for r in replaced if r[0] not in gone}
    # What is replaced and deleted in one update is there: deletions are of what was there before.
    final = {i: r for i, r in final.items() if i not in gone} | {r[0]: r for r in replaced} | {rows[0][0]: (rows[0][0], "x", "w1 once more")}
    fresh = frame(list(final.values()))
    assert last == lifecycle.manifest_of(fresh, "hashing", False)
    lifecycle.build_index(fresh, f"file://{tmp_path}/fresh")
    got, want = lifecycle.load_index(spark, path), lifecycle.load_index(spark, f"file://{tmp_path}/fresh")
    assert stats_of(got) == stats_of(want) and answers(got, asked) == answers(want, asked)
    assert rows_of(got.store) == rows_of(want.store) and rows_of(got.texts.rows().select("chunk_id", "text")) == rows_of(fresh.select("chunk_id", "text"))
    # Four were merged, then one more came.
    assert len(got.snapshot.segments) == 2
    known = rows_of(got.texts.lookup(spark.createDataFrame([(i,) for i in [rows[5][0], rows[3][0], rows[0][0], "new"]], "id string")).select("chunk_id", "text"))
    assert known == sorted((i, final[i][2]) for i in [rows[5][0], rows[3][0], rows[0][0], "new"] if i in final)
    with pytest.raises(ValueError, match="twice"):
        lifecycle.update_index(frame([("a", "x", "y"), ("a", "x", "z")]), path)
    with pytest.raises(lifecycle.IndexStaleError):
        lifecycle.update_index(frame([("a", "x", "y")]), path, model="other")


def test_segments_stay_few():
    def made(sizes):
        parts = ()
        for n in sizes:
            parts = (*parts, segments.Segment("s", n, 1, 0, (), {}))
            while (start := segments.to_merge(parts)) is not None:
                parts = (*parts[:start], segments.Segment("m", sum(s.chunks for s in parts[start:]), 1, 0, (), {}))
        return [s.chunks for s in parts]

    assert made([10] * 3) == [10] * 3 and made([10] * 4) == [40]
    many = made([900] * 1000)
    assert sum(many) == 900_000 and len(many) <= 3 * 8 and made([10**6, 5, 5]) == [10**6, 5, 5]


def test_a_reader_keeps_its_snapshot(spark, tmp_path):
    chunks, path = small_chunks(spark), f"file://{tmp_path}/index"
    lifecycle.build_index(chunks, path)
    reader = lifecycle.load_index(spark, path)
    asked = spark.createDataFrame([(1, "number 7")], "query_id long, text string")
    before = answers(reader, asked)
    lifecycle.build_index(chunks.withColumn("text", F.concat(F.lit("quite other "), "text")), path)
    assert answers(reader, asked) == before and answers(lifecycle.load_index(spark, path), asked) != before
    assert [s.number for s in (reader.snapshot, lifecycle.load_index(spark, path).snapshot)] == [1, 2]
    assert segments.vacuum(spark, path) == [] and answers(lifecycle.load_index(spark, path), asked) != before
    gone = segments.vacuum(spark, path, grace_s=-5)
    assert reader.snapshot.segments[0].name in gone and lifecycle.load_index(spark, path).vectors.count() == 15


def test_of_two_builders_one_is_told(spark, tmp_path, monkeypatch):
    chunks, path = small_chunks(spark), f"file://{tmp_path}/index"
    plain = segments.write_statistics

    def slow(*args):
        # Another builder makes its snapshot before this one.
        monkeypatch.setattr(segments, "write_statistics", plain)
        lifecycle.build_index(chunks.limit(12), path)
        return plain(*args)

    monkeypatch.setattr(segments, "write_statistics", slow)
    with pytest.raises(lifecycle.segments.ConcurrentBuildError):
        lifecycle.build_index(chunks, path)
    assert lifecycle.load_index(spark, path).manifest.chunk_count == 12
    assert lifecycle.build_index(chunks, path).chunk_count == 15 and lifecycle.load_index(spark, path).snapshot.number == 2


def test_a_build_that_is_broken_off_changes_nothing(spark, tmp_path, monkeypatch):
    chunks, path = small_chunks(spark), f"file://{tmp_path}/index"
    first = lifecycle.build_index(chunks, path)

    def broken(*args, **options):
        raise OSError("lost")

    for step in ("write_blocks", "embed_new", "write_statistics", "commit"):
        with monkeypatch.context() as patch:
            patch.setattr(segments, step, broken)
            with pytest.raises(OSError):
                lifecycle.build_index(chunks.limit(12), path)
        assert lifecycle.load_index(spark, path, first).vectors.count() == 15
    lifecycle.build_index(chunks.limit(12), path)
    assert lifecycle.load_index(spark, path).vectors.count() == 12


def test_create_once(spark, tmp_path):
    place = f"file://{tmp_path}/sub/record"
    assert [runtime.create_once(spark, place, text) for text in ("one é", "two")] == [True, False]
    assert runtime.read_text(spark, place) == "one é" and [n for n, _ in runtime.list_names(spark, f"file://{tmp_path}/sub")] == ["record"]
    assert runtime.list_names(spark, f"file://{tmp_path}/none") == []


# --- streams of chunk files ---


def test_a_stream_of_updates(spark, tmp_path):
    source, path = tmp_path / "chunks", f"file://{tmp_path}/inc"
    source.mkdir()
    schema = f"{CHUNK}, deleted boolean"

    def arrive(name, *rows):
        (source / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        incremental_index(spark, f"file://{source}", path, schema=schema, files_per_batch=1).awaitTermination()

    arrive("1.json", {"chunk_id": "a", "category": "x", "text": "red tea"}, {"chunk_id": "b", "category": "x", "text": "green tea"})
    arrive("2.json", {"chunk_id": "c", "category": "y", "text": "tea"}, {"chunk_id": "a", "deleted": True})
    arrive("3.json", {"chunk_id": "b", "category": "y", "text": "coffee"})
    index = lifecycle.load_index(spark, path)
    assert rows_of(index.texts.rows().select("chunk_id", "text")) == [("b", "coffee"), ("c", "tea")] and index.snapshot.batch == 2
    assert dict(rows_of(index.sparse.term_stats.where("namespace = '_merged'").select("term", "df"))) == {"coffee": 1, "tea": 1}
    # A batch that is there already is passed over.
    again = spark.createDataFrame([("z", "x", "more")], CHUNK)
    lifecycle.update_index(again, path, batch=2)
    assert lifecycle.load_index(spark, path).snapshot == index.snapshot
    (source / "4.json").write_text('{"chunk_id": "d", "category": "x", "te\n')
    with pytest.raises(Exception, match="4.json|MALFORMED"):
        incremental_index(spark, f"file://{source}", path, schema=schema).awaitTermination()
    assert lifecycle.load_index(spark, path).snapshot == index.snapshot


def test_lines_that_are_no_chunks(spark, tmp_path):
    good = '{"chunk_id": "a", "category": "x", "text": "t"}\n \t\n\n'
    for name, bad in {"cut": '{"chunk_id": "b", "cat', "without": '{"text": "b"}', "empty": '{"chunk_id": ""}', "list": "[1, 2"}.items():
        (tmp_path / name).write_text(good + bad + "\n")
        for use in (lambda rows: rows.collect(), lambda rows: rows.select("chunk_id").collect(), lambda rows: rows.count()):
            with pytest.raises(Exception, match=f"{name}: "):
                use(readers.read_chunks(spark, f"file://{tmp_path}/{name}"))
    (tmp_path / "good").write_text(good)
    assert [r["chunk_id"] for r in readers.read_chunks(spark, f"file://{tmp_path}/good").collect()] == ["a"]
    (tmp_path / "twice").write_text(good + good)
    rows = readers.read_chunks(spark, f"file://{tmp_path}/twice")
    with pytest.raises(ValueError, match="twice: a"):
        readers.require_unique(rows)


# --- texts by id ---


def test_lookups_read_as_much_of_ten_times_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "FOLDER_TEXTS", 256)
    monkeypatch.setattr(texts, "GROUP_BYTES", 1 << 14)
    read = {}
    for n in (2000, 20_000):
        path = f"{tmp_path}/texts{n}"
        rows = spark.range(n).select(F.concat(F.lit("c/"), "id").alias("chunk_id"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text"))
        folders = texts.folders_for(n)
        texts.write_texts(rows, path, folders)
        store = texts.TextStore([(0, folders, spark.read.parquet(path))])
        ids = spark.createDataFrame([("c/5",), ("c/1999",), ("c/5",), ("none",)], "id string")
        found = store.lookup(ids)
        assert sorted(r["chunk_id"] for r in found.collect()) == ["c/1999", "c/5"]
        files, count = scans(found)
        assert files <= 3 and count <= 3 * 256
        read[n] = files
        many = spark.range(1500).select(F.concat(F.lit("c/"), "id").alias("id"))
        assert store.lookup(many).count() == 1500
        assert evidence.lookup(ids.withColumn("rank", F.monotonically_increasing_id()), store, "rank").count() == 2
    assert read[20_000] <= read[2000] + 1


# --- fingerprints by file ---


def test_new_files_alone_are_read(spark, tmp_path):
    source = str(tmp_path / "in put")
    spark.range(100).selectExpr("id", "concat('t', id) AS text").repartition(3).write.parquet(source)
    asked = []

    def read(files):
        asked.append(len(files))
        return spark.read.parquet(*files)

    known = fingerprints.of_files(spark, source, read)
    assert fingerprints.of_parts(known) == fingerprints.of_rows(spark.read.parquet(source)) and asked == [3]
    known = runtime.stash(known, "files")
    assert fingerprints.of_parts(fingerprints.of_files(spark, source, read, known)) == fingerprints.of_parts(known) and asked == [3]
    spark.range(100, 120).selectExpr("id", "concat('t', id) AS text").coalesce(1).write.mode("append").parquet(source)
    spark.range(0).selectExpr("id", "concat('t', id) AS text").coalesce(1).write.mode("append").parquet(source)
    more = runtime.stash(fingerprints.of_files(spark, source, read, known), "files")
    assert fingerprints.of_parts(more) == fingerprints.of_rows(spark.read.parquet(source)) and asked == [3, 2]
    path = f"file://{tmp_path}/index"
    as_chunks = lambda files: spark.read.parquet(*files).selectExpr("id AS chunk_id", "text", "'x' AS category")
    first = lifecycle.build_from_files(spark, source, as_chunks, path)
    assert first == lifecycle.manifest_of(as_chunks([source]), "hashing", False) == lifecycle.build_from_files(spark, source, lambda files: 1 / 0, path)
    spark.range(120, 125).selectExpr("id", "concat('t', id) AS text").coalesce(1).write.mode("append").parquet(source)
    assert lifecycle.build_from_files(spark, source, as_chunks, path).chunk_count == 125 == lifecycle.load_index(spark, path).texts.rows().count()


# --- dense tiles ---


def test_many_queries_meet_tiles(spark, monkeypatch):
    rng = random.Random(5)
    vec = lambda: [float(rng.randint(-2, 2)) for _ in range(4)]
    vectors = spark.createDataFrame([(f"v{i}", vec() if i % 50 else None, rng.choice(["x", "y", None])) for i in range(300)], "id string, embedding array<double>, category string")
    queries = spark.createDataFrame([(i, vec()) for i in range(90)], "query_id long, embedding array<double>")
    want = {by: rows_of(dense.search(vectors, queries, 7, by=by)) for by in (None, "category")}
    all_ = {r["id"]: r["embedding"] for r in vectors.collect() if r["embedding"]}
    for r in queries.limit(5).collect():
        best = sorted((-sum(a * b for a, b in zip(r["embedding"], v)), i) for i, v in all_.items())[:7]
        assert [(-s, i) for i, s in [(x[1], x[2]) for x in sorted(want[None], key=lambda x: x[-1]) if x[0] == r["query_id"]]] == best
    monkeypatch.setattr(dense, "QUERY_BLOCK", 20)
    for by in (None, "category"):
        assert rows_of(dense.search(vectors, queries, 7, by=by)) == want[by]


# --- work that grows with the texts ---


def test_blocks_are_written_where_they_are_made(spark, tmp_path):
    _, chunks = mixed_chunks(spark)
    bm25.write_blocks(bm25.make_blocks(chunks.repartition(3), category_col="category"), f"{tmp_path}/blocks")
    assert len(list((tmp_path / "blocks" / f"bucket={bm25.LISTS}").glob("*.parquet"))) == 3


def test_a_build_sizes_its_batches_itself(spark, tmp_path):
    _, chunks = mixed_chunks(spark, 20)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    lifecycle.build_index(chunks, f"{tmp_path}/index")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_a_task_gives_on_little_but_the_best(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(bm25, "SLICE_BITS", 3)
    monkeypatch.setattr(bm25, "QUERY_ROWS", 2)
    monkeypatch.setattr(bm25, "TERM_ROWS", 2)
    rows, chunks = mixed_chunks(spark, 600)
    lifecycle.update_index(chunks.where("chunk_id < 'c0500'"), f"{tmp_path}/index")
    lifecycle.update_index(chunks.where("chunk_id >= 'c0480'"), f"{tmp_path}/index", deleted=spark.createDataFrame([(f"c{i:04}",) for i in range(0, 400, 3)], "id string"))
    index = lifecycle.load_index(spark, f"{tmp_path}/index").sparse
    queries = spark.createDataFrame([(i, f"w{i} w1 w2 w{2 * i} w1") for i in range(1, 8)], "query_id long, text string")
    wanted = queries.selectExpr("query_id", "explode(split(text, ' ')) AS term").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    for options in ({"each": False, "namespace": bm25.MERGED}, {"each": True, "namespace": bm25.MERGED}, {"each": False, "namespace": "y"}):
        weights = bm25.query_weights(index, wanted, **options)
        asked = bm25.facts(weights)
        blocks = bm25.asked_blocks(index, weights, asked, options["namespace"], options["each"])
        by = ("query_id", "category") if options["each"] else ("query_id",)
        plain = bm25.scored(blocks, weights, asked.rows, index.gone).select("query_id", "id", "category", "score")
        found = bm25.scored_by_slice(index, blocks, weights, asked, options["namespace"], options["each"], 3)
        assert rows_of(bm25.top(found, 3, by)) == rows_of(bm25.top(plain, 3, by))
        assert found.count() < plain.count()


def test_frequencies_read_no_lists(spark, tmp_path):
    _, chunks = mixed_chunks(spark)
    bm25.write_blocks(bm25.make_blocks(chunks, category_col="category"), f"{tmp_path}/blocks")
    found = bm25.frequencies(spark.read.parquet(f"{tmp_path}/blocks"))
    assert "ids:" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_end_at_what_tokens_takes_for_white_space(spark):
    rows = [f"{c}A{c}bİ{c}" for c in map(chr, range(0x3001)) if c.isspace()] + ["", " ", "ΣAΣ x", "​­z"]
    want = [list(r[0]) for r in spark.createDataFrame([(t,) for t in rows], "t string").select(tokens(F.col("t"))).collect()]
    words, lengths = bm25.split_words(pa.array([r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(F.lower("t")).collect()]))
    ends = lengths.cumsum()
    assert [words[int(e - n) : int(e)].to_pylist() for e, n in zip(ends, lengths)] == want
    vectors = dense.hashing_encoder()(rows)
    for text, vector in zip(rows, vectors):
        plain = [0.0] * dense.HASH_DIM
        for word in text.lower().split():
            plain[dense.hash_bucket(word)] += 1
        size = sum(x * x for x in plain) ** 0.5 or 1
        assert list(vector) == [x / size for x in plain]


def test_lists_of_categories_are_read_once(spark, tmp_path):
    rows = [(1, "x", "a", 0, 0.5), (1, "y", "b", 0, 0.7), (1, "y", "a", 1, 0.6), (1, "x", "c", 1, 0.4), (2, "x", "c", 0, 0.1)]
    spark.createDataFrame(rows, "query_id long, category string, id string, rank0 int, score double").write.parquet(f"{tmp_path}/hits")
    found = fusion.federate(spark.read.parquet(f"{tmp_path}/hits"))
    assert [(r["query_id"], r["id"], r["category"], r["place"]) for r in found.orderBy("query_id", "place").collect()] == [(1, "a", "y", 0), (1, "b", "y", 1), (1, "c", "x", 2), (2, "c", "x", 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_row_groups_stay_small(spark, tmp_path):
    rng = random.Random(1)
    # Short rows first: the writer would look again after thousands of the long ones.
    rows = [(i, "a" if i < 3000 else "".join(rng.choices("abcdefghijklmnop", k=1500))) for i in range(9000)]
    texts.write_texts(spark.createDataFrame(rows, "chunk_id long, text string"), f"{tmp_path}/texts", 1)
    sizes = [f.row_group(i).total_byte_size for f in (pq.ParquetFile(p).metadata for p in (tmp_path / "texts").rglob("*.parquet")) for i in range(f.num_row_groups)]
    assert max(sizes) < 2 * texts.GROUP_BYTES


def test_totals_of_terms_are_those_of_the_postings(spark, tmp_path):
    _, chunks = mixed_chunks(spark, 60)
    by_postings = lambda index: rows_of(index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")))
    lifecycle.update_index(chunks, f"{tmp_path}/index")
    index = lifecycle.load_index(spark, f"{tmp_path}/index").sparse
    assert rows_of(index.term_totals) == by_postings(index) and "explode" not in index.term_totals._jdf.queryExecution().optimizedPlan().toString()
    lifecycle.update_index(chunks.where("chunk_id < 'c0007'").withColumn("text", F.lit("w1 new")), f"{tmp_path}/index")
    index = lifecycle.load_index(spark, f"{tmp_path}/index").sparse
    assert index.gone is not None and rows_of(index.term_totals) == by_postings(index)


def test_more_chunk_files_of_larger_tables(spark, monkeypatch, tmp_path):
    spark.range(50_000).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    source = f"file://{tmp_path}/documents.parquet"
    assert registry.chunk_files(spark, source) == 4
    monkeypatch.setattr(registry, "CHUNK_FILE_BYTES", 10_000)
    assert registry.chunk_files(spark, source) >= 6 and registry.chunk_files(spark, source) % 2 == 0


def test_a_slice_goes_on_over_batches():
    def gathered(most):
        batches = [pa.RecordBatch.from_pydict({"id": [3 * i, 3 * i + 1, 3 * i + 2], "category": ["x", None, "y"], "h": [1, 2, 3], "text": ["tea rare%d" % i, "", "tea tea"], "task": pa.array([2] * 3, pa.int32())}) for i in range(4)]
        return pa.Table.from_batches(bm25._gather(iter(batches), 3, most)).to_pylist()

    rows = gathered(1 << 20)
    # Eight chunks, then four: slices end where the number does, not where a batch does.
    assert {r["slice"] for r in rows} == {2 << 40, (2 << 40) + 1}
    tea = [(r["slice"] & 1, r["category"], r["ids"], r["tfs"], r["dls"]) for r in rows if r["term"] == "tea"]
    assert sorted(tea) == [(0, "x", [0, 3, 6], [1, 1, 1], [2, 2, 2]), (0, "y", [2, 5], [2, 2], [2, 2]), (1, "x", [9], [1], [2]), (1, "y", [8, 11], [2, 2], [2, 2])]
    assert sorted(i for r in rows if r["term"] is None for i in r["ids"]) == list(range(12))
    # A slice of few bytes is one batch.
    assert len({r["slice"] for r in gathered(1)}) >= 4


def test_a_single_segment_has_the_statistics(spark, tmp_path):
    _, chunks = mixed_chunks(spark, 60)
    lifecycle.update_index(chunks.where("chunk_id < 'c0030'"), f"{tmp_path}/index")
    assert not (tmp_path / "index" / "statistics").exists()
    lifecycle.update_index(chunks.where("chunk_id >= 'c0030'"), f"{tmp_path}/index")
    assert (tmp_path / "index" / "statistics").exists()
    index = lifecycle.load_index(spark, f"{tmp_path}/index").sparse
    whole = bm25.build(chunks, category_col="category")
    of = lambda rows: rows_of(rows.select("namespace", "term", "df", F.round("idf", 9)))
    assert of(index.term_stats) == of(whole.term_stats)
    # Frequencies of categories and of all together come from one shuffle.
    plan = bm25.totals(bm25.frequencies(whole.blocks))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_an_index_of_an_older_form_is_told(spark, tmp_path):
    lifecycle.update_index(mixed_chunks(spark, 20)[1], f"{tmp_path}/index")
    record = tmp_path / "index" / "snapshots" / f"{1:010d}.json"
    held = json.loads(record.read_text())
    del held["means"]
    record.unlink()
    (record.parent / f".{record.name}.crc").unlink(missing_ok=True)
    record.write_text(json.dumps(held))
    with pytest.raises(ValueError, match="older form"):
        lifecycle.load_index(spark, f"{tmp_path}/index")


def test_an_encoder_remembers_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(dense, "KNOWN_WORDS", 2)
    encode = dense.hashing_encoder()
    first = encode(["a b c d a", "e"])
    assert len(encode.__closure__) and [c.cell_contents for c in encode.__closure__ if isinstance(c.cell_contents, dict)][0].keys() == {b"a", b"b"}
    assert (encode(["a b c d a", "e"]) == first).all() and first[0].argmax() == dense.hash_bucket("a")


def test_relevant_pairs_are_found_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id long, id string").write.parquet(f"{tmp_path}/pairs")
    hits = spark.createDataFrame([(1, "a", 0), (1, "x", 1), (2, "y", 0)], "query_id long, id string, rank0 int")
    found = evaluation.metrics(hits, hits, spark.read.parquet(f"{tmp_path}/pairs"), (1, 2))
    assert not [f for f in found.inputFiles() if f"{tmp_path}/pairs" in f]
    assert rows_of(found) == [(1, 1, 1.0, 0.5, 1.0, 0.5), (1, 2, 0.5, 0.5, 1.0, 0.5), (2, 1, 0.0, 0.0, 0.0, 0.0), (2, 2, 0.0, 0.0, 0.0, 0.0)]


def test_a_response_reads_the_texts_once(spark):
    found = registry.chat_response(spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "documents.parquet" in f]
