"""Operators 11 to 13: session overlaps, lines in many documents, ball k-means."""

import collections
import datetime
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import ballkmeans, lines, overlaps
from tests.llm.conftest import rows_of

START = datetime.datetime(2024, 3, 30, 22)
HOUR = 3_600_000_000
EPOCH = datetime.datetime(1970, 1, 1)


def us(time):
    return (time - EPOCH) // datetime.timedelta(microseconds=1)


# --- 11 ---

CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, starts string, part int"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, value string, place int"
LINES = "sale_id long, line_no int, shipped_at timestamp_ntz, open string"


def brute_sessions(clicks):
    by_client = collections.defaultdict(list)
    for _, ts, client, kind, *_ in clicks:
        if ts is not None and client is not None:
            by_client[client].append((us(ts), kind == "purchase"))
    found = collections.defaultdict(list)
    for client, seen in by_client.items():
        seen.sort()
        runs = [[seen[0]]]
        for click in seen[1:]:
            if click[0] - runs[-1][-1][0] > 600_000_000:
                runs.append([])
            runs[-1].append(click)
        for run in runs:
            last = run[-1][0]
            found[client].append((run[0][0], last, any(buy for t, buy in run if t == last)))
    return found


def brute_overlaps(sales, shipped, clicks):
    sessions, out = brute_sessions(clicks), collections.Counter()
    totals = collections.defaultdict(lambda: [0, 0, 0])
    for row, (sale, client, sold, *_) in enumerate(sales):
        if client is None or sold is None:
            continue
        own = [at for s, _, at, *_ in shipped if s == sale and sale is not None]
        start, end = us(sold) // HOUR, float("inf") if None in own else max([us(sold), *map(us, own)]) // HOUR
        for first, last, is_open in sessions[client]:
            a, b = first // HOUR, float("inf") if is_open else last // HOUR
            if start <= b and a <= end:
                by_start = 0 if start < a else 1 if start == a else 2
                by_end = 0 if end < b else 1 if end == b else 2
                total = totals[row, sale, overlaps.RELATIONS[3 * by_start + by_end]]
                total[0] += 1
                total[1] = None if end == b == float("inf") else total[1] + min(end, b) - max(start, a) + 1
                total[2] += zlib.crc32(str(first).encode())
    for (_, sale, relation), (n, slots, crc) in totals.items():
        out[sale, relation, n, slots, crc] += 1
    return sorted(out.elements(), key=repr)


def shop(rng, n):
    def time(wide=200):
        return rng.choice([None, *[START + datetime.timedelta(microseconds=rng.choice([1, 60_000_000, 600_000_000, HOUR]) * rng.randint(0, wide))] * 15])

    client = lambda: rng.choice([None, 1, 1, 1, 1, 2, 3])
    clicks = [(i, time(), client(), rng.choice([None, "view", "view", "purchase"]), "x", 1) for i in range(n)]
    clicks += rng.sample(clicks, n // 10)
    sales = [(rng.choice([None, *[i] * 9]), client(), time(), "x", 1) for i in range(n)]
    shipped = [(rng.choice([None, rng.randint(0, n)]), i, rng.choice([time(), START + datetime.timedelta(hours=rng.randint(-50, 90))]), "x") for i in range(n)]
    return clicks, [*sales, *sales[:3]], shipped


def overlapped(spark, clicks, sales, shipped):
    return overlaps.session_overlaps(spark.createDataFrame(sales, SALES), spark.createDataFrame(shipped, LINES), spark.createDataFrame(clicks, CLICKS))


@pytest.mark.parametrize("seed,part,zone", [(1, 16_384, "UTC"), (2, 7, "America/New_York"), (3, 1, "UTC")])
def test_session_overlaps(spark, monkeypatch, seed, part, zone):
    monkeypatch.setattr(overlaps, "PART", part)
    clicks, sales, shipped = shop(random.Random(seed), 150)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [tuple(r) for r in overlapped(spark, clicks, sales, shipped).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(got, key=repr) == brute_overlaps(sales, shipped, clicks)


def test_session_overlaps_of_nothing(spark):
    clicks, sales, shipped = shop(random.Random(4), 20)
    assert overlapped(spark, [], sales, shipped).count() == overlapped(spark, clicks, [], shipped).count() == 0
    assert rows_of(overlapped(spark, clicks, sales, [])) == brute_overlaps(sales, [], clicks)


def test_sessions_are_cut_where_the_gap_is_longer(spark):
    at = lambda minutes, micro=0: START + datetime.timedelta(minutes=minutes, microseconds=micro)
    times = [at(0), at(9), at(19), at(19, 1), at(29, 1), at(39, 2), at(39, 2), at(300)]
    kinds = ["purchase", None, "view", "view", "purchase", "purchase", "view", "view"]
    got = overlaps.sessions(spark.createDataFrame([(i, t, 1, k, "", 0) for i, (t, k) in enumerate(zip(times, kinds))], CLICKS))
    assert rows_of(got) == sorted([(1, us(at(0)), us(at(29, 1)), True), (1, us(at(39, 2)), us(at(39, 2)), True), (1, us(at(300)), us(at(300)), False)], key=repr)


def test_times_with_a_zone_and_before_1970(spark):
    old = datetime.datetime(1969, 12, 31, 23, 50)
    clicks = [(1, old, 1, "view", "", 0), (2, old + datetime.timedelta(minutes=9), 1, "view", "", 0)]
    sales = [(5, 1, old - datetime.timedelta(hours=2), "", 0)]
    shipped = [(5, 1, datetime.datetime(1970, 1, 1), "")]
    assert rows_of(overlapped(spark, clicks, sales, shipped)) == brute_overlaps(sales, shipped, clicks) != []
    zoned = spark.createDataFrame(clicks, CLICKS).selectExpr("client_id", "kind", "CAST(ts AS timestamp) AS ts")
    assert overlaps.sessions(zoned).collect() == overlaps.sessions(spark.createDataFrame(clicks, CLICKS)).collect()


# --- 12 ---


def brute_lines(rows, min_chars, min_docs):
    key = lambda line: bytes(line.strip(" \t\n\x0b\x0c\r"), "utf-8").lower().decode()
    docs, last = collections.Counter(), {}
    place = lambda i: -(1 << 63) if i is None else i
    for i, text, *_ in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            docs[k] += 1
            last[k] = max(last.get(k, place(None)), place(i))
    out = []
    for i, text, *_ in rows:
        have = (text or "").split("\n")
        kept = [line for line in have if len(key(line)) < min_chars or docs[key(line)] < min_docs or last[key(line)] == place(i)]
        out.append((i, len(have), len(have) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=repr)


def some_lines(seed, n=120):
    rng = random.Random(seed)
    pool = ["", " ", "short", "é" * 39, "é" * 40, " " + "É" * 40, "A shared line that is longer than forty characters", "a SHARED line that is longer than forty characters \r", "x" * 40, *(f"{i} rare " * 9 for i in range(40))]
    text = lambda: rng.choice([None, *["\n".join(rng.choices(pool, k=rng.randint(0, 9)))] * 9])
    rows = [(rng.choice([None, i, i, i, i // 2]), text()) for i in range(n)]
    return [*rows, *rows[:4], (10**6, "\n".join(rng.choices(pool, k=30_000)))]


@pytest.mark.parametrize("seed,shard_keys,probes", [(1, 1 << 16, 1 << 16), (2, 4, 3), (3, 1, 1 << 16)])
def test_lines_of_many_documents(documents, monkeypatch, seed, shard_keys, probes):
    monkeypatch.setattr(lines, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(lines, "SLICE_PROBES", probes)
    rows = some_lines(seed)
    got = lines.dedup_lines(documents(rows))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "text"]
    assert rows_of(got) == brute_lines(rows, 40, 5)


def test_lines_where_nothing_is_frequent_or_there(documents):
    assert lines.dedup_lines(documents([])).count() == 0
    rows = [(1, None), (2, ""), (3, "y" * 50), (4, "y" * 50 + "\n")]
    assert rows_of(lines.dedup_lines(documents(rows))) == brute_lines(rows, 40, 5)
    assert rows_of(lines.dedup_lines(documents(rows), min_chars=1, min_docs=1)) == brute_lines(rows, 1, 1)


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(-(1 << 63), (1 << 63) - 1), st.integers(-3, 3)), max_size=300))
def test_perfect_hash(found):
    h1, h2 = (np.array([p[i] for p in sorted(found)], np.int64) for i in (0, 1))
    index = lines.PerfectHash.over(h1, h2)
    assert sorted(index.of(h1, h2).tolist()) == list(range(len(found)))
    others = index.of(h1, h2 + 10)
    assert ((others >= -1) & (others < max(1, len(found)))).all()


# --- 13 ---


def brute_kmeans(rows, clusters, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centers = [v for _, v in first[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, members in groups.items():
            centers[j] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *nearest(v)) for i, v in kept]
    by = collections.Counter()
    for _, d, j in found:
        by[j] += d
    return sorted(((i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster string, v int, distance string"


@pytest.mark.parametrize("scale,seed", [(0.01, 1), (1.0, 2), (900.0, 3)])
def test_ball_kmeans(spark, scale, seed):
    rng = np.random.default_rng(seed)
    hubs = rng.normal(size=(6, 4)) * 5
    # Coarse values make many equal distances.
    made = [(i if i % 17 else None, (np.round((hubs[i % 6] + rng.normal(size=4)) * 8) / 8 * scale).tolist()) for i in range(260)]
    made += made[:9] + [(300, None), (301, []), (302, [1.0, 2.0, None, 4.0]), (303, [1.0, float("nan"), 0.0, 0.0]), (304, [float("inf")] * 4), (305, [0.0] * 3)]
    got = ballkmeans.ball_kmeans(spark.createDataFrame([(i, v, "x", 1, "y") for i, v in made], VECTORS), clusters=9, rounds=4, dims=4)
    assert rows_of(got) == brute_kmeans(made, 9, 4, 4)


def test_ball_kmeans_of_little(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], VECTORS)
    empty = ballkmeans.ball_kmeans(frame([]), dims=4)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-5.5, 0.0])]
    assert rows_of(ballkmeans.ball_kmeans(frame(few), dims=2)) == brute_kmeans(few, 40, 5, 2)
    assert ballkmeans.ball_kmeans(frame([(1, [1e30, 0.0])]), dims=2).count() == 0
    large = [(i, [2.0**20 * (-1) ** i, float(i)]) for i in range(20)]
    assert rows_of(ballkmeans.ball_kmeans(frame(large), clusters=2, dims=2)) == brute_kmeans(large, 2, 5, 2)


def test_balls_leave_comparisons_out_and_change_nothing():
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(3000, 8)) + rng.integers(0, 8, size=(3000, 1)) * 10) * 100 // 1
    centers = v[:40] // 1
    cluster, _ = ballkmeans.nearest_of_all(v, centers)
    moved = centers + rng.integers(-20, 20, size=centers.shape)
    got, distance, compared = ballkmeans.reassigned(v, cluster, moved)
    want = ballkmeans.nearest_of_all(v, moved)
    assert (got == want[0]).all() and (distance == want[1]).all() and compared < 0.5 * len(v) * 39
