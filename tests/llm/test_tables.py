"""Operators across documents: mix, repeats, neighbours, near-duplicates, archives, packing, pipeline."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import components, mixing, neighbours, packing, repeats, similar, simhash, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t", "a", "é 😀", "Ab cD", "aB Cd"]


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))


# --- mix ---


def water_level(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    for _ in range(len(names) + 1):
        share = left / max(1e-300, sum(weight[s] for s in open_)) if open_ else 0
        full = {s for s in open_ if weight[s] * share > 2 * sizes[s]}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
        if not full:
            for s in open_:
                target[s] = weight[s] * share
            break
    return target


def test_mix(documents):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["s0", "s0", "s0", "s1", "s2", "é", None])) for i in range(300)]
    rows += [(1000 + i, t, None, "s1") for i, t in enumerate(ODD)] + [(3000, "again again", "en", "s0")] * 3 + [(None, "no id", "en", "s2"), (2000, "", "en", "empty")]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, *_, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    targets = water_level(sizes)
    source_of = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(taken[s] == int(targets[s] + 1e-6) for s in sizes)
    again = mixing.mix(documents(rows[::-1])).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix(documents([])).count() == 0


def test_mixed_documents_have_what_is_taken(documents):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 60)) + rng.choice(["", " ", "\n"]), "en", f"s{i % 4}") for i in range(120)] + [(500, None, "en", "s1"), (501, " \n", "en", "s1"), (7, "twice here", "en", "s1"), (7, "twice here", "en", "s1")]
    docs = documents(rows)
    plan = collections.Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"]] += r["taken"]
    out = mixing.mixed_documents(docs).collect()
    got = collections.Counter()
    texts = collections.defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    for r in out:
        got[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
        assert any((t or "").startswith(r["text"] or "") for t in texts[r["doc_id"]]) and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert +got == +plan and {500, 501} <= {r["doc_id"] for r in out}
    assert out[0].__fields__ == docs.columns


def test_sources_that_share_ids_get_their_own_words(documents):
    rng = random.Random(20)
    rows = [(i, " ".join(["w"] * 10), "en", s) for s, n in (("a", 40), ("b", 20), ("c", 100)) for i in range(n)] + [(5, " ".join(["w"] * 10), "en", None)] * 3
    rng.shuffle(rows)
    docs = documents(rows)
    plan, got = collections.Counter(), collections.Counter()
    for r in mixing.mix(docs).collect():
        plan[r["source_size"]] += r["taken"]
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
    assert {s: got[s] for s in "abc"} == {"a": plan[400], "b": plan[200], "c": plan[1000]}
    assert abs(got[None] - plan[30]) < 3
    many = mixing.mixed_documents(docs).count()
    mixing_limit, mixing.BROADCAST_SOURCES = mixing.BROADCAST_SOURCES, 1
    try:
        assert mixing.mixed_documents(docs).count() == many
    finally:
        mixing.BROADCAST_SOURCES = mixing_limit


# --- repeats ---


def brute_repeats(rows, length, keep):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count, first = collections.Counter(), {}
    for i, b in sorted(texts, key=lambda r: r[0]):
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] += 1
            first.setdefault(b[s : s + length], (i, s))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if count[w] > 1 and (keep == "none" or first[w] != (i, s)):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [1, 3, repeats.HOT_SEGMENTS])
def test_repeats(documents, monkeypatch, keep, hot):
    rng = random.Random(3)
    shared = [prose(rng, 60) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            a = rng.randint(0, 100)
            parts += [piece[a : a + rng.randint(20, 300)], prose(rng, rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "ab" * 400), (201, "ab" * 300 + "é" * 200), (202, rows[3][1]), (203, rows[3][1][5:]), (204, "x" * 49 + "y"), (205, "z" * 100)]
    got = repeats.remove_repeats(documents(rows), keep, length=50, gram=16, hot_segments=hot)
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute_repeats(rows, 50, keep)
    kept = {r["doc_id"]: bytes(r["kept"]) for r in got.collect()}
    assert hashlib.sha256(kept[202]).hexdigest() == {r[0]: r[4] for r in brute_repeats(rows, 50, keep)}[202]


def test_repeats_of_repeated_rows_nulls_and_nothing(documents):
    text = prose(random.Random(4), 30)
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "")]
    got = sorted((tuple(r)[:4] for r in repeats.remove_repeats(documents(rows), length=50, gram=16).collect()), key=repr)
    n = len(text)
    assert got == sorted([(1, n, n, 1), (1, n, n, 1), (None, n, n, 1), (2, 0, 0, 0), (3, 0, 0, 0)], key=repr)
    assert repeats.remove_repeats(documents([])).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated_spans(documents([]), keep="last")


@pytest.mark.parametrize("keep", ["none", "first"])
def test_one_passage_in_thousands_of_texts(documents, keep):
    rng = random.Random(30)
    passage = prose(rng, 40)
    rows = [(i, prose(rng, 6) + " " + passage[: rng.choice([len(passage), 120])] + " " + prose(rng, 6)) for i in range(2500)]
    rows += [rows[7]] * 40 + [(None, rows[9][1]), (9000, None), (9001, passage), (9002, passage * 3)]
    got = repeats.remove_repeats(documents(rows), keep, length=50, gram=16, hot_segments=64, texts=False).collect()
    want = brute_repeats([(-1 if i is None else i, t) for i, t in rows], 50, keep) if keep == "none" else None
    if want:
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got)) == want
    else:
        # Repeated rows are one document; with the null id last.
        once = list(dict.fromkeys((10**9 if i is None else i, t) for i, t in rows))
        assert sorted({(10**9 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got)}) == brute_repeats(once, 50, keep)


def test_long_texts_are_cut_exactly(monkeypatch):
    rng = random.Random(5)
    data = prose(rng, 600).encode()
    whole = repeats.segments(np.frombuffer(data, np.uint8), np.array([len(data)]), 50, 16)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 100)
    cut = repeats.pieces([data], 50)
    starts = set()
    for _, at, piece in cut:
        s, n, *_ = repeats.segments(np.frombuffer(piece, np.uint8), np.array([len(piece)]), 50, 16)
        starts |= {(at + a, k) for a, m in zip(s, n) for k in range(at + a, at + a + m)}
    assert sorted(k for _, k in starts) == list(range(len(data) - 49)) == sorted(int(a) + k for a, m in zip(whole[0], whole[1]) for k in range(m))


def test_repeats_in_a_very_long_text(documents):
    rng = random.Random(16)
    passage = prose(rng, 60)
    text = passage + rng.randbytes(2_500_000).hex() + passage
    n = len(passage.encode())
    got = {r["doc_id"]: tuple(r)[1:4] for r in repeats.remove_repeats(documents([(1, text), (2, "y" + passage[3:])]), texts=False).collect()}
    assert got == {1: (len(text), 2 * n, 2), 2: (n - 2, n - 3, 1)}


def test_longest_previous_factors():
    rng = random.Random(6)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(300)).encode(), np.uint8)
    starts = np.sort(np.array(rng.sample(range(300 - 24), 150)))
    previous, later = repeats.SuffixOrder(data, starts, 24).factors()

    def common(i, j):
        k = 0
        while k < 24 and data[i + k] == data[j + k]:
            k += 1
        return k

    for k, i in enumerate(starts):
        assert previous[k] == max([common(i, j) for j in starts[:k]], default=0)
        assert later[k] == max([common(i, j) for j in starts[k + 1 :]], default=0)


# --- neighbours ---


def brute_nearest(rows, k):
    data = [(i, np.array(v, "f4").astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in data:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in data if i != q)[:k]
    return out


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "'x' AS bucket", "2 AS rank", "3 AS score", "4 AS ids")


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    rows = [(int(i), (centres[i % 30] + 0.3 * rng.normal(size=16)).astype("f4").tolist()) for i in range(3000)]
    rows += [(3001 + i, rows[0][1]) for i in range(40)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, 2.0]), (None, rows[1][1]), (5400, [None] * 16)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(embeddings(spark, rows), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = brute_nearest([r for r in rows if r[1] is None or len(r[1]) == 16], 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert got[0] == [(0.0, 3001 + i) for i in range(10)]
    scores = {(q, i): s for q in want for s, i in want[q]}
    assert all(s == pytest.approx(scores[q, i], abs=1e-12) for q in got for s, i in got[q] if (q, i) in scores)


def test_few_and_no_neighbours(spark):
    few = neighbours.nearest(embeddings(spark, [(0, [1.0, 0.0]), (1, [-9.0, 5.0]), (2, [3.0, -7.0])]), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 2), (0, 1)]
    assert neighbours.nearest(embeddings(spark, [(0, [0.0, 0.0])]), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.nearest(embeddings(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_large_blocks_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(size=6).astype("f4").tolist()) for i in range(600)]
    got = neighbours.nearest(embeddings(spark, rows), F.col("vec_id") % 100 == 0).collect()
    want = brute_nearest(rows, 10)
    assert len(got) == 60 and sum((r["query_id"], r["vec_id"]) in {(q, i) for q in want for _, i in want[q]} for r in got) >= 54


# --- near-duplicates ---


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, linked):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(keys))]


def test_near_duplicates(documents):
    rng = random.Random(9)
    rows = []
    for i in range(25):
        words = prose(rng, rng.choice([5, 30, 400])).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(["New", "other", ""])
            rows.append((len(rows), " ".join(words)))
    rows += [(900 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1]), (None, rows[4][1]), (None, "lonely words with nobody near them")]
    got = simhash.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    keys = [plain_fingerprint(t) for _, t in rows]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(i), f"{k:016x}") for (i, _), k in zip(rows, keys))
    roots = plain_components(keys, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted((str(i), str(least.get(root))) for (i, _), root in zip(rows, roots))
    assert simhash.near_duplicates(documents([])).count() == 0


def test_parted_places_lose_no_candidates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for pair in range(60):
        bits = rng.integers(0, 2, similar.BITS).astype(np.uint8)
        for k in range(2):
            rows.append((2 * pair + k, np.packbits(bits ^ (rng.random(similar.BITS) < 0.05 * k).astype(np.uint8), bitorder="little").view(np.int64).tolist()))
    table = spark.createDataFrame(rows, "vertex long, bits array<long>")
    whole = {tuple(sorted(r)) for r in similar.candidates(table).collect()}
    assert whole == {(2 * pair, 2 * pair + 1) for pair in range(60)}
    for leaders in (0, 1):
        monkeypatch.setattr(similar, "PLACE_ROWS", 1)
        monkeypatch.setattr(similar, "LEADERS", leaders)
        assert {tuple(sorted(r)) for r in similar.candidates(table).collect()} == whole


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) if a or b else True


def altered(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


@pytest.mark.parametrize("block, place", [(512, 100_000), (3, 100_000), (512, 40)])
def test_near_copies_by_similarity(documents, monkeypatch, block, place):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "PLACE_ROWS", place)
    monkeypatch.setattr(similar, "LEADERS", 16)
    rng = random.Random(21)
    texts = []
    for n in (6, 9, 30, 60, 60, 150, 150, 400, 400, 3000):
        first = last = prose(rng, n)
        texts.append(first)
        for k in range(8):
            # Around the limit of 0.8, and chains that lead away from the first.
            texts.append(altered(rng, first, rng.randint(1, max(1, n // 40))))
            last = altered(rng, last, max(1, n // 60))
            texts.append(last)
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(900 + i, t) for i, t in enumerate(ODD)] + [(3, texts[3]), (3, texts[3]), (None, texts[4]), (None, "lonely words with nobody near them"), (5000, texts[0].upper())]
    sets = [shingle_set(t) for _, t in rows]
    roots = plain_components(sets, alike)
    first = {}
    for (i, t), root in zip(rows, roots):
        key = (i is None, i or 0)
        first[root] = min(first.get(root, (True, 10**9)), key)
    docs = documents(rows)
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert got == sorted(first.values())


def test_near_copies_of_nothing_and_of_all(documents):
    assert similar.keep_one(documents([])).count() == 0
    text = prose(random.Random(22), 50)
    assert [r["doc_id"] for r in similar.keep_one(documents([(i, text) for i in (5, 3, 9, 3)])).collect()] == [3]
    assert {r["doc_id"] for r in similar.keep_one(documents([(1, None), (2, ""), (3, "a b"), (4, "A  b")])).collect()} == {1, 3}


def test_places_catch_similar_fingerprints():
    rng = np.random.default_rng(23)
    for count in (1000, 250_000):
        exact, taken = similar.places(count)
        missed = 0
        for _ in range(400):
            bits = rng.integers(0, 2, similar.BITS).astype(np.uint8)
            other = bits ^ (rng.random(similar.BITS) < 0.15).astype(np.uint8)
            found = similar.keys(np.stack([np.packbits(x, bitorder="little").view(np.int64) for x in (bits, other)]), exact, taken)
            same = (found[:, 0] >> similar.BALL) == (found[:, 1] >> similar.BALL)
            near = np.bitwise_count((found[:, 0] ^ found[:, 1]) & ((1 << similar.BALL) - 1)) <= similar.RADIUS
            missed += not (same & near).any()
        assert missed <= 4


@pytest.mark.parametrize("limit", [1, 500, 3_000_000])
def test_ball_hashing_links_what_all_pairs_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "TASK_VARIANTS", max(limit, 40_000) if limit > 1 else 40_000)
    rng = random.Random(limit)
    keys = {rng.getrandbits(64) for _ in range(30)}
    for k in list(keys)[:12]:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                k ^= 1 << b
            keys.add(k)
    keys |= {0, (1 << 64) - 1, 0xF, 0xFF}
    keys = sorted(keys)
    frame = spark.createDataFrame([(int(np.uint64(k).astype(np.int64)),) for k in keys], "fp long")
    found = components.connected_components(simhash.links(frame, len(keys) if limit > 1 else 4 * len(keys))).collect()
    component = {r["vertex"]: r["component"] for r in found}
    mine = [component.get(int(np.uint64(k).astype(np.int64)), int(np.uint64(k).astype(np.int64))) for k in keys]
    want = plain_components(keys, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_components(spark):
    rng = random.Random(10)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 210), (210, 200), (None, 5), (300, 301), (301, 302), (302, 300)]
    rng.shuffle(pairs)
    got = {r["vertex"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[200] == got[210] and len({got[i] for i in (300, 301, 302)}) == 1 and 100 not in got
    assert len({got[0], got[200], got[300]}) == 3
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- near copies of the pipeline ---


def plain_shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [4, 512])
def test_near_dedup_is_by_jaccard_similarity(documents, spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(16)
    rows = []
    for n, changes in [(60, 1), (150, 2), (400, 8), (400, 30), (12, 1), (4, 1)] * 4:
        words = prose(rng, n).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(4):
            other = list(words)
            for at in rng.sample(range(n), changes):
                other[at] = prose(rng, 1)
            rows.append((len(rows), " ".join(other)))
            words = rng.choice([words, other])
    rows += [(900 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1]), (None, rows[4][1])]
    sets = [plain_shingles(t) for _, t in rows]
    roots = plain_components(sets, lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b))
    least = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    assert len(rows) - 60 < len(set(roots)) < len(rows) - 40
    kept = corpus_pipeline.near_dedup(spark, documents(rows), "").collect()
    assert len(kept) == len(set(roots)) and {r["doc_id"] for r in kept} == set(least.values())
    assert corpus_pipeline.near_dedup(spark, documents([]), "").count() == 0


# --- archives ---


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'x' AS record_type", "2 AS payload", "3 AS first")


def test_archives(spark, monkeypatch):
    rng = random.Random(11)
    long_ = "é\r\n\r\nWARC/1.1\r\n" * 5000
    copied = prose(rng, 40)
    rows = [(1, "http://a/1", None), (2, None, ""), (3, "http://a\r\nX: y", "short"), (4, "u", "short"), (5, "u", long_), (6, "u", long_), (9, "u", copied), (8, "v", copied), (8, "w", copied), (None, "u", copied), (7, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100)]
    rows += [(20 + i, "u", prose(rng, rng.randint(1, 4000))) for i in range(20)]
    frame = pages(spark, rows)
    got = warc.round_trip(frame)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for k, (i, _, html) in enumerate(rows):
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        first = min((j for j in same if j is not None), default=None) if len((html or "").encode()) >= 100 and len(same) > 1 else None
        original = first is None or (i == first and not any(r[0] == i and r[2] == html for r in rows[:k]))
        want.append((i, len((html or "").encode()), digest(html), "response" if original else "revisit", None if original else first))
    out = got.collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    assert all(r["verified"] for r in out if r["record_type"] == "response")
    assert sorted(r["html"] for r in out if r["record_type"] == "response") == sorted((html or "") for (_, _, html), w in zip(rows, want) if w[3] == "response")
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_chunked_framing_and_segments():
    rng = random.Random(12)
    for n in (0, 1, 4095, 4096, 4097, 50_000):
        payload = rng.randbytes(n)
        assert warc.unframed(warc.framed(payload)) == payload
        parts = [r for r in warc.parsed(b"".join(x + b"\r\n\r\n" for x in warc.page_records(7, "u", 1, hashlib.sha256(payload).hexdigest(), payload, None, False)))]
        assert warc.decoded(warc.assembled([(r[4] or 1, r[5], r[9]) for r in parts[::-1]])) == payload
        if len(parts) > 1:
            with pytest.raises(ValueError):
                warc.assembled([(r[4], r[5], r[9]) for r in parts[1:]])
            with pytest.raises(ValueError):
                warc.assembled([(r[4], (r[5] or 0) + 1 if r[5] else None, r[9]) for r in parts])
    with pytest.raises(ValueError):
        warc.unframed(b"3\r\nabcd\r\n0\r\n\r\n")


# --- packing ---


def test_packing(documents):
    from tokenizers import Tokenizer

    rng = random.Random(13)
    texts = ODD + ["it's don't 12 a-b <|endoftext|> é  x　y", "word " * 5000, "Ünïcödé ΣΑΣ ß İ"] + [prose(rng, rng.randint(1, 1500)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(5, "twice"), (5, "twice"), (None, "no id")]
    out = packing.pack(documents(rows)).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(want, key=repr)
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(w[3] for w in want)
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack(documents([])).count() == 0


def test_plan_covers_each_rank_once():
    rng = np.random.default_rng(14)
    for _ in range(20):
        histogram = np.zeros(2049, np.int64)
        kinds = rng.integers(1, 2049, rng.integers(1, 40))
        histogram[kinds] = rng.integers(1, 50, len(kinds))
        used = collections.Counter()
        room = collections.Counter()
        for length, first, times, sequence, offset in packing.plan(histogram):
            assert first == used[length]
            used[length] += times
            for s in range(sequence, sequence + times):
                assert room[s] == offset
                room[s] += length
        assert used == {int(k): int(histogram[k]) for k in np.unique(kinds)} and max(room.values()) <= 2048


def test_two_pieces_replace_the_smallest():
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 22, 17]] = 1
    # Greedy takes 60 and 30; the gap of 40 that 30 leaves is filled by 22 and 17 more tightly.
    assert packing.fill(counts, 100) == [60, 22, 17]


# --- pipeline ---


def test_pipeline_stages(documents, spark, tmp_path):
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.randint(20, 80)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1] + " ", "en", "s0"), (101, "12 34", "en", "s1"), (102, None, "en", "s1"), (103, prose(rng, 30) + " token=abcdef123", "en", "s2")]
    docs = documents(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert seen["language_id"].keys() == {r[0] for r in rows} - {101, 102}
    assert seen["near_dedup"].keys() == seen["language_id"].keys() - {100}
    assert seen["secret_scan"][103].endswith(" [REDACTED]")
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == last > 0


def test_pipeline_of_nothing_and_with_clashing_columns(documents, spark, tmp_path):
    rng = random.Random(41)
    rows = [(i, prose(rng, rng.randint(20, 60)), "en", rng.choice(["s0", "s1", None])) for i in range(40)]
    rows += [(50, None, "en", "s0"), (51, "", None, None), (52, " \n", "en", "s1"), (None, prose(rng, 30), "en", "s0"), (None, rows[3][1], None, "s0"), (3, rows[3][1], "en", "s0"), (60, rows[5][1].upper(), "en", "s1"), (61, prose(rng, 60_000), "en", "s1")]
    docs = documents(rows)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    deduped = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in spark.read.parquet(str(tmp_path / "near_dedup")).collect())
    assert deduped == [(False, i) for i in [*range(40), 61]] + [(True, 0)]
    # Packing: every token of what the mix gave is there once, in sequences without gaps.
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for r in kept.collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        want.update((r["doc_id"], k, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    out = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in out) == want
    places = collections.defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 and [a for a, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] for p in places.values())
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_other_tokenizers_are_asked_for_whole_texts(documents, tmp_path):
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = packing.tokenizer_path(name)
        texts = ["It's  two\n\nlines", "ÉTÉ été x1234", "a" * 5000]
        tokenizer = Tokenizer.from_file(path)
        assert packing.Words(path).by_words == (name == packing.TOKENIZER)
        out = packing.pack(documents(list(enumerate(texts))), path).where("piece = 0").orderBy("doc_id").collect()
        want = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")[:2048] for t in texts]
        assert [(r["length"], r["ids_crc32"]) for r in out] == [(len(w), zlib.crc32(w.tobytes())) for w in want]


def test_very_long_texts(documents):
    """Whole texts, however long: mixed, fingerprinted and with repeats, against the plain rules."""
    rng = random.Random(40)
    long_text = prose(rng, 400_000)
    rows = [(1, long_text, "en", "a"), (2, "short text here", "en", "a"), (3, "x " * 300_000, "en", "b")]
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(documents(rows)).collect()}
    assert sizes == {1: 400_000, 2: 3, 3: 300_000}
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(documents(rows)).collect()}
    assert got[3] == f"{plain_fingerprint('x x x x'):016x}" and got[1] == f"{plain_fingerprint(long_text):016x}"


def test_words_have_the_ids_of_whole_texts(monkeypatch):
    words = packing.Words(packing.tokenizer_path())
    chars = [chr(c) for c in [*range(0x21, 0x250), 0x3A3, 0x130, 0x301, 0x2028, 0x4E2D, 0x1F600]]
    texts = [c + d for c in chars for d in ("", "a", "É1-", "'s")] + ["a " + c + "b" + c + " " + c for c in chars] + ["é x́", "<|EndOfText|> <|endoftext|>a", "we'll DON'T o'clock", "x\x01y \x01", "ΣΑΣ Σ"]
    want = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert words.ids(raw) == want
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    assert [words.ids([t])[0] for t in raw] == want


def all_sets(m, worth, limit):
    """Every change of intervals by one or none whose edges' expected squared distances add up to at most ``limit``."""
    found = []
    for step in itertools.product((-1, 0, 1), repeat=m):
        if sum(worth[j if s < 0 else m + j] for j, s in enumerate(step) if s) <= limit:
            found.append(step)
    return np.array(found)


def test_visited_buckets_and_blocks_are_those_of_the_list():
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(200, 8))
    hashes = neighbours.Hashes(sample, 200, 40)
    for limit in (0.0, 0.3, 0.9, 5.0):
        hashes.limit = limit
        cells, inside = hashes.cells(sample[:6])
        for t in range(neighbours.TABLES):
            worth = hashes.worth(inside[t])
            for i in range(6):
                steps = all_sets(hashes.m, worth[i], limit)
                far = rng.integers(-2, 3, size=(300, hashes.m))
                want = {tuple(s) for s in steps.tolist()}
                assert hashes.visited(cells[t, i], worth[i], cells[t, i] + steps).all()
                assert hashes.visited(cells[t, i], worth[i], cells[t, i] + far).tolist() == [tuple(s) in want for s in far.tolist()]
                assert set(hashes.reached(cells[t, i], worth[i])) == set(hashes.named(hashes.sums(cells[t, i] + steps)))


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_recall_of_nearest(spark, kind):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(3000, 16))
    if kind == "clustered":
        v = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 4 + v * 0.3
    got = neighbours.nearest(embeddings(spark, list(enumerate(v.tolist()))), F.col("vec_id") % 100 == 0).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    want = set()
    for q in range(0, 3000, 100):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        want |= {(q, int(i)) for i in np.argsort(d)[:10]}
    assert len(got) == 300 and len(found & want) >= 0.9 * len(want)
