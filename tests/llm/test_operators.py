"""The operators on hard small tables, against brute force."""

import collections
import hashlib
import importlib
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import _shingles, lang_id, license_scan, mixing, near_dedup, packing, quality, substring_dedup, topk, url_filter, warc
from maskwright.llm._shingles import Sketcher, shingle_hashes

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("n", "ord", "h", "run", "spans", "size", "kept", "cell", "node", "component", "n_words", "row number", "doc")


def words(draw, n, size=400):
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


def hard_docs():
    draw = random.Random(7)
    base = words(draw, 300, 10**6)
    near = base.split()
    near[150] = "changed"
    other = near[:]
    other[20] = other[250] = "again"
    passage = words(draw, 80, 10**6)
    texts = [
        None, "", " \n\t ", "one", "one two", "One  TWO", base, base, " ".join(near), " ".join(other), words(draw, 200, 10**6) + " " + passage, passage + "\n" + words(draw, 150, 10**6),
        "same line\n" * 60, words(draw, 3000, 10**6), "é" * 300, "ab" * 4000, words(draw, 60, 10**6), base + " tail", "x" * 99, "y" * 100, "y" * 100,
    ]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "c"][i % 4], None) for i, t in enumerate(texts)]
    return rows + [(3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "no id here at all", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(hard_docs(), DOC)
    for c in CLASH:
        out = out.withColumn(c, F.lit(c))
    return out.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# 1 -------------------------------------------------------------------------------
def test_topk_equals_brute_force(spark):
    draw = random.Random(1)
    rows = [(i, [draw.choice([-1.5, -0.01, 0.0, 0.004, 0.02, 0.5, 2.0]) for _ in range(6)], "x") for i in range(60)]
    rows += [(100, None, "x"), (120, [1.0, None], "x"), (140, [float("nan")] * 6, "x"), (160, [float("inf")] * 6, "x"), (180, [], "x"), (181, [0.7], "x"), (None, [1.0] * 6, "x"), (40, rows[40][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    vectors = topk.quantised(table)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.exact_top_k(vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), vectors, 5, candidate_rows=7, query_rows=2).collect()}
    plain = {r.vec_id: r.weights for r in vectors.collect()}
    assert set(plain) == {*range(60), 180, 181}
    want = {}
    for q in (v for v in plain if v % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(plain[q], w)), v) for v, w in plain.items() if v != q)[:5]
        want |= {(q, i): (v, -s) for i, (s, v) in enumerate(best, 1)}
    assert got == want
    none = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.exact_top_k(none.withColumnRenamed("vec_id", "query_id"), none).count() == 0
    assert topk.quantised(table.filter("vec_id = 3")).first().weights[0] == int(np.floor(64 * np.float64(np.float32(rows[3][1][0]))))


def test_topk_large_scores(spark):
    items = spark.createDataFrame([(i, [2**30 + i, -(2**20)]) for i in range(5)], "vec_id long, weights array<long>")
    got = topk.exact_top_k(items.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id"), items, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(4, 2**30 * (2**30 + 4) + 2**40), (3, 2**30 * (2**30 + 3) + 2**40)]


# 2 -------------------------------------------------------------------------------
def filled(sizes, weights, share=1.5, most=2):
    """Clamping and resharing until feasible, literally."""
    left, target, total = dict(weights), {}, share * sum(sizes.values())
    while left:
        level = total / sum(left.values())
        over = [s for s, w in left.items() if w * level >= most * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in left.items()}
        for s in over:
            target[s] = most * sizes[s]
            total -= target[s]
            del left[s]
    return target


def test_mixing_targets(spark):
    draw = random.Random(2)
    for _ in range(3):
        sizes = {s: draw.choice([0, 5, 90, 1000]) + draw.randrange(50) for s in "abcdefgh"}
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
        want = filled({s: n for s, n in sizes.items() if n}, {s: w for s, w in weights.items() if sizes[s]})
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert all(abs(got[s] - want.get(s, 0)) < 1e-6 for s in sizes)


def test_mixing_targets_by_ranges(spark, monkeypatch):
    """Sources in more than one task: the same ranks and sums, to the last bit."""
    draw = random.Random(12)
    sizes = spark.createDataFrame([(f"s{draw.randrange(10**6)}" if i else None, draw.choice([0, 5, 90, 1000]) + draw.randrange(50)) for i in range(300)], "source string, size long")
    want = sorted(map(str, mixing.targets(sizes).collect()))
    monkeypatch.setattr(mixing, "ONE_TASK", 2)
    assert sorted(map(str, mixing.targets(sizes.repartition(3)).collect())) == want


def test_mixing_plan(spark, docs, empty):
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.plan_mix(sizes).collect()
    assert len(rows) == len(hard_docs())
    per = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        per[r.source].append(r)
    for rs in per.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan_mix(sizes.repartition(2)).collect()))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.taken // r.size for r in rows if r.size)
    assert mixing.mixed(empty).count() == 0 and mixing.plan_mix(empty.select("doc_id", "source", F.lit(1).alias("size"))).count() == 0
    assert "Python" not in mixing.plan_mix(sizes)._jdf.queryExecution().toString()


# 3 -------------------------------------------------------------------------------
def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, least):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if x and y and 100 * len(x & y) >= least * len(x | y):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return {i: top(i) for i in parent}


@pytest.mark.parametrize("k, least", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, k, least):
    got = near_dedup.near_duplicates(docs, k, least).collect()
    want = components([r[:2] for r in hard_docs()], k, least)
    texts = {r[0]: r[1] for r in hard_docs()}
    assert len(got) == len(hard_docs())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(shingles(texts[r.doc_id], k)))
    kept = near_dedup.keep_first(docs, width=k, threshold=least)
    assert kept.columns == docs.columns and kept.count() == len(set(want.values())) + sum(r.doc_id is None for r in got)  # a row a component


def test_near_duplicates_through_a_hub(spark, empty):
    """Copies that are only like a common original, and not like the centre of their bucket."""
    draw = random.Random(11)
    base = [f"t{draw.randrange(10**7)}" for _ in range(400)]
    rows = []
    for i in range(40):
        w = base[:]
        for at in draw.sample(range(400), 7):
            w[at] = f"u{draw.randrange(10**7)}"
        rows.append((i, " ".join(w)))
    rows.append((99, " ".join(base)))
    rows += [(200 + i, " ".join(base[:200] + [f"v{draw.randrange(10**7)}" for _ in range(200)])) for i in range(30)]
    want = components(rows, 5, 80)
    assert len(set(want.values())) > 2 and sum(v == 0 for v in want.values()) > 30
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id are documents of their own; private names of the operator may be columns."""
    draw = random.Random(5)
    a, b = words(draw, 60, 10**6), words(draw, 60, 10**6)
    rows = [(5, a, "x"), (5, b, "y"), (2, b, "z"), (7, a, "w"), (7, a, "v"), (None, a, "u")]
    cols = "doc_id long, text string, ord string"
    df = spark.createDataFrame(rows, cols)
    for name in ("row", "o", "node", "component", "__gone", "set_id", "n"):
        df = df.withColumn(name, F.lit(1))
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (2, 2, True), (5, 2, False), (5, 5, True), (7, 5, False), (7, 5, False)]
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.ord for r in kept.collect()) == ["u", "x", "z"]


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Hot buckets: many documents that share half their words, few of them links of each other. No broadcasts."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    draw = random.Random(21)
    base = [f"t{draw.randrange(10**7)}" for _ in range(150)]
    rows = []
    for i in range(60):
        own = base + [f"v{draw.randrange(10**7)}" for _ in range(50)]
        rows.append((i, " ".join(own)))
        if i % 6 == 0:
            own[175] = "other"
            rows.append((1000 - i, " ".join(own)))
    want = components(rows, 5, 80)
    assert sum(v == i for i, v in want.items()) == 60
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """Many edits of one text, few of them links of each other: hot buckets of one centre are compared once."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    draw = random.Random(31)
    base = [f"t{draw.randrange(10**7)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        w = base[:]
        for at in draw.sample(range(200), draw.randrange(3, 9)):
            w[at] = f"u{draw.randrange(10**7)}"
        rows.append((i, " ".join(w)))
        if i % 20 == 0:
            w[100] = "other"
            rows.append((1000 + i, " ".join(w)))
    want = components(rows, 5, 80)
    assert len(set(want.values())) > 100 and sum(v == 0 for v in want.values()) > 50
    met, step = [], near_dedup._block_step
    monkeypatch.setattr(near_dedup, "_block_step", lambda rest, *more: met.append(rest.count()) or step(rest, *more))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert met[0] <= 30 * len(rows)


def test_recall_of_bands_and_sketches():
    """Of pairs at and above the threshold, no less than 99 in 100 share a band and have hopeful sketches."""
    draw, tool = np.random.default_rng(8), Sketcher(near_dedup.BANDS, near_dedup.ROWS)
    for least, sizes in ((80, (5, 12, 60, 400, 3000)), (85, (7, 30, 150, 1000))):
        tried = found = 0
        for n in sizes:
            for _ in range(150):
                x = draw.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True)
                lost = int(n * (100 - least) / (100 + least) * draw.random())
                y = np.concatenate([x[lost:], draw.integers(0, 2**64 - 1, lost, dtype=np.uint64, endpoint=True)])
                if 100 * (n - lost) < least * (n + lost):
                    continue
                (a, c), (b, d) = (tool.halves(tool.sketch(np.unique(z))) for z in (x, y))
                same = np.array([p == q and r == s for p, q, r, s in zip(a, b, c, d)])
                low = np.mean([p == q for p, q in zip(a, b)])
                tried += 1
                found += same.reshape(near_dedup.BANDS, -1).all(axis=1).any() and low >= near_dedup.hopeful(least, len(a))
        assert tried > 400 and found >= 0.99 * tried


def test_sketches_estimate_similarity():
    draw = random.Random(4)
    tool = Sketcher(32, 4)
    for n in (3, 20, 1000):
        a = words(draw, n, 10**6).split()
        b = a[:-1] + ["z"]
        x, y = (shingle_hashes(" ".join(t).encode(), 1) for t in (a, b))
        same = np.mean(tool.sketch(x) == tool.sketch(y))
        assert abs(same - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.25


# 4 -------------------------------------------------------------------------------
URLS = [
    ("http://example.com/en/8", "block", "com/en/"), ("HTTPS://WWW.Example.COM/en/71?x", "allow", "example.com/en/7"), ("http://a.net/de/8", "allow", "net/de/"), ("http://b.example.net/de/8#y", "block", "example.net/de/8"),
    ("http://x.org/es/", "block", "org/es/"), ("http://xorg/es/", None, None), ("http://x.org/ES/", None, None), (None, None, None), ("no scheme.com/en/", None, None), ("http://", None, None), ("http://h?/en/", None, None), ("a://b://c.com/en/1", None, None),
    ("http://com/en/x", "block", "com/en/"), ("http://é.com/en/", "block", "com/en/"), ("http://x.io/" + "long/" * 5000, None, None),
]


def test_url_rules(spark):
    table = spark.createDataFrame([(i, u, "x") for i, (u, _, _) in enumerate(URLS)], "page_id long, url string, host string")
    got = url_filter.filter_urls(table).orderBy("page_id").collect()
    for r, (u, verdict, rule) in zip(got, URLS):
        assert r.rule == rule and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/71") and (got[7].host, got[7].path) == ("", "") and (got[10].host, got[10].path) == ("h", "")
    assert "Python" not in url_filter.filter_urls(table)._jdf.queryExecution().toString()
    assert url_filter.filter_urls(table.limit(0)).count() == 0


def test_url_model():
    """New addresses made of words of the labelled table are told apart, with half of it held out."""
    right = 0
    side = [random.Random(i).random() < 0.5 for i in range(len(url_filter.LABELLED))]
    for half in (False, True):
        weights = url_filter.fit(tuple(x for x, s in zip(url_filter.LABELLED, side) if s == half))
        for (url, y), s in zip(url_filter.LABELLED, side):
            if s != half:
                own = {url_filter.bucket(g) for g in url_filter.grams(*url_filter._parts(url))}
                right += (sum(weights[b] for b in own) / len(own) ** 0.5 + weights[-1] > 0) == bool(y)
    assert right >= 0.85 * len(url_filter.LABELLED)


# 5 -------------------------------------------------------------------------------
def brute_repeats(w, least):
    n = len(w)
    covered, longest = set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                covered |= {*range(i, i + k), *range(j, j + k)}
    return len(covered), longest


def test_suffix_array_repeats():
    draw = random.Random(3)
    for n in (0, 1, 5, 40, 120):
        for size in (1, 2, 30):
            ids = np.array([draw.randrange(size) for _ in range(n)], np.int64)
            if n > 60:
                ids[-25:] = ids[5:30]
            cover, longest = quality.repeats(ids, 8, 128)
            want = brute_repeats(ids.tolist(), 8)
            assert cover == want[0]
            assert longest == want[1] or (want[0] == 0 and longest <= want[1]) or longest >= 128


def test_quality_rules(spark, docs, empty):
    rows = {r.doc_id: r for r in quality.judge(docs).collect() if r.doc_id is not None}
    assert rows[0].n_words == rows[1].n_words == 0 and rows[0].base_failed and not rows[0].kept
    assert (rows[12].n_dup_lines, rows[12].n_repeat_words, rows[12].base_failed) == (59, 120, True)
    assert rows[13].kept and rows[6].kept and not rows[15].kept
    block = words(random.Random(1), 70, 10**6)
    twice = spark.createDataFrame([(1, block + " " + words(random.Random(2), 100, 10**6) + " " + block), (2, "a # b*$%&|<> c\nd\n\nd \nd")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(twice).collect()}
    assert not got[1].base_failed or got[1].n_repeat_words == 140
    assert got[1].n_covered_words == 140 and not got[1].kept
    assert (got[2].n_symbols, got[2].n_dup_lines, got[2].word_chars) == (8, 1, 14)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs).filter("kept").count()
    assert quality.keep_good(empty).count() == 0


# 6 -------------------------------------------------------------------------------
def brute_removed(texts):
    seen, out = set(), []
    for b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p: p + 100]
            if w in seen:
                gone[p: p + 100] = b"\1" * 100
            seen.add(w)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def check_removed(spark, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = sorted((r[0] is None, r[0] or 0, *b) for r, b in zip(ordered, brute_removed([(r[1] or "").encode() for r in ordered])))
    got = substring_dedup.digest_rows(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_substrings_hard(spark, docs, empty):
    check_removed(spark, hard_docs())
    cut = substring_dedup.cut(docs)
    assert cut.columns == docs.columns and cut.count() == len(hard_docs())
    assert substring_dedup.digest_rows(empty).count() == 0 and substring_dedup.cut(empty).count() == 0


@pytest.mark.parametrize("hot, piece", [(4000, 1 << 19), (2, 700)])
def test_substrings_random(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    if hot == 2:
        monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", 0)
    draw = random.Random(9)
    parts = [words(draw, draw.randrange(5, 60), 10**6) for _ in range(12)]
    rows = [(i, " ".join(draw.choice([*parts, words(draw, 9, 10**6), "a" * draw.randrange(250)]) for _ in range(draw.randrange(1, 14)))) for i in range(60)]
    check_removed(spark, rows)
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    text = rows[0][1].encode() * 3
    first, n, _ = substring_dedup.runs(text)
    assert n.sum() == len(text) - 99 and (first[1:] == first[:-1] + n[:-1]).all() and n.max() <= 81


def test_words_are_hashed_as_arrays(monkeypatch):
    """Words are equal by hash where they are equal with A-Z lower-cased, and a text of new words costs no Python call a word."""
    draw = random.Random(8)
    spaces, odd = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  \n"], ["\x00", "\x00\x00", "\x1c", "\x85", "\u00c9", "\u00e9", "\u2003", "a", "A", "aB", "Ab", "ba", "x" * 64, "X" * 65, "x" * 65, "y" * 300]
    for piece in (1 << 19, 40):
        monkeypatch.setattr(_shingles, "PIECE", piece)
        for n in (0, 1, 2, 3, 200):
            text = draw.choice(["", " "]) + "".join(draw.choice([*odd, words(draw, 1, 300)]) + draw.choice(spaces) for _ in range(n)) + draw.choice(["", "end"])
            plain = text.encode().lower().split()
            h = _shingles.word_hashes(text.encode()).tolist()
            assert len(h) == len(plain) and len(set(h)) == len(set(plain)) == len(set(zip(h, plain)))
            for width in (1, 3, 5):
                sets = {tuple(plain[i: i + width]) for i in range(max(1, len(plain) - width + 1))} if plain else set()
                found = shingle_hashes(text.encode(), width)
                assert len(found) == len(sets) and (found[1:] > found[:-1]).all()
    monkeypatch.undo()
    calls = []
    text = " ".join(f"{i:x}" for i in range(20_000)).encode()
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        shingle_hashes(text, 5)
    finally:
        sys.setprofile(None)
    assert len(calls) < 500, len(calls)


def test_windows_of_an_anchor_of_many_names():
    """An anchor with the names that a large family of near copies has stays in one task, in little memory."""
    import tracemalloc

    draw = np.random.default_rng(13)
    parts = [draw.integers(0, 256, 179, np.uint8).tobytes() for _ in range(6000)]
    for i in range(50, 6000, 100):
        parts[i] = parts[i][:30] + parts[i - 50][20:169]  # ten bytes on, 50 windows of an earlier run
    rows = pa.table({"h": np.r_[np.full(5999, 7), 8], "ord": np.arange(6000), "run": np.full(6000, 1000 * 128 + 80), "part": pa.array(parts, pa.binary())})
    tracemalloc.start()
    out = pa.Table.from_batches(list(substring_dedup._late_windows(iter(rows.to_batches(max_chunksize=500))))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == [{"ord": i, "s": 1030, "e": 1179} for i in range(50, 6000, 100)]
    assert substring_dedup.HOT > len(parts) and peak < 60e6, peak


def test_runs_are_cut_in_whole_batches(spark, monkeypatch):
    """The bytes of runs leave in a batch for many texts, or for a bounded number of runs, and are no table of files unless an anchor is hot."""
    texts = [bytes(range(65, 91)) * 8 + bytes([i]) * 9 for i in range(50)]
    pairs = [[{"h": i, "run": 3 * 128 + 5}, {"h": -i, "run": 100 * 128 + 1}][: 1 + i % 2] for i in range(50)]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("run", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts, pa.binary()), pa.array(pairs, kind)], names=["ord", "text", "pairs"])
    want = [{"h": x["h"], "ord": i, "run": x["run"], "part": texts[i][x["run"] // 128:][: x["run"] % 128 + 99]} for i in range(50) for x in pairs[i]]
    out = list(substring_dedup._cut_runs(iter([batch, batch.slice(0, 0), batch.slice(7, 20)])))
    assert [b.num_rows for b in out] == [75, 30] and pa.Table.from_batches(out).to_pylist() == want + [x for x in want if 7 <= x["ord"] < 27]
    monkeypatch.setattr(substring_dedup, "CUT", 20)
    out = list(substring_dedup._cut_runs(iter([batch])))
    assert max(b.num_rows for b in out) <= 21 and pa.Table.from_batches(out).to_pylist() == want

    written, plain = [], substring_dedup.stage
    monkeypatch.setattr(substring_dedup, "stage", lambda df, tag: written.append(tag) or plain(df, tag))
    draw = random.Random(4)
    passage = words(draw, 40, 10**6)
    rows = [(i, f"{words(draw, 30, 10**6)} {passage[:150 + i]} {words(draw, 30, 10**6)}") for i in range(20)]
    check_removed(spark, rows)
    assert "pieces" not in written and "runs" in written
    monkeypatch.setattr(substring_dedup, "HOT", 1)
    check_removed(spark, rows)
    assert "pieces" in written


def test_substrings_of_hot_strings(spark):
    """A string of very many copies reaches the shuffle once a batch, and a run of one byte as one span."""
    passage = words(random.Random(3), 60, 10**6)
    texts = [" " * 5000, *(f"{passage} {i} " + "b" * 300 for i in range(300)), " " * 700 + passage]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], names=["ord", "text"])
    out = pa.Table.from_batches(list(substring_dedup._named_runs([batch]))).to_pandas()
    once, spans = out[out.e < 0], out[out.e >= 0]
    assert (once.h == once.h.mode()[0]).sum() <= 320 and not once.duplicated(["h", "name"]).any()
    assert spans[spans.ord == 0][["run", "e"]].values.tolist() == [[1, 5000]] and spans.h.is_unique
    check_removed(spark, [(i, t) for i, t in enumerate(texts)] + [(999, "c" * 200_000)])


# 7 -------------------------------------------------------------------------------
def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tool = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(500, "a<|endoftext|>b <|startoftext|> It's ÉTÉ\u00a0\x85ſ Σας 12.5"), (501, "e\u0301 \u0301x a\x1cb")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd)
    rows = packing.pack(table, size=64).collect()
    want = collections.Counter()
    for doc, text in table.collect():
        ids = tool.encode(text or "", add_special_tokens=False).ids + [0]
        for k, lo in enumerate(range(0, len(ids), 64)):
            want[doc, k, lo, len(ids[lo: lo + 64]), zlib.crc32(np.array(ids[lo: lo + 64], "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    at = collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(empty).count() == 0


def test_best_fit_is_the_tightest():
    draw = random.Random(6)
    for size in (7, 64, 100):
        lengths = sorted((draw.randrange(1, size + 1) for _ in range(300)), reverse=True)
        at, offsets = packing.best_fit(lengths, size)
        free: list[int] = []
        for n in lengths:
            fit = min((f for f in free if f >= n), default=None)
            if fit is None:
                free.append(size - n)
            else:
                free[free.index(fit)] -= n
        assert len(free) == max(at) + 1


# 8 -------------------------------------------------------------------------------
def test_language(spark, docs, empty):
    train = spark.createDataFrame([(i, t, la) for i, (t, la) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), (None, "en"), ("123", "en"), ("x", None)])], "doc_id long, text string, lang string")
    langs, profiles = lang_id.fit(train)
    assert langs == ["de", "en", "fr"]
    asked = spark.createDataFrame([(1, "the dog and the cat"), (2, "die katze und der hund"), (3, None), (4, "12 !?"), (5, "le chien"), (6, "the dog " * 40000)], "doc_id long, text string")
    got = {r.doc_id: r for r in lang_id.predict(asked, langs, profiles).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "fr", "en"] and all(0 <= r.score <= 1 for r in got.values())
    assert lang_id.predict(docs, *lang_id.fit(docs)).count() == len(hard_docs())
    nothing = lang_id.fit(empty)
    assert nothing[0] == [] and {r.lang_pred for r in lang_id.predict(asked, *nothing).collect()} == {"und"}


def plain_vector(text):
    """Trigram by trigram, letter by letter."""
    letters = {0: np.random.default_rng([lang_id.SEED, 0]).choice(np.array([-1, 1], np.int8), lang_id.WIDTH).astype(int)}
    for c in set(text.lower()):
        letters[ord(c)] = np.random.default_rng([lang_id.SEED, ord(c)]).choice(np.array([-1, 1], np.int8), lang_id.WIDTH).astype(int)
    marks = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or marks[-1]:
            marks.append(code)
    if marks[-1]:
        marks.append(0)
    total = np.zeros(lang_id.WIDTH, int)
    for a, b, c in zip(marks, marks[1:], marks[2:]):
        total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total


def test_language_equals_brute_force(spark):
    draw = random.Random(14)
    tongues = {"en": "the and of water house", "de": "der und von wasser haus über", "el": "το και του νερό σπίτι", "ru": "и вода дом что быть", "zh": "的 是 水 房子 不"}
    rows = [(i, " ".join(draw.choice(tongues[k].split()) for _ in range(draw.randrange(2, 15))) + draw.choice(["", "!", " 12", "\n"]), k) for i, k in enumerate(sorted(tongues) * 8)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, profiles = lang_id.fit(train)
    sums = {k: sum(np.rint(v / np.linalg.norm(v) * 1e6) for v in (plain_vector(t) for _, t, lang in rows if lang == k)) for k in tongues}
    want = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    assert langs == sorted(tongues) and np.allclose(profiles, [want[k] for k in langs], atol=1e-5)
    for r, (i, text, lang) in zip(lang_id.predict(train, langs, profiles).orderBy("doc_id").collect(), rows):
        v = plain_vector(text)
        cos = {k: float(w @ v / np.linalg.norm(v)) for k, w in want.items()}
        assert r.lang_pred == max(sorted(cos), key=cos.get) == lang and abs(r.score - max(0, cos[r.lang_pred])) < 1e-4


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = lang_id.query_lang_id(spark, "/root/testdata/sf0.001").join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.95


# 9 -------------------------------------------------------------------------------
def test_licences(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    rows = [
        (1, "r/LICENSE", mit), (2, "r/a/b/x.py", "code = 1"), (3, "r/a/COPYING.txt", "Licensed under the Apache License, Version 2.0."), (4, "r/a/b/y.py", "# This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\nx"),
        (5, "q/z.py", "nothing of the license kind"), (6, None, "x"), (7, "r/c.py", None), (8, "r/d/e.py", ""), (9, "ra/x.py", "k"), (10, "top.py", "k"), (11, "r/f.md", "words " * 5000 + "\nReleased under the MIT License.\n" + "words " * 5000),
    ]
    got = {r.id: r for r in license_scan.scan_licences(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert {i: r.licence for i, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0", 4: "MPL-2.0", 5: None, 6: None, 7: "MIT", 8: "MIT", 9: None, 10: None, 11: "MIT"}
    assert got[2].licence_dir == "r/a" and got[8].licence_dir == "r" and got[4].own_licence == "MPL-2.0"
    assert license_scan.scan_licences(spark.createDataFrame([], "id long, path string, text string")).count() == 0


def test_licence_cosine_equals_brute_force():
    tool = license_scan.Matcher({"license": 30, "the": 90, "version": 10}, 100)
    draw = random.Random(8)
    for _ in range(300):
        unit = [draw.choice([*license_scan.VOCABULARY, "zz", "yy"]) for _ in range(draw.randrange(1, 12))]
        if draw.random() < 0.5:
            unit = license_scan.terms(draw.choice(draw.choice(list(license_scan.TEMPLATES.values())))) + unit[:2]
        weight = {t: c * tool.idf.get(t, tool.rest) for t, c in collections.Counter(unit).items()}
        best = 0.0
        for texts in license_scan.TEMPLATES.values():
            for t in texts:
                v = {x: c * tool.idf[x] for x, c in collections.Counter(license_scan.terms(t)).items()}
                best = max(best, sum(w * v.get(x, 0) for x, w in weight.items()) / (sum(w * w for w in weight.values()) * sum(w * w for w in v.values())) ** 0.5)
        score, _ = tool.best(unit)
        assert abs(score - best) < 1e-9 or (score == 0 and best < license_scan.LEAST)


def test_licence_weighs_all_words(spark):
    asked = "Licensed, note, under the common Apache License, Version 2.0."
    base = [asked, *(f"note some common prose number{i % 7}" for i in range(39))]
    got = {}
    for k in (1, 100):
        rows = [(i, f"d/{i}", t) for i, t in enumerate(base * k)]
        got[k] = license_scan.scan_licences(spark.createDataFrame(rows, "id long, path string, text string")).filter("id = 0").first()
        df = collections.Counter(w for _, _, t in rows for w in set(license_scan.terms(t)))
        weight = {w: np.log((1 + len(rows)) / (1 + df[w])) + 1 for t in (asked, license_scan.TEMPLATES["Apache-2.0"][0]) for w in license_scan.terms(t)}
        own = set(license_scan.terms(license_scan.TEMPLATES["Apache-2.0"][0]))
        want = (sum(weight[w] ** 2 for w in own) / sum(x**2 for x in weight.values())) ** 0.5
        assert abs(got[k].score - want) < 1e-5 and got[k].own_licence == "Apache-2.0"
    assert abs(got[1].score - got[100].score) < 0.01


def test_licence_full_texts(spark):
    full = importlib.import_module("maskwright.llm.licence_texts").FULL
    rows = [(i, f"{name}/7.txt", "Copyright (c) 2021 Jane Doe\n\n" + full[name]) for i, name in enumerate(sorted(full))]
    rows += [(100 + i, f"{name}/src/x.txt", "plain words of a file") for i, name in enumerate(sorted(full))] + [(200, "none/x.txt", "plain words of a file")]
    got = {r.path: r for r in license_scan.scan_licences(spark.createDataFrame(rows, "id long, path string, text string"), by_text=True).collect()}
    for name in full:
        assert got[f"{name}/7.txt"].own_licence == name and got[f"{name}/7.txt"].score > 0.9
        assert got[f"{name}/src/x.txt"].licence == name and got[f"{name}/src/x.txt"].licence_dir == name
    assert got["none/x.txt"].licence is None


def test_licence_inside_longer_lines():
    tool = license_scan.Matcher({}, 100_000)
    filler = " ".join(f"filler{i}" for i in range(300))
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    cases = {
        "Copyright (c) 2021 ACME Inc. Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0. All rights reserved.": "Apache-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one": "MPL-2.0", grant: "MIT",
        "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT */": "GPL-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: LicenseRef-x see MIT": None,
        "You can redistribute it. This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.": "GPL-2.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.": "GPL-3.0",
    }
    for text, name in cases.items():
        for wrapped in (text, f"{filler} {text} {filler}"):
            units = tool.units(wrapped)
            best = max(((license_scan._cosine(u[0], u[2], dict(u[4]), tool.rest), u[1]) for u in units), default=(0.0, None))
            assert (best[1] if best[0] >= license_scan.LEAST else None) == name, (wrapped, best)


def test_licence_windows_equal_brute_force():
    tool = license_scan.Matcher({"license": 30, "the": 90, "version": 10}, 100)
    draw = random.Random(9)
    for _ in range(100):
        i = draw.randrange(len(tool.heads.names))
        template, size = [t for n in sorted(license_scan.TEMPLATES) for t in license_scan.TEMPLATES[n]][i], tool.heads.lengths[i]
        words = [draw.choice(["zz", "the", "license", *license_scan.terms(template)]) for _ in range(40)]
        at = draw.randrange(40)
        words[at:at] = license_scan.terms(template)
        want = []
        for k in range(len(words) - size + 1):
            weight = {t: c * tool.idf.get(t, 1.0) for t, c in collections.Counter(words[k: k + size]).items()}
            if sum(w * tool.heads.weights[i].get(t, 0) for t, w in weight.items()) >= license_scan.LEAST * sum(w * w for w in weight.values()) ** 0.5:
                want.append(words[k: k + size])
        assert list(tool.windows(words, i)) == want and license_scan.terms(template) in want


# 10 ------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    page = "<p>é</p>" * 30
    rows = [(1, "http://a/ b\n\u200b", page), (2, None, page), (0, "http://c", page), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 3_000_000), (7, "u", "x" * 3_000_000), (8, "u", "x" * 3_000_000), (None, "u", page), (9, "u", "a\r\n\r\nb" * 40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    index = warc.write_archives(table, f"file://{tmp_path}/w")
    got = warc.read_archives(index).collect()
    want = []
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and first[h] != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    known, named, urls = set(), set(), collections.defaultdict(set)
    for path in (tmp_path / "w").glob("*.zst"):
        data = path.read_bytes()
        frames = warc.read_seek_table(data)
        bundle = warc._Frames(f"file://{path}")
        for r in index.filter(F.col("bundle").endswith(path.name)).collect():
            fields, _ = warc.parse_record(bundle.frame(r.frame)[r.record_at: r.record_at + r.record_size])
            assert fields["WARC-Record-ID"] == f"<urn:uuid:{r.record_id}>"
            known.add(fields["WARC-Record-ID"])
            named |= {fields["WARC-Refers-To"]} if "WARC-Refers-To" in fields else set()
            urls[fields.get("X-Page-ID")].add(warc.target_url(fields))
        assert sum(a for a, _ in frames) + 9 + 8 * len(frames) + 8 == len(data)
        assert [r for r in index.filter(F.col("bundle").endswith(path.name)).select("frame").distinct().toPandas().frame.sort_values()] == list(range(len(frames)))
    assert named and named <= known
    assert {None if k is None else int(k): v for k, v in urls.items()} == {i: {u or ""} for i, u, _ in rows}
    assert warc.read_archives(warc.write_archives(table.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_warc_copies_without_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_COPIES", 0)
    rows = [(i, f"http://a/{i}", f"{i % 3}" * 150) for i in range(40)] + [(None, "é\u200b\u2028%41", "0" * 150)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to or 0) for r in got) == sorted((-1 if i is None else i, "response" if i in (0, 1, 2) else "revisit", int(h[0]) if i not in (0, 1, 2) else 0) for i, _, h in rows)
