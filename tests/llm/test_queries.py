"""Registered queries against their SQL, and the pipeline's stages."""

import collections
import hashlib

import duckdb
import pytest

import corpus_pipeline
from maskwright.llm import packing, quality, registry
from maskwright.llm._store import stage

SF = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(repr([None if x is None or x != x else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x) for x in r]) for r in frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())


def plain_quality(text):
    w = (text or "").encode().split()

    def covered(k):
        seen = collections.Counter(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
        return {p for i in range(len(w) - k + 1) if seen[tuple(w[i: i + k])] > 1 for p in range(i, i + k)}

    if len(w) < quality.MIN_WORDS or 100 * len(covered(3)) > quality.MAX_REPEAT_WORDS * len(w):
        return False
    return 100 * len(covered(quality.MIN_REPEAT)) <= quality.MAX_COVERED * len(w) and not covered(quality.LONGEST)


def plain_near(docs):
    """The first document of each component of links by five-word shingles."""
    sets = {}
    for i, text in docs.items():
        w = text.encode().lower().split()
        sets[i] = {tuple(w[j: j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in docs}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sorted(docs):
        for j in sorted(docs):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: docs[i] for i in docs if root(i) == i}


def plain_cut(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        b = docs[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p: p + 100] in seen:
                gone[p: p + 100] = b"\1" * 100
            seen.add(b[p: p + 100])
        out[i] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def plain_mix(docs, source):
    """How often each document is taken."""
    size = {i: len(t.encode().split()) for i, t in docs.items()}
    names = sorted({source[i] for i in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in docs if source[i] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * total[s]}
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * total[s]
            left -= goal[s]
        open_ -= over
    goal |= share if open_ else {}
    taken = {}
    for s in names:
        whole = int(goal[s] // total[s]) if total[s] else 0
        extra, before = goal[s] - whole * total[s], 0
        for i in sorted((i for i in docs if source[i] == s), key=lambda i: (hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), i)):
            before += size[i]
            taken[i] = whole + (before - size[i] / 2 <= extra) if size[i] else 0
    return taken


def test_pipeline_equals_brute_force(spark):
    """Each stage of the pipeline on all that the one before it kept, against plain code."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema.simpleString()
    table = {r.doc_id: r for r in docs.collect()}
    source = {i: r.source for i, r in table.items()}
    want = {i: r.text for i, r in table.items() if plain_quality(r.text)}
    steps = dict(corpus_pipeline.STAGES)
    names = list(steps)
    assert names == ["quality_rules", "near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    for name, plain in zip(names[:3], (lambda d: d, plain_near, plain_cut)):
        want = plain(want)
        docs = stage(steps[name](spark, docs, SF), name)
        assert docs.schema.simpleString() == schema
        assert {r.doc_id: r.text for r in docs.collect()} == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    taken = plain_mix(want, source)
    docs = stage(steps[names[3]](spark, docs, SF), names[3])
    assert docs.schema.simpleString() == schema and collections.Counter(r.doc_id for r in docs.collect()) == collections.Counter({i: n for i, n in taken.items() if n})
    tool = Tokenizer.from_file(packing.tokenizer_path())
    lengths, pieces = [], collections.Counter()
    for i, n in taken.items():
        whole = len(tool.encode(want[i], add_special_tokens=False).ids) + 1
        for k, lo in enumerate(range(0, whole, 2048)):
            pieces[i, k, lo, min(2048, whole - lo)] += n
            lengths += [min(2048, whole - lo)] * n
    out = steps[names[4]](spark, docs, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in out) == +pieces
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((f for f in free if f >= n), default=None)
        if fit is None:
            free.append(2048 - n)
        else:
            free[free.index(fit)] -= n
    assert len({r.sequence_id for r in out}) == len(free)


def test_pipeline_runs_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
