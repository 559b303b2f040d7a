"""MinHash near-dedup: one-permutation sketches, banded buckets, star-shaped candidates.

Documents with the same set of shingles form a class, found by a digest of the
set; only a class's smallest document goes on. Its sketch (one-permutation hashing
with optimal densification, 16 bits a bin) is cut into bands; classes that agree
on a band share a bucket. A bucket's smallest document is its star centre, and only
pairs of a centre and a member become candidates. A star alone would lose links
between two members that are both unlike the centre. So buckets whose members still
lie in several components after the stars are taken again. In those of more than
``BLOCK`` members, the members whose sketches agree with the centre's in a third of
the bins or more meet once a centre, however many buckets they share with it. Sketches that
agree enough to be a link differ in d bins at most, so a pair that does not meet there has two
members that agree with the centre in less than a third and d bins. These are parted by each
of the ``NEXT`` following bands, twice at most, if they are still more than ``BLOCK``: two documents that are a link agree on half of all bands, so they meet again
in a part. What is left is compared by sketches in blocks of bounded size, and pairs
from different components that may reach the threshold become candidates too.
Nothing is capped.

Every candidate is confirmed on the full sets of both documents. With 32 bands of
4 rows a link at 0.8 shares no bucket with a chance below 1e-7, one at 0.85 below 1e-10.
Candidates of a block are confirmed together, so a set travels once a block and not
once a pair.

Defined cases: a text without words has an empty set and is linked with nothing;
a row without an id is linked with nothing and kept; rows that repeat an id are
documents of their own (their component is the least id that their text reaches),
and ``keep_first`` keeps one row of a component; an empty table gives no rows; other
columns are carried by ``keep_first``, whatever their names, and ignored by
``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm._graph import components
from maskwright.llm._shingles import Sketcher, set_digest, shingle_hashes
from maskwright.llm._store import discard, numbered, prepare, release, stage

BANDS, ROWS = 32, 4
#: Members of a bucket that are compared at once, and the shingles that they may have together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Bands that part a larger bucket, and how often.
NEXT, LEVELS = 15, 2
SALTS = 16
#: Rows of ids or pairs up to which they are broadcast (about 50 bytes a row in memory).
BROADCAST_IDS = 1_000_000


def hopeful(threshold: int, bins: int) -> float:
    """Least share of equal sketch bins of a pair that is worth confirming: five deviations below the mean at the threshold."""
    t = threshold / 100
    return t - 5 * (t * (1 - t) / bins) ** 0.5


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Sketcher(bands, rows)
        for batch in batches:
            sizes, digests, low, high = [], [], [], []
            for t in batch.column(2):
                h = shingle_hashes(t.as_py(), width)
                sizes.append(len(h))
                digests.append(set_digest(h))
                a, b = tool.halves(tool.sketch(h)) if len(h) else (None, None)
                low.append(a)
                high.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, low, high))], names=["ord", "doc_id", "n", "set_id", "low", "high"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [shingle_hashes(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, h)])
            values = np.concatenate(h) if h else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))], names=["node", "hashes"])

    return run


def _bytes(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _alike(bins: int, share: float):
    """Pairs (a, b, low, low) whose sketches agree often enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_bytes(batch.column(2), bins) == _bytes(batch.column(3), bins)).sum(axis=1) >= share * bins
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return run


def _agreement(bins: int):
    """Pairs (centre, node, low, low) with the number of bins in which the sketches agree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_bytes(batch.column(2), bins) == _bytes(batch.column(3), bins)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64())], names=["centre", "node", "same"])

    return run


def _block_pairs(bins: int, threshold: int, share: float):
    """Pairs of two chunks of a bucket that lie in different components and may be links, with the block where they were found."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            own = left["i"][0].as_py() == right["j"][0].as_py()
            x, y = _bytes(left["low"], bins), np.ascontiguousarray(_bytes(right["low"], bins).T)  # a row a bin: sums run along rows
            (ld, lc, ln), (rd, rc, rn) = ([t[c].to_numpy() for c in ("node", "component", "n")] for t in (left, right))
            for k in range(len(ld)):
                may = (rc != lc[k]) & (100 * np.minimum(rn, ln[k]) >= threshold * np.maximum(rn, ln[k]))
                if own:
                    may &= rd > ld[k]
                at = np.flatnonzero(may)
                if len(at):
                    at = at[(y[:, at] == x[k][:, None]).sum(axis=0, dtype=np.uint16) >= share * bins]
                    found.append((np.minimum(rd[at], ld[k]), np.maximum(rd[at], ld[k])))
        a, b = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        place = [np.full(len(a), left[c][0].as_py() if len(a) else 0, np.int64) for c in ("key", "i", "j")]
        return pa.table({"a": a, "b": b, "key": place[0], "i": place[1], "j": place[2]})

    return run


def _block_links(threshold: int):
    """Of the pairs of a block, those whose full sets reach the threshold: postings of the block's shingles, a document at a time."""
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        a, b = (pairs[c].to_numpy() for c in ("a", "b"))
        node, listed = sets["node"].to_numpy(), sets["hashes"].combine_chunks()
        order = np.argsort(node)
        a, b = (order[np.searchsorted(node, x, sorter=order)] for x in (a, b))
        size = np.diff(listed.offsets.to_numpy())
        start = np.concatenate([[0], np.cumsum(size)])
        _, term = np.unique(listed.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(node)), size)[np.argsort(term, kind="stable")]
        df = np.bincount(term)
        first = np.cumsum(df) - df
        by = np.argsort(a, kind="stable")
        a, b, both = a[by], b[by], np.empty(len(a), np.int64)
        cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]) if len(a) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            t = term[start[a[lo]]: start[a[lo] + 1]]
            many = df[t]
            at = np.repeat(first[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            both[lo:hi] = np.bincount(owner[at], minlength=len(node))[b[lo:hi]]
        ok = 100 * both >= threshold * (size[a] + size[b] - both)
        return pa.table({"a": node[a[ok]], "b": node[b[ok]]})

    return run


def _few(df: DataFrame) -> DataFrame:
    """Ids or pairs to broadcast where their number is within the bound, else as they are."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _band_key(band: Column, rows: int, own: Column, *more: Column) -> Column:
    """A key of a sketch's band; its last byte names the bucket's own band."""
    return F.shiftleft(F.xxhash64(band, *[F.substring(c, band * rows + 1, F.lit(rows)) for c in ("low", "high")], *more), 8).bitwiseOR(own)


def _buckets(entries: DataFrame) -> DataFrame:
    """(key, node, centre) of buckets with two members or more; of buckets with the same members, one."""
    ends = stage(entries.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last"), "ends")
    live = stage(entries.join(_few(ends.select("key", "centre")), "key").select("key", "node", "centre"), "live")
    mark = live.groupBy("key", "centre").agg(F.count("*").alias("m"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("mark"))
    first = mark.groupBy("m", "centre", "last", "mark").agg(F.min("key").alias("key")).select("key")
    out = stage(live.join(_few(first), "key", "left_semi"), "buckets")
    discard(ends)
    discard(live)
    return out


def _split(live: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component) of the buckets with members of several components."""
    named = labels.select(F.col("node").alias("at"), "component")
    member = live.join(named, F.col("node") == F.col("at"), "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = member.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("key")
    return member.join(several, "key", "left_semi")


def _star_links(stars: DataFrame, info: DataFrame, sets: DataFrame, threshold: int, bins: int) -> DataFrame:
    """Links (a, b) among pairs of a centre and a member."""
    def of(name: str, suffix: str) -> DataFrame:
        return info.select(F.col("node").alias(name), F.col("n").alias(f"n{suffix}"), F.col("low").alias(f"s{suffix}"))

    pairs = of("b", "2").join(_few(stars), "b").join(of("a", "1"), "a").filter(100 * F.least("n1", "n2") >= threshold * F.greatest("n1", "n2"))
    pairs = stage(pairs.select("a", "b", "s1", "s2").mapInArrow(_alike(bins, hopeful(threshold, bins)), "a long, b long"), "pairs")
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")).join(_few(pairs), "b")
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    met = two.join(one.join(_few(pairs.select("a").distinct()), "a", "left_semi"), "a").withColumn("both", F.size(F.array_intersect("x", "y")).cast("long"))
    out = stage(met.filter(100 * F.col("both") >= threshold * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"), "links")
    discard(pairs)
    return out


def _block_step(rest: DataFrame, info: DataFrame, sets: DataFrame, threshold: int, bins: int) -> DataFrame:
    """Links (a, b) among all pairs of a bucket from different components."""
    spark = rest.sparkSession
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    rest = rest.join(info.select("node", "n", "low"), "node")
    chunks = rest.groupBy("key").agg(size.alias("chunks"))
    rest = stage(rest.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))), "rest")
    left = rest.withColumn("i", F.col("chunk")).withColumn("j", F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)))
    right = rest.withColumn("j", F.col("chunk")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunk"))))
    # A fixed number of partitions: adaptive coalescing goes by bytes, which are few here, and not by work.
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = ["key", "i", "j"]
    left, right = (t.select(*place, "node", "component", "n", "low").repartition(parts, *place).groupBy(*place) for t in (left, right))
    found = left.cogroup(right).applyInArrow(_block_pairs(bins, threshold, hopeful(threshold, bins)), "a long, b long, key long, i long, j long")
    found = stage(found.groupBy("a", "b").agg(F.min(F.struct(*place)).alias("at")).select("a", "b", "at.*"), "pairs")
    discard(rest)
    # Under other names, as both sides of a cogroup come from one table.
    home = [F.col(x).alias(f"{x}_") for x in place]
    need = found.select(*home, F.col("a").alias("node")).unionByName(found.select(*home, F.col("b").alias("node"))).distinct()
    there = [f"{x}_" for x in place]
    here = sets.join(_few(need), "node").select(*there, "node", "hashes").repartition(parts, *there).groupBy(*there)
    out = stage(found.repartition(parts, *place).groupBy(*place).cogroup(here).applyInArrow(_block_links(threshold), "a long, b long"), "links")
    discard(found)
    return out


def _near_centre(rest: DataFrame, sigs: DataFrame, bins: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Of buckets (key, node, component) of more than BLOCK members: those near the centre, once a centre, and the buckets without pairs that meet there."""
    # Two sketches that may be a link differ in at most this many bins, and so do their numbers of bins that agree with the centre's.
    least, apart = bins // 3, int(bins - share * bins)
    large = rest.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("centre")).filter(F.col("m") > BLOCK).select("key", "centre")
    large = stage(large, "large")
    hot = stage(rest.join(_few(large), "key"), "hot")
    cool = rest.join(_few(large), "key", "left_anti")
    met = hot.select("centre", "node").distinct().join(sigs.select("node", F.col("low").alias("y")), "node")
    met = met.join(sigs.select(F.col("node").alias("centre"), F.col("low").alias("x")), "centre").select("centre", "node", "x", "y")
    same = stage(met.mapInArrow(_agreement(bins), "centre long, node long, same long"), "same")
    named = hot.select("centre", "node", "component").distinct().join(same.filter(F.col("same") >= least), ["centre", "node"])
    near = stage(named.select(F.xxhash64(F.lit("near"), "centre").alias("key"), "node", "component"), "near")
    far = hot.join(same.filter(F.col("same") < least + apart), ["centre", "node"]).select("key", "node", "component")
    several = far.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("key")
    out = stage(cool.unionByName(far.join(several, "key", "left_semi")), "far")
    for t in (large, hot, same):
        discard(t)
    return near, out


def _parted(rest: DataFrame, sigs: DataFrame, labels: DataFrame, bands: int, rows: int) -> DataFrame:
    """Buckets of more than BLOCK members, parted by the bands that follow; the others as they are."""
    for level in range(LEVELS):
        large = rest.groupBy("key").count().filter(F.col("count") > BLOCK).select("key")
        hot = stage(rest.join(large, "key", "left_semi").select("key", "node"), "hot")
        if hot.isEmpty():
            discard(hot)
            break
        cool = rest.join(large, "key", "left_anti")
        wide = hot.join(sigs.select("node", "low", "high"), "node").withColumn("step", F.explode(F.sequence(F.lit(level * NEXT + 1), F.lit((level + 1) * NEXT))))
        own = F.col("key").bitwiseAND(F.lit(255).cast("long"))
        band = F.pmod(own + F.col("step"), F.lit(bands)).cast("int")
        parts = _buckets(wide.select(_band_key(band, rows, own, F.col("key")).alias("key"), "node"))
        rest = stage(cool.unionByName(_split(parts, labels)), "parted")
        discard(hot)
        discard(parts)
    return rest


def _components(docs: DataFrame, width: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """(ord, doc_id, n_shingles, component) of every row of docs (ord, doc_id, text); the component is the least ord that it reaches."""
    spark, bins = docs.sparkSession, bands * rows
    prepare(spark)
    texts = docs.select("ord", "doc_id", F.col("text").cast("binary").alias("text"))
    sigs = stage(texts.mapInArrow(_sketches(width, bands, rows), "ord long, doc_id long, n long, set_id binary, low binary, high binary"), "sketches")
    known = sigs.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    copies = stage(known.groupBy("set_id").agg(F.min("ord").alias("node"), F.count("*").alias("copies")).filter("copies > 1").select("set_id", "node"), "copies")
    heads = known.join(_few(copies), "set_id", "left").filter(F.coalesce("node", "ord") == F.col("ord")).select(F.col("ord").alias("node"), "n", "low", "high")
    entries = heads.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    live = _buckets(entries.select(_band_key(F.col("band"), rows, F.col("band").cast("long")).alias("key"), "node"))
    release(spark)
    ids = _few(live.select("node").distinct())
    info = stage(heads.join(ids, "node", "left_semi"), "info")
    own = texts.filter(F.col("doc_id").isNotNull()).select(F.col("ord").alias("node"), "text").join(ids, "node", "left_semi")
    sets = stage(own.mapInArrow(_sets(width), "node long, hashes array<long>"), "sets")
    stars = stage(live.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = _star_links(stars, info, sets, threshold, bins)
    discard(stars)
    release(spark)
    labels = components(links)
    rest = stage(_split(live, labels), "split")
    discard(live)
    near, rest = _near_centre(rest, info, bins, hopeful(threshold, bins))
    rest = _parted(rest, info, labels, bands, rows)
    more = _block_step(rest.unionByName(near), info, sets, threshold, bins)
    for t in (rest, near, sets, info, labels):
        discard(t)
    release(spark)
    final = components(links.unionByName(more))
    discard(links)
    discard(more)
    head = final.select(F.col("node").alias("at"), "component")
    many = copies.join(head, F.col("node") == F.col("at"), "left").select(F.col("set_id").alias("s"), F.coalesce("component", "node").alias("c1"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t"))
    # A set of very many copies is met in SALTS parts.
    rows_ = sigs.select("ord", "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"), F.pmod(F.xxhash64("ord"), F.lit(SALTS)).cast("int").alias("salt"))
    met = rows_.join(many, (F.col("set_id") == F.col("s")) & (F.col("salt") == F.col("t")), "left").join(head, F.col("ord") == F.col("at"), "left")
    return met.select("ord", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("c1", "component", "ord").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    threshold: least similarity in percent. Shingles have ``width`` words.
    """
    docs, plain = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = _components(docs, width, threshold, bands, rows).withColumnRenamed("component", "component_id")
    if not plain:
        names = docs.select(F.col("ord").alias("o"), F.col("doc_id").alias("named"))
        out = out.join(names, F.col("component_id") == F.col("o")).withColumn("component_id", F.col("named"))
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, width: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The first row of each component, with all its columns, and the rows without an id."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole, _ = numbered(whole)
    out = _components(whole.select("ord", "doc_id", "text"), width, threshold, bands, rows)
    gone = stage(out.filter("component <> ord").select(F.col("ord").alias("o")), "gone")
    return whole.join(_few(gone), F.col("ord") == F.col("o"), "left_anti").select("row.*")


def query_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, threshold=85)


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM w, unnest(range(1, CASE WHEN len(ws) >= 3 THEN len(ws) - 1 WHEN len(ws) > 0 THEN 2 ELSE 1 END)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT a, b FROM e UNION SELECT r.u, e.b FROM r JOIN e ON r.v = e.a),
c AS (SELECT u, min(v) AS m FROM r GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.u = d.doc_id
"""
