"""Removal of bytes that repeat an earlier string of at least 100 bytes.

The method is prefix doubling turned into naming: positions get names (ranks that
only tell equal from unequal) of strings of growing length, and a position leaves
as soon as its name is unique. Doubling over every byte of a corpus sorts some
24 bytes per byte of text and round, so positions are first thinned without loss:

1. Names of 20 bytes. Every 100-byte window picks its anchor, the 20-byte string in
   it with the least hash, leftmost on ties. Equal windows pick equal anchors, so
   windows whose anchor's name is unique are unique and leave.
2. Names of up to 180 bytes. Neighbouring windows with one anchor are a run, and a
   digest of their union names it. Spark sorts the runs by both names: a run with an
   earlier one of its name goes as a whole, and the first run of a name stays in
   question only if its anchor has other names too. One row in some 40 bytes.
3. Names of 100 bytes. Of the runs in question, sorted by anchor and place, each
   window goes if an earlier run of the anchor has it. Anchors with more than ``HOT``
   names have their windows named by digest and grouped instead.

Whole copies of a text are found first, by digest, and skip these steps.

Defined cases: a null text counts as empty; texts under 100 bytes lose nothing by
themselves; repeated rows, rows of the same id and rows without one are ordered by
(id, text), nulls last, and count as documents of their own; very long texts are
cut into overlapping pieces, which changes no result; an empty table gives no
rows; other columns are carried by ``cut`` and ignored by ``removed``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm._shingles import powers
from maskwright.llm._store import discard, numbered, prepare, release, stage

LEAST = 100
GRAM = 20
#: Windows looked at together; bounds memory on very long texts.
PIECE = 1 << 19
SALTS = 16
BROADCAST_IDS = 1_000_000
#: Names of one anchor that a task holds at once, with some 40 windows each.
HOT = 100_000
#: Runs that are cut before they are passed on, some 140 bytes each.
CUT = 100_000
#: Bits of a place in a piece.
_PLACE = np.uint64(2 * PIECE - 1)
_SPREAD = np.int64(0x2545F4914F6CDD1D)
_TABLES = np.random.default_rng(20240612).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(text: bytes, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run of windows with one anchor."""
    out = []
    windows = len(text) - least + 1
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(windows, 0), PIECE):
        piece = data[at: min(at + PIECE, windows) + least - 1]
        up, down = powers(len(piece))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        h = (total[gram:] - total[:-gram]) * down[: len(piece) - gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        # A hash's upper bits and its place in one number: its least is the least hash, leftmost on ties.
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        wide, target = 1, least - gram + 1
        while wide < target:  # least over [i, i + wide) for growing widths
            step = min(wide, target - wide)
            key = np.minimum(key[:-step], key[step:])
            wide += step
        where = (key & _PLACE).view(np.int64)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        out.append((first + at, np.diff(np.append(first, len(where))), h[where[first]].view(np.int64)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _joined(o: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs that half-open spans of texts cover, by text."""
    order = np.lexsort((e, s, o))
    o, s, e = o[order], s[order], e[order]
    # Texts are laid one behind the other, so that one running maximum serves for all.
    width = int(e.max()) + 1
    place = np.cumsum(np.r_[False, o[1:] != o[:-1]]) * width
    reach = np.maximum.accumulate(e + place)
    new = np.flatnonzero(np.r_[True, (s + place)[1:] > reach[:-1]])
    last = np.append(new[1:], len(s)) - 1
    return o[new], s[new], reach[last] - place[last]


def _named_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per run of windows: anchor hash, digest of the windows' union, place.

    Of runs of one name in a batch only the first is for others to meet. The rest repeat it for certain: they come as joined
    spans (start, end) under a hash of their own, so that a string of very many copies is no hot key.
    """
    for batch in batches:
        names, ids, found = [], [], []
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            texts = [t.as_py() for t in part.column(1)]
            each = [runs(t) for t in texts]
            ids.append(np.repeat(part.column(0).to_numpy(), [len(f[0]) for f in each]))
            names += [xxhash.xxh3_64_intdigest(t[a:b]) for t, (first, n, _) in zip(texts, each) for a, b in zip(first.tolist(), (first + n + LEAST - 1).tolist())]
            found += each
        if not names:
            continue
        o, name = np.concatenate(ids), np.array(names, np.uint64).view(np.int64)
        first, n, h = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((first, o, name, h))
        o, name, first, n, h = o[order], name[order], first[order], n[order], h[order]
        again = np.r_[False, (h[1:] == h[:-1]) & (name[1:] == name[:-1])]
        once = ~again
        yield _run_rows(h[once], name[once], o[once], first[once] * 128 + n[once], np.full(once.sum(), -1))
        if again.any():
            own, s, e = _joined(o[again], first[again], first[again] + n[again] + LEAST - 1)
            yield _run_rows(own * _SPREAD + s, np.zeros(len(s), np.int64), own, s, e)


def _run_rows(h, name, o, run, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, name, o, run, e)], names=["h", "name", "ord", "run", "e"])


def _repeated_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by (h, name, ord, run): those that repeat an earlier run of their name (late, with their span's end),
    and the first of each name whose anchor has other names too. Spans go through as they are. Holds one row beside the batch."""
    last: tuple[int, int] | None = None
    pending: tuple[int, int, int] | None = None  # the first run of the last anchor, until it has a second name

    def rows(h, o, r, e) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, o, r, e)], names=["h", "ord", "run", "e"])

    for batch in batches:
        h, name, o, r, e = (batch.column(i).to_numpy() for i in range(5))
        spans = e >= 0
        if spans.any():
            yield rows(h[spans], o[spans], r[spans], e[spans])
            h, name, o, r = (x[~spans] for x in (h, name, o, r))
        if not len(h):
            continue
        new_h = np.r_[last is None or h[0] != last[0], h[1:] != h[:-1]]
        new_n = new_h | np.r_[last is None or name[0] != last[1], name[1:] != name[:-1]]
        group = np.cumsum(new_h)
        second = new_n & ~new_h
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[second]] = True
        if pending is not None:
            if mixed[0]:
                yield rows([pending[0]], [pending[1]], [pending[2]], [-1])
                pending = None
            elif group[-1] > 0:
                pending = None
        keep = ~new_n | second | (new_h & mixed[group])
        if keep.any():
            first, n = r[keep] // 128, r[keep] % 128
            late = ~new_n[keep]
            yield rows(h[keep], o[keep], np.where(late, first, r[keep]), np.where(late, first + n + LEAST - 1, -1))
        if group[-1] > 0 and not mixed[-1]:
            at = int(np.flatnonzero(new_h)[-1])
            pending = (int(h[at]), int(o[at]), int(r[at]))
        last = (int(h[-1]), int(name[-1]))


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run of a text; a batch out per batch in, or per ``CUT`` runs where texts are long."""
    def rows(own, h, at, parts) -> pa.RecordBatch:
        cols = (np.concatenate(x) for x in (h, own, at))
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(parts, pa.binary())], names=["h", "ord", "run", "part"])

    for batch in batches:
        pairs, ends = batch.column(2).flatten(), np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
        h, run = (pairs.field(i).to_numpy() for i in range(2))
        out, lo = ([], [], [], []), 0
        for text, own, hi in zip(batch.column(1), batch.column(0).to_pylist(), ends.tolist()):
            text, at = text.as_py(), run[lo:hi]
            out[0].append(np.full(hi - lo, own))
            out[1].append(h[lo:hi])
            out[2].append(at)
            first = at // 128
            out[3].extend([text[i:j] for i, j in zip(first.tolist(), (first + at % 128 + LEAST - 1).tolist())])
            lo = hi
            if len(out[3]) >= CUT:
                yield rows(*out)
                out = ([], [], [], [])
        if out[3]:
            yield rows(*out)


def _window_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each 100-byte window of all parts, a column a window."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    n = size - LEAST + 1
    start = np.cumsum(size) - size
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    up, down = powers(len(data))
    out = []
    for table in _TABLES:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up, out=total[1:])
        h = (total[at + LEAST] - total[at]) * down[at]
        out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return np.array(out), n


def _late_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by (h, ord, run): spans of windows that an earlier run of the anchor has.

    Windows of an anchor are ordered by one hash and equal where both are. Those of an anchor that may go on in the next batch are kept, in sorted arrays that double.
    """
    last, seen = None, []  # seen: the last anchor's windows

    for batch in batches:
        if not batch.num_rows:
            continue
        h, o, r = (batch.column(i).to_numpy() for i in range(3))
        (x, y), n = _window_hashes(batch.column(3).to_pylist())
        own = np.repeat(np.cumsum(np.r_[False, h[1:] != h[:-1]]), n)
        order = np.lexsort((x, own))
        ow, xs, ys = own[order], x[order], y[order]
        late = np.ones(len(x), bool)
        first = np.r_[True, (ow[1:] != ow[:-1]) | (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])]
        late[order[first]] = False  # lexsort is stable: the first of equal ones is the earliest
        if h[0] == last:
            mine = np.flatnonzero((own == 0) & ~late)
            for known in seen:
                late[mine] |= _among(x[mine], y[mine], *known)
        else:
            seen = []
        if h[-1] != h[0]:
            seen = []
        last = h[-1]
        new = order[(ow == own[-1]) & ~late[order]]
        seen.append((x[new], y[new]))
        while len(seen) > 1 and len(seen[-2][0]) <= 2 * len(seen[-1][0]):
            a, b = (np.concatenate(z) for z in zip(*seen[-2:]))
            order = np.argsort(a, kind="stable")
            seen[-2:] = [(a[order], b[order])]
        row = np.repeat(np.arange(len(n)), n)
        new = late & np.r_[True, ~late[:-1] | (row[1:] != row[:-1])]
        end = late & np.r_[~late[1:] | (row[1:] != row[:-1]), True]
        place = np.repeat(r // 128 - (np.cumsum(n) - n), n) + np.arange(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (o[row[new]], place[new], place[end] + LEAST)], names=["ord", "s", "e"])


def _among(x: np.ndarray, y: np.ndarray, known: np.ndarray, also: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) are among (known, also), sorted by the first."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return (known[at] == x) & (also[at] == y)


def _window_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window of a run, by digest: for anchors with very many names."""
    for batch in batches:
        o, r, parts = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist()
        n = np.fromiter((len(p) - LEAST + 1 for p in parts), np.int64, len(parts))
        names = [xxhash.xxh3_128_digest(p[i: i + LEAST]) for p in parts for i in range(len(p) - LEAST + 1)]
        place = np.repeat(r // 128 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(np.repeat(o, n), pa.int64()), pa.array(place, pa.int64())], names=["name", "ord", "p"])


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs covered by half-open spans."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.column_stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for s, e in zip(batch.column(1), batch.column(2)):
            u = union(np.column_stack([np.array(s.as_py()), np.array(e.as_py())]))
            out.append([{"s": a, "e": b} for a, b in u.tolist()])
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["ord", "spans"])


def _few(df: DataFrame) -> DataFrame:
    """Ids to broadcast where their number is within the bound, else as they are."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (ord, text): all (ord, n_bytes, sha), and (ord, spans) of rows that lose bytes."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select("ord", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    digests = stage(texts.select("ord", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "digests")
    long = digests.filter(F.col("n_bytes") >= LEAST)
    many = long.groupBy("sha").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1")
    many = many.select(F.col("sha").alias("s"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t"))
    copies = stage(long.withColumn("salt", F.pmod(F.xxhash64("ord"), F.lit(SALTS)).cast("int")).join(many, (F.col("sha") == F.col("s")) & (F.col("salt") == F.col("t"))).filter("ord <> first").select("ord", "n_bytes"), "copies")
    once = texts.join(_few(copies.select("ord")), "ord", "left_anti").filter(F.octet_length("text") >= LEAST)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = once.mapInArrow(_named_runs, "h long, name long, ord long, run long, e long").repartition(parts, "h").sortWithinPartitions("h", "name", "ord", "run")
    left = stage(named.mapInArrow(_repeated_runs, "h long, ord long, run long, e long"), "runs")
    release(spark)
    again = left.filter("e >= 0").select("ord", F.col("run").alias("s"), "e")

    open_ = left.filter("e < 0").groupBy("ord").agg(F.collect_list(F.struct("h", "run")).alias("pairs"))
    own = once.join(_few(left.filter("e < 0").select("ord").distinct()), "ord", "left_semi").join(open_, "ord").select("ord", "text", "pairs")
    pieces = own.mapInArrow(_cut_runs, "h long, ord long, run long, part binary")
    # Anchors with more names than one task should hold: at most one in HOT rows.
    hot = stage(left.filter("e < 0").groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > HOT).select(F.col("h").alias("g")), "hot")
    many_hot = hot.count()
    if many_hot:  # they are read twice
        pieces = stage(pieces, "pieces")
        release(spark)
    cool = pieces.join(_few(hot), F.col("h") == F.col("g"), "left_anti") if many_hot else pieces
    late = cool.repartition(parts, "h").sortWithinPartitions("h", "ord", "run").mapInArrow(_late_windows, "ord long, s long, e long")
    if many_hot:
        warm = pieces.join(_few(hot), F.col("h") == F.col("g"), "left_semi").mapInArrow(_window_names, "name binary, ord long, p long")
        lowest = warm.groupBy("name").agg(F.min(F.struct("ord", "p")).alias("at"), F.count("*").alias("n")).filter("n > 1").select(F.col("name").alias("m"), "at")
        hits = warm.join(lowest, F.col("name") == F.col("m")).filter((F.col("ord") != F.col("at.ord")) | (F.col("p") != F.col("at.p")))
        late = late.unionByName(hits.select("ord", F.col("p").alias("s"), (F.col("p") + LEAST).alias("e")))

    spans = again.unionByName(late).unionByName(copies.select("ord", F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))
    spans = spans.groupBy("ord").agg(F.collect_list(F.struct("s", "e")).alias("x")).select("ord", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    out = stage(spans.mapInArrow(_merged, "ord long, spans array<struct<s:long,e:long>>"), "spans")
    for t in (left, pieces, hot, copies):
        discard(t)
    release(spark)
    return digests, out


def _kept(text: bytes, spans: list[dict]) -> bytes:
    ends = [0, *(x["e"] for x in spans)]
    starts = [*(x["s"] for x in spans), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts))


def _hash_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [hashlib.sha256(_kept(t.as_py(), s.as_py())).hexdigest() for t, s in zip(batch.column(1), batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["ord", "cut_sha"])


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_kept(t.as_py(), s.as_py()).decode("utf-8", "ignore") for t, s in zip(batch.column(1), batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["ord", "cut_text"])


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    docs, _ = numbered(docs.select("doc_id", "text"))
    digests, spans = removed(docs)
    texts = docs.select("ord", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    whole = digests.join(spans, "ord", "left")
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]), F.lit(0))
    whole = whole.select("ord", "n_bytes", gone.cast("long").alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.lower(F.hex("sha")).alias("sha"))
    whole = whole.withColumn("n_spans", F.greatest("n_spans", F.lit(0).cast("long")))
    partly = texts.join(_few(spans.select("ord")), "ord", "left_semi").join(spans, "ord").select("ord", "text", "spans")
    out = whole.join(partly.mapInArrow(_hash_kept, "ord long, cut_sha string"), "ord", "left").withColumn("kept_sha256", F.coalesce("cut_sha", "sha"))
    ids = docs.select("ord", "doc_id")
    return out.join(ids, "ord").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes of ``text`` taken out, and n_chars (if there) as it then is.

    Bytes left of a character that a cut went through are dropped with it.
    """
    whole, _ = numbered(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")))
    _, spans = removed(whole.select("ord", "text"))
    ids = _few(spans.select("ord"))
    lost = whole.join(ids, "ord", "left_semi").select("ord", F.col("text").cast("binary").alias("text"), "__row")
    new = lost.select("ord", "text").join(spans, "ord").select("ord", "text", "spans").mapInArrow(_cut_text, "ord long, cut_text string")
    row = F.col("__row").withField("text", F.col("cut_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("cut_text").cast(docs.schema["n_chars"].dataType))
    same = whole.join(ids, "ord", "left_anti").select("__row")
    return same.unionByName(lost.select("ord", "__row").join(new, "ord").select(row.alias("__row"))).select("__row.*")


def query_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
