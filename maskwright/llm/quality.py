"""Quality rules with suffix-array repetition.

Base rules count words, symbols, repeated lines and words in repeated 3-word
windows. The repetition rule builds a suffix array over the words of a text by
prefix doubling, takes the longest common prefixes of neighbouring suffixes,
unions the spans of all repeated substrings of at least ``MIN_REPEAT`` words and
rejects a text if these spans cover more than ``MAX_COVERED`` percent of its words
or if a substring of ``LONGEST`` words or more repeats. Doubling ends once all
ranks differ or lengths pass ``LONGEST``, so memory is a few integers a word.

Defined cases: a null text has no words and fails the base rules, as does an empty
one; very long texts are judged whole; repeated rows count each; an empty table
gives no rows; other columns are kept by ``keep_good`` and ignored by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm._store import prepare

MIN_WORDS = 50
MAX_REPEAT_WORDS = 50
MIN_REPEAT = 16
MAX_COVERED = 30
LONGEST = 128
SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long"


def _pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of pairs, in the order of the pairs, and their number."""
    key = first.astype(np.int64) * (int(second.max()) + 2) + (second + 1)
    uniq, rank = np.unique(key, return_inverse=True)
    return rank.astype(np.int32), len(uniq)


def repeats(ids: np.ndarray, least: int = MIN_REPEAT, longest: int = LONGEST) -> tuple[int, int]:
    """Words within repeated substrings of at least ``least`` words, and the longest repeat.

    The latter is exact below ``longest`` and at least ``longest`` otherwise.
    """
    n = len(ids)
    if n < least + 1:
        return 0, 0
    rank, distinct = np.unique(ids, return_inverse=True)[1].astype(np.int32), 0
    levels, width = [rank], 1
    while distinct < n and width < min(n, longest):
        second = np.full(n, -1, np.int32)
        second[:-width] = rank[width:]
        rank, distinct = _pairs(rank, second)
        levels.append(rank)
        width *= 2
        if width == 2 and distinct == n:
            break
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        top = levels[j]
        size = 1 << j
        # Repeat the widest level: suffixes may agree beyond it.
        for _ in range(1 if j < len(levels) - 1 else 2):
            x, y = a + lcp, b + lcp
            inside = (x + size <= n) & (y + size <= n)
            same = np.zeros(n - 1, bool)
            same[inside] = top[x[inside]] == top[y[inside]]
            lcp += size * same
    hit = lcp >= least
    if not hit.any():
        return 0, int(lcp.max(initial=0))
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, a[hit], lcp[hit])
    np.maximum.at(reach, b[hit], lcp[hit])
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(reach)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + reach[at], -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), int(lcp.max())


def counts(text: bytes | None) -> tuple[int, ...]:
    """The seven figures of one UTF-8 text."""
    if not text:
        return (0,) * 7
    words = text.split()  # of bytes: splits at \x20 and \x09-\x0D only
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeated = 0
    if n >= 4:
        two = _pairs(ids[:-1], ids[1:])[0]
        _, which, often = np.unique(two[:-1].astype(np.int64) * (len(known) + 1) + ids[2:], return_inverse=True, return_counts=True)
        twice = often[which] > 1
        if twice.any():
            mask = np.zeros(n, bool)
            for k in range(3):
                mask[k: n - 2 + k] |= twice
            repeated = int(mask.sum())
    covered, longest = repeats(ids) if repeated else (0, 0)
    return n, len(b"".join(words).decode("utf-8", "replace")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, covered, longest


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        figures = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)]
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *figures], names=[*batch.schema.names[:-1], *names])


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, the seven figures, base_failed and kept, per row."""
    prepare(docs.sparkSession)
    part = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([*part.schema.fields[:-1], *T.StructType.fromDDL(_COLUMNS).fields])
    found = part.mapInArrow(_judge, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_WORDS * F.col("n_words"))
    worn = (100 * F.col("n_covered_words") > MAX_COVERED * F.col("n_words")) | (F.col("longest_repeat") >= LONGEST)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~worn)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows whose text passes, with all their columns, whatever their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    return judge(whole, "text", ("__row",)).filter("kept").select("__row.*")


def query_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUALITY_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (
  SELECT r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (
  SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM b, (VALUES (3), ({MIN_REPEAT}), ({LONGEST})) AS s(k), unnest(range(1, len(ws) - k + 2)) AS t(i)),
d AS (SELECT r, i, k FROM (SELECT *, count(*) OVER (PARTITION BY r, k, g) AS c FROM g) WHERE c > 1),
c AS (SELECT r, k, count(DISTINCT p) AS n FROM (SELECT r, k, unnest(range(i, i + k)) AS p FROM d) GROUP BY r, k),
j AS (
  SELECT b.*, CAST(coalesce(x.n, 0) AS BIGINT) AS n_repeat_words, coalesce(y.n, 0) AS covered, z.n IS NOT NULL AS long FROM b
  LEFT JOIN c x ON x.r = b.r AND x.k = 3 LEFT JOIN c y ON y.r = b.r AND y.k = {MIN_REPEAT} LEFT JOIN c z ON z.r = b.r AND z.k = {LONGEST}),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * covered > {MAX_COVERED} * n_words OR long) AS kept FROM f
"""
