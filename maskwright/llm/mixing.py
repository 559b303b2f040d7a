"""Mixing sources to target weights, in DataFrame functions only.

Capped water-filling gives every source a target: the total is shared by weight,
sources stop at ``max_epochs`` times their size and the excess goes to the others
by weight until none is above. With caps c and weights w the fixed point is
min(c, w * level), so one ordered pass over the sources finds it. A source's
documents are then taken floor(target / size) times whole; the fractional
repetition takes documents in the order of a seeded digest until the rest of the
target is filled. That order is cut at a digest prefix: sums per prefix find the
one prefix where the target ends, and only its documents are ranked. No task
holds a source. Sources are ranked and summed by ranges where they are many.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; sources of size 0 get target 0; documents of size 0 are taken 0 times;
repeated rows count each; null ids draw as the empty string; an empty table gives
no rows; other columns are carried by ``mixed`` and ignored by ``plan_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm._store import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Sources that are ordered in one task.
ONE_TASK = 100_000
#: Hex digits of the digest prefix: 16 ** 3 cells a source at most.
PREFIX = 3
#: Copies of a source's row, so that a hot source's documents meet it in several tasks.
SALTS = 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate, as scalars."""
    whole = row.select(F.struct(*row.columns).alias("row")).scalar()
    return df.withColumn("__row", whole).select(*df.columns, "__row.*")


def _before(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with the sum of columns over all rows before each one. Up to ``ONE_TASK`` rows are ordered in one task; more are cut into
    ranges that are summed apart, and only a row a range is ordered in one task. Either way the sums are of whole numbers."""
    if df.count() <= ONE_TASK:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return stage(df.select("*", *[F.coalesce(F.sum(a).over(w), F.lit(0).cast(df.schema[a].dataType)).alias(b) for a, b in sums.items()]), "ordered")
    cut = stage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(F.col("__range").alias("r")).agg(*[F.sum(a).alias(a) for a in sums]).select("r", *[F.coalesce(F.sum(a).over(ranges), F.lit(0)).alias(f"__{b}") for a, b in sums.items()])
    met = cut.join(F.broadcast(starts), F.col("__range") == F.col("r"))  # a row a partition
    out = [(F.coalesce(F.sum(a).over(within), F.lit(0)) + F.col(f"__{b}")).cast(df.schema[a].dataType).alias(b) for a, b in sums.items()]
    return stage(met.select(*df.columns, *out), "ordered")


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size), one row per source."""
    per = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    per = _before(per.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"one": "n"}).withColumn("w", w)
    per = per.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("fill", F.col("cap") / F.col("w"))
    per = _before(per, [F.col("fill").asc(), F.col("n").asc()], {"cap": "cap_before", "w": "w_before"})
    per = _with_row(per, per.agg((F.sum("source_size") * float(share)).alias("total"), F.sum("w").alias("w_all")))
    # A source is clamped if, with all that fill up before it clamped, its share would exceed its cap.
    free = F.col("w") * (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    per = per.withColumn("clamped", free >= F.col("cap"))
    full = [F.coalesce(F.sum(F.when(F.col("clamped"), F.col(c))), F.lit(0.0)).alias(f"{c}_sum") for c in ("cap", "w")]
    per = _with_row(per, per.agg(*full))
    rest = F.col("w") * (F.col("total") - F.col("cap_sum")) / (F.col("w_all") - F.col("w_sum"))
    return per.select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(rest).alias("target"))


def plan_mix(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) and the columns in keep, from (doc_id, source, size, *keep)."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = sizes.select("doc_id", "source", "size", *keep, key.alias("key")).withColumn("cell", F.substring("key", 1, PREFIX))
    goal = stage(targets(sizes, share, weights, max_epochs), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    cells = docs.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        cells.withColumn("after", F.sum("cell_size").over(upto))
        .join(goal.select(F.col("source").alias("s"), "extra"), F.col("source").eqNullSafe(F.col("s")))
        .filter(F.col("after") >= F.col("extra"))
        .groupBy("source").agg(F.min(F.struct("cell", (F.col("after") - F.col("cell_size")).alias("before"))).alias("end"))
    )
    goal = goal.join(ends.select(F.col("source").alias("s"), "end"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    goal = goal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "s").withColumnRenamed("salt", "t")
    docs = docs.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    met = docs.join(goal, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t")))
    met = met.withColumn("side", F.when(F.col("end").isNull() | (F.col("cell") < F.col("end.cell")), 1).when(F.col("cell") == F.col("end.cell"), 0).otherwise(-1))
    names = ["doc_id", "size", "source", "source_size", "target", "whole", *keep]
    sure = met.filter(F.col("side") != 0).select(*names, (F.col("side") == 1).alias("more"))
    before = Window.partitionBy("source").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("end.before") + F.sum("size").over(before) - F.col("size") / 2
    edge = met.filter(F.col("side") == 0).withColumn("more", middle <= F.col("extra")).select(*names, "more")
    taken = (F.col("whole") + F.when(F.col("more"), 1).otherwise(0)) * F.col("size")
    return sure.unionByName(edge).select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document's row, with all its columns, as often as the plan takes it."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = stage(whole.withColumn("__id", F.monotonically_increasing_id()), "mix")
    plan = plan_mix(sized.select("doc_id", "source", "size", "__id"), keep=("__id",), **options)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    times = plan.select("__id", times.alias("__times")).filter("__times > 0")
    return sized.select("__row", "__id").join(times, "__id").select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")


def query_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return plan_mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(n - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM p),
f AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, sum(w) OVER () AS w_all,
         coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM w WINDOW o AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, w * (total - cap_before) / (w_all - w_before) >= cap AS clamped FROM f),
g AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap ELSE
         w * (total - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) / (w_all - coalesce(sum(w) FILTER (clamped) OVER (), 0)) END AS target FROM c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
t AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN middle <= extra THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM t
"""
