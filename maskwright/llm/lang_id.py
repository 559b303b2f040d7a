"""Language identification with hyperdimensional profiles.

Letters get random vectors of +1 and -1. A trigram's vector binds (multiplies) its
letters' vectors, permuted (rotated) by their place; a text's vector bundles (adds)
its trigrams' vectors, and a language's prototype bundles the unit vectors of its
training texts. A text has the language whose prototype has the largest cosine.
Every letter of Unicode has a vector of its own, as has the border between words.

Prototypes are fitted on at most ``SAMPLE`` texts a language, those whose hashed id
is least, out of the training part; every text is then judged, whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is
every text if nothing was learned; ties go to the first language by code point;
repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm._store import prepare, stage

WIDTH = 512
SAMPLE = 400
SEED = 11


class Letters(dict):
    """The vector of a code point, drawn from a generator seeded by it; a bounded memory."""

    most = 20_000

    def __missing__(self, code: int) -> np.ndarray:
        if len(self) >= self.most:
            self.clear()
        value = self[code] = np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), WIDTH)
        return value


class Encoder:
    """Turns a text into its vector."""

    def __init__(self) -> None:
        self.letters = Letters()
        self.alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def vector(self, text: str | None) -> np.ndarray | None:
        """The bundle of the text's trigrams; None without letters."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(self.alpha[codes], codes, 0)
        if not codes.any():
            return None
        codes = np.r_[0, codes, 0]
        codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]  # one border between words
        points, at = np.unique(codes, return_inverse=True)
        own = np.stack([self.letters[c] for c in points.tolist()])
        n = len(points)
        kinds, often = np.unique((at[:-2] * n + at[1:-1]) * n + at[2:], return_counts=True)
        bound = np.roll(own, 2, axis=1)[kinds // n**2] * np.roll(own, 1, axis=1)[kinds // n % n] * own[kinds % n]
        return often.astype(np.float32) @ bound.astype(np.float32)


_ENCODER: list[Encoder] = []


def encoder() -> Encoder:
    if not _ENCODER:
        _ENCODER.append(Encoder())
    return _ENCODER[0]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, out = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = encoder().vector(text.as_py())
            if v is not None:
                langs.append(lang)
                # Integers, so that a sum does not depend on the order of its parts.
                out.append(np.rint(v / max(float(np.linalg.norm(v)), 1e-9) * 1_000_000).astype(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.list_(pa.int64()))], names=["lang", "vector"])


def _judge(langs: list[str], prototypes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                v = encoder().vector(text.as_py()) if langs else None
                if v is None:
                    names.append("und")
                    scores.append(0.0)
                else:
                    cos = prototypes @ v.astype(np.float64) / max(float(np.linalg.norm(v)), 1e-9)
                    best = int(np.argmax(cos))
                    names.append(langs[best])
                    scores.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def fit(train: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and unit prototypes from train (doc_id, text, lang); a row a language comes to the driver."""
    prepare(train.sparkSession)
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    w = Window.partitionBy("lang").orderBy("rank", "doc_id")
    ids = train.select("doc_id", "lang", F.xxhash64("doc_id").alias("rank")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample)
    # At most sample ids a language: a bounded table.
    picked = train.join(F.broadcast(stage(ids.select("doc_id").distinct(), "sample")), "doc_id", "left_semi").select("lang", "text")
    vectors = picked.mapInArrow(_vectors, "lang string, vector array<long>")
    sums = vectors.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")).orderBy("lang").collect()
    if not rows:
        return [], np.empty((0, WIDTH))
    matrix = np.array([r["v"] for r in rows], np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [r["lang"] for r in rows], matrix / np.where(norms == 0, 1, norms)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with lang_pred and score."""
    prepare(docs.sparkSession)
    part = docs.select(*keep, "text")
    schema = T.StructType([*part.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return part.mapInArrow(_judge(langs, prototypes), schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def query_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, prototypes = fit(docs.filter(~held_out()))
    out = predict(docs, langs, prototypes)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
