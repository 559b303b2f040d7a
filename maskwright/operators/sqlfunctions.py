"""The engine in SQL: a scalar function that masks, and a table function of findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from maskwright.functions import masks
from maskwright.operators.engine import Config, ConfigError, finding_rows, mask_text
from maskwright.shipping import ship_package

ROW = "entity_type string, start int, end int, cstart int, cend int, text string, confidence double, recognizer_id string"


def register(spark: SparkSession, config: Config = Config(), prefix: str = "pii") -> None:
    """Register ``<prefix>_mask(text)`` and ``<prefix>_findings(text)`` for a configuration.

    SELECT pii_mask(text) FROM t;  SELECT id, f.* FROM t, LATERAL pii_findings(t.text) f
    """
    if config.strategy is None or config.strategy.kind == "encrypt":
        raise ConfigError("these functions need a strategy that works without a key")
    ship_package(spark)

    @pandas_udf("string")
    def mask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if t is None else mask_text(t, config.findings(t), lambda f: masks.replacement(f, config.strategy)))

    class Findings:
        def eval(self, text: str):
            if text:
                for r in finding_rows(text, config.findings(text)):
                    r.pop("applies")
                    yield tuple(r.values())

    spark.udf.register(f"{prefix}_mask", mask)
    spark.udtf.register(f"{prefix}_findings", udtf(Findings, returnType=ROW))
