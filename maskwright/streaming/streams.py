"""Structured Streaming: the batch operators per micro-batch, stateless, append mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.functions.entities import DENY, VARIANTS
from maskwright.operators.engine import Config, scan_column
from maskwright.sources.readers import scan_log_lines


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of text files as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def mask_log_stream(lines: DataFrame, config: Config = Config(), line: str = "value") -> DataFrame:
    """One masked line out per line in; no state."""
    return scan_log_lines(lines, line, config)


def findings_stream(df: DataFrame, keys: list[str], text: str, config: Config = Config()) -> DataFrame:
    """A row per finding of a stream of texts."""
    return scan_column(df.select(*keys, text), text, config).select(*keys, F.inline("findings"))


def counts_by_window(findings: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Findings per type in windows of event time; state is bounded by the watermark."""
    return findings.withWatermark(time, late).groupBy(F.window(time, width), "entity_type").agg(F.count("*").alias("n_findings"))


def write_lines(masked: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append masked lines to text files, each exactly once."""
    writer = masked.select(F.coalesce("masked_line", "value").alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_summary(masked: DataFrame, types: tuple[str, ...] = (*VARIANTS, DENY)) -> DataFrame:
    """Lines, lines with findings, findings and findings by type so far (complete mode); types: those that are counted apart."""
    def of(kind: str) -> Column:
        return F.sum(F.size(F.filter("findings", lambda f: f["entity_type"] == kind)).cast("long"))

    n = F.size("findings")
    each = [of(t).alias(f"t{i}") for i, t in enumerate(types)]
    out = masked.groupBy().agg(F.count("*").alias("lines_scanned"), F.sum((n > 0).cast("long")).alias("lines_with_findings"), F.sum(n.cast("long")).alias("total_findings"), *each)
    counts = F.filter(F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(f"t{i}").alias("n")) for i, t in enumerate(types)]), lambda x: x["n"] > 0)
    return out.select("lines_scanned", "lines_with_findings", "total_findings", F.map_from_entries(counts).alias("findings_by_type"))
