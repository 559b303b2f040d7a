"""Reports on tables of findings: counts, severities, roll-ups, SARIF, audit events, evaluation."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.entities import HIGH, MEDIUM, RANKS, dimension
from maskwright.operators.masking import tag_column

DIMENSION = "entity_type string, tag string, name string, severity string, severity_rank int, sarif_level string"


def entity_dimension(spark: SparkSession) -> DataFrame:
    """One row per type: a fixed table, small enough to broadcast."""
    return spark.createDataFrame(dimension(), DIMENSION)


def severity_column(entity: Column) -> Column:
    return F.when(entity.isin(*HIGH), "high").when(entity.isin(*MEDIUM), "medium").otherwise("low")


def rank_column(severity: Column) -> Column:
    return F.when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)


def by_type(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys, "entity_type").agg(F.count("*").alias("n_findings"))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or a higher one; applied after overlaps are resolved, never before."""
    return findings.filter(rank_column(severity_column(F.col("entity_type"))) >= RANKS[severity])


def _types_map() -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n"))))


def audit_files(findings: DataFrame, path: str = "path") -> DataFrame:
    """Per file: total, map by type, maximal severity; only files with findings."""
    counted = findings.groupBy(path, "entity_type").agg(F.count("*").alias("n"))
    counted = counted.withColumn("rank", rank_column(severity_column(F.col("entity_type"))))
    out = counted.groupBy(path).agg(F.sum("n").alias("total_findings"), _types_map().alias("findings_by_type"), F.max("rank").alias("rank"))
    return out.withColumn("severity", F.element_at(F.array(*map(F.lit, RANKS)), F.col("rank") + 1)).drop("rank")


def audit_root(files: DataFrame, findings: DataFrame, minimum: str = "low") -> DataFrame:
    """One row on all files (path, skipped) and their findings."""
    seen = files.agg(F.sum(F.when(~F.col("skipped"), 1).otherwise(0)).alias("files_scanned"), F.sum(F.col("skipped").cast("int")).alias("files_skipped"))
    counted = by_type(at_least(findings, minimum)).withColumnRenamed("n_findings", "n")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"), _types_map().alias("findings_by_type"), F.coalesce(F.max(rank_column(severity_column(F.col("entity_type")))), F.lit(0)).alias("rank"))
    both = seen.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k")  # a row each
    return both.select(F.coalesce("files_scanned", F.lit(0)).alias("files_scanned"), F.coalesce("files_skipped", F.lit(0)).alias("files_skipped"), "total_findings", "findings_by_type",
                       F.element_at(F.array(*map(F.lit, RANKS)), F.col("rank") + 1).alias("severity"), F.lit(minimum).alias("minimum_severity"))


def audit_events(findings: DataFrame, command: str, source: str = "path") -> DataFrame:
    """One event per finding, without any of its text; add a timestamp where it is written."""
    return findings.select(
        F.lit(command).alias("command"), F.col(source).alias("source"), "location", "entity_type", F.lit("masked").alias("action"), "confidence", "recognizer_id",
        F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.octet_length("text").alias("text_length"),
    )


def write_audit_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, stamped with the time of writing."""
    stamped = events.select(F.unix_millis(F.current_timestamp()).alias("timestamp_unix_ms"), "*")
    stamped.write.mode("append").json(path)


def rule_id(entity: Column) -> Column:
    return F.concat(F.regexp_replace(tag_column(entity), r"^\[|\]$", ""), F.lit("_DETECTED"))


def sarif_results(findings: DataFrame, uri: str = "path") -> DataFrame:
    """One row per SARIF result, flat."""
    e = F.col("entity_type")
    line = F.regexp_extract("location", r"^line:(\d+)$", 1)
    row = F.regexp_extract("location", r"^row:(\d+),", 1)
    start_line = F.when(line != "", line.try_cast("long")).when(row != "", row.try_cast("long") + 1).otherwise(F.lit(1).cast("long"))
    level = F.when(e.isin(*HIGH), "error").when(e.isin(*MEDIUM), "warning").otherwise("note")
    return findings.select(
        rule_id(e).alias("rule_id"), e.alias("entity_type"), level.alias("level"), F.concat(e, F.lit(" detected at "), F.col("location")).alias("message"), F.col(uri).alias("uri"),
        start_line.alias("start_line"), (F.col("start") + 1).cast("long").alias("start_column"), (F.col("end") + 1).cast("long").alias("end_column"),
        F.concat_ws(":", uri, rule_id(e), "location", F.col("start").cast("string")).alias("fingerprint"), "confidence", "recognizer_id", "location",
    )


def sarif_rules(results: DataFrame) -> DataFrame:
    """Rules in order of their ids, with their indexes; at most one row per type."""
    from pyspark.sql import Window

    rules = results.select("rule_id", "entity_type", "level").distinct()
    return rules.withColumn("rule_index", (F.row_number().over(Window.orderBy("rule_id")) - 1).cast("long"))


def _sarif_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules, and flat results as JSON with the columns that order them."""
    rules = sarif_rules(results)
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("start_line").alias("endLine"), F.col("end_column").alias("endColumn"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.lit("fail").alias("kind"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints"),
        F.struct(F.col("entity_type").alias("entityType"), "confidence", F.col("recognizer_id").alias("recognizerId"), F.col("location").alias("adapterLocation")).alias("properties"),
    )
    index = F.broadcast(rules.select("rule_id", "rule_index"))  # a row per type
    return rules, results.join(index, "rule_id").select("uri", "start_line", "start_column", "fingerprint", F.to_json(result).alias("value"))


def _sarif_head(rules: DataFrame, tool: str) -> str:
    listed = [
        {
            "id": r.rule_id, "name": r.entity_type, "shortDescription": {"text": f"{r.entity_type} detected"}, "fullDescription": {"text": f"A possible {r.entity_type} value was found."},
            "defaultConfiguration": {"level": r.level}, "properties": {"precision": "high", "tags": ["pii", "privacy", "security"]},
        }
        for r in rules.orderBy("rule_index").collect()  # a row per type
    ]
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": listed}}, "results": []}]}
    return json.dumps(head).removesuffix("]}]}")


def sarif_lines(findings: DataFrame, uri: str = "path", tool: str = "maskwright") -> Iterator[str]:
    """The SARIF 2.1.0 document in pieces: its head, a result at a time in order, its end. Holds one partition."""
    rules, results = _sarif_results(sarif_results(findings, uri))
    yield _sarif_head(rules, tool)
    comma = ""
    for r in results.orderBy("uri", "start_line", "start_column", "fingerprint").toLocalIterator():
        yield comma + r.value
        comma = ","
    yield "]}]}"


def write_sarif(findings: DataFrame, path: str, uri: str = "path", tool: str = "maskwright") -> None:
    """Write the SARIF document as one file: executors sort and write the results, the driver only joins their files byte by byte.

    Texts are scanned once: rules and order come from the flat results, which are written first. Each result has a line of its own, for read_sarif.
    """
    spark = findings.sparkSession
    work = f"{path}.parts"
    flat, parts = f"{work}/flat", f"{work}/text"
    sarif_results(findings, uri).write.mode("overwrite").parquet(flat)
    rules, results = _sarif_results(spark.read.parquet(flat))
    # Each result ends in a comma and a line end; the last comma is made harmless by leaving the last result's out.
    results.orderBy("uri", "start_line", "start_column", "fingerprint").select("value").write.mode("overwrite").option("lineSep", ",\n").text(parts)
    hadoop, copy = spark._jvm.org.apache.hadoop, spark._jvm.org.apache.commons.io.IOUtils.copyLarge
    conf = spark._jsc.hadoopConfiguration()
    folder, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    files = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen())
    out = fs.create(target, True)
    out.write(bytearray(f"{_sarif_head(rules, tool)}\n".encode()))
    for k, (name, size) in enumerate(files):
        source = fs.open(hadoop.fs.Path(folder, name))
        copy(source, out, 0, size - 2 * (k == len(files) - 1))
        source.close()
    out.write(bytearray(b"\n]}]}"))
    out.close()
    fs.delete(hadoop.fs.Path(work), True)


def read_sarif(spark: SparkSession, path: str, result: str) -> DataFrame:
    """(version, r): a row per result of a SARIF document, as a struct of the given type.

    A document of write_sarif is read in splits, line by line; others are read whole, by one task.
    """
    lines = spark.read.text(path)
    value = F.col("value")
    head = lines.filter(value.startswith('{"$schema"') & value.endswith('"results": [')).first()
    if head is None:
        whole = spark.read.schema(f"version string, runs array<struct<results:array<{result}>>>").json(path, multiLine=True)
        return whole.select("version", F.explode(F.flatten("runs.results")).alias("r"))
    version = json.loads(head.value + "]}]}")["version"]
    return lines.filter(value.startswith('{"ruleId"')).select(F.lit(version).alias("version"), F.from_json(F.regexp_replace("value", ",$", ""), result).alias("r"))


def check_sarif(text: str) -> None:
    """Raise if a SARIF document lacks a required field."""
    log = json.loads(text)
    if log.get("version") != "2.1.0" or not isinstance(log.get("$schema"), str) or not log.get("runs"):
        raise ValueError("version, $schema and a run are required")
    run = log["runs"][0]
    if not isinstance(run["tool"]["driver"].get("name"), str) or not isinstance(run["tool"]["driver"].get("rules"), list) or not isinstance(run.get("results"), list):
        raise ValueError("a run needs a tool with rules, and results")
    for r in run["results"]:
        at = r["locations"][0]["physicalLocation"]
        if not (isinstance(r["ruleId"], str) and isinstance(r["level"], str) and isinstance(r["message"]["text"], str) and isinstance(at["artifactLocation"]["uri"], str) and isinstance(at["region"]["startLine"], int)):
            raise ValueError("a result lacks a required field")


def evaluate(expected: DataFrame, predicted: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of multisets of (id, entity_type, start, end), by given columns.

    Duplicates match as often as both sides have them. Measures without a base are null.
    """
    key = ["id", "entity_type", "start", "end"]
    extra = [c for c in by if c not in key]
    left = expected.groupBy(*key, *extra).agg(F.count("*").alias("n_expected"))
    right = predicted.groupBy(*key, *extra).agg(F.count("*").alias("n_predicted"))
    both = left.join(right, [*key, *extra], "full_outer").na.fill(0, ["n_expected", "n_predicted"])
    tp = F.least("n_expected", "n_predicted")
    out = both.groupBy(*by).agg(F.sum(tp).alias("tp"), F.sum(F.col("n_predicted") - tp).alias("fp"), F.sum(F.col("n_expected") - tp).alias("fn"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
