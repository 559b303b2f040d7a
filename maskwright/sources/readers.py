"""Tables of documents from files, and per-format scans of text columns."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import resolve
from maskwright.operators.engine import FINDING, FINDING_DDL, Config, ConfigError, finding_rows, scan_column, with_column
from maskwright.operators.masking import with_mask
from maskwright.sources import formats

_PART = pa.struct([("location", pa.string()), ("findings", pa.list_(FINDING)), ("masked_value", pa.string())])
_DOCUMENT = pa.struct([("parts", pa.list_(_PART)), ("masked", pa.string()), ("error", pa.string())])
_DOCUMENT_DDL = f"struct<parts:array<struct<location:string,findings:array<{FINDING_DDL}>,masked_value:string>>,masked:string,error:string>"


def lines(df: DataFrame, text: str = "value", keys: Iterable[str] = ()) -> DataFrame:
    """A row per line with its 1-based number; ends are \\n or \\r\\n, and no empty last line is made."""
    pieces = F.split(F.col(text), "\n", -1)
    pieces = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    out = df.select(*keys, F.posexplode(pieces).alias("__n", "__line"))
    return out.select(*keys, (F.col("__n") + 1).cast("long").alias("line_number"), F.regexp_replace("__line", "\r$", "").alias("line"))


def join_lines(df: DataFrame, keys: Iterable[str], line: str = "line", end: str = "\n") -> DataFrame:
    """Lines put back together per key, in order of their numbers."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_number", line))), lambda x: x[line])
    return df.groupBy(*keys).agg(F.array_join(ordered, end).alias("value"))


def scan_lines(df: DataFrame, text: str = "value", keys: Iterable[str] = (), config: Config = Config()) -> DataFrame:
    """Plain text: a row per line, also without findings, with findings and masked_line."""
    keys = list(keys)
    out = scan_column(lines(df, text, keys), "line", config)
    return out if config.strategy is None else with_mask(out, "masked_line", F.col("line"), F.col("findings"), config.strategy)


def scan_log_lines(df: DataFrame, line: str = "value", config: Config = Config()) -> DataFrame:
    """df with ``format``, ``findings`` and ``masked_line`` of a column of log lines; works on streams."""
    kind = pa.struct([("format", pa.string()), ("findings", pa.list_(FINDING)), ("masked_line", pa.string())])

    def one(t: str | None) -> dict:
        if t is None:
            return {"format": None, "findings": [], "masked_line": None}
        name, found, m = formats.scan_log_line(t, config)
        return {"format": name, "findings": finding_rows(t, found) if name != "Json" else [dict(r, applies=True) for r in _relative(found)], "masked_line": m}

    out = with_column(df, line, "__log", lambda ts: pa.array([one(t) for t in ts], kind), f"struct<format:string,findings:array<{FINDING_DDL}>,masked_line:string>")
    return out.select(*df.columns, "__log.format", "__log.findings", "__log.masked_line")


def _relative(found) -> list[dict]:
    """Rows of findings whose spans are relative to a JSON string, given by their own texts."""
    return [{"entity_type": f.entity_type, "start": f.start, "end": f.end, "cstart": f.start, "cend": f.end, "text": f.text, "confidence": f.confidence, "recognizer_id": f.recognizer_id, "applies": True} for f in found]


def scan_documents(df: DataFrame, text: str, kind: str | None = None, config: Config = Config(), format_column: str | None = None, **options) -> DataFrame:
    """df with ``report``: parts with findings, masked document, error of a document that can't be read."""
    if config.strategy is not None and config.strategy.kind == "encrypt":
        raise ConfigError("encryption is for columns, not for whole documents")

    def one(t: str | None, how: str) -> dict:
        if t is None:
            return {"parts": [], "masked": None, "error": None}
        try:
            parts, out = formats.scan_document(t, how, config, **options)
        except formats.FormatError as e:
            return {"parts": [], "masked": None, "error": str(e)}
        return {"parts": [{"location": p.location, "findings": finding_rows(p.value, p.findings), "masked_value": p.masked} for p in parts], "masked": out, "error": None}

    if format_column is None:
        return with_column(df, text, "report", lambda ts: pa.array([one(t, kind or "text") for t in ts], _DOCUMENT), _DOCUMENT_DDL)
    from maskwright.shipping import ship_package

    ship_package(df.sparkSession)
    i, j = df.columns.index(text), df.columns.index(format_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([one(t, k) for t, k in zip(b.column(i).to_pylist(), b.column(j).to_pylist())], _DOCUMENT)
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "report"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, report {_DOCUMENT_DDL}")


def located_findings(scanned: DataFrame, keys: Iterable[str]) -> DataFrame:
    """A row per finding of ``report``, with its location."""
    parts = scanned.select(*keys, F.inline("report.parts"))
    return parts.select(*keys, "location", "masked_value", F.inline("findings"))


def csv_cells(df: DataFrame, columns: Iterable[str], row_number: str, config: Config = Config()) -> DataFrame:
    """A row per chosen cell of a typed table: row, column_index, column_name, value, findings, masked_value.

    Cells that are null count as empty. Only the chosen columns reach the scan.
    """
    names = list(columns)
    cells = F.explode(F.array(*[F.struct(F.lit(df.columns.index(c)).alias("column_index"), F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in names]))
    out = df.select(F.col(row_number).cast("long").alias("row_number"), cells.alias("c")).select("row_number", "c.*")
    out = scan_column(out, "value", config)
    return out if config.strategy is None else with_mask(out, "masked_value", F.col("value"), F.col("findings"), config.strategy)


def mask_columns(df: DataFrame, columns: Iterable[str], config: Config = Config()) -> DataFrame:
    """df with the chosen string columns masked, all others as they are, and one crossing to Python."""
    names = list(columns)
    text = df.withColumn("__cells", F.array(*[F.coalesce(F.col(c), F.lit("")) for c in names]))
    at = len(df.columns)
    kind = pa.list_(pa.list_(FINDING))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([[finding_rows(t, config.findings(t)) for t in row] for row in b.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], made], names=[*b.schema.names[:at], "__found"])

    from maskwright.shipping import ship_package

    ship_package(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = text.mapInArrow(run, f"{schema}, __found array<array<{FINDING_DDL}>>")
    for i, c in enumerate(names):
        out = with_mask(out, c, F.col(c), F.col("__found")[i], config.strategy)
    return out.drop("__found")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as strings; quoted fields may span lines; ragged rows fail."""
    return spark.read.csv(path, header=True, sep=delimiter or ",", quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=False)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def format_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("json", "csv", "log", "sql"), ext).otherwise(F.lit("text"))


def _ignored(root: Path) -> list[tuple[Path, str, bool]]:
    """(directory, pattern, negated) of every ignore file below root."""
    out = []
    for p in sorted(root.rglob(".gitignore")):
        for line in p.read_text(errors="replace").splitlines():
            line = line.strip()
            if line and not line.startswith("#"):
                out.append((p.parent, line.lstrip("!"), line.startswith("!")))
    return out


def audit_paths(root: str) -> list[str]:
    """Files below a directory in order; hidden ones and those of ignore files are left out."""
    base = Path(root)
    rules = _ignored(base)
    out = []
    for folder, dirs, names in os.walk(base):
        here = Path(folder)

        def hidden(p: Path, is_dir: bool) -> bool:
            if p.name.startswith("."):
                return True
            drop = False
            for top, pattern, negated in rules:
                if top != p.parent and top not in p.parents:
                    continue
                only_dirs, bare = pattern.endswith("/"), pattern.rstrip("/")
                rel = p.relative_to(top).as_posix()
                hit = fnmatch.fnmatch(rel, bare.lstrip("/")) if "/" in bare else fnmatch.fnmatch(p.name, bare)
                if hit and (is_dir or not only_dirs):
                    drop = not negated
            return drop

        dirs[:] = sorted(d for d in dirs if not hidden(here / d, True))
        out += [str(here / n) for n in names if not hidden(here / n, False)]
    return sorted(out)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, format, value, skipped) of the files below a directory of any file system, listed and read by executors.

    Hidden files and folders are left out, as are names that begin with an underscore, which Spark keeps for its own; ignore files
    are a matter of working copies, for which ``audit_paths`` is there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _decoded(files.filter(~F.col("path").rlike(r"/\.[^/]*(/|$)")))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, format, value, skipped) of a list of files; those with NUL bytes or invalid UTF-8 are skipped."""
    return _decoded(spark.read.format("binaryFile").load(paths))


def _decoded(files: DataFrame) -> DataFrame:
    skipped = F.contains("content", F.lit(b"\0")) | ~F.is_valid_utf8(F.col("content").cast("string"))
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(path.alias("path"), format_of(F.col("path")).alias("format"), F.when(~skipped, F.col("content").cast("string")).alias("value"), skipped.alias("skipped"))


__all__ = ["audit_paths", "csv_cells", "join_lines", "lines", "located_findings", "mask_columns", "read_csv", "read_files", "read_text", "read_tree", "resolve", "scan_documents", "scan_lines", "scan_log_lines"]
