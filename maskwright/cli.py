"""Command line: scan, stream, audit, pre-commit, sanitize, restore.

Files are read, scanned and counted by Spark; stdin is a stream of lines. Exit
codes: 0 clean, 1 findings, 2 error; sanitize and restore give 0 on success.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections import Counter
from collections.abc import Iterable
from pathlib import Path

from maskwright import config as files
from maskwright.api import Mapping, Sanitizer
from maskwright.functions.entities import RANKS
from maskwright.operators.engine import Config, ConfigError
from maskwright.operators.masking import REDACT, Strategy, hashed, partial
from maskwright.sources import formats
from maskwright.sources.private import write_private

STRATEGIES = {"redact": REDACT, "partial-mask": partial(1, 4), "hash": hashed(), "replace": Strategy("replace")}


def _locale(given: Iterable[str]) -> str:
    """The first that is not universal."""
    known = {"us": "US", "nl": "NL", "uk": "UK", "de": "DE", "fr": "FR", "in": "IN", "br": "BR", "eu": "EU"}
    for x in (y.strip().lower() for g in given for y in g.split(",")):
        if x != "universal":
            if x not in known:
                raise ConfigError(f"unknown locale: {x}")
            return known[x]
    return "Universal"


def build(options: argparse.Namespace) -> Config:
    lists = files.load(options.config)
    if options.strategy == "encrypt":
        raise ConfigError("encryption needs a key and is for columns; see operators.masking")
    exclude = tuple(x for e in options.exclude for x in e.split(",") if x)
    return Config(_locale(options.locale), options.min_confidence, (*exclude, *lists["exclude_entities"]), lists["allow_list"], lists["deny_list"], STRATEGIES[options.strategy])


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _log(options: argparse.Namespace, command: str, rows: Iterable[tuple[str | None, str, dict]]) -> None:
    """Append audit events, which hold no text."""
    if options.audit_log:
        with open(options.audit_log, "a", encoding="utf-8") as out:
            for source, location, f in rows:
                event = {
                    "timestamp_unix_ms": time.time_ns() // 1_000_000, "command": command, "source": source, "location": location, "entity_type": f["entity_type"], "action": "masked", "confidence": f["confidence"],
                    "recognizer_id": f["recognizer_id"], "span_start": f["start"], "span_end": f["end"], "text_length": len(f["text"].encode()),
                }
                out.write(json.dumps(event) + "\n")


def _report(found, files_table, root: str, minimum: str, output: str) -> tuple[str, int]:
    """The roll-up of located findings as text, JSON or SARIF."""
    from maskwright.plans import reports

    found = reports.at_least(found, minimum)
    if output == "sarif":
        text = "".join(reports.sarif_lines(found))
        reports.check_sarif(text)
        return text, len(json.loads(text)["runs"][0]["results"])
    total = reports.audit_root(files_table, found, minimum).first().asDict()
    per = [r.asDict() for r in reports.audit_files(found).orderBy("path").collect()]
    if output == "json":
        return json.dumps({"root": root, **total, "files": per}, indent=2), total["total_findings"]
    lines = [f"audit root: {root}", f"files scanned: {total['files_scanned']}", f"files skipped: {total['files_skipped']}", f"findings: {total['total_findings']}", f"severity: {total['severity'].title()}"]
    if total["findings_by_type"]:
        lines += ["", "findings by type", *(f"  {k}: {n}" for k, n in sorted(total["findings_by_type"].items()))]
    if per:
        lines += ["", "files"]
        for p in per:
            lines += [f"  {p['path']}: {p['total_findings']} findings ({p['severity'].title()})", *(f"    {k}: {n}" for k, n in sorted(p["findings_by_type"].items()))]
    return "\n".join(lines), total["total_findings"]


def _scan_files(paths: list[str], root: str, options: argparse.Namespace, command: str) -> int:
    from pyspark.sql import functions as F

    from maskwright.sources import readers

    config, spark = build(options), _spark()
    if not paths:
        table = spark.createDataFrame([], "path string, format string, value string, skipped boolean")
    else:
        table = readers.read_files(spark, paths)
    scanned = readers.scan_documents(table.filter("not skipped"), "value", config=config, format_column="format").cache()
    unread = scanned.filter("report.error IS NOT NULL").select("path", F.lit(True).alias("skipped"))
    read = table.select("path", "skipped").join(unread.select("path"), "path", "left_anti").unionByName(unread)
    found = readers.located_findings(scanned, ["path"])
    text, n = _report(found, read, root, options.minimum_severity, options.output_format)
    _log(options, command, ((r.path, r.location, r.asDict()) for r in found.toLocalIterator()) if options.audit_log else ())
    if not options.quiet:
        print(text)
    return int(n > 0)


def scan(options: argparse.Namespace) -> int:
    config = build(options)
    kind = options.format or formats.detect_format(options.path)
    extra = {}
    if kind == "csv":
        columns = [c for x in options.columns for c in x.split(",") if c]
        extra = {"columns": tuple(c for c in columns if not c.isdigit()), "indexes": tuple(int(c) for c in columns if c.isdigit())}
    elif kind == "json":
        extra = {"include": tuple(options.include), "exclude": tuple(options.exclude_path), "pretty": True}
    parts, out = formats.scan_document(Path(options.path).read_text(encoding="utf-8"), kind, config, **extra)
    from maskwright.operators.engine import finding_rows

    rows = [(p.location, f) for p in parts for f in finding_rows(p.value, p.findings)]
    _log(options, "scan", ((options.path, where, f) for where, f in rows))
    counts = dict(sorted(Counter(f["entity_type"] for _, f in rows).items()))
    if options.quiet:
        sys.stdout.write(out)
    elif options.output_format == "json":
        listed = [{"location": p.location, "findings": finding_rows(p.value, p.findings), "masked_value": p.masked} for p in parts if p.findings]
        print(json.dumps({"file": options.path, "format": kind, "total_findings": len(rows), "findings_by_type": counts, "findings": listed}, ensure_ascii=False, indent=2))
    elif options.output_format == "sarif":
        from maskwright.plans import reports

        schema = "path string, location string, entity_type string, start int, end int, text string, confidence double, recognizer_id string"
        table = _spark().createDataFrame([(options.path, w, f["entity_type"], f["start"], f["end"], f["text"], f["confidence"], f["recognizer_id"]) for w, f in rows], schema)
        print("".join(reports.sarif_lines(table)))
    else:
        print(f"file: {options.path}\nformat: {kind.title()}\nfindings: {len(rows)}")
        for p in parts:
            if p.findings:
                print(f"\n{p.location}")
                for f in p.findings:
                    print(f"  {f.entity_type} {f.text} confidence={f.confidence:.3f} recognizer={f.recognizer_id}")
    return int(bool(rows))


def stream(options: argparse.Namespace) -> int:
    """stdin to stdout line by line; only counts are kept."""
    config, n, hit, counts = build(options), 0, 0, Counter()
    from maskwright.operators.engine import finding_rows

    for n, line in enumerate(sys.stdin, 1):
        line = line.removesuffix("\n").removesuffix("\r")
        _, found, masked = formats.scan_log_line(line, config)
        sys.stdout.write((line if masked is None else masked) + "\n")
        hit += bool(found)
        counts.update(f.entity_type for f in found)
        _log(options, "stream", ((None, f"line:{n}", f) for f in (finding_rows(line, found) if options.audit_log else ())))
    if not options.quiet:
        total = {"lines_scanned": n, "lines_with_findings": hit, "total_findings": sum(counts.values()), "findings_by_type": dict(sorted(counts.items()))}
        shown = json.dumps(total, indent=2) if options.output_format == "json" else "\n".join(["stream summary", f"lines scanned: {n}", f"lines with findings: {hit}", f"findings: {sum(counts.values())}", *(f"{k}: {v}" for k, v in sorted(counts.items()))])
        print(shown, file=sys.stderr)
    return int(hit > 0)


def audit(options: argparse.Namespace) -> int:
    from maskwright.sources.readers import audit_paths

    return _scan_files(audit_paths(options.path), options.path, options, "audit")


def pre_commit(options: argparse.Namespace) -> int:
    build(options)
    if not options.paths:
        return 0
    return _scan_files(options.paths, "pre-commit", options, "pre-commit")


def _read(path: str) -> str:
    return sys.stdin.read() if path == "-" else Path(path).read_text(encoding="utf-8")


def _write(path: str | None, text: str) -> None:
    sys.stdout.write(text) if path in (None, "-") else Path(path).write_text(text, encoding="utf-8")


def sanitize(options: argparse.Namespace) -> int:
    config = build(options)
    same = {os.path.realpath(p) for p in (options.path, options.output) if p and p != "-"}
    if os.path.realpath(options.mapping) in same:
        raise ConfigError("the mapping must be a file of its own")
    tool = Sanitizer()
    tool.config = config
    clean, mapping = tool.sanitize(_read(options.path), placeholder_style=options.style)
    write_private(options.mapping, mapping.to_json(2), options.force)
    _write(options.output, clean)
    return 0


def restore(options: argparse.Namespace) -> int:
    mapping = Mapping.from_json(Path(options.mapping).read_text(encoding="utf-8"))
    _write(options.output, mapping.restore(_read(options.path), strict=options.strict))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maskwright")
    p.add_argument("--locale", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--strategy", choices=(*STRATEGIES, "encrypt"), default="redact")
    p.add_argument("--min-confidence", type=float, default=0.5)
    p.add_argument("--output-format", choices=("text", "json", "sarif"), default="text")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--config")
    p.add_argument("--audit-log")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path")
    s.add_argument("--format", choices=formats.FORMATS)
    s.add_argument("--columns", action="append", default=[])
    s.add_argument("--include", action="append", default=[])
    s.add_argument("--exclude-path", action="append", default=[])
    sub.add_parser("stream")
    for name in ("audit", "pre-commit"):
        s = sub.add_parser(name)
        s.add_argument("path" if name == "audit" else "paths", **({} if name == "audit" else {"nargs": "*"}))
        s.add_argument("--minimum-severity", choices=tuple(RANKS), default="low")
    for name in ("sanitize", "restore"):
        s = sub.add_parser(name)
        s.add_argument("path", nargs="?", default="-")
        s.add_argument("--mapping", required=True)
        s.add_argument("--output")
        s.add_argument("--force" if name == "sanitize" else "--strict", action="store_true")
        if name == "sanitize":
            s.add_argument("--style", choices=("brackets", "braces"), default="brackets")
    return p


def main(args: list[str] | None = None) -> int:
    options = parser().parse_args(args)
    run = {"scan": scan, "stream": stream, "audit": audit, "pre-commit": pre_commit, "sanitize": sanitize, "restore": restore}[options.command]
    try:
        return run(options)
    except (ConfigError, formats.FormatError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
