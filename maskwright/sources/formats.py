"""Format kernels: one text in, its locations with findings and the masked text out."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable
from typing import NamedTuple

from maskwright.functions import masks, resolve
from maskwright.functions.detectors import Finding
from maskwright.operators.engine import Config, mask_text

FORMATS = ("text", "json", "csv", "log", "sql")


class Located(NamedTuple):
    """Findings of one part of a document; spans are relative to ``value``."""

    location: str
    value: str
    findings: list[Finding]
    masked: str | None


class FormatError(ValueError):
    """A document that its format can't read; the message holds none of it."""


def masked(text: str, findings: list[Finding], config: Config) -> str | None:
    if config.strategy is None:
        return None
    return mask_text(text, findings, lambda f: masks.replacement(f, config.strategy))


def _lines(text: str) -> list[tuple[str, str]]:
    """Lines with their ends, as \\n or \\r\\n; no empty last line."""
    out = []
    for piece in re.findall(r"[^\n]*\n|[^\n]+", text):
        body = piece[:-1] if piece.endswith("\n") else piece
        end = piece[len(body):]
        if end and body.endswith("\r"):
            body, end = body[:-1], "\r\n"
        out.append((body, end))
    return out


def scan_text(text: str, config: Config) -> tuple[list[Located], str]:
    found, out = [], []
    for n, (line, end) in enumerate(_lines(text), 1):
        fs = config.findings(line)
        m = masked(line, fs, config)
        found.append(Located(f"line:{n}", line, fs, m))
        out.append((line if m is None else m) + end)
    return found, "".join(out)


def path_matches(pattern: str, path: str) -> bool:
    """Equal, or the parts around ``[*]`` occur in this order anywhere in the path."""
    if pattern == path:
        return True
    if "[*]" not in pattern:
        return False
    at = 0
    for part in filter(None, pattern.split("[*]")):
        at = path.find(part, at)
        if at < 0:
            return False
        at += len(part)
    return True


def _loads(text: str):
    def reject(_: str):
        raise ValueError
    try:
        return json.loads(text, parse_constant=reject)
    except (ValueError, RecursionError):
        raise FormatError("invalid JSON") from None


def scan_json(text: str, config: Config, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), pretty: bool = False) -> tuple[list[Located], str]:
    """String leaves are scanned, keys never; objects come out with sorted keys."""
    found: list[Located] = []

    def walk(v, path: str):
        if isinstance(v, str):
            if (include and not any(path_matches(p, path) for p in include)) or any(path_matches(p, path) for p in exclude):
                return v
            fs = config.findings(v)
            m = masked(v, fs, config)
            if fs:
                found.append(Located(path, v, fs, m))
            return v if m is None else m
        if isinstance(v, list):
            return [walk(x, f"{path}[{i}]") for i, x in enumerate(v)]
        if isinstance(v, dict):
            return {k: walk(v[k], f"{path}.{k}") for k in sorted(v, key=lambda k: k.encode("utf-8", "surrogatepass"))}
        return v

    out = walk(_loads(text), "$")
    return found, json.dumps(out, ensure_ascii=False, indent=2) if pretty else json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def scan_csv(text: str, config: Config, columns: tuple[str, ...] = (), indexes: tuple[int, ...] = (), delimiter: str = ",", header: bool = True) -> tuple[list[Located], str]:
    """Cells of the chosen columns, or of all if none of the chosen exists; ragged rows are errors."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter or ",") if r]
    if any(len(r) != len(rows[0]) for r in rows):
        raise FormatError("rows of different lengths")
    names = rows[0] if header and rows else []
    chosen = {names.index(c) for c in columns if c in names} | set(indexes)
    found, out = [], io.StringIO(newline="")
    write = csv.writer(out, delimiter=delimiter or ",", lineterminator="\n")
    if header and rows:
        write.writerow(names)
    for n, row in enumerate(rows[1:] if header else rows, 1):
        new = list(row)
        for i, cell in enumerate(row):
            if chosen and i not in chosen:
                continue
            fs = config.findings(cell)
            if fs:
                m = masked(cell, fs, config)
                found.append(Located(f"row:{n},column:{i}", cell, fs, m))
                new[i] = cell if m is None else m
        write.writerow(new)
    return found, out.getvalue()


_KEY = re.compile(r"[A-Za-z0-9_.-]+$")


def key_values(line: str) -> list[tuple[int, int]]:
    """Spans of the values of key=value fields; quotes are left out, backslashes escape."""
    spans, i, n = [], 0, len(line)

    def skip(j: int) -> int:
        while j < n and not line[j].isspace():
            j += 1
        return j + 1

    while i < n:
        while i < n and line[i].isspace():
            i += 1
        start = i
        while i < n and line[i] != "=" and not line[i].isspace():
            i += 1
        if i >= n or line[i] != "=" or not _KEY.match(line[start:i]):
            i = skip(i)
            continue
        i += 1
        quote = line[i: i + 1] if line[i: i + 1] in ('"', "'") else ""
        i += len(quote)
        value = i
        while i < n and not (line[i] == quote if quote else line[i].isspace()):
            i += 2 if line[i] == "\\" else 1
        i = min(i, n)
        if value < i:
            spans.append((value, i))
        i = skip(i)
    return spans


def scan_log_line(line: str, config: Config) -> tuple[str, list[Finding], str | None]:
    """(format, findings, masked line) of a line that is JSON, key=value fields or plain text."""
    if line.lstrip()[:1] in ("{", "["):
        try:
            parts, out = scan_json(line, config)
            return "Json", [f for p in parts for f in p.findings], out
        except FormatError:
            pass
    spans = key_values(line)
    found = config.findings(line)
    if not spans:
        return "Plaintext", found, masked(line, found, config)
    for lo, hi in spans:
        for f in config.findings(line[lo:hi]):
            f = f._replace(start=f.start + lo, end=f.end + lo)
            # The value alone is better than a finding that begins in the field's name.
            found = [x for x in found if not (x.entity_type == f.entity_type and x.start < lo and x.end == f.end)]
            if not any((x.entity_type, x.start, x.end) == (f.entity_type, f.start, f.end) for x in found):
                found.append(f)
    found.sort(key=lambda f: f.start)
    return "KeyValue", found, masked(line, found, config)


def scan_log(text: str, config: Config) -> tuple[list[Located], str]:
    found, out = [], []
    for n, (line, _) in enumerate(_lines(text), 1):
        _, fs, m = scan_log_line(line, config)
        found.append(Located(f"line:{n}", line, fs, m))
        out.append(line if m is None else m)
    return found, "".join(x + "\n" for x in out)


_ESCAPED = re.compile(r"''|\\(.)", re.S)


def sql_literals(text: str) -> list[tuple[int, int, int, int]]:
    """(statement, value, start, end) of each literal after VALUES of an INSERT, quotes left out."""
    out, token, i = [], "", 0
    statement = value = 0
    live = False
    while i < len(text):
        c = text[i]
        if c == "'" and live:
            j = i + 1
            while j < len(text):
                if text[j] == "\\":
                    j += 2
                elif text[j] != "'":
                    j += 1
                elif text[j + 1: j + 2] == "'":
                    j += 2
                else:
                    break
            if j >= len(text):
                break  # not closed: left as it is
            out.append((statement, value, i + 1, j))
            value, token, i = value + 1, "", j + 1
            continue
        i += 1
        if c == ";":
            live, token = False, ""
        elif c == "_" or (c.isascii() and c.isalnum()):
            token += c.upper()
        else:
            if token == "INSERT":
                statement, value, live = statement + 1, 0, False
            elif token == "VALUES" and statement:
                live = True
            token = ""
    return out


def scan_sql(text: str, config: Config) -> tuple[list[Located], str]:
    found, out, at = [], [], 0
    for statement, value, lo, hi in sql_literals(text):
        plain = _ESCAPED.sub(lambda m: m.group(1) or "'", text[lo:hi])
        fs = config.findings(plain)
        if fs:
            m = masked(plain, fs, config)
            found.append(Located(f"statement:{statement},value:{value}", plain, fs, m))
            if m is not None:
                out += [text[at:lo], m.replace("'", "''")]
                at = hi
    return found, "".join(out) + text[at:]


def detect_format(path: str) -> str:
    ext = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    return ext if ext in ("json", "csv", "log", "sql") else "text"


def scan_document(text: str, kind: str, config: Config, **options) -> tuple[list[Located], str]:
    scanners: dict[str, Callable] = {"text": scan_text, "json": scan_json, "csv": scan_csv, "log": scan_log, "sql": scan_sql}
    if kind not in scanners:
        raise FormatError(f"unknown format: {kind}")
    return scanners[kind](text, config, **options)


__all__ = ["FORMATS", "FormatError", "Located", "detect_format", "resolve", "scan_document"]
