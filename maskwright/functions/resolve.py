"""Set operators on a text's findings: lists, threshold, overlaps, numbering, restoring."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterable
from itertools import pairwise

from maskwright.functions.detectors import Detector, Finding
from maskwright.functions.entities import DENY, prefix

DENY_ID = "deny_list_v1"
NESTED = "url_query_"


def literal_spans(text: str, literals: Iterable[str]) -> list[tuple[int, int]]:
    """Occurrences of each literal, left to right and not overlapping themselves."""
    return [m.span() for x in literals if x for m in re.finditer(re.escape(x), text)]


def _union(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs that spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _meets(starts: list[int], ends: list[int], f: Finding) -> bool:
    """Whether a run overlaps a finding: only the last one that begins before its end can."""
    at = bisect_left(starts, f.end) - 1
    return at >= 0 and f.start < ends[at]


def _overlap(a: Finding, b: Finding) -> bool:
    return a.start < b.end and b.start < a.end


def _winner(left: Finding, right: Finding) -> Finding:
    a, b = left.end - left.start, right.end - right.start
    return right if b > a or (b == a and right.confidence > left.confidence) else left


def _ordered(findings: Iterable[Finding]) -> list[Finding]:
    return sorted(findings, key=lambda f: (f.start, -f.end))


def _apart(ordered: list[Finding]) -> bool:
    """Whether no two of the findings overlap."""
    return len(ordered) < 2 or all(a.end <= b.start for a, b in pairwise(ordered))


def report(findings: Iterable[Finding]) -> list[Finding]:
    """Resolve overlaps for reporting; values found within a URL stay beside it."""
    ordered = _ordered(findings)
    if _apart(ordered):
        return ordered
    kept: list[Finding] = []
    live = 0
    for f in ordered:
        while live < len(kept) and kept[live].end <= f.start:
            live += 1
        nested = f.recognizer_id.startswith(NESTED)
        if nested and any(kept[i].entity_type == "Url" and kept[i].start <= f.start and f.end <= kept[i].end for i in range(live, len(kept))):
            kept.append(f)
            continue
        at = next((i for i in range(len(kept) - 1, live - 1, -1) if _overlap(f, kept[i])), None)
        if at is None:
            kept.append(f)
            continue
        old = kept[at]
        if (old.start, old.end, old.entity_type) == (f.start, f.end, f.entity_type) and nested != old.recognizer_id.startswith(NESTED):
            kept[at] = f if nested else old
        else:
            kept[at] = _winner(old, f)
    return sorted(kept, key=lambda f: f.start)


def disjoint(findings: Iterable[Finding]) -> list[Finding]:
    """Resolve overlaps for masking: each finding meets only the last one kept."""
    ordered = _ordered(findings)
    if _apart(ordered):
        return ordered
    kept: list[Finding] = []
    for f in ordered:
        if kept and _overlap(f, kept[-1]):
            kept[-1] = _winner(kept[-1], f)
        else:
            kept.append(f)
    return kept


def scan(text: str, detectors: Iterable[Detector], minimum: float = 0.0, exclude: frozenset[str] = frozenset(), allow: tuple[str, ...] = (), deny: tuple[str, ...] = (), overlaps: bool = False) -> list[Finding]:
    """All findings of a text: exclusions, then deny list, allow list, threshold, overlaps, which are kept on demand."""
    found = [f for d in detectors for f in d.scan(text) if f.entity_type not in exclude]
    found += [Finding(DENY, s, e, text[s:e], 1.0, DENY_ID) for s, e in literal_spans(text, deny)]
    if allow:
        starts, ends = _union(literal_spans(text, allow))
        found = [f for f in found if not _meets(starts, ends, f)]
    found = [f for f in found if f.confidence >= minimum]
    return sorted(found, key=lambda f: f.start) if overlaps else report(found)


_STYLES = {"brackets": "[]", "braces": "{}"}
_TAKEN = {s: re.compile(re.escape(o) + r"\s*([^\[\]{}]+_[0-9]+)\s*" + re.escape(c)) for s, (o, c) in _STYLES.items()}


def sanitize(text: str, findings: list[Finding], style: str = "brackets") -> tuple[str, list[tuple[str, Finding]]]:
    """The text with numbered placeholders, and (placeholder, first finding) in order."""
    opening, closing = _STYLES[style]
    taken = {m[1].strip().upper() for m in _TAKEN[style].finditer(text)} if opening in text else set()
    counts: dict[str, int] = {}
    known: dict[tuple[str, str], str] = {}
    mapping, parts, at = [], [], 0
    for f in _ordered(findings):
        if f.start < at:
            continue
        key = (f.entity_type, f.text)
        if key not in known:
            name = prefix(f.entity_type)
            n = counts.get(name, 0) + 1
            while f"{name}_{n}".upper() in taken:
                n += 1
            counts[name] = n
            known[key] = f"{opening}{name}_{n}{closing}"
            mapping.append((known[key], f))
        parts += [text[at: f.start], known[key]]
        at = f.end
    return "".join(parts) + text[at:], mapping


_NUMBERED = re.compile(r"\[\s*(?P<a>[^\[\]{}]+?)_(?P<b>[0-9]+)\s*\]|\{\s*(?P<c>[^\[\]{}]+?)_(?P<d>[0-9]+)\s*\}", re.S)


@functools.lru_cache(maxsize=4096)
def normal(placeholder: str) -> str:
    """Numbered placeholders without inner space and in upper case; others as they are."""
    m = _NUMBERED.fullmatch(placeholder)
    if not m:
        return placeholder
    o, name, n, c = ("[", m["a"], m["b"], "]") if m["a"] is not None else ("{", m["c"], m["d"], "}")
    return f"{o}{''.join(x.upper() if x.isascii() else x for x in name.strip())}_{n}{c}"


def restore(text: str, mapping: Iterable[tuple[str, str]], strict: bool = False) -> str:
    """Put originals back in one pass; what was put back is not searched again."""
    known: dict[str, str] = {}
    for placeholder, original in mapping:
        if placeholder:
            known.setdefault(placeholder if strict else normal(placeholder), original)
    if not known:
        return text
    pattern = _placeholders(tuple(known), strict)
    if strict:
        return pattern.sub(lambda m: known[m.group()], text)
    return pattern.sub(lambda m: known.get(normal(m.group()), m.group()), text)


@functools.lru_cache(maxsize=256)
def _placeholders(known: tuple[str, ...], strict: bool) -> re.Pattern:
    """What finds placeholders, kept as rows often have the same ones."""
    if strict:
        return re.compile("|".join(map(re.escape, sorted(known, key=len, reverse=True))))
    names: dict[str, set[str]] = {"[": set(), "{": set()}
    plain = []
    for p in known:
        m = _NUMBERED.fullmatch(p)
        if m:
            names[p[0]].add(m["a"] if m["a"] is not None else m["c"])
        else:
            plain.append(re.escape(p))
    branches = plain + [
        re.escape(o) + r"\s*(?ai:" + "|".join(re.escape(n) for n in sorted(ns, key=len, reverse=True)) + r")_[0-9]+\s*" + re.escape("]" if o == "[" else "}")
        for o, ns in names.items() if ns
    ]
    return re.compile("|".join(sorted(branches, key=len, reverse=True)))
