"""Scanning and sanitizing of single strings, without Spark."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from maskwright.functions import masks, resolve
from maskwright.functions.detectors import Finding
from maskwright.functions.entities import VARIANTS, kebab
from maskwright.operators.engine import Config, ConfigError, finding_rows, mask_text
from maskwright.operators.masking import REDACT, Strategy

_LOCALES = {x.lower(): x for x in ("Universal", "US", "NL", "UK", "DE", "FR", "IN", "BR", "EU")}


class TextFinding(NamedTuple):
    """A finding; ``start`` and ``end`` index the Python string."""

    entity_type: str
    start: int
    end: int
    text: str
    confidence: float
    recognizer_id: str

    def __repr__(self) -> str:
        return f"TextFinding(entity_type={self.entity_type!r}, start={self.start}, end={self.end}, confidence={self.confidence:.3f})"


class ScanResult(NamedTuple):
    masked_text: str
    findings: tuple[TextFinding, ...]

    def __repr__(self) -> str:
        return f"ScanResult(findings={len(self.findings)})"


def _words(values: Sequence[str], name: str) -> tuple[str, ...]:
    if isinstance(values, str) or not all(isinstance(v, str) for v in values):
        raise TypeError(f"{name} must be a sequence of strings")
    return tuple(values)


def _text(value: str, name: str = "text") -> str:
    if not isinstance(value, str):
        raise TypeError(f"{name} must be a string")
    try:
        value.encode()
    except UnicodeEncodeError:
        raise ValueError(f"{name} holds a lone surrogate") from None
    return value


class _Configured:
    __slots__ = ("config",)

    def __init__(self, strategy: Strategy = REDACT, **options) -> None:
        """Options: locale (universal), min_confidence (0.0), exclude_entities, allow_list, deny_list (none)."""
        if set(options) - {"locale", "min_confidence", "exclude_entities", "allow_list", "deny_list"}:
            raise TypeError(f"unknown options: {sorted(options)}")
        locale = options.get("locale", "universal").lower()
        if locale not in _LOCALES:
            raise ConfigError("unknown locale")
        lists = [_words(options.get(k, ()), k) for k in ("exclude_entities", "allow_list", "deny_list")]
        self.config = Config(_LOCALES[locale], options.get("min_confidence", 0.0), *lists, strategy)

    def __repr__(self) -> str:
        return f"{type(self).__name__}()"


class Scanner(_Configured):
    """Finds and masks; reusable and safe to share between threads."""

    __slots__ = ()

    def scan(self, text: str) -> ScanResult:
        found = self.config.findings(_text(text))
        return ScanResult(self._masked(text, found), tuple(TextFinding(kebab(f.entity_type), *f[1:]) for f in found))

    def mask(self, text: str) -> str:
        return self._masked(text, self.config.findings(_text(text)))

    def _masked(self, text: str, found: list[Finding]) -> str:
        return mask_text(text, found, lambda f: masks.replacement(f, self.config.strategy))


class Mapping:
    """What placeholders stand for. It holds the originals: keep it private. It can't be pickled."""

    __slots__ = ("_entries",)

    def __init__(self, entries: Sequence[dict], /) -> None:
        self._entries = tuple(entries)

    @classmethod
    def from_json(cls, data: str) -> Mapping:
        """Import; entries that contradict themselves or each other are rejected, and never shown."""
        try:
            entries = json.loads(_text(data, "data"))["entries"]
            seen = set()
            for e in entries:
                p = e["placeholder"]
                pair = p[:1] + p[-1:]
                key = f"{p[0]}{p[1:-1].strip().upper()}{p[-1]}" if pair in ("[]", "{}") else p
                length = e["span_end"] - e["span_start"]
                sound = p and key not in seen and length == len(e["original"].encode()) and 0.0 <= float(e["confidence"]) <= 1.0
                kind = e["entity_type"]
                if not sound or not (kind in VARIANTS or isinstance(kind, dict) or kind.startswith("Custom(")):
                    raise ValueError
                seen.add(key)
        except (ValueError, TypeError, KeyError, IndexError, AttributeError):
            raise ValueError("invalid mapping") from None
        return cls(entries)

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps({"entries": list(self._entries)}, ensure_ascii=False, indent=indent)

    def entries(self) -> tuple[dict, ...]:
        return self._entries

    def get(self, placeholder: str) -> dict | None:
        return next((e for e in self._entries if e["placeholder"] == placeholder), None)

    @property
    def style(self) -> str:
        return "braces" if self._entries and self._entries[0]["placeholder"].startswith("{") else "brackets"

    def restore(self, text: str, strict: bool = False) -> str:
        """Put originals back; strict asks for placeholders exactly as given."""
        return resolve.restore(_text(text), ((e["placeholder"], e["original"]) for e in self._entries), strict)

    def __len__(self) -> int:
        return len(self._entries)

    def __repr__(self) -> str:
        n = len(self)
        return f"Mapping(entries={n})"

    def __reduce__(self):
        raise TypeError("a mapping holds original values; export it with to_json()")


class Sanitizer(_Configured):
    """Replaces findings with numbered placeholders that can be put back."""

    __slots__ = ()

    def sanitize(self, text: str, placeholder_style: str = "brackets") -> tuple[str, Mapping]:
        if placeholder_style not in ("brackets", "braces"):
            raise ValueError("placeholder_style must be brackets or braces")
        found = self.config.findings(_text(text))
        clean, mapping = resolve.sanitize(text, found, placeholder_style)
        rows = {id(f): r for f, r in zip(found, finding_rows(text, found))}
        return clean, Mapping([
            {"placeholder": p, "entity_type": f.entity_type, "original": f.text, "span_start": rows[id(f)]["start"], "span_end": rows[id(f)]["end"], "confidence": f.confidence, "recognizer_id": f.recognizer_id}
            for p, f in mapping
        ])
