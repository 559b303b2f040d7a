"""A logging formatter whose fields are masked."""

from __future__ import annotations

import logging

from maskwright.api import Scanner

_PLAIN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


def escape(value: str) -> str:
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        value = value.replace(a, b)
    return f'"{value}"'


class MaskingFormatter(logging.Formatter):
    """level=… target="…" message="…" and the record's extra fields, each value masked by itself."""

    def __init__(self, scanner: Scanner | None = None) -> None:
        super().__init__()
        self.scanner = scanner or Scanner()

    def format(self, record: logging.LogRecord) -> str:
        fields = {"message": record.getMessage()} | {k: str(v) for k, v in vars(record).items() if k not in _PLAIN}
        shown = " ".join(f"{k}={escape(self.scanner.mask(v))}" for k, v in fields.items())
        return f"level={record.levelname} target={escape(record.name)} {shown}"
