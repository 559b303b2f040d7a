"""Words around a candidate, and the confidence they add or take."""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from typing import NamedTuple

ALNUM = frozenset(string.ascii_letters + string.digits)
_LOWER = {ord(u): l for u, l in zip(string.ascii_uppercase, string.ascii_lowercase)}
_WORD = re.compile(r"[\w:=-]+")
_CODE = frozenset("= var let const fn function".split())


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


class Window(NamedTuple):
    """How far to look, and what hits are worth."""

    before: int = 5
    after: int = 3
    one: float = 0.10
    more: float = 0.15
    code: float = 0.20


DEFAULT = Window()


def words_before(text: str, end: int, count: int) -> list[str]:
    """The last words that end by ``end``, ASCII lower-cased; reads backwards, never the whole text."""
    reach = 160
    while count:
        start = max(0, end - reach)
        found = _WORD.findall(ascii_lower(text[start:end]))
        # The first word may be cut where the slice begins, so one more is wanted.
        if start == 0 or len(found) > count:
            return found[-count:]
        reach *= 4
    return []


def words_after(text: str, start: int, count: int) -> list[str]:
    """The first words from ``start`` on, ASCII lower-cased."""
    reach = 80
    while count:
        found = _WORD.findall(ascii_lower(text[start: start + reach]))
        if start + reach >= len(text) or len(found) > count:
            return found[:count]
        reach *= 4
    return []


#: Texts up to this length are split into words once for all their findings.
_SHORT = 400
_SPLIT: tuple[str, list[int], list[str]] = ("", [], [])


def _words_around(text: str, start: int, end: int, before: int, after: int) -> tuple[list[str], list[str]]:
    """What words_before and words_after give, from the words of the text at hand, which are kept."""
    global _SPLIT
    known = _SPLIT
    if known[0] is not text:
        found = [(m.start(), m.group()) for m in _WORD.finditer(ascii_lower(text))]
        _SPLIT = known = (text, [s for s, _ in found], [w for _, w in found])
    _, starts, words = known
    i = bisect_left(starts, start)
    left = words[max(0, i - before): i] if before else []
    if left and starts[i - 1] + len(left[-1]) > start:
        left[-1] = left[-1][: start - starts[i - 1]]
    j = i if end == start else bisect_left(starts, end)
    if j and starts[j - 1] + len(words[j - 1]) > end:
        return left, [words[j - 1][end - starts[j - 1]:], *words[j: j + after - 1]] if after else []
    return left, words[j: j + after]


def adjustment(text: str, start: int, end: int, terms: tuple[str, ...], window: Window = DEFAULT) -> float:
    """What context adds to a confidence. Terms are searched in the joined words, not word by word."""
    if len(text) <= _SHORT:
        before, after = _words_around(text, start, end, window.before, window.after)
    else:
        before, after = words_before(text, start, window.before), words_after(text, end, window.after)
    hay = " ".join(before + after)
    hits = 0
    for t in terms:
        if t in hay:
            hits += 1
    gain = 0.0 if not hits else window.one if hits == 1 else window.more
    return gain if _CODE.isdisjoint(before[-3:]) else gain - window.code


def clamp(value: float) -> float:
    return min(1.0, max(0.0, value))


def free(text: str, start: int, end: int, before: frozenset[str], after: frozenset[str] | None = None) -> bool:
    """Neither neighbour of the span continues it."""
    if start and text[start - 1] in before:
        return False
    return end >= len(text) or text[end] not in (before if after is None else after)
