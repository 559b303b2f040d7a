"""The registered detectors, in registry order, which breaks ties.

A detector finds leftmost candidates by a pattern and then filters them; a rejected
candidate is not retried at a later start. Offsets here are code points.
"""

from __future__ import annotations

import ipaddress
import re
import string
from bisect import bisect_right
from collections.abc import Callable, Iterable
from typing import NamedTuple

from maskwright.functions import checksums as ck
from maskwright.functions.context import ALNUM, Window, adjustment, ascii_lower, clamp, free

A, HEX = "A-Za-z0-9", "0-9A-Fa-f"
#: Parts of patterns by name, for ``rx``.
_PARTS = {
    "<b>": r"\b", "<d>": r"\d", "<s>": r"\s", "<AN>": A, "<HX>": HEX, "<cap>": "[A-Z]", "<dd>": r"\d{2}", "<ddd>": r"\d{3}", "<dddd>": r"\d{4}", "<octet>": r"\d{1,3}", "<sep>": r"[\s.-]?", "<gap>": "[ -]?",
    "<UD>": "A-Z0-9", "<58>": "1-9A-HJ-NP-Za-km-z", "<32>": "ac-hj-np-zAC-HJ-NP-Z02-9",
}


def rx(pattern: str) -> re.Pattern:
    for name, part in _PARTS.items():
        pattern = pattern.replace(name, part)
    return re.compile(pattern)


WORDISH = ALNUM | frozenset("_-")
NAMEISH = ALNUM | frozenset("_")


class Finding(NamedTuple):
    entity_type: str
    start: int
    end: int
    text: str
    confidence: float
    recognizer_id: str


class Detector(NamedTuple):
    """A registered detector; no locales means that it always runs."""

    id: str
    entity_type: str
    locales: tuple[str, ...]
    scan: Callable[[str], list[Finding]]
    validate: Callable[[str], bool] = lambda candidate: True


def _terms(listed: str) -> tuple[str, ...]:
    return tuple(listed.split("|"))


def _detector(id_, kind, patterns, check, base, terms="", *, locales=(), before=WORDISH, after=None, needs=None, own_span=False, trim=None, more=None, window=None, shown=None):
    """A detector by patterns. ``base`` gives the confidence of a candidate before context."""
    rules = [rx(p) if isinstance(p, str) else p for p in patterns]
    words = _terms(terms) if terms else ()
    # Cheap tests that no text with a candidate fails, for all patterns or for each.
    whole, each = (None, needs) if isinstance(needs, tuple) else (needs, (None,) * len(rules))

    def scan(text: str) -> list[Finding]:
        if whole and not whole(text):
            return []
        seen, out = set(), []
        for rule, needed in zip(rules, each):
            for m in rule.finditer(text) if needed is None or needed(text) else ():
                s, e = m.span()
                if trim:
                    e = trim(text, s, e)
                if s >= e or (s, e) in seen:
                    continue
                seen.add((s, e))
                c = text[s:e]
                if not check(c) or not free(text, s, e, before, after) or (more and not more(text, s, e, c)):
                    continue
                score = base(c)
                if words:
                    score += adjustment(text, s, e if own_span else s, words, window or Window())
                out.append(Finding(kind, s, e, shown(c) if shown else c, clamp(score), id_))
        if len(rules) > 1:
            out.sort(key=lambda f: f.start)
        return out

    return Detector(id_, kind, tuple(locales), scan, check)


_DIGIT = re.compile(r"\d")


_FACTS: tuple[str, bool, str] = ("", False, "")


def _facts(text: str) -> tuple[str, bool, str]:
    """The text, whether it has a digit, and its lower case: kept for the text at hand, as many detectors ask."""
    global _FACTS
    known = _FACTS
    if known[0] is not text:
        _FACTS = known = (text, _DIGIT.search(text) is not None, text.lower())
    return known


def _numeric(text: str) -> bool:
    return _facts(text)[1]


# What every candidate of a detector holds. These begin with a set of characters, which the search skips to.
_DIGITS_13, _SSN_DIGITS = rx(r"<d>(?:[ -.]?<d>){12}"), rx(r"<ddd>(?:<d>{6}|[- ]<dd>[- ]<dddd>)")
_IBAN_HEAD, _STREET_HEAD, _BASE58_RUN = rx("<cap>{2}<dd>(?: ?[<UD>]){11}"), rx("<d><s>+<cap>"), rx("[13][<58>]{25}")


def _no_digit_beyond(separators: str):
    """No digit follows or precedes behind a single separator."""
    def test(text: str, s: int, e: int, _: str) -> bool:
        back = s >= 2 and text[s - 1] in separators and text[s - 2] in string.digits
        return not back and not (text[e: e + 1] and text[e] in separators and text[e + 1: e + 2] in tuple(string.digits))
    return test


# Email ----------------------------------------------------------------------
_LABEL = rf"[{A}](?:[{A}-]{{0,61}}[{A}])?"
_ATEXTS = frozenset(string.ascii_letters + string.digits + "-~}|{`_^?=+*'&%$#!.")
_AT_DOMAIN = re.compile(rf"@(?:{_LABEL}\.)+[A-Za-z]{{2,63}}")
_EMAIL_TERMS = _terms("contact|email|contact:|mail:|e-mail:|email:")
_BEFORE_MAIL = NAMEISH | {"/"}


def valid_email(candidate: str) -> bool:
    local, at, domain = candidate.partition("@")
    return bool(at and local) and "." in domain and ".." not in domain and domain[0] != "-" and domain[-1] != "-"


def _email_spans(text: str) -> Iterable[tuple[int, int]]:
    """Leftmost candidates, from each @: only the characters before it that may belong to it are looked at."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        if at > done and text[at - 1] == '"':
            q = text.rfind('"', done, at - 1)
            if 0 <= q < at - 2 and not {"\n", "\r"}.intersection(text[q:at]):
                s = q
        else:
            while s > done and text[s - 1] in _ATEXTS:
                s -= 1
        m = _AT_DOMAIN.match(text, at) if s < at else None
        if m:
            done = m.end()
            yield s, done
        at = text.find("@", max(done, at + 1))


def scan_email(text: str) -> list[Finding]:
    out: list[Finding] = []
    if "@" not in text:
        return out
    seen, scheme = 0, False  # whether :// lies between the last white space before ``seen`` and there
    for s, e in _email_spans(text):
        if not valid_email(text[s:e]) or not free(text, s, e, _BEFORE_MAIL, WORDISH):
            continue
        cut = s
        while cut > seen and not text[cut - 1].isspace():
            cut -= 1
        scheme = "://" in text[cut:s] if cut > seen else scheme or "://" in text[max(0, seen - 2): s]
        seen = s
        if scheme:
            continue
        if text[s] == "'" and text[e: e + 1] == "'" and valid_email(text[s + 1: e]):
            s += 1
        c = text[s:e]
        out.append(Finding("Email", s, e, c, clamp((0.80 if c[0] == '"' else 0.95) + adjustment(text, s, s, _EMAIL_TERMS)), "email_regex_v1"))
    return out


# Phone ----------------------------------------------------------------------
_PHONES = (rx(r"\+<octet><sep>(?:\(<d>{2,4}\)|<d>{1,4})(?:<sep><d>{2,6}){2,4}<b>"), rx(r"(?:\(<ddd>\)<s>*|<b><ddd>[-. ])<ddd>[-. ]<dddd><b>"))
#: No text without a match has a phone number of the second kind; the first begins with a plus sign.
_PHONE_TAIL = re.compile(r"\d{3}[-. ]\d{4}")
_PHONE_TERMS = _terms("sms|text|dial|fax|cell|mobile|tel|tel:|phone|call")


def valid_phone(candidate: str) -> bool:
    d = ck.digits(candidate)
    return 7 <= len(d) <= 15 and len(set(d)) > 1 and not ck.luhn(d)


def scan_phone(text: str) -> list[Finding]:
    out: list[Finding] = []
    if not _numeric(text):
        return out
    for rule, needed in zip(_PHONES, ("+" in text, _PHONE_TAIL.search(text))):
        if not needed:
            continue
        # Spans of one rule are disjoint and in order, so one of them can hold a later candidate: the last that begins by it.
        starts, ends = [f.start for f in out], [f.end for f in out]
        for m in rule.finditer(text):
            s, e = m.span()
            at = bisect_right(starts, s) - 1
            if (at >= 0 and e <= ends[at]) or not valid_phone(m.group()) or not free(text, s, e, WORDISH):
                continue
            base = 0.90 if m.group().lstrip().startswith("+") else 0.70
            out.append(Finding("PhoneNumber", s, e, m.group(), clamp(base + adjustment(text, s, s, _PHONE_TERMS)), "phone_regex_v1"))
    return sorted(out, key=lambda f: f.start)


# Cards ----------------------------------------------------------------------
def valid_card(candidate: str) -> bool:
    return 13 <= len(ck.digits(candidate)) <= 19 and ck.luhn(candidate)


def _number_ends(text: str, s: int, e: int, _: str) -> bool:
    if text[s - 1: s] in tuple(string.digits) or text[e: e + 1] in tuple(string.digits):
        return False
    return _no_digit_beyond(" -.")(text, s, e, _)


# Addresses of machines --------------------------------------------------------
_QUAD = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|\Z)){4}(?<!\.)", re.A)


def parse_ip(candidate: str):
    """Not None for an address."""
    if candidate == "::" or not candidate.isascii() or "%" in candidate:
        return None
    if ":" not in candidate and _QUAD.fullmatch(candidate):
        return candidate
    try:
        return ipaddress.ip_address(candidate)
    except ValueError:
        return None


_DOTS, _COLONS = re.compile(r"\.\d{1,3}\."), re.compile(rf":[{HEX}]{{0,4}}:")
_PAIRS, _QUADS = re.compile(rf"[:-][{HEX}]{{2}}[:-]"), re.compile(rf"\.[{HEX}]{{4}}\.")
_INTERNAL = frozenset("cluster svc k8s intranet private corp lan local internal".split())
_INFRA = "ip test dev prod staging queue lb proxy api app web cache redis db worker node server".split()
_CLOUD = tuple(tuple(x.split(".")) for x in "elasticbeanstalk.com cloudfront.net rds.amazonaws.com svc.cluster.local k8s.local compute.internal ec2.internal".split())
_PUBLIC = frozenset("gov edu io net org com".split())
_MACHINE = rx("<b>(?:WORKSTATION|PC|WIN|LAPTOP|DESKTOP)-[A-Z0-9]{6,10}<b>")
_DOMAIN = re.compile(r"(?i)\b" + _LABEL.replace("A-Z", "") + r"(?:\." + _LABEL.replace("A-Z", "") + r")+\b")
_DOMAIN_ASCII = re.compile(r"\b" + _LABEL + r"(?:\." + _LABEL + r")+\b", re.A)
_DOTTED = re.compile(r"\.[A-Za-z0-9]")
_HOST_TERMS = _terms("upstream|remote_host|server_addr|server_name|host:|ssh|ping|nslookup|dns|resolved|connected to|connecting to|machine|instance|node|server|hostname|host")
_HOSTISH = WORDISH | {"."}


_WHOLE_LABEL = re.compile(rf"[{A}](?:[{A}-]*[{A}])?")
_INFRA_LABEL = re.compile(r"(?:\A|(?<=\.))(?:" + "|".join(_INFRA) + r")(?:[0-9-][^.]*)?(?:\.|\Z)")
_CLOUD_ENDS = tuple("." + ".".join(s) for s in _CLOUD)


def valid_label(label: str) -> bool:
    return _WHOLE_LABEL.fullmatch(label) is not None


def _host_class(candidate: str) -> float | None:
    low = ascii_lower(candidate)
    if not _INTERNAL.isdisjoint(low.split(".")):
        return 0.85
    return 0.80 if ("." + low).endswith(_CLOUD_ENDS) or _INFRA_LABEL.search(low) else None


def valid_domain(candidate: str) -> bool:
    if _host_class(candidate) is None:
        return False
    labels = candidate.split(".")
    return len(labels) > 1 and all(valid_label(x) and len(x) < 64 for x in labels) and ascii_lower(labels[0]) not in _PUBLIC


def valid_hostname(candidate: str) -> bool:
    return _MACHINE.fullmatch(candidate) is not None or valid_domain(candidate)


def scan_hostname(text: str) -> list[Finding]:
    out: list[Finding] = []

    def add(s: int, e: int, base: float) -> None:
        out.append(Finding("Hostname", s, e, text[s:e], clamp(base + adjustment(text, s, s, _HOST_TERMS)), "hostname_infra_v1"))

    if _DOTTED.search(text):
        for m in (_DOMAIN_ASCII if text.isascii() else _DOMAIN).finditer(text):
            s, e = m.span()
            c = m.group()
            if valid_domain(c) and free(text, s, e, _HOSTISH) and text[s - 1: s] != "@" and ascii_lower(c[:4]) != "www." and text[max(0, s - 3): s] != "://":
                add(s, e, _host_class(c) or 0.50)
    if "-" in text:
        known = {(f.start, f.end) for f in out}
        for m in _MACHINE.finditer(text):
            if free(text, *m.span(), _HOSTISH) and m.span() not in known:
                add(*m.span(), 0.85)
    return sorted(out, key=lambda f: f.start)


# URLs -------------------------------------------------------------------------
_URL = re.compile(r"(?i)\b(?:(?:https?|ftp)://|www\.)" + "[^" + re.escape("]['" + '"<>`^|{}' + "\\") + r"\s]+")
_URL_TERMS = _terms("redirect|callback|endpoint|website|link|uri|url")
_CLOSERS = {")": "(", "]": "[", "}": "{"}


def valid_host(host: str) -> bool:
    if ascii_lower(host) == "localhost" or (host and parse_ip(host)) or host == "::":
        return True
    return "." in host and all(map(valid_label, host.split(".")))


def valid_url(candidate: str) -> bool:
    _, scheme, rest = candidate.partition("://")
    if not scheme:
        if ascii_lower(candidate[:4]) != "www.":
            return False
        rest = candidate
    authority = re.split(r"[/?#]", rest, maxsplit=1)[0]
    if not authority:
        return False
    host = authority.rpartition("@")[2]
    if host.startswith("["):
        inner, closed, _ = host[1:].partition("]")
        return valid_host(inner if closed else host)
    return valid_host(host.partition(":")[0])


_SPANS: tuple[str, list[tuple[int, int]]] = ("", [])


def url_spans(text: str) -> list[tuple[int, int]]:
    """Spans of URLs: kept for the text at hand, as three detectors ask."""
    global _SPANS
    if "://" not in text and "www." not in _facts(text)[2]:
        return []
    known = _SPANS
    if known[0] is not text:
        _SPANS = known = (text, _url_spans(text))
    return known[1]


def _url_spans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _URL.finditer(text):
        s, e = m.span()
        spare: dict[str, int] = {}  # closing brackets without an opening one, of those met so far
        while e > s:
            c = text[e - 1]
            if c in _CLOSERS:
                if c not in spare:
                    spare[c] = text.count(c, s, e) - text.count(_CLOSERS[c], s, e)
                if spare[c] <= 0:
                    break
                spare[c] -= 1
            elif c not in ".,;:!?":
                break
            e -= 1
        if s < e and valid_url(text[s:e]) and free(text, s, e, WORDISH):
            out.append((s, e))
    return out


def scan_url(text: str) -> list[Finding]:
    return [
        Finding("Url", s, e, text[s:e], clamp((0.90 if ascii_lower(text[s:e]).startswith(("http://", "https://", "ftp://")) else 0.80) + adjustment(text, s, s, _URL_TERMS)), "url_regex_v1")
        for s, e in url_spans(text)
    ]


def _decoded(value: str) -> tuple[str, list[tuple[int, int]]] | None:
    """The percent-decoded value, and for each of its bytes the source bytes."""
    raw, out, where, i = value.encode(), bytearray(), [], 0
    while i < len(raw):
        pair = raw[i + 1: i + 3]
        if raw[i] == 37 and len(pair) == 2 and all(chr(b) in string.hexdigits for b in pair):
            out.append(int(pair, 16))
            where.append((i, i + 3))
            i += 3
        else:
            out.append(32 if raw[i] == 43 else raw[i])
            where.append((i, i + 1))
            i += 1
    try:
        return out.decode(), where
    except UnicodeDecodeError:
        return None


_FIELD = re.compile(r"[^&;]+")


def _query_values(text: str) -> Iterable[tuple[int, int]]:
    for s, e in url_spans(text) if "?" in text else ():
        q = text.find("?", s, e) + 1
        if not q:
            continue
        stop = text.find("#", q, e)
        for m in _FIELD.finditer(text, q, e if stop < 0 else stop):
            eq = m.group().find("=")
            if 0 <= eq < len(m.group()) - 1:
                yield m.start() + eq + 1, m.end()


def _query_scanner(scan: Callable[[str], list[Finding]], id_: str) -> Callable[[str], list[Finding]]:
    def run(text: str) -> list[Finding]:
        out, seen = [], set()

        def add(f: Finding, s: int, e: int) -> None:
            if (f.entity_type, s, e) not in seen:
                seen.add((f.entity_type, s, e))
                out.append(Finding(f.entity_type, s, e, text[s:e], f.confidence, id_))

        for lo, hi in _query_values(text):
            value = text[lo:hi]
            for f in scan(value):
                add(f, lo + f.start, lo + f.end)
            plain = _decoded(value) if "%" in value or "+" in value else None
            if plain and plain[0] != value:
                raw = value.encode()
                for f in scan(plain[0]):
                    a, b = len(plain[0][: f.start].encode()), len(plain[0][: f.end].encode())
                    if a < b <= len(plain[1]):
                        add(f, lo + len(raw[: plain[1][a][0]].decode()), lo + len(raw[: plain[1][b - 1][1]].decode()))
        return sorted(out, key=lambda f: f.start)

    return run


# Home directories -------------------------------------------------------------
_STOP = "[^" + re.escape("]})" + "'" + '";:,`') + r"\s]*"
_HOMES = (
    re.compile("/(?:Users|home)/[a-zA-Z]" + rf"[{A}._-]{{0,31}}(?:/{_STOP})*"),
    re.compile("(?i)[A-Z]:" + r"\\Users" + r"\\[A-Z]" + rf"[{A}._\- ]{{0,31}}(?:\\{_STOP})*"),
    re.compile(rf"/root(?:/{_STOP})*"),
)
_NOBODY = frozenset("placeholder xxx {user} $user testuser myuser yourusername your_username your_user example username user".split())
_PRIVATE = _terms("authorized_keys|id_rsa|.gnupg|credentials|.env|.aws|.ssh")


def user_name(path: str) -> tuple[int, int] | None:
    """Where the user's name lies in a home path."""
    for head in ("/home/", "/Users/"):
        if path.startswith(head):
            return len(head), len(head) + len(path[len(head):].partition("/")[0])
    i = ascii_lower(path).find("\\users\\")
    if i >= 0:
        return i + 7, i + 7 + len(path[i + 7:].partition("\\")[0])
    return (1, 5) if path == "/root" or path.startswith("/root/") else None


def extract_username(path: str) -> str | None:
    at = user_name(path)
    return None if at is None else path[slice(*at)]


def valid_path(candidate: str) -> bool:
    name = extract_username(candidate)
    return name is not None and ascii_lower(name) not in _NOBODY


def _path_base(c: str) -> float:
    base = 0.75 if c == "/root" or c.startswith("/root/") else 0.85
    low = ascii_lower(c)
    return base + (0.05 if any(p in low for p in _PRIVATE) else 0.0)


def _trimmed(ends: str):
    return lambda text, s, e: s + len(text[s:e].rstrip(ends))


# Names and addresses ----------------------------------------------------------
_CAP = r"[A-Z][a-z]{1,24}"
_PERSON = rx(rf"<b>(?:(?:Dr|Ms|Mrs|Mr)\.?<s>+)?({_CAP})(?:<s>+<cap>\.)?<s>+({_CAP}(?:[-']{_CAP})?)<b>")
_GIVEN = frozenset(
    "william thomas susan sarah robert peter paul patricia olivia nancy mohammed michael mary mark maria lisa linda laura julia joseph jose john jennifer jan "
    "jane james isabella hannah george fatima eric emma emily elizabeth david daniel christopher chris charles carla brian benjamin barbara anthony anna alice alex adam aaron".split()
) | {"k" + "adir"}
_FAMILY = frozenset(
    "young wright wilson williams white walker thompson thomas taylor smith sanchez rodriguez roberts perez patel nguyen moore miller martinez martin lewis lee khan "
    "jones johnson jackson harris hall green garcia evans davis clark brown anderson adams".split()
)
_PERSON_TERMS = _terms("dr|ms|mrs|mr|dear|attn|sender|recipient|author|signed by|full name|account holder|person|contact|user|employee|patient|client|customer|name")


_FIRST = re.compile(rf"{_CAP}(?=\s)")


def valid_name(first: str, last: str) -> bool:
    return first.lower() in _GIVEN and all(p.lower() in _FAMILY for p in re.split("[-']", last))


def scan_person(text: str) -> list[Finding]:
    out = []
    if not any(n.lower() in _GIVEN for n in _FIRST.findall(text)):
        return out
    for m in _PERSON.finditer(text):
        if valid_name(m[1], m[2]) and free(text, *m.span(), NAMEISH):
            known = 0.08 if min(len(m[1]), len(m[2])) >= 4 else 0.0
            score = 0.42 + known + adjustment(text, m.start(), m.start(), _PERSON_TERMS)
            out.append(Finding("PersonName", *m.span(), m.group(), clamp(score), "person_name_dictionary_v1"))
    return out


_ROADS = "Street St Avenue Ave Boulevard Blvd Road Rd Drive Dr Lane Ln Court Ct Way Place Pl Terrace Ter Circle Cir Parkway Pkwy".split()
_ROAD = "|".join(_ROADS)
_STREET = rx(
    rf"<b><d>{{1,6}}<s>+(?:<cap>[.'a-z0-9-]*<s>+){{1,4}}(?:{_ROAD})\.?(?:<s>+(?:Unit|Ste|Suite|Apartment|Apt|\#)<s>*[<AN>-]+)?"
    r"(?:,<s>*<cap>['.A-Za-z-]+)?(?:,<s>*<cap>{2})?(?:<s>+<d>{5}(?:-<dddd>)?)?<b>"
)


def valid_street(candidate: str) -> bool:
    low = ascii_lower(candidate)
    return any(" " + r.lower() in low for r in _ROADS) and any(c in string.digits for c in low) and len(low.split()) > 2 and " not found " not in low


def _street_base(c: str) -> float:
    zipped = any(len(p) == 5 and p.isascii() and p.isdecimal() for p in c.split())
    return 0.70 + (0.08 if "," in c or zipped else 0.0)


# Secrets ----------------------------------------------------------------------
_SECRET_TERMS = "credential|bearer|authorization|secret|token|access_token|api key|api_key"
_SECRET_BEFORE = WORDISH | frozenset("+/.")
_SECRET_AFTER = _SECRET_BEFORE | {"="}
_SECRET_BODY = ALNUM | frozenset("_-+/=")
_URLSAFE = rf"[{A}_-]{{8,}}"
_KEYED = re.compile(r"(?i)\b(?:authorization|secret|(?:access[_-]?)?token|api[_-]?key)\b" + r"\s*(?:=>|=|:)\s*(?:bearer\s+)?[\"']?" + r"([A-Z0-9][A-Z0-9_\-+/=]{19,})")


def valid_jwt(candidate: str) -> bool:
    parts = candidate.split(".")
    return len(parts) == 3 and parts[0][:2] == parts[1][:2] == "ey" and all(len(p) >= 8 and all(c in WORDISH for c in p) for p in parts)


class _Chunked:
    """Candidates for tokens in three parts, only in runs of their characters that have a sound second part."""

    rule = re.compile(rf"\b{_URLSAFE}\.{_URLSAFE}\.{_URLSAFE}\b")
    middle = re.compile(rf"\.ey[{A}_-]{{6,}}\.[{A}_-]{{8}}")
    chunk = re.compile(rf"[{A}_.-]+")

    def finditer(self, text: str) -> Iterable[re.Match]:
        hi = 0
        for m in self.middle.finditer(text):
            if m.start() < hi:
                continue
            lo = m.start()
            while lo > hi and (text[lo - 1] in WORDISH or text[lo - 1] == "."):
                lo -= 1
            hi = self.chunk.match(text, lo).end()
            yield from self.rule.finditer(text, lo, hi + 1)  # with the next character, for the word boundary


def valid_secret(candidate: str) -> bool:
    v = candidate.strip("\"',;")
    return len(v) >= 20 and len(set(v)) > 1 and all(c in _SECRET_BODY for c in v)


def scan_api_key(text: str) -> list[Finding]:
    out = []
    if ":" not in text and "=" not in text:
        return out
    for m in _KEYED.finditer(text):
        s, e = m.span(1)
        c = m[1]
        if valid_secret(c) and free(text, s, e, _SECRET_BEFORE, _SECRET_AFTER):
            mixed = any(x in string.ascii_letters for x in c) and any(x in string.digits for x in c) and any(x not in ALNUM for x in c)
            out.append(Finding("ApiKey", s, e, c, clamp((0.85 if mixed else 0.75) + adjustment(text, s, s, _terms(_SECRET_TERMS))), "api_key_context_v1"))
    return out


# Wallets ----------------------------------------------------------------------
_BASE58 = ALNUM - frozenset("0OIl")
_BECH32 = frozenset("023456789acdefghjklmnpqrstuvwxyz")


def valid_wallet(c: str) -> bool:
    low = ascii_lower(c)
    if len(c) == 42 and low.startswith("0x") and all(x in string.hexdigits for x in c[2:]):
        return True
    if 26 <= len(c) <= 35 and c[0] in "13" and all(x in _BASE58 for x in c):
        return True
    return low.startswith("bc1") and 14 <= len(c) <= 74 and c in (low, c.upper()) and all(x in _BECH32 for x in low[3:])


# Dates of birth -----------------------------------------------------------------
_MONTHS = "january february march april may june july august september october november december".split()
_MONTH_NO = {n: i for i, m in enumerate(_MONTHS, 1) for n in (m, m[:3])} | {"sept": 9}
_MONTH = "(?:" + "|".join(sorted((rf"{m[:3]}(?:{m[3:]})?" if m[3:] else m) for m in _MONTHS if m != "september")) + r"|sep(?:t(?:ember)?)?)\.?"
_DATES = (
    rx("<b><dddd>(?:-<d>{1,2}){2}<b>"), rx("<b>(?:<d>{1,2}[/-]){2}<dddd><b>"),
    re.compile(rf"(?i)\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b"), re.compile(rf"(?i)\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b"),
)
_STRONG = _terms("geboortedatum|d.o.b|date of birth|dob")
_BIRTH = (*_STRONG, "birthday", "born", "birth date")


def _int(text: str, most: int) -> int | None:
    return int(text) if text.isascii() and text.isdecimal() and int(text) <= most else None


def _calendar(y: int | None, m: int | None, d: int | None) -> bool:
    if y is None or m is None or d is None or not 1900 <= y <= 2100 or not 1 <= m <= 12:
        return False
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return 1 <= d <= (28 + leap if m == 2 else 30 if m in (4, 6, 9, 11) else 31)


def valid_date(c: str) -> bool:
    parts = c.split("-")
    if len(parts) == 3:
        y, m, d = _int(parts[0], 65535), _int(parts[1], 255), _int(parts[2], 255)
        if None not in (y, m, d):
            return _calendar(y, m, d)
    numbers = [n for n in (_int(p, 65535) for p in c.split("/" if "/" in c else "-")) if n is not None]
    if len(numbers) == 3 and max(numbers[:2]) < 256 and (_calendar(numbers[2], *numbers[:2]) or _calendar(numbers[2], numbers[1], numbers[0])):
        return True
    words = c.replace(",", "").split()
    if len(words) != 3:
        return False
    month = [_MONTH_NO.get(ascii_lower(w.rstrip("."))) for w in words[:2]]
    if month[0]:
        return _calendar(_int(words[2], 65535), month[0], _int(words[1], 255))
    return bool(month[1]) and _calendar(_int(words[2], 65535), month[1], _int(words[0], 255))


def _birth_before(terms):
    def test(text: str, s: int, e: int | None = None, c: str = "") -> bool:
        near = ascii_lower(text[max(0, s - 80): s])
        return any(t in near for t in terms)
    return test


def scan_birth(text: str) -> list[Finding]:
    strong = _birth_before(_STRONG)
    return [f._replace(confidence=clamp(0.76 + (0.15 if strong(text, f.start) else 0.08))) for f in _BIRTH_DATES.scan(text)]


_BIRTH_DATES = _detector(
    "date_of_birth_context_v1", "DateOfBirth", _DATES, valid_date, lambda c: 0.76, before=ALNUM | frozenset("/-."), more=_birth_before(_BIRTH),
    needs=lambda t: _numeric(t) and any(x in _facts(t)[2] for x in ("dob", "d.o.b", "birth", "born", "geboortedatum")),
)

EU = "EU"
_SSN = _detector(
    "us_ssn_regex_v1", "Ssn", [rx("<b>(?:<d>{9}|<ddd>[- ]<dd>[- ]<dddd>)<b>")], lambda c: ck.ssn(ck.digits(c)), lambda c: 0.85 if "-" in c or " " in c else 0.50,
    "taxpayer|tax id|social security|ssn", locales=("US",), needs=_SSN_DIGITS.search,
)


def _locale(id_, kind, pattern, check, base, terms, locales, more=None, window=None, letters=False):
    return _detector(id_, kind, [rx(pattern)], check, lambda c: base, terms, locales=locales, needs=_numeric, own_span=True, more=more, window=window)


REGISTRY: tuple[Detector, ...] = (
    Detector("email_regex_v1", "Email", (), scan_email, valid_email),
    Detector("phone_regex_v1", "PhoneNumber", (), scan_phone, valid_phone),
    _detector("credit_card_luhn_v1", "CreditCard", [rx("<b>(?:<d>[ -.]?){13,19}<b>")], valid_card, lambda c: 0.99 if ck.card_brand(ck.digits(c)) else 0.60, before=frozenset(), more=_number_ends, needs=_DIGITS_13.search, shown=str.strip),
    _detector("iban_mod97_v1", "Iban", [rx("<b><cap>{2}<dd>(?: ?[<UD>]){11,30}<b>")], lambda c: ck.iban(ck.upper_alnum(c)), lambda c: 0.99, "swift|wire|transfer|bank|account|iban", before=frozenset(), needs=_IBAN_HEAD.search),
    _detector("ip_address_std_v1", "IpAddress", [rx(r"(?:<octet>\.){3}<octet>"), rf"[{HEX}]{{0,4}}(?::[{HEX}]{{0,4}}){{2,7}}"], lambda c: parse_ip(c) is not None, lambda c: 0.90 if ":" in c else 0.85,
              "server|host|destination ip|source ip|client_ip|remote_addr|ip address|ip", before=WORDISH | frozenset(".:%"), needs=(_DOTS.search, _COLONS.search)),
    Detector("url_regex_v1", "Url", (), scan_url, valid_url),
    Detector("hostname_infra_v1", "Hostname", (), scan_hostname, valid_hostname),
    _detector("user_path_home_v1", "UserPath", _HOMES, valid_path, _path_base, "in /|from /|at /|stack trace|enoent|filenotfounderror|no such file|not found|denied|permission|write|read|open|config|folder|directory|path|file",
              before=WORDISH | frozenset("./\\"), trim=_trimmed(".,:;!?)]}"), needs=lambda t: "/root" in t or "/home/" in t or "users" in _facts(t)[2]),
    Detector("person_name_dictionary_v1", "PersonName", (), scan_person, lambda c: (m := _PERSON.fullmatch(c)) is not None and valid_name(m[1], m[2])),
    _detector("physical_address_us_v1", "PhysicalAddress", [_STREET], valid_street, _street_base, "recipient|deliver|located at|office|home|residence|mailing|billing|ship to|street|address", before=NAMEISH, trim=_trimmed(".,;)]"), needs=_STREET_HEAD.search),
    _detector("aws_access_key_v1", "AwsAccessKey", [rx("<b>AKIA[A-Z0-9]{16}<b>")], lambda c: len(c) == 20, lambda c: 0.99, _SECRET_TERMS, needs=lambda t: "AKIA" in t),
    _detector("jwt_regex_v1", "Jwt", [_Chunked()], valid_jwt, lambda c: 0.92, _SECRET_TERMS, before=_SECRET_BEFORE, after=_SECRET_AFTER, needs=lambda t: ".ey" in t),
    Detector("api_key_context_v1", "ApiKey", (), scan_api_key, valid_secret),
    _detector("mac_address_regex_v1", "MacAddress", [rf"\b(?:[{HEX}]{{2}}[:-]){{5}}[{HEX}]{{2}}\b", rf"\b[{HEX}]{{4}}\.[{HEX}]{{4}}\.[{HEX}]{{4}}\b"], lambda c: sum(x in string.hexdigits for x in c) == 12, lambda c: 0.82,
              "nic|adapter|bssid|ethernet|hardware address|mac address|mac", before=frozenset(string.hexdigits + ":-."), needs=(_PAIRS.search, _QUADS.search)),
    _detector("crypto_address_regex_v1", "CryptoAddress", [rf"\b0x[{HEX}]{{40}}\b", rx("<b>[13][<58>]{25,34}<b>"), rx("<b>(?:BC1|bc1)[<32>]{11,71}<b>")], valid_wallet,
              lambda c: 0.92 if c[:2] in ("0x", "0X") else 0.86, "deposit|address|eth|ethereum|btc|bitcoin|crypto|wallet", before=NAMEISH, needs=(lambda t: "0x" in t, _BASE58_RUN.search, lambda t: "bc1" in t or "BC1" in t)),
    Detector("date_of_birth_context_v1", "DateOfBirth", (), scan_birth, valid_date),
    Detector("url_query_email_v1", "Email", (), _query_scanner(scan_email, "url_query_email_v1")),
    Detector("url_query_ssn_v1", "Ssn", ("US",), _query_scanner(_SSN.scan, "url_query_ssn_v1")),
    _SSN,
    _locale("nl_bsn_mod11_v1", "Bsn", r"\b\d{9}\b", lambda c: ck.bsn(ck.digits(c)), 0.35, "sofinummer|burgerservicenummer|bsn", ("NL", EU), window=Window(6, 4, 0.45, 0.55, 0.20)),
    _locale("de_steuer_id_mod11_10_v1", "SteuerID", r"\b\d{11}\b", lambda c: ck.steuer_id(ck.digits(c)), 0.55, "tax id|idnr|identifikationsnummer|steuerliche identifikationsnummer|steueridentifikationsnummer|steuerid|steuer id|steuer-id", ("DE", EU)),
    _locale("in_aadhaar_verhoeff_v1", "Aadhaar", r"\b[2-9]\d{3}(?:[ -]?\d{4}){2}\b", lambda c: ck.aadhaar(ck.digits(c)), 0.65, "unique identification|uid|aadhar|aadhaar", ("IN",), _no_digit_beyond(" -")),
    _locale("in_pan_regex_v1", "Pan", "(?i)<b>[a-z]{3}[tpjlhgfcba][a-z]<dddd>[a-z]<b>", ck.pan, 0.78, "income tax|permanent account number|pan card|pan", ("IN",)),
    _locale("br_cpf_mod11_v1", "Cpf", r"\b(?:\d{11}|(?:\d{3}\.){2}\d{3}-\d{2})\b", lambda c: ck.cpf(ck.digits(c)), 0.65, "taxpayer|cadastro de pessoas fisicas|cpf", ("BR",), _no_digit_beyond(" -./")),
    _locale("br_cnpj_mod11_v1", "Cnpj", r"\b(?:\d{14}|\d{2}(?:\.\d{3}){2}/\d{4}-\d{2})\b", lambda c: ck.cnpj(ck.digits(c)), 0.70, "pessoa juridica|cadastro nacional|cnpj", ("BR",), _no_digit_beyond(" -./")),
    _locale("fr_insee_nir_mod97_v1", "InseeNir", "(?i)<b>[12](?:<gap><dd>){2}<gap>(?:<dd>|2[ab])(?:<gap><ddd>){2}<gap><dd><b>", ck.nir, 0.65, "social security|numero de securite sociale|securite sociale|insee|nir", ("FR", EU), _no_digit_beyond(" -")),
    _locale("uk_nino_regex_v1", "Nino", "(?i)<b>[a-z]{2}(?:<s>?<dd>){3}<s>?[a-d]<b>", ck.nino, 0.75, "nino|ni number|national insurance", ("UK",)),
    _locale("uk_nhs_number_mod11_v1", "NhsNumber", r"\b(?:\d{3}[ -]?){2}\d{4}\b", lambda c: ck.nhs(ck.digits(c)), 0.70, "nhs number", ("UK",)),
)


def for_locale(locale: str = "Universal", registry: tuple[Detector, ...] = REGISTRY) -> tuple[Detector, ...]:
    """The detectors that run for a locale, in registry order."""
    return tuple(d for d in registry if not d.locales or locale in d.locales or "Universal" in d.locales)
