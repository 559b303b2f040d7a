"""Validators of numbers that carry check digits."""

from __future__ import annotations

import string

_DIGITS = frozenset(string.digits)


def digits(value: str) -> str:
    return "".join(c for c in value if c in _DIGITS)


def upper_alnum(value: str) -> str:
    return "".join(c for c in value if c.isascii() and c.isalnum()).upper()


def luhn(number: str) -> bool:
    """Luhn over the digits; fewer than 13 never pass."""
    d = [int(c) for c in digits(number)]
    if len(d) < 13:
        return False
    return sum(d[-1::-2] + [2 * x - 9 * (x > 4) for x in d[-2::-2]]) % 10 == 0


def card_brand(number: str) -> str | None:
    n = len(number)
    if number[:1] == "4" and 13 <= n <= 19:
        return "visa"
    if n == 15 and number[:2] in ("34", "37"):
        return "amex"
    if n == 16:
        if number[:4] == "6011" or number[:2] == "65":
            return "discover"
        if 51 <= int(number[:2]) <= 55 or 2221 <= int(number[:4]) <= 2720:
            return "mastercard"
    return None


#: Length of an account number: the countries that use it.
_IBAN_BY_LENGTH = {
    15: "NO", 16: "BE", 18: "NL GL FO FI DK", 19: "SI MK", 20: "LU LT KZ EE BA AT", 21: "LV LI HR CH", 22: "RS ME IE GE GB DE CR BH BG",
    23: "IL GI AE", 24: "VG TN SK SE SA RO PK MD ES CZ AD", 25: "PT", 26: "TR IS", 27: "SM MR MC IT GR FR",
    28: "PL LB HU GT DO CY AZ AL", 29: "UA QA PS BR", 30: "MU KW", 31: "MT",
}
IBAN_LENGTH = {c: n for n, cs in _IBAN_BY_LENGTH.items() for c in cs.split() if len(c) == 2}


def iban(number: str) -> bool:
    """Country length and MOD 97 of a normalised account number."""
    if IBAN_LENGTH.get(number[:2]) != len(number):
        return False
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def bsn(d: str) -> bool:
    return len(d) == 9 and (sum((9 - i) * int(c) for i, c in enumerate(d[:8])) - int(d[8])) % 11 == 0


def steuer_id(d: str) -> bool:
    if len(d) != 11 or d[0] == "0":
        return False
    often = [d[:10].count(x) for x in string.digits]
    if sum(n > 1 for n in often) != 1 or not {2, 3} & set(often) or often.count(0) not in (1, 2):
        return False
    carry = 10
    for c in d[:10]:
        carry = 2 * ((int(c) + carry) % 10 or 10) % 11
    return (11 - carry) % 10 == int(d[10])


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon, as Verhoeff numbers it."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _permuted(times: int, x: int) -> int:
    for _ in range(times):
        x = int("1576283094"[x])
    return x


def verhoeff(d: str) -> bool:
    c = 0
    for i, x in enumerate(reversed(d)):
        c = _dihedral(c, _permuted(i % 8, int(x)))
    return c == 0


def aadhaar(d: str) -> bool:
    return len(d) == 12 and d[0] not in "01" and verhoeff(d)


def _mod11(d: str, weights: list[int]) -> str:
    rest = sum(int(c) * w for c, w in zip(d, weights)) % 11
    return str(0 if rest < 2 else 11 - rest)


def cpf(d: str) -> bool:
    return len(d) == 11 and len(set(d)) > 1 and d[9:] == _mod11(d[:9], [*range(10, 1, -1)]) + _mod11(d[:10], [*range(11, 1, -1)])


def cnpj(d: str) -> bool:
    first = [*range(5, 1, -1), *range(9, 1, -1)]
    return len(d) == 14 and len(set(d)) > 1 and d[12:] == _mod11(d[:12], first) + _mod11(d[:13], [6, *first])


def nir(value: str) -> bool:
    """French social security number: key = 97 - n mod 97, Corsica by letter."""
    v = upper_alnum(value)
    if len(v) != 15 or v[0] not in "12" or v[6] not in "0123456789AB" or not (v[1:6] + v[7:]).isdecimal():
        return False
    body = int(v[:13].replace("A", "0").replace("B", "0")) - {"A": 10**6, "B": 2 * 10**6}.get(v[6], 0)
    return 97 - body % 97 == int(v[13:])


def nino(value: str) -> bool:
    v = upper_alnum(value)
    if len(v) != 9 or not v[:2].isalpha() or not v[2:8].isdecimal() or v[8] not in "ABCD":
        return False
    return v[0] not in "QVUIFD" and v[1] not in "QVUOIFD" and v[:2] not in ("ZZ", "TN", "NT", "NK", "KN", "GB", "BG")


def nhs(d: str) -> bool:
    if len(d) != 10:
        return False
    check = 11 - sum(int(c) * w for c, w in zip(d, range(10, 1, -1))) % 11
    return check != 10 and check % 11 == int(d[9])


def pan(value: str) -> bool:
    v = upper_alnum(value)
    return len(v) == 10 and v[:5].isalpha() and v[3] in "TPLJHGFCBA" and v[5:9].isdecimal() and v[5:9] != "0000" and v[9].isalpha()


def ssn(d: str) -> bool:
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
