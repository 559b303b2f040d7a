"""Types of findings: tags, names and severities."""

from __future__ import annotations

import re

#: variant: (tag, kebab name); the tag without brackets is the prefix of placeholders.
_NAMES = {
    "Email": "EMAIL email", "PhoneNumber": "PHONE phone-number", "CreditCard": "CREDIT_CARD credit-card", "Iban": "IBAN iban",
    "IpAddress": "IP_ADDRESS ip-address", "Url": "URL url", "DateOfBirth": "DOB date-of-birth", "ApiKey": "API_KEY api-key", "Jwt": "JWT jwt",
    "AwsAccessKey": "AWS_KEY aws-access-key", "CryptoAddress": "CRYPTO_ADDR crypto-address", "MacAddress": "MAC_ADDR mac-address",
    "Hostname": "HOSTNAME hostname", "UserPath": "USER_PATH user-path", "PersonName": "PERSON person-name", "PhysicalAddress": "ADDRESS physical-address",
    "PassportNumber": "PASSPORT passport-number", "DriversLicense": "DRIVERS_LICENSE drivers-license", "Ssn": "SSN ssn", "Bsn": "BSN bsn",
    "Nino": "NINO nino", "NhsNumber": "NHS_NUMBER nhs-number", "Aadhaar": "AADHAAR aadhaar", "Pan": "PAN pan", "Cpf": "CPF cpf", "Cnpj": "CNPJ cnpj",
    "SteuerID": "STEUER_ID steuer-id", "InseeNir": "INSEE_NIR insee-nir",
}
VARIANTS = tuple(_NAMES)
RESERVED = ("PassportNumber", "DriversLicense")
DENY = 'Custom("DenyList")'
HIGH, MEDIUM = ("CreditCard", "Ssn"), ("Email", "PhoneNumber", "Iban")
RANKS = {"low": 0, "medium": 1, "high": 2}
LEVELS = {"low": "note", "medium": "warning", "high": "error"}
_CUSTOM = re.compile(r'Custom\("(.*)"\)$', re.S)


def custom_name(entity: str) -> str | None:
    m = _CUSTOM.match(entity)
    return m and m.group(1)


def prefix(entity: str) -> str:
    """The tag without brackets."""
    name = custom_name(entity)
    if name is None:
        return _NAMES[entity].split()[0]
    return "".join(c.upper() if c.isascii() and c.isalnum() else "_" for c in name)


def tag(entity: str) -> str:
    return f"[{prefix(entity)}]"


def kebab(entity: str) -> str:
    name = custom_name(entity)
    if name is not None:
        return "deny-list" if name == "DenyList" else "custom"
    return _NAMES[entity].split()[1]


def severity(entity: str) -> str:
    return "high" if entity in HIGH else "medium" if entity in MEDIUM else "low"


def by_name(name: str) -> str:
    """The variant of a kebab name; raises before any job on an unknown one."""
    for v in VARIANTS:
        if _NAMES[v].split()[1] == name.strip().lower().replace("_", "-"):
            return v
    raise ValueError(f"unknown entity name: {name}")


def dimension() -> list[tuple[str, str, str, str, int, str]]:
    """Rows of the dimension table: entity_type, tag, name, severity, severity_rank, sarif_level."""
    return [(v, tag(v), kebab(v), severity(v), RANKS[severity(v)], LEVELS[severity(v)]) for v in (*VARIANTS, DENY)]
