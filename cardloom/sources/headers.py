"""Which column of a CSV file holds which field of a contact: decided once, from the header row."""

from __future__ import annotations

import re

NAME, PHONE, EMAIL, ORG = "name", "phone", "email", "org"

# Header names after lower-casing, with _ between words. `exact` takes these alone.
NAMES = {
    NAME: "name fullname full_name contactname displayname first_name firstname given_name givenname last_name lastname family_name familyname surname",
    PHONE: "phone telephone tel mobile cell phone_number phonenumber contactnumber",
    EMAIL: "email e_mail email_address emailaddress mail",
    ORG: "org organization organisation company employer affiliation",
}
# What `fuzzy` takes besides.
PATTERNS = {NAME: r"full-name", PHONE: r"phone_?\d+|phone.number", EMAIL: r"email_?\d+"}


def detect_field(header: str, dialect: str = "fuzzy") -> str:
    """The field of a header, '' if unknown. fuzzy: runs of blanks, _ and - are one _; exact: each of them is."""
    low = header.lower()
    if dialect == "exact":
        key = low.replace(" ", "_").replace("-", "_")
    else:
        key = re.sub(r"[ _-]+", "_", low)
    for field, names in NAMES.items():
        if key in names.split():
            return field
        if dialect == "fuzzy" and field in PATTERNS and re.fullmatch(PATTERNS[field], key):
            return field
    return ""


def resolve(headers: list[str], dialect: str = "fuzzy", mapping: dict[str, str] | None = None) -> dict[str, list[int]]:
    """Places of the columns of each field. ``mapping`` (header, any case, to field) wins over detection.

    A mapped value that is no field hides its column. Keys of ``mapping`` that differ in case alone are refused.
    """
    own: dict[str, str] = {}
    for k, v in (mapping or {}).items():
        if k.lower() in own:
            raise ValueError(f"two mappings for header {k!r}")
        own[k.lower()] = v
    out: dict[str, list[int]] = {f: [] for f in NAMES}
    for i, h in enumerate(headers):
        field = own.get(h.lower()) or detect_field(h, dialect)
        if field in out:
            out[field].append(i)
    return out
