"""Settings of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class NameConfig:
    """llm: a callable from a raw name to a dict (full_name, first_name, last_name, organization) or None; used if use_llm."""

    strip_suffix: bool = False
    org_patterns: tuple[str, ...] = ()
    use_llm: bool = False
    llm: Callable[[str], dict | None] | None = None


@dataclass(frozen=True)
class PhoneConfig:
    default_country: str = ""
    strict: bool = False


@dataclass(frozen=True)
class EmailConfig:
    strip_aliases: bool = False
    strict: bool = False


@dataclass(frozen=True)
class DedupeConfig:
    """Weights of the score, the score from which a pair is linked, and the name similarity above which names count."""

    email_weight: float = 0.40
    phone_weight: float = 0.35
    name_weight: float = 0.20
    org_weight: float = 0.05
    threshold: float = 0.50
    min_name_similarity: float = 0.60


@dataclass(frozen=True)
class CsvDialect:
    """headers: "fuzzy" (patterns) or "exact" (names); name_policy: which of several name columns wins, "first" or "last"."""

    headers: str = "fuzzy"
    name_policy: str = "first"
    keep_org_only: bool = True
    mapping: dict[str, str] = field(default_factory=dict)


CONVERT = CsvDialect()
DEDUPE = CsvDialect("exact", "first", keep_org_only=False)
NORMALIZE = CsvDialect("exact", "last")
