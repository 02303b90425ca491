"""Settings in .env files: KEY=value lines for the name service."""

from __future__ import annotations

import os
from dataclasses import dataclass

from cardloom.functions.name_client import HttpNameClient

PREFIX = "CARDLOOM_LLM_"
KEYS = {"url": "URL", "auth_header": "AUTH_HEADER", "api_key": "API_KEY", "body": "BODY_TEMPLATE"}


@dataclass(frozen=True)
class NameService:
    url: str = ""
    auth_header: str = ""
    api_key: str = ""
    body: str = ""

    def client(self) -> HttpNameClient | None:
        """None without a URL. The key goes into the named header, or as a bearer token into Authorization."""
        if not self.url:
            return None
        headers = {}
        if self.api_key:
            headers = {self.auth_header: self.api_key} if self.auth_header else {"Authorization": f"Bearer {self.api_key}"}
        return HttpNameClient(self.url, headers=headers, body=self.body)


def read_env(path: str, prefix: str = PREFIX) -> NameService:
    """The settings of a file. Blank lines, comments and other keys are passed over; the last value of a key counts; quotes around values go."""
    found: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, equals, value = line.strip().partition("=")
            for name, suffix in KEYS.items():
                if equals and not key.startswith("#") and key.strip() == prefix + suffix:
                    found[name] = value.strip().strip('"')
    return NameService(**found)


def write_env(path: str, settings: NameService, prefix: str = PREFIX) -> None:
    """A file that only its owner may read. Line breaks in values become blanks; values with blanks or # are quoted."""
    lines = ["# name service"]
    for name, suffix in KEYS.items():
        value = getattr(settings, name).replace("\n", " ").replace("\r", " ")
        if any(c in value for c in " #\t"):
            value = '"' + value.replace('"', '\\"') + '"'
        lines.append(f"{prefix}{suffix}={value}")
    with open(os.open(path, os.O_CREAT | os.O_TRUNC | os.O_WRONLY, 0o600), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
