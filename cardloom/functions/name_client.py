"""A client for a name service over HTTP: off by default, used by NameConfig(use_llm=True, llm=HttpNameClient(...))."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field

MOST_BYTES = 1 << 20  # of an answer; more is not read
INPUT = "{input}"


def request_body(template: str, name: str) -> bytes:
    """The template with the name as a JSON string in place of {input}; without a template {"input": name}."""
    if not template.strip():
        return json.dumps({"input": name}, ensure_ascii=False).encode()
    return template.replace(INPUT, json.dumps(name, ensure_ascii=False)).encode()


@dataclass(frozen=True)
class HttpNameClient:
    """A callable from a raw name to its parts. Any failure raises, upon which the rules apply.

    The service answers with a JSON object of full_name (required), first_name, last_name and organization. A status outside
    200 to 299, an answer that is no such object or is cut at MOST_BYTES, and a wait over ``timeout`` seconds are failures.
    """

    url: str
    method: str = "POST"
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 15.0
    body: str = ""

    def __call__(self, name: str) -> dict[str, str]:
        if not self.url.strip():
            raise ValueError("the name service needs a URL")
        headers = self.headers if any(k.lower() == "content-type" for k in self.headers) else {**self.headers, "Content-Type": "application/json"}
        ask = urllib.request.Request(self.url, request_body(self.body, name), headers, method=self.method or "POST")
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout or 15.0) as answer:
                data = answer.read(MOST_BYTES)
        except urllib.error.HTTPError as e:
            raise ValueError(f"name service status {e.code}: {e.read(MOST_BYTES).decode('utf-8', 'replace').strip()}") from e
        found = json.loads(data)
        parts = {k: str(found.get(k) or "").strip() for k in ("full_name", "first_name", "last_name", "organization")}
        if not parts["full_name"]:
            raise ValueError("the name service gave no full_name")
        return parts
