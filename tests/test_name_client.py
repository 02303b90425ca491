from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from cardloom.config import NameConfig
from cardloom.functions.name import with_llm_names
from cardloom.functions.name_client import MOST_BYTES, HttpNameClient, request_body
from cardloom.settings import NameService, read_env, write_env


@pytest.fixture(scope="module")
def service():
    """A name service that does what the path asks for."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, dict(self.headers), body))
            name = body.get("input") or body.get("q") or ""
            answer = {"/missing": b"{}", "/broken": b"no json", "/large": b'{"full_name": "' + b"x" * MOST_BYTES + b'"}'}.get(self.path)
            if self.path == "/slow":
                time.sleep(1.5)
            self.send_response(503 if self.path == "/down" or name == "Bob" else 200)
            self.end_headers()
            self.wfile.write(answer or json.dumps({"full_name": f" {name.title()} ", "first_name": name[:3], "organization": None}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_body():
    assert request_body(" ", 'A "b"') == b'{"input": "A \\"b\\""}'
    assert json.loads(request_body('{"q": {input}, "n": 1}', 'é\n"')) == {"q": 'é\n"', "n": 1}


def test_client(service):
    url, seen = service
    assert HttpNameClient(url)("ann lee") == {"full_name": "Ann Lee", "first_name": "ann", "last_name": "", "organization": ""}
    assert seen[-1][1]["Content-Type"] == "application/json"
    HttpNameClient(url, headers={"content-type": "text/x", "X-Key": "k"}, body='{"q": {input}}')("x")
    assert seen[-1][1]["X-Key"] == "k" and seen[-1][2] == {"q": "x"}


@pytest.mark.parametrize("path", ["/missing", "/broken", "/large", "/down"])
def test_failures(service, path):
    with pytest.raises(ValueError):
        HttpNameClient(service[0] + path)("ann")


def test_timeout(service):
    with pytest.raises(TimeoutError):
        HttpNameClient(service[0] + "/slow", timeout=0.3)("ann")
    with pytest.raises(ValueError):
        HttpNameClient(" ")("ann")


def test_names_fall_back_to_rules(spark, service):
    df = spark.createDataFrame([("ann lee",), ("Bob",), (None,), ("",)], "name string")
    got = [r["n"] for r in with_llm_names(df, NameConfig(use_llm=True, llm=HttpNameClient(service[0])), "name", "n").collect()]
    assert got[0]["full_name"] == "Ann Lee" and got[1]["full_name"] == "Bob" and got[1]["first_name"] == "Bob"


def test_env(tmp_path):
    p = str(tmp_path / ".env")
    settings = NameService("http://x/y", "X-Key", "a b#c", '{"q": {input}}')
    write_env(p, settings)
    assert (tmp_path / ".env").stat().st_mode & 0o777 == 0o600
    got = read_env(p)
    assert (got.url, got.auth_header, got.api_key) == ("http://x/y", "X-Key", "a b#c")
    assert got.client().headers == {"X-Key": "a b#c"} and NameService().client() is None
    (tmp_path / ".env").write_text('# c\n\nA_URL = "http://z"\nA_URL2=no\nnonsense\nA_API_KEY=k\n')
    assert read_env(p, "A_") == NameService("http://z", "", "k", "")
    assert read_env(p, "A_").client().headers == {"Authorization": "Bearer k"}
