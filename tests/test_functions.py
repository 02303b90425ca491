from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.config import EmailConfig, NameConfig, PhoneConfig
from cardloom.functions.email import email_key, normalize_email, parse_address
from cardloom.functions.name import normalize_name, with_llm_names
from cardloom.functions.phone import calling_codes, normalize_phone, phone_country, phone_digits
from cardloom.functions.similarity import jaro_winkler, jaro_winkler_bytes, jaro_winkler_many, org_match
from cardloom.functions.text import utrim
from cardloom.functions.vcard import escape, format_n, structured_name, tel_value, unescape
from cardloom.sources.headers import detect_field, resolve


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_utrim(spark):
    assert each(spark, utrim, [" a b ", " x　", "\u0085", "\x1cx"]) == ["a b", "x", "", "\x1cx"]


def test_phone_digits(spark):
    assert each(spark, phone_digits, ["+1 (415) 555-0199", "0044 20", "abc", "000", "٣12"]) == ["14155550199", "4420", "", "", "12"]


@pytest.mark.parametrize(
    "cfg, cases",
    [
        (PhoneConfig(), [("+1-212-555-0100", "+12125550100", True, "+1"), ("(415) 555-0199", "4155550199", True, ""), ("555-0100", "", False, ""), ("", "", False, ""), ("+91 98765 43210", "+919876543210", True, "+91"), ("+7 495 123 4567", "+74951234567", True, ""), ("1234567890123456", "", False, "")]),
        (PhoneConfig("+44"), [("020 7946 0958", "+442079460958", True, "+44"), ("+353 1 234 5678", "+35312345678", True, "+353"), ("0044 20 7946 0958", "+44442079460958", True, "+44")]),
        (PhoneConfig(strict=True), [("4155550199", "", False, ""), ("+14155550199", "+14155550199", True, "+1")]),
    ],
)
def test_normalize_phone(spark, cfg, cases):
    got = each(spark, lambda c: normalize_phone(c, cfg), [c[0] for c in cases])
    assert [(r["raw"], r["normalized"], r["valid"], r["country"]) for r in got] == cases


def test_calling_codes(spark):
    codes = calling_codes()
    assert len(codes) == len(set(codes)) == 205
    assert each(spark, phone_country, ["+15551234567", "+4420", "+3531", "+7123", "4420", "+"]) == ["+1", "+44", "+353", "", "", ""]


def test_email(spark):
    assert each(spark, email_key, [" User+tag@Example.com", "a@b@c", "none", "+t@x", ""]) == ["user@example.com", "a@b@c", "", "@x", ""]
    got = each(spark, lambda c: normalize_email(c, EmailConfig(strip_aliases=True)), ["User+tag@example.com", "invalid-email", "  ", "a@b.co\n", "x@y"])
    assert [(r["normalized"], r["valid"]) for r in got] == [("user@example.com", True), ("", False), ("", False), ("a@b.co", True), ("", False)]
    strict = each(spark, lambda c: normalize_email(c, EmailConfig(strict=True)), ["bob <bob@e.com>", "a@localhost", "no", "a@", ""])
    assert [(r["normalized"], r["valid"]) for r in strict] == [("bob <bob@e.com>", True), ("a@localhost", True), ("", False), ("", False), ("", False)]
    assert parse_address("a.b@c.d") and not parse_address("a b@c.d")


def test_name(spark):
    cfg = NameConfig(True, ("Inc.", "CSI VIT"))
    got = each(spark, lambda c: normalize_name(c, cfg), ["John Doe Inc.", "Rahul CSI VIT", "  ", "Inc.", "a  b  c"])
    assert [tuple(r) for r in got] == [("John Doe", "John", "Doe", "Inc.", True), ("Rahul", "Rahul", "", "CSI VIT", True), ("", "", "", "", False), ("", "", "", "Inc.", False), ("a  b  c", "a", "c", "", True)]


def test_llm_names_fall_back(spark):
    def client(name):
        if name == "boom":
            raise RuntimeError
        return {"full_name": name.title(), "first_name": "F"} if name == "ann lee" else {"full_name": ""}

    df = spark.createDataFrame([(0, "ann lee"), (1, "boom"), (2, "x y"), (3, "")], "i int, name string")
    got = {r["i"]: tuple(r["normalized_name"]) for r in with_llm_names(df, NameConfig(use_llm=True, llm=client)).collect()}
    assert got == {0: ("Ann Lee", "F", "", "", True), 1: ("boom", "boom", "", "", True), 2: ("x y", "x", "y", "", True), 3: ("", "", "", "", False)}


@pytest.mark.parametrize(
    "a, b, value",
    [("alice", "alicia", 0.893333), ("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("alice smith", "alice", 0.890909), ("josé", "jose", 0.848333), ("abcxyz", "abcpqrstuv", 0.72), ("abcdef", "bcadef", 0.916667), ("john doe", "charlie brown", 0.477564), ("alice", "bob", 0.0), ("", "", 1.0), ("", "a", 0.0)],
)
def test_jaro_winkler(a, b, value):
    assert jaro_winkler_bytes(a.encode(), b.encode()) == pytest.approx(value, abs=1e-6)


@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_bounds(a, b):
    s = jaro_winkler_bytes(a.encode(), b.encode())
    assert 0 <= s <= 1 + 1e-12 and (s == 1.0 if a == b else True)


def test_org_match(spark):
    df = spark.createDataFrame([("acme", "acme"), ("acme corp", "acme"), ("a", "b"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(org_match(F.col("a"), F.col("b"))).collect()] == [1.0, 0.8, 0.0, 0.0]


def test_vcard_text(spark):
    assert each(spark, escape, ["a\\b", "a;b,c", "a\nb", "a\r\nb", "a\rb"]) == ["a\\\\b", "a\\;b\\,c", "a\\nb", "a\\nb", "a\\nb"]
    assert each(spark, unescape, ["a\\,b\\;c", "x\\ny", "x\\\\ny"]) == ["a,b;c", "x\ny", "x\ny"]
    assert each(spark, structured_name, ["", "Cher", "John Doe", "John  Q  Public", "A B C D"]) == [";;;;", ";Cher;;;", "Doe;John;;;", "Public;John;Q;;", "D;A;B C;;"]
    assert each(spark, format_n, ["Doe;John;Q;Dr;Jr", "Doe;John", "", ";;;;", " Doe ; "]) == ["Dr John Q Doe Jr", "John Doe", "", "", "Doe"]
    assert each(spark, tel_value, ["tel:+1", "TEL: +2 ", "+3", "\\, 4"]) == ["+1", "+2", "+3", ", 4"]


@pytest.mark.parametrize("header, fuzzy, exact", [("Name", "name", "name"), ("Full Name", "name", "name"), ("full-name", "name", "name"), ("first  name", "name", ""), ("Phone 2", "phone", ""), ("phone12", "phone", ""), ("PhoneXNumber", "phone", ""), ("Mobile Phone", "", ""), ("E-mail", "email", "email"), ("E-mail Address", "", ""), ("email_3", "email", ""), ("Company", "org", "org"), ("", "", "")])
def test_headers(header, fuzzy, exact):
    assert detect_field(header) == fuzzy
    assert detect_field(header, "exact") == exact


def test_header_overrides():
    assert resolve(["A", "Phone"], mapping={"a": "name", "PHONE": "nothing"}) == {"name": [0], "phone": [], "email": [], "org": []}
    with pytest.raises(ValueError):
        resolve(["a"], mapping={"a": "name", "A": "org"})


@given(st.lists(st.tuples(st.text(alphabet="abcé ", max_size=12), st.text(alphabet="abcé ", max_size=12)), max_size=30))
def test_many_similarities(pairs):
    a, b = ([p[i].encode() for p in pairs] for i in (0, 1))
    assert jaro_winkler_many(a, b).tolist() == [jaro_winkler_bytes(x, y) for x, y in zip(a, b, strict=True)]


def test_similarities_of_a_column(spark):
    df = spark.createDataFrame([("martha", "marhta"), (None, "a"), ("", ""), ("abc", ""), ("martha", "marhta"), ("x", None)], "a string, b string")
    got = [r[0] for r in df.coalesce(1).select(jaro_winkler("a", "b")).collect()]
    assert got == [jaro_winkler_bytes(b"martha", b"marhta"), None, 1.0, 0.0, got[0], None]


@pytest.mark.parametrize("address", ["a@b", "a.b+c@d-e.f", "Ann Lee <a@b.c>", '"Lee, Ann" <a@b.c>', "<a@b.c>", '"a b"@c.d', "A. B. <a@b.c>", "a@b.c (home (old))", "ann@[192.0.2.1]", "ann@[IPv6:2001:db8::1]", "é@ü.de", "team: a@b.c;", " a@b", "Ann (x) Lee <a@b.c>"])
def test_addresses(address):
    from email.utils import parseaddr

    assert parse_address(address)
    assert "@" in parseaddr(address, strict=False)[1]


@pytest.mark.parametrize("address", ["", " ", "a", "a@", "@b", "a@@b", "a@b@c", ".a@b", "a.@b", "a..b@c", "a@.b", "a@b.", "a b@c", "a @b", "a@b, c@d", "Ann a@b.c", "Ann <a@b.c", "<a@b.c> x", '""@b.c', '"a@b.c', "a@[1.2]", "a(b@c.d", "a@b.c (open", "team: a@b.c, d@e.f;", "team:;", "a\x00@b.c", "a;@b.c", "Ann <a@b.c>>"])
def test_no_addresses(address):
    assert not parse_address(address)
