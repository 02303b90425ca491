"""vCard text: rendering and parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.config import EmailConfig
from cardloom.functions.email import normalize_email
from cardloom.functions.phone import normalize_phone, phone_digits
from cardloom.functions.text import utrim, words

CRLF = "\r\n"
PRODID = "-//cardloom//EN"


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), (CRLF, "\\n"), ("\n", "\\n"), ("\r", "\\n")):
        c = _replace(c, a, b)
    return c


def unescape(c: Column) -> Column:
    """Escapes are undone one kind after the other, backslashes first, so that an escaped backslash before n still makes a line break."""
    for a, b in (("\\\\", "\\"), ("\\n", "\n"), ("\\N", "\n"), ("\\;", ";"), ("\\,", ",")):
        c = _replace(c, a, b)
    return c


def structured_name(c: Column) -> Column:
    """family;given;additional;; from the last, the first and the words between."""
    w = words(c)
    n = F.size(w)
    part = lambda x: escape(F.coalesce(x, F.lit("")))
    first, last = part(F.try_element_at(w, F.lit(1))), part(F.try_element_at(w, F.lit(-1)))
    middle = part(F.array_join(F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0))), " "))
    return F.when(n == 0, ";;;;").when(n == 1, F.concat(F.lit(";"), first, F.lit(";;;"))).otherwise(F.concat(last, F.lit(";"), first, F.lit(";"), middle, F.lit(";;")))


def tel_line(p: Column) -> Column:
    n, d = normalize_phone(p), phone_digits(p)
    number = F.when(F.startswith(n["normalized"], F.lit("+")), n["normalized"]).otherwise(F.concat(F.lit("+"), n["normalized"]))
    return F.when(n["valid"], F.concat(F.lit("TEL;VALUE=uri:tel:"), number)).when(d != "", F.concat(F.lit("TEL;VALUE=uri:tel:+"), d)).otherwise(F.concat(F.lit("TEL:"), escape(p)))


def email_line(e: Column) -> Column:
    n = normalize_email(e, EmailConfig(strip_aliases=True))
    return F.concat(F.lit("EMAIL:"), F.when(n["valid"], n["normalized"]).otherwise(escape(e)))


def to_vcard(name: Column, phones: Column, emails: Column, org: Column, prodid: str = PRODID) -> Column:
    """A vCard 4.0 with CRLF line ends."""
    one = lambda head, c: F.array(F.concat(F.lit(head), c))
    lines = F.concat(
        F.array(F.lit("BEGIN:VCARD"), F.lit("VERSION:4.0"), F.lit(f"PRODID:{prodid}")),
        one("FN:", F.when(name == "", "Unknown").otherwise(escape(name))),
        one("N:", structured_name(name)),
        F.when(org != "", one("ORG:", escape(org))).otherwise(F.array().cast("array<string>")),
        F.transform(phones, tel_line),
        F.transform(emails, email_line),
        F.array(F.lit("END:VCARD")),
    )
    return F.concat(F.array_join(lines, CRLF), F.lit(CRLF))


def format_n(n: Column) -> Column:
    """Display name of family;given;additional;prefix;suffix: prefix given additional family suffix, without blanks."""
    parts = F.split(n, ";")
    get = lambda i: utrim(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")))
    return F.array_join(F.filter(F.array(get(4), get(2), get(3), get(1), get(5)), lambda x: x != ""), " ")


def tel_value(v: Column) -> Column:
    return utrim(F.regexp_replace(unescape(utrim(v)), r"(?i)\Atel:", ""))


def card_fields(lines: Column) -> Column:
    """STRUCT<name, phones, emails, organization, errors ARRAY<field>> of the unfolded lines of one card.

    The last FN and the last N win, the first nonempty ORG. Without FN the name comes from N, which is
    unescaped before it is split. Group prefixes and unknown properties are ignored.
    """
    cut = F.transform(
        F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"\r+\z", "")), lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(
            F.upper(utrim(F.substring_index(utrim(F.substring_index(x, ":", 1)), ";", 1))).alias("k"),
            utrim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"),
        ),
    )
    of = lambda k, f: F.transform(F.filter(cut, lambda x: x["k"] == k), lambda x: f(x["v"]))
    filled = lambda a: F.filter(a, lambda x: x != "")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
    fn, n = last(of("FN", unescape)), last(of("N", unescape))
    errors = F.transform(
        F.filter(cut, lambda x: ((x["k"] == "TEL") & (tel_value(x["v"]) == "")) | ((x["k"] == "EMAIL") & (unescape(x["v"]) == ""))), lambda x: x["k"]
    )
    return F.struct(
        utrim(F.when(fn != "", fn).otherwise(format_n(n))).alias("name"),
        filled(of("TEL", tel_value)).alias("phones"),
        filled(of("EMAIL", unescape)).alias("emails"),
        F.coalesce(F.try_element_at(filled(of("ORG", unescape)), F.lit(1)), F.lit("")).alias("organization"),
        errors.alias("errors"),
    )
