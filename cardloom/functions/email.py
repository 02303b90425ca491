"""Email addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.config import EmailConfig
from cardloom.functions.text import utrim

# Fixed value: what passes for an address in the lax check.
LAX = r"\A[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"


def email_key(c: Column) -> Column:
    """Comparable form: trimmed, lower case, the part before the first @ cut at its first +; '' without @."""
    t = utrim(F.lower(c))
    local = F.substring_index(F.substring_index(t, "@", 1), "+", 1)
    return F.when(F.instr(t, "@") == 0, "").otherwise(F.concat(local, F.substring(t, F.instr(t, "@"), F.length(t))))


_SPECIALS = frozenset('()<>[]:;@\\,"')


class _Address:
    """A reader of one address of RFC 5322. Each step gives whether it found its part, from ``at`` on."""

    def __init__(self, s: str):
        self.s, self.at = s, 0

    def here(self) -> str:
        return self.s[self.at : self.at + 1]

    def take(self, c: str) -> bool:
        if self.here() != c:
            return False
        self.at += 1
        return True

    def blanks(self) -> None:
        while self.here() in (" ", "\t") and self.here():
            self.at += 1

    def comments(self) -> bool:
        """Blanks and comments, which may nest; False if one stays open."""
        self.blanks()
        while self.take("("):
            depth = 1
            while depth:
                c = self.here()
                if not c:
                    return False
                depth += (c == "(") - (c == ")")
                self.at += 2 if c == "\\" else 1
            self.blanks()
        return True

    def atom(self, loose: bool = False) -> bool:
        """Letters and dots; dots stand between letters, unless ``loose``."""
        begin = self.at
        while (c := self.here()) and c > " " and c != "\x7f" and c not in _SPECIALS:
            self.at += 1
        word = self.s[begin : self.at]
        return bool(word) and (loose or not (word.startswith(".") or word.endswith(".") or ".." in word))

    def quoted(self) -> bool:
        if not self.take('"'):
            return False
        while (c := self.here()) and c != '"':
            if c == "\\":
                self.at += 1
                c = self.here()
            if not c or (c < " " and c != "\t") or c == "\x7f":
                return False
            self.at += 1
        return self.take('"')

    def literal(self) -> bool:
        """[an IP address]"""
        from ipaddress import ip_address

        end = self.s.find("]", self.at)
        if not self.take("[") or end < 0:
            return False
        try:
            ip_address(self.s[self.at : end].removeprefix("IPv6:").removeprefix("ipv6:"))
        except ValueError:
            return False
        self.at = end + 1
        return True

    def spec(self) -> bool:
        """local@domain"""
        self.blanks()
        begin = self.at
        local = self.quoted() and self.at > begin + 2 if self.here() == '"' else self.atom()
        if not local or not self.take("@"):
            return False
        self.blanks()
        return self.literal() if self.here() == "[" else self.atom()

    def phrase(self) -> bool:
        """The words of a display name, atoms with any dots or quoted ones."""
        words = 0
        while True:
            if words and not self.comments():
                return False
            self.blanks()
            if not (self.quoted() if self.here() == '"' else self.atom(True)):
                return words > 0
            words += 1

    def mailbox(self, group: bool = True) -> bool:
        """An address, with or without a name before it; or a group of one."""
        self.blanks()
        begin = self.at
        if self.spec():
            return True
        self.at = begin
        if self.here() != "<" and not self.phrase():
            return False
        self.blanks()
        if group and self.take(":"):
            return self.mailbox(False) and self.comments() and self.take(";")
        return self.take("<") and self.spec() and self.take(">")


def parse_address(s: str) -> bool:
    """Whether ``s`` is one address of RFC 5322, with or without a display name."""
    a = _Address(s)
    return a.mailbox() and a.comments() and a.at == len(s)


@F.pandas_udf(T.BooleanType())
def email_strict(c: pd.Series) -> pd.Series:
    return c.map(lambda x: x is not None and parse_address(x)).astype(bool)


def normalize_email(raw: Column, cfg: EmailConfig = EmailConfig()) -> Column:
    """STRUCT<raw, normalized, valid>."""
    t = F.lower(utrim(raw))
    n = email_key(t) if cfg.strip_aliases else t
    ok = email_strict(n) if cfg.strict else F.rlike(n, F.lit(LAX))
    ok = (t != "") & ok
    return F.struct(raw.alias("raw"), F.when(ok, n).otherwise("").alias("normalized"), ok.alias("valid"))
