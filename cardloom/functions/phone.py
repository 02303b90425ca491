"""Phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.config import PhoneConfig
from cardloom.functions.text import utrim

# Calling codes.
CALLING_CODES = """
1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218
220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 246 247 248 249 250 251 252 253 254 255 256
257 258 260 261 262 263 264 265 266 267 268 269 290 291 297 298 299 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 379
380 381 382 385 386 387 389 420 421 423 500 501 502 503 504 505 506 507 508 509 590 591 592 593 594 595 596 597 598 599 670 672 673 674 675 676 677
678 679 680 681 682 683 684 685 686 687 688 689 690 691 692 850 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975
976 977 992 993 994 995 996 998
"""


def calling_codes() -> list[str]:
    return CALLING_CODES.split()


def phone_digits(c: Column) -> Column:
    """The digits 0-9 without leading zeros."""
    return F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), r"\A0+", "")


def phone_country(e164: Column) -> Column:
    """+code of the longest calling code (3 to 1 digits) after a leading +; '' without one."""
    known = F.array(*map(F.lit, calling_codes()))
    code = F.lit("")
    for n in (1, 2, 3):
        part = F.substring(e164, 2, n)
        code = F.when((F.length(part) == n) & F.array_contains(known, part), F.concat(F.lit("+"), part)).otherwise(code)
    return F.when(F.startswith(e164, F.lit("+")), code).otherwise("")


def normalize_phone(raw: Column, cfg: PhoneConfig = PhoneConfig()) -> Column:
    """STRUCT<raw, normalized, valid, country>: 10 to 15 digits are a number; a leading + or the default country goes in front."""
    t, digits = utrim(raw), phone_digits(raw)
    plus = F.startswith(t, F.lit("+"))
    valid = F.length(digits).between(10, 15)
    local = F.concat(F.lit(cfg.default_country), digits)
    if not cfg.default_country and cfg.strict:
        valid = valid & plus
    number = F.when(~valid, "").when(plus, F.concat(F.lit("+"), digits)).otherwise(local)
    country = F.when(~valid, "").when(plus, phone_country(number)).otherwise(F.lit(cfg.default_country))
    return F.struct(raw.alias("raw"), number.alias("normalized"), valid.alias("valid"), country.alias("country"))
