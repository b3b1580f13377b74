"""Predicates and expressions over single values: validators, masks, hashes, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def valid_ssn(v: Column) -> Column:
    """Nine digits; no reserved area, group or serial."""
    d = digits(v)
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")


def valid_ssn_loose(v: Column) -> Column:
    """Nine digits with an allowed area."""
    d = digits(v)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900")


def valid_luhn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) >= 13) & F.call_function("luhn_check", d)


def valid_aws_key(v: Column) -> Column:
    return v.rlike(r"^A(KI|BI|CC|SI)A[A-Z0-9]{16}\z")


def valid_phone_digits(v: Column) -> Column:
    return F.length(digits(v)).between(10, 11)


VALIDATORS = {"ssn": valid_ssn, "luhn": valid_luhn, "aws": valid_aws_key}

#: The same tests as DuckDB expressions over a column named value.
SQL_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
SQL_LUHN = f"""(length({SQL_DIGITS}) >= 13 AND list_sum(list_transform(string_split(reverse({SQL_DIGITS}), ''), lambda c, i:
    CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN CAST(c AS INTEGER) * 2 - 9 ELSE CAST(c AS INTEGER) * 2 END)) % 10 = 0)"""
SQL_VALIDATORS = {
    "ssn": f"""(length({SQL_DIGITS}) = 9 AND substr({SQL_DIGITS}, 1, 3) NOT IN ('000', '666') AND substr({SQL_DIGITS}, 1, 1) <> '9'
        AND substr({SQL_DIGITS}, 4, 2) <> '00' AND substr({SQL_DIGITS}, 6, 4) <> '0000')""",
    "luhn": SQL_LUHN,
    "aws": "regexp_full_match(value, 'A(KI|BI|CC|SI)A[A-Z0-9]{16}')",
}


def mask_placeholder(name: Column) -> Column:
    return F.concat(F.lit("["), F.regexp_replace(F.upper(name), r"\s+", "_"), F.lit("]"))


def mask_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[0-9]", "X")


def preview(v: Column) -> Column:
    return F.concat(F.substring(v, 1, 4), F.lit("..."))


def shortened(v: Column, most: int) -> Column:
    """At most that many characters, the last an ellipsis if something was cut."""
    return F.when(F.length(v) > most, F.concat(F.substring(v, 1, most - 1), F.lit("…"))).otherwise(v)


def fingerprint(v: Column) -> Column:
    return F.substring(F.sha2(v.cast("binary"), 256), 1, 8)


def content_sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _pads(key: Column) -> tuple[Column, Column]:
    """Inner and outer HMAC pads of a key, as hex."""
    raw = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key.cast("binary"), 256))).otherwise(key.cast("binary"))
    wide = F.rpad(F.hex(raw), 128, "0")
    nibbles = F.sequence(F.lit(0), F.lit(63))

    def pad(value: int) -> Column:
        return F.array_join(F.transform(nibbles, lambda i: F.lpad(F.hex(F.conv(F.substr(wide, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(value).cast("long"))), 2, "0")), "")

    return pad(0x36), pad(0x5C)


def content_hmac(text: Column, key: Column) -> Column:
    """HMAC-SHA-256 of the text, from two nested hashes; the pads depend on the key alone."""
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.unhex(inner), text.cast("binary")), 256)
    return F.concat(F.lit("hmac-sha256:"), F.sha2(F.concat(F.unhex(outer), F.unhex(first)), 256))


def _utf16(point: Column) -> Column:
    """The one or two UTF-16 units of a code point."""
    above = point - 0x10000
    return F.when(point < 0x10000, F.array(point)).otherwise(F.array(F.shiftright(above, 10) + 0xD800, above.bitwiseAND(F.lit(0x3FF)) + 0xDC00))


def hash32(text: Column) -> Column:
    """The 31-multiplier rolling hash of the UTF-16 units in 32 bits."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    codes = F.flatten(F.transform(points, _utf16))
    # exact in long: every step is cut to 32 bits
    rolled = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(rolled >= 1 << 31, rolled - (1 << 32)).otherwise(rolled)


def card_network(d: Column) -> Column:
    return (
        F.when(d.rlike("^4"), "visa")
        .when(d.rlike("^5[1-5]"), "mastercard")
        .when(d.rlike("^3[47]"), "amex")
        .when(d.rlike("^6(?:011|5)"), "discover")
        .otherwise("generic")
    )


# Value kinds in the order in which they are tried.
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
KINDS = [
    ("ssn", r"^\d{3}[-.\s]\d{2}[-.\s]\d{4}"), ("ssn", r"^\d{9}"), ("email", r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), ("ipv4", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("date", r"^\d{4}-\d{2}-\d{2}"), ("date", r"^\d{2}/\d{2}/\d{4}"), ("date", r"^\d{2}-\d{2}-\d{4}"), ("date", r"^\d{2}\.\d{2}\.\d{4}"), ("date", r"^\d{4}/\d{2}/\d{2}"), ("date", r"^\d{2}/\d{2}/\d{2}"), ("date", r"^\d{1,2}/\d{2}/\d{4}"),
    ("date", rf"^(?i:{_MONTH})\s+\d{{1,2}},?\s+\d{{4}}"), ("date", rf"^\d{{1,2}}\s+(?i:{_MONTH})\s+\d{{4}}"), ("credit_card", r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{1,7}"),
    ("money", r"^[€£¥₹₩₪₺₽฿₴₦$]\s?[\d,.\s]*\d[\d,.\s]*[KMBTkmbt]?"), ("phone", r"^[(+]?\d[\d\s\-().]{6,17}"), ("number", r"^[\d,]+(?:\.\d+)?"),
]


def value_kind(value: Column) -> Column:
    """What a value looks like: the first kind whose pattern it matches whole, else none."""
    out = F.lit("none")
    for kind, regex in reversed(KINDS):
        out = F.when(F.trim(value).rlike(regex + r"\z"), F.lit(kind)).otherwise(out)
    return out
