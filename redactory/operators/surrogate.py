"""Deterministic surrogates: the same type and value give the same replacement everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.spans import bound
from redactory.functions.values import value_kind

FIRST = ["Alex", "Blair", "Casey", "Dana", "Ellis", "Finley", "Gray", "Harper"]
LAST = ["Archer", "Baker", "Cooper", "Dyer", "Fisher", "Hunter", "Mason", "Porter"]
DOMAINS = ["example.com", "example.org", "example.net"]


def draw(type_: Column, value: Column, k: int | Column, n: int) -> Column:
    """The k-th whole number below n that the pair determines."""
    place = F.concat(F.lit(":"), k.cast("string"), F.lit(":")) if isinstance(k, Column) else F.lit(f":{k}:")
    word = F.substring(F.sha2(F.concat(type_, place, value).cast("binary"), 256), 1, 8)
    return F.conv(word, 16, 10).cast("long") % n


def letters(type_: Column, value: Column, n: int | Column) -> Column:
    """n lower-case letters and digits that the pair determines."""
    drawn = F.concat(*(F.sha2(F.concat(type_, F.lit(f":{k}:"), value).cast("binary"), 256) for k in ("s", "t")))
    n = F.lit(n) if isinstance(n, int) else n
    return F.substr(F.when(n <= 128, drawn).otherwise(F.repeat(drawn, (n / 128 + 1).cast("int"))), F.lit(1), n)


def sql_draw(k: int, n: int) -> str:
    return f"(('0x' || substr(sha256(type || ':{k}:' || value), 1, 8))::BIGINT % {n})"


def _pick(pool: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (at + 1).cast("int"))


def like_digits(value: Column, digits: Column) -> Column:
    """The value's layout with its digits replaced in order."""
    chars, begun = F.split(value, ""), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def replaced(given: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            digit = c.rlike("[0-9]")
            return F.struct((acc["at"] + digit.cast("int")).alias("at"), F.concat(acc["out"], F.when(digit, F.substr(given, acc["at"] + 1, F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(chars, begun, step, lambda acc: acc["out"])

    return bound(digits, replaced)


def luhn_digit(body: Column) -> Column:
    """The digit that makes body + digit pass the checksum."""

    def total(given: Column) -> Column:
        n = F.length(given)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + _luhn_part(F.substr(given, i, F.lit(1)).cast("int"), (n - i) % 2 == 0))

    return ((10 - bound(body, total) % 10) % 10).cast("string")


def _luhn_part(d: Column, doubled: Column) -> Column:
    return F.when(~doubled, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def ssn(t: Column, v: Column) -> Column:
    return like_digits(v, F.concat(F.lpad((draw(t, v, 0, 665) + 1).cast("string"), 3, "0"), F.lpad((draw(t, v, 1, 99) + 1).cast("string"), 2, "0"), F.lpad((draw(t, v, 2, 9999) + 1).cast("string"), 4, "0")))


def card(t: Column, v: Column) -> Column:
    """Same network prefix, length and grouping; passes the checksum."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    head = F.substring(digits, 1, 4)
    middle = F.concat(*(F.lpad(draw(t, v, k, 10000).cast("string"), 4, "0") for k in range(4)))
    body = F.concat(head, F.substr(middle, F.lit(1), F.length(digits) - 5))
    return like_digits(v, bound(body, lambda b: F.concat(b, luhn_digit(b))))


def phone(t: Column, v: Column) -> Column:
    """A 555-01xx number in the value's layout; a country code stays."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    code = F.substr(digits, F.lit(1), F.greatest(F.lit(0), F.length(digits) - 10))
    return like_digits(v, F.concat(code, F.lit("555"), F.lpad(draw(t, v, 0, 1000).cast("string"), 3, "0"), F.lit("01"), F.lpad(draw(t, v, 1, 100).cast("string"), 2, "0")))


# Tags of addresses that have one.
TAGS = ["test", "dev", "temp", "noreply", "work"]


def email(t: Column, v: Column) -> Column:
    """A drawn name and domain; where the address has a tag, a drawn one, never its own."""
    plus = F.when(F.contains(F.split_part(v, F.lit("@"), F.lit(1)), F.lit("+")), F.concat(F.lit("+"), _pick(TAGS, draw(t, v, 4, 5)))).otherwise("")
    return F.concat(F.lower(_pick(FIRST, draw(t, v, 0, 8))), F.lit("."), F.lower(_pick(LAST, draw(t, v, 1, 8))), draw(t, v, 2, 100).cast("string"), plus, F.lit("@"), _pick(DOMAINS, draw(t, v, 3, 3)))


# Titles and suffixes of names, without their full stop.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Rev", "Sir", "Lady", "Lord"]
SUFFIXES = ["Jr", "Sr", "I", "II", "III", "IV", "V", "PhD", "MD", "JD", "DDS", "RN", "CPA", "Esq"]


def name(t: Column, v: Column) -> Column:
    """As many words as the value has; its title and suffix stay. One word gives a last name, a middle one a first name or an initial."""
    words = F.filter(F.split(F.trim(v), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"\.", ""))
    title = F.coalesce(F.get(bare, F.lit(0)).isin(TITLES), F.lit(False))
    begin = title.cast("int")
    suffix = (F.size(words) > begin) & F.coalesce(F.element_at(bare, -1).isin(SUFFIXES), F.lit(False))
    count = F.size(words) - begin - suffix.cast("int")

    def middle(i: Column) -> Column:
        initial = F.concat(F.chr(draw(t, v, i * 3 + 11, 26) + 65), F.lit("."))
        return F.when(draw(t, v, i * 3 + 10, 3) == 0, initial).otherwise(_pick(FIRST, draw(t, v, i * 3 + 12, 8)))

    none = F.expr("cast(array() as array<string>)")
    middles = F.when(count > 2, F.transform(F.sequence(F.lit(0), F.greatest(count - 3, F.lit(0))), middle)).otherwise(none)
    first = F.when(count > 1, F.array(_pick(FIRST, draw(t, v, 0, 8)))).otherwise(none)
    made = F.concat(F.when(title, F.slice(words, 1, 1)).otherwise(none), first, middles, F.array(_pick(LAST, draw(t, v, 1, 8))), F.when(suffix, F.slice(words, -1, 1)).otherwise(none))
    return F.when(F.size(words) == 0, "Jane Doe").otherwise(F.array_join(made, " "))


def ipv4(t: Column, v: Column) -> Column:
    """The first address of a block kept for documentation."""
    return F.lit("192.0.2.1")


def ipv6(t: Column, v: Column) -> Column:
    return F.lit("2001:db8::1")


def ip(t: Column, v: Column) -> Column:
    return F.when(F.contains(v, F.lit(":")), ipv6(t, v)).otherwise(ipv4(t, v))


def aws_secret(t: Column, v: Column) -> Column:
    """40 characters; a key and sign before the value stay."""
    return F.concat(F.regexp_extract(v, r"""^([A-Za-z_]+\s*[=:"']\s*["']*)""", 1), letters(t, v, 40))


def github_token(t: Column, v: Column) -> Column:
    return F.concat(F.lit("ghp_"), letters(t, v, 36))


def slack_token(t: Column, v: Column) -> Column:
    """The kind of token, two numbers of ten digits, 24 characters."""
    kind = F.regexp_extract(F.trim(v), "^(xox[ps])", 1)
    digits = drawn_digits(t, v)
    return F.concat_ws("-", F.when(kind == "", "xoxb").otherwise(kind), F.substring(digits, 1, 10), F.substring(digits, 11, 10), letters(t, v, 24))


def secret(t: Column, v: Column) -> Column:
    """Known prefixes, and a key with its sign, stay; the rest is drawn, as long as before and no shorter than its kind allows."""
    x = F.trim(v)
    key = F.regexp_extract(x, r"""^([A-Za-z_-]+\s*[=:"']\s*["']?|[Bb]earer\s+)""", 1)
    n = F.length(x)
    return (
        F.when(F.startswith(x, F.lit("sk_live_")), F.concat(F.lit("sk_test_"), letters(t, v, F.greatest(n - 8, F.lit(24)))))
        .when(F.startswith(x, F.lit("sk-")), F.concat(F.lit("sk-"), letters(t, v, F.greatest(n - 3, F.lit(48)))))
        .when(x.rlike("^(?:ghp|github_pat)_"), github_token(t, v))
        .when(x.rlike("^xox[a-z]-"), slack_token(t, v))
        .when(key != "", F.concat(key, letters(t, v, F.greatest(n - F.length(key), F.lit(32)))))
        .otherwise(F.concat(F.lit("sk_test_"), letters(t, v, F.greatest(n - 8, F.lit(24)))))
    )


def aws_key(t: Column, v: Column) -> Column:
    return F.concat(F.substring(v, 1, 4), F.substring(F.upper(F.sha2(F.concat(t, F.lit(":s:"), v).cast("binary"), 256)), 1, 16))


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def date(t: Column, v: Column) -> Column:
    """A day between 1940 and 2004 in the value's layout; month, day, year with slashes where it has none that is known."""
    x, month, day, year = F.trim(v), draw(t, v, 0, 12) + 1, draw(t, v, 1, 28) + 1, (draw(t, v, 2, 65) + 1940).cast("string")
    m, d, written = F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"), _pick(MONTHS, month - 1)
    layouts = [
        (r"^\d{4}-\d{1,2}-\d{1,2}\z", F.concat_ws("-", year, m, d)), (r"^\d{4}/\d{1,2}/\d{1,2}\z", F.concat_ws("/", year, m, d)), (r"^\d{1,2}\.\d{1,2}\.\d{4}\z", F.concat_ws(".", d, m, year)),
        (r"^(?:1[3-9]|2\d|3[01])/\d{1,2}/\d{4}\z", F.concat_ws("/", d, m, year)), (r"^\d{1,2}-\d{1,2}-\d{4}\z", F.concat_ws("-", m, d, year)), (r"^\d{1,2}/\d{1,2}/\d{2}\z", F.concat_ws("/", m, d, F.substring(year, 3, 2))),
        (r"^[A-Za-z]+\s+\d", F.concat(written, F.lit(" "), day.cast("string"), F.lit(", "), year)), (r"^\d{1,2}\s+[A-Za-z]", F.concat_ws(" ", day.cast("string"), written, year)),
    ]
    out = F.concat_ws("/", m, d, year)
    for regex, made in reversed(layouts):
        out = F.when(x.rlike(regex), made).otherwise(out)
    return out


def drawn_number(t: Column, v: Column) -> Column:
    return (draw(t, v, 0, 98999) + 1000).cast("string")


def routing_number(t: Column, v: Column) -> Column:
    """Nine digits whose weighted sum (3, 7, 1) is a multiple of ten."""
    body = F.lpad((draw(t, v, 0, 99999999)).cast("string"), 8, "0")
    weights = [3, 7, 1, 3, 7, 1, 3, 7]
    total = sum((F.substring(body, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def drawn_digits(t: Column, v: Column) -> Column:
    """32 digits, the first not zero."""
    return F.concat((draw(t, v, 10, 9) + 1).cast("string"), F.lpad(draw(t, v, 11, 10**7).cast("string"), 7, "0"), *(F.lpad(draw(t, v, k, 10**8).cast("string"), 8, "0") for k in (12, 13, 14)))


def same_layout(t: Column, v: Column) -> Column:
    """Amounts and record numbers: every digit redrawn, all else (sign, commas, magnitude, prefix) kept."""
    return like_digits(v, drawn_digits(t, v))


def driver_license(t: Column, v: Column) -> Column:
    return like_digits(F.regexp_replace(v, "[A-Za-z]", "D"), drawn_digits(t, v))


def bank_account(t: Column, v: Column) -> Column:
    """Eight to twelve digits, as many as the value has within that."""
    return F.substr(drawn_digits(t, v), F.lit(1), F.greatest(F.lit(8), F.least(F.lit(12), F.length(F.regexp_replace(v, "[^0-9]", "")))))


def passport(t: Column, v: Column) -> Column:
    return F.concat(F.chr(draw(t, v, 0, 26) + 65), F.substring(drawn_digits(t, v), 1, 8))


def private_key(t: Column, v: Column) -> Column:
    """The value's own frame around drawn text."""
    head = F.regexp_extract(v, "-----BEGIN [A-Z ]+-----", 0)
    return F.concat(head, F.lit("\n"), F.sha2(F.concat(t, F.lit(":k:"), v).cast("binary"), 256), F.lit("\n"), F.regexp_replace(head, "BEGIN", "END"))


def jwt(t: Column, v: Column) -> Column:
    h = F.sha2(F.concat(t, F.lit(":j:"), v).cast("binary"), 256)
    return F.concat(F.lit("eyJ"), F.substring(h, 1, 20), F.lit(".eyJ"), F.substring(h, 21, 22), F.lit("."), F.substring(h, 43, 22))


def connection_string(t: Column, v: Column) -> Column:
    """The scheme and its usual port; user, host and database are made up."""
    scheme = F.lower(F.regexp_extract(v, "^([A-Za-z+]+)://", 1))
    port = F.when(F.startswith(scheme, F.lit("postgres")), "5432").when(scheme == "mysql", "3306").when(F.startswith(scheme, F.lit("mongodb")), "27017").when(scheme == "redis", "6379").otherwise("1433")
    return F.concat(scheme, F.lit("://user:password@db"), draw(t, v, 0, 100).cast("string"), F.lit(".example.com:"), port, F.lit("/app"))


def address(t: Column, v: Column) -> Column:
    return F.concat((draw(t, v, 0, 899) + 100).cast("string"), F.lit(" "), _pick(LAST, draw(t, v, 1, 8)), F.lit(" Street, "), _pick(["Springfield, IL", "Riverton, WY", "Fairview, TX", "Georgetown, KY"], draw(t, v, 2, 4)), F.lit(" "), F.lpad((draw(t, v, 3, 89999) + 10000).cast("string"), 5, "0"))


def by_kind(t: Column, v: Column) -> Column:
    """By what the value looks like, not by its type; a placeholder where it looks like nothing known."""
    kinds = {"ssn": ssn, "email": email, "ipv4": ipv4, "date": date, "credit_card": card, "money": same_layout, "phone": phone, "number": drawn_number}
    kind, out = value_kind(v), placeholder(t)
    for name_, family in kinds.items():
        out = F.when(kind == name_, family(t, v)).otherwise(out)
    return out


def placeholder(type_: Column) -> Column:
    return F.concat(F.lit("[EXAMPLE_"), F.upper(F.regexp_replace(type_, r"\s+", "_")), F.lit("]"))


FAMILIES: dict[str, Callable[[Column, Column], Column]] = {
    "ssn": ssn, "credit_card": card, "credit_card_visa": card, "credit_card_mc": card, "credit_card_amex": card, "credit_card_discover": card, "visa": card, "mastercard": card, "amex": card, "discover": card,
    "phone": phone, "email": email, "person": name, "person_name": name, "name": name, "full_name": name, "patient_name": name, "employee_name": name, "ip_address": ip, "ipv4": ipv4, "ipv6": ipv6,
    "api_key": secret, "aws_secret": aws_secret, "github_token": github_token, "slack_token": slack_token, "aws_key": aws_key, "private_key": private_key, "jwt": jwt, "connection_string": connection_string, "address": address,
    "date": date, "dob": date, "date_of_birth": date, "bank_account": bank_account, "routing_number": routing_number, "passport": passport, "driver_license": driver_license, "medical_record": same_layout, "mrn": same_layout,
    "money": same_layout, "monetary": same_layout, "amount": same_layout, "salary": same_layout, "currency": same_layout, "custom": by_kind,
}


def surrogate(type_: Column, value: Column, families: dict[str, Callable[[Column, Column], Column]] = FAMILIES) -> Column:
    """The replacement of a value by its type, whatever the type's case; a type without a family gets a placeholder.

    families may be another table of generators, or this one with some replaced.
    """

    def made(pair: Column) -> Column:
        kind, own = pair["type"], pair["value"]
        out = placeholder(kind)
        for name_, family in families.items():
            out = F.when(kind == name_, family(kind, own)).otherwise(out)
        return out

    return bound(F.struct(F.lower(F.trim(type_)).alias("type"), value.alias("value")), made)


def surrogate_map(spans: DataFrame) -> DataFrame:
    """type, value, surrogate: one row per distinct pair, made once however often it occurs."""
    return spans.select("type", "value").distinct().withColumn("surrogate", surrogate(F.col("type"), F.col("value")))
