"""Format-preserving pseudonyms for personal numbers and dates, by a keyed Feistel network. Column expressions only.

A validated value is read as a pair of numbers (l, r) in Z_a x Z_b, where a*b is exactly the number of valid values of
its kind, and permuted by ROUNDS alternating additions of a keyed function of the other half. So every pseudonym is
valid in its format, different values get different pseudonyms, and equal values stay linked across documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import alternate, let
from .store import texts

ROUNDS = 8
#: Dates from this day on, FIRST_DAY + 270*271 days in all (to 2100), are read as dates.
FIRST_DAY, DAYS = "1900-01-01", (270, 271)

_END = r"(?![A-Za-z0-9_-])"
_END_DAY = r"(?!(?!T[0-9]{2}:)[A-Za-z0-9_-])"
_END_DOT = r"(?![A-Za-z0-9_-]|\.[0-9])"
#: Shapes, in order of precedence at one place. Fixed formats. Labels of hosts and their number have the bounds of domain
#: names, which also bounds how deep the matcher recurses.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,126}\.[A-Za-z]{2,63}",
    "iban": r"[A-Z]{2}[0-9]{13,32}(?![A-Za-z0-9])",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}" + _END_DOT,
    "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + _END_DAY,
    "dot_date": r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}" + _END_DOT,
    "slash_date": r"[0-9]{2}/[0-9]{2}/[0-9]{4}(?![A-Za-z0-9_/-])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "phone": r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _END,
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9_]|-[0-9])",
}
KINDS = [*SHAPES]
#: A value starts where a word or a host (after //) does, and the word has a digit, @ or parenthesis after its letters and
#: marks.
START = r"(?<![A-Za-z0-9_.%+-])(?<!(?<!/)/)(?=[A-Za-z._%+-]*+[0-9@(])"
ANY = START + "(?:" + "|".join(SHAPES.values()) + ")"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def feistel(l: Column, r: Column, a: Column, b: Column, key: str, kind: str, back: bool = False) -> Column:  # noqa: E741
    """struct(l, r) permuted within Z_a x Z_b (back: the inverse)."""

    def keyed(i: Column, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), a.cast("string"), b.cast("string"), i.cast("string"), x.cast("string")), 256), 1, 13), 16, 10).cast("long")

    sign = -1 if back else 1

    def step(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["l"] + sign * (keyed(i, s["r"]) % a), a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * (keyed(i, s["l"]) % b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(l.cast("long").alias("l"), r.cast("long").alias("r")), step)


def padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _digits(d: Column, key: str, kind: str, back: bool) -> Column:
    """A string of n digits permuted among all strings of n digits (n from 2 to 34)."""
    n = F.char_length(d)
    h = (n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    s = feistel(F.substring(d, F.lit(1), h).cast("long"), F.substring(d, h + 1, n - h).cast("long"), ten(h), ten(n - h), key, kind, back)
    return let(s, lambda x: F.concat(padded(x["l"], h), padded(x["r"], n - h)))


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes the payload and itself valid. payload: a cheap expression (see let)."""
    digit = lambda i: F.substring(payload, i, F.lit(1)).cast("int")
    doubled = lambda d: d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(payload)), F.lit(0), lambda acc, i: acc + F.when((F.char_length(payload) - i) % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return ((10 - total % 10) % 10).cast("string")


def _mod97(number: Column) -> Column:
    return F.aggregate(F.split(number, ""), F.lit(0), lambda acc, c: (acc * 10 + c.cast("int")) % 97)


def _iban_check(country: Column, bban: Column) -> Column:
    letters = lambda at: (F.ascii(F.substring(country, at, 1)) - 55).cast("string")
    return padded(98 - _mod97(F.concat(bban, letters(1), letters(2), F.lit("00"))), 2)


def _laid(value: Column, digits: Column) -> Column:
    """The digits in the places of the value's digits, all other characters kept. digits: a cheap expression."""

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step)["out"]


def _date(value: Column, form: str, key: str, back: bool) -> Column:
    a, b = DAYS
    read = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))

    def change(day: Column) -> Column:
        s = feistel((day / b).cast("int"), day % b, F.lit(a), F.lit(b), key, "date", back)
        new = let(s, lambda x: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (x["l"] * b + x["r"]).cast("int")), form))
        return F.when((day >= 0) & (day < a * b), new)

    return let(read, change)


def _card(d: Column, value: Column, key: str, back: bool) -> Column:
    n = F.char_length(d)
    payload = F.substring(d, F.lit(1), n - 1)
    new = let(_digits(payload, key, "card", back), lambda x: let(F.concat(x, luhn_digit(x)), lambda y: _laid(value, y)))
    return F.when(F.substring(d, n, F.lit(1)) == luhn_digit(payload), new)


def _phone(d: Column, value: Column, key: str, back: bool) -> Column:
    ten = F.right(d, F.lit(10))
    area, office, line = (F.substring(ten, i, n).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
    s = feistel(area - 200, (office - 200) * 10000 + line, F.lit(800), F.lit(8_000_000), key, "phone", back)
    one = F.when(F.char_length(d) == 11, F.lit("1")).otherwise(F.lit(""))
    number = lambda x: F.concat(one, (x["l"] + 200).cast("string"), ((x["r"] / 10000).cast("long") + 200).cast("string"), padded(x["r"] % 10000, 4))
    return F.when((area >= 200) & (office >= 200), let(let(s, number), lambda y: _laid(value, y)))


def _ssn(d: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(d, i, n).cast("long") for i, n in ((1, 3), (4, 2), (6, 4)))
    index = area - 1 - F.when(area > 666, F.lit(1)).otherwise(F.lit(0))
    s = feistel(index, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", back)
    new_area = lambda x: x["l"] + 1 + F.when(x["l"] >= 665, F.lit(1)).otherwise(F.lit(0))
    new = let(s, lambda x: F.concat_ws("-", padded(new_area(x), 3), padded((x["r"] / 9999).cast("long") + 1, 2), padded(x["r"] % 9999 + 1, 4)))
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), new)


def _ip(value: Column, key: str, back: bool) -> Column:
    def change(q: Column) -> Column:
        octet = [q[i].cast("long") for i in range(4)]
        s = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, "ip", back)
        new = let(s, lambda x: F.concat_ws(".", *((y / 256 if hi else y % 256).cast("long").cast("string") for y in (x["l"], x["r"]) for hi in (1, 0))))
        return F.when(reduce(lambda x, y: x & y, (o < 256 for o in octet)), new)

    return let(F.split(value, r"\."), change)


def _iban(value: Column, key: str, back: bool) -> Column:
    country, bban = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.char_length(value) - 4)
    new = let(_digits(bban, key, "iban", back), lambda x: F.concat(country, _iban_check(country, x), x))
    return F.when(F.substring(value, 3, 2) == _iban_check(country, bban), new)


def pseudonym(value: Column, kind: str, key: str, back: bool = False) -> Column:
    """The value's pseudonym, null if the value is not a valid one of its kind. back: the value of a pseudonym
    (all kinds but email, which is hashed)."""
    if kind == "email":
        name = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(value)), 256), 1, 16)
        return F.concat(F.lit("p"), name, F.lit("@example.invalid"))
    if kind in ("card", "phone", "ssn"):
        return let(digits_of(value), lambda d: _card(d, value, key, back) if kind == "card" else _phone(d, value, key, back) if kind == "phone" else _ssn(d, key, back))
    if kind in ("ip", "iban"):
        return _ip(value, key, back) if kind == "ip" else _iban(value, key, back)
    return _date(value, {"iso_date": "yyyy-MM-dd", "dot_date": "dd.MM.yyyy", "slash_date": "dd/MM/yyyy"}[kind], key, back)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: doc_id, text with every valid value replaced, n_<kind> and n_values.

    Values that have a shape but are not valid (a failing check digit, an impossible date) stay as they are. Null texts
    count as empty. Where shapes overlap, the leftmost counts, and at one place the first listed. Rows are changed one by
    one: repeated ids, null ids and repeated rows each have a row of their own; an empty table gives none.
    Not covered: IBANs with letters or spaces in the account part, dates with the month first, telephone numbers outside
    the North American plan.
    key: a secret; whoever has it can turn pseudonyms back (except of e-mail addresses, which are hashed).
    """
    named = lambda m: reduce(lambda rest, k: F.when(m.rlike(f"^(?:{SHAPES[k]})$"), F.lit(k)).otherwise(rest), reversed(KINDS), F.lit(None).cast("string"))
    kind_of = "struct<gap:string,found:string,kind:string,new:string>"

    def change(x: Column) -> Column:
        def with_kind(k: Column) -> Column:
            new = reduce(lambda rest, name: F.when(k == name, pseudonym(x["found"], name, key)).otherwise(rest), KINDS, F.lit(None).cast("string"))
            return let(new, lambda y: F.struct(x["gap"].alias("gap"), x["found"].alias("found"), F.when(y.isNotNull(), k).alias("kind"), y.alias("new")))

        plain = F.struct(x["gap"].alias("gap"), x["found"].alias("found"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new"))
        return F.when(x["found"].isNull(), plain).otherwise(let(named(x["found"]), with_kind)).cast(kind_of)

    whole = F.array(F.struct(F.col("text").alias("gap"), F.lit(None).cast("string").alias("found"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new")).cast(kind_of))
    out = texts(docs).select("doc_id", F.when(F.col("text").rlike(ANY), F.transform(alternate(F.col("text"), ANY), change)).otherwise(whole).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: F.concat(x["gap"], F.coalesce(x["new"], x["found"], F.lit("")))), "")
    counted = lambda k: F.size(F.filter("parts", lambda x: F.coalesce(x["kind"] == k, F.lit(False)))).cast("long")
    counts = [counted(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", text.alias("text"), *counts, F.size(F.filter("parts", lambda x: x["kind"].isNotNull())).cast("long").alias("n_values"))
