"""Text column functions: cleaning, templates, packing, message size, contact hashes."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that count as white space in the texts.
SPACE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean(c: Column) -> Column:
    """Runs of white space become one blank, none at either end."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def render(template: str, value_of) -> Column:
    """``"a {x} b"`` as a concatenation; ``value_of(name)`` gives the column of a placeholder.

    A placeholder without a value is an error while the plan is built, not a wrong text later.
    """
    parts: list[Column] = []
    for literal, name, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            value = value_of(name)
            if value is None:
                raise KeyError(f"placeholder '{{{name}}}' has no value")
            parts.append(F.coalesce(value.cast("string"), F.lit("-")))
    return F.concat(*parts) if parts else F.lit("")


def render_with(template: str, values: dict[str, Column]) -> Column:
    return render(template, values.get)


def weekday_name(date: Column, names: list[str]) -> Column:
    """Name of the weekday, Monday first."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.weekday(date) + 1)


def day_label(date: Column, names: list[str]) -> Column:
    """Weekday name with day and month."""
    return F.concat(weekday_name(date, names), F.lit(" "), F.date_format(date, "dd/MM"))


def pack(head: Column, items: Column, limit: int) -> Column:
    """Head followed by every item that still fits into ``limit`` characters; an item that does not fit is left out."""
    def step(acc: Column, x: Column) -> Column:
        return F.when(F.length(acc) + F.length(x) + 1 > limit, acc).otherwise(F.concat(acc, x, F.lit(" ")))

    return F.trim(F.aggregate(items, head, step))


def segments(text: Column) -> Column:
    """Message parts of a Unicode short message: one up to 70 characters, else 67 per part."""
    n = F.length(text)
    return F.when(n <= 70, 1).otherwise(F.ceil(n / 67)).cast("int")


def digits(phone: Column) -> Column:
    return F.regexp_replace(phone, "[^0-9]", "")


def phone_hash(phone: Column, salt: str) -> tuple[Column, Column]:
    """Salted digest of the digits and their last two; NULL for fewer than ten digits."""
    d = digits(phone)
    ok = F.length(d) >= 10
    return F.when(ok, F.sha2(F.concat(F.lit(salt), d), 256)), F.when(ok, F.right(d, F.lit(2)))
