"""Money, dates, percentages and their shapes, parsed from strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Accepted numeric date formats, asked in this order.
DATE_FORMATS = ["dd/MM/yyyy", "d/M/yyyy", "dd/MM/yy", "d/M/yy", "dd-MM-yyyy", "d-M-yyyy", "dd-MM-yy", "d-M-yy", "yyyy-MM-dd"]
#: Two-digit years up to this one are of this century.
LAST_SHORT_YEAR = 49
#: Portuguese month names without accents.
MONTHS = "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split()


def parse_money(c: Column) -> Column:
    """A trailing separator with one or two digits is the decimal part; other signs go, but for a leading minus. Null without digits."""
    clean = F.regexp_replace(c, r"[^0-9.,\-]", "")
    cents = F.regexp_extract(clean, r"[.,](\d{1,2})$", 1)
    whole = F.regexp_replace(F.regexp_replace(clean, r"[.,]\d{1,2}$", ""), r"[^0-9]", "")
    number = F.concat(F.when(clean.startswith("-"), "-").otherwise(""), F.when(whole == "", "0").otherwise(whole), F.lit("."), F.rpad(cents, 2, "0"))
    return F.when(clean.rlike(r"\d"), number.try_cast(MONEY))


def format_money(c: Column) -> Column:
    """R$ 1.234,56."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c.cast(MONEY), 2), ",.", ".,"))


def parse_date(c: Column) -> Column:
    """The first format that gives a date of the calendar; also "5 de abril de 2024" anywhere in the text. Else null."""
    text = F.trim(c)
    day, sign, month, year = (F.regexp_extract(text, r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$", k) for k in (1, 2, 3, 4))
    century = F.when(F.length(year) == 4, "").when(year.try_cast("int") <= LAST_SHORT_YEAR, "20").otherwise("19")
    numeric = F.when(sign != "", F.try_to_date(F.concat_ws("-", F.concat(century, year), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    named = r"(?iU)\b(\d{1,2})\s+de\s+([A-Za-z]+)\s+de\s+(\d{4})\b"
    place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, named, 2)))
    spelt = F.concat_ws("-", F.regexp_extract(text, named, 3), F.lpad(place.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, named, 1), 2, "0"))
    return F.coalesce(numeric, iso, F.when(text.rlike(named) & (place > 0), F.try_to_date(spelt, "yyyy-MM-dd")))


def is_recent(day: Column, as_of: Column, years: int = 5) -> Column:
    """At most a day after ``as_of`` and at most so many years before it."""
    return (day <= F.date_add(as_of, 1)) & (day >= F.add_months(as_of, -12 * years))


def parse_percent(c: Column) -> Column:
    """A number, with or without %; up to 1 it is a share and counts hundredfold."""
    number = F.trim(F.replace(c, F.lit("%"), F.lit(""))).try_cast("double")
    return F.when(number <= 1, number * 100).otherwise(number)


def value_candidates(value: Column, percent: Column, parts: Column) -> Column:
    """array<struct(derivation, value)>: the value, what it would be a percentage or an instalment of, and its 2nd to 20th part."""
    made = [("raw", value), ("percent", value * 100 / percent), ("percent_parts", value * 100 / percent * parts), ("times", value * parts)]
    fixed = [F.struct(F.lit(name).alias("derivation"), F.round(v, 2).alias("value")) for name, v in made]
    halves = F.transform(F.sequence(F.lit(2), F.lit(20)), lambda n: F.struct(F.concat(F.lit("over_"), n.cast("string")).alias("derivation"), F.round(value / n, 2).alias("value")))
    return F.filter(F.concat(F.array(*fixed), halves), lambda s: s["value"].isNotNull())


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit values."""
    return F.bit_count(a.bitwiseXOR(b))


#: Regexes of well-formed values by kind.
SHAPES = {
    "cpf": r"^(\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11})$",
    "cnj": r"^\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}$",
    "money": r"^(R\$ ?)?\d{1,3}(\.\d{3})*,\d{2}$",
    "date": r"^(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})$",
    "percent": r"^\d{1,3}([.,]\d+)? ?%$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
}


def has_shape(kind: Column, value: Column) -> Column:
    """Whether a value is well formed for its kind; unknown kinds need a non-empty value."""
    out = F.length(F.trim(value)) > 0
    for name, pattern in SHAPES.items():
        out = F.when(kind == name, value.rlike(pattern)).otherwise(out)
    return F.coalesce(out, F.lit(False))
