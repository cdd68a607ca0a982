"""Extraction by declarative rules, compiled to column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import without_overlaps

#: Kinds of entities and their regexes. A CNJ of under 20 digits is a CNJ_PARTIAL.
ENTITIES = {
    "CPF": r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b",
    "CNPJ": r"\b\d{2}\.?\d{3}\.?\d{3}/\d{4}-?\d{2}\b",
    "CNJ": r"\b\d{7}-?\d{2}[.\-]?\d{4}[.\-]?\d[.\-]?\d{2}(?:[.\-]?\d{4})?\b",
    "VALOR": r"\b(?:R\$\s*)?\d{1,3}(?:\.\d{3})*,\d{2}\b|\b(?:R\$\s*)?\d+,\d{2}\b",
    "DATA": r"(?iu)\b(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\s+de\s+(?:janeiro|fevereiro|março|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\s+de\s+\d{4})\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}
#: What a text must hold for a kind to be searched for in it: cheap to look for, and never absent where the regex matches.
NEEDS = {"EMAIL": "@"}
#: Kinds for general text.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
GENERAL = {"EMAIL": MAIL, "IPV4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "DIGITS": r"\d{10,}"}


def unicode_regex(pattern: str) -> str:
    """(?i) folds case beyond ASCII, and \\s, \\w and \\b know all letters and blanks."""
    return "(?U)" + re.sub(r"\(\?([a-z]*)i([a-z]*)\)", lambda m: f"(?{m[1]}iu{m[2]})" if "u" not in m[1] + m[2] else m[0], pattern)


def matches(text: Column, pattern: str, label: str) -> Column:
    """array<struct<start, end, label, text>>: all matches with their places, from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("hit"))
    empty = F.array().cast("array<struct<start:int,end:int,label:string,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(label).alias("label"), x["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    every = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]
    some = text.rlike(pattern)
    if label in NEEDS:
        some = F.contains(text, F.lit(NEEDS[label])) & some
    return F.when(some, every).otherwise(empty)


def entities(text: Column, kinds: dict[str, str] = ENTITIES) -> Column:
    """All entities of a text that don't overlap: by start, the longest first."""
    kept = without_overlaps(F.concat(*(matches(text, pattern, label) for label, pattern in kinds.items())))
    short = lambda e: (e["label"] == "CNJ") & (F.length(F.regexp_replace(e["text"], r"\D", "")) < 20)
    return F.transform(kept, lambda e: e.withField("label", F.when(short(e), "CNJ_PARTIAL").otherwise(e["label"])))


def first_match(text: Column, rules: list[tuple[str, int]]) -> Column:
    """The value of the first rule (regex, group) that matches; an empty group falls back to the whole match."""
    tried = []
    for pattern, group in rules:
        pattern = unicode_regex(pattern)
        tried += [F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))]
    return F.coalesce(*tried)


def extract_fields(rows: DataFrame, key: str, text: Column, rules: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """(key, field, value) for each field whose rules match."""
    found = F.array(*(F.struct(F.lit(field).alias("field"), first_match(text, r).alias("value")) for field, r in rules.items()))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.field", "f.value").where("value is not null")


def confidence(weights: list[Column], floor: float = 0.1) -> Column:
    """0.45 to 0.92 from the product of weights."""
    product = F.lit(1.0)
    for w in weights:
        product = product * F.greatest(F.lit(floor), w)
    return F.least(F.lit(0.92), F.greatest(F.lit(0.45), 0.45 + 0.45 * F.least(F.lit(1.0), product / 1.6)))


def context(text: Column, start: Column, end: Column, around: int) -> Column:
    """What surrounds a span (places from 0), ``around`` characters each way, clamped."""
    begin = F.greatest(F.lit(0), start - around)
    return F.substring(text, begin + 1, end + around - begin)


def matches_rule(text: Column, starts: str | None = None, ends: str | None = None, contains: str | None = None, regex: str | None = None, least: int | None = None, most: int | None = None) -> Column:
    """All given conditions hold; case is ignored."""
    low, out = F.lower(text), F.lit(True)
    if starts is not None:
        out = out & low.startswith(starts.lower())
    if ends is not None:
        out = out & low.endswith(ends.lower())
    if contains is not None:
        out = out & F.contains(low, F.lit(contains.lower()))
    if regex is not None:
        out = out & text.rlike(unicode_regex("(?i)" + regex))
    if least is not None:
        out = out & (F.length(text) >= least)
    return out & (F.length(text) <= most) if most is not None else out
