"""Validation of extracted fields and documents, with reason codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import digits, normalize_for_match
from quarry.functions.values import SHAPES


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that fires; null if none does. An unknown check does not fire."""
    out = F.lit(None).cast("string")
    for code, fires in reversed(checks):
        out = F.when(F.coalesce(fires, F.lit(False)), code).otherwise(out)
    return out


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False)) & ~F.coalesce(F.trim(c) == "-", F.lit(False))


def missing_fields(present: Column, required: list[str]) -> Column:
    """Required fields that are not among the present ones, in their order."""
    return F.array_except(F.array(*map(F.lit, required)), present)


def allowed_fields(fields: DataFrame, field: str, kind: str, matrix: list[tuple[str, str]]) -> DataFrame:
    """Fields whose document type may hold them. The matrix is a short list of (field, type)."""
    allowed = fields.sparkSession.createDataFrame(matrix, f"{field} string, {kind} string").distinct()
    return fields.join(F.broadcast(allowed), [field, kind], "left_semi")


def cross_field_reason(value: Column, field: Column, name: Column, number: Column, labels: list[str]) -> Column:
    """Why a value cannot be its field's: another field's label, the person's number or name, or not its shape."""
    text = normalize_for_match(value)
    leak = F.lit(False)
    for label in labels:
        leak = leak | text.startswith(label.lower())
    shaped = F.lit(True)
    for kind, pattern in SHAPES.items():
        shaped = F.when(field == kind, value.rlike(pattern)).otherwise(shaped)
    return first_reason([
        ("LABEL_LEAK", leak),
        ("NUMBER_IN_OTHER_FIELD", (field != "cpf") & (F.length(digits(number)) >= 6) & F.contains(digits(value), digits(number))),
        ("NAME_IN_OTHER_FIELD", (field != "name") & (normalize_for_match(name) != "") & F.contains(text, normalize_for_match(name))),
        ("BAD_FORMAT", ~shaped),
    ])


def document_reason(kind: Column, fields: Column, needs: dict[str, list[list[str]]]) -> Column:
    """Why a document of a type is rejected: for each list of alternatives one field must be there, in their order.

    ``fields`` is a map of values; the code names the alternatives that are missing.
    """
    out = F.lit(None).cast("string")
    for name, lists in needs.items():
        checks = []
        for some in lists:
            there = F.lit(False)
            for f in some:
                there = there | filled(F.try_element_at(fields, F.lit(f)))
            checks.append(("MISSING_" + "_OR_".join(s.upper() for s in some), ~there))
        out = F.when(kind == name, first_reason(checks)).otherwise(out)
    return out


def diagnostics(checks: list[tuple[str, Column]]) -> Column:
    """All codes that fire, in their order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(fires, F.lit(False)), F.lit(code)) for code, fires in checks)))


def bands(y: Column, header: float = 0.9, title: float = 0.75, footer: float = 0.1) -> Column:
    """The band of a page that a height from 0 (bottom) to 1 lies in."""
    return F.when(y >= header, "header").when(y >= title, "title").when(y <= footer, "footer").otherwise("body")


def band_texts(words: DataFrame, page: list[str], y: str, order: list[str], text: str) -> DataFrame:
    """page, band, text and its SHA-256: the words of each band, in order."""
    grouped = words.groupBy(*page, bands(F.col(y)).alias("band")).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("w"))
    out = grouped.select(*page, "band", F.array_join(F.transform("w", lambda s: s[text]), " ").alias("text"))
    return out.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))


def merge_fields(front: DataFrame, back: DataFrame, key: list[str], value: str) -> DataFrame:
    """Front values, and back ones where the front is missing or empty."""
    b = back.select(*key, F.col(value).alias("_back"))
    merged = front.join(b, key, "full")
    return merged.select(*key, F.when(filled(F.col(value)), F.col(value)).otherwise(F.coalesce("_back", value)).alias(value))


def derived_value(values: Column, order: list[str]) -> Column:
    """The first filled value of a map, by the order of its keys."""
    return F.coalesce(*(F.when(filled(F.try_element_at(values, F.lit(k))), F.try_element_at(values, F.lit(k))) for k in order))


def name_collisions(fields: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """key, value, fields: the same name under several fields of one record."""
    same = normalize_for_match(F.col(value))
    return fields.where(same != "").groupBy(key, same.alias("name")).agg(F.array_sort(F.collect_set(field)).alias("fields")).where(F.size("fields") > 1)
