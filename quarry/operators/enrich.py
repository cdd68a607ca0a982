"""Fees: the value a document states against a table of fees, and experts against a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import digits, normalize_whitespace
from quarry.functions.values import parse_money
from quarry.operators.joins import tiered_lookup
from quarry.operators.names import CPF, is_person, plain

#: What a match loses by how its value was derived; other ways lose 0.1, multiples 0.18.
PENALTIES = {"raw": 0.0, "percent_total": 0.05, "per_unit": 0.08, "percent_total_per_unit": 0.12}
#: Confidence by where the fee's entry was found, and the greatest relative difference.
SOURCES, TOLERANCE = {"alias": 0.9, "area": 0.75, "all": 0.6}, 0.15
#: The fields whose amounts a kind of document states.
VALUE_FIELDS = {"DESPACHO": ["VALOR_ARBITRADO_DE", "VALOR_ARBITRADO_JZ"], "REQUERIMENTO_HONORARIOS": ["VALOR_ARBITRADO_JZ"], "CERTIDAO_CM": ["ADIANTAMENTO"]}
ALL_FIELDS = ["VALOR_ARBITRADO_JZ", "VALOR_ARBITRADO_DE", "VALOR_ARBITRADO_CM", "ADIANTAMENTO"]


def penalty(way: Column) -> Column:
    out = F.lit(0.1)
    for name, p in PENALTIES.items():
        out = F.when(way == name, p).otherwise(out)
    return F.when(way.startswith("multiple_"), 0.18).otherwise(out)


def match_score(confidence: Column, difference: Column, way: Column) -> Column:
    """Confidence less the relative difference and what the derivation costs."""
    return confidence - difference.cast("double") - penalty(way)


def parse_instalments(c: Column) -> Column:
    """The first one to three digits in a row; null without any."""
    return F.nullif(F.regexp_extract(c, r"\d{1,3}", 0), F.lit("")).cast("int")


def unit_values(value: Column, percent: Column, parts: Column) -> Column:
    """array<struct(way, value)>: what an amount may stand for.

    Itself; the whole that it is a percentage of, and an instalment of that; an instalment of
    itself; and, if neither percentage nor instalments are known, its 2nd to 20th part.
    """
    whole = F.when((percent > 0) & (percent <= 100), value * 100 / percent)
    several = F.when(parts > 1, parts)
    made = [("raw", value), ("percent_total", whole), ("percent_total_per_unit", whole / several), ("per_unit", value / several)]
    fixed = F.array(*(F.struct(F.lit(n).alias("way"), v.cast("decimal(24,8)").alias("value")) for n, v in made))
    plain_parts = F.transform(F.sequence(F.lit(2), F.lit(20)), lambda n: F.struct(F.concat(F.lit("multiple_"), n.cast("string")).alias("way"), (value / n).cast("decimal(24,8)").alias("value")))
    free = percent.isNull() & several.isNull()
    return F.filter(F.concat(fixed, F.when(free, plain_parts).otherwise(F.slice(plain_parts, 1, 0))), lambda s: s["value"] > 0)


def fee_matches(rows: DataFrame, key: str, fees: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, field, entry, way, value, source, difference, confidence): per field the best entry of the fee table.

    rows: key, field, value, percent, parts, alias (an entry's id or null), area. fees: id,
    area, fee, ord; the table is a list of some hundred entries and joins by buckets of the fee.
    A value matches the nearest fee within ``tolerance`` of itself, first the alias's entry,
    then those of its area, then all.
    """
    from quarry.operators.joins import nearest_value

    asked = rows.select(key, "field", "alias", "area", F.explode(unit_values(F.col("value"), F.col("percent"), F.col("parts"))).alias("u")).select(key, "field", "alias", "area", "u.way", F.col("u.value").alias("value"))
    asked = asked.withColumn("_id", F.concat_ws("|", F.col(key).cast("string"), "field", "way"))
    # Spark takes the many rows that explode() makes for as few as it is given, and would broadcast them.
    fees = F.broadcast(fees)
    found = []
    for n, (source, sure) in enumerate(SOURCES.items()):
        on = {"alias": ("alias", "id"), "area": ("area", "area")}.get(source)
        if on:
            met = asked.join(fees.select(F.col(on[1]).alias("_on"), F.col("id").alias("entry"), "fee", "ord"), asked[on[0]] == F.col("_on")).where(F.abs(F.col("fee") - F.col("value")) <= tolerance * F.col("value"))
            w = W.partitionBy("_id").orderBy(F.abs(F.col("fee") - F.col("value")), "ord")
            met = met.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("_id", "entry", "fee")
        else:
            met = nearest_value(asked, "_id", "value", fees.withColumnRenamed("id", "entry"), "fee", "ord", ["entry", "fee"], tolerance).where("entry is not null").select("_id", "entry", "fee")
        found.append(met.withColumn("n", F.lit(n)).withColumn("source", F.lit(source)).withColumn("confidence", F.lit(sure)))
    every = found[0].unionByName(found[1]).unionByName(found[2])
    first = every.groupBy("_id").agg(F.min(F.struct("n", "entry", "fee", "source", "confidence")).alias("m"))
    joined = asked.join(first.hint("merge"), "_id").select(key, "field", "way", "value", "m.*")
    difference = F.abs(F.col("fee") - F.col("value")) / F.col("value")
    scored = joined.withColumn("difference", difference.cast("double")).withColumn("_s", match_score(F.col("confidence"), F.col("difference"), F.col("way")))
    order = F.when(F.col("way").startswith("multiple_"), F.regexp_extract("way", r"\d+", 0).cast("int") + 10).otherwise(F.array_position(F.array(*(F.lit(w) for w in PENALTIES)), F.col("way")))
    w = W.partitionBy(key, "field").orderBy(F.desc("_s"), order)
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "field", "entry", "way", F.round("value", 2).alias("value"), "source", "difference", "confidence")


def choose_fee(matches: DataFrame, key: str, factors: DataFrame) -> DataFrame:
    """(key, status, entry, field, value, confidence): one fee a document, or why there is none.

    factors (key, entry): an entry that a document names itself; it wins at 0.95 if all
    matches agree with it. Several entries without one are ambiguous_match; of one entry the
    surest match counts, then the nearest.
    """
    f = factors.select(F.col(key).alias("_k"), F.col("entry").alias("_f"))
    per = matches.groupBy(key).agg(F.collect_set("entry").alias("entries"), F.min(F.struct((-F.col("confidence")).alias("c"), "difference", "field", "entry", "value")).alias("m"))
    joined = per.join(f, per[key] == f["_k"], "full").withColumn(key, F.coalesce(key, "_k"))
    others = F.filter(F.coalesce("entries", F.array().cast("array<string>")), lambda e: ~e.eqNullSafe(F.col("_f")))
    named = F.col("_f").isNotNull()
    status = F.when(named & (F.size(others) > 0), "ambiguous_match").when(named, "ok").when(F.size("entries") > 1, "ambiguous_match").otherwise("ok")
    ok = status == "ok"
    return joined.select(
        key,
        status.alias("status"),
        F.when(ok, F.coalesce("_f", "m.entry")).alias("entry"),
        F.when(ok, F.when(named, "FATOR").otherwise(F.col("m.field"))).alias("field"),
        F.when(ok & ~named, F.col("m.value")).alias("value"),
        F.when(ok, F.when(named, 0.95).otherwise(-F.col("m.c"))).alias("confidence"),
    )


def parse_expert(c: Column, specialty: Column | None = None) -> Column:
    """struct(name, cpf) of a text about an expert: the longest part that is a person's name, and the CPF's digits."""
    text = normalize_whitespace(c)
    cpf = F.nullif(digits(F.regexp_extract(text, CPF, 0)), F.lit(""))
    head = F.trim(F.get(F.split(text, r"(?i)\b(?:CPF|PIS/?PASEP|RG|INSS)\b"), F.lit(0)))
    head = F.regexp_replace(head, r"(?i)^(interessad[oa]|perit[oa])\b[:\-\s]*", "")
    if specialty is not None:
        head = F.replace(head, specialty, F.lit(""))
    parts = F.filter(F.transform(F.split(head, r"\s*[-–—,]\s*"), normalize_whitespace), is_person)
    longest = F.array_min(F.transform(parts, lambda p: F.struct((-F.length(p)).alias("n"), F.array_position(parts, p).alias("at"), p.alias("p"))))["p"]
    return F.struct(F.coalesce(longest, F.when(is_person(head), head)).alias("name"), cpf.alias("cpf"))


def complete_experts(rows: DataFrame, key: str, name: str, cpf: str, catalog: DataFrame) -> DataFrame:
    """rows with name, cpf and specialty completed from the catalog (name, cpf, specialty), and ``derived``: what was.

    A missing name comes from the CPF, a missing CPF from the name, and the specialty from
    either, the name first.
    """
    entry = F.struct("name", "cpf", "specialty")
    tiers = [("name", plain(F.col(name)), plain(F.col("name")), 0.9, 0.75), ("cpf", digits(F.col(cpf)), digits(F.col("cpf")), 0.95, None)]
    found = tiered_lookup(rows.select(F.col(key).alias("_key"), name, cpf), "_key", catalog, tiers, entry)
    found = found.select("_key", F.col("value").alias("_e"), F.col("confidence").alias("_c"))
    joined = rows.join(found, rows[key] == found["_key"], "left").drop("_key")
    no_name, no_cpf = (F.coalesce(F.trim(c), F.lit("")) == "" for c in (name, cpf))
    out = [joined[c] for c in rows.columns if c not in (name, cpf)]
    derived = F.array_compact(F.array(F.when(no_name & F.col("_e.name").isNotNull(), "name_from_cpf"), F.when(no_cpf & F.col("_e.cpf").isNotNull(), "cpf_from_name"), F.when(F.col("_e.specialty").isNotNull(), "specialty")))
    return joined.select(*out, F.when(no_name, F.coalesce("_e.name", joined[name])).otherwise(joined[name]).alias(name), F.when(no_cpf, F.coalesce("_e.cpf", joined[cpf])).otherwise(joined[cpf]).alias(cpf), F.col("_e.specialty").alias("specialty"), derived.alias("derived"))


def check_experts(rows: DataFrame, key: str, name: str, cpf: str, specialty: str, catalog: DataFrame) -> DataFrame:
    """(key, found, match_by, cpf_matches, specialty_matches): a stated expert against the catalog."""
    number = digits(F.coalesce(F.col(cpf), F.lit("")))
    entry = F.struct("name", "cpf", "specialty")
    tiers = [("cpf", number, digits(F.col("cpf")), 0.95, None), ("name", plain(F.col(name)), plain(F.col("name")), 0.9, 0.75)]
    found = tiered_lookup(rows.select(F.col(key), name, cpf, specialty), key, catalog, tiers, entry)
    e = F.col("value")
    same = plain(normalize_whitespace(F.col(specialty))) == plain(normalize_whitespace(e["specialty"]))
    by = F.when(e.isNull(), F.lit(None).cast("string")).when((number != "") & (number == digits(e["cpf"])), "cpf").otherwise("name")
    return found.select(key, e.isNotNull().alias("found"), by.alias("match_by"), F.when(number != "", number == digits(e["cpf"])).alias("cpf_matches"), F.when(F.col(specialty) != "", same).alias("specialty_matches"))


def explicit_amounts(fields: DataFrame, field: str, value: str, source: str, guarded: list[str], explicit: list[str]) -> DataFrame:
    """fields in which guarded amounts are cleared unless their source states them explicitly; ``cleared`` says which were."""
    drop = F.col(field).isin(*guarded) & ~F.coalesce(F.col(source).isin(*explicit), F.lit(False)) & (F.coalesce(F.trim(value), F.lit("")) != "")
    return fields.select(*(F.when(drop, "").otherwise(F.col(c)).alias(c) if c == value else F.col(c) for c in fields.columns), drop.alias("cleared"))


def looks_like_factor(c: Column) -> Column:
    """A small number without a currency sign: over 0 and at most 20."""
    amount = parse_money(c)
    return F.coalesce(~F.upper(c).contains("R$") & (amount > 0) & (amount <= 20), F.lit(False))
