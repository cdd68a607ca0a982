"""Field formats, repair and validation of records, fixed and variable blocks, subtypes and page signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import block_pattern, digits, longest_token, match_text, normalize_whitespace, remove_diacritics
from quarry.functions.values import parse_date
from quarry.operators.names import CPF, EMAIL, clean_person, has_noise, is_court, is_district, is_noisy_expert, is_party, is_person, is_specialty
from quarry.operators.validate import filled, first_reason

#: Forms of a field once white space is out; what any of the second list fits is refused first.
CASE_NUMBERS = [r"^\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}$", r"^\d{7}-\d{2}\.\d{4}\.\d{3}\.\d{4}$", r"^\d{7}\.\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}$", r"^\d{7}\.\d{2}\.\d{4}\.\d{3}\.\d{4}$", r"^\d{3}\.\d{4}\.\d{3}\.\d{3}-\d$"]
ADMIN_NUMBERS = [r"^\d{6,7}-\d{2}\.\d{4}\.\d\.\d{2}(?:\.\d{4})?$", r"^\d{4}\.\d{3}\.\d{3}$", r"^(?:19|20)\d{8}$"]
NO_ADMIN_NUMBERS = [r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$", r"^\d{5}-\d{3}$", r"^\d{2}/\d{4}$", r"^\d{4}/\d{2}$"]
AMOUNT, STRICT_AMOUNT, PERCENT = r"^(?:R\$)?(?:\d{1,3}(?:\.\d{3})*|\d+),\d{2}$", r"^(?:R\$)?\d{1,3}(?:\.\d{3})*,\d{2}$", r"^\d{1,3}(?:[.,]\d{1,2})?%$"
AMOUNT_FIELDS = ["VALOR_ARBITRADO_JZ", "VALOR_ARBITRADO_DE", "VALOR_ARBITRADO_FINAL", "VALOR_ARBITRADO_CM", "VALOR_TABELADO_ANEXO_I"]
DATE_FIELDS = ["DATA_ARBITRADO_FINAL", "DATA_AUTORIZACAO_CM", "DATA_REQUISICAO"]
#: What a kind of document must have; of a list in a list one is enough.
REQUIRED = {
    "DESPACHO": [["PROCESSO_ADMINISTRATIVO"], ["PROCESSO_JUDICIAL"], ["PERITO"], ["PROMOVENTE"], ["VARA"], ["COMARCA"], ["VALOR_ARBITRADO_JZ"]],
    "CERTIDAO_CM": [["PROCESSO_ADMINISTRATIVO"], ["VALOR_ARBITRADO_CM", "DATA_AUTORIZACAO_CM"]],
    "REQUERIMENTO_HONORARIOS": [["PROCESSO_ADMINISTRATIVO"], ["DATA_REQUISICAO"]],
}


def _fits(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def valid_format(field: Column, value: Column) -> Column:
    """Whether a value is well formed for its field; blank ones never are, and fields without a form always."""
    v = F.regexp_replace(value, r"(?U)\s+", "")
    text = normalize_whitespace(value)
    special = ~value.rlike(EMAIL) & ~value.rlike(CPF) & ~has_noise(value) & ~is_person(value)
    ok = (
        F.when(field == "CPF_PERITO", F.length(digits(value)) == 11)
        .when(field == "PROCESSO_JUDICIAL", _fits(v, CASE_NUMBERS) | (F.length(digits(v)) == 20))
        .when(field == "PROCESSO_ADMINISTRATIVO", ~_fits(v, NO_ADMIN_NUMBERS) & _fits(v, ADMIN_NUMBERS))
        .when(field.isin(*AMOUNT_FIELDS), v.rlike(AMOUNT))
        .when(field.isin(*DATE_FIELDS), parse_date(value).isNotNull())
        .when(field == "PERCENTUAL", v.rlike(PERCENT))
        .when(field == "ADIANTAMENTO", v.rlike(STRICT_AMOUNT) | v.rlike(PERCENT))
        .when(field == "PARCELA", v.rlike(AMOUNT) | v.rlike(PERCENT))
        .when(field == "PERITO", F.length(F.trim(value)) >= 5)
        .when(field.isin("PROMOVENTE", "PROMOVIDO"), is_party(value))
        .when(field.isin("ESPECIALIDADE", "ESPECIE_DA_PERICIA"), special & (is_specialty(value) | ((F.length(text) >= 4) & text.rlike(r"\p{L}"))))
        .when(field == "COMARCA", is_district(value))
        .when(field == "VARA", is_court(value))
        .otherwise(F.lit(True))
    )
    return F.coalesce((F.trim(value) != "") & ok, F.lit(False))


def repair_record(values: Column) -> Column:
    """A record's map with identifiers in one form, or dropped if they are none, and the expert's name cleaned."""

    def repaired(k: Column, v: Column) -> Column:
        number = F.regexp_extract(F.regexp_replace(v, r"\s+", ""), r"\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}\.?\d{4}", 0)
        name = clean_person(v)
        return F.when(k == "PROCESSO_JUDICIAL", number).when(k == "CPF_PERITO", F.when(F.length(digits(v)) == 11, digits(v)).otherwise("")).when((k == "PERITO") & (F.length(name) >= 4), name).otherwise(v)

    return F.map_filter(F.transform_values(values, repaired), lambda k, v: F.coalesce(v, F.lit("")) != "")


def changed_keys(before: Column, after: Column) -> Column:
    """The keys whose value differs between two maps, in order."""
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    return F.filter(keys, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)))


def validate_record(kind: Column, values: Column, optional: tuple[str, ...] = ("CPF_PERITO",)) -> Column:
    """struct(ok, reason, changed): a record repaired and held against its kind's rules.

    A certificate without its day takes the final amount's. The reason names the first
    requirement that is missing, or the first field that is badly formed; ``optional`` fields
    may be either.
    """
    day = F.try_element_at(values, F.lit("DATA_ARBITRADO_FINAL"))
    bridge = (kind == "CERTIDAO_CM") & ~filled(F.try_element_at(values, F.lit("DATA_AUTORIZACAO_CM"))) & filled(day)
    bridged = F.when(bridge, F.map_concat(F.map_filter(values, lambda k, v: k != "DATA_AUTORIZACAO_CM"), F.create_map(F.lit("DATA_AUTORIZACAO_CM"), day))).otherwise(values)
    after = repair_record(bridged)
    checks = []
    for name, lists in REQUIRED.items():
        for some in lists:
            there = F.lit(False)
            for f in some:
                there = there | filled(F.try_element_at(after, F.lit(f)))
            checks.append(("MISSING_" + "_OR_".join(some), (kind == name) & ~there))
    names = list(dict.fromkeys(f for lists in REQUIRED.values() for some in lists for f in some))
    for f in [n for n in names if n not in optional]:
        v = F.try_element_at(after, F.lit(f))
        checks.append((f"INVALID_{f}", filled(v) & ~valid_format(F.lit(f), v)))
    reason = first_reason(checks)
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), changed_keys(values, after).alias("changed"))


def from_catalog(value: Column, confidence: Column, entry: Column, noisy: Column, least: float = 0.6) -> Column:
    """A value, or the catalog's where it is missing, unsure or noisy and the catalog has one."""
    weak = ~filled(value) | (F.coalesce(confidence, F.lit(0.0)) < least) | F.coalesce(noisy, F.lit(False))
    return F.when(weak & filled(entry), entry).otherwise(value)


def expert_from_catalog(name: Column, confidence: Column, entry: Column) -> Column:
    return from_catalog(name, confidence, entry, is_noisy_expert(name))


def classify_blocks(blocks: DataFrame, group: str, order: str, text: str, least_token: int, most_pattern: int, fixed: Column | None = None, variable: Column | None = None) -> DataFrame:
    """Adds ``variable``: blocks of a rare pattern and a long enough word, unless a rule says fixed; rules that say variable come last."""
    rare = F.count("*").over(W.partitionBy(group, block_pattern(F.col(text)))) <= most_pattern
    out = rare & (longest_token(F.col(text)) >= least_token)
    if fixed is not None:
        out = F.when(F.coalesce(fixed, F.lit(False)), False).otherwise(out)
    if variable is not None:
        out = F.when(F.coalesce(variable, F.lit(False)), True).otherwise(out)
    return blocks.withColumn("variable", out)


def anchor_blocks(text: Column, least: int, most: int, most_words: int) -> Column:
    """Whether a block may be an anchor: its length within bounds, and not too many words."""
    v = normalize_whitespace(text)
    return F.coalesce(F.length(v).between(least, most) & (F.size(F.split(v, " ")) <= most_words), F.lit(False))


def subtype(kind: Column, back: Column, target: str, hints: list[tuple[str, list[str]]], patterns: list[tuple[str, str]]) -> Column:
    """struct(status, subtype, reason) of a document of the target kind by its back text: hints first, then patterns."""
    norm = match_text(F.coalesce(back, F.lit("")))
    name, reason = F.lit("other"), F.lit("no_hint")
    for sub, pattern in reversed(patterns):
        hit = F.coalesce(back.rlike(pattern), F.lit(False))
        name, reason = F.when(hit, sub).otherwise(name), F.when(hit, "pattern").otherwise(reason)
    for sub, words in reversed(hints):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(norm, match_text(F.lit(w)))
        name, reason = F.when(hit, sub).otherwise(name), F.when(hit, "hint").otherwise(reason)
    status = F.when(~kind.eqNullSafe(F.lit(target)), "skip").when(F.coalesce(F.trim(back), F.lit("")) == "", "no_back_text").otherwise("ok")
    ok = status == "ok"
    return F.struct(status.alias("status"), F.when(ok, name).alias("subtype"), F.when(ok, reason).alias("reason"))


def page_signals(text: Column, header: Column, signals: dict[str, list[str]], money: str = r"(?i)R\$\s*\d") -> Column:
    """struct of flags: which groups of hints a page or its header holds, and whether it states money."""
    page, top = (match_text(F.coalesce(c, F.lit(""))) for c in (text, header))
    flags = []
    for name, words in signals.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(page, match_text(F.lit(w))) | F.contains(top, match_text(F.lit(w)))
        flags.append(hit.alias(name))
    return F.struct(*flags, F.coalesce(text.rlike(money), F.lit(False)).alias("money"))


def first_page(pages: DataFrame, group: str, page: str, listed: str, signals: Column, need: list[str]) -> DataFrame:
    """(group, page): the first listed page whose signals are all there."""
    ok = F.lit(True)
    for name in need:
        ok = ok & signals[name]
    return pages.where(F.col(listed) & ok).groupBy(group).agg(F.min(page).alias(page))


def amount_regions(paragraphs: DataFrame, group: str, order: str, text: str, start: str, value: str, day: str) -> DataFrame:
    """(group, start, value, day): the paragraphs, by place, that begin the decision, and the first from there on with an amount and with a date."""
    begun = paragraphs.where(F.col(text).rlike(start)).groupBy(group).agg(F.min(order).alias("start"))
    after = paragraphs.join(begun, group).where(F.col(order) >= F.col("start"))
    return after.groupBy(group, "start").agg(F.min(F.when(F.col(text).rlike(value), F.col(order))).alias("value"), F.min(F.when(F.col(text).rlike(day), F.col(order))).alias("day"))


def plain_day(c: Column) -> Column:
    """The date of a footer: the first that its text holds, numeric or spelt."""
    found = F.regexp_extract(remove_diacritics(c), r"(?i)\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s+de\s+[a-z]+\s+de\s+\d{4}", 0)
    return parse_date(found)
