"""From pages to one record: page types, segments, their scores, candidates, and the final fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def follow_up(pages: DataFrame, group: str, page: str, kind: str, confirmed: str, strong: str, main: str) -> DataFrame:
    """Adds ``resolved``: the page's kind once confirmations and the page behind a confirmed one are taken in.

    A confirmed page (true) is of the ``main`` kind. The page behind a confirmed one is, too,
    if its own kind is unknown. Other pages of the main kind stay so with strong evidence
    alone (``strong`` is the kind it stands for, or null, and takes the place of the page's).
    """
    own = F.coalesce(F.col(strong), F.col(kind), F.lit(UNKNOWN))
    sure = F.coalesce(F.col(confirmed), F.lit(False))
    w = W.partitionBy(group).orderBy(page)
    behind = F.coalesce(F.lag(sure).over(w) & (F.lag(page).over(w) == F.col(page) - 1), F.lit(False))
    resolved = F.when(sure | (behind & (own == UNKNOWN)), main).when((own == main) & ~behind & F.col(strong).isNull(), UNKNOWN).otherwise(own)
    return pages.withColumn("resolved", resolved)


def segment_scores(pages: DataFrame, keys: list[str], ops: Column, size: Column, odd: Column, flags: dict[str, tuple[Column, float]]) -> DataFrame:
    """keys, pages, density, odd_spacing, score: 1000 a page, 10 for density, 200 less for odd spacing, and what the flags add.

    density is 1000 * ops / size on average over the pages, 0 where size is 0.
    """
    density = F.avg(F.when(size > 0, ops * 1000.0 / size).otherwise(0.0))
    out = pages.groupBy(*keys).agg(F.count("*").alias("pages"), density.alias("density"), F.avg(odd).alias("odd_spacing"), *(F.bool_or(F.coalesce(c, F.lit(False))).alias(f"_{n}") for n, (c, _) in flags.items()))
    bonus = sum((F.when(F.col(f"_{n}"), F.lit(b)).otherwise(0.0) for n, (_, b) in flags.items()), F.lit(0.0))
    return out.select(*keys, "pages", "density", "odd_spacing", (F.greatest(F.col("pages"), F.lit(1)) * 1000.0 + F.col("density") * 10.0 - F.col("odd_spacing") * 200.0 + bonus).alias("score"))


def primary_score(primary: Column, allowed: Column, passes: Column, errors: Column, page: Column) -> Column:
    """Filled primary fields, then allowed ones, then the validator's verdict; errors and late pages cost."""
    return primary * 1000 + allowed * 100 + F.when(passes, 10000).otherwise(-1000) - F.greatest(errors, F.lit(0)) * 5 - F.greatest(page, F.lit(0))


def short_segments(segments: DataFrame, kind: str, size: Column, least: dict[str, int]) -> DataFrame:
    """Segments with too few pages for their kind become unknown, and ``error`` says so."""
    short = F.lit(False)
    for name, n in least.items():
        short = short | ((F.col(kind) == name) & (size < n))
    out = [F.when(short, UNKNOWN).otherwise(F.col(c)).alias(c) if c == kind else F.col(c) for c in segments.columns]
    return segments.select(*out, F.when(short, F.concat(F.col(kind), F.lit("_TOO_SHORT"))).alias("error"))


def best_of(rows: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """The row of highest score per key, then by ``order``."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def collect_candidates(sources: dict[str, DataFrame], key: str, ranks: dict[str, int]) -> DataFrame:
    """(key, field, value, confidence, method, priority): candidates of all methods in one table, by the method's priority (1 if it has none)."""
    out = None
    for method, found in sources.items():
        part = found.select(key, "field", "value", F.col("confidence").cast("double").alias("confidence"), F.lit(method).alias("method"), F.lit(ranks.get(method, 1)).alias("priority"))
        out = part if out is None else out.unionByName(part)
    return out


def resolve_candidates(candidates: DataFrame, keys: list[str], form: Column, accept: Column, strict: bool = False) -> DataFrame:
    """keys, value, confidence, method, forms: of accepted candidates the one of highest priority, then confidence, then value.

    ``form`` is what makes two values the same; with ``strict``, several forms give AMBIGUOUS.
    """
    good = candidates.where(F.coalesce(accept, F.lit(False))).withColumn("_form", form)
    best = good.groupBy(*keys).agg(F.max(F.struct("priority", "confidence", "value", "method")).alias("m"), F.count_distinct("_form").alias("forms"))
    several = F.lit(strict) & (F.col("forms") > 1)
    return best.select(*keys, F.when(several, "AMBIGUOUS").otherwise(F.col("m.value")).alias("value"), F.col("m.confidence").alias("confidence"), F.col("m.method").alias("method"), "forms")


#: The kinds of documents that a final field is taken from, in this order.
COMMON = ["DESPACHO", "REQUERIMENTO_HONORARIOS", "CERTIDAO_CM"]
FIELD_ORDER = {
    **dict.fromkeys(["PROCESSO_ADMINISTRATIVO", "PROCESSO_JUDICIAL", "COMARCA", "VARA", "PERITO", "CPF_PERITO"], COMMON),
    **dict.fromkeys(["PROMOVENTE", "PROMOVIDO"], ["REQUERIMENTO_HONORARIOS", "DESPACHO"]),
    **dict.fromkeys(["ESPECIALIDADE", "ESPECIE_DA_PERICIA", "VALOR_ARBITRADO_JZ"], ["DESPACHO", "REQUERIMENTO_HONORARIOS"]),
    "VALOR_ARBITRADO_DE": ["DESPACHO"],
    "VALOR_ARBITRADO_CM": ["CERTIDAO_CM"],
    "DATA_REQUISICAO": ["REQUERIMENTO_HONORARIOS"],
    **dict.fromkeys(["ADIANTAMENTO", "PERCENTUAL", "PARCELA"], ["CERTIDAO_CM"]),
    "FATOR": ["CERTIDAO_CM", "DESPACHO"],
}


def final_fields(fields: DataFrame, key: str, kind: str, field: str, value: str, validated: Column, order: dict[str, list[str]] = FIELD_ORDER) -> DataFrame:
    """(key, field, value, kind): each final field from the first kind in its order that has it, validated documents first.

    Fields of kinds outside the order don't count. ``order`` is a short list that becomes an expression.
    """
    place = F.lit(None).cast("int")
    for name, kinds in order.items():
        for n, k in enumerate(kinds):
            place = F.when((F.col(field) == name) & (F.col(kind) == k), n).otherwise(place)
    ranked = fields.where(F.coalesce(F.trim(value), F.lit("")) != "").withColumn("_p", place).where("_p is not null").withColumn("_v", F.coalesce(validated, F.lit(False)))
    best = ranked.groupBy(key, field).agg(F.min(F.struct((~F.col("_v")).alias("u"), "_p", F.col(value).alias("v"), F.col(kind).alias("k"))).alias("m"))
    return best.select(key, field, F.col("m.v").alias(value), F.col("m.k").alias(kind))


def widen(pages: DataFrame, ranges: DataFrame, group: str, page: str, first: str, last: str, header: str, footer: str, most: int) -> DataFrame:
    """ranges with adjusted ends: one page earlier if that has a header; on to the first footer within ``most`` pages.

    Without a footer the range ends at ``most`` pages from its start, or at the last page there is.
    """
    p = pages.select(F.col(group).alias("_g"), F.col(page).alias("_p"), F.col(header).alias("_h"), F.col(footer).alias("_f"))
    near = ranges.join(p, (ranges[group] == p["_g"]) & p["_p"].between(F.col(first) - 1, F.col(first) + most - 1), "left")
    begins = F.bool_or(F.coalesce((F.col("_p") == F.col(first) - 1) & F.col("_h"), F.lit(False)))
    foot = F.min(F.when(F.col("_f") & (F.col("_p") >= F.col(last)), F.col("_p")))
    out = near.groupBy(*ranges.columns).agg(begins.alias("_b"), foot.alias("_foot"), F.max("_p").alias("_end"))
    start = F.when(F.col("_b"), F.col(first) - 1).otherwise(F.col(first))
    return out.select(*(c for c in ranges.columns if c not in (first, last)), start.alias(first), F.coalesce("_foot", F.greatest(F.col(last), F.coalesce("_end", F.col(last)))).alias(last))


def document_totals(pages: DataFrame, keys: list[str], words: str, images: str, form: str, annotations: str) -> DataFrame:
    """Per document: pages, words, images, annotations, and whether any page has a form or an annotation."""
    return pages.groupBy(*keys).agg(F.count("*").alias("pages"), F.sum(words).alias("words"), F.sum(images).alias("images"), F.sum(annotations).alias("annotations"), F.bool_or(form).alias("has_form"), F.bool_or(F.col(annotations) > 0).alias("has_annotation"))


def report_totals(files: DataFrame, fields: DataFrame, key: str, valid: str, documents: str, pairs: list[tuple[str, str]], most: int = 10) -> DataFrame:
    """One row: files, documents, invalid, without documents, and per pair of fields the records in which both hold one value.

    ``examples`` lists at most ``most`` keys for each pair: that cap is the report's own.
    """
    totals = files.agg(F.count("*").alias("files"), F.sum(documents).alias("documents"), F.count_if(~F.col(valid)).alias("invalid"), F.count_if(F.col(documents) == 0).alias("empty"))
    names = sorted({f for p in pairs for f in p})
    wide = fields.where(F.col("field").isin(*names)).groupBy(key).agg(*(F.max(F.when(F.col("field") == n, F.lower(F.trim("value")))).alias(n) for n in names))
    equal = F.array_compact(F.array(*(F.when((F.col(a) == F.col(b)) & (F.col(a) != ""), F.lit(f"{a}={b}")) for a, b in pairs)))
    hits = wide.select(key, F.explode(equal).alias("pair"))
    ranked = hits.withColumn("_n", F.row_number().over(W.partitionBy("pair").orderBy(key)))
    warned = ranked.groupBy("pair").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col(key)))).alias("examples"))
    listed = warned.agg(F.array_sort(F.collect_list(F.struct("pair", "n", "examples"))).alias("warnings"))  # one for each pair asked for
    return totals.withColumn("warnings", listed.scalar())


def anchor_concepts(anchors: DataFrame, before: str, after: str, example: list[str], most: int = 5) -> DataFrame:
    """(before, after, count, examples): anchors with equal neighbours; the first ``most`` examples in order, a report's own cap."""
    ranked = anchors.withColumn("_n", F.row_number().over(W.partitionBy(before, after).orderBy(*example)))
    return ranked.groupBy(before, after).agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct(*example)))).alias("examples"))


def with_override(rows: DataFrame, key: list[str], own: str, rich: DataFrame, other: str) -> DataFrame:
    """rows whose list is the rich one where there is any, else their own, else empty."""
    joined = rows.join(rich.select(*key, F.col(other).alias("_rich")), key, "left")
    value = F.coalesce(F.when(F.size("_rich") > 0, F.col("_rich")), F.col(own), F.array().cast(dict(rows.dtypes)[own]))
    return joined.select(*(value.alias(c) if c == own else joined[c] for c in rows.columns))


def band_default(rows: DataFrame, band: str, columns: list[str], bands: DataFrame) -> DataFrame:
    """rows in which missing ``columns`` take those of their band."""
    defaults = bands.select(band, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = rows.join(defaults, band, "left")
    return joined.select(*(F.coalesce(joined[c], joined[f"_{c}"]).alias(c) if c in columns else joined[c] for c in rows.columns))


def pair_with_model(targets: DataFrame, models: DataFrame, kind: str) -> DataFrame:
    """Each target beside the model of its kind: one model a kind, the first by name."""
    chosen = models.groupBy(kind).agg(F.min("model").alias("model"))
    return targets.join(chosen, kind)


def place_range(offsets: Column, start: Column, end: Column) -> Column:
    """struct(first, last): the first and last positive entries of an array of places for the characters start to end (from 0, end outside)."""
    some = F.filter(F.slice(offsets, start + 1, F.greatest(end - start, F.lit(0))), lambda x: x > 0)
    return F.struct(F.get(some, F.lit(0)).alias("first"), F.element_at(some, F.when(F.size(some) > 0, -1)).alias("last"))


def variable_range(steps: DataFrame, pair: str, kind: str, order: str, backoff: int = 0) -> DataFrame:
    """(pair, first, last): from the first to the last block that is not fixed, begun ``backoff`` blocks earlier, at 1 at least."""
    varying = steps.where((F.col(kind) != "fixed") & F.col(order).isNotNull())
    return varying.groupBy(pair).agg(F.greatest(F.lit(1), F.min(order) - backoff).alias("first"), F.max(order).alias("last"))


def variable_slots(slots: DataFrame, group: str, slot: str, variable: str) -> DataFrame:
    """(group, first, last): runs of consecutive variable slots among all slots."""
    from quarry.operators.ordered import islands

    return islands(slots.where(F.col(variable)), [group], slot).select(group, F.col("run_start").alias("first"), F.col("run_end").alias("last"))


def keep_kinds(steps: DataFrame, kind: str, mode: str) -> DataFrame:
    """Steps of an output mode: all, variables (and gaps), or fixed."""
    if mode not in ("all", "variables", "fixed"):
        raise ValueError(f"{mode} is no output mode")
    return steps if mode == "all" else steps.where((F.col(kind) == "fixed") == F.lit(mode == "fixed"))


def parse_range(c: Column) -> Column:
    """struct(first, last, operator) of "op12-40[Tj]"; a single place is its own end, and other texts give null."""
    part = lambda n: F.regexp_extract(c, r"^op(\d+)(?:-(\d+))?(?:\[([^\]]*)\])?$", n)
    first = F.nullif(part(1), F.lit("")).cast("int")
    return F.when(first.isNotNull(), F.struct(first.alias("first"), F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), first).alias("last"), F.nullif(part(3), F.lit("")).alias("operator")))


def format_range(first: Column, last: Column, operator: Column) -> Column:
    place = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    return F.when(first.isNotNull(), F.concat(F.lit("op"), place, F.when(F.coalesce(operator, F.lit("")) != "", F.concat(F.lit("["), operator, F.lit("]"))).otherwise("")))


def stage_range(text: str, stages: int) -> tuple[int, int]:
    """The stages "N-M" or "N" of a run, clipped to those there are; ValueError if it is none or empty."""
    import re

    found = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", text)
    if not found:
        raise ValueError(f"{text!r} is no range of stages")
    first, last = int(found[1]), int(found[2] or found[1])
    first, last = max(1, first), min(stages, last)
    if first > last:
        raise ValueError(f"{text!r} has none of the {stages} stages")
    return first, last


def module_status(asked: Column, error: Column, changed: Column) -> Column:
    """struct(status, reason) of a module's run: skipped, fail with its error, or ok with what it changed."""
    status = F.when(~F.coalesce(asked, F.lit(False)), "skipped").when(F.coalesce(error, F.lit("")) != "", "fail").otherwise("ok")
    reason = F.when(status == "skipped", "disabled").when(status == "fail", error).when(F.coalesce(changed, F.lit(0)) > 0, F.concat(F.lit("changed "), changed.cast("string"))).otherwise("no_change")
    return F.struct(status.alias("status"), reason.alias("reason"))


def map_get(values: Column, key: str) -> Column:
    """A map's value by key, case ignored: the exact key first; null if there is none."""
    same = F.map_filter(values, lambda k, v: F.upper(k) == F.lit(key.upper()))
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.get(F.map_values(same), F.lit(0)))


def map_first(values: Column, keys: list[str]) -> Column:
    """The first filled value of several keys."""
    return F.coalesce(*(F.nullif(F.trim(map_get(values, k)), F.lit("")) for k in keys))


def map_fill(values: Column, key: str, value: Column) -> Column:
    """The map with a value set where the key, case ignored, has none or a blank one."""
    there = F.coalesce(F.trim(map_get(values, key)), F.lit("")) != ""
    rest = F.map_filter(values, lambda k, v: F.upper(k) != F.lit(key.upper()))
    return F.when(there | value.isNull(), values).otherwise(F.map_concat(rest, F.create_map(F.lit(key), value)))


def json_fill(c: Column, key: str, value: Column) -> Column:
    """A flat JSON object of strings with a field set if it is missing or empty; keys in their order, a new one last."""
    return F.to_json(map_fill(F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")), key, value))


def prefer_sure(a: DataFrame, b: DataFrame, keys: list[str], value: str, confidence: str) -> DataFrame:
    """One row per key of both sides: the filled value of higher confidence, the first side's if equal."""
    sides = a.select(*keys, value, confidence, F.lit(0).alias("_s")).unionByName(b.select(*keys, value, confidence, F.lit(1).alias("_s")))
    filled = F.coalesce(F.trim(F.col(value)), F.lit("")) != ""
    best = sides.groupBy(*keys).agg(F.min(F.struct((~filled).alias("e"), (-F.col(confidence)).alias("c"), "_s", F.col(value).alias("v"))).alias("m"))
    return best.select(*keys, F.col("m.v").alias(value), (-F.col("m.c")).alias(confidence))
