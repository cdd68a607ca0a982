"""Extraction driven by rule files: field maps, strategies, span rules, templates of regions, anchored sequences.

Rules are lists on the driver that become column expressions, one pass over the texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalize_whitespace, remove_diacritics, wildcard
from quarry.operators.extract import confidence, first_match, matches, unicode_regex
from quarry.operators.names import cleaned, valid


def _labelled(labels: list[str]):
    """A test of a span's label; F's lambdas take no further parameters."""
    return lambda e: e["label"].isin(*labels)


def map_fields(rows: DataFrame, key: str, bands: dict[str, Column], rules: dict[str, list[dict]], spans: Column | None = None) -> DataFrame:
    """(key, field, value, source) of the first source of each field that gives a value.

    ``rules`` is what ``sources.rules.field_rules`` returns. A source reads its band's text;
    labelled spans (array<struct<label, text>>) come before its regexes. Fields without a
    value give no row.
    """
    found = []
    for field, sources in rules.items():
        tried = []
        for n, s in enumerate(sources):
            text = bands.get(s["band"], bands.get("full"))
            if text is None:
                continue
            if s["labels"] and spans is not None:
                some = s["labels"]
                hits = F.filter(spans, _labelled(some))
                tried.append((F.nullif(F.trim(F.get(hits, F.lit(0))["text"]), F.lit("")), f"{n}:label"))
            if s["patterns"]:
                tried.append((F.nullif(F.trim(first_match(text, s["patterns"])), F.lit("")), f"{n}:regex"))
        if tried:
            value = F.coalesce(*(v for v, _ in tried))
            source = F.coalesce(*(F.when(v.isNotNull(), F.lit(name)) for v, name in tried))
            found.append(F.struct(F.lit(field).alias("field"), value.alias("value"), source.alias("source")))
    return rows.select(key, F.explode(F.array(*found)).alias("f")).select(key, "f.*").where("value is not null")


#: Weights of a source's bucket, of a name that no source knows, and of its bucket.
BUCKETS, OTHER_BUCKET = {"principal": 1.0, "apoio": 0.85, "laudo": 0.75}, 0.8
UNKNOWN_SOURCE, UNKNOWN_BUCKET = 0.7, 0.85


def _strategy_rows(values: Column, field: str, method: str, sure: Column, clean: list[str], validate: list[str]) -> Column:
    values = F.transform(values, lambda v: cleaned(F.trim(v), clean))
    values = F.filter(values, lambda v: (v != "") & valid(v, validate))
    return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"), F.lit(method).alias("method"), sure.alias("confidence")))


def strategy_candidates(segments: DataFrame, key: str, name: Column, text: Column, weight: Column, strategies: list[dict]) -> DataFrame:
    """(key, field, value, method, confidence): all matches of all patterns of all strategies in all segments.

    A strategy: priority, sources (bucket, name_matches), patterns (type regex or keyword,
    label, pattern, field, weight, value, second_field), clean, validate. Confidence comes from the product
    of the weights of pattern, priority, source, bucket and segment, each with its floor.
    """
    found = []
    for s in strategies:
        priority = s.get("priority") or 1.0
        source, bucket = F.lit(1.0), F.lit(1.0)
        if s.get("sources"):
            source, bucket = F.lit(UNKNOWN_SOURCE), F.lit(UNKNOWN_BUCKET)
            for place in s["sources"]:
                known = F.lit(False)
                for pattern in place.get("name_matches") or []:
                    known = known | F.coalesce(wildcard(name, pattern), F.lit(False))
                source = F.when(known, F.greatest(source, F.lit(1.0))).otherwise(source)
                bucket = F.when(known, F.greatest(bucket, F.lit(BUCKETS.get(str(place.get("bucket", "")).strip().lower(), OTHER_BUCKET)))).otherwise(bucket)
        for p in s.get("patterns") or []:
            weights = [(float(p.get("weight", 1.0)), 0.2), (float(priority), 0.7), (source, 0.6), (bucket, 0.6), (weight, 0.6)]
            sure = confidence([F.greatest(F.lit(floor), F.lit(w) if isinstance(w, float) else w) for w, floor in weights], floor=0.0)
            if p.get("type", "regex") == "keyword":
                place = F.locate(p["pattern"].lower(), F.lower(text))
                value = F.lit(p["value"]) if p.get("value") else F.substring(text, place, F.lit(len(p["pattern"])))
                hits = [(p["field"], F.when(place > 0, F.array(value)).otherwise(F.array().cast("array<string>")))]
            else:
                pattern = unicode_regex("(?is)" + p["pattern"])
                groups = re.compile(re.sub(r"\(\?[a-zA-Z]*U?[a-zA-Z]*\)", "", p["pattern"])).groups
                fields = [p["field"], p["second_field"]] if p.get("second_field") and groups >= 2 else [p["field"]]
                hits = [(f, F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1 if groups else 0))) for i, f in enumerate(fields)]
            for field, values in hits:
                found.append(_strategy_rows(values, field, f"strategy_{p.get('type', 'regex')}:{p.get('label', '')}", sure, s.get("clean") or [], s.get("validate") or []))
    return segments.select(key, F.explode(F.array_distinct(F.concat(*found))).alias("c")).select(key, "c.*")


def best_candidates(candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One candidate per key and field: the surest, then by ``order``."""
    best = candidates.groupBy(key, "field").agg(F.min(F.struct((-F.col("confidence")).alias("_c"), *order, "value", "method")).alias("m"))
    return best.select(key, "field", "m.value", "m.method", (-F.col("m._c")).alias("confidence"))


def _plain(c: Column) -> Column:
    return normalize_whitespace(F.lower(remove_diacritics(c)))


def _says(c: Column, words: list[str]) -> list[Column]:
    """Whether a plain text holds each word; words are made plain as texts are."""
    from unicodedata import combining, normalize

    made = [" ".join("".join(x for x in normalize("NFD", w) if not combining(x)).lower().split()) for w in words]
    return [F.contains(c, F.lit(w)) for w in made if w]


def _span_rule(text: Column, spans: Column, rule: dict) -> Column:
    """struct(field, value, label, start, score) of one rule; the value is null if nothing fits."""
    words = {name: rule.get(name) or [] for name in ("before_any", "after_any", "before_all", "after_all", "exclude_any")}
    window, priority = int(rule.get("window", 60)), int(rule.get("priority", 0))
    count = lambda hits: sum((h.cast("int") for h in hits), F.lit(0))

    def judged(e: Column) -> Column:
        before = _plain(F.substring(text, F.greatest(F.lit(1), e["start"] - window + 1), F.least(e["start"], F.lit(window))))
        after = _plain(F.substring(text, e["end"] + 1, F.lit(window)))
        near = {name: _says(before if name.startswith("before") else after, found) for name, found in words.items()}
        ok = (count(near["before_all"]) == len(near["before_all"])) & (count(near["after_all"]) == len(near["after_all"]))
        for name in ("before_any", "after_any"):
            ok = ok & (count(near[name]) > 0) if words[name] else ok
        ok = ok & (count([*_says(before, words["exclude_any"]), *_says(after, words["exclude_any"])]) == 0)
        score = F.lit(priority) + count(near["before_any"]) + count(near["after_any"])
        return F.struct(ok.alias("ok"), (-score).alias("rank"), e["start"].alias("start"), F.trim(e["text"]).alias("value"), e["label"].alias("label"))

    fitting = F.filter(F.transform(F.filter(spans, _labelled(rule.get("labels") or [])), judged), lambda j: j["ok"])
    best = F.array_min(F.transform(fitting, lambda j: F.struct(j["rank"].alias("rank"), j["start"].alias("start"), j["value"].alias("value"), j["label"].alias("label"))))
    made = F.struct(F.lit(rule["key"]).alias("field"), best["value"].alias("value"), best["label"].alias("label"), best["start"].alias("start"), (-best["rank"]).alias("score"))
    if not rule.get("regex"):
        return made
    fallback = F.nullif(F.trim(first_match(text, [("(?i)" + rule["regex"]["pattern"], int(rule["regex"].get("group", 0)))])), F.lit(""))
    other = F.struct(F.lit(rule["key"]).alias("field"), fallback.alias("value"), F.lit("regex").alias("label"), F.lit(None).cast("int").alias("start"), F.lit(priority).alias("score"))
    return F.when(best.isNull(), other).otherwise(made)


def span_fields(rows: DataFrame, key: str, text: Column, spans: Column, rules: list[dict]) -> DataFrame:
    """(key, field, value, label, start, score): per rule the span of its labels whose surroundings fit best.

    A rule: key, labels, before_any, after_any, before_all, after_all, exclude_any, window,
    priority, regex (pattern, group). Score is the priority and the hits of before_any and
    after_any; of equals the first span wins. A rule without a fitting span takes its regex.
    """
    out = [_span_rule(text, spans, rule) for rule in rules]
    return rows.select(key, F.explode(F.array(*out)).alias("f")).select(key, "f.*").where("value is not null")


def region_fields(rows: DataFrame, key: str, text: Column, template: str) -> DataFrame:
    """(key, field, value) from a template of literals and {{FIELD}}s, if all literals stand in the text in their order."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    names, literals = parts[1::2], parts[::2]
    loose = [r"\s+".join(map(re.escape, x.split())) for x in literals]
    pattern = "(?isu)" + "".join(a + (r"\s*(.+?)\s*" if i < len(names) else "") for i, a in enumerate(loose)) + ("$" if not loose[-1] else "")
    found = F.array(*(F.struct(F.lit(n).alias("field"), F.trim(F.regexp_extract(text, pattern, i + 1)).alias("value")) for i, n in enumerate(names)))
    return rows.where(text.rlike(pattern)).select(key, F.explode(found).alias("f")).select(key, "f.*").where("value != ''")


def best_region(rows: DataFrame, key: str, order: str, text: Column, templates: list[str]) -> DataFrame:
    """(key, order, hits): the paragraph that holds most of the templates' literals; the first of equals, and none without any."""
    literals = [" ".join(x.split()).lower() for t in templates for x in re.split(r"\{\{\w+\}\}", t) if x.strip()]
    low = normalize_whitespace(F.lower(text))
    hits = sum((F.contains(low, F.lit(x)).cast("int") for x in literals), F.lit(0))
    best = rows.select(key, order, hits.alias("hits")).where("hits > 0").groupBy(key).agg(F.min(F.struct((-F.col("hits")).alias("h"), order)).alias("m"))
    return best.select(key, F.col(f"m.{order}").alias(order), (-F.col("m.h")).alias("hits"))


def sequential_fields(text: Column, rules: list[tuple[str, str, int]]) -> Column:
    """array<struct<field, value, start>>: rules (field, regex, group) from left to right, each behind the last one's match.

    ``start`` counts from 0 in the text and is null where a rule finds nothing; the place
    then stays, so a later rule may still match.
    """
    at, out = F.lit(0), []
    for field, pattern, group in rules:
        rest = F.substring(text, at + 1, F.length(text))
        whole, value = F.regexp_extract(rest, pattern, 0), F.regexp_extract(rest, pattern, group)
        place = F.instr(rest, whole)
        hit = whole != ""
        out.append(F.struct(F.lit(field).alias("field"), F.when(hit, F.trim(value)).alias("value"), F.when(hit, at + place - 1).alias("start")))
        at = F.when(hit, at + place - 1 + F.length(whole)).otherwise(at)
    return F.array(*out)


def slice_between(text: Column, start: str, end: str) -> Column:
    """The text from the first match of ``start`` to the end of the first match of ``end`` behind it; null if either is missing."""
    first = F.regexp_extract(text, start, 0)
    rest = F.when(first != "", F.substring(text, F.instr(text, first), F.length(text)))
    behind = F.substring(rest, F.length(first) + 1, F.length(rest))
    last = F.regexp_extract(behind, end, 0)
    return F.when(last != "", F.substring(rest, F.lit(1), F.length(first) + F.instr(behind, last) - 1 + F.length(last)))


def operator_range(lines: DataFrame, key: str, order: str, text: str, start: str, end: str) -> DataFrame:
    """(key, first, last): from the first row that matches ``start`` to the first from there on that matches ``end``."""
    begun = lines.where(F.col(text).rlike(start)).groupBy(key).agg(F.min(order).alias("first"))
    after = lines.join(begun, key).where((F.col(order) >= F.col("first")) & F.col(text).rlike(end))
    return after.groupBy(key, "first").agg(F.min(order).alias("last"))


def relocated(fields: DataFrame, key: str, field: str, value: str, accept: Column, targets: dict[str, str]) -> DataFrame:
    """Rejected values that are another field's: (key, field, value, moved), the accepted ones and those that fit a target's regex.

    ``targets``: field to regex; a target that has an accepted value keeps it.
    """
    marked = fields.withColumn("_ok", F.coalesce(accept, F.lit(False)))
    kept = marked.where("_ok").select(key, field, value, F.lit(False).alias("moved"))
    tried = [F.struct(F.lit(t).alias("f"), F.nullif(F.regexp_extract(F.col(value), p, 0), F.lit("")).alias("v")) for t, p in targets.items()]
    moved = marked.where("not _ok").select(key, F.explode(F.array(*tried)).alias("t")).where("t.v is not null")
    moved = moved.groupBy(key, F.col("t.f").alias(field)).agg(F.min("t.v").alias(value), F.lit(True).alias("moved"))
    return kept.unionByName(moved.join(kept.select(key, field), [key, field], "left_anti"))


def rescanned(fields: DataFrame, texts: DataFrame, key: str, field: str, value: str, text: str, rules: dict[str, list[tuple[str, int]]], sure: float = 0.85) -> DataFrame:
    """(key, field, value, confidence): fields without a value are looked for in the whole text, at a fixed confidence."""
    from quarry.operators.extract import extract_fields

    there = fields.where(F.trim(F.coalesce(value, F.lit(""))) != "").select(key, field, value)
    found = extract_fields(texts, key, F.col(text), rules).withColumnRenamed("field", field).withColumnRenamed("value", value)
    fresh = found.join(there, [key, field], "left_anti")
    return there.withColumn("confidence", F.lit(1.0)).unionByName(fresh.withColumn("confidence", F.lit(sure)))


#: Words that a text signature stands behind, and the shape of its date.
SIGNED = r"(?iu)(?:assinado\s+(?:eletronicamente|digitalmente)\s+por|documento\s+assinado\s+por)\s*:?\s*([\p{L}][\p{L} .'-]{3,80}?)(?=\s*(?:[,;\n]|\bem\b|\bdata\b|$|-|\d))"
SIGNED_ON = r"(?iu)(?:assinado[^\n]{0,120}?|\bem\s+)(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s+de\s+[A-Za-z]+\s+de\s+\d{4})"


def signature(text: Column) -> Column:
    """struct(signer, signed_on, complete) of a text signature; parts that are missing are null."""
    from quarry.functions.values import parse_date

    signer = F.nullif(F.trim(F.regexp_extract(text, SIGNED, 1)), F.lit(""))
    day = parse_date(F.regexp_extract(text, SIGNED_ON, 1))
    return F.struct(signer.alias("signer"), day.alias("signed_on"), (signer.isNotNull() & day.isNotNull()).alias("complete"))


def same_signer(signer: Column, listed: Column) -> Column:
    """The name of a list that a signer with lost blanks stands for: equal once blanks, case and accents are off; null if none is."""
    from quarry.functions.text import compact

    return F.get(F.filter(listed, lambda x: compact(x) == compact(signer)), F.lit(0))


def all_matches(rows: DataFrame, key: str, text: Column, patterns: dict[str, str]) -> DataFrame:
    """(key, label, start, end, text): every match of every pattern, with its place from 0."""
    return rows.select(key, F.explode(F.concat(*(matches(text, p, n) for n, p in patterns.items()))).alias("m")).select(key, "m.label", "m.start", "m.end", "m.text")
