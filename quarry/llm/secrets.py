"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that any match must hold.
Posting lists of those trigrams are intersected to candidate documents, and only those
are scanned by the rule. Rules without a mandatory trigram scan every text. Only
DataFrame functions run here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.storage import Scratch, key_filter, may_be_in

_parser, _ops = re._parser, re._constants


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex that Java and Python read alike, and the least length of a group (0: the match)."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run is taken whole, so the least length can stand in the regex.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:authorization: *bearer) +[A-Za-z0-9._~+/=-]{16,}"),
]

SPANS = "array<struct<start:int,order:int,end:int>>"
#: Alternatives kept while a regex is read; a part with more is read as "anything".
MOST_STRINGS = 64


def _strings(node) -> set[str] | None:
    """All strings a part of a regex can match, lower-cased; None if they are too many to list."""
    out = {""}
    for op, value in node:
        if op is _ops.LITERAL:
            part = {chr(value).lower()}
        elif op is _ops.SUBPATTERN:
            part = _strings(value[-1])
        elif op is _ops.BRANCH:
            found = [_strings(b) for b in value[1]]
            part = None if None in found else set().union(*found)
        elif op is _ops.IN and all(o is _ops.LITERAL for o, _ in value):
            part = {chr(v).lower() for _, v in value}
        elif op is _ops.MAX_REPEAT and value[1] <= 4:
            inner = _strings(value[2])
            part = None if inner is None else set().union(*({"".join(c) for c in _powers(inner, n)} for n in range(value[0], value[1] + 1)))
        else:
            part = None
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _powers(strings: set[str], n: int):
    return [(s,) for s in strings] if n == 1 else [()] if n == 0 else [(*p, s) for p in _powers(strings, n - 1) for s in strings]


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """All clauses must hold; a clause holds if all trigrams of one of its alternatives occur.

    The runs of a regex whose strings can be listed give the clauses; no clause means the
    rule has no mandatory trigram.
    """

    def flat(node):
        for op, value in node:
            if op is _ops.SUBPATTERN and _strings(value[-1]) is None:
                yield from flat(value[-1])
            elif op is _ops.MAX_REPEAT and value[0] >= 1 and value[1] > 4:
                yield None
                yield from flat(value[2])
                yield None
            else:
                yield (op, value)

    clauses, run = [], {""}

    def close():
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if grams and all(grams):
            clauses.append(sorted({g for g in grams if not any(h < g for h in grams)}, key=sorted))

    for item in flat(_parser.parse(regex)):
        part = None if item is None else _strings([item])
        if part is None or len(run) * len(part) > MOST_STRINGS:
            close()
            run = part or {""}
        else:
            run = {a + b for a in run for b in part}
    close()
    return clauses


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct(start, order, end)> of a rule's matches, leftmost first, in code points.

    The texts between matches and the matches themselves add up to the places.
    """
    found, values = (F.regexp_extract_all(text, F.lit(rule.regex), F.lit(g)) for g in (0, rule.group))
    gaps = F.slice(F.split(text, rule.regex, -1), F.lit(1), F.size(found))
    # Arrays are read once here; inside the lambda they would be made anew for each match.
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(values, F.length).alias("value"))
    empty = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        span = F.array(F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.when(x["value"] >= rule.least, span).otherwise(empty)).alias("spans"))

    every = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]
    return F.when(text.rlike(rule.regex), every).otherwise(empty)


def _joined(parts: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(parts), lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"], s["end"])), ",")


def _of(order: int):
    return lambda s: s["order"] == order


def build_index(rows: DataFrame, trigrams: list[str], scratch: Scratch) -> DataFrame:
    """(trigram, key): posting lists over rows (key, text), of the trigrams that the rules need."""
    low = F.lower("text")
    held = F.filter(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))), lambda x: x.isNotNull())
    return scratch.keep(rows.select("key", F.explode(held).alias("trigram")).repartition("trigram", "key").sortWithinPartitions("trigram", "key"), "index")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list[Rule] | None = None, more: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, base and spans: arrays of struct(start, order, end), sorted; order numbers the rules.

    Matches of a rule don't overlap, leftmost first, and those whose group is shorter than
    the rule's least length go; matches of different rules may overlap. ``base`` has those
    of the ``base`` rules alone. Places count code points, ends are exclusive.

    Null and empty texts have no spans; repeated rows each get their own. An empty table
    gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    base, more = BASE if base is None else base, MORE if more is None else more
    rules = [*base, *more]
    queries = [trigram_query(r.regex) for r in rules]
    trigrams = sorted({t for q in queries for clause in q for alternative in clause for t in alternative})
    number = {t: i for i, t in enumerate(trigrams)}
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(docs[id_col], text).alias("key"))

    plan = [(number[t], r, c, a, len(alternative)) for r, q in enumerate(queries) for c, clause in enumerate(q) for a, alternative in enumerate(clause) for t in alternative]
    clauses = [(r, len(q)) for r, q in enumerate(queries) if q]
    if plan:
        plan_rows = docs.sparkSession.createDataFrame(plan, "trigram int, rule int, clause int, alternative int, need int")
        clause_rows = docs.sparkSession.createDataFrame(clauses, "rule int, clauses int")
        index = build_index(rows, trigrams, scratch)
        # The plan has a row per trigram of the rules. A key holds each trigram once, and so do equal rows.
        whole = index.distinct().join(F.broadcast(plan_rows), "trigram").groupBy("key", "rule", "clause", "alternative").agg(F.count("*").alias("k"), F.first("need").alias("need")).where("k = need")
        passed = whole.groupBy("key", "rule").agg(F.count_distinct("clause").alias("k")).join(F.broadcast(clause_rows), "rule").where("k = clauses")
        candidates = scratch.keep(passed.groupBy("key").agg(F.collect_set("rule").alias("rules")), "candidates")
        may = may_be_in(key_filter(candidates, "key"), F.col("key"))
        none = F.lit(None).cast("array<int>").alias("rules")
        # Only texts that may be candidates meet their list of rules.
        rows = rows.where(may).join(candidates, "key", "left").select("id", "text", "rules").unionByName(rows.where(~may).select("id", "text", none))
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))

    empty = F.array().cast(SPANS)
    found = [F.when(F.coalesce(F.array_contains("rules", r), F.lit(False)), spans(F.col("text"), rule, r)).otherwise(empty) if q else spans(F.col("text"), rule, r) for r, (rule, q) in enumerate(zip(rules, queries))]
    out = rows.select("id", F.array_sort(F.concat(*found)).alias("spans"))
    return out.select(F.col("id").alias(id_col), F.filter("spans", lambda s: s["order"] < len(base)).alias("base"), "spans")


def scan_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` with the counts per base rule, and the spans as text: kind:start:end, by start, then in the rules' order."""
    kinds = [r.kind for r in (*BASE, *MORE)]
    found = scan(docs, id_col, text_col)
    counts = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select(id_col, *counts, F.sha2(_joined(F.col("base"), kinds).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans"), kinds).alias("spans"))
