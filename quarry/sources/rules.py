"""Rule files: finding them in a registry folder, reading them, and listing their patterns.

Rule files are small and read on the driver; what they say becomes column expressions.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rules(path: str) -> dict:
    """One YAML or JSON rule file; an empty file gives no rules."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text or "{}")
    import yaml  # only rule files in YAML need it

    return yaml.safe_load(text) or {}


def find_rules(root: str, category: str, name: str = "*") -> list[str]:
    """Rule files of a category (a folder of the registry), by name; the folder itself if there is no such category."""
    folder = Path(root) / category
    folder = folder if folder.is_dir() else Path(root)
    return sorted(str(p) for p in folder.glob(f"{name}.*") if p.suffix.lower() in (".yml", ".yaml", ".json"))


def field_rules(loaded: dict) -> dict[str, list[dict]]:
    """Per field its sources in order. A source: band, labels, patterns (regex, group).

    Takes a field map (``sources`` of bands, labels and regexes) and a template file (band,
    ``patterns`` with {{value}}, then regexes) alike.
    """
    from quarry.functions.text import template_regex

    out: dict[str, list[dict]] = {}
    for field, body in (loaded.get("fields") or {}).items():
        sources = body.get("sources") or [body]
        out[field] = []
        for s in sources:
            value = s.get("value_regex")
            made = [(template_regex(p, f"({value})" if value else r"(.+?)") if "{{" in p else p, 1) for p in s.get("patterns") or []]
            made += [(r["pattern"], int(r.get("group", 1))) if isinstance(r, dict) else (r, 1) for r in s.get("regex") or []]
            out[field].append({"band": s.get("band", "full"), "labels": list(s.get("nlp_labels") or []), "patterns": made})
    return out


def pattern_catalog(spark: SparkSession, files: list[dict]) -> DataFrame:
    """(field, ord, band, pattern, group): the patterns of several rule files, merged per field; each once, in the order they come."""
    seen, rows = set(), []
    for loaded in files:
        for field, sources in field_rules(loaded).items():
            for s in sources:
                for pattern, group in s["patterns"]:
                    if (field, pattern) not in seen:
                        seen.add((field, pattern))
                        rows.append((field, sum(r[0] == field for r in rows), s["band"], pattern, group))
    return spark.createDataFrame(rows, "field string, ord int, band string, pattern string, group int")


def rule_catalog(rules: DataFrame, kind: str, active: list[str], most: int = 3) -> DataFrame:
    """(kind, active, rules, about): how many rules are active and how many are not, with the first ``most`` of them by name."""
    flagged = rules.withColumn("active", F.col(kind).isin(*active))
    grouped = flagged.groupBy(kind, "active").agg(F.count("*").alias("rules"), F.array_sort(F.collect_set("name")).alias("names"))
    about = F.concat(F.array_join(F.slice("names", 1, most), ", "), F.when(F.size("names") > most, F.concat(F.lit(" +"), (F.size("names") - most).cast("string"))).otherwise(""))
    return grouped.select(kind, "active", "rules", about.alias("about"))
