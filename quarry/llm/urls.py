"""URL filters: host and path rules, and beyond them trust that spreads over links.

Personalised PageRank carries trust from hosts of allowed pages along their links, and
distrust from hosts of blocked pages against the links, to those that point at them.
Only DataFrame functions run here.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.exact_dedup import ascii_lower
from quarry.storage import Scratch, join_groups

#: (verdict, rule): a rule is a host, then the beginning of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Host names after the slashes of absolute links.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first, so it is wrapped last
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chain = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, tolerance: float = 1e-7) -> DataFrame:
    """(kind, host, score): personalised PageRank by kind.

    edges (kind, src, dst, weight): weights of a source's links add up to 1 in each kind.
    seeds (kind, host, mass): add up to 1 in each kind. Ends once a round reaches no further host
    and moves no score by ``tolerance`` of its kind's mean seed, so neither the length of a chain
    nor the number of seeds decides what a host gets. Moves shrink by ``damping`` a round: rounds
    are as many as the longest way from a seed has links, or what the tolerance takes (100 by
    default), if that is more. The mass that hosts without links would pass on is lost.
    """
    means = seeds.groupBy("kind").agg(F.avg("mass").alias("mean"))  # a row for each kind
    base = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score"))
    now = scratch.keep(base, "scores0")
    for turn in count(1):
        sent = now.join(edges, (now["kind"] == edges["kind"]) & (now["host"] == edges["src"])).select(edges["kind"], F.col("dst").alias("host"), (F.col("score") * F.col("weight") * damping).alias("score"))
        summed = sent.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        new = scratch.keep(summed, f"scores{turn}")
        old = now.withColumnRenamed("score", "old")
        both = new.join(old, ["kind", "host"], "left").join(F.broadcast(means), "kind")
        moved, fresh = both.agg(F.max(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))) / F.col("mean")), F.count_if(F.col("old").isNull())).first()
        scratch.drop(f"scores{turn - 1}")
        now = new
        if moved is None or (not fresh and moved < tolerance):
            break
    return now


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, trust, distrust.

    A rule fits its host and all subdomains, if the path begins with the rule's; the longest
    gives the verdict. Pages without a rule go by their host: block if distrust is over
    ``threshold`` of trust and distrust together, else allow.

    Null urls, and those without ://, have an empty host and path, fit no rule and are in no
    link; they are allowed. Null html has no links. Repeated pages count as often as they
    occur; hosts nothing reaches have neither trust nor distrust. An empty table gives no
    rows; other columns are ignored. ``rules`` is a short list that becomes one expression.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rules = RULES if rules is None else rules
    url = pages[url_col].cast("string")
    judged = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = scratch.keep(judged.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)), "judged")

    counts = judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("fit.verdict") == "allow").alias("allow"), F.count_if(F.col("fit.verdict") == "block").alias("block"))
    counts = scratch.keep(counts, "counts")
    kinds = counts.where("host != ''").select("host", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("k")) for kind in ("allow", "block")))).alias("s"))
    kinds = kinds.select("host", "s.kind", "s.k").where("k > 0")
    totals = kinds.groupBy("kind").agg(F.sum("k").alias("total"))  # two rows
    seeds = kinds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("k") / F.col("total")).alias("mass"))

    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(pages[html_col].cast("string"), F.lit("")), F.lit(LINK), F.lit(1)), ascii_lower))
    links = pages.select(host_of(url).alias("src"), F.explode(targets).alias("dst")).where("src != '' and dst != '' and src != dst")
    links = scratch.keep(links.groupBy("src", "dst").agg(F.count("*").alias("w")), "links")
    along = links.select(F.lit("allow").alias("kind"), "src", "dst", "w")
    against = links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    both = along.unionByName(against)
    out = scratch.keep(both.groupBy(F.concat_ws(" ", "kind", "src").alias("key")).agg(F.sum("w").alias("out")), "out")
    edges = join_groups(both.withColumn("key", F.concat_ws(" ", "kind", "src")), out, "key")
    edges = scratch.keep(edges.select("kind", "src", "dst", (F.col("w") / F.col("out")).alias("weight")), "edges")

    scores = propagate(edges, seeds, scratch)
    by_host = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "allow", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "block", F.col("score"))).alias("distrust"))
    hosts = counts.select("host").join(by_host, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    done = join_groups(judged, scratch.keep(hosts, "hosts"), "host")
    by_links = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return done.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_links).alias("verdict"), "trust", "distrust")
