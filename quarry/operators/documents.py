"""What kind of document a text is: guards, strong signals, rejected phrases, evidence by page part."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import contains_loosely, match_text, normalize_whitespace, remove_diacritics

UNKNOWN = "UNKNOWN"


@dataclass
class Kind:
    """The rules of one kind of document."""

    key: str
    aliases: list[str] = field(default_factory=list)
    require: list[str] = field(default_factory=list)  # all of them
    any: list[str] = field(default_factory=list)  # and one of these
    strong_any: list[str] = field(default_factory=list)
    strong_pairs: list[list[str]] = field(default_factory=list)
    blocked_any: list[str] = field(default_factory=list)
    blocked_all: list[str] = field(default_factory=list)
    title_keywords: list[str] = field(default_factory=list)
    bookmark_keywords: list[str] = field(default_factory=list)
    contents_keywords: list[str] = field(default_factory=list)
    header_keywords: list[str] = field(default_factory=list)


def kinds_from(loaded: dict) -> list[Kind]:
    """Kinds from a detection rule file (``docs`` by key), in the file's order."""
    out = []
    for key, body in (loaded.get("docs") or {}).items():
        guard = body.get("guard") or {}
        lists = {k: list(body.get(k) or []) for k in ("aliases", "strong_any", "strong_pairs", "blocked_any", "blocked_all", "title_keywords", "bookmark_keywords", "contents_keywords", "header_keywords")}
        out.append(Kind(key, require=list(guard.get("require") or []), any=list(guard.get("any") or []), **lists))
    return out


def document_text(c: Column) -> Column:
    """Accents off, lower case, single blanks; null is empty."""
    return F.coalesce(normalize_whitespace(F.lower(remove_diacritics(c))), F.lit(""))


def has_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | contains_loosely(c, w)
    return out


def has_all(c: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & contains_loosely(c, w)
    return out


def guard(c: Column, require: list[str], some: list[str]) -> Column:
    """All required words and, if there are any, one of the others; never true without rules or text."""
    if not require and not some:
        return F.lit(False)
    return (c != "") & has_all(c, require) & (has_any(c, some) if some else F.lit(True))


def strong(c: Column, some: list[str], groups: list[list[str]]) -> Column:
    """One of the words, or all of one group."""
    out = has_any(c, some)
    for g in groups:
        if g:
            out = out | has_all(c, g)
    return (c != "") & out


def blocked(c: Column, some: list[str], every: list[str]) -> Column:
    return (c != "") & (has_any(c, some) | (has_all(c, every) if every else F.lit(False)))


def is_kind(c: Column, kind: Kind) -> Column:
    """Guard or strong signals, and not blocked; ``c`` is a document text."""
    return (guard(c, kind.require, kind.any) | strong(c, kind.strong_any, kind.strong_pairs)) & ~blocked(c, kind.blocked_any, kind.blocked_all)


def is_kind_of_parts(top: Column, body: Column, kind: Kind) -> Column:
    """The kind of a page of which the top and the body are known: either part, or both together."""
    both = normalize_whitespace(F.concat_ws(" ", top, body))
    return is_kind(top, kind) | is_kind(body, kind) | is_kind(both, kind)


def is_signature_page(c: Column, markers: list[str], headers: list[str]) -> Column:
    """Three markers or more and none of the headers that only a document itself has; a page without text counts."""
    hits = sum((F.contains(c, F.lit(m)).cast("int") for m in markers), F.lit(0))
    header = F.lit(False)
    for h in headers:
        header = header | F.contains(c, F.lit(h))
    return (c == "") | ((hits >= 3) & ~header)


def is_rejected(c: Column, phrases: list[str], loose: bool = False) -> Column:
    """Holds a rejected phrase, with or without blanks; ``loose`` also compares repaired texts."""
    text = document_text(c)
    packed = F.replace(text, F.lit(" "), F.lit(""))
    out = F.lit(False)
    for p in phrases:
        phrase = document_text(F.lit(p))
        out = out | ((phrase != "") & (F.contains(text, phrase) | F.contains(packed, F.replace(phrase, F.lit(" "), F.lit("")))))
        if loose:
            out = out | ((match_text(F.lit(p)) != "") & F.contains(match_text(F.coalesce(c, F.lit(""))), match_text(F.lit(p))))
    return (text != "") & out


def kind_key(hint: Column, kinds: list[Kind]) -> Column:
    """The key of the kind that a hint, a path or an output type names: its key or an alias, signs and case aside; null if none.

    An alias must be the whole hint or a part of it between signs; longer aliases are asked first.
    """
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(remove_diacritics(hint)), "[^a-z0-9]+", " ")), F.lit(" "))
    names = sorted({(" ".join("".join(ch if ch.isalnum() else " " for ch in a.lower()).split()), k.key) for k in kinds for a in [k.key, *k.aliases]}, key=lambda x: (-len(x[0]), x))
    out = F.lit(None).cast("string")
    for alias, key in reversed(names):
        out = F.when(F.contains(plain, F.lit(f" {alias} ")), key).otherwise(out)
    return out


def own_aliases(kinds: list[Kind], key: str) -> tuple[list[str], list[str]]:
    """The alias words of a kind, and those of the others that it has not."""
    words = {k.key: {w for a in [k.key, *k.aliases] for w in a.lower().replace("_", " ").split()} for k in kinds}
    own = words.get(key, set())
    return sorted(own), sorted(set().union(*words.values()) - own)


def keywords(kinds: list[Kind], which: str, key: str | None = None) -> list[str]:
    """One dimension of keywords (title, contents, header, bookmark, guard) of a kind, or of all; each once, in order."""
    out: list[str] = []
    for k in kinds:
        if key in (None, k.key):
            found = [*k.require, *k.any] if which == "guard" else getattr(k, f"{which}_keywords")
            out += [w for w in found if w not in out]
    return out


def page_evidence(parts: list[tuple[str, list[Column]]], order: list[tuple[str, Column, bool]], blocked_flag: Column) -> Column:
    """struct(kind, method): the first rule that holds in the first part that has one.

    ``parts``: (method, texts), asked in turn; ``order``: (key, predicate of a text, whether a
    blocked page is exempt). Without any the kind is UNKNOWN and the method empty.
    """
    out = F.struct(F.lit(UNKNOWN).alias("kind"), F.lit("").alias("method"))
    for method, texts in reversed(parts):
        for key, test, exempt in reversed(order):
            hit = F.lit(False)
            for t in texts:
                hit = hit | F.coalesce(test(t), F.lit(False))
            if exempt:
                hit = hit & ~blocked_flag
            out = F.when(hit, F.struct(F.lit(key).alias("kind"), F.lit(method).alias("method"))).otherwise(out)
    return out


def accept_other(guard_pass: Column, strong_pass: Column, titled: Column, score: Column, least: float = 6.0) -> Column:
    """Whether a winner that is not the usual kind is accepted: its guard, or strong signals with a title and a score."""
    return guard_pass | (strong_pass & titled & (score >= least))


def cross_check(target: Column, passes: dict[str, Column]) -> Column:
    """struct(own, other): whether the target's kind passes, and whether another one does."""
    own, other = F.lit(False), F.lit(False)
    for key, ok in passes.items():
        own = own | ((target == key) & F.coalesce(ok, F.lit(False)))
        other = other | ((target != key) & F.coalesce(ok, F.lit(False)))
    return F.struct(own.alias("own"), other.alias("other"))


def candidate_score(parts: list[tuple[Column, int]]) -> Column:
    """The sum of the points of the tests that hold, not under 0."""
    return F.greatest(F.lit(0), sum((F.when(F.coalesce(test, F.lit(False)), points).otherwise(0) for test, points in parts), F.lit(0)))


def classify_titles(titles: DataFrame, title: str, exact: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """titles with canon, macro and subcat: from the exact map by plain title, else by the first rule (keyword, canon, macro, subcat), else 'outros'."""
    plain = document_text(F.col(title))
    canon, macro, sub = (F.lit(x) for x in ("outros", "outros", "outros"))
    for word, c, m, s in reversed(rules):
        hit = F.contains(plain, F.lit(word))
        canon, macro, sub = F.when(hit, c).otherwise(canon), F.when(hit, m).otherwise(macro), F.when(hit, s).otherwise(sub)
    known = exact.select(F.col("title").alias("_t"), F.struct("canon", "macro", "subcat").alias("_k"))
    joined = titles.withColumn("_t", plain).join(known, "_t", "left").drop("_t")
    named = [F.coalesce(F.col(f"_k.{n}"), c).alias(n) for n, c in (("canon", canon), ("macro", macro), ("subcat", sub))]
    return joined.select(*(joined[c] for c in titles.columns), *named)


#: What a marked or short block stands for, by a part of its letters; the first that occurs counts.
ANCHOR_HINTS = [
    ("PROCESSOADMIN", "processo administrativo"), ("PROCESSO_ADMIN", "processo administrativo"), ("PROCESSOJUDICIAL", "processo judicial"), ("PROCESSO_JUDICIAL", "processo judicial"), ("VARA", "vara"), ("COMARCA", "comarca"),
    ("CPF", "cpf"), ("PERITO", "perito"), ("PROMOVENTE", "movido por"), ("PROMOVIDO", "em face de"), ("ESPECIALIDADE", "especialidade"), ("ESPECIE", "pericia"), ("PERICIA", "pericia"), ("VALOR", "valor r"),
    ("TRIBUNAL", "tribunal de justica"), ("DIRETORIA", "diretoria especial"), ("ASSINATURA", "assinatura"), ("ENCAMINHE", "encaminhe se"), ("DATA", "data"),
]
#: Short texts that mark a place by themselves.
CUES = ["vara", "comarca", "cpf", "perito", "especialidade", "pericia", "processo administrativo", "processo judicial", "movido por", "em face de", "valor r", "data"]


def similarity_text(c: Column) -> Column:
    """A block as it is compared: an anchor as what it stands for, else single blanks; lower case, each digit as #."""
    text = normalize_whitespace(F.coalesce(c, F.lit("")))
    plain = normalize_whitespace(F.regexp_replace(F.lower(remove_diacritics(text)), "[^a-z0-9_ ]", " "))
    marked = text.rlike(r"<\s*[A-Za-z_][A-Za-z0-9_]*\s*>|(?i:ANC_|\[ANC|^ANC )") | F.contains(plain, F.lit("anc")) | plain.isin(*CUES)
    letters = F.regexp_replace(F.upper(remove_diacritics(text)), r"[^\p{L}\p{Nd}_]", "")
    token = F.regexp_replace(F.when(F.contains(letters, F.lit("ANC")), F.regexp_replace(letters, "^.*?ANC", "")).otherwise(letters), "^_+|_+$", "")
    hint = F.lit("")
    for part, name in reversed(ANCHOR_HINTS):
        hint = F.when(F.contains(token, F.lit(part)), name).otherwise(hint)
    return F.regexp_replace(F.lower(F.when(marked & (hint != ""), hint).otherwise(text)), r"\p{Nd}", "#")


def find_pages(pages: DataFrame, file: str, page: str, text: str, pattern: str) -> DataFrame:
    """(file, hits, pages, first, last): pages that match, in order, and the best pair: the first matching page that the next one follows.

    Without a pair, first and last are the first match.
    """
    from pyspark.sql import Window as W

    hit = pages.where(F.col(text).rlike(pattern)).select(file, page).distinct()
    paired = hit.withColumn("_next", F.lead(page).over(W.partitionBy(file).orderBy(page)) == F.col(page) + 1)
    grouped = paired.groupBy(file).agg(F.count("*").alias("hits"), F.array_sort(F.collect_list(page)).alias("pages"), F.min(F.when(F.col("_next"), F.col(page))).alias("_p"))
    return grouped.select(file, "hits", "pages", F.coalesce("_p", F.get("pages", F.lit(0))).alias("first"), F.coalesce(F.col("_p") + 1, F.get("pages", F.lit(0))).alias("last"))


def select_page(pages: DataFrame, file: str, page: str, score: Column, size: str) -> DataFrame:
    """The page of each file that scores best; of equals the one with the largest stream, then the first. Files without a score give none."""
    from quarry.operators.assemble import best_of

    return best_of(pages.withColumn("_score", score).where("_score > 0"), [file], "_score", [F.desc(size), page]).drop("_score")


def best_per_kind(evidence: DataFrame, file: str, kind: str, strength: str, page: str) -> DataFrame:
    """(file, kind, page, strength): for each kind found in a file its strongest page, the first of equals; unknown ones go."""
    from quarry.operators.assemble import best_of

    known = evidence.where((F.col(kind) != UNKNOWN) & F.col(kind).isNotNull()).select(file, kind, page, strength)
    return best_of(known, [file, kind], strength, [page])


def record_issues(values: Column, institutions: str) -> Column:
    """Issues of a record's map, in order: a CPF of the wrong length, and institutions where a person or party belongs."""
    get = lambda k: F.coalesce(F.try_element_at(values, F.lit(k)), F.lit(""))
    n = F.length(F.regexp_replace(get("CPF_PERITO"), "[^0-9]", ""))
    named = [("PROMOVENTE", "institutional_in_party"), ("PROMOVIDO", "institutional_in_party"), ("PERITO", "institutional_in_name")]
    flags = [F.when((n > 0) & (n != 11), "CPF_PERITO:cpf_invalid")] + [F.when(F.lower(remove_diacritics(get(k))).rlike(institutions), f"{k}:{code}") for k, code in named]
    return F.array_compact(F.array(*flags))
