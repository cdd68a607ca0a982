"""Text normalisation as column expressions.

Rules are Unicode-aware: ``(?U)`` makes Java's classes cover accented letters and
non-breaking blanks, and ``(?iu)`` folds case beyond ASCII.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters that decompose into a base letter and marks.
_MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")}


def normalize_whitespace(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def remove_diacritics(c: Column) -> Column:
    """Marks off Latin letters, composed or combining."""
    return F.regexp_replace(F.translate(c, "".join(_MARKED), "".join(_MARKED.values())), r"\p{Mn}+", "")


#: The places that get a blank, in this order. The second writes the bracket again, and that is kept.
MISSING_SPACES = [
    (r"(?<=[,:;])(?=\S)", " "),
    (r"(?<=\))(?=\S)", ") "),
    (r"(?<=\S)(?=\()", " "),
    (r"(?<=[A-Za-zÀ-ÿ])(?=[0-9])", " "),
    (r"(?<=[0-9])(?=[A-Za-zÀ-ÿ])", " "),
    (r"(?<=[a-zà-ÿ])(?=[A-ZÁÂÃÀÉÊÍÓÔÕÚÇ])", " "),
]
#: Short words that stand on their own in Portuguese titles.
CONNECTORS = ["DE", "DA", "DO", "DOS", "DAS", "E", "EM", "NO", "NA", "NOS", "NAS", "POR", "PELO", "PELA"]
#: Those that are split off where they are glued between capitals, in this order.
GLUED = ["DA", "DE", "DO", "DAS", "DOS", "E", "EM", "NO", "NA", "NOS", "NAS", "AO", "AOS"]


def fix_missing_spaces(c: Column) -> Column:
    """Blanks after , : ; and ), before (, between letter and digit, and before a capital inside a word."""
    for pattern, by in MISSING_SPACES:
        c = F.regexp_replace(c, "(?U)" + pattern, by)
    return normalize_whitespace(c)


#: One character, or up to three capitals that are no connector: what joins its like across a narrow gap.
_JOINS = rf"(?:[\p{{L}}\p{{Nd}}$/\-–.,ªº°]|(?!(?:{'|'.join(CONNECTORS)})(?!\S))\p{{Lu}}{{2,3}})"


def collapse_spaced_letters(c: Column) -> Column:
    """Single characters and short capitals that stand one or two blanks apart become one word."""
    c = F.translate(c, "\u00a0\u2007\u202f\u200b\u200c\u200d\ufeff", " " * 7)
    return normalize_whitespace(F.regexp_replace(c, rf"(?U)(?<=(?<!\S){_JOINS})[ \t]{{1,2}}(?={_JOINS}(?!\S))", ""))


def fix_title_glue(c: Column) -> Column:
    """Splits wordWord where both sides have three letters or more."""
    return F.regexp_replace(c, r"(?<=\p{L}{2}\p{Ll})(?=\p{Lu}\p{L}{2})", " ")


def normalize_for_match(c: Column) -> Column:
    """No accents, lower case, letters, digits and / - . only."""
    return normalize_whitespace(F.regexp_replace(F.lower(remove_diacritics(c)), r"[^a-z0-9 /.\-]", " "))


def normalize_for_hash(c: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(F.lower(c), r"[\x00-\x1f\x7f]", " "))


def text_digest(c: Column) -> Column:
    return F.sha2(normalize_for_hash(c).cast("binary"), 256)


def normalize_for_similarity(c: Column) -> Column:
    """Lower case, each digit as #."""
    return normalize_whitespace(F.regexp_replace(F.lower(c), r"[0-9]", "#"))


def anchor_text(c: Column) -> Column:
    """No accents, lower case, everything but letters and digits as blanks."""
    return normalize_whitespace(F.regexp_replace(F.lower(remove_diacritics(c)), r"[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def odd_spacing_ratio(c: Column) -> Column:
    """Share of tokens that are one letter or digit; 0 without tokens."""
    all_tokens = tokens(c)
    odd = F.size(F.filter(all_tokens, lambda x: x.rlike(r"^[\p{L}\p{N}]$")))
    return F.when(F.size(all_tokens) > 0, odd / F.size(all_tokens)).otherwise(F.lit(0.0))


def collapse_doubled(c: Column) -> Column:
    """AABBCC becomes ABC if the length is even, and at least three pairs and 70 % of them are equal."""
    pairs = F.regexp_extract_all(c, F.lit(r"(?s)(.)(.)"), F.lit(0))
    same = F.size(F.filter(pairs, lambda p: F.substring(p, 1, 1) == F.substring(p, 2, 1)))
    doubled = (F.length(c) % 2 == 0) & (F.size(pairs) >= 3) & (same >= 0.7 * F.size(pairs))
    return F.when(doubled, F.array_join(F.transform(pairs, lambda p: F.substring(p, 1, 1)), "")).otherwise(c)


def block_pattern(c: Column) -> Column:
    """One sign a token: W for a word, 1 for a single character, : for itself."""
    return F.array_join(F.transform(tokens(c), lambda x: F.when(x == ":", ":").when(F.length(x) == 1, "1").otherwise("W")), "")


def longest_token(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(tokens(c), F.length)), F.lit(0))


#: Words that are typed as particles.
PARTICLES = "da de do dos das e em no na nos nas ao aos a o nº n° n. nr n art sr sra sr. sra.".split()


def token_type(token: Column) -> Column:
    """The type code of a token without white space.

    E mail, V money, R number sign, F, J and Q identifiers of 11, 14 and 16 or 20 digits, A date,
    P particle, N number, U, L, T and M words by case, S signs. All but mail, money signs and bare
    signs carry 1 for a single character or 2; ordinals end in a or o, and a final colon stays.
    """
    from quarry.functions.values import parse_date, parse_money

    colon = token.endswith(":")
    raw = F.when(colon & (F.length(token) > 1), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
    core = F.regexp_replace(raw, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")
    size = F.when(F.length(core) == 1, "1").otherwise("2")
    n = F.length(F.regexp_replace(core, r"[^\p{Nd}]", ""))
    letter, digit, upper, lower = (core.rlike(x) for x in (r"\p{L}", r"\p{Nd}", r"\p{Lu}", r"\p{Ll}"))
    title = core.rlike(r"^[^\p{L}]*\p{Lu}[^\p{Lu}]*$")
    code = (
        F.when(core.rlike(r"^\p{Nd}+[ªaA]$"), F.concat(F.lit("N"), size, F.lit("a")))
        .when(core.rlike(r"^\p{Nd}+[ºoO]$"), F.concat(F.lit("N"), size, F.lit("o")))
        .when(n == 11, F.concat(F.lit("F"), size))
        .when(n == 14, F.concat(F.lit("J"), size))
        .when(n.isin(16, 20), F.concat(F.lit("Q"), size))
        .when(F.contains(raw, F.lit(",")) & parse_money(raw).isNotNull(), F.concat(F.lit("V"), size))
        .when(parse_date(raw).isNotNull(), F.concat(F.lit("A"), size))
        .when(F.lower(core).isin(*PARTICLES), F.concat(F.lit("P"), size))
        .when(~letter & digit, F.concat(F.lit("N"), size))
        .when(letter & ~digit, F.concat(F.when(upper & ~lower, "U").when(lower & ~upper, "L").when(title, "T").otherwise("M"), size))
        .when(letter, F.concat(F.lit("M"), size))
        .otherwise(F.concat(F.lit("S"), size))
    )
    signed = F.concat(F.when(F.lower(raw).isin("nº", "n°", "n."), "R2").otherwise(code), F.when(colon, ":").otherwise(""))
    return F.when(F.contains(raw, F.lit("@")) & F.contains(raw, F.lit(".")), "E").when(F.lower(raw).startswith("r$"), "V").when((core == "") & ~F.lower(raw).isin("nº", "n°", "n."), "S").otherwise(signed)


def typed_pattern(c: Column) -> Column:
    """The type codes of a text's tokens."""
    return F.array_join(F.transform(tokens(c), token_type), "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def compact(c: Column) -> Column:
    """Lower-cased ASCII letters and digits alone, accents off."""
    return F.regexp_replace(F.lower(remove_diacritics(c)), r"[^a-z0-9]", "")


def count_of(c: Column, needle: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def snippet(c: Column, position: Column, around: int) -> Column:
    """The text from ``around`` characters before a 1-based place to as many after it, clamped."""
    start = F.greatest(F.lit(1), position - around)
    return F.substring(c, start, position + around - start + 1)


def top_lines(c: Column, n: int) -> Column:
    return F.slice(_lines(c), 1, n)


def bottom_lines(c: Column, n: int) -> Column:
    lines = _lines(c)
    return F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), F.lit(n))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def contains_loosely(haystack: Column, needle: str) -> Column:
    """Substring of the normalised text; a needle of several words also with all blanks out."""
    wanted = " ".join(needle.lower().split())
    text = normalize_whitespace(F.lower(haystack))
    found = F.contains(text, F.lit(wanted))
    return found | F.contains(F.replace(text, F.lit(" "), F.lit("")), F.lit(wanted.replace(" ", ""))) if " " in wanted else found


def template_regex(template: str, value: str = r"(.+?)") -> str:
    """A regex from a template: {{name}} is a value, blanks are any white space, the rest is literal."""
    parts = re.split(r"(\{\{\w+\}\})", template)
    return "".join(value if part.startswith("{{") and part.endswith("}}") else r"\s+".join(map(re.escape, re.split(r"\s+", part))) for part in parts)


def wildcard(c: Column, pattern: str) -> Column:
    """* stands for anything; the whole text, case ignored."""
    return c.rlike("(?iu)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")


def process_number(path: Column) -> Column:
    """All digits of a file's stem; null if it has none."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    return F.nullif(digits(stem), F.lit(""))


def strip_nul(c: Column) -> Column:
    """What databases and JSON don't take: the NUL character."""
    return F.regexp_replace(c, r"\x00", "")


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def _capital(c: Column) -> Column:
    """Has letters, and all of them are capitals."""
    return c.rlike(r"^[^\p{L}]*(?:\p{Lu}[^\p{L}]*)+$")


def merge_runs(c: Column, joins, least_tokens: int, least_letters: int) -> Column:
    """Runs of tokens for which ``joins(token)`` holds become one, if they have enough tokens and letters. A fold over the tokens."""
    empty = F.array().cast("array<string>")

    def flushed(acc: Column) -> Column:
        run = acc["run"]
        enough = (F.size(run) >= least_tokens) & (_letters(F.array_join(run, "")) >= least_letters)
        return F.concat(acc["done"], F.when(enough, F.array(F.array_join(run, ""))).otherwise(run))

    def step(acc: Column, token: Column) -> Column:
        part = joins(token)
        run = F.when(part, F.concat(acc["run"], F.array(token))).otherwise(empty)
        done = F.when(part, acc["done"]).otherwise(F.concat(flushed(acc), F.array(token)))
        return F.struct(run.alias("run"), done.alias("done"))

    start = F.struct(empty.alias("run"), empty.alias("done"))
    return F.array_join(F.aggregate(tokens(c), start, step, flushed), " ")


def merge_pairs(c: Column, joins) -> Column:
    """From left to right, two neighbours for which ``joins(left, right)`` holds become one word, which joins no further."""
    start = F.struct(F.lit("").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(acc: Column, token: Column) -> Column:
        held = acc["held"]
        both = held.isNotNull() & joins(held, token)
        out = F.when(both, F.concat(held, token)).otherwise(held)
        done = F.when(out.isNull(), acc["done"]).otherwise(F.concat_ws(" ", F.nullif(acc["done"], F.lit("")), out))
        return F.struct(done.alias("done"), F.when(~both, token).alias("held"))

    return F.aggregate(tokens(c), start, step, lambda acc: F.concat_ws(" ", F.nullif(acc["done"], F.lit("")), acc["held"]))


def fix_uppercase_split_tokens(c: Column) -> Column:
    """"DI RE TOR" becomes "DIRETOR": capitals of up to three letters, connectors left out."""
    return merge_runs(c, lambda x: x.rlike(r"^[^\p{L}]*(?:\p{Lu}[^\p{L}]*){1,3}$") & ~F.upper(x).isin(*CONNECTORS), 2, 4)


def fix_uppercase_token_runs(c: Column) -> Column:
    """Three words of up to three capitals or more in a row, connectors or not, become one."""
    short = r"\p{Lu}{1,3}"
    return F.regexp_replace(c, rf"(?U)(?<=(?<!\S){short} {short}) (?={short}(?!\S))|(?<=(?<!\S){short}) (?={short} {short}(?!\S))", "")


def fix_broken_words(c: Column) -> Column:
    """Fragments join the word before them; of "wor dThe" the first letter does, and the rest begins the next word.

    A fold, as what a word has grown to decides what joins it next.
    """
    start = F.struct(F.lit("").alias("done"), F.lit(None).cast("string").alias("held"))
    word = r"^\p{L}+$"

    def step(acc: Column, token: Column) -> Column:
        held = acc["held"]
        words = held.rlike(word) & token.rlike(word)
        capitals = held.rlike(r"^\p{Lu}+$") & token.rlike(r"^\p{Lu}{1,3}$")
        free = ~F.upper(held).isin(*CONNECTORS) & ~F.upper(token).isin(*CONNECTORS)
        first = free & token.rlike(r"^\p{Ll}\p{Lu}")
        short = free & ((F.length(token) <= 2) | ((F.length(held) <= 3) & (F.length(token) <= 3) & token.rlike(r"^\p{Ll}")))
        whole = F.coalesce(words & (capitals | (~first & short)), F.lit(False))
        head = F.coalesce(words & ~capitals & first, F.lit(False))
        out = F.when(head, F.concat(held, F.substring(token, 1, 1))).otherwise(held)
        done = F.when(whole | held.isNull(), acc["done"]).otherwise(F.concat_ws(" ", F.nullif(acc["done"], F.lit("")), out))
        now = F.when(whole, F.concat(held, token)).when(head, F.substring(token, F.lit(2), F.length(token))).otherwise(token)
        return F.struct(done.alias("done"), now.alias("held"))

    return F.aggregate(tokens(c), start, step, lambda acc: F.concat_ws(" ", F.nullif(acc["done"], F.lit("")), acc["held"]))


def fix_uppercase_word_splits(c: Column) -> Column:
    """Capitals of three letters or more and a tail of up to four, if that is no connector, become one word."""
    return merge_pairs(c, lambda a, b: _capital(a) & _capital(b) & ~F.upper(b).isin(*CONNECTORS) & (_letters(a) >= 3) & (_letters(b) <= 4))


def fix_uppercase_prefix_splits(c: Column) -> Column:
    """Up to three capitals before a word of four or more become its beginning, if they are no connector."""
    return merge_pairs(c, lambda a, b: _capital(a) & _capital(b) & (F.length(a) <= 3) & (F.length(b) >= 4) & ~F.upper(a).isin(*CONNECTORS, "AO", "AOS"))


def fix_uppercase_glue(c: Column) -> Column:
    """Splits connectors glued between capitals, and digits off them, in mostly capital text of two blanks at most."""
    capitals = F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    blanks = F.length(F.regexp_replace(c, "[^ \t\u00a0\u2007\u202f]", ""))
    split = F.regexp_replace(c, rf"(?<=\p{{Lu}})({'|'.join(GLUED)})(?=\p{{Lu}})", " $1 ")
    split = F.regexp_replace(split, r"(?<=[0-9])(?=\p{Lu})|(?<=\p{Lu})(?=[0-9])", " ")
    return F.when((_letters(c) > 0) & (capitals >= 0.75 * _letters(c)) & (blanks <= 2), normalize_whitespace(split)).otherwise(c)


def fix_line_break_splits(c: Column) -> Column:
    """Words cut at the ends of lines are joined, by a hyphen or as capitals of which one part is short; lines become one."""
    some = rf"(?!(?:{'|'.join(CONNECTORS)})(?!\S))"
    c = F.regexp_replace(c, r"-+[ \t]*\r?\n[ \t]*(\S)", "$1")
    cut = rf"(?<=(?<!\S){some}\p{{Lu}}{{3,40}})[ \t]*\r?\n[ \t]*(?={some}\p{{Lu}}{{1,3}}(?!\S))|(?<=(?<!\S){some}\p{{Lu}}{{1,3}})[ \t]*\r?\n[ \t]*(?={some}\p{{Lu}}{{4,}}(?!\S))"
    return normalize_whitespace(F.regexp_replace(c, "(?U)" + cut, ""))


def fix_split_words(c: Column, stop_words: list[str]) -> Column:
    """Lower-case fragments of one or two letters that are no stop words join the word before them."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, token: Column) -> Column:
        n = F.size(acc)
        joins = token.rlike(r"^\p{Ll}{1,2}$") & ~token.isin(*stop_words) & (n > 0) & F.coalesce(F.get(acc, n - 1).rlike(r"\p{L}$"), F.lit(False))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(acc, n - 1), token)))).otherwise(F.concat(acc, F.array(token)))

    return F.array_join(F.aggregate(tokens(c), empty, step), " ")


def normalize_pattern_text(c: Column) -> Column:
    """The repairs in their order: spaced letters, blanks, runs of capitals, broken words, split capitals."""
    return fix_uppercase_prefix_splits(fix_uppercase_word_splits(fix_broken_words(fix_uppercase_token_runs(fix_missing_spaces(collapse_spaced_letters(c))))))


def normalize_full_text(c: Column) -> Column:
    return normalize_whitespace(fix_title_glue(fix_uppercase_glue(fix_uppercase_split_tokens(normalize_pattern_text(c)))))


def match_text(c: Column) -> Column:
    """``normalize_for_match`` behind the repairs of a pattern text."""
    return normalize_for_match(normalize_pattern_text(c))


def dedupe_words(words: Column) -> Column:
    """Of array<struct<text, x0, y0, x1, y1>> the first of words with equal text and, to three decimals, equal place."""
    key = lambda w: F.struct(F.lower(w["text"]), *(F.round(w[k], 3) for k in ("x0", "y0", "x1", "y1")))
    keys = F.transform(words, key)
    return F.filter(words, lambda w, i: F.array_position(keys, key(w)) == i + 1)
