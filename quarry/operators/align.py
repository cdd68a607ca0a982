"""Alignment of two block sequences: weighted chains, global alignment, token diffs.

A pair of documents is one row that holds its blocks, so its own size bounds the dynamic
program's memory; pairs spread over the cluster by key and come to Python in batches.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = -0.35


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Edits of single items from ``a`` to ``b``; columns of the distance matrix are held as bits."""
    if not a or not b:
        return max(len(a), len(b))
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = full, 0, len(a)
    for y in b:
        at = places.get(y, 0)
        keep = (((at & plus) + plus) ^ plus) | at | minus
        up, down = minus | (full & ~(keep | plus)), plus & keep
        distance += (up & last > 0) - (down & last > 0)
        up = (up << 1) & full | 1
        plus, minus = (down << 1) & full | full & ~(keep | up), up & keep
    return distance


def plain(text: str) -> str:
    """Accents off, lower case, everything but letters, digits and # as single blanks."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^a-z0-9#]+", " ", bare).split())


def words_of(text: str) -> list[str]:
    """Plain words; three single letters or more in a row are one."""
    joined = re.sub(r"(?<![a-z0-9#])[a-z](?: [a-z](?![a-z0-9#])){2,}", lambda m: m[0].replace(" ", ""), plain(text))
    return joined.split()


def _likeness(a: Sequence, b: Sequence, share: float) -> float:
    longer = max(len(a), len(b))
    return share * (1 - edit_distance(a, b) / longer) + (1 - share) * (1 - abs(len(a) - len(b)) / longer) if longer else 1.0


def word_similarity(a: str, b: str) -> float:
    """0.78 for few edits of words and 0.22 for like numbers of them; 0 if only one text has any."""
    x, y = words_of(a), words_of(b)
    return _likeness(x, y, 0.78) if x and y else float(not x and not y)


def similarity(a: str, b: str) -> float:
    """Likeness of letters (0.7 edits, 0.3 lengths) and of words, which count for more in longer texts."""
    if not a or not b:
        return float(not a and not b)
    letters = _likeness(a, b, 0.7)
    fewest = min(len(words_of(a)), len(words_of(b)))
    if not fewest:
        return letters
    weight = 0.60 if fewest >= 8 else 0.48 if fewest >= 4 else 0.30
    return min(1.0, max(0.0, letters * (1 - weight) + word_similarity(a, b) * weight))


#: How a label begins once it is plain, and the field it names; the first that fits counts.
LABELS = [
    ("processo administrativo", "processo_administrativo"), ("sei", "processo_administrativo"), ("adme", "processo_administrativo"),
    ("processo judicial", "processo_judicial"), ("acao", "processo_judicial"), ("requerente", "requerente"), ("interessad", "interessado"),
    ("promovent", "promovente"), ("promovid", "promovido"), ("assunto", "assunto"), ("processo", "processo"), ("cpf", "cpf"), ("cnpj", "cnpj"),
    ("perito", "perito"), ("perita", "perito"), ("vara", "vara"), ("comarca", "comarca"), ("especialidade", "especialidade"),
    ("pericia", "especie_da_pericia"), ("adiantamento", "adiantamento"), ("parcela", "parcela"), ("percentual", "percentual"), ("valor", "valor"), ("data", "data"),
]
#: Labels of which two different ones must not meet, and short texts that mark a place of the model.
CRITICAL = {"processo_administrativo", "processo_judicial", "requerente", "interessado", "promovente", "promovido", "assunto", "perito", "cpf_perito", "cpf", "cnpj", "comarca", "vara"}
CUES = {"vara", "comarca", "cpf", "perito", "especialidade", "pericia", "processo administrativo", "processo judicial", "movido por", "em face de", "valor r", "data"}


def label_of(head: str) -> str:
    """The field that a label names; with or without its blanks."""
    text = plain(head).replace("#", "")
    return next((field for start, field in LABELS if text.startswith(start) or text.replace(" ", "").startswith(start.replace(" ", ""))), "")


def leading_label(text: str) -> tuple[str, float]:
    """The field that a block's beginning names, and how sure that is: before a colon, before a dash or comma, or just there."""
    text, best = " ".join(text.split()), ("", 0.0)
    colon = text.find(":")
    if 0 < colon <= 60 and (label := label_of(text[:colon])):
        best = (label, 0.95)
    dash = min((i for i in map(text.find, "-–—,") if i >= 0), default=-1)
    if 0 < dash <= 40 and best[1] < 0.75 and (label := label_of(text[:dash])):
        best = (label, 0.75)
    if label := label_of(text[:48]):
        sure = 0.70 if label.startswith("processo") or label in ("cpf", "cnpj") else 0.60
        best = max(best, (label, sure), key=lambda x: x[1])
    return best


def alignment_similarity(a: str, b: str, key_of=None) -> float:
    """Likeness of two blocks, raised if they begin with one label and lowered if with two or if only one has any.

    ``key_of`` may name a helper key of a block; equal and different keys count as well.
    """
    like = similarity(a, b)
    if key_of:
        x, y = key_of(a), key_of(b)
        like += (0.18 if x == y else -0.24) if x and y else -0.10 if x or y else 0.0
    (x, sure_x), (y, sure_y) = leading_label(a), leading_label(b)
    if x and y:
        sure, both = min(sure_x, sure_y), x in CRITICAL and y in CRITICAL
        if x == y:
            like += 0.24 if sure >= 0.9 else 0.16
        else:
            like -= 0.64 if both and sure >= 0.9 else 0.44 if both and sure >= 0.75 else 0.34 if sure >= 0.9 else 0.24 if sure >= 0.7 else 0.14
    elif x or y:
        like -= 0.16 if max(sure_x, sure_y) >= 0.9 else 0.10
    return max(-1.0, min(1.0, like))


def anchors_clash(a: str, b: str) -> bool:
    """Whether two blocks surely begin with different critical labels, so that they can't anchor each other."""
    (x, sure_x), (y, sure_y) = leading_label(a), leading_label(b)
    return bool(x and y and x != y and {x, y} <= CRITICAL and min(sure_x, sure_y) >= 0.9)


def is_cue(text: str) -> bool:
    """A short block that marks a place of the model: named as an anchor, or one of the cues alone."""
    text = plain(text)
    return "anc" in text or text in CUES


def line_ratio(a: str, b: str) -> float:
    """Edits over the longer text: 0 for equal ones, 1 for nothing in common."""
    longer = max(len(a), len(b))
    return edit_distance(a, b) / longer if longer else 0.0


def report_similarity(a: str, b: str) -> float:
    """What edits leave of two normalised texts."""
    return 1 - line_ratio(plain(a), plain(b))


def page_signal(header: float, title: float, structure: float, fields: float) -> float:
    """How much a page is like a model's: its weighted parts."""
    return 0.45 * header + 0.25 * title + 0.30 * structure + 0.55 * fields


def best_chain(points: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The chain of greatest total score that rises strictly in both numbers; prefix maxima over a tree, n log n."""
    ranks = sorted({b for _, b, _ in points})
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(ranks) + 1)
    best: list[tuple[float, int]] = []
    order = sorted(range(len(points)), key=lambda i: (points[i][0], -points[i][1]))
    totals = {}
    for i in order:
        _, b, score = points[i]
        at = bisect.bisect_left(ranks, b)
        found, k = (0.0, -1), at
        while k > 0:
            found = max(found, tree[k])
            k -= k & -k
        totals[i] = (found[0] + score, found[1])
        k = at + 1
        while k <= len(ranks):
            tree[k] = max(tree[k], (totals[i][0], i))
            k += k & -k
    if not points:
        return best
    at = max(totals, key=lambda i: (totals[i][0], -i))
    chain = []
    while at >= 0:
        chain.append(points[at])
        at = totals[at][1]
    return chain[::-1]


def align(a: list[str], b: list[str], least: float = 0.12, band: int = 24, gap: float = GAP, least_ratio: float = 0.05, length_penalty: float = 0.0, like=alignment_similarity) -> list[tuple[int, int, float]]:
    """Steps (place in a, place in b, similarity) of the best global alignment; -1 marks a gap.

    Blocks pair by their likeness from ``least`` on (0.08 beside a cue), less ``length_penalty``
    for unlike lengths, if the shorter has ``least_ratio`` of the longer; others may still pair,
    at a lower score. Pairs are sought within the band of the diagonal, which is as wide as the
    lengths differ, at least. Only gaps lie beyond it, and as gaps may change places, some path
    inside the band is as good: memory is the band's.
    """
    n, m = len(a), len(b)
    width = max(band, abs(n - m) + 2)
    low = float("-inf")
    cues = [is_cue(x) for x in a], [is_cue(x) for x in b]
    before = [low] * (2 * width + 1)  # scores of a row; place j - i + width
    ways: list[bytearray] = []
    met: dict[tuple[int, int], float] = {}
    for i in range(n + 1):
        row, way = [low] * (2 * width + 1), bytearray(2 * width + 1)
        for j in range(max(0, i - width), min(m, i + width) + 1):
            at = j - i + width
            if i == j == 0:
                row[at] = 0.0
                continue
            best, step = low, 0
            if i and j:
                s = met[i - 1, j - 1] = like(a[i - 1], b[j - 1])
                cue = cues[0][i - 1] or cues[1][j - 1]
                x, y = len(a[i - 1]), len(b[j - 1])
                ratio = min(x, y) / max(x, y) if x and y else 0.0
                fits = ratio >= least_ratio or cue
                if s >= (min(least, 0.08) if cue else least) and fits:
                    gain = s - (0.0 if cue else (1 - ratio) * length_penalty)
                else:
                    gain = 0.35 * s - 0.15 - (0.0 if fits else 0.05)
                best, step = before[at] + gain, 1
            if i and at + 1 <= 2 * width and before[at + 1] + gap > best:
                best, step = before[at + 1] + gap, 2
            if j and at and row[at - 1] + gap > best:
                best, step = row[at - 1] + gap, 3
            row[at], way[at] = best, step
        before = row
        ways.append(way)
    steps, i, j = [], n, m
    while i or j:
        step = ways[i][j - i + width]
        if step == 1:
            i, j = i - 1, j - 1
            steps.append((i, j, met[i, j]))
        elif step == 2:
            i -= 1
            steps.append((i, -1, 0.0))
        else:
            j -= 1
            steps.append((-1, j, 0.0))
    return steps[::-1]


def align_anchored(a: list[str], b: list[str], anchors: list[tuple[int, int, float]], **options) -> list[tuple[int, int, float]]:
    """The alignment in which given pairs (place in a, place in b, score) stand fast; what lies between them is aligned by itself.

    Pairs must rise in both places; a pair of clashing labels is left out.
    """
    steps, i, j = [], 0, 0
    for x, y, score in [*(p for p in anchors if not anchors_clash(a[p[0]], b[p[1]])), (len(a), len(b), None)]:
        steps += [(p + i if p >= 0 else -1, q + j if q >= 0 else -1, s) for p, q, s in align(a[i:x], b[j:y], **options)]
        if score is not None:
            steps.append((x, y, score))
        i, j = x + 1, y + 1
    return steps


def align_documents(pairs: DataFrame, pair: str, side: str, order: str, text: str, least: float = 0.12) -> DataFrame:
    """(pair, step, kind, a_order, b_order, score) from rows of both sides ('a' and 'b') of each pair.

    kind: fixed for equal blocks, variable for other paired ones, gap_a or gap_b for a block
    that only the other side has.
    """

    def run(batches):
        for rows in batches:
            out = []
            for key, held in zip(rows["pair"], rows["blocks"]):
                sides = {s: sorted((int(h["n"]), h["t"] or "") for h in held if h["s"] == s) for s in ("a", "b")}
                a, b = ([t for _, t in sides[s]] for s in ("a", "b"))
                for n, (i, j, score) in enumerate(align(a, b, least)):
                    kind = "gap_a" if i < 0 else "gap_b" if j < 0 else "fixed" if a[i] == b[j] else "variable"
                    out.append((key, n, kind, sides["a"][i][0] if i >= 0 else None, sides["b"][j][0] if j >= 0 else None, round(score, 6)))
            yield pd.DataFrame(out, columns=["pair", "step", "kind", "a_order", "b_order", "score"]).astype({"a_order": "Int64", "b_order": "Int64"})

    kind = pairs.schema[pair].dataType.simpleString()
    held = pairs.groupBy(F.col(pair).alias("pair")).agg(F.collect_list(F.struct(F.col(side).alias("s"), F.col(order).alias("n"), F.col(text).alias("t"))).alias("blocks"))
    return held.mapInPandas(run, f"pair {kind}, step int, kind string, a_order long, b_order long, score double")


def token_diff(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, n, op, text): runs of equal, deleted and inserted words from text ``a`` to text ``b``."""

    def run(batches):
        for rows in batches:
            out = []
            for k, x, y in zip(rows[key], rows[a], rows[b]):
                x, y, n = (x or "").split(), (y or "").split(), 0
                for tag, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                    for op, words in (("equal", x[i1:i2]),) if tag == "equal" else (("delete", x[i1:i2]), ("insert", y[j1:j2])):
                        if words:
                            out.append((k, n, op, " ".join(words)))
                            n += 1
            yield pd.DataFrame(out, columns=["key", "n", "op", "text"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, a, b).mapInPandas(run, f"key {kind}, n int, op string, text string")


def chains(points: DataFrame, group: str, a: str, b: str, score: str) -> DataFrame:
    """(group, a, b, score): the points of each group's best chain."""

    def run(batches):
        for rows in batches:
            out = [(key, *p) for key, held in zip(rows["g"], rows["points"]) for p in best_chain([(int(h["a"]), int(h["b"]), float(h["s"])) for h in held])]
            yield pd.DataFrame(out, columns=["g", "a", "b", "s"])

    kind = points.schema[group].dataType.simpleString()
    held = points.groupBy(F.col(group).alias("g")).agg(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(score).alias("s"))).alias("points"))
    return held.mapInPandas(run, f"g {kind}, a long, b long, s double").toDF(group, a, b, score)
