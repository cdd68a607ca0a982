"""Toxicity by weak supervision.

Voters are lexicon terms, word stems and patterns; each says yes or nothing about a text. A
stem votes once for each third of a text. From how often two and three voters fire together
over all documents, a generative label model estimates how accurate each is and which of
them repeat each other. Its posteriors over a bounded sample are the labels of a linear
classifier over votes and hashed words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import map_batches, pieces
from quarry.llm.line_dedup import FOLD
from quarry.storage import Scratch

#: Terms that vote whatever the labelled rows hold.
LEXICON = (
    "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown garbage filth vermin imbecile retard "
    "bastard bitch asshole fuck shit cunt whore slut faggot nazi dummkopf arschloch abschaum idiota imbécil estúpido "
    "connard salaud imbécile crétin"
).split()
#: Patterns over the raw bytes of a text.
PATTERNS = {
    "insult after you": rb"(?i)\byou(?:'re| are)? (?:an? |all |such |so )*(?:stupid|dumb|idiots?|morons?|losers?|pathetic|worthless|disgusting|trash|scum)\b",
    "masked word": rb"(?i)\b[a-z][*#@]{2,}[a-z]?\b",
    "shouting": rb"(?:\b[A-Z]{3,}\b[ ,]+){4,}",
    "marks": rb"[!?]{4,}",
    "threat": rb"(?i)\b(?:kill|hurt|destroy) (?:you|yourself|them|him|her)\b",
}
#: Hashed words the classifier sees.
DIMENSIONS = 1024


def held_out(id_col: Column) -> Column:
    """Rows whose labels must not be learnt from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: A stem votes if it begins at least one in so many of the words.
STEM_EVERY = 100
STEM_LETTERS = range(5, 9)


def words_in(text: bytes) -> set[bytes]:
    return set(text.translate(FOLD).split())


def stems_in(text: bytes) -> set[bytes]:
    """Beginnings of words that are frequent in a text."""
    words = text.translate(FOLD).decode().split()
    counts = Counter(w[:n] for w in words for n in STEM_LETTERS if len(w) >= n)
    return {stem.encode() for stem, k in counts.items() if k >= 2 and k * STEM_EVERY >= len(words)}


@dataclass
class Model:
    """Voters (terms, stems, patterns), the label model over them, and the classifier's weights."""

    terms: list[bytes]
    stems: list[bytes]
    prior: float = 0.1
    precision: np.ndarray | None = None  # P(toxic | vote)
    share: np.ndarray | None = None  # how much of a voter's evidence others don't repeat
    weights: np.ndarray | None = None  # of votes, then hashed words
    bias: float = 0.0

    def voter(self):
        """A function from a text and its words to the numbers of the voters that fire."""
        place = {t: i for i, t in enumerate(self.terms)}
        known = frozenset(place)
        stems = [(len(place) + 3 * i, b" " + s) for i, s in enumerate(self.stems)]
        patterns = [(len(place) + 3 * len(stems) + i, re.compile(p).search) for i, p in enumerate(PATTERNS.values())]

        def vote(text: bytes) -> tuple[list[int], set[bytes]]:
            folded = b" " + text.translate(FOLD)
            words, votes = folded.split(), []
            for i, stem in stems:
                if stem in folded:
                    begins, n = [w.startswith(stem[1:]) for w in words], len(words)
                    thirds = [begins[n * t // 3 : n * (t + 1) // 3] for t in range(3)]
                    votes += [i + t for t, part in enumerate(thirds) if any(part) and sum(part) * STEM_EVERY >= len(part)]
            words = set(words)
            return [place[w] for w in known & words] + votes + [i for i, found in patterns if found(text)], words

        return vote

    @property
    def voters(self) -> int:
        return len(self.terms) + 3 * len(self.stems) + len(PATTERNS)

    def learn_accuracies(self, total: int, single: np.ndarray, pairs: dict[tuple[int, int], int], triples: dict[tuple[int, int, int], int]) -> None:
        """From how many of ``total`` texts voters fired in, alone, in pairs and in threes.

        Where votes depend on toxicity alone, voter k fires beside j for the toxic share of
        j's texts, and beside j and m, which are hardly both wrong, for nearly all toxic
        ones. So P(k | j) / P(k | j, m), both less how often k misfires, is j's precision;
        the median over all pairs (k, m) is taken. What P(k | j) has beyond the model is correlation,
        and voters that share it share their evidence. Voters nothing agrees with get none.
        """
        rate = single / max(total, 1)
        both = lambda j, k: pairs.get((min(j, k), max(j, k)), 0)
        ratios: list[list[float]] = [[] for _ in single]
        hit: list[list[float]] = [[] for _ in single]
        for trio, n in triples.items():
            if n < 3:
                continue
            for j, k, m in permutations(trio):
                fires = n / both(j, m)
                misfires = max(0.0, (rate[k] - self.prior * fires) / (1 - self.prior))
                if fires > misfires:
                    ratios[j].append((both(j, k) / single[j] - misfires) / (fires - misfires))
                    hit[k].append(fires)
        median = lambda v: float(np.median(v)) if v else 0.0
        seen = single + 2.0  # two texts' worth of doubt
        self.precision = np.array([(np.clip(median(r), 0, 1) * n + 2 * self.prior) / w if r else self.prior for r, n, w in zip(ratios, single, seen)])
        fires = np.array([median(h) for h in hit])
        beyond = np.zeros(len(single))
        for (j, k), n in pairs.items():
            for x, y in ((j, k), (k, j)):
                if ratios[x] and ratios[y] and fires[y] < 1:
                    beyond[x] += max(0.0, (n / single[x] - self.precision[x] * fires[y]) / (1 - fires[y]))
        self.share = np.where(self.precision > self.prior, 1 / (1 + beyond), 0.0)

    def evidence(self) -> np.ndarray:
        """Log odds that each vote adds. Silence adds none: most voters speak for one kind of text only."""
        precision = np.clip(self.precision, 1e-3, 0.99)
        return self.share * (np.log(precision / (1 - precision)) - np.log(self.prior / (1 - self.prior)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) for rows of 0/1 votes."""
        logit = np.log(self.prior / (1 - self.prior)) + votes @ self.evidence()
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def features(self, votes: list[int], words: set[bytes]) -> tuple[np.ndarray, float]:
        """Places of a text's features among the weights, and the value of each hashed word."""
        hashed = {crc32(w) % DIMENSIONS for w in words}
        return np.fromiter(votes + [self.voters + h for h in hashed], np.int64), 1 / np.sqrt(max(1, len(hashed)))

    def train(self, rows: list[tuple[list[int], list[int]]]) -> None:
        """A logistic regression on posteriors, begun at the label model's own evidence."""
        start = np.concatenate([self.evidence(), np.zeros(DIMENSIONS)])
        self.weights, self.bias = start.copy(), float(np.log(self.prior / (1 - self.prior)))
        if not rows:
            return
        x = np.zeros((len(rows), self.voters + DIMENSIONS), np.float32)
        for i, (votes, hashed) in enumerate(rows):
            x[i, votes] = 1
            x[i, [self.voters + h for h in hashed]] = 1 / np.sqrt(max(1, len(hashed)))
        target = self.posterior(x[:, : self.voters])
        w, b = self.weights.astype(np.float32), np.float32(self.bias)
        momentum, rate, decay = np.zeros_like(w), 0.5, 1e-3
        for _ in range(200):
            error = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target
            momentum = 0.9 * momentum - rate * (x.T @ error / len(rows) + decay * (w - start))
            w, b = (w + momentum).astype(np.float32), b - np.float32(rate * error.mean())
        self.weights, self.bias = w.astype(float), float(b)

    def score(self, text: bytes, vote) -> float:
        votes, words = vote(text)
        places, value = self.features(votes, words)
        at = self.weights[places]
        logit = self.bias + at[: len(votes)].sum() + value * at[len(votes) :].sum()
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, logit)))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 8000, most_terms: int = 64, most_stems: int = 12) -> Model:
    """Learns voters, label model and classifier.

    Labels are read only from rows that are not held out: ``sample_rows`` of them at most,
    by the order of a hash of the id. They give the prior and further terms and stems,
    those far commoner in toxic texts: the ``most_terms`` terms and ``most_stems`` stems that
    stand in most toxic texts of the sample, ties in order of their bytes; they bound the
    model's size. Votes are counted over all documents and whole texts, however long.

    Null labels and ids are left out; of several labels of an id the larger counts, and of
    documents that share an id the one of the least hash of its text, ties aside, is sampled.
    Null texts count as empty. Without labelled or any documents, only the lexicon and the
    patterns vote, at a prior of 0.1 or less, and the classifier stays at their evidence.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    labelled = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull() & ~held_out(labels[id_col]))
    labelled = labelled.groupBy(labels[id_col].alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = labelled.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    # At most sample_rows ids are broadcast; of rows that share an id, the one with the least text is taken.
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"), F.first("label").alias("label"))
    sample = scratch.keep(sample.select("id", F.col("row.text").alias("text"), "label"), "sample")

    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            toxic, clean = Counter(), Counter()
            for text, label in zip(texts, batch.column("label").to_pylist()):
                # The empty word counts texts; a space marks stems.
                (toxic if label else clean).update(words_in(text) | {b""} | {b" " + x for x in stems_in(text)})
            both = list(toxic | clean)
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), pa.array([toxic[w] for w in both]), pa.array([clean[w] for w in both])], names=["w", "toxic", "clean"])

    counted = scratch.keep(map_batches(sample, count_words, "w binary, toxic long, clean long").groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
    sizes = counted.where(F.octet_length("w") == 0).first()
    n_toxic, n_clean = (sizes.toxic, sizes.clean) if sizes else (0, 0)
    prior = min(0.5, max(0.01, (n_toxic + 1) / (n_toxic + n_clean + 10)))
    ratio = (F.col("toxic") / max(1, n_toxic)) / ((F.col("clean") + 1) / max(1, n_clean))
    telling = counted.where((F.octet_length("w") > 0) & (F.col("toxic") >= max(3, 0.02 * n_toxic)) & (ratio > 8))
    is_stem = F.substring("w", 1, 1) == F.lit(b" ")
    stems: list[bytes] = []
    for r in telling.where(is_stem).orderBy(F.desc("toxic"), F.desc(F.octet_length("w")), "w").limit(50 * most_stems).collect():
        stem = bytes(r.w)[1:]
        if len(stems) < most_stems and not any(s.startswith(stem) or stem.startswith(s) for s in stems):
            stems.append(stem)
    # A word that begins with a stem adds nothing to it.
    found = [bytes(r.w) for r in telling.where(~is_stem).orderBy(F.desc("toxic"), "w").limit(20 * most_terms).collect()]
    terms = [w for w in found if not any(w.startswith(x) for x in stems if w != x)][:most_terms]
    terms += [t.encode() for t in LEXICON if t.encode() not in terms]
    stems = [x for x in stems if x not in terms]
    model = Model(terms, stems, prior)

    def count_votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote, fired = model.voter(), Counter()
        for _, texts in pieces(batches, "text"):
            for text in texts:
                votes = sorted(vote(text)[0])
                for size in (1, 2, 3):
                    fired.update(combinations(votes, size))
            fired[()] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(list(fired), pa.list_(pa.int32())), pa.array(list(fired.values()), pa.int64())], names=["voters", "n"])

    votes = map_batches(rows.select("text"), count_votes, "voters array<int>, n long").groupBy("voters").agg(F.sum("n").alias("n"))
    fired = {tuple(r.voters): r.n for r in votes.toLocalIterator()}  # at most all threes of the voters
    single = np.array([fired.get((i,), 0) for i in range(model.voters)])
    model.learn_accuracies(fired.get((), 0), single, {k: n for k, n in fired.items() if len(k) == 2}, {k: n for k, n in fired.items() if len(k) == 3})

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = model.voter()
        for _, texts in pieces(batches, "text"):
            found = [(votes, sorted({crc32(x) % DIMENSIONS for x in words})) for votes, words in map(vote, texts)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)], names=["votes", "hashed"])

    described = map_batches(sample.select("text"), describe, "votes array<int>, hashed array<int>")
    model.train([(r.votes, r.hashed) for r in described.toLocalIterator()])  # sample_rows bounds it
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts are scored alike, by what no vote at all says. Scores depend on
    the text alone, so repeated rows tie. Rows with a null id are not held out. An empty
    table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by its parameters

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = shared.value.voter()
        for batch, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shared.value.score(t, vote) for t in texts], pa.float64())], names=["id", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = map_batches(rows, run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores under ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = shared.value.voter()
        for batch, texts in pieces(batches, text_col):
            yield batch.filter(pa.array([shared.value.score(t, vote) < threshold for t in texts], pa.bool_()))

    return map_batches(docs, run, docs.schema)
