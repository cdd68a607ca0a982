"""Byte-level BPE: encoding over a trie of distinct words, and decoding.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours stay
apart when their joined bytes are encoded. So the last token of a prefix's encoding
depends only on last tokens of shorter prefixes, and words with a common prefix share
that work: distinct words in sorted order are the leaves of a trie, left to right, and
the walk below keeps the states of the current path alone.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from math import inf

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.batches import map_batches, pieces

#: Words of byte-level BPE, as the published pattern has them. White space is Unicode's; the controls 1C to 1F are none.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
#: Code points that Unicode made letters or numbers after version 16, which the tokenizers library takes for neither.
LATE = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATE_SET = "".join("-".join(rf"\U{int(end, 16):08X}" for end in run.split("-")) for run in LATE.split())


def _pattern(letter: str, number: str, other: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


PATTERN = _pattern(r"\p{L}", r"\p{N}", rf"[^{SPACE}\p{{L}}\p{{N}}]")
#: The same for texts with such code points.
LATE_PATTERN = "(?V1)" + _pattern(rf"[\p{{L}}--[{LATE_SET}]]", rf"[\p{{N}}--[{LATE_SET}]]", rf"[[^{SPACE}\p{{L}}\p{{N}}]||[{LATE_SET}]]")


#: The same again with the classes spelt out for texts below U+0250, which the plain engine splits faster.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\t-\r \x85\xa0{_LETTER}{_NUMBER}]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"


def splitter():
    """A function from a text to its words."""
    latin, beyond = re.compile(LATIN_PATTERN).findall, re.compile("[^\x00-ɏ]").search
    plain, special, late = regex.compile(PATTERN).findall, regex.compile(LATE_PATTERN).findall, regex.compile(f"[{LATE_SET}]").search

    def words_in(text: str) -> list[str]:
        if text.isascii() or not beyond(text):
            return latin(text)
        return special(text) if late(text) else plain(text)

    return words_in


#: Words whose encodings a Python worker remembers at most.
CACHE_WORDS = 300_000
#: Prefixes in the trie of words, and remembered steps of the automaton, from which on a worker starts afresh or adds none.
MOST_NODES, MOST_JUMPS = 600_000, 1_000_000
#: Every so many bytes of a word its prefix is worked out, whether needed or not.
SETTLE_EVERY = 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and its byte.

    Printable bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens read from a tokenizer's JSON text."""

    def __init__(self, definition: str):
        parsed, symbols = json.loads(definition), byte_symbols()
        to_bytes = lambda s: bytes(symbols[c] for c in s)
        model = parsed["model"]
        self.ids = {to_bytes(token): i for token, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = map(to_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.apart: dict[int, bool] = {}  # left token * 2**32 + right token
        self.parts = {merged: (rank, pair) for pair, (rank, merged) in self.merges.items()}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.jumps: dict[int, int] = {}
        self.suffixes()
        self.clear()

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition: the earliest-ranked pair merges first, leftmost first."""
        parts = [self.ids[bytes([b])] for b in data]
        while len(parts) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.merges), default=None)
            if best is None:
                break
            at = best[1]
            parts[at : at + 2] = [self.merges[parts[at], parts[at + 1]][1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts at a token's left (0) or right (1) edge while it is merged from bytes, each with the rank that ends it."""
        known = self.edges.get((token, side))
        if known is None:
            known = [(token, inf)]
            if token in self.parts:
                rank, pair = self.parts[token]
                inner = self.edge(pair[side], side)
                known = [*inner[:-1], (inner[-1][0], rank), *known]
            self.edges[token, side] = known
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side encode to themselves: no merge across comes before those inside."""
        known = self.apart.get(left << 32 | right)
        if known is None:
            merges, known = self.merges, True
            a, b = iter(self.edge(left, 1)), iter(self.edge(right, 0))
            (x, x_ends), (y, y_ends) = next(a), next(b)
            while True:
                across = merges.get((x, y))
                # Of equal ranks the leftmost merges first.
                if across and across[0] < x_ends and across[0] <= y_ends:
                    known = False
                    break
                if x_ends <= y_ends:
                    if x_ends == inf:
                        break
                    x, x_ends = next(a)
                else:
                    y, y_ends = next(b)
            self.apart[left << 32 | right] = known
        return known

    def clear(self) -> None:
        """Forgets the trie of words. Its nodes: last token, that token's bytes, state of the automaton, own number; the root is the empty prefix."""
        self.child: dict[int, list] = {}  # number * 256 + byte: the node of the longer prefix

    def suffixes(self) -> None:
        """An automaton whose state after some bytes knows all tokens that end there, longest first."""
        self.step: dict[int, int] = {}
        whole, level, fail = [None], [0], [0]
        for token, number in self.ids.items():
            state = 0
            for byte in token:
                if (following := self.step.get(state << 8 | byte)) is None:
                    following = self.step[state << 8 | byte] = len(whole)
                    whole.append(None)
                    level.append(level[state] + 1)
                    fail.append(0)
                state = following
            whole[state] = number
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(whole)
        for key, state in sorted(self.step.items(), key=lambda x: level[x[1]]):
            before, byte = key >> 8, key & 255
            while before:
                before = fail[before]
                if (found := self.step.get(before << 8 | byte)) is not None:
                    fail[state] = found
                    break
            own = () if whole[state] is None else ((whole[state], level[state]),)
            self.ends[state] = own + self.ends[fail[state]]
        self.fail = fail

    def follow(self, state: int, byte: int) -> int:
        """The state after one more byte; remembered."""
        at = state
        while (found := self.step.get(at << 8 | byte)) is None and at:
            at = self.fail[at]
        found = found or 0
        if len(self.jumps) < MOST_JUMPS:
            self.jumps[state << 8 | byte] = found
        return found

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The encoding of each distinct word.

        Words enter the trie in sorted order, so it grows depth first. A node's last token is worked out when
        a word first needs it, from last tokens above; a prefix that any word had before, in this call or an
        earlier one, is not worked out again.
        """
        if len(self.child) > MOST_NODES:
            self.clear()
        child, ends, jumps, apart, stay_apart = self.child, self.ends, self.jumps, self.apart, self.stay_apart
        out: dict[bytes, tuple[int, ...]] = {}
        path, before = [[-1, 0, 0, 0]], b""  # nodes of the prefixes of the word before

        def settle(end: int) -> None:
            node = path[end]
            for token, n in ends[node[2]]:
                if n == end:
                    break
                last = path[end - n][0]
                if last is None:
                    settle(end - n)
                    last = path[end - n][0]
                known = apart.get(last << 32 | token)
                if known or known is None and stay_apart(last, token):
                    break
            node[0], node[1] = token, n

        for word in sorted(set(words)):
            at, most = 0, min(len(before), len(word))
            if word[:most] == before[:most]:
                at = most
            else:
                while word[at] == before[at]:
                    at += 1
            del path[at + 1 :]
            node = path[at]
            for place, byte in enumerate(word[at:], at + 1):
                key = node[3] << 8 | byte
                following = child.get(key)
                if following is None:
                    now = jumps.get(node[2] << 8 | byte)
                    if now is None:
                        now = self.follow(node[2], byte)
                    following = child[key] = [None, 0, now, len(child) + 1]
                node = following
                path.append(node)
                if place % SETTLE_EVERY == 0 and node[0] is None:  # bounds the depth of the recursion
                    settle(place)
            before = word
            left, tokens = len(word), []
            while left:
                node = path[left]
                if node[0] is None:
                    settle(left)
                tokens.append(node[0])
                left -= node[1]
            tokens.reverse()
            out[word] = tuple(tokens)
        return out


class Encoder:
    """Texts to ids and back, with the words it has met."""

    def __init__(self, definition: str):
        self.vocabulary = vocabulary = Vocabulary(definition)
        self.words_in = splitter()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None
        self.digits = [str(i) for i in range(max(vocabulary.bytes_of) + 1)]
        self.added = {t: (str(i), vocabulary.bytes_of[i]) for t, i in vocabulary.added.items()}
        self.known: dict[str, tuple[str, bytes]] = dict(self.added)  # a word: its ids as text, and the bytes that these stand for

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(t in text for t in self.added):
            return self.words_in(text)
        # Added tokens stand at odd places.
        return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else self.words_in(part))]

    def learn(self, new: set[str]) -> None:
        of_ids, of_bytes = self.digits.__getitem__, self.vocabulary.bytes_of.__getitem__
        for word, tokens in self.vocabulary.encode_words(w.encode() for w in new).items():
            self.known[word.decode()] = (",".join(map(of_ids, tokens)), b"".join(map(of_bytes, tokens)))

    def run(self, texts: list[str]) -> tuple[list[str], list[bytes]]:
        """For each text, its ids as text, and the bytes that the ids stand for."""
        split = [self.split(text) for text in texts]
        get = self.known.get
        found = [list(map(get, words)) for words in split]
        new: set[str] = set()
        open_texts = [i for i, pairs in enumerate(found) if None in pairs]
        for i in open_texts:
            new.update(w for w, pair in zip(split[i], found[i]) if pair is None)
        if len(self.known) + len(new) > CACHE_WORDS:  # words that come again stay
            again = {w: pair for words, pairs in zip(split, found) for w, pair in zip(words, pairs) if pair is not None}
            self.known = dict(self.added) | (again if len(again) < CACHE_WORDS // 2 else {})
        self.learn(new)
        for i in open_texts:
            found[i] = [pair or self.known[w] for w, pair in zip(split[i], found[i])]
        return [",".join([pair[0] for pair in pairs]) for pairs in found], [b"".join([pair[1] for pair in pairs]) for pairs in found]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """The Python worker's encoder: it outlives a task, so that words and prefixes are worked out once."""
    if definition not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition] = Encoder(definition)
    return _ENCODERS[definition]


def encode(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids array<int>, decoded string.

    ``definition`` is the JSON text of a byte-level BPE tokenizer. Strings of added tokens
    in a text become those tokens. ``decoded`` is made from the ids alone.

    Null and empty texts give no ids and an empty decoded text. Repeated rows each give
    their row; an empty table gives none; other columns are ignored.
    """
    def columns(ids: list[str], decoded: list[bytes]) -> list[pa.Array]:
        values = [np.fromstring(x, np.int32, sep=",") for x in ids]
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values))), pa.array(decoded, pa.binary()).cast(pa.string())]

    return _mapped(docs, definition, id_col, text_col, "ids array<int>, decoded string", columns, ["ids", "decoded"])


def encode_digests(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 for the two."""

    def digests(ids: list[str], decoded: list[bytes]) -> list[pa.Array]:
        return [pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in y]) for y in (map(str.encode, ids), decoded))]

    return _mapped(docs, definition, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _mapped(docs, definition, id_col, text_col, columns, finish, names) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a vocabulary file: some MB
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch, texts in pieces(batches, "text"):
            gc.disable()  # words and nodes are many, and never in cycles
            try:
                ids, decoded = encoder.run([t.decode() for t in texts])
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column("id"), *finish(ids, decoded)], names=["id", *names])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
