import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.simhash import fingerprint, link_block, simhash_dedup


def brute_fingerprint(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = {i: brute_fingerprint(t) for i, t in rows}
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= radius and group[b] < group[a]:
                    group[a], changed = group[b], True
    return {i: (f"{prints[i]:016x}", group[i]) for i in prints}


def texts():
    random = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    out = []
    for g in range(25):
        base = list(random.choice(words, 160))
        for _ in range(random.integers(1, 5)):
            copy = list(base)
            copy[random.integers(0, 160)] = "x"
            out.append(" ".join(copy))
    return [*out, out[0], out[0].upper(), None, "", " \t", "one", "One", "é É", "a b c d", "A b  c\nd"]


def test_against_brute_force(spark, monkeypatch):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    want = brute(rows)
    for chunk in (simhash.CHUNK, 3):  # small chunks: every bucket is cut
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup(docs).collect()}
        assert got == want


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "zz")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash_dedup(rows).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


@pytest.mark.parametrize(("bits", "radius"), [(64, 0), (64, 4), (64, 3), (256, 50)])
def test_link_block(bits, radius):
    random = np.random.default_rng(radius)
    rows = random.integers(0, 2, (6, bits))[random.integers(0, 6, 90)]
    rows ^= random.random((90, bits)) < radius / bits / 1.8
    group = np.sort(random.integers(0, 9, 90))
    want = np.arange(90)
    for _ in range(90):
        for a in range(90):
            for b in range(90):
                if group[a] == group[b] and (rows[a] != rows[b]).sum() <= radius:
                    want[a] = want[b] = min(want[a], want[b])
    assert (link_block(group, rows.astype(np.uint8), radius) == want).all()


def test_long_text():
    text = ("word " * 200_000).encode()
    assert fingerprint(text)[0] == (xxhash.xxh64_intdigest(b"word word word word", 42)).to_bytes(8, "big")


def test_equal_fingerprints_of_unlike_texts(spark):
    filler, rest = "w " * 60, lambda c: " ".join(f"{c}{k}" for k in range(30))
    texts = [filler + rest("a"), filler + rest("b"), filler + rest("a"), None, ""]
    assert fingerprint(texts[0].encode(), 5, 256)[0] == fingerprint(texts[1].encode(), 5, 256)[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = simhash_dedup(docs, words=5, bits=256, radius=56, bands=(16, 4), similarity=0.8)
    assert {r.doc_id: r.component_id for r in out.collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3}
