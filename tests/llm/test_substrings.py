import random

import pytest

from quarry.llm import substrings
from quarry.llm.substrings import remove_repeats


def brute(rows, length=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - length + 1):
                s = b[p : p + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def case():
    random.seed(11)
    vocabulary = ["".join(random.choices("abcdeé", k=random.randint(1, 6))) for _ in range(40)]
    prose = lambda n: " ".join(random.choices(vocabulary, k=n))
    pool = [prose(random.randint(8, 60)) for _ in range(12)]
    rows = []
    for i in random.sample(range(200), 120):
        parts = [prose(random.randint(0, 25))]
        for _ in range(random.randint(0, 3)):
            text = random.choice(pool)
            a = random.randint(0, len(text) // 2)
            parts += [text[a : a + random.randint(45, 200)], prose(random.randint(0, 10))]
        rows.append((i, "".join(parts)))
    rows += [(300, pool[0]), (301, pool[0]), (301, pool[0]), (302, None), (303, ""), (304, "x" * 49), (305, "x" * 400), (306, "x" * 50), (307, "xy" * 200), (None, pool[1]), (308, rows[0][1])]
    return rows


@pytest.mark.parametrize(("piece", "phrase", "hot"), [(substrings.PIECE, substrings.PHRASE, substrings.HOT_PHRASES), (97, 16, 1), (substrings.PIECE, 1 << 30, 2)])
def test_against_brute_force(spark, monkeypatch, piece, phrase, hot):
    """Also with short phrases and pieces, with none but whole texts as phrases, and with all buckets hot."""
    monkeypatch.setattr(substrings, "PIECE", piece)
    monkeypatch.setattr(substrings, "PHRASE", phrase)
    monkeypatch.setattr(substrings, "HOT_PHRASES", hot)
    rows = case()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, tag int, hits string").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().n_bytes == 0


@pytest.mark.parametrize("length", [28, 91])
def test_other_lengths(spark, length):
    rows = case()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, length=length).collect())
    assert got == brute(rows, length)


def test_refused_input(spark):
    with pytest.raises(ValueError, match="length is 28 to 91"):
        remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=92)
    with pytest.raises(TypeError, match="integer id"):
        remove_repeats(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_the_sieve_grows_with_the_text():
    """A set that is right for a small corpus is half full at 6 GB; it grows to a bound instead."""
    assert [substrings.sieve_bits(n) for n in (0, 1 << 29, 2_500_000_000, 6 << 30, 30 << 30)] == [27, 27, 29, 29, 29]


@pytest.mark.parametrize("bits", [(12, 12), (28, 28)])
def test_the_size_of_the_sieve_changes_no_result(spark, monkeypatch, bits):
    monkeypatch.setattr(substrings, "SIEVE_BITS", bits)
    rows = case()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect())
    assert got == brute(rows)
