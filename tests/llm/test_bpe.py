import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.bpe import LATE, Vocabulary, encode, encode_digests, splitter

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(Path(PATH).read_text())


def texts():
    random.seed(7)
    symbols = [chr(c) for c in range(32, 127)] * 2 + list("éüñßçàœ—…“”  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 中文日本🙂👍🏽ا½²")
    symbols += [chr(c) for c in range(0x80, 0x260)]
    symbols += [chr(int(run.split("-")[0], 16)) for run in LATE.split()]
    out = ["".join(random.choices(symbols, k=random.randint(0, 50))) for _ in range(1500)]
    out += ["".join(random.choices([s for s in symbols if ord(s) < 0x250], k=random.randint(0, 50))) for _ in range(1500)]
    out += ["=" * 300 + " " * 77 + "a" * 500, "It's we'll they'd I'M", "<|endoftext|>", "x <|endoftext|> <|endoftext|><|endoftext|", "", "\0a\0", "word " * 30_000]
    return out


def test_words_encode_as_the_library_does(library, vocabulary):
    words_in = splitter()
    for text in texts():
        if "<|endoftext|>" in text:
            continue
        words = words_in(text)
        found = vocabulary.encode_words(w.encode() for w in words)
        assert [i for w in words for i in found[w.encode()]] == library.encode(text, add_special_tokens=False).ids, text


def test_every_token_is_reached(vocabulary):
    assert all(vocabulary.merge(b) == [i] for b, i in list(vocabulary.ids.items())[::7])


def test_query_columns(spark, library):
    rows = [*enumerate(texts()), (9999, None), (9999, None), (None, "null id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    definition = Path(PATH).read_text()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(docs, definition).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded))))
    assert got == sorted(want)
    full = {r.doc_id: r for r in encode(docs, definition).where("doc_id < 50").collect()}
    for i, t in rows[:50]:
        assert list(full[i].ids) == library.encode(t, add_special_tokens=False).ids and full[i].decoded == t
    assert encode(docs.limit(0), definition).count() == 0


def test_neighbours_stay_apart_as_merging_says(vocabulary):
    random.seed(3)
    tokens = list(vocabulary.bytes_of)[:50_000]
    common = tokens[:600] + [vocabulary.ids[b"a" * n] for n in (1, 2, 4) if b"a" * n in vocabulary.ids] + [i for b, i in vocabulary.ids.items() if len(set(b)) == 1]
    pairs = [tuple(random.choices(common, k=2)) for _ in range(20_000)] + [tuple(random.choices(tokens, k=2)) for _ in range(10_000)]
    pairs += [(a, b) for a in common[-60:] for b in common[-60:]]
    for left, right in pairs:
        if right == 50256 or left == 50256:
            continue
        assert vocabulary.stay_apart(left, right) == (vocabulary.merge(vocabulary.bytes_of[left] + vocabulary.bytes_of[right]) == [left, right])
