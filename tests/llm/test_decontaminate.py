import re

import numpy as np

from quarry.llm.decontaminate import decontaminate


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, span=13):
    out = []
    for d, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(span, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
        out.append((str(d), len(w), len(hit), ",".join(sorted(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def got(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, fp int")
    return sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r.item_ids), r.contaminated) for r in decontaminate(d, b).collect())


def case():
    random = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Straße", "a"]
    pick = lambda n: list(random.choice(vocabulary, n))
    items = [(i, " ".join(pick(n))) for i, n in enumerate([40, 13, 14, 30, 5, 1, 2, 12, 25, 13])]
    items += [(50, "Z z. z; z"), (51, ""), (52, None), (53, items[0][1].upper()), (0, items[0][1]), (54, "q " * 30)]
    docs = []
    for i in range(80):
        w = pick(random.integers(0, 90))
        for _ in range(random.integers(0, 3)):
            part = (items[random.integers(0, 10)][1]).split()
            a = random.integers(0, len(part))
            at = random.integers(0, len(w) + 1)
            w[at:at] = part[a : a + random.integers(1, 30)]
        docs.append((i, random.choice([" ", "\n", ", "]).join(w)))
    docs += [(100, None), (101, ""), (102, "..."), (103, "z z z z z z"), (104, "q " * 400), (105, items[3][1]), (105, items[3][1]), (None, items[1][1]), (106, ("pad " * 30_000) + items[0][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    assert got(spark, docs, items) == brute(docs, items)


def test_windows_only(spark):
    docs, items = case()
    items = [i for i in items if i[1] and len(words(i[1])) >= 13]
    assert got(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = case()
    assert got(spark, [], items) == []
    assert got(spark, docs, []) == brute(docs, [])


def test_null_item_id(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), ("a", text + " end"), ("b", None)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in decontaminate(docs, items).collect()}
    assert got == {1: (20, 2, ["", "a"], True), 2: (0, 0, [], False)}
