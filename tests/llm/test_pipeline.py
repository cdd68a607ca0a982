"""The pipeline's stages against planted cases and brute force."""

import random

import pytest

import corpus_pipeline
from quarry.storage import table


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    random.seed(9)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(random.choices(vocabulary, k=n))
    rows, labels, items = [], [], [(i, prose(40)) for i in range(8)]
    plan = {}
    for i in range(300):
        text = "\n".join(prose(random.randint(20, 80)) for _ in range(random.randint(1, 4)))
        kind = "clean"
        if i % 6 == 0:
            words = text.split(" ")
            for _ in range(len(words) // 10 + 2):
                words[random.randrange(len(words))] = random.choice(["idiot", "moron", "scum", "trash", "loser"])
            text, kind = " ".join(words), "toxic"
        elif i % 23 == 1:
            text, kind = text + "\n" + random.choice(items)[1], "benchmark"
        rows.append((i, text))
        labels.append((i, 1, int(kind == "toxic")))
        plan[i] = kind
    clean = [i for i in plan if plan[i] == "clean"]
    for k in range(40):
        source = clean[k]
        words = rows[source][1].split(" ")
        if k % 2:
            words[random.randrange(len(words))] = "changed"
        copy = " ".join(words)
        if alike(copy, rows[source][1]):
            rows.append((1000 + k, copy))
            plan[1000 + k] = "copy"
    rows += [(2000, None), (2001, ""), (2002, "  ")]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(rows), plan


def test_each_stage(spark, corpus):
    folder, texts, plan = corpus
    docs = table(spark, folder, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = ids(corpus_pipeline.toxicity(spark, docs, folder))
    toxic = {i for i in plan if plan[i] == "toxic"}
    assert len(kept & toxic) <= 0.05 * len(toxic) and {i for i in texts if i not in toxic} <= kept
    thinned = corpus_pipeline.line_dedup(spark, docs, folder)
    assert ids(thinned) == set(texts) and thinned.columns == docs.columns
    assert all((r.n_chars or 0) == len(r.text or "") for r in thinned.collect())
    near = ids(corpus_pipeline.near_dedup(spark, docs, folder))
    copies = {i for i in plan if plan[i] == "copy"}
    assert not near & copies and {i for i in plan if plan[i] != "copy"} <= near
    assert len(near & {2000, 2001, 2002}) == 1
    pure = ids(corpus_pipeline.decontamination(spark, docs, folder))
    assert pure == {i for i in texts if plan.get(i) != "benchmark"}


def test_run(spark, corpus):
    folder, _, plan = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(len(r.ids) == r.n_tokens for r in rows)
    found = {plan.get(r.doc_id, "clean") for r in rows}
    assert found == {"clean"} or sum(plan.get(r.doc_id) == "toxic" for r in rows) <= 2


def test_stages_are_the_registered_ones():
    import __spark_entry__

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert "pipeline" in __spark_entry__.queries()


def test_short_near_copies(spark):
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=6))
    rows = []
    for i in range(40):
        text = " ".join(word() for _ in range(8 + i % 4))
        rows += [(i, text), (100 + i, f"{text} {word()}")]
    assert all(alike(rows[k][1], rows[k + 1][1]) for k in range(0, 80, 2))
    near = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert set(range(40)) <= near and len(near) <= 40 + 8


def test_odd_rows_in_each_stage(spark, tmp_path):
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=6))
    long = " ".join(word() for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, "some clean words here"), (3, "some clean words here"), (None, "a null id with words of its own"), (4, long), (5, " ".join(word() for _ in range(30)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, tag string, line int, h string, fp string, key long, item string, row int, votes string, c0 int"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "t", 2, "h", "f", 3, "i", 4, "v", 5) for i, t in rows], schema)
    item = " ".join(long.split()[100:140])
    spark.createDataFrame([(9, item), (10, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 0), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shown = lambda df: sorted((str(r.doc_id), None if r.text is None else len(r.text)) for r in df.collect())
    everything = shown(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "bpe":
            assert sorted((str(r.doc_id), r.n_tokens > 0) for r in out.collect()) == sorted((i, bool(n)) for i, n in everything)
            continue
        assert out.columns == docs.columns
        got = shown(out)
        if name in ("toxicity", "line_dedup"):
            assert got == everything
        elif name == "near_dedup":
            assert got == sorted(x for x in everything if x[0] != "2")  # the empty text is a copy of the null one
        else:
            assert got == everything  # 40 words of 60,000 are under a twentieth
