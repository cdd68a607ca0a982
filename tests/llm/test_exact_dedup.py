from pyspark.sql import functions as F

from quarry.llm.exact_dedup import exact_dedup


def brute(rows, keep):
    norm = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    best = {g: (max if keep == "max" else min)((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted((str(i), str(best[norm(t)]), len(groups[norm(t)]), i == best[norm(t)]) for i, t in rows)


ROWS = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000), (9, "lone"), (9, "lone"), (None, "abc"), (None, "only"), (10, "ß A"), (11, "ß a")]


def rows_of(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in df.collect())


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, b"", 0) for i, t in ROWS], "doc_id long, text string, h binary, n int")
    for keep in ("min", "max"):
        assert rows_of(exact_dedup(docs, keep=keep)) == brute(ROWS, keep)


def test_colliding_hashes_are_told_apart(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    weak = lambda t: F.substring(F.md5(t), 1, 1).cast("binary")
    assert rows_of(exact_dedup(docs, digest=weak)) == brute(ROWS, "min")


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
