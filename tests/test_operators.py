import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quarry.operators import align, extract, joins, ordered, scores, similarity, sinks
from quarry.sources import files
from quarry.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_islands(spark):
    df = spark.createDataFrame([(1, n) for n in (1, 2, 3, 7, 8, 10, 10)], "d int, p int")
    assert rows(ordered.islands(df, ["d"], "p")) == [(1, 1, 3, 3), (1, 7, 8, 2), (1, 10, 10, 1)]


def test_ranges_from_starts(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 4, 1), (1, 6, 2)], "d int, start int, ord int")
    assert [r.range_end for r in ordered.ranges_from_starts(df, "d", "start", ["ord"], F.col("start")).orderBy("start").collect()] == [3, 5, 6]
    assert [r.range_end for r in ordered.ranges_from_starts(df, "d", "start", ["ord"], F.lit(9)).orderBy("start").collect()] == [3, 5, 9]


def test_type_runs(spark):
    pages = lambda kinds: spark.createDataFrame([(1, i + 1, {"U": "UNKNOWN"}.get(k, k)) for i, k in enumerate(kinds)], "d int, p int, k string")
    runs = lambda kinds: [(r.kind[0], r["first"], r["last"]) for r in ordered.type_runs(pages(kinds), "d", "p", "k", {"D": 3, "C": 2}).orderBy("segment").collect()]
    assert runs("DDDD") == [("D", 1, 3), ("D", 4, 4)]
    assert runs("DUDCCCUD") == [("D", 1, 3), ("C", 4, 5), ("C", 6, 7), ("D", 8, 8)]
    assert runs("UUDU") == [("U", 1, 2), ("D", 3, 4)]


@pytest.mark.parametrize(("kinds", "want"), [("DUD", "DDD"), ("DUUD", "DUUD"), ("DUC", "DUC"), ("UDU", "UDU")])
def test_fill_gaps(spark, kinds, want):
    df = spark.createDataFrame([(1, i, {"U": "UNKNOWN"}.get(k, k)) for i, k in enumerate(kinds)], "d int, p int, k string")
    assert "".join(r.filled[0] for r in ordered.fill_gaps(df, "d", "p", "k", 3).orderBy("p").collect()) == want


def test_without_overlaps(spark):
    df = spark.createDataFrame([([(0, 3, "a"), (0, 5, "b"), (4, 6, "c"), (5, 7, "d"), (9, 9, "e")],)], "s array<struct<start:int,end:int,label:string>>")
    assert [s.label for s in df.select(ordered.without_overlaps(F.col("s")).alias("k")).first().k] == ["b", "d", "e"]


def test_nearest_value(spark):
    fees = spark.createDataFrame([(1, "a", 300.0), (2, "b", 370.0), (3, "c", 300.0)], "ord int, fee string, amount double")
    asked = spark.createDataFrame([(1, 340.0), (2, 335.0), (3, 200.0), (4, 0.0), (5, None), (6, 260.87), (7, 352.94)], "id int, v double")
    got = {r.id: r.fee for r in joins.nearest_value(asked, "id", "v", fees, "amount", "ord", ["fee"]).collect()}
    assert got == {1: "b", 2: "a", 3: None, 4: None, 5: None, 6: "a", 7: "b"}


def test_nearest_value_against_all_pairs(spark):
    random.seed(2)
    fees = [(i, f"f{i}", round(random.lognormvariate(5, 2), 2)) for i in range(60)]
    asked = [(i, round(random.lognormvariate(5, 2), 2)) for i in range(300)]
    got = {r.id: r.fee for r in joins.nearest_value(spark.createDataFrame(asked, "id int, v double"), "id", "v", spark.createDataFrame(fees, "ord int, fee string, amount double"), "amount", "ord", ["fee"]).collect()}
    for i, v in asked:
        near = min(((abs(a - v), o, f) for o, f, a in fees if abs(a - v) <= v * 0.15), default=(0, 0, None))
        assert got[i] == near[2]


def test_keywords_are_counted(spark):
    df = spark.createDataFrame([(1, "red ring"), (2, "blue")], "id int, t string")
    words = spark.createDataFrame([(2, "ring", "x"), (1, "red", "y")], "ord int, keyword string, target string")
    assert rows(joins.contains_match(df, "id", F.col("t"), words)) == [(1, "y", "red")]
    assert rows(joins.contains_match(df, "id", F.col("t"), words, 1)) == [(1, "y", "red")]


def test_upsert_prefers_late_and_new(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 5, "c"), (2, 4, "d"), (3, 1, "e")], "k int, t int, v string")
    assert rows(joins.upsert(old, new, ["k"], "t")) == [(1, 5, "c"), (2, 5, "b"), (3, 1, "e")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda x: spark.createDataFrame(x, "k int, t int, v string")
    for _ in range(2):  # repeating a batch changes nothing
        sinks.merge_into(df([(1, 1, "a"), (2, 1, "b")]), path, ["k"], "t")
        sinks.merge_into(df([(2, 2, "c")]), path, ["k"], "t")
    assert rows(spark.read.parquet(path)) == [(1, 1, "a"), (2, 2, "c")]
    sinks.append_absent(df([(1, 9, "x"), (3, 9, "y")]), path, ["k"])
    assert rows(spark.read.parquet(path)) == [(1, 1, "a"), (2, 2, "c"), (3, 9, "y")]
    children = str(tmp_path / "c")
    sinks.replace_children(df([(1, 1, "a"), (2, 1, "b")]), children, "k")
    sinks.replace_children(df([(1, 2, "z")]), children, "k")
    assert sorted((r.k, r.t, r.v) for r in spark.read.parquet(children).collect()) == [(1, 2, "z"), (2, 1, "b")]
    sinks.write_json(df([(1, 1, "a\0b")]), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"k":1,"t":1,"v":"ab"}'


def test_merge_stream(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for part in ([(1, 1, "a")], [(1, 2, "b"), (2, 1, "c")]):
        spark.createDataFrame(part, "k int, t int, v string").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k int, t int, v string").parquet(str(source))
        incremental.merge_stream(stream, target, str(tmp_path / "cp"), ["k"], "t").awaitTermination(120)
    assert rows(spark.read.parquet(target)) == [(1, 2, "b"), (2, 1, "c")]


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    source, schema = tmp_path / "in", "ts timestamp, k string, v double"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    parts = [[("2024-01-01 00:10:00", "a", 1.0)], [("2024-01-01 05:00:00", "a", 2.0)], [("2024-01-01 00:20:00", "a", 4.0)], [("2024-01-01 09:00:00", "b", 8.0)]]
    for part in parts:
        spark.createDataFrame(part, "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
        query = incremental.windowed_counts(stream, "ts", "k", "v").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted((r.k, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1, 1.0), ("a", 1, 2.0)]


def test_best_chain_against_all_chains():
    random.seed(3)
    for _ in range(60):
        points = [(random.randint(0, 6), random.randint(0, 6), random.randint(1, 9) / 4) for _ in range(random.randint(0, 8))]
        chains = [c for n in range(len(points) + 1) for c in combinations(sorted(points), n) if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:]))]
        got = align.best_chain(points)
        assert sum(p[2] for p in got) == max(sum(p[2] for p in c) for c in chains)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_align_covers_every_block_once():
    random.seed(4)
    for _ in range(40):
        a, b = ([random.choice(["fee due", "fees due", "order of the court", "x", ""]) for _ in range(random.randint(0, 9))] for _ in range(2))
        steps = align.align(a, b)
        assert [i for i, _, _ in steps if i >= 0] == list(range(len(a))) and [j for _, j, _ in steps if j >= 0] == list(range(len(b)))
    assert align.align(["x", "y"], ["x", "y"]) == [(0, 0, 1.0), (1, 1, 1.0)]


def test_align_documents(spark):
    df = spark.createDataFrame([(1, "a", 0, "same"), (1, "a", 1, "value 10"), (1, "b", 0, "same"), (1, "b", 1, "value 99"), (1, "b", 2, "zzzzzzzzzzzzzzzzzz"), (2, "a", 0, "alone")], "p int, side string, n int, t string")
    got = [(r.pair, r.kind, r.a_order, r.b_order) for r in align.align_documents(df, "p", "side", "n", "t").orderBy("pair", "step").collect()]
    assert got == [(1, "fixed", 0, 0), (1, "variable", 1, 1), (1, "gap_a", None, 2), (2, "gap_b", 0, None)]


def test_token_diff(spark):
    df = spark.createDataFrame([(1, "a b c", "a x c d"), (2, None, "q")], "k int, a string, b string")
    assert [(r.key, r.op, r.text) for r in align.token_diff(df, "k", "a", "b").orderBy("key", "n").collect()] == [(1, "equal", "a"), (1, "delete", "b"), (1, "insert", "x"), (1, "equal", "c"), (1, "insert", "d"), (2, "insert", "q")]


def test_extraction(spark):
    df = spark.createDataFrame([("Mail a.b@c.org on 01/02/2024, CPF 000.000.001-91; R$ 1.234,56",)], "t string")
    found = df.select(extract.entities(F.col("t")).alias("e")).first().e
    assert [(e.label, e.text) for e in found] == [("EMAIL", "a.b@c.org"), ("DATA", "01/02/2024"), ("CPF", "000.000.001-91"), ("VALOR", "R$ 1.234,56")]
    assert all("Mail a.b@c.org on 01/02/2024, CPF 000.000.001-91; R$ 1.234,56"[e.start : e.end] == e.text for e in found)
    named = spark.createDataFrame([("ÉPOCA: ação",)], "t string")
    assert named.select(extract.first_match(F.col("t"), [(r"missing (x)", 1), (r"(?i)época:\s+(\w+)", 1)]).alias("v")).first().v == "ação"
    assert spark.range(1).select(extract.confidence([F.lit(1.0)]).alias("c")).first().c == 0.45 + 0.45 / 1.6
    assert df.select(extract.context(F.col("t"), F.lit(5), F.lit(14), 5).alias("c")).first().c == "Mail a.b@c.org on 0"


def test_scores(spark):
    pages = spark.createDataFrame([(1, 0, 1)] + [(1, 5, 0)] * 7 + [(2, 0, 1)] * 9 + [(2, 1, 0)], "d int, words int, images int")
    assert {r.d: (float(r.scan_ratio), r.is_scanned) for r in scores.scan_summary(pages, "d", "words", "images").collect()} == {1: (12.5, False), 2: (90.0, True)}
    values = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, 11, 12)], "v double")
    assert scores.two_means(values, "v") == (2.0, 11.0, 6.5, 3, 3, True)
    probes = spark.createDataFrame([("00.000.001-91", "x 0000000191 y"), ("Órgão A", "no orgao  a"), ("ab-cd ef", "ABCDEF"), ("zz", "y"), ("12", "1 2")], "v string, p string")
    assert [r[0] for r in probes.select(scores.probe(F.col("v"), F.col("p"))).collect()] == ["digits", "normalized", "compact", None, None]
    kinds = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (2, "A", 1), (2, "B", 1), (3, "UNKNOWN", 9)], "d int, k string, s int")
    assert {r.d: r.resolved for r in scores.resolve_type(kinds, "d", "k", "s").collect()} == {1: "B", 2: "CONFLICT", 3: "UNKNOWN"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('NAME,ID\n"x ""q"", y",01\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [('x "q", y', "01")]
    (tmp_path / "a.json").write_text('[{"id": "2.1", "words": ["a"], "more": 1}]')
    assert files.read_json(spark, str(tmp_path / "a.json"), "id string, words array<string>").first().words == ["a"]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "y.pdf").write_bytes(b"no")
    found = files.read_files(spark, [str(tmp_path / "x.pdf"), str(tmp_path / "y.pdf"), str(tmp_path / "x.pdf")], b"%PDF-")
    assert sorted((r.path[-5:], r.valid) for r in found.collect()) == [("x.pdf", True), ("y.pdf", False)]
    tree = spark.createDataFrame([(1, [("a", 1, [("b", 2)]), ("c", 3, [])])], "d int, t array<struct<title:string,page:int,children:array<struct<title:string,page:int>>>>")
    assert rows(files.flatten_bookmarks(tree, "d", "t", 2)) == [(1, "a", 1, 1), (1, "b", 2, 2), (1, "c", 3, 1)]
    assert rows(files.rules_frame(spark, {"f": [("x", 1)]})) == [("f", 0, "x", 1)]


def test_similarity(spark):
    assert similarity.length_ratio(F.lit("a"), F.lit("ab")) is not None
    assert spark.range(1).select(similarity.edit_similarity(F.lit("abcd"), F.lit("abcd")), similarity.edit_similarity(F.lit(""), F.lit(""))).first()[:] == (1.0, 1.0)


def test_contains_match_both_ways(spark):
    docs = spark.createDataFrame([(1, "the red widget"), (2, "a blue ring"), (3, "no"), (4, None), (5, "")], "id int, t string")
    words = spark.createDataFrame([(0, "ring", "r"), (1, "red", "d"), (2, "the", "t"), (3, "", "none")], "ord int, keyword string, target string")
    want = [(1, "d", "red"), (2, "r", "ring")]
    for most in (1000, 0):  # a list in one array, and a join by first letters
        got = joins.contains_match(docs, "id", F.col("t"), words, most)
        assert sorted((r.id, r.target, r.keyword) for r in got.collect()) == want


def test_cut_short_swap(spark, tmp_path):
    import os

    df = lambda rows: spark.createDataFrame(rows, "k int, t int, v string")
    path = str(tmp_path / "s")
    sinks.merge_into(df([(1, 1, "a")]), path, ["k"], "t")
    os.rename(path, f"{path}.old")  # a crash before the new files were written
    sinks.merge_into(df([(2, 1, "b")]), path, ["k"], "t")
    assert rows(spark.read.parquet(path)) == [(1, 1, "a"), (2, 1, "b")]
    df([(3, 1, "c")]).write.parquet(f"{path}.next")
    os.rename(path, f"{path}.old")  # and one between the two moves
    sinks.merge_into(df([(4, 1, "d")]), path, ["k"], "t")
    assert rows(spark.read.parquet(path)) == [(3, 1, "c"), (4, 1, "d")]


def test_fee_matches_broadcasts_fees_only(spark, tmp_path):
    """Rows that explode() multiplies look few to Spark; the driver must not gather them."""
    from quarry.operators.enrich import fee_matches

    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("V").alias("field"), F.lit(310).cast("decimal(18,2)").alias("value"), F.lit(None).cast("double").alias("percent"), F.lit(None).cast("int").alias("parts"), F.lit("x").alias("alias"), F.lit("A").alias("area"))
    rows.write.parquet(f"{tmp_path}/rows")
    fees = spark.createDataFrame([("1.1", "A", 300.0, 0), ("9", "B", 40.0, 1)], "id string, area string, fee double, ord int").withColumn("fee", F.col("fee").cast("decimal(24,8)"))
    found = fee_matches(spark.read.parquet(f"{tmp_path}/rows"), "k", fees)
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.entry, r.way, r.source) for r in found.collect()} == {("1.1", "raw", "area")} and found.count() == 2000
