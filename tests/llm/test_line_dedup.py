import random

import numpy as np
import pytest

from quarry.llm import line_dedup
from quarry.llm.line_dedup import distances, drop_lines, edit_similar, line_prints, normalised


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_similarity():
    random.seed(2)
    for _ in range(1500):
        a = "".join(random.choices("abé ", k=random.randint(0, 25)))
        b = list(a)
        for _ in range(random.randint(0, 6)):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 2)] = random.choices("abé ", k=random.randint(0, 2))
        b = "".join(b)
        for least in (0.5, 0.8, 0.9):
            allowed = int((1 - least) * max(len(a), len(b)) + 1e-9)
            assert edit_similar(a, b, least) == (distance(a, b) <= allowed), (a, b)


def test_prints():
    lines = [b"a b c", b"a b c", b"one", b" ".join(b"w%d" % (i % 700) for i in range(2000)), "这是一个没有空格的句子".encode()]
    prints, rows, keys = line_prints(lines)
    assert prints[0] == prints[1] and {len(p) for p in prints} == {16} and list(rows) == sorted(rows)
    assert sorted(keys[rows == 0]) == sorted(keys[rows == 1]) and set(rows) == {0, 1, 2, 3, 4}
    # The long line's sums pass what one byte holds.
    from quarry.llm.hashing import span_hashes
    from quarry.llm.line_dedup import word_spans, _NOT_SPACE

    data, starts, ends, _ = word_spans([lines[3]], _NOT_SPACE)
    bits = np.unpackbits(span_hashes(data, starts, ends).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=int)
    assert np.packbits(2 * bits > 2000).tobytes() == prints[3][:8]


def groups_of(rows):
    """Lines that are equal or, by edit similarity alone, near: (norm, its group) and where each occurs."""
    where = {}
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if words := normalised(line.encode()):
                where.setdefault(b" ".join(words).decode(), []).append((-1 if i is None else i, n))
    norms = list(where)
    group = list(range(len(norms)))
    for a in range(len(norms)):
        for b in range(a):
            if group[a] != group[b] and edit_similar(norms[a], norms[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return dict(zip(norms, group)), where


def case():
    random.seed(4)
    vocabulary = [f"{random.choice('abcdefgh')}{random.choice('xyz')}ord{i}" for i in range(300)] + ["Ünï", "Dash-ed"]
    pool = [" ".join(random.choices(vocabulary, k=random.randint(6, 40))) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(random.randint(0, 6)):
            line = random.choice(pool).split()
            if random.random() < 0.4:
                line[random.randrange(len(line))] = random.choice(vocabulary)
            lines.append(random.choice([" ", "  ", ", "]).join(line).upper() if random.random() < 0.2 else " ".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "one two three four five\none two three four five"), (104, "w " * 50_000)]
    rows += [(105, "w " * 50_001), (106, "same row twice in here"), (106, "same row twice in here"), (None, "a null id has this line"), (107, "A null, id has this line")]
    rows += [(108, "equal id other text alpha beta"), (108, "some third thing gamma delta\nshort"), (109, "short\n---\n---")]
    return rows


def test_against_edit_similarity_alone(spark):
    rows = case()
    docs = spark.createDataFrame([(i, t, 7, "l", b"x") for i, t in rows], "doc_id long, text string, line int, tag string, h binary")
    out = drop_lines(docs)
    got = out.collect()
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    one = out.where("doc_id = 103").first()
    assert (one["_n_lines"], one["_n_dropped"]) == (2, 1)
    assert {r.doc_id: r.text for r in got if r.doc_id in (100, 101, 102)} == {100: None, 101: "", 102: "\n\n"}
    assert [r.text for r in got if r.doc_id == 106] == ["same row twice in here"] * 2 and [r.text for r in got if r.doc_id == 107] == [""]
    group, where = groups_of(rows)
    stays = {}
    for norm, g in group.items():
        stays[g] = min([stays.get(g, (10**9, 0)), *where[norm]])
    kept = {(norm, i) for r in got for i in [-1 if r.doc_id is None else r.doc_id] for line in (r.text or "").split("\n") if (words := normalised(line.encode())) for norm in [b" ".join(words).decode()]}
    first = {(norm, stays[g][0]) for norm, g in group.items() if stays[g] in where[norm]}
    assert first <= kept  # of every group its first line is there
    extra = {(norm, i) for norm, i in kept if i != stays[group[norm]][0]}
    assert len(extra) <= 0.1 * sum(len({i for i, _ in places}) for places in where.values())
    assert sum(len(set(places)) for places in where.values()) > 1.3 * len(first)  # there was much to drop


def test_empty(spark):
    assert drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = spark.createDataFrame([(1, "--\n--"), (2, None)], "doc_id string, text string")
    assert sorted((r.doc_id, r.text) for r in drop_lines(none).collect()) == [("1", "--\n--"), ("2", None)]


@pytest.mark.parametrize("change", ["other", "more", "less"])
def test_recall_by_edit_similarity_alone(spark, change):
    """A word changed, put in or left out, in lines of any length: what edit similarity accepts is found."""
    random.seed(6)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9))) for _ in range(2000)]
    rows, length_of = [], {}
    for size in (6, 10, 20, 40, 80):
        found = 0
        while found < 40:
            line = random.choices(vocabulary, k=size)
            other, at = list(line), random.randrange(size)
            other[at : at + (change != "more")] = [] if change == "less" else [random.choice(vocabulary)]
            if other != line and edit_similar(" ".join(line), " ".join(other)):
                i, found = len(rows), found + 1
                rows += [(i, " ".join(line)), (i + 1, " ".join(other))]
                length_of[i + 1] = size
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in drop_lines(docs).collect() if r.text}
    assert {i for i, _ in rows if i % 2 == 0} <= left
    for size in (6, 10, 20, 40, 80):
        mine = [i for i, n in length_of.items() if n == size]
        assert len(left.intersection(mine)) <= 0.1 * len(mine), size


def test_short_and_unspaced_lines(spark):
    long = "这是一个没有空格的句子它很长所以应该参加近似行的比较而不是被当作一个词跳过去"
    rows = [(1, "all rights reserved\n\nok\n" + long), (2, "All rights  reserved.\n\nOK\n" + long), (3, long.replace("很", "太") + "\nnothing alike"), (4, "---\n---")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "nothing alike", 4: "---\n---"}


def test_distances():
    random.seed(3)
    for _ in range(200):
        a, *others = ("".join(random.choices("abé ", k=random.randint(0, 30))) for _ in range(7))
        assert distances(a, others) == [distance(a, b) for b in others]


def test_every_pair_that_shares_enough_runs_is_found(spark):
    """Changes spread over the line leave no half and few runs whole; every such pair is found, not most."""
    random.seed(8)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(4, 9))) for _ in range(2000)]
    rows = []
    for size in (8, 10, 20, 30, 60):
        for _ in range(20):
            line = random.choices(vocabulary, k=size)
            other = list(line)
            for at in range(2, size, 4 if size < 10 else 5):
                other[at] = line[at][:-2] + random.choice("xyz") + random.choice("xyz")
            assert edit_similar(" ".join(line), " ".join(other))
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
    left = {r.doc_id for r in drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text}
    assert left == set(range(0, len(rows), 2))


def test_counted_runs_are_written_in_few_bytes():
    """What is dealt out to count the runs comes back whole, in under 6 bytes a key instead of 8."""
    levels = line_dedup.Levels(900_000_000)
    random.seed(1)
    keys = np.array([random.getrandbits(64) for _ in range(1 << 18)], np.uint64)
    values = np.sort(levels.values(np.concatenate([keys, keys[:5]]), np.arange(len(keys) + 5, dtype=np.uint64)))
    used, written = levels.deal(values)
    own = (1 << levels.inner_bits + line_dedup.LINE_HASH) - 1
    assert sum(map(len, written)) < 6 * len(values)
    back = [int(v) | int(b) << levels.inner_bits + line_dedup.LINE_HASH for b, w in zip(used, written) for v in levels.read(w)]
    assert back == values.tolist() and all(int(v) <= own for v in levels.read(written[0]))
    few = levels.deal(values[:3])
    assert [int(v) for w in few[1] for v in levels.read(w)] == [int(v) & own for v in values[:3]]


def test_bounds_lose_no_pair_and_spare_distances(monkeypatch):
    """Against edit similarity alone; unlike lines of one star get next to no distance in full."""
    random.seed(5)
    words = ["".join(random.choices("abcdeé", k=random.randint(1, 7))) for _ in range(60)]
    lines = [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(120)]
    for line in lines[:80]:
        new = list(line)
        for _ in range(random.randint(0, len(line) // 4)):
            at = random.randrange(len(new) + 1)
            new[at : at + random.randint(0, 1)] = random.choices("abé ", k=random.randint(0, 1))
        lines.append("".join(new))
    calls = []
    true_similar, true_distances = line_dedup.edit_similar, line_dedup.distances
    monkeypatch.setattr(line_dedup, "edit_similar", lambda a, b, s: calls.append(1) or true_similar(a, b, s))
    monkeypatch.setattr(line_dedup, "distances", lambda a, b: calls.extend(b) or true_distances(a, b))
    got = line_dedup.link_lines(np.zeros(len(lines), np.int64), [bytes(16)] * len(lines), lines, 0.8)
    group = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if group[a] != group[b] and true_similar(lines[a], lines[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    assert got.tolist() == group
    assert len(calls) < 0.02 * len(lines) * (len(lines) - 1) / 2


def test_lines_of_far_lengths_are_not_held_against_each_other(spark, monkeypatch):
    """Lines that share a run, each over a quarter longer than the one before: no text is fetched for them."""
    seen = []
    true_links = line_dedup.verified_links
    monkeypatch.setattr(line_dedup, "verified_links", lambda cells, similarity: seen.append(cells.count()) or true_links(cells, similarity))
    random.seed(9)
    other = ["".join(random.choices("abcdefghijklmnop", k=8)) for _ in range(400)]
    rows = [(i, "shared opening words here " + " ".join(other[40 * i : 40 * i + 3 * 2**i])) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in drop_lines(docs).collect()} == dict(rows)
    assert seen == [0]


def test_one_rare_run_in_common_is_no_reason_to_fetch_two_lines(spark, monkeypatch):
    """Unlike lines of equal length that share a run of three words with the next: no text is fetched. Copies beside them still meet."""
    seen = []
    true_links = line_dedup.verified_links
    monkeypatch.setattr(line_dedup, "verified_links", lambda cells, similarity: seen.append(cells.count()) or true_links(cells, similarity))
    random.seed(10)
    words = ["".join(random.choices("abcdefghijklmnop", k=8)) for _ in range(1000)]
    lines = [words[30 * i : 30 * i + 33] for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    assert drop_lines(docs).where("_n_dropped > 0").count() == 0 and seen == [0]
    near = [(100 + i, " ".join([*line[:20], "other", *line[21:]])) for i, line in enumerate(lines)]
    out = drop_lines(docs.union(spark.createDataFrame(near, docs.schema)))
    assert {r.doc_id for r in out.collect() if r.text} == set(range(30)) and seen[1] == 60


def test_pairs_of_rare_runs(spark):
    """Against all pairs, over keys of one row to thousands: those whose lengths allow the similarity, each one once."""
    random.seed(11)
    rows = [(key, 10_000 * key + i, random.randint(5, 400), random.randint(0, 1)) for key in range(-30, 30) for i in range(random.choice([1, 2, 3, 8, 70]))]
    rows += [(99, i, 10 * 4**i, 0) for i in range(5)]
    got = line_dedup.few_pairs(spark.createDataFrame(rows, "key long, rep long, size int, alone int"), 0.8).collect()
    allowed = lambda a, b: abs(a - b) <= int((1 - 0.8) * max(a, b) + 1e-9)
    want = [(max(x[1], y[1]), min(x[1], y[1]), x[3] | y[3]) for n, x in enumerate(rows) for y in rows[:n] if x[0] == y[0] and allowed(x[2], y[2])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_fewer_stars_hold_all_pairs(spark):
    """Every pair is in a star of what is left, and rows that stand for pairs with other lines stay."""
    from quarry.storage import Scratch

    random.seed(12)
    groups = [random.sample(range(300), random.randint(2, 9)) for _ in range(60)]
    pairs = {(max(x, y), min(x, y)): False for g in groups for x in g for y in g if x != y}
    pairs |= {(x, min(g)): True for g in groups[:20] for x in g if x != min(g)}
    left = {tuple(r) for r in line_dedup.fewer_stars(spark.createDataFrame([(*p, s) for p, s in pairs.items()], "a long, b long, star boolean"), Scratch(spark, "stars")).collect()}
    star = {}
    for a, b in left:
        star.setdefault(b, {b}).add(a)
    assert left <= set(pairs) and len(left) < len(pairs)
    assert all(p in left for p, stays in pairs.items() if stays)
    assert all(any({a, b} <= s for s in star.values()) for a, b in pairs)


def test_how_a_key_makes_lines_meet():
    """Runs of three of level 1 give pairs, alone only in lines that need not share two or that hold the run twice; one key more then."""
    long, short, twice = (b" ".join(b"w%d" % i for i in part) for part in (range(40), range(5), [*range(50, 70), 50, 51, 52]))
    row, key, kind = line_dedup.line_keys(*line_dedup._hashed([long, short, twice]))
    rows, keys, how = line_dedup.rare_first(row, key, kind, np.ones(len(key), int))
    assert set(how[rows == 0]) == {2} and (rows == 0).sum() == 38 - 10 + 2  # two among the first n - t + 2
    assert set(how[(rows == 1)]) == {0, 1}
    repeated = key[row == 2][kind[row == 2] == 2]
    again = {int(k) >> 1 for k in repeated if (repeated == k).sum() > 1}
    assert len(again) == 1 and all(how[i] == (1 if int(keys[i]) in again else 2) for i in np.flatnonzero(rows == 2))
    assert set(line_dedup.rare_first(row, key, kind, np.full(len(key), 2))[2]) == {0}


def test_distances_and_bounds_of_many_pairs():
    """Pairs of lines of up to many words of bits: what is allowed is exact, what is not is beyond, and a bound is never above."""
    random.seed(13)
    lines = []
    while len(lines) < 400:
        a = random.choices("abcdé  ", k=random.choice([1, 5, 63, 64, 65, 128, 130, 200, 500]))
        b = list(a)
        for _ in range(random.randint(0, max(1, len(a) // 4))):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 3)] = random.choices("abé ", k=random.randint(0, 3))
        a, b = sorted(("".join(a), "".join(b)), key=len)
        if a and len(b) - len(a) <= int(0.2 * len(b) + 1e-9):
            lines += [a, b]
    parts, a, b = line_dedup.Parts(lines), np.arange(0, len(lines), 2), np.arange(1, len(lines), 2)
    allowed = np.array([int(0.2 * len(lines[i]) + 1e-9) for i in b])
    true = np.array([distances(lines[i], [lines[j]])[0] for i, j in zip(a, b)])
    got, (bound, sure) = parts.distances(a, b, allowed), parts.bounds(a, b, allowed)
    near = true <= allowed
    assert 50 < near.sum() < 190
    assert (got[near] == true[near]).all() and (got[~near] > allowed[~near]).all()
    assert (bound[near] <= true[near]).all() and (bound[sure] == true[sure]).all() and sure.sum() > 50


def test_large_alphabets_are_verified_by_edit_similarity_alone():
    """With more kinds of characters than are told apart, bounds let more through, and no unlike pair is linked."""
    lines = ["".join(chr(0x4E00 + 40 * i + k) for k in range(40)) for i in range(30)]
    lines += [line[:20] + "x" + line[21:] for line in lines[:10]] + ["y" * 300 + lines[0] * 3, "y" * 300 + lines[1] * 3]
    assert not line_dedup.Parts(lines).exact
    got = line_dedup.link_lines(np.zeros(len(lines), np.int64), [bytes(16)] * len(lines), lines, 0.8)
    want = list(range(len(lines)))
    want[30:40] = range(10)
    assert got.tolist() == want


def test_unlike_lines_of_a_large_star_need_few_distances_one_by_one(monkeypatch):
    """Copies of one line, each with its own sixth of other words: too far from each other to be linked, too near for the
    bounds alone. Their distances are worked out together."""
    random.seed(14)
    words = ["".join(random.choices("abcdefgh", k=random.randint(3, 8))) for _ in range(400)]
    base, lines = random.choices(words, k=70), []
    for _ in range(40):
        line = list(base)
        for at in random.sample(range(70), 14):
            line[at] = random.choice(words)
        lines.append(" ".join(line))
    calls = []
    true_similar = line_dedup.edit_similar
    monkeypatch.setattr(line_dedup, "edit_similar", lambda a, b, s: calls.append(1) or true_similar(a, b, s))
    monkeypatch.setattr(line_dedup, "distances", lambda a, b: calls.extend(b) or [0] * len(b))
    got = line_dedup.link_lines(np.zeros(len(lines), np.int64), [bytes(8) + bytes([255 * (i % 2)] * 8) for i in range(len(lines))], lines, 0.8)
    group = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if group[a] != group[b] and true_similar(lines[a], lines[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    assert got.tolist() == group and not calls
