"""Near copies, lines and vectors against brute force; connected groups."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import lines, minhash, shared, vectors
from tallyframe.llm.queries import CASES


def reach(nodes, links):
    """Node to the smallest node that it reaches."""
    beside = defaultdict(set)
    for a, b in links:
        beside[a].add(b), beside[b].add(a)
    found = {}
    for n in sorted(nodes):
        todo = [n] if n not in found else []
        while todo:
            x = todo.pop()
            if x not in found:
                found[x] = n
                todo += beside[x]
    return found


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    links = {
        "path": [(i, i + 1) for i in range(300)],
        "star": [(700, i) for i in range(400)] + [(900, 901)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
        "none": [],
    }[kind]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in shared.components(frame, "a", "b").collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == reach(nodes, links)


def shingles(text, n):
    words = (text or "").encode().lower().split()
    m = min(n, len(words))
    return {tuple(words[i : i + m]) for i in range(len(words) - m + 1)} if words else set()


def near_expected(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    counts = defaultdict(int)
    for at in holders.values():
        for k, i in enumerate(at):
            for j in at[k + 1 :]:
                counts[i, j] += 1
    links = [(i, j) for (i, j), c in counts.items() if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c)]
    return sets, reach(range(len(rows)), links)


@pytest.fixture(scope="module")
def near_docs(spark, dirty, documents):
    """Dirty rows, real ones, and a family of copies with more and more changes."""
    rng = random.Random(1)
    origin = [f"word{rng.randrange(3000)}" for _ in range(120)]
    family = []
    for i in range(250):
        words = list(origin)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        family.append((10_000 + i, " ".join(words)))
    extra = spark.createDataFrame(family, "doc_id long, text string")
    real = documents.select((F.col("doc_id") + 100).alias("doc_id"), "text")
    return dirty.select("doc_id", "text").unionByName(real).unionByName(extra).repartition(5)


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_groups(near_docs, no_rows, n, percent):
    rows = sorted(near_docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    sets, roots = near_expected(rows, n, percent)
    expected = sorted(
        (str(r["doc_id"]), len(s), str(rows[roots[i]]["doc_id"]) if s else str(r["doc_id"])) for i, (r, s) in enumerate(zip(rows, sets))
    )
    got = minhash.near_groups(near_docs, words=n, percent=percent).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_groups(no_rows).count() == 0


def test_deduplicated_keeps_one_of_each_group(dirty, no_rows):
    got = minhash.deduplicated(dirty)
    assert got.columns == dirty.columns
    texts = [r["text"] for r in got.collect()]
    # texts without words are groups of their own
    assert sum(not (t or "").split() for t in texts) == 5
    assert sum((t or "").lower().split() == ["one", "two"] for t in texts) == 1
    assert sum((t or "").startswith("w0 w7919") or (t or "").startswith("w0 w856") for t in texts) == 1
    assert minhash.deduplicated(no_rows).count() == 0


@pytest.mark.parametrize("percent,bands", [(85, 20), (80, 28)])
def test_pairs_at_the_threshold_are_seldom_missed(percent, bands):
    assert minhash.bands_for(percent) == bands
    assert (1 - (percent / 100) ** minhash.ROWS) ** bands <= 1e-6


def test_centres_and_blocks_agree(monkeypatch, near_docs):
    whole = minhash.near_groups(near_docs)
    whole = sorted(map(str, whole.collect()))
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    monkeypatch.setattr(minhash, "FEW_KEYS", 1)
    assert sorted(map(str, minhash.near_groups(near_docs).collect())) == whole


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(70)))
        b = list(a)
        for _ in range(rng.randrange(8)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(["", "x", "ab"])
        b = "".join(b)
        d = distance(a, b)
        assert lines.edit_distance(a, b, 100) == d
        assert (lines.edit_distance(a, b, 3) <= 3) == (d <= 3)


def lines_expected(rows):
    """Texts after brute force over all pairs of lines."""
    places, normal, groups = [], {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        for p, line in enumerate((rows[i][1] or "").encode().split(b"\n")):
            n = lines.normal(line)
            if len(n) >= lines.LEAST_CHARACTERS and len(line) >= lines.LEAST_CHARACTERS:
                places.append((i, p, n))
    distinct = sorted({n for *_, n in places})
    hashes = lines.simhashes([n.split() for n in distinct]).tolist() if distinct else []
    links = [
        (a, b) for a in range(len(distinct)) for b in range(a + 1, len(distinct))
        if (hashes[a] ^ hashes[b]).bit_count() <= lines.RADIUS and lines.similar(distinct[a], distinct[b])
    ]
    roots = reach(range(len(distinct)), links)
    index = {n: roots[i] for i, n in enumerate(distinct)}
    gone = set()
    for i, p, n in places:
        if index[n] in groups:
            gone.add((i, p))
        groups.setdefault(index[n], (i, p))
    out = []
    for i, (key, text) in enumerate(rows):
        kept = [x for p, x in enumerate((text or "").split("\n")) if (i, p) not in gone]
        out.append((str(key), None if text is None else "\n".join(kept), sum(g[0] == i for g in gone)))
    return sorted(out, key=str), len(links)


def test_lines(spark, dirty, documents, no_rows):
    rng = random.Random(4)
    base = [" ".join(f"v{rng.randrange(500)}" for _ in range(60)) for _ in range(6)]
    made = []
    for i in range(60):
        words = base[i % 6].split()
        words[rng.randrange(60)] = f"u{rng.randrange(50)}"
        made.append((5000 + i, "\n".join([" ".join(words), base[i % 6], f"own line number {i} of {rng.random()} here"])))
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(dirty.filter("doc_id is not null and doc_id <> 7").select("doc_id", "text"))
    docs = docs.unionByName(documents.filter("doc_id < 60").select((F.col("doc_id") + 100).alias("doc_id"), "text")).repartition(4)
    expected, links = lines_expected([tuple(r) for r in docs.collect()])
    assert links > 20
    got = lines.deduplicated_lines(docs).collect()
    assert sorted([(str(r["doc_id"]), r["text"], r["n_dropped"]) for r in got], key=str) == expected
    again = lines.deduplicated_lines(dirty)
    assert again.columns == [*dirty.columns, "n_lines", "n_dropped"] and again.count() == dirty.count()
    assert lines.deduplicated_lines(no_rows).count() == 0


def test_lines_within_the_edit_similarity_are_found(spark):
    """All pairs of lines by edit similarity alone, whatever their SimHash."""
    rng = random.Random(6)
    rows = ["de un queezmill del cioniido que no tajabo queta en en del", "de un queezmill del cioniido que se tajabo queta en en del"]
    for _ in range(120):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(6, 30))]
        rows.append(" ".join(words))
        for _ in range(1 + len(words) // 12):
            words[rng.randrange(len(words))] = "".join(rng.choice("bcdfg") for _ in range(rng.randrange(2, 6)))
        rows.append(" ".join(words))
    whole = [r.encode() for r in rows]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if lines.similar(whole[a], whole[b])]
    assert len(links) > 80
    roots = reach(range(len(rows)), links)
    got = lines.deduplicated_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)).collect()
    found = {r["doc_id"] for r in got if r["n_dropped"]}
    wanted = {b for b, a in roots.items() if a != b}
    assert found <= wanted and len(found) >= 0.98 * len(wanted) and 1 in found


def test_short_lines_within_the_edit_similarity_are_all_found(spark, monkeypatch):
    """Short lines against brute force by edit similarity alone: edits in the middle, scattered ones, few words."""
    rng = random.Random(12)
    rows = ["abcdefghij klmnopqrst", "abcdefghijxklmnopqrst", "some words of a short line ÀÉ", "sone wordz of a shorx line ÀÈ"]
    for _ in range(110):
        line = ["".join(rng.choice("aeiou lnrsté"))[0] for _ in range(rng.randrange(27, 41))]
        line[0], line[-1] = "x", "y"
        rows.append("".join(line))
        for at in rng.sample(range(1, len(line) - 1), rng.randrange(1, len(line) // 5 + 2)):
            line[at] = rng.choice(["", "k", "w", "bc"])
        rows.append("".join(line))
    whole = [lines.normal(r.encode()) for r in rows]
    assert max(map(len, whole)) <= 48 and min(map(len, whole)) >= lines.LEAST_CHARACTERS
    links = [(a, b) for b in range(len(rows)) for a in range(b) if lines.similar(whole[a], whole[b])]
    roots = reach(range(len(rows)), links)
    wanted = sorted(b for b, a in roots.items() if a != b)
    assert len(wanted) > 50 and {1, 3} <= set(wanted)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for block in (4096, 7):
        monkeypatch.setattr(lines, "SHORT_BLOCK", block, raising=False)
        assert sorted(r["doc_id"] for r in lines.deduplicated_lines(docs).collect() if r["n_dropped"]) == wanted


def test_lines_of_other_numbers_stay(spark):
    rows = [
        "2021-03-04 10:22:31 0.53 1.22", "1999-12-30 23:59:01 9.87 4.56", "2021-03-04 10:22:31  0.53 1.22",
        "Total for 1998 was 4512 units", "total for 1998 was 4512 units!", "a | 17 | 20391 | 5562 | 81", "a | 95 | 78845 | 1190 | 33",
    ]
    got = lines.deduplicated_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["n_dropped"]) == [2, 4]


def test_large_buckets_and_blocks_agree(spark, monkeypatch):
    """Copies of copies of one line that share windows, in buckets over PART and in small blocks."""
    rng = random.Random(9)
    rows = [[f"w{rng.randrange(90)}" for _ in range(30)]]
    for _ in range(150):
        words = list(rng.choice(rows[-12:]))
        for _ in range(rng.randrange(5)):
            words[rng.randrange(8, 30)] = f"w{rng.randrange(90)}"
        rows.append(words)
    texts = [(i, " ".join(words)) for i, words in enumerate(rows)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")

    def dropped():
        return sorted(r["doc_id"] for r in lines.deduplicated_lines(docs).collect() if r["n_dropped"])

    large = dropped()
    monkeypatch.setattr(lines, "BLOCK", 7)
    assert dropped() == large
    monkeypatch.setattr(lines, "CELL_PAIRS", 50)
    assert dropped() == large
    monkeypatch.setattr(lines, "PART", 1000)
    assert dropped() == large and 0 < len(large) < len(rows)


def test_lines_of_many_lengths_meet_by_length(spark, monkeypatch):
    """Lines that share windows, of 40 to 900 characters: those of other lengths are no pairs, the groups stay the same."""
    rng = random.Random(4)
    rows = []
    for n in range(60):
        words = ["the same beginning of all lines", *[f"w{rng.randrange(40)}" for _ in range(rng.randrange(4, 220))]]
        rows.append(words)
        for _ in range(3):
            other = list(words)
            for _ in range(rng.randrange(1 + len(words) // 6)):
                other[rng.randrange(1, len(words))] = f"w{rng.randrange(40)}"
            rows.append(other)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")

    def dropped():
        return sorted(r["doc_id"] for r in lines.deduplicated_lines(docs).collect() if r["n_dropped"])

    whole = dropped()
    assert 60 < len(whole) < 240
    for name, value in (("MEET", 16), ("WIDE", 8), ("PART", 4), ("BLOCK", 9)):
        monkeypatch.setattr(lines, name, value, raising=False)
    assert dropped() == whole
    # of one bucket, only lines that lengths allow to be similar are near
    monkeypatch.undo()
    monkeypatch.setattr(lines, "CHOICES", 1)
    nodes = [(i, 5, 20 + i, bytearray(b"\1\0\0\0")) for i in range(60)]
    found = lines._buckets(spark.createDataFrame(nodes, "node long, hash long, chars int, windows binary")).collect()
    assert all(r["bucket"] is not None for r in found) and len(found) == 60
    apart = [(i, 5, 20 * 2**i, bytearray(b"\1\0\0\0")) for i in range(9)]
    assert not lines._buckets(spark.createDataFrame(apart, "node long, hash long, chars int, windows binary")).collect()


def test_bounds_on_beginnings_leave_few_distances(monkeypatch):
    rng = random.Random(6)
    whole = ["".join(rng.choice(("the ", "ing", "tion ", "er", "é", "中")) for _ in range(rng.randrange(60, 90))) for _ in range(60)]
    for i in range(0, 60, 2):
        whole[i + 1] = "".join(c for c in whole[i] if rng.random() > rng.choice((0.05, 0.18, 0.22)))
    pairs = [(a, b) for b in range(60) for a in range(b) if abs(len(whole[a]) - len(whole[b])) <= int(0.2 * max(len(whole[a]), len(whole[b])))]
    x, y = np.array(pairs).T
    similar = [lines.similar(whole[a].encode(), whole[b].encode()) for a, b in pairs]
    may = lines.may_be_similar(whole, x, y)
    assert may[similar].all() and may.sum() < 0.2 * len(pairs)
    asked, exact = [], lines._similar
    monkeypatch.setattr(lines, "_similar", lambda a, b: asked.append(1) or exact(a, b))
    found = lines._links_of(whole, x, y, x, y, list(range(60)))
    assert reach(range(60), [pairs[i] for i in found]) == reach(range(60), [p for p, s in zip(pairs, similar) if s])
    assert len(asked) < 0.2 * len(pairs)


@pytest.mark.parametrize("size", [40, 300])
def test_rows_of_a_bucket_grow_with_its_lines_not_their_pairs(spark, monkeypatch, size):
    """Near lines that nothing links yet: what is handed on is lines, in a small bucket and in a large one."""
    monkeypatch.setattr(lines, "CHOICES", 1)
    rows = [(i, 1 << i % 64 | 1 << i // 64, bytearray(b"\1\0\0\0")) for i in range(2, size + 2)]
    rows = [(i, h - (1 << 64) if h >> 63 else h, w) for i, h, w in rows]
    nodes = spark.createDataFrame(rows, "node long, hash long, windows binary")
    found = lines._buckets(nodes).collect()
    assert sorted(r["node"] for r in found if r["bucket"] is not None) == [r[0] for r in rows] and len(found) == size
    large = spark.createDataFrame([(1 << 8, i, h) for i, h, _ in rows], "bucket long, node long, hash long")
    centres = spark.createDataFrame([(1 << 8, 2, rows[0][1])], "bucket long, centre long, centre_hash long")
    got = lines._unlinked(large, centres, spark.createDataFrame([], "node long, root long"))
    assert sorted(r["node"] for r in got.collect()) == [r[0] for r in rows[1:]]


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((900, 12))
    points[300:600] = points[0] + 0.08 * rng.standard_normal((300, 12))
    points[600:700] = points[rng.integers(0, 300, 100)] + 0.05 * rng.standard_normal((100, 12))
    points[700:710] = points[700]
    rows = [(i, [float(x) for x in p], i % 2 if i > 10 else None) for i, p in enumerate(points)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 12, 1), (2003, [float("nan")] * 12, 1), (2004, [None] + [1.0] * 11, 1), (None, rows[50][1], 0), (50, rows[50][1], 0), (2005, [1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    valid = [i for i, (_, v, g) in enumerate(rows) if g is not None and v and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[i][1] for i in valid])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    group = np.array([rows[i][2] for i in valid])
    near = (x @ x.T >= 0.98) & (group[:, None] == group[None, :])
    np.fill_diagonal(near, False)
    counts = dict(zip(valid, near.sum(axis=1)))
    roots = reach(range(len(rows)), [(valid[a], valid[b]) for a, b in zip(*np.nonzero(near))])
    least = defaultdict(list)
    for i, r in roots.items():
        least[r].append(rows[i][0])
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in least.items()}
    expected = sorted((str(rows[i][0]), int(counts.get(i, 0)), str(least[roots[i]])) for i in range(len(rows)))
    for cell, block in ((512, 4096), (40, 16)):
        monkeypatch.setattr(vectors, "CELL", cell)
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = vectors.linked_vectors(frame).collect()
        assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == expected
    assert vectors.linked_vectors(frame.limit(0)).count() == 0


def test_registered():
    assert sorted(CASES, key=lambda n: int(n[2:].split("_")[0]))[-1].startswith("op10_") and len(CASES) == 10
