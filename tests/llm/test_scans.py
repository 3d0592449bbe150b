"""Collocations, periodic runs and license scans: brute force, dirty rows, edges."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tallyframe.llm import licenses, phrases, runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collocations_by_hand(rows, min_count, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        around = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        rows = []
        for p, a in often.items():
            if 100 * around[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            found.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


def texts(seed, count):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "the", "x\x1cy", "\x85", "lo-ng", "q" * 300]
    joins = [" ", "  ", "\t", ", ", ".", "\n", " ", " "]
    return [
        (i, rng.choice(["en", "en", None, "de"]), "".join(rng.choice(vocabulary) + rng.choice(joins) for _ in range(rng.randrange(40))))
        for i in range(count)
    ]


@pytest.mark.parametrize("sizes", [None, (300, 128, 16)])
def test_collocations(spark, dirty, monkeypatch, sizes):
    if sizes:  # several blocks, folds and rows of ids for each task
        for name, size in zip(("BLOCK_WORDS", "FOLD", "ROW_IDS"), sizes):
            monkeypatch.setattr(phrases, name, size)
    docs = dirty.select("doc_id", "lang", "text").unionByName(spark.createDataFrame(texts(3, 400), "doc_id long, lang string, text string"))
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in phrases.collocations(docs, min_count=5, top=40).collect())
    want = collocations_by_hand(rows, 5, 40)
    assert got == want and len({r[0] for r in got}) == 3


def test_collocations_without_phrases(spark, no_rows):
    assert phrases.collocations(no_rows).count() == 0
    rare = spark.createDataFrame([(1, "en", "a b c d")], "doc_id long, lang string, text string")
    assert phrases.collocations(rare).count() == 0


def test_collocations_in_many_small_tables(spark, monkeypatch):
    docs = spark.createDataFrame(texts(5, 400), "doc_id long, lang string, text string")
    whole = sorted(tuple(r) for r in phrases.collocations(docs, min_count=5, top=40).collect())
    for name, size in (("FOLD", 64), ("TABLE", 150), ("ROW_IDS", 16)):
        monkeypatch.setattr(phrases, name, size)
    assert sorted(tuple(r) for r in phrases.collocations(docs, min_count=5, top=40).collect()) == whole and whole


@pytest.mark.parametrize("size,id_bits", [(2, 20), (4, 17)])
def test_new_entries_are_merged_with_little_beside_the_table(size, id_bits):
    """(4, 17) has more than 64 bits."""
    rng, bits = np.random.default_rng(size), phrases.halves(size, id_bits)
    tables = []
    for n in (300_000, 20_000):
        sides = [rng.integers(0, 1 << b, n).astype(np.uint64) for b in bits]
        sides[0][: n // 2], sides[1][: n // 2] = np.arange(n // 2) % 5_000, 7
        tables.append(phrases.folded(*sides, None, bits))
    want = phrases.folded(*[np.concatenate(x) for x in zip(*tables)], bits)
    tracemalloc.start()
    got = phrases.merged(*tables, bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((g == w).all() for g, w in zip(got, want)) and got[2].max() > 1
    # sorting both together takes three times the table
    assert sum(bits) > 64 or peak < 1.8 * sum(x.nbytes for x in got)


@pytest.mark.parametrize("size,id_bits,shard_bits", [(2, 1, 1), (2, 9, 4), (3, 17, 8), (4, 5, 3), (4, 31, 8)])
def test_filters_keep_everything(size, id_bits, shard_bits):
    rng = np.random.default_rng(size * 100 + id_bits)
    ids = rng.integers(0, 1 << id_bits, (3000, size))
    ids[:1500] = ids[rng.integers(0, 3, 1500)]
    flat, starts, bits = ids.ravel(), np.arange(0, ids.size, size), phrases.halves(size, id_bits)
    left, right, counts = phrases.folded(*phrases.permuted(*phrases.packed(flat, starts, size, id_bits), bits), None, bits)
    want = Counter(map(tuple, ids.tolist()))
    got = Counter()
    for shard in range(1 << shard_bits):
        some = left >> np.uint64(bits[0] - shard_bits) == shard
        if some.any():
            row = phrases.filter_of(left[some], right[some], counts[some], bits, shard_bits)
            a, b, n = phrases.entries_of(row, bits, shard, shard_bits)
            assert (a == left[some]).all() and (b == right[some]).all() and (n == counts[some]).all()
            a, b = (x.tolist() for x in phrases.permuted(a, b, bits, back=True))
            lead, mask = size - size // 2, (1 << id_bits) - 1
            for x, y, c in zip(a, b, n.tolist()):
                words = [x >> id_bits * (lead - 1 - i) & mask for i in range(lead)] + [y >> id_bits * (size - lead - 1 - i) & mask for i in range(size - lead)]
                got[tuple(words)] += c
    assert got == want and max(want.values()) > 255


def runs_by_hand(words):
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(
                q % d == 0 and all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)
            ):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest_by_hand(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs_by_hand(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = [None] * 4
    if found:
        s, length, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = [s, length, q, 1000 * length // q]
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(found), *best, *sha)


def test_runs_of_small_alphabets():
    rng = random.Random(5)
    found = 0
    for _ in range(1500):
        whole, want = [], []
        for _ in range(rng.randrange(4)):
            words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(50))]
            if words and rng.random() < 0.5:
                s, p = rng.randrange(len(words)), rng.randint(1, len(words))
                words[s:] = [words[s + i % p] for i in range(len(words) - s)]
            want += [(len(whole) + s, length, q) for s, length, q in runs_by_hand(words)]
            whole += [*words, -1]
        got = list(zip(*(x.tolist() for x in runs.find_runs(np.array(whole, dtype=np.int64)))))
        assert got == want
        found += len(got)
    assert found > 1000


@pytest.mark.parametrize("together", [1, 1 << 18])
def test_runs(spark, dirty, documents, monkeypatch, together):
    monkeypatch.setattr(runs, "TOGETHER", together)
    more = [(i, "ab " * (i % 50) + "c d e " * (i % 7) + "\x1fé " * 5) for i in range(100, 400)]
    docs = spark.createDataFrame(more, "doc_id long, text string").unionByName(dirty.filter("length(text) < 9999 or text is null").select("doc_id", "text"))
    docs = docs.unionByName(documents.filter("length(text) < 3000").select("doc_id", "text"))
    got = [tuple(r) for r in runs.digests(docs).collect()]
    want = [digest_by_hand(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_runs_dirty(dirty, no_rows):
    clashing = dirty.withColumnRenamed("copy", "RUNS").withColumnRenamed("_row", "row")
    found = runs.with_runs(clashing)
    assert found.columns == [*[c for c in clashing.columns if c != "RUNS"], "n_runs", "runs", "collapsed"]
    assert found.count() == dirty.count() and runs.digests(no_rows).count() == 0
    row = found.filter("doc_id = 16").first()
    assert (row["n_runs"], row["runs"], row["collapsed"]) == (0, [], "a line that is said twice in one text " * 1 + "a line that is said twice in one text")
    # a long text with a long period, and one of a single word
    long = dirty.sparkSession.createDataFrame([(1, " ".join(f"w{i % 9001}" for i in range(50_000))), (2, "x " * 60_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["runs"], r["collapsed"]) for r in runs.with_runs(long).collect()}
    assert [tuple(r) for r in got[1][0]] == [(0, 50_000, 9001)] and got[1][1].count(" ") == 9000
    assert [tuple(r) for r in got[2][0]] == [(0, 60_000, 1)] and got[2][1] == "x"


def license_by_hand(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    places = [
        (i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
LICENSE_TEXTS = [
    "CC BY, cc-by cc  by CC_BY ccby cc\nby", "All rights reserved. all Rights\tRESERVED all rights", "cc cc by by all all rights reserved",
    "GNU General Public License general public general public license license", "x" * 9000 + " cc by " * 2000, "The MIT License", "École cc éby cc by", MIT,
    MIT.replace("hereby granted", "hereby kindly granted").replace("free of charge", "free"), "of this software to any person, a copy of", "\U0001F600cc by\U0001F600 cc by", None, "", " ", "cc", "by",
]


def test_licenses(spark, dirty, documents):
    docs = spark.createDataFrame(list(enumerate(LICENSE_TEXTS, 1000)), "doc_id long, text string")
    rows = docs.unionByName(dirty.select("doc_id", "text")).unionByName(documents.select("doc_id", "text")).repartition(5)
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.license_labels(rows).collect()]
    want = [(r["doc_id"], *license_by_hand(r["text"])) for r in rows.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    own = {r["doc_id"] - 1000: r for r in licenses.license_labels(docs).collect()}
    assert all(set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1 for r in own.values())
    # a word put in and two left out: neighbouring diagonals are one span
    assert [own[i]["labels"] for i in (5, 7, 8, 9)] == ["mit", "mit", "mit", ""] and own[7]["score"] == 1 and 0.75 <= own[8]["score"] < 1
    assert len(set(own[4].asDict().values())) > 3 and own[4]["n_base"] == 2000


def test_licenses_plan(dirty, no_rows):
    assert licenses.license_labels(no_rows).count() == 0
    assert licenses.license_labels(dirty).count() == dirty.count()
    plan = licenses.license_labels(dirty.sparkSession.range(3).selectExpr("id as doc_id", "'x' as text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan
