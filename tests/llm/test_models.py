"""Scores, votes, shards and the pipeline: brute force, held-out labels, exact round trips."""

import math
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import context, quality, shards

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def ones(n):
    """Odds of a one in node counts (zeros, ones)."""
    return (n[1] + 0.5) / (n[0] + n[1] + 1)


def block(n):
    a, b = n
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def steps(unit):
    """(contexts by depth, node, bit) of each decision of a unit."""
    u = unit if unit[:1] == context.GAP else context.WORD + unit + context.WORD
    padded = u[:1] * (context.DEPTH - 1) + u
    for i in range(context.DEPTH, len(padded)):
        node = 1
        for k in range(7, -1, -1):
            bit = padded[i] >> k & 1
            yield [padded[i - d : i] for d in range(context.DEPTH + 1)], node, bit
            node = node << 1 | bit


def expected_scores(rows):
    """log10 probability of each text by a context tree in dictionaries."""
    texts = []
    for key, text in rows:
        words, gaps = context.units_of((text or "").encode())
        texts.append((zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0, Counter(words) + gaps))
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for held_out, units in texts:
        for unit, n in units.items():
            for contexts, node, bit in steps(unit):
                for c, longer in zip(contexts, [*contexts[1:], None]):
                    counts[c, node][bit] += 0 if held_out else n
                    if longer is not None:
                        children[c, node].add(longer)
    tree = {}
    for c, node in sorted(counts, key=lambda x: -len(x[0])):
        own = block(counts[c, node])
        if len(c) < context.DEPTH:
            below = sum(tree[x, node] for x in children[c, node])
            top = max(own, below)
            tree[c, node] = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
        else:
            tree[c, node] = own
    known = {}

    def unit_score(unit):
        if unit not in known:
            total = 0.0
            for contexts, node, bit in steps(unit):
                p, rest = 0.0, 1.0
                for c in contexts:
                    n = counts[c, node]
                    w = 1.0 if len(c) == context.DEPTH else math.exp(block(n) - math.log(2) - tree[c, node])
                    p, rest = p + rest * w * ones(n), rest * (1 - w)
                total += math.log10(p if bit else 1 - p)
            known[unit] = total
        return known[unit]

    return [sum(n * unit_score(u) for u, n in units.items()) for _, units in texts]


@pytest.mark.parametrize("head,few", [(200_000, 4_000_000), (3, 0)])
def test_context_scores(dirty, documents, monkeypatch, head, few):
    monkeypatch.setattr(context, "HEAD_UNITS", head)
    monkeypatch.setattr(context, "FEW_PREDICTIONS", few)
    docs = dirty.filter("length(text) < 1000 or text is null").select("doc_id", "text")
    docs = docs.unionByName(documents.filter("doc_id < 25").select((F.col("doc_id") + 100).alias("doc_id"), F.left("text", F.lit(900)).alias("text"))).repartition(3)
    rows = [tuple(r) for r in docs.collect()]
    wanted = expected_scores(rows)
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    out = [zlib.crc32(b"" if k is None else str(k).encode()) % 10 == 0 for k, _ in rows]
    counts = Counter(w for ws, o in zip(tokens, out) if not o for w in ws)
    below = sum(counts.values()) + 0.1 * (len(counts) + 1)
    base = [sum(math.log10((counts[w] + 0.1) / below) for w in ws) for ws in tokens]
    expected = sorted(
        (str(k), o, len(ws), sum(counts[w] > 0 for w in ws), round(b, 5), round(s, 5))
        for (k, _), o, ws, b, s in zip(rows, out, tokens, base, wanted)
    )
    got = context.scores(docs).collect()
    assert {r["train_tokens"] for r in got} == {sum(counts.values())}
    found = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in got)
    for x, y in zip(found, expected, strict=True):
        assert x[:4] == y[:4] and x[4] == pytest.approx(y[4], abs=1e-4) and x[5] == pytest.approx(y[5], abs=1e-4)


def test_context_model_is_a_probability():
    """Units are read back from their bytes in one way only, so texts of all units add up to one at most."""
    for text in (b"", b" ", b"a b", b" a\n\nb ", b"a\tb  c"):
        words, gaps = context.units_of(text)
        assert sum(gaps.values()) == len(words) + 1 or (not words and gaps == {context.GAP + text + context.LAST: 1})


def test_context_reaches_over_words(spark):
    """The same words in another order, not learned from, have a lower score: what follows a word is predicted from it."""
    unseen = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, "red fox sat.\nold dog ran.") for i in (*range(200), unseen[0])] + [(unseen[1], "red dog sat.\nold fox ran.")]
    score = {r["doc_id"]: r["score"] for r in context.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert score[unseen[0]] == pytest.approx(score[0]) and score[0] > score[unseen[1]] + 1


def test_context_no_rows(no_rows):
    assert context.scores(no_rows).count() == 0


def test_quality_on_held_out_labels(spark, folder, dirty, no_rows):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.digests(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    model = quality.fit(docs, labels)
    # brute force: votes of all sample vectors for some documents
    terms = quality.Terms()
    texts = [r["text"].encode() for r in docs.limit(20).collect()]
    for text, score in zip(texts, model.scores(terms, texts)):
        near = sorted(((float(model.latent(terms, [text])[0] @ v), y) for v, y in zip(model.vectors, model.labels)), reverse=True)
        last = near[quality.NEIGHBOURS - 1][0]
        votes = [(max(s, 0) ** quality.SHARPNESS, y) for s, y in near if s >= last - 1e-6]
        assert score == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-2)
    got = quality.scored(dirty, model)
    assert got.columns == [c for c in dirty.columns if c != "Score"] + ["score", "predicted"]
    assert {r["score"] for r in got.filter("coalesce(text, '') = ''").collect()} == {0.0}
    assert quality.scored(no_rows, model).count() == 0
    unlabelled = quality.fit(docs, labels.limit(0))
    assert quality.scored(dirty, unlabelled).filter("predicted = 0").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(size):
    for seed in (0, 1):
        assert sorted(shards.permuted(range(size), size, seed)) == list(range(size))
    assert size < 64 or list(shards.permuted(range(size), size, 0)) != list(shards.permuted(range(size), size, 1))


def test_shards_round_trip(spark, dirty, no_rows, tmp_path):
    import struct

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = shards.training_order(dirty, MODEL, length=64, seed=5, shard_records=100).cache()
    rows = got.collect()
    n = len(rows)
    assert sorted(r["slot"] for r in rows) == sorted(r["index"] for r in rows) == list(range(n))
    order = shards.permuted(range(n), n, 5)
    assert all(order[r["index"]] == r["slot"] and r["shard"] == r["slot"] // 100 and len(r["record"]) == 128 for r in rows)
    parts = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["index"]):
        if r["part"] == 0:
            text = parts[len(parts)]
        text += struct.unpack(f"<{r['n_tokens']}H", r["record"][: 2 * r["n_tokens"]])
    wanted = [tuple(library.encode(r["text"] or "", add_bos=True, add_eos=True)) for r in dirty.collect()]
    assert sorted(map(tuple, parts.values())) == sorted(wanted)
    shards.write_shards(got, str(tmp_path / "shards"))
    for start in (0, n // 2, n - 1):
        back = shards.read_shards(spark, str(tmp_path / "shards"), 128, 100, start).collect()
        assert {r["slot"]: bytes(r["record"]) for r in back} == {r["slot"]: bytes(r["record"]) for r in rows if r["slot"] >= start}
    assert shards.training_order(no_rows, MODEL).count() == 0
    # no rows, no shards
    shards.write_shards(shards.training_order(no_rows, MODEL), str(tmp_path / "none"))
    assert shards.read_shards(spark, str(tmp_path / "none"), 1024).collect() == []


def test_slots_do_not_depend_on_layout(dirty, documents):
    for docs, seed in ((dirty, 3), (documents, 4)):
        seen = [
            sorted((r["slot"], r["doc_id"] is None, r["doc_id"], r["part"], bytes(r["record"])) for r in
            shards.training_order(docs.repartition(n, "text"), MODEL, length=64, seed=seed).collect()) for n in (3, 5)
        ]
        assert seen[0] == seen[1]


def test_written_shards_hold_the_order(spark, dirty, tmp_path):
    import hashlib

    rows = shards.training_order(dirty, MODEL, length=64, seed=5, shard_records=100).collect()
    found = shards.materialised(dirty, MODEL, str(tmp_path / "whole"), length=64, seed=5, shard_records=100).collect()
    want = sorted((r["slot"], r["shard"], r["index"], str(r["doc_id"]), r["part"], r["n_tokens"], hashlib.sha256(r["record"]).hexdigest()) for r in rows)
    got = sorted((r["slot"], r["shard"], r["index"], str(r["doc_id"]), r["part"], r["n_tokens"], r["record_sha256"]) for r in found)
    assert got == want
    # a key with the name of an added column
    named = shards.training_order(dirty.withColumnRenamed("doc_id", "slot"), MODEL, key="slot", length=64, seed=5, shard_records=100)
    assert sorted((r["slot"], str(r["slot_key"])) for r in named.collect()) == sorted((r["slot"], str(r["doc_id"])) for r in rows)


def test_pipeline_stages(spark, folder):
    from tallyframe.llm import lines, minhash, mixing, pieces

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder).cache()
        if i < 4:
            assert after.columns == columns, name
        if name == "quality classifier":
            scores = quality.scored(before, quality.fit(before, spark.read.parquet(f"{folder}/labels.parquet")))
            assert after.exceptAll(scores.filter("predicted = 1").select(columns)).count() == 0 < after.count() < before.count()
        elif name == "line dedup":
            found = lines.deduplicated_lines(before)
            assert after.select("doc_id", "text").exceptAll(found.select("doc_id", "text")).count() == 0 and after.count() == before.count()
            assert after.filter("n_chars <> length(text)").count() == 0
        elif name == "near dedup":
            groups = minhash.near_groups(before)
            assert after.count() == groups.filter("kept").count()
            assert after.select("doc_id").exceptAll(groups.filter("kept").select("doc_id")).count() == 0
        elif name == "mixing":
            assert after.exceptAll(mixing.mixed(before, corpus_pipeline.WEIGHTS, seed=corpus_pipeline.SEED).select(columns)).count() == 0
        else:
            assert after.count() == before.count()
            assert after.filter("ids_sha256 <> sha2(ids, 256)").count() == 0
            assert after.join(before.distinct(), "doc_id").filter("decoded_sha256 <> sha2(text, 256)").count() == 0
        before = after
    assert isinstance(pieces.OUTPUTS.names, list) and corpus_pipeline.run(spark, folder).count() == before.count()
