"""Private data, exact copies, mixing and pieces: brute force, the library, dirty rows."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import exact, mixing, pieces, private

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0


def base_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


PRIVATE = [
    "a@b.c_d@e.f and x@y, x@y.z.", "1.2.3.4.5 0255.1.1.1 256.1.1.1 1.2.3 10.0.0.1 0.00.000.255 1.2.3.0256", "4111 1111 1111 1111 4111-1111-1111-1111",
    "\U0001F600é 4111111111111111 +1 (555) 010-9999 +12 +1-2", "IBAN DE89370400440532013000, GB82 WEST 1234 5698 7654 32 DE89370400440532013001 FR7630006000011234567890189",
    "7536784127813050 4845168114407329", "a" * 50_000 + "@b.c " + "1" * 50_000, "me@x.org " * 3000, None, "", "+", "@", "card 378282246310005 here",
]


def test_private_spans(spark):
    rows = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["found"] for r in private.find_private(rows).collect()}
    for i, text in enumerate(PRIVATE):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["base"]] == base_spans(text), text
    extra = [(i, s["kind"], s["start"]) for i, spans in got.items() for s in spans if not s["base"]]
    assert sorted(extra) == sorted([(4, "iban", 5), (4, "iban", 29), (4, "iban", PRIVATE[4].index("FR76")), *[(5, "card_block", m.start()) for m in re.finditer("[0-9]+", PRIVATE[5]) if luhn(m[0])], (12, "card_block", 5)])
    assert all(0 < s["score"] <= 1 for spans in got.values() for s in spans)


def test_private_dirty(dirty, no_rows):
    assert private.digests(dirty).count() == dirty.count()
    assert private.digests(no_rows).count() == 0
    marked = private.with_private(dirty)
    assert marked.columns == [*dirty.columns, "private"] and marked.count() == dirty.count()


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("table_bytes", [1 << 25, 2000])
def test_exact_groups(dirty, no_rows, documents, table_bytes):
    docs = dirty.select("doc_id", "text").unionByName(documents.select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    # a third of all rows are one text
    docs = docs.unionByName(docs.sparkSession.range(1000, 1110).selectExpr("id as doc_id", "'one\ttwo' as text")).repartition(5)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[plain(r["text"])].append(r["doc_id"])
    got = exact.exact_groups(docs, table_bytes=table_bytes).collect()
    assert len(got) == docs.count()
    by_text = defaultdict(list)
    for r in got:
        by_text[r["text_sha256"]].append(r)
    for text, ids in groups.items():
        rows = by_text[hashlib.sha256(text.encode()).hexdigest()]
        keep = min((i for i in ids if i is not None), default=None)
        assert Counter(r["doc_id"] for r in rows) == Counter(ids)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(keep, len(ids))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [keep]
    assert exact.exact_groups(no_rows).count() == 0


def test_mixing_rates(spark, dirty, no_rows):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 10 < 7, 'big', if(id % 10 < 9, null, 'rare')) as source")
    got = mixing.mixed(docs, {"rare": 2.0}, seed=3)
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    # weights 1, 1 and 2 of 20 000
    for source, expected in (("big", 5000), (None, 5000), ("rare", 10_000)):
        assert abs(counts[source] - expected) < 5 * expected**0.5
    again = mixing.mixed(docs.repartition(7), {"rare": 2.0}, seed=3)
    assert got.exceptAll(again).count() == 0 and got.count() == again.count()
    per_copy = got.groupBy("doc_id").agg(F.max("copy").alias("m"), F.count("*").alias("n")).filter("m <> n")
    assert per_copy.count() == 0
    # a rate of 2000 for one document is a sum of draws
    many = mixing.mixed(docs.limit(1), {}, target=2000).count()
    assert abs(many - 2000) < 250
    assert mixing.mixed(docs, {"big": 0.0}).filter("source = 'big'").count() == 0
    assert mixing.mixed(no_rows, {}).count() == 0
    assert mixing.mixed(dirty, {"a": 2.0}).columns == [c for c in dirty.columns if c != "copy"] + ["copy", "order_key"]


def test_mixing_order_is_spread(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'s' as source")
    order = [r["doc_id"] for r in mixing.mixed(docs, {}).collect()]
    assert abs(sum(order[: len(order) // 2]) / (len(order) // 2) - 2500) < 150


def test_pieces_match_the_library(dirty, no_rows, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = dirty.unionByName(documents, allowMissingColumns=True)
    got = pieces.encoded(docs, MODEL, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
    assert [c for c in docs.columns if c != "N_Tokens"] == got.columns[: len(docs.columns) - 1]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r["ids"]) == packed and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    again = pieces.decoded(got.drop("decoded"), MODEL)
    assert again.exceptAll(got.select(again.columns)).count() == 0
    assert pieces.encoded(no_rows, MODEL).count() == 0


def test_long_words_use_the_heap():
    vocab = pieces.Vocabulary(open(MODEL, "rb").read())
    # arrays and heap merge alike, ties, repeats and characters that are no piece included
    rng = random.Random(8)
    units = ["thetionwhandérst" * 40, *("▁" * rng.randrange(2) + "".join(rng.choices("theaonirs\U0001F600é漢\n", k=rng.randint(1, 30))) for _ in range(400)), "▁", "aaaaaaa"]
    symbols, sizes = vocab.pairs.merged(units)
    names = {i: p for p, i in vocab.pieces.items()}
    starts = sizes.cumsum() - sizes
    for unit, a, n in zip(units, starts.tolist(), sizes.tolist()):
        want = vocab.many(list(unit))
        assert [names.get(i, w) for i, w in zip(symbols[a : a + n].tolist(), want)] == want and n == len(want)
    units = list(dict.fromkeys(u for u in units if "\n" not in u))
    assert {u: list(struct.unpack(f"<{len(ids) // 4}I", ids)) for u, (ids, _) in vocab.merge_all(units).items()} == {u: vocab.merge(u) for u in units}


def test_a_difference_from_the_library_raises():
    vocab = pieces.Vocabulary(open(MODEL, "rb").read())
    # the pair that the library merges last comes first
    vocab.pairs.rank = vocab.pairs.rank.max() - vocab.pairs.rank
    with pytest.raises(RuntimeError, match="the library says"):
        vocab.merge_all([f"▁{w}" for w in ("qwertyzxcvb", "something")])


def test_forgotten_words_are_merged_again(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_WORDS", 3)
    vocab = pieces.Vocabulary(open(MODEL, "rb").read())
    texts = [b"one two  three four one two", None, b"five six seven eight one two one two nine ten", "é\n▁ x ".encode(), b"one two ten"]
    for _ in range(2):
        for part in (texts, texts[2:], texts[:1]):
            got = vocab.encode_batch(part)
            want = [vocab.library.encode((t or b"").decode()) for t in part]
            assert [list(struct.unpack(f"<{len(ids) // 4}I", ids)) for ids, _ in got] == want == [x.tolist() for x in vocab.ids_of(part)]


def test_broken_bytes_are_decoded_as_the_library_does():
    vocab = pieces.Vocabulary(open(MODEL, "rb").read())
    assert vocab.decode([vocab.begin, vocab.byte_ids[0xFF], vocab.byte_ids[0xC3], *vocab.merge("▁a")]) == vocab.library.decode([vocab.byte_ids[0xFF], vocab.byte_ids[0xC3], *vocab.merge("▁a")])
