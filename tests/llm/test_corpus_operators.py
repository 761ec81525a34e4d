"""The other corpus operators: brute force, round trips and held-out accuracy."""

import math
import random
import zlib
from fractions import Fraction
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat, html_extract, language_id, mixing, packing, quality, topk, warc


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_frame_is_pfair():
    weights = {"a": 7, "b": 3, "c": 1, "d": 2}
    slots, total = mixing.frame(weights), sum(weights.values())
    assert {s: slots.count(s) for s in weights} == weights
    for t in range(total + 1):
        for s, w in weights.items():
            assert abs(slots[:t].count(s) - Fraction(t * w, total)) < 1


def test_mix_against_simulation(spark):
    r = random.Random(1)
    docs = [(i, r.choice(["a", "a", "b", "c", None])) for i in range(333)] + [(None, "b"), (5, "a")]
    df = spark.createDataFrame([(*x, "t", "z") for x in docs], "doc_id long, source string, text string, n string")
    got = sorted(mixing.mix(df, {"a": 5, "b": 2, None: 3}, block_rows=4).collect(), key=lambda x: x["_position"])
    assert [x["_position"] for x in got] == list(range(len(docs)))
    left = {s: sum(x[1] == s for x in docs) for s in ("a", "b", "c", None)}
    weights, order = {"a": 5, "b": 2, "c": 1, None: 3}, []
    while any(left.values()):
        active = {("n" if s is None else f"s{s}"): s for s, n in left.items() if n}
        g = math.gcd(*(weights[s] for s in active.values()))
        over = False
        while not over:
            for key in mixing.frame({k: weights[s] // g for k, s in active.items()}):
                s = active[key]
                n = min(4, left[s])
                order += [s] * n
                left[s] -= n
                if over := not left[s]:
                    break
    assert [x["source"] for x in got] == order
    assert mixing.mix(df.limit(0)).count() == 0


def test_language_id(spark):
    r = random.Random(2)
    letters = {"aa": "abcde", "bb": "cdefgh", "cc": "éèàbc"}
    docs = []
    for i in range(400):
        lang = r.choice(list(letters))
        docs.append((i, " ".join("".join(r.choice(letters[lang]) for _ in range(5)) for _ in range(r.randint(3, 60))), lang))
    docs += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (None, docs[0][1], "bb"), (1003, docs[0][1] * 9000, None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, score string")
    got = {x["doc_id"]: x for x in language_id.identify(df).collect()}
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003]["lang_pred"] == docs[0][2] and not got[None]["held_out"]
    held = [d for d in docs[:400] if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert all(got[d[0]]["held_out"] for d in held)
    assert np.mean([got[d[0]]["lang_pred"] == d[2] for d in held]) > 0.95
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language_id.identified(df).columns == df.columns
    assert language_id.identify(df.limit(0)).count() == 0


def test_grams_of_long_text_do_not_depend_on_slices(monkeypatch):
    grams, text = language_id.Grams(), "Ab c, dé  f!g " * 40
    whole = grams.counts(text)
    monkeypatch.setattr(language_id, "_SLICE", 7)
    sliced = grams.counts(text)
    assert (whole[0] == sliced[0]).all() and (whole[1] == sliced[1]).all()


def test_html(spark):
    model = html_extract.default_model()
    test = html_extract.labelled(150, 77)
    right = [a == b for p in test for a, (_, b) in zip(model.decode([x for x, _ in p]), p, strict=True)]
    assert np.mean(right) > 0.99
    html = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>One\n two.<p><b>Thr</b>ee &eacute;.</article><script>x()</script><footer>&copy; c</footer>'
    df = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "", "<![x <"), (None, "u", "")], "page_id long, url string, html string")
    got = {x["page_id"]: (x["text"], x["n_chars"]) for x in html_extract.extract(df).collect()}
    assert got[1] == ("A & B\n\nOne two.\n\nThree é.", 25) and got[2] == ("", 0) and got[None] == ("", 0)


def brute_top_k(vectors, k):
    valid = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in valid:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in valid if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    vectors = [(int(i), [float(x) for x in centres[i % 6] + 0.05 * r.normal(size=8)]) for i in range(700)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(60)] + [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (None, [1.0] * 8), (2060, []), (2080, [3.0])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, block_rows=64)
    assert sorted(map(tuple, got.collect())) == brute_top_k(vectors, 5)
    big = spark.createDataFrame([(0, [1e14, 1.0]), (1, [1e14, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert [x["vec_id"] for x in sorted(topk.top_k(big, F.col("vec_id") == 2, k=5).collect(), key=lambda x: x["rank"])] == [1, 0]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/ b", "<p>é"), (2, None, "<p>é"), (3, "u\r\nX: y", "<p>é"), (4, "u", None), (9, "u", ""), (None, "u", "z"), (9, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = rows(warc.round_trip(df).select("page_id", "url", "payload_bytes", "record_type", "refers_to"))
    want = [(1, "http://a/ b", 5, "revisit", 3), (2, None, 5, "revisit", 3), (3, "u\r\nX: y", 5, "response", None), (4, "u", 0, "revisit", 9), (9, "u", 0, "response", None), (9, "u", 0, "response", None), (None, "u", 1, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.coalesced([("a", 0, 5), ("a", 6, 4), ("a", 99, 1), ("b", 0, 2)], 3, 100) == [("a", 0, 10, 0, 2), ("a", 99, 100, 2, 3), ("b", 0, 2, 3, 4)]
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "### User: ", r"\### User: ", r"\\</turn>\ ### Text: x", "</turn></turn>", "é\n"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not chat._CONTROL.sub(lambda m: "" if m[1] else "!", chat.escape(text)).count("!")


def test_chat(spark):
    import hashlib

    turns = [(1, 0, "user", "hi ### Assistant: "), (1, 1, "assistant", "yo</turn>"), (1, 2, "tool", None), (None, None, None, "é"), (2, 0, "assistant", "a"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat.round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nhi ### Assistant: \nassistant\nyo</turn>\ntool\n\n") and got[1]["loss_sha256"] == sha("yo</turn>")
    assert got[2]["loss_sha256"] == sha("abb") and got[2]["n_turns"] == 3 and got[None]["turns_sha256"] == sha("\né\n")


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(5)
    words = ["The", "é'tait", "don't", "x,y", "Ⅷ", "<|endoftext|>", "naïve", "12a", "###", "İ", "\u3000", "ſ"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 3, 40, 400]))) for _ in range(150)] + [None, "", "W\u030a w\u030a", "a\tb\nc"]
    docs = list(enumerate(texts)) + [(None, "x"), (3, texts[3])]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), path, length=64, shard_pieces=20).toPandas()
    ids = {i: np.array([*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in enumerate(texts)}
    for x in got[got.doc_id.notna()].itertuples():
        part = ids[int(x.doc_id)][x.start : x.start + x.length]
        assert len(part) == x.length and zlib.crc32(part.tobytes()) == x.ids_crc32 and x.start == 64 * x.piece
    assert len(got) == sum(-(-len(ids[i]) // 64) for i in ids) + 1 + -(-len(ids[3]) // 64)
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert (bin_.offset == bin_.length.cumsum() - bin_.length).all() and bin_.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 1


@pytest.mark.parametrize("weights", [{"hot": 1, "b": 1, "c": 2}, None])
def test_packing_keeps_the_mixture(spark, tmp_path, weights):
    import corpus_pipeline

    r = random.Random(6)
    docs = [(i, r.choice("hhhhhhbc").replace("h", "hot"), "one two three " * r.choice([3, r.randint(1, 60), r.randint(60, 300), 900])) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    mixing.mixture(df, weights=weights, block_rows=4).write.parquet(str(tmp_path / "mixed"))
    order = {x["doc_id"]: x["_position"] for x in mixing.mix(df, weights, block_rows=4).collect()}
    stored = spark.read.parquet(str(tmp_path / "mixed"))
    assert {x["doc_id"]: x["_position"] for x in mixing.numbered(stored).select("doc_id", "_position").collect()} == order
    got = corpus_pipeline.stage_packing(spark, stored, "").toPandas().sort_values(["sequence_id", "offset"])
    assert set(got.doc_id) == set(order) and not got.duplicated(["doc_id", "piece"]).any()
    for _, bin_ in got.groupby("sequence_id"):
        assert (bin_.offset == bin_.length.cumsum() - bin_.length).all() and bin_.length.sum() <= 2048
    n = got[got.length < 2048].shape[0]
    ranges = -(-n // 1024)
    width = -(-len(docs) // ranges)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2 * ranges
    rows = {s: sum(x[1] == s for x in docs) for s in ("hot", "b", "c")}
    target, source = weights or mixing.tempered(rows, 0.5, 1000), {x[0]: x[1] for x in docs}
    # All sources have blocks left as long as each has rows for its share.
    full = min(rows[s] * sum(target.values()) / w for s, w in target.items())
    ends = range(width, len(docs), width)
    assert len(ends) > 2 and ends[0] < full
    for end in ends:
        prefix = set(got[got.sequence_id < end << 20].doc_id)
        assert prefix == {i for i, at in order.items() if at < end}
        if end < full - 50:
            for s, w in target.items():
                assert abs(sum(source[i] == s for i in prefix) - end * w / sum(target.values())) <= 8


def test_local_search_empties_a_bin():
    bins = packing.Bins([6, 6, 4, 4, 5, 5], 10)
    bins.items, bins.free = [[0], [1], [2, 4], [3, 5]], [4, 4, 1, 1]
    bins.search()
    assert sum(map(bool, bins.items)) == 3 and all(sum(bins.sizes[i] for i in b) <= 10 for b in bins.items)


def test_local_search_looks_at_all_underfull_bins():
    r = random.Random(1)
    bins = packing.Bins([r.randint(400, 900) for _ in range(3000)], 2048)
    bins.best_fit()
    assert sum(map(bool, bins.items)) == 1021 and sum(map(bool, bins.free)) == 546
    bins.search()
    assert sorted(i for b in bins.items for i in b) == list(range(3000))
    assert all(sum(bins.sizes[i] for i in b) + f == 2048 for b, f in zip(bins.items, bins.free, strict=True))
    assert sum(map(bool, bins.items)) <= 1000
    # No trade that gains is left.
    underfull = [([bins.sizes[i] for i in b], f) for b, f in zip(bins.items, bins.free, strict=True) if b and f]
    sums = lambda x, n: {sum(c) for k in n for c in combinations(x, k)}
    for a, (mine, free) in enumerate(underfull):
        for b, (theirs, room) in enumerate(underfull):
            if a != b and room <= free:
                for give, take in (([1, 2], [0, 1]), ([1], [2])):
                    assert not any(0 < g - t <= room for g in sums(mine, give) for t in sums(theirs, take))


def test_binomial_tail(spark):
    for n, k, p in [(10, 0, 0.1), (300, 2, 0.02), (5000, 60, 0.02), (100000, 1900, 0.02), (50, 40, 0.1)]:
        exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) if k < n * p else 1.0
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert math.isclose(got, exact, rel_tol=1e-8)


def test_quality(spark):
    docs = [(i, ("ok word " * 3 + " ".join(f"w{i}x{k}" for k in range(60)) + (" ### " * 40 if i % 10 == 0 else "")), "en") for i in range(1500)]
    docs += [(2000, None, None), (2001, "", "en"), (2002, "a b c a b c a b c " * 20, None)]
    labels = [(i, int(i % 10 != 0)) for i in range(1500)] + [(None, 1), (7777, 0), (3, None)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.judge(df, marks, alpha=0.05).collect()}
    assert all(got[i]["kept"] == (i % 10 != 0) for i in range(1500))
    assert [got[i]["base_failed"] for i in (2000, 2001, 2002)] == [True] * 3 and got[2002]["n_repeat_words"] == 180
    assert quality.judge(df.limit(0), marks.limit(0)).count() == 0
    assert all(x["kept"] for x in quality.judge(df.filter("doc_id < 50"), marks.limit(0)).collect())


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        kept.append(out.count())
        docs = out
    assert kept[0] >= kept[1] > kept[2] >= kept[3] == kept[4] > 0.5 * kept[0]
    final = corpus_pipeline.run(spark, folder)
    assert final.select("doc_id").distinct().count() == kept[4]
