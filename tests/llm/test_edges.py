"""Nulls, empty tables, clashing columns, very long inputs, and brute-force checks of the learned operators."""

import base64
import hashlib
import math
import random
import time
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat, html_extract, language_id, mixing, packing, quality, storage, substring, warc


def test_token_ids_of_all_code_points():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, cache, r = Tokenizer.from_file(path), packing.ChunkCache(path), random.Random(1)
    codes = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    near = [c for c in codes if ord(c) < 0x260]
    texts = ["ƐWE Ɓauna ƊANSA"] + [a + b for a in near for b in ("a", "1", " ", "É")] + ["".join(codes[k : k + 7]) for k in range(0, len(codes), 7)]
    for _ in range(6000):
        texts.append("".join(r.choice(near if r.random() < 0.9 else codes) for _ in range(r.randint(1, 12))))
    wanted = tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, e in zip(texts, wanted, strict=True) if np.frombuffer(cache.ids(t), dtype="<u4").tolist() != e.ids]
    assert not wrong, wrong[:5]


def test_packing_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, length string")
    assert packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), length=64).count() == 0


def test_mixture_keeps_clashing_columns_and_follows_positions(spark):
    r = random.Random(2)
    docs = [(i, r.choice("aab"), "t", i * 7, i * 3, f"k{i}") for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, _hash long, _slot long, _position string")
    mixed = mixing.mix(df, {"a": 2, "b": 1})
    assert mixed.columns == [*df.columns, "__block", "__slot", "__position"]
    order = {x["doc_id"]: x["__position"] for x in mixed.collect()}
    parts = mixing.mixture(df, {"a": 2, "b": 1}).withColumn("p", F.spark_partition_id()).collect()
    assert sorted(tuple(x)[:-1] for x in parts) == sorted(docs)
    assert [order[x["doc_id"]] for x in parts] == list(range(500)) and len({x["p"] for x in parts}) == 4
    assert mixing.mixture(df.limit(0)).count() == 0


# Labelled by hand; none of these layouts comes from the generator. ! marks the blocks of the article.
LAYOUTS = [
    "<body><div id=top><a href=/>Site</a> <a href=/b>Blog</a></div><article><h1>!A walk</h1><p>!We went out early in the morning and saw nobody at all.</p><p>!Then it rained.</p></article>"
    '<div id="disqus_thread"><p>I saw it too, it was great</p></div></body>',
    "<main><h1>!Report</h1><section><h2>!First</h2><p>!Numbers grew by a third over the whole year.</p></section><section><h2>!Second</h2><p>!Costs fell.</p></section></main>"
    '<section id="comments"><h3>3 replies</h3><div class="comment"><p>Not in my town, costs grew.</p></div><div class="comment"><p>Agreed.</p></div></section><footer>&copy; 2020 Report Inc.</footer>',
    "<nav><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></nav><article><p>!Only one paragraph, with a <a href=/l>link</a> and more words after it, ends here.</article><aside><h3>Popular</h3><ul><li><a href=/p>Other story</a></ul></aside>",
    '<header><h1><a href="/">The Daily</a></h1></header><div class="post"><h1>!Title of the piece</h1><p>!Some words that make a paragraph of normal length for a page.</p><blockquote><p>!A quotation that belongs to it.</p></blockquote><div class="ad">Buy now and save</div><p>!The end of the piece.</p></div>'
    '<form class="subscribe"><label>Mail</label><p>Get our letter every week.</p></form>',
    '<div class="cookie-notice"><p>We use cookies to improve this page, please accept.</p><a href="#">OK</a></div><article><h2>!Recipe</h2><ul><li>!Two eggs</li><li>!Flour</li></ul><p>!Mix and bake for an hour.</p></article><div class="related-posts"><h3>More</h3><a href=/r>Another recipe</a></div>',
    '<article><h1>!Notes</h1><table><tr><td>!Year</td><td>!Rain</td></tr></table><pre>!x = 1</pre><p>!That is all there was to say about it.</p></article><ol class="commentlist"><li class="comment"><b>Ann</b><p>Thanks for the notes!</p></li></ol>',
]


def test_html_layouts_labelled_by_hand():
    model, right, total = html_extract.default_model(), 0, 0
    for html in LAYOUTS:
        marked = [b.text for b in html_extract.blocks(html)]
        found = html_extract.blocks(html.replace("!", ""), model.marks)
        states = model.decode(found)
        assert len(states) == len(marked)
        right += sum(s == t.startswith("!") for s, t in zip(states, marked, strict=True))
        total += len(marked)
    assert right >= 0.95 * total, (right, total)
    assert "saw it too" not in html_extract.main_text(LAYOUTS[0].replace("!", ""), model)


def test_html_viterbi_against_enumeration():
    model = html_extract.default_model()
    for page in html_extract.labelled(40, 5):
        found = [b for b, _ in page][:8]
        n = len(found)
        unary = [sum(model.weights.get(f, 0.0) for f in html_extract.features(b, k, n)) for k, b in enumerate(found)]

        def score(states):
            return sum(u for u, s in zip(unary, states, strict=True) if s) + sum(model.change[a][b] for a, b in zip(states, states[1:], strict=False))

        assert math.isclose(score(list(map(int, model.decode(found)))), max(map(score, product((0, 1), repeat=n))), abs_tol=1e-9)


def test_html_of_deep_and_long_pages(spark):
    began = time.time()
    model = html_extract.default_model()
    deep = "".join(f'<div class="c{k}">x' for k in range(100_000))
    assert len(html_extract.blocks(deep, model.marks)) == 100_000
    html_extract.main_text("<p>a</b>" * 50_000 + "<li>" * 50_000 + "</td>" * 50_000, model)
    assert time.time() - began < 60
    pages = [(1, "u", "<article><p>" + "word " * 400_000 + "end.</p></article>", "t"), (1, "u", "<p>", "t"), (1, "u", "<p>", "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    assert sorted(x["n_chars"] for x in html_extract.extract(df).collect()) == [0, 0, 2_000_004]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_language_features_and_one_step_against_brute_force():
    text = "Ab c"
    codes = [0, ord("a"), ord("b"), 0, ord("c"), 0]
    grams = [(n, tuple(codes[k : k + n])) for n in (1, 2, 3, 4) for k in range(len(codes) - n + 1) if n > 1 or codes[k]]
    at, counts = language_id.Grams().counts(text)
    assert counts.sum() == len(grams) and len(at) == len(set(grams))
    rows, labels = [(np.array([3, 9]), np.array([0.5, 0.25]))], np.array([1])
    weights, bias = language_id.train_ftrl(rows, labels, 2, alpha=2.0, beta=1.0, l1=0.1, l2=0.01, epochs=1)
    for feature, value, l1 in ((3, 0.5, 0.1), (9, 0.25, 0.1), (None, 1.0, 0.0)):
        for label, error in ((0, 0.5), (1, -0.5)):
            z = g = value * error
            want = 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((1.0 + abs(g)) / 2.0 + 0.01)
            assert math.isclose((bias if feature is None else weights[feature])[label], want, abs_tol=1e-12)


def test_language_rejects_what_is_in_none(spark):
    r = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop"}
    docs = [(i, " ".join("".join(r.choice(letters[lang]) for _ in range(6)) for _ in range(40)), lang) for i in range(300) for lang in [r.choice(list(letters))]]
    mixed = " ".join("".join(r.choice("qrstuvwxyz") for _ in range(6)) for _ in range(200))
    df = spark.createDataFrame([*docs, (1000, mixed, None), (1001, "12", "aa"), (1002, "q", None)], "doc_id long, text string, lang string")
    kept = {x["doc_id"] for x in language_id.identified(df).collect()}
    assert kept == {d[0] for d in docs} | {1002}
    assert {x["doc_id"] for x in language_id.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {d[0] for d in docs} | {1000, 1002}


def test_language_stage_on_other_languages_and_noise(spark):
    r = random.Random(1)
    texts = [
        " ".join("%08x" % r.getrandbits(32) for _ in range(120)),
        base64.b64encode(bytes(r.getrandbits(8) for _ in range(900))).decode(),
        " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(3, 8))) for _ in range(120)),
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. "
        "Een ieder heeft aanspraak op alle rechten en vrijheden in deze verklaring opgesomd, zonder onderscheid van welke aard ook.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "int main(int argc, char **argv) { for (int i = 0; i < argc; i++) { printf(argv[i]); } struct node *next = malloc(sizeof(*next)); if (!next) return -1; memcpy(buf, src, len); "
        "while (ptr != NULL) { ptr = ptr->next; free(ptr); } switch (kind) { case 1: break; default: continue; } }",
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(10**6 + k, t, None, "x", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in language_id.identified(docs.unionByName(more)).select("doc_id").collect()}
    assert kept == {x["doc_id"] for x in docs.select("doc_id").collect()}
    # One label alone, whose score is 1 for every text.
    alone = docs.filter("lang = 'en'")
    kept = {x["doc_id"] for x in language_id.identified(alone.unionByName(more)).select("doc_id").collect()}
    assert kept == {x["doc_id"] for x in alone.select("doc_id").collect()}


def test_language_ties_go_to_the_first_label(spark):
    rows = [(k, "same words everywhere", lang) for k, lang in enumerate(["zz", "aa"] * 20)]
    got = {x["lang_pred"] for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got <= {"aa", "zz"}
    model = language_id.Model(["aa", "bb"], np.ones(language_id.FEATURES), np.zeros((language_id.FEATURES, 2)), np.zeros(2), 1.0, np.zeros(language_id.FEATURES, dtype=bool))
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, ["doc_id"]).collect()
    assert {(x["lang_pred"], x["score"]) for x in got} == {("aa", 0.5)}


def test_packing_sends_few_pieces_up(spark, tmp_path):
    """Pieces of which no two fit together stay in their shards; a level's groups stay within a shard's size."""
    r = random.Random(3)
    pieces = [(i, 0, 0, r.randint(1100, 1500), 0, None) for i in range(6000)] + [(9000 + i, 0, 0, r.randint(1, 40), 0, None) for i in range(3000)]
    stored = spark.createDataFrame(pieces, packing._PIECE).repartition(4)
    scratch = storage.Scratch(spark, "test_packing")
    got = packing.pack_pieces(scratch.keep(stored, "pieces"), 2048, 128, scratch).toPandas()
    assert sorted(got.doc_id) == sorted(p[0] for p in pieces)
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert (bin_.offset == bin_.length.cumsum() - bin_.length).all() and bin_.length.sum() <= 2048
    assert got.sequence_id.nunique() == 6000
    sizes = [x["n"] for x in spark.read.parquet(scratch.path("level_1")).groupBy(F.shiftright("sequence_id", 26)).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 128


def test_only_the_emptiest_bins_are_not_final():
    lengths = [60, 60, 60, 50, 30, 30, 10]
    place, _, final = packing.pack_shard(lengths, 100, 2)
    room = {b: 100 - sum(n for n, x in zip(lengths, place, strict=True) if x == b) for b in set(place.tolist())}
    sent = {b for b, f in zip(place.tolist(), final.tolist(), strict=True) if not f}
    assert sent and all(room[b] >= max((room[c] for c in room if c not in sent), default=0) for b in sent)
    assert packing.pack_shard(lengths, 100)[2].all()


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\u2003", "\u3000"])
def test_ids_of_white_space_are_the_encoders(blank):
    encoding, _ = chat._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for n in (1, 2, 4095, 4096, 4097, 50_000):
        for text in (blank * n, "a" + blank * n, blank * n + "b", f"a{blank * n} b", f"a{blank * n}'s", f"x {blank * n}\n{blank * n}9"):
            assert chat.encode(encoding, text) == encoding.encode_ordinary(text)


def test_chat_of_very_long_white_space(spark):
    texts = [c * 10_000_000 for c in (" ", "\n", "\t")] + ["a" + "\u3000" * 2_000_000 + "b"]
    turns = [(k, t, role, text) for k, text in enumerate(texts) for t, role in enumerate(["user", "assistant"])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(8)
    got = {x["conv_id"]: x for x in chat.round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    for k, text in enumerate(texts):
        assert got[k]["loss_chars"] == len(text) and got[k]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("uri, path", [("/a/b", "/a/b"), ("file:/a/b", "/a/b"), ("file:///a/b", "/a/b"), ("dbfs:/a/b", "/dbfs/a/b")])
def test_archive_schemes(uri, path):
    assert warc.filesystem(uri)[1] == path
    with pytest.raises(ValueError, match="can't be written"):
        warc.filesystem("ftp://host/a")


def test_warc_of_long_payloads_and_clashing_columns(spark):
    pages = [(k, "u", "<p>é" * 300_000 if k else None, "d", 5) for k in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string, first long")
    got = {x["page_id"]: (x["payload_bytes"], x["record_type"], x["refers_to"]) for x in warc.round_trip(df).collect()}
    assert got == {0: (0, "response", None), 1: (1_500_000, "revisit", 2), 2: (1_500_000, "response", None)}
    assert warc.roles(df, id_bytes=0).filter("refers_to = 2").count() == 1


def test_chat_of_long_texts_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "word " * 300_000, 9), (1, 1, "assistant", "</turn>" * 1000, 9)], "conv_id long, turn long, role string, text string, n_turns long")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = chat.round_trip(df, path).collect()
    assert [(x["n_turns"], x["loss_chars"]) for x in got] == [(2, 7000)]
    assert chat.round_trip(df.limit(0), path).count() == 0


def test_passages_with_null_and_repeated_ids(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    df = spark.createDataFrame([(None, passage, "x"), (1, passage, "x"), (1, passage + " end", "x"), (2, "a " + passage, "x"), (3, None, "x")], "doc_id long, text string, _cut_text string")
    got = sorted(((x["doc_id"], x["n_removed"]) for x in substring.repeated_passages(df).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 30), (3, 0), (None, 0)]
    cut = substring.corpus(df)
    assert cut.columns == df.columns and {(x["doc_id"], x["text"]) for x in cut.collect()} == {(None, passage), (1, passage), (1, passage + " end"), (2, "a"), (3, None)}
    assert not spark.catalog.listTables()


def test_risk_stays_below_alpha_in_repeated_samples(spark):
    strata, n, alpha = 60, 400, 0.05
    r = random.Random(5)
    # Of good documents the symbol rate is uniform up to 0.06, of bad ones up to 0.6.
    rows = [(k * n + i, f"s{k}", i % 2, r.random() * (0.06 if i % 2 else 0.6)) for k in range(strata) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, stratum string, quality int, rate double")
    found = df.select("doc_id", "stratum", F.lit(100).cast("long").alias("n_words"), F.lit(500_000).cast("long").alias("word_chars"), F.floor(F.col("rate") * 500_000).alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"), F.lit(False).alias("base_failed"))
    found = found.withColumn("word_chars", F.lit(500).cast("long")).withColumn("n_symbols", F.col("n_symbols") / 1000.0).withColumn("step", quality.rejecting_step())
    chosen = quality.cutoffs(found, df.select("doc_id", "quality"), alpha, 0.05).collect()
    cuts = quality.RULES["symbols"][3]
    rate = lambda limit: max(0.0, 1 - cuts[limit * len(cuts) // quality.STEPS - 1] / 10000 / 0.06) if limit * len(cuts) >= quality.STEPS else 0.0
    assert len(chosen) == strata and all(rate(x["limit"]) <= alpha for x in chosen)
