"""MinHash and substring dedup against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewright.llm import minhash, storage, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(3000)}é" for _ in range(n)]
    passage, out = words(30), [None, "", "one two", "One TWO", "\t \n", "Ünïcode ünïcode", " ".join(words(3000))]
    for _ in range(12):
        base = words(120)
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = list(base)
            for _ in range(r.randrange(1, 8)):
                copy[r.randrange(len(copy))] = "changed"
            out.append(" \n".join(copy))
    out += [" ".join(words(20) + passage + words(15)) for _ in range(90)]
    out += [" ".join(["again"] * 60), out[7], out[7]]
    return list(enumerate(out))


def brute_components(rows, shingle, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(df, 4).collect()}
    assert got == brute_components(texts, 4, 80)


def test_keep_one_keeps_columns_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, None)], "doc_id long, text string, kept string")
    assert sorted(map(tuple, minhash.keep_one(df).collect()), key=str) == [(1, "a b c d e f", "x"), (3, None, None), (None, "a b c d e f", "z")]


def brute_passages(rows, window):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), (i, p))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("pack_bytes", [1, 2 << 20])
def test_repeated_passages(spark, texts, pack_bytes):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in substring.repeated_passages(df, 20, pack_bytes=pack_bytes).collect()}
    assert got == {i: x[:3] for i, x in brute_passages(texts, 20).items()}


def test_corpus_cuts_texts(spark, texts):
    df = spark.createDataFrame([(i, t, "en", 0) for i, t in texts], "doc_id long, text string, lang string, n_chars long")
    want = {}
    for i, (_, removed, _, kept) in brute_passages(texts, 20).items():
        if not removed:
            want[i] = (texts[i][1], 0)
        elif kept:
            want[i] = (kept, len(kept))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring.corpus(df, 20).collect()} == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0
    assert substring.repeated_passages(df).count() == 0


def test_keep_one_by_broadcast_and_by_shuffle(spark, texts):
    df = spark.createDataFrame([*texts, (None, texts[7][1])], "doc_id long, text string").withColumn("_gone", F.lit(1))
    want = sorted(i for i, (_, _, kept) in brute_components(texts, 5, 80).items() if kept)
    for id_bytes in (0, 8 << 20):
        kept = minhash.keep_one(df, id_bytes=id_bytes)
        assert kept.columns == df.columns
        got = [r["doc_id"] for r in kept.collect()]
        assert sorted(i for i in got if i is not None) == want
        assert got.count(None) == 1


def test_packs_of_a_task_share_a_bucket(spark):
    df = spark.range(0, 300, 1, 3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 20).alias("text"))
    packs = substring.pack_documents(df, 2000, 50).select("pack", F.pmod(F.hash("pack"), F.lit(50)).alias("b"), F.spark_partition_id().alias("p"), F.explode("ids").alias("doc_id"))
    rows = packs.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300))
    assert {(r["p"], r["b"]) for r in rows} == {(p, p) for p in range(3)}
    assert len({r["pack"] for r in rows}) > 20


def test_spark_hash(spark):
    numbers = [0, 1, -5, (3 << 32) + 17, 2**62, -(2**63)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(F.hash("n")).collect()]
    assert got == storage.spark_hash(np.array(numbers)).tolist()


def test_limit_on_batches_is_only_lowered(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        for given, want in (("64m", storage.BATCH_BYTES), ("1m", "1m"), ("2048", 2048)):
            spark.conf.set(key, given)
            storage.limit_batches(spark)
            assert spark.conf.get(key) == str(want)
    finally:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def crowd():
    """One dense group of near copies at all similarities, and ids that repeat with other texts."""
    r = random.Random(8)
    base, out = [f"x{k}" for k in range(80)], []
    for _ in range(120):
        copy = list(base)
        for _ in range(r.randrange(0, 12)):
            copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize("limits", [{"block_rows": 16}, {"block_shingles": 500, "giant_blocks": 3, "id_bytes": 0}])
def test_dense_group_in_blocks(spark, crowd, limits):
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(df, 4, **limits).collect()}
    assert got == brute_components(crowd, 4, 80)


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    r = random.Random(9)
    rows = []
    for i in range(20):
        one, two = ([f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(2))
        rows += [(i, " ".join(one)), (i, " ".join(two)), (100 + i, " ".join([*two[:-1], "end"]))]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    got = sorted(tuple(x) for x in minhash.near_duplicates(df, 4).select("doc_id", "component_id", "kept").collect())
    assert got == sorted([(i, i, True) for i in range(20)] * 2 + [(0, 0, True)] + [(100 + i, i, False) for i in range(20)])
    assert minhash.keep_one(df).count() == 41


def test_forest_connects_what_brute_force_does():
    r = random.Random(3)
    for _ in range(30):
        sets = [np.array(sorted(r.sample(range(30), r.randrange(1, 28))), dtype=np.uint64) for _ in range(40)]
        sides = [r.randrange(2) for _ in sets] if r.random() < 0.5 else None
        got = minhash.forest(sets, list(range(40)), sides, minhash.jaccard_need(60))
        similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b))
        want = [(i, j) for i in range(40) for j in range(i) if similar(sets[i], sets[j]) and (sides is None or sides[i] != sides[j])]

        def grouped(pairs):
            root = list(range(40))
            for _ in root:
                for i, j in pairs:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        assert all(similar(sets[i], sets[j]) for i, j in got)
        assert grouped(got) == grouped(want)


def test_packs_lie_in_small_row_groups_and_rows_of_packs_grow_as_the_text(spark):
    text = F.expr("array_join(transform(sequence(1, 9000), i -> concat('w', id * 7919 % 10007, 'x', i)), ' ')")
    docs = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))
    kept = storage.Scratch(spark, "packs").keep_bucketed(substring.pack_documents(docs, 1 << 20), "packs", "pack", 1)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(m.num_rows for m in files) >= 30 and max(g.total_byte_size for g in groups) <= 24 << 20
    rows = lambda total: total / (2 << 20) * 2 ** substring._bits(total / substring.bucket_size(total))
    assert rows(10 << 30) <= 3e6 and substring.bucket_size(1 << 30) == 8 << 20 and substring.bucket_size(200 << 30) == 64 << 20


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_of_few_edges_are_one_step(spark, monkeypatch, few):
    rng = random.Random(9)
    edges = [(rng.randrange(10**12), rng.randrange(10**12)) for _ in range(60)] + [(x, x + 1) for x in range(40)] + [(7, 7), (500, 499), (499, 500)]
    edges += [(a, edges[k - 1][1]) for k, (a, _) in enumerate(edges[1:30], 1)]
    want, group = {x: x for e in edges if e[0] != e[1] for x in e}, f"few {few}"
    while any(want[a] != want[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    monkeypatch.setattr(minhash, "FEW_EDGES", few)
    spark.sparkContext.setJobGroup(group, "")
    got = minhash.components(spark.createDataFrame(edges, "a long, b long"), storage.Scratch(spark, "few"), "edges").collect()
    spark.sparkContext.setJobGroup("", "")
    assert sorted(map(tuple, got)) == sorted(want.items())
    assert (len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 8) == (few > 0)


def test_components_without_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert minhash.components(none, storage.Scratch(spark, "few"), "edges").collect() == []
