"""Importance resampling against a plain loop, with nulls, copies, ties, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from tracewright.llm import resampling, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, longest=1, buckets=10_000, least_words=20, percent=10, seed=2024):
    def found(text):
        w = TERM.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    source, aim = (Counter(b for text in texts for b in found(text)[1]) for texts in ([t for _, t in docs], target))
    every, all_aim = sum(source.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (every + buckets) / ((source[b] + 1) * (all_aim + buckets))))
    rows = []
    for doc_id, text in docs:
        n, f = found(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((n >= least_words, doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    rank = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        rank.setdefault(r[1:], []).append(k + 1)
    return sorted(((*r[1:], (rank.get(r[1:]) or [None]).pop(0) if rank.get(r[1:]) else None) for r in rows), key=str)


def corpus(n=400):
    r = random.Random(8)
    words = [f"W{k}é" if k % 3 else f"{k}" for k in range(300)]
    docs = [(k, " ".join(r.choice(words[: r.choice([40, 300])]) for _ in range(r.randrange(60))) + r.choice([".", "\n", "!?"])) for k in range(n)]
    copies = [(n + k, docs[7][1]) for k in range(n // 2)]
    return docs + copies + [(900, None), (901, ""), (902, "--- \x00 ---"), (None, docs[3][1]), (5, docs[9][1]), (5, docs[9][1]), (903, "x" * 3_000_000 + " y" * 900_000)], [docs[1][1], docs[2][1], None, "new words of the target"]


def got(spark, docs, target, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS weight", "text AS digest", "1 AS rank")
    out = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **how)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, out.collect()), key=str)


def test_equals_a_plain_loop(spark):
    docs, target = corpus()
    assert got(spark, docs, target) == plain(docs, target)


def test_longer_runs_of_words_and_other_shares(spark):
    docs, target = corpus(60)
    assert got(spark, docs[:-1], target, longest=3, buckets=97, least_words=5, percent=37, seed=3) == plain(docs[:-1], target, 3, 97, 5, 37, 3)


def test_empty_tables(spark):
    docs, target = corpus(30)
    assert got(spark, [], target) == []
    assert got(spark, docs[:-1], []) == plain(docs[:-1], [])


def test_terms_of_slices_are_those_of_the_whole(monkeypatch):
    monkeypatch.setattr(terms, "_SLICE", 7)
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("aB9é漢 .\x7f_\n") for _ in range(r.randrange(60)))
        whole = [x for part in terms.terms(pa.scalar(text)) for x in part]
        assert whole == [x.encode() for x in TERM.findall(text.translate(LOWER))]
    assert list(terms.terms(pa.scalar(None, pa.string()))) == []
