"""Ranked lexical search against a plain loop: tiers, blocks, ties, copies, nulls, repeated ids and empty tables."""

import math
import random
import re
from collections import Counter

import pytest

from tracewright.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    sizes = [sum(bag.values()) for _, bag in bags]
    n, total, df = sum(x > 0 for x in sizes), sum(sizes), Counter(t for _, bag in bags for t in bag)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        rows = []
        for (d, bag), size in zip(bags, sizes, strict=True):
            score = 0
            for t in terms & bag.keys():
                m = 50 + (50 * size * n) // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(12)
    common, rare = [f"c{k}" for k in range(25)], [f"Rare{k}é" for k in range(400)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.8 else r.choice(rare) for _ in range(n))
    docs = [(k, text(r.choice([3, 20, 60, 200])) + r.choice(["", "!", "\n"])) for k in range(500)]
    docs += [(1000 + k, docs[4][1]) for k in range(150)] + [(2000, None), (2001, "..."), (None, docs[4][1]), (7, docs[8][1]), (7, docs[8][1]), (2002, "c1 " * 200_000 + "x" * 2_500_000)]
    items = [(k, text(r.choice([2, 8, 25]))) for k in range(40)] + [(k, docs[k][1]) for k in range(50, 60)] + [(60, None), (61, "nowhere"), (None, "c1 c2"), (3, "Rare5é rare7é"), (62, docs[4][1])]
    return docs, items


def got(spark, docs, items, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS row", "text AS at", "1 AS rank")
    out = lexical.search(df.repartition(5), spark.createDataFrame(items, "item_id long, text string"), **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"first": 2, "growth": 8, "tiers": 3}, {"first": 30, "growth": 2, "tiers": 4, "block_bytes": 400}, {"tiers": 1}, {"first": 1, "growth": 3, "tiers": 6, "id_bytes": 0}])
def test_equals_a_plain_loop(spark, corpus, how):
    docs, items = corpus
    assert got(spark, docs, items, k=7, **how) == plain(docs, items, 7)


def test_items_end_on_a_tier_with_proof(spark, corpus):
    docs, items = corpus
    proofs = []
    got(spark, docs, items, k=3, first=40, growth=3, tiers=3, proofs=proofs)
    assert proofs[0] > 0 and sum(proofs) < len(items), proofs


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert got(spark, [], items) == got(spark, docs, []) == got(spark, [(1, "...")], items) == []
