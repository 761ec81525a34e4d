"""The Jaccard join against brute force: exact links, bands and borders, blocks, giants, copies, nulls and empty tables."""

import random

import numpy as np
import pytest
from test_dedup import brute_components

from tracewright.llm import partenum


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(4000)}é" for _ in range(n)]
    passage, out = words(40), [None, "", "one two", "One TWO", "\t \n", "x " * 200, " ".join(words(4000))]
    for size in [3, 5, 6, 7, 8, 9, 10, 12, 13, 15, 18, 23, 30, 38, 41, 60, 90, 150, 400]:
        for _ in range(4):
            base = words(size)
            out.append(" ".join(base))
            for _ in range(4):  # about the threshold: by changed, added and lost words
                copy = list(base)
                for _ in range(r.randrange(0, 2 + size // 45)):
                    copy[r.randrange(len(copy))] = "changed"
                cut = r.randrange(0, 1 + size // 5)
                out.append(" ".join(copy[cut:] if r.random() < 0.5 else copy + words(cut)))
    out += [" ".join(words(12) + passage + words(9)) for _ in range(60)]
    near = words(70)
    out += [" ".join(near[:k] + ["other"] + near[k + 1 :]) for k in range(70)] * 2
    return list(enumerate(out))


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS node", "1 AS n_shingles").repartition(4)
    out = partenum.similar(df, **how)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"shingle": 2, "percent": 60, "bucket_rows": 64}, {"block_rows": 8, "id_bytes": 0, "giant_blocks": 10**6}, {"block_rows": 8, "giant_blocks": 2}])
def test_equals_brute_force(spark, rows, how):
    wanted = brute_components(rows, how.get("shingle", 5), how.get("percent", 80))
    assert got(spark, rows, **how) == sorted(((i, n, root) for i, (n, root, _) in wanted.items()), key=str)


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(1)
    for percent in (55, 80, 95):
        enum = partenum.PartEnum(percent)
        for size in [*range(1, 60), 75, 100, 141, 142, 317, 318, 900, 2500] * 3:
            whole = r.integers(1, 2**63, 2 * size + 2, dtype=np.uint64)
            common = r.integers(0, size + 1)
            for extra in range(size // 2 + 2):
                # as many differences as the threshold allows, split at random
                if 100 * (size - extra) >= percent * size:
                    split = int(r.integers(0, extra + 1))
                    a, b = whole[: size - split], whole[extra - split : size]
                    shared = len(np.intersect1d(a, b))
                    if 100 * shared >= percent * (len(a) + len(b) - shared) and len(a) + len(b) > 2 * shared:
                        assert np.intersect1d(enum.signatures(a), enum.signatures(b)).size, (percent, len(a), len(b), common)


def test_null_and_repeated_ids_and_empty_table(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text), (5, text), (5, "unlike all others"), (None, text), (3, text.upper()), (9, text + " k"), (10, None)]
    # Nine shingles against ten; a row without id links with nothing.
    assert got(spark, rows) == sorted([(5, 6, 3), (5, 6, 3), (5, 1, 5), (None, 6, None), (3, 6, 3), (9, 7, 3), (10, 0, 10)], key=str)
    assert got(spark, []) == []


def test_linked_sets_share_as_many_signatures_as_needed():
    r = np.random.default_rng(2)
    enum = partenum.PartEnum(80)
    for size in [*range(4, 50), 75, 130, 316, 317, 318, 900] * 4:
        whole = r.integers(1, 2**63, 2 * size + 2, dtype=np.uint64)
        extra = int(r.integers(1, size // 5 + 2))
        split = int(r.integers(0, extra + 1))
        a, b = whole[: size - split], whole[extra - split : size]
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * (len(a) + len(b) - shared) and len(a) + len(b) > 2 * shared:
            got = [enum.counted(x) for x in (a, b)]
            sizes, bands = np.array([len(a), len(b)]), np.array([g[1] for g in got])
            counts = np.array([g[2] for g in got]).T
            need = enum.need(sizes, bands, counts[0], counts[1:], 0)[1]
            assert len(np.intersect1d(got[0][0], got[1][0])) >= need, (len(a), len(b))


def test_linked_sets_keep_a_signature_in_common():
    """Whatever order all sets agree on."""
    r = np.random.default_rng(3)
    enum = partenum.PartEnum(80)
    for size in [*range(1, 60), 75, 130, 316, 317, 318, 900] * 4:
        whole = r.integers(1, 2**63, 2 * size + 2, dtype=np.uint64)
        extra = int(r.integers(1, size // 5 + 2))
        split = int(r.integers(0, extra + 1))
        a, b = whole[: size - split], whole[extra - split : size]
        shared = len(np.intersect1d(a, b))
        if len(a) and len(b) and 100 * shared >= 80 * (len(a) + len(b) - shared) and len(a) + len(b) > 2 * shared:
            for order in (lambda x: x, lambda x: -x, lambda x: x * 40503 % 65521):
                kept = [{int(y) for mine, _, most in enum.kept(s) for y in sorted(mine, key=lambda y: (order(int(y)), int(y)))[:most]} for s in (a, b)]
                assert kept[0] & kept[1], (len(a), len(b))


def test_common_signatures_have_one_level(spark, monkeypatch):
    """Nodes of one task, of several, and beyond COMMON: each level is that of all, and what nobody shares stays away."""
    monkeypatch.setattr(partenum, "COMMON", 6)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, 80, " ".join([*words[:60], *(f"u{k}_{j}" for j in range(20))])) for k in range(30)] + [(100 + k, 80, " ".join([*words[200:260], *(f"v{k}_{j}" for j in range(20))])) for k in range(4)]
    rows.append((200, 80, " ".join(f"x{j}" for j in range(80))))
    df = spark.createDataFrame(rows, "node long, n long, text string")
    seen = []
    for parts in (1, 3, 12):
        got = partenum.common(df.repartition(parts), 5, 5, 80).distinct().collect()
        seen.append(sorted((x["node"], x["key"], x["level"], x["x"], x["most"]) for x in got))
    assert seen[0] == seen[1] == seen[2]
    levels = {(x[0] // 100, x[2]) for x in seen[0] if x[2]}
    assert levels <= {(0, n) for n in range(2, 7)} | {(1, n) for n in range(2, 5)} and {(0, 6), (1, 4)} <= levels
    by = {}
    for node, key, level, *_ in seen[0]:
        if level:
            by.setdefault(key, set()).add((node, level))
    assert all(len({lv for _, lv in x}) == 1 and min(len(x), 6) == next(iter(x))[1] for x in by.values())
