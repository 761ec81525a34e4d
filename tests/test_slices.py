"""Slice groups, evidence slices and risk chains against plain loops."""

import random
from collections import deque

import pytest

from tracewright.audits import slices as queries
from tracewright.operators import chains, merging

FOLDER = "/root/testdata/sf0.001"


def merged(rows, cap):
    """The groups of (id, risk, nodes, edges, files, sink) by the rule over all groups at once."""
    groups = []
    for x in sorted(rows, key=lambda r: (-r[1], r[0])):
        name, _, nodes, edges, files, sink = x
        may = []
        for g in groups:
            same = sink is not None and any(y[5] == sink for y in g)
            touch = same or any(set(nodes) & set(y[2]) or set(edges) & set(y[3]) for y in g)
            together = {f for y in g for f in y[4]}
            if touch and (same or len(together | set(files)) <= cap):
                may.append((len(together), [y[0] for y in g], g))
        if may:
            min(may, key=lambda m: m[:2])[2].append(x)
        else:
            groups.append([x])
    return sorted(("group:" + "+".join(sorted(y[0] for y in g)), sorted({f for y in g for f in y[4]}), max(y[1] for y in g)) for g in groups)


SLICE = "slice_id string, risk long, nodes array<string>, edges array<string>, files array<string>, sink string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_against_a_loop(spark, seed):
    r = random.Random(seed)
    some = lambda k, n: [f"{x}" for x in r.sample(range(k), r.randrange(n))]
    rows = [(f"s{i:03d}", r.randrange(5), some(150, 4), some(200, 3), some(40, 5), r.choice([None, None, None, f"k{r.randrange(90)}"])) for i in range(160)]
    got = merging.slice_groups(spark.createDataFrame(rows, SLICE).repartition(5), 8)
    want = merged(rows, 8)
    assert sorted((x["group_id"], x["files"], x["risk"]) for x in got.collect()) == want
    assert any(len(f) > 8 for _, f, _ in want) and any("+" in g for g, _, _ in want)  # beyond the cap by a sink alone


def test_groups_of_odd_rows(spark):
    rows = [("a", 1, None, [], None, None), ("b", 1, ["x", None, "x"], None, ["f"], None), ("b", 1, ["x", None, "x"], None, ["f"], None), ("c", 2, ["x"], None, ["g"], None)]
    got = sorted((x["group_id"], x["files"], x["risk"]) for x in merging.slice_groups(spark.createDataFrame(rows, SLICE), 8).collect())
    assert got == [("group:a", [], 1), ("group:b+c", ["f", "g"], 2)]
    assert merging.slice_groups(spark.createDataFrame([], SLICE), 8).collect() == []


def test_groups_of_the_tables(spark):
    rows = [(x["slice_id"], x["risk"], x["nodes"], x["edges"], x["files"], x["sink"]) for x in queries.slices(spark, FOLDER).collect()]
    want = sorted((g, rows_.count("+") + 1, ",".join(f), risk) for g, f, risk in merged(rows, 8) for rows_ in [g])
    got = [tuple(x) for x in queries.overlapping_slices(spark, FOLDER).collect()]
    assert sorted(got) == want


def relaxed(rows):
    """Priorities by a work list: fn, block, address, index, result, operands, own."""
    out = {}
    for fn in {x[0] for x in rows}:
        mine = sorted(x for x in rows if x[0] == fn)
        by = {x[2:4]: x for x in mine}
        defined = {x[4]: k for k, x in sorted(by.items()) if x[4] is not None}
        found = {k: x[6] for k, x in by.items() if x[6] is not None}
        queue = deque(found)
        while queue:
            k = queue.popleft()
            for name in by[k][5]:
                to, p = defined.get(name), min(6, max(4, found[k] + 1))
                if to is not None and found.get(to, 99) > p:
                    found[to] = p
                    queue.append(to)
        out |= {(fn, *k): found.get(k) for k in by}
    return out


INSTRUCTION = "fn long, block long, address long, index long, result string, operands array<string>, own int"


def test_priorities_and_slices_against_a_loop(spark):
    r = random.Random(8)
    rows = []
    for fn in range(5):
        for k in range(60):
            own = r.choice([0, 1, 2]) if r.random() < (0.08 if fn else 0) else None
            rows.append((fn, k // 7, 100 + k, k, f"v{r.randrange(40)}" if r.random() < 0.8 else None, [f"v{r.randrange(40)}" for _ in range(r.randrange(3))], own))
    rows += [(7, k, k, k, f"c{k}", [f"c{k + 1}"], 2 if k == 0 else None) for k in range(12)]  # a chain of eleven steps
    df = spark.createDataFrame(rows, INSTRUCTION)
    want = relaxed(rows)
    assert {(x["fn"], x["address"], x["index"]): x["priority"] for x in merging.instruction_priorities(df).collect()} == want
    assert {want[7, k, k] for k in range(12)} == {2, 4, 5, 6} and want[7, 11, 11] == 6
    got = {(x["fn"], x["block"]): (x["priority"], x["address"], x["kept"], x["full"], x["omitted"], x["limited"]) for x in merging.evidence_slices(df, 10, 3).collect()}
    expected = {}
    for fn in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == fn]
        order = sorted((want[fn, x[2], x[3]], x[2], x[3], x[1]) for x in mine if want[fn, x[2], x[3]] is not None)
        chosen = order[:10]
        blocks = {}
        for p, a, i, b in chosen:
            blocks.setdefault(b, []).append((p, a, i))
        first = sorted(blocks, key=lambda b: (min(x[:2] for x in blocks[b]), b))[:3]
        full = lambda b, mine=mine: sum(x[1] == b for x in mine)
        for b in first:
            kept = [i for _, i in sorted((a, i) for _, a, i in blocks[b])]
            expected[fn, b] = (*min(x[:2] for x in blocks[b]), kept, full(b), full(b) - len(kept), len(order) > 10 or len(blocks) > 3)
        if not order:
            x = min(mine, key=lambda x: x[1:4])
            expected[fn, x[1]] = (None, x[2], [x[3]], full(x[1]), full(x[1]) - 1, True)
    assert got == expected


def backwards(rows):
    """Chains of one function's statements (dictionaries), each followed backwards from its allocation."""
    rows = sorted(rows, key=lambda x: (x["line"], x["seq"]))

    def state(name, before):
        """Sources, lines, names and transforms of the name ahead of a place."""
        for i in range(before - 1, -1, -1):
            x = rows[i]
            if x["target"] != name:
                continue
            if x["kind"] == "parameter":
                return set(), {x["line"]}, {name}, []
            if x["kind"] == "assign" and (got := assigned(i)):
                return got
        return None

    def united(parts):
        s, li, n, t = set(), set(), set(), []
        for a, b, c, d in parts:
            s, li, n = s | a, li | b, n | c
            t += [y for y in d if y not in t]
        return s, li, n, t

    def assigned(i):
        x = rows[i]
        parts = [p for n in sorted(set(x["names"])) if (p := state(n, i))]
        if not parts and not x["sources"]:
            return None
        ops = sorted(set(x["operations"]))
        own = [f"{x['line']}:{x['target']}:{' '.join(ops)}{':narrow' if x['narrow'] else ''}"] if ops else []
        return united([*parts, (set(x["sources"]), {x["line"]} if x["sources"] else set(), {x["target"]}, own)])

    out = []
    for i, x in enumerate(rows):
        if x["allocation"] is None or x["kind"] not in ("assign", "allocate") or x["kind"] == "assign" and x["target"] is None:
            continue
        got = assigned(i) if x["kind"] == "assign" else united([p for n in sorted(set(x["names"])) if (p := state(n, len(rows)))])
        if not got or not got[3]:
            continue
        into = x["target"] if x["kind"] == "assign" else None
        copies = [y for y in rows if y["kind"] == "copy" and y["line"] >= x["line"] and into in y["names"] and y["sources"]]
        guards = [y for y in rows if y["kind"] == "guard" and y["line"] < x["line"] and got[2] & set(y["names"])]
        strong = [y for y in guards if y["strong"]]
        narrow = any(t.endswith(":narrow") for t in got[3])
        score = (75 if narrow else 60) + 15 * bool(copies) + 5 * any(got[2] & set(y["bound"]) for y in copies)
        score -= 50 if strong else 5 if guards else 0
        out.append((x["allocation"], x["line"], sorted(got[0]), sorted(got[1]), sorted(got[2]), got[3], "dominates" if strong else "partial" if guards else "absent", sorted({y["line"] for y in strong or guards}), sorted({y["sources"][0] for y in copies}), max(0, min(100, score)), "high" if narrow and copies and not strong else "medium" if narrow or copies else "low"))
    return sorted(out, key=repr)


KINDS = "fn long, line long, seq string, kind string, target string, names array<string>, operations array<string>, sources array<string>, allocation string, narrow boolean, strong boolean, bound array<string>"


def test_chains_against_following_backwards(spark):
    r = random.Random(12)
    names, rows = [f"v{k}" for k in range(6)], []
    for fn in range(90):
        for i in range(r.randrange(4, 22)):
            kind = r.choice(["parameter", "assign", "assign", "assign", "assign", "allocate", "guard", "copy", "other"])
            sources = [f"s{i}"] if kind == "copy" or kind == "assign" and r.random() < 0.3 else []
            allocation = f"a{fn}_{i}" if kind == "allocate" or kind == "assign" and r.random() < 0.4 else None
            some = lambda: r.sample(names, r.randrange(3))
            rows.append((fn, 1 + i // 2, f"{i:02d}", kind, r.choice(names), some(), r.choice([[], ["*"], ["+", "*", "+"]]), sources, allocation, r.random() < 0.4, r.random() < 0.4, some()))
    fields = [f.split()[0] for f in KINDS.split(", ")]
    got = [tuple(x) for x in chains.risk_chains(spark.createDataFrame(rows, KINDS).repartition(4)).collect()]
    want = [(fn, *c) for fn in range(90) for c in backwards([dict(zip(fields, x, strict=True)) for x in rows if x[0] == fn])]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {x[7] for x in want} == {"absent", "partial", "dominates"} and {x[-1] for x in want} == {"high", "medium", "low"}


def test_a_later_assignment_replaces_the_state(spark):
    row = lambda line, target, names, **x: (1, line, "0", x.get("kind", "assign"), target, names, x.get("ops", []), x.get("sources", []), x.get("allocation"), True, False, [])
    rows = [row(1, "n", [], sources=["read"]), row(2, "n", [], sources=["open"]), row(3, "n", ["unknown"]), row(4, "size", ["n"], ops=["*"]), row(5, "p", ["size"], allocation="a")]
    (x,) = chains.risk_chains(spark.createDataFrame(rows, KINDS)).collect()
    # Line 2 replaces line 1; nothing known reaches line 3, so it replaces nothing.
    assert (x["sources"], x["source_lines"], x["names"], x["transforms"], x["score"]) == (["open"], [2], ["n", "p", "size"], ["4:size:*:narrow"], 75)
    assert chains.risk_chains(spark.createDataFrame([], KINDS)).collect() == []


def test_chains_of_the_tables(spark):
    by = {}
    for x in queries.statements(spark, FOLDER).collect():
        by.setdefault(x["fn"], []).append(x.asDict())
    text = lambda v: ",".join(str(y) for y in v) if isinstance(v, list) else v
    want = sorted((fn, *map(text, c)) for fn, rows in by.items() for c in backwards(rows))
    assert sorted(map(tuple, queries.function_risk_chains(spark, FOLDER).collect())) == want
    assert len(want) > 50


def test_elements_of_one_slice_link_nothing(spark, monkeypatch):
    """Components see a row for each further slice of an element, none for the rest."""
    seen = []
    found = merging.contracted_components
    monkeypatch.setattr(merging, "contracted_components", lambda links: seen.append(links.count()) or found(links))
    rows = [(f"s{i}", 1, [f"own{i}", f"pair{i // 2}"], [], ["f"], None) for i in range(4)] + [("t", 1, ["alone"], ["pair0"], ["f"], "alone")]
    got = {x["group_id"] for x in merging.slice_groups(spark.createDataFrame(rows, SLICE), 8).collect()}
    assert got == {"group:s0+s1", "group:s2+s3", "group:t"} and seen == [2]
