"""Responses cut to bytes against a loop that removes one fact and serialises again."""

import json
import random

from tracewright.audits import reports
from tracewright.operators import fitting

FOLDER = "/root/testdata/sf0.001"
KINDS = ["unknown", "dataflow", "return_use", "callsite", "guard", "input_source", "security_sink"]
CLASS = dict(zip(KINDS, (4, 3, 2, 2, 1, 0, 0), strict=True))


def body(x):
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def bound(functions, edges):
    there = {(f["fn"], i["address"]) for f in functions for b in f["blocks"] for i in b["instructions"]}
    names, blocks = {f["fn"] for f in functions}, {(f["fn"], b["block"]) for f in functions for b in f["blocks"]}
    return [e | {"guards": [g for g in e["guards"] if (e["caller"], g) in blocks]} for e in edges if e["caller"] not in names or (e["caller"], e["address"]) in there]


def fitted(functions, edges, facts, protected, omissions, maximum):
    """One response; functions nest blocks and instructions, protected holds (fn, address, index)."""
    whole = lambda: body({"functions": functions, "edges": edges, "facts": facts, "omissions": omissions})
    edges = bound(functions, edges)
    if len(whole().encode()) <= maximum:
        return "whole", 0, whole()
    functions = [f | {"excerpt": "", "truncated": True} for f in functions]
    omissions = sorted({*omissions, "response byte budget omitted pseudocode; normalized IR retained", "response byte budget may omit lower-priority instructions"})
    n, facts = 0, list(facts)
    while len(whole().encode()) > maximum:
        may = [f for f in facts if (f["fn"], f["address"], f["index"]) not in protected]
        if not may:
            return "empty", None, body({"functions": [], "edges": [], "facts": [], "omissions": omissions})
        top = min(may, key=lambda f: (-CLASS[f["kind"]], -f["address"], -f["index"], f["fact_id"]))
        facts.remove(top)
        n += 1
        kept = []
        for f in functions:
            blocks = [b | {"instructions": i} for b in f["blocks"] if (i := [i for i in b["instructions"] if (f["fn"], i["address"], i["index"]) != (top["fn"], top["address"], top["index"])])]
            if blocks:
                kept.append(f | {"blocks": blocks})
        functions = kept
        edges = bound(functions, edges)
    return "cut", n, whole()


def by_loop(responses, functions, instructions, edges, facts, maximum):
    out = {}
    for r in responses:
        mine = lambda rows, r=r: [x for x in rows if x["response"] == r["response"]]
        nested = []
        for f in sorted(mine(functions), key=lambda f: str(f["fn"])):
            own = sorted((i for i in mine(instructions) if str(i["fn"]) == str(f["fn"])), key=lambda i: (i["address"], i["index"]))
            blocks = [{"block": b, "instructions": [{k: i[k] for k in ("address", "index", "text")} for i in own if i["block"] == b]} for b in sorted({i["block"] for i in own})]
            nested.append({"fn": str(f["fn"]), "excerpt": f["excerpt"] or "", "truncated": False, "blocks": blocks})
        calls = [{"caller": str(e["caller"]), "address": e["address"], "callee": str(e["callee"]), "guards": e["guards"] or []} for e in mine(edges)]
        calls.sort(key=lambda e: (e["caller"], e["address"], e["callee"], e["guards"]))
        told = sorted(({k: str(f[k]) if k == "fn" else f[k] for k in ("fact_id", "kind", "fn", "address", "index")} for f in mine(facts)), key=lambda f: f["fact_id"])
        protected = {(str(f["fn"]), f["address"], f["index"]) for f in mine(facts) if f["protected"]}
        out[r["response"]] = fitted(nested, calls, told, protected, r["omissions"] or [], maximum)
    return out


def test_random_responses_against_the_loop(spark):
    r = random.Random(2)
    rows = {k: [] for k in ("responses", "functions", "instructions", "edges", "facts")}
    for n in range(60):
        rows["responses"].append((n, r.choice([None, [], ["z said", "a said"]])))
        for fn in range(r.randrange(4)):
            rows["functions"].append((n, f"f{fn}", r.choice([None, "", "héllo\n\"x\" " * r.randrange(1, 9)])))
            for i in range(r.randrange(7)):
                rows["instructions"].append((n, f"f{fn}", f"b{i % 3}", 100 + i // 2, i, r.choice(["ü = 1", "call \\ x", "store"])))
                for k in range(r.randrange(3)):
                    rows["facts"].append((n, f"{fn}{i}{k}", r.choice(KINDS), f"f{fn}", 100 + i // 2, i, r.random() < 0.2))
        for k in range(r.randrange(5)):
            rows["edges"].append((n, f"f{r.randrange(5)}", r.choice([100, 101, 102, 103, 104]), f"g{k}", r.choice([None, [], ["b0"], ["b2", "b0", "b9"]])))
    rows["responses"].append((60, []))
    rows["functions"].append((60, "f", "x" * 700))  # without its excerpt it fits
    kinds = {
        "responses": "response long, omissions array<string>", "functions": "response long, fn string, excerpt string", "instructions": "response long, fn string, block string, address long, index long, text string",
        "edges": "response long, caller string, address long, callee string, guards array<string>", "facts": "response long, fact_id string, kind string, fn string, address long, index long, protected boolean",
    }
    frames = {k: spark.createDataFrame(v, kinds[k]) for k, v in rows.items()}
    records = {k: [dict(zip([c.split()[0] for c in kinds[k].split(", ")], x, strict=True)) for x in v] for k, v in rows.items()}
    outcomes = set()
    for maximum in (300, 600):
        got = {x["response"]: (x["outcome"], x["dropped"], x["body"]) for x in fitting.fit_responses(**frames, maximum=maximum).collect()}
        want = by_loop(**records, maximum=maximum)
        assert got == want
        assert all(len(b.encode()) <= maximum for o, _, b in got.values() if o != "empty")
        outcomes |= {(o, bool(n)) for o, n, _ in got.values()}
    assert outcomes == {("whole", False), ("cut", False), ("cut", True), ("empty", False)}
    empty = {k: spark.createDataFrame([], kinds[k]) for k in kinds}
    assert fitting.fit_responses(**empty, maximum=300).collect() == []


def test_responses_of_the_tables(spark):
    import hashlib

    want = by_loop(**{k: [x.asDict() for x in df.collect()] for k, df in reports.responses(spark, FOLDER).items()}, maximum=3000)
    got = {x["response"]: tuple(x)[1:] for x in reports.response_fit(spark, FOLDER).collect()}
    assert got == {r: (o, n, len(b.encode()), hashlib.sha256(b.encode()).hexdigest()) for r, (o, n, b) in want.items()}
    assert {o for o, *_ in want.values()} >= {"whole", "cut"}
