"""Responses cut to a number of bytes of their JSON: what goes is known from sizes and ranks, without repeated serialising."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.folds import ordered_fold

# Kinds of facts by how readily they go.
DROP_CLASS = {"unknown": 4, "dataflow": 3, "return_use": 2, "callsite": 2, "guard": 1, "input_source": 0, "security_sink": 0}
# What a cut response says.
OMISSIONS = ["response byte budget may omit lower-priority instructions", "response byte budget omitted pseudocode; normalized IR retained"]

# One row a part of a response, whatever its kind; the rest of a kind's columns are null.
_PART = "part int, fn string, address long, index long, name string, note string, size int, more int, listed array<string>, sizes array<int>"
_NAMES = {
    "functions": "array<struct<fn: string, excerpt: string, truncated: boolean, blocks: array<struct<block: string, instructions: array<struct<address: bigint, index: bigint, text: string>>>>>>",
    "edges": "array<struct<caller: string, address: bigint, callee: string, guards: array<string>>>",
    "facts": "array<struct<fact_id: string, kind: string, fn: string, address: bigint, index: bigint>>",
}


def _size(*columns: Column | str) -> Column:
    return F.octet_length(F.to_json(F.struct(*columns)))


def _all_die(deaths: Iterable[int | None]) -> int | None:
    """The rank at which the last of a group goes, or None if one stays."""
    last = 0
    for x in deaths:
        if x is None:
            return None
        last = max(last, x)
    return last


def _stays(death: int | None, dropped: int) -> bool:
    return death is None or death > dropped


class Response:
    """The parts of one response; at its end, what is left of it."""

    def __init__(self, maximum: int):
        self.maximum = maximum
        self.parts: tuple[list[dict], ...] = ([], [], [], [], [])

    def step(self, row: dict) -> list[tuple]:
        self.parts[row["part"]].append(row)
        return []

    def end(self) -> list[tuple]:
        responses, functions, instructions, edges, facts = self.parts
        if not responses:
            return []
        key = lambda x: (x["fn"], x["address"], x["index"])
        guarded = {key(x) for x in facts if x["more"]}
        may = [x for x in facts if not x["more"] and (None in key(x) or key(x) not in guarded)]
        descending = lambda n: (n is None, -(n or 0))
        may.sort(key=lambda x: (-DROP_CLASS.get(x["note"], 5), descending(x["address"]), descending(x["index"]), x["name"] is not None, x["name"] or ""))
        goes: dict[tuple, int] = {}
        for rank, x in enumerate(may, 1):
            x["death"] = rank
            goes.setdefault(key(x), rank)
        names = {x["fn"] for x in functions} - {None}
        blocks, sites = defaultdict(lambda: defaultdict(list)), defaultdict(list)
        for x in instructions:
            if x["fn"] in names:
                x["death"] = None if None in key(x) else goes.get(key(x))
                blocks[x["fn"]][x["name"]].append(x)
                sites[x["fn"], x["address"]].append(x["death"])
        block_death = {fn: {b: _all_die(x["death"] for x in mine) for b, mine in of.items()} for fn, of in blocks.items()}
        fn_death = {fn: _all_die(of.values()) if (of := block_death.get(fn)) else (1 if may else None) for fn in {x["fn"] for x in functions}}

        # What goes at each rank: bytes, functions, edges, facts. Rank None is what stays.
        gone: dict[int | None, list[int]] = defaultdict(lambda: [0, 0, 0, 0])

        def part(death: int | None, size: int, kind: int = 0) -> None:
            sums = gone[death]
            sums[0] += size
            if kind:
                sums[kind] += 1

        for of, deaths in ((of, block_death[fn]) for fn, of in blocks.items()):
            for b, mine in of.items():
                part(deaths[b], mine[0]["more"])
                for x in mine:
                    part(x["death"], x["size"] + 1)
        excerpts = 0
        for x in functions:
            x["death"] = fn_death[x["fn"]]
            part(x["death"], x["size"] + (x["fn"] not in blocks), 1)
            excerpts += x["more"] - x["size"]
        calls = []
        for x in edges:
            fn, inside = x["fn"], x["fn"] in names
            site = sites.get((fn, x["address"])) if inside and x["address"] is not None else None
            if inside and site is None:
                continue
            # The call's instruction goes before its function does, or the edge stays as one from outside.
            death = _all_die(site) if inside else None
            x["death"] = death if death is not None and (fn_death[fn] is None or death < fn_death[fn]) else None
            part(x["death"], x["size"] + 1, 2)
            held = []
            for guard, size in zip(x["listed"] or (), x["sizes"] or (), strict=True):
                if guard is not None and guard in block_death.get(fn, ()):
                    least = [d for d in (x["death"], block_death[fn][guard]) if d is not None]
                    held.append((guard, min(least, default=None)))
                    part(held[-1][1], size)
            if held:
                part(_all_die(d for _, d in held), -1)  # no comma after the last
            calls.append((x, held))
        for x in facts:
            part(x.get("death"), x["size"] + 1, 3)

        full = [sum(k) for k in zip(*gone.values(), strict=True)] or [0, 0, 0, 0]
        commas = lambda rest: sum(n > 0 for n in rest[1:])

        def first_fit(frame: int) -> int | None:
            rest = full
            for dropped in range(len(may) + 1):
                rest = [a - b for a, b in zip(rest, gone[dropped], strict=True)] if dropped in gone else rest
                if rest[0] - commas(rest) + frame <= self.maximum:
                    return dropped
            return None

        def left(dropped: int, whole: bool) -> tuple[list, list, list]:
            nested = {fn: [(b, [(x["address"], x["index"], x["note"]) for x in kept]) for b, mine in of.items() if (kept := [x for x in mine if _stays(x["death"], dropped)])] for fn, of in blocks.items()}
            return (
                [(x["fn"], x["note"] if whole else "", not whole, nested.get(x["fn"], [])) for x in functions if _stays(x["death"], dropped)],
                [(x["fn"], x["address"], x["name"], [g for g, d in held if _stays(d, dropped)]) for x, held in calls if _stays(x["death"], dropped)],
                [(x["name"], x["note"], x["fn"], x["address"], x["index"]) for x in facts if _stays(x.get("death"), dropped)],
            )

        out = []
        for x in responses:
            if full[0] + excerpts - commas(full) + x["more"] <= self.maximum:
                out.append(("whole", 0, *left(0, True), x["listed"]))
            elif (dropped := first_fit(x["size"])) is not None:
                out.append(("cut", dropped, *left(dropped, False), x["listed"]))
            else:
                out.append(("empty", None, [], [], [], x["listed"]))
        return out


def fit_responses(responses: DataFrame, functions: DataFrame, instructions: DataFrame, edges: DataFrame, facts: DataFrame, maximum: int) -> DataFrame:
    """response, outcome, dropped (facts), body (JSON) of each response, whose body has at most ``maximum`` bytes.

    responses: response, omissions (array). functions: response, fn, excerpt. instructions: response, fn, block, address,
    index, text. edges: response, caller, address, callee, guards (array of blocks of the caller). facts: response, fact_id,
    kind, fn, address, index, protected. Edges count only if the caller isn't among the functions or has an instruction at
    the address; guards only if they are blocks of the caller.

    - ``whole``: it fits as it is.
    - ``cut``: the excerpts go, OMISSIONS are added (they are sorted then, each once), and facts go one by one while the
      body is too long: the unprotected one of the highest class in DROP_CLASS, then the highest address, index, then least
      fact_id. Its instruction goes along, blocks and functions that have none left, and then edges and guards that count
      no more. Functions without instructions go with the first fact.
    - ``empty``: no fact that may go is left and the body is too long still: only the omissions stay, whatever their length.

    Each part of the body has a rank at which it goes, and a size; the size of the body after each rank is a running sum,
    so the first that fits is found in one pass. All parts are dealt by response once and folded as a stream of sorted rows;
    a task holds the parts of one response. Ties in fact_id and repeated instructions are taken as given; an unknown kind
    goes first; null arrays are empty; null fields aren't in the JSON.
    """
    r = "response"
    lists = [F.array().alias(k) for k in _NAMES]
    omitted = F.coalesce("omissions", F.array().cast("array<string>"))
    said = F.array_sort(F.array_distinct(F.concat(omitted, F.array(*[F.lit(x) for x in OMISSIONS]))))
    typed = lambda df, **kinds: df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    excerpt = F.coalesce("excerpt", F.lit(""))
    head = lambda text, cut: _size("fn", text.alias("excerpt"), F.lit(cut).alias("truncated"), F.array().alias("blocks"))
    functions, edges = typed(functions, fn="string"), typed(edges, caller="string", address="long", callee="string")
    instructions, facts = (typed(df, fn="string", address="long", index="long") for df in (typed(instructions, block="string"), typed(facts, fact_id="string")))
    kinds = [f.split(" ", 1) for f in _PART.split(", ")]

    def rows(df: DataFrame, part: int, **columns: Column | str) -> DataFrame:
        columns |= {"part": F.lit(part)}
        made = lambda c: F.col(columns[c]) if isinstance(columns[c], str) else columns[c]
        return df.select(r, *[(made(c) if c in columns else F.lit(None)).cast(k).alias(c) for c, k in kinds])

    parts = [
        rows(responses, 0, listed=omitted, size=_size(*lists, said.alias("omissions")), more=_size(*lists, omitted.alias("omissions"))),
        rows(functions, 1, fn="fn", note=excerpt, size=head(F.lit(""), True), more=head(excerpt, False)),
        rows(instructions, 2, fn="fn", address="address", index="index", name="block", note="text", size=_size("address", "index", "text"), more=_size("block", F.array().alias("instructions"))),
        rows(edges, 3, fn="caller", address="address", name="callee", size=_size("caller", "address", "callee", F.array().alias("guards")), listed="guards", sizes=F.transform("guards", lambda g: F.octet_length(F.to_json(F.array(g))) - 1)),
        rows(facts, 4, fn="fn", address="address", index="index", name="fact_id", note="kind", size=_size("fact_id", "kind", "fn", "address", "index"), more=F.coalesce("protected", F.lit(False)).cast("int")),
    ]
    schema = f"outcome string, dropped long, {', '.join(f'{k} {t}' for k, t in _NAMES.items())}, omissions array<string>"
    left = ordered_fold(reduce(DataFrame.union, parts), [r], ["part", "address", "index", "name"], lambda: Response(maximum), schema)
    block = lambda b: F.struct(b["block"].alias("block"), F.array_sort(b["instructions"]).alias("instructions"))
    function = lambda f: F.struct(f["fn"].alias("fn"), f["excerpt"].alias("excerpt"), f["truncated"].alias("truncated"), F.array_sort(F.transform(f["blocks"], block)).alias("blocks"))
    record = F.struct(F.array_sort(F.transform("functions", function)).alias("functions"), F.array_sort("edges").alias("edges"), F.array_sort("facts").alias("facts"), F.when(F.col("outcome") == "whole", F.col("omissions")).otherwise(said).alias("omissions"))
    return left.select(r, "outcome", "dropped", F.to_json(record).alias("body"))
