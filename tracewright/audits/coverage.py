"""Which operators of the inventory the registered queries cover; ``python -m tracewright.audits.coverage`` prints them."""

from __future__ import annotations

import re

from tracewright.audits import COVERS

#: Operators covered by the queries of ``tracewright.queries`` and ``tracewright.whole``, and by stream and source functions.
EARLIER = {
    "usage_cost": "A2", "rate_at_k": "A21", "verdict_conflicts": "A24", "confusion_matrix": "A31 J39", "longest_runs": "A43", "consensus": "A35", "file_reasons": "A6", "unresolved_parts": "J2",
    "neighbour_expansion": "J8", "latest_before": "J38 W4", "theta_or": "J19", "pick_definition": "J1", "first_wins": "W3", "adjacent_ranges": "W5", "knowledge_top_k": "O16", "coverage_plan": "U1",
    "connected_components": "U7", "shortest_paths": "G1", "reachability": "G5", "nearest_seeds": "G13", "dominators": "G16", "json_fields": "F2", "text_normalisation": "F4 F18", "cvss_scores": "F11",
    "reduction": "F21", "insert_if_absent": "K1", "idempotent_replay": "K5",
}


def covered() -> dict[str, list[str]]:
    """Operator number to the queries that cover it."""
    out: dict[str, list[str]] = {}
    for name, numbers in [*EARLIER.items(), *((n, " ".join(c)) for n, c in COVERS.items())]:
        for number in numbers.split():
            out.setdefault(number, []).append(name)
    return out


def place(number: str) -> tuple[str, int]:
    letter, digits = re.fullmatch(r"([A-Z])(\d+)", number).groups()
    return letter, int(digits)


if __name__ == "__main__":
    for number, names in sorted(covered().items(), key=lambda x: place(x[0])):
        print(f"{number}: {', '.join(names)}")
