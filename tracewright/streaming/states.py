"""The states of runs and findings, and what may follow each."""

from __future__ import annotations

# The states of a run in their order; each but the last three may be followed by the next, failed or cancelled.
RUN_SEQUENCE = ["created", "snapshotting", "indexing", "planning", "building", "hunting", "reproducing", "reviewing", "reporting", "completed"]
RUN_EDGES = [(a, b) for a, after in zip(RUN_SEQUENCE, RUN_SEQUENCE[1:], strict=False) for b in (after, "failed", "cancelled")]
RUN_STATES = [*RUN_SEQUENCE, "failed", "cancelled"]

# What may follow each state of a finding, besides the endings below.
FINDING_NEXT = {
    "hypothesis": ["statically_supported", "environment_blocked"],
    "statically_supported": ["poc_ready", "environment_blocked"],
    "poc_ready": ["reproduction_pending", "environment_blocked"],
    "reproduction_pending": ["reproduced", "environment_blocked"],
    "reproduced": ["reviewer_verified"],
    "reviewer_verified": ["reportable", "policy_blocked"],
    "environment_blocked": ["reproduction_pending", "verification_deferred"],
    "policy_blocked": ["reviewer_verified"],
}
# Endings, which may follow the first six states.
FINDING_ENDINGS = ["rejected", "unclear", "statically_refuted", "resource_infeasible", "verification_deferred"]
FINDING_OPEN = ["hypothesis", "statically_supported", "poc_ready", "reproduction_pending", "reproduced", "reviewer_verified"]
FINDING_EDGES = [(a, b) for a, after in FINDING_NEXT.items() for b in [*after, *(FINDING_ENDINGS if a in FINDING_OPEN else [])]]
FINDING_STATES = [*FINDING_NEXT, "reportable", *FINDING_ENDINGS]
