"""Why a candidate is no evidence, by the policy that its query's intent chooses, as column expressions over sets of signals.

A query has identifiers, numbers and core terms that it requires, and is about a completed release or not; a candidate has
its own. The general policy looks at the score alone, which names and numbers that are all there, or core terms of a
leading candidate, make up for. The release policy wants every name, every number and enough core terms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR, CORE_LEAST, LEADING = 0.50, 2, 5  # fixed values: least score, core terms to be met, ranks that core terms may rescue
RELEASE_WORDS = "배포|출시"  # fixed values: what a candidate about a release says


def _all_of(wanted: Column, had: Column) -> Column:
    return F.size(F.array_except(wanted, had)) == 0


def _without(mark: str, wanted: Column, had: Column) -> Column:
    return F.array_sort(F.transform(F.array_except(wanted, had), lambda x: F.concat(F.lit(mark), x)))


def core_matches(q: Column, c: Column) -> Column:
    """Core terms that a candidate meets; being about a release is one of a release query's."""
    return F.size(F.array_intersect(q["core"], c["core"])) + (q["release"] & c["release"]).cast("int")


def core_required(q: Column) -> Column:
    return F.least(F.lit(CORE_LEAST), F.size(q["core"]) + q["release"].cast("int"))


def anchored(q: Column, c: Column) -> Column:
    """Whether the query names something and the candidate has all its names and numbers."""
    return (F.size(q["identifiers"]) > 0) & _all_of(q["identifiers"], c["identifiers"]) & _all_of(q["numbers"], c["numbers"])


def reasons(policy: Column, q: Column, c: Column, score: Column, rank: Column) -> Column:
    """The reasons against a candidate in their order, an empty array for none.

    q, c: structs (identifiers, numbers, core: arrays of strings; release: boolean) of a query and a candidate; policy:
    GENERAL or COMPLETED_RELEASE_EVIDENCE.
    """
    low = (score < FLOOR) & ~anchored(q, c)
    enough = core_matches(q, c) >= core_required(q)
    rescued = (rank <= LEADING) & (F.size(q["identifiers"]) == 0) & (F.size(q["numbers"]) == 0) & (F.size(q["core"]) >= CORE_LEAST) & enough
    silent = (F.size(q["identifiers"]) == 0) & (F.size(q["numbers"]) == 0) & (F.size(q["core"]) == 0) & ~q["release"]
    told = lambda *pairs: F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in pairs]))
    release = F.concat(
        told(("NO_EXPLICIT_EVIDENCE_SIGNAL", silent), ("DENSE_SCORE_BELOW_TUNING_FLOOR", low)),
        _without("MISSING_IDENTIFIER:", q["identifiers"], c["identifiers"]),
        _without("MISSING_NUMBER:", q["numbers"], c["numbers"]),
        told(("INSUFFICIENT_CORE_TERM_COVERAGE", ~enough)),
    )
    return F.when(policy == "GENERAL", told(("DENSE_SCORE_BELOW_TUNING_FLOOR", low & ~rescued))).otherwise(release)
