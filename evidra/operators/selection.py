"""Evidence children chosen by the state of a query's typed constraints: FOUND, PARTIAL, NONE or UNASSESSED.

Works on the ranked passages of each query, so a group is as small as its top k. Constraints and observations are
read from the texts by `typed_values`; a passage's state of a constraint is the best of its children's.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import DataFrame

from ..functions.typed_values import DOCUMENT_RULES, QUERY_RULES, Reading, read

MAX_RESULTS = 5
SATISFIED, CONTRADICTED, UNKNOWN = "SATISFIED", "CONTRADICTED", "UNKNOWN"
UNCLEAR = "UNCLEAR"  # an UNKNOWN whose observation is about the constraint but does not decide it
RANK = (SATISFIED, CONTRADICTED, UNCLEAR, UNKNOWN)
FOLLOWS = {"FOUND": SATISFIED, "PARTIAL": UNKNOWN, "NONE": CONTRADICTED}


def fits(required: str, observed: str) -> bool:
    """Do the required words stand together, in order, among the observed; empty fits empty only."""
    a, b = (regex.findall(r"[\p{L}\p{N}]+", q) for q in (required, observed))
    if not required or not observed:
        return required == observed
    return bool(a) and any(b[i : i + len(a)] == a for i in range(len(b)))


def _decided(inside: bool, outside: bool) -> str:
    return SATISFIED if inside else CONTRADICTED if outside else UNCLEAR


def match(c: Reading, o: Reading) -> str:
    """A constraint against one observation."""
    if c.kind != o.kind:
        return UNKNOWN
    if c.kind == "LITERAL":
        return SATISFIED if c.name == o.name else UNKNOWN
    if c.kind == "IDENTIFIER_NUMBER":
        return UNKNOWN if c.name != o.name else SATISFIED if c.low == o.low else CONTRADICTED
    if not fits(c.qualifier, o.qualifier) or c.kind == "QUANTITY" and c.unit != o.unit:
        return UNKNOWN
    if c.kind == "DATE":  # ISO days are in the order of their text
        return _decided(*{"GT": (o.low > c.high, o.high <= c.high), "GTE": (o.low >= c.low, o.high < c.low), "LT": (o.high < c.low, o.low >= c.low)}.get(c.op, (c.low <= o.low and o.high <= c.high, o.high < c.low or o.low > c.high)))
    if c.direction not in ("NONE", o.direction):
        return UNCLEAR if o.direction == "NONE" else CONTRADICTED
    x, low = Decimal(o.low), Decimal(c.low)
    holds = {"EQ": x == low, "GT": x > low, "GTE": x >= low, "LT": x < low, "LTE": x <= low}.get(c.op)
    return _decided(holds if holds is not None else low <= x <= Decimal(c.high), True)


def _best(states: Iterator[str]) -> str:
    return min(states, key=RANK.index, default=UNKNOWN)


def overall(states: list[str]) -> str:
    """Of several constraints: all satisfied, else unknown if one is, else contradicted."""
    if all(s == SATISFIED for s in states):
        return SATISFIED
    return UNKNOWN if UNKNOWN in states or UNCLEAR in states else CONTRADICTED


def _related(states: list[str]) -> bool:
    return any(s != UNKNOWN for s in states)


def _contributors(children: list[list[str]]) -> list[int]:
    """Children that satisfy all constraints; without one, the first for each constraint, sooner one that contradicts none."""
    whole = [k for k, s in enumerate(children) if overall(s) == SATISFIED]
    if whole:
        return whole
    out = []
    for states in zip(*children):
        able = [k for k, s in enumerate(states) if s == SATISFIED]
        out.append(next((k for k in able if CONTRADICTED not in children[k]), able[0]))
    return list(dict.fromkeys(out))


def select(query: str, passages: list[list[str]]) -> tuple[str, list[tuple[int, int]]]:
    """The state, and (passage, child) of the chosen children in order; passages are lists of child texts, by rank."""
    wanted = read(query, QUERY_RULES)
    if not wanted:
        return "UNASSESSED", [(p, k) for p, kids in enumerate(passages) for k in range(len(kids))]
    told = [[[_best(match(c, o) for o in seen) for c in wanted] for seen in (read(t, DOCUMENT_RULES) for t in kids)] for kids in passages]
    whole = [[_best(iter(states)) for states in zip(*kids)] for kids in told]
    results = [overall(w) for w in whole]
    related = any(r == UNKNOWN and _related(w) for r, w in zip(results, whole))
    state = "FOUND" if SATISFIED in results else "PARTIAL" if related or CONTRADICTED not in results else "NONE"
    chosen = []
    for p, kids in enumerate(told):
        if results[p] != FOLLOWS[state] or state == "PARTIAL" and related and not _related(whole[p]):
            continue
        if state == "FOUND":
            chosen += [(p, k) for k in _contributors(kids)]
        else:
            chosen += [(p, k) for k, s in enumerate(kids) if overall(s) == FOLLOWS[state] and not (state == "PARTIAL" and related and not _related(s))]
    return state, chosen


def select_evidence(ranked: DataFrame, key: str = "query_id", most: int = MAX_RESULTS) -> DataFrame:
    """(key, state, position, child_id) of ranked children (key, query, passage_rank, child_no, child_id, content).

    A child that several passages hold counts once, where it comes first. A query always has a row; without a chosen
    child its position and child are null. Null texts are empty.
    """

    def run(group_key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["passage_rank", "child_no", "child_id"])[["passage_rank", "child_id", "content", "query"]].astype(object)
        held = [list(g) for _, g in groupby(rows.where(rows.notna(), None).itertuples(index=False), key=lambda r: r.passage_rank)]
        state, chosen = select(held[0][0].query or "", [[r.content or "" for r in g] for g in held])
        ids = list(dict.fromkeys(held[p][k].child_id for p, k in chosen))[:most]
        out = [(group_key[0], state, n, i) for n, i in enumerate(ids, 1)] or [(group_key[0], state, None, None)]
        return pd.DataFrame(out, columns=[key, "state", "position", "child_id"], dtype=object)

    types = dict(ranked.dtypes)
    return ranked.groupBy(key).applyInPandas(run, f"{key} {types[key]}, state string, position long, child_id {types['child_id']}")
