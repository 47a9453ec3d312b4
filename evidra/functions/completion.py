"""Queries that ask for a completed release: a small grammar, as one Arrow function.

A supported query is a target of one word or more and then a finished form, a finished form before a marker, or a
noun before a marker, with nothing but blanks between the words and end marks after the last. A query about a release in
any other form is UNSUPPORTED; one that asks for evidence of a release is DIRECT_EVIDENCE; the latter two become
FACT_QUALIFIER where a name, a number and a word for evidence or date are there. All others are NONE, and of general intent.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .korean import IDENTIFIER_SUFFIXES, TOKEN, identifiers_of, search_form

# The words of the grammar.
FINISHED = (
    "출시했다 출시했습니다 출시했나요 출시하였다 출시하였습니다 출시하였나요 출시하였는지 출시했는지 출시했어요 "
    "배포했다 배포했습니다 배포했나요 배포하였다 배포하였습니다 배포하였나요 배포하였는지 배포했는지 배포했어요".split()
)
BEFORE_NOUNS = "출시한 출시했다는 배포한 배포했다는".split()
NOUNS = "출시 배포".split()
MARKERS = "이력 경험 여부".split()
PARTICLES = "이 가 을 를 은 는 의 에 도 만".split()
EXISTS = "있 있나요 있나 있어 있습니까 있었나 있었나요 있었어 있는지".split()
EVIDENCE = "근거 증거".split()
REQUESTS = "찾아줘 보여줘 확인해줘 있나요 있어 있나".split()
AUXILIARY = "하 했 한 되 됐".split()
FACTS = "근거 증거 날짜 일자".split()
MODIFIERS = {"실제로"}
GENERIC_NAMES = frozenset(
    "a an and are as at be been being by did do does evidence experience find for from has have how in is of on or project projects production record role show "
    "the to used using was were what when where which why with without api endpoint endpoints db http https sql jwt ui pdf txt".split()
)

_any = lambda words: f"(?:{'|'.join(words)})"
_may = f"{_any(PARTICLES)}?"
_WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}+#_-]|(?<=[a-z0-9])\.(?=[a-z0-9]))*(?<![_-])"
_TARGET, _END = rf"\s*(?P<target>(?:{_WORD}\s+)+)", r"[\s.!！。?？]*"
_MARKED = rf"{_any(MARKERS)}{_may}(?:\s+{_any(EXISTS)})?"
GRAMMAR = (
    ("SUPPORTED", regex.compile(rf"{_TARGET}(?:{_any(FINISHED)}|{_any(BEFORE_NOUNS)}\s+{_MARKED}|{_any(NOUNS)}{_may}\s+{_MARKED}){_END}")),
    ("DIRECT_EVIDENCE", regex.compile(rf"{_TARGET}{_any(BEFORE_NOUNS)}\s+(?:직접\s+)?{_any(EVIDENCE)}{_may}\s+{_any(REQUESTS)}{_END}")),
)
_NAME = regex.compile(r"[a-z][a-z0-9+.#_-]*")
_HELD = regex.compile(_any(NOUNS))
_FOLLOWS = regex.compile(rf"{_any(AUXILIARY)}|.*{_any(MARKERS)}")


def _bare(word: str) -> str:
    """Without the particle that is attached to a name."""
    heads = (word[: -len(s)] for s in IDENTIFIER_SUFFIXES if word.endswith(s))
    return next((h for h in heads if _NAME.fullmatch(h)), word)


def _speaks_of_release(words: list[str]) -> bool:
    """A release word that is no bare noun, or a bare noun before an auxiliary or a marker."""
    return any(_HELD.search(w) and (w not in NOUNS or _FOLLOWS.match(after) is not None) for w, after in zip(words, [*words, ""][1:], strict=True))


def intent_of(query: str | None) -> dict:
    """intent and the target's words; a null query is empty."""
    form = search_form(query or "")
    found, target = "NONE", []
    for name, rule in GRAMMAR:
        m = rule.fullmatch(form)
        target = [_bare(w) for w in m["target"].split() if w not in MODIFIERS] if m else []
        if target:
            found = name
            break
    words = [w.rstrip("._-") for w in TOKEN.findall(form)]
    if found == "NONE" and _speaks_of_release(words):
        found = "UNSUPPORTED"
    if found in ("UNSUPPORTED", "DIRECT_EVIDENCE"):
        named = {i for i in identifiers_of(query or "") if len(i) <= 64} - GENERIC_NAMES
        if named and regex.search(r"[0-9]", form) and _HELD.search(form) and regex.search(_any(FACTS), form):
            found, target = "FACT_QUALIFIER", []
    return {"intent": found, "target": target, "policy": "GENERAL" if found == "NONE" else "COMPLETED_RELEASE_EVIDENCE"}


@F.pandas_udf(StructType().add("intent", StringType()).add("target", ArrayType(StringType())).add("policy", StringType()))
def intent(query: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([intent_of(q) for q in query], columns=["intent", "target", "policy"], dtype=object)
