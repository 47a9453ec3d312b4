"""The general evidence profile: one result per place and per fact, eligibility by score or terms, a bounded re-ranking.

Works on the candidates of each query (at most `MAX_CANDIDATES`, as the search before it gives), so a group is
small by construction. Release-completion queries need a grammar that is not here; they are treated as general.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from math import ceil

import pandas as pd
import regex
from pyspark.sql import DataFrame

from ..functions.korean import TOKEN, WORDS, identifiers_of, search_form, stem_of
from ..functions.snippets import best_window

# Floors, spans, boosts, and the signal words of the re-ranking.
MAX_CANDIDATES, MAX_RESULTS, TOP = 20, 5, 5
SCORE_FLOOR, CORE_TERMS, IDENTIFIER_MAX = 0.50, 2, 64
OVERLAP, OVERLAP_SHARE = 80, 0.30
SAME_PLACE_SPAN, SAME_PLACE_SHARE, OTHER_PLACE_SPAN, OTHER_PLACE_SHARE = 200, 0.30, 320, 0.40
BOOSTS = {"identifiers": 0.02, "terms": 0.005, "numbers": 0.005}
ADJUSTMENT_LOW, ADJUSTMENT_HIGH = -0.035, 0.065
NUMBER = regex.compile(r"[0-9][0-9,]*(?:\.[0-9]+)?")
APART_NUMBER = regex.compile(r"(?<!\p{N})[0-9][0-9,]*(?:\.[0-9]+)?")
GENERIC_ASCII = frozenset(
    "a an and are as at be been being by did do does evidence experience find for from has have how in is of on or project projects production record role show "
    "the to used using was were what when where which why with without api endpoint endpoints db http https sql jwt ui pdf txt".split()
)
STOPS = frozenset("근거 보여 찾아 확인 실제 이력 기록 질문 문서 프로젝트 경험 이유 어떻게 무엇 있는 있 없 해줘 보여줘 있어 있나 있나요 있었나 있었어 했나 했어 인가 인지 같은 없이 대한 관련 현재".split())
RELEASE_FORMS = tuple(
    "출시한 출시했다 출시했습니다 출시했나요 출시했다는 출시하였다 출시하였습니다 출시하였나요 출시하였는지 출시했는지 출시했어요 "
    "배포한 배포했다 배포했습니다 배포했나요 배포했다는 배포하였다 배포하였습니다 배포하였나요 배포하였는지 배포했는지 배포했어요".split()
)
TOLD_RELEASE_FORMS = tuple("출시했다 출시했습니다 출시하였다 출시하였습니다 출시했어요 배포했다 배포했습니다 배포하였다 배포하였습니다 배포했어요".split())
ACTION = "구현 적용 설계 개선 분리 도입 처리 검증 구축 배포 최적화 전환 방지 재처리 통합 구성 제어 차단".split()
PROBLEM = "문제 장애 실패 병목 충돌 중복 지연 불일치 누락 위험 경쟁 누적 어려".split()
RESULT = "결과 감소 단축 향상 개선 방지 유지 성공 완료 절감 안정 해결 전환 줄였 낮췄 높였 제거 통과 0건".split()
GENERIC_TERMS = frozenset("경험 처리 문제 해결 사용 활용 구현 알려줘 어떻게 방법 같이 했던 있어 있나요 백엔드".split())
ANCHOR_SUFFIXES = "으로부터 에게서 에서는 에서도 이라고 이라도 이라면 하던 했던 하는 오는 에서 에게 까지 부터 으로 라고 라는 에는 에도 로 을 를 은 는 이 가 와 과 의 에 도 만 인".split()
PROFILE = regex.compile(r"(?i)[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.[a-z]{2,}|https?://|www\.|github\.com/|(?:\+?82[- .]?)?0(?:10|2|[3-6][1-5])[- .]?[0-9]{3,4}[- .]?[0-9]{4}|\b(?:contact|email|phone|education|gpa)\b")
GUIDE = regex.compile(r"(?i)(?:포트폴리오|문서).{0,30}(?:요약|소개|정리)|요약|개요|portfolio focus|검증 기준|중심으로 설명")
STACK = regex.compile(r"(?i)^.{0,30}(?:cache|database|realtime|security|infra)")
STRUCTURED = regex.compile(r"문제\s*원인|해결\s*과정|테스트\s*결과|성능\s*측정\s*결과|검증\s*결과")
TECHNICAL = regex.compile(r"(?<![a-z0-9+#._-])[a-z][a-z0-9+.#_-]{2,}(?![a-z0-9+#._-])")


@dataclass(frozen=True)
class Signals:
    identifiers: frozenset[str]
    numbers: frozenset[str]
    terms: frozenset[str]

    def shares(self, of: Signals) -> dict[str, float]:
        """How much of each kind of `of` is here."""
        return {k: len(getattr(of, k) & getattr(self, k)) / len(getattr(of, k)) if getattr(of, k) else 0.0 for k in BOOSTS}


def _plain(number: str) -> str:
    whole, _, part = number.replace(",", "").partition(".")
    part = part.rstrip("0")
    return (whole.lstrip("0") or "0") + (f".{part}" if part else "")


def _signals(text: str, unheard: tuple[str, ...]) -> Signals:
    form = search_form(text)
    words = (t.rstrip("._-") for t in TOKEN.findall(form))
    terms = (stem_of(w) for w in words if w not in unheard)
    return Signals(frozenset(identifiers_of(text)), frozenset(map(_plain, NUMBER.findall(form))), frozenset(t for t in terms if len(t) >= 2))


def _asked(query: str) -> Signals:
    s = _signals(query, RELEASE_FORMS)
    names = frozenset(i for i in s.identifiers if len(i) <= IDENTIFIER_MAX and i not in GENERIC_ASCII)
    return Signals(names, s.numbers, s.terms - names - s.numbers - GENERIC_ASCII - STOPS)


@dataclass
class Candidate:
    chunk_id: int
    version_id: int
    page_no: int | None
    content: str
    score: float
    rank: int
    told: Signals = field(repr=False)
    titled: Signals = field(repr=False)

    def base(self, asked: Signals) -> float:
        return self.score + sum(BOOSTS[k] * share for k, share in self.titled.shares(asked).items())


def _seam(a: str, b: str) -> bool:
    """Is a long end of one text the start of the other."""
    least = ceil(max(OVERLAP, OVERLAP_SHARE * min(len(a), len(b))))
    if min(len(a), len(b)) < least:
        return False
    for x, y in ((a, b), (b, a)):
        at = x.find(y[:least], max(0, len(x) - len(y)))
        while at >= 0:
            if y.startswith(x[at:]):
                return True
            at = x.find(y[:least], at + 1)
    return False


@lru_cache(8192)
def _spaced(text: str) -> str:
    return " ".join(search_form(text).split())


def _span(a: str, b: str, least: int, share: float) -> bool:
    """Do two texts share a stretch of `least` characters and `share` of the shorter one."""
    a, b = sorted((_spaced(t) for t in (a, b)), key=len)
    k = max(least, -int(-len(a) * share // 1))
    step = k // 2  # a stretch of k holds one of k - step + 1 that begins at a multiple of step: few pairs share even such a one
    part = k - step + 1
    if not any(a[i : i + part] in b for i in range(0, len(a) - part + 1, step)):
        return False
    windows = {b[i : i + k] for i in range(len(b) - k + 1)}
    return any(a[i : i + k] in windows for i in range(len(a) - k + 1))


def _same_place(a: Candidate, b: Candidate) -> bool:
    return a.version_id == b.version_id and a.page_no == b.page_no and _seam(a.content, b.content)


def _same_fact(asked: Signals, a: Candidate, b: Candidate) -> bool:
    both = lambda kind: bool(getattr(asked, kind)) and getattr(asked, kind) <= getattr(a.told, kind) & getattr(b.told, kind)
    return len(asked.terms & a.told.terms & b.told.terms) >= CORE_TERMS and (both("identifiers") or both("numbers"))


def _repeats(a: Candidate, b: Candidate) -> bool:
    if a.version_id != b.version_id:
        return False
    return _span(a.content, b.content, SAME_PLACE_SPAN, SAME_PLACE_SHARE) if a.page_no is not None and a.page_no == b.page_no else _span(a.content, b.content, OTHER_PLACE_SPAN, OTHER_PLACE_SHARE)


def _merged(found: list[Candidate], asked: Signals, belongs: Callable[[list[Candidate], Candidate, Candidate], bool]) -> list[Candidate]:
    """The best of each group; a candidate joins the first group, by its members or its best, that it belongs to."""
    groups: list[tuple[list[Candidate], list[Candidate]]] = []
    for c in found:
        home = next((g for g in groups if belongs(g[0], g[1][0], c)), None)
        if home is None:
            groups.append(([c], [c]))
            continue
        home[0].append(c)
        worth = lambda x: (x.score >= SCORE_FLOOR, x.base(asked))
        if worth(c) > worth(home[1][0]):
            home[1][0] = c
    return [best[0] for _, best in groups]


def _eligible(asked: Signals, c: Candidate) -> bool:
    if c.score >= SCORE_FLOOR:
        return True
    if asked.identifiers:
        return asked.identifiers <= c.told.identifiers and asked.numbers <= c.told.numbers
    return c.rank <= TOP and not asked.numbers and len(asked.terms) >= CORE_TERMS and len(asked.terms & c.told.terms) >= CORE_TERMS


@lru_cache(WORDS)
def _anchor(token: str) -> str:
    return next((token[: -len(s)] for s in ANCHOR_SUFFIXES if token.endswith(s) and len(token) >= len(s) + 2), token)


@lru_cache(8)
def _named(query: str) -> frozenset[str]:
    """The anchors of a query, read once for its candidates."""
    return frozenset(a for t in TOKEN.findall(search_form(query)) if len(a := _anchor(t)) >= 2 and a not in GENERIC_TERMS and not a.isdigit())


# What one of each signal is worth, and the most that a candidate of a kind may get.
WORTH = {
    "asked phrase": 0.008, "term of the query": 0.003, "narrative": 0.010, "list": -0.018, "contact line": -0.025,
    "act": 0.004, "act and problem or result": 0.011, "act, problem and result": 0.020, "arc in the whole text": 0.015,
    "a number": 0.005, "three numbers": 0.010, "three numbers in the whole text": 0.008, "eight numbers in the whole text": 0.015,
    "tools of an act": 0.005, "share of anchors": 0.025, "report headings": 0.012, "profile data": -0.010,
}
MOST = {"stack": 0.010, "stack with profile data": 0.0, "mostly profile": -0.030, "guide": -0.018, "nothing asked": 0.0, "anchors missing": 0.015}


def _level(n: int, names: dict[int, str]) -> dict[str, float]:
    """The name of the highest step that n reaches."""
    reached = [names[k] for k in sorted(names) if n >= k]
    return {reached[-1]: 1.0} if reached else {}


def quality_signals(query: str, content: str) -> tuple[dict[str, float], set[str]]:
    """(how much there is of each signal of WORTH, the kinds of MOST that the candidate is of)."""
    chosen, form = best_window(query, content) or {}, search_form(content)
    part = search_form(chosen.get("snippet", content.strip()))
    named = _named(query)
    met = len(named & {_anchor(t) for t in TOKEN.findall(form)})
    tells = lambda text, words: any(w in text for w in words)
    act, profile = tells(part, ACTION), len(PROFILE.findall(form))
    much: dict[str, float] = {
        "asked phrase": chosen.get("exact", False),
        "term of the query": min(chosen.get("coverage", 0), 3),
        "narrative": chosen.get("narrative", False),
        "list": chosen.get("listed", False),
        "contact line": chosen.get("contact", False) and met <= 1,
        "arc in the whole text": all(tells(form, words) for words in (ACTION, PROBLEM, RESULT)),
        "tools of an act": act and len(set(TECHNICAL.findall(part))) >= 2,
        "share of anchors": met / len(named) if named else 0,
        "report headings": STRUCTURED.search(form) is not None,
        "profile data": 0 < profile and not (profile >= 3 and met <= 1),
    }
    if act:
        much |= _level(1 + tells(part, PROBLEM) + tells(part, RESULT), {1: "act", 2: "act and problem or result", 3: "act, problem and result"})
    much |= _level(len(APART_NUMBER.findall(part)), {1: "a number", 3: "three numbers"})
    much |= _level(len(APART_NUMBER.findall(form)), {3: "three numbers in the whole text", 8: "eight numbers in the whole text"})
    kinds = {
        "stack": STACK.search(form) is not None,
        "stack with profile data": STACK.search(form) is not None and much["profile data"],
        "mostly profile": profile >= 3 and met <= 1,
        "guide": len(content) < 320 and GUIDE.search(form) is not None,
        "nothing asked": not (much["term of the query"] or met or much["asked phrase"]),
        "anchors missing": bool(named) and (not met or len(named) >= 3 and much["share of anchors"] < 0.34),
    }
    return much, {k for k, holds in kinds.items() if holds}


def adjustment(query: str, content: str) -> float:
    """What the quality of a candidate as evidence adds to its score, between -0.035 and 0.065."""
    much, kinds = quality_signals(query, content)
    total = sum(WORTH[k] * n for k, n in much.items())
    return max(ADJUSTMENT_LOW, min(ADJUSTMENT_HIGH, total, *(MOST[k] for k in kinds)))


def select(query: str, rows: list[dict]) -> list[tuple[Candidate, float]]:
    """The at most five results of a query, each with its ranking score; rows are in the order of their rank."""
    asked = _asked(query)
    found = [Candidate(**{k: r[k] for k in ("chunk_id", "version_id", "page_no", "content", "score", "rank")}, told=_signals(r["content"], TOLD_RELEASE_FORMS), titled=_signals(f"{r['title']} {r['content']}", TOLD_RELEASE_FORMS)) for r in rows]
    places = _merged(found, asked, lambda members, best, c: any(_same_place(m, c) for m in members))
    facts = _merged([c for c in places if _eligible(asked, c)], asked, lambda members, best, c: _repeats(best, c) or any(_same_fact(asked, m, c) for m in members))
    ranked = [(c, c.base(asked) + adjustment(query, c.content)) for c in facts]
    return sorted(ranked, key=lambda x: (-x[1], -x[0].score))[:MAX_RESULTS]


def evidence_profile(candidates: DataFrame, queries: DataFrame | None = None, most: int | None = MAX_CANDIDATES) -> DataFrame:
    """(query_id, position, chunk_id, version_id, score, ranking_score) of candidates (query_id, query, chunk_id,
    version_id, page_no, title, content, score, rank); a query without eligible candidates has no row.

    page_no is null in texts without pages. A null query, title or content is empty. With `queries` (query_id, query)
    long query texts are not repeated by candidate. At most `most` candidates of a query are read; None reads all.
    """

    def run(key: tuple, group: pd.DataFrame, asked: pd.DataFrame | None = None) -> pd.DataFrame:
        if asked is not None:
            group = group.assign(query=asked["query"].iloc[0] if len(asked) else None)
        group = group.sort_values(["rank", "chunk_id"]).head(len(group) if most is None else most).astype(object)
        rows = group.where(group.notna(), None).to_dict("records")
        texts = [r | {k: r[k] or "" for k in ("title", "content")} for r in rows]
        out = select(rows[0]["query"] or "", texts) if rows else []
        return pd.DataFrame([(key[0], n, c.chunk_id, c.version_id, c.score, s) for n, (c, s) in enumerate(out, 1)], columns=["query_id", "position", "chunk_id", "version_id", "score", "ranking_score"])

    schema = f"query_id {dict(candidates.dtypes)['query_id']}, position long, chunk_id long, version_id long, score double, ranking_score double"
    groups = candidates.groupBy("query_id")
    if queries is None:
        return groups.applyInPandas(lambda key, group: run(key, group), schema)
    return groups.cogroup(queries.groupBy("query_id")).applyInPandas(lambda key, group, asked: run(key, group, asked), schema)
