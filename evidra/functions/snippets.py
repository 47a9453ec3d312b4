"""Sentences of a text with their places, windows of up to three, and the window that answers a query best.

Sentences are cut in runs of lines; a blank line ends a run, and a line that is a heading, a contact, a list of
technologies or the like stands alone and is never part of a window. Null texts have no sentences and no snippet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from .korean import TOKEN, WORDS, search_form
from .slices import by_slices

# What a line that is no prose looks like, signal words, and the weights of a window's score.
ALONE = tuple(
    regex.compile(p.replace(r"\s", r"[ \t\n\v\f\r]"))
    for p in (
        r"(?i)(?:[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.[a-z]{2,}|(?:https?://|www\.|github\.com/)\S+|(?:\+?82[- .]?)?0(?:10|2|[3-6][1-5])[- .]?[0-9]{3,4}[- .]?[0-9]{4}|\s*(?:contact|email|phone|github|education|gpa|name|school|major|status)\b|\s*gpa\s*[: ]?\s*[0-9](?:\.[0-9]+)?\s*/\s*[0-9](?:\.[0-9]+)?|.*(?:19|20)[0-9]{2}[./-]?(?:0?[1-9]|1[0-2])?\s*(?:졸업\s*)?예정\s*$).*",
        r"(?i).*(?:포트폴리오|문서)(?:에서|에)\s+.*(?:요약|소개|정리)(?:했|합니).*",
        r"[가-힣]{2,4}",
        r"(?i)(?:backend|frontend|database|realtime|security|infra|기술 스택|담당 범위)",
        r"[\p{L}\p{N}+#._-]+(?:\s*[|/,·]\s*[\p{L}\p{N}+#._-]+)+",
        r"[^.!?。！？\r\n]{1,80}:\s*[^.!?。！？\r\n]{1,100}",
    )
)
HEADINGS = tuple(
    regex.compile(p)
    for p in (
        r"(?:[0-9]{1,2}(?:\.[0-9]{1,2})+|[0-9]{1,2}[.)]?)[ \t]+.+",
        r"(?i).{0,160}(?:이력서|포트폴리오|resume|portfolio).{0,80}",
        r"(?i)(?:검증 가능한 )?(?:핵심 )?(?:경험|개요|요약|목차|기술 스택|문제 해결 사례|테스트 결과|성능 측정 결과|검증 결과)",
        r"(?i).{0,100}[ \t]+[0-9]{1,3}[ \t]*/[ \t]*[0-9]{1,3}",
    )
)
SEPARATOR = regex.compile(r"[|/·]|(?<![0-9]),(?![0-9])")
EVIDENCE = regex.compile(r"구현|개선|결과|성공|차단|방지|저장|갱신|감소|단축|복구|배포|적용")
CONTACT = regex.compile(r"(?i)[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.[a-z]{2,}|(?:https?://|www\.|github\.com/)\S+|(?:contact|email|phone|github|education|gpa)\b")
NUMBER = regex.compile(r"(?<![\p{L}\p{N}])[0-9]+(?:[.,][0-9]+)?")
TERMINAL = tuple(".!?。！？")
GENERIC = frozenset("experience evidence find show 경력 경험 근거 검색 관련 활용 보여줘 찾아줘 있나요 했나요 인가요".split())
QUERY_SUFFIXES = "했나요 했는지 했어 인가요 있나요 주세요 나요 에서 으로 했던 하는 되는 했다 한다 하게 해 한 을 를 이 가 은 는 과 와 의 에 로".split()
SIGNALS = {
    "action": "구현 개선 설계 적용 해결 통합 운영 검증 도입 배포 직접 분리 전환 최적화 처리 구성 갱신 저장 차단 제어 직렬화 수행 실행 거절 격리 줄었 막 만들 결합 제한".split(),
    "problem": "문제 장애 실패 병목 충돌 중복 지연 불일치 누락 위험 급증 빠지는 재실행 덮어쓰 오류 손상 격리 깨진 거듭 unique".split(),
    "result": "감소 단축 향상 개선 방지 유지 성공 완료 절감 안정 해결 전환 갱신 줄였 낮췄 높였 제거 완화 차단 보냈 반영 들어가지 복구 거절 줄었 막 0건 적용됐 배포했".split() + ["들어갈 수 없", "실행하지 않"],
    "state": "생산 production 운영 배포 출시 실제 적용됐 사용되 현재".split(),
    "detail": "반영 보정 병합 결합 제한 분리 이동 대기열 checkpoint 체크포인트 상한 직렬화 재시도 보냈 전환 격리".split(),
    "actor": "본인 직접 담당 수행 구현했 만들었 적용했 배포했".split(),
    "metric": "p95 p99 응답 시간 지연 비용 처리량 메모리 rss 누락률 정확도 건 회 퍼센트 초 분 밀리초 기가바이트 gb".split(),
}
ASKS_ACTION, ASKS_PROBLEM, ASKS_STATE = ["했나", "어떻게"], "문제 장애 해결 대응".split(), "생산 production 운영 배포 출시 적용 사용".split()
IMPLIED = {"거절": "실행하지 않", "줄였": "줄었"}
COMPONENTS = ("action", "problem", "result", "state", "actor", "metric")
MAX_SENTENCES = 3


@dataclass(frozen=True)
class Sentence:
    block: int
    start: int
    end: int
    text: str
    alone: bool


def stands_alone(line: str) -> bool:
    if any(p.fullmatch(line) for p in ALONE):
        return True
    if line.endswith(TERMINAL):
        return False
    listed = SEPARATOR.search(line) and len(line.split()) >= 2 and not EVIDENCE.search(line)
    return bool(listed) or any(p.fullmatch(line) for p in HEADINGS)


_LINE = regex.compile(r"[^\r\n]+|(?:\r\n|\r|\n)")
_PIECE = regex.compile(r"\S(?:.*?[.!?。！？](?=\s|$)|.*)", regex.S)


def sentences_of(text: str) -> list[Sentence]:
    out: list[Sentence] = []
    block, run = 0, None

    def flush() -> None:
        if run is not None:
            at = run[0]
            while (m := _PIECE.search(text, at, run[1])) is not None:
                # one mark alone is a sentence too: the lazy part then begins behind it
                end = m.start() + 1 if m[0][0] in TERMINAL and (m.start() + 1 == run[1] or text[m.start() + 1].isspace()) else m.end()
                piece = text[m.start() : end].rstrip()
                out.append(Sentence(block, m.start(), m.start() + len(piece), piece, stands_alone(piece)))
                at = end

    at = 0
    for raw in regex.split(r"(\r\n|\r|\n)", text):
        line = raw.strip()
        start = at + len(raw) - len(raw.lstrip())
        at += len(raw)
        if raw in ("\r\n", "\r", "\n"):
            continue
        if line and not stands_alone(line):
            run = (run[0] if run else start, start + len(line))
            continue
        flush()
        run = None
        if line:
            out.append(Sentence(block, start, start + len(line), line, True))
        block += 1 if line or at < len(text) else 0
    flush()
    return out


def windows_of(sentences: list[Sentence], most: int = MAX_SENTENCES) -> Iterator[tuple[int, int]]:
    """(first, last) of neighbouring sentences of one block."""
    for i, s in enumerate(sentences):
        for j in range(i, min(i + most, len(sentences))):
            if sentences[j].alone or sentences[j].block != s.block:
                break
            yield i, j


def _form(text: str) -> str:
    return search_form(text).replace("카카오", "kakao").replace(",", "")


def _numbers(text: str) -> set[str]:
    return {n.replace(",", "") for n in NUMBER.findall(text)}


def _has(form: str, words: list[str]) -> bool:
    return any(w in form for w in words)


@lru_cache(WORDS)
def _asked_word(word: str) -> str:
    return next((word[: -len(s)] for s in QUERY_SUFFIXES if word.endswith(s) and len(word) > len(s) + 1), word)


class Question:
    """What a query asks for."""

    def __init__(self, query: str) -> None:
        self.form = _form(query)
        stems = map(_asked_word, TOKEN.findall(self.form))
        self.ordered = list(dict.fromkeys(t for t in stems if len(t) > 1 and t not in GENERIC))
        self.terms = list(dict.fromkeys(self.ordered + [w for k, w in IMPLIED.items() if k in self.form]))
        self.pairs = [(a, b, f"{a} {b}") for a, b in zip(self.ordered, self.ordered[1:])]
        self.numbers = _numbers(query)
        self.action = _has(self.form, SIGNALS["action"] + ASKS_ACTION)
        self.problem = _has(self.form, SIGNALS["problem"] + ASKS_PROBLEM)
        self.state = _has(self.form, ASKS_STATE)
        self.metric = _has(self.form, SIGNALS["metric"])

    def score(self, text: str, first: str, n: int) -> dict:
        form = _form(text)
        s = {k: _has(form, words) for k, words in SIGNALS.items()}
        s["metric"] |= NUMBER.search(form) is not None
        met = [t for t in self.terms if t in form]
        numeric = len(self.numbers & _numbers(text))
        all_numbers = numeric == len(self.numbers)
        known = set(met)
        phrase = sum(p in form for a, b, p in self.pairs if a in known and b in known)
        exact = len(self.form) >= 4 and bool(self.form.strip()) and self.form in form
        listed = sum(text.count(c) for c in "/|·") >= 2 and len(TOKEN.findall(form)) >= 3 and not s["action"]
        contact = CONTACT.search(text) is not None
        complete = bool(met) and (not self.action or s["action"]) and (not self.problem or s["problem"] and s["result"]) and (not self.state or s["state"]) and all_numbers
        parts = sum(s[k] for k in COMPONENTS)
        leads = _has(_form(first), self.terms)
        points = (
            (len(met), 10_000), (sum(map(len, met)), 20), (numeric, 5_000), (phrase, 2_000), (exact, 100_000),
            (self.action and s["action"], 2_000), (self.problem and s["problem"], 1_500), (self.problem and s["result"], 1_800), (self.problem and s["detail"], 1_600),
            (self.state and s["state"], 2_500), (bool(self.numbers) and all_numbers, 4_000), (s["action"] and s["result"], 1_200), (s["action"] and s["state"], 1_300),
            (s["actor"] and s["action"], 1_200), (self.metric and s["metric"] and s["result"], 700), (complete and (self.action or self.problem), 4_000), (parts, 80),
            (n - 1, -1_000), (exact * (n - 1), -5_000), (n > 1 and not leads, -3_000), (listed, -3_000), (contact, -1_000_000),
        )
        return {"score": sum(int(a) * w for a, w in points), "coverage": len(met), "parts": parts, "numeric": numeric, "exact": exact, "complete": complete, "listed": listed, "contact": contact, "narrative": s["action"] or s["problem"] or s["result"], "phrase": phrase, "grounded": bool(complete and met and s["action"] and s["result"] or s["metric"] and (s["action"] or s["problem"] or s["result"]))}


@lru_cache(8)
def _question(query: str) -> Question:
    """Read once for the texts that are held against it in turn."""
    return Question(query)


def best_window(query: str, text: str) -> dict | None:
    """The best window and its signals: most points, then coverage, parts, numbers met, then the shorter, then the earlier."""
    found = sentences_of(text)
    question = _question(query)
    best = None
    for i, j in windows_of(found):
        part = text[found[i].start : found[j].end]
        s = question.score(part, found[i].text, j - i + 1)
        rank = (s["score"], s["coverage"], s["parts"], s["numeric"], i - j, -i)
        if best is None or rank > best[0]:
            best = rank, {"snippet": part, "first": i, "last": j, **s}
    return best[1] if best else None


def snippet_of(query: str | None, text: str | None) -> dict | None:
    """The best window; without one the whole text, trimmed, with a score of 0; a blank text has none."""
    text = text or ""
    best = best_window(query or "", text)
    if best:
        return {k: best[k] for k in ("snippet", "first", "last", "score", "coverage", "complete")}
    return {"snippet": text.strip(), "first": -1, "last": -1, "score": 0, "coverage": 0, "complete": False} if text.strip() else None


_SENTENCE = StructType().add("block", LongType()).add("start", LongType()).add("end", LongType()).add("text", StringType()).add("alone", BooleanType())
_SNIPPET = StructType().add("snippet", StringType()).add("first", LongType()).add("last", LongType()).add("score", LongType()).add("coverage", LongType()).add("complete", BooleanType())


sentences = by_slices(lambda t: [vars(s) for s in sentences_of(t)], ArrayType(_SENTENCE))


_WINDOW = StructType().add("first", LongType()).add("last", LongType()).add("block", LongType()).add("start", LongType()).add("end", LongType()).add("text", StringType()).add("first_sentence", StringType()).add("last_sentence", StringType())
_WINDOWED = StructType().add("n", LongType()).add("n_prose", LongType()).add("n_blocks", LongType()).add("longest", LongType()).add("windows", ArrayType(_WINDOW))


def windowed_of(text: str) -> dict:
    """How many sentences a text has, how many are prose, in how many blocks, the longest of them; and all windows."""
    found = sentences_of(text)
    prose = [s for s in found if not s.alone]
    row = lambda i, a, j, b: {"first": i, "last": j, "block": a.block, "start": a.start, "end": b.end, "text": text[a.start : b.end], "first_sentence": a.text, "last_sentence": b.text}
    rows = [row(i, found[i], j, found[j]) for i, j in windows_of(found)]
    return {"n": len(found), "n_prose": len(prose), "n_blocks": len({s.block for s in prose}), "longest": max((s.end - s.start for s in prose), default=None), "windows": rows}


windowed = by_slices(windowed_of, _WINDOWED)


@F.pandas_udf(_SNIPPET)
def snippet(query: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [snippet_of(q, t) or {} for q, t in zip(query, text)]
    return pd.DataFrame([[r.get(f.name) for f in _SNIPPET] for r in rows], columns=[f.name for f in _SNIPPET], dtype=object)
