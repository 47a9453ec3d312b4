"""Typed values in text: dates, quantities, numbered identifiers and literal identifiers.

A query is read for constraints, a document for observations. Both are an ordered list of rules, each a pattern and
a reader; what one rule has taken of the text is closed to the later ones. All parts of a reading are strings.
"""

from __future__ import annotations

import calendar
import datetime as dt
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal

import regex
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .slices import by_slices

# The grammar of dates, numbers, units and comparisons, and the words that bound a qualifier.
BEFORE_NUMBER = r"(?<![\p{L}\p{N}_,，.])"
NUMBER = r"(?:\p{Nd}{1,3}(?:[,，]\p{Nd}{3})+|\p{Nd}+)(?:\.\p{Nd}+)?"
TIME_UNIT = r"(?:milliseconds?|minutes?|seconds?|months?|hours?|years?|days?|secs?|mins?|hrs?|sec|min|hr|ms)"
UNIT = r"(?:milliseconds?|minutes?|seconds?|months?|hours?|years?|days?|secs?|mins?|hrs?|sec|min|hr|ms|s|개월|시간|명|건|개|회|년|분|초|일|%)"
AFTER_UNIT = r"(?:(?![\p{L}\p{N}_])|(?=(?:의|이|가|은|는|을|를|에|로|와|과|도|만|였|인|이상|초과|이하|미만|감소|증가)(?:\s|$|\p{L}))|(?=decreas|reduc|increas))"
DATE = r"(?:\p{Nd}{4}[-./]\p{Nd}{1,2}[-./]\p{Nd}{1,2}|\p{Nd}{4}\s*년(?:\s*\p{Nd}{1,2}\s*월)?|\p{Nd}{4}[-./]\p{Nd}{1,2})"
ENGLISH_DIRECTION = r"(?:decreas(?:e|ed|es|ing)|reduc(?:e|ed|es|ing|tion)|increas(?:e|ed|es|ing))"
COMPARATOR = r"(?:no\s+more\s+than|on\s+or\s+above|at\s+least|more\s+than|at\s+most|less\s+than|exactly|over|under)"
LASTING = r"(?:last(?:s|ed|ing)?|continu(?:e|es|ed|ing)|run|runs|ran|running)"
ENGLISH_WORD = r"\p{L}[\p{L}\p{N}_-]*"
NOUN_PHRASE = rf"{ENGLISH_WORD}(?:\s+{ENGLISH_WORD}){{0,5}}?"
VERSION = r"\p{Nd}+(?:\.\p{Nd}+){0,3}"
NAME = r"[A-Za-z][A-Za-z+_-]{0,31}"
WORD = regex.compile(r"[\p{L}\p{N}]+(?:[-_.][\p{L}\p{N}]+)*")
DIRECTION = regex.compile(rf"(?i)감소|증가|{ENGLISH_DIRECTION}")
ADNOMINAL = "된 하는 한 할 했던 되는 될 같은".split()
LEFT_SKIP = frozenset("of on at in from was were is are exactly precisely 정확히 뒤 후".split())
DETERMINERS = frozenset("a an the".split())
RIGHT_STOP = frozenset("in on at from to before after and or was were is are decrease decreased decreases decreasing increase increased increases increasing 감소 증가".split())
SURE_PARTICLES = "으로 은 는 이 가 을 를 로 와 과".split()
BOUNDARY_PARTICLES = "으로부터 에게서 에서는 에서 에게 으로 에 로".split()
STOPPING_PARTICLES = frozenset("으로부터 에게서 에서는 에서 에게 으로 은 는 이 가 을 를 에 로".split())
OBJECT_PARTICLES, CASE_PARTICLES = frozenset("을 를".split()), frozenset("을 를 이 가 은 는".split())
CLAUSE_ENDS = r"[\n\r.!?;:]"
DURATIONS = frozenset("millisecond milliseconds ms second seconds sec secs s minute minutes min mins hour hours hr hrs day days month months year years 개월 시간 년 분 초 일".split())
OPERATORS = {"at least": "GTE", "on or above": "GTE", "more than": "GT", "over": "GT", "at most": "LTE", "no more than": "LTE", "less than": "LT", "under": "LT", "exactly": "EQ", "exceed": "GT", "exceeds": "GT", "exceeded": "GT", "exceeding": "GT"}
SUFFIX_OPERATORS = {"이상": "GTE", "초과": "GT", "이하": "LTE", "미만": "LT"}
DATE_OPERATORS = {"on or after": "GTE", "after": "GT", "before": "LT", "이후": "GTE", "부터": "GTE", "이전": "LT"}
RIEUL = 8  # the final consonant after which 로 follows as after a vowel


@dataclass(frozen=True)
class Reading:
    kind: str  # DATE, QUANTITY, IDENTIFIER_NUMBER, LITERAL
    start: int
    end: int
    op: str = "EQ"
    low: str | None = None  # first day, number, or dotted version
    high: str | None = None  # last day, or the upper number of a range
    unit: str | None = None  # of a date: its precision
    name: str | None = None
    qualifier: str = ""
    direction: str = "NONE"


TAKE = object()  # the reader of a match that is no value but closes its text to the later rules
Reader = Callable[[str, "regex.Match"], object]
Rule = tuple  # (pattern, reader), and what a text must hold for the pattern to match at all, where that is found much sooner


def _p(pattern: str, flags: str = "(?i)") -> regex.Pattern:
    return regex.compile(flags + pattern.replace(r"\s", r"[ \t\n\v\f\r]"))


def _norm(s: str) -> str:
    return unicodedata.normalize("NFKC", s).lower().strip()


def _number(s: str) -> str:
    return format(Decimal(_norm(s).replace(",", "")).normalize(), "f")


def _days(atom: str) -> tuple[dt.date, dt.date, str] | None:
    parts = [int(x) for x in regex.findall("[0-9]+", _norm(atom))]
    try:
        if len(parts) == 3:
            return dt.date(*parts), dt.date(*parts), "FULL_DATE"
        if len(parts) == 2:
            return dt.date(*parts, 1), dt.date(*parts, calendar.monthrange(*parts)[1]), "YEAR_MONTH"
        return dt.date(parts[0], 1, 1), dt.date(parts[0], 12, 31), "YEAR"
    except (ValueError, IndexError):
        return None


_LAST_END, _NEXT_END, _GENITIVE = (regex.compile(p) for p in ("(?r)" + CLAUSE_ENDS, CLAUSE_ENDS, r"\s*의"))

# Qualifiers: the words beside a value that say what it measures


@dataclass(frozen=True)
class _Word:
    text: str
    particle: str


def _ends_like_modifier(word: str) -> bool:
    return word.endswith(tuple(ADNOMINAL))


def _attaches(stem: str, particle: str) -> bool:
    """May the particle follow the stem's last sound; any may after a letter that is no Hangul syllable."""
    last = ord(stem[-1])
    if not 0xAC00 <= last <= 0xD7A3:
        return stem[-1].isalnum()
    final = (last - 0xAC00) % 28
    if particle in ("으로", "로"):
        return (final not in (0, RIEUL)) == (particle == "으로")
    return (final != 0) == (particle in ("은", "이", "을", "과"))


def _word(raw: str) -> _Word:
    if not _ends_like_modifier(_norm(raw)):
        for p in SURE_PARTICLES:
            if raw.endswith(p) and len(raw) > len(p) and _attaches(raw[: -len(p)], p):
                return _Word(_norm(raw[: -len(p)]), p)
        for p in BOUNDARY_PARTICLES:
            if raw.endswith(p) and len(raw) > len(p):
                return _Word(_norm(raw), p)
    return _Word(_norm(raw), "")


def _words(text: str, start: int, end: int) -> list[_Word]:
    return [w for m in WORD.finditer(text, start, end) if (w := _word(m[0])).text]


def _clause(text: str, start: int, end: int) -> tuple[int, int]:
    before, after = _LAST_END.search(text, 0, start), _NEXT_END.search(text, end)
    return before.end() if before else 0, after.start() if after else len(text)


def _owned(text: str, end: int) -> bool:
    """Does a genitive follow."""
    return _GENITIVE.match(text, end) is not None


def _script(word: str) -> str:
    latin = any(c.isalpha() and ord(c) <= 0x24F for c in word)
    hangul = any("가" <= c <= "힣" for c in word)
    return "BOTH" if latin == hangul else "LATIN" if latin else "HANGUL"


def _left(text: str, at: int, most: int, one_script: bool = False) -> str:
    words = _words(text, _clause(text, at, at)[0], at)
    kept: list[str] = []
    while words and len(kept) < most:
        w = words.pop()
        if w.text in LEFT_SKIP and not kept:
            continue
        if w.text in LEFT_SKIP or w.text in DETERMINERS:
            break
        if kept and (w.particle in STOPPING_PARTICLES or _ends_like_modifier(w.text)):
            break
        if one_script and kept:
            ahead = words[-1] if len(kept) == 2 and words else None
            if ahead and (ahead.particle in OBJECT_PARTICLES or ahead.text == "같은") or _script(w.text) != _script(kept[0]):
                break
        kept.append(w.text)
    return " ".join(reversed(kept))


def _right(text: str, at: int, most: int) -> str:
    kept: list[str] = []
    for w in _words(text, at, _clause(text, at, at)[1]):
        if w.text == "의" and not kept:
            continue
        if w.text in RIGHT_STOP:
            break
        kept.append(w.text)
        if len(kept) == most or w.particle in CASE_PARTICLES:
            break
    return " ".join(kept)


def _inside(m: regex.Match, most: int = 6) -> str:
    words = [w.text for w in _words(m.string, *m.span("what"))]
    while words and words[0] in DETERMINERS:
        words.pop(0)
    return " ".join(words) if len(words) <= most else ""


def _way(s: str) -> str:
    return "INCREASE" if _norm(s).startswith(("increas", "증가")) else "DECREASE"


def _direction(text: str, start: int, end: int) -> str:
    """The direction that the clause names; none if it names both."""
    ways = {_way(m[0]) for m in DIRECTION.finditer(text, *_clause(text, start, end))}
    return ways.pop() if len(ways) == 1 else "NONE"


def _measured(text: str, start: int, end: int, unit: str, direction: str) -> str:
    if _owned(text, end):
        return _right(text, end, 3)
    if unit == "%" and direction == "NONE" and (right := _right(text, end, 3)):
        return right
    return _left(text, start, 3 if unit == "%" or unit in DURATIONS else 4, one_script=True)


# Readers


def _interval(text: str, m: regex.Match) -> object:
    a, b = (_days(m[g]) for g in ("first", "last"))
    if a is None or b is None or a[2] != b[2] or b[1] < a[0]:
        return TAKE
    return Reading("DATE", *m.span(), "RANGE", a[0].isoformat(), b[1].isoformat(), a[2], qualifier=_left(text, m.start(), 8))


def _date(text: str, m: regex.Match) -> object:
    days = _days(m["date"])
    if days is None:
        return TAKE
    op = DATE_OPERATORS[regex.sub(r"\s+", " ", _norm(m["op"]))] if "op" in m.groupdict() else "EQ"
    return Reading("DATE", *m.span(), op, days[0].isoformat(), days[1].isoformat(), days[2], qualifier=_left(text, m.start(), 8))


def _compared(m: regex.Match) -> str | None:
    """The operator before or after a number; None if they disagree."""
    said = m.groupdict()
    found = {t[regex.sub(r"\s+", " ", _norm(said[g]))] for g, t in (("before", OPERATORS), ("after", SUFFIX_OPERATORS)) if said.get(g)}
    return None if len(found) > 1 else found.pop() if found else "EQ"


def _by_percent(first: str, last: str) -> Reader:
    """A change by so many per cent, whose span goes from one group to the other."""

    def read(text: str, m: regex.Match) -> object:
        said = m.groupdict()
        what = _inside(m) if "what" in said else _left(text, m.start("way"), 4)
        op = _compared(m)
        start = m.start("before") if said.get("before") else m.start(first)
        return Reading("QUANTITY", start, m.end(last), op, _number(m["n"]), None, "%", qualifier=what, direction=_way(m["way"])) if what and op else None

    return read


def _lasting(text: str, m: regex.Match) -> object:
    """How long something lasts: a range, or one value."""
    said, what = m.groupdict(), _left(text, m.start("verb"), 4)
    if not what:
        return None
    unit = _norm(m["unit"])
    if "high" not in said:
        return Reading("QUANTITY", m.start("n"), m.end("unit"), "EQ", _number(m["n"]), None, unit, qualifier=what)
    low, high = _number(m["low"]), _number(m["high"])
    return Reading("QUANTITY", *m.span("range"), "RANGE", low, high, unit, qualifier=what) if Decimal(low) <= Decimal(high) else None


def _quantity_range(text: str, m: regex.Match) -> object:
    low, high = _number(m["low"]), _number(m["high"])
    if Decimal(high) < Decimal(low):
        return TAKE
    what = _right(text, m.end(), 3) if _owned(text, m.end()) else _left(text, m.start(), 3, one_script=True)
    return Reading("QUANTITY", *m.span(), "RANGE", low, high, _norm(m["unit"]), qualifier=what)


def _quantity(text: str, m: regex.Match) -> object:
    op = _compared(m)
    if op is None:
        return TAKE
    unit, way = _norm(m["unit"]), _direction(text, *m.span())
    return Reading("QUANTITY", *m.span(), op, _number(m["n"]), None, unit, qualifier=_measured(text, *m.span(), unit, way), direction=way)


_NAME_BEFORE = regex.compile(rf"({NAME})(?:[ \t\n\v\f\r]+|/)$")


def _count(text: str, m: regex.Match) -> object:
    said, what, op = m.groupdict(), _inside(m), _compared(m)
    before = None if "before" in said else _NAME_BEFORE.search(text[max(0, m.start("n") - 200) : m.start("n")])
    if not what or op is None or before and _names(before[1]):
        return None
    return Reading("QUANTITY", m.start("before") if "before" in said else m.start("n"), m.end("n"), op, _number(m["n"]), None, "count", qualifier=what)


def _names(identifier: str) -> bool:
    return identifier.lower() == "v" or any(c.isupper() for c in identifier)


def _versioned(text: str, m: regex.Match) -> object:
    if not _names(m["name"]):
        return None
    return Reading("IDENTIFIER_NUMBER", *m.span(), low=".".join(str(int(x)) for x in _norm(m["n"]).split(".")), name=_norm(m["name"]))


def _literal(s: str) -> str:
    return regex.sub(r"[\s._-]+", "", _norm(s))


def _quoted(text: str, m: regex.Match) -> object:
    group = next(g for g in (1, 2, 3) if m[g] is not None)
    return Reading("LITERAL", *m.span(group), name=_literal(m[group])) if _literal(m[group]) else None


def _bare(text: str, m: regex.Match) -> object:
    upper = [c.isupper() for c in m[0]]
    linked = any(c in "-_." for c in m[0]) and any(upper)
    if sum(upper) < 2 and not any(upper[1:]) and not any(c.isdigit() for c in m[0]) and not linked:
        return None
    return Reading("LITERAL", *m.span(), name=_literal(m[0]))


def _closed(text: str, m: regex.Match) -> object:
    return TAKE


_SCALES = (_p(rf"(?<![\p{{L}}\p{{N}}_]){NUMBER}\s*[kmb](?![\p{{L}}\p{{N}}_])"), _closed)
_INTERVALS = (
    (_p(rf"(?P<first>{DATE})\s*부터\s*(?P<last>{DATE})\s*까지"), _interval),
    (_p(rf"from\s+(?P<first>{DATE})\s+to\s+(?P<last>{DATE})"), _interval),
    (_p(r"(?<!\p{Nd})(?P<first>\p{Nd}{4})\s*[~〜–—]\s*(?P<last>\p{Nd}{4})(?!\p{Nd})"), _interval),
)
_PLAIN_DATE = (_p(rf"(?P<date>{DATE})"), _date)
_RANGE = rf"{BEFORE_NUMBER}(?P<low>{NUMBER})\s*[~〜–—]\s*(?P<high>{NUMBER})\s*(?P<unit>{UNIT}){AFTER_UNIT}"
_PLAIN = rf"{BEFORE_NUMBER}(?P<n>{NUMBER})\s*(?P<unit>{UNIT}){AFTER_UNIT}"
_PERCENT = rf"{BEFORE_NUMBER}(?P<n>{NUMBER})\s*(?P<unit>%)"
_NO_UNIT = rf"{BEFORE_NUMBER}(?P<n>{NUMBER})(?!\s*(?:{UNIT}){AFTER_UNIT})\s+(?P<what>{NOUN_PHRASE})"
_APART, _APART_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_NAMES = (
    # no shorter name is followed by a space or a stroke, so the name is possessive
    (_p(rf"(?<![A-Za-z0-9_])(?P<name>{NAME}+)(?:\s+|/)(?P<n>{VERSION})(?![A-Za-z0-9_])", ""), _versioned, _p(r"\p{Nd}(?<=[A-Za-z+_-](?:\s+|/)\p{Nd})", "")),
    (_p(rf"(?<![A-Za-z0-9_])(?P<name>[vV])(?P<n>{VERSION})(?![A-Za-z0-9_])", ""), _versioned),
    (_p(r"\"([^\"\r\n]+)\"|'([^'\r\n]+)'|“([^”\r\n]+)”", ""), _quoted),
    # only words that _bare may take: with a capital or a digit after the first letter, or a capital and a joint
    (_p(r"(?<![A-Za-z0-9_])(?=[A-Za-z][a-z]*+(?:[-_.][a-z]++)*+[-_.]?[A-Z0-9]|[A-Z][a-z]*+[-_.])[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)*(?![A-Za-z0-9_])", ""), _bare),
)
QUERY_RULES = (
    _SCALES,
    *_INTERVALS,
    (_p(rf"(?P<op>on\s+or\s+after|after|before)\s+(?P<date>{DATE})"), _date, _p(r"\p{Nd}{4}(?<=(?:after|before)\s+\p{Nd}{4})")),
    (_p(rf"(?P<date>{DATE})\s*(?P<op>이후|부터|이전)"), _date),
    _PLAIN_DATE,
    (_p(rf"{_APART}(?P<way>{ENGLISH_DIRECTION})\s+(?:the\s+|an?\s+)?(?P<what>{NOUN_PHRASE})\s+by\s+(?:(?P<before>{COMPARATOR})\s+)?{_PERCENT}{_APART_AFTER}"), _by_percent("n", "unit"), _p("%", "")),
    (_p(rf"{_PERCENT}\s+(?P<way>{ENGLISH_DIRECTION})\s+(?:in|of)\s+(?:the\s+|an?\s+)?(?P<what>{NOUN_PHRASE})(?=\s*[?.,!;]|$)"), _by_percent("n", "way")),
    (_p(rf"{_APART}(?P<verb>{LASTING})\s+(?P<range>between\s+(?P<low>{NUMBER})\s+and\s+(?P<high>{NUMBER})\s*(?P<unit>{TIME_UNIT})){AFTER_UNIT}"), _lasting),
    (_p(_RANGE), _quantity_range),
    (_p(rf"(?:(?P<before>{COMPARATOR})\s+)?{_PLAIN}(?:\s*(?P<after>이상|초과|이하|미만))?(?:\s*(?:감소|증가|{ENGLISH_DIRECTION}))?"), _quantity, _p(rf"\p{{Nd}}\s*{UNIT}{AFTER_UNIT}")),
    (_p(rf"{_APART}(?P<before>{COMPARATOR}|exceed(?:s|ed|ing)?)\s+{_NO_UNIT}(?=\s*[?.,!;]|$)"), _count, _p(r"\p{Nd}(?<=(?:than|above|least|most|exactly|over|under|exceed(?:s|ed|ing)?)\s+\p{Nd})")),
    *_NAMES,
)
DOCUMENT_RULES = (
    _SCALES,
    *_INTERVALS,
    _PLAIN_DATE,
    (_p(_RANGE), _closed),  # a range of quantities is no single value
    (_p(rf"{_APART}(?P<way>{ENGLISH_DIRECTION})\s+by\s+{_PERCENT}{_APART_AFTER}"), _by_percent("n", "unit"), _p("%", "")),
    (_p(rf"{_APART}(?P<verb>{LASTING})\s+for\s+{BEFORE_NUMBER}(?P<n>{NUMBER})\s*(?P<unit>{TIME_UNIT}){AFTER_UNIT}"), _lasting),
    (_p(_PLAIN), _quantity),
    (_p(rf"{_NO_UNIT}(?=\s+(?:in|on|at|after|before|during|when|while|from|to|and|or|with|for|as)\b|\s*[?.,!;]|$)"), _count),
    *_NAMES,
)


def read(text: str, rules: Iterable[Rule]) -> list[Reading]:
    """What the rules find, in the order of the text."""
    taken, out = bytearray(len(text)), []
    for pattern, reader, *needs in rules:
        if needs and not needs[0].search(text):
            continue
        for m in pattern.finditer(text):
            value = reader(text, m) if 1 not in taken[m.start() : m.end()] or reader is _quoted else None
            if value is None:
                continue
            i, j = (value.start, value.end) if reader is _quoted else m.span()
            if 1 in taken[i:j]:
                continue
            taken[i:j] = b"\1" * (j - i)
            if value is not TAKE:
                out.append(value)
    return sorted(out, key=lambda r: r.start)


def _column(rules: tuple) -> Callable:
    kind = StructType()
    for name in Reading.__dataclass_fields__:
        kind = kind.add(name, LongType() if name in ("start", "end") else StringType())

    return by_slices(lambda t: [vars(r) for r in read(t, rules)], ArrayType(kind))


constraints, observations = _column(QUERY_RULES), _column(DOCUMENT_RULES)
