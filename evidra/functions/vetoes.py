"""Does a candidate speak against a query, or assert what it asks: two policies as column expressions.

Both work on normalised text (`unicode.normalized`, white space made one blank); texts are cut into sentences, and a
policy is a list of (reason, condition) over these, in the order in which a reason counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of names and numbers, denial, plans, currentness and finished acts.
NAME = r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.#-]{1,}(?![A-Za-z0-9])"
NUMBER = r"(?<![0-9])([0-9]+(?:[.,][0-9]+)?)(%|밀리초|ms|초|분|시간|개|건|명|회)"
DENIED_ACT = r"(?:구현|도입|채택|배포|운영|사용|시작|완료|연결|경험|기록|근거|이전).{0,16}(?:않|없)"
ENDED = r"폐기했|폐기된|제거했|제거된|중단했|중단된|retired|deprecated|현재.{0,20}(?:포함되지|사용하지)|더 이상.{0,20}사용하지"
DONE = r"(?:구현|도입|채택|배포|운영|출시|전환|처리|사용|완료|달성|조정)(?:했|하였|됐다|되었|하고|하여|해|한)|이전했다|이전을 완료했|migration을 수행했"
ASSERTED = r"(?:구현|도입|배포|운영|출시|전환|처리|사용|완료|달성|조정)(?:했|하였|됐다|되었|하고|하여|해|한)|이전했다|이전을 완료했|이전 완료|migration을 수행했|migration 수행했"
PROTOTYPE_USE = r"(?:고객|운영|production|현재).{0,24}(?:연결하지|포함되지|사용하지)"
NOW = r"현재|production|승격"
ASKS_NOW = r"현재|운영|production|출시 제품|현행"
ASKS_SERVICE = r"현재|운영 서비스|production|출시 제품|현행"
PLANNED = r"계획|예정|검토|논의|제안|단계|시작하지"
DENIED = r"않|없다|없으며|없고|못|미구현|미채택"
OUTDATED = r"폐기|제거|중단|prototype|프로토타입|retired|deprecated|더 이상 사용하지"


def names(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NAME})"), 1), F.lower)
    return F.array_distinct(F.filter(found, lambda x: x != "api"))


def numbers(text: Column) -> Column:
    """Numbers with their units, as text."""
    whole = F.regexp_extract_all(text, F.lit(f"((?:{NUMBER}))"), 1)
    return F.array_distinct(F.transform(whole, lambda x: F.replace(x, F.lit(","), F.lit("."))))


def flat(normalized: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(normalized, F.lit("")), r"\s+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def _joined(s: Column, step: int) -> Column:
    """Each sentence with the one after (1) or before (-1) it."""
    at = F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))
    pair = lambda i: F.concat_ws(" ", *([F.get(s, i), F.get(s, i + 1)] if step > 0 else [F.get(s, i - 1), F.get(s, i)]))
    return F.filter(F.transform(at, pair), lambda x: x != "")


def _holds(text: Column, wanted: Column) -> Column:
    return F.forall(wanted, lambda n: F.contains(text, n))


def veto(query: Column, query_form: Column, content_form: Column) -> Column:
    """DENIED_NUMBER, DENIED_ACT, NOT_CURRENT or ONLY_PROTOTYPE where a candidate speaks against the query, else PASS_THROUGH.

    query is as it was asked; the forms are normalised and flat. Texts without sentences pass.
    """
    asked, wanted, said = names(query), numbers(query_form), sentences(content_form)
    windows = _joined(said, 1)
    bound = F.filter(windows, lambda w: _holds(F.get(sentences(w), F.lit(0)), asked))
    where = F.when(F.size(bound) > 0, bound).otherwise(windows)
    lives_on = lambda w: w.rlike(DONE) & w.rlike(NOW)
    now = query_form.rlike(ASKS_NOW)
    rules = (
        ("DENIED_NUMBER", (F.size(wanted) > 0) & F.exists(where, lambda w: (F.size(F.array_except(wanted, numbers(w))) == 0) & w.rlike("않|없|부재"))),
        ("DENIED_ACT", F.exists(bound, lambda w: w.rlike(DENIED_ACT))),
        ("NOT_CURRENT", now & F.exists(bound, lambda w: w.rlike(ENDED) & ~lives_on(w))),
        ("ONLY_PROTOTYPE", now & F.exists(bound, lambda w: w.rlike("prototype|프로토타입") & w.rlike(PROTOTYPE_USE) & ~lives_on(w))),
    )
    return reduce(lambda rest, r: F.when(r[1], r[0]).otherwise(rest), reversed(rules), F.lit("PASS_THROUGH"))


def decision(query: Column, query_form: Column, content_form: Column) -> Column:
    """Whether a candidate asserts what is asked: an ACCEPT:... or REJECT:... with its reason."""
    asked, wanted, said = names(query), numbers(query_form), sentences(content_form)
    named = F.filter(said, lambda s: _holds(s, asked))
    # with numbers: the first stretch with all of them that is planned, denied or done decides
    counted = F.filter(_joined(said, -1), lambda w: _holds(w, asked) & (F.size(F.array_except(wanted, numbers(w))) == 0))
    verdicts = F.transform(counted, lambda w: F.when(w.rlike(PLANNED), "REJECT:NUMERIC_ASSERTION_NOT_COMPLETED").when(w.rlike(DENIED), "REJECT:NUMERIC_ASSERTION_NEGATED").when(w.rlike(ASSERTED), "ACCEPT:AFFIRMATIVE_NUMERIC_CLAIM"))
    by_number = F.coalesce(F.get(F.array_compact(verdicts), F.lit(0)), F.lit("REJECT:NUMERIC_VALUE_UNIT_OR_AFFIRMATION_MISSING"))
    now = query_form.rlike(ASKS_SERVICE)
    old = lambda s: s.rlike(OUTDATED) | s.rlike("현행") & s.rlike("없") | s.rlike("현재") & s.rlike("포함되지")
    told = F.exists(named, lambda s: s.rlike(ASSERTED) & ~s.rlike(PLANNED) & ~s.rlike(DENIED) & ~(now & old(s)))
    missing = (F.size(asked) > 0) & (F.size(named) == 0)
    plain = F.when(missing, "REJECT:TARGET_NOT_BOUND").when(told, "ACCEPT:AFFIRMATIVE_BOUND_CLAIM").when(now, "REJECT:CURRENTNESS_OR_POLARITY_NOT_SUPPORTED").otherwise("REJECT:AFFIRMATIVE_ACTION_NOT_SUPPORTED")
    return F.when(F.size(wanted) > 0, by_number).otherwise(plain)
