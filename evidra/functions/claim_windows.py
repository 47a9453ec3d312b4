"""The best window of one to three sentences of a text for a question, as column expressions.

A window scores 30 for each name of the question that it holds, 24 for each quantity (number and unit), 3 for each term, less
its number of sentences; a question for an explanation gains 12 for each of at least two sentences that share a term.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_number

# Sentences, names, tokens, quantities, endings and words that say nothing.
BREAK = r"(?<=[.!?。！？])\s+|\R+"
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}+#._-]*"
NAME = "[A-Za-z][A-Za-z0-9+#._-]*"
UNITS = "ms|밀리초|초|분|시간|%|퍼센트|gb|기가바이트|tb|테라바이트|건|개|회|명"
QUANTITY = rf"(?i)(?<![\p{{L}}\p{{N}}])([0-9][0-9,]*(?:\.[0-9]+)?)\s*({UNITS})?"
SAME_UNIT = {"밀리초": "ms", "퍼센트": "%", "기가바이트": "gb", "테라바이트": "tb"}
ENDING = "(?:했나요|했는가|인가요|있나요|습니까|했습니다|합니다|했다|하였다|되는|된|하며|하고|하여|해서|에서|으로|부터|에는|은|는|을|를|이|가|에|의|와|과|로)$"
STOP = ("경험", "근거", "직접", "실제", "프로젝트", "어떻게", "어떤", "있", "사용", "구현", "적용", "운영", "개선", "복구", "생산", "production")
EXPLAINS = r"어떻게|어떤\s+[^?]{0,30}(?:절차|방법)"
BY_NAME, BY_QUANTITY, BY_TERM, BY_SENTENCE, MOST = 30, 24, 3, 12, 3


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, BREAK, -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def names(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda x: x != "production"))


def _stem(token: Column) -> Column:
    """Without an ending, twice, as long as two characters are left."""
    for _ in range(2):
        bare = F.regexp_replace(token, ENDING, "")
        token = F.when(F.length(bare) >= 2, bare).otherwise(token)
    return token


def terms(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), _stem)
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 2) & ~x.isin(*STOP) & ~x.rlike("^[0-9]")))


def quantities(text: Column) -> Column:
    """Numbers in their plain form behind their units, each once."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    unit = lambda k: F.lower(F.regexp_replace(F.get(F.regexp_extract_all(plain, F.lit(QUANTITY), F.lit(2)), k), "^$", ""))
    folded = lambda u: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in SAME_UNIT.items() for x in p]), u), u)
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(QUANTITY), F.lit(1)), lambda n, k: F.concat(folded(unit(k)), F.lit(":"), canonical_number(n))))


def signals(text: Column) -> Column:
    """(names, terms, quantities) of a text."""
    return F.struct(names(text).alias("names"), terms(text).alias("terms"), quantities(text).alias("quantities"))


def best_window(query: Column, question: Column, found: Column) -> Column:
    """(first, last, score) of the best window of found, the signals of each sentence; of equal ones the first, then the shortest.
    Null without sentences."""
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    union = lambda xs, name: F.array_distinct(F.flatten(F.transform(xs, lambda x: x[name])))

    def score(xs: Column) -> Column:
        base = BY_NAME * shared(query["names"], union(xs, "names")) + BY_QUANTITY * shared(query["quantities"], union(xs, "quantities")) + BY_TERM * shared(query["terms"], union(xs, "terms")) - F.size(xs)
        support = F.size(F.filter(xs, lambda x: shared(query["terms"], x["terms"]) > 0))
        return base + F.when(question.rlike(EXPLAINS) & (support > 1), BY_SENTENCE * support).otherwise(0)

    sizes = F.sequence(F.lit(1), F.lit(MOST))
    windows = F.flatten(F.transform(found, lambda _, k: F.transform(F.filter(sizes, lambda n: k + n <= F.size(found)), lambda n: F.struct(score(F.slice(found, k + 1, n)).alias("score"), (-(k + 1)).alias("first"), (-n).alias("n")))))
    best = F.array_max(windows)
    return F.when(F.size(found) > 0, F.struct((-best["first"]).alias("first"), (-best["first"] - best["n"] - 1).alias("last"), best["score"].alias("score")))
