"""What is shown of a result: a highlight and its context, both only text of the result itself, as column expressions.

A content is cut into units: its lines if it has at least two, else its sentences. A question about the use of technologies
shows the units that name them, each cut to a bound around a name; any other question shows the unit of the snippet that holds
its numbers, else its names. Blank snippets show nothing; a null content leaves the snippet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How questions, names, headings and personal lines are told, and bounds in characters and units.
ASKS_USE = "사용한|사용했|사용경험|활용한|활용했|활용경험|기술스택"
ASKS_WHY = "어떻게|왜|문제|실패|복구|개선|성능|동시|설계|유지|막"
NAME = "[A-Za-z][A-Za-z0-9+#._-]*"
GENERIC = "^(?:api|and|the|with|using|used|project|experience)$"
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
PERSONAL = r"[\w.%+-]+@[\w.-]+\.[a-z]{2,}|https?://|www\.|github\.com|(?:\+?82[- .]?)?0(?:10|2|[3-6][1-5])[- .]?[0-9]{3,4}[- .]?[0-9]{4}"
PERSONAL_LABEL = r"^(?:contact|email|phone|github|education|gpa|name|school|major|status)\b"
PROJECT = r"\||프로젝트|포트폴리오"
LABELLED = "^[^:|]{1,36}[:|]"
NARRATIVE_UNITS, STRUCTURED_UNITS, LINE_MOST, LEAD, HEADING_MOST, HEADING_REACH = 3, 6, 280, 110, 180, 5
SENTENCE = r"([.!?。！？]+['\"’”)\]}]*)\s+"


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, which is computed once: a lambda computes what it refers to anew for each element."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _flat(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"\s+", "")


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, _trim), lambda u: u != "")


def units(text: Column) -> Column:
    sentences = _kept(F.split(F.regexp_replace(text, SENTENCE, "$1\u0001"), "\u0001", -1))
    return _let(_kept(F.split(text, r"\r?\n", -1)), lambda lines: F.when(F.size(lines) >= 2, lines).otherwise(sentences))


def about_use(query: Column) -> Column:
    return _flat(query).rlike(ASKS_USE) & ~_flat(query).rlike(ASKS_WHY)


def names(query: Column) -> Column:
    """Names of at least two characters, one word each."""
    return F.filter(F.regexp_extract_all(query, F.lit(NAME), F.lit(0)), lambda t: (F.char_length(t) >= 2) & ~F.lower(t).rlike(GENERIC))


def phrases(query: Column) -> Column:
    """Names of one or more words in a row."""
    return F.filter(F.regexp_extract_all(query, F.lit(rf"{NAME}(?:\s+{NAME})*"), F.lit(0)), lambda t: ~F.lower(t).rlike(GENERIC))


def _first(found: Column, test) -> Column:
    """The place of the first unit that passes, from 1; 0 without one."""
    return F.coalesce(F.get(F.filter(F.transform(found, lambda u, k: F.when(test(u), k + 1)), lambda k: k.isNotNull()), F.lit(0)), F.lit(0))


def named_units(flats: Column, query: Column) -> Column:
    """Places of the units (given without white space) that are the first to name a phrase, in order."""
    places = F.transform(F.transform(phrases(query), _flat), lambda p: _first(flats, lambda u: F.contains(u, p)))
    return F.sort_array(F.array_distinct(F.filter(places, lambda k: k > 0)))


def personal(unit: Column) -> Column:
    return F.lower(unit).rlike(PERSONAL) | F.lower(unit).rlike(PERSONAL_LABEL)


def heads_project(unit: Column) -> Column:
    return (F.char_length(unit) <= HEADING_MOST) & ~personal(unit) & unit.rlike(PROJECT)


def project_before(found: Column, place: Column) -> Column:
    """The place of the nearest project heading among the five units before; 0 without one."""
    near = F.filter(F.sequence(F.greatest(place - HEADING_REACH, F.lit(1)), F.greatest(place - 1, F.lit(1))), lambda k: (k < place) & heads_project(F.element_at(found, k)))
    return F.coalesce(F.array_max(near), F.lit(0))


def shortened(unit: Column, terms: Column) -> Column:
    """A long unit cut to a bound around the first term that it holds."""
    term = F.get(F.filter(terms, lambda t: F.contains(_flat(unit), _flat(t))), F.lit(0))
    start = F.greatest(F.instr(F.lower(unit), F.lower(term)) - 1 - LEAD, F.lit(0))
    return F.when((F.char_length(unit) <= LINE_MOST) | term.isNull(), unit).otherwise(_trim(F.substring(unit, start + 1, F.lit(LINE_MOST))))


def claim_unit(query: Column, snippet: Column) -> Column:
    """The first unit of a snippet with all numbers of the query, without numbers all names; else the snippet."""
    numbers = F.regexp_extract_all(query, F.lit(NUMBER), F.lit(0))
    wanted = F.transform(F.when(F.size(numbers) > 0, numbers).otherwise(names(query)), _flat)

    def of(r: Column) -> Column:
        found, flats = r["units"], F.transform(r["units"], _flat)
        place = F.when(F.size(r["wanted"]) > 0, _first(flats, lambda u: F.forall(r["wanted"], lambda t: F.contains(u, t)))).otherwise(0)
        return _let(place, lambda k: F.when((F.size(found) > 1) & (k > 0), F.element_at(found, F.greatest(k, F.lit(1)))).otherwise(snippet))

    return _let(F.struct(units(snippet).alias("units"), wanted.alias("wanted")), of)


def _facts(content: Column, snippet: Column, body: Callable[[Column], Column]) -> Column:
    """body of (shown, units, flats): the snippet, the content's units, and those without white space."""
    parts = F.struct(_trim(snippet).alias("shown"), units(content).alias("units"))
    return _let(parts, lambda r: _let(F.struct(r["shown"].alias("shown"), r["units"].alias("units"), F.transform(r["units"], _flat).alias("flats")), body))


def highlight(query: Column, content: Column, snippet: Column) -> Column:
    """Pieces of the content or the snippet to show, in order."""

    def of(r: Column) -> Column:
        shown, found = r["shown"], r["units"]
        cut = lambda k: _let(F.element_at(found, k), lambda u: shortened(u, names(query)))

        def by_use(places: Column) -> Column:
            first = F.element_at(places, 1)
            headed = lambda project: F.when(project > 0, F.array(F.element_at(found, F.greatest(project, F.lit(1))), cut(first))).otherwise(F.array(cut(first)))
            return (
                F.when(F.size(places) == 0, F.array(shown))
                .when(F.size(phrases(query)) > 1, F.transform(F.slice(places, 1, 3), cut))
                .otherwise(_let(project_before(found, first), headed))
            )

        none = F.array().cast("array<string>")
        return F.when(shown == "", none).when(about_use(query), _let(named_units(r["flats"], query), by_use)).otherwise(F.array(claim_unit(query, shown)))

    return _facts(content, snippet, of)


def context(query: Column, content: Column, snippet: Column) -> Column:
    """Units around the shown one, from its project's heading in a structured content, without personal lines."""

    def of(r: Column) -> Column:
        shown, found, flats = r["shown"], r["units"], r["flats"]
        held = _let(_flat(shown), lambda flat: _first(flats, lambda u: F.contains(flat, u) | F.contains(u, flat)))
        anchor = F.when(about_use(query), F.coalesce(F.get(named_units(flats, query), F.lit(0)), F.lit(0))).otherwise(held)
        structured = F.size(F.filter(found, lambda u: u.rlike(LABELLED))) >= 2

        def around(a: Column) -> Column:
            at = F.when(a["structured"], project_before(found, F.greatest(a["anchor"], F.lit(1)))).otherwise(0)
            start = lambda project: F.when(project > 0, project).otherwise(F.greatest(a["anchor"] - F.when(a["structured"], 3).otherwise(1), F.lit(1)))
            part = F.filter(F.slice(found, _let(at, start), F.when(a["structured"], STRUCTURED_UNITS).otherwise(NARRATIVE_UNITS)), lambda u: ~personal(u))
            return F.when(shown == "", F.array().cast("array<string>")).when(a["anchor"] < 1, F.array(shown)).otherwise(part)

        return _let(F.struct(anchor.alias("anchor"), structured.alias("structured")), around)

    return _facts(content, snippet, of)


def places_of(pieces: Column, content: Column) -> Column:
    """Where each piece begins in the content, from 0; -1 for one of the snippet alone."""
    return F.transform(pieces, lambda p: F.instr(content, p) - 1)
