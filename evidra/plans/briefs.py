"""Named queries of section-aware chunks and of heading paths, over texts with sections, cases and headings.

The test tables hold no such texts. `briefs` makes one of every document: its words, eight a line, and every thirteenth
place says whether a line begins a section or a case, or ends a sentence. The oracle packs lines one after the other in a
recursive query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sections as se
from ..operators import structure
from .queries import _BLOCKS_D, ORACLE, docs, pair

#: The line of place k mod 13, c being its eight words.
TEMPLATES = ("concat('01 Part ', c)", "c", "c", "concat(c, '.')", "'결과'", "concat('Case ', i, ' ', c)", "c", "concat('Case ', i)", "concat(c, '!')", "concat('  ', c, ' ')", "''", "c", "'Project Portfolio'")
_PICK = "CASE (id * 5 + i) % 13 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(TEMPLATES)) + " END"


def briefs(d: DataFrame, pick: str = _PICK) -> DataFrame:
    """(doc_id, text): a text with sections and cases, or with other lines, of every document."""
    words = d.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.split("text", " ").alias("w"))
    cut = words.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("(size(w) - 1) div 8")), lambda k: F.concat_ws(" ", F.slice("w", k * 8 + 1, 8)))).alias("i", "c"))
    lines = cut.select("id", F.struct("i", F.expr(pick).alias("t")).alias("x"))
    return lines.groupBy(F.col("id").alias("doc_id")).agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"])).alias("text"))


@pair(None)
def section_chunks(spark, sf_dir):
    return se.section_chunks(briefs(docs(spark, sf_dir)), "doc_id").select("doc_id", "chunk_no", F.md5(F.col("content").cast("binary")).alias("digest"))


@pair(None)
def case_chunks(spark, sf_dir):
    """Section chunks that carry a short parent's text into its cases."""
    return se.case_chunks(briefs(docs(spark, sf_dir)), "doc_id").select("doc_id", "chunk_no", F.md5(F.col("content").cast("binary")).alias("digest"))


_BLANK = r"[\t-\r\x1c-\x1f \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]+"
_CHUNKS_D = rf"""
b_words AS (SELECT doc_id AS id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
b_cut AS (SELECT id, i, array_to_string(w[8 * i + 1:8 * i + 8], ' ') AS c FROM b_words, unnest(range((len(w) - 1) // 8 + 1)) t(i)),
b_text AS (SELECT id, regexp_split_to_array(string_agg({_PICK}, chr(10) ORDER BY i), '\r\n|\r|\n') AS ls FROM b_cut GROUP BY id),
b_line AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS o, line FROM (SELECT id, i, regexp_replace(ls[i], '^{_BLANK}|{_BLANK}$', '', 'g') AS line FROM b_text, unnest(range(1, len(ls) + 1)) t(i)) WHERE line <> ''),
b_sec AS (SELECT *, count(*) FILTER (regexp_matches(line, '^(?:{se.SECTION})$')) OVER (PARTITION BY id ORDER BY o) AS section FROM b_line),
b_size AS (SELECT id, section, bool_or(regexp_matches(line, '[{se.SENTENCE_END}]$')) OR sum(length(line) + 1) - 1 > {se.CONTEXT_MOST} AS own FROM b_sec GROUP BY id, section),
b_home AS (SELECT s.id, s.section, coalesce((SELECT min(t.section) FROM b_size t WHERE t.id = s.id AND t.own AND t.section >= s.section), (SELECT max(t.section) FROM b_size t WHERE t.id = s.id AND t.own), 0) AS home FROM b_size s),
b_ord AS (SELECT id, home, o, line, row_number() OVER (PARTITION BY id, home ORDER BY o) AS r FROM b_sec JOIN b_home USING (id, section)),
b_pack AS (SELECT id, home, r, o, line, 1 AS chunk, length(line) AS used FROM b_ord WHERE r = 1
  UNION ALL SELECT n.id, n.home, n.r, n.o, n.line, CASE WHEN p.used + 1 + length(n.line) > {se.CHUNK_MOST} THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.used + 1 + length(n.line) > {se.CHUNK_MOST} THEN length(n.line) ELSE p.used + 1 + length(n.line) END FROM b_pack p JOIN b_ord n ON n.id = p.id AND n.home = p.home AND n.r = p.r + 1),
b_last AS (SELECT id, home, max(chunk) AS last FROM b_pack GROUP BY ALL),
b_end AS (SELECT id, home, last, min(r) FILTER (chunk = last - 1) AS b, min(r) FILTER (chunk = last) AS t, max(r) AS e, sum(length(line) + 1) FILTER (chunk = last) - 1 AS tail, sum(length(line) + 1) FILTER (chunk >= last - 1) - 1 AS both FROM b_pack JOIN b_last USING (id, home) GROUP BY ALL HAVING last > 1),
b_try AS (SELECT e.id, e.home, p.r, sum(length(q.line) + 1) FILTER (q.r >= p.r) - 1 AS after, sum(length(q.line) + 1) FILTER (q.r < p.r) - 1 AS before FROM b_end e JOIN b_pack p ON p.id = e.id AND p.home = e.home AND p.r > e.b AND p.r <= e.t JOIN b_pack q ON q.id = e.id AND q.home = e.home AND q.r >= e.b WHERE e.tail < {se.TAIL_LEAST} AND e.both > {se.EVENED_MOST} GROUP BY ALL),
b_fit AS (SELECT y.id, y.home, coalesce(max(y.r) FILTER (y.after >= {se.TAIL_LEAST}), min(y.r)) AS cut FROM b_try y JOIN b_end e USING (id, home) WHERE y.r = e.t OR (y.before >= {se.PREVIOUS_LEAST} AND y.after <= {se.EVENED_MOST}) GROUP BY ALL),
b_done AS (SELECT p.id, p.home, p.o, p.line, CASE WHEN e.tail < {se.TAIL_LEAST} AND e.both <= {se.EVENED_MOST} AND p.chunk = e.last THEN p.chunk - 1 WHEN f.cut IS NOT NULL AND p.chunk = e.last - 1 AND p.r >= f.cut THEN e.last ELSE p.chunk END AS chunk FROM b_pack p LEFT JOIN b_end e USING (id, home) LEFT JOIN b_fit f USING (id, home)),
b_chunk AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY home, chunk) AS chunk_no, string_agg(line, chr(10) ORDER BY o) AS content FROM b_done GROUP BY id, home, chunk)"""

ORACLE["section_chunks"] = f"WITH RECURSIVE {_CHUNKS_D} SELECT id AS doc_id, chunk_no, md5(content) AS digest FROM b_chunk"
ORACLE["case_chunks"] = rf"""WITH RECURSIVE {_CHUNKS_D},
c_kind AS (SELECT *, regexp_matches(content, '{se.CASE}') AS is_case FROM b_chunk),
c_next AS (SELECT a.id, a.chunk_no, a.content, coalesce(min(b.chunk_no) FILTER (NOT b.is_case), 1000000000) AS stop FROM c_kind a LEFT JOIN c_kind b ON b.id = a.id AND b.chunk_no > a.chunk_no WHERE NOT a.is_case AND length(a.content) <= {se.CONTEXT_MOST} AND NOT regexp_matches(a.content, '(?m){se.CASE}') GROUP BY ALL),
c_run AS (SELECT n.id, n.chunk_no, n.stop, n.content FROM c_next n JOIN c_kind k ON k.id = n.id AND k.chunk_no > n.chunk_no AND k.chunk_no < n.stop GROUP BY ALL HAVING max(length(k.content)) + 1 + length(n.content) <= {se.EVENED_MOST}),
c_all AS (SELECT k.id, k.chunk_no, CASE WHEN r.content IS NULL THEN k.content ELSE r.content || chr(10) || k.content END AS content FROM c_kind k LEFT JOIN c_run r ON r.id = k.id AND k.chunk_no > r.chunk_no AND k.chunk_no < r.stop WHERE (k.id, k.chunk_no) NOT IN (SELECT (id, chunk_no) FROM c_run))
SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY chunk_no) AS chunk_no, md5(content) AS digest FROM c_all"""


# Headings with levels: the line of place k mod 11

_HEADED = ("concat('# Part ', i)", "concat(c, '.')", "concat('## ', c, ' ##')", "concat(c, '!')", "''", "concat('Title ', i)", "''", "concat('- ', c)", "concat('#### ', c, ' ', c, ' ', c)", "c", "concat('  ### Deep ', i)")
_HEAD_PICK = "CASE (id * 3 + i * 7) % 11 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_HEADED)) + " END"
_HEADS_D = (
    rf"""b_words AS (SELECT doc_id AS id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
b_cut AS (SELECT id, i, array_to_string(w[8 * i + 1:8 * i + 8], ' ') AS c FROM b_words, unnest(range((len(w) - 1) // 8 + 1)) t(i)),
headed AS (SELECT id AS doc_id, string_agg({_HEAD_PICK}, chr(10) ORDER BY i) AS text FROM b_cut GROUP BY id), """
    + _BLOCKS_D.replace("FROM documents", "FROM headed")
    + r""",
h_all AS (SELECT b.doc_id, ordinal, substr(text, b.start::BIGINT + 1, (b."end" - b.start)::BIGINT) AS t, row_number() OVER (PARTITION BY b.doc_id ORDER BY ordinal) AS o FROM blocks_v b JOIN headed d ON d.doc_id = b.doc_id WHERE kind = 'HEADING'),
h_own AS (SELECT *, length(regexp_extract(t, '^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$', 1)) AS level, CASE WHEN regexp_matches(t, '^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$') THEN trim(regexp_extract(t, '^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$', 2)) ELSE trim(t) END AS title FROM h_all),
h_walk AS (SELECT doc_id, o, ordinal, [{'level': level, 'ordinal': ordinal, 'title': title}] AS stack FROM h_own WHERE o = 1
  UNION ALL SELECT n.doc_id, n.o, n.ordinal, list_append(CASE WHEN n.level = 0 THEN [] ELSE list_filter(p.stack, lambda x : x.level > 0 AND x.level < n.level) END, {'level': n.level, 'ordinal': n.ordinal, 'title': n.title}) FROM h_walk p JOIN h_own n ON n.doc_id = p.doc_id AND n.o = p.o + 1),
h_two AS (SELECT doc_id, ordinal, stack[-1].title AS own, CASE WHEN len(stack) > 1 THEN stack[-2] END AS up FROM h_walk)"""
)
_PATH_SQL = "CASE WHEN up IS NOT NULL AND length(up.title || ' > ' || own) <= 120 THEN up.title || ' > ' || own ELSE left(own, 120) END"


def _headed(spark, sf_dir) -> DataFrame:
    return briefs(docs(spark, sf_dir), _HEAD_PICK)


@pair(None)
def heading_paths(spark, sf_dir):
    """Each heading with the one of the next higher level above it, at most 120 characters."""
    found = structure.heading_paths(_headed(spark, sf_dir), "doc_id")
    return found.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "path", F.size("path_blocks").cast("long").alias("depth"))


ORACLE["heading_paths"] = f"WITH RECURSIVE {_HEADS_D} SELECT doc_id, ordinal::BIGINT AS ordinal, {_PATH_SQL} AS path, CASE WHEN up IS NOT NULL AND length(up.title || ' > ' || own) <= 120 THEN 2 ELSE 1 END::BIGINT AS depth FROM h_two"
