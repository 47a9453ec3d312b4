"""Named queries of what is shown of results and how their order is judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import completion
from ..functions import presentation as pr
from ..functions import text as tx
from ..operators import credit
from ..operators import eligibility as el
from ..operators import fulltext as ft
from .corpus import active_chunks, active_runs, register, table
from .queries import docs, pair
from .retrieval import _DENSE, _KW, _NUMBERS_D, _TERMS, _rarest_sql

# Highlights and context: each active chunk, asked for by its document's three rarest words

#: The question of number k mod 5, a, b and c being those words.
_ASKS = ("concat(a, ' ', b, ' 기술스택은?')", "concat(a, ' 사용한 프로젝트')", "a", "concat('how many ', c)", "concat(a, ', ', b, ' 활용 경험 1')")
_ASK = "CASE (version_id div 2) % 5 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_ASKS)) + " END"


def _asked_chunks(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    words = ft.rarest_terms(d, d, "doc_id", "text").groupBy(F.col("query_id").alias("version_id")).agg(F.sort_array(F.collect_list("term")).alias("w")).where("size(w) = 3")
    words = words.selectExpr("version_id", *[f"get(w, {k}) as {x}" for k, x in enumerate("abc")]).selectExpr("version_id", f"{_ASK} as query")
    return active_chunks(d).join(words, "version_id").select("chunk_id", "query", "content", F.left("content", F.lit(400)).alias("snippet"))


_flat = lambda x: rf"regexp_replace(lower({x}), '\s+', '', 'g')"
_strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_units = lambda x: (
    rf"CASE WHEN len(list_filter(regexp_split_to_array({x}, '\r?\n'), lambda u : {_strip('u')} <> '')) >= 2 THEN list_filter(list_transform(regexp_split_to_array({x}, '\r?\n'), lambda u : {_strip('u')}), lambda u : u <> '')"
    rf" ELSE list_filter(list_transform(string_split(regexp_replace({x}, '{pr.SENTENCE.replace(chr(39), chr(39) * 2)}', '\1' || chr(1), 'g'), chr(1)), lambda u : {_strip('u')}), lambda u : u <> '') END"
)
_holds_all = lambda ts: f"len(list_filter({ts}, lambda t : NOT contains({_flat('u')}, {_flat('t')}))) = 0"
_personal = lambda u: f"(regexp_matches(lower({u}), '{pr.PERSONAL}') OR regexp_matches(lower({u}), '{pr.PERSONAL_LABEL}'))"
_SHOWN_D = (
    _TERMS
    + _rarest_sql("SELECT doc_id AS query_id, term FROM tok")
    + rf""", three AS (SELECT query_id AS version_id, list(term ORDER BY term) AS w FROM kw GROUP BY query_id HAVING count(*) = 3),
q0 AS (SELECT chunk_id, {_ASK.replace(" div ", " // ")} AS query, content, left(content, 400) AS snippet FROM (SELECT version_id, w[1] AS a, w[2] AS b, w[3] AS c FROM three) JOIN chunks_v USING (version_id)),
q1 AS (SELECT *, {_strip("snippet")} AS shown, {_units("content")} AS us, list_filter(regexp_extract_all(query, '{pr.NAME}'), lambda t : length(t) >= 2 AND NOT regexp_matches(lower(t), '{pr.GENERIC}')) AS ns,
  list_filter(regexp_extract_all(query, '{pr.NAME}(?:\s+{pr.NAME})*'), lambda t : NOT regexp_matches(lower(t), '{pr.GENERIC}')) AS ps, regexp_extract_all(query, '{pr.NUMBER}') AS ds,
  regexp_matches({_flat("query")}, '{pr.ASKS_USE}') AND NOT regexp_matches({_flat("query")}, '{pr.ASKS_WHY}') AS uses FROM q0),
q2 AS (SELECT *, {_units("shown")} AS ss, list_sort(list_distinct(list_filter(list_transform(ps, lambda p : list_position(list_transform(us, lambda u : contains({_flat("u")}, {_flat("p")})), true)), lambda k : k > 0))) AS spots,
  len(list_filter(us, lambda u : regexp_matches(u, '{pr.LABELLED}'))) >= 2 AS structured FROM q1),
hit AS (SELECT chunk_id, k, us[k] AS unit, (SELECT n FROM (SELECT unnest(ns) AS n, generate_subscripts(ns, 1) AS o) WHERE contains({_flat("us[k]")}, {_flat("n")}) ORDER BY o LIMIT 1) AS term FROM q2, unnest(spots) t(k)),
cut AS (SELECT chunk_id, k, CASE WHEN length(unit) <= {pr.LINE_MOST} OR term IS NULL THEN unit ELSE {_strip(f"substr(unit, greatest(instr(lower(unit), lower(term)) - 1 - {pr.LEAD}, 0) + 1, {pr.LINE_MOST})")} END AS piece FROM hit),
heads AS (SELECT chunk_id, k, us[k] AS unit FROM q2, unnest(range(1, len(us) + 1)) t(k) WHERE length(us[k]) <= {pr.HEADING_MOST} AND regexp_matches(us[k], '{pr.PROJECT}') AND NOT {_personal("us[k]")}),
claim AS (SELECT chunk_id, CASE WHEN len(ss) > 1 AND len(ws) > 0 THEN coalesce(list_filter(ss, lambda u : {_holds_all("ws")})[1], shown) ELSE shown END AS piece FROM (SELECT *, CASE WHEN len(ds) > 0 THEN ds ELSE ns END AS ws FROM q2))"""
)


@pair(
    _SHOWN_D
    + f""" SELECT q.chunk_id, CASE WHEN shown = '' THEN '' WHEN NOT uses THEN c.piece WHEN len(spots) = 0 THEN shown WHEN len(ps) > 1 THEN (SELECT string_agg(piece, chr(10) ORDER BY k) FROM cut WHERE cut.chunk_id = q.chunk_id AND list_position(q.spots, k) <= 3)
 ELSE concat_ws(chr(10), (SELECT arg_max(unit, k) FROM heads h WHERE h.chunk_id = q.chunk_id AND h.k < q.spots[1] AND h.k >= q.spots[1] - {pr.HEADING_REACH}), (SELECT piece FROM cut WHERE cut.chunk_id = q.chunk_id AND cut.k = q.spots[1])) END AS shown FROM q2 q JOIN claim c USING (chunk_id)"""
)
def presentation_highlights(spark, sf_dir):
    """What is shown of each chunk for its question."""
    rows = _asked_chunks(spark, sf_dir)
    return rows.select("chunk_id", F.array_join(pr.highlight(F.col("query"), F.col("content"), F.col("snippet")), "\n").alias("shown"))


@pair(
    _SHOWN_D
    + f""", a AS (SELECT *, CASE WHEN uses THEN coalesce(spots[1], 0) ELSE coalesce(list_position(list_transform(us, lambda u : contains({_flat("shown")}, {_flat("u")}) OR contains({_flat("u")}, {_flat("shown")})), true), 0) END AS anchor FROM q2),
b AS (SELECT *, (SELECT max(k) FROM heads h WHERE h.chunk_id = a.chunk_id AND a.structured AND h.k < a.anchor AND h.k >= a.anchor - {pr.HEADING_REACH}) AS project FROM a),
c AS (SELECT *, coalesce(project, greatest(1, anchor - CASE WHEN structured THEN 3 ELSE 1 END)) AS start FROM b)
SELECT chunk_id, CASE WHEN shown = '' THEN '' WHEN anchor < 1 THEN shown ELSE coalesce((SELECT string_agg(us[k], chr(10) ORDER BY k) FROM unnest(range(start, least(len(us) + 1, start + CASE WHEN structured THEN {pr.STRUCTURED_UNITS} ELSE {pr.NARRATIVE_UNITS} END))) t(k) WHERE NOT {_personal("us[k]")}), '') END AS around FROM c"""
)
def presentation_context(spark, sf_dir):
    """The units around what is shown."""
    rows = _asked_chunks(spark, sf_dir)
    return rows.select("chunk_id", F.array_join(pr.context(F.col("query"), F.col("content"), F.col("snippet")), "\n").alias("around"))


# nDCG with credit: a candidate covers a unit of its own group and one of a coarser group, a grade less

_UNITS = "SELECT query_id, rank, 1 AS turn, group_id AS grp, CASE rel WHEN 2 THEN 3 ELSE rel END AS gain FROM runs_v WHERE rel > 0 UNION ALL SELECT query_id, rank, 2, 100 + cand_id % 3, CASE rel WHEN 2 THEN 3 ELSE rel END FROM runs_v WHERE rel > 0"


@pair(
    f""", u AS ({_UNITS}), rk AS (SELECT DISTINCT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS o FROM (SELECT DISTINCT query_id, rank FROM u WHERE rank <= 5)),
walk AS (SELECT query_id, 0::BIGINT AS o, []::BIGINT[] AS taken, 0::DOUBLE AS dcg FROM (SELECT DISTINCT query_id FROM u)
  UNION ALL SELECT w.query_id, r.o, CASE WHEN b.grp IS NULL THEN w.taken ELSE list_append(w.taken, b.grp::BIGINT) END, w.dcg + coalesce(b.gain / log2(r.rank + 1), 0) FROM walk w JOIN rk r ON r.query_id = w.query_id AND r.o = w.o + 1
  LEFT JOIN LATERAL (SELECT grp, gain FROM u WHERE u.query_id = w.query_id AND u.rank = r.rank AND NOT list_contains(w.taken, u.grp::BIGINT) ORDER BY gain DESC, turn LIMIT 1) b ON true),
best AS (SELECT query_id, grp, max(gain) AS gain FROM u GROUP BY ALL), ideal AS (SELECT query_id, sum(gain / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS p FROM best) WHERE p <= 5 GROUP BY query_id)
SELECT query_id, round(arg_max(dcg, o) / any_value(ideal), 6) AS ndcg FROM walk JOIN ideal USING (query_id) GROUP BY query_id"""
)
def ndcg_credit(spark, sf_dir):
    register(spark, sf_dir, "runs_v")
    units = spark.sql(_UNITS)
    return credit.credited_ndcg(units, units.select("query_id", "grp", "gain")).withColumn("ndcg", F.round("ndcg", 6))


# Order of names


@pair("""SELECT name, n, row_number() OVER (ORDER BY n DESC, name COLLATE ko, tag_id) AS place FROM (SELECT t.tag_id, t.name, count(DISTINCT d.document_id) AS n FROM tags_v t JOIN document_tags_v d ON d.tag_id = t.tag_id GROUP BY t.tag_id, t.name) u""")
def tag_usage_ranked(spark, sf_dir):
    """Tags by the number of their documents, those with as many by the Korean order of their names."""
    register(spark, sf_dir, "tags_v document_tags_v")
    return tag_order(spark.sql("SELECT t.tag_id, t.name, count(DISTINCT d.document_id) AS n FROM tags_v t JOIN document_tags_v d ON d.tag_id = t.tag_id GROUP BY t.tag_id, t.name")).drop("tag_id")


def tag_order(tags: DataFrame, locale: str = "ko") -> DataFrame:
    """tags (tag_id, name, n) with place, counted from 1 within the tags of as many documents and moved up by those of more."""
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy("n").orderBy(F.collate("name", locale), "tag_id"))
    counts = tags.groupBy("n").agg(F.count("*").alias("m"))  # a row for each number of documents
    before = counts.select("n", F.coalesce(F.sum("m").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("moved"))
    return tags.withColumn("inside", inside).join(before, "n").withColumn("place", F.col("moved") + F.col("inside")).drop("inside", "moved")


# Eligibility by intent: every 50th document asks for its three rarest words, every second time for their release

_RELEASED = "CASE WHEN {0} % 3 = 0 THEN ' 배포했다' ELSE '' END"
_QUESTION = "CASE WHEN (query_id div 50) % 2 = 0 THEN concat(a, ' ', b, ' 출시했나요') ELSE concat(a, ' ', b) END"


@pair(
    _KW
    + _DENSE
    + f""", nums AS {_NUMBERS_D.format("doc_id", "documents")}, core AS (SELECT * FROM tok WHERE length(term) >= 6),
asks AS (SELECT query_id, (query_id // 50) % 2 = 0 AS release FROM kw GROUP BY query_id HAVING count(*) = 3),
d AS (SELECT dense.*, release, cand_id % 3 = 0 AS released, (SELECT count(*) FROM core c JOIN core e ON e.term = c.term WHERE c.doc_id = query_id AND e.doc_id = cand_id) + (release AND cand_id % 3 = 0)::INT AS met,
  least(2, (SELECT count(*) FROM core c WHERE c.doc_id = query_id) + release::INT) AS needed FROM dense JOIN asks USING (query_id)),
lacks AS (SELECT query_id, cand_id, 1 AS o, 'MISSING_IDENTIFIER:' || term AS reason FROM d JOIN kw USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM tok t WHERE t.doc_id = cand_id AND t.term = kw.term)
  UNION ALL SELECT query_id, cand_id, 2, 'MISSING_NUMBER:' || number FROM d JOIN nums ON nums.id = query_id WHERE NOT EXISTS (SELECT 1 FROM nums m WHERE m.id = cand_id AND m.number = nums.number)),
low AS (SELECT query_id, cand_id, 0 AS o, 'DENSE_SCORE_BELOW_TUNING_FLOOR' AS reason FROM d WHERE score < 0.5 AND EXISTS (SELECT 1 FROM lacks l WHERE l.query_id = d.query_id AND l.cand_id = d.cand_id)),
r AS (SELECT * FROM low UNION ALL SELECT lacks.* FROM lacks JOIN asks USING (query_id) WHERE release UNION ALL SELECT query_id, cand_id, 3, 'INSUFFICIENT_CORE_TERM_COVERAGE' FROM d WHERE release AND met < needed)
SELECT d.query_id, d.cand_id, CASE WHEN release THEN 'COMPLETED_RELEASE_EVIDENCE' ELSE 'GENERAL' END AS policy, coalesce(string_agg(reason, '|' ORDER BY o, reason), '') AS reasons FROM d LEFT JOIN r USING (query_id, cand_id) GROUP BY ALL"""
)
def eligibility_by_intent(spark, sf_dir):
    """The reasons against each dense candidate, by the policy that the grammar of its query chooses."""
    d = docs(spark, sf_dir)
    names = ft.rarest_terms(d, d.where("doc_id % 50 = 0"), "doc_id", "text").groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("names")).where("size(names) = 3")
    asked = names.selectExpr("*", "get(names, 0) as a", "get(names, 1) as b").withColumn("i", completion.intent(F.expr(_QUESTION)))
    words, numbers = F.array_distinct(tx.tokens(F.col("text"))), tx.number_tokens(F.col("text"))
    own = d.select("doc_id", words.alias("words"), numbers.alias("numbers"), F.filter(words, lambda t: F.length(t) >= 6).alias("core"), F.expr(f"concat(text, {_RELEASED.format('doc_id')})").rlike(el.RELEASE_WORDS).alias("release"))
    q = asked.join(own.withColumnRenamed("doc_id", "query_id"), "query_id").select("query_id", "i.policy", F.struct(F.col("names").alias("identifiers"), "numbers", "core", (F.col("i.policy") != "GENERAL").alias("release")).alias("q"))
    c = own.select(F.col("doc_id").alias("cand_id"), F.struct(F.col("words").alias("identifiers"), "numbers", "core", "release").alias("c"))
    rows = active_runs(table(spark, sf_dir, "embeddings"), d, 20).join(q, "query_id").join(c, "cand_id")
    told = el.reasons(F.col("policy"), F.col("q"), F.col("c"), F.col("score"), F.col("rank"))
    return rows.select("query_id", "cand_id", "policy", F.array_join(told, "|").alias("reasons"))
