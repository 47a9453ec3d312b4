"""Named queries of evaluation, candidate signals, validation and job transitions, and of the two streams.

As in `retrieval`, DataFrame code stands against an oracle of its own formulation, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import claim_windows as cw
from ..functions import text as tx
from ..functions import unicode as un
from ..operators import fulltext as ft
from ..operators import structure
from ..streaming import runner
from .corpus import active_chunks, register, runs, table, versions
from .queries import _BLOCKS_D, _FOLD_D, _TOKENS_D, _tokens_sql, docs, pair
from .retrieval import _DENSE, _FLOOR, _KW, _NUMBERS_D, _asked, _dense

# Signals of candidates

_SIGNALS = _KW + _DENSE + ", nums AS " + _NUMBERS_D.format("doc_id", "documents") + """, core AS (SELECT * FROM tok WHERE length(term) >= 6),
sig AS (SELECT d.query_id, d.cand_id, d.rank, d.score,
 (SELECT count(*) FROM kw WHERE kw.query_id = d.query_id) AS ids, (SELECT count(*) FROM kw JOIN tok t ON t.term = kw.term WHERE kw.query_id = d.query_id AND t.doc_id = d.cand_id) AS ids_met,
 (SELECT count(*) FROM nums n WHERE n.id = d.query_id) AS numbers, (SELECT count(*) FROM nums n JOIN nums m ON m.number = n.number WHERE n.id = d.query_id AND m.id = d.cand_id) AS numbers_met,
 (SELECT count(*) FROM core c WHERE c.doc_id = d.query_id) AS core, (SELECT count(*) FROM core c JOIN core e ON e.term = c.term WHERE c.doc_id = d.query_id AND e.doc_id = d.cand_id) AS core_met FROM dense d)"""


def _signals(spark, sf_dir) -> DataFrame:
    """Dense candidates with how many identifiers, numbers and core terms a query has and a candidate meets."""
    d = docs(spark, sf_dir)
    core = lambda words: F.filter(F.col(words), lambda t: F.length(t) >= 6)
    names = _asked(spark, sf_dir).groupBy("query_id").agg(F.collect_set("term").alias("names"))
    asked = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_distinct(tx.tokens(F.col("text"))).alias("qw"), tx.number_tokens(F.col("text")).alias("qn"))
    asked = asked.select("query_id", "qn", core("qw").alias("qc")).join(names, "query_id", "left")
    had = d.select(F.col("doc_id").alias("cand_id"), "text")
    some = lambda a: F.coalesce(F.col(a), F.array().cast("array<string>"))  # noqa: E731  a vector may have no document
    met = lambda a, b: F.size(F.array_intersect(some(a), some(b))).cast("long")
    size = lambda a: F.size(some(a)).cast("long")
    rows = _dense(spark, sf_dir).join(asked, "query_id", "left").join(had, "cand_id", "left")
    # only texts of candidates are cut into words
    rows = rows.withColumn("words", F.array_distinct(tx.tokens(F.col("text")))).withColumn("numbers", tx.number_tokens(F.col("text"))).withColumn("core", core("words"))
    return rows.select("query_id", "cand_id", F.col("rank").cast("long").alias("rank"), "score", size("names").alias("ids"), met("names", "words").alias("ids_met"), size("qn").alias("n"), met("qn", "numbers").alias("n_met"), size("qc").alias("c"), met("qc", "core").alias("c_met"))


@pair(_SIGNALS + " SELECT query_id, cand_id, 100 * ids_met + 100 * numbers_met + core_met AS affinity FROM sig")
def lexical_affinity(spark, sf_dir):
    return _signals(spark, sf_dir).select("query_id", "cand_id", (100 * F.col("ids_met") + 100 * F.col("n_met") + F.col("c_met")).alias("affinity"))


@pair(_SIGNALS + " SELECT query_id, cand_id, round(coalesce(0.02::DOUBLE * ids_met / nullif(ids, 0), 0) + coalesce(0.005::DOUBLE * core_met / nullif(core, 0), 0) + coalesce(0.005::DOUBLE * numbers_met / nullif(numbers, 0), 0), 6) AS boost FROM sig")
def ranking_boosts(spark, sf_dir):
    share = lambda of, met, w: F.when(F.col(of) > 0, w * F.col(met) / F.col(of)).otherwise(F.lit(0.0))
    return _signals(spark, sf_dir).select("query_id", "cand_id", F.round(share("ids", "ids_met", 0.02) + share("c", "c_met", 0.005) + share("n", "n_met", 0.005), 6).alias("boost"))


@pair(_SIGNALS + " SELECT query_id, cand_id, numbers, numbers_met FROM sig WHERE numbers_met = numbers")
def numeric_required_filter(spark, sf_dir):
    """Candidates that hold every number of the query."""
    return _signals(spark, sf_dir).where("n_met = n").select("query_id", "cand_id", F.col("n").alias("numbers"), F.col("n_met").alias("numbers_met"))


@pair(_SIGNALS + " SELECT query_id, cand_id, rank FROM sig WHERE ids_met > 0")
def direct_anchor_filter(spark, sf_dir):
    """Candidates that hold at least one name of the query itself."""
    return _signals(spark, sf_dir).where("ids_met > 0").select("query_id", "cand_id", "rank")


@pair(_SIGNALS + f""", st AS (SELECT query_id, cand_id, true AS found, score >= {_FLOOR} OR ids_met = ids AS eligible, rank <= 5 AS top FROM sig)
SELECT query_id, count(*) AS retrieved, sum(eligible::INT)::BIGINT AS eligible, sum((eligible AND top)::INT)::BIGINT AS shown,
 CASE WHEN sum(eligible::INT) = 0 THEN 'ELIGIBILITY' WHEN sum((eligible AND top)::INT) = 0 THEN 'RANKING' ELSE 'NONE' END AS lost_at FROM st GROUP BY query_id""")
def decision_trace(spark, sf_dir):
    """How many candidates of a query are left after each stage, and the stage that loses the last one."""
    eligible = (F.col("score") >= _FLOOR) | (F.col("ids_met") == F.col("ids"))
    n = lambda c: F.sum(c.cast("long"))
    g = _signals(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("retrieved"), n(eligible).alias("eligible"), n(eligible & (F.col("rank") <= 5)).alias("shown"))
    return g.withColumn("lost_at", F.when(F.col("eligible") == 0, "ELIGIBILITY").when(F.col("shown") == 0, "RANKING").otherwise("NONE"))


_BIGRAMS = "list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]))"


@pair(_DENSE + f""", bi AS (SELECT doc_id, {_BIGRAMS} AS b FROM (SELECT doc_id, {_TOKENS_D} AS x FROM documents))
SELECT query_id, cand_id, len(list_intersect(q.b, c.b)) AS n_shared, len(q.b) AS n_asked FROM dense JOIN bi q ON q.doc_id = query_id JOIN bi c ON c.doc_id = cand_id""")
def adjacency_bigrams(spark, sf_dir):
    """How many neighbouring word pairs of the query a candidate has too."""
    x = tx.tokens(F.col("text"))
    pairs = F.transform(F.array(x), lambda w: F.when(F.size(w) > 1, F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>")))[0]
    b = docs(spark, sf_dir).select("doc_id", pairs.alias("b"))
    of = lambda name, as_: b.select(F.col("doc_id").alias(name), F.col("b").alias(as_))
    rows = _dense(spark, sf_dir).select("query_id", "cand_id").join(of("query_id", "q"), "query_id").join(of("cand_id", "c"), "cand_id")
    return rows.select("query_id", "cand_id", F.size(F.array_intersect("q", "c")).cast("long").alias("n_shared"), F.size("q").cast("long").alias("n_asked"))


_stemmed = f"regexp_replace(t, '{cw.ENDING}', '')"
_twice = f"regexp_replace(u, '{cw.ENDING}', '')"
_WINDOW_SIGNALS = rf"""list_distinct(list_filter(list_transform(regexp_extract_all(line, '{cw.NAME}'), lambda t : lower(t)), lambda t : t <> 'production')) AS ns,
 list_distinct(list_filter(list_transform(list_transform(regexp_extract_all(lower(line), '{cw.TOKEN}'), lambda t : CASE WHEN length({_stemmed}) >= 2 THEN {_stemmed} ELSE t END), lambda u : CASE WHEN length({_twice}) >= 2 THEN {_twice} ELSE u END), lambda t : length(t) >= 2 AND NOT list_contains(['{"', '".join(cw.STOP)}'], t) AND NOT regexp_matches(t, '^[0-9]'))) AS ts,
 list_distinct(list_transform(regexp_extract_all(replace(line, ',', ''), '(?i)(?:^|[^\p{{L}}\p{{N}}.])[0-9]+(?:\.[0-9]+)?\s*(?:{cw.UNITS})?'), lambda t : lower(regexp_extract(t, '(?i)({cw.UNITS})$')) || ':' || regexp_replace(regexp_replace(regexp_extract(t, '[0-9]+(?:\.[0-9]+)?'), '^0+([0-9])', '\1'), '(\.[0-9]*?)0+$', '\1'))) AS qs"""


@pair(_KW + _DENSE + rf""", asks AS (SELECT query_id, string_agg(term, ' ' ORDER BY term) || CASE WHEN (query_id // 50) % 2 = 0 THEN ' 어떻게' ELSE ' 12 ms' END AS q FROM kw GROUP BY query_id),
w_texts AS (SELECT d.query_id, d.cand_id, s.k, s.line FROM dense d JOIN (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(10), 'g'), '[\n\r\x0B\f]+'), lambda x : regexp_replace(x, '^\s+|\s+$', 'g')), lambda x : x <> '') AS ls FROM documents)) s ON s.doc_id = d.cand_id WHERE d.rank <= 5),
w_all AS (SELECT query_id, cand_id, k, 0 AS turn, line FROM w_texts UNION ALL SELECT query_id, 0, 0, 1, q FROM asks),
w_sig AS (SELECT *, {_WINDOW_SIGNALS} FROM w_all),
w_win AS (SELECT a.query_id, a.cand_id, a.k AS first, a.k + n - 1 AS last, n, list_distinct(flatten(list(b.ns))) AS ns, list_distinct(flatten(list(b.ts))) AS ts, list_distinct(flatten(list(b.qs))) AS qs, list(b.ts) AS each FROM w_sig a, range(1, 4) r(n), w_sig b WHERE a.turn = 0 AND b.turn = 0 AND b.query_id = a.query_id AND b.cand_id = a.cand_id AND b.k >= a.k AND b.k < a.k + n GROUP BY ALL HAVING count(*) = n),
w_score AS (SELECT w.query_id, w.cand_id, first, last, n, 30 * len(list_intersect(q.ns, w.ns)) + 24 * len(list_intersect(q.qs, w.qs)) + 3 * len(list_intersect(q.ts, w.ts)) - n + CASE WHEN regexp_matches(q.line, '{cw.EXPLAINS}') AND len(list_filter(each, lambda x : list_has_any(x, q.ts))) > 1 THEN 12 * len(list_filter(each, lambda x : list_has_any(x, q.ts))) ELSE 0 END AS score FROM w_win w JOIN w_sig q ON q.query_id = w.query_id AND q.turn = 1)
SELECT query_id, cand_id, first::BIGINT AS first, last::BIGINT AS last, score::BIGINT AS score FROM w_score QUALIFY row_number() OVER (PARTITION BY query_id, cand_id ORDER BY score DESC, first, n) = 1""")
def claim_windows_preselected(spark, sf_dir):
    """The best window of one to three sentences of each of five candidates for a question of its query's rarest words."""
    tail = F.when(F.expr("query_id div 50") % 2 == 0, " 어떻게").otherwise(" 12 ms")
    asked = _asked(spark, sf_dir).groupBy("query_id").agg(F.concat(F.array_join(F.sort_array(F.collect_list("term")), " "), tail).alias("q"))
    asked = asked.withColumn("signals", cw.signals(F.col("q")))
    texts = docs(spark, sf_dir).select(F.col("doc_id").alias("cand_id"), "text")
    rows = _dense(spark, sf_dir, 5).select("query_id", "cand_id").join(asked, "query_id").join(texts, "cand_id")
    rows = rows.withColumn("found", F.transform(cw.sentences(F.col("text")), cw.signals))  # of candidates alone
    best = cw.best_window(F.col("signals"), F.col("q"), F.col("found"))
    # a filter would be pushed below the join, and all texts read for their signals
    some = rows.select("query_id", "cand_id", F.inline(F.filter(F.array(best), lambda w: w.isNotNull())))
    return some.select("query_id", "cand_id", *[F.col(c).cast("long").alias(c) for c in ("first", "last", "score")])


@pair(""", p AS (SELECT a.version_id, a.chunk_no, a.content AS a, b.content AS b FROM chunks_v a JOIN chunks_v b ON b.version_id = a.version_id AND b.chunk_no = a.chunk_no + 1),
k AS (SELECT *, greatest(110, ceil(least(length(a), length(b)) * 0.3))::BIGINT AS k FROM p)
SELECT version_id, chunk_no, bool_or(contains(b, substr(a, i, k))) AS shared FROM (SELECT *, unnest(range(1, greatest(length(a) - k + 2, 2))) AS i FROM k) WHERE k <= length(a) GROUP BY version_id, chunk_no""")
def shared_span_pairs(spark, sf_dir):
    """Neighbouring chunks: do they share any stretch of 110 characters and three tenths of the shorter one."""
    c = active_chunks(docs(spark, sf_dir)).select("version_id", "chunk_no", F.col("content").alias("a"))
    w = Window.partitionBy("version_id").orderBy("chunk_no")
    p = c.withColumn("b", F.lead("a").over(w)).withColumn("after", F.lead("chunk_no").over(w)).where("after = chunk_no + 1")
    p = p.withColumn("k", F.greatest(F.lit(110), F.ceil(F.least(F.length("a"), F.length("b")) * F.lit(0.3))).cast("int")).where("k <= length(a)")
    return p.select("version_id", "chunk_no", tx.shares_stretch(F.col("a"), F.col("b"), F.col("k")).alias("shared"))


# Validation and digests


@pair("SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'BLANK' WHEN length(text) > 500 THEN 'TOO_LONG' ELSE 'OK' END AS verdict FROM conversations")
def query_validation(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.trim(text) == "", "BLANK").when(F.length(text) > 500, "TOO_LONG").otherwise("OK").alias("verdict"))


@pair("SELECT version_id, printf('D%d-V%d-TXT', document_id, version_no) AS unit_key, sha256(coalesce(text, '')) AS source_hash, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM versions_v")
def source_units(spark, sf_dir):
    """The unit key, hash and bytes of each version's text."""
    text = F.coalesce("text", F.lit(""))
    return versions(docs(spark, sf_dir)).select("version_id", F.format_string("D%d-V%d-TXT", "document_id", "version_no").alias("unit_key"), F.sha2(text.cast("binary"), 256).alias("source_hash"), F.octet_length(text).cast("long").alias("n_bytes"))


@pair("SELECT version_id, count(*) AS stored, max(chunk_no)::BIGINT AS expected, count(*) = max(chunk_no) AS agrees FROM chunks_v GROUP BY version_id")
def stored_counts(spark, sf_dir):
    n, last = F.count("*"), F.max("chunk_no")
    return active_chunks(docs(spark, sf_dir)).groupBy("version_id").agg(n.alias("stored"), last.alias("expected"), (n == last).alias("agrees"))


@pair(r"SELECT page_id, left(trim(regexp_replace(html, '[\x00-\x20]+', ' ', 'g')), 1000) AS message FROM pages")
def error_messages(spark, sf_dir):
    """Messages in one line, cut at the 1,000 characters that are stored of them."""
    return table(spark, sf_dir, "pages").select("page_id", F.left(F.trim(F.regexp_replace("html", r"[\x00-\x20]+", " ")), F.lit(1000)).alias("message"))


@pair(r"SELECT tag_id, regexp_replace(trim(name), '\s+', ' ', 'g') AS display, lower(regexp_replace(trim(name), '\s+', ' ', 'g')) AS form FROM tags_v")
def tag_names(spark, sf_dir):
    register(spark, sf_dir, "tags_v")
    return spark.table("tags_v").select("tag_id", un.tag_name("name").alias("display")).withColumn("form", F.lower("display"))


@pair("SELECT vec_id, sha256(concat('contract|', len(v))) AS digest, len(v) = 64 AS holds FROM unit")
def model_contract(spark, sf_dir):
    """The digest of each vector's contract and whether it is the model's."""
    n = F.size("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.sha2(F.concat(F.lit("contract|"), n.cast("string")).cast("binary"), 256).alias("digest"), (n == 64).alias("holds"))


@pair(r""", lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
SELECT doc_id, line_no::BIGINT AS line_no, (sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(raw) - 1)::BIGINT AS start, length(regexp_replace(raw, '\r$', ''))::BIGINT AS n FROM lines""")
def block_lines(spark, sf_dir):
    """Lines with their numbers and where they begin; a carriage return before the line feed is no part of them."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    w = Window.partitionBy("doc_id").orderBy("k")
    start = F.sum(F.length("raw") + 1).over(w) - F.length("raw") - 1
    return lines.select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), start.cast("long").alias("start"), F.length(F.regexp_replace("raw", "\r$", "")).cast("long").alias("n"))


# Evaluation


def _ranked(spark, sf_dir) -> DataFrame:
    return runs(table(spark, sf_dir, "embeddings"))


@pair("SELECT category, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM (SELECT category, query_id, min(CASE WHEN rel = 2 AND rank <= 5 THEN rank END) AS first FROM runs_v GROUP BY ALL) GROUP BY category")
def mrr(spark, sf_dir):
    first = _ranked(spark, sf_dir).groupBy("category", "query_id").agg(F.min(F.when((F.col("rel") == 2) & (F.col("rank") <= 5), F.col("rank"))).alias("first"))
    return first.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@pair("SELECT cand_id, count(DISTINCT query_id) AS n_queries FROM runs_v WHERE rel = 2 GROUP BY cand_id HAVING count(DISTINCT split) = 2")
def split_leaks(spark, sf_dir):
    """Evidence that queries of both splits refer to."""
    g = _ranked(spark, sf_dir).where("rel = 2").groupBy("cand_id").agg(F.count_distinct("query_id").alias("n_queries"), F.array_size(F.collect_set("split")).alias("n"))
    return g.where("n = 2").drop("n")


@pair("""SELECT category, round(avg(CASE WHEN rank <= 5 THEN rel::DOUBLE END) - avg(CASE WHEN rank > 5 THEN rel::DOUBLE END), 6) AS delta, CASE WHEN avg(CASE WHEN rank <= 5 THEN rel::DOUBLE END) - avg(CASE WHEN rank > 5 THEN rel::DOUBLE END) >= 0.05 THEN 'PROMISING'
 WHEN avg(CASE WHEN rank <= 5 THEN rel::DOUBLE END) - avg(CASE WHEN rank > 5 THEN rel::DOUBLE END) < -0.05 THEN 'NO_GO' ELSE 'NEEDS_ADJUSTMENT' END AS decision FROM runs_v GROUP BY category""")
def ablation_decision(spark, sf_dir):
    """The best five against the others, by category."""
    mean = lambda c: F.avg(F.when(c, F.col("rel").cast("double")))
    g = _ranked(spark, sf_dir).groupBy("category").agg((mean(F.col("rank") <= 5) - mean(F.col("rank") > 5)).alias("d"))
    return g.select("category", F.round("d", 6).alias("delta"), F.when(F.col("d") >= 0.05, "PROMISING").when(F.col("d") < -0.05, "NO_GO").otherwise("NEEDS_ADJUSTMENT").alias("decision"))


@pair(_KW + f""", cl AS (SELECT item_id, clause_no, unnest(list_distinct(list_filter({_tokens_sql("clause")}, lambda t: length(t) >= 8))) AS anchor FROM (SELECT item_id, unnest(string_split(text, '. ')) AS clause, unnest(range(len(string_split(text, '. ')))) AS clause_no FROM benchmark)),
n AS (SELECT item_id, count(DISTINCT clause_no) AS n FROM cl GROUP BY 1), m AS (SELECT item_id, t.doc_id, count(DISTINCT clause_no) AS met FROM cl JOIN tok t ON t.term = anchor GROUP BY ALL)
SELECT item_id, doc_id FROM m JOIN n USING (item_id) WHERE met = n""")
def gold_clauses(spark, sf_dir):
    """Documents that hold, for every clause of an item, one of its anchors at least."""
    clause = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\\. ")).alias("clause_no", "clause"))
    anchors = clause.select("item_id", "clause_no", F.explode(F.array_distinct(F.filter(tx.tokens(F.col("clause")), lambda t: F.length(t) >= 8))).alias("term"))
    need = anchors.groupBy("item_id").agg(F.count_distinct("clause_no").alias("n"))
    words = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    met = words.join(anchors, "term").groupBy("item_id", "doc_id").agg(F.count_distinct("clause_no").alias("met"))
    return met.join(need, "item_id").where("met = n").select("item_id", "doc_id")


@pair(", " + _BLOCKS_D + """, c AS (SELECT version_id, chunk_id, (chunk_no - 1) * 680 AS lo, (chunk_no - 1) * 680 + 800 AS hi FROM chunks_v), o AS (SELECT c.version_id, c.chunk_id, b.ordinal, b.parent FROM c JOIN blocks_v b ON b.doc_id = c.version_id AND b.start < c.hi AND c.lo < b."end" AND b.kind <> 'HEADING'),
f AS (SELECT version_id, count(*) AS n FROM (SELECT version_id, ordinal FROM o GROUP BY ALL HAVING count(*) > 1) GROUP BY 1), x AS (SELECT version_id, count(*) AS n FROM (SELECT version_id, chunk_id FROM o GROUP BY ALL HAVING count(DISTINCT parent) > 1) GROUP BY 1)
SELECT v.version_id, coalesce(f.n, 0) AS fragmented, coalesce(x.n, 0) AS contaminated FROM (SELECT DISTINCT version_id FROM o) v LEFT JOIN f USING (version_id) LEFT JOIN x USING (version_id)""")
def corpus_stats(spark, sf_dir):
    """Blocks that lie in several chunks, and chunks that mix blocks of several headings."""
    c = active_chunks(docs(spark, sf_dir)).select("version_id", "chunk_id", "chunk_no")
    b = structure.blocks(docs(spark, sf_dir), "doc_id").where("kind <> 'HEADING'").select(F.col("doc_id").alias("version_id"), "ordinal", "parent", "start", "end")
    # a block names the chunks it reaches (chunk n begins at 680 (n - 1) and has 800 characters), so no document's chunks meet all its blocks
    first, last = F.greatest(F.floor((F.col("start") - 800) / 680) + 2, F.lit(1)), F.ceil(F.col("end") / 680)
    b = b.withColumn("chunk_no", F.explode(F.sequence(first, F.greatest(first, last)))).where(F.col("chunk_no") <= last)
    o = c.join(b, ["version_id", "chunk_no"])
    # both counts in one pass over the pairs: blocks are cut once
    spread = F.count("*").over(Window.partitionBy("version_id", "ordinal"))
    inside = Window.partitionBy("version_id", "chunk_id")
    o = o.withColumn("spread", spread).withColumn("mixed", F.min("parent").over(inside) < F.max("parent").over(inside))
    fragmented, contaminated = F.count_distinct(F.when(F.col("spread") > 1, F.col("ordinal"))), F.count_distinct(F.when(F.col("mixed"), F.col("chunk_id")))
    return o.groupBy("version_id").agg(fragmented.alias("fragmented"), contaminated.alias("contaminated"))


# Jobs


@pair("""SELECT job_id, event_id, ts, CASE WHEN n.next_ts <= ts + INTERVAL '1' HOUR THEN 'DEFERRED' ELSE 'ACTIVATED' END AS outcome, CASE WHEN n.next_ts <= ts + INTERVAL '1' HOUR THEN ts + INTERVAL '1' MINUTE END AS again_at
 FROM (SELECT *, (SELECT min(r.ts) FROM job_events_v r WHERE r.job_id = e.job_id AND r.kind = 'RENEW' AND r.ts > e.ts) AS next_ts FROM job_events_v e WHERE kind = 'COMPLETE') n""")
def activation_deferral(spark, sf_dir):
    """A completion while the job is still being renewed within the hour is put off by a minute."""
    register(spark, sf_dir, "job_events_v")
    w = Window.partitionBy("job_id").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    e = spark.table("job_events_v").where("kind in ('RENEW', 'COMPLETE')").withColumn("next_ts", F.min(F.when(F.col("kind") == "RENEW", F.col("ts"))).over(w)).where("kind = 'COMPLETE'")
    late = F.coalesce(F.col("next_ts") <= F.col("ts") + F.expr("INTERVAL '1' HOUR"), F.lit(False))
    return e.select("job_id", "event_id", "ts", F.when(late, "DEFERRED").otherwise("ACTIVATED").alias("outcome"), F.when(late, F.col("ts") + F.expr("INTERVAL '1' MINUTE")).alias("again_at"))


@pair(""", last AS (SELECT job_id, arg_max(kind, (ts, event_id)) AS kind, max(ts) AS ts, sum((kind = 'CLAIM')::INT)::BIGINT AS fence FROM job_events_v GROUP BY job_id)
SELECT job_id, kind AS old_state, CASE WHEN kind IN ('ENQUEUE', 'FAIL') THEN 'CLAIM' ELSE kind END AS new_state, CASE WHEN kind IN ('ENQUEUE', 'FAIL') THEN fence + 1 ELSE fence END AS fence FROM last""")
def claim_update(spark, sf_dir):
    """All jobs after the claimable ones were claimed: their state and fence are rewritten by a join with the candidates."""
    register(spark, sf_dir, "job_events_v")
    e = spark.table("job_events_v")
    last = e.groupBy("job_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("old_state"), F.sum((F.col("kind") == "CLAIM").cast("long")).alias("held"))
    claimed = last.where("old_state in ('ENQUEUE', 'FAIL')").select("job_id", F.lit("CLAIM").alias("changed"), (F.col("held") + 1).alias("fence"))
    return last.join(claimed, "job_id", "left").select("job_id", "old_state", F.coalesce("changed", "old_state").alias("new_state"), F.coalesce("fence", "held").alias("fence"))


@pair("SELECT job_id, count(*) AS n_due FROM (SELECT *, lead(kind) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS after FROM job_events_v) WHERE kind = 'ENQUEUE' AND after IS DISTINCT FROM 'COMPLETE' GROUP BY job_id")
def claimable_jobs(spark, sf_dir):
    """How often a job was queued and not completed by what came next."""
    register(spark, sf_dir, "job_events_v")
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    e = spark.table("job_events_v").withColumn("after", F.lead("kind").over(w))
    return e.where((F.col("kind") == "ENQUEUE") & ~F.col("after").eqNullSafe("COMPLETE")).groupBy("job_id").agg(F.count("*").alias("n_due"))


# Streams, run to the end of what is there


@pair("SELECT date_trunc('hour', ts) AS start, kind, count(*) AS n FROM job_events_v GROUP BY 1, 2")
def stream_windows_native(spark, sf_dir):
    """Counts by hour and kind of an event stream."""
    return runner.windows(spark, f"{sf_dir}/events.parquet")


@pair(_FOLD_D + " SELECT job_id, status, fence, retries, rejected FROM job")
def stream_job_state(spark, sf_dir):
    """The last state of each job of an event stream; the batch fold gives the same."""
    return runner.job_states(spark, f"{sf_dir}/events.parquet")


# Policies over the signals of candidates

_OK_D = f"(score >= {_FLOOR} OR (ids > 0 AND ids_met = ids AND numbers_met = numbers) OR (ids = 0 AND rank <= 5 AND numbers = 0 AND core >= 2 AND core_met >= 2))"


def _eligible() -> Column:
    named = (F.col("ids") > 0) & (F.col("ids_met") == F.col("ids")) & (F.col("n_met") == F.col("n"))
    worded = (F.col("ids") == 0) & (F.col("rank") <= 5) & (F.col("n") == 0) & (F.col("c") >= 2) & (F.col("c_met") >= 2)
    return (F.col("score") >= _FLOOR) | named | worded


@pair(_SIGNALS + f" SELECT query_id, cand_id, score >= {_FLOOR} AS by_score, ids > 0 AND ids_met = ids AND numbers_met = numbers AS by_names, core_met >= 2 AS by_terms, {_OK_D} AS eligible FROM sig")
def eligibility_general(spark, sf_dir):
    """Candidates by score, by all names and numbers of the query, or by two of its terms among the best five."""
    named = (F.col("ids") > 0) & (F.col("ids_met") == F.col("ids")) & (F.col("n_met") == F.col("n"))
    return _signals(spark, sf_dir).select("query_id", "cand_id", (F.col("score") >= _FLOOR).alias("by_score"), named.alias("by_names"), (F.col("c_met") >= 2).alias("by_terms"), _eligible().alias("eligible"))


@pair(_SIGNALS + f" SELECT query_id, cand_id, round(score, 6) AS orig_score, round(CASE WHEN ids_met = ids AND score < {_FLOOR} THEN {_FLOOR} ELSE score END, 6) AS elig_score FROM sig")
def promoted_scores(spark, sf_dir):
    """Candidates with all names of the query are lifted to the floor for eligibility; their own score stays beside it."""
    lifted = F.when(F.col("ids_met") == F.col("ids"), F.greatest("score", F.lit(_FLOOR))).otherwise(F.col("score"))
    return _signals(spark, sf_dir).select("query_id", "cand_id", F.round("score", 6).alias("orig_score"), F.round(lifted, 6).alias("elig_score"))


@pair(_SIGNALS + f""" SELECT v.vec_id AS query_id, CASE WHEN (SELECT count(*) FROM versions_v WHERE status = 'ACTIVE') = 0 THEN 'NO_SEARCHABLE_DOCUMENTS' WHEN count(s.cand_id) = 0 THEN 'NO_EVIDENCE'
 WHEN sum(CASE WHEN {_OK_D} THEN 1 ELSE 0 END) = 0 THEN 'NO_RELEVANT_RESULTS' ELSE 'EVIDENCE_FOUND' END AS state FROM unit v LEFT JOIN sig s ON s.query_id = v.vec_id WHERE v.vec_id % 50 = 0 GROUP BY v.vec_id""")
def result_state(spark, sf_dir):
    """The state that a query's search ends in."""
    some = not versions(docs(spark, sf_dir)).where("status = 'ACTIVE'").isEmpty()
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    g = asked.join(_signals(spark, sf_dir).withColumn("ok", _eligible()), "query_id", "left").groupBy("query_id").agg(F.count("cand_id").alias("n"), F.count_if("ok").alias("ok"))
    state = F.when(F.lit(not some), "NO_SEARCHABLE_DOCUMENTS").when(F.col("n") == 0, "NO_EVIDENCE").when(F.col("ok") == 0, "NO_RELEVANT_RESULTS").otherwise("EVIDENCE_FOUND")
    return g.select("query_id", state.alias("state"))


@pair(_SIGNALS + " SELECT query_id, cand_id, rank AS old_rank, row_number() OVER (PARTITION BY query_id ORDER BY 100 * ids_met + 100 * numbers_met + core_met DESC, rank, cand_id) AS new_rank FROM sig")
def rerank_order(spark, sf_dir):
    """Candidates by a second score (here their affinity in words), then by their former rank."""
    scored = _signals(spark, sf_dir).withColumn("second", 100 * F.col("ids_met") + 100 * F.col("n_met") + F.col("c_met"))
    w = Window.partitionBy("query_id").orderBy(F.desc("second"), "rank", "cand_id")
    return scored.select("query_id", "cand_id", F.col("rank").alias("old_rank"), F.row_number().over(w).cast("long").alias("new_rank"))


@pair(_SIGNALS + f" SELECT query_id, cand_id, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id, v.source, v.owner_id ORDER BY rank) AS rn FROM sig s JOIN versions_v v ON v.version_id = s.cand_id WHERE {_OK_D}) WHERE rn = 1")
def deferred_dedup(spark, sf_dir):
    """Eligibility of each candidate first; then one of each place (source and owner) stays, the best."""
    v = versions(docs(spark, sf_dir)).select(F.col("version_id").alias("cand_id"), "source", "owner_id")
    ok = _signals(spark, sf_dir).where(_eligible()).join(v, "cand_id")
    best = ok.groupBy("query_id", "source", "owner_id").agg(F.min_by("cand_id", "rank").alias("cand_id"), F.min("rank").alias("rank"))
    return best.select("query_id", "cand_id", "rank")


@pair(_SIGNALS + f""", st AS (SELECT query_id, max((score >= 0.0)::INT) AS found, max(({_OK_D})::INT) AS eligible, max(({_OK_D} AND rank <= 5)::INT) AS shown FROM sig GROUP BY 1)
SELECT CASE WHEN found = 0 THEN 'RETRIEVAL' WHEN eligible = 0 THEN 'ELIGIBILITY' WHEN shown = 0 THEN 'RANKING' ELSE 'NONE' END AS stage, count(*) AS n FROM st GROUP BY 1""")
def failure_funnel(spark, sf_dir):
    """How many queries fail at each stage first."""
    s = _signals(spark, sf_dir).withColumn("ok", _eligible())
    g = s.groupBy("query_id").agg(F.bool_or(F.col("score") >= 0).alias("found"), F.bool_or("ok").alias("eligible"), F.bool_or(F.col("ok") & (F.col("rank") <= 5)).alias("shown"))
    stage = F.when(~F.col("found"), "RETRIEVAL").when(~F.col("eligible"), "ELIGIBILITY").when(~F.col("shown"), "RANKING").otherwise("NONE")
    return g.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@pair(_SIGNALS + """, arms AS (SELECT s.query_id, s.rank, (row_number() OVER (PARTITION BY s.query_id ORDER BY 100 * ids_met + 100 * numbers_met + core_met DESC, rank, cand_id)) AS other, CASE WHEN q.label = c.label THEN 1 ELSE 0 END AS good FROM sig s JOIN unit q ON q.vec_id = s.query_id JOIN unit c ON c.vec_id = s.cand_id),
o AS (SELECT query_id, max(CASE WHEN rank = 1 THEN good END) AS a, max(CASE WHEN other = 1 THEN good END) AS b FROM arms GROUP BY 1)
SELECT query_id, CASE WHEN a + b = 2 THEN 'BOTH' WHEN a = 1 THEN 'FIRST_ONLY' WHEN b = 1 THEN 'SECOND_ONLY' ELSE 'BOTH_WRONG' END AS outcome, CASE WHEN b > a THEN 'WIN' WHEN b < a THEN 'LOSS' ELSE 'TIE' END AS second_is FROM o""")
def outcome_classes(spark, sf_dir):
    """The best candidate of the dense order against that of the reranked one: which of them has the query's label."""
    lab = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ranked = rerank_order(spark, sf_dir).join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q")), "query_id").join(lab.select(F.col("vec_id").alias("cand_id"), F.col("label").alias("c")), "cand_id")
    first = lambda rank: F.max(F.when(F.col(rank) == 1, (F.col("q") == F.col("c")).cast("int")))
    o = ranked.groupBy("query_id").agg(first("old_rank").alias("a"), first("new_rank").alias("b"))
    outcome = F.when((F.col("a") == 1) & (F.col("b") == 1), "BOTH").when(F.col("a") == 1, "FIRST_ONLY").when(F.col("b") == 1, "SECOND_ONLY").otherwise("BOTH_WRONG")
    return o.select("query_id", outcome.alias("outcome"), F.when(F.col("b") > F.col("a"), "WIN").when(F.col("b") < F.col("a"), "LOSS").otherwise("TIE").alias("second_is"))


@pair("""SELECT event_id, job_id, count(b) AS beats FROM (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS until FROM job_events_v) e LEFT JOIN range(1, 4) r(b) ON e.ts + b * INTERVAL '200' MINUTE <= coalesce(e.until, e.ts) WHERE kind = 'CLAIM' GROUP BY event_id, job_id""")
def heartbeat_schedule(spark, sf_dir):
    """How many of the three beats of a lease of ten hours fall due before the job's next event."""
    register(spark, sf_dir, "job_events_v")
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    e = spark.table("job_events_v").withColumn("until", F.lead("ts").over(w)).where("kind = 'CLAIM'")
    micros = F.unix_micros(F.coalesce("until", "ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", "job_id", F.least(F.lit(3).cast("long"), F.floor(micros / (200 * 60 * 1_000_000))).alias("beats"))
