"""Named queries of lexical and hybrid retrieval, guards and rescues, passages and children, and evaluation.

Each is DataFrame code with an oracle of its own formulation. A query set is every 50th document or vector; the words
of a document's query are its three rarest terms, found in its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import completion
from ..functions import korean as kr
from ..functions import text as tx
from ..functions import unicode as un
from ..functions import vetoes as vt
from ..operators import evidence, expansion, structure, vector
from ..operators import fulltext as ft
from ..sources.work import stored
from .corpus import active_chunks, active_runs, every_50th, table, versions
from .queries import _BLOCKS_D, _TOKENS_D, _tokens_sql, QUERIES, docs, pair

_OF = _tokens_sql

# Relations of the oracles

_TERMS = f""", tok AS (SELECT DISTINCT doc_id, t AS term FROM (SELECT doc_id, unnest({_TOKENS_D}) AS t FROM documents)),
df AS (SELECT term, count(*) AS df FROM tok GROUP BY 1)"""
_EVERY_50TH = "SELECT doc_id AS query_id, term FROM tok WHERE doc_id % 50 = 0"
_ITEMS = f"SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({_TOKENS_D}) AS term FROM benchmark)"
_NEED = ", need AS (SELECT query_id, count(*) AS n FROM kw GROUP BY 1)"


def _rarest_sql(asked: str = _EVERY_50TH, n: int = 3, name: str = "kw") -> str:
    """The relation of the n rarest words of each asked text."""
    return f", {name} AS (SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS rn FROM ({asked}) JOIN df USING (term)) WHERE rn <= {n})"


_KW = _TERMS + _rarest_sql() + _NEED
_MATCHES = f""", ct AS (SELECT chunk_id, version_id, unnest(x) AS term, unnest(range(len(x))) AS pos FROM (SELECT chunk_id, version_id, {_OF("content")} AS x FROM chunks_v)),
hits AS (SELECT query_id, chunk_id, version_id, pos, term FROM ct JOIN kw USING (term)),
fullh AS (SELECT h.* FROM hits h JOIN (SELECT query_id, chunk_id FROM hits JOIN need USING (query_id) GROUP BY query_id, chunk_id, n HAVING count(DISTINCT term) = n) f USING (query_id, chunk_id)),
lasts AS (SELECT e.query_id, e.chunk_id, e.pos AS q, h.term, max(h.pos) AS lp FROM fullh e JOIN fullh h ON h.query_id = e.query_id AND h.chunk_id = e.chunk_id AND h.pos <= e.pos GROUP BY ALL),
ends AS (SELECT query_id, chunk_id, q, min(lp) AS p FROM lasts JOIN need USING (query_id) GROUP BY query_id, chunk_id, q, n HAVING count(*) = n),
covers AS (SELECT query_id, chunk_id, p, min(q) AS q FROM ends GROUP BY ALL),
sized AS (SELECT c.query_id, c.chunk_id, h.version_id, c.p, c.q, count(*) AS inside FROM covers c JOIN fullh h ON h.query_id = c.query_id AND h.chunk_id = c.chunk_id AND h.pos BETWEEN c.p AND c.q GROUP BY ALL),
fts AS (SELECT query_id, chunk_id, version_id, sum(0.1 / (1 + (q - p) - (inside - 1))) AS density FROM sized GROUP BY ALL)"""
_FTS = _KW + _MATCHES
_DENSE = """, dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, list_cosine_similarity(q.v, c.v) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.vec_id) AS rank
 FROM unit q, unit c JOIN versions_v a ON a.version_id = c.vec_id AND a.status = 'ACTIVE' WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 20)"""


def _fused_sql(arm: str) -> str:
    return f""", both_arms AS (SELECT coalesce(d.query_id, o.query_id) AS query_id, coalesce(d.cand_id, o.cand_id) AS cand_id, d.rank AS dense_rank, o.rank AS other_rank,
 coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + o.rank), 0) AS rrf FROM dense d FULL JOIN {arm} o ON o.query_id = d.query_id AND o.cand_id = d.cand_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank NULLS LAST, other_rank NULLS LAST, cand_id) AS pos FROM both_arms)
SELECT query_id, cand_id, dense_rank, other_rank, round(rrf, 6) AS rrf, pos FROM placed WHERE pos <= 20"""


def _asked(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    return ft.rarest_terms(d, d.where("doc_id % 50 = 0"), "doc_id", "text")


def _dense(spark, sf_dir, k: int = 20) -> DataFrame:
    return active_runs(table(spark, sf_dir, "embeddings"), docs(spark, sf_dir), k)


def _rounded(fused: DataFrame) -> DataFrame:
    return fused.withColumn("rrf", F.round("rrf", 6))


# Lexical and hybrid retrieval


_ITEMS_FTS = _TERMS + _rarest_sql(_ITEMS) + _NEED + _MATCHES


@pair(_ITEMS_FTS + " SELECT query_id, chunk_id, round(density, 6) AS density, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY density DESC, chunk_id) AS rank FROM fts) WHERE rank <= 20")
def fts_candidates(spark, sf_dir):
    """Active chunks with the three rarest words of a benchmark item, by cover density."""
    d = docs(spark, sf_dir)
    asked = ft.rarest_terms(d, table(spark, sf_dir, "benchmark"), "doc_id", "text", asked_id="item_id")
    found = ft.matches(asked, active_chunks(d), "chunk_id", "content")
    return ft.top(found, "density", "chunk_id", 20).withColumn("density", F.round("density", 6))


@pair(_FTS + _DENSE + ", lex AS (SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY density DESC, cand_id) AS rank FROM (SELECT query_id, version_id AS cand_id, max(density) AS density FROM fts GROUP BY ALL))" + _fused_sql("(SELECT * FROM lex WHERE rank <= 20)"))
def rrf_fusion(spark, sf_dir):
    """Dense and full-text arms: a version's lexical rank is that of its best chunk."""
    chunks = active_chunks(docs(spark, sf_dir))
    found = ft.matches(_asked(spark, sf_dir), chunks, "chunk_id", "content").withColumn("cand_id", F.expr("chunk_id div 1000000"))
    lexical = ft.top(found.groupBy("query_id", "cand_id").agg(F.max("density").alias("density")), "density", "cand_id", 20)
    return _rounded(ft.fuse(_dense(spark, sf_dir), lexical))


@pair(_KW + _DENSE + f""", words AS (SELECT version_id AS cand_id, unnest({_TOKENS_D}) AS term FROM versions_v WHERE status = 'ACTIVE'),
sparse AS (SELECT query_id, cand_id, count(*) AS score FROM words JOIN kw USING (term) GROUP BY ALL),
arm AS (SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM sparse)""" + _fused_sql("(SELECT * FROM arm WHERE rank <= 20)"))
def rrf_sparse_fusion(spark, sf_dir):
    """Dense and sparse arms: the sparse score is a product of term weights."""
    words = versions(docs(spark, sf_dir)).where("status = 'ACTIVE'").select(F.col("version_id").alias("doc_id"), F.explode(tx.tokens(F.col("text"))).alias("term"), F.lit(1).alias("w"))
    sparse = vector.sparse_top(_asked(spark, sf_dir).withColumn("w", F.lit(1)), words, 20).withColumnRenamed("doc_id", "cand_id")
    return _rounded(ft.fuse(_dense(spark, sf_dir), sparse))


# Guards and rescues

_STRONG = "[a-z][a-z0-9+.#_-]{2,}"


@pair(f""", q AS (SELECT DISTINCT conv_id, turn, conv_id % 8 + 1 AS owner_id, term FROM (SELECT conv_id, turn, unnest({_TOKENS_D}) AS term FROM conversations WHERE role = 'user') WHERE regexp_full_match(term, '{_STRONG}')),
had AS (SELECT DISTINCT owner_id, term FROM (SELECT owner_id, unnest({_OF("concat(lang, ' ', source, ' ', text)")}) AS term FROM versions_v WHERE status = 'ACTIVE'))
SELECT conv_id, turn, count(*) AS n_required, count(*) - count(h.term) AS n_missing, count(*) = count(h.term) AS passes FROM q LEFT JOIN had h ON h.owner_id = q.owner_id AND h.term = q.term GROUP BY conv_id, turn""")
def identifier_guard(spark, sf_dir):
    """User turns: does every identifier occur in a title or text of the owner's active versions."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", (F.col("conv_id") % 8 + 1).alias("owner_id"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    asked = asked.where(F.col("term").rlike(f"^{_STRONG}$"))
    title = F.concat_ws(" ", "lang", "source", "text")
    had = versions(docs(spark, sf_dir)).where("status = 'ACTIVE'").select("owner_id", F.explode(F.array_distinct(tx.tokens(title))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").distinct()
    met = asked.join(had.withColumn("met", F.lit(1)), ["owner_id", "term"], "left")
    n, hit = F.count("*"), F.count("met")
    return met.groupBy("conv_id", "turn").agg(n.alias("n_required"), (n - hit).alias("n_missing"), (n == hit).alias("passes"))


_NUMBERS_D = r"""(SELECT DISTINCT {0} AS id, CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(x, '0+$', ''), '\.$', '') ELSE x END AS number
 FROM (SELECT {0}, regexp_replace(replace(raw, ',', ''), '^0+([0-9])', '\1') AS x FROM (SELECT {0}, unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?')) AS raw FROM {1})))"""


@pair(", qn AS (SELECT * FROM " + _NUMBERS_D.format("doc_id", "documents") + " WHERE id % 50 = 0), cn AS (SELECT n.* FROM " + _NUMBERS_D.format("version_id", "versions_v") + """ n JOIN versions_v v ON v.version_id = n.id AND v.status = 'ACTIVE'),
met AS (SELECT DISTINCT q.id AS query_id, c.id AS cand_id FROM qn q JOIN cn c USING (number) WHERE q.id <> c.id),
s AS (SELECT query_id, cand_id, list_cosine_similarity(a.v, b.v) AS score FROM met JOIN unit a ON a.vec_id = query_id JOIN unit b ON b.vec_id = cand_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM s) SELECT query_id, cand_id, round(1 - score, 6) AS distance, rank FROM r WHERE rank <= 20""")
def numeric_anchor_candidates(spark, sf_dir):
    """The 20 nearest active versions that hold a number of the query, numbers taken whole and without commas."""
    n = lambda rows, key, name: rows.select(F.col(key).alias(name), F.explode(tx.number_tokens(F.col("text"))).alias("number"))
    asked = n(docs(spark, sf_dir).where("doc_id % 50 = 0"), "doc_id", "query_id")
    had = n(versions(docs(spark, sf_dir)).where("status = 'ACTIVE'"), "version_id", "cand_id")
    met = asked.join(had, "number").where("query_id <> cand_id").select("query_id", "cand_id").distinct()
    e = table(spark, sf_dir, "embeddings")
    v = lambda name, as_: e.select(F.col("vec_id").alias(name), F.col("embedding").alias(as_))
    scored = met.join(v("query_id", "a"), "query_id").join(v("cand_id", "b"), "cand_id").select("query_id", "cand_id", (1 - vector.cosine_distance(F.col("a"), F.col("b"))).alias("score"))
    return ft.top(scored, "score", "cand_id", 20).select("query_id", "cand_id", F.round(1 - F.col("score"), 6).alias("distance"), "rank")


_SHORT_LOW, _FLOOR = 0.49, 0.50


@pair(_TERMS + _rarest_sql(_EVERY_50TH + " AND length(term) BETWEEN 2 AND 4", 1) + _NEED + _DENSE + f""", weak AS (SELECT query_id FROM dense GROUP BY 1 HAVING max(score) < {_FLOOR}),
ok AS (SELECT d.query_id, d.cand_id, d.score, d.rank FROM dense d JOIN weak USING (query_id) JOIN kw USING (query_id) JOIN tok t ON t.doc_id = d.cand_id AND t.term = kw.term WHERE d.score >= {_SHORT_LOW} AND d.score < {_FLOOR})
SELECT query_id, cand_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM ok) WHERE rn = 1""")
def short_token_rescue(spark, sf_dir):
    """Queries of one token of two to four characters whose candidates are all below the floor: the best one within reach that has the token."""
    d = docs(spark, sf_dir)
    short = F.filter(tx.tokens(F.col("text")), lambda t: F.length(t).between(2, 4))
    own = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct(short)).alias("term")).join(ft.document_frequencies(d, "doc_id", "text"), "term")
    asked = own.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))).where("rn = 1").select("query_id", "term")
    dense = _dense(spark, sf_dir)
    weak = dense.groupBy("query_id").agg(F.max("score").alias("most")).where(F.col("most") < _FLOOR)
    near = dense.where((F.col("score") >= _SHORT_LOW) & (F.col("score") < _FLOOR)).join(weak.select("query_id"), "query_id").join(asked, "query_id")
    has = near.join(d.select(F.col("doc_id").alias("cand_id"), "text"), "cand_id").where(F.array_contains(tx.tokens(F.col("text")), F.col("term")))
    return has.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rn = 1").select("query_id", "cand_id", F.round("score", 6).alias("score"))


@pair(_KW + _DENSE + ", nums AS " + _NUMBERS_D.format("doc_id", "documents") + f""", wants AS (SELECT query_id, 1 AS o, 'MISSING_IDENTIFIER:' || term AS reason, term, NULL AS number FROM kw UNION ALL SELECT id, 2, 'MISSING_NUMBER:' || number, NULL, number FROM nums WHERE id % 50 = 0),
miss AS (SELECT d.query_id, d.cand_id, w.o, w.reason FROM dense d JOIN wants w USING (query_id) LEFT JOIN tok t ON t.doc_id = d.cand_id AND t.term = w.term LEFT JOIN nums n ON n.id = d.cand_id AND n.number = w.number WHERE t.term IS NULL AND n.number IS NULL),
core AS (SELECT d.query_id, d.cand_id, count(t.term) AS n FROM dense d JOIN tok q ON q.doc_id = d.query_id AND length(q.term) >= 6 LEFT JOIN tok t ON t.doc_id = d.cand_id AND t.term = q.term GROUP BY ALL),
allr AS (SELECT query_id, cand_id, 0 AS o, 'DENSE_SCORE_BELOW_TUNING_FLOOR' AS reason FROM dense WHERE score < {_FLOOR} UNION ALL SELECT * FROM miss UNION ALL SELECT query_id, cand_id, 3, 'INSUFFICIENT_CORE_TERM_COVERAGE' FROM dense LEFT JOIN core USING (query_id, cand_id) WHERE coalesce(n, 0) < 2)
SELECT d.query_id, d.cand_id, coalesce(string_agg(a.reason, '|' ORDER BY a.o, a.reason), '') AS reasons FROM dense d LEFT JOIN allr a ON a.query_id = d.query_id AND a.cand_id = d.cand_id GROUP BY ALL""")
def eligibility_completed(spark, sf_dir):
    """Why a candidate of a strict query is no evidence: score, every identifier and number it lacks, too few core terms."""
    d = docs(spark, sf_dir)
    words, numbers = F.array_distinct(tx.tokens(F.col("text"))), tx.number_tokens(F.col("text"))
    names = _asked(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("names"))
    asked = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_sort(numbers).alias("numbers"), F.filter(words, lambda t: F.length(t) >= 6).alias("core")).join(names, "query_id", "left")
    had = d.select(F.col("doc_id").alias("cand_id"), words.alias("has"), numbers.alias("counts"))
    rows = _dense(spark, sf_dir).join(asked, "query_id", "left").join(had, "cand_id", "left")
    lacks = lambda mark, of, had_: F.array_sort(F.transform(F.array_except(F.coalesce(of, F.array().cast("array<string>")), F.coalesce(had_, F.array().cast("array<string>"))), lambda x: F.concat(F.lit(mark), x)))
    core = F.coalesce(F.size(F.array_intersect("core", "has")), F.lit(0)) < 2
    reasons = F.concat(F.array_compact(F.array(F.when(F.col("score") < _FLOOR, "DENSE_SCORE_BELOW_TUNING_FLOOR"))), lacks("MISSING_IDENTIFIER:", F.col("names"), F.col("has")), lacks("MISSING_NUMBER:", F.col("numbers"), F.col("counts")), F.array_compact(F.array(F.when(core, "INSUFFICIENT_CORE_TERM_COVERAGE"))))
    return rows.select("query_id", "cand_id", F.array_join(reasons, "|").alias("reasons"))


@pair(_KW + f""", ct AS (SELECT DISTINCT chunk_id, version_id, chunk_no, term FROM (SELECT chunk_id, version_id, chunk_no, unnest({_OF("content")}) AS term FROM chunks_v)),
p AS (SELECT query_id, version_id, chunk_id, chunk_no, count(*) AS score FROM ct JOIN kw USING (term) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, version_id ORDER BY score DESC, chunk_id) AS rn FROM p), one AS (SELECT * FROM b WHERE rn = 1),
two AS (SELECT p.query_id, p.version_id, p.score, row_number() OVER (PARTITION BY p.query_id, p.version_id ORDER BY p.score DESC, p.chunk_id) AS rn FROM p JOIN one o ON o.query_id = p.query_id AND o.version_id = p.version_id AND abs(p.chunk_no - o.chunk_no) > 1),
d AS (SELECT o.query_id, o.version_id, o.chunk_id AS best_chunk, (o.score + coalesce(t.score, o.score)) / 2.0 AS score FROM one o LEFT JOIN two t ON t.query_id = o.query_id AND t.version_id = o.version_id AND t.rn = 1)
SELECT * FROM (SELECT query_id, version_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_chunk, version_id) AS rank FROM d) WHERE rank <= 20""")
def top2_documents(spark, sf_dir):
    """Documents by the mean of their two best chunks that do not overlap (of one, that one); a chunk's score is how many words of the query it has."""
    c = active_chunks(docs(spark, sf_dir)).select("chunk_id", "version_id", "chunk_no", F.explode(F.array_distinct(tx.tokens(F.col("content")))).alias("term"))
    p = c.join(vector.told(_asked(spark, sf_dir)), "term").groupBy("query_id", "version_id", "chunk_id", "chunk_no").agg(F.count("*").alias("score"))
    p = stored(p, "scores")  # read twice: the chunks are cut into words once
    both = ["query_id", "version_id"]
    one = p.groupBy(*both).agg(F.max_by(F.struct("chunk_no", "chunk_id", "score"), F.struct("score", -F.col("chunk_id"))).alias("o"))
    apart = p.join(one, both).where(F.abs(F.col("chunk_no") - F.col("o.chunk_no")) > 1).groupBy(*both).agg(F.max("score").alias("second"))
    d = one.join(apart, both, "left").select(*both, F.col("o.chunk_id").alias("best"), ((F.col("o.score") + F.coalesce("second", "o.score")) / 2).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "version_id")
    return d.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 20").select(*both, F.round("score", 6).alias("score"), "rank")


# Passages, children and inventories: a version's blocks below one heading are a passage, the blocks its children

_PASSAGES = ", " + _BLOCKS_D + """, act AS (SELECT version_id, document_id, owner_id, lang FROM versions_v WHERE status = 'ACTIVE'),
kids AS (SELECT a.version_id, a.document_id, a.owner_id, a.lang, b.ordinal, b.parent, b.kind, b.start::BIGINT AS start, b."end"::BIGINT AS stop FROM blocks_v b JOIN act a ON a.version_id = b.doc_id WHERE kind <> 'HEADING'),
passages AS (SELECT version_id, document_id, owner_id, lang, parent, count(*) AS n_children, min(start) AS start, max(stop) AS stop FROM kids GROUP BY ALL)"""


def _children(spark, sf_dir) -> DataFrame:
    v = versions(docs(spark, sf_dir)).where("status = 'ACTIVE'").select("version_id", "document_id", "owner_id", "lang")
    b = structure.blocks(docs(spark, sf_dir), "doc_id").where("kind <> 'HEADING'")
    long = [F.col(c).cast("long").alias(n) for c, n in (("ordinal", "ordinal"), ("parent", "parent"), ("start", "start"), ("end", "stop"))]
    return b.select(F.col("doc_id").alias("version_id"), "kind", "content", *long).join(v, "version_id")


def _passages(spark, sf_dir) -> DataFrame:
    keys = ["version_id", "document_id", "owner_id", "lang", "parent"]
    return _children(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n_children"), F.min("start").alias("start"), F.max("stop").alias("stop"))


@pair(_PASSAGES + " SELECT owner_id, document_id, version_id, parent::BIGINT AS parent, n_children, start, stop FROM passages WHERE lang IN ('en', 'de') AND n_children <= 40")
def passage_scan(spark, sf_dir):
    """Passages whose lineage is active and whose language is in the contract of the model."""
    return _passages(spark, sf_dir).where("lang in ('en', 'de') and n_children <= 40").select("owner_id", "document_id", "version_id", "parent", "n_children", "start", "stop")


@pair(_PASSAGES + " SELECT k.version_id, k.ordinal::BIGINT AS ordinal, k.parent::BIGINT AS parent, k.kind FROM kids k WHERE EXISTS (SELECT 1 FROM passages p WHERE p.version_id = k.version_id AND p.parent = k.parent AND p.n_children BETWEEN 2 AND 9)")
def child_scan(spark, sf_dir):
    """Children of a list of passages."""
    wanted = _passages(spark, sf_dir).where("n_children between 2 and 9").select("version_id", "parent")
    return _children(spark, sf_dir).join(wanted, ["version_id", "parent"], "left_semi").select("version_id", "ordinal", "parent", "kind")


@pair(_PASSAGES + """ SELECT version_id, parent::BIGINT AS parent, '["' || string_agg(printf('V%d-SB-%04d', version_id, ordinal::BIGINT), '","' ORDER BY ordinal) || '"]' AS block_ids FROM kids GROUP BY version_id, parent""")
def passage_block_ids(spark, sf_dir):
    """The distinct block ids of each passage in order, as JSON."""
    name = F.format_string("V%d-SB-%04d", "version_id", "ordinal")
    one = _children(spark, sf_dir).groupBy("version_id", "parent").agg(F.array_sort(F.collect_list(F.struct("ordinal", name.alias("id")))).alias("b"))
    return one.select("version_id", "parent", F.to_json(F.array_distinct(F.transform("b", lambda x: x.id))).alias("block_ids"))


@pair(_PASSAGES + """, steps AS (SELECT *, ordinal - lag(ordinal) OVER (PARTITION BY version_id ORDER BY ordinal) AS step, start - lag(stop) OVER (PARTITION BY version_id ORDER BY ordinal) AS gap FROM kids)
SELECT version_id, count(*) AS n_children, count(DISTINCT ordinal) AS n_distinct, count(DISTINCT parent) AS n_passages, sum(CASE WHEN gap < 0 THEN 1 ELSE 0 END)::BIGINT AS n_overlaps, sum(CASE WHEN step < 1 THEN 1 ELSE 0 END)::BIGINT AS n_disorder, sum(CASE WHEN parent >= ordinal THEN 1 ELSE 0 END)::BIGINT AS n_orphans FROM steps GROUP BY version_id""")
def inventory_verify(spark, sf_dir):
    """Counts that an inventory must agree on, and its faults: overlapping, disordered and orphaned children."""
    w = Window.partitionBy("version_id").orderBy("ordinal")
    fault = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    k = _children(spark, sf_dir).withColumn("step", F.col("ordinal") - F.lag("ordinal").over(w)).withColumn("gap", F.col("start") - F.lag("stop").over(w))
    return k.groupBy("version_id").agg(F.count("*").alias("n_children"), F.count_distinct("ordinal").alias("n_distinct"), F.count_distinct("parent").alias("n_passages"), fault(F.col("gap") < 0).alias("n_overlaps"), fault(F.col("step") < 1).alias("n_disorder"), fault(F.col("parent") >= F.col("ordinal")).alias("n_orphans"))


@pair(", " + _BLOCKS_D + """, r AS (SELECT doc_id, ordinal, kind, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY ordinal) AS island FROM blocks_v)
SELECT doc_id, kind, min(ordinal)::BIGINT AS first_block, max(ordinal)::BIGINT AS last_block, count(*) AS n FROM r GROUP BY doc_id, kind, island""")
def section_runs(spark, sf_dir):
    """Runs of blocks of one kind; a kind that comes again starts a new run."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    b = structure.blocks(docs(spark, sf_dir), "doc_id").select("doc_id", "kind", F.col("ordinal").cast("long").alias("ordinal"))
    fresh = (F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind")).cast("long")
    runs_ = b.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    return runs_.groupBy("doc_id", "run", "kind").agg(F.min("ordinal").alias("first_block"), F.max("ordinal").alias("last_block"), F.count("*").alias("n")).drop("run")


@pair(", " + _BLOCKS_D + """, l AS (SELECT doc_id, line_no, bare, sum(CASE WHEN bare = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM s3)
SELECT a.doc_id, a.line_no::BIGINT AS line_no, count(b.line_no) AS ahead FROM l a LEFT JOIN l b ON b.doc_id = a.doc_id AND b.part = a.part AND b.bare <> '' AND b.line_no > a.line_no AND b.line_no <= a.line_no + 10 WHERE a.bare <> '' GROUP BY a.doc_id, a.line_no""")
def look_ahead_lines(spark, sf_dir):
    """How many of the next ten lines follow each line before a blank one."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    lines = lines.select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), tx.strip(F.col("raw")).alias("bare"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    part = lines.withColumn("part", F.sum((F.col("bare") == "").cast("long")).over(w)).where("bare <> ''")
    near = Window.partitionBy("doc_id", "part").orderBy("line_no").rangeBetween(1, 10)
    return part.select("doc_id", "line_no", F.count("*").over(near).alias("ahead"))


# Vectors of passages and children: vectors whose numbers are alike but for the last digit are of one passage


@pair(""", q AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, c.label AS owner_id, list_cosine_similarity(q.v, c.v) AS score FROM unit q, unit c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND q.label = c.label)
SELECT owner_id::BIGINT AS owner_id, query_id, cand_id, row_number() OVER (PARTITION BY owner_id, query_id ORDER BY score DESC, cand_id) AS rank FROM q""")
def full_user_ranking(spark, sf_dir):
    """All candidates of a query's own owner, none cut off; the label stands for the owner."""
    v = table(spark, sf_dir, "embeddings").withColumn("owner_id", F.col("label").cast("long"))
    return vector.ranked_within(v, every_50th(v), "owner_id")


@pair(_DENSE + """, kids AS (SELECT DISTINCT d.query_id, c.vec_id AS child_id FROM dense d JOIN unit c ON c.vec_id // 10 = d.cand_id // 10 WHERE d.rank <= 5)
SELECT query_id, child_id, round(list_cosine_similarity(q.v, c.v), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, child_id) AS rank FROM kids JOIN unit q ON q.vec_id = query_id JOIN unit c ON c.vec_id = child_id""")
def child_rescoring(spark, sf_dir):
    """Children of each query's five best passages, scored anew and no others."""
    v = table(spark, sf_dir, "embeddings")
    best = _dense(spark, sf_dir, 5).select("query_id", F.expr("cand_id div 10").alias("passage")).distinct()
    kids = v.select(F.col("vec_id").alias("child_id"), F.expr("vec_id div 10").alias("passage"), F.col("embedding").alias("c")).join(best, "passage")
    scored = kids.join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").withColumn("score", 1 - vector.cosine_distance(F.col("q"), F.col("c")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "child_id")
    return scored.select("query_id", "child_id", F.round("score", 6).alias("score"), F.row_number().over(w).cast("long").alias("rank"))


@pair(_DENSE + " SELECT query_id, cand_id, document_id, version_no, rank, round(1 - score, 6) AS distance FROM dense JOIN versions_v v ON v.version_id = cand_id WHERE v.owner_id = v.document_id % 8 + 1")
def passage_knn(spark, sf_dir):
    """The 20 nearest passages of active versions with their checked lineage, by (distance, id)."""
    v = versions(docs(spark, sf_dir)).where(F.col("owner_id") == F.col("document_id") % 8 + 1).select(F.col("version_id").alias("cand_id"), "document_id", "version_no")
    return _dense(spark, sf_dir).join(v, "cand_id").select("query_id", "cand_id", "document_id", "version_no", F.col("rank").cast("long").alias("rank"), F.round(1 - F.col("score"), 6).alias("distance"))


@pair(_DENSE + """, use AS (SELECT cand_id, count(*) AS n FROM dense WHERE rank <= 5 GROUP BY 1), s AS (SELECT count(*) AS all_v, max(len(v)) AS dims FROM unit)
SELECT 'PRECOMPUTED' AS strategy, all_v AS computed, (4 * dims * all_v)::BIGINT AS bytes FROM s UNION ALL SELECT 'ON_DEMAND', (SELECT sum(n)::BIGINT FROM use), 0 FROM s UNION ALL SELECT 'CACHED', (SELECT count(*) FROM use), (4 * dims * (SELECT count(*) FROM use))::BIGINT FROM s""")
def embedding_costs(spark, sf_dir):
    """How many embeddings each strategy computes for the log of uses, and the bytes it keeps (four a number)."""
    v = table(spark, sf_dir, "embeddings")
    whole = v.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"))
    used = _dense(spark, sf_dir, 5).agg(F.count("*").alias("uses"), F.count_distinct("cand_id").alias("once"))
    both = whole.crossJoin(used)  # one row each
    row = lambda name, n, kept: F.struct(F.lit(name).alias("strategy"), n.cast("long").alias("computed"), (kept * 4 * F.col("dims")).cast("long").alias("bytes"))
    return both.select(F.inline(F.array(row("PRECOMPUTED", F.col("n"), F.col("n")), row("ON_DEMAND", F.col("uses"), F.lit(0)), row("CACHED", F.col("once"), F.col("once")))))


# Expansion, fallbacks and vetoes: rules of language, without an oracle; fixtures test them


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@pair(None)
def evidence_expansion(spark, sf_dir):
    """What each full-text result of a benchmark item shows: its own lines or a more direct chunk of its version."""
    chunks = active_chunks(docs(spark, sf_dir)).select("version_id", "chunk_id", "chunk_no", "content")
    found = fts_candidates(spark, sf_dir).select("query_id", "chunk_id", F.expr("chunk_id div 1000000").alias("version_id")).join(_items(spark, sf_dir), "query_id")
    return expansion.expand(found, chunks)


@pair(None)
def variant_expansion(spark, sf_dir):
    """The first variant of each user turn whose words are all in one active chunk, and the chunks that hold them."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    variants = turns.select("query_id", F.posexplode(F.concat(F.array("text"), kr.variants("text"))).alias("variant", "said"))
    words = variants.select(F.concat_ws("#", "query_id", "variant").alias("query_id"), F.explode(F.array_distinct(tx.tokens(F.col("said")))).alias("term"))
    found = ft.matches_by_rarest(words, active_chunks(docs(spark, sf_dir)), "chunk_id", "content")
    key = F.split("query_id", "#")
    numbered = found.select(key[0].cast("long").alias("query_id"), key[1].cast("int").alias("variant"), "chunk_id", F.round("density", 6).alias("density"))
    return expansion.first_found(variants, numbered)


@pair(None)
def numeric_anchor_rescue(spark, sf_dir):
    """The profile over candidates that hold the query's numbers, lifted to the floor; results keep their own scores."""
    near = numeric_anchor_candidates(spark, sf_dir).select("query_id", "cand_id", (1 - F.col("distance")).alias("own"), "rank")
    d = docs(spark, sf_dir)
    asked = d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    told = active_chunks(d).select("version_id", "chunk_id", "content", F.concat_ws(" ", "lang", "source").alias("title"))
    rows = near.join(told, near.cand_id == told.version_id).join(asked, "query_id").withColumn("asked_numbers", kr.numeric_anchors("query")).withColumn("told_numbers", kr.numeric_anchors("content")).where(kr.numbers_met(F.col("asked_numbers"), F.col("told_numbers"), False))
    lifted = rows.select("query_id", "chunk_id", "version_id", F.lit(None).cast("int").alias("page_no"), "title", "content", F.greatest("own", F.lit(_FLOOR)).alias("score"), "rank")
    found = evidence.evidence_profile(lifted, asked.join(near.select("query_id").distinct(), "query_id", "left_semi"), most=None)
    return found.select("query_id", "position", "chunk_id", "version_id").join(near.select("query_id", F.col("cand_id").alias("version_id"), "own"), ["query_id", "version_id"])


def _held_items(spark, sf_dir) -> DataFrame:
    """Benchmark items with the documents that hold them, all texts in normal form beside their own."""
    form = lambda c: vt.flat(un.normalized(c))
    items = _items(spark, sf_dir).withColumn("query_form", form("query"))
    texts = docs(spark, sf_dir).select("doc_id", form("text").alias("form"))
    return QUERIES["literal_candidates"](spark, sf_dir).select(F.col("item_id").alias("query_id"), "doc_id").join(items, "query_id").join(texts, "doc_id")


@pair(None)
def contradiction_veto(spark, sf_dir):
    return _held_items(spark, sf_dir).select("query_id", "doc_id", vt.veto(F.col("query"), F.col("query_form"), F.col("form")).alias("verdict"))


@pair(None)
def claim_decision(spark, sf_dir):
    return _held_items(spark, sf_dir).select("query_id", "doc_id", vt.decision(F.col("query"), F.col("query_form"), F.col("form")).alias("decision"))


@pair(None)
def query_intents(spark, sf_dir):
    """Whether a turn asks for a completed release, for what, and by which policy its candidates are judged."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", completion.intent("text").alias("i")).select("conv_id", "turn", "i.*")
