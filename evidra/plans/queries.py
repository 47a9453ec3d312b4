"""Named queries: each applies operators to the corpus relations, with an oracle for the other engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import claims as cl
from ..functions import korean as kr
from ..functions import literals as li
from ..functions import snippets as sn
from ..functions import text as tx
from ..functions import typed_values as tv
from ..operators import bootstrap, evidence, jobs, judgements, needles, selection, structure, typed, vector
from ..sources import files, work
from ..streaming import leases, runner
from .corpus import DUCK, active_chunks, active_runs, every_50th, register, runs, table, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def same(name: str, body: str) -> None:
    """A relational query that is plain SQL over the corpus views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, body)
        return spark.sql(body)

    QUERIES[name], ORACLE[name] = run, DUCK + body


def pair(oracle: str | None) -> Callable:
    """A query in DataFrame code, named as its function, and its oracle over the corpus expressions."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = DUCK + oracle
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Scans and chunks


@pair("SELECT chunk_id, document_id, version_id, owner_id, chunk_no, length(content) AS n, md5(content) AS digest FROM chunks_v")
def active_chunks_scan(spark, sf_dir):
    return active_chunks(docs(spark, sf_dir)).select("chunk_id", "document_id", "version_id", "owner_id", "chunk_no", F.length("content").cast("long").alias("n"), F.md5(F.col("content").cast("binary")).alias("digest"))


same("version_chunks", "SELECT version_id, count(*) AS n_chunks, min(chunk_no) AS first_no, max(chunk_no) AS last_no, sum(length(content)) AS n_chars FROM chunks_v GROUP BY version_id")
same("inventory_counts", "SELECT (SELECT count(*) FROM chunks_v) + (SELECT count(*) FROM versions_v) + (SELECT count(*) FROM tags_v) + (SELECT count(*) FROM document_tags_v) AS n")
same("owner_scope_leaks", "SELECT c.chunk_id FROM chunks_v c JOIN versions_v v ON c.version_id = v.version_id WHERE c.owner_id <> v.owner_id OR v.status <> 'ACTIVE'")

# Vectors

_KNN = "SELECT query_id, cand_id, rank, round(score, 6) AS score, round(1 - score, 6) AS distance FROM ({}) x"
_PAIRS = "SELECT q.vec_id AS query_id, c.vec_id AS cand_id, list_cosine_similarity(q.v, c.v) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.vec_id) AS rank FROM unit q, unit c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id"


def _scored(found: DataFrame) -> DataFrame:
    return found.select("query_id", "cand_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round(1 - F.col("score"), 6).alias("distance"))


def _nearest_to_every_50th(spark, sf_dir, k: int) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return _scored(vector.knn_in_blocks(v, every_50th(v), k))


@pair(_KNN.format("SELECT * FROM (" + _PAIRS + ") WHERE rank <= 20"))
def knn_top20_multi(spark, sf_dir):
    """Every row whose id is divisible by 50 against all rows."""
    return _nearest_to_every_50th(spark, sf_dir, 20)


@pair(_KNN.format("SELECT * FROM (" + _PAIRS + ") WHERE rank <= 5"))
def knn_top5(spark, sf_dir):
    return _nearest_to_every_50th(spark, sf_dir, 5)


@pair("SELECT c.vec_id, round(1 - list_cosine_similarity(q.v, c.v), 6) AS distance, row_number() OVER (ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.vec_id) AS rank FROM unit q, unit c WHERE q.vec_id = 0 AND c.vec_id <> 0 ORDER BY rank LIMIT 20")
def knn_single_query(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").first().embedding
    return vector.nearest(v.where("vec_id <> 0"), q, 20).select("vec_id", F.round("distance", 6).alias("distance"), "rank")


@pair("""SELECT query_id, cand_id, rank, round(score, 6) AS score, v.document_id, concat(v.lang, ' ', v.source) AS title, v.version_no
  FROM (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, list_cosine_similarity(q.v, c.v) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.vec_id) AS rank
   FROM unit q, unit c JOIN versions_v a ON a.version_id = c.vec_id AND a.status = 'ACTIVE' WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id) r JOIN versions_v v ON v.version_id = r.cand_id WHERE rank <= 5""")
def evidence_candidates(spark, sf_dir):
    """The five best active candidates of every 50th vector; other versions take no place."""
    found = active_runs(table(spark, sf_dir, "embeddings"), docs(spark, sf_dir), 5)
    v = versions(docs(spark, sf_dir)).where("status = 'ACTIVE'").select("version_id", "document_id", F.concat_ws(" ", "lang", "source").alias("title"), "version_no")
    return found.join(v, F.col("cand_id") == F.col("version_id")).select("query_id", "cand_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "document_id", "title", "version_no")


@pair("SELECT vec_id, CASE WHEN len(v) = 0 THEN 'EMPTY' WHEN len(v) <> 64 THEN 'DIMENSION' WHEN list_sum(list_transform(v, lambda x: x * x)) = 0 THEN 'ZERO' ELSE 'OK' END AS verdict, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, len(v) AS dims FROM unit")
def vector_validate(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", vector.verdict(e, 64).alias("verdict"), F.round(vector.norm(e), 6).alias("norm"), F.size(e).cast("long").alias("dims"))


@pair("SELECT vec_id, true AS equal FROM unit")
def vector_literal_round_trip(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", (vector.parse_literal(vector.literal(e)) == e).alias("equal"))


_tokens_sql = lambda column="text": "list_filter(list_transform(regexp_extract_all(lower(" + column + "), '[\\p{L}\\p{N}][\\p{L}\\p{N}+#._-]*'), lambda t: regexp_replace(t, '[._-]+$', '')), lambda t: t <> '')"
_TOKENS_D = _tokens_sql()


@pair(f""", terms_d AS (SELECT doc_id, t AS term, count(*) AS w FROM (SELECT doc_id, unnest({_TOKENS_D}) AS t FROM documents) GROUP BY ALL),
terms_q AS (SELECT item_id AS query_id, t AS term, count(*) AS w FROM (SELECT item_id, unnest({_TOKENS_D}) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(q.w * d.w)::BIGINT AS score FROM terms_q q JOIN terms_d d USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 20""")
def sparse_dot_topk(spark, sf_dir):
    def weights(rows, key, name):  # a row for each occurrence: weights of one term add up
        return rows.select(F.col(key).alias(name), F.explode(tx.tokens(F.col("text"))).alias("term"), F.lit(1).alias("w"))

    asked = weights(table(spark, sf_dir, "benchmark"), "item_id", "query_id").groupBy("query_id", "term").agg(F.sum("w").alias("w"))
    texts = work.spread(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", 1_000)  # the only shuffle of documents
    had = weights(texts, "doc_id", "doc_id").groupBy("doc_id", "term").agg(F.sum("w").alias("w"))
    return vector.sparse_top(asked, had, 20)


# Text

@pair(f"SELECT doc_id, len(x) AS n, len(list_distinct(x)) AS n_distinct, md5(array_to_string(x, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS_D} AS x FROM documents)")
def tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.size(F.array_distinct("x")).cast("long").alias("n_distinct"), F.md5(F.array_join("x", " ").cast("binary")).alias("digest"))


@pair(r""", n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?')) AS raw FROM documents),
p AS (SELECT doc_id, regexp_replace(replace(raw, ',', ''), '^0+([0-9])', '\1') AS x FROM n)
SELECT DISTINCT doc_id, CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(x, '0+$', ''), '\.$', '') ELSE x END AS number FROM p""")
def number_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(tx.number_tokens(F.col("text"))).alias("number"))


@pair(f"SELECT doc_id, count(DISTINCT t) AS n, md5(string_agg(DISTINCT t, ' ' ORDER BY t)) AS digest FROM (SELECT doc_id, unnest({_TOKENS_D}) AS t FROM documents) WHERE regexp_full_match(t, '[a-z][a-z0-9+.#_-]*') GROUP BY doc_id")
def identifier_tokens(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", kr.identifiers("text").alias("x")).where(F.size("x") > 0)
    return found.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("x"), " ").cast("binary")).alias("digest"))


@pair(r"SELECT doc_id, len(x) AS n, md5(array_to_string(list_sort(x), ' ')) AS digest FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}+#._-]*'), lambda t: length(t) >= 2)) AS x FROM documents)")
def search_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", kr.terms("text").alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("x"), " ").cast("binary")).alias("digest"))


@pair(None)
def query_variants(spark, sf_dir):
    """User turns as queries: their variants, anchors, and whether they ask for a direct anchor."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'")
    return q.select("conv_id", "turn", F.array_join(kr.variants("text"), " | ").alias("variants"), F.size(kr.anchors("text")).cast("long").alias("n_anchors"), kr.needs_direct_anchor("text").alias("direct"))


@pair(None)
def numeric_anchors(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(kr.numeric_anchors("text")).alias("a")).select("doc_id", "a.number", "a.unit")


@pair(f"""SELECT term, df, round(1 - df / n, 6) AS rarity FROM (SELECT t AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS_D}) AS t FROM documents) GROUP BY 1) a, (SELECT count(*) AS n FROM documents) b""")
def doc_frequency(spark, sf_dir):
    """All terms, those of one document too."""
    d = docs(spark, sf_dir)
    n = d.count()
    df = d.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.round(1 - F.col("df") / n, 6).alias("rarity"))


_ASSERTS = r"(regexp_matches({0}, '(^|[^0-9])(19|20)[0-9]{{2}}([./-][0-9]{{1,2}}([./-][0-9]{{1,2}})?)?([^0-9]|$)') OR regexp_matches({0}, '[0-9][0-9,.]*\s*(%|[a-z]{{2}}|[A-Z]{{2}}|[가-힣])') OR regexp_matches({0}, '\s[—–]\s*\S'))"
_BLOCKS_D = rf"""s0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
s1 AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS line_no FROM s0),
s2 AS (SELECT doc_id, line_no, regexp_replace(raw, '\r$', '') AS body, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(raw) - 1 AS start FROM s1),
s3 AS (SELECT *, regexp_replace(body, '^\s+|\s+$', '', 'g') AS bare FROM s2),
s4 AS (SELECT *, coalesce(lag(bare) OVER w, '') AS above, coalesce(lead(bare) OVER w, '') AS below FROM s3 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
s5 AS (SELECT *, CASE WHEN bare = '' THEN 'BLANK' WHEN regexp_full_match(bare, '[-=_]{{3,}}|[─━]{{3,}}') OR regexp_full_match(bare, '[|]?\s*:?-{{3,}}:?\s*([|]\s*:?-{{3,}}:?\s*)+[|]?') THEN 'OTHER'
 WHEN regexp_full_match(bare, '#{{1,6}}\s+\S.*') THEN 'HEADING' WHEN regexp_full_match(bare, '([-*+•▪◦]|([0-9]+|[A-Za-z])[.)])\s+\S.*') THEN 'LIST_ITEM'
 WHEN length(bare) - length(replace(bare, '|', '')) >= 2 OR length(bare) - length(replace(bare, chr(9), '')) >= 2 THEN 'TABLE_ROW'
 WHEN regexp_full_match(bare, '[A-Za-z][A-Za-z0-9+.-]*://\S+') THEN 'PARAGRAPH' WHEN regexp_full_match(bare, '[^:：\n]{{1,40}}[:：]\s*\S.*') THEN 'KEY_VALUE' WHEN {_ASSERTS.format("bare")} THEN 'PARAGRAPH'
 WHEN above = '' AND length(bare) <= 80 AND NOT regexp_matches(bare, '[.!?。！？;；:]$') AND (below = '' OR (len(regexp_split_to_array(bare, '\s+')) <= 8
  AND NOT (length(below) <= 48 AND len(regexp_split_to_array(below, '\s+')) <= 6 AND NOT regexp_matches(below, '[.!?。！？;；:]$') AND {_ASSERTS.format("below")}))) THEN 'HEADING' ELSE 'PARAGRAPH' END AS kind FROM s4),
s6 AS (SELECT *, CASE WHEN kind = 'PARAGRAPH' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = 'PARAGRAPH' THEN 0 ELSE 1 END AS fresh FROM s5),
s7 AS (SELECT *, sum(CASE WHEN kind <> 'BLANK' THEN fresh ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS ordinal FROM s6),
s8 AS (SELECT doc_id, ordinal, min(kind) AS kind, min(line_no) AS first_line, max(line_no) AS last_line, min(start) AS start, max(start + length(body)) AS "end" FROM s7 WHERE kind <> 'BLANK' GROUP BY doc_id, ordinal),
blocks_v AS (SELECT *, coalesce(max(CASE WHEN kind = 'HEADING' THEN ordinal END) OVER (PARTITION BY doc_id ORDER BY ordinal), 0) AS parent FROM s8)"""


@pair(", " + _BLOCKS_D + """ SELECT b.doc_id, ordinal::BIGINT AS ordinal, kind, parent::BIGINT AS parent, first_line, last_line, b.start::BIGINT AS start, b."end"::BIGINT AS "end", md5(substr(text, b.start::BIGINT + 1, (b."end" - b.start)::BIGINT)) AS digest FROM blocks_v b JOIN documents d ON d.doc_id = b.doc_id""")
def block_assemble(spark, sf_dir):
    long = [F.col(c).cast("long").alias(c) for c in ("ordinal", "parent", "first_line", "last_line", "start", "end")]
    return structure.blocks(docs(spark, sf_dir), "doc_id").select("doc_id", "kind", *long, F.md5(F.col("content").cast("binary")).alias("digest"))


@pair(", " + _BLOCKS_D + " SELECT kind, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_documents, max(last_line - first_line + 1)::BIGINT AS most_lines FROM blocks_v GROUP BY kind")
def block_classify(spark, sf_dir):
    return structure.blocks(docs(spark, sf_dir), "doc_id").groupBy("kind").agg(F.count("*").alias("n_blocks"), F.countDistinct("doc_id").alias("n_documents"), F.max(F.col("last_line") - F.col("first_line") + 1).cast("long").alias("most_lines"))


# Children and passages one after the other; texts with carriage returns are for the tests
_SPACES = r"[\t-\r\x1c-\x1f \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
_CHILDREN_D = rf""", {_BLOCKS_D},
k_text AS (SELECT b.doc_id, ordinal, kind, parent, first_line, last_line, b.start, substr(text, b.start::BIGINT + 1, (b."end" - b.start)::BIGINT) AS t FROM blocks_v b JOIN documents d USING (doc_id)),
k_rule AS (SELECT *, kind = 'OTHER' AND regexp_full_match(t, '{structure.DIVIDER}') AS rule FROM k_text),
k_head AS (SELECT doc_id, ordinal, kind, parent, last_line, rule, CASE WHEN kind = 'TABLE_ROW' THEN ordinal END AS head FROM k_rule WHERE ordinal = 1
  UNION ALL SELECT n.doc_id, n.ordinal, n.kind, n.parent, n.last_line, n.rule, CASE WHEN n.kind = 'OTHER' AND n.rule AND touch AND p.kind = 'TABLE_ROW' THEN p.ordinal WHEN n.kind = 'TABLE_ROW' AND touch AND (p.kind = 'TABLE_ROW' OR (p.rule AND p.head IS NOT NULL)) THEN p.head WHEN n.kind = 'TABLE_ROW' THEN n.ordinal END
  FROM k_head p JOIN k_rule n ON n.doc_id = p.doc_id AND n.ordinal = p.ordinal + 1, LATERAL (SELECT p.last_line + 1 = n.first_line AND p.parent = n.parent AS touch) j),
k_room AS (SELECT k.*, CASE WHEN h.head <> k.ordinal AND length(r.t) + 1 < {structure.PASSAGE_MOST} THEN h.head ELSE 0 END AS header, CASE WHEN h.head <> k.ordinal AND length(r.t) + 1 < {structure.PASSAGE_MOST} THEN r.t END AS context
  FROM k_rule k JOIN k_head h USING (doc_id, ordinal) LEFT JOIN k_text r ON r.doc_id = k.doc_id AND r.ordinal = h.head WHERE k.kind NOT IN ('HEADING', 'OTHER')),
k_cut AS (SELECT *, {structure.PASSAGE_MOST} - coalesce(length(context) + 1, 0) AS room, length(t) > {structure.PASSAGE_MOST} - coalesce(length(context) + 1, 0) AS long, 0 AS part, 0::BIGINT AS i, 0::BIGINT AS j FROM k_room
  UNION ALL SELECT * EXCLUDE (part, i, j, b, w, m), part + 1, b, CASE WHEN NOT long THEN length(t) ELSE b + length(regexp_replace(w[:m], '{_SPACES}+$', '')) END FROM (
   SELECT *, CASE WHEN b + room >= length(t) THEN length(w) WHEN regexp_matches(w, '(?s)[.!?。！？](?:\s|$)') THEN length(regexp_extract(w, '(?s)^(.*[.!?。！？])(?:\s|$)', 1)) WHEN regexp_matches(w, '(?s).\n') THEN length(regexp_extract(w, '(?s)^(.+)\n', 1)) ELSE length(w) END AS m FROM (
    SELECT *, substr(t, b + 1, room) AS w FROM (SELECT *, CASE WHEN long THEN j + length(regexp_extract(substr(t, j + 1), '^{_SPACES}*')) ELSE j END AS b FROM k_cut WHERE j < length(t)) WHERE b < length(t)))),
kids_v AS (SELECT doc_id, ordinal, part, kind, parent, header, first_line + length(substr(t, 1, i)) - length(replace(substr(t, 1, i), chr(10), '')) AS first_line, first_line + length(substr(t, 1, j)) - length(replace(substr(t, 1, j), chr(10), '')) AS last_line,
  (start + i)::BIGINT AS start, (start + j)::BIGINT AS "end", substr(t, i + 1, j - i) AS content, CASE WHEN header > 0 THEN context || chr(10) || substr(t, i + 1, j - i) ELSE substr(t, i + 1, j - i) END AS retrieval, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, part) AS o FROM k_cut WHERE part > 0)"""
_PACKED_D = rf"""{_CHILDREN_D},
p_walk AS (SELECT *, 1 AS passage, length(retrieval) AS size, list_filter([ordinal, header], lambda x : x > 0) AS seen, retrieval AS piece FROM kids_v WHERE o = 1
  UNION ALL SELECT n.*, CASE WHEN goes THEN p.passage ELSE p.passage + 1 END, CASE WHEN goes THEN grown ELSE length(n.retrieval) END, CASE WHEN goes THEN list_concat(p.seen, list_filter([n.ordinal, n.header], lambda x : x > 0)) ELSE list_filter([n.ordinal, n.header], lambda x : x > 0) END, CASE WHEN goes AND known THEN n.content ELSE n.retrieval END
  FROM p_walk p JOIN kids_v n ON n.doc_id = p.doc_id AND n.o = p.o + 1, LATERAL (SELECT list_contains(p.seen, n.header) AS known) a, LATERAL (SELECT p.size + 1 + CASE WHEN known THEN length(n.content) ELSE length(n.retrieval) END AS grown) b,
  LATERAL (SELECT n.parent = p.parent AND n.start >= p."end" AND n.first_line <= p.last_line + 2 AND (n.ordinal - p.ordinal IN (0, 1) OR (p.kind = 'TABLE_ROW' AND n.kind = 'TABLE_ROW' AND n.ordinal = p.ordinal + 2 AND n.header = p.ordinal))
   AND grown <= {structure.PASSAGE_MOST} AND (grown <= {structure.PASSAGE_TARGET} OR p.size < {structure.PASSAGE_LEAST}) AS goes) c)"""


@pair(_CHILDREN_D + " SELECT * EXCLUDE (o) FROM kids_v")
def evidence_children(spark, sf_dir):
    return structure.children(docs(spark, sf_dir), "doc_id")


@pair(_PACKED_D + """ SELECT doc_id, passage, any_value(parent) AS parent, min(first_line) AS first_line, max(last_line) AS last_line, min(start) AS start, max("end") AS "end", string_agg(DISTINCT ordinal::INT, ',' ORDER BY ordinal::INT) AS blocks,
 coalesce(string_agg(DISTINCT header::INT, ',' ORDER BY header::INT) FILTER (header > 0), '') AS headers, count(*) AS n_children, string_agg(content, chr(10) ORDER BY o) AS content, string_agg(piece, chr(10) ORDER BY o) AS retrieval FROM p_walk GROUP BY doc_id, passage""")
def retrieval_passages(spark, sf_dir):
    found = structure.passages(docs(spark, sf_dir), "doc_id")
    return found.withColumn("blocks", F.array_join(F.transform("blocks", lambda x: x.cast("string")), ",")).withColumn("headers", F.array_join(F.transform("headers", lambda x: x.cast("string")), ","))


@pair("""SELECT a.version_id, a.chunk_no, max(k) AS overlap FROM chunks_v a JOIN chunks_v b ON a.version_id = b.version_id AND b.chunk_no = a.chunk_no + 1, range(80, 801) r(k)
WHERE k <= least(length(a.content), length(b.content)) AND k >= ceil(0.3 * least(length(a.content), length(b.content))) AND right(a.content, k) = left(b.content, k) GROUP BY ALL""")
def boundary_overlap_pairs(spark, sf_dir):
    c = active_chunks(docs(spark, sf_dir)).select("version_id", "chunk_no", "content")
    w = Window.partitionBy("version_id").orderBy("chunk_no")
    pairs = c.withColumn("next", F.lead("content").over(w)).withColumn("next_no", F.lead("chunk_no").over(w)).where("next_no = chunk_no + 1")
    return pairs.select("version_id", "chunk_no", tx.boundary_overlap(F.col("content"), F.col("next")).cast("long").alias("overlap")).where("overlap > 0")


@pair("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(regexp_replace(lower(d.text), '\\s+', ' ', 'g'), regexp_replace(lower(b.text), '\\s+', ' ', 'g'))")
def literal_candidates(spark, sf_dir):
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    return needles.holding(docs(spark, sf_dir).select("doc_id", flat("text").alias("flat")), table(spark, sf_dir, "benchmark").select("item_id", flat("text").alias("needle")), "doc_id", "flat", "item_id", "needle")


@pair(None)
def structure_manifests(spark, sf_dir):
    return structure.manifests(docs(spark, sf_dir), "doc_id")


# Snippets, claims and judgements


@pair(None)
def literal_gate(spark, sf_dir):
    """Items with the documents that hold them whole: are all their literal anchors in the document."""
    anchors = table(spark, sf_dir, "benchmark").select("item_id", li.literal_anchors("text").alias("a"))
    held = literal_candidates(spark, sf_dir).join(anchors, "item_id").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    held = held.withColumn("f", li.form("text"))  # of documents that hold an item alone
    return held.select("item_id", "doc_id", F.size("a").cast("long").alias("n_anchors"), li.all_held(F.col("a"), F.col("f")).alias("passes"))



def _located(spark, sf_dir) -> DataFrame:
    """Each benchmark item with the documents that hold it, and the snippet that answers it there."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    held = literal_candidates(spark, sf_dir).join(items, "item_id").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return held.withColumn("s", sn.snippet("query", "text"))


@pair(None)
def sentence_windows(spark, sf_dir):
    """Every window of one to three neighbouring sentences of a block, with its place and text, beside what its document has in
    all; a document without a window is a row of its own."""
    found = docs(spark, sf_dir).select("doc_id", sn.windowed("text").alias("s"))
    return found.select("doc_id", "s.n", "s.n_prose", "s.n_blocks", "s.longest", F.inline_outer("s.windows"))


@pair(None)
def evidence_snippets(spark, sf_dir):
    return _located(spark, sf_dir).select("item_id", "doc_id", "s.*")


@pair(None)
def claim_verdicts(spark, sf_dir):
    rows = _located(spark, sf_dir)
    return rows.withColumn("v", cl.verdict("query", "s.snippet")).select("item_id", "doc_id", "v.*", cl.numeric_veto("s.snippet", "query").alias("veto"))


@pair(None)
def evidence_search(spark, sf_dir):
    """The general profile: every 50th document asks with its whole text; all chunks of its 20 best active versions are candidates.

    The cosine is mapped to 0..1, where the profile's floor lies. Chunks of a version share its rank.
    """
    found = active_runs(table(spark, sf_dir, "embeddings"), docs(spark, sf_dir), evidence.MAX_CANDIDATES)
    asked = docs(spark, sf_dir).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    chunks = active_chunks(docs(spark, sf_dir)).select("version_id", "chunk_id", "content", F.concat_ws(" ", "lang", "source").alias("title"), F.lit(None).cast("int").alias("page_no"))
    rows = chunks.join(found.join(asked.select("query_id"), "query_id"), F.col("cand_id") == F.col("version_id"))
    return evidence.evidence_profile(rows.select("query_id", "chunk_id", "version_id", "page_no", "title", "content", ((F.col("score") + 1) / 2).alias("score"), "rank"), asked, most=None)


@pair("SELECT concat(lang, ' ', source) AS name, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars, CASE WHEN count(*) > 300 THEN 'TOO_MANY_PAGES' WHEN sum(length(text)) > 2000000 THEN 'TOO_LONG' WHEN bool_and(trim(text) = '') THEN 'NO_TEXT' ELSE 'OK' END AS verdict FROM documents GROUP BY lang, source")
def page_verdicts(spark, sf_dir):
    return files.page_verdicts(docs(spark, sf_dir).select(F.concat_ws(" ", "lang", "source").alias("name"), F.col("doc_id").alias("page_no"), "text"))


# What a judge says: the second sentence of the snippet, by its rank sometimes another text; every chunk of a candidate is judged
_SAID = "CASE WHEN rank % 5 = 1 THEN 'no such sentence' WHEN rank % 5 = 2 THEN concat(chunk_id, ' is not in the source') WHEN rank % 5 = 3 THEN content ELSE trim(split_part(content, '.', 2)) END"
_SHOWN = "CASE WHEN rank % 5 = 2 THEN concat('See: ', chunk_id, ' is not in the source') WHEN rank % 5 <> 4 THEN content END"


@pair(f""", j AS (SELECT r.query_id, c.chunk_id, CASE WHEN r.rank % 7 = 0 THEN 1 + r.query_id % 8 ELSE c.owner_id END AS asker, c.owner_id, r.rel, r.rank, c.content, {_SAID} AS said, {_SHOWN} AS shown FROM runs_v r JOIN chunks_v c ON c.version_id = r.cand_id)
SELECT query_id, chunk_id, CASE WHEN rel = 0 THEN 'MODEL_NONE' WHEN rank > 15 THEN 'CHUNK_NOT_SUBMITTED' WHEN position(said IN coalesce(shown, said)) = 0 THEN 'SENTENCE_NOT_IN_SNIPPET' WHEN asker <> owner_id THEN 'CHUNK_NOT_ACTIVE_OWNER' WHEN position(said IN content) = 0 THEN 'SENTENCE_NOT_IN_SOURCE' ELSE 'ACCEPTED' END AS status FROM j""")
def judge_verify(spark, sf_dir):
    """All chunks of all candidates with a sentence that a judge might give of them."""
    register(spark, sf_dir, "runs_v chunks_v")
    rows = spark.sql(f"SELECT r.query_id, r.rank, c.chunk_id, CASE WHEN r.rank % 7 = 0 THEN 1 + r.query_id % 8 ELSE c.owner_id END AS owner_id, r.rel > 0 AS found, {_SAID} AS sentence, {_SHOWN} AS snippet FROM runs_v r JOIN chunks_v c ON c.version_id = r.cand_id")
    return judgements.verified(rows, rows.where("rank <= 15"), spark.table("chunks_v")).select("query_id", "chunk_id", "status")


# Typed values

# The test tables hold hardly a date: each document's text gets four, some of months or days that there are not
_DATED = "concat(text, ' ', 1990 + doc_id % 45, ' ', 2000 + doc_id % 30, '-', doc_id % 14, ' ', 1995 + doc_id % 31, CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '/' END, doc_id % 13, CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '/' END, doc_id % 33, ' 12345')"


@pair(rf""", found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_DATED}, '{typed.DATE_STRING}', 1)) AS raw FROM documents),
parts AS (SELECT doc_id, raw, regexp_split_to_array(raw, '[-./]') AS p FROM found),
days AS (SELECT *, try_cast(concat(p[1], '-', lpad(coalesce(p[2], '1'), 2, '0'), '-', lpad(coalesce(p[3], '1'), 2, '0')) AS DATE) AS f FROM parts)
SELECT doc_id, raw, f AS first_day, CASE len(p) WHEN 3 THEN f WHEN 2 THEN last_day(f) ELSE (f + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE END AS last_day, CASE WHEN f IS NOT NULL THEN ['YEAR', 'YEAR_MONTH', 'FULL_DATE'][len(p)] END AS precision FROM days""")
def date_atoms(spark, sf_dir):
    """The date strings of all documents, each with its interval."""
    raws = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.expr(_DATED), F.lit(typed.DATE_STRING), 1))).alias("raw"))
    atoms = typed.date_atoms(raws.select("raw").distinct())
    return raws.join(atoms, "raw").select("doc_id", "raw", "first_day", "last_day", "precision")


@pair(typed.EVALUATE_DUCK)
def typed_evaluate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("value"))
    day = typed.compare_dates(F.col("day"), F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    amount = typed.compare_numbers(F.col("value"), "GTE", F.lit(100000.0))
    return orders.select("o_orderkey", day.alias("date_state"), amount.alias("amount_state"), typed.all_of(day, amount).alias("state"))


@pair("SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rel = 2 THEN 0 WHEN rel = 1 THEN 1 ELSE 2 END, rank) AS new_rank FROM runs_v")
def typed_partition(spark, sf_dir):
    state = F.when(F.col("rel") == 2, "SATISFIED").when(F.col("rel") == 1, "UNKNOWN").otherwise("CONTRADICTED")
    return typed.stable_partition(runs(table(spark, sf_dir, "embeddings")).withColumn("state", state), "query_id", "rank").select("query_id", "cand_id", "new_rank")


def _readings(rows: DataFrame, key: str, read) -> DataFrame:
    """One row per distinct reading; `meet` is what two readings must share to be compared."""
    meet = F.when(F.col("r.kind") == "QUANTITY", F.col("r.unit")).when(F.col("r.kind") == "DATE", F.lit("")).otherwise(F.col("r.name"))
    parts = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("kind", "op", "low", "high", "unit", "name", "qualifier", "direction")])
    return rows.select(key, F.explode(read("text")).alias("r")).select(key, parts.alias("r")).distinct().select(key, "r", F.concat_ws(":", "r.kind", meet).alias("meet"))


@pair(None)
def typed_query_parse(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(tv.constraints("text")).alias("r")).select("doc_id", "r.*")


@pair(None)
def typed_observations(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(tv.observations("text")).alias("r")).select("doc_id", "r.*")


@pair(None)
def typed_state(spark, sf_dir):
    """(item_id, doc_id, constraint_key, state) where a question's constraint meets a document's observation."""
    wanted = _readings(spark.createDataFrame(list(enumerate(typed.QUESTIONS)), "item_id long, text string"), "item_id", tv.constraints).withColumnRenamed("r", "c")
    had = _readings(docs(spark, sf_dir), "doc_id", tv.observations).withColumnRenamed("r", "o")
    each = wanted.join(had, "meet").select("item_id", "doc_id", F.to_json("c").alias("constraint_key"), typed.reading_state(F.col("c"), F.col("o")).alias("state"))
    best = F.when(F.max(F.col("state") == "SATISFIED"), "SATISFIED").when(F.max(F.col("state") == "CONTRADICTED"), "CONTRADICTED").otherwise("UNKNOWN")
    return each.groupBy("item_id", "doc_id", "constraint_key").agg(best.alias("state"))


@pair(None)
def evidence_selection(spark, sf_dir):
    """Children chosen by state: the questions in turn over the runs of every 50th vector, a candidate document being one passage."""
    asked = spark.createDataFrame(list(enumerate(typed.QUESTIONS)), "k long, query string")
    kids = structure.children(docs(spark, sf_dir), "doc_id").select(F.col("doc_id").alias("cand_id"), (F.col("ordinal").cast("long") * 1000 + F.col("part")).alias("child_no"), "content")
    ranked = runs(table(spark, sf_dir, "embeddings")).withColumn("k", F.expr("query_id div 50") % len(typed.QUESTIONS)).join(asked, "k").join(kids, "cand_id")
    return selection.select_evidence(ranked.select("query_id", "query", F.col("rank").alias("passage_rank"), "child_no", (F.col("cand_id") * 10_000_000 + F.col("child_no")).alias("child_id"), "content"))


# Relational family

same("latest_version", "SELECT d.document_id, l.version_id AS latest_id, l.status AS latest_status, a.version_id AS active_id FROM (SELECT DISTINCT document_id FROM versions_v) d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) AS rn FROM versions_v) l ON l.document_id = d.document_id AND l.rn = 1 LEFT JOIN versions_v a ON a.document_id = d.document_id AND a.status = 'ACTIVE'")
same("dispatch_anti_join", "SELECT v.document_id, v.version_id FROM versions_v v WHERE v.status = 'ACTIVE' AND NOT EXISTS (SELECT 1 FROM chunks_v c WHERE c.document_id = v.document_id AND c.version_id = v.version_id AND c.owner_id = v.owner_id AND c.chunk_no = 3)")
same("eligible_semi_join", "SELECT v.document_id, v.version_id FROM versions_v v WHERE EXISTS (SELECT 1 FROM document_tags_v t WHERE t.document_id = v.document_id AND t.owner_id = v.owner_id AND t.tag_id = 7)")
same("lineage_join", "SELECT c.chunk_id, v.version_no, t.tag_id, t.name FROM chunks_v c JOIN versions_v v ON v.document_id = c.document_id AND v.version_id = c.version_id AND v.owner_id = c.owner_id JOIN document_tags_v dt ON dt.document_id = v.document_id AND dt.owner_id = v.owner_id JOIN tags_v t ON t.tag_id = dt.tag_id WHERE v.status = 'ACTIVE'")
same("document_list", "SELECT version_id, source, status FROM versions_v WHERE lang = 'en' AND lower(source) LIKE '%src1%' AND status <> 'FAILED'")
@pair("SELECT tag_id, name, row_number() OVER (ORDER BY name <> 'NATION_1', owner_id IS NOT NULL, name, tag_id) AS pos FROM tags_v WHERE coalesce(owner_id, 3) = 3 AND contains(substr(name, 1), 'NATION_1') QUALIFY pos <= 20")
def tag_search(spark, sf_dir):
    """The 20 tags that a user may see whose name holds a text: the very name first, then the system's, then by name."""
    register(spark, sf_dir, "tags_v")
    return searched_tags(spark.table("tags_v"), "NATION_1", 3)


def searched_tags(tags: DataFrame, text: str, owner: int, k: int = 20) -> DataFrame:
    """(tag_id, name, pos) of at most k tags; the text is taken literally. A top-k in each task, then k rows are numbered."""
    own = tags.where((F.col("owner_id").isNull() | (F.col("owner_id") == owner)) & F.contains("name", F.lit(text)))
    order = [F.col("name") != text, F.col("owner_id").isNotNull(), "name", "tag_id"]
    best = own.orderBy(*order).limit(k)
    return best.select("tag_id", "name", F.row_number().over(Window.orderBy(*order)).alias("pos"))
same("tag_usage", "SELECT t.tag_id, t.name, count(DISTINCT dt.document_id) AS n_documents FROM tags_v t JOIN document_tags_v dt ON dt.tag_id = t.tag_id AND (t.owner_id IS NULL OR t.owner_id = dt.owner_id) GROUP BY t.tag_id, t.name")
same("tagged_documents", "SELECT DISTINCT dt.document_id FROM document_tags_v dt JOIN tags_v t ON t.tag_id = dt.tag_id WHERE dt.owner_id = 2 AND (t.owner_id IS NULL OR t.owner_id = 2) AND t.tag_id IN (1, 2, 3, 1001)")
same("next_version_no", "SELECT document_id, max(version_no) + 1 AS next_no FROM versions_v GROUP BY document_id")
same("status_remap", "SELECT version_id, CASE status WHEN 'ACTIVE' THEN 'SEARCHABLE' WHEN 'SUPERSEDED' THEN 'HISTORY' ELSE 'REJECTED' END AS state FROM versions_v")
same("in_flight_guard", "SELECT document_id, bool_or(status = 'FAILED') AS any_failed, bool_and(status <> 'ACTIVE') AS none_active FROM versions_v GROUP BY document_id")
same("progress_steps", "SELECT version_id, chunk_no, pct FROM (SELECT version_id, chunk_no, CAST(floor(chunk_no * 100 / n) AS BIGINT) AS pct, lag(CAST(floor(chunk_no * 100 / n) AS BIGINT)) OVER (PARTITION BY version_id ORDER BY chunk_no) AS before FROM (SELECT version_id, chunk_no, count(*) OVER (PARTITION BY version_id) AS n FROM chunks_v) a) b WHERE before IS NULL OR pct <> before")
same("chunk_renumber", "SELECT chunk_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY chunk_no) AS BIGINT) AS source_index FROM chunks_v")
same("set_equality", "SELECT coalesce(a.document_id, b.document_id) AS document_id FROM (SELECT DISTINCT document_id FROM versions_v WHERE status = 'ACTIVE') a FULL OUTER JOIN (SELECT DISTINCT document_id FROM chunks_v WHERE chunk_no = 1) b ON a.document_id = b.document_id WHERE a.document_id IS NULL OR b.document_id IS NULL")
same("constraint_violations", "SELECT 'unique_chunk' AS rule, count(*) AS n FROM (SELECT version_id, chunk_no FROM chunks_v GROUP BY version_id, chunk_no HAVING count(*) > 1) a UNION ALL SELECT 'one_active', count(*) FROM (SELECT document_id FROM versions_v WHERE status = 'ACTIVE' GROUP BY document_id HAVING count(*) > 1) b UNION ALL SELECT 'status_enum', count(*) FROM versions_v WHERE status NOT IN ('ACTIVE', 'FAILED', 'SUPERSEDED') UNION ALL SELECT 'tag_orphan', count(*) FROM document_tags_v t WHERE NOT EXISTS (SELECT 1 FROM tags_v g WHERE g.tag_id = t.tag_id)")
same("upsert_do_nothing", "SELECT document_id, tag_id FROM document_tags_v UNION SELECT n.document_id, 3 AS tag_id FROM versions_v n WHERE n.version_no = 1 AND NOT EXISTS (SELECT 1 FROM document_tags_v t WHERE t.document_id = n.document_id AND t.tag_id = 3)")

# Ranking, fusion and result sets

same("top_per_document", "SELECT query_id, cand_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY rank) AS rn FROM runs_v) a WHERE rn <= 2 AND rank <= 10")
same("presentation_dedup", "SELECT query_id, cand_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY rank) AS rn FROM runs_v) a WHERE rn = 1")
same("merge_candidates", "SELECT query_id, cand_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cand_id ORDER BY score DESC, side) AS rn FROM (SELECT query_id, cand_id, score, 0 AS side FROM runs_v WHERE rank <= 10 UNION ALL SELECT query_id, cand_id, score + CASE WHEN rel = 2 THEN 0.01 ELSE 0 END, 1 FROM runs_v WHERE rank > 5) u) m WHERE rn = 1")
same("synthetic_scores", "SELECT query_id, cand_id, round(0.50 + 0.04 * (count(*) OVER (PARTITION BY query_id) - rank), 6) AS score FROM runs_v")
same("top2_document_rank", "SELECT query_id, group_id, round(avg(score), 6) AS score, min(rank) AS best, CAST(row_number() OVER (PARTITION BY query_id ORDER BY avg(score) DESC, min(rank), group_id) AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY rank) AS rn FROM runs_v) a WHERE rn <= 2 GROUP BY query_id, group_id")

# Evaluation

same("metrics_summary", "SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS recall20, round(avg(CASE WHEN direct THEN 1.0 ELSE 0.0 END), 6) AS direct_recall20, round(avg(p5), 6) AS precision5, round(avg(coalesce(CAST(1 AS DOUBLE) / first_direct, 0)), 6) AS mrr FROM (SELECT query_id, bool_or(rel >= 1) AS hit, bool_or(rel = 2) AS direct, sum(CASE WHEN rank <= 5 AND rel >= 1 THEN 1 ELSE 0 END) / CAST(5 AS DOUBLE) AS p5, min(CASE WHEN rel = 2 THEN rank END) AS first_direct FROM runs_v GROUP BY query_id) q")
same("metrics_grouping_sets", "SELECT split, category, count(DISTINCT query_id) AS n_queries, sum(CASE WHEN rel = 2 THEN 1 ELSE 0 END) AS n_direct, round(avg(score), 6) AS mean_score FROM runs_v GROUP BY GROUPING SETS ((), (split), (category))")
same("ndcg_at5", "SELECT a.query_id, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg FROM (SELECT query_id, sum(CASE WHEN rn = 1 THEN (power(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY rank) AS rn FROM runs_v) x WHERE rank <= 5 GROUP BY query_id) a JOIN (SELECT query_id, sum((power(2, best) - 1) / log2(pos + 1)) AS ideal FROM (SELECT query_id, best, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, group_id) AS pos FROM (SELECT query_id, group_id, max(rel) AS best FROM runs_v GROUP BY query_id, group_id) g) i WHERE pos <= 5 GROUP BY query_id) b ON a.query_id = b.query_id")
same("percentile_nearest_rank", "SELECT split, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY score), 6) AS p50, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY score), 6) AS p95, round(min(score), 6) AS low, round(max(score), 6) AS high FROM runs_v GROUP BY split")
same("micro_macro", "SELECT round((SELECT avg(CAST(rel AS DOUBLE)) FROM runs_v), 6) AS micro, round(avg(m), 6) AS macro FROM (SELECT category, avg(CAST(rel AS DOUBLE)) AS m FROM runs_v GROUP BY category) c")
same("confusion_f1", "SELECT label, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1 FROM (SELECT l.label, sum(CASE WHEN rel = l.label AND guess = l.label THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN rel <> l.label AND guess = l.label THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN rel = l.label AND guess <> l.label THEN 1 ELSE 0 END) AS fn FROM (SELECT rel, CASE WHEN rank <= 5 THEN 2 WHEN rank <= 10 THEN 1 ELSE 0 END AS guess FROM runs_v) r CROSS JOIN (VALUES (0), (1), (2)) AS l(label) GROUP BY l.label) t")
same("coverage_at_k", "SELECT k, round(count(DISTINCT CASE WHEN rank <= k AND rel >= 1 THEN query_id * 1000 + group_id END) / CAST(count(DISTINCT CASE WHEN rel >= 1 THEN query_id * 1000 + group_id END) AS DOUBLE), 6) AS coverage FROM runs_v CROSS JOIN (VALUES (1), (5), (10), (20)) AS t(k) GROUP BY k")
same("duplicate_ratio", "SELECT round(1 - sum(u) / CAST(sum(n) AS DOUBLE), 6) AS ratio FROM (SELECT query_id, count(*) AS n, count(DISTINCT group_id) AS u FROM runs_v WHERE rank <= 10 GROUP BY query_id) q")
same("length_histogram", "SELECT CASE WHEN n <= 10 THEN '01-10' WHEN n <= 20 THEN '11-20' WHEN n <= 40 THEN '21-40' WHEN n <= 80 THEN '41-80' ELSE '81+' END AS bucket, count(*) AS n FROM (SELECT length(content) / 20 AS n FROM chunks_v) c GROUP BY 1")
same("interval_cover_join", "SELECT a.chunk_id, count(*) AS n_spans FROM (SELECT chunk_id, version_id, (chunk_no - 1) * 680 AS lo, (chunk_no - 1) * 680 + length(content) AS hi FROM chunks_v) a JOIN (SELECT version_id, chunk_no * 500 AS lo, chunk_no * 500 + 60 AS hi FROM chunks_v) b ON a.version_id = b.version_id AND a.lo <= b.lo AND b.hi <= a.hi GROUP BY a.chunk_id")
same("interval_overlap_join", "SELECT a.chunk_id, count(*) AS n_spans, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS shared FROM (SELECT chunk_id, version_id, (chunk_no - 1) * 680 AS lo, (chunk_no - 1) * 680 + length(content) AS hi FROM chunks_v) a JOIN (SELECT version_id, chunk_no * 500 AS lo, chunk_no * 500 + 60 AS hi FROM chunks_v) b ON a.version_id = b.version_id AND a.lo < b.hi AND b.lo < a.hi GROUP BY a.chunk_id")
same("localization_iou", "SELECT version_id, sum(hi - lo) AS covered, count(*) AS n_islands FROM (SELECT version_id, island, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY version_id ORDER BY lo, hi) AS island FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY version_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (SELECT version_id, chunk_no * 700 AS lo, chunk_no * 700 + length(content) AS hi FROM chunks_v) s) a) b GROUP BY version_id, island) c GROUP BY version_id")


_DELTAS_D = """, d AS (SELECT query_id // 100 AS cluster, query_id, max((rank <= 5)::INT * rel / 2.0) - max((rank <= 1)::INT * rel / 2.0) AS delta FROM runs_v GROUP BY query_id),
c AS (SELECT cluster, {0} FROM d GROUP BY cluster),
x AS (SELECT cluster, total, weight, s, (cluster % 2147483647 * 1000003 + s * 7919 + 42042) % 2147483647 AS x FROM c, range(10000) r(s)),
z AS (SELECT *, (y * y + x) % 2147483647 AS r FROM (SELECT *, (x * x + 12345) % 2147483647 * 48271 % 2147483647 AS y FROM x)),
w AS (SELECT s, sum(total * n) AS t, sum(weight * n) AS v FROM (SELECT *, {1} AS n FROM z) GROUP BY s),
m AS (SELECT list(t::DOUBLE / v::DOUBLE / 1000000 ORDER BY t::DOUBLE / v::DOUBLE / 1000000) AS l FROM w WHERE v > 0)
SELECT (SELECT count(*) FROM c) AS n_clusters, (SELECT round(sum(total)::DOUBLE / sum(weight)::DOUBLE / 1000000, 6) FROM c) AS mean, round(l[floor(0.025 * (len(l) - 1))::BIGINT + 1], 6) AS low, round(l[floor(0.975 * (len(l) - 1))::BIGINT + 1], 6) AS high FROM m"""
_COPIES_D = " + ".join(f"(r >= {t})::INT" for t in bootstrap.STEPS)


def _deltas(spark, sf_dir) -> DataFrame:
    """(cluster, delta) of every 50th vector as query; two queries in a row are one user's."""
    half = lambda k: F.max((F.col("rank") <= k).cast("int") * F.col("rel") / 2)
    per = runs(table(spark, sf_dir, "embeddings")).groupBy("query_id").agg((half(5) - half(1)).alias("delta"))
    return per.select(F.expr("query_id div 100").alias("cluster"), "delta")


def _interval(clusters: DataFrame) -> DataFrame:
    return bootstrap.interval(clusters).select("n_clusters", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@pair(_DELTAS_D.format("round(avg(delta) * 1000000)::BIGINT AS total, 1::BIGINT AS weight", _COPIES_D))
def bootstrap_ci(spark, sf_dir):
    """Paired bootstrap of users that count alike: 10,000 samples, 95 % interval of the mean difference."""
    return _interval(bootstrap.by_user(_deltas(spark, sf_dir)))


@pair(_DELTAS_D.format("sum(round(delta * 1000000)::BIGINT)::BIGINT AS total, count(*) AS weight", _COPIES_D))
def bootstrap_by_query(spark, sf_dir):
    """The same of users that count by their queries, as the robustness gate has it."""
    return _interval(bootstrap.by_query(_deltas(spark, sf_dir)))


# Jobs

@pair("SELECT job_id, event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM job_events_v WHERE kind = 'ENQUEUE') e WHERE rn = 1")
def claim_order(spark, sf_dir):
    register(spark, sf_dir, "job_events_v")
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    first = spark.table("job_events_v").where("kind = 'ENQUEUE'").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return jobs.ranked_by_time(first.select("job_id", "event_id", "ts"), "ts", "event_id", "pos").drop("ts")

same("outbox_dispatch", "SELECT job_id, min(event_id) AS event_id, count(*) AS n_seen FROM job_events_v WHERE kind = 'ENQUEUE' GROUP BY job_id")
same("retry_schedule", "SELECT event_id, job_id, n, CASE n WHEN 1 THEN ts + INTERVAL '1' MINUTE WHEN 2 THEN ts + INTERVAL '5' MINUTE WHEN 3 THEN ts + INTERVAL '15' MINUTE END AS next_at FROM (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS BIGINT) AS n FROM job_events_v WHERE kind = 'FAIL') f WHERE n <= 4")
same("progress_last_value", "SELECT job_id, max_by(value, event_id) AS last_value, max(ts) AS last_ts, count(*) AS n FROM job_events_v WHERE kind = 'RENEW' GROUP BY job_id")
same("activation_pointer", "SELECT job_id, max_by(event_id, event_id) AS active_event FROM job_events_v WHERE kind = 'COMPLETE' GROUP BY job_id")
same("generation_lifecycle", "SELECT event_id, job_id, CASE WHEN rn = 1 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, before IS NOT DISTINCT FROM CAST(NULL AS BIGINT) AS first_swap FROM (SELECT event_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn, lag(event_id) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM job_events_v WHERE kind = 'COMPLETE') g")
same("hourly_windows", "SELECT date_trunc('hour', ts) AS start, kind, count(*) AS n FROM job_events_v GROUP BY 1, 2")


_FOLD_D = """, ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS o FROM job_events_v),
folded AS (SELECT DISTINCT job_id, 0::BIGINT AS o, NULL::VARCHAR AS st, 0::BIGINT AS f, 0::BIGINT AS n, 0::BIGINT AS rej, NULL::TIMESTAMP AS until, NULL::TIMESTAMP AS due FROM ev
 UNION ALL SELECT job_id, o, CASE WHEN NOT ok THEN st WHEN kind = 'ENQUEUE' THEN 'READY' WHEN kind IN ('CLAIM', 'RENEW') THEN 'RUNNING' WHEN kind = 'COMPLETE' THEN 'COMPLETED' WHEN n < 3 THEN 'RETRY_WAIT' ELSE 'FAILED' END,
  f + (ok AND kind = 'CLAIM')::INT, CASE WHEN ok AND kind = 'ENQUEUE' THEN 0 WHEN ok AND kind = 'FAIL' AND n < 3 THEN n + 1 ELSE n END, rej + (NOT ok)::INT,
  CASE WHEN NOT ok THEN until WHEN kind IN ('CLAIM', 'RENEW') THEN ts + INTERVAL 600 MINUTE END, CASE WHEN NOT ok THEN due WHEN kind = 'FAIL' AND n < 3 THEN ts + to_minutes([1, 5, 15][n + 1]) END
 FROM (SELECT w.*, e.ts, e.kind, e.o AS next, coalesce(CASE e.kind WHEN 'ENQUEUE' THEN w.st IS NULL OR w.st IN ('COMPLETED', 'FAILED') WHEN 'CLAIM' THEN w.st = 'READY' OR (w.st = 'RETRY_WAIT' AND w.due <= e.ts) OR (w.st = 'RUNNING' AND w.until < e.ts) ELSE w.st = 'RUNNING' AND w.until >= e.ts END, false) AS ok
  FROM folded w JOIN ev e ON e.job_id = w.job_id AND e.o = w.o + 1) x(job_id, before, st, f, n, rej, until, due, ts, kind, o, ok)),
job AS (SELECT job_id, st AS status, f AS fence, n AS retries, rej AS rejected, until AS lease_until, due AS next_retry FROM folded QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY o DESC) = 1)"""


@pair(_FOLD_D + " SELECT * FROM job")
def job_fold(spark, sf_dir):
    register(spark, sf_dir, "job_events_v")
    return jobs.fold(spark.table("job_events_v"))


@pair(_FOLD_D + " SELECT job_id, CASE WHEN retries < 3 THEN 'RETRY_WAIT' ELSE 'FAILED' END AS status, fence + 1 AS fence, retries FROM job WHERE status = 'RUNNING' AND lease_until < TIMESTAMP '2025-01-01'")
def job_recovery(spark, sf_dir):
    return jobs.expired(job_fold(spark, sf_dir), F.lit("2025-01-01").cast("timestamp_ntz")).select("job_id", "status", "fence", "retries")



_WALK = """, ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS o FROM job_events_v),
ends AS (SELECT *, 'END' AS kind FROM (SELECT job_id, max(o) + 1 AS o, (SELECT date_trunc('millisecond', max(ts)) FROM job_events_v) AS ts FROM ev GROUP BY job_id)),
steps AS (SELECT job_id, o, ts, kind FROM ev UNION ALL SELECT job_id, o, ts, kind FROM ends),
walk AS (SELECT job_id, 0::BIGINT AS o, NULL::VARCHAR AS st, 0::BIGINT AS f, 0::BIGINT AS n, 0::BIGINT AS rej, NULL::TIMESTAMP AS until, NULL::TIMESTAMP AS due, 0::BIGINT AS lost, 0::BIGINT AS gone, 0::BIGINT AS held FROM ends
 UNION ALL SELECT job_id, o, CASE WHEN ok AND kind = 'ENQUEUE' THEN 'READY' WHEN ok AND kind = 'CLAIM' THEN 'RUNNING' WHEN ok AND kind = 'COMPLETE' THEN 'COMPLETED' WHEN ok AND kind = 'FAIL' THEN CASE WHEN n < 3 THEN 'RETRY_WAIT' ELSE 'FAILED' END ELSE st END,
  f + (ok AND kind = 'CLAIM')::INT, CASE WHEN ok AND kind = 'ENQUEUE' THEN 0 WHEN ok AND kind = 'FAIL' AND n < 3 THEN n + 1 ELSE n END, rej + (NOT ok AND kind <> 'END')::INT,
  CASE WHEN ok AND kind IN ('CLAIM', 'RENEW') THEN ts + INTERVAL 600 MINUTE WHEN ok THEN NULL ELSE until END, CASE WHEN ok AND kind = 'FAIL' AND n < 3 THEN ts + to_minutes([1, 5, 15][n + 1]) WHEN ok THEN NULL ELSE due END, lost, gone,
  CASE WHEN ok AND kind = 'RENEW' THEN held + 1 WHEN ok AND kind = 'CLAIM' THEN held WHEN ok THEN 0 ELSE held END
 FROM (SELECT *, CASE kind WHEN 'ENQUEUE' THEN st IS NULL OR st IN ('COMPLETED', 'FAILED') WHEN 'CLAIM' THEN coalesce(st = 'READY' OR (st = 'RETRY_WAIT' AND due <= ts), false) WHEN 'END' THEN false ELSE coalesce(st = 'RUNNING', false) END AS ok FROM (
  SELECT job_id, o, ts, kind, CASE WHEN due2 < ts THEN 'READY' ELSE st2 END AS st, f2 AS f, n2 AS n, rej, CASE WHEN st2 = 'RUNNING' THEN until END AS until, CASE WHEN due2 >= ts THEN due2 END AS due, lost2 AS lost, gone2 AS gone, held2 AS held FROM (
   SELECT w.job_id, s.o, s.ts, s.kind, w.rej, w.until, late, CASE WHEN late THEN CASE WHEN w.n < 3 THEN 'RETRY_WAIT' ELSE 'FAILED' END ELSE w.st END AS st2, w.f + late::INT AS f2, w.n + (late AND w.n < 3)::INT AS n2,
    CASE WHEN late AND w.n < 3 THEN w.until + to_minutes([1, 5, 15][w.n + 1]) WHEN NOT late AND w.st = 'RETRY_WAIT' THEN w.due END AS due2, w.lost + late::INT AS lost2, w.gone + CASE WHEN late THEN w.held ELSE 0 END AS gone2, CASE WHEN late THEN 0 ELSE w.held END AS held2
   FROM walk w JOIN steps s ON s.job_id = w.job_id AND s.o = w.o + 1, LATERAL (SELECT coalesce(w.st = 'RUNNING' AND w.until < s.ts, false) AS late) l) a) b) c)
SELECT w.job_id, st AS status, f AS fence, n AS retries, rej AS rejected, lost AS expired, gone AS dropped FROM walk w JOIN ends e ON e.job_id = w.job_id AND e.o = w.o"""


def lease_recovery(spark, sf_dir):
    """Jobs with every deadline before the last event carried out: lost workers shut out, their pieces dropped, retries due."""
    register(spark, sf_dir, "job_events_v")
    events = spark.table("job_events_v")
    last = events.agg(F.date_trunc("millisecond", F.max("ts"))).first()[0]
    return leases.recovered(events, last.replace(tzinfo=None))


def stream_leased_jobs(spark, sf_dir):
    """The same by timers of a stream."""
    return runner.leased_jobs(spark, f"{sf_dir}/events.parquet")


for _f in (lease_recovery, stream_leased_jobs):
    QUERIES[_f.__name__], ORACLE[_f.__name__] = _f, DUCK + _WALK

# Composite policies over ranked runs

same("keep_first_union", "SELECT query_id, cand_id, arm FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cand_id ORDER BY arm, rank) AS rn FROM (SELECT query_id, cand_id, rank, 0 AS arm FROM runs_v WHERE rank <= 8 UNION ALL SELECT query_id, cand_id, rank, 1 FROM runs_v WHERE rel >= 1) u) m WHERE rn = 1")
same("legacy_dense", "SELECT query_id, cand_id, rank FROM runs_v WHERE rank <= 5")
same("evidence_by_folder", "SELECT source, lang, count(*) AS n, min(version_id) AS first_id FROM versions_v WHERE status = 'ACTIVE' GROUP BY source, lang")
same("score_distribution", "SELECT category, count(*) AS n, round(min(score), 6) AS low, round(avg(score), 6) AS mean, round(max(score), 6) AS high FROM runs_v GROUP BY category")
same("aspect_coverage", "SELECT query_id, bool_or(group_id % 3 = 0) AND bool_or(group_id % 3 = 1) AS all_met, CASE WHEN count(DISTINCT group_id % 3) >= 2 THEN true ELSE false END AS two_met FROM runs_v WHERE rel >= 1 GROUP BY query_id")
same("gate_decision", "SELECT CASE WHEN delta < -0.05 THEN 'NO_GO' WHEN delta >= 0.02 THEN 'ADOPT' ELSE 'NEEDS_ADJUSTMENT' END AS decision FROM (SELECT avg(CASE WHEN split = 'TEST' THEN CAST(rel AS DOUBLE) END) - avg(CASE WHEN split = 'TUNING' THEN CAST(rel AS DOUBLE) END) AS delta FROM runs_v) g")
same("decision_metrics", "SELECT split, round(sum(CASE WHEN top = 2 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS top1_direct, sum(CASE WHEN best = 0 THEN 1 ELSE 0 END) AS rejected FROM (SELECT split, query_id, max(CASE WHEN rank = 1 THEN rel END) AS top, max(rel) AS best FROM runs_v GROUP BY split, query_id) q GROUP BY split")
same("neighbour_expansion", "SELECT a.chunk_id, count(b.chunk_id) AS n_neighbours, max(length(b.content)) AS longest FROM chunks_v a LEFT JOIN chunks_v b ON a.version_id = b.version_id AND b.chunk_no BETWEEN a.chunk_no - 1 AND a.chunk_no + 1 AND b.chunk_no <> a.chunk_no GROUP BY a.chunk_id")
same("claim_windows", "SELECT chunk_id, md5(concat(coalesce(lag(content) OVER (PARTITION BY version_id ORDER BY chunk_no), ''), '|', content)) AS back, md5(concat(content, '|', coalesce(lead(content) OVER (PARTITION BY version_id ORDER BY chunk_no), ''))) AS ahead FROM chunks_v")
same("chunk_windows", "SELECT version_id, chunk_no, w, sum(length(content)) AS n_chars FROM (SELECT a.version_id, a.chunk_no, s.w, b.content FROM chunks_v a CROSS JOIN (VALUES (1), (2), (3)) AS s(w) JOIN chunks_v b ON b.version_id = a.version_id AND b.chunk_no >= a.chunk_no AND b.chunk_no < a.chunk_no + s.w) x GROUP BY version_id, chunk_no, w HAVING count(*) = w")
same("embedding_reuse_plan", "SELECT c.chunk_id, CASE WHEN r.first_id IS NULL OR r.first_id = c.chunk_id THEN 'COMPUTE' ELSE 'REUSE' END AS action, coalesce(r.first_id, c.chunk_id) AS source_id FROM chunks_v c LEFT JOIN (SELECT owner_id, md5(content) AS h, min(chunk_id) AS first_id FROM chunks_v GROUP BY owner_id, md5(content)) r ON r.owner_id = c.owner_id AND r.h = md5(c.content)")
same("delete_guard", "SELECT d.document_id FROM (SELECT DISTINCT document_id FROM versions_v) d WHERE NOT EXISTS (SELECT 1 FROM versions_v v WHERE v.document_id = d.document_id AND v.status = 'FAILED')")
@pair("SELECT job_id, event_id, CAST(row_number() OVER (ORDER BY due, event_id) AS BIGINT) AS pos FROM (SELECT job_id, event_id, ts + INTERVAL '5' MINUTE AS due FROM job_events_v WHERE kind = 'FAIL') f WHERE due <= TIMESTAMP '2024-01-15 00:00:00'")
def outbox_poll(spark, sf_dir):
    register(spark, sf_dir, "job_events_v")
    due = spark.sql("SELECT job_id, event_id, ts + INTERVAL '5' MINUTE AS due FROM job_events_v WHERE kind = 'FAIL' AND ts + INTERVAL '5' MINUTE <= TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return jobs.ranked_by_time(due, "due", "event_id", "pos").drop("due")


same("supersede_on_swap", "SELECT job_id, event_id, lead(event_id) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS superseded_by FROM job_events_v WHERE kind = 'COMPLETE'")
same("version_segments", "SELECT p_partkey, concat(CAST(p_size AS STRING), '.', CAST(p_partkey % 3 AS STRING)) AS version, p_size >= 10 AND p_partkey % 3 > 0 AS newer FROM part")


@pair("SELECT event_id, 0::BIGINT AS pos, 'k' AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_ordinality(spark, sf_dir):
    props = F.from_json("props", "map<string,bigint>")
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(F.map_entries(props)).alias("pos", "e")).select("event_id", F.col("pos").cast("long").alias("pos"), F.col("e.key").alias("name"), F.col("e.value").alias("value"))


_CORE = f"list_distinct(list_filter({_TOKENS_D}, lambda t: length(t) >= 6))"


@pair(f""", q AS (SELECT item_id, unnest({_CORE}) AS t FROM benchmark), n AS (SELECT item_id, count(*) AS need FROM q GROUP BY 1),
d AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest({_TOKENS_D}) AS t FROM documents)), h AS (SELECT item_id, doc_id, count(*) AS had FROM q JOIN d USING (t) GROUP BY ALL)
SELECT item_id, doc_id, had, round(had / need, 6) AS coverage FROM h JOIN n USING (item_id) WHERE had * 2 >= need""")
def term_coverage(spark, sf_dir):
    core = F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda t: F.length(t) >= 6))
    items = table(spark, sf_dir, "benchmark").select("item_id", core.alias("core"))
    need = items.select("item_id", F.size("core").alias("need"))
    d = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("t"))
    had = items.select("item_id", F.explode("core").alias("t")).join(d, "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("had"))
    return had.join(need, "item_id").where("had * 2 >= need").select("item_id", "doc_id", "had", F.round(F.col("had") / F.col("need"), 6).alias("coverage"))
