"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, html_text, imatch, line_dedup, merkle, ngram_join, packing, quality, ranked_search, substring_dedup, token_counts, warc
from .common import new_path

try:
    import public_tokenizers as _tokenizers
except ImportError:  # only the three queries that read vocabularies need it
    _tokenizers = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path, _tokenizers.PATTERN), path)
    ids = F.concat_ws(",", F.transform("ids", lambda x: x.cast("string")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(_table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = {"n_chars": F.col("n_chars") + F.when(merkle.tampered(F.col("doc_id")), 1).otherwise(0)}
    return merkle.verify(merkle.manifest(_table(spark, sf_dir, "documents"), changed=changed))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_extraction, op2_quality_classifier, op3_substring_dedup, op4_byte_bpe, op5_ngram_join, op6_embedding_dedup, op7_warc, op8_imatch, op9_token_counts, op10_packing, op11_ranked_search, op12_merkle_manifest, op13_line_dedup)}

_REACH = """
        reach AS (SELECT id, id AS root FROM nodes UNION SELECT e.y, r.root FROM reach r JOIN linked e ON e.x = r.id),
        ends AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

ORACLE: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run FROM w, unnest(range(1, len(ws) - 11)) t(i)),
        f AS (SELECT run, min(doc_id) AS lowest FROM s GROUP BY run),
        gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM s JOIN f USING (run), unnest(range(0, 13)) t(k) WHERE lowest < doc_id),
        words AS (SELECT doc_id, pos, ws[pos] AS word FROM w, unnest(range(1, len(ws) + 1)) t(pos)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op5_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
        size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        linked AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        nodes AS (SELECT doc_id AS id FROM documents),{_REACH}
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN size USING (doc_id) JOIN ends ON id = doc_id""",
    "op6_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x : x <> 0)) > 0),
        linked AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE false END),
        nodes AS (SELECT vec_id AS id FROM embeddings),{_REACH},
        degree AS (SELECT x, count(*) AS n FROM linked GROUP BY x)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN ends ON id = vec_id LEFT JOIN degree ON x = vec_id""",
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN original END AS refers_to
        FROM m""",
    "op11_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        total AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
        p AS (SELECT doc_id, len(ts) AS n, term, count(*) AS tf FROM d, unnest(ts) t(term) GROUP BY ALL),
        f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY term, n_docs),
        s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
              FROM q JOIN f USING (term) JOIN p USING (term), total GROUP BY ALL HAVING score > 0),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE crc_table AS (SELECT list(list_reduce([i] || range(8), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        crc AS (SELECT doc_id, doc_id IS NOT NULL AND xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch : ascii(ch)::BIGINT),
                lambda c, b : xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit FROM (SELECT DISTINCT doc_id FROM documents), crc_table),
        fields AS (SELECT d.doc_id, lang, n_chars, coalesce(hit, false) AS hit, coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
                   coalesce(strlen(text) || ':' || text, '-') AS b FROM documents d LEFT JOIN crc ON crc.doc_id IS NOT DISTINCT FROM d.doc_id),
        leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf,
                   sha256(a || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || b) AS claimed FROM fields),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
        tree AS (SELECT g, 0 AS level, pos, leaf AS digest, n FROM placed
                 UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, level, pos // 2, n),
        subs AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        top AS (SELECT 0 AS level, pos, subroot AS digest, n FROM subs
                UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
        low_steps AS (SELECT p.g, p.pos, t.level AS k, (p.pos >> t.level) & 1 AS side, s.digest AS sibling FROM placed p
                  JOIN tree t ON t.g = p.g AND t.n > 1 AND t.pos = p.pos >> t.level LEFT JOIN tree s ON s.g = t.g AND s.level = t.level AND s.pos = xor(t.pos, 1)),
        top_steps AS (SELECT p.g, 1000 + t.level AS k, (p.pos >> t.level) & 1 AS side, s.digest AS sibling FROM subs p
                  JOIN top t ON t.n > 1 AND t.pos = p.pos >> t.level LEFT JOIN top s ON s.level = t.level AND s.pos = xor(t.pos, 1)),
        steps AS (SELECT * FROM low_steps UNION ALL SELECT p.g, p.pos, k, side, sibling FROM placed p JOIN top_steps USING (g)),
        proofs AS (SELECT g, pos, list({'side': side, 'sibling': sibling} ORDER BY k) AS path, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof_sha256 FROM steps GROUP BY g, pos),
        fold AS (SELECT g, pos, 0 AS k, claimed AS digest, path FROM placed LEFT JOIN proofs USING (g, pos)
                 UNION ALL SELECT g, pos, k + 1, sha256(CASE WHEN path[k + 1].sibling IS NULL THEN digest WHEN path[k + 1].side = 1 THEN path[k + 1].sibling || digest ELSE digest || path[k + 1].sibling END), path FROM fold WHERE k < coalesce(len(path), 0)),
        root AS (SELECT digest AS root FROM top WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, digest AS folded_root, digest = root AS verified
        FROM placed JOIN subs USING (g) LEFT JOIN proofs ON proofs.g = placed.g AND proofs.pos = placed.pos JOIN fold ON fold.g = placed.g AND fold.pos = placed.pos AND k = coalesce(len(proofs.path), 0), root""",
    "op13_line_dedup": r"""
        WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                   FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
        k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
        FROM l LEFT JOIN k USING (key) GROUP BY doc_id""",
}
