"""Second formulations for queries that are plain SQL: the oracle reaches the same rows on another way.

Windows stand against correlated counts and lists, joins against set operations, merged intervals against single points.
"""

from __future__ import annotations

from .corpus import DUCK
from .queries import ORACLE

_LISTS = "(SELECT query_id, list(rel ORDER BY rank) AS r, list(group_id ORDER BY rank) AS g FROM runs_v GROUP BY query_id)"
_SPANS = "SELECT version_id, chunk_no * 700 AS lo, chunk_no * 700 + length(content) AS hi FROM chunks_v"
_JOBS = "(SELECT *, list(event_id ORDER BY ts, event_id) OVER (PARTITION BY job_id) AS seq FROM job_events_v WHERE kind = '{0}')"

SECOND = {
    # ranking
    "top_per_document": "SELECT query_id, cand_id, rank FROM runs_v a WHERE rank <= 10 AND (SELECT count(*) FROM runs_v b WHERE b.query_id = a.query_id AND b.group_id = a.group_id AND b.rank < a.rank) < 2",
    "presentation_dedup": "SELECT query_id, arg_min(cand_id, rank) AS cand_id, min(rank) AS rank FROM runs_v GROUP BY query_id, group_id",
    "merge_candidates": "SELECT query_id, cand_id, round(max(CASE WHEN rank > 5 AND rel = 2 THEN score + 0.01 ELSE score END), 6) AS score FROM runs_v GROUP BY query_id, cand_id",
    "synthetic_scores": "SELECT query_id, cand_id, round(0.50 + 0.04 * (n - rank), 6) AS score FROM runs_v JOIN (SELECT query_id, count(*) AS n FROM runs_v GROUP BY query_id) USING (query_id)",
    "top2_document_rank": """, d AS (SELECT query_id, group_id, list_avg(list(score ORDER BY rank)[1:2]) AS s, min(rank) AS best FROM runs_v GROUP BY query_id, group_id)
SELECT query_id, group_id, round(s, 6) AS score, best, (SELECT 1 + count(*) FROM d e WHERE e.query_id = d.query_id AND (e.s > d.s OR (e.s = d.s AND (e.best < d.best OR (e.best = d.best AND e.group_id < d.group_id))))) AS rank FROM d""",
    "keep_first_union": "SELECT query_id, cand_id, CASE WHEN rank <= 8 THEN 0 ELSE 1 END AS arm FROM runs_v WHERE rank <= 8 OR rel >= 1",
    "chunk_renumber": "SELECT chunk_id, (SELECT count(*) FROM chunks_v b WHERE b.version_id = a.version_id AND b.chunk_no <= a.chunk_no) AS source_index FROM chunks_v a",
    # metrics
    "metrics_summary": f"SELECT round(count(*) FILTER (list_max(r) >= 1) / count(*), 6) AS recall20, round(count(*) FILTER (list_contains(r, 2)) / count(*), 6) AS direct_recall20, round(avg(len(list_filter(r[1:5], lambda x : x >= 1)) / 5), 6) AS precision5, round(avg(coalesce(1 / nullif(list_position(r, 2), 0), 0)), 6) AS mrr FROM {_LISTS}",
    "metrics_grouping_sets": """, one AS (SELECT query_id, split, category, count(*) FILTER (rel = 2) AS d, sum(score) AS s, count(*) AS n FROM runs_v GROUP BY ALL)
SELECT NULL AS split, NULL AS category, count(*) AS n_queries, sum(d) AS n_direct, round(sum(s) / sum(n), 6) AS mean_score FROM one UNION ALL SELECT split, NULL, count(*), sum(d), round(sum(s) / sum(n), 6) FROM one GROUP BY split UNION ALL SELECT NULL, category, count(*), sum(d), round(sum(s) / sum(n), 6) FROM one GROUP BY category""",
    "ndcg_at5": f"""SELECT query_id, round(CASE WHEN ideal = 0 THEN 0 ELSE dcg / ideal END, 6) AS ndcg FROM (
 SELECT query_id, coalesce(list_sum(list_transform(range(1, least(5, len(r)) + 1), lambda i : CASE WHEN list_contains(g[1:i - 1], g[i]) THEN 0 ELSE (power(2, r[i]) - 1) / log2(i + 1) END)), 0) AS dcg FROM {_LISTS})
JOIN (SELECT query_id, list_sum(list_transform(range(1, least(5, len(b)) + 1), lambda i : (power(2, b[i]) - 1) / log2(i + 1))) AS ideal FROM (SELECT query_id, list(best ORDER BY best DESC) AS b FROM (SELECT query_id, max(rel) AS best FROM runs_v GROUP BY query_id, group_id) GROUP BY query_id)) USING (query_id)""",
    "percentile_nearest_rank": "SELECT split, round(s[ceil(0.5 * len(s))::INT], 6) AS p50, round(s[ceil(0.95 * len(s))::INT], 6) AS p95, round(s[1], 6) AS low, round(s[-1], 6) AS high FROM (SELECT split, list(score ORDER BY score) AS s FROM runs_v GROUP BY split)",
    "micro_macro": ", c AS (SELECT category, sum(rel)::DOUBLE AS s, count(*) AS n FROM runs_v GROUP BY category) SELECT round(sum(s) / sum(n), 6) AS micro, round(sum(s / n) / count(*), 6) AS macro FROM c",
    "confusion_f1": """, m AS (SELECT rel, CASE WHEN rank > 10 THEN 0 WHEN rank > 5 THEN 1 ELSE 2 END AS guess, count(*) AS n FROM runs_v GROUP BY ALL)
SELECT label, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT label, coalesce((SELECT sum(n) FROM m WHERE rel = label AND guess = label), 0) AS tp, coalesce((SELECT sum(n) FROM m WHERE rel <> label AND guess = label), 0) AS fp, coalesce((SELECT sum(n) FROM m WHERE rel = label AND guess <> label), 0) AS fn FROM range(3) t(label))""",
    "coverage_at_k": ", f AS (SELECT query_id, group_id, min(rank) AS first FROM runs_v WHERE rel >= 1 GROUP BY ALL) SELECT k, round((SELECT count(*) FROM f WHERE first <= k) / (SELECT count(*) FROM f), 6) AS coverage FROM (SELECT unnest([1, 5, 10, 20]) AS k)",
    "duplicate_ratio": "SELECT round(1 - (SELECT count(*) FROM (SELECT DISTINCT query_id, group_id FROM runs_v WHERE rank <= 10)) / (SELECT count(*) FROM runs_v WHERE rank <= 10), 6) AS ratio",
    "score_distribution": "SELECT category, len(s) AS n, round(list_min(s), 6) AS low, round(list_avg(s), 6) AS mean, round(list_max(s), 6) AS high FROM (SELECT category, list(score) AS s FROM runs_v GROUP BY category)",
    "aspect_coverage": "SELECT query_id, len(a) >= 2 AND list_has_all(a, [0, 1]) AS all_met, len(a) >= 2 AS two_met FROM (SELECT query_id, list(DISTINCT group_id % 3) AS a FROM runs_v WHERE rel >= 1 GROUP BY query_id)",
    "decision_metrics": f"SELECT split, round(count(*) FILTER (r[1] = 2) / count(*), 6) AS top1_direct, count(*) FILTER (list_max(r) = 0) AS rejected FROM {_LISTS} JOIN (SELECT DISTINCT query_id, split FROM runs_v) USING (query_id) GROUP BY split",
    "gate_decision": ", m AS (SELECT sum(rel) FILTER (split = 'TEST') / count(*) FILTER (split = 'TEST') - sum(rel) FILTER (split = 'TUNING') / count(*) FILTER (split = 'TUNING') AS d FROM runs_v) SELECT CASE WHEN d >= 0.02 THEN 'ADOPT' WHEN d >= -0.05 THEN 'NEEDS_ADJUSTMENT' ELSE 'NO_GO' END AS decision FROM m",
    "localization_iou": f""", p AS (SELECT DISTINCT version_id, unnest(range(lo, hi)) AS at FROM ({_SPANS}))
SELECT version_id, count(*) AS covered, count(*) FILTER (NOT EXISTS (SELECT 1 FROM p q WHERE q.version_id = p.version_id AND q.at = p.at - 1)) AS n_islands FROM p GROUP BY version_id""",
    "interval_cover_join": ", a AS (SELECT chunk_id, version_id, range((chunk_no - 1) * 680, (chunk_no - 1) * 680 + length(content) + 1) AS r FROM chunks_v) SELECT a.chunk_id, count(*) AS n_spans FROM a JOIN chunks_v b ON b.version_id = a.version_id AND b.chunk_no * 500 BETWEEN a.r[1] AND a.r[-1] AND b.chunk_no * 500 + 60 BETWEEN a.r[1] AND a.r[-1] GROUP BY a.chunk_id",
    "interval_overlap_join": """, p AS (SELECT chunk_id, version_id, unnest(range((chunk_no - 1) * 680, (chunk_no - 1) * 680 + length(content))) AS spot FROM chunks_v), q AS (SELECT version_id, chunk_no, unnest(range(chunk_no * 500, chunk_no * 500 + 60)) AS spot FROM chunks_v)
SELECT chunk_id, count(DISTINCT chunk_no) AS n_spans, count(*) AS shared FROM p JOIN q USING (version_id, spot) GROUP BY chunk_id""",
    "chunk_windows": ", n AS (SELECT *, length(content) AS l, lead(length(content)) OVER w AS l1, lead(length(content), 2) OVER w AS l2, lead(chunk_no) OVER w = chunk_no + 1 AS c1, lead(chunk_no, 2) OVER w = chunk_no + 2 AS c2 FROM chunks_v WINDOW w AS (PARTITION BY version_id ORDER BY chunk_no)) SELECT version_id, chunk_no, 1 AS w, l AS n_chars FROM n UNION ALL SELECT version_id, chunk_no, 2, l + l1 FROM n WHERE c1 UNION ALL SELECT version_id, chunk_no, 3, l + l1 + l2 FROM n WHERE c1 AND c2",
    "lineage_join": ", t AS (SELECT dt.document_id, dt.owner_id, list({'id': g.tag_id, 'name': g.name}) AS tags FROM document_tags_v dt JOIN tags_v g USING (tag_id) GROUP BY ALL) SELECT chunk_id, version_no, tag.id AS tag_id, tag.name AS name FROM (SELECT c.chunk_id, v.version_no, unnest(t.tags) AS tag FROM t JOIN versions_v v USING (document_id, owner_id) JOIN chunks_v c USING (version_id) WHERE v.active_version_id = v.version_id)",
    "length_histogram": ", b AS (SELECT CASE WHEN l <= 200 THEN '01-10' WHEN l <= 400 THEN '11-20' WHEN l <= 800 THEN '21-40' WHEN l <= 1600 THEN '41-80' ELSE '81+' END AS bucket FROM (SELECT length(content) AS l FROM chunks_v)) SELECT bucket, count(*) AS n FROM b GROUP BY bucket",
    # joins and guards
    "latest_version": "SELECT document_id, arg_max(version_id, version_no) AS latest_id, arg_max(status, version_no) AS latest_status, max(version_id) FILTER (status = 'ACTIVE') AS active_id FROM versions_v GROUP BY document_id",
    "dispatch_anti_join": "SELECT document_id, version_id FROM versions_v WHERE status = 'ACTIVE' EXCEPT SELECT document_id, version_id FROM chunks_v WHERE chunk_no = 3",
    "eligible_semi_join": "SELECT DISTINCT document_id, version_id FROM versions_v JOIN document_tags_v USING (document_id, owner_id) WHERE tag_id = 7",
    "set_equality": ", a AS (SELECT document_id FROM versions_v WHERE status = 'ACTIVE'), b AS (SELECT document_id FROM chunks_v WHERE chunk_no = 1) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "upsert_do_nothing": "SELECT document_id, tag_id FROM document_tags_v UNION SELECT document_id, 3 FROM versions_v WHERE version_no = 1",
    "delete_guard": "SELECT document_id FROM versions_v GROUP BY document_id HAVING bool_and(status <> 'FAILED')",
    "in_flight_guard": "SELECT document_id, list_contains(s, 'FAILED') AS any_failed, NOT list_contains(s, 'ACTIVE') AS none_active FROM (SELECT document_id, list(status) AS s FROM versions_v GROUP BY document_id)",
    "tagged_documents": "SELECT document_id FROM document_tags_v WHERE owner_id = 2 AND tag_id IN (SELECT tag_id FROM tags_v WHERE tag_id IN (1, 2, 3, 1001) AND coalesce(owner_id, 2) = 2) GROUP BY document_id",
    "tag_usage": "SELECT tag_id, any_value(name) AS name, len(list(DISTINCT document_id)) AS n_documents FROM (SELECT dt.document_id, t.tag_id, t.name FROM document_tags_v dt JOIN tags_v t USING (tag_id) WHERE coalesce(t.owner_id, dt.owner_id) = dt.owner_id) GROUP BY tag_id",
    "progress_steps": "SELECT version_id, min(chunk_no) AS chunk_no, pct FROM (SELECT version_id, chunk_no, chunk_no * 100 // n AS pct FROM chunks_v JOIN (SELECT version_id, count(*) AS n FROM chunks_v GROUP BY version_id) USING (version_id)) GROUP BY version_id, pct",
    "embedding_reuse_plan": "SELECT chunk_id, CASE WHEN f = chunk_id THEN 'COMPUTE' ELSE 'REUSE' END AS action, f AS source_id FROM (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY owner_id, content) AS f FROM chunks_v)",
    "neighbour_expansion": "SELECT chunk_id, coalesce((a = chunk_no - 1)::INT, 0) + coalesce((b = chunk_no + 1)::INT, 0) AS n_neighbours, nullif(greatest(CASE WHEN a = chunk_no - 1 THEN la ELSE 0 END, CASE WHEN b = chunk_no + 1 THEN lb ELSE 0 END), 0) AS longest FROM (SELECT chunk_id, chunk_no, lag(chunk_no) OVER w AS a, lead(chunk_no) OVER w AS b, lag(length(content)) OVER w AS la, lead(length(content)) OVER w AS lb FROM chunks_v WINDOW w AS (PARTITION BY version_id ORDER BY chunk_no))",
    "claim_windows": ", n AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY chunk_no) AS o FROM chunks_v) SELECT c.chunk_id, md5(coalesce(a.content, '') || '|' || c.content) AS back, md5(c.content || '|' || coalesce(b.content, '')) AS ahead FROM n c LEFT JOIN n a ON a.version_id = c.version_id AND a.o = c.o - 1 LEFT JOIN n b ON b.version_id = c.version_id AND b.o = c.o + 1",
    # jobs
    "outbox_dispatch": f"SELECT job_id, list_min(seq) AS event_id, len(seq) AS n_seen FROM (SELECT DISTINCT job_id, seq FROM {_JOBS.format('ENQUEUE')})",
    "retry_schedule": f"SELECT event_id, job_id, n, CASE WHEN n <= 3 THEN ts + to_minutes([1, 5, 15][n]) END AS next_at FROM (SELECT *, list_position(seq, event_id)::BIGINT AS n FROM {_JOBS.format('FAIL')}) WHERE n <= 4",
    "generation_lifecycle": f"SELECT event_id, job_id, CASE WHEN seq[-1] = event_id THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, seq[1] = event_id AS first_swap FROM {_JOBS.format('COMPLETE')}",
    "supersede_on_swap": f"SELECT job_id, event_id, seq[list_position(seq, event_id) + 1] AS superseded_by FROM {_JOBS.format('COMPLETE')}",
    "hourly_windows": "SELECT start, kind, len(l) AS n FROM (SELECT make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS start, kind, list(event_id) AS l FROM job_events_v GROUP BY ALL)",
}

for _name, _sql in SECOND.items():
    ORACLE[_name] = DUCK + _sql
