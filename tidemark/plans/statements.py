"""DuckDB statements that give the same rows as the registered queries, written independently of them."""

from __future__ import annotations

from ..sources.telemetry import with_tables
from . import answers, daily, fact_rounds, retrievals, rounds

W = with_tables


def _first(table: str, keys: str, order: str, columns: str = "*") -> str:
    return f"SELECT {columns} FROM {table} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


RULES = """CASE WHEN entity_type IN ('check','check_run','workflow_run','build','incident','alert') THEN 'pressure' WHEN entity_type IN ('commit','change','diff') THEN 'cause'
  WHEN entity_type IN ('recommendation','review_action','task') THEN 'action' WHEN entity_type IN ('state','deployment','release') THEN 'state' ELSE 'evidence' END"""
TERMS = r"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({0}), '[\s|&()\[\]{{}}~^*:\"''@%<>=!,;]+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}_]+', '')), lambda w: w <> ''))"
DEPS = f"{W('work_item_dependencies', 'work_items')}, items AS ({_first('work_items', 'work_item_id', 'last_synced DESC')}), d AS ({_first('work_item_dependencies', 'source_work_item_id, target_work_item_id, relationship_type', 'last_synced DESC')})"

PLAIN = {
    "version_dedup": f"{W('work_items')} {_first('work_items', 'work_item_id', 'last_synced DESC', 'work_item_id, title, status, updated_at')}",
    "limit_one_by": _first("events", "user_id, event_type", "value DESC, event_id", "user_id, event_type, event_id, value"),
    "ownership_fold": f"""{W('team_project_ownership')} SELECT org_id, project_key, team_id, min(valid_from) AS valid_from,
        (list(valid_to ORDER BY valid_from DESC, (valid_to IS NULL) DESC, valid_to DESC))[1] AS valid_to FROM team_project_ownership GROUP BY ALL""",
    "ambiguous_projects": f"{W('team_project_ownership')} SELECT org_id, project_key, count(DISTINCT team_id) AS claimants FROM team_project_ownership GROUP BY ALL HAVING count(DISTINCT team_id) > 1",
    "source_watermarks": """WITH e AS (SELECT CASE WHEN event_type = 'click' THEN 'error' ELSE event_type END AS source, max(ts) AS watermark FROM events
        WHERE (event_type <> 'view' OR user_id % 2 = 0) AND ts <= TIMESTAMP '2024-01-30 23:00:00' GROUP BY 1)
        SELECT source, watermark, CASE WHEN watermark IS NULL THEN 'missing' WHEN watermark < TIMESTAMP '2024-01-30 20:00:00' THEN 'stale' ELSE 'fresh' END AS freshness
        FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) c(source) LEFT JOIN e USING (source)""",
    "coverage_sets": """SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS considered, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (value > 30), '') AS available,
        coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (NOT value > 30), '') AS unavailable FROM events GROUP BY user_id""",
    "census_of_parts": "SELECT p_brand, p_size, count(*) AS satisfiers, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS only FROM part GROUP BY p_brand, p_size",
    "panel_consensus": """WITH v AS (SELECT o_orderkey % 200 AS question, o_custkey AS voter, o_orderpriority AS value FROM orders),
        c AS (SELECT question, value, count(*) AS n FROM v GROUP BY ALL), b AS (SELECT question, value AS majority, n AS agreeing FROM c QUALIFY row_number() OVER (PARTITION BY question ORDER BY n DESC, value) = 1)
        SELECT question, majority, agreeing, count(*) AS panel, count(DISTINCT voter) AS voters, agreeing = count(*) AS unanimous FROM v JOIN b USING (question) GROUP BY question, majority, agreeing""",
    "prior_curation": """WITH c AS (SELECT o_custkey % 50 AS member, o_orderpriority AS value, count(*) FILTER (o_orderstatus = 'P') AS human, count(*) AS total FROM orders GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY member ORDER BY human DESC, total DESC, value) - 1 AS rank FROM c WHERE human >= 1""",
    "timing_by_type": "SELECT event_type, round(avg(value), 6) AS mean, (list(value ORDER BY value))[count(*) // 2 + 1] AS p50, max(value) AS most, count(*) AS calls FROM events GROUP BY event_type",
    "percentile_nearest_rank": """SELECT l_returnflag, (list(l_extendedprice ORDER BY l_extendedprice))[ceil(0.5 * count(*))::BIGINT] AS p50, (list(l_extendedprice ORDER BY l_extendedprice))[ceil(0.9 * count(*))::BIGINT] AS p90
        FROM lineitem GROUP BY l_returnflag""",
    "percentile_floor_index": """SELECT l_returnflag, l_linestatus, (list(l_extendedprice ORDER BY l_extendedprice))[greatest(1, floor(0.5 * count(*))::BIGINT)] AS p50,
        (list(l_extendedprice ORDER BY l_extendedprice))[greatest(1, floor(0.95 * count(*))::BIGINT)] AS p95 FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "evaluation_ratios": """SELECT user_id, round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 9) AS precision,
        round(count(*) FILTER (value > 1000) / nullif(count(*) FILTER (value > 100000), 0), 9) AS error_rate FROM events GROUP BY user_id""",
    "recall_at_k": """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS tied FROM part)
        SELECT p_brand, round(count(*) FILTER (place <= 10 AND p_partkey % 3 <> 0) / count(*) FILTER (place <= 10), 9) AS recall,
        round(least(1.0, (count(*) FILTER (p_partkey % 3 <> 0) / count(*) FILTER (place <= 10))::DOUBLE), 9) AS tolerant_recall FROM r WHERE tied <= 10 GROUP BY p_brand""",
    "usage_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS requests, sum(user_id)::BIGINT AS amount FROM events GROUP BY ALL",
    "shard_merge": """SELECT l_suppkey % 10 AS arm, sum(l_linenumber)::BIGINT AS l_linenumber, sum(l_quantity::BIGINT)::BIGINT AS calls, min(l_shipdate) AS l_shipdate,
        string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags, bool_and(l_tax < 0.09) AS valid FROM lineitem GROUP BY 1""",
    "citation_equality": """WITH a AS (SELECT DISTINCT l_orderkey % 300 AS task, l_partkey % 7 AS item FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey % 300 AS task, l_partkey % 7 AS item FROM lineitem WHERE l_returnflag = 'N')
        SELECT coalesce(a.task, b.task) AS task, count(*) FILTER (b.item IS NULL) AS missing, count(*) FILTER (a.item IS NULL) AS unexpected, count(*) FILTER (b.item IS NULL OR a.item IS NULL) = 0 AS equal
        FROM a FULL JOIN b ON a.task = b.task AND a.item = b.item GROUP BY 1""",
    "keyset_page": """WITH r AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_id, event_type FROM events), n AS (
        SELECT * FROM r WHERE hour > TIMESTAMP '2024-01-03' OR (hour = TIMESTAMP '2024-01-03' AND event_id::VARCHAR > '500') ORDER BY hour, event_id::VARCHAR LIMIT 201)
        SELECT *, (SELECT count(*) FROM n) > 200 AS truncated FROM n ORDER BY hour, event_id::VARCHAR LIMIT 200""",
    "merged_change_page": f"""{W('git_pull_requests', 'git_commits')}, u AS (SELECT 'pull_requests' AS "table", last_synced AS "at", number::VARCHAR AS key FROM git_pull_requests UNION ALL SELECT 'commits', committer_when, hash FROM git_commits),
        r AS (SELECT *, dense_rank() OVER (ORDER BY "at", key) AS place FROM u) SELECT * FROM r WHERE place <= 300""",
    "goal_scores": """SELECT p_partkey, (list_sum(list_transform(['large', 'red', 'widget', 'red', 'steel'], lambda w: contains(lower(p_type || ' ' || p_name), w)::INT)))::INT AS goal_score FROM part""",
    "category_rules": f"""WITH e AS (SELECT event_id, (['commit', 'incident', 'deployment', 'task', 'pull_request'])[event_id % 5 + 1] AS entity_type FROM events), c AS (SELECT *, {RULES} AS category FROM e)
        SELECT event_id, entity_type, category, CASE category WHEN 'pressure' THEN 'high' WHEN 'cause' THEN 'warning' WHEN 'action' THEN 'warning' ELSE 'info' END AS severity,
        CASE category WHEN 'state' THEN 0 WHEN 'pressure' THEN 1 WHEN 'cause' THEN 2 WHEN 'evidence' THEN 3 ELSE 4 END AS category_rank FROM c""",
    "greedy_dedup": """WITH RECURSIVE i AS (SELECT l_suppkey % 40 AS packet, l_orderkey, min(l_linenumber) AS line, min(l_partkey) AS part FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1, 2),
        o AS MATERIALIZED (SELECT *, ['o' || (l_orderkey % 50), 'p' || (part % 60)] AS keys, row_number() OVER (PARTITION BY packet ORDER BY line, l_orderkey) AS at FROM i),
        f AS (SELECT packet, 0::BIGINT AS at, []::VARCHAR[] AS used, false AS keep FROM o GROUP BY packet
          UNION ALL SELECT o.packet, o.at, CASE WHEN list_has_any(f.used, o.keys) THEN f.used ELSE list_concat(f.used, o.keys) END, NOT list_has_any(f.used, o.keys) FROM f JOIN o ON o.packet = f.packet AND o.at = f.at + 1)
        SELECT o.packet, o.l_orderkey, o.line, o.part FROM o JOIN f ON o.packet = f.packet AND o.at = f.at WHERE f.keep""",
    "quota_allocation": """WITH e AS (SELECT event_id, value, (['state', 'pressure', 'cause', 'evidence', 'action'])[event_id % 4 + 1] AS category, user_id % 20 AS packet FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY value DESC, event_id) AS rank FROM e), q AS (SELECT *, row_number() OVER (PARTITION BY packet, category ORDER BY rank)
          <= CASE WHEN category IN ('state', 'pressure', 'cause') THEN 3 ELSE 2 END AS inside FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY inside DESC, rank) AS place FROM q)
        SELECT packet, event_id, category, rank FROM p WHERE place <= 13""",
    "pack_stop_first": """WITH e AS (SELECT user_id % 50 AS packet, event_id, ceil(value)::BIGINT AS cost FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY event_id) AS rank FROM e),
        s AS (SELECT *, sum(cost) OVER (PARTITION BY packet ORDER BY rank) AS total FROM r) SELECT packet, event_id, cost, rank FROM s WHERE total <= 500""",
    "pack_skip": """WITH RECURSIVE e AS (SELECT user_id % 50 AS packet, event_id, ceil(value)::BIGINT AS cost FROM events), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY event_id) AS rank FROM e),
        f AS (SELECT packet, 0::BIGINT AS rank, 0::BIGINT AS used, false AS keep FROM r GROUP BY packet UNION ALL
          SELECT r.packet, r.rank, CASE WHEN f.used + r.cost <= 100 THEN f.used + r.cost ELSE f.used END, f.used + r.cost <= 100 FROM f JOIN r ON r.packet = f.packet AND r.rank = f.rank + 1)
        SELECT r.* FROM r JOIN f ON r.packet = f.packet AND r.rank = f.rank WHERE f.keep""",
    "top_k_ties": "SELECT p_brand, p_partkey, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) <= 5",
    "token_estimates": "SELECT doc_id, ((strlen(coalesce(text, '')) + strlen(coalesce(lang, '')) + strlen(coalesce(source, '')) + 3) // 4)::INT AS tokens FROM documents",
    "derived_ids": """WITH s AS (SELECT p_partkey, p_name || ':' || p_brand || '%' AS raw FROM part), e AS (SELECT *, replace(replace(raw, '%', '%25'), ':', '%3A') AS seg FROM s)
        SELECT p_partkey, 'part.v2:' || seg || ':' || p_partkey AS id, raw AS first_segment, 'relationship.v2:part_of:' || substr(sha256(seg), 1, 32) AS relationship_id FROM e""",
    "question_hashes": r"SELECT doc_id, sha256(regexp_replace(lower(trim(regexp_replace('  ' || substr(text, 1, 200) || ' ?? ', '[ \t\n\x0B\f\r]+', ' ', 'g'))), '[.?!,;:\s]+$', '')) AS hash FROM documents",
    "relation_names": "SELECT p_partkey, upper(substr(regexp_replace(lower(p_name || '-' || p_type), '[^a-z0-9_]', '_', 'g'), 1, 64)) AS relation FROM part",
    "pure_identifiers": """SELECT event_id, event_id % 4 IN (0, 1) OR (event_id % 4 = 2 AND length(regexp_replace(md5(event_id::VARCHAR), '[^0-9]', '', 'g')) >= 2) AS pure FROM events""",
    "question_handles": "SELECT event_id, event_id::VARCHAR AS prs, (event_id + 10000)::VARCHAR AS runs, 30 AS days FROM events",
    "edge_validity": f"""{W('work_items')}, w AS ({_first('work_items', 'work_item_id', 'last_synced DESC')}), j AS (
        SELECT c.work_item_id, c.parent_id, greatest(c.created_at, p.created_at) AS f, least(c.completed_at, p.completed_at) AS t FROM w c JOIN w p ON c.parent_id = p.work_item_id WHERE c.work_item_id <> c.parent_id)
        SELECT work_item_id, parent_id, f AS valid_from, CASE WHEN f > t THEN f ELSE t END AS valid_to FROM j""",
    "valid_time_read": f"""{W('team_project_ownership')} SELECT org_id, team_id, count(*) AS projects, count(*) FILTER (valid_to IS NULL) AS open_ended FROM team_project_ownership
        WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-15') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15') GROUP BY ALL""",
    "neighbours": f"""{W('work_graph_edges')} SELECT node, count(*) AS degree FROM (SELECT source_id AS node, target_id AS other FROM work_graph_edges UNION SELECT target_id, source_id FROM work_graph_edges) GROUP BY node""",
    "two_hop_walk": f"""{W('work_item_dependencies')}, b AS (SELECT source_work_item_id AS a, target_work_item_id AS b FROM work_item_dependencies UNION SELECT target_work_item_id, source_work_item_id FROM work_item_dependencies),
        s(seed) AS (VALUES ('WI-1'), ('WI-22'), ('WI-333')), h AS (SELECT seed, seed AS node, 0 AS hop FROM s UNION ALL SELECT seed, b.b, 1 FROM s JOIN b ON b.a = seed UNION ALL SELECT seed, c.b, 2 FROM s JOIN b ON b.a = seed JOIN b c ON c.a = b.b)
        SELECT seed, node, min(hop) AS hop FROM h GROUP BY seed, node""",
    "edge_admission": f"""{W('work_graph_edges', 'work_items')}, n AS (SELECT DISTINCT work_item_id FROM work_items WHERE status = 'done')
        SELECT edge_id, CASE WHEN repo_id = 'repo-3' THEN 'unauthorized' WHEN discovered_at > TIMESTAMP '2024-01-20' THEN 'outside_window' WHEN source_id = target_id THEN 'self_loop'
          WHEN source_id NOT IN (FROM n) OR target_id NOT IN (FROM n) THEN 'missing_endpoint' ELSE 'admitted' END AS reason FROM work_graph_edges""",
    "keyed_upsert": f"{W('work_items')} {_first('work_items', 'work_item_id', 'last_synced DESC', 'work_item_id, status, last_synced')}",
    "tombstones": f"""{W('operational_incidents')}, d AS (SELECT service_id, max(observed_at) AS at FROM operational_incidents WHERE is_deleted = 1 GROUP BY service_id)
        SELECT i.id, i.service_id, i.observed_at FROM operational_incidents i LEFT JOIN d USING (service_id) WHERE d.at IS NULL OR i.observed_at > d.at""",
    "orphaned_stubs": f"""{W('work_item_dependencies', 'work_items')}, k AS (SELECT DISTINCT work_item_id AS node_id FROM work_items) SELECT node_id, 'work_item' AS kind FROM k
        UNION ALL SELECT DISTINCT target_work_item_id, 'stub' FROM work_item_dependencies WHERE target_work_item_id NOT IN (FROM k)""",
    "lexical_matches": f"""WITH i AS (SELECT p_partkey, unnest({TERMS.format("p_name || ' ' || p_type || ' ' || p_brand")}) AS term FROM part),
        q AS (SELECT query_id, {TERMS.format('query')} AS ts FROM (VALUES (1, 'large red widget'), (2, 'blue | ring (steel)'), (3, 'nothing here')) v(query_id, query)), t AS (SELECT query_id, len(ts) AS terms, unnest(ts) AS term FROM q),
        m AS (SELECT query_id, p_partkey, terms, count(*) AS matched FROM i JOIN t USING (term) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, p_partkey) AS place, count(*) OVER (PARTITION BY query_id) > 50 AS truncated FROM m)
        SELECT query_id, p_partkey, matched, place, truncated, round(CASE WHEN truncated THEN 0.5 ELSE 0.5 + 0.25 * matched / terms END, 9)::DOUBLE AS relevance FROM r WHERE place <= 50""",
    "vector_nearest": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings v JOIN embeddings q ON q.vec_id < 5 AND v.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, hit_id) AS place FROM s WHERE similarity > 0.05)
        SELECT query_id, hit_id, place, round(similarity, 9) AS similarity, round(0.5 + 0.2 * (similarity - 0.05::DOUBLE) / 0.95::DOUBLE, 9) AS relevance FROM r WHERE place <= 20""",
    "candidate_fusion": """WITH e AS (SELECT user_id % 10 AS request, event_id % 60 AS subject, (['lexical', 'vector', 'alias', 'exact'])[event_id % 4 + 1] AS mechanism, value / 400 AS confidence, event_type FROM events),
        g AS (SELECT request, subject, max(confidence) AS base, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS terms, list_filter(['caller', 'exact', 'alias', 'provider_key', 'lexical', 'vector'], lambda x: list_contains(list(DISTINCT mechanism), x)) AS ms FROM e GROUP BY ALL)
        SELECT request, subject, terms, array_to_string(ms, ',') AS mechanisms, round(base, 9) AS base, round(CASE WHEN base >= 1 THEN 1.0::DOUBLE WHEN len(ms) >= 2 THEN
          greatest(base, 0.72::DOUBLE + 0.14::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * base + 0.5::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (len(ms) - 2) / 4))))) ELSE base END, 9) AS confidence FROM g""",
    "commit_decisions": """WITH e AS (SELECT user_id AS request, event_id AS subject, round(least(1.0::DOUBLE, 0.6::DOUBLE + value / 100), 2) AS confidence, event_type <> 'view' AS ok FROM events WHERE event_id % 3 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY confidence DESC, subject) AS place FROM e), t AS (SELECT a.*, b.confidence AS second FROM r a LEFT JOIN r b ON b.request = a.request AND b.place = 2 WHERE a.place = 1),
        d AS (SELECT *, CASE WHEN NOT ok THEN 'ambiguous' WHEN second IS NULL THEN CASE WHEN confidence >= 0.72 THEN 'commit' ELSE 'ambiguous' END WHEN second = confidence THEN 'tied'
          WHEN confidence >= 0.88 AND confidence - second >= 0.12 - 1e-12 THEN 'commit' ELSE 'ambiguous' END AS outcome FROM t)
        SELECT request, outcome, CASE WHEN outcome = 'commit' THEN subject END AS committed, round(confidence, 9) AS confidence, round(confidence - second, 9) AS gap FROM d""",
    "identity_collisions": """WITH n AS (SELECT lower(p_name || ' ' || p_size) AS term, p_partkey AS subject, CASE WHEN p_partkey % 2 = 0 THEN 'label' ELSE 'alias' END AS cls FROM part),
        c AS (SELECT term, cls, count(DISTINCT subject) AS claimants, min(subject) AS one FROM n GROUP BY ALL)
        SELECT term, max(claimants) AS most_claimants, coalesce(min(one) FILTER (claimants = 1 AND cls = 'alias'), min(one) FILTER (claimants = 1 AND cls = 'label')) AS names, max(claimants) > 1 AS collides,
          count(DISTINCT one) FILTER (claimants = 1) > 1 AS rivals FROM c GROUP BY term""",
    "floor_calibration": """WITH s AS (SELECT value / 100 AS x FROM events), c AS (SELECT x, sum(count(*)) OVER (ORDER BY x DESC) / (SELECT count(*) FROM s) AS kept FROM s GROUP BY x)
        SELECT round(max(x), 9) AS floor, round(min(kept)::DOUBLE, 9) AS kept FROM c WHERE kept >= 0.9""",
    "margin_calibration": """WITH s AS (SELECT value / 100 AS m, event_id % 50 <> 1 AS ok FROM events), w AS (SELECT max(m) FILTER (NOT ok) AS wrong FROM s)
        SELECT round(wrong, 9) AS largest_wrong, round(count(*) FILTER (ok AND m > wrong) / count(*) FILTER (ok), 9) AS reach FROM s, w GROUP BY wrong""",
}


def _evidence(prefix: str, kind: str, entity: str, label: str, citation: str, observed: str, rest: str, uri: str = "''", provenance: str = "'native'", confidence: str = "1.0", with_: str = "") -> str:
    return f"""{with_} SELECT '{prefix}:' || {entity} AS evidence_ref_id, 'telemetry' AS system, {kind} AS entity_type, {entity} AS entity_id, {label} AS display_label, {uri} AS safe_uri,
        {provenance} AS provenance, ({confidence})::DOUBLE AS confidence, {citation} AS citation, {observed} AS observed_at {rest}"""


EARLY, MID, MINE = "TIMESTAMP '2000-01-01'", "TIMESTAMP '2024-01-15'", "repo_id = 'repo-8' AND repo_id IN (SELECT id FROM repos WHERE org_id = 'org-3')"
LATEST_ITEMS = f"i AS ({_first('work_items', 'work_item_id', 'last_synced DESC')})"
EVIDENCE = {
    "repository_freshness": _evidence("repository", "'repository'", "id", "repo", "'repository freshness'", "last_synced", "FROM repos WHERE org_id = 'org-3' AND id = 'repo-8' AND ref = 'main'", with_=W("repos")),
    "work_items": _evidence("work-item", "'work_item'", "work_item_id", "title", "status", "updated_at", f"FROM i WHERE org_id = 'org-3' AND repo_id = 'repo-8' AND updated_at <= {EARLY} AND updated_at >= {EARLY} - INTERVAL 700 DAY",
        "CASE WHEN url LIKE 'https:%' THEN url ELSE '' END", with_=f"{W('work_items')}, {LATEST_ITEMS}"),
    "work_item_dependencies": _evidence("work-item-dependency", "'work_item_dependency'", "(source_work_item_id || ':' || target_work_item_id)", "source_work_item_id || ' ' || relationship_type || ' ' || target_work_item_id", "relationship_type", "d.last_synced",
        f"FROM work_item_dependencies d JOIN i ON i.work_item_id = d.source_work_item_id WHERE d.org_id = 'org-3' AND i.org_id = 'org-3' AND i.repo_id = 'repo-8' AND d.last_synced <= {EARLY}", with_=f"{W('work_item_dependencies', 'work_items')}, {LATEST_ITEMS}"),
    "git_commits": _evidence("commit", "'commit'", "hash", "CASE WHEN message = '' THEN 'commit ' || hash ELSE message END", "CASE WHEN message = '' THEN 'commit ' || hash ELSE message END", "committer_when",
        f"FROM git_commits WHERE {MINE} AND committer_when <= {EARLY} AND committer_when >= {EARLY} - INTERVAL 365 DAY", with_=W("git_commits", "repos")),
    "git_commit_files": _evidence("commit-file", "'commit_file'", "(commit_hash || ':' || file_path)", "file_path", "additions || ' additions, ' || deletions || ' deletions'", "last_synced", f"FROM git_commit_stats WHERE {MINE} AND file_path IN ('src/f1.py', 'src/f7.py')", with_=W("git_commit_stats", "repos")),
    "pull_requests": _evidence("pull-request", "'pull_request'", "number::VARCHAR", "title", "state", "last_synced", f"FROM git_pull_requests WHERE {MINE} AND (head_branch = 'release' OR base_branch = 'release') AND last_synced <= {EARLY}", with_=W("git_pull_requests", "repos")),
    "pull_request_reviews": _evidence("review", "'pull_request_review'", "review_id", "'PR #' || r.number || ' review'", "r.state", "submitted_at",
        f"FROM git_pull_request_reviews r JOIN git_pull_requests p ON r.repo_id = p.repo_id AND r.number = p.number WHERE r.{MINE.replace(' AND repo_id', ' AND r.repo_id')} AND (head_branch = 'release' OR base_branch = 'release') AND submitted_at <= {EARLY}", with_=W("git_pull_request_reviews", "git_pull_requests", "repos")),
    "ci_pipeline_runs": _evidence("ci", "'ci_pipeline_run'", "run_id", "'CI ' || run_id", "status", "coalesce(finished_at, started_at)", f"FROM ci_pipeline_runs WHERE {MINE} AND branch = 'main' AND started_at <= {MID} AND started_at >= {MID} - INTERVAL 7 DAY", with_=W("ci_pipeline_runs", "repos")),
    "work_graph": _evidence("graph", "'work_graph_edge'", "edge_id", "source_id || ' ' || edge_type || ' ' || target_id", "'edge_id=' || edge_id", "discovered_at", f"FROM work_graph_edges WHERE repo_id = 'repo-8' AND discovered_at <= {MID}", provenance="provenance", confidence="confidence", with_=W("work_graph_edges")),
    "ai_workflow_runs": _evidence("ai-run", "'ai_workflow_run'", "run_id", "CASE WHEN trim(provider || ' ' || run_kind || ' ' || status) = '' THEN 'AI workflow ' || run_id ELSE provider || ' ' || run_kind || ' ' || status END", "CASE WHEN status = '' THEN 'run_id=' || run_id ELSE status END", "observed_at", f"FROM ai_workflow_runs WHERE repo_id = 'repo-8' AND observed_at <= {MID}", with_=W("ai_workflow_runs")),
    "ai_workflow_artifacts": _evidence("ai-artifact", "artifact_type", "artifact_id", "'AI artifact ' || artifact_id", "'artifact_id=' || artifact_id", "observed_at", f"FROM ai_workflow_artifacts WHERE repo_id = 'repo-8' AND observed_at <= {MID}", provenance="CASE source WHEN 'pr_body' THEN 'explicit_text' WHEN 'branch_name' THEN 'heuristic' WHEN 'native' THEN 'native' ELSE '' END", confidence="confidence", with_=W("ai_workflow_artifacts")),
    "ai_review_outcomes": _evidence("review-outcome", "'review_outcome'", "review_outcome_id", "'PR ' || pr_id || ' review outcome'", "outcome", "observed_at", f"FROM ai_review_outcomes WHERE repo_id = 'repo-8' AND observed_at <= {MID}", provenance="CASE source WHEN 'native' THEN 'native' ELSE '' END", confidence="confidence", with_=W("ai_review_outcomes")),
    "deployments": _evidence("deployment", "'deployment'", "deployment_id", "CASE WHEN environment = '' THEN 'deployment ' || deployment_id ELSE environment || ' deployment' END", "'deployment_id=' || deployment_id", "coalesce(deployed_at, started_at, last_synced)", f"FROM deployments WHERE {MINE} AND coalesce(deployed_at, started_at, last_synced) <= {MID}", confidence="release_ref_confidence", with_=W("deployments", "repos")),
    "incidents": _evidence("incident", "'incident'", "id", "title", "'status=' || normalized_status || ', severity=' || normalized_severity", "started_at", "FROM j", provenance="CASE relationship_provenance WHEN 'admin_configuration' THEN 'native' WHEN 'native' THEN 'native' WHEN 'bounded_service_repository_heuristic' THEN 'heuristic' ELSE '' END", confidence="greatest(0, least(1, coalesce(relationship_confidence, 1.0)))",
        with_=f"""{W('operational_incidents', 'service_mappings')}, j AS (SELECT i.*, m.relationship_provenance, m.relationship_confidence FROM operational_incidents i JOIN service_mappings m ON i.org_id = m.org_id AND i.service_id = m.service_id
          WHERE i.org_id = 'org-3' AND m.repo_id = 'repo-8' AND is_active = 1 AND valid_from <= {MID} AND (valid_to IS NULL OR valid_to > {MID}) AND is_deleted = 0 AND i.started_at <= {MID}
          QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY m.relationship_confidence DESC NULLS LAST, m.id) = 1)"""),
    "deployment_incidents": _evidence("deployment-incident", "'deployment_incident_edge'", "edge_id", "deployment_id || ' linked to ' || incident_id", "'edge_id=' || edge_id", "observed_at", f"FROM deployment_incident_edges WHERE repo_id = 'repo-8' AND observed_at <= {MID}", provenance="source", confidence="confidence", with_=W("deployment_incident_edges")),
    "file_hotspots": _evidence("hotspot", "'file_hotspot'", "file_path", "file_path", "'churn=' || churn_loc_30d || ', complexity=' || cyclomatic_total", "day::TIMESTAMP", f"""FROM file_hotspot_daily h WHERE repo_id = 'repo-8'
        AND (day, computed_at) = (SELECT (day, computed_at) FROM file_hotspot_daily WHERE repo_id = 'repo-8' AND day <= {MID} ORDER BY day DESC, computed_at DESC LIMIT 1)""", with_=W("file_hotspot_daily")),
    "file_complexity": _evidence("complexity", "'file_complexity'", "file_path", "file_path", "'complexity=' || cyclomatic_total", "as_of_day::TIMESTAMP", f"""FROM file_complexity_snapshots h WHERE repo_id = 'repo-8'
        AND (ref, as_of_day, computed_at) = (SELECT (ref, as_of_day, computed_at) FROM file_complexity_snapshots WHERE repo_id = 'repo-8' AND as_of_day <= {MID} ORDER BY as_of_day DESC, computed_at DESC, ref LIMIT 1)""", with_=W("file_complexity_snapshots")),
}


def _facts(kind: str, with_: str, source: str, subject: str, fields: dict[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{kind}' AS fact_kind, {subject}::VARCHAR AS subject_id, '{n}' AS field, ({v})::VARCHAR AS value FROM s" for n, v in fields.items())
    return f"{with_}, s AS ({source}) SELECT * FROM ({parts}) WHERE value IS NOT NULL"


ITEMS = (W("work_items"), _first("work_items", "work_item_id", "last_synced DESC"), "work_item_id")


def _team(kind: str, keys: str, order: str, fields: dict[str, str], subject: str = "team_id", keep: str = "true") -> str:
    return _facts(kind, W("team_daily"), f"SELECT * FROM ({_first(f'(SELECT * FROM team_daily WHERE day <= {MID})', keys, order)}) WHERE {keep}", subject, fields)


DAILY = "day DESC, computed_at DESC, event_id DESC"
FACTS = {
    "identity": _facts("identity", *ITEMS, {"title": "title", "provider": "provider"}),
    "membership": _facts("membership", *ITEMS, {"repo_id": "repo_id", "org_id": "org_id"}),
    "status": _facts("status", *ITEMS, {"status": "status"}),
    "work": _facts("work", *ITEMS, {"title": "title"}),
    "actual_completion": _facts("actual_completion", ITEMS[0], f"SELECT * FROM ({ITEMS[1]}) WHERE created_at <= {EARLY}", "work_item_id", {"completed": f"coalesce(completed_at <= {EARLY}, false)"}),
    "pull_requests": _facts("pull_requests", W("git_pull_requests"), f"SELECT * FROM git_pull_requests WHERE created_at <= {EARLY}", "number", {"title": "title", "state": f"CASE WHEN merged_at <= {EARLY} THEN 'merged' WHEN closed_at <= {EARLY} THEN 'closed' ELSE 'open' END"}),
    "reviews": _facts("reviews", W("git_pull_request_reviews"), f"SELECT * FROM git_pull_request_reviews WHERE submitted_at <= {EARLY}", "review_id", {"state": "state"}),
    "continuous_integration": _facts("continuous_integration", W("ci_pipeline_runs"), f"SELECT * FROM ci_pipeline_runs WHERE started_at <= {MID}", "run_id", {"status": f"CASE WHEN finished_at <= {MID} THEN status ELSE 'running' END"}),
    "deployments": _facts("deployments", W("deployments"), f"SELECT * FROM deployments WHERE started_at <= {MID}", "deployment_id", {"status": f"CASE WHEN finished_at <= {MID} THEN status ELSE 'in_progress' END", "environment": "nullif(environment, '')"}),
    "incidents": _facts("incidents", W("operational_incidents"), f"SELECT * FROM operational_incidents WHERE started_at <= {MID} AND is_deleted = 0", "id", {"status": f"CASE WHEN resolved_at <= {MID} THEN 'resolved' ELSE 'open' END"}),
    "metrics": _team("metrics", "team_id", DAILY, {"metric": "metric"}),
    "health": _team("health", "team_id", DAILY, {"metric": "metric", "severity": "severity"}),
    "workload": _team("workload", "team_id, rule_id", "computed_at DESC, event_id DESC", {"metric": "metric", "rule_id": "rule_id"}),
    "investment": _team("investment", "team_id, rule_id", DAILY, {"rule_id": "rule_id", "metric": "metric"}),
    "readiness": _team("readiness", "team_id, rule_id, severity", DAILY, {"rule_id": "rule_id", "metric": "metric"}),
    "operational_deficiencies": _team("operational_deficiencies", "team_id, rule_id", DAILY, {"rule_id": "rule_id", "severity": "severity"}, keep="fired"),
    "source_health": _team("source_health", "rule_id", "computed_at DESC, day DESC, event_id DESC", {"severity": "severity", "computed_at": "computed_at"}, subject="rule_id"),
    "blockers": f"{DEPS} SELECT 'blockers' AS fact_kind, target_work_item_id AS subject_id, 'related' AS field, source_work_item_id AS value FROM d JOIN items ON work_item_id = target_work_item_id WHERE relationship_type = 'blocks'",
    "required_children": f"{DEPS} SELECT 'required_children' AS fact_kind, source_work_item_id AS subject_id, 'related' AS field, target_work_item_id AS value FROM d JOIN items ON work_item_id = source_work_item_id WHERE relationship_type <> 'blocks'",
}


SEG = "replace(replace({0}, '%', '%25'), ':', '%3A')"


def _id(kind: str, key: str) -> str:
    return f"('{kind}.v2:' || {SEG.format(f'({key})')})"


def _node(kind: str, key: str, label: str, observed: str, start: str = "NULL", end: str = "NULL", op: str = "'node'") -> str:
    return f"{op} AS op, '{kind}' AS kind, {_id(kind, key)} AS node_id, {label} AS label, NULL::VARCHAR AS source_id, NULL::VARCHAR AS target_id, NULL::VARCHAR AS relation, ({start})::TIMESTAMP AS valid_from, ({end})::TIMESTAMP AS valid_to, ({observed})::TIMESTAMP AS observed_at"


def _edge(relation: str, source: str, target: str, observed: str, start: str = "NULL", end: str = "NULL", op: str = "'edge'") -> str:
    joined = f"{SEG.format(source)} || ':' || {SEG.format(target)}"
    return f"""{op} AS op, 'relationship' AS kind, 'relationship.v2:{relation.lower()}:' || substr(sha256({joined}), 1, 32) AS node_id, NULL::VARCHAR AS label, {source} AS source_id, {target} AS target_id, '{relation}' AS relation,
        ({start})::TIMESTAMP AS valid_from, ({end})::TIMESTAMP AS valid_to, ({observed})::TIMESTAMP AS observed_at"""


def _placed(kind: str, key: str, label: str, observed: str, source: str, start: str, end: str, with_: str) -> str:
    edge = _edge("BELONGS_TO_REPOSITORY", _id(kind, key), _id("repository", "repo_id"), observed, start, end)
    return f"{with_} SELECT {_node(kind, key, label, observed, start, end)} FROM {source} UNION ALL SELECT {edge} FROM {source} WHERE repo_id IN (SELECT id FROM repos)"


def _common(a: str, b: str, c: str, d: str) -> tuple[str, str]:
    start, end = f"greatest({a}, {c})", f"least({b}, {d})"
    return start, f"CASE WHEN {start} > {end} THEN {start} ELSE {end} END"


ITEM, REF, OLDER = _id("work_item", "work_item_id"), _id("work_item_ref", "target_work_item_id"), _first("work_items", "work_item_id", "last_synced DESC")
TWO_PART = f"({_id('project', 'by_whom')} || ':' || {SEG.format('p.id')})"
PULL, DEPLOYED = "repo_id || '#' || number", "repo_id || '#' || deployment_id"
_S, _E = _common("a.created_at", "a.completed_at", "b.created_at", "b.completed_at")
_SOURCE, _TARGET = _id("work_item", "source_work_item_id"), _id("work_item", "target_work_item_id")


def _dependency(relation: str, where: str) -> str:
    return f"""SELECT {_edge(relation, _SOURCE, _TARGET, 'd.last_synced', _S, _E)} FROM j d WHERE there AND {where}
        UNION ALL SELECT {_edge(relation, _SOURCE, REF, 'd.last_synced', op="'edge_tombstone'")} FROM j d WHERE there AND {where}
        UNION ALL SELECT {_node('work_item_ref', 'target_work_item_id', 'target_work_item_id', 'd.last_synced')} FROM j d WHERE NOT there AND {where}
        UNION ALL SELECT {_edge(relation, _SOURCE, REF, 'd.last_synced')} FROM j d WHERE NOT there AND {where}""".replace("a.created_at", "d.a_from").replace("a.completed_at", "d.a_to").replace("b.created_at", "d.b_from").replace("b.completed_at", "d.b_to")


CHANGES = {
    "organizations": f"{W('repos')} SELECT DISTINCT {_node('organization', 'org_id', 'org_id', 'TIMESTAMP ' + chr(39) + '1970-01-01 00:00:01' + chr(39))} FROM repos",
    "repositories": f"{W('repos')} SELECT {_node('repository', 'id', 'repo', 'last_synced')} FROM repos",
    "work_items": _placed("work_item", "work_item_id", "title", "last_synced", f"({OLDER})", "created_at", "completed_at", W("work_items", "repos")),
    "pull_requests": _placed("pull_request", PULL, "title", "last_synced", "git_pull_requests", "created_at", "coalesce(merged_at, closed_at)", W("git_pull_requests", "repos")),
    "reviews": f"{W('git_pull_request_reviews')} SELECT {_node('review', 'review_id', 'state', 'submitted_at')} FROM git_pull_request_reviews UNION ALL SELECT {_edge('BELONGS_TO_PULL_REQUEST', _id('review', 'review_id'), _id('pull_request', PULL), 'submitted_at')} FROM git_pull_request_reviews",
    "deployments": _placed("deployment", DEPLOYED, "deployment_id", "last_synced", "deployments", "started_at", "finished_at", W("deployments", "repos")),
    "ci_runs": _placed("ci_run", "run_id", "run_id", "coalesce(finished_at, started_at)", "ci_pipeline_runs", "started_at", "finished_at", W("ci_pipeline_runs", "repos")),
    "incidents": f"{W('operational_incidents')} SELECT {_node('incident', 'id', 'title', 'observed_at', 'started_at', 'resolved_at', 'CASE WHEN is_deleted = 1 THEN ' + chr(39) + 'node_tombstone' + chr(39) + ' ELSE ' + chr(39) + 'node' + chr(39) + ' END')} FROM operational_incidents",
    "dependencies": f"""{DEPS}, j AS (SELECT d.*, a.created_at AS a_from, a.completed_at AS a_to, b.created_at AS b_from, b.completed_at AS b_to, b.work_item_id IS NOT NULL AS there
        FROM d JOIN items a ON a.work_item_id = d.source_work_item_id LEFT JOIN items b ON b.work_item_id = d.target_work_item_id)
        {_dependency('BLOCKS', "relationship_type = 'blocks'")} UNION ALL {_dependency('DEPENDS_ON', "relationship_type <> 'blocks'")}
        UNION ALL SELECT 'orphan_tombstone', 'work_item_ref', {REF}, NULL, NULL, NULL, NULL, NULL, NULL, max(last_synced) FROM j WHERE there GROUP BY target_work_item_id""",
    "hierarchy": f"{W('work_items')}, w AS ({OLDER}) SELECT {_edge('PART_OF', _id('work_item', 'a.work_item_id'), _id('work_item', 'a.parent_id'), 'a.last_synced', _S, _E)} FROM w a JOIN w b ON a.parent_id = b.work_item_id WHERE a.work_item_id <> a.parent_id",
    "deployment_incidents": f"""{W('deployment_incident_edges', 'deployments', 'operational_incidents')}, d AS (SELECT repo_id, deployment_id, min(started_at) AS d_from FROM deployments GROUP BY ALL),
        j AS (SELECT e.*, greatest(d.d_from, i.started_at) AS f, i.resolved_at AS t FROM deployment_incident_edges e LEFT JOIN d USING (repo_id, deployment_id) LEFT JOIN operational_incidents i ON i.id = e.incident_id WHERE incident_id <> 'none')
        SELECT {_edge('CAUSED', _id('deployment', DEPLOYED), _id('incident', 'incident_id'), 'observed_at', 'f', 'CASE WHEN f > t THEN f ELSE t END')} FROM j""",
    "teams": f"{W('team_project_ownership')} SELECT {_node('team', 'team_id', 'team_id', 'max(valid_from)')} FROM team_project_ownership GROUP BY team_id",
    "projects": f"{W('team_project_ownership')} SELECT {_node('project', 'org_id || chr(47) || project_key', 'project_key', 'max(valid_from)')} FROM team_project_ownership GROUP BY org_id, project_key",
    "work_item_projects": f"{W('work_items')} SELECT {_edge('BELONGS_TO_PROJECT', ITEM, _id('project', 'org_id || chr(47) || project_id'), 'last_synced')} FROM ({OLDER})",
    "project_teams": f"""{W('team_project_ownership')}, o AS (SELECT org_id, project_key, team_id, min(valid_from) AS f, (list(valid_to ORDER BY valid_from DESC, (valid_to IS NULL) DESC, valid_to DESC))[1] AS t
        FROM team_project_ownership WHERE project_key IN (SELECT project_key FROM team_project_ownership GROUP BY project_key HAVING count(DISTINCT org_id) = 1) GROUP BY ALL)
        SELECT {_edge('OWNED_BY_TEAM', _id('project', 'org_id || chr(47) || project_key'), _id('team', 'team_id'), 'f', 'f', 't')} FROM o""",
    "incident_repositories": f"""{W('operational_incidents', 'service_mappings', 'repos')}, m AS (SELECT DISTINCT s.org_id, s.service_id, s.repo_id FROM service_mappings s JOIN repos r ON r.id = s.repo_id AND r.org_id = s.org_id WHERE is_active = 1)
        SELECT {_edge('BELONGS_TO_REPOSITORY', _id('incident', 'i.id'), _id('repository', 'm.repo_id'), 'i.started_at', 'i.started_at', 'i.resolved_at')} FROM operational_incidents i JOIN m USING (org_id, service_id) WHERE i.is_deleted = 0""",
    "work_item_teams": f"""{W('work_item_team_attributions', 'work_items', 'team_project_ownership')} SELECT {_edge('OWNED_BY_TEAM', ITEM, _id('team', 'team_id'), 'computed_at')} FROM work_item_team_attributions
        WHERE is_primary = 1 AND team_id <> '' AND work_item_id IN (SELECT work_item_id FROM work_items) AND team_id IN (SELECT team_id FROM team_project_ownership)""",
    "resolved_projects": f"""{W('work_items', 'projects')}, p AS (SELECT id, min(provider) AS by_whom FROM projects GROUP BY id HAVING count(*) = 1)
        SELECT {_edge('BELONGS_TO_PROJECT', ITEM, TWO_PART, 'w.updated_at')} FROM ({OLDER}) w JOIN p ON p.id = w.project_id""",
}

PLAIN |= {
    "omitted_projects": f"""{W('work_items', 'projects')}, p AS (SELECT id, count(*) AS claimants FROM projects GROUP BY id HAVING count(*) > 1), w AS ({OLDER})
        SELECT p.id, claimants, (SELECT count(*) FROM w WHERE w.project_id = p.id) AS items FROM p""",
    "supersession_claims": _first("(SELECT o_custkey % 300 AS member, o_orderdate AS created, o_orderkey AS result FROM orders)", "member", "created, result"),
    "answer_reuse": """WITH j AS (SELECT a.event_id AS request_id, a.user_id % 40 AS question, r.event_id AS result_id, r.ts AS created_at FROM events a JOIN events r ON r.user_id % 40 = a.user_id % 40 AND r.event_id % 2 = 1 AND r.event_type = 'click'
        WHERE a.event_id % 10 = 0 AND r.ts >= TIMESTAMP '2024-01-28') SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, result_id) = 1""",
    "scope_filter": f"{W('repos')} SELECT id, id = 'repo-4' OR repo LIKE 'region!_1/%' ESCAPE '!' AS covered FROM repos",
    "answer_caps": """WITH e AS (SELECT user_id % 12 AS answer, event_type, event_id, CASE event_type WHEN 'click' THEN 10 WHEN 'error' THEN 25 WHEN 'view' THEN 3 ELSE 0 END AS most FROM events),
        r AS (SELECT *, row_number() OVER w AS place, greatest(0, count(*) OVER (PARTITION BY answer, event_type) - most) AS omitted FROM e WINDOW w AS (PARTITION BY answer, event_type ORDER BY event_id))
        SELECT answer, event_type, event_id, place, omitted FROM r WHERE place <= most""",
    "fact_states": f"""{W('ci_pipeline_runs', 'deployments')} SELECT 'continuous_integration' AS fact_kind, (SELECT count(DISTINCT run_id) FROM ci_pipeline_runs WHERE started_at <= {MID}) AS subjects, 'available' AS state
        UNION ALL SELECT 'deployments', (SELECT count(DISTINCT deployment_id) FROM deployments WHERE started_at <= {MID}), 'available' UNION ALL SELECT 'status', 0, 'no_data' UNION ALL SELECT 'evidence', 0, 'unconfigured'""",
    "alias_names": f"{W('repos')} SELECT {_id('repository', 'id')} AS node_id, unnest([repo, split_part(repo, '/', 2), provider || ':' || repo]) AS alias FROM repos",
    "tag_lists": f"{W('repos')} SELECT id, CASE WHEN tags = 'none' THEN '' ELSE 'api,cor' END AS tags FROM repos",
    "search_texts": "SELECT p_partkey, substr(p_name || chr(10) || p_brand || chr(10) || p_type, 1, 20) AS body FROM part",
    "parent_lift": """WITH f AS (SELECT user_id % 9 AS request, event_id AS subject, value / 1000 AS confidence, user_id FROM events WHERE event_id % 7 = 0)
        SELECT request, subject, CASE WHEN subject % 14 = 0 AND subject % 42 <> 0 THEN 'r' || (user_id % 5) END AS parent, CASE WHEN subject % 14 <> 0 THEN 'absent' WHEN subject % 42 = 0 THEN 'ambiguous' ELSE 'lifted' END AS outcome,
        round(CASE WHEN subject % 14 = 0 AND subject % 42 <> 0 THEN confidence * 0.85::DOUBLE END, 9) AS confidence FROM f""",
}


def _without(name: str, part: str, instead: str = "") -> str:
    """A statement without its row filter, for the query over the whole table."""
    if part not in PLAIN[name]:
        raise ValueError(f"{name} does not hold {part}")
    return PLAIN[name].replace(part, instead, 1)


WHOLE = {
    "commit_decisions_all": _without("commit_decisions", " WHERE event_id % 3 = 0"),
    "source_watermarks_all": _without("source_watermarks", "(event_type <> 'view' OR user_id % 2 = 0) AND "),
    "greedy_dedup_all": _without("greedy_dedup", " WHERE l_linenumber <= 6"),
    "question_hashes_all": _without("question_hashes", "substr(text, 1, 200)", "text"),
    "lexical_matches_all": _without("lexical_matches", "(VALUES (1, 'large red widget'), (2, 'blue | ring (steel)'), (3, 'nothing here')) v(query_id, query)", "(SELECT p_partkey AS query_id, p_name AS query FROM part WHERE p_partkey % 50 = 0)"),
    "vector_nearest_all": _without("vector_nearest", "q.vec_id < 5", "q.vec_id % 50 = 0"),
    "answer_reuse_all": """SELECT a.event_id AS request_id, a.user_id % 40 AS question, r.event_id AS result_id, r.ts AS created_at
        FROM events a JOIN events r ON r.user_id % 40 = a.user_id % 40 AND r.event_id % 2 = a.event_id % 2 AND r.event_type = a.event_type AND r.ts >= TIMESTAMP '2024-01-28'
        QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY r.ts DESC, r.event_id) = 1""",
    "parent_lift_all": """SELECT user_id % 9 AS request, event_id AS subject, CASE WHEN event_type NOT IN ('view', 'purchase') THEN 'u' || user_id END AS parent,
        CASE event_type WHEN 'view' THEN 'absent' WHEN 'purchase' THEN 'ambiguous' ELSE 'lifted' END AS outcome, round(CASE WHEN event_type NOT IN ('view', 'purchase') THEN value / 1000 * 0.85::DOUBLE END, 9) AS confidence FROM events""",
}


def oracle_sql() -> dict[str, str]:
    return PLAIN | WHOLE | answers.STATEMENTS | rounds.STATEMENTS | fact_rounds.STATEMENTS | retrievals.STATEMENTS | daily.STATEMENTS | {f"evidence_{n}": s for n, s in EVIDENCE.items()} | {f"facts_{n}": s for n, s in FACTS.items()} | {f"changes_{n}": s for n, s in CHANGES.items()}
