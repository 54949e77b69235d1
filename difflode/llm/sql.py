"""DuckDB SQL for the pN_ queries that SQL can express."""

from __future__ import annotations

_REPO = """CASE WHEN trim({c}, ' /\\') = '' OR {c} IS NULL THEN NULL
  ELSE regexp_replace(regexp_replace(regexp_replace(lower(trim({c}, ' /')), '\\.git$', ''), '^([^/:]+?)__([^/:]+)$', '\\1/\\2'),
       '^(?:.*[/:])?([^/:]+)/([^/:]+)$', '\\1/\\2') END"""


def _repo(c: str) -> str:
    return _REPO.format(c=c)


def _similar(src: str, least: int, where: str = "", extra: str = "") -> str:
    """SQL tables ``m(grp, id, cid)`` and ``v(x, y)``: members of word-set classes and pairs of similar classes, by the rarest words of each set."""
    return f"""wd AS (SELECT DISTINCT grp, id{extra}, list_sort(list_distinct(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'))) AS ws FROM {src} WHERE id IS NOT NULL AND t IS NOT NULL {where}),
cl AS (SELECT *, row_number() OVER (ORDER BY grp, ws) AS cid FROM (SELECT DISTINCT grp, ws FROM wd WHERE len(ws) >= {least})), m AS (SELECT wd.grp, id{extra}, cid FROM wd JOIN cl ON cl.grp = wd.grp AND cl.ws = wd.ws),
un AS (SELECT cid, grp, unnest(ws) AS w FROM cl), fq AS (SELECT grp, w, count(*) AS df FROM un GROUP BY ALL), rk AS (SELECT cid, grp, w, row_number() OVER (PARTITION BY cid ORDER BY df, w) AS i, count(*) OVER (PARTITION BY cid) AS n FROM un JOIN fq USING (grp, w)),
px AS (SELECT * FROM rk WHERE i <= n - ceil(0.7::DOUBLE * n - 1e-9) + 1), kd AS (SELECT DISTINCT a.cid AS x, b.cid AS y FROM px a JOIN px b ON a.grp = b.grp AND a.w = b.w AND a.cid < b.cid AND a.n >= 0.7::DOUBLE * b.n - 1e-9 AND b.n >= 0.7::DOUBLE * a.n - 1e-9),
v AS (SELECT x, y FROM (SELECT x, y, len(list_intersect(a.ws, b.ws)) AS s, len(a.ws) + len(b.ws) AS n FROM kd JOIN cl a ON a.cid = x JOIN cl b ON b.cid = y) WHERE s / (n - s) >= 0.7::DOUBLE - 1e-12)"""


def oracle_sql() -> dict[str, str]:
    capped = f"""WITH recs AS (
 SELECT 'fewshot_pool' AS pool, example_id AS record_id, min({_repo('repo')}) AS r, max(CASE WHEN isnan(quality_score) THEN NULL ELSE quality_score END) AS s FROM fewshot_pool GROUP BY example_id
 UNION ALL
 SELECT 'candidates', sha, min({_repo('repo')}), max(CASE WHEN isnan(score) THEN NULL ELSE score END) FROM candidates GROUP BY sha),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pool, r ORDER BY s DESC NULLS LAST, record_id) AS k FROM recs)
SELECT ranked.pool, record_id FROM ranked JOIN contributor_caps c ON c.pool = ranked.pool WHERE r IS NOT NULL AND k > max_rows"""
    share = f"""WITH recs AS (SELECT 'fewshot_pool' AS pool, example_id AS id, min({_repo('repo')}) AS r FROM fewshot_pool GROUP BY example_id UNION ALL SELECT 'candidates', sha, min({_repo('repo')}) FROM candidates GROUP BY sha),
n AS (SELECT pool, r, count(*) AS c FROM recs GROUP BY ALL), f AS (SELECT pool, coalesce(sum(c) FILTER (r IS NULL), 0) AS free, max(c) FILTER (r IS NOT NULL) AS most FROM n GROUP BY pool),
t AS (SELECT f.pool, free, s.t, sum(least(n.c, s.t)) AS kept, sum(greatest(n.c - s.t, 0)) AS dropped, max(least(n.c, s.t)) AS largest FROM f, LATERAL (SELECT unnest(generate_series(1, most)) AS t) s JOIN n ON n.pool = f.pool AND n.r IS NOT NULL GROUP BY ALL)
SELECT pool, (free + arg_max(kept, t))::BIGINT AS kept, arg_max(dropped, t)::BIGINT AS dropped, arg_max(largest, t) AS largest FROM t WHERE t <= 0.05::DOUBLE * (free + kept) + 1e-9 GROUP BY pool, free"""
    families = f"""WITH RECURSIVE s AS (SELECT DISTINCT sample_id, {_repo('repo')} AS r FROM attribution_samples WHERE sample_id IS NOT NULL),
i AS (SELECT DISTINCT sample_id, lower(trim(c)) AS c FROM (SELECT sample_id, unnest(source_atomic_commit_ids) AS c FROM edit_units) WHERE trim(c) <> '' AND sample_id IN (SELECT sample_id FROM s)), d AS (SELECT DISTINCT c FROM i),
m AS (SELECT a.c, coalesce(b.c, a.c) AS f FROM d a LEFT JOIN d b ON length(a.c) < 40 AND length(b.c) > length(a.c) AND starts_with(b.c, a.c)),
k AS (SELECT sample_id, 'r' || r AS key FROM s WHERE r IS NOT NULL UNION SELECT sample_id, 'c' || f FROM i JOIN m USING (c)), e AS (SELECT DISTINCT a.key AS x, b.key AS y FROM k a JOIN k b USING (sample_id)),
g AS (SELECT DISTINCT key AS x, key AS y FROM k UNION SELECT g.x, e.y FROM g JOIN e ON e.x = g.y),
h AS (SELECT x, min(y) FILTER (y[1] = 'r') AS repo, min(y) AS low FROM g GROUP BY x), o AS (SELECT sample_id, min(repo) AS repo, min(low) AS low FROM k JOIN h ON h.x = k.key GROUP BY sample_id), q AS (SELECT s.sample_id, o.repo, coalesce(o.low, s.sample_id) AS low FROM (SELECT DISTINCT sample_id FROM s) s LEFT JOIN o USING (sample_id))
SELECT sample_id, coalesce(substr(repo, 2), min(sample_id) OVER (PARTITION BY low)) AS family_key FROM q"""
    texts = """SELECT 'message' AS grp, log_id AS id, message AS t FROM commit_log UNION ALL SELECT 'commit_message', row_id, commit_message FROM commit_pool UNION ALL SELECT 'git_diff', row_id, git_diff FROM commit_pool"""
    near = f"""WITH src AS ({texts}), {_similar('src', 8)}
SELECT DISTINCT grp AS field, least(a, b) AS id_a, greatest(a, b) AS id_b FROM (SELECT m.grp, m.id AS a, o.id AS b FROM m JOIN m o ON m.cid = o.cid AND m.id < o.id UNION ALL SELECT m.grp, m.id, o.id FROM v JOIN m ON m.cid = v.x JOIN m o ON o.cid = v.y WHERE m.id <> o.id)"""
    split = lambda c: f"CASE WHEN regexp_replace(lower({c}), '[^a-z]+', '', 'g') IN ('train', 'training', 'trainset', 'trn', 'tr') THEN 1 WHEN regexp_replace(lower({c}), '[^a-z]+', '', 'g') IN ('dev', 'devel', 'development', 'devset', 'val', 'valid', 'validation', 'validate', 'valset', 'test', 'testing', 'testset', 'tst', 'finaltest', 'testfinal', 'final', 'heldouttest') THEN 0 END"
    sides = f"""src AS (SELECT 'attribution_samples' AS grp, sample_id AS id, diff_text AS t, {split('split')} AS side FROM attribution_samples UNION ALL SELECT 'fewshot_pool', example_id, subject, {split('split')} FROM fewshot_pool), {_similar('src', 1, 'AND side IS NOT NULL', ', side')}"""
    pairs = f"""{sides},
rv AS (SELECT DISTINCT example_id AS id, nullif(lower(trim(sha)), '') AS c, {split('split')} AS side FROM fewshot_pool), rd AS (SELECT DISTINCT c FROM rv WHERE c IS NOT NULL AND side IS NOT NULL), rm AS (SELECT a.c, coalesce(b.c, a.c) AS f FROM rd a LEFT JOIN rd b ON length(a.c) < 40 AND length(b.c) > length(a.c) AND starts_with(b.c, a.c)), rf AS (SELECT DISTINCT id, side, f FROM rv JOIN rm USING (c) WHERE side IS NOT NULL),
vv AS (SELECT x, y FROM v UNION ALL SELECT y, x FROM v UNION ALL SELECT cid, cid FROM cl),
pe AS (SELECT m.grp, m.id AS ev, o.id AS tr FROM vv JOIN m ON m.cid = vv.x AND m.side = 0 JOIN m o ON o.cid = vv.y AND o.side = 1 WHERE m.id <> o.id UNION SELECT 'fewshot_pool', p.id, q.id FROM rf p JOIN rf q ON p.f = q.f AND p.side = 0 AND q.side = 1 WHERE p.id <> q.id)"""
    across = f"WITH {pairs} SELECT DISTINCT grp AS origin, least(ev, tr) AS id_a, greatest(ev, tr) AS id_b FROM pe"
    name = lambda c: f"CASE WHEN {split(c)} = 0 THEN CASE WHEN regexp_matches(lower({c}), 'd|v') AND NOT regexp_matches(lower({c}), 'held') THEN 'dev' ELSE 'test' END END"
    report = f"""WITH {pairs}, me AS (SELECT 'attribution_samples' AS grp, sample_id AS ev, min({name('split')}) AS split, min({_repo('repo')}) AS repo FROM attribution_samples WHERE {split('split')} = 0 GROUP BY sample_id UNION ALL SELECT 'fewshot_pool', example_id, min({name('split')}), min({_repo('repo')}) FROM fewshot_pool WHERE {split('split')} = 0 GROUP BY example_id)
SELECT grp AS origin, split, repo, count(*) AS pairs, count(DISTINCT ev) AS eval_records FROM pe JOIN me USING (grp, ev) GROUP BY ALL"""
    sided = f"""WITH {sides}, fl AS (SELECT cid, min(id) AS class_id, max(side) = 1 AS t, min(side) = 0 AS e FROM m GROUP BY cid), vv AS (SELECT x, y FROM v UNION ALL SELECT y, x FROM v UNION ALL SELECT cid, cid FROM cl),
lk AS (SELECT x AS cid, s AS side, count(DISTINCT y) AS links FROM vv JOIN fl a ON a.cid = x JOIN fl b ON b.cid = y, (VALUES (0), (1)) q(s) WHERE (s = 1 AND a.t AND b.e) OR (s = 0 AND a.e AND b.t) GROUP BY ALL)
SELECT DISTINCT m.grp AS origin, m.id, m.side = 1 AS is_train, class_id, links FROM m JOIN lk USING (cid, side) JOIN fl USING (cid)"""
    groups = f"""WITH RECURSIVE src AS ({texts}), {_similar('src', 8)}, vv AS (SELECT x, y FROM v UNION SELECT y, x FROM v), fi AS (SELECT cid, min(id) AS class_id FROM m GROUP BY cid), g AS (SELECT DISTINCT x, x AS y FROM vv UNION SELECT g.x, vv.y FROM g JOIN vv ON vv.x = g.y),
lw AS (SELECT g.x AS cid, min(class_id) AS group_id FROM g JOIN fi ON fi.cid = g.y GROUP BY g.x), ln AS (SELECT x AS cid, count(*) AS links FROM vv GROUP BY x)
SELECT DISTINCT m.grp AS field, m.id, class_id, coalesce(group_id, class_id) AS group_id, coalesce(links, 0) AS links FROM m JOIN fi USING (cid) LEFT JOIN lw USING (cid) LEFT JOIN ln USING (cid)"""
    return {"p1_found": families, "p2_found": near, "p2_groups": groups, "p4_found": capped, "p4_share": share, "p5_found": across, "p5_groups": sided, "p5_report": report}
