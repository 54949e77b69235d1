"""DuckDB SQL for the general queries, written apart from the operators as their check."""

from __future__ import annotations


def repo(c: str) -> str:
    """SQL for the canonical name of a repository column."""
    return f"""CASE WHEN {c} IS NULL OR trim({c}, ' /\\') = '' THEN NULL
  ELSE regexp_replace(regexp_replace(regexp_replace(lower(trim({c}, ' /')), '\\.git$', ''), '^([^/:]+?)__([^/:]+)$', '\\1/\\2'), '^(?:.*[/:])?([^/:]+)/([^/:]+)$', '\\1/\\2') END"""


def split(c: str) -> str:
    """SQL for the canonical name of a split column."""
    s = f"regexp_replace(lower({c}), '[^a-z]+', '', 'g')"
    return f"""CASE WHEN {s} IN ('train','training','trainset','trn','tr') THEN 'train' WHEN {s} IN ('dev','devel','development','devset','val','valid','validation','validate','valset') THEN 'dev'
  WHEN {s} IN ('test','testing','testset','tst','finaltest','testfinal','final','heldouttest') THEN 'test' WHEN {s} <> '' THEN {s} END"""


LOG = "(SELECT DISTINCT log_id, repo, sha, subject, message, message_score, commit_date FROM commit_log)"
POOL = "(SELECT DISTINCT row_id, repo, sha, language, type, subject, changed_files, file_count, git_diff FROM commit_pool)"
UNITS = "(SELECT DISTINCT unit_id, sample_id, repo, file_path, patch_text, file_role, language, gold_intent_id, provenance_status FROM edit_units)"
SAMPLES = f"(SELECT DISTINCT sample_id, repo, {split('split')} AS split, k, is_multi_intent, gold_count, intent_types, sample_weight, source_kind FROM attribution_samples)"
FEW = "(SELECT DISTINCT * EXCLUDE (updated_at) FROM fewshot_pool)"
CAND = "(SELECT DISTINCT sha, repo, commit_date, subject, message, score FROM candidates)"
VOTES = """(WITH lab AS (SELECT DISTINCT doc_id, area, annotator_id FROM subject_labels),
 two AS (SELECT doc_id, min(annotator_id) a, max(annotator_id) b FROM lab GROUP BY doc_id HAVING min(annotator_id) < max(annotator_id))
 SELECT two.doc_id, s.area, coalesce(max(CASE WHEN lab.annotator_id = two.a THEN 1 ELSE 0 END), 0) x, coalesce(max(CASE WHEN lab.annotator_id = two.b THEN 1 ELSE 0 END), 0) y
 FROM two CROSS JOIN subject_areas s LEFT JOIN lab ON lab.doc_id = two.doc_id AND lab.area = s.area GROUP BY two.doc_id, s.area)"""
MSG = """m AS (SELECT {key}, replace(coalesce({c}, ''), chr(13), '') AS m FROM {src}),
l AS (SELECT *, list_filter(string_split(m, chr(10)), lambda x: trim(x) <> '') AS ls FROM m),
s AS (SELECT *, coalesce(trim(ls[1]), '') AS subject, lower(coalesce(trim(ls[1]), '')) AS low FROM l)"""
BREAKING = "(regexp_matches(m, 'BREAKING[ -]CHANGE') OR regexp_matches(low, '^[a-z]+(\\([^)]*\\))?!: '))"
MULTI = "regexp_matches(low, '( and | also |; | plus |, )')"
RANKED = """d AS (SELECT quality_score::DOUBLE AS s, sum({t}::DOUBLE) AS pos, count(*)::DOUBLE AS n FROM {few} WHERE {t} IS NOT NULL AND quality_score IS NOT NULL AND NOT isnan(quality_score) GROUP BY 1),
r AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM d)"""
ROLE = """CASE WHEN p IS NULL OR trim(p) = '' THEN 'unknown'
 WHEN regexp_matches(p, '(^|/)(test|tests|__tests__|spec)/|(^|/)test_[^/]*$|[._](test|spec)\\.[a-z]+$') THEN 'test'
 WHEN regexp_matches(p, '(^|/)(\\.github|\\.gitlab|\\.circleci|ci)/|(^|/)(jenkinsfile|\\.travis\\.yml)$') THEN 'ci'
 WHEN regexp_matches(p, '(^|/)(doc|docs)/|\\.(md|rst|txt|adoc)$') THEN 'docs'
 WHEN regexp_matches(p, '(^|/)(build|scripts|tools)/|(^|/)(makefile|dockerfile|cmakelists\\.txt|pom\\.xml|build\\.gradle)$') THEN 'build'
 WHEN regexp_matches(p, '(^|/)(config|conf)/|\\.(ya?ml|json|toml|ini|cfg|lock)$') THEN 'config'
 WHEN regexp_matches(p, '\\.(py|js|ts|go|c|h|cc|cpp|java|rs|sh|rb|cs|kt|scala|php|swift)$') THEN 'source' ELSE 'other' END"""
CLUSTERS = f"""u AS (SELECT sample_id AS g, gold_intent_id AS gold, file_path AS pred FROM {UNITS} WHERE sample_id IS NOT NULL AND gold_intent_id IS NOT NULL AND file_path IS NOT NULL),
cell AS (SELECT g, gold, pred, count(*)::DOUBLE n FROM u GROUP BY ALL), ra AS (SELECT g, gold, sum(n) a FROM cell GROUP BY ALL), cb AS (SELECT g, pred, sum(n) b FROM cell GROUP BY ALL),
c AS (SELECT g, sum(n) n, sum(n*(n-1)/2) tp, sum(n*n/b) bp, sum(n*n/a) br FROM cell JOIN ra USING (g, gold) JOIN cb USING (g, pred) GROUP BY g),
i AS (SELECT cell.g, sum(cell.n / c.n * log2(cell.n * c.n / (a * b))) mi FROM cell JOIN ra USING (g, gold) JOIN cb USING (g, pred) JOIN c ON c.g = cell.g GROUP BY cell.g),
ha AS (SELECT ra.g, sum(a*(a-1)/2) ga, -sum(a / c.n * log2(a / c.n)) h FROM ra JOIN c ON c.g = ra.g GROUP BY ra.g), hb AS (SELECT cb.g, sum(b*(b-1)/2) gb, -sum(b / c.n * log2(b / c.n)) h FROM cb JOIN c ON c.g = cb.g GROUP BY cb.g),
x AS (SELECT c.*, mi, ga, ha.h AS ha, gb, hb.h AS hb, CASE WHEN n > 1 THEN ga*gb/(n*(n-1)/2) END AS e, (ga+gb)/2 AS most FROM c JOIN i USING (g) JOIN ha USING (g) JOIN hb USING (g)),
out AS (SELECT g AS sample_id, n::BIGINT AS units, round(CASE WHEN tp > 0 THEN 2*tp/(ga+gb) ELSE 0 END, 6) AS pair_f1,
 round(CASE WHEN abs(most - coalesce(e, 0)) < 1e-12 THEN 1 ELSE (tp - e)/(most - e) END, 6) AS ari,
 round(CASE WHEN ha < 1e-12 AND hb < 1e-12 THEN 1 ELSE 2*mi/(ha+hb) END, 6) AS nmi, round(2*(bp/n)*(br/n)/(bp/n+br/n), 6) AS bcubed_f1 FROM x)"""


def overlap(src: str) -> str:
    """SQL for shared keys and Jaccard of every two groups of ``src(g, k)``."""
    return f"""WITH d AS (SELECT DISTINCT g, k FROM ({src}) WHERE g IS NOT NULL AND k IS NOT NULL), n AS (SELECT g, count(*) n FROM d GROUP BY g),
p AS (SELECT a.g a, b.g b, count(*) shared FROM d a JOIN d b ON a.k = b.k AND a.g < b.g GROUP BY ALL)
SELECT p.a, p.b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN n x ON x.g = p.a JOIN n y ON y.g = p.b"""


def oracle_sql() -> dict[str, str]:
    """The SQL by query name."""
    nosc = "CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
    unit = "(('0x' || substr(sha256('3|' || repo), 1, 8))::BIGINT / 4294967295.0::DOUBLE)"
    platt = "(1 / (1 + exp(-(1.2 * ln(q / (1 - q)) - 0.1))))"
    return {
        "message_features": f"""WITH {MSG.format(key='log_id', c='message', src=LOG)}
 SELECT log_id, subject, length(m)::BIGINT AS n_chars, len(ls)::BIGINT AS n_lines, length(subject)::BIGINT AS subject_chars,
 len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t]*([-*]|[0-9]+[.)])[ \\t]')))::BIGINT AS n_bullets,
 len(list_filter(regexp_split_to_array(m, '\\n[ \\t]*\\n'), lambda x: trim(regexp_replace(x, '[\\n\\t]', '', 'g')) <> ''))::BIGINT AS n_paragraphs,
 regexp_extract(low, '^([a-z]+)(\\([^)]*\\))?!?: ', 1) AS prefix, {BREAKING} AS is_breaking, regexp_matches(m, '#[0-9]+') AS has_issue,
 regexp_matches(m, '(^|\\n)[A-Z][A-Za-z]+-[A-Za-z-]+: ') AS has_trailer, regexp_matches(low, '^(merge |revert |wip|fixup!|squash!|bump |release )') AS is_noise, {MULTI} AS multi_marker FROM s""",
        "diff_features": f"""WITH p AS (SELECT row_id, coalesce(git_diff, '') AS d, string_split(chr(10) || coalesce(git_diff, ''), chr(10) || 'diff --git ')[2:] AS ps FROM {POOL}),
 c AS (SELECT row_id, d, list_transform(ps, lambda q: len(list_filter(string_split(q, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')))) AS ad,
  list_transform(ps, lambda q: len(list_filter(string_split(q, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')))) AS de FROM p),
 e AS (SELECT *, list_transform(list_zip(ad, de), lambda z: z[1] + z[2]) AS ch, coalesce(list_sum(ad), 0) AS a, coalesce(list_sum(de), 0) AS b FROM c),
 f AS (SELECT *, list_filter(ch, lambda x: x > 0) AS pf, (a + b)::DOUBLE AS t FROM e)
 SELECT row_id, len(ad)::BIGINT AS n_files, len(list_filter(string_split(d, chr(10)), lambda x: starts_with(x, '@@ ')))::BIGINT AS n_hunks, a::BIGINT AS added, b::BIGINT AS deleted, (a + b)::BIGINT AS changed,
 round(CASE WHEN t > 0 THEN -list_sum(list_transform(pf, lambda x: x / t * ln(x / t + 1e-9))) ELSE 0 END, 6) AS entropy,
 round(CASE WHEN t > 0 THEN 1 - list_sum(list_transform(pf, lambda x: (x / t) * (x / t))) ELSE 0 END, 6) AS gini, round(CASE WHEN t > 0 THEN list_max(ch) / t ELSE 0 END, 6) AS dominant FROM f""",
        "role_confusion": f"SELECT stored, {ROLE} AS derived, count(*) AS n FROM (SELECT coalesce(nullif(trim(file_role), ''), 'missing') AS stored, lower(replace(file_path, '\\', '/')) AS p FROM {UNITS}) GROUP BY ALL",
        "module_spread": f"SELECT CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE '.' END AS module, count(*) AS units, count(DISTINCT file_path) AS files FROM (SELECT file_path, regexp_replace(replace(file_path, '\\', '/'), '^(\\./|/)+', '') AS p FROM {UNITS} WHERE file_path IS NOT NULL) GROUP BY 1",
        "repo_identity": f"""SELECT repo AS spelling, {repo('repo')} AS repo, CASE WHEN repo IS NULL OR trim(repo) = '' THEN 'blank' WHEN regexp_matches(repo, '^[a-z]+://') THEN 'address' WHEN regexp_matches(repo, '^[^/]+@[^/]+:') THEN 'ssh'
 WHEN contains(repo, '__') THEN 'joined' WHEN regexp_matches(repo, '^[^/]+/[^/]+/[^/]+$') THEN 'host' ELSE 'slug' END AS form, count(*) AS n FROM {LOG} t GROUP BY t.repo""",
        "type_prevalence": f"WITH g AS (SELECT type, count(*) n FROM {POOL} WHERE type IS NOT NULL GROUP BY 1) SELECT type, n, round(n / sum(n) OVER (), 6) AS share, round((n - avg(n) OVER ()) / greatest(stddev_pop(n) OVER (), 1e-9), 6) AS z FROM g",
        "repo_stats": f"""WITH d AS (SELECT {repo('repo')} AS repo, file_count AS v FROM {POOL} WHERE file_count IS NOT NULL), a AS (SELECT avg(v) m, stddev_pop(v) s FROM d WHERE repo IS NOT NULL)
 SELECT repo, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round((avg(v) - any_value(a.m)) / (any_value(a.s) + 1e-9), 6) AS z FROM d, a WHERE repo IS NOT NULL GROUP BY repo""",
        "length_protocol": f"""WITH d AS (SELECT type, length(subject) AS v FROM {POOL} WHERE type IS NOT NULL AND subject IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY type) AS n FROM d)
 SELECT type, max(n) AS n, max(v) FILTER (i = round_even((n - 1) * 0.1, 0)) AS q10, max(v) FILTER (i = round_even((n - 1) * 0.5, 0)) AS q50, max(v) FILTER (i = round_even((n - 1) * 0.85, 0)) AS q85, max(v) FILTER (i = round_even((n - 1) * 0.9, 0)) AS q90 FROM r GROUP BY type""",
        "robust_reference": f"""WITH d AS (SELECT CASE WHEN contains(message, chr(10)) THEN 'long' ELSE 'short' END AS grp, message_score AS v FROM {LOG} WHERE message_score IS NOT NULL AND NOT isnan(message_score)), m AS (SELECT grp, median(v) m FROM d GROUP BY 1)
 SELECT grp, count(*) AS n, round(any_value(m), 6) AS median, round(median(abs(v - m)), 6) AS mad FROM d JOIN m USING (grp) GROUP BY grp""",
        "annotator_agreement": f"""WITH g AS (SELECT area, count(*) n, avg((x = y)::INT) po, avg(x) pa, avg(y) pb FROM {VOTES} GROUP BY 1), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM g)
 SELECT area, n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM e""",
        "annotator_confusion": f"SELECT x, y, count(*) AS n FROM {VOTES} GROUP BY ALL",
        "count_agreement": f"""WITH d AS (SELECT gold_count::DOUBLE x, k::DOUBLE y FROM {SAMPLES} WHERE gold_count IS NOT NULL AND k IS NOT NULL),
 f AS (SELECT sum(a.n * b.n * (a.x - b.y) * (a.x - b.y)) / sum(a.n * b.n) v FROM (SELECT x, count(*)::DOUBLE n FROM d GROUP BY 1) a, (SELECT y, count(*)::DOUBLE n FROM d GROUP BY 1) b)
 SELECT count(*) AS n, round(CASE WHEN any_value(f.v) > 0 THEN 1 - avg((x - y) * (x - y)) / any_value(f.v) END, 6) AS weighted_kappa FROM d, f""",
        "count_quality": f"SELECT split, count(*) AS n, round(avg((gold_count = k)::INT), 6) AS accuracy, round(avg(abs(gold_count - k)), 6) AS mae, round(avg((k < gold_count)::INT), 6) AS under, round(avg((k > gold_count)::INT), 6) AS over FROM {SAMPLES} WHERE gold_count IS NOT NULL AND k IS NOT NULL GROUP BY split",
        "verified_precision": f"""WITH g AS (SELECT type_pair, count(*)::DOUBLE n, sum((verified_multi_intent = 1)::INT)::DOUBLE k FROM {FEW} WHERE verified_multi_intent IS NOT NULL GROUP BY 1), w AS (SELECT *, k / n AS p, 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) AS h FROM g)
 SELECT type_pair, n::BIGINT AS n, k::BIGINT AS k, round(p, 6) AS precision, round(greatest(0, (p + 3.8416 / (2 * n) - h) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (p + 3.8416 / (2 * n) + h) / (1 + 3.8416 / n)), 6) AS high FROM w""",
        "score_ranking": f"""WITH {RANKED.format(t='fewshot_eligible', few=FEW)}, o AS (SELECT fewshot_eligible::DOUBLE t, quality_score s, greatest(1e-8, least(1 - 1e-8, quality_score)) q FROM {FEW} WHERE fewshot_eligible IS NOT NULL AND quality_score IS NOT NULL AND NOT isnan(quality_score)),
 k AS (SELECT t, avg_rank FROM (SELECT t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS avg_rank FROM o)), a AS (SELECT sum(t) p, sum(1 - t) n, sum(t * avg_rank) sr FROM k)
 SELECT (SELECT count(*) FROM o) AS rows, (SELECT round((sr - p * (p + 1) / 2) / (p * n), 6) FROM a) AS auroc, (SELECT round(sum(pos * tp / seen) / sum(pos), 6) FROM r) AS auprc,
 (SELECT round(avg((s - t) * (s - t)), 6) FROM o) AS brier, (SELECT round(avg(-(t * ln(q) + (1 - t) * ln(1 - q))), 6) FROM o) AS log_loss, (SELECT round(avg(((s >= 0.5)::INT = t)::INT), 6) FROM o) AS accuracy""",
        "score_reliability": f"SELECT least(9, floor(quality_score * 10))::INT AS bin, count(*) AS n, round(avg(quality_score), 6) AS mean_score, round(avg(fewshot_eligible), 6) AS rate, round(abs(avg(quality_score) - avg(fewshot_eligible)), 6) AS gap FROM {FEW} WHERE fewshot_eligible IS NOT NULL AND quality_score IS NOT NULL AND NOT isnan(quality_score) GROUP BY 1",
        "precision_threshold": f"WITH d AS (SELECT round(quality_score::DOUBLE, 6) AS s, fewshot_eligible AS y FROM {FEW} WHERE fewshot_eligible IS NOT NULL AND quality_score IS NOT NULL AND NOT isnan(quality_score)), t AS (SELECT a.s, sum(b.y)::DOUBLE AS hits, count(*)::DOUBLE AS n FROM (SELECT DISTINCT s FROM d) a JOIN d b ON b.s > a.s GROUP BY a.s), x AS (SELECT max(s) FILTER (hits >= 0.8 * n) AS s, max(n) AS most FROM t) SELECT coalesce(x.s, 0.5) AS threshold, t.hits::BIGINT AS hits, coalesce(t.n, x.most)::BIGINT AS selected, x.s IS NULL AS used_fallback FROM x LEFT JOIN t ON t.s = x.s",
        "selective_risk": f"WITH {RANKED.format(t='(1 - fewshot_eligible)', few=FEW)}, x AS (SELECT *, ceil(seen * 10 / (SELECT sum(n) FROM d))::INT AS step FROM r) SELECT step, max(seen)::BIGINT AS rows, round(arg_max(tp, seen) / max(seen), 6) AS risk FROM x GROUP BY step",
        "intent_clusters": f"WITH {CLUSTERS} SELECT * FROM out",
        "file_baseline": f"WITH {CLUSTERS} SELECT split, count(*) AS samples, round(avg(pair_f1), 6) AS pair_f1, round(avg(bcubed_f1), 6) AS bcubed_f1 FROM out JOIN {SAMPLES} s USING (sample_id) GROUP BY split",
        "score_tiers": f"""WITH d AS (SELECT greatest(1e-8, least(1 - 1e-8, message_score)) AS q FROM {LOG} WHERE message_score IS NOT NULL AND NOT isnan(message_score)), e AS (SELECT {platt} AS p FROM d)
 SELECT CASE WHEN p > 0.6 THEN 'A' WHEN p > 0.4 THEN 'B' ELSE 'C' END AS tier, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(-(p * ln(p) + (1 - p) * ln(1 - p))), 6) AS mean_entropy FROM e GROUP BY 1""",
        "calibrated_scores": f"""SELECT example_id, round(CASE WHEN s <= 0.1 THEN 0.05 WHEN s <= 0.4 THEN 0.05 + (s - 0.1) * 0.25 / 0.3 WHEN s <= 0.7 THEN 0.3 + (s - 0.4) * 0.5 / 0.3 WHEN s <= 0.9 THEN 0.8 + (s - 0.7) * 0.15 / 0.2 ELSE 0.95 END, 6) AS p
 FROM (SELECT example_id, quality_score AS s FROM {FEW} WHERE quality_score IS NOT NULL AND NOT isnan(quality_score))""",
        "quota_sample": f"SELECT * FROM (SELECT row_id, coalesce(language, 'unknown') AS language, row_number() OVER (PARTITION BY coalesce(language, 'unknown') ORDER BY sha256('13|' || row_id), row_id) AS rank FROM {POOL}) WHERE rank <= 5",
        "proportional_sample": f"SELECT row_id, language, rank FROM (SELECT row_id, coalesce(language, 'unknown') AS language, row_number() OVER (PARTITION BY coalesce(language, 'unknown') ORDER BY sha256('7|' || row_id), row_id) AS rank, count(*) OVER (PARTITION BY coalesce(language, 'unknown')) AS n FROM {POOL}) WHERE rank <= greatest(1, floor(n * 0.1))",
        "round_robin_sample": f"SELECT row_number() OVER (ORDER BY r, type, row_id) AS position, row_id, type FROM (SELECT row_id, coalesce(type, 'unknown') AS type, row_number() OVER (PARTITION BY coalesce(type, 'unknown') ORDER BY sha256('5|' || row_id), row_id) AS r FROM {POOL}) QUALIFY position <= 30",
        "score_bands": f"SELECT example_id, type_pair, least(4, floor((row_number() OVER (PARTITION BY type_pair ORDER BY quality_score, example_id) - 1) * 5 / count(*) OVER (PARTITION BY type_pair)))::INT AS band FROM {FEW} WHERE quality_score IS NOT NULL AND NOT isnan(quality_score)",
        "hash_splits": f"WITH x AS (SELECT log_id, {repo('repo')} AS repo FROM {LOG}) SELECT CASE WHEN {unit} < 0.8 THEN 'train' WHEN {unit} < 0.9 THEN 'dev' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT repo) AS repos FROM x WHERE repo IS NOT NULL GROUP BY 1",
        "split_usage": f"SELECT split, count(*) AS n, count(DISTINCT {repo('repo')}) AS repos, sum(is_multi_intent::INT)::BIGINT AS multi FROM {SAMPLES} GROUP BY split",
        "split_repo_overlap": overlap(f"SELECT split AS g, {repo('repo')} AS k FROM {SAMPLES}"),
        "table_repo_overlap": overlap(" UNION ALL ".join(f"SELECT '{t}' AS g, {repo('repo')} AS k FROM {t}" for t in ("attribution_samples", "candidates", "commit_log", "commit_pool", "fewshot_pool"))),
        "first_delivery": "SELECT sha, strftime(min(ingested_at), '%Y-%m-%d %H:%M:%S.%f') AS arrived, count(*) AS deliveries FROM candidates GROUP BY sha",
        "latest_delivery": "SELECT example_id, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S.%f') AS arrived, count(*) AS deliveries FROM fewshot_pool GROUP BY example_id",
        "best_evidence": f"SELECT repo, arg_min(sha, rk) AS sha, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC NULLS LAST, sha) AS rk FROM (SELECT {repo('repo')} AS repo, sha, {nosc.format(c='score')} AS score FROM {CAND}) WHERE repo IS NOT NULL) GROUP BY repo",
        "subject_overlap": f"""WITH x AS (SELECT 'f' t, subject s FROM {FEW} UNION ALL SELECT 'c', subject FROM {CAND} UNION ALL SELECT 'l', subject FROM {LOG}), g AS (SELECT trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) v, count(DISTINCT t) AS tables, count(*) AS rows FROM x WHERE s IS NOT NULL GROUP BY 1)
 SELECT tables, count(*) AS subjects, sum(rows)::BIGINT AS rows FROM g WHERE v <> '' GROUP BY tables""",
        "reject_ladder": f"""WITH x AS (SELECT {repo('repo')} AS r, coalesce(trim(subject), '') AS s, coalesce(trim(message), '') AS m, score FROM {CAND})
 SELECT CASE WHEN r IS NULL THEN 'no_repo' WHEN s = '' THEN 'no_subject' WHEN length(s) < 20 THEN 'short_subject' WHEN m = '' THEN 'no_message' WHEN regexp_matches(lower(s), '^(merge|revert|wip|fixup|bump)') THEN 'noise' WHEN score IS NULL OR isnan(score) THEN 'no_score' ELSE 'accepted' END AS reason, count(*) AS n FROM x GROUP BY 1""",
        "reason_counts": f"WITH x AS (SELECT DISTINCT log_id, message_score, list_sort(list_distinct(message_reasons)) AS r FROM commit_log) SELECT reason, count(*) AS n, round(avg({nosc.format(c='message_score')}), 6) AS mean_score FROM (SELECT unnest(r) AS reason, message_score FROM x) GROUP BY 1",
        "known_exclusions": f"""WITH f AS (SELECT lower(trim(sha)) AS sha, {repo('repo')} AS repo FROM {FEW}), c AS (SELECT lower(trim(sha)) AS sha, {repo('repo')} AS repo FROM {CAND})
 SELECT CASE WHEN sha IN (SELECT sha FROM f WHERE sha IS NOT NULL) THEN 'known_sha' WHEN repo IN (SELECT repo FROM f WHERE repo IS NOT NULL) THEN 'known_repo' ELSE 'kept' END AS reason, count(*) AS n FROM c GROUP BY 1""",
        "status_matrix": f"SELECT coalesce(nullif(trim(quality_status), ''), 'UNKNOWN') AS quality, coalesce(nullif(trim(message_status), ''), 'UNKNOWN') AS message, count(*) AS n FROM {FEW} GROUP BY ALL",
        "split_divergence": f"""WITH d AS (SELECT split g, source_kind v FROM {SAMPLES} WHERE split IS NOT NULL AND source_kind IS NOT NULL), k AS (SELECT g, v, count(*) AS c FROM d GROUP BY g, v), p AS (SELECT g, v, c / sum(c) OVER (PARTITION BY g) AS p FROM k), f AS (SELECT a.g, b.v, coalesce(p.p, 0) p FROM (SELECT DISTINCT g FROM p) a CROSS JOIN (SELECT DISTINCT v FROM p) b LEFT JOIN p ON p.g = a.g AND p.v = b.v)
 SELECT x.g AS a, y.g AS b, round(sum(abs(x.p - y.p)) / 2, 6) AS distance FROM f x JOIN f y ON x.v = y.v AND x.g < y.g GROUP BY ALL""",
        "coverage_curve": f"WITH c AS (SELECT split, gold_count AS k, count(*) n FROM {SAMPLES} WHERE split IS NOT NULL AND gold_count IS NOT NULL GROUP BY ALL) SELECT split, k, n, round(sum(n) OVER (PARTITION BY split ORDER BY k) / sum(n) OVER (PARTITION BY split), 6) AS coverage FROM c",
        "yield_table": f"SELECT type, language, count(*) AS n FROM (SELECT coalesce(type, 'unknown') AS type, coalesce(language, 'unknown') AS language FROM {POOL}) GROUP BY CUBE (type, language)",
        "label_shortfall": f"""WITH x AS (SELECT type, language FROM {POOL} WHERE type IS NOT NULL AND language IS NOT NULL), n AS (SELECT type, language, count(*) n FROM x GROUP BY ALL)
 SELECT a.type, b.language, coalesce(n, 0) AS n, greatest(0, 20 - coalesce(n, 0)) AS short FROM (SELECT DISTINCT type FROM x) a CROSS JOIN (SELECT DISTINCT language FROM x) b LEFT JOIN n ON n.type = a.type AND n.language = b.language""",
        "hunk_overlaps": f"""WITH h AS (SELECT sample_id, file_path, unit_id, regexp_extract(patch_text, '@@ -([0-9]+)(?:,([0-9]+))? \\+([0-9]+)(?:,([0-9]+))? @@', ['a', 'b', 'c', 'd']) AS r FROM {UNITS}), u AS (SELECT sample_id, file_path, unit_id, nullif(r.a, '')::BIGINT AS s, coalesce(nullif(r.b, '')::BIGINT, 1) AS n FROM h WHERE r.a <> '')
 SELECT x.sample_id, x.file_path, x.unit_id AS a, y.unit_id AS b FROM u x JOIN u y ON x.sample_id = y.sample_id AND x.file_path = y.file_path AND x.unit_id < y.unit_id AND x.s <= y.s + greatest(y.n, 1) - 1 + 3 AND y.s <= x.s + greatest(x.n, 1) - 1 + 3""",
        "delivery_chain": f"""WITH RECURSIVE x AS (SELECT {repo('repo')} AS repo, log_id, lower(sha) AS sha FROM {LOG}), r AS (SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY log_id) AS i FROM x WHERE repo IS NOT NULL AND sha IS NOT NULL),
 c AS (SELECT repo, i, sha256('|' || sha) AS link FROM r WHERE i = 1 UNION ALL SELECT r.repo, r.i, sha256(c.link || '|' || r.sha) FROM c JOIN r ON r.repo = c.repo AND r.i = c.i + 1)
 SELECT repo, count(*) AS links, min(link) AS least, max(link) AS greatest FROM c GROUP BY repo""",
        "integrity_counters": f"""WITH u AS (SELECT DISTINCT sample_id, unit_id, gold_intent_id IS NULL AS no FROM {UNITS}), s AS (SELECT DISTINCT sample_id FROM attribution_samples), g AS (SELECT DISTINCT sample_id, unnest(map_keys(gold_unit_to_intent)) AS unit_id FROM attribution_samples)
 SELECT 'units_without_sample' AS counter, count(*) AS n FROM u ANTI JOIN s USING (sample_id) UNION ALL SELECT 'samples_without_unit', count(*) FROM s ANTI JOIN u USING (sample_id)
 UNION ALL SELECT 'gold_without_unit', count(*) FROM g ANTI JOIN u USING (sample_id, unit_id) UNION ALL SELECT 'units_outside_gold', count(*) FROM u ANTI JOIN g USING (sample_id, unit_id) UNION ALL SELECT 'units_without_intent', count(*) FROM u WHERE no""",
        "document_slices": "WITH d AS (SELECT coalesce(n_chars, 0) n, text, lang FROM documents) " + " UNION ALL ".join(
            f"SELECT '{k}' AS slice, count(*) AS docs, round(avg(n), 6) AS mean_chars FROM d WHERE {c} HAVING count(*) > 0"
            for k, c in (("short", "n < 300"), ("long", "n > 3000"), ("code", "contains(text, '```')"), ("list", "contains(text, chr(10) || '- ')"), ("labelled_en", "lang = 'en'"), ("all", "true"))),
        "neighbour_pairs": f"""WITH x AS (SELECT {repo('repo')} AS repo, row_id, type, list_distinct(regexp_extract_all(git_diff, 'diff --git a/(\\S+) b/', 1)) AS files FROM {POOL} WHERE git_diff IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY sha256('11|' || row_id), row_id) AS i FROM x WHERE repo IS NOT NULL)
 SELECT p.repo, least(p.row_id, q.row_id) AS a, greatest(p.row_id, q.row_id) AS b, (len(p.files) + len(q.files))::BIGINT AS files FROM r p JOIN r q ON p.repo = q.repo AND q.i - p.i BETWEEN 1 AND 3 WHERE p.type <> q.type AND NOT list_has_any(p.files, q.files)""",
        "example_cascade": f"""WITH f AS (SELECT example_id, {repo('repo')} AS repo, {nosc.format(c='quality_score')} AS score, type_pair, type_signature_raw AS raw, {split('split')} AS split, concat_ws('|', type_pair, type_signature_raw) AS exact FROM {FEW}),
 h AS (SELECT q.example_id AS query_id, p.example_id, p.score, CASE WHEN q.exact = p.exact THEN 0 WHEN q.type_pair = p.type_pair THEN 1 ELSE 2 END AS level FROM f q JOIN f p ON p.split = 'train' AND q.split IN ('dev', 'test') AND q.repo IS DISTINCT FROM p.repo AND (q.exact = p.exact OR q.type_pair = p.type_pair OR q.raw = p.raw))
 SELECT * FROM (SELECT query_id, example_id, level, row_number() OVER (PARTITION BY query_id ORDER BY level, score DESC NULLS LAST, example_id) AS rank FROM h) WHERE rank <= 3""",
        "file_list_check": f"""WITH x AS (SELECT changed_files AS c, file_count FROM {POOL}), y AS (SELECT *, CASE WHEN c IS NULL THEN 'null' WHEN regexp_matches(c, '^\\s*\\[') THEN 'json' WHEN contains(c, '|') THEN 'bar' WHEN contains(c, chr(10)) THEN 'lines' WHEN contains(c, ',') THEN 'comma' ELSE 'one' END AS form FROM x),
 z AS (SELECT *, CASE WHEN form = 'json' THEN json_array_length(c) ELSE len(regexp_split_to_array(c, '\\s*[|\\n,]\\s*')) END AS k FROM y) SELECT form, count(*) AS n, sum((k = file_count)::INT)::BIGINT AS agree, max(k)::BIGINT AS most FROM z GROUP BY form""",
        "repo_caps": f"SELECT * FROM (SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY score DESC NULLS LAST, sha) AS rank FROM (SELECT {repo('repo')} AS repo, sha, {nosc.format(c='score')} AS score FROM {CAND}) WHERE repo IS NOT NULL) WHERE rank <= 3",
        "provenance_filter": f"WITH x AS (SELECT sample_id, max(CASE provenance_status WHEN 'exact' THEN 0 WHEN 'fuzzy' THEN 1 ELSE 2 END) AS w, count(*) AS u FROM {UNITS} WHERE sample_id IS NOT NULL GROUP BY 1) SELECT ['exact', 'fuzzy', 'other'][w + 1] AS worst, count(*) AS samples, sum(u)::BIGINT AS units FROM x GROUP BY 1",
        "breaking_changes": f"""WITH {MSG.format(key='row_id, type', c='subject', src=POOL)} SELECT CASE WHEN lower(type) IN ('feat', 'fix') THEN 0 WHEN lower(type) IN ('refactor', 'perf') THEN 1 ELSE 2 END AS priority, count(*) AS n, sum({BREAKING}::INT)::BIGINT AS breaking, sum({MULTI}::INT)::BIGINT AS multi FROM s GROUP BY 1""",
        "edit_unit_records": f"""WITH p AS (SELECT row_id, string_split(chr(10) || git_diff, chr(10) || 'diff --git ')[2:] AS ps FROM {POOL} WHERE git_diff IS NOT NULL), f AS (SELECT row_id, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS file_no FROM p),
 h AS (SELECT row_id, file_no, regexp_extract(part, '^a/(\\S+) b/', 1) AS file_path, string_split(part, chr(10) || '@@ ')[2:] AS hs FROM f), u AS (SELECT row_id, file_no, file_path, string_split(unnest(hs), chr(10))[2:] AS ls, generate_subscripts(hs, 1) - 1 AS hunk_no FROM h)
 SELECT row_id, file_no, file_path, hunk_no, len(list_filter(ls, lambda x: starts_with(x, '+')))::BIGINT AS added, len(list_filter(ls, lambda x: starts_with(x, '-')))::BIGINT AS deleted FROM u""",
        "exclusion_reasons": f"""WITH x AS (SELECT lower(coalesce(subject, '')) AS s, lower(type) AS t, changed_files AS c, string_split(chr(10) || coalesce(git_diff, ''), chr(10) || 'diff --git ')[2:] AS ps FROM {POOL}),
 y AS (SELECT *, coalesce(list_sum(list_transform(ps, lambda q: len(list_filter(string_split(q, chr(10)), lambda x: (starts_with(x, '+') AND NOT starts_with(x, '+++')) OR (starts_with(x, '-') AND NOT starts_with(x, '---')))))), 0) AS ch FROM x)
 SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN starts_with(s, 'merge') THEN 'merge' END, CASE WHEN starts_with(s, 'revert') THEN 'revert' END, CASE WHEN regexp_matches(s, '^(release|bump|chore\\(release)') THEN 'release' END, CASE WHEN t = 'style' THEN 'style' END,
  CASE WHEN len(ps) = 0 THEN 'no_diff' END, CASE WHEN ch < 3 THEN 'tiny' END, CASE WHEN len(ps) > 4 THEN 'wide' END, CASE WHEN regexp_matches(c, '\\.lock|go\\.sum|package-lock') THEN 'lock_file' END]) AS reason FROM y) WHERE reason IS NOT NULL GROUP BY 1""",
        "deliverable": f"""SELECT CASE WHEN verified_multi_intent <> 1 THEN 'not_verified' WHEN fewshot_eligible <> 1 THEN 'not_eligible' WHEN quality_score IS NULL OR isnan(quality_score) THEN 'no_score' WHEN quality_score < 0.5 THEN 'low_score' WHEN {repo('repo')} IS NULL THEN 'no_repo' ELSE 'ready' END AS reason, intent_k, count(*) AS n FROM {FEW} GROUP BY ALL""",
        "diff_duplicates": f"""WITH g AS (SELECT sha256(array_to_string(list_filter(string_split(git_diff, chr(10)), lambda x: NOT (starts_with(x, 'index ') OR starts_with(x, '@@ '))), chr(10))) AS h, count(*) AS copies FROM {POOL} WHERE git_diff <> '' GROUP BY 1) SELECT copies, count(*) AS groups FROM g GROUP BY 1""",
        "disjoint_flags": f"""WITH p AS (SELECT lower(trim(sha)) AS sha, {repo('repo')} AS repo FROM {POOL}), c AS (SELECT lower(trim(sha)) AS sha, {repo('repo')} AS repo FROM {CAND})
 SELECT coalesce(sha IN (SELECT sha FROM p WHERE sha IS NOT NULL), false) AS sha_known, coalesce(repo IN (SELECT repo FROM p WHERE repo IS NOT NULL), false) AS repo_known, count(*) AS n FROM c GROUP BY ALL""",
        "seed_stability": overlap(" UNION ALL ".join(f"SELECT '{z}' AS g, row_id AS k FROM (SELECT row_id, row_number() OVER (PARTITION BY coalesce(language, 'unknown') ORDER BY sha256('{z}|' || row_id), row_id) AS r FROM {POOL}) WHERE r <= 20" for z in "123")),
        "background_rates": f"SELECT {ROLE} AS role, count(*) AS units, sum((g IS NULL)::INT)::BIGINT AS background, round(avg((g IS NULL)::INT), 6) AS rate FROM (SELECT lower(replace(file_path, '\\', '/')) AS p, gold_intent_id AS g FROM (SELECT DISTINCT unit_id, file_path, gold_intent_id, context_clipped FROM edit_units) WHERE NOT coalesce(context_clipped, false)) GROUP BY 1",
        "sample_rates": f"SELECT source_kind, count(is_multi_intent) AS n_multi, round(avg(is_multi_intent::INT), 6) AS multi_rate, count(gold_count) AS n_gold, round(avg((gold_count = k)::INT), 6) AS k_agrees, round(avg({nosc.format(c='sample_weight')}), 6) AS mean_weight FROM {SAMPLES} GROUP BY 1",
        "intent_types": "WITH x AS (SELECT DISTINCT sample_id, list_sort(list_distinct(intent_types)) AS t FROM attribution_samples) SELECT type, count(*) AS samples, round(avg(k), 6) AS mean_types FROM (SELECT unnest(t) AS type, len(t) AS k FROM x) GROUP BY 1",
        "type_signatures": f"""SELECT array_to_string(list_filter(list_sort(list_distinct(list_transform(regexp_split_to_array(lower(type_signature_raw), '[+|,/& ]+'), lambda v: regexp_replace(v, '\\(.*\\)|!', '', 'g')))), lambda v: v <> ''), '+') AS signature, count(*) AS n FROM {FEW} WHERE type_signature_raw IS NOT NULL GROUP BY 1""",
        "masked_subjects": f"""SELECT regexp_replace(regexp_replace(regexp_replace(subject, '[A-Za-z0-9]+(_[A-Za-z0-9]+)+', 'ID', 'g'), '[0-9]+', 'N', 'g'), '[A-Za-z]+(/[A-Za-z]+)+', 'PATH', 'g') AS mask, count(*) AS n FROM {LOG} WHERE subject IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
        "shard_plan": f"SELECT (i - 1) // 100 AS shard, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS i FROM {POOL}) GROUP BY 1",
        "commit_dates": f"""WITH f AS (SELECT trim(commit_date) AS c FROM {LOG}), g AS (SELECT c, CASE WHEN c IS NULL THEN 'null' WHEN c = '' THEN 'blank' WHEN regexp_matches(c, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T') THEN 'iso' WHEN regexp_matches(c, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'day_first_iso' WHEN regexp_matches(c, '^[0-9]{{9,}}$') THEN 'epoch' WHEN regexp_matches(c, '^[A-Z][a-z]{{2}},? ') THEN 'named' ELSE 'other' END AS form FROM f)
 SELECT form, CASE WHEN form = 'iso' THEN substr(c, 1, 4) END AS year, count(*) AS n FROM g GROUP BY ALL""",
        "difficulty_levels": f"""WITH u AS (SELECT sample_id, count(DISTINCT file_path) f, count(DISTINCT CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE '.' END) m, count(DISTINCT gold_intent_id) i FROM (SELECT *, regexp_replace(replace(file_path, '\\', '/'), '^(\\./|/)+', '') AS p FROM {UNITS} WHERE sample_id IS NOT NULL AND file_path IS NOT NULL) GROUP BY 1)
 SELECT substr('ABCD', 1 + (i > 1)::INT + (f > 2)::INT + (m > 2)::INT, 1) AS level, count(*) AS samples, round(avg(f), 6) AS mean_files FROM u GROUP BY 1""",
        "message_polarity": f"""WITH x AS (SELECT lower(regexp_extract(regexp_replace(subject, '^[a-z]+(\\([^)]*\\))?!?: |^\\[[^]]*\\] |^[a-z]+/[a-z]+: ', ''), '^([A-Za-z]+)', 1)) AS w, score FROM {CAND} WHERE subject IS NOT NULL)
 SELECT CASE WHEN w IN ('add', 'create', 'introduce', 'enable', 'load', 'mount') THEN 'adds' WHEN w IN ('remove', 'delete', 'drop', 'stop', 'disable', 'drain', 'expire', 'flush') THEN 'removes' WHEN w IN ('use', 'let', 'move', 'merge', 'split', 'compact', 'prune', 'seal') THEN 'changes' ELSE 'none' END AS polarity, count(*) AS n, round(avg({nosc.format(c='score')}), 6) AS mean_score FROM x GROUP BY 1""",
        "pair_precheck": f"""WITH x AS (SELECT {repo('repo')} AS repo, row_id, type, list_distinct(regexp_extract_all(git_diff, 'diff --git a/(\\S+) b/', 1)) AS files, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(subject, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) AS ws FROM {POOL} WHERE git_diff IS NOT NULL),
 y AS (SELECT *, list_distinct(list_transform(files, lambda f: CASE WHEN contains(f, '/') THEN split_part(f, '/', 1) ELSE '.' END)) AS ms, row_number() OVER (PARTITION BY repo ORDER BY sha256('19|' || row_id), row_id) AS i FROM x WHERE repo IS NOT NULL),
 z AS (SELECT p.row_id AS pa, q.row_id AS pb, p.type AS ta, q.type AS tb, list_has_any(p.files, q.files) AS meet, len(list_intersect(p.ws, q.ws)) AS wi, len(p.ws) + len(q.ws) AS wn, len(list_intersect(p.ms, q.ms)) AS mi, len(p.ms) + len(q.ms) AS mn, len(p.files) AS na, len(q.files) AS nb FROM y p JOIN y q ON p.repo = q.repo AND q.i - p.i BETWEEN 1 AND 2),
 v AS (SELECT *, CASE WHEN wn - wi > 0 THEN wi / (wn - wi) ELSE 1 END AS w, CASE WHEN mn - mi > 0 THEN mi / (mn - mi) ELSE 1 END AS m, CASE WHEN greatest(na, nb) > 0 THEN least(na, nb) / greatest(na, nb) ELSE 0 END AS bal FROM z),
 c AS (SELECT *, CASE WHEN meet THEN 'shared_file' WHEN ta IS NOT DISTINCT FROM tb THEN 'same_type' WHEN w >= 0.8 THEN 'same_words' ELSE 'none' END AS first_conflict FROM v)
 SELECT least(pa, pb) AS a, greatest(pa, pb) AS b, first_conflict, round(CASE WHEN first_conflict <> 'none' OR (1 - w) * (1 - 0.5 * m) * bal <= 0 THEN 0 ELSE pow((1 - w) * (1 - 0.5 * m) * bal, 1.0 / 3) END, 6) AS weight FROM c""",
        "gate_report": f"""WITH a AS (SELECT avg((verified_multi_intent = 1)::INT) v, avg((fewshot_eligible = 1)::INT) e, avg({nosc.format(c='quality_score')}) m, avg(({repo('repo')} IS NULL)::INT) r, avg((quality_score IS NULL)::INT) s FROM {FEW})
 SELECT 'verified' AS gate, round(v, 6) AS observed, 0.5::DOUBLE AS threshold, v >= 0.5 AS passes FROM a UNION ALL SELECT 'eligible', round(e, 6), 0.5, e >= 0.5 FROM a UNION ALL SELECT 'mean_score', round(m, 6), 0.4, m >= 0.4 FROM a UNION ALL SELECT 'no_repo', round(r, 6), 0.05, r <= 0.05 FROM a UNION ALL SELECT 'no_score', round(s, 6), 0.05, s <= 0.05 FROM a""",
        "stream_first_deliveries": "SELECT sha, any_value(subject) AS subject FROM candidates WHERE sha IS NOT NULL GROUP BY sha",
        "tfidf_neighbours": f"""WITH f AS (SELECT example_id AS id, {repo('repo')} AS repo, {split('split')} AS split, list_filter(regexp_split_to_array(lower(subject), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '') AS ws FROM {FEW}),
 b AS (SELECT id, repo, split, w, count(*)::DOUBLE AS tf FROM (SELECT id, repo, split, unnest(ws) AS w FROM f) GROUP BY ALL), n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM f WHERE split = 'train'), d AS (SELECT w, count(*)::DOUBLE AS df FROM b WHERE split = 'train' GROUP BY w),
 p AS (SELECT id, repo, w, tf * ln((2 + n) / (1 + df)) + 1 AS alone, tf * ln((2 + n) / (2 + df)) + 1 AS v FROM b JOIN d USING (w), n WHERE split = 'train'), q AS (SELECT id, repo, w, tf * ln((2 + n) / (2 + coalesce(df, 0))) + 1 AS v FROM b LEFT JOIN d USING (w), n WHERE split IN ('dev', 'test')),
 pn AS (SELECT id, sum(alone * alone) AS s FROM p GROUP BY id), qn AS (SELECT id, sum(v * v) AS s FROM q GROUP BY id), x AS (SELECT q.id AS query_id, p.id AS example_id, sum(q.v * p.v) AS dot, sum(p.v * p.v - p.alone * p.alone) AS more FROM q JOIN p ON q.w = p.w AND q.repo IS DISTINCT FROM p.repo GROUP BY q.id, p.id),
 s AS (SELECT query_id, example_id, round(dot / sqrt(qn.s * (pn.s + more)), 6) AS cosine FROM x JOIN qn ON qn.id = query_id JOIN pn ON pn.id = example_id)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, example_id) AS rank FROM s) WHERE rank <= 3""",
        "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2",
    }
