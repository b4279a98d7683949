from pyspark.sql import functions as F

from wavelark.operators import integrity, scan_validation, splits
from wavelark.plans.catalog import query, rounded
from wavelark.plans.oracle_views import DESKTOP
from wavelark.plans.views import desktop_rows
from wavelark.session import stored
from wavelark.sources.sessions import session_rollup

ROLLUP_SQL = """
roll AS (SELECT session_id, min(environment) AS environment, count(*) AS "rows", count(DISTINCT scan_index) AS scan_count,
    count(DISTINCT scan_index) >= 3 AND count(bssid_hash) / count(*) >= 0.99 AND count(*) FILTER (ssid_hash IS NOT NULL AND bssid_hash IS NOT NULL) / count(*) >= 0.7 AS runtime_ready
    FROM {rows} GROUP BY 1)"""


@query("session_rollup", f"WITH {DESKTOP}, {ROLLUP_SQL.format(rows='desk')} SELECT * FROM roll")
def rollup(spark, sf_dir):
    return session_rollup(desktop_rows(spark, sf_dir))


# Sessions with faults: lost BSSIDs, a wrong label, two places, a short session and a renamed copy.
FAULTY = DESKTOP + """,
faulty0 AS (SELECT session_id, CASE WHEN session_id = 'sess_04' AND channel_ > 9 THEN 'lab' ELSE environment END AS environment,
    CASE WHEN session_id <> 'sess_05' THEN captured_at_utc END AS captured_at_utc, scan_index, ssid_hash, CASE WHEN session_id = 'sess_02' AND scan_index = 0 THEN NULL ELSE bssid_hash END AS bssid_hash,
    security_type, security_strength, source_dataset, CASE WHEN session_id = 'sess_01' AND scan_index = 1 THEN 1 ELSE 0 END AS label,
    attack_type, is_synthetic FROM (SELECT *, (center_frequency_khz // 1000 - 2407) // 5 AS channel_ FROM desk)
    WHERE session_id <> 'sess_03' OR scan_index < 2),
faulty AS (SELECT * FROM faulty0 UNION ALL SELECT * REPLACE ('sess_90' AS session_id) FROM faulty0 WHERE session_id = 'sess_00'),
fman AS (SELECT session_id, count(DISTINCT scan_index) AS scan_count, count(*) AS n FROM faulty GROUP BY 1)
"""
FAULTY_COLUMNS = ["session_id", "environment", "captured_at_utc", "scan_index", "ssid_hash", "bssid_hash", "security_type",
                  "security_strength", "source_dataset", "label", "attack_type", "is_synthetic"]


def faulty(spark, sf_dir):
    session, scan = F.col("session_id"), F.col("scan_index")
    rows = desktop_rows(spark, sf_dir).where((session != "sess_03") | (scan < 2)).withColumns({
        "environment": F.when((session == "sess_04") & (F.col("center_frequency_khz") > 2_452_000), "lab").otherwise(F.col("environment")),
        "captured_at_utc": F.when(session != "sess_05", F.col("captured_at_utc")),
        "bssid_hash": F.when((session != "sess_02") | (scan != 0), F.col("bssid_hash")),
        "label": F.when((session == "sess_01") & (scan == 1), 1).otherwise(0).cast("long"),
    }).select(*FAULTY_COLUMNS)
    return rows.unionByName(rows.where(session == "sess_00").withColumn("session_id", F.lit("sess_90")))


def manifests(rows):
    return session_rollup(rows).select("session_id", "scan_count", "rows", F.lit(True).alias("runtime_ready"))


def lanes(columns, rows, by="session_id", name="content_fingerprint"):
    """The additive digest in SQL."""
    text = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in sorted(columns))
    sums = " || '|' || ".join(f"sum(CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT))" for i in range(12))
    key = f"{by}, " if by else ""
    return (f"SELECT {key}sha256(count(*) || '|' || {sums}) AS {name} "
            f"FROM (SELECT {key}sha256({text}) AS h FROM {rows}){' GROUP BY 1' if by else ''}")


PRINTED = ["scan_index", "ssid_hash", "bssid_hash", "security_type", "security_strength", "label"]
FINGERPRINT = f"WITH {FAULTY}, fp AS ({lanes(PRINTED, 'faulty')})"


def fingerprints(spark, sf_dir):
    return integrity.fingerprint(faulty(spark, sf_dir).select("session_id", "environment", *PRINTED))


@query("content_fingerprint", f"{FINGERPRINT} SELECT * FROM fp")
def content_fingerprint(spark, sf_dir):
    return fingerprints(spark, sf_dir)


@query("duplicate_content", f"""{FINGERPRINT} SELECT *, count(*) OVER (PARTITION BY content_fingerprint) AS copies FROM fp
QUALIFY count(*) OVER (PARTITION BY content_fingerprint) > 1""")
def duplicate_content(spark, sf_dir):
    return integrity.duplicate_groups(fingerprints(spark, sf_dir))


PREFLIGHT = f"""WITH {FAULTY},
s AS (SELECT session_id, CASE WHEN count(DISTINCT environment) = 1 THEN min(environment) END AS environment, count(*) AS "rows",
    count(bssid_hash) / count(*) AS cov, count(*) FILTER (ssid_hash IS NOT NULL AND bssid_hash IS NOT NULL) / count(*) AS comp,
    count(DISTINCT environment) AS envs, max(label) AS lab, CASE WHEN count(captured_at_utc) = 0 THEN 'captured_at_utc_unavailable' ELSE '' END AS warnings
    FROM faulty GROUP BY 1),
pre AS (SELECT s.session_id, s.environment, "rows", scan_count, round(cov, 9) AS bssid_hash_coverage, round(comp, 9) AS desktop_candidate_completeness,
    concat_ws(',', CASE WHEN cov < 0.99 THEN 'bssid_hash_coverage_below_099' END,
        CASE WHEN comp < 0.7 THEN 'desktop_candidate_completeness_below_070' END,
        CASE WHEN s.session_id IN ('sess_00', 'sess_90') THEN 'duplicate_session_content' END,
        CASE WHEN envs > 1 THEN 'multiple_environments_in_session' END, CASE WHEN lab <> 0 THEN 'row_label_not_zero' END,
        CASE WHEN scan_count < 3 THEN 'scan_count_below_runtime_minimum' END) AS blockers, warnings FROM s JOIN fman USING (session_id))"""


@query("session_preflight", f"{PREFLIGHT} SELECT *, blockers = '' AS valid FROM pre")
def session_preflight(spark, sf_dir):
    rows = faulty(spark, sf_dir)
    out = integrity.preflight(rows, manifests(rows)).drop("time_start_utc", "time_end_utc")
    return rounded(out.withColumns({c: F.array_join(c, ",") for c in ("blockers", "warnings")}),
                   "bssid_hash_coverage", "desktop_candidate_completeness")


PARTS_SQL = """parts AS (SELECT session_id || '/' || coalesce(ssid_hash, '-') AS id, min(captured_at_utc) AS a, max(captured_at_utc) AS b FROM desk GROUP BY 1)"""


def parts(spark, sf_dir):
    """Each network of a session as a session of its own, so that ranges overlap."""
    return desktop_rows(spark, sf_dir).groupBy(F.concat_ws("/", "session_id", F.coalesce("ssid_hash", F.lit("-"))).alias("session_id")).agg(
        F.min("captured_at_utc").alias("time_start_utc"), F.max("captured_at_utc").alias("time_end_utc"))


@query("session_overlaps", f"""WITH {DESKTOP}, {PARTS_SQL}
SELECT x.id AS session_id, count(y.id) AS overlapping_sessions FROM parts x LEFT JOIN parts y ON x.id <> y.id AND x.a <= y.b AND y.a <= x.b GROUP BY 1""")
def session_overlaps(spark, sf_dir):
    return integrity.overlap_counts(parts(spark, sf_dir))


@query("session_overlap_partners", f"""WITH {DESKTOP}, {PARTS_SQL}
SELECT y.id AS session_id FROM parts x JOIN parts y ON x.id <> y.id AND x.a <= y.b AND y.a <= x.b WHERE x.id = 'sess_03/-'""")
def session_overlap_partners(spark, sf_dir):
    return integrity.overlaps_of(parts(spark, sf_dir), "sess_03/-")


PLAN_SQL = """
plan AS (SELECT session_id, CASE WHEN pos_ = 0 THEN 'reference' WHEN pos_ IN (1, 2) THEN 'model_train' WHEN pos_ = 3 THEN 'validation'
    WHEN pos_ = 4 THEN 'test_normal' WHEN (pos_ - 5) % 4 < 2 THEN 'model_train' WHEN (pos_ - 5) % 4 = 2 THEN 'validation' ELSE 'test_normal' END AS split
    FROM (SELECT session_id, row_number() OVER (ORDER BY sha256('20260831|' || session_id)) - 1 AS pos_ FROM roll WHERE runtime_ready))"""
DRY_RUN = f"""WITH {DESKTOP}, {ROLLUP_SQL.format(rows='desk')}, {PLAN_SQL},
pr AS (SELECT d.*, split FROM desk d JOIN plan USING (session_id)),
rf AS (SELECT * FROM pr WHERE split = 'reference' AND ssid_hash IS NOT NULL),
mb AS (SELECT DISTINCT ssid_hash, bssid_hash FROM rf),
ow AS (SELECT bssid_hash FROM mb GROUP BY 1 HAVING count(*) = 1),
cv AS (SELECT split, count(*) AS "rows", count(*) FILTER (ssid_hash IN (SELECT ssid_hash FROM mb) OR bssid_hash IN (SELECT bssid_hash FROM ow)) AS eligible
    FROM pr WHERE split <> 'reference' GROUP BY 1)"""


def plan_rows(spark, sf_dir):
    rows = desktop_rows(spark, sf_dir)
    return rows, session_rollup(rows)


@query("reference_dry_run", f"""{DRY_RUN} SELECT *, "rows" - eligible AS context_unavailable, round(eligible / "rows", 9) AS eligible_rate,
    eligible / "rows" < 0.7 AS below_minimum FROM cv""")
def reference_dry_run(spark, sf_dir):
    return rounded(integrity.coverage_dry_run(*plan_rows(spark, sf_dir)), "eligible_rate")


# The whole capture, and the capture with faults: copies, lost identifiers, a second place.
@query("preflight_status", f"""{DRY_RUN}, {PREFLIGHT.removeprefix(f"WITH {DESKTOP},")}, g AS (SELECT count(*) AS sessions, count(*) FILTER (runtime_ready) AS valid_sessions FROM roll),
lowc AS (SELECT count(*) FILTER (eligible / "rows" < 0.7) AS l FROM cv),
fg AS (SELECT count(*) AS sessions, count(*) FILTER (blockers = '') AS valid, count(*) FILTER (contains(blockers, 'duplicate')) AS copies FROM pre),
fb AS (SELECT list(DISTINCT b) AS found FROM (SELECT unnest(string_split(blockers, ',')) AS b FROM pre WHERE blockers <> '')),
fe AS (SELECT count(DISTINCT environment) > 1 AS mixed, CASE WHEN count(DISTINCT environment) = 1 THEN min(environment) END AS environment FROM pre WHERE blockers = '')
SELECT 'whole' AS capture, sessions, valid_sessions, sessions - valid_sessions AS invalid_sessions, 0 AS duplicate_sessions, false AS mixed_environments, 'home' AS environment,
    CASE WHEN sessions > valid_sessions THEN 'blocked_invalid_sessions' WHEN valid_sessions < 5 THEN 'blocked_insufficient_valid_sessions'
    WHEN l > 0 THEN 'blocked_candidate_reference_coverage' ELSE 'ready_for_split_freeze' END AS status,
    CASE WHEN l > 0 AND valid_sessions >= 5 THEN 'candidate_reference_eligible_rate_below_070' ELSE '' END AS blockers, '' AS warnings FROM g, lowc
UNION ALL SELECT 'faulty', sessions, valid, sessions - valid, copies, mixed, environment, CASE WHEN copies > 0 THEN 'blocked_duplicate_session_content'
    WHEN sessions > valid THEN 'blocked_invalid_sessions' ELSE 'other' END,
    array_to_string(list_sort(list_concat(found, CASE WHEN valid >= 5 AND NOT mixed AND l > 0 THEN ['candidate_reference_eligible_rate_below_070'] ELSE [] END)), ','), ''
    FROM fg, fb, fe, lowc""")
def preflight_status(spark, sf_dir):
    rows, sessions = plan_rows(spark, sf_dir)
    broken = stored(faulty(spark, sf_dir), "faulty")
    covered = stored(integrity.coverage_dry_run(rows, sessions), "covered")
    found = {"whole": integrity.preflight_status(integrity.preflight(rows, sessions), covered),
             "faulty": integrity.preflight_status(integrity.preflight(broken, manifests(broken)), covered)}
    both = [df.select(F.lit(name).alias("capture"), "*").withColumns({c: F.array_join(c, ",") for c in ("blockers", "warnings")}) for name, df in found.items()]
    return both[0].unionByName(both[1])


# Frozen: the clean sessions up to sess_07 with their plan; current: the faulty ones without sess_06.
DRIFT = f"""WITH {FAULTY}, {ROLLUP_SQL.format(rows='desk')}, {PLAN_SQL},
clean AS (SELECT session_id, scan_index, ssid_hash, bssid_hash, security_type, security_strength, label FROM desk WHERE session_id <= 'sess_07'),
ff AS ({lanes(PRINTED, 'clean', name='frozen_fingerprint')}),
fz AS (SELECT session_id, split, frozen_fingerprint FROM ff LEFT JOIN plan USING (session_id)),
cu AS ({lanes(PRINTED, "faulty WHERE session_id <> 'sess_06'")})"""


def frozen(spark, sf_dir):
    rows, sessions = plan_rows(spark, sf_dir)
    plan = splits.session_split_plan(sessions).select("session_id", "split")
    prints = integrity.fingerprint(rows.where(F.col("session_id") <= "sess_07").select("session_id", *PRINTED))
    return prints.join(plan, "session_id", "left")


@query("frozen_drift", f"""{DRIFT} SELECT session_id, split, frozen_fingerprint, content_fingerprint, CASE WHEN frozen_fingerprint IS NULL THEN 'unassigned'
    WHEN content_fingerprint IS NULL THEN 'missing' WHEN content_fingerprint <> frozen_fingerprint THEN 'mutated' ELSE 'unchanged' END AS state
FROM fz FULL JOIN cu USING (session_id)""")
def frozen_drift(spark, sf_dir):
    current = integrity.fingerprint(
        faulty(spark, sf_dir).where(F.col("session_id") != "sess_06").select("session_id", "environment", *PRINTED))
    return integrity.frozen_drift(current, frozen(spark, sf_dir))


@query("assignment_digest", f"""{DRIFT}, az AS (SELECT session_id, split, frozen_fingerprint AS content_fingerprint FROM fz)
{lanes(['session_id', 'split', 'content_fingerprint'], 'az', by='', name='split_digest')}""")
def assignment_digest(spark, sf_dir):
    return integrity.assignment_digest(frozen(spark, sf_dir))


@query("split_disjointness", f"""WITH {DESKTOP}, {ROLLUP_SQL.format(rows='desk')}, {PLAN_SQL},
c AS (SELECT count(*) FILTER (split = 'reference') AS reference, count(*) FILTER (split = 'model_train') AS model_train,
    count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test_normal') AS test_normal, 0 AS unknown_splits,
    count(*) - count(DISTINCT session_id) AS repeated_sessions FROM plan)
SELECT *, reference = 1 AND model_train >= 2 AND validation >= 1 AND test_normal >= 1 AS valid FROM c""")
def split_disjointness(spark, sf_dir):
    _, sessions = plan_rows(spark, sf_dir)
    return integrity.check_disjoint(splits.session_split_plan(sessions))


COVERAGE_SQL = {
    "ssid_hash": "ssid_hash IS NOT NULL", "bssid_hash": "bssid_hash IS NOT NULL", "security_type": "security_type IS NOT NULL",
    "security_strength": "security_strength IS NOT NULL", "rssi_dbm": "rssi_dbm IS NOT NULL",
    "beacon_interval_positive": "beacon_interval_ms > 0", "tsf_positive": "tsf_us > 0", "host_timestamp_positive": "tsf_us > 500000",
    "center_frequency_positive": "center_frequency_khz > 0", "ie_blob_nonempty": "ie_blob_size > 0",
    "ie_parser_not_truncated": "NOT ie_parser_truncated", "ds_parameter_channel": "ds_parameter_channel IS NOT NULL"}


def scans(spark, sf_dir):
    return desktop_rows(spark, sf_dir).withColumn(
        "host_timestamp_100ns", F.greatest((F.col("tsf_us") - 500_000) * 10, F.lit(0)))


@query("field_coverage", f"WITH {DESKTOP} " + " UNION ALL ".join(
    f"SELECT '{n}' AS field, round(count(*) FILTER ({rule}) / count(*), 9) AS coverage FROM desk" for n, rule in COVERAGE_SQL.items()))
def field_coverage(spark, sf_dir):
    return rounded(scan_validation.coverage(scans(spark, sf_dir)), "coverage")


@query("numeric_summary", f"WITH {DESKTOP} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 3) AS mean FROM desk"
    for c in scan_validation.NUMERIC_FIELDS))
def numeric_summary(spark, sf_dir):
    return rounded(scan_validation.numeric_summary(scans(spark, sf_dir)), "mean", digits=3)


TSF_STEPS = """
l AS (SELECT bssid_hash, tsf_us, lag(tsf_us) OVER (PARTITION BY session_id, bssid_hash ORDER BY scan_index, tsf_us) AS p, session_id FROM desk),
b AS (SELECT session_id || bssid_hash AS i, count(*) AS n, count(p) AS t, count(*) FILTER (tsf_us < p) AS down FROM l GROUP BY 1)"""


@query("tsf_continuity", f"""WITH {DESKTOP}, {TSF_STEPS} SELECT count(*) AS unique_bssids_with_tsf, count(*) FILTER (n >= 2) AS repeated_bssids_with_tsf,
    sum(t)::BIGINT AS transitions, sum(down)::BIGINT AS decreasing_transitions, (sum(t) - sum(down))::BIGINT AS nondecreasing_transitions,
    round((sum(t) - sum(down)) / sum(t), 9) AS nondecreasing_rate FROM b""")
def tsf_continuity(spark, sf_dir):
    rows = scans(spark, sf_dir).withColumn("bssid_hash", F.concat("session_id", "bssid_hash"))
    return rounded(scan_validation.tsf_continuity(rows), "nondecreasing_rate")


@query("scan_readiness", f"""WITH {DESKTOP}, {TSF_STEPS}, r AS (SELECT count(DISTINCT session_id || '-' || scan_index) AS scan_count, count(*) AS observation_count,
    count(DISTINCT session_id || bssid_hash) AS unique_bssids, (SELECT count(*) FROM b WHERE n >= 2) AS repeated_bssids,
    count(ssid_hash) AS candidate_context_identity_rows, count(ssid_hash) AS observable_rows, round(count(ssid_hash) / count(*), 9) AS observable_rate,
    (SELECT (sum(t) - sum(down)) / sum(t) FROM b) AS tr FROM desk)
SELECT * EXCLUDE (tr), round(tr, 9) AS tsf_nondecreasing_rate, observable_rate >= 0.7 AS ready, CASE WHEN tr < 0.9 THEN 'tsf_often_decreases' ELSE '' END AS warnings FROM r""")
def scan_readiness(spark, sf_dir):
    rows = scans(spark, sf_dir).withColumns({
        "bssid_hash": F.concat("session_id", "bssid_hash"),
        "scan_index": F.substring("session_id", 6, 2).cast("long") * 100 + F.col("scan_index")})
    out = scan_validation.readiness(rows)
    return rounded(out.withColumn("warnings", F.array_join("warnings", ",")), "observable_rate", "tsf_nondecreasing_rate")


@query("security_value_counts", f"WITH {DESKTOP} SELECT security_type AS value, count(*) AS count FROM desk GROUP BY 1")
def security_value_counts(spark, sf_dir):
    return scan_validation.value_counts(desktop_rows(spark, sf_dir), "security_type")
