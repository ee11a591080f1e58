"""For every job the SQL that DuckDB runs on the same parquet tables.

Written in plain row-level form: outer joins, distinct counts and window functions stand where the Spark
jobs pre-aggregate, so both sides arrive at a result in different ways.
"""

from __future__ import annotations

from mendgrid.schemas import TABLES, Table
from trial.oracle_binding import AS_OF, BOUND, NOW, duck_type, score, with_tables

SQL: dict[str, str] = {}

CLOSED = "('Remediated', 'False Positive')"
SETTLED = "('Remediated', 'Accepted Risk', 'False Positive')"
DONE = "('Completed', 'Cancelled')"
# A finding's vulnerability through its pair.
SEVERITY_OF = (
    "JOIN software_vulnerabilities sv ON sv.sw_vuln_id = f.sw_vuln_id_fk JOIN vulnerabilities v ON v.vuln_id = sv.vuln_id_fk"
)
OUTER_SEVERITY_OF = (
    "LEFT JOIN software_vulnerabilities sv ON sv.sw_vuln_id = f.sw_vuln_id_fk "
    "LEFT JOIN vulnerabilities v ON v.vuln_id = sv.vuln_id_fk"
)


def say(name: str, body: str, **extra: str) -> None:
    SQL[name] = with_tables(body, **extra)


def out(table: str, columns: list[str] | None = None, prefix: str = "") -> str:
    """Columns of a table with whole numbers as BIGINT and decimals as DOUBLE."""
    parts = []
    for c in columns or TABLES[table].names:
        kind = duck_type(TABLES[table].column(c).sql_type)
        cast = "BIGINT" if kind in ("INT", "SMALLINT") else "DOUBLE" if kind.startswith("DECIMAL") else None
        parts.append(f"CAST({prefix}{c} AS {cast}) {c}" if cast else f"{prefix}{c} {c}")
    return ", ".join(parts)


def ratio(num: str, den: str, places: int) -> str:
    """num / den rounded half away from zero, in whole numbers; NULL for den 0."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    size = f"(abs({n}) * {2 * 10**places} + {d}) // (2 * nullif({d}, 0))"
    return f"CAST(CASE WHEN {n} < 0 THEN -({size}) ELSE {size} END AS DOUBLE) / {10**places}"


def percent(done: str, total: str) -> str:
    return f"coalesce({ratio(f'100 * {done}', total, 1)}, 100.0)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


# Snapshots of a day; a stand-in for the table that has no binding.
def snapshots(day: str = AS_OF, findings: str = "scan_findings") -> str:
    return (
        f"SELECT CAST(a.asset_id * 100000 + ({day} - DATE '1970-01-01') AS BIGINT) snapshot_id, "
        f"a.asset_id asset_id_fk, {day} snapshot_date, "
        f"CAST(coalesce(sum({SCORE}) FILTER (f.finding_id IS NOT NULL), 0) AS DECIMAL(10,2)) composite_score, "
        "CAST(count(f.finding_id) AS INT) open_findings_count, "
        + ", ".join(
            f"CAST(count(*) FILTER (v.severity = '{s}') AS SMALLINT) {s.lower()}_count"
            for s in ("Critical", "High", "Medium", "Low")
        )
        + ", CAST(count(*) FILTER (v.exploit_available) AS SMALLINT) exploit_active_count, "
        f"CAST(count(*) FILTER (f.sla_due_date < {day}) AS SMALLINT) sla_breached_count "
        f"FROM assets a LEFT JOIN (SELECT * FROM {findings} WHERE status NOT IN {SETTLED}) f "
        f"ON f.asset_id_fk = a.asset_id {OUTER_SEVERITY_OF} GROUP BY a.asset_id"
    )


SCORE = f"CAST({score('v.cvss_score', 'v.epss_score', 'a.criticality', 'v.exploit_available')} AS DECIMAL(12,2))"
SNAP = {"risk_score_snapshots": snapshots()}

# --- listings -----------------------------------------------------------------------------------------
PAIR_LABELS = (
    "SELECT sw_vuln_id option_id, product_name || ' — ' || cve_id option_label FROM software_vulnerabilities "
    "JOIN software_products ON software_id = software_id_fk JOIN vulnerabilities ON vuln_id = vuln_id_fk"
)


def options(parent: str, label: str) -> str:
    if not label:
        return PAIR_LABELS
    return f"SELECT {TABLES[parent].pk} option_id, CAST({label} AS VARCHAR) option_label FROM {parent}"


def labeled(spec: Table) -> str:
    shown, joins = [], ""
    refs = {r.column: (i, r) for i, r in enumerate(spec.references)}
    for c in spec.flagged("list"):
        shown.append(out(spec.name, [c], "t."))
        if c in refs:
            i, r = refs[c]
            own = r.label == TABLES[r.parent].pk
            text = f"CAST(t.{c} AS VARCHAR)" if own else f"o{i}.option_label"
            shown.append(f"{text} {c[:-3]}_label")
            if not own:
                joins += f" LEFT JOIN ({options(r.parent, r.label)}) o{i} ON o{i}.option_id = t.{c}"
    return f"SELECT {', '.join(shown)} FROM {spec.name} t{joins}"


for _t, _spec in TABLES.items():
    say(f"a1_source_{_t}", f"SELECT {out(_t)} FROM {_t}", **SNAP)
    _order = ", ".join(f"{c} {d}" for c, d in _spec.order)
    say(f"a2_list_{_t}", f"SELECT {out(_t, _spec.flagged('list'))} FROM {_t} ORDER BY {_order}", **SNAP)
    if _spec.references:
        say(
            f"a3_options_{_t}",
            " UNION ALL ".join(
                f"SELECT '{r.column}' fk_column, option_id, option_label FROM ({options(r.parent, r.label)})"
                for r in _spec.references
            ),
        )
        say(f"a5_labeled_{_t}", labeled(_spec), **SNAP)
say("a4_pair_labels", PAIR_LABELS)
say("a6_lookup_asset", f"SELECT {out('assets')} FROM assets WHERE asset_id = 7")
say("a6_lookup_missing", f"SELECT {out('assets')} FROM assets WHERE asset_id = -1")
say(
    "a6_lookup_findings_of_breached_actions",
    f"SELECT {out('scan_findings')} FROM scan_findings WHERE finding_id IN "
    f"(SELECT finding_id_fk FROM patch_actions WHERE due_date < {AS_OF})",
)
_flags = f"SELECT f.*, v.severity, v.exploit_available FROM scan_findings f {OUTER_SEVERITY_OF}"
say(
    "a7_dashboard_counters",
    "SELECT (SELECT count(*) FROM organizations) orgs, (SELECT count(*) FROM users) users, "
    "(SELECT count(*) FROM assets) assets, (SELECT count(*) FROM asset_groups) asset_groups, "
    "(SELECT count(*) FROM software_products) software, (SELECT count(*) FROM vulnerabilities) vulns, "
    "(SELECT count(*) FROM patch_actions) actions, (SELECT count(*) FROM scan_sources) scan_sources, "
    "count(*) FILTER (status = 'Open') findings, "
    "count(*) FILTER (status = 'Open' AND severity = 'Critical') critical_findings, "
    "count(*) FILTER (status = 'Open' AND exploit_available) exploitable, "
    f"count(*) FILTER (status NOT IN {CLOSED} AND sla_due_date < {AS_OF}) sla_breached FROM flags",
    flags=_flags,
)
say("a8_write_version", f"SELECT {out('scan_findings')} FROM scan_findings")
say(
    "a8_snapshot_partitions",
    f"SELECT {out('risk_score_snapshots')} FROM risk_score_snapshots UNION ALL "
    f"SELECT {out('risk_score_snapshots')} FROM older",
    older=snapshots("DATE '1998-06-01'"),
    **SNAP,
)

# --- reports ------------------------------------------------------------------------------------------
say(
    "r1_findings_by_severity",
    "SELECT severity, count(*) cnt, "
    f"{ratio('sum(cvss_score * 10)', '10 * count(cvss_score)', 2)} avg_cvss, "
    f"{ratio('sum(epss_score * 10000)', '10000 * count(epss_score)', 4)} avg_epss, "
    "count(*) FILTER (exploit_available) with_exploit "
    f"FROM scan_findings f {SEVERITY_OF} WHERE status NOT IN {CLOSED} GROUP BY severity",
)
say(
    "r2_patch_status_summary",
    "SELECT status, priority, count(*) cnt, "
    f"count(*) FILTER (due_date < {AS_OF} AND status NOT IN {DONE}) overdue FROM patch_actions GROUP BY ALL",
)
say(
    "r3_top_exposed_assets",
    "SELECT hostname, ip_address, environment, CAST(criticality AS BIGINT) criticality, org_name, "
    "count(finding_id) open_findings, CAST(max(risk_score) AS DOUBLE) max_risk_score, "
    "count(*) FILTER (exploit_available) exploitable_vulns, "
    f"count(*) FILTER (sla_due_date < {AS_OF}) sla_breaches "
    f"FROM scan_findings f {SEVERITY_OF} JOIN assets a ON a.asset_id = f.asset_id_fk "
    f"JOIN organizations o ON o.org_id = a.org_id_fk WHERE status NOT IN {CLOSED} "
    "GROUP BY asset_id, hostname, ip_address, environment, a.criticality, org_name "
    "ORDER BY open_findings DESC, max(risk_score) DESC NULLS FIRST, asset_id LIMIT 10",
)
say(
    "r4_compliance_by_org",
    "SELECT org_name, industry, regulatory_scope, count(DISTINCT a.asset_id) asset_count, "
    "count(p.action_id) total_actions, count(*) FILTER (p.status = 'Completed') completed, "
    f"{percent(chr(39).join(['count(*) FILTER (p.status = ', 'Completed', ')']), 'count(p.action_id)')} compliance_pct, "
    f"count(*) FILTER (f.sla_due_date < {AS_OF} AND f.status NOT IN {CLOSED}) sla_breaches "
    "FROM organizations o LEFT JOIN assets a ON a.org_id_fk = o.org_id "
    "LEFT JOIN scan_findings f ON f.asset_id_fk = a.asset_id "
    "LEFT JOIN patch_actions p ON p.finding_id_fk = f.finding_id "
    "GROUP BY o.org_id, org_name, industry, regulatory_scope",
)
say(
    "r5_most_affected_software",
    "SELECT product_name, vendor, version, product_type, is_supported, count(DISTINCT vuln_id) vuln_count, "
    "count(DISTINCT finding_id) finding_count, CAST(max(cvss_score) AS DOUBLE) max_cvss, "
    "CAST(max(epss_score) AS DOUBLE) max_epss, count(*) FILTER (exploit_available) exploitable_count "
    "FROM software_products s JOIN software_vulnerabilities sv ON sv.software_id_fk = s.software_id "
    "JOIN vulnerabilities v ON v.vuln_id = sv.vuln_id_fk LEFT JOIN scan_findings f ON f.sw_vuln_id_fk = sv.sw_vuln_id "
    "GROUP BY software_id, product_name, vendor, version, product_type, is_supported",
)
_v3 = (
    "SELECT finding_id, org_name, hostname, ip_address, environment, CAST(criticality AS BIGINT) asset_criticality, "
    "cve_id, severity, CAST(cvss_score AS DOUBLE) cvss_score, CAST(epss_score AS DOUBLE) epss_score, "
    "CAST(epss_percentile AS DOUBLE) epss_percentile, attack_vector, exploit_maturity, patch_available, "
    "CAST(risk_score AS DOUBLE) risk_score, sla_due_date, discovered_at, f.status finding_status, "
    "source_name detected_by_tool, "
    f"CASE WHEN sla_due_date < {AS_OF} THEN 'OVERDUE' WHEN sla_due_date <= {AS_OF} + 7 THEN 'DUE SOON' "
    "ELSE 'WITHIN SLA' END sla_urgency, "
    "CASE WHEN exploit_available AND epss_score >= 0.5 THEN 'IMMINENT' WHEN exploit_available OR epss_score >= 0.2 "
    "THEN 'ELEVATED' ELSE 'MONITORED' END exploitation_threat_level "
    f"FROM scan_findings f {SEVERITY_OF} JOIN assets a ON a.asset_id = f.asset_id_fk "
    "JOIN organizations o ON o.org_id = a.org_id_fk LEFT JOIN scan_sources s ON s.source_id = f.scan_source_id_fk "
    f"WHERE f.status NOT IN {SETTLED} AND (exploit_available OR severity = 'Critical' OR severity = 'High')"
)
say("v3_exploit_risk_dashboard", _v3)
say(
    "r6_exploit_risk_dashboard",
    f"SELECT * FROM ({_v3}) ORDER BY epss_score DESC NULLS FIRST, cvss_score DESC NULLS FIRST, finding_id LIMIT 20",
)
_v4 = (
    "SELECT o.org_id, org_name, industry, regulatory_scope, count(DISTINCT asset_id) total_assets, "
    "count(DISTINCT finding_id) open_findings, "
    "count(DISTINCT finding_id) FILTER (severity = 'Critical') critical_findings, "
    "count(DISTINCT finding_id) FILTER (exploit_available) exploitable_findings, "
    f"count(DISTINCT finding_id) FILTER (sla_due_date < {AS_OF}) sla_breached_findings, "
    "count(DISTINCT action_id) total_patch_actions, "
    "count(DISTINCT action_id) FILTER (p.status = 'Completed') completed_actions, "
    f"{percent(chr(39).join(['count(DISTINCT action_id) FILTER (p.status = ', 'Completed', ')']), 'count(DISTINCT action_id)')} "
    "patch_compliance_pct, CAST(round(coalesce(sum(risk_score), 0), 0) AS DOUBLE) aggregate_risk_score "
    "FROM organizations o LEFT JOIN (SELECT * FROM assets WHERE is_active) a ON a.org_id_fk = o.org_id "
    f"LEFT JOIN (SELECT * FROM scan_findings WHERE status NOT IN {SETTLED}) f ON f.asset_id_fk = a.asset_id "
    f"{OUTER_SEVERITY_OF} LEFT JOIN patch_actions p ON p.finding_id_fk = f.finding_id "
    "GROUP BY o.org_id, org_name, industry, regulatory_scope"
)
say("v4_organization_risk_posture", _v4)
say("r7_org_risk_posture", _v4 + " ORDER BY aggregate_risk_score DESC")
say(
    "r8_sla_breach_analysis",
    "SELECT org_name, severity, count(*) breach_count, "
    f"{ratio(f'sum({AS_OF} - sla_due_date)', 'count(*)', 1)} avg_days_overdue, "
    f"max({AS_OF} - sla_due_date) max_days_overdue, "
    f"{ratio('sum(risk_score * 100)', '100 * count(risk_score)', 2)} avg_risk_score "
    f"FROM scan_findings f {SEVERITY_OF} JOIN assets a ON a.asset_id = f.asset_id_fk "
    f"JOIN organizations o ON o.org_id = a.org_id_fk WHERE sla_due_date < {AS_OF} AND status NOT IN {CLOSED} "
    "GROUP BY org_name, severity",
)

# --- views --------------------------------------------------------------------------------------------
_levels = ", ".join(
    f"count(*) FILTER (severity = '{s}') {s.lower()}_count" for s in ("Critical", "High", "Medium", "Low")
)
say(
    "v1_asset_exposure_summary",
    "SELECT asset_id, hostname, fqdn, ip_address, asset_type, operating_system, environment, network_zone, "
    "CAST(criticality AS BIGINT) criticality, business_impact, org_name, u.full_name asset_owner, "
    f"count(finding_id) total_open_findings, {_levels}, count(*) FILTER (exploit_available) exploitable_count, "
    f"count(*) FILTER (sla_due_date < {AS_OF}) sla_breached_count, "
    "CAST(coalesce(max(risk_score), 0) AS DOUBLE) max_risk_score, "
    "CAST(coalesce(sum(risk_score), 0) AS DOUBLE) total_risk_score "
    "FROM assets a JOIN organizations o ON o.org_id = a.org_id_fk LEFT JOIN users u ON u.user_id = a.owner_id_fk "
    f"LEFT JOIN (SELECT * FROM scan_findings WHERE status NOT IN {SETTLED}) f ON f.asset_id_fk = a.asset_id "
    f"{OUTER_SEVERITY_OF} GROUP BY asset_id, hostname, fqdn, ip_address, asset_type, operating_system, environment, "
    "network_zone, a.criticality, business_impact, org_name, u.full_name",
)
say(
    "v2_patch_compliance_status",
    "SELECT action_id, hostname, environment, CAST(criticality AS BIGINT) criticality, cve_id, title vuln_title, "
    "severity, CAST(cvss_score AS DOUBLE) cvss_score, exploit_available, action_type, p.status action_status, "
    "priority, due_date, change_ticket_id, completed_at, u1.full_name assigned_to, u2.full_name assigned_by, "
    "f.status finding_status, sla_due_date, CAST(risk_score AS DOUBLE) risk_score, "
    f"CASE WHEN p.status = 'Completed' THEN 'Compliant' WHEN p.status = 'Cancelled' THEN 'On Track' "
    f"WHEN sla_due_date < {AS_OF} THEN 'SLA Breached' WHEN sla_due_date <= {AS_OF} + 7 THEN 'At Risk' "
    f"ELSE 'On Track' END compliance_state, {AS_OF} - sla_due_date days_past_sla "
    f"FROM patch_actions p JOIN scan_findings f ON f.finding_id = p.finding_id_fk {SEVERITY_OF} "
    "JOIN assets a ON a.asset_id = f.asset_id_fk LEFT JOIN users u1 ON u1.user_id = p.assigned_to_fk "
    "LEFT JOIN users u2 ON u2.user_id = p.assigned_by_fk",
)

# --- functions ----------------------------------------------------------------------------------------
say(
    "f1_finding_risk_score",
    f"SELECT finding_id, CAST({SCORE} AS DOUBLE) risk_score FROM scan_findings f {SEVERITY_OF} "
    "JOIN assets a ON a.asset_id = f.asset_id_fk",
)
say(
    "f2_sla_days_remaining",
    f"SELECT finding_id, CASE WHEN status NOT IN {SETTLED} THEN sla_due_date - {AS_OF} END sla_days_remaining "
    "FROM scan_findings",
)
_rate = (
    f"SELECT o.org_id, {percent('count(*) FILTER (p.status = ' + chr(39) + 'Completed' + chr(39) + ')', 'count(p.action_id)')} "
    "compliance_rate FROM organizations o LEFT JOIN (assets a JOIN scan_findings f ON f.asset_id_fk = a.asset_id "
    "JOIN patch_actions p ON p.finding_id_fk = f.finding_id) ON a.org_id_fk = o.org_id GROUP BY o.org_id"
)
say("f3_org_compliance_rate", _rate)
say("d4_patch_compliance_rate_older", _rate)
say(
    "f4_asset_composite_risk",
    "SELECT asset_id_fk asset_id, CAST(composite_score AS DOUBLE) composite_risk FROM risk_score_snapshots",
    **SNAP,
)
say(
    "d1_asset_risk_score",
    "SELECT asset_id, CAST(coalesce(sum(CASE severity WHEN 'Critical' THEN 10 WHEN 'High' THEN 6 WHEN 'Medium' THEN 3 "
    "WHEN 'Low' THEN 1 ELSE 0 END) FILTER (finding_id IS NOT NULL), 0) * any_value(criticality) AS BIGINT) risk_score "
    "FROM assets a LEFT JOIN (SELECT * FROM scan_findings WHERE status = 'Open') f ON f.asset_id_fk = a.asset_id "
    f"{OUTER_SEVERITY_OF} GROUP BY asset_id",
)
say(
    "d2_asset_exposure_summary_older",
    "SELECT asset_id, hostname, asset_type, environment, CAST(criticality AS BIGINT) criticality, org_name, "
    f"count(finding_id) total_open_findings, {_levels} "
    "FROM assets a JOIN organizations o ON o.org_id = a.org_id_fk "
    "LEFT JOIN (SELECT * FROM scan_findings WHERE status = 'Open') f ON f.asset_id_fk = a.asset_id "
    f"{OUTER_SEVERITY_OF} GROUP BY asset_id, hostname, asset_type, environment, a.criticality, org_name",
)
say(
    "d3_patch_compliance_status_older",
    "SELECT action_id, hostname, cve_id, title vuln_title, severity, action_type, p.status action_status, due_date, "
    "completed_at, u.full_name assigned_to, f.status finding_status, "
    f"CASE WHEN p.status = 'Completed' THEN 'Compliant' WHEN p.status <> 'Cancelled' AND due_date < {AS_OF} "
    "THEN 'Overdue' ELSE 'In Progress' END compliance_state "
    f"FROM patch_actions p JOIN scan_findings f ON f.finding_id = p.finding_id_fk {SEVERITY_OF} "
    "JOIN assets a ON a.asset_id = f.asset_id_fk LEFT JOIN users u ON u.user_id = p.assigned_to_fk",
)
_trend_days = ", ".join(str(n) for n in (*range(360, 29, -30), 2, 1, 0))
say(
    "d5_risk_trend",
    "SELECT asset_id_fk, snapshot_date, CAST(score AS DOUBLE) composite_score, CAST(lag(score) OVER w AS DOUBLE) "
    "previous_score, CAST(score - lag(score) OVER w AS DOUBLE) score_change FROM daily "
    "WINDOW w AS (PARTITION BY asset_id_fk ORDER BY snapshot_date)",
    days=f"SELECT {AS_OF} - n snapshot_date FROM (SELECT unnest([{_trend_days}]) n)",
    scored=(
        f"SELECT f.asset_id_fk, CAST(f.discovered_at AS DATE) opened, CASE WHEN f.status NOT IN {SETTLED} THEN DATE '9999-01-01' "
        "WHEN f.status = 'Remediated' THEN CAST(f.discovered_at AS DATE) + CAST((f.asset_id_fk + f.sw_vuln_id_fk) % 300 AS INT) "
        f"END closed, {SCORE} score FROM scan_findings f {SEVERITY_OF} JOIN assets a ON a.asset_id = f.asset_id_fk"
    ),
    daily=(
        "SELECT a.asset_id asset_id_fk, d.snapshot_date, coalesce(sum(s.score), 0) score FROM assets a CROSS JOIN days d "
        "LEFT JOIN scored s ON s.asset_id_fk = a.asset_id AND s.opened <= d.snapshot_date AND s.closed > d.snapshot_date "
        "GROUP BY a.asset_id, d.snapshot_date"
    ),
)

# --- ingest, patch actions, snapshots -----------------------------------------------------------------
_NUMBERED = (
    "SELECT *, CASE outcome WHEN 'inserted' THEN (SELECT max(finding_id) FROM known) "
    "+ row_number() OVER (PARTITION BY outcome ORDER BY asset_id_fk, sw_vuln_id_fk) ELSE held_id END finding_id FROM judged"
)
INGEST = {
    "feed": (
        "SELECT asset_id_fk % 100 a, v_id % 100 v, pair, seen_at, (asset_id_fk % 24) * 10 + v_id % 2 src, "
        "'host ' || asset_id_fk evidence FROM sightings LEFT JOIN (SELECT vuln_id_fk pv, min(sw_vuln_id) pair "
        "FROM software_vulnerabilities GROUP BY 1) ON pv = v_id % 100"
    ),
    "known": (
        "SELECT a * 500000000000 + pair finding_id, a, pair, ['Open', 'In Progress', 'Remediated', 'Accepted Risk', "
        "'False Positive', 'Pending Retest'][(a + v) % 6 + 1] status, min(seen_at) t0, max(seen_at) t1 "
        f"FROM feed WHERE seen_at < {AS_OF} AND pair IS NOT NULL AND (a * 7 + v) % 3 <> 0 "
        "AND a IN (SELECT asset_id FROM assets) GROUP BY a, pair, v"
    ),
    "ranked": (
        "SELECT *, row_number() OVER (PARTITION BY a, pair ORDER BY seen_at, src NULLS FIRST, evidence NULLS FIRST) rn, "
        f"max(seen_at) OVER (PARTITION BY a, pair) t1 FROM feed WHERE seen_at >= {AS_OF}"
    ),
    "picked": (
        "SELECT org_id_fk po, severity ps, arg_min(max_days_to_remediate, policy_id) sla_days "
        "FROM remediation_sla_policies WHERE is_active GROUP BY ALL"
    ),
    "context": (
        f"SELECT b.*, a.asset_id, sv.sw_vuln_id, sla_days, {SCORE} risk FROM ranked b LEFT JOIN assets a ON a.asset_id = b.a "
        "LEFT JOIN software_vulnerabilities sv ON sv.sw_vuln_id = b.pair LEFT JOIN vulnerabilities v "
        "ON v.vuln_id = sv.vuln_id_fk LEFT JOIN picked ON po = a.org_id_fk AND ps = v.severity WHERE rn = 1"
    ),
    "judged": (
        "SELECT c.a asset_id_fk, c.pair sw_vuln_id_fk, CASE WHEN k.status IN ('Remediated', 'False Positive') "
        "THEN 'rejected_closed' WHEN k.status IS NOT NULL THEN 'touched' WHEN asset_id IS NULL OR sw_vuln_id IS NULL "
        "OR src NOT IN (SELECT source_id FROM scan_sources) THEN 'rejected_fk' ELSE 'inserted' END outcome, "
        "k.finding_id held_id, CASE WHEN k.status IS NULL THEN src END scan_source_id_fk, "
        "coalesce(k.status, 'Open') status, "
        "CASE WHEN k.status IS NULL THEN risk END risk_score, "
        "CASE WHEN k.status IS NULL THEN CAST(c.seen_at AS DATE) + sla_days END sla_due_date, "
        "coalesce(k.t0, c.seen_at) discovered_at, CASE WHEN k.status IN ('Remediated', 'False Positive') THEN k.t1 "
        "ELSE greatest(k.t1, c.t1) END last_seen_at, "
        "CASE WHEN k.status IS NULL THEN evidence END evidence_snippet, CAST(NULL AS VARCHAR) notes "
        "FROM context c LEFT JOIN known k ON k.a = c.a AND k.pair = c.pair"
    ),
    "outcomes": _NUMBERED,
}
_outcome = (
    "SELECT asset_id_fk, sw_vuln_id_fk, outcome, finding_id, scan_source_id_fk, status, "
    "CAST(risk_score AS DOUBLE) risk_score, sla_due_date, discovered_at, last_seen_at, evidence_snippet, notes "
    "FROM outcomes"
)
say("p1_record_scan_findings", _outcome, **INGEST)
# The ids of new findings depend on the batch they come in.
_streamed = _outcome.replace("outcome, finding_id,", "outcome, held_id finding_id,")
say("s1_stream_record_findings", _streamed, **INGEST)
_plain = "CAST(NULL AS TIMESTAMP) first_fixed_at"
_texts = "CAST(NULL AS VARCHAR) false_positive_reason, CAST(NULL AS VARCHAR) accepted_risk_reason, CAST(NULL AS VARCHAR) notes"
say(
    "p1_findings_after",
    "SELECT k.finding_id, k.a asset_id_fk, k.pair sw_vuln_id_fk, CAST(NULL AS BIGINT) scan_source_id_fk, k.status, "
    "CAST(NULL AS DOUBLE) risk_score, CAST(NULL AS DATE) sla_due_date, k.t0 discovered_at, "
    f"coalesce(o.last_seen_at, k.t1) last_seen_at, {_plain}, CAST(NULL AS VARCHAR) evidence_snippet, {_texts} "
    "FROM known k LEFT JOIN outcomes o ON o.finding_id = k.finding_id UNION ALL "
    "SELECT finding_id, asset_id_fk, sw_vuln_id_fk, scan_source_id_fk, status, CAST(risk_score AS DOUBLE), "
    f"sla_due_date, discovered_at, last_seen_at, {_plain}, evidence_snippet, {_texts} "
    "FROM outcomes WHERE outcome = 'inserted'",
    **INGEST,
)
say(
    "t2_finding_pre_insert",
    "SELECT a * 500000000000 + pair finding_id, a asset_id_fk, pair sw_vuln_id_fk, src scan_source_id_fk, 'Open' status, "
    "CAST(CASE WHEN (a + pair) % 2 = 0 THEN 42 ELSE risk END AS DOUBLE) risk_score, "
    f"CASE WHEN (a + pair) % 2 <> 0 THEN {AS_OF} + sla_days END sla_due_date, "
    f"CASE WHEN a % 3 = 0 THEN {NOW} ELSE seen_at END discovered_at, {NOW} last_seen_at, {_plain}, "
    f"CAST(NULL AS VARCHAR) evidence_snippet, {_texts} FROM context WHERE pair IS NOT NULL",
    **INGEST,
)
# The same jobs on the feed's own keys, against the stored findings.
STORED = {
    **INGEST,
    "feed": (
        "SELECT asset_id_fk a, sw_vuln_id_fk pair, v_id v, seen_at, (asset_id_fk % 24) * 10 + v_id % 2 src, "
        "'host ' || asset_id_fk evidence FROM sightings"
    ),
    "known": f"SELECT * FROM scan_findings WHERE discovered_at < {AS_OF} OR (asset_id_fk + sw_vuln_id_fk) % 3 <> 0",
    "judged": (
        "SELECT c.a asset_id_fk, c.pair sw_vuln_id_fk, CASE WHEN k.status IN ('Remediated', 'False Positive') "
        "THEN 'rejected_closed' WHEN k.finding_id IS NOT NULL THEN 'touched' WHEN asset_id IS NULL OR sw_vuln_id IS NULL "
        "OR src NOT IN (SELECT source_id FROM scan_sources) THEN 'rejected_fk' ELSE 'inserted' END outcome, "
        "k.finding_id held_id, "
        "CASE WHEN k.finding_id IS NULL THEN src ELSE k.scan_source_id_fk END scan_source_id_fk, "
        "coalesce(k.status, 'Open') status, CASE WHEN k.finding_id IS NULL THEN risk ELSE k.risk_score END risk_score, "
        "CASE WHEN k.finding_id IS NULL THEN CAST(c.seen_at AS DATE) + sla_days ELSE k.sla_due_date END sla_due_date, "
        "coalesce(k.discovered_at, c.seen_at) discovered_at, CASE WHEN k.status IN ('Remediated', 'False Positive') "
        "THEN k.last_seen_at ELSE greatest(k.last_seen_at, c.t1) END last_seen_at, "
        "CASE WHEN k.finding_id IS NULL THEN evidence ELSE k.evidence_snippet END evidence_snippet, k.notes notes "
        "FROM context c LEFT JOIN known k ON k.asset_id_fk = c.a AND k.sw_vuln_id_fk = c.pair"
    ),
    "outcomes": _NUMBERED,
}
say("p1_record_stored_findings", _outcome, **STORED)
say("s1_stream_stored_findings", _streamed, **STORED)
say(
    "p1_stored_findings_after",
    "SELECT " + out("scan_findings", prefix="k.").replace(
        "k.last_seen_at last_seen_at", "coalesce(o.last_seen_at, k.last_seen_at) last_seen_at"
    ) + " FROM known k LEFT JOIN outcomes o ON o.finding_id = k.finding_id UNION ALL "
    f"SELECT {out('scan_findings')} FROM (SELECT finding_id, asset_id_fk, sw_vuln_id_fk, scan_source_id_fk, status, "
    f"risk_score, sla_due_date, discovered_at, last_seen_at, {_plain}, evidence_snippet, {_texts} "
    "FROM outcomes WHERE outcome = 'inserted')",
    **STORED,
)
say(
    "t2_stored_pre_insert",
    "SELECT a * 500000000000 + pair finding_id, a asset_id_fk, pair sw_vuln_id_fk, src scan_source_id_fk, 'Open' status, "
    "CAST(CASE WHEN (a + pair) % 2 = 0 THEN 42 ELSE risk END AS DOUBLE) risk_score, "
    f"CASE WHEN (a + pair) % 2 <> 0 THEN {AS_OF} + sla_days END sla_due_date, "
    f"CASE WHEN a % 3 = 0 THEN {NOW} ELSE seen_at END discovered_at, {NOW} last_seen_at, {_plain}, "
    f"CAST(NULL AS VARCHAR) evidence_snippet, {_texts} FROM context",
    **STORED,
)
REQUESTS = {
    "requests": (
        "SELECT finding_id * 10 + CASE WHEN h % 260 = 0 THEN 1 WHEN h % 200 = 0 THEN 5 ELSE 5 + j END action_id, finding_id, "
        "CASE WHEN h % 180 = 0 THEN 999999 ELSE h % 10 END assigned_to, "
        "CASE WHEN h % 60 <> 0 THEN h % 9 END assigned_by, CASE WHEN h % 140 = 0 THEN 'Nonsense' ELSE 'Patch' END action_type, "
        "CAST(discovered_at AS DATE) + 14 due_date, 'CHG-' || h ticket FROM (SELECT *, asset_id_fk + sw_vuln_id_fk h FROM scan_findings), range(2) g(j) "
        "WHERE h % 20 = 0 AND (j = 0 OR h % 40 = 0) UNION ALL SELECT -k, -k, 1, 2, 'Patch', NULL, NULL FROM range(1, 6) u(k)"
    ),
    "judged": (
        "SELECT r.*, f.status finding_status, severity, CASE WHEN f.finding_id IS NULL THEN 'rejected_missing' "
        f"WHEN f.status IN {CLOSED} THEN 'rejected_closed' END reason FROM requests r LEFT JOIN "
        f"(scan_findings f {SEVERITY_OF}) ON f.finding_id = r.finding_id"
    ),
    "refused": (
        "SELECT *, NULL rule_id, NULL column_name, NULL AS \"value\" FROM judged WHERE reason IS NOT NULL "
        "UNION ALL SELECT * REPLACE ('rejected_rule' AS reason), 'C2', 'action_id', CAST(action_id AS VARCHAR) FROM judged "
        "WHERE reason IS NULL AND action_id IN (SELECT action_id FROM requests GROUP BY 1 HAVING count(*) > 1) "
        "UNION ALL SELECT * REPLACE ('rejected_rule' AS reason), 'C2', 'action_id', CAST(action_id AS VARCHAR) FROM judged "
        "WHERE reason IS NULL AND action_id IN (SELECT action_id FROM patch_actions) "
        "UNION ALL SELECT * REPLACE ('rejected_rule' AS reason), 'C4', 'assigned_to_fk', CAST(assigned_to AS VARCHAR) FROM judged "
        "WHERE reason IS NULL AND assigned_to NOT IN (SELECT user_id FROM users) "
        "UNION ALL SELECT * REPLACE ('rejected_rule' AS reason), 'C4', 'assigned_by_fk', CAST(assigned_by AS VARCHAR) FROM judged "
        "WHERE reason IS NULL AND assigned_by NOT IN (SELECT user_id FROM users) "
        "UNION ALL SELECT * REPLACE ('rejected_rule' AS reason), 'C6', 'action_type', action_type FROM judged "
        "WHERE reason IS NULL AND action_type = 'Nonsense'"
    ),
    "taken": (
        "SELECT * FROM judged j WHERE NOT EXISTS (SELECT 1 FROM refused x WHERE x.action_id = j.action_id)"
    ),
}
say(
    "p2_new_actions",
    "SELECT action_id, finding_id finding_id_fk, assigned_to assigned_to_fk, assigned_by assigned_by_fk, "
    "action_type, 'Pending' status, CASE WHEN severity IN ('Low', 'Info') THEN 'Low' ELSE severity END priority, "
    "due_date, CAST(NULL AS TIMESTAMP) started_at, CAST(NULL AS TIMESTAMP) completed_at, ticket change_ticket_id, "
    "CAST(NULL AS VARCHAR) rollback_plan, CAST(NULL AS VARCHAR) resolution_notes, "
    f"{NOW} created_at FROM taken",
    **REQUESTS,
)
say(
    "p2_new_history",
    "SELECT (SELECT max(history_id) FROM patch_status_history) + row_number() OVER (ORDER BY action_id) history_id, "
    "action_id action_id_fk, CAST(NULL AS VARCHAR) old_status, "
    f"'Pending' new_status, assigned_by changed_by_fk, {NOW} changed_at, "
    "'Patch action initiated by ' || assigned_by change_reason, FALSE automated FROM taken",
    **REQUESTS,
)
say(
    "p2_findings_after",
    "SELECT " + out("scan_findings", prefix="f.").replace(
        "f.status status",
        "CASE WHEN finding_id IN (SELECT finding_id FROM taken) THEN 'In Progress' "
        "ELSE f.status END status",
    ) + " FROM scan_findings f",
    **REQUESTS,
)
say(
    "p2_rejected",
    'SELECT action_id, finding_id, reason, finding_status, rule_id, column_name, "value" FROM refused',
    **REQUESTS,
)
say("p3_refresh_risk_snapshots", f"SELECT {out('risk_score_snapshots')} FROM risk_score_snapshots", **SNAP)
say(
    "p3_advanced_risk_snapshots",
    f"SELECT {out('risk_score_snapshots')} FROM advanced",
    moved_findings=(
        "SELECT * REPLACE (CASE WHEN (asset_id_fk + sw_vuln_id_fk) % 9 = 0 THEN 'Remediated' ELSE status END AS status) FROM scan_findings"
    ),
    advanced=snapshots(findings="moved_findings"),
)

# --- audit trail, updates -----------------------------------------------------------------------------
UPDATES = {
    "moved": (
        "SELECT action_id mid, assigned_to_fk who, status old_status, CASE WHEN action_id % 8 = 0 THEN status ELSE "
        "CASE status WHEN 'Pending' THEN 'In Progress' WHEN 'In Progress' THEN 'Awaiting Approval' "
        "WHEN 'Awaiting Approval' THEN 'Completed' WHEN 'Completed' THEN 'Failed' WHEN 'Failed' THEN 'Cancelled' "
        "WHEN 'Cancelled' THEN 'Rolled Back' ELSE 'Pending' END END new_status "
        "FROM patch_actions WHERE action_id % 4 = 0"
    )
}
_audit = (
    "SELECT (SELECT max(history_id) FROM patch_status_history) + row_number() OVER (ORDER BY mid) history_id, mid action_id_fk, old_status, new_status, who changed_by_fk, "
    f"{NOW} changed_at, 'Status changed from ' || old_status || ' to ' || new_status change_reason, FALSE automated "
    "FROM moved WHERE old_status <> new_status"
)
say("t1_patch_status_audit", _audit, **UPDATES)
# As a batch update the same change also has to keep every rule: the assignee must be a known user.
say(
    "m2_action_history",
    _audit + " AND (who IS NULL OR EXISTS (SELECT 1 FROM users u WHERE u.user_id = who))",
    **UPDATES,
)
_feed_audit = (
    "SELECT history_id event_id, action_id_fk action_id, old_status, new_status, changed_at, "
    "'Status changed from ' || coalesce(old_status, 'NULL') || ' to ' || new_status change_reason "
    "FROM patch_status_history"
)
say("t1_event_feed_audit", _feed_audit)
say("s2_stream_status_audit", _feed_audit)
say(
    "m2_updated_actions",
    "SELECT " + out("patch_actions", prefix="p.").replace("p.status status", "coalesce(new_status, p.status) status")
    + " FROM patch_actions p LEFT JOIN moved ON mid = p.action_id",
    **UPDATES,
)
FIXED = {
    "fixed": (
        "SELECT *, (asset_id_fk + sw_vuln_id_fk) % 9 = 0 hit FROM scan_findings"
    )
}
say(
    "t3_finding_remediated",
    "SELECT " + out("scan_findings", prefix="f.")
    .replace("f.status status", "CASE WHEN hit THEN 'Remediated' ELSE f.status END status")
    .replace(
        "f.first_fixed_at first_fixed_at",
        f"CASE WHEN hit AND f.status <> 'Remediated' THEN {NOW} END first_fixed_at",
    ) + " FROM fixed f",
    **FIXED,
)
say(
    "t4_org_updated_at",
    "SELECT " + out("organizations").replace(
        "updated_at updated_at", f"CASE WHEN org_id % 2 = 0 THEN {NOW} END updated_at"
    ) + " FROM organizations",
)
say(
    "t5_time_to_remediate",
    "SELECT a.org_id_fk, org_name, severity, count(*) fixed_findings, "
    f"{ratio(f'sum({AS_OF} - CAST(discovered_at AS DATE))', 'count(*)', 1)} avg_days_to_fix "
    f"FROM fixed f {SEVERITY_OF} JOIN assets a ON a.asset_id = f.asset_id_fk "
    "JOIN organizations o ON o.org_id = a.org_id_fk WHERE hit AND f.status <> 'Remediated' "
    "GROUP BY a.org_id_fk, org_name, severity",
    **FIXED,
)
say("m2_unknown_organizations", "SELECT org_id + 1000 org_id FROM organizations WHERE org_id % 5 = 0")

# --- inserts ------------------------------------------------------------------------------------------
FORM = {
    "form": (
        "SELECT c_custkey id, CASE WHEN c_custkey % 17 = 0 THEN 99 ELSE 24 END org, "
        "CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 10 END owner, "
        "CASE WHEN c_custkey % 13 = 0 THEN 'shared-host' ELSE c_name END host, "
        "CASE WHEN c_custkey % 5 = 0 THEN '300.1.1.1' ELSE '10.0.0.' || (c_custkey % 256) END ip, "
        "c_mktsegment kind, CASE WHEN c_custkey % 3 = 0 THEN '9' WHEN c_custkey % 19 = 0 THEN 'high' "
        "ELSE CAST(1 + c_custkey % 5 AS VARCHAR) END crit, c_custkey % 4 <> 0 has_env "
        "FROM customer WHERE c_nationkey = 24"
    ),
    "broken": (
        "SELECT id, 'C5' rule_id, 'ip_address' column_name, ip AS \"value\" FROM form WHERE ip = '300.1.1.1' UNION ALL "
        "SELECT id, 'C5', 'criticality', crit FROM form WHERE crit = 'high' UNION ALL "
        "SELECT id, 'C6', 'criticality', crit FROM form WHERE crit = '9' UNION ALL "
        "SELECT id, 'C1', 'environment', NULL FROM form WHERE NOT has_env UNION ALL "
        "SELECT id, 'C4', 'org_id_fk', CAST(org AS VARCHAR) FROM form WHERE org NOT IN (SELECT org_id FROM organizations) "
        "UNION ALL SELECT id, 'C4', 'owner_id_fk', CAST(owner AS VARCHAR) FROM form "
        "WHERE owner NOT IN (SELECT user_id FROM users) UNION ALL "
        "SELECT id, 'C3', 'hostname', host FROM form WHERE host IN (SELECT hostname FROM assets)"
    ),
    "whole": (
        "SELECT *, row_number() OVER (PARTITION BY host ORDER BY id) rn FROM form "
        "WHERE id NOT IN (SELECT id FROM broken)"
    ),
}
say(
    "m1_inserted_assets",
    "SELECT id asset_id, CAST(org AS BIGINT) org_id_fk, owner owner_id_fk, host hostname, CAST(NULL AS VARCHAR) fqdn, "
    "ip ip_address, CAST(NULL AS VARCHAR) mac_address, kind asset_type, 'Linux' operating_system, "
    "CAST(NULL AS VARCHAR) os_version, CAST(NULL AS BIGINT) cpu_count, CAST(NULL AS DOUBLE) ram_gb, "
    "CAST(crit AS BIGINT) criticality, CAST(NULL AS VARCHAR) business_impact, 'Lab' environment, "
    "CAST(NULL AS VARCHAR) network_zone, TRUE is_active, CAST(NULL AS TIMESTAMP) last_seen_at, "
    f"CAST(NULL AS VARCHAR) notes, {NOW} created_at FROM whole WHERE rn = 1",
    **FORM,
)
say(
    "m1_rejected_assets",
    "SELECT 'assets' table_name, rule_id, CAST(id AS VARCHAR) AS \"key\", column_name, \"value\" FROM broken UNION ALL "
    "SELECT 'assets', 'C3', CAST(id AS VARCHAR), 'hostname', host FROM whole WHERE rn > 1",
    **FORM,
)

# --- deletes, upserts ---------------------------------------------------------------------------------


def _deletion() -> tuple[dict[str, str], str]:
    """Doomed keys per table, then the effects, spelled out along the references."""
    start = {"organizations": "org_id = 3", "users": "user_id = 2", "vulnerabilities": "vuln_id % 50 = 0"}
    ctes: dict[str, str] = {}
    effects = []
    for name, spec in TABLES.items():
        tests = [start[name]] if name in start else []
        tests += [
            f"EXISTS (SELECT 1 FROM gone_{r.parent} g WHERE g.k = {name}.{r.column})"
            for r in spec.references
            if r.on_delete == "cascade" and f"gone_{r.parent}" in ctes
        ]
        if tests:
            ctes[f"gone_{name}"] = f"SELECT {spec.pk} k FROM {name} WHERE {' OR '.join(tests)}"
            effects.append(
                f"SELECT '{name}' table_name, k AS \"key\", 'deleted' effect, '' column_name FROM gone_{name}"
            )
        for r in spec.references:
            if r.on_delete == "set null" and f"gone_{r.parent}" in ctes:
                effects.append(
                    f"SELECT '{name}', {spec.pk}, 'set null', '{r.column}' FROM {name} WHERE {r.column} IN "
                    f"(SELECT k FROM gone_{r.parent}) AND {spec.pk} NOT IN (SELECT k FROM gone_{name})"
                )
    return ctes, " UNION ALL ".join(effects)


_gone, _effects = _deletion()
say("m3_delete_effects", _effects, **_gone, **SNAP)
for _name, _t in {"m3_findings_after": "scan_findings", "m3_actions_after": "patch_actions"}.items():
    _spec = TABLES[_t]
    _cols = out(_t)
    for _r in _spec.references:
        if _r.on_delete == "set null":
            _cols = _cols.replace(
                f"{_r.column} {_r.column}",
                f"CASE WHEN {_r.column} NOT IN (SELECT k FROM gone_{_r.parent}) THEN {_r.column} END {_r.column}",
            )
    say(_name, f"SELECT {_cols} FROM {_t} WHERE {_spec.pk} NOT IN (SELECT k FROM gone_{_t})", **_gone)

_stale = ", ".join(
    f"{c} + 1 AS {c}" for c in TABLES["risk_score_snapshots"].flagged("edit") if c not in ("asset_id_fk", "snapshot_date")
)
say(
    "m4_upsert_snapshots",
    f"SELECT {out('risk_score_snapshots')} FROM stale UNION ALL SELECT * FROM ("
    "SELECT CASE WHEN asset_id_fk % 2 = 0 THEN -(snapshot_id - 30) ELSE snapshot_id END snapshot_id, "
    f"{out('risk_score_snapshots', TABLES['risk_score_snapshots'].names[1:])} FROM risk_score_snapshots)",
    older=snapshots("DATE '1998-06-01'"),
    stale=f"SELECT * REPLACE ({_stale}) FROM older",
    **SNAP,
)

# --- integrity ----------------------------------------------------------------------------------------
_vulns = (
    out("vulnerabilities")
    .replace("severity severity", "CASE WHEN vuln_id % 97 = 0 THEN 'Severe' ELSE severity END severity")
    .replace(
        "CAST(cvss_score AS DOUBLE) cvss_score",
        "CASE WHEN vuln_id % 89 = 0 THEN 12.5 ELSE cvss_score END cvss_score",
    )
)
_assets = (
    out("assets")
    .replace("hostname hostname", "CASE WHEN asset_id % 101 = 0 THEN repeat('h', 201) ELSE hostname END hostname")
    .replace("ip_address ip_address", "CASE WHEN asset_id % 103 = 0 THEN '300.1.1.1' ELSE ip_address END ip_address")
    .replace(
        "mac_address mac_address",
        "CASE WHEN asset_id % 109 = 0 THEN '08:00:2b:01:02' WHEN asset_id % 2 = 0 THEN '08:00:2b:01:02:03' END "
        "mac_address",
    )
    .replace(
        "CAST(criticality AS BIGINT) criticality",
        "CASE WHEN asset_id % 107 <> 0 THEN CAST(criticality AS BIGINT) END criticality",
    )
)
FAULTY = {
    "faulty_scan_findings": (
        "SELECT * FROM scan_findings UNION ALL SELECT * FROM scan_findings "
        "WHERE (asset_id_fk + sw_vuln_id_fk) % 50 = 0"
    ),
    "faulty_vulnerabilities": f"SELECT {_vulns} FROM vulnerabilities",
    "faulty_assets": f"SELECT {_assets} FROM assets",
    "faulty_patch_actions": (
        "SELECT * REPLACE (CASE WHEN action_id % 113 = 0 THEN -action_id ELSE finding_id_fk END AS finding_id_fk) "
        "FROM patch_actions"
    ),
    **SNAP,
}


def at(table: str) -> str:
    return f"faulty_{table}" if f"faulty_{table}" in FAULTY else table


def breach(spec: Table, rule: str, key: str, column: str, value: str, test: str, tail: str = "") -> str:
    return (
        f"SELECT '{spec.name}' table_name, '{rule}' rule_id, {key} AS \"key\", '{column}' column_name, "
        f"{value} AS \"value\" FROM {at(spec.name)} WHERE {test}{tail}"
    )


def _integrity() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {f"C{i}": [] for i in range(1, 7)}
    octets = "len(string_split(ip_address, '.')) = 4 AND list_max(CAST(string_split(ip_address, '.') AS INT[])) <= 255"
    for spec in TABLES.values():
        key = f"CAST({spec.pk} AS VARCHAR)"
        for c in spec.columns:
            text = f"CAST({c.name} AS VARCHAR)"
            if c.required:
                found["C1"].append(breach(spec, "C1", key, c.name, "CAST(NULL AS VARCHAR)", f"{c.name} IS NULL"))
            if c.max_length:
                found["C5"].append(breach(spec, "C5", key, c.name, text, f"len({c.name}) > {c.max_length}"))
            if c.sql_type == "inet":
                found["C5"].append(breach(spec, "C5", key, c.name, text, f"{c.name} IS NOT NULL AND NOT ({octets})"))
            if c.sql_type == "macaddr":
                found["C5"].append(
                    breach(spec, "C5", key, c.name, text, f"NOT regexp_full_match({c.name}, '[0-9a-f]{{2}}(:[0-9a-f]{{2}}){{5}}')")
                )
            if c.name in spec.checks:
                rule = spec.checks[c.name]
                words = rule if isinstance(rule, str) else None
                test = words or f"{c.name} IN ({', '.join(repr(w) for w in rule)})"
                found["C6"].append(breach(spec, "C6", key, c.name, text, f"({test}) IS FALSE"))
        for rule, columns in (("C2", (spec.pk,)), ("C3", spec.unique)):
            if columns:
                shown = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
                present = " AND ".join(f"{c} IS NOT NULL" for c in columns)
                found[rule].append(
                    breach(
                        spec, rule, shown, ",".join(columns), "CAST(count(*) AS VARCHAR)", present,
                        f" GROUP BY {', '.join(columns)} HAVING count(*) > 1",
                    )
                )
        for r in spec.references:
            pk = TABLES[r.parent].pk
            found["C4"].append(
                breach(
                    spec, "C4", key, r.column, f"CAST({r.column} AS VARCHAR)",
                    f"{r.column} IS NOT NULL AND {r.column} NOT IN (SELECT {pk} FROM {at(r.parent)})",
                )
            )
    return found


_titles = {
    "C1": "not_null", "C2": "primary_key", "C3": "unique", "C4": "foreign_key", "C5": "domain", "C6": "check",
}
for _rule, _parts in _integrity().items():
    say(f"{_rule.lower()}_{_titles[_rule]}", " UNION ALL ".join(_parts), **FAULTY)

# --- daily counts -------------------------------------------------------------------------------------
say(
    "s3_stream_daily_counts",
    "SELECT CAST(ts AS DATE) AS \"day\", event_type kind, count(*) n FROM events "
    "WHERE CAST(ts AS DATE) + 1 <= (SELECT max(date_trunc('second', ts)) - INTERVAL 1 DAY FROM events) GROUP BY ALL",
)

assert set(BOUND) | {"risk_score_snapshots"} == set(TABLES)
