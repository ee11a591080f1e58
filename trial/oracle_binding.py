"""The bound tables as SQL, written apart from the Spark binding, for checking results with DuckDB."""

from __future__ import annotations

import re

from mendgrid.schemas import TABLES

AS_OF = "DATE '1998-07-01'"
NOW = "TIMESTAMP '1998-07-01 00:00:00'"

# Each table: the FROM part and the bound columns; columns left out are NULL.
BOUND = {
    "organizations": (
        "nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
        {
            "org_id": "n.n_nationkey",
            "org_name": "n.n_name",
            "industry": "r.r_name",
            "hq_country": "substr(r.r_name, 1, 2)",
            "employee_count": "(n.n_nationkey + 1) * 100",
            "revenue_tier": "CASE n.n_nationkey % 4 WHEN 0 THEN 'SMB' WHEN 1 THEN 'Mid-Market' "
            "WHEN 2 THEN 'Enterprise' ELSE 'Fortune500' END",
            "regulatory_scope": "CASE WHEN n.n_nationkey % 5 <> 0 THEN r.r_name || ', SOC2' END",
        },
    ),
    "users": (
        "supplier",
        {
            "user_id": "s_suppkey",
            "org_id_fk": "s_nationkey",
            "username": "s_name",
            "full_name": "s_name",
            "email": "s_name || '@example.com'",
            "role": "CASE s_suppkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'analyst' ELSE 'patch_manager' END",
            "mfa_enabled": "s_acctbal > 0",
            "is_active": "s_suppkey % 9 <> 0",
        },
    ),
    "asset_groups": (
        "nation, range(5) g(k)",
        {
            "group_id": "n_nationkey * 10 + k",
            "org_id_fk": "n_nationkey",
            "group_name": "'G' || k",
            "group_type": "['Network Zone', 'Business Unit', 'Compliance Scope', 'Criticality Tier', "
            "'Geographic'][k + 1]",
            "owner_id_fk": "CASE WHEN k <> 4 THEN n_nationkey % 10 END",
        },
    ),
    "assets": (
        "customer WHERE c_nationkey <> 24",
        {
            "asset_id": "c_custkey",
            "org_id_fk": "c_nationkey",
            "owner_id_fk": "CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 10 END",
            "hostname": "c_name",
            "ip_address": "'10.0.0.' || (c_custkey % 256)",
            "asset_type": "c_mktsegment",
            "operating_system": "'Linux'",
            "criticality": "c_custkey % 5 + 1",
            "environment": "CASE c_mktsegment WHEN 'BUILDING' THEN 'Production' WHEN 'AUTOMOBILE' THEN 'Staging' "
            "WHEN 'MACHINERY' THEN 'Development' WHEN 'HOUSEHOLD' THEN 'Corporate' ELSE 'DMZ' END",
            "is_active": "c_custkey % 10 <> 0",
        },
    ),
    "asset_group_memberships": (
        "assets",
        {
            "membership_id": "asset_id",
            "asset_id_fk": "asset_id",
            "group_id_fk": "org_id_fk * 10 + asset_id % 5",
            "added_by_fk": "owner_id_fk",
        },
    ),
    "scan_sources": (
        "nation, range(2) g(k)",
        {
            "source_id": "n_nationkey * 10 + k",
            "org_id_fk": "n_nationkey",
            "source_name": "CASE WHEN k = 0 THEN 'scanner' ELSE 'edr' END",
            "source_type": "CASE WHEN k = 0 THEN 'Vulnerability Scanner' ELSE 'EDR' END",
            "is_active": "TRUE",
        },
    ),
    "software_products": (
        "supplier",
        {
            "software_id": "s_suppkey",
            "product_name": "s_name",
            "vendor": "'V' || s_nationkey",
            "version": "CASE WHEN s_suppkey % 6 <> 0 THEN '1.0' END",
            "product_type": "CASE s_suppkey % 3 WHEN 0 THEN 'Application' WHEN 1 THEN 'Library' ELSE 'Database' END",
            "cpe_uri": "'cpe:' || s_name",
            "is_supported": "s_acctbal > 0",
        },
    ),
    "vulnerabilities": (
        "part",
        {
            "vuln_id": "p_partkey",
            "cve_id": "CASE WHEN p_partkey % 19 <> 0 THEN 'CVE-' || p_partkey END",
            "title": "p_name",
            "severity": "CASE WHEN p_size >= 45 THEN 'Critical' WHEN p_size >= 35 THEN 'High' "
            "WHEN p_size >= 20 THEN 'Medium' WHEN p_size >= 5 THEN 'Low' ELSE 'Info' END",
            "cvss_score": "CASE WHEN p_partkey % 13 <> 0 THEN p_size * 0.2 END",
            "epss_score": "CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey * 37) % 10000 AS DECIMAL(9,0)) * 0.0001 END",
            "exploit_available": "p_partkey % 3 = 0",
            "patch_available": "p_partkey % 4 <> 0",
            "attack_vector": "['Network', 'Adjacent', 'Local', 'Physical'][p_partkey % 4 + 1]",
        },
    ),
    "software_vulnerabilities": (
        "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)",
        {
            "sw_vuln_id": "l_partkey * 200000 + l_suppkey",
            "software_id_fk": "l_suppkey",
            "vuln_id_fk": "l_partkey",
        },
    ),
    "asset_software_installs": (
        "(SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) p "
        "WHERE o_custkey IN (SELECT asset_id FROM assets)",
        {
            "install_id": "o_custkey * 200000 + l_suppkey",
            "asset_id_fk": "o_custkey",
            "software_id_fk": "l_suppkey",
            "detected_by": "'scan'",
            "is_authorized": "TRUE",
        },
    ),
    "remediation_sla_policies": (
        "nation, (VALUES (0, 'Critical', 7, 3), (1, 'High', 15, 7), (2, 'Medium', 45, 14), (3, 'Low', 90, 30), "
        "(4, 'Critical', 3, 1)) g(k, s, d, e) WHERE k < 4 OR n_nationkey % 4 = 0",
        {
            "policy_id": "n_nationkey * 10 + k",
            "org_id_fk": "n_nationkey",
            "policy_name": "'P' || k",
            "severity": "s",
            "max_days_to_remediate": "d",
            "escalation_days": "e",
            "applies_to_env": "CASE WHEN k = 4 THEN 'Production' END",
            "is_active": "n_nationkey % 6 <> 5 OR k <> 3",
        },
    ),
    "scan_findings": (
        "(SELECT asset_id_fk a_id, sw_vuln_id_fk p_id, v_id, min(status) st, min(seen_at) t0, max(seen_at) t1, "
        "min(ship) due FROM sightings GROUP BY ALL) f JOIN assets a ON a.asset_id = f.a_id "
        "JOIN vulnerabilities v ON v.vuln_id = f.v_id",
        {
            "finding_id": "f.a_id * 500000000000 + f.p_id",
            "asset_id_fk": "f.a_id",
            "sw_vuln_id_fk": "f.p_id",
            "scan_source_id_fk": "CASE WHEN f.a_id % 6 <> 0 THEN a.org_id_fk * 10 + f.a_id % 2 END",
            "status": "f.st",
            "risk_score": "score(v.cvss_score, v.epss_score, a.criticality, v.exploit_available)",
            "sla_due_date": "CASE WHEN (f.a_id + f.p_id) % 17 <> 0 THEN f.due END",
            "discovered_at": "f.t0",
            "last_seen_at": "f.t1",
        },
    ),
    "patch_actions": (
        "(SELECT *, asset_id_fk + sw_vuln_id_fk h FROM scan_findings) f, range(1, 3) g(k) "
        "WHERE CASE k WHEN 1 THEN h % 3 <> 0 ELSE h % 5 = 0 END",
        {
            "action_id": "finding_id * 10 + k",
            "finding_id_fk": "finding_id",
            "assigned_to_fk": "CASE WHEN h % 8 <> 0 THEN h % 10 END",
            "assigned_by_fk": "h % 9",
            "action_type": "CASE WHEN f.status = 'Accepted Risk' THEN 'Accept Risk' ELSE 'Patch' END",
            "status": "['Pending', 'In Progress', 'Awaiting Approval', 'Completed', 'Failed', 'Cancelled', "
            "'Rolled Back'][(h + k) % 7 + 1]",
            "priority": "['Critical', 'High', 'Medium', 'Low'][(h + k) % 4 + 1]",
            "due_date": "CASE WHEN h % 12 <> 0 THEN CAST(discovered_at AS DATE) + 30 END",
        },
    ),
    "patch_status_history": (
        "(SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) prev FROM events) e "
        "WHERE prev IS DISTINCT FROM event_type",
        {
            "history_id": "event_id",
            "action_id_fk": "user_id",
            "old_status": "prev",
            "new_status": "event_type",
            "changed_at": "ts",
            "automated": "FALSE",
        },
    ),
}

SIGHTINGS = (
    "SELECT o_custkey asset_id_fk, l_partkey * 200000 + l_suppkey sw_vuln_id_fk, l_partkey v_id, "
    "CASE l_returnflag WHEN 'N' THEN CASE l_linestatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'In Progress' "
    "ELSE 'False Positive' END WHEN 'A' THEN CASE l_linestatus WHEN 'O' THEN 'Pending Retest' WHEN 'F' "
    "THEN 'Remediated' ELSE 'False Positive' END WHEN 'R' THEN CASE l_linestatus WHEN 'O' THEN 'Accepted Risk' "
    "ELSE 'False Positive' END ELSE 'False Positive' END status, "
    "o_orderdate seen_at, CAST(l_shipdate AS DATE) ship "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 50 <> 49"
)


def score(cvss: str, epss: str, criticality: str, exploit: str) -> str:
    """Risk in billionths as whole numbers, then rounded half up to cents.

    cvss has one decimal, the criticality weight two, the likelihood five and the bonus one.
    """
    whole = (
        f"(CAST(coalesce({cvss}, 5.0) * 10 AS BIGINT) * (40 + CAST({criticality} AS BIGINT) * 32) "
        f"* (100000 + CAST(coalesce({epss}, 0) * 10000 AS BIGINT) * 15) "
        f"* CASE WHEN {exploit} THEN 12 ELSE 10 END)"
    )
    return f"CAST(({whole} + 5000000) // 10000000 AS BIGINT) / 100.0"


def duck_type(sql_type: str) -> str:
    if sql_type.startswith(("varchar", "char", "text", "inet", "macaddr")):
        return "VARCHAR"
    return sql_type.upper()


def table_select(name: str) -> str:
    source, bound = BOUND[name]
    parts = []
    for c in TABLES[name].columns:
        text = bound.get(c.name, "NULL")
        inner = re.fullmatch(r"score\((.*)\)", text)
        if inner:
            text = score(*[w.strip() for w in inner.group(1).split(",")])
        parts.append(f"CAST({text} AS {duck_type(c.sql_type)}) {c.name}")
    return f"SELECT {', '.join(parts)} FROM {source}"


def with_tables(body: str, **extra: str) -> str:
    """``body`` with the bound tables, and ``extra`` named queries, that it needs in front of it."""
    known = {"sightings": SIGHTINGS, **{t: table_select(t) for t in BOUND}, **extra}
    order: list[str] = []

    def need(text: str, seen: tuple[str, ...]) -> None:
        for name in known:
            if name in order or name in seen or not re.search(rf"\b{name}\b", text):
                continue
            need(known[name], (*seen, name))
            if name not in order:
                order.append(name)

    need(body, ())
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + body
