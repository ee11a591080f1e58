"""Small tracker tables from literal rows."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from mendgrid.schemas import TABLES
from mendgrid.sources.storage import TableSet
from pyspark.sql import types as T

T0 = datetime(2025, 3, 1)


def _value(value, kind):
    if value is None:
        return None
    return Decimal(str(value)) if isinstance(kind, T.DecimalType) else value


def frame(spark, table: str, rows: list[dict]):
    spec = TABLES[table]
    data = [tuple(_value(r.get(c.name), c.spark_type) for c in spec.columns) for r in rows]
    return spark.createDataFrame(data, spec.struct)


def table_set(spark, **rows) -> TableSet:
    return TableSet({t: (lambda t=t: frame(spark, t, rows.get(t, []))) for t in TABLES})


def tracker(spark, **more) -> TableSet:
    """Two organisations, three assets, four vulnerabilities and their pairs."""
    base = {
        "organizations": [
            {"org_id": 1, "org_name": "North Bank", "industry": "Finance", "hq_country": "US"},
            {"org_id": 2, "org_name": "Blue Clinic", "industry": "Health", "hq_country": "DE"},
        ],
        "users": [
            {"user_id": 1, "org_id_fk": 1, "username": "ann", "full_name": "Ann A"},
            {"user_id": 2, "org_id_fk": 2, "username": "bob", "full_name": "Bob B"},
        ],
        "assets": [
            {"asset_id": 1, "org_id_fk": 1, "owner_id_fk": 1, "hostname": "web1", "criticality": 5, "is_active": True,
             "environment": "Production"},
            {"asset_id": 2, "org_id_fk": 1, "hostname": "web2", "criticality": 1, "is_active": False,
             "environment": "Lab"},
            {"asset_id": 3, "org_id_fk": 2, "hostname": "db1", "criticality": 3, "is_active": True,
             "environment": "DMZ"},
        ],
        "scan_sources": [{"source_id": 1, "org_id_fk": 1, "source_name": "scanner", "source_type": "EDR"}],
        "software_products": [{"software_id": 1, "product_name": "Web", "vendor": "V", "product_type": "Library"}],
        "vulnerabilities": [
            {"vuln_id": 1, "cve_id": "CVE-1", "title": "a", "severity": "Critical", "cvss_score": 9.8,
             "epss_score": 0.97, "exploit_available": True, "patch_available": True},
            {"vuln_id": 2, "cve_id": None, "title": "b", "severity": "High", "cvss_score": None, "epss_score": None,
             "exploit_available": False, "patch_available": True},
            {"vuln_id": 3, "cve_id": "CVE-3", "title": "c", "severity": "Medium", "cvss_score": 5.0,
             "epss_score": 0.2, "exploit_available": False, "patch_available": True},
            {"vuln_id": 4, "cve_id": "CVE-4", "title": "d", "severity": "Info", "cvss_score": 1.0,
             "epss_score": 0.01, "exploit_available": False, "patch_available": False},
        ],
        "software_vulnerabilities": [
            {"sw_vuln_id": 10 + v, "software_id_fk": 1, "vuln_id_fk": v} for v in (1, 2, 3, 4)
        ],
        "remediation_sla_policies": [
            {"policy_id": 2, "org_id_fk": 1, "policy_name": "b", "severity": "Critical", "max_days_to_remediate": 3,
             "applies_to_env": "Production", "is_active": True},
            {"policy_id": 1, "org_id_fk": 1, "policy_name": "a", "severity": "Critical", "max_days_to_remediate": 7,
             "is_active": True},
            {"policy_id": 3, "org_id_fk": 1, "policy_name": "c", "severity": "Medium", "max_days_to_remediate": 30,
             "is_active": False},
        ],
    }
    return table_set(spark, **{**base, **more})


def finding(asset: int, pair: int, status: str = "Open", **more) -> dict:
    return {
        "finding_id": asset * 500_000_000_000 + pair, "asset_id_fk": asset, "sw_vuln_id_fk": pair, "status": status,
        "discovered_at": T0, "last_seen_at": T0, **more,
    }


def rows(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
