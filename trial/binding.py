"""Tracker tables derived from the star-schema test parquet.

Ids are arithmetic on natural keys, so no sequence and no global numbering is needed. Beyond suppliers of
200,000 a pair gets its id from a range of its own. Findings of such pairs, of parts beyond 2,500,000 or of assets
beyond 1,844,673 would have actions whose ids leave 64 bits, so they are numbered per asset instead, see ``finding_id``. Ids stay
distinct; what has none left stops the job.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendgrid.functions.scoring import finding_risk_score
from mendgrid.operators.snapshots import refresh_risk_snapshots
from mendgrid.schemas import TABLES
from mendgrid.sources.storage import TableSet, conform, read_table, shared_folder

AS_OF = date(1998, 7, 1)

# Large derived tables are written once per application and test folder, then read as typed parquet.
_STORED: dict[tuple[str, str, str], str] = {}
# The bound tables of a session, so that a job does not declare them anew.
_BOUND: dict[tuple[int, str, str], TableSet] = {}

# Columns of the test parquet the binding reads.
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW[name]).parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, table: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/{key[0]}/{table}-{uuid.uuid4().hex}"
        conform(build(), table).write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return read_table(spark, _STORED[key], table)


def tables(spark: SparkSession, sf_dir: str) -> TableSet:
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _BOUND:
        _BOUND[key] = bind(spark, sf_dir)
    return _BOUND[key]


def bind(spark: SparkSession, sf_dir: str) -> TableSet:
    def src(name):
        return raw(spark, sf_dir, name)

    makers = {
        "organizations": lambda: organizations(src("nation"), src("region")),
        "users": lambda: users(src("supplier")),
        "asset_groups": lambda: asset_groups(src("nation")),
        "assets": lambda: assets(src("customer")),
        "asset_group_memberships": lambda: asset_group_memberships(assets(src("customer"))),
        "scan_sources": lambda: scan_sources(src("nation")),
        "software_products": lambda: software_products(src("supplier")),
        "vulnerabilities": lambda: vulnerabilities(src("part")),
        "remediation_sla_policies": lambda: remediation_sla_policies(src("nation")),
        "patch_status_history": lambda: patch_status_history(src("events")),
        "software_vulnerabilities": lambda: stored(
            spark, sf_dir, "software_vulnerabilities", lambda: software_vulnerabilities(src("lineitem"))
        ),
        "asset_software_installs": lambda: stored(
            spark, sf_dir, "asset_software_installs",
            lambda: asset_software_installs(src("lineitem"), src("orders"), assets(src("customer"))),
        ),
        "scan_findings": lambda: stored(
            spark, sf_dir, "scan_findings",
            lambda: scan_findings(
                sightings(src("lineitem"), src("orders")), assets(src("customer")), vulnerabilities(src("part")),
                ids_run_out(src("lineitem"), src("orders")),
            ),
        ),
    }
    found = TableSet(makers)
    makers["patch_actions"] = lambda: stored(
        spark, sf_dir, "patch_actions", lambda: patch_actions(found["scan_findings"])
    )
    found = TableSet(makers)
    makers["risk_score_snapshots"] = lambda: stored(
        spark, sf_dir, "risk_score_snapshots", lambda: refresh_risk_snapshots(found, AS_OF)
    )
    return TableSet(makers)


def organizations(nation: DataFrame, region: DataFrame) -> DataFrame:
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return conform(
        joined.selectExpr(
            "cast(n_nationkey as bigint) org_id",
            "n_name org_name",
            "r_name industry",
            "substr(r_name, 1, 2) hq_country",
            "100 * (n_nationkey + 1) employee_count",
            "case n_nationkey % 4 when 0 then 'SMB' when 1 then 'Mid-Market' when 2 then 'Enterprise' "
            "else 'Fortune500' end revenue_tier",
            "case when n_nationkey % 5 = 0 then null else concat(r_name, ', SOC2') end regulatory_scope",
        ),
        "organizations",
    )


def users(supplier: DataFrame) -> DataFrame:
    return conform(
        supplier.selectExpr(
            "s_suppkey user_id",
            "cast(s_nationkey as bigint) org_id_fk",
            "s_name username",
            "s_name full_name",
            "concat(s_name, '@example.com') email",
            "case s_suppkey % 3 when 0 then 'admin' when 1 then 'analyst' else 'patch_manager' end role",
            "s_acctbal > 0 mfa_enabled",
            "s_suppkey % 9 <> 0 is_active",
        ),
        "users",
    )


def asset_groups(nation: DataFrame) -> DataFrame:
    each = nation.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return conform(
        each.selectExpr(
            "cast(n_nationkey * 10 + k as bigint) group_id",
            "cast(n_nationkey as bigint) org_id_fk",
            "concat('G', cast(k as string)) group_name",
            "case k when 0 then 'Network Zone' when 1 then 'Business Unit' when 2 then 'Compliance Scope' "
            "when 3 then 'Criticality Tier' else 'Geographic' end group_type",
            "cast(case when k = 4 then null else n_nationkey % 10 end as bigint) owner_id_fk",
        ),
        "asset_groups",
    )


def assets(customer: DataFrame) -> DataFrame:
    return conform(
        customer.where("c_nationkey <> 24").selectExpr(
            "c_custkey asset_id",
            "cast(c_nationkey as bigint) org_id_fk",
            "cast(case when c_custkey % 7 = 0 then null else c_custkey % 10 end as bigint) owner_id_fk",
            "c_name hostname",
            "concat('10.0.0.', cast(c_custkey % 256 as string)) ip_address",
            "c_mktsegment asset_type",
            "'Linux' operating_system",
            "cast(1 + c_custkey % 5 as smallint) criticality",
            "case c_mktsegment when 'BUILDING' then 'Production' when 'AUTOMOBILE' then 'Staging' "
            "when 'MACHINERY' then 'Development' when 'HOUSEHOLD' then 'Corporate' else 'DMZ' end environment",
            "c_custkey % 10 <> 0 is_active",
        ),
        "assets",
    )


def asset_group_memberships(asset_rows: DataFrame) -> DataFrame:
    return conform(
        asset_rows.selectExpr(
            "asset_id membership_id",
            "asset_id asset_id_fk",
            "org_id_fk * 10 + asset_id % 5 group_id_fk",
            "owner_id_fk added_by_fk",
        ),
        "asset_group_memberships",
    )


def scan_sources(nation: DataFrame) -> DataFrame:
    each = nation.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return conform(
        each.selectExpr(
            "cast(n_nationkey * 10 + k as bigint) source_id",
            "cast(n_nationkey as bigint) org_id_fk",
            "case k when 0 then 'scanner' else 'edr' end source_name",
            "case k when 0 then 'Vulnerability Scanner' else 'EDR' end source_type",
            "true is_active",
        ),
        "scan_sources",
    )


def software_products(supplier: DataFrame) -> DataFrame:
    return conform(
        supplier.selectExpr(
            "s_suppkey software_id",
            "s_name product_name",
            "concat('V', cast(s_nationkey as string)) vendor",
            "case when s_suppkey % 6 = 0 then null else '1.0' end version",
            "case s_suppkey % 3 when 0 then 'Application' when 1 then 'Library' else 'Database' end product_type",
            "concat('cpe:', s_name) cpe_uri",
            "s_acctbal > 0 is_supported",
        ),
        "software_products",
    )


def vulnerabilities(part: DataFrame) -> DataFrame:
    return conform(
        part.selectExpr(
            "p_partkey vuln_id",
            "case when p_partkey % 19 = 0 then null else concat('CVE-', cast(p_partkey as string)) end cve_id",
            "p_name title",
            "case when p_size >= 45 then 'Critical' when p_size >= 35 then 'High' when p_size >= 20 then 'Medium' "
            "when p_size >= 5 then 'Low' else 'Info' end severity",
            "case when p_partkey % 13 = 0 then null else cast(p_size * 0.2 as decimal(3,1)) end cvss_score",
            "case when p_partkey % 11 = 0 then null "
            "else cast((p_partkey * 37 % 10000) * 0.0001 as decimal(5,4)) end epss_score",
            "p_partkey % 3 = 0 exploit_available",
            "p_partkey % 4 <> 0 patch_available",
            "case p_partkey % 4 when 0 then 'Network' when 1 then 'Adjacent' when 2 then 'Local' "
            "else 'Physical' end attack_vector",
        ),
        "vulnerabilities",
    )


SUPPLIERS = 200_000
# Ids of a key and a supplier beyond ``SUPPLIERS`` are those of keys from ``WIDE`` on: one for each key and block of suppliers.
WIDE = 40_000_000_000_000
BLOCKS = 1_000
WIDE_KEYS = 6_000_000_000


def with_supplier(key: str) -> str:
    """SQL of an id made of ``key`` and the supplier; it stops the job rather than repeat an id."""
    return (
        f"if(l_suppkey between 0 and {SUPPLIERS - 1} and coalesce({key} < {WIDE}, true), "
        f"{key} * {SUPPLIERS} + l_suppkey, cast(raise_error('supplier key out of range for ids') as bigint))"
    )


def with_any_supplier(key: str) -> str:
    """``with_supplier`` that has ids for suppliers of a thousand more blocks, too."""
    last = SUPPLIERS * (BLOCKS + 1) - 1
    wide = f"({WIDE} + {key} * {BLOCKS} + l_suppkey div {SUPPLIERS} - 1) * {SUPPLIERS} + l_suppkey % {SUPPLIERS}"
    return (
        f"if(l_suppkey between {SUPPLIERS} and {last} and coalesce({key} between 0 and {WIDE_KEYS - 1}, true), "
        f"{wide}, {with_supplier(key)})"
    )


def part_of(pair: str) -> Column:
    """The part in an id that ``with_any_supplier`` made of it."""
    key = f"(({pair} - pmod({pair}, {SUPPLIERS})) div {SUPPLIERS})"
    return F.expr(f"if({pair} >= {WIDE * SUPPLIERS}, ({key} - {WIDE}) div {BLOCKS}, {key})")


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` over as many tasks as the session shuffles to, before it is grouped by them.

    Nearly all rows of the feed differ: combining them before the shuffle, and merging its partitions by their packed size
    after it, only makes tables that a task has to spill. A repeated row costs its task a look-up and no room.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df`` without repeats."""
    # In order, as the parts are small: it packs them to half the size.
    return dealt(df, *df.columns).distinct().sortWithinPartitions(*df.columns)


def software_vulnerabilities(lineitem: DataFrame) -> DataFrame:
    return distinct_rows(lineitem.select("l_partkey", "l_suppkey")).selectExpr(
        f"{with_any_supplier('l_partkey')} sw_vuln_id",
        "l_suppkey software_id_fk",
        "l_partkey vuln_id_fk",
    )


def asset_software_installs(lineitem: DataFrame, orders: DataFrame, asset_rows: DataFrame) -> DataFrame:
    pairs = distinct_rows(with_order(lineitem, orders).select("o_custkey", "l_suppkey"))
    return pairs.join(asset_rows, pairs.o_custkey == asset_rows.asset_id, "left_semi").selectExpr(
        f"{with_any_supplier('o_custkey')} install_id",
        "o_custkey asset_id_fk",
        "l_suppkey software_id_fk",
        "'scan' detected_by",
        "true is_authorized",
    )


def remediation_sla_policies(nation: DataFrame) -> DataFrame:
    ladder = F.expr(
        "explode(array(named_struct('k', 0, 's', 'Critical', 'd', 7, 'e', 3), "
        "named_struct('k', 1, 's', 'High', 'd', 15, 'e', 7), named_struct('k', 2, 's', 'Medium', 'd', 45, 'e', 14), "
        "named_struct('k', 3, 's', 'Low', 'd', 90, 'e', 30), named_struct('k', 4, 's', 'Critical', 'd', 3, 'e', 1)))"
    )
    each = nation.withColumn("g", ladder).where("g.k < 4 or n_nationkey % 4 = 0")
    return conform(
        each.selectExpr(
            "cast(n_nationkey * 10 + g.k as bigint) policy_id",
            "cast(n_nationkey as bigint) org_id_fk",
            "concat('P', cast(g.k as string)) policy_name",
            "g.s severity",
            "g.d max_days_to_remediate",
            "g.e escalation_days",
            "case when g.k = 4 then 'Production' else null end applies_to_env",
            "not (n_nationkey % 6 = 5 and g.k = 3) is_active",
        ),
        "remediation_sla_policies",
    )


def with_order(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Line items with their order. Orders are hashed, as one side of unique keys and few columns: so the line items,
    which hardly fit a task's memory, need no sort, and an order with very many of them no room."""
    return lineitem.join(orders.hint("shuffle_hash"), lineitem.l_orderkey == orders.o_orderkey)


# Status of a sighting by the return flag and line status of its line item; any others are false positives.
FLAGS = {
    "NO": "Open", "NF": "In Progress", "AO": "Pending Retest", "AF": "Remediated", "RO": "Accepted Risk",
}


def sightings(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The raw scan feed: one sighting per line item."""
    # The flags travel as one small number: as text they would make up a third of the rows shuffled for the join.
    flags = F.array(*[F.lit(f) for f in FLAGS])
    lines = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.expr("cast(l_shipdate as date)").alias("ship"),
        F.array_position(flags, F.concat("l_returnflag", "l_linestatus")).cast("tinyint").alias("flags"),
    )
    joined = with_order(lines, orders).where("o_custkey % 50 <> 49")
    statuses = F.array(*[F.lit(s) for s in FLAGS.values()])
    return joined.select(
        F.col("o_custkey").alias("asset_id_fk"),
        F.expr(with_any_supplier("l_partkey")).alias("sw_vuln_id_fk"),
        "l_partkey",
        F.coalesce(F.get(statuses, F.col("flags") - 1), F.lit("False Positive")).alias("status"),
        F.col("o_orderdate").alias("seen_at"),
        "ship",
    )


# Pair ids below this number give distinct finding ids, and those of these assets leave room for actions' ids.
PAIRS = 500_000_000_000
FIRST_ASSET, LAST_ASSET = -900_000, 1_844_673
# Findings without an id of this kind are numbered downwards from the lowest one, in slots of an asset. Rows of a second
# series never get the number of one of the first.
SLOTS, IN_SLOT, SERIES, NUMBERED_ASSETS = 128, 1 << 22, 2, 400_000_000


def pair_in_range(pair: Column) -> Column:
    return (pair >= 0) & (pair < PAIRS)


def finding_key(asset: Column, pair: Column) -> Column:
    """Finding id from its natural key, NULL if a part is. It never collides: a pair id outside
    [0, ``PAIRS``) raises an error."""
    wide = F.raise_error(F.concat(F.lit("pair id out of range for finding ids: "), pair.cast("string")))
    return F.when(pair.isNull() | pair_in_range(pair), asset * F.lit(PAIRS) + pair).otherwise(wide.cast("bigint"))


def slot_of(pair: str) -> Column:
    return F.pmod(F.xxhash64(pair), F.lit(SLOTS)).cast("tinyint")


def number_in_slot() -> Column:
    """Number of a finding among those of its asset and slot: the same however the rows are dealt. A slot holds one part
    in ``SLOTS`` of an asset's findings, so a hot asset lies in many groups."""
    return F.row_number().over(Window.partitionBy("asset_id_fk", "slot").orderBy("sw_vuln_id_fk"))


def finding_id(asset: Column, pair: Column, slot: Column, number: Column, series: int = 0) -> Column:
    """``finding_key`` where it leaves room for the ids of actions, else an id below all of those, made of the asset and
    the finding's ``number`` (from 1) in ``slot`` of it. NULL if a part of the key is."""
    held = (pair < PAIRS) & asset.between(FIRST_ASSET, LAST_ASSET)
    fits = asset.between(0, NUMBERED_ASSETS - 1) & number.between(1, IN_SLOT)
    wide = F.raise_error(F.concat(F.lit("asset or number out of range for finding ids: "), asset.cast("string")))
    place = ((asset * SLOTS + slot) * SERIES + series) * IN_SLOT + number
    return (
        F.when(asset.isNull() | pair.isNull(), F.lit(None).cast("bigint"))
        .when(held, finding_key(asset, pair))
        .when(fits, F.lit(FIRST_ASSET * PAIRS) - place)
        .otherwise(wide.cast("bigint"))
    )


def ids_run_out(lineitem: DataFrame, orders: DataFrame) -> bool:
    """Whether findings of these tables may have to be numbered. The files' statistics mostly tell."""
    pairs = lineitem.where(f"l_partkey >= {PAIRS // SUPPLIERS} or l_suppkey >= {SUPPLIERS}")
    return not (pairs.isEmpty() and orders.where(f"o_custkey < {FIRST_ASSET} or o_custkey > {LAST_ASSET}").isEmpty())


def scan_findings(
    feed: DataFrame, asset_rows: DataFrame, vuln_rows: DataFrame, numbered: bool = False
) -> DataFrame:
    # The asset join comes first and is followed by another shuffle, so a hot asset can be split;
    # the feed is already reduced to one row per (asset, pair) by then. The lowest status is taken by its place among
    # all: a minimum of strings would have the whole feed sorted.
    statuses = F.array(*[F.lit(s) for s in sorted(TABLES["scan_findings"].checks["status"])])
    place = F.array_position(statuses, F.col("status")).cast("tinyint")
    rows = feed.select("asset_id_fk", "sw_vuln_id_fk", place.alias("place"), "seen_at", "ship")
    key, by = ["asset_id_fk", "sw_vuln_id_fk"], ["asset_id_fk", "sw_vuln_id_fk"]
    made = finding_key(F.col("asset_id_fk"), F.col("sw_vuln_id_fk"))
    if numbered:
        rows = rows.withColumn("slot", slot_of("sw_vuln_id_fk"))
        key, by = [*key, "slot"], ["asset_id_fk", "slot"]
        made = finding_id(F.col("asset_id_fk"), F.col("sw_vuln_id_fk"), F.col("slot"), F.col("number"))
    f = dealt(rows, *by).groupBy(*key).agg(
        F.min("place").alias("place"),
        F.min("seen_at").alias("discovered_at"),
        F.max("seen_at").alias("last_seen_at"),
        F.min("ship").alias("ship"),
    )
    if numbered:
        f = f.withColumn("number", number_in_slot())
    f = f.withColumn("status", F.get(statuses, F.col("place") - 1)).drop("place")
    a = asset_rows.select("asset_id", "org_id_fk", "criticality")
    v = vuln_rows.select("vuln_id", "cvss_score", "epss_score", "exploit_available")
    joined = f.join(a, f.asset_id_fk == a.asset_id).join(v, part_of("sw_vuln_id_fk") == v.vuln_id)
    score = finding_risk_score(
        F.col("cvss_score"), F.col("epss_score"), F.col("criticality"), F.col("exploit_available")
    )
    return joined.select(
        made.alias("finding_id"),
        "asset_id_fk",
        "sw_vuln_id_fk",
        F.expr("case when asset_id_fk % 6 = 0 then null else org_id_fk * 10 + asset_id_fk % 2 end").alias(
            "scan_source_id_fk"
        ),
        "status",
        score.cast("decimal(7,2)").alias("risk_score"),
        F.expr("case when (asset_id_fk + sw_vuln_id_fk) % 17 = 0 then null else ship end").alias("sla_due_date"),
        "discovered_at",
        "last_seen_at",
    ).sortWithinPartitions("asset_id_fk", "sw_vuln_id_fk")  # packs smaller, here and where it is shuffled


def patch_actions(findings: DataFrame) -> DataFrame:
    each = (
        findings.selectExpr(
            "finding_id", "status fstatus", "asset_id_fk + sw_vuln_id_fk h", "cast(discovered_at as date) d"
        )
        .withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
        .where("(k = 1 and h % 3 <> 0) or (k = 2 and h % 5 = 0)")
    )
    return each.selectExpr(
        "finding_id * 10 + k action_id",
        "finding_id finding_id_fk",
        "case when h % 8 = 0 then null else h % 10 end assigned_to_fk",
        "h % 9 assigned_by_fk",
        "case when fstatus = 'Accepted Risk' then 'Accept Risk' else 'Patch' end action_type",
        "case (h + k) % 7 when 0 then 'Pending' when 1 then 'In Progress' when 2 then 'Awaiting Approval' "
        "when 3 then 'Completed' when 4 then 'Failed' when 5 then 'Cancelled' else 'Rolled Back' end status",
        "case (h + k) % 4 when 0 then 'Critical' when 1 then 'High' when 2 then 'Medium' else 'Low' end priority",
        "case when h % 12 = 0 then null else d + 30 end due_date",
    )


def status_events(events: DataFrame) -> DataFrame:
    """The status feed: the event's user plays the action, its type the new status."""
    return events.selectExpr(
        "event_id", "user_id as action_id", "event_type as status", "ts as changed_at"
    )


def patch_status_history(events: DataFrame) -> DataFrame:
    from mendgrid.operators.audit import status_changes

    return conform(
        status_changes(status_events(events)).selectExpr(
            "event_id history_id", "action_id action_id_fk", "old_status", "new_status", "changed_at",
            "false automated",
        ),
        "patch_status_history",
    )
