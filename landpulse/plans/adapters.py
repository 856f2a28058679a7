"""Domain tables derived from the test tables.

The SQL texts run unchanged in Spark and in the checking database, apart from ``DAYS(a, b)``, the days from a to b.
They only rename and do integer arithmetic, so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from landpulse.functions.text import DEVANAGARI_DIGITS, LATIN_DIGITS
from landpulse.operators import risk, skew
from landpulse.plans.registry import Tables
from landpulse.session import durable

NOTIFICATIONS = """
SELECT o_custkey AS project_id, o_orderkey AS notification_id,
       CASE o_orderstatus WHEN 'O' THEN '3a' WHEN 'F' THEN '3A' WHEN 'P' THEN '3D' ELSE o_orderstatus END AS notification_type,
       CAST(o_orderdate AS DATE) AS publish_date,
       'GN-' || CAST(o_orderkey AS STRING) AS notification_number, o_orderpriority AS status
FROM {orders}
"""

EVENT_NOTIFICATIONS = """
SELECT user_id AS project_id, event_id AS notification_id,
       CASE event_type WHEN 'view' THEN '3a' WHEN 'click' THEN '3A' WHEN 'purchase' THEN '3D' ELSE event_type END AS notification_type,
       CAST(ts AS DATE) AS publish_date, 'GN-' || CAST(event_id AS STRING) AS notification_number, 'Published' AS status
FROM {events}
"""

SANCTIONS = """
SELECT o_custkey AS project_id, 'SN-' || CAST(o_orderkey AS STRING) AS sanction_number,
       CAST(o_orderdate AS DATE) - 30 AS sanction_date, o_totalprice AS sanction_amount_rs
FROM {orders}
"""

MANIFEST = """
SELECT c_custkey AS project_id,
       CASE WHEN c_custkey % 50 = 0 THEN 'Test ' || c_name ELSE c_name END AS project_name,
       'NH-' || CAST(c_custkey % 80 AS STRING) || CASE WHEN c_custkey % 77 = 0 THEN '-TEST' ELSE '' END AS project_number,
       CAST(50 + c_custkey % 400 AS DOUBLE) AS land_required_ha, CAST(c_custkey % 90 AS DOUBLE) AS land_available_ha,
       CAST(c_custkey % 300 AS DOUBLE) AS land_to_acquire_ha, CAST((c_custkey * 7) % 320 AS DOUBLE) AS land_acquired_ha
FROM {customer}
"""

SURVEYS = """
SELECT o.o_custkey AS project_id, l.l_orderkey AS notification_id, l.l_linenumber AS serial_number,
       'D' || CAST(l.l_suppkey % 7 AS STRING) AS district, 'SD' || CAST(l.l_suppkey % 23 AS STRING) AS sub_district,
       CASE WHEN l.l_partkey % 97 = 0 THEN ' ' ELSE 'V' || CAST(l.l_partkey % 97 AS STRING) END AS village,
       l.l_quantity AS area_hectares, CASE l.l_linestatus WHEN 'O' THEN 'Wet' ELSE 'Dry' END AS land_type,
       CASE l.l_returnflag WHEN 'R' THEN 'Private' WHEN 'A' THEN 'Government' ELSE 'Forest' END AS land_nature,
       CASE WHEN l.l_partkey % 5 = 0 THEN 'Urban' ELSE 'Rural' END AS land_category,
       l.l_linenumber AS owner_count, CAST(l.l_partkey % 3 AS INT) AS affected_party_count
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

PARTIES = """
SELECT o.o_custkey AS project_id, l.l_orderkey AS notification_id,
       CASE l.l_returnflag WHEN 'R' THEN 'Owner' WHEN 'A' THEN 'Affected Party' ELSE 'Tenant' END AS party_type,
       CASE WHEN l.l_partkey % 11 = 0 OR l.l_linenumber = 1 THEN NULL ELSE l.l_quantity END AS party_area_hectares,
       CASE WHEN l.l_partkey % 11 = 0 THEN 'Hectares' ELSE CAST(CAST(l.l_quantity AS INT) AS STRING) || ' Hectares' END AS party_area_raw
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

# One serving snapshot per order; project facts follow from the customer number alone.
SNAPSHOTS = """
SELECT b.*,
       CASE WHEN first_delay_day - days_since_project_start BETWEEN 1 AND 30 THEN 1 ELSE 0 END AS delay_next_30d,
       CASE WHEN first_delay_day - days_since_project_start BETWEEN 1 AND 60 THEN 1 ELSE 0 END AS delay_next_60d,
       CASE WHEN first_delay_day - days_since_project_start BETWEEN 1 AND 90 THEN 1 ELSE 0 END AS delay_next_90d
FROM (
  SELECT a.*, DAYS(project_start_date, snapshot_date) AS days_since_project_start,
         DAYS(stage_entry_date, snapshot_date) AS days_in_current_stage
  FROM (
    SELECT 'S' || CAST(o_orderkey AS STRING) AS snapshot_id, 'P' || CAST(o_custkey AS STRING) AS project_id,
           CAST(o_orderdate AS DATE) AS snapshot_date,
           DATE '1994-01-01' + CAST((o_custkey * 37) % 365 AS INT) AS project_start_date,
           CAST(o_orderdate AS DATE) - CAST((o_orderkey * 31) % 240 AS INT) AS stage_entry_date,
           CASE o_orderstatus WHEN 'O' THEN '3a' WHEN 'F' THEN '3A' ELSE '3D' END AS current_stage,
           CAST(1 + o_orderkey % 15 AS INT) AS event_count_so_far,
           CAST(50 + o_custkey % 400 AS DOUBLE) AS land_required_ha, CAST(10 + (o_custkey * 7) % 300 AS DOUBLE) AS land_to_acquire_ha,
           CAST(o_custkey % 50 AS INT) AS total_parcels, CAST((o_custkey * 13) % 200 AS INT) AS affected_families,
           CAST((o_custkey * 17) % 60 AS INT) AS vulnerable_families, CAST(o_orderkey % 7 AS INT) AS pending_approvals_count,
           CAST((o_orderkey * 3) % 120 AS DOUBLE) AS file_pending_days, CAST(40 + (o_orderkey * 7) % 61 AS DOUBLE) AS docs_complete_pct,
           CAST(o_orderkey % 6 AS INT) AS court_cases_count, CAST((o_orderkey * 5) % 48 AS DOUBLE) AS case_age_months,
           CAST(o_orderkey % 4 AS INT) AS title_disputes_parcels, CAST((o_orderkey * 11) % 13 AS INT) AS grievances_30d,
           CAST(o_orderkey % 50 AS DOUBLE) AS compensation_awarded_cr,
           CAST((o_orderkey % 50) * ((o_orderkey * 17) % 101) AS DOUBLE) / 100e0 AS compensation_disbursed_cr,
           CAST((o_orderkey * 17) % 101 AS DOUBLE) AS disbursal_pct, CAST((o_orderkey * 19) % 101 AS DOUBLE) AS rnr_progress_pct,
           CAST((o_orderkey * 23) % 101 AS DOUBLE) AS rnr_consent_pct, CAST((o_orderkey * 29) % 75 AS DOUBLE) AS grievance_redressal_days,
           CAST(o_orderkey % 2 AS INT) AS forest_involved, CAST((o_custkey * 3) % 40 AS DOUBLE) AS proximity_km_to_urban,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Environment' WHEN '2-HIGH' THEN 'Revenue' ELSE 'Administration' END AS approval_dept,
           CASE WHEN o_custkey % 3 = 0 THEN 'Hilly' ELSE 'Plain' END AS terrain_type,
           CASE WHEN o_custkey % 2 = 0 THEN 'Urban' ELSE 'Rural' END AS urban_rural,
           CASE WHEN o_custkey % 4 <> 0 THEN CAST(200 + (o_custkey * 31) % 2500 AS INT) END AS first_delay_day,
           CAST(o_orderkey % 2 AS INT) AS is_censored
    FROM {orders}
  ) a
) b
"""

# The same panel with missing values: which of them, by snapshot number.
GAPS = {"approval_dept": 97, "docs_complete_pct": 50, "file_pending_days": 15}
WITH_GAPS_SQL = "SELECT * REPLACE ({}) FROM snapshots".format(", ".join(
    f"CASE WHEN CAST(substring(snapshot_id, 2) AS BIGINT) % {n} <> 0 THEN {c} END AS {c}" for c, n in GAPS.items()
))


OUTCOMES = """
SELECT 'P' || CAST(c_custkey AS STRING) AS project_id,
       CASE c_custkey % 5 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'ADMINISTRATIVE_BOTTLENECK' WHEN 2 THEN 'LEGAL_DELAY'
            WHEN 3 THEN 'DOCUMENTATION_DELAY' ELSE 'RNR_DELAY' END AS scenario,
       CASE WHEN c_custkey % 4 <> 0 OR c_custkey % 44 = 0 THEN 1 ELSE 0 END AS delayed,
       CASE WHEN c_custkey % 4 <> 0 THEN CAST(200 + (c_custkey * 31) % 2500 AS INT) END AS first_delay_day
FROM {customer}
"""

PROJECTS = """
SELECT 'P' || CAST(c.c_custkey AS STRING) AS project_id, c.c_name AS project_name,
       CASE c.c_custkey % 3 WHEN 0 THEN 'Highway' WHEN 1 THEN 'Railway' ELSE '' END AS project_type,
       CASE WHEN c.c_custkey % 41 = 0 THEN NULL ELSE c.c_mktsegment END AS implementing_agency,
       CASE WHEN c.c_custkey % 53 = 0 THEN '' ELSE n.n_name END AS state,
       'D' || CAST(c.c_custkey % 40 AS STRING) AS district,
       DATE '1994-01-01' + CAST((c.c_custkey * 37) % 365 AS INT) AS date_initiation
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

PREDICTIONS = """
SELECT o_orderkey AS id, 'delay_next_' || CAST(30 * (1 + o_orderkey % 3) AS STRING) || 'd' AS target,
       CASE WHEN o_custkey % 2 = 0 THEN 'validation' ELSE 'test' END AS split,
       CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END AS y_true,
       CAST((o_orderkey * 7919) % 700 + CASE o_orderstatus WHEN 'P' THEN 300 ELSE 0 END AS DOUBLE) / 1000e0 AS predicted_probability
FROM {orders}
"""

CTES = {
    "notifications": NOTIFICATIONS, "event_notifications": EVENT_NOTIFICATIONS, "sanctions": SANCTIONS, "manifest": MANIFEST,
    "surveys": SURVEYS, "parties": PARTIES, "snapshots": SNAPSHOTS, "outcomes": OUTCOMES, "projects": PROJECTS,
    "predictions": PREDICTIONS,
}
JOINED = ("surveys", "parties")  # line items meet their orders in tasks of bounded size, whatever the tables compress to


def _spark(template: str) -> str:
    return re.sub(r"DAYS\(([^,]+), ([^)]+)\)", r"datediff(\2, \1)", template)


def _check(template: str) -> str:
    text = re.sub(r"DAYS\(([^,]+), ([^)]+)\)", r"CAST(date_diff('day', \1, \2) AS INTEGER)", template)
    return re.sub(r"\{(\w+)\}", r"main.\1", text)


def derived(t: Tables, name: str) -> DataFrame:
    if name in JOINED:
        return t.spark.sql(_spark(CTES[name]), lineitem=skew.bounded(t.lineitem, ["l_orderkey"]), orders=t.orders)
    return t.sql(_spark(CTES[name]))


def snapshots_with_gaps(t: Tables) -> DataFrame:
    number = F.substring("snapshot_id", 2, 20).cast("bigint")
    return derived(t, "snapshots").withColumns({c: F.when(number % n != 0, F.col(c)) for c, n in GAPS.items()})


def with_tables(*names: str, **more: str) -> str:
    """A WITH clause holding the named derived tables and further ones given as SQL."""
    parts = [f"{n} AS ({_check(CTES[n])})" for n in names] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"


# --- scoring used by the serving queries: an integer scorecard per horizon, then a sigmoid calibrator ---------

SCORE_DIVISOR = {"30d": 700.0, "60d": 500.0, "90d": 400.0}
CALIBRATORS = {"30d": (1.5, -0.2), "60d": (1.8, 0.1), "90d": (2.0, 0.5)}
POINTS = {
    "pending_approvals_count": 4.0, "file_pending_days": 1.0, "docs_remaining_pct": 1.0, "court_cases_count": 3.0,
    "grievances_30d": 2.0, "rnr_remaining_pct": 1.0,
}


def scorer(records: DataFrame) -> DataFrame:
    ready = risk.derive_missing(records)
    points = sum((F.col(c) * w for c, w in POINTS.items()), F.lit(0.0))
    return risk.score_horizons(ready, {h: points / d for h, d in SCORE_DIVISOR.items()}, CALIBRATORS)


def scored_latest(t: Tables) -> DataFrame:
    """Newest snapshot of every project, reduced before it is enriched and scored."""
    latest = risk.latest_snapshots(derived(t, "snapshots"))
    return risk.risk_summary(scorer(risk.enrich(latest, derived(t, "projects"), one_per_project=True)))


_POINTS_SQL = ("(4 * pending_approvals_count + file_pending_days + (100 - docs_complete_pct) + 3 * court_cases_count"
               " + 2 * grievances_30d + (100 - rnr_progress_pct))")


def probability_sql(horizon: str, points: str = _POINTS_SQL) -> str:
    slope, intercept = CALIBRATORS[horizon]
    p = f"LEAST(GREATEST({points} / {SCORE_DIVISOR[horizon]}e0, 1e-6), 1 - 1e-6)"
    return f"(1e0 / (1e0 + exp(-({slope}e0 * ln({p} / (1 - {p})) + ({intercept}e0)))))"


def band_sql(p: str) -> str:
    return f"CASE WHEN {p} < 0.2e0 THEN 'LOW' WHEN {p} < 0.4e0 THEN 'MODERATE' WHEN {p} < 0.7e0 THEN 'HIGH' ELSE 'CRITICAL' END"


LATEST_SQL = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY snapshot_date DESC, snapshot_id DESC) AS rn FROM snapshots)
WHERE rn = 1
"""
SCORED_SQL = f"""
SELECT *, {band_sql('p90')} AS risk_band, round_even(p90 * 100, 1) AS risk_90d, round_even(p60 * 100, 1) AS risk_60d,
       round_even(p30 * 100, 1) AS risk_30d, CAST(round_even(p90 * 100, 0) AS INTEGER) AS risk_score,
       CASE WHEN p90 - p30 >= 0.2e0 THEN 'RISING' WHEN p90 - p30 <= -0.2e0 THEN 'FALLING' ELSE 'STABLE' END AS trend
FROM (SELECT l.*, p.* EXCLUDE (project_id), {probability_sql('30d')} AS p30, {probability_sql('60d')} AS p60,
             {probability_sql('90d')} AS p90
      FROM latest l LEFT JOIN projects p ON l.project_id = p.project_id)
"""


def with_scored(**more: str) -> str:
    return with_tables("snapshots", "projects", latest=LATEST_SQL, scored=SCORED_SQL, **more)


# --- registry pages: cells rendered from the tables, for the extraction queries ------------------------------


def devanagari(number: Column) -> Column:
    return F.translate(number.cast("string"), LATIN_DIGITS, DEVANAGARI_DIGITS)


def _cell(text: Column | str, href: Column | str | None = None, caption: Column | str | None = None) -> Column:
    as_text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    return F.struct(as_text(text).alias("cell_text"), as_text(href).alias("href"), as_text(caption).alias("link_text"))


def _row(df: DataFrame, page: str, table: int | Column, row: int | Column, *cells: Column) -> DataFrame:
    as_column = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return df.select(F.col(page).alias("page_id"), as_column(table, "int").alias("table_idx"), as_column(row, "bigint").alias("row_idx"),
                     F.posexplode(F.array(*cells)).alias("cell_idx", "c")).select("page_id", "table_idx", "row_idx", "cell_idx", "c.*")


def _stack(*parts: DataFrame) -> DataFrame:
    first = parts[0]
    for part in parts[1:]:
        first = first.unionByName(part)
    return first


def gazette_text(k: Column) -> Column:
    """A notification number as printed: once per language in two of three cases."""
    return F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("  "), devanagari(k))).when(
        k % 3 == 1, F.concat(k.cast("string"), F.lit("(E)"))).otherwise(
        F.concat(F.lit("S.O. "), k.cast("string"), F.lit(" (E) S.O. "), devanagari(k), F.lit(" (E)")))


def report_cells(t: Tables) -> DataFrame:
    """Project pages: details, sanctions, the three notification tables (every row twice) and consent purchases."""
    people, orders = derived(t, "manifest"), t.orders
    area = lambda c: F.concat(F.col(c).cast("int").cast("string"), F.lit("  (ha)"))
    details = _stack(
        _row(people, "project_id", 0, 0, _cell("Project Name"), _cell(F.col("project_name")), _cell("Project Number"), _cell(F.col("project_number"))),
        _row(people, "project_id", 0, 1, _cell("Land Required"), _cell(area("land_required_ha")), _cell("Land Available"), _cell(area("land_available_ha"))),
        _row(people, "project_id", 0, 2, _cell("Land to be acquired"), _cell(area("land_to_acquire_ha")), _cell("Land Acquired till now")),
        _row(people, "project_id", 0, 3, _cell(area("land_acquired_ha"))),
    )
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    money = F.format_number("o_totalprice", 2)
    sanctions = _stack(
        _row(people, "project_id", 1, 0, _cell("Project Sanction Details")),
        _row(people, "project_id", 1, 1, _cell("Sanction Number"), _cell("Sanction Date"), _cell("Sanction Amount (Rs.)"), _cell("Total (Rs.)")),
        _row(orders, "o_custkey", 1, k + 2, _cell(F.concat(F.lit(" SN-"), k.cast("string"))), _cell(day), _cell(money)),
        _row(people, "project_id", 1, F.lit(9_000_000_000_000), _cell("Total"), _cell(""), _cell("1")),
    )
    table = F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "F", 3).otherwise(4)
    link = F.when(k % 2 == 0, F.concat(F.lit("javascript:openWin('ndet.cshtml?project_id=1&notification_id="), k.cast("string"), F.lit("&nid=9')"))).otherwise(
        F.concat(F.lit("ndet.cshtml?notification_id="), k.cast("string"), F.lit("')")))
    late = k % 7 == 0
    details_link = _cell("", F.when(~late, link), F.when(~late, F.lit("View  Details")).otherwise("none"))
    objections = _cell("", F.when(late, link), F.when(late, F.lit("View Objections")).otherwise("none"))
    head = [_cell(k), _cell(day), _cell(gazette_text(k))]
    status = _cell(F.col("o_orderpriority"))
    notices = []
    for copy in (0, 1):
        at = k * 2 + 2 + copy
        notices += [
            _row(orders.filter("o_orderstatus <> 'F'"), "o_custkey", table, at, *head, F.when(late, objections).otherwise(details_link), status),
            _row(orders.filter("o_orderstatus = 'F'"), "o_custkey", table, at, *head, details_link, objections, status),
        ]
    headers = [
        part for n in (2, 3, 4) for part in (
            _row(people, "project_id", n, 0, _cell("Notification Details")),
            _row(people, "project_id", n, 1, _cell("Sno"), _cell("Publish Date"), _cell("Notification Number"), _cell("Details"), _cell("Status")),
        )
    ]
    consent = _row(orders.filter("o_orderstatus = 'P'"), "o_custkey", 5, k + 2, *[
        _cell(F.concat(F.lit(f"c{i}-"), k.cast("string"))) for i in range(7)], _cell(F.col("o_orderpriority")))
    return durable(_stack(details, sanctions, *notices, *headers, consent))


def notice_cells(t: Tables) -> DataFrame:
    """3a notice pages, one per order: metadata rows, and village rows from its line items."""
    orders, k = t.orders, F.col("o_orderkey")
    meta = _stack(
        _row(orders, "o_orderkey", 0, 0, _cell("Tentative Publish Date"), _cell(F.date_format("o_orderdate", "dd/MM/yyyy"))),
        _row(orders, "o_orderkey", 0, 1, _cell("File Number"), _cell(F.concat(F.lit("F/"), k.cast("string")))),
        _row(orders, "o_orderkey", 0, 2, _cell(F.concat(F.lit("CALA Office "), (k % 40).cast("string"), F.lit(" काला कार्यालय")))),
    )
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    village = F.concat(F.lit("Village "), (part % 5).cast("string"))
    action = F.element_at(F.array(*[F.lit(a) for a in ("Added", "deleted", "MODIFIED", "Unknown")]), (n % 4 + 1).cast("int"))
    villages = _row(lines, "l_orderkey", 1, n.cast("bigint") * 1_000_000_000 + part, _cell(F.when(n % 2 == 0, F.lower(village)).otherwise(village)), _cell(action))
    header = _row(orders, "o_orderkey", 1, 0, _cell("Villages"), _cell("Action"))
    return durable(_stack(meta, header, villages))


def notice_pages(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit('Portal  Details 3a  Notification for "GN-'), k, F.lit('" Tentative Publish Date'))
    return t.orders.select(F.col("o_orderkey").alias("page_id"), text.alias("page_text"))


def survey_pages(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("Details of Survey Numbers for “GN "), k, F.lit("” Tentative Publish  Date "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    plain = F.concat(F.lit("No survey for GN "), k)
    return t.orders.select(F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderkey") % 5 == 0, plain).otherwise(text).alias("page_text"))


def survey_cells(t: Tables) -> DataFrame:
    """3D survey pages, one per order with line items: a parcel row per line number, each followed by its parties.

    Pages of even and odd orders arrange their columns differently.
    """
    lines = t.lineitem
    parcels = durable(lines.groupBy("l_orderkey", "l_linenumber").agg(  # read by five parts below
        F.sum("l_quantity").alias("area"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_returnflag").alias("flag")))
    n, even = F.col("l_linenumber"), F.col("l_orderkey") % 2 == 0
    values = {
        "serial": n.cast("string"), "district": F.concat(F.lit("D"), (F.col("supp") % 7).cast("string")),
        "sub": F.concat(F.lit("SD"), (F.col("supp") % 23).cast("string")), "village": F.concat(F.lit("V"), (F.col("part") % 97).cast("string")),
        "survey": F.concat(F.col("part").cast("string"), F.lit("/2  "), devanagari(F.col("part"))),
        "area": F.concat(F.col("area").cast("int").cast("string"), F.lit(" Hectares")),
        "description": F.concat(F.lit('Land Type : "Wet" Land Nature: "'), F.col("flag"), F.lit('" land category:"Rural"')),
    }
    layouts = {
        True: ["serial", "district", "sub", "village", "survey", "area", "description"],
        False: ["description", "serial", "village", "district", "survey", "area"],
    }
    names = {
        True: ["S.No", "District", "Sub District", "Village", "Survey Number", "Area", "Description"],
        False: ["Land Description", "S No", "Village :", "District", "Survey No.", "AREA:"],
    }
    pages = parcels.select("l_orderkey").distinct()
    outer = []
    for side in (True, False):
        own = even if side else ~even
        outer.append(_row(pages.filter(own), "l_orderkey", 1, 0, *[_cell(x) for x in names[side]]))
        outer.append(_row(parcels.filter(own), "l_orderkey", 1, n * 2 - 1, *[_cell(values[x]) for x in layouts[side]]))
    outer.append(_row(parcels, "l_orderkey", 1, n * 2, _cell("Land Parties")))
    nothing = {"nested_row_idx": F.lit(None).cast("bigint"), "nested_cell_idx": F.lit(None).cast("int")}
    kinds = F.when(F.col("l_returnflag") == "R", "Owner").when(F.col("l_returnflag") == "A", "affected party").otherwise("Tenant")
    number = F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")
    people = lines.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (number + 1).alias("at")).agg(F.min(kinds).alias("kind"))
    missing = F.col("l_partkey") % 11 == 0
    party = [F.concat(F.lit("Owner "), F.col("l_partkey").cast("string")), F.lit(""), F.col("kind"),
             F.when(missing, "Hectares").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" Hectares")))]

    def nested(df: DataFrame, at: Column, cells: list[Column]) -> DataFrame:
        return df.select(F.col("l_orderkey").alias("page_id"), F.lit(1).alias("table_idx"), (n * 2).cast("bigint").alias("row_idx"), at.cast("bigint").alias("nested_row_idx"),
                         F.posexplode(F.array(*cells)).alias("nested_cell_idx", "cell_text")).withColumns({
                             "cell_idx": F.lit(None).cast("int"), "href": F.lit(None).cast("string"), "link_text": F.lit(None).cast("string")})

    heads = nested(parcels, F.lit(0), [F.lit(x) for x in ("Name", "Address", "Type", "Area")])
    return durable(_stack(_stack(*outer).withColumns(nothing), heads, nested(people, F.col("at"), party)))
