"""T queries: text, number and date functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse.functions import numeric as num, text as tx
from landpulse.plans.adapters import derived, devanagari, with_tables
from landpulse.plans.registry import query, r

BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
CLEAN = f"trim(regexp_replace(text, '{BLANKS}', ' ', 'g'))"
NUMBER = r"([-+]?\d+(?:\.\d+)?)"


@query("t01_clean_text", f"SELECT doc_id, md5({CLEAN}) AS digest, length({CLEAN}) AS n FROM documents")
def _(t):
    clean = tx.clean_text(F.col("text"))
    return t.documents.select("doc_id", F.md5(clean.cast("binary")).alias("digest"), F.length(clean).alias("n"))


@query("t02_first_decimal", f"""
SELECT doc_id, {r(f"TRY_CAST(NULLIF(regexp_extract({CLEAN}, '{NUMBER}', 1), '') AS DOUBLE)")} AS number FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.first_decimal(F.col("text")).alias("number"))


@query("t03_parse_amount", "SELECT o_orderkey, o_totalprice AS amount FROM orders")
def _(t):
    printed = F.concat(F.lit("Rs. "), F.format_number("o_totalprice", 2), F.lit(" only"))
    return t.orders.select("o_orderkey", tx.parse_amount(printed).alias("amount"))


@query("t04_portal_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '31/02/2020' WHEN o_orderkey % 10 = 0 THEN ''
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    printed = F.when(k % 9 == 0, F.lit(" 31/02/2020 ")).when(k % 10 == 0, F.lit("  ")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return t.orders.select("o_orderkey", tx.portal_date_to_iso(printed).alias("day"))


@query("t05_normalise_header", """
SELECT p_partkey, lower(replace(p_name, ':', '')) || ' no.' AS header FROM part""")
def _(t):
    printed = F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")), F.lit(" NO. :"))
    return t.part.select("p_partkey", tx.normalise_header(printed).alias("header"))


@query("t06_land_attributes", """
SELECT l_orderkey, l_partkey, l_linestatus AS land_type, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS land_nature,
  'Rural' AS land_category FROM lineitem""")
def _(t):
    nature = F.when(F.col("l_returnflag") != "N", F.concat(F.lit('Land Nature : "'), "l_returnflag", F.lit('"'))).otherwise("")
    text = F.concat(F.lit('land type: "'), "l_linestatus", F.lit('"  '), nature, F.lit(' Land Category:"Rural"'))
    return t.lineitem.select("l_orderkey", "l_partkey", *[
        tx.land_attribute(text, a).alias(f"land_{a.lower()}") for a in ("Type", "Nature", "Category")])


@query("t07_survey_number", "SELECT l_orderkey, l_partkey, CAST(l_partkey AS VARCHAR) || '/2' AS survey_number FROM lineitem")
def _(t):
    printed = F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit("/2  "), devanagari(F.col("l_partkey")))
    return t.lineitem.select("l_orderkey", "l_partkey", tx.survey_number(printed).alias("survey_number"))


@query("t08_query_parameter", """
SELECT page_id, trim(regexp_extract(url, '[?&]page=([^&]+)', 1)) AS page, trim(regexp_extract(url, '[?&]ref=([^&]+)', 1)) AS ref,
  trim(regexp_extract(url, '[?&]utm_source=([^&]+)', 1)) AS utm_source FROM pages""")
def _(t):
    return t.pages.select("page_id", *[tx.query_parameter(F.col("url"), n).alias(n) for n in ("page", "ref", "utm_source")])


@query("t09_unwrap_link", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'http://x/' || o_orderkey ELSE 'det.cshtml?id=' || o_orderkey END AS link FROM orders""")
def _(t):
    k = F.col("o_orderkey").cast("string")
    page = F.concat(F.lit("det.cshtml?id="), k)
    printed = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" javascript:open('"), page, F.lit("',1)"))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(page, F.lit("') "))).otherwise(F.concat(F.lit("http://x/"), k))
    return t.orders.select("o_orderkey", tx.unwrap_link(printed).alias("link"))


@query("t10_gazette_number", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || '' WHEN 1 THEN o_orderkey || '(E)' WHEN 2 THEN 'S.O. ' || o_orderkey || ' (E)'
  WHEN 3 THEN 'NH Part ' || o_orderkey ELSE 'Gazette of ' || o_orderkey END AS number FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    text = k.cast("string")
    twice = F.concat(F.lit("NH Part "), text, F.lit(" nh  part "), text)
    printed = (
        F.when(k % 5 == 0, F.concat(text, F.lit("  "), devanagari(k)))
        .when(k % 5 == 1, F.concat(text, F.lit("(E)")))
        .when(k % 5 == 2, F.concat(F.lit("S.O. "), text, F.lit(" (E) S.O. "), devanagari(k), F.lit(" (E)")))
        .when(k % 5 == 3, twice)
        .otherwise(F.concat(F.lit("Gazette of "), text))
    )
    return t.orders.select("o_orderkey", tx.gazette_number(printed).alias("number"))


@query("t11_english_prefix", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || ' Office' END AS officer FROM customer")
def _(t):
    printed = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_name"), F.lit("  कार्यालय Nagpur"))).otherwise(F.concat(F.col("c_name"), F.lit("  Office")))
    return t.customer.select("c_custkey", tx.english_prefix(printed).alias("officer"))


@query("t12_feature_labels", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Case age' WHEN 1 THEN 'Current stage: 3A' WHEN 2 THEN 'Terrain context' ELSE 'Part Size ' || p_size END AS label,
  CASE p_partkey % 4 WHEN 0 THEN 'Legal' WHEN 2 THEN 'Land Acquisition' ELSE 'Administrative' END AS category FROM part""")
def _(t):
    k = F.col("p_partkey") % 4
    feature = F.when(k == 0, "case_age_months").when(k == 1, "current_stage_3A").when(k == 2, "terrain_type_Hilly").otherwise(
        F.concat(F.lit("part_size_"), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", tx.feature_label(feature).alias("label"), tx.feature_category(feature).alias("category"))


@query("t13_safe_ratios", with_tables("manifest") + f"""
SELECT project_id, {r('CASE WHEN land_to_acquire_ha = 0 THEN 0 ELSE land_acquired_ha / land_to_acquire_ha END')} AS ratio_zero,
  {r('land_acquired_ha / NULLIF(land_to_acquire_ha, 0)')} AS ratio_null, {r('land_acquired_ha / NULLIF(land_to_acquire_ha, 0) * 100')} AS pct_null
FROM manifest""")
def _(t):
    a, b = F.col("land_acquired_ha"), F.col("land_to_acquire_ha")
    return derived(t, "manifest").select("project_id", num.ratio_or_zero(a, b).alias("ratio_zero"), num.ratio_or_null(a, b).alias("ratio_null"),
                                         num.percent_or_null(a, b).alias("pct_null"))


@query("t14_clip", f"SELECT c_custkey, {r('LEAST(GREATEST(c_acctbal, 0), 5000)')} AS bounded, {r('GREATEST(c_acctbal, 100)')} AS floored FROM customer")
def _(t):
    v = F.col("c_acctbal")
    return t.customer.select("c_custkey", num.clip(v, 0.0, 5000.0).alias("bounded"), num.clip(v, 100.0).alias("floored"))


@query("t15_logit_and_sigmoid", with_tables("predictions", c="""
SELECT id, ln(q / (1 - q)) AS z FROM (SELECT id, LEAST(GREATEST(predicted_probability, 1e-6), 1 - 1e-6) AS q FROM predictions)""") + f"""
SELECT id, {r('z')} AS logit, {r('1 / (1 + exp(-z))')} AS sigmoid, {r('1 / (1 + exp(-(0.7e0 * z - 1.2e0)))')} AS calibrated FROM c""")
def _(t):
    z = num.logit(F.col("predicted_probability"))
    return derived(t, "predictions").select("id", z.alias("logit"), num.sigmoid(z).alias("sigmoid"),
                                            num.platt(F.col("predicted_probability"), 0.7, -1.2).alias("calibrated"))


@query("t16_round_half_even", f"""
SELECT o_orderkey, {r('round_even(o_orderkey / 2, 0)')} AS whole, {r('round_even(o_orderkey / 8, 2)')} AS cents FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", num.round_half_even(k / 2).alias("whole"), num.round_half_even(k / 8, 2).alias("cents"))


@query("t17_normalise_record", """
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value, strftime(ts, '%Y-%m-%d') AS ts FROM events""")
def _(t):
    nan = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return num.normalise_record(t.events.select("event_id", nan.alias("value"), "ts"))
