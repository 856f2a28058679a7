import math

import pytest
from pyspark.sql import functions as F

from landpulse.functions import numeric as num, text as tx
from landpulse.operators import risk as rk


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    assert apply(spark, tx.clean_text, ["  a  b\t\n c ", "", None, "\x1cx\x85"]) == ["a b c", "", "", "x"]
    assert apply(spark, tx.collapse_blanks, [" a ", None]) == ["a", None]
    every = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert apply(spark, tx.clean_text, [f"x{c}y {c}z{c} w" for c in every]) == ["x y z w"] * len(every)


def test_number_text(spark):
    values = [0.0, 4.0, 12.5, 100.0, 12.345678, 0.05, 99999.5, 1234567.0, 0.00001]
    assert apply(spark, rk._number_text, values, "double") == [f"{v:g}" for v in values]


def test_numbers(spark):
    assert apply(spark, tx.first_decimal, ["22 (ha)", "-0.5415 ha", "none", "", None, "१२.५ हे", "+7"]) == [22.0, -0.5415, None, None, None, 12.5, 7.0]
    assert apply(spark, tx.parse_amount, ["Rs. 55,74,68,900.50", "1,000", "x"]) == [557468900.5, 1000.0, None]


def test_dates(spark):
    assert apply(spark, tx.portal_date_to_iso, ["17/05/2017", "1/2/2020", "31/02/2020", "soon", None]) == [
        "2017-05-17", "2020-02-01", "31/02/2020", "soon", ""]


def test_headers_and_land(spark):
    assert apply(spark, tx.normalise_header, [" Survey  Number : ", "S.No"]) == ["survey number", "s.no"]
    text = 'Land Type: "Wet" land nature : "Private"'
    assert [apply(spark, lambda c: tx.land_attribute(c, a), [text])[0] for a in ("Type", "Nature", "Category")] == ["Wet", "Private", None]
    assert apply(spark, tx.survey_number, [" 12/3  १२/३ ", ""]) == ["12/3", ""]


def test_links(spark):
    links = ["x.cshtml?a=1&notification_id=50840&n=9", "x?notification_id=", None, "?other=1"]
    assert apply(spark, lambda c: tx.query_parameter(c, "notification_id"), links) == ["50840", "", "", ""]
    hrefs = ["javascript:open('a/b.cshtml?x=1','w')", " a.cshtml?x=1') ", None, "plain"]
    assert apply(spark, tx.unwrap_link, hrefs) == ["a/b.cshtml?x=1", "a.cshtml?x=1", "", "plain"]


def test_gazette_numbers(spark):
    raw = ["1405 १४०५", "3761(E)", "S.O. 5048 (E) S.O. ५०४८ (E)", "s.o. 12 (E) S.O. १२ (e)", "NH 4 nh 4", "a b c", "", None, "x x y y"]
    assert apply(spark, tx.gazette_number, raw) == ["1405", "3761(E)", "S.O. 5048 (E)", "s.o. 12 (E)", "NH 4", "a b c", "", "", "x x y y"]


def test_officer(spark):
    assert apply(spark, tx.english_prefix, ["CALA Nagpur कला अधिकारी", "CALA Pune", "अ"]) == ["CALA Nagpur", "CALA Pune", "अ"]


def test_labels(spark):
    features = ["case_age_months", "current_stage_3A", "urban_rural_Urban", "event_count_so_far"]
    assert apply(spark, tx.feature_label, features) == ["Case age", "Current stage: 3A", "Settlement context", "Event Count So Far"]
    assert apply(spark, tx.feature_category, features) == ["Legal", "Administrative", "Community / Grievance", "Administrative"]


def test_ratios(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = df.select(num.ratio_or_zero(a, b), num.ratio_or_null(a, b), num.percent_or_null(a, b)).collect()
    assert [tuple(r) for r in rows] == [(0.5, 0.5, 50.0), (0.0, None, None), (None, None, None)]


def test_probabilities(spark):
    assert apply(spark, num.sigmoid, [0.0, 800.0, -800.0], "double") == [0.5, 1.0, 0.0]
    values = [0.0, 0.3, 0.5, 1.0]
    for got, p in zip(apply(spark, num.logit, values, "double"), values):
        clipped = min(max(p, 1e-6), 1 - 1e-6)
        assert got == pytest.approx(math.log(clipped / (1 - clipped)), abs=1e-8)
    assert apply(spark, num.logit, [None], "double") == [None]
    assert apply(spark, num.round_half_even, [0.5, 1.5, 2.5], "double") == [0.0, 2.0, 2.0]
    assert apply(spark, lambda c: num.clip(c, 0.0, 1.0), [-1.0, 2.0, None], "double") == [0.0, 1.0, None]
