"""Corner cases of the function library."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import json_text as J
from tidemark.functions import scalar as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_substr(spark):
    h = F.lit("hello")
    assert one(spark, S.substr(h, 2, 3), S.substr(h, -3), S.substr(h, 0, 3), S.substr(h, 3, -2), S.substr(h, -2, -2), S.substr(h, 9), S.substr(F.lit(None).cast("string"), 1)) == ("ell", "llo", "he", "he", "el", "", None)


def test_case_like_and_casts(spark):
    assert one(spark, S.upper(F.lit("aé")), S.lower(F.lit("AÉ"))) == ("Aé", "aÉ")
    assert one(spark, S.like(F.lit("HeLLo"), "h_l%"), S.like(F.lit("É"), "é"), S.like(F.lit("a%b"), "a!%b", "!"), S.like(F.lit("axb"), "a!%b", "!")) == (True, False, True, False)
    assert one(spark, S.cast_integer(F.lit(" 12x")), S.cast_integer(F.lit("x")), S.cast_integer(F.lit(1e30), "double"), S.cast_integer(F.lit(-2.9), "double"), S.number(F.lit("1.5e1z"))) == (12, 0, 2**63 - 1, -2, 15.0)
    assert one(spark, S.truthy(F.lit("0.0x")), S.truthy(F.lit("2b")), S.truthy(F.lit(None).cast("string"))) == (False, True, False)
    assert one(spark, S.compare_numeric_to_text(F.lit(1), F.lit("1")), S.compare_numeric_to_text(F.lit(1), F.lit("1x"))) == (True, False)


def test_arithmetic(spark):
    big = F.lit(2**63 - 1)
    assert one(spark, S.add(big, F.lit(1)), S.divide(F.lit(-7), F.lit(2)), S.divide(F.lit(1), F.lit(0)), S.remainder(F.lit(7.5), F.lit(2.0))) == (float(2**63), -3, None, 1)
    assert one(spark, S.scalar_min(F.lit(1), F.lit(None).cast("int")), S.scalar_max(F.lit(1), F.lit(3)), S.round_(F.lit(2.5)), S.mysql_round(F.lit(2.5))) == (None, 3, 3.0, 2.0)
    assert one(spark, S.unhex(F.lit("ABC")), S.hex_(F.lit(None).cast("string")), S.real_text(F.lit(1e20)), S.real_text(F.lit(2.0))) == (None, "", "1.0e+20", "2.0")


def test_dates(spark):
    t = F.lit
    assert one(spark, D.date(t("2023-02-31")), D.date(t("2023-13-01")), D.date(t("2024-01-31"), "+1 month"), D.date(t("2024-01-31"), "+1 month", "floor"), D.datetime(t("2024-01-01T10:00+02:00"))) == ("2023-03-03", None, "2024-03-02", "2024-02-29", "2024-01-01 08:00:00")
    assert one(spark, D.datetime(t(0), "unixepoch"), D.date(t("2460000.5")), D.time(t("12:34:56.789"), "subsec"), D.strftime("%Q", D.moment(t("2024-01-01")))) == ("1970-01-01 00:00:00", "2023-02-25", "12:34:56.789", None)
    with pytest.raises(NotImplementedError):
        D.date(t("2024-01-01"), "localtime")


def test_dates_read_their_text_once(spark):
    """However many parts a format or modifiers name, the plan reads the text in a fixed number of places."""
    t = F.col("id").cast("string")
    for made in (D.strftime("%Y/%m/%d %H-%M-%S %j %w %u %U %W %V %G %I %p %F %T", D.moment(t)), D.datetime(t, "start of month", "+1 month", "-1 second", "weekday 0")):
        plan = spark.range(1).select(made.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("([0-9]{4})-") == 2, plan.count("([0-9]{4})-")
    texts = ["2023-02-31 01:02:03.5Z", "2024-02-29", " 10:20 ", "2024-01-01T10:20-02:30", "", "Z", "2024-1-1", "1,2", "2024-01-01\n", "24:00", "2460000.5", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string").coalesce(1)
    got = [r.v for r in df.orderBy("k").select(D.strftime("%F %H:%M:%f", D.moment("t")).alias("v")).collect()]
    assert got == ["2023-03-03 01:02:03.500", "2024-02-29 00:00:00.000", "2000-01-01 10:20:00.000", "2024-01-01 12:50:00.000", None, None, None, None, "2024-01-01 00:00:00.000", None, "2023-02-25 00:00:00.000", None]


def test_json(spark):
    from tidemark.session import ship

    ship(spark)
    j = F.lit('{"b": 1.50, "a": [1, {"x": null}, true], "b": 2}')
    assert one(spark, J.json_(j), J.json_extract(j, "$.a[#-1]"), J.json_type(j, "$.a[1].x"), J.json_type(j, "$.b"), J.arrow(j, "$.a")) == ('{"b":1.50,"a":[1,{"x":null},true],"b":2}', "1", "null", "real", '[1,{"x":null},true]')
    a = F.lit('{"a":[1,2]}')
    assert one(spark, J.json_set(a, "$.a[#]", 3), J.json_insert(a, "$.a[0]", 9), J.json_replace(a, "$.z", 9), J.json_remove(a, "$.a[0]"), J.json_set(a, "$.b", '{"k":1}', json_args=(1,))) == ('{"a":[1,2,3]}', '{"a":[1,2]}', '{"a":[1,2]}', '{"a":[2]}', '{"a":[1,2],"b":{"k":1}}')
    assert one(spark, J.json_valid(F.lit("{'a':1}")), J.json_valid(F.lit("NaN")), J.json_array_length(a), J.json_array_length(a, "$.a"), J.json_array_length(a, "$.q")) == (0, 0, 0, 2, None)
    with pytest.raises(ValueError):
        J.json_extract(a, "a.b")
