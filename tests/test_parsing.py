from pyspark.sql import functions as F

from nimbora.functions.parsing import day, decimal_comma, rain_amount, wind_sector
from nimbora.functions.scoring import severity


def values(spark, function, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in found]


def test_decimal_comma(spark):
    texts = ["12,0", "-3,5", "1.013,2", "", "0", None, "12.5", "x", "1f", "2d", "inf", "1,2,3"]
    expected = [12.0, -3.5, 1013.2, 0.0, 0.0, None, 125.0, None, None, None, None, None]
    assert values(spark, decimal_comma, texts) == expected


def test_rain_codes_are_exact(spark):
    texts = ["Ip", "Acum", "ip", "0,7", "", None]
    assert values(spark, rain_amount, texts) == [0.05, 0.0, None, 0.7, 0.0, None]


def test_wind_sectors(spark):
    texts = ["35", "99", "88", None, "36", "0", "9", "-1", "4", "5", "", "x", "40", "NaN"]
    expected = [7, None, None, None, 0, 0, 2, 0, 0, 1, None, None, 0, None]
    assert values(spark, wind_sector, texts) == expected


def test_days_are_iso(spark):
    found = values(spark, day, ["2024-02-29", "2023-02-29", "2024-1-5", "x"])
    assert [str(d) if d else None for d in found] == ["2024-02-29", None, None, None]


def test_severity_edges(spark):
    edges = [1.99, 2.0, 5.0, 5.01, 10.0, 10.1, 49.9, 50.0, None]
    rows = spark.createDataFrame(list(enumerate(edges)), "i int, mm double")
    levels = [r.v for r in rows.select("i", severity(F.col("mm")).alias("v")).orderBy("i").collect()]
    assert levels == [0, 1, 1, 2, 2, 3, 3, 4, 4]
