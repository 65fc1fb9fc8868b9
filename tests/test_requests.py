"""The derived requests are whole."""

from pyspark.sql import functions as F

from prefixlake.sources.tables import search_input

SF = "/root/testdata/sf0.001"


def test_every_request_has_a_user(spark):
    rows = search_input(spark, SF, "requests")
    known = F.col("user_id").isNotNull()
    n, users, with_city, with_place, without_time, tails = rows.agg(
        F.count(F.when(~known, 1)), F.countDistinct("user_id"), F.count(F.when(known & F.col("city").isNotNull(), 1)), F.count(F.when(known & F.col("lat").isNotNull(), 1)),
        F.count(F.when(known & F.col("now").isNull(), 1)), F.countDistinct(F.when(known, F.col("cust") % 12)),
    ).first()
    assert n == 0 and users > 15 and with_city and with_place and without_time and tails == 12
