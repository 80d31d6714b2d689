"""Ratings (E) and users (G, F12)."""

import datetime as dt
from decimal import Decimal

from marketgrid.operators import ratings as R
from marketgrid.operators import users as U


def test_intake_and_sync(spark, seed):
    t = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame([(1, "u2", "u4", "5", t), (2, "u3", "u4", "abc", t), (3, "u2", "u4", "0", t),
                                 (4, "u3", "u4", "6", t), (5, "u3", "u4", " 3 ", t)],
                                "id long, customer_id string, vendor_id string, score_text string, created_at timestamp_ntz")
    intake = R.rating_intake(req)
    assert {r.id: (r.score, r.accepted) for r in intake.collect()} == \
        {1: (5, True), 2: (0, False), 3: (0, False), 4: (6, False), 5: (3, True)}
    empty = spark.createDataFrame([], "id long, customer_id string, vendor_id string, score int, created_at timestamp_ntz")
    ratings = R.append_ratings(empty, intake)
    v = {r.vendor_id: r.rating for r in R.vendor_rating_sync(seed["vendor"], ratings,
                                                               intake.filter("accepted")).collect()}
    assert v == {"u4": Decimal("4.00"), "u5": Decimal("4.50")}


def test_latest_rating_tie_break(spark):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([(1, "u2", "u4", 3, t), (2, "u2", "u4", 5, t), (3, "u2", "u5", 1, t)],
                              "id long, customer_id string, vendor_id string, score int, created_at timestamp_ntz")
    got = {(x.customer_id, x.vendor_id): (x.id, x.score) for x in R.latest_ratings(r).collect()}
    assert got == {("u2", "u4"): (2, 5), ("u2", "u5"): (3, 1)}


def test_roles(spark, seed):
    got = {r.user_id: (r.is_customer, r.is_vendor, r.is_admin, r.is_backend) for r in U.user_roles(seed["users"]).collect()}
    assert got["u1"] == (False, False, True, True) and got["u4"] == (False, True, False, True)
    grants = spark.createDataFrame([("u2", 2), ("u2", 4), ("u4", 2)], "user_id string, bits int")
    got = {r.user_id: r.role_bits for r in U.user_role_add(seed["users"], grants).collect()}
    assert got["u2"] == 7 and got["u4"] == 2 and got["u3"] == 1
