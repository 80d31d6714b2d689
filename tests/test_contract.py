"""The declared columns (A1) and the database's columns under the operators."""

import datetime
from decimal import Decimal

import pytest

from marketgrid.plans import registry
from marketgrid.plans import all_queries
from marketgrid.sources.contract import CONTRACT, schema_report, table_report
from marketgrid.sources.jdbc import SHOP_TABLES, shop_views, typed
from marketgrid.sources.tables import Shop

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database(spark):
    """Empty frames with MySQL's column names, all of them text as a driver may give them."""
    return {t: spark.createDataFrame([], ", ".join(f"`{c}` string" for c in cols)) for t, (_, _, cols) in SHOP_TABLES.items()}


def test_report_of_a_table(spark):
    rows = [("p1", 7, 1), ("p2", None, 4), (None, 3_000_000_000, 0), ("p" * 51, 2, None)]
    df = spark.createDataFrame(rows, "product_id string, tag_id bigint, position int")
    got = {r.column_name: tuple(r)[2:] for r in table_report(df, "shop_tagging").collect()}
    assert got == {"product_id": ("text", "text", 4, 1, 1), "tag_id": ("integer", "integer", 4, 1, 1),
                   "position": ("integer", "integer", 4, 0, 2)}


def test_report_of_missing_and_wrong_columns(spark):
    df = spark.createDataFrame([("v1", "Closed", 1.5)], "vendor_id string, status string, rating double")
    got = {r.column_name: tuple(r)[2:] for r in table_report(df, "shop_vendor").collect()}
    assert got["status"] == ("text", "text", 1, 0, 1) and got["rating"] == ("decimal", "other", 1, None, None)
    assert got["location"] == ("text", "missing", 1, None, None) and list(got) == list(CONTRACT["shop_vendor"])
    assert all(r.n_rows == 0 for r in table_report(df.limit(0), "shop_vendor").collect())


def test_database_meets_the_contract(database):
    views = shop_views({t: typed(df, t) for t, df in database.items()})
    rows = schema_report(views.__getitem__).collect()
    assert len(rows) == sum(map(len, CONTRACT.values()))
    assert all(r.found == r.expected and (r.n_rows, r.n_null, r.n_out_of_range) == (0, 0, 0) for r in rows)


def test_values_of_the_database(spark, database):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    filled = dict(database)
    filled["Vendor"] = spark.createDataFrame([("u4", "Store", None, "Active", "4.80", when)],
                                             "Vendor_ID string, Store_Name string, Location string, Status string, Rating string, Created_At timestamp")
    filled["Customer"] = spark.createDataFrame([("u2", "n", "a", "[]")], "User_ID string, Nick_name string, Address string, Order_History string")
    filled["UserAccount"] = spark.createDataFrame([("u2", "c", "13", 1)], "User_ID string, Username string, Phone_Number string, Role_Bits int")
    views = shop_views({t: typed(df, t) for t, df in filled.items()})
    vendor = views["shop_vendor"].first()
    assert vendor.created_seq == 1704164645000000 and vendor.rating == Decimal("4.80")
    assert views["shop_customer_profile"].first().phone_number == "13"
    assert views["shop_customer_history"].first().order_history == "[]"


# Keys whose plans read the shop's own tables, alone or with requests; the others write or stage state.
KEYS = sorted(k for k in all_queries() if k.split("_")[0] in (
    "public", "search", "product", "products", "tags", "popular", "categories", "all", "customer", "vendor", "vendors", "low",
    "recent", "available", "order", "user", "latest", "browse", "checkout", "split", "ownership"))


def test_database_columns_fit_the_operators(spark, database, monkeypatch):
    """Every such query is analysed over the database's columns."""
    shop = Shop(spark, SF, staged=False)
    shop._frames.update(shop_views({t: typed(df, t) for t, df in database.items()}))
    monkeypatch.setattr(registry, "load_shop", lambda *_: shop)
    failed = {}
    for key in KEYS:
        try:
            assert all_queries()[key](spark, SF).columns
        except Exception as e:  # noqa: BLE001
            failed[key] = str(e)[:300]
    assert not failed, failed
