"""A1: the declared columns of the shop tables, and a report of how the tables at hand meet them.

Every declared column is judged by kind (text, integer, decimal, time), by
NULLs where the declaration forbids them and by values outside the declared
range: longer texts, unknown states, numbers that do not fit.  A wider integer
or decimal type is fine as long as its values fit.  One aggregate per table
reads the declared columns once; only one row of counters per task is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT = (-2147483648, 2147483647)
MONEY = ("-99999999.99", "99999999.99")
RATING = ("-9.99", "9.99")

# View -> column -> (kind, NULL forbidden, greatest length or least and greatest value or allowed texts).
CONTRACT: dict[str, dict[str, tuple]] = {
    "shop_user": {"user_id": ("text", True, 50), "username": ("text", True, 50), "phone_number": ("text", False, 32),
                  "role_bits": ("integer", False, INT)},
    "shop_admin": {"admin_id": ("text", True, 50), "display_name": ("text", False, 50)},
    "shop_vendor": {"vendor_id": ("text", True, 50), "store_name": ("text", True, 255), "location": ("text", False, 255),
                    "status": ("text", False, ["Active", "Inactive"]), "rating": ("decimal", False, RATING)},
    "shop_customer_profile": {"user_id": ("text", True, 50), "nick_name": ("text", False, 255), "address": ("text", False, 255)},
    "shop_rating": {"id": ("integer", True, INT), "customer_id": ("text", False, 50), "vendor_id": ("text", False, 50),
                    "score": ("integer", False, INT), "created_at": ("time", False, None)},
    "shop_category": {"name": ("text", True, 100)},
    "shop_product": {"product_id": ("text", True, 50), "name": ("text", True, 255), "description": ("text", False, None),
                     "price": ("decimal", True, MONEY), "stock": ("integer", True, INT), "category": ("text", False, 100),
                     "image_url": ("text", False, 500), "vendor_id": ("text", True, 50),
                     "status": ("text", False, ["Active", "Inactive", "OutOfStock"]), "rating": ("decimal", False, RATING)},
    "shop_tag": {"tag_id": ("integer", True, INT), "name": ("text", True, 100)},
    "shop_tagging": {"product_id": ("text", True, 50), "tag_id": ("integer", True, INT), "position": ("integer", False, (1, 3))},
    "shop_order_state": {"order_id": ("text", True, 36), "customer_id": ("text", True, 50), "order_date": ("time", True, None),
                         "total_amount": ("decimal", True, MONEY), "status": ("text", True, 50), "shipping_address": ("text", True, None),
                         "payment_status": ("text", True, 50)},
    "shop_sub_orders": {"sub_order_id": ("text", True, 36), "order_id": ("text", True, 36), "merchant_id": ("text", True, 50),
                        "sub_total_amount": ("decimal", True, MONEY), "status": ("text", True, 50),
                        "shipping_status": ("text", True, 50), "created_at": ("time", True, None)},
    "shop_order_items": {"order_item_id": ("text", True, 36), "sub_order_id": ("text", True, 36), "product_id": ("text", True, 50),
                         "quantity": ("integer", True, INT), "price_per_unit": ("decimal", True, MONEY),
                         "total_price": ("decimal", True, MONEY), "item_status": ("text", True, 50)},
}

KINDS = {"text": T.StringType, "integer": T.IntegralType, "decimal": T.DecimalType, "time": (T.DateType, T.TimestampType, T.TimestampNTZType)}


def kind_of(data_type: T.DataType) -> str:
    return next((k for k, types in KINDS.items() if isinstance(data_type, types)), "other")


def _outside(column: str, kind: str, rule):
    c = F.col(f"`{column}`")
    if rule is None:
        return F.lit(False)
    if isinstance(rule, int):
        return F.length(c) > rule
    if isinstance(rule, list):
        return ~c.isin(rule)
    low, high = (F.lit(v).cast("decimal(38,2)" if kind == "decimal" else "bigint") for v in rule)
    return (c < low) | (c > high)


def table_report(df: DataFrame, table: str) -> DataFrame:
    """One row per declared column of ``table``: its kinds, rows, forbidden NULLs and values out of range.

    A missing column or one of another kind has no counts of its values.
    """
    columns = CONTRACT[table]
    kinds = {f.name: kind_of(f.dataType) for f in df.schema}
    fit = [c for c, (kind, _, _) in columns.items() if kinds.get(c) == kind]
    counts = [F.count(F.when(_outside(c, columns[c][0], columns[c][2]), 1)).alias(f"out_{c}") for c in fit]
    counts += [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"null_{c}") for c in fit if columns[c][1]]
    one = df.agg(F.count(F.lit(1)).alias("n"), *counts)

    def row(c):
        kind, required, _ = columns[c]
        none = F.lit(None).cast("bigint")
        nulls = none if c not in fit else F.col(f"null_{c}") if required else F.lit(0).cast("bigint")
        return F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("expected"), F.lit(kinds.get(c, "missing")).alias("found"),
                        F.col("n").alias("n_rows"), nulls.alias("n_null"),
                        (F.col(f"out_{c}") if c in fit else none).alias("n_out_of_range"))

    rows = one.select(F.explode(F.array(*[row(c) for c in columns])).alias("r"))
    return rows.select(F.lit(table).alias("table_name"), "r.*")


def schema_report(tables: Callable[[str], DataFrame]) -> DataFrame:
    """The report of every declared table; ``tables`` gives the table of a view name."""
    return reduce(DataFrame.unionByName, [table_report(tables(t), t) for t in CONTRACT])


def _sql_outside(c: str, rule) -> str:
    if rule is None:
        return "FALSE"
    if isinstance(rule, int):
        return f"length({c}) > {rule}"
    if isinstance(rule, list):
        return f"{c} NOT IN ({', '.join(repr(v) for v in rule)})"
    return f"{c} < {rule[0]} OR {c} > {rule[1]}"


def schema_sql(missing: set[tuple[str, str]]) -> str:
    """The report as SQL, for tables that lack the columns in ``missing``."""
    parts = []
    for table, columns in CONTRACT.items():
        for c, (kind, required, rule) in columns.items():
            head = f"SELECT '{table}' table_name, '{c}' column_name, '{kind}' expected"
            if (table, c) in missing:
                parts.append(f"{head}, 'missing' found, count(*) n_rows, CAST(NULL AS BIGINT) n_null, "
                             f"CAST(NULL AS BIGINT) n_out_of_range FROM {table}")
                continue
            parts.append(f"""{head}, CASE WHEN max(typeof({c})) = 'VARCHAR' THEN 'text' WHEN max(typeof({c})) LIKE '%INT%' THEN 'integer'
 WHEN max(typeof({c})) LIKE 'DECIMAL%' THEN 'decimal' WHEN max(typeof({c})) = 'DATE' OR max(typeof({c})) LIKE 'TIMESTAMP%' THEN 'time'
 ELSE 'other' END found, count(*) n_rows, {f'count(*) FILTER (WHERE {c} IS NULL)' if required else 'CAST(0 AS BIGINT)'} n_null,
 count(*) FILTER (WHERE {_sql_outside(c, rule)}) n_out_of_range FROM {table}""")
    return "\nUNION ALL ".join(parts)
