"""A2: integrity audit of the shop tables.

The schema's keys, uniques, NOT NULLs, foreign keys, ENUM domains and the
tag-position rules become one row each: (rule, table_name, violations).
The rule list is data; the same list renders the DuckDB oracle text.

Violation counts: primary keys count key values that occur more than once plus
rows with a NULL in the key; unique rules count values that occur more than
once; NOT NULL / ENUM / CHECK count offending rows; FK rules count child rows
whose key is missing in the parent; 'max_tags' counts products with more than
three tags.

One grouped pass: every table is scanned once and hands out (domain, key,
part) entries, a domain being a key that several rules ask about: product_id is
the primary key of product and a child of it in tagging and order_items.  One
aggregate counts each part of a (domain, key), with map-side sums, so a hot key
is a few counters a task; parents and children then stand in one row, which
answers the key, the foreign keys and the tag limit at once, without a join.
Row rules hand out an entry under a domain of their own for offending rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The schema's rules (table, columns, parent or domain).
RULES: list[tuple] = [
    ("pk", "user_account", ["user_id"]),
    ("pk", "admins", ["admin_id"]),
    ("pk", "vendor", ["vendor_id"]),
    ("pk", "customer", ["user_id"]),
    ("pk", "rating", ["id"]),
    ("pk", "product", ["product_id"]),
    ("pk", "tag", ["tag_id"]),
    ("pk", "tagging", ["product_id", "tag_id"]),
    ("pk", "orders", ["order_id"]),
    ("pk", "sub_orders", ["sub_order_id"]),
    ("pk", "order_items", ["order_item_id"]),
    ("unique_ci", "user_account", ["username"]),
    ("unique_ci", "tag", ["name"]),
    ("unique_ci", "category", ["name"]),
    ("unique", "tagging", ["product_id", "position"]),
    ("not_null", "product", ["name", "price", "stock", "vendor_id"]),
    ("not_null", "vendor", ["store_name"]),
    ("not_null", "user_account", ["username"]),
    ("not_null", "tag", ["name"]),
    ("not_null", "category", ["name"]),
    ("not_null", "orders", ["customer_id", "order_date", "total_amount", "status", "payment_status"]),
    ("not_null", "sub_orders", ["order_id", "merchant_id", "sub_total_amount", "status", "shipping_status"]),
    ("not_null", "order_items", ["sub_order_id", "product_id", "quantity", "price_per_unit", "total_price", "item_status"]),
    ("fk", "admins", ["admin_id"], "user_account", ["user_id"]),
    ("fk", "vendor", ["vendor_id"], "user_account", ["user_id"]),
    ("fk", "customer", ["user_id"], "user_account", ["user_id"]),
    ("fk", "product", ["vendor_id"], "vendor", ["vendor_id"]),
    ("fk", "tagging", ["product_id"], "product", ["product_id"]),
    ("fk", "tagging", ["tag_id"], "tag", ["tag_id"]),
    ("fk", "orders", ["customer_id"], "customer", ["user_id"]),
    ("fk", "sub_orders", ["order_id"], "orders", ["order_id"]),
    ("fk", "sub_orders", ["merchant_id"], "vendor", ["vendor_id"]),
    ("fk", "order_items", ["sub_order_id"], "sub_orders", ["sub_order_id"]),
    ("fk", "order_items", ["product_id"], "product", ["product_id"]),
    ("enum", "product", ["status"], ["Active", "Inactive", "OutOfStock"]),
    ("enum", "vendor", ["status"], ["Active", "Inactive"]),
    ("enum", "orders", ["status"], ["pending", "shipped", "cancelled", "completed"]),
    ("enum", "sub_orders", ["status"], ["pending", "shipped", "cancelled", "delivered"]),
    ("enum", "sub_orders", ["shipping_status"], ["pending", "shipped", "delivered"]),
    ("enum", "order_items", ["item_status"], ["active", "removed"]),
    ("check_position", "tagging", ["position"]),
    ("max_tags", "tagging", ["product_id"]),
]

# Shop table name -> view name in the registry.
VIEW_OF = {"product": "shop_product", "vendor": "shop_vendor", "user_account": "shop_user", "tag": "shop_tag",
           "tagging": "shop_tagging", "category": "shop_category", "customer": "shop_customer_profile",
           "admins": "shop_admin", "rating": "shop_rating", "orders": "shop_order_state",
           "sub_orders": "shop_sub_orders", "order_items": "shop_order_items"}


def rule_name(r: tuple) -> str:
    return f"{r[0]}:{','.join(r[2])}" + (f"->{r[3]}" if r[0] == "fk" else "")


ROW_RULES = ("not_null", "enum", "check_position")


def _row_predicate(r: tuple) -> Column:
    """Offending-row predicate of a row-level rule."""
    kind, cols = r[0], r[2]
    if kind == "not_null":
        return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    if kind == "enum":
        return F.col(cols[0]).isNotNull() & ~F.col(cols[0]).isin(*r[3])
    return ~F.col(cols[0]).between(1, 3)


def _key(r: tuple) -> Column:
    """The key columns as one text that tells them apart; NULL if one of them is."""
    cols = [F.lower(c) if r[0] == "unique_ci" else F.col(c).cast("string") for c in r[2]]
    if len(cols) == 1:
        return cols[0]
    sized = [x for c in cols for x in (F.length(c).cast("string"), F.lit(":"), c)]
    return F.concat(*sized)


def _domains(rules: list[tuple]) -> list[tuple[int, int]]:
    """(domain, part) each rule reads: a key's own rules share one domain, its children are further parts."""
    numbers: dict[tuple, int] = {}
    parts: dict[tuple, dict] = {}
    out = []
    for i, r in enumerate(rules):
        if r[0] in ROW_RULES:
            name, part = ("row", i), "self"
        elif r[0] == "fk":
            name, part = ("key", r[3], tuple(r[4])), (r[1], tuple(r[2]))
        elif r[0] == "max_tags":
            name, part = ("key", "product", ("product_id",)), (r[1], tuple(r[2]))
        else:
            name, part = ("key" if r[0] == "pk" else r[0], r[1], tuple(r[2])), "self"
        number = numbers.setdefault(name, len(numbers))
        seen = parts.setdefault(name, {"self": 0})
        out.append((number, seen.setdefault(part, len(seen))))
    return out


def integrity_audit(tables: dict[str, DataFrame], rules: list[tuple] = RULES) -> DataFrame:
    """One row per rule (rule, table_name, violations), from one grouped pass over all tables."""
    places = _domains(rules)
    width = 1 + max(part for _, part in places)
    by_table: dict[str, dict] = {}
    for r, (domain, part) in zip(rules, places):
        if r[0] in ROW_RULES:
            entry = F.when(_row_predicate(r), F.struct(F.lit(domain).alias("domain"), F.lit("").alias("key"), F.lit(part).alias("part")))
        else:
            entry = F.struct(F.lit(domain).alias("domain"), _key(r).alias("key"), F.lit(part).alias("part"))
        by_table.setdefault(r[1], {}).setdefault((domain, part), entry)  # max_tags counts the entries of its foreign key
    entries = [tables[t].select(F.explode(F.array_compact(F.array(*found.values()))).alias("x")).select("x.*")
               for t, found in by_table.items()]
    counts = [F.count(F.when(F.col("part") == k, 1)).alias(f"n{k}") for k in range(width)]
    keys = reduce(lambda a, b: a.unionByName(b), entries).groupBy("domain", "key").agg(*counts)

    known, one = F.col("key").isNotNull(), F.lit(1)
    sums = []
    for i, (r, (domain, part)) in enumerate(zip(rules, places)):
        n = F.col(f"n{part}")
        found = {"pk": F.when(known, (n > 1).cast("bigint")).otherwise(n),
                 "unique": F.when(known & (n > 1), one), "unique_ci": F.when(known & (n > 1), one),
                 "fk": F.when(known & (F.col("n0") == 0), n),
                 "max_tags": F.when(known & (n > 3), one)}.get(r[0], n)
        sums.append(F.coalesce(F.sum(F.when(F.col("domain") == domain, found)), F.lit(0)).cast("bigint").alias(f"r{i}"))
    rows = [F.struct(F.lit(rule_name(r)).alias("rule"), F.lit(r[1]).alias("table_name"), F.col(f"r{i}").alias("violations"))
            for i, r in enumerate(rules)]
    return keys.agg(*sums).select(F.inline(F.array(*rows)))


def _sql_not_null(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def integrity_sql(rules: list[tuple] = RULES) -> str:
    """The same audit as one DuckDB statement over the shop views."""
    out = []
    for r in rules:
        kind, t, cols = r[0], r[1], r[2]
        v = VIEW_OF[t]
        cl = ", ".join(cols)
        if kind == "pk":
            body = (f"SELECT 1 FROM {v} WHERE {_sql_not_null(cols)} GROUP BY {cl} HAVING count(*) > 1 UNION ALL "
                    f"SELECT 1 FROM {v} WHERE NOT ({_sql_not_null(cols)})")
        elif kind == "unique":
            body = f"SELECT {cl} FROM {v} WHERE {_sql_not_null(cols)} GROUP BY {cl} HAVING count(*) > 1"
        elif kind == "unique_ci":
            low = ", ".join(f"lower({c})" for c in cols)
            body = f"SELECT {low} FROM {v} WHERE {_sql_not_null(cols)} GROUP BY {low} HAVING count(*) > 1"
        elif kind == "not_null":
            body = f"SELECT 1 FROM {v} WHERE " + " OR ".join(f"{c} IS NULL" for c in cols)
        elif kind == "fk":
            pv = VIEW_OF[r[3]]
            on = " AND ".join(f"p.{p} = c.{c}" for p, c in zip(r[4], cols))
            body = (f"SELECT 1 FROM {v} c WHERE {' AND '.join(f'c.{c} IS NOT NULL' for c in cols)} "
                    f"AND NOT EXISTS (SELECT 1 FROM {pv} p WHERE {on})")
        elif kind == "enum":
            dom = ", ".join(f"'{x}'" for x in r[3])
            body = f"SELECT 1 FROM {v} WHERE {cols[0]} IS NOT NULL AND {cols[0]} NOT IN ({dom})"
        elif kind == "check_position":
            body = f"SELECT 1 FROM {v} WHERE NOT ({cols[0]} BETWEEN 1 AND 3)"
        elif kind == "max_tags":
            body = f"SELECT {cl} FROM {v} GROUP BY {cl} HAVING count(*) > 3 AND {_sql_not_null(cols)}"
        else:
            raise ValueError(kind)
        out.append(f"SELECT '{rule_name(r)}' rule, '{t}' table_name, count(*) violations FROM ({body}) x")
    return "\nUNION ALL ".join(out)
