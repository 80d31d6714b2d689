"""C: vendor dashboards and listings, computed for every vendor in one pass.

Per-vendor figures are conditional aggregates grouped by vendor (map-side
partial aggregation, so a hot vendor is a few counters per task).  Per-vendor
top-k uses ``row_number() <= k``, which Spark turns into a partial
WindowGroupLimit before the shuffle: a vendor holding a third of all products
still sends only k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import date_time, ACTIVE, INACTIVE, ROLE_ADMIN, ROLE_VENDOR, ci_contains, has_role, money, round2
from .catalog import page_cards

TABS = ("all", "active", "inactive", "inventory")


def _tab_filter(tab: str):
    if tab == "active":
        return F.col("status") == ACTIVE
    if tab == "inactive":
        return F.col("status") == INACTIVE
    if tab == "inventory":
        return F.col("status") != INACTIVE
    return F.lit(True)


def vendor_products(product: DataFrame, vendor: DataFrame, tagging: DataFrame, tag: DataFrame,
                    tab: str = "all", page: int = 1, page_size: int = 20,
                    vendor_id: str | None = None) -> DataFrame:
    """One page of each vendor's products, newest first (vendor status not checked)."""
    lo = (max(int(page), 1) - 1) * page_size
    p = product.filter(_tab_filter(tab))
    if vendor_id is not None:
        p = p.filter(F.col("vendor_id") == vendor_id)
    p = p.join(vendor.select("vendor_id", "store_name"), "vendor_id")
    w = Window.partitionBy("vendor_id").orderBy(F.col("created_seq").desc(), F.col("product_id"))
    paged = (p.withColumn("rn", F.row_number().over(w))
             .filter((F.col("rn") <= lo + page_size) & (F.col("rn") > lo)))
    return page_cards(paged.withColumn("rn", F.col("rn").cast("bigint")), tagging, tag, "rn")


def vendor_products_count(product: DataFrame, vendor: DataFrame) -> DataFrame:
    """Product counts of every tab for every vendor, one pass."""
    agg = product.groupBy("vendor_id").agg(
        *[F.count(F.when(_tab_filter(t), 1)).alias(f"{t}_count") for t in TABS])
    return (vendor.select("vendor_id").join(agg, "vendor_id", "left")
            .select("vendor_id", *[F.coalesce(f"{t}_count", F.lit(0)).cast("bigint").alias(f"{t}_count")
                                   for t in TABS]))


def _product_stats(product: DataFrame) -> DataFrame:
    return product.groupBy("vendor_id").agg(
        F.count("*").alias("total_products"),
        F.count(F.when(F.col("status") == ACTIVE, 1)).alias("active_products"),
        F.sum("stock").alias("total_stock"),
        F.count(F.when(F.col("stock") == 0, 1)).alias("out_of_stock"),
        F.count(F.when(F.col("status") == INACTIVE, 1)).alias("inactive_products"))


_STAT_COLS = ["total_products", "active_products", "total_stock", "out_of_stock", "inactive_products"]


def vendor_stats(product: DataFrame, vendor: DataFrame) -> DataFrame:
    """C3 (and C20's template totals): per-vendor product figures, 0 when none."""
    return (vendor.select("vendor_id").join(_product_stats(product), "vendor_id", "left")
            .select("vendor_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _STAT_COLS]))


def vendor_status_breakdown(product: DataFrame, vendor: DataFrame) -> DataFrame:
    """C4: (status, count, percentage) x3 per vendor.

    As coded: 'OutOfStock' counts stock = 0, so the three need not add to 100.
    """
    s = vendor_stats(product, vendor)
    rows = F.array(
        F.struct(F.lit("Active").alias("status"), F.col("active_products").alias("count")),
        F.struct(F.lit("OutOfStock").alias("status"), F.col("out_of_stock").alias("count")),
        F.struct(F.lit("Inactive").alias("status"), F.col("inactive_products").alias("count")))
    return (s.select("vendor_id", "total_products", F.inline(rows))
            .select("vendor_id", "status", "count",
                    F.when(F.col("total_products") > 0,
                           F.col("count") / F.col("total_products") * 100).otherwise(F.lit(0.0))
                    .alias("percentage")))


def low_stock_products(product: DataFrame, limit: int = 5) -> DataFrame:
    """Up to ``limit`` products with 0 < stock < 10 per vendor, by (stock, id)."""
    w = Window.partitionBy("vendor_id").orderBy("stock", "product_id")
    return (product.filter((F.col("stock") > 0) & (F.col("stock") < 10))
            .select("vendor_id", "product_id", "name", "stock")
            .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn"))


def _vendor_row(v: DataFrame) -> DataFrame:
    return v.select("vendor_id", "store_name", "location", "status",
                    money(F.coalesce("rating", F.lit(0))).alias("rating"), "created_seq")


def vendors_list(vendor: DataFrame, status: str | None = None, location: str | None = None,
                 limit: int | None = None, offset: int = 0) -> DataFrame:
    """Vendors newest first, optional status / location substring / paging."""
    v = vendor
    if status is not None:
        v = v.filter(F.col("status") == status)
    if location:
        v = v.filter(ci_contains("location", location))
    v = _vendor_row(v).orderBy(F.col("created_seq").desc(), F.col("vendor_id"))
    if offset:
        v = v.offset(offset)
    if limit is not None:
        v = v.limit(limit)
    return v


def vendor_counts(vendor: DataFrame) -> DataFrame:
    """Vendor count overall ('ALL') and per status, via ROLLUP."""
    return (vendor.rollup("status").agg(F.count("*").alias("vendor_count"), F.grouping("status").alias("g"))
            .select(F.when(F.col("g") == 1, F.lit("ALL")).otherwise(F.col("status")).alias("scope"),
                    "vendor_count"))


def _orders_per_vendor(items: DataFrame, product: DataFrame) -> DataFrame:
    """COUNT(DISTINCT order) per vendor, through the product's vendor.

    Spark plans the distinct count as an aggregate on (vendor, order) pairs
    first, so no vendor's orders gather in one task.
    """
    owner = product.select("product_id", "vendor_id")
    return (items.select("order_id", "product_id").join(owner, "product_id")
            .groupBy("vendor_id").agg(F.countDistinct("order_id").alias("orders_count")))


def vendor_inventory_totals(product: DataFrame, vendor: DataFrame, items: DataFrame) -> DataFrame:
    """Products, active, out-of-stock, total stock and order count per vendor."""
    stats = vendor_stats(product, vendor).select(
        "vendor_id", "total_products", "active_products", "out_of_stock", "total_stock")
    return (stats.join(_orders_per_vendor(items, product), "vendor_id", "left")
            .withColumn("orders_count", F.coalesce("orders_count", F.lit(0)).cast("bigint")))


def vendor_orders_count(product: DataFrame, vendor: DataFrame, items: DataFrame) -> DataFrame:
    """C9."""
    return (vendor.select("vendor_id").join(_orders_per_vendor(items, product), "vendor_id", "left")
            .select("vendor_id", F.coalesce("orders_count", F.lit(0)).cast("bigint").alias("orders_count")))


def vendor_order_lines(product: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct order lines of each vendor's products, newest order first."""
    p = product.select("product_id", "vendor_id", F.col("name").alias("product_name"))
    o = orders.select("order_id", "order_date", "status", "customer_id")
    return (items.select("order_id", "product_id", "quantity", "price_per_unit")
            .join(p, "product_id").join(o, "order_id")
            .select("vendor_id", "order_id", "product_id", "quantity",
                    money("price_per_unit").alias("price"), date_time("order_date").alias("order_date"),
                    "status", "customer_id", "product_name")
            .distinct()
            .orderBy("vendor_id", F.col("order_date").desc(), "order_id", "product_id", "quantity"))


def vendor_sub_orders(sub_orders: DataFrame, items: DataFrame, orders: DataFrame, users: DataFrame,
                      merchant_id: str | None = None) -> DataFrame:
    """C11: sub-orders, newest first, with item count (removed items included) and customer name.

    The correlated COUNT(*) becomes a pre-aggregate joined LEFT, so a
    sub-order without items shows 0.
    """
    so = sub_orders if merchant_id is None else sub_orders.filter(F.col("merchant_id") == merchant_id)
    counts = items.groupBy("sub_order_id").agg(F.count("*").alias("item_count"))
    cust = orders.select("order_id", "customer_id").join(
        users.select(F.col("user_id").alias("customer_id"), F.col("username").alias("customer_name")),
        "customer_id")
    return (so.join(counts, "sub_order_id", "left").join(cust, "order_id")
            .select("sub_order_id", "order_id", "merchant_id", money("sub_total_amount").alias("sub_total_amount"),
                    "status", "shipping_status", date_time("created_at").alias("created_at"),
                    F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"), "customer_name")
            .orderBy("merchant_id", F.col("created_at").desc(), "sub_order_id"))


def vendor_analytics(sub_orders: DataFrame, vendor: DataFrame) -> DataFrame:
    """Sales of non-cancelled sub-orders, sub-order count, averages.

    ``avg_order_value`` divides by ALL sub-orders, cancelled ones included,
    as coded; ``avg_active_order_value`` divides by the non-cancelled ones.
    """
    live = F.col("status") != "cancelled"
    agg = sub_orders.groupBy(F.col("merchant_id").alias("vendor_id")).agg(
        F.sum(F.when(live, F.col("sub_total_amount")).otherwise(F.lit(0))).alias("sales"),
        F.count("*").alias("total_orders"),
        F.count(F.when(live, 1)).alias("active_orders"))
    sales = F.coalesce(F.col("sales").cast("double"), F.lit(0.0))
    n = F.coalesce("total_orders", F.lit(0))
    na = F.coalesce("active_orders", F.lit(0))
    return (vendor.select("vendor_id").join(agg, "vendor_id", "left")
            .select("vendor_id", sales.alias("total_sales"), n.cast("bigint").alias("total_orders"),
                    F.when(n > 0, sales / n).otherwise(F.lit(0.0)).alias("avg_order_value"),
                    F.when(na > 0, sales / na).otherwise(F.lit(0.0)).alias("avg_active_order_value")))


def vendor_top_products(items: DataFrame, sub_orders: DataFrame, product: DataFrame, n: int = 10) -> DataFrame:
    """Best sellers per vendor by revenue of active items in live sub-orders."""
    live = sub_orders.filter(F.col("status") != "cancelled").select("sub_order_id")
    sales = (items.filter(F.col("item_status") == "active").join(live, "sub_order_id", "left_semi")
             .groupBy("merchant_id", "product_id")
             .agg(F.sum("quantity").alias("sales_count"), F.sum("total_price").alias("revenue")))
    w = Window.partitionBy("merchant_id").orderBy(F.col("revenue").desc(), F.col("product_id"))
    top = sales.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return (top.join(product.select("product_id", "name"), "product_id")
            .select(F.col("merchant_id").alias("vendor_id"), "product_id", "name",
                    F.col("sales_count").cast("bigint").alias("sales_count"),
                    money("revenue").alias("total_revenue"), F.col("rank").cast("bigint").alias("rank")))


def vendor_average_rating(rating: DataFrame, vendor: DataFrame) -> DataFrame:
    """C14: mean score to two places (half-up); else stored Vendor.Rating; else 0."""
    avg = rating.groupBy("vendor_id").agg(F.avg("score").alias("avg_score"))
    return (vendor.select("vendor_id", "rating").join(avg, "vendor_id", "left")
            .select("vendor_id", F.coalesce(round2(F.col("avg_score")), money("rating"), F.lit(0.0))
                    .alias("average_rating")))


def vendor_service_stats(product: DataFrame, vendor: DataFrame, rating: DataFrame) -> DataFrame:
    """Name, product counts, C14 rating and status per vendor."""
    stats = vendor_stats(product, vendor).select("vendor_id", "total_products", "active_products")
    return (vendor.select("vendor_id", F.col("store_name").alias("business_name"), "status")
            .join(stats, "vendor_id").join(vendor_average_rating(rating, vendor), "vendor_id")
            .select("vendor_id", "business_name", "total_products", "active_products",
                    "average_rating", "status"))


def recent_products(product: DataFrame, vendor: DataFrame, tagging: DataFrame, tag: DataFrame,
                    n: int = 10) -> DataFrame:
    """Newest ``n`` products per vendor (C1, first page of size n)."""
    return vendor_products(product, vendor, tagging, tag, tab="all", page=1, page_size=n)


def vendor_profile(vendor: DataFrame, ids: DataFrame) -> DataFrame:
    """C17: profile per requested id, with an existence flag; rating 0 when unset."""
    v = vendor.select("vendor_id", F.col("store_name").alias("business_name"),
                      F.col("location").alias("geographical_presence"), "status",
                      money(F.coalesce("rating", F.lit(0))).alias("average_rating"), F.lit(True).alias("_hit"))
    return (ids.select("vendor_id").join(v, "vendor_id", "left")
            .select("vendor_id", F.col("_hit").isNotNull().alias("exists"), "business_name",
                    "geographical_presence", "status", "average_rating"))


def available_users(users: DataFrame) -> DataFrame:
    """Users that are neither vendor nor admin."""
    return (users.filter(~has_role("role_bits", ROLE_VENDOR) & ~has_role("role_bits", ROLE_ADMIN))
            .select(F.col("user_id").alias("id"), "username", F.col("role_bits").alias("role")))


def vendor_catalog(product: DataFrame, vendor: DataFrame, vendor_id: str | None = None) -> DataFrame:
    """Raw product rows per existing vendor, newest first.

    The global sort is range-partitioned on (vendor, created desc), so a hot
    vendor spreads over several ranges.
    """
    p = product if vendor_id is None else product.filter(F.col("vendor_id") == vendor_id)
    p = p.join(vendor.select("vendor_id"), "vendor_id", "left_semi")
    return (p.select("vendor_id", "product_id", "name", "description", money("price").alias("price"), "stock",
                     "category", "image_url", "status", money("rating").alias("rating"), "created_seq")
            .orderBy("vendor_id", F.col("created_seq").desc(), "product_id"))
