"""D: cart, checkout, order split, cancellation and item removal.

The reference does these one order at a time with per-line lookups; here
every cart / order in a batch is handled by joins and grouped aggregates.
State changes are "state + change rows -> next state" and never update in
place.  Money stays DECIMAL until the output edge.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ACTIVE, INACTIVE, ROLE_ADMIN, ROLE_VENDOR, date_time, has_role, money, trigger_status
from ..functions.scan import kept_rows

LINE_ORDER = ["line_no", "product_id", "quantity"]  # unique within a cart


def _visible_products(product: DataFrame, vendor: DataFrame) -> DataFrame:
    """What the shop's product lookup returns: not Inactive, vendor Active."""
    v = vendor.filter(F.col("status") == ACTIVE).select("vendor_id")
    return product.filter(F.col("status") != INACTIVE).join(v, "vendor_id", "left_semi")


def cart_totals(lines: DataFrame, product: DataFrame, vendor: DataFrame) -> DataFrame:
    """Per cart, lines with a known product and sum(price * qty)."""
    known = product.join(vendor.select("vendor_id"), "vendor_id", "left_semi").select("product_id", "price")
    return (lines.join(known, "product_id")
            .groupBy("cart_id").agg(F.count("*").alias("item_lines"),
                                    F.sum(F.col("price") * F.col("quantity")).alias("total"))
            .select("cart_id", F.col("item_lines").cast("bigint"), money("total").alias("total")))


def cart_merge(adds: DataFrame, product: DataFrame, vendor: DataFrame) -> DataFrame:
    """Apply "add to cart" rows: per (cart, product) quantity capped at stock.

    Only Active products of Active vendors can be added.  With positive adds a
    single cap min(sum, stock) equals capping after every add; non-positive
    add rows are rejected.  A result <= 0 removes the line.
    """
    ok = product.filter(F.col("status") == ACTIVE).join(
        vendor.filter(F.col("status") == ACTIVE).select("vendor_id"), "vendor_id", "left_semi")
    summed = (adds.filter(F.col("quantity") > 0).groupBy("cart_id", "product_id")
              .agg(F.sum("quantity").alias("q")))
    return (summed.join(ok.select("product_id", "stock"), "product_id")
            .select("cart_id", "product_id", F.least(F.col("q"), F.col("stock").cast("bigint")).alias("quantity"))
            .filter(F.col("quantity") > 0))


def checkout_lines(lines: DataFrame, product: DataFrame, vendor: DataFrame) -> DataFrame:
    """Per-line verdict: missing / unavailable / insufficient_stock / ok."""
    vis = _visible_products(product, vendor).select(
        "product_id", F.col("status").alias("p_status"), "stock", F.lit(True).alias("_seen"))
    return (lines.join(vis, "product_id", "left")
            .withColumn("reason",
                        F.when(F.col("_seen").isNull(), "missing")
                        .when(F.col("p_status") != ACTIVE, "unavailable")
                        .when(F.col("quantity") > F.col("stock"), "insufficient_stock")
                        .otherwise("ok"))
            .drop("_seen", "p_status", "stock"))


def checkout_validation(lines: DataFrame, product: DataFrame, vendor: DataFrame) -> DataFrame:
    """D3: per cart, the first failing line in cart order, or 'ok' (line 0)."""
    v = checkout_lines(lines, product, vendor)
    first_bad = F.min(F.when(F.col("reason") != "ok", F.struct(*LINE_ORDER, "reason")))
    return (v.groupBy("cart_id").agg(first_bad.alias("b"))
            .select("cart_id", F.coalesce(F.col("b.reason"), F.lit("ok")).alias("verdict"),
                    F.coalesce(F.col("b.line_no"), F.lit(0)).alias("failed_line_no"),
                    F.col("b.product_id").alias("failed_product_id")))


@dataclass
class Split:
    orders: DataFrame
    sub_orders: DataFrame
    items: DataFrame


def split_orders(lines: DataFrame, product: DataFrame, vendor: DataFrame) -> Split:
    """Cart lines -> order, one sub-order per vendor, items.

    Lines whose product the lookup does not return are skipped; a cart with
    nothing left makes no order.  Ids are derived from the cart, not random.
    """
    vis = _visible_products(product, vendor).select("product_id", F.col("vendor_id").alias("merchant_id"), "price")
    order_id = F.concat(F.lit("o"), F.col("cart_id").cast("string"))
    items = (lines.join(vis, "product_id")
             .select(F.concat(F.lit("i"), F.col("cart_id").cast("string"), F.lit("-"), F.col("line_no").cast("string"),
                              F.lit("-"), F.col("product_id"), F.lit("-"), F.col("quantity").cast("string"))
                     .alias("order_item_id"),
                     order_id.alias("order_id"),
                     F.concat(order_id, F.lit("-"), F.col("merchant_id")).alias("sub_order_id"),
                     "merchant_id", "product_id", "quantity", F.col("price").alias("price_per_unit"),
                     (F.col("quantity") * F.col("price")).cast("decimal(10,2)").alias("total_price"),
                     F.lit("active").alias("item_status")))
    subs = (items.groupBy("sub_order_id", "order_id", "merchant_id")
            .agg(F.sum("total_price").alias("sub_total_amount"), F.count("*").alias("item_count"))
            .withColumn("status", F.lit("pending")).withColumn("shipping_status", F.lit("pending")))
    orders = (subs.groupBy("order_id").agg(F.sum("sub_total_amount").alias("total_amount"))
              .withColumn("status", F.lit("pending")).withColumn("payment_status", F.lit("unpaid")))
    return Split(orders, subs, items)


def place_orders(lines: DataFrame, headers: DataFrame, product: DataFrame, vendor: DataFrame) -> Split:
    """D3 -> D4: split the carts the checkout accepts, with a full order header.

    ``headers``: one row per cart (cart_id, customer_id, order_date,
    shipping_address).  A cart is accepted when every line passes D3 and its
    address is not blank; a refused cart makes no order, sub-order or item.
    """
    address = F.btrim("shipping_address", F.lit(" \t\n\r\x0b\x0c"))
    ok = checkout_validation(lines, product, vendor).filter(F.col("verdict") == "ok").select("cart_id")
    head = (headers.withColumn("shipping_address", address).filter(F.col("shipping_address") != "")
            .join(ok, "cart_id", "left_semi"))
    s = split_orders(lines.join(head.select("cart_id"), "cart_id", "left_semi"), product, vendor)
    orders = (head.select(F.concat(F.lit("o"), F.col("cart_id").cast("string")).alias("order_id"),
                          "customer_id", "order_date", "shipping_address")
              .join(s.orders, "order_id"))
    return Split(orders, s.sub_orders, s.items)


def checkout_stock(product: DataFrame, items: DataFrame) -> DataFrame:
    """Stock minus ordered quantity, no floor at zero (checkout path).

    A batch is one update per product (quantities summed), followed by the
    stock trigger; products nobody ordered keep their status.
    """
    ordered = items.groupBy("product_id").agg(F.sum("quantity").alias("ordered"))
    after = F.col("stock") - F.coalesce("ordered", F.lit(0))
    return (product.select("product_id", "stock", "status").join(ordered, "product_id", "left")
            .select("product_id", F.col("stock").alias("stock_before"),
                    F.coalesce("ordered", F.lit(0)).cast("bigint").alias("ordered"),
                    after.cast("bigint").alias("stock_after"),
                    F.when(F.col("ordered").isNull(), F.col("status"))
                    .otherwise(trigger_status(F.col("stock"), after, F.col("status"))).alias("status_after")))


def order_details(orders: DataFrame, sub_orders: DataFrame, items: DataFrame, product: DataFrame) -> DataFrame:
    """Order -> sub_orders -> items as one nested row per order.

    Two grouped collects replace the N+1 lookups; an order's tree is bounded
    by its cart.  Arrays are sorted by id so the tree is deterministic.
    """
    it = items.join(product.select("product_id", F.col("name").alias("product_name"),
                                   F.col("image_url").alias("product_image")), "product_id")
    per_sub = it.groupBy("sub_order_id").agg(F.array_sort(F.collect_list(F.struct(
        "order_item_id", "product_id", "quantity", money("price_per_unit").alias("price_per_unit"),
        money("total_price").alias("total_price"), "item_status", "product_name", "product_image"))).alias("order_items"))
    subs = (sub_orders.join(per_sub, "sub_order_id", "left")
            .groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct(
                "sub_order_id", "merchant_id", money("sub_total_amount").alias("sub_total_amount"),
                "status", "shipping_status", "order_items"))).alias("sub_orders")))
    return (orders.join(subs, "order_id", "left")
            .select("order_id", "customer_id", "order_date", "status", money("total_amount").alias("total_amount"),
                    "payment_status", F.coalesce("sub_orders", F.array()).alias("sub_orders")))


def flatten_order_details(tree: DataFrame) -> DataFrame:
    """One row per item of the D6 tree; an order or sub-order without items
    gives one row with NULL ids and quantity 0."""
    s = tree.select("order_id", "customer_id", F.col("status").alias("order_status"), "total_amount",
                    F.explode_outer("sub_orders").alias("so"))
    i = s.select("*", F.explode_outer("so.order_items").alias("it"))
    return i.select("order_id", "customer_id", "order_status", "total_amount",
                    F.col("so.sub_order_id").alias("sub_order_id"), F.col("so.merchant_id").alias("merchant_id"),
                    F.col("so.status").alias("sub_status"), F.col("so.shipping_status").alias("shipping_status"),
                    F.col("it.order_item_id").alias("order_item_id"), F.col("it.product_id").alias("product_id"),
                    F.coalesce(F.col("it.quantity"), F.lit(0)).alias("quantity"),
                    F.col("it.total_price").alias("total_price"),
                    F.col("it.product_name").alias("product_name"))


def order_details_flat(orders: DataFrame, sub_orders: DataFrame, items: DataFrame, product: DataFrame) -> DataFrame:
    """D6 in flat form: one row per item with its order and sub-order, by joins.

    Same rows as ``flatten_order_details(order_details(...))`` without any
    grouped collect, so an order of any size stays a plain join.
    """
    it = items.join(product.select("product_id", F.col("name").alias("product_name")), "product_id").select(
        "sub_order_id", "order_item_id", "product_id", "quantity", money("total_price").alias("total_price"),
        "product_name")
    so = sub_orders.select("order_id", "sub_order_id", "merchant_id", F.col("status").alias("sub_status"),
                           "shipping_status")
    o = orders.select("order_id", "customer_id", F.col("status").alias("order_status"),
                      money("total_amount").alias("total_amount"))
    return (o.join(so, "order_id", "left").join(it, "sub_order_id", "left")
            .select("order_id", "customer_id", "order_status", "total_amount", "sub_order_id", "merchant_id",
                    "sub_status", "shipping_status", "order_item_id", "product_id",
                    F.coalesce("quantity", F.lit(0)).alias("quantity"), "total_price", "product_name"))


def order_items_named(items: DataFrame, product: DataFrame) -> DataFrame:
    """Items with product name and image."""
    return (items.join(product.select("product_id", F.col("name").alias("product_name"),
                                      F.col("image_url").alias("product_image")), "product_id")
            .select("order_item_id", "sub_order_id", "order_id", "product_id", "quantity",
                    money("price_per_unit").alias("price_per_unit"), money("total_price").alias("total_price"),
                    "item_status", "product_name", "product_image"))


def customer_orders(orders: DataFrame, customer_id: str | None = None) -> DataFrame:
    """Orders per customer, newest first (range-partitioned global sort)."""
    o = orders if customer_id is None else orders.filter(F.col("customer_id") == customer_id)
    return (o.orderBy("customer_id", F.col("order_date").desc(), "order_id")
            .select("order_id", "customer_id", date_time("order_date").alias("order_date"), "status",
                    money("total_amount").alias("total_amount"), "payment_status"))


def _role_holders(users: DataFrame) -> DataFrame:
    """(viewer_id, _role) of the users whose rows change a request: admins, vendors and repeated ids.

    Anyone else is as good as unknown, so this is far smaller than the users.
    It is stored: its true size then tells Spark whether it can be broadcast,
    and while it can, no request is shuffled by its viewer.
    """
    bits = F.coalesce("role_bits", F.lit(0))
    role = F.when(has_role(bits, ROLE_ADMIN), ROLE_ADMIN).when(has_role(bits, ROLE_VENDOR), ROLE_VENDOR).otherwise(0)
    roles = (ROLE_ADMIN, ROLE_VENDOR, 0)
    n = {r: F.col(f"_n{r}").cast("int") for r in roles}
    found = (users.filter(F.col("user_id").isNotNull()).select(F.col("user_id").alias("viewer_id"), role.alias("_role"))
             .groupBy("viewer_id").agg(*[F.count(F.when(F.col("_role") == r, 1)).alias(f"_n{r}") for r in roles])
             .filter((n[ROLE_ADMIN] + n[ROLE_VENDOR] > 0) | (n[0] > 1)))
    return kept_rows(found.select(
        "viewer_id", F.explode(F.concat(*[F.array_repeat(F.lit(r), n[r]) for r in roles])).alias("_role")))


def order_visibility(requests: DataFrame, users: DataFrame, orders: DataFrame, sub_orders: DataFrame) -> DataFrame:
    """(viewer, login_type, order) -> visible sub-orders.

    Admin sees all; a backend vendor sees only its own sub-orders (none while
    the order has some = denied); anyone else must own the order.  Requests
    get their viewer's role first and are then dealt by order once: orders
    and sub-orders are merged with them on that one key, and which of the
    order's sub-orders a request sees is a condition of the last merge.  The
    orders are merged, not broadcast, as the requests lie by order anyway.
    """
    role = (F.when(F.col("_role") == ROLE_ADMIN, ROLE_ADMIN)
            .when((F.col("login_type") == "backend") & (F.col("_role") == ROLE_VENDOR), ROLE_VENDOR))
    r = (requests.select("viewer_id", "login_type", "order_id")
         .join(_role_holders(users), "viewer_id", "left")
         .select("viewer_id", "order_id", role.alias("_role")))
    has_subs = sub_orders.select("order_id").distinct().withColumn("_has", F.lit(True))
    access = (F.when(F.col("_found").isNull(), "not_found")
              .when(F.col("_role") == ROLE_ADMIN, "admin")
              .when(F.col("_role") == ROLE_VENDOR, "vendor")
              .when(F.col("customer_id") == F.col("viewer_id"), "customer")
              .otherwise("denied"))
    r = (r.join(orders.select("order_id", "customer_id", F.lit(True).alias("_found")).hint("merge"), "order_id", "left")
         .select("viewer_id", "order_id", access.alias("access"))
         .join(has_subs, "order_id", "left"))
    so = sub_orders.select(F.col("order_id").alias("_order"), "sub_order_id", "merchant_id")
    seen = (F.col("access").isin("admin", "customer")
            | ((F.col("access") == "vendor") & (F.col("merchant_id") == F.col("viewer_id"))))
    hidden = (F.col("access") == "vendor") & F.col("sub_order_id").isNull() & F.col("_has").isNotNull()
    return (r.join(so, (F.col("order_id") == F.col("_order")) & seen, "left")
            .select("viewer_id", "order_id", F.when(hidden, "denied").otherwise(F.col("access")).alias("access"),
                    "sub_order_id"))


def latest_values(changes: DataFrame, key: str, fields: list[str], order_cols: list[str]) -> DataFrame:
    """Last value per (key, field) by ``order_cols``; one column per field.

    ``max(struct(order..., value))`` is a plain aggregate (partial map-side),
    so a key with many changes never forms a big group.
    """
    aggs = [F.max(F.when(F.col("field") == f, F.struct(*order_cols, "value"))).alias(f"_{f}") for f in fields]
    return changes.groupBy(key).agg(*aggs).select(key, *[F.col(f"_{f}.value").alias(f) for f in fields])


def apply_order_status(orders: DataFrame, changes: DataFrame, order_cols: list[str]) -> DataFrame:
    """Order status / payment status changes, last one wins."""
    last = latest_values(changes, "order_id", ["status", "payment_status"], order_cols)
    o = orders.select("order_id", F.col("status").alias("old_status"), F.col("payment_status").alias("old_payment"))
    return (o.join(last, "order_id", "left")
            .select("order_id", F.coalesce("status", "old_status").alias("status"),
                    F.coalesce("payment_status", "old_payment").alias("payment_status")))


def apply_sub_order_changes(sub_orders: DataFrame, changes: DataFrame, order_cols: list[str]) -> DataFrame:
    """Status and shipping status of sub-orders change independently of
    each other and of the order; per field the last change wins."""
    last = latest_values(changes, "sub_order_id", ["status", "shipping_status"], order_cols)
    s = sub_orders.select("sub_order_id", "order_id", "merchant_id", F.col("status").alias("old_status"),
                          F.col("shipping_status").alias("old_shipping"))
    return (s.join(last, "sub_order_id", "left")
            .select("sub_order_id", "order_id", "merchant_id", F.coalesce("status", "old_status").alias("status"),
                    F.coalesce("shipping_status", "old_shipping").alias("shipping_status")))


SHIPPING_VALUES = ("pending", "shipped", "delivered")


def apply_shipping(sub_orders: DataFrame, updates: DataFrame, order_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Shipping updates set shipping_status AND status; invalid values rejected.

    Returns (next sub-orders, rejected update rows).
    """
    valid = F.col("value").isin(*SHIPPING_VALUES)
    ok = updates.filter(valid).withColumn("field", F.lit("shipping"))
    last = latest_values(ok, "sub_order_id", ["shipping"], order_cols)
    nxt = (sub_orders.join(last, "sub_order_id", "left")
           .select("sub_order_id", "order_id", "merchant_id",
                   F.coalesce("shipping", "status").alias("status"),
                   F.coalesce("shipping", "shipping_status").alias("shipping_status")))
    return nxt, updates.filter(~valid | F.col("value").isNull())


@dataclass
class OrderState:
    outcomes: DataFrame
    orders: DataFrame
    sub_orders: DataFrame
    items: DataFrame
    product: DataFrame


def _restore_stock(product: DataFrame, restore: DataFrame) -> DataFrame:
    """Stock plus the restored units (one update per product), then the stock trigger."""
    add = restore.groupBy("product_id").agg(F.sum("quantity").alias("_add"))
    after = (F.col("stock") + F.coalesce("_add", F.lit(0))).cast("int")
    status = (F.when(F.col("_add").isNull(), F.col("status"))
              .otherwise(trigger_status(F.col("stock"), after, F.col("status"))))
    return product.join(add, "product_id", "left").withColumns({"stock": after, "status": status}).drop("_add")


def cancel_orders(orders: DataFrame, sub_orders: DataFrame, items: DataFrame, product: DataFrame,
                  requests: DataFrame) -> OrderState:
    """Cancel whole orders.

    Refused when any sub-order's shipping_status is not 'pending'.  Otherwise
    the order and its sub-orders are cancelled, items removed and stock
    restored by the quantity of items that were active BEFORE the cancel,
    summed per product first (intended behaviour, not the as-coded order of
    statements that restores nothing).
    """
    req = requests.select("order_id").distinct()
    known = req.join(orders.select("order_id"), "order_id", "left_semi")
    blocked = sub_orders.filter(F.col("shipping_status") != "pending").select("order_id").distinct()
    accepted = known.join(blocked, "order_id", "left_anti")
    acc = accepted.withColumn("_acc", F.lit(True))
    it = items.join(acc, "order_id", "left")
    restore = it.filter(F.col("_acc").isNotNull() & (F.col("item_status") == "active")).select("product_id", "quantity",
                                                                                                "order_id")
    units = restore.groupBy("order_id").agg(F.sum("quantity").alias("restored_units"))
    outcomes = (req.join(known.withColumn("_k", F.lit(True)), "order_id", "left")
                .join(acc, "order_id", "left").join(units, "order_id", "left")
                .select("order_id",
                        F.when(F.col("_k").isNull(), "not_found").when(F.col("_acc").isNull(), "refused")
                        .otherwise("cancelled").alias("outcome"),
                        F.coalesce("restored_units", F.lit(0)).cast("bigint").alias("restored_units")))
    next_orders = (orders.join(acc, "order_id", "left")
                   .withColumn("status", F.when(F.col("_acc").isNotNull(), "cancelled").otherwise(F.col("status")))
                   .drop("_acc"))
    next_subs = (sub_orders.join(acc, "order_id", "left")
                 .withColumn("status", F.when(F.col("_acc").isNotNull(), "cancelled").otherwise(F.col("status")))
                 .drop("_acc"))
    next_items = (it.withColumn("item_status", F.when(F.col("_acc").isNotNull(), "removed")
                                .otherwise(F.col("item_status"))).drop("_acc"))
    return OrderState(outcomes, next_orders, next_subs, next_items, _restore_stock(product, restore))


class RemovedItems:
    """Next states of ``remove_order_items``; what an item removal does to sub-orders and orders is stored when first asked for."""

    def __init__(self, orders: DataFrame, sub_orders: DataFrame, items: DataFrame, product: DataFrame, requests: DataFrame):
        self._orders, self._sub_orders, self._items, self._product = orders, sub_orders, items, product
        self._req = requests.select("order_item_id").distinct()
        self._pending = sub_orders.filter(F.col("shipping_status") == "pending").select("sub_order_id")
        self._removed = (items.join(self._req, "order_item_id", "left_semi").filter(F.col("item_status") == "active")
                         .join(self._pending, "sub_order_id", "left_semi")
                         .select("order_item_id", "product_id", "quantity"))
        self._flag = self._removed.select("order_item_id", F.lit(True).alias("_rm"))

    @cached_property
    def outcomes(self) -> DataFrame:
        return (self._req.join(self._flag, "order_item_id", "left")
                .select("order_item_id", F.col("_rm").isNotNull().alias("removed")))

    @cached_property
    def items(self) -> DataFrame:
        return (self._items.join(self._flag, "order_item_id", "left")
                .withColumn("item_status", F.when(F.col("_rm").isNotNull(), "removed").otherwise(F.col("item_status")))
                .drop("_rm"))

    @cached_property
    def product(self) -> DataFrame:
        return _restore_stock(self._product, self._removed)

    @cached_property
    def _touched(self) -> DataFrame:
        """Touched sub-orders (by the order their items name): amount and items gone, active items left.

        One pass over the active items: in a pending sub-order the requested
        ones go and the others are left.  Several branches read the rows, each
        with filters of its own, so they are stored instead of derived anew.
        """
        asked = F.col("_asked").isNotNull()
        per = (self._items.filter((F.col("item_status") == "active") & F.col("sub_order_id").isNotNull())
               .select("order_item_id", "sub_order_id", "order_id", "total_price")
               .join(self._req.withColumn("_asked", F.lit(True)), "order_item_id", "left")
               .select("sub_order_id", "order_id", F.when(asked, F.col("total_price")).alias("_price"), asked.alias("_asked"))
               .repartition("sub_order_id").groupBy("sub_order_id", "order_id")
               .agg(F.sum("_price").alias("_amt"), F.count(F.when(F.col("_asked"), 1)).alias("_gone"),
                    F.count(F.when(~F.col("_asked"), 1)).alias("_left")))
        # of a sub-order that loses items, also what is left under other orders
        gone = per.groupBy("sub_order_id").agg(
            F.collect_list(F.struct("order_id", "_amt", "_gone")).alias("_orders"),
            F.sum("_amt").alias("_amt"), F.sum("_gone").alias("_gone"), F.sum("_left").alias("_left")).filter("_gone > 0")
        return kept_rows(gone.join(self._pending, "sub_order_id", "left_semi").drop("_gone"))

    @cached_property
    def sub_orders(self) -> DataFrame:
        return (self._sub_orders.join(self._touched.drop("_orders"), "sub_order_id", "left")
                .withColumn("sub_total_amount",
                            (F.col("sub_total_amount") - F.coalesce("_amt", F.lit(0))).cast("decimal(22,2)"))
                .withColumn("status", F.when(F.col("_amt").isNotNull() & (F.coalesce("_left", F.lit(0)) == 0),
                                             "cancelled").otherwise(F.col("status")))
                .drop("_amt", "_left"))

    @cached_property
    def orders(self) -> DataFrame:
        per_order = (self._touched.select(F.inline("_orders")).filter("_gone > 0")
                     .groupBy("order_id").agg(F.sum("_amt").alias("_amt")))
        live_left = (self.sub_orders.join(per_order.select("order_id"), "order_id", "left_semi")
                     .groupBy("order_id").agg(F.count(F.when(F.col("status") != "cancelled", 1)).alias("_live")))
        touched_order = per_order.join(live_left, "order_id", "left")
        return (self._orders.join(touched_order, "order_id", "left")
                .withColumn("total_amount",
                            (F.col("total_amount") - F.coalesce("_amt", F.lit(0))).cast("decimal(12,2)"))
                .withColumn("status", F.when(F.col("_amt").isNotNull() & (F.coalesce("_live", F.lit(0)) == 0),
                                             "cancelled").otherwise(F.col("status")))
                .drop("_amt", "_live"))


def remove_order_items(orders: DataFrame, sub_orders: DataFrame, items: DataFrame, product: DataFrame,
                       requests: DataFrame) -> RemovedItems:
    """Remove items; adjust totals; restore stock; cascade cancels.

    An item is removable when active and its sub-order's shipping is pending.
    A touched sub-order with no active item left is cancelled; a touched order
    with no non-cancelled sub-order left is cancelled.  All removals of one
    batch are applied before the cascades are evaluated.
    """
    return RemovedItems(orders, sub_orders, items, product, requests)


def remove_sub_order_products(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Next items after deleting every item of the requested
    (sub_order_id, product_id) pairs, whatever its status.  Unknown pairs and
    pairs with a null delete nothing."""
    return items.join(requests.select("sub_order_id", "product_id"), ["sub_order_id", "product_id"], "left_anti")


HISTORY_SCHEMA = "array<struct<Order_ID:string,Status:string,Order_Date:string>>"


def order_history_fragments(users: DataFrame, orders: DataFrame) -> DataFrame:
    """History as JSON fragments: one one-entry JSON array per order.

    ``parse_history`` reads any number of history rows per customer, so
    fragments need no per-customer collect.  Customers without orders get
    the seed's non-JSON text 'history'.
    """
    frag = orders.select(F.col("customer_id").alias("user_id"), F.to_json(F.array(F.struct(
        F.col("order_id").alias("Order_ID"), F.col("status").alias("Status"),
        F.date_format("order_date", "yyyy-MM-dd").alias("Order_Date")))).alias("order_history"))
    bare = (users.select("user_id").join(frag.select("user_id"), "user_id", "left_anti")
            .withColumn("order_history", F.lit("history")))
    return frag.join(users.select("user_id"), "user_id", "left_semi").unionByName(bare)


def order_history_text(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Customer.Order_History as ONE JSON text per customer (the reference's
    storage form), built from the order table.

    This collects a customer's whole history into one value, so it is only as
    bounded as one customer's orders; ``order_history_fragments`` is the form
    without that collect.  Customers without orders get 'history'.
    """
    hist = orders.groupBy("customer_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        F.col("order_id").alias("Order_ID"), F.col("status").alias("Status"),
        F.date_format("order_date", "yyyy-MM-dd").alias("Order_Date"))))).alias("order_history"))
    return (users.select(F.col("user_id")).join(hist.withColumnRenamed("customer_id", "user_id"), "user_id", "left")
            .select("user_id", F.coalesce("order_history", F.lit("history")).alias("order_history")))


def parse_history(history: DataFrame) -> DataFrame:
    """JSON text -> one row per entry; bad text parses to an empty list."""
    arr = F.coalesce(F.from_json("order_history", HISTORY_SCHEMA, {"mode": "PERMISSIVE"}),
                     F.array().cast(HISTORY_SCHEMA))
    return (history.select("user_id", F.explode_outer(arr).alias("o"))
            .select("user_id", F.col("o.Order_ID").alias("order_id"), F.col("o.Status").alias("status"),
                    F.col("o.Order_Date").alias("order_date")))


def cancel_in_history(history: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark requested (customer, order) entries 'Cancelled'.

    Returns (exploded entries, re-serialized JSON per customer).
    """
    rows = parse_history(history)
    req = (requests.select(F.col("customer_id").alias("user_id"), "order_id").distinct()
           .withColumn("_c", F.lit(True)))
    marked = (rows.join(req, ["user_id", "order_id"], "left")
              .withColumn("status", F.when(F.col("_c").isNotNull(), "Cancelled").otherwise(F.col("status")))
              .drop("_c"))
    entry = F.when(F.col("order_id").isNotNull(), F.struct(
        F.col("order_id").alias("Order_ID"), F.col("status").alias("Status"), F.col("order_date").alias("Order_Date")))
    text = marked.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("order_history"))
    return marked, text


def cancel_in_stored_history(history: DataFrame, requests: DataFrame) -> DataFrame:
    """D14 on the stored text: (user_id, order_history, cancelled) with requested entries 'Cancelled'.

    A customer's JSON is edited in its own row: the batch's requests are folded
    to one set of order ids per customer, the text is parsed, its entries are
    mapped and written back, and no history is exploded or collected.  Entries
    keep their other fields and their types (VARIANT).  ``cancelled`` counts the
    entries that matched; texts without a match (also bad JSON, and orders of
    someone else) stay byte for byte.
    """
    ids = (requests.filter(F.col("order_id").isNotNull())
           .groupBy(F.col("customer_id").alias("user_id")).agg(F.collect_set("order_id").alias("_ids")))
    entries = F.from_json("order_history", "array<map<string,variant>>")
    hit = lambda e: F.coalesce(
        F.array_contains("_ids", F.try_element_at(e, F.lit("Order_ID")).cast("string")), F.lit(False))
    marked = F.transform("_entries", lambda e: F.when(hit(e), F.transform_values(
        e, lambda k, v: F.when(k == "Status", F.parse_json(F.lit('"Cancelled"'))).otherwise(v))).otherwise(e))
    rows = (history.select("user_id", "order_history").join(ids, "user_id", "left")
            .withColumn("_entries", F.when(F.col("_ids").isNotNull(), entries))
            .withColumn("cancelled", F.coalesce(F.size(F.filter("_entries", hit)), F.lit(0)).cast("bigint")))
    return rows.select("user_id", F.when(F.col("cancelled") > 0, F.to_json(marked)).otherwise(F.col("order_history"))
                       .alias("order_history"), "cancelled")
