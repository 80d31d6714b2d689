"""Registered integrity audit (A2) and next-state write (A3)."""

from __future__ import annotations

import uuid

from ..operators import changes as X
from ..operators import orders as O
from ..operators.integrity import VIEW_OF, integrity_audit, integrity_sql
from ..session import state_root
from ..sources.delta import read_buckets, write_buckets, write_delta
from ..sources.sink import read_state, write_shop
from .changes import FINAL_SQL
from .registry import register


def shop_tables(shop) -> dict:
    return {t: shop[v] for t, v in VIEW_OF.items()}


@register("integrity_audit", integrity_sql())
def q_integrity_audit(shop):
    return integrity_audit(shop_tables(shop))


@register("write_shop", f"WITH {FINAL_SQL} SELECT product_id, stock, status FROM fin")
def q_write_shop(shop):
    """A3: the product table after the stock ledger, written as a new version
    under the shared state root and read back from there."""
    nxt = X.stock_after_ledger(shop.shop_product, X.stock_ledger(shop.shop_product, shop.shop_stock_change))
    path = write_shop(nxt, "product", version=uuid.uuid4().hex)
    return read_state(shop.spark, path).select("product_id", "stock", "status")


@register("write_shop_delta", """
WITH acc AS (SELECT DISTINCT order_id FROM shop_recall_request
 WHERE order_id NOT IN (SELECT order_id FROM shop_sub_orders WHERE shipping_status <> 'pending'))
SELECT order_item_id, order_id, sub_order_id, product_id, quantity,
 CASE WHEN order_id IN (SELECT order_id FROM acc) THEN 'removed' ELSE item_status END item_status FROM shop_order_items""")
def q_write_shop_delta(shop):
    """A3: order items in buckets by order; calling back the newest orders rewrites
    their buckets only.  The batch is run twice, which changes nothing."""
    spark = shop.spark
    t = shop.lazy  # each read once a run
    items = t.shop_order_items.select("order_item_id", "order_id", "sub_order_id", "product_id", "quantity", "item_status")
    path = write_buckets(items, f"{state_root(spark)}/order_items-{uuid.uuid4().hex}", "order_id")
    requests = t.shop_recall_request

    def cancelled(rows):
        return O.cancel_orders(t.shop_orders, t.shop_sub_orders, rows, t.shop_product, requests).items

    for _ in range(2):
        write_delta(spark, path, "order_id", requests, cancelled, "recall")
    return read_buckets(spark, path)
