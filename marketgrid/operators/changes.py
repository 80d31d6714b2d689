"""F: catalog, vendor and user changes as "state + change rows -> next state".

The reference applies one UPDATE per request; here a whole batch of requests
is applied with joins and grouped aggregates.  Sequential rules (the stock
ledger) are prefix scans written as window functions over bounded chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ACTIVE, INACTIVE, OUT_OF_STOCK, ROLE_VENDOR, ci_contains, trigger_status
from ..functions.numbering import dense_numbers
from ..functions.scan import CHUNK_ROWS, range_chunks

MAX_TAGS = 3


# ---------------------------------------------------------------- tags (F1-F2)
def parse_product_tags(texts: DataFrame, text_col: str = "tags_text") -> DataFrame:
    """comma text -> (product_id, name, position).

    Trim, drop empty, keep the first occurrence of a name (case-free: tag
    names are unique without case), then the first three, numbered 1..3.
    """
    arr = F.filter(F.transform(F.split(F.col(text_col), ","), lambda t: F.trim(t)), lambda t: t != "")
    first = F.filter(arr, lambda x, i: ~F.exists(F.slice(arr, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return (texts.select("product_id", F.posexplode(F.slice(first, 1, MAX_TAGS)).alias("pos", "name"))
            .select("product_id", "name", (F.col("pos") + 1).alias("position")))


def upsert_tags(tag: DataFrame, names: DataFrame) -> DataFrame:
    """add unseen names (case-free) with ids after the current maximum.

    New ids follow (lower name, name) order, numbered without a global
    window (``dense_numbers``), so a batch with millions of new names is
    still spread over the cluster.  Case variants of one new name become one
    tag spelled as its smallest variant.
    """
    known = tag.select(F.lower("name").alias("k"))
    new = (names.select(F.lower("name").alias("k"), "name").join(known, "k", "left_anti")
           .groupBy("k").agg(F.min("name").alias("name")))
    top = tag.agg(F.coalesce(F.max("tag_id"), F.lit(0))).scalar()  # scalar subquery
    added = dense_numbers(new, ["k", "name"], base=top, name="tag_id")
    return tag.select("tag_id", "name").unionByName(added.select(F.col("tag_id").cast("int"), "name"))


def _tagging_for(parsed: DataFrame, tags: DataFrame) -> DataFrame:
    t = tags.select("tag_id", F.lower("name").alias("k"))
    return (parsed.withColumn("k", F.lower("name")).join(t, "k")
            .select("product_id", "tag_id", F.col("position").cast("int").alias("position")))


# ---------------------------------------------------------------- products
class CatalogState:
    """Outcomes and next tables of a batch of product requests.

    New tag ids are numbered (which runs jobs) only when ``tag`` or
    ``tagging`` is read; ``outcomes`` and ``product`` stay lazy.
    """

    def __init__(self, outcomes: DataFrame, product: DataFrame, tags: Callable[[], DataFrame],
                 links: Callable[[DataFrame], DataFrame]):
        self.outcomes, self.product, self._tags, self._links = outcomes, product, tags, links

    @cached_property
    def tag(self) -> DataFrame:
        return self._tags()

    @cached_property
    def tagging(self) -> DataFrame:
        return self._links(self.tag)


PRODUCT_COLS = ["product_id", "name", "description", "price", "stock", "category", "image_url", "vendor_id",
                "status", "rating", "created_seq"]


def add_products(product: DataFrame, tag: DataFrame, tagging: DataFrame, new_rows: DataFrame) -> CatalogState:
    """insert new products as Active (rating 0) with their tags; ids that
    already exist are rejected."""
    existing = product.select("product_id")
    accepted = new_rows.join(existing, "product_id", "left_anti")
    outcomes = (new_rows.select("product_id").join(accepted.select("product_id", F.lit(True).alias("_ok")),
                                                  "product_id", "left")
                .select("product_id", F.when(F.col("_ok").isNotNull(), "added").otherwise("rejected")
                        .alias("outcome")))
    rows = accepted.select(
        "product_id", "name", "description", F.col("price").cast("decimal(10,2)").alias("price"),
        F.col("stock").cast("int").alias("stock"), "category", "image_url", "vendor_id",
        F.lit(ACTIVE).alias("status"), F.lit(0).cast("decimal(3,2)").alias("rating"), "created_seq")
    parsed = parse_product_tags(accepted)
    old_links = tagging.select("product_id", "tag_id", "position")
    return CatalogState(outcomes, product.select(*PRODUCT_COLS).unionByName(rows),
                        lambda: upsert_tags(tag, parsed),
                        lambda tags: old_links.unionByName(_tagging_for(parsed, tags)))


def ownership_check(product: DataFrame, claims: DataFrame) -> DataFrame:
    """(product, vendor) claim -> is_owner; false when the product is missing."""
    owner = product.select("product_id", F.col("vendor_id").alias("_owner"))
    return (claims.select("product_id", "vendor_id").join(owner, "product_id", "left")
            .select("product_id", "vendor_id",
                    F.coalesce(F.col("_owner") == F.col("vendor_id"), F.lit(False)).alias("is_owner")))


def update_products(product: DataFrame, tag: DataFrame, tagging: DataFrame, updates: DataFrame,
                    order_cols: list[str]) -> CatalogState:
    """owner-checked full overwrite of product fields and tag list.

    Claims by a vendor that does not own the product are rejected.  When one
    product has several accepted updates the last by ``order_cols`` (unique
    per product) wins.  The stock trigger then sets the status, from the stock
    before the batch.
    """
    fields = ["name", "description", "price", "stock", "category", "image_url", "status", "tags_text"]
    checked = ownership_check(product, updates).select("product_id", "vendor_id", "is_owner")
    u = updates.join(checked.dropDuplicates(["product_id", "vendor_id"]), ["product_id", "vendor_id"])
    ok = u.filter("is_owner")
    last = (ok.groupBy("product_id").agg(F.max(F.struct(*order_cols, *[F.col(c).alias(f"_{c}") for c in fields])).alias("u"))
            .select("product_id", *[F.col(f"u._{c}").alias(f"new_{c}") for c in fields]))
    outcomes = u.select("product_id", "vendor_id",
                        F.when(F.col("is_owner"), "updated").otherwise("denied").alias("outcome"))
    cols = ["name", "description", "price", "stock", "category", "image_url", "status"]
    nxt = (product.join(last.withColumn("_t", F.lit(True)), "product_id", "left")
           .select("product_id", "vendor_id", "rating", "created_seq", "_t", F.col("stock").alias("_old"),
                   *[F.when(F.col("_t").isNotNull(), F.col(f"new_{c}").cast(product.schema[c].dataType))
                     .otherwise(F.col(c)).alias(c) for c in cols])
           .withColumn("status", F.when(F.col("_t").isNull(), F.col("status"))
                       .otherwise(trigger_status(F.col("_old"), F.col("stock"), F.col("status"))))
           .select(*PRODUCT_COLS))
    touched = last.select("product_id")
    parsed = parse_product_tags(last.select("product_id", F.col("new_tags_text").alias("tags_text")))
    kept = tagging.select("product_id", "tag_id", "position").join(touched, "product_id", "left_anti")
    return CatalogState(outcomes, nxt, lambda: upsert_tags(tag, parsed),
                        lambda tags: kept.unionByName(_tagging_for(parsed, tags)))


def toggle_products(product: DataFrame, toggles: DataFrame) -> DataFrame:
    """n toggles per product: Active -> Inactive, anything else -> Active.

    After n >= 1 toggles the result is Active exactly when (status = Active)
    XOR (n odd); OutOfStock thus behaves like Inactive.
    """
    n = toggles.groupBy("product_id").agg(F.count("*").alias("_n"))
    was_active = F.col("status") == ACTIVE
    odd = (F.col("_n") % 2) == 1
    return (product.join(n, "product_id", "left")
            .withColumn("status", F.when(F.col("_n").isNull(), F.col("status"))
                        .when(was_active != odd, ACTIVE).otherwise(INACTIVE))
            .drop("_n"))


# ---------------------------------------------------------------- stock
def stock_status_step(old_stock, new_stock, status, action):
    """F6, one change: manual rules then the stock trigger (old stock compared).

    increase: OutOfStock -> Active; decrease reaching <= 0: Active -> OutOfStock;
    then stock 0 and not Inactive -> OutOfStock; stock > 0 from 0 while
    OutOfStock -> Active.
    """
    manual = (F.when((action == "increase") & (status == OUT_OF_STOCK), F.lit(ACTIVE))
              .when((action == "decrease") & (new_stock <= 0) & (status == ACTIVE), F.lit(OUT_OF_STOCK))
              .otherwise(status))
    return trigger_status(old_stock, new_stock, manual)


def stock_status_rule(product: DataFrame, changes: DataFrame) -> DataFrame:
    """F6 as a single step from the current state, per change row."""
    p = product.select("product_id", F.col("stock").alias("old_stock"), "status")
    c = changes.join(p, "product_id")
    amt = F.col("amount")
    new = (F.when(F.col("action") == "increase", F.col("old_stock") + amt)
           .otherwise(F.greatest(F.lit(0), F.col("old_stock") - amt)))
    return (c.withColumn("new_stock", new.cast("bigint"))
            .select("change_id", "product_id", "new_stock",
                    stock_status_step(F.col("old_stock"), F.col("new_stock"), F.col("status"),
                                      F.col("action")).alias("new_status")))


def stock_ledger(product: DataFrame, changes: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """F5 + F6 along a ledger: stock and status after every change.

    Changes apply per product in (ts, change_id) order; a decrease floors at
    zero.  With x_k = start + running sum of signed amounts, the floored stock
    is x_k - min(0, min_{j<=k} x_j) (needs start >= 0 and amounts >= 0;
    negative amounts and unknown actions are rejected first).

    Skew: a product may own a third of all changes, in one day or over years,
    so the scan runs in two levels.  ``range_chunks`` cuts the ledger, in
    (product, ts, change) order, into runs of about ``rows`` rows; each run of
    one product is a map s -> max(s + A, B) with A its signed sum and B = A -
    min(0, its lowest prefix).  Such maps compose, so one small window over
    the chunk summaries of a product gives every chunk's start stock, and the
    per-change windows never span more than one chunk.

    Status (F6 along the ledger) has a closed form: Inactive never changes;
    stock 0 is OutOfStock; otherwise Active once any increase happened (an
    increase lifts OutOfStock, and after the last increase only decreases
    follow, which reach 0 or leave the status alone); else the start status.
    "Any increase so far" is a running OR, carried across chunks like the
    sums.
    """
    p = product.select("product_id", F.col("stock").alias("s0"), F.col("status").alias("st0"))
    c = changes.filter((F.col("amount") >= 0) & F.col("action").isin("increase", "decrease")) \
        .select("change_id", "product_id", "action", "amount", "ts")
    c = (range_chunks(c, ["product_id", "ts", "change_id"], rows)
         .withColumn("d", F.when(F.col("action") == "increase", F.col("amount")).otherwise(-F.col("amount"))
                     .cast("bigint")))
    w_in = (Window.partitionBy("product_id", "chunk").orderBy("ts", "change_id")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    up = (F.col("action") == "increase").cast("int")
    # one summary per product and chunk, from the last row of the run
    c = (c.withColumn("P", F.sum("d").over(w_in))
         .withColumn("m", F.least(F.lit(0).cast("bigint"), F.min("P").over(w_in)))
         .withColumn("inc_in", F.max(up).over(w_in)))
    summ = (c.groupBy("product_id", "chunk")
            .agg(F.sum("d").alias("A"), F.min("m").alias("mA"), F.max("inc_in").alias("incA"))
            .join(p, "product_id"))
    w_ch = Window.partitionBy("product_id").orderBy("chunk")
    prev = w_ch.rowsBetween(Window.unboundedPreceding, -1)
    summ = (summ.withColumn("CA", F.coalesce(F.sum("A").over(prev), F.lit(0).cast("bigint")))
            .withColumn("Q", F.col("A") - F.col("mA") - (F.col("CA") + F.col("A")))
            .withColumn("S", F.col("CA") + F.greatest(F.col("s0"), F.coalesce(F.max("Q").over(prev), F.col("s0"))))
            .withColumn("inc_before", F.coalesce(F.max("incA").over(prev), F.lit(0)))
            .select("product_id", "chunk", "S", "inc_before", "st0"))
    c = (c.join(summ, ["product_id", "chunk"])
         .withColumn("stock_after", F.col("S") + F.col("P") - F.least(F.lit(0).cast("bigint"), F.col("S") + F.col("m"))))
    status = (F.when(F.col("st0") == INACTIVE, F.lit(INACTIVE))
              .when(F.col("stock_after") == 0, F.lit(OUT_OF_STOCK))
              .when((F.col("inc_in") + F.col("inc_before")) > 0, F.lit(ACTIVE))
              .otherwise(F.col("st0")))
    return c.select("change_id", "product_id", "action", "amount", "ts",
                    F.col("stock_after").cast("bigint").alias("stock_after"), status.alias("status_after"))


def stock_after_ledger(product: DataFrame, ledger: DataFrame) -> DataFrame:
    """Product table after the ledger: last change's stock and status."""
    last = (ledger.groupBy("product_id")
            .agg(F.max(F.struct("ts", "change_id", "stock_after", "status_after")).alias("l"))
            .select("product_id", F.col("l.stock_after").alias("_s"), F.col("l.status_after").alias("_st")))
    return (product.join(last, "product_id", "left")
            .withColumn("stock", F.coalesce(F.col("_s").cast("int"), F.col("stock")))
            .withColumn("status", F.coalesce("_st", "status")).drop("_s", "_st"))


def product_stock_status(product: DataFrame, ids: DataFrame) -> DataFrame:
    """F16: (stock, status) of the requested products."""
    return (product.join(ids.select("product_id").distinct(), "product_id", "left_semi")
            .select("product_id", "stock", "status"))


# ---------------------------------------------------------------- vendors
def vendor_onboard(vendor: DataFrame, users: DataFrame, requests: DataFrame,
                   order_cols: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F8: new Active vendor (rating 0) per user; then role |= vendor bit.

    A user's first valid request by ``order_cols`` counts (invalid ones change
    nothing, later ones meet an existing vendor).  One outcome per user: 'invalid' (blank name or location), 'unknown_user',
    'exists', 'onboarded'.  Returns (outcomes, next vendors, next users).
    """
    valid = (F.trim("business_name") != "") & (F.trim("location") != "")
    named = F.struct(*order_cols, F.trim("business_name").alias("business_name"), F.trim("location").alias("location"))
    r = (requests.groupBy("user_id").agg(F.min(F.when(valid, named)).alias("r"))
         .select("user_id", "r.business_name", "r.location"))
    r = (r.join(users.select("user_id", F.lit(True).alias("_u")), "user_id", "left")
         .join(vendor.select(F.col("vendor_id").alias("user_id"), F.lit(True).alias("_v")), "user_id", "left"))
    outcome = (F.when(F.col("business_name").isNull(), "invalid")
               .when(F.col("_u").isNull(), "unknown_user")
               .when(F.col("_v").isNotNull(), "exists").otherwise("onboarded"))
    r = r.withColumn("outcome", outcome)
    ok = r.filter(F.col("outcome") == "onboarded")
    new_vendors = ok.select(F.col("user_id").alias("vendor_id"), F.col("business_name").alias("store_name"),
                            "location", F.lit(ACTIVE).alias("status"), F.lit(0).cast("decimal(3,2)").alias("rating"),
                            F.lit(None).cast("bigint").alias("created_seq"))
    vendors = vendor.select("vendor_id", "store_name", "location", "status", "rating", "created_seq") \
        .unionByName(new_vendors)
    flag = ok.select("user_id", F.lit(True).alias("_ok"))
    next_users = (users.join(flag, "user_id", "left")
                  .withColumn("role_bits", F.when(F.col("_ok").isNotNull(),
                                                  F.col("role_bits").bitwiseOR(F.lit(ROLE_VENDOR)))
                              .otherwise(F.col("role_bits"))).drop("_ok"))
    outcomes = (r.select("user_id", "outcome")
                .join(next_users.select("user_id", "role_bits"), "user_id", "left"))
    return outcomes, vendors, next_users


def vendor_update(vendor: DataFrame, updates: DataFrame, order_cols: list[str]) -> DataFrame:
    """partial update (NULL or blank = unchanged); per field the last value by ``order_cols`` wins.

    Per request: 'not_found', 'no_change' (nothing given) or 'updated', with
    the vendor's name and location after all of the batch's updates.
    """
    u = _given_fields(updates, order_cols)
    fields = [c for c in VENDOR_FIELDS if c in u.columns]
    nxt = next_vendors(vendor, updates, order_cols).select("vendor_id", "store_name", "location", F.lit(True).alias("_found"))
    given = u.select("vendor_id", F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull().alias("_given"))
    return (given.join(nxt, "vendor_id", "left")
            .select("vendor_id",
                    F.when(F.col("_found").isNull(), "not_found")
                    .when(~F.col("_given"), "no_change")
                    .otherwise("updated").alias("outcome"),
                    "store_name", "location"))


# The fields a vendor update may set; blank names and locations, unknown states and ratings outside 0..5 set nothing.
VENDOR_FIELDS = {
    "store_name": lambda c: F.trim(c) != "",
    "location": lambda c: F.trim(c) != "",
    "status": lambda c: c.isin(ACTIVE, INACTIVE),
    "rating": lambda c: c.between(0, 5),
}


def _given_fields(updates: DataFrame, order_cols: list[str]) -> DataFrame:
    return updates.select("vendor_id", *order_cols, *[F.when(ok(F.col(c)), F.col(c)).alias(c)
                                                      for c, ok in VENDOR_FIELDS.items() if c in updates.columns])


def next_vendors(vendor: DataFrame, updates: DataFrame, order_cols: list[str]) -> DataFrame:
    """the vendor table after a batch of partial updates (store_name, location, status, rating; those the batch has).

    Per field the last given value by ``order_cols`` wins; other columns and vendors stay.
    """
    u = _given_fields(updates, order_cols)
    fields = [c for c in VENDOR_FIELDS if c in u.columns]
    last = u.groupBy("vendor_id").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(*order_cols, F.col(c).alias("_v")))).getField("_v").alias(f"_{c}")
        for c in fields])
    joined = vendor.join(last, "vendor_id", "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}").cast(vendor.schema[c].dataType), c).alias(c) if c in fields else F.col(c)
                           for c in vendor.columns])


def vendor_status_change(vendor: DataFrame, by_id: DataFrame | None = None,
                         bulk: list[tuple[str, str]] | None = None) -> DataFrame:
    """activate / deactivate / toggle by id, then bulk by location.

    Per vendor the last activate/deactivate (by ``seq``) sets a base and
    every later toggle flips it.  ``bulk`` holds (location substring,
    'activate' | 'deactivate'), applied in order after the id actions.
    """
    v = vendor
    if by_id is not None:
        r = by_id.filter(F.col("action").isin("activate", "deactivate", "toggle"))
        sets = (r.filter(F.col("action") != "toggle").groupBy("vendor_id")
                .agg(F.max(F.struct("seq", "action")).alias("s"))
                .select("vendor_id", F.col("s.seq").alias("_set_seq"), F.col("s.action").alias("_set")))
        flips = (r.filter(F.col("action") == "toggle").join(sets, "vendor_id", "left")
                 .filter(F.col("_set_seq").isNull() | (F.col("seq") > F.col("_set_seq")))
                 .groupBy("vendor_id").agg(F.count("*").alias("_flips")))
        base = F.when(F.col("_set") == "activate", ACTIVE).when(F.col("_set") == "deactivate", INACTIVE) \
            .otherwise(F.col("status"))
        odd = (F.coalesce("_flips", F.lit(0)) % 2) == 1
        v = (v.join(sets, "vendor_id", "left").join(flips, "vendor_id", "left")
             .withColumn("status", F.when(odd, F.when(base == ACTIVE, INACTIVE).otherwise(ACTIVE)).otherwise(base))
             .drop("_set_seq", "_set", "_flips"))
    for loc, action in bulk or []:
        hit = ci_contains("location", loc)
        if action == "activate":
            v = v.withColumn("status", F.when(hit & (F.col("status") == INACTIVE), ACTIVE).otherwise(F.col("status")))
        elif action == "deactivate":
            v = v.withColumn("status", F.when(hit & (F.col("status") == ACTIVE), INACTIVE).otherwise(F.col("status")))
    return v


def vendor_delete(vendor: DataFrame, product: DataFrame, sub_orders: DataFrame, requests: DataFrame) -> DataFrame:
    """delete vendors nothing references (no cascade on those keys)."""
    used = (product.select("vendor_id").distinct()
            .unionByName(sub_orders.select(F.col("merchant_id").alias("vendor_id")).distinct()).distinct()
            .withColumn("_used", F.lit(True)))
    return (requests.select("vendor_id").distinct()
            .join(vendor.select("vendor_id", F.lit(True).alias("_found")), "vendor_id", "left")
            .join(used, "vendor_id", "left")
            .select("vendor_id", F.when(F.col("_found").isNull(), "not_found")
                    .when(F.col("_used").isNotNull(), "blocked").otherwise("deleted").alias("outcome")))


def vendors_after_delete(vendor: DataFrame, outcomes: DataFrame) -> DataFrame:
    """the vendor table without the vendors ``vendor_delete`` deleted."""
    return vendor.join(outcomes.filter(F.col("outcome") == "deleted").select("vendor_id"), "vendor_id", "left_anti")


# ---------------------------------------------------------------- cascades
def cascade_delete(orders: DataFrame, sub_orders: DataFrame, items: DataFrame, product: DataFrame,
                   tag: DataFrame, tagging: DataFrame, del_orders: DataFrame | None = None,
                   del_products: DataFrame | None = None, del_tags: DataFrame | None = None) -> dict[str, DataFrame]:
    """deletes with the schema's cascades.

    Orders take their sub-orders and items along; products and tags take
    their tagging rows; a product still named by an order item is not
    deleted (order deletes of the same batch apply first).
    """
    o, so, it, p, t, tg = orders, sub_orders, items, product, tag, tagging
    if del_orders is not None:
        d = del_orders.select("order_id").distinct()
        o = o.join(d, "order_id", "left_anti")
        so = so.join(d, "order_id", "left_anti")
        it = it.join(so.select("sub_order_id"), "sub_order_id", "left_semi")
    blocked = None
    if del_products is not None:
        d = del_products.select("product_id").distinct().join(p.select("product_id"), "product_id", "left_semi")
        referenced = it.select("product_id").distinct()
        blocked = d.join(referenced, "product_id", "left_semi")
        gone = d.join(referenced, "product_id", "left_anti")
        p = p.join(gone, "product_id", "left_anti")
        tg = tg.join(gone, "product_id", "left_anti")
    if del_tags is not None:
        d = del_tags.select("tag_id").distinct()
        t = t.join(d, "tag_id", "left_anti")
        tg = tg.join(d, "tag_id", "left_anti")
    out = {"orders": o, "sub_orders": so, "order_items": it, "product": p, "tag": t, "tagging": tg}
    if blocked is not None:
        out["product_blocked"] = blocked
    return out


def customer_profile_update(profile: DataFrame, updates: DataFrame, order_cols: list[str]) -> DataFrame:
    """partial profile update; NULL leaves a field unchanged, else the
    last value by ``order_cols`` wins, per field."""
    fields = ["nick_name", "address", "phone_number"]
    last = updates.groupBy("user_id").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(*order_cols, F.col(c).alias("_v")))).alias(f"_{c}") for c in fields])
    return (profile.join(last, "user_id", "left")
            .select("user_id", *[F.coalesce(F.col(f"_{c}._v"), F.col(c)).alias(c) for c in fields]))
