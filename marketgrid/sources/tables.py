"""A1 ``load_shop``: the shop tables as typed DataFrames.

Raw tables are plain parquet scans, so Catalyst prunes columns and pushes
filters into each scan.  The shop tables themselves are views derived from
the raw tables.  With ``staged=True`` (the default) each view is derived
ONCE, written as parquet under the shared state root and read back - the
shop's stored tables, as an ETL step would leave them - so queries do not
re-derive, e.g., order items from line items in every branch of every plan.
A staged table is keyed by its view's text and those of all views below it
(text and DataFrame form) and by the version of every raw input (bytes, file
count, modification time), so changed inputs are staged anew.  It is written
with Spark's committer (a table without ``_SUCCESS`` is rebuilt).  Only when
EVERY raw input is read by fewer tasks than there are cores (so all of it is
small) is it hash-partitioned on its whole row first; a small dimension never
makes a wide fact table shuffle.
``staged=False`` keeps every view lazy; ``Shop.lazy`` is the same folder that
way, for plans that read a view once: a table written to be read once costs more
than its derivation, and Catalyst prunes what the plan leaves out.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orders import order_history_text
from ..session import size_session, state_root
from .views import ALL_VIEWS, RAW_TABLES, deps


def _priced_lines(shop: "Shop") -> DataFrame:
    """Order lines with their product's vendor and price, joined on the tables' own numbers.

    Rows with numbers are half as wide as rows with the ids made of them, so the
    ids are put together after the joins.
    """
    part = shop.spark.sql("SELECT p_partkey, p_partkey % (SELECT count(*) FROM {supplier}) vendor,"
                          " CAST(p_retailprice AS DECIMAL(10,2)) price FROM {part}",
                          supplier=shop["supplier"], part=shop["part"])
    quantity = F.col("l_quantity").cast("int")
    return (shop["lineitem"].join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select("l_orderkey", "l_linenumber", "p_partkey", quantity.alias("quantity"), "vendor", "price",
                    (quantity * F.col("price")).cast("decimal(10,2)").alias("total_price"),
                    (F.col("l_returnflag") == "R").alias("removed"), "l_linestatus"))


def _id(letter: str, number: str) -> Column:
    return F.concat(F.lit(letter), F.col(number).cast("string"))


def _sub_order_id() -> Column:
    return F.concat(_id("o", "l_orderkey"), F.lit("-"), _id("s", "vendor"))


def _order_items_form(shop: "Shop") -> DataFrame:
    """Spark form of ``shop_order_items`` (same rows as the fixture text)."""
    dash = F.lit("-")
    return _priced_lines(shop).select(
        F.concat(_id("i", "l_orderkey"), dash, F.col("l_linenumber").cast("string"), dash, _id("p", "p_partkey"), dash,
                 F.col("quantity").cast("string")).alias("order_item_id"),
        _id("o", "l_orderkey").alias("order_id"), _sub_order_id().alias("sub_order_id"), _id("s", "vendor").alias("merchant_id"),
        _id("p", "p_partkey").alias("product_id"), "quantity", F.col("price").alias("price_per_unit"), "total_price",
        F.when(F.col("removed"), "removed").otherwise("active").alias("item_status"), "l_linestatus")


def _sub_orders_form(shop: "Shop") -> DataFrame:
    """Spark form of ``shop_sub_orders`` (same rows as the fixture text).

    order_id is part of the group key, so the fixture's MAX over the order's
    status and date is just that order's value: aggregate the lines per
    sub-order first, then attach the order.  This keeps a hash aggregate (a
    string MAX forces a sort aggregate) and joins one row per sub-order
    instead of one per line.  Lines are dealt by order once, for both.
    """
    active = ~F.coalesce("removed", F.lit(False))
    agg = _priced_lines(shop).repartition("l_orderkey").groupBy("l_orderkey", "vendor").agg(
        F.sum(F.when(active, F.col("total_price")).otherwise(F.lit(0))).cast("decimal(22,2)").alias("sub_total_amount"),
        F.count(F.when(active, 1)).alias("_active"),
        F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("_shipped"))
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "shipped").otherwise("cancelled")
    o = shop["orders"].select("o_orderkey", status.alias("_status"), F.col("o_orderdate").alias("created_at"))
    return agg.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _sub_order_id().alias("sub_order_id"), _id("o", "l_orderkey").alias("order_id"), _id("s", "vendor").alias("merchant_id"),
        "sub_total_amount",
        F.when(F.col("_active") == 0, F.lit("cancelled")).otherwise(F.col("_status")).alias("status"),
        F.when(F.col("_shipped") == 1, F.lit("shipped")).otherwise(F.lit("pending")).alias("shipping_status"),
        "created_at")


def _history_form(shop: "Shop") -> DataFrame:
    """Spark form of ``shop_customer_history``: the table's JSON texts, built from the orders."""
    return order_history_text(shop["shop_customer_profile"], shop["shop_orders"])


# Views whose Spark plan is written with the DataFrame API (same rows as the text).
SPARK_FORMS = {"shop_order_items": _order_items_form, "shop_sub_orders": _sub_orders_form,
               "shop_customer_history": _history_form}

# Projections of one stored table, and tables a plan reads once: never written themselves.
DIRECT = {"shop_cart_line", "shop_orders", "shop_sub_order_change", "shop_view_request"}


class Shop:
    """Mapping from table/view name to DataFrame for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, staged: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.staged = staged
        self._frames: dict[str, DataFrame] = {}
        self._lazy: Shop | None = None

    @property
    def lazy(self) -> "Shop":
        """The same folder with every view lazy."""
        if not self.staged:
            return self
        if self._lazy is None:
            self._lazy = Shop(self.spark, self.sf_dir, staged=False)
        return self._lazy

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name if name in RAW_TABLES or name in ALL_VIEWS else f"shop_{name}"]

    def _build(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in ALL_VIEWS:
            raise KeyError(name)
        if self.staged and name not in DIRECT:
            return self._staged(name)
        return self._derive(name)

    def _derive(self, name: str) -> DataFrame:
        if name in SPARK_FORMS:
            return SPARK_FORMS[name](self)
        bound = {d: self[d] for d in deps(name)}
        return self.spark.sql(ALL_VIEWS[name], **bound)

    def _staged(self, name: str) -> DataFrame:
        key = hashlib.sha1("\n".join([self.sf_dir, *self._version(name)]).encode()).hexdigest()[:16]
        path = f"{state_root(self.spark)}/staged/{name}-{key}"
        if not _committed(self.spark, path):
            df = self._derive(name)
            n = self.spark.sparkContext.defaultParallelism
            if self._narrow(name, n):
                # All inputs are read by fewer tasks than there are cores (e.g. one
                # row group): spread the rows so later scans run in parallel.
                df = df.repartition(n, *[df[c] for c in df.columns])
            # Write aside, then rename into place: concurrent stagers of the
            # same view never write into one folder, and the loser of the
            # rename reads the winner's committed table.
            tmp = f"{path}.tmp-{uuid.uuid4().hex}"
            df.write.parquet(tmp)
            _publish(self.spark, tmp, path)
        return self.spark.read.parquet(path)

    def raw_bytes(self) -> int:
        """Bytes of the raw tables (file listing only)."""
        found = [_fs(self.spark, f"{self.sf_dir}/{t}.parquet") for t in RAW_TABLES]
        return sum(fs.getContentSummary(path).getLength() for path, fs in found if fs.exists(path))

    def _raw_inputs(self, name: str) -> set[str]:
        if name in RAW_TABLES:
            return {name}
        return set().union(*[self._raw_inputs(d) for d in deps(name)]) if deps(name) else set()

    def _narrow(self, name: str, n: int) -> bool:
        """True when every raw input scans in fewer partitions than ``n`` (file
        listing only, no job)."""
        return all(self[t].rdd.getNumPartitions() < n for t in self._raw_inputs(name))

    def _version(self, name: str) -> list[str]:
        """Texts, forms and input versions that ``name`` depends on, transitively."""
        if name in RAW_TABLES:
            path, fs = _fs(self.spark, f"{self.sf_dir}/{name}.parquet")
            c = fs.getContentSummary(path)
            return [f"{name} {c.getLength()} {c.getFileCount()} {fs.getFileStatus(path).getModificationTime()}"]
        form = SPARK_FORMS.get(name)
        own = [ALL_VIEWS[name], *[inspect.getsource(f) for f in ([form, _priced_lines] if form else [])]]
        return own + [v for d in deps(name) for v in self._version(d)]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, tmp: str, path: str) -> None:
    """Move a finished table into place unless another stager already did.

    (A Hadoop rename onto an existing folder would nest the source inside
    it, so an existing committed table wins and the copy is dropped.)
    """
    src, fs = _fs(spark, tmp)
    dst, _ = _fs(spark, path)
    if fs.exists(dst):
        if _committed(spark, path):
            fs.delete(src, True)
            return
        fs.delete(dst, True)  # leftovers without _SUCCESS
    if not fs.rename(src, dst):
        fs.delete(src, True)
    if not _committed(spark, path):
        raise RuntimeError(f"staged table {path} was not committed")


def _committed(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_shop(spark: SparkSession, sf_dir: str, staged: bool = True) -> Shop:
    shop = Shop(spark, sf_dir, staged)
    size_session(spark, shop.raw_bytes())
    return shop
