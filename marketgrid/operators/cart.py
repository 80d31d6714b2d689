"""Carts as a state that adds, increases, decreases and removals change in order.

The reference changes one session's cart per request.  Here every event of
every cart is applied in one job: per (cart, product) the quantity q, 0 when the
line is not in the cart, goes through one step per event, with s the stock:

- add n (only an Active product of an Active vendor): min(s, q + n), floor 0;
  n may be negative, and a missing n counts as 1;
- increase (line in the cart, product shown): q + 1 unless that exceeds s;
- decrease (line in the cart, product shown): q - 1;
- remove: 0, whatever the product's state.

A line may start above a stock that has fallen since: increases leave it alone,
decreases lower it by one, an add cuts it to the stock.

Scan.  Within 0..s every step is a map of the form "q <= z: e, else
min(hi, max(lo, q + a))", and such maps compose to one of that form (z and e
keep lines that are not in the cart apart: an increase does not revive them).
So a (cart, product) with very many events is cut into chunks of bounded rows,
composed with numpy inside each (doubling, no loop over rows), and the chunks'
maps are carried from chunk to chunk.  A line that starts above the stock falls
by one a decrease until the step that lands within 0..s; that step's place comes
from a running count, carried over the chunks alike, and it enters the scan as a
constant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ACTIVE, INACTIVE
from ..functions.scan import CHUNK_ROWS, kept_rows, range_chunks
from ..session import ship_library

LINE = ["cart_id", "product_id"]
ORDER = ["ts", "event_id"]
MAP = ["z", "e", "a", "lo", "hi"]


def cart_steps(events: DataFrame, start: DataFrame, product: DataFrame, vendor: DataFrame) -> DataFrame:
    """Events with what they do (add, increase, decrease, remove or nothing), n, stock s and start quantity q0."""
    active = vendor.filter(F.col("status") == ACTIVE).select("vendor_id")
    shown = product.filter(F.col("status") != INACTIVE).join(active, "vendor_id", "left_semi") \
        .select("product_id", F.col("stock").cast("bigint").alias("s"), F.col("status").alias("p_status"))
    kind = (F.when(F.col("action") == "remove", "remove")
            .when((F.col("action") == "add") & (F.col("p_status") == ACTIVE), "add")
            .when(F.col("action").isin("increase", "decrease") & F.col("s").isNotNull(), F.col("action"))
            .otherwise("nothing"))
    e = events.select("event_id", "ts", *LINE, "action", "quantity").join(shown, "product_id", "left")
    lines = start.select(*LINE, F.col("quantity").cast("bigint").alias("q0"))
    return (e.join(lines, LINE, "left")
            .select("event_id", "ts", *LINE, kind.alias("kind"),
                    F.coalesce("quantity", F.lit(1)).cast("bigint").alias("n"),
                    # an unknown or hidden product changes a line only by removal, so its stock plays no part
                    F.coalesce("s", F.col("q0"), F.lit(0)).alias("s"), F.coalesce("q0", F.lit(0)).alias("q0")))


def _falls(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that start above the stock: (place and value of the step that lands, q after each step before it)."""
    high = steps.filter(F.col("q0") > F.col("s"))
    down = (F.col("kind") == "decrease").cast("bigint")
    inside = Window.partitionBy(*LINE, "chunk").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*LINE).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = high.groupBy(*LINE, "chunk").agg(F.sum(down).alias("_d")) \
        .select(*LINE, "chunk", F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_before"))
    q = F.col("q0") - F.col("_before") - F.sum(down).over(inside)
    at = high.join(carried, [*LINE, "chunk"]).withColumn("q", q)
    lands = (F.col("q") <= F.col("s")) | F.col("kind").isin("add", "remove")
    added = F.greatest(F.lit(0), F.least(F.col("s"), F.col("q") + F.col("n")))
    # an add that stays above the stock is cut to it, so it lands as well
    value = F.when(F.col("kind") == "remove", 0).when(F.col("kind") == "add", added).otherwise(F.col("s"))
    landing = at.filter(lands).groupBy(*LINE).agg(F.min(F.struct(*ORDER, value.alias("value"))).alias("land"))
    return landing, at.select("event_id", "q")


def _compose(f: list[np.ndarray], g: list[np.ndarray]) -> list[np.ndarray]:
    """g after f, both as (z, e, a, lo, hi)."""
    z, e, a, lo, hi = f
    z2, e2, a2, lo2, hi2 = g
    ge = np.where(e <= z2, e2, np.minimum(hi2, np.maximum(lo2, e + a2)))
    cut_lo, cut_hi = np.minimum(hi2, np.maximum(lo2, lo + a2)), np.minimum(hi2, np.maximum(lo2, hi + a2))
    flat = hi <= z2  # all of f's values are in g's lower part
    zc = np.where(lo > z2, z, np.maximum(z, z2 - a))
    return [np.where(flat, -1, zc), np.where(flat, e2, ge), np.where(flat, 0, a + a2),
            np.where(flat, e2, cut_lo), np.where(flat, e2, cut_hi)]


def _scan_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk's rows in order, each with the map from the start of its line's run to after the row."""
    pdf = pdf.sort_values([*LINE, *ORDER], kind="stable").reset_index(drop=True)
    kind, n, s = pdf["kind"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["s"].to_numpy(np.int64)
    const = pdf["const"].to_numpy(np.float64)
    fixed = ~np.isnan(const)
    value = np.where(fixed, const, 0).astype(np.int64)
    fixed |= kind == "remove"
    add, up, down = kind == "add", kind == "increase", kind == "decrease"
    top = np.where(fixed, value, s)
    f = [np.where(up & ~fixed, 0, -1), np.zeros(len(s), np.int64),
         np.where(fixed, 0, np.where(add, n, up.astype(np.int64) - down)),
         np.where(fixed, value, 0), top]
    code = pd.factorize(pd.MultiIndex.from_frame(pdf[LINE]))[0]
    new = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
    at = np.arange(len(code))
    first = np.maximum.accumulate(np.where(new, at, 0))
    reach, longest = 1, int((at - first).max(initial=0))
    while reach <= longest:
        rows = np.flatnonzero(at - first >= reach)
        whole = _compose([x[rows - reach] for x in f], [x[rows] for x in f])
        for x, y in zip(f, whole):
            x[rows] = y
        reach *= 2
    for name, x in zip(MAP, f):
        pdf[name] = x
    last = np.concatenate((new[1:], [True]))
    pdf["run_end"] = last
    # only a chunk's first and last line can go on in another chunk
    pdf["edge"] = last & ((first == 0) | (at == len(at) - 1))
    return pdf.drop(columns=["kind", "n", "const"])


def _carry(pdf: pd.DataFrame) -> pd.DataFrame:
    """Quantity a line enters each of its chunks with."""
    pdf = pdf.sort_values("chunk")
    q, enters = int(pdf["q0"].iloc[0]), []
    for z, e, a, lo, hi in pdf[MAP].itertuples(index=False):
        enters.append(q)
        q = e if q <= z else min(hi, max(lo, q + a))
    return pdf[[*LINE, "chunk"]].assign(q_in=enters)


def cart_history(events: DataFrame, start: DataFrame, product: DataFrame, vendor: DataFrame,
                 rows: int = CHUNK_ROWS) -> DataFrame:
    """(event_id, ts, cart_id, product_id, quantity) after every event; 0: not in the cart.

    Events are applied per (cart_id, product_id) in (ts, event_id) order, from
    the lines of ``start``.
    """
    steps = range_chunks(cart_steps(events, start, product, vendor), [*LINE, *ORDER], rows)
    landing, falling = _falls(steps)
    order = F.struct(*ORDER)
    land = F.struct(F.col("land.ts").alias("ts"), F.col("land.event_id").alias("event_id"))
    falls = F.col("q0") > F.col("s")
    joined = (steps.join(landing, LINE, "left")
              .withColumn("high", falls & (F.col("land").isNull() | (order < land)))
              .withColumn("const", F.when(falls & (order == land), F.col("land.value")).cast("double"))
              .withColumn("kind", F.when(F.col("high"), "nothing").otherwise(F.col("kind")))
              .drop("land"))
    kept = joined.drop("kind", "n", "const")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields) + ", " \
        + ", ".join(f"{c} long" for c in MAP) + ", run_end boolean, edge boolean"
    ship_library(events.sparkSession)
    scanned = kept_rows(joined.groupBy("chunk").applyInPandas(_scan_chunk, schema))
    ends = scanned.filter("edge").select(*LINE, "chunk", "q0", *MAP)
    line_type = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ends.select(*LINE).schema.fields)
    entered = ends.groupBy(*LINE).applyInPandas(_carry, f"{line_type}, chunk int, q_in long")
    q = F.coalesce("q_in", F.col("q0"))
    mapped = F.when(q <= F.col("z"), F.col("e")).otherwise(F.least("hi", F.greatest(F.col("lo"), q + F.col("a"))))
    return (scanned.join(entered, [*LINE, "chunk"], "left").join(falling, "event_id", "left")
            .select("event_id", "ts", *LINE,
                    F.when(F.col("high"), F.col("q")).otherwise(mapped).cast("bigint").alias("quantity")))


def cart_state(start: DataFrame, history: DataFrame) -> DataFrame:
    """Carts after all events: the last quantity of every touched line, other lines as they were."""
    last = history.groupBy(*LINE).agg(F.max(F.struct(*ORDER, "quantity")).alias("l")) \
        .select(*LINE, F.col("l.quantity").alias("_q"))
    return (start.select(*LINE, F.col("quantity").cast("bigint").alias("_q0")).join(last, LINE, "full")
            .select(*LINE, F.coalesce("_q", "_q0").alias("quantity")).filter("quantity > 0"))
