"""E: ratings.  The rating table is append-only; history is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round2


def latest_ratings(rating: DataFrame) -> DataFrame:
    """Newest rating per (customer, vendor); ties broken by the larger id.

    A max over a struct is a plain partial aggregate, no window sort.
    """
    newest = F.max(F.struct("created_at", "id", "score")).alias("r")
    return (rating.groupBy("customer_id", "vendor_id").agg(newest)
            .select("customer_id", "vendor_id", F.col("r.id").alias("id"), F.col("r.score").alias("score")))


def customer_ratings(rating: DataFrame, vendor: DataFrame) -> DataFrame:
    """Ratings with the vendor's store name (LEFT JOIN)."""
    return (rating.join(vendor.select("vendor_id", "store_name"), "vendor_id", "left")
            .select("id", "customer_id", "vendor_id", "score", "store_name"))


def rating_intake(requests: DataFrame) -> DataFrame:
    """Parse the submitted score: non-numbers become 0; 1..5 accepted."""
    score = F.coalesce(F.col("score_text").try_cast("int"), F.lit(0))
    return (requests.withColumn("score", score)
            .select("id", "customer_id", "vendor_id", "score", "created_at",
                    F.col("score").between(1, 5).alias("accepted")))


def append_ratings(rating: DataFrame, intake: DataFrame) -> DataFrame:
    """Rating table after the accepted requests are appended."""
    new = intake.filter("accepted").select(*rating.columns)
    return rating.unionByName(new)


def vendor_rating_sync(vendor: DataFrame, rating: DataFrame, touched: DataFrame) -> DataFrame:
    """Vendor.Rating := two-place average of ALL its ratings, for vendors
    that just received an accepted rating, when the average is within 0..5."""
    avg = (rating.join(touched.select("vendor_id").distinct(), "vendor_id", "left_semi")
           .groupBy("vendor_id").agg(round2(F.avg("score")).alias("new_rating")))
    ok = F.col("new_rating").between(0, 5)
    return (vendor.join(avg, "vendor_id", "left")
            .withColumn("rating", F.when(ok, F.col("new_rating").cast("decimal(3,2)")).otherwise(F.col("rating")))
            .drop("new_rating"))
