"""G: user roles as a bitmask (1 customer, 2 vendor, 4 admin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ROLE_ADMIN, ROLE_CUSTOMER, ROLE_VENDOR, has_role


def user_roles(users: DataFrame) -> DataFrame:
    """G1: role flags and the backend test (vendor OR admin)."""
    return users.select("user_id",
                        has_role("role_bits", ROLE_CUSTOMER).alias("is_customer"),
                        has_role("role_bits", ROLE_VENDOR).alias("is_vendor"),
                        has_role("role_bits", ROLE_ADMIN).alias("is_admin"),
                        has_role("role_bits", ROLE_VENDOR | ROLE_ADMIN).alias("is_backend"))


def user_directory(users: DataFrame) -> DataFrame:
    """Id, username, role (no password column exists here)."""
    return users.select(F.col("user_id").alias("id"), "username", F.col("role_bits").alias("role"))


def user_role_add(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Role_Bits := Role_Bits | bits, all grants of a user OR-ed first."""
    g = grants.groupBy("user_id").agg(F.bit_or(F.col("bits").cast("int")).alias("_g"))
    return (users.join(g, "user_id", "left")
            .withColumn("role_bits", F.col("role_bits").bitwiseOR(F.coalesce("_g", F.lit(0))))
            .drop("_g"))
