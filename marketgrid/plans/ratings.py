"""Registered rating queries (E) and user queries (G, F12)."""

from __future__ import annotations

from ..operators import ratings as R
from ..operators import users as U
from .registry import register


@register("latest_ratings", """
SELECT customer_id, vendor_id, id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY customer_id, vendor_id ORDER BY created_at DESC, id DESC) rn
 FROM shop_rating) x WHERE rn = 1""")
def q_latest_ratings(shop):
    return R.latest_ratings(shop.shop_rating)


@register("customer_ratings", """
SELECT r.id, r.customer_id, r.vendor_id, r.score, v.store_name
FROM shop_rating r LEFT JOIN shop_vendor v ON r.vendor_id = v.vendor_id""")
def q_customer_ratings(shop):
    return R.customer_ratings(shop.shop_rating, shop.shop_vendor)


_INTAKE = """SELECT id, customer_id, vendor_id, coalesce(TRY_CAST(score_text AS INTEGER), 0) score, created_at
 FROM shop_rating_request"""


@register("rating_intake", f"""
SELECT id, customer_id, vendor_id, score, score BETWEEN 1 AND 5 accepted FROM ({_INTAKE}) x""")
def q_rating_intake(shop):
    return R.rating_intake(shop.shop_rating_request).drop("created_at")


@register("vendor_rating_sync", f"""
WITH acc AS (SELECT * FROM ({_INTAKE}) x WHERE score BETWEEN 1 AND 5),
allr AS (SELECT vendor_id, score FROM shop_rating UNION ALL SELECT vendor_id, score FROM acc),
a AS (SELECT vendor_id, floor(avg(score) * 100 + 0.5) / 100 r FROM allr
 WHERE vendor_id IN (SELECT vendor_id FROM acc) GROUP BY vendor_id)
SELECT v.vendor_id, CAST(CASE WHEN a.r BETWEEN 0 AND 5 THEN CAST(a.r AS DECIMAL(3,2)) ELSE v.rating END AS DOUBLE) rating
FROM shop_vendor v LEFT JOIN a ON a.vendor_id = v.vendor_id""")
def q_vendor_rating_sync(shop):
    intake = R.rating_intake(shop.shop_rating_request)
    ratings = R.append_ratings(shop.shop_rating, intake)
    touched = intake.filter("accepted").select("vendor_id")
    out = R.vendor_rating_sync(shop.shop_vendor, ratings, touched)
    return out.select("vendor_id", out["rating"].cast("double").alias("rating"))


@register("user_roles", """
SELECT user_id, (role_bits & 1) <> 0 is_customer, (role_bits & 2) <> 0 is_vendor, (role_bits & 4) <> 0 is_admin,
 (role_bits & 6) <> 0 is_backend FROM shop_user""")
def q_user_roles(shop):
    return U.user_roles(shop.shop_user)


@register("user_directory", "SELECT user_id id, username, role_bits role FROM shop_user")
def q_user_directory(shop):
    return U.user_directory(shop.shop_user)


@register("user_role_add", """
SELECT u.user_id, u.role_bits | coalesce(g.b, 0) role_bits
FROM shop_user u LEFT JOIN (SELECT user_id, bit_or(bits) b FROM shop_role_grant GROUP BY user_id) g
 ON g.user_id = u.user_id""")
def q_user_role_add(shop):
    return U.user_role_add(shop.shop_user, shop.shop_role_grant).select("user_id", "role_bits")
