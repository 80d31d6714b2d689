"""The reference's own sample data (8 products, 2 vendors, 9 tags) as DataFrames.

Fixed values: rows as given by the reference's seed script.
"""

from decimal import Decimal

from pyspark.sql import functions as F

PRODUCTS = [
    ("p1", "High-Performance Laptop", "", "5999.00", 50, "u4", "5.00"),
    ("p2", "Ergonomic Office Chair", "", "899.00", 50, "u5", "5.00"),
    ("p3", "Wireless Headphones", "", "1299.00", 50, "u4", "5.00"),
    ("p4", "Gaming Laptop Pro 16", "High-end gaming laptop with dedicated graphics.", "8999.00", 25, "u4", "4.90"),
    ("p5", "Business Ultrabook 14", "Lightweight business laptop with long battery life.", "6999.00", 30, "u4", "4.80"),
    ("p6", "Mini Desktop PC", "Compact desktop computer for office and home use.", "4599.00", 18, "u5", "4.70"),
    ("p7", "All-in-One Workstation", "Large-screen all-in-one computer for productivity.", "7599.00", 12, "u5", "4.80"),
    ("p8", "Student Notebook Air", "Affordable notebook designed for study and daily tasks.", "3999.00", 40, "u4", "4.60"),
]
TAGS = ["Computer", "Tech", "Office", "Ergonomic", "Audio", "Gaming", "Laptop", "Desktop", "Portable"]
TAGGING = {
    "p1": ["Computer", "Tech"], "p2": ["Office", "Ergonomic"], "p3": ["Audio"],
    "p4": ["Computer", "Gaming", "Laptop"], "p5": ["Computer", "Laptop", "Portable"],
    "p6": ["Computer", "Desktop", "Office"], "p7": ["Computer", "Desktop", "Office"],
    "p8": ["Computer", "Laptop", "Portable"],
}
USERS = [("u1", "admin", 4), ("u2", "customer1", 1), ("u3", "customer2", 1), ("u4", "vendor1", 2), ("u5", "vendor2", 2)]
VENDORS = [("u4", "Digital Store", "Beijing", "Active", "4.80", 1), ("u5", "Home Living", "Shanghai", "Active", "4.50", 2)]


def build_seed(spark):
    product = spark.createDataFrame(
        [(pid, n, d, Decimal(p), s, "Electronics", f"img/{pid}", v, "Active", Decimal(r), 0)
         for pid, n, d, p, s, v, r in PRODUCTS],
        "product_id string, name string, description string, price decimal(10,2), stock int, category string, "
        "image_url string, vendor_id string, status string, rating decimal(3,2), created_seq bigint")
    vendor = spark.createDataFrame(
        [(a, b, c, d, Decimal(e), f) for a, b, c, d, e, f in VENDORS],
        "vendor_id string, store_name string, location string, status string, rating decimal(3,2), created_seq bigint")
    tag = spark.createDataFrame([(i + 1, t) for i, t in enumerate(TAGS)], "tag_id int, name string")
    ids = {t: i + 1 for i, t in enumerate(TAGS)}
    tagging = spark.createDataFrame(
        [(p, ids[t], pos + 1) for p, ts in TAGGING.items() for pos, t in enumerate(ts)],
        "product_id string, tag_id int, position int")
    users = spark.createDataFrame(USERS, "user_id string, username string, role_bits int")
    return {"product": product, "vendor": vendor, "tag": tag, "tagging": tagging, "users": users}


def ids(df, col="product_id"):
    return sorted(r[0] for r in df.select(col).collect())


def with_stock(product, stock_df):
    """Product table with the stock column taken from (product_id, stock_after)."""
    s = stock_df.select("product_id", F.col("stock_after").cast("int").alias("_s"))
    return product.join(s, "product_id", "left").withColumn("stock", F.coalesce("_s", "stock")).drop("_s")
