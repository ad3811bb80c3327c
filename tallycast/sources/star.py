"""Order lines out of the star-schema tables lineitem, orders, part, supplier, customer, nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Raw column -> dimension tables its expression needs besides lineitem.
_NEEDS = {
    "Ordered Item": (),
    "SO Remaining Qty": (),
    "Booked Date": ("orders",),
    "SO Line Amount EGP": (),
    "Shipped Amount [USD]": (),
    "Not Shipped Amount [USD]": (),
    "Shipped Qty": (),
    "Cancelled Qty": (),
    "Calculated Weight (Kg)": ("part",),
    "Unit Weight (Kg)": ("part",),
    "Country": ("orders", "customer", "nation"),
    "Order System": ("part",),
    "Factory Name": ("supplier",),
    "Cell Columns": ("part",),
    "Item Class": ("orders", "customer"),
    "Order Number": (),
    "Description": ("part",),
}

# Demo alias table for the p_type values; SMALL is left out on purpose.
SYSTEM_ALIASES = {
    "SYS01: Economy": ["economy", "Eco"],
    "SYS02: Large": ["Large"],
    "SYS03: Medium": ["MEDIUM"],
    "SYS04: Promo": ["promo"],
    "SYS05: Standard": ["Standard"],
    "SYS06: Reserve": [],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Raw order lines with the asked columns; dimensions no column needs are not joined.

    All joins are equi-joins on table keys; order, customer and nation are joined to each
    other first, so that the lines meet them once. None carries a broadcast hint: the
    dimensions grow with the data, so Spark compares their size with its broadcast
    threshold and otherwise sort-merges, splitting hot keys at run time. Only
    ``nation``, which has one row per country, is always small.
    """
    columns = list(columns or _NEEDS)
    needed = {t for c in columns for t in _NEEDS[c]}
    df = table(spark, sf_dir, "lineitem")
    if "orders" in needed:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        if "customer" in needed:
            customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
            if "nation" in needed:
                nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
                customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in needed:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        df = df.join(part, F.col("l_partkey") == F.col("p_partkey"))
    if "supplier" in needed:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        df = df.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))

    qty, price = F.col("l_quantity"), F.col("l_extendedprice")
    returned, shipped = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    even = F.col("l_linenumber") % 2 == 0
    code = F.col("l_partkey").cast("string")
    zero = F.lit(0.0)
    exprs = {
        "Ordered Item": lambda: F.when(even, F.concat(F.lit("  p-"), code, F.lit("\t"))).otherwise(
            F.concat(F.lit("P-"), code)
        ),
        "SO Remaining Qty": lambda: F.when(~shipped & ~returned, qty).otherwise(zero),
        "Booked Date": lambda: F.col("o_orderdate"),
        "SO Line Amount EGP": lambda: F.round(price * 30, 2),
        "Shipped Amount [USD]": lambda: F.when(shipped, price).otherwise(zero),
        "Not Shipped Amount [USD]": lambda: F.when(~shipped, price).otherwise(zero),
        "Shipped Qty": lambda: F.when(shipped & ~returned, qty).otherwise(zero),
        "Cancelled Qty": lambda: F.when(returned, qty).otherwise(zero),
        "Calculated Weight (Kg)": lambda: F.when(~even, F.col("p_size") * qty),
        "Unit Weight (Kg)": lambda: F.col("p_size"),
        "Country": lambda: F.col("n_name"),
        "Order System": lambda: F.col("p_type"),
        "Factory Name": lambda: F.concat(F.lit("FACTORY_"), F.col("s_nationkey").cast("string")),
        "Cell Columns": lambda: F.col("p_brand"),
        "Item Class": lambda: F.col("c_mktsegment"),
        "Order Number": lambda: F.col("l_orderkey").cast("string"),
        "Description": lambda: F.col("p_name"),
    }
    return df.select(*[exprs[c]().alias(c) for c in columns])


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as text with every kind of dirt, at fixed remainders of the keys.

    Missing, blank and ``nan`` codes and names, mixed case, outer blanks, numbers that are negative or unreadable, dates
    in three layouts, unreadable or missing.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("q"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))

    def case(key: str, by: int, *values):
        c = F.col(key) % by
        out = F.when(c == 0, values[0])
        for k, v in enumerate(values[1:], 1):
            out = out.when(c == k, v)
        return out

    day = lambda pattern: F.date_format("o_orderdate", pattern)
    code, q, kind = F.concat(F.lit("p-"), F.col("l_partkey").cast("string")), F.col("q"), F.col("p_type")
    return df.select(
        case("l_orderkey", 9, F.lit(None).cast("string"), F.lit(" nan "), F.upper(code), F.concat(F.lit("\t"), code, F.lit(" ")), code, code, code, code, code).alias("Ordered Item"),
        case("l_linenumber", 5, q, F.concat(F.lit("-"), q), F.lit("n/a"), F.lit(None).cast("string"), F.concat(F.lit(" "), q, F.lit(".5 "))).alias("SO Remaining Qty"),
        case("l_orderkey", 5, day("yyyy-MM-dd"), day("dd/MM/yyyy"), day("yyyyMMdd"), F.lit("soon"), F.lit(None).cast("string")).alias("Booked Date"),
        case("l_partkey", 6, F.lit(None).cast("string"), F.lit("  "), F.lit("NAN"), F.lower(kind), F.concat(F.lit("  "), kind, F.lit("\n")), kind).alias("Order System"),
        case("l_orderkey", 4, F.lit(None).cast("string"), F.lit("nan"), F.lit(" Land "), F.lit("Land")).alias("Country"),
        case("l_orderkey", 3, F.lit(None).cast("string"), F.col("l_orderkey").cast("string"), F.lit("")).alias("Order Number"),
    )


def item_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Standard and Prime code lists derived from part; they overlap."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    code = F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("code")
    return part.where("p_partkey % 3 = 0").select(code), part.where("p_partkey % 10 = 0").select(code)
