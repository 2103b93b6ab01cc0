"""Profile, query, aggregate and transform steps, and the sales reports built on them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.sources.addresses import with_files
from tidemill.sources.files import bind_inputs, read_source, write_sink


def profile(df: DataFrame, sample: int = 3, show_columns: bool = True, show_sample: bool = True) -> dict:
    """Rows, columns with types, and the first rows of a table; counts and sample are one job each."""
    out: dict = {"row_count": df.count()}
    if show_columns:
        out["columns"] = [(f.name, f.dataType.simpleString()) for f in df.schema]
    if show_sample:
        out["sample"] = [r.asDict() for r in df.limit(sample).collect()]
    return out


def profile_columns(df: DataFrame) -> DataFrame:
    """column, type, rows and nulls of each column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{k}") for k, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("rows"), F.col(f"_{k}").alias("nulls")) for k, f in enumerate(df.schema)]
    return counts.select(F.inline(F.array(*cells)))


def run_query(spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """SQL over named tables, and over files addressed in it (see :func:`with_files`)."""
    bind_inputs(spark, views or {})
    return spark.sql(with_files(spark, sql))


def sql_summary(spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None) -> dict:
    df = run_query(spark, sql, views)
    return {"row_count": df.count(), "columns": df.columns}


def materialize(df: DataFrame, name: str, persist: bool = False) -> DataFrame:
    """Give a step's result a name that later steps can read; ``persist`` if several will."""
    df = df.persist() if persist else df
    df.createOrReplaceTempView(name)
    return df


def ordering(items: str | Column | Iterable[str | Column]) -> list[Column]:
    """Sort keys such as "total DESC" as columns, nulls last."""
    out = []
    for item in [items] if isinstance(items, (str, Column)) else items:
        if isinstance(item, Column):
            out.append(item)
            continue
        for part in item.split(",") if "(" not in item else [item]:
            words = part.strip().rsplit(None, 1)
            down = len(words) == 2 and words[1].upper() == "DESC"
            name = words[0] if len(words) == 2 and words[1].upper() in ("ASC", "DESC") else part.strip()
            out.append(F.expr(name).desc_nulls_last() if down else F.expr(name).asc_nulls_last())
    return out


def aggregate(df: DataFrame, group_by: Iterable, metrics: Iterable[Mapping], order_by=None, output_table: str | None = None) -> DataFrame:
    """Group by columns or expressions and compute named aggregates.

    Keys: a column, an expression, or {expr, alias}. Metrics: {column, function, alias}; the function
    defaults to count and may be any aggregate, the alias to function_column.
    """
    group_by, metrics = list(group_by or []), list(metrics or [])
    if not group_by or not metrics:
        raise ValueError("aggregate needs group_by and metrics")
    keys = [F.expr(k["expr"]).alias(k["alias"]) if isinstance(k, Mapping) else F.expr(k) if k in df.columns else F.expr(k).alias(k) for k in group_by]
    values = []
    for m in metrics:
        function, column = m.get("function") or "count", m.get("column") or "*"
        values.append(F.expr(f"{function}({column})").alias(m.get("alias") or f"{function}_{column}"))
    out = df.groupBy(*keys).agg(*values)
    if order_by:
        out = out.orderBy(*ordering(order_by))
    return materialize(out, output_table) if output_table else out


def transform(df: DataFrame, columns: Iterable[Mapping], output_table: str = "transformed_data") -> DataFrame:
    """All columns and derived ones {name, sql}, in one projection: an expression sees input columns only."""
    derived = [F.expr(c["sql"]).alias(c["name"]) for c in columns if c.get("name") and c.get("sql")]
    if not derived:
        return materialize(df, output_table)
    # fields of a struct cannot refer to each other, as columns of one select could
    packed = df.select("*", F.struct(*derived).alias("_derived"))
    return materialize(packed.select(*[F.col(f"`{c}`") for c in df.columns], "_derived.*"), output_table)


def transform_path(spark: SparkSession, src: str, dst: str, fmt: str | None = None, sql: str | None = None, out_fmt: str = "parquet") -> int:
    """Read a path, run optional SQL over it as ``input_data``, overwrite another path; returns rows written."""
    df = read_source(spark, src, fmt, view="input_data")
    return write_sink(spark.sql(sql) if sql else df, dst, out_fmt)


# --- reports ---------------------------------------------------------------------------------


def money(c: str | Column, scale: int = 4) -> Column:
    """Exact sums: doubles with few decimals as decimals."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def curate_orders(df: DataFrame, threshold: float = 1500) -> DataFrame:
    """Region in title case, amount in cents, and a priority."""
    amount = F.round(F.col("amount").cast("double"), 2)
    return df.withColumns({"region": F.initcap("region"), "amount": amount, "priority": F.when(amount >= threshold, "high").otherwise("standard")})


def sales_summary(df: DataFrame) -> DataFrame:
    """Rows (scope, name, value): totals, and revenue by region in order of names."""
    total = df.agg(F.count(F.lit(1)).cast("double").alias("row_count"), F.round(F.sum(money("amount")), 2).cast("double").alias("total_revenue"), F.count_if(F.col("priority") == "high").cast("double").alias("high_priority_orders"))
    totals = total.select(F.inline(F.array(*[F.struct(F.lit("total").alias("scope"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in total.columns])))
    regions = df.groupBy("region").agg(F.round(F.sum(money("amount")), 2).cast("double").alias("value")).select(F.lit("region").alias("scope"), F.col("region").alias("name"), "value")
    return totals.unionByName(regions)


def reconcile_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both counts and whether they agree."""
    counts = a.agg(F.count(F.lit(1)).alias("left_rows")).withColumn("k", F.lit(1)).join(b.agg(F.count(F.lit(1)).alias("right_rows")).withColumn("k", F.lit(1)), "k").drop("k")
    return counts.withColumn("status", F.when(F.col("left_rows") == F.col("right_rows"), "ok").otherwise("mismatch"))


def sales_kpis(df: DataFrame) -> DataFrame:
    """Gross, discount, net and revenue per unit of each sale."""
    return transform(
        df,
        [
            {"name": "gross_amount", "sql": "quantity * unit_price"},
            {"name": "discount_amount", "sql": "quantity * unit_price * discount_pct"},
            {"name": "net_amount", "sql": "quantity * unit_price * (1 - discount_pct)"},
            {"name": "revenue_per_unit", "sql": "try_divide(revenue, quantity)"},
        ],
        "sales_kpis",
    )


_REVENUE = "CAST(revenue AS DECIMAL(18,4))"


def _report(df: DataFrame, keys: list, order) -> DataFrame:
    out = aggregate(
        df,
        keys,
        [
            {"column": _REVENUE, "function": "sum", "alias": "total_revenue"},
            {"column": "CAST(quantity AS DECIMAL(18,4))", "function": "sum", "alias": "total_quantity"},
            {"column": "*", "function": "count", "alias": "orders"},
        ],
    )
    out = out.withColumns({"total_revenue": F.col("total_revenue").cast("double"), "total_quantity": F.col("total_quantity").cast("double")})
    return out.withColumn("avg_revenue", F.col("total_revenue") / F.col("orders")).orderBy(*ordering(order))


def revenue_by_category(df: DataFrame) -> DataFrame:
    return _report(df, ["category"], ["total_revenue DESC", "category"])


def revenue_by_region_quarter(df: DataFrame) -> DataFrame:
    return _report(df, ["region", "quarter"], ["region", "quarter"])


def daily_totals(df: DataFrame, time: str = "sale_date") -> DataFrame:
    return _report(df, [{"expr": f"CAST({time} AS DATE)", "alias": "day"}], ["day DESC"])


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The n products of most revenue; ties by name."""
    return _report(df, ["product", "category"], ["total_revenue DESC", "product", "category"]).limit(n)


def executive_report(df: DataFrame, n: int = 10) -> DataFrame:
    """Rows (section, name, value, share, rank): totals, shares by category, region and quarter, and ranked products.

    One pass groups by product, category, region and quarter; all sections come from that.
    """
    cube = df.groupBy("product", "category", "region", "quarter").agg(F.sum(money("revenue")).alias("v"), F.count(F.lit(1)).alias("n"))
    total = cube.agg(F.sum("v").cast("double").alias("total"), F.sum("n").alias("orders"))
    head = total.select(F.inline(F.array(
        F.struct(F.lit("total").alias("section"), F.lit("revenue").alias("name"), F.col("total").alias("value"), F.lit(1.0).alias("share"), F.lit(1).alias("rank")),
        F.struct(F.lit("total").alias("section"), F.lit("average_order_value").alias("name"), (F.col("total") / F.col("orders")).alias("value"), F.lit(None).cast("double").alias("share"), F.lit(1).alias("rank")),
    )))
    parts = []
    for section in ("category", "region", "quarter", "product"):
        by = cube.groupBy(F.col(section).cast("string").alias("name")).agg(F.sum("v").cast("double").alias("value"))
        ranked = by.join(total.select("total").withColumn("_k", F.lit(1)), F.lit(1) == F.col("_k")).withColumn("rank", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("value"), "name")))
        parts.append(ranked.filter(F.col("rank") <= n).select(F.lit(section).alias("section"), "name", "value", (F.col("value") / F.col("total")).alias("share"), "rank"))
    out = head
    for part in parts:
        out = out.unionByName(part)
    return out


#: Fixed values of generated sales: products and least and greatest price of each category, regions, and discounts in per cent as often as they stand here.
PRODUCTS = {
    "Electronics": ("Laptop Pro", "Wireless Headphones", "Smart Watch", 'Tablet 10"', "USB-C Hub"),
    "Apparel": ("Running Shoes", "Winter Jacket", "Yoga Pants", "Classic T-Shirt", "Denim Jeans"),
    "Home & Garden": ("Coffee Maker", "Plant Pot Set", "LED Desk Lamp", "Kitchen Scale", "Air Purifier"),
    "Sports": ("Yoga Mat", "Resistance Bands", "Water Bottle", "Gym Gloves", "Jump Rope"),
    "Books": ("Data Science Guide", "Python Cookbook", "Business Strategy", "Sci-Fi Novel", "History Atlas"),
    "Beauty": ("Face Serum", "Moisturizer SPF", "Lip Balm Kit", "Hair Mask", "Eye Cream"),
}
PRICES = {"Electronics": (49.99, 1299.99), "Apparel": (19.99, 249.99), "Home & Garden": (15.99, 199.99), "Sports": (9.99, 89.99), "Books": (9.99, 49.99), "Beauty": (12.99, 89.99)}
REGIONS = ("North", "South", "East", "West", "Central")
DISCOUNTS = (0, 0, 0, 5, 10, 15, 20)


def generate_sales(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Seeded sales rows: category, product of it, price within its range, quantity, discount, region and day are drawn evenly.

    Draws are hashes of row number and seed, so equal seeds give equal rows, whatever the number of partitions.
    """
    draw = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), most)
    pick = lambda values, salt: F.get(F.array(*values), draw(salt, F.lit(len(values))).cast("int"))
    cents = lambda x: round(x * 100)
    offers = [F.struct(F.lit(c).alias("category"), F.array(*map(F.lit, own)).alias("products"), F.lit(cents(PRICES[c][0])).alias("low"), F.lit(cents(PRICES[c][1])).alias("high")) for c, own in PRODUCTS.items()]
    rows = spark.range(n).withColumn("offer", pick(offers, 2))
    rows = rows.select(
        F.format_string("ORD-%05d", F.col("id") + 1).alias("order_id"), F.get("offer.products", draw(1, F.size("offer.products")).cast("int")).alias("product"), F.col("offer.category").alias("category"), pick([F.lit(r) for r in REGIONS], 3).alias("region"),
        (draw(4, F.lit(10)) + 1).cast("int").alias("quantity"), ((draw(5, F.col("offer.high") - F.col("offer.low") + 1) + F.col("offer.low")) / 100).alias("unit_price"),
        (pick([F.lit(x) for x in DISCOUNTS], 6) / 100).alias("discount_pct"), F.date_add(F.lit("2024-01-01").cast("date"), draw(7, F.lit(365)).cast("int")).alias("sale_date"),
    )
    revenue = F.round(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_pct")), 2)
    return rows.select("order_id", "product", "category", "region", "quantity", "unit_price", "discount_pct", revenue.alias("revenue"), "sale_date", F.month("sale_date").alias("month"), F.quarter("sale_date").alias("quarter"))
