"""The driver's tables as a catalogue.

product: parts, with references to suppliers (grouped by nation) and to brands,
and prices from order lines; geo: regions, nations and suppliers as one tree;
brand; order: orders, those that are finished being archived, with a reference
to customers; customer. Numbers are decimals, so that sums don't depend on order;
keys stay as the tables have them, so that comparisons with them reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.catalog import Attribute, Catalog, Collection, Reference, reflected

#: Keys of the tree: regions from 1, nations from 101, suppliers from 1001.
REGION, NATION, SUPPLIER = 1, 101, 1001


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    low = F.when(size % 5 != 0, size)
    high = F.when(size % 4 != 0, size + 10)
    even = F.col("p_partkey") % 2 == 0
    return part.select(
        F.col("p_partkey").alias("pk"),
        F.when(size % 10 == 0, "ARCHIVED").otherwise("LIVE").alias("scope"),
        F.when(even, F.array(F.lit("en"), F.lit("cs"))).otherwise(F.array(F.lit("en"))).alias("locales"),
        F.when(size % 3 == 0, "NONE").when(size % 3 == 1, "LOWEST_PRICE").otherwise("SUM").alias("inner_record_handling"),
        F.concat(F.lit("P-"), F.col("p_partkey")).alias("code"),
        F.when(even, F.create_map(F.lit("en"), "p_name", F.lit("cs"), F.upper("p_name"))).otherwise(F.create_map(F.lit("en"), F.col("p_name"))).alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        size.alias("size"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("list_price"),
        F.split("p_name", " ").alias("tags"),
        F.when(size % 7 != 0, size % 2 == 0).alias("available"),
        F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("from"), high.alias("to"))).alias("validity"),
        F.concat(F.lit('{"brand":"'), "p_brand", F.lit('"}')).alias("note"),
    )


def prices(lineitem: DataFrame) -> DataFrame:
    net = F.col("l_extendedprice").cast("decimal(12,2)")
    return lineitem.select(
        F.col("l_partkey").alias("pk"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("price_id"),
        F.col("l_returnflag").alias("price_list"),
        F.col("l_linestatus").alias("currency"),
        F.col("l_suppkey").alias("inner_record_id"),
        net.alias("price_without_tax"),
        (net * (1 + F.col("l_tax").cast("decimal(4,2)"))).cast("decimal(12,2)").alias("price_with_tax"),
        F.col("l_shipdate").alias("valid_from"),
        (F.col("l_shipdate") + F.expr("INTERVAL 365 DAYS")).alias("valid_to"),
        (F.col("l_quantity") >= 5).alias("indexed"),
    )


def supply(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """One edge for each part and supplier, grouped by the supplier's nation."""
    edges = lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("decimal(14,2)").alias("quantity"), F.count(F.lit(1)).cast("int").alias("lines"))
    return edges.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("pk"), (F.col("l_suppkey") + SUPPLIER).cast("int").alias("ref_pk"), (F.col("s_nationkey") + NATION).cast("int").alias("group_pk"), "quantity", "lines"
    )


def geo(region: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    live = F.lit("LIVE").alias("scope")
    none = F.lit(None).cast("decimal(12,2)").alias("balance")
    top = region.select((F.col("r_regionkey") + REGION).cast("int").alias("pk"), live, F.lit(None).cast("int").alias("parent_pk"), F.col("r_name").alias("name"), F.lit("region").alias("kind"), none)
    mid = nation.select((F.col("n_nationkey") + NATION).cast("int").alias("pk"), live, (F.col("n_regionkey") + REGION).cast("int").alias("parent_pk"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"), none)
    low = supplier.select((F.col("s_suppkey") + SUPPLIER).cast("int").alias("pk"), live, (F.col("s_nationkey") + NATION).cast("int").alias("parent_pk"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_acctbal").cast("decimal(12,2)").alias("balance"))
    return top.unionByName(mid).unionByName(low)


def _brand_key(column: str) -> F.col:
    return F.regexp_extract(column, r"(\d+)$", 1).cast("int")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    part, lineitem, supplier, nation, region, orders, customer = (_read(spark, sf_dir, t) for t in ("part", "lineitem", "supplier", "nation", "region", "orders", "customer"))
    brand_edges = part.select(F.col("p_partkey").alias("pk"), _brand_key("p_brand").alias("ref_pk"), F.lit(None).cast("int").alias("group_pk"))
    brands = part.select("p_brand").distinct().select(_brand_key("p_brand").alias("pk"), F.lit("LIVE").alias("scope"), F.col("p_brand").alias("name"), (_brand_key("p_brand") % 5).alias("priority"))
    order_rows = orders.select(
        F.col("o_orderkey").alias("pk"), F.when(F.col("o_orderstatus") == "F", "ARCHIVED").otherwise("LIVE").alias("scope"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("total"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("priority"),
    )
    customers = customer.select(F.col("c_custkey").alias("pk"), F.lit("LIVE").alias("scope"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))
    product = Collection(
        "product", products(part),
        {
            "code": Attribute(unique=True), "name": Attribute(localized=True), "brand": Attribute(), "type": Attribute(), "size": Attribute("int"), "list_price": Attribute("decimal"),
            "tags": Attribute(array=True), "available": Attribute("boolean"), "validity": Attribute("int", range=True),
        },
        {
            "suppliers": Reference(supply(lineitem, supplier), "geo", "geo", True, {"quantity": Attribute("decimal"), "lines": Attribute("int")}),
            "brand": Reference(brand_edges, "brand", None, True),
        },
        prices(lineitem), compounds={"brand_size": (("brand", "ASC", "LAST"), ("size", "DESC", "LAST"))}, associated=("note",),
    )
    back = {"products": reflected(product.references["suppliers"], "product")}
    tree = Collection("geo", geo(region, nation, supplier), {"name": Attribute(), "kind": Attribute(), "balance": Attribute("decimal")}, back, hierarchical=True)
    brand = Collection("brand", brands, {"name": Attribute(), "priority": Attribute("int")})
    order = Collection(
        "order", order_rows, {"status": Attribute(), "total": Attribute("decimal"), "day": Attribute("date"), "priority": Attribute()},
        {"customer": Reference(orders.select(F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("ref_pk"), F.lit(None).cast("int").alias("group_pk")), "customer")},
    )
    return Catalog({c.name: c for c in (product, tree, brand, order, Collection("customer", customers, {"name": Attribute(), "segment": Attribute(), "balance": Attribute("decimal")}))})
