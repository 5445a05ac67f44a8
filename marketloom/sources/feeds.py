"""Readers of landed feeds: JSON inventories, pages with embedded records, quoted CSV, name/value records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LISTING = "vin string, stock_no string, year int, make string, model string, trim string, condition string, odometer_km int, msrp double, list_price double, sale_price double, days_in_inventory int"
FEED_A = "vehicles array<struct<vin:string,stockNumber:string,year:int,make:string,model:string,trim:string,isNew:boolean,odometer:int,msrp:double,price:double,salePrice:double,entryMillis:bigint>>, pages int"
FEED_B = "results array<struct<vin:string,stock_number:string,year:int,make:string,model:string,trim:string,sale_class:string,odometer:int,msrp:double,internet_price:double,asking_price:double,days_in_stock:int>>, total int"
#: Earliest and latest entry time that a feed can mean.
ENTRY_FROM, ENTRY_TO = 946_684_800_000, 4_102_444_800_000


def inventory_a(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """LISTING rows of feed A: one document a page, entry time in milliseconds."""
    v = spark.read.schema(FEED_A).option("multiLine", True).json(path).select(F.explode("vehicles").alias("v")).select("v.*")
    entry = F.when(F.col("entryMillis").between(ENTRY_FROM, ENTRY_TO), F.to_date(F.timestamp_millis("entryMillis")))
    return v.select(
        F.upper(F.trim("vin")).alias("vin"), F.nullif("stockNumber", F.lit("")).alias("stock_no"), "year", "make", "model", "trim", F.when(F.col("isNew"), "new").when(~F.col("isNew"), "used").alias("condition"), F.col("odometer").alias("odometer_km"), "msrp",
        F.col("price").alias("list_price"), F.col("salePrice").alias("sale_price"), F.datediff(F.to_date(F.lit(as_of)), entry).alias("days_in_inventory"),
    )


def inventory_b(spark: SparkSession, path: str) -> DataFrame:
    """LISTING rows of feed B: the asking price stands before the internet price."""
    v = spark.read.schema(FEED_B).option("multiLine", True).json(path).select(F.explode("results").alias("v")).select("v.*")
    price = F.coalesce(F.when(F.col("asking_price") > 0, F.col("asking_price")), F.when(F.col("internet_price") > 0, F.col("internet_price")))
    return v.select(
        F.upper(F.trim("vin")).alias("vin"), F.nullif("stock_number", F.lit("")).alias("stock_no"), "year", "make", "model", "trim", F.lower("sale_class").alias("condition"), F.col("odometer").alias("odometer_km"), "msrp",
        F.col("internet_price").alias("list_price"), price.alias("sale_price"), F.col("days_in_stock").alias("days_in_inventory"),
    )


#: A vehicle of an embedded linked-data list, as far as it is read.
LD_ITEM = "struct<`@type`:string,name:string,vehicleIdentificationNumber:string,brand:struct<name:string>,model:string,vehicleModelDate:string,mileageFromOdometer:struct<value:string>,offers:struct<price:string,priceCurrency:string>,url:string>"


def linked_data(pages: DataFrame, html: str = "html") -> DataFrame:
    """Vehicles of the linked-data lists in pages: other columns of pages, then vin, name, make, model, year, km, price."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    listed = F.from_json("block", f"struct<`@type`:string,itemListElement:array<struct<item:{LD_ITEM}>>>")
    keep = [c for c in pages.columns if c != html]
    rows = pages.select(*keep, F.explode(blocks).alias("block")).select(*keep, F.explode(listed["itemListElement"]).alias("e")).select(*keep, "e.item.*")
    number = lambda c: F.regexp_replace(c, "[^0-9.]", "").try_cast("double")
    return rows.select(*keep, F.upper("vehicleIdentificationNumber").alias("vin"), "name", F.col("brand.name").alias("make"), "model", F.col("vehicleModelDate").try_cast("int").alias("year"), number(F.col("mileageFromOdometer.value")).alias("km"), number(F.col("offers.price")).alias("price"))


def next_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with next_url, the address that a rel=next link or its twin names."""
    a = F.regexp_extract(F.col(html), r"""(?i)<(?:a|link)[^>]*rel=["']next["'][^>]*href=["']([^"']+)""", 1)
    b = F.regexp_extract(F.col(html), r"""(?i)<(?:a|link)[^>]*href=["']([^"']+)["'][^>]*rel=["']next["']""", 1)
    return pages.withColumn("next_url", F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))


def quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, doubled quotes and line feeds within quotes; a byte order mark is dropped."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)


def record(pairs: Column, fields: list[str]) -> list[Column]:
    """Columns out of an array of (Name, Value.Literal) pairs; the last of equal names counts."""
    entries = F.transform(pairs, lambda p: F.struct(p["Name"].alias("k"), p["Value"]["Literal"].alias("v")))
    of = lambda f: F.filter(entries, lambda e: e["k"] == f)
    return [F.when(F.size(of(f)) > 0, F.element_at(of(f), -1)["v"]).alias(f) for f in fields]


def month_day_year(text: Column) -> Column:
    """A date out of M/D/YYYY; null for anything that is none."""
    parts = F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})", 0)
    return F.try_to_timestamp(F.trim(parts), F.lit("M/d/yyyy")).cast("date")


def starting_prices(pages: DataFrame, key: str, text: str = "text", least: int = 10_000, most: int = 300_000) -> DataFrame:
    """(key, price, n): dollar amounts in a sensible range near the word `from` or `starting`, the least first."""
    amounts = F.regexp_extract_all(F.col(text), F.lit(r"(?i)(?:from|starting(?: at)?)[^$]{0,30}\$\s?([0-9][0-9,]{3,8})"), F.lit(1))
    rows = pages.select(key, F.explode(amounts).alias("a")).select(key, F.regexp_replace("a", ",", "").try_cast("int").alias("price")).where(F.col("price").between(least, most))
    return rows.groupBy(key).agg(F.min("price").alias("price"), F.count("*").alias("n"))
