import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketloom.sources import feeds, sinks
from marketloom.streaming import events


def test_inventories(spark, tmp_path):
    a = {"pages": 1, "vehicles": [{"vin": " 1m8gdm9axkp042788", "stockNumber": "", "year": 2024, "isNew": True, "price": 30.0, "entryMillis": 1704067200000}, {"vin": "X", "isNew": False, "entryMillis": 5}]}
    (tmp_path / "a.json").write_text(json.dumps(a))
    got = feeds.inventory_a(spark, str(tmp_path / "a.json"), "2024-01-11").collect()
    assert (got[0]["vin"], got[0]["stock_no"], got[0]["condition"], got[0]["days_in_inventory"]) == ("1M8GDM9AXKP042788", None, "new", 10) and got[1]["days_in_inventory"] is None
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"vin": "y", "internet_price": 9.0, "asking_price": 0.0}, {"vin": "z", "internet_price": 9.0, "asking_price": 8.0}]}))
    assert [r["sale_price"] for r in feeds.inventory_b(spark, str(tmp_path / "b.json")).collect()] == [9.0, 8.0]


def test_linked_data_and_next(spark):
    item = {"@type": "Car", "vehicleIdentificationNumber": "abc", "brand": {"name": "Make"}, "model": "M", "vehicleModelDate": "2023", "offers": {"price": "$31,500"}, "mileageFromOdometer": {"value": "12 000"}}
    doc = json.dumps({"@type": "ItemList", "itemListElement": [{"item": item}, {"item": item}]})
    page = f'<script type="application/ld+json">{doc}</script><script type="application/ld+json">broken</script><a rel="next" class="x" href="/p2">n</a>'
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    got = feeds.linked_data(df).collect()
    assert len(got) == 2 and (got[0]["vin"], got[0]["year"], got[0]["price"], got[0]["km"]) == ("ABC", 2023, 31500.0, 12000.0)
    assert [r["next_url"] for r in feeds.next_pages(df).orderBy("page_id").collect()] == ["/p2", None, None]


def test_csv_and_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿name,note\n"a ""q"", b","two\nlines"\nc,\n', encoding="utf-8")
    got = feeds.quoted_csv(spark, str(tmp_path / "x.csv"), "name string, note string").collect()
    assert [(r["name"], r["note"]) for r in got] == [('a "q", b', "two\nlines"), ("c", None)]
    df = spark.createDataFrame([([("N", ("1",)), ("D", ("2/30/2020",)), ("N", ("2",))],)], "p array<struct<Name:string,Value:struct<Literal:string>>>")
    assert tuple(df.select(*feeds.record(F.col("p"), ["N", "D", "Q"])).first()) == ("2", "2/30/2020", None)
    dates = spark.createDataFrame([("1/31/2020 x",), ("2/30/2020",), ("no",)], "d string").select(feeds.month_day_year(F.col("d")).alias("d")).collect()
    assert [r["d"] for r in dates] == [dt.date(2020, 1, 31), None, None]


def test_prices_in_text(spark):
    df = spark.createDataFrame([(1, "Starting at only $29,999 and from $31000. Save $500"), (2, "nothing")], "id int, text string")
    assert [tuple(r) for r in feeds.starting_prices(df, "id").collect()] == [(1, 29999, 2)]


def test_swap_keeps_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert sinks.swap(spark.range(100), path) == 100
    with pytest.raises(sinks.Refused):
        sinks.swap(spark.range(10), path)
    assert spark.read.parquet(path).count() == 100 and sinks.swap(spark.range(80), path) == 80
    with pytest.raises(sinks.Refused):
        sinks.swap(spark.range(0), path, floor=1)
    spark.catalog.refreshByPath(path)
    assert spark.read.parquet(path).count() == 80


def test_cache(spark):
    now = dt.datetime(2024, 1, 2)
    cache = spark.createDataFrame([("a", "v1", now), ("b", "v0", now), ("c", "v1", now - dt.timedelta(hours=7))], "url string, version string, created_at timestamp")
    hits, misses = sinks.fresh_cache(cache, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string"), "url", "v1", now)
    assert [r["url"] for r in hits.collect()] == ["a"] and sorted(r["url"] for r in misses.collect()) == ["b", "c", "d"]


def test_new_only(spark, tmp_path):
    path = f"file://{tmp_path}/known"
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    more = df.union(spark.createDataFrame([(3,)], "id int"))
    assert events.new_only(df, path, ["id"], 0).count() == 2
    for _ in range(2):  # a batch that is run again
        assert [r["id"] for r in events.new_only(more, path, ["id"], 1).collect()] == [3]


@pytest.mark.parametrize("mode,keys,exp", [("complete", None, [(1, 3), (2, 1)]), ("update", ["user_id"], [(1, 3), (2, 1)]), ("update", None, [(1, 1), (1, 3), (2, 1)])])
def test_drain_keeps_rows_out_of_the_driver(spark, tmp_path, mode, keys, exp):
    for k, ids in enumerate([[1], [1, 1, 2]]):
        spark.createDataFrame([(i,) for i in ids], "user_id long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("user_id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").groupBy("user_id").agg(F.count("*").alias("n"))
    out = events.drain(stream, mode, keys=keys)
    assert out.columns == ["user_id", "n"] and sorted(tuple(r) for r in out.collect()) == exp
    assert out.inputFiles() and all(f.endswith(".parquet") for f in out.inputFiles())
    empty = spark.readStream.schema("user_id long").parquet(f"file://{tmp_path}/none*")
    assert events.drain(empty).count() == 0


def test_swap_after_a_run_that_was_cut_off(spark, tmp_path):
    """The old table lies aside and nothing is in its place: it is put back, counted against and kept."""
    path = f"file://{tmp_path}/table"
    sinks.swap(spark.range(1000), path)
    (tmp_path / "table").rename(tmp_path / "table.before")
    with pytest.raises(sinks.Refused):
        sinks.swap(spark.range(5), path)
    assert spark.read.parquet(path).count() == 1000
    (tmp_path / "table").rename(tmp_path / "table.before")
    assert sinks.swap(spark.range(900), path) == 900 and not (tmp_path / "table.before").exists()
    # cut off after the new table was in place: the rest of the old one goes
    spark.range(1000).write.parquet(f"{path}.before")
    assert sinks.swap(spark.range(800), path) == 800 and not (tmp_path / "table.before").exists()


def zipped(path, **members):
    import zipfile

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_", "."), text)


def test_zipped_csv(spark, tmp_path):
    from marketloom.sources import archives

    body = '﻿REF_DATE,GEO,"VALUE"\r\n2023,"Québec, QC","1 ""x"""\r\n\r\n2024,"two\nlines",5\r\n2025\r\n'
    zipped(tmp_path / "a.zip", table_csv=body, notes_txt="REF_DATE\n1\n", sub__more_CSV="GEO,REF_DATE,OTHER\nAB,2020,z\n", empty_csv="")
    zipped(tmp_path / "b.zip", big_csv="REF_DATE,VALUE\n" + "".join(f"{i},{i}\n" for i in range(25_000)))
    got = archives.zipped_csv(spark, f"file://{tmp_path}/*.zip", ["REF_DATE", "GEO", "VALUE"])
    a = sorted(tuple(r)[1:] for r in got.where("archive like '%a.zip'").collect())
    assert a == [("sub/more.CSV", 1, "2020", "AB", None), ("table.csv", 1, "2023", "Québec, QC", '1 "x"'), ("table.csv", 2, "2024", "two\nlines", "5"), ("table.csv", 3, "2025", None, None)]
    assert got.where("archive like '%b.zip'").selectExpr("count(*)", "sum(cast(VALUE as long))", "max(row)").first()[:] == (25_000, 25_000 * 24_999 // 2, 25_000)
    assert archives.zipped_csv(spark, f"file://{tmp_path}/a.zip", ["GEO"], member="nothing").count() == 0
    (tmp_path / "broken.zip").write_bytes(b"PK not a zip")
    with pytest.raises(Exception, match="zip"):
        archives.zipped_csv(spark, f"file://{tmp_path}/broken.zip", ["GEO"]).collect()
