"""Places of rows in files, and files of sheets."""

import pytest
from pyspark.sql import functions as F
from test_rules import raw, row

from granary.sources import retail


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("bound", [100_000, 0])
def test_rows_are_numbered_across_blocks_and_files(spark, tmp_path, small_blocks, monkeypatch, bound):
    monkeypatch.setattr(retail, "BROADCAST_BLOCKS", bound)
    lines = {"a": 40, "b": 1, "c": 0, "d": 95}
    for name, n in lines.items():
        rows = "".join(f"{name}{i},c,text {'x' * (i % 17)},1,d,2,3,UK\n" for i in range(n))
        (tmp_path / f"{name}.csv").write_text(",".join(retail.RAW_COLUMNS) + "\n" + rows)
    source = retail.read_raw_csv(spark, str(tmp_path))
    assert source.rdd.getNumPartitions() > 10
    found = {r["Invoice"]: (r["row_in_file"], r["row"]) for r in retail.numbered(source).collect()}
    expected, before = {}, 0
    for name, n in lines.items():
        expected |= {f"{name}{i}": (i + 1, before + i + 1) for i in range(n)}
        before += n
    assert found == expected


def test_every_header_is_checked(spark, tmp_path):
    good = raw(spark, [row("1"), row("2")])
    for name in ("one", "two"):
        retail.write_csv(good, str(tmp_path / name))
    rows, facts = retail.open_sheets(spark, {n: str(tmp_path / n) for n in ("one", "two")})
    assert {(r["sheet"], r["rows"]) for r in facts.collect()} == {("one", 2), ("two", 2)}
    assert rows.where(F.col("sheet") == "two").count() == 2
    (tmp_path / "two" / "zz.csv").write_text("Invoice,StockCode,Description,Quantity,InvoiceDate,Cost,Customer ID,Country\n1,2,3,4,5,6,7,8\n")
    with pytest.raises(Exception, match="(?i)header"):
        retail.open_sheets(spark, {n: str(tmp_path / n) for n in ("one", "two")})[0].collect()
