"""Cleaning rules and cancellations on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from granary.functions.select import kth_largest
from granary.operators import reconcile, rfm, rules, segments
from granary.operators.clustering import scaled, silhouette
from granary.sources import retail

DAY = "2010-01-{:02d} 10:00:00"


def raw(spark, rows):
    return spark.createDataFrame(rows, retail.raw_schema())


def row(invoice="500001", code="10001", text="a", quantity="5", at=DAY.format(1), price="2.5", customer="12345", country="UK"):
    return (invoice, code, text, quantity, at, price, customer, country)


def fates(spark, rows):
    return {(r["InvoiceNo"], r["Description"]): r["removed_by"] for r in rules.attributed(raw(spark, rows)).collect()}


def test_each_rule_takes_its_row(spark):
    rows = [
        row("500001"), row("500002", at="bad"), row("500003", quantity="12.7"), row("500004", price="NaN"), row("A500005"), row("500006", quantity="-1"),
        row("500007", price="0"), row("500008", customer="  "), row("500009", customer=None), row("500010", code="m"), row(None), row("C500012", customer=None, quantity="-5"),
    ]
    assert {k[0]: v for k, v in fates(spark, rows).items()} == {
        "500001": None, "500002": "invalid_invoice_date", "500003": "invalid_values", "500004": "invalid_values", "A500005": "non_sale_invoices", "500006": "quantity_non_positive",
        "500007": "unit_price_non_positive", "500008": "missing_customer_id", "500009": "missing_customer_id", "500010": "non_product_stockcode", None: "invalid_values", "C500012": "cancelled_invoices",
    }


def test_a_cancellation_takes_the_latest_purchase_before_it(spark):
    rows = [row(f"50000{d}", at=DAY.format(d)) for d in (1, 2, 3)] + [row("C500009", quantity="-5", at=DAY.format(5)), row("500010", at=DAY.format(9))]
    assert fates(spark, rows) == {("500001", "a"): None, ("500002", "a"): None, ("500003", "a"): "cancelled_invoices", ("C500009", "a"): "cancelled_invoices", ("500010", "a"): None}


def test_ties_go_to_the_larger_description_and_null_customers_match_nothing(spark):
    rows = [row(text="a"), row(text="b"), row("C500009", quantity="-5", at=DAY.format(5)), row("500020", customer=None, text="x"), row("C500021", customer=None, quantity="-5", at=DAY.format(5))]
    found = fates(spark, rows)
    assert (found["500001", "a"], found["500001", "b"], found["500020", "x"]) == (None, "cancelled_invoices", "missing_customer_id")


def test_audit_adds_up_and_copies_count_once(spark):
    rows = [row()] * 3 + [row("500002", at="bad")] * 2 + [row(country=None)] * 2
    table = {r["rule"]: r for r in rules.audit(rules.attributed(raw(spark, rows))).collect()}
    assert table["invalid_invoice_date"]["rows_before"] == 7
    assert table["invalid_invoice_date"]["rows_removed"] == 2
    assert table["duplicate_rows"]["rows_removed"] == 3
    assert table["non_product_stockcode"]["rows_after"] == 2


def test_empty_input(spark):
    empty = raw(spark, [])
    assert rules.attributed(empty).count() == 0
    assert [r["rows_before"] for r in rules.audit(rules.attributed(empty)).collect()] == [0] * 9
    table = rfm.rfm(rules.cleaned(rules.attributed(empty)))
    assert table.count() == 0
    assert rfm.top_share(table).first()["n_top"] == 0


def test_csv_header_and_corrupt_rows(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(",".join(retail.RAW_COLUMNS) + '\n1,2,"say ""hi"", you",4,5,6,7,8\n1,2,3\n1,2,3,4,5,6,7,8,9\n1,2,,4,5,NA,7,8\n')
    rows = retail.read_raw_csv(spark, str(good), with_corrupt=True).collect()
    assert rows[0]["Description"] == 'say "hi", you'
    assert [r["_corrupt_record"] is None for r in rows] == [True, False, False, True]
    assert rows[3]["Price"] == "NA"
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        retail.read_raw_csv(spark, str(bad))


def test_paths(spark, tmp_path):
    retail.write_parquet(spark.range(5), str(tmp_path / "t"), files=1)
    assert retail.path_exists(spark, str(tmp_path / "t"))
    assert retail.list_files(spark, str(tmp_path / "t")).where(F.col("path").endswith(".parquet")).count() == 1
    retail.write_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_missing_paths_are_python_errors(spark, tmp_path):
    for read in (retail.read_raw_csv, retail.read_parquet):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "none"))
    retail.write_parquet(spark.range(5), f"{tmp_path}/long-name", files=1)
    assert not retail.path_exists(spark, f"{tmp_path}/long")
    assert retail.path_exists(spark, f"{tmp_path}/long-name")
    assert retail.is_folder(spark, f"{tmp_path}/long-name")
    assert not retail.is_folder(spark, f"{tmp_path}/none")
    assert sum(r["rows"] for r in retail.partitions(retail.read_parquet(spark, f"{tmp_path}/long-name")).collect()) == 5
    assert [tuple(r) for r in retail.described(spark.range(1)).collect()] == [(0, "id", "bigint", False)]
    retail.delete(f"file://{tmp_path}/long-name")
    assert not retail.path_exists(spark, f"{tmp_path}/long-name")
    with pytest.raises(FileNotFoundError):
        retail.delete(f"file://{tmp_path}/long-name")
    assert retail.raw_uri("hdfs://host:9000/", "/data/raw/", "a.csv") == "hdfs://host:9000/data/raw/a.csv"


def test_overlap_report_counts_what_is_left(spark):
    a = [row(str(i), at=DAY.format(i)) for i in (1, 2, 3, 3, 4)]
    b = [row(str(i), at=DAY.format(i)) for i in (3, 4, 4, 5)]
    rows, _ = retail.sheets_union({"one": raw(spark, a), "two": raw(spark, b)})
    found = {r["metric"]: r["value"] for r in reconcile.overlap_report(rows, "one", "two").collect()}
    assert (found.pop("since"), found.pop("until")) == (DAY.format(3), DAY.format(4))
    assert {k: int(v) for k, v in found.items()} == {
        "first_rows": 5, "second_rows": 4, "first_within": 3, "second_within": 3, "within_both": 2, "within_first_only": 1, "within_second_only": 1, "first_excess": 1, "second_excess": 1, "excess_without_first_within": 1,
    }


def test_the_number_of_clusters_must_be_chosen():
    from granary.operators.clustering import selected_k

    assert selected_k(4) == 4
    for k in (None, 1):
        with pytest.raises(ValueError):
            selected_k(k)


def test_sheets_overlap(spark):
    a = [row(str(i), at=DAY.format(i)) for i in (1, 2, 3, 3)]
    b = [row(str(i), at=DAY.format(i)) for i in (3, 4)]
    rows, facts = retail.sheets_union({"one": raw(spark, a), "two": raw(spark, b)})
    assert {r["sheet"]: r["rows"] for r in facts.collect()} == {"one": 4, "two": 2}
    counts = reconcile.sheet_overlap(rows, "one", "two").first().asDict()
    assert (counts["left_rows"], counts["right_rows"], counts["in_both"], counts["left_only"], counts["left_excess"]) == (2, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        retail.sheets_union({"one": raw(spark, a), "two": raw(spark, b).drop("Country")})


def test_keyed_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.004), (2, None), (4, 5.0)], "k int, v double")
    assert tuple(reconcile.keyed_differences(a, b, "k", ["v"], 0.005).first()) == (4, 1, 1, 0)
    assert tuple(reconcile.keyed_differences(a, b, "k", ["v"]).first()) == (4, 1, 1, 1)


def test_rfm_of_one_customer(spark):
    tx = spark.sql("SELECT 'c' AS CustomerID, '1' AS InvoiceNo, TIMESTAMP '2020-01-01 10:00:00' AS InvoiceDate, CAST(2.5 AS DECIMAL(18,3)) AS Amount")
    table = rfm.rfm(tx)
    assert tuple(table.first()) == ("c", 1, 1, 2.5)
    assert tuple(rfm.rfm(tx, fixed="2020-01-11").first())[1] == 10
    assert rfm.describe(table).count() == 3
    assert rfm.top_share(table).first()["top_pct"] == 100.0
    assert scaled(table, rfm.FEATURES).first()["z_Recency"] == 0.0
    own = segments.with_tenure(segments.rule_segments(table), tx)
    assert segments.profile(own).first()["CustomerPct"] == 100.0


def test_points_alone_score_zero(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (0, [0.0, 1.0]), (1, [9.0, 9.0])], "label int, v array<double>")
    assert silhouette(points, "v", "label").first()["silhouette"] == pytest.approx(2 / 3, abs=0.01)


def test_ratios_are_of_medians(spark):
    """A skewed segment: its mean is far from its median."""
    rows = [(f"a{i}", 10, 1, float(m), 20, 0) for i, m in enumerate((1, 2, 3, 4, 990))] + [(f"b{i}", 30, 2, 10.0, 40, 1) for i in range(6)]
    customers = spark.createDataFrame(rows, "CustomerID string, Recency int, Frequency long, Monetary double, Tenure int, Cluster int")
    found = {r["Cluster"]: r for r in segments.profile(customers).collect()}
    assert (found[0]["AvgMonetary"], found[0]["MedianMonetary"]) == (200.0, 3.0)
    assert [(found[k]["RecencyVsOverall"], found[k]["FrequencyVsOverall"], found[k]["MonetaryVsOverall"]) for k in (0, 1)] == [(0.33, 0.5, 0.3), (1.0, 1.0, 1.0)]
    assert {r["Cluster"]: r["Name"] for r in segments.labels(segments.profile(customers)).collect()} == {0: "active, low value", 1: "active, low value"}
    assert segments.profile(customers.where("false")).count() == 0


def test_kth_largest(spark):
    df = spark.createDataFrame([(float(x % 37),) for x in range(500)] + [(None,)], "x double")
    values = sorted((float(x % 37) for x in range(500)), reverse=True)
    for k in (1, 13, 14, 250, 500, 900):
        assert kth_largest(df, "x", k) == values[min(k, 500) - 1]
    assert kth_largest(df.where("false"), "x", 3) is None


def test_checks_of_a_run_copy_no_row(spark):
    """Rows are added up before they are split by rule, and what is distinct is counted without a copy of each row for it."""
    from granary.plans.retail import _clean_facts

    found = rules.attributed(raw(spark, [row()] * 3 + [row("500002"), row("500003", customer="12346"), row("500004", at="bad")]))
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plan = text(rules.audit(found))
    assert "Aggregate" in plan[plan.index("Generate explode") :].split("Relation")[0]  # below the explosion
    facts = _clean_facts(rules.cleaned(found))
    assert "Expand" not in text(facts)
    own = rules.cleaned(found).collect()
    assert facts.first()[:3] == (len(own), len({r["CustomerID"] for r in own}), len({(r["CustomerID"], r["InvoiceNo"]) for r in own}))
