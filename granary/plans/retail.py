"""The registered retail queries: each reads the given tables and applies the operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import exact
from granary.functions.typed import typed
from granary.operators import bags, clustering, distinct, lloyd, observed, profiling, reconcile, rfm, rules, segments
from granary.sources import retail
from granary.sources.scratch import materialize, scratch_path, stored

Z_FEATURES = rfm.FEATURES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw transactions as a stored table, made from the given ones once in a session, as long as these are the same files."""
    return stored(spark, f"raw {sf_dir}", retail.fingerprint(spark, [f"{sf_dir}/{n}.parquet" for n in retail.DIRTY_SOURCES]), lambda: retail.dirty_retail(spark, sf_dir))


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.attributed(raw(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cleaned(attributed(spark, sf_dir))


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean sales as they are: each order that has lines, with the exact amount of these. Lines are added up before they meet their order.

    A price or discount that doesn't fit its decimal matters only in a line that meets an order; there it fails as a cast does (casts make null of what is no number).
    """
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    cents, off = exact.hundredths(price, 12), exact.hundredths(discount, 4)
    unfit = [F.max(F.when(steps.isNull() & (F.abs(x) < float("inf")), x)).alias(f"unfit_{n}") for n, steps, x in (("price", cents, price), ("discount", off, discount))]
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*exact.sum_parts(cents * (100 - off), "amount"), *unfit)
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.coalesce(F.col("unfit_price").cast("decimal(12,2)"), F.col("unfit_discount").cast("decimal(4,2)"), exact.total("amount"))
    return joined.select(F.col("o_custkey").alias("CustomerID"), F.col("o_orderkey").alias("InvoiceNo"), F.col("o_orderdate").alias("InvoiceDate"), amount.alias("Amount"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return bought.select(F.col("user_id").alias("CustomerID"), F.col("event_id").alias("InvoiceNo"), F.col("ts").alias("InvoiceDate"), F.col("value").cast("decimal(18,4)").alias("Amount"))


def order_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.rfm(order_totals(spark, sf_dir))


def _as_double(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


# Cleaning


def prepare_typed(spark, sf_dir):
    return _as_double(typed(raw(spark, sf_dir)))


def rule_flags(spark, sf_dir):
    """Rows of the untouched relation that break each row-local rule, and copies and cancellations in it."""
    found = rules.folded(raw(spark, sf_dir))
    every = {r.name: r.flag for r in [*rules.parsing_rules(), *rules.sale_rules()]} | {rules.CANCELLED: rules.is_cancel()}
    sums = found.agg(*[F.coalesce(F.sum(F.when(c, F.col("copies"))), F.lit(0)).alias(n) for n, c in every.items()], F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias(rules.DUPLICATES))
    names = sums.columns
    return sums.select(F.expr("stack({}, {}) AS (rule, detected)".format(len(names), ", ".join(f"'{n}', {n}" for n in names))))


def dedup_rows(spark, sf_dir):
    return _as_double(rules.folded(raw(spark, sf_dir)))


def _sound(spark, sf_dir):
    return materialize(rules.folded(raw(spark, sf_dir)).where(rules.first_broken(rules.parsing_rules()).isNull()), "sound")


def cancel_keys(spark, sf_dir):
    cancelled = _sound(spark, sf_dir).where(rules.is_cancel() & F.col("CustomerID").isNotNull())
    keys = ["CustomerID", "StockCode", F.abs("Quantity").alias("AbsQuantity"), "UnitPrice"]
    return _as_double(cancelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("cancels"), F.max("InvoiceDate").alias("last_cancel")))


def cancel_matched(spark, sf_dir):
    matched = rules.match_cancellations(_sound(spark, sf_dir)).where("matched")
    return _as_double(matched.select("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country", "cancels", "last_cancel"))


def cancel_detail(spark, sf_dir):
    rows = rules.match_cancellations(_sound(spark, sf_dir))
    cancel, own = rules.is_cancel(), F.col("CustomerID").isNotNull()
    facts = rows.agg(
        F.count_if(cancel).alias("cancel_rows"), F.count_if(cancel & own).alias("with_customer"), F.sum(F.when(cancel, F.col("Amount"))).cast("double").alias("cancel_amount"),
        F.count_if("matched").alias("matched_rows"), F.sum(F.when(F.col("matched"), F.col("Amount"))).cast("double").alias("matched_amount"),
    )
    return facts.withColumn("unmatched", F.col("with_customer") - F.col("matched_rows"))


def clean_transactions(spark, sf_dir):
    return _as_double(clean(spark, sf_dir))


def clean_audit(spark, sf_dir):
    """What each rule takes away, observed while the attributed rows are written."""
    order = rules.rule_order()
    figures = observed.step_figures(order, F.col("removed_by"), F.col("early").isNotNull(), F.col("copies"), F.col("Amount"), rules.DUPLICATES)
    rows, seen = observed.materialize_observed(attributed(spark, sf_dir), "attributed", figures)
    return observed.audit_table(rows, order, seen)


def clean_summary(spark, sf_dir):
    """The clean rows at a glance: counts, bounds and the total observed while they are written, numbers of different values from what was written."""
    ends = {n: (f(c)) for c, k in (("Quantity", "quantity"), ("UnitPrice", "price"), ("Amount", "amount")) for n, f in ((f"min_{k}", F.min), (f"max_{k}", F.max))}
    figures = {"n": F.count(F.lit(1)), "first": F.min("InvoiceDate"), "last": F.max("InvoiceDate"), **ends, "total": F.sum("Amount"), "rows_with_null": F.count_if(F.greatest(*[F.col(c).isNull() for c in rules.CLEAN_COLUMNS]))}
    rows, seen = observed.materialize_observed(clean(spark, sf_dir), "clean", figures)
    kinds = rows.agg(*[c.alias(n) for n, c in figures.items()]).schema
    facts = rows.agg(*[F.count_distinct(c).alias(f"n_{c.lower()}") for c in ("InvoiceNo", "CustomerID", "StockCode", "Country")])
    return _as_double(facts.select(*[F.lit(seen[f.name]).cast(f.dataType).alias(f.name) for f in kinds], *facts.columns))


def kept_share(spark, sf_dir):
    rows = attributed(spark, sf_dir).agg(F.sum("copies").alias("raw_rows"), F.count_if(F.col("removed_by").isNull()).alias("clean_rows"))
    return rows.select("*", (F.col("raw_rows") - F.col("clean_rows")).alias("removed"), F.round(100 * F.col("clean_rows") / F.col("raw_rows"), 2).alias("pct_kept"))


# Profiles


def profiled(operator, spark, sf_dir):
    return operator(raw(spark, sf_dir))


# RFM


def rfm_orders(spark, sf_dir):
    """RFM of the 100 customers with the highest spend."""
    return order_rfm(spark, sf_dir).orderBy(F.desc("Monetary"), "CustomerID").limit(100)


def over_orders(operator, spark, sf_dir):
    return operator(order_rfm(spark, sf_dir))


def rfm_events(spark, sf_dir):
    return rfm.rfm(purchases(spark, sf_dir))


def rfm_clean(spark, sf_dir):
    return rfm.rfm(materialize(clean(spark, sf_dir), "clean"))


def rfm_sql_difference(spark, sf_dir):
    """The RFM table against the same in SQL text, and against itself with nothing changed: no row may differ."""
    tx = materialize(clean(spark, sf_dir), "clean")
    sql = spark.sql(
        """SELECT CustomerID, CAST(date_diff(max(to_date(max(InvoiceDate))) OVER () + 1, to_date(max(InvoiceDate))) AS INT) AS Recency,
        count(DISTINCT InvoiceNo) AS Frequency, CAST(CAST(sum(Amount) AS DECIMAL(28,2)) AS DOUBLE) AS Monetary FROM {tx} GROUP BY CustomerID""",
        tx=tx,
    )
    return reconcile.keyed_differences(rfm.rfm(tx), materialize(sql, "rfm-sql"), "CustomerID", rfm.FEATURES, 0.005)


#: The day from which on orders are new to ``rfm_changes``.
SINCE = "1998-07-01"


def rfm_changes(spark, sf_dir):
    """(CustomerID, change): customers whose orders or spend the orders since a day have changed, or who are new by them."""
    orders = order_totals(spark, sf_dir)
    told, _ = reconcile.keyed_changes(rfm.rfm(orders), rfm.rfm(orders.where(F.col("InvoiceDate") < SINCE)), "CustomerID", ["Frequency", "Monetary"], 0.005)
    return told.where("change <> 'none'")


# Different values by sketches

COUNTED = {"customers": "CustomerID", "invoices": "InvoiceNo", "stock_codes": "StockCode"}


def _monthly(spark, sf_dir):
    rows, month = typed(raw(spark, sf_dir)), F.date_format("InvoiceDate", "yyyy-MM")
    return rows, month, materialize(distinct.sketches(rows, month, COUNTED), "sketches")


def distinct_by_month(spark, sf_dir):
    """(part, what, n, within): different values of each month, exact, and whether the month's sketch has them within its bound."""
    rows, month, stored = _monthly(spark, sf_dir)
    return distinct.held_to_bound(distinct.merged(stored, F.col("part")), distinct.exact(rows, month, COUNTED))


def distinct_by_year(spark, sf_dir):
    """The same for years, whose estimates come from the stored sketches of their months alone."""
    rows, _, stored = _monthly(spark, sf_dir)
    return distinct.held_to_bound(distinct.merged(stored, F.substring("part", 1, 4)), distinct.exact(rows, F.date_format("InvoiceDate", "yyyy"), COUNTED))


# Set operations


def _halves(spark, sf_dir):
    rows = raw(spark, sf_dir)
    return rows.where("InvoiceDate <= '1998-12-31'"), rows.where("InvoiceDate >= '1998-01-01'")


def _sheets(spark, sf_dir):
    """Both halves as sheets of one relation, from one pass: rows of the last year are on both."""
    first, second = F.when(F.col("InvoiceDate") <= "1998-12-31", "first"), F.when(F.col("InvoiceDate") >= "1998-01-01", "second")
    return raw(spark, sf_dir).withColumn("sheet", F.explode(F.array_compact(F.array(first, second))))


def overlap_intersect_all(spark, sf_dir):
    rows = _sheets(spark, sf_dir)
    return bags.intersect_all(rows.where("sheet = 'first'"), rows.where("sheet = 'second'"), retail.RAW_COLUMNS)


def overlap_except_all(spark, sf_dir):
    rows = _sheets(spark, sf_dir)
    return bags.except_all(rows.where("sheet = 'first'"), rows.where("sheet = 'second'"), retail.RAW_COLUMNS)


def union_by_name(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    joined, facts = retail.sheets_union({"first": a, "second": b.select(*reversed(b.columns)).select(*a.columns)})
    return facts


def sheet_overlap(spark, sf_dir):
    return reconcile.sheet_overlap(_sheets(spark, sf_dir), "first", "second")


def overlap_report(spark, sf_dir):
    """All that two overlapping sheets have in common, as (metric, value)."""
    return reconcile.overlap_report(_sheets(spark, sf_dir), "first", "second")


# Scaling and clustering


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def scale_zscore(log, spark, sf_dir):
    z = clustering.scaled(order_rfm(spark, sf_dir), Z_FEATURES, log=log)
    return _rounded(z, [f"z_{f}" for f in Z_FEATURES], 5).select("CustomerID", *[f"z_{f}" for f in Z_FEATURES])


def scaling_summary(spark, sf_dir):
    return clustering.scaling_summary(order_rfm(spark, sf_dir), Z_FEATURES)


def kmeans_assign_fixed(spark, sf_dir):
    return clustering.assign_nearest(table(spark, sf_dir, "embeddings"), "embedding", "label", "vec_id").select("vec_id", "label", "nearest", F.round("distance", 3).alias("distance"))


def silhouette(spark, sf_dir):
    return clustering.silhouette(table(spark, sf_dir, "embeddings"), "embedding", "label").withColumn("silhouette", F.round("silhouette", 4))


def inertia(spark, sf_dir):
    return clustering.inertia(table(spark, sf_dir, "embeddings"), "embedding", "label").withColumn("inertia", F.round("inertia", 1))


def cluster_means(spark, sf_dir):
    return clustering.cluster_means(segments.rule_segments(order_rfm(spark, sf_dir)), rfm.FEATURES)


VARIANTS = {"standard_scaler": False, "log1p_standard_scaler": True}
FINAL_VARIANT = "log1p_standard_scaler"
#: The numbers of clusters that are tried, and the one that the evaluation has led to.
KS, SELECTED_K = list(range(2, 7)), 4


def _points(table: DataFrame, variants: list[str], more: list[str] | None = None) -> DataFrame:
    """The customers' scaled features of each variant on the grid, with ``more`` of their columns, written."""
    parts = [lloyd.on_grid(clustering.scaled(table, Z_FEATURES, log=VARIANTS[v]), "CustomerID", [f"z_{f}" for f in Z_FEATURES], v, more) for v in variants]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return materialize(joined, "points")


def _clusters(spark, sf_dir, tenure=False):
    """(clusters, points, run): customers with their cluster, written; the points that it was fitted on; the final run.

    Points carry their customers' columns, so that these meet their clusters without a join.
    """
    table = rfm.rfm(order_totals(spark, sf_dir), tenure=tenure)
    own = [c for c in table.columns if c != "CustomerID"]
    carried = _points(table, [FINAL_VARIANT], own)
    points = carried.select("variant", "key", "x")
    runs = lloyd.fit(points, [clustering.selected_k(SELECTED_K)])
    told = lloyd.assigned(carried, runs).where("key IS NOT NULL").select(F.col("key").alias("CustomerID"), *own, F.col("cluster").alias("Cluster"))
    return materialize(told, "clusters"), points, runs[0]


def kmeans_fit(spark, sf_dir):
    """Customers with their K-Means cluster (k = 4), numbered by centroid."""
    return _clusters(spark, sf_dir)[0]


def k_sweep(spark, sf_dir):
    """Each cluster of each number of clusters and variant, with the evaluation of its run; all runs share their passes."""
    table = order_rfm(spark, sf_dir)
    points = _points(table, list(VARIANTS))
    swept = lloyd.sweep(points, lloyd.fit(points, KS), table, rfm.FEATURES, "CustomerID")
    return _rounded(_rounded(swept, ["pct", *[f"mean_{f}" for f in rfm.FEATURES]], 2), ["cost", "silhouette"], 4)


def kmeans_facts(spark, sf_dir):
    """(fact, cluster, value) of the final run: how it was fitted and ended, and each cluster's size and centroid."""
    _, points, run = _clusters(spark, sf_dir)
    own = lloyd.clusters(points, [run])
    settings = {"k": run.k, "max_iter": lloyd.MAX_ITER, "tolerance": lloyd.TOLERANCE, "iterations": run.iterations, "converged": run.converged}
    fixed = spark.createDataFrame([(n, None, float(v)) for n, v in settings.items()], "fact string, cluster int, value double")
    cost = own.agg(F.sum("cost").alias("value")).select(F.lit("cost").alias("fact"), F.lit(None).cast("int").alias("cluster"), "value")
    cells = [("size", F.col("n").cast("double")), *((f"center_{f}", F.col("center")[i]) for i, f in enumerate(Z_FEATURES))]
    each = own.select("cluster", F.explode(F.array(*[F.struct(F.lit(n).alias("fact"), c.alias("value")) for n, c in cells])).alias("c")).select("c.fact", "cluster", "c.value")
    return _rounded(fixed.unionByName(cost).unionByName(each), ["value"], 4)


def kmeans_checks(spark, sf_dir):
    """(check, value, expected, passed): the stored clusters against the RFM table, the run, and its row of the sweep."""
    stored, points, run = _clusters(spark, sf_dir)
    table = order_rfm(spark, sf_dir)
    swept = materialize(lloyd.sweep(points, [run], table, rfm.FEATURES, "CustomerID"), "swept")
    apart = reconcile.keyed_differences(table, stored, "CustomerID", rfm.FEATURES).select("only_left", "only_right", "different")
    labelled = points.join(stored.select(F.col("CustomerID").alias("key"), "Cluster"), "key").select("Cluster", F.transform("x", lambda c: c.cast("double") / lloyd.GRID).alias("v"))
    flat = stored.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("CustomerID").alias("keys"), F.count_distinct("Cluster").alias("labels"), F.count_if(F.greatest(*[F.col(c).isNull() for c in stored.columns])).alias("nulls"))
    one = swept.agg(F.sum("n").alias("swept_n"), F.max("silhouette").alias("swept_silhouette"), F.max("cost").alias("swept_cost"))
    for part in (apart, one, points.agg(F.count(F.lit(1)).alias("points")), clustering.silhouette(labelled, "v", "Cluster").select("silhouette"), clustering.inertia(labelled, "v", "Cluster").agg(F.sum("inertia").alias("cost"))):
        flat = flat.crossJoin(part)  # one row each
    return segments.check_rows(flat, [
        ("clusters are all there", "labels", str(run.k), 0), ("every customer has one row", "n", "keys", 0), ("every point has a row", "n", "points", 0), ("no value is missing", "nulls", "0", 0),
        ("features are unchanged", "only_left + only_right + different", "0", 0), ("sizes match the sweep", "n", "swept_n", 0),
        ("silhouette matches the sweep", "silhouette", "swept_silhouette", 1e-4), ("cost matches the sweep", "round(cost, 1)", "round(swept_cost, 1)", 0.11), ("fit has converged", str(int(run.converged)), "1", 0),
    ])


def kmeans_profile(spark, sf_dir):
    """The profile of the K-Means clusters, each with its name."""
    return segments.profile(_clusters(spark, sf_dir, tenure=True)[0]).withColumn("Name", segments.name())


def kmeans_profile_checks(spark, sf_dir):
    own = _clusters(spark, sf_dir, tenure=True)[0]
    return segments.profile_checks(own, segments.profile(own))


# The whole run


def run_summary(spark, sf_dir):
    """One row: from raw rows to customers."""
    rows = materialize(attributed(spark, sf_dir), "attributed")
    tx = rules.cleaned(rows)
    counts = rows.agg(F.sum("copies").alias("raw_rows"), F.count_if(F.col("removed_by").isNull()).alias("clean_rows"))
    own = tx.agg(F.count_distinct("InvoiceNo").alias("invoices"), F.sum("Amount").cast("double").alias("amount_total"), F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last"))
    customers = rfm.rfm(tx).agg(F.count(F.lit(1)).alias("customers"), F.sum("Frequency").alias("customer_invoices"))
    joined = counts.crossJoin(own).crossJoin(customers)  # one row each
    return joined.withColumn("pct_kept", F.round(100 * F.col("clean_rows") / F.col("raw_rows"), 2))


def _clean_facts(tx: DataFrame) -> DataFrame:
    """One row: rows, customers, invoices and amount of the transactions. Two levels of aggregation count what is distinct without a copy of each row for it."""
    invoices = tx.groupBy("CustomerID", "InvoiceNo").agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("amount"))
    own = invoices.groupBy("CustomerID").agg(F.sum("n").alias("n"), F.count("InvoiceNo").alias("invoices"), F.sum("amount").alias("amount"))
    known = F.coalesce(F.sum(F.when(F.col("CustomerID").isNotNull(), F.col("invoices"))), F.lit(0))
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("clean"), F.count("CustomerID").alias("clean_customers"), known.alias("clean_invoices"), F.sum("amount").cast("double").alias("clean_amount"))


def summary_checks(spark, sf_dir):
    """(check, value, expected, passed): whether the tables of a run agree with one another."""
    rows = materialize(attributed(spark, sf_dir), "attributed")
    tx = rules.cleaned(rows)
    table = materialize(rfm.rfm(tx, tenure=True), "rfm")
    profiled = materialize(segments.profile(segments.rule_segments(table)), "profiled")
    steps = rules.audit(rows).agg(F.max("rows_before").alias("audit_raw"), F.min("rows_after").alias("audit_clean"), F.sum("rows_removed").alias("audit_removed"))
    clean_facts = _clean_facts(tx)
    rfm_facts = table.agg(F.count(F.lit(1)).alias("customers"), F.sum("Frequency").alias("invoices"), F.sum(F.col("Monetary").cast("decimal(28,2)")).cast("double").alias("amount"))
    sizes = profiled.agg(F.sum("CustomerCount").alias("profiled"), F.count(F.lit(1)).alias("k"))
    named = segments.labels(profiled).agg(F.count("Name").alias("named"))
    flat = rows.agg(F.sum("copies").alias("raw"))
    for part in (steps, clean_facts, rfm_facts, sizes, named):
        flat = flat.crossJoin(part)  # one row each
    return segments.check_rows(flat, [
        ("raw rows match the audit", "raw", "audit_raw", 0), ("audit ends at the clean rows", "audit_clean", "clean", 0), ("audit adds up", "audit_raw - audit_removed", "clean", 0), ("customers match", "customers", "clean_customers", 0),
        ("customers are profiled", "profiled", "customers", 0), ("invoices match", "invoices", "clean_invoices", 0), ("amounts match", "amount", "clean_amount", 0.005 * 1000), ("every segment is named", "named", "k", 0),
    ])


def raw_schema(spark, sf_dir):
    """(position, column, type, nullable) of the raw relation, as a reader of its files has it."""
    path = retail_scratch(spark)
    retail.write_csv(raw(spark, sf_dir), path)
    return retail.described(retail.read_raw_csv(spark, path))


# Segments


def _segments(spark, sf_dir):
    return segments.rule_segments(rfm.rfm(order_totals(spark, sf_dir), tenure=True))


def tenure(spark, sf_dir):
    orders = order_totals(spark, sf_dir)
    return segments.with_tenure(orders.select("CustomerID").distinct(), orders)


def cluster_profile(spark, sf_dir):
    return segments.profile(_segments(spark, sf_dir))


def profile_checks(spark, sf_dir):
    own = _segments(spark, sf_dir)
    return segments.profile_checks(own, segments.profile(own))


def segment_labels(spark, sf_dir):
    return segments.labels(segments.profile(_segments(spark, sf_dir)))


# Round trips


def parquet_roundtrip(spark, sf_dir):
    path = retail_scratch(spark)
    retail.write_parquet(clean(spark, sf_dir), path)
    return _as_double(retail.read_parquet(spark, path).groupBy("Country").agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("amount")))


def sized_files(spark, sf_dir):
    """(rows, in_range): all raw rows in files of half a megabyte; whether each file's length is between half and twice of that, unless there is one only."""
    path, size = retail_scratch(spark), 1 << 19
    retail.write_sized(raw(spark, sf_dir), path, size)
    lengths = retail.list_files(spark, path).where("path LIKE '%.parquet'").agg(F.count(F.lit(1)).alias("files"), F.min("length").alias("least"), F.max("length").alias("most"))
    rows = retail.read_parquet(spark, path).agg(F.count(F.lit(1)).alias("rows"))
    fits = (F.col("most") <= 2 * size) & ((F.col("files") == 1) | (2 * F.col("least") >= size))
    return rows.crossJoin(F.broadcast(lengths)).select("rows", fits.alias("in_range"))  # one row each


def csv_roundtrip(spark, sf_dir):
    path = retail_scratch(spark)
    retail.write_csv(raw(spark, sf_dir), path)
    return profiling.missingness(retail.read_raw_csv(spark, path))


def retail_scratch(spark: SparkSession) -> str:
    return scratch_path(spark, "retail")


def sheets_by_row(spark, sf_dir):
    """Two sheets in one set of files, told apart by row number: the first half of the rows, in the order of all columns, is the first sheet."""
    path = retail_scratch(spark)
    retail.write_csv(raw(spark, sf_dir).orderBy(*[F.col(f"`{c}`") for c in retail.RAW_COLUMNS]), path)
    rows = retail.numbered(retail.read_raw_csv(spark, path).select("Invoice"))  # numbered rows are written
    half = rows.agg(F.expr("count(1) div 2").alias("half"))
    told = rows.crossJoin(F.broadcast(half)).withColumn("sheet", F.when(F.col("row") <= F.col("half"), "first").otherwise("second"))  # one row
    return told.groupBy("sheet").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("from_row"), F.max("row").alias("to_row"), F.min("Invoice").alias("first_invoice"), F.max("Invoice").alias("last_invoice"), F.count_distinct("Invoice").alias("invoices"))


def sheet_files(spark, sf_dir):
    """Both halves as files of their own, opened as sheets of one relation: (sheet, rows, first, last)."""
    paths = {name: retail_scratch(spark) for name in ("first", "second")}
    for path, half in zip(paths.values(), _halves(spark, sf_dir), strict=True):
        retail.write_csv(half, path)
    return retail.open_sheets(spark, paths)[1]


def _short_lines(spark, sf_dir):
    """A CSV copy in which the invoices that end in 00 lost their last field, read with what was caught."""
    path = retail_scratch(spark)
    short = F.col("Invoice").endswith("00")
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in retail.RAW_COLUMNS]
    raw(spark, sf_dir).select(F.concat_ws(",", *quoted[:-1], F.when(~short, quoted[-1])).alias("value")).write.text(path)
    return retail.read_raw_csv(spark, path, with_corrupt=True, header=False)


def corrupt_records(spark, sf_dir):
    """How many lines of a damaged copy were caught."""
    return _short_lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(retail.CORRUPT).isNotNull()).alias("corrupt"), F.count_if(F.col("Country").isNull()).alias("no_country"))


def profile_size(spark, sf_dir):
    return profiling.size(materialize(_short_lines(spark, sf_dir), "ingested"))  # the reader doesn't give its corrupt column alone


def model_applied(spark, sf_dir):
    """Customers with odd numbers in the clusters of those with even ones: scaling and centers are fitted on these, stored, read and applied to the others."""
    table = order_rfm(spark, sf_dir)
    fitted, others = table.where("CustomerID % 2 = 0"), table.where("CustomerID % 2 = 1")
    scaler = materialize(clustering.fit_scaler(fitted, Z_FEATURES), "scaler")
    points = lambda rows: lloyd.on_grid(clustering.apply_scaler(rows, scaler), "CustomerID", [f"z_{f}" for f in Z_FEATURES], FINAL_VARIANT)
    runs = lloyd.fit(materialize(points(fitted), "points"), [clustering.selected_k(SELECTED_K)])
    model = materialize(lloyd.model_table(spark, runs, "even"), "model")
    own = lloyd.assigned(points(others), lloyd.from_table(model, "even"))
    return own.select(F.col("key").alias("CustomerID"), F.col("cluster").alias("Cluster"), F.round(F.sqrt("d") / lloyd.GRID, 4).alias("distance"))


def queries() -> dict:
    own = {
        "prepare_typed": prepare_typed, "rule_flags": rule_flags, "dedup_rows": dedup_rows, "cancel_keys": cancel_keys, "cancel_matched": cancel_matched, "cancel_detail": cancel_detail,
        "clean_transactions": clean_transactions, "clean_audit": clean_audit, "clean_summary": clean_summary, "kept_share": kept_share,
        "rfm_orders": rfm_orders, "rfm_events": rfm_events, "rfm_clean": rfm_clean, "rfm_sql_difference": rfm_sql_difference, "rfm_changes": rfm_changes,
        "distinct_by_month": distinct_by_month, "distinct_by_year": distinct_by_year, "sized_files": sized_files,
        "overlap_intersect_all": overlap_intersect_all, "overlap_except_all": overlap_except_all, "union_by_name": union_by_name, "sheet_overlap": sheet_overlap,
        "overlap_report": overlap_report, "run_summary": run_summary, "summary_checks": summary_checks, "raw_schema": raw_schema,
        "scale_zscore": partial(scale_zscore, False), "scale_log1p_zscore": partial(scale_zscore, True), "scaling_summary": scaling_summary,
        "kmeans_assign_fixed": kmeans_assign_fixed, "silhouette": silhouette, "inertia": inertia, "cluster_means": cluster_means, "kmeans_fit": kmeans_fit, "k_sweep": k_sweep,
        "kmeans_facts": kmeans_facts, "kmeans_checks": kmeans_checks, "kmeans_profile": kmeans_profile, "kmeans_profile_checks": kmeans_profile_checks,
        "tenure": tenure, "cluster_profile": cluster_profile, "profile_checks": profile_checks, "segment_labels": segment_labels,
        "parquet_roundtrip": parquet_roundtrip, "csv_roundtrip": csv_roundtrip, "corrupt_records": corrupt_records, "sheets_by_row": sheets_by_row, "sheet_files": sheet_files, "profile_size": profile_size, "model_applied": model_applied,
    }
    profiles = {
        "missingness": profiling.missingness, "unparseable": profiling.unparseable, "duplicate_profile": profiling.duplicates, "duplicate_by_month": profiling.duplicates_by_month,
        "cardinality": profiling.cardinality, "numeric_stats": profiling.numeric_stats, "date_range": profiling.date_range, "rows_by_month": profiling.rows_by_month, "invoice_types": profiling.invoice_types,
        "value_issues": profiling.value_issues, "customer_issues": profiling.customer_issues, "special_codes": profiling.special_codes, "top_countries": profiling.top_countries, "profile_samples": profiling.samples,
    }
    customers = {"rfm_describe": rfm.describe, "rfm_iqr_outliers": rfm.iqr_outliers, "rfm_correlation": rfm.correlations, "rfm_one_time": rfm.one_time_buyers, "rfm_top_share": rfm.top_share, "rfm_top5": rfm.top_customers}
    return own | {n: partial(profiled, f) for n, f in profiles.items()} | {n: partial(over_orders, f) for n, f in customers.items()}
