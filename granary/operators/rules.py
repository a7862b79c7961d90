"""Declarative cleaning rules: each removed row is attributed to the first rule that it breaks, in one pass.

Equal raw rows are first folded into one with a count of copies, by digests; as all row-local rules see nothing but the raw columns, this
gives the same as removing copies after the first rules. Then come the cancellations, carried back in time to the purchases of their key, and the
remaining rules as one CASE. The audit is one aggregation over what each folded row contributes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.sift import with_maybe
from granary.functions.small import small_table
from granary.functions.typed import blank, typed, violated
from granary.operators import bags
from granary.sources.retail import RAW_COLUMNS
from granary.sources.scratch import materialize

#: Six digits; a cancellation has the prefix before them.
INVOICE_PATTERN, CANCEL_PREFIX = r"^\d{6}$", "C"

#: Stock codes that are fees, adjustments, tests and vouchers.
NON_PRODUCT_CODES = [
    "POST", "DOT", "C2", "M", "m", "D", "S", "B", "BANK CHARGES", "AMAZONFEE", "ADJUST", "ADJUST2", "CRUK", "TEST001", "TEST002", "GIFT",
    "gift_0001_10", "gift_0001_20", "gift_0001_30", "gift_0001_40", "gift_0001_50", "gift_0001_60", "gift_0001_70", "gift_0001_80", "gift_0001_90",
]

DUPLICATES, CANCELLED = "duplicate_rows", "cancelled_invoices"


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column

    @property
    def flag(self) -> Column:
        return violated(self.broken)


def is_cancel() -> Column:
    return violated(F.col("InvoiceNo").startswith(CANCEL_PREFIX))


def parsing_rules() -> list[Rule]:
    """Rules that come before copies and cancellations."""
    missing = F.col("InvoiceNo").isNull() | F.col("StockCode").isNull() | F.col("Quantity").isNull() | F.col("UnitPrice").isNull()
    return [Rule("invalid_invoice_date", F.col("InvoiceDate").isNull()), Rule("invalid_values", missing)]


def sale_rules(codes: list[str] | None = None) -> list[Rule]:
    """Rules that come after them."""
    return [
        Rule("non_sale_invoices", ~is_cancel() & ~F.col("InvoiceNo").rlike(INVOICE_PATTERN)),
        Rule("quantity_non_positive", F.col("Quantity") <= 0),
        Rule("unit_price_non_positive", F.col("UnitPrice") <= 0),
        Rule("missing_customer_id", F.col("CustomerID").isNull() | blank(F.col("CustomerID"))),
        Rule("non_product_stockcode", F.col("StockCode").isin(codes or NON_PRODUCT_CODES)),
    ]


def rule_order() -> list[str]:
    return [*(r.name for r in parsing_rules()), DUPLICATES, CANCELLED, *(r.name for r in sale_rules())]


def first_broken(rules: list[Rule]) -> Column:
    """The name of the first broken rule, or null."""
    return F.coalesce(*[F.when(r.flag, F.lit(r.name)) for r in rules])


def folded(raw: DataFrame) -> DataFrame:
    """One typed row for each distinct raw row (nulls are equal), with ``copies``."""
    return typed(bags.counted(raw, RAW_COLUMNS, {"copies": F.lit(1)}), "copies")


#: Keys with a cancellation up to which the others' rows are told by a broadcast of their digests, 8 bytes each.
BROADCAST_KEYS = 1_000_000


def match_cancellations(rows: DataFrame, broadcast_keys: int | None = None) -> DataFrame:
    """Add ``cancels`` and ``last_cancel`` of a row's key, and ``matched``: purchases that a cancellation takes back.

    The key is customer, stock code, absolute quantity and price; without a customer nothing matches. Purchases and cancellations of a key lie on one
    time line, read backwards: the latest cancellation opens it, and from there on each purchase closes one of the key's cancellations, until none is open.
    Ties go by invoice, description, country. So there is no join: one shuffle, one sort, and running counts.

    Rows are read three times: give stored ones. Only rows of keys with a cancellation take part. Digests of these keys tell them from the others, which don't move; with more than ``broadcast_keys``
    of them a filter of 32 MB at most does, and the few rows of other keys that it lets through take part, with the same result.
    """
    bound = BROADCAST_KEYS if broadcast_keys is None else broadcast_keys
    key = [F.col("CustomerID"), F.col("StockCode"), F.abs("Quantity"), F.col("UnitPrice")]
    cancel = is_cancel() & F.col("CustomerID").isNotNull()
    digest = F.xxhash64(*key)
    opened = materialize(rows.where(cancel).select(digest.alias("opened")).distinct(), "cancelled-keys")
    takes_part = violated(F.col("CustomerID").isNotNull() & (is_cancel() | (F.col("Quantity") > 0)))
    n = opened.count()
    if n <= bound:
        marked = rows.join(F.broadcast(opened), digest == F.col("opened"), "left").withColumn("maybe", F.col("opened").isNotNull()).drop("opened")
    else:
        marked = with_maybe(rows, digest, opened, F.col("opened"), n)
    takes_part = takes_part & F.col("maybe")
    size = F.col("_size")  # a column, not an expression, so that both windows see one partitioning
    backwards = Window.partitionBy("CustomerID", "StockCode", size, "UnitPrice").orderBy(*[F.col(c).desc_nulls_last() for c in ("InvoiceDate", "InvoiceNo", "Description", "Country")])
    whole, so_far = (backwards.rowsBetween(Window.unboundedPreceding, end) for end in (Window.unboundedFollowing, Window.currentRow))
    line = marked.where(takes_part).drop("maybe").withColumn("_size", F.abs("Quantity")).withColumns({"cancels": F.count_if(cancel).over(whole), "last_cancel": F.max(F.when(cancel, F.col("InvoiceDate"))).over(whole)})
    closes = violated(~cancel & (F.col("InvoiceDate") <= F.col("last_cancel")))
    closed = F.count_if("closes").over(so_far)
    told = line.withColumn("closes", closes).withColumn("matched", F.col("closes") & (closed <= F.col("cancels"))).drop("closes", "_size").withColumn("cancels", F.nullif("cancels", F.lit(0)))
    others = marked.where(~takes_part).drop("maybe").withColumns({"cancels": F.lit(None).cast("long"), "last_cancel": F.lit(None).cast("timestamp_ntz"), "matched": F.lit(False)})
    return told.unionByName(others)


def attributed(raw: DataFrame) -> DataFrame:
    """Every distinct raw row with ``copies``, ``removed_by`` (null: it stays) and ``matched``."""
    rows = materialize(folded(raw).withColumn("early", first_broken(parsing_rules())), "folded")
    sound = match_cancellations(rows.where("early IS NULL"))
    late = F.coalesce(F.when(is_cancel() | F.col("matched"), F.lit(CANCELLED)), first_broken(sale_rules()))
    broken = rows.where("early IS NOT NULL").withColumns({"cancels": F.lit(None).cast("long"), "last_cancel": F.lit(None).cast("timestamp_ntz"), "matched": F.lit(False), "removed_by": F.col("early")})
    return sound.withColumn("removed_by", late).unionByName(broken)


CLEAN_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country", "Amount"]


def cleaned(attributed_rows: DataFrame) -> DataFrame:
    return attributed_rows.where("removed_by IS NULL").select(*CLEAN_COLUMNS)


def audit(attributed_rows: DataFrame) -> DataFrame:
    """(step, rule, rows_before, rows_removed, rows_after, amount_removed), one row for each rule, by one aggregation to a row for each rule and kind."""
    order = rule_order()
    amount = lambda n: F.sum((F.col("Amount") * n).cast("decimal(28,3)"))
    one, rest = F.lit(1), F.col("copies") - 1
    few = attributed_rows.groupBy("removed_by", F.col("early").isNotNull().alias("whole")).agg(  # some dozen rows
        F.count(F.lit(1)).alias("n"), F.sum("copies").alias("all"), amount(F.col("copies")).alias("all_amount"), amount(rest).alias("rest_amount"), amount(one).alias("one_amount")
    )
    part = lambda rule, n, amount: F.struct(rule.alias("rule"), n.alias("n"), F.col(amount).alias("amount"))
    whole = F.array(part(F.col("removed_by"), F.col("all"), "all_amount"))
    split = F.array(part(F.lit(DUPLICATES), F.col("all") - F.col("n"), "rest_amount"), part(F.coalesce("removed_by", F.lit("")), F.col("n"), "one_amount"))
    parts = few.select(F.explode(F.when(F.col("whole"), whole).otherwise(split)).alias("x")).select("x.*")
    sums = parts.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    steps = small_table(attributed_rows.sparkSession, {"step": "int", "rule": "string"}, list(enumerate([*order, ""], 1)))
    table = steps.join(sums, "rule", "left").select("step", "rule", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0)).cast("decimal(28,3)").alias("amount"))
    after = Window.orderBy("step")  # ten rows
    left = F.coalesce(F.sum("n").over(after.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return table.select("step", "rule", (left + F.col("n")).alias("rows_before"), F.col("n").alias("rows_removed"), left.alias("rows_after"), F.col("amount").alias("amount_removed")).where("rule != ''")
