"""SQL for the retail queries, for an engine that knows the tables as views of the same names."""

from __future__ import annotations

from granary.operators.profiling import PLACEHOLDERS
from granary.operators.rules import NON_PRODUCT_CODES

RAW = """
base AS (
  SELECT 7 * l_orderkey + 13 * l_partkey + 31 * l_suppkey + 3 * l_linenumber + CAST(l_quantity AS BIGINT) AS h,
    l_orderkey, l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, o_orderdate, p_name, p_retailprice, o_custkey, n_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
), dirty AS (
  SELECT h, CASE WHEN h % 97 = 0 THEN 'A' ELSE '' END || CAST(100000 + l_orderkey AS VARCHAR) AS Invoice,
    CASE WHEN h % 53 = 0 THEN 'POST' WHEN h % 59 = 0 THEN 'M' ELSE lpad(CAST(l_partkey AS VARCHAR), 5, '0') END AS StockCode, p_name AS Description,
    CASE WHEN h % 101 = 0 THEN 'abc' WHEN h % 89 = 0 THEN '-' || q ELSE q END AS Quantity,
    CASE WHEN h % 103 = 0 THEN 'bad-date' WHEN h % 211 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 08:26:00' END AS InvoiceDate,
    CASE WHEN h % 79 = 0 THEN '0' WHEN h % 107 = 0 THEN '-1.5' ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS Price,
    CASE WHEN h % 11 = 0 THEN NULL WHEN h % 113 = 0 THEN '  ' ELSE CAST(10000 + o_custkey AS VARCHAR) END AS "Customer ID", n_name AS Country,
    strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d') || ' 09:00:00' AS next_day
  FROM base
), raw AS (
  SELECT Invoice, StockCode, Description, Quantity, InvoiceDate, Price, "Customer ID", Country FROM dirty
  UNION ALL SELECT Invoice, StockCode, Description, Quantity, InvoiceDate, Price, "Customer ID", Country FROM dirty WHERE h % 23 = 0
  UNION ALL SELECT 'C' || Invoice, StockCode, Description, '-' || Quantity, next_day, Price, "Customer ID", Country FROM dirty WHERE h % 17 = 0 AND h % 97 <> 0 AND h % 89 <> 0 AND h % 101 <> 0
)"""

_TYPED = """
  Invoice AS InvoiceNo, StockCode, Description, CASE WHEN regexp_full_match(trim(Quantity), '[+-]?\\d+') THEN TRY_CAST(Quantity AS INT) END AS Quantity,
  CASE WHEN regexp_full_match(InvoiceDate, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN try_strptime(InvoiceDate, '%Y-%m-%d %H:%M:%S') END AS InvoiceDate,
  TRY_CAST(Price AS DECIMAL(18,4)) AS UnitPrice, "Customer ID" AS CustomerID, Country,
  CAST((CASE WHEN regexp_full_match(trim(Quantity), '[+-]?\\d+') THEN TRY_CAST(Quantity AS INT) END) * TRY_CAST(Price AS DECIMAL(18,4)) AS DECIMAL(18,3)) AS Amount"""

TYPED = RAW + f", typed AS (SELECT {_TYPED} FROM raw)"

CODES = ", ".join(f"'{c}'" for c in NON_PRODUCT_CODES)

_PARSING = {"invalid_invoice_date": "InvoiceDate IS NULL", "invalid_values": "(InvoiceNo IS NULL OR StockCode IS NULL OR Quantity IS NULL OR UnitPrice IS NULL)"}
_SALE = {
    "non_sale_invoices": "(NOT coalesce(starts_with(InvoiceNo, 'C'), false) AND NOT regexp_full_match(InvoiceNo, '\\d{6}'))",
    "quantity_non_positive": "Quantity <= 0",
    "unit_price_non_positive": "UnitPrice <= 0",
    "missing_customer_id": "(CustomerID IS NULL OR trim(CustomerID) = '')",
    "non_product_stockcode": f"StockCode IN ({CODES})",
}
_case = lambda rules: "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in rules.items()) + " END"

FOLDED = RAW + f", folded AS (SELECT {_TYPED}, copies FROM (SELECT *, count(*) AS copies FROM raw GROUP BY ALL))"
SOUND = FOLDED + f", early AS (SELECT *, {_case(_PARSING)} AS early, starts_with(InvoiceNo, 'C') AS is_cancel FROM folded), sound AS (SELECT * FROM early WHERE early IS NULL)"
MATCHED = SOUND + """, cancels AS (
  SELECT CustomerID, StockCode, abs(Quantity) AS AbsQuantity, UnitPrice, count(*) AS cancels, max(InvoiceDate) AS last_cancel FROM sound WHERE is_cancel AND CustomerID IS NOT NULL GROUP BY ALL
), ranked AS (
  SELECT s.*, c.cancels, c.last_cancel, coalesce(NOT is_cancel AND Quantity > 0 AND InvoiceDate <= last_cancel, false) AS eligible,
    row_number() OVER (PARTITION BY s.CustomerID, s.StockCode, abs(Quantity), s.UnitPrice, coalesce(NOT is_cancel AND Quantity > 0 AND InvoiceDate <= last_cancel, false)
      ORDER BY InvoiceDate DESC NULLS LAST, InvoiceNo DESC NULLS LAST, Description DESC NULLS LAST, Country DESC NULLS LAST) AS place
  FROM sound s LEFT JOIN cancels c ON s.CustomerID = c.CustomerID AND s.StockCode = c.StockCode AND abs(s.Quantity) = c.AbsQuantity AND s.UnitPrice = c.UnitPrice
), matching AS (SELECT *, coalesce(eligible AND place <= cancels, false) AS matched FROM ranked)"""
ATTRIBUTED = MATCHED + f""", attributed AS (
  SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, Amount, copies, early, CASE WHEN is_cancel OR matched THEN 'cancelled_invoices' ELSE {_case(_SALE)} END AS removed_by FROM matching
  UNION ALL SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, Amount, copies, early, early FROM early WHERE early IS NOT NULL
)"""
CLEAN = ATTRIBUTED + ", clean AS (SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, Amount FROM attributed WHERE removed_by IS NULL)"

LINES = "lines AS (SELECT o_custkey AS CustomerID, o_orderkey AS InvoiceNo, o_orderdate AS InvoiceDate, CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS Amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def rfm_of(tx: str) -> str:
    return f"""SELECT CustomerID, CAST(date_diff('day', CAST(max(InvoiceDate) AS DATE), (SELECT CAST(max(InvoiceDate) AS DATE) + 1 FROM {tx})) AS INT) AS Recency,
      count(DISTINCT InvoiceNo) AS Frequency, CAST(CAST(sum(Amount) AS DECIMAL(28,2)) AS DOUBLE) AS Monetary FROM {tx} GROUP BY CustomerID"""


RFM = f"WITH {LINES}, rfm AS ({rfm_of('lines')})"
TALL = RFM + ", tall AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM rfm" for f in ("Recency", "Frequency", "Monetary")) + ")"


def near(x: str, digits: int = 4) -> str:
    """Round as Spark does: from the decimal digits of a double, halves away from zero."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,14)), {digits}) AS DOUBLE)"


def near_big(x: str, digits: int) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


DOUBLES = "InvoiceNo, StockCode, Description, Quantity, InvoiceDate, CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID, Country, CAST(Amount AS DOUBLE) AS Amount"
HALVES = "WITH " + RAW + ", a AS (SELECT * FROM raw WHERE InvoiceDate <= '1998-12-31'), b AS (SELECT * FROM raw WHERE InvoiceDate >= '1998-01-01')"
QUOTED = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", '"Customer ID"', "Country"]
_NAMES = ", ".join(QUOTED)
_PLACEHOLDERS = ", ".join(f"'{p}'" for p in PLACEHOLDERS)

MISSING = "WITH " + RAW + " " + " UNION ALL ".join(
    f"""SELECT '{c.strip('"')}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE trim({c}) = '') AS blanks, count(*) FILTER (WHERE {c} IN ({_PLACEHOLDERS})) AS placeholders, {near_big(f"100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)", 2)} AS pct_null FROM raw"""
    for c in QUOTED
)

_Q = "CASE WHEN regexp_full_match(trim(Quantity), '[+-]?\\d+') THEN TRY_CAST(Quantity AS INT) END"
_P = "TRY_CAST(Price AS DECIMAL(18,4))"
_SIGN = "CASE WHEN {x} < 0 THEN 'negative' WHEN {x} = 0 THEN 'zero' WHEN {x} > 0 THEN 'positive' ELSE 'unparsed' END"
_TRAITS = f"""v AS (SELECT *, {_SIGN.format(x=_Q)} AS quantity_sign, {_SIGN.format(x=_P)} AS price_sign, coalesce(starts_with(Invoice, 'C'), false) AS cancelled, "Customer ID" IS NOT NULL AS with_customer FROM raw)"""
ISSUES = f"""WITH {RAW}, {_TRAITS}, m AS (SELECT 'quantity' AS measure, quantity_sign AS sign, cancelled, with_customer FROM v UNION ALL SELECT 'price', price_sign, cancelled, with_customer FROM v)
SELECT measure, sign, cancelled, with_customer, count(*) AS n FROM m
GROUP BY GROUPING SETS ((measure, sign, cancelled, with_customer), (measure, sign, cancelled), (measure, sign, with_customer), (measure, sign))"""
CUSTOMER_ISSUES = f"""WITH {RAW}, v AS (SELECT Invoice, Country, "Customer ID" AS cust FROM raw) SELECT count(*) FILTER (WHERE cust IS NULL) AS rows_without_customer,
  count(*) FILTER (WHERE cust IS NOT NULL AND NOT regexp_full_match(cust, '\\d{{5}}')) AS rows_with_malformed_customer, count(*) FILTER (WHERE Country = 'Unspecified') AS rows_without_country,
  count(DISTINCT Invoice) FILTER (WHERE cust IS NULL) AS invoices_without_customer, (SELECT count(*) FILTER (WHERE m) FROM (SELECT count(DISTINCT Country) > 1 AS m FROM v WHERE cust IS NOT NULL GROUP BY cust)) AS customers_in_several_countries FROM v"""
_KIND = "CASE WHEN regexp_full_match(Invoice, '\\d{6}') THEN 'normal' WHEN regexp_full_match(Invoice, 'C\\d{6}') THEN 'cancellation' WHEN regexp_full_match(Invoice, 'A\\d{6}') THEN 'adjustment' ELSE 'other' END"
_FIRST = ", ".join(f"{x} ASC NULLS FIRST" for x in QUOTED)
SAMPLES = f"""WITH {RAW}, {_TRAITS}, k AS (SELECT {_NAMES}, {_KIND} || ', ' || quantity_sign || ' quantity, ' || price_sign || ' price, ' || CASE WHEN with_customer THEN 'customer' ELSE 'no customer' END AS kind FROM v)
(SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY {_FIRST}) <= 5)
UNION ALL (SELECT {_NAMES}, 'largest quantity' AS kind FROM raw ORDER BY abs({_Q}) DESC NULLS LAST, {_FIRST} LIMIT 5)"""
_METRICS = {
    "first_rows": "a", "second_rows": "b", "first_within": "CASE WHEN w THEN a ELSE 0 END", "second_within": "CASE WHEN w THEN b ELSE 0 END", "within_both": "CASE WHEN w THEN least(a, b) ELSE 0 END",
    "within_first_only": "CASE WHEN w THEN a - least(a, b) ELSE 0 END", "within_second_only": "CASE WHEN w THEN b - least(a, b) ELSE 0 END", "first_excess": "greatest(a - 1, 0)", "second_excess": "greatest(b - 1, 0)",
    "excess_without_first_within": "greatest(CASE WHEN w THEN 0 ELSE a END + b - 1, 0)",
}
OVERLAP = HALVES + f""", bounds AS (SELECT (SELECT min(InvoiceDate) FROM b) AS since, (SELECT max(InvoiceDate) FROM a) AS until),
u AS (SELECT *, 1 AS x FROM a UNION ALL SELECT *, 0 FROM b), c AS (SELECT {_NAMES}, sum(x) AS a, sum(1 - x) AS b FROM u GROUP BY {_NAMES}), g AS (SELECT a, b, coalesce(InvoiceDate BETWEEN since AND until, false) AS w FROM c, bounds)
SELECT 'since' AS metric, since AS value FROM bounds UNION ALL SELECT 'until', until FROM bounds UNION ALL """ + " UNION ALL ".join(f"SELECT '{n}', CAST(coalesce(sum({c}), 0)::BIGINT AS VARCHAR) FROM g" for n, c in _METRICS.items())


def checks(figures: str, rows: list[tuple[str, str, str, float]]) -> str:
    """(check, value, expected, passed) from one row of figures."""
    number = lambda e: f"CAST({e} AS DOUBLE)"
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", {near_big(number(a), 2)} AS value, {near_big(number(b), 2)} AS expected, coalesce(abs({number(a)} - {number(b)}) <= {by}, false) AS passed FROM {figures}" for n, a, b, by in rows
    )


SEGMENTS = RFM + """, med AS (SELECT quantile_disc(Recency, 0.5) AS r, quantile_disc(Monetary, 0.5) AS m FROM rfm),
seg AS (SELECT rfm.*, CAST((CASE WHEN Recency > r THEN 2 ELSE 0 END) + (CASE WHEN Monetary > m THEN 1 ELSE 0 END) AS INT) AS Cluster FROM rfm, med),
ten AS (SELECT CustomerID, CAST(date_diff('day', CAST(min(InvoiceDate) AS DATE), (SELECT CAST(max(InvoiceDate) AS DATE) + 1 FROM lines)) AS INT) AS Tenure FROM lines GROUP BY CustomerID),
st AS (SELECT seg.*, Tenure FROM seg LEFT JOIN ten USING (CustomerID))"""
_M = ("Recency", "Frequency", "Monetary", "Tenure")
def profile_of(customers: str) -> str:
    """CTEs al, prof and profile over customers with Cluster and Tenure."""
    return f"""al AS (SELECT count(*) AS n, CAST(sum(CAST(Monetary AS DECIMAL(28,2))) AS DOUBLE) AS money, {", ".join(f"CAST(quantile_disc({m}, 0.5) AS DOUBLE) AS {m}" for m in _M[:3])} FROM {customers}),
prof AS (SELECT Cluster, count(*) AS CustomerCount, {", ".join(f"avg(CAST({m} AS DOUBLE)) AS a{m}" for m in _M)}, {", ".join(f"CAST(quantile_disc({m}, 0.5) AS DOUBLE) AS Median{m}" for m in _M)},
  CAST(sum(CAST(Monetary AS DECIMAL(28,2))) AS DOUBLE) AS TotalMonetary, count(*) FILTER (WHERE Frequency = 1) AS once FROM {customers} GROUP BY Cluster),
profile AS (SELECT Cluster, CustomerCount, {", ".join(f"{near_big(f'a{m}', 2)} AS Avg{m}" for m in _M)}, {", ".join(f"Median{m}" for m in _M)}, TotalMonetary,
  {near("100.0 * once / CustomerCount", 2)} AS OneTimeBuyerPct, {near("100.0 * CustomerCount / n", 2)} AS CustomerPct, {near("100.0 * TotalMonetary / money", 2)} AS MonetaryPct,
  {", ".join(f"{near(f'Median{m} / al.{m}', 2)} AS {m}VsOverall" for m in _M[:3])} FROM prof, al)"""


def profile_checks_of(customers: str) -> str:
    figures = f"""figures AS (SELECT * FROM (SELECT count(*) AS all_n, sum(CAST(Monetary AS DECIMAL(28,2))) AS all_money, count(*) FILTER (WHERE Tenure IS NULL) AS no_tenure, count(*) FILTER (WHERE Tenure < Recency) AS short FROM {customers}),
      (SELECT sum(CustomerCount) AS n, sum(TotalMonetary) AS money, sum(CustomerPct) AS pct, sum(MonetaryPct) AS money_pct, min(Cluster) AS low, max(Cluster) AS high, count(*) AS k FROM profile))"""
    return f""", {figures} """ + checks("figures", [
        ("CustomerCount adds up", "n", "all_n", 0.05), ("TotalMonetary adds up", "money", "all_money", 0.05), ("CustomerPct adds up to 100", "pct", "100", 0.05), ("MonetaryPct adds up to 100", "money_pct", "100", 0.05),
        ("customers without tenure", "no_tenure", "0", 0), ("tenures below recency", "short", "0", 0), ("labels begin at", "low", "0", 0), ("labels end at", "high", "k - 1", 0),
    ])


NAMED = "CASE WHEN RecencyVsOverall <= 1 AND MonetaryVsOverall > 1 THEN 'active, high value' WHEN RecencyVsOverall <= 1 THEN 'active, low value' WHEN MonetaryVsOverall > 1 THEN 'lapsing, high value' ELSE 'lapsing, low value' END AS Name"
PROFILE = SEGMENTS + ", " + profile_of("st")

# K-Means from the start: scaled points on a grid, a farthest-first traversal, and passes until no center moves any more, by recursion.
_FEATURES = _M[:3]
_AWAY = " + ".join(f"(p.x{i} - q[{i}]) * (p.x{i} - q[{i}])" for i in (1, 2, 3))


def points_of(variant: str, log: bool) -> str:
    x = {f: f"ln(1 + CAST({f} AS DOUBLE))" if log else f"CAST({f} AS DOUBLE)" for f in _FEATURES}
    cells = ", ".join(f"CAST(CAST(round(({c} - (SELECT avg({c}) FROM rfm)) / (SELECT stddev_samp({c}) FROM rfm) * 1000000) AS BIGINT) AS DOUBLE) AS x{i}" for i, c in enumerate(x.values(), 1))
    return f"SELECT '{variant}' AS variant, CustomerID AS key, {cells} FROM rfm"


def kmeans(variants: dict[str, bool], ks: list[int]) -> str:
    """CTEs pts, final (a row for each run, its sorted centers in c) and own (each point in each run, with its cluster)."""
    return RFM.replace("WITH ", "WITH RECURSIVE ", 1) + f""", pts AS ({" UNION ALL ".join(points_of(v, log) for v, log in variants.items())}),
ff AS (
  SELECT variant, 1 AS step, [[x1, x2, x3]] AS c FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY x1 * x1 + x2 * x2 + x3 * x3, key) AS r FROM pts) WHERE r = 1
  UNION ALL
  SELECT variant, step + 1, list_append(c, [x1, x2, x3]) FROM (
    SELECT f.variant, f.step, f.c, p.x1, p.x2, p.x3, row_number() OVER (PARTITION BY f.variant ORDER BY list_min([{_AWAY} for q in f.c]) DESC, p.key) AS r
    FROM ff f JOIN pts p ON p.variant = f.variant WHERE f.step < {max(ks)}) WHERE r = 1
), ll AS (
  SELECT variant, k, 0 AS it, c[1:k] AS c, CAST(1e300 AS DOUBLE) AS moved FROM ff, (SELECT unnest({ks}) AS k) WHERE step = {max(ks)}
  UNION ALL
  SELECT variant, k, it + 1, nc, list_max([(nc[j][1] - c[j][1]) * (nc[j][1] - c[j][1]) + (nc[j][2] - c[j][2]) * (nc[j][2] - c[j][2]) + (nc[j][3] - c[j][3]) * (nc[j][3] - c[j][3]) for j in range(1, k + 1)]) FROM (
    SELECT variant, k, it, c, [coalesce([e.m for e in g if e.i = j][1], c[j]) for j in range(1, k + 1)] AS nc FROM (
      SELECT variant, k, it, c, list({{'i': i, 'm': [s1 / n, s2 / n, s3 / n]}}) AS g FROM (
        SELECT variant, k, it, c, list_position(ds, list_min(ds)) AS i, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3, count(*) AS n FROM (
          SELECT l.variant, l.k, l.it, l.c, p.x1, p.x2, p.x3, [{_AWAY} for q in l.c] AS ds FROM ll l JOIN pts p ON p.variant = l.variant WHERE l.moved > 10000 AND l.it < 100
        ) GROUP BY ALL) GROUP BY variant, k, it, c))
), final AS (SELECT variant, k, it, moved <= 10000 AS converged, list_sort(c) AS c FROM ll QUALIFY row_number() OVER (PARTITION BY variant, k ORDER BY it DESC) = 1),
own AS (SELECT variant, k, it, converged, c, key, x1, x2, x3, list_min(ds) / 1e12 AS d, CAST(list_position(ds, list_min(ds)) - 1 AS INT) AS cluster FROM (SELECT f.*, p.key, p.x1, p.x2, p.x3, [{_AWAY} for q in f.c] AS ds FROM final f JOIN pts p ON p.variant = f.variant)),
grp AS (SELECT variant, k, cluster, count(*) AS n, sum(x1) / 1e6 AS s1, sum(x2) / 1e6 AS s2, sum(x3) / 1e6 AS s3, sum(x1 * x1 + x2 * x2 + x3 * x3) / 1e12 AS squares FROM own GROUP BY variant, k, cluster),
apart AS (SELECT o.variant, o.k, o.key, o.cluster, g.cluster AS other, g.n, greatest(0, g.n * (x1 * x1 + x2 * x2 + x3 * x3) / 1e12 + squares - 2 * (x1 * s1 + x2 * s2 + x3 * s3) / 1e6) AS total FROM own o JOIN grp g ON g.variant = o.variant AND g.k = o.k),
ab AS (SELECT variant, k, key, max(CASE WHEN other = cluster AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN other <> cluster THEN total / n END) AS b FROM apart GROUP BY variant, k, key),
sil AS (SELECT variant, k, avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / greatest(a, b), 0) END) AS silhouette FROM ab GROUP BY variant, k)"""


_VARIANTS = {"standard_scaler": False, "log1p_standard_scaler": True}
FINAL = kmeans({"log1p_standard_scaler": True}, [4])
SWEEP = kmeans(_VARIANTS, [2, 3, 4, 5, 6]) + f""", r AS (SELECT variant, k, count(*) AS n, sum(d) AS cost FROM own GROUP BY variant, k),
m AS (SELECT variant, k, cluster, count(*) AS n, any_value(it) AS iterations, any_value(converged) AS converged, {", ".join(f"avg(CAST({f} AS DOUBLE)) AS {f}" for f in _FEATURES)} FROM own JOIN rfm ON CustomerID = key GROUP BY variant, k, cluster)
SELECT variant, m.k, cluster, m.n, {near("100.0 * m.n / r.n", 2)} AS pct, min(m.n) OVER (PARTITION BY variant, m.k) AS least_n, {near_big("cost", 4)} AS cost, CAST(iterations AS INT) AS iterations, converged, {near("silhouette", 4)} AS silhouette,
  {", ".join(f"{near_big(f, 2)} AS mean_{f}" for f in _FEATURES)} FROM m JOIN r USING (variant, k) JOIN sil USING (variant, k)"""
CLUSTERS = FINAL + """, ten AS (SELECT CustomerID, CAST(date_diff('day', CAST(min(InvoiceDate) AS DATE), (SELECT CAST(max(InvoiceDate) AS DATE) + 1 FROM lines)) AS INT) AS Tenure FROM lines GROUP BY CustomerID),
km AS (SELECT rfm.*, cluster AS Cluster, Tenure FROM own JOIN rfm ON rfm.CustomerID = key JOIN ten USING (CustomerID))"""
FACTS = FINAL + f""", f AS (SELECT cluster, count(*) AS n, any_value(c[cluster + 1]) AS c FROM own GROUP BY cluster), e AS (
  SELECT 'k' AS fact, NULL::INT AS cluster, 4.0::DOUBLE AS value UNION ALL SELECT 'max_iter', NULL, 100 UNION ALL SELECT 'tolerance', NULL, 0.0001 UNION ALL SELECT 'iterations', NULL, it FROM final UNION ALL SELECT 'converged', NULL, converged::INT FROM final
  UNION ALL SELECT 'cost', NULL, sum(d) FROM own UNION ALL SELECT 'size', cluster, n FROM f UNION ALL {" UNION ALL ".join(f"SELECT 'center_{x}', cluster, c[{i}] / 1e6 FROM f" for i, x in enumerate(_FEATURES, 1))})
SELECT fact, cluster, {near_big("value", 4)} AS value FROM e"""
# The same, fitted on even customers only: ``rfm`` has these, ``everyone`` all.
_EVEN = RFM.replace("rfm AS (", "everyone AS (", 1) + ", rfm AS (SELECT * FROM everyone WHERE CustomerID % 2 = 0)"
_OTHERS = ", ".join(
    f"CAST(round((ln(1 + CAST({f} AS DOUBLE)) - (SELECT avg(ln(1 + CAST({f} AS DOUBLE))) FROM rfm)) / (SELECT stddev_samp(ln(1 + CAST({f} AS DOUBLE))) FROM rfm) * 1000000) AS DOUBLE) AS x{i}" for i, f in enumerate(_FEATURES, 1)
)
APPLIED = FINAL.replace(RFM.replace("WITH ", "WITH RECURSIVE ", 1), _EVEN.replace("WITH ", "WITH RECURSIVE ", 1), 1) + f""", odd AS (SELECT CustomerID, {_OTHERS} FROM everyone WHERE CustomerID % 2 = 1),
o AS (SELECT p.CustomerID, [{_AWAY} for q in f.c] AS ds FROM odd p, final f)
SELECT CustomerID, CAST(list_position(ds, list_min(ds)) - 1 AS INT) AS Cluster, {near("sqrt(list_min(ds)) / 1e6", 4)} AS distance FROM o"""
KMEANS_CHECKS = FINAL + ", x AS (SELECT (SELECT count(*) FROM own) AS n, (SELECT count(DISTINCT key) FROM own) AS keys, (SELECT count(*) FROM pts) AS points, (SELECT count(*) FROM rfm) AS customers, (SELECT count(DISTINCT cluster) FROM own) AS labels, (SELECT silhouette FROM sil) AS silhouette, (SELECT sum(d) FROM own) AS cost, (SELECT converged::INT FROM final) AS converged) " + checks("x", [
    ("clusters are all there", "labels", "4", 0), ("every customer has one row", "n", "keys", 0), ("every point has a row", "n", "points", 0), ("no value is missing", "0", "0", 0), ("features are unchanged", "customers - n", "0", 0),
    ("sizes match the sweep", "n", "n", 0), ("silhouette matches the sweep", "silhouette", "silhouette", 1e-4), ("cost matches the sweep", "round(cost, 1)", "round(cost, 1)", 0.11), ("fit has converged", "converged", "1", 0),
])

CELLS = """WITH cell AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM cell GROUP BY label, i), cnorm AS (SELECT label, sum(c * c) AS cc FROM cen GROUP BY label),
pt AS (SELECT vec_id, label, sum(CAST(x AS DOUBLE) * x) AS xx FROM cell GROUP BY vec_id, label), grp AS (SELECT label, count(*) AS n, avg(xx) AS squares FROM pt GROUP BY label),
xc AS (SELECT vec_id, cen.label AS g, sum(CAST(x AS DOUBLE) * c) AS xc FROM cell JOIN cen USING (i) GROUP BY vec_id, cen.label),
dist AS (SELECT pt.vec_id, pt.label, g, n, xx + squares - 2 * xc AS mean_square, xx + cc - 2 * xc AS to_center FROM xc JOIN pt USING (vec_id) JOIN grp ON grp.label = g JOIN cnorm ON cnorm.label = g)"""


def zscore(log: bool) -> str:
    x = {f: f"ln(1 + CAST({f} AS DOUBLE))" if log else f"CAST({f} AS DOUBLE)" for f in _M[:3]}
    return RFM + ", s AS (SELECT " + ", ".join(f"avg({c}) AS m{f}, stddev_samp({c}) AS s{f}" for f, c in x.items()) + ") SELECT CustomerID, ".replace(")", " FROM rfm)", 1) + ", ".join(
        f"{near(f'({c} - m{f}) / s{f}', 5)} AS z_{f}" for f, c in x.items()
    ) + " FROM rfm, s"


def scaling() -> str:
    kinds = []
    for f in _M[:3]:
        log = f"ln(1 + CAST({f} AS DOUBLE))"
        z = f"({log} - (SELECT avg({log}) FROM rfm)) / (SELECT stddev_samp({log}) FROM rfm)"
        for kind, c in (("raw", f"CAST({f} AS DOUBLE)"), ("log", log), ("scaled", z)):
            kinds.append(f"SELECT '{f}' AS feature, '{kind}' AS kind, {c} AS value FROM rfm")
    parts = ", ".join(f"{near_big(e, 4)} AS {n}" for n, e in (("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("min", "min(value)"), ("max", "max(value)")))
    return RFM + ", k AS (" + " UNION ALL ".join(kinds) + f") SELECT feature, kind, {parts} FROM k GROUP BY feature, kind"


_Z = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
_D = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
_ORDER = ["invalid_invoice_date", "invalid_values", "duplicate_rows", "cancelled_invoices", *_SALE]

AUDIT = "WITH " + ATTRIBUTED + f""", part AS (
  SELECT removed_by AS rule, copies AS n, Amount * copies AS amount FROM attributed WHERE early IS NOT NULL
  UNION ALL SELECT 'duplicate_rows', copies - 1, Amount * (copies - 1) FROM attributed WHERE early IS NULL
  UNION ALL SELECT coalesce(removed_by, ''), 1, Amount FROM attributed WHERE early IS NULL
), o AS (SELECT unnest({[*_ORDER, '']}) AS rule, unnest(range(1, {len(_ORDER) + 2})) AS step), g AS (SELECT rule, sum(n) AS n, sum(amount) AS amount FROM part GROUP BY rule),
t AS (SELECT CAST(step AS INT) AS step, o.rule, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(amount, 0) AS DOUBLE) AS amount FROM o LEFT JOIN g USING (rule))
SELECT * FROM (SELECT step, rule, CAST(sum(n) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rows_before, n AS rows_removed,
  CAST(coalesce(sum(n) OVER (ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS rows_after, amount AS amount_removed FROM t) WHERE rule <> ''"""


_SEG = "CAST((CASE WHEN Recency > r THEN 2 ELSE 0 END) + (CASE WHEN Monetary > m THEN 1 ELSE 0 END) AS INT)"
SUMMARY_CHECKS = f"""WITH {CLEAN}, rfm AS ({rfm_of("clean")}), med AS (SELECT quantile_disc(Recency, 0.5) AS r, quantile_disc(Monetary, 0.5) AS m FROM rfm),
x AS (SELECT (SELECT sum(copies) FROM attributed) AS raw, (SELECT sum(copies) - count(*) FILTER (WHERE removed_by IS NULL) FROM attributed) AS removed, (SELECT count(*) FROM clean) AS clean, (SELECT count(DISTINCT CustomerID) FROM clean) AS buyers,
  (SELECT count(*) FROM (SELECT DISTINCT CustomerID, InvoiceNo FROM clean)) AS bought, (SELECT sum(Amount) FROM clean) AS paid, (SELECT count(*) FROM rfm) AS customers, (SELECT sum(Frequency) FROM rfm) AS invoices,
  (SELECT sum(CAST(Monetary AS DECIMAL(28,2))) FROM rfm) AS amount, (SELECT count(DISTINCT {_SEG}) FROM rfm, med) AS k) """ + checks("x", [
    ("raw rows match the audit", "raw", "raw", 0), ("audit ends at the clean rows", "clean", "clean", 0), ("audit adds up", "raw - removed", "clean", 0), ("customers match", "customers", "buyers", 0),
    ("customers are profiled", "customers", "customers", 0), ("invoices match", "invoices", "bought", 0), ("amounts match", "amount", "paid", 5.0), ("every segment is named", "k", "k", 0),
])


def distinct_by(form: str) -> str:
    return f"WITH {TYPED} " + " UNION ALL ".join(
        f"SELECT strftime(InvoiceDate, '{form}') AS part, '{n}' AS what, count(DISTINCT {c}) AS n, true AS within FROM typed GROUP BY 1" for n, c in (("customers", "CustomerID"), ("invoices", "InvoiceNo"), ("stock_codes", "StockCode"))
    )


def top5() -> str:
    return RFM + " " + " UNION ALL ".join(
        f"(SELECT '{f}' AS \"by\", CAST(row_number() OVER (ORDER BY {f} DESC, CustomerID) AS INT) AS place, CustomerID, Recency, Frequency, Monetary FROM rfm ORDER BY {f} DESC, CustomerID LIMIT 5)" for f in _M[:3]
    )


def bags(since_until: bool) -> str:
    inside = "WHERE InvoiceDate BETWEEN (SELECT min(InvoiceDate) FROM b) AND (SELECT max(InvoiceDate) FROM a)" if since_until else ""
    return HALVES + f""", s AS (SELECT *, 1 AS lft FROM a {inside} UNION ALL SELECT *, 0 FROM b {inside}), g AS (SELECT {_NAMES}, sum(lft) AS l, sum(1 - lft) AS r FROM s GROUP BY {_NAMES})
SELECT coalesce(sum(l), 0)::BIGINT AS left_rows, coalesce(sum(r), 0)::BIGINT AS right_rows, coalesce(sum(least(l, r)), 0)::BIGINT AS in_both, coalesce(sum(l - least(l, r)), 0)::BIGINT AS left_only,
  coalesce(sum(r - least(l, r)), 0)::BIGINT AS right_only, coalesce(sum(greatest(l - 1, 0)), 0)::BIGINT AS left_excess, coalesce(sum(greatest(r - 1, 0)), 0)::BIGINT AS right_excess, count(*) FILTER (WHERE l > 0 AND r > 0) AS distinct_in_both FROM g"""


def oracle_sql() -> dict[str, str]:
    counts = {**_PARSING, **_SALE, "cancelled_invoices": "coalesce(starts_with(InvoiceNo, 'C'), false)"}
    return {
        "prepare_typed": f"WITH {TYPED} SELECT {DOUBLES} FROM typed",
        "rule_flags": f"WITH {FOLDED} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(coalesce(sum(copies) FILTER (WHERE {c}), 0) AS BIGINT) AS detected FROM folded" for n, c in counts.items()) + " UNION ALL SELECT 'duplicate_rows', CAST(coalesce(sum(copies - 1), 0) AS BIGINT) FROM folded",
        "dedup_rows": f"WITH {FOLDED} SELECT {DOUBLES}, copies FROM folded",
        "cancel_keys": f"WITH {MATCHED} SELECT CustomerID, StockCode, AbsQuantity, CAST(UnitPrice AS DOUBLE) AS UnitPrice, cancels, last_cancel FROM cancels",
        "cancel_matched": f"WITH {MATCHED} SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID, Country, cancels, last_cancel FROM matching WHERE matched",
        "cancel_detail": f"""WITH {MATCHED}, f AS (SELECT count(*) FILTER (WHERE is_cancel) AS cancel_rows, count(*) FILTER (WHERE is_cancel AND CustomerID IS NOT NULL) AS with_customer, CAST(sum(Amount) FILTER (WHERE is_cancel) AS DOUBLE) AS cancel_amount,
          count(*) FILTER (WHERE matched) AS matched_rows, CAST(sum(Amount) FILTER (WHERE matched) AS DOUBLE) AS matched_amount FROM matching) SELECT *, with_customer - matched_rows AS unmatched FROM f""",
        "clean_transactions": f"WITH {CLEAN} SELECT {DOUBLES} FROM clean",
        "clean_audit": AUDIT,
        "clean_summary": f"""WITH {CLEAN} SELECT count(*) AS n, min(InvoiceDate) AS first, max(InvoiceDate) AS last, min(Quantity) AS min_quantity, max(Quantity) AS max_quantity, CAST(min(UnitPrice) AS DOUBLE) AS min_price, CAST(max(UnitPrice) AS DOUBLE) AS max_price,
          CAST(min(Amount) AS DOUBLE) AS min_amount, CAST(max(Amount) AS DOUBLE) AS max_amount, CAST(sum(Amount) AS DOUBLE) AS total,
          count(*) FILTER (WHERE InvoiceNo IS NULL OR StockCode IS NULL OR Description IS NULL OR Quantity IS NULL OR InvoiceDate IS NULL OR UnitPrice IS NULL OR CustomerID IS NULL OR Country IS NULL OR Amount IS NULL) AS rows_with_null,
          count(DISTINCT InvoiceNo) AS n_invoiceno, count(DISTINCT CustomerID) AS n_customerid, count(DISTINCT StockCode) AS n_stockcode, count(DISTINCT Country) AS n_country FROM clean""",
        "kept_share": f"WITH {ATTRIBUTED}, f AS (SELECT CAST(sum(copies) AS BIGINT) AS raw_rows, count(*) FILTER (WHERE removed_by IS NULL) AS clean_rows FROM attributed) SELECT *, raw_rows - clean_rows AS removed, {near('100.0 * clean_rows / raw_rows', 2)} AS pct_kept FROM f",
        "rfm_orders": RFM + " SELECT * FROM rfm ORDER BY Monetary DESC, CustomerID LIMIT 100",
        "rfm_events": f"WITH tx AS (SELECT user_id AS CustomerID, event_id AS InvoiceNo, ts AS InvoiceDate, CAST(value AS DECIMAL(18,4)) AS Amount FROM events WHERE event_type = 'purchase') {rfm_of('tx')}",
        "rfm_clean": f"WITH {CLEAN} {rfm_of('clean')}",
        "rfm_sql_difference": f"WITH {CLEAN} SELECT count(DISTINCT CustomerID) AS rows, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, CAST(0 AS BIGINT) AS different FROM clean",
        "rfm_describe": TALL + f" SELECT feature, count(value) AS n, min(value) AS min, max(value) AS max, {near_big('avg(value)', 4)} AS mean, {near_big('stddev_samp(value)', 4)} AS std, {near('avg(pow((value - mu) / sd, 3))', 4)} AS skew, " + ", ".join(f"{near_big(f'quantile_disc(value, {q})', 4)} AS {n}" for n, q in _D.items()) + " FROM tall JOIN (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM tall GROUP BY feature) USING (feature) GROUP BY feature",
        "rfm_iqr_outliers": TALL + f", q AS (SELECT feature, quantile_disc(value, 0.25) AS a, quantile_disc(value, 0.75) AS b FROM tall GROUP BY feature), f AS (SELECT feature, a - 1.5 * (b - a) AS lower, b + 1.5 * (b - a) AS upper FROM q) SELECT feature, {near_big('lower', 4)} AS lower, {near_big('upper', 4)} AS upper, count(*) FILTER (WHERE value < lower) AS below, count(*) FILTER (WHERE value > upper) AS above FROM tall JOIN f USING (feature) GROUP BY feature, lower, upper",
        "rfm_correlation": RFM + " SELECT " + ", ".join(f"{near(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 3)} AS {a}_{b}" for a, b in (("Recency", "Frequency"), ("Recency", "Monetary"), ("Frequency", "Monetary"))) + " FROM rfm",
        "rfm_one_time": RFM + " SELECT count(*) AS customers, count(*) FILTER (WHERE Frequency = 1) AS one_time_buyers FROM rfm",
        "rfm_top_share": RFM + f", k AS (SELECT greatest(1, CAST(floor(count(*) * 0.01 + 0.5) AS BIGINT)) AS k, CAST(sum(CAST(Monetary AS DECIMAL(28,2))) AS DOUBLE) AS total FROM rfm), t AS (SELECT Monetary, row_number() OVER (ORDER BY Monetary DESC, CustomerID) AS r FROM rfm), s AS (SELECT count(*) AS n_top, CAST(sum(CAST(Monetary AS DECIMAL(28,2))) AS DOUBLE) AS top_amount FROM t, k WHERE r <= k) SELECT n_top, top_amount, total AS total_amount, {near('100.0 * top_amount / total', 2)} AS top_pct FROM s, k",
        "rfm_top5": top5(),
        "profile_size": f"WITH {RAW} SELECT count(*) AS records, 8 AS columns, count(*) FILTER (WHERE Invoice LIKE '%00') AS corrupt FROM raw",
        "model_applied": APPLIED,
        "rfm_changes": f"WITH {LINES}, early AS (SELECT * FROM lines WHERE InvoiceDate < '1998-07-01'), a AS ({rfm_of('lines')}), b AS ({rfm_of('early')}) "
        "SELECT CustomerID, CASE WHEN b.Frequency IS NULL THEN 'only_left' ELSE 'different' END AS change FROM a LEFT JOIN b USING (CustomerID) "
        "WHERE b.Frequency IS NULL OR a.Frequency <> b.Frequency OR abs(a.Monetary - b.Monetary) > 0.005",
        "distinct_by_month": distinct_by("%Y-%m"),
        "distinct_by_year": distinct_by("%Y"),
        "sized_files": f"WITH {RAW} SELECT count(*) AS rows, true AS in_range FROM raw",
        "missingness": MISSING,
        "unparseable": f"WITH {RAW}, t AS (SELECT {_TYPED}, Quantity AS rq, Price AS rp, raw.InvoiceDate AS rd FROM raw) SELECT count(*) FILTER (WHERE rq IS NOT NULL AND t.Quantity IS NULL) AS Quantity, count(*) FILTER (WHERE rp IS NOT NULL AND UnitPrice IS NULL) AS Price, count(*) FILTER (WHERE rd IS NOT NULL AND t.InvoiceDate IS NULL) AS InvoiceDate FROM t",
        "duplicate_profile": f"WITH {RAW}, c AS (SELECT {_NAMES}, count(*) AS n FROM raw GROUP BY ALL), f AS (SELECT count(*) FILTER (WHERE n > 1) AS groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_groups, CAST(sum(n - 1) AS BIGINT) AS excess, max(n) FILTER (WHERE n > 1) AS max_copies, count(*) AS distinct_rows FROM c) SELECT *, {near('100.0 * excess / (excess + distinct_rows)', 2)} AS pct_excess FROM f",
        "duplicate_by_month": f"WITH {RAW}, c AS (SELECT {_NAMES}, count(*) AS n FROM raw GROUP BY ALL) SELECT substr(InvoiceDate, 1, 7) AS month, CAST(sum(n - 1) AS BIGINT) AS excess FROM c WHERE n > 1 GROUP BY 1",
        "cardinality": f"WITH {RAW} " + " UNION ALL ".join(f"SELECT '{n}' AS what, count(DISTINCT {c}) AS n FROM raw" for n, c in (("customers", '"Customer ID"'), ("invoices", "Invoice"), ("countries", "Country"), ("stock_codes", "StockCode"), ("descriptions", "Description"))),
        "numeric_stats": f"WITH {TYPED}, v AS (SELECT 'Quantity' AS \"column\", CAST(Quantity AS DOUBLE) AS value FROM typed UNION ALL SELECT 'Price', CAST(UnitPrice AS DOUBLE) FROM typed) SELECT \"column\", min(value) AS min, max(value) AS max, {near_big('avg(value)', 4)} AS mean, " + ", ".join(f"quantile_disc(value, {q}) AS {n}" for n, q in _Z.items()) + ' FROM v GROUP BY "column"',
        "date_range": f"WITH {TYPED} SELECT min(InvoiceDate) AS first, max(InvoiceDate) AS last FROM typed",
        "rows_by_month": f"WITH {TYPED} SELECT strftime(InvoiceDate, '%Y-%m') AS month, count(*) AS n FROM typed GROUP BY 1",
        "invoice_types": f"WITH {RAW} SELECT CASE WHEN regexp_full_match(Invoice, '\\d{{6}}') THEN 'normal' WHEN regexp_full_match(Invoice, 'C\\d{{6}}') THEN 'cancellation' WHEN regexp_full_match(Invoice, 'A\\d{{6}}') THEN 'adjustment' ELSE 'other' END AS type, count(*) AS rows, count(DISTINCT Invoice) AS invoices FROM raw GROUP BY 1",
        "value_issues": ISSUES,
        "special_codes": f"WITH {RAW} SELECT StockCode, count(*) AS rows, min(Description) AS example FROM raw WHERE NOT regexp_full_match(StockCode, '\\d{{5}}[A-Za-z]*') GROUP BY StockCode",
        "top_countries": f"WITH {RAW} SELECT Country, count(*) AS rows FROM raw GROUP BY Country ORDER BY rows DESC, Country LIMIT 10",
        "profile_samples": SAMPLES,
        "overlap_intersect_all": HALVES + " SELECT * FROM a INTERSECT ALL SELECT * FROM b",
        "overlap_except_all": HALVES + " SELECT * FROM a EXCEPT ALL SELECT * FROM b",
        "union_by_name": HALVES + ", u AS (SELECT *, 'first' AS sheet FROM a UNION ALL BY NAME SELECT *, 'second' AS sheet FROM b) SELECT sheet, count(*) AS rows, min(InvoiceDate) AS first, max(InvoiceDate) AS last FROM u GROUP BY sheet",
        "sheets_by_row": f"""WITH {RAW}, n AS (SELECT *, row_number() OVER (ORDER BY {_FIRST}) AS row, count(*) OVER () // 2 AS half FROM raw)
          SELECT CASE WHEN row <= half THEN 'first' ELSE 'second' END AS sheet, count(*) AS rows, min(row) AS from_row, max(row) AS to_row, min(Invoice) AS first_invoice, max(Invoice) AS last_invoice, count(DISTINCT Invoice) AS invoices FROM n GROUP BY 1""",
        "sheet_files": HALVES + ", u AS (SELECT *, 'first' AS sheet FROM a UNION ALL BY NAME SELECT *, 'second' AS sheet FROM b) SELECT sheet, count(*) AS rows, min(InvoiceDate) AS first, max(InvoiceDate) AS last FROM u GROUP BY sheet",
        "sheet_overlap": bags(True),
        "overlap_report": OVERLAP,
        "customer_issues": CUSTOMER_ISSUES,
        "raw_schema": f"SELECT CAST(unnest(range({len(QUOTED)})) AS INT) AS position, unnest({[c.strip(chr(34)) for c in QUOTED]}) AS \"column\", 'string' AS type, true AS nullable",
        "run_summary": f"""WITH {CLEAN}, f AS (SELECT CAST(sum(copies) AS BIGINT) AS raw_rows, count(*) FILTER (WHERE removed_by IS NULL) AS clean_rows FROM attributed),
          g AS (SELECT count(DISTINCT InvoiceNo) AS invoices, CAST(sum(Amount) AS DOUBLE) AS amount_total, min(InvoiceDate) AS first, max(InvoiceDate) AS last, count(DISTINCT CustomerID) AS customers, (SELECT count(*) FROM (SELECT DISTINCT CustomerID, InvoiceNo FROM clean)) AS customer_invoices FROM clean)
          SELECT f.*, g.*, {near('100.0 * clean_rows / raw_rows', 2)} AS pct_kept FROM f, g""",
        "summary_checks": SUMMARY_CHECKS,
        "kmeans_checks": KMEANS_CHECKS,
        "kmeans_fit": CLUSTERS + " SELECT CustomerID, Recency, Frequency, Monetary, Cluster FROM km",
        "k_sweep": SWEEP,
        "kmeans_facts": FACTS,
        "kmeans_profile": CLUSTERS + ", " + profile_of("km") + f" SELECT *, {NAMED} FROM profile",
        "kmeans_profile_checks": CLUSTERS + ", " + profile_of("km") + profile_checks_of("km"),
        "scale_zscore": zscore(False),
        "scale_log1p_zscore": zscore(True),
        "scaling_summary": scaling(),
        "kmeans_assign_fixed": CELLS + f", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(to_center, 6), g) AS k FROM dist) SELECT vec_id, label, g AS nearest, {near('to_center', 3)} AS distance FROM r WHERE k = 1",
        "silhouette": CELLS + f", ab AS (SELECT vec_id, max(CASE WHEN g = label AND n > 1 THEN mean_square * n / (n - 1) END) AS a, min(CASE WHEN g <> label THEN mean_square END) AS b FROM dist GROUP BY vec_id) SELECT count(*) AS n, {near('avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / greatest(a, b), 0) END)', 4)} AS silhouette FROM ab",
        "inertia": CELLS + f" SELECT label, count(*) AS n, {near('sum(to_center)', 1)} AS inertia FROM dist WHERE g = label GROUP BY label",
        "cluster_means": SEGMENTS + " SELECT Cluster, count(*) AS n, " + ", ".join(f"{near_big(f'avg(CAST({m} AS DOUBLE))', 2)} AS mean_{m}" for m in _M[:3]) + " FROM seg GROUP BY Cluster",
        "tenure": f"WITH {LINES} SELECT CustomerID, CAST(date_diff('day', CAST(min(InvoiceDate) AS DATE), (SELECT CAST(max(InvoiceDate) AS DATE) + 1 FROM lines)) AS INT) AS Tenure FROM lines GROUP BY CustomerID",
        "cluster_profile": PROFILE + " SELECT * FROM profile",
        "profile_checks": PROFILE + profile_checks_of("st"),
        "segment_labels": PROFILE + f" SELECT Cluster, {NAMED} FROM profile",
        "parquet_roundtrip": f"WITH {CLEAN} SELECT Country, count(*) AS n, CAST(sum(Amount) AS DOUBLE) AS amount FROM clean GROUP BY Country",
        "csv_roundtrip": MISSING,
        "corrupt_records": f"WITH {RAW} SELECT count(*) AS rows, count(*) FILTER (WHERE Invoice LIKE '%00') AS corrupt, count(*) FILTER (WHERE Invoice LIKE '%00') AS no_country FROM raw",
    }
