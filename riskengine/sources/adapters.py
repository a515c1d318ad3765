"""Tables of the driver as transaction records, with the raw schema the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2017-11-30 00:00 UTC, from which transaction seconds count.
EPOCH = 1512000000
_DT_SPARK = f"unix_seconds(CAST(ts AS TIMESTAMP)) - {EPOCH}"
_DT_DUCK = f"CAST(floor(epoch(ts)) AS BIGINT) - {EPOCH}"

# The test records that stand for raw transactions, column by column, in SQL both engines read.
_COLUMNS = (
    ("TransactionID", "event_id"),
    ("TransactionDT", "{DT}"),
    ("TransactionAmt", "value"),
    ("ProductCD", "CASE event_type WHEN 'purchase' THEN 'W' WHEN 'view' THEN 'H' WHEN 'click' THEN 'C' WHEN 'signup' THEN 'S' WHEN 'error' THEN 'R' END"),
    ("card1", "CAST(1000 + user_id AS BIGINT)"),
    ("card4", "CASE event_id % 5 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'discover' WHEN 3 THEN 'American Express' END"),
    ("card6", "CASE event_id % 4 WHEN 0 THEN 'debit' WHEN 1 THEN 'credit' WHEN 2 THEN 'charge card' END"),
    ("addr1", "CASE WHEN user_id % 11 = 0 THEN NULL ELSE CAST(300 + user_id % 7 AS DOUBLE) END"),
    ("P_emaildomain", "CASE event_id % 9 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'gmail' WHEN 2 THEN 'yahoo.com.mx' WHEN 3 THEN 'Hotmail.com' WHEN 4 THEN 'protonmail.com' WHEN 5 THEN 'temp123.net' WHEN 6 THEN 'web.de' WHEN 7 THEN 'mit.edu' END"),
    ("R_emaildomain", "CASE event_id % 7 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.co.uk' WHEN 2 THEN 'live.fr' WHEN 3 THEN 'icloud.com' WHEN 4 THEN 'anonymous.com' END"),
    ("id_30", "CASE user_id % 7 WHEN 0 THEN 'iOS 11.1.2' WHEN 1 THEN 'Android 7.0' WHEN 2 THEN 'Windows 10' WHEN 3 THEN 'Mac OS X 10_12_6' WHEN 4 THEN 'Linux' WHEN 5 THEN 'func' END"),
    ("id_31", "CASE user_id % 10 WHEN 0 THEN 'chrome 63.0' WHEN 1 THEN 'chrome 62.0 for android' WHEN 2 THEN 'mobile safari 11.0' WHEN 3 THEN 'safari generic' WHEN 4 THEN 'edge 15.0' WHEN 5 THEN 'firefox 57.0' WHEN 6 THEN 'samsung browser 6.2' WHEN 7 THEN 'opera 49.0' WHEN 8 THEN 'chrome 63.0 for ios' END"),
    ("id_33", "CASE user_id % 4 WHEN 0 THEN '1920x1080' WHEN 1 THEN '1334x750' WHEN 2 THEN '2208x1242' END"),
    ("DeviceInfo", "CASE user_id % 6 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS Device' WHEN 2 THEN 'SM-G532M Build/MMB29T' WHEN 3 THEN 'HUAWEI Build' WHEN 4 THEN 'rv:57.0' END"),
    ("DeviceType", "CASE user_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' END"),
    ("M1", "CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END"),
    ("M4", "CASE event_id % 4 WHEN 0 THEN 'M0' WHEN 1 THEN 'M1' WHEN 2 THEN 'M2' END"),
    ("D1", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(floor(({DT}) / CAST(86400 AS DOUBLE)) AS DOUBLE) - (user_id % 200) END"),
    ("isFraud", "CASE WHEN event_type = 'error' AND event_id % 6 = 0 THEN 1 ELSE 0 END"),
    ("score", "CAST((event_id * 7919) % 700 + CASE WHEN event_type = 'error' AND event_id % 6 = 0 THEN 300 ELSE 0 END AS DOUBLE) / 1000"),
)

#: The same records as a DuckDB view body, for oracle queries.
TX_SQL = "SELECT " + ", ".join(f"{e.format(DT=_DT_DUCK)} AS {n}" for n, e in _COLUMNS) + " FROM events"

ORDERS_SQL = """SELECT o_orderkey AS TransactionID, o_totalprice AS TransactionAmt, o_orderdate AS ts, o_custkey AS card1,
 c_nationkey AS addr1, c_mktsegment AS card4, o_orderpriority AS ProductCD, o_orderstatus AS status, n_name AS country
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""

LABELS_SQL = """SELECT l.doc_id AS id, toxic AS y, CAST((l.doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS p, CAST(n_chars AS DOUBLE) AS amt
 FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw transactions; only the columns a query uses are scanned."""
    return as_transactions(read_table(spark, sf_dir, "events"))


def as_transactions(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{e.format(DT=_DT_SPARK)} AS {n}" for n, e in _COLUMNS])


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with their customers and nations (left joins) as transactions."""
    o, c, n = (read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return joined.select(
        F.col("o_orderkey").alias("TransactionID"), F.col("o_totalprice").alias("TransactionAmt"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("card1"),
        F.col("c_nationkey").alias("addr1"), F.col("c_mktsegment").alias("card4"), F.col("o_orderpriority").alias("ProductCD"), F.col("o_orderstatus").alias("status"), F.col("n_name").alias("country"),
    )


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as scored records: ``id``, ``y``, ``p``, ``amt``."""
    lab, doc = read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"), ((F.col("doc_id") * 7919) % 1000).cast("double").__truediv__(1000).alias("p"), F.col("n_chars").cast("double").alias("amt"))


def scored(tx: DataFrame) -> DataFrame:
    """The scored view of transactions that evaluation works on."""
    return tx.select(F.col("TransactionID").alias("id"), F.col("isFraud").alias("y"), F.col("score").alias("p"), F.col("TransactionAmt").alias("amt"))


SCORED_SQL = "SELECT TransactionID AS id, isFraud AS y, score AS p, TransactionAmt AS amt FROM tx"
