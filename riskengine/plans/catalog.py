"""All queries by name, each with the SQL that gives the same rows in DuckDB where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.functions import clean
from riskengine.operators import evaluate as ev
from riskengine.operators import features as fe
from riskengine.operators import monitor as mo
from riskengine.operators import scoring as sc
from riskengine.plans import views as vw
from riskengine.sources import adapters as ad
from riskengine.operators import learn as ml
from riskengine.session import materialize, shared_path, spread
from riskengine.sources import readers as rd
from riskengine.streaming import streams as st

THRESHOLD = 0.5
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TX = f"WITH tx AS ({ad.TX_SQL}), sc AS ({ad.SCORED_SQL})"
_USER = """concat(CAST(card1 AS VARCHAR), '_', CAST(coalesce(CAST(addr1 AS BIGINT), -1) AS VARCHAR), '_', CAST(CAST(floor(coalesce(TransactionDT / CAST(86400 AS DOUBLE) - D1, -999.0) / 7) AS BIGINT) AS VARCHAR))"""
TXU = f"WITH tx AS (SELECT *, {_USER} AS UID FROM ({ad.TX_SQL})), sc AS ({ad.SCORED_SQL})"


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return ad.transactions(spark, d)


def _users(spark: SparkSession, d: str) -> DataFrame:
    return fe.with_user(clean.normalise_days(_tx(spark, d)))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return ad.scored(_tx(spark, d))


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def case(column: str, table: dict, default) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + f" ELSE {quote(default)} END"


def matches(column: str, cases: list, default: int = 0) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN {v}" for p, v in cases) + f" ELSE {default} END"


# --- cleaning -----------------------------------------------------------------------------

_GROUP = clean.VENDORS


def _email_sql(c: str) -> str:
    vendor, suffix = f"split_part({c}, '.', 1)", f"split_part({c}, '.', -1)"
    digit = f"CAST(regexp_matches({c}, '[0-9]') AS INT)"
    return ", ".join([
        f"CAST(length({c}) AS INT) AS {c}_length", f"{digit} AS {c}_has_digits", f"CAST({c} IN {clean.FREE_PROVIDERS} AS INT) AS {c}_is_free",
        f"{case('(' + case(vendor, _GROUP, 'unknown') + ')', clean.VENDOR_IDS, 0)} AS {c}_vendor_id", f"{case(suffix, clean.SUFFIX_IDS, 0)} AS {c}_suffix_id", f"{case(suffix, clean.COUNTRY_IDS, 0)} AS {c}_country_id",
        f"{case('(' + case(vendor, _GROUP, 'unknown') + ')', clean.VENDOR_RISK, 1)} + {digit} + CASE WHEN regexp_matches({vendor}, 'temp|fake|trash') THEN 3 ELSE 0 END AS {c}_risk_score",
    ])


_EMAIL = "CASE coalesce(lower({c}), 'nan') WHEN 'gmail' THEN 'gmail.com' WHEN 'nan' THEN 'unknown' ELSE lower({c}) END"


@query(f"""{TX}, e AS (SELECT TransactionID, {_EMAIL.format(c='P_emaildomain')} AS P_emaildomain, {_EMAIL.format(c='R_emaildomain')} AS R_emaildomain FROM tx),
f AS (SELECT *, {_email_sql('P_emaildomain')}, {_email_sql('R_emaildomain')} FROM e)
SELECT *, CAST(P_emaildomain = R_emaildomain AS INT) AS email_match_status,
 CAST(P_emaildomain_country_id <> 0 AND R_emaildomain_country_id <> 0 AND P_emaildomain_country_id <> R_emaildomain_country_id AS INT) AS email_country_mismatch FROM f""")
def clean_email_features(spark: SparkSession, d: str) -> DataFrame:
    return clean.email_features(_tx(spark, d).select("TransactionID", "P_emaildomain", "R_emaildomain"))


@query(f"""{TX} SELECT TransactionID, CASE WHEN P_emaildomain IS NULL OR lower(P_emaildomain) IN ('nan', 'none', 'unknown') THEN 'Unknown'
 ELSE {case("split_part(lower(P_emaildomain), '.', -1)", clean.COUNTRY_SUFFIXES, 'USA/Global')} END AS country FROM tx""")
def clean_country(spark: SparkSession, d: str) -> DataFrame:
    return clean.set_country(_tx(spark, d)).select("TransactionID", "country")


_MOBILE = "regexp_matches(b, 'mobile|android|ios')"
_DEVICE = f"""d AS (SELECT TransactionID, card1, TransactionAmt, addr1, P_emaildomain, TransactionDT, D1, isFraud, ProductCD, TRY_CAST(split_part(id_33, 'x', 1) AS INT) AS screen_width, TRY_CAST(split_part(id_33, 'x', 2) AS INT) AS screen_height,
 coalesce(lower(id_30), '') AS o, coalesce(lower(id_31), '') AS b, coalesce(lower(DeviceInfo), '') AS v, {case('DeviceType', clean.DEVICE_TYPES, -1)} AS device_type FROM tx),
dev AS (SELECT *, {matches('o', clean.OS_CASES)} AS os_type, CASE {' '.join(f"WHEN regexp_matches(b, '{p}') THEN {k}" for p, k in clean.BROWSER_CASES)}
 WHEN regexp_matches(b, 'chrome|chromium|google') THEN CASE WHEN {_MOBILE} THEN 7 ELSE 8 END WHEN contains(b, 'safari') THEN CASE WHEN {_MOBILE} THEN 9 ELSE 10 END ELSE 0 END AS browser_type,
 {matches('v', clean.DEVICE_CASES)} AS device_vendor FROM d)"""


@query(f"{TX}, {_DEVICE} SELECT TransactionID, screen_width, screen_height, os_type, browser_type, device_vendor, device_type, CAST(screen_width AS BIGINT) * screen_height AS screen_area, round(CAST(screen_width AS DOUBLE) / (screen_height + 1), 6) AS screen_aspect_ratio FROM dev")
def clean_device_features(spark: SparkSession, d: str) -> DataFrame:
    names = ["screen_width", "screen_height", "os_type", "browser_type", "device_vendor", "device_type", "screen_area", "screen_aspect_ratio"]
    return _rounded(clean.device_features(_tx(spark, d)).select("TransactionID", *names), "screen_aspect_ratio")


@query(f"""{TX} SELECT TransactionID, {case('ProductCD', clean.PRODUCTS, 0)} AS ProductCD, {case('lower(card4)', clean.CARD_NETWORKS, -1)} AS card4, {case('lower(card6)', clean.CARD_KINDS, -1)} AS card6,
 {case('M1', clean.M_VALUES, -1)} AS M1, {case('M4', clean.M_VALUES, -1)} AS M4 FROM tx""")
def clean_card_m_product(spark: SparkSession, d: str) -> DataFrame:
    return clean.card_features(_tx(spark, d)).select("TransactionID", "ProductCD", "card4", "card6", "M1", "M4")


_IDS = "SELECT event_id AS TransactionID, {id12} AS id_12, {id23} AS id_23, CASE event_id % 4 WHEN 0 THEN 'match_status:2' WHEN 1 THEN 'match_status:-1' WHEN 2 THEN 'x' END AS id_34, CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END AS id_35 FROM events".format(
    id12="CASE event_id % 5 WHEN 0 THEN 'Found' WHEN 1 THEN 'NotFound' WHEN 2 THEN 'New' WHEN 3 THEN 'Unknown' END", id23="CASE event_id % 4 WHEN 0 THEN 'IP_PROXY:TRANSPARENT' WHEN 1 THEN 'IP_PROXY:ANONYMOUS' WHEN 2 THEN 'IP_PROXY:HIDDEN' END"
)


@query(f"SELECT TransactionID, {case('id_12', clean.STATUSES, -1)} AS id_12, {case('id_23', clean.PROXIES, -1)} AS id_23, coalesce(TRY_CAST(split_part(id_34, ':', -1) AS INT), -1) AS id_34, {case('id_35', {'T': 1, 'F': 0}, -1)} AS id_35 FROM ({_IDS})")
def clean_identity_status(spark: SparkSession, d: str) -> DataFrame:
    e = ad.read_table(spark, d, "events")
    return clean.identity_status(e.selectExpr(*[x.strip() for x in _IDS.removeprefix("SELECT ").removesuffix(" FROM events").split(", ")]))


_TS = "(TIMESTAMP '2017-11-30 00:00:00' + to_seconds(TransactionDT))"


@query(f"""{TX}, t AS (SELECT TransactionID, {_TS} AS ts FROM tx) SELECT TransactionID, CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(day(ts) AS INT) AS day_of_month, CAST(year(ts) * 100 + month(ts) AS INT) AS month_year,
 round(sin(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_cos FROM t""")
def time_features(spark: SparkSession, d: str) -> DataFrame:
    t = clean.time_features(_tx(spark, d).select("TransactionID", "TransactionDT"), ad.EPOCH).drop("TransactionDT")
    return t.withColumns({c: F.round(c, 6) + 0.0 for c in ("hour_sin", "hour_cos")})


@query(f"{TX} SELECT TransactionID, round(TransactionDT / CAST(86400 AS DOUBLE) - D1, 6) AS D1_norm FROM tx")
def d_norm(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(clean.normalise_days(_tx(spark, d)).select("TransactionID", "D1_norm"), "D1_norm")


@query(f"""{TX}, c AS (SELECT TransactionID, TransactionAmt, CAST(round(TransactionAmt * 1000) AS BIGINT) AS c FROM tx)
SELECT TransactionID, round(ln(1 + TransactionAmt), 6) AS TransactionAmt_log, CAST(c % 100000 = 0 AS INT) + CAST(c % 100000 = 99000 AS INT) + CAST(c % 1000 IN (990, 950, 900, 490, 0) AS INT) AS TransactionAmt_suspicious,
 CAST(c % 1000 AS INT) AS cents_value, CAST(c % 1000 = 0 AS INT) AS is_exact_dollars, CAST(c % 1000 BETWEEN 990 AND 999 AS INT) AS is_99_cents, round(c % 1000 / CAST(1000 AS DOUBLE), 6) AS TransactionAmt_decimal FROM c""")
def amount_features(spark: SparkSession, d: str) -> DataFrame:
    a = clean.amount_features(_tx(spark, d).select("TransactionID", "TransactionAmt")).drop("TransactionAmt")
    return _rounded(a, "TransactionAmt_log", "TransactionAmt_decimal")


# --- identity, windows, encodings ---------------------------------------------------------

_MD5 = """CAST((CAST((CAST(('0x' || substr(md5(UID), 1, 16)) AS UBIGINT) % 10000) AS BIGINT) * 1616 + CAST((CAST(('0x' || substr(md5(UID), 17, 16)) AS UBIGINT) % 10000) AS BIGINT)) % 10000 AS INT)"""


@query(f"{TXU} SELECT TransactionID, UID, {_MD5} AS UID_hash FROM tx")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select("TransactionID", "UID", fe.hash_bucket(F.col("UID")).alias("UID_hash"))


_COMBOS = ("device_info_combo", "card_email_combo", "product_network_combo", "card1_addr1_combo", "os_browser_combo")


@query(f"""{TXU}, {_DEVICE}, e AS (SELECT TransactionID, {{vendor}} AS vid FROM tx), k AS (SELECT t.TransactionID, concat(t.ProductCD, '_', coalesce(t.card4, 'nan')) AS product_network_combo, concat(CAST(t.card1 AS VARCHAR), '_', CAST(coalesce(CAST(t.addr1 AS BIGINT), -1) AS VARCHAR)) AS card1_addr1_combo,
 concat(CAST(os_type AS VARCHAR), '_', CAST(browser_type AS VARCHAR)) AS os_browser_combo, concat(CAST(browser_type AS VARCHAR), '_', CAST(coalesce(screen_width, -1) AS VARCHAR)) AS device_info_combo, concat(t.card1, '_', vid) AS card_email_combo FROM tx t JOIN dev USING (TransactionID) JOIN e USING (TransactionID))
SELECT *, {', '.join(f'CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INT) AS {c}_code' for c in _COMBOS)} FROM k""".replace("{vendor}", case("split_part(" + _EMAIL.format(c="P_emaildomain") + ", '.', 1)", {v: clean.VENDOR_IDS[g] for v, g in clean.VENDORS.items()}, 0)))
def combination_codes(spark: SparkSession, d: str) -> DataFrame:
    df = fe.with_combinations(clean.email_features(clean.device_features(_tx(spark, d)))).select("TransactionID", *_COMBOS)
    return fe.category_codes(df, list(_COMBOS))[0]


def _window_sql(h: int) -> str:
    w = f"OVER (PARTITION BY UID ORDER BY TransactionDT RANGE BETWEEN {h * 3600} PRECEDING AND 1 PRECEDING)"
    return f"count(TransactionAmt) {w} AS UID_count_{h}h, CASE WHEN count(*) OVER (PARTITION BY UID) > 1 THEN round(coalesce(sum(TransactionAmt) {w}, 0), 4) END AS UID_amt_sum_{h}h, CASE WHEN count(*) OVER (PARTITION BY UID) > 1 THEN round(coalesce(sum(TransactionAmt) {w}, 0) / {h}, 6) END AS UID_velocity_{h}h"


@query(f"{TXU} SELECT TransactionID, UID, {', '.join(map(_window_sql, (1, 12, 24)))} FROM tx")
def velocity_windows(spark: SparkSession, d: str) -> DataFrame:
    names = [f"UID_{k}_{h}h" for k in ("count", "amt_sum", "velocity") for h in (1, 12, 24)]
    out = fe.velocity(_users(spark, d)).select("TransactionID", "UID", *names)
    return _rounded(_rounded(out, *names[3:6], places=4), *names[6:])


@query(f"{TXU} SELECT TransactionID, UID, CAST(sum_24 AS DOUBLE) AS amt_sum_24h, count_24 AS count_24h FROM (SELECT *, count(TransactionAmt) OVER w AS count_24, round(coalesce(sum(TransactionAmt) OVER w, 0), 2) AS sum_24 FROM tx WINDOW w AS (PARTITION BY UID ORDER BY TransactionDT RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)) ORDER BY amt_sum_24h DESC, TransactionID LIMIT 100")
def top_spenders_24h(spark: SparkSession, d: str) -> DataFrame:
    """The 100 records with most spent by their user in the day before."""
    v = fe.velocity(_users(spark, d).select("TransactionID", "UID", "TransactionDT", "TransactionAmt"), (24,), fill_single=True)
    return v.select("TransactionID", "UID", F.round("UID_amt_sum_24h", 2).alias("amt_sum_24h"), F.col("UID_count_24h").alias("count_24h")).orderBy(F.col("amt_sum_24h").desc(), "TransactionID").limit(100)


@query(f"""{TXU}, {_DEVICE}, t AS (SELECT tx.TransactionID, UID, tx.TransactionDT, tx.TransactionAmt, tx.addr1, device_vendor, {case('tx.ProductCD', clean.PRODUCTS, 0)} AS prod FROM tx JOIN dev USING (TransactionID))
SELECT TransactionID, coalesce(TransactionDT - lag(TransactionDT) OVER w, 0) AS UID_dt_diff, row_number() OVER w - 1 AS txn_sequence, round(coalesce(TransactionAmt - lag(TransactionAmt) OVER w, 0), 4) AS amt_change_abs,
 CAST(coalesce(prod - lag(prod) OVER w, 0) <> 0 AS INT) AS "ProductCD_switch", CAST(coalesce(addr1 - lag(addr1) OVER w, 0) <> 0 AS INT) AS addr1_switch, CAST(coalesce(device_vendor - lag(device_vendor) OVER w, 0) <> 0 AS INT) AS device_vendor_switch,
 CAST(coalesce(TransactionDT - lag(TransactionDT) OVER w, 0) < 30 AS INT) AS time_gap_anomaly FROM t WINDOW w AS (PARTITION BY UID ORDER BY TransactionDT, TransactionID)""")
def sequence_features(spark: SparkSession, d: str) -> DataFrame:
    df = fe.sequence_features(clean.card_features(clean.device_features(_users(spark, d))))
    out = df.select("TransactionID", "UID_dt_diff", F.col("txn_sequence").cast("long").alias("txn_sequence"), "amt_change_abs", "ProductCD_switch", "addr1_switch", "device_vendor_switch", "time_gap_anomaly")
    return _rounded(out, "amt_change_abs", places=4)


@query(f"""{TXU}, {_DEVICE}, t AS (SELECT tx.TransactionID, UID, tx.card1, tx.addr1, tx.P_emaildomain, device_vendor FROM tx JOIN dev USING (TransactionID))
SELECT TransactionID, count(DISTINCT UID) OVER (PARTITION BY device_vendor) AS device_vendor_degree, CASE WHEN addr1 IS NULL THEN 0 ELSE count(DISTINCT UID) OVER (PARTITION BY addr1) END AS addr1_degree,
 count(DISTINCT addr1) OVER (PARTITION BY card1) AS unique_addrs_per_card, count(DISTINCT P_emaildomain) OVER (PARTITION BY card1) AS unique_emails_per_card,
 CASE WHEN addr1 IS NOT NULL THEN (count(DISTINCT UID) OVER (PARTITION BY device_vendor) + count(DISTINCT UID) OVER (PARTITION BY addr1)) / CAST(2 AS DOUBLE) END AS multi_entity_sharing FROM t""")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    df = clean.device_features(_users(spark, d)).drop("DeviceInfo")
    return fe.sharing_degrees(df).select("TransactionID", "device_vendor_degree", "addr1_degree", "unique_addrs_per_card", "unique_emails_per_card", "multi_entity_sharing")


_SPLIT = "n AS (SELECT *, row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS pos, count(*) OVER () AS n FROM tx), s AS (SELECT *, CAST(pos < CAST(floor(n * 0.85) AS BIGINT) AS INT) AS is_train FROM n)"


@query(f"{TX}, {_SPLIT} SELECT TransactionID, is_train FROM s")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return fe.time_split(_tx(spark, d).select("TransactionID", "TransactionDT")).select("TransactionID", "is_train")


@query(f"{TX}, n AS (SELECT TransactionID, row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS pos, count(*) OVER () AS n FROM tx) SELECT TransactionID, CAST(greatest(0, 5 - (n - 1 - pos) // (n // 6)) AS INT) AS fold FROM n")
def time_series_folds(spark: SparkSession, d: str) -> DataFrame:
    return fe.time_folds(_tx(spark, d).select("TransactionID", "TransactionDT"), 5).select("TransactionID", "fold")


_VENDOR_ID = case("split_part(" + _EMAIL.format(c="P_emaildomain") + ", '.', 1)", {v: clean.VENDOR_IDS[g] for v, g in clean.VENDORS.items()}, 0)
_PREP = f"""{TXU}, {_DEVICE}, e AS (SELECT TransactionID, {_VENDOR_ID} AS "P_emaildomain_vendor_id" FROM tx),
prep AS (SELECT tx.TransactionID, UID, tx.TransactionDT, tx.TransactionAmt, tx.isFraud, tx.card1, tx.addr1, {case('tx.ProductCD', clean.PRODUCTS, 0)} AS "ProductCD", {case('lower(card4)', clean.CARD_NETWORKS, -1)} AS card4, {case('lower(card6)', clean.CARD_KINDS, -1)} AS card6,
 "P_emaildomain_vendor_id", device_vendor, os_type, browser_type, hour(TIMESTAMP '2017-11-30 00:00:00' + to_seconds(tx.TransactionDT)) AS hour_of_day, concat(browser_type, '_', coalesce(screen_width, -1)) AS device_info_combo, concat(tx.card1, '_', "P_emaildomain_vendor_id") AS card_email_combo
 FROM tx JOIN dev USING (TransactionID) JOIN e USING (TransactionID))"""
_ENC = f"{_PREP}, {_SPLIT.replace('FROM tx)', 'FROM prep)')}, a AS (SELECT * FROM s WHERE is_train = 1), b AS (SELECT * FROM s WHERE is_train = 0)"


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned and encoded records with user and combined keys, before anything learned."""
    return sc.prepare(_tx(spark, d), ad.EPOCH)


def _encoded(spark: SparkSession, d: str, **parts) -> tuple[DataFrame, fe.Encoders]:
    """The last 15 % of the records, and encoders fitted on those before, written and read back."""
    df = _prepared(spark, d)
    cut, folder = fe.train_rows(df), shared_path(spark, "encoders")
    fe.fit_encoders(df.filter(cut), **parts).save(folder)
    return df.filter(~cut), fe.Encoders.load(spark, folder)


_NO_KEYS = {"groups": (), "counted": (), "risky": ()}


@query(f"""{_ENC} SELECT b.TransactionID, {', '.join(f'coalesce(f_{c}.n, 0) AS "{c}_freq_enc"' for c in fe.COUNT_KEYS)} FROM b
{' '.join(f'LEFT JOIN (SELECT {c}, count(*) AS n FROM a WHERE {c} IS NOT NULL GROUP BY {c}) f_{c} ON b.{c} = f_{c}.{c}' for c in fe.COUNT_KEYS)}""")
def freq_encode(spark: SparkSession, d: str) -> DataFrame:
    rest, enc = _encoded(spark, d, users=False, groups=(), risky=())
    return fe.apply_keys(rest, enc).select("TransactionID", *[f"{c}_freq_enc" for c in fe.COUNT_KEYS])


@query(f"""{_ENC}, g AS (SELECT avg(isFraud) AS m FROM a), j AS (SELECT b.TransactionID, {', '.join(f'coalesce(r_{c}.r, m) AS r{k}' for k, c in enumerate(fe.RISK_KEYS))} FROM b CROSS JOIN g
{' '.join(f'LEFT JOIN (SELECT {c}, (sum(isFraud) + 500 * max(m)) / (count(isFraud) + 500) AS r FROM a CROSS JOIN g WHERE {c} IS NOT NULL GROUP BY {c}) r_{c} ON b.{c} = r_{c}.{c}' for c in fe.RISK_KEYS)})
SELECT TransactionID, {', '.join(f'round(r{k}, 6) AS "{c}_fraud_rate"' for k, c in enumerate(fe.RISK_KEYS))}, round(({' + '.join(f'r{k}' for k in range(len(fe.RISK_KEYS)))}) / {len(fe.RISK_KEYS)}, 6) AS composite_risk_score FROM j""")
def target_encode(spark: SparkSession, d: str) -> DataFrame:
    names = [f"{c}_fraud_rate" for c in fe.RISK_KEYS] + ["composite_risk_score"]
    rest, enc = _encoded(spark, d, users=False, groups=(), counted=())
    return _rounded(fe.apply_keys(fe.apply_totals(rest, enc), enc).select("TransactionID", *names), *names)


@query(f"""{_ENC} SELECT b.TransactionID, {', '.join(f'round(b.TransactionAmt / (coalesce(g_{c}.m, b.TransactionAmt) + 1e-5), 6) AS "Amt_div_{c}_mean"' for c in fe.GROUP_KEYS)} FROM b
{' '.join(f'LEFT JOIN (SELECT {c}, avg(TransactionAmt) AS m FROM a WHERE {c} IS NOT NULL GROUP BY {c}) g_{c} ON b.{c} = g_{c}.{c}' for c in fe.GROUP_KEYS)}""")
def group_ratio(spark: SparkSession, d: str) -> DataFrame:
    names = [f"Amt_div_{c}_mean" for c in fe.GROUP_KEYS]
    rest, enc = _encoded(spark, d, users=False, counted=(), risky=())
    return _rounded(fe.apply_keys(rest, enc).select("TransactionID", *names), *names)


@query(f"""{_ENC}, u AS (SELECT UID, min(TransactionDT) AS f, avg(TransactionAmt) AS m, coalesce(nullif(stddev_samp(TransactionAmt), 0), 1) AS sd FROM a GROUP BY UID), g AS (SELECT avg(ln(1 + TransactionAmt)) AS lm, stddev_samp(ln(1 + TransactionAmt)) AS ls FROM a)
SELECT TransactionID, round((TransactionAmt - coalesce(m, TransactionAmt)) / coalesce(sd, 1), 5) AS user_amt_zscore, round((TransactionDT - coalesce(f, TransactionDT)) / CAST(86400 AS DOUBLE), 5) AS days_since_first_txn, round((ln(1 + TransactionAmt) - lm) / greatest(ls, 1e-6), 5) AS "TransactionAmt_log_z" FROM b LEFT JOIN u USING (UID) CROSS JOIN g""")
def user_zscore(spark: SparkSession, d: str) -> DataFrame:
    names = ["user_amt_zscore", "days_since_first_txn", "TransactionAmt_log_z"]
    rest, enc = _encoded(spark, d, **_NO_KEYS)
    return _rounded(fe.apply_totals(fe.apply_users(rest, enc), enc).select("TransactionID", *names), *names, places=5)


@query(f"""{TX}, q AS (SELECT quantile_cont(TransactionAmt, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q, avg(ln(1 + TransactionAmt)) AS lm, stddev_samp(ln(1 + TransactionAmt)) AS ls, avg(isFraud) AS fr FROM tx)
SELECT CAST(i AS BIGINT) AS decile, round(q[i + 1], 4) AS edge, round(lm, 6) AS log_mean, round(ls, 6) AS log_std, round(fr, 6) AS fraud_rate FROM q, range(0, 11) r(i)""")
def global_statistics(spark: SparkSession, d: str) -> DataFrame:
    g = fe.global_statistics(_tx(spark, d))
    return _rounded(g.select(F.posexplode("deciles").alias("decile", "edge"), "log_mean", "log_std", "fraud_rate").withColumn("decile", F.col("decile").cast("long")).withColumn("edge", F.round("edge", 4)), "log_mean", "log_std", "fraud_rate")


_NULLABLE = ("card4", "card6", "addr1", "P_emaildomain", "R_emaildomain", "id_30", "id_31", "id_33", "DeviceInfo", "DeviceType", "M1", "M4", "D1", "ProductCD", "score")


@query(TX + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(CAST({c} IS NULL AS INT)), 6) AS null_share, count({c}) AS known, round(abs(avg(CASE WHEN {c} IS NULL THEN isFraud END) - avg(CASE WHEN {c} IS NOT NULL THEN isFraud END)), 6) AS gap,
 CAST(avg(CAST({c} IS NULL AS INT)) > 0.15 AND (count({c}) < 100 OR abs(avg(CASE WHEN {c} IS NULL THEN isFraud END) - avg(CASE WHEN {c} IS NOT NULL THEN isFraud END)) < 0.01) AS INT) AS "drop" FROM tx""" for c in _NULLABLE))  # fmt: skip
def null_drop_stats(spark: SparkSession, d: str) -> DataFrame:
    out = fe.droppable_columns(_tx(spark, d).select("isFraud", *_NULLABLE), "isFraud", threshold=0.15)
    return _rounded(out.withColumn("drop", F.coalesce("drop", F.lit(0))), "null_share", "gap")


# --- evaluation ---------------------------------------------------------------------------

_HIT = f"p >= {THRESHOLD}"
_COUNTS = f"count_if(y = 1 AND {_HIT}) AS tp, count_if(y = 0 AND {_HIT}) AS fp, count_if(y = 1 AND NOT {_HIT}) AS fn, count_if(y = 0 AND NOT {_HIT}) AS tn"
_SUMS = f"coalesce(sum(amt) FILTER (y = 1 AND {_HIT}), 0) AS ta, coalesce(sum(amt) FILTER (y = 0 AND {_HIT}), 0) AS fa, coalesce(sum(amt) FILTER (y = 1 AND NOT {_HIT}), 0) AS ma"


@query(f"""{TX}, c AS (SELECT {_COUNTS}, {_SUMS} FROM sc), m AS (SELECT *, tp / (tp + fp + 1e-6) AS pr, tp / (tp + fn + 1e-6) AS re FROM c)
SELECT round(pr, 4) AS precision, round(re, 4) AS recall, round(2 * tp / (2 * tp + fp + fn + 1e-6), 4) AS f1, round(fp / (fp + tn + 1e-6), 4) AS fpr_insult_rate, round(ta + 30 * tp, 2) AS gross_savings, round(12.5 * fp + 0.15 * fa, 2) AS false_positive_loss,
 round(ta + 30 * tp - (12.5 * fp + 0.15 * fa), 2) AS net_savings, round(ma, 2) AS fraud_loss_missed, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, CAST(tp + fp + fn + tn AS BIGINT) AS total, round(100.0 * (tp + fn) / (tp + fp + fn + tn), 2) AS fraud_rate FROM m""")
def confusion_pnl(spark: SparkSession, d: str) -> DataFrame:
    return ev.profit_and_loss(_scored(spark, d), THRESHOLD)


def _auc_sql(src: str) -> str:
    return f"r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM {src}) SELECT round((sum(k) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0) / (CAST(count_if(y = 1) AS DOUBLE) * count_if(y = 0)), 9) AS roc_auc FROM r"


def _ap_sql(src: str) -> str:
    return f"g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM {src} GROUP BY p), c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS n, sum(pos) OVER () AS allp FROM g) SELECT round(sum(pos * tp / CAST(n AS DOUBLE)) / max(allp), 9) AS average_precision FROM c"


@query(f"{TX}, {_auc_sql('sc')}")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.roc_auc(_scored(spark, d)), "roc_auc", places=9)


@query(f"WITH l AS ({ad.LABELS_SQL}), {_auc_sql('l')}")
def roc_auc_labels(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.roc_auc(ad.label_scores(spark, d)), "roc_auc", places=9)


@query(f"{TX}, {_ap_sql('sc')}")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.average_precision(_scored(spark, d)), "average_precision", places=9)


@query(f"WITH l AS ({ad.LABELS_SQL}), {_ap_sql('l')}")
def average_precision_labels(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.average_precision(ad.label_scores(spark, d)), "average_precision", places=9)


def _grid_sql(lo: float, hi: float, n: int) -> str:
    return f"grid AS (SELECT CAST({lo} AS DOUBLE) + i * (CAST({hi} AS DOUBLE) - {lo}) / {n - 1} AS t FROM range(0, {n}) r(i))"


_AT = "k AS (SELECT t, count_if(y = 1 AND p >= t) AS tp, count_if(y = 0 AND p >= t) AS fp, count_if(y = 1 AND p < t) AS fn, count_if(y = 0 AND p < t) AS tn, coalesce(sum(amt) FILTER (y = 1 AND p < t), 0) AS ma, coalesce(sum(amt) FILTER (y = 0 AND p >= t), 0) AS fa FROM sc CROSS JOIN grid GROUP BY t)"
_COST = "ma + 30 * fn + 12.5 * fp + 0.15 * fa"


@query(f"{TX}, {_grid_sql(0.01, 0.99, 50)}, {_AT} SELECT round(t, 3) AS threshold, round({_COST}, 2) AS total_loss FROM k")
def cost_curve(spark: SparkSession, d: str) -> DataFrame:
    return ev.cost_curve(_scored(spark, d))


@query(f"{TX}, {_grid_sql(0.01, 0.99, 100)}, {_AT} SELECT round(t, 6) AS threshold FROM k ORDER BY round({_COST}, 6), t LIMIT 1")
def best_threshold_cost(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.best_threshold_cost(_scored(spark, d)), "threshold")


_CUM = "g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY p), c AS (SELECT p, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM g WINDOW w AS (ORDER BY p DESC))"


@query(f"{TX}, {_CUM}, f AS (SELECT p, tp / CAST(tp + fp AS DOUBLE) AS pr, tp / CAST(ap AS DOUBLE) AS re FROM c) SELECT p AS threshold FROM f ORDER BY round(coalesce(5 * pr * re / nullif(4 * pr + re, 0), 0), 9) DESC, p LIMIT 1")
def best_threshold_fbeta(spark: SparkSession, d: str) -> DataFrame:
    return ev.best_threshold_fbeta(_scored(spark, d))


@query(f"{TX}, {_CUM} SELECT p AS threshold FROM c WHERE fp / CAST(an AS DOUBLE) <= 0.02 ORDER BY tp DESC, p LIMIT 1")
def best_threshold_fpr(spark: SparkSession, d: str) -> DataFrame:
    return ev.best_threshold_fpr(_scored(spark, d))


@query(f"{TX}, {_CUM} SELECT p AS threshold, round(tp / CAST(ap AS DOUBLE), 6) AS tpr, round(fp / CAST(an AS DOUBLE), 6) AS fpr, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision FROM c")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.roc_points(_scored(spark, d)), "tpr", "fpr", "precision")


@query(f"{TX}, {_grid_sql(0.0, 1.0, 101)}, {_AT} SELECT round(t, 2) AS threshold, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 1), 4) AS precision, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 4) AS recall, round(coalesce(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 0), 4) AS insult_rate FROM k")
def simulation_table(spark: SparkSession, d: str) -> DataFrame:
    return ev.simulation_table(_scored(spark, d))


@query(f"{TX} SELECT id, p, CASE WHEN p >= 0.75 THEN 'BLOCK' WHEN p >= 0.15 THEN 'REVIEW' ELSE 'APPROVE' END AS action FROM sc")
def tiered_actions(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("id", "p", clean.tier(F.col("p"), 0.15, 0.75).alias("action"))


def _calibration_sql(src: str) -> str:
    return f"SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, round(avg(y), 6) AS prob_true, round(avg(p), 6) AS prob_pred, count(*) AS n FROM {src} GROUP BY 1"


@query(f"{TX} {_calibration_sql('sc')}")
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.calibration_curve(_scored(spark, d)), "prob_true", "prob_pred")


@query(f"WITH l AS ({ad.LABELS_SQL}) {_calibration_sql('l')}")
def calibration_curve_labels(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.calibration_curve(ad.label_scores(spark, d)), "prob_true", "prob_pred")



@query(f"""{TX}, m AS (SELECT y, amt, p AS a, CAST((id * 7919) % 1000 AS DOUBLE) / 1000 AS b, CAST((id * 3571) % 1000 AS DOUBLE) / 1000 AS c FROM sc),
e AS ({' UNION ALL '.join(f"SELECT '{n}' AS ensemble, y, amt, {' + '.join([f'{k} * CAST({w!r} AS DOUBLE)' for k, w in ws.items()])} AS p FROM m" for n, ws in ev.ensemble_scores(['a', 'b', 'c']).items())})
SELECT ensemble, round(sum(CASE WHEN y = 1 AND {_HIT} THEN amt + 30 WHEN y = 0 AND {_HIT} THEN -(12.5 + 0.15 * amt) ELSE 0 END), 2) AS net_savings FROM e GROUP BY ensemble""")
def ensemble_select(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    m = s.select("y", "amt", F.col("p").alias("a"), ((F.col("id") * 7919 % 1000).cast("double") / 1000).alias("b"), ((F.col("id") * 3571 % 1000).cast("double") / 1000).alias("c"))
    return ev.ensemble_report(m, ["a", "b", "c"], THRESHOLD)


@query(f"{TX} SELECT round(sqrt(count_if(y = 0) / CAST(count_if(y = 1) AS DOUBLE)), 6) AS scale FROM sc")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.class_balance(_scored(spark, d)), "scale")


@query(f"{TX}, {_grid_sql(0.01, 0.99, 50)}, {_AT}, z AS (SELECT round(t, 3) AS threshold, round({_COST}, 2) AS total_loss FROM k) SELECT * FROM z ORDER BY round(abs(threshold - 0.37), 9), threshold LIMIT 1")
def nearest_threshold(spark: SparkSession, d: str) -> DataFrame:
    return ev.nearest_point(ev.cost_curve(_scored(spark, d)), "threshold", 0.37)


# --- monitoring ---------------------------------------------------------------------------



def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records before and after the middle of the test year."""
    both = _both_halves(spark, d)
    return both.filter("live = 0"), both.filter("live = 1")


def _both_halves(spark: SparkSession, d: str) -> DataFrame:
    """All records, with ``live`` for those from the middle on; one number comes to the driver."""
    tx = _tx(spark, d)
    mid = tx.agg(F.avg("TransactionDT").alias("m")).first().m
    return tx.withColumn("live", (F.col("TransactionDT") >= F.lit(mid)).cast("int"))


_HALVES = "h AS (SELECT tx.*, CAST(TransactionDT >= (SELECT avg(TransactionDT) FROM tx) AS INT) AS live FROM tx)"
_FEATURES = ("TransactionAmt", "addr1", "D1", "score")
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, live, isFraud AS y FROM h" for c in _FEATURES) + ")"
_BASE = """b AS (SELECT feature, count(*) AS n, count(value) AS known, min(value) AS lo, max(value) AS hi FROM l WHERE live = 0 GROUP BY feature),
k AS (SELECT l.feature, l.live, b.n, b.known, CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, value >= lo AND value <= hi AS inside FROM l JOIN b USING (feature) WHERE value IS NOT NULL)"""


@query(f"""{TX}, {_HALVES}, {_LONG}, {_BASE} SELECT feature, CAST(bin AS BIGINT) AS bin, round(count(*) / CAST(max(known) AS DOUBLE), 6) AS share, round(1 - max(known) / CAST(max(n) AS DOUBLE), 6) AS null_share FROM k WHERE live = 0 GROUP BY feature, bin""")
def histogram_baseline(spark: SparkSession, d: str) -> DataFrame:
    base = mo.baseline(mo.melt(_halves(spark, d)[0], list(_FEATURES)))
    out = base.select("feature", F.posexplode("shares").alias("bin", "share"), "null_share").filter("share > 0")
    return _rounded(out.withColumn("bin", F.col("bin").cast("long")), "share", "null_share")


@query(f"""{TX}, {_HALVES}, {_LONG}, {_BASE}, f AS (SELECT feature, unnest(range(0, 10)) AS bin FROM b),
e AS (SELECT feature, bin, count(*) AS m FROM k WHERE live = 0 GROUP BY ALL), a AS (SELECT feature, bin, count(*) AS m FROM k WHERE live = 1 AND inside GROUP BY ALL),
t AS (SELECT feature, count(value) AS known, count(*) AS n FROM l WHERE live = 1 GROUP BY feature),
s AS (SELECT f.feature, greatest(coalesce(e.m, 0) / CAST(b.known AS DOUBLE), 1e-6) AS x, greatest(coalesce(a.m, 0) / CAST(t.known AS DOUBLE), 1e-6) AS z, abs((1 - t.known / CAST(t.n AS DOUBLE)) - (1 - b.known / CAST(b.n AS DOUBLE))) AS nd FROM f JOIN b USING (feature) JOIN t USING (feature) LEFT JOIN e ON e.feature = f.feature AND e.bin = f.bin LEFT JOIN a ON a.feature = f.feature AND a.bin = f.bin),
p AS (SELECT feature, sum((z - x) * ln(z / x)) AS psi, max(nd) AS nd FROM s GROUP BY feature)
SELECT feature, round(psi, 6) AS psi, round(nd, 6) AS null_drift, CASE WHEN psi > 0.2 OR nd > 0.1 THEN 'RED' ELSE 'GREEN' END AS status FROM p""")
def psi_drift(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mo.drift_between(mo.melt(_both_halves(spark, d), list(_FEATURES), ("live",))), "psi", "null_drift")


@query(f"""{TX}, {_HALVES}, q AS (SELECT list_distinct(quantile_cont(TransactionAmt, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS q0 FROM h WHERE live = 0), q1 AS (SELECT list_sort(q0) AS q FROM q),
k AS (SELECT live, CASE WHEN TransactionAmt BETWEEN q[1] AND q[-1] THEN least(len(list_filter(q, lambda e: e <= TransactionAmt)) - 1, len(q) - 2) END AS bin FROM h, q1),
n AS (SELECT live, count(*) AS n FROM k GROUP BY live), s AS (SELECT live, bin, count(*) AS m FROM k WHERE bin IS NOT NULL GROUP BY ALL),
b AS (SELECT DISTINCT bin FROM s), x AS (SELECT coalesce(e.m / CAST(ne.n AS DOUBLE), 1e-4) AS e, coalesce(a.m / CAST(na.n AS DOUBLE), 1e-4) AS a FROM b LEFT JOIN s e ON e.bin = b.bin AND e.live = 0 LEFT JOIN s a ON a.bin = b.bin AND a.live = 1 JOIN n ne ON ne.live = 0 JOIN n na ON na.live = 1)
SELECT round(sum((e - a) * ln(e / a)), 6) AS psi FROM x""")
def psi_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mo.psi_by_quantiles(*_halves(spark, d), "TransactionAmt"), "psi")


@query(f"""{TX}, {_HALVES}, s0 AS (SELECT live, id_31 AS c, count(*) AS m FROM h WHERE id_31 IS NOT NULL GROUP BY live, id_31), s AS (SELECT *, sum(m) OVER (PARTITION BY live) AS n FROM s0)
SELECT round(sum((e.m / CAST(e.n AS DOUBLE) - coalesce(a.m / CAST(a.n AS DOUBLE), 1e-4)) * ln((e.m / CAST(e.n AS DOUBLE)) / coalesce(a.m / CAST(a.n AS DOUBLE), 1e-4))), 6) AS psi FROM (SELECT * FROM s WHERE live = 0 ORDER BY m DESC, c LIMIT 50) e LEFT JOIN (SELECT * FROM s WHERE live = 1) a USING (c)""")
def psi_categories(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mo.psi_by_categories(*_halves(spark, d), "id_31"), "psi")


@query(f"""{TX}, {_HALVES}, {_LONG}, v AS (SELECT feature, value, sum(y) AS a, sum(1 - y) AS b FROM l WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT feature, sum(a) OVER w / CAST(sum(a) OVER (PARTITION BY feature) AS DOUBLE) AS ca, sum(b) OVER w / CAST(sum(b) OVER (PARTITION BY feature) AS DOUBLE) AS cb FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)),
k AS (SELECT feature, max(abs(ca - cb)) AS ks FROM c GROUP BY feature), m AS (SELECT feature, avg(value) FILTER (y = 1) AS mf, avg(value) FILTER (y = 0) AS ml, avg(CAST(value IS NULL AS INT)) AS ns FROM l GROUP BY feature)
SELECT feature, round(ks, 6) AS ks, round(mf, 5) AS mean_fraud, round(ml, 5) AS mean_legit, round(ns, 6) AS null_share, CASE WHEN ks > 0.4 THEN 'strong' WHEN ks > 0.2 THEN 'good' WHEN ks > 0.05 THEN 'weak' ELSE 'useless' END AS strength FROM m JOIN k USING (feature)""")
def ks_score(spark: SparkSession, d: str) -> DataFrame:
    out = mo.ks_scores(mo.melt(_tx(spark, d), list(_FEATURES), ("isFraud",)).withColumnRenamed("isFraud", "y"))
    return _rounded(_rounded(out, "ks", "null_share"), "mean_fraud", "mean_legit", places=5)


_CORR = ("TransactionAmt", "addr1", "D1", "score", "card1")


@query(f"{TX}, f AS (SELECT {', '.join(f'coalesce(CAST({c} AS DOUBLE), -999) AS {c}' for c in _CORR)} FROM tx) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS r FROM f" for k, a in enumerate(_CORR) for b in _CORR[k + 1 :]))
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mo.correlated_pairs(_tx(spark, d), list(_CORR)), "r")


@query(f"{TX}, s AS (SELECT min(p) AS lo, max(p) AS hi FROM sc) SELECT CAST(least(floor((p - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, count(*) AS n FROM sc, s GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return mo.histogram(_scored(spark, d), "p", 10).select("bin", "n")


@query(f"{TX} SELECT CAST(floor(p * 5) AS INT) AS bin, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM sc) AS DOUBLE), 6) AS share FROM sc WHERE p < 0.8 GROUP BY 1")
def histogram_on_edges(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mo.histogram_on(_scored(spark, d).filter("p <> 0.8 OR p IS NULL").unionByName(_scored(spark, d).filter("p = 0.8").withColumn("p", F.lit(9.0))), "p", [0.0, 0.2, 0.4, 0.6, 0.8]), "share")


@query(f"""{TX}, s AS (SELECT count(*) AS n, stddev_samp(p) * pow(count(*), -0.2) AS h, min(p) AS lo, max(p) AS hi FROM sc), g AS (SELECT i, lo + i * (hi - lo) / 99 AS x, n, h FROM s, range(0, 100) r(i))
SELECT CAST(i AS INT) AS k, round(x, 6) AS x, round(sum(exp(-pow((x - p) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density FROM sc CROSS JOIN g GROUP BY i, x""")
def score_density(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mo.density(_scored(spark, d), "p"), "x", "density")


@query(f"""WITH o AS ({ad.ORDERS_SQL}), p AS (SELECT CAST(ts AS DATE) AS day, avg(TransactionAmt) AS m, stddev_samp(TransactionAmt) AS s, count(*) AS n FROM o GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM p), (SELECT max(day) FROM p), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT c.day, round(m, 4) AS mean, round(s, 4) AS std, coalesce(n, 0) AS n FROM c LEFT JOIN p USING (day)""")
def daily_resample(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mo.daily_trend(ad.order_transactions(spark, d), "ts", "TransactionAmt"), "mean", "std", places=4)


# --- serving ------------------------------------------------------------------------------

_SEQ = "q AS (SELECT TransactionID AS seq, TransactionDT AS ts, isFraud AS y, score AS p, TransactionAmt AS amt FROM tx)"
_SERIES = f"""r AS (SELECT seq, ts, sum(CASE WHEN y = 1 AND {_HIT} THEN amt ELSE 0 END) OVER w AS s, sum(CASE WHEN y = 1 AND p < {THRESHOLD} THEN amt ELSE 0 END) OVER w AS l FROM q WINDOW w AS (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
v AS (SELECT seq, ts, round(s, 2) AS cumulative_savings, round(l, 2) AS cumulative_loss FROM r)"""


def _series(spark: SparkSession, d: str) -> DataFrame:
    q = _tx(spark, d).select(F.col("TransactionID").alias("seq"), F.col("TransactionDT").alias("ts"), F.col("isFraud").alias("y"), F.col("score").alias("p"), F.col("TransactionAmt").alias("amt"))
    return _rounded(vw.running_series(q, THRESHOLD), "cumulative_savings", "cumulative_loss", places=2)


@query(f"{TX}, {_SEQ}, {_SERIES} SELECT * FROM v")
def series_running(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d)


@query(f"""{TX}, {_SEQ}, {_SERIES}, k AS (SELECT *, row_number() OVER w AS n, lag(cumulative_savings) OVER w AS s, lag(cumulative_loss) OVER w AS l FROM v WINDOW w AS (ORDER BY ts, seq)),
e AS (SELECT seq, ts, cumulative_savings, cumulative_loss, row_number() OVER (ORDER BY ts, seq) - 1 AS i, count(*) OVER () AS n FROM k WHERE n = 1 OR s <> cumulative_savings OR l <> cumulative_loss)
SELECT seq, ts, cumulative_savings, cumulative_loss FROM e WHERE i % CAST(ceil(n / 100.0) AS BIGINT) = 0 OR i = n - 1""")
def series_dedupe_decimate(spark: SparkSession, d: str) -> DataFrame:
    hour = F.floor(F.col("ts") / 3600)
    return vw.decimate(vw.drop_repeats(_series(spark, d), ["ts", "seq"], hour), ["ts", "seq"], hour, 100)


_WEIGHTS = {"TransactionAmt": 0.01, "addr1": -0.002, "score": 1.5}
_IMPACT = " UNION ALL ".join(f"SELECT TransactionID AS id, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), 0) * CAST({w} AS DOUBLE) AS impact FROM tx" for c, w in _WEIGHTS.items())


@query(f"{TX}, i AS ({_IMPACT}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(impact) DESC, feature) AS n FROM i WHERE abs(impact) > 1e-4) SELECT id, n AS rank, feature, round(impact, 6) AS impact FROM k WHERE n <= 2")
def top_explanations(spark: SparkSession, d: str) -> DataFrame:
    e = _tx(spark, d).select(F.col("TransactionID").alias("id"), vw.linear_explanations(_WEIGHTS).alias("explanations"))
    e = e.select("id", F.posexplode(vw.top_explanations(n=2)).alias("rank", "e"))
    return e.select("id", (F.col("rank") + 1).cast("long").alias("rank"), "e.feature", F.round("e.impact", 6).alias("impact"))


@query(f"""{TX}, {_HALVES}, i AS ({_IMPACT.replace('FROM tx', 'FROM h WHERE live = {live}').format(live=0)}), j AS ({_IMPACT.replace('FROM tx', 'FROM h WHERE live = {live}').format(live=1)} UNION ALL SELECT 0, 'extra', 2.0 WHERE FALSE),
o AS (SELECT feature, sum(abs(impact)) / count(DISTINCT id) AS value FROM i WHERE feature <> 'score' GROUP BY feature), n AS (SELECT feature, sum(abs(impact)) / count(DISTINCT id) AS value FROM j WHERE feature <> 'addr1' GROUP BY feature)
SELECT feature, round(CASE WHEN n.value IS NULL THEN o.value ELSE coalesce(o.value, 0) * 0.9 + n.value * 0.1 END, 6) AS value FROM o FULL JOIN n USING (feature)""")
def importance_ema(spark: SparkSession, d: str) -> DataFrame:
    def of(df: DataFrame, *names: str) -> DataFrame:
        e = df.select(F.col("TransactionID").alias("id"), vw.linear_explanations({c: _WEIGHTS[c] for c in names}).alias("explanations"))
        return vw.mean_impacts(e)

    old, new = _halves(spark, d)
    return _rounded(vw.merge_importance(of(old, "TransactionAmt", "addr1"), of(new, "TransactionAmt", "score")), "value")


@query(f"{TX}, k AS (SELECT card1, TransactionID, TransactionAmt, row_number() OVER (PARTITION BY card1 ORDER BY TransactionID DESC) AS n FROM tx) SELECT card1, TransactionID, TransactionAmt FROM k WHERE n <= 5")
def capped_history(spark: SparkSession, d: str) -> DataFrame:
    return rd.newest(_tx(spark, d).select("card1", "TransactionID", "TransactionAmt"), 5, "TransactionID", ("card1",))


@query(f"{TX} SELECT card1, TransactionID, TransactionAmt FROM tx QUALIFY row_number() OVER (PARTITION BY card1 ORDER BY TransactionID DESC) = 1")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return rd.latest_by_key(_tx(spark, d).select("card1", "TransactionID", "TransactionAmt"), "card1", "TransactionID")


@query(f"{TX} SELECT id, y, p, amt FROM sc ORDER BY id DESC LIMIT 1000")
def recent(spark: SparkSession, d: str) -> DataFrame:
    return rd.newest(_scored(spark, d), 1000, "id")


@query(f"{TX} SELECT id, y, p, amt FROM sc WHERE id > 900")
def incremental_tail(spark: SparkSession, d: str) -> DataFrame:
    return rd.read_after(_scored(spark, d), "id", 900)


@query(f"{TX} SELECT id, y, p, amt FROM sc ORDER BY p DESC, id LIMIT 50")
def alerts_topk(spark: SparkSession, d: str) -> DataFrame:
    return vw.alerts(_scored(spark, d), 50)


@query(f"{TX} SELECT id, y, p, amt FROM sc WHERE id = 77")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("id = 77")


@query(f"""{TX}, k AS (SELECT coalesce(ProductCD, 'Unknown') AS "ProductCD", coalesce(card4, 'Unknown') AS card4, coalesce(DeviceType, 'Unknown') AS "DeviceType", TransactionAmt FROM tx WHERE isFraud = 1)
SELECT "ProductCD", card4, "DeviceType", round(sum(TransactionAmt), 2) AS total, count(*) AS n, CAST(grouping_id("ProductCD", card4, "DeviceType") AS BIGINT) AS level FROM k GROUP BY ROLLUP ("ProductCD", card4, "DeviceType")""")
def fraud_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vw.hierarchy_totals(_tx(spark, d).filter("isFraud = 1"), ["ProductCD", "card4", "DeviceType"], "TransactionAmt"), "total", places=2)


@query(f"""WITH o AS ({ad.ORDERS_SQL}) SELECT card4, "ProductCD", status, round(sum(TransactionAmt), 2) AS total, count(*) AS n, CAST(grouping_id(card4, "ProductCD", status) AS BIGINT) AS level FROM o GROUP BY ROLLUP (card4, "ProductCD", status)""")
def orders_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vw.hierarchy_totals(ad.order_transactions(spark, d), ["card4", "ProductCD", "status"], "TransactionAmt"), "total", places=2)


@query(f'{TX} SELECT "ProductCD", round(avg(score), 6) AS avg_score, round(avg(isFraud), 6) AS avg_truth, count(*) AS n FROM tx GROUP BY "ProductCD"')
def segment_perf(spark: SparkSession, d: str) -> DataFrame:
    df = _tx(spark, d).select("ProductCD", F.col("score").alias("p"), F.col("isFraud").alias("y"))
    return _rounded(vw.segment_performance(df, "ProductCD"), "avg_score", "avg_truth")


@query(f"{TX} SELECT upper(substr(k, 1, 1)) || lower(substr(k, 2)) AS network, round(sum(TransactionAmt), 2) AS total FROM (SELECT coalesce(card4, 'Unknown') AS k, TransactionAmt FROM tx) GROUP BY 1")
def network_value(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_tx(spark, d).groupBy(clean.capitalised(F.col("card4")).alias("network")).agg(F.sum("TransactionAmt").alias("total")), "total", places=2)


@query(f"{TX} SELECT ProductCD AS \"ProductCD\", round(total, 2) AS total FROM (SELECT ProductCD, sum(TransactionAmt) AS total FROM tx WHERE isFraud = 1 GROUP BY ProductCD) ORDER BY total DESC LIMIT 1")
def worst_product(spark: SparkSession, d: str) -> DataFrame:
    """The product with most fraud by value."""
    by = _tx(spark, d).filter("isFraud = 1").groupBy("ProductCD").agg(F.sum("TransactionAmt").alias("total"))
    return by.agg(F.max_by("ProductCD", "total").alias("ProductCD"), F.round(F.max("total"), 2).alias("total"))


@query(f"{TX} SELECT CAST(hour({_TS}) AS INT) AS hour, count(*) AS n FROM tx WHERE score >= {THRESHOLD} GROUP BY 1")
def alerts_by_hour(spark: SparkSession, d: str) -> DataFrame:
    df = _tx(spark, d).withColumn("p", F.col("score"))
    return vw.alerts_by_hour(df, F.timestamp_seconds(F.col("TransactionDT") + ad.EPOCH), THRESHOLD)


_NOW = 230000000


@query(f"""{TX}, s AS (SELECT count_if(score > 0.8) AS a, count(*) AS n, min(TransactionDT) AS o, count_if(score < 0.15 OR score >= 0.75) AS r FROM tx)
SELECT CAST(a AS BIGINT) AS alerts, CASE WHEN a > 20 THEN 'CRITICAL' WHEN a > 10 THEN 'HIGH' ELSE 'NORMAL' END AS load, round(greatest(2.0, ({_NOW} - o) / CAST(60 AS DOUBLE) / 2), 4) AS mttr_minutes, CAST(floor(a / 10.0) AS BIGINT) AS risk_velocity, round(100.0 * r / n, 6) AS auto_resolution FROM s""")
def ops_kpis(spark: SparkSession, d: str) -> DataFrame:
    df = _tx(spark, d).select(F.col("score").alias("p"), F.col("TransactionDT").alias("ts"))
    return _rounded(_rounded(vw.ops_figures(df, F.lit(_NOW)), "auto_resolution"), "mttr_minutes", places=4)


@query(f"""{TX}, s AS (SELECT count(*) AS n, count_if(p >= 0.75) AS a, count_if(p >= 0.15 AND p < 0.75) AS c, coalesce(sum(amt) FILTER (y = 1 AND p < 0.75), 0) AS m, coalesce(sum(amt) FILTER (p >= 0.75), 0) AS r FROM sc)
SELECT round(1 - a / CAST(n AS DOUBLE), 6) AS approval_rate, round(c / CAST(n AS DOUBLE), 6) AS challenge_rate, round(r, 2) AS revenue_at_risk, round(m + 15 * a, 2) AS total_cost FROM s""")
def strategy_kpis(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(vw.strategy_figures(_scored(spark, d), 0.15, 0.75), "approval_rate", "challenge_rate"), "revenue_at_risk", "total_cost", places=2)


@query(ad.ORDERS_SQL.replace("o_orderdate AS ts, ", ""))
def identity_left_join(spark: SparkSession, d: str) -> DataFrame:
    return ad.order_transactions(spark, d).drop("ts")


@query(f"""{TX}, t AS (SELECT card1, id_31 || ':' || CAST(card1 % 40 AS VARCHAR) AS dev, isFraud FROM tx), bad AS (SELECT dev FROM t WHERE dev IS NOT NULL GROUP BY dev HAVING sum(isFraud) > 1),
e AS (SELECT DISTINCT 'd:' || dev AS a, 'u:' || CAST(card1 AS VARCHAR) AS b FROM t JOIN bad USING (dev)), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (WITH RECURSIVE c(node, ring) AS (SELECT a, a FROM x UNION SELECT x.b, c.ring FROM c JOIN x ON x.a = c.node) SELECT node, min(ring) AS ring FROM c GROUP BY node)
SELECT ring, count(*) AS size, CAST(count_if(starts_with(node, 'u:')) AS BIGINT) AS users, CAST(count_if(starts_with(node, 'd:')) AS BIGINT) AS devices FROM r GROUP BY ring ORDER BY size DESC, ring LIMIT 3""")
def fraud_rings(spark: SparkSession, d: str) -> DataFrame:
    dev = F.concat(F.col("id_31"), F.lit(":"), (F.col("card1") % 40).cast("string"))
    return vw.fraud_rings(_tx(spark, d).select("card1", dev.alias("dev"), "isFraud"), "card1", "dev")


@query(f"""{TX}, {_HALVES}, {_LONG}, {_BASE} SELECT feature, round(1 - known / CAST(n AS DOUBLE), 6) AS null_share, CAST(1 - known / CAST(n AS DOUBLE) > 0.8 AS INT) AS is_sparse, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b""")
def feature_baseline(spark: SparkSession, d: str) -> DataFrame:
    base = mo.baseline(mo.melt(_halves(spark, d)[0], list(_FEATURES)))
    out = base.select("feature", "null_share", F.col("is_sparse").cast("int").alias("is_sparse"), F.element_at("edges", 1).alias("lo"), F.element_at("edges", -1).alias("hi"))
    return _rounded(out, "null_share", "lo", "hi")


# --- streams ------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, files: int | None = 4) -> DataFrame:
    """``events`` as a stream of transactions with ``ts``, an event time, in batches of some files (all files without)."""
    schema = ad.read_table(spark, d, "events").schema
    reader = spark.readStream.schema(schema)
    raw = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{d}/events*.parquet")
    return ad.as_transactions(raw).withColumn("ts", F.timestamp_seconds(F.col("TransactionDT") + ad.EPOCH))


@query(f'{TX} SELECT "ProductCD", count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS fraud FROM tx GROUP BY "ProductCD"')
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = _stream(spark, d).groupBy("ProductCD").agg(F.count("*").alias("n"), F.sum("isFraud").cast("long").alias("fraud"))
    return st.run_to_table(counts, "complete", "stream-counts")


@query(f"""{TX}, t AS (SELECT *, {_TS} AS ts FROM tx) SELECT CAST(date_trunc('day', ts) AS DATE) AS day, "ProductCD", count(*) AS n, round(sum(TransactionAmt), 2) AS amount FROM t GROUP BY ALL""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    w = st.tumbling(_stream(spark, d), "ts", "1 day", "2 days", ("ProductCD",), "TransactionAmt")
    out = st.run_to_table(w, "complete", "stream-windows")
    return out.select(F.to_date("start").alias("day"), "ProductCD", "n", F.round("amount", 2).alias("amount"))


@query(f"""{TXU}, k AS (SELECT *, CASE WHEN TransactionDT - lag(TransactionDT) OVER w < 21600 THEN 0 ELSE 1 END AS new FROM tx WINDOW w AS (PARTITION BY card1 ORDER BY TransactionDT, TransactionID)),
s AS (SELECT card1, TransactionDT, sum(new) OVER (PARTITION BY card1 ORDER BY TransactionDT, TransactionID) AS g FROM k) SELECT card1, min(TransactionDT) AS start_dt, count(*) AS n FROM s GROUP BY card1, g""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions over all files, in whatever order they come."""
    out = st.run_to_table(st.sessions(_stream(spark, d), "ts", "6 hours", None, ("card1",)), "complete", "stream-sessions")
    return out.select("card1", (F.unix_seconds("start") - ad.EPOCH).alias("start_dt"), "n")


@query(f"{TXU} SELECT TransactionID, UID, count(TransactionAmt) OVER w AS count_24h, round(coalesce(sum(TransactionAmt) OVER w, 0), 2) AS amt_sum_24h FROM tx WINDOW w AS (PARTITION BY UID ORDER BY TransactionDT RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)")
def stream_velocity(spark: SparkSession, d: str) -> DataFrame:
    """One batch, as files that are not in time order would make records late."""
    users = fe.with_user(clean.normalise_days(_stream(spark, d, files=None))).select("TransactionID", "UID", "TransactionDT", "TransactionAmt", "ts")
    out = st.run_to_table(st.keyed_velocity(users, 24, event_time="ts", epoch=ad.EPOCH), "append", "stream-velocity")
    return _rounded(out, "amt_sum_24h", places=2)


@query()
def stream_throttled_series(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).select(F.col("ProductCD").alias("series"), F.col("TransactionID").alias("seq"), F.col("TransactionDT").cast("double").alias("at"), F.when(F.col("isFraud") == 1, F.col("TransactionAmt")).otherwise(0.0).alias("delta"))
    return st.run_to_table(st.throttled(s, 3600.0, 500.0), "append", "stream-series")


@query(f"{TX} SELECT id, p, CASE WHEN p >= 0.75 THEN 'BLOCK' WHEN p >= 0.15 THEN 'REVIEW' ELSE 'APPROVE' END AS action, CAST(p >= 0.75 AS INT) AS is_fraud FROM sc")
def stream_scoring(spark: SparkSession, d: str) -> DataFrame:
    """The scoring stream with all its sinks; returns its predictions."""
    tables = st.ScoringTables.under(shared_path(spark, "scoring"))
    q = tables.start(ad.scored(_stream(spark, d)), rd.Settings())
    q.awaitTermination()
    return tables.predictions(spark).select("id", "p", "action", "is_fraud")


# --- learned models -----------------------------------------------------------------------


@query()
def isotonic_calibrate(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return ml.calibrate(s, ml.fit_calibration(s, "isotonic")).select("id", "p", "calibrated")


@query()
def platt_calibrate(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return ml.calibrate(s, ml.fit_calibration(s, "platt")).select("id", "p", "calibrated")


@query()
def pca_groups(spark: SparkSession, d: str) -> DataFrame:
    t = ad.read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("V1"), F.col("l_extendedprice").alias("V2"), F.col("l_discount").alias("V3"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("V4"), F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("V5"))
    return ml.apply_pca(t, ml.fit_pca(t, [f"V{k}" for k in range(1, 6)]))


@query()
def gbt_score(spark: SparkSession, d: str) -> DataFrame:
    """Trees fitted on the first 85 % of the records, scored on the rest."""
    df = fe.time_split(clean.amount_features(clean.card_features(clean.device_features(_users(spark, d)))))
    names = ["TransactionAmt", "ProductCD", "card4", "card6", "os_type", "browser_type", "device_vendor", "TransactionAmt_suspicious"]
    model = ml.fit_trees(df.filter("is_train = 1"), names, "isFraud")
    return ml.score_trees(df.filter("is_train = 0"), model).select("TransactionID", "isFraud", "probability")


@query()
def adversarial_validation(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return ml.adversarial(old, new, list(_FEATURES))


#: Features of the explained trees.
_EXPLAINED = (
    "TransactionAmt", "TransactionAmt_log", "TransactionAmt_decimal", "TransactionAmt_suspicious", "TransactionAmt_log_z", "ProductCD", "card1", "card4", "card6", "addr1", "M1", "M4", "D1", "D1_norm",
    "hour_of_day", "day_of_week", "day_of_month", "P_emaildomain_length", "P_emaildomain_vendor_id", "P_emaildomain_risk_score", "R_emaildomain_length", "R_emaildomain_vendor_id", "email_match_status",
    "screen_width", "screen_height", "screen_area", "os_type", "browser_type", "device_vendor", "device_type", "days_since_first_txn", "user_amt_zscore", "Amt_div_card1_mean", "Amt_div_addr1_mean",
    "card1_freq_enc", "UID_freq_enc", "card4_fraud_rate", "ProductCD_fraud_rate", "hour_of_day_fraud_rate", "composite_risk_score",
)


@query()
def gbt_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Exact contributions of each of 40 features to the raw score of 50 rounds of trees of depth 6, for every record."""
    tx = _tx(spark, d)
    cut, folder = fe.train_rows(tx), shared_path(spark, "encoders")
    df = sc.prepare(spread(tx), ad.EPOCH)
    needed = {*_EXPLAINED, fe.ROW, fe.TIME, fe.AMOUNT, fe.USER, "isFraud", *fe.GROUP_KEYS, *fe.COUNT_KEYS, *fe.RISK_KEYS}
    df = materialize(df.select(*[c for c in df.columns if c in needed]), "prepared")
    fe.fit_encoders(df.filter(cut)).save(folder)
    full = materialize(fe.apply_encoders(df, fe.Encoders.load(spark, folder)).select("TransactionID", "isFraud", "TransactionDT", *_EXPLAINED), "encoded")
    model = ml.fit_trees(full.filter(cut), list(_EXPLAINED), "isFraud", rounds=50, depth=6)
    return ml.explain_trees(full, model, ("TransactionID",))


@query()
def trained_score_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Raw records to report rows with their ten largest contributions, by a trained ensemble of all keys, saved and reloaded.

    It is fitted on the first 85 % of the records, as ``fit_model`` does, and scores the rest.
    """
    df = _tx(spark, d)
    cut, folder = fe.train_rows(df), shared_path(spark, "trained-model")
    sc.fit_model(df.filter(cut).drop("score"), ad.EPOCH).save(spark, folder)
    model = sc.ScoringModel.load(spark, folder)
    rest = materialize(model.features(spread(df.filter(~cut).drop("score"))), "features")
    said = model.explain_features(rest, "deep").select(F.col("TransactionID").cast("string").alias("transaction_id"), "explanations")
    return model.report(rest, F.timestamp_seconds(F.col("TransactionDT") + ad.EPOCH)).join(said, "transaction_id")


# --- further projections, filters, sources and sinks --------------------------------------


@query("SELECT TRY_CAST(event_id AS BIGINT) AS event_id, CAST(event_type AS VARCHAR) AS event_type, TRY_CAST(props AS DOUBLE) AS props, TRY_CAST(value AS DOUBLE) AS value FROM events")
def coerce_schema(spark: SparkSession, d: str) -> DataFrame:
    """Declared kinds for raw columns; what does not parse is null."""
    return clean.coerce_schema(ad.read_table(spark, d, "events").select("event_id", "event_type", "props", "value"), {"event_id"}, {"event_type"})


@query(f"""{TX} SELECT TransactionID, CAST(coalesce(CAST(addr1 AS BIGINT), -1) AS INT) AS addr1, CAST(NULL AS DOUBLE) AS "V1", TransactionAmt FROM tx""")
def align_model_columns(spark: SparkSession, d: str) -> DataFrame:
    """The model's columns in order: filled ids, absent columns as nulls."""
    return clean.align_columns(clean.fill_ids(clean.finite(_tx(spark, d)), ["addr1"]), ["TransactionID", "addr1", "V1", "TransactionAmt"])


@query(f"{TX} SELECT TransactionID AS transaction_id, coalesce(card4, 'none') AS card4, coalesce(CASE WHEN TransactionID % 5 = 0 THEN NULL ELSE score END, 0) AS score FROM tx")
def dashboard_projection(spark: SparkSession, d: str) -> DataFrame:
    """Raw values before engineered ones, dashboard names, and null scores as 0."""
    tx = _tx(spark, d).select("TransactionID", F.col("card4").alias("raw_card4"), F.lit("none").alias("card4"), F.when(F.col("TransactionID") % 5 != 0, F.col("score")).alias("p"))
    return clean.rename_columns(clean.prefer_raw(tx, ["TransactionID", "card4", "p"]), {"TransactionID": "transaction_id", "p": "score"})


def _oracle_columns(name: str, *columns: str) -> str:
    return f"(SELECT TransactionID, {', '.join(columns)} FROM ({ORACLES[name]}))"


_SHOWN = {
    "amount_features": ("TransactionAmt_log", "TransactionAmt_suspicious", "cents_value"), "clean_country": ("country",), "combination_codes": ("os_browser_combo", "card_email_combo", "device_info_combo"),
    "velocity_windows": ("UID_velocity_1h", "UID_velocity_12h", "UID_velocity_24h"), "graph_degrees": ("multi_entity_sharing", "addr1_degree"), "sequence_features": ("ProductCD_switch", "time_gap_anomaly"),
    "clean_email_features": ('"P_emaildomain_risk_score"', "email_match_status", '"P_emaildomain_is_free"'), "time_features": ("hour_of_day", "day_of_week"), "clean_device_features": ("screen_area",),
    "user_zscore": ("user_amt_zscore",), "group_ratio": ('"Amt_div_card1_mean"',),
}


@query(f"""{TX} SELECT TransactionID, tx."P_emaildomain", tx.TransactionAmt, tx."ProductCD", tx.card4, tx."DeviceType", composite_risk_score, addr1_fraud_rate, {', '.join(c for names in _SHOWN.values() for c in names)}
FROM tx JOIN {_oracle_columns('target_encode', 'composite_risk_score', 'addr1_fraud_rate')} USING (TransactionID) {' '.join(f'JOIN {_oracle_columns(n, *c)} USING (TransactionID)' for n, c in _SHOWN.items())}""")
def dashboard_rows(spark: SparkSession, d: str) -> DataFrame:
    """All 29 dashboard columns of the last 15 % of the records: raw values, user windows, degrees and encodings of those before."""
    tx = _tx(spark, d)
    cut, folder = fe.train_rows(tx), shared_path(spark, "encoders")
    df = materialize(sc.dashboard_features(tx, ad.EPOCH), "dashboard")
    fe.fit_encoders(df.filter(cut)).save(folder)
    out = sc.dashboard(fe.apply_encoders(df.filter(~cut), fe.Encoders.load(spark, folder)))
    places = {6: ("TransactionAmt_log", "composite_risk_score", "addr1_fraud_rate", "UID_velocity_1h", "UID_velocity_12h", "UID_velocity_24h", "Amt_div_card1_mean"), 5: ("user_amt_zscore",)}
    for n, names in places.items():
        out = _rounded(out, *names, places=n)
    return out


@query(f"{TXU} SELECT TransactionID, UID FROM tx WHERE UID IN (SELECT UID FROM tx GROUP BY UID HAVING count(*) > 1)")
def active_users(spark: SparkSession, d: str) -> DataFrame:
    """Records of users with more than one."""
    df = _users(spark, d).select("TransactionID", "UID")
    return df.join(df.groupBy("UID").agg(F.count("*").alias("n")).filter("n > 1"), "UID", "left_semi").select("TransactionID", "UID")


@query(f"{TX} SELECT id, p, 'BLOCK' AS action FROM sc WHERE p > 0.8")
def high_risk(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).withColumn("action", clean.tier(F.col("p"), 0.15, 0.75))
    return s.filter((F.col("p") > 0.8) & F.col("action").isin("BLOCK")).select("id", "p", "action")


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL AND isfinite(value)")
def finite_values(spark: SparkSession, d: str) -> DataFrame:
    return clean.finite(ad.read_table(spark, d, "events").select("event_id", "value")).filter("value IS NOT NULL")


@query(f"{TX} SELECT id, round(1 / (1 + exp(-(4 * p - 2 + 0.001 * amt))), 9) AS probability, CASE WHEN p > 0.8 THEN 'red' WHEN p > 0.4 THEN 'amber' ELSE 'green' END AS colour FROM sc")
def log_odds(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select("id", F.round(clean.sigmoid(4 * F.col("p") - 2 + 0.001 * F.col("amt")), 9).alias("probability"), clean.band(F.col("p"), 0.8, 0.4).alias("colour"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0")
def parse_messages(spark: SparkSession, d: str) -> DataFrame:
    """JSON messages of the schema; one in seven is cut short here and goes to the dead letters."""
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())])
    return rd.parse_messages(_messages(spark, d), schema)[0]


def _messages(spark: SparkSession, d: str) -> DataFrame:
    e = ad.read_table(spark, d, "events")
    text = F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit(", "), F.expr("substring(props, 2)"))
    return e.select(F.when(F.col("event_id") % 7 == 0, F.substring(text, 1, 9)).otherwise(text).alias("value"))


@query("SELECT '{\"event_i' AS original_message, 'parse error' AS error_reason FROM events WHERE event_id % 7 = 0")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())])
    return rd.parse_messages(_messages(spark, d), schema)[1].select("original_message", "error_reason")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, ts FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '2024-01-10 00:00:00') WHERE n = 1")
def ttl_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last record that is within its hour to live at a given moment."""
    e = ad.read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    live = e.filter(F.col("ts") <= now).withColumn("at", F.struct("ts", "event_id")).filter(F.col("ts") > now - F.expr("INTERVAL 1 HOUR"))
    return live.groupBy("user_id").agg(F.max_by("event_id", "at").alias("event_id"))


@query(f"{TX} SELECT TransactionID, 'event' AS part FROM tx UNION ALL SELECT o_orderkey, NULL FROM orders")
def concat_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two tables one after the other; a column that one lacks is null there."""
    tx = _tx(spark, d).select("TransactionID").withColumn("part", F.lit("event"))
    return tx.unionByName(ad.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("TransactionID")), allowMissingColumns=True)


@query(f"{TX} SELECT DISTINCT card1, addr1 FROM tx")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return _tx(spark, d).select("card1", "addr1").dropDuplicates()


@query(f"{TX}, i AS ({_IMPACT}) SELECT feature, round(sum(abs(impact)) / count(DISTINCT id), 6) AS value FROM i GROUP BY feature ORDER BY value DESC, feature LIMIT 2")
def importance_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _tx(spark, d).select(F.col("TransactionID").alias("id"), vw.linear_explanations(_WEIGHTS).alias("explanations"))
    return _rounded(vw.mean_impacts(e), "value").orderBy(F.col("value").desc(), "feature").limit(2)


@query(f"""SELECT * FROM ({ORACLES['psi_drift']}) WHERE feature IN (SELECT feature FROM ({TX}, {_HALVES}, i AS ({_IMPACT.replace('FROM tx', 'FROM h WHERE live = 0')}) SELECT feature, sum(abs(impact)) / count(DISTINCT id) AS value FROM i GROUP BY feature) ORDER BY value DESC, feature LIMIT 2)""")
def drift_job(spark: SparkSession, d: str) -> DataFrame:
    """The periodic drift job: important features' logs against the baseline."""
    old, new = _halves(spark, d)
    base = mo.baseline(mo.melt(old, list(_FEATURES)))
    importance = vw.mean_impacts(old.select(F.col("TransactionID").alias("id"), vw.linear_explanations(_WEIGHTS).alias("explanations")))
    return _rounded(vw.drift_report(vw.feature_log(new, list(_FEATURES), "TransactionID"), importance, base, top=2), "psi", "null_drift")


@query(f"{TX} SELECT TransactionID, TransactionAmt FROM tx ORDER BY md5(CAST(TransactionID AS VARCHAR)), TransactionID LIMIT 500")
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 500 records, the same ones every time: the smallest hashes of the id."""
    return _tx(spark, d).select("TransactionID", "TransactionAmt").orderBy(F.md5(F.col("TransactionID").cast("string")), "TransactionID").limit(500)


@query()
def formatted_figures(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select("id", clean.currency(F.col("amt") * 1000).alias("amount"), clean.percent(F.col("p")).alias("share"), F.to_json(F.struct("id", "p")).alias("json"))


@query()
def mock_source(spark: SparkSession, d: str) -> DataFrame:
    return rd.mock_transactions(ad.read_table(spark, d, "events").select("event_id"))


@query(f"{TX} SELECT TransactionDT, TransactionID, card4, 'tx_' || CAST(row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS VARCHAR) AS transaction_id FROM tx")
def replay_ids(spark: SparkSession, d: str) -> DataFrame:
    tx = rd.missing_to_null(_tx(spark, d).select("TransactionDT", "TransactionID", "card4"))
    return rd.with_replay_id(tx, ["TransactionDT", "TransactionID"], F.floor(F.col("TransactionDT") / 3600))


@query()
def hyper_search(spark: SparkSession, d: str) -> DataFrame:
    """Settings of boosted trees by a Parzen search of 20 tries in the ranges of production (``SPACE``) over three expanding-window folds."""
    names = ["TransactionAmt", "ProductCD", "card4"]
    df = materialize(fe.time_folds(clean.card_features(_tx(spark, d)), 3).select("fold", "isFraud", *names), "folds")
    return ml.settings_search(df, "fold", names, "isFraud")


@query()
def cv_score(spark: SparkSession, d: str) -> DataFrame:
    """The rest's scores by the mean of three expanding windows' trees, each stopped early on its fold."""
    df, names = clean.card_features(clean.device_features(_tx(spark, d))), ["TransactionAmt", "ProductCD", "card4", "card6", "os_type", "device_vendor"]
    cut = fe.train_rows(df)
    return ml.expanding_cv(fe.time_folds(df.filter(cut), 3), df.filter(~cut), "fold", names, "isFraud", rounds=10)[0].select("TransactionID", "isFraud", "probability")


# --- the whole way from raw records to reports ---------------------------------------------

_LINEAR = {
    "amounts": ({"TransactionAmt_log": 0.8, "card4_fraud_rate": 4.0, "device_vendor_freq_enc": 0.0001, "user_amt_zscore": 0.3, "TransactionAmt_suspicious": 0.5}, -3.0),
    "products": ({"ProductCD_fraud_rate": 6.0, "Amt_div_card1_mean": 0.2}, -1.0),
}
_SHARES, _CURVE = {"amounts": 0.7, "products": 0.3}, (4.0, -2.0)


def _linear_sql(name: str) -> str:
    weights, bias = _LINEAR[name]
    return f"1 / (1 + exp(-(CAST({bias} AS DOUBLE) + {' + '.join(f'CAST({w} AS DOUBLE) * {c}' for c, w in sorted(weights.items()))})))"


def _rate_sql(c: str) -> str:
    return f"(SELECT {c}, (sum(isFraud) + 500 * max(m)) / (count(isFraud) + 500) AS r FROM a CROSS JOIN g WHERE {c} IS NOT NULL GROUP BY {c}) r_{c} ON b.{c} = r_{c}.{c}"


@query(f"""{_ENC}, g AS (SELECT avg(isFraud) AS m FROM a), u AS (SELECT UID, avg(TransactionAmt) AS m, coalesce(nullif(stddev_samp(TransactionAmt), 0), 1) AS sd FROM a GROUP BY UID),
f AS (SELECT b.TransactionID, b.TransactionDT, b.TransactionAmt, b.isFraud, ln(1 + b.TransactionAmt) AS "TransactionAmt_log", (b.TransactionAmt - coalesce(u.m, b.TransactionAmt)) / coalesce(sd, 1) AS user_amt_zscore, coalesce(r_card4.r, g.m) AS card4_fraud_rate, coalesce(r_ProductCD.r, g.m) AS "ProductCD_fraud_rate",
 coalesce(v.n, 0) AS device_vendor_freq_enc, b.TransactionAmt / (coalesce(c1.m, b.TransactionAmt) + 1e-5) AS "Amt_div_card1_mean", CAST(round(b.TransactionAmt * 1000) AS BIGINT) AS mills,
 CAST(mills % 100000 = 0 AS INT) + CAST(mills % 100000 = 99000 AS INT) + CAST(mills % 1000 IN (990, 950, 900, 490, 0) AS INT) AS "TransactionAmt_suspicious"
 FROM b CROSS JOIN g LEFT JOIN u USING (UID) LEFT JOIN {_rate_sql('card4')} LEFT JOIN {_rate_sql('ProductCD')} LEFT JOIN (SELECT device_vendor, count(*) AS n FROM a GROUP BY device_vendor) v ON b.device_vendor = v.device_vendor LEFT JOIN (SELECT card1, avg(TransactionAmt) AS m FROM a GROUP BY card1) c1 ON b.card1 = c1.card1),
ens AS (SELECT *, {' + '.join(f'{w} * ({_linear_sql(n)})' for n, w in _SHARES.items())} AS raw FROM f), p AS (SELECT *, 1 / (1 + exp(-({_CURVE[0]} * raw + ({_CURVE[1]})))) AS p FROM ens)
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, round(p, 4) AS probability, CAST(p >= 0.75 AS INT) AS is_fraud, isFraud AS y_true, CASE WHEN p >= 0.75 THEN 'BLOCK' WHEN p >= 0.15 THEN 'REVIEW' ELSE 'APPROVE' END AS action, TransactionAmt AS amount,
 strftime(TIMESTAMP '2017-11-30 00:00:00' + to_seconds(TransactionDT), '%Y-%m-%dT%H:%M:%S') AS timestamp FROM p""")
def score_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Raw records to report rows by a saved and reloaded model: encoders of the first 85 %, two linear models, a calibration, tiers."""
    df, cut, model = _scoring_model(spark, d)
    now = F.timestamp_seconds(F.col("TransactionDT") + ad.EPOCH)
    return model.score(df.filter(~cut), now)


def _scoring_model(spark: SparkSession, d: str):
    df = _tx(spark, d)
    cut, folder = fe.train_rows(df), shared_path(spark, "scoring-model")
    enc = fe.fit_encoders(sc.prepare(df.filter(cut), ad.EPOCH), ("card1",), ("device_vendor",), ("card4", "ProductCD"))
    sc.ScoringModel(enc, {n: sc.LinearScorer(*m) for n, m in _LINEAR.items()}, _SHARES, ad.EPOCH, _CURVE).save(spark, folder)
    return df, cut, sc.ScoringModel.load(spark, folder)


@query(ORACLES["score_pipeline"])
def stream_score_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The same model over a stream: raw records are scored in each micro-batch and written to all tables; returns the report rows."""
    _, cut, model = _scoring_model(spark, d)
    stream = _stream(spark, d).filter(~cut)

    def score(batch: DataFrame) -> DataFrame:
        p = model.probabilities(model.features(batch))
        return p.select(F.col("TransactionID").alias("id"), F.col("isFraud").alias("y"), "p", F.col("TransactionAmt").alias("amt"), F.col("ts").alias("happened"), F.col("user_amt_zscore"))

    tables = st.ScoringTables(shared_path(spark, "scored"))
    tables.start(stream, rd.Settings(), score=lambda b: score(b).withColumn("seconds", F.unix_seconds("happened")), log=("user_amt_zscore", "seconds")).awaitTermination()
    when = tables.history(spark, 1 << 40).filter("feature = 'seconds'").select("id", F.col("value").cast("long").alias("_s"))
    said = tables.predictions(spark).join(when, "id")
    return said.select(
        F.col("id").cast("string").alias("transaction_id"), F.round("p", 4).alias("probability"), "is_fraud", "y_true", "action", F.col("amt").alias("amount"), sc.iso_time(F.timestamp_seconds("_s")).alias("timestamp")
    )


@query(f"SELECT *, CAST(least(total, 1000) AS BIGINT) AS queue_depth, CAST(12.5 AS DOUBLE) AS live_latency_ms, total AS total_lifetime_count, CAST({THRESHOLD} AS DOUBLE) AS threshold, '2024-01-10T00:00:00' AS updated_at FROM ({ORACLES['confusion_pnl']})")
def business_report(spark: SparkSession, d: str) -> DataFrame:
    return sc.business_report(_scored(spark, d), THRESHOLD, 12.5, F.lit("2024-01-10 00:00:00").cast("timestamp"))


@query(f"SELECT CASE WHEN n >= 1000 THEN threshold ELSE 0.75 END AS threshold, n FROM ({ORACLES['best_threshold_cost']}), ({TX} SELECT count(*) AS n FROM sc WHERE y IS NOT NULL AND p IS NOT NULL)")
def reoptimised_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sc.reoptimised(_scored(spark, d), 0.75), "threshold")


def _psi_sql(c: str) -> str:
    return f"""(WITH q AS (SELECT list_sort(list_distinct(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM h WHERE live = 0),
k AS (SELECT live, CASE WHEN {c} BETWEEN q[1] AND q[-1] THEN least(len(list_filter(q, lambda e: e <= {c})) - 1, len(q) - 2) END AS bin FROM h, q WHERE {c} IS NOT NULL),
n AS (SELECT live, count(*) AS n FROM k GROUP BY live), s AS (SELECT live, bin, count(*) AS m FROM k WHERE bin IS NOT NULL GROUP BY ALL),
x AS (SELECT coalesce(e.m / CAST(ne.n AS DOUBLE), 1e-4) AS e, coalesce(a.m / CAST(na.n AS DOUBLE), 1e-4) AS a FROM (SELECT DISTINCT bin FROM s) b LEFT JOIN s e ON e.bin = b.bin AND e.live = 0 LEFT JOIN s a ON a.bin = b.bin AND a.live = 1 JOIN n ne ON ne.live = 0 JOIN n na ON na.live = 1)
SELECT '{c}' AS feature, sum((e - a) * ln(e / a)) AS psi FROM x)"""


@query(f"""{TX}, {_HALVES} SELECT feature, round(psi, 6) AS psi, CASE WHEN psi > 0.2 THEN 'critical' WHEN psi > 0.1 THEN 'warning' ELSE 'stable' END AS status FROM ({' UNION ALL '.join(f'FROM {_psi_sql(c)}' for c in _FEATURES)}) ORDER BY psi DESC, feature LIMIT 3""")
def psi_heads(spark: SparkSession, d: str) -> DataFrame:
    """The three least stable features."""
    return _rounded(mo.psi_table(*_halves(spark, d), list(_FEATURES), 3), "psi")


_TWINS = " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS twin, abs(corr(coalesce(CAST({a} AS DOUBLE), -999), coalesce(CAST({b} AS DOUBLE), -999))) AS r FROM h WHERE live = 0" for a in _FEATURES for b in _FEATURES if a != b)


@query(f"""SELECT k.feature, k.ks, k.strength, twin, round(r, 6) AS twin_r, psi, status FROM ({ORACLES['ks_score']}) k JOIN (SELECT * FROM ({TX}, {_HALVES} {_TWINS}) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY r DESC, twin DESC) = 1) t USING (feature)
LEFT JOIN ({ORACLES['psi_heads'].replace('LIMIT 3', '')}) p USING (feature)""")
def feature_quality(spark: SparkSession, d: str) -> DataFrame:
    """Signal, redundancy and stability of each feature."""
    return _rounded(mo.quality_report(*_halves(spark, d), list(_FEATURES), "isFraud"), "ks", "twin_r", "psi")


@query(ORACLES["simulation_table"])
def simulation_map(spark: SparkSession, d: str) -> DataFrame:
    """The simulation table as one map by threshold, as the API gives it, and as rows again."""
    t = ev.simulation_table(_scored(spark, d))
    packed = t.agg(F.map_from_entries(F.collect_list(F.struct("threshold", F.struct("precision", "recall", "insult_rate").alias("v")))).alias("m"))
    return packed.select(F.explode("m").alias("threshold", "v")).select("threshold", "v.*")


@query(f"""{TX} SELECT feature, round(share, 6) AS null_share FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, avg(CAST({c} IS NULL AS INT)) AS share FROM tx" for c in _NULLABLE)})""")
def null_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each column is missing; those of over 0.99 go at fit time."""
    return _rounded(fe.null_shares(_tx(spark, d).select(*_NULLABLE)), "null_share")
