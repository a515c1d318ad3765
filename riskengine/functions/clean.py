"""Cleaning and encoding of raw records: pure column expressions, so all of it is one projection.

Missing values are handled as each function says; texts are matched in lower case unless
said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _constant(value: str | int) -> str:
    """A value as SQL writes it; constants of many values are parsed at once instead of being put together one by one."""
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def case_map(c: Column, table: dict, default) -> Column:
    """A literal lookup (one constant map, however long the table); null and unknown values get the default."""
    return F.coalesce(F.try_element_at(F.expr(f"map({', '.join(_constant(x) for pair in table.items() for x in pair)})"), c), F.lit(default))


def first_match(c: Column, cases: list[tuple[str, int]], default: int) -> Column:
    """The value of the first case of which a text contains one of the parts between bars; null contains none.

    The cases are one constant array, so the compiled code stays small.
    """
    parts = F.expr("array(" + ", ".join(f"named_struct('part', {_constant(x)}, 'value', {v})" for of, v in cases for x in of.split("|")) + ")")
    return F.coalesce(F.get(F.filter(parts, lambda p: F.contains(c, p["part"])), F.lit(0))["value"], F.lit(default))


# Fixed values of the encodings, which a model fitted elsewhere relies on.
EMAIL_ALIASES = {"gmail": "gmail.com", "nan": "unknown"}
FREE_PROVIDERS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "mail.ru", "yandex.ru", "protonmail.com")
VENDORS = {
    "gmail": "google", "googlemail": "google", "hotmail": "microsoft", "outlook": "microsoft", "msn": "microsoft", "live": "microsoft", "yahoo": "yahoo", "ymail": "yahoo", "rocketmail": "yahoo",
    "icloud": "apple", "me": "apple", "mac": "apple", "comcast": "isp", "verizon": "isp", "att": "isp", "sbcglobal": "isp", "protonmail": "privacy", "anonymous": "privacy", "mailinator": "privacy",
}
VENDOR_IDS = {"google": 1, "microsoft": 2, "yahoo": 3, "apple": 4, "isp": 5, "privacy": 6}
VENDOR_RISK = {"google": 0, "microsoft": 0, "yahoo": 0, "apple": 0, "isp": -1, "privacy": 5}
SUFFIX_IDS = {"com": 1, "net": 2, "edu": 3, "org": 4, "mx": 5, "es": 6, "de": 7}
COUNTRY_IDS = {"mx": 1, "es": 2, "de": 3, "fr": 4, "uk": 5, "jp": 6, "br": 7, "ru": 8}
COUNTRY_SUFFIXES = {
    "mx": "Mexico", "es": "Spain", "fr": "France", "uk": "United Kingdom", "de": "Germany", "jp": "Japan", "br": "Brazil", "ca": "Canada",
    "ru": "Russia", "it": "Italy", "au": "Australia",
}
OS_CASES = [("linux", 5), ("mac os", 4), ("windows", 3), ("android", 2), ("ios", 1)]
BROWSER_CASES = [
    ("edge|ie |trident|msie|microsoft", 6),
    ("opera", 4),
    ("android|generic|zte|lg/|mot|huawei|lanix|blade|nokia|m4tel|inco|blu", 3),
    ("samsung", 2),
    ("puffin|maxthon|comodo|iron|silk|line|aol|cyberfox|waterfox|palemoon|seamonkey", 1),
    ("firefox|mozilla", 5),
]
DEVICE_CASES = [
    ("asus", 15), ("htc", 14), ("rv:", 13), ("windows", 12), ("redmi", 11), ("alcatel", 10), ("lenovo", 9), ("pixel", 8), ("zte", 7),
    ("sony", 6), ("lg", 5), ("moto", 4), ("huawei|honor", 3), ("ios|apple|iphone", 2), ("samsung|sm-|gt-", 1),
]
CARD_NETWORKS = {"visa": 1, "mastercard": 2, "american express": 3, "discover": 4}
CARD_KINDS = {"debit": 1, "credit": 2, "debit or credit": 3, "charge card": 4}
PRODUCTS = {"W": 1, "H": 2, "C": 3, "S": 4, "R": 5}
M_VALUES = {"T": 1, "F": 0, "M0": 0, "M1": 1, "M2": 2}
STATUSES = {"Found": 1, "New": 1, "NotFound": 0, "Unknown": 0}
PROXIES = {"IP_PROXY:TRANSPARENT": 1, "IP_PROXY:ANONYMOUS": 2, "IP_PROXY:HIDDEN": 3}
DEVICE_TYPES = {"mobile": 1, "desktop": 0}


def clean_email(c: Column) -> Column:
    """Lower case, aliases resolved; null is ``unknown``."""
    low = F.coalesce(F.lower(c), F.lit("nan"))
    return F.when(low == "gmail", EMAIL_ALIASES["gmail"]).when(low == "nan", EMAIL_ALIASES["nan"]).otherwise(low)


def email_columns(c: Column, prefix: str) -> dict[str, Column]:
    """Features of one mail domain. ``c`` is the cleaned domain."""
    vendor, suffix = F.substring_index(c, ".", 1), F.substring_index(c, ".", -1)
    digit = c.rlike("[0-9]").cast("int")
    return {
        f"{prefix}_length": F.length(c),
        f"{prefix}_has_digits": digit,
        f"{prefix}_is_free": c.isin(*FREE_PROVIDERS).cast("int"),
        f"{prefix}_vendor_id": case_map(vendor, {v: VENDOR_IDS[g] for v, g in VENDORS.items()}, 0),
        f"{prefix}_suffix_id": case_map(suffix, SUFFIX_IDS, 0),
        f"{prefix}_country_id": case_map(suffix, COUNTRY_IDS, 0),
        f"{prefix}_risk_score": case_map(vendor, {v: VENDOR_RISK[g] for v, g in VENDORS.items()}, 1) + digit + F.when(vendor.rlike("temp|fake|trash"), 3).otherwise(0),
    }


def email_features(tx: DataFrame) -> DataFrame:
    """Both parties' mail domains and how they agree; two missing domains agree. All columns are kept."""
    df = tx.withColumns({c: clean_email(F.col(c)) for c in ("P_emaildomain", "R_emaildomain")})
    df = df.withColumns(email_columns(F.col("P_emaildomain"), "P_emaildomain") | email_columns(F.col("R_emaildomain"), "R_emaildomain"))
    p, r = F.col("P_emaildomain_country_id"), F.col("R_emaildomain_country_id")
    return df.withColumns({"email_match_status": (F.col("P_emaildomain") == F.col("R_emaildomain")).cast("int"), "email_country_mismatch": ((p != 0) & (r != 0) & (p != r)).cast("int")})


def country_of_domain(c: Column) -> Column:
    """The country that a raw mail domain's last part names."""
    low = F.lower(c)
    named = case_map(F.substring_index(F.trim(low), ".", -1), COUNTRY_SUFFIXES, "USA/Global")
    return F.when(low.isNull() | low.isin("nan", "none", "unknown"), "Unknown").otherwise(named)


def set_country(tx: DataFrame) -> DataFrame:
    """``country`` by the payer's raw domain; by the recipient's only where there is no payer column."""
    source = next((c for c in ("P_emaildomain", "R_emaildomain") if c in tx.columns), None)
    return tx.withColumn("country", country_of_domain(F.col(source)) if source else F.lit("Unknown"))


def screen_size(c: Column) -> tuple[Column, Column]:
    """Width and height of ``WxH``; null where a text has not two whole numbers."""
    parts = F.split(c, "x")
    num = lambda k: F.when(F.size(parts) == 2, F.get(parts, F.lit(k)).try_cast("int"))
    return num(0), num(1)


def browser_type(c: Column) -> Column:
    """Browser family of a user-agent text in lower case; marks of devices go before chrome and safari."""
    mobile = c.rlike("mobile|android|ios")
    chrome = F.when(c.rlike("chrome|chromium|google"), F.when(mobile, 7).otherwise(8))
    safari = F.when(c.contains("safari"), F.when(mobile, 9).otherwise(10))
    return F.coalesce(F.nullif(first_match(c, BROWSER_CASES, 0), F.lit(0)), chrome, safari, F.lit(0))


def device_features(tx: DataFrame) -> DataFrame:
    """Screen, system, browser and device maker; unknown ones are 0. All columns are kept."""
    w, h = screen_size(F.col("id_33"))
    text = lambda c: F.coalesce(F.lower(c), F.lit(""))
    df = tx.withColumns({
        "screen_width": w, "screen_height": h, "os_type": first_match(text("id_30"), OS_CASES, 0), "browser_type": browser_type(text("id_31")),
        "device_vendor": first_match(text("DeviceInfo"), DEVICE_CASES, 0), "device_type": case_map(F.col("DeviceType"), DEVICE_TYPES, -1),
    })
    return df.withColumns({"screen_area": F.col("screen_width").cast("bigint") * F.col("screen_height"), "screen_aspect_ratio": F.col("screen_width") / (F.col("screen_height") + 1)})


def identity_status(tx: DataFrame) -> DataFrame:
    """Encodes the identity columns that are there: found or not, proxies, ``x:n`` marks, true or false."""
    out = {f"id_{k}": case_map(F.col(f"id_{k}"), STATUSES, -1) for k in (12, 15, 16, 27, 28, 29) if f"id_{k}" in tx.columns}
    out |= {f"id_{k}": case_map(F.col(f"id_{k}"), {"T": 1, "F": 0}, -1) for k in (35, 36, 37, 38) if f"id_{k}" in tx.columns}
    if "id_23" in tx.columns:
        out["id_23"] = case_map(F.col("id_23"), PROXIES, -1)
    if "id_34" in tx.columns:
        out["id_34"] = F.coalesce(F.substring_index(F.col("id_34"), ":", -1).try_cast("int"), F.lit(-1))
    return tx.withColumns(out)


def card_features(tx: DataFrame) -> DataFrame:
    """Encodes product, card network and kind, and every column whose name starts with M."""
    out = {c: case_map(F.col(c), M_VALUES, -1) for c in tx.columns if c.startswith("M")}
    return tx.withColumns(out | {"ProductCD": case_map(F.col("ProductCD"), PRODUCTS, 0), "card4": case_map(F.lower("card4"), CARD_NETWORKS, -1), "card6": case_map(F.lower("card6"), CARD_KINDS, -1)})


def time_features(tx: DataFrame, epoch: int) -> DataFrame:
    """Hour, weekday (Monday 0), day, month and the hour on a circle, in UTC."""
    ts = F.timestamp_seconds(F.col("TransactionDT") + epoch)
    df = tx.withColumns({"hour_of_day": F.hour(ts), "day_of_week": F.weekday(ts), "day_of_month": F.day(ts), "month_year": F.year(ts) * 100 + F.month(ts)})
    turn = 2 * F.pi() * F.col("hour_of_day") / 24
    return df.withColumns({"hour_sin": F.sin(turn), "hour_cos": F.cos(turn)})


def normalise_days(tx: DataFrame) -> DataFrame:
    """``<c>_norm`` for each ``D<digits>`` column: the day its delta points to."""
    names = [c for c in tx.columns if c[:1] == "D" and c[1:].isdigit()]
    return tx.withColumns({f"{c}_norm": F.col("TransactionDT") / 86400 - F.col(c) for c in names})


def amount_features(tx: DataFrame) -> DataFrame:
    """Round and odd amounts. Parts are taken from the amount in thousandths, rounded, so no binary remainder decides.

    Sub-cent digits count: 59.065 has the decimal part 0.065 and the cents value 65. Null
    amounts have the parts of 0 and are not suspicious.
    """
    amt = F.col("TransactionAmt")
    mills = F.round(F.coalesce(amt, F.lit(0.0)) * 1000).cast("long")
    last, hundred = F.pmod(mills, F.lit(1000)), F.pmod(mills, F.lit(100000))
    odd = (hundred == 0).cast("int") + (hundred == 99000).cast("int") + last.isin(990, 950, 900, 490, 0).cast("int")
    return tx.withColumns({
        "TransactionAmt_log": F.log1p(amt), "TransactionAmt_suspicious": F.when(amt.isNull(), 0).otherwise(odd), "cents_value": last.cast("int"),
        "is_exact_dollars": (last == 0).cast("int"), "is_99_cents": (last >= 990).cast("int"), "TransactionAmt_decimal": last / 1000,
    })


def coerce_schema(df: DataFrame, longs: set[str], strings: set[str]) -> DataFrame:
    """Named columns to long and string, all others to double; what does not parse is null."""
    kind = lambda c: "bigint" if c in longs else "string" if c in strings else "double"
    return df.select(*[F.col(c).try_cast(kind(c)).alias(c) for c in df.columns])


def finite(df: DataFrame) -> DataFrame:
    """Infinities and NaN become null in every floating-point column."""
    fix = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return df.select(*[fix(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def fill_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null ids become -1; whole numbers become ints row by row."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1)).try_cast("int") for c in columns})


def align_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The model's columns in its order; absent ones are null doubles."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in wanted])


def prefer_raw(df: DataFrame, names: list[str], raw_prefix: str = "raw_") -> DataFrame:
    """Each name's raw value if it has one, else the engineered one; the dashboard's projection."""
    def pick(c: str) -> Column:
        have = [F.col(x) for x in (raw_prefix + c, c) if x in df.columns]
        return (F.coalesce(*have) if have else F.lit(None)).alias(c)

    return df.select(*[pick(c) for c in names])


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renamed columns, the first of those that end up with one name; null scores become 0."""
    seen: dict[str, Column] = {}
    for c in df.columns:
        seen.setdefault(names.get(c, c), F.col(c))
    if "score" in seen:
        seen["score"] = F.coalesce(seen["score"].cast("double"), F.lit(0.0))
    return df.select(*[c.alias(n) for n, c in seen.items()])


def capitalised(c: Column) -> Column:
    """First letter upper, the rest lower; null and empty are ``Unknown``."""
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c)))))


def currency(c: Column) -> Column:
    """``$1.2M``, ``$3.4K`` or ``$5.67``."""
    a = F.abs(c)
    return F.when(a >= 1e6, F.format_string("$%.1fM", c / 1e6)).when(a >= 1e3, F.format_string("$%.1fK", c / 1e3)).otherwise(F.format_string("$%.2f", c))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def tier(p: Column, soft: float, hard: float) -> Column:
    """BLOCK from the hard threshold, REVIEW from the soft one, else APPROVE."""
    if not soft < hard:
        raise ValueError("the soft threshold has to lie below the hard one")
    return F.when(p >= hard, "BLOCK").when(p >= soft, "REVIEW").otherwise("APPROVE")


def band(c: Column, red: float, amber: float) -> Column:
    return F.when(c > red, "red").when(c > amber, "amber").otherwise("green")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
