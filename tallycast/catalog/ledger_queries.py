"""Cleaning, series, horizons, calendars, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendars, fixed, roles, text
from ..operators import clean, decompose, forecast, frames, horizon, series
from ..sources import sinks
from .ledgers import (
    CUSTOMER,
    EVENT,
    GRID,
    INCOMPLETE,
    MONTHLY,
    PROFILE,
    SAFE,
    SEGMENT,
    SUPPLIER,
    customer_ledger,
    event_ledger,
    segment_ledger,
    supplier_ledger,
    table,
)

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


# --- Dirty text -----------------------------------------------------------------------------------------------------


def dirty_orders(spark, folder: str, month_first: bool = False) -> DataFrame:
    """All orders as text of several date styles and decimal commas, with some broken cells."""
    key = F.col("o_orderkey")
    style = F.pmod(key, F.lit(3))
    day = F.col("o_orderdate")
    iso, dmy, dashed = (F.date_format(day, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "d-M-yyyy"))
    styled = F.date_format(day, "MM/dd/yyyy") if month_first else F.when(style == 0, iso).when(style == 1, dmy).otherwise(dashed)
    amount = F.translate(F.format_number("o_totalprice", 2), ",.", " ,")
    return table(spark, folder, "orders").select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias(" Code_Ordonnateur "),
        F.when(F.pmod(key, F.lit(97)) == 0, "n/a").otherwise(styled).alias("DATE_REGLEMENT"),
        F.when(F.pmod(key, F.lit(89)) == 0, "12.5.0").otherwise(amount).alias("Montant_A_Regler"),
    )


def tagged_orders(spark, folder: str) -> DataFrame:
    raw = roles.normalise_header(dirty_orders(spark, folder))
    return clean.tag_rows(raw, roles.detect_roles(raw.columns, "split"), "day_first")


TRUTH = """CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderdate AS DATE) AS date,
       CAST(CAST(o_totalprice AS DECIMAL(20,4)) AS DOUBLE) AS amount"""


@query("clean_ledger", f"SELECT {TRUTH} FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0")
def clean_ledger(spark, folder):
    return clean.good_rows(tagged_orders(spark, folder)).withColumn("amount", F.col("amount").cast("double"))


@query("clean_month_first", f"SELECT {TRUTH} FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0")
def clean_month_first(spark, folder):
    raw = roles.normalise_header(dirty_orders(spark, folder, month_first=True))
    tagged = clean.tag_rows(raw, roles.detect_roles(raw.columns, "split"), "auto_day_first")
    return clean.good_rows(tagged).withColumn("amount", F.col("amount").cast("double"))


@query(
    "reject_ledger",
    """SELECT CAST(o_custkey AS VARCHAR) AS entity,
       CASE WHEN o_orderkey % 97 = 0 THEN 'bad date' ELSE 'bad amount' END AS reason, count(*) AS n_rows
       FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 GROUP BY 1, 2""",
)
def reject_ledger(spark, folder):
    rejected = clean.rejected_rows(tagged_orders(spark, folder))
    return rejected.groupBy("entity", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


# --- Series ---------------------------------------------------------------------------------------------------------


@query(
    "daily_entity_sum",
    f"WITH {SUPPLIER} SELECT entity, date, CAST(sum(amount) AS DOUBLE) AS amount FROM led GROUP BY 1, 2",
)
def daily_entity_sum(spark, folder):
    return series.daily_sum(supplier_ledger(spark, folder)).withColumn("amount", F.col("amount").cast("double"))


@query(
    "daily_filled",
    f"""WITH {SEGMENT}, days AS (
      SELECT entity, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
      FROM led GROUP BY entity
    ), sums AS (SELECT entity, date, sum(amount) AS amount FROM led GROUP BY 1, 2)
    SELECT d.entity, d.date, CAST(coalesce(s.amount, 0) AS DOUBLE) AS amount
    FROM days d LEFT JOIN sums s ON s.entity = d.entity AND s.date = d.date""",
)
def daily_filled(spark, folder):
    return series.daily_filled(segment_ledger(spark, folder)).withColumn("amount", F.col("amount").cast("double"))


@query("monthly_series", f"WITH {SUPPLIER}, {MONTHLY} SELECT entity, month, y FROM mon")
def monthly_series(spark, folder):
    return series.monthly_series(supplier_ledger(spark, folder))


@query("monthly_series_sparse", f"WITH {CUSTOMER}, {MONTHLY} SELECT entity, month, y FROM mon")
def monthly_series_sparse(spark, folder):
    return series.monthly_series(customer_ledger(spark, folder))


@query(
    "monthly_series_pooled",
    f"WITH {SUPPLIER.replace('CAST(l_suppkey AS VARCHAR)', chr(39) + 'ALL' + chr(39))}, {MONTHLY} "
    "SELECT entity, month, y FROM mon",
)
def monthly_series_pooled(spark, folder):
    return series.monthly_series(clean.pooled(supplier_ledger(spark, folder)))


POLICIES = {
    "keep": "false",
    "incomplete": INCOMPLETE,
    "always": "month = m1 AND m1 > m0",
    "unconditional": "month = m1",
}


@query(
    "trailing_month_policy",
    f"WITH {CUSTOMER}, {GRID} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS policy, entity, max(month) AS last_month, count(*) AS n_months FROM allmon "
        f"WHERE NOT ({rule}) GROUP BY entity"
        for name, rule in POLICIES.items()
    ),
)
def trailing_month_policy(spark, folder):
    ledger = customer_ledger(spark, folder)
    parts = [
        series.monthly_series(ledger, policy)
        .groupBy("entity")
        .agg(F.max("month").alias("last_month"), F.count(F.lit(1)).alias("n_months"))
        .withColumn("policy", F.lit(policy))
        for policy in POLICIES
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "series_profile",
    f"""WITH {CUSTOMER}, {MONTHLY}, {PROFILE}
    SELECT entity, n_months, active_months, round(density, 6) AS density, min_y, max_y, distinct_y,
           first_month, last_month, last_y FROM prof""",
)
def series_profile(spark, folder):
    rows = series.profile(series.monthly_series(customer_ledger(spark, folder)))
    return rows.withColumn("density", F.round("density", 6))


# --- Horizon --------------------------------------------------------------------------------------------------------


@query(
    "smart_duration",
    f"""WITH {CUSTOMER}, {MONTHLY}, {PROFILE}
    SELECT entity, n_months, active_months, {SAFE} AS safe_months, {SAFE} AS months,
           'MODE AUTO' || CASE WHEN density < 20 THEN ' - sparsity detected' ELSE '' END AS reason FROM prof""",
)
def smart_duration(spark, folder):
    rows = horizon.smart_duration(series.profile(series.monthly_series(customer_ledger(spark, folder))))
    return rows.select("entity", "n_months", "active_months", "safe_months", "months", "reason")


def asked_months(spark, folder: str) -> DataFrame:
    """A wish for most customers: a number, a skip, nothing, or no number at all."""
    kind = F.pmod("c_custkey", F.lit(7))
    months = F.when(kind == 0, "s").when(kind == 1, "").when(kind == 2, "many").when(kind == 3, "2").when(kind == 4, "12")
    wishes = table(spark, folder, "customer").filter(kind < 6)
    return wishes.select(F.col("c_custkey").cast("string").alias("entity"), months.otherwise("36").alias("months"))


@query(
    "horizon_requests",
    f"""WITH {CUSTOMER}, {MONTHLY}, {PROFILE}, wish AS (
      SELECT CAST(c_custkey AS VARCHAR) AS entity,
             CASE c_custkey % 7 WHEN 0 THEN 's' WHEN 1 THEN '' WHEN 2 THEN 'many' WHEN 3 THEN '2' WHEN 4 THEN '12'
             ELSE '36' END AS months
      FROM customer WHERE c_custkey % 7 < 6
    ), j AS (
      SELECT p.*, {SAFE} AS safe_months, w.months = 's' AS skip,
             CASE WHEN w.months IN ('s', '') THEN NULL ELSE w.months END AS asked,
             TRY_CAST(CASE WHEN w.months IN ('s', '') THEN NULL ELSE w.months END AS INTEGER) AS k
      FROM prof p LEFT JOIN wish w ON w.entity = p.entity
    )
    SELECT entity, CASE WHEN skip THEN 'skipped' ELSE 'ok' END AS status, safe_months,
      CASE WHEN k <= safe_months OR (k <= 24 AND k <= n_months) THEN k ELSE safe_months END AS months,
      CASE WHEN asked IS NULL THEN 'MODE AUTO' || CASE WHEN density < 20 THEN ' - sparsity detected' ELSE '' END
           WHEN k IS NULL THEN 'INVALID USER REQUEST (' || asked || ')'
           WHEN k <= safe_months THEN 'USER OVERRIDE (' || k || ' <= safe ' || safe_months || ')'
           WHEN k <= 24 AND k <= n_months THEN 'USER OVERRIDE (' || k || ')'
           ELSE 'USER REQUEST REDUCED (' || k || ' → ' || safe_months || ')' END AS reason
    FROM j""",
)
def horizon_requests(spark, folder):
    rows = series.profile(series.monthly_series(customer_ledger(spark, folder)))
    decided = horizon.with_requests(rows, asked_months(spark, folder))
    return decided.select("entity", "status", "safe_months", "months", "reason")


@query(
    "thin_series",
    f"""WITH {CUSTOMER} SELECT entity, count(*) AS ledger_rows,
      count(*) < 6 OR min(amount) = max(amount) AS thin FROM led GROUP BY 1""",
)
def thin_series(spark, folder):
    rows = series.monthly_series(customer_ledger(spark, folder), "keep", with_rows=True)
    one = rows.groupBy("entity").agg(F.max("ledger_rows").alias("ledger_rows"), F.max("ledger_constant").alias("constant"))
    return one.select("entity", "ledger_rows", horizon.too_thin(F.col("ledger_rows"), F.col("constant")).alias("thin"))


AHEAD = f"""ahead AS (
  SELECT p.*, h, CAST(last_month + to_months(CAST(h AS INTEGER)) AS DATE) AS month
  FROM (SELECT *, unnest(generate_series(1, {SAFE})) AS h FROM prof) p
)"""


@query(
    "naive_forecast",
    f"""WITH {CUSTOMER}, {MONTHLY}, {PROFILE}, {AHEAD}
    SELECT entity, h, month, last_y AS value, last_y AS lower, last_y AS upper FROM ahead""",
)
def naive_forecast(spark, folder):
    rows = horizon.smart_duration(series.profile(series.monthly_series(customer_ledger(spark, folder))))
    return forecast.naive_forecast(rows)


@query(
    "future_months",
    f"WITH {SUPPLIER}, {MONTHLY}, {PROFILE}, {AHEAD} SELECT entity, h, month FROM ahead",
)
def future_months(spark, folder):
    rows = horizon.smart_duration(series.profile(series.monthly_series(supplier_ledger(spark, folder))))
    months = calendars.future_months(F.col("last_month"), F.col("months"))
    return rows.select("entity", F.posexplode(months).alias("place", "month")).select(
        "entity", (F.col("place") + 1).alias("h"), "month"
    )


@query(
    "overlay",
    f"""WITH {CUSTOMER}, {MONTHLY}, {PROFILE}, {AHEAD}
    SELECT entity, 'history' AS kind, month, y AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM mon
    UNION ALL SELECT entity, 'forecast', month, last_y, last_y, last_y FROM ahead""",
)
def overlay(spark, folder):
    monthly = series.monthly_series(customer_ledger(spark, folder))
    return forecast.overlay(monthly, forecast.naive_forecast(horizon.smart_duration(series.profile(monthly))))


@query(
    "formatted_export",
    f"""WITH {CUSTOMER}, {MONTHLY}, {PROFILE}, {AHEAD}
    SELECT entity, strftime(month, '%Y-%m-%d') AS date, format('{{:,.2f}}', last_y) AS value_text, 'N/A' AS min_text,
           format('{{:,.2f}}', last_y) AS max_text FROM ahead""",
)
def formatted_export(spark, folder):
    rows = horizon.smart_duration(series.profile(series.monthly_series(customer_ledger(spark, folder))))
    naive = forecast.naive_forecast(rows).withColumn("lower", F.lit(None).cast("double"))
    return sinks.formatted_export(naive)


# --- Calendar -------------------------------------------------------------------------------------------------------

HOLIDAY_SQL = "hol AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in fixed.HOLIDAYS) + "]) AS holiday)"


@query(
    "business_day_spend",
    f"""WITH {EVENT}, {HOLIDAY_SQL}, days AS (SELECT date, sum(amount) AS amount FROM led GROUP BY 1)
    SELECT date, CAST(amount AS DOUBLE) AS amount, date IN (SELECT holiday FROM hol) AS is_holiday,
      isodow(date) < 6 AND date NOT IN (SELECT holiday FROM hol) AS is_business_day FROM days""",
)
def business_day_spend(spark, folder):
    days = event_ledger(spark, folder).groupBy("date").agg(F.sum("amount").cast("double").alias("amount"))
    return calendars.flag_business_days(days, calendars.holiday_table(spark))


@query(
    "business_days_only",
    f"""WITH {EVENT}, {HOLIDAY_SQL} SELECT entity, date, CAST(sum(amount) AS DOUBLE) AS amount FROM led
    WHERE isodow(date) < 6 AND date NOT IN (SELECT holiday FROM hol) GROUP BY 1, 2""",
)
def business_days_only(spark, folder):
    daily = series.daily_sum(event_ledger(spark, folder))
    kept = calendars.business_days_only(daily, calendars.holiday_table(spark))
    return kept.select("entity", "date", F.col("amount").cast("double").alias("amount"))


@query(
    "holidays_only",
    f"""WITH {EVENT}, {HOLIDAY_SQL} SELECT entity, date, CAST(sum(amount) AS DOUBLE) AS amount FROM led
    WHERE date IN (SELECT holiday FROM hol) GROUP BY 1, 2""",
)
def holidays_only(spark, folder):
    daily = series.daily_sum(event_ledger(spark, folder))
    kept = calendars.holidays_only(daily, calendars.holiday_table(spark))
    return kept.select("entity", "date", F.col("amount").cast("double").alias("amount"))


# --- Selection of entities ------------------------------------------------------------------------------------------

CODES = "5, 17,no-such-code,, 42, 5"


@query(
    "code_selection",
    f"""WITH {SUPPLIER}, {MONTHLY}, {PROFILE}, codes AS (
      SELECT entity, min(place) AS place FROM (
        SELECT trim(unnest(string_split('{CODES}', ','))) AS entity,
               generate_subscripts(string_split('{CODES}', ','), 1) - 1 AS place) WHERE entity <> '' GROUP BY 1)
    SELECT c.entity, c.place, CASE WHEN p.entity IS NULL THEN 'missing' ELSE 'ok' END AS status, n_months, last_month, last_y
    FROM codes c LEFT JOIN prof p ON p.entity = c.entity""",
)
def code_selection(spark, folder):
    codes = clean.code_list(spark, CODES)
    rows = series.profile(series.monthly_series(supplier_ledger(spark, folder)))
    picked = clean.select_codes(codes, rows)
    return picked.select("entity", "place", "status", "n_months", "last_month", "last_y")


@query(
    "one_code",
    f"""WITH {SUPPLIER} SELECT entity, date, CAST(sum(amount) AS DOUBLE) AS amount FROM led WHERE entity = '17' GROUP BY 1, 2""",
)
def one_code(spark, folder):
    daily = series.daily_sum(clean.one_code(supplier_ledger(spark, folder), "17"))
    return daily.withColumn("amount", F.col("amount").cast("double"))


@query("known_codes", f"WITH {CUSTOMER} SELECT DISTINCT entity FROM led ORDER BY entity LIMIT 10")
def known_codes(spark, folder):
    return clean.known_codes(customer_ledger(spark, folder))


@query(
    "first_entities",
    f"""WITH {SUPPLIER}, keys AS (SELECT DISTINCT entity FROM led ORDER BY entity LIMIT 20)
    SELECT entity, date, CAST(sum(amount) AS DOUBLE) AS amount FROM led
    WHERE entity IN (SELECT entity FROM keys) GROUP BY 1, 2""",
)
def first_entities(spark, folder):
    daily = series.daily_sum(clean.first_entities(supplier_ledger(spark, folder), 20))
    return daily.withColumn("amount", F.col("amount").cast("double"))


@query(
    "safe_keys",
    "SELECT c_custkey AS entity, regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g') AS entity_key FROM customer",
)
def safe_keys(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), text.safe_key(F.col("c_name")).alias("entity_key")
    )


# --- Decomposition and frames ---------------------------------------------------------------------------------------

DECOMPOSED = """tr AS (
  SELECT *, (t - 1) % 12 AS place, CASE WHEN n >= 24 AND t > 6 AND t <= n - 6 THEN
      (0.5 * lag(y, 6) OVER w
       + sum(y) OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
       + 0.5 * lead(y, 6) OVER w) / 12 END AS trend
  FROM ser WINDOW w AS (PARTITION BY entity ORDER BY month)
), pm AS (SELECT entity, place, avg(y - trend) AS place_mean FROM tr GROUP BY 1, 2
), gm AS (SELECT entity, avg(place_mean) AS mean FROM pm GROUP BY 1
), dec AS (
  SELECT tr.*, place_mean - mean AS seasonal, y - trend - (place_mean - mean) AS residual
  FROM tr JOIN pm ON pm.entity = tr.entity AND pm.place = tr.place JOIN gm ON gm.entity = tr.entity
)"""


@query(
    "decompose",
    f"""WITH {SUPPLIER}, {MONTHLY}, {DECOMPOSED} SELECT entity, month, y, round(trend, 6) AS trend,
    round(seasonal, 6) AS seasonal, round(residual, 6) AS residual FROM dec""",
)
def decomposition(spark, folder):
    parts = decompose.decompose(series.monthly_series(supplier_ledger(spark, folder)))
    rounded = [F.round(c, 6).alias(c) for c in ("trend", "seasonal", "residual")]
    return parts.select("entity", "month", "y", *rounded)


@query(
    "seasonality_flag",
    f"""WITH {SUPPLIER}, {MONTHLY}, {DECOMPOSED}, a AS (
      SELECT entity, count(*) AS n_months, max(seasonal) - min(seasonal) AS sa, max(y) - min(y) AS ta FROM dec GROUP BY 1)
    SELECT entity, n_months, round(sa, 6) AS season_amplitude, ta AS total_amplitude,
      coalesce(sa > 0.2 * ta, false) AS seasonal, coalesce(sa > 0.1 * ta, false) AS seasonal_classic FROM a""",
)
def seasonality_flag(spark, folder):
    flags = decompose.seasonality(series.monthly_series(supplier_ledger(spark, folder)))
    classic = decompose.is_seasonal(F.col("season_amplitude"), F.col("total_amplitude"), fixed.SEASONAL_SHARE_CLASSIC)
    return flags.withColumn("seasonal_classic", classic).withColumn("season_amplitude", F.round("season_amplitude", 6))


@query(
    "differences",
    f"""WITH {SUPPLIER}, {MONTHLY}, d AS (
      SELECT *, lag(y) OVER w AS lag_1, lag(y, 12) OVER w AS lag_12 FROM ser WINDOW w AS (PARTITION BY entity ORDER BY month))
    SELECT entity, month, y, lag_1, lag_12, y - lag_1 AS diff_1, y - lag_12 AS diff_12,
      (y - lag_12) - lag(y - lag_12) OVER (PARTITION BY entity ORDER BY month) AS diff_1_12 FROM d""",
)
def differences(spark, folder):
    return frames.differences(series.monthly_series(supplier_ledger(spark, folder)))


SCALED = """sc AS (
  SELECT *, CASE WHEN hi > lo THEN (y - lo) / (hi - lo) ELSE 0 END AS scaled FROM (
    SELECT *, min(y) OVER (PARTITION BY entity) AS lo, max(y) OVER (PARTITION BY entity) AS hi FROM ser)
)"""


@query(
    "minmax_scaled",
    f"WITH {CUSTOMER}, {MONTHLY}, {SCALED} SELECT entity, month, y, round(scaled, 9) AS scaled FROM sc",
)
def minmax_scaled(spark, folder):
    rows = frames.minmax_scaled(series.monthly_series(customer_ledger(spark, folder)))
    return rows.withColumn("scaled", F.round("scaled", 9))


@query(
    "lookback_frames",
    f"""WITH {SUPPLIER}, {MONTHLY}, {SCALED}, f AS (
      SELECT *, avg(scaled) OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS frame_mean,
             lag(scaled, 12) OVER (PARTITION BY entity ORDER BY month) AS frame_first FROM sc)
    SELECT entity, month, t - 12 AS frame_no, round(frame_mean, 8) AS frame_mean, round(frame_first, 8) AS frame_first,
      12 AS frame_size, round(scaled, 8) AS target,
      CASE WHEN t - 12 <= floor((n - 12) * 0.8) THEN 'train' ELSE 'validate' END AS part
    FROM f WHERE n >= 24 AND t > 12""",
)
def lookback_frames(spark, folder):
    rows = frames.lookback_frames(series.monthly_series(supplier_ledger(spark, folder)))
    total = F.aggregate("frame", F.lit(0.0), lambda acc, v: acc + v)
    return rows.select(
        "entity",
        "month",
        "frame_no",
        F.round(total / F.size("frame"), 8).alias("frame_mean"),
        F.round(F.element_at("frame", 1), 8).alias("frame_first"),
        F.size("frame").alias("frame_size"),
        F.round("target", 8).alias("target"),
        "part",
    )


@query(
    "chrono_split",
    f"""WITH {SUPPLIER}, {MONTHLY} SELECT entity, month, t, n AS n_months,
    CASE WHEN t > n - 12 THEN 'test' ELSE 'train' END AS part FROM ser""",
)
def chrono_split(spark, folder):
    rows = frames.hold_out(series.monthly_series(supplier_ledger(spark, folder)))
    return rows.select("entity", "month", "t", "n_months", "part")
