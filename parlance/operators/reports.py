"""Nested-JSON documents to text reports (GEO-*, JN-5, ORD-4).

Documents are stored tables (the reference fetches them over HTTP): alerts per state with
``features: array<struct<properties: map<string,string>>>`` - a map, so an absent key and an
explicit null stay different - and point / forecast documents joined by key.

Documents come in two forms. In the nested form a document is a row with an array. In the long form
its features or periods are rows by document key and position, which is the form for large documents:
no plan then gathers a document's rows; a report takes its first few periods by a group limit, and an
alert report, whose text holds every alert by definition, is put together from finished pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.plans.ranges import first_k, joined_text, running

# ---- Fixed values (must equal the reference's strings) ----------------------------------------
ALERT_FIELDS = [("Event", "event", "Unknown"), ("Area", "areaDesc", "Unknown"),
                ("Severity", "severity", "Unknown"),
                ("Description", "description", "No description available"),
                ("Instructions", "instruction", "No specific instructions provided")]
ALERT_INDENT = " " * 8
PERIOD_INDENT = " " * 4
REPORT_SEPARATOR = "\n---\n"
NO_ALERTS_DOCUMENT = "Unable to fetch alerts or no alerts found."
EMPTY_ALERTS = "No active alerts for this state."
NO_POINT = "Unable to fetch forecast data for this location."
NO_FORECAST = "Unable to fetch detailed forecast."
PYTHON_NONE = "None"
PERIODS_SHOWN = 5
# -------------------------------------------------------------------------------------------------

PERIOD_DDL = ("struct<name:string,temperature:int,temperatureUnit:string,windSpeed:string,"
              "windDirection:string,detailedForecast:string>")


def _get(props: Column, key: str, default: str) -> Column:
    """``dict.get(key, default)`` rendered like an f-string: absent -> default, null -> None."""
    return F.when(F.map_contains_key(props, F.lit(key)),
                  F.coalesce(props[key], F.lit(PYTHON_NONE))).otherwise(F.lit(default))


def format_alert(props) -> Column:
    """GEO-1: one feature's five lines."""
    p = F.col(props) if isinstance(props, str) else props
    parts = [F.lit("\n")]
    for label, key, default in ALERT_FIELDS:
        parts += [F.lit(f"{ALERT_INDENT}{label}: "), _get(p, key, default), F.lit("\n")]
    parts.append(F.lit(ALERT_INDENT))
    return F.concat(*parts)


def alert_report(docs: DataFrame, key: str = "state", features: str = "features") -> Column:
    """GEO-2 as a column over a document row: formatted features joined by the separator;
    null features -> the no-document sentinel, empty list -> the no-alerts sentinel."""
    f = F.col(features)
    body = F.array_join(F.transform(f, lambda x: format_alert(x["properties"])), REPORT_SEPARATOR)
    return (F.when(f.isNull(), F.lit(NO_ALERTS_DOCUMENT))
            .when(F.size(f) == 0, F.lit(EMPTY_ALERTS)).otherwise(body))


def alert_reports(requests: DataFrame, docs: DataFrame, key: str = "state") -> DataFrame:
    """GEO-2: every requested ``key`` gets a report; a key without a document gets the
    no-document sentinel (left join, document side partitioned by key)."""
    d = docs.select(key, F.col("features"))
    return requests.join(d, key, "left").withColumn("report", alert_report(d, key)).drop("features")


def numbered_alerts(features: DataFrame, key: str = "state", order: str = "seq", props: str = "properties") -> DataFrame:
    """GEO-1, long form: ``(key, pos, alert)`` of every feature row; ``pos`` counts from 0 in ``order``, over
    sampled ranges, so a key with most features is spread."""
    one = features.select(key, order, F.lit(1).cast("long").alias("_one"), format_alert(props).alias("alert"))
    return running(one, [key], [order], {"_n": ("_one", "sum")}).select(key, (F.col("_n") - 1).cast("int").alias("pos"), "alert")


def alert_reports_long(requests: DataFrame, documents: DataFrame, features: DataFrame, key: str = "state",
                       order: str = "seq", props: str = "properties") -> DataFrame:
    """GEO-2, long form: ``documents(key, has_features)``, ``features(key, order, properties)``."""
    texts = joined_text(features.select(key, order, format_alert(props).alias("_a")), [key], [order], "_a", REPORT_SEPARATOR, "_body")
    j = requests.join(documents.select(key, F.col("has_features").alias("_has")), key, "left").join(texts, key, "left")
    has = F.coalesce("_has", F.lit(False))
    report = F.when(~has, F.lit(NO_ALERTS_DOCUMENT)).otherwise(F.coalesce("_body", F.lit(EMPTY_ALERTS)))
    return j.withColumn("report", report).drop("_has", "_body")


def format_period(p: Column) -> Column:
    """One forecast period (GEO-3); a null field reads ``None``."""
    i = PERIOD_INDENT
    f = lambda name: F.coalesce(p[name].cast("string"), F.lit(PYTHON_NONE))
    return F.concat(F.lit(f"\n{i}"), f("name"), F.lit(f":\n{i}Temperature: "), f("temperature"),
                    F.lit("°"), f("temperatureUnit"), F.lit(f"\n{i}Wind: "), f("windSpeed"), F.lit(" "),
                    f("windDirection"), F.lit(f"\n{i}Forecast: "), f("detailedForecast"), F.lit(f"\n{i}"))


def top_periods(periods, k: int = PERIODS_SHOWN) -> Column:
    """ORD-4: the first ``k`` periods."""
    p = F.col(periods) if isinstance(periods, str) else periods
    return F.slice(p, 1, k)


def point_forecast_lookup(requests: DataFrame, points: DataFrame, forecasts: DataFrame,
                          lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """JN-5: ``(lat, lon)`` -> grid point row -> its ``forecast`` key -> forecast document.
    Two chained left joins; adds ``forecast`` (the key), ``periods`` and ``lookup_status``
    (``no_point``, ``no_forecast``, ``ok``)."""
    pts = points.select(lat, lon, F.col("forecast"), F.lit(True).alias("_has_point"))
    fc = forecasts.select(F.col("forecast"), F.col("periods"), F.lit(True).alias("_has_fc"))
    j = requests.join(pts, [lat, lon], "left").join(fc, "forecast", "left")
    status = (F.when(F.col("_has_point").isNull(), "no_point")
              .when(F.col("_has_fc").isNull(), "no_forecast").otherwise("ok"))
    return j.withColumn("lookup_status", status).drop("_has_point", "_has_fc")


def forecast_report(looked_up: DataFrame) -> Column:
    """GEO-3: sentinel by lookup status, else the first five periods formatted and joined."""
    body = F.array_join(F.transform(top_periods("periods"), format_period), REPORT_SEPARATOR)
    s = F.col("lookup_status")
    return (F.when(s == "no_point", F.lit(NO_POINT)).when(s == "no_forecast", F.lit(NO_FORECAST))
            .otherwise(F.coalesce(body, F.lit(""))))


def period_counts(periods: DataFrame, key: str = "forecast") -> DataFrame:
    """Long form: ``(key, n_periods)`` of every document that has periods, by a partial count."""
    return periods.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_periods"))


def point_forecast_counts(requests: DataFrame, points: DataFrame, counts: DataFrame,
                          lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """JN-5, long form: adds ``forecast, n_periods, lookup_status``; ``counts(forecast, n_periods)`` has a row
    for each forecast document (0 for one without periods)."""
    pts = points.select(lat, lon, F.col("forecast"), F.lit(True).alias("_has_point"))
    j = requests.join(pts, [lat, lon], "left").join(counts.select("forecast", "n_periods"), "forecast", "left")
    status = (F.when(F.col("_has_point").isNull(), "no_point")
              .when(F.col("n_periods").isNull(), "no_forecast").otherwise("ok"))
    return j.withColumn("lookup_status", status).drop("_has_point")


def shown_periods(periods: DataFrame, order: list[str], text: Column, sep: str, key: str = "forecast",
                  k: int = PERIODS_SHOWN, out: str = "shown") -> DataFrame:
    """ORD-4, long form: ``(key, out)``: ``text`` of a document's first ``k`` periods, joined. A group limit
    goes before the list, so no list is longer than ``k``."""
    first = first_k(periods.select(key, *order, text.alias("_t")), [key], order, k)
    return (first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_rn", "_t"))).alias("_l"))
            .select(key, F.array_join(F.col("_l._t"), sep).alias(out)))


def forecast_reports(looked_up: DataFrame, periods: DataFrame, order: list[str], period: str = "period") -> DataFrame:
    """GEO-3, long form: ``looked_up`` (of ``point_forecast_counts``) with its ``report``."""
    body = shown_periods(periods, order, format_period(F.col(period)), REPORT_SEPARATOR, out="_body")
    s = F.col("lookup_status")
    report = (F.when(s == "no_point", F.lit(NO_POINT)).when(s == "no_forecast", F.lit(NO_FORECAST))
              .otherwise(F.coalesce("_body", F.lit(""))))
    return looked_up.join(body, "forecast", "left").withColumn("report", report).drop("_body")
