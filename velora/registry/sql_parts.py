"""DuckDB oracle texts: CTEs that rebuild each derived frame from the driver tables.

Each must produce the same rows as the Spark code in ``velora.sources`` and
``velora.plans``; they are written independently, in plain SQL.
"""

from __future__ import annotations

PI2 = "(2 * pi())"

COUNTS = """counts AS (
  SELECT 100056789 + user_id AS site_id, date_trunc('hour', ts) AS ts, count(*) AS hourly_count
  FROM events GROUP BY 1, 2
)"""

COUNTS_WIDE = """counts_wide AS (
  SELECT 100056789 + user_id AS site_id,
         date_trunc('hour', ts + to_days(CAST(event_id % 600 AS INTEGER))) AS ts, count(*) AS hourly_count
  FROM events GROUP BY 1, 2
)"""


def weather_raw(counts: str = "counts", name: str = "weather_raw") -> str:
    return f"""{name}_grid AS (
  SELECT time, date_diff('hour', t0, time) AS h FROM (
    SELECT t0, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS time
    FROM (SELECT min(ts) AS t0, max(ts) AS t1 FROM {counts})
  )
), {name}_base AS (
  SELECT time,
         CASE WHEN h % 41 = 0 THEN NULL ELSE greatest(CAST(h * 7 % 10 - 6 AS DOUBLE), 0.0) END AS rain,
         greatest(CAST(h * 11 % 50 - 47 AS DOUBLE), 0.0) AS snowfall,
         CAST(h * 13 % 30 AS DOUBLE) AS wind_speed_10m,
         CAST(h * 17 % 300 AS DOUBLE) / 10.0 - 5.0 AS apparent_temperature,
         0 AS ingest_seq, h
  FROM {name}_grid WHERE h % 37 <> 0
), {name} AS (
  SELECT time, rain, snowfall, wind_speed_10m, apparent_temperature, ingest_seq FROM {name}_base
  UNION ALL
  SELECT time, rain, snowfall, wind_speed_10m, apparent_temperature + 1.0, 1 FROM {name}_base WHERE h = 1
)"""


def weather_hourly(raw: str = "weather_raw", name: str = "weather") -> str:
    return f"""{name} AS (
  SELECT time AS ts, apparent_temperature,
         coalesce(rain > 0, false) AS is_rainy,
         coalesce(snowfall > 0, false) AS is_snowy,
         coalesce(wind_speed_10m > 15, false) AS is_windy
  FROM (SELECT *, row_number() OVER (PARTITION BY time ORDER BY ingest_seq DESC) AS rk FROM {raw}) WHERE rk = 1
)"""


def season_sql(ts: str) -> str:
    md = f"(month({ts}) * 100 + day({ts}))"
    return (
        f"CASE WHEN {md} >= 320 AND {md} < 621 THEN 'spring' "
        f"WHEN {md} >= 621 AND {md} < 922 THEN 'summer' "
        f"WHEN {md} >= 922 AND {md} < 1221 THEN 'autumn' ELSE 'winter' END"
    )


def night_sql(ts: str) -> str:
    h = f"(hour({ts}) + minute({ts}) / 60.0)"
    s = season_sql(ts)
    return (
        f"CASE {s} WHEN 'winter' THEN ({h} >= 17 OR {h} < 8) WHEN 'spring' THEN ({h} >= 20.5 OR {h} < 6) "
        f"WHEN 'summer' THEN ({h} >= 22 OR {h} < 5) WHEN 'autumn' THEN ({h} >= 19 OR {h} < 7) ELSE false END"
    )


def rush_sql(ts: str) -> str:
    return f"((hour({ts}) >= 7 AND hour({ts}) < 10) OR (hour({ts}) >= 17 AND hour({ts}) < 20))"


# The school holiday periods, [first day, day after the last).
HOLIDAYS = [
    ("2024-10-19", "2024-11-05"),
    ("2024-12-21", "2025-01-07"),
    ("2025-02-15", "2025-03-04"),
    ("2025-04-12", "2025-04-29"),
    ("2025-05-29", "2025-06-01"),
    ("2025-07-05", "2025-09-02"),
]


def holiday_sql(ts: str) -> str:
    parts = [f"({ts} >= TIMESTAMP '{a}' AND {ts} < TIMESTAMP '{b}')" for a, b in HOLIDAYS]
    return "(" + " OR ".join(parts) + ")"


def season_idx_sql(ts: str) -> str:
    return f"CASE {season_sql(ts)} WHEN 'winter' THEN 0.0 WHEN 'spring' THEN 1.0 WHEN 'summer' THEN 2.0 WHEN 'autumn' THEN 3.0 ELSE 0.0 END"


def cyclic_sql(ts: str) -> str:
    dow = f"CAST(isodow({ts}) - 1 AS DOUBLE)"
    mon = f"CAST(month({ts}) AS DOUBLE)"
    hr = f"CAST(hour({ts}) AS DOUBLE)"
    se = season_idx_sql(ts)
    out = []
    for name, x, n in (("dow", dow, 7.0), ("month", mon, 12.0), ("hour", hr, 24.0), ("season", se, 4.0)):
        out.append(f"sin({PI2} * ({x}) / {n}) AS {name}_sin")
        out.append(f"cos({PI2} * ({x}) / {n}) AS {name}_cos")
    return ", ".join(out)


def site_stats(counts: str = "counts", name: str = "stats", with_n: bool = False) -> str:
    n = "count(hourly_count) AS n, " if with_n else ""
    return f"""{name} AS (
  SELECT site_id, {n}CAST(avg(hourly_count) AS DOUBLE) AS site_mean, CAST(stddev_samp(hourly_count) AS DOUBLE) AS site_std,
         CAST(min(hourly_count) AS DOUBLE) AS site_min, CAST(max(hourly_count) AS DOUBLE) AS site_max
  FROM {counts} WHERE hourly_count IS NOT NULL GROUP BY site_id
)"""


def lagged(counts: str = "counts", name: str = "lagged") -> str:
    w = "PARTITION BY site_id ORDER BY ts, hourly_count"
    return f"""{name} AS (
  SELECT site_id, ts, hourly_count,
         CAST(lag(hourly_count, 1) OVER ({w}) AS DOUBLE) AS lag_1,
         CAST(lag(hourly_count, 24) OVER ({w}) AS DOUBLE) AS lag_24,
         CASE WHEN count(hourly_count) OVER ({w} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) = 24
              THEN avg(hourly_count) OVER ({w} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS rolling_mean_24
  FROM {counts}
)"""


def features(counts: str = "counts", name: str = "features") -> str:
    """Full chain: weather, stats, lags, calendar -> the 25-column table."""
    return ",\n".join(
        [
            weather_raw(counts, f"{name}_wraw"),
            weather_hourly(f"{name}_wraw", f"{name}_weather"),
            site_stats(counts, f"{name}_stats"),
            lagged(counts, f"{name}_lagged"),
            f"""{name} AS (
  SELECT l.site_id, l.hourly_count, l.ts,
         {holiday_sql('l.ts')} AS is_holiday, {rush_sql('l.ts')} AS is_rush_hour, {night_sql('l.ts')} AS is_night,
         w.apparent_temperature, w.is_rainy, w.is_windy, w.is_snowy,
         s.site_mean, s.site_std, s.site_min, s.site_max, l.lag_1, l.lag_24, l.rolling_mean_24,
         {cyclic_sql('l.ts')}
  FROM {name}_lagged l
  LEFT JOIN {name}_weather w ON l.ts = w.ts
  LEFT JOIN {name}_stats s ON l.site_id = s.site_id
  WHERE l.lag_1 IS NOT NULL AND l.lag_24 IS NOT NULL AND l.rolling_mean_24 IS NOT NULL
)""",
        ]
    )


def with_(*ctes: str) -> str:
    return ("WITH RECURSIVE " if any("_rec(" in c for c in ctes) else "WITH ") + ",\n".join(ctes) + "\n"


def round_all(inner: str, double_cols: list[str]) -> str:
    """Wrap a query so listed double columns are rounded to 6 places (+0.0 folds -0.0)."""
    if not double_cols:
        return inner
    rep = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) q"


def counts_raw(counts: str = "counts", name: str = "counts_raw") -> str:
    return f"""{name}_base AS (
  SELECT CASE WHEN hour(ts) = 5 AND day(ts) = 2 THEN NULL ELSE CAST(site_id AS VARCHAR) END AS site_id,
         'Site ' || CAST(site_id AS VARCHAR) AS site_name,
         CASE WHEN hour(ts) = 6 AND day(ts) = 3 THEN 'n/a' ELSE CAST(hourly_count AS VARCHAR) END AS hourly_count,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || '+01:00' AS ts,
         CASE WHEN site_id % 10 = 8 THEN NULL WHEN site_id % 10 = 7 THEN ''
              ELSE '48.8' || CAST(site_id % 10 AS VARCHAR) || ',2.3' || CAST(site_id % 7 AS VARCHAR) END AS coordinates,
         0 AS ingest_seq, (hour(ts) = 3 AND day(ts) = 1) AS rep
  FROM {counts}
), {name} AS (
  SELECT site_id, site_name, hourly_count, ts, coordinates, ingest_seq FROM {name}_base
  UNION ALL
  SELECT site_id, site_name, hourly_count, ts, coordinates, 1 FROM {name}_base WHERE rep
)"""


def raw_clean(raw: str = "counts_raw", name: str = "raw") -> str:
    """P3 + P4 + K12 on the landed text."""
    return f"""{name}_typed AS (
  SELECT CASE WHEN regexp_matches(site_id, '^[+-]?[0-9]+$') THEN TRY_CAST(site_id AS BIGINT)
              ELSE CAST(trunc(TRY_CAST(site_id AS DOUBLE)) AS BIGINT) END AS site_id, site_name,
         CASE WHEN regexp_matches(hourly_count, '^[+-]?[0-9]+$') THEN TRY_CAST(hourly_count AS BIGINT)
              ELSE CAST(trunc(TRY_CAST(hourly_count AS DOUBLE)) AS BIGINT) END AS hourly_count,
         TRY_CAST(substr(ts, 1, 19) AS TIMESTAMP) AS ts, coordinates, ingest_seq
  FROM {raw}
), {name} AS (
  SELECT site_id, site_name, hourly_count, ts, coordinates FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, ts ORDER BY ingest_seq) AS rk
    FROM {name}_typed WHERE site_id IS NOT NULL AND ts IS NOT NULL
  ) WHERE rk = 1
)"""


def sites(raw: str = "raw", name: str = "sites") -> str:
    """K6: site dimension from the raw table (latest row per id with coordinates)."""
    return f"""{name} AS (
  SELECT site_id, site_name,
         TRY_CAST(nullif(trim(split_part(coordinates, ',', 1)), '') AS DOUBLE) AS latitude,
         TRY_CAST(nullif(trim(split_part(coordinates, ',', 2)), '') AS DOUBLE) AS longitude
  FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC, site_name DESC, coordinates DESC) AS rk
    FROM {raw} WHERE coordinates IS NOT NULL
  ) WHERE rk = 1
)"""


def weather_forecast(counts: str = "counts", name: str = "wfc", horizon: int = 168) -> str:
    return f"""{name} AS (
  SELECT time,
         CASE WHEN h % 41 = 0 THEN NULL ELSE greatest(CAST(h * 7 % 10 - 6 AS DOUBLE), 0.0) END AS rain,
         greatest(CAST(h * 11 % 50 - 47 AS DOUBLE), 0.0) AS snowfall,
         CAST(h * 13 % 30 AS DOUBLE) AS wind_speed_10m,
         CAST(h * 17 % 300 AS DOUBLE) / 10.0 - 5.0 AS apparent_temperature
  FROM (
    SELECT time, date_diff('hour', t0, time) AS h, t1 FROM (
      SELECT t0, t1, unnest(generate_series(t0, t1 + to_hours({horizon}), INTERVAL 1 HOUR)) AS time
      FROM (SELECT min(ts) AS t0, max(ts) AS t1 FROM {counts})
    )
  ) WHERE h % 37 <> 0 AND time > t1
)"""


def future_features(counts: str = "counts", wfc: str = "wfc", name: str = "hf", horizon: int = 48) -> str:
    return f"""{name}_hours AS (
  SELECT unnest(generate_series(t1 + INTERVAL 1 HOUR, t1 + to_hours({horizon}), INTERVAL 1 HOUR)) AS ts
  FROM (SELECT max(ts) AS t1 FROM {counts})
), {name} AS (
  SELECT h.ts, {holiday_sql('h.ts')} AS is_holiday, {rush_sql('h.ts')} AS is_rush_hour, {night_sql('h.ts')} AS is_night,
         w.apparent_temperature,
         coalesce(w.rain, 0) > 0 AS is_rainy, coalesce(w.wind_speed_10m, 0) > 15 AS is_windy,
         coalesce(w.snowfall, 0) > 0 AS is_snowy,
         {cyclic_sql('h.ts')}
  FROM {name}_hours h LEFT JOIN {wfc} w ON w.time = h.ts
)"""


def history24(features: str = "features", counts: str = "counts", name: str = "hist", days: int = 30) -> str:
    return f"""{name} AS (
  SELECT site_id,
         CASE WHEN len(v) >= 24 THEN v
              ELSE list_transform(range(24 - len(v)), lambda i: round_even(list_sum(v) / len(v), 0)) || v END AS history
  FROM (
    SELECT site_id, list(CAST(hourly_count AS DOUBLE) ORDER BY ts) AS v FROM (
      SELECT f.site_id, f.ts, f.hourly_count,
             row_number() OVER (PARTITION BY f.site_id ORDER BY f.ts DESC) AS rk
      FROM {features} f, (SELECT max(ts) AS t1 FROM {counts}) b
      WHERE f.ts >= b.t1 - to_days({days}) AND f.ts <= b.t1
    ) WHERE rk <= 24 GROUP BY site_id
  )
)"""


def forecast_fold(hist: str = "hist", hf: str = "hf", name: str = "fc") -> str:
    """M8(a) with the fixed scorer, as a recursive CTE."""
    base = "0.1 + 1.0 * CAST(is_rush_hour AS DOUBLE) + -0.5 * hour_cos"
    return f"""{name}_steps AS (
  SELECT ts, row_number() OVER (ORDER BY ts) AS k, {base} AS base FROM {hf}
), {name}_rec(site_id, k, hist, ts, pred) AS (
  SELECT site_id, 0, history, CAST(NULL AS TIMESTAMP), CAST(NULL AS DOUBLE) FROM {hist}
  UNION ALL
  SELECT site_id, k, hist[2:] || [p], ts, p FROM (
    SELECT r.site_id, s.k, r.hist, s.ts,
           greatest(s.base + 0.5 * r.hist[24] + 0.3 * r.hist[1] + 0.2 * (list_sum(r.hist) / len(r.hist)), 0.0) AS p
    FROM {name}_rec r JOIN {name}_steps s ON s.k = r.k + 1
  )
), {name} AS (
  SELECT site_id, ts, pred AS hourly_count FROM {name}_rec WHERE k > 0
)"""


def forecast_chain() -> list[str]:
    """counts -> features -> history -> horizon -> forecast ``fc`` + raw/sites + ``geo``."""
    return [
        COUNTS,
        features(),
        weather_forecast(),
        future_features(),
        history24(),
        forecast_fold(),
        counts_raw(),
        raw_clean(),
        sites(),
        """geo AS (
  SELECT f.site_id, f.ts, f.hourly_count, s.site_name, s.latitude, s.longitude
  FROM fc f LEFT JOIN sites s ON f.site_id = s.site_id
)""",
    ]


def hist_ref(raw: str = "counts_wide", targets: str = "counts_wide", name: str = "href") -> str:
    """A16 by brute force: a range join per target."""
    labels = [
        "4-week mean (same weekday and hour)",
        "8-week mean (same weekday and hour)",
        "8-week mean (same hour)",
        "8-week mean (all hours)",
    ]
    same_wd = "isodow(r.ts) = isodow(t.ts) AND hour(r.ts) = hour(t.ts)"
    conds = [
        f"{same_wd} AND r.ts >= t.ts - to_days(28)",
        same_wd,
        "hour(r.ts) = hour(t.ts)",
        "true",
    ]
    cols = []
    for i, c in enumerate(conds, 1):
        cols.append(f"sum(CASE WHEN {c} THEN CAST(r.hourly_count AS DOUBLE) END) AS s{i}")
        cols.append(f"count(CASE WHEN {c} THEN r.hourly_count END) AS c{i}")
        cols.append(f"count(CASE WHEN {c} THEN 1 END) AS n{i}")
    ok = [f"(n{i} > 0 AND c{i} > 0)" for i in range(1, 5)]
    level = "CASE " + " ".join(f"WHEN {ok[i]} THEN {i + 1}" for i in range(4)) + " END"
    n = "CASE " + " ".join(f"WHEN {ok[i]} THEN n{i + 1}" for i in range(4)) + " END"
    val = "CASE " + " ".join(f"WHEN {ok[i]} THEN s{i + 1} / c{i + 1}" for i in range(4)) + " END"
    lab = "CASE " + " ".join(f"WHEN {ok[i]} THEN '{labels[i]}'" for i in range(4)) + " END"
    return f"""{name}_agg AS (
  SELECT t.site_id, t.ts, {", ".join(cols)}
  FROM (SELECT DISTINCT site_id, ts FROM {targets}) t
  JOIN {raw} r ON r.site_id = t.site_id AND r.ts BETWEEN t.ts - to_days(56) AND t.ts - INTERVAL 1 HOUR
  GROUP BY t.site_id, t.ts
), {name} AS (
  SELECT site_id, ts, {level} AS level, {lab} || ' (n=' || CAST({n} AS VARCHAR) || ')' AS label, {n} AS n, {val} AS reference
  FROM {name}_agg WHERE {level} IS NOT NULL
)"""
