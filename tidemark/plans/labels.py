"""The labelled event row: entry, exit, the ladder of statuses and the features known at the entry.

Error events are the news, one-minute bars of all other events the prices. Entry and exit are the first bars at or
after their targets; features see only bars that have ended by the entry, of the local session of the event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.plans.dialect import S, statement
from tidemark.session import load

MINUTE = 60_000_000
#: Parameters of the contract, in seconds: entry lag, horizon, slippage of entry and exit, hold, staleness of a feature.
LAG, HORIZON, SLIP, HOLD, STALE = 120, 1800, 300, (1795, 2040), 300
CADENCE = 60
ZONES = {"US": ("America/New_York", 9 * 3600 + 30 * 60, 16 * 3600), "KR": ("Asia/Seoul", 9 * 3600, 15 * 3600 + 30 * 60)}
BACK = (1, 2, 3, 5, 10, 15, 20, 30, 45, 60, 90, 120)


def _news(q) -> str:
    return f"""n AS (SELECT event_id, {q.us('ts')} AS t, CASE WHEN user_id % 2 = 0 THEN 'US' ELSE 'KR' END AS market, user_id % 11 <> 0 AS eligible,
            CASE WHEN user_id % 13 = 0 THEN 300 ELSE {CADENCE} END AS cadence, CASE WHEN user_id % 17 = 0 THEN 'CLOSE' ELSE 'OPEN' END AS semantics FROM events WHERE event_type = 'error'),
        b AS (SELECT CAST(floor({q.us('ts')} / {MINUTE}) AS BIGINT) * {MINUTE} AS bt, {q.at_least('value', 'event_id')} AS open, {q.at_most('value', 'event_id')} AS close, max(value) AS high, min(value) AS low,
            count(*) AS volume FROM events WHERE event_type <> 'error' GROUP BY 1)"""


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("event_type <> 'error'")
    bt = (F.floor(F.expr(S.us("ts")) / MINUTE) * MINUTE).cast("bigint").alias("bt")
    return rows.groupBy(bt).agg(F.min_by("value", "event_id").alias("open"), F.max_by("value", "event_id").alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("volume"))


def placed_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News with the first bars at or after the entry target and, thirty minutes after the entry, the exit target."""
    bars = minute_bars(spark, sf_dir)
    news = load(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", (F.expr(S.us("ts")) + LAG * 1_000_000).alias("entry_target"))
    lookup = dict(right_time="bt", value="open", tolerance=1440 * MINUTE, bucket=1440 * MINUTE)
    entered = asof.asof_join(news, bars, "entry_target", prefix="entry", **lookup)
    entered = entered.withColumn("exit_target", F.col("entry_time") + HORIZON * 1_000_000)
    left = asof.asof_join(entered.where("entry_time IS NOT NULL"), bars, "exit_target", prefix="exit", **lookup)
    return left.unionByName(entered.where("entry_time IS NULL"), allowMissingColumns=True).select("event_id", F.col("entry_time").alias("et"), F.col("entry_value").alias("entry"), F.col("exit_time").alias("xt"), F.col("exit_value").alias("exit"))


def _ladder(q) -> str:
    zone = lambda c: "CASE market " + " ".join(f"WHEN '{m}' THEN {q.local(q.back(c), z)}" for m, (z, _, _) in ZONES.items()) + " END"
    bound = lambda i: "CASE market " + " ".join(f"WHEN '{m}' THEN {v[i]}" for m, v in ZONES.items()) + " END"
    if q.spark:
        placed = "p AS (SELECT n.*, et, entry, xt, exit FROM n JOIN placed_news w ON w.event_id = n.event_id)"
    else:
        far = lambda c, at: f"CASE WHEN bt - {at} <= {1440 * MINUTE} THEN {c} END"
        placed = f"""i AS (SELECT x.*, {far('bt', 'x.target')} AS et, {far('b.open', 'x.target')} AS entry FROM (SELECT *, t + {LAG * 1_000_000} AS target FROM n) x ASOF LEFT JOIN b ON x.target <= b.bt),
        p AS (SELECT y.*, {far('bt', 'y.leave')} AS xt, {far('b.open', 'y.leave')} AS exit FROM (SELECT *, coalesce(et, 9000000000000000) + {HORIZON * 1_000_000} AS leave FROM i) y ASOF LEFT JOIN b ON y.leave <= b.bt)"""
    return f"""{_news(q)}, {placed},
        l AS (SELECT *, {zone('t')} AS lt, {zone('et')} AS el, {zone('xt')} AS xl, {bound(1)} AS op, {bound(2)} AS cl FROM p),
        m AS (SELECT *, {q.seconds('lt')} AS ls, {q.seconds('el')} AS es, {q.seconds('xl')} AS xs, {q.day('lt')} AS ld FROM l),
        s AS (SELECT *, CASE WHEN NOT eligible THEN 'NOT_EXACT_PRICE_ELIGIBLE' WHEN cadence <= 0 OR cadence > {CADENCE} THEN 'PRICE_CADENCE_INELIGIBLE' WHEN semantics <> 'OPEN' THEN 'BAR_SEMANTICS_UNKNOWN'
            WHEN ls < op OR ls > cl THEN 'OFF_HOURS' WHEN et IS NULL THEN 'BAR_MISSING' WHEN et - t - {LAG * 1_000_000} > {SLIP * 1_000_000} THEN 'ENTRY_TIMING_MISS' WHEN xt IS NULL OR xt <= et THEN 'BAR_MISSING'
            WHEN xt - et - {HORIZON * 1_000_000} > {SLIP * 1_000_000} THEN 'EXIT_TIMING_MISS' WHEN xt - et < {HOLD[0] * 1_000_000} OR xt - et > {HOLD[1] * 1_000_000} THEN 'HOLD_TIMING_MISS'
            WHEN {q.day('el')} <> ld OR {q.day('xl')} <> ld OR es < op OR es > cl OR xs < op OR xs > cl THEN 'CROSSES_SESSION'
            WHEN coalesce(entry, 0) <= 0 OR coalesce(exit, 0) <= 0 THEN 'BAD_PRICE' ELSE 'PLACED' END AS status FROM m)"""


def label_rows(q) -> str:
    """One row for each news event: status, and for OK rows the return, the label and the features at the entry."""
    back = lambda m: f"{q.at_most('close', f'CASE WHEN be <= et - {m * MINUTE} AND et - {m * MINUTE} - be <= {STALE * 1_000_000} AND close > 0 THEN be END')}"
    inside = lambda m, c: f"CASE WHEN bt >= et - {m * MINUTE} THEN {c} END"
    moved = lambda m, c="r": f"CASE WHEN pt >= et - {m * MINUTE} THEN {c} END"
    volume = lambda m: f"avg({inside(m, 'volume')})"
    high, low = (lambda m: f"max({inside(m, 'high')})"), (lambda m: f"min({inside(m, 'low')})")
    columns = [f"entry / {back(m)} - 1 AS pre_ret_{m}" for m in BACK]
    columns += [f"stddev_samp({moved(m)}) AS pre_vol_{m}" for m in (5, 10, 30, 60)]
    columns += [f"{volume(a)} / greatest({volume(b)}, 1) AS volume_ratio_{a}_{b}" for a, b in ((1, 30), (2, 30), (5, 30), (10, 60))]
    columns += [f"({high(m)} - {low(m)}) / max(entry) AS range_{m}m" for m in (5, 10, 30, 60)]
    columns += [f"CASE WHEN {high(m)} > {low(m)} THEN (max(entry) - {low(m)}) / ({high(m)} - {low(m)}) WHEN {high(m)} IS NOT NULL THEN 0.5 END AS close_position_{m}" for m in (10, 30, 60)]
    columns += [
        f"{q.at_most('close', 'bt')} / nullif({q.at_most('open', 'bt')}, 0) - 1 AS entry_bar_ret",
        f"({q.at_most('high', 'bt')} - {q.at_most('low', 'bt')}) / nullif({q.at_most('close', 'bt')}, 0) AS entry_bar_range",
        f"max(entry) / nullif({q.at_least('open', 'bt')}, 0) - 1 AS intraday_ret_open",
        f"CASE WHEN count({moved(30)}) >= 3 THEN corr({moved(30)}, CASE WHEN ppt >= et - {30 * MINUTE} THEN pr END) END AS return_autocorr_30",
        *[f"avg({moved(m, 'CASE WHEN r > 0 THEN 1.0E0 ELSE 0.0E0 END')}) AS up_fraction_{m}" for m in (10, 30)],
        *[f"CASE WHEN count({inside(m, 'ln(nullif(greatest(close, 0), 0))')}) >= 5 THEN regr_slope({inside(m, 'ln(nullif(greatest(close, 0), 0))')}, {inside(m, f'(bt - et) / {MINUTE}.0E0')}) END AS trend_slope_{m}" for m in (30, 60)],
        f"max(entry) / coalesce(sum({inside(30, 'close * volume')}) / nullif(sum({inside(30, 'volume')}), 0), avg({inside(30, 'close')})) - 1 AS vwap_distance_30",
    ]
    columns = [c.replace("entry /", "max(entry) /", 1) if c.startswith("entry /") else c for c in columns]
    names = [c.rsplit(" AS ", 1)[1] for c in columns]
    days = " UNION ALL ".join(f"SELECT '{m}' AS market, {q.day(q.local(q.back('bt'), z))} AS ld, {q.seconds(q.local(q.back('bt'), z))} AS bs, b.* FROM b" for m, (z, _, _) in ZONES.items())
    # Moves between neighbouring bars of a session are the same for all its events: they are taken before events meet bars.
    opens = "CASE market " + " ".join(f"WHEN '{m}' THEN {v[1]}" for m, v in ZONES.items()) + " END"
    return f"""WITH {_ladder(q)}, d AS ({days}),
        g AS (SELECT * FROM d WHERE bs >= {opens}),
        r AS (SELECT *, lag(bt) OVER w AS pt, close / nullif(lag(close) OVER w, 0) - 1 AS r FROM g WINDOW w AS (PARTITION BY market, ld ORDER BY bt)),
        v AS (SELECT *, lag(pt) OVER w AS ppt, lag(r) OVER w AS pr FROM r WINDOW w AS (PARTITION BY market, ld ORDER BY bt)),
        u AS (SELECT s.event_id, s.et, s.entry, v.bt, v.bt + {CADENCE * 1_000_000} AS be, open, close, high, low, volume, pt, r, ppt, pr FROM s JOIN v ON v.market = s.market AND v.ld = s.ld
            WHERE s.status = 'PLACED' AND v.bt + {CADENCE * 1_000_000} <= s.et),
        f AS (SELECT event_id, count(*) AS n_bars, {', '.join(columns)} FROM u GROUP BY event_id)
        SELECT s.event_id, CASE WHEN status <> 'PLACED' THEN status WHEN coalesce(n_bars, 0) < 2 THEN 'NO_PREHISTORY' ELSE 'OK' END AS status, s.market,
        CASE WHEN n_bars >= 2 THEN (et - t - {LAG * 1_000_000}) / 1E6 END AS entry_slip_s, CASE WHEN n_bars >= 2 THEN (xt - et) / 1E6 END AS hold_s, CASE WHEN n_bars >= 2 THEN round(exit / entry - 1, 8) END AS fwd_ret,
        CASE WHEN n_bars >= 2 THEN exit > entry END AS up, CASE WHEN n_bars >= 2 THEN round(ln(entry), 8) END AS log_entry_price, CASE WHEN n_bars >= 2 THEN round((ls - op) / 60.0E0, 6) END AS minutes_from_open,
        CASE WHEN n_bars >= 2 THEN round((cl - ls) / 60.0E0, 6) END AS minutes_to_close, {', '.join(f'CASE WHEN n_bars >= 2 THEN round({n}, 6) END AS {n}' for n in names)} FROM s LEFT JOIN f ON f.event_id = s.event_id"""


def label_status(q) -> str:
    return f"WITH {_ladder(q)} SELECT market, status, count(*) AS n FROM s GROUP BY market, status"


def session_flags(q) -> str:
    """Local minutes from open and to close, and whether the event lies in the regular session of a weekday."""
    z = lambda c: "CASE market " + " ".join(f"WHEN '{m}' THEN {c.format(z=z, op=op, cl=cl)}" for m, (z, op, cl) in ZONES.items()) + " END"
    local = z(q.local("ts", "{z}"))
    last = "CASE market WHEN 'US' THEN 55620 ELSE 53820 END"  # 15:27 and 14:57, thirty-three minutes before the close
    return f"""WITH e AS (SELECT event_id, ts, CASE WHEN user_id % 2 = 0 THEN 'US' ELSE 'KR' END AS market FROM events), l AS (SELECT *, {local} AS lt FROM e),
        s AS (SELECT event_id, market, {q.seconds('lt')} AS ls, {q.day('lt')} AS ld, {z('{op}')} AS op, {z('{cl}')} AS cl, {last} AS last FROM l)
        SELECT event_id, round((ls - op) / 60.0E0, 6) AS minutes_from_open, round((cl - ls) / 60.0E0, 6) AS minutes_to_close, (ld + 3) % 7 < 5 AND ls >= op AND ls <= last AS regular FROM s"""


def model_frame(q) -> str:
    """Calendar and difference columns from an event's time and returns."""
    hour = "(hour(ts) + minute(ts) / 60.0E0)"
    return f"""WITH e AS (SELECT event_id, ts, user_id, value, lag(value, 1) OVER w AS v2, lag(value, 2) OVER w AS v5, lag(value, 3) OVER w AS v15, lag(value, 4) OVER w AS v30 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT event_id, ts, {', '.join(f'value / nullif(v{m}, 0) - 1 AS r{m}' for m in (2, 5, 15, 30))} FROM e)
        SELECT event_id, round({hour}, 8) AS event_hour, CAST(({q.day('ts')} + 3) % 7 AS BIGINT) AS weekday, CAST(month(ts) AS BIGINT) AS event_month, round(sin(2 * pi() * {hour} / 24), 8) + 0.0E0 AS hour_sin, round(cos(2 * pi() * {hour} / 24), 8) + 0.0E0 AS hour_cos,
        {', '.join(f'round(abs(r{m}), 6) AS abs_ret_{m}' for m in (2, 5, 15, 30))}, round(r2 - r15, 6) AS slope_2_15, round(r5 - r30, 6) AS slope_5_30 FROM r"""


PLANS = {"label_rows": label_rows, "label_status": label_status, "session_flags": session_flags, "model_frame": model_frame}
STATEMENTS = {name: statement(build, {"placed_news": placed_news}) for name, build in PLANS.items()}
QUERIES = {name: pair[0] for name, pair in STATEMENTS.items()}
ORACLES = {name: pair[1] for name, pair in STATEMENTS.items()}
