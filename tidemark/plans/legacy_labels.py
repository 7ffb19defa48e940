"""The older labelled row: prices are closes, the exit target stands thirty minutes after the entry target, frames count bars.

News and bars are those of ``labels``. What the bars before an entry say depends on the entry bar alone and is taken once a bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, tails
from tidemark.plans.dialect import D, S
from tidemark.plans.labels import BACK, HORIZON, LAG, MINUTE, ZONES, minute_bars
from tidemark.session import load

DAY = 1440 * MINUTE
LEAST_BARS = 10
FRAMES = (
    [f"pre_vol_{n}" for n in (5, 10, 30, 60)] + [f"volume_ratio_{a}" for a in ("1_30", "2_30", "5_30", "10_60")] + [f"range_{n}m" for n in (5, 10, 30, 60)]
    + [f"close_position_{n}" for n in (10, 30, 60)] + ["entry_bar_ret", "entry_bar_range", "return_autocorr_30", "up_fraction_10", "up_fraction_30", "trend_slope_30", "trend_slope_60", "vwap_distance_30"]
)


def _local(q, us: str) -> str:
    return "CASE market " + " ".join(f"WHEN '{m}' THEN {q.local(q.back(us), z)}" for m, (z, _, _) in ZONES.items()) + " END"


def _bound(i: int) -> str:
    return "CASE market " + " ".join(f"WHEN '{m}' THEN {v[i]}" for m, v in ZONES.items()) + " END"


def place(news: DataFrame, bars: DataFrame) -> DataFrame:
    """``news`` (event_id, t, market) with status, entry and exit bars and their closes.

    ``bars``: (bt, close, ...), distinct times. Times are microseconds since 1970 in UTC. The ladder: OFF_HOURS, TOO_LATE (33 minutes
    before the close), BAR_MISSING, CROSSES_SESSION, BAD_PRICE, else PLACED. A bar more than a day after its target
    cannot lie on the event's local day and is told from a missing one by the time of the last bar. Null times are OFF_HOURS.
    """
    rows = news.withColumn("lt", F.expr(_local(S, "t"))).withColumn("entry_target", F.col("t") + LAG * 1_000_000)
    rows = rows.withColumn("exit_target", F.col("entry_target") + HORIZON * 1_000_000)
    find = dict(right_time="bt", value="close", tolerance=DAY, bucket=DAY)
    timed = rows.where("t IS NOT NULL")
    found = asof.asof_join(asof.asof_join(timed, bars, "entry_target", prefix="entry", **find), bars, "exit_target", prefix="exit", **find)
    found = found.unionByName(rows.where("t IS NULL"), allowMissingColumns=True)
    last = bars.agg(F.max("bt").alias("last_bar"))
    found = found.join(F.broadcast(last))  # one row
    for name, us in (("el", "entry_time"), ("xl", "exit_time")):
        found = found.withColumn(name, F.expr(f"CASE WHEN {us} IS NOT NULL THEN {_local(S, us)} END"))
    found = found.withColumn("s", F.expr(S.seconds("lt"))).withColumn("op", F.expr(_bound(1))).withColumn("cl", F.expr(_bound(2)))
    late = f"s + {LAG + HORIZON + 60} > cl"
    ladder = f"""CASE WHEN t IS NULL OR s < op OR s > cl THEN 'OFF_HOURS' WHEN {late} THEN 'TOO_LATE'
        WHEN entry_time IS NULL OR exit_time <= entry_time OR (exit_time IS NULL AND coalesce(exit_target > last_bar, true)) THEN 'BAR_MISSING'
        WHEN exit_time IS NULL OR {S.day('el')} <> {S.day('lt')} OR {S.day('xl')} <> {S.day('lt')} THEN 'CROSSES_SESSION'
        WHEN coalesce(entry_value, 0) <= 0 OR coalesce(exit_value, 0) <= 0 THEN 'BAD_PRICE' ELSE 'PLACED' END"""
    return found.withColumn("status", F.expr(ladder))


def label(news: DataFrame, bars: DataFrame) -> DataFrame:
    """A row for each of ``news``: status, and for OK rows (ten bars or more before the entry) the return, the label and the features."""
    rows = place(news, bars)
    placed = rows.where("status = 'PLACED'")
    targets = placed.select("event_id", F.col("entry_time").alias("et"), F.col("entry_value").alias("entry"), F.explode(F.array(*map(F.lit, BACK))).alias("m"), "entry_target")
    targets = targets.withColumn("at", F.col("entry_target") - F.col("m").cast("bigint") * MINUTE)
    seen = asof.asof_join(targets, bars, "at", "bt", "close", tolerance=DAY + 120 * MINUTE, bucket=2 * DAY, prefix="back")
    past = F.when((F.col("back_time") < F.col("et")) & (F.col("back_value") > 0), F.col("entry") / F.col("back_value") - 1)
    backs = seen.groupBy("event_id").agg(*[F.max(F.when(F.col("m") == m, past)).alias(f"pre_ret_{m}") for m in BACK])
    days = F.array(*[F.struct(F.lit(m).alias("market"), F.expr(S.day(S.local(S.back("bt"), z))).alias("day")) for m, (z, _, _) in ZONES.items()])
    opens = bars.select("bt", "open", F.explode(days).alias("d")).groupBy("d.market", "d.day").agg(F.min_by("open", "bt").alias("day_open"))
    framed = tails.bar_tails(bars).select(F.col("bt").alias("entry_time"), "n_pre", *FRAMES)
    full = rows.withColumn("day", F.expr(S.day("lt"))).join(framed, "entry_time", "left").join(backs, "event_id", "left").join(opens, ["market", "day"], "left")
    ok = (F.col("status") == "PLACED") & (F.col("n_pre") >= LEAST_BARS)
    entry = F.col("entry_value")
    out = {
        "fwd_ret_30m": F.col("exit_value") / entry - 1, "log_entry_price": F.ln(entry), "minutes_from_open": (F.col("s") - F.col("op")) / 60, "minutes_to_close": (F.col("cl") - F.col("s")) / 60,
        "intraday_ret_open": F.when(F.col("day_open") > 0, entry / F.col("day_open") - 1), **{c: F.col(c) for c in [*[f"pre_ret_{m}" for m in BACK], *FRAMES]},
    }
    status = F.when(F.col("status") != "PLACED", F.col("status")).when(ok, "OK").otherwise("NO_PREHISTORY")
    return full.select("event_id", "market", status.alias("status"), F.when(ok, F.col("exit_value") > entry).alias("up"), *[F.when(ok, F.round(c, 6)).alias(n) for n, c in out.items()])


def legacy_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = load(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.expr(S.us("ts")).alias("t"), F.when(F.col("user_id") % 2 == 0, "US").otherwise("KR").alias("market"))
    return label(news, minute_bars(spark, sf_dir))


def _sql() -> str:
    """The rule on one table of numbered bars; frames are windows over the whole series."""
    w = lambda n: f"OVER (ORDER BY bt ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    hi, lo = (lambda n: f"max(high) {w(n)}"), (lambda n: f"min(low) {w(n)}")
    f = {f"pre_vol_{n}": f"CASE WHEN n_pre - 1 >= {k} THEN stddev_samp(r) {w(n)} END" for n, k in ((5, 3), (10, 5), (30, 10), (60, 20))}
    f |= {f"volume_ratio_{a}_{b}": f"avg(volume) {w(a)} / greatest(avg(volume) {w(b)}, 1)" for a, b in ((1, 30), (2, 30), (5, 30), (10, 60))}
    f |= {f"range_{n}m": f"({hi(n)} - {lo(n)}) / nullif(close, 0)" for n in (5, 10, 30, 60)}
    f |= {f"close_position_{n}": f"CASE WHEN {hi(n)} > {lo(n)} THEN (close - {lo(n)}) / ({hi(n)} - {lo(n)}) WHEN {hi(n)} IS NOT NULL THEN 0.5 END" for n in (10, 30, 60)}
    f |= {f"up_fraction_{n}": f"CASE WHEN n_pre - 1 >= {k} THEN avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) {w(n)} END" for n, k in ((10, 5), (30, 10))}
    f["return_autocorr_30"] = f"CASE WHEN n_pre - 1 >= 10 AND stddev_samp(r) {w(29)} > 0 AND stddev_samp(pr) {w(29)} > 0 THEN corr(r, pr) {w(29)} END"
    f |= {f"trend_slope_{n}": f"CASE WHEN least({n}, n_pre) >= 5 AND min(close) {w(n)} > 0 THEN regr_slope(CASE WHEN close > 0 THEN ln(close) END, rn::DOUBLE) {w(n)} END" for n in (30, 60)}
    vwap = f"CASE WHEN sum(volume) {w(30)} > 0 THEN sum(close * volume) {w(30)} / sum(volume) {w(30)} ELSE avg(close) {w(30)} END"
    f["vwap_distance_30"] = f"CASE WHEN {vwap} > 0 THEN close / ({vwap}) - 1 END"
    f["entry_bar_ret"], f["entry_bar_range"] = "CASE WHEN open > 0 THEN close / open - 1 END", "CASE WHEN close > 0 THEN (high - low) / close END"
    ok = "status = 'PLACED' AND n_pre >= 10"
    days = " UNION ALL ".join(f"SELECT '{m}' AS market, {D.day(D.local(D.back('bt'), z))} AS day, arg_min(open, bt) AS day_open FROM b GROUP BY 2" for m, (z, _, _) in ZONES.items())
    columns = {"fwd_ret_30m": "x_close / entry - 1", "log_entry_price": "ln(entry)", "minutes_from_open": "(s - op) / 60.0", "minutes_to_close": "(cl - s) / 60.0", "intraday_ret_open": "CASE WHEN day_open > 0 THEN entry / day_open - 1 END"}
    columns |= {n: n for n in [*[f"pre_ret_{m}" for m in BACK], *f]}
    return f"""WITH b AS (SELECT CAST(floor(epoch_us(ts) / {MINUTE}) AS BIGINT) * {MINUTE} AS bt, arg_min(value, event_id) AS open, arg_max(value, event_id) AS close, max(value) AS high, min(value) AS low, count(*) AS volume FROM events WHERE event_type <> 'error' GROUP BY 1),
        c AS (SELECT *, row_number() OVER (ORDER BY bt) AS rn, close / nullif(lag(close) OVER (ORDER BY bt), 0) - 1 AS r FROM b), e AS (SELECT *, lag(r) OVER (ORDER BY bt) AS pr, least(125, rn - 1) AS n_pre FROM c),
        g AS (SELECT bt, n_pre, {', '.join(f'{x} AS {n}' for n, x in f.items())} FROM e),
        n AS (SELECT event_id, epoch_us(ts) AS t, CASE WHEN user_id % 2 = 0 THEN 'US' ELSE 'KR' END AS market FROM events WHERE event_type = 'error'),
        i AS (SELECT n.*, t + {LAG * 1_000_000} AS enter, t + {(LAG + HORIZON) * 1_000_000} AS leave FROM n),
        j AS (SELECT i.*, c.bt AS et, c.rn AS ei, c.close AS entry FROM i ASOF LEFT JOIN c ON i.enter <= c.bt), k AS (SELECT j.*, c.bt AS xt, c.rn AS xi, c.close AS x_close FROM j ASOF LEFT JOIN c ON j.leave <= c.bt),
        l AS (SELECT *, {_local(D, 't')} AS lt, {_local(D, 'et')} AS el, {_local(D, 'xt')} AS xl, {_bound(1)} AS op, {_bound(2)} AS cl FROM k),
        m AS (SELECT *, {D.seconds('lt')} AS s FROM l),
        p AS (SELECT *, CASE WHEN s < op OR s > cl THEN 'OFF_HOURS' WHEN s + 1980 > cl THEN 'TOO_LATE' WHEN ei IS NULL OR xi IS NULL OR xi <= ei THEN 'BAR_MISSING'
            WHEN CAST(el AS DATE) <> CAST(lt AS DATE) OR CAST(xl AS DATE) <> CAST(lt AS DATE) THEN 'CROSSES_SESSION' WHEN NOT (entry > 0 AND x_close > 0) THEN 'BAD_PRICE' ELSE 'PLACED' END AS status FROM m),
        v AS (SELECT p.event_id, o AS m, enter - CAST(o AS BIGINT) * {MINUTE} AS past, ei, entry FROM p, (SELECT unnest({list(BACK)}) AS o) WHERE status = 'PLACED'),
        y AS (SELECT v.event_id, {', '.join(f'max(CASE WHEN m = {o} AND c.rn < ei AND c.close > 0 THEN v.entry / c.close - 1 END) AS pre_ret_{o}' for o in BACK)} FROM v ASOF LEFT JOIN c ON v.past <= c.bt GROUP BY v.event_id),
        z AS ({days})
        SELECT p.event_id, p.market, CASE WHEN status <> 'PLACED' THEN status WHEN {ok} THEN 'OK' ELSE 'NO_PREHISTORY' END AS status, CASE WHEN {ok} THEN x_close > entry END AS up,
        {', '.join(f'CASE WHEN {ok} THEN round({x}, 6) END AS {n}' for n, x in columns.items())} FROM p LEFT JOIN g ON g.bt = et LEFT JOIN y ON y.event_id = p.event_id LEFT JOIN z ON z.market = p.market AND z.day = {D.day('lt')}"""


QUERIES = {"legacy_label_rows": legacy_label_rows}
ORACLES = {"legacy_label_rows": _sql()}
