"""Queries of sources and of feature preparation, and their SQL. Pages and payloads are made from the bars, so parsing must give them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import features as X
from ..operators import ml as L
from ..sources import pages as S
from .q_features import PARTS, SQL
from .q_market import c
from .testbed import BARS, MS, bars, ms, rounded, sql_rounded, table

OHLCV = ("open", "high", "low", "close", "volume")


def parse_history_pages(spark, sf):
    b = bars(spark, sf)
    cell = lambda n: F.concat(F.lit("<td>"), F.when((n == "close") & (F.dayofmonth("ts") == 13), "n/a").otherwise(F.format_number(n, 4)), F.lit("</td>"))
    row = F.concat(F.lit('<tr><td data-order="'), F.unix_seconds("ts").cast("string"), F.lit('">day</td>'), *[cell(n) for n in OHLCV], F.lit("</tr>"))
    html = b.groupBy("symbol").agg(F.concat(F.lit("<table>\n"), F.concat_ws("\n", F.collect_list(row)), F.lit("</table>")).alias("html"))
    return rounded(S.parse_history_pages(html), "symbol", ms(), digits=4, **c(*OHLCV))


def parse_quote_pages(spark, sf):
    s = table(spark, sf, "supplier")
    row = F.concat(F.lit("<tr><td> s"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "-sep").otherwise(""), F.lit(" </td><td>"), F.format_number(F.abs("s_acctbal"), 2), F.lit("</td><td>"), F.when(F.col("s_suppkey") % 5 == 0, "-").otherwise("1,000"), F.lit("</td></tr>"))
    html = s.groupBy(F.col("s_nationkey").cast("long").alias("page_id")).agg(F.concat_ws("", F.collect_list(F.concat(row, row))).alias("html"))
    return rounded(S.parse_quote_pages(html), "page_id", "symbol", digits=2, **c("close", "volume"))


def normalize_vendor_json(spark, sf):
    b = bars(spark, sf)
    k = F.dayofmonth("ts") % 3
    t = F.unix_millis("ts")
    item = F.struct(F.when(k == 0, t).alias("timestamp"), F.when(k == 1, t).alias("time"), F.when(k == 2, t).alias("date"), F.when(k != 1, F.col("open")).alias("open"), "high", "low", F.when(k == 0, F.col("close")).alias("close"), F.when(k == 1, F.col("close")).alias("last"), F.when(k == 2, F.when(F.dayofmonth("ts") == 14, 0.0).otherwise(F.col("close"))).alias("price"), F.when(k != 2, F.col("volume")).alias("volume"))
    p = b.groupBy("symbol").agg(F.to_json(F.collect_list(item)).alias("payload"))
    return rounded(S.normalize_vendor_json(p), "symbol", ms(), digits=4, **c(*OHLCV))


def normalize_chart_json(spark, sf):
    b = bars(spark, sf).withColumn("volume", F.when(F.dayofmonth("ts") % 7 == 0, 0.0).otherwise(F.col("volume")))
    one = lambda n: F.transform(F.col("rows"), lambda r: r[n]).alias(n)
    g = b.groupBy("symbol").agg(F.collect_list(F.struct(F.unix_seconds("ts").alias("timestamp"), *OHLCV)).alias("rows"))
    p = g.select("symbol", F.to_json(F.struct(*[one(n) for n in ("timestamp", *OHLCV)])).alias("payload"))
    return rounded(S.normalize_chart_json(p), "symbol", ms(), digits=4, **c(*OHLCV))


def write_audit(spark, sf):
    """The counts that an audit run writes."""
    b = bars(spark, sf)
    i = b.withColumn("idx", F.row_number().over(C.by_time()) - 1).withColumn("close", F.when(F.col("idx") % 50 == 7, F.lit(None)).otherwise(F.col("close")))
    ok = S.finite(F.col("close"))
    return i.groupBy("symbol").agg(F.count("*").alias("fetched"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.lit("official").alias("source"))


def catalyst_events(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    kinds = F.array(*map(F.lit, ("THE", "TH", "S.", "E-", "DER")))
    symbols = table(spark, sf, "nation").select(kinds[(F.col("n_nationkey") % 5).cast("int")].alias("symbol"))
    e = C.catalyst_events(d, symbols, ["ANTION", "OUEA"], ["ERTI", "UNG"])
    return e.select("doc_id", "symbol", F.col("at").cast("long").alias("at"), "direction", "excerpt")


NAMES = ["ret_mean_5", "rsi_14", "hl_spread", "volume_z_20", "ema_20"]


def long(spark, sf):
    b = bars(spark, sf)
    f = X.compute_features(b, ["ret_mean_std_w", "rsi_14", "hl_spread", "z_scores_20", "ema_w"]).where("idx >= 20")
    return L.unpivot(f.join(L.targets(b).select("symbol", "ts", "y"), ["symbol", "ts"]), NAMES, ("symbol", "ts", "y"))


_E = {"ret_mean_5": SQL["ret_mean_std_w"]["ret_mean_5"], "rsi_14": "rsi", "hl_spread": "(high - low) / close", "volume_z_20": SQL["z_scores_20"]["volume_z_20"], "ema_20": SQL["ema_w"]["ema_20"]}
LONG = PARTS + f""",
y0 as (select symbol, ts, idx, {', '.join(f'{e} as f_{n}' for n, e in _E.items())}, case when count(ret) over w = 5 then sum(ret) over w end as y from p window w as (partition by symbol order by ts rows between 1 following and 5 following)),
lo as (select symbol, ts, y, unnest([{', '.join(f"{{'name': '{n}', 'x': f_{n}}}" for n in _E)}], recursive := true) from y0 where y is not null and idx >= 20)"""


def normalize_standard(spark, sf):
    return rounded(L.normalize_standard(long(spark, sf)), "symbol", ms(), "name", **c("z"))


def normalize_robust(spark, sf):
    return rounded(L.normalize_robust(long(spark, sf)), "symbol", ms(), "name", **c("z"))


def select_f_regression(spark, sf):
    return rounded(L.select_f_regression(long(spark, sf)), "symbol", "name", **c("score"))


def select_mutual_info(spark, sf):
    return rounded(L.select_mutual_info(long(spark, sf)), "symbol", "name", **c("score"))


def top_features(spark, sf):
    return rounded(L.top_features(L.select_f_regression(long(spark, sf)), 2), "symbol", "name", F.col("rank").cast("long").alias("rank"), **c("score"))


def ml_dataset(spark, sf):
    """A hundred bars of three features before each bar (their sum, the oldest and the newest value), and the three targets after it."""
    d = L.ml_dataset(bars(spark, sf), ["ret", "rsi_14", "hl_spread"], kind=("return", "direction", "volatility")).withColumnRenamed("return", "y")
    x = F.col("features")
    return rounded(d, "symbol", ms(), F.size(x).cast("long").alias("width"), total=F.aggregate(x, F.lit(0.0), lambda s, v: s + v), oldest=F.element_at(x, 1), newest=F.element_at(x, -1), **c("y", "direction", "volatility"))


QUERIES = {f.__name__: f for f in (parse_history_pages, parse_quote_pages, normalize_vendor_json, normalize_chart_json, write_audit, catalyst_events, normalize_standard, normalize_robust, select_f_regression, select_mutual_info, top_features, ml_dataset)}

FR = "select symbol, name, corr(x, y) ** 2 * (count(*) - 2) / (1 - corr(x, y) ** 2) as score from lo group by 1, 2"
ORACLES = {
    "parse_history_pages": f"with {BARS} select symbol, {MS}, {sql_rounded({n: n for n in OHLCV}, 4)} from bars where day(ts) <> 13",
    "parse_quote_pages": "select s_nationkey::bigint as page_id, 'S' || s_suppkey as symbol, round(abs(s_acctbal), 2) + 0.0 as close, 1000.0::double as volume from supplier where s_suppkey % 5 <> 0",
    "normalize_vendor_json": f"with {BARS} select symbol, {MS}, {sql_rounded({'open': 'case when day(ts) % 3 = 1 then close else open end', 'high': 'high', 'low': 'low', 'close': 'close', 'volume': 'case when day(ts) % 3 = 2 then 0 else volume end'}, 4)} from bars where day(ts) <> 14",
    "normalize_chart_json": f"with {BARS} select symbol, {MS}, {sql_rounded({n: n for n in OHLCV}, 4)} from bars where day(ts) % 7 <> 0",
    "write_audit": f"with {BARS}, i as (select symbol, (row_number() over (partition by symbol order by ts) - 1) % 50 = 7 as bad from bars) select symbol, count(*) as fetched, count(*) filter (not bad) as accepted, count(*) filter (bad) as rejected, 'official' as source from i group by 1",
    "catalyst_events": """with c as (select doc_id, replace(replace(upper(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))), 'ß', 'SS'), 'ẞ', 'SS') as t from documents),
        h as (select doc_id, s as symbol, instr(t, s) as pos, t from c, (values ('THE'), ('TH'), ('S.'), ('E-'), ('DER')) v(s)),
        x as (select doc_id, symbol, pos, substr(t, greatest(pos - 250, 1), pos + 1500 - greatest(pos - 250, 1)) as excerpt from h where pos > 0)
        select doc_id, symbol, pos as "at", case when regexp_matches(excerpt, 'ANTION|OUEA') then 'POSITIVE' when regexp_matches(excerpt, 'ERTI|UNG') then 'NEGATIVE' else 'NEUTRAL' end as direction, excerpt from x""",
    "normalize_standard": f"with {LONG} select symbol, {MS}, name, {sql_rounded({'z': 'coalesce((x - avg(x) over (partition by symbol, name)) / nullif(stddev_samp(x) over (partition by symbol, name), 0), 0)'})} from lo",
    "normalize_robust": f"""with {LONG}, k as (select *, row_number() over (partition by symbol, name order by x) - 1 as nth, count(*) over (partition by symbol, name) as n from lo),
        q as (select symbol, name, max(case when nth = floor(n * 0.25) then x end) as q1, max(case when nth = floor(n * 0.5) then x end) as q2, max(case when nth = floor(n * 0.75) then x end) as q3 from k group by 1, 2)
        select k.symbol, {MS}, k.name, {sql_rounded({'z': 'coalesce((x - q2) / nullif(q3 - q1, 0), 0)'})} from k join q using (symbol, name)""",
    "select_f_regression": f"with {LONG}, s as ({FR}) select symbol, name, {sql_rounded({'score': 'score'})} from s",
    "top_features": f"with {LONG}, s as ({FR}), t as (select *, row_number() over (partition by symbol order by score desc, name) as rank from s) select symbol, name, rank, {sql_rounded({'score': 'score'})} from t where rank <= 2",
    "select_mutual_info": f"""with {LONG}, b as (select symbol, name, least(9, floor((x - min(x) over w) / (max(x) over w - min(x) over w) * 10)) as bx, least(9, floor((y - min(y) over w) / (max(y) over w - min(y) over w) * 10)) as byy from lo window w as (partition by symbol, name)),
        n as (select symbol, name, bx, byy, count(*) as n from b group by all), m as (select *, sum(n) over (partition by symbol, name) as t, sum(n) over (partition by symbol, name, bx) as nx, sum(n) over (partition by symbol, name, byy) as ny from n)
        select symbol, name, {sql_rounded({'score': 'sum(n / t * ln(n * t / (nx * ny)))'})} from m group by 1, 2""",
    "ml_dataset": f"""with {PARTS}, z0 as (select symbol, ts, idx, ret, coalesce(rsi, 0) as rsi, (high - low) / close as hl, count(*) over (partition by symbol) as bars_, count(ret) over w as n, sum(ret) over w as y, stddev_samp(ret) over w as vol from p where idx >= 1
            window w as (partition by symbol order by ts rows between 1 following and 5 following)),
        z as (select *, sum(ret + rsi + hl) over (partition by symbol order by ts rows between 100 preceding and 1 preceding) as total, lag(ret, 100) over (partition by symbol order by ts) as oldest, lag(hl, 1) over (partition by symbol order by ts) as newest from z0)
        select symbol, {MS}, 300::bigint as width, {sql_rounded({'total': 'total', 'oldest': 'oldest', 'newest': 'newest', 'y': 'y', 'direction': '(y > 0)::int', 'volatility': 'vol'})} from z where idx >= 101 and n = 5 and bars_ >= 109""",
}
