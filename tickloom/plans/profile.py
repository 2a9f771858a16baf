"""Volume-profile queries. Bins of 5 price units fit the price scale of the derived bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.windows import by
from tickloom.operators import bars as br, daily as dl, intraday as it, levels as lv, profile as pf
from tickloom.plans.adapters import BAR, with_
from tickloom.plans.catalog import query
from tickloom.plans.intraday import VWAP, W_DAY
from tickloom.plans.levels import BRK, WIDE, leveled
from tickloom.plans.sqlkit import roll

S = 5.0
K = "symbol trading_day:d "
PROF = """
kb AS (SELECT symbol, trading_day, floor(close / 5) + o AS bin, volume * k AS w FROM bar, (VALUES (-1, 2), (0, 6), (1, 2)) v(o, k)),
prof AS (SELECT symbol, trading_day, bin, sum(w) AS w FROM kb GROUP BY 1, 2, 3)"""
DENSE = """
bd AS (SELECT symbol, trading_day, floor(floor(min(close) - 5) / 5) AS lo, ceil(ceil(max(close) + 5) / 5) - 1 AS hi FROM bar GROUP BY 1, 2),
dn AS (SELECT b.symbol, b.trading_day, b.lo, i AS bin, coalesce(p.w, 0) AS w FROM bd b, generate_series(0, 300) g(i) LEFT JOIN prof p ON p.symbol = b.symbol AND p.trading_day = b.trading_day AND p.bin = b.lo + i WHERE b.lo + i <= b.hi),
dv AS (SELECT symbol, trading_day, any_value(lo) AS lo, list(w ORDER BY bin) AS v FROM dn GROUP BY 1, 2)""".replace("FROM bd b, generate_series(0, 300) g(i) LEFT JOIN", "FROM bd b CROSS JOIN generate_series(0, 300) g(i) LEFT JOIN")
VA = """
va0 AS (SELECT symbol, trading_day, lo, v, list_sum(v) AS total, len(v) AS n, list_position(v, list_max(v)) AS pi FROM dv),
va1 AS (SELECT symbol, trading_day, lo, v, total, n, pi, pi AS a, pi AS z, v[pi] AS cum FROM va0 UNION ALL
 SELECT symbol, trading_day, lo, v, total, n, pi, CASE WHEN l >= r THEN a - 1 ELSE a END, CASE WHEN l >= r THEN z ELSE z + 1 END, cum + CASE WHEN l >= r THEN l ELSE r END
 FROM (SELECT *, CASE WHEN a > 1 THEN v[a - 1] ELSE -1 END AS l, CASE WHEN z < n THEN v[z + 1] ELSE -1 END AS r FROM va1 WHERE cum < .7::DOUBLE * total AND NOT (a = 1 AND z = n))),
va AS (SELECT symbol, trading_day, any_value(lo) AS lo, any_value(pi) - 1 AS pi, arg_max(a, z - a) - 1 AS a, arg_max(z, z - a) - 1 AS z FROM va1 GROUP BY 1, 2)"""
REC = lambda *c: with_(*c).replace("WITH ", "WITH RECURSIVE ", 1)


def day_profile(t):
    return pf.volume_by_price(t.bar(), S)


def day_dense(t):
    return pf.dense(day_profile(t), pf.grid_bounds(t.bar(), S))


@query("volume_by_price", K + "bin:i volume:f", with_(BAR, PROF) + "SELECT symbol, trading_day, bin, w / 10 AS volume FROM prof")
def _(t):
    return day_profile(t).withColumn("volume", F.col("w") / 10)


@query("bid_ask_profile", K + "bin:i bid:f ask:f", with_(BAR) + "SELECT symbol, trading_day, floor(close / 5) AS bin, sum(bidvolume) AS bid, sum(askvolume) AS ask FROM bar GROUP BY 1, 2, 3")
def _(t):
    return pf.bid_ask_profile(t.bar(), S)


@query("poc", K + "poc_bin:i total:f", with_(BAR, PROF) + "SELECT symbol, trading_day, first(bin ORDER BY w DESC, bin) AS poc_bin, sum(w) AS total FROM prof GROUP BY 1, 2")
def _(t):
    return pf.poc(day_profile(t))


@query("value_area_70", K + "poc_i:i va_lo_i:i va_hi_i:i", REC(BAR, PROF, DENSE, VA) + "SELECT symbol, trading_day, pi AS poc_i, a AS va_lo_i, z AS va_hi_i FROM va")
def _(t):
    return pf.value_area(day_dense(t))


SHAPE = """
sh0 AS (SELECT *, w / sum(w) OVER (PARTITION BY symbol, trading_day) AS p, (bin + .5) * 5 AS x FROM prof),
sh1 AS (SELECT *, sum(p * x) OVER (PARTITION BY symbol, trading_day) AS m FROM sh0),
shape AS (SELECT symbol, trading_day, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS entropy, coalesce(sum(p * (x - m) * (x - m) * (x - m)) / nullif(pow(sum(p * (x - m) * (x - m)), 1.5), 0), 0) AS skew FROM sh1 GROUP BY 1, 2)"""


@query("profile_entropy", K + "entropy:f", with_(BAR, PROF, SHAPE) + "SELECT symbol, trading_day, entropy FROM shape")
def _(t):
    return pf.profile_shape(day_profile(t), S)


@query("profile_skew", K + "skew:f", with_(BAR, PROF, SHAPE) + "SELECT symbol, trading_day, skew FROM shape")
def _(t):
    return pf.profile_shape(day_profile(t), S)


PEAKS = """
pk AS (SELECT p.symbol, p.trading_day, count(*) FILTER (p.w > coalesce(l.w, 0) AND p.w > coalesce(r.w, 0) AND p.w > .05 * t.t) AS n_peaks FROM prof p JOIN (SELECT symbol, trading_day, sum(w) AS t FROM prof GROUP BY 1, 2) t USING (symbol, trading_day)
 LEFT JOIN prof l ON l.symbol = p.symbol AND l.trading_day = p.trading_day AND l.bin = p.bin - 1 LEFT JOIN prof r ON r.symbol = p.symbol AND r.trading_day = p.trading_day AND r.bin = p.bin + 1 GROUP BY 1, 2)"""


@query("profile_peaks", K + "n_peaks:i", with_(BAR, PROF, PEAKS) + "SELECT * FROM pk")
def _(t):
    return pf.profile_peaks(day_profile(t))


@query("profile_prominent_peaks", K + "n_peaks_prominent:i peak_separation:f")
def _(t):
    return pf.prominent_peaks(day_dense(t))


@query("hvn_lvn_nodes", K + "n_hvn:i n_lvn:i")
def _(t):
    return pf.hvn_lvn_nodes(day_dense(t)).withColumns({"n_hvn": F.size("hvn"), "n_lvn": F.size("lvn")})


@query("profile_resample", K + "slot:i share:f", with_(BAR, PROF, DENSE) + """
, ac AS (SELECT symbol, trading_day, v[list_position(list_transform(v, lambda x: x > 0), true):len(v) - list_position(list_reverse(list_transform(v, lambda x: x > 0)), true) + 1] AS a FROM dv),
rs AS (SELECT symbol, trading_day, i, a, len(a) AS n, i * (len(a) - 1) / 19.0::DOUBLE AS x, least(floor(i * (len(a) - 1) / 19.0::DOUBLE), len(a) - 2)::INT AS k FROM ac, generate_series(0, 19) g(i)),
rv AS (SELECT symbol, trading_day, i, CASE WHEN n = 1 THEN (i = 10)::INT ELSE a[k + 1] + (a[k + 2] - a[k + 1]) * (x - k) END AS y FROM rs)
SELECT symbol, trading_day, i AS slot, y / sum(y) OVER (PARTITION BY symbol, trading_day) AS share FROM rv""")
def _(t):
    return pf.profile_resample(day_dense(t)).select("symbol", "trading_day", F.posexplode("resampled").alias("slot", "share"))


RUNP = """
rp0 AS (SELECT a.symbol, a.trading_day, a.dt, a.vwap AS lv, floor(b.close / 5) + o AS bin, sum(b.volume * k) AS w FROM vw a JOIN vw b ON a.symbol = b.symbol AND a.trading_day = b.trading_day AND b.bar_no <= a.bar_no CROSS JOIN (VALUES (-1, 2), (0, 6), (1, 2)) v(o, k) GROUP BY 1, 2, 3, 4, 5),
rb0 AS (SELECT symbol, trading_day, floor(floor(min(close) - 5) / 5) AS lo, ceil(ceil(max(close) + 5) / 5) - floor(floor(min(close) - 5) / 5) AS n FROM bar GROUP BY 1, 2),
rp AS (SELECT rp0.*, (bin + .5) * 5 AS c, lo, n, greatest(ceil((lv - 10) / 5 - .5) - lo, 0) AS ia, least(greatest(ceil((lv + 10) / 5 - .5) - lo + 1, 0), n) AS iz FROM rp0 JOIN rb0 USING (symbol, trading_day)),
rq AS (SELECT *, bin - lo >= ia AND bin - lo < iz AS near, row_number() OVER (PARTITION BY symbol, dt ORDER BY w DESC, bin) AS rd, row_number() OVER (PARTITION BY symbol, dt ORDER BY w, bin) AS ra, count(*) OVER (PARTITION BY symbol, dt) AS nnz FROM rp),
rn AS (SELECT symbol, dt, any_value(lv) AS lv, any_value(n) AS n, any_value(iz - ia) AS nb, sum(w) AS tot, sum(w * w) AS sq, coalesce(sum(w) FILTER (near), 0) AS s, min(abs(c - lv)) FILTER (rd <= greatest(1, ceil(.3::DOUBLE * nnz))) AS hvn, min(abs(c - lv)) FILTER (ra <= greatest(1, ceil(.2::DOUBLE * nnz))) AS lvn,
  first(c ORDER BY w DESC, bin) AS poc FROM rq GROUP BY 1, 2),
re AS (SELECT symbol, dt, -sum(p * ln(p)) AS ent, sum(p * (c - m) * (c - m) * (c - m)) AS m3, sum(p * (c - m) * (c - m)) AS m2 FROM (SELECT *, sum(p * c) OVER (PARTITION BY symbol, dt) AS m FROM (SELECT symbol, dt, c, w / sum(w) OVER (PARTITION BY symbol, dt) AS p FROM rq WHERE near)) GROUP BY 1, 2),
rf AS (SELECT a.symbol, a.dt, coalesce(sum(b.bidvolume) FILTER (floor(b.close / 5) - lo >= ia AND floor(b.close / 5) - lo < iz), 0) AS bl, coalesce(sum(b.askvolume) FILTER (floor(b.close / 5) - lo >= ia AND floor(b.close / 5) - lo < iz), 0) AS al
  FROM (SELECT DISTINCT symbol, trading_day, dt, lo, ia, iz FROM rp) a JOIN vw b ON a.symbol = b.symbol AND a.trading_day = b.trading_day AND b.dt <= a.dt GROUP BY 1, 2)"""


@query("profile_at_level", "symbol dt:t vol_at_level:f vol_at_level_pct:f vol_concentration_z:f vol_profile_entropy:f profile_skew_at_level:f poc_distance:f bid_vol_at_level:f ask_vol_at_level:f delta_at_level:f delta_at_level_z:f "
       "vol_into_level:f vol_at_rejection_bar:f vol_ratio_rejection:f delta_into_level:f delta_flip_at_level:i", with_(BAR, VWAP, RUNP) + f"""
, fl AS (SELECT symbol, dt, volume, coalesce(sum(volume) OVER i, 0) AS vi, volume / avg(volume) OVER w AS vr, coalesce(sum(bidvolume - askvolume) OVER i, 0) AS di, bidvolume - askvolume AS d FROM bar WINDOW {W_DAY}, i AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT symbol, dt, s / 10 AS vol_at_level, s / tot AS vol_at_level_pct, (s / greatest(nb, 1) - tot / n) / greatest(sqrt(sq / n - (tot / n) * (tot / n)), 1e-6) AS vol_concentration_z, coalesce(ent, 0) AS vol_profile_entropy,
 CASE WHEN nb > 2 AND m2 > 1e-18 THEN m3 / pow(m2, 1.5) ELSE 0 END AS profile_skew_at_level, abs(poc - lv) AS poc_distance, bl AS bid_vol_at_level, al AS ask_vol_at_level, bl - al AS delta_at_level, coalesce((bl - al) / nullif(bl + al, 0), 0) AS delta_at_level_z,
 vi AS vol_into_level, volume AS vol_at_rejection_bar, vr AS vol_ratio_rejection, di AS delta_into_level, (di * d < 0)::INT AS delta_flip_at_level FROM rn JOIN fl USING (symbol, dt) JOIN rf USING (symbol, dt) LEFT JOIN re USING (symbol, dt)""")
def _(t):
    return pf.profile_at_level(it.vwap_running(t.bar()), "vwap", S, 10.0, columns=[c for c in pf.RUNNING if c not in pf.SEARCHED])


@query("hvn_lvn_distance", "symbol dt:t nearest_hvn_dist:f nearest_lvn_dist:f", with_(BAR, VWAP, RUNP) + "SELECT symbol, dt, hvn AS nearest_hvn_dist, lvn AS nearest_lvn_dist FROM rn")
def _(t):
    return pf.running_profile(it.vwap_running(t.bar()), "vwap", S, 10.0, columns=["nearest_hvn_dist", "nearest_lvn_dist"])


RVA = """
rd AS (SELECT v.symbol, v.dt, v.vwap AS lv, b.lo, list(coalesce(p.w, 0)::DOUBLE ORDER BY i) AS v FROM vw v JOIN rb0 b USING (symbol, trading_day) CROSS JOIN generate_series(0, 300) g(i) LEFT JOIN rp0 p ON p.symbol = v.symbol AND p.dt = v.dt AND p.bin = b.lo + i WHERE i < b.n GROUP BY 1, 2, 3, 4),
rv0 AS (SELECT *, list_sum(v) AS total, len(v) AS n, list_position(v, list_max(v)) AS pi FROM rd),
rva AS (SELECT symbol, dt, lv, lo, v, total, n, pi, pi AS a, pi AS z, v[pi] AS cum FROM rv0 UNION ALL
 SELECT symbol, dt, lv, lo, v, total, n, pi, CASE WHEN l >= r THEN a - 1 ELSE a END, CASE WHEN l >= r THEN z ELSE z + 1 END, cum + CASE WHEN l >= r THEN l ELSE r END
 FROM (SELECT *, CASE WHEN a > 1 THEN v[a - 1] ELSE -1 END AS l, CASE WHEN z < n THEN v[z + 1] ELSE -1 END AS r FROM rva WHERE cum < .7::DOUBLE * total AND NOT (a = 1 AND z = n))),
rvf AS (SELECT symbol, dt, any_value(lv) AS lv, (any_value(lo + pi) - .5) * 5 AS poc, (arg_max(lo + a, z - a) - .5) * 5 AS lo_px, (arg_max(lo + z, z - a) - .5) * 5 AS hi_px FROM rva GROUP BY 1, 2)"""


@query("profile_va_contains", "symbol dt:t va_contains_level:i running_poc:f running_va_low:f running_va_high:f", REC(BAR, VWAP, RUNP, RVA) + "SELECT symbol, dt, (lv BETWEEN lo_px AND hi_px)::INT AS va_contains_level, poc AS running_poc, lo_px AS running_va_low, hi_px AS running_va_high FROM rvf")
def _(t):
    return pf.running_profile(it.vwap_running(t.bar()), "vwap", S, 10.0, columns=["va_contains_level", "running_poc", "running_va_low", "running_va_high"])


@query("composite_profile", K + "bin:i w:f", with_(BAR, PROF) + """
, c AS (SELECT symbol, trading_day, row_number() OVER (PARTITION BY symbol ORDER BY trading_day) AS n FROM (SELECT DISTINCT symbol, trading_day FROM bar))
SELECT a.symbol, a.trading_day, bin, sum(w) AS w FROM c a JOIN c b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 3 AND a.n - 1 JOIN prof p ON p.symbol = b.symbol AND p.trading_day = b.trading_day GROUP BY 1, 2, 3""")
def _(t):
    return pf.composite_profile(day_profile(t), 3)


@query("composite_at_level", "symbol dt:t composite_density:f level_is_hvn:i level_is_lvn:i composite_poc_dist:f", with_(BAR, VWAP, PROF) + """
, c AS (SELECT symbol, trading_day, row_number() OVER (PARTITION BY symbol ORDER BY trading_day) AS n FROM (SELECT DISTINCT symbol, trading_day FROM bar)),
cp AS (SELECT a.symbol, a.trading_day, bin, sum(w) AS w FROM c a JOIN c b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 3 AND a.n - 1 JOIN prof p ON p.symbol = b.symbol AND p.trading_day = b.trading_day GROUP BY 1, 2, 3),
st AS (SELECT symbol, trading_day, sum(w) AS t, quantile_cont(w, .7) FILTER (w > 0) AS p7, quantile_cont(w, .2) FILTER (w > 0) AS p2, first(bin ORDER BY w DESC, bin) AS pb FROM cp GROUP BY 1, 2)
SELECT v.symbol, dt, coalesce(w, 0) / greatest(t, 1e-6) AS composite_density, (coalesce(w, 0) >= p7)::INT AS level_is_hvn, (coalesce(w, 0) <= p2)::INT AS level_is_lvn, abs((pb + .5) * 5 - vwap) AS composite_poc_dist
FROM vw v JOIN st USING (symbol, trading_day) LEFT JOIN cp ON cp.symbol = v.symbol AND cp.trading_day = v.trading_day AND cp.bin = floor(vwap / 5)""")
def _(t):
    pts = it.vwap_running(t.bar()).withColumnRenamed("vwap", "level_price")
    return pf.composite_at_level(pts, pf.composite_profile(day_profile(t), 3), S)


FP = """
fp AS (SELECT b.symbol, b.dt, CASE WHEN t.ts >= b.dt THEN 'current' ELSE 'context' END AS part, greatest(least(floor((t.price - (b.vwap - 50)) / 5), 19), 0) AS price_bin, t.ts, seq, t.volume, t.bidvolume, t.askvolume FROM vw b JOIN tick t ON t.symbol = b.symbol AND t.ts >= b.dt - INTERVAL 45 MINUTES AND t.ts < b.dt + INTERVAL 15 MINUTES)"""


@query("footprint", "symbol dt:t part price_bin:i slot:i volume:f bidvolume:f askvolume:f delta:f", with_(BAR, VWAP, FP) + "SELECT symbol, dt, part, price_bin, row_number() OVER (PARTITION BY symbol, dt, part ORDER BY ts DESC, seq DESC) - 1 AS slot, volume, bidvolume, askvolume, bidvolume - askvolume AS delta FROM fp")
def _(t):
    s = it.vwap_running(t.bar()).select("symbol", "dt", F.col("vwap").alias("level_price"))
    return pf.footprint(s, t.tick(), 20, 50.0, 3, 15)


def heat_sql(col):
    return with_(BAR, VWAP) + f"""
, h AS (SELECT a.symbol, a.dt, a.vwap, b.close, b.volume, row_number() OVER (PARTITION BY a.symbol, a.dt ORDER BY b.bar_no) - 1 AS i, count(*) OVER (PARTITION BY a.symbol, a.dt) AS n FROM vw a JOIN vw b ON a.symbol = b.symbol AND a.trading_day = b.trading_day AND b.bar_no BETWEEN a.bar_no - 19 AND a.bar_no),
g AS (SELECT symbol, dt, greatest(least(floor((close - (vwap - 60)) / 12), 9), 0) AS row, {col} AS col, sum(volume) AS v FROM h GROUP BY 1, 2, 3, 4)
SELECT symbol, dt, row, col, v / sum(v) OVER (PARTITION BY symbol, dt) AS share FROM g"""


@query("vp_heatmap", "symbol dt:t row:i col:i share:f", heat_sql("20 - n + i"))
def _(t):
    b = it.vwap_running(t.bar())
    return pf.vp_heatmap(b.select("symbol", "trading_day", "dt", F.col("vwap").alias("level_price")), b, 60.0, 10, 20)


@query("vp_heatmap_binned", "symbol dt:t row:i col:i share:f", heat_sql("least(floor(i / greatest(floor(n / 5), 1)), 4)"))
def _(t):
    b = it.vwap_running(t.bar())
    return pf.vp_heatmap(b.select("symbol", "trading_day", "dt", F.col("vwap").alias("level_price")), b, 60.0, 10, 20, 5)


@query("level_second_features", "symbol dt:t level_sec_delta_at_touch:f level_sec_vol_at_touch:f level_sec_rejection_speed:f level_sec_time_at_level:i level_sec_retests:i level_sec_bid_ask_at_level:f level_sec_delta_before_touch:f level_sec_touch_vol_ratio:f",
       with_(BAR.replace("15 minutes", "240 minutes"), VWAP) + """
, t AS (SELECT t.symbol, v.dt, v.vwap, row_number() OVER (PARTITION BY t.symbol, v.dt ORDER BY t.ts, t.seq) AS i, count(*) OVER (PARTITION BY t.symbol, v.dt) AS n, t.price, t.volume, t.bidvolume AS b, t.askvolume AS a, abs(t.price - v.vwap) <= 15 AS hit FROM tick t JOIN vw v ON v.symbol = t.symbol AND v.dt = time_bucket(INTERVAL '240 minutes', t.ts)),
f AS (SELECT *, min(i) FILTER (hit) OVER (PARTITION BY symbol, dt) AS f, CASE WHEN hit THEN i - lag(i) OVER (PARTITION BY symbol, dt, hit ORDER BY i) END AS gap FROM t)
SELECT symbol, dt, coalesce(sum(b - a) FILTER (i BETWEEN f - 5 AND f + 4), 0) AS level_sec_delta_at_touch, coalesce(sum(volume) FILTER (i BETWEEN f - 5 AND f + 4), 0) AS level_sec_vol_at_touch,
 coalesce(CASE WHEN count(*) FILTER (i BETWEEN f AND f + 4) >= 2 THEN abs(arg_max(price, i) FILTER (i BETWEEN f AND f + 4) - arg_min(price, i) FILTER (i BETWEEN f AND f + 4)) / count(*) FILTER (i BETWEEN f AND f + 4) END, 0) AS level_sec_rejection_speed,
 count(*) FILTER (hit) AS level_sec_time_at_level, CASE WHEN any_value(f) IS NULL THEN 0 ELSE 1 + count(*) FILTER (gap > 3) END AS level_sec_retests, coalesce((sum(b - a) FILTER (hit)) / nullif(sum(b + a) FILTER (hit), 0), 0) AS level_sec_bid_ask_at_level,
 coalesce(sum(b - a) FILTER (i BETWEEN f - 10 AND f - 1), 0) AS level_sec_delta_before_touch, coalesce(avg(volume) FILTER (hit) / (sum(volume) / count(*)), 0) AS level_sec_touch_vol_ratio FROM f GROUP BY 1, 2""")
def _(t):

    b = it.vwap_running(br.with_session(br.build_bars(t.tick(), 240)))
    return pf.level_second_features(t.tick(), b.select("symbol", "dt", F.col("vwap").alias("level_price")), 15.0, 240)


SUMM = """
px AS (SELECT symbol, trading_day, arg_min(close, dt) AS open, arg_max(close, dt) AS close, max(high) AS high, min(low) AS low, greatest(max(close) - min(close), 1) AS day_range, min(close) AS mn, sum(volume) AS total_volume, sum(askvolume - bidvolume) AS cum_delta FROM bar GROUP BY 1, 2),
summ AS (SELECT px.*, (lo + pi + .5) * 5 AS poc, (lo + a + .5) * 5 AS va_low, (lo + z + .5) * 5 AS va_high, entropy, skew, n_peaks, ((lo + pi + .5) * 5 - mn) / day_range AS poc_rel, (z - a) * 5 / day_range AS va_width_rel, (close - open) / greatest(abs(open), 1) * 100 AS close_vs_open,
 cum_delta / greatest(total_volume, 1) AS cum_delta_rate, (close - mn) / day_range AS close_rel, abs(close - open) / day_range AS move_from_open, high - low AS range FROM px JOIN va USING (symbol, trading_day) JOIN shape USING (symbol, trading_day) JOIN pk USING (symbol, trading_day))"""
SUM = (BAR, PROF, DENSE, VA, SHAPE, PEAKS, SUMM)


@query("day_profile_summary", K + "open:f close:f poc:f va_low:f va_high:f range:f poc_rel:f va_width_rel:f entropy:f skew:f n_peaks:i close_vs_open:f cum_delta_rate:f", REC(*SUM) + "SELECT * FROM summ")
def _(t):
    return pf.day_profile_summary(t.bar(), S)


OTF = """
ox AS (SELECT symbol, trading_day, (high > max(high) OVER b)::INT AS u, (low < min(low) OVER b)::INT AS d FROM bar WINDOW b AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
otf AS (SELECT symbol, trading_day, coalesce(abs(sum(coalesce(u, 0)) - sum(coalesce(d, 0))) / nullif(sum(coalesce(u, 0)) + sum(coalesce(d, 0)), 0), 0) AS otf FROM ox GROUP BY 1, 2)"""


@query("day_type_binary", K + "otf_ratio:f trend_score:f day_type", REC(*SUM, OTF) + """
, sc AS (SELECT symbol, trading_day, otf AS otf_ratio, CASE WHEN va_width_rel < .45 THEN 2 WHEN va_width_rel < .55 THEN 1 ELSE 0 END + CASE WHEN poc_rel > .7 OR poc_rel < .3 THEN 2 WHEN poc_rel > .6 OR poc_rel < .4 THEN 1 ELSE 0 END
 + CASE WHEN close_rel > .75 OR close_rel < .25 THEN 1.5 WHEN close_rel > .65 OR close_rel < .35 THEN .5 ELSE 0 END + CASE WHEN otf > .7 THEN 2 WHEN otf > .5 THEN 1 ELSE 0 END + CASE WHEN move_from_open > .7 THEN 1.5 WHEN move_from_open > .5 THEN .75 ELSE 0 END
 + CASE WHEN (close_vs_open > .3 AND poc_rel > .6) OR (close_vs_open < -.3 AND poc_rel < .4) THEN 1.5 ELSE 0 END AS trend_score FROM summ JOIN otf USING (symbol, trading_day))
SELECT *, CASE WHEN trend_score >= 5 THEN 'Trend' ELSE 'Balance' END AS day_type FROM sc""")
def _(t):
    return pf.day_type_binary(pf.day_profile_summary(t.bar(), S).join(pf.otf_ratio(t.bar()), ["symbol", "trading_day"]))


@query("day_type_label", K + "day_type day_type_simple")
def _(t):
    return pf.day_type_label(pf.prominent_peaks(pf.day_profile_summary(t.bar(), S)))


@query("day_minute_features", "symbol dt:t price_vs_vwap:f vwap_deviation:f ret_5m:f ib_high_dist:f ib_low_dist:f range_ext_up:f range_ext_down:f vol_share:f cum_delta_rate:f otf_score:f otf_direction:f price_in_range:f dist_from_open:f momentum_5:f momentum_10:f "
       "acceleration:f or5_breakout:f or15_breakout:f range_expansion_rate:f vol_surge:f gap_pct:f open_vs_prior_poc:f open_vs_prior_va_high:f prior_day_range_pct:f open_in_prior_va:i gap_vs_prior_range:f", REC(*SUM) + f"""
, pr AS (SELECT symbol, trading_day, lag(close) OVER w AS pc, lag(poc) OVER w AS pp, lag(va_low) OVER w AS pl, lag(va_high) OVER w AS ph, lag(range) OVER w AS prg FROM summ WINDOW w AS (PARTITION BY symbol ORDER BY trading_day)),
m0 AS (SELECT *, bar_no - 1 AS t, count(*) OVER d AS n, max(high) OVER w AS hi, min(low) OVER w AS lo, first_value(close) OVER w AS o, sum(volume) OVER w AS cv, sum(close * volume) OVER w AS pv, sum(askvolume - bidvolume) OVER w AS dl, sum(volume) OVER d AS dv,
 max(high) FILTER (bar_no <= 5) OVER d AS h5, min(low) FILTER (bar_no <= 5) OVER d AS l5, max(high) FILTER (bar_no <= 15) OVER d AS h15, min(low) FILTER (bar_no <= 15) OVER d AS l15, max(high) FILTER (bar_no <= 20) OVER d AS ih, min(low) FILTER (bar_no <= 20) OVER d AS il,
 lag(close, 5) OVER q AS c5, lag(close, 10) OVER q AS c10 FROM bar WINDOW {W_DAY}, d AS (PARTITION BY symbol, trading_day), q AS (PARTITION BY symbol, trading_day ORDER BY dt)),
m1 AS (SELECT *, greatest(hi - lo, 1) AS rg, pv / greatest(cv, 1) AS vwap, coalesce((hi > lag(hi) OVER q)::INT, 0) AS u, coalesce((lo < lag(lo) OVER q)::INT, 0) AS dd FROM m0 WINDOW q AS (PARTITION BY symbol, trading_day ORDER BY dt)),
m2 AS (SELECT *, sum(u) OVER w AS nu, sum(dd) OVER w AS nd, lag(rg, 5) OVER (PARTITION BY symbol, trading_day ORDER BY dt) AS r5 FROM m1 WINDOW {W_DAY})
SELECT symbol, dt, (m2.close - vwap) / greatest(vwap, 1) * 100 AS price_vs_vwap, abs(m2.close - vwap) / rg AS vwap_deviation, coalesce(m2.close / nullif(c5, 0) - 1, 0) AS ret_5m, CASE WHEN t >= 20 THEN coalesce((m2.close - ih) / nullif(ih - il, 0), 0) ELSE 0 END AS ib_high_dist,
 CASE WHEN t >= 20 THEN coalesce((il - m2.close) / nullif(ih - il, 0), 0) ELSE 0 END AS ib_low_dist, CASE WHEN t >= 20 THEN coalesce(greatest(hi - ih, 0) / nullif(ih - il, 0), 0) ELSE 0 END AS range_ext_up, CASE WHEN t >= 20 THEN coalesce(greatest(il - lo, 0) / nullif(ih - il, 0), 0) ELSE 0 END AS range_ext_down,
 cv / greatest(dv, 1) AS vol_share, dl / greatest(cv, 1) AS cum_delta_rate, CASE WHEN t >= 5 THEN coalesce(abs(nu - nd) / nullif(nu + nd, 0), 0) ELSE 0 END AS otf_score, CASE WHEN t >= 5 THEN coalesce((nu - nd) / nullif(nu + nd, 0), 0) ELSE 0 END AS otf_direction,
 (m2.close - lo) / rg AS price_in_range, (m2.close - o) / rg AS dist_from_open, coalesce((m2.close - c5) / rg, 0) AS momentum_5, coalesce((m2.close - c10) / rg, 0) AS momentum_10, coalesce((m2.close - 2 * c5 + c10) / rg, 0) AS acceleration,
 CASE WHEN t >= 5 AND m2.close > h5 THEN coalesce((m2.close - h5) / nullif(h5 - l5, 0), 0) WHEN t >= 5 AND m2.close < l5 THEN coalesce((m2.close - l5) / nullif(h5 - l5, 0), 0) ELSE 0 END AS or5_breakout,
 CASE WHEN t >= 15 AND m2.close > h15 THEN coalesce((m2.close - h15) / nullif(h15 - l15, 0), 0) WHEN t >= 15 AND m2.close < l15 THEN coalesce((m2.close - l15) / nullif(h15 - l15, 0), 0) ELSE 0 END AS or15_breakout,
 coalesce((rg - r5) / r5, 0) AS range_expansion_rate, volume / greatest(cv / (t + 1), 1) AS vol_surge, coalesce((o - pc) / greatest(abs(pc), 1) * 100, 0) AS gap_pct, coalesce((o - pp) / nullif(prg, 0), 0) AS open_vs_prior_poc, coalesce((o - ph) / nullif(prg, 0), 0) AS open_vs_prior_va_high,
 CASE WHEN pc IS NULL THEN 0 ELSE prg / greatest(pc, 1) * 100 END AS prior_day_range_pct, coalesce((o BETWEEN pl AND ph)::INT, 0) AS open_in_prior_va, coalesce(abs(o - pc) / nullif(prg, 0), 0) AS gap_vs_prior_range FROM m2 JOIN pr USING (symbol, trading_day)""")
def _(t):
    s = pf.day_profile_summary(t.bar(), S)
    w = by(("symbol",), "trading_day")
    prior = s.select("symbol", "trading_day", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("close", "poc", "va_low", "va_high", "range")])
    return pf.day_minute_features(t.bar(), prior, ib=20, ranges=(5, 15))


@query("early_trend_score", "symbol dt:t early_trend_score:f")
def _(t):
    w = by(("symbol",), "trading_day")
    s = pf.day_profile_summary(t.bar(), S)
    prior = s.select("symbol", "trading_day", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("close", "poc", "va_low", "va_high", "range")])
    m = pf.day_minute_features(t.bar(), prior, ib=20, ranges=(5, 15))
    r = pf.running_profile(t.bar(), "close", S, 10.0, columns=["running_poc", "running_va_low", "running_va_high"]).drop("trading_day")
    lo = F.col("close") - F.col("price_in_range") * F.col("running_range")
    j = m.join(r, ["symbol", "dt"]).withColumns({"poc_rel": (F.col("running_poc") - lo) / F.col("running_range"), "va_width_rel": (F.col("running_va_high") - F.col("running_va_low")) / F.col("running_range")})
    return pf.early_trend_score(j)


@query("expected_volume_curve", "symbol dt:t cum_vol:f vol_rate:f", with_(BAR) + f"""
, c AS (SELECT symbol, trading_day, dt, minute, sum(volume) OVER w AS cum_vol FROM bar WINDOW {W_DAY}), e AS (SELECT symbol, minute, avg(cum_vol) AS ev FROM c WHERE trading_day < DATE '2024-01-16' GROUP BY 1, 2)
SELECT c.symbol, dt, cum_vol, coalesce(cum_vol / greatest(ev, 1), 1) AS vol_rate FROM c LEFT JOIN e USING (symbol, minute)""".replace("cum_vol / greatest(ev, 1), 1)", "cum_vol / CASE WHEN ev IS NOT NULL THEN greatest(ev, 1) END, 1)"))
def _(t):
    return pf.expected_volume_curve(t.bar(), F.col("trading_day") < F.lit("2024-01-16").cast("date"))


EVF = """
evt AS (SELECT DISTINCT symbol, dt, level, level_price FROM brk),
ev0 AS (SELECT e.symbol, e.dt, e.level, e.level_price, b.trading_day, floor(p.close / 5) + o AS bin, sum(p.volume * k) AS w FROM evt e JOIN bar b USING (symbol, dt) JOIN bar p ON p.symbol = b.symbol AND p.trading_day = b.trading_day AND p.bar_no <= b.bar_no CROSS JOIN (VALUES (-1, 2), (0, 6), (1, 2)) v(o, k) GROUP BY ALL),
eb AS (SELECT symbol, trading_day, floor(floor(min(close) - 5) / 5) AS lo, ceil(ceil(max(close) + 5) / 5) - floor(floor(min(close) - 5) / 5) AS n FROM bar GROUP BY 1, 2),
ev1 AS (SELECT ev0.*, bin - lo >= least(greatest(ceil((level_price - 10) / 5 - .5) - lo, 0), n - 1) AND bin - lo < least(greatest(ceil((level_price + 10) / 5 - .5) - lo + 1, 0), n) AS near FROM ev0 JOIN eb USING (symbol, trading_day))"""


@query("event_feature_lookup", "symbol dt:t level level_price:f vol_at_level:f vol_at_level_pct:f poc_distance:f", with_(*WIDE, BRK, EVF) + """
SELECT symbol, dt, level, level_price, coalesce(sum(w) FILTER (near), 0) / 10 AS vol_at_level, coalesce(sum(w) FILTER (near), 0) / sum(w) AS vol_at_level_pct, abs(first((bin + .5) * 5 ORDER BY w DESC, bin) - level_price) AS poc_distance FROM ev1 GROUP BY 1, 2, 3, 4""")
def _(t):
    ev = lv.breakout_triggers(leveled(t)).select("symbol", "dt", "level", "level_price").distinct()
    return pf.event_feature_lookup(ev, t.bar(), S, 10.0, columns=["vol_at_level", "vol_at_level_pct", "poc_distance"])


DVP = """
dk AS (SELECT symbol, trading_day, floor(close / 5) AS bin, sum(volume) * 10 AS w FROM bar GROUP BY 1, 2, 3),
dd AS (SELECT symbol, trading_day, max(high) AS h, min(low) AS l, count(*) AS n, arg_max(close, dt) AS close, CASE WHEN max(high) - min(low) < .01 THEN 1 ELSE max(high) - min(low) END AS rng, floor((floor(min(low)) - 1) / 5) AS lo, ceil((ceil(max(high)) + 1) / 5) - 1 AS hi FROM bar GROUP BY 1, 2)"""


@query("daily_vp_metrics", K + "vp_poc_rel:f vp_va_width_rel:f vp_skew:f vp_entropy:f vp_n_peaks:i", REC(BAR, DVP, SHAPE.replace("FROM prof", "FROM dk"), PEAKS.replace("prof ", "dk "),
       DENSE.replace("FROM bd b", "FROM dd b").replace("LEFT JOIN prof p", "LEFT JOIN dk p"), VA) + """
SELECT symbol, trading_day, CASE WHEN dd.n >= 5 THEN greatest(least(((va.lo + pi + .5) * 5 - l) / rng, 1), 0) ELSE .5 END AS vp_poc_rel, CASE WHEN dd.n >= 5 THEN greatest(least((z - a) * 5 / rng, 1), 0) ELSE 1 END AS vp_va_width_rel,
 CASE WHEN dd.n >= 5 THEN greatest(least(skew, 3), -3) ELSE 0 END AS vp_skew, CASE WHEN dd.n >= 5 THEN entropy ELSE 0 END AS vp_entropy, CASE WHEN dd.n >= 5 THEN n_peaks ELSE 1 END AS vp_n_peaks FROM dd JOIN va USING (symbol, trading_day) JOIN shape USING (symbol, trading_day) JOIN pk USING (symbol, trading_day)""")
def _(t):
    return pf.daily_vp_metrics(t.bar(), S)


@query("vp_evolution", "symbol day:d vp_poc_vs_close:f vp_poc_shift_5d:f vp_va_width_trend_5d:f vp_entropy_change_5d:f vp_va_width_10d_avg:f vp_n_peaks_5d_avg:f", with_(BAR) + f"""
, d AS (SELECT symbol, trading_day AS day, max(high) AS high, min(low) AS low, arg_max(close, dt) AS close, avg(close) / max(high) AS pr, stddev_pop(close) / max(high) AS vw, ln(sum(volume)) AS en, count(*) % 4 AS np FROM bar GROUP BY 1, 2)
SELECT symbol, day, coalesce((close - (low + pr * (high - low))) / nullif(high - low, 0), 0) AS vp_poc_vs_close, coalesce(pr - lag(pr, 5) OVER w, 0) AS vp_poc_shift_5d, coalesce(vw - lag(vw, 5) OVER w, 0) AS vp_va_width_trend_5d, coalesce(en - lag(en, 5) OVER w, 0) AS vp_entropy_change_5d,
 {roll('avg', 'vw', 10, 1)} AS vp_va_width_10d_avg, {roll('avg', 'np', 5, 1)} AS vp_n_peaks_5d_avg FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)""")
def _(t):
    d = t.bar().groupBy("symbol", F.col("trading_day").alias("day")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close"), (F.avg("close") / F.max("high")).alias("vp_poc_rel"), (F.stddev_pop("close") / F.max("high")).alias("vp_va_width_rel"),
        F.ln(F.sum("volume")).alias("vp_entropy"), (F.count(F.lit(1)) % 4).alias("vp_n_peaks"))
    return dl.vp_evolution(d)
