"""Recurrences over whole series as scans over blocks.

A series is cut into blocks of ``BLOCK`` rows by exact positions and a block becomes one row
that holds its rows in order. Its summary is the map from the state before it to the state
after it, so blocks are summarised independently; only the summaries of a series meet (one per
``BLOCK`` rows), and then every block is unrolled from its own start state. All of it is
built-in array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.windows import by, safe_div
from tickloom.operators.blocks import join_keys, with_position

BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def in_blocks(placed: DataFrame, keys, at: str, columns, block_rows: int = BLOCK, also=()) -> DataFrame:
    """One row per block: its keys, ``block`` and ``rows``, structs of ``columns`` in order of
    the position column ``at``; ``also`` are further aggregates."""
    rows = F.sort_array(F.collect_list(F.struct(at, *[c for c in columns if c != at and c not in keys])))
    return placed.groupBy(*keys, F.floor(F.col(at) / block_rows).alias("block")).agg(rows.alias("rows"), *also)


def with_start(blocks: DataFrame, keys, first: Column, summary: Column, apply) -> DataFrame:
    """Adds ``start``, the state before each block. ``first`` is an aggregate giving the state
    before the series and ``apply(state, summary)`` the state after a block."""
    keys = list(keys)
    series = blocks.withColumn("_map", summary).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "_map"))).alias("_maps"), first.alias("_first"))
    seen = F.aggregate(
        "_maps", F.struct(F.col("_first").alias("state"), F.transform(F.slice("_maps", 1, 0), lambda m: F.struct(m["block"].alias("_at"), F.col("_first").alias("start"))).alias("out")),
        lambda a, m: F.struct(apply(a["state"], m["_map"]).alias("state"), F.concat(a["out"], F.array(F.struct(m["block"].alias("_at"), a["state"].alias("start")))).alias("out")),
        lambda a: a["out"])
    starts = series.select(*keys, F.inline(seen)).withColumnRenamed("_at", "block")
    return join_keys(blocks, starts, [*keys, "block"])


def unroll(rows, start: Column, none: Column, step, emit) -> Column:
    """Array of what ``emit(state after the row, state before it, row)``, itself an array, gives
    for each row. ``none`` is an empty array of that type."""
    return F.aggregate(
        rows, F.struct(start.alias("state"), none.alias("out")),
        lambda a, r: let(step(a["state"], r), lambda s: F.struct(s.alias("state"), F.concat(a["out"], emit(s, a["state"], r)).alias("out"))),
        lambda a: a["out"])


def after(rows, i: Column, state: Column, step) -> Column:
    """State at the end of the block when ``state`` holds after its ``i``-th row (from 1)."""
    return F.aggregate(F.slice(rows, i + 1, F.size(rows)), state, step)


# --- y = a * y + b -------------------------------------------------------------------------------

def affine(df: DataFrame, keys, at: str, factor: str, terms: dict[str, str], block_rows: int = BLOCK) -> DataFrame:
    """Adds, for each ``out: b``, the recurrence y = factor * y + b from 0 on; a null b adds
    nothing. ``at`` is the row's exact position in its series."""
    outs = list(terms)
    blocks = in_blocks(df, keys, at, df.columns, block_rows)
    zero = F.struct(*[F.lit(0.0).alias(o) for o in outs])

    def step(s, r):
        return F.struct(*[(s[o] * r[factor] + F.coalesce(r[b], F.lit(0.0))).alias(o) for o, b in terms.items()])

    gain = F.aggregate("rows", F.lit(1.0), lambda g, r: g * r[factor])
    summary = F.struct(gain.alias("gain"), F.aggregate("rows", zero, step).alias("own"))
    started = with_start(blocks, keys, F.first(zero), summary, lambda s, m: F.struct(*[(s[o] * m["gain"] + m["own"][o]).alias(o) for o in outs]))
    none = F.transform(F.slice("rows", 1, 0), lambda r: F.struct(r.alias("row"), F.col("start").alias("y")))
    done = unroll("rows", F.col("start"), none, step, lambda s, _, r: F.array(F.struct(r.alias("row"), s.alias("y"))))
    return started.select(*keys, F.inline(done)).select(*keys, "row.*", "y.*")


# --- two-sided sums that start again above a limit ---------------------------------------------------

def resetting_sums(df: DataFrame, keys, at: str, z: str, drift: float, reset: float, block_rows: int = BLOCK) -> DataFrame:
    """Adds ``up`` and ``down``: up = max(0, up + z - drift), down = max(0, down - z - drift), both
    0 again after a row on which one is above ``reset``. Rows without z show 0 and change nothing.

    Without a reset a block maps up to max(own, up + sum), where own is its result from 0. From a
    higher start the first reset comes earlier: only at rows whose sum so far is a new maximum,
    each with the start above which it resets. After a reset all starts agree, so the block's map
    is that short list with the end state behind each entry.
    """
    blocks = in_blocks(df, keys, at, df.columns, block_rows)
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def moved(s, r):
        return F.struct(F.greatest(F.lit(0.0), s["up"] + r[z] - drift).alias("up"), F.greatest(F.lit(0.0), s["down"] - r[z] - drift).alias("down"))

    def step(s, r):
        return F.when(r[z].isNull(), s).otherwise(let(moved(s, r), lambda n: F.when(F.greatest(n["up"], n["down"]) > reset, zero).otherwise(n)))

    none = F.array().cast("array<struct<at:int,level:double>>")
    begin = F.struct(F.lit(0).alias("i"), zero.alias("own"), zero.alias("sum"), zero.alias("top"), none.alias("ups"), none.alias("downs"), F.lit(None).cast("int").alias("hit"))

    def scan(a, r):
        skip = r[z].isNull() | a["hit"].isNotNull()
        sums = F.struct((a["sum"]["up"] + r[z] - drift).alias("up"), (a["sum"]["down"] - r[z] - drift).alias("down"))

        def record(c, name, s):
            return F.when(s[c] > a["top"][c], F.concat(a[name], F.array(F.struct((a["i"] + 1).alias("at"), s[c].alias("level"))))).otherwise(a[name]).alias(name)

        def taken(n, s):
            tops = F.struct(F.greatest(a["top"]["up"], s["up"]).alias("up"), F.greatest(a["top"]["down"], s["down"]).alias("down"))
            return F.struct((a["i"] + 1).alias("i"), n.alias("own"), s.alias("sum"), tops.alias("top"), record("up", "ups", s), record("down", "downs", s),
                            F.when(F.greatest(n["up"], n["down"]) > reset, a["i"] + 1).alias("hit"))

        kept = F.struct((a["i"] + 1).alias("i"), *[a[c].alias(c) for c in ("own", "sum", "top", "ups", "downs", "hit")])
        return F.when(skip, kept).otherwise(let(moved(a["own"], r), lambda n: let(sums, lambda s: taken(n, s))))

    blocks = blocks.withColumn("_own", F.aggregate("rows", begin, scan))
    ended = lambda i: after("rows", i, zero, step).alias("end")
    ends = lambda name: F.transform(f"_own.{name}", lambda e: F.struct(e["at"].alias("at"), e["level"].alias("level"), ended(e["at"])))
    own_hit = F.filter(F.array(F.struct(F.col("_own.hit").alias("at"), F.lit(0.0).alias("level"), ended(F.col("_own.hit")))), lambda e: e["at"].isNotNull())
    summary = F.struct("_own.own", "_own.sum", ends("ups").alias("ups"), ends("downs").alias("downs"), own_hit.alias("hits"))

    def apply(s, m):
        met = F.concat(F.filter(m["ups"], lambda e: s["up"] + e["level"] > reset), F.filter(m["downs"], lambda e: s["down"] + e["level"] > reset), m["hits"])
        through = F.struct(F.greatest(m["own"]["up"], s["up"] + m["sum"]["up"]).alias("up"), F.greatest(m["own"]["down"], s["down"] + m["sum"]["down"]).alias("down"))
        return F.when(F.size(met) > 0, F.array_min(met)["end"]).otherwise(through)

    started = with_start(blocks, keys, F.first(zero), summary, apply).drop("_own")
    shown = lambda s, r: F.when(r[z].isNull(), zero).otherwise(moved(s, r))
    nothing = F.transform(F.slice("rows", 1, 0), lambda r: F.struct(r.alias("row"), zero.alias("y")))
    done = unroll("rows", F.col("start"), nothing, step, lambda _, before, r: F.array(F.struct(r.alias("row"), shown(before, r).alias("y"))))
    return started.select(*keys, F.inline(done)).select(*keys, "row.*", "y.*")


# --- turning points ------------------------------------------------------------------------------------

def _running_extremes(placed: DataFrame, keys, bucket: str, at: str, price: str) -> DataFrame:
    """Adds ``_lo`` and ``_hi``: lowest and highest price up to the row, with the position of the
    earliest row that has it (negative in ``_hi``). Between buckets one row per bucket travels."""
    low = F.when(F.col(price).isNotNull(), F.struct(F.col(price).alias("px"), F.col(at).alias("at")))
    high = F.when(F.col(price).isNotNull(), F.struct(F.col(price).alias("px"), (-F.col(at)).alias("at")))
    placed = placed.withColumns({"_l": low, "_h": high})
    w = by((*keys, bucket), at).rowsBetween(Window.unboundedPreceding, 0)
    earlier = by(keys, bucket).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(*keys, bucket).agg(F.min("_l").alias("_l"), F.max("_h").alias("_h"))
    ends = ends.select(*keys, bucket, F.min("_l").over(earlier).alias("_bl"), F.max("_h").over(earlier).alias("_bh"))
    df = join_keys(placed.withColumns({"_l": F.min("_l").over(w), "_h": F.max("_h").over(w)}), ends, [*keys, bucket])
    return df.withColumns({"_lo": F.least("_l", "_bl"), "_hi": F.greatest("_h", "_bh")}).drop("_l", "_h", "_bl", "_bh")


def turning_points(df: DataFrame, keys, bucket: Column, order: str, price: str, threshold: float, block_rows: int = BLOCK) -> DataFrame:
    """Rows at which ``price`` turned: ``order``, ``price``, kind (peak or trough), turn_no.

    The first turn is confirmed by the first row that is ``threshold`` away from the running low
    (checked first) or high. From the row after that extreme on, the state is the side and the
    extreme since the last turn. A block maps an extreme h of the upper side to what follows the
    first row low enough below h or below the block's own high; for h these are rows of a new
    minimum only, each listed with the end state behind it. The lower side is the mirror image.
    ``bucket`` must not decrease along ``order``. Rows without a price turn nothing.
    """
    keys = list(keys)
    src = df.select(*keys, bucket.alias("_bucket"), F.col(order).alias("_o"), F.col(price).cast("double").alias("_px"))
    placed = with_position(src, keys, "_bucket", "_o", "_at")

    def rose(px, low):
        return F.coalesce(safe_div(px, low) - 1.0 >= threshold, F.lit(False))

    def fell(px, high):
        return F.coalesce(1.0 - safe_div(px, high) >= threshold, F.lit(False))

    def turned(side, px, extreme):
        return F.when(side == 1, fell(px, extreme)).otherwise(rose(px, extreme))

    def beyond(side, px, extreme):
        return F.coalesce((px - extreme) * side > 0, F.lit(False))

    def state(r, side):
        return F.struct(side.alias("side"), r["_px"].alias("px"), r["_o"].alias("o"))

    def step(s, r):
        return F.when(beyond(s["side"], r["_px"], s["px"]), state(r, s["side"])).when(turned(s["side"], r["_px"], s["px"]), state(r, -s["side"])).otherwise(s)

    seen = _running_extremes(placed, keys, "_bucket", "_at", "_px")
    up, down = rose(F.col("_px"), F.col("_lo.px")), fell(F.col("_px"), F.col("_hi.px"))
    row = {c: F.col(c) for c in ("_px", "_o")}
    confirmed = F.struct(state(row, F.when(up, 1).otherwise(-1)).alias("state"), F.when(up, F.col("_lo.at")).otherwise(-F.col("_hi.at")).alias("back"))
    firsts = seen.filter(up | down).groupBy(*keys).agg(F.min_by(confirmed, "_at").alias("_first"))
    rest = join_keys(placed, firsts, keys)
    opening = rest.filter(F.col("_at") == F.col("_first.back")).select(
        *keys, F.col("_at").alias("_no"), F.col("_o"), F.col("_px"), F.when(F.col("_first.state.side") == 1, "trough").otherwise("peak").alias("kind"))
    # all rows of a series carry the same first turn
    blocks = in_blocks(rest.filter(F.col("_at") > F.col("_first.back")), keys, "_at", ["_px", "_o"], block_rows, [F.first("_first").alias("_first")])

    def summary(side: int):
        """The block's own extreme on ``side``, the rows whose price is a new bound against the
        side, and the first row that turns against the own extreme."""
        none = F.array().cast("array<struct<at:int,level:double>>")
        extreme = F.get(F.filter("rows", lambda r: r["_px"].isNotNull()), F.lit(0))
        begin = F.struct(F.lit(0).alias("i"), F.when(extreme.isNotNull(), state(extreme, F.lit(side))).alias("own"), F.lit(None).cast("double").alias("bound"), none.alias("bounds"), F.lit(None).cast("int").alias("hit"))

        def scan(a, r):
            new = F.coalesce((r["_px"] - a["bound"]) * side < 0, r["_px"].isNotNull())
            entry = F.array(F.struct((a["i"] + 1).alias("at"), r["_px"].alias("level")))
            own = F.when(beyond(F.lit(side), r["_px"], a["own"]["px"]), state(r, F.lit(side))).otherwise(a["own"])
            kept = F.struct((a["i"] + 1).alias("i"), *[a[c].alias(c) for c in ("own", "bound", "bounds", "hit")])
            return F.when(a["hit"].isNotNull(), kept).otherwise(F.struct(
                (a["i"] + 1).alias("i"), own.alias("own"), F.when(new, r["_px"]).otherwise(a["bound"]).alias("bound"),
                F.when(new, F.concat(a["bounds"], entry)).otherwise(a["bounds"]).alias("bounds"), F.when(turned(F.lit(side), r["_px"], a["own"]["px"]), a["i"] + 1).alias("hit")))

        return F.aggregate("rows", begin, scan)

    def mapped(name: str, side: int):
        behind = lambda i: let(F.element_at("rows", i), lambda r: after("rows", i, state(r, F.lit(-side)), step)).alias("end")
        bounds = F.transform(f"{name}.bounds", lambda e: F.struct(e["at"].alias("at"), e["level"].alias("level"), behind(e["at"])))
        hits = F.transform(F.filter(F.array(F.col(f"{name}.hit")), lambda i: i.isNotNull()), lambda i: F.struct(i.alias("at"), F.lit(0.0).alias("level"), behind(i)))
        return F.struct(F.col(f"{name}.own").alias("own"), bounds.alias("bounds"), hits.alias("hits")).alias(name)

    def apply(s, both):
        def over(m):
            far = F.filter(m["bounds"], lambda e: turned(s["side"], e["level"], s["px"]))
            through = F.when(beyond(s["side"], m["own"]["px"], s["px"]), m["own"]).otherwise(s)
            return let(F.concat(far, m["hits"]), lambda met: F.when(F.size(met) > 0, F.array_min(met)["end"]).otherwise(through))
        return let(F.when(s["side"] == 1, both["_up"]).otherwise(both["_down"]), over)

    def turn(s, r):
        return F.array(F.struct(r["_at"].alias("_no"), s["o"].alias("_o"), s["px"].alias("_px"), F.when(s["side"] == 1, "peak").otherwise("trough").alias("kind")))

    blocks = blocks.withColumns({"_up": summary(1), "_down": summary(-1)})
    started = with_start(blocks, keys, F.first("_first.state"), F.struct(mapped("_up", 1), mapped("_down", -1)), apply)
    none = F.flatten(F.transform(F.slice("rows", 1, 0), lambda r: turn(F.col("start"), r)))
    turns = unroll("rows", F.col("start"), none, step, lambda s, before, r: F.when(s["side"] != before["side"], turn(before, r)).otherwise(none))
    # numbered by the rows that confirm them, the first turn by itself: it lies before the rows that
    # follow it; only turns meet in this window
    found = opening.unionByName(started.select(*keys, F.inline(turns)))
    number = F.row_number().over(by(keys, "_no")).cast("int")
    return found.select(*keys, F.col("_o").alias(order), F.col("_px").alias(price), "kind", number.alias("turn_no"))
