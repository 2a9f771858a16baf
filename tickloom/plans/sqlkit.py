"""SQL fragments shared by oracles."""

from __future__ import annotations

import math


def ema_sql(name: str, src: str, x: str, span: float, min_periods: int, day: str = "day", key: str = "symbol") -> str:
    """CTE adding ``ema`` to ``src``: adjusted weights by a self join cut at negligible weight."""
    r = 1.0 - 2.0 / (span + 1.0)
    reach = math.ceil(math.log(1e-17) / math.log(r)) + 2
    wt = f"pow({r!r}::DOUBLE, a.rn - b.rn)"
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {day}) AS rn, count({x}) OVER (PARTITION BY {key} ORDER BY {day} ROWS UNBOUNDED PRECEDING) AS cn FROM {src}),
{name}_e AS (SELECT a.{key}, a.rn, sum(b.{x} * {wt}) / sum(CASE WHEN b.{x} IS NOT NULL THEN {wt} END) AS ema FROM {name}_n a JOIN {name}_n b
  ON a.{key} = b.{key} AND b.rn BETWEEN a.rn - {reach} AND a.rn GROUP BY 1, 2),
{name} AS (SELECT n.*, CASE WHEN n.cn >= {min_periods} THEN e.ema END AS ema FROM {name}_n n JOIN {name}_e e USING ({key}, rn))"""


P = "PARTITION BY symbol ORDER BY day"


def roll(fn: str, x: str, n: int, mp: int | None = None, p: str = P) -> str:
    """Rolling aggregate with a minimum count; ``fn`` may hold a {x} placeholder."""
    call = fn.format(x=x) if "{x}" in fn else f"{fn}({x})"
    over = f"OVER ({p} ROWS {n - 1} PRECEDING)"
    mp = n if mp is None else mp
    return f"{call} {over}" if mp <= 1 else f"CASE WHEN count({x}) {over} >= {mp} THEN {call} {over} END"


def lag(x: str, n: int = 1, p: str = P) -> str:
    return f"lag({x}, {n}) OVER ({p})"


def pct(x: str, n: int = 1, p: str = P) -> str:
    return f"({x} / nullif({lag(x, n, p)}, 0) - 1)"


def z0(e: str) -> str:
    return f"coalesce({e}, 0)"


def pair(fn: str, a: str, b: str, n: int, mp: int, p: str = P) -> str:
    over = f"OVER ({p} ROWS {n - 1} PRECEDING)"
    if fn == "corr":  # written out: corr() is NaN, not NULL, when a side is constant
        sd = lambda u, v: f"stddev_samp(CASE WHEN {v} IS NOT NULL THEN {u} END) {over}"
        call = f"covar_samp({a}, {b}) {over} / nullif({sd(a, b)} * {sd(b, a)}, 0)"
    else:
        call = f"{fn}({a}, {b}) {over}"
    return f"CASE WHEN count({a} + {b}) {over} >= {mp} THEN {call} END"


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
YEAR = "sqrt(252::DOUBLE)"


def rsi_sql(name: str, src: str, x: str, span: int) -> str:
    """CTE adding ``rsi`` to ``src``."""
    g = f"{name}g AS (SELECT *, CASE WHEN {x} - {lag(x)} > 0 THEN {x} - {lag(x)} ELSE 0 END AS gain, CASE WHEN {x} - {lag(x)} < 0 THEN {lag(x)} - {x} ELSE 0 END AS loss FROM {src})"
    return ", ".join([g, ema_sql(f"{name}a", f"{name}g", "gain", span, span), ema_sql(f"{name}b", f"{name}g", "loss", span, span),
                      f"{name} AS (SELECT s.*, coalesce(100 - 100 / (1 + a.ema / nullif(b.ema, 0)), 50) AS rsi FROM {src} s JOIN {name}a a USING (symbol, day) JOIN {name}b b USING (symbol, day))"])


def atr_sql(name: str, src: str, span: int) -> str:
    """CTE adding ``atr`` to ``src``."""
    return ", ".join([f"{name}t AS (SELECT *, {TR} AS tr FROM {src})", ema_sql(f"{name}e", f"{name}t", "tr", span, span),
                      f"{name} AS (SELECT s.*, coalesce(e.ema, e.tr) AS atr FROM {src} s JOIN {name}e e USING (symbol, day))"])
