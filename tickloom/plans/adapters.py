"""Domain tables derived from the given parquet tables, with the SQL that derives the same.

tick   events: symbol = event type, price = value
bar    15-minute bars of the ticks, session roll at 15:00, regular hours from 06:30
day    daily bars of lineitem: symbol = return flag, price = unit price
day2   daily bars of orders: symbol = order priority, price = order total
chain  weekly option quotes: lineitem joined to part, strike from the retail price

A plan reads these tables in several branches with different columns, which Spark would
compute once per branch. They are far smaller than what they are built from, so each is
persisted: one scan of the source, memory first, disk when it does not fit, recomputed from
lineage when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators import bars

BAR_MINUTES = 15


def packed_line() -> F.Column:
    """Order of lineitem rows as one decimal, which a hash aggregation can hold (a struct makes it a sort): order key in
    13 digits, line number in 2, part key in 11, supplier key in 10."""
    part = lambda c, zeros: F.col(c).cast("decimal(38,0)") * F.lit(Decimal(10**zeros))
    return part("l_orderkey", 23) + part("l_linenumber", 21) + part("l_partkey", 10) + F.col("l_suppkey")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._shared: dict[str, DataFrame] = {}

    def shared(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._shared:
            self._shared[name] = make().persist(StorageLevel.MEMORY_AND_DISK)
        return self._shared[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def tick(self) -> DataFrame:
        vol = (1 + F.col("user_id") % 7).cast("double")
        return self.table("events").select(
            F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"),
            vol.alias("volume"),
            F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(vol).alias("bidvolume"),
            F.when(F.col("event_id") % 2 == 0, vol).otherwise(0.0).alias("askvolume"),
        )

    def bar(self) -> DataFrame:
        return self.shared("bar", lambda: bars.with_session(bars.build_bars(self.tick(), minutes=BAR_MINUTES)))

    def day(self) -> DataFrame:
        price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100.0) / 100.0
        rows = self.table("lineitem").select(
            F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day"), price.alias("price"),
            F.col("l_quantity").alias("volume"),
            packed_line().alias("seq"),
        )
        return self.shared("day", lambda: bars.daily_from_trades(rows))

    def day2(self) -> DataFrame:
        rows = self.table("orders").select(
            F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day"),
            F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"), F.col("o_orderkey").alias("seq"),
        )
        return self.shared("day2", lambda: bars.daily_from_trades(rows))

    def quotes(self) -> DataFrame:
        li = self.table("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", "l_shipdate")
        part = self.table("part").select("p_partkey", "p_retailprice", "p_size")
        trade = F.to_date(F.date_trunc("week", "l_shipdate"))
        return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            trade.alias("trade_date"), F.date_add(trade, (4 + 7 * F.col("l_linenumber")).cast("int")).alias("expiration"),
            (F.round(F.col("p_retailprice") / 5) * 5).alias("strike"),
            F.when(F.col("l_orderkey") % 2 == 0, "C").otherwise("P").alias("instrument_class"),
            "p_size", "l_quantity", "l_linestatus",
        )

    def chain(self) -> DataFrame:
        return self.shared("chain", lambda: self.quotes().groupBy("trade_date", "expiration", "strike", "instrument_class").agg(
            (0.1 + F.max("p_size") / 100.0).alias("iv"), F.sum("l_quantity").alias("open_interest")))

    def spot(self, chain: DataFrame) -> DataFrame:
        """Reference price of a trade date: the median quoted strike."""
        return chain.groupBy("trade_date").agg(F.median("strike").alias("spot"))


#: The other series that every symbol is matched with.
SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def with_series(df):
    """A copy of each row for every other series."""
    return df.withColumn("series", F.explode(F.array(*map(F.lit, SERIES))))


TICK = """
tick AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, (1 + user_id % 7)::DOUBLE AS volume,
  CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE (1 + user_id % 7)::DOUBLE END AS bidvolume,
  CASE WHEN event_id % 2 = 0 THEN (1 + user_id % 7)::DOUBLE ELSE 0.0 END AS askvolume FROM events)"""

BAR = TICK + f""",
bar0 AS (SELECT symbol, time_bucket(INTERVAL '{BAR_MINUTES} minutes', ts) AS dt,
  first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
  sum(volume) AS volume, sum(bidvolume) AS bidvolume, sum(askvolume) AS askvolume, avg(price) AS price,
  count(*) AS n_ticks FROM tick GROUP BY 1, 2),
bar AS (SELECT *, CAST(dt + INTERVAL 9 HOURS AS DATE) AS trading_day,
  (date_part('hour', dt) * 60 + date_part('minute', dt))::INT AS minute,
  CASE WHEN date_part('hour', dt) * 60 + date_part('minute', dt) < 390 OR date_part('hour', dt) > 13 THEN 1 ELSE 0 END AS ovn,
  row_number() OVER (PARTITION BY symbol, CAST(dt + INTERVAL 9 HOURS AS DATE) ORDER BY dt) AS bar_no FROM bar0)"""

DAY = """
trade AS (SELECT l_returnflag AS symbol, l_shipdate::DATE AS day, floor(l_extendedprice / l_quantity * 100::DOUBLE) / 100::DOUBLE AS price, l_quantity AS volume,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
day AS (SELECT symbol, day,
  first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open,
  max(price) AS high, min(price) AS low,
  last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close,
  sum(volume) AS volume FROM trade GROUP BY 1, 2)"""

DAY2 = """
day2 AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS day, first(o_totalprice ORDER BY o_orderkey) AS open,
  max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderkey) AS close,
  count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2)"""

CHAIN = """
chain AS (SELECT date_trunc('week', l_shipdate)::DATE AS trade_date,
  (date_trunc('week', l_shipdate)::DATE + (4 + 7 * l_linenumber)::INT)::DATE AS expiration,
  round(p_retailprice / 5) * 5 AS strike, CASE WHEN l_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS instrument_class,
  0.1 + max(p_size) / 100.0::DOUBLE AS iv, sum(l_quantity) AS open_interest
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""


def with_(*ctes: str) -> str:
    """WITH clause of the named table derivations."""
    return "WITH " + ", ".join(c.strip() for c in ctes) + " "
