"""Table contracts. Times are epoch microseconds once ingested; raw feeds carry milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame

SNAPSHOT_JSON = "lastUpdateId long, bids array<array<string>>, asks array<array<string>>"

# The positional layout of a kline array.
KLINE_FIELDS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume",
                "number_of_trades", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume")
KLINE_LONGS = ("open_time", "close_time", "number_of_trades")

TRADES = "symbol string, ts long, id long, price double, qty double"
BARS = "symbol string, bar_ts long, open double, high double, low double, close double, volume double"
BOOK_UPDATES = "symbol string, seq long, side string, price double, qty double"
EVENTS = "symbol string, t0 long, t1 long, trgt double, side int, type string"


def check(df: DataFrame, contract: str) -> DataFrame:
    """Fail early if a column of the contract is missing or has another type."""
    have = dict(df.dtypes)
    for part in contract.split(","):
        name, kind = part.split()
        kind = {"long": "bigint"}.get(kind, kind)
        if have.get(name) != kind:
            raise TypeError(f"column {name}: expected {kind}, found {have.get(name)}")
    return df
