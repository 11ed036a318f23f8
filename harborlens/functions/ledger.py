"""Signs, dates, prices and movement codes of stock ledgers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each movement code means.
MOVEMENT_NAMES = {
    "101": "Goods Receipt",
    "102": "GR Reversal",
    "261": "Goods Issue (Production)",
    "311": "Transfer Posting",
    "344": "Stock Adjustment",
    "551": "Scrapping",
    "601": "Goods Issue (Delivery)",
    "641": "GI Reversal",
}
# Codes that count as flow into and out of a location.
INBOUND_CODES = ["101", "561", "501", "102"]
OUTBOUND_CODES = ["601", "641", "261", "201"]


def signed_qty(flag: Column, qty: Column) -> Column:
    """'S' books in, 'H' books out."""
    return F.when(flag == "H", -qty).otherwise(qty)


def flow_qty(code: Column, qty: Column) -> Column:
    """Signed by movement code; codes in neither list move nothing."""
    return F.when(code.isin(INBOUND_CODES), qty).when(code.isin(OUTBOUND_CODES), -qty).otherwise(F.lit(0.0))


def movement_name(code: Column) -> Column:
    pairs = [F.lit(x) for pair in MOVEMENT_NAMES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("Other"))


def parse_day(text: Column) -> Column:
    """yyyyMMdd text to a date, null when it is none."""
    return F.try_to_date(text, "yyyyMMdd")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def week_start(day: Column) -> Column:
    """The Monday of the week, as a date."""
    return F.trunc(day, "week")


def week_end(day: Column) -> Column:
    return F.date_add(week_start(day), 6)


def money(amount: Column, scale: int = 4) -> Column:
    """Exact decimal, so that sums do not depend on the order of rows."""
    return amount.cast(f"decimal(18,{scale})")


def unit_price(net: Column, qty: Column) -> Column:
    """Net value per piece, 0 when there is no quantity."""
    return F.when(qty.isNotNull() & (qty > 0), net / qty).otherwise(F.lit(0.0))


def item_value(qty: Column, price: Column, unit: Column) -> Column:
    """Value of a quantity whose price is quoted per ``unit`` pieces."""
    return F.round(qty * price / unit, 2)
