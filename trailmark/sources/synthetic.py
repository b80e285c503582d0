"""Deterministic synthetic sessions: a random walk over a small shop, one walk per id.

Every draw is a slice of an MD5 digest of (seed, id), so a session depends on nothing but its
id: any partitioning, any retry and any SQL engine produce the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.tokens import let

# Event names, start events, follow-up events and length weights (1..8) of the walk.
SHOP_EVENTS = (
    "Home", "Search", "Product_View", "Add_To_Cart", "Checkout",
    "Payment", "Order_Confirmation", "Account_Settings", "Help_Center", "Category_Browse",
)
START_EVENTS = ("Home", "Search", "Category_Browse")
FOLLOW_UPS = {
    "Home": ("Search", "Category_Browse", "Product_View"),
    "Search": ("Product_View", "Home", "Search"),
    "Category_Browse": ("Product_View", "Home", "Search"),
    "Product_View": ("Add_To_Cart", "Category_Browse", "Product_View"),
    "Add_To_Cart": ("Checkout", "Product_View", "Home"),
    "Checkout": ("Payment", "Add_To_Cart"),
    "Payment": ("Order_Confirmation", "Checkout"),
}
LENGTH_WEIGHTS = (25, 20, 18, 15, 10, 6, 4, 2)

_HEX_PER_DRAW = 7  # 28 random bits per draw, nine draws out of two digests


def _names(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def walk_sessions(ids: DataFrame, id_column: str = "id", seed: int = 42) -> DataFrame:
    """One session per row of ``ids``: (SESSION, EVENT_PATH, TOTAL_EVENTS)."""
    key = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    digest = F.concat(F.md5(F.concat(key, F.lit(":a"))), F.md5(F.concat(key, F.lit(":b"))))
    draws = let(
        digest,
        lambda digits: F.array(
            *[
                F.conv(F.substring(digits, 1 + _HEX_PER_DRAW * k, _HEX_PER_DRAW), 16, 10).cast(
                    "bigint"
                )
                for k in range(len(LENGTH_WEIGHTS) + 1)
            ]
        ),
    )

    # Draw 0 picks the length by weight, draw 1 the start, the others the following events.
    length = F.lit(len(LENGTH_WEIGHTS))
    roll = F.get("draws", F.lit(0)) % sum(LENGTH_WEIGHTS)
    for n in range(len(LENGTH_WEIGHTS) - 1, 0, -1):
        length = F.when(roll < sum(LENGTH_WEIGHTS[:n]), n).otherwise(length)

    follow_ups = F.create_map(
        *[part for name, nxt in FOLLOW_UPS.items() for part in (F.lit(name), _names(nxt))]
    )

    def step(path: Column, draw: Column) -> Column:
        options = F.coalesce(
            F.try_element_at(follow_ups, F.element_at(path, -1)), _names(SHOP_EVENTS)
        )
        follower = let(options, lambda o: F.get(o, (draw % F.size(o)).cast("int")))
        return F.concat(path, F.array(follower))

    start = F.get(_names(START_EVENTS), (F.get("draws", F.lit(1)) % len(START_EVENTS)).cast("int"))
    path = F.aggregate(F.slice("draws", F.lit(3), F.col("length") - 1), F.array(start), step)

    return (
        ids.select(F.col(id_column).alias("id"))
        .select("id", draws.alias("draws"))
        .select("id", "draws", length.cast("int").alias("length"))
        .select(
            F.concat(F.lit("SESS_"), _session_code(F.col("id"))).alias("SESSION"),
            F.array_join(path, "->").alias("EVENT_PATH"),
            F.col("length").cast("bigint").alias("TOTAL_EVENTS"),
        )
    )


# An odd multiplier, which is one-to-one modulo a power of two, and half the code.
_MULTIPLIER, _HALF_BITS = 0x5DEECE66D, 24


def _session_code(row_id: Column) -> Column:
    """Twelve hex digits, distinct for distinct ids below 2^48.

    The product modulo 2^48 is taken in two halves so that it stays within a bigint.
    """
    half = 1 << _HALF_BITS
    low = row_id.bitwiseAND(half - 1)
    high = F.shiftright(row_id, _HALF_BITS).bitwiseAND(half - 1)
    mixed = (low * _MULTIPLIER + ((high * _MULTIPLIER) % half) * half) % (half * half)
    return F.lpad(F.hex(mixed), 12, "0")


def generate_sessions(
    spark: SparkSession, rows: int, seed: int = 42, partitions: int | None = None
) -> DataFrame:
    """``rows`` synthetic sessions; the load generator for benchmarks."""
    if rows < 1:
        raise ValueError("The number of sessions must be positive.")
    return walk_sessions(spark.range(0, rows, 1, partitions), "id", seed)
