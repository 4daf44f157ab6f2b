"""Names of bar lengths and networks as columns: static look-ups that need no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_SECONDS = 365.25 * 86_400
_UNIT_SECONDS = {"m": 60, "h": 3_600, "d": 86_400}

# Bar lengths that pools are quoted in.
POOL_LENGTHS = ("1m", "5m", "15m", "1h", "4h", "12h", "1d")
# Bar lengths of perpetuals and their seconds; a month is 30 days, and letters count in their case.
PERP_SECONDS = {
    "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "8h": 28800, "12h": 43200, "1d": 86400, "3d": 259200,
    "1w": 604800, "1M": 2592000,
}
# Common names of networks and the ids they are listed under.
NETWORKS = {
    "sol": "solana", "solana": "solana", "eth": "eth", "ethereum": "eth", "mainnet": "eth", "base": "base", "bsc": "bsc", "bnb": "bsc", "arb": "arbitrum",
    "arbitrum": "arbitrum", "poly": "polygon_pos", "polygon": "polygon_pos", "matic": "polygon_pos", "avax": "avax", "avalanche": "avax", "op": "optimism",
    "optimism": "optimism",
}


def seconds_of(length: Column, supported: tuple[str, ...] = POOL_LENGTHS) -> Column:
    """Seconds of a bar of a length such as ``15m``, in any case of letters; an error for one that is not supported."""
    return _known(F.lower(length), {n: int(n[:-1]) * _UNIT_SECONDS[n[-1]] for n in supported}, length)


def perp_seconds_of(length: Column) -> Column:
    """Seconds of a bar of a perpetual; an error for a length that is not supported."""
    return _known(length, PERP_SECONDS, length)


def _known(key: Column, values: dict[str, int], said: Column) -> Column:
    found = F.create_map(*(F.lit(x) for n, v in values.items() for x in (n, v)))
    wrong = F.concat(F.lit("unsupported bar length "), F.coalesce(said, F.lit("null")), F.lit("; use one of " + ", ".join(values)))
    return F.coalesce(F.try_element_at(found, F.coalesce(key, F.lit(""))).cast("long"), F.raise_error(wrong).cast("long"))


def bars_per_year(seconds: Column) -> Column:
    return YEAR_SECONDS / seconds


def bars_per_day(seconds: Column) -> Column:
    return 86_400 / seconds


def network_id(name: Column) -> Column:
    """The id of a network by any of its common names; other names are ids already."""
    key = F.lower(F.trim(name))
    known = F.create_map(*(F.lit(x) for pair in NETWORKS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, key), key)
