"""Times of several systems as timestamps in UTC."""

from pyspark.sql import Column, functions as F

#: 100 ns ticks from 1601 to 1970, and microseconds.
FILETIME_EPOCH_TICKS = 116_444_736_000_000_000
WEBKIT_EPOCH_MICROSECONDS = 11_644_473_600_000_000
FIRST_YEAR, LAST_YEAR = 1970, 2100


def in_valid_years(ts: Column) -> Column:
    """The timestamp, or null outside of the years 1970 to 2100."""
    return F.when(F.year(ts).between(FIRST_YEAR, LAST_YEAR), ts)


def from_filetime(ticks: Column) -> Column:
    """Windows FILETIME; 0 and negative values (2^63 and above) are null. The 100 ns digit goes."""
    since = ticks - F.lit(FILETIME_EPOCH_TICKS)
    micros = ((since - F.pmod(since, F.lit(10))).cast("decimal(20,0)") / 10).cast("long")
    return F.when(ticks > 0, in_valid_years(F.timestamp_micros(micros)))


def from_unix_seconds(seconds: Column) -> Column:
    return in_valid_years(F.timestamp_seconds(seconds))


def from_webkit(micros: Column) -> Column:
    """Microseconds since 1601; values up to 0 are null."""
    return F.when(micros > 0, F.timestamp_micros(micros - F.lit(WEBKIT_EPOCH_MICROSECONDS)))


def from_firefox(micros: Column) -> Column:
    """Microseconds since 1970; values up to 0 are null."""
    return F.when(micros > 0, F.timestamp_micros(micros))


def from_dos(packed: Column, quarter_hours: Column | None = None) -> Column:
    """DOS date and time in 32 bits (date above time), two-second steps, with an optional UTC
    offset in quarters of an hour. Impossible dates are null."""
    bits = lambda shift, mask: F.shiftright(packed, shift).bitwiseAND(F.lit(mask))
    text = F.format_string(
        "%04d-%02d-%02d %02d:%02d:%02d",
        bits(25, 127) + 1980, bits(21, 15), bits(16, 31), bits(11, 31), bits(5, 63), bits(0, 31) * 2,
    )
    ts = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    if quarter_hours is not None:
        ts = F.timestamp_micros(F.unix_micros(ts) - quarter_hours.cast("long") * 900_000_000)
    return in_valid_years(ts)
