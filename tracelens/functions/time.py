"""Timestamps in several epochs, times embedded in ids, and zone-aware rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracelens.functions.values import safe_double, safe_long

# Epoch offsets and the accepted range.
APPLE_OFFSET_S = 978_307_200
CHROMIUM_OFFSET_US = 11_644_473_600_000_000
MAX_EPOCH_S = 4_102_444_800
APPLE_MIN, APPLE_MAX = 100_000_000, 2_000_000_000

# Display formats (datetime pattern) and display zones.
DISPLAY_PATTERNS = {
    "iso": "yyyy-MM-dd'T'HH:mm:ss",
    "ymd": "yyyy-MM-dd HH:mm:ss",
    "dmy": "dd/MM/yyyy HH:mm:ss",
    "dMy": "dd/MMM/yyyy HH:mm:ss",
    "d_mon_y": "dd MMM yyyy, HH:mm:ss",
    "mon_d_y": "MMM dd, yyyy, hh:mm:ss a",
    "mdy": "MM/dd/yyyy hh:mm:ss a",
    "full": "EEE, dd MMM yyyy, HH:mm:ss",
    "date_only": "dd MMM yyyy",
    "epoch_ms": "",
}
DISPLAY_ZONES = ["UTC", "Asia/Kolkata", "Asia/Dubai", "Asia/Singapore", "Europe/London", "America/New_York"]
# Zone labels: those with letters have one label per offset, the others show the offset itself.
_ZONE_NAMES = {
    "UTC": {0: "UTC"},
    "Asia/Kolkata": {19800: "IST"},
    "Asia/Dubai": {14400: "+04"},
    "Asia/Singapore": {28800: "+08"},
    "Europe/London": {0: "GMT", 3600: "BST"},
    "America/New_York": {-18000: "EST", -14400: "EDT"},
}


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp (zone-less input is read as UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def norm_ts(value: Column) -> Column:
    """Struct ``(epoch_ms, ts, source)`` from ms, s or 2001-epoch seconds by magnitude; else null."""
    v = safe_double(value)
    seconds = (
        F.when(v <= 0, F.lit(None))
        .when(v > 1e12, F.when(v <= MAX_EPOCH_S * 1000.0, v / 1000.0))
        .when(v > 1e9, F.when(v <= MAX_EPOCH_S, v))
        .when((v > APPLE_MIN) & (v < APPLE_MAX), v + APPLE_OFFSET_S)
    )
    source = F.when(v > 1e12, F.lit("unix_ms")).when(v > 1e9, F.lit("unix_s")).otherwise(F.lit("apple_coredata"))
    ms = F.rint(seconds * 1000.0).cast("long")
    return F.when(
        seconds.isNotNull(), F.struct(ms.alias("epoch_ms"), F.timestamp_millis(ms).alias("ts"), source.alias("source"))
    )


def norm_ms(value: Column) -> Column:
    return norm_ts(value)["epoch_ms"]


def ledger_ts_ms(value: Column, payment_id: Column) -> Column:
    """Milliseconds as stored (seconds are scaled up), else the wall clock inside the payment id."""
    v = safe_double(value)
    stored = F.when(v != 0, F.when(v > 1e11, v).otherwise(v * 1000.0)).try_cast("long")
    clock = F.regexp_extract(payment_id, r"^[TP](\d{12})", 1)
    embedded = F.unix_millis(F.try_to_timestamp(F.concat(F.lit("20"), clock), F.lit("yyyyMMddHHmmss")))
    return F.coalesce(stored, F.when(clock != "", embedded))


def decode_id_ts(payment_id: Column) -> Column:
    """Epoch milliseconds of the ``yyMMddHHmmss`` digits inside an id; null when they are no date."""
    digits = F.regexp_extract(F.trim(payment_id), r"^[TR]?(\d{12})\d+$", 1)

    def pair(i: int) -> Column:
        return F.substring(digits, i, 2).try_cast("int")

    year = F.when(pair(1) < 70, pair(1) + 2000).otherwise(pair(1) + 1900)
    valid = (digits != "") & pair(3).between(1, 12) & pair(5).between(1, 31) & (pair(7) < 24) & (pair(9) < 60) & (pair(11) < 60)
    made = F.try_make_timestamp(year, pair(3), pair(5), pair(7), pair(9), pair(11))
    return F.when(valid, F.unix_millis(made))


def chromium_ts(micros: Column) -> Column:
    """Timestamp of microseconds since 1601; values outside 1970..2100 are null."""
    unix = safe_long(micros) - CHROMIUM_OFFSET_US
    return F.when((unix > 0) & (unix <= MAX_EPOCH_S * 1_000_000), F.timestamp_micros(unix))


def iso(ms: Column) -> Column:
    """ISO text in UTC; a fraction is printed only when there is one."""
    base = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(ms, F.lit(1000))
    return F.concat(base, F.when(part != 0, F.concat(F.lit("."), F.lpad((part * 1000).cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))


def utc_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def ist_text(ms: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), "Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss")


def ist_naive(ms: Column) -> Column:
    """Zone-less local time for spreadsheets."""
    return F.from_utc_timestamp(F.timestamp_millis(ms), "Asia/Kolkata").cast("timestamp_ntz")


def zone_offset_s(ms: Column, zone: str) -> Column:
    ts = F.timestamp_millis(ms)
    return (F.unix_millis(F.from_utc_timestamp(ts, zone)) - ms) / 1000


def render_ts(ms: Column, fmt: str = "iso", zone: str = "UTC") -> Column:
    """Text of an instant in a display format and zone, with the zone label appended."""
    if fmt == "epoch_ms":
        return ms.cast("string")
    zone = zone if zone in DISPLAY_ZONES else "UTC"
    local = F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    offset = zone_offset_s(ms, zone)
    pattern = DISPLAY_PATTERNS.get(fmt, DISPLAY_PATTERNS["iso"])
    text = F.date_format(local, pattern)
    if fmt == "iso":
        minutes = (F.abs(offset) / 60).cast("int")
        part = F.pmod(ms, F.lit(1000))
        fraction = F.when(part != 0, F.format_string(".%06d", part * 1000)).otherwise(F.lit(""))
        sign = F.when(offset < 0, F.lit("-")).otherwise(F.lit("+"))
        hours = F.floor(minutes / 60)
        return F.concat(text, fraction, sign, F.format_string("%02d:%02d", hours, minutes - hours * 60))
    label = F.lit(None).cast("string")
    for seconds, name in _ZONE_NAMES[zone].items():
        label = F.when(offset == seconds, F.lit(name)).otherwise(label)
    return F.trim(F.concat_ws(" ", text, label))
