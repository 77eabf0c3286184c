"""Numbers, times, hashes, costs and colours as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RETENTION_MS = 30 * 24 * 60 * 60 * 1000


def clock(seconds: Column) -> Column:
    """m:ss; empty for what is no time."""
    whole = F.floor(seconds)
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (seconds < 0), "").otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")))


def half_up(x: Column) -> Column:
    """The nearest integer, halves upwards."""
    return F.floor(x + 0.5)


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rfc1123(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


#: Months of the Gregorian calendar in Arabic. Fixed values.
MONTHS = ["يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر"]


def arabic_date(ts: Column) -> Column:
    digits = lambda c: F.translate(c.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts))
    return F.concat_ws(" ", digits(F.dayofmonth(ts)), month, digits(F.year(ts)))


def valid_progress(part_index: Column, part_count: Column, time: Column, updated_ms: Column, now_ms: Column) -> Column:
    """Whether a saved position may be used: in range, not from the future, not older than 30 days (both ends count)."""
    age = now_ms - updated_ms
    ok = (part_count > 0) & (age >= 0) & (age <= RETENTION_MS) & (part_index >= 0) & (part_index < part_count) & (time >= 0) & ~F.isnan(time.cast("double"))
    return F.coalesce(ok, F.lit(False))


def audio_key(article_id: Column) -> Column:
    return F.substring(F.sha2(article_id.cast("string"), 256), 1, 16)


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of the fields as JSON in this order; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def cost_usd(provider: Column, characters: Column, rate_per_1000: Column | None = None, chars_per_second: float = 11.0, chars_per_token: float = 2.0) -> Column:
    """Estimated price of synthesis; null where it is not known. Prices are fixed values: 0.0001 USD a character; 0.5
    and 10, or 0.6 and 12, USD a million text and audio tokens at 25 or 50 audio tokens a second."""
    seconds, tokens = characters / chars_per_second, F.ceil(characters / chars_per_token)
    by_token = lambda text, audio, per_second: tokens * text / 1_000_000 + F.ceil(seconds * per_second) * audio / 1_000_000
    rated = F.lit(None).cast("double") if rate_per_1000 is None else F.when(rate_per_1000 >= 0, characters / 1000 * rate_per_1000)
    return F.when(provider == "character", characters * 0.0001).when(provider == "token_25", by_token(0.5, 10, 25)).when(provider == "token_50", by_token(0.6, 12, 50)).when(provider == "rated", rated)


def total_or_null(x: Column) -> Column:
    """A sum that is null as soon as one value is."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def threshold_reached(ratio: Column, thresholds: list[float]) -> Column:
    return F.array_max(F.filter(F.array(*map(F.lit, thresholds)), lambda t: ratio >= t))


def gate(used: Column, warn: float, stop: float) -> Column:
    return F.when(used > stop, "stop").when(used >= warn, "warn").otherwise("ok")


def _channels(colour: Column) -> list[Column]:
    return [F.conv(F.substring(colour, i, 2), 16, 10).cast("double") / 255 for i in (2, 4, 6)]


def luminance(colour: Column) -> Column:
    linear = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4)) for c in _channels(colour)]
    return reduce(lambda a, b: a + b, (c * w for c, w in zip(linear, (0.2126, 0.7152, 0.0722), strict=True)))


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def mixed_colour(front: Column, back: Column, amount: float = 0.12) -> Column:
    parts = [F.lpad(F.lower(F.hex(half_up((f * amount + b * (1 - amount)) * 255).cast("long"))), 2, "0") for f, b in zip(_channels(front), _channels(back), strict=True)]
    return F.concat(F.lit("#"), *parts)
