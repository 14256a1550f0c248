"""How figures are shown in reports: a dash for what isn't known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
PERIODS = {"day": "last 24 hours", "week": "last 7 days", "month": "last 30 days", "all": "all time"}


def _or_dash(value: Column, shown: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")), DASH).otherwise(shown)


def number(value: Column) -> Column:
    """With commas between thousands and two places at most."""
    return _or_dash(value, F.regexp_replace(F.format_number(value.cast("double"), 2), r"\.?0+$", ""))


def json_number(value: Column) -> Column:
    """As JSON text: six places at most, none for a whole number; null if not known."""
    plain = F.regexp_replace(value.cast("decimal(30,6)").cast("string"), r"\.?0+$", "")
    return F.when(value.isNull() | F.isnan(value.cast("double")), "null").otherwise(plain)


def duration(ms: Column) -> Column:
    """Milliseconds as "12 ms", "3.4 s" or "5m 6s"."""
    s = ms / 1000
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.round(s - F.floor(s / 60) * 60).cast("long").cast("string"), F.lit("s"))
    return _or_dash(ms, F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).when(s < 60, F.concat(F.format_string("%.1f", s), F.lit(" s"))).otherwise(minutes))


def usd(value: Column) -> Column:
    return _or_dash(value, F.concat(F.lit("$"), F.format_string("%.4f", value.cast("double"))))


def percent(rate: Column) -> Column:
    return _or_dash(rate, F.concat(F.format_string("%.1f", rate.cast("double") * 100), F.lit("%")))


def tokens(n: Column) -> Column:
    """Compact: 950, 1.2k, 3.45M."""
    x = n.cast("double")
    return _or_dash(n, F.when(n >= 1_000_000, F.concat(F.format_string("%.2f", x / 1e6), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", x / 1e3), F.lit("k"))).otherwise(n.cast("string")))


def relative(at_ms: Column, now_ms: int) -> Column:
    """How long ago: minutes, hours, days, and from thirty days on the date."""
    minutes = F.round((F.lit(now_ms) - at_ms) / 60_000).cast("long")
    hours = F.round(minutes / 60).cast("long")
    days = F.round(hours / 24).cast("long")
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at_ms / 86_400_000).cast("int")), "yyyy-MM-dd")
    return _or_dash(at_ms, F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).when(days < 30, ago(days, "d")).otherwise(date))


def period_label(period: Column, project: Column, session: Column) -> Column:
    """What a report is over: a session, or a period and the project if there is one."""
    label = F.coalesce(F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv))[period], period)
    return F.when(session.isNotNull(), F.concat(F.lit("session "), session.cast("string"))).when(project.isNotNull(), F.concat(label, F.lit(" · project "), project.cast("string"))).otherwise(label)
