"""Field decoding for log lines: syslog body, epoch time, duration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two header layouts a syslog line may carry.  The body is
# "content" in the older one and "message" in the newer one.
RFC5424_RE = (
    r"^(?:[0-9]+ )?<[0-9]{1,3}>1 \S+ \S+ \S+ \S+ \S+ "
    r"(?:-|(?:\[(?:[^\]\\]|\\.)*\])+) (.+)$"
)
RFC3164_RE = (
    r"^(?:[0-9]+ )?<[0-9]{1,3}>[A-Z][a-z]{2} [ 0-9][0-9] "
    r"[0-9]{2}:[0-9]{2}:[0-9]{2} \S+ [^:\s\[]+(?:\[[^\]]*\])?: ?(.+)$"
)
_SECONDS_RE = r"^[+-]?[0-9]+(?:\.[0-9]{1,9})?$"


def syslog_text(line: Column) -> Column:
    """Body of a syslog line, empty when no header layout matches."""
    return F.when(
        line.rlike("^(?:[0-9]+ )?<[0-9]{1,3}>1 "), F.regexp_extract(line, RFC5424_RE, 1)
    ).otherwise(F.regexp_extract(line, RFC3164_RE, 1))


def syslog_body(line: Column) -> Column:
    """Body of a syslog line, NULL when no header layout matches."""
    return F.nullif(syslog_text(line), F.lit(""))


def seconds_to_us(text: Column) -> Column:
    """``"sec[.frac]"`` -> whole microseconds, exact; NULL when malformed or when the
    microseconds do not fit a long (what a TIMESTAMP holds)."""
    exact = text.try_cast("decimal(28,9)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.when(text.rlike(_SECONDS_RE), exact.try_cast("bigint"))


def epoch_time(text: Column) -> Column:
    return F.timestamp_micros(seconds_to_us(text))
