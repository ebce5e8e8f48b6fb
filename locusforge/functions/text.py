"""Column builders over short texts: names, labels, durations, log messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and units whose results must be matched.
NAME_OTHER = "[^a-z0-9-]"
LABEL_OTHER = "[^a-z0-9-_]"
LABEL_LENGTH = 63
DURATION = r"^(\d+)([dhms])$"
UNIT_SECONDS = {"d": 86400, "h": 3600, "m": 60, "s": 1}
EXIT_MESSAGE = r'startup-script[\w":\s]*exit status [0-9]+'
EXIT_CODE = r"exit status\s*([0-9]+)"
SESSION_ENTRY = "step.session.spark_uri=yarn"


def clean_name(name: Column) -> Column:
    """Lower case with every other character as a dash."""
    return F.regexp_replace(F.lower(name), NAME_OTHER, "-")


def create_name(prefix: Column, suffix: Column) -> Column:
    """Clean name of ``prefix-suffix``."""
    return clean_name(F.concat(prefix, F.lit("-"), suffix))


def clean_label(label: Column) -> Column:
    """Clean name that keeps underscores, cut to the longest label allowed."""
    return F.substring(F.regexp_replace(F.lower(label), LABEL_OTHER, "-"), 1, LABEL_LENGTH)


def strhash(text: Column, length: int = 5) -> Column:
    """First hexadecimal digits of the SHA-256 digest."""
    return F.substring(F.sha2(text, 256), 1, length)


def duration_seconds(text: Column, on_error: str = "raise") -> Column:
    """Seconds of texts such as ``10m`` or ``2h``."""
    number = F.regexp_extract(text, DURATION, 1)
    unit = F.regexp_extract(text, DURATION, 2)
    factor = F.lit(None).cast("bigint")
    for name, seconds in UNIT_SECONDS.items():
        factor = F.when(unit == name, F.lit(seconds).cast("bigint")).otherwise(factor)
    value = F.when(number != "", number).cast("bigint") * factor
    if on_error == "null":
        return value
    return F.when(value.isNotNull(), value).otherwise(
        F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a duration: "), text)))
    )


def exit_status(message: Column) -> Column:
    """Exit code a start-up script reported, null for any other message."""
    return F.when(message.rlike(EXIT_MESSAGE), F.regexp_extract(message, EXIT_CODE, 1).cast("bigint"))


def map_to_pairs(params: Column, with_session: bool = False) -> Column:
    """``key=value`` texts of a map in entry order.

    An empty map, or a key without ``step`` in it, is an error. The session
    entry is added once when asked for.
    """
    pairs = F.transform(F.map_entries(params), lambda e: F.concat_ws("=", e["key"], e["value"]))
    if with_session:
        pairs = F.when(F.array_contains(pairs, SESSION_ENTRY), pairs).otherwise(
            F.concat(pairs, F.array(F.lit(SESSION_ENTRY)))
        )
    wrong = F.filter(F.map_keys(params), lambda k: ~k.contains("step"))
    return (
        F.when(
            params.isNull() | (F.size(params) == 0),
            F.raise_error(F.lit("expected at least one parameter")),
        )
        .when(
            F.size(wrong) > 0,
            F.raise_error(F.concat(F.lit("incorrect parameter keys: "), F.array_join(wrong, ","))),
        )
        .otherwise(pairs)
    )
