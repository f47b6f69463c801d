"""Times as text: strict UTC parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?"


def utc_timestamp(text: Column) -> Column:
    """The instant of ISO text with a zone (Z or an offset); text without one, or that is no time, is an error. Null stays null."""
    bare = F.trim(text)
    zoned = bare.rlike(_FORM + r"(Z|z|[+-]\d{2}:?\d{2})$")
    naive = bare.rlike(_FORM + "$")
    wrong = F.when(naive, F.lit("time without a zone")).otherwise(F.lit("not a time"))
    # an offset without its colon is written with one
    whole = F.regexp_replace(F.upper(bare), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.isNull(), F.lit(None)).when(zoned, F.to_timestamp(whole)).otherwise(F.raise_error(wrong).cast("timestamp"))


def iso_utc(instant: Column) -> Column:
    """ISO text in UTC with a final Z, to the microsecond only where there is one."""
    micros = F.unix_micros(instant)
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int")), "yyyy-MM-dd")
    rest = F.pmod(micros, F.lit(86_400_000_000))
    part = lambda unit, most: F.lpad((F.floor(rest / unit) % most).cast("string"), 2, "0")
    fraction = F.pmod(micros, F.lit(1_000_000))
    tail = F.when(fraction == 0, "").otherwise(F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0")))
    return F.when(instant.isNotNull(), F.concat(day, F.lit("T"), part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), tail, F.lit("Z")))
