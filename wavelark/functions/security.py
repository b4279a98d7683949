"""Security type names and their strength order."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavelark.functions.text import strip

# Accepted names, weakest first; the rank is the position.
SECURITY_ORDER = ["OPEN", "WEP", "WPA", "WPA2", "WPA3"]


def normalize_security(value: Column) -> Column:
    text = F.upper(strip(value))
    return F.when(text.isin(SECURITY_ORDER), text).when(value.isNotNull(), "OTHER")


def security_rank(value: Column) -> Column:
    text = normalize_security(value)
    rank = F.array_position(F.array(*[F.lit(s) for s in SECURITY_ORDER]), text) - 1
    return F.when(rank >= 0, rank).cast("double")
