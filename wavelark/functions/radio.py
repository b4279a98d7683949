"""Channel, frequency and band expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel_to_frequency_mhz(channel: Column) -> Column:
    c = channel.cast("long")
    return (
        F.when(c.between(1, 13), c * 5 + 2407)
        .when(c == 14, F.lit(2484))
        .when(c.between(32, 177), c * 5 + 5000)
        .cast("double")
    )


def wifi_band(frequency_mhz: Column) -> Column:
    f = frequency_mhz.cast("double")
    return (
        F.when(f.isNull(), F.lit(None).cast("string"))
        .when((f >= 2400) & (f < 2500), "2.4GHz")
        .when((f >= 4900) & (f < 5925), "5GHz")
        .when((f >= 5925) & (f < 7125), "6GHz")
        .when((f >= 57000) & (f <= 71000), "60GHz")
        .otherwise("OTHER")
    )


def valid_advertised_channel(channel: Column) -> Column:
    c = channel.cast("long")
    return F.when(c > 0, c)


def channel_mismatch(capture: Column, advertised: Column) -> Column:
    """1.0 when the capture channel differs from a valid advertised one, NULL if unknown."""
    return (capture.cast("long") != valid_advertised_channel(advertised)).cast("double")
