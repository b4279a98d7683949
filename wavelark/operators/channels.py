"""Reference and features of the channel an access point itself advertises."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.functions.identity import hash_bssid, hash_ssid
from wavelark.functions.radio import channel_mismatch, valid_advertised_channel
from wavelark.functions.text import number
from wavelark.operators.checks import require_columns
from wavelark.operators.context import Reference, _absent, _resolve, bssid_ssids
from wavelark.session import stored


def build_channel_reference(df: DataFrame) -> Reference:
    """Known advertised channels per SSID. An SSID that never advertised one has no profile."""
    require_columns(df, ["ssid", "bssid", "advertised_channel"], "channel reference")
    combos = stored(df.select(
        hash_ssid(F.col("ssid")).alias("ssid_hash"), hash_bssid(F.col("bssid")).alias("bssid_hash"),
        valid_advertised_channel(number(F.col("advertised_channel"))).alias("channel"),
    ).distinct(), "channel-facts")
    named = combos.where(F.col("ssid_hash").isNotNull())
    members = named.where(F.col("bssid_hash").isNotNull()).select("ssid_hash", "bssid_hash").distinct()
    single = bssid_ssids(members).where(F.col("ssid_hash").isNotNull()).select("bssid_hash", "ssid_hash")
    orphans = combos.where(F.col("ssid_hash").isNull()).select("bssid_hash", "channel").join(single, "bssid_hash")
    pairs = named.select("ssid_hash", "channel").unionByName(orphans.select("ssid_hash", "channel"))
    profiles = pairs.where(F.col("channel").isNotNull()).distinct().groupBy("ssid_hash").agg(
        F.sort_array(F.collect_set("channel")).alias("channels"))
    # A BSSID may lead to an SSID without channels: it resolves, but to an empty set.
    owners = single.join(profiles, "ssid_hash", "left").withColumn(
        "channels", F.coalesce("channels", F.array().cast("array<bigint>")))
    return Reference(profiles, members, owners)


def transform_channels(df: DataFrame, ref: Reference) -> DataFrame:
    require_columns(df, ["ssid", "bssid", "channel", "advertised_channel"], "channel features")
    capture, advertised = number(F.col("channel")), number(F.col("advertised_channel"))
    rows = df.withColumns({
        "ssid_hash": hash_ssid(F.col("ssid")), "bssid_hash": hash_bssid(F.col("bssid"))})
    out = _resolve(rows, ref, "ssid", "bssid_fallback", "none")
    kept = [c for c in df.columns if c not in ("ssid", "bssid", "channel", "advertised_channel")]
    valid = valid_advertised_channel(advertised)
    return out.select(
        *kept, capture.cast("long").alias("capture_channel"), valid.alias("advertised_channel"),
        channel_mismatch(capture, advertised).alias("capture_advertised_mismatch"),
        _absent(valid, F.col("ref_channels")).alias("advertised_channel_changed"))
