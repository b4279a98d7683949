"""Volume and range profiles of the raw datasets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.functions.text import number

# Radio standards by their short name.
STANDARDS = {"n": "802.11n", "ac": "802.11ac", "ad": "802.11ad"}


def profile_beacons(normal: DataFrame) -> DataFrame:
    """One row about raw beacon rows of all sessions."""
    rssi, channel = number(F.col("RSSI")), number(F.col("Channel"))
    # Folding on the identifiers keeps the distinct counts off the raw rows.
    folded = normal.groupBy("session_id", "BSSID", "SSID", number(F.col("BeaconInterval")).alias("_interval")).agg(
        F.count(F.lit(1)).alias("n"), F.min(rssi).alias("r0"), F.max(rssi).alias("r1"),
        F.min(channel).alias("c0"), F.max(channel).alias("c1"))
    return folded.agg(
        F.sum("n").alias("normal_rows"), F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("BSSID").alias("unique_bssids"), F.count_distinct("SSID").alias("unique_ssids"),
        F.coalesce(F.sum(F.when(F.col("SSID").isNull(), F.col("n"))), F.lit(0).cast("long")).alias("missing_ssid"),
        F.min("r0").alias("rssi_min_dbm"), F.max("r1").alias("rssi_max_dbm"),
        F.min("c0").cast("long").alias("channel_min"), F.max("c1").cast("long").alias("channel_max"),
        F.sort_array(F.collect_set("_interval")).alias("beacon_interval_unique"))


def beacon_intervals(normal: DataFrame) -> DataFrame:
    """Every interval that occurs and its rows, one row each, however many there are."""
    return normal.groupBy(number(F.col("BeaconInterval")).alias("beacon_interval")).agg(F.count(F.lit(1)).alias("rows"))


def attack_counts(processed: DataFrame) -> DataFrame:
    return processed.where(number(F.col("is_rogue")) == 1).groupBy("_rogue_type").agg(F.count(F.lit(1)).alias("rows"))


def profile_aggregates(raw: DataFrame) -> DataFrame:
    """Validity of the one-second aggregates per radio standard; zero-filled."""
    rssi = number(F.col("meanBeaconRssi"))
    gap = number(F.col("meanInterBeaconTime"))
    ok_rssi, ok_gap = rssi.isNotNull() & (rssi != -100), gap.isNotNull() & (gap != 1.0)
    counted = raw.groupBy("wifiType").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok_rssi).alias("valid_beacon_rssi"),
        F.count_if(ok_gap).alias("valid_beacon_interval"), F.count_if(ok_rssi & ok_gap).alias("valid_both"))
    names = raw.sparkSession.createDataFrame(list(STANDARDS.items()), "wifiType string, wifi_standard string")
    columns = ["rows", "valid_beacon_rssi", "valid_beacon_interval", "valid_both"]
    return names.join(counted, "wifiType", "left").select(
        "wifi_standard", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns])


def aggregate_values(raw: DataFrame) -> DataFrame:
    """Traces, frequencies and client counts that occur."""
    folded = raw.select("traceNr", number(F.col("channelFreq")).alias("f"),
                        number(F.col("nrClients")).cast("long").alias("c")).distinct()
    return folded.agg(
        F.count_distinct("traceNr").alias("traces"), F.sort_array(F.collect_set("f")).alias("frequencies_mhz"),
        F.sort_array(F.collect_set("c")).alias("client_count_values"))


def aggregate_value_counts(raw: DataFrame) -> DataFrame:
    """(field, value, rows) of the traces, frequencies and client counts that occur, one row each, however many there are."""
    fields = {"trace": F.col("traceNr").cast("string"), "frequency_mhz": number(F.col("channelFreq")).cast("string"),
              "clients": number(F.col("nrClients")).cast("long").cast("string")}
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in fields.items()])).alias("p")
    return raw.select(pairs).select("p.*").where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))


def profile_fingerprints(samples: DataFrame) -> DataFrame:
    """Per collection and overall (`is_total`): sessions, samples, readings, APs, missing channels, RSSI range.

    `samples` has collection, session_id and the maps rssis and channels.
    """
    readings = samples.select("collection", "session_id", F.explode("rssis").alias("ap_id", "rssi"), "channels").select(
        "collection", "ap_id", "rssi", F.try_element_at("channels", F.col("ap_id")).isNull().alias("lost"))
    folded = readings.groupBy("collection", "ap_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("lost").alias("lost"), F.min("rssi").alias("lo"), F.max("rssi").alias("hi"))
    aps = folded.rollup("collection").agg(
        F.sum("n").alias("observations"), F.count_distinct("ap_id").alias("unique_aps"),
        F.sum("lost").alias("missing_channel"), F.min("lo").alias("rssi_min_dbm"), F.max("hi").alias("rssi_max_dbm"),
        (F.grouping("collection") == 1).alias("is_total"))
    sizes = samples.groupBy("collection", "session_id").agg(F.count(F.lit(1)).alias("n")).rollup("collection").agg(
        F.count("session_id").alias("sessions"), F.sum("n").alias("samples"), (F.grouping("collection") == 1).alias("is_total"))
    a, b = aps.alias("a"), sizes.alias("b")
    same = F.col("a.collection").eqNullSafe(F.col("b.collection")) & (F.col("a.is_total") == F.col("b.is_total"))
    return b.join(a, same, "left").select(
        "b.collection", "b.is_total", "sessions", "samples", "observations", "unique_aps", "missing_channel", "rssi_min_dbm",
        "rssi_max_dbm")


def common_channels(samples: DataFrame, top: int = 15) -> DataFrame:
    """The most frequent channels of all readings."""
    readings = samples.select(F.explode("rssis").alias("ap_id", "rssi"), "channels").select(
        F.try_element_at("channels", F.col("ap_id")).alias("channel")).where(F.col("channel").isNotNull())
    return readings.groupBy("channel").agg(F.count(F.lit(1)).alias("observations")).orderBy(
        F.desc("observations"), "channel").limit(top)


def profile_frames(raw: DataFrame) -> DataFrame:
    """One row about raw management frames."""
    rssi = number(F.col("rssi"))
    folded = raw.groupBy("type", "addr2", "addr3", "SSID").agg(
        F.count(F.lit(1)).alias("n"), F.min(rssi).alias("lo"), F.max(rssi).alias("hi"))

    def of(kind):
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("n"))), F.lit(0).cast("long"))

    return folded.agg(
        F.sum("n").alias("frames"), of("Dot11Beacon").alias("beacons"), of("Dot11ProbeResp").alias("probe_responses"),
        of("Dot11ProbeReq").alias("probe_requests"), F.count_distinct("addr2").alias("unique_transmitters"),
        F.count_distinct("addr3").alias("unique_bssid_field_values"), F.count_distinct("SSID").alias("unique_ssid_values"),
        F.min("lo").alias("rssi_min_dbm"), F.max("hi").alias("rssi_max_dbm"))
