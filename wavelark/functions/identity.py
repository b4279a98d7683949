"""Cleaning and hashing of network identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavelark.functions.text import strip

MAC_PATTERN = "^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"


def clean_ssid(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def clean_bssid(value: Column) -> Column:
    return F.upper(clean_ssid(value))


def clean_mac(value: Column) -> Column:
    """Upper-case MAC address, NULL unless it has six hexadecimal octets."""
    text = clean_bssid(value)
    return F.when(text.rlike(MAC_PATTERN), text)


def hash_identifier(namespace: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{namespace}|"), value), 256)


def hash_ssid(value: Column) -> Column:
    return hash_identifier("ssid", clean_ssid(value))


def hash_bssid(value: Column) -> Column:
    return hash_identifier("bssid", clean_bssid(value))


def stable_group_id(*parts: Column) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 20)


def network_id(interface_guid: Column, bssid: Column) -> Column:
    return F.sha2(F.concat(interface_guid, F.lit("|"), bssid), 256)


def _first_octet(mac: Column) -> Column:
    return F.conv(F.substring(clean_mac(mac), 1, 2), 16, 10).cast("int")


def local_admin_bit(mac: Column) -> Column:
    return F.shiftright(_first_octet(mac).bitwiseAND(2), 1).cast("double")


def multicast_bit(mac: Column) -> Column:
    return _first_octet(mac).bitwiseAND(1).cast("double")
