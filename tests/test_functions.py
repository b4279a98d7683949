import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from wavelark.functions import identity, radio, security, text


def values(frame, column, rows, kind="string"):
    df = frame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_channel_frequency_and_band(frame):
    channels = [1, 6, 13, 14, 31, 32, 36, 177, 178, None]
    assert values(frame, radio.channel_to_frequency_mhz, channels, "long") == [
        2412.0, 2437.0, 2472.0, 2484.0, None, 5160.0, 5180.0, 5885.0, None, None]
    assert values(frame, radio.wifi_band, [2400.0, 2500.0, 4900.0, 5925.0, 7125.0, 57000.0, 71000.0, None], "double") == [
        "2.4GHz", "OTHER", "5GHz", "6GHz", "OTHER", "60GHz", "60GHz", None]


def test_security_names_and_rank(frame):
    names = [" wpa2 ", "Open", "wep", "WPA", "wpa3", "enterprise", None]
    assert values(frame, security.normalize_security, names) == ["WPA2", "OPEN", "WEP", "WPA", "WPA3", "OTHER", None]
    assert values(frame, security.security_rank, names) == [3.0, 0.0, 1.0, 2.0, 4.0, None, None]


def test_identifiers(frame):
    assert values(frame, identity.hash_ssid, [" Home\t", "", None]) == [
        hashlib.sha256(b"ssid|Home").hexdigest(), None, None]
    assert values(frame, identity.hash_bssid, ["aa:bb"]) == [hashlib.sha256(b"bssid|AA:BB").hexdigest()]
    macs = ["00:11:22:33:44:55", "02:11:22:33:44:55", "01:11:22:33:44:55", "invalid", None]
    assert values(frame, identity.local_admin_bit, macs) == [0.0, 1.0, 0.0, None, None]
    assert values(frame, identity.multicast_bit, macs) == [0.0, 0.0, 1.0, None, None]
    group = values(frame, lambda v: identity.stable_group_id(F.lit("a"), v), [None])
    assert group == [hashlib.sha256(b"a|").hexdigest()[:20]]


def test_byte_literal_text(frame):
    raw = ["b'NETWORK_1'", "b''", 'b"it"', "plain", "b'caf\\xc3\\xa9'", "b'\\xff'", "b'open", " ", None, "b'a\\'b'"]
    assert values(frame, text.decode_byte_literal, raw) == [
        "NETWORK_1", None, "it", "plain", "café", "�", "b'open", None, None, "a'b"]


def test_token_map(frame):
    lines = ["ap1:-50,ap2:-60", "ap1:-50,ap1:-70, ap2 : 3,bad,:4,x:,y:z", "", None]
    assert values(frame, text.parse_token_map, lines) == [
        {"ap1": -50, "ap2": -60}, {"ap1": -70, "ap2 ": 3}, {}, None]


def test_compact_timestamp(frame):
    stamps = ["20240102030405123", "20240102030405123456", "20240102030405", " ", None]
    got = values(frame, lambda v: F.unix_micros(text.parse_compact_timestamp(v)), stamps[:2] + stamps[3:])
    base = int((datetime(2024, 1, 2, 3, 4, 5) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert got == [base + 123_000, base + 123_456, None, None]


def test_coordinates_and_keys(frame):
    got = values(frame, text.parse_coordinates, ["1.5, 2,3", "1.5,,", "4"])
    assert [tuple(g) for g in got] == [(1.5, 2.0, 3.0), (1.5, None, None), (4.0, None, None)]
    keys = values(frame, lambda v: text.position_key(v, F.lit(-0.0000001), F.lit(2.0)), [1.00000049, 1.0, None], "double")
    assert keys[0] == keys[1] and keys[2] is None


def test_booleans(frame):
    words = ["TRUE", "1", "yes", "y", "0", "no", "maybe", None]
    assert values(frame, text.tolerant_true, words) == [True, True, True, True, False, False, False, False]
    assert values(frame, text.strict_boolean, words) == [True, True, True, None, False, False, None, None]


def test_numbers(frame):
    assert values(frame, text.number, ["1.5", "NaN", "x", None]) == [1.5, None, None, None]
