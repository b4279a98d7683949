"""Information elements of raw captures and the security they announce."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.operators.checks import require_columns

# Element ids, vendor prefix, authentication suites and the privacy bit.
DS_PARAMETER, RSN, VENDOR = 3, 48, 221
WPA_PREFIX, RSN_OUI = "0050F201", "000FAC"
SAE_SUITES = ["000FAC08", "000FAC09"]
PRIVACY_BIT = 0x10
# Security types and their strength.
STRENGTH = {"OPEN": 0, "LEGACY_PRIVACY": 1, "WPA": 2, "WPA2_OR_NEWER": 3, "WPA3_SAE": 4}

PARSED = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("element_id", T.IntegerType()), T.StructField("data", T.BinaryType())]))),
    T.StructField("truncated", T.BooleanType()),
])


def walk_elements(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All elements of a column of blobs: blob, element id, begin and end of the payload in the buffer, by blob and place;
    and whether bytes are left over in each blob. All blobs are walked in step, one element of each at a time."""
    data, offsets = buffer_of(blobs)
    at, end = offsets[:-1].copy(), offsets[1:]
    found, active = [], np.arange(len(blobs))
    while len(active):
        here, stop = at[active], end[active]
        room = here + 2 <= stop
        active, here, stop = active[room], here[room], stop[room]
        after = here + 2 + data[here + 1].astype(np.int64)
        whole = after <= stop
        active, here, after = active[whole], here[whole], after[whole]
        found.append((active, data[here], here + 2, after))
        at[active] = after
    blob, kind, begin, stop = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    order = np.argsort(blob, kind="stable")
    return blob[order], kind[order], begin[order], stop[order], at < end


def buffer_of(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the place where each blob begins (one more at the end); NULL is empty."""
    blobs = blobs.fill_null(b"") if blobs.null_count else blobs
    _, offsets, data = blobs.cast(pa.large_binary()).buffers()
    places = np.frombuffer(offsets, np.int64)[blobs.offset:blobs.offset + len(blobs) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), places


@F.arrow_udf(PARSED)
def _split_elements(blobs: pa.Array) -> pa.Array:
    blob, kind, begin, end, truncated = walk_elements(blobs)
    data, _ = buffer_of(blobs)
    length = end - begin
    ends = np.concatenate([[0], np.cumsum(length)])
    taken = np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])
    payload = pa.Array.from_buffers(pa.binary(), len(kind), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[taken])])
    elements = pa.StructArray.from_arrays([pa.array(kind.astype(np.int32)), payload], names=["element_id", "data"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(blob, np.arange(len(blobs) + 1)).astype(np.int32)), elements)
    return pa.StructArray.from_arrays([lists, pa.array(truncated)], names=["elements", "truncated"])


def with_elements(captures: DataFrame) -> DataFrame:
    require_columns(captures, ["capture_id", "ie_blob"], "information elements")
    return captures.withColumn("_p", _split_elements("ie_blob")).select(
        *captures.columns, F.col("_p.elements").alias("elements"), F.col("_p.truncated").alias("truncated"))


def explode_elements(captures: DataFrame) -> DataFrame:
    """One row per element, in order; a capture without any keeps one row of NULLs."""
    return with_elements(captures).select("capture_id", "truncated", F.posexplode_outer("elements").alias("position", "e")).select(
        "capture_id", "position", F.col("e.element_id").alias("element_id"), F.col("e.data").alias("data"), "truncated")


def _u16(payload: Column, at: Column) -> Column:
    """Little-endian number at a byte offset of a hex text; NULL past the end."""
    text = F.concat(payload.substr(at * 2 + 3, F.lit(2)), payload.substr(at * 2 + 1, F.lit(2)))
    return F.when(F.length(text) == 4, F.conv(text, 16, 10).cast("int"))


def key_suites(payload: Column) -> Column:
    """Authentication suites of one RSN payload given as hex; none unless its structure is complete."""
    size = F.length(payload) / 2
    listed = _u16(payload, F.lit(6)) * 4 + 8
    count = _u16(payload, listed)
    start = listed + 2
    complete = (size >= 8) & (listed <= size) & (count > 0) & (start + count * 4 <= size)
    suites = F.transform(
        F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
        lambda i: payload.substr((start + i * 4) * 2 + 1, F.lit(8)))
    return F.when(complete, suites).otherwise(F.array().cast("array<string>"))


def security_posture(captures: DataFrame) -> DataFrame:
    """Security type, strength, evidence and DS channel per capture, without moving any row."""
    require_columns(captures, ["capability_info"], "security posture")
    rows = with_elements(captures)

    def of(kind):
        return F.filter("elements", lambda e: e["element_id"] == kind)

    rsn = of(RSN)
    sae = F.exists(rsn, lambda e: F.arrays_overlap(key_suites(F.hex(e["data"])), F.array(*[F.lit(s) for s in SAE_SUITES])))
    wpa = F.exists(of(VENDOR), lambda e: F.hex(e["data"]).startswith(WPA_PREFIX))
    private = F.col("capability_info").bitwiseAND(PRIVACY_BIT) != 0
    kind = (F.when((F.size(rsn) > 0) & sae, "WPA3_SAE").when(F.size(rsn) > 0, "WPA2_OR_NEWER").when(wpa, "WPA")
            .when(private, "LEGACY_PRIVACY").otherwise("OPEN"))
    source = F.when(F.size(rsn) > 0, "rsn_ie").when(wpa, "wpa_vendor_ie").otherwise("capability_privacy_bit")
    channels = F.filter(
        F.transform(F.filter(of(DS_PARAMETER), lambda e: F.length(e["data"]) == 1),
                    lambda e: F.conv(F.hex(e["data"]), 16, 10).cast("int")), lambda c: c > 0)
    out = rows.withColumn("security_type", kind)
    strength = F
    for name, value in STRENGTH.items():
        strength = strength.when(F.col("security_type") == name, value)
    return out.select(
        *[c for c in captures.columns if c != "ie_blob"], "security_type", strength.alias("security_strength"),
        source.alias("security_source"), F.try_element_at(channels, F.lit(1)).alias("ds_parameter_channel"), "truncated")


def posture_counts(postures: DataFrame) -> DataFrame:
    return postures.groupBy("security_type", "security_source").agg(F.count(F.lit(1)).alias("captures"))
