import gzip

import pytest
from pyspark.sql import functions as F

from wavelark.llm import warc as W

ROWS = [(i, f"http://h{i % 3}/p\r\n{i}", "<p>" + "é" * (i % 7) + "</p>") for i in range(40)] + [
    (100, None, None), (101, "u", ""), (102, "http://x", "x" * 500_000), (90, "http://y", "x" * 500_000), (102, "http://x", "x" * 500_000),
    (None, "http://n", "<p></p>")]


@pytest.fixture
def archive(spark, tmp_path):
    W.register(spark)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    path = f"file://{tmp_path}/archive"
    W.write_pages(pages, path, file_bytes=4000)
    return path


def expected(min_bytes=0):
    first, out = {}, []
    for i, _, html in ROWS:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, _, html in ROWS:
        data = (html or "").encode()
        new = i is None or first[html or ""] == i or len(data) < min_bytes
        out.append((i, len(data), W.payload_digest(data), "response" if new else "revisit", None if new else first[html or ""]))
    return sorted(out, key=str)


def tuples(df):
    page = F.expr("try_cast(substring_index(record_id, ':', -1) AS long)")
    return sorted(map(tuple, df.select(page, "payload_length", "payload_digest", "record_type",
                                       F.expr("try_cast(substring_index(refers_to, ':', -1) AS long)")).collect()), key=str)


@pytest.mark.parametrize("split", [128 << 20, 300, 97])
def test_round_trip_in_ranges(spark, archive, split):
    df = W.read_archive(spark, archive, split_bytes=split)
    assert tuples(df) == expected()
    for r in df.where("record_type = 'response'").collect():
        assert len(r.payload) == r.payload_length and W.payload_digest(r.payload) == r.payload_digest
    assert df.where("record_type = 'revisit' AND payload IS NOT NULL").count() == 0


def test_small_payloads_are_no_revisits(spark, tmp_path):
    W.register(spark)
    W.write_pages(spark.createDataFrame(ROWS, "page_id long, url string, html string"), f"{tmp_path}/a", min_bytes=100)
    assert tuples(W.read_archive(spark, f"{tmp_path}/a", payload=False)) == expected(100)


def test_filters_are_pushed_down(spark, archive):
    df = W.read_archive(spark, archive, payload=False).where("record_type = 'revisit' AND payload_length > 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "payload_length" in plan.split("Filter")[1].split("\n")[0] and "record_type" not in plan.split("Filter")[1].split("\n")[0].split("AND")[-1]
    assert df.count() == sum(r[3] == "revisit" and r[1] > 5 for r in expected())
    reader = W.WarcReader("x", 1, False)
    assert list(reader.pushFilters([W.EqualTo(("record_type",), "response"), W.In(("date",), ("a", "b"))])) == []
    assert reader._accepts({"record_type": "response", "date": "a"}) and not reader._accepts({"record_type": "revisit", "date": "a"})


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, tmp_path, packed):
    """Members without the length field, and archives without compression."""
    records = [W.record_bytes({"record_id": f"urn:page:{i}", "refers_to": None, "target_uri": None, "date": "d", "payload": b"a\r\n\r\nWARC" * i,
                               "payload_digest": W.payload_digest(b"a\r\n\r\nWARC" * i)}) for i in range(50)]
    name = "x.warc.gz" if packed else "x.warc"
    (tmp_path / name).write_bytes(b"".join(gzip.compress(r) for r in records) if packed else b"".join(records))
    for split in (1 << 20, 500):
        got = W.read_archive(spark, str(tmp_path), split_bytes=split).collect()
        assert sorted(r.record_id for r in got) == sorted(f"urn:page:{i}" for i in range(50))
        assert all(W.payload_digest(r.payload) == r.payload_digest for r in got)


def test_empty_table(spark, tmp_path):
    W.register(spark)
    W.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/none")
    assert W.read_archive(spark, f"{tmp_path}/none").count() == 0


def test_uncommitted_files_are_not_read(spark, archive):
    store, root = W.opened(archive)
    with store.open_output_stream(f"{root}/part-lost.warc.gz", compression=None) as f:
        f.write(b"half a record")
    assert tuples(W.read_archive(spark, archive)) == expected()
