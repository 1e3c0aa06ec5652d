import hashlib

import pytest
import zstandard
from data import rows
from pyspark.sql import functions as F

from tributary.llm import warc
from tributary.scratch import new_path

SCHEMA = "page_id long, url string, html string, digest string, id int, size string"


def pages(spark):
    long = "<p>ä" + "x" * 300
    some = [(5, "http://a/1", long), (3, "http://b/2", long), (9, None, long), (1, "u\r\nX: y", "short"), (2, "http://c", "short"), (4, "http://d", None), (6, "http://e", ""), (7, "http://f", "WARC/1.1\r\n\r\n" * 20), (8, "", "y" * 3_000_000), (3, "http://b/2", long), (None, "http://g", long), (None, "http://h", "z" * 100), (10, "http://i", "z" * 99 + "ü")]
    return spark.createDataFrame([(*r, "d", 1, "s") for r in some], SCHEMA), some


def want(some):
    out, first, seen = [], {}, set()
    for i, _, t in some:
        b = (t or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    for i, _, t in some:
        b = (t or "").encode()
        refers = first.get(b)
        again = refers is not None and (i != refers or (i, b) in seen)
        seen.add((i, b))
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", refers if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    df, some = pages(spark)
    path = warc.write(df, new_path(spark, "warc"))
    got = warc.read(spark, path, with_payload=True)
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want(some)
    bodies = {bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert bodies == {(t or "").encode() for _, _, t in some}
    one = got.where("page_id = 7").first()
    [(head, body)] = warc.lookup(spark, path, [one.record_id])
    assert head["Page-ID"] == "7" and body == some[7][2].encode()


def test_any_zstd_tool_reads_a_bundle(spark):
    df, some = pages(spark)
    path = warc.write(df.repartition(1), new_path(spark, "warc"))
    index = spark.read.parquet(f"{path}/index")
    n = 0
    for name in [r.bundle for r in index.select("bundle").distinct().collect()]:
        files, base = warc._files(f"{path}/bundles")
        with files.open_input_file(f"{base}/{name}") as f:
            data = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
        at = 0
        while at < len(data):
            _, _, at = warc.parse(data, at)
            n += 1
    assert n == len(some)


@pytest.mark.parametrize("most", ["-1", "10m"])
def test_rows_that_repeat_in_several_files(spark, most):
    """Each payload has one response, whichever way Spark joins."""
    df, some = pages(spark)
    where = new_path(spark, "pages")
    for _ in range(3):
        df.repartition(4).write.mode("append").parquet(where)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        got = warc.read(spark, warc.write(spark.read.parquet(where), new_path(spark, "warc")))
        assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want(some * 3)
        assert got.select("record_id").distinct().count() == 3 * len(some)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_broken_index_is_noticed(spark):
    df, _ = pages(spark)
    path = warc.write(df, new_path(spark, "warc"))
    other = new_path(spark, "warc")
    spark.read.parquet(f"{path}/index").withColumn("record_id", F.lit("<x>")).write.parquet(f"{other}/index")
    bundles, (files, base) = f"{path}/bundles", warc._files(f"{other}/bundles")
    files.create_dir(base)
    src, sbase = warc._files(bundles)
    for r in spark.read.parquet(f"{path}/index").select("bundle").distinct().collect():
        with src.open_input_file(f"{sbase}/{r.bundle}") as f, files.open_output_stream(f"{base}/{r.bundle}", compression=None) as g:
            g.write(f.read())
    with pytest.raises(Exception, match="the index points"):
        warc.read(spark, other).collect()


def test_empty(spark):
    path = warc.write(spark.createDataFrame([], SCHEMA), new_path(spark, "warc"))
    assert warc.read(spark, path).count() == 0
