import base64
import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rows import EXTRA
from textloom.llm import warc


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for name in (*EXTRA, "type", "origin", "segment", "block", "first"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


def rows():
    rng = random.Random(3)
    html = lambda n: "".join(rng.choice("<p>é\r\n x1") for _ in range(n))
    long = html(90_000)
    out = [(0, "http://a/", None), (1, None, ""), (2, "http://b/\r\nx", "0\r\n\r\n"), (3, "u", "WARC/1.1\r\n\r\n\r\n\r\n"), (4, "u", long), (5, "u", long), (6, "u", html(4097)), (7, "u", html(4096)), (None, "u", "lost"), (8, "u", "lost")]
    return out + [(20 + i, f"http://c/{i}", html(rng.randint(0, 9000))) for i in range(10)] + [(40 + i, "hot", "the same page") for i in range(30)]


@pytest.mark.parametrize("segment", [1000, warc.SEGMENT_BYTES])
def test_round_trip(spark, tmp_path, segment):
    path = f"file://{tmp_path}/w"
    own = rows()
    warc.write_archives(warc.with_revisits(pages(spark, own)), path, segment)
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(own)
    first = {}
    for i, _, html in own:
        first[html or ""] = min((x for x in (first.get(html or ""), i) if x is not None), default=None)
    got = {}
    for r in found:
        key = r.record_id.split(":")[2]
        got[None if key == "-" else int(key)] = r
    for i, _, html in own:
        r, payload = got[i], (html or "").encode()
        assert r.digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if i == first[html or ""]:
            assert (r.type, bytes(r.payload), r.refers_to) == ("response", payload, None)
        else:
            assert (r.type, bytes(r.payload), r.refers_to, r.stated) == ("revisit", b"", f"urn:page:{first[html or '']}", len(payload))


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.with_revisits(pages(spark, [])), path)
    assert warc.read_archives(spark, path).count() == 0


def archive(records):
    return warc.END.encode().join([*records, b""])


@pytest.mark.parametrize("change", [lambda r: r[:1] + r[2:], lambda r: r[:-1], lambda r: [*r[:1], r[1].replace(b"Segment-Number: 2", b"Segment-Number: 9"), *r[2:]], lambda r: [*r[:-1], r[-1].replace(b"Total-Length: 2500", b"Total-Length: 2501")]])
def test_gaps_and_wrong_lengths_raise(spark, tmp_path, change):
    own = list(warc.records("response", "urn:page:1:k", "u", "D", b"x" * 2500, None, segment=1000))
    assert len(own) == 3
    (tmp_path / "a.warc").write_bytes(archive(change(own)))
    with pytest.raises(PySparkException):
        warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_segments_in_any_order_and_file(spark, tmp_path):
    body = bytes(range(256)) * 12
    own = list(warc.records("response", "urn:page:1:k", "u", "D", warc.http_response(body), None, segment=700))
    for n, r in enumerate(reversed(own)):
        (tmp_path / f"{n}.warc").write_bytes(archive([r]))
    (r,) = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert bytes(r.payload) == body


def test_chunked_framing():
    for n in (0, 1, 4095, 4096, 4097, 10_000):
        assert warc.unchunked(warc.chunked(b"y" * n)) == b"y" * n
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
