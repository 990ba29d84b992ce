import hashlib
import io
import re
import zlib

import pytest

from pagewise.llm import warc

from .helpers import CLASHES

BIG = "<p>" + "long page " * 200


def pages(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(-1).alias(c) for c in (*CLASHES, "digest", "revisit", "refers_to", "html_", "of", "best")))
    return df


def brute(rows):
    best = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and (i is not None or b not in best):
            best[b] = i if best.get(b) is None else max(i, best[b])
    out, used = [], set()
    for i, _, h in rows:
        b = (h or "").encode()
        sha = hashlib.sha1(b).hexdigest()
        if len(b) < 1000 or (i == best[b] and b not in used):
            used.add(b)
            out.append((i, len(b), sha, "response", None))
        else:
            out.append((i, len(b), sha, "revisit", best[b]))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [(1, "http://a/", BIG), (5, "http://b/\nx", BIG), (3, None, BIG), (5, "http://b/", BIG), (None, "u", BIG), (7, "u", "é" * 700), (8, "u", "é" * 700), (9, "u", "short"), (10, "u", "short"), (11, "u", ""), (12, "u", None), (None, None, None), (13, "u", "x" * 300_000)]
    got = warc.round_trip(pages(spark, rows, clash=True)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    rows = [(1, "http://a/?q=ü", BIG), (2, "http://b/", "tiny"), (3, "http://c/", BIG)]
    made = warc.write(pages(spark, rows), f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.read(spark, made).collect()}
    assert bytes(got[3]["payload"]) == BIG.encode() and got[3]["url"] == "http://c/"
    assert got[1]["payload"] is None and got[1]["refers_to"] == 3 and got[1]["record_type"] == "revisit"
    assert bytes(got[2]["payload"]) == b"tiny"
    assert sum(r["n_records"] for r in made.collect()) == 3


def archive(*payloads):
    return b"".join(warc.member(i, f"http://x/{i}", p, hashlib.sha1(p).hexdigest(), None, False) for i, p in enumerate(payloads))


class Trickle(io.BytesIO):
    """Gives few octets at a time, across all boundaries."""

    def read(self, n=-1):
        return super().read(min(n, 7))


def test_reader_frames_records_at_any_chunk():
    data = [b"", b"a\r\n\r\nb", b"WARC/1.1\r\n" * 500, bytes(range(256)) * 3000]
    for kind in (io.BytesIO, Trickle):
        got = list(warc.records(kind(archive(*data))))
        assert [r.payload for r in got] == data
        assert [r.payload_digest for r in got] == [hashlib.sha1(p).hexdigest() for p in data]
    assert list(warc.records(io.BytesIO(b""))) == []


def test_damage_is_told():
    whole = archive(b"one payload", b"another")
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(whole[:-3])))
    raw = zlib.decompress(archive(b"one payload"), 31)
    for bad in (raw.replace(b"one payload", b"two payload"), raw[:-9] + b"\r\n\r\n", re.sub(rb"(?<=Digest: )(.{37})\r\nContent-Length: \d", rb"\1\r\nContent-Length: 1", raw), raw.replace(b"Content-Length", b"Content-Width"), raw[:-2]):
        z = zlib.compressobj(wbits=31)
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(z.compress(bad) + z.flush())))
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(b"not gzip at all")))


def test_headers_of_any_length(spark):
    url = "http://long/" + "x" * 5_000_000
    rows = [(1, url, BIG), (2, "u", BIG)]
    got = warc.round_trip(pages(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    r = next(warc.records(io.BytesIO(warc.member(1, url, b"x", hashlib.sha1(b"x").hexdigest(), None, False))))
    assert r.headers["warc-target-uri"] == url


def test_what_breaks_lines_is_percent_encoded():
    assert warc._line("a\u2028b\r\n c") == "a%E2%80%A8b%0D%0A%20c"
    r = next(warc.records(io.BytesIO(warc.member(1, "u\r\nX-Page-Id: 9", b"x", hashlib.sha1(b"x").hexdigest(), None, False))))
    assert r.headers["x-page-id"] == "1"


def test_revisits_are_checked_against_their_response(spark):
    zero = "0" * 40
    rows = [(1, 1000, "a" * 40, "response", None), (2, 1000, "a" * 40, "revisit", 1), (3, 1000, zero, "revisit", 1), (4, 999, "a" * 40, "revisit", 1), (5, 1000, "a" * 40, "revisit", None)]
    df = spark.createDataFrame(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert {(r["payload_digest"], r["payload_bytes"], r["refers_to"]) for r in warc.unmatched(df).collect()} == {(zero, 1000, 1), ("a" * 40, 999, 1), ("a" * 40, 1000, None)}
    assert warc.unmatched(df.where("page_id < 3")).isEmpty()


def test_repeated_rows_make_one_response(spark):
    rows = [(1, "u", BIG)] * 300 + [(None, None, BIG + "y")] * 50 + [(i, "v", "z" * 2000) for i in range(200)]
    got = warc.round_trip(pages(spark, rows).repartition(7)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
