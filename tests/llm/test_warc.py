import hashlib
import struct

from lodforge.llm import warc
from lodforge.llm.common import table


def brute(rows):
    least, many = {}, {}
    for i, h in rows:
        h = h or ""
        many[h] = many.get(h, 0) + 1
        if i is not None:
            least[h] = min(i, least.get(h, i))
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        first = least.get(h or "")
        revisit = len(raw) >= 100 and many[h or ""] > 1 and first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def digest(frame):
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = [(r["page_id"], r["html"]) for r in pages.collect()]
    read = warc.read_archives(warc.write_archives(pages))
    assert digest(read) == brute(rows)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read.where("record_type = 'response'").collect()} == dict(rows)


def test_cases(spark):
    big = "<p>" + "é" * 200
    rows = [(5, big), (3, big), (9, big), (3, big), (None, big), (1, "small"), (2, "small"), (7, None), (8, ""), (None, "x" * 150), (None, "x" * 150), (10, "long " * 100000)]
    frame = spark.createDataFrame([(i, "http://a b\r\nX: y", h) for i, h in rows], "page_id long, url string, html string").withColumn("digest", warc.F.lit("clash"))
    read = warc.read_archives(warc.write_archives(frame))
    assert digest(read) == brute(rows)
    assert {r["url"] for r in read.collect()} == {"http://a%20b%0D%0AX:%20y"}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_archive_layout():
    import zstandard

    records = [warc.record(i, f"http://x/{i}", b"<p>shared words " * 20 + str(i).encode(), "d", None, "now") for i in range(300)]
    data = warc.archive(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
    assert frame.decompress(data[8 + size :]) == records[0]  # a frame holds one record
    plain = sum(len(zstandard.ZstdCompressor().compress(r)) for r in records)
    assert len(data) < plain


def test_many_repeated_payloads_are_joined_instead(spark, monkeypatch):
    rows = [(k, f"<p>{'text ' * 40}{k % 7}") for k in range(60)] + [(100, None), (None, f"<p>{'text ' * 40}3")]
    frame = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    plain = lambda f: sorted(((r["page_id"], r["digest"], r["refers_to"]) for r in f.collect()), key=str)
    near = warc.with_originals(frame)
    assert "BroadcastHashJoin" in near._jdf.queryExecution().toString()
    monkeypatch.setattr(warc, "REPEATED", 6)
    far = warc.with_originals(frame)
    assert plain(near) == plain(far) and sum(r[2] is not None for r in plain(far)) == 54
    assert digest(warc.read_archives(warc.write_archives(frame))) == brute(rows)
