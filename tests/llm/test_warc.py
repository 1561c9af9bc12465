import gzip
import hashlib
import zlib

import pytest

from tallyline.llm import warc
from tallyline.llm.frames import fresh_path


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = h in first and (i is None or i > first[h])
        out.append((i, "revisit" if again else "response", first[h] if again else None, len(data), hashlib.sha256(data).hexdigest(), b"" if again else data))
    return sorted(out, key=repr)


def test_pages_come_back_as_they_were(spark):
    big = "é" * 60
    rows = [(1, "u\r\nv: x", None), (2, None, big), (3, "u", big), (None, "u", big), (2, "dup", big), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 30), (9, "u", "z" * 900_000), (None, "u", "q" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [(r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in warc.archive_pages(df, payload=True).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_the_normaliser_gives_every_record_a_member_of_its_own(spark):
    pages = spark.range(40).selectExpr("id page_id", "concat('http://x/', id) url", "repeat(concat('p', id, ' '), 5000) html").repartition(2)
    raw, folder = fresh_path(spark, "raw"), fresh_path(spark, "members")
    written = warc.write_archives(warc.with_revisits(pages), raw)
    done = warc.normalise(written, folder)
    again = warc.normalise(done, folder + "-again")  # archives of many members are read alike
    assert {r.records for r in again.collect()} == {r.records for r in written.collect()}
    index = warc.read_index(spark, folder).collect()
    assert sorted(int(r.record_id) for r in index) == list(range(40))
    for source, target in zip(sorted(r.path for r in written.collect()), sorted(r.path for r in done.collect())):
        one, many = (open(p.removeprefix("file://"), "rb").read() for p in (source, target))
        assert gzip.decompress(one) == gzip.decompress(many)
        for r in index:
            if r.path == target:
                fields, payload = warc.read_member(many[r.offset : r.offset + r.length])
                assert payload == f"p{r.record_id} ".encode() * 5000 and zlib.decompressobj(31).decompress(many[r.offset :]).startswith(b"WARC/1.1")


class _Bytes:
    def __init__(self, data):
        self.data = data

    def read(self, n):
        out, self.data = self.data[:n], self.data[n:]
        return out


@pytest.mark.parametrize("cut", [20, -5])
def test_a_damaged_archive_is_an_error(cut):
    header, http, payload = warc.record({"id": 1, "url": "u", "payload": bytes(range(256)) * 4000, "size": 1_024_000, "digest": "d", "record_type": "response", "refers_to": None})
    stream = warc._Inflated(_Bytes(gzip.compress(header + http + payload + b"\r\n\r\n")[:cut]))
    with pytest.raises((ValueError, zlib.error)):
        length = int(warc.fields_of(stream.until(b"\r\n\r\n"))["content-length"])
        list(stream.pieces(length + 4))
        stream.until(b"\r\n\r\n")
