import base64
import gzip
import hashlib
import io
import random
import time

import pytest

from latentmesh.llm import warc

from .fixtures import words

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_round_trip_in_chunks(spark):
    rng = random.Random(0)
    rows = [(i, f"http://x/{i}", words(rng, rng.randint(1, 2000)) + "é") for i in range(40)]
    got = sorted(warc.chunked(pages(spark, rows).repartition(3), 1000).collect(), key=lambda r: (r.page_id, r.chunk_no))
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, url, html in rows:
        data, parts = html.encode(), by[i]
        assert b"".join(bytes(p.payload) for p in parts) == data
        assert [p.chunk_no for p in parts] == list(range(-(-len(data) // 1000)))
        assert all(p.length <= 1000 and p.total == len(data) and p.url == url for p in parts)
        assert all(p.digest == hashlib.sha256(data[: p.start + p.length]).hexdigest() for p in parts)
        assert [p.intact for p in parts] == [None] * (len(parts) - 1) + [True]


def test_awkward_rows(spark):
    rows = [(1, "http://a", None), (2, None, ""), (None, "http://b\r\nX: y", "text"), (3, "http://c", "same"), (3, "http://c", "same"), (4, "u", "WARC/1.1\r\n\r\n" * 5), (5, "u", "x" * 3_000_000)]
    docs = pages(spark, rows)
    docs = docs.selectExpr("*", "1 AS digest", "'x' AS payload", "2 AS file")
    got = warc.chunked(docs, 1 << 16).collect()
    by = {}
    for r in got:
        by.setdefault((r.page_id, r.file, r.position), []).append(r)
    whole = sorted((k[0] or -1, b"".join(bytes(r.payload) for r in sorted(v, key=lambda r: r.chunk_no)).decode()) for k, v in by.items())
    assert whole == sorted((i or -1, h or "") for i, _, h in rows)
    assert len({r.record_id for r in got if r.page_id == 3}) == 1
    assert max(r.chunk_no for r in got if r.page_id == 5) == 45
    assert [r.length for r in got if r.page_id == 1] == [0]
    assert all(r.intact for v in by.values() for r in v if r.start + r.length == r.total)


def test_empty_table(spark):
    assert warc.chunked(pages(spark, [(1, "u", "h")]).where("false")).count() == 0


def parsed(data, chunk=10):
    return list(warc.records(warc._Stream(io.BytesIO(data)), chunk))


def record(k, body, url="u"):
    return warc._headers(k, url, hashlib.sha256(body).hexdigest(), len(body)) + body + b"\r\n\r\n"


def bodies_of(got):
    out = {}
    for r in got:
        out[r["page_id"]] = out.get(r["page_id"], b"") + r["payload"]
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_streams_plain_and_gzip(packed):
    bodies = [b"", b"0123456789", b"x" * 25, bytes(range(256)) * 3]
    got = parsed(b"".join(gzip.compress(record(k, b)) if packed else record(k, b) for k, b in enumerate(bodies)))
    assert bodies_of(got) == dict(enumerate(bodies))
    assert all(len(r["payload"]) <= 10 for r in got)
    assert parsed(gzip.compress(b"".join(record(k, b) for k, b in enumerate(bodies)))) == parsed(b"".join(record(k, b) for k, b in enumerate(bodies)))


def test_cut_and_changed_records_are_told():
    whole = record(1, b"a" * 50)[:-4]
    assert parsed(whole)[-1]["intact"] is True
    assert parsed(whole[:-7])[-1]["intact"] is False
    assert parsed(whole[:-1] + b"b")[-1]["intact"] is False
    noise = record(1, random.Random(0).randbytes(50))[:-4]
    assert parsed(gzip.compress(noise))[-1]["intact"] is True
    for lost in (12, 30, 60, 200):
        cut = parsed(gzip.compress(noise)[:-lost])
        assert cut[-1]["intact"] is False and all(r["intact"] is None for r in cut[:-1])
    assert parsed(b"") == []


def spoiled(member, at, n=6):
    return member[:at] + bytes(255 - x for x in member[at : at + n]) + member[at + n :]


def test_reading_goes_on_after_a_damaged_member():
    rng = random.Random(3)
    bodies = [rng.randbytes(n) for n in (300, 40_000, 20, 150_000, 7)]
    members = [gzip.compress(record(k, b)) for k, b in enumerate(bodies)]
    for bad in range(5):
        for at in (0, 3, 11, 40, len(members[bad]) // 2, len(members[bad]) - 40, len(members[bad]) - 8):
            got = parsed(b"".join(spoiled(m, at) if k == bad else m for k, m in enumerate(members)), 1 << 16)
            assert {k: b for k, b in bodies_of([r for r in got if r["page_id"] not in (bad, None)]).items()} == {k: b for k, b in enumerate(bodies) if k != bad}
            mine = [r for r in got if r["page_id"] in (bad, None)]
            assert mine and mine[-1]["intact"] is False, (bad, at)
            assert [r["intact"] for r in got if r["page_id"] not in (bad, None) and r["start"] + r["length"] == r["total"]] == [True] * 4


def test_every_digest_is_compared_or_not_vouched_for():
    body = b"some text"
    of = lambda *lines: parsed(("\r\n".join(["WARC/1.0", f"Content-Length: {len(body)}", *lines]) + "\r\n\r\n").encode() + body, 99)[-1]["intact"]
    sha1 = hashlib.sha1(body).digest()
    assert of("WARC-Block-Digest: sha1:" + base64.b32encode(sha1).decode()) is True
    assert of("WARC-Block-Digest: SHA1:" + sha1.hex().upper()) is True
    assert of("WARC-Block-Digest: sha1:" + base64.b32encode(sha1[::-1]).decode()) is False
    assert of("WARC-Block-Digest: md5:" + hashlib.md5(body).hexdigest()) is True
    assert of("WARC-Block-Digest: crc9:00") is None
    assert of() is None


def test_foreign_headers_and_what_is_no_record():
    odd = b"WARC/1.0\r\nContent-Length: 1\r\nX-Page-ID: seven\r\n: x\r\nnocolon\r\n\r\na\r\n\r\n"
    assert [(r["page_id"], r["payload"], r["intact"]) for r in parsed(odd)] == [(None, b"a", None)]
    without = b"WARC/1.0\r\nWARC-Record-ID: <x>\r\n\r\nlost\r\n\r\n"
    got = parsed(without + b"\r\nnoise\r\n" + record(5, b"kept"))
    assert [(r["record_id"], r["total"], r["intact"]) for r in got][0] == ("<x>", None, False)
    assert (got[-1]["page_id"], got[-1]["payload"], got[-1]["intact"]) == (5, b"kept", True)
    assert all(r["intact"] is False for r in got[:-1])
    endless = b"WARC/1.0\r\nX: " + b"y" * (3 << 20) + b"\r\n\r\n" + record(6, b"after")
    got = parsed(endless)
    assert got[0]["intact"] is False and got[-1]["payload"] == b"after"


def test_many_records_of_one_member_take_linear_time():
    data = gzip.compress(b"".join(record(k, b"text %d" % k) for k in range(40_000)))
    began = time.process_time()
    assert sum(1 for _ in warc.records(warc._Stream(io.BytesIO(data)), 1000)) == 40_000
    assert time.process_time() - began < 10


def test_addresses_come_back_as_they_were(spark):
    urls = ["http://a/ b", " lead", "trail ", "a\r\nX-Page-ID: 9", "100%25 \u2028 é", "", None, "a\tb"]
    got = warc.chunked(pages(spark, [(k, u, "h") for k, u in enumerate(urls)])).collect()
    assert {r.page_id: r.url for r in got} == dict(enumerate(urls))


def test_memory_stays_bounded():
    import tracemalloc

    class Long(io.RawIOBase):
        """A record of 200 MB that is never whole."""

        def __init__(self):
            self.head, self.left = b"WARC/1.1\r\nContent-Length: 200000000\r\n\r\n", 200_000_000

        def read(self, n=-1):
            if self.head:
                out, self.head = self.head[:n], self.head[n:]
                return out
            n = min(n, self.left)
            self.left -= n
            return b"z" * n

    tracemalloc.start()
    total = sum(r["length"] for r in warc.records(warc._Stream(Long()), 1 << 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 200_000_000 and peak < 16 << 20


def test_report_equals_sql(spark, monkeypatch):
    import duckdb

    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", words(rng, n)) for i, n in enumerate((0, 1, 50, 9_000, 20_000))] + [(9, None, None)]
    got = warc.report(pages(spark, rows)).toPandas()
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(r) for r in rows])
    want = con.sql(warc.SQL).df()[list(got.columns)]
    assert len(want) > len(rows)
    plain = lambda d: sorted(map(tuple, d.astype(object).where(d.notna(), None).astype(str).to_numpy()))
    assert plain(got) == plain(want)


def test_names_and_ids_of_any_kind(spark):
    rows = spark.createDataFrame([("1", "u", "a", 0), ("x", "v", "b", 0)], "Page_ID string, URL string, Html string, `a.b` int")
    assert {(r.page_id, r.url, bytes(r.payload)) for r in warc.chunked(rows).collect()} == {(1, "u", b"a"), (None, "v", b"b")}
