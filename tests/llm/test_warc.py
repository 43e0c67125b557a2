"""Archives: round trips, revisits, and what the reader saves from damaged files."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import pytest

from equipoise.llm import warc
from equipoise.llm.warc import Gap, _Source, read_archives, record_bytes, salvage, write_archives


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, path string")


def found(data):
    return list(salvage(_Source(lambda n, i: data[i : i + n], len(data))))


@pytest.fixture
def packed():
    return [gzip.compress(record_bytes(str(i), f"http://h/{i}", f"body {i} ".encode() * 50, None), mtime=0) for i in range(6)]


def ids(found):
    return [x.headers["warc-record-id"] for x in found if not isinstance(x, Gap)]


def test_whole_archives_have_no_gap(packed):
    assert ids(found(b"".join(packed))) == [f"<urn:row:{i}>" for i in range(6)]
    assert not any(isinstance(x, Gap) for x in found(b"".join(packed)))
    plain = b"".join(gzip.decompress(p) for p in packed)
    assert ids(found(plain)) == ids(found(gzip.compress(plain))) == ids(found(b"".join(packed)))
    assert found(b"") == []


@pytest.mark.parametrize("damage", ["flip", "zero", "drop", "insert", "cut"])
def test_later_records_are_recovered(packed, damage):
    start = len(packed[0]) + len(packed[1])
    size = len(packed[2])
    middle = bytearray(packed[2])
    if damage == "flip":
        middle[size // 2] ^= 0xFF
    elif damage == "zero":
        middle[:12] = bytes(12)
    elif damage == "drop":
        del middle[20:40]
    elif damage == "insert":
        middle[30:30] = warc.MAGIC + b"junk" + warc.VERSION
    else:
        middle = middle[: size // 2]
    data = packed[0] + packed[1] + bytes(middle) + b"".join(packed[3:])
    got = found(data)
    gaps = [x for x in got if isinstance(x, Gap)]
    assert ids(got) == [f"<urn:row:{i}>" for i in (0, 1, 3, 4, 5)]
    assert [(g.start, g.end) for g in gaps] == [(start, start + len(middle))] and gaps[0].reason


def test_plain_records_with_wrong_digest_or_length_are_quarantined(packed):
    plain = [gzip.decompress(p) for p in packed]
    bad = plain[1].replace(b"body 1", b"BODY 1", 1)
    short = plain[3].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    got = found(b"".join([plain[0], bad, plain[2], short, *plain[4:]]))
    assert ids(got) == ["<urn:row:0>", "<urn:row:2>", "<urn:row:4>", "<urn:row:5>"]
    assert [x.reason for x in got if isinstance(x, Gap)] == ["block digest differs", "record is cut off"]
    assert [type(x) for x in found(b"no archive at all")] == [Gap]


def test_payload_that_looks_like_records(packed):
    inner = gzip.decompress(packed[0]) + packed[1]
    assert ids(found(record_bytes("9", None, inner, None) + packed[2])) == ["<urn:row:9>", "<urn:row:2>"]


def test_table_round_trip(spark, tmp_path):
    long = "ü" * 3_000_000
    rows = [(4, "http://a b/\r\nX: y", "same"), (2, None, "same"), (9, "u", "same"), (2, "u", "same"), (5, "u", None), (6, "", ""), (None, "u", "same"), (7, "u", long)]
    table = pages(spark, [(*r, "x") for r in rows])
    archives = write_archives(table, f"{tmp_path}/w", "page_id", "url", "html")
    got = read_archives(archives)
    assert got.where("error IS NOT NULL").count() == 0 and archives.agg({"records": "sum"}).first()[0] == len(rows)
    result = sorted(((r["record_id"] or "", r["warc_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got.collect()), key=str)
    n = {"same": 4, "": 0, long: 6_000_000}
    want = []
    for k, _, html in rows:
        html = html or ""
        refers = {4: "2", 9: "2", 6: "5"}.get(k)
        want.append(("" if k is None else str(k), "revisit" if refers else "response", refers, n[html], digest(html.encode())))
    assert result == sorted(want, key=str)
    assert {bytes(r["payload"]) for r in got.where("record_id = 7").collect()} == {long.encode()}
    assert next(r["target_uri"] for r in got.where("record_id = 4").collect()) == "http://a%20b/%0D%0AX:%20y"


def test_short_payloads_are_all_responses(spark, tmp_path):
    table = pages(spark, [(1, "u", "abc", ""), (2, "u", "abc", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")])
    got = read_archives(write_archives(table, f"{tmp_path}/w", "page_id", "url", "html", min_bytes=5)).collect()
    assert {r["record_id"]: r["refers_to"] for r in got} == {"1": None, "2": None, "3": None, "4": "3"}


def test_empty_table(spark, tmp_path):
    archives = write_archives(pages(spark, []), f"{tmp_path}/w", "page_id", "url", "html")
    assert archives.count() == 0 and read_archives(archives).count() == 0


def test_query_against_the_table(spark):
    from equipoise.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["page_id"]: tuple(r)[1:] for r in QUERIES["op4_warc"](spark, sf).collect()}
    html = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for k in sorted(html):
        first.setdefault(html[k], k)
    want = {}
    for k, h in html.items():
        again = first[h] != k
        want[k] = (len(h), digest(h), "revisit" if again else "response", first[h] if again else None)
    assert got == want


def test_no_row_is_lost_to_a_long_header(spark, tmp_path):
    table = pages(spark, [(1, "http://h/" + "漢" * 500_000, "abc", ""), (2, "u", "abcd", "")])
    got = read_archives(write_archives(table, f"{tmp_path}/w", "page_id", "url", "html")).collect()
    assert sorted(r["record_id"] or r["error"] for r in got) == ["1", "2"]
    assert warc.archive_round_trip(spark, table, "page_id", "url", "html").count() == 2


@pytest.mark.parametrize("damage", ["gap", "fewer"])
def test_archives_that_lack_a_record_fail_where_their_number_is_told(spark, tmp_path, packed, damage):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(packed[:5]) + (b"junk" if damage == "gap" else b""))
    paths = spark.createDataFrame([(f"{tmp_path}/a.warc.gz", 5 if damage == "gap" else 6)], "path string, records long")
    assert read_archives(paths).where("error IS NULL").count() == 5
    with pytest.raises(Exception, match="no version line|header does not end|5 records of 6"):
        read_archives(paths, records="records").collect()


@pytest.mark.parametrize("spacing", [1 << 23, 3000])
def test_one_member_for_all_records(monkeypatch, spacing):
    """What lies before a cut, a wrong byte or a wrong trailer comes back, from content that is kept or inflated again."""
    monkeypatch.setattr(warc, "SPACING", spacing)
    if spacing == 3000:
        monkeypatch.setattr(warc, "FETCH", 2000)
        monkeypatch.setattr(warc, "PIECE", 500)
    rng = random.Random(1)
    bodies = [rng.randbytes(rng.choice([10, 900, 5000])) for _ in range(20)]
    plain = [record_bytes(str(i), "http://h/", body, None) for i, body in enumerate(bodies)]
    packed = gzip.compress(b"".join(plain))
    want = [f"<urn:row:{i}>" for i in range(20)]
    assert ids(found(packed)) == want and not gaps(packed)
    cut = packed[: len(packed) * 9 // 10]
    got = zlib.decompressobj(wbits=31).decompress(cut)
    whole = sum(sum(map(len, plain[: i + 1])) <= len(got) for i in range(20))
    assert 15 <= whole < 20 and ids(found(cut)) == want[:whole]
    assert [g.reason for g in gaps(cut)] == ["member is cut off"] and gaps(cut)[0].end == len(cut)
    assert ids(found(packed[:-8] + bytes(8))) == want and len(gaps(packed[:-8] + bytes(8))) == 1
    next_ = gzip.compress(record_bytes("next", None, b"more", None))
    assert ids(found(cut + next_)) == [*want[:whole], "<urn:row:next>"]
    assert ids(found(packed[:-8] + bytes(8) + next_)) == [*want, "<urn:row:next>"]
    bare = [re.sub(rb"WARC-(Block|Payload)-Digest: [^\r]*\r\n", b"", p) for p in plain]
    assert ids(found(gzip.compress(b"".join(bare)))) == want
    assert ids(found(gzip.compress(b"".join(bare))[:-8] + bytes(8))) == []  # nothing vouches for them


def gaps(data):
    return [x for x in found(data) if isinstance(x, Gap)]
