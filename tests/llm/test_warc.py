"""Archives: round trip, and salvage of damaged files."""

import random
import zlib

from linkstats.llm import warc
from linkstats.session import scratch_dir

PAGES = [(1, "http://a/ b", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c", None), (4, "http://d", ""),
         (5, "http://e", "é\r\n\r\nWARC/1.1\r\n" * 50), (None, "http://n", "<p>same</p>"), (6, "x", "y" * 300_000)]


def test_round_trip(spark):
    folder = scratch_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3), folder)
    read = warc.read_warc(spark, folder)
    assert warc.gaps(read).count() == 0
    got = {warc_id: r for r in warc.records(read).collect() for warc_id in [r.record_id]}
    assert len(got) == len(PAGES)
    one, two, null = (got[f"<urn:x-page:{i}>"] for i in (1, 2, "null"))
    assert (one.warc_type, one.refers_to, one.payload, one.url) == ("revisit", "<urn:x-page:2>", None, "http://a/%20b")
    assert (two.warc_type, bytes(two.payload), two.url) == ("response", b"<p>same</p>", None)
    assert null.warc_type == "revisit" and one.payload_digest == two.payload_digest == warc.digest(b"<p>same</p>")
    assert one.payload_bytes == 11 and got["<urn:x-page:4>"].payload_bytes == 0
    assert got["<urn:x-page:3>"].refers_to == "<urn:x-page:4>"
    assert bytes(got["<urn:x-page:5>"].payload).decode() == PAGES[4][2]


def test_small_payloads_may_all_be_responses(spark):
    folder = scratch_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string"), folder, min_payload=100)
    assert {r.warc_type for r in warc.read_warc(spark, folder).collect()} == {"response"}


def test_empty_table_and_columns_of_its_own(spark):
    folder = scratch_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string, sum int, holder int"), folder)
    assert warc.read_warc(spark, folder).count() == 0


def records_of(data):
    found = list(warc.salvage(data))
    assert sum(n for at, n, f, r in found) == len(data)  # every byte is in a record or a gap
    return [f[1] for _, _, f, r in found if f], [(at, n, r) for at, n, f, r in found if r]


def plain(i):
    return warc.record_bytes(i, "http://x", b"payload %d" % i, i, "2024-01-01T00:00:00Z")


def test_salvage_after_damage():
    for parts in ([plain(i) for i in range(5)], [warc.gzip_member(plain(i)) for i in range(5)]):
        whole = b"".join(parts)
        assert records_of(whole) == ([f"<urn:x-page:{i}>" for i in range(5)], [])
        begin, end = len(parts[0]), len(parts[0]) + len(parts[1])
        rest = [f"<urn:x-page:{i}>" for i in (0, 2, 3, 4)]
        for at in (begin, (begin + end) // 2, end - 6):
            hurt = bytearray(whole)
            hurt[at] ^= 0xFF
            ids, gaps = records_of(bytes(hurt))
            assert ids == rest and [g[:2] for g in gaps] == [(begin, end - begin)], at
        cut = whole[:begin + 20] + whole[end:]
        assert records_of(cut)[0] == rest
        ids, gaps = records_of(whole[:-10])
        assert len(ids) == 4 and gaps[0][0] == len(whole) - len(parts[4])
        ids, gaps = records_of(b"junk" + whole + b"\0tail")
        assert len(ids) == 5 and [g[1] for g in gaps] == [4, 5]
    mixed = plain(0) + warc.gzip_member(plain(1)) + b"\x1f\x8b\x08broken" + plain(2)
    assert records_of(mixed)[0] == [f"<urn:x-page:{i}>" for i in range(3)]
    assert records_of(b"") == ([], []) and records_of(b"nothing")[0] == []


def test_members_end_with_a_zero_byte():
    big = bytes(17 << 20)
    member = warc.gzip_member(big)
    assert member[-1] == 0
    first = zlib.decompressobj(31)
    assert len(first.decompress(member)) == len(big) and first.unused_data


def test_salvage_inside_a_member():
    records = [warc.record_bytes(i, "http://x", random.Random(i).randbytes(3000), i, "2024-01-01T00:00:00Z") for i in range(6)]
    names = [f"<urn:x-page:{i}>" for i in range(8)]
    after = warc.gzip_member(plain(6)) + plain(7)

    def read(data):
        found = list(warc.salvage(data))
        return [f[1] for _, _, f, _ in found if f], [(at, n, r) for at, n, f, r in found if r]

    hurt = [bytearray(r) for r in records]
    hurt[2][-100] ^= 0xFF
    member = warc.gzip_member(b"".join(hurt))
    ids, gaps = read(member + after)
    a = len(records[0] + records[1])
    assert ids == names[:2] + names[3:] and len(gaps) == 1 and gaps[0][:2] == (0, len(member))
    assert gaps[0][2].startswith("block digest differs") and f"{a} to {a + len(records[2])}" in gaps[0][2]
    hurt[0][0] ^= 0xFF
    hurt[5][-100] ^= 0xFF
    ids, gaps = read(warc.gzip_member(b"".join(hurt)))
    assert ids == [names[i] for i in (1, 3, 4)] and len(gaps) == 3
    whole = warc.gzip_member(b"".join(records))
    ids, gaps = read(whole[:-2000])
    assert ids == names[:5] and gaps[-1][2] == "gzip member is cut off"
    ids, gaps = read(whole[:len(whole) // 2] + after)
    assert ids == names[:2] + names[6:] or ids == names[:3] + names[6:]
    crc = bytearray(whole)
    crc[-6] ^= 0xFF
    ids, gaps = read(bytes(crc) + after)
    assert ids == names and len(gaps) == 1 and "damaged" in gaps[0][2]
