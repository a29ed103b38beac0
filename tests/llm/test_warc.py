import hashlib
from collections import Counter

from papyra.llm.warc import archive_records, archive_round_trip, dictionary_frame, parse_record, read_archives, record_bytes, train_dictionary
from papyra.workspace import Workspace

SCHEMA = "page_id long, url string, html string, payload string, digest int"


def pages(n=200):
    rows = [(i, f"http://host/{i} x\n", f"<p>page {i % 61} " + "wörd " * (i % 61 * 7), "clash", 1) for i in range(n)]
    rows += [(1000, None, None, "c", 1), (1001, "u", "", "c", 1), (1002, "u", "short", "c", 1), (1003, "u", "short", "c", 1), (None, "u", rows[60][2], "c", 1), (2000, "long", "é" * 3_000_000, "c", 1)]
    return rows + [rows[50], rows[50]]


def test_round_trip(spark):
    rows = pages()
    work = Workspace(spark, "warc-test")
    got = archive_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3), work, roll_bytes=20_000).collect()
    assert len(got) == len(rows) and not [r for r in got if r.error]
    payloads = {r[0]: (r[2] or "").encode() for r in rows}
    first = {}
    for i, p in payloads.items():
        if i is not None:
            first[p] = min(first.get(p, i), i)
    for r in got:
        p = payloads[r.page_id]
        revisit = len(p) >= 100 and first[p] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha256(p).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[p]) if revisit else ("response", None))
        assert r.payload == (None if revisit else p)
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    assert len({r.archive for r in got}) > 3


def test_dictionary_and_damage(spark, tmp_path):
    table = spark.createDataFrame([(i, f"<html><body>page number {i} of the same site, " + str(i * 7919) * 9) for i in range(300)], "page_id long, text string")
    dictionary = train_dictionary(table.selectExpr("page_id", "cast(text as binary) as payload"))
    assert dictionary
    import zstandard

    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    records = [record_bytes(i, "u", b"payload" * i, hashlib.sha256(b"payload" * i).hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(5)]
    frames = [packer.compress(r) for r in records]
    whole = dictionary_frame(dictionary) + b"".join(frames)
    assert [r for _, r, _ in archive_records(whole)] == records
    broken = bytearray(whole)
    broken[len(whole) - len(frames[4]) - len(frames[3]) + len(frames[3]) // 2] ^= 0xFF
    found = list(archive_records(bytes(broken)))
    assert [r for _, r, _ in found if r] == records[:3] + records[4:] and sum(e is not None for _, _, e in found) >= 1
    assert list(archive_records(whole[:-3]))[-1][2]
    wrong = record_bytes(9, "u", b"abc", "0" * 64, None, "2024-01-01T00:00:00Z")
    (tmp_path / "a.warc.zst").write_bytes(whole + packer.compress(wrong))
    read = read_archives(spark, f"file://{tmp_path}").collect()
    assert len(read) == 6 and [r.error is None for r in sorted(read, key=lambda r: r.offset)] == [True] * 5 + [False]
    for bad in (b"", records[1][:-1], records[1].replace(b"WARC-Date", b"Date"), b"HTTP/1.1\r\n\r\n"):
        try:
            parse_record(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_empty_table(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA), Workspace(spark, "warc-test")).count() == 0
