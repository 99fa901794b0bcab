import base64
import hashlib
import random
import struct

import pytest
import zstandard

from checks.compare import difference, duck
from tablekeep.llm import queries, warc
from tablekeep.session import scratch_dir

SF_DIR = "/root/testdata/sf0.001"
ROWS = [
    (5, "http://a", "same page"), (3, "http://b", "same page"), (9, None, None), (7, "u", ""), (8, "with blank\r\nX: y", "ü\r\n\r\nbody\r\n\r\n"),
    (None, "n", "same page"), (None, "n", "alone"), (3, "http://b", "same page"), (11, "v", "P*M\x18\x00\x00\x00\x00"),
]


def pages_of(docs_of, rows):
    return docs_of(rows, "page_id long, url string, html string")


def test_round_trip(docs_of):
    rows = warc.round_trip(pages_of(docs_of, ROWS).repartition(4)).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kinds = {5: 3, 9: 7}
    expected = [(i, len((t or "").encode()), digest(t), "revisit" if i in kinds or (i, t) == (None, "same page") else "response", kinds.get(i, 3 if (i, t) == (None, "same page") else None)) for i, _, t in ROWS]
    mine = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(mine, key=repr) == sorted(expected, key=repr)
    texts = {i: (t or "").encode() for i, _, t in ROWS}
    assert all(bytes(r["payload"]) == texts[r["page_id"]] for r in rows if r["record_type"] == "response" and r["page_id"])


def test_small_payloads_are_no_revisits_on_demand(docs_of):
    rows = warc.round_trip(pages_of(docs_of, ROWS), min_revisit_bytes=5).collect()
    assert {r["page_id"]: r["record_type"] for r in rows if r["page_id"] in (7, 9)} == {7: "response", 9: "response"}


def test_no_pages_give_no_records(docs_of):
    assert warc.round_trip(pages_of(docs_of, ROWS).limit(0)).collect() == []


def test_archives_are_cut_and_begin_with_their_dictionary(spark, docs_of):
    draw = random.Random(4)
    rows = [(k, f"http://x/{k}", "<p>" + " ".join(draw.choices(["alpha", "beta", "gamma", "delta"], k=300))) for k in range(300)]
    path = scratch_dir(spark, "archives")
    warc.write_archives(pages_of(docs_of, rows), path, archive_bytes=100_000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").collect()
    assert len(files) > 3
    for file in files:
        content = bytes(file["content"])
        magic, size = struct.unpack_from("<II", content)
        assert magic == 0x184D2A5D and size > 0
        found = zstandard.ZstdCompressionDict(content[8 : 8 + size])
        first = zstandard.ZstdDecompressor(dict_data=found).decompressobj().decompress(content[8 + size + 8 :])
        assert first.startswith(b"WARC/1.1\r\n") and first.endswith(b"\r\n\r\n")
    assert sum(f["length"] for f in files) < sum(len(r[2]) for r in rows) / 2
    back = warc.read_archives(spark, path).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back} == {r[0]: r[2] for r in rows}


def test_a_broken_payload_is_noticed():
    one = warc.record(1, "u", b"payload", None, False)
    assert warc.parsed(one)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(one.replace(b"\r\n\r\npayload", b"\r\n\r\npaYload"))


def test_query_equals_sql(spark):
    assert difference(queries.op4_warc(spark, SF_DIR), duck(SF_DIR), queries.ORACLES["op4_warc"]) is None


def test_an_archive_that_is_cut_off_is_an_error():
    frames = list(warc.archive_frames(iter([f"record {k} ".encode() * 50 for k in range(20)])))
    whole = b"".join(frames)
    assert len(list(warc.read_archive(whole))) == 20
    for lost in (1, 20, len(frames[-1]) - 1):
        with pytest.raises(ValueError, match="cut off"):
            list(warc.read_archive(whole[:-lost]))
