"""Chat formatting and WARC archives: exact round trips."""

import base64
import gzip
import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trellis.llm import chat, warc
from trellis.llm.common import scratch_path

PIECES = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "<", "\n", "\n</turn>\n", "### assistant: ", ": ", "a", "é", " "]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.CLOSE.strip() not in chat.escape(text).replace("\\" + chat.CLOSE.strip(), "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "a: b\n%"]), PIECES), PIECES), max_size=5))
def test_turns_round_trip(turns):
    assert chat.parse("".join(chat.render_turn(r, t)[0] for r, t in turns)) == turns


def test_examples_and_digests(spark):
    probe = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", probe), (1, 2, "user", None), (1, 3, "assistant", "ü\\"), (1, 4, "user", "bye"),
            (2, 0, "user", "alone"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 1, None, "x"), (4, None, "user", "z" * 50000), (4, 1, "assistant", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.expand(df)
    ex = sorted((r for r in examples.collect() if r.conv_id == 1), key=lambda r: len(r.formatted))
    assert [(r.target, r.last, r.n_context) for r in ex] == [(True, False, 1), (True, False, 3), (False, True, 5)]
    assert [chat.unescape(r.formatted[r.loss_start : r.loss_end]) for r in ex] == [probe, "ü\\", ""]
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [((r[2] or ""), (r[3] or "")) for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        g = got[conv]
        assert (g.n_turns, g.loss_chars) == (len(turns), len(loss))
        assert g.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


PAGES = [(4, "http://a/x", "<p>same"), (2, "http://b/y", "<p>same"), (9, None, None), (8, "u", ""), (1, "v", "é" * 70000), (3, "w", "\x1f\x8b\x08 <p>"),
         (2, "http://b/y", "<p>same"), (None, "n", "<p>same"), (12, "two\r\nlines", "WARC/1.1\r\n\r\n")]


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = min((j for j, _, g in rows if j is not None and (g or "").encode() == body), default=None)
        again = i != first and len(body) >= least
        out.append((str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", str(first if again else None)))
    return sorted(out)


@pytest.mark.parametrize("split", [7, 100, 1 << 20])
def test_round_trip_by_byte_ranges(spark, split):
    df = spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, first string")
    got = warc.payload_digests(warc.round_trip(df, split)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute(PAGES)


def test_least_bytes_and_empty(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.mark_revisits(df, 3).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted((b[0], b[3], b[4]) for b in brute(PAGES, 3))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_a_task_for_each_byte_range(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}" * 50) for i in range(60)], "page_id long, url string, html string")
    files = warc.write_archives(warc.mark_revisits(df), scratch_path(spark, "t"))
    ranges = sum(-(-f.bytes // 300) for f in files.collect())
    read = warc.read_archives(files, 300)
    assert ranges > 20 and read.rdd.getNumPartitions() == ranges and read.count() == 60
    whole = warc.read_archives(files, 1 << 20)
    assert whole.select(F.spark_partition_id()).distinct().count() == files.filter("records > 0").count()


def test_archives_roll_and_are_plain_gzip(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}" * 50) for i in range(40)], "page_id long, url string, html string")
    files = warc.write_archives(warc.mark_revisits(df).coalesce(1), scratch_path(spark, "t"), archive_bytes=2000).collect()
    assert len(files) > 3 and sum(f.records for f in files) == 40
    with open(files[0].file.removeprefix("file:"), "rb") as f:
        assert gzip.decompress(f.read()).count(b"WARC/1.1\r\n") == files[0].records


def test_every_record_has_one_owner():
    """False magic in the data and between members; every split of the file owns each record once."""
    bodies = [b"WARC/1.1\r\nx: %d\r\n\r\n" % i + bytes([0x1F, 0x8B, 8]) * i for i in range(30)]
    data = b"".join(warc._member(b, 0 if i % 2 else 6) for i, b in enumerate(bodies))
    for step in (1, 13, 64, 1000, len(data)):
        found = [c for a in range(0, len(data), step) for _, c in warc.records_in(io.BytesIO(data), a, min(a + step, len(data)), len(data))]
        assert found == bodies
    nested = warc._member(b"WARC/1.1\r\n\r\n" + warc._member(bodies[3], 6) + b"tail", 0) + warc._member(bodies[4], 6)
    found = [c for a in range(0, len(nested), 9) for _, c in warc.records_in(io.BytesIO(nested), a, min(a + 9, len(nested)), len(nested))]
    assert found[-1] == bodies[4] and len(found) == 2
    with pytest.raises(ValueError):
        list(warc.records_in(io.BytesIO(data[:-5]), 0, len(data) - 5, len(data) - 5))
