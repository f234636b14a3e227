"""Streaming ingestion of landed files: whole chains per file, idempotent batches."""

import json
import os
import tempfile

from trellis.streaming.landing import ingest


def _write(path, rows):
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_ingest_stream(spark):
    d = tempfile.mkdtemp(prefix="trellis-stream-")
    src, out, ck = (os.path.join(d, x) for x in ("src", "out", "ck"))
    os.makedirs(src)
    base = {"snapshot_date": "2024-03-05", "label": "pages", "parent_key": "S1", "ok": True}
    _write(os.path.join(src, "a.json"), [
        dict(base, request_id="r1", page_no=0, body=json.dumps({"results": [{"id": "p1"}, {"id": "p2"}]})),
        dict(base, request_id="r1", page_no=1, body=json.dumps({"results": [{"id": "p3"}]})),
    ])
    _write(os.path.join(src, "b.json"), [
        dict(base, request_id="r2", page_no=0, body=json.dumps({"results": [{"id": "p4"}]})),
        dict(base, request_id="r2", page_no=1, ok=False, body=None),
    ])
    q = ingest(spark, src, out, ck, once=True)
    q.awaitTermination(120)
    got = sorted(r["_json"] for r in spark.read.parquet(out).collect())
    assert got == ['{"_id":"p1"}', '{"_id":"p2"}', '{"_id":"p3"}']
    # a second run finds nothing new and adds nothing
    q = ingest(spark, src, out, ck, once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
