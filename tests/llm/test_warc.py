from __future__ import annotations

import gzip
import hashlib
import io
import os
from base64 import b32encode

import pytest

from outcomelens.llm import warc as W
from outcomelens.llm.common import store_of

SCHEMA = "page_id long, url string, html string, payload string"


def pages():
    rows = [(k, f"http://h{k % 3}.example/p {k}\r\nX: y", f"<p>{k}</p>" * (k * 40 % 977), "x") for k in range(60)]
    rows += [(100 + k, "http://copy", "<p>the same ä</p>" * 500, None) for k in range(30)]
    return rows + [(200, None, None, "x"), (201, "u", "", "x"), (202, "u", "WARC/1.1\r\n\r\n\x1f", "x"), (203, "u", "long " * 400_000, "x"), (None, "u", "null id", "x")]


def expected(rows, least=0):
    digest = lambda b: b32encode(hashlib.sha1(b).digest()).decode()
    first: dict = {}
    for i, _, html, _ in rows:
        body = (html or "").encode()
        if i is not None:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        again = len(body) >= least and i is not None and first[body] != i
        out.append((i, len(body), digest(body), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1, 100])
def test_round_trip(spark, scratch, least):
    rows = pages()
    got = W.archive(spark.createDataFrame(rows, SCHEMA).repartition(4), scratch, least).collect()
    shown = [(W_page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, W_page(r.refers_to)) for r in got]
    assert sorted(shown, key=repr) == expected(rows, least)
    html = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in got:
        if r.record_type == "response":
            assert bytes(r.payload) == html[W_page(r.record_id)]
        else:
            assert r.payload is None


def save(spark, rows, scratch, folder, mode="append"):
    W.register(spark)
    for records in W.page_records(spark.createDataFrame(rows, SCHEMA), scratch):
        records.write.format("warc").mode(mode).save(folder)
        mode = "append"


def W_page(urn):
    return None if urn in (None, "<urn:page:null>") else int(urn[10:-1])


def test_pushed_predicates_and_skipped_payloads(spark, scratch, monkeypatch):
    folder = scratch.folder("warc")
    save(spark, pages(), scratch, folder)
    read = spark.read.format("warc").load(folder)
    chosen = read.where("record_type = 'revisit'")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert chosen.count() == sum(r[3] == "revisit" for r in expected(pages()))
    assert read.where("record_type in ('response', 'x') and target_uri = 'u'").count() == 3
    assert read.where("refers_to is not null").count() == chosen.count()
    heads = spark.read.format("warc").option("payload", "false").load(folder).collect()
    assert len(heads) == len(pages()) and all(r.payload is None and r.payload_bytes is not None for r in heads)


def test_rejected_records_are_not_inflated():
    row = {"payload": os.urandom(200_000), "record_type": "response", "record_id": "<urn:page:1>", "target_uri": "u", "payload_digest": None, "payload_bytes": None, "refers_to": None}
    data = W.member(W.record_bytes(row)) + W.member(W.record_bytes(row | {"record_id": "<urn:page:2>"}))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.taken += len(got)
            return got

    got = list(W.records(Counted(data), lambda r: r["record_id"] == "<urn:page:2>", payload=False))
    assert [r["record_id"] for r in got] == ["<urn:page:2>"] and Counted.taken < 20_000
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 2  # other readers see plain gzip members


def test_members_without_lengths():
    row = {"payload": b"abc" * 5000, "record_type": "response", "record_id": "<urn:page:1>", "target_uri": None, "payload_digest": None, "payload_bytes": None, "refers_to": None}
    data = gzip.compress(W.record_bytes(row)) + gzip.compress(W.record_bytes(row | {"payload": b""}))
    for payload in (True, False):
        assert [r["payload_bytes"] for r in W.records(io.BytesIO(data), lambda r: True, payload)] == [15_000, 0]


def test_files_of_failed_tasks_are_not_read(spark, scratch):
    folder = scratch.folder("warc")
    save(spark, pages()[:5], scratch, folder)
    store, path = store_of(folder)
    with store.open_output_stream(f"{path}/part-000009-77-0-dead.warc.gz", compression=None) as f:
        f.write(b"\x1f\x8b half a record")
    assert spark.read.format("warc").load(folder).count() == 5


def test_empty_table(spark, scratch):
    assert W.archive(spark.createDataFrame([], SCHEMA), scratch).count() == 0


def test_cut_off_members_and_plain_files_are_refused(tmp_path):
    row = {"payload": os.urandom(20_000), "record_type": "response", "record_id": "<urn:page:1>", "target_uri": "u", "payload_digest": None, "payload_bytes": None, "refers_to": None}
    for make in (W.member, gzip.compress):
        one = make(W.record_bytes(row))
        for accept, payload in ((lambda r: True, True), (lambda r: True, False), (lambda r: False, True)):
            assert len(list(W.records(io.BytesIO(one + gzip.compress(b"") + one), lambda r: True, payload))) == 2
            for cut in (one[:60], one[:5_000], one[:-1]):
                with pytest.raises(ValueError, match=f"f.warc.gz: the member at byte {len(one)} "):
                    list(W.records(io.BytesIO(one + cut), accept, payload, "f.warc.gz"))
            with pytest.raises(ValueError, match="byte 0 "):
                list(W.records(io.BytesIO(gzip.compress(b"no header") + one), accept, payload))
    (tmp_path / "a.warc").write_bytes(W.record_bytes(row))
    with pytest.raises(ValueError, match="a.warc"):
        W.WarcReader({"path": str(tmp_path)}).partitions()


def test_appends_unite_and_overwrites_replace(spark, scratch):
    folder = scratch.folder("warc")
    save(spark, pages()[:7], scratch, folder)
    save(spark, pages()[7:20], scratch, folder)
    assert spark.read.format("warc").load(folder).count() == 20
    save(spark, pages()[20:23], scratch, folder, "overwrite")
    got = spark.read.format("warc").load(folder).collect()
    assert sorted(W_page(r.record_id) for r in got) == [20, 21, 22]
    store, path = store_of(folder)
    left = {n for m in W._manifests(store, path) for n in W._listed(store, m)}
    assert {x.base_name for x in store.get_file_info(W.fs.FileSelector(path)) if x.base_name.startswith("part-")} == left


def foreign(k, body, more=""):
    """A record as other tools write it, without the source's own header."""
    block = W.HTTP_HEAD + body
    digest = hashlib.sha1(body).hexdigest()
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{k}>\r\nWARC-Target-URI: u{k}\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n"), b32encode(bytes.fromhex(digest)).decode()


@pytest.mark.parametrize("stated", [False, True])
def test_foreign_archives_with_every_predicate(spark, tmp_path, stated):
    W.register(spark)
    body = b"x" * 150
    digest = hashlib.sha1(body).hexdigest()
    data, told = foreign(1, body, f"WARC-Payload-Digest: sha1:{digest}\r\n" if stated else "")
    other, _ = foreign(2, b"y" * 10)
    (tmp_path / "a.warc.gz").write_bytes(data + other)
    read = spark.read.format("warc").load(str(tmp_path))
    for where in (
        "payload_bytes = 150", "payload_bytes in (150, 3)", f"payload_digest = '{told}'", "target_uri = 'u1'", "record_id = '<urn:x:1>'", "payload_bytes > 20",
        "record_type = 'response' and payload_bytes = 150 and payload_digest is not null", "refers_to is null and target_uri in ('u1', 'z')",
    ):
        assert [r.record_id for r in read.where(where).collect()] == ["<urn:x:1>"], where
    assert read.where("refers_to is not null").count() == read.where("payload_bytes = 151").count() == 0


def test_payloads_are_not_dealt_out(spark, scratch):
    docs = scratch.table(spark.createDataFrame(pages(), SCHEMA))
    held = len(scratch.paths)
    responses, revisits = W.page_records(docs, scratch)
    assert not any("keyed" in path for path in scratch.paths[held:])  # no second copy of the pages
    plan = responses._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert "html" not in revisits._jdf.queryExecution().executedPlan().toString()


def test_told_lengths_are_read_exactly():
    row = {"payload": os.urandom(300_000), "record_type": "response", "record_id": "<urn:page:1>", "target_uri": "u", "payload_digest": None, "payload_bytes": None, "refers_to": None}
    data = W.member(W.record_bytes(row)) * 3

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.taken += len(got)
            return got

    assert len(list(W.records(Counted(data), lambda r: True))) == 3 and Counted.taken == len(data)
