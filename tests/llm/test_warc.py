"""WARC archives: round trip, push-down, foreign files."""

from __future__ import annotations

import gzip

import pytest
from gleaner.llm import warc
from gleaner.session import shared_path

PAGES = [
    (5, "http://a.example/1", "<p>same</p>", 1),
    (3, "http://b.example/2", "<p>same</p>", 1),
    (3, "http://b.example/2", "<p>same</p>", 1),
    (9, "http://b.example/3", "é" * 100_000, 2),
    (11, None, None, 3),
    (10, "http://c.example/\r\nx", "", 3),
    (None, "http://d.example", "<p>same</p>", None),
    (None, "http://e.example", "alone", None),
    (12, "http://f.example", "WARC/1.1\r\n\r\nWARC-Type: warcinfo\r\n\r\n", 0),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, payload int")


def test_round_trip(pages):
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=repr)
    want = []
    for i, _, html, _ in PAGES:
        body = (html or "").encode()
        first = min((j for j, _, h, _ in PAGES if (h or "") == (html or "") and j is not None), default=None)
        again = first is not None and first != i
        want.append((i or -1, len(body), warc.digest(body), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)


def test_predicates_are_pushed_and_payloads_skipped(spark, pages):
    path = shared_path(spark, "warc-test")
    warc.write_pages(pages, path)
    found = spark.read.format("warc").load(path).where("record_type = 'response' and page_id > 8 and target_uri like 'http://b%'")
    rows = found.collect()
    assert [(r["page_id"], bytes(r["payload"]).decode()) for r in rows] == [(9, "é" * 100_000)]
    reader = warc.Reader(path, {"record_type": "revisit"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert {x for b in batches for x in b.column("record_type").to_pylist()} == {"revisit"}
    assert not list(reader.pushFilters([warc.ds.EqualTo(("page_id",), 5)]))
    assert len(list(reader.pushFilters([warc.ds.EqualTo(("payload",), b"")]))) == 1


def test_foreign_archives(tmp_path):
    data = [warc.record(i, f"http://x/{i}", b"body %d" % i, None, False) for i in range(3)]
    (tmp_path / "plain.warc").write_bytes(b"".join(data))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in data))
    reader = warc.Reader(str(tmp_path), {})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["page_id"], r["payload"]) for r in rows) == sorted((i, b"body %d" % i) for i in range(3) for _ in range(2))


def read(path, **options) -> list[dict]:
    reader = warc.Reader(str(path), options)
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_members_of_other_tools_hold_many_records(tmp_path, monkeypatch):
    monkeypatch.setattr(warc.Stream, "STEP", 700)
    data = [warc.record(i, f"http://x/{i}", b"body %d " % i * 3000, None, False) for i in range(5)]
    whole = b"".join(data)
    cut = len(data[0]) + 100
    files = {"one.warc.gz": gzip.compress(whole), "across.warc.gz": gzip.compress(whole[:cut]) + gzip.compress(whole[cut:]) + b"\0" * 512, "mixed.warc.gz": warc.member(data[0]) + gzip.compress(b"".join(data[1:4])) + warc.member(data[4]), "plain.warc": whole}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
        assert [(r["page_id"], r["payload"]) for r in read(tmp_path / name)] == [(i, b"body %d " % i * 3000) for i in range(5)], name
        assert [r["target_uri"] for r in read(tmp_path / name, payload="false", uri_prefix="http://x/3")] == ["http://x/3"]


def test_truncated_archives_raise(tmp_path):
    data = [warc.record(i, f"http://x/{i}", b"body %d " % i * 3000, None, False) for i in range(3)]
    whole = b"".join(data)
    for name, content in {"a.warc.gz": gzip.compress(whole)[:-300], "b.warc": whole[:-3000], "c.warc.gz": b"".join(map(warc.member, data))[:-50], "d.warc": whole[: len(data[0]) + 30]}.items():
        (tmp_path / name).write_bytes(content)
        with pytest.raises(ValueError, match=name):
            read(tmp_path / name)
    (tmp_path / "e.warc.gz").write_bytes(b"")
    assert read(tmp_path / "e.warc.gz") == []


def test_writer_rolls_archives(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 300)
    batch = warc.pa.RecordBatch.from_pylist([{"page_id": i, "url": None, "html": f"text {i}", "refers_to": None, "revisit": False} for i in range(9)])
    writer = warc.Writer(f"{tmp_path}/out")
    done = writer.write(iter([batch]))
    writer.commit([done, None])
    assert len(done.names) > 3 and sorted(r["page_id"] for r in read(f"{tmp_path}/out")) == list(range(9))


def test_extra_columns_play_no_part(spark):
    clash = spark.createDataFrame([(1, "http://a", "x", "s", 1), (2, "http://b", "x", None, 2)], "page_id long, url string, html string, sha string, refers_to int")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(clash).collect()) == [(1, "response", None), (2, "revisit", 1)]


def test_empty(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
