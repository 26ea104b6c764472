import hashlib

import pytest

from songsift.llm.arc_convert import convert, convert_pages, parse_arc, read_arc, read_warc, write_arc, write_warc

BIG = "é" * 600


def arc(version, records):
    fields = {
        1: "URL IP-address Archive-date Content-type Archive-length",
        2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
    }[version]
    body = f"{version} 0 someone\n{fields}\n".encode()
    out = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain %d\n%s\n" % (len(body), body)
    for url, content in records:
        more = " 200 abc - 99 a.arc" if version == 2 else ""
        out += f"{url} 1.2.3.4 20010203040506 text/html{more} {len(content)}\n".encode() + content + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_records_are_taken_by_their_declared_length(version):
    tricky = b"x\n\nhttp://b 1.2.3.4 20010203040506 text/html 3\nabc"
    found = list(parse_arc(arc(version, [("http://a", tricky), ("http://c", b""), ("http://d", b"\n\n")]), "a.arc"))
    assert [(f["URL"], c) for f, _, c in found] == [("http://a", tricky), ("http://c", b""), ("http://d", b"\n\n")]
    assert all(f["Archive-date"] == "20010203040506" for f, *_ in found)


def test_versions_may_follow_each_other():
    both = arc(1, [("http://a", b"1")]) + arc(2, [("http://b", b"2")])
    assert [len(f) for f, *_ in parse_arc(both, "x")] == [5, 10]


@pytest.mark.parametrize("cut", [1, 20])
def test_a_broken_file_keeps_the_records_before(spark, tmp_path, cut):
    data = arc(1, [("http://a", b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\nhi"), ("http://b", b"some content here")])
    (tmp_path / "part-0.arc").write_bytes(data[: -cut - 1])
    rows = read_arc(spark, str(tmp_path)).collect()
    assert [(r.page_id, r.url, bytes(r.payload) if r.payload is not None else None) for r in rows] == [
        (7, "http://a", b"hi"), (None, None, None),
    ]
    assert rows[0].problem is None and "a.arc" not in (rows[1].problem or "") and rows[1].problem
    assert rows[0].date == "2001-02-03T04:05:06Z"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a b/\n", BIG), (5, None, BIG), (5, "u", BIG), (None, "u", BIG), (2, "u", None), (3, "u", ""),
        (4, "u", "x\r\n\r\nWARC/1.1\r\n\nhttp://x 0.0.0.0 2020 text/html 5\n"), (6, "v", "y" * 999), (7, "v", "y" * 999),
        (None, "w", "z" * 1000), (None, "w", "z" * 1000), (8, "w", "q" * 200_000),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_pages_come_back_with_their_digests_and_types(spark, sf_dir, pages):
    for df in (pages, spark.read.parquet(f"{sf_dir}/pages.parquet")):
        sent = sorted(((r.page_id is None, r.page_id or 0, (r.html or "").encode()) for r in df.collect()))
        found = convert_pages(df).collect()
        plain = [hashlib.sha1(b).hexdigest() for *_, b in sent]
        assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest) for r in found) == sorted(
            (none, page, len(b), d) for (none, page, b), d in zip(sent, plain)
        )
        groups = {}
        for r in found:
            groups.setdefault(r.payload_digest, []).append(r)
        for group in groups.values():
            ids = [r.page_id for r in group if r.page_id is not None]
            responses = [r for r in group if r.record_type == "response"]
            if group[0].payload_bytes < 1000:
                assert len(responses) == len(group) and all(r.refers_to is None for r in group)
                continue
            assert [r.page_id for r in responses] == [max(ids, default=None)]
            for r in group:
                assert (r.refers_to, r.refers_to_record) == (
                    (None, None) if r.record_type == "response" else (max(ids, default=None), responses[0].record_id)
                )
        assert len({r.record_id for r in found}) == len(found)


def test_files_are_cut_and_both_versions_read(spark, tmp_path, pages):
    write_arc(pages.repartition(2), str(tmp_path / "arc"), file_bytes=2000)
    assert len(list((tmp_path / "arc").glob("part-*"))) > 4
    records = read_arc(spark, str(tmp_path / "arc"))
    assert records.count() == pages.count() and records.filter("problem is not null").count() == 0
    write_warc(convert(records), str(tmp_path / "warc"))
    assert read_warc(spark, str(tmp_path / "warc")).count() == pages.count()


def test_empty_table(pages):
    assert convert_pages(pages.limit(0)).count() == 0


def test_a_page_may_have_the_url_of_a_version_block(spark):
    rows = [(1, "http://a.b/", "one"), (2, "filedesc://x.arc", "two"), (3, "http://a.c/", "three")]
    found = convert_pages(spark.createDataFrame(rows * 2, "page_id bigint, url string, html string").coalesce(1))
    assert sorted((r.page_id, r.url) for r in found.collect()) == sorted((i, u) for i, u, _ in rows * 2)


def test_a_strict_read_does_not_lose_a_broken_file(spark, tmp_path):
    (tmp_path / "part-0.arc").write_bytes(arc(1, [("http://a", b"one")])[:-2])
    assert read_arc(spark, str(tmp_path)).filter("problem is not null").count() == 1
    with pytest.raises(Exception, match="bytes"):
        read_arc(spark, str(tmp_path), strict=True).collect()
