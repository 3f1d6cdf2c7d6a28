import hashlib

import pytest

from lingua_spark.llm.warc_archive import parse, read_archives, round_trip, write_archives

LONG = "payload with é and \r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n inside " * 3
PAGES = [
    (1, "http://a/?q=1 2\r\nX: y", LONG),
    (2, "http://b/", LONG),
    (2, "http://b/", LONG),
    (3, None, "short"),
    (4, "http://d/", "short"),
    (5, "", None),
    (6, "http://f/", ""),
    (None, "http://g/", LONG),
    (None, "http://h/", "only null pages hold this payload " * 4),
    (7, "http://i/", "one large page " * 100_000),
    (8, "http://j/", "one large page " * 100_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr(
        "*", "'x' as payload", "1 as original", "2 as key"
    )


def slow(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(same) if same and len(raw) >= 100 else page
        revisit = first != page
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(pages):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[n] for n in names) for r in round_trip(pages).collect()), key=str) == slow(PAGES)
    assert round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_archives_hold_each_payload_once_and_whole(spark, pages, tmp_path, codec):
    write_archives(pages, f"{tmp_path}/w", codec=codec)
    rows = read_archives(spark, f"{tmp_path}/w").collect()
    assert len(rows) == len(PAGES)
    assert sum(r["content"] == LONG for r in rows) == 1
    revisits = [r for r in rows if r["record_type"] == "revisit"]
    assert all(r["content"] == "" and r["refers_to"] in {x["record_id"] for x in rows} for r in revisits)
    assert all(r["url"] is None or "\n" not in r["url"] for r in rows)


def test_damage_is_reported():
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [body for _, body in parse(iter([whole[:20], whole[20:], whole]))] == [b"abc", b"abc"]
    for bad in (whole[:-6], whole[:10], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(parse(iter([bad])))
