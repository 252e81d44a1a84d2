import base64
import gzip
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from stratakv.llm import warc


def want(rows, least):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in data:
        if i is not None:
            first[p] = max(i, first.get(p, i))
    out = []
    for i, p in data:
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        refers = first.get(p) if len(p) >= least and first.get(p) is not None and i != first[p] else None
        out.append((i, len(p), digest, "response" if refers is None else "revisit", refers))
    return sorted(map(repr, out))


ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://ü/3", None), (4, "http://a/4\r\nX: y", ""), (5, "u", "é\r\n\r\n" * 50), (6, "u", "x" * 3_000_000), (None, "u", "<p>same</p>"), (None, None, "alone"), (7, "u", "tie"), (7, "u", "tie"), (8, "u", "WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 12])
@pytest.mark.parametrize("few", [0, 1000])
def test_round_trip(spark, least, few, tmp_path):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, digest string, first int").repartition(3)
    if few:
        got = warc.round_trip(pages, least)
        assert sorted(repr(tuple(r)) for r in got.collect()) == want(ROWS, least)
    warc.write_pages(pages, str(tmp_path / "w"), least, broadcast_rows=few)
    back = warc.read(spark, str(tmp_path / "w")).filter("record_type = 'response'").select("page_id", F.decode("payload", "utf-8").alias("p"))
    held = {(r.page_id, r.p) for r in back.collect()}
    assert (6, "x" * 3_000_000) in held and (5, "é\r\n\r\n" * 50) in held and (8, "WARC/1.1\r\n\r\n") in held


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_predicates_are_pushed_down(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/x", f"page {i // 2}") for i in range(40)], "page_id long, url string, html string")
    warc.write_pages(pages, str(tmp_path / "w"))
    df = warc.read(spark, str(tmp_path / "w")).filter("record_type = 'revisit' and target_uri like 'http://h1/%'")
    assert {r.page_id for r in df.collect()} == {i for i in range(40) if i % 2 == 0 and i % 3 == 1}
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("http://h1/x",)), IsNotNull(("record_type",)), EqualTo(("page_id",), 3)]))
    assert len(left) == 2 and len(reader.tests) == 2
    assert spark.read.format("warc").load(str(tmp_path / "w")).count() == 40


def test_unwanted_payloads_are_not_decoded(monkeypatch):
    big = os.urandom(2_000_000)
    data = b"".join(warc.member(warc.record(i, "u", big, "D", None)) for i in range(3))
    decoded = []
    more = warc.Member.more
    monkeypatch.setattr(warc.Member, "more", lambda self, n=4096: (more(self, n), decoded.append(len(self.out)))[0])

    class File(io.BytesIO):
        def size(self):
            return len(data)

    assert len(list(warc.records(warc.Source(File(data)), lambda h: True, False))) == 3
    assert max(decoded) < 100_000


def test_other_tools_read_it_and_other_archives_are_read():
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", rng.randbytes(rng.randrange(5000)), "A" * 32, None) for i in range(300)]
    plain = b"".join(warc.record(*r) for r in rows)
    members = b"".join(warc.member(warc.record(*r)) for r in rows)
    assert gzip.decompress(members) == plain
    foreign = b"".join(gzip.compress(warc.record(*r)) for r in rows)  # no lengths noted, a name in no header
    for data in (plain, members, foreign):
        got = list(warc.records(warc.Source(io.BytesIO(data), step=1000), lambda h: True, True))
        assert [p for _, p in got] == [r[2] for r in rows]
    with pytest.raises(ValueError):
        list(warc.records(warc.Source(io.BytesIO(members[:-200])), lambda h: True, True))
