"""The registry data source: cap, short pages, restarts, odd bodies, pruned pages."""

import json

import pytest

from tidemark.sources.envelopes import RegistryReader, registered
from tidemark.sources.registry import poll


def envelope(page, n, total=None):
    records = [{"applicationNumber": f"{page}-{k}", "updateDate": "2024-01-01", "wordMark": f"é {k}"} for k in range(n)]
    return records if total is None else {"trademarks": records, "totalPages": total, "page": page}


def archive(folder, bodies, first=0):
    folder.mkdir(exist_ok=True)
    for k, body in enumerate(bodies, first):
        (folder / f"page-{k:04d}.json").write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False))
    return folder.as_uri()


def read(spark, path, **options):
    return registered(spark).read.format("registry").options(**options).load(path)


def rows(df):
    return sorted((r.page, r.place, r.number) for r in df.collect())


@pytest.mark.parametrize("sizes, total", [([50, 50, 50, 7], 4), ([50, 50, 7], None), ([50, 7, 50], None), ([50, 50], None), ([0], 1), ([], None), ([50] * 9, 6)])
@pytest.mark.parametrize("cap", [1, 2, 1000])
def test_batch_equals_poll(spark, tmp_path, sizes, total, cap):
    bodies = [envelope(k, n, total) for k, n in enumerate(sizes)]
    path = archive(tmp_path / "a", bodies)
    pages = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)], "page int, body string")
    want = sorted((r.page, r.place) for r in poll(pages, 50, cap)[0].collect())
    got = rows(read(spark, path, maxPages=cap))
    assert [x[:2] for x in got] == want and all(n == f"{p}-{k}" for p, k, n in got)


def test_pages_are_pruned(spark, tmp_path):
    path = archive(tmp_path / "a", [envelope(k, 50, 200) for k in range(200)])
    df = read(spark, path).where("page >= 70 and page < 80 and place = 3")
    assert rows(df) == [(p, 3, f"{p}-3") for p in range(70, 80)]
    assert df.rdd.getNumPartitions() == 1
    assert rows(read(spark, path).where("page = 5 and place < 2")) == [(5, 0, "5-0"), (5, 1, "5-1")]
    assert len(RegistryReader({"path": path}).partitions()) == 4


@pytest.mark.parametrize("bad, why", [("{", "no envelope"), ('"text"', "no envelope"), ('{"trademarks": [1]}', "no envelope"), (envelope(1, 51, 3), "51 records")])
def test_bad_pages_are_errors(spark, tmp_path, bad, why):
    path = archive(tmp_path / "a", [envelope(0, 50, 3), bad, envelope(2, 50, 3)])
    with pytest.raises(Exception, match=f"page 1: {why}"):
        read(spark, path).collect()
    gap = archive(tmp_path / "b", [envelope(0, 50, 3), envelope(1, 50, 3)])
    with pytest.raises(Exception, match="page 2 is missing"):
        read(spark, gap).collect()


def run(spark, path, tmp_path, **options):
    stream = registered(spark).readStream.format("registry").options(**options).load(path)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    return rows(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")))


def test_stream_with_cap_short_page_and_restarts(spark, tmp_path):
    """Each run takes up to three pages; late pages and a short one come in between; nothing is read twice."""
    path = archive(tmp_path / "a", [envelope(k, 50) for k in range(5)])
    options = {"maxPages": 3, "progress": (tmp_path / "p" / "at.json").as_uri()}
    upto = lambda n, short=None: sorted((p, k, f"{p}-{k}") for p in range(n) for k in range(7 if p == short else 50))
    assert run(spark, path, tmp_path, **options) == upto(3)
    assert run(spark, path, tmp_path, **options) == upto(5)
    assert run(spark, path, tmp_path, **options) == upto(5)
    archive(tmp_path / "a", [envelope(5, 7)], 5)
    archive(tmp_path / "a", [envelope(7, 50)], 7)  # page 6 has not arrived yet
    assert run(spark, path, tmp_path, **options) == upto(6, 5)
    archive(tmp_path / "a", [envelope(6, 50)], 6)
    assert run(spark, path, tmp_path, **options) == upto(8, 5)


def test_stream_without_cap(spark, tmp_path):
    path = archive(tmp_path / "a", [envelope(k, 50) for k in range(70)])
    assert len(run(spark, path, tmp_path)) == 3500
    with pytest.raises(Exception, match="progress"):
        run(spark, path, tmp_path / "x", maxPages=3)
