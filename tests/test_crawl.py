"""The paged crawl in batch and as a stream that is stopped, goes on, and finds new pages."""

import json

import pytest

from tessera.sources import crawl


def put(root, pages, more=None):
    """Pages of ids (by their number), of which each but the last names the next; ``more``: the last one too."""
    (root / "pages" / "all").mkdir(parents=True, exist_ok=True)
    (root / "messages").mkdir(exist_ok=True)
    for k, ids in pages.items():
        after = f"t{k + 1}" if k + 1 in pages or more == k else None
        page = {"messages": [{"id": i} for i in ids]} | ({"nextPageToken": after} if after else {})
        (root / "pages" / "all" / ("first.json" if k == 0 else f"t{k}.json")).write_text(json.dumps(page))
        for i in ids:
            (root / "messages" / f"{i}.json").write_text(json.dumps({"id": i, "snippet": f"é {i}"}))


PAGES = {k: [f"m{k}-{i}" for i in range(5 if k != 2 else 0)] for k in range(6)}


@pytest.fixture
def spark_with(spark):
    crawl.register(spark)
    return spark


def test_batch_follows_the_chain(spark_with, tmp_path):
    put(tmp_path, PAGES)
    read = lambda **o: spark_with.read.format("tessera_crawl").options(path=str(tmp_path), **o).load()
    rows = read().collect()
    assert sorted(r.id for r in rows) == sorted(i for ids in PAGES.values() for i in ids)
    assert all(json.loads(r.message)["snippet"] == f"é {r.id}" for r in rows)
    assert read().rdd.getNumPartitions() == 6
    # Whole pages, until there are so many messages.
    assert read(maxResults=7).count() == 10
    assert read(maxResults=10).count() == 10
    assert read(maxResults=11).count() == 15
    put(tmp_path / "empty", {0: []})
    assert spark_with.read.format("tessera_crawl").option("path", str(tmp_path / "empty")).load().count() == 0


def test_stream_goes_on_where_it_was(spark_with, tmp_path):
    source = tmp_path / "in"

    def run():
        q = spark_with.readStream.format("tessera_crawl").options(path=str(source), maxResults=1000).load().writeStream.format("parquet")
        q = q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r.id for r in spark_with.read.parquet(str(tmp_path / "out")).collect())

    put(source, {k: PAGES[k] for k in range(3)})
    first = run()
    assert first == sorted(PAGES[0] + PAGES[1])
    assert run() == first  # nothing new
    put(source, {k: PAGES[k] for k in range(2, 5)}, more=None)
    second = run()
    put(source, PAGES)
    assert run() == sorted(i for ids in PAGES.values() for i in ids)
    assert second == sorted(i for k in range(5) for i in PAGES[k])
