import glob

from marl.llm import warc


def test_url_keys():
    assert warc.url_key("http://www.Example.com:8080/a?b=c#d") == "com,example,www:8080)/a?b=c"
    assert warc.url_key("https://example.com") == "com,example)/"
    assert warc.url_key("https://u:p@example.com?x") == "com,example)/?x"
    assert warc.url_key(None) == "" and warc.url_key("no url") == "no url"


def plain(rows):
    out = []
    for page_id, url, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        last = max(same, default=None)
        revisit = last is not None and page_id != last
        out.append((page_id, len(payload), warc.sha1_base32(payload), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 90}", f"<p>{i % 120}</p>" * (i % 5)) for i in range(600)]
    rows += [(1000, None, None), (1001, "", ""), (None, "http://x.y/", "alone"), (None, "http://x.y/", "<p>1</p>"), (1002, "http://hot/", "é\r\n\r\n" * 300000), (1003, "a\nb\tc d", "x\x00y")]
    rows += [(5000 + i, "http://hot/", "copy") for i in range(300)] + [(-4, "http://hot/", "copy"), (5299, "http://hot/", "copy")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(5)
    cfg = warc.WarcConfig(block=20, roll=20000)
    archive = warc.write(spark, pages, f"file://{tmp_path}/a", cfg)
    got = warc.lookup(archive, pages.select("url", "page_id").distinct()).drop("payload").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    records = [warc.parse_record(x) for f in glob.glob(f"{tmp_path}/a/*.warc.gz") for x in warc.read_archive(f)]
    assert len(records) == len(rows) and len(glob.glob(f"{tmp_path}/a/*.warc.gz")) > 3
    some = spark.createDataFrame([("http://hot/", 1002), ("http://nowhere/", 1), ("http://hot/", 5005)], "url string, page_id long")
    found = {r.page_id: r for r in warc.lookup(archive, some).collect()}
    assert set(found) == {1002, 5005} and bytes(found[1002].payload).decode() == "é\r\n\r\n" * 300000
    assert found[5005].refers_to == 5299 and found[5005].payload_bytes == 4


def test_urls_of_one_key_are_told_apart(spark, tmp_path):
    rows = [(5, "http://a.b/x", "one"), (5, "https://a.b/x#f", "two"), (5, "https://a.b/x#f", "two"), (6, None, "three"), (6, "", "four"), (7, "a\nb", "five"), (7, "a%0Ab", "six")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write(spark, pages, f"file://{tmp_path}/k")
    got = sorted((r.page_id, bytes(r.payload).decode()) for r in warc.lookup(archive, pages).collect() if r.record_type == "response")
    assert got == sorted((i, h) for i, _, h in rows)
    assert warc.lookup(archive, pages.select("url", "page_id").distinct()).count() == len(rows)
    only = spark.createDataFrame([("https://a.b/x#f", 5)], "url string, page_id long")
    assert {bytes(r.payload) for r in warc.lookup(archive, only).collect()} == {b"two"}


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write(spark, pages, f"file://{tmp_path}/b")
    assert archive.parts == () and warc.lookup(archive, pages.select("url", "page_id")).collect() == []
