"""WARC archives: exact round trips, revisits, lookups by range reads."""

import base64
import gzip
import hashlib
import random
import time
import uuid

import pytest

from railbird.llm import warc as W
from railbird.session import ensure_checkpoint_dir

DATA = "/root/testdata/sf0.001"


def expected(rows, min_bytes=0):
    top, out = {}, []
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    for i, p in payloads:
        if i is not None:
            top[p] = max(top.get(p, i), i)
    for i, p in payloads:
        same = len(p) >= min_bytes and sum(q == p for _, q in payloads) > 1
        again = same and p in top and i != top[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top[p] if again else None))
    return sorted(out, key=str)


def as_rows(index):
    return sorted(((r.page_id, r.payload_bytes, r.digest, r.type, r.refers_to) for r in W.entries(index).collect()), key=str)


def test_query_on_all_pages(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    got = W.op8(spark, DATA).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(pages)


ODD = [
    (1, "http://a.b/x", "same"), (2, None, "same"), (3, "no scheme", None), (4, "http://a.b/\r\nX: y", ""), (None, "http://q.r/", "same"),
    (5, "https://Www.Ex.com?q#f", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\0\0é"), (5, "https://Www.Ex.com?q#f", "other"), (6, "http://a.b/x", "z" * 300_000),
    (7, "http://a.b/x", "abc"), (7, "http://a.b/x", "abc"),
]


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_odd_pages(spark, min_bytes):
    pages = spark.createDataFrame([(*r, "x") for r in ODD], "page_id long, url string, html string, digest string")
    index = W.archive(pages, min_bytes=min_bytes)
    assert as_rows(index) == expected(ODD, min_bytes)
    assert W.entries(W.archive(pages.limit(0))).count() == 0


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_lookups_read_the_records_alone(spark, partitions):
    pages = [(100 + i, f"http://h{i % 7}.example.org/{i // 3}", f"page {i} é") for i in range(300)] + ODD
    pages += [(1000 + i, "http://hot.org/", f"hot {i}") for i in range(90)]  # one key in several blocks and ranges
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    W.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = W.build_index(W.captures(spark, folder), block_lines=16)
        assert index.agg({"n_lines": "max"}).first()[0] == 16 and index.select("part").distinct().count() == int(partitions)
        for urls in (["http://hot.org/"], ["http://h1.example.org/1", "http://H3.example.org/5", None, "http://zzz/", "http://a.b/x", "no scheme"], [u for _, u, _ in pages]):
            wanted = spark.createDataFrame([(u,) for u in urls * 2], "url string")
            keys = {W.url_key(W.safe_url(u)) for u in urls}
            want = sorted((i, h) for i, u, h in pages if W.url_key(W.safe_url(u)) in keys and (i or 0) >= 100)
            held = sorted(str(i) for i, u, _ in pages if W.url_key(W.safe_url(u)) in keys)
            found = W.lookups(index, W.keys_of(wanted))
            got = [(r.page_id, bytes(r.payload).decode()) for r in W.read_records(found.where("type = 'response'")).collect() if (r.page_id or 0) >= 100]
            assert sorted(got) == want and sorted(str(r.page_id) for r in found.collect()) == held
        assert W.lookups(index, W.keys_of(wanted.limit(0))).count() == 0 and W.lookups(index.limit(0), W.keys_of(wanted)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_members_are_read_in_linear_time():
    rnd = random.Random(1)
    raw = [rnd.randbytes(n) for n in [20_000] * 4_000 + [0, 1, 3_000_000, 5]]
    data = b"".join(W._member(r) for r in raw)
    began = time.process_time()
    got = list(W.members(data))
    assert time.process_time() - began < 3
    assert [c for _, _, c in got] == [r for r in raw if r] and sum(n for _, n, _ in got) == len(data)
    with pytest.raises(ValueError):
        list(W.members(data[:-1]))


def test_files_are_bounded_by_bytes(spark):
    rnd = random.Random(3)
    sizes = [100] * 30 + [3_000] * 30 + [40_000] * 20 + [90_000, 300_000]
    rows = [(i, f"http://a.b/{i}", rnd.randbytes(n // 2).hex()) for i, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    W.write_archives(pages, folder, file_bytes=200_000)
    lines = W.captures(spark, folder)
    files = lines.groupBy("file").agg({"payload_bytes": "sum", "*": "count"}).collect()
    assert all(f["sum(payload_bytes)"] <= 200_000 or f["count(1)"] == 1 for f in files)
    assert as_rows(W.build_index(lines)) == expected(rows)


def test_size_classes():
    assert W.size_classes(0) == W.size_classes(33_000) == [(-1, 33_554, 4_000)]
    for most in (33_555, 1 << 20, 1 << 27, 1 << 31):
        classes = W.size_classes(most)
        assert classes[-1][1] >= most and all(a[1] == b[0] for a, b in zip(classes, classes[1:]))
        assert all(n == 1 or high * n <= W.FILE_BYTES for _, high, n in classes)


def test_archives_are_plain_gzip(spark):
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    W.write_archives(spark.createDataFrame([(1, "http://a.b", "x"), (2, "http://a.c", "y" * 20_000_000)], "page_id long, url string, html string").coalesce(1), folder)
    files = [r for r in spark.read.format("binaryFile").load(folder).collect()]
    text = b"".join(gzip.decompress(bytes(f.content)) for f in files)
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"y\r\n\r\n")
    assert W.captures(spark, folder).count() == 2


def test_keys():
    assert W.url_key("https://Www.Example.com/a?b#c") == "com,example,www)/a?b#c"
    assert W.url_key("") == ")" and W.url_key("x/y") == ")x/y"
