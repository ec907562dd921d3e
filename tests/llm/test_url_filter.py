"""URL filters against SQL and against trying every entry on every URL."""

import random

import pytest
from oracle import assert_same

from faultledger.llm import queries, url_filter


def test_query_against_sql(spark, sf_dir):
    rows = assert_same(queries.op12_url_filter(spark, sf_dir), queries.ORACLES["op12_url_filter"], sf_dir)
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert {"allow", "block"} <= {value for row in rows for value in row}


def plain(url, block, allow):
    host, _, rest = "", "", ""
    path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        raw, rest = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [(len(h), len(p), h + p) for h, p in {*block, *allow} if f".{host}".endswith(f".{h}") and path.startswith(p)]
    rule = max(fits)[2] if fits else None
    allowed = rule is None or rule in {h + p for h, p in allow}
    return host, path, rule, "allow" if allowed else "block"


@pytest.mark.parametrize("size", [1, 30, 1 << 20])
def test_against_every_entry(spark, size):
    draw = random.Random(5)
    labels, parts = ["a", "b", "co", "é", ""], ["x", "xy", "y", ""]
    hosts = [".".join(draw.choices(labels[:4], k=draw.randint(1, 3))) for _ in range(25)]
    entries = [(h, "/".join(["", *draw.choices(parts, k=draw.randint(0, 3))])) for h in hosts]
    block, allow = entries[:14], entries[10:] + [("a", ""), ("b.a", "/")]
    urls = [
        draw.choice(["http://", "://", "HTTP://u@", "x", ""]) + ".".join(draw.choices(labels, k=draw.randint(1, 4))).upper()
        + draw.choice(["", "?q", "#f", ":80"]) + "/".join(["", *draw.choices(parts, k=draw.randint(0, 4))]) + draw.choice(["", "?a=/x", "#://a"])
        for _ in range(400)
    ]
    urls += [None, "", "://", "a://a\n/x", urls[0], urls[0], "http://" + "a." * 3000 + "a/" + "x/" * 3000]
    frame = spark.createDataFrame([(i, u, "old", i) for i, u in enumerate(urls)], "_host_size int, url string, Verdict string, _judged_url int")
    got = url_filter.judge(frame, block, allow, trie_bytes=size)
    assert got.columns == ["_host_size", "url", "_judged_url", "host", "path", "rule", "verdict"]
    rows = sorted(got.collect())
    assert [r.url for r in rows] == urls
    assert [tuple(r)[3:] for r in rows] == [plain(u, block, allow) for u in urls]


def test_edges(spark):
    frame = spark.createDataFrame([("http://WWW.Example.net/EN/1",), ("http://example.net",), ("http://net.org/x",)], "path string")
    got = [tuple(r) for r in url_filter.judge(frame, [("NET", "/")], url="path").collect()]
    assert got == [
        ("www.example.net", "/EN/1", "net/", "block"),
        ("example.net", "", None, "allow"),
        ("net.org", "/x", None, "allow"),
    ]
    assert url_filter.judge(frame.limit(0), [("net", "/")], url="path").count() == 0
    assert {r.verdict for r in url_filter.judge(frame, [], url="path", default="block").collect()} == {"block"}
    with pytest.raises(ValueError):
        url_filter.judge(frame, [("", "/")])
