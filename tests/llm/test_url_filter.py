import random

from helixgrid.llm import url_filter
from tests.llm import sql


def link(*to):
    return "".join(f'<a class="x" href="{t}">t</a>' for t in to)


PAGES = [
    (1, "https://Good.example.org/fr/1?x", link("http://near.test/", "//other.test/a", "/own")),
    (2, "http://bad.NET/", link("http://near.test")),
    (3, "http://near.test/x", link("http://far.test/", "http://bad.net/x")),
    (4, "http://farm.test", link("https://bad.net/1", "https://bad.net/2", "https://bad.net/2")),
    (5, "http://far.test/#net/", None), (6, None, None), (7, "no scheme", "<a href=http://x.test>"), (7, "http://lone.test?y", ""),
    (8, "http://a.example.net/en/1", ""), (9, "http://a.example.net/e", ""), (10, "x://example.com/de/", ""), (11, "x://myexample.com/de/", ""),
    (12, "http://net?a", ""), (13, "http://net/", ""), (14, "http://u.test/a://b", "HREF"), (15, "", ""),
]


def test_equals_sql(spark):
    data = [(i, u, h, "clash") for i, u, h in PAGES]
    df = spark.createDataFrame(data, "page_id long, url string, html string, host string")
    got = url_filter.judge(df)
    assert sql.of(got) == sql.rows(url_filter.oracle(), pages=("page_id bigint, url varchar, html varchar, host varchar", data))
    verdict = {r.page_id: r.verdict for r in got.collect()}
    assert verdict[4] == "block" and verdict[5] == "allow" and verdict[8] == "allow" and verdict[10] == "block" and verdict[11] == "allow"


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(df).count() == 0


def test_far_hosts_and_small_shares_count(spark):
    chain = [(i, f"http://h{i}.test/", link(f"http://h{i - 1}.test/")) for i in range(1, 25)]
    hub = [(1000 + i, f"http://s{i}.test/", link("http://bad.net/")) for i in range(300)]
    heavy = [(2000, "http://t.test/", link(*[f"http://bad.net/{i}" for i in range(50)]))]
    pages = [(0, "http://h0.test/", link("http://bad.net/")), (500, "http://bad.net/", "")] + chain + hub + heavy
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: r.verdict for i, r in got.items()} == {p[0]: "block" for p in pages}
    assert got[1000].distrust > 0 and abs(got[2000].distrust - 50 * got[1000].distrust) <= 50
    assert got[11].distrust > 0 and all(got[i].distrust <= got[i - 1].distrust for i in range(1, 25))


def test_a_linked_web_equals_sql(spark):
    """Thousands of pages, a host with a third of them, repeated page ids, and links between hosts."""
    rng = random.Random(3)
    hosts = ["hot.test"] * 30 + [f"h{i}.test" for i in range(50)] + ["bad.net", "worse.net", "fine.org", "ok.org"]
    pages = []
    for i in range(3_000):
        h = rng.choice(hosts)
        near = [x for x in hosts if sum(map(ord, x)) % 3 == sum(map(ord, h)) % 3]
        to = [f"http://{rng.choice(near)}/{rng.randrange(5)}" for _ in range(rng.randrange(4))]
        pages.append((i // 2 if i < 20 else i, f"http://{h}/{'fr' if rng.random() < 0.8 else 'x'}/{i}", link(*to) + '<a data-href="http://bad.net/">'))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = url_filter.judge(df)
    assert sql.of(got) == sql.rows(url_filter.oracle(), pages=("page_id bigint, url varchar, html varchar", pages))
    assert {r.verdict for r in got.filter("rule is null").collect()} == {"allow", "block"}
