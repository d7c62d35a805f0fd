"""Seeds are whole words of a host's name or a table; without them the links alone decide."""

import duckdb
from pyspark.sql import functions as F

from cairnmap.llm import urls

SCHEMA = "page_id long, url string, html string"


def _link(*hosts):
    return "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)


def _verdicts(frame):
    return {r.host: r.verdict for r in frame.collect()}


def test_words_stand_alone(spark):
    clean = ["alphabets.com", "antispam.net", "adulteducation.edu", "roads-tracker.net", "spamalot.net"]
    bad = ["free-bets.net", "spam.example.net", "adult-x.net", "www.casino.biz", "ads-track.net"]
    pages = spark.createDataFrame([(i, f"http://{h}/a", None) for i, h in enumerate(clean + bad)], SCHEMA)
    assert _verdicts(urls.judge_urls(pages)) == {**dict.fromkeys(clean, "allow"), **dict.fromkeys(bad, "block")}


def _graph(spark):
    """A ring that links to two listed bad hosts, hosts that listed good ones link to, and one that both sides know."""
    rows = [("bad1.net", _link("ring1.net")), ("bad2.net", ""), ("ring1.net", _link("bad1.net", "bad2.net")), ("ring2.net", _link("ring1.net", "bad2.net")),
            ("good1.net", _link("fine1.net", "mixed.net")), ("good2.net", _link("fine2.net", "mixed.net", "good1.net")), ("fine1.net", _link("fine2.net")),
            ("fine2.net", ""), ("mixed.net", _link("ring2.net")), ("alone.net", None)]
    return spark.createDataFrame([(i, f"https://{h}/", html) for i, (h, html) in enumerate(rows)], SCHEMA)


def test_links_alone_decide(spark):
    seeds = spark.createDataFrame([("BAD1.net", True), ("bad2.net", True), ("good1.net", False), ("good2.net", False)], "host string, bad boolean")
    judged = urls.judge_urls(_graph(spark).repartition(3), seeds=seeds, blocked_words=(), rules=())
    got = {r.host: r for r in judged.collect()}
    assert {h for h, r in got.items() if r.verdict == "block"} == {"bad1.net", "bad2.net", "ring1.net", "ring2.net"}
    assert got["mixed.net"].distrust > 0 and got["mixed.net"].trust > got["mixed.net"].distrust
    assert got["alone.net"].trust == got["alone.net"].distrust == 0 and got["alone.net"].verdict == "allow"
    assert set(_verdicts(urls.judge_urls(_graph(spark), blocked_words=(), rules=())).values()) == {"allow"}


def test_ranks_equal_a_plain_iteration(spark):
    seeds = spark.createDataFrame([("bad1.net", True), ("good1.net", False)], "host string, bad boolean")
    found = {r.host: r for r in urls.score_hosts(_graph(spark), rules=(), blocked_words=(), seeds=seeds).collect()}
    links = {}
    for r in _graph(spark).collect():
        src = r.url.split("/")[2]
        for dst in {x.split("/")[0] for x in (r.html or "").split("https://")[1:]}:
            links[src, dst] = links.get((src, dst), 0) + 1
    for column, seed, edges in (("trust", "good1.net", links), ("distrust", "bad1.net", {(b, a): n for (a, b), n in links.items()})):
        rank = {h: float(h == seed) for h in found}
        for _ in range(urls.ROUNDS):
            got = dict.fromkeys(rank, 0.0)
            for (a, b), n in edges.items():
                got[b] += rank[a] * n / sum(m for (x, _), m in edges.items() if x == a)
            lost = 1 - urls.DAMPING * sum(got.values())
            rank = {h: urls.DAMPING * got[h] + lost * (h == seed) for h in rank}
        assert all(abs(found[h][column] - rank[h]) < 1e-12 for h in rank)


def test_block_rules_seed_distrust_and_odd_rows(spark):
    rows = [(1, "http://evil.net/a", _link("near.net")), (2, "http://near.net/", _link("evil.net")), (2, "http://near.net/", _link("evil.net")),
            (3, None, None), (4, "no scheme", "x"), (5, "http://" + "a" * 5000 + ".net/" + "b" * 20000, "")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("trust", F.lit("x")).withColumn("host", F.lit("y"))
    got = urls.judge_urls(pages, rules=(("block", "evil.net", "/"),), blocked_words=()).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(1, "block"), (2, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow")]


def test_sql_agrees_where_links_matter(spark):
    """The registered SQL over a graph whose org hosts are trusted and whose casino is not."""
    rows = [(1, "http://casino.net/a", _link("friend.net")), (2, "http://friend.net/", _link("casino.net")), (3, "http://a.org/", _link("b.net", "friend2.net")),
            (4, "http://b.net/", ""), (5, "http://friend2.net/q", _link("casino.net")), (6, "http://x.example.org/es/1", "")]
    got = {r.page_id: (r.host, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    cursor = con.execute(urls.oracle())
    names = [d[0] for d in cursor.description]
    assert got == {r[names.index("page_id")]: (r[names.index("host")], r[names.index("verdict")]) for r in cursor.fetchall()}
    assert got[2][1] == "block" and got[4][1] == "allow"
