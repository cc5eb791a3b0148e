from pyspark.sql import functions as F

from ferrule.llm import urlfilter
from ferrule.llm.queries import RULES

URLS = [
    None, "", "no scheme/en/", "http://", "http://EXAMPLE.com", "http://example.com/en/x?y#z", "https://www.Example.com/en/", "https://a.www.example.com/en/1#q",
    "http://xexample.com/en/a", "http://b.net/es/", "http://b.net/fr/q?x", "http://net/es/x", "http://b.net/de/", "ftp://spam.org/://x", "http://user@h.org:80?q", "x://É.net/fr/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        cut = min(ends, default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return host, path, best


def test_against_brute_force(spark):
    rows = [(i, u, "html", "h") for i, u in enumerate([*URLS, *URLS[:6], *(f"http://host{i}.org/a" for i in range(3000))])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    keys = [(f"host{i}.org",) for i in range(0, 3000, 7)] + [("spam.org",), ("not-in-corpus.org",), (None,)]
    listed = spark.createDataFrame([*keys, *keys[:5]], "key string")
    names = {k for (k,) in keys}
    for limit in (urlfilter.MAX_WORDS, 1):
        hosts = pages.select(urlfilter.host_and_path(F.col("url"))[0].alias("key")).where("key <> ''")
        assert bool(urlfilter.build_cascade(listed, hosts, limit).levels) == (limit > 1)
    got = {x.page_id: x for x in urlfilter.judge(pages, RULES, listed).collect()}
    assert len(got) == len(rows)
    for i, url, *_ in rows:
        host, path, best = brute(url)
        verdict = best.verdict if best else "block" if host in names else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best.name, verdict), url


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    for share in (2, 3, 100):
        listed = universe.where(F.crc32("key") % share == 0)
        cascade = urlfilter.build_cascade(listed, universe)
        wrong = universe.where(urlfilter.contains(cascade, F.col("key")) != (F.crc32("key") % share == 0))
        assert wrong.count() == 0


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    assert urlfilter.judge(pages, RULES, none).count() == 0
    one = spark.createDataFrame([(1, "http://a.org")], "page_id long, url string")
    assert urlfilter.judge(one, RULES, none).first().verdict == "allow"
