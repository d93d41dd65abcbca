from sparkstrata.llm.scratch import Scratch
from sparkstrata.llm.urlrules import judge, templates
from pyspark.sql import functions as F

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
SCHEMA = "page_id long, url string, html string, host string, shape string"


def parts(url):
    _, mark, rest = (url or "").partition("://")
    place = rest.partition("?")[0].partition("#")[0] if mark else ""
    host, slash, path = place.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def rule(host, path):
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    "http://a.com/en/1", "https://x.example.com/en/71", "https://example.com/en/8", "http://notcom/en/1", "http://com/en/", "http://com/enx", "HTTP://WWW.Example.NET/de/81?x=/es/#y",
    "http://example.net/de/7", "ftp://q.org/es/1#://z.com/en/", "no scheme", None, "", "://", "http://h?q=1", "http://h#f", "http://É.COM/en/é", "mailto:a@b.org/es/", "http://a.com//en/1", "http://a/b://c.com/en/",
    "http://foo.net?next=https://foo.net/de/9", "http://a.com#://b/en/7", "x?u=http://a.com/en/1", "http:///en/1", "http://a.com?/en/1#://q.com/en/2",
    "http://a.org/es", "http://u@h.org:80/es/x", "http://" + "d/" * 20_000,
]


def test_rules_hosts_and_paths(spark):
    df = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None, None), (0, URLS[0], "h", "x", "y")], SCHEMA)
    got = judge(df, Scratch(spark, "t"), RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[r.page_id or 0]
        host, path = parts(url)
        want, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want), url
        assert r.verdict == (verdict or "allow")


def labelled(spark, rows):
    return spark.createDataFrame([(h, s.split("/"), b) for h, s, n, k in rows for b in [1] * k + [0] * (n - k)], "host string, shape array<string>, bad int")


def test_bad_branches_are_rejected_and_like_ones_merge(spark):
    rows = [("h", f"{lang}/{{n}}", 100, 5) for lang in ("en", "de", "fr", "es")] + [("h", "spam/{n}", 100, 97), ("g", "a/b", 2, 2), ("g", "c", 40, 0)]
    got = {(r.host, "/".join(r.shape)): r for r in templates(labelled(spark, rows), Scratch(spark, "t")).collect()}
    assert got["h", "spam/{n}"].verdict == "block" and got["h", "spam/{n}"].template == "/spam/{n}"
    assert {got["h", f"{lang}/{{n}}"].verdict for lang in ("en", "de", "fr", "es")} == {"allow"}
    # Two bad urls of a good host are too few to reject their template.
    assert got["g", "a/b"].verdict == "allow" and 0 < got["g", "a/b"].bad_rate < 0.5


def test_similar_branches_become_a_wildcard(spark):
    rows = [("h", f"{lang}/{tail}", 50, 5) for lang in ("en", "de", "fr") for tail in ("{n}", "x")]
    got = templates(labelled(spark, rows), Scratch(spark, "t")).collect()
    assert {r.template.split("/")[1] for r in got} == {"*"} and all(abs(r.bad_rate - 0.1) < 0.01 for r in got)


def test_families_of_like_branches_become_wildcards_of_their_own(spark):
    rows = [("h", f"p{i}/{tail}", 300, 3) for i, tail in enumerate("xxxxyyyy")]
    got = templates(labelled(spark, rows), Scratch(spark, "t")).collect()
    assert {r.template for r in got} == {"/*(x)/x", "/*(y)/y"}


def test_a_rare_bad_branch_among_many_clean_ones_is_rejected(spark):
    for siblings in (20, 60):
        rows = [("h", f"n{i}/a/b/c/d/{{n}}", 400, 4) for i in range(siblings)] + [("h", "spam/a/b/c/d/{n}", 60, 60)]
        got = {"/".join(r.shape): r for r in templates(labelled(spark, rows), Scratch(spark, "t")).collect()}
        assert got["spam/a/b/c/d/{n}"].verdict == "block" and got["n7/a/b/c/d/{n}"].verdict == "allow"


def test_deep_branches_are_told_apart(spark):
    rows = [("h", f"blog/{{n}}/{{n}}/{{n}}/a/b/c/{tail}", 100, bad) for tail, bad in (("spam", 98), ("news", 2))]
    got = {r.shape[-1]: r.verdict for r in templates(labelled(spark, rows), Scratch(spark, "t")).collect()}
    assert got == {"spam": "block", "news": "allow"}


def test_many_rare_names_become_a_wildcard(spark):
    rows = [("h", f"user/name-{i}", 1, 0) for i in range(300)] + [("h", "user/login", 300, 290)]
    got = {"/".join(r.shape): r for r in templates(labelled(spark, rows), Scratch(spark, "t")).collect()}
    assert got["user/name-7"].template == "/user/*" and got["user/login"].template == "/user/login"
    assert got["user/login"].verdict == "block" and got["user/name-7"].verdict == "allow"


def test_purity_is_the_formula(spark):
    rows = [("h", "a/{n}", 60, 50), ("h", "b", 30, 0), ("k", "a", 10, 1)]
    prior = (51 + 0.5) / 102
    host = (50 + 10 * prior) / 100
    got = {(r.host, r.template): r.bad_rate for r in templates(labelled(spark, rows), Scratch(spark, "t")).collect()}
    assert abs(got["h", "/a/{n}"] - (50 + 10 * host) / 70) < 1e-12


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert judge(df, Scratch(spark, "t"), RULES).collect() == []
    some = spark.createDataFrame([(1, "http://a.b/c", "", "", "")], SCHEMA)
    none = spark.createDataFrame([], "url string, bad int")
    r = judge(some, Scratch(spark, "t"), [], none).first()
    assert (r.rule, r.bad_rate, r.template) == (None, 0.25, "/c")
    assert judge(some, Scratch(spark, "t"), [], none.union(some.select("url", F.lit(None).cast("int")))).first().bad_rate == 0.25
