import random

from lendspark.llm import url_filter as U
from lendspark.llm.queries import URL_RULES

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fit)[1:] if fit else (None, "allow")
    return host, path, *rule


def test_verdicts_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["net", "example.net", "www.example.com", "EXAMPLE.com", "a.org", "xnet", "net.x", "", "é.net", "a:80.net"]
    tails = ["", "/", "/en/x", "/en", "/de/1?x=/fr/", "/fr/#a", "?q=/en/", "#", "//net/", "/x.net/", "/a\nb"]
    urls = [rng.choice(["http://", "https://", "", "://", "x://y://"]) + rng.choice(parts) + rng.choice(tails)
            for _ in range(400)] + [None, "", "http://" + "a." * 3000 + "net/" + "b" * 5000, "no scheme"]
    data = [(i % 300, u, "r") for i, u in enumerate(urls)] + [(None, "http://a.net/", "r")]
    df = spark.createDataFrame(data, "page_id long, url string, rule string")
    got = U.url_verdicts(df, URL_RULES).collect()
    want = [(i, *brute(u), None) for i, u, _ in data]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_multiword_masks_globs_and_empty_table(spark):
    import re
    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    auto = U.WildcardAutomaton(globs)
    assert auto.words > 1
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    hit = auto.run([t.encode() for t in texts])
    pattern = lambda g: re.compile("".join(
        ".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]", g)), re.S)
    for k, g in enumerate(globs):
        if "***" in g:
            continue
        p = pattern(g)
        assert [bool(p.fullmatch(t)) for t in texts] == hit[:, k].tolist(), g
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.url_verdicts(empty, URL_RULES).collect() == []


def test_equally_long_rules_block_first(spark):
    rules = [("allow", "a.b/", "*.a.b/**"), ("block", "*.b/", "*.*.b/**")]
    df = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    assert U.url_verdicts(df, rules).first()["rule"] == "*.b/"
    rules = [("allow", "a.b/", "*.a.b/**"), ("block", "a.b/", "*.a.b/**")]
    assert U.url_verdicts(df, rules).first()["verdict"] == "block"


def test_unwanted_globs_decide_without_a_rule(spark):
    urls = ["http://a.ads-track.example.org/en/1", "http://ads-track.example.net/en/1", "http://x.org/en/wp-admin/a?b",
            "http://x.org/en/file.exe", "http://x.org/fr/file.exe", "http://x.org/tag/a/page/2", "http://x.org/tag/a/b/page/2",
            "http://my-casino.com/", "http://my.casinos.com", "http://x.org/ads-/", "http://clean.example.org/en/1", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.unwanted) for r in U.url_verdicts(df, URL_RULES, unwanted=U.UNWANTED).collect()}
    assert got[0] == (None, "block", "*.ads-*/**") and got[1] == ("example.net/en/", "allow", "*.ads-*/**")
    assert got[2] == (None, "block", "**/wp-admin/**") and got[3] == (None, "block", "**.exe")
    assert got[4] == ("org/fr/", "allow", "**.exe") and got[5] == (None, "block", "**/tag/*/page/*")
    assert got[6] == (None, "allow", None) and got[7] == (None, "block", "*-casino.*/**")
    assert got[8] == got[9] == got[10] == got[11] == (None, "allow", None)
    assert U.WildcardAutomaton([r[2] for r in URL_RULES] + U.UNWANTED).words >= 4
