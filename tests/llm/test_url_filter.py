from collections import defaultdict

import random

from mereling.llm import url_filter as U
from mereling.llm.queries import RULES


def brute(pages, labels, s=U.Settings()):
    """The same tree with dictionaries."""
    import re

    votes = defaultdict(bool)
    for i, bad in labels:
        if i is not None and bad is not None:
            votes[i] |= bad
    rows = []
    for i, url in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        rows.append([i, host, path, ([] if path == "" else re.sub("^/", "", path).split("/")), "", int(i in votes), int(votes.get(i, False))])
    for lvl in range(max((len(r[3]) for r in rows), default=0)):
        each, whole = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
        for r in rows:
            if len(r[3]) > lvl:
                e, w = each[r[1], r[4], r[3][lvl]], whole[r[1], r[4]]
                e[0] += 1
                e[1] += r[5]
                e[2] += r[6]
                w[0] += r[5]
                w[1] += r[6]
        lit, sides = {}, defaultdict(lambda: [0, 0, 0])
        for key, (n, l, b) in each.items():
            pl, pb = whole[key[:2]]
            rl, rb = pl - l, pb - b
            if n >= s.min_pages and l and rl:
                p, gap = pb / pl, b / l - rb / rl
                if gap * gap > s.z * s.z * (p * (1 - p) * (1 / l + 1 / rl)):
                    lit[key] = "#bad" if gap > 0 else "#good"
                    for k, x in enumerate((l, b, 1)):
                        sides[*key[:2], lit[key]][k] += x
        for key, side in lit.items():
            (_, l, b), (sl, sb, k) = each[key], sides[*key[:2], side]
            p = sb / sl
            if not (k > 1 and (b / l - p) ** 2 <= s.z * s.z * (p * (1 - p) * (1 / l + 1 / sl))):
                lit[key] = key[2]
        for r in rows:
            if len(r[3]) > lvl:
                r[4] += "/" + lit.get((r[1], r[4], r[3][lvl]), "*")
    t, h, g = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for r in rows:
        for x in (t[r[1], r[4]], h[r[1]], g):
            x[0] += r[5]
            x[1] += r[6]
    out = []
    for i, host, path, _, tpl, _, _ in rows:
        gs = g[1] / g[0] if g[0] else 0.0
        hs = (h[host][1] + s.prior * gs) / (h[host][0] + s.prior)
        share = (t[host, tpl][1] + s.prior * hs) / (t[host, tpl][0] + s.prior)
        fits = [(len(rh + rp), rh + rp, v) for v, rh, rp in RULES if (host == rh or host.endswith("." + rh)) and path.startswith(rp)]
        rule = max(fits) if fits else None
        out.append((i, host, path, rule and rule[1], rule[2] if rule else ("block" if share >= s.reject else "allow"), tpl))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(3)
    urls = [None, "", "nohost", "http://", "HTTP://A.Example.ORG/es/1?x=/y", "ftp://u@H.com:80/de/x#f", "a://b://c/d", "x://org", "x://notorg/en/", "https://example.org/en/12", "x://a.com/fr/", "x://a.com/de/\nz", "http://q.net//double//slash/"]
    pages = list(enumerate(urls))
    for i in range(100, 2100):
        host = "big.net" if i % 3 else f"h{r.randrange(6)}.net"
        section = r.choice(["news", "shop", "spam", "tag"])
        pages.append((i, f"http://{host}/{section}/{r.choice(['a', 'b', r.randrange(10**6)])}/{i}/x" + r.choice(["", "/y/z"])))
    pages.append((None, "http://big.net/spam/a"))
    pages.append(pages[-2])
    labels = [(i, (("/spam/" in (u or "")) and r.random() < 0.95) or r.random() < 0.1) for i, u in pages if r.random() < 0.5] + [(None, True), (101, None), (101, True)]
    got = U.judge(spark.createDataFrame([(i, u, "n", "t") for i, u in pages], "page_id long, url string, host string, _tpl string"), spark.createDataFrame(labels, "page_id long, bad boolean"), RULES)
    rows = sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict", "template").collect()), key=repr)
    assert rows == brute(pages, labels)
    assert any(x[5].startswith(("/spam", "/#bad")) and x[4] == "block" for x in rows) and any(x[4] == "allow" and x[3] is None for x in rows)


def test_deep_branches_and_similar_ones(spark):
    r = random.Random(6)
    pages, labels = [], []
    for i in range(3000):
        section = ["casino", "pills", "news", "sport", "blog", "shop"][i % 6]
        bad = r.random() < (0.97 if i % 6 < 2 else 0.03)
        depth = i // 6 % 3
        pages.append((i, f"http://x.net/{r.choice('ab')}/{i}/c/d/e/{section}/{i}" + "/z" * depth))
        if r.random() < 0.6:
            labels.append((i, bad))
    got = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"), RULES)
    rows = sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict", "template").collect()), key=repr)
    assert rows == brute(pages, labels)
    for i, _, _, _, verdict, template in rows:
        assert verdict == ("block" if i % 6 < 2 else "allow")
        assert template.split("/")[6] in (("#bad",) if i % 6 < 2 else ("#good", "*")), template


def test_empty(spark):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean")
    assert U.judge(pages, labels, RULES).count() == 0
    assert U.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), labels, RULES).first().verdict == "allow"
