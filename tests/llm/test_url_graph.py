import random

from factloom.llm import url_graph as U

SCHEMA = "page_id long, url string, html string, verdict string"


def table(spark, rows):
    return spark.createDataFrame([(k, u, h, "clash") for k, (u, h) in enumerate(rows)], SCHEMA)


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def rule_of(host, path):
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    "http://a.org/x", "https://A.Example.ORG/es/1", "http://example.org/en/12?q", "http://x.example.org/en/2",
    "http://org", "http://org/", "http://shop.com/fr/1#t", "http://shop.com/de/", "http://shop.com/en",
    "ftp://u@b.net:80/p?x#y", "http://é.net/É", "no scheme", "", None, "://", "http://?q", "http://notorg/", "http://xorg/",
    "http://a.org?x=http://b.com/fr/", "http://b.net/a\nb?c",
]


def test_parts_and_rules_by_hand(spark):
    rows = U.judged_by_rules(table(spark, [(u, "") for u in URLS]), U.RULES).collect()
    for r in rows:
        host, path = parts(URLS[r["page_id"]])
        rule = rule_of(host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == ((rule.name, rule.verdict) if rule else (None, None))


def spread(links, seeds, rounds):
    total, out = {}, {}
    for (a, b), w in links.items():
        total[a] = total.get(a, 0) + w
    mass = sum(seeds.values())
    base = {h: m / mass for h, m in seeds.items()}
    rank = dict(base)
    for _ in range(rounds):
        out = {h: (1 - U.DAMPING) * m for h, m in base.items()}
        for (a, b), w in links.items():
            out[b] = out.get(b, 0) + U.DAMPING * rank.get(a, 0) * w / total[a]
        rank = out
    return rank


def test_ranks_by_hand(spark):
    rng = random.Random(6)
    hosts = [f"h{k}.net" for k in range(25)]
    links = {}
    for _ in range(90):
        a, b = rng.sample(hosts, 2)
        links[a, b] = links.get((a, b), 0) + rng.randint(1, 4)
    good, bad = {hosts[0]: 3.0, hosts[1]: 1.0}, {hosts[2]: 2.0}
    edges = spark.createDataFrame([(a, b, float(w)) for (a, b), w in links.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame(
        [("trust", h, m) for h, m in good.items()] + [("distrust", h, m) for h, m in bad.items()], "kind string, host string, mass double"
    )
    got = {(r["kind"], r["host"]): r["rank"] for r in U.propagated(edges, seeds, 6).collect()}
    turned = {(b, a): w for (a, b), w in links.items()}
    want = {("trust", h): v for h, v in spread(links, good, 6).items()}
    want |= {("distrust", h): v for h, v in spread(turned, bad, 6).items()}
    assert {k for k, v in want.items() if v > 0} <= set(got)
    assert all(abs(got[k] - want.get(k, 0)) < 1e-12 for k in got)


def test_links_and_verdicts(spark):
    pages = [
        ("http://good.org/a", '<a href="http://Friend.net/x">f</a> <a href=\'//www.friend.net\'>'),
        ("http://spam.net/a", '<a href="https://shop.com/de/1">s</a>'),
        ("http://shop.com/de/1", "<a href='/own'>"),
        ("http://friend.net/q", None),
        ("http://alone.net/", ""),
        ("nothing", '<a href="http://x.net">'),
    ]
    found = {(r["src"], r["dst"]): r["weight"] for r in U.host_links(table(spark, pages)).collect()}
    assert found == {
        ("good.org", "friend.net"): 1.0,
        ("good.org", "www.friend.net"): 1.0,
        ("spam.net", "shop.com"): 1.0,
        ("www.friend.net", "friend.net"): 1.0,
        ("friend.net", "www.friend.net"): 1.0,
    }
    judged = {r["page_id"]: r["verdict"] for r in U.judged_pages(table(spark, pages)).collect()}
    assert judged == {0: "allow", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_edges(spark):
    empty = table(spark, []).limit(0) if False else spark.createDataFrame([], SCHEMA)
    assert U.judged_pages(empty).collect() == []
    twice = table(spark, [("http://a.org/", "")] * 3 + [(None, None)])
    rows = U.judged_pages(twice).collect()
    assert len(rows) == 4 and {r["verdict"] for r in rows} == {"allow"}


def test_ranks_settle_and_reach_all_hosts(spark):
    """A chain of several steps, and ranks as after very many rounds."""
    chain = [f"c{k}.net" for k in range(4 * U.STEP + 2)]
    pages = [(f"http://{a}/", f'<a href="http://{b}/">') for a, b in zip(chain, chain[1:], strict=False)]
    pages[-1] = (pages[-1][0], '<a href="http://shop.com/">')
    pages.append(("http://shop.com/de/", ""))
    judged = U.judged_pages(table(spark, pages)).collect()
    assert {r["verdict"] for r in judged} == {"block"}
    links = {("a", "b"): 2.0, ("b", "a"): 1.0, ("b", "c"): 1.0, ("c", "a"): 1.0}
    edges = spark.createDataFrame([(*k, w) for k, w in links.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, mass double")
    want = spread(links, {"a": 1.0}, 400)
    got = {r["host"]: r["rank"] for r in U.propagated(edges, seeds).collect()}
    assert set(got) == set(want) and all(abs(got[h] - want[h]) < 1e-8 for h in want)


def test_settled_verdicts_by_hand(spark):
    """Rounds end early, with the verdicts of very many rounds."""
    rng = random.Random(17)
    hosts = [f"h{k}.net" for k in range(40)] + ["good.org", "shop.com", "deal.com", "sale.com"]
    rows = []
    for k in range(160):
        links = "".join(f'<a href="http://{rng.choice(hosts)}/{k}">' for _ in range(rng.randint(0, 4)))
        rows.append((f"http://{rng.choice(hosts)}/{rng.choice(['de/', 'de/', 'de/', 'en'])}{k}", links))
    rows.append(("http://good.org/long", "x" * 300_000 + '<a href="http://h3.net/">'))
    pages = table(spark, rows)
    links = {(r["src"], r["dst"]): r["weight"] for r in U.host_links(pages).collect()}
    seeds = {"trust": {}, "distrust": {}}
    for url, _ in rows:
        host, path = parts(url)
        if rule := rule_of(host, path):
            own = seeds["trust" if rule.verdict == "allow" else "distrust"]
            own[host] = own.get(host, 0) + 1
    trust = spread(links, seeds["trust"], 400)
    distrust = spread({(b, a): w for (a, b), w in links.items()}, seeds["distrust"], 400)
    found = U.judged_pages(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path = parts(rows[r["page_id"]][0])
        rule = rule_of(host, path)
        bad = distrust.get(host, 0) > U.RATIO * trust.get(host, 0)
        assert r["verdict"] == (rule.verdict if rule else "block" if bad else "allow")
    assert len({r["verdict"] for r in found if r["rule"] is None}) == 2


def test_null_page_ids(spark):
    rows = [(None, "http://a.org/", None, "x"), (None, "http://b.net/", "", "x")]
    found = U.judged_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["page_id"] for r in found] == [None, None]
