"""WARC round trips and URL filters."""

import hashlib
import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexispark.llm import common, urlfilter, warc

PAGES = "page_id long, url string, html string, digest string, shard int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)


def expected(rows, least=100):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least:
            first.setdefault(b, []).append(i)
    return {b: min(x for x in v) for b, v in first.items()}


def test_round_trip(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"http://h.example.com/{i}", rng.choice(["<p>é" + "x" * 200, "short", "", None, "u" * 150 + str(i)])) for i in range(200)] + [(900, None, "big" * 100_000), (901, "http://x y\r\nz/", "a\r\n\r\nb")]
    out = f"{tmp_path}/a"
    manifest = warc.write_warc(pages(spark, rows), out, roll_bytes=2000, shard_bytes=20_000).collect()
    assert sum(m.records for m in manifest) == len(rows) and len(manifest) > 3
    for m in manifest:
        data = open(f"{out}/{m.name}", "rb").read()
        assert len(data) == m.bytes and hashlib.sha256(data).hexdigest() == m.sha256
    assert not os.path.exists(f"{out}/_temporary")
    got = {r.page_id: r for r in warc.read_warc(spark, out).collect()}
    first = expected(rows)
    assert len(got) == len(rows)
    for i, _, h in rows:
        b, r = (h or "").encode(), got[i]
        assert r.payload_bytes == len(b) and r.payload_digest == hashlib.sha256(b).hexdigest()
        revisit = b in first and first[b] != i
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (first[b] if revisit else None)
        assert r.payload is None if revisit else bytes(r.payload) == b
    again = warc.write_warc(pages(spark, rows).repartition(5), f"{tmp_path}/b", roll_bytes=2000, shard_bytes=20_000).collect()
    assert sorted((m.name, m.sha256) for m in again) == sorted((m.name, m.sha256) for m in manifest)


def test_repeated_ids_nulls_and_empty(spark, tmp_path):
    rows = [(1, "u", "x" * 100), (1, "u", "x" * 100), (1, "u", "y" * 100), (None, "u", "z" * 100), (2, "u", "z" * 100)]
    warc.write_warc(pages(spark, rows), f"{tmp_path}/a")
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.read_warc(spark, f"{tmp_path}/a").collect())
    # The smallest id that is not null is the response.
    assert got == [("1", "response", "None"), ("1", "response", "None"), ("1", "revisit", "1"), ("2", "response", "None"), ("None", "revisit", "2")]
    warc.write_warc(pages(spark, [(None, "u", "z" * 100), (None, "v", "z" * 100), (None, None, None)]), f"{tmp_path}/c")
    assert sorted((r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, f"{tmp_path}/c").collect()) == [(0, "response", None), (100, "response", None), (100, "revisit", None)]
    with pytest.raises(TypeError, match="integers"):
        warc.write_warc(pages(spark, []).withColumn("page_id", F.lit("x")), f"{tmp_path}/d")
    warc.write_warc(pages(spark, []), f"{tmp_path}/b")
    assert warc.read_warc(spark, f"{tmp_path}/b").count() == 0


def test_shards_of_outlying_and_heavy_ids(spark, tmp_path):
    """An id far away costs no balance, and an id larger than a shard is dealt over several."""
    rng = random.Random(19)
    rows = [(i, "u", "%x" % rng.getrandbits(4000)) for i in range(100)] + [(2**62, "u", "far"), (-(2**62), "u", "near")] + [(i, "u", "%x" % rng.getrandbits(4000)) for i in [None] * 30 + [50] * 40]
    out = warc.write_warc(pages(spark, rows), f"{tmp_path}/a", roll_bytes=3000, shard_bytes=10_000).collect()
    shards = {}
    for m in out:
        shards[m.shard] = shards.get(m.shard, 0) + m.records
    assert sum(shards.values()) == len(rows) and max(shards.values()) <= 20 and len(shards) >= 15
    assert max(m.part for m in out) >= 1
    got = warc.read_warc(spark, f"{tmp_path}/a").collect()
    assert sorted((str(r.page_id), bytes(r.payload).decode()) for r in got) == sorted((str(i), h) for i, _, h in rows)


def test_damage_is_found(spark, tmp_path):
    warc.write_warc(pages(spark, [(1, "u", "x" * 100)]), f"{tmp_path}/a")
    name = next(f for f in os.listdir(f"{tmp_path}/a") if f.endswith(".warc.gz"))
    with open(f"{tmp_path}/a/{name}", "r+b") as f:
        f.truncate(80)
    with pytest.raises(Exception, match="cut short|damaged|EOF"):
        warc.read_warc(spark, f"{tmp_path}/a").collect()


RULES = urlfilter.parse_rules(["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"])


def test_rules(spark):
    cases = {
        "http://a.example.com/en/5": ("a.example.com", "/en/5", "com/en/", "block"), "HTTP://A.EXAMPLE.com/en/77?x=/en/": ("a.example.com", "/en/77", "example.com/en/7", "allow"),
        "https://x.net/de/81#z": ("x.net", "/de/81", "net/de/", "allow"), "https://x.example.net/de/81#z": ("x.example.net", "/de/81", "example.net/de/8", "block"),
        "https://notcom/en/1": ("notcom", "/en/1", None, "allow"), "a.com/en/1": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://com": ("com", "", None, "allow"), "http://x.org?/es/": ("x.org", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate([*cases, *cases])], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_filter(df, RULES).collect()}
    assert got == {i: c for i, c in enumerate([*cases.values(), *cases.values()])}
    assert urlfilter.url_filter(df.limit(0), RULES).count() == 0


def test_templates_and_purity(spark):
    urls = [("spam.example", f"/buy/item-{i}/{i}.html", 1) for i in range(60)] + [("spam.example", f"/about/{i}", 0) for i in range(30)]
    rows = [(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(urls)] + [(900, "http://spam.example/buy/new-thing/7.html"), (901, "http://spam.example/about/9"), (902, "http://other.example/buy/a/7.html"), (903, "http://spam.example/never/x")]
    labels = spark.createDataFrame([(f"http://{h}{p}", b) for h, p, b in urls[::2]], "url string, bad int")
    got = {r.page_id: r for r in urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [], labels).collect()}
    assert got[900].template == "/buy/*/*.html" and got[900].verdict == "block" and got[900].purity > 0.8
    assert [got[i].verdict for i in (901, 902, 903)] == ["allow"] * 3
    for i, (_, _, bad) in enumerate(urls):
        assert got[i].verdict == ("block" if bad else "allow")


@pytest.mark.parametrize("sections", [24, 25])
@pytest.mark.parametrize("given", [False, True])
def test_labels_of_one_section_stay_there(spark, sections, given):
    """However many sections a host has, a blocked one says nothing about the others."""
    names = ["en", *(f"{a}{b}" for a in "fgh" for b in "klmnopqrstuvwxyzabcd")][:sections]
    rows = [(i * 10 + k, f"http://big.example.com/{s}/{k}") for i, s in enumerate(names) for k in range(3)]
    labels = spark.createDataFrame([(u, 1) for _, u in rows if "/en/" in u], "url string, bad int") if given else None
    rules = [] if given else urlfilter.parse_rules(["block com/en/"])
    got = {r.page_id: r for r in urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules, labels).collect()}
    assert {i: r.verdict for i, r in got.items()} == {i: "block" if i < 10 else "allow" for i, _ in rows}
    assert got[0].template == "/en/*" and got[10].template == "/fk/*"


def brute_url_filter(rows, rules, labels, purity, smoothing):
    """Templates by form alone, purity pooled over like templates of a branch. Siblings that the operator merges have like shares, so their verdicts are the same."""
    form = lambda s: "*" + (m[2] or "") if (m := re.match(r"^([0-9]+|[0-9a-fA-F]{8,})(\.[A-Za-z]{1,5})?$", s)) else s
    split = lambda u: re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u).groups()
    key = lambda u: (split(u)[0].lower(), tuple(form(s) for s in re.sub("^/", "", split(u)[1]).split("/")))

    def rule(u):
        h, p = split(u)
        fit = [(len(a) + len(b) - 1, act == "block", act) for act, a, b in rules if (h.lower() == a or h.lower().endswith("." + a)) and p.startswith(b)]
        return max(fit)[2] if fit else None

    given = [(key(u), b) for u, b in labels if rule(u) is None]
    seen = defaultdict(list)
    for k, b in given:
        seen[k].append(b)
    ruled = defaultdict(list)
    for _, u in rows:
        if rule(u):
            ruled[key(u)].append(int(rule(u) == "block"))
    overall = sum(b for _, b in given) / len(given)
    hosts = defaultdict(list)
    for (h, _), b in given:
        hosts[h].append(b)
    prior = lambda h: (sum(hosts[h]) + smoothing * overall) / (len(hosts[h]) + smoothing)
    out, branches = {}, defaultdict(list)
    for k in set(seen) | set(ruled):
        all_ = seen[k] + ruled[k]
        branches[k[0], k[1][:-1]].append((sum(all_) / len(all_), "/" + "/".join(k[1]), len(all_), sum(all_), k))
    for (h, _), some in branches.items():
        classes, last = [], None
        for share, name, n, bad, k in sorted(some):
            if last is not None:
                pooled = (bad + last[0] * last[1]) / (n + last[1])
                if share - last[0] > 1.96 * max((pooled * (1 - pooled) * (1 / n + 1 / last[1])) ** 0.5, 1e-12):
                    classes.append([])
            classes = classes or [[]]
            classes[-1].append((n, bad, k))
            last = (share, n)
        for c in classes:
            n, bad = sum(x[0] for x in c), sum(x[1] for x in c)
            for _, _, k in c:
                out[k] = (bad + smoothing * prior(h)) / (n + smoothing)
    return {i: (rule(u) or ("block" if out.get(key(u), 0) >= purity else "allow"), out.get(key(u))) for i, u in rows}


def test_verdicts_match_brute_force(spark):
    rng = random.Random(14)
    hosts = ["a.example.com", "b.example.net", "c.example.org", "d.example.org"]
    rows = [(i, f"http://{h}/{rng.choice(['en', 'de', 'fr', 'x/y/z'])}/{i}{rng.choice(['', '.html', '/'])}") for i in range(300) for h in [rng.choice(hosts)]]
    labels = [(u, int(rng.random() < (0.95 if "d.example" in u and "fr" in u else 0.1))) for _, u in rows]
    got = urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), RULES, spark.createDataFrame(labels, "url string, bad int"), purity=0.65, smoothing=2.0)
    want = brute_url_filter(rows, RULES, labels, 0.65, 2.0)
    seen = {r.page_id: r.verdict for r in got.collect()}
    assert seen == {i: v for i, (v, _) in want.items()}
    assert any(seen[i] == "block" and "d.example" in u and "/fr/" in u for i, u in rows)


def brute_alike(children, purity, z):
    """The children of one branch and kind that merge: children is {segment: (n, labelled, bad, ruled)}."""
    free = {s: c for s, c in children.items() if s and not c[3]}
    some = {s: c for s, c in free.items() if c[1]}
    if len(some) < 2:
        return set()
    labelled, bad = sum(c[1] for c in some.values()), sum(c[2] for c in some.values())
    p = bad / labelled
    error = lambda n: max((p * (1 - p) * (1 / n + 1 / (labelled - n))) ** 0.5, 1e-12)
    some = {s: c for s, c in some.items() if abs(c[2] / c[1] - (bad - c[2]) / (labelled - c[1])) <= z * error(c[1])}
    m = len(some)
    if m < 2:
        return set()
    labelled, bad = sum(c[1] for c in some.values()), sum(c[2] for c in some.values())
    p = bad / labelled
    chi = sum((c[2] - c[1] * p) ** 2 / (c[1] * p * (1 - p)) for c in some.values()) if 0 < p < 1 else 0.0
    if chi > m - 1 + z * (2 * (m - 1)) ** 0.5:
        return set()
    out = set(some)
    if m >= purity * z * z / (1 - purity):
        rate = sum(min(c[1], c[0]) for c in free.values()) / max(1, sum(c[0] for c in free.values()))
        out |= {s for s, c in free.items() if not c[1] and (1 - rate) ** c[0] >= 0.025}
    return out


def brute_templates(shapes, purity, z):
    """{(host, shape): template} of {(host, shape): (n, labelled, bad, ruled)}, by a walk from branch to branch."""
    extension = lambda s: (re.search(r"(\.[A-Za-z]{1,5})$", s) or [""])[0]
    out, todo = {}, [(h, "", 0, [k for k in shapes if k[0] == h]) for h in {k[0] for k in shapes}]
    while todo:
        h, template, level, some = todo.pop()
        inside = [k for k in some if len(k[1]) > level]
        walk = sum(shapes[k][1] > 0 for k in inside) > 1
        for k in some:
            if len(k[1]) <= level:
                out[k] = template
            elif not walk:
                out[k] = template + "".join(f"/{s}" for s in k[1][level:])
        if not walk:
            continue
        below = defaultdict(list)
        for kind in {(len(k[1]), extension(k[1][-1])) for k in inside}:
            mine = [k for k in inside if (len(k[1]), extension(k[1][-1])) == kind]
            children = {}
            for k in mine:
                old, own = children.get(k[1][level], (0, 0, 0, False)), shapes[k]
                children[k[1][level]] = (*(old[i] + own[i] for i in range(3)), old[3] or own[3])
            merged = brute_alike(children, purity, z)
            beside = bool(merged) and any(re.fullmatch(r"\*(\.[A-Za-z]{1,5})?", s) and s not in merged for s in children)
            for k in mine:
                star = ("*word" if beside else "*") + (kind[1] if kind[0] == level + 1 else "")
                below[f"{template}/{star if k[1][level] in merged else k[1][level]}"].append(k)
        todo += [(h, t, level + 1, ks) for t, ks in below.items()]
    return out


@pytest.mark.parametrize("most", [None, 0])
def test_merging_and_purity_match_brute_force(spark, monkeypatch, most):
    """Templates, purities and verdicts with merged siblings, also where no table is broadcast."""
    if most is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    rng, z, smoothing, purity = random.Random(41), 1.96, 3.0, 0.7
    bad = {"buy": 0.97, "blog": 0.05, "mix": 0.5, "about": 0.1}
    urls = []
    for i in range(900):
        host, part = rng.choice(["h.example", "h.example", "k.example"]), rng.choice(list(bad))
        path = {"buy": f"buy/item-{chr(97 + i % 23)}/{i}.html", "blog": f"blog/{rng.choice('pqrstuvw')}{rng.choice('xyz')}", "mix": f"mix/{rng.choice('abcdef')}/{rng.choice('abcdefgh')}/{i}", "about": rng.choice([f"about/{i}", "about/us", "about"])}[part]
        urls.append((f"http://{host}/{path}", int(rng.random() < (bad[part] if host[0] == "h" else 1 - bad[part]))))
    rows = [(i, u) for i, (u, _) in enumerate(urls)]
    labels = [x for x in urls if rng.random() < 0.4]
    form = lambda s: "*" + (m[2] or "") if (m := re.match(r"^([0-9]+|[0-9a-fA-F]{8,})(\.[A-Za-z]{1,5})?$", s)) else s
    key = lambda u: (u.split("/")[2], tuple(map(form, u.split("/")[3:])))
    shapes, given = {}, defaultdict(list)
    for u, _ in urls:
        n, l, b, r = shapes.get(key(u), (0, 0, 0, False))
        shapes[key(u)] = (n + 1, l, b, r)
    for u, y in labels:
        n, l, b, r = shapes[key(u)]
        shapes[key(u)] = (n, l + 1, b + y, r)
        given[key(u)[0]].append(y)
    made = brute_templates(shapes, purity, z)
    counts = defaultdict(lambda: [0, 0])
    for k, t in made.items():
        counts[k[0], t][0] += shapes[k][1]
        counts[k[0], t][1] += shapes[k][2]
    branches, overall, pure = defaultdict(list), sum(y for _, y in labels) / len(labels), {}
    for (h, t), (l, b) in counts.items():
        if l:
            branches[h, t.rpartition("/")[0]].append((b / l, t, l, b))
    for (h, _), some in branches.items():
        prior, classes, last = (sum(given[h]) + smoothing * overall) / (len(given[h]) + smoothing), [[]], None
        for share, t, l, b in sorted(some):
            if last:
                p = (b + last[0] * last[1]) / (l + last[1])
                if share - last[0] > z * max((p * (1 - p) * (1 / l + 1 / last[1])) ** 0.5, 1e-12):
                    classes.append([])
            classes[-1].append((t, l, b))
            last = (share, l)
        for c in classes:
            for t, _, _ in c:
                pure[h, t] = (sum(x[2] for x in c) + smoothing * prior) / (sum(x[1] for x in c) + smoothing)
    got = urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [], spark.createDataFrame(labels, "url string, bad int"), purity=purity, smoothing=smoothing, z=z).collect()
    assert len(got) == len(rows)
    for r in got:
        k = key(rows[r.page_id][1])
        want = pure.get((k[0], made[k]))
        assert r.template == made[k] and (r.purity is None) == (want is None) and (want is None or abs(r.purity - want) < 1e-9)
        assert r.verdict == ("block" if want is not None and want >= purity else "allow")
    assert any("item" in rows[r.page_id][1] and r.template == "/buy/*/*.html" and r.verdict == "block" for r in got)
    assert {r.verdict for r in got} == {"block", "allow"}


def test_a_hot_host_is_work_for_many_tasks(spark, monkeypatch):
    """Beyond the bound of broadcasts, rows of one key are dealt out."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = spark.range(4000).select("id", F.lit("h").alias("host"), F.lit("/x").alias("path"))
    table = common.stored(spark.createDataFrame([("h", 1)], "host string, v int"), "test")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = urlfilter.lookup(rows, table, ["host"], ["id"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r.n for r in got) == sum(r.v for r in got) == 4000 and max(r.n for r in got) < 1200


def test_junk_labels(spark):
    rows = [("a", "<p>plain words of a page, as usual.</p>"), ("b", "<b>THIS!! IS!! ALL!! NOISE!!</b>"), ("c", None), ("d", "<style>p{}</style><script>x==1;;</script>"), ("e", "one two three four five six seven &&&"), ("f", "w " * 200_000)]
    got = dict(urlfilter.junk_labels(spark.createDataFrame(rows, "url string, html string")).collect())
    assert got == {"a": 0, "b": 1, "c": 1, "d": 1, "e": 0, "f": 0}


def test_labels_of_urls_that_rules_fit_are_the_rules(spark):
    pages = spark.createDataFrame([(i, f"http://x.example.com/{p}/{i}") for i, p in enumerate(["en"] * 5 + ["fr"] * 5)], "page_id long, url string")
    labels = pages.selectExpr("url", "CASE WHEN url LIKE '%/en/%' THEN 1 ELSE 0 END AS bad")
    got = urlfilter.url_filter(pages, RULES, labels, purity=0.5).collect()
    assert {r.page_id: r.verdict for r in got} == {i: "block" if i < 5 and i != 7 else "allow" for i in range(10)}


def test_very_long_urls(spark):
    """A path of many segments leaves the walk where it is alone."""
    deep = "/".join(f"s{i}" for i in range(3000))
    rows = [(1, f"http://x.example.org/{deep}"), (2, f"http://x.example.org/{deep}/y"), (3, "http://x.example.org/" + "z" * 200_000)]
    labels = spark.createDataFrame([(rows[0][1], 1), ("http://x.example.org/a", 0)], "url string, bad int")
    got = {r.page_id: r for r in urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [], labels).collect()}
    assert got[1].template == "/" + deep and got[1].path == "/" + deep and len(got[3].path) == 200_001
    assert {r.verdict for r in got.values()} == {"allow"}
