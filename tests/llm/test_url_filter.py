"""Hosts, paths and rules against plain code; the trees on held-out URLs."""

import random
import re

from pyspark.sql import functions as F

from fieldtrust.llm.url_filter import RULES, Rule, features, filter_urls, fit, judged, parts, ruled

PAGES = "page_id long, url string"
ODD = [
    None, "", "no scheme", "http://", "http://WWW.Example.COM/en/a?x=1&y=2#f", "https://example.com", "https://example.com/en", "a://b://c/d",
    "http://x.net/es/é?", "http://x.net/fr/#", "http://net/es/", "http://notnet/es/", "http://İ.com/", "http://a.com?/en/", "://h/p", "http://x.org/\n/y",
    "http://" + "a" * 30_000 + ".org/" + "b/" * 30_000,
]


def urls(n=900):
    rng = random.Random(2)
    return [
        f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['a', 'example', 'thing'])}.{rng.choice(['com', 'net', 'org', 'example.com'])}"
        f"/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(10**5)}{rng.choice(['', '?page=2&ref=x', '#top', '.html'])}"
        for _ in range(n)
    ]


def plain(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = [r for r in rules if (host == r.host or host.endswith(f".{r.host}")) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: (len(r.host + r.path), r.verdict == "block"), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_parts_and_rules_equal_plain_code(spark):
    rows = list(enumerate(ODD + urls(), 1)) + [(None, "http://a.net/es/"), (3, "http://a.net/es/"), (3, "http://a.net/es/")]
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], PAGES + ", host string, verdict string").repartition(3)
    got = filter_urls(frame).collect()
    assert len(got) == len(rows)
    key = lambda r: repr(r)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=key) == sorted(((i, *plain(u)[:3]) for i, u in rows), key=key)
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert all(plain(u)[3] in (None, verdicts[i]) for i, u in rows if i != 3) and set(verdicts.values()) <= {"allow", "block"}


def test_equally_long_rules(spark):
    rules = (Rule("allow", "b.c", "/x"), Rule("block", "c", "/x/y"), Rule("allow", "c", "/z"))
    rows = spark.createDataFrame([(1, "http://a.b.c/x/y")], PAGES)
    assert ruled(parts(rows), rules).first()["_verdict"] == plain("http://a.b.c/x/y", rules)[3] == "block"


def test_trees_judge_held_out_urls(spark):
    """The label follows lexical features here: many digits or parameters mean block."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        bad = i % 3 == 0
        tail = "".join(rng.choice("0123456789") for _ in range(rng.randint(9, 14))) if bad else "".join(rng.choice("abcdef") for _ in range(rng.randint(9, 14)))
        rows.append((i, f"http://h{rng.choice('xyz')}.org/{tail}{'?a=1&b=2&c=3' if bad else '/x'}", "block" if bad else "allow"))
    frame = parts(spark.createDataFrame(rows, PAGES + ", _verdict string"))
    model = fit(frame.where("page_id < 1000"))
    held = judged(frame.where("page_id >= 1000").withColumn("truth", F.col("_verdict")).withColumn("_verdict", F.lit(None).cast("string")), model)
    right = held.where("verdict = truth").count()
    assert right >= 0.97 * 500


def test_features(spark):
    row = features(parts(spark.createDataFrame([(1, "http://aab.com/x/1?p=1&q=2#z"), (2, None)], PAGES)), {"com": 0.25}, 0.5).orderBy("page_id").collect()
    assert [row[0][c] for c in ("f_length", "f_host_length", "f_labels", "f_depth", "f_parameters", "f_fragment", "f_suffix")] == [28, 7, 2, 2, 2, 1, 0.25]
    assert abs(row[0]["f_digits"] - 3 / 28) < 1e-12 and row[0]["f_entropy"] > 3
    assert row[1]["f_entropy"] == 0 and row[1]["f_suffix"] == 0.5


def test_few_or_no_labels(spark):
    assert filter_urls(spark.createDataFrame([], PAGES)).count() == 0
    assert filter_urls(spark.createDataFrame([(1, "http://x.org/"), (2, None)], PAGES)).where("verdict = 'allow'").count() == 2
    assert filter_urls(spark.createDataFrame([(1, "http://x.org/"), (2, "http://a.net/es/")], PAGES)).where("verdict = 'block'").count() == 2


def test_repeated_urls_above_the_bound(spark):
    """Copies of few urls are no reason to lose a kind of label, whatever their hashes."""
    for seed in range(6):
        rows = [(i, f"http://{'bad' if i % 7 < 2 else 'good'}{seed}{i % 7}.org/{'9' * 12 if i % 7 < 2 else 'about'}", "block" if i % 7 < 2 else "allow") for i in range(680)]
        rows += [(1000 + i, rows[0][1], "block") for i in range(300)]
        model = fit(parts(spark.createDataFrame(rows, PAGES + ", _verdict string").repartition(3)), size=100)
        assert model.trees is not None and abs(model.overall - (300 + sum(r[2] == "block" for r in rows[:680])) / 980) < 1e-9
