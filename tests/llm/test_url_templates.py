import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from blockscope.llm import queries
from blockscope.llm import url_templates as u

RULES = queries.URL_RULES


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (found[1].translate(str.maketrans(u._UPPER, u._LOWER)), found[2]) if found else ("", "")


def rule(host, path):
    fits = []
    for verdict, text in RULES:
        its, _, rest = text.partition("/")
        if (host == its or host.endswith("." + its)) and path.startswith("/" + rest):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


def shape(path):
    path = re.sub("/+", "/", re.sub("[0-9]+", "*", path))
    return path[:-1] if len(path) > 1 and path.endswith("/") else path


def brute(urls, labels):
    """Rejected (host, shape) by the tree, with dictionaries."""
    tree = defaultdict(lambda: [0, 0, 0])
    for url, good in [(x, None) for x in urls] + [x for x in labels if x[1] is not None]:
        host, path = parts(url)
        cell = tree[host, shape(path)]
        cell[0] += 1
        cell[1] += good is not None
        cell[2] += bool(good)
    template = dict.fromkeys(tree, "")
    segments = {}
    for key in tree:
        s = [x for x in key[1].split("/") if x]
        segments[key] = s if len(s) <= u.LEVELS else [*s[: u.LEVELS - 1], "/".join(s[u.LEVELS - 1 :])]
    for level in range(max(map(len, segments.values()), default=0)):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for key, cell in tree.items():
            if level < len(segments[key]):
                child = nodes[key[0], template[key]][segments[key][level]]
                for k in range(3):
                    child[k] += cell[k]
        wild = {}
        for node, children in nodes.items():
            total = [sum(c[k] for c in children.values()) for k in range(3)]
            pooled = total[2] / max(total[1], 1)
            for name, c in children.items():
                small = len(children) > u.MOST_BRANCHES and c[0] * u.MOST_BRANCHES < total[0]
                unsure = small and c[1] < u.PRIOR_LABELS
                error = math.sqrt(c[1] * pooled * (1 - pooled))
                wild[node, name] = unsure or abs(c[2] - c[1] * pooled) <= u.APART * error + 1e-9
        step = {}
        for key in tree:
            if level < len(segments[key]):
                name = segments[key][level]
                step[key] = template[key] + "/" + ("*" if wild[(key[0], template[key]), name] else name)
        template |= step
    pools = defaultdict(lambda: [0, 0])
    for key, cell in tree.items():
        pools[key[0], template[key]][0] += cell[1]
        pools[key[0], template[key]][1] += cell[2]
    n, good = (sum(c[k] for c in tree.values()) for k in (1, 2))
    prior = good / n if n else 1.0
    return {
        key
        for key in tree
        if (pools[key[0], template[key]][1] + u.PRIOR_LABELS * prior) / (pools[key[0], template[key]][0] + u.PRIOR_LABELS)
        < u.LEAST_PURITY
    }


def expected(urls, labels):
    rejected = brute([x for _, x in urls], labels)
    out = []
    for page, url in urls:
        host, path = parts(url)
        text, verdict = rule(host, path)
        verdict = verdict or ("block" if (host, shape(path)) in rejected else "allow")
        out.append((page, host, path, text, verdict))
    return sorted(out, key=str)


def frames(spark, urls, labels):
    return (
        spark.createDataFrame([(*x, "x", 1) for x in urls], "page_id long, url string, host string, good int"),
        spark.createDataFrame([(*x, "x") for x in labels], "url string, good boolean, template string"),
    )


def judged(spark, urls, labels):
    out = u.judge_urls(*frames(spark, urls, labels), RULES)
    return sorted((tuple(r[:5]) for r in out.collect()), key=str)


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://", "", ""), ("HTTP://A.Example.COM", "a.example.com", ""),
        ("http://h/p?q=http://x/y#z", "h", "/p"), ("http://h?a/b", "h", ""), ("http://h#/b", "h", ""), ("x://É.de/É//", "É.de", "/É//"),
        ("a/b?c://h/p", "h", "/p"), ("http://u:p@h:80/ a\nb", "u:p@h:80", "/ a\nb"),
    ],
)
def test_host_and_path(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string")
    assert tuple(df.select(u.host_of(F.col("url")), u.path_of(F.col("url"))).first()) == (host, path)
    assert parts(url) == (host, path)


@pytest.mark.parametrize(
    ("url", "text"),
    [
        ("http://a.net/x", "net/"), ("http://net/x", "net/"), ("http://a.net", None), ("http://anet/x", None),
        ("http://example.net/en/1", "example.net/en/"), ("http://b.example.net/en/", "example.net/en/"),
        ("http://example.net/en", "net/"), ("http://xexample.net/en/1", "net/"), ("http://www.example.com/de/", "example.com/de/"),
        ("http://a.org/fr/", "org/fr/"), ("http://a.org/FR/", None),
    ],
)
def test_longest_rule(spark, url, text):
    df = spark.createDataFrame([parts(url)], "host string, path string")
    assert df.select(u.rule_of(F.col("host"), F.col("path"), RULES)).first()[0] == text == rule(*parts(url))[0]


def made(n):
    """Hosts with a bad section, a section like its siblings, slugs, and digits."""
    urls, labels = [], []
    for k in range(n):
        for path, good in (
            (f"/news/{k}.html", k % 10 > 0), (f"/blog/{k}", k % 9 > 0), (f"/cheap/{k}", k % 20 == 0),
            (f"/by-name/title-{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}/x", k % 7 > 0), (f"/deep/a/b/c/d/e/f/g/h/{k}", True),
        ):
            urls.append((len(urls), f"http://h{k % 2}.example.com{path}"))
            if k % 3:
                labels.append((urls[-1][1], good))
    return urls, labels


def test_bad_sections_are_rejected_and_others_not(spark):
    urls, labels = made(120)
    got = judged(spark, urls, labels)
    assert got == expected(urls, labels)
    blocked = {re.sub("[0-9]+", "*", r[2]) for r in got if r[4] == "block"}
    assert blocked == {"/cheap/*"}


@pytest.mark.parametrize("sections", [15, 40])
def test_a_bad_section_is_blocked_among_few_and_among_many(spark, sections):
    """With the last section all bad; single bad labels of many titles stay with their siblings."""
    names = ["s" + "abcdefgh"[k // 8] + "abcdefgh"[k % 8] for k in range(sections)]
    urls = [(25 * k + n, f"http://h/{name}/{n}") for k, name in enumerate(names) for n in range(25)]
    labels = [(url, f"/{names[-1]}/" not in url) for _, url in urls for _ in range(4)]
    titles = ["t" + "abcdefgh"[k // 8] + "abcdefgh"[k % 8] for k in range(40)]
    urls += [(10_000 + k, f"http://g/{x}") for k, x in enumerate(titles)]
    labels += [(f"http://g/{x}", k > 1) for k, x in enumerate(titles)]
    got = judged(spark, urls, labels)
    assert got == expected(urls, labels)
    assert {r[2].split("/")[1] for r in got if r[4] == "block"} == {names[-1]}


def test_edge_rows(spark):
    urls = [(1, None), (2, ""), (3, "x"), (None, "http://a/b"), (4, "http://a/b"), (4, "http://a/b"), (5, "http://a/" + "s/" * 4000), (6, "http://a.net/")]
    labels = [("http://a/b", None), ("http://a/b", False), ("http://a/b", True), (None, False), ("http://unseen/", False)]
    assert judged(spark, urls, labels) == expected(urls, labels)
    assert judged(spark, urls, []) == expected(urls, [])
    assert judged(spark, [], labels) == []


def test_query_equals_brute_force(spark):
    home = "/root/testdata/sf0.01"
    urls = [tuple(r) for r in spark.read.parquet(f"{home}/pages.parquet").select("page_id", "url").collect()]
    labels = [tuple(r) for r in queries.page_labels(spark, home).select("url", "good").collect()]
    assert len(labels) > 50
    got = sorted((tuple(r[:5]) for r in queries.op6_url_templates(spark, home).collect()), key=str)
    assert got == expected(urls, labels)


def test_no_python_in_the_plan(spark):
    plan = queries.op6_url_templates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
