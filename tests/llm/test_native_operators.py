"""URL reputation and license rules against plain-Python versions."""

import math
import os
import re
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from revlens.llm import license_rules, url_reputation  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# --- urls --------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http://A.Example.NET", "http://a.example.net/", "http://a.example.net/en/x?y#z",
        "http://example.net/en/", "http://badexample.net/en/", "https://example.com/de/1", "https://EXAMPLE.com/DE/1", "ftp://x.org/fr/a#b",
        "http://u:p@h.co.uk:80/en/", "http://1.2.3.4/de/", "x://a?b/c", "x://a#b", "http://a.com/http://b.net/", "http://İ.net/ \n/", "http://org/fr/" + "z" * 5000]


def parts(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(brute.LOW), re.match(r"[^?#]*", rest[len(host):])[0]


def fitting(host, path):
    found = []
    for rule in ("net/", "example.net/en/", "example.com/de/", "org/fr/"):
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            found.append(rule)
    return max(found, key=len) if found else None


def posteriors(hosts, outcomes):
    """hosts: name -> (domain, suffix); outcomes: name -> [bad, ...]."""
    def level(groups):  # name -> (bad, n, prior)
        extra = sum((b - n * m) ** 2 - n * m * (1 - m) for b, n, m in groups.values())
        scale = sum(n * m * (1 - m) * (n - 1) for b, n, m in groups.values())
        rho = min(max(extra / scale if scale > 0 else 1.0, 1 / 10001), 1 / 2)
        s = 1 / rho - 1
        return {g: (s * m + b, s * (1 - m) + n - b) for g, (b, n, m) in groups.items()}

    def sums(key):
        out = defaultdict(lambda: [0, 0])
        for h in hosts:
            out[key(h)][0] += sum(outcomes[h])
            out[key(h)][1] += len(outcomes[h])
        return out
    mean = lambda ab: ab[0] / sum(ab)
    total = (sum(map(sum, outcomes.values())) + 0.5) / (sum(map(len, outcomes.values())) + 1)
    suffix = level({g: (b, n, total) for g, (b, n) in sums(lambda h: hosts[h][1]).items()})
    domain = level({g: (b, n, mean(suffix[g[1]])) for g, (b, n) in sums(lambda h: hosts[h]).items()})
    return level({h: (b, n, mean(domain[hosts[h]])) for h, (b, n) in sums(lambda h: h).items()})


def test_urls(spark):
    urls = list(enumerate(URLS)) + [(100 + i, f"http://{h}.example.com/en/{i}") for i in range(300) for h in [("bad" if i % 3 == 0 else f"s{i % 7}")]]
    urls += [(5, URLS[5]), (None, "http://s1.example.com/")]
    bad = [(p, u is not None and "bad" in u and p % 9 != 0) for p, u in urls if p is not None and p % 2 == 0 and p != 5]
    extra = [(7, None), (None, True), (999999, True), (100, True)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    labels = spark.createDataFrame(bad + extra, "page_id long, bad boolean").withColumn("path", F.lit(3))
    got = url_reputation.judge_urls(pages, labels).collect()
    domains = {"a.example.net": ("example.net", "net"), "example.net": ("example.net", "net"), "badexample.net": ("badexample.net", "net"),
               "example.com": ("example.com", "com"), "x.org": ("x.org", "org"), "u:p@h.co.uk:80": ("h.co.uk", "co.uk"), "1.2.3.4": ("1.2.3.4", ""),
               "a": ("a", "a"), "a.com": ("a.com", "com"), "İ.net": ("İ.net", "net"), "org": ("org", "org"), "": ("", "")}
    by_id = defaultdict(list)
    for p, b in bad + extra:
        if p is not None and b is not None:
            by_id[p].append(b)
    outcomes = defaultdict(list)
    hosts = {}
    for p, u in dict.fromkeys(urls):
        h = parts(u)[0]
        hosts[h] = domains.get(h) or ("example.com", "com")
        outcomes[h] += by_id.get(p, [])
    post = posteriors(hosts, {h: outcomes[h] for h in hosts})
    want = []
    for p, u in urls:
        host, path = parts(u)
        a, b = post[host]
        rule = fitting(host, path)
        lower = max(0.0, a / (a + b) - 1.645 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))))
        verdict = ("block" if rule in ("net/", "example.com/de/") else "allow") if rule else ("block" if lower > 0.3 else "allow")
        want.append((p, host, path, rule, verdict, round(lower, 9)))
    assert sorted((*tuple(r)[:5], round(r.lower, 9)) for r in got if r.page_id is not None) == sorted(w for w in want if w[0] is not None)
    assert len(got) == len(urls)
    assert {r.verdict for r in got if r.host == "bad.example.com" and r.rule is None} == {"block"}
    assert {r.verdict for r in got if r.host == "s1.example.com" and r.rule is None} == {"allow"}
    assert url_reputation.judge_urls(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in url_reputation.judge_urls(pages, labels.limit(0)).collect() if r.rule is None} == {"allow"}


def test_rule_order(spark):
    df = spark.createDataFrame([("a.b.c", "/x/y")], "h string, p string")
    pick = lambda rules: df.select(url_reputation.rule_of(F.col("h"), F.col("p"), rules)).first()[0]
    assert pick(["c/x/y", "b.c/x/"]) == "b.c/x/" and pick(["c/"]) == "c/" and pick(["d/"]) is None and pick([]) is None
    with pytest.raises(ValueError):
        url_reputation.judge_urls(df, df, block=("c/",), allow=("c/",))


# --- licenses ------------------------------------------------------------------

def license_row(doc_id, text, table):
    words = brute.words(text)
    norm = " " + " ".join(words) + " "
    low = (text or "").lower()
    hits = []
    gates = {"licen" if "licen" in r.pattern else r.keyword for r in table}
    for r in table if words and any(g in low for g in gates) else ():
        if " " + r.keyword in norm:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
                start = norm[:m.start()].count(" ") - 1
                hits.append((start, start + m[0].count(" ") + 1, r))

    def gives_way(d, e):
        if not (e[0] <= d[0] and e[1] >= d[1]):
            return False
        size = (e[1] - e[0]) - (d[1] - d[0])
        return e[2].priority < d[2].priority or e[2].priority == d[2].priority and (size > 0 or size == 0 and e[2].name < d[2].name)
    base = [h for h in hits if h[2].priority == 0]
    found = [d for d in hits if d[2].priority == 0 or not any(gives_way(d, e) for e in hits)]
    join = lambda hs: ",".join(sorted({h[2].label for h in hs}))
    return (doc_id, len(words), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None),
            join(base), join(found), max((h[2].score for h in found), default=0.0))


TEXTS = [None, "", " .,- ", "MIT License", "mit license mit license", "mit\nLicense, under the GNU Lesser General Public License, version 2.1 or later",
         "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "emit licenses", "mit x license", "mit licenses",
         "Released under the MIT License. Released under the BSD-3-Clause license.", "Permission is hereby granted, free of charge, to any person obtaining a copy",
         "All rights reserved. Kein Mit. License: ISC", "apache_license", "\u212a apache license", "ÀMIT License", "MIT license\u00a0x",
         "w " * 20000 + "general public license " + "w " * 100, "mit license " * 60, "this is distributed under the terms of the Mozilla Public License v 2 0"]


def test_licenses(spark):
    docs = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "mit license")]
    docs += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("norm", F.lit("x")).withColumn("hits", F.lit(1)).repartition(4)
    table = license_rules.rules()
    assert 200 < len(table) == len({r.name for r in table})
    assert rows(license_rules.license_report(df)) == sorted((license_row(d, t, table) for d, t in docs), key=str)
    assert license_rules.license_report(df.limit(0)).count() == 0
    labels = {r.doc_id: r.labels for r in license_rules.license_report(df.where("doc_id < 100")).collect()}
    assert labels[5] == "gpl,lgpl" or "lgpl" in labels[5]
    assert labels[7] == "gpl" and labels[12] == "mit" and "isc" in labels[13]


def forms(pattern, rng):
    """One string that ``pattern`` matches, branches and counts drawn at random."""
    from re import _parser

    def draw(items):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += "1" if str(arg[0][0]) == "CATEGORY" else chr(rng.choice(arg)[1])
            elif name == "SUBPATTERN":
                out += draw(arg[-1])
            elif name == "BRANCH":
                out += draw(rng.choice(arg[1]))
            elif name == "MAX_REPEAT":
                out += "".join(draw(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], 2))))
            else:
                raise AssertionError(name)
        return out
    return draw(_parser.parse(pattern))


def test_gates_are_implied():
    """Every text that a rule matches opens the rule's keyword and the first gate."""
    import random
    rng = random.Random(3)
    table = license_rules.rules()
    gates = {"licen" if "licen" in r.pattern else r.keyword for r in table}
    for r in table:
        for _ in range(100):
            text = " " + forms(r.pattern, rng) + " "
            assert re.search(f"(?<= )(?:{r.pattern})(?= )", text) and " " + r.keyword in text and any(g in text for g in gates), (r.name, text)


def test_licenses_spelled_out(spark):
    """Against all rules run without their keywords; names that share no word with their short forms."""
    from dataclasses import replace
    want = {"Under the GNU Library General Public License, version 2": "gpl,lgpl", "GNU Lesser General Public License": "gpl,lgpl",
            "the Common Development and Distribution License": "cddl", "CDDL license": "cddl", "Creative Commons Attribution Share Alike License": "cc-by-sa",
            "attribution non commercial license": "cc-by-nc", "Do What The Fuck You Want To Public License": "wtfpl", "WTFPL license": "wtfpl",
            "SPDX-License-Identifier: CDDL-1.0": "cddl", "Licensed under the Creative Commons Attribution-ShareAlike license": "cc-by-sa"}
    docs = list(enumerate([*want, *TEXTS])) + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ungated = [replace(r, keyword="") for r in license_rules.rules()]
    got = rows(license_rules.license_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)))
    assert got == sorted((license_row(d, t, ungated) for d, t in docs), key=str)
    assert [r[6] for r in sorted((r for r in got if r[0] < len(want)), key=lambda r: r[0])] == list(want.values())
