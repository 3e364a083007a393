"""Merged observations against the same merge in Python, with sources beyond the bound."""

from __future__ import annotations

import random

import pytest

from newsweft.operators import candidates as C

SEEN = "company_id long, seq long, url string, kind string, confidence double, method string"


@pytest.mark.parametrize("most", [3, 200])
def test_merge_against_python(spark, most):
    r, rows = random.Random(2), []
    for seq in range(1500):
        path = f"/f{r.randrange(260 if seq % 2 else 6)}"
        url = f"https://{r.choice(['', 'www.'])}x.org{path}{r.choice(['', '?a=1', '?b=22'])}{r.choice(['', '#s'])}" if r.random() < 0.95 else "https://x.org/sitemap.xml"
        rows.append((seq % 2, seq, url, r.choice(["html", "rss"]), r.choice([0.2, 0.5, 0.9]), r.choice(["link", "feed"])))
    want = {}
    for company, _, url, kind, confidence, method in rows:
        if "sitemap" in url:
            continue
        url = url.split("#")[0]
        key = (company, kind, url.replace("www.", "").split("?")[0] if kind == "html" else url.replace("www.", ""))
        if key not in want:
            if sum(k[0] == company for k in want) >= most:
                continue
            want[key] = [url, confidence, []]
        have = want[key]
        if confidence > have[1] or (confidence == have[1] and ("?" in url, len(url)) < ("?" in have[0], len(have[0]))):
            have[0] = url
        have[1] = max(have[1], confidence)
        have[2].append(method)
    got = {(x["company_id"], x["kind"], x["key"]): (x["url"], x["confidence"], x["n_observations"], x["methods"]) for x in C.merge_observations(spark.createDataFrame(rows, SEEN), most).collect()}
    assert got == {k: (v[0].split("?")[0] if k[1] == "html" else v[0], v[1], len(v[2]), sorted(set(v[2]))) for k, v in want.items()}
    assert max(sum(k[0] == c for k in got) for c in (0, 1)) == (most if most == 3 else 200) and not C.merge_observations(spark.createDataFrame([], SEEN)).count()
