"""Revisit resolution against a plain loop over all captures."""

import random

import pytest

from tidepanel.llm import revisits

SCHEMA = "record_id long, kind string, status int, url string, at long, etag string, last_modified string, digest string, headers map<string,string>, slice int, near string"


def brute(rows, key):
    """Target and outcome of each revisit; ``key`` names the place a URL stands for."""
    out = []
    for i, kind, _, url, at, etag, date, digest, *_ in rows:
        if kind != "revisit":
            continue
        full = [r for r in rows if r[1] == "response" and r[2] == 200 and r[4] is not None and at is not None and r[4] < at and key[url] and key[r[3]] == key[url]]
        target = max(full, key=lambda r: (r[4], r[0]), default=None)
        strip = lambda x: x and x.strip().removeprefix("W/")
        if target is None:
            out.append((i, None, "missing"))
        elif etag is None and date is None and digest is None:
            out.append((i, target[0], "unvalidated"))
        else:
            same = strip(etag) == strip(target[5]) if etag is not None else date == target[6] if date is not None else digest == target[7]
            out.append((i, target[0], "resolved" if same else "mismatch"))
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 64])
def test_revisits_match_a_loop(spark, slices):
    r = random.Random(8)
    key = {None: None, "": None, "  ": None, "http://": None, "http://a.org/x": "x", "HTTPS://www.A.org:443/x/": "x", "a.org:80/x#y": "x", "http://a.org:8080/x": "8080", "https://a.org:80/x": "80",
           "http://a.org/x?ref=main": "ref", "http://a.org/x?utm_source=z": "x", "http://b.org/?b=1&a=2": "b", "b.org?a=2&b=1": "b", "http://u@b.org:/?a=2&b=1": "b"}
    urls = list(key)
    rows = []
    for i in range(600):
        tag, date, digest = (r.choice(c) for c in ([None, '"1"', 'W/"1"', '"2"'], [None, "d1", "d2"], [None, "g1", "g2"]))
        hot = "http://a.org/x" if i % 3 == 0 else r.choice(urls)
        rows.append((i, r.choice(["response", "revisit"]), r.choice([200, 200, 404, None]), hot, r.choice([None, *range(40)]), tag, date, digest, {"Date": str(i)}, 7, "clash"))
    rows += [rows[0], (9999, "revisit", 304, "", 50, '"1"', None, None, None, 1, "c")]
    found = revisits.resolve(spark.createDataFrame(rows, SCHEMA), slices).collect()
    assert sorted(((x.record_id, x.target_id, x.outcome) for x in found), key=str) == sorted(brute(rows, key), key=str)
    assert revisits.resolve(spark.createDataFrame([], SCHEMA), slices).collect() == []
