import datetime as dt
from collections import defaultdict

import pytest

from seqtok.llm import url_filters as uf

pytest_plugins = ["llm_fixtures"]

D = dt.date
T = lambda m, d: dt.datetime(2024, m, d, 13, 30)
ENTRIES = [
    ("spam", "bad.example.com", "add", D(2024, 1, 10)), ("spam", "bad.example.com", "remove", D(2024, 2, 10)),
    ("spam", "bad.example.com", "add", D(2024, 3, 1)), ("spam", "bad.example.com", "add", D(2024, 3, 5)),
    ("spam", "BAD.example.com", "add", D(2024, 3, 5)), ("adult", "example.com", "add", D(2024, 2, 1)),
    ("adult", "example.com", "remove", D(2024, 2, 1)), ("path", "ok.org/x/y", "add", D(2023, 1, 1)),
    ("path", "ok.org/x", None, D(2023, 1, 1)), (None, "ok.org", "add", D(2023, 1, 1)),
    ("null", None, "add", D(2023, 1, 1)), ("null", "ok.org", "add", None), ("org", "ok.org", "add", D(2024, 6, 1)),
]
CAPTURES = [
    (1, "http://bad.example.com/a", T(1, 9)), (2, "http://bad.example.com/a", T(1, 10)),
    (3, "https://www.BAD.example.com:8080/q?x#y", T(2, 9)), (4, "http://bad.example.com", T(2, 10)),
    (5, "http://bad.example.com/a", T(3, 2)), (6, "http://user@bad.example.com/", T(12, 1)),
    (7, "http://ok.org/x/y/z", T(1, 1)), (7, "http://ok.org/x/y/z", T(1, 1)), (8, "http://ok.org/x/yy", T(1, 1)),
    (9, "https://notbad.example.com/", T(2, 5)), (10, None, T(1, 1)), (11, "", T(1, 1)), (12, "ftp://ok.org", T(7, 1)),
    (13, "http://ok.org", None), (None, "http://ok.org", T(7, 1)), (14, "http://example.com/", T(5, 5)),
]


def _brute():
    days = defaultdict(dict)
    for lst, pat, act, day in ENTRIES:
        if lst and pat and day:
            k = (lst, pat.lower())
            days[k][day] = days[k].get(day, True) and act == "add"
    out = []
    for i, url, t in CAPTURES:
        hits = set()
        if url and t and url.lower().startswith(("http://", "https://")):
            rest = url.lower().split("://", 1)[1].split("#")[0].split("?")[0]
            host, _, path = rest.partition("/")
            host = host.split("@")[-1].split(":")[0]
            labels = host.split(".")
            cand = {".".join(labels[k:]) for k in range(max(1, len(labels) - 1))}
            parts = [p for p in path.split("/") if p]
            cand |= {host + "/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)}
            for (lst, pat), states in days.items():
                seen = [d for d in states if d <= t.date()]
                if pat in cand and seen and states[max(seen)]:
                    hits.add((lst, pat))
        out.append((i, url, t, bool(hits), sorted({a for a, _ in hits}), sorted({b for _, b in hits})))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_equals_brute_force(shipped, monkeypatch, limit):
    monkeypatch.setattr(uf, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(uf, "ROWS_PER_SALT", 1)
    caps = shipped.createDataFrame([(*c, "e", 1) for c in CAPTURES],
                                   "page_id long, url string, fetch_time timestamp, pattern string, day int")
    ents = shipped.createDataFrame(ENTRIES, "list_name string, pattern string, action string, entry_date date")
    out = uf.filter_urls(caps, ents)
    got = sorted(((r.page_id, r.url, r.fetch_time, r.blocked, r.lists, r.patterns) for r in out.collect()), key=str)
    assert got == _brute()
    assert out.columns == [*caps.columns, "blocked", "lists", "patterns"]


def test_empty_tables(shipped):
    caps = shipped.createDataFrame(CAPTURES, "page_id long, url string, fetch_time timestamp")
    ents = shipped.createDataFrame(ENTRIES, "list_name string, pattern string, action string, entry_date date")
    assert uf.filter_urls(caps.limit(0), ents).count() == 0
    assert uf.filter_urls(caps, ents.limit(0)).where("blocked").count() == 0


def test_columns_named_like_the_result_are_replaced(shipped):
    caps = shipped.createDataFrame([(*c, "x", 7) for c in CAPTURES], "page_id long, url string, fetch_time timestamp, Blocked string, LISTS int")
    ents = shipped.createDataFrame(ENTRIES, "list_name string, pattern string, action string, entry_date date")
    out = uf.filter_urls(caps, ents)
    assert out.columns == ["page_id", "url", "fetch_time", "blocked", "lists", "patterns"]
    assert out.where("blocked").count() == sum(r[3] for r in _brute())
