"""URL rules against every combination of tokens, and the whole query over tables with planted rules."""

import math
import random
import re
import time
from collections import defaultdict
from itertools import combinations

import pytest
from test_copies import assert_same
from test_pages import split_url

from caseloom.llm import queries, url_filter


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tokens(url):
    if not url or "://" not in url:
        return frozenset()
    host, path = split_url(url)
    found = {f"s:{url.split('://')[0]}"}
    labels = host.split(".") if host else []
    found |= {f"h:{'.'.join(labels[i:])}" for i in range(len(labels))}
    found |= {f"p:{w}" for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(path))}
    query = re.match(r"(?s)^.*?://[^?#]*\?([^#]*)", url)
    found |= {f"q:{k}" for k in re.findall(r"(?:^|&)([^=&]+)", query.group(1))} if query else set()
    return frozenset(found | ({"f:"} if "#" in url else set()))


def mined(rows, support=url_filter.SUPPORT, least=url_filter.LEAST, confidence=url_filter.CONFIDENCE):
    """All rules, from all combinations of tokens of the blocked rows; rows (url, blocked)"""
    baskets = [(tokens(u), b) for u, b in rows if u is not None and b is not None and tokens(u)]
    need = max(least, math.ceil(support * len(baskets)), 1)
    where = defaultdict(set)
    for i, (held, _) in enumerate(baskets):
        for token in held:
            where[token].add(i)
    blocked = {i for i, (_, b) in enumerate(baskets) if b}
    speaking = {}
    for token, at in where.items():
        if len(at) < len(baskets) and len(at & blocked) >= need:
            key = frozenset(at)
            speaking[key] = max(speaking.get(key, ""), token, key=lambda t: (len(t), t))
    rules, level = {}, {(t,): at for at, t in speaking.items()}
    while level:
        for items, at in level.items():
            if len(at & blocked) / len(at) >= confidence:
                rules[items] = (len(at & blocked) / len(at), len(at & blocked) / len(baskets))
        after = {}
        for items, at in level.items():
            for other, token in speaking.items():
                if token > items[-1] and len(at & other & blocked) >= need:
                    after[(*items, token)] = at & other
        level = after
    out = {}
    for items, (sure, share) in rules.items():
        shorter = (c for n in range(1, len(items)) for c in combinations(items, n))
        if not any(c in rules and rules[c][0] >= sure for c in shorter):
            out[items] = (sure, share)
    return out


def planted(seed, count):
    pick = random.Random(seed)
    words = ["news", "blog", "casino", "bonus", "shop", "de", "item", "win"]
    rows = []
    for _ in range(count):
        host = pick.choice(["a.example.net", "b.example.net", "c.org", "www.d.com", "e.co.uk"])
        path = pick.sample(words, pick.randint(1, 4))
        url = f"{pick.choice(['http', 'https'])}://{host}/{'/'.join(path)}{pick.choice(['', '?id=1&ref=x', '#top', '?win=2'])}"
        bad = "casino" in path or ({"bonus", "win"} <= set(path)) or (host == "e.co.uk" and "shop" in path)
        rows.append((url, bad != (pick.random() < 0.08)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_all_combinations(spark, seed):
    rows = [*planted(seed, 500), (None, True), ("nothing", True), ("http://c.org/casino", None)]
    found = url_filter.mine(spark.createDataFrame(rows, "url string, blocked boolean").repartition(4)).collect()
    expected = mined(rows)
    assert {tuple(r["items"]) for r in found} == set(expected) and len(expected) > 3
    assert any(len(items) > 1 for items in expected)
    for r in found:
        assert (r.confidence, r.support) == pytest.approx(expected[tuple(r["items"])])


def test_templated_urls_stay_cheap(spark):
    """Words that always occur together are one; 16 of them would make 65,536 combinations."""
    path = "/".join(f"word{i}" for i in range(16))
    rows = [(f"http://www.site{i % 3}.example.com/{path}/{'casino' if i % 4 == 0 else 'page'}/{i}", i % 4 == 0) for i in range(400)]
    rows += [(f"http://other.net/{path}/{i}", False) for i in range(100)]
    start = time.perf_counter()
    found = url_filter.mine(spark.createDataFrame(rows, "url string, blocked boolean")).collect()
    assert time.perf_counter() - start < 60
    assert {tuple(r["items"]) for r in found} == set(mined(rows)) == {("p:casino",)}


def test_whole_query_over_planted_rules(spark, tmp_path):
    rows = planted(5, 900)
    extra = [(None, 5000), ("no scheme", 5001), ("http://x.example.org/es/casino", 5002), ("http://new.com/de/casino", 5003), ("http://z.net/bonus/win", 5004)]
    pages = [(i, u) for i, (u, _) in enumerate(rows)] + [(i, u) for u, i in extra] + [(5004, "http://z.net/news")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    labels = [(i, 0 if b and i % 2 else 1, 1 if b and not i % 2 else 0) for i, (_, b) in enumerate(rows[:600])]
    labels += [(5000, 0, 1), (None, 0, 1), (700, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    evidence = [(u, b) for u, b in rows[:600]] + [(rows[700][0], False), (None, True)]
    rules, expected = mined(evidence), []
    for id, url in pages:
        host, path = split_url(url)
        fits = [
            (len(h + p), len(h), f"{h}{p}", verdict)
            for verdict, h, p in url_filter.GIVEN
            if (host == h or host.endswith(f".{h}")) and path.startswith(p)
        ]
        sure = max((c for items, (c, _) in rules.items() if set(items) <= tokens(url)), default=None)
        rule, verdict = max(fits)[2:] if fits else (None, "block" if sure is not None else "allow")
        expected.append((id, host, path, rule, verdict, sure and round(sure, 9)))
    found = [(*r[:5], r[5] and round(r[5], 9)) for r in queries.op1_url_filter(spark, str(tmp_path)).collect()]
    assert_same(found, expected)
    by_method = [r for r in expected if r[3] is None and r[4] == "block"]
    assert len(by_method) > 50 and any(r[3] and r[5] for r in expected)
