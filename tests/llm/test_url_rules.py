"""Many rules of one host: each is sent to every range of the host's urls, but a url costs its paths' different lengths only, so ten
times the rules are far from ten times the work."""

import time

from parchmill.llm import urls


def test_many_rules_of_one_host(spark):
    rows = spark.range(20_000).selectExpr("id as page_id", "concat('https://a.example.net/d', id % 5000, '/x/', id) as url")
    took = {}
    for n in (2_000, 20_000, 2_000, 20_000):
        rules = spark.range(n).selectExpr("concat('example.net/d', id, '/') as rule", "if(id % 2 = 0, 'block', 'allow') as verdict")
        began = time.perf_counter()
        got = urls.filter_urls(rows, rules).collect()
        took[n] = time.perf_counter() - began
        for r in got[::97]:
            k = r.page_id % 5000
            assert (r.rule, r.verdict) == ((f"example.net/d{k}/", "allow" if k % 2 else "block") if k < n else (None, "allow"))
    assert took[20_000] < 4 * took[2_000] + 2, took
