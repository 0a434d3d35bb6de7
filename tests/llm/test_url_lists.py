import datetime
import random

from pyspark.sql import functions as F

from vacantia.llm import url_lists

DAY = datetime.date(2020, 1, 1)
CAPTURES, ENTRIES = "id long, url string, day date", "list string, pattern string, day date, added boolean"


def covers(pattern, url):
    rest = url.split("://", 1)[-1].split("#")[0].split("?")[0]
    host, _, path = rest.partition("/")
    host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
    if "/" in pattern:
        own, _, prefix = pattern.partition("/")
        parts, wanted = [p for p in path.split("/") if p], prefix.split("/")
        return own == host and parts[:len(wanted)] == wanted
    return host == pattern or host.endswith("." + pattern)


def brute(captures, entries, blocking):
    out = {}
    for i, url, day in captures:
        active = []
        for name, pattern in {(e[0], e[1]) for e in entries if e[1] is not None}:
            before = [e for e in entries if e[:2] == (name, pattern) and e[2] is not None and day and e[2] <= day]
            if before and url:
                last = max(e[2] for e in before)
                if all(e[3] for e in before if e[2] == last) and covers(pattern, url):
                    active.append((len(pattern), name in blocking, pattern, name))
        best = max(active, default=None)
        out[i] = (len(active), best[2] if best else None, best[3] if best else None, bool(best and best[1]))
    return out


def test_against_every_entry(spark):
    rng = random.Random(20)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "hot.net", "c.co.uk"]
    paths = ["", "/", "/p", "/p/q?z=1", "//p/q/r#f", "/pq"]
    day = lambda: DAY + datetime.timedelta(days=rng.randrange(900))
    captures = [(i, f"http://{rng.choice(hosts + ['hot.net'] * 5)}{rng.choice(paths)}", day()) for i in range(500)]
    captures += [(900, None, DAY), (901, "not a url", DAY), (902, "http://a.com/", None), (903, "HTTPS://u:p@X.A.com.:8080/p", day()),
                 (904, "http://a.com/" + "p/" * 3000, day())]
    patterns = hosts + ["com", "uk", "hot.net/p", "hot.net/p/q", "a.com/p", "other.io"]
    entries = [(rng.choice(["bad", "worse", "fine"]), rng.choice(patterns), day(), rng.random() < 0.6) for _ in range(150)]
    entries += entries[:5] + [("bad", None, DAY, True), ("bad", "b.org", None, True)]
    found = url_lists.judged(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES), ["bad", "worse"])
    got = {r["id"]: (r["n_active"], r["pattern"], r["list"], r["blocked"]) for r in found.collect()}
    want = brute(captures, entries, ["bad", "worse"])
    assert any(v[3] for v in want.values()) and got == want


def test_border_days_repeats_and_no_rows(spark):
    entries = [("bad", "a.com", DAY, True), ("bad", "a.com", DAY + datetime.timedelta(40), False)]
    days = [-1, 0, 39, 40, 41]
    captures = [(i, "http://a.com", DAY + datetime.timedelta(d)) for i, d in enumerate(days)] * 2
    table = spark.createDataFrame(captures, CAPTURES).withColumn("month", F.lit("clash"))
    listed = spark.createDataFrame(entries, ENTRIES)
    found = url_lists.judged(table, listed, ["bad"]).collect()
    assert sorted((r["id"], r["blocked"]) for r in found) == sorted([(0, False), (1, True), (2, True), (3, False), (4, False)] * 2)
    assert url_lists.judged(table.limit(0), listed, ["bad"]).count() == 0
    assert [r["blocked"] for r in url_lists.judged(table, listed.limit(0), ["bad"]).collect()] == [False] * 10


def test_an_entry_never_removed_holds_for_ever(spark):
    days = [datetime.date(2020, 1, 1), datetime.date(2099, 12, 31), datetime.date(2150, 6, 1)]
    captures = spark.createDataFrame([(i, "http://a.com/x", d) for i, d in enumerate(days)], CAPTURES)
    entries = spark.createDataFrame([("spam", "a.com", datetime.date(2020, 1, 2), True), ("ads", "a.com", days[0], True),
                                     ("ads", "a.com", datetime.date(2100, 1, 1), False)], ENTRIES)
    found = {r["id"]: (r["n_active"], r["blocked"]) for r in url_lists.judged(captures, entries, ["spam"]).collect()}
    assert found == {0: (1, False), 1: (2, True), 2: (1, True)}
