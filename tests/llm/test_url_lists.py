"""The temporal list join against a walk through the history of every key."""

import random

from panelwright.llm import url_lists as ul


def brute(captures, entries):
    out = []
    for url, day, *_ in captures:
        host, seg = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            for mark in "?#":
                rest = rest.split(mark, 1)[0]
            host, _, path = rest.partition("/")
            host = host.split("@")[-1].split(":")[0].lower()
            seg = path.split("/")[0]
        best = None
        if host and day is not None:
            labels = host.split(".")
            keys = ([f"{host}/{seg}"] if seg else []) + [".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))]
            for key in keys:
                past = sorted(((d, s, a) for k, a, d, s in entries if k == key and d is not None and d <= day))
                if past and past[-1][2] != "remove":
                    best = (key, past[-1][2], past[-1][0])
                    break
        out.append((url, day, host, bool(best and best[1] == "block"), *(best or (None, None, None))))
    return sorted(out, key=repr)


def test_histories_ties_and_odd_captures(spark):
    rng = random.Random(2)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "localhost", "www.x.org"]
    keys = hosts + ["a.example.com/en", "x.org/de", "com"]
    entries = [(rng.choice(keys), rng.choice(["block", "allow", "remove"]), rng.randrange(400), i) for i in range(60)] + [(None, "block", 1, 900), ("x.org", "block", None, 901)]
    captures = [(f"http://{rng.choice(['', 'u@'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/x?a=b', '/de#t', '?q=/en', ':80/en/'])}", rng.randrange(500), 1, "h", "k") for _ in range(400)]
    captures += captures[:5] + [(None, 3, 1, None, "k"), ("http://x.org/", None, 1, "h", "k"), ("", 9, 1, "h", "k"), ("mailto:x", 9, 1, "h", "k"), ("HTTP://X.ORG/de/" + "y" * 100000, 90, 1, "h", "k")]
    frame = spark.createDataFrame(captures, "url string, day long, segment int, d string, period string")
    got = ul.judge(frame, spark.createDataFrame(entries, "key string, action string, day long, seq long"))
    assert got.columns[:5] == frame.columns
    assert sorted(((r.url, r.day, r.host, r.blocked, r.matched_key, r.action, r.since) for r in got.collect()), key=repr) == brute(captures, entries)


def test_empty_tables(spark):
    frame, entries = spark.createDataFrame([], "url string, day long"), spark.createDataFrame([], "key string, action string, day long, seq long")
    assert ul.judge(frame, entries).count() == 0
    assert [r.blocked for r in ul.judge(spark.createDataFrame([("http://x.org", 1)], "url string, day long"), entries).collect()] == [False]
