"""Lines that name other systems."""

from graphloom.sources import signals


def _sections(spark, rows, **limits):
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    out = signals.signal_sections(files, **limits).orderBy("repo", "category", "position").collect()
    return [(r.repo, r.category, r.key, r.line) for r in out]


def test_first_line_of_each_key_in_five_categories(spark):
    code = '\n  u = "https://API.Pay.example:8080/x" + "http://github.com/a" + "http://raw.github.com/b"\r\nx = os.environ["PAY_URL"]\ny = os.environ["PAY_MODE"]\n'
    code += 'z = getenv("JOBS_QUEUE")\nclient.publish(topic="orders.made")\ndsn = "postgres://db1/shop"\nc = NewClient("pay:443")\nagain = "https://api.pay.example/y"\n'
    rows = [("a", "b.py", code), ("a", "a.md", "https://skipped.test"), ("a", "z.go", "// https://api.pay.example"), ("a", ".env", "S=http://first.test"), ("a", "n.py", None)]
    assert _sections(spark, rows) == [
        ("a", "client", "pay:443", 'b.py:8: c = NewClient("pay:443")'),
        ("a", "datastore", "postgres://db1/shop", 'b.py:7: dsn = "postgres://db1/shop"'),
        ("a", "env", "pay_url", 'b.py:3: x = os.environ["PAY_URL"]'),
        ("a", "env", "jobs_queue", 'b.py:5: z = getenv("JOBS_QUEUE")'),
        ("a", "messaging", "orders.made", 'b.py:6: client.publish(topic="orders.made")'),
        ("a", "url", "first.test", ".env:1: S=http://first.test"),
        ("a", "url", "api.pay.example", 'b.py:2: u = "https://API.Pay.example:8080/x" + "http://github.com/a" + "http://raw.github.com/b"'),
    ]


def test_limits_are_tested_before_a_line(spark):
    rows = [("a", "a.py", "http://h1.test\nhttp://h2.test http://h3.test\nhttp://h4.test " + "x" * 300), ("a", "b.py", "http://h5.test"), ("b", "a.py", "http://h4.test " + "x" * 300)]
    got = _sections(spark, rows, per_category=2)
    assert [(r, k) for r, _, k, _ in got] == [("a", "h1.test"), ("a", "h2.test"), ("a", "h3.test"), ("b", "h4.test")]
    assert got[-1][3] == "a.py:1: " + ("http://h4.test " + "x" * 300)[:200]
    assert [k for r, _, k, _ in _sections(spark, rows, max_files=1) if r == "a"] == ["h1.test", "h2.test", "h3.test", "h4.test"]
