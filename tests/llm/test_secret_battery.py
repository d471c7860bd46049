"""The battery and its discovery control against naive versions; texts with very many candidates."""

import math
import random
import string

from orbita.llm import secret_scan

ALPHABETS = {0: "0123456789abcdef", 1: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 2: string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"}


def _naive(value):
    body = value.rstrip("=")
    if all(c in "0123456789abcdef" for c in body) or all(c in "0123456789ABCDEF" for c in body):
        enc, body = 0, body.lower()
    elif all(c in ALPHABETS[1] for c in body):
        enc = 1
    else:
        enc, body = 2, body.replace("-", "+").replace("_", "/")
    k, n = len(ALPHABETS[enc]), len(body)
    codes = [ALPHABETS[enc].index(c) for c in body]
    squares = sum(codes.count(c) ** 2 for c in set(codes))
    z1 = (squares - n - n * (n - 1) / k) / math.sqrt(2 * n * (n - 1) / k * (1 - 1 / k))
    mid = (k - 1) / 2
    turns = sum((a > mid) != (b > mid) for a, b in zip(codes, codes[1:]))
    z2 = (turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    z3 = sum((a - mid) * (b - mid) for a, b in zip(codes, codes[1:])) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
    return enc, n, min(1.0, 3 * min(tail(z1) / 2 if z1 > 0 else 1 - tail(z1) / 2, tail(z2), tail(z3)))


def _values(r, count):
    out = []
    for _ in range(count):
        a = ALPHABETS[r.randrange(3)]
        n = r.randrange(20, 90)
        kind = r.randrange(3)
        text = "".join(r.choice(a) for _ in range(n)) if kind == 0 else "".join(r.choice(a[: 4 + n % 5]) for _ in range(n)) if kind == 1 else "".join(a[i % len(a)] for i in range(n))
        out.append(text + "=" * (n % 3 == 0))
    return sorted(set(out))


def test_battery_equals_the_naive_one(spark):
    values = _values(random.Random(4), 200)
    got = {r["value"]: r for r in secret_scan.battery(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    for v in values:
        enc, n, p = _naive(v)
        assert (got[v]["enc"], got[v]["n"]) == (enc, n) and abs(got[v]["p"] - p) < 5e-7


def test_discovery_control_equals_the_naive_one(spark):
    r = random.Random(9)
    rows = [(r.randrange(3), r.randrange(3), r.choice((20.0, 30.0, 50.0, 80.0)), 10 ** -r.uniform(0, 12) if r.random() < 0.4 else r.random()) for _ in range(500)]
    got = {(x["enc"], x["stratum"]): x["limit"] for x in secret_scan.rejection_limits(spark.createDataFrame(rows, "enc int, stratum int, n double, p double")).collect()}
    for key in {x[:2] for x in rows}:
        own = [x for x in rows if x[:2] == key]
        bins = [min(63, math.floor(-2 * math.log2(p))) for *_, p in own]
        least = min(n for *_, n, _ in own)
        allowed = 0.3 if least < 24 else 0.2 if least < 40 else 0.1 if least < 64 else 0.05
        passing = [b for b in set(bins) if 2 ** (-b / 2) <= allowed * sum(c >= b for c in bins) / len(bins)]
        assert got.get(key) == (min(passing) if passing else None)


def test_many_candidates_in_one_text(spark):
    """200,000 candidates in 5 MB, half of them beside base spans; each place is right."""
    r = random.Random(1)
    parts, at, want, base = [], 0, [], []
    some = ["".join(r.choice("abcdefghij0123456789XYZ") for _ in range(22)) + f"{k}q" for k in range(2000)]
    for i in range(200_000):
        v = some[i % 2000]
        lead = "é token=" if i % 2 else "é "
        if i % 2:
            base.append((at + 2, at + len(lead) + len(v)))
        else:
            want.append((at + 2, at + 2 + len(v)))
        parts.append(lead + v)
        at += len(parts[-1]) + 1
    docs = spark.createDataFrame([(1, "\n".join(parts)), (2, None), (2, "plain")], "doc_id long, text string")
    rows, spans = secret_scan.located(docs)
    assert rows.count() == 3
    got = spans.filter("kind <> 2").select("kind", "start", "end").collect()
    assert sorted((x["start"], x["end"]) for x in got if x["kind"] == 3) == want
    assert sorted((x["start"], x["end"]) for x in got if x["kind"] == 0) == base
    out = {x["doc_id"]: x for x in secret_scan.scan(docs).collect()}
    assert out[1]["n_assign"] == 100_000 and out[1]["spans"].startswith("random:2:" if "random:2:" in out[1]["spans"] else "assign:")
    assert out[2]["spans"] == ""
