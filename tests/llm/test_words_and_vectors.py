"""Whitening, decontamination and spelling variants against brute force, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from orbita.llm import decontamination, spelling, whitening


def _centre(x):
    return whitening.Centre(len(x), tuple(int(v) for v in x.sum(axis=0)))


def test_products_are_compensated():
    r = np.random.default_rng(0)
    x = (r.integers(-(10**9), 10**9, (300, 4)) // np.array([1, 10**3, 10**7, 10**9])).astype(np.int64) + 10**12
    at = _centre(x)
    high, low = whitening.gram(*at.centred(x))
    mean = [Fraction(int(s), len(x)) for s in x.sum(axis=0)]
    for i in range(4):
        for j in range(4):
            want = sum((Fraction(int(a)) - mean[i]) * (Fraction(int(b)) - mean[j]) for a, b in zip(x[:, i], x[:, j]))
            scale = sum(abs(Fraction(int(a)) - mean[i]) * abs(Fraction(int(b)) - mean[j]) for a, b in zip(x[:, i], x[:, j]))
            assert abs(Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - want) <= scale * Fraction(2) ** -92


def _rows(r):
    base = r.normal(size=(120, 6)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.1])
    rows = [(i, [float(np.float32(v)) for v in base[i]]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # a third are copies
    return rows, [(300, None), (301, [1.0] * 5 + [None]), (302, [1.0] * 5 + [float("nan")]), (303, [1.0] * 5 + [float("inf")]), (304, []), (305, [1.0, 2.0])]


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening(spark, parts, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    good, bad = _rows(np.random.default_rng(5))
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in [*good, (None, good[0][1]), *bad]], "vec_id long, embedding array<double>, n long, component string").repartition(parts)
    got = whitening.whitened(frame).toPandas()
    x = np.array([[int(np.floor(64 * c)) + 1000000 for c in v] for _, v in good], object)
    fit = np.array(sorted({tuple(v) for v in x}), object)
    n, sums = len(fit), fit.sum(axis=0)
    assert set(got["n"]) == {n} and len(got) == (len(good) + 1) * 6
    d = (fit * n - sums).astype(np.float64) / n
    v = d.T @ d / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    by = {(None if np.isnan(r.vec_id) else int(r.vec_id), r.component): r for r in got.itertuples()}
    assert by[None, 1].whitened == by[0, 1].whitened
    sign = {}
    for (i, _), row in zip(good, x):
        want = (row * n - sums).astype(np.float64) / n @ q / np.sqrt(e)
        for k in range(6):
            r = by[i, k + 1]
            assert r.deviation == int(((row * n - sums) ** 2).sum())
            sign.setdefault(k, np.sign(want[k] * r.whitened))
            assert r.whitened == pytest.approx(want[k] * sign[k], rel=1e-9, abs=1e-9)
            assert r.explained == pytest.approx(e[k] / v.trace(), rel=1e-9) and r.identity_error < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).collect() == []
    # one direction of variance among three; huge entries have no exact long
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 0.0, 2.0 * i]) for i in range(9)], schema)).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)
    huge = whitening.whitened(spark.createDataFrame([(i, [1e300 * (i % 2), float(i)]) for i in range(4)], schema)).collect()
    assert {r["deviation"] for r in huge} == {None} and all(np.isfinite(r["whitened"]) for r in huge)


def test_matrices_of_many_tasks_merge_in_groups(spark):
    r = np.random.default_rng(2)
    high, low = r.normal(size=(70, 2, 2)), r.normal(size=(70, 2, 2)) * 1e-18
    rows = [(p, i, high[p, i].tolist(), low[p, i].tolist()) for p in range(70) for i in range(2)]
    got = whitening.merged(spark.createDataFrame(rows, whitening.PART), 4)
    for i in range(2):
        for j in range(2):
            want = sum(Fraction(float(h[i, j])) + Fraction(float(l[i, j])) for h, l in zip(high, low))
            assert abs(Fraction(float(got[0][i, j])) + Fraction(float(got[1][i, j])) - want) < Fraction(2) ** -95


def test_eigenvectors_of_close_values():
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.normal(size=(30, 30)))
    e = 1 + 1e-6 * np.arange(30)[::-1]
    v = (q * e) @ q.T
    values, axes = whitening.eigen((v + v.T) / 2, np.zeros((30, 30)))
    assert np.abs(axes.T @ axes - np.eye(30)).max() < 1e-14
    wide = ((v + v.T) / 2).astype(np.longdouble)
    assert np.abs(wide @ axes - axes * values).max() < 1e-15


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(text, bench):
    text = text or ""
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    words = WORD.findall(text.translate(FOLD))
    hit, items = set(), set()
    for i, t in bench:
        own = WORD.findall((t or "").translate(FOLD))
        size = min(10, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1) if own else ():
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                items.add(i)
    runs = []
    for k in sorted(hit):
        if runs and runs[-1][1] == k:
            runs[-1][1] = k + 1
        else:
            runs.append([k, k + 1])
    return len(words), len(hit), sorted(x for x in items if x is not None), [(places[a][0], places[b - 1][1]) for a, b in runs]


@pytest.fixture(scope="module")
def tests_and_texts():
    r = random.Random(8)
    words = "Der Hund läuft über 12 Wiesen und 日本 x\U0001f600y sieht Äpfel a1 b2 c3".split()
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    bench = [(i, line(r.choice((1, 2, 9, 10, 11, 30)))) for i in range(20)]
    bench += [(3, line(12)), (40, bench[5][1]), (None, line(14)), (41, None), (42, " .,; "), (43, bench[6][1].upper())]
    docs = [(i, line(r.choice((0, 3, 20, 80))) + " -- " + r.choice(bench)[1].replace(" ", ",\n ") + "! " + line(4) if i % 2 else line(60)) for i in range(40)]
    docs += [(100, None), (101, ""), (None, bench[0][1]), (102, "ABC" * 10), (102, bench[8][1]), (103, (line(2000) + " ") * 20)]
    return bench, docs


@pytest.mark.parametrize("block", [1 << 22, 400])
def test_decontamination(spark, tests_and_texts, block):
    bench, docs = tests_and_texts
    if block == 400:
        docs = docs[:12] + docs[-6:-1]
    b = spark.createDataFrame([(i, t, "x") for i, t in bench[: None if block > 400 else 6]], "item_id long, text string, row string")
    d = spark.createDataFrame([(i, t, "s", "f", k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, row string, found string, k long")
    got = {r["row"]["k"]: r for r in decontamination.scanned(d, b, ["k"], block_bytes=block).collect()}
    assert len(got) == len(docs)
    want = {k: _brute(t, bench[: None if block > 400 else 6]) for k, (_, t) in enumerate(docs)}
    for k, (n, hit, items, spans) in want.items():
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) == (n, hit, items, spans), docs[k]
    clean = decontamination.decontaminated(d, b, block_bytes=block)
    assert clean.columns == d.columns and {r["k"] for r in clean.collect()} == {k for k, w in want.items() if not w[1]}
    if block > 400:
        for r in decontamination.report(d.filter("doc_id < 40"), b).collect():
            n, hit, items, _ = want[r["doc_id"]]
            assert (r["n_items"], r["contaminated"]) == (len(items), hit > 0)
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def test_decontamination_edges(spark):
    b, d = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.report(d, b).collect()) == [(1, 2, 0, 0), (2, 0, 0, 0)]
    assert decontamination.report(d.limit(0), b).count() == 0
    long = spark.createDataFrame([(1, "w " * 1_500_000 + "one two three four five six seven eight nine ten")], "doc_id long, text string")
    item = spark.createDataFrame([(7, "One two three; four five six seven eight nine TEN")], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"]) for r in decontamination.report(long, item).collect()] == [(1_500_010, 10)]


def _spelled(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))

    out, form = {}, {}
    for w in n:
        others = [v for v in n if v != w and near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form[w], n[w], len(others)]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, out[w][1], out[w][2], n.get(out[w][0]))
    return out


def test_spelling(spark):
    r = random.Random(6)
    stems = ["maison", "mäßig", "théâtre", "aabbaab", "Straßen", "hello", "hallo", "hullo", "ÀÉÎÕ÷×ÿ"] + ["".join(r.choice("abc") for _ in range(r.choice((4, 5, 6)))) for _ in range(40)]
    docs = []
    for i in range(400):
        words = [r.choice(stems) for _ in range(20)]
        k = r.randrange(20)
        at = r.randrange(len(words[k]))
        words[k] = words[k][:at] + r.choice(("", "a", "é", words[k][at] * 2)) + words[k][at + 1 :]
        docs.append((i, r.choice((" ", "-", "1")).join(words)))
    docs += [(500, None), (501, ""), (None, "maison " * 9), (502, "hallo " * 3000), (503, "x" * 3 + " abc"), (502, "hallo hallo")]
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n long")
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling.variants(frame).collect()}
    want = _spelled(docs)
    assert got == want and any(w[0] and w[1] != w[0] for w in want.values())


def test_spelling_edges(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "ab" * 60_000
    rows = [(i, long) for i in range(4)] + [(10 + i, long[:50_000] + "c" + long[50_000:]) for i in range(9)] + [(30 + i, long[:-1] + "z") for i in range(5)]
    got = {(len(x["word"]), x["n"]): x for x in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _spelled_long(rows)
    assert {k: (x["n_near"], x["form"] is not None) for k, x in got.items()} == want


def _spelled_long(rows):
    counts = Counter()
    for i, t in rows:
        h = zlib.crc32(f"{i}:{t}".encode())
        counts[t[: h % len(t)] + t[h % len(t) + 1 :] if h % 97 == 0 else t] += 1
    n = {w: c for w, c in counts.items() if c >= 3}
    assert len(n) == 3  # the long word, one letter more, one replaced
    a, b, c = (next(w for w in n if test(w)) for test in (lambda w: "c" not in w and "z" not in w, lambda w: "c" in w, lambda w: "z" in w))
    return {(len(a), n[a]): (2, n[b] >= 2 * n[a]), (len(b), n[b]): (1, n[a] >= 2 * n[b]), (len(c), n[c]): (1, n[a] >= 2 * n[c])}


def test_deletion_keys():
    words = ["aab", "abab", "ß÷ÿaa", "x", "", "hello"]
    whole, less, word, place, begins = spelling.keys_of(words + [w[:k] + w[k + 1 :] for w in words for k in range(len(w))])
    n = len(words)
    strings = [w[:k] + w[k + 1 :] for w in words for k in range(len(w))]
    assert less[: len(strings)].tolist() == whole[n:].tolist()
    for i, w in enumerate(words):
        own = [strings[j] for j in range(len(strings)) if word[j] == i and begins[j]]
        assert len(own) == len(set(own)) and set(own) == {w[:k] + w[k + 1 :] for k in range(len(w))}
    assert place[:3].tolist() == [0, 1, 2]
