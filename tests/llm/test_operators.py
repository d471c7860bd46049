"""Each operator against a brute-force version on small fixtures, with edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from orbita.llm import components, exact_dedup, html_blocks, mixing, order_minhash, secret_scan, sentence_pieces, shared, simhash, token_files, toxicity, url_filter

import public_tokenizers

TOKENIZERS = public_tokenizers.path("byte_bpe_50k.json").rpartition("/")[0]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for i in range(40):
        t = " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.choice((1, 6, 30, 90))))
        out.append((i, t, r.choice(("a", "b", None))))
    near = out[3][1].split() if len(out[3][1].split()) > 20 else [f"w{k}" for k in range(60)]
    out += [(100, " ".join(near), "a"), (101, " ".join(near[:-1] + ["other"]), "a"), (102, " ".join(near), "b"), (103, None, "a"), (104, "", None), (105, " \t\n", "a"), (106, "x  y\n\nz ", "b"), (107, "x y z ", "b"), (None, "no id here at all", "a"), (108, "ab\x1ccd \x85 日本 \U0001f600 <|endoftext|> z", "a"), (108, "repeated id", "a"), (108, "repeated id", "a"), (109, "word " * 3000, "b")]
    return out


def test_simhash(spark, rows):
    some = [x for x in rows if x[0] != 108]
    got = {r["doc_id"]: r for r in simhash.fingerprint_report(frame(spark, some)).collect()}
    order = sorted(some, key=lambda x: -(x[0] if x[0] is not None else -1))
    assert len(got) == len(some)
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        distance = bin(int(got[i]["fingerprint"], 16) ^ int(got[i]["edited_fingerprint"], 16)).count("1")
        assert got[i]["near_edited"] == 1 - distance / 64
        nxt = got[order[(k + 1) % len(order)][0]]
        assert got[i]["near_next"] == 1 - bin(int(got[i]["fingerprint"], 16) ^ int(nxt["fingerprint"], 16)).count("1") / 64
    assert got[100]["fingerprint"] == got[102]["fingerprint"]
    assert got[103]["fingerprint"] == got[104]["fingerprint"] == "0" * 16
    assert simhash.fingerprint_report(frame(spark, [])).count() == 0
    for text, fp in ((t or "", got[i]["fingerprint"]) for i, t, _ in some[:20]):
        words = text.split()
        pairs = list(zip(words, words[1:], strict=False)) or [(w, "") for w in words]
        votes = [0] * 64
        for r in spark.createDataFrame(pairs, "a string, b string").selectExpr("xxhash64(a, b) as h").collect() if pairs else []:
            votes = [v + (1 if r["h"] >> k & 1 else -1) for k, v in enumerate(votes)]
        assert fp == f"{sum(1 << k for k, v in enumerate(votes) if v > 0):016x}"
    near = {r["doc_id"]: r["n_within"] for r in simhash.with_neighbours(simhash.fingerprint_report(frame(spark, some))).collect()}
    every = {x["fingerprint"] for x in got.values()}
    assert near == {i: sum(0 < bin(int(f, 16) ^ int(x["fingerprint"], 16)).count("1") <= 3 for f in every) for i, x in got.items()}
    far = frame(spark, [(-(1 << 63), "a b", "a"), ((1 << 63) - 1, "c d", "a"), (0, "e f", "a")])
    assert simhash.fingerprint_report(far).count() == 3


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_fingerprints_within_radius(spark, radius):
    r = random.Random(radius)
    fps = [r.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 8))) for f in fps]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(x["a"], x["b"], x["distance"]) for x in simhash.within_radius(spark.createDataFrame([(f,) for f in signed + signed[:5] + [None]], "fp long"), radius).collect()}
    flat = sorted(set(signed))
    want = {(a, b, d) for i, a in enumerate(flat) for b in flat[i + 1 :] if (d := bin((a ^ b) & ((1 << 64) - 1)).count("1")) <= radius}
    assert got == want


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, rows, weak):
    from pyspark.sql import functions as F

    how = {"digest": lambda x: F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(x), F.lit(3))), 2, "0")), "width": 1} if weak else {}
    many = rows + [(1000 + i, "copy of  one", "a") for i in range(500)]
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(frame(spark, [x for x in many if x[0] is not None]), **how).collect())
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in many:
        if i is not None:
            groups.setdefault(norm(t), []).append(i)
    want = sorted((i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert got == want
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    if not weak:
        left = exact_dedup.deduplicated(frame(spark, many))
        assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == sorted([(False, min(g)) for g in groups.values()] + [(True, 0)])
        # one id with a copy and a text of its own; copies without id, few and many; a hot text whose first row is repeated
        odd = [(1, "first", "a"), (2, "first ", "a"), (2, "first", "a"), (2, "own", "b"), (None, "n  n", "a"), (None, "n n", "b"), (1, "first", "a")] + [(None, "m m", "a")] * 200 + [(7 + i // 2, "hot\ttext" if i % 3 else "hot text", "a") for i in range(300)]
        stay = sorted((norm(r["text"]), r["doc_id"]) for r in exact_dedup.deduplicated(frame(spark, odd)).collect())
        assert stay == [("first", 1), ("first ", 2), ("hot text", 7), ("m m", None), ("n n", None), ("own", 2)]
        assert exact_dedup.deduplicated(frame(spark, [])).count() == 0


def test_lsm_shard():
    r = np.random.default_rng(1)
    keys = np.array([bytes([x]) * 32 for x in r.integers(0, 256, 3000)], "S32")
    ids = r.integers(0, 10**6, 3000)
    shard = exact_dedup.LsmShard(memtable_rows=100)
    try:
        for at in range(0, 3000, 50):
            for run in shard.put(keys[at : at + 50], ids[at : at + 50], np.ones(50, np.int64)):
                shard.spool(run)
        for run in shard.drain():
            shard.spool(run)
        assert len(shard.runs) > 1
        got = sorted((k, i, n) for a in shard.compact() for k, i, n in zip(*a, strict=True))
        want = sorted((k, ids[keys == k].min(), (keys == k).sum()) for k in np.unique(keys))
        assert got == want
        assert (shard.get(keys[:20]) == [ids[keys == k].min() for k in keys[:20]]).all()
        assert (shard.get(np.array([b"absent" + b"\1" * 26], "S32")) == exact_dedup.NO_ID).all()
    finally:
        shard.close()


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://Example.ORG/es/x?q", "https://a.example.org/en/12", "https://example.org/en/2", "http://x.com/fr/", "http://com/de/1#t", "ftp://net", "http://a.org", "http://bexample.org/es/", "http://x.com?/de/", "s://h/a/://b"]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filtered(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    for u, (host, path, rule, verdict) in zip(urls, got, strict=True):
        rest = re.split(r"[?#]", u.split("://", 1)[1])[0] if u and "://" in u else ""
        assert (host, path) == (rest.partition("/")[0].lower(), "/" + rest.partition("/")[2] if "/" in rest else "")
        fit = [(len(r), r, v) for r, v in url_filter.RULES if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
        assert (rule, verdict) == (max(fit)[1:] if fit else (None, "allow"))


def test_html_blocks():
    page = "<html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body><nav><ul><li>Home<li>News</ul></nav><article><h1>Head &amp; line</h1><p>One <b>two</b><br>three<p>Four\n five</article><footer>&copy; me</footer>"
    got = html_blocks.blocks(page)
    assert [b.text for b in got] == ["T", "Home", "News", "Head & line", "One two three", "Four five", "© me"]
    assert html_blocks.marked(got) == [0, 0, 0, 1, 1, 1, 0]
    r = random.Random(5)
    pages = ["<body><nav><ul>" + "".join(f"<li>{r.choice(WORDS)}</li>" for _ in range(4)) + "</ul></nav><article>" + "".join(f"<p>{' '.join(r.choice(WORDS) for _ in range(30))}.</p>" for _ in range(4)) + "</article><div class=ad>buy now</div><footer>end</footer></body>" for _ in range(40)]
    model = html_blocks.train(pages[:30])
    for p, text in zip(pages[30:], html_blocks.main_texts(pages[30:], model), strict=True):
        assert text == "\n".join(re.findall(r"<p>(.*?)</p>", p))
    assert html_blocks.main_texts(["", "<br>"], model) == ["", ""]
    assert html_blocks.train([]) is None and html_blocks.main_texts(["<p>x</p>"], None) == [""]


def test_html_scripts_and_styles_are_no_markup():
    article = "<article><p>One text.</p></article>"
    for raw in ("<script>for(i=0;i<n;i++){f()}</script>", '<script>var a="<!--";</script>', "<SCRIPT>if(a<b&&c=='x){}</ScRiPt >", "<style>a:before{content:'<p'}</style>", "<template><script>x<y</script></template>", "<script>'</scripts>' <t</script\n>"):
        assert [b.text for b in html_blocks.blocks(f"<body>{raw}{article}<p>After.</p></body>")] == ["One text.", "After."], raw
    assert [b.text for b in html_blocks.blocks("<p>Before</p><script>a<b")] == ["Before"]


def test_html_in_bounds(spark):
    article = "<article>" + "".join(f"<p>{' '.join(WORDS[k:k + 9])} and so on.</p>" for k in range(6)) + "</article>"
    pages = [f"<body><nav><li>Home<li>News</nav>{article}<footer><p>me</p></footer></body>"] * 2
    odd = ["<a " * 20000, '<a "' * 20001 + ">", "<b>x" * 20000 + "<a", "<table>" + "<tr><td>c d" * 20000 + "</table>", "5 < 6 and a<b", "<div>" * 3000 + "deep text", None, ""]
    rows = [(i, "u", p, "x") for i, p in enumerate(pages + odd)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, score string")
    got = {x["page_id"]: x for x in html_blocks.extracted(table).collect()}
    assert len(got) == len(rows) and got[0]["text"] == got[1]["text"] == "\n".join(f"{' '.join(WORDS[k:k + 9])} and so on." for k in range(6))
    assert all(x["n_chars"] == len(x["text"]) for x in got.values()) and got[8]["text"] == got[9]["text"] == ""
    assert [b.text for b in html_blocks.blocks(odd[4])] == ["5 < 6 and a<b"]
    assert len(html_blocks.blocks(odd[3])) == 20000 and max(len(b.path) for b in html_blocks.blocks(odd[5])) == html_blocks.DEPTH
    assert html_blocks.extracted(table.limit(0)).count() == 0
    # no page marks its article: blocks that look like text teach the labeller
    plain = [p.replace("article", "section") for p in pages] * 10
    assert html_blocks.main_texts(plain[:1], html_blocks.train(plain))[0].count("and so on.") >= 5


def test_lstm_gradient():
    r = np.random.default_rng(0)
    net = html_blocks.Lstm(3, 2, 1)
    pages, labels = [r.normal(size=(n, 3)) for n in (4, 2)], [np.array([1.0, 0, 1, 0]), np.array([0.0, 1])]

    def loss():
        x, mask = html_blocks.padded(pages)
        y, _ = html_blocks.padded([v[:, None] for v in labels])
        z = net._margins(x.astype(float), mask)[0]
        return (np.log1p(np.exp(np.where(y[:, :, 0] > 0, -z, z)))[mask]).sum()

    before = loss()
    net.fit([p.astype(np.float32) for p in pages], labels, 400, 0)
    assert loss() < before / 3


def test_near_dedup(spark):
    r = random.Random(11)
    base = [[r.choice(WORDS) + str(r.randrange(500)) for _ in range(120)] for _ in range(12)]
    docs = []
    for b in base:
        for _ in range(r.choice((1, 3, 6))):
            c = list(b)
            for _ in range(r.randrange(0, 10)):
                c[r.randrange(len(c))] = "new" + str(r.randrange(999))
            docs.append(" ".join(c))
    docs += ["short text", "short text", None, "", docs[0].upper()]
    rows = [(i, t, "a") for i, t in enumerate(docs)] + [(None, docs[0], "a")]
    seq = [(t or "").lower().split() for t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            far = distance(seq[i], seq[j])
            if far <= order_minhash.most_edits(max(len(seq[i]), len(seq[j]))):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {x["doc_id"]: (x["class_id"], x["kept"]) for x in order_minhash.near_classes(frame(spark, rows)).collect()}
    assert got.pop(None) == (None, True)
    assert got == {i: (label[i], label[i] == i) for i in range(len(docs))}
    kept = {x["doc_id"] for x in order_minhash.deduplicated(frame(spark, rows)).collect()}
    assert kept == {None} | set(label)
    assert order_minhash.near_classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [10, 31, 40, 60, 100, 140, 300, 1000])
def test_links_meet_wherever_the_edits_are(n):
    """Pairs of edit similarity 0.9 exactly: words replaced, deleted or inserted, at random or evenly spread."""
    r = np.random.default_rng(n)
    new = lambda k: r.integers(0, 1 << 62, k).astype(np.uint64)
    keys = lambda x: np.r_[order_minhash.sketch(x), order_minhash.short_keys(x)]
    for kind in ("replace", "delete", "insert"):
        edits = order_minhash.most_edits(n) if kind != "insert" else max(e for e in range(n) if e <= 0.1 * (n + e) + 1e-9)
        even = np.unique(np.linspace(n / (2 * edits), n - n / (2 * edits), edits).astype(int))
        for spread in (False, True):
            met = 0
            for _ in range(300):
                a, at = new(n), even if spread else r.choice(n, edits, replace=False)
                b = np.delete(a, at) if kind == "delete" else np.insert(a, at, new(edits)) if kind == "insert" else a.copy()
                if kind == "replace":
                    b[at] = new(edits)
                met += bool(np.intersect1d(keys(a), keys(b)).size)
            assert met >= 0.9 * 300, (n, kind, spread, met)


def test_short_links_always_meet():
    r = random.Random(8)
    links = 0
    for _ in range(6000):
        a = [r.randrange(1 << 60) for _ in range(r.randrange(1, 31))]
        b = list(a)
        for _ in range(r.randrange(1, 5)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [r.randrange(1 << 60)] * r.randrange(2)
        if not 0 < len(b) <= 30 or distance(a, b) > order_minhash.most_edits(max(len(a), len(b))):
            continue
        links += 1
        x, y = (order_minhash.short_keys(np.array(t, np.uint64)) for t in (a, b))
        assert np.intersect1d(x, y).size, (len(a), len(b))
    assert links > 1000


def test_short_near_dedup(spark):
    texts = ["a b c d e f g h i j", "x a b c d e f g h i j", "p q r s t u v w y z", "p q x s t u v w y z", "one two three four", "one two three five"]
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.near_classes(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}


def test_k_mers_with_and_without_repeats_agree():
    once = np.arange(5, dtype=np.uint64)
    assert order_minhash.labelled(np.r_[once, once[:1]])[:5].tolist() == order_minhash.labelled(once).tolist()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_alignment():
    r = random.Random(1)
    pairs, want = [], []
    for _ in range(200):
        a = [r.randrange(20) for _ in range(r.choice((0, 1, 4, 25, 80)))]
        b = list(a)
        for _ in range(r.randrange(0, len(a) // 2 + 2)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [r.randrange(20)] * r.randrange(2)
        d = distance(a, b)
        pairs.append((np.array(a, np.int64), np.array(b, np.int64)))
        want.append((d <= order_minhash.most_edits(max(len(a), len(b))), d))
    near, low, high = order_minhash.bounds(pairs)
    assert near.tolist() == [w for w, _ in want]
    assert all(lo <= d <= hi for lo, hi, (_, d) in zip(low, high, want, strict=True))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1001 + k) for k in range(50)] + [(k, k + 1) for k in range(2000, 2040)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(edges)):
        old = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    looped = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    want = {k: v for k, v in label.items() if k not in looped}
    assert got == want
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    for cut in (0, 100, 220):  # first some edges, then the others
        both = components.extended(components.components(frame(edges[:cut])), frame(edges[cut:])).collect()
        assert {x["node"]: x["label"] for x in both} == want and len(both) == len(want)


def test_toxicity(spark):
    r = random.Random(4)
    bad = ["idiot", "stupid", "moron"]
    texts, labels = [], []
    for i in range(300):
        words = [r.choice(WORDS) for _ in range(25)]
        if i % 4 == 0:
            words[r.randrange(25)] = r.choice(bad)
            words[r.randrange(25)] = r.choice(bad)
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(900, None, "a"), (901, "you id-iot i d i o t", "a"), (None, "alpha", "a")])
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.scored(docs, marks).collect()}
    assert len(got) == 303 and got[900]["predicted"] == 0 and got[901]["predicted"] == 1
    out = [(got[i]["predicted"], y) for i, y in enumerate(labels) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert np.mean([a == b for a, b in out]) > 0.95
    left = toxicity.without_toxic(docs, marks)
    assert {x["doc_id"] for x in left.collect()} == {i for i, x in got.items() if x["score"] < 0.5} and left.columns == docs.columns
    assert {x["score"] for x in toxicity.scored(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.scored(frame(spark, []), marks).count() == 0


def test_mixing(spark, rows):
    docs = frame(spark, rows + [(2000 + i, "w " * (i % 50), "c") for i in range(300)])
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    again = sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert again == sorted(map(str, got))
    total, left = sum(x["size"] for x in got), {}
    by = {}
    for x in got:
        assert x["taken"] <= 2 * x["size"] and (not x["size"] or x["taken"] % x["size"] == 0)
        s = by.setdefault((x["source_size"], x["target"]), [0, 0])
        s[0] += x["taken"]
        s[1] = max(s[1], x["size"])
    for (size, target), (taken, longest) in by.items():
        assert abs(taken - target) <= max(1, longest) and target <= 2 * size + 1e-9
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total, left
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(x["taken"] // x["size"] for x in got if x["size"]) + out.filter("not text rlike '[^\\\\s]' or text is null").count()
    assert mixing.mix(frame(spark, [])).count() == 0
    nameless = mixing.mix(frame(spark, [(None, f"w{i} x", "n") for i in range(400)] + [(i, "y z", "m") for i in range(100)])).filter("doc_id is null").collect()
    assert abs(sum(x["taken"] for x in nameless) - nameless[0]["target"]) <= 2


def test_secrets(spark):
    r = random.Random(9)
    rand = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choice(a) for _ in range(n))
    hexed = rand(40, "0123456789abcdef")
    texts = [None, "", "plain words only", f'token = "{hexed}" é AKIA{rand(16, "ABCDEFGH234")} x', "password=token:abcdefghi", "Secret: short", "PASSWD='longenough1' api-key = zzzzzzzzz", f"{hexed}{hexed} AKIAshort", f"日本 {rand(44)} and aaaaaaaaaaaaaaaaaaaa1aaaaaaaaaaaaaaaaaaaaa", f"password={hexed} password={hexed}"]
    got = {x["doc_id"]: x for x in secret_scan.scan(frame(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(50, texts[3], "a"), (50, texts[3], "a")])).collect()}
    kinds = (("assign", secret_scan.ASSIGN, lambda m: len(m[2]) >= 8), ("access", secret_scan.ACCESS, lambda m: len(m[0]) >= 16), ("hex", secret_scan.HEX, lambda m: len(m[0]) >= 32))
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m))
        text = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (t, text, got[i]["spans"])
        assert [got[i][n] for n in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(text.split(",")) <= set(got[i]["spans"].split(",")) | {""}
    assert "random:3:47" in got[8]["spans"] and got[8]["spans"].count("random") == 1
    assert secret_scan.scan(frame(spark, [(1, texts[8], "a")] * 3)).count() == 3
    assert secret_scan.scan(frame(spark, [])).count() == 0


def test_random_strings_are_found_and_words_are_not(spark):
    r = random.Random(21)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    secrets = ["".join(r.choice(alphabets[i % 3]) for _ in range((24, 28, 31)[i % 3] if i % 3 == 0 else r.randrange(24, 80))) for i in range(300)]
    words = ["-".join(r.choice(WORDS) for _ in range(r.randrange(6, 12))) + str(i % 10) for i in range(300)]
    texts = [f"see {x} there" for x in secrets + words]
    got = {x["doc_id"]: x["spans"] for x in secret_scan.scan(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    candidates = [i for i in range(300) if re.search("[0-9]", secrets[i]) and re.search("[A-Za-z]", secrets[i])]
    caught, wrong = sum("random" in got[i] for i in candidates), sum("random" in got[300 + i] for i in range(300))
    assert caught >= 0.9 * len(candidates) and wrong <= 0.1 * caught, (caught, len(candidates), wrong)


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    lib = Tokenizer.from_file(path)
    docs = frame(spark, rows)
    parts = token_files.write(docs, shared.fresh(spark, "t"), path)
    got = sorted(((x["doc_id"] is not None, x["doc_id"] or 0, x["start"]), x) for x in token_files.read(spark, parts, True).collect())
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at = 0
    for (i, t, _), (_, x) in zip(order, got, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (x["doc_id"], x["start"], x["n_tokens"], x["ids"]) == (i, at, len(ids), ids)
        assert x["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.token_files(frame(spark, []), path).count() == 0


def test_words_are_looked_up_one_by_one(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 40)
    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as f:
        enc = token_files.Encoder(f.read())
    plain = ["it's we'd they'll I'm 'sa 's'S ''ve", "x1 12 _-- ß É  \t\n end ", "", "'"] + [f"word{'abcdefgh'[i % 8] * i} it's {i}" for i in range(60)]
    odd = ["×÷ ß\u00a0É", "a\x1cb", "<|endoftext|> x", "< | <|", "日本 x", "\x00'll", "a\u200b b", "½ 1²"]
    want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in plain + odd]
    assert [x for t in plain + odd for x in enc.encode([t])] == want
    for name in ("_of", "_raw"):  # for other texts only
        monkeypatch.setattr(enc, name, None)
    assert [x for t in plain for x in enc.encode([t])] == want[: len(plain)]


def test_sentence_pieces(spark, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    texts = {i: t or "" for i, t, _ in rows if i != 108}
    got = {x["doc_id"]: x for x in sentence_pieces.encoded(frame(spark, [x for x in rows if x[0] != 108]), f"{TOKENIZERS}/piece_bpe_32k.model").collect()}
    for i, t in texts.items():
        assert got[i]["ids"] == lib.encode(t) and got[i]["decoded_same"] and got[i]["n_pieces"] == len(got[i]["ids"])
    assert sentence_pieces.encoded(frame(spark, []), f"{TOKENIZERS}/piece_bpe_32k.model").count() == 0
    model, r = sentence_pieces.pieces(open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb").read()), random.Random(2)
    assert model.chained  # so ids come from the Viterbi over merge histories
    kinds = ["abcdefghijklmnopqrstuvwxyz ", "aA bB.,;", "éàüñ çß ", "漢字かな交じり文 ", "0123456789 .,-", "ab", " \n\t!?", "🙂é a", "()[]{}<>=;\"' x", "лорем ипсум "]
    fuzz = ["".join(r.choice(r.choice(kinds) if k % 2 else kinds[k // 2 % len(kinds)]) for _ in range(r.randrange(1, 60))) for k in range(3000)] + ["".join(r.choice("abcde漢") for _ in range(5000))]
    for t, ids in zip(fuzz, model.encode(fuzz), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t), t
        assert model.decode(ids) == lib.decode(lib.encode(t))


def test_viterbi():
    r = random.Random(6)
    texts = {"▁", *"abcd", *("".join(r.choice("abcd▁"[: 4 + (k == 0)]) for k in range(r.randrange(2, 5))) for _ in range(40))}
    texts = {t for t in texts if "▁" not in t.lstrip("▁")}
    model = sentence_pieces.Pieces([("<unk>", 0.0, 2)] + [(t, r.uniform(-9, -1), 1) for t in sorted(texts)], unigram=True)
    score = {t: s for t, s, k in model.pieces if k == 1}

    def best(word):
        found = [(0.0, [])] + [(-np.inf, None)] * len(word)
        for j in range(1, len(word) + 1):
            found[j] = max(((found[i][0] + score[word[i:j]], [*found[i][1], word[i:j]]) for i in range(j) if word[i:j] in score and found[i][1] is not None), default=(-np.inf, None), key=lambda x: x[0])
        return found[-1][1]

    for _ in range(100):
        text = " ".join("".join(r.choice("abcd") for _ in range(r.randrange(1, 9))) for _ in range(3))
        ids = np.frombuffer(model.encode([text])[0], "<u4")
        want = [p for w in re.findall("▁[^▁]*", "▁" + text.replace(" ", "▁")) for p in best(w)]
        assert [model.pieces[i][0] for i in ids] == want
        assert model.decode(ids.astype("<u4").tobytes()) == text


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    r = random.Random(8)
    rows = [(i, " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(40)) + (" idiot moron" if i % 5 == 0 else ""), "ab"[i % 2]) for i in range(120)]
    rows += [(500 + i, rows[i + 1][1], "a") for i in range(10)] + [(600, rows[7][1] + " more", "b")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left, seen = docs, []
    for name, stage in c.STAGES:
        before, left = left, shared.written(stage(spark, left, str(tmp_path)), "t")
        seen.append({x["doc_id"] for x in left.select("doc_id").collect()})
        if name != "sentence_pieces":
            assert left.columns == before.columns
    assert not seen[0] & {i for i in range(0, 120, 5)} and len(seen[0]) > 95
    assert not seen[1] & {500, 501, 502} - {500 + i for i in range(10) if (i + 1) % 5 == 0}
    assert 600 not in seen[2] and seen[3] <= seen[2] and seen[4] == seen[3]
    assert sorted(x["doc_id"] for x in c.run(spark, str(tmp_path)).collect()) == sorted(x["doc_id"] for x in left.collect())


def test_columns_of_clashing_names_and_repeated_rows(spark):
    names = ("row", "digest", "norm", "id", "salt", "node", "size", "score", "html", "draw", "words", "key", "label", "_x")
    rows = [(1, "one two three", "en", "a"), (1, "one two three", "en", "a"), (2, None, None, None), (None, "one  two three", "en", "b")]
    docs = spark.createDataFrame([(*r, 0, *("y" for _ in names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    marks = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for run in (simhash.fingerprint_report, exact_dedup.exact_dedup, order_minhash.near_classes, lambda d: toxicity.scored(d, marks), mixing.mix, secret_scan.scan, lambda d: token_files.token_files(d, f"{TOKENIZERS}/byte_bpe_50k.json"), lambda d: sentence_pieces.encoded(d, f"{TOKENIZERS}/piece_bpe_32k.model")):
        assert run(docs).count() == 4
    assert exact_dedup.deduplicated(docs).columns == order_minhash.deduplicated(docs).columns == mixing.mixed(docs).columns == toxicity.without_toxic(docs, marks).columns == docs.columns
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>t</p>", *("y" for _ in names if _ != "html"))] * 2, "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names if n != "html"))
    assert url_filter.filtered(pages).count() == html_blocks.extracted(pages).count() == 2
    assert url_filter.filtered(pages.limit(0)).count() == 0


def test_outlying_ids_do_not_gather_the_rest(spark):
    ids = [*range(-1500, 3000, 3), *range(10**9, 10**9 + 900), 10**15, (1 << 63) - 1, -(1 << 63) + 1, None]
    docs = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string")
    rows = simhash.edited_neighbours(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + 1
    assert max(sizes.values()) <= 4 * simhash.ROWS_PER_BUCKET + 8
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    want = {i: f"text of {j}" for i, j in zip(order, order[1:] + order[:1], strict=True)}
    assert {r["doc_id"]: r["next_text"] for r in rows if not r["guest"]} == want
