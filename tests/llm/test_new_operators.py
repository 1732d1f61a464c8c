"""Secret scans, filter audit and spelling variants against brute force."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare
from pyspark.sql import functions as F

from rillflow.llm import audit, bagminhash, decontaminate, packing, queries, revisits, secrets, spelling, substring, tagpaths
from rillflow.session import shared_folder

DOCS = "doc_id long, text string, lang string"


# ---- secrets -----------------------------------------------------------------------------------


def base_by_hand(text):
    """Spans of the contract, found one position at a time."""
    forms = {
        "assign": (re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    out = []
    for k, (kind, (form, ok)) in enumerate(forms.items()):
        at = 0
        while at < len(text):
            m = form.match(text, at)
            if not m:
                at += 1
                continue
            if ok(m):
                out.append((m.start(), k, m.end(), kind))
            at = m.end()
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def check_scan(rows, docs):
    want = {i: base_by_hand(t or "") for i, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(kind) for s in base) for kind in ("assign", "access", "hex"))
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("literal")] == base
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])))


def test_secret_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op11_secret_scan(spark, sf_dir).collect()
    check_scan(rows, docs)


def test_base_spans_of_odd_texts(spark, tmp_path):
    rng = random.Random(3)
    bits = ["token", "TOKEN", "api_key", "apikey", "ſecret", "toKen", "secret", "passwd", "=", ":", " ", '"', "'", "abc", "abcdef", "é", "😀", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "ABCDEF", "\n", "-"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(3000)] + [(3000, None), (3001, ""), (3002, "token=token:abcdefgh"), (3003, "é token: abcdef" * 30_000), (3002 + 2, 'token = "' + "a" * 200_000)]
    spark.createDataFrame([(i, t, None, "x") for i, t in docs], "doc_id long, text string, TEXT2 string, `a.b` string").write.parquet(str(tmp_path / "documents.parquet"))
    check_scan(queries.op11_secret_scan(spark, str(tmp_path)).collect(), docs)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('db_password = "hunter2!x"', ["hunter2!x"]),
        ("k = 'Zx81kkQw90'\nuser = 'bob'\ncfg.password = k", ["Zx81kkQw90"]),
        ("a = 'Zx81kk'\nb = a + 'Qw90pp'\nc = b\nconnect(user='bobbob1', passwd=c)", ["Zx81kk", "Qw90pp"]),
        ("a = 'Zx81kkQw90'\na = 'nothing here'\npassword = a", ["nothing here"]),
        ('{"user": "admin-one", "client_secret": "q7w8e9r0t1"}', ["q7w8e9r0t1"]),
        ("database:\n  user: admin1\n  password: s3cr3tPa55\n", ["s3cr3tPa55"]),
        ("export AWS_SECRET=abCD12efGH34\necho done", ["abCD12efGH34"]),
        ("ENV API_TOKEN 9f8e7d6c5b4a", ["9f8e7d6c5b4a"]),
        ("<password>tr0ub4dor&3</password><user>somebody1</user>", ["tr0ub4dor&3"]),
        ('System.setProperty("db.password", "tr0ub4dor3");', ["tr0ub4dor3"]),
        ('client.setPassword("tr0ub4dor3")', ["tr0ub4dor3"]),
        ('os.environ["API_TOKEN"] = "9f8e7d6c5b4a"', ["9f8e7d6c5b4a"]),
        ("const apiKey: string = 'AbCd1234EfGh';", ["AbCd1234EfGh"]),
        ("$pass = 'AbCd1234EfGh';\n$dsn_password = $pass;", ["AbCd1234EfGh"]),
        ("p = 'AbCd1234EfGh'\nauth_secret = f\"{p}\"", ["AbCd1234EfGh"]),
        ('password = os.getenv("DB", "f4llb4ckPw")', ["f4llb4ckPw"]),
        ("host = 'server-nr-12'\nport = 5432", []),
        ("password = 'changeme'\nsecret = '<your secret>'\ntoken = None", []),
        ("password_hint = 'name of your cat 1'\nmax_tokens = '1234567'", []),
        ("The secret: nobody knows what it was, and it's don't.", []),
        ('if password == "tr0ub4dor3": pass', []),
        ("password = get_it\nsecret = other.name", []),
        ("", []),
    ],
)
def test_pairs_and_propagation(text, want):
    assert [text[r["start"] : r["end"]] for r in secrets.scan_text(text) if r["kind"] == "literal"] == want


def test_scan_edges(spark):
    rows = [(1, 'token = "abc123def"', "x", "y"), (1, 'token = "abc123def"', "x", "y"), (2, None, None, None)]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, FOUND string, `a.b` string"))
    assert out.columns == ["doc_id", "FOUND", "a.b", "found"] and out.count() == 3
    assert secrets.scan(spark.createDataFrame([], "text string, found int")).collect() == []


# ---- audit -------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    """Every order applied row by row."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    judged = []
    for i, t, lang in docs:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        judged.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, removed_by = {}, Counter()
    parts = {j[0] for j in judged}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in parts:
            rows = left = [j for j in judged if j[0] == part]
            for step, x in enumerate(order, 1):
                gone = [j for j in left if x in j[1]]
                left = [j for j in left if x not in j[1]]
                removed_by[part, x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in j[1] for j in rows) - len(gone), sum(j[1] == {x} for j in rows), sum(j[2] for j in gone), sum(j[3] for j in gone)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


@pytest.mark.parametrize("chain_bytes", [5000, 1 << 26])
def test_audit(spark, chain_bytes, monkeypatch):
    rng = random.Random(8)
    some = ["", None, "A b c", "a " * 250, " ".join(f"w{i}" for i in range(300)), "X|y " * 300, "É" * 50 + " Z", "w x\x1cy " * 210, "# " + " ".join(f"u{i}" for i in range(200))]
    docs = [(rng.choice([None, *range(400)]), rng.choice(some) if rng.random() < 0.7 else "common text", rng.choice(["en", "de", "", None])) for _ in range(900)]
    docs += [(5, "twice", "en")] * 40 + [(2, "twice", "de"), (9, "twice", None)]
    labels = [(rng.choice([None, *range(500)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)]
    monkeypatch.setattr(audit.failures, "__defaults__", (*audit.failures.__defaults__[:-1], chain_bytes))
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS + ", LANG2 string, `a.b` string").repartition(7)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audited(audit.audit(df, marks))
    assert got == audit_by_hand(docs, labels)
    assert audit.audit(df.limit(0), marks).collect() == []
    assert len(audited(audit.audit(df, marks.limit(0)))) == len(got)


def test_chains_of_colliding_hashes():
    chains = audit.Chains(lambda text: 7)
    out = [row for t, i in (("a", 3), ("b", 1), ("a", 1), ("b", 4), ("a", 2), ("a", 1)) for row in chains.add(t.encode(), i, 0, {"en": 1})]
    assert out == [(3, "en", 16, 1), (4, "en", 16, 1), (2, "en", 16, 1)]
    assert sorted(link for _, link in chains.drain()) == [(b"a", 1, 0, {"en": 2}), (b"b", 1, 0, {"en": 1})]


# ---- spelling ----------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(docs, factor=5, least_length=6, least_count=5):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    held = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    close = {w: [] for w in held}
    for a, b in itertools.combinations(held, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-held[v], v), default=None)
        form[w] = best if best is not None and held[best] >= factor * held[w] else None
    out = set()
    for w in held:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, held[w], len(close[w]), held[form[w]] if form[w] else None))
    return out


def test_spelling_of_a_small_alphabet(spark):
    """Dense neighbourhoods, long chains of forms, ties, runs of one letter."""
    rng = random.Random(2)
    docs = []
    for i in range(1500):
        words = ["".join(rng.choices("aabcéÀß", k=rng.choice([3, 6, 6, 7, 8]))) for _ in range(6)]
        words += ["aaaaaa"] * rng.choice([0, 0, 3]) + ["AAAAAa", "aaaaaaa"] * (i % 9 == 0) + ["bbbbbb", "bbbbbc"] * (i % 40 == 0)
        words += ["cccccc"] * 20 + ["ccccca"] * 2 * (i % 4 == 0) + ["cccca"] + ["ccccba"] * (i % 15 == 0) + ["cccbba"] * (i % 100 == 0)
        docs.append((rng.choice([None, i]), rng.choice([" ", "-", "1", "\n"]).join(words)))
    docs += [(1, None), (2, ""), (3, "x" * 300_000), (4, "÷×÷×÷×÷ " * 9)]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, WORD int, `a.b` string")
    got = [tuple(r) for r in spelling.spelling_variants(df).collect()]
    want = variants_by_hand(docs)
    assert len(got) == len(want) and set(got) == want
    assert any(form and root != form for _, form, root, *_ in want)
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_spelling_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op13_spelling_variants(spark, sf_dir).collect()]
    want = variants_by_hand(docs)
    assert len(got) == len(want) and set(got) == want


def test_keys_of_long_words():
    own, blanked, deleted = spelling.word_keys("ab" * 20_000)
    assert len(set(blanked)) == 40_000 and len(set(deleted)) == 40_000
    assert own not in blanked and spelling.word_keys("ab" * 19_999 + "a")[0] == deleted[0]
    assert spelling.word_keys("aab")[1][0] == spelling.word_keys("aac")[1][0] and len(spelling.word_keys("aaaa")[2]) == 1


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_spelling_variants"])
def test_new_queries_match_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name]) > 0


# ---- packing of many sources -------------------------------------------------------------------


def first_counts(lengths, shares, window):
    """Counts at every window's edge by sorting all tokens."""
    w = np.array(shares, float) / np.sum(shares)
    tokens = sorted(((i + 0.5) / w[s], s) for s, n in enumerate(lengths) for i in range(n))
    c, out = np.zeros(len(lengths), int), []
    for k, (_, s) in enumerate(tokens):
        if k % window == 0:
            out.append(c.copy())
        c[s] += 1
    return np.array([*out, c])


def test_counts_of_the_round_robin():
    rng = np.random.default_rng(6)
    for trial in range(120):
        q = int(rng.integers(1, 12))
        lengths = rng.integers(1, 200, q)
        shares = (lengths, rng.integers(1, 6, q), rng.random(q) ** 4 + 1e-6)[trial % 3]
        window = int(rng.integers(q, 40))
        want = first_counts(lengths, shares, window)
        assert (packing.Plan(lengths.tolist(), [float(x) for x in shares], window).allocated(np.arange(len(want))) == want).all()


def test_a_thousand_queues_in_bounded_memory():
    """512 documents of 1,000 tokens, as a task holds them: about 250,000 pieces."""
    rng = np.random.default_rng(0)
    plan = packing.Plan([1_000_000] * 1000, [1.0] * 1000, 2048)
    queue, place, n = rng.integers(0, 1000, 512), 5000 + rng.integers(0, 3000, 512), np.full(512, 1000)
    tracemalloc.start()
    doc, start, length, t, offset = plan.cut(queue, place, n)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20 and len(doc) > 200_000
    assert (np.bincount(doc, weights=length) == 1000).all() and (offset + length <= 2048).all()


def test_small_sources_take_turns(spark):
    """Beyond `max_queues` sources share a queue by hash and are mixed there too."""
    words = "alpha beta gamma delta".split()
    docs = [(i, " ".join(words * 30), "big" if i % 2 else f"s{i % 20}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    rows = packing.pack(df, queries.word_tokenizer(), window=64, max_queues=4).collect()
    source, total, windows = {i: s for i, _, s in docs}, Counter(), {}
    for r in rows:
        total[r.doc_id] += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, source[r.doc_id]))
    assert len(total) == 200 and all(total[r.doc_id] == r.doc_tokens for r in rows)
    for pieces in windows.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
    full = [w for w in windows.values() if sum(k for _, k, _ in w) == 64]
    assert len(full) >= len(windows) - 1
    small = [len({s for _, _, s in w} - {"big"}) for w in full]
    assert np.mean(small) > 3  # several small sources in a window, not one after another


# ---- seeds of benchmark items ------------------------------------------------------------------


def test_alignments_do_not_follow_the_number_of_items():
    """Edited copies of 30 items among chance look-alikes of 30 and of 300 items: the same finds, no more alignments."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(1500)] + ["the", "of", "to"] * 60
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [text(rng.randrange(12, 40)) for _ in range(300)]
    docs, copies = [text(rng.randrange(20, 600)) for _ in range(600)], set()
    for k in range(150):
        own = items[k % 30].split()
        for at in range(len(own)):
            if rng.random() < 0.15:
                own[at] = rng.choice([rng.choice(words), "", own[at] + " " + rng.choice(words)])
        docs[k] = f"{docs[k]} {' '.join(own)} {text(30)}"
        copies.add((k, k % 30))
    made, found = {}, {}
    aligned = decontaminate.align_many
    for n in (30, 300):
        count = []
        decontaminate.align_many = lambda a, b, count=count: count.append(len(a)) or aligned(a, b)
        try:
            block = decontaminate.Items(list(range(n)), items[:n], 3)
            (held,) = decontaminate.blocks(pa.array(docs), 1 << 30)
            every = {(r, i) for r, i, s, _ in block.matches(held) if s >= 0.45 and i < 30}
            count.clear()
            block.choose(block.held(held), len(docs))
            found[n] = {(r, i) for r, i, s, _ in block.matches(held, 0.45) if s >= 0.45 and i < 30}
            made[n] = sum(count)
        finally:
            decontaminate.align_many = aligned
        assert not block.rare.all() and len(found[n] & copies) >= 0.97 * len(every & copies) and len(every & copies) > 100
    assert found[30] >= found[300] - {x for x in found[300] if x not in copies}
    assert made[300] <= 3 * made[30]


# ---- main text ---------------------------------------------------------------------------------

LONG = "This is a sentence of the article, with commas, and it goes on for a while; then it ends. Another one follows, as they do."


@pytest.mark.parametrize("frame", ["article", "main", "div"])
def test_nothing_else_is_dropped(frame):
    body = f"""<h1>Head</h1><p>{LONG}</p><p class="share-price">Shares cost 5.</p><p class="legal">By law.</p><figure><img src=x><figcaption>Caption</figcaption></figure>
<dl><dt>Term</dt><dd>Meaning</dd></dl><p><a href=1>First reference of the text</a></p><p><a href=2>Second reference of the text</a></p><p>{LONG}</p>"""
    page = f"""<html><body><nav><ul><li><a href=/>One</a></li><li><a href=/b>Two</a></li></ul></nav><{frame}>{body}<div class="comment-list"><p>{LONG}</p></div><div class="ad-box">Buy, buy, buy.</div></{frame}>
<div><ul><li><a href=/c>Three</a></li><li><a href=/d>Four</a></li></ul></div><footer>Made by us, all rights reserved.</footer></body></html>"""
    want = ["Head", LONG, "Shares cost 5.", "By law.", "Caption", "Term", "Meaning", "First reference of the text", "Second reference of the text", LONG]
    assert tagpaths.main_text(page).split("\n") == want


def test_ratios_and_names_both_matter(monkeypatch):
    """Unnamed boxes of links are left to the ratios, comments in prose to their names; neither alone gives the text."""
    links = "".join(f"<li><a href=/{i}>Entry number {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div></div><div>Short line</div><div><ul>{links}</ul></div></body>"
    want = f"Head\n{LONG}\n{LONG}"
    assert tagpaths.main_text(page) == want
    with monkeypatch.context() as m:
        m.setattr(tagpaths, "_out", lambda *a: False)
        assert tagpaths.main_text(page) != want
    with monkeypatch.context() as m:
        m.setattr(tagpaths, "selected", lambda p: [x for x in p.nodes if not x.named])
        assert tagpaths.main_text(page) != want


def test_path_statistics_by_hand():
    page = tagpaths.Page(f"<body><div><p>{LONG}</p><p>A, b.</p></div><ul><li><a href=x>Go, now.</a></li></ul></body>")
    found = tagpaths.path_ratios(page.nodes)
    one, two, link = page.nodes
    marks = sum(c in ".,;" for c in LONG + "A, b.")
    assert one.path == two.path and abs(found[one.path] - (len(LONG) + 5) / 2 * (1 + marks / 2)) < 1e-9 and found[link.path] == 0
    run = tagpaths.smoothed(page.nodes, found)
    weight = [math.exp(-0.5 * k * k) for k in range(-2, 3)]
    assert run[0] == run[1] and abs(run[0] - weight[2] * found[one.path] / sum(weight)) < 1e-9 and abs(run[2] - weight[1] * found[one.path] / sum(weight)) < 1e-9


def test_names_of_columns(spark):
    rows = [(1, "<article><p>a, b.</p></article>", "x", "y")]
    out = tagpaths.extract(spark.createDataFrame(rows, "page_id long, html string, TEXT string, `a.b` string"))
    assert out.columns == ["page_id", "TEXT", "a.b", "text"] and [tuple(r) for r in out.collect()] == [(1, "x", "y", "a, b.")]


# ---- hot URLs and names of columns -------------------------------------------------------------


def test_slices_follow_the_records(spark):
    """One record far off in time leaves the others of a URL spread; the answers stay the same."""
    rows = [(0, "http://x.org/", 0, "response", 200, '"a"', None, None, None)]
    rows += [(i, "http://x.org/", 10**12 + i // 3, "response" if i % 4 == 0 else "revisit", 200, '"a"', None, None, None) for i in range(1, 1200)]
    rows += [(5000 + i, None if i % 2 else "http://x.org/", 7 if i % 2 else None, "revisit", 304, None, None, None, None) for i in range(300)]
    schema = "record_id long, url string, ts long, kind string, http_status int, etag string, last_modified string, digest string, headers map<string,string>"
    df = spark.createDataFrame(rows, schema).select("*", F.lit("clash").alias("URL"), F.lit(1).alias("a.b"))
    got = {r.record_id: r for r in revisits.resolve(df, 64).collect()}
    assert set(got) == {r[0] for r in rows if r[3] == "revisit"}
    full = [(r[2], r[0]) for r in rows if r[3] == "response"]
    for r in rows:
        if r[3] == "revisit":
            old = max((x for x in full if r[1] and r[2] is not None and x[0] < r[2]), default=(None, None))
            assert got[r[0]].response_id == old[1]
    known = spark.createDataFrame(rows, schema).filter("ts is not null and url is not null").select(F.col("ts").cast("double").alias("t"))
    cuts = known.approxQuantile("t", [k / 64 for k in range(1, 64)], 0.25 / 64)
    assert len(set(cuts)) > 50


def test_columns_of_any_name(spark):
    """Names with dots and names that differ in case only, through whole operators and the pipeline's filtering stages."""
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text if i < 2 else f"{text} {i}" if i == 2 else " ".join(f"x{i}y{j}" for j in range(60)), "en", "s", 1, i, i, i, i, i) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, CLASS_ID int, N_REMOVED int, TEXT int, Doc_Id int")
    left = bagminhash.one_of_each(df)
    assert left.columns == df.columns and sorted(r[0] for r in left.collect()) == [0, 3, 4, 5]
    cut = substring.remove_repeats(df, length=35)
    assert cut.columns == [*df.columns, "n_words", "n_removed", "kept"] and cut.count() == 6
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    labels.write.mode("overwrite").parquet(f"{shared_folder(spark)}/names/labels.parquet")
    spark.createDataFrame([(1, "no item of these words")], "item_id long, text string").write.mode("overwrite").parquet(f"{shared_folder(spark)}/names/benchmark.parquet")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{shared_folder(spark)}/names")
        assert docs.columns == df.columns and docs.schema.simpleString() == df.schema.simpleString()
    assert sorted(r[0] for r in docs.collect()) == [0, 3, 4, 5] and all(r[5] == r[0] == r[9] for r in docs.collect())


def test_of_equal_ids_the_least_text_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, f"{text} b"), (1, f"{text} a"), (1, f"{text} a"), (2, text)]
    assert [tuple(r) for r in bagminhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [(1, f"{text} a")]
