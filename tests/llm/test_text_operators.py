"""Text operators against brute force on small, awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillflow.llm import bagminhash, decontaminate, packing, quality, repeats, ring, substring, suffix, textblocks
from rillflow.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, row string, n_words long"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = ["ab", "cde", "f", "ghij", "kl", "Ünö", "x1", "no,", "end."]
    passage = " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(60))
    texts = []
    for i in range(n):
        body = [rng.choice(words) + str(rng.randint(0, 60)) for _ in range(rng.randint(0, 150))]
        if i % 5 == 0:
            k = rng.randint(0, len(body))
            body[k:k] = passage.split()[rng.randint(0, 15) :]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(body))
    texts += [None, "", "   \n ", "one", "one two three", texts[3], texts[3], "same " * 120, "same " * 120 + "end", " ".join(["long"] + words * 400)]
    base = texts[7].split()
    texts += [" ".join(base[:-2] + ["changed", "tail"]), texts[7] + " more"]
    return [(i if i % 17 else None, t, rng.choice(["en", "de", None]), "hot" if i % 3 else rng.choice(["s1", None]), "clash", i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_windows():
    texts = ["a bb  c", None, "", " x\ty\x0bz ", "é ü", " nbsp stays"]
    (block,) = textblocks.blocks(pa.array(texts))
    w = block.words()
    got = [[block.buf[w.lo[k] : w.hi[k]].tobytes().decode() for k in range(w.row_lo[i], w.row_hi[i])] for i in range(block.n)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    values = np.random.default_rng(0).integers(0, 3, 300).astype(np.uint64)
    a = textblocks.Anchors(values, np.array([0, 120]), np.array([120, 300]), 12, 4)
    covered = sorted(s for lo, hi in zip(a.lo, a.hi, strict=True) for s in range(lo, hi + 1))
    assert covered == [*range(0, 109), *range(120, 289)]
    pick = {s: at - s for lo, hi, at in zip(a.lo, a.hi, a.at, strict=True) for s in range(lo, hi + 1)}
    by = {}
    for s, off in pick.items():
        assert by.setdefault(values[s : s + 12].tobytes(), off) == off  # equal windows, equal place


def brute_words(texts, length):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for w in words:
        mask = [False] * len(w)
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                mask[k : k + length] = [True] * length
        out.append((len(w), sum(mask), b" ".join(x for x, m in zip(w, mask, strict=True) if not m).decode()))
    return out


@pytest.mark.parametrize("length", [3, 12, 35])
def test_substring(docs, length):
    rows = substring.remove_repeats(docs, length).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "row", "n_words", "n_removed", "kept"}
    assert [(r.n_words, r.n_removed, r.kept) for r in rows] == brute_words([r.text for r in rows], length)


def test_substring_keeps_source_spacing(docs):
    for r in substring.remove_repeats(docs, 12, joiner="source").collect():
        assert r.n_removed or r.kept == (r.text or "")
        assert len(r.kept.split()) == r.n_words - r.n_removed


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_suffix(docs, hot):
    length = 60
    rows = suffix.remove_repeated_bytes(docs, length, hot=hot, seed=12).collect()
    raws = [(r.text or "").encode() for r in rows]
    count = Counter(x[k : k + length] for x in raws for k in range(len(x) - length + 1))
    for r, x in zip(rows, raws, strict=True):
        mask = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if count[x[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(x), sum(mask), len(re.findall(b"\1+", bytes(mask))))
        assert bytes(r.kept) == bytes(b for b, m in zip(x, mask, strict=True) if not m)


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_first_copies_stay(docs, nothing, hot):
    length = 60
    unique = docs.withColumn("row", F.col("n_words"))  # n_words numbers the rows of the fixture
    rows = suffix.remove_later_copies(unique, length, order="row", hot=hot, seed=12).collect()
    seen = set()
    for r in sorted(rows, key=lambda r: r.row):
        x = (r.text or "").encode()
        mask = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if x[k : k + length] in seen:
                mask[k : k + length] = b"\1" * length
            seen.add(x[k : k + length])
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(x), sum(mask), len(re.findall(b"\1+", bytes(mask))))
        assert bytes(r.kept) == bytes(b for b, m in zip(x, mask, strict=True) if not m)
    assert any(0 < r.n_removed < r.n_bytes for r in rows)
    assert suffix.remove_later_copies(nothing).count() == 0


def test_longest_previous_factor():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, cap = int(rng.integers(0, 50)), int(rng.choice([3, 8, 13, 200]))
        data = rng.integers(97, 99, n).astype(np.uint8)
        for later in (False, True):
            got, at = suffix.longest_previous_factor(data, cap, later)
            for i in range(n):
                best = 0
                for j in range(i + 1, n) if later else range(i):
                    k = 0
                    while max(i, j) + k < n and k < cap and data[i + k] == data[j + k]:
                        k += 1
                    best = max(best, k)
                assert got[i] == best
                assert best == 0 or bytes(data[at[i] : at[i] + best]) == bytes(data[i : i + best])


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def test_signatures_are_unbiased():
    rng = random.Random(1)
    a = [rng.choice("abcdefghij") for _ in range(200)]
    b = a[:150] + [rng.choice("uvwxyz") for _ in range(50)]
    (block,) = textblocks.blocks(pa.array([" ".join(a), " ".join(b), ""]))
    sig = bagminhash.signatures(*bagminhash.bags(*bagminhash.shingles(block, 1)), 3, 4096)
    x, y = Counter(a), Counter(b)
    assert abs((sig[0] == sig[1]).mean() - sum((x & y).values()) / sum((x | y).values())) < 0.03
    assert np.isinf(sig[2]).all()


def test_near_duplicates(docs):
    rows = bagminhash.near_duplicates(docs).collect()
    n, bags = len(rows), [bag(r.text) for r in rows]
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            inter, union = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (rows[i].text or "") == (rows[j].text or "") or (union and inter >= 0.8 * union):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    mine = {}
    for r, g in zip(rows, group, strict=True):
        assert mine.setdefault(g, r.class_key) == r.class_key
    assert len({r.class_key for r in rows}) == len(mine)
    for g in set(group):
        members = [r for r, k in zip(rows, group, strict=True) if k == g]
        assert {r.class_size for r in members} == {len(members)}
        ids = [r.doc_id for r in members if r.doc_id is not None]
        assert {r.class_id for r in members} == {min(ids) if ids else None}
    one = bagminhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len(mine)


def test_near_duplicates_of_a_hot_family(spark, monkeypatch):
    """Classes of one family around the threshold are those of all its links inside shared buckets, also across blocks."""
    rng = random.Random(11)
    base, texts = [f"w{k}" for k in range(200)], set()
    for i in range(300):
        body = list(base)
        for k in rng.sample(range(200), rng.randint(2, 4)):
            body[k] = f"x{i}y{k}"
        texts.add(" ".join(body))
    texts = sorted(texts)
    (block,) = textblocks.blocks(pa.array(texts))
    sig = bagminhash.signatures(*bagminhash.bags(*bagminhash.shingles(block)), len(texts), bagminhash.BANDS * bagminhash.ROWS)
    keys, bags, group = bagminhash.band_keys(sig, bagminhash.BANDS, bagminhash.ROWS), [set(bag(t)) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and (keys[i] == keys[j]).any() and len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    family = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1024, 40):
        monkeypatch.setattr(bagminhash, "BLOCK_TEXTS", most, raising=False)
        got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(family).collect()}
        assert len(set(group)) > 1
        assert len({(got[i], g) for i, g in enumerate(group)}) == len(set(group)) == len(set(got.values()))


@pytest.mark.parametrize(("shards", "slack"), [(24, 0.0), (24, 0.1), (2000, 0.0), (3, 0.5)])
def test_ring(shards, slack):
    nodes, bits = ring.sized(shards)
    cells, owner = ring.ring(shards, nodes, 1 << bits)
    assert len(cells) == shards * nodes and set(owner) == set(range(shards))
    loads = {c: c % 7 for c in range(0, 1 << bits, 5)} | {3: 5000}
    total = sum(loads.values())
    caps = ring.capacities(total, shards, slack)
    parts = ring.stretches(loads, caps)
    held = Counter()
    for cell, lo, hi, shard, place in parts:
        assert place == held[shard]
        held[shard] += hi - lo
    assert sum(held.values()) == total and all(held[s] <= caps[s] for s in held)
    spans = sorted((cell, lo, hi) for cell, lo, hi, _, _ in parts)
    assert all(a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(spans, spans[1:], strict=False))
    with pytest.raises(ValueError, match="smaller"):
        ring.stretches(loads, [1] * shards)


def test_overflow_goes_on_clockwise():
    """Each load is walked along the ring by hand, round by round."""
    nodes, bits = ring.sized(4, 3)
    cells, owner = ring.ring(4, nodes, 1 << bits)
    rng = random.Random(2)
    loads = {rng.randrange(1 << bits): rng.randint(1, 9) for _ in range(300)}
    caps = ring.capacities(sum(loads.values()), 4, 0.0)
    room, where = list(caps), {}
    waiting = sorted((min((i for i, c in enumerate(cells) if c >= cell), default=0), cell, 0, n) for cell, n in loads.items())
    while waiting:
        later = []
        for node, cell, lo, hi in waiting:
            take = min(room[owner[node]], hi - lo)
            room[owner[node]] -= take
            where.update({(cell, k): owner[node] for k in range(lo, lo + take)})
            if lo + take < hi:
                later.append((node, cell, lo + take, hi))
        waiting = []
        for node, cell, lo, hi in later:
            while not room[owner[node]]:
                node = (node + 1) % len(cells)
            waiting.append((node, cell, lo, hi))
        waiting.sort()
    got = {(cell, k): shard for cell, lo, hi, shard, _ in ring.stretches(loads, caps, 3) for k in range(lo, hi)}
    assert got == where


def test_ring_rows(docs, nothing):
    rows = ring.place(docs, 5).collect()
    held = {}
    for r in rows:
        held.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in held.values())
    sizes = [len(held.get(s, [])) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in corpus())
    assert sorted((r.size, r.text_crc32) for r in rows) == want
    assert ring.place(nothing, 5).count() == 0


def test_encoder():
    """Unit by unit gives the ids of whole texts, whatever the characters."""
    from tokenizers import Tokenizer

    rng = random.Random(1)
    signs = list("aAbzZ09 .,'\"#$<|>-_\t\n\r\x0b\x0c\x1c\x1d\x85\xa0éÉßñİıΣσςΑ中文。…—“”’\u0338\u0301\u200b\u3000\u2028😀ﬁ½²٣\ufeff")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["it's don't I'LL we'Ve 's'S rock'scene 'em", "<|endoftext|> a <|ENDOFTEXT|> b<|startoftext|>c", "a\x1cb", "a\x0bb", "", None, "a" * 5000, "word " * 30_000]
    whole, encoder, got = Tokenizer.from_file(word_tokenizer()), packing.Encoder(word_tokenizer()), []
    for b in textblocks.blocks(pa.array(texts), 1 << 14):
        ids, n = encoder.encode_rows(b, 1)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def round_robin(lengths, shares, window):
    """Tokens of each queue in each window when tokens are taken one by one, least virtual time first."""
    order = sorted(((i + 0.5) / shares[q], q) for q, n in enumerate(lengths) for i in range(n))
    return [Counter(q for _, q in order[k : k + window]) for k in range(0, len(order), window)]


def test_mixture_is_that_of_a_plain_round_robin():
    rng = np.random.default_rng(4)
    for queues in (1, 3, 40):
        n, w = rng.integers(1, 900, queues).tolist(), (rng.random(queues) + 0.05).tolist()
        plan = packing.Plan(n, w, 64)
        c = plan.allocated(np.arange(0, -(-plan.total // 64) + 1))
        want = round_robin(n, [x / sum(w) for x in w], 64)
        assert [{q: k for q, k in enumerate(row) if k} for row in np.diff(c, axis=0).tolist()] == [dict(x) for x in want]


def test_sources_that_share_a_queue(docs):
    whole = docs.withColumn("doc_id", F.col("n_words"))
    rows = packing.pack(whole, word_tokenizer(), window=64, max_queues=1, shares={"hot": 0.5, "s1": 0.25, "other": 0.25}).collect()
    assert {r.doc_id for r in rows} == set(range(docs.count()))


@pytest.mark.parametrize("shares", [None, {"hot": 0.5, "s1": 0.5}])
def test_packing(docs, shares):
    from tokenizers import Tokenizer

    whole = docs.withColumn("doc_id", F.col("n_words"))
    tok = Tokenizer.from_file(word_tokenizer())
    rows = packing.pack(whole, word_tokenizer(), window=64, shares=shares).collect()
    want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in whole.collect()}
    got, seq = {}, {}
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.start == len(got.setdefault(r.doc_id, [])) and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id] += ids
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for s, parts in seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == max(seq)


def test_plan_is_monotone():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = rng.integers(0, 3000, int(rng.integers(1, 12))).tolist()
        plan = packing.Plan(n, (rng.random(len(n)) + 0.01).tolist(), 64)
        t = np.arange(0, plan.total // 64 + 2)
        c = plan.allocated(t)
        assert (np.diff(c, axis=0) >= 0).all() and (c[0] == 0).all() and (c[-1] == plan.n).all()
        assert (c.sum(axis=1) == np.minimum(t * 64, plan.total)).all()


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(0, 15)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64)
        assert decontaminate.align(a, b) == smith_waterman(a.tolist(), b.tolist())


def test_decontamination(spark, docs, nothing):
    rng = random.Random(3)
    item = [f"bench{rng.randint(0, 999)}" for _ in range(30)]
    edited = [w if i % 7 else "other" for i, w in enumerate(item)]
    rows = [(1000, "start here " + " ".join(item) + " end", "en", "s", "", 0), (1001, "Start, " + ", ".join(edited).upper() + "!", "en", "s", "", 0), (1002, " ".join(item[:4]) + " then other words", "en", "s", "", 0)]
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, "too short")], "item_id long, text string")
    every = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r for r in decontaminate.contaminated(every, items).collect() if r.doc_id is not None}
    assert {i for i, r in got.items() if r.contaminated} == {1000, 1001}
    assert got[1000].best_score == 1.0 and got[1000].best_item == 7 and 0.6 < got[1001].best_score < 0.9
    left = decontaminate.clean(every, items)
    assert left.columns == docs.columns and left.count() == every.count() - 2
    assert decontaminate.contaminated(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contaminated(nothing, items).count() == 0


def test_decontamination_of_edited_and_partial_copies(spark):
    """The only leak of an item is an edited copy of few surviving seeds, or the half that is leaked more often."""
    rng = random.Random(8)
    items = [[f"i{k}w{n}" for n in range(40)] for k in range(20)]
    texts = []
    for words in items[:10]:
        edited = [w if n % 4 else f"new{rng.randint(0, 10**6)}" for n, w in enumerate(words)]
        texts.append("before it " + " ".join(edited) + " after it")
    for words in items[10:]:
        texts += [f"hot {n} " + " ".join(words[:20]) for n in range(4)] + ["rare " + " ".join(words[20:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, table).collect()}
    for i, t in enumerate(texts):
        scores = [smith_waterman(words, t.split()) / 80 for words in items]
        assert max(scores) >= 0.45 and got[i].contaminated
        assert got[i].best_score == round(max(scores), 6) and got[i].best_item == scores.index(max(scores))


def test_alignments_in_batches():
    rng = np.random.default_rng(2)
    a, b = ([rng.integers(0, 4, rng.integers(1, most)).astype(np.uint64) for _ in range(300)] for most in (15, 300))
    assert decontaminate.align_many(a, b).tolist() == [decontaminate.align(x, y) for x, y in zip(a, b, strict=True)]
    assert len(decontaminate.align_many([], [])) == 0


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, 0, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    rows = quality.risk_controlled(docs.drop("n_words"), labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        mask = [False] * len(w)
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                mask[k : k + 3] = [True] * 3
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), sum(mask))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * sum(mask) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.risk_controlled(nothing.drop("n_words"), labels).count() == 0


def test_binomial_bound():
    from math import comb

    assert abs(quality.binomial_at_most(3, 20, 0.2) - sum(comb(20, i) * 0.2**i * 0.8 ** (20 - i) for i in range(4))) < 1e-12
    assert abs(quality.upper_bound(0, 50, 0.05) - (1 - 0.05 ** (1 / 50))) < 1e-9


def test_verdicts_of_quality_rules(spark):
    """Cutoffs and verdicts of every row against exact sums of binomial terms."""
    from fractions import Fraction
    from math import comb

    rng = random.Random(6)
    rows, labels = [], []
    for i in range(2400):
        lang, bad = ("en", "de", None)[i % 3], rng.random() < 0.3
        words = [rng.choice("abcdefgh") * rng.randint(2, 6) + str(rng.randint(0, 400)) for _ in range(60)]
        if bad:
            words = [w + rng.choice(["", "#", "%%", "$$$"]) for w in words]
        rows.append((i, " ".join(words) if i % 200 else "short", lang))
        if i % 5 == 0:
            labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.risk_controlled(docs, spark.createDataFrame(labels, "doc_id long, quality int"), alpha=0.2, delta=0.1).collect()}
    value = lambda r: {"symbols": r.n_symbols / r.n_words, "dup_lines": 10 * r.n_dup_lines / r.n_words, "repeats": r.n_repeat_words / r.n_words, "long_words": r.word_chars / r.n_words, "short_words": r.n_words / r.word_chars}
    good = {i for i, y in labels if y}
    strata = {lang: [value(got[i]) for i, _, x in rows if x == lang and i in good and not got[i].base_failed] for lang in ("en", "de", None)}
    share, level = Fraction(1, 5) / 5, Fraction(1, 10) / 15
    cutoffs = {}
    for lang, held in strata.items():
        for rule, (_, grid) in quality.RULES.items():
            for cutoff in grid:
                k, n = sum(v[rule] > cutoff for v in held), len(held)
                if sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)) > level:
                    break
                cutoffs[lang, rule] = cutoff
    assert any(rule == "symbols" for _, rule in cutoffs)
    for i, _, lang in rows:
        over = not got[i].base_failed and any(value(got[i])[rule] > c for (x, rule), c in cutoffs.items() if x == lang)
        assert got[i].kept == (not got[i].base_failed and not over)


def test_recall_of_near_duplicates(spark, sf_dir):
    """Every pair of 0.8 or more of the ids divisible by 20, against all rows: at least 0.9 are in one class; none is joined without links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.class_id, r.text) for r in bagminhash.near_duplicates(docs).collect()}
    bags = {i: bag(t) for i, (_, t) in got.items()}
    pairs = [(i, j) for i in got if i % 20 == 0 for j in got if j != i and bags[i] and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())]
    assert pairs and sum(got[i][0] == got[j][0] for i, j in pairs) >= 0.9 * len(pairs)


def test_long_texts(spark):
    """Texts of over a million words beside short ones."""
    rng = random.Random(12)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(1_000_000)]
    texts = [" ".join(long), "before " + " ".join(long[500_000:500_100]) + " after", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(df).select("doc_id", "n_removed").collect()}
    assert got == {0: 100, 1: 100, 2: 0}
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeated_bytes(df).select("doc_id", "n_removed").collect()}
    middle = " " + " ".join(long[500_000:500_100]) + " "
    assert got == {0: len(middle), 1: len(middle), 2: 0}
    assert bagminhash.near_duplicates(df).select("class_id").distinct().count() == 3


def test_a_shared_folder_is_asked_for(monkeypatch):
    from rillflow.llm import scratch

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        scratch.root(Session())  # on a cluster a folder of the driver would lose rows


def test_empty_tables(nothing):
    assert substring.remove_repeats(nothing).count() == 0
    assert suffix.remove_repeated_bytes(nothing).count() == 0
    assert bagminhash.near_duplicates(nothing).count() == 0
    assert packing.pack(nothing, word_tokenizer()).count() == 0


def test_content_hashes(docs):
    assert repeats.with_content(docs).select("c1", "c2").distinct().count() == len({t or "" for _, t, *_ in corpus()})
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
