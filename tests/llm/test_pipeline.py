"""The corpus pipeline against a brute-force version of every stage."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_text_operators import bag, brute_words, round_robin, smith_waterman

import corpus_pipeline
from rillflow.llm import scratch, toxicity
from rillflow.llm.queries import word_tokenizer

COLUMNS = "doc_id text lang source n_chars".split()


def corpus(seed=5):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["er", "an", "th", "in", "ou", "st", "re", "ly", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    bad = ["worthless", "idiot", "scum", "pathetic"]
    text = lambda n: [rng.choice(plain) for _ in range(n)]
    rows, labels, items = [], [], [text(40) for _ in range(6)]

    def add(words, source="src1", toxic=None):
        rows.append((len(rows), words if words is None else " ".join(words), rng.choice(["en", None]), source, None))
        if toxic is not None:
            labels.append((rows[-1][0], 1, toxic))

    for i in range(240):  # labelled rows, of which a fifth are toxic
        words = text(rng.randint(30, 90))
        if i % 5 == 0:
            for _ in range(8):
                words[rng.randrange(len(words))] = rng.choice(bad)
        add(words, f"src{i % 4}", int(i % 5 == 0))
    for _ in range(4):  # chains of near copies, exact copies of a member, and a family around the threshold
        words = text(120)
        for _ in range(5):
            words = list(words)
            words[rng.randrange(120)] = rng.choice(plain) + "x"
            add(words, "hot")
        add(words, "hot")
    base = text(100)
    for _ in range(25):
        words = list(base)
        for k in rng.sample(range(100), rng.randint(1, 4)):
            words[k] = rng.choice(plain) + "y"
        add(words, "hot")
    passage = text(60)
    for _ in range(12):  # a passage that documents share
        words = text(rng.randint(40, 80))
        words[20:20] = passage
        add(words, rng.choice(["src2", None]))
    for item in items[:4]:  # leaks, edited and not
        add(text(50) + item + text(20))
        add(text(30) + [w if n % 6 else "edit" + w for n, w in enumerate(item)] + text(30))
    for words in (None, [], ["one"], ["same"] * 200, text(3), None):
        add(words, None)
    rows.append((rows[7][0], *rows[7][1:]))  # a repeated row
    return rows, labels, [(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, "")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rows, labels, items = corpus()
    path = tmp_path_factory.mktemp("corpus")
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int32()}
    pq.write_table(pa.table([pa.array([None if c == "n_chars" and r[1] is None else len(r[1]) if c == "n_chars" else r[i] for r in rows], kinds[c]) for i, c in enumerate(COLUMNS)], names=COLUMNS), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": [x[2] for x in labels]}), path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [x[0] for x in items], "text": pa.array([x[1] for x in items], pa.string())}), path / "benchmark.parquet")
    return str(path)


def plain(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr)


def test_stages(spark, folder):
    rows, labels, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = scratch.table(stages[name](spark, docs, folder), name)
        return out, out.collect()

    start = docs.collect()
    docs, kept = step("toxicity", docs)
    scorer = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).scorer()
    assert plain(kept) == plain(r for r in start if scorer.scores(pa.array([r.text], pa.string()))[0] < corpus_pipeline.TOXIC_FROM)
    toxic = {i for i, _, y in labels if y}
    assert sum(r.doc_id in toxic for r in kept) < 0.2 * len(toxic) and sum(r.doc_id not in toxic for r in kept) > 0.95 * (len(start) - len(toxic))

    before, group = kept, list(range(len(kept)))
    docs, kept = step("near_dedup", docs)
    bags = [bag(r.text) for r in before]
    for i in range(len(before)):
        for j in range(i):
            if group[i] == group[j]:
                continue
            inter, union = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (before[i].text or "") == (before[j].text or "") or (union and inter >= 0.8 * union):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for r, g in zip(before, group, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in kept) == sorted(least.values()) and len(kept) < len(before)
    assert set(plain(kept)) <= set(plain(before))

    before = kept
    docs, kept = step("substring_dedup", docs)
    want, got = {}, {r.doc_id: r for r in kept}
    for r, (n, gone, rest) in zip(before, brute_words([r.text for r in before], corpus_pipeline.REPEAT_WORDS), strict=True):
        if not gone or gone < n:
            want[r.doc_id] = (r, gone, rest)
    assert set(got) == set(want) and any(gone for _, gone, _ in want.values())
    for i, (r, gone, rest) in want.items():
        assert got[i].text == r.text if not gone else got[i].text.split() == rest.split() and got[i].n_chars == len(got[i].text)
        assert (got[i].lang, got[i].source) == (r.lang, r.source)

    before = kept
    docs, kept = step("decontamination", docs)
    score = lambda text: max((smith_waterman(x.split(), (text or "").split()) / (2 * len(x.split())) for _, x in items if x), default=0)
    assert plain(kept) == plain(r for r in before if score(r.text) < 0.45) and len(kept) == len(before) - 8

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    _, pieces = step("packing", docs)
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in kept}
    source, got, held = {r.doc_id: r.source for r in kept}, {i: [] for i in ids}, {}
    for p in sorted(pieces, key=lambda p: p.start):
        assert p.start == len(got[p.doc_id]) and p.length * 4 == len(p.ids)
        got[p.doc_id] += memoryview(bytes(p.ids)).cast("I").tolist()
        held.setdefault(p.sequence_id, Counter())[source[p.doc_id]] += p.length
    assert got == ids
    sizes = Counter(source[i] for i, x in ids.items() for _ in x)
    rows_of = Counter(source.values())
    order = sorted(sizes, key=lambda s: (-rows_of[s], "null" if s is None else "=" + s))  # queues by number of documents
    total = sum(sizes.values())
    turn = round_robin([sizes[s] for s in order], [sizes[s] / total for s in order], corpus_pipeline.WINDOW)
    assert held == {k: Counter({order[q]: n for q, n in x.items()}) for k, x in enumerate(turn)}


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, folder), name)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(corpus_pipeline.run(spark, folder).select("doc_id", "start", "length")) == rows(docs.select("doc_id", "start", "length"))


def test_empty_tables(spark, tmp_path):
    rows, labels, items = corpus()
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars int"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
