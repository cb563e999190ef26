"""Line dedup, near-dedup, top-k, suffix tree and the pipeline, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, components, linededup, neardup, suffixtree, topk
from lodestone.llm.common import materialize

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(t):
    return (t or "").encode().translate(LOWER).split()


# -- line dedup ---------------------------------------------------------------


def _line_dedup(rows, least=5):
    sites, first, need = {}, {}, {}
    strip = " \t\v\f\r"
    for i, t, _, source, _ in rows:
        for raw in (t or "").split("\n"):
            line = raw.strip(strip)
            if line:
                need[line] = least if len(re.findall(r"[^ \t\v\f\r]+", line)) >= 3 else 50
                sites.setdefault(line, set()).add(source or "")
                first[line] = min(first.get(line, math.inf), math.inf if i is None else i)
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        mine = math.inf if i is None else i
        keep = [x for x in lines if len(sites.get(x.strip(strip), ())) < need.get(x.strip(strip), 1) or first[x.strip(strip)] == mine]
        text = "\n".join(keep)
        n = 0 if t is None else len(lines)
        out[(i, n, len(lines) - len(keep), len(text), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_line_dedup(docs, no_docs, rows):
    got = Counter(map(tuple, linededup.digest(docs).collect()))
    assert got == _line_dedup(rows)
    assert any(k[2] for k in got)
    assert linededup.digest(no_docs).count() == 0
    clean = linededup.clean(docs)
    assert clean.columns == docs.columns and clean.schema == docs.schema
    assert all(r.n_chars is None or r.n_chars in (1, len(r.text)) for r in clean.collect())


def test_line_dedup_counts_near_lines_exactly(spark):
    rows = [(i, f"line on {k} sites here", f"site{i}") for k in range(1, 12) for i in range(k)]
    rows = [(n, t, s) for n, (_, t, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = linededup.boilerplate(df, min_sites=6)
    assert bad.count() == 6  # 6 to 11 sites


def test_line_dedup_short_lines_need_more_sites(spark):
    rows = [(i, "Read more\nAll about it here", f"site{i % 40}") for i in range(60)] + [(100 + i, "Sign in\nno", f"site{i}") for i in range(55)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(map(tuple, linededup.digest(df).collect()))
    assert got == _line_dedup([(*r[:2], "en", r[2], 0) for r in rows])
    assert {k[2] for k in got if k[0] >= 101} == {2} and {k[2] for k in got if 0 < k[0] < 60} == {1}


# -- near duplicates ----------------------------------------------------------


def _components(ids, edges):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _set(t):
    w = _words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def _linked(rows):
    """The rows' sets, and the component of each row by its number."""
    sets = [_set(r[1]) for r in rows]
    ids = range(len(rows))
    edges = [(i, j) for i in ids for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return sets, _components(ids, edges)


def _groups(rows):
    sets, root = _linked(rows)
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], math.inf), math.inf if r[0] is None else r[0])
    out = Counter()
    for i, r in enumerate(rows):
        d, c = r[0], least[root[i]]
        c = d if c == math.inf else c
        out[(d, len(sets[i]), c, d == c)] += 1
    return out


def _one_each(rows):
    """A row of each component, that of its least doc_id; all rows without words."""
    sets, root = _linked(rows)
    out, seen = Counter(), set()
    for i in sorted(range(len(rows)), key=lambda i: math.inf if rows[i][0] is None else rows[i][0]):
        if not sets[i] or root[i] not in seen:
            seen.add(root[i])
            out[tuple(rows[i])] += 1
    return out


def test_near_dedup(docs, no_docs, rows):
    want = _groups(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.groups(docs).collect())
    assert got == want
    assert neardup.groups(no_docs).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == _one_each(docs.collect())


def test_near_dedup_deep_and_dense(spark, monkeypatch):
    """Small limits: nodes branch further, dense nodes are resolved, the last level is cut into blocks."""
    monkeypatch.setattr(neardup, "NODE", 16)
    monkeypatch.setattr(neardup, "DEPTH", 4)
    monkeypatch.setattr(neardup, "NODE_SHINGLES", 3000)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(0, 120))] = f"e{int(rng.integers(0, 10**6))}"
        rows.append((i, " ".join(w)))
    for i in range(150, 200):
        rows.append((i, " ".join(f"x{int(x)}" for x in rng.integers(0, 10**6, 60))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.groups(df).collect()}
    assert got == set(_groups(rows))


def test_near_dedup_one_of_repeated_rows(spark):
    """Repeated rows, a null id and one id with two texts: one row of each component stays."""
    t, other = "a b c d e f g h", "p q r s t u v"
    rows = [(7, other), (7, t), (30, t), (30, t), (None, t), (None, "z z z"), (None, "z z z"), (8, ""), (8, ""), (9, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.groups(df).collect()) == _groups(rows)
    assert Counter(map(tuple, neardup.keep_one(df).collect())) == _one_each(rows) == Counter([(7, other), (7, t), (None, "z z z"), (8, ""), (8, "")])


def _variants(rng, words, n, most_edits, mark):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(int(rng.integers(1, most_edits + 1))):
            w[int(rng.integers(0, len(w)))] = f"{mark}{int(rng.integers(0, 10**9))}"
        out.append(" ".join(w))
    return out


def test_near_dedup_large_group_stays_linear(spark, monkeypatch):
    """10,000 near copies of one text: no more rows to compare than classes in a tree, one component."""
    rng = np.random.default_rng(5)
    texts = _variants(rng, [f"w{i}" for i in range(300)], 10_000, 2, "e")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    counted = []
    whole = neardup.leaves

    def leaves(docs, classes):
        leaf, links = whole(docs, classes)
        counted.append((leaf.count(), classes.count()))
        return leaf, links

    monkeypatch.setattr(neardup, "leaves", leaves)
    assert {(r.component_id, r.kept) for r in neardup.groups(df).where("doc_id > 0").collect()} == {(0, False)}
    (rows, classes) = counted[0]
    assert classes > 9_900 and rows <= 1.5 * neardup.TREES * classes


def test_near_dedup_beside_a_large_group(spark, monkeypatch):
    """Large nodes that hold a dense group, a second one linked with it by a few, and texts near to both but not linked."""
    monkeypatch.setattr(neardup, "NODE", 32)
    monkeypatch.setattr(neardup, "NODE_SHINGLES", 5000)
    rng = np.random.default_rng(6)
    one = [f"w{i}" for i in range(120)]
    two = one[:88] + [f"v{i}" for i in range(32)]
    between = [one[:104] + two[104:], one[:100] + two[100:]]
    texts = _variants(rng, one, 150, 2, "e") + _variants(rng, two, 100, 2, "f") + [" ".join(b) for b in between]
    texts += [" ".join(one[:60] + [f"x{k}y{i}" for i in range(60)]) for k in range(60)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.groups(df).collect()) == _groups(rows)


def test_near_dedup_shuffles_only_texts_that_may_be_wanted(spark):
    docs = spark.createDataFrame([(i if i else None, f"text number {i}") for i in range(3000)], "doc_id long, text string").repartition(3)
    keyed = docs.withColumn("id", F.expr("coalesce(doc_id, 0) + 7")).withColumn("text_key", F.xxhash64("text"))
    wanted = materialize(keyed.where("id in (7, 8, 507)").select("id", "doc_id", "text_key"))
    through = {r.text for r in neardup._gated(docs, wanted).collect()}
    assert {"text number 0", "text number 1", "text number 500"} <= through and len(through) < 6
    got = {r.id: r.set for r in neardup._sets(docs, wanted).collect()}
    assert got == {i + 7: neardup.shingles(f"text number {i}").tobytes() for i in (0, 1, 500)}
    assert neardup._gated(docs, wanted.where("id < 0")).count() == 0


def test_materialize_leaves_no_shuffle_files(spark):
    spark.sparkContext._jvm.System.gc()
    blocks = lambda: sum(p.stat().st_size for p in Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data"))
    before = blocks()
    table = materialize(spark.range(200_000).select(F.col("id") % 70_001, F.xxhash64("id").alias("x")).repartition(5, "x"))
    assert table.count() == 200_000
    assert blocks() - before < 100_000


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100, 300)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1500, (300, 2)) if a != b] + [(5000, i) for i in range(5001, 5400)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == _components(got, edges)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- exact search -------------------------------------------------------------


def _top(rows, every, k):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault((i, tuple(math.floor(64 * float(np.float32(c))) for c in x)), None)
    out = set()
    for i, q in v:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, d, strict=True)), j) for j, d in v if j != i and len(d) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(s)}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "QUERY_LEAF", 3)
    monkeypatch.setattr(topk, "ROWS_PER_PIVOT", 100)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.1 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, centres[0].tolist()) for i in range(150)]  # a very common vector
    rows += [(1000, None), (1020, [1.0, None] * 4), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (1080, [0.5, 0.25]), (1081, [1.0, -1.0]), (1100, [0.0] * 8), (None, [1.0] * 8), rows[3]]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], "vec_id long, embedding array<float>, label int, v string").repartition(3)
    got = topk.top_k(df, k=20).collect()
    assert {tuple(r) for r in got} == _top(rows, 20, 20) and len(got) == len(set(got))
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [1.0, 0.0]), (40, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df).collect()} == {(20, 1, 21, 4096), (20, 2, 40, 2048), (40, 1, 20, 2048), (40, 2, 21, 2048)}


@pytest.mark.parametrize("spread", [0.02, 0.3, 5.0])
def test_cover_tree_covers_and_separates(spread):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, spread, (60, 6)) for c in rng.normal(size=(20, 6))])
    t = topk.CoverTree(x, 10)
    assert sorted(t.order) == list(range(len(x)))
    inner = 0
    for k, (lo, hi) in enumerate(t.range):
        kids = t.children[k]
        away = np.sqrt(((x[t.order[lo:hi]] - t.centre[k]) ** 2).sum(1))
        assert away.max() <= t.radius[k]
        assert t.level[k] is None or away.max() <= 2.0 ** t.level[k]
        if kids:
            inner += 1
            assert [t.range[c][0] for c in kids] == [lo, *[t.range[c][1] for c in kids[:-1]]] and t.range[kids[-1]][1] == hi
            assert all(t.level[c] is None or t.level[c] < t.level[k] for c in kids)
            centres = t.centre[kids]
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(2))
            assert apart[~np.eye(len(kids), dtype=bool)].min() > 2.0 ** (t.level[k] - 1)
    assert inner or spread > 1


def test_top_k_opens_few_blocks_of_clustered_data(spark, monkeypatch):
    """Block pairs stay in proportion to the blocks where vectors lie in clusters, and results are exact."""
    for name, value in (("BLOCK", 64), ("QUERY_BLOCK", 16), ("ROWS_PER_PIVOT", 64), ("LEAF", 16), ("QUERY_LEAF", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(60, 16))
    middle *= 4 / np.sqrt((middle**2).sum(1))[:, None]
    x = np.concatenate([rng.normal(m, 0.05, (100, 16)) for m in middle])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    sizes, write = {}, topk.materialize

    def counting(df, label="t"):
        out = write(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(topk, "materialize", counting)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = [tuple(r) for r in topk.top_k(df).orderBy("query_id", "rank").collect()]
    v = np.floor(x * 64)
    want = []
    for i in range(0, len(v), 20):
        scores = v @ v[i]
        order = [j for j in np.lexsort((np.arange(len(v)), -scores)) if j != i][:20]
        want += [(i, n + 1, int(j), int(scores[j])) for n, j in enumerate(order)]
    assert got == want
    assert sizes["blocks"] > 90 and sizes["pairs"] < 64 * sizes["blocks"]


def test_suffix_tree_base(docs, no_docs, rows):
    got = suffixtree.score(docs).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows}
    c, n = Counter(), 0
    for i, t, *_ in rows:
        if not held[i]:
            c.update([*_words(t), "END"])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        w = [*_words(t), "END"]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[(i, held[i], len(w), sum(c[x] > 0 for x in w), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert suffixtree.score(no_docs).count() == 0


def test_suffix_tree_in_parts_leaves_only_what_its_result_reads(docs, monkeypatch):
    got = []
    for parts in (1, 3):
        monkeypatch.setattr(suffixtree, "PARTS", parts)
        before = set(common._written)
        got.append(Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffixtree.score(docs).collect()))
        left = Counter(p.rsplit("/", 1)[1].split("-")[0] for p in common._written - before)
        assert left == {"scored": parts, "states": 1}
    assert got[0] == got[1] and got[0].total() == docs.count()


def test_suffix_tree_only_held_out_rows(spark):
    i = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = suffixtree.score(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and math.isfinite(r.score)


@pytest.fixture(scope="module")
def markov(spark):
    """Texts in which the last one or two words tell much about the next."""
    rng = np.random.default_rng(11)
    words = [f"v{i}" for i in range(30)]
    rows = []
    for i in range(400):
        w = ["v0", "v1"]
        for _ in range(60):
            if rng.random() < 0.7:
                w.append(words[(int(w[-1][1:]) * 7 + int(w[-2][1:]) * 3 + 1) % 30])
            else:
                w.append(words[int(rng.integers(0, 30))])
        rows.append((i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_suffix_tree_gains_on_held_out_texts(markov):
    r = suffixtree.score(markov).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > 0.75 * r[0]


def test_suffix_tree_distributions_sum_to_one(markov, spark):
    train = suffixtree._rows(markov).where("not held_out")
    counts = materialize(suffixtree.count_words(train), "words")
    n = counts.agg(F.sum("n")).first()[0]
    ends = train.count()
    v = counts.count() + 1
    total = n + ends
    tree = suffixtree.fit(train, counts, total, v, ends)
    assert len(tree.back) > 20 and len(tree.pair_keys)
    uni = np.zeros(tree.m)
    uni[suffixtree.END] = ends
    for r in counts.collect():
        uni[tree.ids[bytes(r.word)]] = r.n
    root = (uni + 0.5) / (total + 0.5 * (v + 1))
    root[[suffixtree.BEGIN, suffixtree.OTHER]] = 0  # no rare words here; 0.5 of z is left for unknown ones
    unknown = 1 - root.sum()
    words = [i for i in range(tree.m) if i != suffixtree.BEGIN]
    for context in ([3], [5, 9], [suffixtree.BEGIN], [suffixtree.BEGIN, 4], [7, 8]):
        p = 0
        for w in words:
            s = np.array([*context, w], np.int64)
            p += (root[w] if w != suffixtree.OTHER else unknown) * 10 ** tree.corrections(s)[-1]
        assert abs(p - 1) < 1e-9


def test_suffix_tree_keeps_grams_of_rare_words(spark, monkeypatch):
    """What is evidence (three times) counts in a corpus of any size, and as much joined as sent to the workers."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 5000, 400))) for i in range(300)]
    rows = [(i, t + " rarely seen words together" if i % 25 == 0 else t) for i, t in rows]
    docs = spark.createDataFrame([*rows, (1001, "rarely seen words together"), (1002, "together words seen rarely")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixtree.score(docs).collect()}
    gain = {i: got[i].score - got[i].base_score for i in (1001, 1002)}
    assert gain[1001] > 8 and gain[1001] > gain[1002] + 8
    # A corpus in which no word and no gram is frequent enough to travel.
    monkeypatch.setattr(suffixtree, "HOT_SYMBOL", 1.0)
    monkeypatch.setattr(suffixtree, "HOT_GRAM", 1.0)
    again = {r.doc_id: r for r in suffixtree.score(docs).collect()}
    assert all(abs(again[i].score - r.score) < 1e-6 for i, r in got.items())


def test_suffix_tree_hands_on_a_value_for_each_bucket(spark):
    """No row for each gram, key or weight: they travel in buckets, and come back as they were."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 500)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    words = spark.createDataFrame([(f"w{k}",) for k in range(300)], "word string").select(F.xxhash64("word").alias("key"))
    gate = common.Gate(words.union(spark.createDataFrame([(suffixtree.BEGIN,), (suffixtree.END,)], "key long")))
    dealt = suffixtree._deal_grams(docs, 2, gate, 16).collect()
    assert len(dealt) <= 2 * 16 and {r.bucket for r in dealt} == set(range(16))
    (a, b, n), rows = suffixtree._columns([bytes(r.data) for r in dealt], [np.uint64, np.uint64, np.uint32])
    assert (suffixtree._key(a, b) % np.uint64(16) == np.repeat([r.bucket for r in dealt], rows)).all()
    count = Counter()
    for t in texts:
        h = suffixtree._hashes([t]).tolist()
        count.update(zip(h, h[1:], strict=False))
    got = Counter()
    for x, y, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        got[x, y] += k
    assert got == count
    often = {(*(x % 2**64 for x in (r.g0, r.g1)), r.n) for r in suffixtree._count_grams(docs, 2, gate, 16).collect()}
    assert often == {(*g, k) for g, k in count.items() if k >= suffixtree.LEAST}
    weights = spark.createDataFrame([(k - 500, k / 7, -k / 3) for k in range(1000)], "key long, gain double, weight double").repartition(1)
    dealt = suffixtree._deal_weights(weights, 8).collect()
    (key, gain, weight), _ = suffixtree._columns([bytes(r.data) for r in dealt], [np.int64, np.float64, np.float64])
    assert len(dealt) == 8 and set(zip(key.tolist(), gain.tolist(), weight.tolist(), strict=True)) == {tuple(r) for r in weights.collect()}


# -- pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark, docs, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "personal_data", "packing"]
    seen = d.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = materialize(stage(spark, d, str(tmp_path)), "stage")
        if k < 4:
            assert d.columns == docs.columns and 0 < d.count() <= seen
            seen = d.count()
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == Counter(map(tuple, d.drop("sequence_id", "offset").collect()))


def test_pipeline_of_no_rows(spark, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_recall_does_not_fall_with_depth():
    """Pairs at the threshold, if every node on their way were too large to compare."""
    from recall_by_depth import recall

    got = recall(0.75, pairs=300)
    assert got[0] == 1 and min(got.values()) >= 0.95
