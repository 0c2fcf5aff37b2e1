import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidewright.llm import graph, jaccard, linededup, mixing, textnum
from tidewright.session import materialise


def brute(docs):
    """{row: (class, links)} of rows (id, text), by comparing all pairs."""
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]))
    root, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i)), links[i]) for i, (d, _) in enumerate(docs)), key=str)


def near_copies(seed, groups, size):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        words = prose(rng, rng.choice([12, 60, 150])).split(" ")
        for k in range(size):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
            out.append((g * size + k, " ".join(w)))
    return out


def test_classes_match_brute_force(spark, odd):
    docs = near_copies(1, 12, 14) + [(r.doc_id, r.text) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    got = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(docs)


def test_components_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 5)
    docs = near_copies(2, 2, 30)
    got = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(docs)


def test_one_document_of_each_class_stays(spark):
    docs = near_copies(3, 5, 8)
    kept = {r.doc_id for r in jaccard.unique(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {c for _, c, _ in brute(docs)}


def test_floor_is_the_longest_prefix_that_meets_the_recall_at_the_threshold():
    p = jaccard.prefix_length()
    missed = lambda p: (1 - 0.8**p) ** jaccard.TREES
    assert missed(p) <= 1 - jaccard.RECALL < missed(p + 1)


def test_neighbours_are_those_of_the_sorted_tries(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SORTED_ROWS", 37)  # many tasks, whose edges must meet
    column = pa.array([t for _, t in near_copies(4, 6, 12)])
    rows = []
    for _, _, buf, at in textnum.slices(column):
        key, first = jaccard.shingle_sets(buf, at)
        strings, bits = jaccard.signatures(key, first)
        rows += [(n, s.tobytes()) for n, s in zip(jaccard.set_names(key, first), strings, strict=True)]
    rows = list(dict(rows).items())
    want = {}
    for tree in range(jaccard.TREES):
        sort = sorted((s[tree * 2 * jaccard.LONGEST : (tree + 1) * 2 * jaccard.LONGEST], n) for n, s in rows)
        for (s, a), (t, b) in zip(sort, sort[1:], strict=False):
            shared = next((k for k in range(jaccard.LONGEST) if s[2 * k : 2 * k + 2] != t[2 * k : 2 * k + 2]), jaccard.LONGEST)
            if shared >= 5:
                want[min(a, b), max(a, b)] = max(shared, want.get((min(a, b), max(a, b)), 0))
    got = jaccard.neighbours(spark.createDataFrame(rows, "node binary, strings binary"), 5).collect()
    assert {(bytes(r.a), bytes(r.b)): r.shared for r in got} == want and want


def test_prefixes_are_shortened_by_the_partners_met(spark):
    near, far = [-1] * (jaccard.SKETCH - 1) + [-1 ^ (1 << 20) - 1], [0] * jaccard.SKETCH  # agreement 0.92, similarity 0.84
    nodes = spark.createDataFrame([(b"a", [-1] * jaccard.SKETCH), (b"b", [-1] * jaccard.SKETCH), (b"c", near), (b"d", far)], "node binary, sketch array<long>")
    pairs = spark.createDataFrame([(b"a", b"b", 10), (b"a", b"c", 9), (b"b", b"d", 7), (b"c", b"d", 7)], "a binary, b binary, shared int")
    got = {(bytes(r.a), bytes(r.b)) for r in jaccard.shortened(pairs, nodes, 7).collect()}
    # b has met only its equal: it stays at the longest prefix; c comes down to what its similarity asks for; pairs with d are no partners
    assert got == {(b"a", b"b"), (b"a", b"c"), (b"b", b"d"), (b"c", b"d")}
    alone = spark.createDataFrame([(b"a", b"b", 8)], "a binary, b binary, shared int")
    assert jaccard.shortened(alone, nodes, 7).count() == 0  # equals are sure to share ten levels elsewhere


def test_a_node_with_very_many_neighbours_is_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pairs = materialise(spark.range(200_000).select((F.col("id") * (F.col("id") % 2)).alias("u"), (F.col("id") + 1).alias("v")), "star")
        joined = graph._smaller(pairs)
        joined.write.format("noop").mode("overwrite").save()
        assert joined.where("u = 0 AND m = 0").count() == 100_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_null_ids_and_repeated_ids_stay_linear(spark):
    docs = near_copies(9, 1, 1500)
    docs = [(None if k % 3 else 5, t) for k, t in docs]
    got = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(docs)


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(11)
    shared, tails = prose(rng, 80), [prose(rng, 40) for _ in range(3)]
    docs = [(1, shared + "\n" + tails[0]), (1, shared + "\n" + tails[1]), (2, shared + "\n" + tails[2])]
    got = sorted(linededup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect(), key=lambda r: (r.doc_id, r.n_removed))
    assert [r.n_removed > 0 for r in got] == [False, True, True]
    assert got[1].n_removed == got[2].n_removed


def lines_of(text):
    return re.findall(linededup.LINE.replace(r"\z", r"\Z"), text or "")


def test_later_windows_go_and_first_ones_stay(spark):
    rng = random.Random(5)
    passage = " ".join(f"{prose(rng, 17)[:-1]}{k}." for k in range(4)).replace("\n", " ")
    docs = [(k, prose(rng, 60).replace("\n", " ") + f" end{k}.\n" + (passage + "\n" if k % 2 else "") + prose(rng, 40) + f" stop{k}.") for k in range(8)]
    got = {r.doc_id: r for r in linededup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text == docs[1][1]
    for k in (3, 5, 7):
        assert passage not in got[k].text and got[k].text.endswith(f"stop{k}.") and f"end{k}." in got[k].text
        assert got[k].n_removed == len(lines_of(passage))
    for k in (0, 2, 4, 6):
        assert got[k].text == docs[k][1] and got[k].n_removed == 0


def test_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = linededup.line_dedup(docs).collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].text is None and by_id[2].text == "" and by_id[3].text == " \n\t "
    assert by_id[None].n_removed == 0  # a null id comes first
    assert by_id[6].n_removed == by_id[6].n_lines and by_id[6].text == ""
    assert [r.n_removed for r in got if r.doc_id == 7] == [by_id[6].n_lines] * 2
    shared = Counter(w for r in got if r.doc_id in (9, 10) for w in set(lines_of(r.text)))
    assert not [w for w, n in shared.items() if n > 1 and len(w) > 60]


def test_mix_meets_targets(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = mixing.taken(docs).collect()
    total = sum(r["size"] for r in got)
    assert all(r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        x = by.setdefault((r.source_size, r.target), [0, 0])
        x[0] += r.taken
        x[1] += r["size"]
    targets = {t for _, t in by}
    assert abs(sum(targets) - 1.5 * total) < 1e-6 * total or len(targets) < len({r.source for r in docs.select("source").collect()})
    for (size, target), (took, own) in by.items():
        assert target <= 2 * size + 1e-6
        assert abs(took - target) <= 64 + 0.02 * target


def test_shards_hold_the_words_that_are_taken(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = mixing.shards(docs).collect()
    assert sum(len(re.findall(mixing.WORDS, r.text)) for r in got) == sum(r.taken for r in mixing.taken(docs).collect())
    places = [(r.shard, r.position) for r in got]
    assert len(set(places)) == len(places) and max(len(re.findall(mixing.WORDS, r.text)) for r in got) == mixing.BLOCK
    long = next(r.text for r in docs.collect() if r.doc_id == 11)
    words = re.findall(mixing.WORDS, long)
    assert any(r.text == " ".join(words[k : k + mixing.BLOCK]) for r in got if r.key == "vb" for k in range(0, 40_000, 1) if r.text.startswith(words[k]))


def test_shards_draw_their_sources(spark):
    weights = {"a": 40_000, "b": 9_000, "c": 500, "d": 3, "e": 0}
    start, rows = 0, []
    for key, m in weights.items():
        rows.append((key, m, start))
        start += m
    counted = spark.createDataFrame(rows, "key string, m long, start long")
    got = Counter((r.id // 1000, r.key) for r in mixing.drawn(counted, start, 1000).collect())
    assert sum(got.values()) == start and not [k for _, k in got if k == "e"]
    for s in range(start // 1000):  # each shard is a draw of its own
        assert sum(n for (t, _), n in got.items() if t == s) == 1000
        assert abs(got[s, "b"] - 1000 * 9_000 / start) < 5 * (1000 * 0.18 * 0.82) ** 0.5
    assert len({got[s, "b"] for s in range(start // 1000)}) > 10


def test_targets_reshare_what_is_above_the_cap(spark):
    sizes = {"a": 10, "b": 100, "c": 1000, None: 50, "d": 400}
    df = spark.createDataFrame([(f"k{s}", s, n) for s, n in sizes.items()], "key string, source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    names = sorted(s for s in sizes if s) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    share, open_ = 1.5 * sum(sizes.values()), set(names)
    want = {}
    while True:
        level = (share - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in names)


def test_permutations_are_permutations():
    import numpy as np

    for n in (1, 2, 3, 7, 64, 1000):
        x = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(x.tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)).tolist() != list(range(1000))
