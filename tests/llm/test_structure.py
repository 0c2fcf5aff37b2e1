"""Conversation repair, periodic runs and nearest neighbours against plain second implementations."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from tidewright.llm import neighbours, periodic, turnrepair
from tidewright.llm import queries as q

WORD = re.compile("[^\x20\x09-\x0d]+")
TURNS = "conv_id long, turn long, role string, text string"


# --- conversation repair


def plain_cheapest(initials, found):
    """All edits of up to two inserts between rows, cheapest first, then ASCII: a full dynamic programme over strings."""
    follows = {"": "us", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        for _ in range(2):
            for last, (cost, audit) in list(states.items()):
                to, new = follows[last][0], (cost + 2, audit + "I")
                if to not in states or new < states[to]:
                    states[to] = new
        return states

    states = inserted({"": (0, "")})
    for initial, fault in zip(initials, found, strict=True):
        after = {}
        for last, (cost, audit) in states.items():
            options = [(last, (cost + 3, audit + "D"))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options.append((follows[last][0], (cost + 2 + extra, audit + "R")))
                if initial in follows[last]:
                    options.append((initial, (cost + extra, audit + "K")))
            for to, new in options:
                if to not in after or new < after[to]:
                    after[to] = new
        states = inserted(after)
    return min(v for k, v in states.items() if k in ("", "a"))


def legal_costs(initials, found, most):
    """Cheapest by listing every audit of up to ``most`` letters and reading what it leaves."""
    best = None
    for n in range(most + 1):
        for audit in map("".join, itertools.product("DIKR", repeat=n)):
            if sum(c != "I" for c in audit) != len(initials):
                continue
            cost, last, i, right = 0, "", 0, True
            out = ""
            for c in audit:
                to = "a" if last == "u" else "u"
                if c == "I":
                    cost, last = cost + 2, to
                    out += to
                    continue
                bad, role = found[i] in ("blank", "duplicate"), initials[i]
                i += 1
                if c == "D":
                    cost += 3
                    continue
                right &= not bad
                cost += found[i - 1] == "truncated"
                if c == "R":
                    cost, last = cost + 2, to
                else:
                    last = role
                out += last
            if right and re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_cheapest_edits_are_those_of_a_full_listing():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(4)
        initials = [rng.choice("suax") for _ in range(n)]
        found = [rng.choice(["", "", "blank", "duplicate", "truncated"]) for _ in range(n)]
        assert turnrepair.cheapest(initials, found) == legal_costs(initials, found, n + 3)


def test_cheapest_edits_of_longer_conversations():
    rng = random.Random(2)
    for n in [*range(4, 40), 300]:
        initials = [rng.choice("suuaa ") for _ in range(n)]
        found = [rng.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in range(n)]
        assert turnrepair.cheapest(initials, found) == plain_cheapest(initials, found)


def plain_repair(rows):
    """op11's row of each conv_id from rows (conv_id, turn, role, text)."""
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or "", turn))
    out = {}
    for conv, held in chats.items():
        after, turns = [], set()
        for _, _, has_role, role, has_text, text, turn in sorted(held):
            role, text = (role if has_role else " "), (text if has_text else " ")
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            after += [(role, text)] * (2 if kind == 3 else 1)
            if turn is not None:
                turns.add(turn)
        found, seen = [], set()
        for r in after:
            s = r[1].strip(" \t\n\v\f\r")
            found.append("blank" if not s else "duplicate" if r in seen else "truncated" if s[-1] not in ".!?" else "")
            seen.add(r)
        initials = [r[0][:1] or " " for r in after]
        cost, audit = plain_cheapest(initials, found)
        left, last, i = [], "", 0
        for c in audit:
            to = "assistant" if last == "u" else "user"
            if c == "I":
                left.append(f"{to}:")
                last = to[0]
                continue
            role, text = after[i]
            i += 1
            if c != "D":
                role = role if c == "K" else to
                left.append(f"{role}:{text}")
                last = role[:1]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_repairs_of_whole_tables(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in q.op11_turn_repair(spark, folder).collect()}
    assert got == plain_repair(rows)


def test_repairs_of_odd_conversations(spark, tmp_path):
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", ""), (1, 1, "", "x."), (1, 1, "", "x."), (1, 9, "tool", "y"), (2, 0, "user", "é." * 50_000), (2, -3, "assistant", "b!"), (3, 5, "ax", " ")]
    rows += [(k, rng.randrange(9), rng.choice(["user", "assistant", "system", None]), rng.choice(["a.", "b", "", "c?\n", " \t"])) for k in range(10, 60) for _ in range(rng.randrange(1, 9))]
    spark.createDataFrame(rows, TURNS).withColumn("audit", F.lit(1)).withColumn("t", F.lit(2)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in q.op11_turn_repair(spark, str(tmp_path)).collect()}
    assert got == plain_repair(rows)
    same(q.op11_turn_repair(spark, str(tmp_path)), q.ORACLE_SQL["op11_turn_repair"], str(tmp_path))


def test_conversations_are_repaired_as_they_are(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "user", "q?"), (1, 3, "assistant", "a.")], TURNS)
    got = turnrepair.repair(turnrepair.as_is(turns)).first()
    assert (got.audit, got.cost, [tuple(t) for t in got.repaired]) == ("KKDK", 3, [("system", "s."), ("user", "q?"), ("assistant", "a.")])
    assert turnrepair.repair(turnrepair.as_is(turns.limit(0))).count() == 0


# --- periodic runs


def plain_runs(w):
    """All runs of a list of words, by extending from every place at every period."""
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, exponent, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def key(r):
    return tuple((x is None, str(x)) for x in r)


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_a_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in q.op12_periodic_runs(spark, sf).collect()]
    assert sorted(got, key=key) == sorted((plain_row(*d) for d in docs), key=key)


def periodic_texts():
    rng = random.Random(7)
    out = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "x " + "a b c " * 4 + "y", "a a a a a a b " * 5, "É  " * 9, "q" * 9000, "w " * 3000]
    for _ in range(200):
        w = []
        while len(w) < rng.randrange(1, 90):
            unit = [rng.choice("ab") for _ in range(rng.randrange(1, 6))]
            w += unit * rng.choice([1, 1, 4, 5, 7]) + unit[: rng.randrange(len(unit))]
        out.append(" ".join(w))
    return out


def test_runs_of_odd_texts_dealt_out_or_not(spark):
    rows = [(k, t) for k, t in enumerate(periodic_texts())] + [(None, "a " * 9), (3, "a"), (3, "a"), (5, "a a a a a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("key", F.lit("k"))
    expected = sorted([(d, tuple(plain_runs(WORD.findall(t or "")))) for d, t in rows], key=key)
    for work in (periodic.RANGE_WORK, 50, 1):
        got = periodic.periodic_runs(docs, work=work)
        assert sorted([(r.doc_id, tuple(tuple(x) for x in r.runs)) for r in got.collect()], key=key) == expected
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_dealt_out_texts_collapse_alike(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(periodic_texts())], "doc_id long, text string")
    one, two = (sorted(map(tuple, periodic.periodic_runs(docs, work=w).select("doc_id", "n_words", "collapsed").collect())) for w in (periodic.RANGE_WORK, 30))
    assert one == two


# --- nearest neighbours


def plain_nearest(ids, x, asks, k=5):
    x = np.asarray(x, float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(asks):
        s = u @ u[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def table_of(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def recalled(spark, ids, x, asks_every=50):
    got = {}
    for r in neighbours.search(table_of(spark, ids, x), F.col("vec_id") % asks_every == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    exact = plain_nearest(ids, x.astype(np.float32), ids % asks_every == 0)
    assert got.keys() == exact.keys() and all(sorted(v) == list(range(1, 6)) for v in got.values())
    return np.mean([len(set(got[i].values()) & set(exact[i])) / 5 for i in exact])


def test_recall_on_random_and_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    n = 6000
    ids = rng.permutation(n)
    centres = rng.standard_normal((40, 32))
    tight = centres[rng.integers(0, 40, n)] + 0.3 * rng.standard_normal((n, 32))
    assert recalled(spark, ids, tight) >= 0.9
    # a third of all vectors are near copies of one
    tight[: n // 3] = centres[0] + 0.02 * rng.standard_normal((n // 3, 32))
    assert recalled(spark, ids, tight) >= 0.9
    assert recalled(spark, ids, rng.standard_normal((n, 64))) >= 0.9


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    exact = plain_nearest(ids, x, ids % 50 == 0)
    got = {}
    for r in q.op13_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    at = {int(i): k for k, i in enumerate(ids)}
    for i, found in got.items():
        assert [r for r, *_ in sorted(found)] == [1, 2, 3, 4, 5]
        for _, j, s in found:
            a, b = x[at[i]].astype(float), x[at[j]].astype(float)
            assert math.isclose(s, a @ b / math.sqrt((a @ a) * (b @ b)), rel_tol=1e-12)
        assert [(-s, j) for _, j, s in sorted(found)] == sorted((-s, j) for _, j, s in found)
    assert np.mean([len({j for _, j, _ in got[i]} & set(exact[i])) / 5 for i in exact]) >= 0.9


def test_deep_prefixes_settle_clustered_queries(spark, monkeypatch):
    """With no search of all vectors, prefixes alone find what is near."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((300, 48))
    x = centres[rng.integers(0, 300, 6000)] + 0.1 * rng.standard_normal((6000, 48))
    levels = []
    whole = neighbours._meet
    monkeypatch.setattr(neighbours, "_meet", lambda rows, asked, level: levels.append((level, asked.count())) or whole(rows, asked, level))
    assert recalled(spark, np.arange(6000), x, 5) >= 0.9
    assert max(k for k, _ in levels[1:]) >= 2 and levels[-1][1] <= 0.05 * 1200


def test_small_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 8))
    table = table_of(spark, np.arange(700), x)
    one = sorted(map(tuple, neighbours.search(table, F.col("vec_id") % 10 == 0).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    assert sorted(map(tuple, neighbours.search(table, F.col("vec_id") % 10 == 0).collect())) == one


def test_odd_vectors(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(0, e), (0, e), (1, e), (2, [2.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0]), (None, e), (8, []), (9, [1.0, 1.0]), (50, [1e300, 1e300, 0.0]), (10, [-1e-300, 0.0, 0.0])]
    rows += [(100 + k, e) for k in range(40)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 12)))
    assert sorted(got[0]) == [(k + 1, v, 1.0) for k, v in enumerate([1, 2, 100, 101, 102])]
    assert sorted(got[50]) == [(k + 1, v, round(1 / math.sqrt(2), 12)) for k, v in enumerate([0, 1, 2, 100, 101])]
    assert sorted(got[100]) == [(k + 1, v, 1.0) for k, v in enumerate([0, 1, 2, 101, 102])]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (50, [3.0, 4.0, 5.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.search(few, F.col("vec_id") % 50 == 0).collect()] == [1]
    assert neighbours.search(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0
