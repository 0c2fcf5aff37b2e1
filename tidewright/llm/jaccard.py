"""Similarity join of documents by the Jaccard index of their word n-grams, through a MinHash LSH forest.

Each of TREES signatures of a text is a string of LONGEST minhashes, and a tree of the forest is the trie of one signature of all texts: here the sorted
list of its strings, in which the texts below any node of the trie stand together. One range sort holds all tries. Neighbours in it that share a
prefix are linked with its length, and every text shortens the prefix by which it is matched, from LONGEST on, until the partners that it has met are
expected to share one with the target recall; a text that met none goes down to the length that gives the recall at the threshold itself. Links
shorter than that are left, the others join to components, and inside a component all texts are verified exactly, in blocks, each pair
of blocks in one task. No bucket is expanded to pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm import textnum as tn
from tidewright.llm.graph import components
from tidewright.operators.skew import split_join
from tidewright.session import materialise

N, THRESHOLD = 5, Fraction(4, 5)
TREES, LONGEST, RECALL = 32, 10, 0.999
#: Neighbours are taken for partners from this estimate of their similarity on; its standard error is below 0.04 at the threshold.
NEAR = 0.65
#: Longs of 64 one-bit minhashes that the estimate is made from, and rows of the sorted tries in one task, about.
SKETCH, SORTED_ROWS = 4, 1_000_000
#: Texts, and their bytes, in one block of a component at most, about.
BLOCK_TEXTS, BLOCK_BYTES = 2048, 16 << 20
U = np.uint64
_RNG = np.random.default_rng(5)
_SEEDS = _RNG.integers(1, 1 << 63, (2, TREES * LONGEST), dtype=np.int64).astype(U) * U(2) + U(1)


def prefix_length(threshold: float = float(THRESHOLD), trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix that a pair at the threshold shares in some trie with the target recall."""
    for p in range(longest, 0, -1):
        if 1 - (1 - threshold**p) ** trees >= recall:
            return p
    return 1


def shingle_sets(buf: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes, first of each text and the end). A text of fewer than n words has one, of all its words."""
    start, end, first = tn.words(buf, at, tn.SPACE)
    owner = tn.owners(first)
    h = tn.span_hash(tn.prefix_hash(buf), start, end)
    key, place = tn.shingles(h, owner, n)
    whose = owner[place]
    count = np.diff(first)
    short = np.flatnonzero(count < n)
    whole = []
    for i in short.tolist():
        x = int(count[i]) + 1
        for w in h[first[i] : first[i + 1]].tolist():
            x = (x * 0xD6E8FEB86659FD93 + w) & 0xFFFFFFFFFFFFFFFF
        whole.append(x)
    key, whose = np.concatenate([key, tn.mix(np.array(whole, U))]), np.concatenate([whose, short])
    order = np.lexsort((key, whose))
    key, whose = key[order], whose[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (whose[1:] != whose[:-1])
    key, whose = key[new], whose[new]
    return key, np.searchsorted(whose, np.arange(len(at)))


def set_names(key: np.ndarray, first: np.ndarray) -> list[bytes]:
    """16 bytes that name each set: equal sets have equal names."""
    parts = [np.add.reduceat(tn.mix(key ^ U(salt)), first[:-1]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return [a + b for a, b in zip(*([x.tobytes() for x in p.astype(">u8")] for p in parts), strict=True)]


def signatures(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strings, sketches) of sets: the strings of all trees, 2 bytes a minhash, as bytes of shape (texts, TREES, 2 * LONGEST), and SKETCH longs of one bit a minhash."""
    n = len(first) - 1
    strings, bits = np.empty((n, TREES, LONGEST), ">u2"), np.zeros((n, SKETCH), U)
    for tree in range(TREES):
        for level in range(LONGEST):
            k = tree * LONGEST + level
            a, b = _SEEDS[:, k]
            least = np.minimum.reduceat((key ^ a) * b, first[:-1])
            strings[:, tree, level] = (least ^ (least >> U(29))) & U(0xFFFF)
            if k < 64 * SKETCH:
                bits[:, k // 64] |= ((least >> U(20)) & U(1)) << U(k % 64)
    return strings.view(np.uint8).reshape(n, TREES, 2 * LONGEST), bits


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, at in tn.slices(batch.column(3)):
            key, first = shingle_sets(buf, at)
            strings, bits = signatures(key, first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * SKETCH, pa.int32()), pa.array(bits.view(np.int64).ravel()))
            sent = [*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(set_names(key, first), pa.binary()), pa.array([x.tobytes() for x in strings], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(sent, names=["doc_id", "t1", "t2", "node", "strings", "sketch"])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Bytes of a column whose values all have ``width``."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(len(column), width)


ADJACENT = "a binary, b binary, shared int, edge binary"


def _adjacent(floor: int):
    """From sorted rows (string, node) the neighbours that share a prefix of at least ``floor`` levels, and the first and last row of the task, with b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [] if held is not None else [0]
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            string, node = rows["string"].combine_chunks() if isinstance(rows["string"], pa.ChunkedArray) else rows["string"], rows["node"].combine_chunks() if isinstance(rows["node"], pa.ChunkedArray) else rows["node"]
            x = _fixed(string, 1 + 2 * LONGEST)
            level = np.ascontiguousarray(x[:, 1:]).view(">u2")
            same = np.cumprod(level[1:] == level[:-1], axis=1, dtype=np.int32).sum(1) * (x[1:, 0] == x[:-1, 0])
            at = np.flatnonzero(same >= floor)
            yield _edges(node.take(pa.array(at)), node.take(pa.array(at + 1)), same[at], None)
            if ends:
                yield _edges(node.slice(0, 1), None, np.array([0]), string.slice(0, 1))
            held = batch.slice(batch.num_rows - 1, 1)
        if held is not None:
            yield _edges(held.column("node"), None, np.array([0]), held.column("string"))

    return run


def _edges(a: pa.Array, b: pa.Array | None, shared: np.ndarray, edge: pa.Array | None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.binary())
    return pa.RecordBatch.from_arrays([a.cast(pa.binary()), none if b is None else b.cast(pa.binary()), pa.array(shared.astype(np.int32)), none if edge is None else edge.cast(pa.binary())], names=["a", "b", "shared", "edge"])


def neighbours(nodes: DataFrame, floor: int) -> DataFrame:
    """(a, b, shared) for distinct pairs of nodes that stand together in some sorted trie: the levels that they share there at most.

    ``nodes`` are (node, strings). The sort is by ranges of the strings, with the node as the last key, so a prefix that very many texts share is cut over
    tasks like any other. The rows at the edges of tasks, two a task, are linked afterwards.
    """
    spread = nodes.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda i: F.substr("strings", i * (2 * LONGEST) + 1, F.lit(2 * LONGEST)))).alias("tree", "s"), "node")
    rows = spread.select(F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), "s").alias("string"), "node")
    tasks = max(8, -(-nodes.count() * TREES // SORTED_ROWS))
    found = materialise(rows.repartitionByRange(tasks, "string", "node").sortWithinPartitions("string", "node").mapInArrow(_adjacent(floor), ADJACENT), "tries")
    order = Window.orderBy("edge", "a")  # two rows a task
    same = sum(((F.substring("edge", 1, 1 + 2 * p) == F.substring(F.lag("edge").over(order), 1, 1 + 2 * p)).cast("int") for p in range(1, LONGEST + 1)), F.lit(0))
    across = found.where("b IS NULL").select("a", F.lag("a").over(order).alias("b"), same.alias("shared")).where(F.col("b").isNotNull() & (F.col("shared") >= floor))
    both = found.where("b IS NOT NULL").select("a", "b", "shared").unionByName(across).where("a != b")
    return both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("shared").alias("shared"))


def chance(s: Column, p: int) -> Column:
    """Chance that a pair of similarity s shares a prefix of length p in some tree."""
    return 1 - F.pow(1 - F.pow(s, F.lit(float(p))), F.lit(float(TREES)))


def shortened(pairs: DataFrame, sketches: DataFrame, floor: int, recall: float = RECALL) -> DataFrame:
    """The pairs (a, b, shared) that share the prefix to which either of them has come down.

    A text comes down from LONGEST until, by its estimated similarities to the partners that it has met, it is expected to share a prefix with ``recall`` of them;
    one that has met none comes down to ``floor``. Pairs that are no partners stay: they hold a run of the trie together.
    """
    sketch = lambda x: sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    differ = sum(F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH))
    s = 1 - 2 * differ / (64.0 * SKETCH)
    known = materialise(pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "shared", s.alias("s")), "pairs")
    ends = known.where(F.col("s") >= NEAR).select(F.explode(F.array("a", "b")).alias("x"), F.greatest("s", F.lit(float(THRESHOLD))).alias("s"))
    lengths = range(floor + 1, LONGEST + 1)
    depth = ends.groupBy("x").agg(sum(((F.avg(chance(F.col("s"), p)) >= recall).cast("int") for p in lengths), F.lit(floor)).alias("depth"))
    of = lambda x: depth.select(F.col("x").alias(x), F.col("depth").alias(f"d{x}"))
    own = lambda x: F.coalesce(f"d{x}", F.lit(floor))
    return known.join(of("a"), "a", "left").join(of("b"), "b", "left").where((F.col("shared") >= F.least(own("a"), own("b"))) | (F.col("s") < NEAR)).select("a", "b")


def _linked(names: list[bytes], column: pa.Array, copies: np.ndarray, left: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a group: index of the least text linked with it through links of the group, and the copies of its links.

    ``left`` marks the first of two blocks, of which only pairs across count.
    """
    m = len(names)
    sets, sizes = [], np.zeros(m, np.int64)
    for a, _, buf, at in tn.slices(column):
        key, first = shingle_sets(buf, at)
        sets.append(key)
        sizes[a : a + len(first) - 1] = np.diff(first)
    order = np.argsort(sizes, kind="stable")
    start = np.concatenate([[0], np.cumsum(sizes)])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    by_size = np.concatenate([code[start[i] : start[i + 1]] for i in order.tolist()])
    n = sizes[order]
    at = np.concatenate([[0], np.cumsum(n)])
    side = left[order] if left is not None else None
    root, links, weight = np.arange(m), np.zeros(m, np.int64), copies[order]
    mark = np.zeros(int(code.max()) + 1, bool)
    top, bottom = THRESHOLD.numerator, THRESHOLD.denominator
    for i in range(m - 1):
        end = int(np.searchsorted(n, n[i] * bottom // top, "right"))  # larger sets can't reach the threshold
        if end <= i + 1:
            continue
        own = by_size[at[i] : at[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[by_size[at[i + 1] : at[end]]], at[i + 1 : end] - at[i + 1], dtype=np.int64)
        mark[own] = False
        ok = common * (top + bottom) >= top * (n[i] + n[i + 1 : end])
        if side is not None:
            ok &= side[i + 1 : end] != side[i]
        js = np.flatnonzero(ok) + i + 1
        if len(js):
            links[i] += weight[js].sum()
            links[js] += weight[i]
            met = np.unique(np.append(root[js], root[i]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    out_root, out_links = np.empty(m, np.int64), np.empty(m, np.int64)
    out_links[order] = links
    for r in np.unique(root).tolist():
        members = order[root == r]
        out_root[members] = min(members.tolist(), key=names.__getitem__)
    return out_root, out_links


VERIFIED = "node binary, root binary, links long, blocks int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, i, j, blocks, block, node, copies, text), sorted by the first three: links inside each group."""

    def done(group: pa.Table) -> pa.RecordBatch:
        names = group["node"].to_pylist()
        once = [k for k, x in enumerate(names) if names.index(x) == k] if len(set(names)) < len(names) else None
        if once is not None:  # rows that repeat
            group, names = group.take(once), [names[k] for k in once]
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        left = np.asarray(group["block"].to_numpy() == i) if i != j else None
        root, links = _linked(names, group["text"].combine_chunks(), group["copies"].to_numpy(), left)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([names[r] for r in root.tolist()], pa.binary()), pa.array(links), pa.array(group["blocks"].to_numpy().astype(np.int32))],
            names=["node", "root", "links", "blocks"],
        )

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            if keys[a] != now and held:
                yield done(pa.Table.from_batches(held))
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
            a = b
    if held:
        yield done(pa.Table.from_batches(held))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of docs: class_id is the least doc_id among documents joined by links, n_links the
    number of other documents with a Jaccard index of 4/5 or more, copies included.

    N-grams are five words ``[^\\x20\\x09-\\x0D]+`` as they are; a text of fewer words has one n-gram of all its words, so such texts
    link if their words are equal (nulls and empty texts with each other). Rows that repeat an id are rows of their own; a null id gives a
    class whose other ids are not null one of those. Equal sets meet once, as a node; a component of candidates larger than a block is split, and its blocks meet
    in pairs. Other columns are ignored.
    """
    return _classes(docs).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame) -> DataFrame:
    """The columns of :func:`classes` with the hashes of the text (t1, t2) and the name of the class (root)."""
    source = _keyed(docs)
    signed = materialise(source.mapInArrow(_signed, "doc_id long, t1 long, t2 long, node binary, strings binary, sketch array<long>"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2")).alias("rep")
    nodes = materialise(signed.groupBy("node").agg(F.count("*").alias("copies"), first, F.first("strings").alias("strings"), F.first("sketch").alias("sketch")), "nodes")
    floor = prefix_length()
    linked = shortened(neighbours(nodes.select("node", "strings"), floor), nodes.select("node", "sketch"), floor)
    candidate = materialise(components(linked), "candidates")
    members = candidate.join(nodes.select("node", "copies", "rep"), "node").select("node", "component", "copies", _whole(F.col("rep.doc_id")).alias("id"), "rep.t1", "rep.t2")
    texts = source.select(_whole(F.col("doc_id")).alias("id"), "t1", "t2", "text").join(members, ["id", "t1", "t2"])
    # rows that repeat an id and its text bring one text
    texts = materialise(texts.groupBy("component", "node", "copies").agg(F.first("text").alias("text")), "texts")
    sizes = texts.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"), F.count("*").alias("n"))
    sizes = materialise(sizes.where("n > 1"), "sizes")
    found = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = split_join(texts, sizes, ["component"], "n", found).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meets = meets.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "blocks", "block", "node", "copies", "text")
    groups = meets.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    verified = materialise(groups.mapInArrow(_verify, VERIFIED), "verified")
    one = verified.where("blocks = 1").select("node", "root", "links")
    more = verified.where("blocks > 1")
    if more.limit(1).count():
        whole = components(more.select(F.col("node").alias("a"), F.col("root").alias("b")))
        sums = more.groupBy("node").agg(F.sum("links").alias("links"))
        one = one.unionByName(sums.join(whole, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "links"))
    known = nodes.join(one, "node", "left").select("node", "copies", F.col("rep.doc_id").alias("rep"), F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    known = materialise(known, "classes")
    ids = known.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n_nodes"))
    total = known.count()
    named = materialise(split_join(known, ids, ["root"], "n_nodes", total).select("node", "copies", "root", "class_id", "links"), "named")
    rows = signed.select("doc_id", "t1", "t2", "node")
    return split_join(rows, named, ["node"], "copies", rows.count()).select("doc_id", "t1", "t2", "root", "class_id", (F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"))


def _whole(c: Column) -> Column:
    """An id that joins: null stands for itself."""
    return F.coalesce(c, F.lit(-(1 << 63)))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text): two hashes name the text, so rows that repeat an id, or have none, are told apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("t"), "text").alias("t2"), "text")


def unique(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: the row with the least id, and of rows that share that id (or have none) those of the text whose hashes are least.

    Rows that repeat both id and text are the same document and stay together.
    """
    found = _classes(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2")).alias("k")
    kept = found.groupBy("root").agg(least).select(_whole(F.col("k.doc_id")).alias("__id"), F.col("k.t1").alias("__t1"), F.col("k.t2").alias("__t2"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = (_whole(docs["doc_id"].cast("long")) == kept["__id"]) & (F.xxhash64(text) == kept["__t1"]) & (F.xxhash64(F.lit("t"), text) == kept["__t2"])
    return docs.join(kept, same, "left_semi")
