"""Toxicity by weak supervision.

Voters for toxic texts are a lexicon of abuse, patterns (shouting, runs of marks, starred words, abuse said to someone), and words and word beginnings that go with
toxic labels in a bounded sample of labelled rows; a lexicon of civil words votes against. A generative label model (votes given a hidden class, fitted by
expectation-maximisation) estimates each voter's rates in both classes, and from the
residual correlations between voters how much each one repeats others; its posteriors, not the given labels, train a linear
classifier over a wider vocabulary. That classifier scores whole texts in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textnum as tn
from tidewright.session import materialise

#: Labelled rows in the sample at most (those with the smallest hashes of their ids): the bound of what is broadcast and collected.
SAMPLE_ROWS = 20_000
#: Voters, and features of the classifier, at most: those most clearly tied to the class.
MAX_VOTERS, MAX_FEATURES = 400, 4096
#: Word beginnings, in bytes of UTF-8.
PREFIXES = (4, 5, 6, 8)
HOLD_OUT = 5
#: Voters whose residual correlation reaches this say the same thing (a word and its beginnings); lower ones only share a topic or language.
REPEAT = 0.6
#: Words of abuse that vote even where no label teaches them.
LEXICON = ("idiot", "moron", "scum", "stupid", "worthless", "pathetic", "disgusting", "loser", "trash", "clown")
#: Words that address someone, and civil words, which vote against.
ADDRESS = ("you", "your", "u", "du", "dein", "tu", "vous", "usted", "eres")
CIVIL = ("thanks", "thank", "please", "welcome", "danke", "bitte", "merci", "gracias")
#: Patterns, each a feature of its own. No word holds a colon, so none has the hash of a name.
PATTERNS = ("pattern:shouts", "pattern:marks", "pattern:starred", "pattern:said")


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32 of the id as text is divisible by 5; never learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.unique(np.array([tn.hash_text(w) for w in words], np.uint64))


def _patterns(raw: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners) of the PATTERNS of each text, from its bytes and words.

    Shouts: three words or more in capitals, and three in ten of all. Marks: three of ``!?`` in a row. Starred: a letter before two stars. Said: a word of abuse
    within three words of an address.
    """
    n = len(at) - 1
    capital, letter = (raw >= 0x41) & (raw <= 0x5A), ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)
    sums = np.concatenate([[0], np.cumsum(capital)])
    loud = np.bincount(owner[(end - start >= 3) & (sums[end] - sums[start] == end - start)], minlength=n)
    mark, star = (raw == 0x21) | (raw == 0x3F), raw == 0x2A
    runs = np.flatnonzero(mark[:-2] & mark[1:-1] & mark[2:]) if len(raw) > 2 else np.zeros(0, np.int64)
    stars = np.flatnonzero(letter[:-2] & star[1:-1] & star[2:]) if len(raw) > 2 else np.zeros(0, np.int64)
    inside = lambda i: np.unique(t[i + 2 < at[t + 1]]) if len(t := np.searchsorted(at, i, "right") - 1) else t
    abuse, address = np.isin(h, _hashes(LEXICON)), np.isin(h, _hashes(ADDRESS))
    said = [owner[:-k][address[:-k] & abuse[k:] & (owner[:-k] == owner[k:])] for k in (1, 2, 3) if len(h) > k]
    found = [np.flatnonzero((loud >= 3) & (10 * loud >= 3 * np.bincount(owner, minlength=n))), inside(runs), inside(stars), np.unique(np.concatenate([np.zeros(0, np.int64), *said]))]
    keys = [np.full(len(t), tn.hash_text(name), np.uint64) for name, t in zip(PATTERNS, found, strict=True)]
    return np.concatenate(keys), np.concatenate(found)


def _features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners) of all words, word beginnings and patterns of a slice."""
    raw, buf = buf, tn.lower_latin(buf)
    start, end, first = tn.words(buf, at, tn.PUNCT)
    owner = tn.owners(first)
    sums = tn.prefix_hash(buf)
    keys, whose = [tn.span_hash(sums, start, end)], [owner]
    for n in PREFIXES:
        long = np.flatnonzero(end - start > n)
        keys.append(tn.mix(tn.span_hash(sums, start[long], start[long] + n) + np.uint64(n)))
        whose.append(owner[long])
    key, text = _patterns(raw, at, start, end, owner, keys[0])
    keys.append(key)
    whose.append(text)
    return np.concatenate(keys), np.concatenate(whose)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic texts, clean texts) of each slice."""
    for batch in batches:
        toxic = np.asarray(batch.column(1).to_pylist(), np.int64)
        for a, b, buf, at in tn.slices(batch.column(0)):
            key, owner = _features(buf, at)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, y = key[new], toxic[a:b][owner[new]]
            own, group = np.unique(key, return_inverse=True)
            t = np.bincount(group, y, len(own)).astype(np.int64)
            n = np.bincount(group, minlength=len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(t), pa.array(n - t)], names=["f", "t", "c"])


def _hits(known: np.ndarray, key: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, index in the sorted ``known``) of the features that are known."""
    if not len(known) or not len(key):
        z = np.zeros(0, np.int64)
        return z, z
    i = np.minimum(np.searchsorted(known, key), len(known) - 1)
    ok = known[i] == key
    pair = np.unique(owner[ok] * np.int64(len(known)) + i[ok])
    return pair // len(known), pair % len(known)


@dataclass
class Model:
    """Sorted feature hashes with their weights."""

    known: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        text, i = _hits(self.known, *_features(buf, at), n)
        z = self.bias + np.bincount(text, self.weight[i], n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(text: np.ndarray, voter: np.ndarray, n: int, k: int, prior: float, rounds: int = 25, against: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for n texts from the votes (text, voter), and the weight 1 / (sum of correlations) of each voter.

    A voter votes for class 1 (those marked ``against``: for class 0) or abstains. Rates given the class come from expectation-maximisation; residual correlations given the
    class say how many voters repeat one another, and their evidence counts once.
    """
    votes = np.zeros((n, k), np.float32)
    votes[text, voter] = 1
    against = np.zeros(k, bool) if against is None else against
    q = np.where(votes[:, ~against].any(1), 0.9, prior / 2)
    share = np.ones(k)
    together = (votes.T @ votes).astype(np.float64)
    for _ in range(rounds):
        n1, n0 = q.sum() + 1e-9, (1 - q).sum() + 1e-9
        up, down = q @ votes, (1 - q) @ votes
        a, b = np.clip((up + 0.1) / (n1 + 1), 1e-6, 1 - 1e-6), np.clip((down + 0.1) / (n0 + 10), 1e-7, 1 - 1e-6)
        a, b = np.where(against, a, np.maximum(a, b * 1.5)), np.where(against, np.maximum(b, a * 1.5), b)  # a voter is better than chance: the classes keep their names
        a, b = np.minimum(a, 1 - 1e-6), np.minimum(b, 1 - 1e-6)
        # what is expected of a text's votes has rank two, so the covariances of the rest need no matrix of texts by voters
        both, rates = np.stack([q, 1 - q]), np.stack([a, b])
        crossed = np.stack([up, down]).T @ rates
        cov = together - crossed - crossed.T + rates.T @ (both @ both.T) @ rates
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        corr = np.abs(cov / sd[:, None] / sd[None, :])
        corr[corr < REPEAT] = 0
        share = 1 / np.maximum(corr.sum(1), 1)
        pi = np.clip(q.mean(), prior / 4, 0.5)
        present, absent = share * np.log(a / b), share * np.log((1 - np.minimum(a, 0.999)) / (1 - b))
        z = np.log(pi / (1 - pi)) + votes @ (present - absent) + absent.sum()
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, share


def linear(text: np.ndarray, feature: np.ndarray, q: np.ndarray, m: int, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam; both classes weigh alike."""
    n = len(q)
    w, mean, square = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    balance = np.where(q > 0.5, 0.5 / max((q > 0.5).mean(), 1e-3), 0.5 / max((q <= 0.5).mean(), 1e-3))
    w[m] = -1.0
    for step in range(1, rounds + 1):
        z = w[m] + np.bincount(text, w[feature], n)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) * balance / n
        g = np.append(np.bincount(feature, e[text], m), e.sum())
        g[:m] += ridge * w[:m]
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return w[:m], float(w[m])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled rows that are not held out. Null labels and ids are left out.

    An id with several labels has the largest; of several rows with one id the text with the least hash is taken. Only the sampled ids are broadcast, and only counts of features and the known
    features of the sample reach the driver, so what it holds does not grow with the documents.
    """
    spark = docs.sparkSession
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = named.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = spark.createDataFrame(chosen.toPandas(), "doc_id long, toxic int")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialise(named.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "sample")
    counts = sample.mapInArrow(_counts, "f long, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    rows = sample.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("c")).first()
    big_t, big_c = int(rows.t or 0), int(rows.c or 0)
    own, civil = _hashes(LEXICON), _hashes(CIVIL)
    if big_t and big_c:
        # likelihood-ratio statistic of the feature and the class
        n, p = F.col("t") + F.col("c"), big_t / (big_t + big_c)
        log = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        g2 = 2 * (log(F.col("t"), n * p) + log(F.col("c"), n * (1 - p)))
        tied = counts.where((F.col("t") >= 2) & (F.col("t") > 3 * n * p)).select("f", g2.alias("g")).orderBy(F.desc("g"), "f").limit(MAX_FEATURES).toPandas()
    else:
        tied = None
    if tied is not None and len(tied):
        f, g = tied["f"].to_numpy(np.int64).view(np.uint64), tied["g"].to_numpy()
    else:
        f, g = np.zeros(0, np.uint64), np.zeros(0)
    voters = np.unique(np.concatenate([f[:MAX_VOTERS][g[:MAX_VOTERS] >= 20], own, civil, _hashes(PATTERNS)]))
    known = np.unique(np.concatenate([f, voters]))

    def known_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, at in tn.slices(batch.column(0)):
                text, i = _hits(known, *_features(buf, at), b - a)
                cut = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(i, pa.int32()))], names=["i"])

    held = [np.asarray(r.i, np.int64) for r in sample.mapInArrow(known_of, "i array<int>").toLocalIterator()]
    if not held:
        return Model(known, np.where(np.isin(known, own), 4.0, 0.0), -2.0)
    text = np.repeat(np.arange(len(held)), [len(x) for x in held])
    feature = np.concatenate(held)
    index = np.searchsorted(voters, known)
    is_voter = (index < len(voters)) & (voters[np.minimum(index, len(voters) - 1)] == known)
    vote = is_voter[feature]
    q, _ = label_model(text[vote], index[feature[vote]], len(held), len(voters), min(max(big_t / max(1, big_t + big_c), 0.01), 0.5), against=np.isin(voters, civil))
    # words of the lexicon that the sample doesn't hold keep a weight of their own
    weight, bias = linear(text, feature, q, len(known))
    unseen = np.bincount(feature, minlength=len(known)) == 0
    weight[unseen & np.isin(known, own)] = -bias + 2.0
    return Model(known, weight, bias)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` of every whole text, after the columns ``keep`` (all others by default).

    A null or empty text has no features and the score of the bias, below 0.5. Columns named score and predicted are replaced. One narrow pass.
    """
    own = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    # a text that is kept anyway is sent once
    sent = [F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in own]
    source = docs.select(*sent) if "text" in own else docs.select(*sent, F.col("text").cast("string").alias("__scored"))
    at = source.columns.index("text" if "text" in own else "__scored")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(own)]), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in tn.slices(batch.column(at)):
                s = model.score(buf, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(own))), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*own, "score", "predicted"])

    return source.mapInArrow(run, schema)
