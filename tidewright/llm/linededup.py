"""Line deduplication over overlapping three-line windows, with DataFrame functions only.

Prose has few newlines, so a line ends where the words alone decide, and a passage is cut alike wherever it stands: at a newline; after a word that
ends a clause (``.!?,;:``), where the two before it end none; and after a word of 7, 10, 13 … characters, where the one before it has another length.
LINE_WORDS words without any of these end one too, counted from the end before. Every three consecutive lines of a text are hashed (128 bits). Of a window that
occurs more than once anywhere, all but the first occurrence (smallest id, then smallest place) are removed; overlapping windows merge.

All windows are shuffled and sorted once, by their hash; what follows an equal one is a later occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.skew import HOT_SHARE
from tidewright.session import materialise

WINDOW = 3
MARKS, LINE_WORDS = ".!?,;:", 20
BLANKS = " \t\n\x0b\x0c\r"
_C, _GAP, _AFTER = r"[^ \t-\r]", r"[ \t\x0B-\r]+", r"[ \t-\r]"
_CLAUSE = rf"(?:{_C}*[^ \t-\r{MARKS}]{_GAP}){{2}}{_C}*[{MARKS}]"
_LENGTH = rf"(?:{_C}{{1,6}}|{_C}{{8,9}}(?:{_C}{{3}})*){_GAP}{_C}{{7}}(?:{_C}{{3}})*"
#: A line and the white space after it. Java and RE2 read it alike: up to the earliest ending word, else as many words as may be.
LINE = rf"(?:{_C}+{_GAP}){{0,{LINE_WORDS - 2}}}?(?:{_CLAUSE}|{_LENGTH})(?:{_AFTER}+|\z)|(?:{_C}+{_GAP}){{0,{LINE_WORDS - 1}}}{_C}+{_AFTER}*"
#: The same for Spark, where words can be taken whole: the line is group 1.
_WORD, _WIDE = rf"{_C}++", r"[ \t\x0B-\r]++"
_ENDED = (
    rf"{_WORD}(?<![{MARKS}]){_WIDE}{_WORD}(?<![{MARKS}]){_WIDE}{_WORD}(?<=[{MARKS}])"
    rf"|(?:{_C}{{8,9}}(?:{_C}{{3}})*+|{_C}{{1,6}}+)(?!{_C}){_WIDE}{_C}{{7}}(?:{_C}{{3}})*+(?!{_C})"
)
_SPARK_LINE = rf"((?:{_WORD}{_WIDE}){{0,{LINE_WORDS - 2}}}?(?:{_ENDED})|(?:{_WORD}{_WIDE}){{0,{LINE_WORDS - 1}}}{_WORD}){_AFTER}*+"
#: Documents that are looked at, about, to find the windows which so many hold that they are dealt over SALTS tasks. They decide where rows go, not which.
PROBED, SALTS = 5_000, 64


def lines(text: str, bare: bool = False) -> Column:
    """The lines of a text, each with the white space after it or ``bare``."""
    return F.regexp_extract_all(F.col(text), F.lit(_SPARK_LINE), F.lit(int(bare)))


def windows(docs: DataFrame, order: str, key: str, text: str) -> DataFrame:
    """(o, k, pos, a, b): each window of each text, with the 128-bit hash (a, b) of its lines without the white space after them; and for each text one row with pos -1, whose a is its number of lines."""
    rows = docs.select(F.col(order).alias("o"), F.col(key).alias("k"), F.transform(lines(text, bare=True), lambda x: F.xxhash64(x)).alias("h"))
    rows = rows.select("o", "k", "h", F.coalesce(F.size("h"), F.lit(0)).alias("n"))
    places = F.when(F.col("n") >= WINDOW, F.sequence(F.lit(0), F.col("n") - WINDOW)).otherwise(F.array().cast("array<int>"))
    of = lambda i, *salt: F.xxhash64(*salt, *[F.get("h", i + k) for k in range(WINDOW)])
    whole = F.transform(places, lambda i: F.struct(i.alias("pos"), of(i).alias("a"), of(i, F.lit("b")).alias("b")))
    count = F.struct(F.lit(-1).alias("pos"), F.col("n").cast("long").alias("a"), F.xxhash64("o", "k").alias("b"))
    return rows.select("o", "k", F.inline(F.concat(F.array(count), whole)))


def later(found: DataFrame, hot: DataFrame) -> DataFrame:
    """(o, k, pos, a): the windows that occurred before, and the rows that count lines.

    Ranks run within (a, b). A window in ``hot`` is dealt over SALTS tasks, ranked in each, and the first ones of these meet once more. Windows that share
    (o, k, pos) are one occurrence.
    """
    order = ("o", "k", "pos")
    held = found.join(F.broadcast(hot.select("a", "b", F.lit(True).alias("hot"))), ["a", "b"], "left")
    dealt = held.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("k", "pos"), F.lit(SALTS))).otherwise(0))
    ranked = dealt.withColumn("nth", F.rank().over(Window.partitionBy("a", "b", "salt").orderBy(*order))).where("nth > 1 OR hot OR pos < 0")
    again = F.col("hot").isNotNull() & (F.col("nth") == 1) & (F.col("pos") >= 0)
    # what is known to be later meets nothing: its own place is its key
    second = Window.partitionBy(F.when(again, F.col("a")).otherwise(F.col("k")), F.when(again, F.col("b")).otherwise(F.col("pos")), again).orderBy(*order)
    return ranked.withColumn("again", F.rank().over(second)).where(~again | (F.col("again") > 1)).select(*order, "a")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later occurrences of repeated windows removed from ``text``, plus ``n_lines`` and ``n_removed`` (long).

    Where lines go, the text before them ends with a newline; a text that loses nothing stays as it is, byte by byte. A null text
    stays null and has no lines; texts of fewer than three lines stay. Rows that share an id and a text are the same occurrence and
    are cut alike; of rows that share an id and differ in text, one comes first, by a hash of the text; a null id comes first. Columns named n_lines and
    n_removed are replaced. No group of rows of a common window is gathered.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    source = docs.select(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in own]).alias("r"), F.col(f"`{id_col}`").alias("o"), F.xxhash64(f"`{text}`").alias("k"))
    t = f"r.`{text}`"
    found = windows(source, "o", "k", t)
    share = min(1.0, PROBED / max(1, docs.count()))
    probed = materialise(windows(source.sample(share, 7), "o", "k", t).where("pos >= 0").groupBy("a", "b").agg(F.count("*").alias("n")), "probed")
    total = probed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = probed.where(F.col("n") >= max(8, int(total * HOT_SHARE))).select("a", "b")
    place = F.when(F.col("pos") >= 0, F.col("pos"))
    lost = later(found, hot).groupBy("o", "k").agg(F.sort_array(F.collect_set(place)).alias("at"), F.max(F.when(F.col("pos") < 0, F.col("a"))).alias("n_lines"))
    gone = F.when(F.size("at") > 0, F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + WINDOW - 1)))))
    lost = lost.select(F.col("o").alias("__o"), F.col("k").alias("__k"), gone.alias("gone"), "n_lines")
    cut = source.join(lost.hint("shuffle_hash"), F.col("o").eqNullSafe(F.col("__o")) & (F.col("k") == F.col("__k")), "left")
    cut = cut.select("r", "gone", "n_lines", F.when(F.col("gone").isNotNull(), lines(t)).alias("p"))
    every = F.when(F.size("p") > 0, F.sequence(F.lit(0), F.size("p") - 1))
    kept = cut.select("r", "p", "gone", "n_lines", F.when(F.col("gone").isNotNull(), F.array_except(every, F.col("gone"))).alias("kept"))

    def written(i: Column, j: Column) -> Column:
        whole, follows = F.element_at("p", i + 1), F.get("kept", j + 1)
        bare = F.rtrim(whole, F.lit(BLANKS))
        return F.when(follows == i + 1, whole).when(follows.isNull() & (i == F.size("p") - 1), whole).when(follows.isNull(), bare).otherwise(F.concat(bare, F.lit("\n")))

    new = F.when(F.col("kept").isNull(), F.col(t)).otherwise(F.concat_ws("", F.transform("kept", written)))
    out = [new.alias(c) if c == text else F.col(f"r.`{c}`").alias(c) for c in own]
    return kept.select(*out, F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
