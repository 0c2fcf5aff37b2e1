"""Line-first quality rules.

Each line is judged by rules on its punctuation, on navigation and on boilerplate; lines that fail are removed, and a document that
loses too much of its text so is rejected. All counting is numpy over the bytes of many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textnum as tn

SYMBOLS = b"#*$%&|<>"
#: A word that ends in one of these carries a sentence end.
MARKS = b".!?:;\"')]"
#: Fixed phrases of page furniture, searched for in the lower-cased line.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
)
#: A line also fails if over half its words shout or repeat the word before, or if signs exceed 3 in 10 words. A line with so many bars is a menu.
NAV_BARS = 3
#: Windows of so many words count as repeats; a document of fewer words than MIN_WORDS, or with over MAX_REPEAT percent of its
#: words in repeats, fails the base rules.
WINDOW, MIN_WORDS, MAX_REPEAT = 5, 10, 20
#: Rejected if its failing lines hold more than this percentage of its words.
MAX_LOST = 50

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bad_lines long, kept_words long, base_failed boolean, kept boolean"
_SYMBOL, _MARK = tn.byte_set(SYMBOLS), tn.byte_set(MARKS)


def _per(owner: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weight, n).astype(np.int64)


def _repeat_words(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words of each text within windows that occur twice or more in it."""
    key, at = tn.shingles(h, owner, WINDOW)
    if not len(key):
        return np.zeros(n, np.int64)
    key = tn.mix(key + owner[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    cover = np.zeros(len(h) + WINDOW, np.int32)
    starts = at[again]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return _per(owner[np.cumsum(cover)[: len(h)] > 0], n)


def _measure(buf: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The columns of SCHEMA; start and end of each line; whether the line stays."""
    n = len(at) - 1
    sums = tn.prefix_hash(buf)
    start, end, first = tn.words(buf, at, tn.SPACE)
    owner = tn.owners(first)
    n_words = np.diff(first)
    by_byte = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(((buf & 0xC0) != 0x80) & ~tn.SPACE[buf], out=by_byte[1:])
    word_chars = np.diff(by_byte[at])
    np.cumsum(_SYMBOL[buf], out=by_byte[1:])
    symbols, n_symbols = by_byte.copy(), np.diff(by_byte[at])
    # lines: cut at \n and at the ends of texts
    cuts = np.flatnonzero(buf == 0x0A)
    line_start = np.sort(np.concatenate([at[:-1], cuts + 1]), kind="stable")
    line_owner = np.searchsorted(at[1:], line_start, "right")
    # an empty text, and the empty line after a \n that ends a text, have no words: their place matters not
    line_end = np.minimum(np.append(line_start[1:], len(buf)), np.append(at[1:], len(buf))[np.minimum(line_owner, n)])
    line_end = np.where((line_end > line_start) & (buf[np.maximum(line_end, 1) - 1] == 0x0A) if len(buf) else False, line_end - 1, line_end)
    line_of = np.searchsorted(line_start, start, "right") - 1
    m = len(line_start)
    in_line = _per(line_of, m)
    real = np.flatnonzero(in_line)
    key = tn.mix(tn.span_hash(sums, line_start[real], line_end[real]) + owner[np.searchsorted(line_of, real)].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, once = np.unique(key, return_index=True)
    dup = np.ones(len(real), bool)
    dup[once] = False
    real_owner = owner[np.searchsorted(line_of, real)]
    n_dup = _per(real_owner[dup], n)
    h = tn.span_hash(sums, start, end)
    n_repeat = _repeat_words(h, owner, n)
    # rules by line
    ends = _per(line_of[_MARK[buf[end - 1]]], m)
    np.cumsum(buf == 0x7C, out=by_byte[1:])
    bars = by_byte[line_end] - by_byte[line_start]
    np.cumsum(buf == 0x21, out=by_byte[1:])
    shouts = by_byte[line_end] - by_byte[line_start]
    signs = symbols[line_end] - symbols[line_start]
    again = np.flatnonzero((h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])) + 1
    stutters = _per(line_of[again], m)
    bad = (ends == 0) | (bars >= NAV_BARS) | (2 * shouts > in_line) | (10 * signs > 3 * in_line) | (2 * stutters > in_line)
    low = tn.lower_ascii(buf).tobytes()
    for phrase in BOILERPLATE:
        p = phrase.encode()
        i = low.find(p)
        while i >= 0:
            k = np.searchsorted(line_start, i, "right") - 1
            bad[k] |= i + len(p) <= line_end[k]
            i = low.find(p, i + 1)
    bad &= in_line > 0
    lost = _per(owner[bad[line_of]], n)
    kept_words = n_words - lost
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT * n_words)
    kept = ~failed & (100 * lost <= MAX_LOST * n_words)
    cols = [n_words, word_chars, n_symbols, n_dup, n_repeat, _per(real_owner, n), _per(line_owner_of(bad, line_of, owner), n), kept_words, failed, kept]
    return cols, line_start, line_end, ~bad


def line_owner_of(bad: np.ndarray, line_of: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Text of each failing line."""
    lines = np.flatnonzero(bad)
    return owner[np.searchsorted(line_of, lines)]


def _cleaned(buf: np.ndarray, at: np.ndarray, line_start: np.ndarray, line_end: np.ndarray, stays: np.ndarray) -> list[str]:
    data, out = buf.tobytes(), []
    lo = np.searchsorted(line_start, at[:-1], "left")
    hi = np.searchsorted(line_start, at[1:], "left")
    for i in range(len(at) - 1):
        a = [data[line_start[k] : line_end[k]] for k in range(lo[i], hi[i]) if stays[k]]
        out.append(b"\n".join(a).decode())
    return out


def quality(docs: DataFrame, text: str = "text", clean: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Columns of SCHEMA for each row of ``docs``, after its columns ``keep`` (all others by default).

    ``clean`` adds ``clean_text``, the text without its failing lines. A null or empty text has no words and fails; a repeated
    row is judged again, alike; an empty table gives none. Input columns named as those of SCHEMA are left out. One narrow pass:
    nothing is shuffled.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    own = [c for c in (keep if keep is not None else docs.columns) if c not in (*names, text, "clean_text")]
    source = docs.select(*own, F.col(text).cast("string").alias("__text"))
    extra = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]] if own else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, at in tn.slices(batch.column(len(own))):
                cols, s, e, stays = _measure(buf, at)
                out = [batch.column(i).slice(a, b - a) for i in range(len(own))] + [pa.array(c) for c in cols]
                if clean:
                    out.append(pa.array(_cleaned(buf, at, s, e, stays), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[*own, *names, *(["clean_text"] if clean else [])])

    return source.mapInArrow(run, ", ".join([*extra, SCHEMA, *(["clean_text string"] if clean else [])]))
