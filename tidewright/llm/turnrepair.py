"""Structure repair of conversations: A* over the lattice of edits.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Keep, Rerole, Delete and Insert turn its rows into a legal
one; the search finds the cheapest edits, and of those with equal cost the one whose audit (the initials of the edits, in order) is
least in ASCII. A node is (rows consumed, role written last). The heuristic is a suffix sum of what the rows ahead cost whatever
is done with them: a blank or duplicate row must be deleted, and a truncated one costs its charge, or more if it goes. It is
consistent, so nodes that leave the queue, keyed (cost plus heuristic, audit), are final.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Role written last -> initials that may follow; the first is the one that an edit can write.
FOLLOWS = {"": "us", "s": "u", "u": "a", "a": "u"}
ENDS = {"", "a"}
BLANKS = " \t\n\v\f\r"
FAULTS = ("", "blank", "duplicate", "truncated")
SCHEMA = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"
)
TURN = "struct<numbered:boolean,turn:long,role:string,text:string,shown:string,said:string,copies:int>"


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """First fault of each (role, text): blank, duplicate of an earlier row, truncated, or none."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        said = row[1].rstrip(BLANKS)
        out.append("blank" if not said else "duplicate" if row in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add(row)
    return out


def initial(role: str) -> str:
    """First character; an empty role counts as a space, as a null one does."""
    return role[:1] or " "


def cheapest(initials: list[str], found: list[str]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows with these initials and faults.

    The open list holds audits as text, so memory can reach the square of the rows of one conversation.
    """
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if found[i] in ("blank", "duplicate") else TRUNCATED if found[i] else 0)
    done: set[tuple[int, str]] = set()
    queue = [(ahead[0], "", 0, "")]
    while queue:
        guess, audit, i, last = heapq.heappop(queue)
        if (i, last) in done:
            continue
        if i == n and last in ENDS:
            return guess, audit
        done.add((i, last))
        cost = guess - ahead[i]
        write = FOLLOWS[last][0]
        steps = [(cost + INSERT + ahead[i], audit + "I", i, write)]
        if i < n:
            rest = ahead[i + 1]
            steps.append((cost + DELETE + rest, audit + "D", i + 1, last))
            if found[i] in ("", "truncated"):
                charge = TRUNCATED if found[i] else 0
                steps.append((cost + REROLE + charge + rest, audit + "R", i + 1, write))
                if initials[i] in FOLLOWS[last]:
                    steps.append((cost + KEEP + charge + rest, audit + "K", i + 1, initials[i]))
        for step in steps:
            if (step[2], step[3]) not in done:
                heapq.heappush(queue, step)
    raise AssertionError("deleting every row is always legal")


def replay(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows that the edits of ``audit`` leave."""
    out: list[tuple[str, str]] = []
    last, i = "", 0
    for edit in audit:
        write = FOLLOWS[last][0]
        if edit == "I":
            out.append((ROLE[write], ""))
        else:
            role, text = rows[i]
            i += 1
            if edit == "D":
                continue
            out.append((role, text) if edit == "K" else (ROLE[write], text))
        last = initial(out[-1][0])
    return out


def mend(turns: list[dict]) -> tuple:
    """Values of SCHEMA for the sorted rows of one conversation."""
    rows = [(t["shown"], t["said"]) for t in turns for _ in range(t["copies"])]
    numbers = {t["turn"] for t in turns if t["numbered"] and t["copies"]}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    found, initials = faults(rows), [initial(r) for r, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest(initials, found)
    fixed = [{"role": r, "text": t} for r, t in replay(rows, audit)]
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, fixed


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``shown``, ``said`` and ``copies``: what planted faults make of each row.

    crc32 of ``conv_id:turn`` (nulls: one space) modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` away,
    3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return turns.select(
        "conv_id", "turn", "role", "text",
        F.when(kind == 4, "user").otherwise(blank("role")).alias("shown"),
        said.alias("said"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def as_is(turns: DataFrame) -> DataFrame:
    """``turns`` with the columns that :func:`repair` reads, undamaged; a null role or text is one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select("conv_id", "turn", "role", "text", blank("role").alias("shown"), blank("text").alias("said"), F.lit(1).alias("copies"))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id and SCHEMA, one row a conversation, from what :func:`damage` or :func:`as_is` returns.

    Rows come by turn (nulls first), those of one turn by role and text as they were before any damage, copies side by side. A conversation
    without rows that remain has zeros, an empty audit and no repaired turns; null ids are one conversation; an empty table gives none;
    other columns are ignored. One shuffle brings the rows of a conversation together; a conversation is the unit of the search, so
    one task holds it, whatever else is skewed.
    """
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"), "shown", "said", F.col("copies").cast("int").alias("copies"),
    )
    chats = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda t: F.struct(t["numbered"].alias("numbered"), t["turn"].alias("turn"), t["shown"].alias("shown"), t["said"].alias("said"), t["copies"].alias("copies"))).alias("t"))
    kind = chats.schema["conv_id"].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        kinds = [pa.int64()] * 6 + [pa.string(), turns_type]
        for batch in batches:
            got = [mend(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([g[k] for g in got], kinds[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["conv_id", *names])

    return chats.mapInArrow(run, f"conv_id {kind}, {SCHEMA}")


def text_of(repaired: Column) -> Column:
    """``role:text`` of each turn, one a line."""
    return F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
