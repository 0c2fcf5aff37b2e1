import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ke li mo nu ra se ti vo wy".split() for b in "lan mer dos pin tug rav sel qui".split()]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        w = rng.choice(WORDS)
        out.append(w + rng.choice([".\n", ". ", "! "]) if k % 9 == 8 else w + " ")
    return "".join(out).strip()


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, copies, near copies, shared lines, and a very long text."""
    rng = random.Random(3)
    base, shared = prose(rng, 120), "\n".join(prose(rng, 20).replace("\n", " ") for _ in range(4))
    near = base.split(" ")
    near[40] = "changed"
    out = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "one two", "en", "b", 7),
        (5, "one two", "en", "b", 7),
        (None, base, None, "a", 1),
        (6, base, "en", None, 1),
        (7, base, "en", "c", 1),
        (7, base, "en", "c", 1),
        (8, " ".join(near), "en", "a", 1),
        (9, prose(rng, 200) + "\n" + shared + "\n" + prose(rng, 50), "en", "a", 1),
        (10, shared + "\n" + prose(rng, 90), "en", "b", 1),
        (11, prose(rng, 60_000), "en", "b", 1),
        (12, "x" * 300_000, "en", "b", 1),
        (13, "GNU General Public License, MIT License. Apache-License; cc by\n" + prose(rng, 30), "en", "z", 1),
        (14, "é" * 50 + " ÀÉ stupid idiot\r\nline | a | b | c\n#*$%&|<>", "fr", "é", 1),
    ]
    return out


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with a documents table of odd rows."""
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows(), SCHEMA).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
