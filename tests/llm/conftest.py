"""Texts with everything the operators must bear."""

from __future__ import annotations

import random

import pytest

SCHEMA = ("doc_id long, text string, source string, n_words long, shard string, _lines string, "
          "sequence_id int")


def _texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(11)
    words = ["alpha", "Bêta", "gamma", "delta.", "épsilon", "zeta,", "Eta", "theta", "iota", "ça",
             "kappa", "lambda", "MU", "nü", "xi", "o", "pi", "rho!", "sigma", "tau", "c3", "42"]

    def text(n: int) -> str:
        return "".join(rng.choice(words) + str(rng.randint(0, 40)) + rng.choice("     \n")
                       for _ in range(n)).strip(" ")

    base = [text(n) for n in (130, 200, 90, 400)]
    rows: list[tuple[int | None, str | None, str | None]] = []
    for i in range(24):
        rows.append((i, text(rng.randint(1, 120)), f"host{i % 3}"))
    for i in range(24, 64):  # near and exact copies
        w = base[i % 4].split(" ")
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w), "host0"))
    passage = text(70).replace("\n", " ")
    lines = "\n".join(text(6).replace("\n", " ") for _ in range(12))
    for i in range(64, 72):
        rows.append((i, text(30) + "\n" + passage + "\n" + lines + "\n" + text(25), None))
    rows += [(72, None, "host1"), (73, "", "host1"), (74, "   \n\t ", "host2"), (75, "one", None),
             (76, "two words", "host2"), (77, base[0], "host0"), (77, base[0], "host0"),
             (None, base[1], "host0"), (None, None, None), (78, "same " * 300, "host0"),
             (79, "x\n" * 400, "host0"), (80, text(30000), "host1"),
             (81, "Write to a.b@mail7.example.com or +1 (017) 555-7713 now", "host1"),
             (82, "ip 10.0.0.255 and 256.1.1.1, card 4111 1111 1111 1111, 4111111111111112", None),
             (83, "a@b.c_d@e.f é𝒳 x@y 1.2.3.4.5.6.7.8 +1((((((( " + "9" * 5000, "host2"),
             (84, "licensed under CC\nBY 4.0. All rights  reserved. MIT license the under "
                  "released\nGeneral Public License, cc by cc by", "host2"),
             (85, "<|endoftext|> a<|startoftext|>b  <|ENDOFTEXT|>   c \n d e　f "
                  "日本語 'll don't", "host2"),
             (86, text(40) + " " + "z" * 4000 + " " + text(10), "host1")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return _texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "s", "l", 2) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark, rows):
    w = (rows[3][1] or "").split()
    some = [(1, " ".join(w[2:20])), (2, "not there at all in any of these texts of ours today"),
            (3, "two words"), (10, " ".join((rows[65][1] or "").split()[40:60])), (4, None), (5, ""),
            (None, "Bêta gamma unlikely words"), (3, "two words")]
    return spark.createDataFrame(some, "item_id long, text string"), some
