"""Small tables of texts with the cases that break things."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string"


def in_parts(spark, *parts):
    """A table with each list of rows in a partition of its own."""
    return spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(list), SCHEMA)


def passages(seed: int, n: int = 80) -> list[tuple[int, str | None]]:
    """Few different words, pieces of other texts, runs, nulls, empty and space-only texts."""
    r = random.Random(seed)
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        letters = r.choice(["a", "ab", "abc", "abcdefgh", "äé日z"])
        w = [r.choice(letters) * r.choice([1, 1, 3]) for _ in range(r.choice([0, 1, 4, 5, 12, 13, 14, 40, 150]))]
        for _ in range(2):
            if rows and r.random() < 0.7:
                old = (r.choice(rows)[1] or "").split()
                a, p = r.randrange(len(old) + 1), r.randrange(len(w) + 1)
                w[p:p] = old[a : a + r.randrange(60)]
        text = "".join(x + r.choice([" ", " ", " ", "\n", "\t", "  ", " \r\n"]) for x in w)
        rows.append((i * 3 - 20, r.choice([text] * 20 + [None, "", " \n\t "])))
    rows.append((1000, rows[5][1]))
    rows.append((1001, "ab" * 400))
    rows.append((1002, "x " * 3000))
    return rows


def edited(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    """Copies with no, one or a few words changed."""
    r = random.Random(seed)
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        if rows and r.random() < 0.7:
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 6])):
                p = r.randrange(len(w) + 1)
                w[p : p + r.randrange(2)] = [r.choice(["New", "new", "z"])] * r.randrange(2)
        else:
            w = [r.choice("abcdefghij") + r.choice("klmnop") for _ in range(r.choice([0, 1, 3, 5, 6, 30, 80, 200]))]
        rows.append((i, " ".join(w) if r.random() < 0.95 else None))
    return rows


def lines(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        out = []
        for _ in range(r.randrange(5)):
            old = [x for _, t in rows[-20:] for x in (t or "").split("\n")]
            if old and r.random() < 0.7:
                w = r.choice(old).split(" ")
                for _ in range(r.choice([0, 1, 1, 2])):
                    p = r.randrange(len(w) + 1)
                    w[p : p + r.randrange(2)] = [r.choice("abc")] * r.randrange(2)
            else:
                w = [r.choice("abcdefgh" if r.random() < 0.6 else "ab") for _ in range(r.choice([0, 2, 4, 5, 9, 10, 11, 30]))]
            out.append(" ".join(w))
        rows.append((i, "\n".join(out) if r.random() < 0.95 else None))
    return rows


def regular_words(size: int) -> tuple[str, str]:
    """Two different words of regular build, for which polynomials modulo powers of two are equal."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
