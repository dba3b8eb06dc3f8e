"""Small tables with every awkward case: nulls in any column, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, n_words string, hits string, host string"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed: int = 1, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, 90) for _ in range(4)]
    out = []
    for i in range(n):
        k = i % 8
        if k == 0:
            words = base[i % 4].split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            text = " ".join(words)
        elif k == 1:
            text = base[i % 4]
        elif k == 2:
            text = prose(rng, 30) + " " + " ".join(base[0].split()[10:50]) + " " + prose(rng, 10)
        elif k == 3:
            text = "\n".join(prose(rng, 12) for _ in range(5)) + "\nShared line of the site\n"
        else:
            text = prose(rng, rng.randrange(1, 200))
        out.append((i, text, "en" if i % 3 else None, f"s{i % 2}" if i % 7 else None, len(text), "q", "n", "h", "o"))
    out += [
        (1000, None, "en", "s0", None, None, None, None, None),
        (1001, "", "en", "s0", 0, None, None, None, None),
        (1002, " \t\n\x0b ", None, None, 5, None, None, None, None),
        (1003, "one", "en", "s1", 3, None, None, None, None),
        (1004, prose(rng, 20_000), "en", "s1", None, None, None, None, None),
        (None, base[0], "en", "s1", None, None, None, None, None),
        (None, base[0], "en", "s1", None, None, None, None, None),
        (1005, base[1], "de", "s1", None, None, None, None, None),
        (1005, base[1], "de", "s1", None, None, None, None, None),
        (1006, "Äé ß日本語 \U0001f600 don't   42%", "de", "s1", None, None, None, None, None),
    ]
    return out


def table(spark, given=None, parts: int = 3):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA).repartition(parts)
