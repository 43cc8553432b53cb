"""Rows that every operator must take."""

import random

LONG = " ".join(f"word{k % 977} tail{k % 31}." for k in range(9000))
PLAIN = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion "


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "su", "ker", "an", "vo", "del", "ish"]
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(words))


def edge_documents() -> list[tuple]:
    """(doc_id, text): NULL, empty, blank, long, tied, repeated and non-ASCII rows."""
    base = prose(1, 120)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, base), (6, base), (6, base),
        (7, base + " and a few more words"), (8, "Ünïcödé straße 文字 mixed space " * 12),
        (9, "one two"), (10, "one two"), (11, prose(2, 80) + "\n" + prose(2, 80)),
        (12, "### $$$ *** ||| " * 30), (13, "ab " * 400), (None, base), (14, prose(3, 60)),
        (15, "x" * 5000), (16, PLAIN * 3 + prose(4, 60)), (17, prose(5, 70) + " " + PLAIN * 3),
    ]


#: Names that the operators use inside, to clash with.
CLASH = "doc_id long, text string, n long, spans string, codes string, bucket int, place string, a int"
