"""A small documents table with what may go wrong: nulls, empty and long texts, repeated rows, clashing columns."""

import random

rng = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "Ärger", "naïve", "zeta", "theta", "kappa", "omega"]


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


LONG = prose(30_000)
BASE = prose(120)
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("alpha", "alpha", 1) + " tail end"), (4, None), (5, ""), (6, "   \n \n"), (7, "one two"), (8, "One two."),
    (9, LONG), (10, LONG + " more"), (None, BASE), (None, None), (11, prose(60)), (12, "日本語 テキスト ▁ mark \x00 end"), (13, "x" * 500), (14, "y y y y y y y y y y y y"),
]


def frame(spark, rows=ROWS):
    data = [(i, t, "en", "src", 0, "kept", "n") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words int, items string, spans string")
