import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


#: Null and empty texts, blanks, a very long text, repeated rows, ties, and text beyond ASCII.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(1, 300)), (5, prose(1, 300)), (6, prose(1, 300)), (7, prose(2, 6000)),
    (8, "Ärger 日本語 🙂 naïve ² ½ x y z\x1c\x85 don't we'll\n\n  three   spaces"), (9, "line one is here\nline two is here\nline one is here"),
    (10, "LINE ONE IS HERE  \nshort\nline two is here"), (None, "no document"),
]


def documents(spark, rows=None):
    """Documents with more columns, some of names that operators might use inside."""
    schema = "doc_id long, text string, lang string, h1 long, n_words string, media string, pos int, _of int, n_chars long"
    return spark.createDataFrame([(i, t, "en", 0, "x", "y", 1, 2, len(t or "")) for i, t in (EDGES if rows is None else rows)], schema)


def texts(rows=None):
    return [(i, t or "") for i, t in (EDGES if rows is None else rows) if i is not None]
