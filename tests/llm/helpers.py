"""Tables for the tests, with what real ones hold now and then."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, start long, _doc long"


def docs(spark, texts):
    """Documents of (doc_id, text), with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, 7, 8) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


#: Null, empty, blank, repeated, odd spaces, no final word, controls, very long.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one two"), (5, "a  b\n c "), (6, "Ünï çödé   wide   x"),
    (7, "x" * 100_000), (8, "word " * 30_000), (9, "\x00\x01\x02 \x1c"), (10, "<|im_end|> <|endoftext|> it's don't 123abc"),
]
