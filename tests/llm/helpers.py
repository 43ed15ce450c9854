"""Small documents with every awkward case."""

TEXT = "doc_id long, text string"
SPACE = r"[^\x20\x09-\x0D]+"


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def awkward():
    """Nulls, empties, blanks, ties, repeated rows, odd characters and one long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [(1, "Hello World, hello world."), (2, None), (3, ""), (4, " \n\t "), (None, "no id"), (5, long), (6, long), (7, "Hello World, hello world."), (7, "Hello World, hello world."), (8, "ÄÖ é 日本 \x1cx\x85y "), (9, "a\n\na\na b c d e a b c d e")]


def frame(spark, rows, schema=TEXT):
    return spark.createDataFrame(rows, schema)
