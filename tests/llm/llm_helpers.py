"""Inputs that the tests of the text operators share."""

SF = "/root/testdata/sf0.001"

#: Null and empty texts, blanks, an empty id, repeated rows, ties, and one very long text.
ODD = (
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "a null id has this text"), (None, None),
    (5, "same words in this row"), (5, "same words in this row"), (6, "same words in this row"),
    (7, "naïve Ünïcødé ✓ 漢字 \U0001f600 text"), (8, "long " * 30000 + "tail"),
)
