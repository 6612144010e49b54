"""Tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

EXTRA = ("doc long, tie string, key_doc int, run_spans string, size string, pattern string, kept string, "
         "score string, grp string, words string, item string, page string, target string, `odd name` string")
N_EXTRA = 14
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"

LONG = " ".join(f"long{k % 5003}word{k}" for k in range(30_000))
PLAIN = ("the quick fox of this story went over many hills and found under an old tree some letters that nobody had "
         "opened for years so it carried them home and read them aloud by the fire while rain fell on the roof and "
         "winter slowly went away from all the valleys around")


def documents(spark, rows=None):
    base = [
        (1, PLAIN, "en", "a"), (1, PLAIN, "en", "a"), (2, PLAIN, "en", "b"), (None, PLAIN, None, None),
        (3, None, "en", "a"), (4, "", "en", "a"), (5, "  \n \t\n", None, "a"), (None, None, None, None),
        (6, LONG, "en", "a"), (7, "one two", "en", None), (8, "ünï cödé \U0001f600 text here", "de", "b"),
        (9, "x\n" * 300, "en", "b"), (1, "another text under the same number", "en", "a"),
    ] if rows is None else rows
    filled = [(*row, None if row[1] is None else len(row[1]), *[None] * N_EXTRA) for row in base]
    return spark.createDataFrame(filled, DOCUMENTS)


def empty(spark):
    return documents(spark, [])
