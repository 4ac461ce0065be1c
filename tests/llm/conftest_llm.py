"""Values that the tests of the text operators share."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("size", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("__text", T.StringType()),
    ]
)
FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} v{i * i % 1009}" for i in range(30000))
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (4, "one"),
    (None, "one two three four five six"),
    (None, None),
    (5, "a b c a b c a b c\n\na b c\n a b c"),
    (6, "line\nline\nLine\n\n\nline \x0b x"),
    (7, LONG),
    (8, "\u00e9\U0001f600 # * | \u2028 x\u00a0y"),
    (9, "a b c a b c a b c\n\na b c\n a b c"),
]
