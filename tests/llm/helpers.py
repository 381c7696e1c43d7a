"""Small tables with the awkward cases that every operator must bear."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "", "", 0),
    (4, " \t\n\r ", "en", "a", 5),
    (5, "the quick brown fox jumps over the lazy dog again", "en", "a", 10),
    (5, "the quick brown fox jumps over the lazy dog again", "en", "a", 10),
    (None, "the quick brown fox jumps over the lazy dog again", None, None, None),
    (None, None, None, None, None),
    (6, "word " * 30_000, "en", "b", 150_000),
    (7, "x" * 100_000, None, "b", 100_000),
    (8, "KK Under The MIT License \U0001f600 é́ ▁▁ <s> <0x0A>\x00", "fr", "c", 3),
    (9, "12345 !!! ???", "de", "c", 13),
]

#: Names that operators use themselves.
CLASHES = "norm hits s key fp anchor digest n n_bytes keep_id bucket name lo root rep node rank forest share q v grade h nth text_sha256 component_id mix_slot mix_at n_words".split()


def docs(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
