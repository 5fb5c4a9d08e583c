"""Fixtures that every operator of the subpackage must survive."""

from pyspark.sql.functions import lit

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EDGE_TEXTS = [
    None, "", " ", "  ", "\n", "a", "a  b", "a\n\nb", " \n x", "it's 'S IT'S 'll<|endoftext|>x <|startoftext|> y", "\0a b\0 c", "é é́ İ Σας ΣΑΣ ﬁ",
    "tab\tx \ty", "12 345\n6", "x\x1cy \x1c z", "x\x01y", "hello\x85there", "日本語 テスト🙂 🙂", "▁a ▁", "<s> </s> <unk> <0x0A>", "\n\n\na\n", "word " * 3000, "ab" * 4000,
    "the same text twice", "the same text twice",
]


def edge_docs(spark, ids=None):
    """Edge texts with a repeated row, a null id, null and empty columns, and extra columns with clashing names."""
    rows = [(i, t, [None, "en", "xx", ""][i % 4], [None, "s1", "s2", ""][i % 4], None if t is None else len(t)) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[5], (None, "a document without an id", "en", "s1", 3)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    for name in ("size", "n_tokens", "rank", "start", "kept", "component_id", "length", "id", "row", "copies", "copy", "gone_id", "near", "TEXT", "Source"):
        df = df.select("*", lit("x").alias(name))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
