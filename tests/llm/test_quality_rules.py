from helixgrid.llm import quality_rules
from tests.llm import sql

LONG = " ".join(f"word{i}" for i in range(40))
DOCS = [
    (1, "", "a"), (2, None, "a"), (3, LONG, "a"), (4, LONG + "\n" + LONG, "b"), (5, "x " * 30, "b"), (5, "x " * 30, "b"),
    (6, "a\nb\na\n \n\nb\na #*$ <|>", None), (7, "é\u00a0ß\u2003x " + LONG, None), (8, LONG + " one two " + " ".join(f"word{i}" for i in range(9)) + " end", "c"),
    (9, "p q r s t u v w p q r s t u v w " + LONG, "c"), (10, "\t\x0b\x0c\r", "d"), (11, LONG * 30, "d"),
]


def test_equals_sql(spark):
    data = [(i, t, h, 0) for i, t, h in DOCS]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, host int")
    assert sql.of(quality_rules.apply_rules(df)) == sql.rows(quality_rules.ORACLE_SQL, documents=("doc_id bigint, text varchar, source varchar, host int", data))


def test_bad_host_and_empty_table(spark):
    data = [(i, LONG, "good") for i in range(20)] + [(100 + i, "spam", "bad") for i in range(19)] + [(200, LONG, "bad")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.apply_rules(df).filter("kept").collect()}
    assert kept == set(range(20))
    assert quality_rules.apply_rules(df.limit(0)).count() == 0
