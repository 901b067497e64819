"""Functions under SQL names give what the column functions give."""
from docweave.functions.register import ONE_TEXT, register


def test_registered_functions(spark):
    names = register(spark, "dw_")
    assert len(names) >= 18
    texts = spark.createDataFrame([("Chapter IV.B.2 - Leave & Travel",), ("https://x.example/a",), ("",), (None,)], "c string")
    texts.createOrReplaceTempView("register_texts")
    for name in names:
        by_name = [r[0] for r in spark.sql(f"SELECT {name}(c) v FROM register_texts").collect()]
        assert by_name == [r[0] for r in texts.select(ONE_TEXT[name.removeprefix("dw_")]("c")).collect()], name
