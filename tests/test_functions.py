import random

import pytest
from pyspark.sql import functions as F

from keystrata.functions import keys, protocol

PAYLOAD = '{"name": "erlang"}'


@pytest.mark.parametrize("before,after", [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)])
def test_blanks_around_a_command_mean_nothing(spark, before, after):
    df = spark.createDataFrame([(" " * before + "save " + PAYLOAD + " " * after,)], "raw string")
    row = protocol.parse(df).first()
    assert (row.command, row.args, row.doc, row.valid) == ("save", PAYLOAD, PAYLOAD, True)


def test_parser_cases(spark):
    cases = {
        "lookup": ("lookup", "", None, True),
        "save_key A1 x  y": ("save_key", "A1", "x  y", True),
        "save_key A1": ("save_key", "A1", "", True),
        "update A1 v\r\n": ("update", "A1", "v", True),
        "save\tx": ("save\tx", None, None, False),
        "SAVE x": ("SAVE", None, None, False),
        "": ("", None, None, False),
        "save a\nsave b\n": ("save", None, "a\nsave b", True),
        "delete 0f \r\n\r\n": ("delete", "0f", None, True),
        None: ("", None, None, False),
    }
    df = spark.createDataFrame([(i, raw) for i, raw in enumerate(cases)], "i int, raw string")
    got = [(r.command, r.key, r.doc, r.valid) for r in protocol.parse(df).orderBy("i").collect()]
    assert got == list(cases.values())


def test_key_domain_and_number(spark):
    top = "7" + "F" * 27
    cases = {"0": 0, "ff": 255, "0FF": 255, top: 2**111 - 1, "8" + "0" * 27: None, "-1": None, "xyz": None, "": None, "000": 0, "0" * 40 + "a": 10, None: None}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, k string")
    rows = df.select("i", keys.in_domain(F.col("k")).alias("ok"), keys.to_number(F.col("k")).cast("string").alias("n")).orderBy("i").collect()
    for row, want in zip(rows, cases.values()):
        assert row.ok == (want is not None)
        assert (None if row.n is None else int(row.n)) == want


def test_key_round_trip(spark):
    r = random.Random(1)
    texts = [format(r.getrandbits(r.randint(1, 111)), "X") for _ in range(300)] + ["0", "1", "7" + "F" * 27, "1" + "0" * 14]
    df = spark.createDataFrame([(t,) for t in texts], "k string")
    bad = df.where(keys.from_number(keys.to_number(F.col("k"))) != F.col("k")).count()
    assert bad == 0


def test_generated_keys_are_distinct_and_valid(spark):
    df = spark.range(2000).select(keys.generated(F.col("id"), 7).alias("k"))
    assert df.distinct().count() == 2000
    assert df.where(~keys.in_domain(F.col("k"))).count() == 0


def test_empty_prefix_starts_nothing(spark):
    df = spark.createDataFrame([("", "abc"), ("ab", "abc"), ("b", "abc"), ("", "")], "p string, s string")
    assert [r[0] for r in df.select(keys.starts_with(F.col("p"), F.col("s"))).collect()] == [False, True, False, False]
