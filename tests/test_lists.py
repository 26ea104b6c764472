import ast

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from songsift.functions.sql import register_functions
from songsift.functions.lists import (
    clean_tokens,
    first_listed,
    overlap_pct,
    parse_floats,
    parse_list,
    trim_brackets,
    without,
)


def apply(spark, function, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_parse_list_reads_printed_lists(spark):
    cases = {
        "['rock', 'pop']": ["rock", "pop"],
        """["rock 'n roll", 'jazz']""": ["rock 'n roll", "jazz"],
        "['a, b', 'c']": ["a, b", "c"],
        "[]": [],
        r"['caf\xe9']": ["café"],
        r"['a\\xe9']": [r"a\xe9"],
        r"""['it\'s "x"', 'b']""": ["it's \"x\"", "b"],
        "['rock', 'rock', 'Rock']": ["rock", "rock", "Rock"],
        "['']": [""],
        "[rock, pop]": ["rock", "pop"],
        "rock,pop": ["rock", "pop"],
        "": [],
    }
    assert apply(spark, parse_list, list(cases)) == list(cases.values())
    assert apply(spark, parse_list, [None]) == [None]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.text(max_size=12), max_size=5), min_size=1, max_size=30))
def test_parse_list_inverts_repr(spark, lists):
    lists = [[item.encode("utf-8", "ignore").decode() for item in items] for items in lists]
    texts = [repr(items) for items in lists]
    # \U escapes of unassigned code points beyond the basic plane have no JSON form.
    kept = [t for t in texts if "\\U" not in t]
    assert apply(spark, parse_list, kept) == [ast.literal_eval(t) for t in kept]


def test_parse_floats(spark):
    cases = ["[1. 0.91 3.e-1\n 0.5 ]", "[0.1 0.2 ... 0.9]", "[]", None, "[1.0, 2.0]"]
    assert apply(spark, parse_floats, cases) == [
        [1.0, 0.91, 0.3, 0.5],
        [0.1, 0.2, 0.9],
        [],
        None,
        [1.0, 2.0],
    ]


def test_token_helpers(spark):
    assert apply(spark, clean_tokens, [[" Rock ", "POP"], []], "array<string>") == [["rock", "pop"], []]
    assert apply(spark, trim_brackets, ["[a]", "[[a", "a"]) == ["a", "a", "a"]
    pick = lambda v: first_listed(v, ["pop", "rock"])
    assert apply(spark, pick, [["x", "rock", "pop"], ["x"], [], None], "array<string>") == [
        "rock",
        None,
        None,
        None,
    ]


def test_overlap_and_without(spark):
    df = spark.createDataFrame(
        [(["a", "b", "b", "c"], ["b", "c", "d"], "a"), ([], ["a"], "a")],
        "t array<string>, p array<string>, own string",
    )
    got = df.select(overlap_pct(F.col("t"), F.col("p")), without(F.col("t"), F.col("own"))).collect()
    assert [tuple(r) for r in got] == [(50.0, ["b", "b", "c"]), (0.0, [])]


def test_sql_functions_parse_like_the_column_functions(spark):
    register_functions(spark)
    texts = [
        "['rock', 'pop']", """["rock 'n roll", 'a, b']""", r"['caf\xe9', 'a\\xe9']", "[rock, 'pop']",
        r"""['it\'s "x"']""", "[]", "", None, "[1. 0.5\n ... 3e-1]",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT i, parseStringList(t) AS l, parseFloatList(t) AS f FROM texts")
    want = df.select("i", parse_list(F.col("t")).alias("l"), parse_floats(F.col("t")).alias("f"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
