"""Column functions: recode equivalence, accent folding, labels, flags."""

import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from microstar.functions import (any_flag, attendance_code, code_parts, label, recode_map,
                                 recode_sequential, region_label, strip_accents, strip_accents_unicode)
from microstar.functions.recode import Rule, compose_rules
from microstar.spec.recodes import recodes_for

TOKENS = st.sampled_from(list("ABCDEFGH") + [str(i) for i in range(14)])


@settings(max_examples=25, deadline=None)
@given(rules=st.lists(st.tuples(TOKENS, TOKENS), min_size=1, max_size=8),
       values=st.lists(st.one_of(TOKENS, TOKENS.map(str.lower), st.just("Z9")), min_size=1, max_size=12))
def test_sequential_equals_composed_map_on_single_tokens(spark, rules, values):
    rs = [Rule(a, b) for a, b in rules]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(recode_sequential("v", rs).alias("s"), recode_map("v", rs).alias("m")).collect()
    assert all(r["s"] == r["m"] for r in got), (rules, values, got)


def test_identity_rule_still_normalises_case(spark):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    rules = [Rule("A", "A")]
    got = df.select(recode_sequential("v", rules).alias("s"), recode_map("v", rules).alias("m")).collect()
    assert [(r["s"], r["m"]) for r in got] == [("A", "A"), ("b", "b")]


def test_placeholder_swap_and_minus_one_is_token_exact(spark):
    rules = [Rule("1", "0"), Rule("3", "A"), Rule("2", "3"), Rule("A", "2")]
    assert compose_rules(rules) == {"1": "0", "3": "2", "2": "3", "A": "2"}
    df = spark.createDataFrame([("3",), ("2",), ("-1",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(recode_map("v", rules)).collect()]
    assert got == ["2", "3", "-1", "x", None]
    # the regex form turns '-1' into '-0' (word boundary before 1)
    assert df.where(F.col("v") == "-1").select(recode_sequential("v", rules)).first()[0] == "-0"


def test_edition_maps_have_expected_shape():
    m19 = recodes_for(2019)["ANO_CCL_ENS_MED"]
    assert m19["1"] == "13" and m19["13"] == "1" and m19["M"] == "13"
    assert recodes_for(2019)["Q002"]["E"] == "6" and recodes_for(2018)["Q002"]["E"] == "7"
    assert "COD_EST_CVL" not in recodes_for(2019)


def test_strip_accents_matches_nfd_rule(spark):
    texts = ["São João", "Caracaraí", "Ñandú Über façade", "Ærø Łódź", "é combined", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(strip_accents("t")).collect()]
    full = [r[0] for r in df.select(strip_accents_unicode("t")).collect()]

    def nfd(s):
        if s is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)) \
            .replace("Ł", "L").replace("ł", "l")
    assert got == [nfd(t) for t in texts]
    assert full == got


def test_labels_flags_and_codes(spark):
    df = spark.createDataFrame([("0", "1", None, "0", "1400100"), ("1", "0", "0", "0", "5300108"),
                                ("7", "0", "0", "0", "0000000")], "c string, a string, b string, d string, m string")
    rows = df.select(label("c", {"0": "zero", "1": "one"}).alias("l"), any_flag(["a", "b"]).alias("f"),
                     attendance_code(["a", "b", "d"]).alias("k"), region_label(code_parts("m")["COD_REG_UF"]).alias("r"),
                     code_parts("m")["COD_MUN"].alias("mun")).collect()
    assert [r["l"] for r in rows] == ["zero", "one", ""]
    assert [r["f"] for r in rows] == ["Sim", "Não", "Não"]      # null flag = not set
    assert [r["k"] for r in rows] == [2, 0, 0]
    assert [r["r"] for r in rows] == ["N", "CO", ""]
    assert rows[0]["mun"] == "00100"


def test_dataframe_recode_modes(spark):
    from microstar.operators.project import recode
    df = spark.createDataFrame([("F", "3"), ("o", "1"), ("P", "x")], "s string, n string")
    rules = {"s": [Rule("F", "A"), Rule("O", "F"), Rule("A", "O")], "n": [Rule("1", "0"), Rule("3", "1")]}
    by_map = [tuple(r) for r in recode(df, rules).collect()]
    by_seq = [tuple(r) for r in recode(df, rules, mode="sequential").collect()]
    assert by_map == by_seq == [("O", "1"), ("F", "0"), ("P", "x")]
    assert [tuple(r) for r in recode(df, {"s": {"F": "0"}}).collect()][0] == ("0", "3")


def test_multi_column_histograms_equal_single_column(spark):
    from microstar.operators.profile import profile_histogram, profile_histograms
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    many = sorted(tuple(r) for r in profile_histograms(li, cols).collect())
    one = sorted(tuple(r) for c in cols for r in profile_histogram(li, c).collect())
    assert many == one


def test_profile_quantiles(spark):
    from microstar.operators.profile import profile_summary
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("x"))
    m = {r["metric"]: r["value"] for r in profile_summary(df, ["x"], quantiles=(0.25, 0.5, 0.75)).collect()}
    assert (m["p25"], m["p50"], m["p75"]) == (250.0, 500.0, 750.0)
    assert m["count"] == 1000 and m["distinct"] == 1000
