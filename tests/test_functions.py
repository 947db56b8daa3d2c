import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.config import ResolutionConfig, Weights
from kinfold.functions import text as T


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.96111), ("dixon", "dicksonx", 0.81333), ("abcd", "axyz", 0.55), ("abcdef", "bcadef", 0.91667), ("", "x", 0.0), ("", "", 1.0), ("same", "same", 1.0)])
def test_jaro_winkler_values(a, b, want):
    assert T.jaro_winkler_one(a.encode(), b.encode()) == pytest.approx(want, abs=1e-5)


@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_bounds_and_symmetry(a, b):
    x, y = a.encode(), b.encode()
    assert 0 <= T.jaro_winkler_one(x, y) <= 1 + 1e-12
    assert T.jaro_winkler_one(x, x) == 1.0


def test_jaro_winkler_column(spark):
    rows = spark.createDataFrame([("martha", "marhta"), ("a", "a"), (None, "a")], "a string, b string")
    got = [r[0] for r in rows.select(T.jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.961111, 1.0, 0.0], abs=1e-5)


def test_jaro_winkler_column_equals_the_function_without_python(spark):
    names = ["", "lee ann", "lee  ann", "lee. ann", "martha", "marhta", "dwayne", "duane", "dixon", "dicksonx", "aabbaabb", "bbaabbaa", "abcabc", "cbacba", "x", "日本 é", "日本 e", None]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    out = rows.select("a", "b", T.jaro_winkler(F.col("a"), F.col("b")).alias("v"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert all(r["v"] == T.jaro_winkler_one((r["a"] or "").encode(), (r["b"] or "").encode()) for r in out.collect())


def test_cleaning(spark):
    rows = spark.createDataFrame([(" a\t",), ("\x00 \n",), ("",), (None,)], "v string")
    assert [r[0] for r in rows.select(T.clean(F.col("v"))).collect()] == ["a", None, None, None]
    dates = spark.createDataFrame([("0000-00-00",), ("2020-13-01",), ("",), ("1999-02-03",), (None,)], "v string")
    assert [str(r[0]) for r in dates.select(T.clean_date(F.col("v"))).collect()] == ["None", "None", "None", "1999-02-03", "None"]


def test_block_key(spark):
    rows = spark.createDataFrame([("O'Brien", "1970-01-01"), ("'Brien", None), ("Ash-croft", "0000-00-00"), (None, "1970-01-01"), ("日本", "1980-01-01")], "last string, dob string")
    got = [r[0] for r in rows.select(T.block_key(F.col("last"), F.col("dob"))).collect()]
    assert got == ["O165|1970", "B650|____", "A261|0000", None, "0000|1980"]


def test_name_gate_parts(spark):
    rows = spark.createDataFrame([("J", "John", True), ("John", "Jon", False), (None, "x", True), ("St. John", "st john", True)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in rows.select(T.middle_compatible(F.col("a"), F.col("b")), "want").collect())
    assert [r[0] for r in rows.select(T.same_name(F.col("a"), F.col("b"))).collect()] == [False, False, False, True]


def test_ssn_forms():
    h = lambda v: hashlib.sha512((v + "k").encode()).hexdigest()
    assert T.ssn_candidates("123456789", "k") == [h("123456789"), h("123-45-6789")]
    assert T.ssn_candidates("123-45-6789", "k") == [h("123-45-6789"), h("123456789")]
    assert T.ssn_candidates("12345", "k") == [h("12345")]
    assert T.ssn_candidates("12345", None) == [] and T.ssn_unavailable_reason(None) and T.ssn_unavailable_reason("k") is None
    assert len(T.placeholder_hashes("k")) == 26


def test_weights_warn_that_merging_is_unreachable():
    assert Weights().reachable == 0.92 and ResolutionConfig().warnings()
    assert not ResolutionConfig(auto_merge_at=0.9).warnings()


def test_confidences_and_placeholders():
    c = ResolutionConfig()
    assert [c.confidence(t) for t in ("ssn_hash", "npi", "upin", "dea_number", "name_dob")] == [0.99] * 4 + [0.95]
    assert len(c.placeholders) == 13 and c.most_people_per_ssn == 3
