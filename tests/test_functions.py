"""Normalizers, dialects, row hash, Python functions."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import normalize as nz
from quern.functions.dialect import row_hash, translate
from quern.functions.udf import apply_to_batch, udaf, udf


def one(spark, steps, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return nz.normalize(df, {"x": steps}).first().x


@pytest.mark.parametrize(
    "steps,value,want",
    [
        ([nz.trim(), nz.lower()], "  AbC ", "abc"),
        ([nz.empty_to_null()], "", None),
        ([nz.whitespace_to_null()], " \t".strip("\t"), None),
        ([nz.email_normalize()], " A@B.c ", "a@b.c"),
        ([nz.phone_normalize()], "+1 (23) 4-5", "+12345"),
        ([nz.regex_replace(r"(a)(b)", r"\2\1")], "abab", "baba"),
        ([nz.regex_replace("a", "$", flags="")], "banana", "b$nana"),
        ([nz.regex_replace("A", "x", flags="gi")], "aAb", "xxb"),
        ([nz.regex_replace("z", "x", flags="")], "aAb", "aAb"),
        ([nz.truncate(2)], "abc", "ab"),
        ([nz.parse_int()], "-12", -12),
        ([nz.parse_int()], "1.5", None),
        ([nz.parse_int(on_failure="default", default=7)], "x", 7),
        ([nz.parse_int(on_failure="default", default=7)], None, 7),
        ([nz.parse_bool()], "YES", True),
        ([nz.parse_bool()], "0", False),
        ([nz.parse_bool()], "?", None),
        ([nz.default("d")], None, "d"),
        ([nz.nullif("a"), nz.not_null_or("b")], "a", "b"),
        ([nz.sql("concat(col, 'color')")], "a", "acolor"),
    ],
)
def test_normalizers(spark, steps, value, want):
    assert one(spark, steps, value) == want


def test_dates(spark):
    said = lambda v, **k: str(one(spark, [nz.parse_timestamp(**k)], v))
    assert said("2024-02-03 04:05:06.25").startswith("2024-02-03 04:05:06.25")
    assert said("2024-02-03T04:05:06+02:00") == "2024-02-03 02:05:06"
    assert said("02/03/2024") == "2024-02-03 00:00:00"
    assert said("2024-13-01") == "None" and said("soon") == "None"
    assert said("03/02/2024", format="DD/MM/YYYY") == "2024-02-03 00:00:00"
    assert str(one(spark, [nz.parse_date()], "20240203")) == "2024-02-03"
    with pytest.raises(ValueError):
        nz.parse_date(format="YY")
    with pytest.raises(Exception, match="cannot parse"):
        one(spark, [nz.parse_timestamp("YYYY-MM-DD", on_failure="error")], "soon")
    for wrong in (dict(on_failure="error"), dict(default="x"), dict(on_failure="default"), dict(format="YYYYMMDD", formats=["YYYYMMDD"]), dict(formats=[])):
        with pytest.raises(ValueError):
            one(spark, [nz.parse_timestamp(**wrong)], "x")
    assert one(spark, [nz.parse_bool()], "t") is None and one(spark, [nz.parse_bool()], "Y") is True
    assert str(one(spark, [nz.parse_timestamp(), nz.to_timezone("Asia/Tokyo"), nz.date_trunc("hour")], "2024-01-01 00:30:00")) == "2024-01-01 09:00:00"
    assert one(spark, [nz.clamp(1, 5)], None, "int") == 1 and one(spark, [nz.clamp(1, 5)], 9, "int") == 5
    assert one(spark, [nz.round(1)], 2.25, "double") == 2.3


def test_tables(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, n int, v string")
    assert sorted(r.v for r in nz.deduplicate_by(df, "k", order_by=[F.desc("n")]).collect()) == ["b", "c"]
    assert nz.deduplicate_by(df, "k").count() == 2
    assert nz.normalize(df, {"w": [nz.derive("n + 1"), nz.clamp(0, 2)]}).agg(F.max("w")).first()[0] == 2
    assert nz.limit(nz.filter_where(df, "k = 1"), 1).count() == 1
    assert nz.sample_pct(df, 100).count() == 3 and nz.sample_pct(df, 0).count() == 0
    with pytest.raises(ValueError):
        nz.normalize(df, {"w": [nz.clamp(0, 2), nz.derive("n")]})
    with pytest.raises(ValueError):
        nz.sample_pct(df, 101)


def test_translate(spark):
    assert translate("SELECT strpos(a, 'strpos(') FROM \"t x\"", "datafusion") == "SELECT instr(a, 'strpos(') FROM `t x`"
    assert translate("SELECT make_array(1, 2), arrow_cast(c, 'Timestamp(Microsecond, None)')", "datafusion") == "SELECT array(1, 2), CAST(c AS timestamp)"
    assert translate("SELECT list_value(1) AS list_value", "duckdb") == "SELECT array(1) AS list_value"
    assert spark.sql(translate('SELECT list_value(1, 2) AS "a b"', "duckdb")).first()[0] == [1, 2]
    assert translate("SELECT 1", "spark") == "SELECT 1"
    with pytest.raises(ValueError):
        translate("SELECT 1", "oracle9")


def test_row_hash(spark):
    r = spark.createDataFrame([("a", None, 3)], "x string, y string, z int").select(row_hash(["x", "y", "z"]).alias("h")).first()
    assert r.h == hashlib.sha256(b"a\x01\x00NULL\x00\x013").hexdigest()


def test_functions(spark):
    @udf(args=("double",), returns="double")
    def twice(x):
        import pyarrow.compute as pc

        return pc.multiply(x, 2.0)

    @udaf(args=("double",), returns="double")
    class Span:
        def __init__(self):
            self.low = self.high = None

        def update_batch(self, x):
            self.merge_batch([(x.min(), x.max())])

        def merge_batch(self, states):
            for low, high in states:
                self.low = low if self.low is None else min(low, self.low)
                self.high = high if self.high is None else max(high, self.high)

        def state(self):
            return self.low, self.high

        def evaluate(self):
            return float(self.high - self.low)

    df = spark.createDataFrame([(1, 2.0), (1, 5.0), (2, 1.0), (None, 4.0)], "k int, x double").repartition(3)
    assert sorted(r.y for r in df.select(twice("x").alias("y")).collect()) == [2.0, 4.0, 8.0, 10.0]
    assert apply_to_batch(twice, pa.array([1.5])).to_pylist() == [3.0]
    assert {(r.k, r.span) for r in Span(df, ["k"], ["x"]).collect()} == {(1, 3.0), (2, 0.0), (None, 0.0)}
    assert Span(df, [], ["x"], "s").first().s == 4.0
    with pytest.raises(TypeError):
        twice("x", "k")
