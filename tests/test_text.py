import pytest
from pyspark.sql import functions as F

from tracewell.functions import rules as R
from tracewell.functions import text


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_grams_of_mixed_text(spark):
    assert _one(spark, "你好世界 hello 世a", text.extract_grams("t", 2)) == ["你好", "好世", "世界", "hello", "世a"]
    assert _one(spark, "你好世界", text.extract_grams("t", 3)) == ["你好世", "好世界"]
    assert _one(spark, "ab，c", text.extract_grams("t", 2)) == ["ab"]


def test_cjk_rewrite(spark):
    assert _one(spark, "查询 apple错误", text.cjk_bigram_rewrite("t")) == "查询 apple 错误"
    assert _one(spark, "数据库错误", text.cjk_bigram_rewrite("t")) == "数据 据库 库错 错误"
    assert _one(spark, "好", text.cjk_bigram_rewrite("t")) == "好"


def test_bigrams_keep_code_points(spark):
    got = _one(spark, "a 😀b c", text.bigrams("t"))
    s = "a😀bc"
    assert sorted(got) == sorted(s[i : i + 2] for i in range(len(s) - 1))
    assert _one(spark, "a", text.bigrams("t")) == []


def test_error_keys(spark):
    raw = "Error: cannot edit C:\\tmp\\a.md  'x y' at 12\nmore"
    assert _one(spark, raw, text.normalize_error("t")) == "cannot edit <path> <q> at N"
    assert _one(spark, "bad\n thing Input: secret", text.clean_error_sample("t")) == "bad thing"


def test_tokens_and_quotes(spark):
    assert _one(spark, "你好abcd", text.est_tokens("t")) == 2 + 1 + 1
    assert _one(spark, "说「一二三四五六」和「短」", text.quote_spans("t")) == ["一二三四五六"]
    assert _one(spark, 'a "one" b "x" c "open', text.ascii_quote_spans("t")) == ["one"]


@pytest.mark.parametrize(
    "given,want",
    [
        ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
        ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"),
        ("2024-01-02T03:04:05.123", "2024-01-02 03:04:05"),
        ("1700000000", "2023-11-14 22:13:20"),
        ("1700000000000", "2023-11-14 22:13:20"),
        ("soon", "soon"),
        (" ", None),
    ],
)
def test_stamps(spark, given, want):
    assert _one(spark, given, text.to_local_ts("t")) == want


def test_rule_tables_are_checked():
    R.check_rules(R.DEFAULT_RULES)
    good = R.Rule("a", "env", ("x",), "w", "f")
    for bad in (
        [good, good],
        [R.Rule("a", "env", (), "w", "f")],
        [R.Rule("a", "env", ("(",), "w", "f")],
        [R.Rule("a", "nope", ("x",), "w", "f")],
        [R.Rule("a", "env", ("x",), "w", "f", face="moon")],
    ):
        with pytest.raises(ValueError):
            R.check_rules(bad)


def test_key_matching(spark):
    df = spark.createDataFrame([("abcdefgh", "x abcdefgh y"), ("abc", "x abc"), ("same", "same"), ("", "x")], "k string, p string")
    assert [r.m for r in df.select(text.key_matches(F.col("k"), F.col("p")).alias("m")).collect()] == [True, False, True, False]
