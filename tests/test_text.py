from pyspark.sql import functions as F

from lexicorn.functions.text import char_prompt, char_reference, clean_text, strip_prefix


def _clean(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(clean_text("t", **kw)).collect()]


def test_clean_steps_in_order(spark):
    got = _clean(spark, [
        "Hello World",
        "see http://ex.org/a?b=1 now",
        "ping @user_1 ok",
        "#Tag_9 rocks",
        "price $5 + tax \U0001F600",
        "a\nb\tc",
        "  many   spaces here  ",
        None,
        "WWW.Site.com/x end",
    ])
    assert got == ["hello world", "see now", "ping ok", "tag_9 rocks", "price 5 tax",
                   "abc", "many spaces here", "", "end"]


def test_newline_to_space_option(spark):
    assert _clean(spark, ["a\nb"], newline_to_space=True) == ["a b"]


def test_char_split_and_strip(spark):
    df = spark.createDataFrame([("abcdefg", "abc")], "t string, p string")
    r = df.select(char_prompt("t", 0.5).alias("p1"), char_reference("t", 0.5).alias("r1"),
                  strip_prefix(F.lit("hello there"), F.lit("hello")).alias("s")).first()
    assert (r.p1, r.r1, r.s) == ("abc", "defg", "there")
