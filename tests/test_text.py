import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callgrain.functions import text as T
from callgrain.functions.similarity import name_ratio

QUERY_GOLDEN = {
    None: None,
    "": "",
    "   ": "",
    "yojna yojna scheme": "",
    "PM KSNY PM KSNY": "",
    "PM-Kisan status?": "status pmksn",
    "status of PM Kisan Samman Nidhi": "status pmksn",
    "Pradhan  Mantri Kisan Samman Nidhi Yojana": "pmksn",
    "pm the kisan": "pmksn",
    "kisan samman nidhi": "pmksn",
    "Prime Minister scheme": "pm",
    "asked asked pm": "pm",
    "tell me about the the weather in Agra": "weather agra",
    "पीएम किसान की जानकारी।": "पीएम किसान की जानकारी",
    "status status": "status",
    "statusof status": "status statusof",
    "xpm kisan samman nidhix": "xpmksnx",
    "pm kisan pm kisan": "pmksn pmksn",
    "Étion dans, la": "étion dans la",
    "a\tb\nc": "b c",
    "ask_me ask": "ask_me",
    "...the status!": "status",
    "ਕਣਕ ਦੀ ਬਿਜਾਈ": "ਕਣਕ ਦੀ ਬਿਜਾਈ",
}

TEXT_GOLDEN = {
    None: "",
    "   ": "",
    "PM-Kisan status?": "pmkisan status",
    "pm  kisan samman nidhi": "pmkisan",
    "pradhan mantri kisan samman nidhi": "pmkisan samman nidhi",
    "pradhan mantri kisansamman nidhi": "pmkisan",
    "pmkisansammannidhi": "pmkisan",
    "xpm kisan": "xpm kisan",
    "pm kisanx": "pm kisanx",
    "पीएम किसान की जानकारी।": "pmkisan की जानकारी।",
    "प्रधान मंत्री किसान": "pmkisan",
    "ਕਣਕ ਦੀ": "ਕਣਕ ਦ",
    "a_b, c/d": "a_b c d",
    "x²": "x²",
}


def test_query_golden(eval_col):
    assert eval_col(T.norm_query, list(QUERY_GOLDEN)) == list(QUERY_GOLDEN.values())


def test_text_golden(eval_col):
    assert eval_col(T.norm_text, list(TEXT_GOLDEN)) == list(TEXT_GOLDEN.values())


PIECES = ["pm", "kisan", "samman", "nidhi", "ksny", "pradhan", "mantri", "prime", "minister", "yojana", "yojna",
          "scheme", "status", "the", "of", "x", "_", " ", "  ", "-", ".", "\n", "é", "7", "किसान", "पीएम", "PM"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=40, max_size=60))
def test_properties_of_normalised_texts(eval_col, texts):
    latin = [t for t in texts if not re.search(r"[\u0900-\u097f]", t)]
    queries, plain = eval_col(T.norm_query, latin), eval_col(T.norm_text, texts)
    for out in (*queries, *plain):
        assert out == " ".join(out.split()) == out.lower() and not re.search(r"[.-]", out)
    for out in queries:
        words = out.split()
        assert not set(words) & {*T.STOP_WORDS, "scheme"} and "status" not in words[1:]
    assert eval_col(T.norm_text, plain) == plain


def test_small_normalisers(eval_col):
    assert eval_col(T.trim_ws, ["  a b  "]) == ["a b"]
    assert eval_col(T.norm_key, [" Uttar Pradesh "]) == ["uttarpradesh"]
    assert eval_col(T.norm_name, [" Kanpur-Dehat "]) == ["kanpurdehat"]
    assert eval_col(T.repair_name, ["H|s>r @p-x"]) == ["hisarupx"]
    assert eval_col(lambda c: T.keep_directions(c, F.lit("delhi")), ["east", "eastern"]) == ["eastdelhi", "eastern"]
    assert eval_col(T.byte_length, [None, " कि ", "ab"]) == [0, 6, 2]
    assert eval_col(lambda c: T.preview(c, 3), [" abcdef"]) == ["abc"]
    assert eval_col(T.one_line, ["a\nb "]) == ["a b"]
    assert eval_col(T.tokens, ["", "a b"]) == [[], ["a", "b"]]
    assert eval_col(T.match_form, ["Hapur (Panchsheel)"]) == ["hapur  panchsheel"]


@pytest.mark.parametrize(
    "a,b,score",
    [("hissar", "hisar", 91), ("barddhaman", "bardhaman", 95), ("", "a", 0), ("a", "", 0), ("abcd", "wxyz", 0),
     ("kitten", "sitting", 62), ("abcde", "abcde", 100), ("कानपुर", "कानपुरा", 92)],
)
def test_ratio(spark, a, b, score):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(name_ratio(F.col("a"), F.col("b")).alias("s")).first()["s"] == score
