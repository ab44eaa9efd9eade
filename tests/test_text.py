import pytest
from pyspark.sql import functions as F

from layerlab.functions import text as X
from layerlab.functions.fixed_values import EMOTICONS, EMOTICONS_SHORT


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first()[0]


@pytest.mark.parametrize(
    ("raw", "alnum"),
    [
        ("Hi :)", "hi happy"),
        (":))", "happy"),
        (":-((", "sad"),
        ("a >= b", "a more thanequal b"),
        ("x == y", "x equalequal y"),
        ("http://x", "httpconfusionx"),
        ("XD :D", "xd d"),
        (":-\\", "confusion"),
        ("it's l'été", "its lt"),
        ("a\tb\n  c d", "a b c d"),
        (None, ""),
        ("", ""),
        ("  Wow!!  ok, yes?  ", "wow ok yes"),
    ],
)
def test_clean_alnum(spark, raw, alnum):
    assert one(spark, raw, X.clean_text_alnum) == alnum


def test_clean_keeps_sentence_marks(spark):
    assert one(spark, "Wow!! (ok), yes? e.g. :)", X.clean_text_keep_punct) == "wow!! ok, yes? e.g. happy"


def test_short_table_leaves_comparisons(spark):
    assert one(spark, "a>b :)", lambda c: X.replace_emoticons(c, EMOTICONS_SHORT)) == "a>b happy"
    assert len(EMOTICONS) == 25 and len(EMOTICONS_SHORT) == 18


def test_upper_case_keys_match_without_lowering(spark):
    assert one(spark, "XD", X.replace_emoticons) == "laugh"


def test_emoji_names(spark):
    names = {"😸": "grinning_cat", "🤣": "rofl", "👍🏽": "thumbs_medium", "👍": "thumbs"}
    fn = lambda c: X.emoji_to_name(c, names)
    assert one(spark, "ha😸😸ha🤣", fn) == "ha:grinning_cat::grinning_cat:ha:rofl:"
    assert one(spark, "👍🏽👍", fn) == ":thumbs_medium::thumbs:"
    assert one(spark, "plain ☃ text", fn) == "plain ☃ text"
    clean = lambda c: X.clean_text_alnum(c, emoji=names)
    assert one(spark, "ok 😸🤣", clean) == "ok grinningcatrofl"
    apart = lambda c: X.clean_text_alnum(c, emoji=names, separate=True)
    assert one(spark, "ok 😸🤣", apart) == "ok grinningcat rofl"


def test_emoji_sequences_and_flags(spark):
    names = {"👩": "woman", "💻": "laptop", "👩\u200d💻": "technologist", "🇫🇷": "flag_fr", "🇫🇮": "flag_fi", "❤": "heart"}
    fn = lambda c: X.emoji_to_name(c, names)
    assert one(spark, "👩\u200d💻👩💻", fn) == ":technologist::woman::laptop:"
    assert one(spark, "🇫🇮🇫🇷", fn) == ":flag_fi::flag_fr:"
    keep = lambda c: X.clean_text_keep_punct(c, emoji=names)
    # a joiner or a selector that belongs to no key is dropped with the other marks
    assert one(spark, "Hi, ❤\ufe0f 👩\u200d👩!", keep) == "hi, heart womanwoman!"
    assert one(spark, "🇫🇷 oui", lambda c: X.clean_text_alnum(c, emoji=names)) == "flagfr oui"
    assert one(spark, None, keep) == ""


def test_emoji_rule_table():
    names = X.emoji_names_by_rule()
    assert names["😀"] == "grinning_face" and len(names) > 1000


def test_tokens_and_stop_words(spark):
    text = "The cat, a dog_1 é été I'm 42 the"
    assert one(spark, text, X.tokenize_words) == ["the", "cat", "dog_1", "été", "42", "the"]
    kept = one(spark, text, lambda c: X.remove_stop_words(X.tokenize_words(c), ["the"]))
    assert kept == ["cat", "dog_1", "été", "42"]
    assert one(spark, None, X.tokenize_words) == []
