import pytest
from pyspark.sql import functions as F

from chronoloom.functions import perception as P
from chronoloom.functions import text as X
from tests.conftest import rows


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("What are you looking at?", "see_question"), ("who are you", "identity"), ("Hello there", "greeting"), ("Look to the left", "statement"), ("look LEFT please", "look_command"),
        ("where's the gate", "look_at_thing"), ("thanks a lot", "thanks"), ("Did you notice how it moved away", "yesno_question"), ("why is that", "wh_question"), ("good bye", "farewell"),
        ("the lamp fell behind it", "unknown"), ("", "statement"), (None, None), ("what did you hear", "hear_question"),
    ],
)
def test_intents(spark, text, want):
    assert one(spark, text, X.intent) == want


def test_names_and_referents(spark):
    assert one(spark, "Hey, Bea  Con!", lambda c: X.is_addressed(c, (r"bea\s*con",))) and not one(spark, "a con", lambda c: X.is_addressed(c, (r"bea\s*con",)))
    assert one(spark, "please look at the old Gate please", X.referent) == "old gate"
    assert one(spark, "where's a lamp", X.referent) == "lamp" and one(spark, "no", X.referent) is None
    assert one(spark, "the windows", X.thing_key) == "window" and one(spark, "glass", X.thing_key) == "glass" and one(spark, "light strip", X.thing_key) == one(spark, "Light-strips", X.thing_key)
    assert tuple(one(spark, "the windows on the left", X.spatial_split)) == ("left", "windows")
    assert tuple(one(spark, "leftmost windows", X.spatial_split)) == ("leftmost", "windows")
    assert tuple(one(spark, "Gate", X.spatial_split)) == (None, "Gate")
    assert [tuple(one(spark, t, X.anaphor)) for t in ("it again", "that gate", "the left one", "red gate", "")] == [("pronoun", None), ("det", "gate"), ("one", "left"), (None, None), (None, None)]
    assert one(spark, "left", X.base_name) is None and one(spark, "leftmost windows", X.base_name) == "windows"
    assert one(spark, "a b c", X.prefixes) == ["a b c", "a b", "a"]
    assert one(spark, "I see.\nLOOK: Left", X.trailing_command) == "left" and one(spark, "LOOK left", X.trailing_command) is None
    assert one(spark, "/a/b/c.mp4", X.base_path) == "c.mp4"
    assert one(spark, "cat", X.prompt_for) == "a photo of a cat"


def test_phonetic_keys(spark):
    key = lambda w: one(spark, w, X.phonetic_key)
    assert key("their") == key("there") and key("night") == key("knight") and key("marvel") == key("marble")
    assert key("42") == "" and key("calm") != key("marvel") and key("write") == key("rite")


def test_modeled_reading(spark):
    df = spark.createDataFrame([([" Hello", " Wold,", " yes"], 1, "world")], "w array<string>, i int, a string")
    assert df.select(X.modeled_reading(F.col("w"), F.col("i"), F.col("a")).alias("x")).first()["x"] == "Hello World, yes"
    lead, core, tail = one(spark, '"word!"', X.punctuation_split)
    assert (lead, core, tail) == ('"', "word", '!"')


def test_regions_and_scales(spark):
    r = lambda x, y: spark.range(1).select(X.region(F.lit(x), F.lit(y)).alias("r")).first()["r"]
    assert [r(10.0, 10.0), r(112.0, 112.0), r(112.0, 200.0), r(200.0, 112.0)] == ["upper left", "center", "lower", "right"]
    v = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert v(P.clip(F.lit(float("nan")), 0.0, 1.0)) == 0.0 and v(P.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert v(P.finite(F.lit(float("inf")))) == 0.0
    assert v(P.darkness_gain(F.lit(0.0))) == 3.0 and v(P.darkness_gain(F.lit(0.5))) == 1.0
    assert v(P.pan_of_levels(F.lit(1.0), F.lit(1e-9))) == -1.0
    assert v(P.pan_to_column(F.lit(float("nan")))) == 28.0
    assert v(X.config_hash(b=F.lit(1), a=F.lit("x"))) == v(X.config_hash(a=F.lit("x"), b=F.lit(1)))


def test_names_and_anaphors_of_the_tables_against_plain_python(spark, data):
    import re

    from chronoloom.plans import text_queries as Q

    norm = lambda t: re.sub(r"[^a-z\s]", "", t.lower(), flags=re.ASCII)

    def split(t):
        n = re.sub("^the ", "", norm(t))
        words = n.split()
        if words and words[0] in X.SELECTORS:
            return words[0], " ".join(words[1:])
        if m := re.search(X.SIDE, n):
            return m[1], n[: m.start()].strip(" ")
        return None, t

    def key(t):
        bare = re.sub(r"^(the|a|an)\s+", "", norm(t).strip(" "))
        return (bare[:-1] if re.search(r"(?:^|[^s])s$", bare) else bare).replace(" ", "")

    def anaphor(t):
        w = norm(t).split()
        if w and w[0] in X.PRONOUNS:
            if len(w) == 1 or len(w) == 2 and w[1] == "again":
                return "pronoun", None
            return ("det", " ".join(w[1:])) if w[0] in ("that", "this") else (None, None)
        rest = w[1:] if w[:1] == ["the"] else w
        return ("one", rest[0]) if len(rest) == 2 and rest[1] == "one" and rest[0] in X.ONE_SIDES else (None, None)

    said = Q._segs(spark, data).filter("text is not null").collect()
    names = [(x["run_id"], x["seg_id"], *split(x["text"]), key(split(x["text"])[1]), None if x["text"] == "" or norm(x["text"]) in X.DIRECTIONS else split(x["text"])[1]) for x in said]
    assert rows(Q.segment_names(spark, data)) == sorted(names, key=repr)
    assert said and rows(Q.segment_anaphors(spark, data)) == sorted(((x["run_id"], x["seg_id"], *anaphor(x["text"])) for x in said), key=repr)
