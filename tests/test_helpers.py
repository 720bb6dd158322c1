"""Python-backed helpers checked against brute force on small fixtures."""
import itertools
import math

from pyspark.sql import functions as F

from textlab.operators.hashtags import segment_hashtags


def brute_segment(s, counts, total):
    def score(w):
        c = counts.get(w)
        return math.log10(c / total) if c else math.log10(10.0 / (total * 10 ** len(w)))
    best, arg = -math.inf, None
    for k in range(len(s)):
        for cuts in itertools.combinations(range(1, len(s)), k):
            parts = [s[i:j] for i, j in zip((0, *cuts), (*cuts, len(s)))]
            v = sum(score(p) for p in parts)
            if v > best:
                best, arg = v, parts
    return arg


def test_segmentation_matches_brute_force(spark):
    from textlab.operators.hashtags import segment_tags
    counts = {"hate": 50, "speech": 40, "is": 200, "bad": 30, "ha": 5, "te": 3, "sp": 1, "pneumonoultramicroscopicsilico": 2}
    total = sum(counts.values())
    tags = ["hatespeech", "isbad", "hatesp", "xyz", "speechisbad", "ispneumonoultramicroscopicsilico"]
    texts = [" ".join([w] * c) for w, c in counts.items()] + [f"#{t}" for t in tags]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.tag[1:]: r.segmented.split(" ") for r in segment_tags(df).collect()}
    assert all(got[t] == brute_segment(t, counts, total) for t in tags[:5])
    assert got[tags[5]] == ["is", "pneumonoultramicroscopicsilico"]  # no bound on a word's length


def test_segment_hashtags_rewrites_text(spark):
    texts = ["hate speech is bad", "speech is free", "stop #HateSpeech now", "no tags here", "#isbad!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")
    out = {r.row_id: r.text for r in segment_hashtags(df).collect()}
    assert out[2] == "stop hate speech now"
    assert out[3] == "no tags here"
    assert out[4] == "is bad"


def test_emoji_words(spark):
    from textlab.functions.emoji import emoji_to_text
    df = spark.createDataFrame([("hi\U0001F600 ok",)], "t string")
    assert df.select(emoji_to_text("t")).first()[0] == "higrinning face ok"
    assert df.select(emoji_to_text("t", "tokens")).first()[0] == "hi grinning_face  ok"


def test_emoji_sequences_get_one_name(spark):
    from textlab.functions.emoji import emoji_to_text
    cases = [("\U0001F44D\U0001F3FD", " thumbs_up_sign_emoji_modifier_fitzpatrick_type-4 "), ("\U0001F1E7\U0001F1F7", " flag_br "),
             ("\U0001F1E7\U0001F1F7\U0001F1E7", " flag_br  regional_indicator_symbol_letter_b "), ("#\uFE0F\u20E3 7", " keycap_#  7"),
             ("\u2600\uFE0F", " black_sun_with_rays "), ("\U0001F469\u200D\U0001F4BB", " woman_personal_computer "), ("1 # *", "1 # *"),
             ("a\n\u2600\nb", "a\n black_sun_with_rays \nb"), ("\uFE0F", "\uFE0F"), ("", ""), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r[1] for r in df.select("i", emoji_to_text("t", "tokens")).orderBy("i").collect()]
    assert got == [want for _, want in cases]


def test_whole_cleaners(spark):
    from textlab.operators.hashtags import baseline_clean, social_clean
    texts = ["hate speech is bad", "stop #HateSpeech @joe \U0001F600 &amp; http://x.y", "\u201cis\u201d #\u00d3dio #speech_is", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")
    got = {r.row_id: r.text for r in baseline_clean(df).collect()}
    assert got == {0: "hate speech is bad", 1: "stop hate speech <user> grinning face and <url>", 2: '" is " # dio speech is', 3: "", 4: ""}
    got = {r.row_id: r.text for r in social_clean(df).collect()}
    assert got[2] == "\u201c is \u201d \u00d3dio speech is" and got[3] == ""


def test_score_batches_matches_formula(spark):
    from textlab.operators.scoring import length_scorer_factory, score_batches
    df = spark.createDataFrame([(1, "abc"), (2, "x" * 10), (3, "")], "row_id long, text string")
    rows = {r.row_id: (r.pred, r.probs) for r in score_batches(df, length_scorer_factory).collect()}
    for rid, text in [(1, "abc"), (2, "x" * 10), (3, "")]:
        z = ((len(text) % 11) - 5) / 2.0
        p1 = math.exp(z) / (1 + math.exp(z))
        assert abs(rows[rid][1][1] - p1) < 1e-12 and rows[rid][0] == int(p1 > 0.5)


def test_emoji_oracle_matches_spark_on_emoji_text(spark):
    """The emoji SQL and the Spark function agree on awkward texts."""
    import duckdb

    from textlab.functions.emoji import emoji_to_text
    from textlab.plans.oracle import emoji_ctes
    texts = ["hi\U0001F600 ok", "\u2600:x_y-z: :a b:", "multi\nline \U0001F44D\U0001F3FD\U0001F44D", None, "", "9\u20E3 9 #*",
             "::", ":only", "tab\t:\U0001F600:\u3000x", "plain text", "\U0001F1E7\U0001F1F7\U0001F1E7x", "\u2764\uFE0F\u200D\U0001F525"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")
    got = {r.row_id: (r.words, r.tokens) for r in df.select(
        "row_id", emoji_to_text("text", "words").alias("words"), emoji_to_text("text", "tokens").alias("tokens")).collect()}
    con = duckdb.connect()
    con.register("src", df.toPandas())
    want = {r[0]: (r[1], r[2]) for r in con.execute(f"WITH {emoji_ctes('src')} SELECT row_id, words, tokens FROM named").fetchall()}
    assert got == want


def test_segment_oracle_matches_spark_on_real_tags(spark):
    """The segmentation SQL and the Spark operator agree on awkward tags."""
    import duckdb

    from textlab.plans.oracle import segment_ctes
    texts = ["hate speech is bad", "speech is free and bad", "stop #HateSpeech now", "no tags here",
             "#isbad! and #Stop_Hate", "#a#b x", "# lone", "#123abc #xyzzyplugh", None, "",
             "is is is hate speech stop now free", "#speechisbadnow\n#HATE"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")
    got = {r.row_id: r.text for r in segment_hashtags(df).collect()}
    con = duckdb.connect()
    con.register("src", df.toPandas())
    tag = r"#[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{3000}]+"
    want = {r[0]: r[1] for r in con.execute(f"WITH RECURSIVE {segment_ctes('src', tag)} SELECT row_id, text FROM segmented").fetchall()}
    assert got == want
    assert got[2] == "stop hate speech now" and got[11] == "speech is bad now\nhate"


def test_selected_model_is_scored_on_test(spark):
    from textlab.operators.scoring import select_model
    rows = [(i, "good fine nice" if i % 2 else "bad awful poor", i % 2) for i in range(24)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    wrong = df.where("row_id < 8").withColumn("label", F.expr("CASE WHEN row_id < 2 THEN 1 - label ELSE label END"))
    _, table = select_model(df, df, reg_params=(0.0, 0.1), max_iter=5, num_features=64, test=wrong)
    got = {r.config: r for r in table.collect()}
    assert got[0].selected and not got[1].selected and got[0].val_macro_f1 == 1.0
    assert abs(got[0].test_macro_f1 - 0.75) < 1e-12 and got[1].test_macro_f1 is None  # three of four right in each class
