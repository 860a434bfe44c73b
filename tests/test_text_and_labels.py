import pytest
from pyspark.sql import functions as F

from tallyloom.functions import rules
from tallyloom.functions import text as tx
from tallyloom.operators import labels as lb
from tallyloom.operators import language as se


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


CONTENT = [
    ("how to style these samba", ["tutorial_utility"]),
    ("bts on set today", []),
    ("bts workshop craftsmanship how it's made", ["story_heritage"]),
    ("", []),
    (None, []),
]


def test_content_types(spark):
    assert column(spark, [c for c, _ in CONTENT], lb.content_types) == [want for _, want in CONTENT]


@pytest.mark.parametrize(("caption", "there"), [("adidas x diesel capsule drop", True), ("box is 10 x 10 cm", False), ("essentials #createdwithadidas @adidas created with", True), ("a x b", False), ("été × hiver", True)])
def test_collaboration(spark, caption, there):
    assert ("collaboration" in column(spark, [caption], lb.content_types)[0]) == there


def test_mechanics(spark):
    got = column(spark, ["this is viral", "check this #viral clip", "trending viral edit", "#trendalert"], lb.social_mechanics)
    assert [("trend" in x) for x in got] == [False, True, True, True] and got[0] == []


def test_promo_is_no_cta(spark):
    from tallyloom.operators.features import with_cta

    r = with_cta(spark.createDataFrame([("50% off today only",), ("shop now",), (None,)], "caption_raw string")).collect()
    assert [(x.has_promo, x.has_cta) for x in r] == [(True, False), (False, True), (False, False)]


TAXONOMY = [
    (["adidasoriginals", "adidassamba"], "", ["originals_apparel", "samba"], ["shoes", "apparel"]),
    (["nikeshoes", "nikeoutfit"], "", [], ["shoes", "apparel"]),
    ([], "love this sneaker pair", [], ["shoes"]),
    (["nike"], "", [], ["uncategorized"]),
    (["ootd", "fashion", "streetwear"], "", [], ["uncategorized"]),
    (["ootd", "jacket"], "", [], ["apparel"]),
    (["ootd", "sneakers"], "", [], ["shoes"]),
]


def test_taxonomy(spark):
    t = rules.load("taxonomy")
    df = spark.createDataFrame([(i, tags, c) for i, (tags, c, _, _) in enumerate(TAXONOMY)], "i int, tags array<string>, c string")
    lines = lb.product_lines(F.col("tags"), t)
    got = df.select("i", lines.alias("l"), lb.product_categories(lines, F.col("tags"), F.col("c"), t).alias("k")).orderBy("i").collect()
    assert [(r.l, r.k) for r in got] == [(a, b) for *_, a, b in TAXONOMY]


def test_styles_are_a_union(spark):
    df = spark.createDataFrame([("new foam cushioning technology", ["nikerunning"])], "c string, t array<string>")
    assert df.select(lb.brand_styles(F.col("c"), F.col("t"), rules.load("taxonomy"))).first()[0] == ["performance", "technical"]


def test_clean_caption_and_tags(spark):
    assert column(spark, ["  Hello   #nike  https://x.com/a  ", None], tx.clean_caption) == ["hello", ""]
    df = spark.createDataFrame([(["NikeFootball", "fyp"],)], "t array<string>")
    assert df.select(tx.cluster_tags(F.col("t"), ["nike", "adidas"], ["fyp"])).first()[0] == "football"
    scrub = lambda c: tx.scrub_for_clusters(c, ["nike", "adidas"], ["fyp"])
    assert column(spark, ["@adidas drop with @creator fyp nike shoes"], scrub) == ["drop with @creator shoes"]
    assert column(spark, ["#Привет мир #Ok"], tx.hashtags_in) == [["привет", "ok"]]


def test_phrase_forms(spark):
    hit = lambda c: tx.has_any(c, ["created with"])
    assert column(spark, ["was created with us", "#createdwithus", "createdwith", "recreatedwithal"], hit) == [True, True, True, False]


TOPICS = [("these sambas look fire but too expensive", "price_value"), ("sambas are super comfy", "fit_comfort"), ("[stickers]", "meme_chatter"), ("where can i find them", "availability"), ("nike tech is so ugly", "design_aesthetics"), ("", "other_unclear"), (None, "other_unclear"), ("@someone", "meme_chatter")]


def test_comment_topics(spark):
    assert column(spark, [t for t, _ in TOPICS], lambda c: lb.comment_topics(c, rules.load("topics"))["topic"]) == [w for _, w in TOPICS]


def test_partner_rules(spark):
    df = spark.createDataFrame([("alien", "??", "Acme"), ("celebrity", "HIGH", "Nike"), (None, None, " ")], "partner_type string, confidence string, partner_name string")
    got = [tuple(r) for r in lb.normalize_partner(df, ["celebrity", "none"], ["high"], {"nike": "nike"}).collect()]
    assert got == [("other", "unclear", "Acme"), ("none", "high", None), ("other", "unclear", None)]


def test_sentiment_routing(spark):
    df = spark.createDataFrame([("en", 0.9, "love it", False), ("en", 0.5, "love it", False), ("de", 0.9, "sehr schön heute", False), ("de", 0.9, "gut", False), ("und", 0.0, "??", False), ("en", 0.9, "🔥", True)], "lang string, c double, t string, e boolean")
    off = df.select(*[c.alias(n) for n, c in se.route_sentiment(F.col("lang"), F.col("c"), F.col("t"), F.col("e"), False).items()]).collect()
    assert [(r.sentiment_method, r.translation_status) for r in off] == [("lexicon_en", "not_applicable"), ("not_scored", "not_applicable"), ("not_scored_non_en", "pending"), ("not_scored_non_en", "pending"), ("not_scored", "not_applicable"), ("not_scored", "not_applicable")]
    on = df.select(*[c.alias(n) for n, c in se.route_sentiment(F.col("lang"), F.col("c"), F.col("t"), F.col("e"), True, F.lit("very nice today")).items()]).collect()
    assert [r.translation_status for r in on] == ["not_applicable", "not_applicable", "done", "skipped", "not_applicable", "not_applicable"]


def test_lexicon_score(spark):
    good, better, turned, none = column(spark, ["good", "very good", "not good", "table"], se.lexicon_score)
    assert 0 < good < better < 1 and turned < 0 and none == 0


def test_emoji_only(spark):
    flags = lambda n: (lambda c: se.script_flags(c)[n])
    assert column(spark, ["🔥🔥 ❤️", "ok 🔥", ""], flags("is_emoji_only")) == [True, False, False]
    assert column(spark, ["hello мир", "hello"], flags("has_mixed_script")) == [True, False]


def test_language_profiles_learn_from_all_rows(spark, tmp_path):
    from tallyloom.plans.q_labels import QUERIES

    rows = [(2 * k + 1, f"il gatto rosso siede sul tappeto {k}", "it") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert all("it" in tuple(r) for r in QUERIES["se03_detect_language"](spark, str(tmp_path)).collect())
