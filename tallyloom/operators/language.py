"""Language profiles and lexicon sentiment, as expressions and aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as rule_files
from ..functions import text as tx

EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "arabic": r"\p{IsArabic}", "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}"}
METHODS = ["lexicon_en", "lexicon_via_mt", "not_scored", "not_scored_non_en"]


def detection_text(c: Column, brand_words: list[str] = ()) -> Column:
    """Text without URLs, mentions, tags and brand nouns, lower-cased."""
    low = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{tx.URL}|[@#]{tx.WORD}+", " "))
    if brand_words:
        low = F.array_join(F.filter(F.split(low, r"\s+"), lambda w: ~F.regexp_replace(w, r"[^\p{L}\p{N}]", "").isin(*brand_words)), " ")
    return tx.squeeze(low)


def script_flags(c: Column) -> dict[str, Column]:
    """is_emoji_only, has_mixed_script and has_non_latin_tag."""
    text = F.coalesce(c, F.lit(""))
    bare = F.regexp_replace(text, rf"(?:{EMOJI}|\s)+", "")
    scripts = sum((text.rlike(p).cast("int") for p in SCRIPTS.values()), F.lit(0))
    tags = F.array_join(tx.hashtags_in(text), " ")
    return {"is_emoji_only": (bare == "") & text.rlike(EMOJI), "has_mixed_script": scripts >= 2, "has_non_latin_tag": tags.rlike(r"[\p{L}&&[^\p{IsLatin}]]")}


def word_profiles(df: DataFrame, text: str, lang: str, top: int = 50) -> DataFrame:
    """(lang, word, weight): the most frequent words of each language and their share; its size is fixed by ``top``."""
    words = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= top)
    return ranked.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).select("lang", "word", "weight")


def detect_language(df: DataFrame, key: str, text: str, profiles: DataFrame, least: float = 0.0) -> DataFrame:
    """(key, lang, confidence): the language whose profile the words weigh most for; und without any profile word."""
    words = df.select(key, F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy(key, "word").agg(F.count("*").alias("uses"))
    scored = words.join(F.broadcast(profiles), "word").groupBy(key, "lang").agg(F.sum(F.col("uses") * F.col("weight")).alias("s"))
    best = scored.groupBy(key).agg(F.max(F.struct("s", F.col("lang"))).alias("b"), F.sum("s").alias("t")).select(key, F.col("b.lang").alias("lang"), (F.col("b.s") / F.col("t")).alias("confidence"))
    out = df.select(key).join(best, key, "left")
    ok = F.coalesce(F.col("confidence") >= least, F.lit(False))
    return out.select(key, F.when(ok, F.col("lang")).otherwise("und").alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def lexicon_score(c: Column, lexicon: dict | None = None) -> Column:
    """Compound score in [-1, 1]: word valences, boosted by the word before, turned by a negation within three words."""
    lexicon = lexicon or rule_files.load("sentiment")
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, float(v))])
    valence, boost = table(lexicon["words"]), table(lexicon["boosters"])
    negations = F.array(*[F.lit(x) for x in lexicon["negations"]])
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}']+"), lambda w: w != "")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

    def term(x):
        v = F.coalesce(F.try_element_at(valence, x["w"]), F.lit(0.0))
        before = F.slice(words, F.greatest(x["i"] - 2, F.lit(1)), F.least(x["i"], F.lit(3)))
        b = F.coalesce(F.try_element_at(boost, F.try_element_at(words, x["i"])), F.lit(0.0))
        b = F.when(x["i"] > 0, b).otherwise(0.0)
        turned = F.when((x["i"] > 0) & F.arrays_overlap(before, negations), float(lexicon["negation_factor"])).otherwise(1.0)
        return F.when(v == 0, 0.0).otherwise((v + F.signum(v) * b) * turned)

    total = F.aggregate(F.transform(placed, term), F.lit(0.0), lambda s, x: s + x)
    return total / F.sqrt(total * total + 15)


def route_sentiment(lang: Column, confidence: Column, text: Column, emoji_only: Column, mt: bool, translated: Column | None = None, sure: float = 0.8, least: int = 8) -> dict[str, Column]:
    """sentiment_method, translation_status and the text to score, by language, confidence, length and the switch for translation."""
    text = tx.strip(F.coalesce(text, F.lit("")))
    nothing = lang.isin("und", "mixed") | emoji_only | (text == "")
    english = (lang == "en") & (confidence >= sure)
    weak = (lang == "en") & (confidence < sure)
    short = F.length(text) < least
    translated = translated if translated is not None else F.lit(None).cast("string")
    bad = tx.blank_to_null(translated).isNull()
    method = F.when(nothing | weak, "not_scored").when(english, "lexicon_en")
    status = F.when(nothing | weak | english, "not_applicable")
    if not mt:
        return {"sentiment_method": method.otherwise("not_scored_non_en"), "translation_status": status.otherwise("pending"), "scored_text": F.when(~nothing & english, text)}
    method = method.when(short | bad, "not_scored_non_en").otherwise("lexicon_via_mt")
    status = status.when(short, "skipped").when(bad, "failed").otherwise("done")
    scored = F.when(nothing | weak, F.lit(None)).when(english, text).when(~short & ~bad, translated)
    return {"sentiment_method": method, "translation_status": status, "scored_text": scored}


def unusable_translation(source: Column, translated: Column) -> Column:
    """Blank, unchanged, an error page, or far longer than the source."""
    t = tx.blank_to_null(translated)
    return t.isNull() | (F.lower(t) == F.lower(F.trim(source))) | F.coalesce(F.lower(t).rlike("error 5\\d\\d|too many requests|<html"), F.lit(False)) | (F.length(t) > 10 * F.length(source) + 20)


def rescore_backlog(df: DataFrame, translate: Callable[[Column, Column], Column], limit: int | None, key: str = "comment_id") -> tuple[DataFrame, DataFrame]:
    """The table with up to ``limit`` rows of the untranslated backlog scored (lowest keys first), and counts by outcome."""
    backlog = df.where("sentiment_method = 'not_scored_non_en'")
    if limit is not None:
        backlog = backlog.orderBy(key).limit(limit)
    route = route_sentiment(F.col("lang"), F.lit(1.0), F.col("text"), F.lit(False), True, translate(F.col("text"), F.col("lang")))
    score = F.when(F.col("sentiment_method") == "lexicon_via_mt", lexicon_score(F.col("scored_text")))
    done = backlog.withColumns(route).withColumn("sentiment_score", score).select(*dict.fromkeys([*df.columns, "translation_status"]))
    rest = df.join(done.select(key), key, "left_anti")
    return rest.unionByName(done, allowMissingColumns=True), done.groupBy("translation_status").agg(F.count("*").alias("n"))


def audience(comments: DataFrame, key: str = "video_id", score: str = "sentiment_score") -> DataFrame:
    """Per video: scored comments, positive and negative share, net."""
    s = F.col(score)
    out = comments.where(s.isNotNull()).groupBy(key).agg(F.count("*").alias("scored"), F.avg((s >= 0.05).cast("int")).alias("positive"), F.avg((s <= -0.05).cast("int")).alias("negative"))
    return out.withColumn("net", F.col("positive") - F.col("negative"))
