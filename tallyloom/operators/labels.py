"""Rule-based labels over lower-cased text: phrase rules, taxonomy cascade, comment topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as rule_files
from ..functions import text as tx


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def in_order(hits: Column, order: list[str]) -> Column:
    """The labels that were hit, in a fixed order."""
    return F.filter(_strings(order), lambda x: F.array_contains(hits, x))


# --- content types and mechanics --------------------------------------------------------------


def heritage_rule(text: Column, rule: dict, found: Column) -> Column:
    """Strong phrases; a behind-the-scenes phrase only with context; else pairs or two weak phrases."""
    rest = {k: rule.get(k, []) for k in ("pairs", "weak")}
    return F.when(tx.any_found(found, rule.get("strong", [])), True).when(tx.any_found(found, rule.get("triggers", [])), tx.any_found(found, rule.get("context", []))).otherwise(tx.match_rule(text, rest, found=found))


def names_crossed(text: Column) -> Column:
    """A x B with two characters or more on both sides, unless both are numbers."""
    side = r"([\p{L}\p{N}_]+)"
    left, right = (F.regexp_extract_all(text, F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_]){side} [x×] {side}"), F.lit(i)) for i in (1, 2))
    crossed = F.exists(F.arrays_zip(left.alias("l"), right.alias("r")), lambda p: (F.length(p["l"]) >= 2) & (F.length(p["r"]) >= 2) & ~(p["l"].rlike("^[0-9]+$") & p["r"].rlike("^[0-9]+$")))
    return F.when(F.contains(text, F.lit(" x ")) | F.contains(text, F.lit(" × ")), crossed).otherwise(False)


def rule_labels(caption: Column, rules: dict, single_tag: bool = False) -> Column:
    """All labels whose rule matches, in the rule file's order; [] for blank text."""
    def labels(text: Column, found: Column) -> Column:
        hits = []
        for label in rules["order"]:
            rule = rules["labels"][label]
            match = heritage_rule(text, rule, found) if "triggers" in rule else tx.match_rule(text, rule, single_tag, found)
            if label == "collaboration":
                match = match | names_crossed(text)
            hits.append(F.when(match, F.lit(label)))
        return F.array_compact(F.array(*hits))

    phrases = [p for label in rules["order"] for p in tx.rule_phrases(rules["labels"][label])]
    return tx.once(F.lower(F.coalesce(caption, F.lit(""))), lambda text: tx.once(tx.phrases_found(text, phrases), lambda found: labels(text, found)))


def content_types(caption: Column, rules: dict | None = None) -> Column:
    return rule_labels(caption, rules or rule_files.load("content"))


def social_mechanics(caption: Column, rules: dict | None = None) -> Column:
    return rule_labels(caption, rules or rule_files.load("mechanics"), single_tag=True)


def one_hot(df: DataFrame, col: str, labels: list[str], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{x}": F.coalesce(F.array_contains(col, x), F.lit(False)) for x in labels})


# --- taxonomy ---------------------------------------------------------------------------------


def brand_styles(caption: Column, tags: Column, taxonomy: dict) -> Column:
    """Styles that a tag stands for or a keyword gives evidence of, in fixed order."""
    text = F.lower(F.concat_ws(" ", F.coalesce(caption, F.lit("")), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")))
    by_tag = F.array_compact(F.transform(tags, lambda t: _lookup(taxonomy["style_of_tag"], t)))
    by_word = F.array_compact(F.array(*[F.when(tx.has_any(text, w), F.lit(s)) for s, w in taxonomy["style_words"].items()]))
    return in_order(F.array_union(by_tag, by_word), taxonomy["styles"])


def product_lines(tags: Column, taxonomy: dict) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(tags, lambda t: _lookup(taxonomy["line_of_tag"], t)))))


def product_categories(lines: Column, tags: Column, caption: Column, taxonomy: dict) -> Column:
    """Categories of the lines, else of the tags, else of caption words, else uncategorized; the first layer with any wins."""
    order = taxonomy["categories"]
    of_lines = in_order(F.array_compact(F.transform(lines, lambda x: _lookup(taxonomy["category_of_line"], x))), order)
    some = lambda names: F.arrays_overlap(tags, _strings(names))
    of_tags = in_order(F.array_union(F.array_compact(F.transform(tags, lambda t: _lookup(taxonomy["category_of_tag"], t))), F.array_compact(F.array(F.when(some(taxonomy["apparel_tags"]), F.lit("apparel")), F.when(some(taxonomy["accessory_tags"]), F.lit("accessories"))))), order)
    text = F.lower(F.coalesce(caption, F.lit("")))
    of_words = F.array_compact(F.array(*[F.when(tx.has_any(text, taxonomy["category_words"].get(c, [])), F.lit(c)) for c in order]))
    return F.when(F.size(of_lines) > 0, of_lines).when(F.size(of_tags) > 0, of_tags).when(F.size(of_words) > 0, of_words).otherwise(_strings(["uncategorized"]))


def display_lines(lines: Column, brand: Column, taxonomy: dict) -> Column:
    """Lines of the post's own brand that aren't broad."""
    return F.filter(lines, lambda x: (_lookup(taxonomy["brand_of_line"], x) == brand) & ~F.array_contains(_strings(taxonomy["broad_lines"]), x))


def with_labels(df: DataFrame, caption: str = "caption_raw", tags: str = "hashtags") -> DataFrame:
    """content_type, social_mechanic, brand_styles, product_lines and product_categories."""
    taxonomy = rule_files.load("taxonomy")
    clean = tx.clean_tags(F.col(tags))
    df = df.withColumns({"content_type": content_types(F.col(caption)), "social_mechanic": social_mechanics(F.col(caption)), "brand_styles": brand_styles(F.col(caption), clean, taxonomy), "product_lines": product_lines(clean, taxonomy)})
    return df.withColumn("product_categories", product_categories(F.col("product_lines"), clean, F.col(caption), taxonomy))


def refresh_report(df: DataFrame, caption: str = "caption_raw") -> DataFrame:
    """Recomputed label columns as counts: column, label, n, share of all rows."""
    fresh = df.select(content_types(F.col(caption)).alias("content_type"), social_mechanics(F.col(caption)).alias("social_mechanic"))
    total = fresh.agg(F.count("*").alias("_t"))
    long = fresh.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("labels")) for c in fresh.columns])).alias("x")).select("x.column", F.explode("x.labels").alias("label"))
    return long.groupBy("column", "label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")  # one row


def margin_gate(label: Column, margin: Column, least: float) -> dict[str, Column]:
    """label (null below the margin), label_likely (as given) and status."""
    ok = F.coalesce(margin >= least, F.lit(False))
    return {"label": F.when(ok, label), "label_likely": label, "status": F.when(label.isNull(), "missing").when(ok, "ok").otherwise("low_confidence")}


ACRONYMS = {"bts": "BTS", "pov": "POV", "ootd": "OOTD", "ugc": "UGC", "cta": "CTA", "grwm": "GRWM"}


def humanize(label: Column) -> Column:
    """snake_case to Title Case, acronyms in capitals, Unclassified for null."""
    words = F.transform(F.split(label, "_"), lambda w: F.coalesce(_lookup(ACRONYMS, w), F.initcap(w)))
    return F.coalesce(F.array_join(words, " "), F.lit("Unclassified"))


def drop_catch_all(label: Column, barred: tuple[str, ...] = ("other", "unknown", "none", "n/a")) -> Column:
    return F.when(~F.lower(F.trim(label)).isin(*barred), label)


def normalize_partner(df: DataFrame, kinds: list[str], confidences: list[str], focal: dict[str, str]) -> DataFrame:
    """Enum coercion of type and confidence; names of the focal brands (any alias) and blanks become no partner."""
    kind = F.lower(F.trim("partner_type"))
    kind = F.when(kind.isin(kinds), kind).otherwise("other")
    level = F.lower(F.trim("confidence"))
    name = tx.blank_to_null(F.col("partner_name"))
    own = F.coalesce(F.lower(name).isin(list(focal)), F.lit(False))
    kind = F.when(own, "none").otherwise(kind)
    return df.withColumns({"partner_type": kind, "confidence": F.when(level.isin(confidences), level).otherwise("unclear"), "partner_name": F.when(~own & (kind != "none"), name)})


def rule_misses(df: DataFrame, labels: str = "content_type", text: str = "caption_raw", least: int = 8) -> DataFrame:
    """Rows without a label but with usable text."""
    return df.where((F.coalesce(F.size(labels), F.lit(0)) == 0) & (F.length(tx.strip(F.coalesce(F.col(text), F.lit("")))) >= least))


# --- comment topics ---------------------------------------------------------------------------


def comment_topics(text: Column, topics: dict) -> Column:
    """A struct of a comment's primary topic and all its topics: layer first, then priority, then hits; chatter or unclear without any hit."""
    layer = {t["id"]: t["layer"] for t in topics["topics"]}
    rank = {x: i for i, x in enumerate(topics["layers"])}
    words = {topic: topics["words"][topic] for topic in topics["priority"] if topics["words"].get(topic)}
    phrases = [p for ps in words.values() for p in ps]

    def scored(hits: Column) -> Column:
        out = []
        for i, topic in enumerate(topics["priority"]):
            if topic in words:
                n = tx.count_found(hits, words[topic])
                out.append(F.when(n > 0, F.struct(F.lit(rank[layer[topic]]).alias("layer"), F.lit(i).alias("priority"), (-n).alias("hits"), F.lit(topic).alias("topic"))))
        return F.array_compact(F.array(*out))

    slang = topics.get("slang", [])

    def rest(low: Column) -> Column:
        """A text without any hit: chatter if it addresses somebody, or says nothing but slang or marks in brackets."""
        spoken = F.filter(F.split(F.regexp_replace(low, r"\[[^\]]*\]|[^\p{L}\p{N}@]", " "), " "), lambda w: w != "")
        addressed = F.exists(spoken, lambda w: w.rlike("^@."))
        plain = (F.length(F.array_join(spoken, "")) < 3) | F.forall(spoken, lambda w: w.isin(slang))
        return F.when((low != "") & (addressed | plain), "meme_chatter").otherwise("other_unclear")

    def all_topics(found: Column) -> Column:
        by = F.array_sort(F.transform(found, lambda x: F.struct(x["priority"].alias("p"), x["hits"].alias("h"), x["topic"].alias("topic"))))
        return F.struct(F.array_min(found)["topic"].alias("topic"), F.transform(by, lambda x: x["topic"]).alias("topics"))

    none = lambda low: tx.once(rest(low), lambda r: F.struct(r.alias("topic"), F.array(r).alias("topics")))
    either = lambda low, hits: F.when(F.size(hits) > 0, tx.once(scored(hits), all_topics)).otherwise(none(low))
    low = F.lower(tx.strip(F.coalesce(text, F.lit(""))))
    return tx.once(low, lambda t: tx.once(tx.phrases_found(t, phrases), lambda h: either(t, h)))


def comment_text(df: DataFrame, *candidates: str) -> Column:
    """First text that isn't blank: translated, cleaned, raw."""
    return tx.first_text(*[F.col(c) for c in candidates if c in df.columns])


def map_clusters(df: DataFrame, names: DataFrame, aliases: dict[str, str], cluster: str = "cluster_id") -> DataFrame:
    """topic of each cluster id (aliases resolved), other_unclear without one."""
    named = names.select(F.col("cluster_id").alias("_c"), F.coalesce(_lookup(aliases, F.lower("topic")), F.lower("topic")).alias("_t"))
    return df.join(named, F.col(cluster) == F.col("_c"), "left").withColumn("topic", F.coalesce("_t", F.lit("other_unclear"))).drop("_c", "_t")


def lexicon_examples(phrases: DataFrame, n: int = 3) -> DataFrame:
    """Per topic: phrases of several words first, then words of three letters or more, in their order."""
    rows = phrases.withColumn("several", F.col("phrase").contains(" ")).where("several or length(phrase) >= 3")
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("several"), "ord"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= n)
    return top.groupBy("topic", "layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]), ", ").alias("examples"))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
