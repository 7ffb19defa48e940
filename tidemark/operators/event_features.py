"""Features of an event from the articles linked to it: counts, sets, likeness of its stories, confirmation, novelty, timing.

Of the articles that may be used at the decision time the first of each syndication root stands for its story. Stories of one
event are compared by pairs of blocks, so that an event with very many stories is dealt to many tasks; their likenesses are counted
by value before the median is taken. Events without an article keep the stated defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.storage import materialise

#: Stories of a block; two blocks of an event meet in one task.
BLOCK = 256
SECOND = 1_000_000
DAY = 86_400 * SECOND
WINDOWS = {"24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}


def clean(c: Column) -> Column:
    """White space runs as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def norm(c: Column) -> Column:
    """Lower-cased words of letters and digits, Latin and Hangul, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9가-힣]+", " "))


def word_set(c: Column) -> Column:
    """Distinct words of two letters or more."""
    return F.array_distinct(F.filter(F.split(norm(c), " "), lambda w: F.length(w) > 1))


def set_jaccard(a: str, b: str) -> Column:
    """0 where a set is empty; both sides use the shared words in any case, so that they are looked for once."""
    shared = F.size(F.array_intersect(F.col(a), F.col(b)))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def structured_kind() -> Column:
    """SEC, KIND, ISSUER_PR or empty, by the words of type, provider, class, publisher and URL."""
    names = ("source_type", "source_provider", "publisher_class", "publisher_canonical", "canonical_url")
    hay = F.concat_ws(" ", *[F.lower(clean(F.col(n))) for n in names])
    return (
        F.when(F.contains(hay, F.lit("sec.gov")) | hay.rlike(r"\b(sec|edgar)\b"), "SEC")
        .when(F.contains(hay, F.lit("kind.krx")) | F.contains(hay, F.lit("dart.fss")) | hay.rlike(r"\bkind\b"), "KIND")
        .when(F.contains(hay, F.lit("issuer")) | F.contains(hay, F.lit("official")), "ISSUER_PR")
        .otherwise("")
    )


def _rank_of(c: str, order: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in order.items():
        out = F.when(F.col(c) == name, rank).otherwise(out)
    return out


def representatives(articles: DataFrame) -> DataFrame:
    """The earliest usable article (ties: least id) of each event and root, with its word set; null times come last."""
    kept = articles.where("causal_t2_eligible AND canonical_event_id IS NOT NULL")
    first = kept.groupBy("canonical_event_id", "syndication_root_id").agg(
        F.min(F.struct(F.col("published_at").isNull().alias("late"), F.coalesce("published_at", F.lit(0)).alias("at"), F.col("article_uid").alias("uid"))).alias("first")
    )
    place = first.select(F.col("canonical_event_id").alias("event"), F.col("first.uid").alias("article_uid"))
    rows = kept.withColumn("event", F.col("canonical_event_id")).join(place, ["event", "article_uid"])
    rows = rows.withColumn("hw", word_set(F.col("headline"))).withColumn("bw", word_set(F.coalesce("body", F.lit(""))))
    derived = {"words": word_set(F.col("normalized_text")), "kind": structured_kind(), "headline_length": F.length("headline"), "body_length": F.length(F.coalesce("body", F.lit(""))), "headline_body": set_jaccard("hw", "bw")}
    kept_as_is = ["ticker", "origin_publisher", "publisher_class", "source_type", "primary_topic", "embedding", "embedding_model_revision", "published_at", "published_at_precision", "published_at_confidence", "first_seen_observed"]
    return rows.select("event", "article_uid", *kept_as_is, *[c.alias(n) for n, c in derived.items()])


def _value_stats(reps: DataFrame) -> DataFrame:
    """Per event what the counts of publishers, classes, topics and source types say."""
    fields = {"publisher": "origin_publisher", "class": "publisher_class", "topic": "primary_topic", "type": "source_type"}
    long = reps.select("event", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), clean(F.col(c)).alias("value")) for k, c in fields.items()])).alias("x")).select("event", "x.*")
    counts = long.groupBy("event", "field", "value").agg(F.count("*").alias("n"))
    is_ = lambda k: F.col("field") == k
    known = F.col("value") != ""
    named = lambda k: F.to_json(F.array_sort(F.collect_set(F.when(is_(k) & known, F.col("value")))))
    total = F.sum(F.when(is_("publisher"), F.col("n")))
    spread = F.sum(F.when(is_("publisher"), F.col("n") * F.log(F.col("n"))))
    of_topics = lambda names: F.coalesce(F.sum(F.when(is_("topic") & F.col("value").isin(*names), F.col("n"))), F.lit(0))
    pairs = F.array_sort(F.collect_list(F.when(is_("class"), F.struct("value", "n"))))
    as_json = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["value"], F.lit('":'), p["n"].cast("string"))), ","), F.lit("}"))
    own = [F.coalesce(F.sum(F.when(is_("class") & (F.col("value") == c), F.col("n"))), F.lit(0)).alias(f"publisher_class_{c.lower()}_count_t2") for c in rules.PUBLISHER_CLASSES]
    has = lambda c: F.coalesce(F.max(is_("class") & (F.col("value") == c)), F.lit(False))
    conflict = F.least(of_topics(rules.POSITIVE_TOPICS), of_topics(rules.NEGATIVE_TOPICS))
    stories = F.sum(F.when(is_("topic"), F.col("n")))
    return counts.groupBy("event").agg(
        as_json.alias("publisher_class_counts_t2"),
        F.count(F.when(is_("publisher"), 1)).alias("unique_origin_publisher_count"),
        F.count(F.when(is_("class") & known, 1)).alias("unique_publisher_class_count"),
        F.greatest(F.log(total) - spread / total, F.lit(0.0)).alias("publisher_entropy"),
        F.count(F.when(is_("type") & known, 1)).alias("source_type_diversity"),
        *[has(c).alias(name) for c, name in (("WIRE", "wire_present"), ("MAJOR_FINANCIAL", "major_financial_present"), ("BIOTECH_SPECIALIST", "biotech_specialist_present"), ("ISSUER_OFFICIAL", "issuer_official_present"))],
        (F.max(F.when(is_("topic"), F.col("n"))) / stories).alias("topic_agreement_rate"),
        conflict.alias("topic_conflict_count"),
        (conflict / stories).alias("semantic_contradiction_proxy"),
        named("topic").alias("primary_topics_t2"),
        named("publisher").alias("origin_publishers_t2"),
        named("type").alias("source_types_t2"),
        *own,
    )


def _story_stats(reps: DataFrame, events: DataFrame) -> DataFrame:
    """Per event what each of its stories adds on its own."""
    timed = reps.join(events.select(F.col("canonical_event_id").alias("event"), "event_time"), "event")
    minutes = (F.col("published_at") - F.col("event_time")) / (60 * SECOND)
    count = lambda c: F.count(F.when(c, 1))
    kind = F.col("kind")
    first = F.struct(F.col("published_at").isNull(), F.coalesce("published_at", F.lit(0)), F.col("article_uid"))
    return timed.groupBy("event").agg(
        F.count("*").alias("independent_source_count_t2"),
        F.count_distinct("origin_publisher").alias("unique_publisher_count_t2"),
        F.count("*").alias("syndication_root_count_t2"),
        count(kind != "").alias("structured_confirmation_count_t2"),
        count(kind != "").alias("official_source_count_t2"),
        (count(kind == "ISSUER_PR") > 0).alias("issuer_pr_present_t2"),
        (count(kind == "SEC") > 0).alias("SEC_present_t2"),
        (count(kind == "KIND") > 0).alias("KIND_present_t2"),
        F.count("embedding").alias("embedding_article_count_t2"),
        (F.count("embedding") / F.count("*")).alias("embedding_coverage_t2"),
        F.min_by(clean(F.col("embedding_model_revision")), first).alias("embedding_model_revision"),
        F.min_by("ticker", first).alias("story_ticker"),
        F.avg(_rank_of("published_at_precision", rules.PRECISION_ORDER)).alias("published_time_precision_mean"),
        F.avg(_rank_of("published_at_confidence", rules.CONFIDENCE_ORDER)).alias("published_time_confidence_mean"),
        F.min(minutes).alias("minutes_from_event_to_publish_min"),
        F.max(minutes).alias("minutes_from_event_to_publish_max"),
        count(minutes <= 0).alias("published_pre_event_count"),
        count(minutes > 0).alias("published_post_event_count"),
        count(F.col("first_seen_observed")).alias("first_seen_known_count"),
        F.avg("headline_length").alias("headline_length_mean"),
        F.avg("body_length").alias("body_length_mean"),
        F.avg((F.col("body_length") > 0).cast("int")).alias("body_available_rate"),
        F.avg("headline_body").alias("headline_body_similarity_mean"),
    )


def story_pairs(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every two stories of an event once, as (event, a_*, b_*): words, embedding, kind; by pairs of blocks of stories."""
    sizes = reps.groupBy("event").agg(F.count("*").alias("stories"), (F.count("embedding") >= 2).alias("by_vector")).where("stories > 1")
    many = F.ceil(F.col("stories") / block)
    rows = reps.select("event", "article_uid", "words", "embedding", "kind").join(sizes, "event")
    rows = rows.withColumn("blocks", many).withColumn("own", F.pmod(F.xxhash64("article_uid"), F.col("blocks")))
    side = lambda p: [F.col(n).alias(f"{p}_{n}") for n in ("article_uid", "words", "embedding", "kind")]
    left = rows.select("event", "by_vector", *side("a"), F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"))
    right = rows.select("event", *side("b"), F.explode(F.expr("sequence(0L, own)")).alias("i"), F.col("own").alias("j"))
    return left.join(right, ["event", "i", "j"]).where("i < j OR a_article_uid < b_article_uid").drop("i", "j")


def _pair_stats(reps: DataFrame, block: int) -> DataFrame:
    """Per event mean, median and least likeness of its stories, and the greatest between an official story and another one."""
    pairs = story_pairs(reps, block)
    dot = F.aggregate(F.zip_with("a_embedding", "b_embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = F.when(dot > 1, 1.0).when(dot < -1, -1.0).otherwise(dot)  # null where a vector is missing
    words = set_jaccard("a_words", "b_words")
    mixed = (F.col("a_kind") == "") != (F.col("b_kind") == "")
    scored = pairs.select("event", F.when(F.col("by_vector"), cosine).otherwise(words).alias("likeness"), F.when(mixed, words).alias("confirmed"))
    counted = scored.groupBy("event", "likeness").agg(F.count("*").alias("n"), F.max("confirmed").alias("confirmed"))
    mean = F.sum(F.col("likeness") * F.col("n")) / F.sum(F.when(F.col("likeness").isNotNull(), F.col("n")))
    return counted.groupBy("event").agg(
        F.max("confirmed").alias("structured_text_similarity"),
        mean.alias("mean_pairwise_similarity"),
        F.expr("percentile(likeness, 0.5D, n)").alias("median_similarity"),
        F.min("likeness").alias("minimum_similarity"),
    )


def _novelty(reps: DataFrame, articles: DataFrame, events: DataFrame, stories: DataFrame) -> DataFrame:
    """Per event the greatest likeness of its stories to earlier articles of the ticker that belong to other events."""
    longest = max(WINDOWS.values())
    own = stories.select("event", clean(F.col("story_ticker")).alias("ticker")).where("ticker <> ''")
    times = events.select(F.col("canonical_event_id").alias("event"), "event_time")
    now = reps.select("event", "words").join(own, "event").join(times, "event").withColumn("cell", F.floor(F.col("event_time") / longest))
    before = articles.where("published_at IS NOT NULL").select(clean(F.col("ticker")).alias("ticker"), clean(F.col("canonical_event_id")).alias("other"), "published_at", word_set(F.col("normalized_text")).alias("old"))
    cell = F.floor(F.col("published_at") / longest)
    before = before.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    near = now.join(before, ["ticker", "cell"]).where(f"other <> event AND published_at < event_time AND published_at >= event_time - {longest}")
    near = near.select("event", "published_at", "event_time", set_jaccard("words", "old").alias("like"))
    return near.groupBy("event").agg(*[F.max(F.when(F.col("published_at") >= F.col("event_time") - span, F.col("like"))).alias(f"similarity_to_prior_{name}") for name, span in WINDOWS.items()])


#: Columns that are null without stories; all other numbers are 0, flags false, sets empty.
_NULLABLE = {
    "structured_text_similarity", "mean_pairwise_similarity", "median_similarity", "minimum_similarity", "embedding_coverage_t2", "topic_agreement_rate",
    "published_time_precision_mean", "published_time_confidence_mean", "minutes_from_event_to_publish_min", "minutes_from_event_to_publish_max",
    "headline_length_mean", "body_length_mean", "body_available_rate", "headline_body_similarity_mean", *[f"similarity_to_prior_{w}" for w in WINDOWS],
}


def event_features(events: DataFrame, articles: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per event. Times are whole microseconds.

    ``events``: canonical_event_id (a unique string), event_group_id, market, ticker, event_time, decision_cutoff. ``articles``: article_uid
    (unique), canonical_event_id, ticker, syndication_root_id, causal_t2_eligible, quality_tier, origin_publisher, publisher_class,
    publisher_canonical, canonical_url, source_type, source_provider, primary_topic, normalized_text, headline, body, embedding (array or
    null), embedding_model_revision, published_at, published_at_precision, published_at_confidence, first_seen_observed.

    With two embeddings or more an event's stories are compared by cosine, those with an embedding alone; otherwise by their words. An
    unknown precision or confidence counts as 0; a null body is empty; stories without a time count in no timing column. Novelty looks at
    articles of the ticker of the earliest story; without one all three likenesses are null and the story is novel.
    """
    reps = materialise(representatives(articles), "stories")
    stories = _story_stats(reps, events)
    tiers = articles.where("canonical_event_id IS NOT NULL").groupBy(F.col("canonical_event_id").alias("event")).agg(
        *[F.count(F.when(F.col("causal_t2_eligible") & (F.col("quality_tier") == t), 1)).alias(n) for t, n in (("A", "tierA_article_count_t2"), ("B_FULL", "tierB_article_count_t2"), ("B_FULL", "tierBFull_article_count_t2"))],
        F.count(F.when(F.col("quality_tier") == "B_HEADLINE", 1)).alias("tierBHeadline_article_count_t2"),
    )
    parts = [tiers, stories, _value_stats(reps), _pair_stats(reps, block), _novelty(reps, articles, events, stories)]
    out = events.select(F.col("canonical_event_id").alias("event"), "event_group_id", "market", "ticker", "event_time", "decision_cutoff")
    for part in parts:
        out = out.join(part, "event", "left")
    known = F.col("independent_source_count_t2").isNotNull()
    filled = []
    for part in parts:
        for field in part.schema.fields[1:]:
            default = {"string": F.lit("[]"), "boolean": F.lit(False), "double": F.lit(0.0)}.get(field.dataType.simpleString(), F.lit(0))
            default = {"publisher_class_counts_t2": F.lit("{}"), "embedding_model_revision": F.lit("")}.get(field.name, default)
            if field.name != "story_ticker":
                filled.append(F.col(field.name) if field.name in _NULLABLE else F.coalesce(field.name, default).alias(field.name))
    like = F.col("similarity_to_prior_30d")
    recycled = F.when(~known, "NO_CAUSAL_ARTICLE").when(like >= 0.85, "NEAR_DUPLICATE_PRIOR_NEWS").when(like >= 0.55, "MINOR_UPDATE_OR_REPUBLICATION").otherwise("NOVEL_STORY")
    return out.select(
        F.col("event").alias("canonical_event_id"), "event_group_id", "market", "ticker", "event_time", "decision_cutoff", *filled,
        (1 - F.col("mean_pairwise_similarity")).alias("semantic_dispersion"),
        F.col("mean_pairwise_similarity").isNotNull().alias("semantic_consensus_available"),
        F.when(F.coalesce("embedding_article_count_t2", F.lit(0)) >= 2, "MULTILINGUAL_E5_COSINE").otherwise("TOKEN_JACCARD_FALLBACK").alias("semantic_similarity_method"),
        F.coalesce(like >= 0.85, F.lit(False)).alias("near_duplicate_prior_news"),
        recycled.alias("news_recycling_class"),
        F.col("event").alias("market_context_join_key"),
        F.col("event").alias("model_agreement_join_key"),
    )


def event_clusters(events: DataFrame, articles: DataFrame) -> DataFrame:
    """One row per event: its articles in all windows and those usable, the sets of roots, articles and topics as JSON."""
    as_set = lambda c: F.to_json(F.array_sort(F.collect_set(F.col(c).cast("string"))))
    linked = articles.groupBy("canonical_event_id").agg(
        F.count("*").alias("article_count_all_windows"), F.count(F.when(F.col("causal_t2_eligible"), 1)).alias("causal_article_count_t2"),
        as_set("syndication_root_id").alias("syndication_root_ids"), as_set("article_uid").alias("article_uids"), as_set("primary_topic").alias("topics"),
    )
    out = events.select("canonical_event_id", "event_group_id").join(linked, "canonical_event_id", "left")
    return out.fillna(0, ["article_count_all_windows", "causal_article_count_t2"]).fillna("[]", ["syndication_root_ids", "article_uids", "topics"])
