"""Event features on hand-made rows; the registered query is compared with its SQL in test_queries."""

from pyspark.sql import functions as F

from tidemark.operators import event_features as ef

MIN = 60 * ef.SECOND
EVENTS = "canonical_event_id string, event_group_id string, market string, ticker string, event_time bigint, decision_cutoff bigint"
ARTICLES = (
    "article_uid string, canonical_event_id string, ticker string, syndication_root_id string, causal_t2_eligible boolean, quality_tier string, origin_publisher string, publisher_class string, "
    "publisher_canonical string, canonical_url string, source_type string, source_provider string, primary_topic string, normalized_text string, headline string, body string, embedding array<float>, "
    "embedding_model_revision string, published_at bigint, published_at_precision string, published_at_confidence string, first_seen_observed boolean"
)


def article(uid, event, root, text, at, ok=True, tier="A", pub="P", cls="WIRE", kind="news", topic="OTHER", vec=None, ticker="T"):
    return (uid, event, ticker, root, ok, tier, pub, cls, pub, "http://x", kind, "feed", topic, text, text, "", vec, "", at, "EXACT_SECOND", "HIGH", True)


def frames(spark, events, articles):
    return spark.createDataFrame(events, EVENTS), spark.createDataFrame(articles, ARTICLES)


def test_defaults_representatives_and_confirmation(spark):
    t = 100 * ef.DAY
    events = [(e, "g", "US", "T", t, t + 2 * MIN) for e in ("none", "unusable", "two", "later")]
    rows = [
        article("u1", "unusable", "r0", "x", t, ok=False, tier="B_HEADLINE"),
        article("b", "two", "r1", "alpha beta gamma", t - MIN, pub="P", topic="RECALL"),
        article("a", "two", "r1", "copy that came second", t, pub="Q"),
        article("c", "two", "r2", "alpha beta delta", t + MIN, pub="P", cls="ISSUER_OFFICIAL", kind="issuer feed", topic="FDA_APPROVAL", tier="B_FULL"),
        article("d", "later", "r3", "alpha beta gamma", None, pub=""),
    ]
    got = {r["canonical_event_id"]: r for r in ef.event_features(*frames(spark, events, rows)).collect()}
    none, unusable, two, later = (got[e] for e in ("none", "unusable", "two", "later"))
    assert none["news_recycling_class"] == unusable["news_recycling_class"] == "NO_CAUSAL_ARTICLE"
    assert none["publisher_class_counts_t2"] == "{}" and none["primary_topics_t2"] == "[]" and none["mean_pairwise_similarity"] is None and none["publisher_entropy"] == 0
    assert unusable["tierBHeadline_article_count_t2"] == 1 and none["tierBHeadline_article_count_t2"] == 0
    assert two["tierA_article_count_t2"] == 2 and two["tierB_article_count_t2"] == 1 and two["independent_source_count_t2"] == 2
    assert two["publisher_class_counts_t2"] == '{"ISSUER_OFFICIAL":1,"WIRE":1}' and two["unique_origin_publisher_count"] == 1
    assert two["mean_pairwise_similarity"] == two["median_similarity"] == two["structured_text_similarity"] == 0.5
    assert two["issuer_pr_present_t2"] and not two["SEC_present_t2"] and two["topic_conflict_count"] == 1 and two["semantic_contradiction_proxy"] == 0.5
    assert (two["minutes_from_event_to_publish_min"], two["minutes_from_event_to_publish_max"], two["published_pre_event_count"], two["published_post_event_count"]) == (-1, 1, 1, 1)
    # The story of another event was published a minute before this one; a story without a time counts in no timing column.
    assert later["similarity_to_prior_24h"] == 1 and later["news_recycling_class"] == "NEAR_DUPLICATE_PRIOR_NEWS"
    assert later["minutes_from_event_to_publish_min"] is None and later["published_pre_event_count"] == 0
    assert two["similarity_to_prior_30d"] is None and two["news_recycling_class"] == "NOVEL_STORY"


def test_vectors_take_the_place_of_words(spark):
    rows = [article("a", "e", "r1", "same words", 5, vec=[1.0, 0.0]), article("b", "e", "r2", "same words", 6, vec=[0.6, 0.8]), article("c", "e", "r3", "same words", 7)]
    row = ef.event_features(*frames(spark, [("e", "g", "US", "T", 9, 9)], rows)).first()
    assert row["semantic_similarity_method"] == "MULTILINGUAL_E5_COSINE" and row["embedding_article_count_t2"] == 2
    assert abs(row["mean_pairwise_similarity"] - 0.6) < 1e-7 and abs(row["minimum_similarity"] - 0.6) < 1e-7


def test_many_stories_by_blocks(spark):
    """An event of 60 stories gives the same by blocks of 4 as in one, and every pair once."""
    rows = [article(f"a{i}", "big", f"r{i}", " ".join(f"w{j}" for j in range(i % 13, i % 13 + 9)), i, kind="SEC" if i % 5 == 0 else "news") for i in range(60)]
    rows += [article("z", "small", "q", "w1 w2", 3)]
    events, articles = frames(spark, [("big", "g", "US", "T", 99, 99), ("small", "g", "US", "T", 99, 99)], rows)
    pairs = ef.story_pairs(ef.representatives(articles), block=4)
    assert pairs.count() == pairs.select(F.array_sort(F.array("a_article_uid", "b_article_uid"))).distinct().count() == 60 * 59 // 2
    assert sorted(ef.event_features(events, articles, block=4).collect()) == sorted(ef.event_features(events, articles).collect())
