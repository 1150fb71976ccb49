"""Every query over the tables at hand: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import last_n, round_scaled, unit_dot
from ..functions.tables import stored
from ..operators import families, metrics, models, profiles, retrieval, splits
from . import relations as R

FROZEN = R.VALIDATION_START
CUTS = (1, 10, 20)


def _samples(spark, d):
    return R.samples(spark, d)


def sample_projection(spark, d):
    return R.samples(spark, d).withColumn("tags", F.array_join("tags", ","))


def impression_explode(spark, d):
    li = R.read(spark, d, "lineitem")
    lists = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("shown"), F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))).alias("clicked"))
    return splits.explode_impressions(lists, "shown", "clicked").select("l_orderkey", "position", "candidate_count", "item_id", "label")


def sample_validation(spark, d):
    return splits.validation_report(R.samples(spark, d))


def stable_negative(spark, d):
    li = R.read(spark, d, "lineitem")
    lists = li.groupBy(F.col("l_orderkey").alias("key")).agg(F.sort_array(F.collect_set("l_partkey")).alias("shown"), F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))).alias("clicked"))
    return splits.stable_negative(lists, "key", "shown", "clicked").select("key", "negative")


def temporal_split(spark, d):
    return R.with_split(R.samples(spark, d)).groupBy("split", "policy").agg(F.count("*").alias("n_rows"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


def quantile_split(spark, d):
    return splits.quantile_split(R.sequence(spark, d)).groupBy("split").agg(F.count("*").alias("n_rows"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


def popularity_scores(spark, d):
    x = models.popularity(R.with_split(R.samples(spark, d)))
    return x.where("split = 'test'").select("sample_id", F.round("score", 6).alias("score"))


def impression_metrics(spark, d):
    x = models.popularity(R.with_split(R.samples(spark, d))).where("split in ('validation', 'test')")
    return metrics.impression_metrics(x, ["split"])


def _scored_exposures(spark, d):
    return models.popularity(splits.quantile_split(R.exposures(spark, d)))


def binary_metrics(spark, d):
    return metrics.binary_metrics(_scored_exposures(spark, d), ["split"])


def policy_metrics(spark, d):
    return metrics.policy_metrics(_scored_exposures(spark, d).where("split = 'test'"))


def pit_user_item_counts(spark, d):
    from ..operators.pit import visible_sums

    x = R.exposures(spark, d)
    probes = x.select("sample_id", "user_id", "item_id", "timestamp")
    return visible_sums(x, probes, ["item_id"], {"seen": F.lit(1), "clicks": F.col("label")}, {**R.EVENT_WIDTHS, "all": None}).drop("user_id", "item_id", "timestamp")


def interaction_features(spark, d):
    return families.interaction_features(R.samples(spark, d), R.INTERVAL, R.DELAY, FROZEN)


def interaction_features_replay(spark, d):
    return families.interaction_features(R.samples(spark, d), R.INTERVAL, R.DELAY)


def long_term_profile(spark, d):
    return families.long_term_profile(R.samples(spark, d), R.INTERVAL, R.DELAY)


def relative_freshness(spark, d):
    return families.relative_freshness(R.samples(spark, d))


def candidate_ranks(spark, d):
    return families.candidate_ranks(R.samples(spark, d), ["read_time", "position"])


def session_exposure(spark, d):
    return families.session_exposure(R.samples(spark, d), R.ORDER_WIDTHS["30d"], R.ORDER_WIDTHS["90d"])


def past_exposure(spark, d):
    return families.past_exposure(R.samples(spark, d), {k: R.ORDER_WIDTHS[k] for k in ("7d", "30d")})


def past_exposure_momentum(spark, d):
    return families.past_exposure(R.exposures(spark, d), R.EVENT_WIDTHS, True)


def past_engagement(spark, d):
    return families.past_engagement(R.samples(spark, d), {k: R.ORDER_WIDTHS[k] for k in ("7d", "30d")})


def fixed_history(spark, d):
    x = R.samples(spark, d)
    old = x.where((F.col("timestamp") < FROZEN) & (F.col("label") == 1))
    hist = old.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "sample_id", "item_id"))), lambda e: e["item_id"]).alias("history"))
    items = R.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_brand").alias("category"))
    return families.fixed_history(x, hist, items)


def topic_affinity(spark, d):
    return families.topic_affinity(R.samples(spark, d), R.INTERVAL, R.DELAY)


def context_features(spark, d):
    x = R.with_split(R.samples(spark, d))
    return families.context_features(x, F.col("split") == "train")


def event_aggregates(spark, d):
    x = R.exposures(spark, d)
    probes = x.select("sample_id", "item_id", splits.cutoff(3_600_000, 60_000).alias("cut"))
    return families.event_aggregates(x.where("policy <> 'random'"), probes, "item_id", R.EVENT_WIDTHS)


def visible_history(spark, d):
    return families.visible_history(R.samples(spark, d), 5, R.INTERVAL, R.DELAY)


def retrieval_queries(spark, d):
    return retrieval.retrieval_queries(R.sequence(spark, d)).withColumn("history", F.array_join("history", ","))


def even_sampling(spark, d):
    return splits.even_sample(R.sequence(spark, d).select("event_id", "timestamp"), ["timestamp", "event_id"], 500).select("event_id", "timestamp")


def _train(spark, d, sequence=None):
    return splits.quantile_split(sequence or R.sequence(spark, d)).where("split = 'train'").drop("split")


def _queries(spark, d, sequence=None):
    q = stored(retrieval.retrieval_queries(sequence or R.sequence(spark, d)), "all-queries")
    return splits.quantile_split(q).where("split = 'test'").drop("split")


def _base(spark, d):
    """Events in order, those to learn from, and queries: written once, as all channels read them."""
    s = stored(R.sequence(spark, d), "sequence")
    return s, stored(_train(spark, d, s), "train"), stored(_queries(spark, d, s), "queries")


def hot_items(spark, d):
    return retrieval.hot_items(_train(spark, d))


def item_cf(spark, d):
    return retrieval.item_cf(_train(spark, d), 10)


def user_cf(spark, d):
    return retrieval.user_cf(_train(spark, d), 10, 10)


def _i2i(train, q, k=20):
    return retrieval.trigger_recall(q, retrieval.item_cf(train, 20), k)


def i2i_recall(spark, d):
    _, train, q = _base(spark, d)
    return _i2i(train, q)


def i2i_hot_recall(spark, d, base=None):
    _, train, q = base or _base(spark, d)
    return retrieval.fill_to_k(_i2i(train, q, 10), q, retrieval.hot_items(train), 20)


def retrieval_metrics(spark, d):
    base = _base(spark, d)
    return metrics.target_metrics(i2i_hot_recall(spark, d, base), base[2], 20)


def _transition(train, q, k=20):
    return retrieval.transition_recall(q, retrieval.transitions(train), k)


def transition_recall(spark, d):
    _, train, q = _base(spark, d)
    return _transition(train, q)


def transition_loso(spark, d):
    s, _, q = _base(spark, d)
    return retrieval.transition_recall(q, retrieval.transitions(s), 20, retrieval.transitions(s, True))


def _part_texts(spark, d):
    return R.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


def tfidf_recall(spark, d):
    return retrieval.tfidf_recall(_part_texts(spark, d), 10)


def content_i2i(spark, d):
    return retrieval.tfidf_recall(_part_texts(spark, d), 10, drop_self=False).select("query_id", "item_id", "score")


def bm25_recall(spark, d):
    p = R.read(spark, d, "part").withColumnRenamed("p_partkey", "id")
    q = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return retrieval.bm25_recall(q, p, {"p_name": 2.0, "p_type": 1.5, "p_brand": 0.5}, 10)


def dense_recall(spark, d):
    e = R.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense_recall(e.where("id % 50 = 0"), e, 10)


def embedding_presence(spark, d):
    e = R.read(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_ids"), F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim"), F.count_if(unit_dot("embedding", "embedding") > 0).alias("present"))


def new_items(spark, d):
    o = R.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    catalog = R.read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 10 != 0, F.date_add(F.lit("1992-01-01").cast("date"), (F.col("p_partkey") % 2000).cast("int"))).alias("release"))
    return retrieval.new_items(o, catalog, 10)


def _channels(spark, d):
    """The channels' lists and the queries."""
    _, train, q = _base(spark, d)
    hot = retrieval.hot_items(train).where("rank <= 20").select("item_id", "score", F.col("rank").cast("int").alias("rank"))
    hot_q = q.select("query_id").crossJoin(F.broadcast(hot))  # 20 rows
    return {"hot": hot_q, "i2i": _i2i(train, q), "transition": _transition(train, q)}, q


def rrf_fusion(spark, d):
    return retrieval.rrf(_channels(spark, d)[0], 20)


def weighted_fusion(spark, d):
    c, _ = _channels(spark, d)
    return retrieval.weighted_fusion({"hot": (c["hot"], 0.2), "i2i": (c["i2i"], 0.5), "transition": (c["transition"], 0.3)}, 20)


def top1_graft(spark, d):
    _, train, q = _base(spark, d)
    return retrieval.top1_graft(_i2i(train, q), _transition(train, q), 20)


def _pool(spark, d):
    """The candidates with their query's target, and the queries."""
    c, q = _channels(spark, d)
    return retrieval.candidate_pool(c).join(q.select("query_id", "target"), "query_id"), q


NAMES = ["rank_hot", "rank_i2i", "rank_transition"]


def candidate_pool(spark, d):
    return _pool(spark, d)[0]


def training_requests(spark, d):
    return retrieval.training_requests(_pool(spark, d)[0])


def request_summary(spark, d):
    return retrieval.request_summary(_pool(spark, d)[0])


def entity_affinity(spark, d):
    p = R.read(spark, d, "part").select((F.col("p_partkey") - 1).cast("string").alias("item_id"), F.col("p_brand").alias("entity"), F.split("p_type", " ").alias("tags"))
    pool, q = _pool(spark, d)
    return retrieval.entity_affinity(pool, q, p)


def channel_overlap(spark, d):
    return metrics.channel_overlap(_pool(spark, d)[0], NAMES)


def rank_metrics_ablation(spark, d):
    pool, q = _pool(spark, d)
    return metrics.channel_ablation(pool, NAMES, "query_id", "target", 20, q.count())


def exclusive_hits(spark, d):
    pool, q = _pool(spark, d)
    return metrics.exclusive_hits(pool, NAMES, "target", q.count())


def rank_metrics(spark, d):
    _, train, q = _base(spark, d)
    hit = _i2i(train, q).join(q.select("query_id", "target"), "query_id").where("item_id = target")
    return metrics.rank_metrics(hit, "rank", CUTS, q.count())


def catalog_diversity(spark, d):
    return metrics.catalog_diversity(i2i_recall(spark, d), R.exposures(spark, d).select("item_id").distinct())


def lexical_diversity(spark, d):
    return metrics.lexical_diversity(R.read(spark, d, "conversations").where("role = 'assistant'"))


def leakage_free_views(spark, d):
    x = splits.leakage_free_views(R.read(spark, d, "conversations"), 8)
    return x.groupBy("conv_id", "target").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


def query_text(spark, d):
    c = R.read(spark, d, "conversations").where("role = 'user'")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    return c.dropDuplicates(["conv_id", "turn"]).select("conv_id", "turn", F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text")).over(w)), lambda e: e["text"]), " ").alias("query"))


def _commerce(spark, d):
    o, li, p = (R.read(spark, d, t) for t in ("orders", "lineitem", "part"))
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    action = F.when(F.col("l_returnflag") == "R", "click").when(F.col("l_returnflag") == "A", "collect").otherwise("buy")
    return x.select(F.col("o_custkey").alias("client_id"), action.alias("action"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("seconds"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("category"))


def profiles_v2(spark, d):
    clients = R.read(spark, d, "customer").select(F.col("c_custkey").alias("client_id"))
    return profiles.profile(_commerce(spark, d), clients, R.TEST_START // 1000)


def category_hist(spark, d):
    return profiles.category_histogram(_commerce(spark, d))


def label_flags(spark, d):
    clients = R.read(spark, d, "customer").select(F.col("c_custkey").alias("client_id"))
    return profiles.label_flags(clients, _commerce(spark, d).where(f"action = 'buy' and seconds >= {R.TEST_START // 1000}"))


def profiles_v1(spark, d):
    x = _commerce(spark, d).where(F.col("seconds") < R.TEST_START // 1000)
    clients = R.read(spark, d, "customer").select(F.col("c_custkey").alias("client_id"))
    at = R.TEST_START // 1000
    agg = x.groupBy("client_id").agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("seconds") / 86400)).alias("days"), F.count_distinct("category").alias("cats"), F.max("seconds").alias("last"), F.count_if(F.col("seconds") >= at - 30 * 86400).alias("n30"))
    y = clients.join(agg, "client_id", "left")
    cols = {"event_count": F.col("n"), "event_active_days": F.col("days"), "event_unique_category_count": F.col("cats"), "event_recency_seconds": at - F.col("last"), "event_count_30d": F.col("n30")}
    return y.select("client_id", *[F.round(F.log1p(F.coalesce(v, F.lit(0))), 6).alias(k) for k, v in cols.items()])


def aligned_vectors(spark, d):
    ids = R.read(spark, d, "documents").select("doc_id")
    e = R.read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    x = profiles.aligned(ids, e, "doc_id", "embedding", 64)
    return x.select("doc_id", "missing", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"))


def user_folds(spark, d):
    u = R.exposures(spark, d).select("user_id").distinct()
    return splits.user_folds(u)


def fold_sizes(spark, d):
    u = splits.user_folds(R.exposures(spark, d).select("user_id").distinct())
    return R.exposures(spark, d).join(u, "user_id").groupBy("fold", "part").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_users"))


def first_wins(spark, d):
    x = R.exposures(spark, d).select("user_id", "item_id", "timestamp", "sample_id")
    return splits.first_wins(x, ["user_id", "item_id"], ["timestamp", "sample_id"])


def title_fallback(spark, d):
    p = R.read(spark, d, "part").select("p_partkey", "p_name")
    e = R.read(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), F.lit(True).alias("present"))
    return p.join(e, "p_partkey", "left").select("p_partkey", F.when(F.col("present"), "").otherwise(F.col("p_name")).alias("title"))


def word2vec_recall(spark, d):
    return retrieval.word2vec_recall(_train(spark, d), _queries(spark, d), 10)


NUMERIC, CATEGORICAL = ["position", "candidate_count", "read_time"], ["category", "scene", "device_type"]


def _model(spark, d, name):
    x = R.with_split(R.samples(spark, d)).where("split is not null").fillna({"scroll_percentage": 0.0})
    if name != "gbt":  # trees draw the rows for their bins by partition, so another layout gives other trees
        # Written once: each pass of a fit would join the tables anew.
        x = stored(x.select("sample_id", "group_id", "label", "split", *NUMERIC, *CATEGORICAL), "model-rows")
    out = models.scored(x, models.fitted(x, name, NUMERIC, CATEGORICAL))
    return out.where("split = 'test'").select("sample_id", "group_id", "label", "score")


def lr_scores(spark, d):
    return _model(spark, d, "lr")


def fm_scores(spark, d):
    return _model(spark, d, "fm")


def gbt_scores(spark, d):
    return _model(spark, d, "gbt")


def history_mean_recall(spark, d):
    e = R.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    means = retrieval.history_means(_queries(spark, d).select(F.col("query_id").alias("id"), "history"), e, 5)
    return retrieval.dense_recall(means, e, 10, other_ids=True)


def group_ndcg(spark, d):
    x = models.popularity(R.with_split(R.samples(spark, d))).where("split = 'test'")
    return metrics.group_ndcg(x).select("group_id", F.col("first_hit").cast("int").alias("first_hit"), "ndcg")


def one_class_groups(spark, d):
    return metrics.one_class_groups(R.samples(spark, d))


def greedy_ablation(spark, d):
    pool, q = _pool(spark, d)
    return metrics.greedy_channels(pool, NAMES, "query_id", "target", 20, q.count())


def source_split(spark, d):
    x = splits.source_split(R.exposures(spark, d), F.col("policy") == "random")
    return x.groupBy("split").agg(F.count("*").alias("n_rows"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


def split_audit(spark, d):
    return splits.split_audit(R.with_split(R.samples(spark, d)), ["sample_id", "group_id", "user_id", "item_id"])


def prediction_coverage(spark, d):
    _, train, q = _base(spark, d)
    return splits.prediction_faults(_i2i(train, q), q, 20)


def vocabulary_size(spark, d):
    lists = R.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"), F.collect_set("l_suppkey").alias("suppliers"))
    return splits.vocabulary_size(lists, "parts", "suppliers")


def period_history(spark, d):
    x = R.samples(spark, d).where(F.col("timestamp") >= FROZEN)
    clicks = R.samples(spark, d).where("label = 1")
    entry = F.struct("timestamp", "sample_id", "item_id")
    parts = [
        clicks.where(F.col("timestamp") < at).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["item_id"]).alias("history")).withColumn("period", F.lit(p))
        for p, at in enumerate((FROZEN, R.TEST_START))
    ]
    out = splits.period_snapshot(x, parts[0].unionByName(parts[1]), (F.col("timestamp") >= R.TEST_START).cast("int"))
    return out.select("sample_id", "period", F.size("history").alias("n_history"), F.array_contains("history", F.col("item_id")).alias("seen"))


def popular_channel(spark, d):
    return retrieval.popular(retrieval.hot_items(_train(spark, d)))


def usable_vectors(spark, d):
    return profiles.usable_vectors(R.read(spark, d, "embeddings"), "vec_id", "embedding", 64)


def candidate_features(spark, d):
    c, _ = _channels(spark, d)
    x = models.candidate_features(retrieval.candidate_pool(c), c)
    floats = [f.name for f in x.schema if f.dataType.typeName() == "double"]
    return x.withColumns({f: round_scaled(f, 4) for f in floats})


def streaming_exposure(spark, d):
    from ..streaming.exposure import windowed_counts

    return windowed_counts(spark, d)


ALL = [
    sample_projection, impression_explode, sample_validation, stable_negative, temporal_split, quantile_split, popularity_scores, impression_metrics, binary_metrics, policy_metrics,
    pit_user_item_counts, interaction_features, interaction_features_replay, long_term_profile, relative_freshness, candidate_ranks, session_exposure, past_exposure, past_exposure_momentum,
    past_engagement, fixed_history, topic_affinity, context_features, event_aggregates, visible_history, retrieval_queries, even_sampling, hot_items, item_cf, user_cf, i2i_recall, i2i_hot_recall,
    retrieval_metrics, transition_recall, transition_loso, tfidf_recall, content_i2i, bm25_recall, dense_recall, embedding_presence, new_items, rrf_fusion, weighted_fusion, top1_graft, candidate_pool, training_requests, request_summary, entity_affinity,
    channel_overlap, rank_metrics_ablation, exclusive_hits, rank_metrics, catalog_diversity, lexical_diversity, leakage_free_views, query_text, profiles_v1, profiles_v2, category_hist, label_flags,
    aligned_vectors, user_folds, fold_sizes, first_wins, title_fallback, history_mean_recall, word2vec_recall, lr_scores, fm_scores, gbt_scores, streaming_exposure,
    group_ndcg, one_class_groups, greedy_ablation, source_split, split_audit, prediction_coverage, vocabulary_size, period_history, popular_channel, usable_vectors, candidate_features,
]


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def impression_relation(spark, d) -> DataFrame:
    """The mapped relation, for users of the package."""
    return _samples(spark, d)
