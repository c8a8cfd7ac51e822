"""One query for each operator family, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import prompts, text
from termweave.operators import bm25, dense, evaluation, fusion, generation, hierarchy, jaccard, topk
from termweave.plans import adapters as a
from termweave.plans import pipeline
from termweave.sources import terminology
from termweave.sources.settled import settled

CONTEXT = ("c_mktsegment", "n_name")
METHODS = ("multi_match", "elastic_fuzzy", "jaccard")


def active_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    orders = a.table(spark, d, "orders").where(F.col("o_orderstatus") == "F").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    good = a.table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    return orders.join(good, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey", "o_orderpriority")


def short_terms_extract(spark: SparkSession, d: str) -> DataFrame:
    return terminology.short_terms(a.concepts(spark, d), a.descriptions(spark, d).where("term is not null"))


def definitions_extract(spark: SparkSession, d: str) -> DataFrame:
    return terminology.definitions(a.concepts(spark, d), a.texts(spark, d))


def isa_edges_extract(spark: SparkSession, d: str) -> DataFrame:
    return terminology.isa(a.places(spark, d), a.relationships(spark, d))


def raw_isa_edges(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.edges(a.relationships(spark, d))


def bm25_documents_build(spark: SparkSession, d: str) -> DataFrame:
    return terminology.bm25_documents(a.concepts(spark, d), a.descriptions(spark, d), a.texts(spark, d))


def combined_pool(spark: SparkSession, d: str) -> DataFrame:
    short = a.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("concept_id"), F.col("p_name").alias("description"))
    told = a.fielded(spark, d).select("concept_id", "definition").where("definition <> ''")
    return dense.combined_pool(short, told)


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"), text.plain(F.col("text"), False).alias("plain"))


def clean_text_stopwords(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "documents").select("doc_id", text.clean(F.col("text"), remove_stopwords=True).alias("cleaned"))


def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "part").select("p_partkey", F.explode(text.ngrams(text.clean(F.col("p_name")))).alias("ngram"))


def _people(spark: SparkSession, d: str) -> DataFrame:
    nation = a.table(spark, d, "nation").select("n_nationkey", "n_name")
    return a.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "c_mktsegment", "n_name")


def algorithm_texts(spark: SparkSession, d: str) -> DataFrame:
    made = prompts.semantic_inputs(_people(spark, d), "customer", "c_name", CONTEXT)
    m = F.col("algorithm_ai_metadata")
    return made.select("c_custkey", "algorithm_1_text", "algorithm_2_text", m["query_value"].alias("query_value"), F.array_join(m["context_columns"], ",").alias("context_columns"), m["context_values"]["n_name"].alias("nation"))


def ai_metadata_key(spark: SparkSession, d: str) -> DataFrame:
    return _people(spark, d).select("c_custkey", prompts.metadata_key("customer", "c_name", ("n_name", "c_mktsegment")).alias("key"))


def ai_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _people(spark, d).select("c_custkey", prompts.table_prompt("customer", "c_name", CONTEXT).alias("prompt"))


def few_shot_prompt(spark: SparkSession, d: str) -> DataFrame:
    made = prompts.messages(prompts.table_prompt("customer", "c_name", CONTEXT), prompts.table_examples("customer", "c_name", CONTEXT))
    return _people(spark, d).select("c_custkey", F.explode(F.slice(made, 2, 5)).alias("m")).select("c_custkey", "m.role", "m.content")


def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = _people(spark, d).select(F.col("c_custkey").alias("sample_index"), F.col("c_name").alias("test_name"), F.col("c_mktsegment").alias("spec_type_desc"))
    grid = generation.experiment_grid(rows, "test_name", ("spec_type_desc",), ("model-a", "model-b"))
    return grid.select("sample_index", "query_value", "prompt_type", "shot_type", "model", "prompt", F.col("n_messages").cast("long").alias("n_messages"))


def template_texts(spark: SparkSession, d: str) -> DataFrame:
    made = prompts.semantic_inputs(_people(spark, d), "customer", "c_name", CONTEXT)
    return made.select("c_custkey", generation.template().alias("ai_text"))


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return topk.sample_rows(a.table(spark, d, "events"), F.col("event_id"), 50, 7).select("event_id", "user_id", "event_type")


def distinct_query_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct name is looked up once and given back to all its rows."""
    parts = a.table(spark, d, "part")
    found = parts.where("p_name is not null").groupBy("p_name").agg(F.count(F.lit(1)).alias("n_rows"), F.min("p_partkey").alias("first_part"))
    return parts.select("p_partkey", "p_name").join(found, "p_name", "left").select("p_partkey", "p_name", "n_rows", "first_part")


def jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    parts = a.table(spark, d, "part")
    found = jaccard.match(parts, parts, "p_name", "p_name", "p_partkey", 5, 3, text.clean)
    return found.select("query", F.col("rank").cast("long").alias("rank"), "concept_id", "term", F.round("jaccard_score", 6).alias("jaccard_score"))


def ngram_postings(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.candidate_postings(a.table(spark, d, "part"), "p_name", "p_partkey", 3, text.clean)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "embeddings")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    found = dense.match_blocks(v.where("vec_id % 100 = 0"), v, "vec_id", "vec_id", "embedding", 5, skip_self=True)
    return found.select("query_id", "pool_id", "similarity", F.col("rank").cast("long").alias("rank"))


def dense_topk_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    found = dense.match_pairs(v.where("vec_id % 100 = 0"), v, "vec_id", "vec_id", "embedding", 5, skip_self=True)
    return found.select("query_id", "pool_id", "similarity", F.col("rank").cast("long").alias("rank"))


def dense_topk_combined_source(spark: SparkSession, d: str) -> DataFrame:
    """Search of a pool of two sources, with the source of each match."""
    v = _vectors(spark, d)
    tagged = v.select("vec_id", "embedding", F.when(F.col("label") % 2 == 0, "short_term").otherwise("definition").alias("source"))
    found = dense.match_blocks(v.where("vec_id % 100 = 0"), tagged, "vec_id", "vec_id", "embedding", 5)
    return found.join(tagged.select(F.col("vec_id").alias("pool_id"), "source"), "pool_id").select("query_id", "pool_id", "similarity", F.col("rank").cast("long").alias("rank"), "source")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = bm25.multi_match(a.items(spark, d), bm25.build_index(a.fielded(spark, d)), "query", 5)
    return found.select("query", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _typos(spark: SparkSession, d: str) -> DataFrame:
    """Part names whose first word has lost its third letter."""
    return a.table(spark, d, "part").select(F.regexp_replace("p_name", "^(..).", "$1").alias("query")).distinct()


def fuzzy_topk(spark: SparkSession, d: str) -> DataFrame:
    pool = a.table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("doc_id")).select("doc_id", F.col("p_name").alias("term"), F.lit("").alias("definition"))
    found = bm25.fuzzy_match(_typos(spark, d), bm25.build_index(pool), "query", 5)
    return found.select("query", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def ancestors_depth_k(spark: SparkSession, d: str) -> DataFrame:
    starts = a.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("concept_id"))
    return hierarchy.ancestors_few_hops(starts, a.geography(spark, d), 3).select("concept_id", "ancestor", F.col("distance").cast("long").alias("distance"))


def ancestors_all(spark: SparkSession, d: str) -> DataFrame:
    """Hop by hop, proper ancestors only."""
    starts = a.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("concept_id"))
    return hierarchy.ancestors(starts, a.geography(spark, d, False), 5, False).select("concept_id", "ancestor", F.col("distance").cast("long").alias("distance"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier with the next one and with its own nation."""
    s = a.table(spark, d, "supplier")
    me = F.concat(F.lit("s"), "s_suppkey").alias("a")
    return s.select(me, F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("b")).union(s.select(me, F.concat(F.lit("n"), "s_nationkey")))


def common_ancestors(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.common_ancestors(_pairs(spark, d), a.geography(spark, d, False), 3)
    return found.select("a", "b", "ancestor", *[F.col(c).cast("long").alias(c) for c in ("distance_a", "distance_b", "total_distance", "rank")])


def nearest_common_ancestor(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.nearest_common_ancestor(_pairs(spark, d), a.geography(spark, d, False), 3)
    return found.select("a", "b", "ancestor", F.col("total_distance").cast("long").alias("total_distance"))


def related_pairs_common(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.related(_pairs(spark, d), a.geography(spark, d, False), 1)


def related_pairs_lineage(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.related(_pairs(spark, d), a.geography(spark, d, False), 2, "lineage")


def _matches(spark: SparkSession, d: str, methods: tuple[str, ...]) -> DataFrame:
    """Lexical methods' five best documents for every benchmark item, whole texts on both sides."""
    rows, docs = a.items(spark, d), a.fielded(spark, d)
    index = bm25.build_index(docs)
    names = docs.select("doc_id", "concept_id", F.col("term").alias("text"))
    whole = a.whole_documents(spark, d)
    makers = {
        "multi_match": lambda: bm25.multi_match(rows, index, "query", 5).join(names, "doc_id"),
        "elastic_fuzzy": lambda: bm25.fuzzy_match(rows, index, "query", 5).join(names, "doc_id"),
        "jaccard": lambda: jaccard.match_texts(rows, whole, "query", "term", "doc_id", 5, 3, text.clean).select("query", F.col("concept_id").cast("string").alias("concept_id"), F.col("term").alias("text"), "rank", F.round("jaccard_score", 6).alias("score")),
    }
    out = None
    for method in methods:
        part = makers[method]().select("query", F.lit(method).alias("method"), "rank", "concept_id", "text", "score")
        out = part if out is None else out.unionByName(part)
    return settled(rows.join(out, "query").select("row_id", "query", "method", "rank", "concept_id", "text", "score"))


EXACT = ("multi_match", "jaccard")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """The matches of the two methods that SQL can give as well."""
    return _matches(spark, d, EXACT)


def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    return fusion.comparison(a.items(spark, d), _matches(spark, d, EXACT), EXACT)


def method_comparison_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The same with typo-tolerant matches."""
    return fusion.comparison(a.items(spark, d), _matches(spark, d, METHODS), METHODS)


def vote_aggregation(spark: SparkSession, d: str) -> DataFrame:
    v = fusion.votes(_lists(spark, d), 3, EXACT)
    return v.select("row_id", "concept_id", F.col("points").cast("long").alias("points"), F.array_join("methods", ",").alias("methods"), F.col("ord").cast("long").alias("ord"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    c = fusion.clusters(fusion.votes(_lists(spark, d), 5, EXACT), a.document_graph(spark, d).where("child not like 'lang:%' and parent not like 'lang:%'"), 1)
    return c.select("row_id", "concept_id", F.col("ord").cast("long").alias("ord"), F.col("cluster").cast("long").alias("cluster"))


def _source_graph(spark: SparkSession, d: str) -> DataFrame:
    return a.document_graph(spark, d).where("child not like 'lang:%' and parent not like 'lang:%'")


def cluster_common_ancestor(spark: SparkSession, d: str) -> DataFrame:
    c = fusion.clusters(fusion.votes(_lists(spark, d), 5, EXACT), _source_graph(spark, d), 1)
    found = fusion.cluster_ancestors(c, _source_graph(spark, d), 2)
    return found.select("row_id", F.col("cluster").cast("long").alias("cluster"), "ancestor", *[F.col(x).cast("long").alias(x) for x in ("total_distance", "max_distance")])


def consensus_topk(spark: SparkSession, d: str) -> DataFrame:
    best = fusion.consensus(_lists(spark, d), _source_graph(spark, d), 5, 6, 1, EXACT)
    return best.select("row_id", F.col("rank").cast("long").alias("rank"), "concept_id", "source", *[F.col(x).cast("long").alias(x) for x in ("cluster_points", "concept_points", "n_methods")])


def consensus_summary(spark: SparkSession, d: str) -> DataFrame:
    best = fusion.consensus(_lists(spark, d), _source_graph(spark, d), 5, 6, 1, EXACT)
    final = fusion.final_candidates(a.items(spark, d), best, 5)
    return final.select("row_id", "test_name", "final_concept_id", "support_score", F.col("n_methods_agreeing").cast("long").alias("n_methods_agreeing"), F.array_join("agreeing_methods", ",").alias("agreeing_methods"), F.array_join("final_candidate_ids", ",").alias("final_candidate_ids"))


def valid_code_sets(spark: SparkSession, d: str) -> DataFrame:
    v = evaluation.valid_sets(_vectors(spark, d), "label", "vec_id")
    return v.select("code", F.array_join("valid", ",").alias("valid"))


def _truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as records whose valid concepts are the vectors of their label that are divisible by three."""
    v = _vectors(spark, d)
    rows = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("code"))
    found = dense.match_blocks(v.where("vec_id % 100 = 0"), v, "vec_id", "vec_id", "embedding", 5, skip_self=True)
    matches = found.select(F.col("query_id").alias("row_id"), F.lit("dense").alias("method"), "rank", F.col("pool_id").cast("string").alias("concept_id"))
    return rows, matches, evaluation.valid_sets(v.where("vec_id % 3 = 0"), "label", "vec_id")


def _vector_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges vector -> group of its number modulo 50 -> group modulo 10."""
    v = _vectors(spark, d).select("vec_id")
    low = v.select(F.col("vec_id").cast("string").alias("child"), F.concat(F.lit("g"), F.col("vec_id") % 50).alias("parent"))
    return low.union(v.select(F.concat(F.lit("g"), F.col("vec_id") % 50), F.concat(F.lit("h"), F.col("vec_id") % 10)).distinct())


def hit_at_k_strict(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.hits(*_truth(spark, d)).withColumn("k", F.col("k").cast("long"))


def hit_at_k_lineage(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.hits(*_truth(spark, d), isa=_vector_graph(spark, d), max_depth=2, mode="lineage").withColumn("k", F.col("k").cast("long"))


def hit_at_k_related(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.hits(*_truth(spark, d), isa=_vector_graph(spark, d), max_depth=1, mode="common_ancestor").withColumn("k", F.col("k").cast("long"))


def method_scores(spark: SparkSession, d: str) -> DataFrame:
    rows, matches, truth = _truth(spark, d)
    parts = [evaluation.rates(evaluation.hits(rows, matches, truth), "strict_hit"), evaluation.rates(evaluation.hits(rows, matches, truth, isa=_vector_graph(spark, d), max_depth=1, mode="common_ancestor"), "related_hit")]
    names = ("strict_hit@1", "strict_hit@5", "related_hit@1", "related_hit@5")
    wide = evaluation.score_table(parts, names, {"dense": "semantic"})
    return wide.select("method", "type", *[F.col(f"`{n}`").alias(n.replace("@", "_at_")) for n in names])


def _mapping(spark: SparkSession, d: str, methods: tuple[str, ...]) -> DataFrame:
    records = a.items(spark, d).withColumnRenamed("query", "diagnosis_text")
    docs = a.fielded(spark, d)
    whole = a.whole_documents(spark, d).select("concept_id", F.col("term").alias("description"))
    pools = pipeline.Pools(whole, docs.select("concept_id", "definition").where("definition <> ''"), docs, _source_graph(spark, d))
    cfg = pipeline.MappingConfig(table_path="items.csv", consensus_max_depth=1, methods=methods)
    final = pipeline.run(records, pools, cfg)["final_candidates"]
    return final.select("row_id", "test_name", "final_concept_id", "support_score", F.col("n_methods_agreeing").cast("long").alias("n_methods_agreeing"), F.array_join("final_candidate_ids", ",").alias("final_candidate_ids"))


def pipeline_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """The lexical methods over the benchmark items to the final candidates."""
    return _mapping(spark, d, EXACT)


def pipeline_all_methods(spark: SparkSession, d: str) -> DataFrame:
    """All six methods, with the built-in embedder and generator; their hashes are not SQL's."""
    return _mapping(spark, d, fusion.METHODS)


def generated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct record's text asked for once, of a generator that repeats the query value."""
    people = _people(spark, d)
    cfg = pipeline.MappingConfig(table_path="customer.csv", query_column="c_name", context_columns=CONTEXT, model=generation.echo)
    return pipeline.prepare(people.withColumn("row_id", F.col("c_custkey")), cfg).select("c_custkey", "ai_key", "algorithm_ai_text", "ai_error")


def experiment_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Prompt experiments asked of the same generator."""
    rows = a.table(spark, d, "customer").select(F.col("c_custkey").alias("sample_index"), F.col("c_name").alias("test_name"), F.col("c_mktsegment").alias("spec_type_desc"))
    models = ("model-a", "model-b")
    grid = generation.experiment_grid(rows, "test_name", ("spec_type_desc",), models)
    return generation.run_experiment(grid, generation.echo, models).select("sample_index", "prompt_type", "shot_type", "model", "ai_output")


def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return terminology.count_report(a.table(spark, d, "documents"))


NAMES = (
    "active_semi_filter short_terms_extract definitions_extract isa_edges_extract raw_isa_edges bm25_documents_build combined_pool clean_text "
    "clean_text_stopwords char_ngrams algorithm_texts ai_metadata_key ai_prompt few_shot_prompt experiment_grid template_texts seeded_sample "
    "distinct_query_lookup jaccard_topk ngram_postings dense_topk dense_topk_pairs dense_topk_combined_source bm25_topk fuzzy_topk "
    "ancestors_depth_k ancestors_all common_ancestors nearest_common_ancestor related_pairs_common related_pairs_lineage method_comparison method_comparison_fuzzy "
    "vote_aggregation clusters cluster_common_ancestor consensus_topk consensus_summary valid_code_sets hit_at_k_strict hit_at_k_lineage "
    "hit_at_k_related method_scores pipeline_end_to_end pipeline_all_methods generated_texts experiment_outputs null_counts"
).split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in NAMES}
