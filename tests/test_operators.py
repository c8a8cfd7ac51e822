"""Hand-worked cases, edge rows and invariants of the reference's operators."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F
from termweave.functions import prompts, text
from termweave.operators import bm25, dense, evaluation, fusion, generation, hierarchy, jaccard, topk
from termweave.plans import pipeline
from termweave.sources import sinks, terminology

EDGES = [("A", "X"), ("A", "Y"), ("B", "X"), ("X", "R"), ("Y", "R"), ("C", "Z")]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "child string, parent string")


def values(spark, expression, *cells, name="v", kind="string"):
    df = spark.createDataFrame([(c,) for c in cells], f"{name} {kind}")
    return [r[0] for r in df.select(expression).collect()]


def test_cleaning(spark):
    assert values(spark, text.clean(F.col("v")), "  Foo-Bar (disorder)\t", None, "!!!", "a b", '"q" NA') == ["foobar disorder", "", "", "a b", "q na"]
    assert values(spark, text.clean(F.col("v"), remove_stopwords=True), "Pain in the chest") == ["pain chest"]
    assert values(spark, text.clean_value(F.col("v")), "  x ", None) == ["x", ""]
    assert values(spark, text.plain(F.col("v")), " AB ") == ["ab"]


def test_ngrams(spark):
    assert values(spark, text.ngrams(F.col("v")), "banana", "ab", "", "abc") == [["ban", "ana", "nan"], ["ab"], [], ["abc"]]
    with pytest.raises(ValueError):
        text.ngrams(F.col("v"), 0)


def test_rounding_and_embedding(spark):
    assert values(spark, text.round_even(F.col("v")), 0.0625, 3.6666, kind="double") == [0.062, 3.667]
    a, b = values(spark, text.hashed_embedding(F.col("v"), 16), "heart attack", "")
    assert math.isclose(sum(x * x for x in a), 1.0, rel_tol=1e-5) and sum(map(abs, b)) == 0


def test_jaccard(spark):
    pool = spark.createDataFrame([("1", "cat scan"), ("2", "bananas"), ("3", "heart attacks"), ("4", "ab"), ("5", "abc"), ("6", None)], "id string, term string")
    queries = spark.createDataFrame([("cat",), ("banana",), ("heart attack",), ("ab",), ("",), (None,), ("ab",)], "q string")
    found = {(r.query, r.concept_id): r.jaccard_score for r in jaccard.match(queries, pool, "q", "term", "id").collect()}
    assert found == pytest.approx({("cat", "1"): 1 / 6, ("banana", "2"): 0.75, ("heart attack", "3"): 10 / 11, ("ab", "4"): 1.0})
    with pytest.raises(ValueError):
        jaccard.match(queries, pool, "q", "nothing", "id")
    with pytest.raises(ValueError):
        jaccard.match(queries, pool, "q", "term", "id", 0)
    with pytest.raises(ValueError):
        jaccard.postings(pool, "term", 0)


def test_jaccard_against_sets(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    grams = lambda w: {w} if len(w) < 3 else {w[i : i + 3] for i in range(len(w) - 2)}
    pool = spark.createDataFrame(list(enumerate(words)), "id long, term string")
    got = jaccard.match(pool, pool, "term", "term", "id", 4).collect()
    for q in set(words):
        scored = sorted(((-len(grams(q) & grams(w)) / len(grams(q) | grams(w)), i) for i, w in enumerate(words) if grams(q) & grams(w)))[:4]
        assert [r.concept_id for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == [i for _, i in scored]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "heart attack", None), (2, "heart", None)], "doc_id long, term string, definition string")
    queries = spark.createDataFrame([("attack",), (None,), ("???",)], "query string")
    rows = bm25.multi_match(queries, bm25.build_index(docs), k=5).collect()
    assert [(r.query, r.doc_id, r.rank) for r in rows] == [("attack", 1, 1)]
    # idf ln 2, tf 1 / (1 + 1.2 * (0.25 + 0.75 * 2 / 1.5)) = 0.4
    assert rows[0].score == pytest.approx(3 * 2.2 * math.log(2) * 0.4, abs=1e-5)


def test_fuzzy(spark):
    docs = spark.createDataFrame([(1, "attack", ""), (2, "attach", ""), (3, "track", ""), (4, "ca", "")], "doc_id long, term string, definition string")
    queries = spark.createDataFrame([("atatck",), ("ac",)], "query string")
    got = [(r.query, r.doc_id) for r in bm25.fuzzy_match(queries, bm25.build_index(docs), k=5).collect()]
    assert got == [("atatck", 1), ("atatck", 2)]
    assert bm25._osa("ca", "abc") == 3 and bm25._osa("abcd", "abdc") == 1 and bm25._osa("", "ab") == 2


def test_dense(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(40)] + [(99, None)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    a = dense.match_blocks(v, v, "id", "id", "vector", 3, block=7).collect()
    b = dense.match_pairs(v.where("vector is not null"), v.where("vector is not null"), "id", "id", "vector", 3).collect()
    assert {(r.query_id, r.rank, r.pool_id) for r in a} == {(r.query_id, r.rank, r.pool_id) for r in b} and len(a) == 120
    assert dense.match_blocks(v.limit(1), v.limit(2), "id", "id", "vector", 5).count() == 2
    assert dense.match_blocks(v.limit(0), v, "id", "id", "vector").count() == 0


def test_combined_pool(spark):
    s = spark.createDataFrame([("1", "a"), ("1", "a")], "concept_id string, description string")
    d = spark.createDataFrame([("2", "b")], "concept_id string, definition string")
    assert sorted(map(tuple, dense.combined_pool(s, d).collect())) == [("1", "a", "short_term"), ("1", "a", "short_term"), ("2", "b", "definition")]


def test_ancestors(spark):
    starts = spark.createDataFrame([("A",), ("unknown",), (None,)], "concept_id string")
    for f in (hierarchy.ancestors_few_hops, hierarchy.ancestors):
        got = {(r.concept_id, r.ancestor): r.distance for r in f(starts, edges(spark), 3).collect()}
        assert got == {("A", "A"): 0, ("A", "X"): 1, ("A", "Y"): 1, ("A", "R"): 2, ("unknown", "unknown"): 0}
    one = hierarchy.ancestors(starts, edges(spark), 1, include_self=False).collect()
    assert {r.ancestor for r in one} == {"X", "Y"}
    loop = edges(spark, [("A", "B"), ("B", "A")])
    assert {(r.ancestor, r.distance) for r in hierarchy.ancestors(starts.limit(1), loop, None).collect()} == {("A", 0), ("B", 1)}


def test_common_ancestors_and_relatedness(spark):
    pairs = spark.createDataFrame([("A", "B"), ("A", "Y"), ("A", "C"), ("A", "A"), (None, "A")], "a string, b string")
    got = [tuple(r) for r in hierarchy.common_ancestors(pairs.limit(3), edges(spark)).orderBy("a", "b", "rank").collect()]
    assert got == [("A", "B", "X", 1, 1, 2, 1), ("A", "B", "R", 2, 2, 4, 2), ("A", "Y", "Y", 1, 0, 1, 1), ("A", "Y", "R", 2, 1, 3, 2)]
    common = {(r.a, r.b): r.related for r in hierarchy.related(pairs, edges(spark)).collect()}
    assert common == {("A", "B"): True, ("A", "Y"): True, ("A", "C"): False, ("A", "A"): True, (None, "A"): False}
    line = {(r.a, r.b): r.related for r in hierarchy.related(pairs, edges(spark), 3, "lineage").collect()}
    assert not line["A", "B"] and line["A", "Y"]
    with pytest.raises(ValueError):
        hierarchy.related(pairs, edges(spark), 1, "cousins")
    flat = [tuple(r) for r in hierarchy.common_ancestors(pairs.limit(1), edges(spark), order="total_a_b", limit=1).collect()]
    assert flat == [("A", "B", "X", 1, 1, 2, 1)]


def lists(spark, rows):
    return spark.createDataFrame([(1, "q", m, r, c, f"text {c}", 1.0) for m, r, c in rows], "row_id long, query string, method string, rank int, concept_id string, text string, score double")


def test_consensus(spark):
    found = lists(spark, [("algorithm_1", 1, "A"), ("algorithm_1", 2, "B"), ("algorithm_1", 3, "C"), ("jaccard", 1, "B"), ("jaccard", 2, "A"), ("jaccard", 3, "B")])
    votes = {r.concept_id: (r.points, r.ord) for r in fusion.votes(found).collect()}
    assert votes == {"A": (5, 0), "B": (6, 1), "C": (1, 2)}
    best = fusion.consensus(found, edges(spark), 3, 5, 3).orderBy("rank").collect()
    assert [(r.concept_id, r.source, r.cluster_points) for r in best] == [("B", "exact_candidate", 11), ("A", "exact_candidate", 11), ("X", "common_ancestor", 11), ("C", "exact_candidate", 1)]
    rows = spark.createDataFrame([(1, "q"), (2, "none")], "row_id long, query string")
    one, none = fusion.final_candidates(rows, fusion.consensus(found, edges(spark)), 3).orderBy("row_id").collect()
    assert (one.final_concept_id, one.support_score, one.n_methods_agreeing, one.agreeing_methods) == ("B", 3.667, 2, ["algorithm_1", "jaccard"])
    assert one.final_candidate_scores == [3.667, 3.667, 3.667, 0.333] and one.final_candidate_ancestor_distances[2].total == 2
    assert none.final_concept_id is None and none.support_score == 0.0 and none.final_candidate_ids == [] and none.final_candidate_cluster_members is None
    alone = fusion.consensus(found, None).collect()
    assert all(r.source == "exact_candidate" and len(r.members) == 1 for r in alone)
    assert {tuple(map(str, r)) for r in fusion.consensus(found.repartition(5), edges(spark)).collect()} == {tuple(map(str, r)) for r in best}


def test_clusters_against_union_find(spark):
    rng = random.Random(9)
    rows, graph = [], []
    for row in range(12):
        for i in range(10):
            rows.append((row, f"{row}.{i}", 1, 1, ["m"], "t", i))
        graph += [(f"{row}.{rng.randrange(10)}", f"{row}.{rng.randrange(10)}") for _ in range(6)]
    got = fusion.clusters(spark.createDataFrame(rows, "row_id long, concept_id string, points int, n_methods int, methods array<string>, text string, ord int"), edges(spark, graph), 1).collect()
    known = {}
    for row in range(12):
        up = {f"{row}.{i}": {f"{row}.{i}"} | {p for c, p in graph if c == f"{row}.{i}"} for i in range(10)}
        label = {c: i for i, c in enumerate(up)}
        for _ in range(10):
            for a, b in itertools.combinations(up, 2):
                if up[a] & up[b]:
                    label[a] = label[b] = min(label[a], label[b])
        known |= {(row, c): v for c, v in label.items()}
    assert {(r.row_id, r.concept_id): r.cluster for r in got} == known


def test_comparison(spark):
    rows = spark.createDataFrame([(1, "q"), (2, "r")], "row_id long, query string")
    one, two = fusion.comparison(rows, lists(spark, [("jaccard", 1, "A"), ("jaccard", 2, "B")]), ("jaccard", "multi_match")).orderBy("row_id").collect()
    assert (one.jaccard_concept_id, one.multi_match_concept_id, two.jaccard_concept_id) == ("A", None, None)


def test_evaluation(spark):
    truth = evaluation.valid_sets(spark.createDataFrame([("c", "q"), ("c", None), (None, "z"), (" c ", "q")], "code string, snomed string"), "code", "snomed")
    assert [tuple(r) for r in truth.collect()] == [("c", ["q"])]
    rows = spark.createDataFrame([(1, "c"), (2, "missing")], "row_id long, code string")
    hits = {(r.row_id, r.k): r.hit for r in evaluation.hits(rows, lists(spark, [("jaccard", 1, "p"), ("jaccard", 2, "q")]), truth).collect()}
    assert hits == {(1, 1): False, (1, 5): True, (2, 1): False, (2, 5): False}


def test_prompts(spark):
    df = spark.createDataFrame([("sodium", None, " blood ", 2)], "q string, unit string, fluid string, z int")
    made = prompts.semantic_inputs(df, "t", "q", ("unit", "fluid")).first()
    assert made.algorithm_2_text == "q: sodium\nfluid: blood" and made.algorithm_ai_metadata.context_values == {"unit": "", "fluid": "blood"}
    assert prompts.semantic_inputs(df, "t", "q").first().algorithm_ai_metadata.context_values is None
    assert df.select(prompts.metadata_key("t", "q", ("z", "fluid"))).first()[0] == "t|q|sodium|fluid=blood|z=2"
    assert df.select(prompts.table_prompt("", "q", ())).first()[0] == "Table name: unknown table\nQuery column: q\nQuery value: sodium\nContext columns: none\nContext values:\n- none"
    assert df.select(prompts.prompt("full_row", df.columns, "q", ())).first()[0] == "q: sodium\nfluid: blood\nz: 2"
    assert df.select(prompts.prompt("values_only", df.columns, "unit", ())).first()[0] == "missing"
    for bad in (lambda: prompts.prompt("x", [], "q", ()), lambda: prompts.semantic_inputs(df, "t", "nope")):
        with pytest.raises(ValueError):
            bad()
    assert len(prompts.table_examples("t", "q", ("a", "b", "c", "d"))) == 4


def test_generation(spark):
    calls = []

    def fails():
        calls.append(1)
        raise OSError("down")

    pauses = []
    assert generation.with_retries(fails, 3, 5, pauses.append) == (None, "OSError: down") and pauses == [5, 10] and len(calls) == 3
    items = spark.createDataFrame([("a", [("user", "hello")]), ("a", [("user", "hello")]), ("b", [("user", "bye")])], "key string, messages array<struct<role:string,content:string>>")
    done = spark.createDataFrame([("b", "kept", None)], "key string, ai_output string, error string")
    got = generation.generate_missing(items, done, lambda: lambda m, model, t: m[0]["content"].upper() + " ")
    assert [tuple(r) for r in got.collect()] == [("a", "HELLO", None)]
    embed = generation.embedder(lambda: lambda batch: [[float(len(t)), 0.0] for t in batch])
    vectors = generation.embed_missing(items.select("key").distinct().withColumn("t", F.lit("xyz")), done, "key", "t", embed).collect()
    assert [(r.key, r.vector) for r in vectors] == [("a", [1.0, 0.0])]
    with pytest.raises(ValueError):
        generation.experiment_grid(items, "key", (), ("m",), shot_types=("many",))
    assert generation.manifest(spark, models=["m"]).count() == 1


def test_sampling_is_repeatable(spark):
    df = spark.range(100)
    one = topk.sample_rows(df, F.col("id"), 5, 1).collect()
    assert one == topk.sample_rows(df.repartition(7), F.col("id"), 5, 1).collect() and len(one) == 5
    assert topk.sample_rows(df.limit(3), F.col("id"), 5).count() == 3


def test_release_files(spark, tmp_path):
    write = lambda name, *lines: (tmp_path / name).write_text("\n".join("\t".join(x) for x in lines) + "\n")
    write("c.txt", ("id", "active"), ("1", "1"), ("2", "0"), ("900000000000000001", "1"))
    write("d.txt", ("id", "conceptId", "active", "typeId", "term"), ("x", "1", "1", terminology.FULL_NAME, '"quoted" term'), ("y", "1", "1", terminology.SYNONYM, "NA"), ("y", "1", "1", terminology.SYNONYM, "NA"), ("z", "2", "1", terminology.SYNONYM, "gone"), ("w", "900000000000000001", "0", terminology.SYNONYM, "old"))
    write("r.txt", ("sourceId", "destinationId", "typeId", "active"), ("1", "900000000000000001", hierarchy.IS_A, "1"), ("1", "2", hierarchy.IS_A, "1"), ("1", "900000000000000001", "5", "1"))
    got = terminology.build_terminology(spark, *[str(tmp_path / f"{n}.txt") for n in "cdtr"])
    assert sorted(map(tuple, got["short_terms"].collect())) == [("1", '"quoted" term', "FSN"), ("1", "NA", "Synonym")]
    assert got["definitions"].count() == 0 and [tuple(r) for r in got["isa"].collect()] == [("1", "900000000000000001")]
    assert got["bm25_documents"].count() == 3
    assert terminology.release_table(spark, str(tmp_path / "d.txt"), na_words=True).where("term is null").count() == 2
    (tmp_path / "q.csv").write_text("icd9,snomed,diagnosisstring\n250.00,129032061000119103,a|b\n")
    row = terminology.with_query(terminology.query_table(spark, str(tmp_path / "q.csv"))).first()
    assert (row.icd9, row.snomed, row.diagnosis_text) == ("250.00", "129032061000119103", "a - b")
    assert terminology.ground_truth(spark, str(tmp_path / "q.csv"), "icd9").first().concept == "129032061000119103"


def test_vector_import(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "v.npy", np.eye(3))
    ids = spark.createDataFrame([("b", 1), ("a", 0), ("c", 2)], "id string, n long")
    got = {r.id: r.vector for r in terminology.vectors_from_npy(spark, ids, "id", "n", str(tmp_path / "v.npy"), 2).collect()}
    assert got == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1]}
    with pytest.raises(ValueError):
        terminology.vectors_from_npy(spark, ids.limit(1), "id", "n", str(tmp_path / "v.npy"))


def test_checkpoints_and_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A", "heart attack", "an infarction"), (2, "B", "heart failure", None), (3, "C", "broken arm", None)], "doc_id long, concept_id string, term string, definition string")
    pools = pipeline.Pools(docs.select("concept_id", F.col("term").alias("description")), docs.select("concept_id", "definition").where("definition is not null"), docs, edges(spark))
    records = spark.createDataFrame([(1, "heart attack"), (2, "heart attack"), (3, None), (4, "arm broken")], "row_id long, diagnosis_text string")
    keep = sinks.Checkpoints(spark, str(tmp_path / "ck"))
    cfg = pipeline.MappingConfig(top_k=2)
    out = pipeline.run(records, pools, cfg, keep)
    final = {r.row_id: r.final_concept_id for r in out["final_candidates"].collect()}
    assert final[1] == final[2] == "A" and final[4] == "C" and set(final) == {1, 2, 3, 4}
    assert out["comparison"].count() == 4
    count = lambda: len(list((tmp_path / "ck" / "method=jaccard").iterdir()))
    assert count() == 1
    again = pipeline.run(records, pools, cfg, keep)["final_candidates"]
    assert {r.row_id: r.final_concept_id for r in again.collect()} == final and count() == 1
    # changed records, pools or settings never meet old results
    more = records.union(spark.createDataFrame([(5, "failure of the heart")], records.schema))
    assert {r.row_id: r.final_concept_id for r in pipeline.run(more, pools, cfg, keep)["final_candidates"].collect()} == final | {5: "B"} and count() == 2
    fewer = pipeline.Pools(pools.short_terms.where("concept_id <> 'A'"), pools.definitions.limit(0), docs.where("concept_id <> 'A'"), edges(spark))
    assert {r.final_concept_id for r in pipeline.run(records, fewer, cfg, keep)["final_candidates"].where("row_id = 1").collect()} == {"B"} and count() == 3
    stale = next((tmp_path / "ck" / "method=jaccard").iterdir())
    before = {x.name for x in stale.iterdir()}
    pipeline.run(records, pools, pipeline.MappingConfig(top_k=2, methods=("jaccard",), fresh_start=True), keep)
    assert any({x.name for x in f.iterdir()} != before for f in (tmp_path / "ck" / "method=jaccard").iterdir() if f == stale) or count() == 3
    sinks.write_scores(out["comparison"].select("row_id"), str(tmp_path / "scores"))
    sinks.write_results(out["data"], str(tmp_path / "data"))
    assert "algorithm_ai_metadata" not in spark.read.parquet(str(tmp_path / "data")).columns
    assert spark.read.parquet(sinks.keep_index(jaccard.candidate_postings(docs, "term", "doc_id"), str(tmp_path), {"n": 3}, 2)).count() > 0


def test_kept_indexes_give_the_same_matches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "heart attack", "an infarction"), (2, "heart failure", None), (3, "broken arm", None), (4, "", None)], "doc_id long, term string, definition string")
    queries = spark.createDataFrame([("heart atack",), ("arm",), ("infarction heart",)], "query string")
    index = bm25.build_index(docs)
    bm25.write_index(index, str(tmp_path / "bm25"), 2)
    back = bm25.read_index(spark, str(tmp_path / "bm25"))
    for f in (bm25.multi_match, bm25.fuzzy_match):
        rows = lambda i, f=f: sorted(map(tuple, f(queries, i, k=3).collect()))
        assert rows(index) == rows(back) != []
    plain = sorted(map(tuple, jaccard.match(queries, docs, "query", "term", "doc_id", 2).collect()))
    for made in (jaccard.candidate_postings(docs, "term", "doc_id"), jaccard.postings(docs, "term")):
        path = sinks.keep_index(made, str(tmp_path), {"n": 3, "columns": made.columns}, 2)
        assert sorted(map(tuple, jaccard.match(queries, docs, "query", "term", "doc_id", 2, index=spark.read.parquet(path)).collect())) == plain != []


def test_near_terms_against_all_pairs(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(250)} | {"a" * 30, "a" * 31, "ab" * 13, "ab" * 12, "ab" * 12 + "ba"})
    frame = spark.createDataFrame([(w,) for w in words], "own string")
    got = {(r.own, r.token): r.edits for r in bm25.expansions(frame, frame.withColumnRenamed("own", "token"), most=10_000).collect()}
    allowed = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    assert got == {(a, b): e for a in words for b in words if a[0] == b[0] and abs(len(a) - len(b)) <= 2 and (e := bm25._osa(a, b)) <= allowed(a)}


def test_far_ancestors_and_cycles(spark):
    chain = edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n12", "n0")])
    starts = spark.createDataFrame([("n0",)], "concept_id string")
    assert {(r.ancestor, r.distance) for r in hierarchy.ancestors(starts, chain, None).collect()} == {(f"n{i}", i) for i in range(13)}
    assert {r.distance for r in hierarchy.ancestors_few_hops(starts, chain, 7).collect()} == set(range(8))


def test_generated_texts_and_experiments(spark, tmp_path):
    """Each key is asked for once, failures stay errors without matches and are tried again, stored texts are not."""
    records = spark.createDataFrame([("heart", "x"), ("heart", "x"), ("arm", "y"), ("bad", "z")], "diagnosis_text string, unit string")
    log = str(tmp_path / "calls")

    def factory(broken):
        def make():
            def generate(messages, model, temperature):
                value = generation.echo()(messages, model, temperature)
                with open(log, "a") as out:
                    out.write(value + "\n")
                if value == broken:
                    raise OSError("down")
                return f"{value} text"

            return generate

        return make

    cfg = lambda broken: pipeline.MappingConfig(table_path="t.csv", context_columns=("unit",), model=factory(broken), text_store=str(tmp_path / "texts"), attempts=2, pause=0.0, top_k=1, methods=("algorithm_ai",))
    first = pipeline.prepare(records, cfg("bad"))
    assert sorted((r.diagnosis_text, r.algorithm_ai_text, r.ai_error) for r in first.collect())[0:2] == [("arm", "arm text", None), ("bad", None, "OSError: down")]
    assert len({r.row_id for r in first.collect()}) == 4
    assert sorted(open(log).read().split()) == ["arm", "bad", "bad", "heart"]
    pool = spark.createDataFrame([("A", "heart text"), ("B", "arm text"), ("C", None)], "concept_id string, description string")
    docs = spark.createDataFrame([], "doc_id long, concept_id string, term string, definition string")
    pools = pipeline.Pools(pool, spark.createDataFrame([], "concept_id string, definition string"), docs, None)
    found = pipeline.retrieve(first, pools, cfg("bad")).join(first.select("row_id", "diagnosis_text"), "row_id").collect()
    assert sorted((r.diagnosis_text, r.concept_id) for r in found) == [("arm", "B"), ("heart", "A"), ("heart", "A")]
    second = pipeline.prepare(records, cfg("none"))
    assert {r.diagnosis_text: r.algorithm_ai_text for r in second.collect()} == {"heart": "heart text", "arm": "arm text", "bad": "bad text"}
    assert sorted(open(log).read().split())[:2] == ["arm", "bad"] and open(log).read().split().count("heart") == 1
    sample = spark.createDataFrame([(1, "heart", "x")], "sample_index long, test_name string, spec_type_desc string")
    grid = generation.experiment_grid(sample, "test_name", ("spec_type_desc",), ("m1", "m2"))
    outputs = generation.run_experiment(grid, lambda: lambda m, model, t: 1 / 0 if model == "m2" else "heart text", ("m1", "m2"), attempts=1)
    rows = outputs.collect()
    assert len(rows) == 12 and {(r.model, r.ai_output, r.error is None) for r in rows} == {("m1", "heart text", True), ("m2", None, False)}
    mapped = pipeline.map_experiment(outputs, pools, pipeline.MappingConfig(top_k=1)).collect()
    assert len(mapped) == 6 and {(r.model, r.concept_id) for r in mapped} == {("m1", "A")}
    done = outputs.where("ai_output is not null").select("key", "ai_output")
    again = generation.run_experiment(grid, lambda: lambda m, model, t: "new", ("m1", "m2"), done).collect()
    assert {(r.model, r.ai_output) for r in again} == {("m1", "heart text"), ("m2", "new")}


def test_small_writers_and_settings(spark, tmp_path, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id long, vector array<float>")
    sinks.write_vectors(vectors, str(tmp_path / "v"), 5, 2)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 5
    with pytest.raises(ValueError):
        sinks.write_vectors(vectors, str(tmp_path / "w"), 6)
    sinks.write_pools({"isa": edges(spark), "definitions": vectors}, str(tmp_path / "pools"))
    assert sinks.read_pools(spark, str(tmp_path / "pools"), ("isa",))["isa"].count() == len(EDGES)
    report = {r.column: (r.rows, r.nulls) for r in terminology.count_report(spark.createDataFrame([(1, None), (2, "x")], "a long, `b.c` string")).collect()}
    assert report == {"a": (2, 0), "b.c": (2, 1)}
    cells = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "v array<array<double>>, m array<int>")
    assert [r[0] for r in cells.select(text.masked_mean(F.col("v"), F.col("m"))).collect()] == [[2.0, 3.0], None]
    monkeypatch.setenv("TERMWEAVE_TOP_K", "7")
    monkeypatch.setenv("TERMWEAVE_METHODS", "jaccard,multi_match")
    monkeypatch.setenv("TERMWEAVE_FRESH_START", "true")
    cfg = pipeline.MappingConfig.from_env(table_path="x/y.csv")
    assert (cfg.top_k, cfg.methods, cfg.fresh_start, cfg.table_name) == (7, ("jaccard", "multi_match"), True, "y")
    empty = generation.embed_missing(spark.createDataFrame([(1, None), (2, "x")], "k long, t string"), None, "k", "t", generation.hashing).collect()
    assert {r.k: r.vector is None for r in empty} == {1: True, 2: False}


def test_stream(spark, tmp_path):
    from termweave.streaming.incremental import map_stream

    spark.createDataFrame([(1, "cat"), (2, "dog")], "id long, q string").write.parquet(str(tmp_path / "in"))
    pool = spark.createDataFrame([("9", "cats")], "id string, term string")
    stream = spark.readStream.schema("id long, q string").parquet(str(tmp_path / "in"))
    run = map_stream(stream, lambda b: jaccard.match(b, pool, "q", "term", "id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_plans_are_native(spark):
    pool = spark.range(50).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("term "), "id").alias("term"))
    plan = jaccard.match(pool, pool, "term", "term", "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "Python" not in plan


def _names(plan):
    return plan._jdf.queryExecution().executedPlan().toString()


def test_bm25_scores_where_documents_lie(spark, monkeypatch):
    """Same as SQL, with shared ids, repeated rows and several blocks and parts; no join makes a row for each query, document and token."""
    import duckdb
    from termweave.operators import products
    from termweave.plans import oracle

    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["ä", "x1"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(rng.randrange(40), say(rng.randrange(6)), rng.choice([None, say(9), say(9).upper()])) for _ in range(90)] + [(3, "w1 w2", "w3")] * 3
    asked = [(say(3 + i % 4),) for i in range(15)] + [(None,), ("",), ("nothing here",)]
    docs = spark.createDataFrame(rows, "doc_id long, term string, definition string")
    queries = spark.createDataFrame(asked, "query string")
    con = duckdb.connect()
    con.execute("CREATE TABLE fld (doc_id BIGINT, term VARCHAR, definition VARCHAR)")
    con.execute("CREATE TABLE items (query VARCHAR)")
    con.executemany("INSERT INTO fld VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO items VALUES (?)", asked)
    wanted = con.execute(f"WITH {oracle._terms('items', 'tm')}, {oracle._bm25('tm', 'fld', 'mm')} SELECT query, doc_id, score, rank FROM mm ORDER BY ALL").fetchall()
    index = bm25.build_index(docs)
    for entries, queries_at_once in ((1 << 20, 256), (20, 2)):
        monkeypatch.setattr(products, "ENTRIES", entries)
        monkeypatch.setattr(products, "QUERIES", queries_at_once)
        found = bm25.multi_match(queries, index, k=5)
        assert sorted(map(tuple, found.collect())) == [pytest.approx(x) for x in wanted]
    plan = _names(bm25.multi_match(queries, index, k=5))
    assert "MapInArrow" in plan and "Join" not in plan
    stats = {r.field: (r.n, r.avgdl) for r in index.stats.collect()}
    cut = [len((r[1] or "").split()) for r in rows if r[1]]
    assert stats["term"] == (len(cut), pytest.approx(sum(cut) / len(cut)))


@pytest.mark.parametrize("n", [1, 3, 4])
def test_whole_texts_match_like_terms(spark, monkeypatch, n):
    """match_texts gives what the joined index gives, copies, ties, short and null texts included, and joins no n-grams."""
    from termweave.operators import products

    rng = random.Random(n)
    texts = ["".join(rng.choice("abc äé😀") for _ in range(rng.randint(0, 9))) for _ in range(120)] + [None, "ab", "ab", "AB", "a"]
    pool = spark.createDataFrame([(rng.randrange(90), t) for t in texts], "id long, term string")
    queries = spark.createDataFrame([(t,) for t in texts[::3]], "q string")
    wanted = sorted(map(tuple, jaccard.match(queries, pool, "q", "term", "id", 4, n, text.clean).collect()))
    for entries, queries_at_once in ((1 << 20, 256), (40, 3)):
        monkeypatch.setattr(products, "ENTRIES", entries)
        monkeypatch.setattr(products, "QUERIES", queries_at_once)
        found = jaccard.match_texts(queries, pool, "q", "term", "id", 4, n, text.clean)
        assert sorted(map(tuple, found.collect())) == wanted != []
    assert "ngram" not in _names(found)


def test_best_cells_are_bounded():
    import numpy as np

    best = topk.Best(2, 3)
    row, col = best.cells(np.array([[1.0, 5.0, -np.inf], [1.0, 4.0, np.nan], [1.0, 6.0, -np.inf]]))
    assert list(zip(row, col, strict=True)) == [(0, 0), (1, 0), (2, 1), (0, 1)]
    row, col = best.cells(np.array([[0.5, 4.5, 1.0], [2.0, 5.5, -1.0]]))
    assert list(zip(row, col, strict=True)) == [(1, 0), (1, 1), (0, 2), (1, 2)]


def test_dense_ties_and_pairs_by_products(spark):
    """Equal vectors go by their ids over all slices; pairs without a condition are products, not a cross join."""
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(2600, 0, -1)], "id long, vector array<float>").coalesce(1)
    few = v.where("id % 500 = 0")
    found = dense.match_blocks(few, v, "id", "id", "vector", 3, skip_self=True)
    pairs = dense.match_pairs(few, v, "id", "id", "vector", 3, skip_self=True)
    slow = dense.match_pairs(few, v, "id", "id", "vector", 3, keep=F.col("query_id") != F.col("pool_id"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect())) == sorted(map(tuple, slow.collect()))
    assert "MapInArrow" in _names(pairs) and "CartesianProduct" not in _names(pairs) and "NestedLoop" not in _names(pairs)


def test_few_hops_against_hop_by_hop(spark):
    """Graphs with cycles, repeated edges and hubs; the way on from a parent is found once, not once for each concept below it."""
    rng = random.Random(6)
    rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)] + [(f"low{i}", "n1") for i in range(40)] * 2 + [(None, "n1"), ("n1", None)]
    starts = spark.createDataFrame([(f"low{i}",) for i in range(40)] + [(f"n{i}",) for i in range(0, 35, 3)], "concept_id string")
    for depth in range(4):
        few = sorted(map(tuple, hierarchy.ancestors_few_hops(starts, edges(spark, rows), depth).collect()))
        assert few == sorted(map(tuple, hierarchy.ancestors(starts, edges(spark, rows), depth).collect()))
    plan = _names(hierarchy.ancestors_few_hops(starts, edges(spark, rows), 3))
    assert plan.count("Join") <= 2 * plan.count("Union") and plan.count("parent") and "RepartitionBy" not in plan and "REPARTITION_BY_NUM" in plan


def test_messages_are_made_in_bounded_tasks(spark, monkeypatch):
    """Tasks that hold messages grow in number with the rows, and messages themselves are not dealt out."""
    monkeypatch.setattr(generation, "ROWS", 10)
    sample = spark.createDataFrame([(i, f"heart {i}", "x") for i in range(25)], "sample_index long, test_name string, spec_type_desc string")
    grid = generation.experiment_grid(sample, "test_name", ("spec_type_desc",), ("m1", "m2"))
    assert grid.rdd.getNumPartitions() == 30
    asked = generation.generate_missing(grid.select("key", "messages"), None, generation.echo)
    assert _names(asked).count("Exchange") == 1 and asked.rdd.getNumPartitions() == 30
    assert asked.count() == 300 == grid.select("key").distinct().count()


def test_hashing_counts_names_of_cells(spark):
    """The built-in embedder gives the vectors of the definition and asks no lambda about each n-gram for each cell."""
    texts = spark.createDataFrame([("heart attack " * 20,), ("Äb, c-d",), ("",), (None,), ("x",)], "t string")
    grams = text.ngrams(text.clean(F.col("t")), 3)
    hashed = F.transform(grams, lambda g: F.struct(F.pmod(F.xxhash64(g), F.lit(64)).alias("cell"), F.when(F.xxhash64(g, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))
    made = text.hashed_embedding(F.col("t"))
    for r in texts.select(hashed.alias("h"), made.alias("v")).collect():
        sums = [sum(x.sign for x in r.h if x.cell == k) for k in range(64)]
        norm = math.sqrt(sum(x * x for x in sums))
        assert r.v == pytest.approx([x / norm if norm else 0.0 for x in sums], abs=1e-7)
    assert "array_remove" in _names(texts.select(made)) and "aggregate(filter" not in _names(texts.select(made))
