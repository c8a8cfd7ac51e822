"""The registered queries in DuckDB SQL over the driver's tables, written from the definitions and not from the plans."""

from __future__ import annotations

from termweave.functions.prompts import EXAMPLES
from termweave.functions.text import PUNCTUATION, STOPWORDS


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean(x: str, stop: bool = False) -> str:
    out = f"translate(lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')), {_lit(PUNCTUATION)}, '')"
    if stop:
        out = f"array_to_string(list_filter(string_split_regex({out}, '\\s+'), lambda w: w <> '' AND w NOT IN ({', '.join(map(_lit, STOPWORDS))})), ' ')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '^\\s+|\\s+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _grams(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN []::VARCHAR[] WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, greatest(length({x}) - 1, 2)), lambda i: substr({x}, i, 3))) END"


CONCEPTS = "con AS (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size % 5 <> 0)"
DESCRIPTIONS = """des AS (
  SELECT CAST(p_partkey AS VARCHAR) AS "conceptId", '900000000000003001' AS "typeId", p_name AS term FROM part WHERE p_size % 7 <> 0
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), '900000000000013009', p_type FROM part WHERE p_size % 7 <> 0
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), '900000000000550004', p_brand FROM part WHERE p_size % 7 <> 0)"""
TEXTS = "txt AS (SELECT CAST(doc_id AS VARCHAR) AS cid, 'quality ' || quality || ' toxic ' || toxic AS definition FROM labels WHERE quality = 1)"
RELATIONS = """rel AS (
  SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier WHERE s_suppkey % 5 <> 0
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
PLACES = """pla AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_suppkey % 7 <> 0 UNION SELECT 'n' || n_nationkey FROM nation
  UNION SELECT 'r' || r_regionkey FROM region WHERE r_regionkey <> 0)"""
GEO = "e AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
PEOPLE = "peo AS (SELECT c_custkey, c_name, c_mktsegment, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"
ITEMS = "items AS (SELECT item_id AS row_id, text AS query FROM benchmark)"
FIELDED = "fld AS (SELECT doc_id, substr(text, 1, 80) AS term, substr(text, 81) AS definition FROM documents)"
PAIRS = "p AS (SELECT DISTINCT 's' || s_suppkey AS a, 's' || (s_suppkey + 1) AS b FROM supplier UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def _closure(starts: str, depth: int, edges: str = "e", name: str = "clo") -> str:
    """Shortest distances of all ancestors within ``depth`` of ``starts`` (a table with column s)."""
    hops = [f"{name}0 AS (SELECT DISTINCT s, s AS anc FROM {starts} WHERE s IS NOT NULL)"]
    hops += [f"{name}{k} AS (SELECT DISTINCT c.s, {edges}.parent AS anc FROM {name}{k - 1} c JOIN {edges} ON c.anc = {edges}.child)" for k in range(1, depth + 1)]
    every = " UNION ALL ".join(f"SELECT s, anc, {k} AS dist FROM {name}{k}" for k in range(depth + 1))
    return ", ".join(hops) + f", {name} AS (SELECT s, anc, min(dist) AS dist FROM ({every}) GROUP BY s, anc)"


def _related(pairs: str, depth: int, mode: str, edges: str = "e", name: str = "rlt") -> str:
    """CTE ``name`` (a, b): the distinct related pairs of ``pairs`` (a, b)."""
    closure = _closure(f"(SELECT a AS s FROM {pairs} UNION SELECT b FROM {pairs})", depth, edges, f"{name}c")
    if mode == "lineage":
        test = f"EXISTS (SELECT 1 FROM {name}c x WHERE x.s = q.a AND x.anc = q.b) OR EXISTS (SELECT 1 FROM {name}c x WHERE x.s = q.b AND x.anc = q.a)"
        return f"{closure}, {name} AS (SELECT DISTINCT a, b FROM {pairs} q WHERE {test})"
    return f"{closure}, {name} AS (SELECT DISTINCT q.a, q.b FROM {pairs} q JOIN {name}c x ON x.s = q.a JOIN {name}c y ON y.s = q.b AND y.anc = x.anc)"


def _bm25(terms: str, docs: str, name: str, k: int = 5) -> str:
    """CTE ``name`` (query, doc_id, score, rank). ``terms``: query, token, weight, grp. ``docs``: doc_id, term, definition."""
    n = name
    return f"""
{n}d AS (SELECT doc_id, 'term' AS field, {_tokens("term")} AS toks FROM {docs} UNION ALL SELECT doc_id, 'definition', {_tokens("definition")} FROM {docs}),
{n}l AS (SELECT doc_id, field, toks, len(toks) AS dl FROM {n}d WHERE len(toks) > 0),
{n}s AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM {n}l GROUP BY field),
{n}x AS (SELECT doc_id, field, dl, unnest(toks) AS token FROM {n}l),
{n}f AS (SELECT doc_id, field, dl, token, count(*) AS f FROM {n}x WHERE token IN (SELECT token FROM {terms}) GROUP BY ALL),
{n}df AS (SELECT field, token, count(*) AS df FROM {n}f GROUP BY ALL),
{n}b AS (SELECT t.query, t.grp, d.field, max(d.df) AS df FROM {terms} t JOIN {n}df d ON t.token = d.token GROUP BY ALL),
{n}w AS (SELECT t.query, t.token, t.weight, b.field, s.avgdl, ln(1 + (s.n - b.df + 0.5) / (b.df + 0.5)) AS idf
         FROM {terms} t JOIN {n}b b ON b.query = t.query AND b.grp = t.grp JOIN {n}s s ON s.field = b.field),
{n}p AS (SELECT w.query, f.doc_id, f.field,
                sum((CASE f.field WHEN 'term' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END) * w.weight * 2.2::DOUBLE * w.idf * f.f
                    / (f.f + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * f.dl / w.avgdl))) AS score
         FROM {n}f f JOIN {n}w w ON w.token = f.token AND w.field = f.field GROUP BY ALL),
{n}m AS (SELECT query, doc_id, round(max(score), 6) AS score FROM {n}p GROUP BY ALL),
{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM {n}m) WHERE rank <= {k})"""


def _terms(queries: str, name: str) -> str:
    cut = f"(SELECT query, unnest({_tokens(_clean('query'))}) AS own FROM (SELECT DISTINCT query FROM {queries} WHERE query IS NOT NULL))"
    return f"{name}o AS (SELECT query, own, count(*)::DOUBLE AS times FROM {cut} GROUP BY ALL), {name} AS (SELECT query, own AS token, times AS weight, own AS grp FROM {name}o)"


def _fuzzy_terms(queries: str, docs: str, name: str) -> str:
    allowed = "CASE WHEN length(o.own) <= 2 THEN 0 WHEN length(o.own) <= 5 THEN 1 ELSE 2 END"
    return f"""{_terms(queries, name + "e")},
{name}v AS (SELECT DISTINCT unnest({_tokens("term")}) AS token FROM {docs} UNION SELECT DISTINCT unnest({_tokens("definition")}) FROM {docs}),
{name}n AS (SELECT o.own, v.token, damerau_levenshtein(o.own, v.token) AS edits
            FROM (SELECT DISTINCT own FROM {name}eo) o JOIN {name}v v ON substr(o.own, 1, 1) = substr(v.token, 1, 1)
             AND abs(length(o.own) - length(v.token)) <= {allowed} WHERE damerau_levenshtein(o.own, v.token) <= {allowed}),
{name}k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY edits, token) AS nth FROM {name}n) WHERE nth <= 50),
{name} AS (SELECT o.query, k.token, o.times * (1 - k.edits / least(length(k.own), length(k.token))) AS weight, o.own AS grp
           FROM {name}eo o JOIN {name}k k ON k.own = o.own)"""


def _jaccard(queries: str, pool: str, name: str, k: int = 5) -> str:
    """CTE ``name`` (query, rank, concept_id, term, jaccard_score). ``pool``: concept_id, term."""
    n = name
    return f"""
{n}q AS (SELECT query, {_clean("query")} AS own FROM (SELECT DISTINCT query FROM {queries} WHERE query IS NOT NULL)),
{n}r AS (SELECT concept_id, term, {_clean("term")} AS form FROM {pool}),
{n}a AS (SELECT own, len(g) AS size, unnest(g) AS gram FROM (SELECT DISTINCT own, {_grams("own")} AS g FROM {n}q WHERE own <> '')),
{n}b AS (SELECT form, len(g) AS size, unnest(g) AS gram FROM (SELECT DISTINCT form, {_grams("form")} AS g FROM {n}r WHERE form <> '')),
{n}j AS (SELECT a.own, b.form, count(*) / (a.size + b.size - count(*)) AS s FROM {n}a a JOIN {n}b b ON a.gram = b.gram GROUP BY a.own, b.form, a.size, b.size),
{n} AS (SELECT query, rank, concept_id, term, round(s, 6) AS jaccard_score FROM (
          SELECT q.query, r.concept_id, r.term, j.s, row_number() OVER (PARTITION BY q.query ORDER BY round(j.s, 12) DESC, r.concept_id, r.term) AS rank
          FROM {n}q q JOIN {n}j j ON j.own = q.own JOIN {n}r r ON r.form = j.form) WHERE rank <= {k})"""


DENSE = """
sim AS (SELECT q.vec_id AS query_id, c.vec_id AS pool_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity
        FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 {keep}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pool_id) AS rank FROM sim) WHERE rank <= 5)"""
DENSE_OTHERS = DENSE.format(keep="AND q.vec_id <> c.vec_id")

MATCHES = f"""{ITEMS}, {FIELDED}, {_terms("items", "tm")}, {_bm25("tm", "fld", "mm")},
pool AS (SELECT doc_id AS concept_id, text AS term FROM documents), {_jaccard("items", "pool", "jc")},
mat AS (SELECT query, 'multi_match' AS method, rank, doc_id, score, term AS text FROM mm JOIN fld USING (doc_id)
        UNION ALL SELECT query, 'jaccard', rank, concept_id, jaccard_score, term FROM jc)"""
LISTS = f"""{MATCHES}, lis AS (SELECT i.row_id, i.query, m.method, CASE m.method WHEN 'multi_match' THEN 0 ELSE 1 END AS i, m.rank, m.doc_id FROM items i JOIN mat m ON m.query = i.query)"""


def _votes(k: int) -> str:
    return f"""vot0 AS (
  SELECT row_id, CAST(doc_id AS VARCHAR) AS concept_id, CAST(sum({k} + 1 - rank) AS BIGINT) AS points, list_sort(list_distinct(list(method))) AS methods,
         min(i * 100 + rank) AS seen FROM lis WHERE rank <= {k} GROUP BY row_id, doc_id),
vot AS (SELECT row_id, concept_id, points, methods, row_number() OVER (PARTITION BY row_id ORDER BY seen, concept_id) - 1 AS ord FROM vot0)"""


SOURCES = """g AS (SELECT CAST(doc_id AS VARCHAR) AS child, 'source:' || source AS parent FROM documents WHERE source IS NOT NULL
  UNION SELECT 'source:' || source, 'corpus' FROM documents WHERE source IS NOT NULL)"""
def _clusters(k: int) -> str:
    return f"""{LISTS}, {_votes(k)}, {SOURCES},
cp AS (SELECT x.row_id, x.concept_id AS a, x.ord AS i, y.concept_id AS b, y.ord AS j FROM vot x JOIN vot y ON x.row_id = y.row_id AND x.ord < y.ord),
{_related("cp", 1, "common", "g", "crl")},
lnk AS (SELECT cp.row_id, i, j FROM cp JOIN crl ON crl.a = cp.a AND crl.b = cp.b),
two AS (SELECT row_id, i, j FROM lnk UNION SELECT row_id, j, i FROM lnk),
rea AS (SELECT row_id, ord, ord AS seen FROM vot UNION SELECT rea.row_id, rea.ord, two.j FROM rea JOIN two ON two.row_id = rea.row_id AND two.i = rea.seen),
clu AS (SELECT v.*, m.cluster FROM vot v JOIN (SELECT row_id, ord, min(seen) AS cluster FROM rea GROUP BY ALL) m ON m.row_id = v.row_id AND m.ord = v.ord)"""


CLUSTERS = _clusters(5)


def _tops(depth: int) -> str:
    return f"""siz AS (SELECT row_id, cluster, count(*) AS n FROM clu GROUP BY ALL HAVING count(*) > 1),
{_closure("(SELECT concept_id AS s FROM clu)", depth, "g", "cla")},
anc AS (SELECT c.row_id, c.cluster, x.anc, sum(x.dist) AS total, max(x.dist) AS most FROM clu c JOIN siz s ON s.row_id = c.row_id AND s.cluster = c.cluster
        JOIN cla x ON x.s = c.concept_id GROUP BY c.row_id, c.cluster, x.anc, s.n HAVING count(*) = s.n),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, cluster ORDER BY total, most, anc) AS k FROM anc) WHERE k = 1)"""


def _consensus(k: int, final: int) -> str:
    return f"""{_clusters(k)}, {_tops(1)},
agg AS (SELECT row_id, cluster, CAST(sum(points) AS BIGINT) AS cp, list_sort(list_distinct(flatten(list(methods)))) AS ms, list(concept_id) AS members FROM clu GROUP BY ALL),
cand AS (SELECT c.row_id, c.concept_id, 'exact_candidate' AS source, c.cluster, 0 AS late, c.ord, a.cp, c.points AS own, a.ms
         FROM clu c JOIN agg a ON a.row_id = c.row_id AND a.cluster = c.cluster
         UNION ALL SELECT t.row_id, t.anc, 'common_ancestor', t.cluster, 1, 0, a.cp, 0, a.ms
         FROM top t JOIN agg a ON a.row_id = t.row_id AND a.cluster = t.cluster WHERE NOT list_contains(a.members, t.anc)),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY cp DESC, own DESC, len(ms) DESC, cluster, late, ord) AS rank FROM cand) WHERE rank <= {final})"""


CONSENSUS = _consensus(5, 6)
VECTOR_GRAPH = "g AS (SELECT CAST(vec_id AS VARCHAR) AS child, 'g' || (vec_id % 50) AS parent FROM embeddings UNION SELECT 'g' || (vec_id % 50), 'h' || (vec_id % 10) FROM embeddings)"
HIT_BASE = f"""{DENSE_OTHERS},
rws AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS code FROM embeddings WHERE vec_id % 100 = 0),
val AS (SELECT DISTINCT CAST(label AS VARCHAR) AS code, CAST(vec_id AS VARCHAR) AS concept FROM embeddings WHERE vec_id % 3 = 0 AND label IS NOT NULL),
hp AS (SELECT t.query_id AS row_id, t.rank, CAST(t.pool_id AS VARCHAR) AS a, v.concept AS b FROM top t JOIN rws r ON r.row_id = t.query_id JOIN val v ON v.code = r.code)"""


def _hits(condition: str, name: str = "hit") -> str:
    return f"""{name}b AS (SELECT row_id, min(rank) AS best FROM hp WHERE {condition} GROUP BY row_id),
{name} AS (SELECT r.row_id, 'dense' AS method, k.k, coalesce(b.best <= k.k, false) AS hit FROM rws r, (VALUES (1::BIGINT), (5::BIGINT)) k(k) LEFT JOIN {name}b b ON b.row_id = r.row_id)"""


_KNOWN = "EXISTS (SELECT 1 FROM rlt WHERE rlt.a = hp.a AND rlt.b = hp.b)"


def _prompt(value: str, segment: str, nation: str) -> str:
    m = lambda x: f"CASE WHEN {x} = '' THEN 'missing' ELSE {x} END"
    return f"'Table name: customer' || chr(10) || 'Query column: c_name' || chr(10) || 'Query value: ' || {m(value)} || chr(10) || 'Context columns: c_mktsegment, n_name' || chr(10) || 'Context values:' || chr(10) || '- c_mktsegment: ' || {m(segment)} || chr(10) || '- n_name: ' || {m(nation)}"


NAME, SEGMENT, NATION = _strip("c_name"), _strip("c_mktsegment"), _strip("n_name")
PROMPT = _prompt(NAME, SEGMENT, NATION)
_shots = " UNION ALL ".join(
    f"SELECT c_custkey, 'user' AS role, {_prompt(_lit(e['test_name']), _lit(e['spec_type_desc']), _lit(e['org_name']))} AS content FROM peo UNION ALL SELECT c_custkey, 'assistant', {_lit(e['ideal_description'])} FROM peo" for e in EXAMPLES
)
_MISS = lambda x: f"CASE WHEN {x} = '' THEN 'missing' ELSE {x} END"
_LINE = lambda name, x: f"CASE WHEN {x} <> '' THEN '{name}' || {x} END"

SQL: dict[str, str] = {
    "active_semi_filter": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "short_terms_extract": f"""WITH {CONCEPTS}, {DESCRIPTIONS} SELECT DISTINCT "conceptId" AS concept_id, term AS description, CASE "typeId" WHEN '900000000000003001' THEN 'FSN' ELSE 'Synonym' END AS description_type
        FROM des WHERE "typeId" IN ('900000000000003001', '900000000000013009') AND "conceptId" IN (SELECT id FROM con)""",
    "definitions_extract": f"WITH {CONCEPTS}, {TEXTS} SELECT DISTINCT cid AS concept_id, definition FROM txt WHERE cid IN (SELECT id FROM con)",
    "isa_edges_extract": f"WITH {RELATIONS}, {PLACES} SELECT DISTINCT child AS source_id, parent AS destination_id FROM rel WHERE child IN (SELECT id FROM pla) AND parent IN (SELECT id FROM pla)",
    "raw_isa_edges": f"WITH {RELATIONS} SELECT DISTINCT child, parent FROM rel",
    "bm25_documents_build": f'WITH {CONCEPTS}, {DESCRIPTIONS}, {TEXTS} SELECT "conceptId", term, definition, "typeId" FROM des JOIN con ON con.id = des."conceptId" LEFT JOIN txt ON txt.cid = des."conceptId" WHERE term IS NOT NULL',
    "combined_pool": f"WITH {FIELDED} SELECT CAST(p_partkey AS VARCHAR) AS concept_id, p_name AS text, 'short_term' AS source FROM part UNION ALL SELECT CAST(doc_id AS VARCHAR), definition, 'definition' FROM fld WHERE definition <> ''",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned, {_strip('text')} AS plain FROM documents",
    "clean_text_stopwords": f"SELECT doc_id, {_clean('text', True)} AS cleaned FROM documents",
    "char_ngrams": f"SELECT p_partkey, unnest({_grams('c')}) AS ngram FROM (SELECT p_partkey, {_clean('p_name')} AS c FROM part)",
    "algorithm_texts": f"""WITH {PEOPLE} SELECT c_custkey, {NAME} AS algorithm_1_text, concat_ws(chr(10), {_LINE("c_name: ", NAME)}, {_LINE("c_mktsegment: ", SEGMENT)}, {_LINE("n_name: ", NATION)}) AS algorithm_2_text,
        {NAME} AS query_value, 'c_mktsegment,n_name' AS context_columns, {NATION} AS nation FROM peo""",
    "ai_metadata_key": f"WITH {PEOPLE} SELECT c_custkey, 'customer|c_name|' || {NAME} || '|c_mktsegment=' || {SEGMENT} || '|n_name=' || {NATION} AS key FROM peo",
    "ai_prompt": f"WITH {PEOPLE} SELECT c_custkey, {PROMPT} AS prompt FROM peo",
    "few_shot_prompt": f"WITH {PEOPLE} {_shots} UNION ALL SELECT c_custkey, 'user', {PROMPT} FROM peo",
    "experiment_grid": f"""WITH b AS (SELECT c_custkey AS sample_index, {NAME} AS query_value, {SEGMENT} AS seg FROM customer),
        p AS (SELECT sample_index, query_value, 'named' AS prompt_type, 'Query column: test_name' || chr(10) || 'Query value: ' || {_MISS("query_value")} || chr(10) || 'Context values:' || chr(10) || '- spec_type_desc: ' || {_MISS("seg")} AS prompt FROM b
              UNION ALL SELECT sample_index, query_value, 'values_only', coalesce(nullif(concat_ws(chr(10), nullif(query_value, ''), nullif(seg, '')), ''), 'missing') FROM b
              UNION ALL SELECT sample_index, query_value, 'full_row', coalesce(nullif(concat_ws(chr(10), {_LINE("test_name: ", "query_value")}, {_LINE("spec_type_desc: ", "seg")}), ''), 'missing') FROM b)
        SELECT sample_index, query_value, prompt_type, s.shot_type, m.model, prompt, s.n AS n_messages FROM p, (VALUES ('zero_shot', 2::BIGINT), ('few_shot', 6::BIGINT)) s(shot_type, n), (VALUES ('model-a'), ('model-b')) m(model)""",
    "template_texts": f"""WITH {PEOPLE}, f AS (SELECT c_custkey, {_MISS(NAME)} AS v, concat_ws(', ', {_LINE("c_mktsegment ", SEGMENT)}, {_LINE("n_name ", NATION)}) AS facts FROM peo)
        SELECT c_custkey, v || CASE WHEN facts <> '' THEN ' with ' || facts ELSE '' END || '.' AS ai_text FROM f""",
    "seeded_sample": "SELECT event_id, user_id, event_type FROM events ORDER BY md5(event_id || '|7'), event_id LIMIT 50",
    "distinct_query_lookup": "SELECT p_partkey, p_name, n_rows, first_part FROM part LEFT JOIN (SELECT p_name AS n, count(*) AS n_rows, min(p_partkey) AS first_part FROM part WHERE p_name IS NOT NULL GROUP BY p_name) ON n = p_name",
    "jaccard_topk": f"WITH q AS (SELECT p_name AS query FROM part), pool AS (SELECT p_partkey AS concept_id, p_name AS term FROM part), {_jaccard('q', 'pool', 'jc')} SELECT * FROM jc",
    "ngram_postings": f"SELECT DISTINCT unnest({_grams('c')}) AS ngram, candidate FROM (SELECT p_partkey AS candidate, {_clean('p_name')} AS c FROM part)",
    "dense_topk": f"WITH {DENSE_OTHERS} SELECT query_id, pool_id, similarity, rank FROM top",
    "dense_topk_pairs": f"WITH {DENSE_OTHERS} SELECT query_id, pool_id, similarity, rank FROM top",
    "dense_topk_combined_source": f"WITH {DENSE.format(keep='')} SELECT query_id, pool_id, similarity, rank, CASE WHEN label % 2 = 0 THEN 'short_term' ELSE 'definition' END AS source FROM top JOIN embeddings ON vec_id = pool_id",
    "bm25_topk": f"WITH {ITEMS}, {FIELDED}, {_terms('items', 'tm')}, {_bm25('tm', 'fld', 'mm')} SELECT query, doc_id, score, rank FROM mm",
    "fuzzy_topk": f"""WITH typ AS (SELECT DISTINCT regexp_replace(p_name, '^(..).', '\\1') AS query FROM part), pool AS (SELECT min(p_partkey) AS doc_id, p_name AS term, '' AS definition FROM part GROUP BY p_name),
        {_fuzzy_terms("typ", "pool", "ft")}, {_bm25("ft", "pool", "fz")} SELECT query, doc_id, score, rank FROM fz""",
    "ancestors_depth_k": f"WITH e0 AS (SELECT 1), {GEO.replace('e AS (', 'e AS (SELECT DISTINCT ' + chr(39) + 'p' + chr(39) + ' || l_partkey AS child, ' + chr(39) + 's' + chr(39) + ' || l_suppkey AS parent FROM lineitem UNION ', 1)}, st AS (SELECT 'p' || p_partkey AS s FROM part), {_closure('st', 3)} SELECT s AS concept_id, anc AS ancestor, CAST(dist AS BIGINT) AS distance FROM clo",
    "ancestors_all": f"WITH {GEO}, st AS (SELECT 's' || s_suppkey AS s FROM supplier), {_closure('st', 5)} SELECT s AS concept_id, anc AS ancestor, CAST(dist AS BIGINT) AS distance FROM clo WHERE dist > 0",
    "common_ancestors": f"""WITH {GEO}, {PAIRS}, {_closure("(SELECT a AS s FROM p UNION SELECT b FROM p)", 3)}
        SELECT a, b, x.anc AS ancestor, CAST(x.dist AS BIGINT) AS distance_a, CAST(y.dist AS BIGINT) AS distance_b, CAST(x.dist + y.dist AS BIGINT) AS total_distance,
               row_number() OVER (PARTITION BY a, b ORDER BY x.dist + y.dist, greatest(x.dist, y.dist), x.anc) AS rank
        FROM p JOIN clo x ON x.s = a JOIN clo y ON y.s = b AND y.anc = x.anc""",
    "nearest_common_ancestor": f"""WITH {GEO}, {PAIRS}, {_closure("(SELECT a AS s FROM p UNION SELECT b FROM p)", 3)}
        SELECT a, b, ancestor, total_distance FROM (SELECT a, b, x.anc AS ancestor, CAST(x.dist + y.dist AS BIGINT) AS total_distance,
               row_number() OVER (PARTITION BY a, b ORDER BY x.dist + y.dist, greatest(x.dist, y.dist), x.anc) AS k
        FROM p JOIN clo x ON x.s = a JOIN clo y ON y.s = b AND y.anc = x.anc) WHERE k = 1""",
    "related_pairs_common": f"WITH {GEO}, {PAIRS}, {_related('p', 1, 'common')} SELECT p.a, p.b, rlt.a IS NOT NULL AS related FROM p LEFT JOIN rlt ON rlt.a = p.a AND rlt.b = p.b",
    "related_pairs_lineage": f"WITH {GEO}, {PAIRS}, {_related('p', 2, 'lineage')} SELECT p.a, p.b, rlt.a IS NOT NULL AS related FROM p LEFT JOIN rlt ON rlt.a = p.a AND rlt.b = p.b",
    "method_comparison": f"""WITH {MATCHES}, one AS (SELECT * FROM mat WHERE rank = 1)
        SELECT i.row_id, i.query AS test_name, {", ".join(f"CAST({m}.doc_id AS VARCHAR) AS {m}_concept_id, {m}.text AS {m}_match, {m}.score AS {m}_score" for m in ("multi_match", "jaccard"))}
        FROM items i {" ".join(f"LEFT JOIN one {m} ON {m}.query = i.query AND {m}.method = '{m}'" for m in ("multi_match", "jaccard"))}""",
    "vote_aggregation": f"WITH {LISTS}, {_votes(3)} SELECT row_id, concept_id, points, array_to_string(methods, ',') AS methods, ord FROM vot",
    "clusters": f"WITH RECURSIVE {CLUSTERS} SELECT row_id, concept_id, ord, cluster FROM clu",
    "cluster_common_ancestor": f"WITH RECURSIVE {CLUSTERS}, {_tops(2)} SELECT row_id, cluster, anc AS ancestor, CAST(total AS BIGINT) AS total_distance, CAST(most AS BIGINT) AS max_distance FROM top",
    "consensus_topk": f"WITH RECURSIVE {CONSENSUS} SELECT row_id, rank, concept_id, source, cp AS cluster_points, CAST(own AS BIGINT) AS concept_points, CAST(len(ms) AS BIGINT) AS n_methods FROM fin",
    "pipeline_end_to_end": f"""WITH RECURSIVE {_consensus(20, 10)}, lst AS (SELECT row_id, string_agg(concept_id, ',' ORDER BY rank) AS ids FROM fin GROUP BY row_id)
        SELECT i.row_id, i.query AS test_name, f.concept_id AS final_concept_id, coalesce(round_even(f.cp / 20.0::DOUBLE, 3), 0.0) AS support_score, CAST(coalesce(len(f.ms), 0) AS BIGINT) AS n_methods_agreeing,
               coalesce(l.ids, '') AS final_candidate_ids
        FROM items i LEFT JOIN fin f ON f.row_id = i.row_id AND f.rank = 1 LEFT JOIN lst l ON l.row_id = i.row_id""",
    "generated_texts": f"WITH {PEOPLE} SELECT c_custkey, 'customer|c_name|' || {NAME} || '|c_mktsegment=' || {SEGMENT} || '|n_name=' || {NATION} AS ai_key, {_MISS(NAME)} AS algorithm_ai_text, CAST(NULL AS VARCHAR) AS ai_error FROM peo",
    "experiment_outputs": f"""WITH b AS (SELECT c_custkey AS sample_index, {NAME} AS query_value, {SEGMENT} AS seg FROM customer),
        p AS (SELECT sample_index, 'named' AS prompt_type, {_MISS("query_value")} AS ai_output FROM b
              UNION ALL SELECT sample_index, 'values_only', coalesce(nullif(concat_ws(chr(10), nullif(query_value, ''), nullif(seg, '')), ''), 'missing') FROM b
              UNION ALL SELECT sample_index, 'full_row', coalesce(nullif(concat_ws(chr(10), {_LINE("test_name: ", "query_value")}, {_LINE("spec_type_desc: ", "seg")}), ''), 'missing') FROM b)
        SELECT sample_index, prompt_type, s.shot_type, m.model, ai_output FROM p, (VALUES ('zero_shot'), ('few_shot')) s(shot_type), (VALUES ('model-a'), ('model-b')) m(model)""",
    "null_counts": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "consensus_summary": f"""WITH RECURSIVE {CONSENSUS}, lst AS (SELECT row_id, string_agg(concept_id, ',' ORDER BY rank) AS ids FROM fin GROUP BY row_id)
        SELECT i.row_id, i.query AS test_name, f.concept_id AS final_concept_id, coalesce(round_even(f.cp / 5.0::DOUBLE, 3), 0.0) AS support_score, CAST(coalesce(len(f.ms), 0) AS BIGINT) AS n_methods_agreeing,
               coalesce(array_to_string(f.ms, ','), '') AS agreeing_methods, coalesce(l.ids, '') AS final_candidate_ids
        FROM items i LEFT JOIN fin f ON f.row_id = i.row_id AND f.rank = 1 LEFT JOIN lst l ON l.row_id = i.row_id""",
    "valid_code_sets": "SELECT CAST(label AS VARCHAR) AS code, string_agg(DISTINCT CAST(vec_id AS VARCHAR), ',' ORDER BY CAST(vec_id AS VARCHAR)) AS valid FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL GROUP BY 1",
    "hit_at_k_strict": f"WITH {HIT_BASE}, {_hits('a = b')} SELECT row_id, method, k, hit FROM hit",
    "hit_at_k_lineage": f"WITH {HIT_BASE}, {VECTOR_GRAPH}, {_related('hp', 2, 'lineage', 'g')}, {_hits(_KNOWN)} SELECT row_id, method, k, hit FROM hit",
    "hit_at_k_related": f"WITH {HIT_BASE}, {VECTOR_GRAPH}, {_related('hp', 1, 'common', 'g')}, {_hits(_KNOWN)} SELECT row_id, method, k, hit FROM hit",
    "method_scores": f"""WITH {HIT_BASE}, {VECTOR_GRAPH}, {_related("hp", 1, "common", "g")}, {_hits("a = b", "st")}, {_hits(_KNOWN, "rl")}
        SELECT 'dense' AS method, 'semantic' AS type, {", ".join(f"(SELECT round(avg(hit::INT), 6) FROM {t} WHERE k = {k}) AS {n}_hit_at_{k}" for t, n in (("st", "strict"), ("rl", "related")) for k in (1, 5))}""",
}
