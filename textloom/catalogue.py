"""The engine's queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import analyzer, postings, registry
from .operators import match, score, searchbox
from .sources.index import SearchIndex
from .sources.scratch import scratch
from .streaming.ingest import ingest

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}

TOKENS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '(?:\p{L}(?:[:.''][\p{L}])*|\p{Nd}(?:[,;.''][\p{Nd}])*|_)+'), lambda x: length(replace(x, '_', '')) > 0) AS raw FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, list_transform(raw, lambda x: lower(strip_accents(x))) AS terms FROM w),
tok AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM t)
"""
NAMES = r"""
WITH t AS (SELECT c_custkey, list_transform(regexp_extract_all(c_name, '[A-Za-z0-9]+'), lambda x: lower(x)) AS terms FROM customer)
"""


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def put(run: Run) -> Run:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return put


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")


def matching(name: str, q: str, where: str) -> None:
    """Documents that match, by id."""
    query(name, f"{TOKENS} SELECT doc_id FROM t WHERE {where}")(lambda spark, d: match.search(docs(spark, d), q).select("doc_id"))


def has(*terms: str) -> str:
    return " AND ".join(f"list_contains(terms, '{t}')" for t in terms)


def then(a: str, b: str, gap: int) -> str:
    return f"EXISTS (SELECT 1 FROM tok x JOIN tok y ON x.doc_id = y.doc_id WHERE x.doc_id = t.doc_id AND x.term = '{a}' AND y.term = '{b}' AND y.pos > x.pos AND y.pos - x.pos - 1 <= {gap})"


def adjacent(*slots: tuple[int, tuple[str, ...]]) -> str:
    first, *rest = slots
    quoted = lambda terms: ", ".join(f"'{t}'" for t in terms)
    joins = "".join(f" JOIN tok s{i} ON s{i}.doc_id = s.doc_id AND s{i}.pos = s.pos + {d - first[0]} AND s{i}.term IN ({quoted(terms)})" for i, (d, terms) in enumerate(rest))
    return f"doc_id IN (SELECT s.doc_id FROM tok s{joins} WHERE s.term IN ({quoted(first[1])}))"


# boolean queries

matching("term", "the", has("the"))
matching("and_terms", "in the and", has("in", "the", "and"))
matching("or_terms", "vicon OR tion OR und", "list_has_any(terms, ['vicon', 'tion', 'und'])")
matching("and_not", "the AND NOT tion -en", f"{has('the')} AND NOT {has('tion')} AND NOT {has('en')}")
matching("mixed_boolean", "the (of OR en) -er", f"{has('the')} AND ({has('of')} OR {has('en')}) AND NOT {has('er')}")
matching("nested_not", "the -(of -en)", f"{has('the')} AND NOT ({has('of')} AND NOT {has('en')})")
matching("list_any", "[der die, das] und", f"list_has_any(terms, ['der', 'die', 'das']) AND {has('und')}")
matching("all_of", "ALL OF [in the of]", has("in", "the", "of"))
_SOME = " + ".join(f"list_contains(terms, '{t}')::INT" for t in ("the", "of", "en", "und", "de"))
matching("at_least_n", "AT LEAST 2 OF [the of en und de]", f"{_SOME} >= 2")
matching("at_least_pct", "AT LEAST 55% OF [the of en und de]", f"{_SOME} >= 3")

# patterns

matching("prefix", "thon*", "len(list_filter(terms, lambda x: starts_with(x, 'thon'))) > 0")
matching("fragment", "*nthen*", "len(list_filter(terms, lambda x: contains(x, 'nthen'))) > 0")


def _swaps(q: str) -> list[str]:
    return [q[:i] + q[i + 1] + q[i] + q[i + 2 :] for i in range(len(q) - 1) if q[i] != q[i + 1]]


def osa1(t: str, q: str) -> str:
    return f"(levenshtein({t}, '{q}') <= 1 OR {t} IN ({', '.join(repr(s) for s in [*_swaps(q), q])}))"


def osa2(t: str, q: str) -> str:
    parts = [f"levenshtein({t}, '{q}') <= 2"]
    for i in range(len(q) - 1):
        if q[i] != q[i + 1]:
            a, w, b = q[:i], q[i + 1] + q[i], q[i + 2 :]
            parts.append(f"(starts_with({t}, '{a + w}') AND {osa1(f'substr({t}, {len(a) + 3})', b)})")
            parts.append(f"(ends_with({t}, '{w + b}') AND {osa1(f'substr({t}, 1, length({t}) - {len(w + b)})', a)})")
    return f"({' OR '.join(parts)})"


def named(name: str, q: str, where: str) -> None:
    query(name, f"{NAMES} SELECT c_custkey FROM t WHERE {where}")(lambda spark, d: match.search(customers(spark, d), q, "c_name").select("c_custkey"))


def any_term(condition: str) -> str:
    return f"len(list_filter(terms, lambda x: {condition})) > 0"


named("fuzzy1", "000000120~", any_term(osa1("x", "000000120")))
named("fuzzy2", "000000102~2", any_term(osa2("x", "000000102")))
named("pattern_combo", "0000001* -*9* customr~", f"{any_term("starts_with(x, '0000001')")} AND NOT {any_term("contains(x, '9')")} AND {any_term(osa1('x', 'customr'))}")

# positions

matching("phrase", '"of the"', adjacent((0, ("of",)), (1, ("the",))))
matching("phrase_gap", '"the _ of"', adjacent((0, ("the",)), (2, ("of",))))
matching("phrase_alts", '"[in of to] the"', adjacent((0, ("in", "of", "to")), (1, ("the",))))
matching("phrase_slop", '"of in the"~3', """doc_id IN (SELECT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.term = 'of' AND b.term = 'in' AND b.pos BETWEEN a.pos + 1 AND a.pos + 4
JOIN tok c ON a.doc_id = c.doc_id AND c.term = 'the' AND c.pos > b.pos AND c.pos - a.pos <= 5)""")
matching("then_n", "of THEN/2 the", then("of", "the", 2))
matching("near_n", "and NEAR/1 to", f"({then('and', 'to', 1)} OR {then('to', 'and', 1)})")
matching("near_phrase", '"of the" NEAR/3 and', """doc_id IN (SELECT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.term = 'of' AND b.term = 'the' JOIN tok c ON c.doc_id = a.doc_id AND c.term = 'and'
AND ((c.pos > b.pos AND c.pos - b.pos - 1 <= 3) OR (c.pos < a.pos AND a.pos - c.pos - 1 <= 3)))""")

# the analyzer


@query("analyze_terms", f"{TOKENS} SELECT doc_id, len(terms) AS n_words, md5(array_to_string(terms, ' ')) AS words_md5 FROM t")
def analyze_terms(spark: SparkSession, d: str) -> DataFrame:
    words = match.analyzed(docs(spark, d))
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5"))


@query("unique_terms", f"{TOKENS} SELECT doc_id, len(list_distinct(terms)) AS n_terms, md5(array_to_string(list_sort(list_distinct(terms)), ' ')) AS terms_md5 FROM t")
def unique_terms(spark: SparkSession, d: str) -> DataFrame:
    words = match.analyzed(docs(spark, d)).select("doc_id", F.array_sort(F.array_distinct(F.filter("words", analyzer.is_term))).alias("terms"))
    return words.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


@query("term_positions", f"{TOKENS} SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM tok WHERE term IN ('the', 'of', 'und', 'de') GROUP BY doc_id, term")
def term_positions(spark: SparkSession, d: str) -> DataFrame:
    words = match.analyzed(docs(spark, d)).select("doc_id", F.posexplode("words").alias("pos", "term")).filter(F.col("term").isin("the", "of", "und", "de"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"))


@query("grams4", NAMES + ", m AS (SELECT DISTINCT unnest(terms) || chr(2) AS m FROM t), g AS (SELECT DISTINCT m, substr(m, i::BIGINT, 4) AS gram FROM m, range(1, 60) r(i) WHERE i + 3 <= length(m)) SELECT replace(gram, chr(2), '$') AS gram, count(*) AS terms FROM g GROUP BY gram")
def grams4(spark: SparkSession, d: str) -> DataFrame:
    terms = customers(spark, d).select(F.explode(analyzer.unique_terms(F.col("c_name"))).alias("term")).distinct()
    grams = terms.select(F.explode(analyzer.grams(F.col("term"))).alias("gram"))
    return grams.groupBy(F.replace("gram", F.lit("\u0002"), F.lit("$")).alias("gram")).agg(F.count("*").alias("terms"))


# aggregates


@query("count_matches", f"{TOKENS} SELECT count(*) AS n FROM t WHERE {has('the')} AND NOT {has('tion')}")
def count_matches(spark: SparkSession, d: str) -> DataFrame:
    return match.search(docs(spark, d), "the -tion").agg(F.count("*").alias("n"))


@query("doc_freq", f"{TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term HAVING count(DISTINCT doc_id) >= 5")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    terms = match.analyzed(docs(spark, d)).select(F.explode(F.array_distinct(F.filter("words", analyzer.is_term))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 5")


@query("doc_stats", f"{TOKENS} SELECT count(*) AS docs, sum(len(list_distinct(terms)))::BIGINT AS postings, round(avg(len(list_distinct(terms))), 6) AS average FROM t")
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    terms = docs(spark, d).select("text").filter("text IS NOT NULL").mapInArrow(postings.lengths, "n int")
    return terms.agg(F.count("*").alias("docs"), F.sum("n").alias("postings"), F.round(F.avg("n"), 6).alias("average"))


@query("freq_class", f"{TOKENS}, f AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term), n AS (SELECT count(*) AS n FROM t) SELECT CASE WHEN df >= 0.01 * n THEN 'high' WHEN df >= 0.0001 * n THEN 'medium' ELSE 'rare' END AS class, count(*) AS terms, sum(df)::BIGINT AS postings FROM f, n GROUP BY 1")
def freq_class(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, docs(spark, d)).frequency_classes()


# the search box


def tier_sql(q: str, max_typos: int = 2) -> str:
    """The tier of a row's terms for a query, null: none."""
    out = []
    for t in searchbox.box_terms(q):
        cases = [f"WHEN x = '{t}' THEN 0", f"WHEN starts_with(x, '{t}') THEN 1"]
        if len(t) >= 3:
            cases.append(f"WHEN contains(x, '{t}') THEN 2")
        if len(t) >= 4 and max_typos >= 1:
            cases.append(f"WHEN {osa1('x', t)} THEN 3")
        if len(t) >= 7 and max_typos >= 2:
            cases.append(f"WHEN {osa2('x', t)} THEN 4")
        out.append(f"list_min(list_transform(terms, lambda x: CASE {' '.join(cases)} END))")
    return f"CASE WHEN {' AND '.join(f'{o} IS NOT NULL' for o in out)} THEN greatest({', '.join(out)}) END"


BOX, FILTERED = "customer 00000012", "000000102"


@query("search_box", f"{NAMES} SELECT c_custkey, tier::INT AS tier FROM (SELECT c_custkey, {tier_sql(BOX)} AS tier FROM t) WHERE tier IS NOT NULL")
def search_box(spark: SparkSession, d: str) -> DataFrame:
    return searchbox.ranked(customers(spark, d), BOX, "c_name").select("c_custkey", "tier")


@query("search_box_typos1", f"{NAMES} SELECT c_custkey, tier::INT AS tier FROM (SELECT c_custkey, {tier_sql(BOX, 1)} AS tier FROM t) WHERE tier IS NOT NULL")
def search_box_typos1(spark: SparkSession, d: str) -> DataFrame:
    return searchbox.ranked(customers(spark, d), BOX, "c_name", 1).select("c_custkey", "tier")


@query("search_box_top", f"{NAMES} SELECT c_custkey, tier::INT AS tier FROM (SELECT c_custkey, {tier_sql(BOX)} AS tier FROM t) WHERE tier IS NOT NULL ORDER BY tier, c_custkey LIMIT 10")
def search_box_top(spark: SparkSession, d: str) -> DataFrame:
    return searchbox.top(customers(spark, d), BOX, 10, "c_custkey", "c_name").select("c_custkey", "tier")


@query("search_box_distance", f"{NAMES} SELECT c_custkey, coalesce({tier_sql(FILTERED)}::DOUBLE, 9) AS distance FROM t")
def search_box_distance(spark: SparkSession, d: str) -> DataFrame:
    found = customers(spark, d)
    tier = searchbox.distance(searchbox.tier_column(FILTERED, analyzer.folded(F.col("c_name"))))
    return found.select("c_custkey", F.when(tier == float("inf"), 9.0).otherwise(tier).alias("distance"))


@query("search_box_filtered", f"{NAMES} SELECT c_custkey, coalesce({tier_sql(FILTERED)}, 5)::INT AS tier FROM t WHERE {any_term("starts_with(x, '00000010')")} ORDER BY tier, c_custkey LIMIT 20")
def search_box_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = match.search(customers(spark, d), "00000010*", "c_name")
    return searchbox.top_with_rest(rows, FILTERED, 20, "c_custkey", "c_name").select("c_custkey", "tier")


@query("search_fallback", f"{NAMES}, r AS (SELECT c_custkey, {tier_sql('0000012')} AS tier FROM t), m AS (SELECT min(tier) AS least FROM r) SELECT c_custkey, tier::INT AS tier FROM r, m WHERE tier <= greatest(least, 1) ORDER BY tier, c_custkey LIMIT 10")
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    return searchbox.fallback(customers(spark, d), "0000012", 10, "c_custkey", "c_name").select("c_custkey", "tier")


@query("plain_search", """
WITH g AS (SELECT c_custkey, list_distinct(list_transform(range(1, length('  ' || lower(c_name) || ' ') - 1), lambda i: substr('  ' || lower(c_name) || ' ', i, 3))) AS g FROM customer),
s AS (SELECT c_custkey, len(list_intersect(g, q))::DOUBLE / (len(g) + len(q) - len(list_intersect(g, q))) AS similarity FROM g, (SELECT list_distinct(list_transform(range(1, length('  customer#000000102 ') - 1), lambda i: substr('  customer#000000102 ', i, 3))) AS q))
SELECT c_custkey, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.5 ORDER BY similarity DESC, c_custkey LIMIT 10""")
def plain_search(spark: SparkSession, d: str) -> DataFrame:
    """Trigram similarity, the comparison that needs no index of terms."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))
    own, other = grams(F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "))), grams(F.lit("  customer#000000102 "))
    common = F.size(F.array_intersect(own, other))
    found = customers(spark, d).select("c_custkey", (common / (F.size(own) + F.size(other) - common)).alias("similarity"))
    return found.filter("similarity >= 0.5").orderBy(F.desc("similarity"), "c_custkey").limit(10).select("c_custkey", F.round("similarity", 6).alias("similarity"))


# scores


def bm25_sql(weights: dict[str, float], where: str, outer: str) -> str:
    listed = ", ".join(f"('{t}', {w})" for t, w in weights.items())
    return f"""{TOKENS}, q(term, weight) AS (VALUES {listed}), n AS (SELECT count(*)::DOUBLE AS n, sum(len(list_distinct(terms)))::DOUBLE / count(*) AS average FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT tf.doc_id, sum(weight * ln(1 + greatest(n - df + 0.5, 0) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(list_distinct(terms)) / greatest(average, 1)))) AS score
FROM tf JOIN df USING (term) JOIN q USING (term) JOIN t ON t.doc_id = tf.doc_id, n WHERE {where} GROUP BY tf.doc_id) {outer}"""


EITHER = f"({has('vicon')} OR {has('of')})"


@query("bm25_score", bm25_sql({"vicon": 1, "of": 1}, EITHER, "SELECT doc_id, round(score, 6) AS score FROM s"))
def bm25_score(spark: SparkSession, d: str) -> DataFrame:
    return score.scores(docs(spark, d), "vicon OR of").select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_topk", bm25_sql({"und": 1, "the": 1}, "true", "SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, doc_id LIMIT 10"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return score.top(docs(spark, d), "und OR the", 10).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_boost", bm25_sql({"of": 2.5, "the": 1}, f"{has('of', 'the')} AND NOT {has('en')}", "SELECT doc_id, round(score, 6) AS score FROM s"))
def bm25_boost(spark: SparkSession, d: str) -> DataFrame:
    return score.scores(docs(spark, d), "of^2.5 the -en").select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_explain")
def bm25_explain(spark: SparkSession, d: str) -> DataFrame:
    return score.explain(docs(spark, d), '"of the" und^2').select("doc_id", F.to_json("explanation").alias("explanation"))


@query("bm25_explain_terms", f"""{TOKENS}, q(term, weight) AS (VALUES ('of', 1), ('the', 1), ('und', 2)), n AS (SELECT count(*)::DOUBLE AS n, sum(len(list_distinct(terms)))::DOUBLE / count(*) AS average FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT term, weight, df, ln(1 + greatest(n - df + 0.5, 0) / (df + 0.5)) AS idf FROM df JOIN q USING (term), n),
m AS (SELECT doc_id, {adjacent((0, ('of',)), (1, ('the',)))} AND {has('und')} AS matches FROM t)
SELECT tf.doc_id, tf.term, tf::BIGINT AS tf, df::BIGINT AS df, weight::DOUBLE AS weight, round(idf, 6) AS idf, round(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(list_distinct(terms)) / greatest(average, 1))), 6) AS score, matches
FROM tf JOIN i USING (term) JOIN t ON t.doc_id = tf.doc_id JOIN m ON m.doc_id = tf.doc_id, n""")
def bm25_explain_terms(spark: SparkSession, d: str) -> DataFrame:
    """What bm25_explain says of each term, as rows."""
    found = score.explain(docs(spark, d), '"of the" und^2').select("doc_id", "explanation.matches", F.explode("explanation.terms").alias("x"))
    return found.select("doc_id", "matches", "x.term", F.col("x.tf").cast("long").alias("tf"), "x.df", "x.weight", "x.idf", "x.score")


# highlighting


def _marked(name: str, column) -> None:
    query(name)(lambda spark, d: match.search(docs(spark, d), '"of the" OR und').select("doc_id", column().alias(name)))


_marked("highlight", lambda: registry.function(registry.highlight, "string", registry.pa.string())(F.col("text"), F.lit('"of the" OR und')))
_marked("snippet", lambda: registry.function(registry.snippet, "string", registry.pa.string())(F.col("text"), F.lit('"of the" OR und')))


@query("sql_functions", f"{TOKENS} SELECT doc_id FROM t WHERE {has('of')} AND {has('the')}")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    registry.register(spark)
    docs(spark, d).createOrReplaceTempView("textloom_documents")
    return spark.sql("SELECT doc_id FROM textloom_documents WHERE text_match(text, 'of the')")


@query("query_table_join", f"{TOKENS} SELECT 'the -tion' AS q, doc_id FROM t WHERE {has('the')} AND NOT {has('tion')} UNION ALL SELECT 'und' AS q, doc_id FROM t WHERE {has('und')} UNION ALL SELECT '\"of the\"' AS q, doc_id FROM t WHERE {adjacent((0, ('of',)), (1, ('the',)))}")
def query_table_join(spark: SparkSession, d: str) -> DataFrame:
    return match.search_many(docs(spark, d), ["the -tion", "und", '"of the"'])


# the index


def build(spark: SparkSession, rows: DataFrame, grams: bool = False, key: str = "doc_id", text: str = "text") -> SearchIndex:
    return SearchIndex.build(rows, scratch(spark, "index"), key, text, grams)


@query("index_search", ORACLE_SQL["mixed_boolean"])
def index_search(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, docs(spark, d)).ids("the (of OR en) -er")


@query("index_phrase", ORACLE_SQL["phrase_alts"])
def index_phrase(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, docs(spark, d)).ids('"[in of to] the"')


@query("index_slop", ORACLE_SQL["phrase_slop"])
def index_slop(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, docs(spark, d)).ids('"of in the"~3')


@query("index_nested_not", ORACLE_SQL["nested_not"])
def index_nested_not(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, docs(spark, d)).ids("the -(of -en)")


@query("index_fragment", f"{NAMES} SELECT c_custkey AS doc_id FROM t WHERE {any_term("contains(x, '0012')")} OR {any_term("contains(x, '102')")}")
def index_fragment(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, customers(spark, d), True, "c_custkey", "c_name").ids("*0012* OR *102*")


@query("index_box", f"{NAMES} SELECT c_custkey AS doc_id, tier::INT AS tier FROM (SELECT c_custkey, {tier_sql(BOX)} AS tier FROM t) WHERE tier IS NOT NULL")
def index_box(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, customers(spark, d), False, "c_custkey", "c_name").box(BOX)


@query("index_bm25", ORACLE_SQL["bm25_boost"])
def index_bm25(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, docs(spark, d)).score("of^2.5 the -en").select("doc_id", F.round("score", 6).alias("score"))


@query("index_after_append", ORACLE_SQL["mixed_boolean"])
def index_after_append(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, docs(spark, d).filter("doc_id % 3 <> 0"))
    index.append(docs(spark, d).filter("doc_id % 3 = 0"))
    return index.ids("the (of OR en) -er")


@query("index_after_upsert", f"{TOKENS} SELECT doc_id FROM t WHERE {has('the')} AND doc_id % 5 <> 0")
def index_after_upsert(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, docs(spark, d))
    index.upsert(docs(spark, d).filter("doc_id % 5 = 0").withColumn("text", F.lit("replaced")))
    return index.ids("the")


@query("index_after_delete", f"{TOKENS} SELECT doc_id FROM t WHERE {has('the')} AND doc_id % 4 <> 1")
def index_after_delete(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, docs(spark, d))
    index.delete(docs(spark, d).filter("doc_id % 4 = 1"))
    return index.ids("the")


@query("index_compacted", f"{TOKENS} SELECT doc_id FROM t WHERE {has('of')} AND doc_id % 4 <> 1")
def index_compacted(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, docs(spark, d).filter("doc_id % 2 = 0"))
    index.append(docs(spark, d).filter("doc_id % 2 = 1"))
    index.delete(docs(spark, d).filter("doc_id % 4 = 1"))
    index.vacuum()
    return index.ids("of")


@query("index_prefix", f"{TOKENS} SELECT doc_id FROM t WHERE len(list_filter(terms, lambda x: starts_with(x, 'thon'))) > 0 AND NOT {has('of')}")
def index_prefix(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, docs(spark, d)).ids("thon* -of")


@query("index_typo", f"{NAMES} SELECT c_custkey AS doc_id FROM t WHERE {any_term(osa1('x', '000000120'))}")
def index_typo(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, customers(spark, d), False, "c_custkey", "c_name").ids("000000120~")


@query("index_box_top", f"{NAMES} SELECT c_custkey AS doc_id, tier::INT AS tier FROM (SELECT c_custkey, {tier_sql(BOX)} AS tier FROM t) WHERE tier IS NOT NULL ORDER BY tier, doc_id LIMIT 10")
def index_box_top(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, customers(spark, d), False, "c_custkey", "c_name").box_top(BOX, 10)


@query("index_rows", f"{TOKENS} SELECT t.doc_id, md5(text) AS digest FROM t JOIN documents USING (doc_id) WHERE {has('the')} AND NOT {has('of')}")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, docs(spark, d)).search("the -of").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("index_merged_when_due", f"{TOKENS} SELECT doc_id, 1 AS segments FROM t WHERE {has('of')} AND doc_id % 4 <> 1")
def index_merged_when_due(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, docs(spark, d).filter("doc_id % 2 = 0"))
    index.append(docs(spark, d).filter("doc_id % 2 = 1"))
    index.delete(docs(spark, d).filter("doc_id % 4 = 1"))
    if index.due():
        index.compact()
    index.verify()
    return index.ids("of").withColumn("segments", F.lit(index.segments().count()))


@query("index_truncated", f"{TOKENS} SELECT doc_id FROM t WHERE {has('of')} AND doc_id % 3 = 0")
def index_truncated(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, docs(spark, d))
    index.truncate()
    index.append(docs(spark, d).filter("doc_id % 3 = 0"))
    return index.ids("of")


@query("index_selectivity", f"""{TOKENS}, s AS (SELECT avg(({has('the')})::INT) AS a, avg(({has('of')})::INT) AS b FROM t)
SELECT round(a, 6) AS one, round(a * b, 6) AS both, round(1 - (1 - a) * (1 - b), 6) AS either FROM s""")
def index_selectivity(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, docs(spark, d))
    return spark.createDataFrame([tuple(round(index.selectivity(q), 6) for q in ("the", "the of", "the OR of"))], "one double, both double, either double")


@query("segment_stats", f"{TOKENS} SELECT (doc_id % 2 = 1) AS pending, count(*) AS docs, sum(len(list_distinct(terms)))::BIGINT AS postings FROM t GROUP BY 1")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, docs(spark, d).filter("doc_id % 2 = 0"))
    index.append(docs(spark, d).filter("doc_id % 2 = 1"))
    return index.segments().select("pending", "docs", "postings")


@query("index_stats", "SELECT 1 AS segments, count(*) FILTER (doc_id % 4 <> 1) AS live_docs, count(*) FILTER (doc_id % 2 = 1) AS pending_docs, 3 AS generation FROM documents WHERE text IS NOT NULL")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, docs(spark, d).filter("doc_id % 2 = 0"))
    index.append(docs(spark, d).filter("doc_id % 2 = 1"))
    index.delete(docs(spark, d).filter("doc_id % 4 = 1"))
    return index.stats().select("segments", "live_docs", "pending_docs", "generation")


@query("stream_ingest", f"{TOKENS} SELECT doc_id FROM t WHERE {has('in', 'the')}")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    index = SearchIndex.empty(spark, scratch(spark, "index"))
    rows = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parquet*")
    ingest(rows, index, scratch(spark, "offsets")).awaitTermination()
    return index.refresh().ids("in the")


#: (kind, query, the row that it was made from)
ASKED = [("exact", "000000012", 12), ("exact", "customer 000000120", 120), ("prefix", "00000010", 103), ("swapped", "000000210", 120), ("swapped", "cutsomer 000000045", 45), ("absent", "zzzzzzzzz", 7)]


def metrics_sql() -> str:
    tops = " UNION ALL ".join(f"SELECT * FROM (SELECT {i} AS i, c_custkey, row_number() OVER (ORDER BY tier, c_custkey) AS place FROM (SELECT c_custkey, {tier_sql(q)} AS tier FROM t) WHERE tier IS NOT NULL) WHERE place <= 10" for i, (_, q, _) in enumerate(ASKED))
    asked = ", ".join(f"({i}, '{kind}', {target})" for i, (kind, _, target) in enumerate(ASKED))
    return f"""{NAMES}, top AS ({tops}), a(i, kind, target) AS (VALUES {asked}),
r AS (SELECT i, kind, coalesce(max((c_custkey = target AND place = 1)::INT), 0) AS first, coalesce(max((c_custkey = target)::INT), 0) AS ten, count(c_custkey) AS found FROM a LEFT JOIN top USING (i) GROUP BY i, kind)
SELECT kind, count(*) AS queries, round(avg(first), 6) AS hit_at_1, round(avg(ten), 6) AS hit_at_10, round(avg(ten / greatest(found, 1)), 6) AS precision_at_10, round(avg((found = 0)::INT), 6) AS empty_rate FROM r GROUP BY kind"""


@query("retrieval_metrics", metrics_sql())
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How often the search box finds the row that a query was made from, by kind of query."""
    index = build(spark, customers(spark, d), False, "c_custkey", "c_name")
    # ten rows of each stated query: a window over these orders no more than that
    place = F.row_number().over(Window.partitionBy("i").orderBy("tier", "doc_id"))
    found = match.union(index.box_top(q, 10).withColumn("i", F.lit(i)) for i, (_, q, _) in enumerate(ASKED)).withColumn("place", place)
    asked = spark.createDataFrame([(i, kind, target) for i, (kind, _, target) in enumerate(ASKED)], "i int, kind string, target long")
    hit = F.coalesce(F.col("doc_id") == F.col("target"), F.lit(False))
    each = asked.join(found, "i", "left").groupBy("i", "kind").agg(F.max((hit & (F.col("place") == 1)).cast("int")).alias("first"), F.max(hit.cast("int")).alias("ten"), F.count("doc_id").alias("found"))
    mean = lambda c: F.round(F.avg(c), 6)
    return each.groupBy("kind").agg(F.count("*").alias("queries"), mean("first").alias("hit_at_1"), mean("ten").alias("hit_at_10"), mean(F.col("ten") / F.greatest("found", F.lit(1))).alias("precision_at_10"), mean((F.col("found") == 0).cast("int")).alias("empty_rate"))
