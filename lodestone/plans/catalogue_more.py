"""Queries of chunks, sources, answers and evaluation, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import answers, chunking, evaluation, ingest, profile_checks, profiles, quality
from lodestone.plans import oracle_text as O
from lodestone.plans.catalogue import _t, query
from lodestone.sources.shared import spread


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each as one page, cut into chunks."""
    pages = spread(_t(spark, sf_dir, "documents").select("doc_id", "text")).select(ingest.fingerprint(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text"))).alias("document_hash"), F.lit(1).alias("page_number"), chunking.page_text(F.col("text")).alias("text"))
    return chunking.chunk_documents(pages)


@query("SELECT lang AS section_name, count(*) AS n_chunks, count_if(length(text) < 80) AS n_small FROM documents GROUP BY lang")
def section_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, languages as sections."""
    return chunking.section_histogram(_t(spark, sf_dir, "documents").withColumn("section_name", F.col("lang")))


@query("SELECT l_orderkey, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN CAST(min(l_linenumber) AS VARCHAR) ELSE min(l_linenumber) || '-' || max(l_linenumber) END AS page_label FROM lineitem GROUP BY l_orderkey")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as pages."""
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(chunking.page_label(F.collect_set("l_linenumber")).alias("page_label"))


@query("""WITH e AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, doc_id, [lang, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END, 'unnamed'] AS keys FROM documents)
SELECT source || '-source-' || CAST(place AS VARCHAR) AS source_id, source AS candidate_id, doc_id AS chunk_id, array_to_string(list_filter([CASE k WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'long' THEN 'a long text' WHEN 'short' THEN 'a short text' END FOR k IN keys], lambda x: x IS NOT NULL), '|') AS supports FROM e""")
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence of their sources, with some conditions' labels."""
    from pyspark.sql.window import Window as W

    keys = F.array("lang", F.when(F.col("n_chars") > 500, "long").otherwise("short"), F.lit("unnamed"))
    evidence = _t(spark, sf_dir, "documents").select(F.col("source").alias("candidate_id"), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("place"), F.col("doc_id").alias("chunk_id"), keys.alias("keys"))
    labels = spark.createDataFrame([("en", "English"), ("de", "German"), ("long", "a long text"), ("short", "a short text")], "key string, label string")
    return answers.sources(evidence, labels).select("source_id", "candidate_id", "chunk_id", F.array_join("supports", "|").alias("supports"))


@query("""WITH a AS (SELECT user_id AS q, CASE WHEN bool_or(event_type = 'purchase') THEN 'supported' WHEN bool_or(event_type = 'signup') THEN 'partial' ELSE 'unsupported' END AS outcome FROM events GROUP BY 1),
c AS (SELECT user_id AS q, CAST(event_id AS VARCHAR) AS s FROM events WHERE event_type IN ('click', 'view')), k AS (SELECT user_id AS q, CAST(event_id AS VARCHAR) AS s, 'b' || CAST(CAST(value AS BIGINT) % 3 AS VARCHAR) AS o FROM events WHERE event_type IN ('view', 'error')),
x AS (SELECT DISTINCT q, o FROM k), m AS (SELECT c.*, outcome, o FROM c JOIN a USING (q) LEFT JOIN k USING (q, s))
SELECT DISTINCT q AS question_id, CAST(NULL AS VARCHAR) AS subject, 'citation_when_unsupported' AS problem FROM m WHERE outcome = 'unsupported' UNION ALL SELECT q, NULL, 'no_citation' FROM a WHERE outcome <> 'unsupported' AND q NOT IN (SELECT q FROM c)
UNION ALL SELECT DISTINCT q, s, 'unknown_answer_source' FROM m WHERE outcome <> 'unsupported' AND o IS NULL UNION ALL SELECT x.q, x.o, 'missing_candidate' FROM x JOIN a USING (q) WHERE outcome <> 'unsupported' AND NOT EXISTS (SELECT 1 FROM m WHERE m.q = x.q AND m.o = x.o)""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as questions; clicks and views cite, views and errors are the sources there are."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").cast("string").alias("source_id"), "event_type", F.concat(F.lit("b"), (F.rint("value").cast("long") % 3).cast("string")).alias("owner"))
    kind = F.max(F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0))
    outcome = e.groupBy("question_id").agg(F.get(F.array(*map(F.lit, ("unsupported", "partial", "supported"))), kind).alias("outcome"))
    known = e.where("event_type IN ('view', 'error')")
    return answers.answer_problems(outcome, e.where("event_type IN ('click', 'view')").select("question_id", "source_id"), known, known.select("question_id", F.col("owner").alias("candidate_id")))


@query("""WITH r AS (SELECT user_id, list_distinct(list(event_type)) AS got, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS size, bool_and(value > 1) AS traced FROM events GROUP BY user_id),
s AS (SELECT user_id, CASE WHEN n > 6 THEN ['click', 'view'] ELSE [] END AS want, got, n, size, traced, CASE WHEN list_contains(got, 'purchase') THEN 'supported' ELSE 'unsupported' END AS outcome FROM r),
f AS (SELECT *, list_filter(want, lambda x: NOT list_contains(got, x)) AS missing, list_filter(got, lambda x: NOT list_contains(want, x)) AS extra, size <= 90 AND n <= 12 AS inside FROM s)
SELECT user_id AS scenario_id, outcome, len(missing) AS n_missing, len(extra) AS n_unexpected, inside AS budget_compliant, (CASE WHEN len(want) > 0 THEN outcome <> 'unsupported' AND len(missing) = 0 ELSE outcome = 'unsupported' AND len(got) = 0 END) AND traced AND inside AS passed FROM f""")
def scenario_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as scenarios, their event types as returned ids."""
    g = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scenario_id")).agg(F.collect_set("event_type").alias("returned"), F.count("*").alias("n_chunks"), F.sum(F.length("props")).alias("n_chars"), F.min(F.col("value") > 1).alias("source_traceable"))
    wanted = g.select("scenario_id", F.when(F.col("n_chunks") > 6, F.array(F.lit("click"), F.lit("view"))).alias("expected"))
    runs = g.select("*", F.when(F.array_contains("returned", "purchase"), "supported").otherwise("unsupported").alias("outcome"), F.lit(90).alias("most_chars"), F.lit(12).alias("most_chunks"))
    return evaluation.scenarios(wanted, runs).select("scenario_id", "outcome", F.size("missing").cast("long").alias("n_missing"), F.size("unexpected").cast("long").alias("n_unexpected"), "budget_compliant", "passed")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS years FROM part""")
def stated_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences about years from part sizes: two forms that claim experience, and one that doesn't."""
    n = F.col("p_size").cast("string")
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("An engineer who has "), n, F.lit(" years behind them"))).when(F.col("p_partkey") % 3 == 1, F.concat(n, F.lit("+ years of data experience"))).otherwise(F.concat(F.lit("Lasted "), n, F.lit(" years")))
    return _t(spark, sf_dir, "part").select("p_partkey", quality.stated_years(s).alias("years"))


@query("""SELECT lower(source) AS candidate_key, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def repeated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.repeated_candidates(_t(spark, sf_dir, "documents").select(F.col("source").alias("candidate_id")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 4) AND p_size >= 10 THEN 1.0 ELSE 0.0 END AS at_least, CASE WHEN p_partkey % 5 IN (2, 3, 4) AND p_size < 10 THEN 1.0 ELSE 0.0 END AS below, CASE WHEN p_partkey % 5 = 4 AND p_size = 10 THEN 1.0 ELSE 0.0 END AS exactly FROM part""")
def numeric_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team sizes that come with a comparison of their own, against three wanted ones."""
    from lodestone.functions import text as T
    from lodestone.operators import evidence as E

    words = F.get(F.array(*map(F.lit, ("at least ", "more than ", "up to ", "under ", ""))), (F.col("p_partkey") % 5).cast("int"))
    text = F.concat(F.lit("Managed "), words, F.col("p_size").cast("string"), F.lit(" engineers. Joined in 2010"))
    # Through a generator, so that the three wanted ones don't search the clauses again.
    found = spread(_t(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.explode(F.array(E.numbers(T.clauses(text)))).alias("found"))
    none = F.array().cast("array<array<string>>")
    each = (E.numeric_of(F.col("found"), F.lit(10.0), F.lit(op), F.lit("team_size"), none).alias(name) for op, name in (("gte", "at_least"), ("lt", "below"), ("eq", "exactly")))
    return found.select("p_partkey", *each)


@query(f"""WITH n AS (SELECT doc_id, {O.canonical_terms('text')} AS terms, array_to_string({O.tokens('text')}, ' ') AS said FROM documents)
SELECT doc_id, round(least(1.0, (CASE WHEN list_contains(terms, 'the') THEN 1.0 ELSE 0.0 END + CASE WHEN list_contains(terms, 'und') THEN 1.0 ELSE 0.0 END) / 2 + 0.15 * (CASE WHEN contains(said, 'of the') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(said, 'und die') THEN 1.0 ELSE 0.0 END) / 2), 6) AS lexical FROM n""")
def lexical_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of terms and of phrases in one score."""
    from lodestone.functions import text as T
    from lodestone.operators import evidence as E

    d = _t(spark, sf_dir, "documents").select("doc_id", T.canonical_terms(F.col("text")).alias("terms"), T.normalized(F.col("text")).alias("said"))
    return d.select("doc_id", F.round(E.lexical(F.col("terms"), F.col("said"), ["the", "und"], ["of the", "und die"]), 6).alias("lexical"))


@query("""WITH s AS (SELECT 'candidate_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS c, CAST(n_nationkey + 1 AS INTEGER) AS p, CASE WHEN n_nationkey = 7 THEN upper((SELECT n_name FROM nation WHERE n_nationkey = 3)) ELSE n_name END AS f FROM nation),
x AS (SELECT r_name AS s, 'candidate_' || lpad(CAST(r_regionkey * 9 AS VARCHAR), 3, '0') AS c FROM region)
SELECT CAST(count(*) AS VARCHAR) AS subject, 'slot_count' AS problem FROM s HAVING count(*) <> 24 UNION ALL SELECT c, 'out_of_order' FROM s WHERE c <> 'candidate_' || lpad(CAST(p AS VARCHAR), 3, '0')
UNION ALL SELECT lower(f), 'repeated_name' FROM s GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT r_name, 'policy_off' FROM region WHERE r_regionkey > 2 UNION ALL SELECT x.s || ':' || x.c, 'unknown_candidate' FROM x WHERE c NOT IN (SELECT c FROM s)""")
def plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as slots, one too low and one name twice; regions as scenarios and policies."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    third = F.upper(F.lit(n.where("n_nationkey = 3").first()["n_name"]))
    key = F.col("n_nationkey").cast("int")
    slots = n.select(F.format_string("candidate_%03d", key).alias("candidate_id"), (key + 1).alias("place"), F.when(key == 7, third).otherwise(F.col("n_name")).alias("full_name"))
    wanted = r.select(F.col("r_name").alias("scenario_id"), F.array(F.format_string("candidate_%03d", (F.col("r_regionkey") * 9).cast("int"))).alias("expected"))
    return profiles.plan_problems(slots, wanted, r.select(F.col("r_name").alias("name"), (F.col("r_regionkey") <= 2).alias("enabled")), 24)


@query("""WITH n AS (SELECT n_regionkey AS r, list(n_name ORDER BY n_nationkey) AS planned, count(*) AS n FROM nation GROUP BY 1), s AS (SELECT n_regionkey AS r, list(n_name ORDER BY s_suppkey) AS described FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY 1),
p AS (SELECT n.r, planned, n, coalesce(described, []) AS described FROM n LEFT JOIN s USING (r))
SELECT r AS n_regionkey, problem FROM p, unnest([CASE WHEN len(planned) <> n THEN 'wrong_count' END, CASE WHEN len(list_distinct(planned)) < len(planned) THEN 'repeated_planned' END, CASE WHEN list_sort(planned) <> planned THEN 'unordered_planned' END,
CASE WHEN len(list_distinct(described)) < len(described) THEN 'repeated_described' END, CASE WHEN list_sort(described) <> described THEN 'unordered_described' END, CASE WHEN len(list_filter(planned, lambda x: NOT list_contains(described, x))) > 0 THEN 'not_described' END,
CASE WHEN len(list_filter(described, lambda x: NOT list_contains(planned, x))) > 0 THEN 'not_planned' END]) AS u(problem) WHERE problem IS NOT NULL""")
def list_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as a plan, those of its suppliers with a balance as what describes it."""
    n, s = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "supplier")
    first = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    planned = n.groupBy("n_regionkey").agg(first("n_nationkey", "n_name").alias("planned"), F.count("*").cast("int").alias("n"))
    owners = s.where("s_acctbal > 0").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    described = owners.groupBy("n_regionkey").agg(first("s_suppkey", "n_name").alias("described"))
    return profile_checks.list_problems(planned.join(described, "n_regionkey", "left"), "n_regionkey", "planned", "n", "described")


@query("""SELECT doc_id, row_number() OVER (ORDER BY lower(source), lang, doc_id) AS place FROM documents""")
def listing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as an ingestion lists its results."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return ingest.in_order(d, "source", "lang", "doc_id").select("doc_id", "place")
