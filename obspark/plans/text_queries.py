"""Queries of full-text relevance, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from obspark.operators import cover_density, search
from obspark.plans.search_queries import POOL, SCOPE
from obspark.sources import views

#: Two words, or a phrase without a word that follows it.
WEB_QUERY = 'the and or "de la" -rewh'


def _relevance(s, d):
    pool = search.candidate_pool(views.observations(s, d), SCOPE)
    out = cover_density.text_relevance(pool, "static_text", WEB_QUERY)
    return out.select("record_id", *[F.round(c, 6).alias(c) for c in ("cover_density", "similarity", "relevance")])


def _names(s, d):
    parts = views.table(s, d, "part")
    queries = parts.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("query"))
    return cover_density.similar_texts(parts.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", F.col("p_partkey").cast("string")).alias("text")), queries, digits=6)


def _grams(words: str) -> str:
    """Distinct trigrams of a list of words."""
    return f"list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in {words}]))"


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_ALIKE = "CAST(len(list_intersect({0}, {1})) AS DOUBLE) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"

#: Covers by windows: at each place the latest start of a satisfied alternative, new where it exceeds all before.
RELEVANCE_SQL = f"""{POOL}, w AS (SELECT record_id, {_WORDS.format("coalesce(static_text, '')")} AS w FROM pool),
 e AS (SELECT record_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w),
 o AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS i FROM e WHERE word IN ('the', 'and', 'de', 'la', 'rewh')),
 l AS (SELECT *, lag(pos) OVER r AS before, lag(word) OVER r AS prior FROM o WINDOW r AS (PARTITION BY record_id ORDER BY pos)),
 u AS (SELECT *, CASE WHEN word = 'the' THEN pos END AS t, CASE WHEN word = 'and' THEN pos END AS a, CASE WHEN word = 'la' AND prior = 'de' AND before = pos - 1 THEN pos - 1 END AS p FROM l),
 m AS (SELECT *, max(t) OVER r AS lt, max(a) OVER r AS la, max(p) OVER r AS lp FROM u WINDOW r AS (PARTITION BY record_id ORDER BY pos)),
 x AS (SELECT record_id, bool_or(word = 'rewh') AS bad, max(t) IS NOT NULL AND max(a) IS NOT NULL AS one, max(p) IS NOT NULL AS two FROM u GROUP BY record_id),
 b AS (SELECT record_id, pos, i, greatest(CASE WHEN lt IS NOT NULL AND la IS NOT NULL THEN least(lt, la) ELSE 0 END, CASE WHEN NOT bad THEN coalesce(lp, 0) ELSE 0 END) AS start FROM m JOIN x USING (record_id)),
 n AS (SELECT *, coalesce(max(start) OVER (PARTITION BY record_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM b),
 c AS (SELECT n.record_id, sum(0.1 / (1 + (n.pos - n.start) - (n.i - o.i))) AS cd FROM n JOIN o ON o.record_id = n.record_id AND o.pos = n.start WHERE n.start > n.held GROUP BY 1),
 g AS (SELECT record_id, {_grams('w')} AS g, {_grams("['the', 'and', 'or', 'de', 'la', 'rewh']")} AS q FROM w),
 s AS (SELECT record_id, CASE WHEN len(g) = 0 THEN 0 ELSE {_ALIKE.format('g', 'q')} END AS similarity FROM g)
SELECT s.record_id, round(coalesce(cd, 0), 6) AS cover_density, round(similarity, 6) AS similarity, round(coalesce(cd, 0) + 0.05 * similarity, 6) AS relevance
FROM s LEFT JOIN c USING (record_id) LEFT JOIN x USING (record_id) WHERE coalesce(x.one OR (x.two AND NOT x.bad), false) OR similarity >= 0.3"""

SIMILAR_SQL = f"""WITH t AS (SELECT p_partkey AS id, {_grams(_WORDS.format("p_name || ' ' || p_type || ' ' || p_partkey"))} AS g FROM part), q AS (SELECT p_partkey AS query_id, {_grams(_WORDS.format("p_name || ' ' || p_type"))} AS a FROM part WHERE p_partkey % 50 = 0)
SELECT query_id, id, round({_ALIKE.format('g', 'a')}, 6) AS similarity FROM t, q WHERE {_ALIKE.format('g', 'a')} >= 0.3"""

QUERIES = {"cover_density": _relevance, "similar_names": _names}
ORACLE_SQL = {"cover_density": f"WITH {RELEVANCE_SQL}", "similar_names": SIMILAR_SQL}
