"""Graph queries over the binding views."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlume.operators import graphs as G
from revlume.operators import published as P
from revlume.plans import views as V
from revlume.plans.registry import Registry
from revlume.plans.shared import cut, shared_folder
from revlume.plans.views import with_views

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

PAIRS = "m AS (SELECT DISTINCT review_id, aspect_raw FROM predictions), pairs AS (SELECT x.review_id, x.aspect_raw AS a, y.aspect_raw AS b FROM m x JOIN m y ON x.review_id = y.review_id AND x.aspect_raw < y.aspect_raw), edges AS (SELECT a, b, count(*) AS weight FROM pairs GROUP BY 1, 2)"


@R.add("J09_cooccurrence", with_views(PAIRS + " SELECT * FROM edges"))
def j09(spark, d):
    return G.cooccurrence(V.predictions(spark, d), name="aspect_raw")


NODES = """n AS (SELECT aspect_raw, count(DISTINCT review_id) AS frequency, count(*) AS mentions, CAST(sum(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) AS BIGINT)::DOUBLE / count(*) AS avg_sentiment,
 count(*) FILTER (sentiment = 'negative')::DOUBLE / count(*) AS negative_ratio, count(*) FILTER (source = 'explicit') AS explicit_count, count(*) FILTER (source = 'implicit') AS implicit_count FROM predictions GROUP BY 1),
md AS (SELECT aspect_raw, sentiment AS dominant FROM (SELECT aspect_raw, sentiment, row_number() OVER (PARTITION BY aspect_raw ORDER BY count(*) DESC, sentiment) AS place FROM predictions GROUP BY 1, 2) WHERE place = 1)"""


@R.add("A13_aspect_nodes", with_views(NODES + " SELECT n.*, dominant FROM n JOIN md USING (aspect_raw)"))
def a13(spark, d):
    return G.nodes(V.predictions(spark, d), "aspect_raw")


@R.add("A13_recent_edges", with_views("""recent AS (SELECT review_id FROM reviews WHERE review_id IN (SELECT review_id FROM predictions) ORDER BY created_at DESC, review_id DESC LIMIT 2000), m AS (SELECT DISTINCT review_id, aspect_raw FROM predictions JOIN recent USING (review_id))
SELECT x.aspect_raw AS a, y.aspect_raw AS b, count(*) AS weight FROM m x JOIN m y ON x.review_id = y.review_id AND x.aspect_raw < y.aspect_raw GROUP BY 1, 2 HAVING count(*) >= 2"""))
def a13_edges(spark, d):
    """The batch graph's edges: its input is the 2,000 most recent reviews with predictions, by definition."""
    p = V.predictions(spark, d)
    recent = V.reviews(spark, d).join(p, "review_id", "left_semi").orderBy(F.desc("created_at"), F.desc("review_id")).limit(2000).select("review_id")
    return G.cooccurrence(p.join(recent, "review_id"), name="aspect_raw", least=2)


@R.add("A14_novel_nodes", with_views("SELECT trim(aspect_raw) AS aspect, count(*) AS mentions, round((CAST(sum(100 - conf) AS BIGINT)::DOUBLE / count(*)) / 100, 6) AS novelty FROM predictions WHERE conf < 93 GROUP BY 1"))
def a14(spark, d):
    low = V.predictions(spark, d).where("conf < 93")
    return low.groupBy(F.trim("aspect_raw").alias("aspect")).agg(F.count(F.lit(1)).alias("mentions"), F.round(F.sum(100 - F.col("conf")).cast("double") / F.count(F.lit(1)) / 100, 6).alias("novelty"))


IDF = "idfs AS (SELECT aspect, count(DISTINCT review_id) AS df, round(ln(((SELECT count(*) FROM reviews) + 1)::DOUBLE / (count(DISTINCT review_id) + 1)), 6) AS idf FROM predictions GROUP BY 1)"


@R.add("A18_idf", with_views(IDF + " SELECT * FROM idfs"))
def a18(spark, d):
    return G.idf(V.predictions(spark, d), V.reviews(spark, d))


RANKS = """e AS (SELECT x.aspect AS a, y.aspect AS b, count(*)::DOUBLE AS weight FROM (SELECT DISTINCT review_id, aspect FROM predictions) x JOIN (SELECT DISTINCT review_id, aspect FROM predictions) y ON x.review_id = y.review_id AND x.aspect < y.aspect GROUP BY 1, 2),
both_ways AS (SELECT a AS node, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e), tot AS (SELECT node, sum(weight) AS total FROM both_ways GROUP BY 1), sh AS (SELECT node, other, weight / total AS share FROM both_ways JOIN tot USING (node)), nn AS (SELECT count(*) AS n FROM tot),
r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM tot, nn), """ + ", ".join(f"r{k} AS (SELECT other AS node, (1 - 0.85::DOUBLE) / any_value(n) + 0.85::DOUBLE * sum(rank * share) AS rank FROM sh JOIN r{k - 1} USING (node), nn GROUP BY 1)" for k in range(1, 21)) + ", ranks AS (" + " UNION ALL ".join(f"SELECT * FROM r{k} WHERE {k} = (SELECT min(k) FROM moved WHERE far < n * 1e-6 OR k = 20)" for k in range(1, 21)) + ")"
RANKS = RANKS.replace(", ranks AS (", ", moved AS (" + " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(x.rank - y.rank)) AS far, count(*) AS n FROM r{k} x JOIN r{k - 1} y USING (node)" for k in range(1, 21)) + "), ranks AS (", 1)


@R.add("G03_pagerank", with_views(RANKS + " SELECT node, round(rank, 6) AS rank FROM ranks"))
def g03(spark, d):
    return G.pagerank(G.cooccurrence(V.predictions(spark, d))).select("node", F.round("rank", 6).alias("rank"))


@R.add("A19_overall_sentiment", with_views(RANKS[: RANKS.index(", moved AS (")] + ", " + IDF + """, s AS (SELECT p.*, 2.5::DOUBLE * (0.55::DOUBLE * (p.conf / 100.0::DOUBLE) + 0.25::DOUBLE * rank + 0.2::DOUBLE * idf / (idf + 5)) AS s FROM predictions p JOIN r20 ON node = p.aspect JOIN idfs ON idfs.aspect = p.aspect),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY review_id)) AS w FROM s), o AS (SELECT review_id, sum(w * CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END * conf / 100) / sum(w) AS score FROM w GROUP BY 1)
SELECT review_id, round(score, 5) + 0.0::DOUBLE AS overall_score, CASE WHEN score > 0.15::DOUBLE THEN 'positive' WHEN score < -0.15::DOUBLE THEN 'negative' ELSE 'neutral' END AS overall FROM o"""))
def a19(spark, d):
    p = V.predictions(spark, d)
    return G.overall_sentiment(p.withColumn("evidence", F.col("conf") / 100), G.pagerank(G.cooccurrence(p), rounds=20, tolerance=0.0), G.idf(p, V.reviews(spark, d)))


@R.add("W04_transitions", with_views("SELECT review_id, aspect AS a, nxt AS b, count(*) AS moves FROM (SELECT review_id, aspect, lead(aspect) OVER (PARTITION BY review_id ORDER BY position, aspect) AS nxt FROM predictions) WHERE nxt IS NOT NULL AND nxt <> aspect GROUP BY 1, 2, 3"))
def w04(spark, d):
    return G.transitions(V.by_review(spark, d))


SIMILAR = """heavy AS (SELECT a, b FROM edges WHERE weight >= (SELECT quantile_cont(weight, 0.97) FROM edges)), sym AS (SELECT a, b FROM heavy UNION SELECT b, a FROM heavy),
reach AS (SELECT a AS node, b AS other FROM sym UNION SELECT a, a FROM sym UNION SELECT reach.node, sym.b FROM reach JOIN sym ON reach.other = sym.a), roots AS (SELECT node, arg_min(other, {'l': length(other), 'o': other}) AS root FROM reach GROUP BY 1)"""


def heavy(spark, d):
    return heavy_of(V.predictions(spark, d))


def heavy_of(rows):
    edges = cut(G.cooccurrence(rows, name="aspect_raw"))
    least = edges.agg(F.expr("percentile(weight, 0.97)").alias("least"))
    return edges.crossJoin(F.broadcast(least)).where(F.col("weight") >= F.col("least"))


@R.add("G01_components", with_views(PAIRS + ", " + SIMILAR + " SELECT * FROM roots").replace("WITH ", "WITH RECURSIVE ", 1))
def g01(spark, d):
    return G.components(heavy(spark, d))


@R.add("G02_communities", with_views(PAIRS + ", " + SIMILAR + ", g AS (SELECT root, count(*) AS size FROM roots GROUP BY root), o AS (SELECT root, size, CAST(row_number() OVER (ORDER BY size DESC, root) AS INTEGER) AS community FROM g) SELECT community, size, node AS member FROM roots JOIN o USING (root)").replace("WITH ", "WITH RECURSIVE ", 1))
def g02(spark, d):
    return G.communities(heavy(spark, d), 0)


@R.add("G04_clustered_edges", with_views(PAIRS + """, k AS (SELECT p_name AS raw, min(p_type) AS cluster FROM part GROUP BY 1), c AS (SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM edges JOIN k x ON x.raw = edges.a JOIN k y ON y.raw = edges.b WHERE x.cluster <> y.cluster GROUP BY 1, 2) SELECT * FROM c"""))
def g04(spark, d):
    """Edges between clusters: endpoints mapped, loops dropped, weights summed."""
    mapping = V.table(spark, d, "part").groupBy(F.col("p_name").alias("raw")).agg(F.min("p_type").alias("cluster"))
    edges = G.cooccurrence(V.predictions(spark, d), name="aspect_raw")
    joined = edges.join(mapping.toDF("a", "x"), "a").join(mapping.toDF("b", "y"), "b").where("x <> y")
    return joined.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight"))


@R.add("T08_edges_by_weight", with_views(PAIRS + " SELECT * FROM edges ORDER BY weight DESC, a, b LIMIT 200"))
def t08(spark, d):
    return G.cooccurrence(V.predictions(spark, d), name="aspect_raw").orderBy(F.desc("weight"), "a", "b").limit(200)


@R.add("F18_odd_nodes", with_views(NODES + """, x AS (SELECT n.*, dominant, (SELECT quantile_cont(frequency, 0.5) FROM n) AS med FROM n JOIN md USING (aspect_raw)), f AS (SELECT aspect_raw, frequency, concat_ws(',', CASE WHEN mentions >= 20 AND implicit_count::DOUBLE / mentions >= 0.95 THEN 'mostly_implicit' END, CASE WHEN mentions >= 20 AND implicit_count::DOUBLE / mentions <= 0.05 THEN 'mostly_explicit' END,
 CASE WHEN dominant = 'positive' AND negative_ratio > 0.34 THEN 'inconsistent' END, CASE WHEN frequency >= greatest(10, 1.05 * med) THEN 'frequent' END) AS flags FROM x) SELECT * FROM f WHERE flags <> ''"""))
def f18(spark, d):
    return G.odd_nodes(G.nodes(V.predictions(spark, d), "aspect_raw")).select("aspect_raw", "frequency", "flags")


@R.add("U02_review_graph_nodes", with_views("SELECT review_id, aspect, count(*) AS mentions, CAST(sum(conf) AS BIGINT)::DOUBLE / count(*) / 100 AS confidence, min(position) AS first_position FROM predictions GROUP BY 1, 2"))
def review_graph(spark, d):
    """Nodes of each review's graph."""
    own = V.predictions(spark, d)
    return own.groupBy("review_id", "aspect").agg(F.count(F.lit(1)).alias("mentions"), (F.sum("conf").cast("double") / F.count(F.lit(1)) / 100).alias("confidence"), F.min("position").alias("first_position"))


@R.add("G05_review_edges", with_views(PAIRS + " SELECT a, b, count(*) AS reviews, 0.5::DOUBLE * count(*) AS weight FROM pairs GROUP BY 1, 2"))
def g05(spark, d):
    """Edges of single reviews' graphs, each of weight one half, over all reviews."""
    pairs = G.pairs_per_review(V.predictions(spark, d), name="aspect_raw").withColumn("weight", F.lit(0.5))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("reviews"), F.sum("weight").alias("weight"))


@R.add("G06_rebuilt_graph", with_views(PAIRS + ", " + SIMILAR + """, p AS (SELECT review_id, coalesce(root, aspect_raw) AS cluster FROM predictions LEFT JOIN roots ON node = aspect_raw),
g AS (SELECT coalesce(x.root, a) AS x, coalesce(y.root, b) AS y, weight FROM edges LEFT JOIN roots x ON x.node = a LEFT JOIN roots y ON y.node = b)
SELECT 'node' AS kind, cluster AS a, NULL AS b, count(DISTINCT review_id) AS weight, count(*) AS mentions FROM p GROUP BY 2 UNION ALL SELECT 'edge', least(x, y), greatest(x, y), CAST(sum(weight) AS BIGINT), NULL FROM g WHERE x <> y GROUP BY 2, 3""").replace("WITH ", "WITH RECURSIVE ", 1))
def g06(spark, d):
    """Nodes and edges of the whole graph, built anew."""
    found, edges = G.rebuild(V.predictions(spark, d), heavy(spark, d))
    nodes = found.select(F.lit("node").alias("kind"), F.col("cluster").alias("a"), F.lit(None).cast("string").alias("b"), F.col("frequency").alias("weight"), "mentions")
    return nodes.union(edges.select(F.lit("edge"), "a", "b", "weight", F.lit(None).cast("long")))


SCOPE = PAIRS + ", " + SIMILAR + """, p AS (SELECT review_id, coalesce(root, aspect_raw) AS cluster FROM predictions LEFT JOIN roots ON node = aspect_raw),
g AS (SELECT coalesce(x.root, a) AS x, coalesce(y.root, b) AS y, weight FROM edges LEFT JOIN roots x ON x.node = a LEFT JOIN roots y ON y.node = b)
SELECT 'SCOPE' AS scope, 'node' AS kind, cluster AS a, NULL AS b, count(DISTINCT review_id) AS weight, count(*) AS mentions, round(ln(((SELECT count(*) FROM own_reviews) + 1)::DOUBLE / (count(DISTINCT review_id) + 1)), 6) AS idf FROM p GROUP BY cluster
UNION ALL SELECT 'SCOPE', 'edge', least(x, y), greatest(x, y), CAST(sum(weight) AS BIGINT), NULL, NULL FROM g WHERE x <> y GROUP BY 3, 4"""


def scope_sql(scope: str, where: str) -> str:
    own = f"own_reviews AS (SELECT * FROM reviews WHERE {where}), scoped AS (SELECT p.* FROM predictions p WHERE review_id IN (SELECT review_id FROM own_reviews)), "
    return f"SELECT * FROM ({with_views(own + SCOPE.replace('SCOPE', scope).replace('FROM predictions', 'FROM scoped')).replace('WITH ', 'WITH RECURSIVE ', 1)})"


@R.add("G06_published_graph", scope_sql("all", "true") + " UNION ALL " + scope_sql("BUILDING", "domain = 'BUILDING'"))
def g06_published(spark, d):
    """The graphs of all domains and of one, published one after the other; the second again, from nothing, changes nothing."""
    root, reviews, rows = shared_folder(spark, "graph"), V.reviews(spark, d), V.predictions(spark, d)
    one = reviews.where("domain = 'BUILDING'")
    of_one = rows.join(one.select("review_id"), "review_id", "left_semi")
    G.publish(rows, heavy_of(rows), reviews, "all", root, 0)
    G.publish(of_one, heavy_of(of_one), one, "BUILDING", root, 1)
    if P.replace(spark.createDataFrame([("BUILDING",)], "scope string"), "scope", root, 1, {name: P.read(spark, root, name).limit(0) for name in ("nodes", "edges")}):
        raise AssertionError("a published number was published again")
    nodes = P.read(spark, root, "nodes").select("scope", F.lit("node").alias("kind"), F.col("cluster").alias("a"), F.lit(None).cast("string").alias("b"), F.col("frequency").alias("weight"), "mentions", "idf")
    return nodes.union(P.read(spark, root, "edges").select("scope", F.lit("edge"), "a", "b", "weight", F.lit(None).cast("long"), F.lit(None).cast("double")))
