"""Prototype, calibration and evaluation queries over ``embeddings`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlume.operators import episodes as EP
from revlume.operators import vectors as X
from revlume.plans import views as V
from revlume.plans.registry import Registry
from revlume.plans.shared import cut

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

BANK = """places AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM places GROUP BY 1, 2), bank AS (SELECT label, max(n) AS n, list(m ORDER BY pos) AS centre FROM m GROUP BY 1)"""


def embeddings(spark, d):
    return V.table(spark, d, "embeddings")


@R.add("A33_prototype_bank", f"WITH {BANK} SELECT label, n, round(centre[1], 6) AS c0, round(centre[64], 6) AS c63, round(sqrt(list_sum(list_transform(centre, lambda x: x * x))), 6) AS norm FROM bank")
def a33(spark, d):
    bank = X.prototypes(embeddings(spark, d))
    return bank.select("label", "n", F.round(F.col("centre")[0], 6).alias("c0"), F.round(F.col("centre")[63], 6).alias("c63"), F.round(F.sqrt(X.dot(F.col("centre"), F.col("centre"))), 6).alias("norm"))


SCORED = BANK + """, d AS (SELECT vec_id, e.label AS truth, b.label AS candidate, list_sum(list_transform(list_zip(embedding, centre), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS d2 FROM embeddings e, bank b),
w AS (SELECT *, exp(-d2 - max(-d2) OVER (PARTITION BY vec_id)) AS e FROM d), s AS (SELECT vec_id, truth, candidate, d2, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM w)"""


def scored(spark, d):
    e = embeddings(spark, d)
    return X.score(e, X.prototypes(e))


@R.add("M08_prototype_scores", f"WITH {SCORED} SELECT vec_id, candidate, round(d2, 6) AS d2, round(p, 6) AS p FROM s")
def m08(spark, d):
    return scored(spark, d).select("vec_id", "candidate", F.round("d2", 6).alias("d2"), F.round("p", 6).alias("p"))


DECIDED = SCORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, candidate) AS place FROM s),
dec AS (SELECT vec_id, truth, max(candidate) FILTER (place = 1) AS predicted, max(p) FILTER (place = 1) AS confidence, max(p) FILTER (place = 2) AS second, max(d2) FILTER (place = 1) AS d2 FROM r GROUP BY 1, 2)"""


def decided(spark, d):
    return X.decide(scored(spark, d))


@R.add("X04_nearest_prototype", f"WITH {DECIDED} SELECT vec_id, truth, predicted, round(confidence, 6) AS confidence, round(1 - (confidence - second), 6) AS ambiguity, round(d2 / (d2 + 1), 6) AS distance FROM dec")
def x04(spark, d):
    return decided(spark, d).select("vec_id", "truth", "predicted", *(F.round(c, 6).alias(c) for c in ("confidence", "ambiguity", "distance")))


@R.add("T11_within_margin", f"WITH {SCORED} SELECT vec_id, count(*) AS labels FROM (SELECT vec_id, p, max(p) OVER (PARTITION BY vec_id) AS top FROM s) WHERE round(top - p, 7) <= 0.1 GROUP BY 1")
def t11(spark, d):
    top = F.max("p").over(Window.partitionBy("vec_id"))
    return scored(spark, d).withColumn("top", top).where(F.round(F.col("top") - F.col("p"), 7) <= 0.1).groupBy("vec_id").agg(F.count(F.lit(1)).alias("labels"))


@R.add("A29_per_label", f"WITH {DECIDED}, t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = predicted) AS hits FROM dec GROUP BY 1), q AS (SELECT predicted AS label, count(*) AS k FROM dec GROUP BY 1), x AS (SELECT label, support, CASE WHEN coalesce(k, 0) > 0 THEN hits::DOUBLE / k ELSE 0 END AS precision, hits::DOUBLE / support AS recall FROM t LEFT JOIN q USING (label)) SELECT label, support, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM x")
def a29(spark, d):
    return X.per_label(decided(spark, d))


@R.add("A30_summary", f"WITH {DECIDED} SELECT count(*) AS n, count(*) FILTER (truth = predicted)::DOUBLE / count(*) AS accuracy, round(avg(confidence), 6) AS confidence, round(avg(1 - (confidence - second)), 6) AS ambiguity FROM dec")
def a30(spark, d):
    n = F.count(F.lit(1))
    return decided(spark, d).agg(n.alias("n"), (F.count_if(F.col("truth") == F.col("predicted")).cast("double") / n).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("ambiguity"), 6).alias("ambiguity"))


@R.add("A31_calibration_error", f"WITH {DECIDED}, b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, count(*) FILTER (truth = predicted)::DOUBLE / count(*) AS a FROM dec GROUP BY 1) SELECT round(sum(abs(a - c) * n) / sum(n), 6) AS ece FROM b")
def a31(spark, d):
    return X.calibration_error(decided(spark, d)).select(F.round("ece", 6).alias("ece"))


@R.add("A32_confusions", f"WITH {DECIDED} SELECT truth, predicted, count(*) AS n FROM dec WHERE truth <> predicted GROUP BY 1, 2 ORDER BY n DESC, truth, predicted LIMIT 5")
def a32(spark, d):
    return decided(spark, d).where("truth <> predicted").groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "truth", "predicted").limit(5)


@R.add("A29_auroc", "WITH x AS (SELECT length(text) AS s, toxic = 1 AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM x GROUP BY 1), w AS (SELECT *, sum(q) OVER (ORDER BY s) - q AS below FROM c) SELECT round((sum(p * (below + q / 2.0::DOUBLE)) / (sum(p) * sum(q)))::DOUBLE, 9) AS auroc FROM w")
def auroc(spark, d):
    """How well a text's length alone ranks toxic labels."""
    own = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id").select(F.length("text").alias("s"), (F.col("toxic") == 1).alias("y"))
    return X.auroc(own, "s", "y").select(F.round("auroc", 9).alias("auroc"))


@R.add("A34_class_weights", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), w AS (SELECT label, n, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, n)) AS w FROM n) SELECT label, n, round(w / avg(w) OVER (), 6) AS weight FROM w")
def a34(spark, d):
    n = embeddings(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    w = n.withColumn("w", F.lit(1 - 0.9999) / (1 - F.pow(F.lit(0.9999), F.col("n"))))
    return w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("mean")))).select("label", "n", F.round(F.col("w") / F.col("mean"), 6).alias("weight"))


@R.add("A35_threshold_grid", f"WITH {DECIDED}, nov AS (SELECT least(0.999999, 2 * d2 / (d2 + 1) - 0.5) AS novelty, truth >= 8 AS is_novel FROM dec), ats AS (SELECT floor(novelty * 20) AS step, is_novel, count(*) AS n FROM nov GROUP BY 1, 2), g AS (SELECT i / 20.0::DOUBLE AS t FROM range(1, 20) x(i)), p AS (SELECT a.t AS known, b.t AS novel FROM g a JOIN g b ON a.t < b.t), met AS (SELECT known, novel, step / 20.0::DOUBLE AS s, is_novel, n FROM p, ats), c AS (SELECT known, novel, coalesce(sum(n) FILTER (is_novel AND s >= novel), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (NOT is_novel AND s >= novel), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (is_novel AND s < novel), 0)::BIGINT AS fn, coalesce(sum(n) FILTER (NOT is_novel AND s < known), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT is_novel), 0)::BIGINT AS k FROM met GROUP BY 1, 2) SELECT known, novel, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS novel_f1, CASE WHEN k > 0 THEN kept::DOUBLE / k ELSE 0 END AS known_recall, 0.5::DOUBLE * novel_f1 + 0.5::DOUBLE * known_recall AS objective FROM c")
def a35(spark, d):
    """Thresholds over the distance to the nearest prototype; labels from 8 on count as novel."""
    own = decided(spark, d).select(F.least(F.lit(0.999999), 2 * F.col("distance") - 0.5).alias("novelty"), (F.col("truth") >= 8).alias("is_novel"))
    return X.threshold_grid(own)


@R.add("J10_similar_labels", f"WITH {BANK}, u AS (SELECT label, list_transform(centre, lambda x: x / sqrt(list_sum(list_transform(centre, lambda y: y * y)))) AS v FROM bank), c AS (SELECT x.label AS a, y.label AS b, list_sum(list_transform(list_zip(x.v, y.v), lambda z: z[1] * z[2])) AS cosine FROM u x JOIN u y ON x.label <> y.label), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS place FROM c WHERE cosine >= -0.05) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, round(cosine, 6) AS cosine FROM r WHERE place <= 3")
def j10(spark, d):
    """Similar labels by their unit prototypes, each pair that one of both names: the self-join is over labels, not rows."""
    bank = cut(X.prototypes(embeddings(spark, d)).select(F.col("label").alias("id"), X.unit(F.col("centre")).alias("v")))
    return X.similar_pairs(bank, -0.05, 3, both=True).withColumn("cosine", F.round("cosine", 6))


@R.add("J10_similar_vectors", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e), c AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) AS cosine FROM u x JOIN u y ON x.vec_id <> y.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS place FROM c WHERE cosine >= 0.3) SELECT a, b, round(cosine, 6) AS cosine FROM r WHERE place <= 25 AND a < b")
def j10_rows(spark, d):
    """Pairs of all vectors with a cosine of 0.3 or more, of each the 25 nearest."""
    unit = embeddings(spark, d).select(F.col("vec_id").alias("id"), X.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return X.similar_pairs(unit, 0.3, 25).withColumn("cosine", F.round("cosine", 6))


CURVE = "SELECT s, y, count(*) AS n FROM (SELECT length(text) AS s, toxic = 1 AS y FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2"
STEPS = f"c AS ({CURVE}), d AS (SELECT s, coalesce(sum(n) FILTER (y), 0) AS p, coalesce(sum(n) FILTER (NOT y), 0) AS q FROM c GROUP BY 1), st AS (SELECT s, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS all_p, sum(q) OVER () AS all_q FROM d WINDOW w AS (ORDER BY s DESC))"


def lengths_and_labels(spark, d):
    return V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id").select(F.length("text").alias("s"), (F.col("toxic") == 1).alias("y"))


@R.add("A29_precision_recall", f"WITH {STEPS} SELECT s AS score, tp::DOUBLE / (tp + fp)::DOUBLE AS precision, tp::DOUBLE / all_p::DOUBLE AS recall FROM st")
def precision_recall(spark, d):
    """Of a text's length as a score of toxic labels."""
    return X.precision_recall(lengths_and_labels(spark, d), "s", "y")


@R.add("A29_ranking_summary", f"WITH {STEPS} SELECT round((SELECT sum(p * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(p) FROM st), 9) AS average_precision, (SELECT min(fp::DOUBLE / all_q::DOUBLE) FROM st WHERE tp >= 0.95 * all_p) AS fpr")
def ranking_summary(spark, d):
    own = lengths_and_labels(spark, d)
    return X.average_precision(own, "s", "y").select(F.round("average_precision", 9).alias("average_precision")).crossJoin(X.fpr_at_recall(own, "s", "y", 0.95))


@R.add("A29_risk_coverage", f"WITH {DECIDED}, x AS (SELECT round(d2 / (d2 + 1), 6) AS novelty, truth = predicted AS ok FROM dec), q AS (SELECT i / 10.0::DOUBLE AS quantile FROM range(1, 11) v(i)), t AS (SELECT quantile, (SELECT list_sort(list(novelty)) FROM x) AS l FROM q), c AS (SELECT quantile, l[CAST(floor(quantile * (len(l) - 1)) AS INTEGER) + 1] AS low, l[CAST(ceil(quantile * (len(l) - 1)) AS INTEGER) + 1] AS high, quantile * (len(l) - 1) AS spot FROM t), b AS (SELECT quantile, low + (high - low) * (spot - floor(spot)) AS threshold FROM c) SELECT quantile, round(threshold, 6) AS threshold, count(*) FILTER (novelty <= threshold)::DOUBLE / count(*) AS coverage, round(1 - count(*) FILTER (novelty <= threshold AND ok)::DOUBLE / count(*) FILTER (novelty <= threshold), 9) AS risk FROM b, x GROUP BY 1, b.threshold")
def risk_coverage(spark, d):
    """How wrong the nearest prototype is among the rows that are near enough, by tenths of the distance."""
    own = decided(spark, d).select(F.round("distance", 6).alias("novelty"), (F.col("truth") == F.col("predicted")).alias("ok"))
    found = X.risk_coverage(own, "novelty", "ok", [i / 10 for i in range(1, 11)])
    return found.select("quantile", F.round("threshold", 6).alias("threshold"), "coverage", F.round("risk", 9).alias("risk"))


@R.add("X07_eligible_labels", "SELECT label, count(*) AS examples, count(*) FILTER (vec_id % 2 = 0) AS support_pool, count(*) FILTER (vec_id % 2 = 1) AS query_pool FROM embeddings GROUP BY 1 HAVING count(*) >= 4")
def x07(spark, d):
    n = F.count(F.lit(1))
    even = F.col("vec_id") % 2
    return embeddings(spark, d).groupBy("label").agg(n.alias("examples"), F.count_if(even == 0).cast("long").alias("support_pool"), F.count_if(even == 1).cast("long").alias("query_pool")).where("examples >= 4")


UNIFORM = "((('0x' || substr(md5(concat_ws('|', {}) ), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE"
DRAW = "-ln(" + UNIFORM + ") / {}"
EPISODES = f"""ex AS (SELECT vec_id AS id, label, CAST(vec_id // 2 AS VARCHAR) AS parent, CASE WHEN vec_id % 3 = 0 THEN 'g' || (vec_id // 9) END AS grp, 1.0::DOUBLE + vec_id % 4 AS weight, (vec_id % 4) / 3.0::DOUBLE AS hardness, 'd' || (vec_id % (1 + label % 3)) AS domain FROM embeddings),
l0 AS (SELECT label, count(DISTINCT parent) AS parents, avg(hardness) AS hard, count(DISTINCT domain) AS domains FROM ex GROUP BY 1), lab AS (SELECT label, greatest(1e-6, 0.55::DOUBLE / parents + 0.3::DOUBLE * hard + 0.15::DOUBLE * domains / (SELECT max(domains) FROM l0)) AS weight FROM l0 WHERE parents >= 5),
dr AS (SELECT i AS episode FROM range(1, 121) r(i)), kl AS (SELECT episode, label, {DRAW.format("'42', 'label', episode, label", "weight")} AS draw FROM dr, lab), ch AS (SELECT episode, label FROM kl QUALIFY row_number() OVER (PARTITION BY episode ORDER BY draw, label) <= 3),
pool AS (SELECT * FROM ex WHERE label IN (SELECT label FROM lab) QUALIFY row_number() OVER (PARTITION BY label ORDER BY {DRAW.format("'42', 'pool', id", "weight")}, id) <= 2000),
met AS (SELECT episode, ch.label, id, parent, weight, CASE WHEN {UNIFORM.format("'42', 'role', episode, coalesce(grp, parent)")} < 2 / 5.0::DOUBLE THEN 'support' ELSE 'query' END AS role, {DRAW.format("'42', 'row', episode, id", "weight")} AS draw FROM ch JOIN pool ON pool.label = ch.label),
once AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY episode, label, role, parent ORDER BY draw, id) = 1), pick AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY episode, label, role ORDER BY draw, id) <= CASE role WHEN 'support' THEN 2 ELSE 3 END),
full_ones AS (SELECT episode, row_number() OVER (ORDER BY episode) AS number FROM pick GROUP BY 1 HAVING count(*) = 15)"""


@R.add("X07_episodes", f"WITH {EPISODES} SELECT number AS episode, label, role, id FROM pick JOIN full_ones USING (episode) WHERE number <= 10")
def episodes(spark, d):
    """Ten episodes of three labels, two support and three query rows each."""
    i = F.col("vec_id")
    own = embeddings(spark, d).select(
        i.alias("id"), "label", F.floor(i / 2).cast("string").alias("parent"), F.when(i % 3 == 0, F.concat(F.lit("g"), F.floor(i / 9).cast("string"))).alias("group"), (1.0 + i % 4).alias("weight"), ((i % 4) / 3.0).alias("hardness"),
        F.concat(F.lit("d"), (i % (1 + F.col("label") % 3)).cast("string")).alias("domain"))
    return EP.build(own, 3, 2, 3, 10)
