"""Gates, routes and canonical names over mentions: labels and evidence made of the given product names and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlume.functions import text as X
from revlume.operators import builder as B
from revlume.operators import etl as E
from revlume.operators import gates as G
from revlume.operators import published as P
from revlume.operators import records as C
from revlume.plans import views as V
from revlume.plans.records import words
from revlume.plans.registry import Registry
from revlume.plans.shared import shared_folder
from revlume.sources import files as S

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

#: Every prediction as a mention: its label by its place in the review, its evidence by its confidence.
SQL = f"""WITH {V.SQL.strip()}, mentions AS (SELECT review_id, position, aspect_cluster, aspect_raw, sentiment, conf, source,
 CASE position % 7 WHEN 0 THEN 'get ' || aspect_raw WHEN 1 THEN aspect_raw WHEN 2 THEN 'Battery_Life' WHEN 3 THEN 'one' WHEN 4 THEN '3 ' || aspect_raw WHEN 5 THEN 'table service' ELSE ' My-cam ' END AS label,
 CASE conf % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'The ' || aspect_raw || ' is good' WHEN 2 THEN aspect_raw ELSE 'It keeps ' || split_part(aspect_raw, ' ', 2) || 'ing, does not ' || split_part(aspect_raw, ' ', 1) || ' a thing under load; good' END AS evidence FROM predictions) """


def mentions(spark, d):
    place, sure = F.col("position") % 7, F.col("conf") % 4
    first, second = (F.split_part("aspect_raw", F.lit(" "), F.lit(i)) for i in (1, 2))
    label = (
        F.when(place == 0, F.concat(F.lit("get "), "aspect_raw")).when(place == 1, F.col("aspect_raw")).when(place == 2, "Battery_Life").when(place == 3, "one").when(place == 4, F.concat(F.lit("3 "), "aspect_raw"))
        .when(place == 5, "table service").otherwise(" My-cam ")
    )
    evidence = (
        F.when(sure == 0, " ").when(sure == 1, F.concat(F.lit("The "), "aspect_raw", F.lit(" is good"))).when(sure == 2, F.col("aspect_raw"))
        .otherwise(F.concat(F.lit("It keeps "), second, F.lit("ing, does not "), first, F.lit(" a thing under load; good")))
    )
    own = V.predictions(spark, d).select("review_id", "position", "aspect_cluster", "aspect_raw", "sentiment", "conf", "source")
    return own.withColumn("label", label).withColumn("evidence", evidence)


def count():
    return F.count(F.lit(1)).alias("n")


@R.add("C23_explicit_labels", SQL + "SELECT DISTINCT label, CASE WHEN n IN ('my cam', 'cam') THEN 'camera' ELSE n END AS aspect FROM (SELECT label, trim(regexp_replace(trim(replace(replace(lower(label), '-', ' '), '_', ' ')), '^my ', '')) AS n FROM mentions)")
def c23(spark, d):
    return mentions(spark, d).select("label").distinct().select("label", G.explicit_label(F.col("label")).alias("aspect"))


@R.add("F09_drop_reasons", SQL + "SELECT label, CASE WHEN label LIKE '3 %' THEN 'numeric_quantity' WHEN label = 'one' THEN 'low_quality_aspect' WHEN label = 'table service' THEN 'domain_mismatch' END AS reason, count(*) AS n FROM mentions GROUP BY 1, 2")
def f09(spark, d):
    """Labels judged for laptops: numbers, low quality, those of restaurants; the rest stays."""
    plain = G.explicit_label(F.col("label"))
    gate = C.explicit_gate(plain, words("one", "thing"), words("battery life", "camera"), words("price", "support"), words("service", "table"))
    return mentions(spark, d).groupBy("label", G.drop_reason(plain, gate).alias("reason")).agg(count())


@R.add("F07_domain_gate", SQL + """, r AS (SELECT *, CASE WHEN conf % 5 = 0 THEN 'boundary' ELSE 'known' END AS routing, CASE WHEN conf % 3 = 0 THEN 'abstain' ELSE 'single' END AS decision FROM mentions), t AS (SELECT *, routing = 'known' AND decision <> 'abstain' AND (label = 'one' OR (review_id % 4 > 0 AND label NOT IN ('Battery_Life', ' My-cam '))) AS turned FROM r)
SELECT CASE WHEN turned THEN 'boundary' ELSE routing END AS routing, CASE WHEN turned THEN 'abstain' ELSE decision END AS decision, turned AS abstain, CASE WHEN turned THEN 'domain_mismatch' END AS reason, count(*) AS n FROM t GROUP BY 1, 2, 3, 4""")
def f07(spark, d):
    """Known mentions that are neither of the laptop's words nor generic turn to abstentions; a quarter has no domain."""
    own = mentions(spark, d).withColumn("routing", F.when(F.col("conf") % 5 == 0, "boundary").otherwise("known")).withColumn("decision", F.when(F.col("conf") % 3 == 0, "abstain").otherwise("single"))
    own = own.withColumn("abstain", F.lit(False)).withColumn("reason", F.lit(None).cast("string")).withColumn("domain", F.when(F.col("review_id") % 4 > 0, "laptop"))
    allowed = G.implicit_allowed(F.col("label"), F.col("domain"), words("one"), words("battery life", "cam"), words("price"))
    return G.gate_implicit(own, allowed).groupBy("routing", "decision", "abstain", "reason").agg(count())


@R.add("F08_graph_rows", SQL + ", w AS (SELECT CASE position % 3 WHEN 0 THEN '' WHEN 1 THEN aspect_cluster ELSE ' Time ' END AS c, CASE WHEN position = 6 THEN 'thing' ELSE aspect_raw END AS raw, CASE WHEN conf <> 97 THEN CAST(conf AS DOUBLE) / 10 - 9 END AS weight FROM mentions) SELECT trim(lower(CASE WHEN trim(c) = '' THEN raw ELSE c END)) AS aspect, count(*) AS n FROM w WHERE trim(lower(CASE WHEN trim(c) = '' THEN raw ELSE c END)) NOT IN ('time', 'thing') AND (weight IS NULL OR weight >= 0.75) GROUP BY 1")
def f08(spark, d):
    """Aspects that may enter the graph; some mentions have no cluster, a blocked one, or no weight."""
    place = F.col("position") % 3
    own = mentions(spark, d).select(
        F.when(place == 0, "").when(place == 1, F.col("aspect_cluster")).otherwise(" Time ").alias("c"), F.when(F.col("position") == 6, "thing").otherwise(F.col("aspect_raw")).alias("raw"), F.when(F.col("conf") != 97, F.col("conf") / 10 - 9).alias("weight"))
    kept = own.where(G.allowed_in_graph(F.col("c"), F.col("raw"), F.col("weight")))
    return kept.groupBy(X.squash(F.lower(F.coalesce(X.blank_to_null(F.col("c")), "raw"))).alias("aspect")).agg(count())


@R.add("F14_export_routes", SQL + """, g AS (SELECT review_id, CASE review_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, max(conf < 92) AS low, max(source <> 'explicit') AS weak, max(trim(evidence) = '') AS gone FROM mentions GROUP BY 1),
r AS (SELECT *, concat_ws(',', CASE WHEN low THEN 'low_confidence' END, CASE WHEN gone THEN 'missing_evidence' END, CASE WHEN weak THEN 'weak_support' END) AS reasons FROM g)
SELECT split, CASE WHEN split = 'train' AND reasons <> '' THEN 'review_queue' WHEN gone THEN 'hard_reject' ELSE 'benchmark_gold' END AS destination, reasons, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def f14(spark, d):
    own = mentions(spark, d).withColumn("reasons", E.gate_reasons(F.when(F.col("conf") < 92, 0.2).otherwise(0.9), F.when(F.col("source") == "explicit", "exact").otherwise("none"), F.col("evidence")))
    rows = own.groupBy("review_id").agg(F.collect_set("reasons").alias("reasons"))
    split = F.when(F.col("review_id") % 3 == 0, "train").when(F.col("review_id") % 3 == 1, "val").otherwise("test")
    routed = rows.select(split.alias("split"), G.export_route(F.col("reasons"), split).alias("r"))
    return routed.groupBy("split", F.col("r.destination").alias("destination"), F.array_join("r.reasons", ",").alias("reasons")).agg(count())


@R.add("F16_pruned_labels", SQL + ", s AS (SELECT review_id, count(*) AS items, max(source = 'explicit' AND label NOT IN ('one', 'table service')) AS fine FROM mentions GROUP BY 1) SELECT review_id, items, count(*) FILTER (items <= 1 OR source = 'implicit' OR label NOT IN ('one', 'table service') OR NOT fine) AS kept FROM mentions JOIN s USING (review_id) GROUP BY 1, 2")
def f16(spark, d):
    items = mentions(spark, d).groupBy("review_id").agg(F.collect_list(F.struct(F.col("source").alias("label_type"), F.col("label").alias("canonical"))).alias("own"))
    return items.select("review_id", F.size("own").cast("long").alias("items"), F.size(G.prune_broad(F.col("own"), words("one", "table service"))).cast("long").alias("kept"))


@R.add("C15_neutral_phrases", SQL + """, e AS (SELECT lower(evidence) AS e, count(*) AS n FROM mentions GROUP BY 1), p AS (SELECT 'keeps ' || unnest(regexp_extract_all(e, '\\bkeeps?\\s+([a-z]+(?:ing|ed|s)?)\\b', 1)) AS phrase, n FROM e UNION ALL SELECT 'does not ' || unnest(regexp_extract_all(e, '\\bdoes\\s+not\\s+([a-z]+)\\b', 1)), n FROM e
 UNION ALL SELECT unnest(regexp_extract_all(e, '\\b([a-z]+s?)\\s+under\\s+([a-z]+)\\b')), n FROM e) SELECT phrase, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1""")
def c15(spark, d):
    return mentions(spark, d).select(F.explode(G.neutral_phrases(F.col("evidence"))).alias("phrase")).groupBy("phrase").agg(count())


FAMILIES = {"comfort": ("soft", "Red", "small"), "power": ("keeps", "gear", "large"), "fit": ("ring", "small")}


@R.add("C16_family_scores", SQL + ", e AS (SELECT DISTINCT evidence, lower(evidence) AS e FROM mentions), f AS (SELECT evidence, 0 AS place, 'comfort' AS family, contains(e, 'soft')::INT + contains(e, 'red')::INT + contains(e, 'small')::INT AS hits FROM e UNION ALL SELECT evidence, 1, 'power', contains(e, 'keeps')::INT + contains(e, 'gear')::INT + contains(e, 'large')::INT FROM e UNION ALL SELECT evidence, 2, 'fit', contains(e, 'ring')::INT + contains(e, 'small')::INT FROM e) SELECT evidence, family, round(least(0.95, 0.4::DOUBLE + 0.1::DOUBLE * hits), 6) AS confidence, row_number() OVER (PARTITION BY evidence ORDER BY hits DESC, place) AS rank FROM f WHERE hits > 0")
def c16(spark, d):
    scored = mentions(spark, d).select("evidence").distinct().select("evidence", F.posexplode(G.family_scores(F.col("evidence"), FAMILIES)).alias("at", "s"))
    return scored.select("evidence", "s.family", F.round("s.confidence", 6).alias("confidence"), (F.col("at") + 1).cast("long").alias("rank"))


NOISE = """, u AS (SELECT DISTINCT label, evidence, position % 2 + 1 AS support, trim(lower(label)) AS c, trim(lower(evidence)) AS e FROM mentions),
v AS (SELECT *, string_split(c, ' ') AS t FROM u), x AS (SELECT *, e = '' OR list_has_any(t, ['get', 'give', 'make', 'use', 'thing', 'way']) OR len(t) > 5 OR t[1] IN ('my', 'this', 'that', 'get', 'have') AS noise FROM v),
y AS (SELECT *, round(CASE WHEN t[1] NOT IN ('get', 'my') AND len(t) <= 3 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN contains(e, c) AND c <> e THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(e, 'good|bad|great|poor|slow|fast|broken|broke|excellent|awful|amazing|terrible|soft|hard') THEN 0.25::DOUBLE ELSE 0 END
 + CASE WHEN NOT noise THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN support > 1 THEN 0.1::DOUBLE ELSE 0 END, 6) AS score FROM x),
z AS (SELECT *, CASE WHEN noise THEN 'dropped_noise' WHEN score >= 0.75 THEN 'open_world' WHEN score >= 0.5 THEN 'provisional' WHEN score >= 0.35 THEN 'memory_candidate' ELSE 'dropped_noise' END AS bucket FROM y) """


@R.add("C17_unmapped_buckets", SQL + NOISE + "SELECT label, evidence, support, bucket, CASE WHEN noise THEN 0.0::DOUBLE ELSE score END AS score FROM z")
def c17(spark, d):
    own = mentions(spark, d).select("label", "evidence", (F.col("position") % 2 + 1).cast("int").alias("support")).distinct()
    judged = own.withColumn("u", G.unmapped(F.col("label"), F.col("evidence"), F.col("support")))
    return judged.select("label", "evidence", "support", "u.bucket", "u.score")


@R.add("C18_canonical_names", SQL + NOISE.replace("position % 2 + 1 AS support", "1 AS support") + """, m AS (SELECT p_name AS label, min(p_brand) AS brand FROM part WHERE p_name LIKE 'r%' GROUP BY 1)
SELECT label, evidence, CASE WHEN brand IS NOT NULL THEN brand WHEN bucket IN ('provisional', 'open_world') THEN replace(c, ' ', '_') ELSE 'unknown' END AS canonical, CASE WHEN brand IS NOT NULL THEN 'phrase' ELSE bucket END AS layer,
 CASE WHEN brand IS NOT NULL THEN 1.0::DOUBLE WHEN bucket = 'provisional' THEN 0.35::DOUBLE WHEN bucket = 'open_world' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM z LEFT JOIN m USING (label)""")
def c18(spark, d):
    """By a dictionary of some product names, else by the bucket of the candidate."""
    own = mentions(spark, d).select(F.col("label").alias("aspect_raw"), "evidence").distinct()
    names = V.table(spark, d, "part").where("p_name like 'r%'").groupBy(F.col("p_name").alias("aspect_raw")).agg(F.min("p_brand").alias("canonical"))
    return G.canonicalize(own, [("phrase", 1.0, names, ["aspect_raw"])]).withColumnRenamed("aspect_raw", "label")


@R.add("C09_clauses", "WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), '[;,] ', chr(2) || chr(1), 'g'), chr(1)) AS parts FROM documents), q AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p), s AS (SELECT doc_id, rtrim(part, chr(2)) AS snippet, CAST(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(part) - 1 AS start FROM q) SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(max(length(snippet)) AS BIGINT) AS longest FROM s WHERE snippet <> '' GROUP BY 1")
def c09(spark, d):
    spans = V.table(spark, d, "documents").select("doc_id", F.explode(G.clauses(F.col("text"))).alias("c"))
    return spans.groupBy("doc_id").agg(count(), F.sum("c.start").alias("starts"), F.max(F.length("c.snippet")).cast("long").alias("longest"))


@R.add("U10_distinct_phrases", "WITH f AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), g AS (SELECT doc_id, w, min(i) AS first FROM f GROUP BY 1, 2) SELECT doc_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY first)) AS digest FROM g GROUP BY 1")
def u10(spark, d):
    """Each text's distinct words in the order of their first places."""
    kept = V.table(spark, d, "documents").where("text is not null").select("doc_id", F.array_distinct(F.split("text", " ")).alias("w"))
    return kept.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@R.add("A37_selection_scores", SQL + ", m AS (SELECT aspect_cluster, count(*) FILTER (sentiment = 'positive')::DOUBLE / count(*) AS accuracy, count(*) FILTER (source = 'explicit')::DOUBLE / count(*) AS macro_f1, CASE WHEN count(*) % 2 = 0 THEN count(*) FILTER (conf > 95)::DOUBLE / count(*) END AS abstention_f1 FROM mentions GROUP BY 1) SELECT aspect_cluster, round(0.55::DOUBLE * accuracy + 0.3::DOUBLE * macro_f1 + 0.1::DOUBLE * coalesce(abstention_f1, 0), 6) AS score FROM m")
def a37(spark, d):
    share = lambda c: F.count_if(c).cast("double") / F.count(F.lit(1))
    m = mentions(spark, d).groupBy("aspect_cluster").agg(
        share(F.col("sentiment") == "positive").alias("accuracy"), share(F.col("source") == "explicit").alias("macro_f1"), F.when(F.count(F.lit(1)) % 2 == 0, share(F.col("conf") > 95)).alias("abstention_f1"))
    return m.select("aspect_cluster", F.round(G.selection_score(m), 6).alias("score"))


@R.add("A38_client_reducers", SQL + ", g AS (SELECT aspect_cluster, count(*) AS m, count(*) FILTER (sentiment = 'negative')::DOUBLE / count(*) AS n FROM mentions GROUP BY 1) SELECT CAST(sum(m) AS BIGINT) AS mentions, round(sum(m * n) / sum(m), 6) AS negative_ratio, count(*) FILTER (n >= 0.34) AS high, count(*) FILTER (n < 0.34) AS low FROM g")
def a38(spark, d):
    """The mention-weighted mean of negative ratios, and how many aspects are above a third."""
    g = mentions(spark, d).groupBy("aspect_cluster").agg(F.count(F.lit(1)).alias("m"), (F.count_if(F.col("sentiment") == "negative").cast("double") / F.count(F.lit(1))).alias("n"))
    return g.agg(F.sum("m").alias("mentions"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("m"), 6).alias("negative_ratio"), F.count_if(F.col("n") >= 0.34).alias("high"), F.count_if(F.col("n") < 0.34).alias("low"))


@R.add("W09_rolling_mean", "SELECT o_orderkey AS id, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS rolling FROM orders")
def w09(spark, d):
    rolled = G.rolling_mean(V.table(spark, d, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"], "o_custkey")
    return rolled.select(F.col("o_orderkey").alias("id"), F.round("rolling", 4).alias("rolling"))


@R.add("M05_row_scores", SQL + ", s AS (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(conf AS DOUBLE) / 100 + 0.1::DOUBLE * (position % 2) - least(0.5::DOUBLE, 0.2::DOUBLE * greatest(0, position - 2)))) AS score, CAST(position AS DOUBLE) / 7 AS a, source FROM mentions) SELECT CASE WHEN source = 'implicit' THEN 'H3' WHEN a >= 0.75 THEN 'H2' WHEN a > 0 THEN 'H1' ELSE 'H0' END AS tier, round(score, 6) AS score, count(*) AS n FROM s GROUP BY 1, 2")
def m05(spark, d):
    own = mentions(spark, d)
    score = G.row_score(F.col("conf") / 100, 0.1 * (F.col("position") % 2), F.lit(0.0), F.col("position") - 2)
    tier = G.tier(F.col("position") / 7, F.when(F.col("source") == "implicit", "novel").otherwise("known"))
    return own.groupBy(tier.alias("tier"), F.round(score, 6).alias("score")).agg(count())


@R.add("M07_policies", SQL + ", p AS (SELECT aspect_cluster, CASE WHEN count(*) FILTER (source = 'implicit') > 0.52 * count(*) THEN 'implicit_heavy' WHEN count(*) FILTER (source = 'implicit') < 0.48 * count(*) THEN 'explicit_heavy' ELSE 'mixed' END AS mode FROM mentions GROUP BY 1) SELECT aspect_cluster, CASE mode WHEN 'implicit_heavy' THEN 'evidence_strict' WHEN 'explicit_heavy' THEN 'canonical_balanced' ELSE 'balanced' END AS policy, CASE mode WHEN 'implicit_heavy' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS min_confidence_train FROM p")
def m07(spark, d):
    implicit, n = F.count_if(F.col("source") == "implicit"), F.count(F.lit(1))
    profiles = mentions(spark, d).groupBy("aspect_cluster").agg(F.when(implicit > 0.52 * n, "implicit_heavy").when(implicit < 0.48 * n, "explicit_heavy").otherwise("mixed").alias("mode"))
    return profiles.select("aspect_cluster", G.policy(F.col("mode")).alias("p")).select("aspect_cluster", "p.*")


@R.add("F01_parsed_times", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN CAST(o_orderdate AS DATE)::TIMESTAMP END AS at FROM orders")
def f01(spark, d):
    """Times written as ISO text, as dates, as words and as nothing."""
    turn = F.col("o_orderkey") % 4
    written = F.when(turn == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(turn == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(turn == 2, "last week")
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), G.parse_time(written).cast("timestamp_ntz").alias("at"))


@R.add("F03_label_variants", "SELECT DISTINCT p_name AS label, array_to_string(list_sort(list_distinct([p_name, replace(p_name, ' ', '_'), replace(p_name, ' ', '-'), p, replace(p, ' ', '_'), replace(p, ' ', '-')])), ',') AS variants FROM (SELECT p_name, CASE WHEN p_name LIKE '%y' THEN p_name[:-2] || 'ies' ELSE p_name || 's' END AS p FROM part)")
def f03(spark, d):
    return V.table(spark, d, "part").select(F.col("p_name").alias("label"), F.array_join(G.label_variants(F.col("p_name")), ",").alias("variants")).distinct()


@R.add("F04_filter_values", SQL + "SELECT nullif(trim(CASE WHEN trim(evidence) = '' THEN evidence ELSE label END), '') AS value, count(*) AS n FROM mentions GROUP BY 1")
def f04(spark, d):
    """Filter values without blanks around; a blank one is none."""
    given = F.when(F.trim("evidence") == "", F.col("evidence")).otherwise(F.col("label"))
    return mentions(spark, d).groupBy(X.blank_to_null(given).alias("value")).agg(count())


@R.add("T09_working_chunk", "WITH s AS (SELECT doc_id, source, sha1('7|' || doc_id::VARCHAR) AS o FROM documents ORDER BY o, doc_id LIMIT 150) SELECT doc_id, source FROM s ORDER BY o, doc_id LIMIT 50 OFFSET 40")
def t09(spark, d):
    """Of a seeded sample of 150 documents the chunk of 50 from the 40th on."""
    return G.working_sample(V.table(spark, d, "documents").select("doc_id", "source"), "doc_id", 7, 150, 40, 50)


@R.add("S13_benchmark_examples", SQL + ", g AS (SELECT review_id, position, coalesce(nullif(CASE WHEN conf = 95 THEN '' ELSE aspect_raw END, ''), 'unknown') || '__' || sentiment AS label FROM mentions), a AS (SELECT review_id, string_agg(label, ',' ORDER BY position, label) AS labels FROM g GROUP BY 1) SELECT review_id::VARCHAR || '_g' || row_number() OVER (PARTITION BY review_id ORDER BY position, label) AS example_id, label, labels FROM g JOIN a USING (review_id)")
def s13(spark, d):
    """An example for each gold interpretation; those without an aspect are unknown."""
    one = F.struct("position", F.concat_ws("__", F.when(F.col("conf") == 95, "unknown").otherwise(F.col("aspect_raw")), "sentiment").alias("k"), F.when(F.col("conf") == 95, "").otherwise(F.col("aspect_raw")).alias("aspect"), "sentiment")
    rows = mentions(spark, d).groupBy(F.col("review_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["aspect"].alias("aspect"), x["sentiment"].alias("sentiment"))).alias("gold"))
    rows = rows.select("id", F.lit("a review").alias("review_text"), F.lit("d").alias("domain"), F.lit("train").alias("split"), "gold")
    return G.benchmark_examples(rows).select("example_id", "label", F.array_join("labels", ",").alias("labels"))


@R.add("F17_artifact_report", """WITH r AS (SELECT doc_id AS id, source AS group_id, text AS review_text, CASE doc_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (trim(review_text, ' ') = '' OR review_text IS NULL) AS incomplete, count(*) FILTER (length(review_text) < 4) AS bad_spans,
 (SELECT count(*) FROM (SELECT group_id FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaked_groups, (SELECT count(*) FROM (SELECT lower(trim(regexp_replace(review_text, '\\s+', ' ', 'g'))) FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaked_texts, false AS valid FROM r""")
def f17(spark, d):
    """The documents as an artifact whose splits share groups and texts: not valid."""
    turn = F.col("doc_id") % 10
    split = F.when(turn == 0, "val").when(turn == 1, "test").otherwise("train")
    rows = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group_id"), F.col("text").alias("review_text"), split.alias("split"))
    issue = E.span_issue(F.col("review_text"), F.substring("review_text", 1, 4), F.array(F.lit(0), F.lit(4)))
    return G.artifact_report(rows.withColumn("issue", issue))


@R.add("F17_valid_artifact", """WITH r AS (SELECT min(doc_id) AS id FROM documents WHERE length(text) >= 4 AND trim(text, ' ') <> '' GROUP BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), c AS (SELECT count(*) FILTER (id % 10 > 1) AS n_train, count(*) FILTER (id % 10 = 0) AS n_val, count(*) FILTER (id % 10 = 1) AS n_test FROM r)
SELECT *, 0 AS incomplete, 0 AS bad_spans, 0 AS leaked_groups, 0 AS leaked_texts, least(n_train, n_val, n_test) > 0 AS valid FROM c""")
def f17_valid(spark, d):
    """The documents with each text once, its splits by document: valid where no split is empty."""
    own = V.table(spark, d, "documents").where((F.length("text") >= 4) & (F.trim("text") != ""))
    once = own.groupBy(F.lower(X.squash(F.col("text"))).alias("t")).agg(F.min("doc_id").alias("id"), F.min_by("text", "doc_id").alias("review_text"))
    turn = F.col("id") % 10
    rows = once.select("id", F.col("id").alias("group_id"), "review_text", F.when(turn == 0, "val").when(turn == 1, "test").otherwise("train").alias("split"))
    issue = E.span_issue(F.col("review_text"), F.substring("review_text", 1, 4), F.array(F.lit(0), F.lit(4)))
    return G.artifact_report(rows.withColumn("issue", issue))


@R.add("F06_matched_labels", SQL + "SELECT label, label IN ('Battery_Life', 'table service') OR contains(' ' || label || ' ', ' gear ') AS matched, count(*) AS n FROM mentions GROUP BY 1, 2")
def f06(spark, d):
    """Labels that equal a candidate or hold all of its tokens."""
    plain = F.translate("label", "_", " ")
    return mentions(spark, d).groupBy("label", C.matches_any(plain, words("battery life", "service table", "gear")).alias("matched")).agg(count())


@R.add("U06_routed_predictions", SQL + """, f AS (SELECT DISTINCT review_id, aspect_raw, aspect_cluster, conf, conf % 4 AS r, position % 2 AS odd FROM mentions), novel AS (SELECT DISTINCT review_id, aspect_cluster AS aspect, 0.9::DOUBLE AS s FROM f WHERE r = 3 AND odd = 1 UNION SELECT DISTINCT review_id, aspect_raw, 0.5::DOUBLE FROM f WHERE r = 3 AND odd = 1 UNION SELECT DISTINCT review_id, aspect_raw, NULL FROM f WHERE r = 3 AND odd = 0)
SELECT 'accepted' AS kind, count(*) AS n FROM (SELECT DISTINCT review_id, aspect_raw, conf FROM f WHERE r = 0) UNION ALL SELECT 'abstained', count(*) FROM (SELECT DISTINCT review_id, aspect_raw, conf FROM f WHERE r IN (1, 2)) UNION ALL SELECT 'novel', count(*) FROM novel""")
def u06(spark, d):
    """How many predictions are accepted, abstained and novel; half of the novel ones name candidates."""
    r = F.col("conf") % 4
    routing = F.when(r == 0, "known").when(r == 1, "boundary").when(r == 2, "abstain").otherwise("novel")
    one = lambda name, score: F.struct(F.col(name).alias("aspect"), F.lit(score).alias("novelty_score"))
    named = F.when((r == 3) & (F.col("position") % 2 == 1), F.array(one("aspect_cluster", 0.9), one("aspect_raw", 0.5)))
    item = F.struct(F.col("aspect_raw").alias("aspect"), routing.alias("routing"), F.col("conf").alias("confidence"), named.alias("novel_candidates"))
    parts = C.route_predictions(mentions(spark, d).groupBy(F.col("review_id").alias("id")).agg(F.collect_list(item).alias("predictions")))
    out = None
    for kind, part in zip(("accepted", "abstained", "novel"), parts, strict=True):
        own = part.agg(count()).select(F.lit(kind).alias("kind"), "n")
        out = own if out is None else out.union(own)
    return out


@R.add("M04_example_weights", SQL + "SELECT round(greatest(0.25, least(1.5, greatest(0.5, least(1.0, conf / 100.0::DOUBLE)) * greatest(0.5, least(1.0, position / 5.0::DOUBLE)) * (1 + 0.3::DOUBLE * CASE position % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.34::DOUBLE WHEN 2 THEN 0.67::DOUBLE ELSE 1 END))), 6) AS weight, count(*) AS n FROM mentions GROUP BY 1")
def m04(spark, d):
    tier = F.concat(F.lit("H"), (F.col("position") % 4).cast("string"))
    weight = C.quality_weight(F.col("conf") / 100, F.col("position") / 5, tier)
    return mentions(spark, d).groupBy(F.round(weight, 6).alias("weight")).agg(count())


def documents(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")


@R.add("S01_csv_reviews", "SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents WHERE text <> ''")
def s01(spark, d):
    """The documents, written as CSV with line feeds and quotes in fields, as the CSV reader gives them back."""
    path = shared_folder(spark, "reviews-csv")
    documents(spark, d).where("text <> ''").write.csv(path, header=True, escape='"', quoteAll=True)
    return S.read_csv(spark, path)


@R.add("S02_json_reviews", "SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents")
def s02(spark, d):
    """The documents as JSON lines, read back with the schema that the reader infers."""
    path = shared_folder(spark, "reviews-json")
    documents(spark, d).write.json(path)
    return S.read_jsonl(spark, path).select("doc_id", "lang", "text")


@R.add("S08_uploaded_rows", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS broken, count(*) AS n FROM orders GROUP BY 1")
def s08(spark, d):
    """Orders as an uploaded file in which each third line lacks a field: those are marked, not lost."""
    path = shared_folder(spark, "upload")
    lines = V.table(spark, d, "orders").select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey").cast("string"))).alias("id,status,user"))
    lines.write.csv(path, header=True, sep="|")
    found = S.read_csv_upload(spark, path, most_rows=10**9)
    return found.groupBy(F.when(F.col("_broken").isNotNull(), "yes").otherwise("no").alias("broken")).agg(F.count("id").alias("n"))


@R.add("R01_streamed_product_cache", f"WITH {V.SQL.strip()} SELECT product_id, round(CAST(sum(rating) AS BIGINT)::DOUBLE / count(*), 6) AS avg_rating, count(*) AS review_count, CAST(sum(helpful) AS BIGINT) AS helpful_count FROM user_reviews GROUP BY 1")
def r01(spark, d):
    """Product aggregates from a stream of changes (one for each user review, in four files), batch by batch."""
    from revlume.streaming.changes import maintain_product_cache

    feed, cache, state = (shared_folder(spark, f"feed-{x}") for x in ("in", "out", "state"))
    changes = V.user_reviews(spark, d).select("product_id", F.col("rating").cast("long").alias("rating_delta"), F.lit(1).cast("long").alias("review_delta"), F.col("helpful").alias("helpful_delta"))
    changes.repartition(4, "product_id", "rating_delta", "helpful_delta").write.parquet(feed)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    query = maintain_product_cache(stream, cache, state)
    query.awaitTermination()
    return P.read(spark, cache, "cache").select("product_id", F.round("avg_rating", 6).alias("avg_rating"), "review_count", "helpful_count")


BUILT = """WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), f AS (SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS c, unnest(range(1, len(w))) AS pos FROM w WHERE len(w) > 1), n AS (SELECT id, c, count(*) AS n, min(pos) AS first FROM f GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS place FROM n), b AS (SELECT r.id, c, split_part(c, ' ', 1) AS t1, string_split(c, ' ') AS t, trim(lower(text)) AS e, lower(text) AS low FROM r JOIN documents ON doc_id = id WHERE place <= 6),
x AS (SELECT *, list_has_any(t, ['provide','get','give','take','make','use','want','need','visit','go','come','road','center','place','area','thing','something','anything','nothing','everything','way','lot','bit']) OR c IN ('it is','there is','this is','i have','they have','we have') AS noisy,
 t1 IN ('recommend','save','lose','have','make','use','buy','try','go','come','get','take','give','watch','upload','download','open','close','this','that','these','those','my','your','our','their','his','her','its') AS begun FROM b),
y AS (SELECT *, noisy OR begun AS noise, round(CASE WHEN NOT begun AND NOT list_has_any(t, ['is','was','were','are','be','being','been']) THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN contains(e, c) AND c <> e THEN 0.15::DOUBLE ELSE 0 END
 + CASE WHEN regexp_matches(e, 'good|bad|great|poor|slow|fast|broken|broke|excellent|awful|amazing|terrible|soft|hard') THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN NOT (noisy OR begun) THEN 0.15::DOUBLE ELSE 0 END, 6) AS score FROM x),
z AS (SELECT *, CASE WHEN noise OR score < 0.35 THEN 'none' WHEN score >= 0.75 THEN 'open' WHEN score >= 0.5 THEN 'provisional' ELSE 'none' END AS bucket FROM y),
k AS (SELECT id, CASE bucket WHEN 'provisional' THEN replace(c, ' ', '_') WHEN 'open' THEN CASE WHEN t1 IN ('great','excellent','amazing','terrible','awful','bad','good','poor','delicious','tasty','slow','fast') THEN t[2] ELSE replace(c, ' ', '_') END ELSE 'unknown' END AS canonical,
 CASE bucket WHEN 'provisional' THEN 0.35 WHEN 'open' THEN 0.25 ELSE 0 END AS conf, contains(low, c) AS exact FROM z),
g AS (SELECT id, count(*) AS items, count(DISTINCT canonical) AS kinds, max(canonical = 'unknown') AS unknown, min(conf) < 0.3 AS low, NOT min(exact) AS weak FROM k GROUP BY 1),
h AS (SELECT *, CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, round(least(0.35::DOUBLE, 0.18::DOUBLE * (kinds - 1)) + CASE WHEN unknown THEN 0.15::DOUBLE ELSE 0 END + 0.1::DOUBLE, 6) AS ambiguity, concat_ws(',', CASE WHEN low THEN 'low_confidence' END, CASE WHEN weak THEN 'weak_support' END) AS reasons FROM g)
SELECT id, split, items, ambiguity, CASE WHEN unknown AND ambiguity >= 0.5 THEN 'H3' WHEN items > 4 THEN 'H2' ELSE 'H0' END AS hardness, CASE WHEN split = 'train' AND reasons <> '' THEN 'review_queue' ELSE 'benchmark_gold' END AS destination, reasons FROM h"""


@R.add("X10_built_rows", BUILT)
def x10(spark, d):
    """The documents through all stages of the builder."""
    turn = F.col("doc_id") % 3
    reviews = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.when(turn == 0, "train").when(turn == 1, "val").otherwise("test").alias("split"))
    return B.build(reviews)


@R.add("M11_merged_settings", "WITH b AS (SELECT p_brand, p_type, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names FROM part WHERE p_size < 30 GROUP BY 1, 2), o AS (SELECT p_brand, p_type, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names FROM part WHERE p_size >= 20 AND p_brand > 'Brand#2' GROUP BY 1, 2) SELECT coalesce(b.p_brand, o.p_brand) AS domain, coalesce(b.p_type, o.p_type) AS k, coalesce(o.names, b.names) AS v FROM b FULL JOIN o ON b.p_brand = o.p_brand AND b.p_type = o.p_type")
def m11(spark, d):
    """Names by brand and type as settings: those of small parts, overridden by those of large ones."""
    def settings(rows):
        lists = rows.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_name")).alias("v"))
        return lists.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "v"))))

    part = V.table(spark, d, "part")
    merged = B.merge_settings(settings(part.where("p_size < 30")), settings(part.where("p_size >= 20 and p_brand > 'Brand#2'")))
    return merged.select("domain", F.explode("settings").alias("k", "v")).select("domain", "k", F.array_join("v", ",").alias("v"))


@R.add("R02_upload_status", "SELECT CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN doc_id % 7 = 0 THEN 'empty_text' END AS error, count(*) AS n FROM documents WHERE length(trim(text, ' ' || chr(10))) > 0 GROUP BY 1, 2")
def r02(spark, d):
    """Documents as uploaded rows, each seventh without a text: those fail alone."""
    own = V.table(spark, d, "documents").where(F.length(F.trim("text", F.lit(" \n"))) > 0).withColumn("text", F.when(F.col("doc_id") % 7 > 0, F.col("text")).otherwise(" "))
    return B.upload_status(own).groupBy("status", "error").agg(count())
