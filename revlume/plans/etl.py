"""Record cleaning, profiling, splitting and text functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlume.functions import text as X
from revlume.operators import analytics as A
from revlume.operators import etl as E
from revlume.plans import views as V
from revlume.plans.analytics import rows
from revlume.plans.registry import Registry
from revlume.plans.views import with_views

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def docs(spark, d):
    return V.table(spark, d, "documents")


@R.add("S04_normalized_reviews", "SELECT doc_id::VARCHAR AS review_id, source AS group_id, lang AS domain, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def s04(spark, d):
    raw = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("group_id"), F.col("lang").alias("domain"), "text")
    return E.normalize_reviews(raw, "documents")


@R.add("S03_flattened_children", "SELECT doc_id, lang, line, count(*) AS n FROM (SELECT doc_id, coalesce(left(x, 1), lang) AS lang, x AS line FROM (SELECT doc_id, lang, unnest(CASE WHEN text IS NULL THEN [NULL] ELSE string_split(text, chr(10)) END) AS x FROM documents)) GROUP BY 1, 2, 3")
def s03(spark, d):
    """The lines of each document as child rows; the child's field overrides the parent's of the same name."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.substring(x, 1, 1).alias("lang")))
    nested = docs(spark, d).select("doc_id", "lang", lines.alias("aspects"))
    return E.flatten_aspects(nested).groupBy("doc_id", "lang", "line").agg(F.count(F.lit(1)).alias("n"))


@R.add("C01_normalized_aspects", "SELECT DISTINCT p_name AS raw, array_to_string(list_transform(string_split(trim(regexp_replace(replace(replace(lower(p_name || 's'), '_', ' '), '-', ' '), '\\s+', ' ', 'g')), ' '), lambda t: CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN t[:-4] || 'y' WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN t[:-2] ELSE t END), ' ') AS aspect FROM part")
def c01(spark, d):
    return V.table(spark, d, "part").select(F.col("p_name").alias("raw"), X.normalize(F.concat("p_name", F.lit("s"))).alias("aspect")).distinct()


@R.add("C02_aspect_keys", "SELECT DISTINCT replace(p_name, ' ', '_') AS k, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS label FROM part")
def c02(spark, d):
    return V.table(spark, d, "part").select(X.aspect_key(F.col("p_name")).alias("k"), X.aspect_label(F.col("p_name")).alias("label")).distinct()


@R.add("C04_origin", with_views("SELECT source, count(*) AS n FROM predictions GROUP BY 1"))
def c04(spark, d):
    return V.predictions(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@R.add("C06_stable_ids", "SELECT doc_id, 'r_' || substr(sha1(lower(trim(source)) || '|' || doc_id::VARCHAR), 1, 16) AS review_id FROM documents")
def c06(spark, d):
    return docs(spark, d).select("doc_id", X.stable_id("r_", F.col("source"), F.col("doc_id")).alias("review_id"))


@R.add("C07_overlap", with_views("SELECT DISTINCT aspect_raw, aspect_cluster, len(list_intersect(string_split(aspect_raw, ' '), ['red', 'gear', 'small']))::DOUBLE / 2 AS share FROM predictions"))
def c07(spark, d):
    return V.predictions(spark, d).select("aspect_raw", "aspect_cluster", X.overlap_share(F.col("aspect_raw"), F.lit("small red gear")).alias("share")).distinct()


@R.add("C08_sentences", "SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: length(x) > 0)) AS s FROM documents) GROUP BY 1")
def c08(spark, d):
    spans = docs(spark, d).select("doc_id", F.explode(X.sentence_spans(F.col("text"))).alias("s"))
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s.sentence")).alias("chars"))


@R.add("C11_phrase_spans", "SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN instr(lower(text), 'the') - 1 ELSE -1 END AS start FROM documents")
def c11(spark, d):
    return docs(spark, d).select("doc_id", X.phrase_span(F.col("text"), F.lit("The"))[0].cast("long").alias("start"))


@R.add("C12_phrase_windows", "SELECT doc_id, array_to_string(w[greatest(p - 8, 1):p + 8], ' ') AS window_text FROM (SELECT doc_id, w, list_position(list_transform(w, lambda x: contains(lower(x), 'idiot')), true) AS p FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents WHERE contains(lower(text), 'idiot'))) WHERE p > 0")
def c12(spark, d):
    own = docs(spark, d).where(F.contains(F.lower("text"), F.lit("idiot")))
    return own.select("doc_id", E.phrase_window(F.col("text"), F.lit("idiot")).alias("window_text")).where("window_text is not null")


@R.add("C24_keyword_polarity", "SELECT doc_id, CASE WHEN u > n THEN 'positive' WHEN n > u THEN 'negative' ELSE 'neutral' END AS polarity FROM (SELECT doc_id, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in X.POSITIVE) + " AS u, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in X.NEGATIVE) + " AS n FROM documents)")
def c24(spark, d):
    return docs(spark, d).select("doc_id", X.keyword_polarity(F.col("text")).alias("polarity"))


@R.add("C25_polarity_hints", with_views("s AS (SELECT DISTINCT sentiment FROM predictions) SELECT x.sentiment AS a, y.sentiment AS b, CASE WHEN x.sentiment = y.sentiment THEN x.sentiment WHEN 'neutral' NOT IN (x.sentiment, y.sentiment) THEN 'mixed' WHEN x.sentiment = 'neutral' THEN y.sentiment ELSE x.sentiment END AS hint FROM s x, s y"))
def c25(spark, d):
    s = V.predictions(spark, d).select("sentiment").distinct()
    return s.toDF("a").crossJoin(s.toDF("b")).withColumn("hint", X.polarity_hint(F.col("a"), F.col("b")))  # three by three


@R.add("C26_joint_labels", with_views("SELECT aspect || '__' || sentiment AS label, aspect, count(*) AS n FROM predictions GROUP BY 1, 2"))
def c26(spark, d):
    joint = V.predictions(spark, d).groupBy(F.concat_ws("__", "aspect", "sentiment").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return joint.withColumn("aspect", X.joint_aspect(F.col("label")))


@R.add("F10_noisy_labels", "WITH s AS (SELECT doc_id, trim(lower(unnest(regexp_extract_all(text, '[^.!?]+'))), ' ') AS label FROM documents UNION ALL SELECT -p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Get the ' || p_name WHEN 1 THEN p_name || ' thing' WHEN 2 THEN ' It is ' ELSE p_name END FROM part), t AS (SELECT doc_id, trim(lower(label), ' ') AS label, string_split(trim(regexp_replace(lower(label), '\\s+', ' ', 'g')), ' ') AS w FROM s) SELECT doc_id, count(*) AS labels, count(*) FILTER (trim(label) = '' OR w = [''] OR len(w) > 5 OR list_has_any(w, ['provide','get','give','take','make','use','want','need','visit','go','come']) OR list_has_any(w, ['visit','road','center','place','area','thing','something','anything','nothing','everything','way','lot','bit']) OR label IN ('it is','there is','this is','i have','they have','we have')) AS noisy FROM t GROUP BY 1")
def f10(spark, d):
    """Noisy ones among the sentences of whole texts, and among product names with words around."""
    sentences = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^.!?]+"), F.lit(0))).alias("label"))
    part, turn = V.table(spark, d, "part"), F.col("p_partkey") % 4
    names = part.select((-F.col("p_partkey")).alias("doc_id"), F.when(turn == 0, F.concat(F.lit("Get the "), "p_name")).when(turn == 1, F.concat("p_name", F.lit(" thing"))).when(turn == 2, " It is ").otherwise(F.col("p_name")).alias("label"))
    return sentences.union(names).groupBy("doc_id").agg(F.count(F.lit(1)).alias("labels"), F.count_if(E.noisy_label(F.col("label"))).alias("noisy"))


@R.add("F13_gate_reasons", with_views("SELECT reasons, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN conf < 93 THEN 'low_confidence' END, CASE WHEN source <> 'explicit' THEN 'weak_support' END) AS reasons FROM predictions) GROUP BY 1"))
def f13(spark, d):
    p = V.predictions(spark, d).withColumn("support", F.when(F.col("source") == "explicit", "exact").otherwise("none"))
    confidence = F.when(F.col("conf") < 93, 0.2).otherwise(0.9)
    return p.groupBy(F.array_join(E.gate_reasons(confidence, F.col("support"), F.col("aspect_raw")), ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@R.add("F15_span_issues", "WITH l AS (SELECT doc_id, text, regexp_extract(text, '([^ \\n]+)[ \\n]*$', 1) AS word FROM documents), s AS (SELECT doc_id, text, word, CASE doc_id % 5 WHEN 0 THEN length(text) + 1 ELSE length(rtrim(text, ' ' || chr(10))) END AS stop FROM l), t AS (SELECT *, CASE doc_id % 5 WHEN 1 THEN stop ELSE stop - length(word) END AS start FROM s) SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'shape' WHEN start < 0 OR stop < start OR stop > length(text) THEN 'range' WHEN start = stop THEN 'empty' WHEN lower(substr(text, start + 1, stop - start)) <> lower(word || CASE WHEN doc_id % 5 = 3 THEN '!' ELSE '' END) THEN 'mismatch' END AS issue FROM t")
def f15(spark, d):
    """The last word of each whole text as evidence: some spans out of range, empty, without an end or of other words."""
    turn, t = F.col("doc_id") % 5, F.col("text")
    own = docs(spark, d).withColumn("word", F.regexp_extract("text", r"([^ \n]+)[ \n]*$", 1)).withColumn("stop", F.when(turn == 0, F.length(t) + 1).otherwise(F.length(F.rtrim(t, F.lit(" \n")))))
    own = own.withColumn("start", F.when(turn == 1, F.col("stop")).otherwise(F.col("stop") - F.length("word")))
    span = F.when(turn == 2, F.array("start")).otherwise(F.array("start", "stop"))
    return own.select("doc_id", E.span_issue(t, F.concat("word", F.when(turn == 3, "!").otherwise("")), span).alias("issue"))


@R.add("A20_profile", "SELECT lang AS domain, count(*) AS n, count(*) FILTER (contains(lower(text), 'the') OR contains(lower(text), 'ein'))::DOUBLE / count(*) AS explicit_share, count(*) FILTER (contains(lower(text), 'idiot'))::DOUBLE / count(*) AS implicit_share FROM documents GROUP BY 1")
def a20(spark, d):
    own = docs(spark, d)
    return own.groupBy(F.col("lang").alias("domain")).agg(F.count(F.lit(1)).alias("n"), E.keyword_share(own, ("the", "ein")).alias("explicit_share"), E.keyword_share(own, ("idiot",)).alias("implicit_share"))


@R.add("A21_quality_report", with_views("SELECT 'sentiment' AS field, sentiment AS value, count(*) AS n FROM joined GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM joined GROUP BY 2 UNION ALL SELECT 'aspect', aspect, count(*) FROM joined GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM joined GROUP BY 2"))
def a21(spark, d):
    return E.histograms(rows(spark, d), ["sentiment", "source", "aspect", "domain"])


#: Texts with symptoms: products, and what is said of them in the words of their type.
SYMPTOMS = r"""t AS (SELECT lower(p_brand) AS domain, CASE p_size % 6 WHEN 0 THEN 'The ' || p_name || ' keeps ' || lower(p_type) || 'ing and stopped working.' WHEN 1 THEN 'It keep ' || lower(p_type) || 's, it does not last.' WHEN 2 THEN p_name || ' breaks under load, ' || p_name || ' under load' WHEN 3 THEN 'Does  not fit' WHEN 4 THEN NULL ELSE 'no symptom at all' END AS text,
 CASE WHEN p_size % 12 = 5 THEN 'Good' WHEN p_size % 12 = 11 THEN ' No   Symptom' END AS given FROM part), f AS (SELECT domain, lower(coalesce(text, '')) AS low, given FROM t),
 said AS (SELECT domain, low, given AS phrase FROM f WHERE given IS NOT NULL UNION ALL SELECT domain, low, 'keeps ' || unnest(regexp_extract_all(low, '\bkeeps?\s+([a-z]+(?:ing|ed|s)?)\b', 1)) FROM f WHERE given IS NULL UNION ALL SELECT domain, low, 'stopped ' || unnest(regexp_extract_all(low, '\bstopped\s+([a-z]+(?:ing|ed)?)\b', 1)) FROM f WHERE given IS NULL
 UNION ALL SELECT domain, low, 'does not ' || unnest(regexp_extract_all(low, '\bdoes\s+not\s+([a-z]+)\b', 1)) FROM f WHERE given IS NULL UNION ALL SELECT domain, low, regexp_replace(unnest(regexp_extract_all(low, '\b[a-z]+s?\s+under\s+[a-z]+\b')), '\s+', ' ', 'g') FROM f WHERE given IS NULL),
 own AS (SELECT domain, low, trim(regexp_replace(lower(phrase), '\s+', ' ', 'g')) AS phrase FROM said),
 found AS (SELECT phrase, count(*) AS support_count, array_to_string(list_sort(list_distinct(list(domain))), ',') AS domains, count(*) FILTER (contains(low, phrase) OR (starts_with(phrase, 'keeps ') AND contains(low, 'keep ' || substr(phrase, 7)))) AS evidence_valid_count FROM own WHERE phrase <> '' GROUP BY 1 HAVING count(*) >= 2),
 mined AS (SELECT 'mined_' || regexp_replace(phrase, '[^a-z0-9]+', '_', 'g') AS pattern_id, *, evidence_valid_count::DOUBLE / support_count AS rate FROM found)"""


def symptoms(spark, d):
    turn, low = F.col("p_size") % 6, F.lower("p_type")
    text = (
        F.when(turn == 0, F.concat(F.lit("The "), "p_name", F.lit(" keeps "), low, F.lit("ing and stopped working."))).when(turn == 1, F.concat(F.lit("It keep "), low, F.lit("s, it does not last.")))
        .when(turn == 2, F.concat("p_name", F.lit(" breaks under load, "), "p_name", F.lit(" under load"))).when(turn == 3, "Does  not fit").when(turn == 4, F.lit(None).cast("string")).otherwise("no symptom at all")
    )
    given = F.when(F.col("p_size") % 12 == 5, "Good").when(F.col("p_size") % 12 == 11, " No   Symptom")
    return V.table(spark, d, "part").select(F.lower("p_brand").alias("domain"), text.alias("text"), given.alias("symptom_phrase"))


@R.add("A22_mined_patterns", "WITH " + SYMPTOMS + " SELECT pattern_id, phrase, support_count, domains, evidence_valid_count, rate AS precision_estimate, CASE WHEN contains(domains, ',') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS domain_entropy FROM mined")
def a22(spark, d):
    """Symptom phrases mined from what is said of products."""
    return E.mined_patterns(symptoms(spark, d)).select("pattern_id", "phrase", "support_count", F.array_join("domains", ",").alias("domains"), "evidence_valid_count", "precision_estimate", "domain_entropy")


@R.add("X11_validated_patterns", "WITH " + SYMPTOMS + " SELECT phrase, CASE WHEN support_count < 5 OR rate < 0.8 OR phrase IN ('good', 'bad', 'quality', 'works', 'service') THEN 'review_queue' ELSE 'promoted' END AS status, concat_ws(',', CASE WHEN support_count < 5 THEN 'insufficient_support' END, CASE WHEN rate < 0.8 THEN 'invalid_evidence' END, CASE WHEN rate < 0.75 THEN 'low_precision' END, CASE WHEN phrase IN ('good', 'bad', 'quality', 'works', 'service') THEN 'broad_phrase' END) AS reasons, CASE WHEN contains(domains, ',') THEN 'global' ELSE 'domain_scoped' END AS scope FROM mined")
def x11(spark, d):
    """With a support of five, so that some fall short of it."""
    out = E.validated_patterns(E.mined_patterns(symptoms(spark, d)), ("good", "bad", "quality", "works", "service"), support=5)
    return out.select("phrase", "status", F.array_join("reason_codes", ",").alias("reasons"), F.col("domain_scope").alias("scope"))


NAMED = """raw AS (SELECT review_id, domain, position, aspect_cluster AS context, conf, CASE WHEN conf = 90 THEN 'Good ' WHEN conf = 91 THEN 'restaurant' WHEN conf = 92 THEN aspect_raw || ' quality' WHEN conf = 93 THEN ' Fit of ' || aspect_raw WHEN conf = 94 THEN '' WHEN conf = 95 THEN aspect_raw || review_id ELSE aspect_raw END AS name, CASE WHEN conf = 97 THEN 'failure_event' WHEN conf = 98 THEN 'quality_judgment' WHEN conf = 99 THEN '' ELSE 'unknown' END AS cue_type FROM joined),
ev AS (SELECT *, lower(trim(name)) AS aspect, review_id * 16 + position AS seq FROM raw), ex AS (SELECT aspect, lower(context) AS form, row_number() OVER (PARTITION BY aspect ORDER BY seq, review_id, context) AS place FROM ev), fm AS (SELECT aspect, count(DISTINCT form) AS forms FROM ex WHERE place <= 5 GROUP BY 1),
lc AS (SELECT aspect, arg_max(cue_type, {'s': seq, 'r': review_id, 'c': context}) AS cue FROM (SELECT aspect, seq, review_id, context, max(cue_type) AS cue_type FROM ev WHERE cue_type <> '' GROUP BY 1, 2, 3, 4) GROUP BY 1),
mem AS (SELECT aspect, count(*) AS support, count(DISTINCT review_id) AS reviews, count(DISTINCT domain) AS domains FROM ev GROUP BY 1),
st AS (SELECT mem.*, forms, CASE WHEN contains(aspect, 'quality') THEN 'quality' WHEN contains(aspect, 'late') THEN 'delivery' WHEN contains(aspect, 'fit') THEN 'comfort' END AS parent, cue FROM mem JOIN fm USING (aspect) LEFT JOIN lc USING (aspect)),
memory AS (SELECT *, CASE WHEN aspect IN ('', 'good') THEN 'rejected' WHEN support >= 5 AND reviews >= 3 AND forms >= 2 AND aspect <> 'restaurant' AND (parent IS NOT NULL OR coalesce(cue IN ('failure_event', 'quality_judgment'), false)) THEN 'review_queue' ELSE 'candidate' END AS status FROM st)"""


def evidence(spark, d):
    """Mentions as evidence: some names are no aspects, some too broad, some rare; some cues are strong."""
    conf, name = F.col("conf"), F.col("aspect_raw")
    named = F.when(conf == 90, "Good ").when(conf == 91, "restaurant").when(conf == 92, F.concat(name, F.lit(" quality"))).when(conf == 93, F.concat(F.lit(" Fit of "), name)).when(conf == 94, "").when(conf == 95, F.concat(name, F.col("review_id").cast("string"))).otherwise(name)
    cue = F.when(conf == 97, "failure_event").when(conf == 98, "quality_judgment").when(conf == 99, "").otherwise("unknown")
    r = A.scan(V.by_review(spark, d), V.reviews(spark, d))
    return r.select(named.alias("aspect_raw"), "review_id", "domain", F.col("aspect_cluster").alias("context"), cue.alias("cue_type"), (F.col("review_id") * 16 + F.col("position")).alias("seq"))


@R.add("A23_aspect_memory", with_views(NAMED + " SELECT aspect, support, reviews, domains, forms, parent, cue, status FROM memory"))
def a23(spark, d):
    return E.memory(evidence(spark, d)).drop("examples")


@R.add("A24_memory_summary", with_views(NAMED + " SELECT status, count(*) AS n, CAST(max(support) AS BIGINT) AS most FROM memory GROUP BY 1"))
def a24(spark, d):
    return E.memory(evidence(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("support").alias("most"))


@R.add("A25_reason_counts", with_views("SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN conf < 93 THEN 'low_confidence' END, CASE WHEN source <> 'explicit' THEN 'weak_support' END], lambda x: x IS NOT NULL)) AS reason FROM predictions) GROUP BY 1"))
def a25(spark, d):
    p = V.predictions(spark, d).withColumn("support", F.when(F.col("source") == "explicit", "exact").otherwise("none"))
    reasons = E.gate_reasons(F.when(F.col("conf") < 93, 0.2).otherwise(0.9), F.col("support"), F.col("aspect_raw"))
    return p.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


SPLIT = "g AS (SELECT DISTINCT source FROM documents), p AS (SELECT source, row_number() OVER (ORDER BY sha256('42|' || source)) AS place, count(*) OVER () AS n FROM g), s AS (SELECT source, CASE WHEN place <= greatest(1, floor(n * 0.8::DOUBLE + 0.5)) THEN 'train' WHEN place <= greatest(1, floor(n * 0.8::DOUBLE + 0.5)) + floor(n * 0.1::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM p)"


def split_docs(spark, d):
    own = docs(spark, d)
    return own.join(E.grouped_split(own, "source"), "source")


@R.add("X08_grouped_split", f"WITH {SPLIT} SELECT * FROM s")
def x08(spark, d):
    return E.grouped_split(docs(spark, d), "source")


@R.add("U04_group_leakage", f"WITH {SPLIT}, j AS (SELECT d.*, split FROM documents d JOIN s USING (source)) SELECT lang, count(DISTINCT split) AS splits FROM j GROUP BY 1 HAVING count(DISTINCT split) > 1")
def u04(spark, d):
    return E.group_leakage(split_docs(spark, d), "lang")


@R.add("U05_text_leakage", f"WITH {SPLIT}, j AS (SELECT DISTINCT lower(trim(text, ' ')) AS t, split FROM documents JOIN s USING (source)) SELECT x.split || '-' || y.split AS pair, count(*) AS texts FROM j x JOIN j y ON x.t = y.t AND x.split < y.split GROUP BY 1")
def u05(spark, d):
    return E.text_leakage(split_docs(spark, d))


@R.add("A26_split_sizes", f"WITH {SPLIT} SELECT split, count(*) AS n, count(DISTINCT source) AS groups FROM documents JOIN s USING (source) GROUP BY 1")
def a26(spark, d):
    return split_docs(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("groups"))


@R.add("U09_distinct_texts", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def u09(spark, d):
    return E.distinct_texts(docs(spark, d), "doc_id")


@R.add("X09_release_gate", f"WITH {SPLIT}, j AS (SELECT d.*, split FROM documents d JOIN s USING (source)), leak AS (SELECT count(*) AS n FROM (SELECT lower(trim(text, ' ')) FROM j GROUP BY 1 HAVING count(DISTINCT split) > 1)) SELECT count(*) AS n_rows, count(DISTINCT split) AS splits, (SELECT n FROM leak) AS leaked_texts, CASE WHEN count(DISTINCT split) < 3 THEN 'fatal' WHEN (SELECT n FROM leak) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM j")
def x09(spark, d):
    own = split_docs(spark, d)
    leaked = own.groupBy(F.lower(F.trim("text")).alias("t")).agg(F.countDistinct("split").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("leaked_texts"))
    stats = own.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("split").alias("splits")).crossJoin(leaked)
    return stats.withColumn("verdict", F.when(F.col("splits") < 3, "fatal").when(F.col("leaked_texts") > 0, "fail").otherwise("pass"))


@R.add("M02_routing", "SELECT label, r AS route, count(*) AS n FROM (SELECT label, greatest(0, least(1, 0.5::DOUBLE * abs(embedding[1]::DOUBLE) * 4 + 0.3::DOUBLE * abs(embedding[2]::DOUBLE) * 4 + 0.2::DOUBLE * abs(embedding[3]::DOUBLE) * 4)) AS s, abs(embedding[4]::DOUBLE) AS c, CASE WHEN s >= 0.85 THEN 'novel' WHEN s > 0.7 THEN 'boundary' WHEN c < 0.01 THEN 'abstain' ELSE 'known' END AS r FROM embeddings) GROUP BY 1, 2")
def m02(spark, d):
    e = V.table(spark, d, "embeddings")
    x = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    s = E.novelty_score(x(0) * 4, x(1) * 4, x(2) * 4)
    return e.groupBy("label", E.route(s, x(3)).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@R.add("M06_novelty", with_views("k AS (SELECT aspect_raw FROM predictions GROUP BY 1 HAVING count(*) > 930), x AS (SELECT CASE WHEN conf = 91 THEN ' Unknown' WHEN conf = 90 AND position = 1 THEN '' ELSE aspect_raw END AS name, aspect_raw IN (SELECT aspect_raw FROM k) AS known, (conf - 92) / 8.0::DOUBLE AS c, CASE position WHEN 2 THEN 'provisional' WHEN 3 THEN 'token_fallback' WHEN 4 THEN 'unmapped' WHEN 5 THEN NULL ELSE 'exact' END AS mapping, source = 'explicit' AS supported FROM predictions), n AS (SELECT CASE WHEN lower(trim(name)) IN ('', 'unknown') THEN 'unknown_aspect_canonical' WHEN known AND c >= 0.75 THEN 'canonical_in_registry' WHEN coalesce(mapping IN ('token_fallback', 'provisional', 'unmapped'), false) OR (c > 0 AND c < 0.75) THEN 'weak_mapping_or_untrusted_source' WHEN NOT supported THEN 'insufficient_evidence' WHEN NOT known THEN 'high_confidence_unknown_canonical' ELSE 'unmapped_evidence_supported' END AS reason FROM x) SELECT CASE reason WHEN 'canonical_in_registry' THEN 'known' WHEN 'high_confidence_unknown_canonical' THEN 'novel' WHEN 'unmapped_evidence_supported' THEN 'novel' ELSE 'boundary' END AS status, CASE reason WHEN 'unknown_aspect_canonical' THEN 0.4::DOUBLE WHEN 'canonical_in_registry' THEN 0.0::DOUBLE WHEN 'weak_mapping_or_untrusted_source' THEN 0.6::DOUBLE WHEN 'insufficient_evidence' THEN 0.5::DOUBLE WHEN 'high_confidence_unknown_canonical' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS score, reason, count(*) AS n FROM n GROUP BY 1, 2, 3"))
def m06(spark, d):
    """Names in the registry are the frequent ones; some mappings are weak, some names blank, some without evidence."""
    p, at = V.predictions(spark, d), F.col("position")
    known = p.groupBy("aspect_raw").agg(F.count(F.lit(1)).alias("n")).where("n > 930").select("aspect_raw", F.lit(True).alias("known"))
    own = p.join(known, "aspect_raw", "left")
    name = F.when(F.col("conf") == 91, " Unknown").when((F.col("conf") == 90) & (at == 1), "").otherwise(F.col("aspect_raw"))
    mapping = F.when(at == 2, "provisional").when(at == 3, "token_fallback").when(at == 4, "unmapped").when(at == 5, F.lit(None).cast("string")).otherwise("exact")
    found = E.novelty(name, F.coalesce("known", F.lit(False)), (F.col("conf") - 92) / 8.0, mapping, F.col("source") == "explicit")
    return own.select(found.alias("f")).groupBy("f.status", "f.score", "f.reason").agg(F.count(F.lit(1)).alias("n"))


@R.add("M09_snapshot_hash", "WITH b AS (SELECT source, doc_id // 1000 AS block, sha1(string_agg(doc_id::VARCHAR || ':' || sha1(text), '|' ORDER BY doc_id, sha1(text))) AS h FROM documents GROUP BY 1, 2), c AS (SELECT source, block // 1000 AS upper, sha1(string_agg(h, '|' ORDER BY block)) AS h FROM b GROUP BY 1, 2) SELECT source, sha1(string_agg(h, '|' ORDER BY upper)) AS snapshot FROM c GROUP BY 1")
def m09(spark, d):
    return E.snapshot(docs(spark, d), "doc_id", "text", "source")


@R.add("M12_memo_lookup", with_views("c AS (SELECT sha256('model:' || aspect_raw) AS k, count(*) AS uses FROM predictions WHERE conf >= 98 GROUP BY 1) SELECT a.aspect_raw, c.uses FROM (SELECT DISTINCT aspect_raw FROM predictions) a LEFT JOIN c ON c.k = sha256('model:' || a.aspect_raw)"))
def m12(spark, d):
    p = V.predictions(spark, d)
    key = F.sha2(F.concat(F.lit("model:"), "aspect_raw"), 256)
    memo = p.where("conf >= 98").groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("uses"))
    return p.select("aspect_raw").distinct().withColumn("k", key).join(memo, "k", "left").select("aspect_raw", "uses")
