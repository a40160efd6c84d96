"""Per-record queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlume.operators import etl as E
from revlume.operators import mapping as M
from revlume.operators import phrases as P
from revlume.operators import records as C
from revlume.operators import similar as S
from revlume.plans import views as V
from revlume.plans.analytics import rows
from revlume.plans.registry import Registry
from revlume.plans.views import with_views

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def words(*given: str):
    return F.array(*(F.lit(w) for w in given))


@R.add("F05_explicit_gate", with_views("""w AS (SELECT *, string_split(aspect_raw, ' ') AS t FROM predictions) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN aspect_raw = 'old bolt' THEN 'low_quality_aspect' WHEN list_contains(t, 'gear') OR list_has_all(t, ['red', 'widget']) THEN 'domain' WHEN list_contains(t, 'ring') THEN 'generic' WHEN list_contains(t, 'anvil') THEN 'domain_mismatch' ELSE 'open_world' END AS reason FROM w) GROUP BY 1"""))
def f05(spark, d):
    gate = C.explicit_gate(F.col("aspect_raw"), words("old bolt"), words("gear", "red widget"), words("ring"), words("anvil"))
    return V.predictions(spark, d).groupBy(gate["reason"].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@R.add("U08_collapsed_fragments", with_views("""x AS (SELECT DISTINCT review_id, sentiment, aspect_raw AS canonical, conf AS confidence FROM predictions), y AS (SELECT DISTINCT review_id, sentiment, split_part(canonical, ' ', 2) AS canonical, 0 AS confidence FROM x UNION ALL SELECT review_id, sentiment, canonical, max(confidence) FROM x GROUP BY 1, 2, 3),
z AS (SELECT *, first_value(canonical) OVER w AS winner, row_number() OVER w AS place FROM y WINDOW w AS (PARTITION BY review_id, sentiment ORDER BY length(canonical) DESC, confidence DESC, canonical)) SELECT review_id, sentiment, canonical FROM z WHERE place = 1 OR NOT contains(winner, canonical)"""))
def u08(spark, d):
    x = V.predictions(spark, d).groupBy("review_id", "sentiment", F.col("aspect_raw").alias("canonical")).agg(F.max("conf").alias("confidence"))
    short = x.select("review_id", "sentiment", F.split_part("canonical", F.lit(" "), F.lit(2)).alias("canonical"), F.lit(0).cast("long").alias("confidence")).distinct()
    return C.collapse_fragments(x.unionByName(short), ["review_id", "sentiment"]).select("review_id", "sentiment", "canonical")


@R.add("A27_row_novelty", with_views("""i AS (SELECT review_id, conf / 100.0::DOUBLE AS c, CASE sentiment WHEN 'negative' THEN 'novel' WHEN 'neutral' THEN 'boundary' ELSE 'known' END AS s FROM predictions), a AS (SELECT review_id, count(*) AS n, count(*) FILTER (s = 'novel') AS novel, count(*) FILTER (s <> 'known') AS odd, max({'c': c, 's': s}) AS top FROM i GROUP BY 1)
SELECT review_id, CASE WHEN top.s = 'novel' THEN 'novel' WHEN 2 * novel > n THEN 'novel' WHEN odd > 0 THEN 'boundary' ELSE 'known' END AS novelty FROM a"""))
def a27(spark, d):
    status = F.when(F.col("sentiment") == "negative", "novel").when(F.col("sentiment") == "neutral", "boundary").otherwise("known")
    items = V.predictions(spark, d).groupBy("review_id").agg(F.collect_list(F.struct((F.col("conf") / 100).alias("confidence"), status.alias("status"))).alias("items"))
    return items.select("review_id", C.row_novelty(F.col("items")).alias("novelty"))


AMBIGUITY = """i AS (SELECT review_id, CASE WHEN conf = 95 THEN 'unknown' ELSE aspect END AS canonical, source, CASE WHEN position = 3 THEN 'unknown' ELSE sentiment END AS sentiment, CAST(conf AS DOUBLE) / 100 - 0.45::DOUBLE AS confidence FROM predictions),
a AS (SELECT review_id, count(*) AS n, max(canonical = 'unknown') AS unnamed, max(source = 'implicit') AS implicit, count(DISTINCT sentiment) AS moods,
 round(least(1.0::DOUBLE, least(0.35::DOUBLE, 0.18::DOUBLE * (count(DISTINCT canonical) - 1)) + CASE WHEN count(DISTINCT source) > 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN count(DISTINCT sentiment) FILTER (sentiment <> 'unknown') > 1 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN max(canonical = 'unknown') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN min(confidence) < 0.5 THEN 0.1::DOUBLE ELSE 0 END), 6) AS score FROM i GROUP BY 1)"""


def ambiguous(spark, d):
    """Reviews with their items; some without a canonical name, a sentiment or confidence, and some novel."""
    one = F.struct(
        F.when(F.col("conf") == 95, "unknown").otherwise(F.col("aspect")).alias("canonical"), "source", F.when(F.col("position") == 3, "unknown").otherwise(F.col("sentiment")).alias("sentiment"), (F.col("conf") / 100 - 0.45).alias("confidence"))
    items = V.predictions(spark, d).groupBy("review_id").agg(F.collect_list(one).alias("items"))
    return items.withColumn("score", F.round(C.ambiguity(F.col("items")), 6)).withColumn("novelty", F.when(F.col("review_id") % 5 == 0, "novel").otherwise("known"))


@R.add("A28_ambiguity", with_views(AMBIGUITY + " SELECT review_id, score FROM a"))
def a28(spark, d):
    return ambiguous(spark, d).select("review_id", "score")


@R.add("W07_hardness", with_views(AMBIGUITY + " SELECT CASE WHEN (review_id % 5 = 0 OR unnamed) AND score >= 0.5 THEN 'H3' WHEN n > 4 OR moods > 1 THEN 'H2' WHEN implicit THEN 'H1' ELSE 'H0' END AS tier, count(*) AS n FROM a GROUP BY 1"))
def w07(spark, d):
    return ambiguous(spark, d).groupBy(C.hardness(F.col("items"), F.col("score"), F.col("novelty")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@R.add("J13_ordered_mapping", with_views("""p AS (SELECT DISTINCT aspect_raw, split_part(aspect_raw, ' ', 2) AS anchor FROM predictions), one AS (SELECT p_name AS aspect_raw, min(p_brand) AS c FROM part WHERE p_name LIKE 'r%' GROUP BY 1), two AS (SELECT split_part(p_name, ' ', 2) AS anchor, min(p_brand) AS c FROM part WHERE split_part(p_name, ' ', 2) < 'h' GROUP BY 1)
SELECT p.*, coalesce(one.c, two.c) AS canonical, CASE WHEN one.c IS NOT NULL THEN 'phrase' WHEN two.c IS NOT NULL THEN 'anchor' ELSE 'unmapped' END AS layer, CASE WHEN one.c IS NOT NULL THEN 1.0::DOUBLE WHEN two.c IS NOT NULL THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM p LEFT JOIN one USING (aspect_raw) LEFT JOIN two USING (anchor)"""))
def j13(spark, d):
    part = V.table(spark, d, "part").select(F.col("p_name").alias("aspect_raw"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("anchor"), "p_brand")
    items = V.predictions(spark, d).select("aspect_raw", F.split_part("aspect_raw", F.lit(" "), F.lit(2)).alias("anchor")).distinct()
    one = part.where("aspect_raw like 'r%'").groupBy("aspect_raw").agg(F.min("p_brand").alias("canonical"))
    two = part.where("anchor < 'h'").groupBy("anchor").agg(F.min("p_brand").alias("canonical"))
    return C.map_by_steps(items, [("phrase", 1.0, one, ["aspect_raw"]), ("anchor", 0.8, two, ["anchor"])])


DICTIONARY = """nm AS (SELECT 'generic' AS domain, split_part(p_name, ' ', 2) AS key, min(p_brand) AS canonical FROM part WHERE split_part(p_name, ' ', 2) < 'c' GROUP BY 2 UNION ALL SELECT 'building', p_name, min(p_brand) FROM part WHERE p_name LIKE 'r%' GROUP BY 2 UNION ALL SELECT 'machinery', split_part(p_name, ' ', 1), min(p_brand) FROM part WHERE p_name < 'i' GROUP BY 2 UNION ALL SELECT 'machinery', split_part(p_name, ' ', 2), max(p_brand) FROM part WHERE p_name LIKE '% anvil' GROUP BY 2),
md AS (SELECT DISTINCT 'generic' AS domain, split_part(p_name, ' ', 2) AS anchor, split_part(p_name, ' ', 1) AS modifier, replace(p_name, ' ', '_') AS canonical FROM part WHERE p_name LIKE '% gear' UNION ALL SELECT DISTINCT 'automobile', 'gear', 'hot', 'heat' FROM part),
it AS (SELECT lower(domain) AS domain, aspect_raw, split_part(aspect_raw, ' ', 1) AS adj, split_part(aspect_raw, ' ', 2) AS noun, CASE WHEN conf = 100 AND source = 'implicit' THEN aspect END AS learned, count(*) AS n FROM joined GROUP BY ALL),
two AS (SELECT d.domain, a.anchor, a.modifier, coalesce(max(a.canonical) FILTER (a.domain = d.domain), max(a.canonical) FILTER (a.domain = 'generic')) AS canonical, string_agg(DISTINCT CASE a.domain WHEN 'generic' THEN 'generic' ELSE 'domain_specific' END, '+' ORDER BY CASE a.domain WHEN 'generic' THEN 'generic' ELSE 'domain_specific' END DESC) AS scope FROM (SELECT DISTINCT domain FROM it) d JOIN md a ON a.domain IN (d.domain, 'generic') GROUP BY 1, 2, 3),
one AS (SELECT d.domain, a.key, coalesce(max(a.canonical) FILTER (a.domain = d.domain), max(a.canonical) FILTER (a.domain = 'generic')) AS canonical FROM (SELECT DISTINCT domain FROM it) d JOIN nm a ON a.domain IN (d.domain, 'generic') GROUP BY 1, 2),
kn AS (SELECT DISTINCT domain, key FROM nm UNION SELECT domain, anchor FROM md), met AS (SELECT it.*, two.canonical AS c2, two.scope AS s2, p.canonical AS c3, a.canonical AS c4, t.canonical AS c5, CASE WHEN p.canonical IS NOT NULL THEN p.key WHEN a.canonical IS NOT NULL THEN a.key ELSE t.key END AS key FROM it LEFT JOIN two ON two.domain = it.domain AND anchor = noun AND modifier = adj LEFT JOIN one p ON p.domain = it.domain AND p.key = aspect_raw LEFT JOIN one a ON a.domain = it.domain AND a.key = noun LEFT JOIN one t ON t.domain = it.domain AND t.key = adj)
SELECT domain, aspect_raw, coalesce(learned, c2, c3, c4, c5) AS canonical, CASE WHEN learned IS NOT NULL THEN 'trusted_learned' WHEN c2 IS NOT NULL THEN 'anchor_modifier' WHEN c3 IS NOT NULL THEN 'exact_phrase' WHEN c4 IS NOT NULL THEN 'anchor_only' ELSE 'token_fallback' END AS mapping_source, CASE WHEN learned IS NOT NULL THEN 'learned_store' WHEN c2 IS NOT NULL THEN s2 WHEN NOT EXISTS (SELECT 1 FROM kn WHERE kn.key = met.key AND kn.domain = met.domain) THEN 'generic' WHEN EXISTS (SELECT 1 FROM kn WHERE kn.key = met.key AND kn.domain = 'generic') THEN 'generic+domain_specific' ELSE 'domain_specific' END AS scope, n FROM met WHERE coalesce(learned, c2, c3, c4, c5) IS NOT NULL"""


def mapped(spark, d):
    """Mentions, each kind once with its count, mapped by a dictionary from the products; labels and latent families are product types."""
    part = V.table(spark, d, "part")
    adjective, noun = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    entry = lambda domain, key, rows, name: rows.groupBy(F.lit(domain).alias("domain"), key.alias("key")).agg(name.alias("canonical"))
    names = entry("generic", noun, part.where(noun < "c"), F.min("p_brand")).unionByName(entry("building", F.col("p_name"), part.where("p_name like 'r%'"), F.min("p_brand")))
    names = names.unionByName(entry("machinery", adjective, part.where("p_name < 'i'"), F.min("p_brand"))).unionByName(entry("machinery", noun, part.where("p_name like '% anvil'"), F.max("p_brand")))
    modifiers = part.where("p_name like '% gear'").select(F.lit("generic").alias("domain"), noun.alias("anchor"), adjective.alias("modifier"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("canonical")).distinct()
    modifiers = modifiers.unionByName(part.select(F.lit("automobile").alias("domain"), F.lit("gear").alias("anchor"), F.lit("hot").alias("modifier"), F.lit("heat").alias("canonical")).distinct())
    broad = part.select(F.lit("generic").alias("domain"), F.lower("p_type").alias("label")).distinct()
    learned = F.when((F.col("conf") == 100) & (F.col("source") == "implicit"), F.col("aspect"))
    kinds = rows(spark, d).groupBy(F.lower("domain").alias("domain"), "aspect_raw", learned.alias("aspect_canonical"), F.lower("aspect_cluster").alias("latent_family"))
    items = kinds.agg(F.count(F.lit(1)).alias("n")).select(
        "domain", "aspect_raw", "aspect_canonical", "latent_family", "n", F.when(F.col("aspect_canonical").isNotNull(), "implicit_learned").otherwise("explicit").alias("source_type"),
        F.split_part("aspect_raw", F.lit(" "), F.lit(2)).alias("aspect_anchor"), F.array(F.split_part("aspect_raw", F.lit(" "), F.lit(1))).alias("modifier_terms"))
    found = M.map_aspects(items, names, modifiers, broad)
    return found.groupBy("domain", "aspect_raw", "canonical", "mapping_source", "scope").agg(F.sum("n").alias("n"))


@R.add("J13_mapped_aspects")
def j13_mapped(spark, d):
    """Names by all steps, those of similar names and latent families included."""
    return mapped(spark, d)


@R.add("J13_dictionary_steps", with_views(DICTIONARY))
def j13_steps(spark, d):
    """Names by keys of the dictionary."""
    return mapped(spark, d).where(F.col("mapping_source").isin("trusted_learned", "anchor_modifier", "exact_phrase", "anchor_only", "token_fallback"))


@R.add("C21_top_bigrams", "WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), f AS (SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram, unnest(range(1, len(w))) AS pos FROM w WHERE len(w) > 1), c AS (SELECT id, bigram, count(*) AS n, min(pos) AS first FROM f GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS INTEGER) AS place FROM c) SELECT id, place, bigram, n FROM r WHERE place <= 6")
def c21(spark, d):
    return C.top_bigrams(V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@R.add("A36_set_scores", with_views("s AS (SELECT review_id AS id, coalesce(list_distinct(list(aspect) FILTER (source = 'implicit')), []) AS p, coalesce(list_distinct(list(aspect) FILTER (source = 'explicit')), []) AS g FROM predictions GROUP BY 1), k AS (SELECT id, len(list_intersect(p, g))::DOUBLE AS hits, len(p) AS np, len(g) AS ng FROM s), x AS (SELECT id, CASE WHEN np > 0 THEN hits / np ELSE 0 END AS precision, CASE WHEN ng > 0 THEN hits / ng ELSE 0 END AS recall FROM k) SELECT id, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM x"))
def a36(spark, d):
    own = lambda s: F.collect_set(F.when(F.col("source") == s, F.col("aspect")))
    sets = V.predictions(spark, d).groupBy(F.col("review_id").alias("id")).agg(own("implicit").alias("predicted"), own("explicit").alias("gold"))
    return C.set_scores(sets)


def pattern_store(spark, d):
    """A store from benchmark texts: three words of each, some of one language alone, some not promoted, and forms of two."""
    items, turn = V.table(spark, d, "benchmark"), F.col("item_id") % 6
    words = F.split("text", " ")
    own = F.array_join(F.slice(words, 4, 3), " ")
    # of some the order is another, so that only their words are found
    phrase = F.when(turn == 5, F.array_join(F.reverse(F.slice(words, 2, 4)), " ")).otherwise(own)
    return items.select(
        F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("pattern_id"), phrase.alias("phrase"), F.lower(own).alias("aspect_canonical"), F.lit("mined").alias("latent_family"),
        F.when(turn == 4, "review_queue").otherwise("promoted").alias("status"), F.when(turn == 3, "domain_scoped").otherwise("global").alias("domain_scope"), F.array(F.lit("EN")).alias("domains"),
        (0.5 + 0.1 * (F.col("item_id") % 5)).alias("confidence"), F.lit(0.6).alias("precision_estimate"),
    )


def review_texts(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), "text")


@R.add("C14_pattern_matches", "WITH p AS (SELECT 'p' || item_id AS pattern_id, array_to_string(string_split(text, ' ')[4:6], ' ') AS phrase, item_id % 6 AS turn, 0.5::DOUBLE + 0.1::DOUBLE * (item_id % 5) AS c FROM benchmark WHERE item_id % 6 < 4) SELECT doc_id AS id, pattern_id, CAST(strpos(lower(text), lower(phrase)) - 1 AS INTEGER) AS start_char, CAST(strpos(lower(text), lower(phrase)) - 1 + length(phrase) AS INTEGER) AS end_char, substr(text, strpos(lower(text), lower(phrase)), length(phrase)) AS matched_text, round(greatest(c, 0.6::DOUBLE), 6) AS confidence FROM documents, p WHERE contains(lower(text), lower(phrase)) AND (turn <> 3 OR lang = 'en')")
def c14(spark, d):
    """Where each promoted phrase stands as it is, in whole texts."""
    found = P.match_patterns(review_texts(spark, d), pattern_store(spark, d), resolve=False).where("match_type = 'exact'")
    return found.select("id", "pattern_id", "start_char", "end_char", "matched_text", F.round("confidence", 6).alias("confidence"))


@R.add("C13_resolved_matches")
def c13(spark, d):
    """Matches of all kinds, forms and windows included, the surer one of those that overlap."""
    return P.match_patterns(review_texts(spark, d), pattern_store(spark, d))


@R.add("J12_cross_split_containment", "SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)")
def j12(spark, d):
    """Documents that hold a benchmark text."""
    items = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    return C.containing(V.table(spark, d, "documents").select("doc_id", "text"), items).select("item_id", "doc_id")


@R.add("J12_near_duplicates", """WITH RECURSIVE g AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY sha256('42|' || p_partkey)) AS place, count(*) OVER () AS n FROM part), s AS (SELECT id, CASE WHEN place <= greatest(1, floor(n * 0.8::DOUBLE + 0.5)) THEN 'train' WHEN place <= greatest(1, floor(n * 0.8::DOUBLE + 0.5)) + floor(n * 0.1::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM g),
t AS (SELECT id, split, lower(trim(p_name || ' ' || p_brand)) AS text FROM part JOIN s ON id = p_partkey), u AS (SELECT DISTINCT text FROM t),
close AS (SELECT x.text AS a, y.text AS b FROM u x JOIN u y ON x.text < y.text AND levenshtein(x.text, y.text) * 10 <= length(x.text) + length(y.text)),
r AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0::BIGINT) AS line FROM close UNION ALL SELECT a, b, i + 1, list_transform([list_transform(range(1, length(b) + 1), lambda j: CASE WHEN substr(b, CAST(j AS INTEGER), 1) = substr(a, i + 1, 1) THEN line[j] + 1 ELSE line[j + 1] END)], lambda c: [0::BIGINT] || list_transform(range(1, length(b) + 1), lambda j: list_max(c[1:j])))[1] FROM r WHERE i < length(a)),
p AS (SELECT a, b FROM r WHERE i = length(a) AND 10 * (length(a) + length(b) - 2 * line[length(b) + 1]) <= length(a) + length(b)), twice AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), o AS (SELECT * FROM (VALUES ('train', 0), ('val', 1), ('test', 2)) v(split, turn))
SELECT DISTINCT x.id, x.split, y.split AS other_split FROM t x JOIN twice ON x.text = a JOIN t y ON y.text = b JOIN o AS m ON m.split = x.split JOIN o AS n ON n.split = y.split WHERE m.turn < n.turn""")
def j12_near(spark, d):
    """Products whose title has a near copy in a later split."""
    part = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return S.near_copies(part.join(E.grouped_split(part, "id"), "id"), ["train", "val", "test"])


@R.add("C19_fuzzy_names")
def c19(spark, d):
    """The best name of the dictionary for names as they are typed: turned round, cut short, with a word more, with a letter less."""
    name, turn = F.col("p_name"), F.col("p_partkey") % 4
    words = F.split(name, " ")
    part = V.table(spark, d, "part")
    typed = F.when(turn == 0, F.array_join(F.reverse(words), " ")).when(turn == 1, F.substring(name, 1, 6)).when(turn == 2, F.concat(F.upper(name), F.lit(" of Brand"))).otherwise(F.concat(F.substring(name, 1, 3), F.substring(name, 5, 30)))
    return S.best_match(part.select(typed.alias("query")), part.select(name.alias("candidate")))


@R.add("X15_single_issue_rows", with_views("SELECT review_id, aspect_raw, conf FROM predictions WHERE (conf < 93) <> (source <> 'explicit')"))
def x15(spark, d):
    """Rows with exactly one reason against them."""
    p = V.predictions(spark, d).withColumn("support", F.when(F.col("source") == "explicit", "exact").otherwise("none"))
    reasons = E.gate_reasons(F.when(F.col("conf") < 93, 0.2).otherwise(0.9), F.col("support"), F.col("aspect_raw"))
    return p.where(F.size(reasons) == 1).select("review_id", "aspect_raw", "conf")


@R.add("S17_export", with_views("SELECT domain, count(*) AS mentions, count(DISTINCT review_id) AS reviews, count(DISTINCT aspect) AS aspects FROM joined GROUP BY 1"))
def s17(spark, d):
    """The head of the export document of each domain."""
    return rows(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("review_id").alias("reviews"), F.countDistinct("aspect").alias("aspects"))
