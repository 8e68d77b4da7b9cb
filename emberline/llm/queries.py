"""One query for each operation, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import decontam, fingerprints, html_text, langid, mixing, neighbors, passages, quality, runs, simhash, suffix_dedup, turn_trie, url_filter
from emberline.llm.registry import query, table
from emberline.storage import materialize

URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_URL_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM parts
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT u.page_id, max_by(r.host || r.path, length(r.host) * 1000 + length(r.path)) AS rule,
         max_by(r.verdict, length(r.host) * 1000 + length(r.path)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.page_id
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits f USING (page_id)
"""


@query("op3_url_filter", _URL_SQL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def fitted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    return quality.train(docs, quality.grades_of_labels(table(spark, sf_dir, "labels")), n_grades=3)


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, fitted_quality(spark, docs, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sizes GROUP BY source
), weighted AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), chosen AS (
  SELECT coalesce(min(level) FILTER (WHERE level <= cap / weight), max(cap / weight)) AS level FROM (
    SELECT *, row_number() OVER (ORDER BY cap / weight, number) AS rn, min(CASE WHEN level <= cap / weight THEN 1 ELSE 2 END) OVER () AS m FROM levels) l
  WHERE rn = (SELECT min(rn) FROM (SELECT row_number() OVER (ORDER BY cap / weight, number) AS rn, level, cap / weight AS ratio FROM levels) x WHERE level <= ratio) OR m = 2
), targets AS (
  SELECT w.*, least(w.weight * c.level, w.cap) AS target FROM weighted w, chosen c
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.number, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
, counted AS (
  SELECT *, round(target - whole * source_size)::BIGINT AS rest, least(greatest(round(target - whole * source_size)::BIGINT - before, 0), size) AS extra FROM placed
), copied AS (
  SELECT *, whole * size + extra AS taken, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN extra > 0 THEN 1 ELSE 0 END END AS n_copies,
         (before + CASE WHEN whole > 0 THEN size ELSE extra END / 2.0::DOUBLE) / (whole * source_size + rest) AS early,
         CASE WHEN extra > 0 THEN (whole * source_size + before + extra / 2.0::DOUBLE) ELSE ((whole - 1) * source_size + before + size / 2.0::DOUBLE) END / (whole * source_size + rest) AS late
  FROM counted
)
SELECT doc_id, size, source_size, target, taken, n_copies,
       CASE WHEN n_copies > 0 THEN round({first}, 9) END AS first_position, CASE WHEN n_copies > 0 THEN round({last}, 9) END AS last_position
FROM copied
"""


def _time_sql(share: str) -> str:
    """When a share is due on the three schedules: from weight 3/2 down to 1/2, even, and from 1/2 up to 3/2."""
    up = f"CASE WHEN {share} <= 0.375 THEN 2 * {share} / (0.5 + sqrt(0.25 + 2 * {share})) ELSE 0.5 + 2 * ({share} - 0.375) / (1 + sqrt(1 + 2 * ({share} - 0.375))) END"
    return f"least(1.0, CASE number % 3 WHEN 0 THEN 2 * {share} / (1.5 + sqrt(greatest(2.25 - 2 * {share}, 0))) WHEN 1 THEN {share} ELSE {up} END)"


_MIX_SQL = _MIX_SQL.replace("{first}", _time_sql("early")).replace("{last}", _time_sql("late"))


@query("op9_mixing", _MIX_SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    places = {n: F.round(F.try_element_at("copies.position", F.lit(i)), 9) for n, i in (("first_position", 1), ("last_position", -1))}
    out = plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("n_copies"), *[c.alias(n) for n, c in places.items()])
    # in the order in which training first reads the documents; those never read come last
    order = [F.col("first_position").asc_nulls_last(), "doc_id"]
    return materialize(out, "mix").repartitionByRange(*order).sortWithinPartitions(*order)


_LEAK_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [chr(10) || array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), bs AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                       WHEN len(w) > 0 THEN [chr(10) || array_to_string(w, ' ')] ELSE [] END) AS s FROM b
), n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) / n::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n
HAVING count(*) >= ceil(0.8 * n - 1e-9)
"""


@query("op8_decontamination", _LEAK_SQL)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs.where(~held_out_of("doc_id")))
    found = langid.predict(docs, net)
    return found.select(F.col("id").alias("doc_id"), held_out_of("id").alias("held_out"), "lang_pred", "score")


def held_out_of(column: str):
    """Whether a document is kept from learning; never one without an id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_versions(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "earlier_id": "earlier_doc_id"})


def looped_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents, by a hash of the id, go on from some word to their end by repeating a few words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    rows = rows.withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    left = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil(left / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    text = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), left))
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(looped_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # longest first; then the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.select("id", "runs", "collapsed", F.array_join(lines, "").alias("lines"), best.alias("best"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_NEAR_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), sound AS (
  SELECT vec_id, x FROM vectors
  WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reached AS (
  SELECT vec_id AS u, vec_id AS v FROM vectors UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u
), counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT r.u AS vec_id, coalesce(any_value(c.n), 0)::BIGINT AS n_links, min(r.v) AS component_id, min(r.v) = r.u AS kept
FROM reached r LEFT JOIN counts c ON c.u = r.u GROUP BY r.u
"""


@query("op12_embedding_near_dedup", _NEAR_SQL)
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbors.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


_TRIE_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv, conv - conv % 5 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
             lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                 lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv FROM given)
), turns AS (
  SELECT c.conv, g.n AS place, g.role, g.text FROM convs c JOIN given g ON g.conv = c.base AND g.n <= c.h
  UNION ALL
  SELECT c.conv, g.n + 8 AS place, g.role, g.text FROM convs c JOIN given g ON g.conv = c.conv AND g.n > c.h
), rebuilt AS (
  SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY place) AS depth, sha256(strlen(role) || ':' || role || text) AS sha, strlen(text) AS n_bytes FROM turns
), prefixes AS (
  SELECT conv, 0::BIGINT AS depth, ''::VARCHAR AS prefix, NULL::VARCHAR AS parent, 0::BIGINT AS n_bytes FROM convs
  UNION ALL
  SELECT r.conv, r.depth, sha256(p.prefix || r.sha), p.prefix, r.n_bytes FROM prefixes p JOIN rebuilt r ON r.conv = p.conv AND r.depth = p.depth + 1
), lengths AS (
  SELECT conv, max(depth) AS n FROM prefixes GROUP BY conv
), nodes AS (
  SELECT p.depth, p.prefix, any_value(p.parent) AS parent, min(p.conv) AS conv, count(*) AS n_convs, any_value(p.n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(p.conv::VARCHAR, ',' ORDER BY p.conv) FILTER (WHERE p.depth = l.n), '')) AS ends
  FROM prefixes p JOIN lengths l USING (conv) GROUP BY p.depth, p.prefix
), children AS (
  SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY depth, parent
), below AS (
  SELECT a.depth, a.prefix, n.depth AS d, n.prefix AS x, n.parent AS up FROM nodes a JOIN nodes n ON a.depth = n.depth AND a.prefix = n.prefix
  UNION ALL
  SELECT b.depth, b.prefix, n.depth, n.prefix, n.parent FROM below b JOIN nodes n ON n.depth = b.d + 1 AND n.parent = b.x
), sums AS (
  SELECT b.depth, b.prefix, count(*) FILTER (WHERE c.n IS NULL)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.n_bytes)::BIGINT AS saved
  FROM below b JOIN nodes n ON n.depth = b.d AND n.prefix = b.x LEFT JOIN children c ON c.depth = b.d AND c.prefix = b.x GROUP BY b.depth, b.prefix
)
SELECT n.conv AS conv_id, n.depth, p.conv AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.n_leaves, s.saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.prefix = n.prefix LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.parent
"""


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of each conversation with its first ones, up to 8 by a hash of the id, taken from the conversation its family begins with; and all conversations."""
    turns = turn_trie.numbered_turns(conversations)
    convs = turns.where("depth = 1").select("conv", (F.col("conv") - F.col("conv") % 5).alias("base"), (F.crc32(F.col("conv").cast("string")) % 9).alias("h"))
    early = turns.where("depth <= 8").withColumnsRenamed({"conv": "c"})
    taken = convs.join(early, (F.col("base") == F.col("c")) & (F.col("depth") <= F.col("h"))).select("conv", "depth", "h1", "h2", "n_bytes")
    there = early.groupBy("c").agg(F.max("depth").alias("n"))
    facts = convs.join(there, F.col("base") == F.col("c"), "left").select(F.col("conv").alias("c"), "h", F.least("h", F.coalesce("n", F.lit(0))).alias("n"))
    own = turns.join(facts, F.col("conv") == F.col("c")).where("depth > h").select("conv", (F.col("depth") - F.col("h") + F.col("n")).alias("depth"), "h1", "h2", "n_bytes")
    return materialize(taken.unionByName(own), "rebuilt"), convs.select("conv")


@query("op11_conversation_trie", _TRIE_SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(*rebuilt_conversations(table(spark, sf_dir, "conversations"))).drop("n_ends")
