"""Queries of the deduplication, rating, normalisation and reference families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.functions import keys, paths
from cratewright.operators import changes, dedup, joins, normalize, rank, stages
from cratewright.plans.registry import query
from cratewright.plans.text_queries import LIVE_SQL
from cratewright.sources.files import size_class
from cratewright.session import table

c = F.col


def low_sql(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


# ---- paths and keys

_PATH = "CASE WHEN inner_ <> '' THEN '/' || replace(inner_, '/:', '/') ELSE '' END || '/' || loc_file"
_PATHS = f"p AS (SELECT entry_id, loc_dir, loc_file, {_PATH} AS path FROM (SELECT *, regexp_replace(regexp_replace(trim(loc_dir), '^/:', ''), '/:$', '') AS inner_ FROM nml_entry))"


def entry_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nml_entry").withColumn("path", paths.location_to_path(c("loc_dir"), c("loc_file")))


@query(f"""
WITH {_PATHS}
SELECT entry_id, path, 'Macintosh HD/:' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/:') AS key,
  lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, list_extract(string_split(path, '/'), -2) AS folder FROM p
""")
def path_codec(spark: SparkSession, d: str) -> DataFrame:
    e = entry_paths(spark, d)
    return e.select("entry_id", "path", paths.path_to_key(c("path")).alias("key"), paths.extension(c("path")).alias("ext"), F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("folder"))


@query(f"""
WITH {_PATHS}, f AS (SELECT entry_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
SELECT entry_id, '/' || array_to_string(parts, '/') AS path, CASE WHEN len(parts) > 1 THEN '/:' || array_to_string(parts[:-2], '/:') || '/:' ELSE '/:' END AS dir, parts[-1] AS file FROM f WHERE len(parts) > 0
""")
def path_round_trip(spark: SparkSession, d: str) -> DataFrame:
    e = entry_paths(spark, d).select("entry_id", paths.key_to_path(paths.path_to_key(c("path"))).alias("path")).where("path <> '/'")
    loc = paths.path_to_location(c("path"))
    return e.select("entry_id", "path", loc["dir"].alias("dir"), loc["file"].alias("file"))


@query(f"""
WITH t AS (SELECT entry_id, {low_sql("artist")} AS a, coalesce(title, '') AS title FROM nml_entry)
SELECT entry_id, a || chr(9) || {low_sql("title")} AS song, a || chr(9) || {low_sql("regexp_replace(title, '\\s*[\\(\\[][^)\\]]*[\\)\\]]', '', 'g')")} AS bare,
  a || chr(9) || {low_sql("regexp_replace(title, '(?s)\\s*[\\(\\[].*', '')")} AS cut, regexp_replace(a, '^(the|a|an) ', '') AS artist_bare,
  a || chr(9) || {low_sql("regexp_replace(title, '\\s*[\\(\\[][^\\n\\r]{0,40}[\\)\\]]\\s*$', '')")} AS version, a || chr(9) || {low_sql("regexp_replace(title, '\\s*\\([^)]*\\)\\s*$', '')")} AS base,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '^(the|a|an)\\s+', ''), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}\\s\\p{{Z}}]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'), ' ') AS loose FROM t
""")
def song_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry")
    a, t = c("artist"), c("title")
    return e.select("entry_id", keys.song_key(a, t).alias("song"), keys.bare_key(a, t).alias("bare"), keys.cut_key(a, t).alias("cut"), keys.without_article(a).alias("artist_bare"), keys.version_key(a, t).alias("version"), keys.base_key(a, t).alias("base"), keys.loose_name(t).alias("loose"))


# ---- keep-best deduplication


@query("SELECT sha256(text) AS sha, md5(text) AS md5, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))
    return t.groupBy("sha", "md5").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query("""
WITH d AS (SELECT *, sha256(text) AS sha FROM documents WHERE text IS NOT NULL)
SELECT sha, doc_id, source FROM d QUALIFY row_number() OVER (PARTITION BY sha ORDER BY n_chars DESC, CASE WHEN lang = 'en' THEN 1 ELSE 0 END DESC, length(coalesce(source, '')), doc_id) = 1
""")
def keep_best_hash(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").withColumn("sha", F.sha2("text", 256))
    order = [F.desc("n_chars"), F.desc(F.when(c("lang") == "en", 1).otherwise(0)), F.length(F.coalesce("source", F.lit(""))), c("doc_id")]
    return dedup.keep_best(t, ["sha"], order).select("sha", "doc_id", "source")


_BEST = "row_number() OVER (PARTITION BY k ORDER BY coalesce(try_cast(bitrate AS BIGINT), 0) DESC, fmt DESC, backup, length(path), entry_id)"
_KEYED = f"""
WITH {_PATHS}, n AS (
  SELECT p.entry_id, p.path, e.bitrate, {low_sql('e.artist')} || chr(9) || {low_sql('e.title')} AS k, CASE WHEN contains(p.path, '/Backups/') OR contains(p.path, '/backups/') THEN 1 ELSE 0 END AS backup,
    CASE lower(regexp_extract(p.path, '(\\.[^./]+)$', 1)) WHEN '.flac' THEN 6 WHEN '.wav' THEN 5 WHEN '.aiff' THEN 4 WHEN '.aif' THEN 4 WHEN '.m4a' THEN 3 WHEN '.ogg' THEN 2 WHEN '.opus' THEN 2 WHEN '.mp3' THEN 1 ELSE 0 END AS fmt
  FROM p JOIN nml_entry e USING (entry_id) WHERE trim(e.artist) <> '' AND trim(e.title) <> '')
"""


def _keyed(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    e = entry_paths(spark, d).where("trim(artist) <> '' and trim(title) <> ''").withColumn("k", keys.song_key(c("artist"), c("title")))
    order = [F.desc(F.coalesce(c("bitrate").try_cast("bigint"), F.lit(0))), F.desc(dedup.format_rank(c("path"))), F.desc(dedup.not_backup(c("path"))), F.length("path"), c("entry_id")]
    return e, order


@query(_KEYED + f"SELECT k, entry_id, path FROM n QUALIFY {_BEST} = 1")
def keep_best_key(spark: SparkSession, d: str) -> DataFrame:
    e, order = _keyed(spark, d)
    return dedup.keep_best(e, ["k"], order).select("k", "entry_id", "path")


@query(_KEYED + f"SELECT k, entry_id FROM n QUALIFY {_BEST} > 1")
def removals(spark: SparkSession, d: str) -> DataFrame:
    e, order = _keyed(spark, d)
    return dedup.losers(e.select("k", "entry_id", "path", "bitrate"), ["k"], order).select("k", "entry_id")


@query(_KEYED + f"""
, r AS (SELECT *, {_BEST} AS rn FROM n), w AS (SELECT k, entry_id AS winner FROM r WHERE rn = 1)
SELECT r.entry_id, coalesce(w.winner, r.entry_id) AS target FROM r LEFT JOIN w ON w.k = r.k AND r.rn > 1
""")
def redirect_refs(spark: SparkSession, d: str) -> DataFrame:
    e, order = _keyed(spark, d)
    won = dedup.keep_best(e, ["k"], order).select("k", c("entry_id").alias("new"))
    moved = e.select("k", c("entry_id").alias("old")).join(won, "k").where("old <> new").select("old", "new")
    return joins.redirect(e.select("entry_id"), "entry_id", moved).select("entry_id", "target")


@query("""
WITH m AS (SELECT o_custkey, o_orderpriority, o_orderkey AS k, epoch(o_orderdate) / 86400.0 AS day, o_totalprice AS price FROM orders)
SELECT a.k AS a, b.k AS b FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.k < b.k AND abs(a.day - b.day) <= 60 AND abs(a.price - b.price) <= 100000
""")
def band_self_join(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d)


def _bands(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", c("o_orderkey").alias("k"), (F.unix_micros(c("o_orderdate").cast("timestamp")) / 86400e6).alias("day"), c("o_totalprice").alias("price"))
    return dedup.band_pairs(o, ["o_custkey", "o_orderpriority"], "k", {"day": 60, "price": 100000}, hint="day")


@query("""
WITH RECURSIVE m AS (SELECT o_custkey, o_orderpriority, o_orderkey AS k, epoch(o_orderdate) / 86400.0 AS day, o_totalprice AS price FROM orders),
e AS (SELECT a.k AS a, b.k AS b FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.k <> b.k AND abs(a.day - b.day) <= 60 AND abs(a.price - b.price) <= 100000),
r(v, w) AS (SELECT a, a FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w)
SELECT v AS node, min(w) AS component FROM r GROUP BY v
""")
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dedup.clusters(_bands(spark, d))


@query("""
WITH n AS (SELECT artist AS x, count(*) AS n, split_part(lower(artist), ' ', 1) AS block FROM artist_credit WHERE artist IS NOT NULL GROUP BY 1),
p AS (SELECT a.x AS ax, b.x AS bx, a.n AS an, b.n AS bn, levenshtein(lower(a.x), lower(b.x)) AS d FROM n a JOIN n b ON a.block = b.block AND a.block <> '' AND a.x < b.x AND abs(length(a.x) - length(b.x)) <= 2)
SELECT CASE WHEN an >= bn THEN bx ELSE ax END AS rare, CASE WHEN an >= bn THEN ax ELSE bx END AS frequent, CAST(d AS INTEGER) AS distance FROM p WHERE d BETWEEN 1 AND 2
""")
def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "artist_credit").where("artist is not null").groupBy(c("artist").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return dedup.fuzzy_pairs(n, "x", "n", 2)


_LOOSE = "t0"
for _p, _by in (("^\\d{1,3}\\s*[-.]?\\s*", ""), ("[\\s\\p{Z}]+-[\\s\\p{Z}]+[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}][\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}\\s\\p{Z}]*$", ""), ("\\s+\\d+$", ""), ("[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}\\s\\p{Z}]", " "), ("[\\s\\p{Z}]+", " ")):
    _LOOSE = f"trim(regexp_replace({_LOOSE}, '{_p}', '{_by}', 'g'), ' ')"


@query("""
WITH b AS (SELECT *, round_even(l_quantity / 5, 0) * 5 AS bucket FROM lineitem)
SELECT l_partkey, bucket, l_orderkey, l_linenumber FROM b QUALIFY row_number() OVER (PARTITION BY l_partkey, bucket ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_shipdate) = 1
""")
def bucket_dedup(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), c("l_orderkey"), c("l_linenumber"), c("l_suppkey"), c("l_shipdate")]
    return dedup.bucket_dedup(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity", 5.0, order).select("l_partkey", "bucket", "l_orderkey", "l_linenumber")


@query(f"""
WITH RECURSIVE r AS (SELECT entry_id AS id, lower(regexp_replace(coalesce(title, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS t0, lower(trim(coalesce(artist, ''))) AS a, CASE WHEN regexp_full_match(trim(filesize), '[+-]?[0-9]+(\\.[0-9]*)?([eE][+-]?[0-9]+)?') THEN try_cast(trim(filesize) AS DOUBLE) END AS size, try_cast(trim(playtime_float) AS DOUBLE) AS sec FROM nml_entry),
k AS (SELECT * EXCLUDE (t0), {_LOOSE} AS t FROM r),
e AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.t = y.t AND x.id < y.id AND x.t <> '' AND x.size > 0 AND y.size > 0 AND x.sec > 0 AND y.sec > 0 AND abs(x.size - y.size) < 0.01 * greatest(x.size, y.size) AND abs(x.sec - y.sec) <= 2 AND (x.a = y.a OR x.a = '' OR y.a = '')),
n AS (SELECT row_number() OVER (ORDER BY v) AS i, v, earlier FROM (SELECT v, list(u) FILTER (WHERE u IS NOT NULL) AS earlier FROM (SELECT b AS v, a AS u FROM e UNION ALL SELECT a, NULL FROM e) GROUP BY v)),
s(i, stars) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT n.i, CASE WHEN coalesce(list_has_any(s.stars, n.earlier), false) THEN s.stars ELSE list_append(s.stars, n.v) END FROM s JOIN n ON n.i = s.i + 1),
f AS (SELECT unnest(stars) AS star FROM s QUALIFY row_number() OVER (ORDER BY i DESC) = 1)
SELECT min(e.a) AS star, e.b AS member FROM e JOIN f ON f.star = e.a WHERE e.b NOT IN (SELECT star FROM f) GROUP BY e.b
""")
def greedy_stars(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry").select("entry_id", keys.loose_title(c("title")).alias("t"), F.lower(F.trim(F.coalesce("artist", F.lit("")))).alias("a"), c("filesize").try_cast("double").alias("size"), c("playtime_float").try_cast("double").alias("sec"))
    return dedup.greedy_stars(e.where("t <> '' and size > 0 and sec > 0"), ["t"], "entry_id", "size", "sec", "a")


@query("""
WITH b AS (SELECT p_partkey, lower(p_name) AS base, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, CASE WHEN n > 1 THEN base || '_' || CAST(n AS VARCHAR) ELSE base END || '.mp3' AS name FROM b
""")
def collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    return dedup.numbered_names(table(spark, d, "part"), F.lower("p_name"), ["p_partkey"], suffix=".mp3").select("p_partkey", "name")


# ---- ratings, histograms, coverage

_STARS = "CASE WHEN {0} < 0.2 THEN 1 WHEN {0} < 0.4 THEN 2 WHEN {0} < 0.6 THEN 3 WHEN {0} < 0.8 THEN 4 ELSE 5 END"


@query(f"""
WITH r AS (SELECT c_custkey, (dense_rank() OVER (ORDER BY c_acctbal) - 1) / (SELECT count(DISTINCT c_acctbal) FROM customer)::DOUBLE AS pct FROM customer WHERE c_acctbal IS NOT NULL)
SELECT c_custkey, CAST({_STARS.format("pct")} AS INTEGER) AS stars FROM r
""")
def percentile_stars(spark: SparkSession, d: str) -> DataFrame:
    return rank.percentiles(table(spark, d, "customer"), "c_acctbal", "pct", closed=False).where("pct is not null").select("c_custkey", rank.stars(c("pct")).alias("stars"))


@query(f"""
WITH a AS (SELECT c_custkey AS k, (dense_rank() OVER (ORDER BY c_acctbal) - 1) / ((SELECT count(DISTINCT c_acctbal) FROM customer) - 1)::DOUBLE AS a FROM customer),
n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT k, (dense_rank() OVER (ORDER BY n) - 1) / ((SELECT count(DISTINCT n) FROM n) - 1)::DOUBLE AS b FROM n),
s AS (SELECT k, coalesce(0.5::DOUBLE * a + 0.5::DOUBLE * b, a, b) AS score FROM a FULL JOIN b USING (k))
SELECT k, CAST({_STARS.format("score")} AS INTEGER) AS stars, round(score, 6) AS score FROM s
""")
def composite_stars(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("value"))
    b = table(spark, d, "orders").groupBy(c("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("value"))
    return rank.blend(a, b, "k").select("k", "stars", F.round("score", 6).alias("score"))


@query("WITH s AS (SELECT list_sort(list(c_acctbal)) AS v FROM customer) SELECT step, v[CAST(floor(step * len(v)) AS BIGINT) + 1] AS value FROM s, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) t(step)")
def star_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rank.thresholds(table(spark, d, "customer"), "c_acctbal")


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY event_type")
def histogram_pct(spark: SparkSession, d: str) -> DataFrame:
    return rank.shares(table(spark, d, "events"), "event_type")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, max(l_extendedprice) AS top_price FROM lineitem GROUP BY ALL")
def group_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.max("l_extendedprice").alias("top_price"))


@query(f"WITH e AS (SELECT n.entry_id, l.lyrics_key IS NOT NULL AS tried, l.t FROM nml_entry n LEFT JOIN (SELECT lyrics_key, min(lyrics_text) AS t FROM lyrics_raw WHERE lyrics_key IS NOT NULL GROUP BY 1) l ON l.lyrics_key = {low_sql('n.artist')} || chr(9) || {low_sql('n.title')}) SELECT count(*) AS n, count_if(tried AND t IS NOT NULL) AS found, count_if(tried AND t IS NULL) AS empty, count_if(NOT tried) AS untried FROM e")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    lyrics = table(spark, d, "lyrics_raw").where("lyrics_key is not null").groupBy(c("lyrics_key").alias("k")).agg(F.min("lyrics_text").alias("t")).withColumn("tried", F.lit(True))
    e = table(spark, d, "nml_entry").withColumn("k", keys.song_key(c("artist"), c("title"))).join(lyrics, "k", "left")
    return rank.coverage(e, c("tried"), c("t"))


@query("""
WITH k AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, n FROM k QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) = 1
""")
def mode_inference(spark: SparkSession, d: str) -> DataFrame:
    return rank.most_common(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT CASE WHEN b <= 50 THEN '0-50' WHEN b <= 100 THEN '50-100' WHEN b <= 200 THEN '100-200' WHEN b <= 500 THEN '200-500' ELSE '500+' END AS bucket, count(*) AS n FROM (SELECT l_extendedprice * 5000 / 1048576.0 AS b FROM lineitem) GROUP BY 1")
def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(size_class(c("l_extendedprice") * 5000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS batch FROM customer")
def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    return rank.batches(table(spark, d, "customer"), "c_custkey", 50).select("c_custkey", "batch")


# ---- names and categories


@query("""
WITH n AS (SELECT artist AS name, count(*) AS n FROM nml_entry WHERE trim(artist) <> '' GROUP BY 1),
v AS (SELECT lower(trim(artist)) AS k, arg_min(artist, {'n': -c, 'x': artist}) AS vote FROM (SELECT artist, count(*) AS c FROM artist_credit WHERE artist IS NOT NULL GROUP BY 1) GROUP BY 1),
b0 AS (SELECT lower(trim(name)) AS k, arg_min(name, {'u': CASE WHEN regexp_matches(name, '^\\p{Lu}') THEN 0 ELSE 1 END, 'n': -n, 'x': name}) AS best, count(*) AS c FROM n GROUP BY 1),
b AS (SELECT b0.k, coalesce(v.vote, b0.best) AS best, c FROM b0 LEFT JOIN v USING (k))
SELECT n.name, b.best AS canonical FROM n JOIN b ON b.k = lower(trim(n.name)) WHERE c > 1 AND n.name <> b.best
""")
def canonical_vote(spark: SparkSession, d: str) -> DataFrame:
    votes = table(spark, d, "artist_credit").where("artist is not null").groupBy(c("artist").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return normalize.canonical_names(_artist_counts(spark, d), votes)


def _artist_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nml_entry").where("trim(artist) <> ''").groupBy(c("artist").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH n AS (SELECT artist AS name, count(*) AS n FROM nml_entry WHERE trim(artist) <> '' GROUP BY 1)
SELECT CASE WHEN a.n >= b.n THEN b.name ELSE a.name END AS name, CASE WHEN a.n >= b.n THEN a.name ELSE b.name END AS canonical FROM n a JOIN n b ON a.name = 'The ' || b.name
""")
def article_merge(spark: SparkSession, d: str) -> DataFrame:
    return normalize.article_merge(_artist_counts(spark, d))


@query("""
WITH n AS (SELECT trim(artist) AS name, count(*) AS n FROM nml_entry WHERE trim(artist) <> '' GROUP BY 1),
a AS (SELECT name, n, CASE WHEN name = 'V/A' THEN 'Various Artists' END AS typo,
  array_to_string(list_transform(string_split(name, ' '), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') AS cased, regexp_matches(name, '^\\p{Ll}') AS low FROM n),
b AS (SELECT *, CASE WHEN typo IS NULL AND low AND cased <> name THEN cased END AS fix FROM a),
k AS (SELECT coalesce(typo, fix, name) AS x, sum(n) AS nx FROM b GROUP BY 1),
e AS (SELECT *, typo IS NULL AND fix IS NULL AS open_, trim(regexp_extract(name, '(?i)^(\\d{2}''?s)[-]\\s*(.+)$', 2)) AS dec FROM b),
f AS (SELECT *, CASE WHEN open_ AND dec <> '' AND dec <> name THEN dec END AS decade,
  CASE WHEN regexp_matches(name, '(?i)^(.+?)\\s+(?:feat\\.?|ft\\.?|featuring|with|w/)\\s+.+$') THEN trim(regexp_extract(name, '(?i)^(.+?)\\s+(?:feat\\.?|ft\\.?|featuring|with|w/)\\s+.+$', 1))
       WHEN regexp_matches(name, '(?i)^(.+?)\\s+(?:&|and)\\s+.+$') THEN trim(regexp_extract(name, '(?i)^(.+?)\\s+(?:&|and)\\s+.+$', 1)) END AS prim FROM e),
g AS (SELECT f.*, coalesce(k1.nx, 0) AS n_name, coalesce(k2.nx, 0) AS n_prim, coalesce(k3.nx, 0) AS n_dec FROM f LEFT JOIN k k1 ON k1.x = f.name LEFT JOIN k k2 ON k2.x = f.prim LEFT JOIN k k3 ON k3.x = f.decade),
h AS (SELECT *, CASE WHEN open_ AND decade IS NULL AND n_prim > greatest(n_name, n) THEN prim END AS first_, CASE WHEN starts_with(name, 'The ') AND length(name) > 4 THEN substring(name, 5) ELSE 'The ' || name END AS oth FROM g),
i AS (SELECT h.*, coalesce(k.nx, 0) AS n_oth FROM h LEFT JOIN k ON k.x = h.oth),
j AS (SELECT *, CASE WHEN open_ AND decade IS NULL AND first_ IS NULL AND n_oth > 0 AND n_name > 0 AND (n_oth > n_name OR (n_oth = n_name AND starts_with(oth, 'The '))) THEN oth END AS other_ FROM i)
SELECT j.name, coalesce(typo, fix, decade, first_, other_) AS new_name,
  CASE WHEN typo IS NOT NULL THEN 'typo' WHEN fix IS NOT NULL THEN 'case_fix' WHEN decade IS NOT NULL THEN 'decade_prefix' WHEN first_ IS NOT NULL THEN 'collab_strip' ELSE 'article_norm' END AS rule,
  j.n AS old_count, CAST(CASE WHEN typo IS NOT NULL OR fix IS NOT NULL THEN coalesce(r.n, 0) WHEN decade IS NOT NULL THEN n_dec WHEN first_ IS NOT NULL THEN n_prim ELSE n_oth END AS BIGINT) AS new_count
FROM j LEFT JOIN n r ON r.name = coalesce(typo, fix, decade, first_, other_) WHERE coalesce(typo, fix, decade, first_, other_) IS NOT NULL
""")
def rename_cascade(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nml_entry").where("trim(artist) <> ''").groupBy(F.trim("artist").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    typos = spark.createDataFrame([("V/A", "Various Artists")], "old string, new string")
    return normalize.rename_cascade(n, typos)


_MAP = (("economy", "Darkwave"), ("small", "Gothic Rock"), ("medium", "EBM"), ("promo", "Metal"), ("building", "Industrial"), ("machinery", "Ambient"), ("household", "Pop"))


@query(
    "WITH m(raw, canonical) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MAP) + "), o(canonical, idx) AS (VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(normalize.TAXONOMY)) + """),
v AS (SELECT c_custkey, p_type || ' / ' || c_mktsegment AS raw FROM customer JOIN part ON p_partkey = c_custkey),
h AS (SELECT v.c_custkey, v.raw, m.canonical, o.idx, t.i FROM v, LATERAL (SELECT unnest([1, 2]) AS i) t JOIN m ON m.raw = lower(trim(split_part(v.raw, '/', t.i))) LEFT JOIN o ON o.canonical = m.canonical)
SELECT v.c_custkey, v.raw, b.canonical FROM v LEFT JOIN (SELECT c_custkey, arg_min(canonical, idx * 10 + i) AS canonical FROM h GROUP BY 1) b USING (c_custkey)
""")
def taxonomy_resolve(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "customer").join(table(spark, d, "part").select(c("p_partkey").alias("c_custkey"), "p_type"), "c_custkey")
    v = v.select("c_custkey", F.concat_ws(" / ", "p_type", "c_mktsegment").alias("raw"))
    return normalize.resolve_category(v, "raw", spark.createDataFrame(_MAP, "raw string, canonical string"), normalize.taxonomy(spark))


@query(
    "WITH m(raw, canonical) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MAP) + """),
t AS (SELECT c_custkey, unnest([c_mktsegment, p_type]) AS tag, generate_subscripts([c_mktsegment, p_type], 1) AS pos FROM customer JOIN part ON p_partkey = c_custkey)
SELECT c_custkey, arg_min(canonical, pos) AS canonical FROM t JOIN m ON m.raw = lower(t.tag) GROUP BY c_custkey
""")
def first_match_tag(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "customer").join(table(spark, d, "part").select(c("p_partkey").alias("c_custkey"), "p_type"), "c_custkey")
    return normalize.first_mapped_tag(v, "c_custkey", F.array("c_mktsegment", "p_type"), spark.createDataFrame(_MAP, "raw string, canonical string"))


# ---- enrichment and references

_BASE = "regexp_replace(coalesce(title, ''), '\\s*\\([^)]*\\)\\s*$', '')"


@query(f"""
WITH l AS (SELECT lyrics_key AS k, min(lyrics_id) AS v FROM lyrics_raw WHERE lyrics_key IS NOT NULL GROUP BY 1),
e AS (SELECT entry_id, {low_sql('artist')} || chr(9) || {low_sql('title')} AS k1, {low_sql('artist')} || chr(9) || {low_sql(_BASE)} AS k2 FROM nml_entry)
SELECT e.entry_id, coalesce(a.v, b.v) AS lyrics_id FROM e LEFT JOIN l a ON a.k = e.k1 LEFT JOIN l b ON b.k = e.k2
""")
def left_join_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry").select("entry_id", keys.song_key(c("artist"), c("title")).alias("k1"), keys.base_key(c("artist"), c("title")).alias("k2"))
    return joins.join_with_fallback(e, table(spark, d, "lyrics_raw"), ["k1", "k2"], "lyrics_key", "lyrics_id", "lyrics_id").select("entry_id", "lyrics_id")


@query("""
WITH g AS (SELECT lower(trim(artist)) AS a, arg_min(nullif(trim(genre), ''), entry_id) FILTER (WHERE nullif(trim(genre), '') IS NOT NULL) AS v FROM nml_entry GROUP BY 1)
SELECT n.entry_id, coalesce(nullif(trim(n.genre), ''), g.v) AS genre FROM nml_entry n LEFT JOIN g ON g.a = lower(trim(n.artist))
""")
def sibling_fill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry").select("entry_id", F.lower(F.trim("artist")).alias("a"), F.nullif(F.trim("genre"), F.lit("")).alias("genre"))
    return joins.fill_from_siblings(e, ["a"], "genre", [c("entry_id")]).select("entry_id", "genre")


_MOVED = f"WITH {_PATHS}, m AS (SELECT path AS old_path, '/moved' || min(path) AS new_path FROM p WHERE path LIKE '/crates/main/%' GROUP BY path)"


@query(_MOVED + " SELECT p.entry_id, CASE WHEN m.new_path IS NOT NULL THEN 'remap' WHEN starts_with(p.path, '/crates/inbox/') THEN 'keep' ELSE 'drop' END AS outcome, CASE WHEN m.new_path IS NOT NULL THEN m.new_path WHEN starts_with(p.path, '/crates/inbox/') THEN p.path END AS new_path FROM p LEFT JOIN m ON m.old_path = p.path")
def three_way_classify(spark: SparkSession, d: str) -> DataFrame:
    e = entry_paths(spark, d).select("entry_id", "path")
    m = e.where("path like '/crates/main/%'").select(c("path").alias("old_path")).distinct().withColumn("new_path", F.concat(F.lit("/moved"), c("old_path")))
    return joins.classify_paths(e, "path", m, ["/crates/inbox"]).select("entry_id", "outcome", "new_path")


@query(_MOVED + ", o AS (SELECT CASE WHEN m.new_path IS NOT NULL THEN 'remap' WHEN starts_with(p.path, '/crates/inbox/') THEN 'keep' ELSE 'drop' END AS outcome FROM p LEFT JOIN m ON m.old_path = p.path) SELECT outcome, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM nml_entry")
def outcome_balance(spark: SparkSession, d: str) -> DataFrame:
    return changes.balance(three_way_classify(spark, d), "outcome")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.without(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 400000").select(c("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


@query("SELECT entry_id FROM nml_entry WHERE entry_id NOT IN (SELECT entry_id FROM history_row WHERE entry_id IS NOT NULL)")
def never_played(spark: SparkSession, d: str) -> DataFrame:
    return joins.todo(table(spark, d, "nml_entry"), table(spark, d, "history_row"), "entry_id").select("entry_id")


@query(f"""
SELECT n.entry_id FROM nml_entry n LEFT JOIN (SELECT lyrics_key AS k, max(lyrics_text) AS t FROM lyrics_raw WHERE lyrics_key IS NOT NULL GROUP BY 1) l ON l.k = {low_sql('n.artist')} || chr(9) || {low_sql('n.title')}
WHERE l.t IS NULL AND NOT contains(lower(coalesce(n.title, '')), 'instrumental')
""")
def lyrics_gaps(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "lyrics_raw").where("lyrics_key is not null").groupBy(c("lyrics_key").alias("k")).agg(F.max("lyrics_text").alias("t"))
    e = table(spark, d, "nml_entry").withColumn("k", keys.song_key(c("artist"), c("title")))
    return joins.gaps(e, cache, "k", "t", F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("instrumental"))).select("entry_id")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN c_name WHEN trim(n_name) <> '' AND c_acctbal >= 0 THEN n_name ELSE c_mktsegment END AS label, CASE WHEN c_acctbal >= 5000 THEN 'match' WHEN trim(n_name) <> '' AND c_acctbal >= 0 THEN 'tags' ELSE 'name' END AS source
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def source_precedence(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").join(table(spark, d, "nation"), c("n_nationkey") == c("c_nationkey"), "left")
    return joins.first_of_sources(x, [("match", c("c_acctbal") >= 5000, c("c_name")), ("tags", c("c_acctbal") >= 0, c("n_name")), ("name", F.lit(True), c("c_mktsegment"))], "label").select("c_custkey", "label", "source")


@query("""
WITH l AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), m AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O')
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM l UNION SELECT k FROM m) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM l INTERSECT SELECT k FROM m) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM l EXCEPT SELECT k FROM m)
""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a, b = li.where("l_returnflag = 'R'").select(c("l_partkey").alias("k")), li.where("l_linestatus = 'O'").select(c("l_partkey").alias("k"))
    n = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return joins.union_all([n(a.union(b).distinct(), "union"), n(a.intersect(b), "intersect"), n(a.subtract(b), "except")])


@query("""
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'came' ELSE 'went' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
""")
def set_change(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity > 45").withColumnRenamed("l_partkey", "k")
    return joins.set_change(li.where("l_returnflag = 'R'").select("k"), li.where("l_linestatus = 'O'").select("k"), "k")


_RENAMES = ((1, "/crates/main/The Purnvilbrik Mosaic", "/crates/main/Mosaic"), (2, "/crates/main", "/music"), (3, "/crates", "/attic"))


@query(f"WITH {_PATHS} SELECT entry_id, CASE " + " ".join(f"WHEN path = '{a}' OR starts_with(path, '{a}/') THEN '{b}' || substring(path, {len(a) + 1})" for _, a, b in _RENAMES) + " ELSE path END AS new_path FROM p")
def prefix_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return joins.first_prefix(entry_paths(spark, d).select("entry_id", "path"), "path", spark.createDataFrame(_RENAMES, "pos int, old string, new string")).select("entry_id", "new_path")


@query(f"""
WITH {_PATHS}, ask AS (SELECT entry_id AS q, CASE WHEN entry_id % 2 = 0 THEN path ELSE '/elsewhere/' || list_extract(string_split(path, '/'), -1) END AS path FROM p),
e AS (SELECT path, min(entry_id) AS a FROM p GROUP BY 1), f AS (SELECT list_extract(string_split(path, '/'), -1) AS name, min(a) AS b FROM e GROUP BY 1)
SELECT q, coalesce(e.a, f.b) AS entry_id FROM ask LEFT JOIN e ON e.path = ask.path LEFT JOIN f ON f.name = list_extract(string_split(ask.path, '/'), -1)
""")
def basename_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = entry_paths(spark, d)
    tracks = e.groupBy("path").agg(F.min("entry_id").alias("entry_id"))
    ask = e.select(c("entry_id").alias("q"), F.when(c("entry_id") % 2 == 0, c("path")).otherwise(F.concat(F.lit("/elsewhere/"), paths.base_name(c("path")))).alias("path"))
    return joins.by_path_or_name(ask, "path", tracks, "entry_id", "entry_id").select("q", "entry_id")


@query("""
WITH s AS (SELECT o_custkey AS k, CAST(min(o_totalprice) AS DOUBLE) AS v FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN s.v IS NOT NULL AND c_acctbal < 0 THEN s.v ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN s ON s.k = c_custkey
""")
def rating_update(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.min("o_totalprice").alias("c_acctbal"))
    return joins.replace_where(table(spark, d, "customer"), new, "c_custkey", "c_acctbal", c("c_acctbal") < 0).select("c_custkey", "c_acctbal")


@query("""
WITH o AS (SELECT c_custkey, c_mktsegment AS old, upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) AS new FROM customer)
SELECT c_custkey, 'c_mktsegment' AS field, old, new FROM o WHERE old <> new
""")
def field_changes(spark: SparkSession, d: str) -> DataFrame:
    before = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    after = before.withColumn("c_mktsegment", F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.substring("c_mktsegment", 2, 100))))
    return changes.change_set(before, after, "c_custkey", ["c_mktsegment", "c_name"])


# ---- stages


@query(f"""
WITH {_PATHS}, r AS (SELECT p.entry_id, p.path, n.title, CASE WHEN regexp_full_match(n.playtime, '\\d+') THEN try_cast(n.playtime AS INTEGER) END AS s FROM p JOIN nml_entry n USING (entry_id))
SELECT entry_id, CASE WHEN coalesce(trim(path), '') IN ('', '/') THEN 'no place' WHEN s < 30 THEN 'short' WHEN s > 450 THEN 'long' WHEN regexp_matches(title, '{LIVE_SQL}') THEN 'live' END AS reason FROM r
""")
def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    e = entry_paths(spark, d).withColumn("seconds", F.when(c("playtime").rlike(r"^\d+$"), c("playtime").try_cast("int")))
    return stages.drop_reasons(e, 30, 450).select("entry_id", "reason")


@query("""
WITH n AS (SELECT 'entries' AS name, count(*) AS n FROM nml_entry UNION ALL SELECT 'credits', count(*) FROM artist_credit UNION ALL SELECT 'lyrics', count(*) FROM lyrics_raw)
SELECT * FROM n UNION ALL SELECT 'without_lyrics', greatest(0, (SELECT n FROM n WHERE name = 'entries') - (SELECT n FROM n WHERE name = 'lyrics')) UNION ALL SELECT 'credits_over', greatest(0, (SELECT n FROM n WHERE name = 'credits') - (SELECT n FROM n WHERE name = 'entries'))
""")
def baseline_snapshot(spark: SparkSession, d: str) -> DataFrame:
    t = {k: table(spark, d, v) for k, v in (("entries", "nml_entry"), ("credits", "artist_credit"), ("lyrics", "lyrics_raw"))}
    return stages.snapshot(t, {"without_lyrics": ("entries", "lyrics"), "credits_over": ("credits", "entries")})


def _rebuilt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stage with all its results; the plays of a session are its references."""
    sha = table(spark, d, "dedup_member").where("group_id is not null").groupBy("group_id", "entry_id").agg(F.min("sha").alias("sha")).select("entry_id", "sha")
    at = entry_paths(spark, d)
    e = at.join(sha, "entry_id", "left").select(c("entry_id").alias("entry_idx"), "path", "sha", F.size("cues").alias("richness"))
    m = e.where("path like '/crates/main/%'").select(c("path").alias("old_path")).distinct().withColumn("new_path", F.concat(F.lit("/music"), F.substring("old_path", 13, 1 << 30)))
    refs = table(spark, d, "history_row").join(at.select("entry_id", "path"), "entry_id").select(c("session_id").cast("string").alias("playlist"), c("row_id").alias("pos"), "path")
    return stages.rebuild(e, m, ["/crates/inbox"], refs)


@query(f"""
WITH {_PATHS}, s AS (SELECT group_id, entry_id, min(sha) AS sha FROM dedup_member WHERE group_id IS NOT NULL GROUP BY 1, 2),
x AS (SELECT p.entry_id AS entry_idx, p.path, s.sha, CAST(len(n.cues) AS INTEGER) AS richness, CASE WHEN starts_with(p.path, '/crates/main/') THEN '/music' || substring(p.path, 13) END AS mapped FROM p JOIN nml_entry n USING (entry_id) LEFT JOIN s USING (entry_id)),
y AS (SELECT *, CASE WHEN mapped IS NOT NULL THEN 'remap' WHEN starts_with(path, '/crates/inbox/') THEN 'keep' ELSE 'drop' END AS outcome FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY coalesce(sha, 'entry ' || CAST(entry_idx AS VARCHAR)) ORDER BY richness DESC, entry_idx) AS rn FROM y WHERE outcome <> 'drop')
SELECT entry_idx, CASE WHEN rn = 1 THEN outcome ELSE 'merged' END AS outcome FROM z UNION ALL SELECT entry_idx, outcome FROM y WHERE outcome = 'drop'
""")
def rebuild_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _rebuilt(spark, d)[2]


_REBUILT = f"""
WITH {_PATHS}, s AS (SELECT group_id, entry_id, min(sha) AS sha FROM dedup_member WHERE group_id IS NOT NULL GROUP BY 1, 2),
x AS (SELECT p.entry_id AS entry_idx, p.path, s.sha, CAST(len(n.cues) AS INTEGER) AS richness, CASE WHEN starts_with(p.path, '/crates/main/') THEN '/music' || substring(p.path, 13) END AS mapped FROM p JOIN nml_entry n USING (entry_id) LEFT JOIN s USING (entry_id)),
y AS (SELECT *, CASE WHEN mapped IS NOT NULL THEN 'remap' WHEN starts_with(path, '/crates/inbox/') THEN 'keep' END AS outcome, coalesce(sha, 'entry ' || CAST(entry_idx AS VARCHAR)) AS content, coalesce(mapped, path) AS new_path FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY richness DESC, entry_idx) AS rn, first_value(new_path) OVER (PARTITION BY content ORDER BY CASE WHEN outcome = 'remap' THEN 0 ELSE 1 END, entry_idx) AS target FROM y WHERE outcome IS NOT NULL)
"""


@query(_REBUILT + "SELECT entry_idx, sha, outcome, target AS path FROM z WHERE rn = 1")
def rebuild_kept(spark: SparkSession, d: str) -> DataFrame:
    return _rebuilt(spark, d)[0]


@query(_REBUILT + ", moved AS (SELECT path, min(target) AS target FROM z GROUP BY 1) SELECT CAST(h.session_id AS VARCHAR) AS playlist, h.row_id AS pos, m.target AS path FROM history_row h JOIN p ON p.entry_id = h.entry_id JOIN moved m ON m.path = p.path")
def rebuild_refs(spark: SparkSession, d: str) -> DataFrame:
    return _rebuilt(spark, d)[1]


@query("""
WITH o AS (SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS target FROM orders)
SELECT l.l_orderkey, l.l_linenumber, coalesce(o.target, l.l_orderkey) AS target FROM lineitem l LEFT JOIN o ON o.o_orderkey = l.l_orderkey
""")
def redirect_lines(spark: SparkSession, d: str) -> DataFrame:
    # Keep-best, remap and redirect, end to end: orders alike in customer, priority and status become the dearest one, and lines follow.
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.concat_ws("|", "o_custkey", "o_orderpriority", "o_orderstatus").alias("k"))
    moved = dedup.winners_of_losers(o, ["k"], [F.desc("o_totalprice"), c("o_orderkey")], "o_orderkey").select(c("loser").alias("old"), c("winner").alias("new"))
    return joins.redirect(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", moved).select("l_orderkey", "l_linenumber", "target")
