"""The registered queries of this package: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysieve.llm import decontam, licenses, lmscore, media, neardup, packing, periodic, quality, repeats, secrets, toxicity, urlrules, whitening
from tallysieve.llm.textkit import id_crc, read_table


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_links")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
        F.array_join("near_items", ",").alias("near_items"),
    )


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        *(of_kind(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex", "novel")),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels"), quality.graded()))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(read_table(spark, sf_dir, "documents"), F.pmod(id_crc(), F.lit(7)) == 2)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text by its id's crc32 repeats a stretch of its words from some word on."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), id_crc().alias("h"))
    planted = F.col("h") % 10 == 0
    rows = rows.select("doc_id", "text", F.expr("h div 10").alias("g"), F.when(planted, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), 0)).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    rewritten = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, rewritten).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(with_planted_runs(read_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS LONG)"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def payload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can express."""
    return op1_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that follow from the list rules."""
    return op2_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("listed"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that the base patterns give."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that don't depend on the buckets."""
    return op6_packing(spark, sf_dir).select("doc_id", "n_tokens", "piece", "start", "length")


def count_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that the corpus counts give; the score is rounded."""
    return op8_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that the base phrases give."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def exact_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op13 that integers give."""
    return op13_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_url_filter": op2_url_filter,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_lm_score": op8_lm_score,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_whitening": op13_whitening,
    "payload_columns": payload_columns,
    "listed_urls": listed_urls,
    "base_secrets": base_secrets,
    "packed_pieces": packed_pieces,
    "count_scores": count_scores,
    "base_licenses": base_licenses,
    "exact_deviations": exact_deviations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_TEXT = "coalesce(text, '')"


def _either_case(word: str) -> str:
    """The letters of a word in either case; a fold of all of Unicode would let other letters in."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _little_endian(n: str) -> str:
    return "unhex(printf('" + "%02x" * 4 + "', " + ", ".join(f"CAST({n} >> {k} AS BIGINT) & 255" for k in (0, 8, 16, 24)) + "))"


def _crc32(codes: str) -> str:
    """The CRC-32 of a list of byte values: each byte goes in, then eight shifts."""
    steps = f"flatten(list_transform({codes}, lambda b: [1000 + b, 0, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 1000 THEN xor(c, x - 1000) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)"
    return f"xor({crc}, 4294967295::BIGINT)"


def _found(kind: str, pattern: str, least: int, group: int = 0) -> str:
    """Spans of one kind: the text between the matches gives their places."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, start, start + length(m) AS stop FROM (
      SELECT doc_id, m, g, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m) AS start FROM (
        SELECT doc_id, unnest(m) AS m, unnest(g) AS g, unnest(p[:len(m)]) AS p, generate_subscripts(m, 1) AS k FROM (
          SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS p FROM d))) WHERE length(g) >= {least}"""


_ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

#: What the other queries' methods add (a fit, spans, labels, sketches, features) SQL can't express; tests hold those to brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_neardup": f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_TEXT} AS t, {_WORDS} AS w FROM documents),
    t AS (SELECT t, any_value(w) AS w, row_number() OVER (ORDER BY t) AS n FROM d GROUP BY t),
    s AS (SELECT DISTINCT n, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT n, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM t WHERE len(w) > 0)),
    sizes AS (SELECT n, count(*) AS c FROM s GROUP BY n),
    shared AS (SELECT x.n AS a, y.n AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.n < y.n GROUP BY ALL),
    links AS (SELECT a, b FROM shared z JOIN sizes x ON x.n = a JOIN sizes y ON y.n = b WHERE z.c / (x.c + y.c - z.c) >= {neardup.SIMILARITY}::DOUBLE),
    ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT n AS a, n AS b FROM t UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
    ids AS (SELECT t.n, min(doc_id) AS first_id, count(*) AS copies FROM d JOIN t USING (t) GROUP BY t.n),
    classes AS (SELECT a AS n, min(first_id) AS class_id, CAST(sum(copies) AS BIGINT) AS class_size FROM reach JOIN ids ON ids.n = b GROUP BY a),
    degree AS (SELECT a AS n, count(*) AS n_links FROM ends GROUP BY a)
    SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links FROM d JOIN t USING (t) JOIN classes USING (n) LEFT JOIN degree USING (n)
    """,
    "payload_columns": f"""
    WITH d AS (SELECT doc_id, encode({_TEXT}) AS raw FROM documents),
    p AS (SELECT doc_id, octet_length(raw) AS n, raw || repeat('\\xFF'::BLOB, greatest(1, CAST(ceil(octet_length(raw) / 576) AS BIGINT)) * 576 - octet_length(raw)) AS payload FROM d),
    s AS (SELECT *, octet_length(payload) AS size, right(hex(payload), 64) AS tail FROM p),
    m AS (SELECT *, 'RIFF'::BLOB || {_little_endian("36 + size")} || 'WAVEfmt '::BLOB || unhex('1000000001000100401f0000401f000001000800') || 'data'::BLOB || {_little_endian("size")} || payload AS media FROM s)
    SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(payload) AS payload_sha256, {_crc32("list_transform(range(0, 32), lambda i: CAST('0x' || tail[2 * i + 1:2 * i + 2] AS BIGINT))")} AS tail_crc32,
    octet_length(media) AS media_bytes, sha256(media) AS media_sha256 FROM m
    """,
    "listed_urls": """
    WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS listed FROM r
    """,
    "base_secrets": f"""
    WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents),
    found AS ({_found("assign", _ASSIGN, 8, 2)} UNION ALL {_found("access", "AKIA[A-Z0-9]+", 16)} UNION ALL {_found("hex", "[0-9a-f]+", 32)}),
    listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END) AS spans FROM found GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN listed USING (doc_id)
    """,
    "packed_pieces": f"""
    WITH d AS (SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens FROM documents),
    p AS (SELECT doc_id, n_tokens, unnest(range(0, (n_tokens + {packing.CONTEXT - 1}) // {packing.CONTEXT})) AS piece FROM d)
    SELECT doc_id, n_tokens, piece, piece * {packing.CONTEXT} AS start, least({packing.CONTEXT}, n_tokens - piece * {packing.CONTEXT}) AS length FROM p
    UNION ALL SELECT doc_id, n_tokens, NULL, NULL, NULL FROM d WHERE n_tokens = 0
    """,
    "count_scores": f"""
    WITH d AS (SELECT doc_id, {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))")} % 7 = 2 AS held_out, list_append({_TOKENS}, '') AS w FROM documents),
    each AS (SELECT doc_id, held_out, unnest(w) AS word FROM d),
    counts AS (SELECT word, count(*) AS c FROM each WHERE NOT held_out GROUP BY word),
    whole AS (SELECT coalesce(CAST(sum(c) AS BIGINT), 0) AS n, count(*) AS v FROM counts)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
    FROM each LEFT JOIN counts USING (word), whole GROUP BY doc_id, held_out, n
    """,
    "base_licenses": f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    spots AS (SELECT doc_id, w, list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit, list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS apache,
      list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl FROM d),
    every AS (SELECT *, list_concat(mit, apache, gpl) AS s FROM spots)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(s) AS BIGINT) AS n_base, list_min(s) - 1 AS first_word, list_max(s) - 1 AS last_word,
    concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM every
    """,
    "exact_deviations": """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS c FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    x AS (SELECT vec_id, i, CAST(floor(64 * c[i]) AS HUGEINT) + 1000000 AS x FROM (SELECT vec_id, c, unnest(range(1, len(c) + 1)) AS i FROM v)),
    s AS (SELECT i, sum(x) AS s, count(*) AS n FROM x GROUP BY i)
    SELECT vec_id, any_value(n) AS n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM x JOIN s USING (i) GROUP BY vec_id
    """,
    "op4_decontamination": f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
    grams AS (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS t FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM windows))),
    found AS (SELECT g.doc_id, g.k, g.size, x.item FROM grams g JOIN windows x ON g.size = x.size AND g.t = x.t),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id),
    terms AS (SELECT DISTINCT item, unnest(w) AS word FROM b),
    chosen AS (SELECT item, word, row_number() OVER (PARTITION BY item ORDER BY df, word) AS k FROM terms JOIN (SELECT word, count(*) AS df FROM terms GROUP BY word) USING (word) WHERE item IS NOT NULL QUALIFY k <= {decontam.NEAR_TERMS}),
    spots AS (SELECT doc_id, item, k, pos FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d) JOIN chosen USING (word)),
    close AS (SELECT r.doc_id, r.item FROM spots r JOIN spots o USING (doc_id, item) WHERE r.k = 1 AND abs(o.pos - r.pos) <= {decontam.NEAR_SPAN // 2} GROUP BY r.doc_id, r.item, r.pos HAVING count(DISTINCT o.k) = (SELECT count(*) FROM chosen c WHERE c.item = r.item)),
    near AS (SELECT doc_id, string_agg(DISTINCT item, ',' ORDER BY item) AS near_items FROM close GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(near_items, '') AS near_items
    FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
}
