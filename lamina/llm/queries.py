"""The registered queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import balltree, compression_bands, ftrl, infill, line_chunks, minhash, piece_scan, signature_tree, source_mix, subword_softmax, token_bits, url_temporal
from .common import WORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compression_bands.compression_bands(table(spark, sf_dir, "documents"))
    failed = compression_bands.base_failed()
    return rows.withColumns({"base_failed": failed, "kept": ~failed & F.col("in_band")}).drop("in_band")


def op2_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op3_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bits.id_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op4_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(table(spark, sf_dir, "documents")).drop("source")


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_removed")


def dated_list(pages: DataFrame) -> DataFrame:
    """(entry, action, effective_at): events in 2024 for hosts and parent domains of the pages, by a hash of the name."""
    hosts = pages.select(url_temporal.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    names = hosts.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]+\.", ""))).alias("entry")).distinct()
    n = F.conv(F.substring(F.md5("entry"), 1, 6), 16, 10).cast("int")
    day = lambda k: F.expr("timestamp_ntz '2024-01-01 00:00:00'") + F.make_dt_interval(days=k)
    added = names.where(n % 3 == 0).select("entry", F.lit("add").alias("action"), day(n % 180).alias("effective_at"))
    removed = names.where(n % 3 == 0).select("entry", F.lit("remove").alias("action"), day(n % 180 + 20 + n % 90).alias("effective_at"))
    again = names.where(n % 6 == 0).select("entry", F.lit("add").alias("action"), day(n % 180 + 150).alias("effective_at"))
    return added.unionByName(removed).unionByName(again)


def op7_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.conv(F.substring(F.md5("url"), 1, 6), 16, 10).cast("int")
    fetched = F.expr("timestamp_ntz '2024-01-01 00:00:00'") + F.make_dt_interval(days=n % 366, hours=n % 24)
    return url_temporal.temporal_filter(pages.withColumn("fetched_at", fetched), dated_list(pages))


def _crc(by: int):
    return F.crc32(F.col("doc_id").cast("string")) % by


def op8_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = ftrl.fit(docs, table(spark, sf_dir, "labels"), "quality", _crc(5) != 0)
    held = F.coalesce(_crc(5) == 0, F.lit(False)).alias("held_out")
    return ftrl.score(docs, weights).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = subword_softmax.fit(docs, table(spark, sf_dir, "labels"), "toxic", _crc(4) != 2)
    held = F.coalesce(_crc(4) == 2, F.lit(False)).alias("held_out")
    return subword_softmax.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    return piece_scan.encode(table(spark, sf_dir, "documents"), path).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


def op11_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.edited_pairs(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_compression_bands, op2_ball_tree_topk, op3_token_bits, op4_signature_tree_join, op5_source_mix, op6_line_chunks, op7_temporal_url_filter, op8_ftrl_quality, op9_subword_toxicity, op10_piece_scan, op11_permutation_minhash, op12_infill, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_ball_tree_topk": OP2, "op4_signature_tree_join": OP4, "op5_source_mix": OP5, "op6_line_chunks": OP6, "op7_temporal_url_filter": OP7, "op11_permutation_minhash": OP11, "op12_infill": OP12}


OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [list_aggregate(ws, 'string_agg', ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh
    FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM d GROUP BY source
), cap AS (SELECT *, source_no % 3 + 1 AS weight, 3 * source_size AS cap FROM per
), lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM cap WINDOW o AS (ORDER BY cap::DOUBLE / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_no, source_size, CASE WHEN cap <= level * weight THEN cap::DOUBLE
    ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target FROM lev
), k AS (SELECT sum(source_size)::BIGINT AS words, greatest(16, least(1024, (sum(source_size) // 100000)::BIGINT)) AS block FROM t
), ends AS (
  SELECT source_no, source_size, round(sum(target) OVER (ORDER BY source_no) / sum(target) OVER () * 2147483648)::BIGINT AS high FROM t WHERE target > 0
), share AS (
  SELECT source_no, (source_size + block - 1) // block AS blocks, coalesce(lag(high) OVER (ORDER BY source_no), 0) AS low, high FROM ends, k
), slot AS (
  SELECT i AS slot, ((i % 2147483648) * 1327217885) % 2147483648 AS point FROM k, range(0, (words + block - 1) // block) x(i)
), hit AS (
  SELECT source_no, blocks, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS rank FROM slot JOIN share ON point >= low AND point < high
), uses AS (SELECT source_no, rank % blocks AS block_no, count(*) AS uses FROM hit WHERE rank < 3 * blocks GROUP BY 1, 2
), laid AS (
  SELECT d.doc_id, size, source_no, coalesce(sum(size) OVER (PARTITION BY source_no ORDER BY place, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0
), cut AS (
  SELECT doc_id, source_no, start, least(start + size, (b + 1) * block) - greatest(start, b * block) AS n, b AS block_no
  FROM laid, k, range(start // block, (start + size - 1) // block + 1) x(b)
), took AS (
  SELECT source_no, start, sum(n * coalesce(uses, 0))::BIGINT AS taken FROM cut LEFT JOIN uses USING (source_no, block_no) GROUP BY 1, 2
)
SELECT doc_id, size, source_size, target, taken FROM laid JOIN took USING (source_no, start) JOIN t USING (source_no)
UNION ALL
SELECT doc_id, size, source_size, target, 0 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size = 0
"""

OP6 = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), m AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT % 2147483648 AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY line) AS n FROM l
), b AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m WHERE words = 0 OR n > 1
), r AS (SELECT *, lag(line) OVER w AS before, lag(h) OVER w AS before_h FROM b WHERE words > 0 WINDOW w AS (PARTITION BY doc_id, run ORDER BY pos)
), p AS (SELECT before, line, count(*) AS n, (h * 31 + before_h) % 2147483648 % 8 = 0 AS rolled FROM r WHERE before IS NOT NULL GROUP BY ALL HAVING count(*) > 1
), x AS (SELECT line, max(n) AS most FROM (SELECT before AS line, n FROM p UNION ALL SELECT line, n FROM p) GROUP BY line
), q AS (SELECT p.before, p.line, rolled OR p.n < greatest(y.most, z.most) AS ends FROM p JOIN x y ON y.line = p.before JOIN x z ON z.line = p.line
), e AS (
  SELECT r.*, sum((ends IS NULL)::INT) OVER w AS stretch, sum(coalesce(ends, true)::INT) OVER w AS part
  FROM r LEFT JOIN q USING (before, line) WINDOW w AS (PARTITION BY doc_id, run ORDER BY pos)
), f AS (SELECT doc_id, run, stretch, part, min(pos) AS first, max(pos) AS last, count(*) AS n, sum(words) AS words FROM e GROUP BY ALL
), k AS (
  SELECT *, lag(first) OVER w AS first0, lag(n) OVER w AS n0, lag(words) OVER w AS words0, lead(last) OVER w AS last2, lead(n) OVER w AS n2, lead(words) OVER w AS words2,
    (n >= 2 AND words >= 10) OR words >= 50 AS alone FROM f WINDOW w AS (PARTITION BY doc_id, run, stretch ORDER BY part)
), s AS (
  SELECT doc_id, first, last FROM k WHERE alone
  UNION ALL SELECT doc_id, first, last2 FROM k WHERE NOT alone AND ((n + n2 >= 2 AND words + words2 >= 10) OR words + words2 >= 50)
  UNION ALL SELECT doc_id, first0, last FROM k WHERE NOT alone AND ((n + n0 >= 2 AND words + words0 >= 10) OR words + words0 >= 50)
), c AS (
  SELECT s.doc_id, s.first, s.last, string_agg(l.line, chr(10) ORDER BY l.pos) AS body FROM (SELECT DISTINCT * FROM s) s JOIN l ON l.doc_id = s.doc_id AND l.pos BETWEEN s.first AND s.last GROUP BY ALL
), g AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS k FROM c) WHERE k > 1
), gone AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN g ON l.doc_id = g.doc_id AND l.pos BETWEEN g.first AND g.last
), t AS (
  SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS text, count(gone.pos) AS n_lines_removed
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
)
SELECT d.doc_id, t.text, coalesce(t.n_lines_removed, 0) AS n_lines_removed FROM documents d LEFT JOIN t USING (doc_id)
"""

OP7 = r"""
WITH p AS (
  SELECT page_id, url, ('0x' || substr(md5(url), 1, 6))::INTEGER AS n,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages
), c AS (SELECT page_id, url, host, path, TIMESTAMP '2024-01-01 00:00:00' + to_days(n % 366) + to_hours(n % 24) AS fetched_at FROM p
), names AS (SELECT DISTINCT unnest([host, regexp_replace(host, '^[^.]+\.', '')]) AS entry FROM p WHERE host <> ''
), b AS (SELECT entry, ('0x' || substr(md5(entry), 1, 6))::INTEGER AS n FROM names
), iv AS (
  SELECT entry, n % 180 AS a, n % 180 + 20 + n % 90 AS z FROM b WHERE n % 3 = 0
  UNION ALL SELECT entry, n % 180 + 150, NULL FROM b WHERE n % 6 = 0
), keys AS (
  SELECT DISTINCT url, fetched_at, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(list_filter(string_split(path, '/'), lambda s: s <> '')) + 1), lambda i: host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> '')[1:i], '/')))) AS entry
  FROM c WHERE host <> ''
), hit AS (
  SELECT url, fetched_at, count(*) AS n, arg_min(k.entry, (-length(k.entry), k.entry)) AS entry FROM keys k JOIN iv ON k.entry = iv.entry
  WHERE fetched_at >= TIMESTAMP '2024-01-01 00:00:00' + to_days(iv.a) AND (iv.z IS NULL OR fetched_at < TIMESTAMP '2024-01-01 00:00:00' + to_days(iv.z))
  GROUP BY url, fetched_at
)
SELECT page_id, c.url, c.fetched_at, hit.n IS NOT NULL AS blocked, coalesce(hit.n, 0) AS n_entries, hit.entry
FROM c LEFT JOIN hit ON c.url = hit.url AND c.fetched_at = hit.fetched_at
"""

OP11 = r"""
WITH bins AS (
  SELECT b, ('0x' || substr(m, 1, 8))::BIGINT % 256 AS start, ('0x' || substr(m, 9, 8))::BIGINT % 128 * 2 + 1 AS step,
    ('0x' || substr(m, 17, 8))::BIGINT % 2147483646 + 1 AS factor, ('0x' || substr(m, 25, 8))::BIGINT % 2147483647 AS shift
  FROM (SELECT i AS b, md5('bin:' || i) AS m FROM range(256) x(i))
), probe AS (SELECT b, t, (start + t * step) % 256 AS other FROM bins, range(256) x(t)
), d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents
), e AS (
  SELECT *, left(text, n_chars - n_chars // 3) || left(coalesce(lead(text) OVER w, first_value(text) OVER w), n_chars // 3) AS edited,
    coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), t AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e
), w AS (SELECT doc_id, kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t
), h AS (
  SELECT doc_id, kind, ('0x' || substr(md5(array_to_string(ws[i:i + 4], ' ')), 1, 15))::BIGINT AS h
  FROM (SELECT doc_id, kind, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), m AS (SELECT doc_id, kind, h >> 52 AS b, min(h) AS h FROM h GROUP BY ALL
), k AS (SELECT DISTINCT doc_id, kind FROM m
), near AS (
  SELECT doc_id, kind, b, arg_min(h, t) AS h FROM (
    SELECT k.doc_id, k.kind, p.b, p.t, m.h FROM k JOIN probe p ON true JOIN m ON m.doc_id = k.doc_id AND m.kind = k.kind AND m.b = p.other
  ) GROUP BY ALL
), v AS (
  SELECT n.doc_id, n.kind, n.b, ((coalesce(m.h, n.h) % 2147483647) * factor + shift) % 2147483647 % 256 AS low
  FROM near n JOIN bins USING (b) LEFT JOIN m ON m.doc_id = n.doc_id AND m.kind = n.kind AND m.b = n.b
), f AS (SELECT doc_id, kind, list(low ORDER BY b) AS lows, string_agg(format('{:02x}', low), '' ORDER BY b) AS print FROM v GROUP BY ALL
), o AS (
  SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, coalesce(a.print, '') AS a, coalesce(b.print, '') AS b, coalesce(c.print, '') AS c, a.lows AS al, b.lows AS bl, c.lows AS cl
  FROM e LEFT JOIN f a ON a.doc_id = e.doc_id AND a.kind = 0 LEFT JOIN f b ON b.doc_id = e.doc_id AND b.kind = 1 LEFT JOIN f c ON c.doc_id = e.next_id AND c.kind = 0
), g AS (
  SELECT *, len(list_filter(range(1, 257), lambda i: al[i] = bl[i])) / 256.0::DOUBLE AS ab, len(list_filter(range(1, 257), lambda i: al[i] = cl[i])) / 256.0::DOUBLE AS ac FROM o
)
SELECT doc_id, n_chars, edited_sha256, a AS fingerprint, b AS edited_fingerprint,
  CASE WHEN a = b THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, (ab - 0.00390625::DOUBLE) / 0.99609375::DOUBLE) END AS near_edited,
  CASE WHEN a = c THEN 1.0::DOUBLE WHEN a = '' OR c = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, (ac - 0.00390625::DOUBLE) / 0.99609375::DOUBLE) END AS near_next
FROM g
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS s FROM documents
), h AS (
  SELECT *, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS y, ('0x' || substr(s, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(s, 25, 8))::BIGINT % 100 AS h4 FROM d
), f AS (
  SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(x, y) AS a, greatest(x, y) AS b FROM h
), p AS (SELECT *, left(t, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
