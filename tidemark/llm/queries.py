"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import contextmix, itq, langid, lines, mixing, packing, periodic, pipeline, quality, simhash, spelling, tokenfiles, topk, warc
from tidemark.llm.common import is_held_out, scratch, stage, table
from tidemark.llm.tokens import vocabulary

#: An id that the vocabulary doesn't have, for the end of a document.
END = 65535
#: Shares of tokens wanted of the languages; others split the rest.
LANGUAGES = {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.12}


def op1_tokens(spark, sf_dir):
    folder = scratch(spark, "tokens")
    named = stage(tokenfiles.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), END), "named")
    got = tokenfiles.token_counts(spark, folder, END)
    return got.join(named, ["file", "doc_no"]).select(F.col("id").alias("doc_id"), "file", "doc_no", "start", "tokens")


def op2_mixing(spark, sf_dir):
    got = mixing.mix(table(spark, sf_dir, "documents"), langs=LANGUAGES, keep=0.8)
    return got.withColumnsRenamed({"id": "doc_id", "p": "probability", "gap": "marginal_gap"})


def op3_lines(spark, sf_dir):
    got = lines.duplicate_lines(table(spark, sf_dir, "documents"), least=0.8)
    return got.withColumnsRenamed({"doc": "doc_id", "line": "line_no"})


def op4_warc(spark, sf_dir):
    got = warc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, "archives"), least=1000)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""


def op7_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learned_from = lambda i: F.crc32(i.cast("string")) % 5 != 0
    got = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels"), learned_from))
    return got.select(
        F.col("id").alias("doc_id"), is_held_out("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs, langid.learn(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return got.select(F.col("id").alias("doc_id"), is_held_out("id", 3, 1).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark, sf_dir):
    got = simhash.simhash_groups(table(spark, sf_dir, "documents"), most=2, n=3)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return got.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def op9_itq(spark, sf_dir):
    got = itq.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)
    return got.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op10_packing(spark, sf_dir):
    got = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048, end=0)
    return got.withColumnRenamed("id", "doc_id")


def with_repeats(docs):
    """``documents`` of which each tenth by crc32 repeats a stretch of its words from some word on, as op11's contract says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    # outside what repeats, numbers are kept above zero: Spark may evaluate them anyway
    shaped = words.withColumn("a", F.when(n > 0, g % F.greatest(n, F.lit(1))).cast("int"))
    shaped = shaped.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), n - F.col("a"))), " ")
    return shaped.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark, sf_dir):
    got = periodic.word_runs(with_repeats(table(spark, sf_dir, "documents")), least=6, exponent=4)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    got = got.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return got.select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.period").alias("period"),
        F.expr("-1000 * b.l div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: CRC-32 of an ASCII text ``s`` by bytes, with the table ``t`` of 256 numbers (crc(0..255) of one byte each).
CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc_sql(codes: str) -> str:
    """SQL for the unsigned CRC-32 of a list of bytes."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"


OP11 = rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, {crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} AS h,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents, crc),
s AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS m FROM d),
r AS (SELECT *, 1 + (n - a) // m AS p FROM s),
v AS (SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM r),
x AS (SELECT doc_id, n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM v),
e AS (SELECT y.doc_id, y.i, y.i - x.i AS q FROM x JOIN x y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
f AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT doc_id, start, length, min(q) AS period FROM f GROUP BY doc_id, start, length),
o AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start, length, period), (-length, start, period)) AS b,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM u GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM (SELECT x.doc_id, x.i, x.w FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, CAST(b.length AS BIGINT) AS length, b.period AS period,
  CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spelled(docs):
    """(word, n) of the letter runs of ``documents``, of which op12's contract has some lose a letter by crc32."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("([a-zÀ-ÿ]+)"))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(h % 97 == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= 5).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


def op12_spelling(spark, sf_dir):
    return spelling.variants(spelled(table(spark, sf_dir, "documents")), times=2)


OP12 = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS r FROM documents),
k AS (SELECT doc_id, r, count(*) AS c, CAST(doc_id AS VARCHAR) || ':' || r AS s FROM r GROUP BY doc_id, r),
h AS (SELECT r, c, {crc_sql("flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END))")} AS h FROM k, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
d AS (SELECT word, n, unnest(list_transform(range(length(word)), lambda i: left(word, i) || chr(1) || substr(word, i + 2))) AS k FROM v),
near AS (SELECT x.word, y.word AS other, y.n AS m FROM d x JOIN d y ON x.k = y.k AND x.word <> y.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = replace(d.k, chr(1), '')
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = replace(d.k, chr(1), '')),
b AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(other, m), (-m, other)) AS best FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best.m >= 2 * v.n THEN b.best.other END AS form, CASE WHEN b.best.m >= 2 * v.n THEN b.best.m END AS form_n
  FROM v LEFT JOIN b ON v.word = b.word),
p AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT p.word, p.next, f.form FROM p JOIN f ON f.word = p.next)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n FROM f JOIN p ON p.word = f.word AND p.next IS NULL
"""


def op13_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = contextmix.score(docs, contextmix.learn(docs, ~is_held_out("doc_id", 10, 0)))
    return got.select(
        F.col("id").alias("doc_id"), is_held_out("id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


QUERIES = {"op1_tokens": op1_tokens, "op2_mixing": op2_mixing, "op3_lines": op3_lines, "op4_warc": op4_warc, "op5_quality": op5_quality, "op6_simhash": op6_simhash, "op7_topk": op7_topk, "op8_language": op8_language, "op9_itq": op9_itq, "op10_packing": op10_packing, "op11_periodic": op11_periodic, "op12_spelling": op12_spelling, "op13_lm": op13_lm, "pipeline": pipeline.run}
SQL = {"op4_warc": OP4, "op7_topk": OP7, "op11_periodic": OP11, "op12_spelling": OP12}
if pipeline.ORACLE_SQL:
    SQL["pipeline"] = pipeline.ORACLE_SQL
