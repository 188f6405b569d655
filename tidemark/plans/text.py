"""Queries on articles, pages and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import sentiment, stories
from tidemark.plans.base import epoch, query, rnd, table

TITLE = "array_to_string(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:12], ' ')"
ART = f"a AS (SELECT doc_id AS id, TIMESTAMP '2024-01-01' + doc_id * INTERVAL '7 minutes' AS ts, {TITLE} AS title, 'https://www.' || source || '.example.com/' || (doc_id % 200) || '/?q=1' AS url, source, lang, text, n_chars FROM documents WHERE text IS NOT NULL)"


def articles(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    first = F.regexp_extract("text", r"^[ \t\n\f\r]*+((?:[^ \t\n\f\r]++[ \t\n\f\r]++){0,11}[^ \t\n\f\r]++)", 1)
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("doc_id") * 420)
    return d.select(
        F.col("doc_id").alias("id"), ts.alias("ts"), F.regexp_replace(first, r"[ \t\n\f\r]+", " ").alias("title"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), (F.col("doc_id") % 200).cast("string"), F.lit("/?q=1")).alias("url"), "source", "lang", "text", "n_chars",
    )


@query("f1_headline_norm", f"WITH {ART} SELECT id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS norm FROM a")
def f1(spark, sf):
    return articles(spark, sf).select("id", text.squash(F.col("title")).alias("norm"))


def _ending(before: str, name: str, now: str, pattern: str) -> str:
    """SQL: ``name`` with the ending of ``pattern`` off, where four words stay."""
    cut = f"regexp_replace({now}, '{pattern}', '')"
    return f"{name} AS (SELECT id, t, CASE WHEN len(string_split(trim({cut}), ' ')) >= 4 THEN {cut} ELSE {now} END AS {name} FROM {before})"


OUTLET_SQL, BYLINE_SQL = r"\s*[-–—|]\s*[a-z0-9&.''’ ]{2,35}$", r"\s+by\s+[a-z0-9&.''’ ]{2,30}$"
#: Titles as they come: each third one with an outlet, each fifth by someone, each seventh with both and a second outlet.
NEWS = f"""{ART}, nw AS (SELECT id, CASE WHEN id % 7 = 0 THEN title || ' - Wire by Jo O''Neil | The Daily' WHEN id % 5 = 0 THEN title || ' by A. Writer' WHEN id % 3 = 0 THEN title || ' — Reuters' ELSE title END AS title FROM a)"""


@query(
    "f2_headline_key",
    f"""WITH {NEWS}, k AS (SELECT id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS t FROM nw), {_ending("k", "c1", "t", OUTLET_SQL)}, {_ending("c1", "c2", "c1", BYLINE_SQL)}, {_ending("c2", "c3", "c2", OUTLET_SQL)},
s AS (SELECT id, t, trim(regexp_replace(regexp_replace(c3, '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS k FROM c3) SELECT id, CASE WHEN k = '' THEN t ELSE k END AS key FROM s""",
)
def f2(spark, sf):
    return headlines(spark, sf).select("id", text.headline_key(F.col("title")).alias("key"))


def headlines(spark, sf):
    i, t = F.col("id"), F.col("title")
    named = F.when(i % 7 == 0, F.concat(t, F.lit(" - Wire by Jo O'Neil | The Daily"))).when(i % 5 == 0, F.concat(t, F.lit(" by A. Writer"))).when(i % 3 == 0, F.concat(t, F.lit(" — Reuters")))
    return articles(spark, sf).select("id", F.coalesce(named, t).alias("title"))


@query("f3_protected_tokens", """SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(html), '(\\d+(?:\\.\\d+)?%?)', 1))), ',') AS tokens FROM pages""")
def f3(spark, sf):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit(r"(\d+(?:\.\d+)?%?)"), 1)))
    return table(spark, sf, "pages").select("page_id", F.array_join(found, ",").alias("tokens"))


#: Addresses as they come: every third page's without scheme, every fifth's host with a port.
URLS = r"""u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^[a-z]+://', '') WHEN page_id % 5 = 0 THEN regexp_replace(url, '://([^/]+)', '://User@\1:8080') ELSE url END AS url FROM pages),
f AS (SELECT page_id, CASE WHEN contains(trim(coalesce(url, '')), '://') THEN trim(url) ELSE 'https://' || trim(coalesce(url, '')) END AS u FROM u),
d AS (SELECT page_id, u, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', ''), '^www\.', '') AS domain FROM f)"""


def addresses(spark, sf):
    u = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", r"^[a-z]+://", "")).when(F.col("page_id") % 5 == 0, F.regexp_replace("url", r"://([^/]+)", "://User@$1:8080"))
    return table(spark, sf, "pages").select("page_id", u.otherwise(F.col("url")).alias("url"))


@query(
    "f4_canonical_url",
    rf"""WITH {URLS}, p AS (SELECT *, regexp_replace(url_decode(replace(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), '+', '%2B')), '/+$', '') AS path FROM d)
SELECT page_id, domain, CASE WHEN domain = '' THEN '' ELSE 'https://' || domain || CASE WHEN path = '' THEN '/' ELSE path END END AS canonical FROM p""",
)
def f4(spark, sf):
    u = F.col("url")
    return addresses(spark, sf).select("page_id", text.domain(u).alias("domain"), text.canonical_url(u).alias("canonical"))


@query("f6_html_title", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def f6(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query("f6_html_text")
def f6b(spark, sf):
    """Entities are decoded by an Arrow function; no SQL."""
    return table(spark, sf, "pages").select("page_id", text.unescape(text.html_text(F.col("html"))).alias("text"))


@query("f8_stable_ids", f"WITH {ART} SELECT id, substr(sha256(source || '|' || CAST(id AS VARCHAR) || '|' || lang), 1, 20) AS sid FROM a")
def f8(spark, sf):
    return articles(spark, sf).select("id", text.stable_id(F.col("source"), F.col("id").cast("string"), F.col("lang")).alias("sid"))


@query("f9_dates", f"WITH {ART} SELECT id, epoch(date_trunc('week', ts))::BIGINT AS week_s, (isodow(ts) - 1)::INT AS weekday, epoch(time_bucket(INTERVAL '15 minutes', ts))::BIGINT AS grid_s FROM a")
def f9(spark, sf):
    grid = F.floor(epoch() / 900) * 900
    return articles(spark, sf).select("id", epoch(F.date_trunc("week", "ts")).alias("week_s"), F.weekday("ts").alias("weekday"), grid.alias("grid_s"))


@query(
    "f10_calendar_features",
    f"""WITH {ART}, l AS (SELECT id, ts, timezone('America/New_York', timezone('UTC', ts)) AS ny FROM a)
SELECT id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, isodow(ts) >= 6 AS weekend,
  isodow(ts) < 6 AND (hour(ny) * 60 + minute(ny)) BETWEEN 570 AND 959 AS ny_session FROM l""",
)
def f10(spark, sf):
    local = F.from_utc_timestamp("ts", "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    angle = 2 * F.pi() * F.hour("ts") / 24
    return articles(spark, sf).select(
        "id", rnd(F.sin(angle)).alias("hour_sin"), rnd(F.cos(angle)).alias("hour_cos"), (F.weekday("ts") >= 5).alias("weekend"),
        ((F.weekday("ts") < 5) & (minute >= 570) & (minute < 960)).alias("ny_session"),
    )


def relevant_sql(c: str) -> str:
    """The rules of ``text.relevant`` in SQL."""
    out = []
    for topic, rx in text.RELEVANT.items():
        t = f"lower({c})"
        hit = f"regexp_matches({f"regexp_replace({t}, '{text.BLANKED[topic]}', ' ', 'g')" if topic in text.BLANKED else t}, '{rx}')"
        if topic in text.RULED_OUT:
            hit += f" AND NOT regexp_matches({t}, '{text.RULED_OUT[topic]}')"
        if topic in text.NEEDED:
            hit += f" AND regexp_matches({t}, '{text.NEEDED[topic]}')"
        out.append(f"({hit})")
    return f"coalesce({' OR '.join(out)}, false)"


@query("p7_relevance", f"SELECT page_id, {relevant_sql('html')} AS relevant FROM pages")
def p7(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.relevant(F.col("html")).alias("relevant"))


@query("p7_market_relevance", f"SELECT doc_id, {relevant_sql('text')} AS relevant FROM documents")
def p7b(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.relevant(F.col("text")).alias("relevant"))


@query("p8_tech_subset", f"""SELECT page_id, regexp_matches(lower(concat_ws(' ', html, url)), '{text.TECH}') AS tech FROM pages""")
def p8(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.technology(F.concat_ws(" ", "html", "url")).alias("tech"))


@query("p9_streams", f"WITH {ART} SELECT id, array_to_string(list_sort(list_distinct(list_filter(['base', CASE WHEN regexp_matches(lower(title), 'the') THEN 'en' END, CASE WHEN regexp_matches(lower(title), 'und|der') THEN 'de' END], lambda x: x IS NOT NULL))), ',') AS streams FROM a")
def p9(spark, sf):
    return articles(spark, sf).select("id", F.array_join(text.streams(F.col("title"), {"en": "the", "de": "und|der"}, ["base"]), ",").alias("streams"))


@query("s17_stream_rows", f"WITH {ART} SELECT id, unnest(list_filter(['usa500', CASE WHEN regexp_matches(lower(title), 'en') THEN 'btc' END, CASE WHEN regexp_matches(lower(title), 'st') THEN 'usatech' END], lambda x: x IS NOT NULL)) AS stream, epoch(ts)::BIGINT + 60 AS available_s FROM a")
def s17(spark, sf):
    """One row for each stream that an event's title belongs to, usable a minute later."""
    of = text.streams(F.col("title"), {"btc": "en", "usatech": "st"}, ["usa500"])
    return articles(spark, sf).select("id", F.explode(of).alias("stream"), (epoch() + 60).alias("available_s"))


@query("s13_first_by_url", f"WITH {ART} SELECT url, arg_min(id, (ts, id)) AS id FROM a GROUP BY url")
def s13(spark, sf):
    return stories.first_by(articles(spark, sf).select("id", "ts", "url"), ["url"], [F.col("ts"), F.col("id")]).select("url", "id")


@query(
    "x1_exact_echoes",
    f"""WITH RECURSIVE {ART}, g AS (SELECT url, min(ts) AS ts FROM a GROUP BY url UNION ALL SELECT g.url, (SELECT min(a.ts) FROM a WHERE a.url = g.url AND a.ts >= g.ts + INTERVAL '30 hours') FROM g WHERE g.ts IS NOT NULL)
SELECT id, g.ts IS NOT NULL AS keep FROM a LEFT JOIN g ON g.url = a.url AND g.ts = a.ts""",
)
def x1(spark, sf):
    return stories.exact_echoes(articles(spark, sf), "id", "url", 30)


@query("x1_story_ledger")
def x1b(spark, sf):
    """The fuzzy step has no SQL; tests compare it with a plain loop over the given articles and over crowded ones."""
    return stories.story_ledger(articles(spark, sf))


@query("g30_echo_counts", f"WITH {ART} SELECT title, epoch(min(ts))::BIGINT AS first_s, count(*) AS echoes FROM a GROUP BY title")
def g30(spark, sf):
    return stories.echo_counts(articles(spark, sf), "title").select("title", epoch("first_seen").alias("first_s"), "echoes")


SCO = f"{ART}, sc AS (SELECT a.id, a.ts, a.source, quality - toxic AS sent, least(n_chars, 5000) / 5000.0 AS conf FROM a JOIN labels l ON l.doc_id = a.id)"


def scored(spark, sf):
    l = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return articles(spark, sf).join(l, "id").select("id", "ts", "source", (F.col("quality") - F.col("toxic")).alias("sent"), (F.least("n_chars", F.lit(5000)) / 5000.0).alias("conf"))


@query("j9_matched_scores", f"WITH {SCO} SELECT id, sent, round(conf, 6) AS conf FROM sc")
def j9(spark, sf):
    return scored(spark, sf).select("id", "sent", rnd("conf").alias("conf"))


@query(
    "x7_sentiment_grid",
    f"""WITH {SCO}, g AS (SELECT 'all' AS k, time_bucket(INTERVAL '1 hour', ts) AS ts, sum(conf) AS w, sum(conf * sent) AS wx, count(*) AS n FROM sc GROUP BY ALL),
c AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM g), z AS (SELECT c.ts, coalesce(w, 0) AS w, coalesce(wx, 0) AS wx, coalesce(n, 0) AS n FROM c LEFT JOIN g ON g.ts = c.ts)
SELECT epoch(ts)::BIGINT AS ts_s, n::BIGINT AS n, sum(n) OVER (ORDER BY ts ROWS 5 PRECEDING)::BIGINT AS n6, round(coalesce(sum(wx) OVER (ORDER BY ts ROWS 23 PRECEDING) / nullif(sum(w) OVER (ORDER BY ts ROWS 23 PRECEDING), 0), 0), 5) AS mean24 FROM z""",
)
def x7(spark, sf):
    from tidemark.operators.bars import on_grid
    from tidemark.operators.series import rolling

    s = scored(spark, sf).withColumn("symbol", F.lit("all"))
    g = s.groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("conf").alias("w"), F.sum(F.col("conf") * F.col("sent")).alias("wx"), F.count(F.lit(1)).alias("n"))
    g = on_grid(g, "1 hour", ["w", "wx", "n"])
    tot = lambda f, c, k: F.sum(c).over(f.over(k))
    got = rolling(g, 24, lambda f: {"n6": tot(f, "n", 6), "mean24": F.coalesce(tot(f, "wx", 24) / F.nullif(tot(f, "w", 24), F.lit(0.0)), F.lit(0.0))})
    return got.select(epoch().alias("ts_s"), "n", "n6", rnd("mean24", 5).alias("mean24"))


@query("x6_arm_weights", f"WITH {ART}, e AS (SELECT title, count(*) AS n, min(id) AS id FROM a GROUP BY title) SELECT e.id, round(least(n_chars, 5000) / 5000.0 * (1 + ln(1 + n)), 6) AS weight FROM e JOIN a ON a.id = e.id")
def x6(spark, sf):
    a = articles(spark, sf)
    e = a.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).drop("title")
    return a.join(e, "id").select("id", rnd(stories.arm_weight(F.least("n_chars", F.lit(5000)) / 5000.0, F.col("n"))).alias("weight"))


@query("t5_top_items", f"WITH {SCO}, r AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY source ORDER BY conf DESC, id) <= 3) SELECT id, source, round(conf, 6) AS conf FROM r ORDER BY conf DESC, id LIMIT 20")
def t5(spark, sf):
    got = stories.top_items(scored(spark, sf), 3, 20, "source", [F.desc("conf"), F.col("id")])
    return got.select("id", "source", rnd("conf").alias("conf"))


@query(
    "x8_consolidated_lessons",
    r"""WITH l AS (SELECT conv_id, trim(regexp_replace(unnest(string_split_regex(lower(text), '[.,;:!?]')), '\s+', ' ', 'g')) AS lesson FROM conversations WHERE text IS NOT NULL)
SELECT lesson, count(DISTINCT conv_id) AS support, round(least(0.95, 0.5 + 0.1 * count(DISTINCT conv_id)), 6) AS confidence FROM l WHERE lesson <> '' GROUP BY lesson HAVING count(DISTINCT conv_id) >= 2""",
)
def x8(spark, sf):
    """Every clause of every turn is a lesson; conversations are the independent evaluations."""
    c = table(spark, sf, "conversations").where("text is not null")
    l = c.select(F.explode(F.split(F.lower("text"), r"[.,;:!?]")).alias("c"), F.col("conv_id").alias("evaluation"), F.col("turn").alias("ts"))
    l = l.select(text.squash(F.col("c")).alias("lesson"), "evaluation", "ts").where("lesson <> ''")
    return stories.consolidated(l).select("lesson", "support", rnd("confidence").alias("confidence"))


@query("t6_retrieval", f"WITH {ART} SELECT id, (CASE WHEN source IN ('src1', 'en') THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS overlap FROM a WHERE ts <= (SELECT to_timestamp((epoch(min(ts)) + epoch(max(ts))) // 2)::TIMESTAMP FROM a) ORDER BY overlap DESC, ts DESC, id LIMIT 8")
def t6(spark, sf):
    m = articles(spark, sf).select("id", F.col("ts").alias("available_at"), F.array("source", "lang").alias("tags"))
    half = m.agg(F.floor((F.unix_timestamp(F.min("available_at")) + F.unix_timestamp(F.max("available_at"))) / 2)).first()[0]
    return stories.retrieve(m, ["src1", "en"], 8, F.timestamp_seconds(F.lit(half))).select("id", "overlap")


@query("x4_score_cache", f"""WITH {ART}, k AS (SELECT id, lang, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM a), c AS (SELECT DISTINCT key FROM k WHERE lang <> 'en'),
m AS (SELECT key, min(text) AS text FROM k GROUP BY key) SELECT id, round(CASE WHEN c.key IS NOT NULL THEN 0.5 ELSE least(1.0, length(m.text) / 1000) END, 6) AS score FROM k JOIN m USING (key) LEFT JOIN c USING (key)""")
def x4(spark, sf):
    """The scorer, a function of the user, is a text's length here."""
    a = articles(spark, sf)
    key = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    cache = a.where("lang <> 'en'").select(key.alias("key"), F.lit("m").alias("model"), F.lit("1").alias("version"), F.lit(0.5).alias("score"))
    return stories.score_missing(a, cache, lambda texts: [min(1.0, len(t) / 1000) for t in texts], "m", "1").select("id", rnd("score").alias("score"))


@query("j13_semi_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j13(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j11_full_outer", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' WHEN l.doc_id IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def j11(spark, sf):
    d = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.lit(1).alias("a"))
    l = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("b"))
    side = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    return d.join(l, "doc_id", "full_outer").select("doc_id", side.alias("side"))


@query("s21_content_hash", "SELECT bucket, sha256(count(*) || '|' || sum(('0x' || h[1:15])::BIGINT) || '|' || sum(('0x' || h[16:30])::BIGINT) || '|' || sum(('0x' || h[31:45])::BIGINT)) AS digest FROM (SELECT event_id % 16 AS bucket, sha256(CAST(event_id AS VARCHAR) || '|' || event_type) AS h FROM events) GROUP BY bucket")
def s21(spark, sf):
    from tidemark.sources.tables import content_hash

    return content_hash(table(spark, sf, "events").select(F.col("event_id").cast("string").alias("a"), F.col("event_type").alias("b"), "event_id"), ["a", "b"], F.col("event_id") % 16)


@query("s3_clean", """WITH d AS (SELECT user_id, date_trunc('hour', ts) AS ts, min(event_id) AS event_id FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT user_id, epoch(ts)::BIGINT AS ts_s, event_id FROM d""")
def s3(spark, sf):
    e = table(spark, sf, "events").where("value is not null").select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "event_id")
    return stories.first_by(e, ["user_id", "ts"], [F.col("event_id")]).select("user_id", epoch().alias("ts_s"), "event_id")


@query("u_set_operations", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
UNION ALL SELECT 'only_customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'union', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)""")
def u(spark, sf):
    o, c = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    parts = {"both": o.intersect(c), "only_customers": c.subtract(o), "union": o.union(c).distinct()}
    rows = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


#: Two scorers of the same stories, the first of each title, and what comes with them; policy events are those of two sources.
STORIES = f"""{ART}, fs AS (SELECT title, min(id) AS id, count(*) AS echoes FROM a GROUP BY title),
st AS (SELECT a.id, a.ts, a.source, a.title, echoes, quality - toxic * 0.5 AS sent, (n_chars % 201 - 100) / 100.0 AS llm_sent, (n_chars % 11) / 10.0 AS llm_relevance, n_chars % 3 AS llm_impact,
  ['BTC', 'macro', 'US500', 'none'][a.id % 4 + 1] AS llm_asset, (n_chars % 13 - 6) / 2.0 AS tone FROM fs JOIN a ON a.id = fs.id JOIN labels l ON l.doc_id = a.id),
br AS (SELECT DISTINCT time_bucket(INTERVAL '15 minutes', ts) AS b FROM events), br0 AS (SELECT min(b) AS b0 FROM br)"""
TOPIC = r"(?:^|[^\p{L}])(?:the|und|les|los)(?:$|[^\p{L}])"


def stories_scored(spark, sf):
    a = articles(spark, sf)
    first = a.groupBy("title").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("echoes")).drop("title")
    got = a.join(first, "id").join(table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id")
    n = F.col("n_chars")
    asset = F.element_at(F.array(*map(F.lit, ("BTC", "macro", "US500", "none"))), (F.col("id") % 4 + 1).cast("int"))
    return got.select(
        F.lit("btc").alias("symbol"), "id", "ts", "source", "title", "echoes", (F.col("quality") - F.col("toxic") * 0.5).alias("sent"), ((n % 201 - 100) / 100.0).alias("llm_sent"),
        ((n % 11) / 10.0).alias("llm_relevance"), (n % 3).alias("llm_impact"), asset.alias("llm_asset"), ((n % 13 - 6) / 2.0).alias("tone"),
    )


def blocks(spark, sf, scorer, weighting):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bars = e.select(F.lit("btc").alias("symbol"), F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900).alias("ts")).distinct()
    s = stories_scored(spark, sf)
    index = e.groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.floor(F.avg("value")).alias("value"))
    releases = e.where("event_type = 'signup'").select(F.lit("btc").alias("symbol"), F.date_trunc("hour", "ts").alias("ts")).distinct()
    direct = F.col("source").isin("src1", "src2")
    return sentiment.matched_features(bars, s.where(~direct), s.where(~direct), releases, s.where(direct), index, scorer, weighting, "BTC", TOPIC)


def block_sql(scorer: str, weighting: str) -> str:
    score = "llm_sent" if scorer == "llm" else "sent"
    own = weighting == "own"
    llm_w = "least(greatest(llm_relevance, 0.0), 1.0) * (llm_impact + 1)"
    llm_k = "llm_asset IN ('BTC', 'macro')"
    kept = "true" if not own else llm_k if scorer == "llm" else f"regexp_matches(lower(title), '{TOPIC}')"
    w = "1.0" if not own else llm_w if scorer == "llm" else "least(abs(sent), 1.0) * (1 + ln(1.0 + echoes))"
    direct = "source IN ('src1', 'src2')"
    parts = [
        f"SELECT 'news', ts, {score}, {w} FROM st WHERE NOT {direct} AND {kept}", f"SELECT 'tone', ts, tone, 1.0 FROM st WHERE NOT {direct}",
        "SELECT DISTINCT 'macro', date_trunc('hour', ts), 1.0, 1.0 FROM events WHERE event_type = 'signup'", f"SELECT 'direct', ts, {score}, {w} FROM st WHERE {direct} AND {kept}",
    ]
    if scorer == "llm":
        parts += [
            f"SELECT 'rel', ts, least(greatest(llm_relevance, 0.0), 1.0), 1.0 FROM st WHERE NOT {direct} AND {llm_k}",
            f"SELECT 'hi', ts, {score}, {llm_w} FROM st WHERE NOT {direct} AND {llm_k} AND llm_impact >= 2", f"SELECT 'every', ts, {score}, 1.0 FROM st WHERE NOT {direct}",
        ]
    mean = lambda n: f"CASE WHEN coalesce(max(CASE WHEN name = '{n}' THEN w END), 0) > 1e-12 THEN max(CASE WHEN name = '{n}' THEN vw END) / max(CASE WHEN name = '{n}' THEN w END) ELSE 0 END"
    of = lambda n, c: f"coalesce(max(CASE WHEN name = '{n}' THEN {c} END), 0)"
    more = f""", round({mean("rel")}, 6) AS sent_llm_relevance_decay, round({mean("hi")}, 6) AS sent_llm_hi_impact_decay,
  round(CASE WHEN {of("every", "n")} > 0 THEN {of("rel", "n")} / {of("every", "n")} ELSE 0 END, 6) AS sent_llm_topic_share_24h""" if scorer == "llm" else ""  # fmt: skip
    return f"""WITH {STORIES}, ev(name, ts, v, w) AS ({" UNION ALL ".join(parts)}),
cl AS (SELECT name, time_bucket(INTERVAL '15 minutes', ts) AS c, count(*) AS n, sum(v) AS v, sum(w) AS w, sum(v * w) AS vw FROM ev GROUP BY ALL),
s0 AS (SELECT name, least(min(c), any_value(b0)) AS s, CASE WHEN name = 'direct' THEN 1 - pow(0.5, 1 / 192.0) ELSE 1 - pow(0.5, 1 / 24.0) END AS a FROM cl, br0 GROUP BY name),
k AS (SELECT br.b, cl.*, pow(1 - a, (epoch(br.b) - epoch(c)) / 900) * CASE WHEN c = s THEN 1 ELSE a END AS f FROM br JOIN cl ON cl.c <= br.b JOIN s0 ON s0.name = cl.name),
d AS (SELECT b, name, sum(f * v) AS v, sum(f * w) AS w, sum(f * vw) AS vw, CAST(sum(CASE WHEN c > b - INTERVAL '24 hours' THEN n ELSE 0 END) AS DOUBLE) AS n FROM k GROUP BY ALL),
ix AS (SELECT date_trunc('day', ts) AS at, floor(avg(value)) AS x FROM events GROUP BY ALL), iy AS (SELECT br.b, x FROM br ASOF LEFT JOIN ix ON br.b + INTERVAL '15 minutes' >= ix.at),
iz AS (SELECT b, coalesce(x - lag(x, 672) OVER (ORDER BY b), 0) AS g FROM iy)
SELECT epoch(iz.b)::BIGINT AS ts_s, round({mean("news") if own else of("news", "v")}, 6) AS sent_news_decay, {of("news", "n")} AS sent_news_count_24h, round({of("tone", "v")}, 6) AS sent_tone_decay,
  round({of("macro", "v")}, 6) AS sent_macro_decay, round({of("direct", "vw")} / (1 - pow(0.5, 1 / 192.0)), 6) AS sent_direct_pulse, any_value(g) AS sent_fng_change_7d{more}
FROM iz LEFT JOIN d ON d.b = iz.b GROUP BY iz.b"""


def _rounded(got):
    return got.select(epoch().alias("ts_s"), *[F.col(c) if c in ("sent_news_count_24h", "sent_fng_change_7d") else rnd(c).alias(c) for c in got.columns if c not in ("symbol", "ts")])


@query("x7_llm_own_blocks", block_sql("llm", "own"))
def x7_llm(spark, sf):
    return _rounded(blocks(spark, sf, "llm", "own"))


@query("x7_classic_own_blocks", block_sql("classic", "own"))
def x7_classic_own(spark, sf):
    return _rounded(blocks(spark, sf, "classic", "own"))


@query("x7_classic_plain_blocks", block_sql("classic", "plain"))
def x7_classic(spark, sf):
    return _rounded(blocks(spark, sf, "classic", "plain"))
