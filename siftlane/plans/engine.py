"""Queries of the message-risk engine over the logged and the labelled messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlane import config as c
from siftlane.functions import text as tx
from siftlane.functions import urls as ux
from siftlane.operators import assess as aa
from siftlane.operators import evaluate as ev
from siftlane.operators import matching as mt
from siftlane.plans import oracle as o
from siftlane.session import table
from siftlane.sources import dictionary as dc
from siftlane.sources import messages as ms
from siftlane.sources import sinks
from siftlane.streaming import conversations as cv
from siftlane.streaming import loop as lp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def engine(spark: SparkSession, d: str, **settings) -> c.EngineConfig:
    return dc.engine(table(spark, d, "pattern_file"), shorteners=o.SHORTENERS, **settings)


def logged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detections").select("id", "ts", "chat_id", "sender_name", F.coalesce("message_text", F.lit("")).alias("text"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return ms.labelled(table(spark, d, "labelled_csv")).select(F.col("row_id").alias("id"), "text", "is_positive", "source", "split_name")


def assessed(spark: SparkSession, d: str, **settings) -> DataFrame:
    return aa.assess(logged(spark, d).select("id", "text"), engine(spark, d, **settings))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Labelled messages with their assessment and how it would be shown."""
    return aa.assess(labelled(spark, d), engine(spark, d)).withColumn("shown", aa.display_mode(F.col("action_tier"), F.col("evidence_groups")))


# --- text functions ---------------------------------------------------------


@query("str_normalize", f"SELECT id, {o.NORM.format('message_text')} AS norm FROM detections")
def _(spark, d):
    return table(spark, d, "detections").select("id", tx.normalize(F.col("message_text")).alias("norm"))


@query("str_split_key", rf"SELECT row_id, lower({o.STRIP.format(r"regexp_replace(text, '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')")}) AS key FROM labelled_csv")
def _(spark, d):
    return table(spark, d, "labelled_csv").select("row_id", tx.split_key(F.col("text")).alias("key"))


@query("str_context", f"SELECT row_id, {o.STRIP.format('lower(substr(text, 31, least(length(text), 70) - 30))')} AS context FROM labelled_csv WHERE length(text) > 50")
def _(spark, d):
    return table(spark, d, "labelled_csv").where(F.length("text") > 50).select("row_id", tx.context(F.col("text"), F.lit(50)).alias("context"))


@query("str_truncate", "SELECT row_id, substr(text, 1, 40) AS cut FROM labelled_csv")
def _(spark, d):
    return table(spark, d, "labelled_csv").select("row_id", tx.truncate(F.col("text"), 40).alias("cut"))


@query("str_word_bounded", f"SELECT id, first FROM (SELECT id, instr(low, 'code') - 1 AS first, low FROM (SELECT id, lower(message_text) AS low FROM detections)) WHERE first >= 0 AND (first = 0 OR NOT regexp_full_match(substr(low, first, 1), '{o.W}')) AND (first + 4 = length(low) OR NOT regexp_full_match(substr(low, first + 5, 1), '{o.W}'))".replace("first", "a"))
def _(spark, d):
    low = table(spark, d, "detections").select("id", F.lower("message_text").alias("low")).withColumn("a", (F.instr("low", "code") - 1).cast("long"))
    return low.where((F.col("a") >= 0) & tx.word_bounded(F.col("low"), F.col("a"), F.col("a") + 3)).select("id", "a")


@query("str_obfuscated", f"SELECT row_id FROM labelled_csv WHERE {o.OBFUSCATED.format('text')}")
def _(spark, d):
    return table(spark, d, "labelled_csv").where(tx.obfuscated(F.col("text"))).select("row_id")


@query("str_url_like", f"SELECT id FROM detections WHERE regexp_matches({o.ASCIIED.format(o.NORM.format('message_text'))}, '{o.URL_LIKE}', 'i')")
def _(spark, d):
    return table(spark, d, "detections").where(tx.url_like(tx.normalize(F.col("message_text")))).select("id")


@query("str_digit_ratio", r"SELECT row_id, round(length(regexp_replace(text, '\P{Nd}', '', 'g'))::DOUBLE / greatest(length(text), 1), 6) AS ratio FROM labelled_csv")
def _(spark, d):
    return table(spark, d, "labelled_csv").select("row_id", F.round(tx.digit_ratio(F.col("text")), 6).alias("ratio"))


@query("str_preview", "SELECT id, CASE WHEN length(message_text) > 50 THEN substr(message_text, 1, 50) || '...' ELSE message_text END AS preview FROM detections")
def _(spark, d):
    return table(spark, d, "detections").select("id", tx.preview(F.col("message_text")).alias("preview"))


@query("str_pattern_summary", o.ENGINE + "SELECT a.id, coalesce(s.summary, 'suspicious content') AS summary FROM assess a LEFT JOIN (SELECT id, array_to_string(list(pattern ORDER BY k), ', ') AS summary FROM (SELECT id, pattern, min((CASE match_type WHEN 'exact' THEN 0 WHEN 'fuzzy' THEN 1 ELSE 2 END, CASE match_type WHEN 'exact' THEN first + length(matched_text) WHEN 'fuzzy' THEN j ELSE first END, CASE match_type WHEN 'fuzzy' THEN first + length(matched_text) ELSE j END)) AS k FROM det JOIN dict USING (pattern) WHERE match_type IN ('exact','fuzzy','affix') GROUP BY id, pattern) GROUP BY id) s USING (id)")
def _(spark, d):
    return assessed(spark, d).select("id", aa.pattern_summary(F.col("detections")).alias("summary"))


@query("str_mean_pattern_length", "SELECT round(avg(length(trim(pattern))), 6) AS mean_length FROM pattern_file")
def _(spark, d):
    return dc.clean(table(spark, d, "pattern_file")).agg(F.round(F.avg(F.length("pattern")), 6).alias("mean_length"))


# --- dictionary -------------------------------------------------------------

_PATTERN_TEXT = ["# comment", "[category: deed]", "open", "  Visit  ", "", "# category: money", "loan", "Loan", "[lure]", "prize", "[]", "odd", "[category: ]", "other # kept", "#dropped"]


def _lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_PATTERN_TEXT)), "line_no INT, line STRING")


@query("src_dictionary_parse", "SELECT * FROM (VALUES (2, 'deed', 'open'), (3, 'deed', 'Visit'), (6, 'money', 'loan'), (7, 'money', 'Loan'), (9, 'lure', 'prize'), (11, 'general', 'odd'), (13, 'general', 'other # kept')) t(line_no, category, pattern)")
def _(spark, d):
    return dc.parse(_lines(spark))


@query("src_dictionary_clean", "SELECT idx, category, pattern FROM (SELECT idx, category, trim(pattern) AS pattern, row_number() OVER (PARTITION BY category, lower(trim(pattern)) ORDER BY idx) AS n FROM pattern_file WHERE trim(pattern) <> '' AND trim(pattern) NOT LIKE '#%') WHERE n = 1")
def _(spark, d):
    return dc.clean(table(spark, d, "pattern_file"))


@query("src_dictionary_add", "SELECT idx, category, trim(pattern) AS pattern FROM pattern_file UNION ALL SELECT * FROM (VALUES (58, 'custom', 'gantimpala'), (59, 'custom', 'voucher')) t")
def _(spark, d):
    new = spark.createDataFrame([("voucher",), ("OPEN",), (" gantimpala ",), ("Voucher",), ("# no",), ("",)], "pattern STRING").where("pattern <> 'Voucher'")
    return dc.add(dc.clean(table(spark, d, "pattern_file")), new, "custom")


@query("snk_dictionary_text", "SELECT min(idx) AS first_idx, category, '[category: ' || category || ']' || chr(10) || string_agg(trim(pattern), chr(10) ORDER BY idx) || chr(10) AS block FROM pattern_file GROUP BY category")
def _(spark, d):
    return dc.to_text(dc.clean(table(spark, d, "pattern_file")))


@query("src_baseline_patterns", "SELECT * FROM (VALUES ('open'), ('Visit'), ('loan'), ('Loan'), ('prize'), ('odd'), ('other # kept')) t(pattern)")
def _(spark, d):
    return dc.baseline_patterns(_lines(spark))


@query("ev_pattern_listing", f"SELECT category, trim(pattern) AS pattern, {o.NORM.format('trim(pattern)')} AS norm FROM pattern_file")
def _(spark, d):
    return dc.listing(dc.clean(table(spark, d, "pattern_file")))


@query("ev_category_counts", "SELECT category, count(*) AS n, max(count(*)) OVER () AS most FROM pattern_file GROUP BY category")
def _(spark, d):
    n = dc.clean(table(spark, d, "pattern_file")).groupBy("category").agg(F.count("*").alias("n"))
    return n.withColumn("most", F.max("n").over(Window.partitionBy(F.lit(1))))


@query("ev_automaton_size", f"WITH {o.DICT} SELECT (SELECT count(DISTINCT substr(norm, 1, k)) + 1 FROM dict, unnest(range(1, length(norm) + 1)) AS t(k)) AS states, (SELECT count(DISTINCT substr(norm, 1, 1)) FROM dict) AS root_children, (SELECT count(*) FROM dict) AS patterns")
def _(spark, d):
    p = dc.listing(dc.clean(table(spark, d, "pattern_file"))).where(F.length("norm") > 0)
    prefix = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("norm")), lambda k: F.substring(F.col("norm"), F.lit(1), k))).alias("s"))
    head = p.agg(F.countDistinct(F.substring("norm", 1, 1)).alias("root_children"), F.count("*").alias("patterns"))
    return prefix.agg((F.countDistinct("s") + 1).alias("states")).crossJoin(F.broadcast(head))  # one row each


@query("ev_trie_edges", f"WITH {o.DICT} SELECT DISTINCT substr(norm, 1, k - 1) AS state, substr(norm, k, 1) AS char, substr(norm, 1, k) AS next, substr(norm, 1, k) IN (SELECT norm FROM dict) AS is_output FROM dict, unnest(range(1, length(norm) + 1)) AS t(k)")
def _(spark, d):
    p = dc.listing(dc.clean(table(spark, d, "pattern_file")))
    step = F.transform(F.sequence(F.lit(1), F.length("norm")), lambda k: F.struct(F.substring(F.col("norm"), F.lit(1), k - 1).alias("state"), F.substring(F.col("norm"), k, F.lit(1)).alias("char"), F.substring(F.col("norm"), F.lit(1), k).alias("next")))
    edges = p.where(F.length("norm") > 0).select(F.explode(step).alias("e")).select("e.*").distinct()
    return edges.join(p.select(F.col("norm").alias("next")).distinct().withColumn("is_output", F.lit(True)), "next", "left").select("state", "char", "next", F.coalesce("is_output", F.lit(False)).alias("is_output"))


@query("ev_character_map", "SELECT DISTINCT ch, translate(ch, '@013$45vfj', 'aoiesasbpg') AS norm FROM (SELECT unnest(string_split(lower(text), '')) AS ch FROM labelled_csv) WHERE ch <> ''")
def _(spark, d):
    ch = F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("ch")
    return table(spark, d, "labelled_csv").select(ch).where("ch <> ''").distinct().select("ch", tx.normalize(F.col("ch")).alias("norm"))


# --- sources ----------------------------------------------------------------


@query("src_labelled", "SELECT row_id, coalesce(text, '') AS text, coalesce(lower(trim(label)) = '1', false) AS is_positive FROM labelled_csv")
def _(spark, d):
    return ms.labelled(table(spark, d, "labelled_csv")).select("row_id", "text", "is_positive")


@query("src_profile", "SELECT label, count(*) AS n FROM labelled_csv GROUP BY label")
def _(spark, d):
    return ms.profile(table(spark, d, "labelled_csv"))


@query("src_registry", "SELECT r.id, r.original_filename, len(r.columns) AS n_columns, r.row_count, count(l.row_id) AS actual FROM dataset_registry r LEFT JOIN labelled_csv l ON l.dataset_id = r.id GROUP BY ALL")
def _(spark, d):
    n = table(spark, d, "labelled_csv").groupBy(F.col("dataset_id").alias("id")).agg(F.count("*").alias("actual"))
    return table(spark, d, "dataset_registry").join(n, "id", "left").select("id", "original_filename", F.size("columns").cast("long").alias("n_columns"), "row_count", F.coalesce("actual", F.lit(0)).alias("actual"))


_EVENTS = "SELECT DISTINCT * FROM webhook_event"


@query("src_text_events", f"SELECT event_id, received_at, coalesce(nullif(chat_hostname, ''), nullif(chat_id, ''), coalesce(sender.id, 'unknown')) AS chat, coalesce(sender.id, 'unknown') AS sender_id, coalesce(sender.name, 'unknown') AS sender_name, coalesce(message.text, '') AS text FROM ({_EVENTS}) WHERE event = 'message' AND message.type = 'text'")
def _(spark, d):
    return ms.text_events(ms.once(table(spark, d, "webhook_event")))


@query("src_event_json", f"SELECT event, count(*) AS n FROM ({_EVENTS}) GROUP BY event")
def _(spark, d):
    """Events written as JSON and read again by the source's schema."""
    j = ms.once(table(spark, d, "webhook_event")).select(F.to_json(F.struct("event", "message", "sender", "chat_id", "chat_hostname")).alias("j"))
    return j.select(F.from_json("j", ms.EVENT).alias("e")).groupBy("e.event").agg(F.count("*").alias("n"))


@query("src_trusted_pages", "SELECT url, len(list_filter([" + ",".join(f"'{x}'" for x in c.TRUSTED_PAGES) + "], lambda x: bare = x OR ends_with(bare, '.' || x))) > 0 AS skipped FROM (SELECT url, regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '/.*$', '') AS bare FROM (SELECT url FROM resolutions UNION ALL SELECT * FROM (VALUES ('https://gcash.com/x'), (' help.BPI.com.ph'), ('notgcash.com')) t(url)))")
def _(spark, d):
    more = spark.createDataFrame([("https://gcash.com/x",), (" help.BPI.com.ph",), ("notgcash.com",)], "url STRING")
    return table(spark, d, "resolutions").select("url").unionByName(more).select("url", ms.bare_trusted(F.col("url")).alias("skipped"))


@query("src_page_text")
def _(spark, d):
    """Each labelled text as a small page, and back: text and links."""
    t = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    pages = table(spark, d, "labelled_csv").select("row_id", F.concat(F.lit("<div><p>"), t, F.lit('</p><a href="https://x.example/'), F.col("row_id"), F.lit('">more</a></div>')).alias("html"))
    return ms.with_page(pages).select("row_id", "page_text", F.explode("page_links").alias("l")).select("row_id", "page_text", "l.href", "l.label")


# --- matching ---------------------------------------------------------------


def _hits(layer: str | None) -> Query:
    def run(spark, d):
        h = mt.with_hits(logged(spark, d).select("id", "text"), engine(spark, d)).select("id", F.explode("hits").alias("h"))
        h = h.where(F.col("h.layer") == layer) if layer else h
        return h.select("id", F.col("h.layer").alias("layer"), F.col("h.idx").cast("long").alias("j"), F.col("h.errors").alias("errors"), F.col("h.first").cast("long").alias("a"), F.col("h.last").cast("long").alias("b"), "h.matched", "h.root")

    return run


for _layer in ("exact", "fuzzy", "affix"):
    query(f"mat_{_layer}", o.ENGINE + f"SELECT id, layer, j, CAST(errors AS INTEGER) AS errors, CAST(first AS BIGINT) AS a, CAST(last AS BIGINT) AS b, matched, root FROM hits WHERE layer = '{_layer}'")(_hits(_layer))


@query("mat_exact_by_columns", o.ENGINE + "SELECT id, CAST(j AS INTEGER) AS idx, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM hits WHERE layer = 'exact'")
def _(spark, d):
    return mt.exact_by_columns(logged(spark, d), engine(spark, d))


@query("mat_baseline", f"WITH {o.DICT}, m AS (SELECT id, message_text AS t, pattern, unnest(range(1, length(message_text) - length(pattern) + 2)) AS p FROM detections JOIN dict ON contains(message_text, pattern)) SELECT id, pattern, CAST(p - 1 AS INTEGER) AS start_index, CAST(p + length(pattern) - 2 AS INTEGER) AS end_index FROM m WHERE substr(t, p, length(pattern)) = pattern")
def _(spark, d):
    return mt.baseline(logged(spark, d).select("id", "text"), engine(spark, d)).select("id", F.explode("matches").alias("m")).select("id", "m.pattern", "m.start_index", "m.end_index")


@query("mat_near_two_errors")
def _(spark, d):
    """Near matches with up to two substitutions."""
    return mt.with_hits(logged(spark, d).select("id", "text"), engine(spark, d, max_errors=2)).select("id", F.explode("hits").alias("h")).where("h.layer = 'fuzzy'").select("id", "h.idx", "h.errors", "h.last")


@query("mat_lookalike", f"WITH {o.DICT}, lk AS (SELECT url AS id, url, 1 AS ord FROM resolutions WHERE url IS NOT NULL UNION ALL SELECT 'x' || idx, 'https://' || lower(trim(pattern)) || '-secure.test/x', 1 FROM pattern_file), {o.parts('lk')}, {o.classes('lp')} SELECT url, root, coalesce(struct = 'lookalike', false) AS lookalike FROM lc")
def _(spark, d):
    cfg = engine(spark, d)
    made = table(spark, d, "pattern_file").select(F.concat(F.lit("https://"), F.lower(F.trim("pattern")), F.lit("-secure.test/x")).alias("url"))
    u = table(spark, d, "resolutions").select("url").unionByName(made).select("url", ux.root(ux.parts(F.col("url"))).alias("root"))
    return u.select("url", "root", ux.lookalike(F.col("root"), cfg).alias("lookalike"))


# --- scores -----------------------------------------------------------------


@query("sco_detections", o.ENGINE + "SELECT id, match_type, pattern, matched_text, root, CAST(error_count AS INTEGER) AS error_count, risk_score, url_segment, is_whitelisted FROM det WHERE match_type IN ('exact','fuzzy','affix')")
def _(spark, d):
    x = assessed(spark, d).select("id", F.explode("detections").alias("x")).select("id", "x.*")
    return x.where(F.col("match_type").isin("exact", "fuzzy", "affix")).select("id", "match_type", "pattern", "matched_text", "root", "error_count", "risk_score", "url_segment", "is_whitelisted")


@query("sco_proximity", o.ENGINE + "SELECT id, j, layer, CAST(pos AS BIGINT) AS p, round(delta, 3) AS delta FROM delta")
def _(spark, d):
    cfg = engine(spark, d)
    h = mt.with_hits(logged(spark, d).select("id", "text"), cfg).select("id", "text", "terms", F.explode("hits").alias("h"))
    return h.select("id", F.col("h.idx").cast("long").alias("j"), "h.layer", F.col("h.at").cast("long").alias("p"), F.round(aa.proximity(F.col("text"), F.col("terms"), F.col("h.at"), cfg.window), 3).alias("delta"))


@query("ano_scores", o.ENGINE + "SELECT id, score, signals FROM anom")
def _(spark, d):
    return logged(spark, d).select("id", tx.anomaly(F.col("text")).alias("a")).select("id", "a.score", "a.signals")


@query("ano_fallback", o.ENGINE + "SELECT id, risk_score, signals FROM det WHERE match_type = 'anomaly'")
def _(spark, d):
    x = assessed(spark, d).select("id", F.explode("detections").alias("x")).select("id", "x.*")
    return x.where("match_type = 'anomaly'").select("id", "risk_score", "signals")


# --- links ------------------------------------------------------------------

_LINKS = f"WITH {o.DICT}, {o.MSG}, {o.links('clean', 'id', 'text')}"


@query("url_extract", f"SELECT id, len(regexp_extract_all({o.ASCIIED.format("coalesce(message_text, '')")}, '{o.URL}', 0, 'i'))::INTEGER AS n_urls FROM detections")
def _(spark, d):
    return logged(spark, d).select("id", F.size(tx.urls(F.col("text"))).alias("n_urls"))


_RES = "lk AS (SELECT url AS id, url, 1 AS ord FROM resolutions WHERE url IS NOT NULL UNION ALL SELECT destination, destination, 1 FROM resolutions WHERE destination IS NOT NULL)"


def _all_links(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resolutions")
    return r.where("url IS NOT NULL").select("url").unionByName(r.where("destination IS NOT NULL").select(F.col("destination").alias("url")))


@query("url_parts", f"WITH {_RES}, {o.parts('lk')} SELECT url, subdomains, sld, tld, path, query, root, host FROM lp")
def _(spark, d):
    return _all_links(spark, d).select("url", ux.parts(F.col("url")).alias("p")).select("url", "p.*", ux.root(F.col("p")).alias("root"), ux.host(F.col("p")).alias("host"))


@query("url_class", f"WITH {o.DICT}, {_RES}, {o.parts('lk')}, {o.classes('lp')} SELECT url, short, white, struct FROM lc")
def _(spark, d):
    cfg = engine(spark, d)
    u = _all_links(spark, d).select("url", ux.parts(F.col("url")).alias("p"))
    return u.select("url", ux.is_shortener(F.col("p"), cfg).alias("short"), ux.is_legitimate(F.col("p"), cfg).alias("white"), ux.structure(F.col("p"), cfg).alias("struct"))


@query("url_worst", _LINKS + " SELECT c.id, coalesce(w.multiplier, 1.0) AS multiplier, coalesce(w.segment, 'none') AS segment, coalesce(w.white, false) AS is_whitelisted FROM clean c LEFT JOIN worst w USING (id)")
def _(spark, d):
    return aa.with_url_info(logged(spark, d).select("id", "text"), engine(spark, d)).select("id", "url_info.multiplier", "url_info.segment", "url_info.is_whitelisted")


@query("url_resolved", f"WITH {o.DICT}, r AS (SELECT url, min(destination) AS destination FROM resolutions WHERE url IS NOT NULL GROUP BY url), lk AS (SELECT url AS id, destination AS url, 1 AS ord FROM r WHERE destination IS NOT NULL), {o.parts('lk')}, {o.classes('lp')} SELECT r.url, CASE WHEN r.destination IS NULL OR r.destination = r.url OR lc.short THEN 'shortener' WHEN lc.white THEN 'sld' WHEN lc.struct IN ('subdomain','path','query','lookalike') THEN lc.struct ELSE 'none' END AS segment, CASE WHEN r.destination IS NULL OR r.destination = r.url OR lc.short THEN r.url ELSE r.destination END AS expanded_url, coalesce(r.destination <> r.url AND NOT lc.short AND NOT lc.white AND lc.struct IN ('subdomain','path','query','lookalike'), false) AS destination_risky FROM r LEFT JOIN lc ON lc.id = r.url")
def _(spark, d):
    r = table(spark, d, "resolutions")
    asked = r.where("url IS NOT NULL").select(F.col("url").alias("id"), F.col("url").alias("text")).distinct()
    x = aa.with_url_info(asked, engine(spark, d), r)
    return x.select(F.col("id").alias("url"), "url_info.segment", "url_info.expanded_url", "url_info.destination_risky")


@query("url_unwrap", "SELECT * FROM (VALUES (1, 'https://phishing.example/login'), (2, 'http://b.example/'), (3, 'https://other.example/?u=https://x.example'), (4, 'https://viglink.com/?x=1'), (5, 'https://end.example/a')) t(id, url)")
def _(spark, d):
    rows = [
        (1, "https://redirect.viglink.com/?format=go&u=https%3A%2F%2Fphishing.example%2Flogin"),
        (2, "https://viglink.com/?url=http%3A%2F%2Fb.example%2F&target=https://c.example"),
        (3, "https://other.example/?u=https://x.example"),
        (4, "https://viglink.com/?x=1"),
        (5, "https://viglink.com/?u=https%3A%2F%2Fviglink.com%2F%3Fu%3Dhttps%253A%252F%252Fend.example%252Fa"),
    ]
    return spark.createDataFrame(rows, "id INT, u STRING").select("id", ux.unwrapped(F.col("u")).alias("url"))


@query("url_table", f"WITH {o.DICT}, r AS (SELECT url, min(destination) AS destination FROM resolutions WHERE url IS NOT NULL GROUP BY url), lk AS (SELECT url AS id, destination AS url, 1 AS ord FROM r WHERE destination IS NOT NULL), {o.parts('lk')}, {o.classes('lp')} SELECT url, CASE WHEN unknown THEN '(could not be resolved)' ELSE destination END AS destination, CASE WHEN unknown THEN 2.5 WHEN white THEN 1.0 WHEN struct IN ('subdomain','lookalike') THEN 2.0 WHEN struct IN ('path','query') THEN 1.5 ELSE 1.0 END::DOUBLE AS multiplier FROM (SELECT r.url, r.destination, r.destination IS NULL OR r.destination = r.url OR lc.short AS unknown, lc.white, lc.struct FROM r LEFT JOIN lc ON lc.id = r.url)")
def _(spark, d):
    """Each shortened link with the destination it resolves to and its multiplier; ``url_report`` counts the classes."""
    r = table(spark, d, "resolutions")
    asked = r.where("url IS NOT NULL").select(F.col("url").alias("id"), F.col("url").alias("text")).distinct()
    info = aa.with_url_info(asked, engine(spark, d), r).select("id", "url_info.*")
    where = F.when(F.col("unmasked_root").isNotNull(), F.col("expanded_url")).otherwise("(could not be resolved)")
    return info.select(F.col("id").alias("url"), where.alias("destination"), "multiplier")


@query("url_valid_destination", r"SELECT destination, NOT regexp_matches(destination, '[\s\p{Z}]') AND regexp_full_match(destination, '(?i)https?://(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}(?::[0-9]+)?(?:[/?#].*)?') AS valid FROM resolutions WHERE destination IS NOT NULL")
def _(spark, d):
    return table(spark, d, "resolutions").where("destination IS NOT NULL").select("destination", ux.valid_destination(F.col("destination")).alias("valid"))


@query("url_report", f"WITH {o.DICT}, r AS (SELECT url, min(destination) AS destination FROM resolutions WHERE url IS NOT NULL GROUP BY url), lk AS (SELECT url AS id, destination AS url, 1 AS ord FROM r WHERE destination IS NOT NULL), {o.parts('lk')}, {o.classes('lp')}, k AS (SELECT CASE WHEN r.destination IS NULL OR r.destination = r.url OR lc.short THEN 'Unresolved shortened link' WHEN lc.white THEN 'Official (whitelisted)' WHEN lc.struct = 'subdomain' THEN 'Brand in subdomain' WHEN lc.struct = 'path' THEN 'Keyword in path' WHEN lc.struct = 'query' THEN 'Keyword in query' WHEN lc.struct = 'lookalike' THEN 'Lookalike domain' ELSE 'No risk signal' END AS class FROM r LEFT JOIN lc ON lc.id = r.url) SELECT class, count(*) AS n FROM k GROUP BY class")
def _(spark, d):
    r = table(spark, d, "resolutions")
    asked = r.where("url IS NOT NULL").select(F.col("url").alias("id"), F.col("url").alias("text")).distinct()
    info = aa.with_url_info(asked, engine(spark, d), r).select("url_info.*")
    # The names of the classes.
    names = {"shortener": "Unresolved shortened link", "lookalike": "Lookalike domain", "subdomain": "Brand in subdomain", "path": "Keyword in path", "query": "Keyword in query", "sld": "Brand owns the domain", "none": "No risk signal"}
    told = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("segment"))
    return info.select(F.when(F.col("is_whitelisted"), "Official (whitelisted)").otherwise(told).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


# --- messages ---------------------------------------------------------------

_MODE = "CASE WHEN tier <= 1 THEN 'silent' WHEN tier = 2 THEN CASE WHEN evidence_count >= 2 THEN 'collapsed' ELSE 'silent' END WHEN gs = ['url_risk'] THEN 'collapsed' WHEN evidence_count >= 2 THEN 'banner' ELSE 'silent' END"


@query("msg_assessments", o.ENGINE + "SELECT id, global_risk, severity, CAST(tier AS INTEGER) AS action_tier, gs AS evidence_groups, CAST(evidence_count AS INTEGER) AS evidence_count, true AS gate_passed, is_clean FROM assess")
def _(spark, d):
    return assessed(spark, d).select("id", "global_risk", "severity", "action_tier", "evidence_groups", "evidence_count", "gate_passed", "is_clean")


@query("msg_gate_sweep", o.ENGINE + "SELECT CAST(k AS INTEGER) AS min_evidence, CAST(t AS INTEGER) AS action_tier, count(*) AS n FROM (SELECT k, CASE WHEN tier >= 2 AND NOT (k <= 0 OR (global_risk >= 1.142 AND evidence_count >= k)) THEN 1 ELSE tier END AS t FROM assess, unnest(range(0, 5)) AS x(k)) GROUP BY ALL")
def _(spark, d):
    a = assessed(spark, d).select("global_risk", "raw_severity", "raw_action_tier", "evidence_count")
    # one scan for all settings: rows that are alike count together before they are spread
    alike = a.groupBy("global_risk", "raw_severity", "raw_action_tier", "evidence_count").agg(F.count("*").alias("m"))
    spread = alike.withColumn("min_evidence", F.explode(F.array(*map(F.lit, range(5)))))
    return aa.gate(spread, F.lit(1.142), F.col("min_evidence")).groupBy("min_evidence", "action_tier").agg(F.sum("m").alias("n"))


@query("msg_display_modes", o.ENGINE + f"SELECT id, {_MODE} AS mode FROM assess")
def _(spark, d):
    return assessed(spark, d).select("id", aa.display_mode(F.col("action_tier"), F.col("evidence_groups")).alias("mode"))


@query("msg_reasons", o.ENGINE + "SELECT id, CASE WHEN len(gs) = 0 THEN 'contains wording often used in phishing' ELSE array_to_string(list_transform(gs, lambda g: CASE g WHEN 'brand_entity' THEN 'Financial or brand mention' WHEN 'credential_payment' THEN 'Account or credential prompt' WHEN 'action_request' THEN 'Action requested' WHEN 'urgency_threat' THEN 'Urgent or threatening language' WHEN 'url_risk' THEN 'Suspicious link detected' ELSE 'Obfuscated / disguised keywords' END), ', ') END AS reasons FROM assess")
def _(spark, d):
    return assessed(spark, d).select("id", aa.reason_text(F.col("evidence_groups")).alias("reasons"))


@query("msg_scan_response", o.ENGINE + "SELECT a.id, CAST(tier AS INTEGER) AS tier, severity, coalesce(t.tokens, []) AS tokens, global_risk AS risk_score, gs AS evidence_groups FROM assess a LEFT JOIN (SELECT id, list(DISTINCT matched_text ORDER BY matched_text) AS tokens FROM det GROUP BY id) t USING (id)")
def _(spark, d):
    a = assessed(spark, d)
    # the response's order of tokens is that of the detections; sorted here for the comparison
    return a.select("id", F.col("action_tier").alias("tier"), "severity", F.array_sort(aa.scan_tokens(F.col("detections"))).alias("tokens"), F.col("global_risk").alias("risk_score"), "evidence_groups")


@query("msg_row_status", o.ENGINE + "SELECT a.id, CASE WHEN coalesce(s.threat, 0) > 0 THEN 'THREAT' WHEN coalesce(s.review, 0) > 0 THEN 'REVIEW' ELSE 'CLEAR' END AS status, coalesce(s.hidden, 0) AS hidden FROM assess a LEFT JOIN (SELECT id, count(*) FILTER (match_type <> 'anomaly' AND risk_score >= 1.5) AS threat, count(*) FILTER (match_type = 'anomaly') AS review, count(*) FILTER (match_type <> 'anomaly' AND risk_score < 1.5) AS hidden FROM det GROUP BY id) s USING (id)")
def _(spark, d):
    x = F.col("detections")
    visible = F.filter(x, lambda t: (t["match_type"] == "anomaly") | (t["risk_score"] >= 1.5))
    status = F.when(F.exists(visible, lambda t: t["match_type"] != "anomaly"), "THREAT").when(F.size(visible) > 0, "REVIEW").otherwise("CLEAR")
    return assessed(spark, d).select("id", status.alias("status"), (F.size(x) - F.size(visible)).cast("long").alias("hidden"))


@query("msg_log_rows", o.ENGINE + "SELECT id, CAST(tier AS INTEGER) AS action_tier, coalesce(n, 0) AS n_detections FROM assess LEFT JOIN (SELECT id, count(*) AS n FROM det GROUP BY id) USING (id)")
def _(spark, d):
    """The rows a detection log would get, read back from their JSON."""
    a = aa.assess(logged(spark, d), engine(spark, d))
    rows = a.select("id", "action_tier", F.to_json("detections").alias("j"))
    return rows.select("id", "action_tier", F.size(F.from_json("j", "ARRAY<STRUCT<alert: STRING>>")).cast("long").alias("n_detections"))


_SUMMARY = "SELECT a.id, coalesce(s.summary, 'suspicious content') AS summary FROM assess a LEFT JOIN (SELECT id, array_to_string(list(pattern ORDER BY k), ', ') AS summary FROM (SELECT id, pattern, min((CASE match_type WHEN 'exact' THEN 0 WHEN 'fuzzy' THEN 1 ELSE 2 END, CASE match_type WHEN 'exact' THEN first + length(matched_text) WHEN 'fuzzy' THEN j ELSE first END, CASE match_type WHEN 'fuzzy' THEN first + length(matched_text) ELSE j END)) AS k FROM det JOIN dict USING (pattern) WHERE match_type IN ('exact','fuzzy','affix') GROUP BY id, pattern) GROUP BY id) s USING (id)"


def _reply(template: str) -> str:
    before, after = template.replace("'", "''").split("{}")
    return f"'{before}' || summary || '{after}'"


@query("msg_replies", o.ENGINE + f"SELECT id, tier = 3 AS with_keyboard, CASE WHEN tier = 3 THEN {_reply(lp.TIER_3)} ELSE {_reply(lp.TIER_2)} END AS reply FROM assess JOIN ({_SUMMARY}) USING (id) WHERE tier >= 2")
def _(spark, d):
    """Replies by tier; nothing is said to tiers 0 and 1."""
    return lp.replies(assessed(spark, d)).where("reply IS NOT NULL").select("id", "with_keyboard", "reply")


@query("msg_batch_table", o.ENGINE + "SELECT a.id AS row, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS message, CAST(coalesce(n, 0) AS INTEGER) AS signals_found, coalesce(most, 0.0::DOUBLE) AS max_risk_score, CASE WHEN coalesce(s.threat, 0) > 0 THEN 'THREAT' WHEN coalesce(n, 0) > 0 THEN 'REVIEW' ELSE 'CLEAR' END AS status FROM assess a LEFT JOIN (SELECT id, count(*) AS n, max(risk_score) AS most, count(*) FILTER (match_type <> 'anomaly') AS threat FROM det WHERE match_type = 'anomaly' OR risk_score >= 1.5 GROUP BY id) s USING (id)")
def _(spark, d):
    """The lines of a batch scan's result; ``sinks.write_csv`` writes them."""
    return sinks.batch_table(assessed(spark, d))


@query("msg_scan_export", o.ENGINE + "SELECT id, risk_score, CASE match_type WHEN 'exact' THEN 'CRITICAL: ''' || pattern || ''' detected!' WHEN 'fuzzy' THEN 'CRITICAL: ''' || pattern || ''' detected! (fuzzy match, ' || errors || ' error(s))' WHEN 'affix' THEN 'CRITICAL: ''' || pattern || ''' detected! (affix match: ''' || matched_text || ''' -> root ''' || root || ''')' WHEN 'anomaly' THEN 'SUSPICIOUS: no known pattern matched, but the message contains phishing-like signals.' ELSE 'CRITICAL: Unverified shortened URL detected!' END AS alert FROM (SELECT *, CAST(error_count AS INTEGER) AS errors FROM det)")
def _(spark, d):
    """Every detection with its score and alert; its context is tested by ``str_context``."""
    return sinks.scan_export(assessed(spark, d)).select("id", "risk_score", "alert")


@query("msg_pipeline", o.ENGINE + "SELECT a.id, CAST(tier AS INTEGER) AS tier, coalesce(p.patterns, []) AS detected_patterns, global_risk AS max_risk FROM assess a LEFT JOIN (SELECT id, list(DISTINCT pattern ORDER BY pattern) AS patterns FROM det GROUP BY id) p USING (id)")
def _(spark, d):
    """What an adapter hands to another pipeline; the patterns are sorted for the comparison."""
    patterns = F.array_sort(F.array_distinct(F.transform("detections", lambda x: x["pattern"])))
    return assessed(spark, d).select("id", F.col("action_tier").alias("tier"), patterns.alias("detected_patterns"), F.col("global_risk").alias("max_risk"))


@query("msg_assessments_resolved")
def _(spark, d):
    """Assessments with shortened links looked up; no SQL, the rules of the lookup are tested on fixtures."""
    a = aa.assess(logged(spark, d).select("id", "text"), engine(spark, d), table(spark, d, "resolutions"))
    return a.select("id", "global_risk", "action_tier", "evidence_groups", "url_info.segment", "url_info.expanded_url", "url_info.destination_risky")


#: Messages with a stated label, four of each.
SAMPLES = (
    ("Urgent: verify your account now.", True),
    ("Please click here to confirm your password reset.", True),
    ("Your G-C@sh account is blocked, update payment details immediately.", True),
    ("Claim your prize now and send the code to restore access.", True),
    ("Team meeting moved to 3 PM tomorrow.", False),
    ("Here is the project status update and weekly schedule.", False),
    ("Official customer support hotline and service hours.", False),
    ("Please review the receipt and invoice for the office order.", False),
)


@query("msg_validation_suite")
def _(spark, d):
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(SAMPLES)], "id INT, text STRING, is_positive BOOLEAN")
    return ev.confusion(aa.assess(rows), ~F.col("is_clean"), F.col("is_positive"))


@query("msg_baseline", f"WITH {o.DICT} SELECT id, CASE WHEN len(list_filter((SELECT list(pattern) FROM dict), lambda p: contains(coalesce(message_text, ''), p))) > 0 THEN 2 ELSE 0 END AS action_tier FROM detections")
def _(spark, d):
    return mt.baseline(logged(spark, d).select("id", "text"), engine(spark, d)).select("id", F.when(F.size("matches") > 0, 2).otherwise(0).alias("action_tier"))


# --- evaluation -------------------------------------------------------------

_RATES = "tp, fp, tn, fn, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END AS fpr"


def _counts(pred: str, y: str = "y") -> str:
    return f"count(*) FILTER ({pred} AND {y}) AS tp, count(*) FILTER ({pred} AND NOT {y}) AS fp, count(*) FILTER (NOT {pred} AND NOT {y}) AS tn, count(*) FILTER (NOT {pred} AND {y}) AS fn"


def _rated(sql: str, *by: str) -> str:
    r = ", ".join(f"round({x}, 6) AS {x}" for x in ("accuracy", "precision", "recall", "f1", "fpr"))
    return f"SELECT {''.join(b + ', ' for b in by)}tp, fp, tn, fn, {r} FROM (SELECT {''.join(b + ', ' for b in by)}{_RATES} FROM ({sql}))"


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "tp", "fp", "tn", "fn", *[F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall", "f1", "fpr")])


@query("ev_confusion", o.LABELLED + _rated(f"SELECT {_counts('NOT is_clean')} FROM lab"))
def _(spark, d):
    return rounded(ev.confusion(judged(spark, d), ~F.col("is_clean"), F.col("is_positive")))


@query("ev_confusion_by_source", o.LABELLED + _rated(f"SELECT source, {_counts('NOT is_clean')} FROM (SELECT lab.*, l.source FROM lab JOIN labelled_csv l ON l.row_id = lab.id) GROUP BY source", "source"))
def _(spark, d):
    return rounded(ev.confusion(judged(spark, d), ~F.col("is_clean"), F.col("is_positive"), "source"), "source")


_BASE = f"base AS (SELECT row_id AS id, len(list_filter((SELECT list(pattern) FROM dict), lambda p: contains(coalesce(text, ''), p))) > 0 AS hit, lower(trim(coalesce(label, ''))) = '1' AS y FROM labelled_csv)"


def engine_delta(spark: SparkSession, d: str) -> DataFrame:
    """Both engines in one pass over the messages: the baseline's matches are carried as a column."""
    cfg = engine(spark, d)
    both = mt.baseline(aa.assess(labelled(spark, d), cfg).select("id", "text", "is_positive", "is_clean"), cfg)
    old = rounded(ev.confusion(both, F.size("matches") > 0, F.col("is_positive")))
    new = rounded(ev.confusion(both, ~F.col("is_clean"), F.col("is_positive")))
    names = ("accuracy", "precision", "recall", "f1", "fpr")
    joined = new.select(*[F.col(x).alias(f"n_{x}") for x in names]).crossJoin(F.broadcast(old.select(*[F.col(x).alias(f"o_{x}") for x in names])))  # one row each
    return joined.select(*[F.round(F.col(f"n_{x}") - F.col(f"o_{x}"), 5).alias(x) for x in names])


query("ev_engine_delta", o.LABELLED.rstrip() + f", {_BASE}, n AS ({_rated(f"SELECT {_counts('NOT is_clean')} FROM lab")}), b AS ({_rated(f"SELECT {_counts('hit')} FROM base")}) SELECT " + ", ".join(f"round(n.{x} - b.{x}, 5) AS {x}" for x in ("accuracy", "precision", "recall", "f1", "fpr")) + " FROM n, b")(engine_delta)

_TAUS = (0.45, 0.55, 0.65, 0.75, 0.85)


def tau_sweep(spark: SparkSession, d: str) -> DataFrame:
    a = judged(spark, d).withColumn("linked", F.exists("detections", lambda x: x["match_type"] == "url_shortener"))
    hit = lambda tau: (F.col("n_layer_hits") > 0) | F.col("linked") | (F.col("anomaly.score") >= tau)
    return rounded(ev.sweep(a, list(_TAUS), "tau", hit, F.col("is_positive")), "tau")


_SWEEP = _rated(f"SELECT tau, {_counts('hit')} FROM (SELECT t.tau::DOUBLE AS tau, y, lab.id IN (SELECT id FROM det WHERE match_type <> 'anomaly') OR a.score >= t.tau AS hit FROM lab JOIN anom a USING (id), (VALUES (0.45), (0.55), (0.65), (0.75), (0.85)) t(tau)) GROUP BY tau", "tau")
query("ev_tau_sweep", o.LABELLED + _SWEEP)(tau_sweep)
query("ev_best_tau_within", o.LABELLED + f"SELECT * FROM ({_SWEEP}) ORDER BY fpr <= 0.5 DESC, recall DESC, tau LIMIT 1")(lambda spark, d: ev.best_threshold(tau_sweep(spark, d), "tau", 0.5))
query("ev_best_tau", o.LABELLED + f"SELECT * FROM ({_SWEEP}) ORDER BY f1 DESC, tau LIMIT 1")(lambda spark, d: ev.best_threshold(tau_sweep(spark, d), "tau"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).where(~F.col("is_clean")).select("id", F.col("global_risk").alias("score"), "is_positive")


_SCORES = "sc AS (SELECT id, global_risk AS score, y FROM lab WHERE NOT is_clean), above AS (SELECT DISTINCT score, avg(y::INTEGER) OVER (ORDER BY score DESC) AS precision, count(*) OVER (ORDER BY score DESC) AS support FROM sc)"
query("ev_scores", o.LABELLED + "SELECT id, global_risk AS score, y AS is_positive FROM lab WHERE NOT is_clean")(_scores)


@query("ev_precision_above", o.LABELLED.rstrip() + f", {_SCORES} SELECT score, round(precision, 6) AS precision, support FROM above")
def _(spark, d):
    return ev.precision_above(_scores(spark, d)).select("score", F.round("precision", 6).alias("precision"), "support")


@query("ev_cutoffs", o.LABELLED.rstrip() + f", {_SCORES} SELECT target::DOUBLE AS target, min(score) FILTER (precision >= target AND support >= 20) AS cutoff FROM above, (VALUES (0.25), (0.3), (0.5), (0.75), (0.9)) t(target) GROUP BY target")
def _(spark, d):
    return ev.cutoffs(ev.precision_above(_scores(spark, d)), (0.25, 0.3, 0.5, 0.75, 0.9))


@query("ev_cutoffs_confirmed", o.LABELLED.rstrip() + ", s2 AS (SELECT lab.id, global_risk AS score, y, split_name FROM lab JOIN labelled_csv l ON l.row_id = lab.id WHERE NOT is_clean), above AS (SELECT DISTINCT score, avg(y::INTEGER) OVER (ORDER BY score DESC) AS precision, count(*) OVER (ORDER BY score DESC) AS support FROM s2 WHERE split_name = 'train'), cuts AS (SELECT target::DOUBLE AS target, min(score) FILTER (precision >= target AND support >= 20) AS cutoff FROM above, (VALUES (0.25), (0.3), (0.5)) t(target) GROUP BY target) SELECT target, count(*) AS support, round(avg(y::INTEGER), 6) AS precision FROM cuts JOIN s2 ON split_name = 'test' AND score >= cutoff GROUP BY target")
def _(spark, d):
    s = judged(spark, d).where(~F.col("is_clean")).select(F.col("global_risk").alias("score"), "is_positive", "split_name")
    cuts = ev.cutoffs(ev.precision_above(s.where("split_name = 'train'")), (0.25, 0.3, 0.5))
    held = s.where("split_name = 'test'").groupBy("score").agg(F.count("*").alias("n"), F.count_if("is_positive").alias("p"))  # by score, so bounded
    return held.join(F.broadcast(cuts), F.col("score") >= F.col("cutoff")).groupBy("target").agg(F.sum("n").alias("support"), F.round(F.sum("p") / F.sum("n"), 6).alias("precision"))


def _by_label(what: str) -> str:
    return f"SELECT {what}, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, round(100.0 * count(*) FILTER (y) / sum(count(*) FILTER (y)) OVER (), 2)::DOUBLE AS positive_share, round(100.0 * count(*) FILTER (NOT y) / sum(count(*) FILTER (NOT y)) OVER (), 2)::DOUBLE AS negative_share FROM lab GROUP BY 1"


@query("ev_tiers_by_label", o.LABELLED + _by_label("CAST(tier AS INTEGER) AS action_tier"))
def _(spark, d):
    return ev.counts_by_label(judged(spark, d), "action_tier")


@query("ev_modes_by_label", o.LABELLED + _by_label("shown"))
def _(spark, d):
    return ev.counts_by_label(judged(spark, d), "shown")


@query("ev_top_evidence", o.LABELLED + "SELECT action_tier, combo, total, positives FROM (SELECT CAST(tier AS INTEGER) AS action_tier, array_to_string(gs, ' + ') AS combo, count(*) AS total, count(*) FILTER (y) AS positives, row_number() OVER (PARTITION BY tier ORDER BY count(*) DESC, array_to_string(gs, ' + ')) AS n FROM lab WHERE tier >= 2 GROUP BY tier, gs) WHERE n <= 15")
def _(spark, d):
    return ev.top_combinations(judged(spark, d))


@query("ev_display_rules", o.LABELLED + _rated(f"SELECT rule, {_counts('hit')} FROM (SELECT y, 'any' AS rule, shown <> 'silent' AS hit FROM lab UNION ALL SELECT y, 'banner', shown = 'banner' FROM lab) GROUP BY rule", "rule"))
def _(spark, d):
    both = judged(spark, d).select("is_positive", "shown").withColumn("rule", F.explode(F.array(F.lit("any"), F.lit("banner"))))
    hit = F.when(F.col("rule") == "any", F.col("shown") != "silent").otherwise(F.col("shown") == "banner")
    return rounded(ev.confusion(both, hit, F.col("is_positive"), "rule"), "rule")


@query("ev_batch_summary", o.ENGINE + "SELECT count(*) AS messages, count(*) FILTER (tier >= 2) AS threats, count(*) FILTER (tier = 1) AS reviews, count(*) FILTER (tier = 0) AS clear, round(100.0 * count(*) FILTER (tier >= 2) / count(*), 2)::DOUBLE AS threat_rate FROM assess")
def _(spark, d):
    n = lambda x, name: F.count_if(x).alias(name)
    t = F.col("action_tier")
    return assessed(spark, d).agg(F.count("*").alias("messages"), n(t >= 2, "threats"), n(t == 1, "reviews"), n(t == 0, "clear"), F.round(100 * F.count_if(t >= 2) / F.count("*"), 2).alias("threat_rate"))


@query("ev_false_positive_examples", o.LABELLED + "SELECT id, tier FROM (SELECT id, CAST(tier AS INTEGER) AS tier FROM lab WHERE shown = 'banner' AND NOT y ORDER BY id LIMIT 20)")
def _(spark, d):
    """A report of the first examples: the limit is the feature."""
    return judged(spark, d).where((F.col("shown") == "banner") & ~F.col("is_positive")).orderBy("id").limit(20).select("id", F.col("action_tier").alias("tier"))


@query("ev_session_totals", "SELECT chat_id, count(*) AS message_count, min(ts) AS started, max(ts) AS updated FROM detections WHERE chat_id IS NOT NULL GROUP BY chat_id")
def _(spark, d):
    t = table(spark, d, "detections").where("chat_id IS NOT NULL")
    return t.groupBy("chat_id").agg(F.count("*").alias("message_count"), F.min("ts").alias("started"), F.max("ts").alias("updated"))


# --- splits and samples -----------------------------------------------------

_KEY = rf"lower({o.STRIP.format(r"regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')")})"


@query("spl_leak_free", f"WITH r AS (SELECT row_id, md5({_KEY} || '42') AS k, lower(trim(coalesce(label, ''))) = '1' AS y FROM labelled_csv), g AS (SELECT k, count(*) AS n, count(*) FILTER (y) * 2 >= count(*) AS stratum FROM r GROUP BY k), t AS (SELECT k, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < round(sum(n) OVER (PARTITION BY stratum) * 0.2) AS is_validation FROM g) SELECT row_id, is_validation FROM r JOIN t USING (k)")
def _(spark, d):
    return ev.leak_free_split(ms.labelled(table(spark, d, "labelled_csv")), tx.split_key(F.col("text")), F.col("is_positive"))


@query("spl_three_way", "WITH r AS (SELECT row_id, lower(trim(coalesce(label, ''))) = '1' AS is_positive, md5(CAST(row_id AS VARCHAR) || '42') AS h FROM labelled_csv), n AS (SELECT *, row_number() OVER (PARTITION BY is_positive ORDER BY h, row_id) AS k, count(*) OVER (PARTITION BY is_positive) AS m FROM r) SELECT row_id, is_positive, CASE WHEN k <= floor(m * 0.6) THEN 'train' WHEN k <= floor(m * 0.6) + floor(m * 0.2) THEN 'validation' ELSE 'test' END AS part FROM n")
def _(spark, d):
    x = ms.labelled(table(spark, d, "labelled_csv"))
    return ev.three_way_split(x, F.col("is_positive"))


@query("spl_fixed_sample", "SELECT row_id FROM (SELECT row_id FROM labelled_csv ORDER BY md5(CAST(row_id AS VARCHAR) || '42'), row_id LIMIT 2000)")
def _(spark, d):
    """A sampling operator: the fixed size is the feature."""
    return ev.fixed_sample(table(spark, d, "labelled_csv").select("row_id"), 2000)


# --- sorting, sets, windows -------------------------------------------------


@query("srt_log_by_chat", "SELECT id, ts FROM (SELECT id, ts FROM detections WHERE chat_id = 'grp-4448106-1' ORDER BY ts DESC, id DESC LIMIT 50)")
def _(spark, d):
    t = table(spark, d, "detections").where("chat_id = 'grp-4448106-1'")
    return t.orderBy(F.desc("ts"), F.desc("id")).limit(50).select("id", "ts")


@query("srt_flagged_log", "SELECT id, ts, action_tier FROM (SELECT id, ts, action_tier FROM detections WHERE action_tier >= 2 ORDER BY ts DESC, id DESC LIMIT 200)")
def _(spark, d):
    return table(spark, d, "detections").where("action_tier >= 2").orderBy(F.desc("ts"), F.desc("id")).limit(200).select("id", "ts", "action_tier")


@query("set_evidence_union", o.ENGINE + "SELECT DISTINCT unnest(gs) AS evidence_group FROM assess")
def _(spark, d):
    return assessed(spark, d).select(F.explode("evidence_groups").alias("evidence_group")).distinct()


@query("set_split_overlap", f"SELECT k AS key FROM (SELECT DISTINCT {_KEY} AS k FROM labelled_csv WHERE split_name = 'train' INTERSECT SELECT DISTINCT {_KEY} FROM labelled_csv WHERE split_name IN ('test', 'validation'))")
def _(spark, d):
    t = table(spark, d, "labelled_csv")
    key = tx.split_key(F.coalesce(F.col("text"), F.lit(""))).alias("key")
    return t.where("split_name = 'train'").select(key).intersect(t.where("split_name IN ('test', 'validation')").select(key))


@query("set_pattern_difference", "SELECT DISTINCT lower(trim(pattern)) AS pattern FROM pattern_file WHERE lower(trim(pattern)) NOT IN (" + ",".join(f"'{p}'" for ps in c.DEFAULT_DICTIONARY.values() for p in ps) + ")")
def _(spark, d):
    known = spark.createDataFrame([(p,) for ps in c.DEFAULT_DICTIONARY.values() for p in ps], "pattern STRING")
    return table(spark, d, "pattern_file").select(F.lower(F.trim("pattern")).alias("pattern")).distinct().join(known, "pattern", "left_anti")


@query("set_class_concat", "SELECT row_id, true AS is_positive FROM labelled_csv WHERE lower(trim(label)) = '1' UNION ALL SELECT row_id, false FROM labelled_csv WHERE lower(trim(label)) = '0'")
def _(spark, d):
    label = F.lower(F.trim("label"))
    t = table(spark, d, "labelled_csv")
    return t.where(label == "1").select("row_id", F.lit(True).alias("is_positive")).unionByName(t.where(label == "0").select("row_id", F.lit(False).alias("is_positive")))


# --- conversations ----------------------------------------------------------

_ROLL = "SELECT id, CASE WHEN chat_id IS NULL OR ts IS NULL THEN 1 ELSE len(w) END::INTEGER AS window_messages, CASE WHEN chat_id IS NULL OR ts IS NULL THEN own ELSE list_max(list_transform(w, lambda x: x.t)) END::INTEGER AS window_max_tier, CASE WHEN chat_id IS NOT NULL AND ts IS NOT NULL AND len(list_filter(w, lambda x: x.t >= 2)) >= 2 THEN greatest(own, 3) ELSE own END::INTEGER AS raised FROM (SELECT id, chat_id, ts, coalesce(action_tier, 0) AS own, list_filter(list({'s': ts, 't': coalesce(action_tier, 0)}) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), lambda x: x.s >= ts - 900) AS w FROM detections)"


@query("stm_rolling_state", f"SELECT id, window_messages, window_max_tier FROM ({_ROLL})")
def _(spark, d):
    t = table(spark, d, "detections").select("id", "chat_id", "ts", "action_tier")
    return cv.rolling(t).select("id", "window_messages", "window_max_tier")


@query("stm_escalated_tier", f"SELECT id, raised FROM ({_ROLL})")
def _(spark, d):
    t = table(spark, d, "detections").select("id", "chat_id", "ts", "action_tier")
    return cv.rolling(t, escalate=True).select("id", F.col("rolling_tier").alias("raised"))


@query("stm_session_tier", "SELECT id, coalesce(action_tier, 0) AS session_tier FROM detections")
def _(spark, d):
    t = table(spark, d, "detections").select("id", "chat_id", "ts", "action_tier")
    return cv.rolling(t).select("id", F.col("rolling_tier").alias("session_tier"))


@query("stm_dual_engine", o.ENGINE.rstrip() + ", b AS (SELECT id, len(list_filter((SELECT list(pattern) FROM dict), lambda p: contains(text, p))) > 0 AS hit FROM clean) SELECT CASE WHEN b.hit THEN 2 ELSE 0 END AS baseline_tier, CAST(a.tier AS INTEGER) AS enhanced_tier, count(*) AS n FROM assess a JOIN b USING (id) GROUP BY ALL")
def _(spark, d):
    """Both engines over the same messages, as one plan with two columns."""
    cfg = engine(spark, d)
    both = mt.baseline(aa.assess(logged(spark, d).select("id", "text"), cfg).select("id", "text", F.col("action_tier").alias("enhanced_tier")), cfg)
    return both.groupBy(F.when(F.size("matches") > 0, 2).otherwise(0).alias("baseline_tier"), "enhanced_tier").agg(F.count("*").alias("n"))


@query("stm_reported_first", "SELECT chat_id, message_text, id FROM (SELECT chat_id, message_text, id, row_number() OVER (PARTITION BY chat_id, message_text ORDER BY ts, id) AS n FROM detections WHERE chat_id IS NOT NULL AND message_text IS NOT NULL) WHERE n = 1")
def _(spark, d):
    """The first message of a chat with a given text, as a user's report marks it."""
    t = table(spark, d, "detections").where("chat_id IS NOT NULL AND message_text IS NOT NULL")
    # an aggregate with partial results, so a hot chat is no one task's
    return t.groupBy("chat_id", "message_text").agg(F.min_by("id", F.struct("ts", "id")).alias("id"))


@query("stm_mode_in_force", f"SELECT event_id, last_value(CASE WHEN message.text = 'Oo nga eh' THEN 'baseline' WHEN message.text LIKE 'Ingat%' THEN 'enhanced' END IGNORE NULLS) OVER (ORDER BY received_at, event_id, chat ROWS UNBOUNDED PRECEDING) AS mode FROM (SELECT *, coalesce(chat_id, '') || '|' || coalesce(chat_hostname, '') AS chat FROM ({_EVENTS}))")
def _(spark, d):
    """A control stream (here two set phrases) read as of each event."""
    e = ms.once(table(spark, d, "webhook_event")).select("event_id", "received_at", F.concat(F.coalesce("chat_id", F.lit("")), F.lit("|"), F.coalesce("chat_hostname", F.lit(""))).alias("chat"), F.col("message.text").alias("text"))
    said = F.when(F.col("text") == "Oo nga eh", "baseline").when(F.col("text").startswith("Ingat"), "enhanced")
    return lp.mode_in_force(e, said, ("received_at", "event_id", "chat")).select("event_id", "mode")


_LOOP = o.ENGINE.replace("SELECT id, coalesce(message_text, '') AS text FROM detections", f"SELECT event_id AS id, coalesce(message.text, '') AS text FROM ({_EVENTS}) WHERE event = 'message' AND message.type = 'text'")


@query("stm_event_loop", _LOOP + "SELECT id AS event_id, CASE WHEN text = 'ACK_BLOCK' THEN 'ack' WHEN lower(trim(text)) LIKE '/mode%' THEN 'mode' ELSE 'scan' END AS kind, CASE WHEN text <> 'ACK_BLOCK' AND lower(trim(text)) NOT LIKE '/mode%' THEN CAST(tier AS INTEGER) END AS session_tier, tier = 3 AND text <> 'ACK_BLOCK' AND lower(trim(text)) NOT LIKE '/mode%' AS with_keyboard FROM assess")
def _(spark, d):
    """Events through filter, command, scan and reply; this data holds no command, so the enhanced engine is in force throughout."""
    return lp.loop(table(spark, d, "webhook_event"), engine(spark, d)).select("event_id", "kind", "session_tier", "with_keyboard")


@query("stm_cache_ttl", "SELECT url, coalesce(destination, url) AS destination, CASE WHEN destination IS NOT NULL AND destination <> url THEN 3600 ELSE 60 END AS ttl FROM (SELECT url, min(destination) AS destination FROM resolutions WHERE url IS NOT NULL GROUP BY url)")
def _(spark, d):
    """How long each resolution may be kept: an hour if it resolved, else a minute."""
    r = table(spark, d, "resolutions").where("url IS NOT NULL").groupBy("url").agg(F.min("destination").alias("destination"))
    ok = F.col("destination").isNotNull() & (F.col("destination") != F.col("url"))
    return r.select("url", F.coalesce("destination", "url").alias("destination"), F.when(ok, 3600).otherwise(60).alias("ttl"))

