"""All queries of the library's own operators, by name, with the SQL that must agree with them.

The input tables stand in for what the operators were made for; the operator is the subject. Inputs of
other forms (files, manifests, commands) are built from them in :mod:`tallyspark.plans.built`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import hashing, text, urls, variant
from tallyspark.operators import asof, discover, fingerprint, layout, ledger, match, posts, queue, reconcile, report
from tallyspark.plans import built, checks
from tallyspark.plans.tables import table
from tallyspark.streaming import queue as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_ANCHORS = r"""
h AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS base,
    regexp_extract_all(html, '(?s)<a[^>]+href="([^"#]+)"[^>]*>(.*?)</a>', 1) AS hrefs,
    regexp_extract_all(html, '(?s)<a[^>]+href="([^"#]+)"[^>]*>(.*?)</a>', 2) AS inners
  FROM pages),
e AS (SELECT page_id, base, i, hrefs[i] AS href, inners[i] AS inner_html FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM h)),
a AS (
  SELECT page_id, base, i, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE base || href END AS url,
    substr(trim(regexp_replace(regexp_replace(inner_html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), 1, 200) AS title
  FROM e)
"""


@_query("q01_page_links", f"WITH {_ANCHORS} SELECT url, arg_max(title, (length(title), -page_id, -i)) AS title FROM a GROUP BY url")
def page_links(spark, sf_dir):
    """Links of pages, each address with its longest title."""
    found = discover.anchors(table(spark, sf_dir, "pages"), "page_id")
    return found.groupBy("url").agg(F.max_by("title", F.struct(F.char_length("title"), -F.col("page_id"), -F.col("pos"))).alias("title"))


@_query(
    "q02_post_url_filter",
    rf"""WITH {_ANCHORS},
p AS (SELECT *, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM a WHERE regexp_extract(url, '^(https?://[^/?#]*)') = base)
SELECT url, arg_max(title, (length(title), -page_id, -i)) AS title FROM p
WHERE path <> '' AND NOT regexp_matches(path, '(?i)^/(link|links|about|archives|tags|categories|msg|board)$')
  AND NOT regexp_matches(path, '(?i)(tag|categor|author|page/\d|archive|search|about|contact|privacy|license|friends|links|guestbook|comment|feed|rss|atom|sitemap|\.css|\.js|\.png|\.jpg|\.jpeg|\.gif|\.svg|\.ico|\.woff)')
GROUP BY url""",
)
def post_links(spark, sf_dir):
    """Links that look like posts of the page's own site."""
    return discover.post_links(table(spark, sf_dir, "pages"))


@_query(
    "q03_turn_ledger_audit",
    """WITH r AS (SELECT conv_id, turn, unnest(CASE WHEN (conv_id + turn) % 11 = 2 THEN [1, 2] ELSE [1] END) AS copy FROM conversations WHERE (conv_id + turn) % 9 <> 4),
t AS (SELECT conv_id, turn, count(*) AS n FROM r GROUP BY conv_id, turn),
m AS (SELECT conv_id, max(turn) AS last, sum(n) AS records, count(*) AS there, count(*) FILTER (n > 1) AS repeated FROM t GROUP BY conv_id)
SELECT conv_id, CAST(records AS BIGINT) AS records, CAST(last + 1 - there AS BIGINT) AS missing, CAST(repeated AS BIGINT) AS repeated
FROM m WHERE last + 1 - there > 0 OR repeated > 0""",
)
def turn_ledger(spark, sf_dir):
    """Conversations whose turns, some of them lost or written twice, from 0 to the last are missing or repeated."""
    place = F.col("conv_id") + F.col("turn")
    twice = F.explode(F.when(place % 11 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return ledger.gaps(table(spark, sf_dir, "conversations").where(place % 9 != 4).select("conv_id", "turn", twice.alias("copy")), "conv_id", "turn")


@_query(
    "q04_key_coverage",
    """WITH e AS (SELECT DISTINCT o_orderkey AS k FROM orders), a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey),
b AS (SELECT e.k AS e, a.k AS a, n FROM e FULL OUTER JOIN a ON e.k = a.k)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS records, count(e) AS expected, count(*) FILTER (e IS NOT NULL AND a IS NOT NULL) AS covered,
  count(*) FILTER (a IS NULL) AS missing, count(*) FILTER (e IS NULL) AS extra, count(*) FILTER (n > 1) AS repeated FROM b""",
)
def key_coverage(spark, sf_dir):
    """Order keys against line items."""
    return reconcile.audit(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@_query("q04b_missing_keys", "SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_keys(spark, sf_dir):
    return reconcile.missing(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@_query(
    "q04c_covered_customers",
    "SELECT count(DISTINCT c_custkey) AS covered FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
)
def covered_customers(spark, sf_dir):
    both = reconcile.covered(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")
    return both.agg(F.count("*").alias("covered"))


@_query(
    "q05_reply_parent_check",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 17 = 5 THEN 'user' ELSE role END AS role FROM conversations WHERE (conv_id * 7 + turn) % 13 <> 6)
SELECT c.conv_id, c.turn, c.role FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
WHERE c.turn > 0 AND (p.conv_id IS NULL OR p.role = c.role)""",
)
def reply_parents(spark, sf_dir):
    """Turns whose previous turn is missing or of the same role, where some turns are lost and some roles wrong."""
    role = F.when((F.col("conv_id") + F.col("turn")) % 17 == 5, "user").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").where((F.col("conv_id") * 7 + F.col("turn")) % 13 != 6)
    rows = rows.select("conv_id", "turn", role.alias("role"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"))
    return queue.parent_failures(rows, ["conv_id"], "parent", "turn", "role").drop("parent")


@_query(
    "q06_hash_drift",
    r"""WITH h AS (SELECT doc_id, sha256(text) AS recorded, sha256(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS actual FROM documents)
SELECT doc_id, recorded, actual FROM h WHERE recorded <> actual""",
)
def hash_drift(spark, sf_dir):
    """Documents whose hash changes when white space does."""
    docs = table(spark, sf_dir, "documents")
    recorded = docs.select("doc_id", hashing.sha256(F.col("text")).alias("h"))
    actual = docs.select("doc_id", hashing.sha256(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")).alias("h"))
    return reconcile.drifted(recorded, actual, "doc_id", "h")


@_query(
    "q07_ordered_list_equal",
    """WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos, role FROM conversations),
b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY text, turn) AS pos, role FROM conversations)
SELECT conv_id, CAST(pos AS INTEGER) AS pos, a.role AS first_role, b.role AS second_role FROM a FULL OUTER JOIN b USING (conv_id, pos)
WHERE a.role IS DISTINCT FROM b.role""",
)
def list_differences(spark, sf_dir):
    """Places where a conversation's roles by turn differ from those by text."""
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("t"), F.array_sort(F.collect_list(F.struct("text", "turn", "role"))).alias("x"))
    a = packed.select("conv_id", F.posexplode("t").alias("p", "r")).select("conv_id", (F.col("p") + 1).alias("pos"), "r.role")
    b = packed.select("conv_id", F.posexplode("x").alias("p", "r")).select("conv_id", (F.col("p") + 1).alias("pos"), "r.role")
    found = reconcile.lists_differ(a, b, "pos", ["role"], ["conv_id"])
    return found.select("conv_id", "pos", F.col("first.role").alias("first_role"), F.col("second.role").alias("second_role"))


@_query(
    "q08_asof_role",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_event_id,
  last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def asof_purchase(spark, sf_dir):
    """Each event with its user's last purchase at or before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    marks = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    found = asof.last_before(events.select("event_id", "user_id", "ts"), marks, "user_id", "ts", "event_id", ["event_id", "value"])
    return found.select("event_id", "user_id", "last_event_id", "last_value")


@_query(
    "q09_title_exact",
    r"""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents),
f AS (SELECT title, min(doc_id) AS post FROM d GROUP BY title)
SELECT doc_id AS article, post, 'title-exact' AS how FROM d JOIN f USING (title) WHERE doc_id <> post""",
)
def title_exact(spark, sf_dir):
    """Documents with the same first line as an earlier one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article"), F.split("text", "\n")[0].alias("title"))
    return match.exact(docs, docs.withColumnRenamed("article", "post").withColumn("pos", F.col("post"))).where("article <> post")


@_query(
    "q10_containment_match",
    "SELECT doc_id AS article, min(item_id) AS post, 'title-partial' AS how FROM documents d JOIN benchmark b ON contains(d.text, b.text) OR contains(b.text, d.text) GROUP BY doc_id",
)
def containment(spark, sf_dir):
    """Documents that hold a benchmark item or lie in one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article"), F.col("text").alias("title"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("post"), F.col("item_id").alias("pos"), F.col("text").alias("title"))
    return match.partial(docs, items)


@_query(
    "q11_body_dice",
    r"""WITH t AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), chr(9) || chr(13) || ' ') AS line FROM documents),
s AS (SELECT DISTINCT doc_id, line FROM t WHERE length(line) >= 10 AND NOT regexp_matches(line, '^#{1,6}\s') AND NOT regexp_matches(line, '^!?\[')),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.line = y.line AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id)
SELECT a, b, CAST(common AS INTEGER) AS common, 2.0 * CAST(common AS DOUBLE) / (m.n + n.n) AS score
FROM p JOIN n AS m ON m.doc_id = a JOIN n ON n.doc_id = b WHERE 2.0 * CAST(common AS DOUBLE) / (m.n + n.n) >= 0.5""",
)
def body_dice(spark, sf_dir):
    """Pairs of documents that share half of their lines."""
    return match.similar_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


@_query("q12_pending_by_party", "SELECT role AS recipient, count(*) AS pending FROM conversations WHERE length(text) > 100 GROUP BY role")
def pending_by_party(spark, sf_dir):
    """Long turns, as messages without an ack, by role."""
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("recipient"), F.when(F.char_length("text") <= 100, 1.0).alias("ack_at"))
    return queue.unacknowledged(turns)


@_query(
    "q13_latin_by_font",
    r"""WITH d AS (SELECT coalesce(lang, 'xx') AS doc, 'F' || doc_id % 3 AS font, length(regexp_replace(coalesce(text, ''), '[^0-9\p{Latin}]', '', 'g')) AS n FROM documents)
SELECT doc, font, CAST(sum(n) AS BIGINT) AS latin FROM d WHERE n > 0 GROUP BY doc, font""",
)
def latin_by_font(spark, sf_dir):
    """Latin letters and digits by language and font, texts as spans of characters."""
    docs = table(spark, sf_dir, "documents")
    spans = docs.select(F.coalesce("lang", F.lit("xx")).alias("doc"), F.concat(F.lit("F"), F.col("doc_id") % 3).alias("font"), F.split(F.coalesce("text", F.lit("")), "").alias("chars"))
    return layout.latin_by_font(spans)


@_query(
    "q14_next_id",
    """WITH m AS (SELECT 1 + max(k) AS n FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer))
SELECT CASE WHEN length(CAST(n AS VARCHAR)) >= 4 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 4, '0') END AS next_id FROM m""",
)
def next_id(spark, sf_dir):
    """The id after the greatest one of two tables; drafts, whose ids are no numbers, don't count."""
    key = F.col("o_orderkey").cast("string")
    orders = table(spark, sf_dir, "orders").select(F.explode(F.array(key, F.concat(F.lit("draft-"), key))).alias("id"))
    return match.next_id(orders, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@_query(
    "q15_basename_collision",
    r"""WITH b AS (SELECT regexp_extract(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS base, url FROM pages)
SELECT base, count(DISTINCT url) AS sources FROM b GROUP BY base HAVING count(DISTINCT url) > 1""",
)
def basename_collisions(spark, sf_dir):
    refs = table(spark, sf_dir, "pages").select(F.lit("all").alias("file"), F.col("url").alias("ref"), F.col("url").alias("resolved"))
    return posts.asset_collisions(refs).select("base", "sources")


@_query(
    "q16_tree_fingerprint",
    """WITH e AS (SELECT source, doc_id, sha256(coalesce(text, '')) AS h FROM documents),
r AS (SELECT source, doc_id // 1000 AS k, sha256(string_agg(h, chr(10) ORDER BY doc_id, h) || chr(10)) AS h, count(*) AS n FROM e GROUP BY source, doc_id // 1000),
s AS (SELECT source, k // 1000 AS k2, sha256(string_agg(h, chr(10) ORDER BY k, h) || chr(10)) AS h, sum(n) AS n FROM r GROUP BY source, k // 1000)
SELECT source, sha256(string_agg(h, chr(10) ORDER BY k2, h) || chr(10)) AS fingerprint, CAST(sum(n) AS BIGINT) AS entries FROM s GROUP BY source""",
)
def fingerprints(spark, sf_dir):
    """One hash of each source's documents."""
    return fingerprint.of_groups(table(spark, sf_dir, "documents"), "source", "doc_id", hashing.sha256(F.coalesce("text", F.lit(""))))


@_query(
    "q17_pagination_stop",
    r"""WITH p AS (SELECT page_id // 10 + 1 AS page, regexp_extract(url, '([^./]+\.[^./]+)/', 1) AS item FROM pages),
f AS (SELECT item, min(page) AS page FROM p GROUP BY item), own AS (SELECT DISTINCT page FROM p)
SELECT min(page) AS stop FROM (SELECT page FROM own WHERE page > 1 AND page NOT IN (SELECT page FROM f) UNION ALL SELECT page + 1 FROM own WHERE page + 1 NOT IN (SELECT page FROM own))""",
)
def pagination_stop(spark, sf_dir):
    """Where a crawl of pages by tens stops: the first ten that name no new domain."""
    rows = table(spark, sf_dir, "pages").select(F.expr("page_id div 10 + 1").alias("page"), F.regexp_extract("url", r"([^./]+\.[^./]+)/", 1).alias("item"))
    return discover.stopped_at(rows.select("page"), rows, "page", "item")


@_query("q18_inbox_limit", "SELECT event_id AS seq, event_type AS recipient, value FROM events WHERE event_type = 'signup' AND value < 50 ORDER BY event_id LIMIT 10")
def inbox(spark, sf_dir):
    """The first ten open messages of a party."""
    stored = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("recipient"), "value", F.when(F.col("value") >= 50, F.col("value")).alias("ack_at"))
    return queue.pending(stored, "signup", 10).drop("ack_at")


@_query(
    "q19_idempotent_append",
    """WITH f AS (SELECT user_id, min(event_id) AS first, arg_min(event_type, event_id) AS t FROM events GROUP BY user_id)
SELECT e.user_id, any_value(first) AS first, count(*) FILTER (event_id > first AND event_type = t) AS repeats, count(*) FILTER (event_id > first AND event_type <> t) AS conflicts
FROM events e JOIN f USING (user_id) GROUP BY e.user_id""",
)
def idempotent_append(spark, sf_dir):
    """Events as posts under their user's id: first, repeats and conflicts."""
    return queue.idempotent(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"])


@_query(
    "q20_debounce",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS changed_from, max(ts) + INTERVAL 5 MINUTE AS quiet_at, count(*) AS n FROM i GROUP BY user_id, k""",
)
def debounce(spark, sf_dir):
    """Bursts of a user's events that five minutes of quiet end."""
    found = stream.quiet_periods(table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts"), "5 minutes")
    return found.select(F.col("path").alias("user_id"), F.col("changed_from").cast("timestamp_ntz").alias("changed_from"), F.col("quiet_at").cast("timestamp_ntz").alias("quiet_at"), "n")


@_query("q21_exclusivity", "SELECT sha256(coalesce(text, '')) AS h, count(DISTINCT source) AS owners FROM documents GROUP BY 1 HAVING count(DISTINCT source) <> 1")
def exclusivity(spark, sf_dir):
    """Texts that aren't in exactly one source."""
    docs = table(spark, sf_dir, "documents").select(hashing.sha256(F.coalesce("text", F.lit(""))).alias("h"), "source")
    return reconcile.exclusive(docs, "h", "source")


@_query("q22_json_projection", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_projection(spark, sf_dir):
    """The first present of two keys of a JSON column, as an integer."""
    v = variant.parsed(F.col("props"))
    return table(spark, sf_dir, "events").select(variant.as_integer(variant.first_present(v, ("k", "key"))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@_query(
    "q23_required_fields",
    """SELECT doc_id, field FROM (
  SELECT d.doc_id, unnest(['text', 'lang', 'quality']) AS field, unnest([d.text, d.lang, CAST(l.quality AS VARCHAR)]) AS value FROM documents d LEFT JOIN labels l USING (doc_id))
WHERE value IS NULL OR value = ''""",
)
def required_fields(spark, sf_dir):
    """Fields of labelled documents that are null or empty."""
    both = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return reconcile.required(both, "doc_id", ["text", "lang", "quality"])


@_query(
    "q24_severity_rollup",
    """WITH s AS (SELECT d.source, CASE WHEN l.toxic = 1 THEN 'FAIL' WHEN l.quality = 0 THEN 'WARN' ELSE 'PASS' END AS severity FROM labels l JOIN documents d USING (doc_id))
SELECT source, CAST(max(CASE severity WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) AS INTEGER) AS level,
  count(*) FILTER (severity = 'FAIL') AS n_fail, count(*) FILTER (severity = 'WARN') AS n_warn, count(*) FILTER (severity = 'PASS') AS n_pass FROM s GROUP BY source""",
)
def severity(spark, sf_dir):
    """Findings from labels by source."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    checks = both.select("source", F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 0, "WARN").otherwise("PASS").alias("severity"))
    return report.rollup(checks, "source")


@_query(
    "q29_body_lines",
    r"""WITH t AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), chr(9) || chr(13) || ' ') AS line FROM documents)
SELECT doc_id, count(DISTINCT line) AS lines FROM t WHERE length(line) >= 10 AND NOT regexp_matches(line, '^#{1,6}\s') AND NOT regexp_matches(line, '^!?\[') GROUP BY doc_id""",
)
def body_lines(spark, sf_dir):
    """Distinct body lines of documents."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.size(text.body_lines(F.col("text"))).cast("long").alias("lines"))
    return own.where("lines > 0")


@_query("q30_list_preview", "WITH k AS (SELECT n_regionkey AS region, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1) SELECT region, array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ' (+' || (len(l) - 3) || ' more)' ELSE '' END AS preview FROM k")
def list_preview(spark, sf_dir):
    """First names of each region's nations and how many more there are."""
    own = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return own.select("region", report.preview(F.col("l"), 3).alias("preview"))


@_query(
    "q31_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(spark, sf_dir):
    return reconcile.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@_query(
    "q32_url_parts",
    r"""SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS authority,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages""",
)
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.authority(u).alias("authority"), urls.path(u).alias("path"))


@_query(
    "q33_compared_trees",
    """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id, sha256(lower(text)) AS h FROM documents JOIN labels USING (doc_id))
SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.h = b.h THEN 'equal' ELSE 'different' END AS state FROM a LEFT JOIN b USING (doc_id)""",
)
def compared_trees(spark, sf_dir):
    """Documents against the labelled ones in lower case: missing, equal or different."""
    docs = table(spark, sf_dir, "documents")
    local = docs.select("doc_id", hashing.sha256(F.col("text")).alias("h"))
    remote = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", hashing.sha256(F.lower("text")).alias("h"))
    return reconcile.compared(local, remote, "doc_id", "h")


@_query(
    "q34_undeclared",
    "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 = 1)",
)
def undeclared(spark, sf_dir):
    """Parts of line items that are neither among the declared nor the excluded ones."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k")
    return reconcile.undeclared(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), part.where("k % 3 = 0"), part.where("k % 5 = 1"), "k")


for _name, _sql, _build in (
    ("q25_front_matter", built.FRONT_MATTER_SQL, built.front_matter),
    ("q26_xml_feeds", built.XML_SQL, built.xml_feeds),
    ("q27_filetree_source", built.TREE_SQL, built.file_tree),
    ("q27b_tree_hash", built.TREE_HASH_SQL, built.tree_hash),
    ("q28_queue_stream", built.OUTCOME_SQL, built.queue_stream),
    ("q35_page_ledger", built.LEDGER_SQL, built.page_ledger),
    ("q35b_ledger_findings", built.LEDGER_FINDINGS_SQL, built.ledger_findings),
    ("q36_manifest", built.MANIFEST_SQL, built.manifest),
    ("q37_release", built.RELEASE_SQL, built.release),
    ("q38_workspace", built.WORKSPACE_SQL, built.workspace),
    ("q39_page_layout", built.LAYOUT_SQL, built.page_layout),
    ("q40_article_match", built.MATCH_SQL, built.article_match),
    ("q41_discovery", built.DISCOVERY_SQL, built.discovery),
    ("q42_queue_fold", built.MESSAGE_SQL, built.queue_fold),
    ("q42b_queue_outcomes", built.OUTCOME_SQL, built.queue_outcomes),
    ("q43_corrections", built.CORRECTION_SQL, built.corrections),
    ("q44_broken_links", built.LINK_SQL, built.broken_links),
    ("q44b_link_summary", built.LINK_SUMMARY_SQL, built.link_summary),
    ("q45_agreement", built.AGREEMENT_SQL, built.agreement),
    ("q46_code_runs", built.CODE_SQL, built.code_runs),
    ("q47_verdict", built.VERDICT_SQL, built.verdict),
    ("q48_canonical_json", built.JSON_SQL, built.canonical),
    ("q49_queue_events", built.EVENT_SQL, built.queue_events),
    *checks.CHECKS,
):
    _query(_name, _sql)(_build)
