"""Queries on texts, pages, identifiers and checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import segmentation, text, tree
from ..operators import windows
from ..session import kept
from .registry import query

MARK = "BOOKDATA_0123456789ABCDEF"


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents")
def normalize_ws(t):
    return t.documents.select("doc_id", text.collapsed("text").alias("x"))


@query(r"SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE left(s, 57) || '…' END AS title FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)")
def title_from_seed(t):
    return t.documents.select("doc_id", text.title_from("text").alias("title"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '  ' ELSE source END), ''), 'Untitled') AS title FROM documents")
def default_text(t):
    raw = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "  ").otherwise(F.col("source"))
    return t.documents.select("doc_id", text.default_text(raw, "Untitled").alias("title"))


@query("SELECT p_partkey, left(CASE WHEN s = '' THEN 'part' ELSE s END, 48) AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' #' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)")
def slugify(t):
    return t.part.select("p_partkey", text.slug(F.concat_ws(" #", "p_name", "p_type")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, floor(l_discount * 100 + 0.5)::BIGINT AS pct FROM lineitem")
def percent_round(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", text.half_up(F.col("l_discount") * 100).alias("pct"))


@query("""WITH s AS (SELECT c_custkey, greatest(0, floor(c_acctbal))::BIGINT AS s FROM customer), p AS (SELECT *, s // 3600 AS h, s % 3600 // 60 AS m, s % 60 AS r FROM s)
SELECT c_custkey, CASE WHEN h > 0 THEN h || ':' || lpad(m::VARCHAR, 2, '0') ELSE m::VARCHAR END || ':' || lpad(r::VARCHAR, 2, '0') AS clock,
array_to_string(list_filter([CASE WHEN h > 0 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END END, CASE WHEN m > 0 THEN m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END END, CASE WHEN r > 0 OR s = 0 THEN r || ' second' || CASE WHEN r = 1 THEN '' ELSE 's' END END], lambda x: x IS NOT NULL), ' ') AS spoken,
CASE WHEN h > 0 THEN h || 'h ' || lpad(m::VARCHAR, 2, '0') ELSE m::VARCHAR END || 'm ' || lpad(r::VARCHAR, 2, '0') || 's' AS report FROM p""")
def format_time(t):
    s = F.col("c_acctbal")
    return t.customer.select("c_custkey", text.clock(s).alias("clock"), text.spoken(s).alias("spoken"), text.duration(text.whole_seconds(s)).alias("report"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def iso_dates(t):
    d = F.col("o_orderdate").cast("timestamp")
    return t.orders.select("o_orderkey", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), F.date_format(d, "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, least(greatest(value, 0), 60) AS inside, 30 + least(greatest(value - 30, 0), 20) AS absolute, least(greatest(floor(value)::BIGINT * 10, 80), 180) AS font FROM events")
def clamp_relative(t):
    v = F.col("value")
    return t.events.select("event_id", text.clamped(v, 60).alias("inside"), (30 + text.clamped(v - 30, 20)).alias("absolute"), F.least(F.greatest(F.floor(v) * 10, F.lit(80)), F.lit(180)).cast("long").alias("font"))


@query("SELECT event_id, least(floor(value / 7.5 + 0.5) * 7.5, 60) AS at FROM events")
def snap_to_grid(t):
    return t.events.select("event_id", text.snapped("value", 7.5, 60).alias("at"))


@query(r"SELECT doc_id, regexp_extract(left(text, 12), '\S*$') || regexp_extract(substring(text, 13), '^\S*') AS word FROM documents")
def word_at(t):
    return t.documents.select("doc_id", text.word_at("text", F.lit(12)).alias("word"))


@query(r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN true ELSE lower(regexp_extract(CASE WHEN page_id % 5 = 1 THEN 'not a url' ELSE url END, '^https?://([^/:?#]+)', 1)) = lower(regexp_extract(first_url, '^https?://([^/:?#]+)', 1)) END AS same FROM pages, (SELECT min(url) AS first_url FROM pages)""")
def same_host(t):
    """No origin is allowed, a malformed one isn't."""
    origin = F.when(F.col("page_id") % 5 == 1, "not a url").when(F.col("page_id") % 5 != 0, F.col("url"))
    one = t.pages.agg(F.min("url").alias("first_url"))
    host = lambda c: F.lower(F.regexp_extract(c, r"^https?://([^/:?#]+)", 1))
    return t.pages.crossJoin(F.broadcast(one)).select("page_id", F.when(origin.isNull(), True).otherwise(F.coalesce(host(origin) == host(F.col("first_url")), F.lit(False))).alias("same"))


@query(rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{MARK}' || chr(10) || text || ' {MARK} x' || chr(10) || '  {MARK} {MARK}' || chr(10) || chr(10) || chr(10) || 'end ' ELSE text END AS t FROM documents),
l AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?:BOOKDATA_[0-9A-Z]{{16}}\s*)+$')), chr(10)) AS s FROM d)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'BOOKDATA_[0-9A-Z]{{16}}', '', 'g'), '[ \t\r\f\v]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS x FROM l""")
def strip_markers(t):
    whole = F.col("text")
    marked = F.concat(F.lit(MARK + "\n"), whole, F.lit(f" {MARK} x\n  {MARK} {MARK}\n\n\nend "))
    return t.documents.select("doc_id", text.without_markers(F.when(F.col("doc_id") % 2 == 0, marked).otherwise(whole)).alias("x"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents), h AS (SELECT *, left(c, 4000) AS h FROM c),
p AS (SELECT *, CASE WHEN contains(h, chr(10) || chr(10)) THEN length(regexp_extract(h, '(?s)^(.*)\n\n', 1)) ELSE -1 END AS a, CASE WHEN contains(h, chr(10)) THEN length(regexp_extract(h, '(?s)^(.*)\n', 1)) ELSE -1 END AS b,
CASE WHEN regexp_matches(h, '[.!?]') THEN length(regexp_extract(h, '(?s)^(.*)[.!?]', 1)) ELSE -1 END AS d, CASE WHEN contains(h, ' ') THEN length(regexp_extract(h, '(?s)^(.*) ', 1)) ELSE -1 END AS e FROM h)
SELECT doc_id, CASE WHEN length(c) <= 4000 THEN c ELSE regexp_replace(left(h, CASE WHEN a > 2000 THEN a + 1 WHEN b > 2000 THEN b + 1 WHEN d > 2000 THEN d + 1 WHEN e > 2000 THEN e + 1 ELSE 4000 END), '^\s+|\s+$', '', 'g') || '…' END AS digest FROM p WHERE c <> ''""")
def normalize_summary(t):
    # empty digests go within the generator: a filter would compute each digest again
    return t.documents.select("doc_id", F.explode(F.filter(F.array(text.digest("text")), lambda d: d != "")).alias("digest"))


@query()
def sentence_split(t):
    cuts = segmentation.sentence_cuts(F.col("text"))
    return t.documents.select("doc_id", F.size(cuts).cast("long").alias("n_cuts"), F.array_join(cuts, ",").alias("cuts"))


@query("""SELECT doc_id, array_to_string(list_filter(['You are a reading companion.', 'Title: ' || source, CASE WHEN doc_id % 2 = 0 THEN 'Language: ' || lang END, '## Where the reader is', 'Position: roughly ' || floor(n_chars / 200.0 + 0.5)::BIGINT || '% through the book',
'## The passage', 'T' || lpad(doc_id::VARCHAR, 15, '0'), text, 'T' || lpad(doc_id::VARCHAR, 15, '0'), CASE WHEN doc_id % 3 = 0 THEN '## Spoilers' END], lambda x: x IS NOT NULL), chr(10)) AS prompt FROM documents""")
def prompt_assemble(t):
    token = F.concat(F.lit("T"), F.lpad(F.col("doc_id").cast("string"), 15, "0"))
    even = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Language: "), "lang"))
    place = F.concat(F.lit("Position: roughly "), text.half_up(F.col("n_chars") / 200).cast("string"), F.lit("% through the book"))
    spoilers = F.when(F.col("doc_id") % 3 == 0, "## Spoilers")
    return t.documents.select("doc_id", F.concat_ws("\n", F.lit("You are a reading companion."), F.concat(F.lit("Title: "), "source"), even, F.lit("## Where the reader is"), place, F.lit("## The passage"), text.fenced(token, F.col("text")), spoilers).alias("prompt"))


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def fingerprint(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h"))


KEY_SQL = """SELECT conv_id, sha256('{"backend":"silence","bitrate":null,"format":"wav","gap":0.35,"segments":[' || string_agg('{"id":"mg-' || turn || '","role":"' || role || '","size":' || length(text) || '}', ',' ORDER BY turn) || '],"version":1}') AS key FROM conversations GROUP BY 1"""


def _keys(t):
    part = F.struct("turn", F.struct(F.concat(F.lit("mg-"), F.col("turn").cast("string")).alias("id"), "role", F.length("text").alias("size")).alias("s"))
    g = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    payload = F.struct(F.lit("silence").alias("backend"), F.lit(None).cast("string").alias("bitrate"), F.lit("wav").alias("format"), F.lit(0.35).alias("gap"), F.transform("p", lambda x: x.s).alias("segments"), F.lit(1).alias("version"))
    return g.select("conv_id", F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256).alias("key"))


@query(KEY_SQL)
def cache_key(t):
    return _keys(t)


@query(f"""WITH k AS ({KEY_SQL}), log AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN 'changed' ELSE key END AS old, CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 2 END AS bytes FROM k WHERE conv_id % 3 > 0)
SELECT k.conv_id, coalesce(log.old = k.key AND log.bytes = 2, false) AS reused FROM k LEFT JOIN log ON log.conv_id = k.conv_id""")
def incremental_reuse(t):
    """A part is reused if its file has the size and the key that the log says."""
    k = _keys(t)
    c = F.col("conv_id")
    log = k.filter(c % 3 > 0).select("conv_id", F.when(c % 5 == 1, "changed").when(c % 5 != 0, F.col("key")).alias("old"), F.when(c % 7 == 0, 1).otherwise(2).alias("bytes"))
    return k.join(log, "conv_id", "left").select("conv_id", F.coalesce((F.col("old") == F.col("key")) & (F.col("bytes") == 2), F.lit(False)).alias("reused"))


@query("""SELECT n_regionkey, '[' || string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS doc FROM nation GROUP BY 1""")
def export_json(t):
    row = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("doc"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.error.message'), 'none') AS message FROM events")
def json_extract(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1).cast("long")).alias("k"), F.coalesce(F.get_json_object("props", "$.error.message"), F.lit("none")).alias("message"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{' ELSE props END AS p FROM events) SELECT event_id, json_valid(p) AS is_json, CASE WHEN json_valid(p) THEN coalesce(TRY_CAST(json_extract_string(p, '$.k') AS BIGINT) > 20, false) ELSE false END AS ok FROM e""")
def json_validate(t):
    p = F.when(F.col("event_id") % 4 == 0, "{").otherwise(F.col("props"))
    k = F.get_json_object(p, "$.k").try_cast("bigint")
    return t.events.select("event_id", F.get_json_object(p, "$").isNotNull().alias("is_json"), F.coalesce(k > 20, F.lit(False)).alias("ok"))


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 3 AND turn = 1 THEN 'tool' ELSE role END AS role, CASE WHEN conv_id % 13 = 5 AND turn = 0 THEN NULL ELSE text END AS text FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN role NOT IN ('system', 'user', 'assistant') THEN 'role' WHEN text IS NULL THEN 'content' WHEN sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) > 4000 THEN 'too long' END AS err FROM m)
SELECT conv_id, coalesce(CASE WHEN count(*) > 7 THEN 'too many' END, min_by(err, turn) FILTER (WHERE err IS NOT NULL), 'ok') AS verdict FROM e GROUP BY 1""")
def payload_validate(t):
    """The first rule that a request breaks."""
    c = F.col("conv_id")
    m = t.conversations.select("conv_id", "turn", F.when((c % 11 == 3) & (F.col("turn") == 1), "tool").otherwise(F.col("role")).alias("role"), F.when((c % 13 != 5) | (F.col("turn") != 0), F.col("text")).alias("text"))
    total = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    e = m.select("conv_id", "turn", F.when(~F.col("role").isin("system", "user", "assistant"), "role").when(F.col("text").isNull(), "content").when(total > 4000, "too long").alias("err"))
    return e.groupBy("conv_id").agg(F.coalesce(F.when(F.count("*") > 7, "too many"), F.min_by("err", F.when(F.col("err").isNotNull(), F.col("turn"))), F.lit("ok")).alias("verdict"))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '{' ELSE '{"audioId":"a' || (event_id % 3) || '","positionSeconds":' || CASE WHEN event_id % 5 = 0 THEN '-1' ELSE (user_id)::VARCHAR END || ',"updatedAt":1}' END AS j FROM events)
SELECT event_id, CASE WHEN json_valid(j) THEN coalesce(json_extract_string(j, '$.audioId') = 'a1' AND TRY_CAST(json_extract_string(j, '$.positionSeconds') AS DOUBLE) BETWEEN 0 AND 100 AND TRY_CAST(json_extract_string(j, '$.updatedAt') AS BIGINT) IS NOT NULL, false) ELSE false END AS resumes FROM s""")
def resume_position_valid(t):
    e = F.col("event_id")
    j = F.when(e % 6 == 0, "{").otherwise(F.concat(F.lit('{"audioId":"a'), (e % 3).cast("string"), F.lit('","positionSeconds":'), F.when(e % 5 == 0, "-1").otherwise(F.col("user_id").cast("string")), F.lit(',"updatedAt":1}')))
    s = F.from_json(j, "audioId string, positionSeconds double, updatedAt bigint")
    ok = (s.audioId == "a1") & s.positionSeconds.between(0, 100) & s.updatedAt.isNotNull()
    return t.events.select("event_id", F.coalesce(ok, F.lit(False)).alias("resumes"))


@query("""SELECT event_id, status, CASE WHEN status = 401 THEN 'That key was rejected.' WHEN status = 429 THEN 'Rate limited.' WHEN status >= 500 THEN 'Unavailable.' WHEN status = 200 THEN 'ok' ELSE 'failed (' || status || ').' END AS message,
CASE WHEN ttl BETWEEN 60 AND 172800 THEN epoch_us(ts) // 1000000 + ttl END AS expires, value > 55 AS skips_second FROM (SELECT *, (user_id * 10)::BIGINT AS ttl, CASE WHEN event_type = 'view' THEN 405 WHEN event_id % 10 = 0 THEN 503 WHEN user_id % 9 = 0 THEN 403 WHEN event_type = 'error' THEN 429 WHEN value < 5 THEN 400 ELSE 200 END AS status FROM events)""")
def status_decision(t):
    """Guards in order decide the status."""
    status = F.when(F.col("event_type") == "view", 405).when(F.col("event_id") % 10 == 0, 503).when(F.col("user_id") % 9 == 0, 403).when(F.col("event_type") == "error", 429).when(F.col("value") < 5, 400).otherwise(200)
    ttl = F.regexp_extract(F.concat((F.col("user_id") * 10).cast("string"), F.lit("s")), r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    s = F.col("status")
    said = F.when(s == 401, "That key was rejected.").when(s == 429, "Rate limited.").when(s >= 500, "Unavailable.").when(s == 200, "ok").otherwise(F.concat(F.lit("failed ("), s.cast("string"), F.lit(").")))
    at = F.expr("unix_micros(cast(ts AS timestamp)) div 1000000")
    rows = t.events.withColumn("status", status)
    return rows.select("event_id", "status", said.alias("message"), F.when(ttl.between(60, 172800), at + ttl).alias("expires"), (F.col("value") > 55).alias("skips_second"))


@query(r"""WITH h AS (SELECT event_id, user_id AS size, CASE event_id % 6 WHEN 0 THEN 'bytes=0-0' WHEN 1 THEN 'bytes=' || (event_id % 100) || '-' WHEN 2 THEN 'bytes=-' || (event_id % 50) WHEN 3 THEN 'bytes=9-5' WHEN 4 THEN 'junk' ELSE 'bytes=5-60' END AS r FROM events),
p AS (SELECT *, TRY_CAST(nullif(regexp_extract(r, '^bytes=(\d*)-(\d*)$', 1), '') AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(r, '^bytes=(\d*)-(\d*)$', 2), '') AS BIGINT) AS b FROM h),
o AS (SELECT *, a IS NOT NULL AND a < size AND (b IS NULL OR b >= a) AS front, a IS NULL AND b > 0 AND size > 0 AS back FROM p)
SELECT event_id, CASE WHEN front THEN a WHEN back THEN size - least(b, size) END AS off, CASE WHEN front THEN least(coalesce(b, size - 1), size - 1) - a + 1 WHEN back THEN least(b, size) END AS len FROM o""")
def byte_range(t):
    e = F.col("event_id")
    h = (F.when(e % 6 == 0, "bytes=0-0").when(e % 6 == 1, F.concat(F.lit("bytes="), (e % 100).cast("string"), F.lit("-"))).when(e % 6 == 2, F.concat(F.lit("bytes=-"), (e % 50).cast("string")))
         .when(e % 6 == 3, "bytes=9-5").when(e % 6 == 4, "junk").otherwise("bytes=5-60"))
    r = text.byte_range(h, F.col("user_id"))
    return t.events.select("event_id", r.offset.alias("off"), r.length.alias("len"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'dark' END, CASE WHEN c_custkey % 2 = 0 THEN 'sepia' END, 'light') AS theme, coalesce(CASE WHEN c_acctbal > 0 THEN c_nationkey END, 100)::BIGINT AS font FROM customer")
def settings_overlay(t):
    """Defaults, under what is stored, under the patch."""
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", F.coalesce(F.when(k % 3 == 0, "dark"), F.when(k % 2 == 0, "sepia"), F.lit("light")).alias("theme"), F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")), F.lit(100)).cast("long").alias("font"))


@query()
def html_text(t):
    return segmentation.html_text(t.pages)


@query()
def html_blocks(t):
    return segmentation.html_blocks(t.pages)


@query()
def page_links(t):
    return segmentation.page_links(t.pages)


@query(r"SELECT page_id, regexp_replace(string_split(regexp_replace(url, '^https?://[^/]+', ''), '#')[1], '^\.?/', '') AS path FROM pages")
def normalize_url(t):
    return t.pages.select("page_id", text.href_path(F.regexp_replace("url", "^https?://[^/]+", "")).alias("path"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a b' WHEN 1 THEN '100%' WHEN 2 THEN NULL WHEN 3 THEN 'x+y' END AS fragment,
CASE page_id % 5 WHEN 4 THEN '%zz' ELSE 'p q/' || page_id END AS path FROM pages""")
def link_parts(t):
    """The decoded parts of links; an escape that is none leaves a part as it is."""
    fragments = F.array(*map(F.lit, ("#a%20b", "#100%", "#", "#x+y", "")))
    n = F.col("page_id") % 5
    path = F.when(n == 4, "%zz").otherwise(F.concat(F.lit("p%20q/"), F.col("page_id").cast("string")))
    link = F.concat(path, F.get(fragments, n.cast("int")))
    return t.pages.select("page_id", text.href_fragment(link).alias("fragment"), text.unescaped(F.substring_index(link, "#", 1)).alias("path"))


SECRET = b"a key of our own"
PADS = [bytes(k ^ x for k in SECRET.ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]


@query(f"""WITH m AS (SELECT page_id, unhex('{PADS[1]}') || encode(url || chr(10) || (1700000000 + page_id)) AS inner_ FROM pages)
SELECT page_id, 1700000000 + page_id AS expires, rtrim(replace(replace(base64(unhex(sha256(unhex('{PADS[0]}') || unhex(sha256(inner_))))), '+', '-'), '/', '_'), '=') AS signature FROM m""")
def signed_links(t):
    expires = F.col("page_id") + 1_700_000_000
    return t.pages.select("page_id", expires.alias("expires"), text.hmac_sha256(SECRET, F.concat("url", F.lit("\n"), expires.cast("string"))).alias("signature"))


@query()
def segment_documents(t):
    return segmentation.segment_texts(t.documents.select("doc_id", "text"))


@query()
def segment_pages(t):
    return segmentation.segment_pages(t.pages)


@query("""WITH f AS (SELECT conv_id, turn, text, role FROM conversations) SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'error' WHEN max_by(role, turn) = 'assistant' THEN 'ok' ELSE 'truncated' END AS status,
CASE WHEN NOT bool_or(role = 'system') AND max_by(role, turn) = 'assistant' THEN string_agg(text, '' ORDER BY turn) END AS text FROM f GROUP BY 1""")
def sse_decode(t):
    """Event streams made of the turns: a system turn is an error in the stream, a last answer its end. Every other stream has
    CR LF at its line ends, and white space and an error that is false in its frames."""
    from ..streaming import sse

    last = F.max("turn").over(Window.partitionBy("conv_id")) == F.col("turn")
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    frame = F.when(F.col("role") == "system", F.lit('{"error":{"message":"no"}}')).otherwise(delta)
    body = F.concat(F.lit(": keepalive\n\ndata: "), frame, F.when(last & (F.col("role") == "assistant"), "\n\ndata: [DONE]\n\n").otherwise("\n\n"))
    odd = F.concat(F.lit(": keepalive\r\n\r\ndata:\t"), F.regexp_replace(frame, r'^\{"choices"', '{"error":false,"choices"'), F.when(last & (F.col("role") == "assistant"), " \r\n\r\ndata: [DONE]\r\n\r\n").otherwise("\r\n\r\n"))
    rows = t.conversations.select("conv_id", "turn", "role", "text").withColumn("chunk", F.when(F.col("conv_id") % 2 == 0, body).otherwise(odd))
    return sse.decoded(rows, "conv_id", "turn", "chunk")


@query()
def reading_flagship(t):
    """Documents cut into utterances, and how long and costly each is to read."""
    seg = segmentation.segment_texts(t.documents.select("doc_id", "text"))
    samples = (F.greatest(F.length("text") / 14.5, F.lit(0.2)) * 24000).cast("long") + int(0.35 * 24000)
    # a timeline's end is the sum of its lengths, so neither its order nor a window is needed
    return seg.groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), F.round(F.sum(samples) / 24000, 3).alias("seconds"))


@query(r"SELECT doc_id, doc_id % 7 <> 3 OR NOT regexp_matches(text, '\S') AS preserved FROM documents")
def segment_integrity(t):
    """Whether the utterances of a document together are its text; a seventh of the documents lose their first one."""
    docs = t.documents.select("doc_id", "text")
    segments = segmentation.segment_texts(docs).filter("doc_id % 7 <> 3 or pos > 0")
    return segmentation.preserved(docs, segments, ["doc_id"], ["pos"])


@query()
def anchor_blocks(t):
    """The block that each element leads to: pages have few ids, so every element is an anchor, by its tag and number."""
    elements = kept(tree.nodes(t.pages), "nodes")
    marks = elements.select("page_id", "ord", F.concat_ws("-", "tag", F.col("ord").cast("string")).alias("anchor"))
    return tree.anchored(marks, tree.leaves(elements))


@query()
def span_pages(t):
    """Pages rewritten with a span around each utterance; numbers run on over all pages."""
    out = tree.rewritten(t.pages)
    return out.select("page_id", F.size("spans").cast("long").alias("n_spans"), F.get("spans", F.lit(0))["id"].alias("first_id"), F.sha2("html", 256).alias("html_sha256"),
                      F.sha2(F.array_join(F.transform("spans", lambda s: s["text"]), "\n"), 256).alias("text_sha256"), "error")


@query()
def numbered_segments(t):
    """Utterances of all documents with ids that run on over them."""
    rows = kept(segmentation.segment_texts(t.documents.select("doc_id", "text")), "segments")
    return tree.running_numbers(rows, "doc_id", "pos", "n").select("doc_id", "pos", "n", F.format_string("mg-%06d", "n").alias("span_id"))


@query()
def sql_utterances(t):
    """The same as segment_documents, from SQL."""
    from ..functions.register import register

    register(t.spark)
    t.documents.createOrReplaceTempView("lectern_documents")
    return t.spark.sql("SELECT doc_id, u.pos, u.text FROM lectern_documents, LATERAL utterances(text) u")
