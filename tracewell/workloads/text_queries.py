"""Queries over texts: search, similarity, clustering, scalar text functions."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tracewell import schemas, store
from tracewell.functions import text
from tracewell.operators import reports as R
from tracewell.operators import search as H
from tracewell.operators import similarity as J
from tracewell.operators import steps as O
from tracewell.plans.components import connected_components
from tracewell.session import ensure_checkpoint_dir
from tracewell.workloads import derived as D
from tracewell.workloads.base import CONV_SESSIONS, ERRORS, MESSAGES, STEPS, query


def _messages(spark, d):
    return schemas.messages_from_conversations(spark, d)


def _sessions(spark, d):
    return schemas.sessions_from_conversations(spark, d)


# --- search -----------------------------------------------------------------

_QUERIES = ("the erst", "und nicht", "ætt zzz", "éle")

_TERMS = r"""terms AS (SELECT sid, seq, t.term, t.pos FROM (SELECT sid, seq, regexp_extract_all(lower(raw), '[\p{L}\p{N}\p{M}]+') AS a FROM messages) m,
  unnest(list_transform(a, lambda x, i: {'term': x, 'pos': i-1})) u(t))"""


@query(
    "H1_cjk_rewrite",
    f"""WITH {MESSAGES} SELECT sid, seq, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS text FROM messages""",
)
def cjk_rewrite(spark, d):
    return _messages(spark, d).select("sid", "seq", text.cjk_bigram_rewrite("raw").alias("text"))


@query(
    "H2_postings",
    f"""WITH {MESSAGES}, {_TERMS} SELECT sid, seq, term, CAST(pos AS INTEGER) AS pos FROM terms""",
)
def postings(spark, d):
    return H.postings(_messages(spark, d))


@query(
    "H3_query_terms",
    r"""WITH q AS (SELECT conv_id, regexp_extract_all(replace(arg_min(text, turn), '"', ' '), '\S+') AS ws FROM conversations WHERE role='user' GROUP BY conv_id),
w AS (SELECT conv_id, i-1 AS clause, regexp_extract_all(lower(ws[i]), '[\p{L}\p{N}\p{M}]+') AS ts FROM (SELECT conv_id, ws, unnest(range(1, len(ws)+1)) AS i FROM q))
SELECT conv_id AS qid, CAST(clause AS INTEGER) AS clause, CAST(len(ts) AS INTEGER) AS n_terms, CAST(j-1 AS INTEGER) AS term_pos, ts[j] AS term
FROM (SELECT *, unnest(range(1, len(ts)+1)) AS j FROM w)""",
)
def query_terms(spark, d):
    first = schemas.read_table(spark, d, "conversations").filter(F.col("role") == "user")
    return H.terms_of(first.groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("query")))


_VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(_QUERIES))
_BM25 = f"""WITH {MESSAGES}, {CONV_SESSIONS}, {_TERMS},
q(qid, query) AS (VALUES {_VALUES}),
qt AS (SELECT qid, unnest(string_split(query, ' ')) AS term FROM q),
hits AS (SELECT qid, t.term, sid, seq, count(*) AS tf FROM terms t JOIN qt ON qt.term=t.term GROUP BY ALL),
len AS (SELECT sid, seq, len(regexp_extract_all(lower(raw), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) AS len FROM messages),
c AS (SELECT count(*) AS n, avg(len) AS al FROM len),
df AS (SELECT qid, term, count(*) AS df FROM hits GROUP BY ALL),
s AS (SELECT qid, h.sid, h.seq, sum(greatest(ln((n-df+0.5)/(df+0.5)), 1e-6) * tf*2.2/(tf+1.2*(0.25+0.75*len/al))) AS score
  FROM hits h JOIN df USING (qid, term) JOIN len l ON l.sid=h.sid AND l.seq=h.seq, c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score,9) DESC, sid, seq) AS rn FROM s)"""


@query(
    "H4_search",
    _BM25
    + """ SELECT CAST(qid AS INTEGER) AS qid, CAST(rn AS INTEGER) AS rank, r.sid, seq, source, title, round(score,6) AS score
FROM r JOIN csessions c ON c.sid=r.sid WHERE rn<=20""",
)
def search(spark, d):
    hits = H.search(_messages(spark, d), _sessions(spark, d), _QUERIES)
    return hits.select("qid", "rank", "sid", "seq", "source", "title", F.round("score", 6).alias("score"))


@query(
    "H4_indexed_search",
    _BM25
    + """ SELECT CAST(qid AS INTEGER) AS qid, CAST(rn AS INTEGER) AS rank, r.sid, seq, source, title, round(score,6) AS score
FROM r JOIN csessions c ON c.sid=r.sid WHERE rn<=20""",
)
def indexed_search(spark, d):
    """The same over a stored index of two segments: system and user turns first, answers added later."""
    messages = _messages(spark, d)
    path = f"{ensure_checkpoint_dir(spark)}/tables/index-{uuid.uuid4().hex}"
    H.write_index(messages.filter("role <> 'assistant'"), path, bucket_rows=50_000, cell_rows=32)
    index = H.append_index(messages.filter("role = 'assistant'"), path, bucket_rows=50_000)
    hits = H.search(messages, _sessions(spark, d), _QUERIES, index=index)
    return hits.select("qid", "rank", "sid", "seq", "source", "title", F.round("score", 6).alias("score"))


#: Words of two terms are phrases.
_PHRASES = ("of-the", "de.la", "the,of")
_PHRASE_ROWS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(re.split("[-.,]", p) for p in _PHRASES))


@query(
    "H4_indexed_phrases",
    _BM25.replace(f"q(qid, query) AS (VALUES {_VALUES}),", f"q(qid, a, b) AS (VALUES {_PHRASE_ROWS}),")
    .replace("qt AS (SELECT qid, unnest(string_split(query, ' ')) AS term FROM q),", "")
    .replace(
        "hits AS (SELECT qid, t.term, sid, seq, count(*) AS tf FROM terms t JOIN qt ON qt.term=t.term GROUP BY ALL),",
        """hits AS (SELECT qid, a AS term, x.sid, x.seq, count(*) AS tf FROM q JOIN terms x ON x.term=a
  JOIN terms y ON y.term=b AND y.sid=x.sid AND y.seq=x.seq AND y.pos=x.pos+1 GROUP BY ALL),""",
    )
    + """ SELECT CAST(qid AS INTEGER) AS qid, CAST(rn AS INTEGER) AS rank, r.sid, seq, source, title, round(score,6) AS score
FROM r JOIN csessions c ON c.sid=r.sid WHERE rn<=20""",
)
def indexed_phrases(spark, d):
    """Phrase queries on a stored index; small buckets, so that there are several."""
    messages = _messages(spark, d)
    index = H.write_index(messages, f"{ensure_checkpoint_dir(spark)}/tables/index-{uuid.uuid4().hex}", bucket_rows=5000)
    hits = H.search(messages, _sessions(spark, d), _PHRASES, index=index)
    return hits.select("qid", "rank", "sid", "seq", "source", "title", F.round("score", 6).alias("score"))


@query(
    "H5_snippet",
    f"""WITH {MESSAGES}, p AS (SELECT sid, seq, raw, CASE WHEN instr(lower(raw),'th')>0 THEN instr(lower(raw),'th')
  WHEN instr(lower(raw),'en')>0 THEN instr(lower(raw),'en') ELSE 1 END - 1 AS hit FROM messages),
b AS (SELECT *, greatest(0, hit-20) AS s FROM p)
SELECT sid, seq, concat(CASE WHEN s>0 THEN '…' ELSE '' END, substr(raw, s+1, CAST(least(length(raw), s+120)-s AS INTEGER)),
 CASE WHEN s+120<length(raw) THEN '…' ELSE '' END) AS snippet FROM b""",
)
def snippets(spark, d):
    rows = _messages(spark, d).withColumn("query", F.lit('"Th" en'))
    return rows.select("sid", "seq", H.snippet("raw", "query").alias("snippet"))


@query(
    "D2_messages_with_session",
    f"""WITH {MESSAGES}, {CONV_SESSIONS} SELECT m.sid, seq, role, source, title FROM messages m JOIN csessions c ON c.sid=m.sid""",
)
def messages_with_session(spark, d):
    return _messages(spark, d).select("sid", "seq", "role").join(_sessions(spark, d).select("sid", "source", "title"), "sid")


# --- scalar functions -----------------------------------------------------------


@query(
    "I3_extract_grams",
    """SELECT doc_id, len(g) AS n_grams, array_to_string(list_sort(list_distinct(g)), ' ') AS grams FROM (
  SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: length(x)>=3) AS g FROM documents)""",
)
def extract_grams(spark, d):
    docs = schemas.read_table(spark, d, "documents").select("doc_id", text.extract_grams("text", 3).alias("g"))
    return docs.select("doc_id", F.size("g").cast("long").alias("n_grams"), F.array_join(F.array_sort(F.array_distinct("g")), " ").alias("grams"))


@query(
    "I4_bigrams",
    f"""WITH {MESSAGES}, c AS (SELECT sid, seq, regexp_replace(raw, '\\s+', '', 'g') AS t FROM messages)
SELECT sid, seq, array_to_string(list_sort(list_distinct([t[i:i+1] FOR i IN range(1, length(t))])), '|') AS grams FROM c""",
)
def bigrams(spark, d):
    return _messages(spark, d).select(
        "sid", "seq", F.array_join(F.array_sort(F.array_distinct(text.bigrams("raw"))), "|").alias("grams")
    )


@query(
    "I6_normalize_and_month",
    """SELECT doc_id, replace(concat(text, chr(13), chr(10)), chr(13)||chr(10), chr(10)) AS lines,
trim(regexp_replace(text, '\\s+', ' ', 'g')) AS folded FROM documents""".replace("\\\\", "\\"),
)
def normalize_and_month(spark, d):
    return schemas.read_table(spark, d, "documents").select(
        "doc_id",
        text.normalize_newlines(F.concat("text", F.lit("\r\n"))).alias("lines"),
        text.fold("text").alias("folded"),
    )


@query(
    "I6_month_key",
    """SELECT event_id, substr(CAST(ts AS VARCHAR),1,7) AS month FROM events""",
)
def month_key(spark, d):
    return schemas.read_table(spark, d, "events").select("event_id", text.month_key(F.col("ts").cast("string")).alias("month"))


@query(
    "I7_loose_key",
    """SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM documents""",
)
def loose_key(spark, d):
    return schemas.read_table(spark, d, "documents").select("doc_id", text.loose_key("text").alias("key"))


@query(
    "I8_warning_key",
    f"""WITH {ERRORS} SELECT sid, seq, left(regexp_replace(error, '\\d+', '#', 'g'), 200) AS key FROM errs""",
)
def warning_key(spark, d):
    rows = store.steps(spark, d).filter(F.col("error").isNotNull())
    return rows.select("sid", "seq", text.warning_key("error").alias("key"))


@query(
    "I9_ascii_quotes",
    """WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages),
p AS (SELECT page_id, string_split(line, '"') AS a FROM l),
q AS (SELECT page_id, unnest(list_filter(list_transform(a, lambda x, i: CASE WHEN (i-1)%2=1 AND i-1<len(a)-1 AND length(trim(x))>=2 THEN x END), lambda x: x IS NOT NULL)) AS quote FROM p)
SELECT page_id, quote, count(*) AS n FROM q GROUP BY ALL""",
)
def ascii_quotes(spark, d):
    rows = schemas.read_table(spark, d, "pages").select("page_id", F.explode(text.ascii_quote_spans("html")).alias("quote"))
    return rows.groupBy("page_id", "quote").agg(F.count(F.lit(1)).alias("n"))


@query(
    "I9_corner_quotes",
    """SELECT doc_id, text AS quote FROM documents WHERE length(text)>=6 AND text NOT LIKE '%」%'""",
)
def corner_quotes(spark, d):
    body = F.concat(F.lit("see 「"), "text", F.lit("」 and 「a」"))
    return schemas.read_table(spark, d, "documents").select("doc_id", F.explode(text.quote_spans(body)).alias("quote"))


@query(
    "I11_date_span",
    """SELECT o_orderkey, CASE WHEN o_orderstatus<>'P' THEN CAST(o_orderdate AS DATE) END AS start_day,
CASE WHEN o_orderstatus<>'P' THEN CAST(o_orderdate AS DATE) + 7 END AS end_day FROM orders""",
)
def date_span(spark, d):
    day = F.to_date("o_orderdate")
    tail = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_add(day, 7).cast("string"))
    span = text.date_span(F.concat(day.cast("string"), F.lit(" ~ "), tail))
    return schemas.read_table(spark, d, "orders").select("o_orderkey", span["start"].alias("start_day"), span["end"].alias("end_day"))


@query(
    "I12_note_patterns",
    """SELECT o_orderkey, concat(o_orderpriority, ',', o_orderstatus) AS found FROM orders""",
)
def note_patterns(spark, d):
    note = F.concat(
        F.lit("why;Pattern: "), "o_orderpriority", F.lit(" ；pattern:"), "o_orderstatus", F.lit("\n pattern: "), "o_orderpriority"
    )
    return schemas.read_table(spark, d, "orders").select("o_orderkey", F.array_join(text.note_patterns(note), ",").alias("found"))


@query(
    "I13_key_matches",
    """SELECT o_orderkey, p_partkey, o_orderpriority = p_type OR (length(o_orderpriority)>=8 AND contains(p_type, o_orderpriority)) AS hit
FROM (SELECT o_orderkey, o_orderpriority, o_custkey AS p_partkey, concat('x', o_orderpriority) AS p_type FROM orders)""",
)
def key_matches(spark, d):
    rows = schemas.read_table(spark, d, "orders")
    longer = F.concat(F.lit("x"), "o_orderpriority")
    return rows.select(
        "o_orderkey", F.col("o_custkey").alias("p_partkey"), text.key_matches(F.col("o_orderpriority"), longer).alias("hit")
    )


@query(
    "A13_local_stamp",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS iso, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS seconds,
concat('at ', event_id) AS other FROM events""",
)
def local_stamp(spark, d):
    """Stamps in several spellings; the zone is pinned by writing offsets of the session zone."""
    stamp = F.col("ts").cast("timestamp")
    return schemas.read_table(spark, d, "events").select(
        "event_id",
        text.to_local_ts(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("iso"),
        text.to_local_ts(F.unix_seconds(stamp).cast("string")).alias("seconds"),
        text.to_local_ts(F.concat(F.lit("at "), "event_id")).alias("other"),
    )


# --- similarity -------------------------------------------------------------------

_GRAM_ROWS = f"""j AS (SELECT sid, regexp_replace(string_agg(raw, '' ORDER BY seq), '\\s+', '', 'g') AS t FROM messages WHERE role='user' GROUP BY sid),
g AS (SELECT DISTINCT sid, unnest([t[i:i+1] FOR i IN range(1, length(t))]) AS gram FROM j),
n AS (SELECT sid, count(*) AS n FROM g GROUP BY sid)"""


@query(
    "J_session_grams",
    f"""WITH {MESSAGES}, {_GRAM_ROWS} SELECT sid, string_agg(gram, '|' ORDER BY gram) AS grams FROM g GROUP BY sid""",
)
def session_grams(spark, d):
    return J.session_grams(_messages(spark, d)).select("sid", F.array_join(F.array_sort("grams"), "|").alias("grams"))


_CLUSTERS = """pairs AS (SELECT a.sid AS a, b.sid AS b, count(*) AS c FROM {g} a JOIN {g} b ON a.gram=b.gram AND a.sid<b.sid GROUP BY ALL),
jac AS (SELECT a, b, c/(x.n+y.n-c) AS j FROM pairs JOIN n x ON x.sid=a JOIN n y ON y.sid=b),
edge AS (SELECT a AS u, b AS v FROM jac WHERE j>=0.9-1e-12 {extra} UNION SELECT b, a FROM jac WHERE j>=0.9-1e-12 {extra}),
reach AS (SELECT u, v FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u=r.v),
comp AS (SELECT u AS sid, least(u, min(v)) AS rep FROM reach GROUP BY u)"""


def _conv_items(spark, d):
    grams = J.session_grams(_messages(spark, d))
    return grams.join(_sessions(spark, d).select("sid", "created_at"), "sid")


def _doc_items(spark, d):
    docs = schemas.read_table(spark, d, "documents")
    sid = F.format_string("doc:%07d", "doc_id").alias("sid")
    return docs.select(sid, F.lit("").alias("created_at"), F.array_distinct(text.bigrams("text")).alias("grams"))


def _source_items(spark, d):
    sources = schemas.read_table(spark, d, "documents").select(F.format_string("doc:%07d", "doc_id").alias("sid"), "source")
    return _doc_items(spark, d).join(sources, "sid")


_DOC_GRAMS = """t AS (SELECT printf('doc:%07d', doc_id) AS sid, source, regexp_replace(text, '\\s+', '', 'g') AS t FROM documents),
g AS (SELECT DISTINCT sid, unnest([t[i:i+1] FOR i IN range(1, length(t))]) AS gram FROM t),
n AS (SELECT sid, count(*) AS n FROM g GROUP BY sid)"""
#: Documents whose text has this many characters at most are known already.
_KNOWN_CHARS = 120
_IN_SOURCE = """tg AS (SELECT source, g.sid, gram FROM g JOIN t USING (sid)),
pairs AS (SELECT x.source, x.sid AS a, y.sid AS b, count(*) AS c FROM tg x JOIN tg y ON x.source=y.source AND x.gram=y.gram AND x.sid<y.sid GROUP BY ALL),
jac AS (SELECT source, a, b, c/(x.n+y.n-c) AS j FROM pairs JOIN n x ON x.sid=a JOIN n y ON y.sid=b)"""


@query(
    "J1_session_duplicates",
    f"""WITH RECURSIVE messages AS (SELECT concat('conv:', conv_id // 2, '-', turn) AS sid, conv_id AS seq, role, text AS raw FROM conversations
  UNION ALL SELECT concat('conv:again-', conv_id // 2, '-', turn), conv_id, role, text FROM conversations),
{_GRAM_ROWS}, {_CLUSTERS.format(g="g", extra="")}
SELECT rep, comp.sid, round(j, 3) AS jaccard FROM comp LEFT JOIN jac ON a=rep AND b=comp.sid AND j>=0.9-1e-12 WHERE comp.sid<>rep""",
)
def session_duplicates(spark, d):
    """Every session of two messages is there twice, under another name."""
    rows = schemas.read_table(spark, d, "conversations")
    half = F.floor(F.col("conv_id") / 2).cast("long")
    sid = F.explode(F.array(F.concat(F.lit("conv:"), half, F.lit("-"), "turn"), F.concat(F.lit("conv:again-"), half, F.lit("-"), "turn")))
    messages = rows.select(sid.alias("sid"), F.col("conv_id").alias("seq"), "role", F.col("text").alias("raw"))
    return J.duplicate_clusters(J.session_grams(messages).withColumn("created_at", F.lit("")))


@query(
    "J1_document_duplicates",
    f"""WITH RECURSIVE {_DOC_GRAMS}, {_CLUSTERS.format(g="g", extra="")}
SELECT rep, comp.sid, round(j, 3) AS jaccard FROM comp LEFT JOIN jac ON a=rep AND b=comp.sid AND j>=0.9-1e-12 WHERE comp.sid<>rep""",
)
def document_duplicates(spark, d):
    return J.duplicate_clusters(_doc_items(spark, d))


@query(
    "J2_duplicate_candidates",
    f"""WITH RECURSIVE {_DOC_GRAMS}, og AS (SELECT g.* FROM g JOIN t USING (sid) WHERE length(t)>{_KNOWN_CHARS}), {_CLUSTERS.format(g="og", extra="")}
SELECT rep, comp.sid, round(j, 3) AS jaccard FROM comp LEFT JOIN jac ON a=rep AND b=comp.sid AND j>=0.9-1e-12 WHERE comp.sid<>rep""",
)
def duplicate_candidates(spark, d):
    known = schemas.read_table(spark, d, "documents").filter(F.length(text.squash("text")) <= _KNOWN_CHARS)
    return J.duplicate_candidates(_doc_items(spark, d), known.select(F.format_string("doc:%07d", "doc_id").alias("sid")))


@query(
    "J1_topic_pairs",
    f"""WITH {_DOC_GRAMS}, {_IN_SOURCE},
k AS (SELECT source, sid, sha256(string_agg(gram, '|' ORDER BY gram)) AS k FROM tg GROUP BY ALL),
c AS (SELECT source, k, min(sid) AS cls, count(*) AS copies FROM k GROUP BY ALL)
SELECT a, b, x.copies AS a_copies, y.copies AS b_copies, round(j,3) AS jaccard, CASE WHEN j>=0.9 THEN 'duplicate' ELSE 'band' END AS kind
FROM jac JOIN c x ON x.source=jac.source AND x.cls=a JOIN c y ON y.source=jac.source AND y.cls=b WHERE j>=0.8-1e-12""",
)
def topic_pairs(spark, d):
    return J.similar_pairs(_source_items(spark, d), group=["source"])


@query(
    "L13_topic_dedupe",
    f"""WITH RECURSIVE {_DOC_GRAMS}, {_IN_SOURCE},
edge AS (SELECT a AS u, b AS v FROM jac WHERE j>=0.9-1e-12 UNION SELECT b, a FROM jac WHERE j>=0.9-1e-12),
reach AS (SELECT u, v FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u=r.v),
comp AS (SELECT u AS sid, least(u, min(v)) AS rep FROM reach GROUP BY u)
SELECT source, count(*) AS members, count(*) FILTER (WHERE c.sid<>c.rep) AS duplicates, count(*) - count(*) FILTER (WHERE c.sid<>c.rep) AS reps
FROM t LEFT JOIN comp c USING (sid) GROUP BY source""",
)
def topic_dedupe(spark, d):
    items = _source_items(spark, d)
    return J.dedupe_summary(items.select("source", "sid"), J.duplicate_clusters(items, group=["source"]), ["source"])


@query(
    "J3_zero_user_sessions",
    """SELECT printf('doc:%07d', d.doc_id) AS sid, d.lang AS title FROM documents d WHERE d.doc_id NOT IN (SELECT conv_id FROM conversations WHERE role='user')""",
)
def zero_user_sessions(spark, d):
    sid = F.format_string("doc:%07d", "doc_id").alias("sid")
    sessions = schemas.read_table(spark, d, "documents").select(sid, F.col("lang").alias("title"))
    messages = schemas.read_table(spark, d, "conversations").select(F.format_string("doc:%07d", "conv_id").alias("sid"), "role")
    return J.zero_user_sessions(sessions, messages)


@query(
    "J4_filtered_clusters",
    f"""WITH RECURSIVE {_DOC_GRAMS}, {_CLUSTERS.format(g="g", extra="")},
m AS (SELECT rep, comp.sid, round(j,3) AS jaccard FROM comp LEFT JOIN jac ON a=rep AND b=comp.sid AND j>=0.9-1e-12 WHERE comp.sid<>rep)
SELECT rep, sid, jaccard FROM m WHERE jaccard IS NULL OR jaccard>=0.95""",
)
def filtered_clusters(spark, d):
    return J.filter_clusters(J.duplicate_clusters(_doc_items(spark, d)), 0.95)


@query(
    "J6_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 1000000 + CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS BIGINT)*100 + o_custkey % 37 AS b FROM orders),
x AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r AS (SELECT u, v FROM x UNION SELECT r.u, x.v FROM r JOIN x ON x.u=r.v)
SELECT u AS node, least(u, min(v)) AS component FROM r GROUP BY u""",
)
def components(spark, d):
    year = F.year("o_orderdate").cast("long")
    edges = (
        schemas.read_table(spark, d, "orders")
        .select(F.col("o_custkey").alias("a"), (F.lit(1000000) + year * 100 + F.col("o_custkey") % 37).alias("b"))
        .distinct()
    )
    return connected_components(edges)


# --- topic candidates ------------------------------------------------------------------

_CAND = f"""{STEPS}, {D.INTRO},
kept AS (SELECT sid, title, regexp_replace(title, '\\s+', '', 'g') AS t, left(regexp_replace(first_user, '\\s+', '', 'g'), 200) AS f FROM titled
  WHERE sid NOT IN (SELECT sid FROM noise)),
tg AS (SELECT DISTINCT sid, unnest([t[i:i+1] FOR i IN range(1, length(t))]) AS gram FROM kept),
fg AS (SELECT DISTINCT sid, unnest([f[i:i+1] FOR i IN range(1, length(f))]) AS gram FROM kept),
al AS (SELECT sid, gram FROM tg UNION SELECT sid, gram FROM fg),
pst AS (SELECT gram FROM al GROUP BY gram HAVING count(*)>=2),
ok AS (SELECT al.* FROM al SEMI JOIN pst USING (gram)),
pr AS (SELECT DISTINCT x.sid AS a, y.sid AS b FROM ok x JOIN ok y ON x.gram=y.gram AND x.sid<y.sid),
tn AS (SELECT sid, count(*) AS n FROM tg GROUP BY sid), fn AS (SELECT sid, count(*) AS n FROM fg GROUP BY sid),
tc AS (SELECT x.sid AS a, y.sid AS b, count(*) AS c FROM tg x JOIN tg y ON x.gram=y.gram AND x.sid<y.sid GROUP BY ALL),
fc AS (SELECT x.sid AS a, y.sid AS b, count(*) AS c FROM fg x JOIN fg y ON x.gram=y.gram AND x.sid<y.sid GROUP BY ALL),
sims AS (SELECT pr.a, pr.b,
  (CASE WHEN ta.n>0 AND tb.n>0 THEN 0.5*(coalesce(tc.c,0)/(ta.n+tb.n-coalesce(tc.c,0))) ELSE 0.0 END
  + CASE WHEN fa.n>0 AND fb.n>0 THEN 0.3*(coalesce(fc.c,0)/(fa.n+fb.n-coalesce(fc.c,0))) ELSE 0.0 END)
  / (CASE WHEN ta.n>0 AND tb.n>0 THEN 0.5 ELSE 0 END + CASE WHEN fa.n>0 AND fb.n>0 THEN 0.3 ELSE 0 END) AS sim
  FROM pr LEFT JOIN tn ta ON ta.sid=a LEFT JOIN tn tb ON tb.sid=b LEFT JOIN fn fa ON fa.sid=a LEFT JOIN fn fb ON fb.sid=b
  LEFT JOIN tc ON tc.a=pr.a AND tc.b=pr.b LEFT JOIN fc ON fc.a=pr.a AND fc.b=pr.b)"""


def _features(spark, d):
    sessions = D.titled(spark, d)
    return J.candidate_features(sessions, _messages(spark, d), store.steps(spark, d), D.noise(spark, d))


@query("J5_candidate_pairs", f"WITH {_CAND} SELECT a, b, round(sim, 6) AS sim FROM sims WHERE sim>=0.35")
def candidate_pairs(spark, d):
    return J.candidate_pairs(_features(spark, d)).withColumn("sim", F.round("sim", 6))


# The greedy one session after the other: a session is a seed if no seed before it is its neighbour.
_SEEDS = f"""{_CAND},
e AS (SELECT a AS u, b AS v, sim FROM sims WHERE sim>=0.35 UNION ALL SELECT b, a, sim FROM sims WHERE sim>=0.35),
dg AS (SELECT u, row_number() OVER (ORDER BY count(*) DESC, u) AS rk, list(v) AS near FROM e GROUP BY u),
walk AS (SELECT CAST(0 AS BIGINT) AS rk, CAST([] AS VARCHAR[]) AS seeds
  UNION ALL SELECT d.rk, CASE WHEN list_has_any(near, seeds) THEN seeds ELSE list_append(seeds, u) END FROM walk w JOIN dg d ON d.rk=w.rk+1),
sd AS (SELECT unnest(seeds) AS seed FROM (SELECT seeds FROM walk ORDER BY rk DESC LIMIT 1)),
fr AS (SELECT e.u AS sid, e.v AS seed, e.sim, row_number() OVER (PARTITION BY e.u ORDER BY k.rk) AS nth FROM e JOIN sd ON e.v=sd.seed JOIN dg k ON k.u=e.v
  WHERE e.u NOT IN (SELECT seed FROM sd)),
cl AS (SELECT seed, seed AS sid, CAST(1 AS DOUBLE) AS sim FROM sd UNION ALL SELECT seed, sid, sim FROM fr WHERE nth=1),
cs AS (SELECT *, count(*) OVER (PARTITION BY seed) AS size FROM cl)"""


@query("J5_topic_candidates", f"WITH RECURSIVE {_SEEDS} SELECT seed, sid, round(sim, 3) AS sim, size FROM cs WHERE size>=2")
def topic_candidates(spark, d):
    clusters = J.candidate_clusters(_features(spark, d))
    return clusters.select("seed", "sid", "sim", "size")


@query(
    "J5_cluster_keywords",
    f"""WITH RECURSIVE {_SEEDS}, kw AS (SELECT seed, gram, count(*) AS n FROM cs JOIN al USING (sid) WHERE size>=2 AND regexp_matches(gram, '^[\u4e00-\u9fffA-Za-z]{{2,}}$') GROUP BY ALL),
rn AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, gram) AS nth FROM kw) SELECT seed, gram, n, CAST(nth AS INTEGER) AS rank FROM rn WHERE nth<=5""",
)
def cluster_keywords(spark, d):
    features = _features(spark, d)
    return J.cluster_keywords(J.candidate_clusters(features), features)


@query(
    "D8_topic_hint",
    f"""WITH {D.INTRO}, p AS (SELECT sid, concat(title, ' ', left(first_user, 120)) AS probe FROM titled),
h AS (SELECT p.sid, topic_id, keyword, row_number() OVER (PARTITION BY p.sid ORDER BY length(keyword) DESC, concat('topic ', topic_id), keyword) AS rn
  FROM p JOIN tkeywords ON contains(probe, keyword))
SELECT sid, concat('topic ', topic_id) AS topic, keyword FROM h WHERE rn=1""",
)
def topic_hint(spark, d):
    from tracewell.operators import classify as K

    return K.topic_hints(D.titled(spark, d), D.topics(spark, d))


@query(
    "D9_patterns_known_by_cards",
    f"""WITH {D.CARDS}, k AS (SELECT item_id, text AS key FROM benchmark),
c AS (SELECT trim(regexp_replace(lower(concat(title, chr(10), evidence, chr(10), summary)), '\\s+', ' ', 'g')) AS body FROM cards)
SELECT item_id, key, EXISTS (SELECT 1 FROM c WHERE contains(body, trim(regexp_replace(lower(key), '\\s+', ' ', 'g')))) AS known_card FROM k""",
)
def patterns_known(spark, d):
    from tracewell.operators import classify as K

    keys = schemas.read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("key"))
    return K.known_by_cards(keys, D.cards(spark, d), "key")


@query(
    "J7_template_groups",
    f"""WITH {ERRORS} SELECT DISTINCT pattern, CASE WHEN pattern LIKE '%timed out%' OR pattern LIKE '%out of range%' THEN 0
WHEN pattern LIKE '%does not exist%' THEN 2 END AS root FROM errs""",
)
def template_groups(spark, d):
    errors = O.collect_errors(store.steps(spark, d), schemas.sessions_from_events(spark, d))
    return J.template_groups(O.pattern_stats(errors), O.pattern_samples(errors))


_TRIGGERS = """tr AS (SELECT DISTINCT concat('card-', doc_id) AS id, lower(w.word) AS word FROM (SELECT doc_id, string_split(split_part(text, chr(10), 1), ' ')[1:2] AS ws FROM documents) x,
  unnest(ws) w(word) WHERE trim(w.word)<>'')"""


def _triggered(spark, d):
    """Cards whose triggers are the first two words of the document."""
    words = F.slice(F.split(F.substring_index("text", "\n", 1), " "), 1, 2)
    return schemas.read_table(spark, d, "documents").select(
        F.concat(F.lit("card-"), "doc_id").alias("id"), words.alias("triggers")
    )


@query(
    "J8_confusable_triggers",
    f"""WITH {_TRIGGERS}, h AS (SELECT word, count(*) AS n FROM tr GROUP BY word)
SELECT x.word AS trigger, y.word AS other_trigger, x.n AS cards, y.n AS other_cards FROM h x JOIN h y ON contains(x.word, y.word) OR contains(y.word, x.word)
WHERE x.word<>y.word OR x.n>1""",
)
def confusable_triggers(spark, d):
    return J.confusable_triggers(_triggered(spark, d))


@query(
    "J9_duplicate_cards",
    f"""WITH {ERRORS}, k AS (SELECT lower(pattern) AS key, count(DISTINCT sid) AS sessions FROM errs GROUP BY 1),
c AS (SELECT concat('card-', sid, '-', seq) AS id, lower(concat('seen ', pattern, ' again')) AS body FROM errs WHERE bucket='closing')
SELECT key, sessions, count(*) AS n_cards, min(id) AS first_card FROM k JOIN c ON contains(body, key) GROUP BY key, sessions""",
)
def duplicate_cards(spark, d):
    errors = O.collect_errors(store.steps(spark, d), schemas.sessions_from_events(spark, d))
    cards = errors.filter(F.col("bucket") == "closing").select(
        F.concat(F.lit("card-"), "sid", F.lit("-"), "seq").alias("id"),
        F.lit("seen").alias("title"),
        F.col("pattern").alias("evidence"),
        F.lit("again").alias("summary"),
    )
    return J.duplicate_cards(cards, errors)
