"""Registry tables derived from the given tables, in Spark and in SQL.

Topics, noise, cards and ledgers are curated data in production.  Here they
follow from the content of the given tables, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import text
from tracewell.operators import sequence as Q
from tracewell.workloads.base import CONV_SESSIONS, MESSAGES

# Sessions and their topic: the first letter of the title; members have three or more user turns.
INTRO = (
    MESSAGES
    + ",\n"
    + CONV_SESSIONS
    + """,
intro AS (SELECT sid, arg_min(raw, seq) FILTER (WHERE role='user') AS first_user,
  count(*) FILTER (WHERE role='user') AS user_turns FROM messages GROUP BY sid),
titled AS (SELECT c.*, i.first_user, i.user_turns, lower(left(title,1)) AS letter FROM csessions c JOIN intro i USING (sid) WHERE title<>''),
tmembers AS (SELECT concat('t-', letter) AS topic_id, sid, left(title, 20) AS evidence, CAST(session_id AS INTEGER) AS pos
  FROM titled WHERE user_turns>=3),
topics AS (SELECT topic_id, concat('topic ', topic_id) AS name FROM tmembers GROUP BY topic_id),
tkeywords AS (SELECT DISTINCT concat('t-', letter) AS topic_id, split_part(title, ' ', 1) AS keyword FROM titled
  WHERE user_turns>=3 AND length(split_part(title, ' ', 1))>=2),
noise AS (SELECT sid, 'short opening' AS reason FROM titled WHERE length(first_user)<40)"""
)


def titled(spark, d):
    intro = Q.session_intro(schemas.messages_from_conversations(spark, d)).select("sid", "first_user", "user_turns")
    sessions = schemas.sessions_from_conversations(spark, d).filter(F.col("title") != "")
    return sessions.join(intro, "sid").withColumn("letter", F.lower(text.head("title", 1)))


def topic_members(spark, d, turns=3):
    return titled(spark, d).filter(F.col("user_turns") >= turns).select(
        F.concat(F.lit("t-"), "letter").alias("topic_id"),
        "sid",
        text.head("title", 20).alias("evidence"),
        F.col("session_id").cast("int").alias("pos"),
    )


def topics(spark, d):
    first_word = F.substring_index("title", " ", 1)
    return (
        titled(spark, d)
        .filter(F.col("user_turns") >= 3)
        .groupBy(F.concat(F.lit("t-"), "letter").alias("topic_id"))
        .agg(F.array_sort(F.collect_set(F.when(F.length(first_word) >= 2, first_word))).alias("keywords"))
        .select("topic_id", F.concat(F.lit("topic "), "topic_id").alias("name"), "keywords", F.lit("").alias("created"))
    )


def noise(spark, d):
    return titled(spark, d).filter(F.length("first_user") < 40).select(
        "sid", F.lit("short opening").alias("reason"), F.lit("").alias("created")
    )


# Status log of suggestions: one entry per order, keyed by customer.
LEDGER_LOG = """llog AS (SELECT concat('cust ', o_custkey) AS key,
  CASE o_orderstatus WHEN 'F' THEN 'adopted' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status,
  CASE WHEN o_orderpriority LIKE '1%' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS adopted_at,
  CASE WHEN o_orderpriority LIKE '2%' THEN '' WHEN o_orderpriority LIKE '3%' THEN concat('pattern: ', o_orderpriority) END AS note,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS updated_at, o_orderkey AS entry_no FROM orders)"""


def ledger_log(spark, d):
    day = F.to_date("o_orderdate").cast("string")
    return schemas.read_table(spark, d, "orders").select(
        F.concat(F.lit("cust "), "o_custkey").alias("key"),
        F.when(F.col("o_orderstatus") == "F", "adopted").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending").alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), day).alias("adopted_at"),
        F.when(F.col("o_orderpriority").startswith("2"), "")
        .when(F.col("o_orderpriority").startswith("3"), F.concat(F.lit("pattern: "), "o_orderpriority"))
        .alias("note"),
        day.alias("updated_at"),
        F.col("o_orderkey").alias("entry_no"),
    )


# Sessions of both kinds, and topics over the dated ones: one per model and source.
ALL_SESSIONS = """allsess AS (
  SELECT sid, source, session_id, title, created_at, updated_at, model FROM sessions
  UNION ALL SELECT sid, source, session_id, title, NULL, NULL, NULL FROM csessions),
emembers AS (SELECT concat('e-', source, '-', coalesce(model,'none')) AS topic_id, sid FROM sessions)"""


def all_sessions(spark, d):
    return schemas.sessions_from_events(spark, d).unionByName(schemas.sessions_from_conversations(spark, d))


def dated_members(spark, d):
    return schemas.sessions_from_events(spark, d).select(
        F.concat(F.lit("e-"), "source", F.lit("-"), F.coalesce("model", F.lit("none"))).alias("topic_id"), "sid"
    )


# Cards written from documents.
CARDS = r"""cards AS (SELECT concat('card-', doc_id) AS id, left(split_part(text, chr(10), 1), 60) AS title,
  CASE WHEN lang='en' THEN 'pitfall' WHEN lang='fr' THEN 'insight' WHEN lang='de' THEN 'howto' ELSE 'misc' END AS type,
  concat('conv:', n_chars % 150) AS session_id, CAST(CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars % 7 END AS INTEGER) AS turn,
  text AS evidence, CASE WHEN n_chars>200 THEN left(text, 30) ELSE '' END AS summary,
  n_chars/1000.0 AS confidence, CAST(CAST('2023-12-01' AS DATE) + CAST(n_chars % 75 AS INTEGER) AS VARCHAR) AS created
  FROM documents)"""


def cards(spark, d):
    n = F.col("n_chars")
    anchor = F.struct(
        F.concat(F.lit("conv:"), n % 150).alias("session_id"), F.when(n % 7 != 0, n % 7).cast("int").alias("turn")
    )
    return schemas.read_table(spark, d, "documents").select(
        F.concat(F.lit("card-"), "doc_id").alias("id"),
        text.head(F.substring_index("text", "\n", 1), 60).alias("title"),
        F.when(F.col("lang") == "en", "pitfall").when(F.col("lang") == "fr", "insight").when(F.col("lang") == "de", "howto").otherwise("misc").alias("type"),
        F.array(anchor).alias("anchors"),
        F.col("text").alias("evidence"),
        F.when(n > 200, text.head("text", 30)).otherwise("").alias("summary"),
        (n / 1000.0).alias("confidence"),
        F.date_add(F.lit("2023-12-01").cast("date"), (n % 75).cast("int")).cast("string").alias("created"),
        F.lit("").alias("topic_id"),
    )
