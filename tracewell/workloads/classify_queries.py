"""Queries over classification, triage, evaluation and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas, store
from tracewell.functions import rules as RU
from tracewell.operators import classify as K
from tracewell.operators import sequence as Q
from tracewell.operators import similarity as J
from tracewell.operators import steps as O
from tracewell.workloads import derived as D
from tracewell.workloads.base import ERRORS, MONTH_CUTOFF, SESSIONS, STEPS, TOOLS, query
from tracewell.workloads.sequence_queries import INVOCATIONS

_RULE = """CASE WHEN error LIKE '%timed out%' THEN 'net-timeout' WHEN error LIKE '%out of range%' THEN 'bad-range'
  WHEN error LIKE '%does not exist%' THEN 'missing-target' END"""


# the part of ERRORS after steps and sessions
_ERROR_TAIL = ERRORS.split(SESSIONS + ",", 1)[1]


def _errors(spark, d):
    return O.collect_errors(store.steps(spark, d), schemas.sessions_from_events(spark, d))


def _invocations(spark, d):
    return Q.skill_invocations(store.steps(spark, d), schemas.sessions_from_events(spark, d))


@query("K1_error_class", f"WITH {ERRORS} SELECT error, class FROM errs")
def error_class(spark, d):
    rows = store.steps(spark, d).filter(F.col("status") == "error")
    return rows.select("error", RU.error_class(F.col("error")).alias("class"))


#: Ordered fallback families for errors that no rule matches; the first that matches counts, and the first two overlap.
_FAMILIES = (("many_codes", (r"code 1\d", r"code 2")), ("low_code", (r"code [0-3]",)), ("files", ("cannot open",)))


@query(
    "K1_error_families",
    f"""WITH {STEPS} SELECT error, CASE WHEN regexp_matches(error, 'timed out') THEN 'env'
 WHEN regexp_matches(error, 'code 1\\d') OR regexp_matches(error, 'code 2') THEN 'many_codes' WHEN regexp_matches(error, 'code [0-3]') THEN 'low_code'
 WHEN regexp_matches(error, 'cannot open') THEN 'files' ELSE 'unclassified' END AS class FROM steps WHERE status='error'""",
)
def error_families(spark, d):
    """Rules first, then families in their order."""
    rows = store.steps(spark, d).filter(F.col("status") == "error")
    rules = [r for r in RU.DEFAULT_RULES if any("timed out" in m for m in r.match)]
    return rows.select("error", RU.error_class(F.col("error"), rules, _FAMILIES).alias("class"))


@query(
    "G6_pattern_union",
    f"""WITH {ERRORS}, t AS (SELECT DISTINCT tool AS key, unnest([pattern, left(pattern, 30), substr(pattern, 12)]) AS target FROM errs),
p AS (SELECT pattern, count(*) AS n FROM errs GROUP BY pattern),
h AS (SELECT DISTINCT key, pattern, n FROM t JOIN p ON target=pattern OR length(target)>=8 AND length(pattern)>=8 AND (contains(pattern, target) OR contains(target, pattern)))
SELECT key, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS errors FROM h GROUP BY key""",
)
def pattern_union(spark, d):
    """All patterns of a tool's errors, their beginnings and ends: many of them hit the same errors."""
    errors = _errors(spark, d)
    parts = F.array("pattern", F.substring("pattern", 1, 30), F.expr("substring(pattern, 12)"))
    return K.pattern_union(errors.select(F.col("tool").alias("key"), F.explode(parts).alias("target")), errors)


@query("K2_attribution", f"WITH {ERRORS} SELECT sid, seq, {_RULE} AS rule_id, class, left({_RULE}, 3) AS short FROM errs")
def attribution(spark, d):
    rows = K.attribute(store.steps(spark, d).filter(F.col("status") == "error"))
    return rows.select(
        "sid", "seq", "rule.rule_id", F.col("rule.class").alias("class"), F.substring("rule.rule_id", 1, 3).alias("short")
    )


@query(
    "K3_attribution_summary",
    f"""WITH {ERRORS} SELECT pattern, min(class) AS class, count(*) AS n_errors, count(*) FILTER (WHERE NOT resolved) AS given_up,
string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, min({_RULE}) AS rule_id, min({_RULE}) AS rule_ids, false AS conflict FROM errs GROUP BY pattern""",
)
def attribution_summary(spark, d):
    return K.attribution_summary(_errors(spark, d)).select(
        "pattern",
        "class",
        F.col("count").alias("n_errors"),
        "given_up",
        F.array_join("tools", ",").alias("tools"),
        "rule.rule_id",
        F.array_join("rule_ids", ",").alias("rule_ids"),
        "conflict",
    )


@query(
    "K3_attribution_anchors",
    f"""WITH {ERRORS}, r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY sid, seq) AS rn FROM errs)
SELECT pattern, CAST(rn AS INTEGER) AS rank, sid, seq, trim(error) AS error FROM r WHERE rn<=5""",
)
def attribution_anchors(spark, d):
    return K.attribution_anchors(_errors(spark, d))


@query(
    "K4_attribution_totals",
    f"""WITH {ERRORS}, p AS (SELECT pattern, count(*) AS n, min({_RULE}) AS rule FROM errs GROUP BY pattern)
SELECT count(*) AS patterns_total, count(rule) AS patterns_attributed, CAST(sum(n) AS BIGINT) AS errors_total,
CAST(sum(n) FILTER (WHERE rule IS NOT NULL) AS BIGINT) AS errors_attributed, count(DISTINCT rule) AS rules_hit, CAST(5 AS BIGINT) AS rules_total,
round(count(rule)*100.0/count(*),1) AS pct_patterns, round(sum(n) FILTER (WHERE rule IS NOT NULL)*100.0/sum(n),1) AS pct_errors FROM p""",
)
def attribution_totals(spark, d):
    return K.attribution_totals(K.attribution_summary(_errors(spark, d)))


@query(
    "K4_reviewed_rows",
    f"""WITH {ERRORS} SELECT pattern, count(*) AS n_errors, CASE WHEN count(*) FILTER (WHERE NOT resolved)*9 > count(*) THEN 'accepted' END AS verdict
FROM errs GROUP BY pattern""",
)
def reviewed_rows(spark, d):
    summary = K.attribution_summary(_errors(spark, d))
    verdicts = summary.filter(F.col("given_up") * 9 > F.col("count")).select(
        F.col("pattern").alias("pattern_key"), "rule.rule_id", F.lit("accepted").alias("verdict")
    )
    return K.split_reviewed(summary, verdicts).select("pattern", F.col("count").alias("n_errors"), "verdict")


_SUGGEST = f"""{ERRORS}, ps AS (SELECT pattern, count(*) AS n, count(*) FILTER (WHERE NOT resolved) AS g FROM errs GROUP BY pattern),
gr AS (SELECT *, CASE WHEN pattern LIKE '%timed out%' OR pattern LIKE '%out of range%' THEN 0 WHEN pattern LIKE '%does not exist%' THEN 2 END AS root FROM ps),
sg AS (SELECT root, CASE root WHEN 0 THEN 'Check the file before opening it' ELSE 'List the folder before opening a file' END AS title,
  'agent' AS owner, CAST(sum(n) AS BIGINT) AS total, CAST(sum(g) AS BIGINT) AS unresolved_count FROM gr WHERE root IS NOT NULL GROUP BY root)"""


def _group_totals(spark, d):
    errors = _errors(spark, d)
    stats, samples = O.pattern_stats(errors), O.pattern_samples(errors)
    groups = J.template_groups(stats, samples)
    return stats, groups, J.group_titles(stats, groups, samples)


@query(
    "K6_suggestions",
    f"""WITH {_SUGGEST} SELECT title, root, owner, total, unresolved_count, CASE WHEN root=0 THEN 'adopted' ELSE 'pending' END AS status FROM sg WHERE total>=3""",
)
def suggestions(spark, d):
    _, _, totals = _group_totals(spark, d)
    statuses = totals.filter(F.col("root") == 0).select(F.col("title").alias("key"), F.lit("adopted").alias("status"))
    return K.suggestions(totals, statuses)


@query(
    "K6_leftover_patterns",
    f"""WITH {_SUGGEST} SELECT pattern, n AS n_errors, g AS given_up FROM gr WHERE root IS DISTINCT FROM 0""",
)
def leftover_patterns(spark, d):
    """With the first two templates only, so that something is left."""
    errors = _errors(spark, d)
    stats = O.pattern_stats(errors)
    groups = J.template_groups(stats, O.pattern_samples(errors), RU.DEFAULT_TEMPLATES[:2])
    return K.leftover_patterns(stats, groups).withColumnRenamed("count", "n_errors")


@query(
    "D11_ledger_coverage",
    f"""WITH {D.LEDGER_LOG}, s AS (SELECT DISTINCT concat('cust ', c_custkey) AS key FROM customer),
l AS (SELECT key, arg_max(status, (updated_at, entry_no)) AS status FROM llog GROUP BY key)
SELECT coalesce(s.key, l.key) AS key, l.status, CASE WHEN s.key IS NOT NULL AND coalesce(l.status,'pending')<>'pending' THEN 'decided'
 WHEN s.key IS NOT NULL THEN 'undecided' WHEN l.status='adopted' THEN 'stale_adopted' ELSE 'stale_other' END AS place
FROM s FULL JOIN l ON s.key=l.key""",
)
def ledger_coverage(spark, d):
    suggested = schemas.read_table(spark, d, "customer").select(F.concat(F.lit("cust "), "c_custkey").alias("title"))
    ledger = D.ledger_log(spark, d).groupBy("key").agg(F.max_by("status", F.struct("updated_at", "entry_no")).alias("status"))
    return K.ledger_coverage(suggested, ledger)


@query(
    "K7_triage_patterns",
    f"""WITH {ERRORS} SELECT pattern, min(class) AS class, min(ts) AS first_seen, count(*) FILTER (WHERE ts>='{MONTH_CUTOFF}') AS n_errors,
string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, CASE WHEN min(ts)>='{MONTH_CUTOFF}' THEN 'new' ELSE 'recurring' END AS kind FROM errs GROUP BY pattern""",
)
def triage_patterns(spark, d):
    out = K.triage_patterns(_errors(spark, d), MONTH_CUTOFF)
    return out.withColumn("tools", F.array_join("tools", ",")).withColumnRenamed("count", "n_errors")


@query(
    "K7_triage_skills",
    f"""WITH {INVOCATIONS} SELECT skill, count(*) AS n_calls, count(*) FILTER (WHERE status='completed') AS n_ok,
string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(concat(sid, '#', printf('%09d', seq))) FILTER (WHERE status='completed') AS sample,
arg_min(chain, (sid, seq)) FILTER (WHERE status='completed' AND chain<>'') AS chain FROM invs WHERE ts>='{MONTH_CUTOFF}' GROUP BY skill""",
)
def triage_skills(spark, d):
    out = K.triage_skills(_invocations(spark, d), MONTH_CUTOFF)
    return out.withColumn("sources", F.array_join("sources", ",")).withColumn("chain", F.array_join("chain", "→"))


_LOOKUP, _INTEGRATE, _CRAFT = ("that", "nicht", "une"), ("eron", "ungen"), ("hash", "elle")


def _triage(spark, d, deep=True):
    return K.intent_triage(
        D.titled(spark, d),
        schemas.messages_from_conversations(spark, d),
        D.topics(spark, d),
        D.topic_members(spark, d, turns=4),  # the registry: sessions of four turns and more are assigned
        D.noise(spark, d),
        lookup_words=_LOOKUP,
        integrate_words=_INTEGRATE,
        craft_words=_CRAFT,
        max_turns=2,
        include_deep=deep,
        coherence=False,  # no query shows it
    )


def _any(words):
    return "(" + " OR ".join(f"contains(first_user, '{w}')" for w in words) + ")"


TRIAGE = f"""{D.INTRO}, hh AS (SELECT t.sid, topic_id, keyword, row_number() OVER (PARTITION BY t.sid ORDER BY length(keyword) DESC, topic_id, keyword) AS rn
  FROM titled t JOIN tkeywords ON contains(concat(title, ' ', left(first_user, 120)), keyword)),
tri AS (SELECT t.sid, source, left(title, 44) AS title, left(first_user, 200) AS first_user, concat('topic ', topic_id) AS topic,
  {_any(_LOOKUP)} AS lookup, {_any(_INTEGRATE)} AS integrate, {_any(_CRAFT)} AS craft, user_turns AS turns,
  CASE WHEN user_turns>2 THEN CASE WHEN topic_id IS NOT NULL THEN 'deep_topic_hint' ELSE 'deep_unassigned' END
   WHEN topic_id IS NOT NULL THEN 'topic_hint' WHEN {_any(_INTEGRATE)} THEN 'substantive' WHEN {_any(_CRAFT)} THEN 'craft_material'
   WHEN {_any(_LOOKUP)} AND user_turns=1 THEN 'noise_high' WHEN {_any(_LOOKUP)} THEN 'noise_maybe' ELSE 'substantive' END AS verdict
  FROM titled t LEFT JOIN hh ON hh.sid=t.sid AND rn=1
  WHERE t.sid NOT IN (SELECT sid FROM titled WHERE user_turns>=4) AND t.sid NOT IN (SELECT sid FROM noise))"""


@query(
    "K8_intent_triage",
    f"""WITH {TRIAGE} SELECT sid, source, title, first_user, verdict, CASE WHEN topic='topic ' THEN NULL ELSE topic END AS topic, lookup, integrate, craft, turns FROM tri""",
)
def intent_triage(spark, d):
    return _triage(spark, d).drop("coherence", "created_at")


@query(
    "K9_noise_candidates",
    f"""WITH {D.INTRO} SELECT t.sid, title, first_user FROM titled t WHERE user_turns=1 AND length(trim(first_user))<200 AND t.sid NOT IN (SELECT sid FROM tmembers)""",
)
def noise_candidates(spark, d):
    return K.noise_candidates(
        D.titled(spark, d), schemas.messages_from_conversations(spark, d), store.steps(spark, d), D.topic_members(spark, d), 200
    )


def _adopted(spark, d):
    """One entry per error pattern and tool, adopted at the tool's hundredth part of its history."""
    errors = _errors(spark, d)
    cut = F.concat(F.date_add(F.to_date(F.min("ts")), 12).cast("string"), F.lit(" 06:00:00"))
    return errors.groupBy("pattern", "tool").agg(cut.alias("adopted_at")).select(
        F.concat("tool", F.lit(" "), "pattern").alias("key"),
        F.lit("adopted").alias("status"),
        "adopted_at",
        F.when(F.col("tool") == "Skill", F.concat(F.lit("pattern: "), F.substring("pattern", 1, 22))).alias("note"),
        F.lit("2024-01-20").alias("updated_at"),
    )


_EVAL = f"""{ERRORS},
ent AS (SELECT concat(tool, ' ', pattern) AS key, tool='Skill' AS from_note, pattern,
  CAST(concat(CAST(CAST(min(ts)[1:10] AS DATE)+12 AS VARCHAR), ' 06:00:00') AS TIMESTAMP) AS b FROM errs GROUP BY tool, pattern),
win AS (SELECT key, from_note, pattern, strftime(b, '%Y-%m-%d %H:%M:%S') AS boundary, strftime(b - INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS lo,
  strftime(b + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS hi FROM ent),
hit AS (SELECT w.*, e.sid, e.ts, e.resolved FROM win w JOIN errs e ON (from_note AND contains(e.pattern, replace(left(w.pattern, 22), '"', '')) OR NOT from_note AND e.pattern=w.pattern)),
ses AS (SELECT key, sid, CASE WHEN ts<boundary THEN 'before' ELSE 'after' END AS side, count(*) AS n, count(*) FILTER (WHERE NOT resolved) AS o
  FROM hit WHERE ts>=lo AND ts<hi GROUP BY ALL),
cnt AS (SELECT key, CAST(coalesce(sum(n) FILTER (WHERE side='before'),0) AS BIGINT) AS be, CAST(coalesce(sum(o) FILTER (WHERE side='before'),0) AS BIGINT) AS bu,
  count(*) FILTER (WHERE side='before') AS bs, count(*) FILTER (WHERE side='before' AND n>=2) AS br,
  CAST(coalesce(sum(n) FILTER (WHERE side='after'),0) AS BIGINT) AS ae, CAST(coalesce(sum(o) FILTER (WHERE side='after'),0) AS BIGINT) AS au,
  count(*) FILTER (WHERE side='after') AS "as", count(*) FILTER (WHERE side='after' AND n>=2) AS ar FROM ses GROUP BY key),
tot AS (SELECT key, count(*) AS pattern_hits FROM hit GROUP BY key),
rat AS (SELECT *, bu/nullif(be,0) AS ub, au/nullif(ae,0) AS ua, br/nullif(bs,0) AS rb, ar/nullif("as",0) AS ra FROM cnt),
chg AS (SELECT *, CASE WHEN ub=0 THEN CASE WHEN ua<=0 THEN 0.0 ELSE 1.0 END ELSE (ua-ub)/ub END AS du,
  CASE WHEN rb=0 THEN CASE WHEN ra<=0 THEN 0.0 ELSE 1.0 END ELSE (ra-rb)/rb END AS dr FROM rat)"""


@query(
    "K10_rule_evaluation",
    f"""WITH {_EVAL} SELECT w.key, boundary, from_note, pattern_hits, be AS before_errors, bu AS before_unresolved, ae AS after_errors, au AS after_unresolved,
bs AS before_sessions, br AS before_recurred, "as" AS after_sessions, ar AS after_recurred, round(du,6) AS delta,
CASE WHEN be<5 OR ae<5 OR be+ae<20 THEN 'inconclusive' WHEN coalesce(du>=0.1-1e-9,false) OR coalesce(dr>=0.1-1e-9,false) THEN 'worsened'
 WHEN coalesce(du<=-(0.1-1e-9),false) OR coalesce(dr<=-(0.1-1e-9),false) THEN 'improved' ELSE 'unchanged' END AS verdict
FROM win w JOIN chg USING (key) JOIN tot USING (key)""",
)
def rule_evaluation(spark, d):
    ledger = _adopted(spark, d)
    # the entry's own pattern is its target unless the note names one
    errors = _errors(spark, d)
    plain = ledger.withColumn(
        "note", F.coalesce("note", F.concat(F.lit("pattern: "), F.expr("substring(key, instr(key, ' ') + 1)")))
    )
    out = K.evaluate_rules(plain, errors)
    return out.select(
        "key",
        "boundary",
        F.col("key").startswith("Skill").alias("from_note"),
        "pattern_hits",
        *[f"{s}_{n}" for s in ("before", "after") for n in ("errors", "unresolved", "sessions", "recurred")],
        F.round("delta", 6).alias("delta"),
        "verdict",
    )


@query(
    "K11_review_levels",
    f"""WITH {ERRORS}, t AS (SELECT tool, count(*) AS entries, count(*) FILTER (WHERE class='env') AS candidates FROM errs GROUP BY tool)
SELECT tool, CASE WHEN entries<=0 THEN 'R0' WHEN candidates<=0 THEN 'R1' WHEN tool='Skill' THEN 'R3' ELSE 'R2' END AS level FROM t""",
)
def review_levels(spark, d):
    counts = _errors(spark, d).groupBy("tool").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("class") == "env").alias("candidates")
    )
    return counts.select("tool", K.review_level(F.col("entries"), F.col("candidates"), F.col("tool") == "Skill").alias("level"))


@query(
    "K12_review_pack",
    f"""WITH {INVOCATIONS}, {TOOLS}, {_ERROR_TAIL},
p AS (SELECT pattern, count(*) AS n, min({_RULE}) AS rule FROM errs GROUP BY pattern),
sk AS (SELECT skill, count(*) AS calls FROM invs GROUP BY skill)
SELECT concat('E-', lpad(CAST(row_number() OVER (ORDER BY n DESC, pattern) AS VARCHAR), 3, '0')) AS item_id, 'errors' AS face, pattern AS subject, rule AS rule_id FROM p
UNION ALL SELECT concat('T-', lpad(CAST(row_number() OVER (ORDER BY error DESC, tool) AS VARCHAR), 3, '0')), 'tools', tool,
  CASE WHEN regexp_matches(tool, '^tool_[0-9]+$') THEN 'tool-misuse' END FROM tools WHERE error>0
UNION ALL SELECT concat('S-', lpad(CAST(row_number() OVER (ORDER BY calls DESC, skill) AS VARCHAR), 3, '0')), 'skills', skill,
  CASE WHEN skill IN ('sk0','sk1') THEN 'skill-fails' END FROM sk""",
)
def review_pack(spark, d):
    steps = store.steps(spark, d)
    pack = K.review_pack(
        K.attribution_summary(_errors(spark, d)),
        O.merge_aliases(O.tool_stats(steps)),
        Q.skill_summary(_invocations(spark, d)),
    )
    return pack.select("item_id", "face", "subject", "rule_id")


@query(
    "K12_pack_check",
    """WITH i AS (SELECT concat('I-', o_orderkey) AS item_id, o_orderpriority AS subject FROM orders WHERE o_orderstatus<>'P'),
s AS (SELECT concat('I-', o_orderkey) AS item_id, CASE WHEN o_orderpriority LIKE '5%' THEN 'other' ELSE o_orderpriority END AS subject,
 CASE WHEN o_orderpriority LIKE '4%' THEN 'maybe' ELSE 'accepted' END AS verdict FROM orders WHERE o_orderstatus<>'F')
SELECT s.item_id, 'slot without item' AS problem FROM s WHERE s.item_id NOT IN (SELECT item_id FROM i)
UNION ALL SELECT i.item_id, 'item without slot' FROM i WHERE i.item_id NOT IN (SELECT item_id FROM s)
UNION ALL SELECT s.item_id, 'subject differs' FROM s JOIN i USING (item_id) WHERE i.subject<>s.subject
UNION ALL SELECT s.item_id, 'unknown verdict' FROM s WHERE verdict='maybe'""",
)
def pack_check(spark, d):
    orders = schemas.read_table(spark, d, "orders").withColumn("item_id", F.concat(F.lit("I-"), "o_orderkey"))
    items = orders.filter(F.col("o_orderstatus") != "P").select("item_id", F.col("o_orderpriority").alias("subject"))
    slots = orders.filter(F.col("o_orderstatus") != "F").select(
        "item_id",
        F.when(F.col("o_orderpriority").startswith("5"), "other").otherwise(F.col("o_orderpriority")).alias("subject"),
        F.when(F.col("o_orderpriority").startswith("4"), "maybe").otherwise("accepted").alias("verdict"),
    )
    return K.check_pack(items, slots)


_DERIVED = "dr AS (SELECT concat('cust ', c_custkey) AS key, CASE WHEN c_mktsegment<>'BUILDING' THEN '2020-01-01' END AS adopted_at FROM customer)"


def _customer_rows(spark, d):
    return schemas.read_table(spark, d, "customer").select(
        F.concat(F.lit("cust "), "c_custkey").alias("key"),
        F.lit("adopted").alias("status"),
        F.when(F.col("c_mktsegment") != "BUILDING", "2020-01-01").alias("adopted_at"),
        F.lit(None).cast("string").alias("note"),
    )


def _latest_ledger(spark, d):
    place = F.struct("updated_at", "entry_no")
    return D.ledger_log(spark, d).groupBy("key").agg(
        F.max_by(F.struct("status", "adopted_at", "note", "updated_at"), place).alias("r")
    ).select("key", "r.*")


_LATEST = "lt AS (SELECT key, arg_max({'s': status, 'a': adopted_at, 'u': updated_at}, (updated_at, entry_no)) AS r FROM llog GROUP BY key)"


@query(
    "K13_ledger_sync",
    f"""WITH {D.LEDGER_LOG}, {_LATEST}, {_DERIVED}
SELECT dr.key, CASE WHEN lt.key IS NULL THEN 'created' WHEN coalesce(r.a,'')='' AND dr.adopted_at IS NOT NULL THEN 'filled' ELSE 'unchanged' END AS action
FROM dr LEFT JOIN lt ON lt.key=dr.key""",
)
def ledger_sync(spark, d):
    return K.ledger_sync(_latest_ledger(spark, d), _customer_rows(spark, d)).select("key", "action")


@query(
    "K13_apply_sync",
    f"""WITH {D.LEDGER_LOG}, {_LATEST}, {_DERIVED}
SELECT lt.key, r.s AS status, CASE WHEN coalesce(r.a,'')='' AND dr.adopted_at IS NOT NULL AND r.s='adopted' THEN dr.adopted_at ELSE r.a END AS adopted_at FROM lt LEFT JOIN dr USING (key)
UNION ALL SELECT key, 'adopted', adopted_at FROM dr WHERE key NOT IN (SELECT key FROM lt)""",
)
def apply_sync(spark, d):
    return K.apply_sync(_latest_ledger(spark, d), _customer_rows(spark, d), "2024-02-01 00:00:00").select("key", "status", "adopted_at")


@query(
    "K13_backfill",
    f"""WITH {D.LEDGER_LOG}, {_LATEST} SELECT key, r.s AS status, CASE WHEN r.s='adopted' AND coalesce(r.a,'')='' THEN r.u ELSE r.a END AS adopted_at FROM lt""",
)
def backfill(spark, d):
    return K.backfill_adopted_at(_latest_ledger(spark, d)).select("key", "status", "adopted_at")


@query(
    "B5_ledger_upsert",
    f"""WITH {D.LEDGER_LOG}, o AS (SELECT *, max(CASE WHEN status<>'adopted' THEN printf('%s %012d', updated_at, entry_no) END) OVER (PARTITION BY key) AS brk FROM llog),
l AS (SELECT key, arg_max(status, (updated_at, entry_no)) AS status, max(updated_at) AS updated_at,
  arg_max(note, (updated_at, entry_no)) FILTER (WHERE note IS NOT NULL) AS note,
  coalesce(arg_max(adopted_at, (updated_at, entry_no)) FILTER (WHERE adopted_at IS NOT NULL AND (brk IS NULL OR printf('%s %012d', updated_at, entry_no)>brk)),
    min(updated_at) FILTER (WHERE brk IS NULL OR printf('%s %012d', updated_at, entry_no)>brk)) AS ad FROM o GROUP BY key)
SELECT key, status, CASE WHEN status='adopted' THEN ad END AS adopted_at, note, updated_at FROM l""",
)
def ledger_upsert(spark, d):
    log = D.ledger_log(spark, d)
    return K.ledger_upsert(log.drop("entry_no").filter(F.lit(False)), log)


@query(
    "B5_verdict_upsert",
    """WITH v AS (SELECT concat('f', l_linenumber) AS face, concat('p', l_partkey) AS subject, l_returnflag AS key, l_linestatus AS verdict, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS reviewed_at FROM lineitem)
SELECT face, subject, key, max(reviewed_at) AS reviewed_at, arg_max(verdict, (reviewed_at, verdict)) AS verdict FROM v GROUP BY ALL""",
)
def verdict_upsert(spark, d):
    rows = schemas.read_table(spark, d, "lineitem").select(
        F.concat(F.lit("f"), "l_linenumber").alias("face"),
        F.concat(F.lit("p"), "l_partkey").alias("subject"),
        F.col("l_returnflag").alias("key"),
        F.col("l_linestatus").alias("verdict"),
        F.to_date("l_shipdate").cast("string").alias("reviewed_at"),
    )
    old, new = rows.filter(F.col("reviewed_at") < "1995-06-17"), rows.filter(F.col("reviewed_at") >= "1995-06-17")
    return K.upsert_verdicts(old, new)
