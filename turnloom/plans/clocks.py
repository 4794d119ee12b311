"""Queries over timed turns and event tracks, text helpers and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.functions.numeric import round_n
from turnloom.operators import align as A
from turnloom.operators import signals as S
from turnloom.operators.index import within_person_z
from turnloom.operators.store import cascade_delete, insert_new, latest_wins, next_number, upsert
from turnloom.plans.fixtures import CORPUS, corpus_turns, space_words, sql_round as R, sql_space_words
from turnloom.session import table


def _timed(spark, sf_dir):
    t = table(spark, sf_dir, "aligned_turns").where("start_s >= 0 and not isnan(start_s) and not isnan(end_s) and end_s > start_s")
    return latest_wins(t, ["session_id", "idx"], F.asc("start_s"), F.asc("end_s")).select("session_id", "idx", "speaker", "start_s", "end_s", "process_mean")


def _points(spark, sf_dir):
    """A point every 20 seconds of each session."""
    far = _timed(spark, sf_dir).groupBy("session_id").agg(F.max("end_s").alias("far"))
    return far.select("session_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("far") / 20).cast("int") + 1)).alias("k")).select("session_id", (F.col("k") * 20.0).cast("double").alias("t"))


def align_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus_turns(spark, sf_dir).withColumns({"words": space_words(F.col("text")), "duration": F.lit(600.0)})
    p = A.proportional_times(t, "transcript_id", order="idx", words="words", duration="duration")
    return p.select("transcript_id", "idx", round_n(F.col("start_s"), 4).alias("start_s"), round_n(F.col("end_s"), 4).alias("end_s"))


def align_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _timed(spark, sf_dir).withColumns({"stamp": F.when(F.col("idx") % 3 == 1, F.col("start_s")), "duration": F.lit(900.0)})
    p = A.interpolated_times(t.drop("start_s", "end_s"), "session_id", order="idx", stamp="stamp", duration="duration")
    return p.select("session_id", "idx", round_n(F.col("start_s"), 4).alias("start_s"), round_n(F.col("end_s"), 4).alias("end_s"))


def moment_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.containing_interval(_points(spark, sf_dir), _timed(spark, sf_dir), "session_id")


def moment_near_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nearest_interval(_points(spark, sf_dir), _timed(spark, sf_dir), "session_id")
    return n.select("session_id", "t", round_n(F.col("gap"), 4).alias("gap"))


def _track(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy("user_id", F.unix_timestamp("ts").alias("t")).agg(F.max("value").alias("v"), F.min("value").alias("u"))


def event_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.outlier_episodes(_track(spark, sf_dir), "user_id", t="t", value="v", min_s=60.0)


def event_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arc(_track(spark, sf_dir), "user_id", t="t", value="v")


def event_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.moments(_track(spark, sf_dir), "user_id", t="t", tracks=("v", "u"))


def within_label_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("embedding")).alias("x"), (F.col("vec_id") % 2 == 0).alias("base"))
    return within_person_z(e, "label", "x", "base").select("vec_id", "label", "x_z")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), round_n(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def document_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.script_language(F.col("text")).alias("script_lang"))


def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.numbers_in(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(n).alias("n_numbers"), F.aggregate(n, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("sum_numbers"))


def number_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a document that are not among 0..12."""
    allowed = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: i.cast("string"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(X.unsupported_numbers(F.col("text"), allowed)).alias("n_unsupported"))


def document_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.clean_excerpt(F.col("text")).alias("excerpt"))


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(X.sentence_list(F.col("text"))).alias("n_sentences"))


def turn_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).select("session_id", "idx", X.clock(F.col("start_s")).alias("clock"))


def measure_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd ids as the stored table, even ids as corrections of the same client, session and instrument."""
    m = table(spark, sf_dir, "measures").distinct()
    keys = ["client_id", "session_number", "instrument"]
    old = latest_wins(m.where("id % 2 = 1"), keys, F.desc("recorded_at"), F.desc("id"))
    new = latest_wins(m.where("id % 2 = 0"), keys, F.desc("recorded_at"), F.desc("id"))
    return upsert(old, new, keys)


def client_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clients put into a table that holds those with a therapist already."""
    c = table(spark, sf_dir, "clients").select("id", "code", "therapist_code").distinct()
    return insert_new(c.where("therapist_code is not null").drop("therapist_code"), c.drop("therapist_code"), "id")[0]


def deleted_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left per table once all clients without a therapist code are gone."""
    gone = table(spark, sf_dir, "clients").where("therapist_code is null").select("id")
    names = (("clients", "id"), ("transcripts", "client_id"), ("measures", "client_id"))
    left = cascade_delete(gone, "id", *[(table(spark, sf_dir, n), c) for n, c in names])
    out = None
    for (n, _), df in zip(names, left):
        one = df.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(n).alias("table_name"), "n_left")
        out = one if out is None else out.union(one)
    return out


def client_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per client with the number of sessions and measures, without a look-up per client."""
    c = table(spark, sf_dir, "clients").groupBy("id").agg(F.min("code").alias("code"))
    s = table(spark, sf_dir, "transcripts").groupBy(F.col("client_id").alias("id")).agg(F.count_distinct("session_number").alias("n_sessions"))
    m = table(spark, sf_dir, "measures").groupBy(F.col("client_id").alias("id")).agg(F.count_distinct("id").alias("n_measures"))
    return c.join(s, "id", "left").join(m, "id", "left").fillna(0, ["n_sessions", "n_measures"])


def next_session_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_number(table(spark, sf_dir, "transcripts"), "client_id", "session_number")


_names = """align_proportional align_interpolated moment_in_turn moment_near_turn event_episodes event_arc event_moments within_label_z event_windows document_scripts document_numbers number_gate
document_excerpts document_sentences turn_clocks measure_upsert client_insert deleted_clients client_summary next_session_number""".split()
QUERIES = {n: globals()[n] for n in _names}

_TIMED = """timed AS (SELECT session_id, idx, speaker, start_s, end_s FROM (SELECT *, row_number() OVER (PARTITION BY session_id, idx ORDER BY start_s, end_s) AS rn FROM aligned_turns
  WHERE start_s >= 0 AND NOT isnan(start_s) AND NOT isnan(end_s) AND end_s > start_s) WHERE rn = 1)"""
_POINTS = f"{_TIMED}, pts AS (SELECT session_id, unnest(range(0, (floor(far / 20)::INT + 2))) * 20.0::DOUBLE AS t FROM (SELECT session_id, max(end_s) AS far FROM timed GROUP BY session_id))"
_TRACK = "track AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, max(value) AS v, min(value) AS u FROM events WHERE value IS NOT NULL GROUP BY ALL)"
_ep = lambda kind, cond: f"""SELECT user_id, min(t) AS start_t, max(t) AS end_t, count(*) AS n, max(t) - min(t) AS duration, '{kind}' AS kind FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - row_number() OVER (PARTITION BY user_id, {cond} ORDER BY t) AS g FROM zz) WHERE {cond} GROUP BY user_id, g HAVING max(t) - min(t) >= 60"""  # noqa: E731
_SIG = "(round_even(x * pow(10.0::DOUBLE, 3 - floor(log10(abs(CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE x END)))), 0) / pow(10.0::DOUBLE, 3 - floor(log10(abs(CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE x END)))))"
_NUM = f"list_distinct(list_transform(list_transform(regexp_extract_all(text, '-?\\d+\\.?\\d*'), lambda t: t::DOUBLE), lambda x: CASE WHEN x = floor(x) THEN format('{{:.0f}}', x) WHEN {_SIG} = floor({_SIG}) AND abs({_SIG}) < 10000 THEN format('{{:.0f}}', {_SIG}) ELSE {_SIG}::VARCHAR END))"
SQL = {
    "align_proportional": f"""WITH {CORPUS}, w AS (SELECT transcript_id, idx, greatest(1, {sql_space_words('text')})::DOUBLE AS n FROM corpus),
c AS (SELECT *, sum(n) OVER (PARTITION BY transcript_id ORDER BY idx) AS upto, sum(n) OVER (PARTITION BY transcript_id) AS total FROM w)
SELECT transcript_id, idx, {R('600.0::DOUBLE * (upto - n) / total', 4)} AS start_s, {R('600.0::DOUBLE * upto / total', 4)} AS end_s FROM c""",
    "align_interpolated": f"""WITH {_TIMED}, p AS (SELECT session_id, idx, CASE WHEN idx % 3 = 1 THEN start_s END AS st, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS i FROM timed),
n AS (SELECT *, last_value(CASE WHEN st IS NOT NULL THEN {{'i': i, 't': st}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(CASE WHEN st IS NOT NULL THEN {{'i': i, 't': st}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p),
s AS (SELECT *, CASE WHEN st IS NOT NULL THEN st WHEN a IS NOT NULL AND b IS NOT NULL THEN a.t + (i - a.i)::DOUBLE / (b.i - a.i) * (b.t - a.t) WHEN a IS NOT NULL THEN a.t ELSE 0.0 END AS s FROM n)
SELECT session_id, idx, {R('s', 4)} AS start_s, {R('coalesce(lead(s) OVER (PARTITION BY session_id ORDER BY i), greatest(900.0::DOUBLE, s + 1))', 4)} AS end_s FROM s""",
    "moment_in_turn": f"WITH {_POINTS} SELECT session_id, t, idx, start_s, end_s FROM (SELECT p.session_id, t, idx, start_s, end_s, row_number() OVER (PARTITION BY p.session_id, t ORDER BY idx) AS r FROM pts p JOIN timed i ON p.session_id = i.session_id AND t BETWEEN start_s AND end_s) WHERE r = 1",
    "moment_near_turn": f"WITH {_POINTS} SELECT p.session_id, t, {R('min(least(abs(start_s - t), abs(end_s - t)))', 4)} AS gap FROM pts p JOIN timed i USING (session_id) GROUP BY p.session_id, t",
    "event_episodes": f"WITH {_TRACK}, zz AS (SELECT *, v > avg(v) OVER w + 1.2::DOUBLE * stddev_pop(v) OVER w AS hi, v < greatest(0.0::DOUBLE, avg(v) OVER w - 1.2::DOUBLE * stddev_pop(v) OVER w) AS lo FROM track WINDOW w AS (PARTITION BY user_id)) {_ep('opening', 'hi')} UNION ALL {_ep('closure', 'lo')}",
    "event_moments": f"""WITH RECURSIVE {_TRACK}, st AS (SELECT *, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 0 THEN stddev_pop(v) OVER w ELSE 1e-6 END AS zv, (u - avg(u) OVER w) / CASE WHEN stddev_pop(u) OVER w > 0 THEN stddev_pop(u) OVER w ELSE 1e-6 END AS zu,
  row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER w AS n FROM track WINDOW w AS (PARTITION BY user_id)),
cand AS (SELECT user_id, t, i, greatest(3, n // 17) AS gap, {R('coalesce(abs(zv - lag(zv) OVER o), 0.0) + coalesce(abs(zu - lag(zu) OVER o), 0.0)', 6)} AS salience FROM st WHERE n >= 10 WINDOW o AS (PARTITION BY user_id ORDER BY t)),
pick AS (SELECT DISTINCT user_id, 0 AS k, []::BIGINT[] AS chosen FROM cand
  UNION ALL SELECT p.user_id, p.k + 1, list_append(any_value(p.chosen), arg_max(c.i, {{'s': c.salience, 'i': c.i}})) FROM pick p JOIN cand c ON c.user_id = p.user_id AND len(list_filter(p.chosen, lambda x: abs(x - c.i) <= c.gap)) = 0 WHERE p.k < 8 GROUP BY p.user_id, p.k),
last AS (SELECT user_id, arg_max(chosen, k) AS chosen FROM pick GROUP BY user_id)
SELECT c.user_id, c.t, c.salience FROM last l JOIN cand c ON c.user_id = l.user_id AND list_contains(l.chosen, c.i)""",
    "event_arc": f"""WITH {_TRACK}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM track),
s AS (SELECT user_id, count(*) AS n, avg(v) FILTER (i < c // 3) AS f, avg(v) FILTER (i >= c - ceil(c / 3)) AS l, avg(v) FILTER (i < c // 2) AS h1, avg(v) FILTER (i >= c // 2) AS h2, avg(v) AS m, stddev_pop(v) AS sd, max(v) AS top FROM n GROUP BY user_id)
SELECT user_id, n, {R('f', 6)} AS first_third, {R('l', 6)} AS last_third, CASE WHEN l / nullif(f, 0) >= 1.4::DOUBLE THEN 'rising' WHEN l / nullif(f, 0) <= 0.6::DOUBLE THEN 'fading' ELSE 'level' END AS engagement, {R('h2 - h1', 6)} AS half_shift, top > m + 2 * sd AS spike FROM s""",
    "within_label_z": f"""WITH e AS (SELECT vec_id, label, list_sum(embedding::DOUBLE[]) / len(embedding) AS x FROM embeddings), b AS (SELECT label, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM e WHERE vec_id % 2 = 0 GROUP BY label)
SELECT vec_id, label, {R('CASE WHEN n >= 2 THEN (x - m) / CASE WHEN s = 0 THEN 1e-6::DOUBLE ELSE s END END', 4)} AS x_z FROM e LEFT JOIN b USING (label)""",
    "event_windows": f"SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, {R('sum(value)', 4)} AS total FROM events GROUP BY ALL",
    "document_scripts": r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{0B80}-\x{0BFF}]')) AS ta, len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')) AS hi, len(regexp_extract_all(text, '[A-Za-z]')) AS en FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN ta = 0 AND hi = 0 THEN 'en' WHEN ta >= hi AND ta >= 0.2 * (en + ta) THEN 'ta' WHEN hi > ta AND hi >= 0.2 * (en + hi) THEN 'hi' ELSE 'en' END AS script_lang FROM c""",
    "document_numbers": f"SELECT doc_id, len({_NUM}) AS n_numbers, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_sort({_NUM}), lambda v: v::DOUBLE)), lambda a, b: a + b) AS sum_numbers FROM documents WHERE text IS NOT NULL",
    "number_gate": f"SELECT doc_id, len(list_filter({_NUM}, lambda x: NOT list_contains(['0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12'], x))) AS n_unsupported FROM documents WHERE text IS NOT NULL",
    "document_excerpts": """WITH t AS (SELECT doc_id, replace(regexp_replace(text, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'), chr(10), ' ') AS t FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, CASE WHEN contains(t, '. ') THEN split_part(t, '. ', 1) || '.' WHEN contains(t, '? ') THEN split_part(t, '? ', 1) || '?' WHEN contains(t, '! ') THEN split_part(t, '! ', 1) || '!' ELSE t END AS f FROM t)
SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE regexp_replace(substr(f, 1, 80), ' [^ ]*$', '') || '…' END AS excerpt FROM f""",
    "document_sentences": r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?।|])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS n_sentences FROM documents WHERE text IS NOT NULL""",
    "turn_clocks": f"WITH {_TIMED} SELECT session_id, idx, lpad((floor(start_s)::BIGINT // 60)::VARCHAR, 2, '0') || ':' || lpad((floor(start_s)::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM timed",
    "measure_upsert": """WITH m AS (SELECT DISTINCT * FROM measures), r AS (SELECT *, row_number() OVER (PARTITION BY client_id, session_number, instrument, id % 2 ORDER BY recorded_at DESC, id DESC) AS rn FROM m),
one AS (SELECT * FROM r WHERE rn = 1) SELECT id, client_id, session_number, instrument, score, recorded_at FROM one a
WHERE id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM one b WHERE b.id % 2 = 0 AND b.client_id = a.client_id AND b.session_number = a.session_number AND b.instrument = a.instrument)""",
    "client_insert": "SELECT DISTINCT id, code FROM clients",
    "deleted_clients": """WITH g AS (SELECT DISTINCT id AS gid FROM clients WHERE therapist_code IS NULL) SELECT 'clients' AS table_name, count(*) AS n_left FROM clients WHERE id NOT IN (SELECT gid FROM g WHERE gid IS NOT NULL) OR id IS NULL
UNION ALL SELECT 'transcripts', count(*) FROM transcripts WHERE client_id NOT IN (SELECT gid FROM g WHERE gid IS NOT NULL) OR client_id IS NULL UNION ALL SELECT 'measures', count(*) FROM measures WHERE client_id NOT IN (SELECT gid FROM g WHERE gid IS NOT NULL) OR client_id IS NULL""",
    "client_summary": "SELECT id, min(code) AS code, coalesce(any_value(s), 0) AS n_sessions, coalesce(any_value(m), 0) AS n_measures FROM clients LEFT JOIN (SELECT client_id AS id, count(DISTINCT session_number) AS s FROM transcripts GROUP BY 1) USING (id) LEFT JOIN (SELECT client_id AS id, count(DISTINCT id) AS m FROM measures GROUP BY 1) USING (id) GROUP BY id",
    "next_session_number": "SELECT client_id, coalesce(max(session_number), 0) + 1 AS next_number FROM transcripts GROUP BY client_id",
}
