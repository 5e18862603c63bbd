"""Queries over events as frames of recordings (one a user): runs, changes, retiming, samples, workspaces, streams."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.operators import intervals as iv
from timeweave.operators import retime as rt
from timeweave.sources import config, urls
from timeweave.sources.recordings import cache_dir
from timeweave.streaming import frames as streaming

BY, HOUR = "user_id", 3_600_000_000
RUN, RATE, PER_SECOND, LEAST = 3, 10, 1_000_000, 30 * HOUR // 2
NAMES = ["user_id", "beg", "fin", "multi"]


def micros(ts: str) -> str:
    """SQL for microseconds since 1970 of a time without zone, whatever the session's zone."""
    i = f"(CAST({ts} AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return f"(((extract(DAY FROM {i}) * 24L + extract(HOUR FROM {i})) * 60L + extract(MINUTE FROM {i})) * 60000000L + CAST(extract(SECOND FROM {i}) * 1000000 AS BIGINT))"


def events(spark: SparkSession, d: str) -> DataFrame:
    """user_id, event_id, event_type, value, idx, flag and us: microseconds since a second before the user's first event."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "value", "ts", F.expr(micros("ts")).alias("at"))
    w = W.partitionBy(BY).orderBy("at", "event_id")
    flag = (F.col("event_type") == "error") | (F.col("value") > 50)
    us = F.col("at") - F.min("at").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + 1_000_000  # in this order the least is the first: one sort does
    return e.withColumn("idx", F.row_number().over(w) - 1).withColumn("flag", flag).withColumn("us", us)


E = """e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS tus, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type = 'error' OR value > 50 AS flag FROM events),
r AS (SELECT *, tus - min(tus) OVER (PARTITION BY user_id) + 1000000 AS us FROM e)"""
RUNS = "runs AS (SELECT user_id, min(idx) AS beg, max(idx) + 1 AS fin FROM (SELECT user_id, idx, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS k FROM r WHERE flag) GROUP BY user_id, k)"


def changes(spark: SparkSession, d: str, *types: str) -> DataFrame:
    """Changes from half an hour after events of these types for 20 hours at most, disjoint; purchases cut, others halve."""
    beg = F.col("us") + HOUR // 2
    w = W.partitionBy(BY).orderBy("at", "event_id")
    e = events(spark, d).filter(F.col("event_type").isin(*types)).select(BY, "at", "event_id", beg.alias("beg"), F.lead(beg).over(w).alias("following"), F.when(F.col("event_type") == "purchase", 0.0).otherwise(0.5).alias("multi"))
    fin = F.least(F.col("beg") + 20 * HOUR, F.coalesce("following", F.col("beg") + 20 * HOUR))
    return e.select(BY, F.col("beg").cast("double").alias("beg"), fin.cast("double").alias("fin"), "multi").filter("beg < fin")


def ranked_changes(spark: SparkSession, d: str, *types: str) -> DataFrame:
    """The changes of each of these types by itself, with its place among them as rank: one scan, one exchange and one sort for all."""
    e = spark.read.parquet(f"{d}/events.parquet").select(BY, "event_id", "event_type", F.expr(micros("ts")).alias("at")).repartition(BY)
    e = e.withColumn("following", F.lead("at").over(W.partitionBy(BY, "event_type").orderBy("at", "event_id"))).withColumn("least", F.min("at").over(W.partitionBy(BY).orderBy("event_type", "at", "event_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    beg = lambda at: F.col(at) - F.col("least") + 1_000_000 + HOUR // 2
    fin = F.least(beg("at") + 20 * HOUR, F.coalesce(beg("following"), beg("at") + 20 * HOUR))
    rank = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(k)) for k, t in enumerate(types)))
    multi = F.when(F.col("event_type") == "purchase", 0.0).otherwise(0.5)
    return e.filter(F.col("event_type").isin(*types)).select(BY, beg("at").cast("double").alias("beg"), fin.cast("double").alias("fin"), multi.alias("multi"), rank.alias("rank")).filter("beg < fin")


def changes_sql(name: str, *types: str) -> str:
    listed = ", ".join(f"'{t}'" for t in types)
    return f"""{name} AS (SELECT * FROM (SELECT user_id, beg::DOUBLE AS beg, least(beg + {20 * HOUR}, coalesce(following, beg + {20 * HOUR}))::DOUBLE AS fin, multi FROM
(SELECT user_id, us + {HOUR // 2} AS beg, lead(us + {HOUR // 2}) OVER (PARTITION BY user_id ORDER BY us, event_id) AS following, CASE WHEN event_type = 'purchase' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS multi FROM r WHERE event_type IN ({listed}))) WHERE beg < fin)"""


def overlay_sql(name: str, primary: str, supplement: str) -> str:
    """CTEs for primary with what it leaves of supplement, by pairing overlaps."""
    return f"""{name}_o AS (SELECT s.user_id, s.beg AS sb, s.fin AS sf, s.multi, p.beg AS pb, p.fin AS pf FROM {supplement} s LEFT JOIN {primary} p ON p.user_id = s.user_id AND p.beg < s.fin AND p.fin > s.beg),
{name}_g AS (SELECT user_id, multi, greatest(sb, coalesce(lag(pf) OVER (PARTITION BY user_id, sb ORDER BY pb), sb)) AS beg, pb AS fin FROM {name}_o WHERE pb IS NOT NULL
 UNION ALL SELECT user_id, multi, greatest(sb, coalesce(max(pf), sb)) AS beg, sf AS fin FROM {name}_o GROUP BY user_id, sb, sf, multi),
{name} AS (SELECT user_id, beg, fin, multi FROM {primary} UNION ALL SELECT user_id, beg, fin, multi FROM {name}_g WHERE beg < fin)"""


def tail_changes(spark: SparkSession, d: str) -> DataFrame:
    """A cut of everything from an hour before the last event, for users whose last event is a click or a view."""
    last = events(spark, d).groupBy(BY).agg(F.max("us").alias("us"), F.max_by("event_type", F.struct("us", "event_id")).alias("t"))
    return last.filter("t IN ('click', 'view')").select(BY, (F.col("us") - HOUR).cast("double").alias("beg"), F.lit(float("inf")).alias("fin"), F.lit(0.0).alias("multi"))


TAIL = f"tail AS (SELECT user_id, (us - {HOUR})::DOUBLE AS beg, 'inf'::DOUBLE AS fin, 0.0::DOUBLE AS multi FROM (SELECT user_id, max(us) AS us, arg_max(event_type, (us, event_id)) AS t FROM r GROUP BY user_id) WHERE t IN ('click', 'view'))"


def timed(spark: SparkSession, d: str) -> DataFrame:
    """Frames in whole microseconds."""
    return rt.frame_durations(events(spark, d), BY, "us").withColumn("src", F.floor("src").cast("double"))


DURATIONS = """g AS (SELECT user_id, us, lead(us) OVER w - us AS gap, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, us FROM r WHERE us >= 0) WINDOW w AS (PARTITION BY user_id ORDER BY us)),
fd AS (SELECT user_id, rn::INTEGER AS frame, coalesce(gap::DOUBLE, avg(gap) OVER (PARTITION BY user_id)) AS src, false AS virtual FROM g WHERE n > 1 UNION ALL SELECT user_id, 0::INTEGER, us::DOUBLE, true FROM g WHERE n > 1 AND rn = 1)"""
BOUNDS = "b AS (SELECT user_id, frame, floor(src) AS src, sum(floor(src)) OVER w AS fe, sum(floor(src)) OVER w - floor(src) AS fb FROM fd WINDOW w AS (PARTITION BY user_id ORDER BY frame))"


def retime_sql(ch: str = "ch") -> str:
    return f"rt AS (SELECT b.user_id, b.frame, b.src, b.fb, b.fe, b.src + coalesce(sum((least(b.fe, c.fin) - greatest(b.fb, c.beg)) * (c.multi - 1)), 0) AS dst FROM b LEFT JOIN {ch} c ON c.user_id = b.user_id AND b.fb < c.fin AND b.fe > c.beg GROUP BY b.user_id, b.frame, b.src, b.fb, b.fe)"


CH = changes_sql("ch", "purchase", "signup")
RETIMED = f"{E}, {CH}, {DURATIONS}, {BOUNDS}, {retime_sql()}"
SAMPLES = f"""{RETIMED}, n0 AS (SELECT *, trunc(sum(src) OVER w * {RATE} / {PER_SECOND})::BIGINT AS s, round_even(sum(dst) OVER w * {RATE} / {PER_SECOND}, 0)::BIGINT AS t FROM rt WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
n1 AS (SELECT *, s - coalesce(lag(s) OVER w, 0) AS src_n, t - coalesce(lag(t) OVER w, 0) AS dst_n FROM n0 WINDOW w AS (PARTITION BY user_id ORDER BY frame))"""
TOLERANT = f"""{SAMPLES}, n2 AS (SELECT *, src_n <> dst_n AS x, sum(CASE WHEN lag_x IS DISTINCT FROM (src_n <> dst_n) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM (SELECT *, lag(src_n <> dst_n) OVER (PARTITION BY user_id ORDER BY frame) AS lag_x FROM n1)),
n3 AS (SELECT *, abs(sum(src_n) OVER q - sum(dst_n) OVER q) <= 1 AS noise FROM n2 WINDOW q AS (PARTITION BY user_id, run)),
n4 AS (SELECT user_id, frame, CASE WHEN noise THEN src_n ELSE dst_n END AS dst_n, src_n AS raw_n, x AND NOT noise AS edited FROM n3),
n5 AS (SELECT user_id, frame, dst_n, CASE WHEN dst_n = 0 THEN 0 ELSE raw_n END AS src_n, edited FROM n4),
er AS (SELECT user_id, min(frame) AS beg, max(frame) + 1 AS fin FROM (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS k FROM n5 WHERE edited) GROUP BY user_id, k),
cu AS (SELECT user_id, frame, sum(src_n) OVER w AS ce, sum(src_n) OVER w - src_n AS cb, count(*) OVER (PARTITION BY user_id) AS many FROM n5 WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
pr AS (SELECT er.user_id, er.beg, er.fin, coalesce(max(c.frame) FILTER (c.cb <= l.cb - {rt.PAD}), 0) AS new_beg, coalesce(min(c.frame) FILTER (c.ce >= h.ce + {rt.PAD}) + 1, any_value(c.many)) AS new_fin
 FROM er JOIN cu l ON l.user_id = er.user_id AND l.frame = er.beg JOIN cu h ON h.user_id = er.user_id AND h.frame = er.fin - 1 JOIN cu c ON c.user_id = er.user_id GROUP BY er.user_id, er.beg, er.fin)"""


def retimed(spark, d):
    return rt.retime(timed(spark, d), changes(spark, d, "purchase", "signup"), BY)


def tolerant(spark, d):
    return rt.tolerate_noise(rt.samples(retimed(spark, d), RATE, PER_SECOND, BY), BY)


def whole(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if c in ("beg", "fin", "frame", "idx", "new_beg", "new_fin") else F.col(c) for c in columns))


def islands(s, d):
    return whole(iv.islands(events(s, d), BY), BY, "beg", "fin")


def min_run_islands(s, d):
    return whole(iv.min_runs(iv.islands(events(s, d), BY), RUN), BY, "beg", "fin")


def morph_close_open(s, d):
    return whole(iv.close_open(events(s, d), RUN, BY), BY, "idx", "flag")


def run_to_seconds(s, d):
    return iv.run_seconds(iv.islands(events(s, d), BY), 256, 16000, 0.0, BY)


def validate_changes(s, d):
    raw = events(s, d).select(BY, F.col("us").cast("double").alias("beg"), (F.col("us") + F.col("value").cast("long") * (HOUR // 4)).cast("double").alias("fin"), F.lit(0.5).alias("multi"))
    return iv.violations(raw, BY).select(BY, "beg", "fin")


def combine_changes(s, d):
    return iv.by_rank(ranked_changes(s, d, "purchase", "signup"), 2, BY)


def combine_priority_fold(s, d):
    return iv.by_rank(ranked_changes(s, d, "purchase", "signup", "view"), 3, BY)


def frame_durations(s, d):
    return rt.frame_durations(events(s, d), BY, "us").select(BY, F.col("frame").cast("long").alias("frame"), F.round("src", 2).alias("dur_us"), "virtual")


def retime_frames(s, d):
    return retimed(s, d).select(BY, F.col("frame").cast("long").alias("frame"), F.col("src").alias("src_us"), F.col("dst").alias("dst_us"))


def retime_seconds(s, d):
    """The same in seconds, where nothing is a whole number: what no change touches stays as it is, what is cut is 0."""
    second = lambda c: rt.seconds(F.col(c), Fraction(1, PER_SECOND))
    ch = changes(s, d, "purchase", "signup").withColumn("beg", second("beg")).withColumn("fin", second("fin"))
    out = rt.retime(timed(s, d).withColumn("src", second("src")), ch, BY)
    return out.select(BY, F.col("frame").cast("long").alias("frame"), F.round("src", 7).alias("src_s"), F.round("dst", 7).alias("dst_s"), (F.col("dst") == F.col("src")).alias("same"), (F.col("dst") == 0).alias("cut"))


def tail_trim(s, d):
    ch = iv.combine(tail_changes(s, d), changes(s, d, "purchase", "signup"), BY)
    return rt.trim_tail(rt.retime(timed(s, d), ch, BY), ch, BY).groupBy(BY).agg(F.count("*").alias("n_frames"), F.sum("dst").alias("dst_us"))


def output_pts(s, d):
    return whole(rt.output_times(retimed(s, d), BY), BY, "frame", "pts")


def fps_constrain(s, d):
    return rt.limit_fps(retimed(s, d), LEAST, BY).select(BY, F.col("frame").cast("long").alias("frame"), F.col("dst").alias("dur_us"))


def samples_from_seconds(s, d):
    return whole(rt.samples(retimed(s, d), RATE, PER_SECOND, BY), BY, "frame", "src_n", "dst_n")


def edit_noise_tolerance(s, d):
    return whole(tolerant(s, d), BY, "frame", "src_n", "dst_n", "edited")


def pad_ranges(s, d):
    return whole(rt.edited_ranges(tolerant(s, d), rt.PAD, BY), BY, "beg", "fin", "new_beg", "new_fin")


def merge_padded(s, d):
    return whole(rt.padded_edits(tolerant(s, d), rt.PAD, BY), BY, "beg", "fin")


def workspace_plan(s, d):
    t = tolerant(s, d)
    return rt.plan_workspaces(t, rt.padded_edits(t, rt.PAD, BY), BY)


def frame_workspaces(s, d):
    """Each frame with the start of the padded range that it is edited in, or -1."""
    t = tolerant(s, d)
    ranges = rt.padded_edits(t, rt.PAD, BY)
    at = iv.as_of(t.select(BY, "frame"), ranges, BY, F.col("frame").cast("long"), F.col("beg").cast("long"), F.struct("beg", "fin"), "w")
    return at.select(BY, F.col("frame").cast("long").alias("frame"), F.coalesce(F.when(F.col("frame") < F.col("w.fin"), F.col("w.beg")), F.lit(-1)).cast("long").alias("beg"))


def deleted_neighbour_trim(s, d):
    return whole(rt.trim_neighbours(tolerant(s, d), BY), BY, "frame", "n")


def equal_split(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").alias("size"))
    return rt.split_evenly(o, "size", rt.SILENT_FRAME).select("o_orderkey", "part", "part_size")


def stream_summary(s, d):
    e = events(s, d)
    per = e.groupBy(BY, "event_type").agg(F.count("*").alias("n_frames"), (F.max("us") - F.min("us")).alias("total_us"), F.sum(F.col("flag").cast("long")).alias("n_flagged"), F.bool_and("flag").alias("all_flagged"))
    expected = e.groupBy(BY).agg(F.count("*").alias("expected"))
    return per.join(expected, BY).select(BY, "event_type", "n_frames", "expected", "total_us", "n_flagged", "all_flagged", (F.col("total_us") <= 0).alias("is_empty"))


def recording_summary(s, d):
    return rt.summary(retimed(s, d), BY)


def first_stream(s, d):
    return config.first_stream(events(s, d), BY, "idx").select(BY, "event_type")


def best_candidate(s, d):
    return events(s, d).groupBy(BY).agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


def slow_transfer_guard(s, d):
    log = events(s, d).select(BY, "event_id", "idx", (F.col("us") / PER_SECOND).alias("elapsed"), (F.col("value")).alias("eta"), F.when(F.col("event_type") == "error", None).otherwise(F.col("value")).alias("speed"))
    return urls.slow_transfers(log, BY, 50.0, 86400.0, 10.0).select(BY, "event_id", "slow")


def edit_list_json(s, d):
    ch = changes(s, d, "purchase", "signup")
    return config.edit_list(ch.select(BY, (F.col("beg") / HOUR).cast("long").alias("beg"), (F.col("fin") / HOUR).cast("long").alias("fin"), F.when(F.col("multi") == 0, 0).otherwise(1).cast("long").alias("multi")), BY)


def condensed(s, d):
    """Flagged stretches of each user's events, closed and opened, are cut: durations before and after."""
    e = iv.close_open(events(s, d), RUN, BY)
    w = W.partitionBy(BY).orderBy("idx")
    runs = iv.with_runs(e.withColumn("next_us", F.lead("us").over(w)), BY, "idx", "flag", "run").filter("flag").groupBy(BY, "run").agg(F.min("us").cast("double").alias("beg"), F.max(F.coalesce("next_us", "us")).cast("double").alias("fin"), F.lit(0.0).alias("multi"))
    return rt.summary(rt.retime(timed(s, d), runs, BY), BY).select(BY, "n_frames", "n_kept", F.col("src").alias("original_us"), F.col("dst").alias("condensed_us"))


def stream_sessions(s, d):
    ts = f"{d}/events.parquet"
    e = s.read.parquet(ts).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = streaming.sessions(e, BY, "ts", "6 hours")
    return out.select(BY, F.expr(micros("start")).alias("start_us"), F.expr(micros("end")).alias("end_us"), "n")


def frame_buffer_stream(s, d):
    """Ten events of a user at a time, from a stream of the table."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return streaming.drained(streaming.buffered(stream, BY, "value", 10), cache_dir(s)).select(BY, "range_no", "n_frames", F.round("total", 6).alias("total"))


def stream_shortage(s, d):
    e = events(s, d)
    got = e.filter(~F.col("flag")).groupBy(BY).agg(F.count("*").alias("got"))
    return streaming.shortage(e.groupBy(BY).agg(F.count("*").alias("expected")), got, BY)


MORPH = f"""{E}, m0 AS (SELECT user_id, idx, flag, sum(CASE WHEN p IS DISTINCT FROM flag THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM (SELECT *, lag(flag) OVER (PARTITION BY user_id ORDER BY idx) AS p FROM r)),
m1 AS (SELECT user_id, idx, flag OR count(*) OVER (PARTITION BY user_id, run) < {RUN} AS flag FROM m0),
m2 AS (SELECT user_id, idx, flag, sum(CASE WHEN p IS DISTINCT FROM flag THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM (SELECT *, lag(flag) OVER (PARTITION BY user_id ORDER BY idx) AS p FROM m1)),
m3 AS (SELECT user_id, idx, run, flag AND count(*) OVER (PARTITION BY user_id, run) >= {RUN} AS flag FROM m2)"""
PAIR = f"{E}, {changes_sql('p', 'purchase')}, {changes_sql('s', 'signup')}, {overlay_sql('c1', 'p', 's')}"
FPS = f"""WITH RECURSIVE {RETIMED}, x AS (SELECT user_id, frame, trunc(dst)::BIGINT AS d, max(frame) OVER (PARTITION BY user_id) AS last FROM rt),
f AS (SELECT user_id, -1 AS frame, NULL::BIGINT AS open, 0::BIGINT AS acc, NULL::BIGINT AS done, NULL::BIGINT AS val FROM (SELECT DISTINCT user_id FROM x)
 UNION ALL SELECT x.user_id, x.frame, CASE WHEN NOT (x.d > 0 AND x.d < {LEAST}) THEN f.open WHEN f.open IS NULL THEN x.frame WHEN f.acc + x.d < {LEAST} THEN f.open WHEN f.acc + x.d > {LEAST} THEN x.frame END,
  CASE WHEN NOT (x.d > 0 AND x.d < {LEAST}) THEN f.acc WHEN f.open IS NULL THEN x.d WHEN f.acc + x.d < {LEAST} THEN f.acc + x.d ELSE f.acc + x.d - {LEAST} END,
  CASE WHEN NOT (x.d > 0 AND x.d < {LEAST}) THEN x.frame WHEN f.open IS NOT NULL AND f.acc + x.d >= {LEAST} THEN f.open END,
  CASE WHEN NOT (x.d > 0 AND x.d < {LEAST}) THEN x.d WHEN f.open IS NOT NULL AND f.acc + x.d >= {LEAST} THEN {LEAST} END
  FROM f JOIN x ON x.user_id = f.user_id AND x.frame = f.frame + 1),
o AS (SELECT user_id, done AS frame, val FROM f WHERE done IS NOT NULL UNION ALL SELECT f.user_id, f.open, round_even(f.acc::DOUBLE / {LEAST}, 0)::BIGINT * {LEAST} FROM f JOIN x ON x.user_id = f.user_id AND x.frame = f.frame AND x.frame = x.last WHERE f.open IS NOT NULL)
SELECT x.user_id, x.frame::BIGINT AS frame, coalesce(o.val, 0)::BIGINT AS dur_us FROM x LEFT JOIN o ON o.user_id = x.user_id AND o.frame = x.frame"""

QUERIES = {
    "islands": (islands, f"WITH {E}, {RUNS} SELECT user_id, beg, fin FROM runs"),
    "min_run_islands": (min_run_islands, f"WITH {E}, {RUNS} SELECT user_id, beg, fin FROM runs WHERE fin - beg >= {RUN}"),
    "morph_close_open": (morph_close_open, f"WITH {MORPH} SELECT user_id, idx, flag FROM m3"),
    "run_to_seconds": (run_to_seconds, f"WITH {E}, {RUNS} SELECT user_id, beg * 256 / 16000::DOUBLE AS beg, fin * 256 / 16000::DOUBLE AS fin, 0.0::DOUBLE AS multi FROM runs"),
    "validate_changes": (validate_changes, f"WITH {E}, v AS (SELECT user_id, us::DOUBLE AS beg, (us + trunc(value)::BIGINT * {HOUR // 4})::DOUBLE AS fin FROM r) SELECT user_id, beg, fin FROM (SELECT *, lead(beg) OVER (PARTITION BY user_id ORDER BY beg, fin) AS nx FROM v) WHERE NOT (beg >= 0 AND beg < fin AND (nx IS NULL OR fin <= nx))"),
    "combine_changes": (combine_changes, f"WITH {PAIR} SELECT * FROM c1"),
    "combine_priority_fold": (combine_priority_fold, f"WITH {PAIR}, {changes_sql('v', 'view')}, {overlay_sql('c2', 'c1', 'v')} SELECT * FROM c2"),
    "frame_durations": (frame_durations, f"WITH {E}, {DURATIONS} SELECT user_id, frame::BIGINT AS frame, round(src, 2) AS dur_us, virtual FROM fd"),
    "retime_frames": (retime_frames, f"WITH {RETIMED} SELECT user_id, frame::BIGINT AS frame, src AS src_us, dst AS dst_us FROM rt"),
    "retime_seconds": (retime_seconds, f"WITH {RETIMED} SELECT user_id, frame::BIGINT AS frame, round(src / {PER_SECOND}::DOUBLE, 7) AS src_s, round(dst / {PER_SECOND}::DOUBLE, 7) AS dst_s, dst = src AS same, dst = 0 AS cut FROM rt"),
    "tail_trim": (tail_trim, f"WITH {E}, {CH}, {TAIL}, {overlay_sql('cc', 'tail', 'ch')}, {DURATIONS}, {BOUNDS}, {retime_sql('cc')}, z AS (SELECT user_id, max(fe) AS e FROM rt GROUP BY user_id), k AS (SELECT rt.user_id, min(frame) AS cut FROM rt JOIN z USING (user_id) JOIN cc c ON c.user_id = rt.user_id AND c.fin >= z.e AND rt.fe > c.beg WHERE rt.dst = 0 GROUP BY rt.user_id) SELECT user_id, count(*) AS n_frames, sum(dst) AS dst_us FROM rt LEFT JOIN k USING (user_id) WHERE cut IS NULL OR frame < cut GROUP BY user_id"),
    "output_pts": (output_pts, f"WITH {RETIMED} SELECT user_id, frame::BIGINT AS frame, pts FROM (SELECT *, sum(dst) OVER (PARTITION BY user_id ORDER BY frame) - dst AS pts FROM rt) WHERE dst > 0"),
    "fps_constrain": (fps_constrain, FPS),
    "samples_from_seconds": (samples_from_seconds, f"WITH {SAMPLES} SELECT user_id, frame::BIGINT AS frame, src_n, dst_n FROM n1"),
    "edit_noise_tolerance": (edit_noise_tolerance, f"WITH {TOLERANT} SELECT user_id, frame::BIGINT AS frame, src_n, dst_n, edited FROM n5"),
    "pad_ranges": (pad_ranges, f"WITH {TOLERANT} SELECT user_id, beg::BIGINT AS beg, fin::BIGINT AS fin, new_beg::BIGINT AS new_beg, new_fin::BIGINT AS new_fin FROM pr"),
    "merge_padded": (merge_padded, f"WITH {TOLERANT}, fl AS (SELECT DISTINCT pr.user_id, f.frame FROM pr JOIN n5 f ON f.user_id = pr.user_id AND f.frame >= pr.new_beg AND f.frame < pr.new_fin) SELECT user_id, min(frame)::BIGINT AS beg, max(frame)::BIGINT + 1 AS fin FROM (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS k FROM fl) GROUP BY user_id, k"),
    "workspace_plan": (workspace_plan, None),
    "frame_workspaces": (frame_workspaces, f"WITH {TOLERANT}, fl AS (SELECT DISTINCT pr.user_id, f.frame FROM pr JOIN n5 f ON f.user_id = pr.user_id AND f.frame >= pr.new_beg AND f.frame < pr.new_fin), ws AS (SELECT user_id, min(frame) AS beg, max(frame) + 1 AS fin FROM (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS k FROM fl) GROUP BY user_id, k) SELECT n5.user_id, n5.frame::BIGINT AS frame, coalesce(ws.beg, -1)::BIGINT AS beg FROM n5 LEFT JOIN ws ON ws.user_id = n5.user_id AND n5.frame >= ws.beg AND n5.frame < ws.fin"),
    "deleted_neighbour_trim": (deleted_neighbour_trim, f"WITH {TOLERANT} SELECT user_id, frame::BIGINT AS frame, CASE WHEN dst_n = 0 THEN 0 WHEN p = 0 OR q = 0 THEN least(src_n, dst_n) ELSE src_n END::BIGINT AS n FROM (SELECT *, lag(dst_n) OVER w AS p, lead(dst_n) OVER w AS q FROM n5 WINDOW w AS (PARTITION BY user_id ORDER BY frame))"),
    "equal_split": (equal_split, f"WITH o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders), k AS (SELECT *, greatest(ceil(n / {rt.SILENT_FRAME}.0)::BIGINT, 1) AS k FROM o), x AS (SELECT *, unnest(range(0, k)) AS i FROM k) SELECT o_orderkey, i::BIGINT AS part, ((i + 1) * n // k - i * n // k)::BIGINT AS part_size FROM x"),
    "stream_summary": (stream_summary, f"WITH {E} SELECT user_id, event_type, count(*) AS n_frames, any_value(expected) AS expected, max(us) - min(us) AS total_us, sum(flag::INTEGER)::BIGINT AS n_flagged, bool_and(flag) AS all_flagged, max(us) - min(us) <= 0 AS is_empty FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS expected FROM r) GROUP BY user_id, event_type"),
    "recording_summary": (recording_summary, f"WITH {RETIMED} SELECT user_id, count(*) AS n_frames, count(*) FILTER (dst > 0) AS n_kept, sum(src) AS src, sum(dst) AS dst, max(dst) <= 0 AS is_empty FROM rt GROUP BY user_id"),
    "first_stream": (first_stream, f"WITH {E} SELECT user_id, event_type FROM r WHERE idx = 0"),
    "best_candidate": (best_candidate, "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1"),
    "slow_transfer_guard": (slow_transfer_guard, f"WITH {E} SELECT user_id, event_id, us / {PER_SECOND}::DOUBLE - coalesce(max(CASE WHEN event_type <> 'error' AND value > 50 THEN us / {PER_SECOND}::DOUBLE END) OVER (PARTITION BY user_id ORDER BY idx), 0) > 86400 AND value > 10 AS slow FROM r"),
    "edit_list_json": (edit_list_json, f"""WITH {E}, {CH}, j AS (SELECT user_id, (trunc(beg / {HOUR}))::BIGINT AS b, (trunc(fin / {HOUR}))::BIGINT AS f, CASE WHEN multi = 0 THEN 0 ELSE 1 END AS m FROM ch) SELECT user_id, '{{"timeline-changes":[' || string_agg('[' || b || ',' || f || ',' || m || ']', ',' ORDER BY b, f, m) || ']}}' AS json FROM j GROUP BY user_id"""),
    "condensed": (condensed, f"WITH {MORPH}, q AS (SELECT m3.user_id, m3.run, m3.flag, r.us, lead(r.us) OVER (PARTITION BY m3.user_id ORDER BY m3.idx) AS nx, m3.idx FROM m3 JOIN r ON r.user_id = m3.user_id AND r.idx = m3.idx), q2 AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM flag THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx) AS g2 FROM (SELECT *, lag(flag) OVER (PARTITION BY user_id ORDER BY idx) AS p FROM q)), ch AS (SELECT user_id, min(us)::DOUBLE AS beg, max(coalesce(nx, us))::DOUBLE AS fin, 0.0::DOUBLE AS multi FROM q2 WHERE flag GROUP BY user_id, g2), {DURATIONS}, {BOUNDS}, {retime_sql()} SELECT user_id, count(*) AS n_frames, count(*) FILTER (dst > 0) AS n_kept, sum(src) AS original_us, sum(dst) AS condensed_us FROM rt GROUP BY user_id"),
    "stream_sessions": (stream_sessions, f"WITH {E}, s AS (SELECT user_id, tus, sum(CASE WHEN tus - p > {6 * HOUR} OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tus, event_id) AS g FROM (SELECT *, lag(tus) OVER (PARTITION BY user_id ORDER BY tus, event_id) AS p FROM r)) SELECT user_id, min(tus) AS start_us, max(tus) + {6 * HOUR} AS end_us, count(*) AS n FROM s GROUP BY user_id, g"),
    "frame_buffer_stream": (frame_buffer_stream, "WITH k AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS g FROM events) SELECT user_id, g::BIGINT AS range_no, count(*) AS n_frames, round(sum(value), 6) AS total FROM k GROUP BY user_id, g HAVING count(*) = 10"),
    "stream_shortage": (stream_shortage, f"WITH {E} SELECT user_id, count(*) AS expected, count(*) FILTER (NOT flag) AS got, count(*) FILTER (flag) AS missing FROM r GROUP BY user_id HAVING count(*) FILTER (flag) > 0"),
}
