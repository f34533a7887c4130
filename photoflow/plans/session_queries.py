"""Games from photo timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photoflow.functions import names
from photoflow.operators import sessions as S
from photoflow.plans import fixtures as X
from photoflow.plans.registry import query

BY = ["source"]


def _micros(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in cols})


def _games_sql(gap: int, duration: int, source: str = "source") -> str:
    """games(source, session, start_time, end_time, photo_count) by fixed gaps."""
    return f"""{X.PHOTOS}, g AS (SELECT {source} AS source, photo_id, ts, filename,
  CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= {gap} * 60000000 THEN 1 ELSE 0 END AS nw, lag(ts) OVER w AS prev_ts, lead(ts) OVER w AS next_ts FROM photos WINDOW w AS (PARTITION BY {source} ORDER BY ts, photo_id)),
marked AS (SELECT *, sum(nw) OVER (PARTITION BY source ORDER BY ts, photo_id) AS session FROM g),
games AS (SELECT source, session, min(ts) AS start_time, max(ts) AS end_time, count(*) AS photo_count, arg_min(prev_ts, (ts, photo_id)) AS prev_ts, arg_max(next_ts, (ts, photo_id)) AS next_ts
  FROM marked GROUP BY source, session HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= {duration} * 60000000)"""


_GAPS = """SELECT source, CAST(row_number() OVER w AS INTEGER) AS game_id, epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time, photo_count,
  nullif((epoch_us(start_time) - lag(epoch_us(end_time)) OVER w) / 1e6, 0) AS gap_before_s, nullif((lead(epoch_us(start_time)) OVER w - epoch_us(end_time)) / 1e6, 0) AS gap_after_s
FROM games WINDOW w AS (PARTITION BY source ORDER BY start_time, end_time)"""


def _numbered(photos: DataFrame, gap: float, duration: float) -> DataFrame:
    return S.number_games(S.sessionize(photos, BY, gap, duration), BY)


@query("e1_sessionize", f"WITH {_games_sql(30, 30)} {_GAPS}")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = S.game_gaps(_numbered(X.photos(spark, sf_dir), 30, 30), BY)
    return _micros(games.select("source", "game_id", "start_time", "end_time", "photo_count", "gap_before_s", "gap_after_s"), "start_time", "end_time")


_ONE = "'all'"


@query("e1_sessionize_by_range", f"WITH {_games_sql(10, 30, _ONE)} {_GAPS}")
def e1_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = X.photos(spark, sf_dir).withColumn("source", F.lit("all"))
    marked = S.mark_sessions_by_range(photos, BY, 10)
    games = S.game_gaps(S.number_games(S.sessionize(photos, BY, 10, 30, marked), BY), BY)
    return _micros(games.select("source", "game_id", "start_time", "end_time", "photo_count", "gap_before_s", "gap_after_s"), "start_time", "end_time")


@query("e5_photo_gaps", f"""WITH {_games_sql(30, 30)} SELECT source, session, epoch_us(start_time) AS start_time,
  nullif((epoch_us(start_time) - epoch_us(prev_ts)) / 1e6, 0) AS gap_before_s, nullif((epoch_us(next_ts) - epoch_us(end_time)) / 1e6, 0) AS gap_after_s FROM games""")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = X.photos(spark, sf_dir)
    marked = S.mark_sessions(photos, BY, 30)
    games = S.photo_gaps(marked, S.sessionize(photos, BY, 30, 30, marked), BY)
    return _micros(games.select("source", F.col("session"), "start_time", "gap_before_s", "gap_after_s"), "start_time")


@query("e3_lookahead_gap", f"""WITH {X.PHOTOS}, g AS (SELECT source, photo_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY source ORDER BY ts, photo_id)) / 6e7 AS gap FROM photos)
SELECT source, photo_id, gap, coalesce(max(gap) OVER (PARTITION BY source ORDER BY ts, photo_id ROWS BETWEEN 1 FOLLOWING AND 99 FOLLOWING), 0) AS lookahead FROM g""")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lookahead_gap(X.photos(spark, sf_dir), BY).select("source", "photo_id", "gap", "lookahead")


_ADAPTIVE = f"""WITH RECURSIVE {X.PHOTOS},
g AS (SELECT 'all' AS source, ts, row_number() OVER w - 1 AS idx, lag(ts) OVER w AS prev_ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 6e7 AS gap, count(*) OVER () AS n FROM photos WINDOW w AS (ORDER BY ts, photo_id)),
l AS (SELECT *, coalesce(max(gap) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 99 FOLLOWING), 0) AS ahead, sum(CASE WHEN gap >= 30 THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS block FROM g),
e AS (SELECT block, max(idx) AS last_idx, max(ts) AS last_ts, min(idx) AS first_idx, min(ts) AS first_ts FROM l GROUP BY block),
c AS (SELECT l.*, row_number() OVER (PARTITION BY l.block ORDER BY idx) AS k FROM l JOIN e USING (block) WHERE gap >= 10 AND idx > first_idx),
r AS (
  SELECT block, CAST(0 AS BIGINT) AS k, first_idx AS s, first_ts AS st, CAST(NULL AS BIGINT) AS es, CAST(NULL AS TIMESTAMP) AS est, CAST(NULL AS BIGINT) AS ee, CAST(NULL AS TIMESTAMP) AS eet FROM e
  UNION ALL
  SELECT r.block, c.k, CASE WHEN x.cut THEN c.idx ELSE r.s END, CASE WHEN x.cut THEN c.ts ELSE r.st END, CASE WHEN x.cut THEN r.s END, CASE WHEN x.cut THEN r.st END, CASE WHEN x.cut THEN c.idx - 1 END, CASE WHEN x.cut THEN c.prev_ts END
  FROM r JOIN c ON c.block = r.block AND c.k = r.k + 1, LATERAL (SELECT c.gap >= CASE
    WHEN c.idx - r.s < 50 THEN 30 WHEN (epoch_us(c.prev_ts) - epoch_us(r.st)) / 6e7 >= 30 THEN 10 WHEN c.ahead > c.gap * 2 AND c.gap < 30 THEN 25 WHEN r.s < 200 AND c.ahead > 50 THEN 25 ELSE 10 END AS cut) x
), f AS (SELECT es AS s, est AS st, ee AS e, eet AS et, false AS last FROM r WHERE es IS NOT NULL
  UNION ALL SELECT r.s, r.st, e.last_idx, e.last_ts, e.block = (SELECT max(block) FROM e) FROM (SELECT block, arg_max(s, k) AS s, arg_max(st, k) AS st FROM r GROUP BY block) r JOIN e USING (block))
SELECT 'all' AS source, s AS start_idx, e AS end_idx, epoch_us(st) AS start_time, epoch_us(et) AS end_time, e - s + 1 AS photo_count FROM f
WHERE e - s + 1 >= 50 AND (epoch_us(et) - epoch_us(st)) / 6e7 >= 30 AND (NOT last OR s < (SELECT count(*) FROM events) - 1)"""


@query("e2_sessionize_adaptive", _ADAPTIVE)
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = X.photos(spark, sf_dir).withColumn("source", F.lit("all"))
    return _micros(S.sessionize_adaptive(photos, BY), "start_time", "end_time")


@query("e4_merge_sessions", f"""WITH {_games_sql(20, 10)},
a AS (SELECT *, row_number() OVER w AS i, epoch_us(end_time) - epoch_us(start_time) >= 600000000 AND photo_count >= 3 AS big, lead(start_time) OVER w AS ns, lead(end_time) OVER w AS ne, lead(photo_count) OVER w AS nc FROM games WINDOW w AS (PARTITION BY source ORDER BY start_time, end_time)),
b AS (SELECT *, coalesce(epoch_us(ns) - epoch_us(end_time) < CAST(2400000000 AS BIGINT) AND epoch_us(ne) - epoch_us(start_time) < CAST(14400000000 AS BIGINT) AND big AND lead(big) OVER (PARTITION BY source ORDER BY i), false) AS link FROM a),
c AS (SELECT *, i - sum(CAST(link AS INTEGER)) OVER (PARTITION BY source ORDER BY i) AS run FROM b),
d AS (SELECT *, link AND row_number() OVER (PARTITION BY source, link, run ORDER BY i) % 2 = 1 AS first FROM c),
f AS (SELECT *, coalesce(lag(first) OVER (PARTITION BY source ORDER BY i), false) AS gone FROM d)
SELECT source, epoch_us(start_time) AS start_time, epoch_us(CASE WHEN first THEN ne ELSE end_time END) AS end_time, photo_count + CASE WHEN first THEN nc ELSE 0 END AS photo_count FROM f WHERE NOT gone""")
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = S.sessionize(X.photos(spark, sf_dir), BY, 20, 10)
    return _micros(S.merge_sessions(games, BY, max_gap=40, min_duration=10, min_photos=3), "start_time", "end_time")


_SPLITS = """splits AS (SELECT ts AS split_ts FROM photos WHERE photo_id % 1000 = 7 UNION ALL SELECT ts + INTERVAL 5 MINUTE FROM photos WHERE photo_id % 1000 = 13)"""


@query("d5_apply_manual_splits", f"""WITH {_games_sql(30, 30)}, {_SPLITS}, s AS (SELECT DISTINCT split_ts FROM splits),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start_time, end_time) AS game_id FROM games),
i AS (SELECT source, game_id, start_time, end_time, split_ts FROM numbered JOIN s ON split_ts BETWEEN start_time AND end_time),
p AS (SELECT source, game_id, split_ts AS t, 1 AS o FROM i UNION ALL SELECT DISTINCT source, game_id, start_time, 0 FROM i UNION ALL SELECT DISTINCT source, game_id, end_time, 2 FROM i),
q AS (SELECT source, game_id, t AS start_time, lead(t) OVER (PARTITION BY source, game_id ORDER BY o, t) AS end_time, row_number() OVER (PARTITION BY source, game_id ORDER BY o, t) AS part FROM p),
h AS (SELECT q.source, q.game_id, part, q.start_time, q.end_time, count(*) AS photo_count FROM q JOIN photos f ON f.source = q.source AND f.ts BETWEEN q.start_time AND q.end_time WHERE q.end_time IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
u AS (SELECT source, start_time, end_time, photo_count FROM h UNION ALL SELECT source, start_time, end_time, photo_count FROM numbered WHERE (source, game_id) NOT IN (SELECT source, game_id FROM i))
SELECT source, epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time, photo_count, CAST(row_number() OVER (PARTITION BY source ORDER BY start_time, end_time) AS INTEGER) AS game_id FROM u""")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = X.photos(spark, sf_dir)
    splits = photos.where("photo_id % 1000 = 7").select(F.col("ts").alias("split_ts")).unionByName(photos.where("photo_id % 1000 = 13").select((F.col("ts") + F.expr("interval 5 minutes")).alias("split_ts")))
    return _micros(S.apply_manual_splits(_numbered(photos, 30, 30), photos, splits, BY, min_photos=3), "start_time", "end_time")


@query("f1_game_summary", f"""WITH {_games_sql(30, 30)}, x AS ({_GAPS}) SELECT source, game_id, photo_count, round((end_time - start_time) / 6e7, 6) AS duration_min, round(gap_before_s / 60, 6) AS gap_before_min, round(gap_after_s / 60, 6) AS gap_after_min FROM x""")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.game_summary(_numbered(X.photos(spark, sf_dir), 30, 30), BY)
    return s.select("source", "game_id", "photo_count", *[F.round(c, 6).alias(c) for c in ("duration_min", "gap_before_min", "gap_after_min")])


@query("f2_detected_dates", f"WITH {X.PHOTOS} SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM photos")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.detected_dates(X.photos(spark, sf_dir)).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("h6_sample_files_per_game", f"""WITH {_games_sql(30, 30)}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start_time, end_time) AS game_id FROM games),
p AS (SELECT n.source, CAST(n.game_id AS INTEGER) AS game_id, f.photo_id, row_number() OVER (PARTITION BY n.source, n.game_id ORDER BY f.ts, f.photo_id) AS place FROM n JOIN photos f ON f.source = n.source AND f.ts BETWEEN n.start_time AND n.end_time)
SELECT source, game_id, photo_id, CAST(place AS INTEGER) AS place FROM p WHERE place <= 10""")
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = X.photos(spark, sf_dir)
    return S.sample_files_per_game(S.game_photos(photos, _numbered(photos, 30, 30), BY), BY).select("source", "game_id", "photo_id", "place")


_NAMES = f"""{X.PHOTOS}, n AS (SELECT photo_id, CASE photo_id % 6 WHEN 0 THEN filename WHEN 1 THEN 'IMG_' || substr(filename, 1, 15) || '.JPG' WHEN 2 THEN substr(filename, 1, 15) || '.png' WHEN 3 THEN 'holiday' || photo_id || '.jpg'
  WHEN 4 THEN substr(filename, 1, 15) || '.' || substr(filename, 17, 3) || '.jpg' ELSE substr(filename, 1, 15) || '77_x.jpeg' END AS name FROM photos)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda a, n: F.substring("filename", a, n)
    form = F.when(F.col("k") == 0, F.col("filename")).when(F.col("k") == 1, F.concat(F.lit("IMG_"), f(1, 15), F.lit(".JPG"))).when(F.col("k") == 2, F.concat(f(1, 15), F.lit(".png")))
    form = form.when(F.col("k") == 3, F.concat(F.lit("holiday"), F.col("photo_id").cast("string"), F.lit(".jpg"))).when(F.col("k") == 4, F.concat(f(1, 15), F.lit("."), f(17, 3), F.lit(".jpg"))).otherwise(F.concat(f(1, 15), F.lit("77_x.jpeg")))
    return X.photos(spark, sf_dir).withColumn("k", F.col("photo_id") % 6).select("photo_id", form.alias("name"))


@query("b1_photo_ts", f"""WITH {_NAMES} SELECT photo_id, CASE photo_id % 6 WHEN 3 THEN NULL ELSE epoch_us(strptime(regexp_extract(name, '[0-9]{{8}}_[0-9]{{6}}'), '%Y%m%d_%H%M%S')) + CASE WHEN photo_id % 6 = 0 THEN CAST(substr(name, 17, 3) AS BIGINT) * 1000 ELSE 0 END END AS ts FROM n""")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("photo_id", F.unix_micros(names.photo_ts(F.col("name"))).alias("ts"))


@query("b2_photo_ts_v1", f"""WITH {_NAMES} SELECT photo_id, CASE WHEN photo_id % 6 = 4 THEN epoch_us(strptime(substr(name, 1, 15), '%Y%m%d_%H%M%S')) END AS ts FROM n""")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("photo_id", F.unix_micros(names.photo_ts_v1(F.col("name"))).alias("ts"))


@query("a2_pattern_filter", f"""WITH {_NAMES} SELECT photo_id, name FROM n WHERE name GLOB '202401*_*' AND regexp_matches(lower(name), '\\.(jpg|jpeg|png)$')""")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).where(F.col("name").rlike(names.glob_regex("202401*_*")) & F.lower("name").rlike(r"\.(jpg|jpeg|png)$"))


_LINES = f"""{X.PHOTOS}, lines AS (SELECT photo_id, CASE photo_id % 5 WHEN 0 THEN '# note' WHEN 1 THEN strftime(ts, '%H:%M:%S') WHEN 2 THEN ' ' || strftime(ts, '%H%M%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'bad' END AS line, ts FROM photos)"""


@query("a8_read_split_points", f"""WITH {_LINES}, d AS (SELECT date_trunc('day', min(ts)) AS day FROM photos)
SELECT photo_id, epoch_us(CASE WHEN photo_id % 5 = 3 THEN date_trunc('second', ts) ELSE day + (date_trunc('second', ts) - date_trunc('day', ts)) END) AS split_ts FROM lines, d WHERE photo_id % 5 IN (1, 2, 3)""")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = X.photos(spark, sf_dir)
    k = F.col("photo_id") % 5
    line = F.when(k == 0, "# note").when(k == 1, F.date_format("ts", "HH:mm:ss")).when(k == 2, F.concat(F.lit(" "), F.date_format("ts", "HHmmss"))).when(k == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("bad")
    day = photos.agg(F.min("ts")).first()[0]
    lines = photos.select("photo_id", names.split_time(line, F.lit(day)).alias("t"))
    return lines.where("t is not null").select("photo_id", F.unix_micros("t").alias("split_ts"))


@query("a10_layout", f"""WITH {_games_sql(30, 30)}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start_time, end_time) AS game_id FROM games)
SELECT source, CAST(game_id AS INTEGER) AS game_id, photo_count, 'Game' || game_id || '_' || strftime(start_time, '%d%b%Y') || '_' || strftime(start_time, '%H%M%S') || '-' || strftime(end_time, '%H%M%S') AS folder FROM n""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photoflow.sources.sidecars import game_folder

    folder = game_folder(F.col("game_id"), F.col("start_time"), F.col("end_time"))
    return _numbered(X.photos(spark, sf_dir), 30, 30).select("source", "game_id", "photo_count", folder.alias("folder"))


@query("b35_duration_throughput", f"WITH {X.OPERATIONS} SELECT image, printf('%02d:%02d:%02d', CAST(floor(value * 100) AS BIGINT) // 3600, CAST(floor(value * 100) AS BIGINT) % 3600 // 60, CAST(floor(value * 100) AS BIGINT) % 60) AS duration, round(CASE WHEN value > 0 THEN 10 / value ELSE 0 END, 6) AS per_second FROM operations")
def b35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.operations(spark, sf_dir).select("image", names.duration_fmt(F.col("value") * 100).alias("duration"), F.round(names.throughput(F.lit(10), F.col("value")), 6).alias("per_second"))
