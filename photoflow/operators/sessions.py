"""Splitting photos into games by the gaps between them."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoflow.operators.graph import running_total
from photoflow.scratch import materialize, partitions

MICROS = 60_000_000
DAY = 86_400_000_000
#: photos that adaptive sessions look ahead, and photos of a chunk
LOOK, CHUNK = 99, 20_000
#: neighbouring blocks folded by one call
BLOCKS = 64


def minutes(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS))


def _ordered(by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy("ts", "photo_id")


def mark_sessions(photos: DataFrame, by: list[str], min_gap: float = 10) -> DataFrame:
    """photos with `session`: 0, 1, ... within each value of `by`; a gap of min_gap minutes or more starts a new one."""
    w = _ordered(by)
    gap = minutes(F.col("ts"), F.lag("ts").over(w))
    return photos.withColumn("_new", F.when(gap >= min_gap, 1).otherwise(0)).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def mark_sessions_by_range(photos: DataFrame, by: list[str], min_gap: float = 10) -> DataFrame:
    """mark_sessions for sources of any size: one source may fill many tasks.

    Photos are range-partitioned by source and time and each range is scanned alone; its first photo takes
    the one before from the ranges' last photos, and session numbers are carried on by prefix sums over
    one row per range and source.
    """
    order = [*by, "ts", "photo_id"]
    p = photos.repartitionByRange(partitions(photos.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    p = materialize(p, "photos")
    w = Window.partitionBy("_range", *by).orderBy("ts", "photo_id")
    ends = p.groupBy("_range", *by).agg(F.max("ts").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*by).orderBy("_range"))).drop("_end")
    gap = minutes(F.col("ts"), F.coalesce(F.lag("ts").over(w), F.col("_before")))
    flagged = _null_safe(p, ends, ["_range", *by]).withColumn("_new", F.when(gap >= min_gap, 1).otherwise(0))
    sums = flagged.groupBy("_range", *by).agg(F.sum("_new").alias("_n"))
    base = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.withColumn("_base", F.coalesce(base, F.lit(0))).drop("_n")
    local = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _null_safe(flagged.withColumn("_local", local), bases, ["_range", *by]).withColumn("session", F.col("_local") + F.col("_base")).select(*photos.columns, "session")


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), on).select(*[F.col(f"a.{c}") for c in a.columns], *[F.col(f"b.{c}") for c in b.columns if c not in keys])


def sessionize(photos: DataFrame, by: list[str], min_gap: float = 10, min_duration: float = 30, marked: DataFrame | None = None) -> DataFrame:
    """Games of each source: (by, session, start_time, end_time, photo_count), those of min_duration minutes or more.

    A source with a single photo is one game whatever its duration. Null timestamps are left out.
    """
    marked = marked if marked is not None else mark_sessions(photos.where("ts is not null"), by, min_gap)
    games = marked.groupBy(*by, "session").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("photo_count"))
    total = F.sum("photo_count").over(Window.partitionBy(*by))
    games = games.withColumn("_total", total)
    return games.where((minutes(F.col("end_time"), F.col("start_time")) >= min_duration) | (F.col("_total") < 2)).drop("_total")


def number_games(games: DataFrame, by: list[str]) -> DataFrame:
    """game_id: 1, 2, ... in time order within each source."""
    return games.withColumn("game_id", F.row_number().over(Window.partitionBy(*by).orderBy("start_time", "end_time")))


def game_gaps(games: DataFrame, by: list[str]) -> DataFrame:
    """Seconds to the game before and after; a gap of 0 counts as none."""
    w = Window.partitionBy(*by).orderBy("start_time", "end_time")
    seconds = lambda a, b: F.nullif((F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6), F.lit(0.0))
    return games.withColumns({
        "gap_before_s": seconds(F.col("start_time"), F.lag("end_time").over(w)),
        "gap_after_s": seconds(F.lead("start_time").over(w), F.col("end_time")),
    })


def _in_chunks(photos: DataFrame, by: list[str], after: int) -> tuple[DataFrame, Window]:
    """Photos numbered from 0 in each source (idx) and dealt out to chunks, and the window over a chunk.

    A chunk also holds the last photo before it and `after` photos behind it, so its own photos
    (_own = chunk) see the neighbours that they have in the whole source, which may fill many tasks.
    """
    size = max(CHUNK, after)
    p = running_total(photos.withColumn("_one", F.lit(1)), [*by, "ts", "photo_id"], {"idx": "_one"}, "chunks", within=by).drop("_one")
    own, place = F.floor(F.col("idx") / size), F.col("idx") % size
    seen = F.array_compact(F.array(own, F.when(place < after, own - 1), F.when(place == size - 1, own + 1)))
    return p.select("*", own.alias("_own"), F.explode(seen).alias("chunk")), Window.partitionBy(*by, "chunk").orderBy("idx")


def photo_gaps(marked: DataFrame, games: DataFrame, by: list[str]) -> DataFrame:
    """games with the seconds to the neighbouring photos (the older rule), from photos marked with their session."""
    p, w = _in_chunks(marked.select(*by, "session", "ts", "photo_id"), by, 1)
    ends = p.withColumns({"_prev": F.lag("ts").over(w), "_next": F.lead("ts").over(w)}).where("_own = chunk")
    ends = ends.groupBy(*by, "session").agg(F.min_by("_prev", "idx").alias("_prev"), F.max_by("_next", "idx").alias("_next"))
    seconds = lambda a, b: F.nullif((F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6), F.lit(0.0))
    out = games.join(ends, [*by, "session"])
    return out.withColumns({"gap_before_s": seconds(F.col("start_time"), F.col("_prev")), "gap_after_s": seconds(F.col("_next"), F.col("end_time"))}).drop("_prev", "_next")


def lookahead_gap(photos: DataFrame, by: list[str], rows: int = LOOK) -> DataFrame:
    """photos with their gap in minutes and the largest gap among the next `rows` photos (0 if none)."""
    p, w = _in_chunks(photos, by, rows)
    g = p.withColumn("gap", minutes(F.col("ts"), F.lag("ts").over(w)))
    g = g.withColumn("lookahead", F.coalesce(F.max("gap").over(w.rowsBetween(1, rows)), F.lit(0.0)))
    return g.where("_own = chunk").select(*photos.columns, "gap", "lookahead")


def sessionize_adaptive(photos: DataFrame, by: list[str], min_gap: float = 10, min_duration: float = 30, min_photos: int = 50) -> DataFrame:
    """Games whose splitting gap depends on what has been gathered: (by, start_idx, end_idx, start_time, end_time, photo_count).

    A gap of max(2 * min_gap, 30) minutes always splits and one under min_gap never does, so hard splits
    cut each source into blocks that fold independently, and only gaps in between are folded one by one.
    Photos are numbered by range and scanned in chunks that also hold the photos they look at beyond their
    ends, so one source may fill many tasks; a block too small or short for a game is not folded.
    """
    hard = max(2 * min_gap, 30)
    p, w = _in_chunks(photos.where("ts is not null").select(*by, "ts", "photo_id"), by, LOOK)
    p = p.withColumn("prev_ts", F.lag("ts").over(w)).withColumn("gap", minutes(F.col("ts"), F.col("prev_ts")))
    p = p.withColumn("lookahead", F.coalesce(F.max("gap").over(w.rowsBetween(1, LOOK)), F.lit(0.0))).where("_own = chunk").drop("_own")
    p = materialize(p.withColumn("_hard", F.when(F.col("gap") >= hard, 1).otherwise(0)), "gaps")
    chunks = p.groupBy(*by, "chunk").agg(F.sum("_hard").alias("_h"), F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*by, "chunk", F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_base"), F.sum("_c").over(Window.partitionBy(*by)).alias("n")).where(F.col("n") >= min_photos)
    p = _null_safe(p.withColumn("_run", F.sum("_hard").over(w.rowsBetween(Window.unboundedPreceding, 0))), chunks, [*by, "chunk"]).withColumn("block", F.col("_run") + F.col("_base"))
    ends = p.groupBy(*by, "block").agg(F.max("idx").alias("last_idx"), F.max("ts").alias("last_ts"), F.first("n").alias("n"), F.min("idx").alias("first_idx"), F.min("ts").alias("first_ts"))
    ends = ends.where((F.col("last_idx") - F.col("first_idx") + 1 >= min_photos) & (minutes(F.col("last_ts"), F.col("first_ts")) >= min_duration))
    # the first photo of each block and the gaps that may split it
    may = p.where((F.col("idx") == 0) | (F.col("gap") >= min_gap)).select(*by, "block", "idx", "ts", "prev_ts", "gap", "lookahead")
    folded = _null_safe(may, ends, [*by, "block"])
    schema = ", ".join([*[f"{c} {dict(photos.dtypes)[c]}" for c in by], "start_idx long, end_idx long, start_time timestamp, end_time timestamp, photo_count long"])

    def games(block: list) -> list[tuple]:
        rows, head = [], block[0]
        start, start_ts = head.idx, head.ts

        def close(end: int, end_ts: pd.Timestamp) -> None:
            if (end_ts - start_ts).total_seconds() / 60 >= min_duration and end - start + 1 >= min_photos:
                rows.append((start, end, start_ts, end_ts, end - start + 1))

        for r in block[1:]:
            count, lasted = r.idx - start, (r.prev_ts - start_ts).total_seconds() / 60
            if count < min_photos:
                need = hard
            elif lasted >= min_duration:
                need = min_gap
            elif r.lookahead > r.gap * 2 and r.gap < 30:
                need = max(min_gap * 1.5, 25)
            elif start < 200 and r.lookahead > 50:
                need = max(min_gap * 2, 25)
            else:
                need = min_gap
            if r.gap >= need:
                close(r.idx - 1, r.prev_ts)
                start, start_ts = r.idx, r.ts
        if head.last_idx < head.n - 1 or start < head.n - 1:
            close(head.last_idx, head.last_ts)
        return rows

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        source = tuple(pdf.iloc[0][c] for c in by)
        blocks = groupby(pdf.sort_values("idx").drop(columns=by).itertuples(index=False), key=lambda r: r.block)
        rows = [(*source, *game) for _, block in blocks for game in games(list(block))]
        return pd.DataFrame(rows, columns=[*by, "start_idx", "end_idx", "start_time", "end_time", "photo_count"])

    return folded.groupBy(*by, F.floor(F.col("block") / BLOCKS)).applyInPandas(fold, schema)


def _within(times: DataFrame, at: str, spans: DataFrame, by: list[str]) -> DataFrame:
    """Rows of times with each span (start_time to end_time, both included) that holds their `at`.

    A span is met only on the days that it covers, so the join has keys and nothing is broadcast by hand.
    """
    day = lambda c: F.floor(F.unix_micros(c) / F.lit(float(DAY)))
    covered = spans.withColumn("_day", F.explode(F.sequence(day("start_time"), day("end_time"))))
    return times.withColumn("_day", day(at)).join(covered, [*by, "_day"]).where(F.col(at).between(F.col("start_time"), F.col("end_time"))).drop("_day")


def game_photos(photos: DataFrame, games: DataFrame, by: list[str]) -> DataFrame:
    """(by, game_id, photo_id, ts): photos within a numbered game's bounds."""
    bounds = games.select(*by, "game_id", "start_time", "end_time")
    return _within(photos, "ts", bounds, by).select(*by, "game_id", "photo_id", "ts")


def apply_manual_splits(games: DataFrame, photos: DataFrame, splits: DataFrame, by: list[str], min_photos: int = 50) -> DataFrame:
    """Cut numbered games at the split times (column split_ts) inside them, bounds included.

    Segments run from bound to bound, take the photos within both ends (so a photo on a split is in both)
    and stay if they have min_photos; games without a split stay as they are. Renumbered; no gaps yet.
    """
    inside = _within(splits.select("split_ts").where("split_ts is not null").distinct(), "split_ts", games, [])
    cuts = inside.groupBy(*by, "game_id", "start_time", "end_time").agg(F.array_sort(F.collect_list("split_ts")).alias("s"))
    edges = F.concat(F.array("start_time"), F.col("s"), F.array("end_time"))
    parts = cuts.select(*by, "game_id", edges.alias("e")).select(*by, "game_id", "e", F.explode(F.sequence(F.lit(1), F.size("e") - 1)).alias("part"))
    parts = parts.select(*by, "game_id", "part", F.element_at("e", F.col("part")).alias("start_time"), F.element_at("e", F.col("part") + 1).alias("end_time"))
    held = _within(photos, "ts", parts, by).groupBy(*by, "game_id", "part", "start_time", "end_time").agg(F.count("*").alias("photo_count"))
    whole = games.join(cuts.select(*by, "game_id"), [*by, "game_id"], "left_anti")
    cols = [*by, "start_time", "end_time", "photo_count"]
    return number_games(held.where(F.col("photo_count") >= min_photos).select(*cols).unionByName(whole.select(*cols)), by)


def merge_sessions(games: DataFrame, by: list[str], max_gap: float = 30, max_merged: float = 240, min_duration: float = 30, min_photos: int = 50) -> DataFrame:
    """Merge neighbouring games, pairs only, from the earliest on: a merged pair takes part in no other.

    A pair merges when its gap is under max_gap minutes, the whole under max_merged, and both games have
    min_duration minutes and min_photos photos. In a run of mergeable neighbours the odd ones merge.
    """
    w = Window.partitionBy(*by).orderBy("start_time", "end_time")
    nxt = lambda c: F.lead(c).over(w)
    own = minutes(F.col("end_time"), F.col("start_time")) >= min_duration
    big = own & (F.col("photo_count") >= min_photos)
    g = games.withColumns({"_i": F.row_number().over(w), "_big": big, "_n_start": nxt("start_time"), "_n_end": nxt("end_time"), "_n_count": nxt("photo_count")})
    ok = (minutes(F.col("_n_start"), F.col("end_time")) < max_gap) & (minutes(F.col("_n_end"), F.col("start_time")) < max_merged) & F.col("_big") & F.lead("_big").over(w)
    g = g.withColumn("_link", F.coalesce(ok, F.lit(False)))
    g = g.withColumn("_run", F.col("_i") - F.sum(F.col("_link").cast("int")).over(w))
    g = g.withColumn("_k", F.when(F.col("_link"), F.row_number().over(Window.partitionBy(*by, "_link", "_run").orderBy("_i"))))
    g = g.withColumn("_first", F.col("_link") & (F.col("_k") % 2 == 1)).withColumn("_gone", F.coalesce(F.lag("_first").over(w), F.lit(False)))
    kept = g.where("not _gone")
    return kept.select(
        *by, "start_time", F.when(F.col("_first"), F.col("_n_end")).otherwise(F.col("end_time")).alias("end_time"), (F.col("photo_count") + F.when(F.col("_first"), F.col("_n_count")).otherwise(0)).alias("photo_count"),
    )


def game_summary(games: DataFrame, by: list[str]) -> DataFrame:
    """Per numbered game: bounds, minutes, photos and the gaps in minutes (not rounded)."""
    g = game_gaps(games, by)
    return g.select(*by, "game_id", "start_time", "end_time", minutes(F.col("end_time"), F.col("start_time")).alias("duration_min"), "photo_count", (F.col("gap_before_s") / 60).alias("gap_before_min"), (F.col("gap_after_s") / 60).alias("gap_after_min"))


def detected_dates(photos: DataFrame) -> DataFrame:
    return photos.where("ts is not null").select(F.to_date("ts").alias("day")).distinct()


def sample_files_per_game(photos_of_games: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """The first n photos of every game."""
    w = Window.partitionBy(*by, "game_id").orderBy("ts", "photo_id")
    return photos_of_games.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
