"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.operators import intervals as I
from turnlake.operators import joins as J
from turnlake.plans.views import DAY_US, HYP, LOCAL, SEGMENTS, TURNS, hyp, islands_sql, local, ref, segments, sql, steps_sql
from turnlake.registry import query

PROFILE = """SELECT file_id, CAST(SUM(CASE WHEN active = 0 THEN end_us - start_us ELSE 0 END) AS BIGINT) AS silence_us, CAST(SUM(CASE WHEN active = 1 THEN end_us - start_us ELSE 0 END) AS BIGINT) AS single_us,
 CAST(SUM(CASE WHEN active >= 2 THEN end_us - start_us ELSE 0 END) AS BIGINT) AS overlap_us, MAX(active) AS max_active FROM steps GROUP BY file_id"""


@query("iv_time_profile", sql(SEGMENTS, steps_sql("segments"), select=PROFILE))
def iv_time_profile(spark, d):
    return I.time_profile(segments(spark, d))


@query("iv_speech_regions", sql(SEGMENTS, islands_sql("segments", "file_id", 150000), select="SELECT * FROM isl"))
def iv_speech_regions(spark, d):
    return I.islands(segments(spark, d), gap_us=150_000)


@query("iv_union", sql(SEGMENTS, islands_sql("segments", "file_id"), select="SELECT file_id, start_us, end_us FROM isl"))
def iv_union(spark, d):
    return I.islands(segments(spark, d)).drop("n_segments")


HOUR_US = 3_600_000_000


@query("iv_speech_regions_sliced", sql(SEGMENTS, islands_sql("segments", "file_id", 150000), select="SELECT * FROM isl"))
def iv_speech_regions_sliced(spark, d):
    """The same with windows of an hour, as for recordings larger than a task."""
    return I.islands(segments(spark, d), gap_us=150_000, slice_us=HOUR_US)


@query("iv_time_profile_sliced", sql(SEGMENTS, steps_sql("segments"), select=PROFILE))
def iv_time_profile_sliced(spark, d):
    return I.time_profile(segments(spark, d), slice_us=HOUR_US)


REGIONS = [steps_sql("segments"), "busy AS (SELECT file_id, start_us, end_us FROM steps WHERE active >= 2)", islands_sql("busy", "file_id", name="regions")]


@query("iv_overlap_regions", sql(SEGMENTS, *REGIONS, select="SELECT file_id, start_us, end_us FROM regions"))
def iv_overlap_regions(spark, d):
    return I.overlap_regions(segments(spark, d))


@query("iv_overlap_regions_sliced", sql(SEGMENTS, *REGIONS, select="SELECT file_id, start_us, end_us FROM regions"))
def iv_overlap_regions_sliced(spark, d):
    return I.overlap_regions(segments(spark, d), slice_us=HOUR_US)


@query("iv_overlap_ratio", sql(SEGMENTS, *REGIONS, select="""SELECT s.seg_id, CAST(SUM(CASE WHEN r.start_us IS NULL THEN 0 ELSE LEAST(s.end_us, r.end_us) - GREATEST(s.start_us, r.start_us) END) AS BIGINT) AS covered_us,
 SUM(CASE WHEN r.start_us IS NULL THEN 0 ELSE LEAST(s.end_us, r.end_us) - GREATEST(s.start_us, r.start_us) END)::DOUBLE / GREATEST(ANY_VALUE(s.end_us - s.start_us), 1) AS overlap_ratio
 FROM segments s LEFT JOIN regions r ON s.file_id = r.file_id AND s.start_us < r.end_us AND r.start_us < s.end_us GROUP BY s.seg_id"""))
def iv_overlap_ratio(spark, d):
    s = segments(spark, d)
    return J.overlap_ratio(s, I.overlap_regions(s), ["file_id"], "seg_id").select("seg_id", "covered_us", "overlap_ratio")


@query("iv_clamp_to_speech", sql(HYP, islands_sql("segments", "file_id", 150000, name="reg"), select="""SELECT h.seg_id, COALESCE(GREATEST(h.start_us, p.start_us), h.start_us) AS c_start_us, COALESCE(LEAST(h.end_us, p.end_us), h.end_us) AS c_end_us
 FROM hyp h LEFT JOIN (SELECT * FROM (SELECT h.seg_id, r.start_us, r.end_us, ROW_NUMBER() OVER (PARTITION BY h.seg_id ORDER BY LEAST(h.end_us, r.end_us) - GREATEST(h.start_us, r.start_us) DESC, r.start_us) AS n
 FROM hyp h JOIN reg r ON h.file_id = r.file_id AND h.start_us < r.end_us AND r.start_us < h.end_us) WHERE n = 1) p ON h.seg_id = p.seg_id"""))
def iv_clamp_to_speech(spark, d):
    regions = I.islands(segments(spark, d), gap_us=150_000).drop("n_segments")
    return J.clamp_to_region(hyp(spark, d), regions, ["file_id"], "seg_id").select("seg_id", "c_start_us", "c_end_us")


@query("iv_pairs_overlap_iou", sql(SEGMENTS, select="""SELECT a.seg_id AS a_id, b.seg_id AS b_id, LEAST(a.end_us, b.end_us) - GREATEST(a.start_us, b.start_us) AS overlap_us,
 (LEAST(a.end_us, b.end_us) - GREATEST(a.start_us, b.start_us))::DOUBLE / (GREATEST(a.end_us, b.end_us) - LEAST(a.start_us, b.start_us)) AS iou
 FROM segments a JOIN segments b ON a.file_id = b.file_id AND a.seg_id < b.seg_id AND a.speaker <> b.speaker AND a.start_us < b.end_us AND b.start_us < a.end_us"""))
def iv_pairs_overlap_iou(spark, d):
    pairs = J.overlapping_pairs(segments(spark, d), ["file_id"])
    bounds = ("start_us", "end_us", "r_start_us", "r_end_us")
    return pairs.select(F.col("seg_id").alias("a_id"), F.col("r_seg_id").alias("b_id"), I.overlap_len(*bounds).alias("overlap_us"), I.hull_iou(*bounds).alias("iou"))


@query("iv_overlap_vs_metadata", sql(SEGMENTS, steps_sql("segments"), select="""SELECT file_id, CAST(SUM(CASE WHEN active >= 2 THEN end_us - start_us ELSE 0 END) AS BIGINT) AS overlap_us, CAST(SUM(CASE WHEN active >= 1 THEN end_us - start_us ELSE 0 END) AS BIGINT) AS speech_us,
 SUM(CASE WHEN active >= 2 THEN end_us - start_us ELSE 0 END)::DOUBLE / SUM(CASE WHEN active >= 1 THEN end_us - start_us ELSE 0 END) AS ratio FROM steps GROUP BY file_id"""))
def iv_overlap_vs_metadata(spark, d):
    p = I.time_profile(segments(spark, d)).withColumn("speech_us", F.col("single_us") + F.col("overlap_us"))
    return p.select("file_id", "overlap_us", "speech_us", (F.col("overlap_us") / F.col("speech_us")).alias("ratio"))


SPK = [islands_sql("segments", "file_id, speaker", name="spk"), steps_sql("spk")]


@query("iv_max_speakers", sql(SEGMENTS, *SPK, select="SELECT file_id, MAX(active) AS max_speakers FROM steps GROUP BY file_id"))
def iv_max_speakers(spark, d):
    return I.steps(I.by_speaker(segments(spark, d))).groupBy("file_id").agg(F.max("active").alias("max_speakers"))


@query("iv_overlap_count", sql(SEGMENTS, """m AS (SELECT file_id, start_us AS t, 1 AS dd FROM segments UNION ALL SELECT file_id, end_us, -1 FROM segments), a AS (SELECT file_id, dd, SUM(dd) OVER (PARTITION BY file_id ORDER BY t, dd DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM m)""", select="SELECT file_id, CAST(SUM(CASE WHEN n = 2 AND dd = 1 THEN 1 ELSE 0 END) AS BIGINT) AS overlap_count FROM a GROUP BY file_id"))
def iv_overlap_count(spark, d):
    return I.overlap_starts(segments(spark, d))


@query("iv_gaps", sql(LOCAL, islands_sql("local", "file_id"), f"nx AS (SELECT *, LEAD(start_us) OVER (PARTITION BY file_id ORDER BY start_us) AS nxt FROM isl), e AS (SELECT file_id, MIN(start_us) AS f, MAX(end_us) AS l FROM isl GROUP BY file_id)", select=f"""SELECT file_id, end_us AS start_us, nxt AS end_us FROM nx WHERE nxt - end_us >= 60000000
 UNION ALL SELECT file_id, CAST(0 AS BIGINT), f FROM e WHERE f > 60000000 UNION ALL SELECT file_id, l, CAST({DAY_US} AS BIGINT) FROM e WHERE {DAY_US} - l > 60000000"""))
def iv_gaps(spark, d):
    s = local(spark, d)
    return I.gaps(s, s.select("file_id").distinct().withColumn("duration_us", F.lit(DAY_US)), 60_000_000)


@query("iv_raster_overlap", sql(LOCAL, "f AS (SELECT file_id, unnest(generate_series(start_us // 1000000, end_us // 1000000 - 1)) AS frame FROM local WHERE end_us // 1000000 > start_us // 1000000), c AS (SELECT file_id, frame, COUNT(*) AS n FROM f GROUP BY ALL)", select="SELECT file_id, CAST(SUM(CASE WHEN n >= 2 THEN 1 ELSE 0 END) * 1000000 AS BIGINT) AS overlap_us FROM c GROUP BY file_id"))
def iv_raster_overlap(spark, d):
    return I.raster_overlap(local(spark, d), 1_000_000)


@query("iv_frame_activity", sql(LOCAL, """fs AS (SELECT file_id, speaker, MIN(start_us) AS f FROM local GROUP BY ALL), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY f, speaker) - 1 AS speaker_index FROM fs),
 k AS (SELECT l.file_id, (start_us + 500000) // 1000000 AS f0, (end_us + 500000) // 1000000 AS f1, CAST(speaker_index AS INTEGER) AS speaker_index FROM local l JOIN rk ON l.file_id = rk.file_id AND l.speaker = rk.speaker WHERE speaker_index < 3),
 fr AS (SELECT DISTINCT file_id, speaker_index, unnest(generate_series(f0, f1 - 1)) AS frame FROM k WHERE f1 > f0)""", select="SELECT file_id, speaker_index, COUNT(*) AS frames, CAST(SUM(frame) AS BIGINT) AS frame_sum FROM fr GROUP BY ALL"))
def iv_frame_activity(spark, d):
    runs = I.frame_runs(local(spark, d), 3, 1_000_000)
    return runs.groupBy("file_id", "speaker_index").agg(F.sum(F.expr("end_us - start_us")).alias("frames"), F.sum(F.expr("(start_us + end_us - 1) * (end_us - start_us) div 2")).alias("frame_sum"))


@query("iv_frames", sql(LOCAL, "k AS (SELECT file_id, speaker, (start_us + 5000000) // 10000000 AS f0, (end_us + 5000000) // 10000000 AS f1 FROM local), fs AS (SELECT file_id, speaker, MIN(start_us) AS f FROM local GROUP BY ALL), rk AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY f, speaker) - 1 AS INTEGER) AS speaker_index FROM fs)", select="SELECT DISTINCT k.file_id, unnest(generate_series(f0, f1 - 1)) AS frame, speaker_index FROM k JOIN rk ON k.file_id = rk.file_id AND k.speaker = rk.speaker WHERE f1 > f0 AND speaker_index < 2"))
def iv_frames(spark, d):
    return I.frame_activity(local(spark, d), 2, 10_000_000)


@query("iv_validate_stats", sql(SEGMENTS, islands_sql("segments", "file_id"), select="""SELECT s.file_id, COUNT(*) AS n_segments, COUNT(DISTINCT speaker) AS n_speakers, CAST(SUM(end_us - start_us) AS BIGINT) AS total_us, MAX(end_us) AS last_us, ANY_VALUE(u.union_us) AS union_us
 FROM segments s JOIN (SELECT file_id, CAST(SUM(end_us - start_us) AS BIGINT) AS union_us FROM isl GROUP BY file_id) u ON s.file_id = u.file_id GROUP BY s.file_id"""))
def iv_validate_stats(spark, d):
    s = segments(spark, d)
    u = I.islands(s).groupBy("file_id").agg(F.sum(F.expr("end_us - start_us")).alias("union_us"))
    stats = s.groupBy("file_id").agg(F.count("*").alias("n_segments"), F.countDistinct("speaker").alias("n_speakers"), F.sum(F.expr("end_us - start_us")).alias("total_us"), F.max("end_us").alias("last_us"))
    return stats.join(u, "file_id")


@query("iv_partner", sql(SEGMENTS, """p AS (SELECT a.seg_id, b.seg_id AS b_id, b.start_us AS bs FROM segments a JOIN segments b ON a.file_id = b.file_id AND a.speaker <> b.speaker AND LEAST(a.end_us, b.end_us) - GREATEST(a.start_us, b.start_us) > 10000),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY seg_id ORDER BY bs, b_id) AS n, COUNT(*) OVER (PARTITION BY seg_id) AS n_partners FROM p)""", select="SELECT seg_id, b_id AS partner, n_partners FROM r WHERE n = 1"))
def iv_partner(spark, d):
    return J.first_partner(segments(spark, d), ["file_id"])


@query("iv_overlap_flag", sql(SEGMENTS, select="SELECT a.seg_id, EXISTS (SELECT 1 FROM segments b WHERE a.file_id = b.file_id AND a.speaker <> b.speaker AND LEAST(a.end_us, b.end_us) - GREATEST(a.start_us, b.start_us) > 50000) AS overlapped FROM segments a"))
def iv_overlap_flag(spark, d):
    s = segments(spark, d)
    return s.join(J.first_partner(s, ["file_id"], 50_000), "seg_id", "left").select("seg_id", F.col("partner").isNotNull().alias("overlapped"))


ALIGNED = """al AS (SELECT file_id, seg_id, CAST(unnest(range(0, len(words))) AS INTEGER) AS pos, len(words) AS n, words, start_us, end_us, speaker FROM ref),
 pa AS (SELECT file_id, seg_id, speaker, pos, words[pos + 1] AS word, CASE WHEN seg_id % 3 = 0 THEN start_us + (end_us - start_us) * pos // n ELSE CAST(floor(start_us + (pos / 2.0::DOUBLE) / ((n - 1) / 2.0::DOUBLE + 0.4::DOUBLE) * (end_us - start_us) + 0.5) AS BIGINT) END AS ws,
 CASE WHEN seg_id % 3 = 0 THEN start_us + (end_us - start_us) * (pos + 1) // n ELSE CAST(floor(start_us + (pos / 2.0::DOUBLE + 0.4::DOUBLE) / ((n - 1) / 2.0::DOUBLE + 0.4::DOUBLE) * (end_us - start_us) + 0.5) AS BIGINT) END AS we, start_us, end_us FROM al),
 pw AS (SELECT file_id, seg_id, speaker, pos, word, GREATEST(start_us, LEAST(ws, end_us)) AS word_start_us, GREATEST(GREATEST(start_us, LEAST(ws, end_us)), LEAST(we, end_us)) AS word_end_us FROM pa)"""


def aligned_words(spark, d):
    """Words of turns by alignments that leave every third turn out: half a second from word to word,
    0.4 of them spoken."""
    r = ref(spark, d)
    spoken = F.transform("words", lambda w, i: F.struct(w.alias("word"), (i / 2).alias("start"), (i / 2 + 0.4).alias("end")))
    alignments = r.where("seg_id % 3 <> 0").select(F.concat_ws("_", "file_id", "seg_id").alias("source"), spoken.alias("words"))
    slots = r.select("file_id", "seg_id", "speaker", "start_us", "end_us", "words", F.concat_ws("_", "file_id", "seg_id").alias("source"))
    return I.project_aligned(slots, alignments, "source")


@query("iv_project_aligned", sql(TURNS, ALIGNED, select="SELECT file_id, seg_id, pos, word, word_start_us, word_end_us FROM pw"))
def iv_project_aligned(spark, d):
    return aligned_words(spark, d).select("file_id", "seg_id", "pos", "word", "word_start_us", "word_end_us")


MOVED = "moved AS (SELECT file_id, speaker, start_us - 900000 AS start_us, end_us + 300000 AS end_us FROM ref)"


def flagged_words(spark, d):
    moved = ref(spark, d).select("file_id", "speaker", (F.col("start_us") - 900_000).alias("start_us"), (F.col("end_us") + 300_000).alias("end_us"))
    return I.overlapped_words(aligned_words(spark, d), moved)


@query("iv_word_overlap_flag", sql(TURNS, ALIGNED, MOVED, select="SELECT file_id, seg_id, pos, EXISTS (SELECT 1 FROM moved m WHERE m.file_id = pw.file_id AND m.speaker <> pw.speaker AND LEAST(m.end_us, word_end_us) - GREATEST(m.start_us, word_start_us) > 50000) AS overlapped FROM pw"))
def iv_word_overlap_flag(spark, d):
    return flagged_words(spark, d).select("file_id", "seg_id", "pos", "overlapped")


@query("sink_word_lines", sql(TURNS, ALIGNED, MOVED, select="SELECT file_id, seg_id, pos, printf('%d.%03d %d.%03d %s %s%s', (word_start_us + 500) // 1000000, (word_start_us + 500) // 1000 % 1000, (word_end_us + 500) // 1000000, (word_end_us + 500) // 1000 % 1000, speaker, CASE WHEN EXISTS (SELECT 1 FROM moved m WHERE m.file_id = pw.file_id AND m.speaker <> pw.speaker AND LEAST(m.end_us, word_end_us) - GREATEST(m.start_us, word_start_us) > 50000) THEN '[OVERLAP] ' ELSE '' END, word) AS value FROM pw"))
def sink_word_lines(spark, d):
    from turnlake.sources import sinks as K

    return K.word_lines(flagged_words(spark, d), "seg_id", "pos").select("file_id", "seg_id", "pos", "value")


@query("iv_clip", sql(LOCAL, select="SELECT seg_id, start_us, LEAST(end_us, 43200000000) AS end_us FROM local WHERE start_us < 43200000000 - 1000"))
def iv_clip(spark, d):
    return I.clip(local(spark, d), F.lit(43_200_000_000)).select("seg_id", "start_us", "end_us")


@query("iv_clip_both", sql(LOCAL, select="SELECT seg_id, GREATEST(0, start_us - 3600000000) AS start_us, LEAST(43200000000, end_us - 3600000000) AS end_us FROM local WHERE LEAST(43200000000, end_us - 3600000000) > GREATEST(0, start_us - 3600000000)"))
def iv_clip_both(spark, d):
    moved = local(spark, d).withColumns({"start_us": F.col("start_us") - 3_600_000_000, "end_us": F.col("end_us") - 3_600_000_000})
    return I.clip_both(moved, F.lit(43_200_000_000)).select("seg_id", "start_us", "end_us")


@query("iv_pad", sql(LOCAL, select=f"SELECT seg_id, GREATEST(0, start_us - 100000) AS start_us, LEAST({DAY_US}, end_us + 200000) AS end_us FROM local"))
def iv_pad(spark, d):
    return local(spark, d).select("seg_id", *I.pad(100_000, 200_000, F.lit(DAY_US)))


@query("iv_trim", sql(LOCAL, select="SELECT seg_id, CASE WHEN end_us - start_us > 4100000 THEN start_us + 2000000 ELSE start_us END AS start_us, CASE WHEN end_us - start_us > 4100000 THEN end_us - 2000000 ELSE end_us END AS end_us FROM local"))
def iv_trim(spark, d):
    return local(spark, d).select("seg_id", *I.trim(2_000_000))


@query("iv_shift", sql(LOCAL, select="SELECT seg_id, GREATEST(0, start_us - 5000000) AS start_us, GREATEST(GREATEST(0, start_us - 5000000), end_us - 9000000) AS end_us FROM local"))
def iv_shift(spark, d):
    return local(spark, d).select("seg_id", *I.shift(-5_000_000, -9_000_000))


@query("iv_split_long", sql(LOCAL, "n AS (SELECT *, CAST(GREATEST(1, (end_us - start_us + 28999999) // 29000000) AS INTEGER) AS parts FROM local), p AS (SELECT *, unnest(range(0, parts)) AS part FROM n)", select="SELECT seg_id, CAST(part AS INTEGER) AS part, parts, start_us + (end_us - start_us) * part // parts AS start_us, start_us + (end_us - start_us) * (part + 1) // parts AS end_us FROM p"))
def iv_split_long(spark, d):
    return I.split_long(local(spark, d), 29_000_000).select("seg_id", "part", "parts", "start_us", "end_us")


@query("iv_split_long_text", sql(TURNS, """n AS (SELECT file_id, seg_id, array_to_string(words, ' ') AS text, words, start_us, end_us, CAST(GREATEST(1, (end_us - start_us + 4999999) // 5000000) AS INTEGER) AS parts FROM ref), p AS (SELECT *, CAST(unnest(range(0, parts)) AS INTEGER) AS part FROM n),
 t AS (SELECT *, GREATEST(1, len(words) // parts) AS step FROM p), u AS (SELECT *, CASE WHEN parts = 1 THEN array_to_string(words, ' ') WHEN part = parts - 1 THEN array_to_string(words[part * step + 1:], ' ') ELSE array_to_string(words[part * step + 1:(part + 1) * step], ' ') END AS tt FROM t)""", select="""SELECT file_id, seg_id, part, start_us + (end_us - start_us) * part // parts AS start_us, start_us + (end_us - start_us) * (part + 1) // parts AS end_us, CASE WHEN COALESCE(tt, '') = '' THEN text ELSE tt END AS text FROM u"""))
def iv_split_long_text(spark, d):
    lines = ref(spark, d).select("file_id", "seg_id", "start_us", "end_us", F.array_join("words", " ").alias("text"))
    return I.split_long_text(lines, 5_000_000).select("file_id", "seg_id", "part", "start_us", "end_us", "text")


@query("iv_sliding_windows", sql("r AS (SELECT conv_id AS file_id, CAST(COUNT(*) * 7300000 AS BIGINT) AS duration_us FROM conversations GROUP BY conv_id), w AS (SELECT *, unnest(range(0, GREATEST(0, duration_us - 4000000) + 1, 2000000)) AS start_us FROM r)", select="SELECT file_id, start_us, LEAST(duration_us, start_us + 8000000) AS end_us FROM w WHERE LEAST(duration_us, start_us + 8000000) - start_us >= 4000000 OR start_us = 0"))
def iv_sliding_windows(spark, d):
    recordings = spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("file_id")).agg((F.count("*") * 7_300_000).alias("duration_us"))
    return I.sliding_windows(recordings, 8_000_000, 2_000_000).select("file_id", "start_us", "end_us")


@query("iv_gap_rescan", sql(SEGMENTS, "g AS (SELECT *, LEAD(start_us) OVER (PARTITION BY file_id ORDER BY start_us, end_us) - end_us AS gap_us FROM segments)", select="SELECT seg_id, gap_us FROM g WHERE gap_us > 4000000"))
def iv_gap_rescan(spark, d):
    return I.adjacent_gaps(segments(spark, d), 4_000_000).select("seg_id", "gap_us")


@query("iv_other_speaker_in_gap", sql(SEGMENTS, """g AS (SELECT seg_id AS gap_id, file_id, speaker, end_us AS start_us, LEAD(start_us) OVER (PARTITION BY file_id, speaker ORDER BY start_us, seg_id) AS end_us FROM segments)""", select="SELECT gap_id, start_us, end_us FROM g WHERE end_us > start_us AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.file_id = g.file_id AND s.speaker <> g.speaker AND s.start_us < g.end_us AND g.start_us < s.end_us)"))
def iv_other_speaker_in_gap(spark, d):
    from pyspark.sql import Window

    s = segments(spark, d)
    following = F.lead("start_us").over(Window.partitionBy("file_id", "speaker").orderBy("start_us", "seg_id"))
    gaps = s.select(F.col("seg_id").alias("gap_id"), "file_id", "speaker", F.col("end_us").alias("start_us"), following.alias("end_us")).where("end_us > start_us")
    return J.other_speaker_in_gap(gaps, s, ["file_id"]).select("gap_id", "start_us", "end_us")


@query("iv_gap_recovery", sql(SEGMENTS, islands_sql("segments", "file_id"), "g AS (SELECT * FROM (SELECT file_id, end_us AS start_us, LEAD(start_us) OVER (PARTITION BY file_id ORDER BY start_us) AS end_us FROM isl) WHERE end_us - start_us > 4000000), c AS (SELECT seg_id, file_id, start_us + 30000000 AS start_us, end_us + 30000000 AS end_us FROM segments)", select="""SELECT c.seg_id, GREATEST(c.start_us, g.start_us) AS start_us, LEAST(c.end_us, g.end_us) AS end_us FROM c JOIN g ON c.file_id = g.file_id AND c.start_us < g.end_us AND g.start_us < c.end_us
 WHERE LEAST(c.end_us, g.end_us) - GREATEST(c.start_us, g.start_us) > 500000 OR (LEAST(c.end_us, g.end_us) - GREATEST(c.start_us, g.start_us)) * 2 > c.end_us - c.start_us"""))
def iv_gap_recovery(spark, d):
    from pyspark.sql import Window

    s = segments(spark, d)
    following = F.lead("start_us").over(Window.partitionBy("file_id").orderBy("start_us"))
    gaps = I.islands(s).select("file_id", F.col("end_us").alias("start_us"), following.alias("end_us")).where("end_us - start_us > 4000000")
    cues = s.select("seg_id", "file_id", (F.col("start_us") + 30_000_000).alias("start_us"), (F.col("end_us") + 30_000_000).alias("end_us"))
    pairs = J.range_join(cues, J.right_side(gaps, ["file_id"]), ["file_id"]).withColumn("ov", F.expr("least(end_us, r_end_us) - greatest(start_us, r_start_us)"))
    return pairs.where("ov > 500000 or ov * 2 > end_us - start_us").select("seg_id", F.greatest("start_us", "r_start_us").alias("start_us"), F.least("end_us", "r_end_us").alias("end_us"))


@query("iv_merge_rows", sql(TURNS, select="SELECT file_id, speaker, MIN(start_us) AS start_us, ARG_MAX(end_us, start_us) AS end_us, STRING_AGG(text, ' ' ORDER BY start_us, end_us, text) AS text FROM ref GROUP BY ALL"))
def iv_merge_rows(spark, d):
    return I.merge_rows(ref(spark, d), ("file_id", "speaker"))


@query("iv_reindex", sql(SEGMENTS, select="SELECT seg_id, CAST(ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY start_us, end_us, seg_id) AS INTEGER) AS idx FROM segments"))
def iv_reindex(spark, d):
    return I.reindex(segments(spark, d)).select("seg_id", "idx")


@query("iv_slots_to_events", sql(SEGMENTS, "s AS (SELECT seg_id, start_us, end_us, CASE seg_id % 3 WHEN 0 THEN [] WHEN 1 THEN [speaker] ELSE [speaker, 'x'] END AS speakers FROM segments)", select="SELECT seg_id, start_us, end_us, unnest(speakers) AS speaker FROM s"))
def iv_slots_to_events(spark, d):
    speakers = F.expr("case seg_id % 3 when 0 then cast(array() as array<string>) when 1 then array(speaker) else array(speaker, 'x') end")
    return I.slots_to_events(segments(spark, d).select("seg_id", "start_us", "end_us", speakers.alias("speakers")))


@query("iv_timeline_events", sql(SEGMENTS, select="SELECT file_id, start_us, end_us, speaker, 'speech' AS event_type FROM segments"))
def iv_timeline_events(spark, d):
    return segments(spark, d).select("file_id", "start_us", "end_us", "speaker", F.lit("speech").alias("event_type"))


WORDS = "w AS (SELECT file_id, seg_id, speaker, start_us, end_us, CAST(unnest(range(0, len(words))) AS INTEGER) AS pos, len(words) AS n, words FROM ref), pw AS (SELECT file_id, seg_id, speaker, pos, words[pos + 1] AS word, start_us + (end_us - start_us) * pos // n AS word_start_us, start_us + (end_us - start_us) * (pos + 1) // n AS word_end_us FROM w)"


@query("iv_project_words", sql(TURNS, WORDS, select="SELECT file_id, seg_id, pos, word, word_start_us, word_end_us FROM pw"))
def iv_project_words(spark, d):
    return I.project_words(ref(spark, d)).select("file_id", "seg_id", "pos", "word", "word_start_us", "word_end_us")


@query("iv_change_point_lines", sql(TURNS, WORDS, "moved AS (SELECT file_id, seg_id, start_us - CASE WHEN seg_id % 2 = 1 THEN 900000 ELSE 0 END AS start_us, end_us FROM ref)", steps_sql("moved"), "cut AS (SELECT file_id, start_us AS t0, end_us AS t1 FROM steps WHERE active > 0 AND end_us - start_us >= 10000)", select="SELECT p.file_id, t0, t1, speaker, STRING_AGG(word, ' ' ORDER BY word_start_us, seg_id, pos, word) AS text FROM pw p JOIN cut c ON p.file_id = c.file_id AND (word_start_us + word_end_us) // 2 >= t0 AND (word_start_us + word_end_us) // 2 < t1 GROUP BY p.file_id, t0, t1, speaker"))
def iv_change_point_lines(spark, d):
    r = ref(spark, d)
    moved = r.select("file_id", "seg_id", (F.col("start_us") - F.when(F.col("seg_id") % 2 == 1, 900_000).otherwise(0)).alias("start_us"), "end_us")
    return I.change_point_lines(I.project_words(r).select("file_id", "seg_id", "speaker", "pos", "word", "word_start_us", "word_end_us"), moved)
