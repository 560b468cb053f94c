"""The pN_ queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heliovox.llm import abuse, leakage, nearest_time, packing
from heliovox.session import table


POSE_S, CLOUD_S = 0.150, 0.080


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pose and cloud of every camera frame, with the distance in time."""
    frames = table(spark, sf_dir, "zed_frames")
    streams = [("pose", "posetum", "pose_id", "posetum_epoch", POSE_S), ("cloud", "lidar_clouds", "cloud_id", "cloud_epoch", CLOUD_S)]
    out = [
        nearest_time.match(frames, table(spark, sf_dir, name), entity="session_id", left_id="frame_id", left_time="zed_epoch", right_id=key, right_time=time, tolerance_s=most).select(
            "frame_id", F.lit(stream).alias("stream_name"), "match_id", "delta_s"
        )
        for stream, name, key, time, most in streams
    ]
    return out[0].unionByName(out[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).drop("delta_s")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or piece of one, by tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers the packing takes, and how full they are."""
    return packing.report(p6_pack(spark, sf_dir))


def p6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far containers, and windows of them, are from the mixture of sources that was asked for."""
    return packing.mixture(p6_pack(spark, sf_dir))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of evaluation items, with the length of the passage."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).drop("words_held")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores for abusive, hateful and sexual content."""
    return abuse.score(table(spark, sf_dir, "documents"), keep=("source",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories of such content that documents hold."""
    return abuse.found(p8_scores(spark, sf_dir))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of such documents per source."""
    return abuse.rates(p8_scores(spark, sf_dir))


def p8_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the scores stand to the labels of the reviewers."""
    labelled = table(spark, sf_dir, "review_labels").select("doc_id").distinct()
    scores = abuse.score(table(spark, sf_dir, "documents").join(labelled, "doc_id", "left_semi"))
    return abuse.against_reviews(scores, table(spark, sf_dir, "review_labels"))


QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches, "p6_pack": p6_pack, "p6_report": p6_report, "p6_mixture": p6_mixture, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates, "p8_review": p8_review}
_NEAREST = """
select frame_id, '{stream}' as stream_name, match_id{extra} from (
  select f.frame_id, p.{key} as match_id, round((p.us - f.us) / 1e6, 6) as delta_s,
         row_number() over (partition by f.frame_id order by abs(p.us - f.us), p.{key}) as i
  from (select *, cast(round(zed_epoch * 1e6) as bigint) as us from zed_frames where zed_epoch is not null) f
  join (select *, cast(round({time} * 1e6) as bigint) as us from {name} where {time} is not null) p
    on f.session_id = p.session_id and p.us between f.us - {most} and f.us + {most}
) where i = 1"""


def _nearest(extra: str) -> str:
    parts = [_NEAREST.format(stream="pose", key="pose_id", time="posetum_epoch", name="posetum", most=150_000, extra=extra), _NEAREST.format(stream="cloud", key="cloud_id", time="cloud_epoch", name="lidar_clouds", most=80_000, extra=extra)]
    return " union all ".join(parts)


SQL: dict[str, str] = {"p5_found": _nearest(""), "p5_matches": _nearest(", delta_s")}
