"""The brute-force detector over a stream, an addition to the batch one."""

from pyspark.sql import DataFrame, functions as F

from ..operators.logs import BRUTE_FORCE_REQUESTS, looks_like_login


def stream_brute_force(requests: DataFrame, late: str = "10 minutes", least: int = BRUTE_FORCE_REQUESTS) -> DataFrame:
    """As ``brute_force``, for a stream of requests (ts, client_ip, method, uri). Buckets of five
    minutes are given out once they are older than the watermark, in append mode."""
    posts = requests.where((F.lower("method") == "post") & looks_like_login(F.col("uri")))
    counted = posts.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes"), "client_ip").agg(F.count("*").alias("requests"))
    return counted.where(F.col("requests") >= least).select(F.col("window.start").alias("bucket_start"), "client_ip", "requests")


def stream_type_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
