"""Queries over pages as recordings to fetch and over nations, suppliers and customers as configurations and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.sources import config, subtitles, urls

#: Subtitles of a page: those in its language, as vtt if it has a script, as srt else.
LANG = r"<html lang=\"([a-z]+)\""


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def url_dedup(s, d):
    listed = pages(s, d).select(F.explode(F.array(F.concat(F.lit("  "), "url", F.lit(" ")), F.regexp_replace("url", r"[?#].*$", ""), F.lit("   "))).alias("url"))
    return urls.lines(listed).distinct()


def _infos(s, d):
    """Pages with links are playlists of them; those of more than seven blocks' worth of links have none."""
    p = pages(s, d).withColumn("lang", F.regexp_extract("html", LANG, 1)).withColumn("links", F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)))
    subs = F.create_map(F.col("lang"), F.array(F.struct(F.when(F.length("html") % 2 == 0, "vtt").otherwise("srt").alias("ext")), F.struct(F.lit("json").alias("ext"))))
    entries = F.transform("links", lambda x: F.struct(F.concat("url", F.lit("#"), x).alias("webpage_url"), subs.alias("subtitles")))
    return p.select(F.col("url").alias("webpage_url"), F.when(F.col("lang") != "de", entries).alias("entries"), subs.alias("subtitles"))


def playlist_expand(s, d):
    return urls.expand(_infos(s, d)).select(F.col("webpage_url").alias("url"))


def subs_filter(s, d):
    return urls.valid_urls(_infos(s, d), "en")


def staged_download(s, d):
    p = pages(s, d)
    subs = p.filter(F.length("html") % 2 == 0).select("url")
    recordings = p.filter(F.length("html") % 3 == 0).select("url")
    return urls.stages(p.select("url"), subs, recordings)


def unique_output_name(s, d):
    p = pages(s, d).select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("name"))
    return urls.unique_names(p, order="page_id").select("page_id", "unique_name")


def output_paths(s, d):
    p = pages(s, d)
    return p.select("page_id", urls.output_path("out/", F.regexp_extract("url", r"^https?://([^/]+)/", 1), F.col("page_id").cast("string"), "subs", F.lit("vtt")).alias("path"))


def reader_dispatch(s, d):
    p = pages(s, d)
    kind = F.when(F.length("html") % 3 == 0, ".VTT").when(F.length("html") % 3 == 1, ".txt").otherwise(".bin")
    return subtitles.dispatch(p.select("page_id", F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), kind, F.lit("?x=a.b")).alias("path"))).select("page_id", F.coalesce("reader", F.lit("none")).alias("reader"))


def retry_limit(s, d):
    """Users as URLs, their events as attempts: those that failed too often and never came."""
    e = s.read.parquet(f"{d}/events.parquet").select("user_id", (F.col("value") > 200).alias("ok"))
    return urls.given_up(e, "user_id", 60)


def configs(s, d) -> DataFrame:
    """id, json: a configuration for each nation."""
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("r"), "n_name")
    text = F.format_string(
        '{"Video": {"Codec": "%s", "bitrate": %d, "max-fps": 25, "resolution": [%d, 480], "codec-options": {"preset": "fast"}, "volume": 3}, "audio": {"sample-rate": %d, "mono": true}, "%d": {"bitrate": %d, "codec": "own"}, "Colour": {"x": 1},'
        ' "timeline-changes": [[0, %d.5, 0], [%d.5, Infinity, 0.5]], "methods": [{"spectrogram": {"th_ratio": 2, "threshold": 1}}, {"a": {}, "b": {}}, {"unheard": {}}, {"tfidf": {"corpus": "%s"}}]}',
        "n_name", F.col("id") * 1000, F.col("r") * 100, F.col("id") * 8000, "r", F.col("id") * 10, "id", F.col("id") + 1, "n_name",
    )
    return n.select("id", text.alias("json"))


def settings(s, d):
    return config.settings(configs(s, d)).select("id", "scope", "codec", F.element_at("codec_options", "preset").alias("preset"), F.coalesce("bitrate", F.lit(-1)).alias("bitrate"), F.coalesce(F.get("resolution", 0), F.lit(-1)).cast("long").alias("width"), F.coalesce("max_fps", F.lit(-1.0)).alias("max_fps"), F.coalesce("sample_rate", F.lit(-1)).cast("long").alias("sample_rate"), F.coalesce("mono", F.lit(False)).alias("mono"))


def unknown_settings(s, d):
    return config.unknown_keys(configs(s, d)).select("id", "scope", F.coalesce("key", F.lit("")).alias("key"))


def settings_validate(s, d):
    return config.invalid_settings(config.settings(configs(s, d)))


def streams(s, d) -> DataFrame:
    """id, stream, type and more: each customer is a stream of its nation's recording."""
    c = s.read.parquet(f"{d}/customer.parquet")
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "video").when(F.col("c_mktsegment") == "FURNITURE", "data").otherwise("audio")
    return c.select(F.col("c_nationkey").alias("id"), (F.col("c_custkey") % 7).alias("stream"), "c_custkey", kind.alias("type"), (F.col("c_acctbal") > 0).alias("has_decoder"), F.floor("c_acctbal").cast("bigint").alias("src_bitrate"), F.lit("copy").alias("src_codec"), F.lit(2).alias("src_channels"))


def _overlaid(s, d):
    return config.overlay(config.supported(streams(s, d)), config.settings(configs(s, d)))


def supported_streams(s, d):
    return config.supported(streams(s, d)).select("c_custkey", "type")


def settings_overlay(s, d):
    return _overlaid(s, d).select("c_custkey", F.coalesce("codec", F.lit("")).alias("codec"), F.coalesce("bitrate", F.lit(-1)).alias("bitrate"))


def settings_default(s, d):
    return config.defaults(_overlaid(s, d)).select("c_custkey", "codec", "bitrate", F.col("channels").cast("long").alias("channels"))


def config_changes(s, d):
    out = config.timeline_changes(configs(s, d))
    return out.withColumn("fin", F.when(F.col("fin") < float("inf"), F.col("fin")).otherwise(-1.0))


def method_list(s, d):
    return config.method_list(configs(s, d)).select("id", F.col("priority").cast("long").alias("priority"), "name")


def unknown_parameters(s, d):
    return config.unknown_parameters(config.method_list(configs(s, d)))


def config_round_trip(s, d):
    """Settings and changes written as an edit list and read again."""
    c = configs(s, d)
    again = config.full_edit_list(config.settings(c), config.timeline_changes(c))
    left = config.timeline_changes(again).groupBy("id").agg(F.count("*").alias("n_changes"), F.sum("beg").alias("beg"))
    return config.settings(again).groupBy("id").agg(F.count("*").alias("n_scopes"), F.sum("bitrate").alias("bitrate"), F.bool_or("mono").alias("mono")).join(left, "id")


N = "n AS (SELECT n_nationkey AS id, n_regionkey AS r, n_name FROM nation)"
SCOPES = f"""{N}, s AS (SELECT id, 'video' AS scope, n_name AS codec, 'fast' AS preset, (id * 1000)::BIGINT AS bitrate, (r * 100)::BIGINT AS width, 25.0::DOUBLE AS max_fps, -1::BIGINT AS sample_rate, false AS mono FROM n
UNION ALL SELECT id, 'audio', NULL, NULL, -1, -1, -1.0, id * 8000, true FROM n UNION ALL SELECT id, r::VARCHAR, 'own', NULL, id * 10, -1, -1.0, -1, false FROM n)"""
STREAMS = "st AS (SELECT c_nationkey AS id, c_custkey % 7 AS stream, c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'video' WHEN c_mktsegment = 'FURNITURE' THEN 'data' ELSE 'audio' END AS type, c_acctbal FROM customer), su AS (SELECT * FROM st WHERE type IN ('video', 'audio') AND c_acctbal > 0)"
OVER = f"{SCOPES}, {STREAMS}, ov AS (SELECT su.*, coalesce(i.codec, t.codec) AS codec, CASE WHEN i.bitrate >= 0 THEN i.bitrate WHEN t.bitrate >= 0 THEN t.bitrate END AS bitrate, t.mono OR coalesce(i.mono, false) AS mono FROM su LEFT JOIN s t ON t.id = su.id AND t.scope = su.type LEFT JOIN s i ON i.id = su.id AND i.scope = su.stream::VARCHAR)"
INFO = """i AS (SELECT url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS links, length(html) % 2 = 0 AS vtt FROM pages),
x AS (SELECT url || '#' || unnest(links) AS url, lang, vtt FROM i WHERE lang <> 'de' AND len(links) > 0 UNION ALL SELECT url, lang, vtt FROM i WHERE lang = 'de' OR len(links) = 0)"""
HOST = "regexp_extract(url, '^https?://([^/]+)/', 1)"

QUERIES = {
    "url_dedup": (url_dedup, "SELECT DISTINCT url FROM (SELECT trim(url) AS url FROM pages UNION ALL SELECT trim(regexp_replace(url, '[?#].*$', '')) FROM pages) WHERE url <> ''"),
    "playlist_expand": (playlist_expand, f"WITH {INFO} SELECT url FROM x"),
    "subs_filter": (subs_filter, f"WITH {INFO} SELECT DISTINCT url FROM x WHERE lang = 'en' AND vtt"),
    "staged_download": (staged_download, "SELECT DISTINCT url, 'subtitles' AS stage FROM pages UNION ALL SELECT DISTINCT url, 'recording' FROM pages WHERE length(html) % 2 = 0 UNION ALL SELECT * FROM (SELECT url, 'done' FROM pages WHERE length(html) % 2 = 0 INTERSECT SELECT url, 'done' FROM pages WHERE length(html) % 3 = 0)"),
    "unique_output_name": (unique_output_name, f"SELECT page_id, name || CASE WHEN k > 0 THEN ' (' || k || ')' ELSE '' END AS unique_name FROM (SELECT page_id, {HOST} AS name, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS k FROM pages)"),
    "output_paths": (output_paths, f"SELECT page_id, 'out/' || {HOST} || '-' || page_id || '/subs.vtt' AS path FROM pages"),
    "reader_dispatch": (reader_dispatch, "SELECT page_id, CASE length(html) % 3 WHEN 0 THEN 'webvtt' WHEN 1 THEN 'plain' ELSE 'none' END AS reader FROM pages"),
    "retry_limit": (retry_limit, "SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (NOT value > 200) > 60 AND NOT bool_or(value > 200)"),
    "settings": (settings, f"WITH {SCOPES} SELECT * FROM s"),
    "unknown_settings": (unknown_settings, f"WITH {N} SELECT id, 'video' AS scope, 'volume' AS key FROM n UNION ALL SELECT id, 'colour', '' FROM n"),
    "settings_validate": (settings_validate, f"WITH {N} SELECT id, 'video' AS scope, 'bitrate' AS setting FROM n WHERE id = 0 UNION ALL SELECT id, r::VARCHAR, 'bitrate' FROM n WHERE id = 0 UNION ALL SELECT id, 'video', 'resolution' FROM n WHERE r = 0 UNION ALL SELECT id, 'audio', 'sample_rate' FROM n WHERE id = 0"),
    "supported_streams": (supported_streams, f"WITH {STREAMS} SELECT c_custkey, type FROM su"),
    "settings_overlay": (settings_overlay, f"WITH {OVER} SELECT c_custkey, coalesce(codec, '') AS codec, coalesce(bitrate, -1)::BIGINT AS bitrate FROM ov"),
    "settings_default": (settings_default, f"WITH {OVER} SELECT c_custkey, coalesce(codec, 'copy') AS codec, coalesce(bitrate, floor(c_acctbal))::BIGINT AS bitrate, CASE WHEN mono THEN 1 ELSE 2 END::BIGINT AS channels FROM ov"),
    "config_changes": (config_changes, f"WITH {N} SELECT id, 0.0::DOUBLE AS beg, id + 0.5::DOUBLE AS fin, 0.0::DOUBLE AS multi FROM n UNION ALL SELECT id, id + 1.5::DOUBLE, -1.0::DOUBLE, 0.5::DOUBLE FROM n"),
    "method_list": (method_list, f"WITH {N} SELECT id, 0::BIGINT AS priority, 'spectrogram' AS name FROM n UNION ALL SELECT id, 3, 'tfidf' FROM n"),
    "unknown_parameters": (unknown_parameters, f"WITH {N} SELECT id, 'spectrogram' AS name, 'threshold' AS key FROM n"),
    "config_round_trip": (config_round_trip, f"WITH {N} SELECT id, 3::BIGINT AS n_scopes, (id * 1010)::BIGINT AS bitrate, true AS mono, 2::BIGINT AS n_changes, id + 1.5::DOUBLE AS beg FROM n"),
}
