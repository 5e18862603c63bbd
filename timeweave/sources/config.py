"""Settings and edit lists as JSON: reading, checking, overlaying and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Setting, its key in JSON, and its type.
SETTINGS = (("codec", "codec", "string"), ("codec_options", "codec-options", "map<string,string>"), ("bitrate", "bitrate", "bigint"), ("resolution", "resolution", "array<int>"), ("max_fps", "max-fps", "double"), ("sample_rate", "sample-rate", "int"), ("mono", "mono", "boolean"))
NAMES = [name for name, _, _ in SETTINGS]
TYPES = ("video", "audio")
CHANGES, METHODS = "timeline-changes", "methods"
TIME_BASE = 60000
#: Parameters of the analysis methods; others are reported.
METHOD_KEYS = {"spectrogram": ("th_ratio", "dur_multi", "silence_len"), "tfidf": ("corpus", "sent_th_ratio", "remove_sw", "lemmatize")}
KEYS = "map<string,string>"


def members(config: DataFrame) -> DataFrame:
    """id, scope, body from id and json: each top-level member, its key in lower case, its value as JSON."""
    parsed = F.from_json("json", "map<string,string>", {"allowNonNumericNumbers": "true"})
    return config.select("id", F.explode(parsed).alias("scope", "body")).withColumn("scope", F.lower("scope"))


def settings(config: DataFrame) -> DataFrame:
    """id, scope and the SETTINGS of each scope: a stream's type, or its index. Other scopes and other keys are left out."""
    own = members(config).filter(F.col("scope").isin(*TYPES) | F.col("scope").rlike("^[0-9]+$"))
    keyed = own.withColumn("kv", F.transform_keys(F.from_json("body", KEYS), lambda k, v: F.lower(k)))

    def read(key: str, kind: str) -> Column:
        value = F.element_at("kv", key)
        if kind.startswith(("map", "array")):
            return F.from_json(value, kind)
        if kind == "boolean":  # as a truth value of JSON: all but false, 0, "" and null
            return F.when(value.isNotNull(), ~F.lower(value).isin("false", "0", "", "0.0"))
        return value.cast(kind)

    return keyed.select("id", "scope", *(read(key, kind).alias(name) for name, key, kind in SETTINGS))


def unknown_keys(config: DataFrame) -> DataFrame:
    """id, scope, key of what no setting is; key is null if the scope itself isn't known."""
    top = members(config).filter(~F.col("scope").isin(CHANGES, METHODS))
    known = F.col("scope").isin(*TYPES) | F.col("scope").rlike("^[0-9]+$")
    inner = top.filter(known).select("id", "scope", F.explode(F.map_keys(F.from_json("body", KEYS))).alias("key")).withColumn("key", F.lower("key")).filter(~F.col("key").isin(*(key for _, key, _ in SETTINGS)))
    return inner.unionByName(top.filter(~known).select("id", "scope", F.lit(None).cast("string").alias("key")))


def invalid_settings(df: DataFrame) -> DataFrame:
    """id, scope, setting: numbers that must be positive and aren't. Of a resolution both sides must be."""
    bad = F.array_compact(F.array(
        F.when(F.col("bitrate") <= 0, F.lit("bitrate")), F.when(F.exists("resolution", lambda v: v <= 0), F.lit("resolution")),
        F.when(F.col("max_fps") <= 0, F.lit("max_fps")), F.when(F.col("sample_rate") <= 0, F.lit("sample_rate")),
    ))
    return df.select("id", "scope", F.explode(bad).alias("setting"))


def overlay(streams: DataFrame, chosen: DataFrame) -> DataFrame:
    """streams (id, stream, type) with the settings of their index, or else those of their type, key by key."""
    by_type = chosen.select(F.col("id").alias("t_id"), F.col("scope").alias("t_scope"), *(F.col(n).alias(f"t_{n}") for n in NAMES))
    by_index = chosen.select(F.col("id").alias("i_id"), F.col("scope").alias("i_scope"), *(F.col(n).alias(f"i_{n}") for n in NAMES))
    joined = streams.join(by_type, (F.col("id") == F.col("t_id")) & (F.col("type") == F.col("t_scope")), "left")
    joined = joined.join(by_index, (F.col("id") == F.col("i_id")) & (F.col("stream").cast("string") == F.col("i_scope")), "left")
    return joined.select(*streams.columns, *(F.coalesce(f"i_{n}", f"t_{n}").alias(n) for n in NAMES))


def defaults(df: DataFrame) -> DataFrame:
    """Settings completed from the source stream's own (columns src_*); channels is 1 for mono; a time base limits max_fps."""
    out = df.select(*(c for c in df.columns if c not in (*NAMES, *(f"src_{n}" for n in NAMES), "src_channels")), *(F.coalesce(n, f"src_{n}").alias(n) if f"src_{n}" in df.columns else F.col(n) for n in NAMES), F.when(F.col("mono"), 1).otherwise(F.col("src_channels")).alias("channels"))
    return out.withColumn("max_fps", F.least("max_fps", F.lit(float(TIME_BASE))))


def supported(streams: DataFrame) -> DataFrame:
    """Streams of a known type that have a decoder."""
    return streams.filter(F.col("type").isin(*TYPES) & F.coalesce("has_decoder", F.lit(False)))


def first_stream(streams: DataFrame, by: str, order: str) -> DataFrame:
    """The first stream of each recording."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(order))
    return streams.withColumn("tw_k", rank).filter("tw_k = 1").drop("tw_k")


def timeline_changes(config: DataFrame) -> DataFrame:
    """id, beg, fin, multi of the configuration's own changes. Infinity may be bare or a string."""
    rows = members(config).filter(F.col("scope") == CHANGES).select("id", F.explode(F.from_json("body", "array<array<string>>")).alias("c"))
    number = lambda k: F.get("c", k).cast("double")
    return rows.select("id", number(0).alias("beg"), number(1).alias("fin"), number(2).alias("multi"))


def method_list(config: DataFrame) -> DataFrame:
    """id, priority, name, params: the methods in order. An element that isn't a map of one key, or names no method, is skipped."""
    rows = members(config).filter(F.col("scope") == METHODS).select("id", F.posexplode(F.from_json("body", "array<string>")).alias("priority", "m"))
    parsed = rows.withColumn("kv", F.from_json("m", KEYS)).filter(F.size("kv") == 1)
    named = parsed.select("id", "priority", F.map_keys("kv")[0].alias("name"), F.from_json(F.map_values("kv")[0], KEYS).alias("params"))
    return named.filter(F.col("name").isin(*METHOD_KEYS))


def unknown_parameters(methods: DataFrame) -> DataFrame:
    """id, name, key of parameters that a method doesn't have."""
    keys = methods.select("id", "name", F.explode(F.map_keys("params")).alias("key"))
    known = F.create_map(*(x for name, ks in METHOD_KEYS.items() for x in (F.lit(name), F.array(*map(F.lit, ks)))))
    return keys.filter(~F.array_contains(F.element_at(known, F.col("name")), F.col("key")))


def edit_list(changes: DataFrame, by: str = "rec") -> DataFrame:
    """by, json: {"timeline-changes": [[beg, fin, multi], ...]} in order; infinity is written bare, as JSON readers of numbers expect."""
    row = F.struct("beg", "fin", "multi")
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: F.array(r["beg"], r["fin"], r["multi"]))
    out = changes.groupBy(by).agg(F.to_json(F.struct(rows.alias(CHANGES))).alias("json"))
    return out.withColumn("json", F.replace("json", F.lit('"Infinity"'), F.lit("Infinity")))


def full_edit_list(chosen: DataFrame, changes: DataFrame, by: str = "id") -> DataFrame:
    """id, json: settings by scope together with the changes; methods aren't written."""
    body = F.to_json(F.struct(*(F.col(n).alias(key) for n, key, _ in SETTINGS)))
    own = chosen.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scope", body)))).alias("s"))
    text = F.array_join(F.transform(F.map_entries("s"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    joined = own.select(by, text.alias("s")).join(edit_list(changes, by), by, "full")
    inner = F.coalesce(F.regexp_extract("json", r"(?s)^\{(.*)\}$", 1), F.lit(f'"{CHANGES}":[]'))
    return joined.select(by, F.concat(F.lit("{"), F.concat_ws(",", F.when(F.col("s") != "", F.col("s")), inner), F.lit("}")).alias("json"))
