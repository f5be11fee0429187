"""Declared schemas of the media tables and of stream events."""

from __future__ import annotations

import json

from pyspark.sql import types as T


def ddl(text: str) -> T.StructType:
    """The struct of a column list in SQL's notation: name TYPE [NOT NULL]; no session is needed."""
    out = T.StructType()
    for part in text.split(","):
        name, kind, *rest = part.split()
        out.add(name, {"INT": "integer"}.get(kind, kind.lower()), not rest)
    return out


# Names, types and nullability of the platform's columns.
TABLES: dict[str, T.StructType] = {
    "users": ddl("""
    user_id STRING NOT NULL,
    user_age INT NOT NULL,
    country STRING NOT NULL,
    user_subscription STRING NOT NULL,
    signup_ts TIMESTAMP_NTZ NOT NULL
"""),
    "videos": ddl("""
    video_id STRING NOT NULL,
    video_title STRING NOT NULL,
    video_genre STRING NOT NULL,
    video_duration INT NOT NULL,
    upload_date DATE NOT NULL
"""),
    "playback_history": ddl("""
    session_id STRING NOT NULL,
    history_id STRING NOT NULL,
    user_id STRING NOT NULL,
    video_id STRING NOT NULL,
    playback_date DATE NOT NULL,
    watch_hours DOUBLE NOT NULL
"""),
    "interactions": ddl("""
    interaction_id STRING NOT NULL,
    user_id STRING NOT NULL,
    video_id STRING NOT NULL,
    interaction_type STRING NOT NULL,
    likes BOOLEAN
"""),
    "ad_impressions": ddl("""
    impression_id STRING NOT NULL,
    user_id STRING NOT NULL,
    video_id STRING NOT NULL,
    advertiser_id STRING NOT NULL,
    cost_nanos LONG NOT NULL,
    midpoint BOOLEAN,
    third_quartile BOOLEAN,
    clicked BOOLEAN NOT NULL,
    playback_date DATE NOT NULL
"""),
}
EVENT = ddl("""
    event_id STRING NOT NULL,
    event_type STRING NOT NULL,
    event_timestamp LONG NOT NULL,
    created_ts LONG NOT NULL,
    user_id STRING NOT NULL,
    session_id STRING NOT NULL,
    device_type STRING NOT NULL,
    platform STRING NOT NULL,
    video_id STRING,
    genre_id STRING,
    playback_position_seconds INT,
    ad_campaign_id STRING,
    midpoint BOOLEAN,
    third_quartile BOOLEAN
""")
PROMOTED = ("event_id", "event_type", "event_timestamp", "created_ts", "user_id", "session_id", "video_id")
RAW_EVENT = ddl("""
    raw_payload STRING,
    ingest_ts TIMESTAMP NOT NULL,
    source_file STRING,
    kafka_topic STRING NOT NULL,
    kafka_partition LONG NOT NULL,
    kafka_offset LONG NOT NULL,
    source_offset STRING NOT NULL,
    kafka_key STRING,
    parse_error STRING,
    event_id STRING,
    event_type STRING,
    event_timestamp LONG,
    created_ts LONG,
    user_id STRING,
    session_id STRING,
    video_id STRING
""")
KAFKA = ddl("""
    key BINARY,
    value BINARY,
    topic STRING NOT NULL,
    partition INT NOT NULL,
    offset LONG NOT NULL,
    timestamp TIMESTAMP NOT NULL
""")
DEDUP_KEYS = {"playback_history": "history_id", "interactions": "interaction_id", "ad_impressions": "impression_id", "users": "user_id", "videos": "video_id", "stream_events": "event_id"}


def table_schema(name: str) -> T.StructType:
    """The declared schema; an unknown table is a KeyError."""
    return TABLES[name]


def avro_record(name: str, schema: T.StructType) -> dict:
    """An Avro record for a flat schema of strings, integers, longs and booleans; timestamps in milliseconds are longs."""
    kinds = {"string": "string", "integer": "int", "long": "long", "boolean": "boolean"}
    fields = []
    for f in schema:
        kind: object = kinds[f.dataType.typeName()]
        if f.name in ("event_timestamp", "created_ts"):
            kind = {"type": "long", "logicalType": "timestamp-millis"}
        fields.append({"name": f.name, "type": ["null", kind] if f.nullable else kind} | ({"default": None} if f.nullable else {}))
    return {"type": "record", "name": name, "fields": fields}


def avro_json(name: str = "StreamingEvent") -> str:
    return json.dumps(avro_record(name, EVENT))
