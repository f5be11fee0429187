"""Kafka in batch: topics, producing events and reading a topic. Needs the Kafka connector, and an admin client for topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenflow.operators.bronze import to_kafka
from lumenflow.operators.checks import validated
from lumenflow.schemas import EVENT

PARTITIONS, REPLICATION = 3, 1


def publish(events: DataFrame, servers: str, topic: str, limit: int | None = None) -> int:
    """Write events to a topic, keyed by user_id, and return how many; limit publishes that many of them.

    Events are validated first: a missing or additional column, another type or a null in a required field fails.
    """
    if limit is not None:
        if limit < 0:
            raise ValueError("limit must not be negative")
        events = events.limit(limit)
    sent = Observation()
    rows = to_kafka(validated(events, EVENT), topic).observe(sent, F.count(F.lit(1)).alias("n"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    return sent.get["n"]


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()


def _admin(servers: str):
    try:
        from confluent_kafka.admin import AdminClient
    except ImportError as missing:
        raise RuntimeError("topics need the confluent_kafka package") from missing
    return AdminClient({"bootstrap.servers": servers})


def list_topics(servers: str, timeout: float = 10.0) -> list[str]:
    return sorted(_admin(servers).list_topics(timeout=timeout).topics)


def ensure_topics(servers: str, names: list[str], partitions: int = PARTITIONS, replication: int = REPLICATION) -> list[str]:
    """Create the topics that don't exist; those that do stay as they are. Returns the new ones."""
    from confluent_kafka.admin import NewTopic

    admin = _admin(servers)
    new = [n for n in names if n not in set(admin.list_topics(timeout=10.0).topics)]
    for done in admin.create_topics([NewTopic(n, partitions, replication) for n in new]).values() if new else ():
        done.result()
    return new


def delete_topic(servers: str, name: str) -> None:
    for done in _admin(servers).delete_topics([name]).values():
        done.result()
