from curbside.sources.feeds import kafka_feed, read_feed, stream_feed
from curbside.sources.tables import clients, pings, requests, taxis
from curbside.sources.tail import growing_feed

__all__ = ["clients", "growing_feed", "kafka_feed", "pings", "read_feed", "requests", "stream_feed", "taxis"]
