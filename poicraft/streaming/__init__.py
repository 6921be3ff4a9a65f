"""Structured Streaming adapters for the row-wise operators."""

from poicraft.streaming.incremental import entity_payload_stream, start_json_sink

__all__ = ["entity_payload_stream", "start_json_sink"]
