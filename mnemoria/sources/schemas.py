"""Schemas of captured messages, stored messages and chunks."""

from pyspark.sql import types as T

CAPTURED = "content string, role string, conversation_id string, model string, timestamp long, platform string, captured_at long, message_id string, capture_method string, confidence string, seq long"
MESSAGES = "id string, content string, role string, conversation_id string, model string, timestamp long, message_id string, embedding array<float>, source string, created_at timestamp, synced_at timestamp"
CHUNKS = (
    "id string, turn_range string, conversation_id string, platform string, content string, speakers array<string>, turn_count int, start_timestamp long, end_timestamp long, "
    "topics array<string>, hypothetical_questions array<string>, embedding array<float>, user_id string, created_at timestamp, synced_at timestamp"
)


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
