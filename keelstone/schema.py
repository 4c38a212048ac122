"""Schemas and fixed values of the data model."""

from __future__ import annotations

#: An entry that never expires.
NEVER = 9223372036854775807

PUT, DEL = "PUT", "DEL"

MUTATIONS = "seq bigint, ts_ms bigint, op string, key string, value string, expires_at_ms bigint"
COMMANDS = "session_id string, seq bigint, ts_ms bigint, argv array<string>"
REPLIES = "session_id string, seq bigint, type string, text string, num bigint, items array<string>, resp string"
SUBSCRIPTIONS = "conn string, kind string, target string, seq_from bigint, seq_to bigint"
MESSAGES = "msg_id bigint, seq bigint, channel string, payload string"
USERS = "username string, password string, allowed array<string>"
