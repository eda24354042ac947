"""Patterns and field names of the input formats."""

from __future__ import annotations

# They define which text is an entity id, a log line and an audit
# record, so they have to be exactly these for results to be comparable.
UUID_V4 = r"[0-9a-f]{8}-?[0-9a-f]{4}-?4[0-9a-f]{3}-?[89ab][0-9a-f]{3}-?[0-9a-f]{12}"

LOG_HEAD = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) (\S+) (\S+:\d+) (\d+)"
LOG_DEFAULT = LOG_HEAD + r" (\S+) (\S+) \[-\] (.*)"
LOG_TRACE = LOG_HEAD + r" TRACE (\S+) (.*)"
LOG_CONTEXT = LOG_HEAD + r" (\S+) (\S+) \[(\S+) (\S+) (\S+)\] (.*)"

DB_RECORD = r'^(\d+),"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})","(\S+)","(\S+)",(.*)'
DB_RECORD_STRICT = r'^(\d+),"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})","([^"\s]+)","([^"\s]+)",(.*)'

DB_FIELDS = ["id", "timestamp", "event", "tablename", "content"]
LOG_FIELDS = [
    "timestamp",
    "funcName",
    "pathNameLineno",
    "process",
    "levelName",
    "name",
    "content",
    "requestID",
    "user",
    "tenant",
]

LOOKBACK_SECONDS = 300
SNAPSHOT_META = ["timestamp", "IP"]
RECORD_IGNORED = ["statistics", "IP", "timestamp"]
IFACE_COLUMN = "external_ids"
IFACE_KEY = "iface-id"
# End of fixed values.
