"""Queries over sessions, callers and conversations, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity
from ..sources.driver_tables import table



def _sessions(s, d):
    i = F.col("event_id")
    given = {
        "header": F.when(i % 4 == 0, F.concat(F.lit("h"), i)).when(i % 4 == 1, " "), "conversation": F.when(i % 3 == 0, F.concat(F.lit("c"), i)).when(i % 3 == 1, ""),
        "prompt_cache_key": F.when(i % 5 == 0, F.concat(F.lit("k"), i)), "user": F.when(i % 7 != 0, F.concat(F.lit("u"), i)),
    }
    value, source, scope = identity.session_source(given)
    return table(s, d, "events").select("event_id", value.alias("raw"), source.alias("source"), scope.alias("scope"))


QUERIES = {
    "session_priority": _sessions,
    "first_user_and_system": lambda s, d: identity.first_texts(table(s, d, "conversations")),
    "latest_event_per_user": lambda s, d: identity.latest_state(table(s, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id"),
}
ORACLE_SQL = {
    "session_priority": """SELECT event_id, CASE source WHEN 'header' THEN 'h' || event_id WHEN 'conversation' THEN 'c' || event_id WHEN 'prompt_cache_key' THEN 'k' || event_id WHEN 'user' THEN 'u' || event_id END AS raw, source,
        CASE WHEN source = 'user' THEN 'user' WHEN source IS NULL THEN 'none' ELSE 'session' END AS scope
      FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'header' WHEN event_id % 3 = 0 THEN 'conversation' WHEN event_id % 5 = 0 THEN 'prompt_cache_key' WHEN event_id % 7 <> 0 THEN 'user' END AS source FROM events)""",
    "first_user_and_system": """SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'system') AS system_text, min_by(text, turn) FILTER (WHERE role = 'user') AS first_user_text,
      count(*) AS turns FROM conversations GROUP BY conv_id""",
    "latest_event_per_user": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
}
