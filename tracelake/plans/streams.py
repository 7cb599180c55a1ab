"""Queries over event streams, in their batch form, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text_streams, traffic
from ..sources.driver_tables import table


def _sse(s, d):
    """Each conversation as a stream; a turn is one event, cut into two chunks."""
    whole = F.concat(F.lit("event: "), "role", F.lit("\r\ndata: "), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), F.lit("\r\n\r\n"))
    turns = table(s, d, "conversations").select(F.col("conv_id").alias("stream_id"), "turn", whole.alias("w"))
    parts = F.array(F.substring("w", 1, 9), F.col("w").substr(F.lit(10), F.length("w")))
    chunks = turns.select("stream_id", "turn", F.posexplode(parts).alias("k", "chunk")).withColumn("seq", F.col("turn") * 2 + F.col("k"))
    return traffic.sse_events(chunks, "stream_id", "seq", "chunk").select("stream_id", "pos", "event", "data")


def _ttft(s, d):
    i = F.col("event_id")
    data = F.when(i % 3 == 0, '{"choices":[{"delta":{"content":"hi"}}]}').when(i % 3 == 1, '{"choices":[{"delta":{"role":"assistant"}}]}').otherwise('{"type":"ping"}')
    rows = table(s, d, "events").select(F.col("user_id").alias("stream_id"), i.alias("at"), (i - 5).alias("started"), data.alias("data"))
    return traffic.first_token(rows, "stream_id", "at", "started")


def _stitched(s, d):
    """Texts as UTF-8, cut every seven bytes, put together again."""
    docs = table(s, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    # An array of chunks, so that rows do not carry the whole text each.
    cut = docs.select("doc_id", F.posexplode(F.expr("transform(sequence(0, cast(floor(length(b) / 7) as int)), k -> substring(b, k * 7 + 1, 7))")).alias("seq", "chunk"))
    whole = text_streams.stitched(cut, "doc_id", "seq", "chunk").groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), ""), 256).alias("digest"))
    # No chunk of an empty text is left.
    return whole.unionByName(docs.filter(F.length("b") == 0).select("doc_id", F.sha2("b", 256).alias("digest")))


QUERIES = {"sse_events": _sse, "ttft": _ttft, "utf8_stitched": _stitched}
ORACLE_SQL = {
    "sse_events": """SELECT conv_id AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS event, '{"t":' || to_json(coalesce(text, '')) || '}' AS data FROM conversations""",
    "ttft": "SELECT user_id AS stream_id, min(event_id) FILTER (WHERE event_id % 3 = 0) - min(event_id - 5) AS ttft_ms, count(*) AS events FROM events GROUP BY 1",
    "utf8_stitched": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
}
