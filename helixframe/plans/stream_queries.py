"""Queries of the streaming operators, over the events table as a batch."""

from __future__ import annotations

from ..streaming import windows as W
from .fixtures import table


def stream_tumbling(s, d):
    return W.windowed_counts(table(s, d, "events"))


def stream_sliding(s, d):
    return W.windowed_counts(table(s, d, "events"), size="10 minutes", slide="5 minutes")


def stream_bins(s, d):
    return W.binned_positions(table(s, d, "events"), "user_id", 10)


def stream_sessions(s, d):
    return W.sessions(table(s, d, "events"))


def stream_concurrency(s, d):
    return W.concurrency(table(s, d, "events"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_bins, stream_sessions, stream_concurrency)}
ORACLE_SQL = {
    "stream_tumbling": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sliding": "WITH t AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * k AS w FROM events, (VALUES (0), (1)) AS v(k)) SELECT w AS window_start, w + INTERVAL 10 MINUTE AS window_end, event_type, count(*) AS n FROM t GROUP BY ALL",
    "stream_bins": """SELECT date_trunc('hour', ts) AS window_start, user_id // 10 * 10 AS "start", user_id // 10 * 10 + 10 AS "end", count(*) AS n FROM events GROUP BY ALL""",
    "stream_sessions": """WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, n DESC ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, i""",
    "stream_concurrency": "SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE * k AS minute, count(*) AS depth FROM events, (VALUES (0), (1), (2), (3), (4)) AS v(k) GROUP BY 1",
}
