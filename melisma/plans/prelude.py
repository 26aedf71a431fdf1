"""DuckDB views of the adapters, as common table expressions that every oracle may start from."""

CTES = r"""
songs AS (
    SELECT p_partkey AS song_id, p_name AS title, p_brand AS artist, p_type AS genre, p_size + 1970 AS year,
           round(p_retailprice * 100)::BIGINT AS duration_ms, p_partkey % 10 AS confidence10 FROM part),
tags AS (
    SELECT song_id, field, label, max(w) AS w FROM (
        SELECT p_partkey AS song_id, 'track_tags' AS field, split_part(p_name, ' ', 1) AS label, 7000::BIGINT AS w FROM part
        UNION ALL SELECT p_partkey, 'track_tags', split_part(p_name, ' ', 2), (4000 + p_size % 5 * 500)::BIGINT FROM part
        UNION ALL SELECT p_partkey, 'genres', p_type, 10000 FROM part
        UNION ALL SELECT p_partkey, 'artist_tags', p_brand, 10000 FROM part) GROUP BY ALL),
collection AS (
    SELECT o_custkey AS user_id, l_partkey AS song_id, min(l_orderkey) AS first_order FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
feedback AS (
    SELECT user_id, event_id AS seq, (props->>'$.k')::BIGINT AS song_id, ts, round(value * 100)::BIGINT AS value100,
           CASE event_type WHEN 'view' THEN 'play' WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'playlist_add' WHEN 'signup' THEN 'favorite' ELSE 'dislike' END AS kind,
           CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 6 WHEN 'purchase' THEN 10 WHEN 'signup' THEN 8 ELSE -10 END::BIGINT AS reward10 FROM events),
steps AS (
    SELECT *, strftime(ts, '%Y-%m-%d') AS day, user_id || '-' || strftime(ts, '%Y-%m-%d') AS trajectory_id,
           row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY seq) AS rank FROM feedback),
messages AS (SELECT conv_id AS session_id, turn, role, text FROM conversations)
"""


def oracle(rest: str, recursive: bool = False) -> str:
    """A statement that can use the adapters' names; ``rest`` starts with further CTEs or SELECT."""
    rest = rest.strip()
    head = f"WITH {'RECURSIVE ' if recursive else ''}{CTES.strip()}"
    return f"{head}\n{rest}" if rest.upper().startswith("SELECT") else f"{head},\n{rest}"
