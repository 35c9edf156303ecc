"""DuckDB SQL with the same results as the registered queries.

Written from the rules, not from the Spark plans: bans step through each key's
events with a recursive query, address arithmetic uses 128-bit integers.
"""

from __future__ import annotations

TWO48 = "281470681743360::UHUGEINT"  # ::ffff:0.0.0.0
HUGE80 = "1208925819614629174706176::UHUGEINT"  # 2 ** 80

_BASE = r"""
pg AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS url,
         regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
         strlen(html)::BIGINT AS bytes
  FROM pages),
ev AS (
  SELECT event_id AS seq, (epoch_us(ts) // 43200000000 - 39446)::BIGINT AS pace_sec,
         (event_id % 1000)::BIGINT AS ms, user_id AS u, event_type,
         CAST(round(value * 1000) AS BIGINT) AS sent,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
req AS (
  SELECT ev.seq, 1704067200 + pace_sec AS sec,
         ((1704067200 + pace_sec) * 1000000 + ms * 1000)::BIGINT AS time_us, ms, k, client,
         CASE WHEN u % 8 < 5 THEN '00000000000000000000ffff0a' || lower(lpad(to_hex(u // 256 % 256), 2, '0'))
                || lower(lpad(to_hex(u % 256), 2, '0')) || lower(lpad(to_hex(7 + u // 65536 % 240), 2, '0'))
              ELSE '20010db8' || lower(lpad(to_hex(u % 65536), 4, '0')) || lower(lpad(to_hex(u // 65536), 4, '0'))
                || '0000000000000001' END AS client_key,
         CASE WHEN u % 8 < 5 THEN 4 ELSE 6 END::INTEGER AS family,
         CASE WHEN u % 8 < 5 THEN client || '/24' WHEN u < 65536 THEN '2001:db8:' || lower(to_hex(u)) || '::1/48'
              ELSE client || '/48' END AS prefix,
         '203.0.113.1' AS server,
         CASE event_type WHEN 'click' THEN 'GET' WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'POST'
              WHEN 'signup' THEN 'PUT' ELSE 'HEAD' END AS method,
         coalesce(pg.url, '') AS url, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END::INTEGER AS status, sent,
         (k * 1000)::BIGINT AS duration_us, coalesce(pg.host, '') AS host,
         'agent-' || (k % 7) AS agent
  FROM (SELECT *, CASE WHEN u % 8 < 5
          THEN '10.' || (u // 256 % 256) || '.' || (u % 256) || '.' || (7 + u // 65536 % 240)
          ELSE '2001:db8:' || lower(to_hex(u % 65536)) || ':' || lower(to_hex(u // 65536)) || '::1' END AS client,
        (u * 7 + k % 5 * 37) % (SELECT max(page_id) + 1 FROM pages) AS page FROM ev) ev
  LEFT JOIN pg ON pg.page_id = ev.page),
parts AS (
  SELECT * EXCLUDE (bare), CASE WHEN strpos(bare, '/') > 0 THEN substr(bare, 1, strpos(bare, '/') - 1) END AS tag,
         CASE WHEN strpos(bare, '/') > 0 THEN substr(bare, strpos(bare, '/')) END AS rest
  FROM (SELECT *, CASE WHEN url[1] = '/' THEN url[2:] ELSE url END AS bare FROM req)),
tags AS (SELECT DISTINCT split_part(bare, '/', 1) AS tag
         FROM (SELECT CASE WHEN url[1] = '/' THEN url[2:] ELSE url END AS bare FROM pg)
         WHERE strpos(bare, '/') > 0),
routes AS (SELECT tag, '/data/' || tag AS root FROM tags WHERE tag <> 'de'),
inv AS (
  SELECT '/data' || url AS path, min(page_id) % 33 = 7 AS is_dir,
         CASE WHEN min(page_id) % 23 = 6 THEN 0 WHEN min(page_id) % 21 <> 5 THEN max(bytes) END AS size
  FROM pg GROUP BY url HAVING min(page_id) % 20 <> 0),
res AS (
  SELECT parts.*, routes.root || rest AS path FROM parts LEFT JOIN routes USING (tag)),
sized AS (
  SELECT res.*, inv.size,
         CASE WHEN res.path IS NULL THEN 'NO_ROUTE' WHEN inv.path IS NULL THEN 'MISSING'
              WHEN inv.is_dir THEN 'IS_DIR'
              WHEN inv.size IS NULL THEN 'ERROR' WHEN inv.size = 0 THEN 'EMPTY' ELSE 'SIZE' END AS outcome
  FROM res LEFT JOIN inv ON inv.path = res.path),
tracked AS (
  SELECT *, ((sent::HUGEINT * 100000) // size)::BIGINT AS ratio_cost FROM sized WHERE outcome = 'SIZE'),
json_lines AS (
  SELECT seq, '{"time":"' || CASE WHEN seq % 101 <> 0 AND seq % 103 = 0 THEN 'abc'
                ELSE sec || '.' || lpad(ms::VARCHAR, 3, '0') END
         || '","client":"' || CASE WHEN seq % 101 = 0 THEN '999.1.1.1' ELSE client END
         || '","server":"203.0.113.1","method":"' || method || '","url":"' || url
         || '","status":' || status || ',"sent":' || sent || ',"duration":"'
         || CASE WHEN seq % 101 <> 0 AND seq % 103 <> 0 AND seq % 107 = 0 THEN 'x'
                 ELSE '0.' || lpad(k::VARCHAR, 3, '0') END
         || '","host":"' || host || '","agent":"' || agent || '"}' AS json_body
  FROM req),
bodies AS (SELECT seq, CASE WHEN seq % 97 = 0 THEN 'not json' ELSE json_body END AS body FROM json_lines),
dirty AS (
  SELECT seq, CASE WHEN seq % 2 = 1 THEN '<134>Jan  1 00:00:00 edge nginx: ' || body
                   ELSE '<134>1 2024-01-01T00:00:00Z edge nginx - - - ' || body END AS line
  FROM bodies),
manual_json AS (
  SELECT page_id AS seq, CASE WHEN page_id % 10 = 3 THEN 'invalid Prefix'
              WHEN page_id % 10 = 1 THEN '192.0.' || (page_id % 256) || '.0/25'
              ELSE '192.0.' || (page_id % 256) || '.0/24' END AS prefix,
         'manual' AS blame,
         (1704153600 + (page_id % 60) * 60)::BIGINT * 1000000 AS expires_us
  FROM pages WHERE page_id % 11 <> 5)
"""

REQ_MEASURES = [
    ("1", 1, 3, 86400, "request count bucket overflow"),
    ("sent", 40000, 200000, 86400, "byte count bucket overflow"),
]
PATH_MEASURES = [("ratio_cost", 40000, 8000000, 604800, "file ratio bucket overflow")]


def _steps(name, source, key, measures, floor=False, idle=None):
    """CTEs ``<name>_in`` and ``<name>``: one row per event with its outcome."""
    n = range(len(measures))
    costs = ", ".join(f"({m[0]})::BIGINT AS x{i}" for i, m in enumerate(measures))
    gap = "false"
    if idle is not None:
        gap = (
            f"coalesce(sec - max(sec) OVER (PARTITION BY {key} ORDER BY seq ROWS BETWEEN "
            f"UNBOUNDED PRECEDING AND 1 PRECEDING) > {idle}, false)"
        )
    zero = ", ".join(f"0::BIGINT AS l{i}" for i in n)
    level = []
    for i, m in enumerate(measures):
        kept = f"CASE WHEN fresh THEN x{i} ELSE p{i} + x{i} - {m[1]} * delta END"
        if floor:
            kept = f"greatest(0, {kept})"
        level.append(f"({kept})::BIGINT AS l{i}")
    hit = "CASE " + " ".join(f"WHEN l{i} > {m[2]} THEN {i}" for i, m in enumerate(measures)) + " ELSE -1 END"
    prev = ", ".join(f"s.l{i} AS p{i}" for i in n)
    return f"""
{name}_in AS MATERIALIZED (
  SELECT {key} AS gk, seq, sec, time_us, {costs}, {gap} AS idle,
         row_number() OVER (PARTITION BY {key} ORDER BY seq) AS rn
  FROM {source}),
{name} AS (
  SELECT gk, 0::BIGINT AS rn, -1::BIGINT AS seq, {zero}, NULL::BIGINT AS last, 0 AS hit, 0::BIGINT AS base_us
  FROM (SELECT DISTINCT gk FROM {name}_in)
  UNION ALL
  SELECT gk, rn, seq, {", ".join(f"l{i}" for i in n)}, last, {hit} AS hit,
         CASE WHEN moved THEN time_us ELSE last * 1000000 END AS base_us
  FROM (
    SELECT *, {", ".join(level)}, CASE WHEN fresh THEN sec ELSE greatest(sec, plast) END AS last,
           fresh OR delta > 0 AS moved
    FROM (
      SELECT e.*, s.last AS plast, {prev}, (s.hit >= 0 OR e.idle) AS fresh,
             CASE WHEN s.hit >= 0 OR e.idle THEN 0 ELSE greatest(0, e.sec - s.last) END AS delta
      FROM {name} s JOIN {name}_in e ON e.gk = s.gk AND e.rn = s.rn + 1)))"""


def _blame(measures):
    return "CASE b.hit " + " ".join(f"WHEN {i} THEN '{m[4]}'" for i, m in enumerate(measures)) + " END"


def _expires(measures):
    ban = "CASE b.hit " + " ".join(f"WHEN {i} THEN {m[3]}" for i, m in enumerate(measures)) + " END"
    return f"(b.base_us + {ban}::BIGINT * 1000000)::BIGINT"


def _with(*ctes):
    return "WITH RECURSIVE " + ",\n".join([_BASE, *ctes])


_PATH_KEY = "(client_key || ' ' || url)"


def _client_ban_rows(**options):
    return (
        _steps("cb", "req", "client_key", REQ_MEASURES, **options),
        f"""cbans AS (SELECT b.seq, r.client_key, r.prefix, {_blame(REQ_MEASURES)} AS blame,
            {_expires(REQ_MEASURES)} AS expires_us FROM cb b JOIN req r USING (seq) WHERE b.rn > 0 AND b.hit >= 0)""",
    )


def _path_ban_rows(**options):
    return (
        _steps("pb", "tracked", _PATH_KEY, PATH_MEASURES, **options),
        f"""pbans AS (SELECT b.seq, r.client_key, r.url, r.prefix, {_blame(PATH_MEASURES)} AS blame,
            {_expires(PATH_MEASURES)} AS expires_us FROM pb b JOIN req r USING (seq) WHERE b.rn > 0 AND b.hit >= 0)""",
    )


_EVERY = (
    *_client_ban_rows(),
    *_path_ban_rows(),
    """every AS (SELECT prefix, blame, expires_us FROM cbans UNION ALL
       SELECT prefix, blame, expires_us FROM pbans UNION ALL
       SELECT prefix, blame, expires_us FROM manual_json)""",
)
_NOW_US = "1704153630000000"
_NUMBERED = (
    *_client_ban_rows(),
    *_path_ban_rows(),
    """numbered AS (SELECT row_number() OVER (ORDER BY seq, kind) AS id, * FROM (
       SELECT seq, 0::INTEGER AS kind, prefix, blame, expires_us FROM cbans UNION ALL
       SELECT seq, 1::INTEGER, prefix, blame, expires_us FROM pbans))""",
)


def _ranges(source):
    """``rng``: distinct valid prefixes of ``source`` as [lo, nxt) integers."""
    return (
        f"""pfx AS (SELECT DISTINCT prefix, split_part(prefix, '/', 1) AS a,
              try_cast(split_part(prefix, '/', 2) AS INTEGER) AS len FROM {source}
            WHERE prefix LIKE '%/%')""",
        f"""rng AS (SELECT prefix, family, v - v % size AS lo, v - v % size + size AS nxt FROM (
            SELECT prefix, 4::INTEGER AS family,
              {TWO48} + split_part(a, '.', 1)::UHUGEINT * 16777216 + split_part(a, '.', 2)::UHUGEINT * 65536
              + split_part(a, '.', 3)::UHUGEINT * 256 + split_part(a, '.', 4)::UHUGEINT AS v,
              CASE len WHEN 24 THEN 256 WHEN 25 THEN 128 END::UHUGEINT AS size
            FROM pfx WHERE a NOT LIKE '%:%'
            UNION ALL
            SELECT prefix, 6::INTEGER,
              (536939960::UHUGEINT * 65536 + ('0x' || split_part(a, ':', 3))::UHUGEINT) * {HUGE80} + 1, {HUGE80}
            FROM pfx WHERE a LIKE '%:%'))""",
    )


_ISLANDS = (
    """opened AS (SELECT *, coalesce(lo > max(nxt) OVER (PARTITION BY family ORDER BY lo, nxt
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM (SELECT DISTINCT family, lo, nxt FROM rng))""",
    """isl AS (SELECT family, min(lo) AS s, max(nxt) AS e FROM (
        SELECT *, count(*) FILTER (opens) OVER (PARTITION BY family ORDER BY lo, nxt
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM opened) GROUP BY family, island)""",
)
_TILES = (
    """pow AS (SELECT 0 AS k, 1::UHUGEINT AS size UNION ALL SELECT k + 1, size * 2 FROM pow WHERE k < 127)""",
    """tile AS (
        SELECT family, s AS pos, e, 0::UHUGEINT AS lo, -1 AS k FROM isl
        UNION ALL
        SELECT family, (pos + size)::UHUGEINT, e, pos, k FROM (
          SELECT t.family, t.pos, t.e, max(p.k) AS k, max(p.size) AS size FROM tile t JOIN pow p
          ON t.pos % p.size = 0 AND t.pos + p.size <= t.e GROUP BY t.family, t.pos, t.e) WHERE pos < e)""",
    f"""mini AS (SELECT family, lo, CASE family
          WHEN 4 THEN ((lo - {TWO48}) // 16777216) || '.' || ((lo - {TWO48}) // 65536 % 256) || '.'
            || ((lo - {TWO48}) // 256 % 256) || '.' || ((lo - {TWO48}) % 256) || '/' || (32 - k)
          ELSE '2001:db8:' || lower(to_hex((lo // {HUGE80} % 65536)::BIGINT)) || '::/' || (128 - k) END AS prefix
        FROM tile WHERE k >= 0)""",
)
_LIVE = f"live AS (SELECT * FROM every WHERE expires_us > {_NOW_US})"
_RULE = """(SELECT coalesce(string_agg(prefix, ',' ORDER BY family, lo), '') FROM mini)"""
_JSON_RULE = """(SELECT coalesce(string_agg('"' || prefix || '"', ',' ORDER BY family, lo), '') FROM mini)"""


def _hex33(x):
    return f"lpad(lower(to_hex({x})), 33, '0')"


def _hex32(x):
    return f"lpad(lower(to_hex({x})), 32, '0')"


def _level(cost, leak, name, key="client_key", source="req", extra="", floor=False):
    """Closed form: running cost minus leak times the advance of the clock."""
    w = f"OVER (PARTITION BY {key} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    raw = (
        f"SELECT seq, client_key{extra}, (sum({cost}) {w} - {leak} * (max(sec) {w} - first(sec) {w}))::BIGINT AS s "
        f"FROM {source}"
    )
    if not floor:
        return f"{_with()} SELECT seq, client_key{extra}, s AS {name} FROM ({raw})"
    return (
        f"{_with()} SELECT seq, client_key{extra}, (s - least(0, min(s) {w}))::BIGINT AS {name} FROM ({raw})"
    )


_W = "OVER (PARTITION BY client_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LEVELS = f"""lv AS (SELECT seq, client_key, time_us,
    (count(*) {_W} - (max(sec) {_W} - first(sec) {_W}))::BIGINT AS request_level,
    (sum(sent) {_W} - 40000 * (max(sec) {_W} - first(sec) {_W}))::BIGINT AS byte_level FROM req)"""
_OVER = """ov AS (SELECT *, CASE WHEN request_level > 3 THEN 'request count bucket overflow'
    ELSE 'byte count bucket overflow' END AS blame FROM lv WHERE request_level > 3 OR byte_level > 200000)"""
_REASON = """CASE WHEN seq % 97 = 0 THEN 'json' WHEN seq % 101 = 0 THEN 'client' WHEN seq % 103 = 0 THEN 'time' END"""

_CLIENT_OUT = "SELECT seq, client_key, prefix, blame, expires_us FROM cbans"
_PATH_OUT = "SELECT seq, client_key, url, prefix, blame, expires_us FROM pbans"

ORACLES: dict[str, str] = {
    "log_lines_scan": f"{_with()} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, line FROM dirty",
    "syslog_unpack": f"{_with()} SELECT seq, body FROM bodies",
    "parsed_requests": f"""{_with()} SELECT seq, time_us, client, client_key, family, server, method, url, status,
        sent, CASE WHEN seq % 107 <> 0 THEN duration_us END AS duration_us, host, agent
        FROM req WHERE {_REASON} IS NULL""",
    "rejected_lines": f"""{_with()} SELECT seq, {_REASON} AS reject_reason, left(body, 10) AS head
        FROM bodies WHERE {_REASON} IS NOT NULL""",
    "parsed_time": f"""{_with()} SELECT seq, json_extract_string(body, '$.time') AS time_text,
        CASE WHEN regexp_matches(json_extract_string(body, '$.time'), '^[0-9]+\\.[0-9]+$') THEN
          (json_extract_string(body, '$.time')::DECIMAL(20, 9) * 1000000)::BIGINT END AS time_us
        FROM (SELECT seq, CASE WHEN seq % 97 <> 0 THEN body END AS body FROM bodies)""",
    "parsed_duration": f"""{_with()} SELECT seq, json_extract_string(body, '$.duration') AS duration_text,
        CASE WHEN regexp_matches(json_extract_string(body, '$.duration'), '^[0-9]+\\.[0-9]+$') THEN
          (json_extract_string(body, '$.duration')::DECIMAL(20, 9) * 1000000)::BIGINT END AS duration_us
        FROM (SELECT seq, CASE WHEN seq % 97 <> 0 THEN body END AS body FROM bodies)""",
    "client_keys": f"""{_with()} SELECT client, client_key, family, count(*) AS requests
        FROM req GROUP BY ALL""",
    "ban_prefixes": f"{_with()} SELECT seq, client, prefix FROM req",
    "valid_prefixes": f"{_with()} SELECT seq, prefix FROM manual_json WHERE prefix <> 'invalid Prefix'",
    "prefix_ranges": f"""{_with(*_EVERY, *_ranges('every'))} SELECT prefix, family, {_hex32('lo')} AS lo,
        {_hex32('nxt - 1')} AS hi FROM rng UNION ALL
        SELECT DISTINCT prefix, NULL::INTEGER, NULL::VARCHAR, NULL::VARCHAR FROM every WHERE prefix NOT LIKE '%/%'""",
    "merged_ranges": f"""{_with(*_EVERY, *_ranges('every'), *_ISLANDS)}
        SELECT family, {_hex33('s')} AS start, {_hex33('e')} AS "end" FROM isl""",
    "minimal_prefixes": f"""{_with(*_EVERY, *_ranges('every'), *_ISLANDS, *_TILES)}
        SELECT family, prefix FROM mini""",
    "routes_normalized": f"{_with()} SELECT tag, root FROM routes",
    "file_inventory": f"{_with()} SELECT path, size, is_dir, 1704067200000000::BIGINT AS scanned_us FROM inv",
    "url_route_parts": f"""{_with()} SELECT page_id, url, split_part(url, '/', 2) AS tag,
        substr(url, length(split_part(url, '/', 2)) + 2) AS rest FROM pg""",
    "resolved_paths": f"{_with()} SELECT seq, url, tag, path FROM res",
    "size_outcomes": f"{_with()} SELECT seq, path, outcome, size FROM sized",
    "trackable_requests": f"{_with()} SELECT seq, path, size FROM tracked",
    "untracked_requests": f"{_with()} SELECT seq, path FROM sized WHERE outcome <> 'SIZE'",
    "file_ratio_cost": f"{_with()} SELECT seq, sent, size, ratio_cost FROM tracked",
    "fresh_sizes": f"""{_with()} SELECT path, size, is_dir, seen * 1000000 AS scanned_us FROM (
        SELECT '/data' || url AS path, page_id % 33 = 7 AS is_dir,
          CASE WHEN page_id % 20 <> 0 AND page_id % 33 <> 7 THEN bytes END AS size,
          (1704067200 + (page_id * 7919) % 36000)::BIGINT AS seen, page_id FROM pg)
        WHERE page_id % 17 <> 3 AND seen + 21600 >= 1704067200 + 36000
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY seen DESC) = 1""",
    "elapsed_seconds": f"""{_with()} SELECT seq, client_key, greatest(sec, coalesce(prev, sec))::BIGINT AS last_sec,
        greatest(0, sec - coalesce(prev, sec))::BIGINT AS delta FROM (
        SELECT *, max(sec) OVER (PARTITION BY client_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM (SELECT seq, client_key, CASE WHEN seq % 50 = 7 THEN sec - 5 ELSE sec END AS sec FROM req))""",
    "request_levels": _level("1", 1, "request_level"),
    "byte_levels": _level("sent", 40000, "byte_level"),
    "request_levels_floored": _level("1", 1, "request_level", floor=True),
    "byte_levels_floored": _level("sent", 40000, "byte_level", floor=True),
    "ratio_levels": _level("ratio_cost", 40000, "ratio_level", key="client_key, url", source="tracked", extra=", url"),
    "overflow_events": f"{_with(_LEVELS, _OVER)} SELECT seq, client_key, blame, request_level, byte_level FROM ov",
    "first_overflow": f"""{_with(_LEVELS, _OVER)} SELECT client_key, seq, time_us, blame, request_level, byte_level
        FROM ov QUALIFY row_number() OVER (PARTITION BY client_key ORDER BY seq) = 1""",
    "client_bans": f"{_with(*_client_ban_rows())} {_CLIENT_OUT}",
    "client_bans_floored": f"{_with(*_client_ban_rows(floor=True))} {_CLIENT_OUT}",
    "client_bans_idle_reset": f"{_with(*_client_ban_rows(idle=4))} {_CLIENT_OUT}",
    "path_bans": f"{_with(*_path_ban_rows())} {_PATH_OUT}",
    "path_bans_floored": f"{_with(*_path_ban_rows(floor=True))} {_PATH_OUT}",
    "client_bucket_state": f"""{_with(*_client_ban_rows())} SELECT gk AS client_key, l0 AS requests, l1 AS bytes,
        last AS last_sec FROM cb WHERE hit < 0 QUALIFY rn = max(rn) OVER (PARTITION BY gk)
        AND rn = (SELECT max(i.rn) FROM cb_in i WHERE i.gk = cb.gk)""",
    "path_bucket_state": f"""{_with(*_path_ban_rows())} SELECT r.client_key, r.url, l0 AS ratio, last AS last_sec
        FROM (SELECT * FROM pb QUALIFY rn = max(rn) OVER (PARTITION BY gk)) b JOIN req r USING (seq) WHERE hit < 0""",
    "manual_bans": f"""{_with()} SELECT seq, prefix, blame, expires_us FROM manual_json
        WHERE prefix <> 'invalid Prefix'""",
    "all_bans": f"{_with(*_EVERY)} SELECT prefix, blame, expires_us FROM every",
    "active_bans": f"""{_with(*_EVERY, _LIVE)} SELECT prefix, blame, expires_us FROM live
        WHERE prefix <> 'invalid Prefix'""",
    "pruned_bans": f"""{_with(*_NUMBERED)} SELECT id, prefix, blame, expires_us FROM numbered
        WHERE id % 7 <> 0 AND expires_us > {_NOW_US}""",
    "invalid_bans": f"{_with()} SELECT count(*) AS invalid FROM manual_json WHERE prefix = 'invalid Prefix'",
    "bans_with_ids": f"{_with(*_NUMBERED)} SELECT id, seq, kind, prefix, blame, expires_us FROM numbered",
    "bans_after_delete": f"""{_with(*_NUMBERED)} SELECT id, prefix, blame, expires_us FROM numbered WHERE id % 7 <> 0""",
    "ban_rules": f"""{_with(*_EVERY, _LIVE, *_ranges('live'), *_ISLANDS, *_TILES)}
        SELECT {_RULE} AS prefixes, '80,443' AS dst_ports""",
    "rules_json": f"""{_with(*_EVERY, _LIVE, *_ranges('live'), *_ISLANDS, *_TILES)}
        SELECT '{{"prefixes":[' || {_JSON_RULE} || '],"dst_ports":[80,443]}}' AS rule""",
    "tracking_stats": f"""{_with(*_client_ban_rows(), *_path_ban_rows())} SELECT
        (SELECT count(DISTINCT client_key) FROM req) AS clients, (SELECT count(*) FROM req) AS events,
        (SELECT count(*) FROM (SELECT DISTINCT client_key, url FROM tracked)) AS client_paths,
        (SELECT count(*) FROM tracked) AS tracked_events,
        (SELECT count(*) FROM cbans WHERE blame LIKE 'request%') AS request_bans,
        (SELECT count(*) FROM cbans WHERE blame LIKE 'byte%') AS byte_bans,
        (SELECT count(*) FROM pbans) AS ratio_bans""",
    "index_stats": f"{_with()} SELECT tag, outcome, count(*) AS lookups FROM sized GROUP BY ALL",
}
