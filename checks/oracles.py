"""The same results in SQL. ``RELATIONS`` mirrors ``checks/adapters.py``."""

from __future__ import annotations

import re

RELATIONS = {
    "raw_databases": """
        SELECT DISTINCT p_brand AS name, false AS is_template, true AS allow_conn FROM part
        UNION ALL VALUES ('information_schema', false, true), ('performance_schema', false, true),
          ('lost+found', false, true), ('template1', true, true), ('closed', false, false)""",
    "raw_tables": """
        SELECT p_brand AS database, replace(p_name, ' ', '_') || '_' || p_partkey AS name,
          CASE WHEN p_size % 8 <> 0 THEN CAST(floor(p_retailprice * 1024) AS BIGINT) END AS data_length,
          CASE WHEN p_size % 5 <> 0 THEN CAST(p_size * 4096 AS BIGINT) END AS index_length,
          CASE p_size % 8 WHEN 0 THEN NULL WHEN 1 THEN 'MyISAM' WHEN 2 THEN 'MRG_MyISAM'
            WHEN 3 THEN 'FEDERATED' WHEN 4 THEN 'MEMORY' ELSE 'InnoDB' END AS engine
        FROM part""",
    "dbs": """
        SELECT name FROM raw_databases
        WHERE name NOT IN ('information_schema', 'performance_schema', 'lost+found')""",
    "tbls": """
        SELECT database, name, coalesce(data_length, 0) AS data_size, coalesce(index_length, 0) AS index_size,
          lower(coalesce(engine, 'view')) AS engine
        FROM raw_tables""",
    "fdbs": """
        SELECT name, regexp_matches(name, '(?is)^brand#2.\\z') AS excluded FROM dbs""",
    "ftbls": """
        SELECT t.*, regexp_matches(database || '.' || t.name, '(?is)^(?:.*\\.small.*|brand#1\\.red.*)\\z')
          OR t.engine = 'memory' AS excluded
        FROM tbls t WHERE database IN (SELECT name FROM fdbs WHERE NOT excluded)""",
    "sizes": """
        SELECT d.name AS database, CASE WHEN d.excluded THEN 0 ELSE coalesce((
            SELECT sum(data_size + index_size) FROM ftbls t
            WHERE t.database = d.name AND NOT t.excluded AND t.engine NOT IN ('mrg_myisam', 'federated')), 0)
          END AS size
        FROM fdbs d""",
    "runs": """
        SELECT 'set' || user_id AS backupset, strftime(ts, '%Y%m%d_%H%M%S') AS name, event_id AS run_id,
          CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS plugin,
          ts AS start_time, ts + to_seconds(event_id % 7200) AS stop_time, event_type = 'error' AS failed,
          CAST(floor(floor(value * 1048576) * (50 + event_id % 100) / 100.0::DOUBLE) AS BIGINT) AS estimated_size,
          CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value * 1048576) AS BIGINT) END AS on_disk_size,
          CASE WHEN event_id % 37 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS estimated_size_factor
        FROM events""",
    "capacity": """
        SELECT backupset, total_bytes, required_bytes,
          CAST(floor((substr(backupset, 4)::BIGINT % 20) * total_bytes / 100.0::DOUBLE) AS BIGINT) AS free_bytes
        FROM (SELECT backupset, CAST(sum(on_disk_size) AS BIGINT) + 536870912 AS total_bytes,
                max(estimated_size) AS required_bytes
              FROM runs GROUP BY backupset)""",
    "change_log": """
        SELECT event_id AS seq, user_id AS key,
          CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, value
        FROM events""",
    "applied": """
        SELECT coalesce(b.c_custkey, l.key) AS key, CASE WHEN l.key IS NULL THEN b.c_acctbal ELSE l.value END AS value
        FROM customer b FULL JOIN (
          SELECT * FROM change_log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) l
        ON b.c_custkey = l.key
        WHERE l.op IS NULL OR l.op <> 'D'""",
    "newest_events": """
        SELECT user_id, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
    "set_settings": """
        SELECT 'set' || user_id AS scope, 'run' AS section,
          CASE event_type WHEN 'click' THEN 'backups-to-keep' WHEN 'purchase' THEN 'purge-policy'
            WHEN 'view' THEN 'historic-size' WHEN 'signup' THEN 'estimated-size-factor' ELSE 'colour' END AS key,
          CASE WHEN event_type = 'click' THEN CAST(k - 10 AS VARCHAR)
            WHEN event_type = 'purchase' THEN ['manual', 'before-backup', 'after-backup', 'sometimes'][k % 4 + 1]
            WHEN event_type = 'view' AND k % 3 = 0 THEN 'Yes' ELSE CAST(k AS VARCHAR) END AS value, true AS own
        FROM newest_events
        UNION ALL
        SELECT 'set' || user_id, 'run', CASE event_type WHEN 'click' THEN 'log-level' WHEN 'purchase' THEN 'umask'
            WHEN 'view' THEN 'databases' WHEN 'signup' THEN 'options' ELSE 'log-level' END,
          CASE event_type WHEN 'click' THEN ['Info', 'critical', 'banana'][k % 3 + 1] WHEN 'purchase' THEN CAST(k AS VARCHAR)
            WHEN 'view' THEN ['a', 'a, b', 'a,b,c'][k % 3 + 1] WHEN 'signup' THEN ['--x "a b"', '--x ''a'][k % 2 + 1]
            ELSE 'debug' END, event_type <> 'error'
        FROM newest_events""",
    "default_settings": """
        SELECT scope, 'run' AS section, d.key, d.value
        FROM (SELECT DISTINCT scope FROM set_settings),
          (VALUES ('plugin', NULL), ('backups-to-keep', '1'), ('purge-policy', 'after-backup'),
             ('historic-size', 'yes'), ('estimated-size-factor', '1.0'), ('log-level', 'info'), ('umask', '022'),
             ('databases', '*'), ('options', '')) d(key, value)""",
    "files": """
        SELECT source AS archive, lang || '/doc ' || doc_id || '.txt' AS member,
          CAST(strlen(text) AS BIGINT) AS length, text
        FROM documents""",
    "names": "SELECT text AS s FROM documents UNION ALL SELECT url FROM pages",
    "size_texts": """
        SELECT event_id, regexp_extract(props, '(\\d+)', 1) AS number,
          CASE WHEN event_id % 5 = 0 THEN '.5' ELSE '' END AS fraction,
          ['', 'K', 'm', 'G', 'B', 'x'][event_id % 6 + 1] AS unit
        FROM events""",
    "plan3": """
        SELECT *, CASE WHEN row_number() OVER (PARTITION BY backupset ORDER BY name DESC, run_id DESC) <= 3
          THEN 'keep' ELSE 'purge' END AS action
        FROM runs""",
}


def _named(body: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", body))
    return [name for name in RELATIONS if name in words]


def _sql(body: str) -> str:
    """Put the relations a query uses, directly or not, in front of it."""
    needed: set[str] = set()
    waiting = _named(body)
    while waiting:
        name = waiting.pop()
        if name not in needed:
            needed.add(name)
            waiting += _named(RELATIONS[name])
    ctes = ", ".join(f"{name} AS ({RELATIONS[name]})" for name in RELATIONS if name in needed)
    return f"WITH {ctes} {body}" if ctes else body


def _size_text(n: str, magnitude: str, units: list[str]) -> str:
    cases = " ".join(
        f"WHEN {magnitude} < {1024.0 ** (power + 1):.1f}::DOUBLE THEN printf('%.2f{unit}', {n} / {1024.0 ** power:.1f}::DOUBLE)"
        for power, unit in enumerate(units)
    )
    return f"CASE {cases} END"


_BYTES = ["B", "KB", "MB", "GB", "TB", "PB"]
_SIGNED = ["Bytes", "KB", "MB", "GB", "TB", "PB"]

_FACTOR = """CASE upper(unit) WHEN 'K' THEN 1024.0 WHEN 'M' THEN 1048576.0 WHEN 'G' THEN 1073741824.0
    WHEN 'B' THEN 1.0 WHEN '' THEN {bare} END::DOUBLE"""

_PATH_NAME = """list_reduce(list_transform(regexp_extract_all({c}, '(?s).'), lambda c, i:
    CASE WHEN regexp_full_match(c, '[A-Za-z0-9-]') OR (c = '_' AND i > 1) THEN c
    ELSE '(' || printf('%x', unicode(c)) || ')' END), lambda x, y: x || y)"""

_INSERTED_ORDER = """'(' || o_orderkey || ',' || o_custkey || ',''' || o_orderstatus || ''',' || o_totalprice
    || ',''' || o_orderdate || ''',''' || o_orderpriority || ''')'"""

_ESCAPED_TEXT = """replace(replace(replace(replace(text, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n'), chr(13), '\\r')"""

_TREE = """
    SELECT source || '/' || ['', '.state/', '_parts/', 'deep/er/', 'a b+%41/'][doc_id % 5 + 1] || ['', '.', '_'][doc_id % 3 + 1] || doc_id AS member,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text, CAST(strlen(CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END) AS BIGINT) AS length
    FROM documents"""

_RECORDED_RUNS = """
    SELECT event_type AS backupset, strftime(max(ts), '%Y%m%d_%H%M%S') AS name,
      CASE WHEN max(event_id) % 5 = 0 THEN '' ELSE event_type END AS plugin, sum(event_id) % 3 = 0 AS failed,
      CAST(sum(event_id) AS BIGINT) AS estimated_size, count(*) AS on_disk_size
    FROM events GROUP BY event_type, CAST(ts AS DATE)"""

_SHOP_COUNTS = """
    SELECT 'shop' AS database, 'customer' AS name, count(*) AS n_rows FROM customer
    UNION ALL SELECT 'shop', 'orders', count(*) FROM orders
    UNION ALL SELECT 'stock', 'part', count(*) FROM part
    UNION ALL SELECT 'stock', 'supplier', count(*) FROM supplier"""

_INTERVAL = """
    SELECT event_id, seconds, CAST(floor(seconds / 604800) AS BIGINT) AS w,
      CAST(floor(seconds % 604800 / 86400) AS BIGINT) AS d, CAST(floor(seconds % 86400 / 3600) AS BIGINT) AS h,
      CAST(floor(seconds % 3600 / 60) AS BIGINT) AS m, seconds % 60 AS s
    FROM (SELECT event_id, (event_id * 977) % 2000000
            + CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id / 4.0::DOUBLE END AS seconds
          FROM events)"""


def _counted(column: str, word: str) -> str:
    return f"CASE WHEN {column} > 0 THEN {column} || ' {word}' || CASE WHEN {column} > 1 THEN 's' ELSE '' END END"


def _codec_rows() -> str:
    from checks.queries import CODECS

    values = ", ".join(f"('{fmt}', '{codec}')" for fmt, codec in CODECS)
    return f"""
        SELECT c.format, c.codec, o.* FROM (VALUES {values}) c(format, codec),
          (SELECT count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
             CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(o_orderdate) AS newest
           FROM orders) o"""


_EVENT_GROUP = """
    SELECT event_type, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS id_sum, max(ts) AS newest
    FROM events GROUP BY event_type"""

_MARKS = "event_type AS table, max(event_id) AS max_seq, max(ts) AS max_ts, count(*) AS n_rows"

#: The fields of the documents that ``documents_fields`` reads, a row for each; those that are not there have no type.
_FIELDS = """
    WITH fields AS (
      SELECT unnest([
        {'path': '$', 'type': 'OBJECT'},
        {'path': '$.conv_id', 'type': CASE WHEN conv_id % 2 = 0 THEN 'BIGINT' ELSE 'STRING' END},
        {'path': '$.turn', 'type': CASE WHEN conv_id % 2 = 1 THEN 'OBJECT' WHEN turn IS NOT NULL THEN 'BIGINT' END},
        {'path': '$.turn.n', 'type': CASE WHEN conv_id % 2 = 1 AND turn IS NOT NULL THEN 'BIGINT' END},
        {'path': '$.role', 'type': CASE WHEN role IS NOT NULL THEN 'STRING' END},
        {'path': '$.text', 'type': CASE WHEN conv_id % 2 = 0 AND text IS NOT NULL THEN 'STRING' END},
        {'path': '$.parts', 'type': CASE WHEN conv_id % 2 = 1 THEN 'ARRAY' END},
        {'path': '$.parts[]', 'type': CASE WHEN conv_id % 2 = 1 THEN CASE WHEN text IS NULL THEN 'VOID' ELSE 'BIGINT' END END},
        {'path': '$.parts[]', 'type': CASE WHEN conv_id % 2 = 1 THEN 'VOID' END},
        {'path': '$.meta', 'type': CASE WHEN conv_id % 2 = 1 THEN 'OBJECT' END},
        {'path': '$.meta.body', 'type': CASE WHEN conv_id % 2 = 1 THEN 'OBJECT' END},
        {'path': '$.meta.body.text', 'type': CASE WHEN conv_id % 2 = 1 AND text IS NOT NULL THEN 'STRING' END}
      ], recursive := true) FROM conversations)"""

_BODIES = {
    "list_databases": "SELECT name FROM dbs",
    "list_databases_flags": "SELECT name FROM raw_databases WHERE NOT is_template AND allow_conn",
    "table_metadata": "SELECT * FROM tbls",
    "table_metadata_fast": """
        SELECT database, name, CAST(0 AS BIGINT) AS data_size, CAST(0 AS BIGINT) AS index_size, engine FROM tbls""",
    "run_name_filter": """
        SELECT event_id, name, try_strptime(name, '%Y%m%d_%H%M%S') AS started FROM (
          SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y%m%d_%H%M%S')
            WHEN 1 THEN strftime(ts, '%Y%m%d_%H%M%S') || 'x' WHEN 2 THEN event_type || '_' || event_id
            ELSE strftime(ts, '%Y13%d_%H%M%S') END AS name FROM events)
        WHERE regexp_full_match(name, '\\d{8}_\\d{6}') AND try_strptime(name, '%Y%m%d_%H%M%S') IS NOT NULL""",
    "tree_size": """
        SELECT CAST(sum(strlen(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
          l_linestatus)) + 1) AS BIGINT) AS total_bytes FROM lineitem""",
    "tree_size_hidden": f"SELECT CAST(sum(length) AS BIGINT) AS total_bytes FROM ({_TREE})",
    "tree_listing": f"""
        SELECT CAST(len(steps) AS INTEGER) AS level, FALSE AS is_folder, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes
        FROM (SELECT length, string_split(member, '/') AS steps FROM ({_TREE})) GROUP BY 1
        UNION ALL SELECT CAST(len(steps) AS INTEGER), TRUE, count(*), CAST(0 AS BIGINT) FROM (
          SELECT DISTINCT steps[:i] AS steps FROM (
            SELECT steps, unnest(range(1, len(steps))) AS i FROM (SELECT string_split(member, '/') AS steps FROM ({_TREE})))) GROUP BY 1""",
    "runs_left": f"""
        SELECT backupset, name FROM ({_RECORDED_RUNS}) QUALIFY row_number() OVER (PARTITION BY backupset ORDER BY name DESC) <= 3""",
    "scan_runs": _RECORDED_RUNS,
    "retention_scanned": f"""
        SELECT backupset, name, CASE WHEN row_number() OVER (PARTITION BY backupset ORDER BY name DESC) <= 3 THEN 'keep' ELSE 'purge' END AS action
        FROM ({_RECORDED_RUNS})""",
    "restore_orders": "SELECT * FROM orders",
    "restore_selected": """
        SELECT 'shop.customer' AS table, max(c_custkey) AS max_seq, max(c_acctbal) AS max_ts, count(*) AS n_rows FROM customer
        UNION ALL SELECT 'shop.orders', max(o_orderkey), max(o_totalprice), count(*) FROM orders
        UNION ALL SELECT 'stock.part', max(p_partkey), max(p_retailprice), count(*) FROM part""",
    "documents_json_roundtrip": "SELECT * FROM conversations",
    "documents_fields": f"""
        {_FIELDS} SELECT path, type, count(*) AS n FROM fields WHERE type IS NOT NULL GROUP BY path, type""",
    "documents_field_types": f"""
        {_FIELDS} SELECT path, CASE count(DISTINCT type) FILTER (type <> 'VOID') WHEN 0 THEN 'VOID' WHEN 1 THEN min(type) FILTER (type <> 'VOID')
          ELSE 'VARIANT' END AS type, count(DISTINCT type) FILTER (type <> 'VOID') > 1 AS conflict
        FROM fields WHERE type IS NOT NULL GROUP BY path""",
    "documents_columns": """
        SELECT CASE WHEN conv_id % 2 = 0 THEN conv_id END AS number,
          CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE 'c' || conv_id END AS name, turn, role, text
        FROM conversations""",
    "dump_per_database": """
        SELECT database, count(*) AS tables, CAST(sum(data_size) AS BIGINT) AS data_bytes,
          CAST(sum(index_size) AS BIGINT) AS index_bytes FROM tbls GROUP BY database""",
    "dump_all_counts": _SHOP_COUNTS,
    "restore_from_all": "SELECT * FROM orders",
    "restore_without_database": "SELECT * FROM orders",
    "restore_numeric_names": """
        SELECT f AS format, database, name, n_rows FROM (VALUES ('parquet'), ('json'), ('csv')) t(f), (
          SELECT '1' AS database, 't' AS name, count(*) AS n_rows FROM orders
          UNION ALL SELECT '01', 't', count(*) FROM customer UNION ALL SELECT 'é b', '1.t', count(*) FROM nation)""",
    "chunk_plan_text_key": """
        SELECT role, conv_id, turn, bytes, CAST(floor((sum(bytes) OVER (ORDER BY role, conv_id, turn ROWS UNBOUNDED PRECEDING) - bytes) / 16384)
          AS BIGINT) AS chunk_id
        FROM (SELECT role, conv_id, turn, CAST(strlen(text) AS INTEGER) AS bytes FROM conversations)""",
    "split_files_by_bytes": """
        SELECT 'orders' AS "table", count(*) AS n_rows, true AS within_limit FROM orders
        UNION ALL SELECT 'documents', count(*), true FROM documents""",
    "restore_insert_sql": """
        SELECT 'conversations' AS "table", conv_id AS key, turn::VARCHAR AS detail, text FROM conversations
        UNION ALL SELECT 'documents', doc_id, lang, text FROM documents
        UNION ALL SELECT 'orders', o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority FROM orders""",
    "snapshot_pinned": """
        SELECT 'events' AS "table", event_id AS key FROM events UNION ALL SELECT 'orders', o_orderkey FROM orders""",
    "chunk_plan": """
        SELECT doc_id, bytes, CAST(floor((sum(bytes) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - bytes) / 65536)
          AS BIGINT) AS chunk_id
        FROM (SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes FROM documents)""",
    "split_files": "SELECT count(*) AS n_rows, true AS within_limit FROM orders",
    "manifest": """
        SELECT name, name || '.sql.gz' AS file FROM fdbs WHERE NOT excluded""",
    "insert_sql": f"""
        SELECT 'INSERT IGNORE INTO `chat` VALUES (' || conv_id || ',' || turn || ',''' || role || ''','''
          || {_ESCAPED_TEXT} || ''');' AS statement FROM conversations""",
    "insert_sql_extended": f"""
        SELECT chunk_id, 'INSERT INTO `orders` VALUES ' || string_agg(v, ',' ORDER BY o_orderkey) || ';' AS statement
        FROM (SELECT o_orderkey, v, CAST(floor((sum(strlen(v)) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)
                - strlen(v)) / 65536) AS BIGINT) AS chunk_id
              FROM (SELECT o_orderkey, {_INSERTED_ORDER} AS v FROM orders))
        GROUP BY chunk_id""",
    "order_by_primary": """
        SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_unsorted, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
        FROM orders""",
    "ddl_columns": """
        SELECT c.table_name AS table, CAST(c.ordinal_position AS INTEGER) AS position, c.column_name AS column,
          CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type, n.n_rows
        FROM information_schema.columns c JOIN (
          SELECT 'customer' AS t, count(*) AS n_rows FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem
          UNION ALL SELECT 'orders', count(*) FROM orders) n ON c.table_name = n.t""",
    "dump_current": """
        SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "dump_history": """
        SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events""",
    "history_kept": """
        SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events""",
    "snapshot_cut_counts": """
        WITH cuts(upto) AS (VALUES (TIMESTAMP '2000-01-01'), (TIMESTAMP '2024-01-15'))
        SELECT strftime(upto, '%Y') AS cut, 'events' AS table, count(*) FILTER (ts <= upto) AS n_rows FROM events, cuts GROUP BY upto
        UNION ALL SELECT strftime(upto, '%Y'), 'lineitem', count(*) FILTER (l_shipdate <= upto) FROM lineitem, cuts GROUP BY upto
        UNION ALL SELECT strftime(upto, '%Y'), 'orders', count(*) FILTER (o_orderdate <= upto) FROM orders, cuts GROUP BY upto
        UNION ALL SELECT strftime(upto, '%Y'), 'nation', count(*) FROM nation, cuts GROUP BY upto""",
    "tz_utc": "SELECT event_id, ts - INTERVAL 2 HOUR AS ts FROM events",
    "dump_plan": f"""
        SELECT database, name, '/dumps/today/backup_data/' || {_PATH_NAME.format(c="database")} || '/'
          || {_PATH_NAME.format(c="name")} AS path, data_size + index_size AS est_bytes
        FROM ftbls WHERE NOT excluded""",
    "order_by_size": """
        SELECT database, name, '/dumps/today/backup_data/all_databases' AS path, data_size + index_size AS est_bytes
        FROM ftbls WHERE NOT excluded ORDER BY est_bytes, database, name""",
    "filter_include": """
        SELECT * FROM tbls WHERE regexp_matches(database, '(?is)^brand#[^12]\\z') OR regexp_matches(database, '(?is)^.*#2.\\z')""",
    "filter_exclude": """
        SELECT * FROM tbls WHERE NOT regexp_matches(name, '(?is)^.*ring.*\\z')
          AND NOT regexp_matches(name, '(?is)^....._w.*[0-4]\\z')""",
    "filter_qualified": """
        SELECT * FROM tbls WHERE regexp_matches(database || '.' || name, '(?is)^(?:.*\\.red_.*|brand#1.\\..*)\\z')
          AND NOT regexp_matches(database || '.' || name, '(?is)^(?:.*\\..*5|brand#1\\..*)\\z')""",
    "filter_regex": """
        SELECT * FROM tbls WHERE regexp_matches(name, '(?i)^(?:(?:red|small)_\\w+_\\d{2,3}$|blue)')
          AND NOT regexp_matches(database, '(?i)^brand#1\\d')""",
    "filter_engine": "SELECT * FROM tbls WHERE engine IN ('myisam', 'innodb', 'view')",
    "filtered_catalog": "SELECT * FROM ftbls",
    "filtered_databases": "SELECT * FROM fdbs",
    "filter_optional": """
        SELECT *, engine = 'view' AS excluded FROM tbls WHERE database IN (SELECT name FROM dbs)""",
    "excluded_tables": "SELECT * EXCLUDE (excluded) FROM ftbls WHERE excluded",
    "ignore_lines": "SELECT 'ignore-table = ' || database || '.' || name AS line FROM ftbls WHERE excluded",
    "find_tables": """
        SELECT * FROM tbls WHERE NOT lower(database) LIKE 'brand#3%'
          AND (regexp_matches(database || '.' || name, '(?is)^.*\\..*_widget_.*\\z') OR lower(database) = 'brand#4')
          AND NOT lower(name) LIKE 'red%'""",
    "find_excluded_tables": """
        SELECT * FROM tbls WHERE regexp_matches(database, '(?is)^brand#.\\z') AND lower(name) LIKE 'red%'""",
    "find_databases": """
        SELECT name FROM raw_databases
        WHERE NOT name LIKE '%\\_schema' ESCAPE '\\' AND NOT lower(name) LIKE 'brand#1%' AND name <> 'lost+found'""",
    "valid_runs": "SELECT backupset, name, run_id, plugin FROM runs WHERE plugin <> ''",
    "exclude_files": """
        SELECT archive || '/' || member AS path, length FROM files
        WHERE NOT member LIKE 'fr/%' AND NOT member LIKE '%1.txt'""",
    "filter_objects": """
        SELECT * FROM (
          SELECT CASE event_type WHEN 'click' THEN 'routine' WHEN 'view' THEN 'event' WHEN 'error' THEN 'trigger'
              ELSE 'user' END AS kind, 'db' || user_id AS database, event_type || '_' || event_id AS name
          FROM events)
        WHERE CASE kind WHEN 'routine' THEN database LIKE 'db1%' WHEN 'event' THEN NOT name LIKE '%7'
          WHEN 'trigger' THEN name LIKE '%\\_1%' ESCAPE '\\' AND database <> 'db2' ELSE true END""",
    "dump_set": "SELECT * EXCLUDE (excluded) FROM ftbls WHERE NOT excluded",
    "invalid_views": """
        SELECT 'v_' || l_orderkey AS view, CASE WHEN bool_or(p.p_partkey IS NULL) THEN 'quarantined' ELSE 'valid' END AS status
        FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size % 8 <> 3) p ON l_partkey = p_partkey
        GROUP BY l_orderkey""",
    "invalid_views_deep": """
        WITH RECURSIVE orders_of AS (SELECT DISTINCT l_orderkey AS o FROM lineitem),
        named AS (
          SELECT 'v_' || l_orderkey AS view, 'p_' || l_partkey AS object FROM lineitem WHERE l_linenumber % 3 = 1
          UNION SELECT 'v_' || o, 'v_' || (o - 1) FROM orders_of WHERE o % 12 <> 0
          UNION SELECT 'v_' || o, 'v_' || (o + 5) FROM orders_of WHERE o % 36 = 0),
        there AS (SELECT 'p_' || p_partkey AS object FROM part WHERE p_size % 8 <> 3 UNION SELECT 'v_' || o FROM orders_of),
        broken(view, depth, missing) AS (
          SELECT view, 1, object FROM named WHERE object NOT IN (SELECT object FROM there)
          UNION SELECT n.view, b.depth + 1, b.missing FROM named n JOIN broken b ON n.object = b.view WHERE b.depth < 40)
        SELECT view, min(depth)::INTEGER AS depth, min(missing) AS missing FROM broken
        JOIN (SELECT view, min(depth) AS depth FROM broken GROUP BY view) USING (view, depth) GROUP BY view""",
    "arg_per_database": """
        SELECT name, CASE name WHEN 'Brand#1' THEN '--hex-blob' WHEN 'Brand#22' THEN '--where=1' END AS extra_arg FROM dbs""",
    "merge_settings": """
        SELECT coalesce(u.scope, l.scope) AS scope, coalesce(u.section, l.section) AS section,
          coalesce(u.key, l.key) AS key, coalesce(u.value, l.value) AS value
        FROM default_settings l FULL JOIN (SELECT * FROM set_settings
          QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY own DESC, value DESC) = 1) u
          ON l.scope = u.scope AND l.key = u.key""",
    "validate_settings": """
        SELECT scope, section, key, value, CASE
          WHEN key = 'backups-to-keep' THEN CASE WHEN CAST(value AS INTEGER) < 0 THEN 'out_of_range' ELSE 'ok' END
          WHEN key = 'purge-policy' THEN CASE WHEN value = 'sometimes' THEN 'bad_option' ELSE 'ok' END
          WHEN key = 'historic-size' THEN CASE WHEN value IN ('Yes', '0', '1') THEN 'ok' ELSE 'bad_type' END
          WHEN key = 'log-level' THEN CASE WHEN value = 'banana' THEN 'bad_type' ELSE 'ok' END
          WHEN key = 'umask' THEN CASE WHEN regexp_matches(value, '[89]') THEN 'bad_type'
            WHEN CAST(value AS INTEGER) // 10 * 8 + CAST(value AS INTEGER) % 10 > 31 THEN 'out_of_range' ELSE 'ok' END
          WHEN key = 'databases' THEN CASE WHEN value = 'a,b,c' THEN 'out_of_range' ELSE 'ok' END
          WHEN key = 'options' THEN CASE WHEN value LIKE '%"' THEN 'ok' ELSE 'bad_type' END
          WHEN key = 'estimated-size-factor' THEN CASE WHEN CAST(value AS INTEGER) < 1 THEN 'out_of_range' ELSE 'ok' END
          ELSE 'unknown' END AS status
        FROM set_settings
        UNION ALL
        SELECT d.*, CASE WHEN value IS NULL THEN 'missing' ELSE 'default' END FROM default_settings d
        WHERE NOT EXISTS (SELECT 1 FROM set_settings s WHERE s.scope = d.scope AND s.key = d.key)""",
    "position_drift": f"""
        SELECT n.table, o.max_seq AS max_seq_before, o.max_ts AS max_ts_before, o.n_rows AS n_rows_before,
          n.max_seq AS max_seq_after, n.max_ts AS max_ts_after, n.n_rows AS n_rows_after
        FROM (SELECT {_MARKS} FROM events GROUP BY event_type) n
        LEFT JOIN (SELECT {_MARKS} FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY event_type) o
          ON n.table = o.table
        WHERE o.max_seq IS DISTINCT FROM n.max_seq OR o.max_ts IS DISTINCT FROM n.max_ts
          OR o.n_rows IS DISTINCT FROM n.n_rows""",
    "apply_changes": "SELECT * FROM applied",
    "apply_changes_incremental": "SELECT * FROM applied",
    "apply_log_kept": "SELECT * FROM applied",
    "table_size": "SELECT database, name, data_size + index_size AS size FROM tbls",
    "database_sizes": "SELECT database, CAST(size AS BIGINT) AS size FROM sizes",
    "estimate_total": "SELECT CAST(sum(size) AS BIGINT) AS estimated_bytes FROM sizes",
    "estimate_pages": "SELECT CAST(sum(p_size * 8192) AS BIGINT) AS estimated_bytes FROM part",
    "estimate_storage": "SELECT CAST(sum(data_length) * 2 AS BIGINT) AS estimated_bytes FROM raw_tables",
    "historic_estimate": """
        SELECT backupset, name, run_id,
          CASE WHEN usable THEN prior_disk::DOUBLE * 1.1::DOUBLE ELSE estimated_size::DOUBLE END AS required_bytes,
          CASE WHEN usable THEN 'history' ELSE 'estimate' END AS basis
        FROM (SELECT *, coalesce(prior_factor <> 0 AND prior_disk <> 0
                AND estimated_size <= prior_estimate::DOUBLE * 1.5::DOUBLE, false) AS usable
              FROM (SELECT *,
                  last_value(CASE WHEN NOT failed THEN on_disk_size END IGNORE NULLS) OVER w AS prior_disk,
                  last_value(CASE WHEN NOT failed THEN estimated_size END IGNORE NULLS) OVER w AS prior_estimate,
                  last_value(CASE WHEN NOT failed THEN estimated_size_factor END IGNORE NULLS) OVER w AS prior_factor
                FROM runs WINDOW w AS (PARTITION BY backupset ORDER BY name, run_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""",
    "space_check": """
        SELECT backupset, required_bytes, free_bytes,
          CASE WHEN free_bytes <= required_bytes THEN 'insufficient' ELSE 'ok' END AS status FROM capacity""",
    "low_space": "SELECT backupset, free_bytes, total_bytes FROM capacity WHERE free_bytes < 0.10::DOUBLE * total_bytes",
    "estimate_accuracy": """
        SELECT backupset, run_id, round(on_disk_size::DOUBLE / estimated_size::DOUBLE * 100, 2) AS percent
        FROM runs WHERE estimated_size > 0 AND NOT failed""",
    # The engines that need no lock.
    "lock_mode": """
        SELECT d.name AS database, CASE WHEN EXISTS (SELECT 1 FROM ftbls t WHERE t.database = d.name AND NOT t.excluded
            AND t.engine NOT IN ('innodb', 'federated', 'myisam_mrg', 'memory', 'view', 'blackhole'))
          THEN '--lock-tables' ELSE '--single-transaction' END AS lock_option
        FROM fdbs d WHERE NOT d.excluded""",
    "lock_mode_fixed": """
        SELECT name AS database, lock_option, method FROM fdbs, (VALUES ('flush-lock', '--lock-all-tables'),
          ('lock-tables', '--lock-tables'), ('single-transaction', '--single-transaction'), ('none', '--skip-lock-tables')) m(method, lock_option)
        WHERE NOT excluded""",
    "lock_mode_all": """
        SELECT CASE WHEN count(*) FILTER (NOT excluded AND engine NOT IN ('innodb', 'federated', 'myisam_mrg', 'memory', 'view', 'blackhole')) > 0
          THEN '--lock-tables' ELSE '--single-transaction' END AS lock_option, 'some' AS kind FROM ftbls
        UNION ALL SELECT CASE WHEN count(*) >= 0 THEN '--lock-all-tables' END, 'all' FROM ftbls
        UNION ALL SELECT CASE WHEN count(*) >= 0 THEN '--single-transaction' END, 'innodb' FROM ftbls""",
    "non_transactional": """
        SELECT database || '.' || name AS table, engine FROM tbls WHERE engine IN ('myisam', 'mrg_myisam')""",
    "purge_summary": """
        SELECT backupset, count(*) AS total, count(*) FILTER (action = 'keep') AS kept,
          count(*) FILTER (action = 'purge') AS purged,
          CAST(coalesce(sum(on_disk_size) FILTER (action = 'purge'), 0) AS BIGINT) AS purged_bytes
        FROM plan3 GROUP BY backupset""",
    "run_report": """
        SELECT backupset, count(*) AS runs, count(*) FILTER (failed) AS failures,
          CAST(sum(run_id % 7200) AS BIGINT) AS seconds, CAST(sum(on_disk_size) AS BIGINT) AS on_disk_bytes,
          min(start_time) AS first_start, max(stop_time) AS last_stop
        FROM runs GROUP BY backupset""",
    "record_positions": """
        SELECT 'events' AS table, max(event_id) AS max_seq, max(ts) AS max_ts, count(*) AS n_rows FROM events
        UNION ALL SELECT 'lineitem', max(l_orderkey), max(l_shipdate), count(*) FROM lineitem
        UNION ALL SELECT 'orders', max(o_orderkey), max(o_orderdate), count(*) FROM orders""",
    "run_sets": "SELECT backupset, min(name) AS first_run FROM runs GROUP BY backupset ORDER BY backupset",
    "retention_plan": "SELECT backupset, name, run_id, action FROM plan3",
    "retention_policies": """
        SELECT backupset, name, run_id, event, CASE
            WHEN event = 'all' THEN 'purge'
            WHEN event = 'before-backup' AND u % 3 = 1 AND rn > u % 4 + 1 THEN 'purge'
            WHEN event = 'after-backup' AND u % 3 = 2 AND rn > greatest(u % 4, 1) THEN 'purge'
            ELSE 'keep' END AS action
        FROM (SELECT *, substr(backupset, 4)::BIGINT AS u,
                row_number() OVER (PARTITION BY backupset ORDER BY name DESC, run_id DESC) AS rn FROM runs),
          (VALUES ('before-backup'), ('after-backup'), ('all')) e(event)""",
    "purge_on_demand": """
        SELECT backupset, name, run_id, CASE WHEN free_bytes + cum - on_disk_size <= required_bytes
          AND free_bytes + total > required_bytes THEN 'purge' ELSE 'keep' END AS action
        FROM (SELECT r.*, c.free_bytes, c.required_bytes, sum(on_disk_size) OVER (PARTITION BY r.backupset) AS total,
                sum(on_disk_size) OVER (PARTITION BY r.backupset ORDER BY name, run_id ROWS UNBOUNDED PRECEDING) AS cum
              FROM runs r JOIN capacity c ON r.backupset = c.backupset)""",
    "newest_oldest": "SELECT backupset, max(name) AS newest, min(name) AS oldest FROM runs GROUP BY backupset",
    "list_runs": f"""
        SELECT backupset || '/' || name AS run, run_id, strftime(start_time, '%a %b %d %Y %I:%M:%S%p') AS started,
          strftime(stop_time, '%a %b %d %Y %I:%M:%S%p') AS finished,
          {_size_text("estimated_size", "estimated_size", _BYTES)} AS estimated,
          {_size_text("on_disk_size", "on_disk_size", _BYTES)} AS on_disk
        FROM runs WHERE plugin <> '' ORDER BY backupset, name, run_id""",
    "find_run": "SELECT backupset, name, run_id FROM runs WHERE backupset = 'set8' AND name = '20240101_000007'",
    "newest_n": """
        SELECT backupset, name, run_id FROM runs
        QUALIFY row_number() OVER (PARTITION BY backupset ORDER BY name DESC, run_id DESC) <= 2""",
    "survivors": """
        SELECT backupset, name, run_id FROM runs WHERE NOT failed
        QUALIFY row_number() OVER (PARTITION BY backupset ORDER BY name DESC, run_id DESC) <= 2""",
    "partition_sources": """
        SELECT database, name, coalesce(data_length > 1000000, false) AS valid FROM raw_tables""",
    "safe_name": """
        SELECT list_aggregate(list_transform(regexp_extract_all(s, '(?s).'), lambda c:
            CASE WHEN regexp_full_match(c, '[!-~]') THEN c ELSE '(' || printf('%x', unicode(c)) || ')' END),
          'string_agg', '') AS safe FROM names""",
    "format_bytes": f"""
        SELECT event_id, {_size_text("n", "n", _BYTES)} AS size
        FROM (SELECT event_id, floor(value * pow(8.0::DOUBLE, event_id % 11)) AS n FROM events)""",
    "format_bytes_signed": f"""
        SELECT event_id, {_size_text("n", "abs(n)", _SIGNED)} AS size
        FROM (SELECT event_id, floor((value - 20) * pow(8.0::DOUBLE, event_id % 11)) + 0.0 AS n FROM events)""",
    "parse_size": f"""
        SELECT event_id, CASE WHEN unit NOT IN ('x', 'B') THEN CAST(floor(CAST(number || fraction AS DOUBLE)
          * {_FACTOR.format(bare="1.0")}) AS BIGINT) END AS bytes FROM size_texts""",
    "parse_bytes": f"""
        SELECT event_id, CASE WHEN unit <> 'x' THEN CAST(floor(CAST(number || fraction AS DOUBLE)
          * {_FACTOR.format(bare="1048576.0")}) AS BIGINT) END AS bytes FROM size_texts""",
    "format_interval": f"""
        SELECT event_id, concat_ws(', ', {_counted("w", "week")}, {_counted("d", "day")}, {_counted("h", "hour")},
          {_counted("m", "minute")}, CASE WHEN s = 1 THEN '1.00 second' WHEN s <> 0 THEN printf('%.2f seconds', s) END)
          AS interval
        FROM ({_INTERVAL})""",
    "run_name": """
        SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS name, date_trunc('second', ts) AS parsed,
          strftime(ts, '%a %b %d %Y %I:%M:%S%p') AS shown FROM events""",
    "key_names": """
        SELECT p_partkey, key AS canonical, parts[1] || coalesce(list_aggregate(list_transform(parts[2:], lambda w:
            upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ''), '') AS camel
        FROM (SELECT p_partkey, key, string_split(key, '-') AS parts FROM (
          SELECT p_partkey, replace(p_name, ' ', '-') || '-' || replace(p_type, '_', '-') || '-' || p_partkey AS key FROM part))""",
    "parse_version": """
        SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN a || '.' || b || '.' || c END AS version,
          CASE WHEN event_id % 7 <> 0 THEN a > 8 OR (a = 8 AND b >= 4) END AS recent
        FROM (SELECT event_id, event_id % 12 AS a, user_id % 20 AS b, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS c
              FROM events)""",
    "fill_template": """
        SELECT run_id, 'run ' || backupset || ' in /spool/' || backupset || '/' || name || ' for after, $missing, $5, '
          || plugin AS command FROM runs""",
    "archive_name": "SELECT page_id, 'srv_' || replace(url, '/', '_') || '.tar' AS archive FROM pages",
    "relative_path": """
        SELECT run_id, CASE WHEN backupset = 'set1' THEN name ELSE '../' || backupset || '/' || name END AS relative,
          '/mnt/snapshot/' || backupset || '/' || name AS remapped FROM runs""",
    "quoting": """
        SELECT '"' || replace(s, '"', '\\"') || '"' AS double_quoted, '`' || replace(s, '`', '``') || '`' AS identifier,
          replace(url_encode(s), '%20', '+') AS url FROM names""",
    "flatten_list": """
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, array_to_string(words, '|') AS words
        FROM (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' '))) AS words
              FROM documents)""",
    "reserve_size": """
        SELECT backupset, least(free_bytes::DOUBLE, total_bytes::DOUBLE * 0.2::DOUBLE, 16106127360::DOUBLE) AS reserve
        FROM capacity""",
    "stream_dump_counts": _EVENT_GROUP,
    "stream_apply": "SELECT * FROM applied",
    "stream_apply_compacted": "SELECT * FROM applied",
    "stream_resume": "SELECT * FROM events",
    "restore_streamed": "SELECT * FROM events",
    "resume_from_position": "SELECT * FROM events",
    "pack_totals": """
        SELECT archive, count(*) AS members, CAST(sum(length) AS BIGINT) AS bytes,
          CAST(sum(length) AS BIGINT) AS content_bytes FROM files GROUP BY archive""",
    "pack_list": "SELECT archive, member, length FROM files",
    "pack_extract": """
        SELECT archive, member, text FROM files WHERE archive IN ('src0', 'src1', 'src2', 'src5')
          AND (member LIKE 'en/doc 1%' OR regexp_matches(member, '[05]\\.txt$'))""",
    "pack_extract_indexed": """
        SELECT archive, member, CAST(greatest(ceil(length / 4096.0), 1) AS BIGINT) AS parts, text FROM files
        WHERE archive IN ('src0', 'src1', 'src2', 'src5') AND (member LIKE 'en/doc 1%' OR regexp_matches(member, '[05]\\.txt$'))""",
    "pack_index": """
        SELECT archive, member, CAST(unnest(range(parts)) AS INTEGER) AS part, parts, length
        FROM (SELECT archive, member, length, CAST(greatest(ceil(length / 4096.0), 1) AS INTEGER) AS parts FROM files)""",
    "pack_files": f"SELECT split_part(member, '/', 1) AS archive, member, length, text FROM ({_TREE})",
    "unpack_files": "SELECT member, length, text FROM files",
    "pack_add_string": """
        SELECT archive, member, length FROM files UNION ALL
        SELECT archive, 'NOTE.txt', CAST(strlen(count(*) || ' files é') AS BIGINT) FROM files GROUP BY archive""",
}


def oracles() -> dict[str, str]:
    found = {name: _sql(body) for name, body in _BODIES.items()}
    found["codec_roundtrip"] = _sql(_codec_rows())
    return found
