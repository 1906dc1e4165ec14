"""DuckDB oracle SQL for the registered queries (tables are pre-registered views).

Each statement is written from the operator's definition, independently of the Spark plan:
window functions where Spark uses the distributed ordered index, plain joins and aggregates
elsewhere. Types are cast to match the Spark result (row_number is BIGINT, sum of BIGINT is
HUGEINT in DuckDB). References and faults of documents are stated from what the documents were made of.
"""

from __future__ import annotations

from lithos.plans import roles as R
from lithos.plans.queries import COPY_SCHEMAS, LOOKUP_CUSTOMER, SNAPSHOT_NAME, SNAPSHOT_TIME, SOURCE_WS, TARGET_WS
from lithos.plans.schemas import BASE_REQUIRED, TYPE_FIELDS

LI = ", ".join(R.LINEITEM_ORDER)
HOLE = "CAST(l_orderkey AS VARCHAR)"


def _iso(c: str) -> str:
    return (f"(strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({c}, '%f') = '000000' THEN '' "
            f"ELSE '.' || strftime({c}, '%f') END)")


def _valid(*cs: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in cs)


def _box(x="x", y="y", z="z") -> str:
    return ", ".join(f"min({c}) AS min_{a}, max({c}) AS max_{a}" for a, c in zip("xyz", (x, y, z)))


EV_XYZ = "SELECT event_id, CAST(user_id AS DOUBLE) AS x, value AS y, CAST(event_id AS DOUBLE) AS z, event_type FROM events"
DOC_XYZ = ("SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS x, CAST(l.quality AS DOUBLE) AS y, "
           "CAST(l.toxic AS DOUBLE) AS z FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
FINITE = "(isfinite(min(x)) AND isfinite(max(x)) AND isfinite(min(y)) AND isfinite(max(y)) AND isfinite(min(z)) AND isfinite(max(z)))"

SCHEMA_CASE = "CASE o.o_orderpriority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in R.SCHEMA_BY_PRIORITY.items()) + " ELSE 'pointset' END"

OBJ = f"""obj AS (
  SELECT coalesce(lower(c.c_mktsegment), 'unassigned') AS workspace_id, 'obj-' || CAST(o.o_custkey AS VARCHAR) AS id,
         'object-' || CAST(o.o_custkey AS VARCHAR) AS name,
         '/' || coalesce(lower(c.c_mktsegment), 'unassigned') || '/object-' || CAST(o.o_custkey AS VARCHAR) || '.json' AS path,
         {SCHEMA_CASE} AS schema_id, CAST(o.o_orderkey AS VARCHAR) AS version_id, o.o_orderdate AS created_at,
         'user-' || CAST(c.c_nationkey AS VARCHAR) AS created_by, o.o_orderstatus = 'F' AS deleted,
         o.o_orderstatus, o.o_orderkey
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, id ORDER BY created_at DESC, version_id DESC) AS rn
                 FROM obj) t WHERE rn = 1),
alive AS (SELECT * FROM cur WHERE NOT deleted),
refs AS (
  SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
         l_extendedprice, l_tax, l_returnflag, l_linestatus, l_shipdate, l_discount) - 1 AS INTEGER) AS ordinal,
         'blob-' || CAST(l_partkey AS VARCHAR) AS blob_id
  FROM lineitem),
blobs AS (
  SELECT DISTINCT o.workspace_id, 'blob-' || CAST(li.l_partkey AS VARCHAR) AS blob_id, CAST(c.c_nationkey AS BIGINT) AS length
  FROM lineitem li JOIN obj o ON o.o_orderkey = li.l_orderkey
  JOIN customer c ON c.c_custkey = li.l_partkey AND lower(c.c_mktsegment) <> o.workspace_id)"""

LOOKUP_WS = f"(SELECT lower(c_mktsegment) FROM customer WHERE c_custkey = {LOOKUP_CUSTOMER})"
LOOKUP_ID = f"'obj-{LOOKUP_CUSTOMER}'"

HOLE_LOOKUP = ("hl AS (SELECT CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS key, v "
               "FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS v FROM orders) t)")


def _index_map(data_sql: str, name: str = "im") -> str:
    """hole index CTE over rows (v = hole id text) of ``data_sql``: key, offset, count per lookup hole."""
    return (f"{name}_c AS (SELECT v, count(*) AS n FROM ({data_sql}) t GROUP BY v), "
            f"{name}_o AS (SELECT v, n, sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM {name}_c), "
            f"{name} AS (SELECT hl.key AS hole_index, CAST(coalesce(o.off, 0) AS BIGINT) AS \"offset\", "
            f"CAST(coalesce(o.n, 0) AS BIGINT) AS \"count\" FROM hl LEFT JOIN {name}_o o ON hl.v = o.v)")


def _dup_ctes(schemas: tuple[str, ...]) -> str:
    filt = f"AND schema_id IN ({', '.join(repr(s) for s in schemas)})" if schemas else ""
    return f"""{OBJ},
src AS (SELECT * FROM alive WHERE workspace_id = '{SOURCE_WS}' {filt}),
src_refs AS (SELECT s.id, r.blob_id FROM src s JOIN refs r ON r.l_orderkey = s.o_orderkey),
failed AS (SELECT DISTINCT sr.id FROM src_refs sr
           WHERE sr.blob_id NOT IN (SELECT blob_id FROM blobs WHERE workspace_id = '{SOURCE_WS}')),
ok AS (SELECT * FROM src WHERE id NOT IN (SELECT id FROM failed)),
ok_refs AS (SELECT DISTINCT r.blob_id FROM ok s JOIN refs r ON r.l_orderkey = s.o_orderkey)"""


def _conformance_values() -> str:
    rows = []
    for t, (req, _opt) in TYPE_FIELDS.items():
        rows += [f"('{t}', '{p}')" for p in BASE_REQUIRED + req]
    return ", ".join(rows)


def _profile(source: str, table_sql: str, cols: list[tuple[str, str, bool]]) -> list[str]:
    out = []
    for c, dtype, numeric in cols:
        lo = f"CAST(min({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
        hi = f"CAST(max({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
        out.append(f"SELECT '{source}' AS source, '{c}' AS \"column\", '{dtype}' AS dtype, count({c}) AS non_null_count, "
                   f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, {lo} AS min, {hi} AS max "
                   f"FROM ({table_sql}) t")
    return out


EV_FIRST = ("ev_lk AS (SELECT CAST(row_number() OVER (ORDER BY f, v) AS INTEGER) AS key, v "
            "FROM (SELECT coalesce(event_type, '') AS v, min(event_id) AS f FROM events GROUP BY 1) t)")

def _rows(name: str, sql: str, pos: str = "pos", a: str = "NULL", b: str = "NULL", c: str = "NULL", text: str = "NULL") -> str:
    """Rows of one array in the long form (array, pos, a, b, c, text)."""
    values = ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for v, n in ((a, "a"), (b, "b"), (c, "c")))
    return f"SELECT '{name}' AS \"array\", CAST({pos} AS BIGINT) AS pos, {values}, CAST({text} AS VARCHAR) AS text FROM ({sql}) q"


def _coded(name: str, order: str, column: str, source: str) -> str:
    """CTEs: {name} has pos and v (rows of ``source`` along ``order``), {name}_lk the first-appearance lookup."""
    return (f"{name} AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS pos, coalesce(CAST({column} AS VARCHAR), '') AS v, * FROM {source}), "
            f"{name}_lk AS (SELECT row_number() OVER (ORDER BY f, v) AS key, v FROM (SELECT v, min(pos) AS f FROM {name} GROUP BY v) t)")


def _lookup_rows(name: str, cte: str) -> str:
    return _rows(name, f"SELECT * FROM {cte}_lk", "key", text="v")


def _code_rows(name: str, cte: str) -> str:
    return _rows(name, f"SELECT r.pos, k.key FROM {cte} r JOIN {cte}_lk k ON r.v = k.v", a="key")


SORTED_HOLES = f"{HOLE}, l_quantity, {LI}"
LI_CSV = ", ".join(c for c in R.LINEITEM_ORDER if c != "l_shipdate")
BLANK = "CASE WHEN l_linenumber < 7 THEN CAST(l_orderkey AS VARCHAR) ELSE '' END"

def _many(name: str, sql: str, pos: str = "pos", a: str = "NULL", b: str = "NULL", c: str = "NULL", text: str = "NULL") -> str:
    """As ``_rows``, of many objects (column obj)."""
    return _rows(name, sql, pos, a, b, c, text).replace("SELECT ", "SELECT obj AS object, ", 1)


def _coded_many(name: str, order: str, column: str, source: str) -> str:
    """As ``_coded``, for every object of ``source`` (column obj)."""
    return (f"{name} AS (SELECT row_number() OVER (PARTITION BY obj ORDER BY {order}) - 1 AS pos, coalesce(CAST({column} AS VARCHAR), '') AS v, "
            f"* FROM {source}), {name}_lk AS (SELECT obj, row_number() OVER (PARTITION BY obj ORDER BY f, v) AS key, v "
            f"FROM (SELECT obj, v, min(pos) AS f FROM {name} GROUP BY obj, v) t)")


def _many_lookup(name: str, cte: str) -> str:
    return _many(name, f"SELECT * FROM {cte}_lk", "key", text="v")


def _many_codes(name: str, cte: str) -> str:
    return _many(name, f"SELECT r.obj, r.pos, k.key FROM {cte} r JOIN {cte}_lk k ON r.obj = k.obj AND r.v = k.v", a="key")


SEGMENT_POINTS = """seg AS (SELECT coalesce(lower(c_mktsegment) || '-' || CAST(c_nationkey AS VARCHAR), '') AS obj, o_orderkey,
    o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS DOUBLE) END AS z, o_orderpriority
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
# objects whose points all lack a coordinate fail
SEGMENT_BUILT = f"{SEGMENT_POINTS}, built AS (SELECT * FROM seg WHERE obj IN (SELECT obj FROM seg WHERE {_valid('x', 'y', 'z')}))"

CUSTOMER_HOLES = f"""own AS (SELECT CAST(o_custkey AS VARCHAR) AS obj, CAST(o_orderkey AS VARCHAR) AS hole, CAST(o_custkey AS DOUBLE) AS x,
    o_totalprice AS y FROM orders),
  col AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY hole) - 1 AS pos, row_number() OVER (PARTITION BY obj ORDER BY hole) AS key FROM own),
  li AS (SELECT CAST(o_custkey AS VARCHAR) AS obj, {HOLE} AS hole, lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  cnt AS (SELECT obj, hole, count(*) AS n, max(l_quantity) AS d FROM li GROUP BY ALL),
  idx AS (SELECT obj, hole, n, d, sum(n) OVER (PARTITION BY obj ORDER BY hole) - n AS off FROM cnt),
  hix AS (SELECT col.obj, col.key AS hole_index, coalesce(idx.off, 0) AS off, coalesce(idx.n, 0) AS n, coalesce(idx.d, 0.0) AS d, col.pos
          FROM col LEFT JOIN idx ON col.obj = idx.obj AND col.hole = idx.hole)"""

BRAND_LINES = """vert AS (SELECT p_brand AS obj, * FROM part),
  line AS (SELECT p_brand AS obj, l_linenumber - 1 AS s, l_linenumber AS e, lineitem.* FROM lineitem JOIN part ON l_partkey = p_partkey),
  vn AS (SELECT obj, count(*) AS n FROM vert GROUP BY obj),
  chk AS (SELECT vn.obj, any_value(vn.n) AS vertices, count(line.obj) AS segments, CAST(max(s) AS DOUBLE) AS max_start,
            CAST(max(e) AS DOUBLE) AS max_end, count(*) FILTER (WHERE s < 0 OR s >= vn.n) AS bad_start,
            count(*) FILTER (WHERE e < 0 OR e >= vn.n) AS bad_end FROM vn LEFT JOIN line ON line.obj = vn.obj GROUP BY vn.obj),
  good AS (SELECT obj FROM chk WHERE bad_start + bad_end = 0),
  gvert AS (SELECT * FROM vert WHERE obj IN (SELECT obj FROM good)), gline AS (SELECT * FROM line WHERE obj IN (SELECT obj FROM good))"""

SUPPLIER = "sup AS (SELECT CAST(l_suppkey AS VARCHAR) AS obj, * FROM lineitem)"


SQL: dict[str, str] = {
    "pointsets_by_segment": f"""WITH {SEGMENT_BUILT}, {_coded_many('p', 'o_orderkey', 'o_orderpriority', 'built')}
        """ + " UNION ALL ".join([
        _many("coordinates", "SELECT * FROM p", a="x", b="y", c="z"), _many_lookup("lookup:o_orderpriority", "p"),
        _many_codes("codes:o_orderpriority", "p"), _many("values:o_orderkey", "SELECT * FROM p", a="o_orderkey")]),
    "downhole_by_group": f"""WITH {CUSTOMER_HOLES}, {_coded_many('p', f'hole, l_quantity, {LI}', 'l_returnflag', 'li')}
        """ + " UNION ALL ".join([
        _many("coordinates", "SELECT * FROM col", a="x", b="y", c="0.0"), _many("distances", "SELECT * FROM hix", a="d", b="d", c="d"),
        _many("lookup", "SELECT * FROM col", "key", text="hole"), _many("codes", "SELECT * FROM col", a="key"),
        _many("holes", "SELECT * FROM hix", "hole_index", a="off", b="n"),
        _many("path", "SELECT * FROM p", a="l_quantity", b="l_extendedprice", c="-l_discount"),
        _many("from_to:assay", "SELECT * FROM p", a="l_quantity", b="l_quantity + l_linenumber"),
        _many("holes:assay", "SELECT * FROM hix", "hole_index", a="off", b="n"), _many_lookup("lookup:assay.l_returnflag", "p"),
        _many_codes("codes:assay.l_returnflag", "p"), _many("values:assay.l_tax", "SELECT * FROM p", a="l_tax")]),
    "line_segments_by_group": f"""WITH {BRAND_LINES}, {_coded_many('v', 'p_partkey', 'p_type', 'gvert')}, {_coded_many('s', LI, 'l_returnflag', 'gline')}
        """ + " UNION ALL ".join([
        _many("coordinates", "SELECT * FROM v", a="p_retailprice", b="p_size", c="0.0"), _many("indices", "SELECT * FROM s", a="s", b="e"),
        _many_lookup("lookup:vertices.p_type", "v"), _many_codes("codes:vertices.p_type", "v"),
        _many_lookup("lookup:segments.l_returnflag", "s"), _many_codes("codes:segments.l_returnflag", "s")]),
    "intervals_by_group": f"""WITH {SUPPLIER}, {_coded_many('h', LI, 'l_orderkey', 'sup')}, {_coded_many('r', LI, 'l_returnflag', 'sup')}
        """ + " UNION ALL ".join([
        _many("start", "SELECT * FROM h", a="l_quantity", b="l_extendedprice", c="-l_quantity"),
        _many("end", "SELECT * FROM h", a="l_quantity + l_linenumber", b="l_extendedprice", c="-(l_quantity + l_linenumber)"),
        _many("mid_points", "SELECT * FROM h", a="l_quantity", b="l_extendedprice", c="-l_quantity"),
        _many("from_to", "SELECT * FROM h", a="l_quantity", b="l_quantity + l_linenumber"), _many_lookup("lookup", "h"), _many_codes("codes", "h"),
        _many_lookup("lookup:intervals.l_returnflag", "r"), _many_codes("codes:intervals.l_returnflag", "r")]),
    "segment_gate_by_group": f"""WITH {BRAND_LINES},
        box AS (SELECT obj, {_box('p_retailprice', 'CAST(p_size AS DOUBLE)', '0.0::DOUBLE')} FROM vert GROUP BY obj)
        SELECT chk.obj AS object, CASE WHEN bad_start + bad_end > 0 THEN 'validation_failed' ELSE 'validation_passed' END AS status, vertices,
          segments, max_start, max_end, bad_start, bad_end, min_x, max_x, min_y, max_y, min_z, max_z,
          CAST(CASE WHEN bad_start + bad_end > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_errors FROM chk JOIN box ON chk.obj = box.obj""",
    "documents_by_segment": f"""WITH {SEGMENT_BUILT}
        SELECT obj AS object, obj AS name, '/objects/pointset/1.3.0/pointset.schema.json' AS schema, min(z) FILTER (WHERE {_valid('x', 'y', 'z')}) AS min_z,
          max(z) FILTER (WHERE {_valid('x', 'y', 'z')}) AS max_z, count(*) AS points, count(DISTINCT coalesce(o_orderpriority, '')) AS categories,
          count(*) AS codes, 'continuous' AS second_type, count(*) AS "values" FROM built GROUP BY obj""",
    "array_slice": f"""WITH {_coded('e', 'event_id', 'event_type', f'({EV_XYZ}) t')}, s AS (SELECT * FROM e WHERE pos >= 200 AND pos < 700)
        SELECT 'coordinates' AS "array", pos, x AS a, y AS b, z AS c FROM s
        UNION ALL SELECT 'codes:event_type', pos, CAST(k.key AS DOUBLE), NULL, NULL FROM s JOIN e_lk k ON s.v = k.v
        UNION ALL SELECT 'values:value', pos, y, NULL, NULL FROM s""",
    "pointset": f"""WITH p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, x, y, z, event_id,
                                coalesce(event_type, '') AS v FROM ({EV_XYZ}) t), {EV_FIRST}
        SELECT p.pos, p.x, p.y, p.z, ev_lk.key AS event_type FROM p LEFT JOIN ev_lk ON p.v = ev_lk.v""",
    "bounding_box": f"""SELECT 'events' AS source, {_box()}, count(*) AS valid_rows, {FINITE} AS finite
        FROM ({EV_XYZ}) t WHERE {_valid('x', 'y', 'z')}
        UNION ALL
        SELECT 'documents' AS source, {_box()}, count(*) AS valid_rows, {FINITE} AS finite
        FROM ({DOC_XYZ}) t WHERE {_valid('x', 'y', 'z')}""",
    "bounding_box_by_group": f"""SELECT l_orderkey, {_box('l_quantity', 'l_extendedprice', 'l_tax')}, count(*) AS valid_rows
        FROM lineitem GROUP BY l_orderkey""",
    "valid_points": f"SELECT doc_id, x, y, z FROM ({DOC_XYZ}) t WHERE {_valid('x', 'y', 'z')}",
    "missing_coords": f"""SELECT count(*) AS "rows", count(*) FILTER (WHERE NOT ({_valid('x', 'y', 'z')})) AS missing_rows,
        count(*) FILTER (WHERE {_valid('x', 'y', 'z')}) AS valid_rows,
        CASE WHEN count(*) FILTER (WHERE {_valid('x', 'y', 'z')}) = 0 THEN 'validation_failed'
             WHEN NOT (isfinite(min(x) FILTER (WHERE {_valid('x', 'y', 'z')})) AND isfinite(max(x) FILTER (WHERE {_valid('x', 'y', 'z')}))
                  AND isfinite(min(y) FILTER (WHERE {_valid('x', 'y', 'z')})) AND isfinite(max(y) FILTER (WHERE {_valid('x', 'y', 'z')}))
                  AND isfinite(min(z) FILTER (WHERE {_valid('x', 'y', 'z')})) AND isfinite(max(z) FILTER (WHERE {_valid('x', 'y', 'z')})))
             THEN 'validation_failed' ELSE 'validation_passed' END AS status
        FROM ({DOC_XYZ}) t""",
    "dry_run_report": f"""WITH v AS (SELECT *, {_valid('x', 'y', 'z')} AS ok FROM ({DOC_XYZ}) t),
        a AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT ok) AS miss, count(*) FILTER (WHERE ok) AS valid,
                     min(x) FILTER (WHERE ok) AS min_x, max(x) FILTER (WHERE ok) AS max_x,
                     min(y) FILTER (WHERE ok) AS min_y, max(y) FILTER (WHERE ok) AS max_y,
                     min(z) FILTER (WHERE ok) AS min_z, max(z) FILTER (WHERE ok) AS max_z FROM v)
        SELECT CASE WHEN valid = 0 OR NOT (isfinite(min_x) AND isfinite(max_x) AND isfinite(min_y) AND isfinite(max_y)
                    AND isfinite(min_z) AND isfinite(max_z)) THEN 'validation_failed' ELSE 'validation_passed' END AS status,
               n AS "rows", valid AS valid_rows, miss AS missing_rows, min_x, max_x, min_y, max_y, min_z, max_z,
               CAST(CASE WHEN valid = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_errors,
               CAST(CASE WHEN miss > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_warnings,
               CASE WHEN miss > 0 THEN CAST(miss AS VARCHAR) || ' rows lack a coordinate' END AS first_warning
        FROM a""",
    "line_segments": f"""WITH v AS (SELECT p_retailprice AS x, CAST(p_size AS DOUBLE) AS y, 0.0::DOUBLE AS z FROM part),
        n AS (SELECT count(*) AS n FROM part),
        s AS (SELECT count(*) AS segments, CAST(max(l_partkey) AS DOUBLE) AS max_start, CAST(max(l_suppkey) AS DOUBLE) AS max_end,
                     count(*) FILTER (WHERE l_partkey < 0 OR l_partkey >= (SELECT n FROM n)) AS bad_start,
                     count(*) FILTER (WHERE l_suppkey < 0 OR l_suppkey >= (SELECT n FROM n)) AS bad_end FROM lineitem),
        b AS (SELECT {_box()} FROM v WHERE {_valid('x', 'y', 'z')})
        SELECT CASE WHEN bad_start + bad_end > 0 THEN 'validation_failed' ELSE 'validation_passed' END AS status,
               (SELECT n FROM n) AS vertices, segments, max_start, max_end, bad_start, bad_end, min_x, max_x, min_y, max_y, min_z, max_z
        FROM s, b""",
    "segment_index_check": f"""WITH n AS (SELECT count(*) AS n FROM supplier)
        SELECT (SELECT n FROM n) AS vertices, count(*) AS segments, CAST(max(l_partkey) AS DOUBLE) AS max_start,
               CAST(max(l_suppkey) AS DOUBLE) AS max_end,
               count(*) FILTER (WHERE l_partkey < 0 OR l_partkey >= (SELECT n FROM n)) AS bad_start,
               count(*) FILTER (WHERE l_suppkey < 0 OR l_suppkey >= (SELECT n FROM n)) AS bad_end,
               CASE WHEN count(*) FILTER (WHERE l_partkey < 0 OR l_partkey >= (SELECT n FROM n) OR l_suppkey < 0
                    OR l_suppkey >= (SELECT n FROM n)) > 0 THEN 'validation_failed' ELSE 'validation_passed' END AS status
        FROM lineitem""",
    "dangling_segment_ends": f"""WITH n AS (SELECT count(*) AS n FROM supplier)
        SELECT 'start' AS "end", CAST(l_partkey AS DOUBLE) AS idx FROM lineitem WHERE l_partkey < 0 OR l_partkey >= (SELECT n FROM n)
        UNION ALL
        SELECT 'end' AS "end", CAST(l_suppkey AS DOUBLE) AS idx FROM lineitem WHERE l_suppkey < 0 OR l_suppkey >= (SELECT n FROM n)""",
    "segment_indices": f"SELECT row_number() OVER (ORDER BY {LI}) - 1 AS pos, l_partkey AS data1, l_suppkey AS data2 FROM lineitem",
    "coords_xyz": f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, x, y, z FROM ({EV_XYZ}) t",
    "clean_strings": """SELECT d.doc_id, coalesce(d.lang, '') AS lang, coalesce(d.source, '') AS source,
        coalesce(CAST(l.quality AS VARCHAR), '') AS quality, coalesce(CAST(l.toxic AS VARCHAR), '') AS toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "numeric_coerce": """SELECT o_orderkey, TRY_CAST(trim(o_orderpriority) AS DOUBLE) AS priority_num,
        TRY_CAST(trim(CAST(o_totalprice AS VARCHAR)) AS DOUBLE) AS totalprice,
        TRY_CAST(trim(o_orderstatus) AS DOUBLE) AS status_num FROM orders""",
    "invert_dip": f"""SELECT {HOLE} AS hole_id, l_linenumber, l_partkey, l_quantity AS distance, l_extendedprice AS azimuth,
        -l_discount AS dip FROM lineitem""",
    "survey_path": f"""SELECT row_number() OVER (ORDER BY {HOLE}, l_quantity, {LI}) - 1 AS pos, l_quantity AS distance,
        l_extendedprice AS azimuth, l_discount AS dip FROM lineitem""",
    "attribute_key": "SELECT p_partkey, p_type AS name, regexp_replace(lower(p_type), '[ -]', '_', 'g') AS key FROM part",
    "attribute_dispatch": """
        SELECT 'event_id' AS "column", 'event_id' AS key, 'continuous' AS kind, count(event_id) AS n_values,
               CAST(NULL AS BIGINT) AS n_categories, CAST(NULL AS VARCHAR) AS warning FROM events
        UNION ALL SELECT 'ts', 'ts', 'category', count(ts), count(DISTINCT coalesce(CAST(ts AS VARCHAR), '')),
               'column ts of type timestamp_ntz is stored as text categories' FROM events
        UNION ALL SELECT 'user_id', 'user_id', 'continuous', count(user_id), NULL, NULL FROM events
        UNION ALL SELECT 'event_type', 'event_type', 'category', count(event_type), count(DISTINCT coalesce(event_type, '')), NULL FROM events
        UNION ALL SELECT 'value', 'value', 'continuous', count(value), NULL, NULL FROM events
        UNION ALL SELECT 'props', 'props', 'category', count(props), count(DISTINCT coalesce(props, '')), NULL FROM events""",
    "continuous_attribute": """SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, CAST(value AS DOUBLE) AS value,
        CAST(user_id AS DOUBLE) AS user_id FROM events""",
    "category_lookup": f"WITH {EV_FIRST} SELECT key, v AS value FROM ev_lk",
    "category_codes": f"""WITH {EV_FIRST} SELECT e.event_id, ev_lk.key AS event_type FROM events e
        LEFT JOIN ev_lk ON coalesce(e.event_type, '') = ev_lk.v""",
    "category_lookups": f"""WITH p AS (SELECT row_number() OVER (ORDER BY {LI}) - 1 AS pos, l_returnflag, l_linestatus FROM lineitem),
        f AS (SELECT 'l_returnflag' AS attribute, coalesce(l_returnflag, '') AS value, min(pos) AS first FROM p GROUP BY 1, 2
              UNION ALL
              SELECT 'l_linestatus', coalesce(l_linestatus, ''), min(pos) FROM p GROUP BY 1, 2)
        SELECT attribute, CAST(row_number() OVER (PARTITION BY attribute ORDER BY first, value) AS INTEGER) AS key, value FROM f""",
    "hole_lookup": f"WITH {HOLE_LOOKUP} SELECT key, v AS value FROM hl",
    "collar_keys": f"WITH {HOLE_LOOKUP} SELECT CAST(o_orderkey AS VARCHAR) AS hole_id, hl.key FROM orders JOIN hl ON CAST(o_orderkey AS VARCHAR) = hl.v",
    "hole_index_map": f"WITH {HOLE_LOOKUP}, {_index_map(f'SELECT {HOLE} AS v FROM lineitem')} SELECT * FROM im",
    "run_length_index": f"""WITH p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, coalesce(event_type, '') AS v FROM events),
        s AS (SELECT pos, v, lag(v) OVER (ORDER BY pos) AS pv FROM p),
        st AS (SELECT pos, v FROM s WHERE pv IS NULL OR pv <> v),
        r AS (SELECT pos, v, lead(pos) OVER (ORDER BY pos) AS np FROM st), {EV_FIRST}
        SELECT ev_lk.key AS hole_index, CAST(r.pos AS BIGINT) AS "offset",
               CAST(coalesce(r.np, (SELECT count(*) FROM p)) - r.pos AS BIGINT) AS "count"
        FROM r JOIN ev_lk ON r.v = ev_lk.v""",
    "row_position": "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events",
    "sample_rows": "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 10",
    "max_depth": f"SELECT {HOLE} AS hole_id, CAST(max(l_quantity) AS DOUBLE) AS max_depth FROM lineitem GROUP BY 1",
    "hole_distances": f"""WITH m AS (SELECT {HOLE} AS hole_id, max(l_quantity) AS d FROM lineitem GROUP BY 1)
        SELECT CAST(o_orderkey AS VARCHAR) AS hole_id, coalesce(m.d, 0.0) AS final, coalesce(m.d, 0.0) AS target,
               coalesce(m.d, 0.0) AS current FROM orders LEFT JOIN m ON CAST(o_orderkey AS VARCHAR) = m.hole_id""",
    "orphan_intervals": f"""SELECT {HOLE} AS hole_id, count(*) AS "rows" FROM lineitem
        WHERE {HOLE} NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) GROUP BY 1""",
    "empty_holes": f"""WITH {HOLE_LOOKUP} SELECT key, v AS hole_id FROM hl
        WHERE v NOT IN (SELECT DISTINCT {HOLE} FROM lineitem)""",
    "sorted_intervals": f"""SELECT row_number() OVER (ORDER BY {HOLE}, l_quantity, {LI}) - 1 AS pos, {HOLE} AS hole_id,
        l_quantity AS "from", l_quantity + l_linenumber AS "to" FROM lineitem""",
    "interval_collection": f"""WITH {HOLE_LOOKUP}, {_index_map(f'SELECT {HOLE} AS v FROM lineitem')}, {_coded('s', SORTED_HOLES, 'l_returnflag', 'lineitem')}
        """ + " UNION ALL ".join([
        _rows("from_to", "SELECT * FROM s", a="l_quantity", b="l_quantity + l_linenumber"),
        _rows("holes", "SELECT * FROM im", "hole_index", a='"offset"', b='"count"'),
        _lookup_rows("lookup_0", "s"), _code_rows("codes_0", "s"), _rows("values_0", "SELECT * FROM s", a="l_tax")]),
    "interval_collections": f"""WITH {HOLE_LOOKUP}, {_index_map(f'SELECT {HOLE} AS v FROM lineitem', 'a')},
        {_index_map("SELECT CAST(l_suppkey AS VARCHAR) AS v FROM lineitem", 'g')}
        SELECT 'assay' AS collection, * FROM a UNION ALL SELECT 'geology' AS collection, * FROM g""",
    "hole_location": f"""WITH {HOLE_LOOKUP}, {_index_map(f'SELECT {HOLE} AS v FROM lineitem')},
        m AS (SELECT {HOLE} AS v, max(l_quantity) AS d FROM lineitem GROUP BY 1),
        o AS (SELECT row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS pos, CAST(o_orderkey AS VARCHAR) AS v, * FROM orders),
        p AS (SELECT row_number() OVER (ORDER BY {SORTED_HOLES}) - 1 AS pos, * FROM lineitem)
        """ + " UNION ALL ".join([
        _rows("coordinates", "SELECT * FROM o", a="o_custkey", b="o_totalprice", c="0.0"),
        _rows("distances", "SELECT o.pos, coalesce(m.d, 0.0) AS d FROM o LEFT JOIN m ON o.v = m.v", a="d", b="d", c="d"),
        _rows("lookup", "SELECT * FROM hl", "key", text="v"),
        _rows("codes", "SELECT o.pos, hl.key FROM o JOIN hl ON o.v = hl.v", a="key"),
        _rows("holes", "SELECT * FROM im", "hole_index", a='"offset"', b='"count"'),
        _rows("path", "SELECT * FROM p", a="l_quantity", b="l_extendedprice", c="-l_discount")]),
    "downhole_collection": f"""WITH {HOLE_LOOKUP}, {_index_map(f'SELECT {HOLE} AS v FROM lineitem', 's')},
        {_index_map("SELECT CAST(l_suppkey AS VARCHAR) AS v FROM lineitem", 'g')}
        """ + " UNION ALL ".join(_rows(n, f"SELECT * FROM {t}", "hole_index", a='"offset"', b='"count"')
                                for n, t in (("survey", "s"), ("assay", "s"), ("geology", "g"))),
    "downhole_intervals": f"""WITH {_coded('s', LI, HOLE, 'lineitem')}, {_coded('t', LI, 'l_returnflag', 'lineitem')}
        """ + " UNION ALL ".join([
        _rows("start", "SELECT * FROM s", a="l_quantity", b="l_extendedprice", c="-l_quantity"),
        _rows("end", "SELECT * FROM s", a="l_quantity + l_linenumber", b="l_extendedprice", c="-(l_quantity + l_linenumber)"),
        _rows("mid", "SELECT * FROM s", a="(l_quantity + (l_quantity + l_linenumber)) / 2", b="(l_extendedprice + l_extendedprice) / 2",
              c="(-l_quantity + -(l_quantity + l_linenumber)) / 2"),
        _rows("from_to", "SELECT * FROM s", a="l_quantity", b="l_quantity + l_linenumber"),
        _lookup_rows("lookup_0", "s"), _code_rows("codes_0", "s"), _lookup_rows("lookup_1", "t"), _code_rows("codes_1", "t")]),
    "unique_holes": """SELECT 'orders' AS source, count(*) AS "rows", count(DISTINCT o_orderkey) AS unique_ids FROM orders
        UNION ALL SELECT 'conversations', count(*), count(DISTINCT conv_id) FROM conversations""",
    "duplicate_ids": 'SELECT conv_id AS id, count(*) AS "rows" FROM conversations GROUP BY conv_id HAVING count(*) > 1',
    "column_profile": " UNION ALL ".join(
        _profile("events", "SELECT * FROM events", [
            ("event_id", "int64", True), ("ts", "datetime64[us]", False), ("user_id", "int64", True),
            ("event_type", "object", False), ("value", "float64", True), ("props", "object", False)])
        + _profile("documents", "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d "
                                "LEFT JOIN labels l ON d.doc_id = l.doc_id", [
            ("doc_id", "int64", True), ("text", "object", False), ("lang", "object", False), ("source", "object", False), ("n_chars", "int64", True),
            ("quality", "int32", True), ("toxic", "int32", True)])),
    "csv_typed_scan": f"SELECT event_id, {_iso('ts')} AS ts, user_id, event_type, value, props FROM events",
    "list_workspaces": f"""WITH pc AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY 1),
        ws AS (SELECT c_mktsegment, min(f) AS created_at, max(l) AS updated_at FROM customer LEFT JOIN pc ON c_custkey = o_custkey
               GROUP BY c_mktsegment)
        SELECT lower(c_mktsegment) AS id, c_mktsegment AS name, 'Objects of the ' || c_mktsegment || ' segment' AS description,
               'OWNER' AS user_role, {_iso('created_at')} AS created_at, {_iso('updated_at')} AS updated_at
        FROM ws ORDER BY name, id LIMIT 50""",
    "get_workspace": f"""WITH pc AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY 1),
        ws AS (SELECT c_mktsegment, min(f) AS created_at, max(l) AS updated_at FROM customer LEFT JOIN pc ON c_custkey = o_custkey
               GROUP BY c_mktsegment)
        SELECT lower(c_mktsegment) AS id, c_mktsegment AS name, 'Objects of the ' || c_mktsegment || ' segment' AS description,
               'OWNER' AS user_role, {_iso('created_at')} AS created_at, {_iso('updated_at')} AS updated_at,
               'system' AS created_by, 'unspecified' AS default_coordinate_system, c_mktsegment AS labels
        FROM ws WHERE c_mktsegment = '{SOURCE_WS.upper()}'""",
    "list_objects": f"""WITH {OBJ}
        SELECT id, name, path, schema_id, version_id, {_iso('created_at')} AS created_at FROM cur
        WHERE workspace_id = '{SOURCE_WS}' AND schema_id = 'pointset' AND NOT deleted
        ORDER BY cur.created_at DESC, id LIMIT 100""",
    "get_object": f"""WITH {OBJ}
        SELECT id, name, path, schema_id, version_id, {_iso('created_at')} AS created_at FROM cur
        WHERE workspace_id = {LOOKUP_WS} AND path = '/' || {LOOKUP_WS} || '/object-{LOOKUP_CUSTOMER}.json'""",
    "filter_objects": f"""WITH {OBJ}
        SELECT id, name, path, schema_id, version_id, {_iso('created_at')} AS created_at FROM cur
        WHERE schema_id IN ({', '.join(repr(s) for s in COPY_SCHEMAS)})""",
    "latest_versions": f"WITH {OBJ} SELECT workspace_id, id, version_id, {_iso('created_at')} AS created_at FROM cur",
    "object_versions": f"""WITH {OBJ}
        SELECT version_id, {_iso('created_at')} AS created_at, created_by FROM obj
        WHERE workspace_id = {LOOKUP_WS} AND id = {LOOKUP_ID}""",
    "object_content": f"""WITH {OBJ}
        SELECT c.id, c.version_id, c.schema_id, c.schema_id AS doc_schema,
               CASE WHEN c.o_orderstatus <> 'P' THEN 'unspecified' END AS crs,
               CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = c.o_orderkey) AS INTEGER) AS n_refs
        FROM cur c WHERE c.workspace_id = {LOOKUP_WS} AND c.id = {LOOKUP_ID}""",
    "workspace_summary": f"""WITH {OBJ}
        SELECT workspace_id, schema_id, count(*) AS objects FROM alive GROUP BY ROLLUP (workspace_id, schema_id)
        HAVING workspace_id IS NOT NULL""",
    "workspace_snapshot": f"""WITH {OBJ},
        ws AS (SELECT DISTINCT lower(c_mktsegment) AS workspace_id, c_mktsegment AS workspace_name,
                      'Objects of the ' || c_mktsegment || ' segment' AS workspace_description FROM customer)
        SELECT '{SNAPSHOT_NAME}' AS snapshot_name, '{SNAPSHOT_TIME}' AS snapshot_timestamp, c.workspace_id, ws.workspace_name,
               ws.workspace_description, c.id AS object_id, c.name, c.path, c.schema_id, c.version_id,
               {_iso('c.created_at')} AS created_at,
               CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = c.o_orderkey) AS INTEGER) AS n_blobs
        FROM alive c LEFT JOIN ws ON c.workspace_id = ws.workspace_id WHERE c.workspace_id = '{SOURCE_WS}'""",
    "snapshot_references": f"""WITH {OBJ}
        SELECT '{SNAPSHOT_NAME}' AS snapshot_name, c.id AS object_id, c.version_id, r.ordinal, r.blob_id
        FROM alive c JOIN refs r ON r.l_orderkey = c.o_orderkey WHERE c.workspace_id = '{SOURCE_WS}'""",
    "iso_timestamps": f"SELECT event_id, {_iso('ts')} AS ts FROM events",
    "data_references": f"""WITH {OBJ}
        SELECT o.workspace_id, o.id, o.version_id, r.ordinal, r.blob_id FROM obj o JOIN refs r ON r.l_orderkey = o.o_orderkey""",
    "object_blobs": f"""WITH {OBJ}
        SELECT o.workspace_id, o.id, o.version_id, r.ordinal, r.blob_id, s.length
        FROM obj o JOIN refs r ON r.l_orderkey = o.o_orderkey
        JOIN blobs s ON s.blob_id = r.blob_id AND s.workspace_id = o.workspace_id""",
    "new_blobs": f"""WITH {_dup_ctes(())}
        SELECT '{TARGET_WS}' AS workspace_id, b.blob_id, b.length
        FROM ok_refs r JOIN (SELECT DISTINCT blob_id, length FROM blobs WHERE workspace_id = '{SOURCE_WS}') b ON r.blob_id = b.blob_id
        WHERE b.blob_id NOT IN (SELECT blob_id FROM blobs WHERE workspace_id = '{TARGET_WS}')""",
    "duplicate_workspace": f"""WITH {_dup_ctes(COPY_SCHEMAS)}
        SELECT '{TARGET_WS}' AS workspace_id, id AS source_id, name, path, schema_id, version_id AS source_version_id FROM ok""",
    "duplicate_counts": f"""WITH {_dup_ctes(COPY_SCHEMAS)}
        SELECT (SELECT count(*) FROM ok) AS objects_copied, (SELECT count(*) FROM failed) AS objects_failed,
               (SELECT count(*) FROM ok_refs) AS data_blobs_copied""",
    "copy_object": f"""WITH {OBJ},
        one AS (SELECT * FROM cur WHERE workspace_id = {LOOKUP_WS} AND id = {LOOKUP_ID}),
        one_refs AS (SELECT r.blob_id, b.blob_id IS NOT NULL AS held FROM one JOIN refs r ON r.l_orderkey = one.o_orderkey
                     LEFT JOIN blobs b ON b.blob_id = r.blob_id AND b.workspace_id = one.workspace_id),
        ok AS (SELECT count(*) FILTER (WHERE NOT held) = 0 AS ok, count(*) AS n FROM one_refs)
        SELECT (SELECT count(*) FROM one WHERE (SELECT ok FROM ok)) AS objects_copied,
               (SELECT count(*) FROM one WHERE NOT (SELECT ok FROM ok)) AS objects_failed,
               CAST(CASE WHEN (SELECT ok FROM ok) THEN (SELECT n FROM ok) ELSE 0 END AS BIGINT) AS data_blobs_copied""",
    "duplicate_then_list": f"""WITH {_dup_ctes(())},
        have AS (SELECT blob_id FROM blobs WHERE workspace_id IN ('{SOURCE_WS}', '{TARGET_WS}')),
        n AS (SELECT s.id, count(*) AS n, count(*) FILTER (WHERE r.blob_id IN (SELECT blob_id FROM have)) AS h
              FROM ok s JOIN refs r ON r.l_orderkey = s.o_orderkey GROUP BY s.id)
        SELECT substr(sha256('["{SOURCE_WS}","' || ok.id || '","{TARGET_WS}"]'), 1, 32) AS id, name, path, schema_id, '{SNAPSHOT_TIME}' AS created_at,
               coalesce(n.n, 0) AS n_references, coalesce(n.h, 0) AS n_held FROM ok LEFT JOIN n ON ok.id = n.id""",
    "duplicate_twice": f"""WITH {_dup_ctes(())},
        fresh AS (SELECT blob_id FROM ok_refs WHERE blob_id NOT IN (SELECT blob_id FROM blobs WHERE workspace_id = '{TARGET_WS}')),
        c AS (SELECT 'objects' AS "table", (SELECT count(*) FROM ok) AS n
              UNION ALL SELECT 'references', (SELECT count(*) FROM ok s JOIN refs r ON r.l_orderkey = s.o_orderkey)
              UNION ALL SELECT 'blobs', (SELECT count(*) FROM fresh))
        SELECT "table", n AS first, CAST(0 AS BIGINT) AS second, n AS held FROM c""",
    "append_retry": f"""WITH {OBJ} SELECT substr(sha256('["{SOURCE_WS}","' || path || '"]'), 1, 32) AS id, name, path, schema_id,
        CAST(1 AS BIGINT) AS versions FROM cur WHERE workspace_id = '{SOURCE_WS}'""",
    "filter_by_names": f"""WITH {OBJ} SELECT id, name, path, schema_id, version_id, {_iso('created_at')} AS created_at FROM cur
        WHERE name IN (SELECT 'object-' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)""",
    "nested_references": f"""WITH {OBJ}, o AS (SELECT obj.*, orders.o_custkey, CASE WHEN obj.o_orderstatus = 'F' THEN 1 ELSE 0 END AS again
          FROM obj JOIN orders ON obj.o_orderkey = orders.o_orderkey),
        r AS (SELECT workspace_id, id, version_id, 0 AS ordinal, 'esc-' || version_id AS blob_id FROM o
          UNION ALL SELECT workspace_id, id, version_id, 1, 'kept-' || version_id FROM o WHERE again = 1
          UNION ALL SELECT workspace_id, id, version_id, 1 + again, 'deep-' || CAST(o_custkey AS VARCHAR) FROM o
          UNION ALL SELECT workspace_id, id, version_id, 2 + again + ordinal, refs.blob_id FROM o JOIN refs ON refs.l_orderkey = o.o_orderkey)
        SELECT workspace_id, id, version_id, CAST(ordinal AS INTEGER) AS ordinal, blob_id FROM r""",
    "document_problems": f"""WITH {OBJ}, o AS (SELECT obj.*, orders.o_orderpriority AS p FROM obj JOIN orders ON obj.o_orderkey = orders.o_orderkey),
        l AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LI}) - 1 AS i FROM lineitem),
        f AS (SELECT id, version_id, 'wrong type' AS problem, '/locations/coordinates/data' AS "at", 'string' AS expected, 'integer' AS found
            FROM o WHERE o_orderstatus = 'F'
          UNION ALL SELECT id, version_id, 'missing', '/bounding_box/min_z', 'number or integer', 'null' FROM o WHERE o_orderstatus = 'P'
          UNION ALL SELECT id, version_id, 'missing', '/coordinate_reference_system', 'string or object', NULL FROM o WHERE p = '5-LOW'
          UNION ALL SELECT id, version_id, 'unknown', '/note', NULL, 'object' FROM o WHERE p = '1-URGENT'
          UNION ALL SELECT id, version_id, 'missing', '/locations/attributes/' || CAST(i AS VARCHAR) || '/key', 'string', NULL
            FROM o JOIN l ON l_orderkey = o_orderkey WHERE l_linenumber = 3
          UNION ALL SELECT id, version_id, 'wrong type', '/locations/attributes/' || CAST(i AS VARCHAR) || '/values/length', 'integer', 'string'
            FROM o JOIN l ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
        SELECT id, version_id, 'pointset' AS object_type, problem, "at", expected, found FROM f""",
    "schema_conformance": f"""WITH {OBJ},
        req(object_type, parameter) AS (VALUES {_conformance_values()}),
        has_lines AS (SELECT DISTINCT l_orderkey FROM lineitem)
        SELECT c.id, c.version_id, c.schema_id AS object_type, req.parameter AS missing_field
        FROM cur c JOIN req ON req.object_type = c.schema_id
        WHERE NOT (req.parameter IN ('name', 'uuid', 'schema')
                   OR (req.parameter = 'coordinate_reference_system' AND c.o_orderstatus <> 'P')
                   OR (req.parameter = 'bounding_box' AND c.o_orderkey IN (SELECT l_orderkey FROM has_lines)))""",
    "line_segments_arrays": f"""WITH {_coded('v', 'p_partkey', 'p_brand', 'part')}, {_coded('s', LI, 'l_returnflag', 'lineitem')}
        """ + " UNION ALL ".join([
        _rows("coordinates", "SELECT * FROM v", a="p_retailprice", b="p_size", c="0.0"),
        _rows("indices", "SELECT * FROM s", a="l_partkey", b="l_suppkey"),
        _lookup_rows("lookup_0", "v"), _code_rows("codes_0", "v"), _lookup_rows("lookup_1", "s"), _code_rows("codes_1", "s")]),
    "dry_run_downhole": f"""SELECT 'validation_passed' AS status, CAST(0 AS INTEGER) AS n_errors, CAST(0 AS INTEGER) AS n_warnings,
        count(*) AS "rows", count(DISTINCT o_orderkey) AS unique_holes, count(*) AS valid_rows,
        {_box('CAST(o_custkey AS DOUBLE)', 'o_totalprice', '0.0::DOUBLE')} FROM orders""",
    "pointset_document": """SELECT 'events' AS name, '/objects/pointset/1.3.0/pointset.schema.json' AS schema, min(CAST(user_id AS DOUBLE)) AS min_x,
        max(CAST(user_id AS DOUBLE)) AS max_x, count(*) AS points, CAST(0 AS INTEGER) AS i, 'event_type' AS attribute, 'event_type' AS key,
        'category' AS attribute_type, CAST(0 AS INTEGER) AS nan_values, count(DISTINCT coalesce(event_type, '')) AS categories,
        count(*) AS "values" FROM events
        UNION ALL SELECT 'events', '/objects/pointset/1.3.0/pointset.schema.json', min(CAST(user_id AS DOUBLE)), max(CAST(user_id AS DOUBLE)),
        count(*), 1, 'event_id', 'event_id', 'continuous', 0, NULL, count(*) FROM events""",
    "csv_preview": " UNION ALL ".join(p.replace("'events' AS source, ", "") for p in _profile("events", "SELECT * FROM events", [
        ("event_id", "int64", True), ("user_id", "int64", True), ("event_type", "object", False), ("value", "float64", True)])),
    "csv_pointset": f"""WITH {_coded('e', 'event_id', 'event_type', 'events')}
        """ + " UNION ALL ".join([_rows("coordinates", "SELECT * FROM e", a="user_id", b="value", c="event_id"),
                                  _lookup_rows("lookup_0", "e"), _code_rows("codes_0", "e")]),
    "csv_line_segments": f"""WITH {_coded('v', 'p_partkey', 'p_brand', 'part')}, {_coded('s', LI_CSV, 'l_returnflag', 'lineitem')}
        """ + " UNION ALL ".join([
        _rows("coordinates", "SELECT * FROM v", a="p_retailprice", b="p_size", c="0.0"),
        _rows("indices", "SELECT * FROM s", a="l_partkey", b="l_suppkey"),
        _lookup_rows("lookup_0", "v"), _code_rows("codes_0", "v"), _lookup_rows("lookup_1", "s"), _code_rows("codes_1", "s")]),
    "interval_files": f"""WITH {HOLE_LOOKUP} SELECT 'c' || CAST(l_suppkey % 50 AS VARCHAR) AS object, hl.key AS hole_index, l_quantity AS data1,
        l_quantity + l_linenumber AS data2, l_returnflag AS flag, l_tax AS tax FROM lineitem JOIN hl ON {HOLE} = hl.v WHERE l_suppkey % 50 <> 7""",
    "interval_file_index": f"""WITH {HOLE_LOOKUP}, f AS (SELECT DISTINCT l_suppkey % 50 AS f FROM lineitem WHERE l_suppkey % 50 <> 7),
        n AS (SELECT l_suppkey % 50 AS f, {HOLE} AS v, count(*) AS n FROM lineitem GROUP BY ALL),
        o AS (SELECT f, v, n, sum(n) OVER (PARTITION BY f ORDER BY v) - n AS off FROM n)
        SELECT 'c' || CAST(f.f AS VARCHAR) AS object, hl.key AS hole_index, CAST(coalesce(o.off, 0) AS BIGINT) AS "offset",
          CAST(coalesce(o.n, 0) AS BIGINT) AS "count" FROM f CROSS JOIN hl LEFT JOIN o ON o.f = f.f AND o.v = hl.v""",
    "interval_file_reports": """SELECT 'c' || CAST(f AS VARCHAR) AS collection, CASE WHEN f = 7 THEN 'error' ELSE 'ok' END AS status,
          CAST(CASE WHEN f = 7 THEN 1 ELSE 0 END AS INTEGER) AS n_errors, n AS "rows"
        FROM (SELECT l_suppkey % 50 AS f, count(*) AS n FROM lineitem GROUP BY 1) t
        UNION ALL SELECT 'c50', 'error', 1, 0""",
    "csv_hole_distances": f"""WITH m AS (SELECT {BLANK} AS hole_id, max(l_quantity) AS d FROM lineitem GROUP BY 1)
        SELECT CAST(o_orderkey AS VARCHAR) AS hole_id, CAST(coalesce(m.d, 0.0) AS DOUBLE) AS final, CAST(coalesce(m.d, 0.0) AS DOUBLE) AS target,
               CAST(coalesce(m.d, 0.0) AS DOUBLE) AS current FROM orders LEFT JOIN m ON CAST(o_orderkey AS VARCHAR) = m.hole_id""",
    "csv_downhole_collection": f"""WITH {HOLE_LOOKUP}, {_index_map(f'SELECT {BLANK} AS v FROM lineitem')},
        m AS (SELECT {BLANK} AS v, max(l_quantity) AS d FROM lineitem GROUP BY 1),
        o AS (SELECT row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS pos, CAST(o_orderkey AS VARCHAR) AS v, * FROM orders)
        """ + " UNION ALL ".join([
        _rows("coordinates", "SELECT * FROM o", a="o_custkey", b="o_totalprice", c="0.0"),
        _rows("distances", "SELECT o.pos, coalesce(m.d, 0.0) AS d FROM o LEFT JOIN m ON o.v = m.v", a="d", b="d", c="d"),
        _rows("codes", "SELECT o.pos, hl.key FROM o JOIN hl ON o.v = hl.v", a="key"),
        _rows("holes", "SELECT * FROM im", "hole_index", a='"offset"', b='"count"'),
        _rows("collection", "SELECT * FROM im", "hole_index", a='"offset"', b='"count"')]),
    "csv_downhole_intervals": f"""WITH {_coded('s', LI_CSV, HOLE, 'lineitem')}, {_coded('t', LI_CSV, 'l_returnflag', 'lineitem')}
        """ + " UNION ALL ".join([
        _rows("mid", "SELECT * FROM s", a="l_quantity", b="l_quantity", c="l_quantity"),
        _rows("from_to", "SELECT * FROM s", a="l_quantity", b="l_quantity + l_linenumber"),
        _lookup_rows("lookup_0", "s"), _code_rows("codes_0", "s"), _lookup_rows("lookup_1", "t"), _code_rows("codes_1", "t")]),
    "csv_statuses": """SELECT 'good' AS "case", CASE WHEN count(value) > 0 THEN 'validation_passed' ELSE 'validation_failed' END AS status,
        CAST(CASE WHEN count(value) > 0 THEN 0 ELSE 1 END AS INTEGER) AS n_errors FROM events
        UNION ALL SELECT 'text', 'validation_failed', 2 UNION ALL SELECT 'missing', 'error', 1""",
    "file_position": "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events",
    "pinned_version": f"""WITH {OBJ}
        SELECT id, name, path, schema_id, version_id, {_iso('created_at')} AS created_at FROM obj
        WHERE workspace_id = {LOOKUP_WS} AND id = {LOOKUP_ID}
          AND version_id = (SELECT min(version_id) FROM obj WHERE workspace_id = {LOOKUP_WS} AND id = {LOOKUP_ID})""",
}
