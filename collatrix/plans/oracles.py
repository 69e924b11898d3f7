"""DuckDB SQL with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from .queries import NAMES, PAIRS, REVIEW

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def words(column: str) -> str:
    return WORDS.format(column)


def values(rows: list[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)


LINES = "lines AS (SELECT doc_id, source, lang, CAST(i - 1 AS INT) AS line_no, parts[i] AS line FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) t(i))"
SHINGLES = f"""
tok AS (SELECT doc_id, {words("text")} AS w FROM documents),
sh AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] AS s FROM tok, unnest(range(1, len(w) - 2)) t(i)),
uq AS (SELECT doc_id, s, min(pos) AS pos FROM sh GROUP BY 1, 2 HAVING count(*) = 1)"""
COPIES = (
    SHINGLES
    + """,
firsts AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
own AS (SELECT uq.* FROM uq SEMI JOIN firsts USING (doc_id)),
copies AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM own x JOIN own y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 20)"""
)
VOTES = (
    COPIES
    + """,
votes AS (SELECT c.a, c.b, y.pos // 40 AS b_page, x.pos // 40 AS a_page, count(*) AS n FROM copies c JOIN uq x ON x.doc_id = c.a JOIN uq y ON y.doc_id = c.b AND y.s = x.s GROUP BY 1, 2, 3, 4),
best AS (SELECT a, b, CAST(b_page AS INT) AS b_page, CAST(a_page AS INT) AS a_page, n FROM votes QUALIFY row_number() OVER (PARTITION BY a, b, b_page ORDER BY n DESC, a_page) = 1)"""
)
QUOTES = "hits AS (SELECT i.item_id, d.doc_id, d.source FROM benchmark i JOIN documents d ON contains(d.text, i.text))"
STATUSES = """st AS (SELECT d.doc_id, d.source, d.lang, CASE WHEN toxic = 1 THEN 'removed' WHEN quality = 0 THEN 'changed' WHEN d.doc_id % 3 = 0 THEN 'moved' WHEN d.doc_id % 3 = 1 THEN 'unchanged' ELSE 'unresolved' END AS status FROM labels l JOIN documents d USING (doc_id))"""
BOXES = """bx AS (SELECT vec_id, label, vec_id // 25 AS page, least(e[1], e[3]) AS x0, least(e[2], e[4]) AS y0, greatest(e[1], e[3]) AS x1, greatest(e[2], e[4]) AS y1, e[5] AS px, e[6] AS py FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""
PANELS = """pp AS (SELECT x.vec_id, x.label, y.label AS other_label, y.e IS NULL AS gone,
  len(list_filter(list_zip(x.e, y.e), lambda p: (p[1] > 0.1 OR p[2] > 0.1) AND abs(p[1] - p[2]) > 0.2))
  / greatest(len(list_filter(list_zip(x.e, y.e), lambda p: p[1] > 0.1 OR p[2] > 0.1)), 5.0) AS ratio
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) x LEFT JOIN (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) y ON y.vec_id = x.vec_id + 1)"""
DICE = f"""ib AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest({words("lower(text)")}) AS w FROM benchmark) GROUP BY 1, 2),
sz AS (SELECT item_id, sum(n) AS n FROM ib GROUP BY 1)"""
TURNS = f"""tb AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({words("lower(text)")}) AS w FROM conversations) GROUP BY 1, 2, 3),
ts AS (SELECT conv_id, turn, sum(n) AS n FROM tb GROUP BY 1, 2)"""

REFERENCE = r"^(?i)(fig(ure)?s?|tab(le)?s?|eqs?|equations?|sec(tion)?s?|refs?|app(endix)?|appendices|chapters?|lines?|l)\.?$"
SECTION = r"^[(\[]?(?:[A-Z]|[0-9]+)(?:\.[0-9]+)*[a-z]?(?:-(?:[A-Z]\.?)?[0-9]+(?:\.[0-9]+)*[a-z]?)?[)\],.;:]*$"
WHOLE = r"^[\[(]?(?:[A-Z]\.)?[0-9]+[a-z]?[\])]?[,.;:]?$"
CITATION = r"^(\[[0-9]+[\],;]?[,.;:]?|[0-9]+\][,.;:]?)$"
EQUATION = r"^\((?:[A-Z]\.)?[0-9]+[a-z]?\)[,.;:]?$"
CITED = r"^\[?[0-9]+(?:-[0-9]*)?(?:,[0-9]+(?:-[0-9]*)?)*[\],]?[,.;:]?$"


def both(pattern: str) -> str:
    return f"(regexp_matches(old, '{pattern}') AND regexp_matches(new, '{pattern}'))"


ORACLES: dict[str, str] = {
    "doc_lines": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines",
    "doc_tokens": f"WITH t AS (SELECT doc_id, {words('text')} AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(w) - 1 AS INT) AS last_tok, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS n_chars, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM t WHERE len(w) > 0",
    "digit_skeleton": "SELECT page_id, regexp_replace(url, '[0-9.]+', '#', 'g') AS skeleton FROM pages",
    "suspicious_glyphs": r"SELECT doc_id, CAST(length(text) AS INT) AS glyphs, CAST(length(regexp_replace(text, '[^\x{E000}-\x{F8FF}\x{FFFD}\x{F0000}-\x{10FFFF}]', '', 'g')) AS INT) AS suspicious FROM documents",
    "repeated_lines": f"""WITH {LINES}, sz AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
        seen AS (SELECT source, regexp_replace(line, '[0-9.]+', '#', 'g') AS skeleton, count(DISTINCT doc_id) AS n_docs FROM lines WHERE line <> '' GROUP BY 1, 2)
        SELECT source, skeleton, n_docs FROM seen JOIN sz USING (source) WHERE n_docs >= greatest(3, ceil(pages * 0.01))""",
    "unique_shingles": f"WITH {SHINGLES} SELECT doc_id, count(*) AS n_unique, min(pos) AS first_pos, max(pos) AS last_pos FROM uq GROUP BY 1",
    "text_classes": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents",
    "near_copy_pairs": f"WITH {COPIES} SELECT a, b, shared FROM copies",
    "edit_cover": f"WITH {COPIES} SELECT c.a, c.b, CAST(len(x.w) AS BIGINT) AS a_tokens, CAST(len(y.w) AS BIGINT) AS b_tokens FROM copies c JOIN tok x ON x.doc_id = c.a JOIN tok y ON y.doc_id = c.b",
    "op_islands": """WITH s AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS st FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS island FROM s)
        SELECT conv_id, island, role, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM g GROUP BY 1, 2, 3""",
    "bridge_groups": """WITH m AS (SELECT *, event_type IN ('error', 'purchase') AS edit, sum(CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
        e AS (SELECT *, CASE WHEN gap - lag(gap) OVER w > 3 OR lag(gap) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM m WHERE edit WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS grp FROM e)
        SELECT user_id, grp, count(*) AS n_edits, min(event_id) AS least_event, max(event_id) AS greatest_event FROM g GROUP BY 1, 2""",
    "consecutive_share": """WITH s AS (SELECT l_returnflag, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS d FROM lineitem)
        SELECT l_returnflag, count(*) AS n, CAST(count(*) FILTER (d = 1) AS BIGINT) AS n_follow FROM s GROUP BY 1""",
    "line_number_column": """WITH r AS (SELECT l_returnflag, CAST(floor(l_quantity / 25) AS INT) AS bucket, row_number() OVER (PARTITION BY l_returnflag, floor(l_quantity / 25) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem),
        m AS (SELECT *, CASE WHEN nth % 7 = 0 OR (nth % 2 = 0 AND bucket % 2 = 1) THEN -nth ELSE nth END AS num FROM r),
        s AS (SELECT l_returnflag, bucket, num - lag(num) OVER (PARTITION BY l_returnflag, bucket ORDER BY nth) AS d FROM m),
        c AS (SELECT l_returnflag, bucket, count(*) AS n, CAST(count(*) FILTER (d = 1) AS BIGINT) AS steps FROM s GROUP BY 1, 2 HAVING count(*) >= 15)
        SELECT * FROM c WHERE steps >= 0.6 * (n - 1) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY steps DESC, bucket) = 1""",
    "classify_pairs": f"""WITH v(id, old, new, p1, p2, p3, heading, cited) AS (VALUES {values(PAIRS)})
        SELECT id, CASE WHEN old = new THEN 'same'
          WHEN NOT regexp_matches(old, '[0-9]') OR NOT regexp_matches(new, '[0-9]') OR regexp_replace(old, '[0-9.]+', '#', 'g') <> regexp_replace(new, '[0-9.]+', '#', 'g') THEN 'text'
          WHEN (heading OR regexp_matches(p1, '{REFERENCE}')) AND {both(SECTION)} THEN 'renumber'
          WHEN cited AND {both(CITED)} THEN 'renumber'
          WHEN NOT {both(WHOLE)} THEN 'numeric'
          WHEN {both(CITATION)} OR {both(EQUATION)} THEN 'renumber'
          WHEN p1 IN ('and', '&', '-', '–', 'to', ',') AND regexp_matches(p2, '{WHOLE}') AND regexp_matches(p3, '{REFERENCE}') THEN 'renumber'
          WHEN regexp_matches(p1, '^[0-9]+,$') AND regexp_matches(p2, '{REFERENCE}') THEN 'renumber' ELSE 'numeric' END AS cls FROM v""",
    "bag_dice": f"""WITH {DICE}, {TURNS}, c AS (SELECT item_id, conv_id, turn, CAST(sum(least(ib.n, tb.n)) AS BIGINT) AS common FROM ib JOIN tb USING (w) GROUP BY 1, 2, 3)
        SELECT item_id, conv_id, turn, common, round(2 * common / (sz.n + ts.n), 9) AS score FROM c JOIN sz USING (item_id) JOIN ts USING (conv_id, turn) WHERE 2 * common / (sz.n + ts.n) >= 0.15""",
    "caption_candidates": f"""WITH {DICE}, c AS (SELECT x.item_id AS a, y.item_id AS b, sum(least(x.n, y.n)) AS common FROM ib x JOIN ib y USING (w) WHERE x.item_id < y.item_id GROUP BY 1, 2)
        SELECT a, b, round(2 * common / (p.n + q.n) - 0.001 * abs(a - b), 9) AS score FROM c JOIN sz p ON p.item_id = a JOIN sz q ON q.item_id = b WHERE 2 * common / (p.n + q.n) >= 0.2""",
    "page_votes": f"""WITH {VOTES}, classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents),
        others AS (SELECT doc_id, class_id FROM classes JOIN uq USING (doc_id) WHERE doc_id > class_id GROUP BY 1, 2 HAVING count(*) >= 20)
        SELECT a, b, b_page, a_page, n FROM best
        UNION ALL SELECT class_id, doc_id, CAST(pos // 40 AS INT), CAST(pos // 40 AS INT), count(*) FROM others JOIN uq USING (doc_id) GROUP BY 1, 2, 3, 4""",
    "unpaired_pages": f"""WITH {VOTES}, span AS (SELECT a, b, min(a_page) AS lo, max(a_page) AS hi FROM best GROUP BY 1, 2),
        every AS (SELECT a, b, CAST(p AS INT) AS a_page FROM span, unnest(range(lo, hi + 1)) t(p)) SELECT * FROM every ANTI JOIN best USING (a, b, a_page)""",
    "asof_place": """WITH p AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events)
        SELECT event_id, user_id, click_id FROM p WHERE event_type = 'purchase'""",
    "interpolate_pos": """WITH e AS (SELECT *, CAST(epoch_us(ts) AS DOUBLE) AS x, CASE WHEN event_type = 'click' THEN value END AS y, CASE WHEN event_type = 'click' THEN CAST(epoch_us(ts) AS DOUBLE) END AS ax FROM events),
        w AS (SELECT *, last_value(ax IGNORE NULLS) OVER b AS x0, last_value(y IGNORE NULLS) OVER b AS y0, first_value(ax IGNORE NULLS) OVER f AS x1, first_value(y IGNORE NULLS) OVER f AS y1 FROM e
          WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 4) AS "at" FROM w WHERE event_type = 'view'""",
    "forward_fill_section": f"""WITH {LINES}, f AS (SELECT doc_id, line_no, last_value(CASE WHEN length(line) BETWEEN 1 AND 30 THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM lines)
        SELECT doc_id, section, count(*) AS n_lines, min(line_no) AS first_line FROM f GROUP BY 1, 2""",
    "snippet_hits": f"WITH {QUOTES} SELECT item_id, doc_id FROM hits",
    "round_evidence": f"""WITH {QUOTES}, s AS (SELECT item_id, source, count(*) AS n FROM hits GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, source) AS p FROM s),
        b AS (SELECT item_id, max(n) FILTER (p = 1) AS best, coalesce(max(n) FILTER (p = 2), 0) AS second, max(source) FILTER (p = 1) AS source FROM r WHERE p <= 2 GROUP BY 1)
        SELECT item_id, best, second, CASE WHEN best > second THEN source END AS source FROM b""",
    "ref_patterns": "WITH v(line, text) AS (VALUES " + values(REVIEW) + ") " + " UNION ALL ".join(
        f"SELECT line, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}', 1)) AS ref FROM v"
        for kind, pattern in (
            ("figure", r"\b(?:Fig(?:ure)?s?\.?|figs?\.) ?([0-9]+[a-z]?)"),
            ("table", r"\b(?:Tab(?:le)?s?\.?|tabs?\.) ?([0-9]+)"),
            ("table", r"\b(?:Tab(?:le)?s?\.?|tabs?\.) ?[0-9]+ and ([0-9]+)"),
            ("equation", r"\b(?:Eq(?:uation)?s?\.?|eqs?\.) ?\(?([0-9]+)"),
            ("section", r"\b(?:[Ss]ec(?:tion)?s?\.?|[Cc]hapter|App(?:endix)?\.?) ?((?:[0-9]+|[A-Z])(?:\.[0-9]+)*)\b"),
            ("cite", r"\b(?:Refs?\.?|refs?\.?) ?\[?([0-9]+)"),
        )
    ),
    "ref_status_rank": f"WITH {STATUSES} SELECT source, lang, arg_max(status, CASE status WHEN 'removed' THEN 5 WHEN 'changed' THEN 4 WHEN 'moved' THEN 3 WHEN 'unchanged' THEN 2 ELSE 1 END) AS status FROM st GROUP BY 1, 2",
    "lead_status": f"WITH {STATUSES} SELECT source, status FROM st QUALIFY row_number() OVER (PARTITION BY source ORDER BY status = 'unresolved', doc_id) = 1",
    "segments_context": f"""WITH t AS (SELECT conv_id, turn, {words("text")} AS w FROM conversations), r AS (SELECT conv_id, turn, i AS pos, w[i] AS word, regexp_matches(w[i], '^[A-Z]') AS changed FROM t, unnest(range(1, len(w) + 1)) u(i)),
        s AS (SELECT *, max(changed) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM r),
        m AS (SELECT *, CASE WHEN lag(pos) OVER q = pos - 1 AND lag(changed) OVER q = changed THEN 0 ELSE 1 END AS st FROM s WHERE near WINDOW q AS (PARTITION BY conv_id, turn ORDER BY pos)),
        g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS INT) AS segment FROM m)
        SELECT conv_id, turn, segment, changed, string_agg(word, ' ' ORDER BY pos) AS text FROM g GROUP BY 1, 2, 3, 4""",
    "box_union": f"WITH {BOXES} SELECT label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM bx GROUP BY 1",
    "box_iou": f"""WITH {BOXES}, m AS (SELECT p.vec_id AS a, q.vec_id AS b, greatest(least(p.x1, q.x1) - greatest(p.x0, q.x0), 0.0) * greatest(least(p.y1, q.y1) - greatest(p.y0, q.y0), 0.0) AS c,
        greatest(p.x1 - p.x0, 0.0) * greatest(p.y1 - p.y0, 0.0) AS pa, greatest(q.x1 - q.x0, 0.0) * greatest(q.y1 - q.y0, 0.0) AS qa FROM bx p JOIN bx q ON p.page = q.page AND p.vec_id < q.vec_id AND p.label = q.label)
        SELECT * FROM (SELECT a, b, round(CASE WHEN pa + qa - c > 0 THEN c / (pa + qa - c) ELSE 0.0 END, 9) AS iou FROM m) WHERE iou > 0.2""",
    "point_in_box": f"""WITH {BOXES} SELECT p.vec_id AS point_id, q.vec_id AS box_id FROM bx p JOIN bx q ON p.page = q.page AND p.px BETWEEN q.x0 AND q.x1 AND p.py BETWEEN q.y0 AND q.y1
        QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY greatest(q.x1 - q.x0, 0.0) * greatest(q.y1 - q.y0, 0.0), q.vec_id) = 1""",
    "version_labels": f"""WITH n(name) AS (VALUES {values(NAMES)} UNION ALL SELECT DISTINCT 'v' || regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1) || '_0' FROM pages),
        l AS (SELECT name, regexp_extract(lower(name), '(?:^|[^a-z])v([0-9]+(?:[._r][0-9]+)*)', 1) AS num FROM n)
        SELECT name, CASE WHEN num <> '' THEN 'v' || replace(num, '_', '.') END AS label,
          CASE WHEN num <> '' THEN regexp_replace(array_to_string(list_transform(string_split_regex(num, '[._r]'), lambda p: CAST(CAST(p AS INT) AS VARCHAR)), '.'), '(\\.0)+$', '') END AS version FROM l""",
    "version_order": """WITH n AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, regexp_extract(url, '/([0-9]+(?:-[0-9]+)*)(?:[?#]|$)', 1) AS v FROM pages),
        k AS (SELECT *, list_transform(string_split(v, '-'), lambda p: TRY_CAST(p AS INT)) AS key FROM n)
        SELECT page_id, host, replace(v, '-', '.') AS version, CAST(row_number() OVER (PARTITION BY host ORDER BY v = '', coalesce(key[1], 0), coalesce(key[2], 0), coalesce(key[3], 0), coalesce(key[4], 0), page_id) AS INT) AS place FROM k""",
    "newest_versions": """WITH n AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, TRY_CAST(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1) AS INT) AS number FROM pages)
        SELECT page_id, host FROM n QUALIFY row_number() OVER (PARTITION BY host ORDER BY number DESC NULLS FIRST, page_id DESC) <= 2""",
    "retention": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30",
    "cache_miss": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "entries_union": """SELECT 'text' AS type, o_orderkey AS id, round(o_custkey * 10000.0::DOUBLE + o_totalprice % 1000, 3) AS pos FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 'figure', p_partkey, round(p_size * 10000.0::DOUBLE, 3) FROM part WHERE p_size > 40
        UNION ALL SELECT 'renumber', s_suppkey, round(s_nationkey * 10000.0::DOUBLE - 0.1, 3) FROM supplier""",
    "category_counts": f"WITH {STATUSES} SELECT status, count(*) AS n FROM st GROUP BY 1",
    "section_counts": "SELECT source, lang, count(*) AS n, CAST(count(*) FILTER (regexp_matches(text, '[0-9]')) AS BIGINT) AS n_numeric FROM documents GROUP BY 1, 2",
    "ink_ratio": f"WITH {PANELS} SELECT vec_id, round(ratio, 9) AS ratio FROM pp WHERE NOT gone",
    "panel_states": f"WITH {PANELS} SELECT vec_id, CASE WHEN gone THEN 'removed' WHEN label = other_label THEN 'same' WHEN ratio > 0.5 THEN 'changed' ELSE 'same' END AS state FROM pp",
    "html_text_lines": """WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'gs'), '<[^>]*>', chr(10), 'g') AS t FROM pages),
        l AS (SELECT page_id, unnest(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS line FROM s)
        SELECT page_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l GROUP BY 1""",
    "caption_starts": "SELECT * FROM (VALUES (1, 'figure', '3'), (2, 'figure', '4'), (3, NULL, NULL), (4, 'table', 'A.1'), (5, NULL, NULL), (6, NULL, NULL)) v(id, kind, number)",
    "body_geometry": f"""WITH {LINES}, c AS (SELECT lang, CAST(floor(length(line) / 10 + 0.5) * 10 AS INT) AS size, count(*) AS n FROM lines WHERE line <> '' GROUP BY 1, 2)
        SELECT lang, size, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, size) = 1""",
    "page_heights": "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM conversations",
    "panel_pairs": """WITH r AS (SELECT vec_id // 20 AS key, vec_id AS part, CASE WHEN label > 0 THEN CAST(label AS VARCHAR) ELSE '' END AS hash FROM embeddings),
        k AS (SELECT *, part % 2 AS side, row_number() OVER (PARTITION BY key, part % 2, hash ORDER BY part) AS nth FROM r WHERE hash <> ''),
        e AS (SELECT x.key, x.part AS a_part, y.part AS b_part FROM k x JOIN k y ON x.key = y.key AND x.hash = y.hash AND x.nth = y.nth AND x.side = 0 AND y.side = 1),
        p AS (SELECT key, part, row_number() OVER (PARTITION BY key ORDER BY part) AS nth FROM r WHERE part % 2 = 0 AND part NOT IN (SELECT a_part FROM e)),
        q AS (SELECT key, part, row_number() OVER (PARTITION BY key ORDER BY part) AS nth FROM r WHERE part % 2 = 1 AND part NOT IN (SELECT b_part FROM e))
        SELECT key, a_part, b_part, TRUE AS same FROM e UNION ALL SELECT coalesce(p.key, q.key), p.part, q.part, FALSE FROM p FULL JOIN q ON p.key = q.key AND p.nth = q.nth""",
    "unused_files": """WITH n AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 15)
        SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM n))""",
    "summary_lines": f"""WITH {STATUSES}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM st)
        SELECT source, doc_id, 0 AS part, CASE WHEN r = 1 THEN '## ' || source ELSE '- ' || doc_id || ' ' || status END AS line FROM n
        UNION ALL SELECT source, doc_id, 1, '- ' || doc_id || ' ' || status FROM n WHERE r = 1""",
    "version_files": r"""WITH n AS (SELECT page_id, url, regexp_replace(url, '[^A-Za-z0-9_.\- ]+', '_', 'g') AS s FROM pages)
        SELECT page_id, CASE WHEN length(s) <= 30 THEN s ELSE s[:27] || '...' END AS name, sha256(url) AS version_id FROM n""",
}
