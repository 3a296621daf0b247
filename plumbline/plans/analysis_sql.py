"""DuckDB SQL of the analysis queries."""

from __future__ import annotations

import os

import plumbline
from plumbline.functions.languages import LANGUAGES, SETTINGS_OF, SUPPORTED
from plumbline.operators.rules import DEFAULTS, RULES, severity_column
from plumbline.operators.scan import DISABLE_TAG, IGNORE_TAG
from plumbline.plans.analysis_queries import BROKEN, DIRECTIVES, PROSE, SETTINGS

_Q = "'"


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _text(x: str) -> str:
    """A literal with its newlines spelled out."""
    return " || chr(10) || ".join(map(_s, x.split("\n")))


def _list(xs) -> str:
    return "[" + ", ".join(map(_s, xs)) + "]"


def _escape(x: str) -> str:
    return "".join("\\" + c if c in '\\.*+?()[]{}|^$' else c for c in x)


_STRINGS = "|".join(rf"{q}(?:\\[\s\S]|[^{q}\\])*(?:{q}|\\?\z)" for q in "\"'`")


def _plain(x, more=""):
    starts = "".join(dict.fromkeys("\"'`" + (x.line or "")[:1] + (x.block[0][:1] if x.block else "") + more))
    return "[^" + "".join("\\" + c if c in "\\]^-" else c for c in starts) + "]+|[\\s\\S]"


def _block(x):
    return x.block and rf"{_escape(x.block[0])}[\s\S]*?(?:{_escape(x.block[1])}|\z)"


def _case(value, languages=LANGUAGES) -> str:
    """CASE over extensions by languages that share a value."""
    groups: dict[str, list[str]] = {}
    for x in languages:
        groups.setdefault(value(x), []).extend(x.extensions)
    return "CASE " + " ".join(f"WHEN ext IN ({', '.join(map(_s, e))}) THEN {v}" for v, e in groups.items()) + " END"


def _scan(x) -> str:
    rx = "|".join(p for p in (x.line and _escape(x.line) + r"[^\n]*", _block(x), _STRINGS, _plain(x)) if p)
    return f"regexp_extract_all(content, {_s(rx)})"


_JSX = r"\{\s*/\*[\s\S]*?(?:\*/(?:\s*\})?|\z)"
_DOCS = r"///[^\n]*|//![^\n]*|/\*\*(?:[^/][\s\S]*?)??(?:\*/|\z)"


def _strip(x, docs: bool, literal: bool = False) -> str:
    def rx(jsx):
        block = rf"{_escape(x.block[0])}[\s\S]*?(?:{_escape(x.block[1])}(?:\s*\}})?|\z)" if literal and jsx else _block(x)
        return "|".join(p for p in (_STRINGS, _JSX if jsx else None, _DOCS if docs and x.line == "//" else None, block, x.line and _escape(x.line) + r"[^\n]*", _plain(x, "{" if jsx else "")) if p)

    if x.name in ("JavaScript", "TypeScript"):
        return f"CASE WHEN ext IN ('jsx', 'tsx') THEN regexp_extract_all(content, {_s(rx(True))}) ELSE regexp_extract_all(content, {_s(rx(False))}) END"
    return f"regexp_extract_all(content, {_s(rx(False))})"




def _line(x) -> str:
    return _s(x.line) if x.line else "NULL"


def _open(x) -> str:
    return _s(x.block[0]) if x.block else "NULL"


_LINE, _OPEN = _case(_line), _case(_open)
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(path, '[\\/]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '')"
_EXT = r"nullif(regexp_extract(path, '[^/]\.([^./]+)$', 1), '')"
_IN = "(" + ", ".join(map(_s, SUPPORTED)) + ")"

FILES = f"""fp AS (SELECT {_CLEAN} AS path, any_value(content) AS content FROM files WHERE content IS NOT NULL AND path IS NOT NULL GROUP BY 1),
fs AS (SELECT path, {_EXT} AS ext, content FROM fp WHERE {_EXT} IN {_IN})"""
DIRECTED = FILES.replace("fs AS (", "fo AS (") + f""",
fd AS (SELECT {_CLEAN} AS path, min(file_id) % 5 AS k FROM files WHERE content IS NOT NULL AND path IS NOT NULL GROUP BY 1),
fs AS (SELECT path, ext, content FROM fo UNION ALL SELECT 'directed/' || path, ext, CASE k {" ".join(f"WHEN {k} THEN {_text(x)}" for k, x in DIRECTIVES.items())} END || content FROM fo JOIN fd USING (path) WHERE k IN ({", ".join(map(str, DIRECTIVES))}))"""

_IGNORED = f"len(list_filter(string_split(content, chr(10))[1:10], lambda x: contains(x, '{IGNORE_TAG}'))) > 0"
_WORDS = rf"""list_distinct(list_filter(flatten(list_transform(string_split(content, chr(10))[1:20], lambda x:
  CASE WHEN contains(lower(x), '{DISABLE_TAG}') THEN regexp_split_to_array(lower(substring(x, CAST(strpos(lower(x), '{DISABLE_TAG}') + {len(DISABLE_TAG)} AS BIGINT))), '\s+') ELSE [] END)), lambda w: w <> ''))"""

_LIMITS = f"""dl AS (SELECT * FROM thresholds WHERE ext = 'default'),
lim AS (SELECT t.ext, {", ".join(f"coalesce(t.{c}, d.{c}, {v}) AS {c}" for c, v in DEFAULTS.items())} FROM thresholds t LEFT JOIN dl d ON true)"""
_KEY = "CASE " + " ".join(f"WHEN ext = '{a}' THEN '{b}'" for a, b in SETTINGS_OF.items()) + " ELSE ext END"


def _limited(source: str) -> str:
    cols = ", ".join(f"coalesce(l.{c}, d.{c}, {v}) AS {c}" for c, v in DEFAULTS.items())
    return f"SELECT f.*, {cols} FROM (SELECT *, {_KEY} AS lk FROM {source}) f LEFT JOIN lim l ON l.ext = f.lk LEFT JOIN lim d ON d.ext = 'default'"


def lines(files: str = FILES, languages=LANGUAGES) -> str:
    """CTEs up to ln(path, ext, line, depth, is_import, code)."""
    return f"""
WITH {files},
kp AS (SELECT path, ext, content, {_WORDS} AS disabled FROM fs WHERE NOT ({_IGNORED})),
tk AS (SELECT path, ext, {_case(_scan, languages)} AS t, {_case(_line, languages)} AS lc, {_case(_open, languages)} AS bo FROM kp),
kd AS (SELECT path, ext, list_transform(t, lambda x: struct_pack(x := x, k := CASE WHEN coalesce(starts_with(x, lc), false) THEN 'l' WHEN coalesce(starts_with(x, bo), false) THEN 'b'
  WHEN x[1] IN ('"', '''', '`') THEN 's' ELSE 'p' END)) AS t FROM tk),
ms AS (SELECT path, ext,
  string_split(array_to_string(list_transform(t, lambda z: CASE z.k WHEN 'l' THEN chr(1) WHEN 'p' THEN z.x
    WHEN 'b' THEN chr(1) || regexp_replace(z.x, '[^\\n]+', '', 'g') || CASE WHEN contains(z.x, chr(10)) AND NOT ends_with(z.x, chr(10)) THEN chr(3) ELSE '' END
    ELSE chr(1) || regexp_replace(regexp_replace(z.x, '\\\\[\\s\\S]', chr(2), 'g'), '[^\\n]+', '', 'g') ||
      CASE WHEN contains(regexp_replace(z.x, '\\\\[\\s\\S]', chr(2), 'g'), chr(10)) AND NOT ends_with(regexp_replace(z.x, '\\\\[\\s\\S]', chr(2), 'g'), chr(10)) THEN chr(3) ELSE '' END END), ''), chr(10)) AS m,
  string_split(regexp_replace(array_to_string(list_transform(t, lambda z: CASE z.k WHEN 'l' THEN chr(1) WHEN 'p' THEN z.x WHEN 'b' THEN chr(1) || regexp_replace(z.x, '[^\\n]+', '', 'g')
    ELSE replace(z.x, '\\' || chr(10), '\\' || chr(2)) || CASE WHEN contains(replace(z.x, '\\' || chr(10), ''), chr(10)) THEN chr(3) ELSE '' END END), ''), '\\x03[ \\t]*|\\x01', '', 'g'), chr(10)) AS c,
  string_split(array_to_string(list_transform(t, lambda z: CASE z.k WHEN 'l' THEN z.x WHEN 'p' THEN z.x WHEN 'b' THEN z.x || CASE WHEN contains(z.x, chr(10)) THEN chr(3) ELSE '' END
    ELSE replace(z.x, '\\' || chr(10), '\\' || chr(2)) || CASE WHEN contains(replace(z.x, '\\' || chr(10), ''), chr(10)) THEN chr(3) ELSE '' END END), ''), chr(10)) AS r
  FROM kd),
rw AS (SELECT path, ext, CAST(i AS INTEGER) AS line, m[i] AS m, coalesce(c[i], '') AS c, r[i] AS r FROM (SELECT *, unnest(range(1, len(m) + CASE WHEN m[len(m)] = '' THEN 0 ELSE 1 END)) AS i FROM ms)),
r2 AS (SELECT *, regexp_extract(m, '^\\x03?([ \\t]*)', 1) AS lead_, CASE WHEN ltrim(regexp_extract(r, '\\x03([^\\x03]*)$', 1), E' \\t\\r\\f') <> '' THEN ltrim(regexp_extract(r, '\\x03([^\\x03]*)$', 1), E' \\t\\r\\f')
  ELSE ltrim(replace(r, chr(3), ''), E' \\t\\r\\f') END AS tested FROM rw),
ln AS (SELECT path, ext, line, CAST((length(replace(lead_, chr(9), '')) + {_case(lambda x: str(x.indent), languages)} * (length(lead_) - length(replace(lead_, chr(9), '')))) // {_case(lambda x: str(x.indent), languages)} AS INTEGER) AS depth,
  len(list_filter({_case(lambda x: _list(x.imports), languages)}, lambda k: starts_with(tested, k))) > 0 AS is_import, trim(c, E' \\t\\r\\n\\f' || chr(2)) AS code FROM r2)"""


def metrics(files: str = FILES, limited: str = "", more: tuple[str, ...] = ()) -> str:
    """CTEs up to win(path, ..., chunk) and mt(path, metrics, limits, disabled, more)."""
    return lines(files) + f""", {limited or f"{_LIMITS}, fl AS ({_limited('kp')})"},
fm AS (SELECT f.path, f.ext, f.disabled, {", ".join("f." + c for c in (*DEFAULTS, *more))}, count(l.line) AS lines, count(*) FILTER (WHERE is_import) AS imports, CAST(coalesce(max(depth), 0) AS BIGINT) AS depth
  FROM fl f LEFT JOIN ln l ON l.path = f.path GROUP BY ALL),
cd AS (SELECT path, list(code ORDER BY line) AS codes, list(line ORDER BY line) AS nos FROM ln WHERE code <> '' GROUP BY path),
win AS (SELECT path, w, nos[i] AS start_line, nos[i:i + w - 1] AS line_nos, concat(w, chr(10), array_to_string(codes[i:i + w - 1], chr(10))) AS chunk
  FROM (SELECT cd.path, codes, nos, CAST(min_duplicate_lines AS BIGINT) AS w, unnest(range(1, greatest(len(codes) - CAST(min_duplicate_lines AS BIGINT) + 2, 1))) AS i FROM cd JOIN fl ON fl.path = cd.path)),
lg AS (SELECT path, chunk, count(*) AS members, min(start_line) AS first_line FROM win GROUP BY path, chunk HAVING count(*) > 1),
ll AS (SELECT path, count(DISTINCT no) AS repeated FROM (SELECT win.path, unnest(line_nos) AS no FROM win JOIN lg ON lg.path = win.path AND lg.chunk = win.chunk) GROUP BY path),
mt AS (SELECT fm.*, CASE WHEN lines > 0 THEN coalesce(repeated, 0) / lines * 100.0 ELSE 0.0 END AS repetition FROM fm LEFT JOIN ll ON ll.path = fm.path),
gg AS (SELECT chunk, count(*) AS members, min(struct_pack(path := path, line := start_line)) AS f FROM win GROUP BY chunk HAVING count(*) > 1),
gl AS (SELECT path, count(DISTINCT no) AS repeated FROM (SELECT win.path, unnest(range(start_line, start_line + w)) AS no FROM win JOIN gg ON gg.chunk = win.chunk) GROUP BY path),
gm AS (SELECT mt.* EXCLUDE (repetition), CASE WHEN repeated IS NOT NULL AND lines > 0 THEN least(repeated / lines * 100.0, 100.0) ELSE repetition END AS repetition FROM mt LEFT JOIN gl ON gl.path = mt.path),
tx AS (SELECT path, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) AS text FROM kp)"""


def _issues(source: str, severity=lambda rule: "'error'") -> str:
    return f"""SELECT path, 'max-lines' AS rule, 'File too long: ' || lines || ' lines (max ' || max_lines || ')' AS message, {severity('max-lines')} AS severity, CAST(NULL AS INTEGER) AS line FROM {source} WHERE lines > max_lines AND NOT list_contains(disabled, 'max-lines')
UNION ALL SELECT path, 'max-imports', 'Too many imports: ' || imports || ' (max ' || max_imports || ')', {severity('max-imports')}, NULL FROM {source} WHERE imports > max_imports AND NOT list_contains(disabled, 'max-imports')
UNION ALL SELECT path, 'max-repetition', printf('High code repetition: %.1f%% (max %.1f%%)', round_even(repetition, 1), round_even(max_repetition, 1)), {severity('max-repetition')}, NULL FROM {source} WHERE repetition > max_repetition AND NOT list_contains(disabled, 'max-repetition')"""


def _warned(rule: str) -> str:
    return "'warning'" if rule == "max-repetition" else "'error'"


def _depth(files: str, limit: str = "f.max_depth", severity: str = "'error'") -> str:
    return f"""SELECT l.path, 'max-depth' AS rule, 'Excessive nesting: ' || l.depth || ' levels (max ' || {limit} || ')' AS message, {severity} AS severity, line FROM ln l JOIN {files} f ON f.path = l.path WHERE l.depth > {limit} AND NOT list_contains(disabled, 'max-depth')"""


_JD = "jd AS (SELECT {m}.path, lines, count(i.rule) AS issues, coalesce(count(*) FILTER (WHERE i.severity = 'error'), 0) = 0 AS passed FROM {m} LEFT JOIN iss i ON i.path = {m}.path GROUP BY {m}.path, lines)"


def _judged(files: str = FILES) -> str:
    return metrics(files) + f""", iss AS ({_issues("mt", _warned)} UNION ALL {_depth("fl")}), """ + _JD.format(m="mt")


_JUDGED = _judged()
_CROSS = metrics() + f", iss AS ({_issues('gm', _warned)}), " + _JD.format(m="gm")
_DETAILS = """SELECT win.path, start_line AS line, array_to_string(text[start_line:start_line + w - 1], chr(10)) AS content, win.chunk FROM win JOIN {groups} USING ({key}) JOIN tx ON tx.path = win.path WHERE start_line + w <= len(text)"""


# the other places of a block, ten at most, and how many more
_OTHERS = """array_to_string(list_transform(o[1:10], lambda p: p.path || ':' || p.line), ', ') || CASE WHEN len(o) > 10 THEN ' and ' || (len(o) - 10) || ' more' ELSE '' END"""


def _details(name: str, groups: str, key: str, where: str = "true") -> str:
    """CTE of (path, line, content, o): places of repeated blocks with all other places."""
    return f"""{name}_a AS (SELECT win.path, start_line AS line, win.w, win.chunk FROM win SEMI JOIN {groups} USING ({key})),
{name}_g AS (SELECT {key}, list(struct_pack(path := path, line := line) ORDER BY path, line) AS places FROM (SELECT * FROM {name}_a) GROUP BY {key}),
{name} AS (SELECT m.path, line, array_to_string(text[line:line + w - 1], chr(10)) AS content, list_filter(places, lambda p: p.path <> m.path OR p.line <> m.line) AS o
  FROM {name}_a m JOIN {name}_g g USING ({key}) JOIN tx ON tx.path = m.path JOIN fl ON fl.path = m.path WHERE line + w <= len(text) AND {where})"""


_LOCAL = _details("dt", "lg", "path, chunk")
_LOCAL_KEPT = _details("dt", "lg", "path, chunk", "NOT list_contains(disabled, 'max-repetition')")


def _stripped(docs: bool, files: str = FILES, languages=LANGUAGES, literal: bool = False) -> str:
    doc = f"""(lc = '//' AND regexp_matches(x, '^(///|//!|/\\*\\*([^/]|\\z))'))""" if docs else "false"
    kept = f"CASE WHEN ext IN ('jsx', 'tsx') AND coalesce(starts_with(x, bo), false) THEN regexp_extract(x, '^(/\\*[\\s\\S]*?(?:\\*/|\\z))', 1) ELSE x END" if literal else "x"
    return f"""WITH {files}, tk AS (SELECT path, ext, {_case(lambda x: _strip(x, docs, literal), languages)} AS t, {_case(_line, languages)} AS lc, {_case(_open, languages)} AS bo FROM fs),
js AS (SELECT path, array_to_string(list_transform(t, lambda x: CASE WHEN ext IN ('jsx', 'tsx') AND regexp_matches(x, '^\\{{\\s*/\\*') THEN regexp_replace(regexp_extract(x, '^\\{{\\s*(/\\*[\\s\\S]*?(?:\\*/|\\z))', 1), '[^\\n]+', '', 'g')
  WHEN x[1] IN ('"', '''', '`') THEN x WHEN (coalesce(starts_with(x, bo), false) OR coalesce(starts_with(x, lc), false)) AND NOT {doc} THEN regexp_replace({kept}, '[^\\n]+', '', 'g') ELSE x END), '') AS s FROM tk)
SELECT path, {_normal("s")} AS content FROM js"""


def _normal(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[ \\t\\r\\f\\v]+(\\n|\\z)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), E' \\t\\r\\n\\f\\x0b')"


_CATALOG = ", ".join(
    f"({_s(x.name)}, {_s(e)}, {_s(x.line) if x.line else 'NULL'}, {_s(x.block[0]) if x.block else 'NULL'}, {_s(x.block[1]) if x.block else 'NULL'}, {_s(','.join(x.imports))}, {x.indent})" for x in LANGUAGES for e in x.extensions
)
_ONE = lines() + " SELECT "

# --- settings
_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
_EXCLUDE = "['node_modules', 'vendor', 'dist', 'target', '__pycache__', 'build', '.git']"
_NUMBER = {c: ("DOUBLE" if isinstance(v, float) else "BIGINT") for c, v in DEFAULTS.items()}
_SEVS = [severity_column(r) for r in RULES]


def _severity_sql(rule: str) -> str:
    return f"""coalesce(json_extract_string(b, '$.thresholds.severities."{rule}"'), json_extract_string(b, '$.thresholds.severities.{rule.replace("-", "_")}')) AS {severity_column(rule)}"""


_SETTINGS = f"""pi AS (SELECT {_CLEAN} AS path, min(file_id) AS id FROM files WHERE content IS NOT NULL AND path IS NOT NULL AND {_EXT} IN {_IN} GROUP BY 1),
pn AS (SELECT id, parts, unnest(range(0, len(parts))) AS n FROM (SELECT id, string_split(path, '/') AS parts FROM pi)),
dk AS (SELECT array_to_string(parts[1:n], '/') AS dir, min(id) % 13 AS k FROM pn GROUP BY 1),
sb AS (SELECT dir, CASE WHEN k IN ({", ".join(map(str, BROKEN))}) AND len(string_split(dir, '/')) < 3 THEN NULL ELSE CASE k {" ".join(f"WHEN {k} THEN {_s(x)}" for k, x in SETTINGS.items())} END END AS body FROM dk),
sv AS (SELECT dir, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth,
  CASE WHEN json_valid(body) THEN len(list_filter(json_keys(CASE WHEN json_valid(body) THEN body END), lambda k: k NOT IN ('$schema', 'exclude', 'thresholds', 'cross_file_repetition'))) = 0 ELSE false END AS valid, body FROM sb WHERE body IS NOT NULL),
sj AS (SELECT dir, depth, valid, CASE WHEN valid THEN body END AS b FROM sv),
sp AS (SELECT dir, CAST(depth AS INTEGER) AS depth, valid, b, CASE WHEN valid THEN coalesce(CAST(json_extract(b, '$.exclude') AS VARCHAR[]), {_EXCLUDE}) END AS exclude,
  CASE WHEN valid THEN coalesce(CAST(json_extract(b, '$.cross_file_repetition') AS BOOLEAN), false) END AS cross_file,
  {", ".join(f"nullif(CAST(json_extract_string(b, '$.thresholds.global.{c}') AS {_NUMBER[c]}), {v}) AS {c}" for c, v in DEFAULTS.items())}, {", ".join(map(_severity_sql, RULES))} FROM sj),
dd AS (SELECT DISTINCT {_DIR} AS target FROM fs),
au AS (SELECT target, array_to_string(parts[1:n], '/') AS dir FROM (SELECT target, string_split(target, '/') AS parts, unnest(range(0, CASE WHEN target = '' THEN 1 ELSE len(string_split(target, '/')) + 1 END)) AS n FROM dd)),
mg AS (SELECT target, bool_or(NOT valid) AS broken, flatten(list(exclude ORDER BY depth) FILTER (WHERE valid)) AS exclude, bool_or(cross_file) AS cross_file,
  {", ".join(f"arg_max({c}, depth) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in (*DEFAULTS, *_SEVS))} FROM au JOIN sp ON sp.dir = au.dir GROUP BY target),
ok AS (SELECT target, depth, b, unnest(json_keys(json_extract(b, '$.thresholds.overrides'))) AS oext FROM au JOIN sp ON sp.dir = au.dir WHERE valid),
ov AS (SELECT target, oext, {", ".join(f"""CAST(json_extract_string(b, '$.thresholds.overrides."' || oext || '".{c}') AS {_NUMBER[c]}) AS {c}""" for c in DEFAULTS)}
  FROM (SELECT *, row_number() OVER (PARTITION BY target, oext ORDER BY depth DESC) AS r FROM ok) WHERE r = 1)"""


def _configured(source: str) -> str:
    cols = ", ".join(f"coalesce(o.{c}, m.{c}, {v}) AS {c}" for c, v in DEFAULTS.items())
    return f"""SELECT f.*, {cols}, coalesce(m.cross_file, false) AS cross_file, {", ".join("m." + c for c in _SEVS)} FROM (SELECT *, {_KEY} AS lk, {_DIR} AS dir FROM {source}) f LEFT JOIN mg m ON m.target = f.dir
LEFT JOIN ov o ON o.target = f.dir AND o.oext = f.lk WHERE NOT coalesce(m.broken, false) AND coalesce(len(list_filter(m.exclude, lambda p: contains(f.path, p))), 0) = 0"""


_CFG = f"WITH {FILES}, {_SETTINGS} "
_CFG_JUDGED = metrics(limited=f"{_SETTINGS}, fl AS ({_configured('kp')})", more=tuple(_SEVS)) + f""", iss AS ({_issues("mt", lambda r: f"coalesce({severity_column(r)}, 'error')")} UNION ALL {_depth("fl", severity="coalesce(f.sev_max_depth, 'error')")}), """ + _JD.format(m="mt")

# --- files made for some queries
_PROSE = "fs AS (SELECT subject || '.md' AS path, 'md' AS ext, 'include ' || subject || ' % ' || subject || chr(10) || '  <!-- ' || title || chr(10) || ' --> end' || chr(10) || '    % only' || chr(10) || title AS content FROM subjects)"
_JSX_FILES = FILES.replace("fs AS (", "fo AS (") + f""", fs AS (SELECT path || '.jsx' AS path, 'jsx' AS ext, {_text("f(<a>{ /* one" + chr(10) + " two */ }</a>);" + chr(10) + "{ g(); /* c */ }" + chr(10) + "/* d */" + chr(10))} || content || {_text(chr(10) + "const b = { /* x */ y: 1 /* z */" + chr(10) + " };" + chr(10))} AS content FROM fo)"""
_EDITS = "(SELECT user_id AS uri, ts, CASE event_type WHEN 'view' THEN 'open' ELSE 'change' END AS kind FROM events)"
_TREE = os.path.dirname(os.path.abspath(plumbline.__file__))
_REPORT = """SELECT path, CASE WHEN count(*) = 1 THEN any_value(j) ELSE '[' || string_agg(j, ',' ORDER BY line, message) || ']' END AS report
FROM (SELECT path, line, message, '{"line":' || line || ',"message":' || to_json(message) || '}' AS j FROM pr) GROUP BY path"""
_PROBLEMS = _JUDGED + f""", {_LOCAL_KEPT}, pr AS (SELECT path, coalesce(line, 1) AS line, message FROM iss UNION ALL SELECT path, line, 'Duplicate found. Also in: ' || {_OTHERS} FROM dt)"""

SQL = {
    "lines_explode": _ONE + "path, line FROM ln",
    "line_count": lines() + " SELECT kp.path, count(line) AS lines FROM kp LEFT JOIN ln ON ln.path = kp.path GROUP BY kp.path",
    "line_depth": _ONE + "path, line, depth FROM ln",
    "deep_lines": _ONE + "path, line, depth FROM ln WHERE depth > 3",
    "import_count": lines() + " SELECT kp.path, count(*) FILTER (WHERE is_import) AS imports FROM kp LEFT JOIN ln ON ln.path = kp.path GROUP BY kp.path",
    "code_lines": _ONE + "path, line, code FROM ln WHERE code <> ''",
    "line_hash_groups": _ONE + "code, count(*) AS n, count(DISTINCT path) AS files FROM ln WHERE code <> '' GROUP BY code HAVING count(*) > 1",
    "windows_ngram": metrics() + " SELECT path, start_line, line_nos[len(line_nos)] AS end_line, CAST(w AS INTEGER) AS \"window\" FROM win",
    "dup_groups_file": metrics() + " SELECT path, first_line, members FROM lg",
    "dup_groups_project": metrics() + " SELECT f.path AS first_path, f.line AS first_line, members FROM gg",
    "repetition_local": metrics() + " SELECT path, round(repetition, 6) AS repetition FROM mt",
    "repetition_global": metrics() + " SELECT path, round(repetition, 6) AS repetition FROM gm",
    "duplicates_local": metrics() + f", {_LOCAL} SELECT dt.path, line, members, first_line, content FROM (SELECT dt.*, a.chunk FROM dt JOIN dt_a a USING (path, line)) dt JOIN lg ON lg.path = dt.path AND lg.chunk = dt.chunk",
    "duplicates_project": metrics() + f", {_details('dt', 'gg', 'chunk')} SELECT dt.path, line, members, f.path AS first_path, f.line AS first_line, content FROM (SELECT dt.*, a.chunk FROM dt JOIN dt_a a USING (path, line)) dt JOIN gg USING (chunk)",
    "duplicate_places": metrics() + " SELECT gg.f.path AS first_path, gg.f.line AS first_line, win.path, start_line AS line FROM win JOIN gg USING (chunk)",
    "inspect_details": metrics() + f", {_LOCAL} SELECT path, line, content, {_OTHERS} AS also_in FROM dt",
    "cross_file_details": metrics() + f", {_LOCAL}, {_details('dg', 'gg', 'chunk')} SELECT path, line, content, {_OTHERS} AS also_in FROM dt UNION ALL SELECT path, line, content, {_OTHERS} FROM dg ANTI JOIN dt USING (path, line)",
    "cross_file_report": _CROSS + " SELECT gm.path, gm.lines, gm.imports, round(gm.repetition, 6) AS repetition, issues, passed FROM gm JOIN jd ON jd.path = gm.path",
    "report_terminal": metrics() + f", {_LOCAL} SELECT path, line, array_to_string(string_split(content, chr(10))[1:3], chr(10)) AS head, {_OTHERS} AS also_in FROM dt",
    "file_metrics": metrics() + " SELECT path, ext, lines, imports, depth AS max_depth, round(repetition, 6) AS repetition FROM mt",
    "filter_supported": f"WITH {FILES} SELECT path, ext FROM fs",
    "filter_exclude": f"WITH {FILES} SELECT path FROM fs WHERE NOT regexp_matches(path, 'vendor|dist|target|node_modules|build')",
    "directive_ignore": f"WITH {DIRECTED} SELECT path, {_IGNORED} AS ignored FROM fs",
    "directive_line": f"WITH {DIRECTED}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM fs) SELECT path, CAST(line AS INTEGER) AS line FROM l WHERE contains(x, '{IGNORE_TAG}')",
    "directive_disable": f"WITH {DIRECTED} SELECT path, unnest({_WORDS}) AS rule FROM fs",
    "lang_catalog": f"SELECT * FROM (VALUES {_CATALOG}) t(name, ext, line_comment, block_open, block_close, imports, indent_size)",
    "lang_join": f"WITH {FILES} SELECT {_case(lambda x: _s(x.name))} AS language, ext, count(*) AS files FROM fs GROUP BY ALL",
    "lang_added": lines(_PROSE, [*LANGUAGES, PROSE]) + " SELECT path, line, depth, is_import, code FROM ln",
    "strip_added": _stripped(False, _PROSE, [*LANGUAGES, PROSE]),
    "thresholds_resolved": f"WITH {FILES}, {_LIMITS} SELECT path, ext, {', '.join(DEFAULTS)} FROM ({_limited('fs')})",
    "issues": metrics() + " " + _issues("mt"),
    "issues_depth": metrics() + " " + _depth("fl", "3"),
    "issues_disabled": _judged(DIRECTED) + " SELECT path, rule, severity, message, line FROM iss",
    "issues_cross_file": _CROSS + " SELECT path, rule, severity, message, line FROM iss",
    "verdicts": _JUDGED + " SELECT path, issues, passed FROM jd",
    "verdicts_directed": _judged(DIRECTED) + " SELECT path, issues, passed FROM jd",
    "project_summary": _JUDGED + " SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, coalesce(bool_and(passed), true) AS ok FROM jd",
    "gate": _JUDGED + " SELECT coalesce(bool_and(passed), true) AS ok, CASE WHEN coalesce(bool_and(passed), true) THEN 0 ELSE 1 END AS code FROM jd",
    "gate_empty": "SELECT true AS ok, 0 AS code",
    "report_ranked": _JUDGED + " SELECT path, passed, issues, lines FROM jd ORDER BY passed DESC, issues DESC, lines DESC, path",
    "report_quiet": _JUDGED + " SELECT jd.path, CASE WHEN any_value(passed) THEN 'WARNING' ELSE 'BITTER' END AS status, string_agg(message, ', ' ORDER BY coalesce(line, 0), rule, message) AS messages FROM jd JOIN iss ON iss.path = jd.path GROUP BY jd.path",
    "report_quiet_summary": _JUDGED + " SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM jd HAVING max(issues) > 0",
    "report_json": _PROBLEMS + " " + _REPORT,
    "report_json_file": _PROBLEMS + " " + _REPORT,
    "report_full": _JUDGED + f""", {_LOCAL_KEPT} SELECT mt.path, mt.lines, imports, mt.depth AS max_depth, round(repetition, 6) AS repetition, passed, issues, coalesce(n, 0) AS duplicates, coalesce(k, 0) AS deep_lines
FROM mt JOIN jd ON jd.path = mt.path LEFT JOIN (SELECT path, count(*) AS n FROM dt GROUP BY path) a ON a.path = mt.path LEFT JOIN (SELECT path, count(*) AS k FROM iss WHERE rule = 'max-depth' GROUP BY path) b ON b.path = mt.path""",
    "report_problems": _PROBLEMS + " SELECT path, line, message FROM pr",
    "lsp_diagnostics": _JUDGED + f""", {_LOCAL_KEPT} SELECT path, coalesce(line - 1, 0) AS start_line, coalesce(line - 1, 0) AS end_line, 80 AS end_column, rule, 'warning' AS severity, message, NULL AS related FROM iss UNION ALL
SELECT path, line - 1, line - 1 + CAST(len(string_split(regexp_replace(content, '\\n\\z', ''), chr(10))) AS INTEGER) - 1, 80, 'max-repetition', 'warning', 'Code duplication detected! (repeated in ' || len(o) || ' other places)', {_OTHERS} FROM dt""",
    "lsp_quickfix": _JUDGED + f" SELECT DISTINCT path, rule, coalesce({_LINE}, '//') || ' {DISABLE_TAG} ' || rule || chr(10) AS edit FROM (SELECT path, rule, {_EXT} AS ext FROM iss)",
    "lsp_root_filter": f"SELECT DISTINCT {_CLEAN} AS path FROM files WHERE path IS NOT NULL AND (starts_with({_CLEAN}, 'zelbre-matinzel/src/') OR starts_with({_CLEAN}, 'kolforol-kinnor8/') OR {_CLEAN} IN ('zelbre-matinzel/src', 'kolforol-kinnor8'))",
    "strip_aggressive": _stripped(False),
    "strip_conservative": _stripped(True),
    "strip_rewrite": _stripped(False),
    "strip_jsx": _stripped(False, _JSX_FILES),
    "strip_jsx_literal": _stripped(False, _JSX_FILES, literal=True),
    "strip_literal": f"""WITH r AS ({_stripped(False)}) SELECT fs.path, CASE WHEN {_LINE} = '//' THEN {_normal("replace(replace(replace(fs.content, chr(1), ''), chr(2), ''), chr(3), '')")} ELSE r.content END AS content FROM r JOIN (WITH {FILES} SELECT * FROM fs) fs USING (path)""",
    "normalize_ws": f"SELECT doc_id, {_normal('text')} AS text FROM (SELECT doc_id, replace(any_value(text), chr(160), ' ') AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)",
    "src_scan": lines(f"fs AS (SELECT replace(filename, {_s(_TREE + '/')}, '') AS path, 'py' AS ext, content FROM read_text({_s(_TREE + '/**/*.py')}))") + """ SELECT f.path, count(line) AS lines, count(*) FILTER (WHERE is_import) AS imports, CAST(coalesce(max(depth), 0) AS BIGINT) AS max_depth FROM kp f LEFT JOIN ln ON ln.path = f.path GROUP BY f.path""",
    "utf8_gate": f"SELECT path, k AS flawed FROM (SELECT {_CLEAN} AS path, file_id % 3 = 0 AS k, octet_length(encode(content)) AS n FROM files WHERE content IS NOT NULL AND path IS NOT NULL GROUP BY ALL) WHERE NOT k OR n + 1 >= 16384",
    "cfg_parse": _CFG + f"SELECT dir, depth, valid, array_to_string(exclude, ',') AS exclude, cross_file, {', '.join(DEFAULTS)} FROM sp",
    "cfg_resolve": _CFG + f"SELECT target AS dir, array_to_string(exclude, ',') AS exclude, cross_file, {', '.join((*DEFAULTS, *_SEVS))} FROM mg WHERE NOT broken",
    "cfg_errors": _CFG + f"SELECT sp.dir, CAST(coalesce(sum(n), 0) AS BIGINT) AS files FROM sp LEFT JOIN au ON au.dir = sp.dir LEFT JOIN (SELECT {_DIR} AS target, count(*) AS n FROM fs GROUP BY 1) c ON c.target = au.target WHERE NOT valid GROUP BY sp.dir",
    "cfg_thresholds": _CFG + f"SELECT path, ext, cross_file, {', '.join(DEFAULTS)} FROM ({_configured('fs')})",
    "cfg_verdicts": _CFG_JUDGED + " SELECT path, issues, passed FROM jd",
    "stream_debounce": "SELECT uri, ts FROM (SELECT user_id AS uri, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE n IS NULL OR n >= ts + INTERVAL 6 HOUR",
    "stream_open": f"SELECT uri, ts, kind FROM {_EDITS} WHERE kind = 'open' UNION ALL SELECT uri, ts, kind FROM (SELECT *, lead(ts) OVER (PARTITION BY uri ORDER BY ts) AS n FROM {_EDITS} WHERE kind = 'change' AND uri IS NOT NULL AND ts IS NOT NULL) WHERE n IS NULL OR n >= ts + INTERVAL 6 HOUR",
}
