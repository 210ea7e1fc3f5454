"""DuckDB SQL for the queries of queries.py, written from the operators' definitions."""

from __future__ import annotations

from jobs import evidence_report, index_documents
from jobs.common import read_config

from ..functions.paths import DEPENDENCY_DIRS, LANGUAGES, SENSITIVE_NAMES, SENSITIVE_SUFFIXES, TEST_DIRS
from ..functions.text import ENDINGS
from ..operators.graph import PATTERNS
from ..operators.judge import file_question
from ..operators.ranking import ROLES
from .paths_of_documents import EXTENSIONS, derived_path_sql
from .queries import HIT, NOW, OTHER_PATHS, QUERY, SNIFF_ROWS, TEST_PATHS

PATH, SPEC = derived_path_sql(), derived_path_sql(extension=False)


def _pieces(text: str) -> str:
    """T1 in RE2, which has no look-around: two passes put spaces where a word is cut."""
    return rf"string_split_regex(regexp_replace(regexp_replace({text}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z][A-Z])([A-Z])([^A-Z]|$)', '\1 \2\3', 'g'), '[^A-Za-z0-9]+')"


def _variants(word: str) -> str:
    without = lambda w, e: f"CASE WHEN ends_with({w}, '{e}') AND length({w}) >= {3 + len(e)} THEN left({w}, length({w}) - {len(e)}) ELSE '' END"
    base = [word, *(without(word, e) for e in ENDINGS)]
    return f"list_distinct([{', '.join([*base, *(without(b, 'e') for b in base)])}])"


def _terms(source: str, ids: str = "id") -> str:
    """(ids, term) for every occurrence, from a query with (ids, text)."""
    return f"""
      SELECT {ids}, term FROM (
        SELECT {ids}, unnest({_variants('word')}) AS term FROM (
          SELECT {ids}, lower(p) AS word FROM (SELECT {ids}, unnest({_pieces('text')}) AS p FROM ({source})) WHERE length(p) >= 2))
      WHERE term <> ''"""


def _bm25(source: str, part: str = "", query: str = QUERY) -> str:
    """CTEs ending in lex (part, id, lex) over a query with (part, id, text)."""
    p, on, group = (f"{part}, ", f"USING ({part})", f"GROUP BY {part}") if part else ("", "ON true", "")
    return f"""
    src AS ({source}),
    v AS ({_terms('SELECT * FROM src', f'{p}id')}),
    q AS (SELECT term, count(*) AS qtf FROM ({_terms(f"SELECT 0 AS id, '{query}' AS text")}) GROUP BY term),
    tf AS (SELECT {p}id, term, count(*) AS tf FROM v GROUP BY ALL),
    dl AS (SELECT {p}s.id, coalesce(n, 0) AS dl FROM src s LEFT JOIN (SELECT id, count(*) AS n FROM v GROUP BY id) USING (id)),
    st AS (SELECT {p}count(*) AS n_docs, avg(dl) AS avgdl FROM dl {group}),
    df AS (SELECT {p}term, count(*) AS df FROM tf GROUP BY ALL),
    raw AS (
      SELECT {p}dl.id, sum(coalesce(qtf * ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE
             / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / CASE WHEN avgdl > 0 THEN avgdl ELSE 1 END)), 0)) AS raw
      FROM dl JOIN st {on} LEFT JOIN (SELECT {p}id, term, tf, df, qtf FROM tf JOIN df USING ({p}term) JOIN q USING (term)) x USING ({p}id)
      GROUP BY ALL),
    top AS (SELECT {p}max(raw) AS top FROM raw {group}),
    lex AS (SELECT {p}id, CASE WHEN top > 0 THEN raw / top ELSE raw END AS lex FROM raw JOIN top {on})"""


DOCS = "SELECT doc_id AS id, text FROM documents"
TURNS = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"
BEST = f"WITH {_bm25(DOCS)}, best AS (SELECT id AS doc_id, round(lex, 6) AS score, row_number() OVER (ORDER BY round(lex, 6) DESC, id)::INT AS nth FROM lex QUALIFY nth <= 40)"

_SEGMENTS = f"(SELECT path, string_split(path, '/') AS s FROM (SELECT {PATH} AS path FROM documents))"
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)


def _allowed(hidden: bool, dependencies: bool, sensitive: bool) -> str:
    """The policy for one row (path, seg, place, n) of segments: a segment that drops the path."""
    drops = ["seg = '.git'"]
    if not hidden:
        drops.append("starts_with(seg, '.')")
    if not dependencies:
        drops.append(f"(place < n AND seg IN ({_quoted(DEPENDENCY_DIRS)}))")
    if not sensitive:
        ends = " OR ".join(f"ends_with(lower(seg), '{x}')" for x in SENSITIVE_SUFFIXES)
        drops.append(f"(lower(seg) IN ({_quoted(SENSITIVE_NAMES)}) OR starts_with(lower(seg), '.env.') OR {ends})")
    return f"NOT bool_or({' OR '.join(drops)})"


_NAME = "split_part(path, '/', -1)"
_EXT = f"CASE WHEN contains({_NAME}, '.') THEN split_part({_NAME}, '.', -1) ELSE '' END"
_STEM = f"CASE WHEN contains({_NAME}, '.') THEN left({_NAME}, length({_NAME}) - length({_EXT}) - 1) ELSE {_NAME} END"
_IS_TEST = f"""(list_has_any(string_split(lower(path), '/'), [{_quoted(TEST_DIRS)}]) OR CASE
  WHEN {_EXT} = 'py' THEN starts_with(lower({_STEM}), 'test_') OR ends_with(lower({_STEM}), '_test')
  WHEN {_EXT} = 'go' THEN ends_with(lower({_STEM}), '_test')
  WHEN {_EXT} IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'mts') THEN ends_with(lower({_STEM}), '.test') OR ends_with(lower({_STEM}), '.spec') OR ends_with(lower({_STEM}), '_test')
  ELSE ends_with({_STEM}, 'Test') OR ends_with({_STEM}, 'Tests') OR ends_with({_STEM}, 'IT') OR ends_with(lower({_STEM}), '_test') END)"""


def _clamped(text: str, n: int) -> str:
    """The longest prefix of at most n bytes: characters counted by their running bytes."""
    return f"array_to_string(list_transform(list_filter(range(1, least(length({text}), {n}) + 1), lambda i: strlen(left({text}, i)) <= {n}), lambda i: {text}[i]), '')"


#: Windows of three lines around hits (doc_id, line), merged.
_WINDOWS = """
wide AS (SELECT doc_id, greatest(line - 3, 1) AS a, least(line + 3, n_lines) AS b FROM hits JOIN n USING (doc_id)),
flag AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM wide),
isl AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM flag),
merged AS (SELECT doc_id, min(a)::INT AS start_line, max(b)::INT AS end_line FROM isl GROUP BY doc_id, k)"""

_ISLANDS = f"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
n AS (SELECT doc_id, max(line) AS n_lines FROM lines GROUP BY doc_id),
hits AS (SELECT doc_id, line FROM lines WHERE contains(lower(line_text), '{HIT}')),{_WINDOWS}"""

#: Windows, comments (kind 1) and blank lines (kind 2) that follow one another.
_BRIDGED = """
bridges AS (
  SELECT doc_id, a, b, 0 AS kind FROM wide UNION ALL SELECT doc_id, line, line, 1 FROM lines WHERE contains(line_text, 'tion')
  UNION ALL SELECT doc_id, line, line, 2 FROM lines WHERE trim(line_text, ' ') = ''),
met AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM bridges),
joined AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY a, b, kind ROWS UNBOUNDED PRECEDING) AS k FROM met)"""



def _evidence(name: str, query: str, k: int, least: float, most: int) -> str:
    """Excerpts of a question's best documents."""
    return f"""
      WITH {_bm25(DOCS, query=query)},
      best AS (SELECT id AS doc_id, round(lex, 6) AS score, row_number() OVER (ORDER BY round(lex, 6) DESC, id)::INT AS nth FROM lex WHERE lex >= {least} QUALIFY nth <= {k}),
      lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM best JOIN documents USING (doc_id)),
      n AS (SELECT doc_id, max(line) AS n_lines FROM lines GROUP BY doc_id),
      held AS ({_terms('SELECT doc_id, line, line_text AS text FROM lines', 'doc_id, line')}),
      hits AS (SELECT DISTINCT doc_id, line FROM held JOIN q USING (term)),{_WINDOWS.replace('ORDER BY a, b', 'ORDER BY a, b, line').replace('SELECT doc_id, greatest', 'SELECT doc_id, line, greatest')},
      x AS (SELECT m.*, l.line, l.line_text, sum(strlen(line_text) + 1) OVER (PARTITION BY m.doc_id, start_line ORDER BY line) AS upto FROM merged m JOIN lines l ON l.doc_id = m.doc_id AND l.line BETWEEN start_line AND end_line),
      e AS (
        SELECT doc_id, start_line, max(line)::INT AS last_line, string_agg(line_text, chr(10) ORDER BY line) AS source, max(line) < end_line AS cut
        FROM x WHERE upto <= {most} OR line = start_line GROUP BY doc_id, start_line, x.end_line)
      SELECT '{name}' AS question, nth, doc_id, score, start_line, last_line AS end_line, source, cut FROM best JOIN e USING (doc_id)"""


def _answers(name: str, query: str, k: int) -> str:
    """A question's best documents as rows of the index job's output."""
    return f"""
      WITH {_bm25(DOCS, query=query)}
      SELECT 'answers' AS part, '{name}' AS question, row_number() OVER (ORDER BY round(lex, 6) DESC, id)::INT AS nth, id AS doc_id, round(lex, 6) AS score, '' AS term, 0::BIGINT AS tf FROM lex WHERE lex > 0 QUALIFY nth <= {k}"""


def _job1(config: dict) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({_evidence(n, q, config['documents_per_question'], config['least_score'], config['excerpt_bytes'])})" for n, q in sorted(config["questions"].items()))


def _job2(config: dict) -> str:
    index = f"SELECT 'index' AS part, '' AS question, 0::INT AS nth, id AS doc_id, 0.0::DOUBLE AS score, term, count(*) AS tf FROM ({_terms(DOCS)}) GROUP BY ALL"
    return " UNION ALL ".join([index, *(f"SELECT * FROM ({_answers(n, q, config['documents_per_question'])})" for n, q in sorted(config["questions"].items()))])


_CALLS = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line FROM documents),
n AS (SELECT doc_id, max(line)::INT AS n_lines FROM lines GROUP BY doc_id),
spaced AS (SELECT doc_id, line, replace(line_text, ' ', '(') AS t FROM lines),
defs AS (SELECT doc_id, line AS d_idx, regexp_extract(regexp_extract(t, '^([^(]+)', 1), '([^.:]+)$', 1) AS called, regexp_extract(t, '^([^(]+)', 1) AS name FROM spaced),
called AS (
  SELECT d.doc_id, d_idx, called, s.line FROM defs d JOIN spaced s ON s.doc_id = d.doc_id AND contains(s.t, called || '(')
  WHERE called <> '' AND NOT ends_with(name, '.context') AND name <> 'source')"""
_ISLANDS_OF_LINES = f"hits AS (SELECT doc_id, line FROM spaced WHERE contains(lower(t), '{HIT}')),{_WINDOWS.replace('ORDER BY a, b', 'ORDER BY a, b, line').replace('SELECT doc_id, greatest', 'SELECT doc_id, line, greatest')}"


def _specifiers() -> str:
    """The patterns line by line (Go's over the whole text), the first group that matches, distinct in order."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    group = lambda p, x: f"coalesce({', '.join(f'nullif(regexp_extract({x}, {q(p)}, {i + 1}), {chr(39) * 2})' for i in range(p.count('(') - p.count('(?') - p.count(chr(92) + '(')))}, '')"
    langs = " ".join(f"WHEN {_EXT} IN ({_quoted(LANGUAGES[n])}) THEN flatten(list_transform(ls, lambda x: [{', '.join(group(p, 'x') for p in ps)}]))" for n, ps in PATTERNS.items() if n in LANGUAGES)
    return f"""
      WITH d AS (SELECT doc_id, {PATH} AS path, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 2 = 1 THEN 'import ' || x ELSE 'import "' || array_to_string(string_split(x, ' ')[1:2], ' ') || '"' END)[1:400] AS ls FROM documents),
      f AS (
        SELECT doc_id, list_filter(CASE WHEN {_EXT} = 'go' THEN list_concat(regexp_extract_all(array_to_string(ls, chr(10)), '(?m)^import\\s+(?:[\\w.]+\\s+)?"([^"]+)"', 1), flatten(list_transform(regexp_extract_all(array_to_string(ls, chr(10)), '(?ms)^import\\s*\\((.*?)^\\s*\\)', 1), lambda b: regexp_extract_all(b, '"([^"]+)"', 1)))) {langs} ELSE [] END, lambda x: x <> '') AS found FROM d),
      e AS (SELECT doc_id, unnest(found) AS spec, unnest(range(len(found))) AS i FROM f),
      u AS (SELECT doc_id, spec, min(i) AS i FROM e GROUP BY ALL)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS nth, spec FROM u QUALIFY nth < 24"""


def _candidates() -> str:
    """P4 for the languages that the derived paths have."""
    joined = lambda base, name: f"CASE WHEN {base} = '' THEN {name} ELSE {base} || '/' || {name} END"
    forms = lambda base, ends: ", ".join(f"{base} || '{e}'" for e in ends)
    py = (".py", ".pyi", "/__init__.py")
    flat = lambda x: f"array_to_string(list_reduce(list_prepend(''::VARCHAR, list_filter(string_split({x}, '/'), lambda s: s NOT IN ('', '.'))), lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN s ELSE a || '/' || s END).string_split('/'), '/')"
    js = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
    rust = "flatten(list_transform(range(len(parts), 0, -1), lambda n: [{0} || '.rs', {0} || '/mod.rs']))".format("(" + joined("root", "array_to_string(parts[1:n], '/')") + ")")
    return f"""
      WITH d AS (SELECT DISTINCT doc_id, {PATH} AS path, unnest(string_split(string_split(text, chr(10))[1], ' ')) AS spec FROM documents),
      p AS (SELECT *, {_EXT} AS ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS here, length(regexp_extract(spec, '^(\\.*)', 1)) AS dots, replace(regexp_replace(spec, '^\\.+', ''), '.', '/') AS rest, replace(spec, '.', '/') AS dotted FROM d),
      b AS (
        SELECT *, array_to_string(string_split(here, '/')[1:greatest(len(string_split(here, '/')) - (dots - 1), 0)], '/') AS base, list_filter(string_split(regexp_replace(spec, '^(crate|self|super)::', ''), '::'), lambda x: x <> '') AS parts,
               CASE WHEN starts_with(spec, 'crate::') THEN CASE WHEN contains(path, 'src/') THEN regexp_extract(path, '^(.*?src)/', 1) ELSE 'src' END WHEN starts_with(spec, 'super::') THEN array_to_string(string_split(here, '/')[1:len(string_split(here, '/')) - 1], '/') ELSE here END AS root,
               {flat("here || '/' || spec")} AS at_here FROM p),
      r AS (SELECT *, CASE WHEN rest = '' THEN base ELSE {joined('base', 'rest')} END AS relative, {joined('here', 'rest')} AS local, regexp_replace(at_here, '\\.[mc]?jsx?$', '') AS bare FROM b)
      SELECT doc_id, spec, array_to_string(CASE
        WHEN ext = 'py' AND dots > 0 THEN [{forms('relative', py)}]
        WHEN ext = 'py' THEN [{forms('rest', py)}, {forms("'src/' || rest", py)}, {forms('local', py)}]
        WHEN ext = 'ts' AND starts_with(spec, '.') THEN [{forms('at_here', js)}, {forms('bare', ('.ts', '.tsx'))}]
        WHEN ext = 'rs' THEN {rust}
        WHEN ext = 'java' THEN [{', '.join(f"'{x}' || dotted || '.java'" for x in ('src/main/java/', 'src/test/java/', 'src/', ''))}]
        WHEN ext = 'kt' THEN [{', '.join(f"'{x}' || dotted || '{e}'" for x in ('src/main/kotlin/', 'src/main/java/', 'src/test/kotlin/', 'src/', '') for e in ('.kt', '.java'))}]
        WHEN ext = 'cpp' THEN [at_here, {flat('spec')}, {flat("'include/' || spec")}, {flat("'src/' || spec")}]
        ELSE [] END, ' ') AS candidates FROM r"""


_EVENTS = "SELECT user_id::VARCHAR || ':' || event_type AS key, * FROM events"

ORACLES = {
    "tokenize_terms": f"SELECT id AS doc_id, term, count(*) AS tf FROM ({_terms(DOCS)}) GROUP BY ALL",
    "bm25_stats": f"SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 6) AS idf FROM (SELECT DISTINCT id, term FROM ({_terms(DOCS)})) GROUP BY term",
    "bm25_scores": f"WITH {_bm25(DOCS)} SELECT id AS doc_id, round(lex, 6) AS lex FROM lex",
    "bm25_topk": f"{BEST} SELECT doc_id, score, nth FROM best",
    "bm25_indexed": f"{BEST} SELECT doc_id, score, nth FROM best",
    "bm25_pages": f"WITH {_bm25('SELECT page_id AS id, html AS text FROM pages')} SELECT id AS page_id, round(lex, 6) AS lex FROM lex",
    "bm25_turns": f"WITH {_bm25(TURNS)} SELECT id AS turn_id, round(lex, 6) AS lex FROM lex",
    "bm25_partitioned": f"WITH {_bm25('SELECT conv_id, conv_id * 1000 + turn AS id, text FROM conversations', 'conv_id')} SELECT conv_id, id AS turn_id, round(lex, 6) AS lex FROM lex QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(lex, 6) DESC, id) <= 3",
    "lexical_prefilter": f"WITH {_bm25(DOCS)} SELECT id AS doc_id, round(lex, 6) AS lex, lex >= 0.06 AS passes FROM lex WHERE lex > 0.02",
    "policy_filter": f"""SELECT path, {_allowed(False, False, False)} AS default_policy, {_allowed(True, False, False)} AS with_hidden, {_allowed(True, True, False)} AS with_dependencies, {_allowed(True, True, True)} AS with_all
      FROM (SELECT path, unnest(s) AS seg, unnest(range(1, len(s) + 1)) AS place, len(s) AS n FROM {_SEGMENTS}) GROUP BY path""",
    "language_of_path": f"SELECT path, CASE {' '.join(f'WHEN {_EXT} IN ({_quoted(exts)}) THEN {lang!r}' for lang, exts in LANGUAGES.items())} ELSE 'text' END AS language FROM (SELECT {PATH} AS path FROM documents)",
    "test_path_classify": f"SELECT path, {_IS_TEST} AS is_test FROM (SELECT {PATH} AS path FROM documents UNION ALL SELECT unnest([{_quoted((*TEST_PATHS, *OTHER_PATHS))}]))",
    "describe_documents": f"""
      WITH d AS (SELECT {PATH} AS path, text, string_split(text, chr(10)) AS ls FROM documents),
      l AS (SELECT path, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM d),
      nb AS (SELECT path, trim(x, ' ') AS x, i, row_number() OVER (PARTITION BY path ORDER BY i) AS k FROM l WHERE trim(x, ' ') <> '' QUALIFY k <= 40),
      bare AS (SELECT path, i, trim(regexp_replace(x, '^/*\\**#*!*', ''), ' ') AS b FROM nb WHERE strlen(x) > 6),
      head AS (SELECT path, left(arg_min(b, i), 120) AS h FROM bare WHERE NOT regexp_matches(lower(b), 'licen[sc]e|copyright') AND regexp_matches(b, '\\pL') GROUP BY path),
      o AS (SELECT d.path, 'File: ' || d.path || ' (' || len(ls) || ' lines)' || chr(10) || CASE WHEN coalesce(h, '') <> '' THEN 'Header: ' || h ELSE 'Content: ' || replace(left(text, 200), chr(10), ' ') END AS s FROM d LEFT JOIN head USING (path))
      SELECT path, CASE WHEN strlen(s) <= 600 THEN s ELSE {_clamped('s', 600)} END AS description FROM o""",
    "clamp_bytes": f"WITH o AS (SELECT doc_id, trim(translate(text, chr(13) || chr(10), '  '), ' ') AS s FROM documents), c AS (SELECT doc_id, CASE WHEN strlen(s) <= 100 THEN s ELSE {_clamped('s', 100)} END AS clamped FROM o) SELECT doc_id, clamped, strlen(clamped)::INT AS n_bytes FROM c",
    "path_ancestors": f"SELECT DISTINCT array_to_string(s[1:i], '/') AS dir FROM (SELECT s, unnest(range(len(s))) AS i FROM {_SEGMENTS})",
    "content_hash_dups": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "binary_sniff": f"""
      SELECT doc_id, CASE WHEN regexp_matches(left(text, 8192), '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]') THEN 'excluded' ELSE 'ok' END AS status, CASE WHEN regexp_matches(left(text, 8192), '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]') THEN 'binary' END AS reason FROM documents
      UNION ALL SELECT * FROM (VALUES {', '.join(f"({k}, '{'excluded' if h[2:] in ('00', '1b', '7f', 'ff') else 'ok'}', {repr({'00': 'binary', '1b': 'binary', '7f': 'binary', 'ff': 'invalid_utf8'}.get(h[2:])) if h[2:] in ('00', '1b', '7f', 'ff') else 'NULL'})" for k, h in SNIFF_ROWS.items())})""",
    "import_edges": f"""
      WITH d AS (SELECT doc_id, {PATH} AS path, {SPEC} AS spec FROM documents),
      c AS (SELECT a.path AS importer, b.spec || '.' || e AS cand, i FROM d a JOIN d b ON b.doc_id = a.doc_id // 2, (SELECT unnest([{_quoted(EXTENSIONS)}]) AS e, unnest(range({len(EXTENSIONS)})) AS i))
      SELECT importer, arg_min(cand, i) AS importee FROM c JOIN d ON d.path = c.cand WHERE cand <> importer GROUP BY importer""",
    "propagate_scores": f"""
      WITH {_bm25(TURNS)},
      r1 AS (SELECT a.id, CASE WHEN b.lex * 0.75 > a.lex + 1e-9 THEN b.lex * 0.75 ELSE a.lex END AS lex FROM lex a LEFT JOIN lex b ON b.id = a.id + 1),
      r2 AS (SELECT a.id, CASE WHEN b.lex * 0.75 > a.lex + 1e-9 THEN b.lex * 0.75 ELSE a.lex END AS lex FROM r1 a LEFT JOIN r1 b ON b.id = a.id + 1)
      SELECT id AS turn_id, round(lex, 6) AS lex FROM r2""",
    "blend_topk": f"""
      WITH {_bm25(DOCS)}, j AS (SELECT id, lex, (contains(text, 'heat')::INT + contains(text, 'tion')::INT) / 2.0::DOUBLE AS sem FROM lex JOIN src USING (id)),
      b AS (SELECT id, round(0.7::DOUBLE * lex + 0.3::DOUBLE * sem, 6) AS score FROM j WHERE lex >= 0.06 AND sem >= 0.3)
      SELECT id AS doc_id, score, score >= 0.25 AS strong, row_number() OVER (ORDER BY score DESC, id)::INT AS nth FROM b QUALIFY nth <= 40""",
    "line_hits_merge": f"WITH {_ISLANDS} SELECT * FROM merged",
    "excerpt_cap": f"""
      WITH {_ISLANDS},
      x AS (SELECT m.*, l.line, l.line_text, sum(strlen(line_text) + 1) OVER (PARTITION BY m.doc_id, start_line ORDER BY line) AS upto FROM merged m JOIN lines l ON l.doc_id = m.doc_id AND l.line BETWEEN start_line AND end_line)
      SELECT doc_id, start_line, max(line)::INT AS end_line, sha256(string_agg(line_text, chr(10) ORDER BY line)) AS source_hash, max(line) < end_line AS cut
      FROM x WHERE upto <= 1500 OR line = start_line GROUP BY doc_id, start_line, x.end_line""",
    "unit_pack": """
      WITH RECURSIVE u AS (SELECT conv_id, turn, strlen(text) + 140 AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
      f AS (
        SELECT conv_id, turn, k, 0 AS g, 1 AS n, b AS bytes FROM u WHERE k = 1
        UNION ALL
        SELECT u.conv_id, u.turn, u.k, CASE WHEN n < 2 AND bytes + b <= 380 THEN g ELSE g + 1 END, CASE WHEN n < 2 AND bytes + b <= 380 THEN n + 1 ELSE 1 END, CASE WHEN n < 2 AND bytes + b <= 380 THEN bytes + b ELSE b END
        FROM f JOIN u ON u.conv_id = f.conv_id AND u.k = f.k + 1)
      SELECT conv_id, turn::INT AS turn, g::INT AS group_idx FROM f""",
    "lead_dedup": "SELECT user_id, event_type AS name, day(ts)::INT AS start_line, round(max(value), 6) AS score FROM events GROUP BY ALL",
    "phrase_contains_join": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, left(b.text, 40))",
    "range_join_innermost": f"WITH {_ISLANDS} SELECT doc_id, line::INT AS line, 'u' || ((line - 1) // 5)::INT AS unit FROM hits",
    "role_labels": f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN (doc_id * {2 * k + 3} % 101) / 100.0 > 0.65 THEN {r!r} END' for k, r in enumerate(ROLES))}], lambda x: x IS NOT NULL), ',') AS roles FROM documents",
    "budget_fold": f"""
      {BEST.replace('WITH', 'WITH RECURSIVE', 1)}, x AS (SELECT b.doc_id, nth, strlen(text)::BIGINT AS bytes FROM best b JOIN documents d ON d.doc_id = b.doc_id),
      f AS (
        SELECT doc_id, nth, bytes, bytes <= 20000 AS kept, CASE WHEN bytes <= 20000 THEN 20000 - bytes ELSE 20000 END AS room FROM x WHERE nth = 1
        UNION ALL SELECT x.doc_id, x.nth, x.bytes, x.bytes <= room, CASE WHEN x.bytes <= room THEN room - x.bytes ELSE room END FROM f JOIN x ON x.nth = f.nth + 1)
      SELECT doc_id, nth, bytes, kept FROM f""",
    "cache_lookup": f"""
      WITH c AS ({_EVENTS}), l AS (SELECT key, arg_max(value, (ts, event_id)) AS v FROM c WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY key)
      SELECT k.key, v IS NOT NULL AS hit, round(v, 6) AS answer FROM (SELECT DISTINCT key FROM c) k LEFT JOIN l ON l.key = k.key""",
    "cache_evict": "SELECT event_id FROM (SELECT event_id, sum(strlen(props)) OVER (ORDER BY ts DESC, event_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS upto FROM events) WHERE upto <= (SELECT sum(strlen(props)) // 2 FROM events)",
    "issue_counts": "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1",
    "run_status": "SELECT user_id, CASE WHEN coalesce(max(value) > 400, false) THEN 'interrupted' WHEN count(*) FILTER (WHERE value < 1) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM events GROUP BY user_id",
    "grouped_order": f"{BEST}, p AS (SELECT {PATH} AS path, score FROM best JOIN documents USING (doc_id)) SELECT path, score, {_IS_TEST} AS is_test, row_number() OVER (ORDER BY {_IS_TEST}, score DESC, path)::INT AS nth FROM p",
    "text_chunks": """
      WITH RECURSIVE d AS (
        SELECT doc_id, encode(text) AS data, strlen(text) AS size, list_transform(range(1, len(l)), lambda i: list_sum(list_transform(l[:i], lambda x: strlen(x) + 1))::BIGINT) AS ends
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')),
      f AS (
        SELECT doc_id, -1 AS unit_idx, 0::BIGINT AS a, 0::BIGINT AS z FROM d
        UNION ALL
        SELECT doc_id, unit_idx + 1, z, CASE WHEN whole < size THEN coalesce(list_max(list_filter(ends, lambda x: x > z + 1 AND x <= whole)), whole) ELSE size END
        FROM (
          SELECT f.doc_id, unit_idx, z, size, ends,
                 least(size, z + 2500 + coalesce(list_position(list_transform(range(1, 5), lambda i: hex(data[z + 2500 + i:z + 2500 + i]) NOT BETWEEN '80' AND 'BF'), true), 1) - 1) AS whole
          FROM f JOIN d ON d.doc_id = f.doc_id WHERE z < size)),
      c AS (SELECT f.doc_id, unit_idx, a, z, ends, 1 + len(list_filter(ends, lambda x: x <= a)) AS start_line, len(list_filter(ends, lambda x: x > a AND x < z)) AS inner_ends FROM f JOIN d ON d.doc_id = f.doc_id WHERE unit_idx >= 0)
      SELECT doc_id, unit_idx::INT AS unit_idx, start_line::INT AS start_line, (start_line + inner_ends)::INT AS end_line, a::INT AS byte_start, z::INT AS byte_end FROM c""",
    "json_report": f"""
      {BEST}, p AS (SELECT {PATH} AS path, score, text FROM best JOIN documents USING (doc_id))
      SELECT path, to_json(struct_pack(
        path := path, score := round(score, 4), "testFile" := {_IS_TEST}, priority := NULL::INT, roles := []::VARCHAR[], leads := []::VARCHAR[], "callLeads" := []::VARCHAR[],
        excerpts := [struct_pack("startLine" := 1, "endLine" := len(string_split(text, chr(10))), source := text)], "sourceOmitted" := false))::VARCHAR AS json FROM p""",
    "quote_and_shell": """
      SELECT doc_id, to_json(regexp_replace(text, '[\\x{7F}-\\x{9F}\\x{2028}-\\x{202E}\\x{2066}-\\x{2069}]', '', 'g'))::VARCHAR AS quoted, '''' || replace(text, '''', '''\\''''') || '''' AS arg,
             repeat('`', greatest(coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1, 3)) AS fence FROM documents""",
    "contained_units": f"""
      WITH {_ISLANDS}, u AS (SELECT doc_id, unnest(range(1, n_lines + 1)) AS a FROM n)
      SELECT doc_id, a::INT AS start_line FROM u WHERE EXISTS (SELECT 1 FROM merged m WHERE m.doc_id = u.doc_id AND u.a >= m.start_line AND u.a + 4 <= m.end_line)""",
    "commented_windows": f"WITH {_ISLANDS},{_BRIDGED} SELECT doc_id, (min(a) FILTER (WHERE kind < 2))::INT AS start_line, (max(b) FILTER (WHERE kind < 2))::INT AS end_line FROM joined GROUP BY doc_id, k HAVING min(kind) = 0",
    "cache_keys": f"""
      SELECT doc_id, sha256('{{"schema":1,"namespace":"terms-1","state":' || to_json(text)::VARCHAR || ',"questions":[{{"qid":"relevant","instructions":' || to_json('{file_question(QUERY)}')::VARCHAR || '}}]}}') AS key FROM documents""",
    "weak_leads": "SELECT conv_id, 'u' || turn::VARCHAR AS name, turn, 0.0::DOUBLE AS score FROM conversations WHERE turn % 4 > 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2",
    "nested_leads": "SELECT user_id, string_agg(event_type || '@' || d::VARCHAR, ' ' ORDER BY d, event_type) AS leads FROM (SELECT DISTINCT user_id, event_type, day(ts)::INT AS d FROM events) GROUP BY user_id",
    "state_headers": f"SELECT doc_id, 'Query: {QUERY} now' || chr(10) || text AS state, round(n_chars / 7.0::DOUBLE, 4) AS seventh FROM documents",
    "unit_calls": f"""
      WITH {_CALLS}, u AS (SELECT d.doc_id, d_idx AS s, least(d_idx + 2, n_lines) AS e, name FROM defs d JOIN n ON n.doc_id = d.doc_id),
      c AS (
        SELECT u.doc_id, u.s, list_sort(list_distinct(list((d.d_idx, d.called)))) AS found
        FROM u JOIN called d ON d.doc_id = u.doc_id AND d.line BETWEEN u.s AND u.e JOIN n ON n.doc_id = u.doc_id WHERE NOT (d.d_idx >= u.s AND least(d.d_idx + 2, n_lines) <= u.e) GROUP BY ALL),
      b AS (SELECT u.*, list(t ORDER BY line) AS body FROM u JOIN spaced ON spaced.doc_id = u.doc_id AND line BETWEEN s AND e GROUP BY ALL),
      h AS (SELECT *, name || ' (lines ' || s || '-' || e || '): ' || left(CASE WHEN trim(body[1], ' ') <> '' THEN trim(body[1], ' ') ELSE coalesce(trim(body[2], ' '), '') END, 70) AS head FROM b),
      o AS (
        SELECT *, left(list_filter(list_transform(list_filter(body, lambda x: regexp_matches(trim(x, ' '), '^(///|/\\*\\*|#|""\")')), lambda x: trim(regexp_replace(trim(x, ' '), '^[/*"#\\s]+|[/*"#\\s]+$', '', 'g'), ' ')), lambda x: regexp_matches(x, '\\pL'))[1], 90) AS doc FROM h)
      SELECT o.doc_id, o.s AS line, concat_ws(' | ', head, CASE WHEN strlen(head) < 60 THEN doc END, 'calls ' || array_to_string(list_transform(found[1:4], lambda x: x[2]), ', ')) AS description
      FROM o LEFT JOIN c ON c.doc_id = o.doc_id AND c.s = o.s""",
    "call_leads": f"""
      WITH {_CALLS}, {_ISLANDS_OF_LINES},
      met AS (SELECT DISTINCT d.doc_id, called, d.line FROM called d JOIN n ON n.doc_id = d.doc_id JOIN merged m ON m.doc_id = d.doc_id AND d.line BETWEEN m.start_line AND m.end_line WHERE NOT d.line BETWEEN d_idx AND least(d_idx + 2, n_lines))
      SELECT DISTINCT met.doc_id, defs.name AS caller, met.called AS name, met.line FROM met JOIN defs ON defs.doc_id = met.doc_id AND defs.d_idx = met.line""",
    "answer_validity": "SELECT event_id, coalesce(event_id % 3 <> 0 AND value / 500 BETWEEN 0 AND 1, false) AS valid FROM events",
    "import_specifiers": _specifiers(),
    "specifier_candidates": _candidates(),
    "calls_by_endings": """
      WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line FROM documents),
      spaced AS (SELECT doc_id, line, replace(t, ' ', '(') AS t FROM lines),
      defs AS (SELECT doc_id, line AS d_idx, regexp_extract(regexp_extract(t, '^([^(]+)', 1), '([^.:]+)$', 1) AS called, regexp_extract(t, '^([^(]+)', 1) AS name FROM spaced)
      SELECT d.doc_id, d_idx, called, s.line FROM defs d JOIN spaced s ON s.doc_id = d.doc_id AND contains(s.t, called || '(') WHERE called <> '' AND NOT ends_with(name, '.context') AND name <> 'source'""",
    "job1_evidence_report": _job1(read_config(None, evidence_report.CONFIG)),
    "job2_index_documents": _job2(read_config(None, index_documents.CONFIG)),
}
