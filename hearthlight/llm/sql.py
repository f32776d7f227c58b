"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: Every pair of documents that share a shingle, then the least document that links reach.
MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN k ON k.node = d.doc_id
"""

#: A window is its text; a word goes if a window over it stands in a document with a lesser id.
SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS pos, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 49], ' ') AS own FROM v),
f AS (SELECT own, min(doc_id) AS first FROM h GROUP BY own HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS i FROM h JOIN f USING (own) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

#: Escaped texts differ from plain ones by a backslash before each bar that "<" and backslashes precede.
CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n_text,
  length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_role + n_text + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _crc32(text: str) -> str:
    """Of a text of ASCII characters, byte by byte and bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    bit = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    byte = f"list_reduce([xor(crc, code), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, turn: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda crc, code: {byte}), 4294967295)"


def _tree(name: str, levels: int) -> str:
    """From ``{name}0`` (tree, idx, n, d) up: ``{name}s{k}`` has the siblings at a level, before and after."""
    out = []
    for k in range(levels):
        out.append(f"""{name}s{k} AS (SELECT tree, idx, coalesce(string_agg(d, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1
  WINDOW o AS (PARTITION BY tree, idx // 8 ORDER BY idx)),
{name}{k + 1} AS (SELECT tree, idx // 8 AS idx, (n + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY idx)) AS d FROM {name}{k} WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT * FROM {name}{k} WHERE n = 1)""")
    return ",\n".join(out)


def _way(name: str, levels: int, tree: str, idx: str) -> tuple[str, str, str]:
    """Joins of a leaf with its siblings at all levels; all siblings; the root that ``x`` leads to."""
    joins, every, folded, at = "", [], "x", idx
    for k in range(levels):
        s = f"{name}s{k}"
        joins += f"\nLEFT JOIN {s} ON {s}.tree = {tree} AND {s}.idx = {at}"
        every.append(f"coalesce({s}.l || {s}.r, '')")
        folded, at = f"CASE WHEN {s}.l IS NULL THEN {folded} ELSE sha256({s}.l || {folded} || {s}.r) END", f"{at} // 8"
    return joins, " || ".join(every), folded


def _leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    fields = [f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values]
    return f"sha256({' || '.join(fields)})"


#: Up to 8 ** 7 leaves a language and 8 ** 3 languages.
_LEAVES, _LANGS = 7, 3
_BELOW, _SIDES, _FOLD = _way("a", _LEAVES, "v.tree", "v.idx")
_ABOVE, _TOP_SIDES, _TOP_FOLD = _way("b", _LANGS, "''", "t.idx")
MERKLE = f"""
WITH v AS (SELECT doc_id, coalesce('g' || lang, '') AS tree, d, CASE WHEN doc_id IS NOT NULL AND
    {_crc32("coalesce(doc_id, 0)::VARCHAR")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE d END AS x,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, {_leaf("text")} AS d FROM documents)),
a0 AS (SELECT tree, idx, n, d FROM v),
{_tree("a", _LEAVES)},
t AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM a{_LEAVES}),
b0 AS (SELECT '' AS tree, idx, n, subroot AS d FROM t),
{_tree("b", _LANGS)},
w AS (SELECT doc_id, v.d AS leaf, subroot, {_SIDES} AS sides, {_FOLD} AS x, t.idx FROM v JOIN t ON t.tree = v.tree {_BELOW}),
z AS (SELECT doc_id, leaf, subroot, (SELECT d FROM b{_LANGS}) AS root, sides || {_TOP_SIDES} AS sides, {_TOP_FOLD} AS folded_root FROM w t {_ABOVE})
SELECT doc_id, leaf, subroot, root, sha256(sides) AS proof_sha256, folded_root, folded_root = root AS verified FROM z
"""


def _best(*candidates: str) -> str:
    return f"list_min([{', '.join(candidates)}])"


def _path(of: str, cost: str, edits: str, left: str = "''") -> str:
    return f"{{'c': {of}.c + {cost}, 't': {of}.t || {edits}, 'o': {of}.o || {left}}}"


def _turn(of: str, role: str, inserted: str = "") -> str:
    """The row as the turn of ``role``: kept or given that role, after an inserted turn or none."""
    own = f"(r = '{role[0]}')"
    before, paid, i = (f"chr(10) || '{inserted}:' || ", 5, "I") if inserted else ("", 0, "")
    return _path(
        of, f"CASE WHEN gone THEN 1000000 ELSE p + {paid} + CASE WHEN {own} THEN 0 ELSE 1 END END",
        f"CASE WHEN {own} THEN '{i}K' ELSE '{i}R' END", f"{before}chr(10) || CASE WHEN {own} THEN role ELSE '{role}' END || ':' || text",
    )


def _gone(of: str) -> str:
    return _path(of, "2", "'D'")


#: The cheapest edits after each row, for each state: nothing yet (e), after system (s), user (u), assistant (a).
REPAIR = rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM x),
f AS (SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS p,
  lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS bad FROM f),
c AS (SELECT DISTINCT conv_id FROM conversations),
v AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 't': '', 'o': ''}} AS e, {{'c': CAST(1000000 AS BIGINT), 't': '', 'o': ''}} AS s,
  {{'c': CAST(1000000 AS BIGINT), 't': '', 'o': ''}} AS u, {{'c': CAST(1000000 AS BIGINT), 't': '', 'o': ''}} AS a FROM c
  UNION ALL SELECT v.conv_id, g.i, {_gone("e")},
  {_best(_gone("s"), _path("e", "CASE WHEN gone OR r <> 's' THEN 1000000 ELSE p END", "'K'", "chr(10) || role || ':' || text"))},
  {_best(_gone("u"), *[_turn(x, "user") for x in "esa"], _turn("u", "user", "assistant"))},
  {_best(_gone("a"), _turn("u", "assistant"), *[_turn(x, "assistant", "user") for x in "esa"])}
  FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i + 1),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM g GROUP BY conv_id),
b AS (SELECT v.conv_id, {_best("e", "a", _path("u", "5", "'I'", "chr(10) || 'assistant:'"),
    _path("s", "10", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"))} AS b, n.*
  FROM v LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id WHERE v.i = coalesce(n.rows, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.t AS audit, sha256(substr(b.o, 2)) AS repaired_sha256 FROM b
"""
