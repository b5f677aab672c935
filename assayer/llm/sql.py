"""DuckDB SQL of those queries that SQL can express on whole tables."""

from __future__ import annotations

from assayer.llm.quality import BOILERPLATE, BOILERPLATE_WORDS, LOST, SEPARATOR_SHARE, SYMBOL_SHARE

_LOW = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top, count(*) AS many FROM p GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND many > 1 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND many > 1 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p JOIN g USING (h)"""


def _chars(t: str) -> str:
    return f"length(regexp_replace({t}, '{_GAP}', '', 'g'))"


_FAILS = (
    f"(length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) > {SYMBOL_SHARE}::DOUBLE * {_chars('l')} OR "
    f"len(list_filter(regexp_extract_all(l, '{_SPACE}'), lambda w: regexp_matches(w, '^[|>»•·/-]+$'))) >= {SEPARATOR_SHARE}::DOUBLE * len(regexp_extract_all(l, '{_SPACE}')) OR "
    f"(len(regexp_extract_all(l, '{_SPACE}')) <= {BOILERPLATE_WORDS} AND regexp_matches(l, '(?i){'|'.join(BOILERPLATE)}')))"
)

OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_SPACE}')) AS lines FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM k) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, {_chars('t')}::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  list_sum(list_transform(list_filter(lines, lambda l: NOT {_FAILS}), lambda l: {_chars('l')})) AS kept_chars
  FROM d LEFT JOIN n USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 1 - coalesce(kept_chars, 0) / word_chars::DOUBLE <= {LOST}::DOUBLE AS kept FROM f"""

OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format(t="coalesce(text, '')")}, '{_SPACE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g, least(3, len(w)) AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT c.node, u.b FROM c JOIN u ON c.seen = u.a)
SELECT node AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(seen) AS component_id, min(seen) = node AS kept
FROM c LEFT JOIN n ON n.doc_id = node GROUP BY node, n"""

_WINDOWS = "unnest(range(1, len(w) - {n} + 2))"
OP6 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format(t="coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW.format(t="coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS n, {_WINDOWS.format(n='least(13, len(w))')} AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, {_WINDOWS.format(n='n')} AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

# --- op11: a list of the four states' best (cost in nine digits, then the audit) goes from turn to turn


def _add(state: str, cost: str, letters: str) -> str:
    return f"lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letters}'"


def _step(a: str, turn: str) -> str:
    """The states after a turn; insertions stand before it, one at most, as two lead to where none does."""
    at = [f"{a}[{k}]" for k in range(1, 5)]
    ins = lambda k: f"({_add(at[k], '3', 'I')})"
    before = [[at[0]], [at[1]], [at[2], ins(0), ins(1), ins(3)], [at[3], ins(2)]]
    low, extra = f"lower({turn})", f"(CASE WHEN {turn} = 'd' OR {turn} = lower({turn}) THEN 0 ELSE 3 END)"

    def to(role: str, froms: list[int], reroled: bool) -> list[str]:
        keep = [f"CASE WHEN {low} = '{role}' THEN {_add(s, extra, 'K')} END" for k in froms for s in before[k]]
        return keep + [f"CASE WHEN {low} NOT IN ('d', '{role}') THEN {_add(s, f'3 + {extra}', 'R')} END" for k in froms for s in before[k] if reroled]

    moves = [[], to("s", [0], False), to("u", [0, 1, 3], True), to("a", [2], True)]
    return "[" + ", ".join(f"list_min([{', '.join([_add(s, '4', 'D') for s in before[k]] + moves[k])}])" for k in range(4)) + "]"


_BYTE = "list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT)), lambda a, b: {_BYTE}), 4294967295::BIGINT)"
_TURN = "turn NULLS FIRST, role, text"
OP11 = f"""WITH k AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, {_CRC} % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS c FROM h WHERE h <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY {_TURN}, c) AS rn, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY {_TURN}, c) AS was,
  CASE WHEN NOT regexp_matches(text, '{_SPACE}') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' END AS fault FROM d),
l AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN 'd' ELSE CASE WHEN fault = 't' THEN upper(i) ELSE i END END AS letter
  FROM (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS i FROM o)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (was IS NOT NULL AND was || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
  list(letter ORDER BY rn) AS letters, list(role ORDER BY rn) AS roles, list(text ORDER BY rn) AS texts FROM l GROUP BY conv_id),
s AS (SELECT *, list_reduce(list_concat([['000000000', NULL, NULL, NULL]], list_transform(letters, lambda x: [x])), lambda a, b: {_step('a', 'b[1]')}) AS z FROM g),
e AS (SELECT *, list_min([z[1], z[4], {_add('z[3]', '3', 'I')}, {_add('z[2]', '6', 'II')}]) AS best FROM s),
u AS (SELECT *, string_split(substr(best, 10), '') AS edits, left(best, 9)::BIGINT AS cost FROM e),
p AS (SELECT *, list_filter(list_transform(range(1, len(edits) + 1), lambda i: {{'e': edits[i], 'row': len(list_filter(edits[:i], lambda x: x <> 'I')), 'place': len(list_filter(edits[:i], lambda x: x <> 'D'))}}), lambda x: x.e NOT IN ('D', '')) AS kept FROM u),
r AS (SELECT *, CASE WHEN len(kept) > 0 AND kept[1].e = 'K' AND left(roles[kept[1].row], 1) = 's' THEN 1 ELSE 0 END AS system FROM p),
f AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, substr(best, 10) AS audit, sha256(coalesce(array_to_string(list_transform(kept, lambda x:
  (CASE WHEN x.e = 'K' THEN roles[x.row] WHEN (x.place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN x.e = 'I' THEN '' ELSE texts[x.row] END)), chr(10)), '')) AS sha FROM r)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id"""

OP12 = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOW.format(t="coalesce(text, '')")} AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
x AS (SELECT lang, w, i, k FROM o, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
g AS (SELECT lang, w[i:i + k - 1] AS ws, k, count(*) AS f FROM x GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 30),
q AS (SELECT lang, ws, f AS a, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT q.*, l.f AS l, r.f AS r, (2000000 * a::HUGEINT) // (l.f + r.f) AS score FROM q JOIN g l ON l.lang = q.lang AND l.ws = q.ws[1:cut] JOIN g r ON r.lang = q.lang AND r.ws = q.ws[cut + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
m AS (SELECT lang, ws[i:i + j - 1] AS ws, max(f) AS f FROM (SELECT lang, ws, f, k, j, unnest(range(1, k - j + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS j) WHERE j < k) GROUP BY ALL),
t AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN m ON m.lang = b.lang AND m.ws = b.ws WHERE m.f IS NULL OR 100 * m.f < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM t JOIN n USING (lang) QUALIFY rank <= 2000"""

SQL = {
    "op1_warc": OP1, "op2_quality_rules": OP2, "op3_minhash_near_dedup": OP3, "op6_benchmark_decontamination": OP6,
    "op11_conversation_repair": OP11,
    "op12_phrase_collocations": OP12,
}
