"""SQL twins of the corpus queries, in DuckDB's dialect."""

from __future__ import annotations

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _spans(kind: str, pattern: str, valid: str, score: str, floor: float = 0.5) -> str:
    """Spans of one kind: gaps between the matches give the places."""
    return f"""
{kind}_m AS (
  SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}')),
{kind}_u AS (
  SELECT doc_id, m[k] AS m, list_sum([len(x) FOR x IN g[1:k]])::BIGINT + coalesce(list_sum([len(x) FOR x IN m[1:k - 1]]), 0)::BIGINT AS s,
         lower(right(g[k], 40) || ' ' || left(g[k + 1], 20)) AS near
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM {kind}_m)),
{kind}_s AS (
  SELECT doc_id, m, s, s + len(m) AS e, least(1.0, {score})::DOUBLE AS score FROM {kind}_u WHERE {valid} AND {score} >= {floor})"""


def _personal_data() -> str:
    near = lambda base, words: f"({base} + CASE WHEN regexp_matches(near, '{words}') THEN 0.3 ELSE 0 END)"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (
        f"(list_sum(list_transform(string_split(reverse({digits}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT"
        f" WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0)"
    )
    plain = "replace(m, ' ', '')"
    mod97 = (
        f"list_reduce(list_prepend(0, list_transform(string_split({plain}[5:] || {plain}[:4], ''),"
        f" lambda x: CASE WHEN ascii(x) < 58 THEN ascii(x) - 48 ELSE ascii(x) - 55 END)),"
        f" lambda a, n: (a * CASE WHEN n < 10 THEN 10 ELSE 100 END + n) % 97) = 1"
    )
    kinds = {
        "email": _spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", near(0.9, "mail|contact")),
        "ip": _spans("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS BIGINT), 256) > 255)) = 0", near(0.6, r"\bip\b|address|host|server")),
        "card": _spans("card", r"[0-9](?:[\x20-]?[0-9])+", f"len({digits}) BETWEEN 13 AND 19 AND {luhn}", near(0.8, "card|visa|credit|karte|carte|tarjeta")),
        "phone": _spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({digits}) BETWEEN 9 AND 15", near(0.7, "phone|call|tel|mobile")),
        "iban": _spans("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", mod97, near(0.7, "iban|bank|account|konto|compte|cuenta")),
        "national_id": _spans("national_id", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(m, '^(?:000|666|9)|^...-00|0000$')", near(0.3, r"ssn|social|security|\bid\b|identity")),
    }
    union = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{k}' AS kind, s, e, score FROM {k}_s" for i, k in enumerate(kinds))
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    out = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {",".join(kinds.values())},
a AS ({union}),
per AS (SELECT doc_id, {counts}, {listed} FILTER (o < 4) AS base, {listed} AS spans, round(min(score), 6) AS least_score FROM a GROUP BY doc_id)
SELECT d.doc_id, {out}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, least_score FROM d LEFT JOIN per USING (doc_id)
"""


PERSONAL_DATA = _personal_data()

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT doc_id, i, unnest(range(8)) AS j FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum([len(x) FOR x IN w.w]), 0)::BIGINT AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_upper > word_chars OR 5 * n_exclaim > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""


def near_duplicates(size: int, table: str = "documents") -> str:
    """Pairs share one of each set's rarest shingles, as many as could be missing from the other;
    then whole sets are compared. A walk over the links gives the components."""
    run = f"array_to_string(w[i:i + {size - 1}], ' ')"
    return rf"""
WITH RECURSIVE
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM {table}),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, {run} AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT x, count(*) AS f FROM s GROUP BY x),
r AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS p FROM s JOIN f USING (x)),
head AS MATERIALIZED (SELECT doc_id, x FROM r JOIN n USING (doc_id) WHERE p <= n - (n * 80 + 99) // 100 + 1),
cand AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM head a JOIN head b ON a.x = b.x AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)),
both_ AS (SELECT a, b, count(*) AS k FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.x = x.x GROUP BY a, b),
link AS MATERIALIZED (
  SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
two AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, two.b FROM reach JOIN two ON two.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


NEAR_DUPLICATES = near_duplicates(2)

_TOKENS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def decontamination(docs: str = "documents") -> str:
    """Masked windows meet as texts; sums of points and their least earlier sum give the best stretch."""
    masked = lambda m: " || ' ' || ".join(f"w[i + {o}]" for o in range(12) if o % 3 != m)
    long_ = " UNION ALL ".join(f"SELECT id, i, {m} AS k, {masked(m)} AS x FROM p" for m in range(3))
    def side(name: str, source: str) -> str:
        return f"""
{name}_p AS (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM {source}),
{name}_l AS ({long_.replace("FROM p", f"FROM {name}_p")})"""
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id AS id, {_TOKENS} AS w FROM {docs} WHERE doc_id IS NOT NULL),
b AS MATERIALIZED (SELECT DISTINCT item_id AS id, w FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) >= 5),
{side("dw", "d")}, {side("bw", "b")},
short AS (SELECT id, len(w) AS n, array_to_string(w, ' ') AS x FROM b WHERE len(w) < 12),
sw AS (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (
  SELECT d.id, d.w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM short))),
hit AS MATERIALIZED (
  SELECT DISTINCT x.id AS doc_id, y.id AS item_id, x.i - y.i AS shift FROM dw_l x JOIN bw_l y ON x.k = y.k AND x.x = y.x
  UNION SELECT sw.id, short.id, sw.i - 1 FROM sw JOIN short ON sw.n = short.n AND sw.x = short.x),
laid AS (SELECT doc_id, item_id, shift, i, CASE WHEN shift + i BETWEEN 1 AND len(d.w) AND d.w[shift + i] = b.w[i] THEN 1 ELSE -2 END AS point, len(b.w) AS size
         FROM (SELECT hit.*, unnest(range(1, len(b.w) + 1)) AS i FROM hit JOIN b ON b.id = item_id) JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
sums AS (SELECT *, sum(point) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS s FROM laid),
least_ AS (SELECT *, least(0, min(s * 1000000 - i) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS l FROM sums),
scored AS (SELECT *, s - ceil(l / 1000000.0) AS score, (ceil(l / 1000000.0) * 1000000 - l)::BIGINT AS start FROM least_),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, shift, i) = 1)
SELECT doc_id, item_id, score::BIGINT AS score, (shift + start)::BIGINT AS first_token, (i - start)::BIGINT AS n_tokens
FROM best WHERE score >= least(9, size)
"""


DECONTAMINATION = decontamination()


def _chat_tools() -> str:
    """Line i of a user turn waits for line i // 2, so its level is how often i can be halved."""
    split = "unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS nth"
    js = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    return f"""
WITH l AS (SELECT conv_id, turn, role, {split} FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (
  SELECT conv_id, turn, 't' || turn || 'c' || nth AS call_id, floor(log2(nth))::INT AS level, min(len(line)) AS size, min(line) AS line,
         CASE WHEN min(len(line)) % 7 = 0 THEN 'browse' WHEN min(len(line)) % 2 = 0 THEN 'search' ELSE 'translate' END AS name
  FROM l WHERE role = 'user' GROUP BY conv_id, turn, nth),
r AS (SELECT conv_id, turn, 't' || (turn - 1) || 'c' || nth AS call_id, min(line) AS content FROM l WHERE role = 'assistant' GROUP BY conv_id, turn, nth),
b AS (
  SELECT conv_id, coalesce(c.turn, r.turn) AS turn, call_id, level,
         CASE WHEN c.turn IS NULL THEN 'orphan' WHEN name = 'search' AND size < 12 OR name = 'translate' AND size > 150 THEN 'invalid'
              WHEN name = 'browse' THEN 'unknown_tool' WHEN r.turn IS NULL THEN 'no_result' ELSE 'ok' END AS status,
         CASE WHEN c.turn IS NULL THEN '{{' ELSE '{{"arguments":{{"query":' || {js("line")} || ',"size":' || size || '}},' END
           || '"id":' || {js("call_id")} || CASE WHEN c.turn IS NULL THEN '' ELSE ',"name":' || {js("name")} END
           || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || {js("content")} END || '}}' AS line
  FROM c FULL JOIN r USING (conv_id, call_id))
SELECT conv_id, turn, {", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("ok", "no_result", "unknown_tool", "invalid", "missing", "cycle", "orphan"))},
       '[' || string_agg(line, ',' ORDER BY CASE WHEN status = 'orphan' THEN 2 ELSE 0 END, coalesce(level, 0), call_id, line) || ']' AS messages
FROM b GROUP BY conv_id, turn
"""


CHAT_TOOLS = _chat_tools()


def _spelling(least: int = 5, times: int = 5, one_in: int = 199) -> str:
    """crc32 is linear in the bytes: a byte adds the value of its place from the end, and the length
    a constant. Words meet with one letter left out, at its place, or as the rest of a longer one."""
    return f"""
WITH RECURSIVE
step(b, v) AS MATERIALIZED (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM (SELECT unnest(range(256)) AS b)),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
k AS MATERIALIZED (
  SELECT word, coalesce(doc_id::VARCHAR, '') || ':' || word AS key, count(*) AS n
  FROM (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM r) WHERE len(word) >= 6 GROUP BY ALL),
longest AS (SELECT coalesce(max(octet_length(encode(key))), 0) AS size FROM k),
value_(p, b, v) AS MATERIALIZED (
  SELECT 0, b, v FROM step
  UNION ALL SELECT p + 1, value_.b, xor(step.v, value_.v >> 8) FROM value_ JOIN step ON step.b = value_.v & 255 WHERE p < (SELECT size FROM longest)),
start_(size, v) AS MATERIALIZED (
  SELECT 0::BIGINT, 4294967295::BIGINT
  UNION ALL SELECT size + 1, xor(step.v, start_.v >> 8) FROM start_ JOIN step ON step.b = start_.v & 255 WHERE size < (SELECT max(size) FROM longest)),
bytes_ AS (SELECT key, hex(encode(key)) AS h, octet_length(encode(key)) AS size, unnest(range(octet_length(encode(key)))) AS i FROM k),
sums AS (
  SELECT key, any_value(bytes_.size) AS size, bit_xor(v) AS v FROM bytes_
  JOIN value_ ON value_.p = bytes_.size - 1 - i AND value_.b = ('0x' || substr(h, 2 * i + 1, 2))::BIGINT GROUP BY key),
hashed AS (SELECT k.word, k.n, xor(xor(sums.v, start_.v), 4294967295) AS h FROM k JOIN sums USING (key) JOIN start_ USING (size)),
dropped AS (SELECT n, CASE WHEN h % {one_in} = 0 THEN left(word, (h % len(word))::INT) || substr(word, (h % len(word))::INT + 2) ELSE word END AS word FROM hashed),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM dropped WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= {least}),
rest AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM rest a JOIN rest b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM rest a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM rest a JOIN w b ON a.rest = b.word),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word),
link AS MATERIALIZED (SELECT w.word, form, form_n FROM w JOIN best USING (word) WHERE form_n >= {times} * n),
chain(word, root) AS (SELECT word, word FROM w UNION ALL SELECT chain.word, link.form FROM chain JOIN link ON link.word = chain.root),
roots AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM link))
SELECT word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, link.form_n::BIGINT AS form_n
FROM w JOIN roots USING (word) LEFT JOIN link USING (word) LEFT JOIN (SELECT word, n_near FROM best) USING (word)
"""


SPELLING = _spelling()
