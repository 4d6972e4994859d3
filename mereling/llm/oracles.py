"""DuckDB SQL with the same rows as the queries, where SQL expresses them."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL["op6_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM q
"""

ORACLE_SQL["op4_substring_dedup"] = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
rec AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
starts AS (SELECT doc_id, i, 1 AS hit FROM win WHERE g IN (SELECT g FROM rec)),
pos AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
marked AS (SELECT p.doc_id, p.i, p.word, max(coalesce(s.hit, 0)) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
           FROM pos p LEFT JOIN starts s ON p.doc_id = s.doc_id AND p.i = s.i),
kept AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


# PII. The patterns of the contract, and those of the two added kinds, whose neighbours are tested after the match.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
_SCORES = {"email": (70, "mail|contact", 30), "ip": (50, "ip|address|host", 40), "card": (80, "card|visa|credit", 20), "phone": (60, "phone|tel|call", 30), "iban": (80, "iban|account|bank", 20), "ssn": (40, "ssn|social security|tax id", 40)}
_SCORE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n} + CASE WHEN regexp_matches(around, '{w}') THEN {m} ELSE 0 END" for k, (n, w, m) in _SCORES.items()) + " END"
_KINDS = " UNION ALL ".join(f"SELECT doc_id, t, '{k}' AS kind, {i} AS o, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS bs FROM d" for i, (k, p) in enumerate(_PATTERNS.items()))
ORACLE_SQL["op10_pii"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_KINDS}),
e AS (SELECT doc_id, t, kind, o, ms[i] AS s, CAST(list_sum(list_transform(bs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM m, unnest(range(1, len(ms) + 1)) AS r(i)),
f AS (SELECT *, a + length(s) AS z, regexp_replace(s, '[^0-9]', '', 'g') AS digits, replace(s, ' ', '') AS bare, substr(t, a, 1) AS prior, substr(t, a + length(s) + 1, 1) AS next,
      lower(substr(t, greatest(a - 40, 0) + 1, least(a, 40)) || ' ' || substr(t, a + length(s) + 1, 40)) AS around FROM e),
g AS (SELECT *, string_split(reverse(digits), '') AS ds, list_transform(string_split(substr(bare, 5) || substr(bare, 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END) AS ns FROM f),
v AS (SELECT * FROM g WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN list_max(list_transform(string_split(s, '.'), lambda p: CAST(p AS HUGEINT))) <= 255
  WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(ds[i] AS INTEGER) ELSE CAST(ds[i] AS INTEGER) * 2 - CASE WHEN CAST(ds[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
  WHEN 'iban' THEN NOT regexp_matches(prior, '[A-Za-z0-9]') AND NOT regexp_matches(next, '[A-Za-z0-9]') AND
    list_reduce(list_transform(string_split(array_to_string(ns, ''), ''), lambda c: CAST(c AS BIGINT)), lambda x, y: (x * 10 + y) % 97) = 1
  ELSE NOT regexp_matches(prior, '[0-9-]') AND NOT regexp_matches(next, '[0-9-]') AND NOT regexp_matches(s, '^(000|666|9)|-00-|-0000$') AND regexp_matches(around, 'ssn|social security|tax id') END),
w AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
      string_agg(kind || ':' || a || ':' || z, ',' ORDER BY o, a) FILTER (WHERE o < 4) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY o, a) AS spans, string_agg({_SCORE}, ',' ORDER BY o, a) AS scores FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN w ON d.doc_id = w.doc_id
"""


def _url_tree(levels: int = 8, pages: int = 20, z: float = 2.58, prior: float = 10.0) -> str:
    """The template tree: a step per level, as in `url_filter`, for as many levels as the tables' mixed branches have."""
    steps = ["""p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages)""",
             "votes AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id)",
             """r0 AS (SELECT p.page_id, host, path, CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS segs, '' AS tpl, CASE WHEN bad IS NULL THEN 0 ELSE 1 END AS l, coalesce(bad, 0) AS b
  FROM p LEFT JOIN votes ON p.page_id = votes.page_id)"""]
    for i in range(1, levels + 1):
        steps += [
            f"w{i} AS (SELECT host, tpl, sum(l) AS pl, sum(b) AS pb FROM r{i - 1} WHERE len(segs) >= {i} GROUP BY host, tpl)",
            f"e{i} AS (SELECT host, tpl, segs[{i}] AS seg, sum(l) AS l, sum(b) AS b FROM r{i - 1} WHERE len(segs) >= {i} GROUP BY host, tpl, segs[{i}] HAVING count(*) >= {pages})",
            f"g{i} AS (SELECT host, tpl, seg, l, b, (b / nullif(l, 0)::DOUBLE) - ((pb - b) / nullif(pl - l, 0)::DOUBLE) AS gap, pb / nullif(pl, 0)::DOUBLE AS share, 1 / nullif(l, 0)::DOUBLE + 1 / nullif(pl - l, 0)::DOUBLE AS inv FROM e{i} JOIN w{i} USING (host, tpl))",
            f"a{i} AS (SELECT host, tpl, seg, l, b, CASE WHEN gap > 0 THEN '#bad' ELSE '#good' END AS side FROM g{i} WHERE gap * gap > {z}::DOUBLE * {z}::DOUBLE * (share * (1 - share) * inv))",
            f"s{i} AS (SELECT host, tpl, side, sum(l)::DOUBLE AS sl, sum(b)::DOUBLE AS sb, sum(b) / sum(l)::DOUBLE AS pool, count(*) AS n FROM a{i} GROUP BY host, tpl, side)",
            f"""k{i} AS (SELECT host, tpl, seg, CASE WHEN n > 1 AND (b / l::DOUBLE - pool) * (b / l::DOUBLE - pool) <= {z}::DOUBLE * {z}::DOUBLE * (pool * (1 - pool) * (1 / l::DOUBLE + 1 / sl)) THEN side ELSE seg END AS lit
  FROM a{i} JOIN s{i} USING (host, tpl, side))""",
            f"""r{i} AS (SELECT page_id, host, path, segs, CASE WHEN len(segs) < {i} THEN r.tpl ELSE r.tpl || '/' || coalesce(k.lit, '*') END AS tpl, l, b
  FROM r{i - 1} r LEFT JOIN (SELECT host AS kh, tpl AS kt, seg, lit FROM k{i}) k ON r.host = k.kh AND r.tpl = k.kt AND len(segs) >= {i} AND segs[{i}] = k.seg)""",
        ]
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    fits = lambda h, p: f"(d.host = '{h}' OR ends_with(d.host, '.{h}')) AND starts_with(d.path, '{p}')"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    steps += [
        f"done AS (SELECT page_id, host, path, tpl || repeat('/*', greatest(len(segs) - {levels}, 0)) AS tpl, l, b FROM r{levels})",
        "t AS (SELECT host, tpl, sum(l) AS l, sum(b) AS b FROM done GROUP BY host, tpl)", "h AS (SELECT host, sum(l) AS hl, sum(b) AS hb FROM t GROUP BY host)",
        "a AS (SELECT coalesce(sum(b) / nullif(sum(l), 0)::DOUBLE, 0) AS g FROM t)",
        f"j AS (SELECT host, tpl, (b + {prior}::DOUBLE * ((hb + {prior}::DOUBLE * g) / (hl + {prior}::DOUBLE))) / (l + {prior}::DOUBLE) AS share FROM t JOIN h USING (host), a)",
    ]
    return f"WITH {', '.join(steps)} SELECT d.page_id, d.host, d.path, {rule} AS rule, {verdict} WHEN j.share >= 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM done d JOIN j ON d.host = j.host AND d.tpl = j.tpl"


ORACLE_SQL["op9_url_filter"] = _url_tree()


#: Damage by CRC-32 (its table from the polynomial), then a programme over every turn, from the last on: of each
#: role before a turn the cheapest edits of what is left, as cost, audit and lines.
_STATE = "{'c': CAST(%s AS BIGINT), 'a': %s, 'p': %s}"
_LINE = "chr(10) || role || ':' || text"


def _keep(to: str, state: int, before: str) -> str:
    """A turn retained as `to`, with an empty turn in front where the role before needs it."""
    role, between, other = ("'user'", "u", "assistant") if to == "u" else ("'assistant'", "a", "user")
    kept, extra = f"kind = '{to}'", "fault = 'truncated'"
    return ("CASE WHEN fault NOT IN ('blank', 'duplicate') THEN " + _STATE % (
        f"CASE WHEN {before} THEN 2 ELSE 0 END + CASE WHEN {kept} THEN 0 ELSE 2 END + CASE WHEN {extra} THEN 1 ELSE 0 END + st[{state}].c",
        f"CASE WHEN {before} THEN 'I' ELSE '' END || CASE WHEN {kept} THEN 'K' ELSE 'R' END || st[{state}].a",
        f"CASE WHEN {before} THEN chr(10) || '{other}:' ELSE '' END || chr(10) || CASE WHEN {kept} THEN role ELSE {role} END || ':' || text || st[{state}].p") + " END")


ORACLE_SQL["op12_conversation_repair"] = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, o: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS key FROM conversations),
  cases AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(key, lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295) % 20 AS k FROM keyed, crc),
  damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM cases, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS u(copy) WHERE k <> 0),
  seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS visible FROM damaged),
  turns AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS kind, CASE WHEN visible = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(visible, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS n FROM seen),
  pairs AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY n) || kind AS pair FROM turns),
  counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS total FROM pairs GROUP BY conv_id),
  steps AS (SELECT conv_id, total AS i, [{_STATE % (0, "''", "''")}, {_STATE % (4, "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")}, {_STATE % (2, "'I'", "chr(10) || 'assistant:'")}, {_STATE % (0, "''", "''")}] AS st FROM counts
    UNION ALL SELECT s.conv_id, i - 1, list_transform(range(1, 5), lambda r: list_sort(list_filter([{_STATE % ('3 + st[r].c', "'D' || st[r].a", 'st[r].p')},
      CASE WHEN r = 1 AND kind = 's' AND fault NOT IN ('blank', 'duplicate') THEN {_STATE % ("CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END + st[2].c", "'K' || st[2].a", _LINE + ' || st[2].p')} END,
      {_keep('u', 3, 'r = 3')},
      {_keep('a', 4, 'r <> 3')}], lambda x: x IS NOT NULL))[1])
    FROM steps s JOIN turns t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = s.i),
  done AS (SELECT c.*, st[1].c AS cost, st[1].a AS audit, sha256(substr(st[1].p, 2)) AS repaired_sha256 FROM counts c JOIN steps s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = 0)
  SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
    coalesce(repaired_sha256, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id"""
