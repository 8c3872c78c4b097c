"""DuckDB SQL for the results of the queries in ``queries``."""

from __future__ import annotations

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, 1 + least(len(q.w), len(c.w))), lambda i: q.w[i] * c.w[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

MIX_SQL = """
WITH RECURSIVE named(source, weight) AS (VALUES {named}),
d AS (SELECT *, CASE WHEN source IN (SELECT source FROM named) THEN source ELSE '~rest' END AS grp FROM documents),
c AS (SELECT grp, count(*)::DOUBLE AS n FROM d GROUP BY grp),
w AS (SELECT c.grp, c.n, coalesce(named.weight, {rest}::DOUBLE) AS weight FROM c LEFT JOIN named ON c.grp = named.source),
m AS (SELECT grp, (SELECT sum(n) FROM c) * weight / (SELECT sum(weight) FROM w) / n AS mean FROM w WHERE weight > 0),
p AS (SELECT grp, greatest(1, ceil(mean / {part}))::BIGINT AS parts, mean / greatest(1, ceil(mean / {part})) AS mean FROM m),
cdf AS (
  SELECT grp, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS total FROM p
  UNION ALL
  SELECT grp, mean, k + 1, p * (mean / (k + 1)), total + p * (mean / (k + 1)) FROM cdf WHERE k < 120 AND (k < mean OR p > 1e-18)
),
tables AS (SELECT grp, list(total ORDER BY k) AS totals FROM cdf GROUP BY grp),
drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         CAST(list_sum(list_transform(range(1, p.parts + 1), lambda i: len(list_filter(tables.totals, lambda t:
           t <= CAST('0x' || substr(md5({seed} || '|' || i || '|' || coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, ''))), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0
         )))) AS BIGINT) AS copies
  FROM d JOIN p ON d.grp = p.grp JOIN tables ON d.grp = tables.grp
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM drawn
"""

REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE doc_id > least),
g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM r) GROUP BY doc_id),
j AS (SELECT d.doc_id, words, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM j
"""


def _spans_sql(kinds: list[tuple[str, str, str]], n_base: int, more: str = "") -> str:
    """kinds: (name, RE2 pattern, test of the match m); the first n_base are base kinds."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cuts = ", ".join(f"regexp_extract_all(t, {quoted(p)}) AS m{i}, string_split_regex(t, {quoted(p)}) AS g{i}" for i, (_, p, _) in enumerate(kinds))
    spans = ", ".join(
        f"""list_filter(list_transform(range(1, len(m{i}) + 1), lambda i: {{
          's': CAST(list_sum(list_transform(g{i}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m{i}[1:i - 1], lambda y: length(y))), 0) AS BIGINT),
          'p': {i}, 'k': '{name}', 'm': m{i}[i]}}), lambda z: {test.replace("$", "z.m")})"""
        for i, (name, _, test) in enumerate(kinds)
    )
    text = "array_to_string(list_transform({}, lambda z: z.k || ':' || z.s || ':' || (z.s + length(z.m))), ',')"
    counts = ", ".join(f"len(list_filter(s, lambda z: z.p = {i}))::BIGINT AS n_{kinds[i][0]}" for i in range(n_base))
    return f"""
WITH c AS (SELECT doc_id, t, {cuts} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
f AS (SELECT doc_id, t, list_sort(flatten([{spans}])) AS s FROM c)
SELECT doc_id, {counts}, sha256(coalesce({text.format(f"list_filter(s, lambda z: z.p < {n_base})")}, '')) AS base_sha256,
       coalesce({text.format("s")}, '') AS spans{more}
FROM f
"""


SECRETS_SQL = _spans_sql(
    [
        (
            "assign",
            r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            r"""length(regexp_extract($, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 6""".replace("$'", "\x00'").replace("$", "$", 1),
        ),
        ("access", "AKIA[A-Z0-9]+", "length($) >= 20"),
        ("hex", "[0-9a-f]+", "length($) >= 24"),
        ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
        ("code_host", "(ghp_|gho_|ghs_)[A-Za-z0-9]{36}", "true"),
        ("chat_host", "(xoxb-|xoxp-|xoxa-)[0-9A-Za-z-]{10,}", "true"),
    ],
    3,
).replace("\x00", "$")

_DIGITS = "regexp_replace($, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER)
  ELSE CAST('0246813579'[CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER) + 1] AS INTEGER) END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(substr($, 5) || substr($, 1, 4), ''), lambda c: ord(c))),
  lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"""
_CONTEXT = {
    "email": ("mail|contact|write", 0.9), "ip": ("ip|address|host|server", 0.6), "card": ("card|visa|credit|payment", 0.7),
    "phone": ("phone|call|tel|mobile", 0.6), "iban": ("iban|account|bank|transfer", 0.8),
}
_SCORE = "CASE z.k " + " ".join(
    f"WHEN '{k}' THEN CASE WHEN regexp_matches(lower(substr(t, greatest(z.s - 48, 0) + 1, z.s - greatest(z.s - 48, 0)) || ' ' || substr(t, z.s + length(z.m) + 1, 48)), '\\b(?:{w})\\b') THEN least({x}::DOUBLE + 0.35::DOUBLE, 1.0::DOUBLE) ELSE {x}::DOUBLE END"
    for k, (w, x) in _CONTEXT.items()
) + " END"
PII_SQL = _spans_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split($, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT), 256) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", _MOD97),
    ],
    4,
    f", coalesce(list_max(list_transform(s, lambda z: {_SCORE})), 0.0::DOUBLE) AS max_score",
)
