"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from . import ngram_lm, secrets, vector_codes

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hex_digits: str) -> str:
    """Twenty bits at a time: five hexadecimal digits are four of base 32."""
    five = f"CAST('0x' || substr({hex_digits}, i * 5 + 1, 5) AS INTEGER)"
    chars = " || ".join(f"substr('{_BASE32}', ({five} >> {s}) % 32 + 1, 1)" for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda i: {chars}), '')"


WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, upper(sha1(h)) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, payload_bytes, {_base32("x")} AS payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, true AS verified FROM f"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(coalesce(score, 0) AS BIGINT) AS score FROM s QUALIFY rank <= 5"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END) AS s FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), bt AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM bt JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b), c AS (SELECT node, min(low) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON node = doc_id"""

_GRAMS = range(1, ngram_lm.ORDER + 1)


def _scores() -> str:
    """Count tables of each order over the corpus, joined to each word of a row."""
    out = [f"w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents), p AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, ws FROM w)"]
    for n in _GRAMS:
        out.append(f"g{n} AS (SELECT r, i, hash(ws[i - {n - 1}:i]) AS h FROM p WHERE i >= {n}), t{n} AS (SELECT h, count(*) AS c FROM g{n} GROUP BY 1)")
        out.append(f"c{n} AS (SELECT r, i, c FROM g{n} JOIN t{n} USING (h))")
    score = "log10(greatest(c1.c, 0.5) / total)"
    for n in _GRAMS[1:]:
        score = f"CASE WHEN c{n}.c > 0 THEN log10(c{n}.c / x{n - 1}.c) WHEN c1.i >= {n} THEN {score} + log10({ngram_lm.ALPHA}) ELSE {score} END"
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.r = c1.r AND c{n}.i = c1.i LEFT JOIN c{n - 1} x{n - 1} ON x{n - 1}.r = c1.r AND x{n - 1}.i = c1.i - 1" for n in _GRAMS[1:])
    return (
        "WITH " + ",\n".join(out) + f",\nN AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM p), s AS (SELECT c1.r, sum({score}) AS s FROM c1 {joins}, N GROUP BY 1)\n"
        "SELECT doc_id, len(ws) AS n_words, round(coalesce(s, 0), 4) AS log10_score FROM w LEFT JOIN s USING (r)"
    )


SCORES = _scores()


def _spans(name: str, text: str, pattern: str, kind: int, where: str = "true", group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""{name}0 AS (SELECT r, unnest(range(1, len(f) + 1)) AS i, f, g, gaps FROM (SELECT r, regexp_extract_all({text}, '{p}', 0) AS f, regexp_extract_all({text}, '{p}', {group}) AS g, string_split_regex({text}, '{p}') AS gaps FROM t WHERE {where})),
{name} AS (SELECT r, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, {kind} AS kind, f[i] AS m, g[i] AS v FROM {name}0)"""


_RUNS = "[A-Za-z0-9+/=_.-]+"
SECRETS = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_spans("assign", "text", secrets.ASSIGN, 0, "true", 2)}, {_spans("access", "text", secrets.ACCESS, 1)}, {_spans("hex", "text", secrets.HEX, 2)},
{_spans("runs", "text", _RUNS, 3, "contains(text, 'AKIA')")}, {_spans("ends", "text", secrets.ENDPOINT, 4, "contains(text, 'AKIA')")},
base AS (SELECT r, a, kind, a + length(m) AS b FROM (SELECT * FROM assign WHERE length(v) >= {secrets.ASSIGNED} UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex)),
wk AS (SELECT r, a, kind, a + length(m) AS b FROM runs WHERE regexp_full_match(m, '[A-Za-z0-9+/]{{40}}')), weak AS (SELECT * FROM wk WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = wk.r AND base.a <= wk.a AND base.b >= wk.b)),
sc AS (SELECT r, a - {secrets.SCOPE} AS lo, b + {secrets.SCOPE} AS hi FROM base WHERE kind = 1),
full_sc AS (SELECT DISTINCT sc.* FROM sc JOIN (SELECT * FROM weak UNION ALL SELECT * FROM base WHERE kind = 0) s ON s.r = sc.r AND s.a >= lo AND s.b <= hi),
linked AS (SELECT DISTINCT weak.* FROM weak JOIN sc ON sc.r = weak.r AND a >= lo AND b <= hi UNION ALL SELECT DISTINCT e.* FROM (SELECT r, a, kind, a + length(m) AS b FROM ends) e JOIN full_sc f ON f.r = e.r AND a >= lo AND b <= hi),
names AS (SELECT r, a, b, kind, {secrets.KINDS!r}[kind + 1] || ':' || a || ':' || b AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM linked)),
x AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans FROM names GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN x USING (r)"""



def _codes() -> str:
    """Each round of the codebooks as two tables: entries by part of a vector, then sums of the parts by entry."""
    near = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    at = lambda t, i: f"{t} AS MATERIALIZED (SELECT r, part, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT p.r, p.part, c.k, {near} AS d FROM p JOIN c{i} c USING (part)) GROUP BY 1, 2)"
    out = []
    for i in range(vector_codes.ROUNDS):
        out.append(at(f"a{i}", i))
        out.append(f"s{i} AS (SELECT part, k, axis, sum(x[axis])::BIGINT AS s, count(*) AS n FROM p JOIN a{i} USING (r, part), range(1, (SELECT w FROM dims) + 1) AS t(axis) GROUP BY 1, 2, 3)")
        out.append(f"u{i} AS (SELECT part, k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY axis) AS x FROM s{i} GROUP BY 1, 2)")
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.k, coalesce(u.x, c.x) AS x FROM c{i} c LEFT JOIN u{i} u ON u.part = c.part AND u.k = c.k)")
    last = vector_codes.ROUNDS
    rounds, parts, entries = ",\n".join([*out, at("final", last)]), vector_codes.PARTS, vector_codes.ENTRIES
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dims AS (SELECT greatest(1, (max(len(e)) + {parts - 1}) // {parts}) AS w FROM v), o AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS k FROM v QUALIFY k < {entries}),
p AS MATERIALIZED (SELECT r, part, list_resize(e, {parts} * w, 0)[part * w + 1 : (part + 1) * w] AS x FROM v, dims, range({parts}) AS t(part)),
c0 AS MATERIALIZED (SELECT part, k, x FROM p JOIN o USING (r)),
{rounds},
f AS (SELECT r, string_agg(lpad(to_hex(k), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY 1),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c{last})
SELECT vec_id, label, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN f USING (r), b"""


CODES = _codes()

ORACLE_SQL = {
    "op2_warc_round_trip": WARC,
    "op3_stupid_backoff": SCORES,
    "op5_exact_top_k": TOP_K,
    "op7_minhash_near_dedup": NEAR,
    "op10_linked_secrets": SECRETS,
    "op13_vector_codes": CODES,
}
