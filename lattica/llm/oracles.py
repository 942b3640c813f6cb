"""SQL that registered queries are compared with, for those that SQL can express on whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _reached(edges: str, nodes: str) -> str:
    """CTEs after which `component` (id, component_id) has the smallest node that each of `nodes` (id) reaches over `edges` (a, b)."""
    return f"""links AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
walk AS (SELECT id AS start, id FROM {nodes} UNION SELECT walk.start, links.b FROM walk JOIN links ON links.a = walk.id AND links.b > walk.start),
component AS (SELECT id, min(start) AS component_id FROM walk GROUP BY id)"""


EMBEDDINGS = (
    """WITH RECURSIVE fine AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM fine WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id < y.vec_id WHERE list_inner_product(x.v, y.v) / x.norm / y.norm >= 0.93),
nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings),
"""
    + _reached("pairs", "nodes")
    + """
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN component c ON c.id = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id"""
)

SHINGLES = (
    f"""WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS id FROM documents),
"""
    + _reached("pairs", "nodes")
    + """
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN component c ON c.id = d.doc_id"""
)


def _filled(name: str, parents: str, children: str, keys: str, last: str) -> str:
    """CTEs after which `name` (keys, last, amount) splits the amounts of `parents` (keys, amount) among `children` (keys, last, w, room)."""
    on = f"USING ({keys})" if keys else "ON true"
    by = f"PARTITION BY {keys}" if keys else ""
    own = f"{keys}, {last}" if keys else last
    return f"""{name}_a AS (SELECT c.*, least(amount, sum(room) OVER ({by})) AS total FROM {children} c JOIN {parents} p {on} WHERE w > 0 AND room > 0),
{name}_b AS (SELECT *, total - coalesce(sum(room) OVER ({by} ORDER BY room / w, {last} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free, sum(w) OVER ({by} ORDER BY room / w, {last} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weigh FROM {name}_a),
{name}_c AS (SELECT *, bool_and(free * w >= room * weigh) OVER ({by} ORDER BY room / w, {last} ROWS UNBOUNDED PRECEDING) AS met FROM {name}_b),
{name}_d AS (SELECT *, total - coalesce(sum(CASE WHEN met THEN room END) OVER ({by}), 0) AS open, sum(CASE WHEN NOT met THEN w END) OVER ({by}) AS all_w FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN met THEN room ELSE open * w // all_w END AS part, CASE WHEN met THEN -1 ELSE open * w % all_w END AS over FROM {name}_d),
{name} AS (SELECT {own}, part + CASE WHEN NOT met AND row_number() OVER (PARTITION BY {keys + ', ' if keys else ''}met ORDER BY over DESC, {last}) <= total - sum(part) OVER ({by}) THEN 1 ELSE 0 END AS amount FROM {name}_e)"""


def mixing(weights: dict[str, int], domains: int, share: str, epochs: int, seed: int) -> str:
    """Domains alike, languages by weights, sources by tokens."""
    cases = " ".join(f"WHEN '{lang}' THEN {w}" for lang, w in weights.items())
    big = "CAST(sum(n) AS HUGEINT)"
    return f"""WITH d AS (SELECT *, 'd' || ((instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % {domains}) AS domain, coalesce(lang, '') AS l, coalesce(source, '') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents),
top AS (SELECT CAST(sum(n) AS HUGEINT) * {share} AS amount FROM d),
c1 AS (SELECT domain, CAST(1 AS HUGEINT) AS w, {big} * {epochs} AS room FROM d GROUP BY ALL),
c2 AS (SELECT domain, l, CAST(CASE l {cases} ELSE 0 END AS HUGEINT) AS w, {big} * {epochs} AS room FROM d GROUP BY ALL),
c3 AS (SELECT domain, l, s, {big} AS w, {big} * {epochs} AS room FROM d GROUP BY ALL),
{_filled("f1", "top", "c1", "", "domain")},
{_filled("f2", "f1", "c2", "domain", "l")},
{_filled("f3", "f2", "c3", "domain, l", "s")},
goal AS (SELECT f3.domain, f3.l, f3.s, CAST(amount // w AS BIGINT) AS whole, CAST(amount % w AS BIGINT) AS rest FROM f3 JOIN c3 USING (domain, l, s)),
placed AS (SELECT d.*, whole, rest, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM d JOIN goal USING (domain, l, s)),
run AS (SELECT *, sum(n) OVER (PARTITION BY domain, l, s ORDER BY h, coalesce(CAST(doc_id AS VARCHAR), '') RANGE UNBOUNDED PRECEDING) <= rest AS fits FROM placed)
SELECT doc_id, domain, lang, source, n AS tokens, CAST(unnest(range(whole + CASE WHEN fits THEN 1 ELSE 0 END)) AS BIGINT) AS epoch FROM run"""
