"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

from . import licences, mixing, secret_scan, sharding, url_filter

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _mix() -> str:
    weights = ", ".join(f"{float(w)}" for w in mixing.WEIGHTS)
    return f"""
WITH sized AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
turn AS (SELECT *, ([{weights}]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS w,
  {mixing.CAP}::DOUBLE * source_size AS cap, {mixing.SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM per),
run AS (SELECT *, (total - (sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM turn),
filled AS (SELECT *, cap <= w * level AS done FROM run),
final AS (SELECT source, source_size, CASE WHEN done THEN cap ELSE w * ((total - coalesce(sum(CASE WHEN done THEN cap END) OVER (), 0))
  / nullif(sum(CASE WHEN NOT done THEN w END) OVER (), 0)) END AS target FROM filled),
rated AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized d JOIN final f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, size * (floor(rate) + CASE WHEN
  ('0x' || substr(md5('{mixing.SEED}:' || doc_id || ':' || size), 1, 13))::BIGINT / {float(1 << 52)} < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM rated"""


def _shard() -> str:
    owners = ",".join(map(str, sharding.fill(sharding.SHARDS, sharding.SLOTS)))
    names = ", ".join(f"'{s}'" for s in sharding.SHARDS)
    return f"""
WITH owners AS (SELECT unnest(string_split('{owners}', ','))::INT AS owner, unnest(range({sharding.SLOTS})) AS slot),
placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, placed.slot, ([{names}])[owner + 1] AS shard FROM placed JOIN owners ON placed.slot = owners.slot"""


_TOPK = """
WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _urls() -> str:
    k, b = url_filter.K, url_filter.BACKOFF
    rule = verdict = "NULL"
    for h, p, v in sorted(url_filter.RULES, key=lambda r: len(r[0] + r[1])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"

    def p(v: str, total: str) -> str:
        one = f"(({v}1 + 1) / ({total} + {k}))"
        two = f"(({v}2 + {b} * {one}) / ({v}c1 + {b}))"
        return f"(({v}3 + {b} * {two}) / ({v}c2 + {b}))"

    def sums(by: str, n: str) -> str:
        return f"sum(x3) OVER (PARTITION BY {by}) AS x{n}, sum(y3) OVER (PARTITION BY {by}) AS y{n}"

    def model(n: str, where: str) -> str:
        """The table of log ratios learned from some of the labelled URLs."""
        return f"""counts{n} AS (SELECT k, count(*) FILTER (rv = 'allow') AS x3, count(*) FILTER (rv = 'block') AS y3 FROM keyed WHERE rv IS NOT NULL AND {where} GROUP BY k),
grid{n} AS (SELECT range AS k, coalesce(x3, 0)::DOUBLE AS x3, coalesce(y3, 0)::DOUBLE AS y3 FROM range({k**3}) LEFT JOIN counts{n} ON range = k),
cells{n} AS (SELECT k, x3, y3, {sums(f"k // {k}", "c2")}, {sums(f"k % {k * k}", "2")}, {sums(f"k // {k} % {k}", "c1")}, {sums(f"k % {k}", "1")} FROM grid{n}),
total{n} AS (SELECT count(*) FILTER (rv = 'allow') AS tx, count(*) FILTER (rv = 'block') AS ty FROM keyed WHERE {where}),
ratios{n} AS (SELECT k, round(ln({p("x", "tx")} / {p("y", "ty")}), 4) AS v FROM cells{n}, total{n}),
scored{n} AS (SELECT page_id, sum(v) / count(*) AS score FROM keyed JOIN ratios{n} ON keyed.k = ratios{n}.k GROUP BY page_id)"""

    middle = "(avg(coalesce(score, 0)) FILTER (rv = 'allow') + avg(coalesce(score, 0)) FILTER (rv = 'block')) / 2"
    return f"""
WITH cut AS (SELECT page_id, url, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
hosted AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, ('0x' || substr(md5(coalesce(url, '')), 1, 8))::BIGINT % {url_filter.PARTS} AS part FROM cut),
ruled AS (SELECT *, {rule} AS rule, {verdict} AS rv FROM hosted),
spelt AS (SELECT page_id, rv, part, list_transform(list_filter(string_split(translate(translate(coalesce(url, ''), {_AZ}), '123456789', '000000000'), ''), lambda c: c <> ''), lambda c: strpos('{url_filter.ALPHABET}', c)) AS s FROM ruled),
flat AS (SELECT page_id, rv, part, unnest(s) AS z, unnest(range(len(s))) AS i FROM spelt),
keyed AS (SELECT page_id, rv, part, (lag(z, 2, {k - 1}) OVER w * {k} + lag(z, 1, {k - 1}) OVER w) * {k} + z AS k FROM flat WINDOW w AS (PARTITION BY page_id ORDER BY i)),
{model("_all", "true")},
{model("_fit", "part <> 0")},
judged AS (SELECT r.page_id, host, path, rule, rv, part, score FROM ruled r LEFT JOIN scored_all s ON r.page_id = s.page_id),
held AS (SELECT {middle} AS c FROM ruled r LEFT JOIN scored_fit s ON r.page_id = s.page_id WHERE part = 0),
cutoff AS (SELECT coalesce((SELECT c FROM held), {middle}, '-inf'::DOUBLE) AS c FROM judged)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN score >= c OR score IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM judged, cutoff"""


def _licences() -> str:
    def canonical(text: str) -> str:
        out = f"' ' || trim(regexp_replace(regexp_replace(translate({text}, {_AZ}), '{licences._COPYRIGHT.replace('(?md)', '(?m)')}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
        for other, one in licences.SPELLINGS:
            out = f"replace({out}, ' {other} ', ' {one} ')"
        return f"md5(trim({out}))"

    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licences.KNOWN)
    return f"""
WITH known AS (SELECT {canonical("t")} AS d, min(n) AS n FROM (VALUES {known}) v(n, t) GROUP BY d),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
notices AS (SELECT doc_id, string_agg(DISTINCT n, ',' ORDER BY n) AS notices FROM (SELECT doc_id, n FROM lines JOIN known ON {canonical("line")} = d WHERE regexp_matches(line, '{licences.MARK}') OR regexp_matches(line, '\\bCC\\b')) GROUP BY doc_id)
SELECT t.doc_id, digest, known.n AS licence, coalesce(notices, '') AS notices FROM (SELECT doc_id, {canonical("text")} AS digest FROM documents) t LEFT JOIN known ON digest = d LEFT JOIN notices ON t.doc_id = notices.doc_id"""


def _secrets() -> str:
    k, n, stems = secret_scan.K, secret_scan.SAMPLES, secret_scan.STEMS
    quote = lambda x: x.replace("'", "''")
    stem = [f"stems[('0x' || substr(digest, {1 + 4 * i}, 4))::BIGINT % {len(stems)} + 1]" for i in range(4)]
    title = [f"upper(substr({x}, 1, 1)) || substr({x}, 2)" for x in stem]

    def found(kind: int, pattern: str) -> str:
        return f"""(SELECT doc_id, {kind} AS kind, unnest(list_transform(range(1, len(hits) + 1), lambda j: list_sum(list_transform(gaps[1:j], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:j - 1], lambda h: length(h))), 0)))::BIGINT AS start, unnest(hits) AS hit
  FROM (SELECT doc_id, regexp_extract_all(text, '{quote(pattern)}') AS hits, string_split_regex(text, '{quote(pattern)}') AS gaps FROM docs))"""

    def p(v: str) -> str:
        return f"(({v} + 4 * ({v}_b + 0.5) / ({v}_n + {0.5 * k})) / ({v}_a + 4))"

    spans = "coalesce(string_agg(['{}'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop){}, '')".replace("['{}']", "[" + ", ".join(f"'{x}'" for x in secret_scan.KINDS) + "]")
    return f"""
WITH made AS (SELECT id, sha256('sample-' || id) AS digest, [{", ".join(f"'{x}'" for x in stems)}] AS stems FROM range({n}) t(id)),
samples AS (SELECT id, true AS secret, CASE id % 4 WHEN 0 THEN substr(digest, 1, 40) WHEN 1 THEN upper(substr(digest, 1, 40)) ELSE substr(regexp_replace(to_base64(unhex(digest)), '[^A-Za-z0-9+/]', '', 'g'), 1, 40) END AS token FROM made
  UNION ALL SELECT id, false, CASE WHEN id % 6 = 5 THEN repeat(substr('{secret_scan.ALPHABET}', ((id // 6) % {len(secret_scan.ALPHABET)} + 1)::INT, 1), 24)
    WHEN id % 7 = 3 THEN concat_ws('/', {", ".join(stem)})
    WHEN id % 5 = 0 THEN concat_ws('_', {", ".join(stem)}) WHEN id % 5 = 1 THEN {" || ".join([stem[0], *title[1:]])}
    WHEN id % 5 = 2 THEN concat_ws('-', {", ".join(stem[:3])}, id % 100) WHEN id % 5 = 3 THEN upper(concat_ws('_', {", ".join(stem[:3])})) ELSE {" || ".join(stem)} END FROM made),
spelt AS (SELECT id, secret, list_transform(string_split(token, ''), lambda c: strpos('{secret_scan.ALPHABET}', c)) AS s FROM samples),
seen AS (SELECT secret, lag(z, 1, 0) OVER (PARTITION BY id, secret ORDER BY i) * {k} + z AS k FROM (SELECT id, secret, unnest(s) AS z, unnest(range(len(s))) AS i FROM spelt)),
counts AS (SELECT k, count(*) FILTER (secret) AS r, count(*) FILTER (NOT secret) AS o FROM seen GROUP BY k),
grid AS (SELECT range AS k, coalesce(r, 0)::DOUBLE AS r, coalesce(o, 0)::DOUBLE AS o FROM range({k * k}) LEFT JOIN counts ON range = k),
cells AS (SELECT *, {", ".join(f"sum({v}) OVER (PARTITION BY {by}) AS {v}_{x}" for v in "ro" for by, x in ((f"k // {k}", "a"), (f"k % {k}", "b"), ("1", "n")))} FROM grid),
ratios AS (SELECT k, round(ln({p("r")} / {p("o")}), 4) AS v FROM cells),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc_id, kind, start, start + length(hit) AS stop FROM (FROM {found(0, secret_scan._ASSIGN)} UNION ALL FROM {found(1, secret_scan._ACCESS)} UNION ALL FROM {found(2, secret_scan._HEX)})
  WHERE kind > 0 OR length(regexp_extract(hit, '{quote(secret_scan._ASSIGN)}', 2)) >= 12),
apart AS (SELECT doc_id, start, start + length(hit) AS stop, hit FROM {found(3, f"[A-Za-z0-9+/_=-]{{{secret_scan.MIN_TOKEN},}}")} t
  WHERE NOT EXISTS (FROM base b WHERE b.doc_id = t.doc_id AND b.start < t.start + length(t.hit) AND t.start < b.stop)),
chars AS (SELECT doc_id, start, stop, strpos('{secret_scan.ALPHABET}', unnest(string_split(hit, ''))) AS z, unnest(range(length(hit))) AS i FROM apart),
paired AS (SELECT doc_id, start, stop, lag(z, 1, 0) OVER (PARTITION BY doc_id, start ORDER BY i) * {k} + z AS k FROM chars),
more AS (SELECT doc_id, 3 AS kind, start, stop FROM paired JOIN ratios ON paired.k = ratios.k GROUP BY ALL HAVING sum(v) / count(*) >= {secret_scan.THRESHOLD}),
every AS (FROM base UNION ALL FROM more)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256({spans.format(" FILTER (kind < 3)")}) AS base_sha256, {spans.format("")} AS spans
FROM docs d LEFT JOIN every e ON d.doc_id = e.doc_id GROUP BY d.doc_id"""


_JACCARD = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
held AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM held a JOIN held b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS a, y AS z FROM both_ways UNION SELECT r.a, b.y FROM reach r JOIN both_ways b ON r.z = b.x)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(z), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN reach ON d.doc_id = a GROUP BY d.doc_id"""


def sql() -> dict[str, str]:
    return {"op8_mix": _mix(), "op6_sharding": _shard(), "op5_topk": _TOPK, "op4_url_filter": _urls(), "op3_license_scan": _licences(), "op9_secret_scan": _secrets(), "op1_jaccard_join": _JACCARD}
