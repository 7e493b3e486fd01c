"""DuckDB SQL that gives the rows of the queries."""

from __future__ import annotations

import re

from lakeweave.llm import secrets, sharding, warc


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spans_of(text: str, pattern: str) -> str:
    """A list of structs s, e, v for the matches of a pattern in a column."""
    p = _quoted(pattern)
    return (
        f"list_transform(range(1, len(regexp_extract_all({text}, {p})) + 1), lambda i: {{"
        f"'s': coalesce(list_sum(list_transform(string_split_regex({text}, {p})[1:i], lambda g: length(g))), 0)"
        f" + coalesce(list_sum(list_transform(regexp_extract_all({text}, {p})[1:i-1], lambda g: length(g))), 0),"
        f"'v': regexp_extract_all({text}, {p})[i]}})"
    )


def _secrets() -> str:
    conditions = {
        "assign": f"length(regexp_replace(x.v, {_quoted(secrets.ASSIGN_HEAD)}, '')) >= 6",
        "access": "length(x.v) >= 20",
    }
    found = ",\n".join(f"{spans_of('t', r.plain or r.pattern)} AS f{i}" for i, r in enumerate(secrets.RULES))

    def length(r) -> str:
        if not r.plain:
            return "length(x.v)"
        groups = range(1, re.compile(r.plain).groups + 1)
        return " + ".join(f"length(regexp_extract(x.v, {_quoted(r.plain)}, {g}))" for g in groups)

    parts = []
    for i, r in enumerate(secrets.RULES):
        parts.append(
            f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, CAST(x.s AS BIGINT) AS s, CAST(x.s + {length(r)} AS BIGINT) AS e"
            f" FROM (SELECT doc_id, unnest(f{i}) AS x FROM found) WHERE {conditions.get(r.kind, 'true')}"
        )
    every = "\nUNION ALL\n".join(parts)
    one = "kind || ':' || s || ':' || e"
    return f"""
WITH found AS (SELECT doc_id, {found} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
spans AS ({every})
SELECT d.doc_id,
  count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
  count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256(coalesce(string_agg({one}, ',' ORDER BY s, k) FILTER (WHERE k < 3), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' ORDER BY s, k) FILTER (WHERE k >= 0), '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


SECRETS = _secrets()


SHINGLES = (
        "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] "
        "ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END"
)  # five-word shingles of the list w; a shorter text is one


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

CONTAINED = f"""
WITH listed AS (SELECT item_id, {WORDS.format("lower(coalesce(text, ''))")} AS w FROM benchmark),
items AS (SELECT item_id, unnest(list_distinct({SHINGLES})) AS sh FROM listed),
widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM listed WHERE len(w) > 0),
held AS (
  SELECT DISTINCT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' ')))) AS sh
  FROM (SELECT doc_id, {WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents), widths),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(n_item) AS n_item
FROM held JOIN items USING (sh) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)"""

COMPONENTS = f"""
WITH RECURSIVE held AS (
  SELECT doc_id, list_distinct({SHINGLES}) AS shs
  FROM (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
        FROM documents)),
sizes AS (SELECT doc_id, len(shs) AS n FROM held),
each AS (SELECT doc_id, unnest(shs) AS sh FROM held),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(m.n) + any_value(n.n) - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id
FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n"""

ARCHIVE = f"""
WITH r AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, octet_length(encode(h)) AS n, sha1(h) AS digest FROM r),
t AS (SELECT *, n >= 1000 AND page_id <> max(page_id) OVER same AS again, max(page_id) OVER same AS top, chr(13) || chr(10) AS nl
  FROM d WINDOW same AS (PARTITION BY digest, n)),
x AS (SELECT *, 'WARC/1.1' || nl || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || nl
  || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Date: {warc.DATE}' || nl
  || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || nl, '')
  || 'WARC-Payload-Digest: sha1:' || digest || nl
  || CASE WHEN again THEN 'WARC-Profile: {warc.PROFILE}' || nl || 'WARC-Refers-To: <urn:page:' || top || '>' || nl ELSE '' END
  || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE n END || nl || nl
  || CASE WHEN again THEN '' ELSE h END || nl || nl AS record FROM t)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to,
  CAST(octet_length(encode(record)) AS BIGINT) AS record_bytes, sha1(record) AS record_sha1
FROM x"""

# The rules of the contract.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

URLS = f"""
WITH rules(rh, rp, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
hits AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS place
  FROM u LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM hits WHERE place = 1"""

SHARDS = f"""
WITH d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes,
    CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
probes AS (SELECT doc_id, bytes, CAST(depth AS INTEGER) AS depth, substr(lpad(bin(h), 60, '0'), 1, depth) AS prefix
       FROM d, range(0, 41) x(depth)),
sizes AS (SELECT depth, prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM probes GROUP BY ALL)
SELECT doc_id, bytes, depth, prefix, shard_bytes, shard_docs
FROM probes JOIN sizes USING (depth, prefix)
WHERE shard_bytes <= {sharding.SHARD_BYTES} OR shard_docs = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""
