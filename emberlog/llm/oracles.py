"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The table of the reflected CRC-32 polynomial, made by its rule: eight shift steps for each byte.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(text: str) -> str:
    """CRC-32 of a text expression, with ``t`` in scope."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({digits}), 2), lambda k: ('0x' || substr({digits}, k, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_WORDS = (
    "SELECT {key}, unnest(regexp_extract_all(translate({text}, '" + _CAPITALS + "', '" + _CAPITALS.lower() + "'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM {table}"
)

RESAMPLING = f"""
WITH {_CRC_TABLE},
d AS MATERIALIZED ({_WORDS.format(key="doc_id", text="text", table="documents")}),
b AS MATERIALIZED ({_WORDS.format(key="item_id", text="text", table="benchmark")}),
words AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT w FROM d UNION SELECT w FROM b), crc_table),
s AS (SELECT bucket, count(*) AS s FROM d JOIN words USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN words USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM d) AS all_s, (SELECT count(*) FROM b) AS all_t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN words USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scores AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scores s LEFT JOIN ranks USING (doc_id)
"""


def _leaf(text: str) -> str:
    parts = ("doc_id", "source", "lang", "n_chars", text)
    one = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(one.format(p) for p in parts) + ")"


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')")} ELSE {_leaf("text")} END AS claimed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM documents, crc_table),
low AS (
  SELECT tree, 0 AS level, place, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY tree, level, place // 16, n),
subroots AS MATERIALIZED (
  SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place, n, h FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY level, place // 16, n),
low_runs AS MATERIALIZED (SELECT tree, level, place // 16 AS up, list(h ORDER BY place) AS run FROM low WHERE n > 1 GROUP BY ALL),
high_runs AS MATERIALIZED (SELECT level, place // 16 AS up, list(h ORDER BY place) AS run FROM high WHERE n > 1 GROUP BY ALL),
folded AS (
  SELECT doc_id, tree, 0 AS level, place, claimed AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, f.tree, f.level + 1, f.place // 16,
    sha256(array_to_string(run[:f.place % 16] || [f.h] || run[f.place % 16 + 2:], '')),
    proof || array_to_string(run[:f.place % 16] || run[f.place % 16 + 2:], '')
  FROM folded f JOIN low_runs r ON f.tree = r.tree AND f.level = r.level AND f.place // 16 = r.up),
ends AS MATERIALIZED (SELECT doc_id, tree, h, proof FROM folded QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1),
folded_high AS (
  SELECT doc_id, 0 AS level, s.place, e.h, proof FROM ends e JOIN subroots s USING (tree)
  UNION ALL
  SELECT doc_id, f.level + 1, f.place // 16,
    sha256(array_to_string(run[:f.place % 16] || [f.h] || run[f.place % 16 + 2:], '')),
    proof || array_to_string(run[:f.place % 16] || run[f.place % 16 + 2:], '')
  FROM folded_high f JOIN high_runs r ON f.level = r.level AND f.place // 16 = r.up),
told AS (SELECT doc_id, h AS folded_root, sha256(proof) AS proof_sha256 FROM folded_high QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1),
top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN told USING (doc_id), top
"""
