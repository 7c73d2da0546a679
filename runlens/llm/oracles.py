"""DuckDB SQL of the training-data queries that SQL can express, computed from the source tables."""

from __future__ import annotations

from runlens.llm import urlfilter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_BENCHMARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words(_BENCHMARK_WORD)} AS w FROM documents),
b AS (SELECT item_id, {_words(_BENCHMARK_WORD)} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS words
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, item_id, place.n, i FROM place JOIN win ON place.words = win.words AND place.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

_ESCAPED = "length({0}) + length(regexp_replace({0}, '[^\\\\#<:\\n]', '', 'g'))"

CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_SPACED_WORD = r"[^\x20\x09-\x0D]+"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_SPACED_WORD)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.size + nb.size - c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reached.a, link.b FROM reached JOIN link ON link.a = reached.b),
low AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN low ON low.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: The table of the reflected CRC-32 polynomial, and the checksum of a list of bytes by it.
_CRC_TABLE = """crc AS (SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS tab FROM range(256) t(b))"""


def _crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


_NEXT = "((k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT)"

SHARDING = f"""
WITH RECURSIVE {_CRC_TABLE},
keys AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::UHUGEINT AS k FROM documents),
walk AS (SELECT doc_id, {_NEXT} AS k, 0::BIGINT AS shard FROM keys
         UNION ALL
         SELECT doc_id, {_NEXT}, onto
         FROM (SELECT doc_id, k, floor((shard + 1) * (2147483648::DOUBLE / ((k >> 33::UHUGEINT)::DOUBLE + 1)))::BIGINT AS onto FROM walk)
         WHERE onto < 25),
ends AS (SELECT doc_id, max(shard) FILTER (shard < 24) AS shard, max(shard) AS grown FROM walk GROUP BY doc_id),
sums AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc)
SELECT sums.doc_id, size, text_crc32, 'key' AS law, ends.shard::INT AS shard,
       row_number() OVER (PARTITION BY ends.shard ORDER BY k, size, text_crc32) - 1 AS slot, grown::INT AS grown_shard
FROM sums JOIN ends ON sums.doc_id IS NOT DISTINCT FROM ends.doc_id JOIN keys ON sums.doc_id IS NOT DISTINCT FROM keys.doc_id
"""

_LN_RATIO = "ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE))"

RESAMPLING = f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_BENCHMARK_WORD)} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_words(_BENCHMARK_WORD)}) AS word FROM benchmark),
bucket AS (SELECT word, {_crc32("word")} % 10000 AS b FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN bucket USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN bucket USING (word) GROUP BY b),
gain AS (SELECT b, floor(1000 * {_LN_RATIO})::BIGINT AS gain
         FROM s LEFT JOIN t USING (b), (SELECT count(*) AS all_s FROM dw), (SELECT count(*) AS all_t FROM bw)),
sums AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS g FROM dw JOIN bucket USING (word) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN sums ON sums.r = d.r),
final AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
                  count(*) FILTER (n_features >= 20) OVER () AS eligible FROM final)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= eligible * 10 // 100 THEN place END AS rank
FROM placed
"""

ORACLES = {"op11_sharding": SHARDING, "op13_resampling": RESAMPLING,
           "op1_decontamination": DECONTAMINATION, "op5_url_filter": urlfilter.ORACLE, "op8_chat_format": CHAT,
           "op10_near_duplicates": NEAR_DUPLICATES}
