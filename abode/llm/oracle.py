"""DuckDB statements for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from abode.llm.divergence import COMMON_WORDS

_VOCABULARY = ", ".join(f"('{lang}', {i}, '{w}')" for lang, ws in COMMON_WORDS.items() for i, w in enumerate(ws))

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
vocabulary(lang, bin, word) AS (VALUES {_VOCABULARY}),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS tokens,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(tokens[i:i + 7], ' ') AS win
        FROM (SELECT rid, tokens, unnest(range(1, len(tokens) - 6)) AS i FROM w WHERE len(tokens) >= 8)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY rid),
base AS (SELECT w.rid, doc_id, lang, text, tokens, len(tokens) AS n_words, length(array_to_string(tokens, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
        FROM w LEFT JOIN covered ON w.rid = covered.rid),
tok AS (SELECT rid, lower(unnest(tokens)) AS word FROM base),
hits AS (SELECT rid, v.lang, count(*) AS n, min(CASE v.lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END) AS k
        FROM tok JOIN vocabulary v USING (word) GROUP BY rid, v.lang),
best AS (SELECT rid, lang FROM hits QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC, k) = 1),
ref AS (SELECT base.*, CASE WHEN base.lang IN ('en', 'de', 'fr', 'es') THEN base.lang ELSE coalesce(best.lang, 'en') END AS ref_lang,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base LEFT JOIN best ON base.rid = best.rid),
known AS (SELECT ref.rid, v.bin, count(*) AS n FROM tok JOIN ref ON tok.rid = ref.rid
        JOIN vocabulary v ON v.lang = ref.ref_lang AND v.word = tok.word GROUP BY ref.rid, v.bin),
words AS (SELECT rid, bin, n FROM known UNION ALL
        SELECT ref.rid, 24, n_words - coalesce((SELECT sum(n) FROM known WHERE known.rid = ref.rid), 0) FROM ref),
five AS (SELECT rid, length(text) AS size, [length(text) - length(regexp_replace(text, '[a-z]+', '', 'g')),
        length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')), length(text) - length(regexp_replace(text, '[0-9]+', '', 'g')),
        length(text) - length(regexp_replace(text, '[.,;:!?''\"()\-]+', '', 'g')),
        length(text) - length(regexp_replace(text, '[^\x00-\x7F]+', '', 'g')), length(text) - word_chars, n_symbols] AS c FROM ref),
classes AS (SELECT rid, unnest(range(8)) AS bin, unnest(list_append(c, size - list_sum(c))) AS n FROM five),
both_kinds AS (SELECT rid, 'c' AS kind, bin, n FROM classes UNION ALL SELECT rid, 'w', bin, n FROM words),
sums AS (SELECT ref_lang, kind, bin, sum(n) AS n FROM both_kinds JOIN ref USING (rid) WHERE NOT base_failed GROUP BY ALL),
shares AS (SELECT ref_lang, kind, bin, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY ref_lang, kind) AS q FROM sums),
mine AS (SELECT rid, kind, bin, n / CAST(nullif(sum(n) OVER (PARTITION BY rid, kind), 0) AS DOUBLE) AS p FROM both_kinds),
pairs AS (SELECT ref.rid, s.kind, s.bin, q, coalesce(p, 0) AS p FROM ref JOIN shares s ON s.ref_lang = ref.ref_lang
        LEFT JOIN mine ON mine.rid = ref.rid AND mine.kind = s.kind AND mine.bin = s.bin),
far AS (SELECT rid, kind, CASE WHEN sum(p) > 0 THEN round(sqrt(least(greatest(sum(
        CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0), 1)), 6)
        END AS distance FROM pairs GROUP BY rid, kind),
judged AS (SELECT ref.*, c.distance AS class_distance, x.distance AS word_distance,
        coalesce(length(text) >= 300 AND c.distance > 0.25, false) AS far_class,
        coalesce(n_words >= 100 AND x.distance > 0.28, false) AS far_word
        FROM ref LEFT JOIN far c ON c.rid = ref.rid AND c.kind = 'c' LEFT JOIN far x ON x.rid = ref.rid AND x.kind = 'w')
SELECT doc_id, ref_lang, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, class_distance, word_distance,
  concat_ws(',', CASE WHEN far_class THEN 'class_divergence' END, CASE WHEN far_word THEN 'word_divergence' END) AS failed_rules,
  NOT base_failed AND NOT far_class AND NOT far_word AS kept
FROM judged
"""

# CRC-32 bit by bit: the text's bytes as hex pairs, their bits from the lowest, one step of the register for each
_CRC32 = """(4294967295 - list_reduce(
    flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'),
      lambda h: list_transform(range(8), lambda k: (CAST('0x' || h AS BIGINT) >> k) & 1))),
    lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b)), 4294967295))"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents),
sized AS (SELECT rid, doc_id, k, CAST(strlen(text) + 8 AS BIGINT) AS size,
        CAST({_CRC32.format(text="text")} AS BIGINT) AS text_crc32 FROM d),
drawn AS (SELECT rid, s, substr(md5(concat(k, ':', s)), 1, 13) AS u FROM d, (SELECT unnest(range(25)) AS s)),
one AS (SELECT rid, s AS shard FROM drawn WHERE s < 24 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY u DESC, s) = 1),
grown AS (SELECT rid, s AS grown_shard FROM drawn QUALIFY row_number() OVER (PARTITION BY rid ORDER BY u DESC, s) = 1)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws('|', k, size, text_crc32)), 1, 13),
    doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM sized JOIN one USING (rid) JOIN grown USING (rid)
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, encode(source) NULLS LAST) AS k,
        sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM sources),
before AS (SELECT *, total - 3 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
        weights - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM ranked),
level AS (SELECT CAST(left_words AS DOUBLE) / left_weight AS l FROM before
        WHERE weight * (CAST(left_words AS DOUBLE) / left_weight) <= 3 * source_size ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(weight * coalesce((SELECT l FROM level), 0), CAST(3 * source_size AS DOUBLE)) AS target FROM sources),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
body AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS b FROM d),
weighed AS (SELECT *, CASE WHEN length(b) > 0 THEN 0.25 + 0.75 * length(regexp_replace(b, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) / length(b)
        ELSE 0.25 END AS w, md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(text))) AS h FROM body),
keyed AS (SELECT *, exp(ln((CAST(CAST('0x' || substr(h, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / w) AS key FROM weighed),
run AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY key DESC, k.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS reached
        FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE least(3, epochs + CASE WHEN reached - size / 2.0 <= budget THEN 1 ELSE 0 END) * size END AS BIGINT) AS taken
FROM run
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
        regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(t), 10) AS n, array_to_string(t[i:i + 9], ' ') AS win
        FROM (SELECT item, t, unnest(range(1, greatest(len(t) - 9, 1) + 1)) AS i FROM items WHERE len(t) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, n, i, array_to_string(t[i:i + n - 1], ' ') AS win
        FROM (SELECT rid, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, sizes WHERE len(t) >= n)),
found AS (SELECT rid, i, places.n, item FROM places JOIN windows ON places.n = windows.n AND places.win = windows.win),
hit AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM found) GROUP BY rid),
held AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY rid)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN held USING (rid)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(total.total, 0) + v.v)::HUGEINT AS p,
        1 + 1000000000::HUGEINT * (k.lang_n + 1) // (v.lang_total + v.v)::HUGEINT AS lp
        FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN total USING (lang, source)
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
        FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value
        FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
named AS (SELECT lang, source, 'term' AS part, term AS item, (p - lp) * (p - lp) // lp AS value FROM dense WHERE n > 0 AND p > lp),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT * FROM named),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR rank <= 200
"""

ORACLES: dict[str, str] = {
    "op1_distribution_divergence": OP1,
    "op5_rendezvous_shards": OP5,
    "op7_efraimidis_spirakis": OP7,
    "op10_prefix_set_join": OP10,
    "op11_iceberg_divergence": OP11,
}
