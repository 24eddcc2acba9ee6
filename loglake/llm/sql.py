"""DuckDB SQL that the registered queries must agree with."""

from .shards import LEVEL_BITS, PREFIX, _transitions, size_steps


def _crc_table() -> list[int]:
    """The reflected CRC-32 of each four bits."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, four bits at a time, low ones first."""
    digits = f"string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), '')"
    bits = f"list_transform({digits}, lambda d: strpos('0123456789ABCDEF', d)::BIGINT - 1)"
    table = f"{_crc_table()}::BIGINT[]"
    folded = f"list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, x: xor(c >> 4, ({table})[1 + (xor(c, x) & 15)]))"
    return f"CASE WHEN {text} = '' THEN 0 WHEN {text} IS NOT NULL THEN xor({folded}, 4294967295::BIGINT) END"


def _category_starts(column: str) -> str:
    """One row with the first value of each level of a category, in order."""
    levels = (1 << LEVEL_BITS) - 1
    return f"""(
        SELECT list(v ORDER BY v) AS {column}_starts FROM (
            SELECT min(v) AS v FROM (
                SELECT v, CASE WHEN count(*) OVER () <= {levels} THEN row_number() OVER (ORDER BY v)
                               ELSE (sum(n) OVER (ORDER BY v) - n) * {levels} // sum(n) OVER () END AS level
                FROM (SELECT left({column}, {PREFIX}) AS v, count(*) AS n FROM documents
                      WHERE {column} IS NOT NULL GROUP BY 1)
            ) GROUP BY level
        )
    )"""


def _category_level(column: str) -> str:
    return f"coalesce(len(list_filter({column}_starts, lambda start: start <= left({column}, {PREFIX}))), 0)"


def _hilbert_shards(shards: int = 24) -> str:
    digits, following = _transitions(3)
    walk = "levels"
    for bit in reversed(range(LEVEL_BITS)):
        octant = f"(((a >> {bit}) & 1) + 2 * ((b >> {bit}) & 1) + 4 * ((c >> {bit}) & 1))"
        walk = f"""(SELECT * EXCLUDE (curve, state), curve * 8 + ({digits})[1 + state * 8 + {octant}] AS curve,
                   ({following})[1 + state * 8 + {octant}] AS state FROM {walk})"""
    return f"""
    WITH facts AS (
        SELECT doc_id, source, lang, coalesce(octet_length(encode(text)), 0) + 8 AS size,
               {_crc32('text')} AS text_crc32
        FROM documents
    ),
    levels AS (
        SELECT doc_id, size, text_crc32, 0::BIGINT AS curve, 0 AS state,
               {_category_level('source')} AS a, {_category_level('lang')} AS b,
               len(list_filter({size_steps()}, lambda step: step <= size)) AS c
        FROM facts, {_category_starts('source')}, {_category_starts('lang')}
    ),
    ranked AS (
        SELECT *, row_number() OVER (ORDER BY curve, doc_id) - 1 AS r, count(*) OVER () AS n FROM {walk}
    ),
    cut AS (
        SELECT *, CASE WHEN r < (n % {shards}) * (n // {shards} + 1) THEN r // (n // {shards} + 1)
                       ELSE n % {shards} + (r - (n % {shards}) * (n // {shards} + 1)) // (n // {shards}) END AS shard
        FROM ranked
    )
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot,
           CAST(NULL AS INTEGER) AS grown_shard, curve
    FROM cut
"""


HILBERT_SHARDS = _hilbert_shards()

LINE_DEDUP = """
    WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    windows AS (
        SELECT doc_id, pos, [ls[pos + 1], ls[pos + 2], ls[pos + 3]] AS w
        FROM texts, unnest(generate_series(0, len(ls) - 3)) AS s(pos) WHERE len(ls) >= 3
    ),
    ranked AS (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS place
        FROM windows WHERE trim(array_to_string(w, ''), ' ') <> ''
    ),
    covered AS (
        SELECT doc_id, list_distinct(flatten(list([pos + 1, pos + 2, pos + 3]))) AS gone
        FROM ranked WHERE place > 1 GROUP BY doc_id
    ),
    kept AS (
        SELECT t.doc_id, text, coalesce(len(ls), 0) AS n, gone,
               list_filter(ls, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS k
        FROM texts t LEFT JOIN covered USING (doc_id)
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(coalesce(n - len(k), 0) AS BIGINT) AS n_removed,
           sha256(coalesce(array_to_string(k, chr(10)), '')) AS kept_sha256
    FROM kept
"""

PARETO_MIX = """
    WITH read AS (
        SELECT doc_id, source,
               coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
               (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || coalesce(text, '')), 1, 13) AS BIGINT)
                + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
        FROM documents
    ),
    docs AS (
        SELECT *, CASE WHEN size < 64 THEN 0.5::DOUBLE WHEN size < 512 THEN 1::DOUBLE ELSE 2::DOUBLE END AS w FROM read
    ),
    weighed AS (
        SELECT source, source_size, CAST(2 * source_size AS DOUBLE) AS cap,
               [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][
                   1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)
    ),
    levels AS (
        SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                   - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM weighed
    ),
    targets AS (
        SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels
    ),
    classes AS (SELECT source, w, CAST(sum(size) AS DOUBLE) AS words FROM docs GROUP BY source, w),
    reached AS (
        SELECT t.*, (t.target - coalesce(sum(2 * words) OVER (PARTITION BY t.source ORDER BY w DESC
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / nullif(sum(words * w) OVER (PARTITION BY t.source ORDER BY w DESC
                                                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate
        FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
    ),
    rates AS (
        SELECT source, source_size, target, coalesce(max(rate), 0) AS rate FROM reached
        GROUP BY source, source_size, target
    ),
    ranked AS (
        SELECT d.doc_id, d.size, d.u, t.*, least(t.rate * d.w, 2) AS e
        FROM docs d JOIN rates t ON d.source IS NOT DISTINCT FROM t.source
    ),
    odds AS (
        SELECT *, CAST(floor(e) AS BIGINT) AS certain,
               greatest(1e-9::DOUBLE, least(1 - 1e-9::DOUBLE, e - floor(e))) AS p FROM ranked
    ),
    running AS (
        SELECT *, sum(size) OVER (PARTITION BY source ORDER BY
                       CASE WHEN certain < 2 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id, size
                       ROWS UNBOUNDED PRECEDING) AS so_far,
               target - sum(size * certain) OVER (PARTITION BY source) AS rest
        FROM odds
    )
    SELECT doc_id, size, source_size, target,
           CAST(size * (certain + CASE WHEN certain < 2 AND so_far - size / 2 < rest THEN 1 ELSE 0 END) AS BIGINT)
               AS taken
    FROM running
"""

SUBSTRING_DEDUP = """
    WITH texts AS (
        SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents
    ),
    windows AS (
        SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + 13], ' ')) AS w
        FROM texts, unnest(generate_series(0, len(ws) - 13)) AS s(pos) WHERE len(ws) >= 13
    ),
    marked AS (
        SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS earliest FROM windows)
        WHERE doc_id > earliest
    ),
    words AS (
        SELECT doc_id, i, ws[i + 1] AS word FROM texts, unnest(generate_series(0, len(ws) - 1)) AS s(i)
        WHERE len(ws) > 0
    ),
    removed AS (
        SELECT DISTINCT doc_id, pos + step AS i FROM marked, unnest(generate_series(0, 12)) AS s(step)
    ),
    kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS k
        FROM words ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(k, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)
"""

ARCHIVED_PAGES = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
placed AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) || '0' AS hex,
    row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS place,
    first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS first_page
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((((instr('0123456789abcdef', substr(hex, (5 * k // 4 + 1)::BIGINT, 1)) - 1) * 16
      + instr('0123456789abcdef', substr(hex, (5 * k // 4 + 2)::BIGINT, 1)) - 1)
      >> (3 - (5 * k) % 4)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_page END AS refers_to
FROM placed
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, c.vec_id, c.row, a.label = c.label AS same,
    list_dot_product(a.vec, c.vec)::BIGINT AS score
  FROM v a JOIN v c ON a.row <> c.row
  WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) AS place
  FROM scored WHERE same),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id, n.row) AS place
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= 3
"""
