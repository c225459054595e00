"""DuckDB SQL of the queries that SQL can express: exact results by brute force, for small tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
#: Lower case for A-Z alone.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _word_repeats(length: int) -> str:
    """Words, every window of `length` of them, and what lies under one that starts earlier, too."""
    return f"""WITH split AS (SELECT doc_id, {_WORDS.format(text="text")} AS u FROM documents),
        windows AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS spot, unnest(h) AS h FROM (
            SELECT doc_id, list_transform(range(1, len(u) - {length - 2}), lambda i: md5(array_to_string(u[i : i + {length - 1}], ' '))) AS h FROM split WHERE len(u) >= {length})),
        again AS (SELECT doc_id, spot FROM (SELECT doc_id, spot, row_number() OVER (PARTITION BY h ORDER BY doc_id, spot) AS r FROM windows) WHERE r > 1),
        reached AS (SELECT doc_id, i, CASE WHEN max(spot) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) >= i - {length - 1} THEN 1 ELSE 0 END AS gone
            FROM (SELECT s.doc_id, s.i, a.spot FROM (SELECT doc_id, unnest(range(1, len(u) + 1)) AS i FROM split) s LEFT JOIN again a ON a.doc_id = s.doc_id AND a.spot = s.i)),
        told AS (SELECT doc_id, sum(gone) AS gone, list(i ORDER BY i) FILTER (WHERE gone = 0) AS stay FROM reached GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(u) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_select(u, coalesce(stay, [])), ' ')) AS kept_sha256
        FROM split s LEFT JOIN told t ON t.doc_id = s.doc_id"""


OP1 = _word_repeats(20)

#: As above, over the bytes as pairs of hexadecimal digits.
OP10 = """WITH split AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS u, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    windows AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS spot, unnest(h) AS h FROM (SELECT doc_id, list_transform(range(1, n - 98), lambda i: md5(substring(u, 2 * i - 1, 200))) AS h FROM split WHERE n >= 100)),
    again AS (SELECT doc_id, spot FROM (SELECT doc_id, spot, row_number() OVER (PARTITION BY h ORDER BY doc_id, spot) AS r FROM windows) WHERE r > 1),
    spans AS (SELECT doc_id, min(spot) AS a, max(spot) + 99 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY spot) AS span
        FROM (SELECT *, CASE WHEN spot - lag(spot) OVER (PARTITION BY doc_id ORDER BY spot) <= 100 THEN 0 ELSE 1 END AS fresh FROM again)) GROUP BY doc_id, span),
    gaps AS (SELECT s.doc_id, s.u, s.n, p.a, p.b, coalesce(lag(p.b) OVER w, 0) AS before, lead(p.a) OVER w IS NULL AS final FROM split s LEFT JOIN spans p USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY p.a)),
    kept AS (SELECT doc_id, n, count(a) AS n_spans, coalesce(sum(b - a + 1), 0) AS n_removed,
        string_agg(substring(u, 2 * before + 1, 2 * (coalesce(a, n + 1) - before - 1)) || CASE WHEN final AND a IS NOT NULL THEN substring(u, 2 * b + 1) ELSE '' END, '' ORDER BY coalesce(a, 0)) AS k FROM gaps GROUP BY doc_id, n)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept"""

OP5 = f"""WITH RECURSIVE split AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
    rows_ AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets),
    links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM rows_ a JOIN rows_ b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reached AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN (SELECT x, min(y) AS component_id FROM reached GROUP BY x) ON x = doc_id"""

#: The generator's state wraps spot 64 bits; a key makes one jump a row until it passes the last shard.
OP6 = r"""WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
    crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    sized AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(trim(regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g')), ' '), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) END AS text_crc32
        FROM documents, crcs),
    walk(doc_id, key, spot, jump) AS (SELECT DISTINCT doc_id, CAST(doc_id AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents
        UNION ALL SELECT doc_id, next, jump, CAST(floor((jump + 1) * (2147483648.0 / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
        FROM (SELECT doc_id, jump, (((key % 4294967296) * 2862933555777941757) + ((key // 4294967296) * (2862933555777941757 % 4294967296) % 4294967296) * 4294967296 + 1) % 18446744073709551616 AS next FROM walk WHERE jump <= 40)),
    homes AS (SELECT doc_id, max(jump) FILTER (WHERE jump < 40) AS shard, max(jump) FILTER (WHERE jump < 41) AS grown FROM walk GROUP BY doc_id)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
        row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 64, doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
    FROM sized JOIN homes USING (doc_id)"""

OP9 = """WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

#: Every feature of every text, and all rules at once.
OP11 = rf"""WITH split AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS w FROM documents),
    windows AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS spot, unnest(h) AS h FROM (SELECT doc_id, list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i : i + 7], ' '))) AS h FROM split WHERE len(w) >= 8)),
    again AS (SELECT doc_id, spot FROM (SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id, h) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(spot, spot + 8)) AS i FROM again) GROUP BY doc_id),
    lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
    lines_ AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines FROM lines GROUP BY doc_id),
    told AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes FROM split),
    whole AS (SELECT t.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM told t LEFT JOIN lines_ USING (doc_id) LEFT JOIN covered c USING (doc_id)),
    base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM whole)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
        NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_capitals > n_letters OR 2 * n_echoes > n_words) AS kept FROM base"""

#: The weakest cut is the first of those with the lowest score; phrases are joined by blanks, so lists of words and texts order alike.
OP12 = rf"""WITH split AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
    totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
    phrases AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM lists, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM phrases GROUP BY lang, size, phrase HAVING count(*) >= 10),
    cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest FROM (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
    scores AS (SELECT c.lang, c.size, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
    weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS phrase FROM weakest, (SELECT unnest([1, 2]) AS i) WHERE size = 3) GROUP BY lang, phrase),
    kept AS (SELECT w.* FROM weakest w LEFT JOIN inner_ i USING (lang, phrase) WHERE size = 3 OR most IS NULL OR 100 * most < 50 * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLE_SQL = {"op1_rlz_dedup": OP1, "op5_lsh_forest": OP5, "op6_jump_sharding": OP6, "op9_maxscore": OP9, "op10_suffix_dedup": OP10, "op11_rule_cascade": OP11, "op12_collocations": OP12}
