"""DuckDB SQL of the corpus queries that SQL can express."""

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: CRC-32 by half bytes, low one first; the fixed values are the CRC register's steps over four zero bits.
_CRC = """
    xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, 2 * strlen(gram), 2),
        lambda i: [strpos('0123456789ABCDEF', hex(gram)[i + 1]) - 1, strpos('0123456789ABCDEF', hex(gram)[i]) - 1]))),
        lambda c, n: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
                               3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, n) & 15) + 1])))"""

OP11 = f"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, NULL AS item, {_WORDS} AS w FROM documents
    UNION ALL SELECT NULL, NULL, item_id, {_WORDS} FROM benchmark),
grams AS (
    SELECT row, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
    FROM texts, (VALUES (1), (2), (3)) AS lengths(n)),
buckets AS (SELECT gram, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM grams)),
counted AS (SELECT row, bucket, count(*) AS n FROM grams JOIN buckets USING (gram) GROUP BY ALL),
sums AS (
    SELECT bucket, coalesce(sum(n) FILTER (row IS NOT NULL), 0)::bigint AS s, coalesce(sum(n) FILTER (row IS NULL), 0)::bigint AS t
    FROM counted GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::double * ((SELECT sum(s) FROM sums) + 10000)::double
                                   / ((s + 1)::double * ((SELECT sum(t) FROM sums) + 10000)::double)))::bigint AS gain FROM sums),
weights AS (SELECT row, sum(n)::bigint AS n_features, sum(n * gain)::bigint AS weight FROM counted JOIN gains USING (bucket) WHERE row IS NOT NULL GROUP BY row),
scored AS (
    SELECT row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS score
    FROM texts LEFT JOIN weights USING (row) WHERE row IS NOT NULL),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= (SELECT (5 * count(*)) // 100 FROM ranked) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row)"""


def _books(name: str, codes: str) -> str:
    """A round's codebooks: floored means of the parts of each entry, unused entries stay."""
    return f"""
{name} AS (
    SELECT b.p, b.k, CASE WHEN s.n IS NULL THEN b.x ELSE list_transform(s.x, lambda v: floor(v / s.n)::bigint) END AS x
    FROM {codes.replace('codes', 'books')} b LEFT JOIN (
        SELECT p, k, count(*) AS n, [sum(x[1]), sum(x[2]), sum(x[3]), sum(x[4])] AS x FROM {codes} GROUP BY p, k) s USING (p, k))"""


def _codes(name: str, books: str) -> str:
    return f"""
{name} AS (
    SELECT vec_id, p, any_value(x) AS x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT v.vec_id, v.p, v.x, b.k, list_sum(list_transform(range(1, 5), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::bigint AS d
        FROM parts v JOIN {books} b USING (p)) GROUP BY vec_id, p)"""


#: Vectors of 64 components: parts of four.
OP12 = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, x[4 * p + 1:4 * p + 4] AS x FROM kept, range(16) AS r(p)),
books0 AS (SELECT p, rank - 1 AS k, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM kept) USING (vec_id) WHERE rank <= 64),
{_codes('codes0', 'books0')},{_books('books1', 'codes0')},
{_codes('codes1', 'books1')},{_books('books2', 'codes1')},
{_codes('codes2', 'books2')},
coded AS (SELECT vec_id, string_agg(lower(printf('%02X', k)), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM codes2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM books2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""

OP13 = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts),
windows AS (
    SELECT row, unnest(range(len(w) - 34)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS words FROM texts),
repeated AS (SELECT row, i FROM windows WHERE words IN (SELECT words FROM windows GROUP BY words HAVING count(*) > 1)),
gone AS (SELECT DISTINCT row, i + j AS i FROM repeated, range(35) AS r(j)),
kept AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM words ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (row)"""
