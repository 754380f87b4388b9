"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op11_ranked_search": f"""WITH given AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
d AS (SELECT r, doc_id, len(terms) AS n, terms FROM given WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT i.item_id, i.term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM i JOIN f USING (term) CROSS JOIN s),
c AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM w JOIN p USING (term) JOIN d USING (r) CROSS JOIN s GROUP BY item_id, doc_id, r),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op13_collocations": rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
p AS (SELECT c.lang, c.k, c.phrase, c.a, c.ws, x.cut, array_to_string(ws[1:x.cut], ' ') AS head, array_to_string(ws[x.cut + 1:], ' ') AS tail FROM c JOIN (VALUES (1), (2)) AS x(cut) ON x.cut < c.k),
s AS (SELECT p.*, h.a AS l, t.a AS r, CAST((CAST(1000000 AS HUGEINT) * p.a * p.a) // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score FROM p JOIN f h ON h.lang = p.lang AND h.phrase = p.head JOIN f t ON t.lang = p.lang AND t.phrase = p.tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM c WHERE k = 3) GROUP BY lang, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.around IS NULL OR 100 * i.around < 50 * b.a)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n ON n.lang = o.lang WHERE o.rank <= 2000""",
    "op3_substring_dedup": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS oid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, oid, unnest(range(1, len(ws) - 11)) AS i, ws FROM d), k AS (SELECT r, oid, i, md5(array_to_string(ws[i:i + 12], ' ')) AS key FROM w),
f AS (SELECT key, min(oid) AS first FROM k GROUP BY key), hit AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (key) WHERE first < oid),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d), kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM p ANTI JOIN hit USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
}
