"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import collocations, langid, licenses, linededup, media, mixing, ngramjoin, packing, quality, resampling, urlfilter, vptree, warc
from .common import table


def op1_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_warc_normaliser(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


def op3_vantage_point_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.search(vectors, vectors.where(F.col("vec_id") % vptree.EVERY == 0))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_media_container(spark, sf_dir):
    return media.describe(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark, sf_dir):
    return ngramjoin.components(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark, sf_dir):
    return linededup.deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_warc_normaliser,
        op3_vantage_point_search,
        op4_license_scan,
        op5_source_mixing,
        op6_best_fit_packing,
        op7_url_filter,
        op8_media_container,
        op9_ngram_jaccard_join,
        op10_quality_classifier,
        op11_importance_resampling,
        op12_phrase_collocations,
        op13_line_dedup,
    )
}

#: DuckDB SQL of the whole results. The other operators' results hang on learned models, hashes of Spark or packing order.
ORACLES: dict[str, str] = {
    "op2_warc_normaliser": r"""
        WITH p AS (SELECT page_id::BIGINT AS page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        r AS (SELECT *, row_number() OVER w AS k, min(page_id) OVER w AS first_id FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id))
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN k > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN k > 1 AND payload_bytes >= 100 THEN first_id END AS refers_to
        FROM r""",
    "op9_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id::BIGINT AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM d),
        c AS (SELECT g, min(doc_id) AS rid, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
        t AS (SELECT rid, n, unnest(g) AS shingle FROM c),
        links AS (SELECT x.rid AS a, y.rid AS b FROM t x JOIN t y ON x.shingle = y.shingle AND x.rid < y.rid AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
            GROUP BY x.rid, y.rid, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT rid, rid AS other FROM c UNION SELECT reach.rid, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
        named AS (SELECT rid, min(other) AS component_id FROM reach GROUP BY rid)
        SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(named.component_id, s.doc_id) AS component_id
        FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN named ON named.rid = c.rid""",
    "op11_importance_resampling": r"""
        WITH RECURSIVE bits AS (SELECT i AS byte, i::BIGINT AS c, 0 AS step FROM range(256) t(i) UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
        crc_table AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE step = 8),
        d AS (SELECT row_number() OVER () AS row_, doc_id::BIGINT AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        dw AS (SELECT row_, unnest(w) AS word FROM d),
        bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
        hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT)),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM words, crc_table),
        dc AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
        bc AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM dc) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM bc) + 10000)::DOUBLE)))::BIGINT AS g FROM dc LEFT JOIN bc USING (bucket)),
        weights AS (SELECT row_, sum(g)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row_),
        noise AS (SELECT *, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d),
        scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM noise LEFT JOIN weights USING (row_)),
        ordered AS (SELECT *, n_features >= 20 AND doc_id IS NOT NULL AS may, row_number() OVER (PARTITION BY n_features >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= (SELECT count(*) FROM ordered WHERE may) * 10 // 100 THEN place END AS rank FROM ordered""",
    "op12_phrase_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row_, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        pieces AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM p),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        grams AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM words
            UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
            UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
        f AS (SELECT lang, m, phrase, count(*)::BIGINT AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 10),
        cuts AS (SELECT lang, m, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part FROM f, range(1, 3) c(k) WHERE m >= 2 AND k < m),
        scores AS (SELECT cuts.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = left_part AND x.m = k JOIN f y ON y.lang = cuts.lang AND y.phrase = right_part AND y.m = cuts.m - k),
        best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM f WHERE m = 3) GROUP BY lang, phrase),
        kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase AND best.m = 2 WHERE most IS NULL OR 100 * most < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
        QUALIFY rank <= 2000""",
    "op13_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS row_, doc_id::BIGINT AS doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        s AS (SELECT row_, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s),
        hot AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT k.*, largest IS NOT NULL AND doc_id IS DISTINCT FROM largest AS gone FROM k LEFT JOIN hot USING (key))
        SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY row_""",
}
