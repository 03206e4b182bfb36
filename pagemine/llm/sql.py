"""DuckDB twins of the opN queries that SQL can express."""

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP6 = f"""
WITH lines AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), cells AS (
  SELECT r, doc_id, i, ls[i] AS line, {ASCII_LOWER.format(f"trim(ls[i], {BLANKS})")} AS key
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM lines)
), often AS (
  SELECT key FROM cells WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT any_value(c.doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(c.line, chr(10) ORDER BY c.i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM cells c LEFT JOIN often o ON c.key = o.key
GROUP BY c.r
"""

OP7 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce({WORDS.replace('text', ASCII_LOWER.format('text'))}, []) AS w FROM documents
), grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM words
), cells AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM grams
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM cells x JOIN cells y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT g.doc_id, len(g.g) AS n_shingles, least(g.doc_id, coalesce(min(r.b), g.doc_id)) AS component_id
FROM grams g LEFT JOIN reach r ON g.doc_id = r.a
GROUP BY g.doc_id, g.g
"""

_ROUNDS = 40

OP9 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(len({WORDS}), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM totals
), rounds AS (
  SELECT 0 AS k, source, source_size, w, false AS held FROM weighed
  UNION ALL
  SELECT k + 1, source, source_size, w,
    held OR w * (sum(source_size) OVER () - sum(CASE WHEN held THEN 3 * source_size ELSE 0 END) OVER ())
      > 3 * source_size * sum(CASE WHEN held THEN 0 ELSE w END) OVER ()
  FROM rounds WHERE k < {_ROUNDS}
), last AS (
  SELECT source, source_size, CASE WHEN held THEN (3 * source_size)::DOUBLE
    ELSE (w * (sum(source_size) OVER () - sum(CASE WHEN held THEN 3 * source_size ELSE 0 END) OVER ()))::DOUBLE
      / sum(CASE WHEN held THEN 0 ELSE w END) OVER () END AS target
  FROM rounds WHERE k = {_ROUNDS}
), rated AS (
  SELECT d.doc_id, d.size, l.source_size, l.target, CASE WHEN l.source_size > 0 THEN l.target / l.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
  FROM docs d JOIN last l ON d.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

LICENSE_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op2() -> str:
    """Brute force: every window of a notice's length against the notice, all word sets in full."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    notices = ", ".join(f"({at}, {quoted(label)}, {quoted(text)}, {quoted(must)})" for at, (label, text, must) in enumerate(NOTICES))
    words = LICENSE_WORDS.format(ASCII_LOWER.format("{}"))
    places = " || ".join(
        "list_transform(list_filter(range(1, len(w) + 1), lambda i: "
        + " AND ".join(f"coalesce(w[i + {at}], '') = {quoted(word)}" for at, word in enumerate(phrase.split()))
        + f"), lambda i: {{'at': i - 1, 'label': {quoted(label)}}})"
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
    )
    return f"""
WITH templates AS (
  SELECT id, label, must, len(sequence) AS span, list_distinct(sequence) AS ws
  FROM (SELECT id, label, must, {words.format("notice")} AS sequence FROM (VALUES {notices}) AS t(id, label, notice, must))
), docs AS (
  SELECT doc_id, coalesce({words.format("coalesce(text, '')")}, []) AS w, row_number() OVER () AS r FROM documents
), possible AS (
  SELECT r, w, label, must, span, ws FROM docs, templates WHERE list_contains(w, must) AND len(list_intersect(w, ws)) >= 0.8 * len(ws)
), ends AS (
  SELECT r, label, must, ws, w[greatest(1, i - span + 1):i] AS held FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM possible)
), blocks AS (
  SELECT r, label, len(list_intersect(held, ws))::DOUBLE / len(ws) AS containment FROM ends
  WHERE list_contains(held, must) AND len(list_intersect(held, ws)) >= 0.8 * len(ws)
), found AS (
  SELECT r, list(DISTINCT label) AS labels, max(containment) AS best FROM blocks GROUP BY r
), phrases AS (
  SELECT r, doc_id, len(w) AS n_words, {places} AS p FROM docs
)
SELECT doc_id, n_words, len(p)::BIGINT AS n_base,
  list_min(list_transform(p, lambda x: x['at'])) AS first_word, list_max(list_transform(p, lambda x: x['at'])) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x['label']))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x['label']) || coalesce(labels, []))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM phrases LEFT JOIN found USING (r)
"""


#: Fixed values, restated: the notices op2 looks for.
NOTICES = (
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "software"),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "sharealike"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "nc"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "copyright"),
)

OP3 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(s.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(s.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.a LEFT JOIN smallest s ON e.vec_id = s.a
"""

OP10 = """
WITH facts AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), last AS (
  SELECT payload_digest, max(page_id) AS last FROM facts WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, f.payload_digest,
  CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM facts f LEFT JOIN last l ON f.payload_digest = l.payload_digest
"""



def _op12(k: int = 40, width: int = 64, rounds: int = 5) -> str:
    """All vectors against all centroids in every round."""
    steps = []
    for at in range(rounds + 1):
        steps.append(f"""near{at} AS (
  SELECT r, min({{'d': list_sum(list_transform(range(1, {width + 1}), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i])))::BIGINT, 'c': y.c}}) AS best
  FROM vectors x CROSS JOIN centroids{at} y GROUP BY r
)""")
        if at < rounds:
            steps.append(f"""sums{at} AS (
  SELECT best['c'] AS c, i, sum(v[i]) AS s, count(*) AS n
  FROM (SELECT best, v, unnest(range(1, {width + 1})) AS i FROM near{at} JOIN vectors USING (r)) GROUP BY best['c'], i
), centroids{at + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.v, o.v) AS v FROM centroids{at} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM sums{at} GROUP BY c
  ) m USING (c)
)""")
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM vectors ORDER BY c LIMIT {k}
), {", ".join(steps)}, found AS (
  SELECT vec_id, best['c']::INTEGER AS cluster, best['d'] AS distance FROM near{rounds} JOIN vectors USING (r)
)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM found JOIN centroids{rounds} ON c = cluster
"""


OP13 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    {ASCII_LOWER.format("coalesce(text, '')")} AS text FROM documents
), occurrences AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT lang, coalesce(sum(lang_n), 0)::HUGEINT AS total, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM occurrences JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
), parts AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM cells WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES = {"op13_source_divergence": OP13, "op12_centroid_clusters": _op12(), "op2_license_scan": _op2(), "op3_embedding_dedup": OP3, "op10_warc_index": OP10, "op6_line_dedup": OP6, "op7_ngram_join": OP7, "op9_mixing": OP9}
