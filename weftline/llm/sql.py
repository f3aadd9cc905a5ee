"""DuckDB SQL of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op5_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY normal ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY normal) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY normal ORDER BY n_chars DESC, doc_id) AS kept,
       sha256(normal) AS text_sha256
FROM t
"""

SQL["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
    END AS shingles
  FROM w
), n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  WHERE 100 * least(p.n_shingles, q.n_shingles) >= 85 * greatest(p.n_shingles, q.n_shingles)
  GROUP BY x.doc_id, y.doc_id, p.n_shingles, q.n_shingles
  HAVING 100 * count(*) >= 85 * (p.n_shingles + q.n_shingles - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT n.doc_id, n.n_shingles, min(reach.b) AS component_id, n.doc_id = min(reach.b) AS kept
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

SQL["op3_suffix_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS parts
  FROM documents WHERE text IS NOT NULL
), word AS (
  SELECT doc_id, unnest(range(0, len(words))) AS i, unnest(words) AS word, unnest(parts) AS part FROM w
), placed AS (
  SELECT doc_id, i, word, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM word
), windows AS (
  SELECT doc_id, i, stop - length(word) AS start,
         md5(string_agg(word, ' ') OVER f) AS passage, max(stop) OVER f AS stop, count(*) OVER f AS n
  FROM placed WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), repeated AS (
  SELECT * FROM (SELECT *, min(doc_id) OVER p <> max(doc_id) OVER p AS shared
                 FROM windows WHERE n = 50 WINDOW p AS (PARTITION BY passage)) WHERE shared
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM repeated)
)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, min(start) AS start, max(stop) AS "end",
       max(i) + 50 - min(i) AS n_words
FROM runs GROUP BY doc_id, run
"""


def _link_graph(rounds: int = 10) -> str:
    """Rules, seeds and the rounds of spreading, one common table per round."""
    rules = [  # longest first
        ("www.example.com", "/en/", "allow"),
        ("example.com", "/en/", "block"),
        ("net", "/es/", "block"),
        ("net", "/fr/", "block"),
        ("com", "/", "allow"),
    ]

    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = "(?s)^.*?://([^/?#]*)([^?#]*)"
    link = r"""(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)"""
    steps = "".join(
        f""", r{i + 1} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
          SELECT * FROM r0
          UNION ALL SELECT dst, CASE WHEN along THEN 0.85 * trust * weight ELSE 0 END,
            CASE WHEN along THEN 0 ELSE 0.85 * distrust * weight END FROM r{i} JOIN ways ON src = host) GROUP BY host)"""
        for i in range(rounds)
    )
    return f"""WITH parts AS (
      SELECT page_id, html, coalesce(translate(regexp_extract(url, '{url}', 1), '{upper}', '{lower}'), '') AS host,
        coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
    ruled AS MATERIALIZED (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS decided FROM parts),
    links AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1),
        lambda h: translate(h, '{upper}', '{lower}')))) AS dst FROM ruled WHERE host <> ''),
    counted AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND dst <> '' GROUP BY ALL),
    edges AS (SELECT src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY src) AS weight FROM counted),
    ways AS MATERIALIZED (SELECT src, dst, weight, true AS along FROM edges
      UNION ALL SELECT dst, src, weight / sum(weight) OVER (PARTITION BY dst), false FROM edges),
    share AS (SELECT host, count(*) AS n, count(*) FILTER (decided = 'allow') AS allowed, count(*) FILTER (decided = 'block') AS blocked
      FROM ruled WHERE host <> '' GROUP BY host),
    r0 AS MATERIALIZED (SELECT host, CASE WHEN allowed > 0 AND blocked = 0 THEN 0.15::DOUBLE ELSE 0 END AS trust,
        CASE WHEN 2 * blocked >= n THEN 0.15::DOUBLE ELSE 0 END AS distrust
      FROM share WHERE (allowed > 0 AND blocked = 0) OR 2 * blocked >= n){steps},
    bad AS (SELECT host FROM r{rounds} WHERE distrust >= 0.015 AND distrust > trust)
    SELECT page_id, host, path, rule,
      coalesce(decided, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""


SQL["op7_link_graph"] = _link_graph()


def _source_mix() -> str:
    """Targets by the first source (by size a weight) that is not capped; documents by running sums in the order of the hash."""

    def level(k: int, share: str) -> str:
        return f"""level{k} AS (SELECT (round({share} * total)::BIGINT - capped)::DOUBLE / left_weight AS level
          FROM filling WHERE (round({share} * total)::BIGINT - capped)::DOUBLE / left_weight * weight <= 3 * source_size
          ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
        goal{k} AS (SELECT source, source_size, least((SELECT level FROM level{k}) * weight, 3 * source_size) AS target FROM weighted),
        plan{k} AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT // source_size END AS whole,
          floor(target + 0.5)::BIGINT AS words FROM goal{k})"""

    def taken(k: int) -> str:
        rest = f"(p{k}.words - p{k}.whole * p{k}.source_size)"
        return f"size * (p{k}.whole + CASE WHEN before + size <= {rest} OR (before <= {rest} AND 2 * ({rest} - before) > size) THEN 1 ELSE 0 END)"

    shares = {1: "0.25::DOUBLE", 2: "0.5::DOUBLE", 3: "1"}
    return rf"""WITH docs AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15])::BIGINT AS h FROM documents),
    ordered AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position FROM docs GROUP BY source),
    weighted AS (SELECT source, source_size, 1 + position % 3 AS weight FROM ordered),
    filling AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, coalesce(sum(3 * source_size) OVER before_it, 0)::BIGINT AS capped,
        (sum(weight) OVER () - coalesce(sum(weight) OVER before_it, 0))::BIGINT AS left_weight FROM weighted
      WINDOW before_it AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {", ".join(level(k, s) for k, s in shares.items())},
    placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before FROM docs)
    SELECT doc_id, size, p3.source_size, p3.target, {taken(3)} AS taken, {taken(1)} AS quarter, {taken(2)} AS half
    FROM placed d JOIN plan1 p1 ON d.source IS NOT DISTINCT FROM p1.source JOIN plan2 p2 ON d.source IS NOT DISTINCT FROM p2.source
    JOIN plan3 p3 ON d.source IS NOT DISTINCT FROM p3.source"""


SQL["op12_source_mix"] = _source_mix()

SQL["op11_ranked_search"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), docs AS (SELECT r, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
asked AS (
  SELECT q, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, total GROUP BY term, docs
), part AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total.docs) // total.terms))) AS part
  FROM held JOIN weight USING (term) JOIN docs USING (r), total
), scored AS (
  SELECT q, item_id, r, sum(times * part)::BIGINT AS score FROM asked JOIN part USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored JOIN docs USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
