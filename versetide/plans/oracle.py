"""The queries once more as plain SQL over the tables, for the comparison."""

from __future__ import annotations

SEED = 42
DAY = "2024-02-01"
VOCAB = (
    "EraECONOMY", "EraLARGE", "EraMEDIUM", "EraPROMO", "EraSMALL", "EraSTANDARD",
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red", "ring", "rod",
    "small", "widget",
)

K = "json_extract_string(props, '$.k')"

ACCESS_LOG = f"""
access_log AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS "userId",
    CASE WHEN event_type = 'signup' AND value < 35 THEN 'search?kw=a' WHEN value < 250 THEN '/poem' END AS url,
    CASE WHEN value >= 200 AND value < 205 THEN '[log]login' ELSE '[log]svc[fn]' ||
      CASE event_type WHEN 'view' THEN 'showPoetryDetails' WHEN 'click' THEN 'toPoemDetails'
        WHEN 'purchase' THEN 'collectPoem' WHEN 'error' THEN 'evaluatePoem' ELSE 'collectAuthor' END
    END AS full_method,
    CASE WHEN value < 0.6 THEN 'bad'
      WHEN event_type = 'view' THEN 'id=' || {K} || '&from=list'
      WHEN event_type = 'click' THEN 'poemId=' || {K}
      WHEN event_type = 'purchase' THEN 'poemId=' || {K} || '&collection=' ||
        CASE WHEN value < 20 THEN '0' WHEN value < 25 THEN '00' ELSE '1' END
      WHEN event_type = 'error' THEN 'like=' ||
        CASE WHEN value < 20 THEN '0' WHEN value < 25 THEN '00' ELSE '1' END || '&poemId=' || {K}
    END AS parameter
  FROM events
), clean AS (
  SELECT "userId", parameter, split_part(full_method, ']', 3) AS method
  FROM access_log
  WHERE NOT starts_with(url, 'search')
    AND split_part(full_method, ']', 3) IN ('showPoetryDetails', 'collectPoem', 'evaluatePoem', 'toPoemDetails')
)"""

SCORES = ACCESS_LOG + """, by_method AS (
  SELECT method, CAST("userId" AS BIGINT) AS "userId", TRY_CAST(NULLIF(regexp_extract(parameter, 'poemId=(.+)', 1), '') AS INTEGER) AS "itemId", NULL AS flag
  FROM clean WHERE method = 'toPoemDetails'
  UNION ALL
  SELECT method, CAST("userId" AS BIGINT), TRY_CAST(NULLIF(regexp_extract(parameter, 'd=(.*?)&', 1), '') AS INTEGER), NULL
  FROM clean WHERE method = 'showPoetryDetails'
  UNION ALL
  SELECT method, CAST("userId" AS BIGINT), TRY_CAST(NULLIF(regexp_extract(parameter, 'poemId=(.*?)&collection=(.+)', 1), '') AS INTEGER),
    NULLIF(regexp_extract(parameter, 'poemId=(.*?)&collection=(.+)', 2), '')
  FROM clean WHERE method = 'collectPoem'
  UNION ALL
  SELECT method, CAST("userId" AS BIGINT), TRY_CAST(NULLIF(regexp_extract(parameter, 'like=(.+)&poemId=(.+)', 2), '') AS INTEGER),
    NULLIF(regexp_extract(parameter, 'like=(.+)&poemId=(.+)', 1), '')
  FROM clean WHERE method = 'evaluatePoem'
), scored AS (
  SELECT method, "userId", "itemId",
    CASE WHEN method IN ('toPoemDetails', 'showPoetryDetails') THEN "itemId" * 0 + 1
      WHEN flag = '0' THEN -2 WHEN flag IS NOT NULL THEN 2 END AS rating
  FROM by_method
)"""

USER_LOG = SCORES + """, summed AS (
  SELECT "userId", "itemId", CAST(SUM(rating) AS BIGINT) AS rating FROM scored GROUP BY ALL
), user_log AS (
  SELECT *, CASE WHEN rating > 0 THEN 1 ELSE 0 END AS label FROM summed
)"""

SAMPLE = USER_LOG + f""", impressions AS (
  SELECT o_orderkey AS "impressionId", o_custkey AS "userId", list(DISTINCT CAST(l_partkey AS INTEGER)) AS items
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
), wanted AS (
  SELECT GREATEST(0, CAST(FLOOR((COUNT(*) FILTER (WHERE label = 1) - COUNT(*) FILTER (WHERE label = 0)) / 10.0) AS BIGINT)) AS n
  FROM user_log
), drawn AS (
  SELECT * FROM impressions
  QUALIFY ROW_NUMBER() OVER (ORDER BY md5('{SEED}:' || "impressionId"), "impressionId") <= (SELECT n FROM wanted)
), shown AS (
  SELECT "impressionId", "userId", UNNEST(items) AS "itemId" FROM drawn
)"""

# the group sum over log and negatives, as a check of the anti join
SAMPLES = SAMPLE + """, samples AS (
  SELECT "userId", "itemId", CAST(SUM(rating) AS BIGINT) AS rating,
    CASE WHEN SUM(rating) > 0 THEN 1 ELSE 0 END AS label
  FROM (SELECT "userId", "itemId", rating FROM user_log UNION ALL SELECT "userId", "itemId", 0 FROM shown)
  GROUP BY "userId", "itemId"
)"""

ITEMS = """
items AS (
  SELECT CAST(p_partkey AS INTEGER) AS "poemId", CAST(split_part(p_brand, '#', 2) AS INTEGER) + 200000 AS "poemAuthorId",
    CAST(p_size AS DOUBLE) AS "poemStar", 'Era' || p_type AS "poemDynasty", replace(p_name, ' ', ',') AS "poemTagNames"
  FROM part
), item_terms AS (
  SELECT DISTINCT "poemId", UNNEST(list_prepend("poemDynasty", string_split("poemTagNames", ','))) AS term FROM items
)"""

FAVOURITES = """
favourites AS (
  SELECT DISTINCT o_custkey AS "userId", CAST(split_part(p_brand, '#', 2) AS BIGINT) + 200000 AS author
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
  WHERE l_quantity >= 45
)"""

INDICATORS = ", ".join(
    f"""CAST(list_contains(list_prepend("poemDynasty", string_split("poemTagNames", ',')), '{v}') AS BIGINT) AS "{v}" """
    for v in VOCAB
)

TAG_INDEX = ITEMS + f""", tag_index AS (
  SELECT term AS tag,
    ROW_NUMBER() OVER (PARTITION BY term ORDER BY md5('{SEED}:' || term || ':' || "poemId"), "poemId") - 1 AS pos,
    "poemId" AS "itemId", COUNT(*) OVER (PARTITION BY term) AS n
  FROM item_terms
)"""

RECENT = """
last_actions AS (
  SELECT user_id AS "userId", event_id, ts,
    CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS "itemId",
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS pos
  FROM events
), recent AS (
  SELECT "userId", pos, a."itemId" AS "itemId", "poemDynasty" AS dynasty, "poemTagNames" AS tag_names
  FROM last_actions a LEFT JOIN items i ON a."itemId" = i."poemId" WHERE pos < 11
)"""

SIMILAR = """
vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
  SELECT a.vec_id AS "poemId", b.vec_id AS "similarId", round(list_cosine_similarity(a.v, b.v), 6) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
), similar_items AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY "poemId" ORDER BY score DESC, "similarId") AS rank
  FROM pairs QUALIFY rank <= 100
)"""

RECALL = TAG_INDEX + "," + RECENT + "," + SIMILAR + f""", entry_tags AS (
  SELECT DISTINCT "userId", UNNEST(list_prepend(dynasty, string_split(tag_names, ','))) AS tag
  FROM recent WHERE dynasty IS NOT NULL
), drawn_tags AS (
  SELECT "userId", tag FROM entry_tags JOIN customer ON "userId" = c_custkey
  QUALIFY ROW_NUMBER() OVER (PARTITION BY "userId" ORDER BY md5('{SEED}:' || "userId" || ':' || tag), tag) <= 5
), tags AS (
  SELECT "userId", tag FROM drawn_tags
  UNION ALL
  SELECT c_custkey, UNNEST(['EraECONOMY', 'small', 'ring']) FROM customer
  WHERE c_custkey NOT IN (SELECT "userId" FROM drawn_tags)
), starts AS (
  SELECT "userId", tag, n, CAST('0x' || substr(md5('{SEED}:' || "userId" || ':' || tag), 1, 8) AS BIGINT) % n AS start
  FROM tags JOIN (SELECT DISTINCT tag, n FROM tag_index) USING (tag)
), candidates AS (
  SELECT "userId", x."itemId" FROM starts s JOIN tag_index x
    ON s.tag = x.tag AND (x.pos - s.start + s.n) % s.n < 5
  UNION
  SELECT "userId", "similarId" FROM recent JOIN similar_items ON "itemId" = "poemId"
  WHERE rank <= 10 AND "userId" IN (SELECT c_custkey FROM customer)
)"""

PURCHASES = """
ratings AS (
  SELECT o_custkey AS "userId", l_partkey AS "itemId", AVG(l_quantity) / 10 AS rating
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
), overall AS (SELECT AVG(rating) AS mean FROM ratings),
item_bias AS (
  SELECT "itemId", round(SUM(rating - mean) / (10.0 + COUNT(*)), 10) AS b FROM ratings, overall GROUP BY ALL
), user_bias AS (
  SELECT "userId", round(SUM(rating - mean - b) / (15.0 + COUNT(*)), 10) AS u
  FROM ratings JOIN item_bias USING ("itemId"), overall GROUP BY "userId"
)"""

BASE_TOP = PURCHASES + """, best AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY b DESC, "itemId") AS rank FROM item_bias QUALIFY rank <= 100
), base_top AS (
  SELECT "userId", "itemId", rank, GREATEST(-2.0, LEAST(5.0, mean + u + b)) AS score FROM user_bias, best, overall
)"""

HEADERS = f"""
SELECT event_id AS "eventId", CAST(user_id AS VARCHAR) AS "userId",
  CASE WHEN event_type = 'error' THEN '' END AS age,
  CASE WHEN event_type = 'view' THEN 'ab' END AS name,
  CASE WHEN event_type <> 'signup' THEN {K} END AS "itemId",
  CASE event_type WHEN 'error' THEN '0' WHEN 'click' THEN '1' END AS click
FROM events"""

RECENT_ROWS = "WITH " + ITEMS + "," + RECENT + """
SELECT "userId", pos, "itemId", CASE WHEN dynasty IS NULL THEN '' ELSE dynasty || '-' || replace(tag_names, ',', '-') END AS tags
FROM recent"""

JOINED = """
SELECT "userId", "itemId", rating, label, {columns}
FROM user_log JOIN items ON "itemId" = "poemId" WHERE rating IS NOT NULL AND "userId" IS NOT NULL"""

WORDS = r"""cut AS (
  SELECT doc_id, regexp_extract_all(lower(text), '\p{Han}|[^\P{L}\p{Han}]+') AS tokens FROM documents
)"""
GIVEN = WORDS + """, tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, UNNEST(tokens) AS term FROM cut) GROUP BY ALL),
terms AS (
  SELECT term, CAST(round(ln(((SELECT COUNT(*) FROM documents) + 1.0) / (COUNT(*) + 1)) * 1000000) AS BIGINT) AS weight,
    UNNEST(range(8)) AS place FROM tf GROUP BY term
), valued AS (
  SELECT term, weight, place, CAST(round(weight * CAST(round(
    (CAST('0x' || substr(md5(term), CAST(2 * place + 1 AS BIGINT), 2) AS INTEGER) / 255 - 0.5) * 100000000) AS BIGINT) / 1000000) AS BIGINT) AS units
  FROM terms WHERE weight > 0
), given AS (
  SELECT doc_id AS "docId", CAST(place AS INTEGER) AS place, round(SUM(tf * units) / (SUM(tf * weight) * 100.0), 8) AS value
  FROM tf JOIN valued USING (term) GROUP BY doc_id, place
)"""

CELLS = SAMPLES + "," + ITEMS + "," + FAVOURITES + """, ranker_terms AS (
  SELECT term, ROW_NUMBER() OVER (ORDER BY md5('term:' || term), term) + 1 AS place FROM (
    SELECT term FROM item_terms UNION SELECT 'sex=' || c_mktsegment FROM customer)
), rated AS (
  SELECT s."userId", s."itemId", "poemStar", c_mktsegment, CASE WHEN author IS NULL THEN 0.0 ELSE 1.0 END AS favourite
  FROM samples s JOIN items ON s."itemId" = "poemId" JOIN customer ON s."userId" = c_custkey
    LEFT JOIN favourites f ON f."userId" = s."userId" AND author = "poemAuthorId"
), cells AS (
  SELECT "userId", "itemId", 0 AS place, "poemStar" AS value FROM rated
  UNION ALL SELECT "userId", "itemId", 1, favourite FROM rated
  UNION ALL SELECT "userId", "itemId", place, 1 FROM rated JOIN item_terms ON "poemId" = "itemId" JOIN ranker_terms USING (term)
  UNION ALL SELECT "userId", "itemId", place, 1 FROM rated JOIN ranker_terms ON term = 'sex=' || c_mktsegment
)"""

ORACLE = {
    "access_log_clean": "WITH " + ACCESS_LOG + ' SELECT "userId", parameter, method FROM clean',
    "event_scores": "WITH " + SCORES + ' SELECT "userId", "itemId", rating FROM scored',
    "engagement_ratings": "WITH " + USER_LOG + ' SELECT "userId", "itemId", rating, label FROM user_log',
    "label_balance": "WITH " + USER_LOG + " SELECT label, COUNT(*) AS n FROM user_log GROUP BY label",
    "parse_report": "WITH " + SCORES + """
SELECT method, COUNT(*) AS events, COUNT(*) FILTER (WHERE "itemId" IS NULL) AS no_item,
  COUNT(*) FILTER (WHERE rating IS NULL) AS no_rating
FROM scored GROUP BY method""",
    "impression_sample": "WITH " + SAMPLE + ' SELECT "impressionId", "userId", "itemId" FROM shown',
    "negatives_added": "WITH " + SAMPLES + ' SELECT "userId", "itemId", rating, label FROM samples',
    "items_joined": "WITH " + USER_LOG + "," + ITEMS + JOINED.format(columns='"poemId", "poemAuthorId", "poemStar"'),
    "csv_items": "WITH " + USER_LOG + "," + ITEMS + JOINED.format(
        columns='"poemAuthorId", "poemStar", ' + INDICATORS),
    "training_set": "WITH " + SAMPLES + "," + ITEMS + "," + FAVOURITES + f"""
SELECT s."userId", s."itemId", rating, label, "poemStar", {INDICATORS}, c_mktsegment AS "userSex",
  CASE WHEN author IS NULL THEN 0 ELSE 1 END AS "collectAuthor"
FROM samples s JOIN items ON s."itemId" = "poemId" JOIN customer ON s."userId" = c_custkey
  LEFT JOIN favourites f ON f."userId" = s."userId" AND author = "poemAuthorId"
WHERE rating IS NOT NULL""",
    "training_sparse": "WITH " + SAMPLES + "," + ITEMS + "," + FAVOURITES + """, term_ids AS (
  SELECT term, ROW_NUMBER() OVER (ORDER BY md5('term:' || term), term) - 1 AS id FROM (SELECT DISTINCT term FROM item_terms)
), indicators AS (
  SELECT "poemId" AS poem, string_agg(id, ' ' ORDER BY id) AS ids FROM item_terms JOIN term_ids USING (term) GROUP BY "poemId"
)
SELECT s."userId", s."itemId", rating, label, "poemStar", ids AS indicators, c_mktsegment AS "userSex",
  CASE WHEN author IS NULL THEN 0 ELSE 1 END AS "collectAuthor"
FROM samples s JOIN items ON s."itemId" = "poemId" JOIN customer ON s."userId" = c_custkey JOIN indicators ON poem = "poemId"
  LEFT JOIN favourites f ON f."userId" = s."userId" AND author = "poemAuthorId"
WHERE rating IS NOT NULL""",
    "multi_hot": "WITH " + ITEMS + ' SELECT "poemId", term, CAST(1 AS DOUBLE) AS value FROM item_terms',
    "tag_index": "WITH " + TAG_INDEX + ' SELECT tag, pos, "itemId", n FROM tag_index',
    "tag_lists": "WITH " + TAG_INDEX + """
SELECT tag, pos // 10000 AS chunk, n, pos % 10000 AS place, "itemId" FROM tag_index""",
    "recent_activity": RECENT_ROWS,
    "stream_recent": RECENT_ROWS,
    "recall_candidates": "WITH " + RECALL + ' SELECT "userId", "itemId" FROM candidates',
    "tfidf_weights": r"""
WITH words AS (
  SELECT doc_id, UNNEST(regexp_extract_all(lower(text), '\p{Han}|[^\P{L}\p{Han}]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term)
SELECT doc_id AS "docId", term, tf, df,
  round(tf * ln(((SELECT COUNT(*) FROM documents) + 1.0) / (df + 1)), 4) AS weight
FROM tf JOIN df USING (term)""",
    "similar_exact": "WITH " + SIMILAR + """
SELECT "poemId", rank, "similarId", CAST(round(score * 1000000) AS BIGINT) AS micros FROM similar_items""",
    "most_similar": "WITH " + SIMILAR + """
SELECT "poemId", '[' || string_agg("similarId", ',' ORDER BY rank) || ']' AS payload
FROM similar_items WHERE rank <= 10 GROUP BY "poemId" """,
    "cf_baseline": "WITH " + PURCHASES + """
SELECT "userId", "itemId", round(GREATEST(-2.0, LEAST(5.0, mean + u + b)), 4) AS prediction
FROM ratings JOIN user_bias USING ("userId") JOIN item_bias USING ("itemId"), overall""",
    "cf_baseline_top": "WITH " + BASE_TOP + ' SELECT "userId", "itemId", rank, round(score, 4) AS score FROM base_top',
    "daily_list": "WITH " + BASE_TOP + f""", daily AS (
  SELECT "userId", "itemId",
    ROW_NUMBER() OVER (PARTITION BY "userId" ORDER BY md5('{DAY}:' || "userId" || ':' || "itemId"), "itemId") AS place
  FROM base_top QUALIFY place <= 10
), lists AS (
  SELECT "userId", '[' || string_agg("itemId", ',' ORDER BY place) || ']' AS items FROM daily GROUP BY "userId"
)
SELECT c_custkey AS "userId", '{{"rijian":' || COALESCE(items, 'null') || '}}' AS payload
FROM customer LEFT JOIN lists ON "userId" = c_custkey""",
    "guess_by_star": "WITH " + RECALL + "," + FAVOURITES + """, ranked AS (
  SELECT c."userId", c."itemId", ROW_NUMBER() OVER (PARTITION BY c."userId"
    ORDER BY "poemStar" + CASE WHEN author IS NULL THEN 0 ELSE 100 END DESC, c."itemId") AS rank
  FROM candidates c JOIN items ON c."itemId" = "poemId"
    LEFT JOIN favourites f ON f."userId" = c."userId" AND author = "poemAuthorId"
  QUALIFY rank <= 10
)
SELECT "userId", '{"rs":[' || string_agg("itemId", ',' ORDER BY rank) || ']}' AS payload
FROM ranked GROUP BY "userId" """,
    "guess_strangers": "WITH " + RECALL + "," + FAVOURITES + """, ranked AS (
  SELECT c."userId", c."itemId", ROW_NUMBER() OVER (PARTITION BY c."userId"
    ORDER BY "poemStar" + CASE WHEN author IS NULL OR "poemStar" % 2 <> 0 THEN 0 ELSE 100 END DESC, c."itemId") AS rank
  FROM candidates c JOIN items ON c."itemId" = "poemId"
    LEFT JOIN favourites f ON f."userId" = c."userId" AND author = "poemAuthorId"
  QUALIFY rank <= 10
)
SELECT "userId", '{"rs":[' || string_agg("itemId", ',' ORDER BY rank) || ']}' AS payload
FROM ranked GROUP BY "userId" """,
    "impression_loop": "WITH " + USER_LOG + "," + RECALL + "," + FAVOURITES + f""", ranked AS (
  SELECT c."userId", c."itemId", ROW_NUMBER() OVER (PARTITION BY c."userId"
    ORDER BY "poemStar" + CASE WHEN author IS NULL THEN 0 ELSE 100 END DESC, c."itemId") AS rank
  FROM candidates c JOIN items ON c."itemId" = "poemId"
    LEFT JOIN favourites f ON f."userId" = c."userId" AND author = "poemAuthorId"
  QUALIFY rank <= 10
), wanted AS (
  SELECT GREATEST(0, CAST(FLOOR((COUNT(*) FILTER (WHERE label = 1) - COUNT(*) FILTER (WHERE label = 0)) / 10.0) AS BIGINT)) AS n
  FROM user_log
), drawn AS (
  SELECT "userId" FROM (SELECT DISTINCT "userId", '{DAY}:r1:' || "userId" AS id FROM ranked)
  QUALIFY ROW_NUMBER() OVER (ORDER BY md5('{SEED}:' || id), id) <= (SELECT n FROM wanted)
)
SELECT "userId", "itemId", CAST(SUM(rating) AS BIGINT) AS rating, CASE WHEN SUM(rating) > 0 THEN 1 ELSE 0 END AS label
FROM (SELECT "userId", "itemId", rating FROM user_log UNION ALL SELECT "userId", "itemId", 0 FROM ranked JOIN drawn USING ("userId"))
GROUP BY "userId", "itemId" """,
    "recall_with_cf": "WITH " + RECALL + "," + BASE_TOP + """
SELECT "userId", "itemId" FROM candidates
UNION SELECT "userId", "itemId" FROM base_top WHERE rank <= 10 AND "userId" IN (SELECT c_custkey FROM customer)""",
    "als_step": "WITH " + PURCHASES + """, given AS (
  SELECT "itemId", CAST('0x' || substr(md5('factor-0:' || "itemId"), 1, 4) AS INTEGER) / 65535 - 0.5 AS x,
    CAST('0x' || substr(md5('factor-1:' || "itemId"), 1, 4) AS INTEGER) / 65535 - 0.5 AS y FROM (SELECT DISTINCT "itemId" FROM ratings)
), sums AS (
  SELECT "userId", SUM(x * x) / 2 + 0.1 * COUNT(*) AS a, SUM(x * y) / 2 AS b, SUM(y * y) / 2 + 0.1 * COUNT(*) AS c,
    SUM(x * rating) / sqrt(2) AS p, SUM(y * rating) / sqrt(2) AS q FROM ratings JOIN given USING ("itemId") GROUP BY "userId"
), solved AS (
  SELECT "userId", 0 AS place, (c * p - b * q) / (a * c - b * b) AS v FROM sums
  UNION ALL SELECT "userId", 1, (a * q - b * p) / (a * c - b * b) FROM sums
)
SELECT "userId", place, CAST(round(v * 1000000) AS BIGINT) AS micros FROM solved""",
    "ranker_features": "WITH " + CELLS + """
SELECT "userId", "itemId", CAST(place AS INTEGER) AS place, CAST(value AS DOUBLE) AS value FROM cells WHERE value <> 0""",
    "leaf_slots": "WITH " + CELLS + """, tested AS (
  SELECT "userId", "itemId", MAX(value) FILTER (place = 0) AS star, MAX(value) FILTER (place = 1) AS favourite,
    COUNT(*) FILTER (place = 5) AS five, COUNT(*) FILTER (place = 9) AS nine FROM cells GROUP BY ALL
)
SELECT "userId", "itemId", CASE WHEN star <= 25 THEN CASE WHEN favourite <= 0.5 THEN 0 ELSE 1 END WHEN star <= 40 THEN 2 ELSE 3 END AS slot FROM tested
UNION ALL SELECT "userId", "itemId", CASE WHEN five = 1 THEN 11 WHEN star <= 10 THEN 8 WHEN nine = 0 THEN 9 ELSE 10 END FROM tested""",
    "ranker_metrics": "WITH " + SAMPLES + "," + ITEMS + "," + FAVOURITES + """, starred AS (
  SELECT c_mktsegment AS "userSex", label, ("poemStar" + CASE WHEN author IS NULL THEN 0 ELSE 100 END) / 150 AS score
  FROM samples s JOIN items ON s."itemId" = "poemId" JOIN customer ON s."userId" = c_custkey
    LEFT JOIN favourites f ON f."userId" = s."userId" AND author = "poemAuthorId"
), placed AS (
  SELECT *, 2 * RANK() OVER w - 1 + COUNT(*) OVER (PARTITION BY "userSex", score) AS twice,
    LEAST(1 - 1e-15, GREATEST(1e-15, score)) AS safe
  FROM starred WINDOW w AS (PARTITION BY "userSex" ORDER BY score)
)
SELECT "userSex", COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS positives,
  round((SUM(label * twice) / 2.0 - SUM(label) * (SUM(label) + 1) / 2.0) / (SUM(label) * (COUNT(*) - SUM(label))), 6) AS auc,
  round(-AVG(CASE WHEN label > 0 THEN ln(safe) ELSE ln(1 - safe) END), 6) AS logloss
FROM placed GROUP BY "userSex" """,
    "offline_job": "WITH " + SAMPLES + "," + ITEMS + "," + FAVOURITES + f"""
SELECT rating, label, "poemStar", {INDICATORS}, c_mktsegment AS "userSex",
  CASE WHEN author IS NULL THEN 0 ELSE 1 END AS "collectAuthor"
FROM samples s JOIN items ON s."itemId" = "poemId" JOIN customer ON s."userId" = c_custkey
  LEFT JOIN favourites f ON f."userId" = s."userId" AND author = "poemAuthorId"
WHERE rating IS NOT NULL""",
    "fold_errors": "WITH " + PURCHASES + """, rated AS (
  SELECT *, CAST('0x' || substr(md5('7:' || "userId" || ':' || "itemId"), 1, 8) AS BIGINT) % 5 AS fold FROM ratings
), folds AS (SELECT UNNEST(range(5)) AS k),
train AS (SELECT k, r.* FROM rated r JOIN folds ON fold <> k),
means AS (SELECT k, AVG(rating) AS m FROM train GROUP BY k),
ib AS (SELECT k, "itemId", round(SUM(rating - m) / (10.0 + COUNT(*)), 10) AS ib FROM train JOIN means USING (k) GROUP BY k, "itemId"),
ub AS (
  SELECT k, "userId", round(SUM(rating - m - ib) / (15.0 + COUNT(*)), 10) AS ub
  FROM train JOIN means USING (k) JOIN ib USING (k, "itemId") GROUP BY k, "userId"
), misses AS (
  SELECT fold, rating - GREATEST(-2.0, LEAST(5.0, m + COALESCE(ub, 0) + COALESCE(ib, 0))) AS e
  FROM rated r JOIN means ON r.fold = means.k
    LEFT JOIN ib ON ib.k = r.fold AND ib."itemId" = r."itemId" LEFT JOIN ub ON ub.k = r.fold AND ub."userId" = r."userId"
)
SELECT CAST(fold AS INTEGER) AS fold, COUNT(*) AS n, round(sqrt(AVG(e * e)), 6) AS rmse, round(AVG(abs(e)), 6) AS mae
FROM misses GROUP BY fold""",
    "factors_top": """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) // 2 AS h FROM embeddings),
pairs AS (
  SELECT a.id AS "userId", b.id AS "itemId", a.id % 5 / 10 AS ub,
    round(list_dot_product(a.v[1:a.h], b.v[b.h + 1:2 * b.h]) + b.id % 7 / 10, 6) AS s FROM v a, v b
), ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY "userId" ORDER BY s DESC, "itemId") AS rank FROM pairs QUALIFY rank <= 20
)
SELECT "userId", "itemId", CAST(rank AS INTEGER) AS rank, CAST(round(GREATEST(-2.0, LEAST(5.0, 1.5 + ub + s)) * 1000000) AS BIGINT) AS micros FROM ranked""",
    "doc_vectors_given": "WITH " + GIVEN + """
SELECT "docId", place, CAST(round(value * 100000000) AS BIGINT) AS units FROM given""",
    "similar_given": "WITH " + GIVEN + """, vectors AS (
  SELECT "docId" AS id, list(value ORDER BY place) AS v FROM given GROUP BY "docId"
), unit AS (
  SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vectors WHERE list_dot_product(v, v) > 0
), scored AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS s FROM unit a, unit b WHERE a.id <> b.id),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM scored QUALIFY rank <= 100)
SELECT a AS "poemId", CAST(rank AS INTEGER) AS rank, b AS "similarId", CAST(round(s * 1000000) AS BIGINT) AS micros FROM ranked""",
    "word_vectors_exact": "WITH " + WORDS + """, numbered AS (
  SELECT doc_id, UNNEST(tokens) AS term, UNNEST(range(len(tokens))) AS pos FROM cut
), beside AS (SELECT doc_id, term, pos + UNNEST([1, 2]) AS pos FROM numbered), counts AS (
  SELECT LEAST(x.term, y.term) AS a, GREATEST(x.term, y.term) AS b, COUNT(*) AS n
  FROM beside x JOIN numbered y ON x.doc_id = y.doc_id AND x.pos = y.pos GROUP BY ALL
), totals AS (
  SELECT term, SUM(n) AS total FROM (SELECT a AS term, n FROM counts UNION ALL SELECT b, n FROM counts) GROUP BY term
), pmi AS (
  SELECT a, b, CAST(round(ln(CASE WHEN a = b THEN 2 * n ELSE n END * CAST((SELECT SUM(total) FROM totals) AS DOUBLE)
    / (CAST(x.total AS DOUBLE) * y.total * 1.0)) * 1000000) AS BIGINT) AS units
  FROM counts JOIN totals x ON x.term = a JOIN totals y ON y.term = b
), rows_of AS (SELECT a AS term, b AS other, units FROM pmi UNION ALL SELECT b, a, units FROM pmi WHERE a <> b)
SELECT term, CAST(CAST('0x' || substr(md5(other), 1, 8) AS BIGINT) % 64 AS INTEGER) AS place,
  CAST(SUM(units * (CAST('0x' || substr(md5(other), 9, 1) AS BIGINT) % 2 * 2 - 1)) AS BIGINT) AS units
FROM rows_of WHERE units > 0 GROUP BY 1, 2 HAVING SUM(units * (CAST('0x' || substr(md5(other), 9, 1) AS BIGINT) % 2 * 2 - 1)) <> 0""",
    "headers_parsed": HEADERS,
    "stream_headers": HEADERS,
    "envelopes_parsed": f"""
SELECT event_id AS "eventId", 'filed1, filed2, filed3' AS body, CAST(user_id AS VARCHAR) AS "userId",
  NULL AS age, NULL AS name, NULL AS "itemId", event_type AS click FROM events
UNION ALL
SELECT event_id, props, NULL, '3', NULL, {K}, NULL FROM events""",
    "log_lines": """
SELECT event_id AS "eventId", user_id AS "userId", CASE WHEN event_type = 'view' THEN 'filed1' ELSE event_type END AS action
FROM events WHERE event_type <> 'signup'""",
}
