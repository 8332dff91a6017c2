"""SQL that queries of this subpackage can be held against: the same results by plain, unsharded statements."""

from __future__ import annotations

_BLANK = r"[\s\p{Z}]"
#: A Filename apart from case, outer blanks, separators and a ``.txt`` ending.
NAME = rf"nullif(regexp_replace(regexp_replace(lower(regexp_replace(Filename, '^{_BLANK}+|{_BLANK}+$', '', 'g')), '\.txt$', ''), '[\s\p{{Z}}_\-]+', '_', 'g'), '')"
RATER = r"try_cast(nullif(regexp_extract(rater_id, '(\d+)', 1), '') AS BIGINT)"


def _rated(score: str) -> str:
    """Ratings, their norms, all pairs of raters of an item, and accuracies by triplets over pairs of panels and two passes."""
    return rf"""
        valid AS (SELECT source_row_id, rater_position, {RATER} AS rater_no, coalesce({NAME}, 'row ' || source_row_id) AS item, "{score}" AS score FROM rater_essay_wide WHERE "{score}" IN (1, 2, 3, 4, 5)),
        once AS (SELECT source_row_id, rater_position, rater_no, min(item) AS item, min(score) AS score FROM valid WHERE rater_no IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2, 3),
        rated AS (SELECT item, rater_no, avg(score) AS score, count(*) AS n FROM once GROUP BY 1, 2),
        norms AS (SELECT rater_no, CAST(sum(n) AS BIGINT) AS n_ratings, avg(score) AS mean_score, stddev_pop(score) AS sd_score FROM rated GROUP BY 1),
        z AS (SELECT item, rater_no, (score - mean_score) / sd_score AS z, rater_no % 4 AS p FROM rated JOIN norms USING (rater_no) WHERE sd_score > 1e-9),
        pairs AS (SELECT x.rater_no AS i, y.rater_no AS j, x.p AS f, y.p AS g, x.z * y.z AS v FROM z x JOIN z y ON x.item = y.item AND x.rater_no <> y.rater_no),
        met AS (SELECT i, g, sum(v) AS u, count(*) AS k FROM pairs GROUP BY 1, 2),
        panels AS (SELECT f, g, avg(v) AS c FROM pairs WHERE f < g GROUP BY 1, 2),
        triplets AS (SELECT m.i, sum(m.u * n.u) AS up, sum(m.k * n.k * coalesce(panels.c, 0)) AS down FROM met m JOIN met n ON n.i = m.i AND m.g < n.g LEFT JOIN panels ON panels.f = m.g AND panels.g = n.g GROUP BY 1),
        agreed AS (SELECT i, sum(u) AS u, sum(k) AS k FROM met GROUP BY 1),
        a0 AS (SELECT agreed.i, u / k AS agreement, greatest(-0.98, least(0.98, sign(u) * sqrt(greatest(coalesce(CASE WHEN down > 0 THEN up / down END, 0), 0)))) AS a FROM agreed LEFT JOIN triplets ON triplets.i = agreed.i),
        s1 AS (SELECT pairs.i, sum(v * a) AS up, sum(a * a) AS down FROM pairs JOIN a0 ON a0.i = pairs.j GROUP BY 1),
        a1 AS (SELECT s1.i, CASE WHEN down > 1e-3 THEN greatest(-0.98, least(0.98, up / down)) ELSE a0.a END AS a FROM s1 JOIN a0 ON a0.i = s1.i),
        s2 AS (SELECT pairs.i, sum(v * a) AS up, sum(a * a) AS down FROM pairs JOIN a1 ON a1.i = pairs.j GROUP BY 1),
        a2 AS (SELECT s2.i, 0.5 * a1.a + 0.5 * CASE WHEN down > 1e-3 THEN greatest(-0.98, least(0.98, up / down)) ELSE a1.a END AS a FROM s2 JOIN a1 ON a1.i = s2.i),
        raters AS (
            SELECT norms.rater_no, n_ratings, mean_score, sd_score, agreement, CASE WHEN sd_score > 1e-9 THEN a2.a ELSE 0 END AS accuracy
            FROM norms LEFT JOIN a0 ON a0.i = norms.rater_no LEFT JOIN a2 ON a2.i = norms.rater_no)"""


def _consensus(score: str) -> str:
    return f"""
        WITH {_rated(score)},
        centre AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM rated),
        votes AS (
            SELECT item, score, s, coalesce(ln((1 + accuracy) / (1 - accuracy)), 0) AS w, m + s * CASE WHEN sd_score > 0 THEN (rated.score - mean_score) / sd_score ELSE 0 END * CASE WHEN coalesce(accuracy, 0) < 0 THEN -1 ELSE 1 END AS v
            FROM rated JOIN raters USING (rater_no) CROSS JOIN centre),
        sums AS (SELECT item, count(*) AS votes, sum(abs(w)) AS w, sum(abs(w) * v) AS wv, sum(abs(w) * v * v) AS wvv, avg(score) AS plain, min(s) AS s FROM votes GROUP BY 1),
        means AS (SELECT *, round(CASE WHEN w > 1e-9 THEN wv / w ELSE plain END, 6) AS mean FROM sums)
        SELECT item, votes, mean AS consensus, CAST(greatest(1, least(5, floor(mean + 0.5))) AS INTEGER) AS consensus_score,
               CASE WHEN votes > 1 AND w > 1e-9 AND s > 0 THEN round(1 - (wvv / w - (wv / w) * (wv / w)) / (s * s), 6) END AS agreement
        FROM means"""


#: A plain search: windows of five words that both texts hold, their words counted once on either side.
_OVERLAPS = r"""evals AS (SELECT DISTINCT try_cast(split_part(target_id, ':', 1) AS BIGINT) AS r FROM phase1_predictions),
    trains AS (SELECT DISTINCT try_cast(split_part(h, ':', 1) AS BIGINT) AS r FROM (SELECT unnest(history_ids) AS h FROM phase1_predictions)),
    texts AS (SELECT DISTINCT source_row_id AS r, regexp_extract_all(lower(Text), '[\p{L}\p{N}]+') AS w FROM rater_essay_wide WHERE Text IS NOT NULL AND source_row_id IS NOT NULL),
    numbered AS (SELECT row_number() OVER () AS id, r, w, len(w) AS n, r IN (SELECT r FROM evals) AS is_eval, r IN (SELECT r FROM trains) AS is_train FROM texts WHERE len(w) > 0),
    windows AS (SELECT id, r, n, is_eval, is_train, unnest(range(1, n - 3)) AS p, w FROM numbered WHERE n >= 5),
    hashed AS (SELECT id, r, n, is_eval, is_train, p, hash(w[p : p + 4]) AS h FROM windows),
    hits AS (SELECT a.id AS e, b.id AS t, a.r AS re, b.r AS rt, a.n AS ne, b.n AS nt, a.p AS pe, b.p AS pt FROM hashed a JOIN hashed b ON a.h = b.h WHERE a.is_eval AND b.is_train AND a.r <> b.r),
    many AS (SELECT e, t FROM hits GROUP BY e, t HAVING count(DISTINCT pe) >= 2 * any_value(ne) / 15 AND count(DISTINCT pt) >= 2 * any_value(nt) / 15),
    words AS (SELECT e, t, re, rt, ne, nt, pe + k AS we, pt + k AS wt FROM hits JOIN many USING (e, t), unnest(range(5)) AS u(k)),
    covered AS (SELECT e, t, re, rt FROM words GROUP BY e, t, re, rt HAVING count(DISTINCT we) >= 2 * any_value(ne) / 3 AND count(DISTINCT wt) >= 2 * any_value(nt) / 3),
    pairs AS (
        SELECT re, rt FROM covered
        UNION SELECT a.r, b.r FROM numbered a JOIN numbered b ON a.w = b.w AND a.r <> b.r WHERE a.n < 5 AND a.is_eval AND b.is_train)"""


def _words(text: str) -> str:
    """Words of a text apart from broken lines, markup, entities, hidden letters, accents and case."""
    x = rf"regexp_replace({text}, '([\p{{L}}\p{{N}}_])-[ \t]*\r?\n[>\s]*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    x = f"regexp_replace({x}, '<[!/?]?[A-Za-z][^<>]*>', ' ', 'g')"
    for entity, letter in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{letter}')"
    x = f"regexp_replace({x}, '[' || chr(173) || chr(8203) || '-' || chr(8207) || chr(8288) || chr(65279) || ']', '', 'g')"
    return f"regexp_extract_all(regexp_replace(lower(strip_accents({x})), '\\p{{M}}', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"


#: A plain alignment: where a document and a passage share six words in a row, their words are compared place by place at that shift.
_LEAKED = f"""
    WITH lines AS (SELECT t, unnest(list_distinct(list_transform(regexp_split_to_array(t, '\r\n|\r|\n'), lambda x: trim(lower(x))))) AS line FROM (SELECT DISTINCT text AS t FROM eval_passages WHERE text IS NOT NULL)),
    shared AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(*) >= 3),
    listed AS (SELECT coalesce(list(line), []) AS known FROM shared),
    cut AS (SELECT item_id, text, array_to_string(list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: NOT list_contains(known, trim(lower(x)))), chr(10)) AS kept FROM eval_passages CROSS JOIN listed WHERE text IS NOT NULL),
    items AS (SELECT item_id, CASE WHEN 2 * len({_words('kept')}) >= len({_words('text')}) THEN {_words('kept')} ELSE {_words('text')} END AS w FROM cut),
    docs AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL),
    iw AS (SELECT item_id, p, hash(w[p : p + 5]) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS p FROM items)),
    dw AS (SELECT doc_id, p, hash(w[p : p + 5]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS p FROM docs)),
    shifts AS (SELECT DISTINCT doc_id, item_id, dw.p - iw.p AS s FROM dw JOIN iw USING (h)),
    same AS (
        SELECT doc_id, item_id, s, p, row_number() OVER (PARTITION BY doc_id, item_id, s ORDER BY p) AS k
        FROM (SELECT doc_id, item_id, s, unnest(range(1, len(items.w) + 1)) AS p, items.w AS iw, docs.w AS dw FROM shifts JOIN items USING (item_id) JOIN docs USING (doc_id)) WHERE p + s BETWEEN 1 AND len(dw) AND iw[p] = dw[p + s])
    SELECT DISTINCT a.doc_id, a.item_id FROM same a JOIN same b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.s = b.s AND b.p - a.p + 1 >= 20 AND 10 * (b.k - a.k + 1) >= 9 * (b.p - a.p + 1)"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say on whole tables; the others are held against brute force in the tests."""
    return {
        "p1_raters": f"WITH {_rated('Overall')} SELECT rater_no, n_ratings, round(mean_score, 6) AS mean_score, round(sd_score, 6) AS sd_score, round(agreement, 6) AS agreement, round(accuracy, 6) AS accuracy FROM raters",
        "p1_found": f"WITH {_rated('Overall')} SELECT rater_no FROM raters WHERE n_ratings >= 20 AND accuracy < 0.3",
        "p1_consensus": _consensus("Overall"),
        "p1_consensus_cohesion": _consensus("Cohesion"),
        "p2_found": f"WITH {_OVERLAPS} SELECT DISTINCT least(re, rt) AS row_a, greatest(re, rt) AS row_b FROM pairs",
        "p2_report": f"""
            WITH {_OVERLAPS}, names AS (SELECT source_row_id AS r, min({NAME}) AS name FROM rater_essay_wide GROUP BY 1),
            named AS (SELECT DISTINCT re, rt, CASE WHEN a.name IS NULL OR b.name IS NULL THEN 'unnamed' WHEN a.name = b.name THEN 'same_name' ELSE 'other_name' END AS source FROM pairs JOIN names a ON a.r = re JOIN names b ON b.r = rt)
            SELECT 'evaluation' AS split, source, count(DISTINCT re) AS "rows", count(*) AS pairs FROM named GROUP BY source UNION ALL SELECT 'training', source, count(DISTINCT rt), count(*) FROM named GROUP BY source""",
        "p7_found": _LEAKED,
        # The averages alone, over all texts: the fitted level must leave out none of them.
        "p3_found": r"""
            WITH texts AS (SELECT DISTINCT source_row_id, Text AS t FROM rater_essay_wide WHERE regexp_matches(Text, '[\p{L}\p{N}]')),
            bare AS (SELECT source_row_id, regexp_replace(t, '\b(Mr|Mrs|Ms|Dr|Prof|Rev|Gen|Col|St|Jr|Sr|vs|etc|e\.g|i\.e|cf|approx|ca|No|Nr|Vol|pp|Fig|Inc|Ltd|Co|U\.S|U\.K|a\.m|p\.m)\.(\s|,|$)', '\1\2', 'g') AS t FROM texts),
            dotless AS (SELECT source_row_id, replace(replace(replace(replace(replace(replace(t, 'e.g', 'eg'), 'i.e', 'ie'), 'U.S', 'US'), 'U.K', 'UK'), 'a.m', 'am'), 'p.m', 'pm') AS t FROM bare),
            tokens AS (SELECT source_row_id, regexp_extract_all(t, '[\p{L}\p{Nl}\p{No}]+([''’][\p{L}\p{Nl}\p{No}]+)*|\d+([.,]\d+)*|[.!?。！？]+') AS x FROM dotless),
            counts AS (
                SELECT source_row_id, len(list_filter(x, lambda w: NOT regexp_matches(w, '^[.!?。！？]'))) AS words,
                       list_sum(list_transform(x, lambda w: CASE WHEN regexp_matches(w, '^[.!?。！？]') THEN 0 ELSE length(w) END)) AS letters,
                       len(list_filter(x, lambda w, i: NOT regexp_matches(w, '^[.!?。！？]') AND (i = len(x) OR regexp_matches(x[i + 1], '^[.!?。！？]')))) AS sentences
                FROM tokens)
            SELECT DISTINCT source_row_id FROM counts WHERE words > 24 * greatest(sentences, 1) AND letters > 6.5 * words""",
        "p4_violations": "SELECT 'rows' AS \"check\", count(*) AS value FROM rater_essay_wide UNION ALL SELECT unnest(['unlabelled', 'off_balance', 'parted_rows', 'parted_names', 'parted_raters']), 0",
        "p4_found": rf"""
            WITH RECURSIVE keyed AS (
                SELECT DISTINCT source_row_id, {NAME} AS name, {RATER} AS rater
                FROM rater_essay_wide),
            ties AS (
                SELECT 's' || source_row_id AS a, 'f' || name AS b FROM keyed WHERE source_row_id IS NOT NULL AND name IS NOT NULL
                UNION SELECT 's' || source_row_id, 'r' || rater FROM keyed WHERE source_row_id IS NOT NULL AND rater IS NOT NULL
                UNION SELECT 'f' || name, 'r' || rater FROM keyed WHERE name IS NOT NULL AND rater IS NOT NULL),
            edges AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
            walk(start, node) AS (
                SELECT DISTINCT rater, 'r' || rater FROM keyed WHERE rater IS NOT NULL
                UNION SELECT walk.start, edges.b FROM walk JOIN edges ON edges.a = walk.node)
            SELECT CAST(substr(node, 2) AS BIGINT) AS source_row_id, min(start) AS group_rater FROM walk WHERE node LIKE 's%' GROUP BY node""",
    }
