"""DuckDB SQL of the corpus operators whose whole results SQL can express, by plain means: every string, every pair."""

from __future__ import annotations

from . import minhash, passages, quality_rules

#: Every string of 100 bytes with its places; those that are not its first are removed, and runs of them make spans.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
p AS (SELECT doc_id, b, unnest(range(1, n - {passages.WIDTH} + 2)) AS i FROM n WHERE n >= {passages.WIDTH}),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY array_slice(b, i, i + {passages.WIDTH} - 1) ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
edge AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + {passages.WIDTH}, true) AS opens FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, i, count_if(opens) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + {passages.WIDTH} AS z FROM run GROUP BY ALL),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM span GROUP BY doc_id),
cut AS (SELECT n.doc_id, n.n, n.b, n_removed, n_spans, list_append(starts, n.n + 1) AS starts, list_prepend(1, ends) AS ends FROM n JOIN gone USING (doc_id)),
kept AS (SELECT doc_id, n, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(starts) + 1), lambda k: hex(array_slice(b, ends[k], starts[k] - 1))), ''))) AS s FROM cut)
SELECT doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(s, sha256(b)) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""


def _count(text: str, chars: str) -> str:
    return f"len(regexp_replace({text}, '[^{chars}]', '', 'g'))"


def _quality_sql() -> str:
    """Measures by text functions, the merging of strata by recursion, the binomial bound by its sum."""
    q = quality_rules
    risk = q.MAX_FALSE_REJECTION
    band = "CASE " + " ".join(f"WHEN n_words >= {least} THEN {k + 1}" for k, least in reversed(list(enumerate(q.STRATA)))) + " ELSE 0 END"
    punct = "".join("\\" + chr(c) for c in q._PUNCT).replace("'", "''")
    ratios = {
        "symbol": "n_symbols / n_words", "dup_line": "n_dup_lines / n_lines", "repeat": "n_repeat_words / n_words", "upper": f"{_count('text', 'A-Z')} / greatest({_count('text', 'A-Za-z')}, 1)",
        "punct": f"{_count('text', punct)} / n_words", "digit": f"{_count('text', '0-9')} / word_chars", "long_word": "word_chars / n_words",
    }
    grid = {r: "[" + ", ".join(repr(x) for x in q.GRIDS[r]) + "]::DOUBLE[]" for r in q.RULES}
    level = "least(" + ", ".join(f"len(list_filter({grid[r]}, lambda c: NOT {r} > c))" for r in q.RULES) + ")"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) AS lines FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, text, len(w) AS n_words, len(regexp_replace(text, '[ \\t\\n\\v\\f\\r]', '', 'g')) AS word_chars, {_count("text", "#*$%&|<>")} AS n_symbols,
      len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
x AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed, {band} AS stratum, {", ".join(f"{e} AS {r}" for r, e in ratios.items())} FROM m),
l AS (SELECT *, {level} AS level FROM x),
marks AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT stratum, good, level FROM l JOIN marks USING (doc_id) WHERE NOT base_failed),
good AS (SELECT s, (SELECT count(*) FROM held WHERE stratum = s AND good) AS n FROM range(0, {len(q.STRATA) + 1}) AS bands(s)),
merged AS (
  SELECT 0 AS round, list(n ORDER BY s) AS size, list(s ORDER BY s) AS first FROM good
  UNION ALL
  SELECT round + 1, size[1 : a - 1] || [size[a] + size[a + 1]] || size[a + 2 :], first[1 : a] || first[a + 2 :]
  FROM (SELECT *, CASE WHEN k > 1 AND (k = len(size) OR size[k - 1] <= size[k + 1]) THEN k - 1 ELSE k END AS a FROM (SELECT *, list_position(size, list_min(size)) AS k FROM merged))
  WHERE len(size) > 1 AND list_min(size) < ln({q.DELTA}::DOUBLE / len(size)) / ln(1 - {risk}::DOUBLE)
),
last AS (SELECT size, first FROM merged ORDER BY round DESC LIMIT 1),
band AS (SELECT s AS stratum, len(list_filter(first, lambda f: f <= s)) AS grp, {q.DELTA}::DOUBLE / len(size) AS delta FROM good, last),
step AS (SELECT unnest(range(0, {q.STEPS})) AS step),
sums AS (SELECT grp, delta, step, (SELECT count(*) FROM held JOIN band b USING (stratum) WHERE b.grp = u.grp AND good) AS n,
      (SELECT count(*) FROM held JOIN band b USING (stratum) WHERE b.grp = u.grp AND good AND level <= step) AS wrong,
      (SELECT count(*) FROM held JOIN band b USING (stratum) WHERE b.grp = u.grp AND NOT good AND level <= step) AS found FROM (SELECT DISTINCT grp, delta FROM band) u, step),
tested AS (SELECT *, n > wrong AND list_sum(list_transform(range(0, wrong + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}::DOUBLE) + (n - i) * ln(1 - {risk}::DOUBLE)))) <= delta AS ok FROM sums WHERE n > 0),
certified AS (SELECT * FROM (SELECT *, bool_and(ok) OVER (PARTITION BY grp ORDER BY step) AS holds FROM tested) WHERE holds AND found > wrong),
chosen AS (SELECT grp, step FROM certified QUALIFY row_number() OVER (PARTITION BY grp ORDER BY found - wrong DESC, step) = 1)
SELECT l.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND coalesce(level > step, true) AS kept
FROM l LEFT JOIN band USING (stratum) LEFT JOIN chosen USING (grp)
"""


OP4_SQL = _quality_sql()

#: All pairs of different bags that share a shingle, their exact weighted Jaccard similarity, and what links reach.
OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\v\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, md5(array_to_string(w, ' ')) AS key FROM d WHERE len(w) > 0),
bag AS (SELECT key, any_value(w) AS w, min(doc_id) AS least FROM k GROUP BY key),
place AS (SELECT key, w, unnest(range(1, greatest(len(w) - {minhash.WORDS - 1}, 1) + 1)) AS i FROM bag),
s AS (SELECT key, array_to_string(w[i : i + {minhash.WORDS - 1}], ' ') AS g, count(*) AS c FROM place GROUP BY ALL),
size AS (SELECT key, sum(c) AS n FROM s GROUP BY key),
pair AS (SELECT a.key AS x, b.key AS y, sum(least(a.c, b.c)) AS shared FROM s a JOIN s b ON a.g = b.g AND a.key < b.key GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size p ON p.key = x JOIN size q ON q.key = y WHERE 10 * shared >= {round(10 * minhash.SIMILARITY)} * (p.n + q.n - shared)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT key AS x, key AS y FROM bag UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y),
class AS (SELECT reach.x AS key, min(bag.least) AS class_id FROM reach JOIN bag ON bag.key = reach.y GROUP BY reach.x),
named AS (SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id FROM d LEFT JOIN k USING (doc_id) LEFT JOIN class USING (key))
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_class, doc_id = class_id AS kept FROM named
"""
