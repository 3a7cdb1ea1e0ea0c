"""DuckDB counterparts of the queries that SQL can express on whole tables."""

from __future__ import annotations

# Fixed values of the word rules.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op1_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS x
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, k, place.n, item_id FROM place JOIN win ON win.n = place.n AND win.x = array_to_string(list_slice(w, k, k + place.n - 1), ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLES["op10_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 12), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
early AS (SELECT x, min(doc_id) AS least FROM win GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM win JOIN early USING (x) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS v FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

ORACLES["op8_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_SPACED}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + least(5, len(w)) - 1), ' ') AS x
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

# The tree level by level: a run of two gives its parent, a lone node is hashed alone, until a group has one node.
_TREE = """SELECT * FROM {leaves} UNION ALL
    SELECT grp, lvl + 1, pos // 2, sha256(d || coalesce(nd, '')), (n + 1) // 2
    FROM (SELECT *, lead(d) OVER (PARTITION BY grp ORDER BY pos) AS nd FROM {tree} WHERE n > 1) WHERE pos % 2 = 0"""
# A leaf climbs: at each level its sibling is the other node of its run, if there is one.
_CLIMB = """SELECT c.id, c.lvl + 1, c.pos // 2, c.grp, c.proof || coalesce(s.d, ''),
    sha256(CASE WHEN s.d IS NULL THEN c.f WHEN c.pos % 2 = 1 THEN s.d || c.f ELSE c.f || s.d END)
    FROM {climb} c JOIN {tree} o ON o.grp = c.grp AND o.lvl = c.lvl AND o.pos = c.pos AND o.n > 1
    LEFT JOIN {tree} s ON s.grp = c.grp AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1)"""
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"""


def _leaf(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in fields) + ")"


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS grp, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS changed FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n,
    row_number() OVER (ORDER BY grp, doc_id, leaf) AS id FROM d),
base AS (SELECT grp, 0 AS lvl, pos, leaf AS d, n FROM ranked),
tree AS ({_TREE.format(leaves='base', tree='tree')}),
subs AS (SELECT grp, d AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
ubase AS (SELECT '' AS grp, 0 AS lvl, pos, subroot AS d, n FROM subs),
utree AS ({_TREE.format(leaves='ubase', tree='utree')}),
climb AS (SELECT id, 0 AS lvl, pos, grp, '' AS proof, coalesce(changed, leaf) AS f FROM ranked UNION ALL {_CLIMB.format(climb='climb', tree='tree')}),
mid AS (SELECT id, arg_max(proof, lvl) AS proof, arg_max(f, lvl) AS f FROM climb GROUP BY id),
uclimb AS (SELECT m.id, 0 AS lvl, s.pos, '' AS grp, m.proof, m.f FROM mid m JOIN ranked r USING (id) JOIN subs s ON s.grp = r.grp
    UNION ALL {_CLIMB.format(climb='uclimb', tree='utree')}),
top AS (SELECT id, arg_max(proof, lvl) AS proof, arg_max(f, lvl) AS f FROM uclimb GROUP BY id)
SELECT r.doc_id, r.leaf, s.subroot, u.d AS root, sha256(t.proof) AS proof_sha256, t.f AS folded_root, t.f = u.d AS verified
FROM ranked r JOIN top t USING (id) JOIN subs s ON s.grp = r.grp JOIN utree u ON u.n = 1"""

ORACLES["op11_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
