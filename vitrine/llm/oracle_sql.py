"""DuckDB SQL that ``op11`` and ``op12`` must agree with, written from their definitions and not from the operators."""

from __future__ import annotations

from vitrine.catalog.hashing import CRC_TABLES, crc

_FRAMED = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FRAMED.format("{0}") + ")"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _levels(name: str, leaves: str, steps: int) -> str:
    """Tables name0..namesteps of (g, pos, digest, n): the nodes of each level; namekr holds the runs of level k.

    A tree whose level has one node has reached its top; that node is repeated at the levels above, with nothing beside it.
    """
    out = [f"{name}0 AS (SELECT g, pos, digest, n FROM {leaves})"]
    for k in range(steps):
        out.append(f"""{name}{k}r AS (SELECT g, pos // 8 AS up, n, list(digest ORDER BY pos) AS run FROM {name}{k} GROUP BY g, up, n)""")
        out.append(f"""{name}{k + 1} AS (SELECT g, up AS pos, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest, (n + 7) // 8 AS n FROM {name}{k}r)""")
    return ",\n".join(out)


def _beside(name: str, k: int, place: str) -> tuple[str, str]:
    """What stands left and right of the node above ``place`` at level ``k``; nothing once the top is reached."""
    run, pos = f"{name}{k}r_.run", f"({place} // {8 ** k}) % 8"
    return f"array_to_string({run}[1:{pos}], '')", f"array_to_string({run}[{pos} + 2:], '')"


def _merkle(steps: int = 7, top_steps: int = 3) -> str:
    joins = "\n".join([f"JOIN t{k}r t{k}r_ ON t{k}r_.g = d.g AND t{k}r_.up = d.pos // {8 ** (k + 1)}" for k in range(steps)]
                      + [f"JOIN u{k}r u{k}r_ ON u{k}r_.up = s.pos // {8 ** (k + 1)}" for k in range(top_steps)])
    sides = [(*_beside("t", k, "d.pos"), f"t{k}r_.n = 1") for k in range(steps)] + [(*_beside("u", k, "s.pos"), f"u{k}r_.n = 1") for k in range(top_steps)]
    proof = " || ".join(f"{left} || {right}" for left, right, _ in sides)
    folds, before = [], "changed"
    for i, (left, right, ended) in enumerate(sides):
        folds.append(f"f{i} AS (SELECT *, CASE WHEN e{i} THEN {before} ELSE sha256(l{i} || {before} || r{i}) END AS c{i} FROM {f'f{i - 1}' if i else 'found'})")
        before = f"c{i}"
    parts = ", ".join(f"{left} AS l{i}, {right} AS r{i}, {ended} AS e{i}" for i, (left, right, ended) in enumerate(sides))
    return f"""WITH {CRC_TABLES},
d0 AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_LEAF.format('text')} AS leaf, {_LEAF.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS lowered,
    {crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS hit FROM documents, crc_table, hexes),
d AS (SELECT doc_id, g, leaf, CASE WHEN hit THEN lowered ELSE leaf END AS changed, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY g) AS n FROM d0),
{_levels('t', '(SELECT g, pos, leaf AS digest, n FROM d)', steps)},
s AS (SELECT g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, digest, count(*) OVER () AS n FROM t{steps}),
{_levels('u', "(SELECT '' AS g, pos, digest, n FROM s)", top_steps)},
found AS (SELECT d.doc_id, d.leaf, d.changed, s.digest AS subroot, (SELECT digest FROM u{top_steps}) AS root, sha256({proof}) AS proof_sha256, {parts}
FROM d JOIN s ON s.g = d.g
{joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, {before} AS folded_root, {before} = root AS verified FROM f{len(sides) - 1}"""


MERKLE = _merkle()

RESAMPLING = rf"""WITH {CRC_TABLES},
w AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
e AS (SELECT row_id, unnest(words) AS word FROM w),
distinct_words AS (SELECT DISTINCT word FROM (SELECT word FROM e UNION ALL SELECT word FROM b)),
coded AS (SELECT word, {crc("word")} % 10000 AS bucket FROM distinct_words, crc_table, hexes),
sc AS (SELECT bucket, count(*) AS s FROM e JOIN coded USING (word) GROUP BY 1),
tc AS (SELECT bucket, count(*) AS t FROM b JOIN coded USING (word) GROUP BY 1),
sums AS (SELECT (SELECT count(*) FROM e) AS all_s, (SELECT count(*) FROM b) AS all_t),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS g
    FROM sc LEFT JOIN tc USING (bucket), sums),
weights AS (SELECT row_id, CAST(sum(g) AS BIGINT) AS weight FROM e JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY 1),
hashed AS (SELECT w.doc_id, row_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    list_reduce(list_prepend(0::BIGINT, list_transform(range(8), lambda i: (instr(digits, sha256('2024:' || doc_id)[i + 1]) - 1)::BIGINT)), lambda acc, x: acc * 16 + x) AS h
    FROM w LEFT JOIN weights USING (row_id), hexes),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM hashed),
ranked AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (row_id)"""
