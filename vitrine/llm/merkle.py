"""Merkle manifest of a data set: digest-to-children records, and proofs found by descending them from the root.

Rows become leaves; the leaves of one group form a tree of fixed fan-out, and the roots of those trees, in order of their groups, form one
more. A node is stored under its own digest as the list of its children's digests. A proof request starts at the root with the place of its
leaf; each digit of the place (base fan-out) picks one child, the others become a segment of the path. Requests that share their leading
digits travel as one row, so a level of the descent has no more rows than the tree has nodes there; single requests part at the last digit.
The collected segments, turned round, lead from leaf to root.

Everything is DataFrame work. Ranks come from a distributed numbering, so neither a group nor a level is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.common import durable
from vitrine.operators.ordered import numbered

FAN_OUT = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def framed(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value, so that joined fields cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def _height(leaves: Column, fan_out: int) -> Column:
    """How often ``leaves`` nodes are gathered into runs until one is left."""
    steps, reach = [], 1
    while reach < 1 << 62:
        steps.append((leaves > F.lit(reach)).cast("int"))
        reach *= fan_out
    return sum(steps[1:], steps[0])


@dataclass(frozen=True)
class Tree:
    """Leaves under (``_tree``, ``_at``) with what they carry, the records of each level, and the top of each tree with its height."""

    leaves: DataFrame
    levels: list[DataFrame] = field(repr=False)
    tops: DataFrame = field(repr=False)


@dataclass(frozen=True)
class Manifest:
    groups: Tree
    upper: Tree
    fan_out: int = FAN_OUT

    def root(self) -> DataFrame:
        """One row with the digest of everything; no row where there is no leaf."""
        return self.upper.tops.select(F.col("_digest").alias("root"))

    def records(self) -> DataFrame:
        """The content-addressed store: each digest once, with its children."""
        parts = [level.select("_digest", "_children") for tree in (self.groups, self.upper) for level in tree.levels]
        out = self.upper.tops.select("_digest", F.array().cast("array<string>").alias("_children")).limit(0)
        for part in parts:
            out = out.unionByName(part)
        return out.dropDuplicates(["_digest"]).select(F.col("_digest").alias("digest"), F.col("_children").alias("children"))


def _grown(leaves: DataFrame, fan_out: int) -> Tree:
    """Levels over ``leaves``, which has ``_tree``, ``_at`` (0-based, gapless in its tree), ``_of`` and ``_digest``.

    A level is written durably before the next is built from it; it has an eighth of the rows of the one below.
    """
    nodes = leaves.select("_tree", "_at", "_digest", "_of", _height(F.col("_of"), fan_out).alias("_height"))
    highest = nodes.agg(F.max("_height")).first()[0] or 0
    found = ["_tree", "_digest", "_of", "_height"]
    levels, tops = [], nodes.filter("_height = 0").select(*found)
    for level in range(highest):
        runs = nodes.filter(F.col("_height") > level).groupBy("_tree", "_of", "_height", F.expr(f"_at div {fan_out}").alias("_at"))
        listed = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_digest"))), lambda s: s["_digest"])
        nodes = durable(runs.agg(listed.alias("_children")).withColumn("_digest", F.sha2(F.array_join("_children", ""), 256)))
        levels.append(nodes)
        tops = tops.unionByName(nodes.filter(F.col("_height") == level + 1).select(*found))
    return Tree(leaves, levels, tops)


def build(rows: DataFrame, digest: str, order: Sequence[Column], group: str, fan_out: int = FAN_OUT) -> Manifest:
    """The manifest of ``rows``, one leaf a row with the digest in column ``digest``.

    The leaves of a ``group`` follow ``order`` (end it in the digest: rows that still tie are equal leaves and may change places). The trees
    of the groups follow the group's value, null first, then by UTF-8 bytes. Other columns are carried to ``groups.leaves`` unchanged;
    names with a leading underscore are the operator's own and must not occur in ``rows`` (checked).
    """
    if clash := [c for c in rows.columns if c.startswith("_")]:
        raise ValueError(f"columns {clash} clash with names of the operator")
    # '-' sorts before '=', so null comes first and stays apart from the empty string
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-"))
    placed = numbered(rows.withColumn("_tree", tree).withColumn("_digest", F.col(digest)), order, ["_tree"], "_no", "_of")
    groups = _grown(placed.withColumn("_at", F.col("_no") - 1).drop("_no"), fan_out)
    subroots = groups.tops.select(F.col("_tree").alias("_group"), F.col("_height").alias("_group_height"), "_digest").withColumn("_tree", F.lit(""))
    upper = numbered(subroots, [F.col("_group").asc()], ["_tree"], "_no", "_of")
    return Manifest(groups, _grown(upper.withColumn("_at", F.col("_no") - 1).drop("_no"), fan_out), fan_out)


def _segment(children: Column, digit: Column) -> Column:
    """The children that were not chosen, those before and those after."""
    joined = lambda part: F.array_join(part, "")
    return F.struct(joined(F.slice(children, F.lit(1), digit)).alias("before"),
                    joined(F.slice(children, digit + 2, F.greatest(F.size(children) - digit - 1, F.lit(0)))).alias("after"))


def _descended(level: DataFrame, front: DataFrame, fan_out: int, carried: Sequence[str]) -> DataFrame:
    """One level down: the nodes of ``front`` looked up by digest, a row for each child with the segment of the others on its path."""
    known = level.groupBy("_digest").agg(F.first("_children").alias("_children"))
    met = front.join(known, "_digest")
    opened = met.select("_tree", "_at", "_path", "_children", *carried, F.posexplode("_children").alias("_digit", "_child"))
    return opened.select("_tree", (F.col("_at") * fan_out + F.col("_digit")).alias("_at"), F.col("_child").alias("_digest"),
                         F.concat("_path", F.array(_segment(F.col("_children"), F.col("_digit")))).alias("_path"), *carried)


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The path of each requested leaf: its columns with ``subroot``, ``root`` and ``path``, segments from leaf to root.

    ``requests`` are rows of ``manifest.groups.leaves``, by default all of them; a leaf asked for twice is answered twice. Where only some
    are asked for, nodes that lead to none of them are left at each level.
    """
    fan_out, everything = manifest.fan_out, requests is None
    wanted = manifest.groups.leaves if everything else requests
    carried = [c for c in wanted.columns if c not in ("_tree", "_at", "_of", "_digest")]
    nowhere = F.array().cast("array<struct<before:string,after:string>>")

    front = manifest.upper.tops.select("_tree", F.lit(0).cast("long").alias("_at"), "_digest", nowhere.alias("_path"), F.col("_digest").alias("root"))
    for level in reversed(manifest.upper.levels):
        front = _descended(level, front, fan_out, ["root"])
    named = manifest.upper.leaves.select("_at", F.col("_group").alias("_name"), "_group_height")
    starts = front.join(named, "_at").select(F.col("_name").alias("_tree"), F.lit(0).cast("long").alias("_at"), "_digest", "_path", "root",
                                             F.col("_digest").alias("subroot"), "_group_height")

    kept = ["root", "subroot"]
    front = None
    for height in range(len(manifest.groups.levels), 1, -1):
        begun = starts.filter(F.col("_group_height") == height).drop("_group_height")
        front = begun if front is None else front.unionByName(begun)
        front = _descended(manifest.groups.levels[height - 1], front, fan_out, kept)
        if not everything:
            near = wanted.select("_tree", F.expr(f"_at div {fan_out ** (height - 1)}").alias("_at")).distinct()
            front = front.join(near, ["_tree", "_at"], "left_semi")
    answers = ["_tree", "_at", "_digest", "_path", *kept, *carried]
    whole = F.struct("_at", "_digest", *carried)
    lone = starts.filter("_group_height = 0").drop("_at", "_digest", "_group_height").join(wanted, "_tree").select(*answers)
    if manifest.groups.levels:
        begun = starts.filter("_group_height = 1").drop("_group_height")
        front = begun if front is None else front.unionByName(begun)
        lowest = manifest.groups.levels[0]
        known = lowest.groupBy("_digest").agg(F.first("_children").alias("_children"))
        # the requests below one node travel as one row; only here, behind the last shuffle, do they part
        bundles = wanted.groupBy("_tree", F.expr(f"_at div {fan_out}").alias("_at")).agg(F.collect_list(whole).alias("_requests"))
        met = front.join(known, "_digest").drop("_digest").join(bundles, ["_tree", "_at"])
        parted = met.select("_tree", "_path", "_children", *kept, F.explode("_requests").alias("_request"))
        digit = F.pmod(F.col("_request._at"), F.lit(fan_out)).cast("int")
        lone = lone.unionByName(parted.select(
            "_tree", F.col("_request._at").alias("_at"), F.get("_children", digit).alias("_digest"),
            F.concat("_path", F.array(_segment(F.col("_children"), digit))).alias("_path"), *kept, *[F.col("_request")[c].alias(c) for c in carried]))
    return lone.select(*carried, "subroot", "root", F.reverse("_path").alias("path"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf's to the root's, each level left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["before"], below, s["after"]), 256))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_proofs(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof and what a check of a changed copy says.

    A leaf digests doc_id, source, lang, n_chars and text. Where 3 divides the CRC-32 of the decimal doc_id, the copy's text has A-Z in
    lower case; a text without such letters, an empty or a null text stays the same and is verified. Documents of one language form a tree
    by doc_id (null first); rows with the same id follow their digests, equal rows are equal leaves in neighbouring places. A null doc_id
    counts as empty text for the CRC and so changes its text (the CRC-32 of nothing is 0). Further columns of ``docs``, whatever their
    names, are not read. An empty table gives no rows.
    """
    read = [F.col(c) for c in FIELDS]
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    changes = F.crc32(id_text.cast("binary")) % 3 == 0
    copy = F.when(changes, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "lang", leaf_digest(read).alias("leaf"), F.when(changes, leaf_digest([*read[:-1], copy])).alias("changed"))
    manifest = build(leaves, "leaf", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "lang")
    proven = prove(manifest).withColumn("proof_sha256", proof_digest(F.col("path")))
    proven = proven.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
