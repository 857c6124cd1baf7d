"""A Merkle manifest of a dataset: sparse forests of unresolved nodes that partitions hold and a tree reduction merges.

A group's rows (of one language, say) are its leaves, in order. While several nodes remain, each run of ``arity`` consecutive ones (the last run may be shorter, even of one) becomes
the digest of its members' digests. The groups' roots, in the groups' order, become leaves of one more such tree.

A forest is a set of nodes, keyed by group, level and index, none of which has all its siblings there. Two forests merge by union; whenever a run is complete, which is known as the
group's number of leaves is, its parent takes its place, and so on upwards. This is associative and commutative, with the empty forest as its unit, so it doesn't matter how leaves are dealt out.
A task's forest has the leaves of a range, of which at most 2 (arity - 1) nodes of a level stay unresolved, and only one if the range is a whole subtree, as ``LEAVES`` makes it for arity 2.
The tree reduction merges ``fan`` neighbouring forests at a time, so a round has few nodes. Every merge keeps, for each node that entered it, the path up to the node that left it; going back from the
root, these join up to the paths of all leaves. No task holds a group, and nothing goes through the driver.

Paths: a level is the digests of the node's run with ``*`` for the node itself, levels are joined by ``;``, from the leaf's up; a single leaf has an empty path.

Defined results: null values have a mark of their own, and a null group is the first of all; rows without an order value come first in their group; rows of equal order are sorted by their digests; repeated rows
are leaves of their own; other columns are not part of a leaf; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .ordering import numbered

ARITY = 2
#: Leaves of a task's forest, and forests that meet in a merge.
LEAVES, FAN = 1 << 12, 64
#: Every such document is tampered with in ``audit``.
TAMPERED = 7
Node = tuple[int, int]  # level, index


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


# ---------------------------------------------------------------- the monoid


def settle(nodes: dict[Node, str], n: int, arity: int) -> tuple[dict[Node, str], dict[Node, str]]:
    """Unresolved nodes of a group of ``n`` leaves, and the path's level of each node whose run was complete."""
    levels: dict[int, dict[int, str]] = {}
    for (level, i), h in nodes.items():
        levels.setdefault(level, {})[i] = h
    steps: dict[Node, str] = {}
    level = min(levels, default=0)
    while level <= max(levels, default=-1):
        here, wide = levels.get(level, {}), -(-n // arity**level)
        for run in sorted({i // arity for i in here}) if wide > 1 else ():
            members = range(run * arity, min(wide, (run + 1) * arity))
            if all(m in here for m in members):
                digests = [here[m] for m in members]
                levels.setdefault(level + 1, {})[run] = hashlib.sha256("".join(digests).encode()).hexdigest()
                for k, m in enumerate(members):
                    steps[level, m] = "".join(digests[:k]) + "*" + "".join(digests[k + 1 :])
        level += 1
    return {(level, i): h for level, here in levels.items() for i, h in here.items() if (level, i) not in steps}, steps


def climbs(nodes, steps: dict[Node, str], arity: int) -> dict[Node, tuple[str, Node]]:
    """For each of ``nodes``: its path up to an unresolved node, and that node."""
    out: dict[Node, tuple[str, Node]] = {}
    for level, i in sorted(steps, reverse=True):  # parents before children
        above = (level + 1, i // arity)
        path, top = out.get(above, ("", above))
        out[level, i] = (steps[level, i] + (";" + path if path else ""), top)
    return {key: out.get(key, ("", key)) for key in nodes}


# ---------------------------------------------------------------- the tree reduction


def _keys(table: pa.Table) -> list[Node]:
    return list(zip(table.column("level").to_pylist(), table.column("idx").to_pylist(), strict=True))


def _forest(leaves: DataFrame, most: int, arity: int, size: int, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """The root (grp, n, level, idx, digest) of each group of ``leaves`` (grp, n, idx, digest; ``most``: the largest n) and the rounds of the reduction."""

    def gather(table):
        n = table.column("n")[0].as_py()
        rest, _ = settle({(0, i): h for i, h in zip(table.column("idx").to_pylist(), table.column("digest").to_pylist(), strict=True)}, n, arity)
        return pa.table({"grp": pa.repeat(table.column("grp")[0], len(rest)), "n": pa.repeat(pa.scalar(n, pa.int64()), len(rest)), "level": pa.array([k[0] for k in rest], pa.int32()), "idx": pa.array([k[1] for k in rest], pa.int64()), "digest": pa.array([*rest.values()], pa.string())})

    def merge(table):
        keys = _keys(table)
        rest, steps = settle(dict(zip(keys, table.column("digest").to_pylist(), strict=True)), table.column("n")[0].as_py(), arity)
        found = climbs(keys, steps, arity)
        path, top = zip(*[found[k] for k in keys], strict=True)
        return pa.table({c: table.column(c) for c in ("grp", "n", "level", "idx")} | {"path": pa.array(path, pa.string()), "to_level": pa.array([t[0] for t in top], pa.int32()), "to_idx": pa.array([t[1] for t in top], pa.int64()), "to_digest": pa.array([rest[t] for t in top], pa.string())})

    C.ship(leaves.sparkSession)
    plain = "grp string, n long, level int, idx long"
    part = lambda wide: F.floor(F.col("idx") * F.pow(F.lit(arity), F.col("level")).cast("long") / F.lit(wide))
    up = C.materialize(leaves.groupBy("grp", F.floor(F.col("idx") / size).alias("part")).applyInArrow(gather, f"{plain}, digest string"))
    rounds, wide = [], size
    while wide < most:
        wide *= fan
        rounds.append(C.materialize(up.groupBy("grp", part(wide).alias("part")).applyInArrow(merge, f"{plain}, path string, to_level int, to_idx long, to_digest string")))
        up = rounds[-1].select("grp", "n", F.col("to_level").alias("level"), F.col("to_idx").alias("idx"), F.col("to_digest").alias("digest")).distinct()
    return up, rounds


def _paths(leaves: DataFrame, ends: DataFrame, rounds: list[DataFrame], arity: int, size: int) -> DataFrame:
    """``leaves`` with ``path``, the continuation of their group (``ends``: grp, level, idx, path, subroot, root) included, subroot and root."""
    for merged in reversed(rounds):
        above = ends.select("grp", F.col("level").alias("to_level"), F.col("idx").alias("to_idx"), F.col("path").alias("rest"), "subroot", "root")
        path = F.array_join(F.filter(F.array("path", "rest"), lambda p: p != ""), ";")
        ends = C.materialize(merged.join(above, ["grp", "to_level", "to_idx"]).select("grp", "level", "idx", path.alias("path"), "subroot", "root"))
    ends = ends.withColumn("first", F.col("idx") * F.pow(F.lit(arity), F.col("level")).cast("long"))
    kept = [f for f in leaves.schema.fields if f.name not in ("n", "idx", "digest")]

    def finish(table, above):
        if not table.num_rows:
            return pa.table({f: pa.array([], t.type) for f, t in zip(wanted.names, wanted, strict=True)}, schema=wanted)
        keys = [(0, i) for i in table.column("idx").to_pylist()]
        _, steps = settle(dict(zip(keys, table.column("digest").to_pylist(), strict=True)), table.column("n")[0].as_py(), arity)
        found, rest = climbs(keys, steps, arity), dict(zip(_keys(above), above.column("path").to_pylist(), strict=True))
        path = [";".join(x for x in (p, rest[top]) if x) for p, top in (found[k] for k in keys)]
        same = [pa.repeat(above.column(c)[0], len(keys)) for c in ("subroot", "root")]
        return pa.Table.from_arrays([*(table.column(f.name) for f in kept), pa.array(path, pa.string()), *same], schema=wanted)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    out = StructType([*kept, *(StructField(c, StringType()) for c in ("path", "subroot", "root"))])
    wanted = to_arrow_schema(out)
    part = lambda c: F.floor(F.col(c) / size).alias("part")
    return leaves.groupBy("grp", part("idx")).cogroup(ends.groupBy("grp", part("first"))).applyInArrow(finish, out)


def proofs(rows: DataFrame, group: str, order: str, digest: str, arity: int = ARITY, size: int = LEAVES, fan: int = FAN) -> DataFrame:
    """``rows`` (with the digest of each row's leaf) with path, subroot (of its group) and root (of all)."""
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before any value
    given = C.materialize(rows.select(grp.alias("grp"), *[F.col(c).alias(f"_{c}") for c in rows.columns]))
    leaves = C.materialize(numbered(given, ["grp"], [f"_{order}", f"_{digest}"]).withColumnRenamed("at", "idx").withColumn("digest", F.col(f"_{digest}")))
    C.drop(given)
    most = leaves.agg(F.max("n")).first()[0] or 0
    roots, rounds = _forest(leaves, most, arity, size, fan)
    roots = C.materialize(roots.select(F.lit("all").alias("one"), "grp", "level", "idx", "digest"))
    top = C.materialize(numbered(roots, ["one"], ["grp"]).select(F.col("one").alias("grp"), F.col("grp").alias("member"), F.col("level").alias("own_level"), "n", F.col("at").alias("idx"), "digest"))
    crown, crown_rounds = _forest(top, top.count(), arity, size, fan)
    crown = crown.select("grp", "level", "idx", F.lit("").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    named = _paths(top.withColumn("subroot_of", F.col("digest")), crown, crown_rounds, arity, size)
    ends = C.materialize(named.select(F.col("member").alias("grp"), F.col("own_level").alias("level"), F.lit(0).cast("long").alias("idx"), "path", F.col("subroot_of").alias("subroot"), "root"))
    return _paths(leaves, ends, rounds, arity, size).select(*[F.col(f"_{c}").alias(c) for c in rows.columns], "path", "subroot", "root")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings on its path."""
    return F.when(path == "", digest).otherwise(F.aggregate(F.split(path, ";"), digest, lambda h, level: F.sha2(F.replace(level, F.lit("*"), h), 256)))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, from the leaf's up, left to right."""
    return F.sha2(F.replace(F.replace(path, F.lit("*"), F.lit("")), F.lit(";"), F.lit("")), 256)


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; where ``TAMPERED`` divides the check sum of a row's id, its n_chars are one more when it is folded."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    changed = (F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    own = leaf(*[F.col(c) for c in columns])
    other = leaf(*[more if c == "n_chars" else F.col(c) for c in columns])
    given = docs.select("doc_id", "lang", own.alias("leaf"), F.when(changed, other).alias("tampered"))
    out = proofs(given, "lang", "doc_id", "leaf").withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
