"""Operator 12: a Merkle manifest of a dataset whose proofs are looked up by coordinates.

A leaf is the SHA-256 (lower-case hex) of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and
the value. The leaves of a group (rows of one lang) ascend by id; every two consecutive nodes become the hash of
their hex texts, a last single one the hash of itself, until one node remains: the group's subroot. The subroots,
ordered by group (null first), give the root in the same way.

1. Rows are numbered in their group without one task for a group: rows are sorted over all tasks by range, each
   task counts what it holds of each group, and the counts before it are added.
2. The node table is materialised `bits` levels at a time: a task hashes runs (blocks) of at most 2^bits consecutive
   nodes, and only the last level of each run goes on. A block is one row, its digests by level and place, 32 bytes each.
3. A proof is looked up: the sibling that a leaf needs at a level has the coordinates (g, block, level, place), which
   follow from the leaf's position alone. A leaf meets the row of its block, by g and block, and takes its siblings from
   it; the rest of its proof is that of its block, which is looked up in the same way in the part above. So a leaf is
   shuffled once, without its siblings, and the few nodes near the root are not a hot key of all leaves.
4. The siblings are put in order, concatenated and folded over the leaf by column expressions.

Only the number of rows of the largest group reaches the driver. Defined cases: null fields are ``-``; a null
group is a group of its own; a null id comes before all others and is never tampered with; rows that repeat an
id are leaves of their own, ordered by their hashes; an empty table gives an empty result and no root; other
columns are neither hashed nor carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCKS = "g string, height int, block long, nodes array<array<binary>>"


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def text(digest: Column) -> Column:
    """The lower-case hex text of a digest, which is what is hashed and shown."""
    return F.lower(F.hex(digest))


def tampered(doc_id: Column) -> Column:
    """Whether the manifest query tampers with a row: 7 divides the unsigned CRC-32 of its decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def height(n: Column) -> Column:
    """Levels above the leaves of a group of n: the bits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def _digest(*parts: bytes) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def _grown(level: DataFrame, start: int, bits: int) -> DataFrame:
    """The blocks over level (g, height, pos, digest), whose level is start: nodes[k] are the digests of level start + k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("g", "height", "pos", "digest")], strict=True)

        out, held = [], 0
        for (g, top, block), same in groupby(rows(), key=lambda r: (r[0], r[1], r[2] >> bits)):
            nodes = [[r[3] for r in same]]
            for _ in range(min(bits, top - start)):
                now = nodes[-1]
                nodes.append([_digest(*now[i : i + 2]) for i in range(0, len(now), 2)])
            out.append((g, top, block, nodes))
            held += len(nodes[0])
            if held > 10_000:
                yield _batch(out)
                out, held = [], 0
        yield _batch(out)

    block = level.withColumn("block", F.shiftright("pos", bits)).repartition("g", "block").sortWithinPartitions("g", "pos")
    return block.select("g", "height", "pos", "digest").mapInArrow(run, _BLOCKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.binary())))
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["g", "height", "block", "nodes"])


def node_tables(leaves: DataFrame, bits: int = 8) -> list[DataFrame]:
    """The node table over leaves (g, height, pos, digest) in parts of bits levels, stored: (g, height, block, nodes). A part
    begins with the nodes that it is built on: the leaves, or the last level of the part before. Lone leaves are in none."""
    most = leaves.agg(F.max("height")).first()[0] or 0
    level, parts = leaves, []
    for start in range(0, max(most, 1), bits):
        parts.append(stored(_grown(level.where(F.col("height") > start), start, bits), "nodes"))
        level = parts[-1].select("g", "height", F.col("block").alias("pos"), _last().alias("digest"))
    return parts


def _last() -> Column:
    return F.element_at("nodes", -1)[0]


def subroots(leaves: DataFrame, parts: list[DataFrame], bits: int = 8) -> DataFrame:
    """(g, digest): the last node of each group: a lone leaf, or the last of the part in which the group's last level is."""
    tops = [p.where(F.col("height") <= (k + 1) * bits).select("g", _last().alias("digest")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tops, leaves.where("height = 0").select("g", "digest"))


def _siblings(start: int, bits: int) -> Column:
    """The siblings that the node at `inside` of a block needs, by level; null where its ancestor is a last, single node."""
    return F.expr(f"transform(sequence(0, least({bits}, height - {start}) - 1), k -> get(get(nodes, k), shiftright(inside, k) ^ 1))")


def proofs(leaves: DataFrame, parts: list[DataFrame], bits: int = 8) -> DataFrame:
    """leaves (g, height, pos, ...) with steps: for every level below the last, the leaf's sibling there (null where the
    leaf's ancestor is a last, single node) and whether it stands on the left. Steps go from leaf to subroot."""
    none = F.array().cast("array<binary>")
    above = None
    for k in range(len(parts) - 1, -1, -1):
        held = parts[k].withColumn("more", none)
        if above is not None:  # sorted and merged at any size, so that the same rows are shuffled, whatever Spark expects
            held = parts[k].join(above.hint("merge"), ["g", "block"], "left").withColumn("more", F.coalesce("more", none))
        if k:
            units = held.withColumn("inside", F.explode(F.expr("sequence(0, size(nodes[0]) - 1)")))
            above = units.select("g", (F.shiftleft("block", bits) + F.col("inside")).alias("block"), F.concat(_siblings(k * bits, bits), "more").alias("more"))
    asked = leaves.withColumn("block", F.shiftright("pos", bits)).join(held.drop("height").hint("merge"), ["g", "block"], "left")
    asked = asked.withColumn("inside", F.col("pos").bitwiseAND((1 << bits) - 1).cast("int"))
    found = asked.withColumn("found", F.when(F.col("height") > 0, F.concat(_siblings(0, bits), "more")).otherwise(none)).drop("nodes", "more", "inside", "block")
    left = "transform(found, (s, i) -> struct(lower(hex(s)) as digest, shiftright(pos, i) % 2 = 1 as left))"
    return found.withColumn("steps", F.expr(left)).drop("found")


def folded(start: Column, steps: Column) -> Column:
    """The root that start and the steps lead to."""
    join = lambda acc, s: F.sha2(F.when(s["digest"].isNull(), acc).when(s["left"], F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"])), 256)
    return F.aggregate(steps, start, join)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, bits: int = 8) -> DataFrame:
    """(id_col, leaf, claimed, subroot, root, steps) of every row; bits: levels of one part of the node table.

    claimed is the leaf of the row with the columns of changed in place of its own (the leaf itself without): what
    somebody who holds another version of the row would prove.
    """
    changed = changed or {}
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit("-"))  # "-" comes before "="
    own = leaf([F.col(c) for c in fields])
    claimed = leaf([changed.get(c, F.col(c)) for c in fields]) if changed else own
    same = F.when(claimed != own, claimed)  # null where the claim is the leaf, so that most rows carry one digest
    rows = numbered(docs.select(F.col(id_col).alias("id"), g.alias("g"), own.alias("digest"), same.alias("claimed")), ["id", "digest"])
    rows = stored(rows.withColumn("height", height(F.col("n"))).drop("n"), "leaves")
    parts = node_tables(rows, bits)
    tops = numbered(subroots(rows, parts, bits).select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"])
    tops = stored(tops.withColumn("height", height(F.col("n"))), "subroots")
    top_parts = node_tables(tops, bits)
    root = subroots(tops, top_parts, bits).select("g", text(F.col("digest")).alias("root"))
    upper = proofs(tops, top_parts, bits).join(root, "g")
    # stored, so that its size is known before the leaves are joined with it
    upper = stored(upper.select(F.col("name").alias("g"), text(F.col("digest")).alias("subroot"), "root", F.col("steps").alias("more")), "upper")
    out = proofs(rows, parts, bits).join(upper, "g")
    return out.select(F.col("id").alias(id_col), text(F.col("digest")).alias("leaf"), text(F.coalesce("claimed", "digest")).alias("claimed"), "subroot", "root", F.concat("steps", "more").alias("steps"))


def verify(proved: DataFrame) -> DataFrame:
    """proved (of manifest) with proof_sha256, folded_root and verified in place of claimed and steps."""
    siblings = F.concat_ws("", F.transform(F.filter("steps", lambda s: s["digest"].isNotNull()), lambda s: s["digest"]))
    out = proved.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", folded(F.col("claimed"), F.col("steps")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("claimed", "steps")
