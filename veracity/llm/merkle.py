"""A Merkle manifest of a dataset: digests in contiguous matrices, one row for each aligned block.

Leaves are dealt to blocks of fanout ** levels consecutive places of their group. A block's leaves lie in one numpy
matrix of 64 hex digits a row, which is reshaped by the fanout and hashed row by row, level after level; the blocks'
roots are the leaves of the next tier, and the groups' roots (subroots) those of a last tree. Siblings are found by
index arithmetic in these matrices. No task holds more than one block's leaves and proofs.

A run of `fanout` nodes (the last of a level: those that are left, also one alone) becomes the digest of their
concatenated hex digits, while a level has several nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

#: A block: its place in the tier, the number of the group's leaves, whether a tier follows, and its root.
TIER = "key string, block long, n long, open boolean, ids array<string>, digests binary, claims binary, root string"
PROOFS = "key string, id string, i long, leaf string, claim string, proof string, steps array<int>, subroot string, root string, folded string"


def digest(fields: list[Column]) -> Column:
    """SHA-256 in hex of the fields, each `-` if null, else its number of UTF-8 bytes, a colon and its text."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(f.cast("string")) for f in fields]), 256)


def _height(n: int, fanout: int) -> int:
    levels, width = 0, 1
    while width < n:
        levels, width = levels + 1, width * fanout
    return levels


def _matrix(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.uint8).reshape(-1, 64)


def _levels(leaves: np.ndarray, fanout: int, steps: int) -> list[np.ndarray]:
    """The matrices of all levels, the leaves' first."""
    out = [leaves]
    for _ in range(steps):
        whole = len(out[-1]) // fanout
        runs = [*out[-1][: whole * fanout].reshape(whole, 64 * fanout)]
        if whole * fanout < len(out[-1]):
            runs.append(out[-1][whole * fanout :].reshape(-1))
        out.append(_matrix("".join([sha256(run).hexdigest() for run in runs]).encode()))
    return out


def _paths(levels: list[np.ndarray], fanout: int) -> tuple[np.ndarray, list[bytes]]:
    """For each leaf of a block its steps, place * (fanout + 1) + size of its run, and its siblings level by level."""
    n = len(levels[0])
    steps, parts = np.zeros((n, len(levels) - 1), np.int32), []
    for depth, level in enumerate(levels[:-1]):
        at = np.arange(n) // fanout**depth
        first = at - at % fanout
        size = np.minimum(fanout, len(level) - first)
        steps[:, depth] = (at - first) * (fanout + 1) + size
        around = first[:, None] + np.arange(fanout)
        there = (around != at[:, None]) & (around < len(level))
        siblings = level[around[there]].tobytes()
        ends = np.cumsum(there.sum(1)) * 64
        parts.append([siblings[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
    return steps, [b"".join(p) for p in zip(*parts, strict=True)] if parts else [b""] * n


def fold(node: str, steps: list[int], proof: str, fanout: int) -> str:
    """The root that a leaf and its siblings give."""
    at = 0
    for step in steps:
        place, size = divmod(int(step), fanout + 1)
        middle, end = at + 64 * place, at + 64 * (size - 1)
        node, at = sha256((proof[at:middle] + node + proof[middle:end]).encode()).hexdigest(), end
    return node


def _tier(nodes: DataFrame, tier: int, fanout: int, levels: int) -> DataFrame:
    """Blocks of the nodes (key, n, i, id, leaf, claim); ids as text, since pandas would make numbers beside nulls inexact."""
    size = fanout**levels

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n, i = int(pdf["n"].iloc[0]), int(pdf["i"].iloc[0])
        leaves = "".join(pdf["leaf"]).encode()
        left = _height(n, fanout) - tier * levels
        root = _levels(_matrix(leaves), fanout, min(left, levels))[-1].tobytes().decode()
        claims = None if pdf["claim"].isna().all() else "".join(pdf["claim"]).encode()
        return pd.DataFrame([[pdf["key"].iloc[0], i // size, n, left > levels, list(pdf["id"]), leaves, claims, root]], columns=TIER.replace(",", "").split()[::2])

    return materialize(nodes.withColumns({"block": F.expr(f"i div {size}"), "id": F.col("id").cast("string")}).groupBy("key", "block").applyInPandas(pack, TIER), "tier")


def tiers(leaves: DataFrame, fanout: int = 2, levels: int = 10) -> list[DataFrame]:
    """The blocks of all tiers of the groups' trees. `leaves` has (key, id, leaf, claim) and what orders them is (id, leaf, claim)."""
    placed = numbered(leaves, ["key"], [F.col("id").asc_nulls_first(), "leaf", "claim"])
    out = [_tier(placed, 0, fanout, levels)]
    while not (above := out[-1].where("open")).isEmpty():
        nodes = above.select("key", "n", F.col("block").alias("i"), F.lit(None).cast("long").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("claim"))
        out.append(_tier(nodes, len(out), fanout, levels))
    return out


def _descend(blocks: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The leaves of the first tier with their proofs, from the proofs (key, proof, steps, subroot, root) of the groups' roots."""
    size = fanout**levels

    def proofs(tier: int):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in (r for b in batches for r in b.itertuples(index=False)):
                own = _levels(_matrix(row.digests), fanout, min(_height(row.n, fanout) - tier * levels, levels))
                steps, paths = _paths(own, fanout)
                text = row.digests.decode()
                claims = text if row.claims is None else row.claims.decode()
                cut = lambda t: [t[k : k + 64] for k in range(0, len(t), 64)]
                proof = [p.decode() + row.proof for p in paths]
                turns = [[*s, *row.steps] for s in steps.tolist()]
                place = range(row.block * size, row.block * size + len(proof))
                folded = [fold(c, s, p, fanout) for c, s, p in zip(cut(claims), turns, proof, strict=True)] if tier == 0 else None
                yield pd.DataFrame({"key": row.key, "id": row.ids, "i": place, "leaf": cut(text), "claim": cut(claims), "proof": proof, "steps": turns, "subroot": row.subroot, "root": row.root_of_all, "folded": folded})
        return of

    above = above.withColumnRenamed("root", "root_of_all")
    down = None
    for tier in range(len(blocks) - 1, -1, -1):
        closed = blocks[tier].where("not open").join(above, "key")
        rows = closed if down is None else closed.unionByName(blocks[tier].where("open").join(down, ["key", "block"]))
        made = rows.drop("root", "open").mapInPandas(proofs(tier), PROOFS)
        down = made.select("key", F.col("i").alias("block"), "proof", "steps", "subroot", F.col("root").alias("root_of_all"))
    return made


def proofs(leaves: DataFrame, fanout: int = 2, levels: int = 10) -> DataFrame:
    """(key, id, i, leaf, claim, proof, steps, subroot, root, folded): every leaf's proof up to the root of all groups.

    `leaves` has (key, id, leaf, claim): groups in the order of their keys, leaves by id (null first), equal ids by
    digest. `proof` holds the siblings' digests, level by level and left to right, `steps` the leaf's places (see
    `fold`), `folded` the root that `claim`, or the leaf where that is null for the whole block, gives with them.
    Equal rows are leaves of their own; an empty table has no proofs.
    """
    leaves = materialize(leaves.select("key", "id", "leaf", F.coalesce("claim", "leaf").alias("claim")), "leaves")
    groups = tiers(leaves, fanout, levels)
    subroots = groups[0].where("not open").select("key", "root")
    for blocks in groups[1:]:
        subroots = subroots.unionByName(blocks.where("not open").select("key", "root"))
    subroots = materialize(subroots, "subroots")
    order = numbered(subroots.withColumn("all", F.lit("")), ["all"], ["key"])
    nodes = order.select(F.col("all").alias("key"), F.lit(None).cast("long").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("claim"), "i", "n")
    top = [_tier(nodes, 0, fanout, levels)]
    while not (above := top[-1].where("open")).isEmpty():
        top.append(_tier(above.select("key", F.lit(None).cast("long").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("claim"), F.col("block").alias("i"), "n"), len(top), fanout, levels))
    start = top[-1].select("key", F.lit("").alias("proof"), F.array().cast("array<int>").alias("steps"), F.lit("").alias("subroot"), "root")
    of_groups = _descend(top, start, fanout, levels).select("i", "proof", "steps", "root").join(order.select("i", F.col("key").alias("group"), F.col("root").alias("subroot")), "i")
    of_groups = materialize(of_groups.select(F.col("group").alias("key"), "proof", "steps", "subroot", "root"), "groups")
    return _descend(groups, of_groups, fanout, levels).withColumn("id", F.col("id").cast(leaves.schema["id"].dataType))


#: The fields of a document, in the order in which they are hashed.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_leaves(docs: DataFrame) -> DataFrame:
    """(key, id, leaf, claim) of documents, grouped by lang (null first); the claim is the digest after tampering.

    Tampering adds 1 to n_chars where 7 divides the CRC-32 of the id's decimal digits; documents without id stay.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("lang").cast("string")), F.lit("n"))
    own = docs.select(*FIELDS).select(key.alias("key"), F.col("doc_id").cast("long").alias("id"), "n_chars", *[F.col(f).alias(f"f_{f}") for f in FIELDS], digest([F.col(f) for f in FIELDS]).alias("leaf"))
    other = digest([F.col("n_chars") + 1 if f == "n_chars" else F.col(f"f_{f}") for f in FIELDS])
    hit = F.crc32(F.col("id").cast("string")) % 7 == 0
    return own.select("key", "id", "leaf", F.when(hit & F.col("n_chars").isNotNull(), other).otherwise(F.col("leaf")).alias("claim"))


def verified(docs: DataFrame) -> DataFrame:
    """Every document's leaf, roots and proof, and whether it still gives the root after the tampering above."""
    p = proofs(document_leaves(docs))
    return p.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
