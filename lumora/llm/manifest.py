"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled so that children come before parents. Spark's sort is the external queue: nodes of a level are dealt
out in blocks of consecutive labels, and in each block a priority queue hands child digests to parents. A few rounds reach
the roots, of groups first and then of the list of groups. A reversed sweep hands each child the rest of its proof.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumora.llm.shared import written
from lumora.plans.order import ordered_index

#: Children of a node, and levels that one block climbs: a block has FAN_IN ** BLOCK_LEVELS nodes.
FAN_IN, BLOCK_LEVELS = 2, 10
#: Of documents whose checksum this divides, the tampered version is verified.
TAMPER = 7
_NODE = "grp string, pos long, m long, digest string"


def canonical(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:`, and the value; binary values as hex."""
    said = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[canonical(c) for c in columns]), 256)


def digest(parts: Sequence[str]) -> str:
    """Hex SHA-256 of the concatenated hex digests."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(first: int, count: int, fan_in: int, levels: int) -> int:
    """Levels from `count` nodes to one, at most `levels`."""
    n = 0
    while count > 1 and n < levels:
        count, n = -(-count // fan_in), n + 1
    return n


class Block:
    """A subtree over consecutive nodes of one level: `digests` of positions `first`, `first` + 1, … of `m` nodes."""

    def __init__(self, digests: Sequence[str], first: int, m: int, fan_in: int = FAN_IN, levels: int = BLOCK_LEVELS):
        self.fan_in, self.height = fan_in, climbed(first, m, fan_in, levels)
        self.nodes = {(0, first + k): d for k, d in enumerate(digests)}
        # messages to (level, position) with the sender's position and digest; in this order they are a heap already
        messages = [(1, at // fan_in, at, d) for (_, at), d in self.nodes.items()] if self.height else []
        while messages:
            level, at = messages[0][:2]
            children = []
            while messages and messages[0][:2] == (level, at):
                children.append(heapq.heappop(messages)[3])
            made = digest(children)
            self.nodes[level, at] = made
            if level < self.height:
                heapq.heappush(messages, (level + 1, at // fan_in, at, made))
        self.top = max(self.nodes)

    @property
    def root(self) -> str:
        return self.nodes[self.top]

    def proofs(self, suffix: str) -> Iterator[tuple[int, str]]:
        """(position, proof) of every lowest node, parents before children. A proof lists a level's digests left of the
        node, `.`, those right of it, `;`, level by level; the block's own proof is `suffix`."""
        queue = [(-self.top[0], -self.top[1], suffix)]
        while queue:
            level, at, rest = heapq.heappop(queue)
            level, at = -level, -at
            if level == 0:
                yield at, rest
                continue
            run = [k for k in range(at * self.fan_in, (at + 1) * self.fan_in) if (level - 1, k) in self.nodes]
            for k in run:
                left = "".join(self.nodes[level - 1, j] for j in run if j < k)
                right = "".join(self.nodes[level - 1, j] for j in run if j > k)
                heapq.heappush(queue, (1 - level, -k, f"{left}.{right};{rest}"))


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    for step in proof.split(";")[:-1]:
        left, right = step.split(".")
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def siblings(proof: str) -> str:
    """All digests of a proof, one after the other."""
    return proof.replace(".", "").replace(";", "")


def _block(fan_in: int, levels: int) -> Column:
    return F.floor(F.col("pos") / (fan_in**levels)).cast("long")


def ascend(nodes: DataFrame, fan_in: int = FAN_IN, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """Nodes of each round, from the given (grp, pos, m, digest) up to one node per group; m is the group's node count."""
    rounds = [nodes]

    def up(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        first, m = int(part["pos"].iloc[0]), int(part["m"].iloc[0])
        block = Block(part["digest"].tolist(), first, m, fan_in, levels)
        return pd.DataFrame({"grp": [part["grp"].iloc[0]], "pos": [block.top[1]], "m": [_after(m, block.height, fan_in)], "digest": [block.root]})

    while (rounds[-1].agg(F.max("m")).first()[0] or 0) > 1:
        work = rounds[-1].withColumn("block", _block(fan_in, levels))
        rounds.append(written(work.groupBy("grp", "block").applyInPandas(up, _NODE), "nodes"))
    return rounds


def _after(m: int, height: int, fan_in: int) -> int:
    for _ in range(height):
        m = -(-m // fan_in)
    return m


def descend(rounds: list[DataFrame], top: DataFrame, fan_in: int = FAN_IN, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(grp, pos, proof, subroot) of the nodes of each lower round; the lowest round stays as blocks.

    `top` has (grp, proof, subroot) of every group's root. Returned are (grp, block, proof, subroot) for blocks of round 0.
    """
    given = top.select("grp", F.lit(0).cast("long").alias("pos"), "proof", "subroot")
    for nodes in reversed(rounds[1:-1]):
        work = nodes.withColumn("block", _block(fan_in, levels))

        def down(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            return _sweep(part, above, fan_in, levels)

        made = work.groupBy("grp", "block").cogroup(given.withColumnRenamed("pos", "block").groupBy("grp", "block")).applyInPandas(down, "grp string, pos long, proof string, subroot string")
        given = written(made, "proofs")
    return given.withColumnRenamed("pos", "block")


def _sweep(part: pd.DataFrame, above: pd.DataFrame, fan_in: int, levels: int) -> pd.DataFrame:
    part = part.sort_values("pos")
    block = Block(part["digest"].tolist(), int(part["pos"].iloc[0]), int(part["m"].iloc[0]), fan_in, levels)
    found = sorted(block.proofs(above["proof"].iloc[0]))
    return pd.DataFrame({"grp": part["grp"].to_numpy(), "pos": [k for k, _ in found], "proof": [p for _, p in found], "subroot": [above["subroot"].iloc[0]] * len(found)})


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", count_col: str = "n_chars",
    fan_in: int = FAN_IN, levels: int = BLOCK_LEVELS, with_proof: bool = False,
) -> DataFrame:
    """One row per row of `docs`: its leaf, its group's root, the root of all, a digest of its proof, and whether the row verifies.

    Leaves ascend by id within their group, nulls first and equal ids by their digest; groups ascend bytewise, null first.
    Of rows whose id's checksum TAMPER divides, a version whose count is one more is verified, against the original
    proof. Empty tables give no rows; other columns are not read; texts of any length only pass through the digest.
    """
    own = [F.col(f"`{c}`") for c in columns]
    changed = [F.col(f"`{c}`").cast("decimal(38,0)") + 1 if c == count_col else F.col(f"`{c}`") for c in columns]
    chosen = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % TAMPER == 0
    group = F.col(f"`{group_col}`").cast("string")
    leaves = written(docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("grp"), F.col(f"`{id_col}`").alias("doc_id"), leaf_digest(own).alias("digest"),
        F.when(chosen, leaf_digest(changed)).alias("tampered"),
    ), "leaves")
    placed = ordered_index(leaves, ["doc_id", "digest"], ["grp"], "pos", small=False)
    counts = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    placed = written(placed.join(counts, "grp").select("grp", "pos", "m", "digest", F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("tampered", "digest").alias("tested")), "placed")
    rounds = ascend(placed.select("grp", "pos", "m", "digest"), fan_in, levels)
    if len(rounds) == 1:  # nothing to join: each group is a single leaf, or there is none
        rounds.append(rounds[0])
    subroots = rounds[-1].select("grp", "digest")
    listed = ordered_index(subroots.withColumn("one", F.lit("")), ["grp"], ["one"], "pos", small=False)
    total = subroots.count()
    above = written(listed.select(F.lit("").alias("grp"), "pos", F.lit(total).cast("long").alias("m"), "digest", F.col("grp").alias("named")), "subroots")
    upper = ascend(above.select("grp", "pos", "m", "digest"), fan_in, levels)
    last = upper[-1].first()
    root = last["digest"] if last else None
    if len(upper) == 1:
        upper.append(upper[0])
    start = upper[-1].select("grp", F.lit("").alias("proof"), F.lit(root).cast("string").alias("subroot"))
    blocks = descend(upper, start, fan_in, levels)

    def tops(part: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        made = _sweep(part, given, fan_in, levels)
        return pd.DataFrame({"grp": part["named"].to_numpy(), "proof": made["proof"], "subroot": part["digest"].to_numpy()})

    work = above.withColumn("block", _block(fan_in, levels))
    top = written(work.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInPandas(tops, "grp string, proof string, subroot string"), "tops")
    blocks = descend(rounds, top, fan_in, levels)
    more = ", proof string" if with_proof else ""

    def leaves_of(part: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        made = _sweep(part, given, fan_in, levels)
        folded = [fold(leaf, p) for leaf, p in zip(part["tested"], made["proof"])]
        rows = {
            "doc_id": part["doc_id"].to_numpy(), "leaf": part["digest"].to_numpy(), "subroot": made["subroot"], "root": [root] * len(part),
            "proof_sha256": [hashlib.sha256(siblings(p).encode()).hexdigest() for p in made["proof"]], "folded_root": folded, "verified": [f == root for f in folded],
        }
        return pd.DataFrame(rows | ({"proof": made["proof"]} if with_proof else {}))

    work = placed.withColumn("block", _block(fan_in, levels))
    found = work.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInPandas(
        leaves_of, f"doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{more}"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
