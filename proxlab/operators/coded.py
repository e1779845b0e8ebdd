"""Leaves and sums of coded rows, for the boosters (boost, gbt).

A row is a code per bundle.  Bundles are taken together in *groups*: a row has one number per group, from which all its
bundles' codes follow, so that a sum by that number is a sum by the codes of every bundle of the group.  What a tree does
with a row follows from a table per group too: the leaves that the row's codes leave possible, as bits; the leaf is the
first that all groups leave possible.  Neither depends on how often rows repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..session import PARTITION_BYTES

#: rows of a block
BLOCK_ROWS = 1 << 15
#: numbers of a group of bundles that trees look up
GROUP_CODES = 1 << 12
#: sums of a tree's nodes by the numbers of a group, at the most; a bundle of more codes is a group by itself
GROUP_SUMS = 1 << 13
#: leaves of a tree that are found by bits
MOST_LEAVES = 1 << 9
#: bits of the tables of a tree
MOST_BITS = 1 << 26
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def dealt(blocks: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """The blocks of so many rows, dealt evenly to as many tasks as there are cores, or to a multiple where these would hold too much."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    turns = max(1, -(-rows * row_bytes // (PARTITION_BYTES * cores)))
    return blocks.repartition(int(max(1, min(cores * turns, 2 * rows // BLOCK_ROWS))))


class Groups:
    """Bundles in groups whose numbers of codes multiply to ``most`` at the most: the largest first, each where it fits."""

    def __init__(self, sizes: np.ndarray, most: int, first: np.ndarray | None = None):
        self.sizes, self.members, self.cells = [int(x) for x in sizes], [], []
        for b in np.argsort(-np.asarray(sizes), kind="stable").tolist():
            for g, cells in enumerate(self.cells):
                if cells * self.sizes[b] <= most:
                    self.members[g].append(b)
                    self.cells[g] *= self.sizes[b]
                    break
            else:
                self.members.append([b])
                self.cells.append(self.sizes[b])
        first = np.zeros(len(sizes), np.int64) if first is None else first
        self.least = [int(self._number(first, g)) for g in self.members]

    def _number(self, rows, members: list[int]):
        at = rows[members[0]].astype(np.intp)
        for b in members[1:]:
            at = at * self.sizes[b]
            at += rows[b]
        return at

    def numbers(self, rows: np.ndarray) -> list[np.ndarray]:
        """Each group's number of the rows [bundle, row], whose codes begin at the bundle's ``first``."""
        out = []
        for members, least in zip(self.members, self.least, strict=True):
            at = self._number(rows, members)
            if least:
                at -= least
            out.append(at)
        return out

    def by_bundle(self, g: int, sums: np.ndarray):
        """(bundle, sums by its codes) of the group's bundles, from [..., number]."""
        members = self.members[g]
        whole = sums.reshape(*sums.shape[:-1], *(self.sizes[b] for b in members))
        axes = range(sums.ndim - 1, whole.ndim)
        for axis, b in zip(axes, members, strict=True):
            yield b, whole.sum(axis=tuple(x for x in axes if x != axis))


def leaf_masks(left: np.ndarray, right: np.ndarray, bundle: np.ndarray, goes_left) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(the leaves from left to right, by bundle and code the leaves that the code leaves possible, as words of 64 bits).

    Leaves have no ``left``; ``bundle`` is that of inner nodes' features, and ``goes_left(nodes, bundle)`` says by node and code
    whether rows go left.
    """
    left, right = left.tolist(), right.tolist()
    first, middle, leaves, todo = {}, {}, [], [(0, False)]
    while todo:
        v, seen = todo.pop()
        if seen:
            middle[v] = len(leaves)
        elif left[v] < 0:
            leaves.append(v)
        else:
            first[v] = len(leaves)
            todo += [(right[v], False), (v, True), (left[v], False)]
    inner = np.array(sorted(first), np.int64)
    at = np.arange(64 * -(-len(leaves) // 64))
    below = (at >= np.array([first[v] for v in inner.tolist()])[:, None]) & (at < np.array([middle[v] for v in inner.tolist()])[:, None])
    gone = ~np.packbits(below, axis=1, bitorder="little").view("<u8").astype(np.uint64)     # of rows that go right
    masks = {}
    for b in np.unique(bundle[inner]).tolist():
        own = np.flatnonzero(bundle[inner] == b)
        masks[b] = np.bitwise_and.reduce(np.where(goes_left(inner[own], b)[:, None, :], ALL, gone[own][:, :, None]), axis=0)
    return np.array(leaves), masks


class Leaves:
    """The leaves of a tree's rows, from :func:`leaf_masks`."""

    @staticmethod
    def served(leaves: int, groups: Groups) -> bool:
        return leaves <= MOST_LEAVES and -(-leaves // 64) * sum(groups.cells) * 64 <= MOST_BITS

    def __init__(self, node: np.ndarray, masks: dict[int, np.ndarray], groups: Groups):
        self.node, self.words, self.tables = node, -(-len(node) // 64), []
        for g, members in enumerate(groups.members):
            if any(b in masks for b in members):
                table = np.full((self.words, 1), ALL)
                for b in members:
                    own = masks.get(b)
                    if own is None:
                        table = np.repeat(table, groups.sizes[b], axis=1)
                    else:
                        table = (table[:, :, None] & own[:, None, :]).reshape(self.words, -1)
                self.tables.append((g, [np.ascontiguousarray(x) for x in table]))

    def places(self, numbers: list[np.ndarray]) -> np.ndarray:
        """The place of each row's leaf in ``node``."""
        out = None
        for w in reversed(range(self.words)):
            left = None
            for g, table in self.tables:
                some = table[w].take(numbers[g])
                left = some if left is None else np.bitwise_and(left, some, out=left)
            low = np.negative(left)
            low &= left
            low -= np.uint64(1)
            place = np.bitwise_count(low)
            if self.words == 1:
                return place
            place = place.astype(np.intp) + 64 * w
            out = place if out is None else np.where(left != 0, place, out)
        return out


def groups_for(nodes, sizes: np.ndarray, first: np.ndarray | None = None) -> dict[int, Groups]:
    """By the number of a tree's nodes to sum: groups of few enough sums; the same ones for about as many nodes."""
    made: dict[int, Groups] = {}
    for n in nodes:
        about = 1 << (n - 1).bit_length()
        made.setdefault(about, Groups(sizes, max(1, GROUP_SUMS // about), first))
    return {n: made[1 << (n - 1).bit_length()] for n in nodes}


def add_up(total: np.ndarray, key: np.ndarray, weights: list[np.ndarray | None]) -> None:
    """Adds the weights (None: ones) by key to the rows of ``total``."""
    cells = total.shape[1]
    for i, w in enumerate(weights):
        if cells <= 4 * len(key):
            total[i] += np.bincount(key, w, cells)
        else:
            np.add.at(total[i], key, 1.0 if w is None else w)
