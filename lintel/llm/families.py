"""Families of near copies: links within a large block of sets, without meeting in pairs.

The members of a block are given by their differences from one common set, so differences of two members are those of their sets:
x and y link when d |R(x) ^ R(y)| <= c (|x| + |y|), with c = 100 - percent and d = 100 + percent.

A block of more than ``DIRECT`` members is resolved like this:

1. The common set is moved to the block's majority: a shingle that over half of the differences hold leaves those that have it and
   joins those that don't. What all or most members have in common is gone from the differences then.
2. Let s(x) = d |R(x)| - c |x|. If s(x) + s(y) <= 0, the two link whatever they share; and whenever that holds of any two, it
   holds of each with the member of smallest s. So one star around that member links all such pairs.
3. Every other linked pair shares at least (s(x) + s(y)) / 2d of its differences. Shingles that nearly the same members have are
   one token, with their number as weight (a replaced word brings and takes several shingles at once). Members are put into a
   block for each of their rarest tokens, as many as it takes that a partner in a given range of s must share one (weighted prefix
   filter by ranges). No such block has more than half of the members.
4. Those blocks are resolved in turn; those whose members are connected already are left out. In blocks of at most ``DIRECT``
   members each pair is compared, once for all blocks that come from one.

So members of a family that differ from it in places of their own meet few others, however many there are. A block with at most
``LOCAL`` shingles in its differences is resolved within one task; larger ones take steps 1 to 3 as joins and sums, as often as
it takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, joined, staged

DIRECT, LOCAL = 32, 1_000_000
#: Ranges of s at most; shingles of pairs compared at a time.
RANGES, BATCH = 8, 2_000_000


class Family:
    """Links of one block in memory. ``tests``: how many pairs were compared."""

    def __init__(self, sizes: np.ndarray, percent: int):
        self.n, self.c, self.d = sizes.astype(np.int64), 100 - percent, 100 + percent
        self.root = np.arange(len(sizes))
        self.marks = np.random.default_rng(7).integers(1, 1 << 63, (2, len(sizes)), np.uint64)
        self.links: list[tuple[int, int]] = []
        self.seen: list[np.ndarray] = []
        self.tests = 0

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)
        return i != j

    def unite(self, i: int, j: int) -> None:
        if self.join(i, j):
            self.links.append((int(i), int(j)))

    def roots(self, members: np.ndarray) -> np.ndarray:
        r = self.root[members]
        while (up := self.root[r]).tobytes() != r.tobytes():
            r = up
        return r

    def solve(self, differences: list[np.ndarray]) -> None:
        lens = np.array([len(r) for r in differences], np.int64)
        every = np.concatenate([np.zeros(0, np.int64), *[np.asarray(r).view(np.int64) for r in differences]])
        token = np.unique(every, return_inverse=True)[1].astype(np.int64)
        self.stack = [(np.arange(len(lens)), lens, token, np.repeat(np.arange(len(lens)), lens))]
        while self.stack:
            self.step(*self.stack.pop())

    def step(self, members: np.ndarray, size: np.ndarray, token: np.ndarray, owner: np.ndarray) -> None:
        """One block: its members, sizes of their differences, and the tokens that several may share, by owner (a place in members)."""
        m = len(members)
        if m < 2 or self.connected(members):
            return
        known, token, count = np.unique(token, return_inverse=True, return_counts=True)
        if m <= DIRECT:
            order = np.argsort(owner, kind="stable")
            self.test(members, size, token[order], np.searchsorted(owner[order], np.arange(m + 1)), *np.triu_indices(m, 1))
            return
        major = np.flatnonzero(2 * count > m)
        if len(major):
            at = np.full(len(known), -1)
            at[major] = np.arange(len(major))
            held = np.zeros((m, len(major)), bool)
            of = at[token]
            held[owner[of >= 0], of[of >= 0]] = True
            size = size + len(major) - 2 * held.sum(1)
            lack, which = np.nonzero(~held)
            token, owner = np.concatenate([token[of < 0], major[which]]), np.concatenate([owner[of < 0], lack])
            count[major] = m - count[major]
        s = self.d * size - self.c * self.n[members]
        first = int(s.argmin())
        for i in np.flatnonzero(s + s[first] <= 0):
            if i != first:
                self.unite(members[first], members[i])
        live = count[token] > 1
        token, owner = token[live], owner[live]
        if not len(token):
            return
        kind = self.kinds(m, len(known), members, token, owner)
        pairs, weight = np.unique(owner * (kind.max() + 1) + kind[token], return_counts=True)
        who, kinds = pairs // (kind.max() + 1), pairs % (kind.max() + 1)
        holders = np.bincount(kinds)
        # those whose members are connected need no block
        roots = self.roots(members)
        low, high = np.full(len(holders), len(self.root)), np.zeros(len(holders), np.int64)
        np.minimum.at(low, kinds, roots[who])
        np.maximum.at(high, kinds, roots[who])
        order = np.lexsort((kinds, holders[kinds], who))
        who, kinds, weight = who[order], kinds[order], weight[order]
        of_member = np.zeros(m, np.int64)
        np.add.at(of_member, who, weight)
        rest = np.cumsum(of_member)[who] - np.cumsum(weight) + weight  # weight of this and all more frequent tokens of the member
        alive = (low < high)[kinds]
        # ranges of s
        span = max(1, int(self.c * np.median(self.n[members])), int(s.max() - s.min()) // RANGES + 1)
        part = (s - s.min()) // span
        own = np.unique(part)
        least = {p: int(s[part == p].min()) for p in own}
        most = {p: int((self.d * size + self.c * self.n[members])[part == p].max()) for p in own}
        order = np.argsort(owner, kind="stable")
        token, begin = token[order], np.searchsorted(owner[order], np.arange(m + 1))
        few = []
        for a in own:
            for b in own[own >= a]:
                if least[b] > most[a] or least[a] > most[b]:
                    continue  # more would have to be shared than there is
                mine = alive & (part[who] == a) & (2 * self.d * rest >= s[who] + least[b])
                if b != a:
                    mine |= alive & (part[who] == b) & (2 * self.d * rest >= s[who] + least[a])
                few += self.deal(members, size, token, begin, who[mine], kinds[mine], 2 * self.d * rest[mine] - s[who[mine]], s)
        if few:
            i, j = np.divmod(np.unique(np.concatenate(few)), m)
            may = (self.d * np.minimum(size[i], size[j]) * 2 >= s[i] + s[j]) & (s[i] + s[j] > 0)
            self.test(members, size, token, begin, i[may], j[may])

    def kinds(self, m: int, tokens: int, members: np.ndarray, token: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """A number for each token; tokens with the same or nearly the same holders share it (two min-hashes of the holders), unless
        over half of all members would hold one of them."""
        low = np.full((2, tokens), np.iinfo(np.uint64).max, np.uint64)
        for k in range(2):
            np.minimum.at(low[k], token, self.marks[k][members[owner]])
        near = np.unique(low[0] * np.uint64(0x9E3779B97F4A7C15) + low[1], return_inverse=True)[1]
        held = np.unique(owner * (near.max() + 1) + near[token]) % (near.max() + 1)
        many = 2 * np.bincount(held, minlength=near.max() + 1) > m
        return np.where(many[near], near.max() + 1 + np.arange(tokens), near)

    def connected(self, members: np.ndarray) -> bool:
        roots = self.roots(members)
        return bool((roots == roots[0]).all())

    def deal(self, members, size, token, begin, who, kinds, spare, s) -> list[np.ndarray]:
        """Puts large groups of the same kind on the stack; pairs (first * members + second) of the others for which enough shared
        tokens may follow (spare: what the rest of a member's tokens leave for its partner's s)."""
        order = np.lexsort((who, kinds))
        who, kinds, spare = who[order], kinds[order], spare[order]
        starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(kinds)))
        for start, count in zip(starts[counts > DIRECT], counts[counts > DIRECT]):
            group = who[start : start + count]
            spans = [token[begin[i] : begin[i + 1]] for i in group]
            self.stack.append((members[group], size[group], np.concatenate(spans), np.repeat(np.arange(count), [len(x) for x in spans])))
        pairs = []
        for count in range(2, DIRECT + 1):
            at = starts[counts == count]
            if len(at):
                i, j = ((at[:, None] + k).ravel() for k in np.triu_indices(count, 1))
                enough = (spare[i] >= s[who[j]]) & (spare[j] >= s[who[i]])
                pairs.append(who[i[enough]] * len(members) + who[j[enough]])
        return pairs

    def fresh(self, i, j) -> np.ndarray:
        """Places of pairs not tested before; they are remembered, in sorted runs of falling length."""
        keys, at = np.unique(np.minimum(i, j) * len(self.root) + np.maximum(i, j), return_index=True)
        for run in self.seen:
            new = run[np.minimum(np.searchsorted(run, keys), len(run) - 1)] != keys
            keys, at = keys[new], at[new]
        if len(keys):
            self.seen.append(keys)
        while len(self.seen) > 1 and 2 * len(self.seen[-1]) > len(self.seen[-2]):
            self.seen[-2:] = [np.sort(np.concatenate(self.seen[-2:]))]
        return at

    def test(self, members, size, token, begin, i, j) -> None:
        """Unites the pairs (i, j) that link."""
        roots = self.roots(members)
        may = np.flatnonzero(roots[i] != roots[j])
        may = may[self.fresh(members[i[may]], members[j[may]])]
        i, j = i[may], j[may]
        self.tests += len(i)
        step = max(1, BATCH // (1 + int((begin[1:] - begin[:-1]).max(initial=0))))
        top = int(token.max(initial=0)) + 1
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            keys = []
            for side in (x, y):
                lens = begin[side + 1] - begin[side]
                at = np.repeat(begin[side] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
                keys.append(np.repeat(np.arange(len(side)), lens) * top + token[at])
            keys = np.sort(np.concatenate(keys))
            both = np.bincount(keys[1:][keys[1:] == keys[:-1]] // top, minlength=len(x))
            link = self.d * (size[x] + size[y] - 2 * both) <= self.c * (self.n[members[x]] + self.n[members[y]])
            for a, b in zip(members[x[link]], members[y[link]]):
                self.unite(a, b)


def within(sizes: np.ndarray, linked: np.ndarray, differences: list[np.ndarray], percent: int) -> Family:
    """A block resolved in memory; those flagged as linked are connected from the start."""
    out = Family(sizes, percent)
    for i in np.flatnonzero(linked)[1:]:
        out.join(int(np.flatnonzero(linked)[0]), int(i))
    out.solve(differences)
    return out


ROWS = ("block", "node", "n", "size", "linked", "r")


def resolved(apart: DataFrame, percent: int, local: int | None = None) -> list[DataFrame]:
    """Links (a, b) that connect all linked members of each block of apart: block, node, n (size of its set), linked (connected to
    the others so flagged), r (differences from a set that the block's members have in common)."""
    local = local or LOCAL
    rows = apart.withColumn("size", F.size("r").cast("long")).select(*ROWS)
    out, left = [], [rows]
    while left:
        rows = staged(left.pop(), "family")
        total = staged(rows.groupBy("block").agg(F.sum(F.size("r")).alias("tokens"), F.count(F.lit(1)).alias("m")), "family-sizes")
        large = total.where((F.col("tokens") > local) & (F.col("m") > DIRECT))
        if large.isEmpty():
            out.append(staged(in_tasks(rows, percent), "family-links"))
        else:
            out.append(staged(in_tasks(joined(rows, total.where((F.col("tokens") <= local) | (F.col("m") <= DIRECT)), "block", "m").select(*ROWS), percent), "family-links"))
            stars, smaller = spread(joined(rows, large, "block", "m"), percent)
            out.append(stars)
            left.append(smaller)
        forget(rows, total)
    return out


def in_tasks(rows: DataFrame, percent: int) -> DataFrame:
    def run(block: pa.Table) -> pa.Table:
        nodes = block["node"].to_pylist()
        r = [np.array(x or [], np.int64) for x in block["r"].to_pylist()]
        links = within(block["n"].to_numpy(), block["linked"].to_numpy(), r, percent).links
        a, b = ([min(nodes[i], nodes[j]) for i, j in links], [max(nodes[i], nodes[j]) for i, j in links])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.select("block", "node", "n", "linked", "r").groupBy("block").applyInArrow(run, "a binary, b binary")


def spread(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links of stars, members of smaller blocks) of blocks too large for a task; rows have m, their block's members."""
    c, d = 100 - percent, 100 + percent
    tokens = rows.select("block", "m", F.explode("r").alias("token")).groupBy("block", "m", "token").agg(F.count(F.lit(1)).alias("count"))
    major = staged(tokens.where(2 * F.col("count") > F.col("m")).groupBy("block").agg(F.collect_list("token").alias("major"), F.max("m").alias("m")), "family-major")
    moved = joined(rows.drop("m"), major, "block", "m", "left").withColumn("major", F.coalesce("major", F.array().cast("array<bigint>")))
    flipped = moved.withColumn("r", F.concat(F.array_except("r", "major"), F.array_except("major", "r"))).drop("major", "m")
    flipped = staged(flipped.withColumn("size", F.size("r").cast("long")).withColumn("s", d * F.col("size") - c * F.col("n")), "family-moved")
    firsts = staged(flipped.groupBy("block").agg(F.min(F.struct("s", "node")).alias("first"), F.count(F.lit(1)).alias("m")), "family-firsts")
    both = joined(flipped, firsts, "block", "m")
    star = (F.col("s") + F.col("first.s") <= 0) & (F.col("node") != F.col("first.node"))
    stars = staged(both.where(star).select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")), "family-stars")
    held = both.select("block", "node", "s", F.col("first.s").alias("s0"), (F.col("s") + F.col("first.s") > 0).alias("loose"), F.explode("r").alias("token"))
    kinds = held.groupBy("block", "token").agg(F.count(F.lit(1)).alias("count"), F.bit_xor(F.xxhash64("node")).alias("marks"), F.max("loose").alias("loose")).where("count > 1 and loose").drop("loose")
    kinds = kinds.withColumn("kind", F.xxhash64("block", "marks", "count"))
    of_node = held.join(kinds, ["block", "token"]).groupBy("block", "node", "s", "s0", "loose", "kind").agg(F.count(F.lit(1)).alias("weight"), F.max("count").alias("count"))
    more = Window.partitionBy("block", "node").orderBy(F.col("count").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    least = F.when(F.col("loose"), F.col("s0")).otherwise(-F.col("s0"))  # a partner of one in the star isn't in the star
    kept = of_node.withColumn("rest", F.sum("weight").over(more)).where(2 * d * F.col("rest") >= F.col("s") + least).select("block", "node", "kind")
    members = kept.join(flipped, ["block", "node"]).select(F.col("kind").alias("block"), "node", "n", "size", F.lit(False).alias("linked"), "r")
    smaller = staged(members, "family-blocks")
    forget(major, flipped, firsts)
    return stars, smaller
