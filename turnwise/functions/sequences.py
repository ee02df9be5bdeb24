"""Similarity of step sequences and tactic sets, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = (0.5, 0.3, 0.2)  # fixed values: order, tactics, transitions


#: Elements of a list that a long's bits can stand for.
_BITS = 62


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence.

    Where no element of a repeats, one fold over b: a bit for each place of a says whether the common subsequence ends
    before it, and an addition carries all places on at once. Else a fold over a whose state is the last row of the table.
    """
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    full = bit(F.size(a)) - 1

    def step(v: Column, x: Column) -> Column:
        at = F.array_position(a, x).cast("int")
        u = F.when(at > 0, v.bitwiseAND(bit(at - 1))).otherwise(F.lit(0).cast("long"))
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)

    plain = (F.size(a) <= _BITS) & (F.size(F.array_distinct(a)) == F.size(a)) & ~F.exists(a, lambda x: x.isNull()) & ~F.exists(b, lambda x: x.isNull())
    return F.when(plain, F.size(a) - F.bit_count(F.aggregate(b, full, step))).otherwise(_lcs_table(a, b))


def _lcs_table(a: Column, b: Column) -> Column:
    zero = F.transform(F.concat(F.array(F.lit(0)), F.transform(b, lambda _: F.lit(0))), lambda x: x)

    def next_row(row: Column, x: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            up, diagonal = F.get(row, j), F.get(row, j - 1)
            return F.concat(new, F.array(F.when(F.get(b, j - 1) == x, diagonal + 1).otherwise(F.greatest(up, F.get(new, j - 1)))))

        return F.when(F.size(b) == 0, row).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array(F.lit(0)), cell))

    return F.get(F.aggregate(a, zero, next_row), F.size(b))


def bigrams(steps: Column) -> Column:
    """Distinct adjacent pairs, written ``a>b``."""
    n = F.size(steps)
    pairs = F.zip_with(F.slice(steps, 1, F.greatest(n - 1, F.lit(0))), F.slice(steps, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.concat_ws(">", x, y))
    return F.array_distinct(F.when(n < 2, F.array().cast("array<string>")).otherwise(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def order_similarity(a: Column, b: Column) -> Column:
    return F.lit(2.0) * lcs_length(a, b) / (F.size(a) + F.size(b))


def fingerprint_similarity(a_steps: Column, a_tactics: Column, b_steps: Column, b_tactics: Column) -> Column:
    """Weighted order, tactic and transition similarity; 0 if either side has no steps."""
    total = WEIGHTS[0] * order_similarity(a_steps, b_steps) + WEIGHTS[1] * jaccard(a_tactics, b_tactics) + WEIGHTS[2] * jaccard(bigrams(a_steps), bigrams(b_steps))
    return F.when((F.size(a_steps) == 0) | (F.size(b_steps) == 0), F.lit(0.0)).otherwise(total)


def step_cell(steps: Column, names: Iterable[str]) -> Column:
    """The set of a list's steps as bits, in the order of ``names``; one bit more if a step repeats or is none of them."""
    names = tuple(names)
    table = F.array(*[F.lit(n) for n in names])
    known = F.array_intersect(steps, table)
    bits = F.aggregate(known, F.lit(0), lambda m, s: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.array_position(table, s).cast("int") - 1)))
    return bits.bitwiseOR(F.when(F.size(known) < F.size(steps), 1 << len(names)).otherwise(0))


def most_similar(a: Column, b: Column, names: int) -> Column:
    """What fingerprints of two step cells can reach at most: common steps bound the common subsequence and one less the transitions."""
    la, lb, c = F.bit_count(a), F.bit_count(b), F.bit_count(a.bitwiseAND(b))
    moves = F.greatest(c - 1, F.lit(0))
    none = (la < 2) & (lb < 2)
    bound = WEIGHTS[0] * 2 * c / F.greatest(la + lb, F.lit(1)) + WEIGHTS[1] + WEIGHTS[2] * F.when(none, 1.0).otherwise(moves / F.greatest(la + lb - 2 - moves, F.lit(1)))
    return F.when((a == 0) | (b == 0), 0.0).when((a >= 1 << names) | (b >= 1 << names), 1.0).otherwise(bound)


def bounded_similarity(a_steps: Column, a_tactics: Column, b_steps: Column, b_tactics: Column, least: Column) -> Column:
    """``fingerprint_similarity`` where it can reach ``least``, else null: sets are compared first, and the order only if they leave room."""
    sets = WEIGHTS[1] * jaccard(a_tactics, b_tactics) + WEIGHTS[2] * jaccard(bigrams(a_steps), bigrams(b_steps))
    order = WEIGHTS[0] * 2 * F.least(F.size(a_steps), F.size(b_steps)) / F.greatest(F.size(a_steps) + F.size(b_steps), F.lit(1))
    return F.when(sets + order >= least - 1e-9, fingerprint_similarity(a_steps, a_tactics, b_steps, b_tactics))


def partial_similarity(live_steps: Column, live_tactics: Column, proto_steps: Column, proto_tactics: Column) -> Column:
    """How far a conversation so far runs along a prototype: against the prototype's first k+1 steps, damped while k is under 4."""
    k = F.size(live_steps)
    prefix = F.slice(proto_steps, 1, k + 1)
    order = lcs_length(live_steps, prefix) / k
    covered = F.when(F.size(live_tactics) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(live_tactics, proto_tactics)) / F.size(live_tactics))
    moves = F.when(k > 1, jaccard(bigrams(live_steps), bigrams(prefix))).otherwise(order)
    total = (WEIGHTS[0] * order + WEIGHTS[1] * covered + WEIGHTS[2] * moves) * F.least(F.lit(1.0), F.sqrt(k / F.lit(4.0)))
    return F.when((k == 0) | (F.size(proto_steps) == 0), F.lit(0.0)).otherwise(total)


def percent(score: Column) -> Column:
    """Half-even percent."""
    return F.bround(score * 100).cast("int")


def display_percent(score: Column) -> Column:
    """Percent as a display rounds it: half up."""
    return F.floor(score * 100 + 0.5).cast("int")


def first_unseen(steps: Column, seen: Column) -> Column:
    """The first step of a list that another doesn't have; null if none."""
    return F.get(F.filter(steps, lambda s: ~F.array_contains(seen, s)), F.lit(0))


def next_after_subsequence(partial: Column, steps: Column) -> Column:
    """The step after the place where ``partial`` is matched greedily as a subsequence of ``steps``; null if it isn't one or nothing follows."""
    zero = F.struct(F.lit(0).alias("p"), F.lit(-1).alias("at"), F.lit(0).alias("i"))

    def walk(acc: Column, s: Column) -> Column:
        hit = (acc["p"] < F.size(partial)) & (F.get(partial, acc["p"]) == s)
        return F.struct(F.when(hit, acc["p"] + 1).otherwise(acc["p"]).alias("p"), F.when(hit, acc["i"]).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"))

    end = F.aggregate(steps, zero, walk)
    return F.when((end["p"] == F.size(partial)) & (end["at"] + 1 < F.size(steps)), F.get(steps, end["at"] + 1))
