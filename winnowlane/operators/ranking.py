"""Ranking by single elimination with a second chance, replayed from a log of answers.

A field is drawn by a seed and played as a seeded bracket. The place just decided leaves its slot to
those its holder had beaten, and the bracket of slots is played again; answers that are on record are
not asked for anew. The course of questions is a coroutine: it yields a match and is sent the winner.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowlane.operators.order import fold_units
from winnowlane.operators.staged import shuffled

#: Multiplier that varies the draw from place to place.
PLACE_MIX = 2654435761


def seed_slots(size: int) -> list[int]:
    """Seeds in bracket order for a power of two: best against worst, the two best in different halves."""
    out = [1]
    while len(out) < size:
        total = 2 * len(out) + 1
        out = [s for x in out for s in (x, total - x)]
    return out


def seed_slots_expr(rounds: Column) -> Column:
    """The same as a native fold over so many doublings."""
    grow = lambda acc, _: F.flatten(F.transform(acc, lambda x: F.array(x, 2 * F.size(acc) + 1 - x)))
    return F.aggregate(F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>")), F.array(F.lit(1)), grow)


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


@dataclass
class Record:
    """What is known of a ranking so far."""

    order: list
    places: list = field(default_factory=list)
    beat: dict = field(default_factory=dict)  # winner: those it met and beat, in order
    depth: dict = field(default_factory=dict)  # deepest round of the first bracket
    wins: dict = field(default_factory=dict)
    asked: int = 0
    reused: int = 0
    deferred: int = 0
    broke: str | None = None
    pending: tuple | None = None  # match id and its two sides

    def winner(self, a, b):
        return a if b in self.beat.get(a, ()) else b if a in self.beat.get(b, ()) else None

    def note(self, w, loser) -> None:
        if loser not in self.beat.setdefault(w, []):
            self.beat[w].append(loser)

    def ranking(self) -> list:
        """Places first, then the others by depth, wins and draw."""
        rank = {x: i for i, x in enumerate(self.order)}
        rest = [x for x in self.order if x not in set(self.places)]
        return self.places + sorted(rest, key=lambda x: (-self.depth.get(x, 0), -self.wins.get(x, 0), rank[x]))


def _bracket(r: Record, slots: list, tag: str) -> Generator[tuple, object, object]:
    """Plays slots (None: empty) to one winner; yields (match id, a, b) and is sent the winner, or None to defer."""
    size = power_of_two(len(slots))
    field_ = [slots[s - 1] if s <= len(slots) else None for s in seed_slots(size)]
    for round_ in range(size.bit_length()):
        live = [x for x in field_ if x is not None]
        if len(live) <= 1:
            return live[0] if live else None
        if tag == "main":
            r.depth.update((x, max(r.depth.get(x, 0), round_)) for x in live)
        result: list = [None] * (len(field_) // 2)
        queue = []
        for p in range(len(result)):
            a, b = field_[2 * p], field_[2 * p + 1]
            if a is None or b is None:
                result[p] = a if b is None else b
            elif (known := r.winner(a, b)) is not None:
                result[p], r.reused = known, r.reused + 1
            else:
                queue.append(p)
        while queue:
            p = queue.pop(0)
            a, b = field_[2 * p], field_[2 * p + 1]
            w = yield (f"{tag}:r{round_}:p{p}", a, b)
            if w is None:
                queue.append(p)
                continue
            result[p] = w
            r.asked += 1
            r.wins[w] = r.wins.get(w, 0) + 1
            r.note(w, b if w == a else a)
        field_ = result
    return field_[0]


def course(r: Record, target: int, seed: int) -> Generator[tuple, object, None]:
    """All matches until ``target`` places are decided."""
    slots, tag = list(r.order), "main"
    chance: list | None = None
    while len(r.places) < target and any(x is not None for x in slots):
        best = yield from _bracket(r, slots, tag)
        if best is None:
            return
        r.places.append(best)
        if len(r.places) >= target:
            return
        place = len(r.places) + 1
        fresh = [x for x in r.beat.get(best, []) if x not in r.places and (chance is None or x not in chance)]
        draw = {x: i for i, x in enumerate(shuffled(sorted(fresh), (seed ^ (place * PLACE_MIX)) % 2**32))}
        fresh.sort(key=lambda x: (-r.depth.get(x, 0), -r.wins.get(x, 0), draw[x]))
        if chance is None:
            chance = fresh + [None] * (power_of_two(max(1, len(fresh))) - len(fresh))
        else:
            at = chance.index(best)
            chance[at] = fresh.pop(0) if fresh else None
            while fresh:
                if None not in chance:
                    chance += [None] * len(chance)
                chance[chance.index(None)] = fresh.pop(0)
        slots, tag = list(chance), f"rep{place}"


def replay(pool: list, target: int, seed: int, ops: list[dict]) -> Record:
    """The record after a log of {'t': 'pick' or 'defer', 'm': match id or None, 'w': winner}.

    ``broke`` says where a log doesn't fit; what came before it stands. ``pending`` is the match asked for next.
    """
    r = Record(shuffled(pool, seed))
    matches = course(r, max(0, min(target, len(pool))), seed)
    r.pending = next(matches, None)
    for i, op in enumerate(ops):
        if r.pending is None:
            r.broke = f"op {i} past completion"
            break
        mid, a, b = r.pending
        if op.get("m") and op["m"] != mid:
            r.broke = f"op {i} is for {op['m']}, the bracket is at {mid}"
            break
        if op["t"] == "defer":
            r.deferred += 1
            answer = None
        elif op.get("w") in (a, b):
            answer = op["w"]
        else:
            r.broke = f"op {i} picks {op.get('w')}, which is not in {mid}"
            break
        try:
            r.pending = matches.send(answer)
        except StopIteration:
            r.pending = None
    return r


def judge(pool: list, target: int, seed: int, better: Callable[[object, object], object]) -> tuple[Record, list[dict]]:
    """A ranking by a judge, and the log it leaves."""
    r, log = Record(shuffled(pool, seed)), []
    matches = course(r, max(0, min(target, len(pool))), seed)
    match = next(matches, None)
    while match is not None:
        mid, a, b = match
        w = better(a, b)
        log.append({"t": "pick", "m": mid, "w": w})
        try:
            match = matches.send(w)
        except StopIteration:
            match = None
    return r, log


RANKED = "place long, decided boolean, comparisons long, reused long"


def rank_by_score(rows: DataFrame, unit: str, key: str, score: str, target: int, seed: int) -> DataFrame:
    """unit, key, place, decided, comparisons, reused: each unit's field ranked by matches; ties to the smaller key."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (unit, key)}

    def fold(u, columns: dict[str, list]) -> dict[str, list]:
        strength = {k: (s, -i) for i, (k, s) in enumerate(zip(columns[key], columns[score]))}
        r, _ = judge(columns[key], target, seed, lambda a, b: a if strength[a] > strength[b] else b)
        out = r.ranking()
        n = len(out)
        return {unit: [u] * n, key: out, "place": list(range(1, n + 1)), "decided": [i < len(r.places) for i in range(n)], "comparisons": [r.asked] * n, "reused": [r.reused] * n}

    return fold_units(rows.select(unit, key, score), unit, [key], fold, f"{unit} {kinds[unit]}, {key} {kinds[key]}, {RANKED}")


def rank_from_log(pool: DataFrame, ops: DataFrame, target: int, seed: int) -> DataFrame:
    """unit, id, place, decided, broke: rankings rebuilt from op logs (unit, seq, type, mid, winner)."""
    schema = f"unit {pool.schema['unit'].dataType.simpleString()}, id {pool.schema['id'].dataType.simpleString()}, place long, decided boolean, broke string"

    def fold(u, c: dict[str, list]) -> dict[str, list]:
        members = [x for x, own in zip(c["id"], c["member"]) if own]
        steps = [{"t": t, "m": m, "w": w} for t, m, w, own in zip(c["type"], c["mid"], c["winner"], c["member"]) if not own]
        r = replay(sorted(members), target, seed, steps)
        out = r.ranking()  # empty: a log without a pool
        n = len(out)
        return {"unit": [u] * n, "id": out, "place": list(range(1, n + 1)), "decided": [i < len(r.places) for i in range(n)], "broke": [r.broke] * n}

    # a pool and its log come as rows of one unit, the log in its order
    both = pool.select("unit", "id", F.lit(True).alias("member")).unionByName(ops.select("unit", "seq", "type", "mid", "winner", F.lit(False).alias("member")), allowMissingColumns=True)
    return fold_units(both, "unit", [F.col("seq").asc_nulls_last()], fold, schema, ["unit", "id", "member", "type", "mid", "winner"])


def undo(ops: DataFrame, unit: str = "unit") -> DataFrame:
    """Each unit's log without its last pick and the deferrals after it; without picks, without the last deferral."""
    last = ops.groupBy(unit).agg(F.max(F.when(F.col("type") == "pick", F.col("seq"))).alias("p"), F.max("seq").alias("m"))
    return ops.join(last, unit).where(F.col("seq") < F.coalesce("p", "m")).drop("p", "m")


def rename(ops: DataFrame, old, new) -> DataFrame:
    return ops.withColumn("winner", F.when(F.col("winner") == F.lit(old), F.lit(new)).otherwise(F.col("winner")))


def top_k(rows: DataFrame, unit: str, order: list[Column], cap: int | None) -> DataFrame:
    """The first rows of each unit; all of them without a cap. Spark cuts each partition before it shuffles."""
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy(unit).orderBy(*order)))
    return out if cap is None else out.where(F.col("place") <= cap)


def chosen_or_top(ranked: DataFrame, chosen: DataFrame, unit: str, key: str, cap: int | None) -> DataFrame:
    """The chosen rows of each unit in ranked order; of a unit without a choice, the first up to the cap."""
    picked = ranked.join(chosen.select(unit, key), [unit, key], "left_semi")
    rest = ranked.join(picked.select(unit).distinct(), unit, "left_anti")
    return picked.unionByName(rest if cap is None else rest.where(F.col("place") <= cap))


def left_to_ask(entrants: int, decided: int, reused: int, target: int, placed: int, field_size: int) -> int:
    """Comparisons still to come: the running bracket's, and about a path's length for each later place."""
    later = target - placed - (1 if entrants else 0)
    path = max(1, math.ceil(math.log2(max(2, field_size))) - 1)
    return max(0, (entrants - 1 - decided - reused if entrants else 0) + max(0, later) * path)


def left_to_ask_expr(entrants: Column, decided: Column, reused: Column, target: Column, placed: Column, field_size: Column) -> Column:
    """The same of columns of whole numbers."""
    running = entrants > 0
    later = target - placed - F.when(running, 1).otherwise(0)
    # the binary digits of n - 1 are the rounds of n: no logarithm that may round
    path = F.greatest(F.lit(1), F.length(F.bin(F.greatest(F.lit(2), field_size) - 1)) - 1)
    return F.greatest(F.lit(0), F.when(running, entrants - 1 - decided - reused).otherwise(0) + F.greatest(F.lit(0), later) * path).cast("long")


def runoff(winners: DataFrame, groups: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Winners' groups of two and more, to choose from: unit, group_id, id, keep.

    ``kept`` (id) are chosen members; a group without any keeps its winner, so none is empty.
    """
    g = groups.join(groups.groupBy("unit", "group_id").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["unit", "group_id"], "left_semi")
    faced = winners.join(g, ["unit", "id"]).select("unit", "group_id", F.col("id").alias("winner"))
    rows = g.join(faced, ["unit", "group_id"])
    mark = F.lit(None).cast("boolean") if kept is None else F.col("chosen")
    rows = rows if kept is None else rows.join(kept.select("id", F.lit(True).alias("chosen")), "id", "left")
    rows = rows.withColumn("pick", F.coalesce(mark, F.lit(False)))
    some = F.max(F.col("pick").cast("int")).over(Window.partitionBy("unit", "group_id")) == 1
    return rows.withColumn("keep", F.when(some, F.col("pick")).otherwise(F.col("id") == F.col("winner"))).select("unit", "group_id", "id", "keep")


def after_runoff(winners: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """unit, id and ord of what stands after a runoff: for each winner (unit, id, ord) what its group keeps, each once, in the order of the winners."""
    kept = rows.where("keep").select("unit", "group_id", "id")
    faced = winners.join(groups.select("unit", "group_id", "id"), ["unit", "id"], "left")
    big = rows.select("unit", "group_id").distinct()
    own = faced.join(big, ["unit", "group_id"], "left_anti").select("unit", "id", "ord")
    more = faced.select("unit", "group_id", "ord").join(kept, ["unit", "group_id"]).select("unit", "id", "ord")
    return own.unionByName(more).groupBy("unit", "id").agg(F.min("ord").alias("ord"))


def over_target(n: Column, target: Column) -> Column:
    return F.greatest(F.lit(0), n - target)


def final_unit(winners: DataFrame, target: int) -> DataFrame:
    """One unit over all units' winners, each once, for a last ranking; empty unless there are two at least."""
    once = winners.groupBy("id").agg(F.min("ord").alias("ord"))
    n = once.agg(F.count("*").alias("n"))
    return once.crossJoin(F.broadcast(n)).where("n > 1").select(F.lit("final").alias("unit"), "id", "ord", F.least(F.lit(target), F.col("n")).alias("target"))
