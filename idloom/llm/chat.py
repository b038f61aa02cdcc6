"""Operator 6, chat formatting with minimum-cost role repair.

A conversation is legal when it is an optional system turn, then user and assistant turns in alternation, user first, assistant
last. A dynamic program over the automaton of legal turns repairs any sequence of roles at least cost. For each turn it may

* keep it, when its role is next (cost 0);
* merge it into the turn before, when the roles are equal (cost MERGE), or, as another role, RELABEL more;
* relabel it to the role that is next (cost RELABEL);
* first insert an empty turn of the role that is next (cost INSERT each), then do one of these.

A turn whose role is unknown (none of ROLES in lower case without blanks; NULL too) can only be relabelled. Of repairs of
equal cost the one is taken whose first differing step is earlier in the order keep, merge, relabel, insert. The repaired turns are
rendered as <|role|> line, text, <|end|> line. No text can pass for a marker: each <| in it, with any backslashes between, gets one backslash
more before its bar, which a reader can take back.

Plan: one shuffle gathers a conversation's turns, in order; roles alone go to the program, and texts stay in Spark; a worker remembers some
thousands of sequences of roles; the rendering is done by Spark from the steps, in time linear in the text.

Defined cases: turns are ordered by turn, then role, then text, NULLs first; a turn that repeats a whole row is a turn;
NULL texts are empty; of rows without conv_id no two are known to belong together: each is a conversation; a conversation whose turns are
all empty is repaired like any other. A last user turn gets an empty answer inserted if that costs least. Texts of any length are rendered whole.
Only conv_id, of any type, turn, role and text are read; columns of any other name are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROLES = ("system", "user", "assistant")
#: States of the automaton: nothing yet, or the role of the last turn.
START = 3
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
FINAL = 2
MERGE, RELABEL, INSERT = 1, 2, 3
KEEP_STEP, MERGE_STEP, RELABEL_STEP, INSERT_STEP = range(4)

Step = tuple[int, int]
"""(kind, role); an insertion stands before the step of its turn, or at the end."""


def repair(roles: list[int]) -> tuple[int, list[Step]]:
    """Least cost and steps; a role is 0, 1 or 2, or -1 where unknown. No turns need no repair."""
    if not roles:
        return 0, []
    n = len(roles)
    # cheapest way to the end from (turn, state), backwards; then the first of the cheapest steps, forwards
    end = {s: 0 if s == FINAL else INSERT * (2 if s in (START, 0) else 1) for s in NEXT}
    best = [dict[int, int]() for _ in range(n)] + [end]

    def moves(i: int, s: int) -> Iterator[tuple[Step, int, int, int]]:
        """Step, cost, next turn, next state."""
        if i < n:
            r = roles[i]
            if r in NEXT[s]:
                yield (KEEP_STEP, r), 0, i + 1, r
            if s != START:
                yield (MERGE_STEP, s), MERGE if r == s else MERGE + RELABEL, i + 1, s
            for x in NEXT[s]:
                if x != r:
                    yield (RELABEL_STEP, x), RELABEL, i + 1, x
        if i < n or s != FINAL:
            for x in NEXT[s]:
                yield (INSERT_STEP, x), INSERT, i, x

    for i in range(n - 1, -1, -1):
        at = {s: min((c + best[j][x] for (k, _), c, j, x in moves(i, s) if k != INSERT_STEP), default=1 << 30) for s in NEXT}
        for _ in NEXT:  # insertions lead from state to state of one turn
            at = {s: min([at[s], *(INSERT + at[x] for x in NEXT[s])]) for s in NEXT}
        best[i] = at
    steps, i, s = [], 0, START
    while i < n or s != FINAL:
        step, i, s = next((step, j, x) for step, c, j, x in moves(i, s) if c + best[j][x] == best[i][s])
        steps.append(step)
    return best[0][START], steps


@functools.lru_cache(maxsize=1 << 14)
def _plan(roles: tuple[int, ...]) -> tuple[int, list[int], list[str], list[int]]:
    """Cost; and of each step: kind, role, and the number of the text that it takes (from 1; 0 for an insertion)."""
    cost, steps = repair(list(roles))
    kinds = [k for k, _ in steps]
    takes = np.cumsum([k != INSERT_STEP for k in kinds], dtype=int).tolist()
    return cost, kinds, [ROLES[x] for _, x in steps], [0 if k == INSERT_STEP else n for k, n in zip(kinds, takes, strict=True)]


def _solver() -> object:
    """Roles to the parts of their plan."""

    @F.arrow_udf("struct<cost:int,kinds:array<int>,names:array<string>,takes:array<int>>")
    def solve(roles: pa.Array) -> pa.Array:
        plans = [_plan(tuple(r)) for r in roles.to_pylist()]
        cost, kinds, names, takes = (list(c) for c in zip(*plans, strict=True)) if plans else ([],) * 4
        ints = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(cost, pa.int32()), pa.array(kinds, ints), pa.array(names, pa.list_(pa.string())), pa.array(takes, ints)], ["cost", "kinds", "names", "takes"])

    return solve


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, cost, merged, relabelled, inserted, rendered: a row for each conversation."""
    clean = F.lower(F.regexp_replace(F.coalesce("role", F.lit("")), r"\s", ""))
    code = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in ROLES]), clean), F.lit(0)).cast("int") - 1, F.lit(-1))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = conversations.select("conv_id", alone.alias("alone"), F.struct("turn", "role", "text", code.alias("code")).alias("t")).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("ts"))
    ready = turns.select("conv_id", F.transform("ts", lambda t: t["code"]).alias("roles"), F.transform("ts", lambda t: escaped(F.coalesce(t["text"], F.lit("")))).alias("texts"))
    solved = ready.withColumn("plan", _solver()(F.col("roles"))).select("conv_id", "texts", "plan.*")

    def piece(s, j):  # noqa: ANN001, ANN202
        text = F.coalesce(F.get("texts", s["takes"] - 1), F.lit(""))
        head = F.concat(F.when(j == 0, F.lit("<|")).otherwise(F.lit("\n<|end|>\n<|")), s["names"], F.lit("|>\n"))
        return F.concat(F.when(s["kinds"] == MERGE_STEP, F.lit("\n")).otherwise(head), text)

    count = lambda step: F.size(F.filter("kinds", lambda k: k == step))
    pieces = F.transform(F.arrays_zip("kinds", "names", "takes"), piece)
    rendered = F.concat(F.array_join(pieces, ""), F.lit("\n<|end|>\n"))
    return solved.select("conv_id", F.size("texts").alias("n_turns"), "cost", count(MERGE_STEP).alias("merged"), count(RELABEL_STEP).alias("relabelled"), count(INSERT_STEP).alias("inserted"), rendered.alias("rendered"))


def _by_turn(a, b):  # noqa: ANN001, ANN202
    """Order of turns: by turn, role, text, NULLs first."""

    def one(f: str, otherwise):  # noqa: ANN001, ANN202
        x, y = a[f], b[f]
        return F.when(x.isNull() & y.isNull(), otherwise).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(otherwise)

    return one("turn", one("role", one("text", F.lit(0))))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
