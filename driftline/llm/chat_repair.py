"""Chat formatting: repair the roles of conversations at least cost, then render them.

A legal conversation is an optional system turn, then user and assistant turns in
alternation that begin with the user. Dynamic programming over that automaton picks for each turn
whether it stays, gets another role, joins the turn before it, or needs empty turns before it.
Costs add along the turns, so a run of turns is a matrix of least costs from state to state.
Conversations that are too long for one task are cut into runs. Products of their matrices give the
costs that each run begins with; with these a run says from which state it came to each of its last
ones, and those answers, followed from the end, fix the states at the borders. So each turn gets what it would get in one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import modest_batches, written

ROLES = ("system", "user", "assistant")
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 4, 1, 1, 6
LONG, LONG_CHARS = 4096, 1 << 24  # turns and characters of a conversation that are solved at once
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
STEPS = {(BEGIN, SYSTEM), (BEGIN, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"
JOINT = "\n\n"
SCHEMA = "conv_id long, turn long, role string, new_role string, action string, inserted string, cost long, piece string"
FAR = 1 << 40


def _empty_turns(start: int) -> dict[int, tuple[int, tuple[int, ...]]]:
    """State -> (cost, empty turns): the cheapest ways on from start by empty turns alone."""
    found = {start: (0, ())}
    for _ in STATES:
        for s, (c, path) in sorted(found.items()):
            for a, b in sorted(STEPS):
                if a == s and (b not in found or c + INSERT < found[b][0]):
                    found[b] = (c + INSERT, (*path, b))
    return found


def _moves(role: int | None) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """(state before, after) -> (cost, action, empty turns before it) for a turn of a role; None is any unknown role."""
    change = lambda to: 0 if to == role else RELABEL_UNKNOWN if role is None else RELABEL
    out = {}
    for s in STATES:
        options = []
        if s != BEGIN:
            options.append((s, MERGE + change(s), "merge" if change(s) == 0 else "relabel+merge", ()))
        for mid, (c, path) in _empty_turns(s).items():
            options += [(b, c + change(b), "keep" if change(b) == 0 else "relabel", path) for a, b in STEPS if a == mid]
        for b, cost, action, path in sorted(options, key=lambda o: (o[1], o[2], o[3])):
            out.setdefault((s, b), (cost, action, path))
    return out


MOVES = {role: _moves(role) for role in (SYSTEM, USER, ASSISTANT, None)}
#: after the last turn: cost and empty turns until the conversation may end
ENDS = {s: min((c, p) for t, (c, p) in _empty_turns(s).items() if t in (USER, ASSISTANT)) for s in STATES}


def role_of(role: str | None) -> int | None:
    role = (role or "").strip().lower()
    return ROLES.index(role) + 1 if role in ROLES else None


def run_matrix(roles: list[int | None]) -> list[int]:
    """Least costs from each state to each other over the turns, by rows."""
    out = []
    for s in STATES:
        best = [0 if t == s else FAR for t in STATES]
        for r in roles:
            nxt = [FAR] * 4
            for (a, b), (c, _, _) in MOVES[r].items():
                nxt[b] = min(nxt[b], best[a] + c)
            best = nxt
        out += [min(x, FAR) for x in best]
    return out


def forward(roles: list[int | None], costs: list[int]) -> tuple[list[int], list[list[int]]]:
    """Least costs of the states after the turns, from those before; and per turn the state that each came from, the first of equals."""
    best, back = costs, []
    for r in roles:
        nxt, came = [FAR] * 4, [0] * 4
        for (a, b), (c, _, _) in sorted(MOVES[r].items()):
            if best[a] + c < nxt[b]:
                nxt[b], came[b] = best[a] + c, a
        best = nxt
        back.append(came)
    return best, back


def last_state(costs: list[int]) -> int:
    """Where the cheapest conversation stands after its last turn, the first of equals."""
    return min(STATES, key=lambda s: (costs[s] + ENDS[s][0], s))


def entries(roles: list[int | None], costs: list[int]) -> list[int]:
    """For each state after the turns the state before them."""
    at = list(STATES)
    for came in reversed(forward(roles, costs)[1]):
        at = [came[s] for s in at]
    return at


START = [0, FAR, FAR, FAR]


def solve(roles: list[int | None], costs: list[int] = START, leave: int | None = None) -> list[tuple[int, str, tuple[int, ...], int]]:
    """(new role, action, empty turns before, cost) of each turn at least cost. costs are those of the states before the
    turns; leave is the state after them, None: any that may end."""
    best, back = forward(roles, costs)
    at = last_state(best) if leave is None else leave
    out = []
    for k in range(len(roles) - 1, -1, -1):
        before = back[k][at]
        cost, action, empty = MOVES[roles[k]][before, at]
        out.append((at, action, empty, cost))
        at = before
    return out[::-1]


def _quoted(text: str | None) -> str:
    """Text in which the markers of turns can't be mistaken for real ones."""
    return (text or "").replace("<|im_", "<| im_")


def rows_of(turns: list[tuple], entry: int = BEGIN, costs: list[int] = START, leave: int | None = None, last: bool = True) -> list[tuple]:
    """Output rows of turns (conv_id, turn, role, text) in order, which begin in the state entry; joined, their pieces are the rendered conversation."""
    if not turns:
        return []
    out, state = [], entry
    plan = solve([role_of(t[2]) for t in turns], costs, leave)
    for (conv, turn, role, text), (to, action, empty, cost) in zip(turns, plan, strict=True):
        if action.endswith("merge"):
            piece = JOINT + _quoted(text)
        else:
            piece = "" if state == BEGIN else CLOSE
            piece += "".join(OPEN.format(ROLES[e - 1]) + CLOSE for e in empty)
            piece += OPEN.format(ROLES[to - 1]) + _quoted(text)
        state = to
        out.append([conv, turn, role, ROLES[to - 1], action, ",".join(ROLES[e - 1] for e in empty), cost, piece])
    if last:
        cost, empty = ENDS[state]
        out[-1][6] += cost
        out[-1][7] += CLOSE + "".join(OPEN.format(ROLES[e - 1]) + CLOSE for e in empty)
    return [tuple(r) for r in out]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = dict(zip([c.split()[0] for c in SCHEMA.split(", ")], zip(*rows, strict=True), strict=True))
    return pd.DataFrame(columns | {c: pd.array(columns[c], "Int64") for c in ("conv_id", "turn")})


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows of one key, over the borders of batches. Null keys are equal."""
    at, rows = None, []
    for batch in batches:
        frame = batch.astype(object).where(batch.notna(), None)
        n = len(keys)
        for row in frame.itertuples(index=False, name=None):
            if row[:n] != at:
                if rows:
                    yield at, rows
                at, rows = row[:n], []
            rows.append(row[n:])
    if rows:
        yield at, rows


def _int(x):
    return None if x is None else int(x)


ORDER = ["conv_id", "turn", "tie1", "tie2"]


def repair(talks: DataFrame, long: int = LONG, long_chars: int = LONG_CHARS) -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action, inserted, cost, piece.

    `talks` has conv_id, turn, role and text; other columns are ignored. Turns go by turn,
    null first, and equal ones by two 64-bit hashes of role and text; rows that repeat are turns of their own.
    Roles are compared in lower case; null and unknown ones cost less to relabel. Null text is
    empty. The pieces of a conversation, joined in that order, are its rendering; the last row
    has the end and the cost of any empty turns there. Rows without a conv_id are one
    conversation. Of repairs of equal cost the one is taken whose states, read from the end, come first. Conversations of more than
    `long` turns or long_chars characters are solved in runs, with the same rows as result, so no
    task holds more than that of one, or one text if that is longer. An empty table gives no rows.
    """
    modest_batches(talks.sparkSession)
    ties = [F.xxhash64(talks["role"], talks["text"], F.lit(k)).alias(f"tie{k}") for k in (1, 2)]
    rows = talks.select(
        talks["conv_id"].cast("long").alias("conv_id"), talks["turn"].cast("long").alias("turn"), talks["role"].alias("role"), talks["text"].alias("text"), *ties
    )
    as_text = [F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text"]  # pandas would make floats of longs with nulls
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    # at most a row for every `long` turns or `long_chars` characters, so its size is that of a small fraction of the input
    big = written(sizes.where((F.col("n") > long) | (F.col("chars") > long_chars)).select(F.col("conv_id").alias("big"), F.lit(True).alias("is_big")), "long-talks")
    marked = rows.join(F.broadcast(big), F.col("conv_id").eqNullSafe(F.col("big")), "left").drop("big")
    short = marked.where("is_big is null").drop("is_big").repartition("conv_id").sortWithinPartitions(*ORDER).select(*as_text)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (conv,), turns in _grouped(batches, ["conv_id"]):
            out += rows_of([(_int(conv), _int(t), r, x) for t, r, x in turns])
            if len(out) >= LONG:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    done = short.mapInPandas(whole, SCHEMA)
    if big.isEmpty():
        return done
    return done.unionByName(_repair_long(marked.where("is_big").drop("is_big"), long, long_chars))


def _repair_long(rows: DataFrame, long: int, long_chars: int) -> DataFrame:
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keyed = rows.withColumn("tie", F.monotonically_increasing_id())  # splits what repeats; the range's samples hold numbers only
    ranged = keyed.repartitionByRange(n, *ORDER, "tie").sortWithinPartitions(*ORDER, "tie").withColumn("part", F.spark_partition_id())

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, run, held, chars = None, -1, 0, 0
        for batch in batches:
            conv = batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None).tolist()
            runs, places = [], []
            for c, size in zip(conv, batch["text"].str.len().fillna(0), strict=True):
                if (c,) != at or held == long or held and chars + size > long_chars:
                    at, run, held, chars = (c,), run + 1, 0, 0
                runs.append(run)
                places.append(held)
                held, chars = held + 1, chars + size
            yield batch.assign(run=runs, place=places)

    ranged = ranged.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "part")
    schema = "conv_id string, turn string, role string, text string, part int, run long, place long"
    runs = written(ranged.mapInPandas(numbered, schema), "runs")
    key = ["part", "run"]
    roles = runs.select(*key, "conv_id", "place", "role").repartition(*key).sortWithinPartitions(*key, "place")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (part, run, conv), turns in _grouped(batches, [*key, "conv_id"]):
            yield pd.DataFrame({"part": [part], "run": [run], "conv_id": [conv], "m": [run_matrix([role_of(r) for _, r in turns])]})

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The costs that each run begins with, a few numbers for each."""
        for (conv,), found in _grouped(batches, ["conv_id"]):
            best, out = START, []
            for part, run, m in found:
                out.append((part, run, conv, best))
                best = [min(FAR, *(best[a] + m[4 * a + b] for a in STATES)) for b in STATES]
            last = last_state(best)
            yield pd.DataFrame([(*row, last if k == len(out) - 1 else None) for k, row in enumerate(out)], columns=[*key, "conv_id", "costs", "leave"]).astype({"leave": "Int64"})

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (part, run, conv, leave), turns in _grouped(batches, [*key, "conv_id", "leave"]):
            costs = turns[0][0]
            came = entries([role_of(r) for _, _, r in turns], [int(c) for c in costs])
            out = pd.DataFrame({"part": [part], "run": [run], "conv_id": [conv], "costs": [costs], "leave": [leave], "came": [came]})
            yield out.astype({"leave": "Int64"})

    def borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The states at the ends of the runs of each conversation, from the last to the first."""
        for _, found in _grouped(batches, ["conv_id"]):
            at, out = int(found[-1][3]), []
            for part, run, costs, leave, came in reversed(found):
                out.append((part, run, int(came[at]), costs, at, leave is not None))
                at = int(came[at])
            yield pd.DataFrame(out, columns=[*key, "entry", "costs", "leave", "last"])

    by_talk = lambda df, *columns: df.select("conv_id", *key, *columns).repartition("conv_id").sortWithinPartitions("conv_id", *key)
    costs = written(roles.mapInPandas(matrices, "part int, run long, conv_id string, m array<long>"), "matrices")
    costs = written(by_talk(costs, "m").mapInPandas(begun, "part int, run long, conv_id string, costs array<long>, leave long"), "begun")
    met = roles.join(costs.drop("conv_id"), key).repartition(*key).sortWithinPartitions(*key, "place")
    met = met.select(*key, "conv_id", "leave", "costs", "place", "role")
    came = written(met.mapInPandas(traced, "part int, run long, conv_id string, costs array<long>, leave long, came array<long>"), "traced")
    edges = by_talk(came, "costs", "leave", "came").mapInPandas(borders, "part int, run long, entry int, costs array<long>, leave int, last boolean")
    edges = written(edges, "borders")

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, _, entry, leave, last), turns in _grouped(batches, [*key, "entry", "leave", "last"]):
            costs = [int(c) for c in turns[0][0]]
            yield _frame(rows_of([(_int(c), _int(t), r, x) for _, _, c, t, r, x in turns], int(entry), costs, int(leave), bool(last)))

    final = runs.join(edges, key).repartition(*key).sortWithinPartitions(*key, "place")
    return final.select(*key, "entry", "leave", "last", "costs", "place", "conv_id", "turn", "role", "text").mapInPandas(solved, SCHEMA)
