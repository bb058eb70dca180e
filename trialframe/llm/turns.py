"""Repair of conversation structure by the cheapest edits: Viterbi in parallel chunks.

Rows are sorted once by range, so that any conversation may spread over many partitions, and cut
into bounded chunks; what a chunk holds of one conversation is a run.  Backward costs (state ->
cheapest way to the end) are computed run by run from a guess of the costs behind it.  As such
vectors soon differ by a constant only, whatever was behind (rank convergence), few fix-up passes
make every guess right up to a constant; the decisions do not depend on it.  Entry states follow
from each run's map of entry to exit state, and every run traces its own part of the audit.

Model: roles must read ``(s?(ua)+)?`` by their initials.  Keep (K) costs 0, Rerole (R) to user or
assistant 3, Delete (D) 4, Insert (I) of an empty user or assistant turn 3, a truncated row that
stays 3 more; blank and repeated rows must go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.llm.common import release, store

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> the state after a kept row of that initial; the role that Rerole and Insert give.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
GIVES = ("user", "user", "assistant", "user")
NEXT = tuple(AFTER[q][GIVES[q][0]] for q in range(4))
#: Cost to the end after the last row: the inserts that complete a pair.
LAST = (0, 2 * INSERT, INSERT, 0)
LAST_EDITS = (("", START), ("II", ASSISTANT), ("I", ASSISTANT), ("", ASSISTANT))
#: A row's code: initial (s, u, a, other), then whether it is truncated; it must go; it is no row.
INITIALS = "sua"
FORCED, ABSENT = 8, 9
#: Stands for a state that cannot be reached.
FAR = 1 << 40
#: Characters of repaired text that one cell of a spread conversation holds.
PIECE = 1 << 22

Costs = tuple[int, int, int, int]
_steps: dict[tuple[Costs, int], tuple[Costs, int, tuple]] = {}


def step(behind: Costs, code: int) -> tuple[Costs, int, tuple[tuple[str, int], ...]]:
    """Costs before a row from those behind it (least 0), their constant, and per state the edits.

    An edit string holds the inserts before the row and the row's own edit; of equally cheap ones
    it is the least.  Costs behind allow for inserts there.  There are few different arguments, so
    results are remembered.
    """
    if (behind, code) in _steps:
        return _steps[behind, code]
    if code == ABSENT:
        found = [(behind[q], "", q) for q in range(4)]
    else:
        initial = None if code == FORCED else (*INITIALS, "")[code // 2]
        stays = TRUNCATED if code % 2 else 0
        found = []
        for q in range(4):
            # Ways from q: some inserts, then an edit; more than three would repeat a state.
            ways, state, edits, cost = [], q, "", 0
            for _ in range(4):
                ways.append((cost + DELETE + behind[state], edits + "D", state))
                if code != FORCED:
                    if initial in AFTER[state]:
                        to = AFTER[state][initial]
                        ways.append((cost + KEEP + stays + behind[to], edits + "K", to))
                    to = NEXT[state]
                    ways.append((cost + REROLE + stays + behind[to], edits + "R", to))
                state, edits, cost = NEXT[state], edits + "I", cost + INSERT
            found.append(min(ways))
    least = min(c for c, _, _ in found)
    out = (tuple(min(c - least, FAR) for c, _, _ in found), least, tuple((e, s) for _, e, s in found))
    _steps[behind, code] = out
    return out


def backward(codes: bytes, behind: Costs) -> tuple[Costs, int, list]:
    """Costs before a run (least 0), their constant, and the rows' edits in reverse order."""
    total, edits = 0, []
    for code in reversed(codes):
        behind, more, made = step(behind, code)
        total += more
        edits.append(made)
    return behind, total, edits


def trace(edits: list, state: int) -> tuple[list[str], int]:
    """Each row's edits from an entry state on, and the exit state."""
    out = []
    for made in reversed(edits):
        e, state = made[state]
        out.append(e)
    return out, state


# rows and runs ----------------------------------------------------------------

def damage(df: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text with faults by crc32("conv_id:turn") % 20; nulls: one blank.

    0 drops a row (``live`` false), 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it,
    4 sets the role user.
    """
    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        df.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
        .select("*", F.explode(copies).alias("copy"))
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                .otherwise(F.col("text")).alias("text"), (F.col("kind") != 0).alias("live")))


def _ordered(df: DataFrame, rows_per_chunk: int, bytes_per_chunk: int) -> DataFrame:
    """All rows in order, stored, with pos (growing), chunk (pos of its first row) and their faults."""
    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)

    live = F.coalesce("live", F.lit(True)) if "live" in df.columns else F.lit(True)
    order = ["conv_id", "turn", "role", "digest", "live", "place"]
    ends = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    ddl = ("conv_id long, turn long, role string, text string, live boolean, digest binary, "
           "blank boolean, truncated boolean")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, size = TaskContext.get().partitionId() << 33, 0
        at = first = 0
        for batch in batches:
            chunk = np.zeros(len(batch), np.int64)
            lengths = pc.binary_length(batch.column("text")).to_numpy()
            for i, n in enumerate(lengths.tolist()):
                if at > first and (at - first >= rows_per_chunk or size + n > bytes_per_chunk):
                    first, size = at, 0
                chunk[i] = base + first
                size += n
                at += 1
            pos = np.arange(base + at - len(batch), base + at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos), pa.array(chunk)],
                                             names=[*batch.schema.names, "pos", "chunk"])

    return store(
        df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                  shown("role"), shown("text"), live.alias("live"))
        .withColumn("digest", F.unhex(F.sha2("text", 256)))
        .withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
        .withColumn("blank", F.length(ends) == 0)
        .withColumn("truncated", ~F.right(ends, F.lit(1)).isin(".", "!", "?"))
        .mapInArrow(place, ddl + ", pos long, chunk long"), "turns")


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
EDGES = ("first_role", "last_role", "first_turn", "last_turn")
_COUNTED = [*((c, pa.int64()) for c in COUNTS), ("first_role", pa.string()), ("last_role", pa.string()),
            ("first_turn", pa.int64()), ("last_turn", pa.int64())]
_COUNTED_DDL = (", ".join(f"{c} long" for c in COUNTS)
                + ", first_role string, last_role string, first_turn long, last_turn long")
RUN = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("run", pa.int64()),
                 ("codes", pa.binary()), ("moves", pa.bool_()), *_COUNTED])
RUN_DDL = f"conv_id long, chunk long, run long, codes binary, moves boolean, {_COUNTED_DDL}"
LEGAL = {"su", "ua", "au"}


def _join_counts(a: dict, b: dict) -> None:
    """Add a later run's counts to those of an earlier one: sums, and what meets where they touch."""
    if not b["rows"]:
        return
    if a["rows"]:
        a["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    else:
        a["first_role"] = b["first_role"]
    if b["first_turn"] is not None:
        a["turns"] -= a["last_turn"] == b["first_turn"]
        a["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
        a["last_turn"] = b["last_turn"]
    a["last_role"] = b["last_role"]
    for c in COUNTS:
        a[c] += b[c]


def _no_counts() -> dict:
    return dict.fromkeys(COUNTS, 0) | dict.fromkeys(EDGES)


def _runs(rows: DataFrame) -> DataFrame:
    """A row per run, stored: a code per row, its counts, and its edges.

    A repeated row is one whose place is not the least of its conversation, role and digest.  The
    least places are found with partial aggregation, so a hot text costs one row per task, and
    they meet the rows by place, which has no skew.
    """
    firsts = rows.where("live").groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct("pos", "chunk")).alias("first")).select("first.pos", "first.chunk")
    light = rows.select("chunk", "pos", "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"),
                        "live", "blank", "truncated")

    def build(own: pa.Table, first: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        new = np.isin(own.column("pos").to_numpy(), first.column("pos").to_numpy()).tolist()
        cols = [own.column(c).to_pylist()
                for c in ("chunk", "conv_id", "turn", "initial", "live", "blank", "truncated")]
        out: list[dict] = []
        for fresh, chunk, conv, turn, initial, live, blank, cut in zip(new, *cols):
            if not out or out[-1]["conv_id"] != conv:
                out.append({"conv_id": conv, "chunk": chunk, "run": len(out), "codes": bytearray(),
                            "moves": False, **_no_counts()})
            r = out[-1]
            if not live:
                r["codes"].append(ABSENT)
                continue
            fault = "blank" if blank else "duplicate" if not fresh else "truncated" if cut else None
            if fault in ("blank", "duplicate"):
                r["codes"].append(FORCED)
            else:
                kind = INITIALS.find(initial) if initial else -1
                r["codes"].append(2 * (kind if kind >= 0 else 3) + (fault == "truncated"))
                r["moves"] = True
            one = _no_counts() | {"rows": 1, "first_role": initial, "last_role": initial,
                                  "first_turn": turn, "last_turn": turn, "turns": int(turn is not None)}
            if fault:
                one[fault] = 1
            _join_counts(r, one)
        for r in out:
            r["codes"] = bytes(r["codes"])
        return pa.Table.from_pylist(out, RUN)

    return store(light.groupBy("chunk").cogroup(firsts.groupBy("chunk")).applyInArrow(build, RUN_DDL), "runs")


# costs and states across runs -------------------------------------------------

_COSTS = "array<long>"


def _guessed(runs: DataFrame) -> DataFrame:
    """chunk, run, conv_id, behind (costs used), before (costs found) of runs with a given ``behind``."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [backward(c, tuple(b))[0] for c, b in zip(
                batch.column("codes").to_pylist(), batch.column("behind").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("chunk", "run", "conv_id", "behind")),
                 pa.array(found, pa.list_(pa.int64()))], names=["chunk", "run", "conv_id", "behind", "before"])

    return runs.mapInArrow(solve, f"chunk long, run long, conv_id long, behind {_COSTS}, before {_COSTS}")


def _along(df: DataFrame, descending: bool, ddl: str, visit) -> DataFrame:
    """One small row per run, in the order of each conversation: ``visit(state or None, row)``.

    Streams: a task holds a batch of such rows and one state.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, ()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if current != (row["conv_id"],):
                    state, current = None, (row["conv_id"],)
                state, made = visit(state, row)
                out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out)

    order = F.col("chunk").desc() if descending else F.col("chunk").asc()
    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(walk, ddl)


def converge(split: DataFrame, passes: int = 6) -> tuple[DataFrame, int, int]:
    """(chunk, run, behind) of the runs of spread conversations; passes made; runs left to the exit.

    ``behind`` are the costs behind a run up to a constant.  Pass 0 starts every run but the last
    of a conversation from equal costs.  A fix-up pass reruns the runs whose costs behind differ,
    by more than a constant, from what the next run found.  Rows that alternate freely keep two
    phases apart, so a conversation may converge by one run a pass only; what is not settled
    after ``passes`` goes to an exact exit: each run's 4 x 4 matrix of costs from state to state,
    multiplied backwards from the end.  Runs without a row that could stay change nothing and
    are passed over.
    """
    next_run = Window.partitionBy("conv_id").orderBy("chunk")
    moving = store(split.where("moves").select(
        "conv_id", "chunk", "run", "codes", F.lead("chunk").over(next_run).isNull().alias("last")), "moving")
    last = F.array(*map(F.lit, LAST)).cast(_COSTS)
    guess = F.array(*[F.lit(0)] * 4).cast(_COSTS)
    state = store(_guessed(moving.withColumn("behind", F.when(F.col("last"), last).otherwise(guess))), "costs")
    made = left = 0
    while True:
        seen = state.withColumn("found", F.lead("before").over(next_run))
        wrong = store(seen.where("found != behind").select("chunk", "run", "conv_id", F.col("found").alias("new")), "wrong")
        left = wrong.count()
        if not left or made == passes:
            break
        made += 1
        again = _guessed(moving.join(wrong.drop("conv_id"), ["chunk", "run"]).withColumnRenamed("new", "behind"))
        kept = state.join(wrong, ["chunk", "run"], "left_anti")
        before, state = state, store(kept.unionByName(again), "costs")
        release(before, wrong)
    if left:
        marked = moving.join(wrong.select(F.col("conv_id").alias("open")).distinct(),
                             F.col("conv_id").eqNullSafe(F.col("open")), "left_semi")
        exact = store(_multiplied(marked), "exact")
        behind = state.select("chunk", "run", "behind").join(exact, ["chunk", "run"], "left_anti").unionByName(exact)
    else:
        behind = state.select("chunk", "run", "behind")
    out = store(behind, "behind")
    release(state, wrong, moving, *([exact] if left else []))
    return out, made, left


def _multiplied(moving: DataFrame) -> DataFrame:
    """chunk, run, behind from the product of the runs' matrices, last run first."""
    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes in batch.column("codes").to_pylist():
                ways = [backward(codes, tuple(0 if q == j else FAR for q in range(4)))[:2] for j in range(4)]
                low = min(total for _, total in ways)
                out.append([min(costs[q] + total - low, FAR) for q in range(4) for costs, total in ways])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("chunk", "run", "conv_id")), pa.array(out, pa.list_(pa.int64()))],
                names=["chunk", "run", "conv_id", "ways"])

    def visit(behind, row):
        behind = behind or LAST
        before = [min(w + b for w, b in zip(row["ways"][4 * q:4 * q + 4], behind)) for q in range(4)]
        return tuple(b - min(before) for b in before), {
            "chunk": row["chunk"], "run": row["run"], "behind": list(behind)}

    found = moving.mapInArrow(matrices, f"chunk long, run long, conv_id long, ways {_COSTS}")
    return _along(found, True, f"chunk long, run long, behind {_COSTS}", visit)


def _entries(split: DataFrame) -> DataFrame:
    """chunk, run, entry state, from each run's exit states; ``split`` has codes, moves, behind."""
    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, moves, behind in zip(*(batch.column(c).to_pylist() for c in ("codes", "moves", "behind"))):
                edits = backward(codes, tuple(behind))[2] if moves else []
                out.append([trace(edits, q)[1] for q in range(4)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("chunk", "run", "conv_id")), pa.array(out, pa.list_(pa.int64()))],
                names=["chunk", "run", "conv_id", "exits"])

    def visit(state, row):
        state = START if state is None else state
        return row["exits"][state], {"chunk": row["chunk"], "run": row["run"], "entry": state}

    found = split.mapInArrow(exits, f"chunk long, run long, conv_id long, exits {_COSTS}")
    return _along(found, False, "chunk long, run long, entry long", visit)


# repaired turns ---------------------------------------------------------------

def _edited(run: dict, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of a run in order; a deleted row has no role."""
    edits, _ = trace(backward(run["codes"], tuple(run["behind"]))[2], run["entry"])
    state = run["entry"]
    for made, role, text in zip(edits, roles, texts):
        for e in made:
            if e == "D":
                yield e, None, None
            elif e == "K":
                yield e, role, text
                state = AFTER[state][role[0]]
            else:
                yield e, GIVES[state], "" if e == "I" else text
                state = NEXT[state]
    if run["last"]:
        for e in LAST_EDITS[state][0]:
            yield e, GIVES[state], ""
            state = NEXT[state]


def _cost(run: dict, audit: str) -> int:
    """What the edits of a run cost, with its truncated rows that stay."""
    own = audit.replace("I", "")  # one edit per row that is there
    codes = run["codes"].replace(bytes([ABSENT]), b"")
    cut = sum(1 for e, c in zip(own, codes) if e != "D" and c % 2)
    return INSERT * audit.count("I") + REROLE * audit.count("R") + DELETE * audit.count("D") + TRUNCATED * cut


def _by_run(rows: pa.Table, runs: pa.Table) -> Iterator[tuple[dict, list[str], list[str]]]:
    rows = rows.sort_by("pos")
    at = 0
    for run in runs.sort_by("run").to_pylist():
        part = rows.slice(at, len(run["codes"]))
        yield run, part.column("role").to_pylist(), part.column("text").to_pylist()
        at += len(run["codes"])


PIECES = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("nth", pa.int64()), ("spread", pa.bool_()),
                    *_COUNTED, ("cost", pa.int64()), ("audit", pa.string()), ("text", pa.string()),
                    ("sha256", pa.string())])
TURN = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("nth", pa.int64()), ("edit", pa.string()),
                  ("role", pa.string()), ("text", pa.string())])
REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
    ("repaired_sha256", pa.string())])
_REPORT_DDL = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
               "cost long, audit string, repaired_sha256 string")


class Repair:
    """The plan of a repair: ``turns()`` are the repaired turns, ``report()`` a row per conversation.

    ``passes`` fix-up passes were made; ``left`` runs went to the exact exit.
    """

    def __init__(self, rows: DataFrame, runs: DataFrame, passes: int, left: int):
        self.rows, self.runs, self.passes, self.left = rows, runs, passes, left

    def _cogroup(self, make, ddl: str) -> DataFrame:
        rows = self.rows.select("chunk", "pos", "role", "text")
        return rows.groupBy("chunk").cogroup(self.runs.groupBy("chunk")).applyInArrow(make, ddl)

    def turns(self) -> DataFrame:
        """conv_id, chunk, nth, edit, role, text: every edit; order by chunk and nth within conv_id.

        Deleted rows are there with edit D and null role and text; all others make up the
        repaired conversation.
        """
        def make(rows: pa.Table, runs: pa.Table) -> pa.Table:
            out = [{"conv_id": run["conv_id"], "chunk": run["chunk"], "nth": i, "edit": e, "role": r, "text": t}
                   for run, roles, texts in _by_run(rows, runs)
                   for i, (e, r, t) in enumerate(_edited(run, roles, texts))]
            return pa.Table.from_pylist(out, TURN)

        return self._cogroup(make, "conv_id long, chunk long, nth long, edit string, role string, text string")

    def report(self, piece: int = PIECE) -> DataFrame:
        """Per conversation: gaps, fault counts, illegal, cost, audit, repaired_sha256.

        A conversation in one chunk is hashed there.  The pieces of others (about ``piece``
        characters each) are streamed in order to one task each, since a hash is made from first
        to last byte; it holds a batch of pieces.
        """
        def make(rows: pa.Table, runs: pa.Table) -> pa.Table:
            out = []
            for run, roles, texts in _by_run(rows, runs):
                one = {"conv_id": run["conv_id"], "chunk": run["chunk"], "nth": 0, "spread": run["spread"],
                       **{c: run[c] for c in (*COUNTS, *EDGES)}}
                audit, lines, size = [], [], 0
                whole = hashlib.sha256()
                made = 0
                for e, role, text in _edited(run, roles, texts):
                    audit.append(e)
                    if role is None:
                        continue
                    line = f"{role}:{text}"
                    if run["spread"]:
                        if lines and size + len(line) > piece:
                            out.append(dict(one, text="\n".join(lines), cost=0, audit=""))
                            one = {"conv_id": run["conv_id"], "chunk": run["chunk"], "nth": one["nth"] + 1,
                                   "spread": True, **_no_counts()}
                            lines, size = [], 0
                        lines.append(line)
                        size += len(line) + 1
                    else:
                        whole.update((b"\n" if made else b"") + line.encode("utf-8", "surrogatepass"))
                        made += 1
                edits = "".join(audit)
                out.append(dict(one, audit=edits, cost=_cost(run, edits),
                                text="\n".join(lines) if lines else None,
                                sha256=None if run["spread"] else whole.hexdigest()))
            return pa.Table.from_pylist(out, PIECES)

        pieces = store(self._cogroup(
            make, f"conv_id long, chunk long, nth long, spread boolean, {_COUNTED_DDL}, cost long, "
            "audit string, text string, sha256 string"), "pieces")
        gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
        single = pieces.where("not spread").select(
            "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
            F.col("sha256").alias("repaired_sha256"))
        spread = (pieces.where("spread").repartition("conv_id")
                  .sortWithinPartitions("conv_id", "chunk", "nth").mapInArrow(_assemble, _REPORT_DDL))
        return single.unionByName(spread)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces, which come in order."""
    def done() -> pa.RecordBatch:
        span = 0 if counts["first_turn"] is None else counts["last_turn"] - counts["first_turn"] + 1
        return pa.RecordBatch.from_pylist([{
            "conv_id": conv, "gaps": span - counts["turns"], **{c: counts[c] for c in COUNTS[1:5]},
            "cost": cost, "audit": "".join(audit), "repaired_sha256": whole.hexdigest()}], REPORT)

    conv: object = ()
    for batch in batches:
        for row in batch.to_pylist():
            if conv == () or row["conv_id"] != conv:
                if conv != ():
                    yield done()
                conv, counts, cost, audit, whole, made = row["conv_id"], _no_counts(), 0, [], hashlib.sha256(), False
            _join_counts(counts, row)
            cost += row["cost"]
            audit.append(row["audit"])
            if row["text"] is not None:
                whole.update((b"\n" if made else b"") + row["text"].encode("utf-8", "surrogatepass"))
                made = True
    if conv != ():
        yield done()


def repair(df: DataFrame, rows_per_chunk: int = 1 << 16, bytes_per_chunk: int = 1 << 24,
           passes: int = 6) -> Repair:
    """Plan the cheapest edits that make every conversation's roles read ``(s?(ua)+)?``.

    ``df``: conv_id, turn, role, text, and optionally ``live`` (false: a row that is only there
    for its conversation to be reported); other columns are ignored.  Null roles and texts are
    one blank, null turns come first, a null conv_id is a conversation of its own.  Rows of one
    turn are ordered by role, then the SHA-256 of their text; equal rows stand together, so of
    repeated rows one stays.  A row's first fault counts: blank (nothing but blanks), duplicate
    (role and text seen earlier in the conversation), truncated (last character that is no blank
    not in ``.!?``).  Conversations without rows are reported with zeros, an empty audit and the
    hash of nothing; an empty table gives no conversation.

    A chunk has at most ``rows_per_chunk`` rows and ``bytes_per_chunk`` bytes of text (one longer
    text stands alone), however long a conversation is.
    """
    rows = _ordered(df, rows_per_chunk, bytes_per_chunk)
    runs = _runs(rows)
    along = Window.partitionBy("conv_id").orderBy("chunk")
    keys = runs.select("chunk", "run", F.lag("chunk").over(along).alias("earlier"),
                       F.lead("chunk").over(along).alias("later"))
    spread = store(keys.where("earlier is not null or later is not null")
                   .select("chunk", "run", F.col("later").isNull().alias("last")), "spread")
    split = runs.join(spread, ["chunk", "run"])
    behind, made, left = converge(split, passes)
    guess = F.array(*[F.lit(0)] * 4).cast(_COSTS)
    known = store(split.join(behind, ["chunk", "run"], "left")
                  .withColumn("behind", F.coalesce("behind", guess)), "known")
    entries = store(_entries(known), "entries")
    plan = known.join(entries, ["chunk", "run"]).select("chunk", "run", "behind", "entry", "last",
                                                        F.lit(True).alias("spread"))
    planned = store(runs.join(plan, ["chunk", "run"], "left").fillna({"entry": START, "last": True, "spread": False})
                    .withColumn("behind", F.coalesce("behind", F.array(*map(F.lit, LAST)).cast(_COSTS))), "planned")
    release(runs, spread, behind, known, entries)
    return Repair(rows, planned, made, left)
