"""Conversation structure repair: the cheapest edits that give each conversation legal roles, by depth-first branch-and-bound.

Edits of a row: keep (0), rerole to user or assistant (1), delete (2, required for blank rows and repeats); an empty message of user or
assistant can be inserted anywhere (5); a truncated row that isn't deleted adds 5. Roles must then read ``(s?(ua)+)?`` by their initials. Of
the cheapest audits (K, R, D, I in order) the ASCII-least wins. ``search`` keeps an explicit stack, bounds what is left from below by
forced deletions, truncated rows and disjoint pairs of rows that can't stand next to each other, and drops a prefix whose (cost, audit)
isn't better than the best one known at the same row and role, or can't beat the incumbent. When the stack is empty the incumbent is optimal.
The incumbent's cost is proved first, its audit second.

Rows are dealt by ranges of their order, so a conversation lies in one task or in neighbouring ones. One that lies within a task is
repaired there. One that may go on in the next task, or has over ``RUN`` distinct rows or ``BYTES`` of text, is cut into blocks: each is
searched from every role it can begin after to every role it can end with, and the blocks' results are chained. Two audits of one cost
between the same roles never begin with one another, so the least of all is made of the blocks' least, and the result is the same.

Defined cases: null turns come first; null roles and texts are one space; rows of one turn are ordered by role, the text's first
64 characters and its SHA-256. A null conversation id is a conversation. Repeated rows count each. A conversation without rows has zeros.
A role's first character decides; one that isn't s, u or a can't be kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded_batches, materialize

#: Most distinct rows of a conversation searched as one, most of a block searched between all roles, most characters held.
RUN, BLOCK, BYTES = 128, 32, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
#: Roles so far: none, the system's, the last is the user's, the last is the assistant's. A repaired conversation ends with the first or last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
#: What a row is by itself: blank, ending as a sentence does, or truncated.
BLANK, WHOLE, CUT = range(3)

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def after_keep(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == NONE else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def after_turn(state: int) -> int:
    """After a message of the user's or the assistant's, whichever may come next."""
    return ASSISTANT if state == USER else USER


def suffix_bounds(steps: list[tuple[str | None, int, int]]) -> list[int]:
    """Least cost of the steps from each on, whatever came before.

    Rows that must go and truncated rows cost a deletion at least. Two rows that can't stand next to each other, with only such rows between
    them, cost one more, as keeping both needs an insertion or a truncated row kept; pairs counted have no row in common.
    """
    bounds, between, following = [0] * (len(steps) + 1), 0, None
    for i in range(len(steps) - 1, -1, -1):
        initial, extra, count = steps[i]
        if initial is None or extra:
            between += DELETE * count
            bounds[i] = DELETE * count + bounds[i + 1]
            continue
        bounds[i] = bounds[i + 1]
        if following is not None and initial + steps[following][0] not in LEGAL:
            bounds[i] = max(bounds[i], REROLE + between + bounds[following + 1])
        between, following = 0, i
    return bounds


def branches(steps: list[tuple[str | None, int, int]], i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edits, cost, next step, state after) of what can be done before or with step ``i``, in ASCII order."""
    turned = after_turn(state)
    if i == len(steps):
        return [("I", INSERT, i, turned)]
    initial, extra, count = steps[i]
    out = [("D" * count, DELETE * count, i + 1, state), ("I", INSERT, i, turned)]
    if initial is not None:
        kept = after_keep(state, initial)
        out += [("K", extra, i + 1, kept)] * (kept is not None) + [("R", REROLE + extra, i + 1, turned)] * (kept != turned)
    return out


def least_cost(steps: list[tuple[str | None, int, int]], bounds: list[int], entry: int, ends: tuple[int, ...]) -> int | None:
    """Cost of the cheapest edits: the cheapest branch first, so that an incumbent comes early."""
    best, seen, stack = None, {}, [(0, entry, 0)]
    while stack:
        i, state, cost = stack.pop()
        if (best is not None and cost + bounds[i] >= best) or seen.get((i, state), cost + 1) <= cost:
            continue
        seen[i, state] = cost
        if i == len(steps) and state in ends:
            best = cost
            continue
        stack += sorted(((j, after, cost + more) for _, more, j, after in branches(steps, i, state)), key=lambda b: b[2] + bounds[b[0]], reverse=True)
    return best


def search(steps: list[tuple[str | None, int, int]], entry: int = NONE, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from ``entry`` to one of ``ends``, ties to the ASCII-least; None if there are none.

    A step is (initial, cost of not deleting, 1), or (None, 0, n) for n rows in a row that must go. The first descent proves the least
    cost. The second takes branches in ASCII order under that cost as its bound, so the first end it comes to is the ASCII-least; a row and
    role left without success is entered again only at a lower cost.
    """
    bounds = suffix_bounds(steps)
    cost = least_cost(steps, bounds, entry, ends)
    if cost is None:
        return None
    seen, stack, path = {}, [(0, entry, 0, 0, "")], []
    while stack:
        i, state, spent, depth, edits = stack.pop()
        if spent + bounds[i] > cost or seen.get((i, state), spent + 1) <= spent:
            continue
        seen[i, state] = spent
        path[depth:] = [edits]
        if i == len(steps) and state in ends and spent == cost:
            return cost, "".join(path)
        stack += [(j, after, spent + more, depth + 1, letters) for letters, more, j, after in reversed(branches(steps, i, state))]
    raise AssertionError("the proved cost has no audit")


def judge(rows: list[tuple]) -> tuple[list[tuple[str | None, int, int]], dict[str, int], str | None, str | None]:
    """Steps, counts of faults, first and last initial of ordered rows (turn, role, mark, n, whether role and text are new)."""
    steps, counts, first, last = [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), None, None

    def force(n: int) -> None:
        if steps and steps[-1][0] is None:
            steps[-1] = (None, 0, steps[-1][2] + n)
        elif n:
            steps.append((None, 0, n))

    for _, role, mark, n, fresh in rows:
        if not n:
            continue
        initial = role[:1]
        first = initial if last is None else first
        counts["illegal"] += n - 1 + (last is not None and last + initial not in LEGAL)
        last = initial
        if mark == BLANK:
            counts["blank"] += n
            force(n)
        elif not fresh:
            counts["duplicate"] += n
            force(n)
        else:
            counts["duplicate"] += n - 1
            counts["truncated"] += mark == CUT
            steps.append((initial, TRUNCATED if mark == CUT else 0, 1))
            force(n - 1)
    return steps, counts, first, last


def apply_audit(rows: list[tuple], audit: str, entry: int = NONE) -> list[dict]:
    """Messages after the audit's edits of rows (role, text, n)."""
    messages, state, at = [], entry, 0

    def insert() -> None:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state, at = after_turn(state), at + 1
            messages.append({"role": "user" if state == USER else "assistant", "text": ""})

    for role, text, n in rows:
        for _ in range(n):
            insert()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = after_keep(state, role[:1])
            elif edit == "R":
                state = after_turn(state)
                role = "user" if state == USER else "assistant"  # noqa: PLW2901
            if edit != "D":
                messages.append({"role": role, "text": text})
    insert()
    return messages


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``n``: distinct rows after damage by crc32(conv_id:turn) % 20 and their number.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets role user. A dropped row leaves one with n 0.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    gone = kind == 0
    return conversations.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(kind == 4, "user").otherwise(told("role")).alias("role"), F.when(gone, "").otherwise(text).alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def counted(messages: DataFrame) -> DataFrame:
    """Distinct messages with their number ``n``; a table without ``n`` counts each row once."""
    rows = messages if "n" in messages.columns else messages.withColumn("n", F.lit(1).cast("long"))
    filled = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], "n")
    return filled.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _turns(rows: list[tuple]) -> list[int]:
    return [r[0] for r in rows if r[0] is not None and r[3]]


def _mark(text: str) -> int:
    bare = text.rstrip(SPACE)
    return BLANK if not bare else WHOLE if bare[-1] in ".!?" else CUT


def _local(types: dict[str, str]):
    """Repairs conversations that lie within a task; hands on the rows of others, each with its place and block."""
    schema = (
        f"conv_id {types['conv_id']}, part long, parts int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, messages array<struct<role:string,text:string>>, "
        "place long, turn long, role string, text string, mark int, n long"
    )
    names = ["conv_id", "part", "parts", *_COUNTS, "audit", "messages", "place", "turn", "role", "text", "mark", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, block, kind = TaskContext.get().partitionId(), 0, 0, None
        out, held = [], 0

        def packed() -> pa.RecordBatch:
            nonlocal out, held
            columns = [[r.get(name) for r in out] for name in names]
            types = [kind, pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string(), _MESSAGES, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def hand_on(key, rows: list[tuple]) -> None:
            """Rows of a conversation go out in blocks."""
            nonlocal place, block
            for k, (turn, role, text, n) in enumerate(rows):
                mark, block = _mark(text), block + (k % BLOCK == 0)
                out.append({"conv_id": key, "part": task << 32 | block, "place": task << 40 | place, "turn": turn, "role": role, "text": "" if mark == BLANK else text, "mark": mark, "n": n})
                place += 1

        def close(key, rows: list[tuple]) -> None:
            seen, judged = set(), []
            for turn, role, text, n in rows:
                mark = _mark(text)
                judged.append((turn, role, mark, n, (role, text) not in seen))
                if n and mark != BLANK:
                    seen.add((role, text))
            steps, counts, _, _ = judge(judged)
            cost, audit = search(steps)
            turns = _turns(rows)
            gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
            messages = apply_audit([r[1:] for r in rows], audit)
            out.append({"conv_id": key, "part": 0, "parts": 1, "gaps": gaps, **counts, "cost": cost, "audit": audit, "messages": messages})

        rows, size, now, begun, first = [], 0, None, False, True  # begun: the conversation's earlier rows have gone out, or may lie in the task before
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n")), strict=True):
                if first or key != now:
                    if not first:
                        (hand_on if begun else close)(now, rows)
                    rows, size, now, begun, first = [], 0, key, first, False
                elif len(rows) == RUN or size > BYTES:
                    hand_on(now, rows)
                    rows, size, begun = [], 0, True
                rows.append(tuple(row))
                size += len(row[2])
                held += len(row[2]) + 100
                if held > BYTES:
                    if out:
                        yield packed()
                    held = 0
        if not first:
            hand_on(now, rows)
            yield packed()

    return run, schema


def _solve(table: pa.Table) -> pa.Table:
    """One block's results from every role it can begin after to every role it can end with."""
    table = table.sort_by("place")
    rows = list(zip(*(table.column(c).to_pylist() for c in ("turn", "role", "mark", "n", "fresh")), strict=True))
    steps, counts, first, last = judge(rows)
    turns = _turns(rows)
    found = [(entry, end, *best) for entry in range(4) for end in range(4) if (best := search(steps, entry, (end,)))]
    record = {
        "conv_id": table.column("conv_id")[0].as_py(), "part": table.column("part")[0].as_py(), **counts, "first": first, "last": last, "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
        "found": [dict(zip(("entry", "end", "cost", "audit"), f, strict=True)) for f in found],
    }
    types = [
        table.schema.field("conv_id").type, *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3,
        pa.list_(pa.struct([("entry", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
    ]
    return pa.table({k: pa.array([v], t) for (k, v), t in zip(record.items(), types, strict=True)})


def chain(blocks: list[dict]) -> list[dict]:
    """One conversation's blocks in order, joined by the cheapest, ASCII-least path: entry and audit of each, and the conversation's counts."""
    best = {NONE: (0, "", None)}
    for block in blocks:
        after = {}
        for f in block["found"]:
            if f["entry"] in best:
                cost, audit, trail = best[f["entry"]]
                now = (cost + f["cost"], audit + f["audit"], (trail, f["entry"], f["audit"]))
                if f["end"] not in after or now[:2] < after[f["end"]][:2]:
                    after[f["end"]] = now
        best = after
    cost, _, trail = min((best[end] for end in ENDS if end in best), key=lambda b: b[:2])
    chosen = []
    while trail is not None:
        trail, entry, audit = trail
        chosen.append((entry, audit))
    some = [b for b in blocks if b["first"] is not None]
    seams = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(some, some[1:], strict=False))
    dated = [b for b in blocks if b["low"] is not None]
    distinct = sum(b["turns"] for b in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
    gaps = max(b["high"] for b in dated) - min(b["low"] for b in dated) + 1 - distinct if dated else 0
    sums = {k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated", "illegal")}
    sums["illegal"] += seams
    return [{"conv_id": b["conv_id"], "part": b["part"], "parts": len(blocks), "gaps": gaps, **sums, "cost": cost, "audit": audit, "entry": entry} for b, (entry, audit) in zip(blocks, reversed(chosen), strict=True)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[dict]]]:
    """Rows of one conversation after the other, of batches sorted by it, and the type of its id."""
    run, kind = [], None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if run and row["conv_id"] != run[0]["conv_id"]:
                yield kind, run
                run = []
            run.append(row)
    if run:
        yield kind, run


def repair(messages: DataFrame) -> DataFrame:
    """Repaired conversations in parts: ``conv_id``, ``part`` (their order), ``parts`` (their number), the conversation's ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal`` and ``cost``, the part's ``audit`` and ``messages`` (role, text). Short conversations have one part.

    ``messages``: conv_id, turn, role, text, and ``n`` if rows stand for several.
    """
    rows = counted(messages).withColumn("_start", F.substring("text", 1, 64)).withColumn("_digest", F.sha2("text", 256)).withColumn("turn", F.col("turn").cast("long"))
    order = ("conv_id", "turn", "role", "_start", "_digest")
    run, schema = _local(dict(messages.dtypes))
    with bounded_batches(messages.sparkSession):
        ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "n")
        local = materialize(ranged.mapInArrow(run, schema), "local")
    key = schema.split(",")[0]
    parts = ["conv_id", "part", "parts", *_COUNTS, "audit", "messages"]
    within = local.where("parts = 1").select(parts)

    across = local.where("parts is null").select("conv_id", "part", "place", "turn", "role", "text", "mark", "n")
    firsts = across.where(f"mark <> {BLANK} and n > 0").groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("fresh"))
    marked = materialize(across.join(firsts, "place", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))), "marked")
    found = "array<struct<entry:int,end:int,cost:long,audit:string>>"
    solved = marked.drop("text").groupBy("part").applyInArrow(_solve, f"{key}, part long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, found {found}")
    told = f"{key}, part long, parts int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, entry int"

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, blocks in _runs(batches):
            yield pa.RecordBatch.from_pylist(chain(blocks), pa.schema([("conv_id", kind), ("part", pa.int64()), ("parts", pa.int32()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("entry", pa.int32())]))

    plans = materialize(solved.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(chained, told), "plans")

    def edited(rows: pa.Table, plan: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        done = apply_audit(list(zip(*(rows.column(c).to_pylist() for c in ("role", "text", "n")), strict=True)), plan.column("audit")[0].as_py(), plan.column("entry")[0].as_py())
        return plan.drop_columns("entry").append_column("messages", pa.array([done], _MESSAGES))

    pieces = marked.select("part", "place", "role", "text", "n").groupBy("part").cogroup(plans.groupBy("part")).applyInArrow(edited, told.removesuffix(", entry int") + ", messages array<struct<role:string,text:string>>")
    return within.unionByName(pieces.select(parts))


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation: its counts, its whole ``audit`` and ``repaired_sha256`` of its messages as role:text, newline-joined.

    A hash takes a text in order, so the parts of a long conversation are streamed through one task, a part at a time.
    """
    columns = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    single = repaired.where("parts = 1").withColumn("repaired_sha256", F.sha2(text, 256)).select(columns)
    key = dict(repaired.dtypes)["conv_id"]

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, left, begun = None, [], 0, False
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for row in batch.to_pylist():
                if not left:
                    digest, audit, left, begun = hashlib.sha256(), [], row["parts"], False
                if row["n"]:
                    digest.update(("\n" * begun + row["text"]).encode())
                    begun = True
                audit.append(row["audit"])
                left -= 1
                if not left:
                    yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in ("conv_id", *_COUNTS)}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

    long = repaired.where("parts > 1").select("conv_id", "part", "parts", *_COUNTS, "audit", text.alias("text"), F.size("messages").alias("n"))
    told = f"conv_id {key}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return single.unionByName(long.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(streamed, told))
