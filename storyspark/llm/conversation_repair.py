"""Repair of the turn structure of conversations by a survivor-coalescence Viterbi search (operator 12).

A conversation is right if its role initials read ``(s?(ua)+)?``. The search goes through its rows in order and keeps, for each state of
that pattern, the cheapest edits that lead there. Edits hang in a tree of back pointers that counts its references: a branch that no
state holds any more is freed, and once the survivors of all states share an ancestor, the edits up to it are emitted and
forgotten. Of equally cheap paths the one stays whose edits, written down, are least. What is unresolved in two paths is compared
as a whole: paths have as many steps as rows were read and no step is the beginning of another, so two paths compare as the ones that they grew
from, or by their last step; survivors carry that order with them.

Rows are dealt to tasks by ranges of conversation and turn, so that a conversation of any size is cut at the borders of ranges. A piece that may
go on beyond its task is searched from every state that it can start in, and the few pieces of such a conversation are put together by the
same rule, by their costs and their order alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import partitions
from storyspark.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What an output so far can end with: nothing, a first system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Where a row of the role that is due leads.
_DUE = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_LEGAL = ("su", "ua", "au")
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
FINE, CUT, GONE = range(3)


def _steps(initial: str, kind: int) -> list[list[tuple[int, int, str]]]:
    """For each state the ``(next state, cost, edits)`` that a row allows, inserted rows before it included.

    Two insertions before one row, and an insertion before a deleted row rather than behind it, never give the least of the cheapest.
    """
    out = []
    for state in range(4):
        found = [(state, DELETE, "D")]
        if kind != GONE:
            for at, cost, edits in ((state, 0, ""), (_DUE[state], INSERT, "I")):
                cost += TRUNCATED if kind == CUT else 0
                kept = _KEPT.get(initial, {}).get(at)
                if kept is not None:
                    found.append((kept, cost + KEEP, edits + "K"))
                found.append((_DUE[at], cost + REROLE, edits + "R"))
        out.append(found)
    return out


STEPS = {(initial, kind): _steps(initial, kind) for initial in ("s", "u", "a", "") for kind in (FINE, CUT, GONE)}


class _Node:
    """One step of a path: ``refs`` counts the steps after it and the state that it is the last step of."""

    __slots__ = ("edits", "parent", "refs")

    def __init__(self, parent: _Node | None, edits: str) -> None:
        self.parent, self.edits, self.refs = parent, edits, 0


class Search:
    """The cheapest edits from one start state to every state, row by row; ``emitted`` are the edits that are settled."""

    def __init__(self, start: int = NOTHING) -> None:
        self.root = _Node(None, "")
        self.root.refs = 1
        self.survivors = {start: (0, 0, self.root)}  # state: cost, order among the survivors, last step
        self.emitted: list[str] = []

    def push(self, steps: list[list[tuple[int, int, str]]]) -> None:
        best: dict[int, tuple[int, int, str, _Node]] = {}
        for state, (cost, order, node) in self.survivors.items():
            for target, more, edits in steps[state]:
                found = (cost + more, order, edits, node)
                if target not in best or found[:3] < best[target][:3]:
                    best[target] = found
        best = _undominated(best)
        old = [node for _, _, node in self.survivors.values()]
        grown = {}
        for order, state in enumerate(sorted(best, key=lambda s: best[s][1:3])):
            cost, _, edits, parent = best[state]
            parent.refs += 1
            node = _Node(parent, edits)
            node.refs = 1
            grown[state] = (cost, order, node)
        self.survivors = grown
        for node in old:
            _release(node)
        if self.root.refs == 1:
            self._emit()

    def _emit(self) -> None:
        """Settle the steps that all survivors share."""
        path, node = [], next(iter(self.survivors.values()))[2]
        while node is not self.root:
            path.append(node)
            node = node.parent
        tips = {id(n) for _, _, n in self.survivors.values()}
        while path and self.root.refs == 1 and id(self.root) not in tips:
            self.root = path.pop()
            self.root.parent = None
            self.emitted.append(self.root.edits)

    def unresolved(self) -> int:
        """Steps in the longest path that isn't settled."""
        return max(len(self._suffix(n)) for _, _, n in self.survivors.values())

    def _suffix(self, node: _Node) -> list[str]:
        out = []
        while node is not self.root:
            out.append(node.edits)
            node = node.parent
        return out[::-1]

    def paths(self) -> dict[int, tuple[int, str]]:
        """``state: (cost, edits)`` of all survivors."""
        settled = "".join(self.emitted)
        return {state: (cost, settled + "".join(self._suffix(node))) for state, (cost, _, node) in self.survivors.items()}


def _release(node: _Node) -> None:
    node.refs -= 1
    while not node.refs and node.parent is not None:
        node = node.parent
        node.refs -= 1


def _undominated(best: dict[int, tuple]) -> dict[int, tuple]:
    """Without states that cost more than another one and the edits that make up for the difference, whatever follows."""
    cost = {state: found[0] for state, found in best.items()}
    user, assistant = cost.get(USER, 1 << 60), cost.get(ASSISTANT, 1 << 60)
    worth = {
        NOTHING: min(assistant + DELETE, user + INSERT + DELETE),  # a system row that comes later is deleted
        SYSTEM: min(assistant, user + INSERT),
        USER: assistant + INSERT,
        ASSISTANT: user + INSERT,
    }
    return {state: found for state, found in best.items() if found[0] <= worth[state]}


def ended(paths: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """Cost and edits of the best path that ends a conversation: after an assistant row or without any row."""
    ends = []
    for state, (cost, edits) in paths.items():
        missing = {NOTHING: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
        ends.append((cost + INSERT * missing, edits + "I" * missing))
    return min(ends)


def _texts(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest``; null roles and texts are one space."""
    space = F.lit(" ")
    known = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return known.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, initial, copies, fault``: rows that are alike in all are one, with their number.

    ``fault`` is ``blank``, ``duplicate``, ``truncated`` or null, and is that of the first copy; the others are duplicates unless it is blank.
    """
    text = F.rtrim(F.col("text"), F.lit(_WHITE))
    own = F.when(F.btrim(F.col("text"), F.lit(_WHITE)) == "", "blank").when(~F.substring(text, -1, 1).isin(".", "!", "?"), "truncated")
    alike = _texts(rows).withColumn("own", own).groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.first("own").alias("own"))
    alike = stage(alike, "conversation-rows")
    first = alike.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    again = first.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), F.col("first.turn").alias("_first"), F.lit(True).alias("_again"))
    joined = alike.join(again, alike["conv_id"].eqNullSafe(again["_conv"]) & (alike["digest"] == again["_digest"]), "left")
    duplicate = F.col("_again") & ~F.col("turn").eqNullSafe(F.col("_first"))
    fault = F.when(F.col("own") == "blank", "blank").when(duplicate, "duplicate").otherwise(F.col("own"))
    return joined.select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "copies", fault.alias("fault"))


class _Piece:
    """Consecutive rows of one conversation within one task."""

    def __init__(self, conv_id: object, starts: tuple[int, ...]) -> None:
        self.conv_id, self.searches = conv_id, {s: Search(s) for s in starts}
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # initials
        self.first_turn = self.last_turn = None

    def push(self, turn: int | None, initial: str, fault: str | None) -> None:
        kind = GONE if fault in ("blank", "duplicate") else CUT if fault else FINE
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.rows and self.last + initial not in _LEGAL:
            self.illegal += 1
        self.first = initial if not self.rows else self.first
        self.last, self.rows = initial, self.rows + 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        steps = STEPS[initial if initial in _KEPT else "", kind]
        for search in self.searches.values():
            search.push(steps)

    def row(self, part: int, is_open: bool) -> dict:
        found = {(s, t): path for s, search in self.searches.items() for t, path in search.paths().items()}
        order = {edits: k for k, edits in enumerate(sorted({edits for _, edits in found.values()}))}
        ways = [{"start": s, "end": t, "cost": cost, "place": order[edits], "edits": edits} for (s, t), (cost, edits) in found.items()]
        cost, audit = (None, None) if is_open else ended({t: path for (s, t), path in found.items() if s == NOTHING})
        counts = {k: getattr(self, k) for k in ("conv_id", *_COUNTS, "first", "last", "first_turn", "last_turn")}
        return counts | {"part": part, "open": is_open, "cost": cost, "audit": audit, "ways": ways if is_open else []}


_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


def search_pieces(found: DataFrame, n: int) -> DataFrame:
    """One row per conversation and task, with the answer or, for the first and last conversation of a task, the ways through the piece."""
    kind = dict(found.dtypes)["conv_id"]
    order = ["conv_id", "turn", "role", "digest"]
    schema = (
        f"conv_id {kind}, part int, open boolean, {', '.join(f'{c} bigint' for c in _COUNTS)}, first string, last string, first_turn bigint, last_turn bigint, "
        "cost bigint, audit string, ways array<struct<start:int,end:int,cost:bigint,place:int,edits:string>>"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, is_first, done = TaskContext.get().partitionId(), None, True, []
        arrow = None

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, arrow)

        for batch in batches:
            arrow = arrow or _arrow_schema(batch.schema.field("conv_id").type)
            for conv_id, turn, initial, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "copies", "fault")), strict=True):
                if piece is None or conv_id != piece.conv_id:
                    if piece is not None:
                        done.append(piece.row(part, is_first))
                        is_first = False
                    piece = _Piece(conv_id, tuple(range(4)) if is_first else (NOTHING,)) if piece is None else _Piece(conv_id, (NOTHING,))
                for k in range(copies):
                    piece.push(turn, initial, fault if not k or fault == "blank" else "duplicate")
                if len(done) >= 500:
                    yield packed(done)
                    done = []
        if piece is not None:
            yield packed([*done, piece.row(part, True)])

    columns = [*order, "initial", "copies", "fault"]
    return found.select(*columns).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(search, schema)


def _arrow_schema(conv_id: pa.DataType) -> pa.Schema:
    way = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()), ("edits", pa.string())])
    counts = [(c, pa.int64()) for c in _COUNTS]
    ends = [("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
    return pa.schema([("conv_id", conv_id), ("part", pa.int32()), ("open", pa.bool_()), *counts, *ends, ("cost", pa.int64()), ("audit", pa.string()), ("ways", pa.list_(way))])


def chain_pieces(pieces: list[dict]) -> tuple[dict, list[tuple[int, int]], str]:
    """Sums of the pieces of one conversation in order, the way taken through each, and the edits after the last."""
    total = {c: 0 for c in (*_COUNTS, "cost")}
    last = last_turn = first_turn = None
    survivors = {NOTHING: (0, 0)}  # state: cost, order
    back: list[dict[int, int]] = []
    for piece in pieces:
        for c in _COUNTS:
            total[c] += piece[c]
        if last is not None and last + piece["first"] not in _LEGAL:
            total["illegal"] += 1
        last = piece["last"]
        if piece["first_turn"] is not None:
            total["turns"] -= piece["first_turn"] == last_turn
            first_turn = piece["first_turn"] if first_turn is None else first_turn
            last_turn = piece["last_turn"]
        best: dict[int, tuple] = {}
        for way in piece["ways"]:
            if way["start"] in survivors:
                cost, order = survivors[way["start"]]
                found = (cost + way["cost"], order, way["place"], way["start"])
                if way["end"] not in best or found < best[way["end"]]:
                    best[way["end"]] = found
        back.append({state: found[3] for state, found in best.items()})
        ranked = sorted(best, key=lambda s: best[s][1:3])
        survivors = {state: (best[state][0], k) for k, state in enumerate(ranked)}
    missing = {NOTHING: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
    cost, _, state = min((c + INSERT * missing[s], order, s) for s, (c, order) in survivors.items())
    total |= {"cost": cost, "first_turn": first_turn, "last_turn": last_turn}
    after, ways = "I" * missing[state], []
    for step in reversed(back):
        ways.append((step[state], state))
        state = step[state]
    return total, ways[::-1], after


def repair(rows: DataFrame, n: int | None = None) -> DataFrame:
    """``conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation of ``rows (conv_id, turn, role, text)``.

    Rows of a conversation follow each other by turn, null first, rows of one turn by role and a hash of role and text. Null roles and texts
    are one space; rows without ``conv_id`` are a conversation. A row's first fault counts: ``blank``, no character but ASCII white space;
    ``duplicate``, role and text of an earlier row; ``truncated``, the last character that isn't white space is none of ``.!?``. ``illegal``
    counts neighbours whose role initials are not su, ua or au, ``gaps`` the turns missing between the first and the last.

    ``audit`` has one letter per edit: K keep, R change the role to user or assistant (2), D delete (3; blank and duplicate rows must go), I insert an empty
    user or assistant row (2). A truncated row that stays adds 1. The cheapest edits win, of several the least as text. Other columns are not used;
    an empty table gives no rows. ``n`` is the number of ranges.
    """
    pieces = stage(search_pieces(faults(rows), n or partitions(rows.sparkSession)), "conversation-pieces")
    closed = pieces.filter("not open")
    several = pieces.filter("open")
    kind = dict(pieces.dtypes)["conv_id"]
    sums = ", ".join(f"{c} bigint" for c in (*_COUNTS, "cost", "first_turn", "last_turn"))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        parts = group.astype(object).where(group.notna(), None).sort_values("part").to_dict("records")
        total, ways, after = chain_pieces(parts)
        taken = [{"part": int(p["part"]), "start": s, "end": t} for p, (s, t) in zip(parts, ways, strict=True)]
        return pd.DataFrame({"conv_id": group["conv_id"].iloc[:1].to_numpy(), **{k: pd.array([v], "Int64") for k, v in total.items()}, "taken": [taken], "after": [after]})

    # At most two open pieces per range, each with no more than sixteen ways; the edits themselves stay where they are.
    slim = several.withColumn("ways", F.transform("ways", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["cost"].alias("cost"), w["place"].alias("place"))))
    chained = slim.groupBy("conv_id").applyInPandas(chain, f"conv_id {kind}, {sums}, taken array<struct<part:int,start:int,end:int>>, after string")
    chained = stage(chained, "conversation-chains")
    taken = chained.select(F.col("conv_id").alias("_conv"), F.inline("taken").alias("_part", "_start", "_end"))
    ways = several.select("conv_id", "part", F.inline("ways"))
    edits = ways.join(taken, ways["conv_id"].eqNullSafe(taken["_conv"]) & (F.col("part") == F.col("_part")) & (F.col("start") == F.col("_start")) & (F.col("end") == F.col("_end")))
    audits = edits.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "edits"))), lambda e: e["edits"]), "").alias("_edits"))
    audits = audits.withColumnRenamed("conv_id", "_conv")
    finished = chained.join(audits, chained["conv_id"].eqNullSafe(audits["_conv"])).withColumn("audit", F.concat("_edits", "after"))
    columns = ["conv_id", *_COUNTS, "cost", "first_turn", "last_turn", "audit"]
    every = closed.select(*columns).unionByName(finished.select(*columns))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    return every.select("conv_id", F.col("rows").alias("n_rows"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def apply_audits(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text``: the rows of the repaired conversations in order, kept, with another role, or inserted and empty.

    A conversation streams through one task in its order, behind its edits; no more than a batch of its rows is held. Within a partition
    the result is in order of conversation and position.
    """
    kind = dict(rows.dtypes)["conv_id"]
    none = F.lit(None)
    texts = _texts(rows).select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "digest", "text")
    heads = repairs.select("conv_id", F.lit(0).alias("_kind"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("digest"), F.col("audit").alias("text"))
    order = ["conv_id", "_kind", "turn", "role", "digest"]
    together = heads.unionByName(texts).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, out = None, []
        for batch in batches:
            names = list(_ROW)
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *((c, _ROW[c]) for c in names)])
            for conv_id, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_kind", "role", "text")), strict=True):
                if head == 0:
                    editor = _Editor(conv_id, text)
                    out += editor.inserted()
                elif editor is not None and editor.conv_id == conv_id:
                    out += editor.row(role, text)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []

    return together.mapInArrow(apply, f"conv_id {kind}, position bigint, edit string, role string, text string")


_ROW = {"position": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}


class _Editor:
    """Applies the edits of one conversation to its rows in order."""

    def __init__(self, conv_id: object, audit: str) -> None:
        self.conv_id, self.audit, self.at, self.state, self.position = conv_id, audit, 0, NOTHING, 0

    def _made(self, edit: str, role: str | None, text: str) -> dict:
        if edit == "K":
            self.state = _KEPT[role[:1]][self.state]
        else:
            self.state = _DUE[self.state]
            role = "user" if self.state == USER else "assistant"
        made = {"conv_id": self.conv_id, "position": self.position, "edit": edit, "role": role, "text": text}
        self.position += 1
        return made

    def inserted(self) -> list[dict]:
        """Rows to insert before the next row, or at the end."""
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            out.append(self._made("I", None, ""))
        return out

    def row(self, role: str, text: str) -> list[dict]:
        edit, self.at = self.audit[self.at], self.at + 1
        return ([] if edit == "D" else [self._made(edit, role, text)]) + self.inserted()


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of rows as :func:`apply_audits` gives them: ``role:text`` joined by line feeds, hashed as they stream by."""
    kind = dict(repaired.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running, out, arrow = None, None, [], None
        for batch in batches:
            arrow = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
            for conv_id, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if running is not None:
                        out.append({"conv_id": current, "repaired_sha256": running.hexdigest()})
                    current, running = conv_id, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if running is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": running.hexdigest()}], arrow)

    return repaired.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` damaged by the remainder of crc32(``conv_id:turn``) by 20.

    0 drops a row, 1 empties its text, 2 removes its full stops and exclamation and question marks, 3 repeats it, 4 makes its role user. A null is one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    known = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_damage"))
    text = F.when(F.col("_damage") == 1, "").when(F.col("_damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_damage") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    damaged: list[Column] = [F.col("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")]
    return known.filter("_damage > 0").select(*damaged).drop("_copy")
