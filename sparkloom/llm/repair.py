"""Conversation repair: the cheapest edits that turn a conversation into ``(system)? (user assistant)+``, or into nothing.

Edits of the messages in order: keep (0), give the other role (3), delete (4; a must for blank and repeated messages), insert an empty user or assistant message (3).
A truncated message that stays costs 3 more. They're found by A* on the lattice of (messages consumed, last role): what is left costs at least 4 for each message
that must go and 3 for each truncated one, which stays at 3 or goes at 4, so suffix sums of these are an admissible and consistent heuristic. The queue is ordered by (cost
plus heuristic, audit), the audit being the edits' initials so far: the first goal that leaves it is the cheapest, and of those the one whose audit is least.

A conversation of up to ``ROWS`` messages and ``CHARS`` characters is one group of a task. A longer one is numbered across tasks and cut into segments; a task
searches each from every role it may begin after to every role it may end with, the segments' answers are put together in order (a cost and an audit for each of
four roles, whose common beginning is fixed as soon as there is one), and the repaired messages pass through the hash as a sorted stream.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored
from sparkloom.operators import ordered

ROWS, CHARS, SEGMENT = 2_000, 8_000_000, 500
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What ``state`` says of a message: fine, blank, without a full stop.
FINE, BLANK, CUT = 0, 1, 2
#: Last role so far: none, system, user, assistant; by initials where each leads, and the role that a given or inserted message takes there.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_ONWARD = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_GIVEN = (USER, USER, ASSISTANT, USER)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
GOALS = (NONE, ASSISTANT)
_SPACES = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
REPORT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def search(initials: Sequence[str], gone: Sequence[bool], cut: Sequence[bool], entry: int = NONE, goals: Sequence[int] | None = GOALS) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest edits from role ``entry`` to the first of ``goals``, or, without goals, to every role that can be reached."""
    n, least, done, found = len(initials), [0], set(), {}
    for must, short in zip(reversed(gone), reversed(cut), strict=True):
        least.append(least[-1] + (DELETE if must else TRUNCATED if short else 0))
    least.reverse()
    queue = [(least[0], "", 0, entry)]
    while queue:
        total, audit, i, last = heapq.heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == n and (goals is None or last in goals):
            found[last] = (total, audit)
            if goals is not None:
                return found
        given = _GIVEN[last]
        heapq.heappush(queue, (total + INSERT, audit + "I", i, given))
        if i < n:
            ahead = total - least[i] + least[i + 1]
            heapq.heappush(queue, (ahead + DELETE, audit + "D", i + 1, last))
            if not gone[i]:
                ahead += TRUNCATED if cut[i] else 0
                to = _ONWARD[last].get(initials[i])
                if to is not None:
                    heapq.heappush(queue, (ahead + KEEP, audit + "K", i + 1, to))
                if to != given:
                    heapq.heappush(queue, (ahead + REROLE, audit + "R", i + 1, given))
    return found


def applied(audit: str, initials: Iterable[str], entry: int = NONE) -> Iterator[tuple[str, str | None]]:
    """(edit, role given) for each edit of ``audit``; the role is None where the message keeps its own or goes."""
    last, own = entry, iter(initials)
    for edit in audit:
        initial = "" if edit == "I" else next(own)
        if edit == "K":
            last = _ONWARD[last][initial]
        elif edit != "D":
            last = _GIVEN[last]
        yield edit, _ROLES[last] if edit in "IR" else None


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def messages(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False) -> DataFrame:
    """(conv, turn, role, text, initial, state, present) of all messages; a null role or text is one space. ``conv`` is the id as text behind ``=``, or empty for null.

    With ``damage``, crc32(``id:turn``) % 20 decides (nulls: one space): 0 drops the message (then a row that isn't present stands for it), 1 empties its text, 2 removes
    its full stops, question and exclamation marks, 3 repeats it, 4 makes it the user's.
    """
    own = conversations.select(F.col(id_col).cast("string").alias("id"), F.col(turn_col).cast("long").alias("turn"), _text(role_col).alias("role"), _text(text_col).alias("text"))
    own = own.withColumn("conv", F.when(F.col("id").isNull(), "").otherwise(F.concat(F.lit("="), "id")))
    if damage:
        how = F.crc32(F.concat(_text("id"), F.lit(":"), _text("turn")).cast("binary")) % 20
        own = own.withColumn("how", how).withColumns({
            "text": F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("how") == 4, "user").otherwise(F.col("role")),
            "present": F.explode(F.expr("CASE how WHEN 0 THEN array(false) WHEN 3 THEN array(true, true) ELSE array(true) END")),
        })
    else:
        own = own.withColumn("present", F.lit(True))
    end = F.substring(F.rtrim("text", F.lit(_SPACES)), -1, 1)
    state = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), FINE).otherwise(CUT)
    return own.select("conv", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), state.cast("int").alias("state"), "present")


def _conversation(rows: list[tuple]) -> tuple:
    """The report on one conversation's rows (turn, role, text, initial, state, present) in order."""
    rows = [r for r in rows if r[5]]
    seen, initials, gone, cut, repeated = set(), [], [], [], 0
    for _, role, text, initial, state, _ in rows:
        again = (role, text) in seen
        seen.add((role, text))
        repeated += again and state != BLANK
        initials.append(initial)
        gone.append(again or state == BLANK)
        cut.append(state == CUT and not again)
    (cost, audit), turns = next(iter(search(initials, gone, cut).values())), {r[0] for r in rows if r[0] is not None}
    out, own = [], iter(rows)
    for edit, role in applied(audit, initials):
        row = (None, role, "") if edit == "I" else next(own)
        if edit != "D":
            out.append(f"{role or row[1]}:{row[2]}")
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        sum(r[4] == BLANK for r in rows),
        repeated,
        sum(cut),
        sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """The rows of each conversation of sorted batches, whose first column is ``conv``."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for conv, own in groupby(rows, itemgetter(0)):
        yield conv, [row[1:] for row in own]


def _short(rows: DataFrame) -> DataFrame:
    """The report on conversations that are one group each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out: list[tuple] = []
        for conv, own in _grouped(batches):
            out.append((conv, *_conversation(own)))
            if len(out) == 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = rows.select("conv", "turn", "role", "text", "initial", "state", "present").repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(run, REPORT.replace("conv_id", "conv"))


_SEARCHED = "conv string, seg long, entry int, exit int, cost long, audit string"


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (conv, seg, codes), codes being sorted structs of (pos, initial, gone, cut): the answers from each role to each."""
    for batch in batches:
        rows = []
        for conv, seg, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = [[c[k] for c in codes] for k in ("initial", "gone", "cut")]
            for entry in range(4) if seg else (NONE,):
                rows += [(conv, seg, entry, to, cost, audit) for to, (cost, audit) in search(*own, entry=entry, goals=None).items()]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["conv", "seg", "entry", "exit", "cost", "audit"])


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of segments, sorted by (conv, seg): pieces of the best whole audit, numbered, and the cost with the last one."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    out: list[tuple] = []

    def sent() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["conv", "piece", "audit", "cost"])
        out.clear()
        return made

    conv, seg, best, now, piece = None, None, {}, {}, 0

    def ended(whole: bool) -> None:
        """Takes the segment's answers over; what all roles' audits begin with is fixed."""
        nonlocal best, piece
        best = now
        if whole:
            cost, rest = min(best[s] for s in GOALS if s in best)
            out.append((conv, piece, rest, cost))
        else:
            common = os.path.commonprefix([audit for _, audit in best.values()])
            if common:
                out.append((conv, piece, common, None))
                best, piece = {s: (cost, audit[len(common) :]) for s, (cost, audit) in best.items()}, piece + 1

    for batch in batches:
        for own, k, entry, to, cost, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (own, k) != (conv, seg):
                if conv is not None:
                    ended(own != conv)
                if own != conv:
                    best, piece = {NONE: (0, "")}, 0
                conv, seg, now = own, k, {}
            if entry in best:
                found = (best[entry][0] + cost, best[entry][1] + audit)
                now[to] = min(now.get(to, found), found)
        if len(out) >= 1_000:
            yield sent()
    if conv is not None:
        ended(True)
    yield sent()


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (conv, kind, pos, audit, initial), the audit's pieces (kind 0) before the messages (kind 1), which pass as a stream: what is inserted before each message, its edit
    and given role; one row more for the end."""
    out: list[tuple] = []

    def sent() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=["conv", "pos", "inserted", "edit", "given"])
        out.clear()
        return made

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for conv, own in groupby(rows, itemgetter(0)):
        pieces, message = [], []
        for row in own:
            if row[1]:
                message = [row]
                break
            pieces.append(row[3])
        inserted, pos = "", 0
        for edit, role in applied("".join(pieces), (row[4] for row in chain(message, own))):
            if edit == "I":
                inserted += f"{role}:\n"
            else:
                pos += 1
                out.append((conv, pos, inserted, edit, role))
                inserted = ""
                if len(out) == 10_000:
                    yield sent()
        out.append((conv, pos + 1, inserted, "D", None))
    yield sent()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by (conv, pos), each ended by a line feed: the hash of all without the last line feed."""
    conv, state, open_line, out = None, None, False, []
    for batch in batches:
        for own, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != conv:
                if conv is not None:
                    out.append((conv, state.hexdigest()))
                conv, state, open_line = own, hashlib.sha256(), False
            if lines:
                state.update((b"\n" if open_line else b"") + lines[:-1].encode())
                open_line = True
    if conv is not None:
        out.append((conv, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else ((), ()))], names=["conv", "repaired_sha256"])


def _long(rows: DataFrame, segment: int) -> DataFrame:
    """The report on conversations that spread over tasks. What one task reads of a conversation in order: a letter or so for each message, and, as a stream, the repaired lines."""
    there = rows.where("present").withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    numbered = stored(ordered.with_row_number(there, ["conv"], ["turn", "role", "text"], "pos"), "numbered")
    first = numbered.groupBy("conv", "digest").agg(F.min("pos").alias("first"))
    known = numbered.select("conv", "turn", "pos", "initial", "state", "digest").join(stored(first, "first-seen"), ["conv", "digest"])
    again = F.col("pos") > F.col("first")
    codes = stored(known.select("conv", "turn", "pos", "initial", "state", (again | (F.col("state") == BLANK)).alias("gone"), ((F.col("state") == CUT) & ~again).alias("cut")), "codes")
    cut = codes.groupBy("conv", F.floor((F.col("pos") - 1) / segment).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("pos", "initial", "gone", "cut"))).alias("codes"))
    searched = cut.mapInArrow(_segments, _SEARCHED)
    pieces = stored(searched.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_joined, "conv string, piece long, audit string, cost long"), "audits")
    steps = pieces.select("conv", F.lit(0).alias("kind"), F.col("piece").alias("pos"), "audit", F.lit("").alias("initial")).unionByName(codes.select("conv", F.lit(1).alias("kind"), "pos", F.lit("").alias("audit"), "initial"))
    edits = steps.repartition("conv").sortWithinPartitions("conv", "kind", "pos").mapInArrow(_edits, "conv string, pos long, inserted string, edit string, given string")
    stays = F.when(F.col("edit") == "D", "").otherwise(F.concat(F.coalesce("given", "role"), F.lit(":"), "text", F.lit("\n")))
    lines = stored(edits, "edits").join(numbered.select("conv", "pos", "role", "text"), ["conv", "pos"], "left").select("conv", F.concat("inserted", stays).alias("lines"), "pos")
    hashes = lines.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "lines").mapInArrow(_hashed, "conv string, repaired_sha256 string")
    before = codes.select("conv", (F.col("pos") + 1).alias("pos"), F.col("initial").alias("before"))
    pairs = codes.select("conv", "pos", "initial").join(before, ["conv", "pos"]).where(~F.concat("before", "initial").isin(*_LEGAL)).groupBy("conv").agg(F.count("*").alias("illegal"))
    turns = codes.where("turn is not null").groupBy("conv", "turn").count().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    blank = F.col("state") == BLANK
    counts = codes.groupBy("conv").agg(F.count_if(blank).alias("blank"), F.count_if(F.col("gone") & ~blank).alias("duplicate"), F.count_if("cut").alias("truncated"))
    whole = pieces.groupBy("conv").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    out = counts.join(turns, "conv", "left").join(pairs, "conv", "left").join(whole, "conv").join(hashes, "conv")
    return out.select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal"), "cost", "audit", "repaired_sha256")


def report(rows: DataFrame, *, most_rows: int = ROWS, most_chars: int = CHARS, segment: int = SEGMENT) -> DataFrame:
    """A row per conversation of ``messages``: conv_id (text), gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's messages go by turn (null turns first), those of one turn by role and text. A message's first fault counts: blank (spaces only), duplicate (role and
    text stood before), truncated (its last character that is no space isn't ``.``, ``!`` or ``?``). ``gaps``: turns that are missing between the first and the last;
    ``illegal``: neighbours whose roles' initials aren't su, ua or au; ``repaired_sha256`` of the repaired messages as ``role:text`` lines. Without messages that are
    present: zeros, an empty audit and the hash of nothing. No rows give no rows.
    """
    sizes = rows.groupBy("conv").agg(F.count_if("present").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = stored(sizes.where((F.col("n") > most_rows) | ((F.col("n") > 1) & (F.col("chars") > most_chars))).select("conv"), "long-conversations")
    if long.isEmpty():
        out = _short(rows)
    else:
        out = _short(rows.join(long, "conv", "left_anti")).unionByName(_long(rows.join(long, "conv", "left_semi"), segment))
    return out.select(F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).alias("conv_id"), *[c for c in out.columns if c != "conv"])
