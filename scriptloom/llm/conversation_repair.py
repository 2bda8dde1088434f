"""Conversation structure repair: the cheapest edits that give a legal order of roles.

A recursive query of DuckDB runs over batches of whole conversations inside
Spark's tasks.  Each recursion takes one turn of all conversations of the batch
and keeps, for each state of the grammar of roles, the least cost and the least
audit (the initials of the edits) of that cost.  Two audits of one state, place
and cost are never each other's beginning (what follows would be insertions,
which cost), so the lesser one stays the lesser whatever follows.

Conversations of more than LONG rows are cut into blocks of turns, which go to
tasks of their own and are solved from every state they can be entered in; the
blocks' results are then followed in order.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import table

#: Rows of a conversation beyond which it is cut, and turns of a block.
LONG, BLOCK_TURNS = 512, 256
#: Rows and bytes that a batch has at least before it is solved, unless no more come.
BATCH_ROWS, BATCH_BYTES = 20_000, 16 << 20
#: What the edits cost; a truncated row that stays costs one more.
RECAST, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a; the state that each initial leads to.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = range(4)
LEGAL_PAIRS = ("su", "ua", "au")
#: To end well: insertions that each state needs.
ENDINGS = {0: 0, 1: 2, 2: 1, 3: 0}

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def moves() -> list[tuple[int, str, int, int, str]]:
    """(state, class of a row, next state, cost, audit) of the best edits for one row, insertions before it included.

    A class is the initial of the role (x: none of the grammar) and whether the
    row is cut off, or "must go".
    """
    best: dict[tuple[int, str, int], tuple[int, str]] = {}

    def offer(state: int, kind: str, to: int, cost: int, audit: str) -> None:
        key = (state, kind, to)
        best[key] = min(best.get(key, (cost, audit)), (cost, audit))

    for state in STATES:
        offer(state, "must go", state, DELETE, "D")
        for initial in "uasx":
            for cut in (0, 1):
                kind = f"{initial}{cut}"
                offer(state, kind, state, DELETE, "D")
                at, inserted = state, 0
                while True:
                    for role in "uas":
                        if (to := NEXT.get((at, role))) is not None:
                            if role == initial:
                                offer(state, kind, to, inserted * INSERT + cut * TRUNCATED, "I" * inserted + "K")
                            if role != "s":
                                offer(state, kind, to, inserted * INSERT + RECAST + cut * TRUNCATED, "I" * inserted + "R")
                    if inserted == 2:
                        break
                    at, inserted = next(to for (s, role), to in NEXT.items() if s == at and role != "s"), inserted + 1
    return [(state, kind, to, cost, audit) for (state, kind, to), (cost, audit) in sorted(best.items())]


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(repr(x) for x in row)})" for row in rows)


#: Rows of a batch in order, with their faults; ``batch`` has (seg, turn, h, role, text, copies, blank, cut, seen, present).
_ROWS = """
create or replace temp table r as
select seg, pos, sum(copies) over (partition by seg order by pos rows unbounded preceding) - copies + 1 as place, turn, role, text, copies, blank, cut, init, not blank and again as again,
  case when blank or again then 'must go' else (case when init in ('u', 'a', 's') then init else 'x' end) || cut::int::varchar end as kind, lag(init) over (partition by seg order by pos) as before
from (select *, left(role, 1) as init, seen or row_number() over (partition by seg, role, text order by pos) > 1 as again from (
  select *, row_number() over (partition by seg order by turn nulls first, h, role, text) as pos from batch where present))
"""
_SOLVE = f"""
create or replace temp table solved as
with recursive moves(state, kind, goes, price, letters) as (values {_values(moves())}),
step as (
  select seg, entry, entry as state, 0::bigint as pos, 0::bigint as cost, '' as audit from (select distinct seg from r), entries
  union all
  select seg, entry, goes, pos, best.c, best.a from (
    select s.seg, s.entry, m.goes, r.pos, min({{'c': s.cost + m.price + {DELETE} * (r.copies - 1), 'a': s.audit || m.letters || repeat('D', r.copies - 1)}}) as best
    from step s join r on r.seg = s.seg and r.pos = s.pos + 1 join moves m on m.state = s.state and m.kind = r.kind group by all)
)
select step.* from step join (select seg, max(pos) as pos from r group by seg) using (seg, pos)
"""
_FAULTS = f"""
select seg, sum(copies)::bigint as rows, min(turn) as least, max(turn) as most, count(distinct turn)::bigint as turns, coalesce(sum(copies) filter (blank), 0)::bigint as blank,
  coalesce(sum(case when blank then 0 when again then copies else copies - 1 end), 0)::bigint as duplicate, count(*) filter (cut and not blank and not again)::bigint as truncated,
  (sum(copies - 1) + count(*) filter (before || init not in {LEGAL_PAIRS}))::bigint as illegal, arg_min(init, pos) as first_init, arg_max(init, pos) as last_init
from r group by seg
"""
#: The texts that an audit leaves; ``plan`` has (seg, entry, audit). By the state of its entry, a block begins with the user's turn or the assistant's.
_REPAIRED = """
with letters as (select seg, entry, unnest(range(1, len(audit) + 1)) as i, unnest(string_split(audit, '')) as letter from plan where audit <> ''),
counted as (select *, count(*) filter (letter <> 'I') over w as place, count(*) filter (letter <> 'D') over w as k from letters window w as (partition by seg order by i)),
joined as (select c.*, r.role, r.text, r.init from counted c left join r on r.seg = c.seg and r.place = c.place and c.letter in ('K', 'R')),
led as (select *, coalesce(bool_or(entry = 0 and k = 1 and letter = 'K' and init = 's') over (partition by seg), false) as leads from joined)
select seg, string_agg(case when letter = 'K' then role when (k + (entry = 2)::int - leads::int) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by i) as repaired from led where letter <> 'D' group by seg
"""
_BEST = f"""
select seg, entry, best.c as cost, best.a as audit from (select seg, entry, min({{'c': cost + price, 'a': audit || letters}}) as best from solved join (values {_values([(s, n * INSERT, "I" * n) for s, n in ENDINGS.items()])}) e(state, price, letters) using (state) group by seg, entry)
"""


def _connection(entries: list[int]):
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
    con.execute("set preserve_insertion_order = false")
    con.execute(f"create table entries as select * from (values {_values([(e,) for e in entries])}) t(entry)")
    return con


def _batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, with their number as ``seg``, of some BATCH_ROWS rows or BATCH_BYTES bytes."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held, rows, size = [*held, batch], rows + len(batch), size + batch.nbytes
        if rows < BATCH_ROWS and size < BATCH_BYTES:
            continue
        whole = _numbered(pa.Table.from_batches(held).combine_chunks(), keys)
        seg = whole.column("seg").to_numpy()
        cut = int(seg.searchsorted(seg[-1]))  # the last group may go on
        rest = whole.slice(cut).drop_columns("seg").combine_chunks()
        if cut:
            yield whole.slice(0, cut)
        held, rows, size = rest.to_batches(), len(rest), rest.nbytes
    if rows:
        yield _numbered(pa.Table.from_batches(held).combine_chunks(), keys)


def _numbered(rows: pa.Table, keys: list[str]) -> pa.Table:
    changes = np.zeros(len(rows), bool)
    for key in keys:
        column = rows.column(key).combine_chunks()
        known, value = column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)
        changes[1:] |= (known[1:] != known[:-1]) | (value[1:] != value[:-1])
    return rows.append_column("seg", pa.array(np.cumsum(changes)))


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RESULT for the whole conversations of sorted rows."""
    con = _connection([0])
    for rows in _batches(batches, ["conv_id"]):
        con.register("batch", rows)
        con.execute(_ROWS)
        con.execute(_SOLVE)
        con.execute(f"create or replace temp table plan as {_BEST}")
        yield from con.sql(f"""
            select conv_id, coalesce(least(most::hugeint - least + 1 - turns, {(1 << 63) - 1}), 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
              coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
            from (select seg, any_value(conv_id) as conv_id from batch group by seg) left join ({_FAULTS}) using (seg) left join plan using (seg) left join ({_REPAIRED}) using (seg)
        """).to_arrow_table().to_batches()
        con.unregister("batch")


BLOCK = ["conv_id", "b", "t", "s"]
_BLOCK_TYPES = "conv_id long, b long, t long, s long"
_PATHS = f"{_BLOCK_TYPES}, entry int, state int, cost long, audit string, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, first_init string, last_init string"


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _PATHS: the best way through each block from each state to each state, and the block's faults."""
    con = _connection(list(STATES))
    for rows in _batches(batches, BLOCK):
        con.register("batch", rows)
        con.execute(_ROWS)
        con.execute(_SOLVE)
        columns = "entry, state, cost, audit, least, most, turns, blank, duplicate, truncated, illegal, first_init, last_init"
        yield from con.sql(f"select {', '.join(BLOCK)}, {columns} from (select seg, {', '.join(f'any_value({k}) as {k}' for k in BLOCK)} from batch group by seg) join solved using (seg) join ({_FAULTS}) using (seg)").to_arrow_table().to_batches()
        con.unregister("batch")


class _Way:
    """The best ways through the blocks of one conversation so far, one for each state; what they share is kept once."""

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, str]] = {0: (0, "")}
        self.shared: list[str] = []
        self.blocks: list[tuple[tuple, dict[int, int]]] = []
        self.sums = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.last_init = None

    def add(self, key: tuple, paths: list[dict]) -> None:
        best: dict[int, tuple[int, str, int]] = {}
        for p in paths:
            if p["entry"] in self.ways:
                cost, audit = self.ways[p["entry"]]
                new = (cost + p["cost"], audit + p["audit"], p["entry"])
                best[p["state"]] = min(best.get(p["state"], new), new)
        shared = os.path.commonprefix([audit for _, audit, _ in best.values()])
        self.shared.append(shared)
        self.ways = {state: (cost, audit[len(shared) :]) for state, (cost, audit, _) in best.items()}
        self.blocks.append((key, {state: entry for state, (_, _, entry) in best.items()}))
        facts = paths[0]
        for name in self.sums:
            self.sums[name] += facts[name]
        self.sums["turns"] -= facts["least"] is not None and facts["least"] == self.most  # two blocks of one turn
        self.sums["illegal"] += self.last_init is not None and self.last_init + facts["first_init"] not in LEGAL_PAIRS
        self.last_init = facts["last_init"]
        if facts["least"] is not None:
            self.least, self.most = facts["least"] if self.least is None else self.least, facts["most"]

    def rows(self) -> Iterator[dict]:
        """What each block of the best way is entered and left by, and the conversation's result."""
        cost, audit, state = min((cost + ENDINGS[s] * INSERT, audit + "I" * ENDINGS[s], s) for s, (cost, audit) in self.ways.items())
        gaps = 0 if self.least is None else min((1 << 63) - 1, self.most - self.least + 1 - self.sums["turns"])
        conv_id = self.blocks[0][0][0]
        yield {"conv_id": conv_id, "gaps": gaps, **{k: n for k, n in self.sums.items() if k != "turns"}, "cost": cost, "audit": "".join(self.shared) + audit}
        more = "I" * ENDINGS[state]
        for key, entries in reversed(self.blocks):
            yield dict(zip(BLOCK, key, strict=True)) | {"entry": entries[state], "state": state, "more": more}
            state, more = entries[state], ""


_FOLLOWED = f"{_BLOCK_TYPES}, entry int, state int, more string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _FOLLOWED for sorted rows of _PATHS: one for each conversation, and one for each block."""
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (x.split() for x in _FOLLOWED.split(", "))])
    out: list[dict] = []
    way = key = None
    paths: list[dict] = []

    def taken() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_pylist(out[i : i + 10_000], schema=schema)
        out.clear()

    for batch in batches:
        for p in batch.to_pylist():
            at = tuple(p[k] for k in BLOCK)
            if at != key:
                if way and paths:
                    way.add(key, paths)
                if way is None or at[0] != key[0]:
                    out += way.rows() if way else []
                    way = _Way()
                key, paths = at, []
            paths.append(p)
        yield from taken()
    if way:
        way.add(key, paths)
        out += way.rows()
        yield from taken()


def _repair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, repaired): the texts of each block along its chosen way."""
    con = _connection(list(STATES))
    for rows in _batches(batches, BLOCK):
        con.register("batch", rows)
        con.execute(_ROWS)
        con.execute(_SOLVE)
        con.execute("create or replace temp table plan as select seg, s.entry, s.audit || more as audit from solved s join (select distinct seg, entry, state, more from batch) using (seg, entry, state)")
        yield from con.sql(f"select {', '.join(BLOCK)}, repaired from (select seg, {', '.join(f'any_value({k}) as {k}' for k in BLOCK)} from batch group by seg) join ({_REPAIRED}) using (seg)").to_arrow_table().to_batches()
        con.unregister("batch")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of sorted pieces, read one after the other."""
    key, found, ids, digests = None, None, [], []
    for batch in batches:
        for conv_id, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if found is None or conv_id != key:
                if found is not None:
                    ids, digests = [*ids, key], [*digests, found.hexdigest()]
                key, found = conv_id, hashlib.sha256()
            else:
                found.update(b"\n")
            found.update(piece.encode())
    if found is not None:
        ids, digests = [*ids, key], [*digests, found.hexdigest()]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join by keys in which null equals null; the keys of the right side go."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    found = left.join(other, [left[k].eqNullSafe(other[f"_{k}"]) for k in keys], how)
    return found if how in ("left_semi", "left_anti") else found.drop(*[f"_{k}" for k in keys])


def _long(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Results of the long conversations, by blocks.

    Equal rows are one with a number of copies; a row is a repetition if its
    role and text have an earlier turn, which the least turn of each tells.  A
    block of one turn with too many rows is cut by their hashes, by which rows
    of one turn are in order.
    """
    same = ["conv_id", "turn", "role", "text"]
    rows = _same(rows.where("present"), ids, ["conv_id"], "left_semi").groupBy(*same).agg(F.sum("copies").cast("long").alias("copies"), F.lit(True).alias("present"))
    rows = table(_with_faults(rows).withColumns({"b": F.floor(F.col("turn") / BLOCK_TURNS), "k": F.xxhash64(F.lit(1), "role", "text")}), "long")
    thick = rows.groupBy("conv_id", "b").agg(F.count("*").alias("rows")).where(F.col("rows") > LONG)
    placed = _same(rows, thick, ["conv_id", "b"], "left")
    piece = F.shiftright((F.shiftright("h", 32) + (1 << 31)) * F.floor(F.col("rows") / LONG + 1), 32)
    placed = placed.withColumns({"t": F.when(F.col("rows").isNotNull(), F.col("turn")), "s": F.coalesce(piece, F.lit(0)).cast("long")})
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = rows.groupBy("conv_id", "h", "k").agg(F.min(when).alias("first"))
    placed = _same(placed.drop("rows"), first, ["conv_id", "h", "k"], "inner").withColumn("seen", when != F.col("first"))
    blocks = table(placed.select(*BLOCK, *_SENT), "blocks")
    # the sort is by what a key means: null first, as in the batches
    sorted_rows = lambda df, key: df.repartition(*key).sortWithinPartitions(*BLOCK)
    paths = table(sorted_rows(blocks, BLOCK).mapInArrow(_solve_blocks, _PATHS), "paths")
    followed = table(sorted_rows(paths, ["conv_id"]).mapInArrow(_follow, _FOLLOWED), "followed")
    chosen = followed.where("entry is not null").select(*BLOCK, "entry", "state", "more")
    pieces = table(sorted_rows(_same(blocks, chosen, BLOCK, "inner"), BLOCK).mapInArrow(_repair_blocks, f"{_BLOCK_TYPES}, repaired string"), "pieces")
    digests = sorted_rows(pieces, ["conv_id"]).select("conv_id", "repaired").mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    results = _same(followed.where("entry is null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), digests, ["conv_id"], "left")
    return _same(ids.select("conv_id"), results, ["conv_id"], "left").fillna({"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


#: Columns that go to the batches.
_SENT = ["turn", "h", "role", "text", "copies", "blank", "cut", "seen", "present"]


def _with_faults(rows: DataFrame) -> DataFrame:
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    return rows.withColumns({"h": F.xxhash64("role", "text"), "blank": last == "", "cut": ~last.isin(".", "!", "?"), "seen": F.lit(False)})


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, present): a fixed fault in a quarter of the rows, by the hash of conversation and turn.

    Nulls of role and text are one space, as are those of conversation and turn in what is hashed.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")), F.lit(20))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"), (fault != 0).alias("present"))
    return rows


def repaired(rows: DataFrame) -> DataFrame:
    """Rows of RESULT, one for each conversation of ``rows`` (conv_id, turn, role, text, copies, present).

    Rows go by turn, nulls first; rows of one turn by a hash of role and text.
    A row that isn't present only names its conversation, and one without any
    that is has zeros, an empty audit and the hash of an empty text.  A null
    conv_id is a conversation of its own.  Equal rows are repetitions of the
    first; roles go by their initials, an empty role has none.  Very long texts
    stay whole; a repaired conversation is hashed piece by piece.  An empty
    table gives no rows, other columns play no part.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "copies", "present")
    ids = table(rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).where(F.col("n") > LONG), "long-ids")
    some = ids.limit(1).count() > 0
    short = _same(rows, ids, ["conv_id"], "left_anti") if some else rows
    found = _with_faults(short).select("conv_id", *_SENT).repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_repair, RESULT)
    return found.unionByName(_long(rows, ids)) if some else found
