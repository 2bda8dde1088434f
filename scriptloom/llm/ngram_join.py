"""Exact Jaccard self-join of documents on word n-grams, by vertical partitioning.

The global order of n-grams (their 64-bit hashes) is cut into fragments, and
each document's set into one segment for each fragment.  All occurrences of an
n-gram meet in one fragment, which counts there in how many different sets it
occurs.  N-grams of one set alone can't add to an overlap and are left behind,
so what goes on is small.  A set whose rarest n-grams, as many as two linked
sets may differ in, are all its own has no partner; the others meet by those
rare n-grams.  Where documents are compared, their sets are again cut into
fragments of the order: tasks count the partial overlaps of each fragment by
themselves, and these are summed for each pair.

A first round over a part of the order already shows most sets to have too many
n-grams of their own; only the rest is cut over the whole order.

Equal sets are one node from the start, and the members of large groups are
compared in blocks: first within each block and with a few common members, then
only those that aren't yet in the group's largest component with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import U64, as_long, hashes, mix, shingles, text_slices, words
from .components import connected_components
from .scratch import bounded, shuffle_partitions, table

#: Tokens that a map task holds before it sends its segments off.
BATCH_TOKENS = 1_000_000
#: An n-gram in so many sets of one batch is known to be frequent; its entries are spread instead of meeting in one fragment.
HOT_IN_BATCH = 64
HOT_DF = np.uint32(2**31)
#: N-grams of a fragment: more of them make more fragments.
FRAGMENT_GRAMS = 4_000_000
#: Members of one block of a group, and columns of one product when overlaps are counted.
BLOCK, COLUMNS = 256, 4096
#: Members whose blocks one task compares, and n-grams of theirs that it has at a time.
TASK_MEMBERS, TASK_GRAMS = 1024, 250_000


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, sorted distinct n-grams row by row, their number in each row)."""
    for row, data, offsets in text_slices(texts):
        rows = len(offsets) - 1
        starts, ends, at = words(data, offsets)
        grams, of = shingles(hashes(data, starts, ends), at, rows, k)
        bounds = np.searchsorted(of, np.arange(rows + 1))
        sizes, kept = np.zeros(rows, np.int64), []
        for i in np.flatnonzero(np.diff(bounds)):
            own = np.sort(grams[bounds[i] : bounds[i + 1]])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            sizes[i] = len(own)
            kept.append(own)
        yield row, rows, np.concatenate(kept) if kept else grams, sizes


def _signatures(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums of each set; the first names the node (never 0)."""
    end = np.cumsum(sizes)
    out = []
    for salt in (0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7):
        sums = np.concatenate(([U64(0)], np.cumsum(mix(grams ^ U64(salt)), dtype=U64)))
        out.append(mix(sums[end] - sums[end - sizes]))
    out[0][out[0] == 0] = 1
    return out[0], out[1]


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text: with its id they name a row, or rows that are the same."""
    return F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")


def set_table(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, a, b, n, node, check) of every row: two hashes of its text, set size and signatures of its n-gram set."""

    def run(batches):
        for batch in batches:
            for row, rows, grams, sizes in _sets(batch.column(1), k):
                node, check = _signatures(grams, sizes)
                kept = [batch.column(i).slice(row, rows) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes), pa.array(as_long(node)), pa.array(as_long(check))], names=["doc_id", "a", "b", "n", "node", "check"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *text_hashes(text)).mapInArrow(run, "doc_id long, a long, b long, n long, node long, check long")


def _segments(docs: DataFrame, text_col: str, k: int, fragments: int, share: float = 1.0) -> DataFrame:
    """Rows (part, key, node, n, count): a batch's segments in one fragment, as packed arrays.

    The fragments cover the first ``share`` of the order of n-grams.

    Parts from ``fragments`` on hold entries of n-grams that are frequent in
    their batch; the n-gram's own fragment gets a marker (node 0) for them.
    """

    def pack(part: int, tok: np.ndarray, doc: np.ndarray, node: np.ndarray, n: np.ndarray) -> dict:
        new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        return {
            "part": part,
            "key": tok.tobytes(),
            "node": as_long(node[doc[new]]).tobytes(),
            "n": n[doc[new]].astype("<u4").tobytes(),
            "count": np.diff(np.append(new, len(doc))).astype("<u4").tobytes(),
        }

    def cut(held: list) -> Iterator[dict]:
        tok, sizes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        node = _signatures(tok, sizes)[0]
        first = np.zeros(len(node), bool)
        first[np.unique(node, return_index=True)[1]] = True
        first &= sizes > 0
        scale = U64(round(fragments / share))
        fragment = lambda tok: (((tok >> U64(32)) * scale) >> U64(32)).astype(np.int64)
        keep = np.repeat(first, sizes)
        if share < 1:
            keep &= fragment(tok) < fragments
        tok, doc = tok[keep], np.repeat(np.arange(len(sizes)), sizes)[keep]
        if not len(tok):
            return
        part = fragment(tok)
        ordered = np.sort(tok)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        hot = ordered[edge[:-1]][np.diff(edge) >= HOT_IN_BATCH]
        if len(hot):
            where = np.minimum(np.searchsorted(hot, tok), len(hot) - 1)
            is_hot = hot[where] == tok
            spread = fragments + (as_long(node)[doc[is_hot]] >> 20) % fragments
            order = np.argsort(spread, kind="stable")
            hot_tok, hot_doc, spread = tok[is_hot][order], doc[is_hot][order], spread[order]
            for a, b in _runs(spread) if share == 1 else ():  # a first round counts only n-grams of one set
                yield pack(int(spread[a]), hot_tok[a:b], hot_doc[a:b], node, sizes)
            node, sizes = np.append(node, U64(0)), np.append(sizes, 0)
            tok, doc = np.concatenate([tok[~is_hot], hot]), np.concatenate([doc[~is_hot], np.full(len(hot), len(sizes) - 1)])
            part = fragment(tok)
        order = np.argsort(part.astype(np.uint16) if fragments <= 65535 else part, kind="stable")
        tok, doc, part = tok[order], doc[order], part[order]
        for a, b in _runs(part):
            yield pack(int(part[a]), tok[a:b], doc[a:b], node, sizes)

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for _, _, grams, sizes in _sets(batch.column(0), k):
                held.append((grams, sizes))
                total += len(grams)
                if total >= BATCH_TOKENS:
                    yield from map(_record, _packs(cut(held)))
                    held, total = [], 0
        if held:
            yield from map(_record, _packs(cut(held)))

    def _record(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("key", "node", "n", "count"))])
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "part long, key binary, node binary, n binary, count binary")


def _packs(rows: Iterator[dict], size: int = 64) -> Iterator[list[dict]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if len(x):
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
        yield from zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def _joined(t: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram, node and set size of each entry of a fragment's segments."""
    count = _joined(t, "count", "<u4")
    return _joined(t, "key", "<u8"), np.repeat(_joined(t, "node", "<i8"), count), np.repeat(_joined(t, "n", "<u4"), count)


def _dealt(node: np.ndarray, groups: int, columns: dict[str, np.ndarray]) -> pa.Table:
    """Rows (group, ...) of packed arrays: the entries of a node go to one group."""
    group = ((node >> 32) & 0x7FFFFFFF) % groups
    order = np.argsort(group, kind="stable")
    group, columns = group[order], {k: v[order] for k, v in columns.items()}
    rows = [{"group": int(group[a])} | {k: v[a:b].tobytes() for k, v in columns.items()} for a, b in _runs(group)]
    return pa.Table.from_pylist(rows, schema=pa.schema([("group", pa.int64()), *((c, pa.binary()) for c in columns)]))


def _ruled_out(segments: DataFrame, fragments: int, num: int, den: int) -> DataFrame:
    """(node) of the nodes that have, in these segments alone, more n-grams of their own than linked sets may differ in."""

    def own(t: pa.Table) -> pa.Table:
        node, n, u = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if t.column("part")[0].as_py() < fragments:
            key, node, n = _entries(t)
            order = np.argsort(key, kind="stable")
            key, node, n = key[order], node[order], n[order]
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            alone = np.minimum.reduceat(node, edge) == np.maximum.reduceat(node, edge)
            pick = edge[alone & (node[edge] != 0)]
            node, at, u = np.unique(node[pick], return_index=True, return_counts=True)
            n = n[pick][at]
        return _dealt(node, fragments, {"node": node, "n": n.astype("<u4"), "own": u.astype("<u4")})

    def out(t: pa.Table) -> pa.Table:
        node, n, u = _joined(t, "node", "<i8"), _joined(t, "n", "<u4").astype(np.int64), _joined(t, "own", "<u4")
        node, at, inverse = np.unique(node, return_index=True, return_inverse=True)
        n, u = n[at], np.bincount(inverse, u)
        return pa.table({"node": pa.array(node[u > n + (-n * num // den)], pa.int64())})

    return segments.groupBy("part").applyInArrow(own, "group long, node binary, n binary, own binary").groupBy("group").applyInArrow(out, "node long")


def _shared(segments: DataFrame, fragments: int) -> DataFrame:
    """From each fragment its n-grams of two sets or more: (group, node, n, gram, df) as packed arrays, dealt by node."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        key, node, n = _entries(t)
        if part >= fragments:
            df = np.full(len(key), HOT_DF, np.uint32)
        else:
            order = np.argsort(key, kind="stable")
            key, node, n = key[order], node[order], n[order]
            again = np.zeros(len(key), bool)
            again[1:] = key[1:] == key[:-1]
            again[:-1] |= again[1:]
            again |= node == 0
            key, node, n = key[again], node[again], n[again]
            order = np.lexsort((node, key))
            key, node, n = key[order], node[order], n[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, n = key[fresh], node[fresh], n[fresh]
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
            df = np.repeat(np.diff(edge), np.diff(edge)).astype(np.uint32)
            marked = key[node == 0]
            if len(marked):
                df[np.isin(key, marked)] = HOT_DF
            keep = (df > 1) & (node != 0)
            key, node, n, df = key[keep], node[keep], n[keep], df[keep]
        return _dealt(node, fragments, {"node": node, "n": n.astype("<u4"), "gram": key, "df": df})

    return segments.groupBy("part").applyInArrow(run, "group long, node binary, n binary, gram binary, df binary")


def _meeting(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n, grams, prefix) of the nodes that may have a partner: their shared n-grams, and those by which they meet.

    Linked sets of sizes n and more share at least ceil(n * num / den) n-grams,
    so of the n - that + 1 rarest n-grams of either, in one order for all, one
    is common.  N-grams of a single set come first in this order.
    """

    def run(t: pa.Table) -> pa.Table:
        node, n, gram, df = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("node", "<i8"), ("n", "<u4"), ("gram", "<u8"), ("df", "<u4")))
        order = np.lexsort((gram, df, node))
        node, n, gram, df = node[order], n[order], gram[order], df[order]
        fresh = np.ones(len(node), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (gram[1:] != gram[:-1])
        node, n, gram = node[fresh], n[fresh], gram[fresh]
        rows = []
        for a, b in _runs(node):
            size = int(n[a])
            reach = size - -(-size * num // den) + 1 - (size - (b - a))
            if reach > 0:
                own = gram[a:b].view(np.int64)
                rows.append({"node": int(node[a]), "n": size, "grams": np.sort(own), "prefix": own[:reach]})
        return pa.Table.from_pylist(rows, schema=pa.schema([("node", pa.int64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))]))

    return shared.groupBy("group").applyInArrow(run, "node long, n long, grams array<long>, prefix array<long>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    total = np.zeros((len(sets), len(sets)), np.float64)
    which = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    value = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    order = np.argsort(value, kind="stable")
    value, which = value[order], which[order]
    if not len(value):
        return total
    fresh = np.concatenate(([True], value[1:] != value[:-1]))
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1
    column, which = column[common], which[common]
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1 if len(column) else column
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        segment = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - start)), np.float32)
        segment[which[a:b], column[a:b] - start] = 1
        total += segment @ segment.T
    return total


def _partial(members: DataFrame, cuts: int) -> DataFrame:
    """(task, block, counts): for each fragment of the order and each block, how many of the fragment's n-grams each two members share.

    ``members`` are (task, block, node, n, label, grams) with ``grams`` in
    order; counts are those of pairs of different nodes in order, packed.
    """
    bounds = np.linspace(-(2.0**63), 2.0**63, cuts + 1)[1:-1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("grams")
            values, offsets = grams.values.to_numpy(), grams.offsets.to_numpy()
            at = np.stack([np.concatenate(([a], a + np.searchsorted(values[a:b], bounds), [b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            whole = pa.array(np.repeat(np.arange(len(batch)), cuts))
            segments = pa.LargeListArray.from_arrays(pa.array(np.append(at[:, :-1].ravel(), at[-1, -1]) if len(batch) else np.zeros(1, np.int64)), grams.values)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(whole) for c in ("task", "block", "node")] + [pa.array(np.tile(np.arange(cuts, dtype=np.int32), len(batch))), segments.cast(pa.list_(pa.int64()))], names=["task", "block", "node", "fragment", "segment"])

    def count(t: pa.Table) -> pa.Table:
        block, node = t.column("block").to_numpy(), t.column("node").to_numpy()
        order = np.lexsort((node, block))
        segments, out = t.column("segment").combine_chunks().take(pa.array(order)), []
        block, node = block[order], node[order]
        values, offsets = segments.values.to_numpy(), segments.offsets.to_numpy()
        for a, b in _runs(block):
            own = a + np.flatnonzero(np.diff(node[a:b], prepend=~node[a]))
            shared = overlaps([values[offsets[i] : offsets[i + 1]] for i in own])
            out.append((int(block[a]), shared[np.triu_indices(len(own), 1)].astype("<u4").tobytes()))
        return pa.table({"task": t.column("task").slice(0, 1).take(pa.array(np.zeros(len(out), np.int64))), "block": pa.array([x[0] for x in out], pa.int64()), "counts": pa.array([x[1] for x in out], pa.binary())})

    segments = members.select("task", "block", "node", "grams").mapInArrow(cut, "task long, block long, node long, fragment int, segment array<long>")
    return segments.groupBy("task", "fragment").applyInArrow(count, "task long, block long, counts binary")


def _compare(members: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what is linked within each block of ``members`` (keys, node, n, grams, label; pairs of one label are connected already)."""
    members = table(members.select(F.xxhash64(*keys).alias("block"), "node", "n", "label", "grams"), "compared")
    rows, grams = members.agg(F.count("*"), F.sum(F.size("grams"))).first()
    tasks = -(-rows // TASK_MEMBERS)
    members = members.withColumn("task", F.pmod("block", F.lit(max(1, tasks))))

    def run(partial: pa.Table, t: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        for block, counts in zip(partial.column("block").to_pylist(), partial.column("counts"), strict=True):
            own = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
            sums[block] = sums[block] + own if block in sums else own
        block, node = t.column("block").to_numpy(), t.column("node").to_numpy()
        order = np.lexsort((node, block))
        block, node, n, label = block[order], node[order], t.column("n").to_numpy()[order], t.column("label").to_numpy()[order]
        out = [np.zeros((2, 0), np.int64)]
        for a, b in _runs(block):
            own = a + np.flatnonzero(np.diff(node[a:b], prepend=~node[a]))
            out.append(node[own][_forest(sums[int(block[a])], n[own], label[own], num, den)])
        both = np.concatenate(out, 1)
        return pa.table({"a": pa.array(both[0]), "b": pa.array(both[1])})

    parts = _partial(members, max(2, -(-(grams or 0) // max(1, tasks) // TASK_GRAMS)))
    return parts.groupBy("task").cogroup(members.select("task", "block", "node", "n", "label").groupBy("task")).applyInArrow(run, "a long, b long")


def _forest(shared: np.ndarray, n: np.ndarray, label: np.ndarray, num: int, den: int) -> np.ndarray:
    """Two rows of places: links that connect what is linked, by the overlaps of all pairs in order."""
    one, two = np.triu_indices(len(n), 1)
    near = (den * shared >= num * (n[one] + n[two] - shared)) | (label[one] == label[two])
    linked = np.zeros((len(n), len(n)), bool)
    linked[one[near], two[near]] = linked[two[near], one[near]] = True
    root, out = np.full(len(n), -1), []
    for i in range(len(n)):
        if root[i] < 0:
            root[i], ahead = i, [i]
            while ahead:
                new = np.flatnonzero(linked[ahead.pop()] & (root < 0))
                root[new] = i
                ahead += new.tolist()
                out += new.tolist()
    return np.stack([np.array(out, np.int64), root[out].astype(np.int64)])


def _blocks(count, size: int):
    return F.ceil(count / F.lit(size)).cast("int")


def _fragments(spark: SparkSession, grams: int) -> int:
    return max(shuffle_partitions(spark), -(-grams // FRAGMENT_GRAMS))


def _remaining(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, fragments: int) -> DataFrame:
    """The rows of ``docs``, one at least for each node, that a first round over a part of the n-grams doesn't rule out."""
    out = table(_ruled_out(_segments(docs, text_col, k, fragments, min(1.0, 2.5 * (den - num) / den)), fragments, num, den), "ruled-out")
    ids = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(out, "node", "left_anti").select("least").distinct()
    ids = table(ids, "remaining")
    ids = bounded(ids, ids.count())
    return docs.join(ids, docs[id_col].cast("long").eqNullSafe(ids["least"]), "left_semi")


def node_components(docs: DataFrame, text_col: str, k: int, num: int, den: int, fragments: int) -> DataFrame:
    """(node, label) of the nodes with a link to another node: label names their component.

    Two nodes (different n-gram sets) link when their Jaccard similarity is
    num / den or more.  Every link counts: pairs are left uncompared only where
    their set sizes and rare n-grams rule a link out or they are connected.
    """
    meeting = table(_meeting(_shared(_segments(docs, text_col, k, fragments), fragments), num, den), "meeting")
    at = meeting.select("node", F.explode("prefix").alias("gram"))
    least = at.groupBy("gram").agg(F.min("node").alias("lead"), F.count("*").alias("c")).where("c > 1")
    group = table(connected_components(at.join(least, "gram").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))), "groups")
    sizes = group.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("c"))
    members = meeting.drop("prefix").join(group.withColumnRenamed("label", "cluster").join(sizes, "cluster"), "node")
    members = table(members.withColumns({"blocks": _blocks(F.col("c"), BLOCK), "block": F.pmod(F.xxhash64("node"), _blocks(F.col("c"), BLOCK)).cast("int"), "label": F.col("node")}), "members")
    guide = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("c")) < 8)
    within = members.withColumn("block", F.explode(F.when(guide, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    links = table(_compare(within, ["cluster", "block"], num, den), "links")
    found = table(connected_components(links), "linked")
    large = members.where("blocks > 1").drop("label").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = large.groupBy("cluster", "label").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("label", "c").alias("main"))
    large = large.join(main, "cluster")
    rest = large.where("label <> main")
    counts = rest.groupBy("cluster").agg(_blocks(F.count("*"), BLOCK).alias("others"))
    rest = rest.join(counts, "cluster").withColumn("other", F.pmod(F.xxhash64("node", F.lit(3)), F.col("others")).cast("int"))
    crossed = (
        rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", "block", "other", "node", "n", "grams", "label")
        .union(large.join(counts, "cluster").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select("cluster", "block", "other", "node", "n", "grams", "label"))
    )
    more = table(_compare(crossed, ["cluster", "block", "other"], num, den), "links")
    return connected_components(links.union(more))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs without white space, A-Z in lower case; a text of fewer than
    ``k`` words has its whole sequence as its one n-gram.  component_id is the
    least doc_id that links reach, the row's own included.

    Null and empty texts have an empty set, link with nothing and keep their
    own id.  Rows that repeat (text, doc_id or both) each give a row; equal
    sets are linked.  Ties don't arise: the least id is one value.  A null
    doc_id takes part in links but never names a component that has another id.
    An empty table gives no rows; other columns of ``docs`` play no part.  Sets
    and n-grams go by 64-bit hashes; for m different texts, the chance that two
    are confused is about m * m / 2 ** 65.
    """
    sets, nodes = _linked(docs, id_col, text_col, k, num, den)
    component = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = nodes.join(component, "label").select("node", "component_id")
    full = sets.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def _linked(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The set table of ``docs``, and (node, least, label) of its nodes: their least id and their component."""
    sets = table(set_table(docs, id_col, text_col, k), "sets")
    fragments = _fragments(docs.sparkSession, sets.agg(F.sum("n")).first()[0] or 0)
    label = table(node_components(_remaining(docs, sets, id_col, text_col, k, num, den, fragments), text_col, k, num, den, fragments), "labels")
    nodes = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return sets, table(nodes, "nodes")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each group of linked texts, that of the least doc_id; columns stay.

    Rows are judged, not ids: a row is told by its id and its text's hashes.
    Of linked rows with one least id, or with null ids alone, that of the least
    hashes stays; an id comes before null.  Rows with the same id and text are
    one; unlinked texts all stay, whatever ids they share.  Texts without words
    are linked with nothing.  An empty table stays empty.
    """
    sets, nodes = _linked(docs, id_col, text_col, k, num, den)
    rows = table(sets.where("n > 0").join(nodes.select("node", "label"), "node").select("label", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "a", "b").alias("row")).distinct(), "components-of")
    first = rows.groupBy("label").agg(F.min("row").alias("first"))
    lesser = table(rows.join(first, "label").where("row <> first").select(F.col("row.doc_id").alias("_id"), F.col("row.a").alias("_a"), F.col("row.b").alias("_b")).distinct(), "copies")
    again = table(sets.groupBy("doc_id", "a", "b").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("a").alias("_a"), F.col("b").alias("_b")), "repeated-rows")
    a, b = text_hashes(F.col(text_col).cast("string"))
    keyed = docs.withColumns({"__a": a, "__b": b})
    same = lambda t: keyed[id_col].cast("long").eqNullSafe(t["_id"]) & (keyed["__a"] == t["_a"]) & (keyed["__b"] == t["_b"])
    lesser = bounded(lesser, lesser.count())
    n_again = again.count()
    if not n_again:
        return keyed.join(lesser, same(lesser), "left_anti").drop("__a", "__b")
    again = bounded(again, n_again)
    left = keyed.join(lesser, same(lesser), "left_anti")
    once, more = left.join(again, same(again), "left_anti"), left.join(again, same(again), "left_semi")
    return once.unionByName(more.dropDuplicates([id_col, "__a", "__b"])).drop("__a", "__b")
