"""Conversation structure repair: cheapest edits to role order, by weighted CYK interval parsing.

A conversation is well formed when its role initials read ``(s?(ua)+)?``.  Its rows may be
kept (0), get the role user or assistant (2) or go (3; blank rows and rows that repeat an
earlier role and text must), rows without text may be inserted anywhere (2), and a row that
stays though its text breaks off costs 1 more.

The repair grammar is in Chomsky normal form.  A nonterminal ``(p, q)`` covers the spans
that lead the form from state p to q; a binary rule ``(p, q) -> (p, r) (r, q)`` exists for
every r, a terminal rule for every edit of one row, and the insertions are closed over in
every cell.  A cell holds the least (cost, audit) of each nonterminal over a span; audits
are the edits' initials.  Cells are combined bottom-up by span length: rows, pairs, spans of
4, 8 and so on.  Since every r has a rule, each derivation of a span passes through each of
its split points, so one split a span finds what all would: n cells rather than n * n.  Equal
costs never leave one audit a prefix of another over one span (it would hold more
insertions), so least parts make the least whole.

Rows are ordered by turn (nulls first), then role, then the text's SHA-256.  Equal rows are
counted before any shuffle, and only keys, digests and symbols are ordered, by range, so one
conversation may hold any share of the rows: spans of 4096 rows are parsed apart, then their
cells are folded.  Texts move only to meet their edits, by the row's whole key.

Defined results: a null conv_id is a conversation of its own; null roles and texts are one
space; an empty role fits no place and can't be kept; other columns are left behind; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The form's moves by role initial, its final states, the costs.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
RETITLE, DELETE, INSERT, BROKEN = 2, 3, 2, 1

#: Rows of a span that is parsed in one step, as a power of two.
SPAN_BITS = 12

_WORDY = r"[^\x20\x09-\x0D]"
_STATES = range(len(MOVES))
#: A row's symbol: its initial, in upper case when its text breaks off, a digit when it must go.
_SYMBOLS = {"fine": "suao", "broken": "SUAO", "gone": "1234"}
_INITIAL = str.maketrans("SUAO1234", "suaosuao")

Cell = tuple  # (cost, audit) or None for each nonterminal (p, q), at 4 * p + q


def _best(*options):
    return min((o for o in options if o is not None), default=None)


def combine(a: Cell, b: Cell) -> Cell:
    """The cell of a span from those of its two parts, by the binary rules."""
    out = []
    for p in _STATES:
        for q in _STATES:
            best = None
            for r in _STATES:
                x, y = a[4 * p + r], b[4 * r + q]
                if x is not None and y is not None:
                    cost = x[0] + y[0]
                    if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                        best = (cost, x[1] + y[1])
            out.append(best)
    return tuple(out)


def _insertions() -> Cell:
    """Nothing, or rows inserted until no cell falls."""
    cell = tuple((0, "") if p == q else (INSERT, "I") if q in (MOVES[p].get("u"), MOVES[p].get("a")) else None for p in _STATES for q in _STATES)
    while (more := tuple(_best(x, y) for x, y in zip(cell, combine(cell, cell)))) != cell:
        cell = more
    return cell


NOTHING = _insertions()


@lru_cache(maxsize=None)
def leaf(symbol: str) -> Cell:
    """The cell of one row: the terminal rules, closed under insertions."""
    initial, rules = symbol.translate(_INITIAL), {}
    for p in _STATES:
        rules[p, p] = (DELETE, "D")
        if symbol not in _SYMBOLS["gone"]:
            extra = BROKEN if symbol in _SYMBOLS["broken"] else 0
            for role, q in MOVES[p].items():
                if role in "ua":
                    rules[p, q] = _best(rules.get((p, q)), (RETITLE + extra, "R"))
                if role == initial:
                    rules[p, q] = _best(rules.get((p, q)), (extra, "K"))
    row = tuple(rules.get((p, q)) for p in _STATES for q in _STATES)
    return combine(combine(NOTHING, row), NOTHING)


def parse(word: str) -> Cell:
    """The cell of a span of symbols, bottom-up by span length."""
    if not word:
        return NOTHING
    size = 8
    cells = [_short(word[i:i + size]) for i in range(0, len(word), size)]
    while len(cells) > 1:
        pairs = [combine(x, y) for x, y in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(pairs) * 2:]
    return cells[0]


@lru_cache(maxsize=1 << 15)
def _short(word: str) -> Cell:
    if len(word) == 1:
        return leaf(word)
    half = 1 << (len(word) - 1).bit_length() - 1
    return combine(_short(word[:half]), _short(word[half:]))


def cheapest(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return _best(*(cell[q] for q in FINAL))


def illegal_pairs(initials: str) -> int:
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the fixed damage by crc32 of conv_id:turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")]
    return (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
            .filter("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies")))


def _keyed(rows: DataFrame) -> DataFrame:
    """Keys without nulls: c and t stand for conv_id and turn, h for the text."""
    t = F.coalesce(F.col("turn").cast("decimal(20,0)"), F.expr("-9223372036854775809BD").cast("decimal(20,0)"))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("c"), t.alias("t"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies")
                       ).withColumn("h", F.unhex(F.sha2("text", 256)))


def _symbol(kind: Column, initial: Column) -> Column:
    at = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    text = F.when(kind == "gone", _SYMBOLS["gone"]).when(kind == "broken", _SYMBOLS["broken"]).otherwise(_SYMBOLS["fine"])
    return F.substr(text, at, F.lit(1))


def _ordered(rows: DataFrame) -> DataFrame:
    """One row per different (c, t, role, h): its position, faults and symbols; no texts."""
    blank, last = ~F.col("text").rlike(_WORDY), F.regexp_extract("text", rf"(?s)({_WORDY})[\x20\x09-\x0D]*$", 1)
    light = (rows.select("c", "t", "turn", "role", "h", blank.alias("blank"), (~last.isin(".", "!", "?")).alias("broken"), "copies")
             .groupBy("c", "t", "turn", "role", "h", "blank", "broken").agg(F.sum("copies").alias("copies")))
    light = materialize(light, "turns")
    again = light.groupBy("c", "role", "h").agg(F.count("*").alias("n"), F.min("t").alias("first")).filter("n > 1").drop("n")
    light = light.join(again, ["c", "role", "h"], "left").withColumn("again", F.col("t") > F.coalesce("first", "t"))
    initial = F.substr("role", F.lit(1), F.lit(1))
    fresh = ~F.col("blank") & ~F.col("again")
    gone = _symbol(F.lit("gone"), initial)
    word = F.when(fresh, F.concat(_symbol(F.when(F.col("broken"), "broken").otherwise("fine"), initial), F.repeat(gone, (F.col("copies") - 1).cast("int")))) \
        .otherwise(F.repeat(gone, F.col("copies").cast("int")))
    keys = ["c", "t", "role", "h"]
    out = light.select(*keys, "turn", word.alias("word"), F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"),
                       F.when(F.col("blank"), 0).otherwise(F.col("copies") - fresh.cast("long")).alias("duplicate"), (fresh & F.col("broken")).cast("long").alias("truncated"))
    return materialize(out.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id()), "turns-in-order")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, span, word) -> the span's cell and what its ends need."""
    for b in batches:
        words = b.column("word").to_pylist()
        cells = [parse(w) for w in words]
        yield pa.RecordBatch.from_arrays([
            b.column("c"), b.column("span"), pa.array([len(w) for w in words], pa.int64()), pa.array([w[:1] + w[-1:] for w in words], pa.string()),
            pa.array([illegal_pairs(w.translate(_INITIAL)) for w in words], pa.int64()),
            pa.array([[x and x[0] for x in c] for c in cells], pa.list_(pa.int64())), pa.array([[x and x[1] for x in c] for c in cells], pa.list_(pa.string()))],
            names=["c", "span", "n", "ends", "illegal", "costs", "audits"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in the order of (c, span) -> a row for each conversation, and one with its part of the audit for each span.

    Neighbouring cells of equal length are combined as they come, so few are held."""
    schema = pa.schema([("c", pa.string()), ("span", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("start", pa.int64()), ("odd", pa.bool_())])
    at, spans, stack, illegal, end = None, [], [], 0, ""
    out: list[tuple] = []

    def close():
        if at is None:
            return
        cell = None
        for _, x in reversed(stack):
            cell = x if cell is None else combine(x, cell)
        cost, audit = cheapest(cell)
        letters = np.frombuffer(audit.encode(), np.uint8)
        rows = np.flatnonzero(letters != ord("I"))  # each row has one letter; the last span takes what is inserted behind it
        kept = np.r_[0, np.cumsum(letters != ord("D"))]
        odd, lo, done = bool(kept[-1] % 2), 0, 0
        out.append((at, None, cost, audit, illegal, None, odd))
        for i, (span, n) in enumerate(spans):
            done += n
            hi = len(audit) if i == len(spans) - 1 else int(rows[done - 1]) + 1
            out.append((at, span, None, audit[lo:hi], None, int(kept[lo]), odd))
            lo = hi

    def batch():
        got = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
        out.clear()
        return got

    for b in batches:
        for r in b.to_pylist():
            if r["c"] != at:
                close()
                at, spans, stack, illegal, end = r["c"], [], [], 0, ""
            illegal += r["illegal"] + illegal_pairs((end + r["ends"][0]).translate(_INITIAL))
            end = r["ends"][1]
            spans.append((r["span"], r["n"]))
            stack.append((1, tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"]))))
            while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                (n, x), (_, y) = stack[-2:]
                stack[-2:] = [(2 * n, combine(x, y))]
        if len(out) > 2000:
            yield batch()
    close()
    yield batch()


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A span's rows and its part of the audit -> the edits that each row takes and where its output starts."""
    for b in batches:
        got = []
        for r in b.to_pylist():
            at, start, audit = 0, r["start"], r["audit"]
            for i, row in enumerate(r["rows"]):
                left, lo = len(row["word"]), at
                while left:
                    left -= audit[at] != "I"
                    at += 1
                if i == len(r["rows"]) - 1:
                    at = len(audit)
                mine = audit[lo:at]
                if mine.strip("D"):
                    got.append((r["c"], row["t"], row["role"], row["h"], mine, start, r["odd"]))
                start += len(mine) - mine.count("D")
        cols = list(zip(*got)) or [()] * 7
        kinds = [pa.string(), pa.decimal128(20, 0), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["c", "t", "role", "h", "edits", "start", "odd"])


class Repair:
    """The repair of a table of conversations (conv_id, turn, role, text and maybe copies).

    ``summary``: c, cost, audit, illegal, blank, duplicate, truncated, gaps for each conversation.
    ``rows()``: c, place, role, text, edit of all rows after the repair.
    """

    def __init__(self, conversations: DataFrame):
        self.texts = _keyed(conversations)
        self.turns = _ordered(self.texts)
        span = F.shiftright("pos", SPAN_BITS)
        row = F.struct("pos", "word", "t", "role", "h")
        self.spans = materialize(self.turns.groupBy("c", span.alias("span")).agg(F.sort_array(F.collect_list(row)).alias("rows")), "spans")
        words = self.spans.select("c", "span", F.array_join("rows.word", "").alias("word"))
        cells = words.mapInArrow(_cells, "c string, span long, n long, ends string, illegal long, costs array<long>, audits array<string>")
        self.parsed = materialize(cells.repartition("c").sortWithinPartitions("c", "span")
                                  .mapInArrow(_fold, "c string, span long, cost long, audit string, illegal long, start long, odd boolean"), "parsed")

    @property
    def summary(self) -> DataFrame:
        sums = (self.turns.groupBy("c", "turn").agg(*[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
                .groupBy("c").agg(*[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")],
                                  F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")))
        return self.parsed.filter("span IS NULL").select("c", "cost", "audit", "illegal").join(sums, "c")

    def rows(self) -> DataFrame:
        parts = self.parsed.filter("span IS NOT NULL").select("c", "span", "audit", "start", "odd")
        edits = (self.spans.join(parts, ["c", "span"]).select("c", "rows", "audit", "start", "odd")
                 .mapInArrow(_edits, "c string, t decimal(20,0), role string, h binary, edits string, start long, odd boolean"))
        keys = ["c", "t", "role", "h"]
        texts = self.texts.select(*keys, "text").dropDuplicates(keys)
        stay = F.filter(F.split("edits", ""), lambda e: e.isin("K", "R", "I"))
        each = edits.join(texts, keys).select("c", "role", "text", "start", "odd", F.posexplode(stay).alias("k", "edit"))
        place = F.col("start") + F.col("k")
        user = (place + F.col("odd").cast("int")) % 2 == 0
        return each.select("c", place.alias("place"), F.when(F.col("edit") == "K", F.col("role")).when(user, "user").otherwise("assistant").alias("role"),
                           F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of (c, place) -> each conversation's SHA-256; one line is held at a time."""
    at, sha = None, None
    for b in batches:
        done = []
        for c, role, text in zip(*(b.column(x).to_pylist() for x in ("c", "role", "text"))):
            if c != at:
                if at is not None:
                    done.append((at, sha.hexdigest()))
                at, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["c", "repaired_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sha.hexdigest()])], names=["c", "repaired_sha256"])


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """Every conv_id with the faults, the cost, the audit and the digest of its repair after the damage.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256); a conversation
    that lost all its rows has zeros, an empty audit and the digest of nothing."""
    repair = Repair(damaged(conversations))
    digests = (repair.rows().repartition("c").sortWithinPartitions("c", "place").select("c", "role", "text")
               .mapInArrow(_digests, "c string, repaired_sha256 string"))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    got = (ids.withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
           .join(repair.summary, "c", "left").join(digests, "c", "left"))
    numbers = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
