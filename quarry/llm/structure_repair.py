"""Cheapest structure repair of conversations by integer weights on a directed acyclic graph.

Rows of a conversation are kept, get another role, are deleted, or rows are inserted, until the initials of
the roles read ``(s?(ua)+)?``. Four states follow that pattern (nothing yet, after s, after u, after a); the
graph's nodes are (rows done, state). The weight of a path from a node to the end is one whole number: its
high digits are the cost, its low digits the audit letters of the path, a digit of three bits each, first letter
in the highest place, zero where the audit has ended (D 1, I 2, K 3, R 4, their ASCII order). Putting an edge
before a path adds its cost above and moves the letters down one place, so the smallest whole number at the first
node is the cheapest repair and, of equally cheap ones, that with the ASCII-least audit. Between two rows at
most one row is inserted: two would return to a state at least as good, or cost more than deleting a leading
system row.

Long conversations are split. Rows are range-partitioned by conversation and place, so that one with a third
of all rows lies in many tasks, and cut into segments of at most ``SEGMENT`` rows (``SEGMENT_CHARS`` of text).
A segment alone gives, for each state it may be entered in, the least weight per exit state and audit length
(paths of one length compare alike whatever follows; those dearer than the cheapest by more than ``SLACK``
can't win, as any state reaches what another does for that much). A conversation's segments, without their
texts, are then put together from the last to the first. The repaired text is hashed segment by segment
in a sorted stream. What a conversation needs in one place is its audit (which is a value of one result row), a
byte a row beside it, and the weights of its segments.

Defined results: order within a conversation is turn (nulls first), role, text; nulls in role and text are one
space, as they are in the key of the damage; rows with a null conversation id form one conversation; an
empty role fits no place; an empty table gives an empty result; other columns are ignored. Repeated rows are
duplicates of the first; rows are told apart by SHA-256 of role and text.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import written

SEGMENT, SEGMENT_CHARS = 128, 1 << 22
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SLACK = 5
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
BITS = 3
#: Classes of a row's role by its initial, and its fault.
CLASSES, FAULTS = "sua", ["", "blank", "duplicate", "truncated"]
#: State after a row of a class, and after a row that is given the role the state wants.
NEXT = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
WANTED = [2, 2, 3, 2]
ENDS = (0, 3)
LEGAL = {(0, 1), (1, 2), (2, 1)}
FIRST_TURN = -(1 << 63)
NOT_BLANK, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def damaged(messages: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Rows as the fixed damage leaves them: by the key's CRC-32 modulo 20 a row is dropped (0), emptied (1), loses its
    ends of sentences (2), comes twice (3) or becomes the user's (4)."""
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                           F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
                           (F.crc32(key) % 20).alias("_d")).where(F.col("_d") != 0)
    d = F.col("_d")
    rows = rows.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.sequence(F.lit(1), F.when(d == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


# ---- one conversation's symbols: a letter a row, for its class and fault

def symbol(cls: int, fault: int) -> str:
    return chr(65 + 4 * cls + fault)


def parts_of(sym: str) -> tuple:
    return divmod(ord(sym) - 65, 4)


def _before(letter: str, cost: int, values: dict, step: int, width: int) -> dict:
    """The paths ``values`` (by exit and length) with an edge put before them."""
    top, one = DIGITS[letter] << (width - BITS), 1 << width
    out = {}
    for (end, length), w in values.items():
        low = w & (one - 1)
        out[end, length + step] = w - low + cost * one + top + (low >> BITS)
    return out


def _least(*options: dict) -> dict:
    out: dict = {}
    for paths in options:
        for k, w in paths.items():
            if k not in out or w < out[k]:
                out[k] = w
    return out


@lru_cache(maxsize=20000)
def paths(symbols: str, last: bool) -> tuple:
    """For each state before the rows: ``{(exit, length): weight}``; with ``last`` only the least one, to the end."""
    width = BITS * (2 * len(symbols) + 1)
    step = 0 if last else 1

    def gap(values):
        return [_least(values[s], _before("I", INSERT, values[WANTED[s]], step, width)) for s in range(4)]

    values = [{(-1, 0): 0} if s in ENDS else {} for s in range(4)] if last else [{(s, 0): 0} for s in range(4)]
    values = gap(values) if last else values
    for sym in reversed(symbols):
        cls, fault = parts_of(sym)
        extra = TRUNCATED if FAULTS[fault] == "truncated" else 0
        new = []
        for s in range(4):
            options = [_before("D", DELETE, values[s], step, width)]
            if FAULTS[fault] not in ("blank", "duplicate"):
                options.append(_before("R", REROLE + extra, values[WANTED[s]], step, width))
                if cls in NEXT[s]:
                    options.append(_before("K", KEEP + extra, values[NEXT[s][cls]], step, width))
            new.append(_least(*options))
        values = gap(new)
        if not last:
            values = [{k: w for k, w in v.items() if w >> width <= (min(v.values()) >> width) + SLACK} for v in values]
    return tuple(values)


def letters(low: int, width: int) -> str:
    """The audit of a weight's low digits."""
    text = format(low, "o").rjust(width // BITS, "0") if width else ""
    return text.rstrip("0").translate(str.maketrans({str(d): c for c, d in DIGITS.items()}))


def digits(audit: str) -> int:
    return int(audit.translate(str.maketrans({c: str(d) for c, d in DIGITS.items()})) or "0", 8)


def segment_table(symbols: str) -> str:
    """Paths of a segment that isn't a whole conversation, as text: per entry state a list of exit, cost, audit."""
    width = BITS * (2 * len(symbols) + 1)
    return json.dumps([[[end, w >> width, letters(w & ((1 << width) - 1), width)] for (end, _), w in v.items()]
                       for v in paths(symbols, False)], separators=(",", ":"))


def cheapest(segments: list) -> tuple:
    """``(cost, audit)`` of a conversation from its segments' ``(symbols, table)``, first to last."""
    if len(segments) == 1:
        width = BITS * (2 * len(segments[0][0]) + 1)
        w = paths(segments[0][0], True)[0][-1, 0]
        return w >> width, letters(w & ((1 << width) - 1), width)
    width = BITS * (2 * sum(len(s) for s, _ in segments) + 1)
    one = 1 << width
    after: list = [0, None, (INSERT << width) + (DIGITS["I"] << (width - BITS)), 0]
    for symbols, table in reversed(segments):
        before: list = []
        for entries in json.loads(table or segment_table(symbols)):
            ways = [(cost + (after[end] >> width), end, cost, audit) for end, cost, audit in entries if after[end] is not None]
            least = min((w[0] for w in ways), default=None)
            found = None
            for total, end, cost, audit in ways:
                if total == least:  # the high digits decide already for the others
                    low = after[end] & (one - 1)
                    w = (total << width) + (digits(audit) << (width - BITS * len(audit))) + (low >> (BITS * len(audit)))
                    found = w if found is None or w < found else found
            before.append(found)
        after = before
    return after[0] >> width, letters(after[0] & (one - 1), width)


def walk(segments: list, audit: str):
    """Per segment the state it is entered in and its piece of the audit; insertions before a row go with it, those at the
    end with the last segment."""
    at, state = 0, 0
    for k, (symbols, _) in enumerate(segments):
        start, entry = at, state
        for sym in symbols:
            while audit[at] == "I":
                state, at = WANTED[state], at + 1
            if audit[at] == "K":
                state = NEXT[state][parts_of(sym)[0]]
            elif audit[at] == "R":
                state = WANTED[state]
            at += 1
        yield entry, audit[start:] if k + 1 == len(segments) else audit[start:at]


def repaired_lines(state: int, piece: str, symbols: str, roles: list, texts: list):
    """``role:text`` of a segment's repaired rows."""
    i = 0
    for letter in piece:
        if letter == "I":
            role, text = ("assistant" if state == 2 else "user"), ""
            state = WANTED[state]
        else:
            role, text, cls = roles[i], texts[i], parts_of(symbols[i])[0]
            i += 1
            if letter == "D":
                continue
            if letter == "R":
                role, state = ("assistant" if state == 2 else "user"), WANTED[state]
            else:
                state = NEXT[state][cls]
        yield f"{role}:{text}"


# ---- tasks

def _rows_of(batches, *cols):
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in cols))


def _batches(rows, schema, at_most=2048, chars=1 << 24):
    import pyarrow as pa
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if len(held) >= at_most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(schema):
    """Sorted rows of a partition to segments; a table of paths goes with each that may not be a whole conversation."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()

        def cuts():
            number, held, size, conv, edge = 0, [], 0, None, True

            def close(more):
                nonlocal number
                symbols = "".join(h[0] for h in held)
                row = {"conv_id": conv, "part": part, "seg": number, "symbols": symbols, "roles": [h[1] for h in held],
                       "texts": [h[2] for h in held], "paths": segment_table(symbols) if edge or more else None}
                number += 1
                return row, size + 200

            for cid, sym, role, text in _rows_of(batches, "conv_id", "sym", "role", "text"):
                if held and (cid != conv or len(held) >= SEGMENT or size >= SEGMENT_CHARS):
                    same = cid == conv
                    yield close(same)
                    held, size, edge = [], 0, same
                conv = cid
                held.append((sym, role, text))
                size += len(role) + len(text)
            if held:
                yield close(True)
        yield from _batches(cuts(), schema)
    return run


def _conversations(batches, *cols):
    """Runs of rows of one conversation in a sorted stream."""
    held, conv = [], None
    for row in _rows_of(batches, "conv_id", *cols):
        if held and row[0] != conv:
            yield conv, held
            held = []
        conv = row[0]
        held.append(row[1:])
    if held:
        yield conv, held


def _decide(schema):
    def run(batches):
        def rows():
            for conv, held in _conversations(batches, "part", "seg", "symbols", "paths"):
                segments = [(h[2], h[3]) for h in held]
                cost, audit = cheapest(segments)
                symbols = "".join(s for s, _ in segments)
                classes = [parts_of(s)[0] for s in symbols]
                faults = [symbols.count(symbol(c, f)) for f in (1, 2, 3) for c in range(4)]
                first = {"cost": cost, "audit": audit, "blank": sum(faults[:4]), "duplicate": sum(faults[4:8]), "truncated": sum(faults[8:]),
                         "illegal": sum(p not in LEGAL for p in zip(classes, classes[1:]))}
                for (part, seg, _, _), (entry, piece) in zip(held, walk(segments, audit)):
                    yield {"conv_id": conv, "part": part, "seg": seg, "entry": entry, "piece": piece} | first, 2 * len(piece)
                    first = dict.fromkeys(first)
        yield from _batches(rows(), schema)
    return run


def _hash(schema):
    def run(batches):
        def rows():
            conv, digest, lines = None, None, 0
            for cid, entry, piece, symbols, roles, texts in _rows_of(batches, "conv_id", "entry", "piece", "symbols", "roles", "texts"):
                if digest is None or cid != conv:
                    if digest is not None:
                        yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}, 100
                    conv, digest, lines = cid, hashlib.sha256(), 0
                for line in repaired_lines(entry, piece, symbols, roles, texts):
                    digest.update((("\n" if lines else "") + line).encode())
                    lines += 1
            if digest is not None:
                yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}, 100
        yield from _batches(rows(), schema)
    return run


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, part, seg, piece)`` tables of
    damaged ``(conv_id, turn, role, text)`` rows: a row per conversation that has rows."""
    cls = F.lit(len(CLASSES))
    for k, initial in enumerate(CLASSES):
        cls = F.when(F.substring("role", 1, 1) == initial, k).otherwise(cls)
    fault = F.when(~F.col("text").rlike(NOT_BLANK), 1).when(~F.col("text").rlike(ENDED), 3).otherwise(0)
    rows = rows.select("conv_id", "turn", "role", "text", F.coalesce("turn", F.lit(FIRST_TURN)).alias("t"), cls.alias("cls"), fault.alias("fault"),
                       F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("digest"),
                       F.monotonically_increasing_id().alias("uid"))
    rows = written(rows, "repair-rows")
    # A row is a duplicate unless it is the first of its conversation, role and text.
    firsts = (rows.where("fault <> 1").groupBy(F.col("conv_id").alias("_c"), F.col("digest").alias("_g"))
              .agg(F.min(F.struct("t", "uid")).alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    known = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_g")), "left")
    later = F.col("_first").isNotNull() & (F.col("fault") != 1) & ((F.col("_first.t") != F.col("t")) | (F.col("_first.uid") != F.col("uid")))
    sym = F.char(65 + 4 * F.col("cls") + F.when(later, 2).otherwise(F.col("fault")))
    order = ["conv_id", "t", "role", "text", "uid"]
    dealt = (known.select(*order, sym.alias("sym")).repartitionByRange(*order).sortWithinPartitions(*order)
             .select("conv_id", "sym", "role", "text"))
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    place = [conv, T.StructField("part", T.IntegerType()), T.StructField("seg", T.LongType())]
    cut = T.StructType([*place, T.StructField("symbols", T.StringType()), T.StructField("roles", T.ArrayType(T.StringType())),
                        T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("paths", T.StringType())])
    segments = written(dealt.mapInArrow(_cut(_arrow(cut)), cut), "repair-segments")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    decided = T.StructType([*place, T.StructField("entry", T.IntegerType()), T.StructField("piece", T.StringType()),
                            *[T.StructField(c, T.LongType()) for c in counts], T.StructField("audit", T.StringType())])
    pieces = (segments.select("conv_id", "part", "seg", "symbols", "paths").repartition("conv_id")
              .sortWithinPartitions("conv_id", "part", "seg").mapInArrow(_decide(_arrow(decided)), decided))
    pieces = written(pieces, "repair-pieces")
    hashed = T.StructType([conv, T.StructField("repaired_sha256", T.StringType())])
    hashes = (segments.select("part", "seg", "conv_id", "symbols", "roles", "texts").join(pieces.select("part", "seg", "entry", "piece"), ["part", "seg"])
              .repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
              .select("conv_id", "entry", "piece", "symbols", "roles", "texts").mapInArrow(_hash(_arrow(hashed)), hashed))
    gaps = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    found = pieces.where(F.col("audit").isNotNull()).select("conv_id", *counts, "audit")
    return _one_row_each([gaps, found, hashes], ["gaps", *counts, "audit", "repaired_sha256"])


def _one_row_each(frames: list, cols: list) -> DataFrame:
    """The frames' columns by conversation, each of which one frame has."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in cols])


def structure_repair(messages: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Damage, faults, cheapest edits and the repaired text's hash for every conversation of ``messages``."""
    found = repair(damaged(messages, conv_col, turn_col, role_col, text_col))
    every = messages.groupBy(F.col(conv_col).alias("conv_id")).agg(F.lit(None).cast("long").alias("gaps"))
    cols = [c for c in found.columns if c != "conv_id"]
    out = _one_row_each([every, found], cols)
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return out.select("conv_id", *[F.coalesce(F.col(c), nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in cols])


def oracle_sql() -> str:
    """DuckDB SQL of :func:`structure_repair` over ``conversations``."""
    def put(letter, cost, v):
        return f"lpad(CAST(CAST(left({v}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || '{letter}' || substr({v}, 9)"

    def row(s):
        keep = " ".join(f"WHEN '{CLASSES[c]}' THEN {put('K', '(CASE WHEN fault = 3 THEN 1 ELSE 0 END)', f'v{t}')}" for c, t in NEXT[s].items())
        rerole = put("R", f"({REROLE} + CASE WHEN fault = 3 THEN 1 ELSE 0 END)", f"v{WANTED[s]}")
        return (f"least({put('D', DELETE, f'v{s}')}, CASE WHEN fault IN (0, 3) THEN {rerole} END, "
                f"CASE WHEN fault IN (0, 3) THEN CASE left(role, 1) {keep} END END)")

    def gap(s):
        return f"least(r{s}, {put('I', INSERT, f'r{WANTED[s]}')})"

    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (SELECT m.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM m, crc),
r AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, (SELECT unnest([1, 2]) AS c) WHERE d <> 0 AND (c = 1 OR d = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{NOT_BLANK}') THEN 1
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(text, '{ENDED}') THEN 3 ELSE 0 END AS fault FROM n),
l AS (SELECT *, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS place FROM f),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (place > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY conv_id),
v AS (SELECT conv_id, n AS i, '00000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '0000000{INSERT}I' AS v2, '00000000' AS v3 FROM g
  UNION ALL
  SELECT conv_id, i, {', '.join(f'{gap(s)} AS v{s}' for s in range(4))} FROM (
    SELECT v.conv_id, v.i - 1 AS i, {', '.join(f'{row(s)} AS r{s}' for s in range(4))}
    FROM v JOIN f ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND v.i = f.i)),
b AS (SELECT conv_id, CAST(left(v0, 8) AS BIGINT) AS cost, substr(v0, 9) AS audit FROM v WHERE i = 0),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS a, unnest(range(1, length(audit) + 1)) AS p FROM b WHERE audit <> ''),
w AS (SELECT *, count(*) FILTER (a <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM e),
x AS (SELECT w.conv_id, a, p, role, text, a = 'K' AND left(role, 1) = 's' AS s
  FROM w LEFT JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i AND a <> 'I' WHERE a <> 'D'),
y AS (SELECT *, CASE WHEN count(*) FILTER (NOT s) OVER (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 = 0
    THEN 'user' ELSE 'assistant' END AS given FROM x),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN a = 'K' THEN role ELSE given END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS sha FROM y GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN h ON c.conv_id IS NOT DISTINCT FROM h.conv_id"""
