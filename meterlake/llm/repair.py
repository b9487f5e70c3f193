"""Conversations repaired to an optional system turn and pairs of user and assistant.

Forward Viterbi over four grammar states (nothing yet, after s, after u, after
a). A turn's layer holds for each state the cheapest (cost, audit string) that
reaches it by consuming that turn, and is closed by inserted turns, two at most.

The audit strings are not carried as such: a state keeps its rank among the
layer's strings and one byte of where it came from, so that a conversation costs
its length, not the square. Two strings of one layer that both end with a
consumed turn are never one another's beginning; hence ranks and the letters
since then order them. The hash of the repaired text travels with each state.

A conversation is read as a stream in order of its turns and never gathered: a
task holds four hashes and four bytes a turn. The digest of the whole repaired
text can only be computed in order, by one task for each conversation; what
needs other turns (repeated ones) is found before by a grouped minimum that any
number of tasks share.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, whole

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after a system, user, assistant turn.
START, S, U, A = range(4)
NAMES = {U: "user", A: "assistant"}
#: The state that a role's initial leads to, for each state that allows it.
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
#: The only state that an inserted or reroled turn leads to.
FORCED = {START: U, S: U, U: A, A: U}
LEGAL = {"su", "ua", "au"}
_LETTERS = "DIKR"


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as damaged by the checksum of `conv_id:turn`; nulls count as one space, in role and text they become one."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.crc32(key) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace(text, r"[.!?]", "")).otherwise(text)
    role = F.when(F.col("hit") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    kept = rows.select("conv_id", "turn", "role", "text", hit.alias("hit")).where("hit <> 0")
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256))


class Repair:
    """One conversation, fed turn by turn."""

    def __init__(self) -> None:
        self.base: list[tuple | None] = [(0, 0, hashlib.sha256(), False), None, None, None]  # of a state: cost, rank, hash of the repaired text, whether there is any
        self.came = bytearray()  # four bytes a layer: state of the layer before, inserted turns, letter
        self._close()

    def _close(self) -> None:
        """closed[state]: (cost, rank, letters inserted, state of the layer)."""
        closed: list[tuple | None] = [None if b is None else (b[0], b[1], 0, s) for s, b in enumerate(self.base)]
        for _ in range(2):
            for s in range(4):
                if closed[s] is not None:
                    cost, rank, n, at = closed[s]
                    t = FORCED[s]
                    if n < 2 and (closed[t] is None or (cost + INSERT, rank, n + 1) < closed[t][:3]):
                        closed[t] = (cost + INSERT, rank, n + 1, at)
        self.closed = closed

    def _text(self, entry: tuple) -> tuple:
        """The hash of an entry's repaired text, and whether there is any, with its inserted turns."""
        _, _, n, at = entry
        _, _, digest, some = self.base[at]
        if n:
            digest = digest.copy()
            for _ in range(n):
                at = FORCED[at]
                digest.update(f"{chr(10) if some else ''}{NAMES[at]}:".encode())
                some = True
        return digest, some

    def turn(self, role: str, text: str, fault: str) -> None:
        best: list[tuple | None] = [None] * 4
        extra = TRUNCATED if fault == "truncated" else 0
        for s, entry in enumerate(self.closed):
            if entry is None:
                continue
            cost, rank, n, _ = entry
            ways = [(DELETE, "D", s)]
            if fault not in ("blank", "duplicate"):
                ways.append((REROLE + extra, "R", FORCED[s]))
                t = NEXT[s].get(role[:1])
                if t is not None:
                    ways.append((KEEP + extra, "K", t))
            for c, letter, t in ways:
                way = (cost + c, rank, "I" * n + letter, s)
                if best[t] is None or way < best[t]:
                    best[t] = way
        base: list[tuple | None] = [None] * 4
        layer = bytearray(4)
        order = sorted({b[1:3] for b in best if b is not None})
        for t, way in enumerate(best):
            if way is None:
                continue
            cost, rank, letters, s = way
            digest, some = self._text(self.closed[s])
            if letters[-1] != "D":
                digest = digest.copy()
                digest.update(f"{chr(10) if some else ''}{role if letters[-1] == 'K' else NAMES[t]}:".encode())
                digest.update(text.encode("utf-8", "surrogatepass"))
                some = True
            base[t] = (cost, order.index((rank, letters)), digest, some)
            layer[t] = self.closed[s][3] << 4 | self.closed[s][2] << 2 | _LETTERS.index(letters[-1])
        self.came += layer
        self.base = base
        self._close()

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired text) of the cheapest repair."""
        entry = min((self.closed[s] for s in (START, A) if self.closed[s] is not None), key=lambda e: e[:3])
        cost, _, n, at = entry
        back = ["I" * n]
        for i in range(len(self.came) - 4, -1, -4):
            byte = self.came[i + at]
            back += [_LETTERS[byte & 3], "I" * (byte >> 2 & 3)]
            at = byte >> 4
        return cost, "".join(reversed(back)), self._text(entry)[0].hexdigest()


_FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


class _Conversation:
    def __init__(self, conv_id: pa.Scalar) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.before: tuple | None = None

    def feed(self, turn, role: str, text: str, digest: bytes, fault: str, repeated: bool, earliest: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.before is not None and self.before[0] + role[:1] not in LEGAL:
            self.illegal += 1
        # Rows of one turn, role and text follow each other.
        again = repeated and not (earliest and (self.before is None or self.before[1:] != (turn, digest)))
        if fault != "blank" and again:
            fault = "duplicate"
        self.faults[fault] += 1
        self.before = (role[:1], turn, digest)
        self.repair.turn(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, *self.repair.end())


def _repaired(batches):
    """Rows sorted by conversation and turn to one row for each conversation."""
    now, done, kind = None, [], None

    def out() -> pa.RecordBatch:
        columns = [pa.array([c.as_py() for c, _ in done], kind), *[pa.array([r[i] for _, r in done], pa.int64() if i < 6 else pa.string()) for i in range(len(_FIELDS))]]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *_FIELDS])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids, rows = part.column("conv_id"), zip(*[part.column(c).to_pylist() for c in ("turn", "role", "text", "digest", "fault", "repeated", "earliest")], strict=True)
            for conv_id, row in zip(ids, rows, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append((now.conv_id, now.row()))
                    now = _Conversation(conv_id)
                now.feed(*row)
        if sum(len(r[6]) for _, r in done) > 1 << 20 or len(done) > 5000:
            yield out()
    if now is not None:
        done.append((now.conv_id, now.row()))
        yield out()


@whole
def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of conversations (conv_id, turn, role, text), after their damage.

    Turns are whole numbers; rows of one turn are taken by role, then text. A
    null conv_id is a conversation too. A role counts by its first letter, as
    written; one that is no s, u or a, or empty, can only be reroled or deleted.
    Repeated rows are repeated turns. An empty table gives an empty one; other
    columns are ignored, whatever their names.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    fault = F.when(~F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), "blank").when(~F.regexp_like("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), "truncated").otherwise("")
    turns = damaged(rows).select("conv_id", "turn", "role", "text", _digest().alias("digest"), fault.alias("fault"))
    # Turns of a conversation with one role and text: the earliest stands. Only those that occur again are kept.
    again = turns.groupBy("conv_id", "digest").agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("undated"), F.min("turn").alias("least")).where("n > 1")
    again = staged(again.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.when(~F.col("undated"), F.col("least")).alias("least")), "again")
    marked = turns.join(again, turns["conv_id"].eqNullSafe(again["c"]) & (turns["digest"] == again["d"]), "left")
    marked = marked.select("conv_id", "turn", "role", "text", "digest", "fault", F.col("d").isNotNull().alias("repeated"), F.col("turn").eqNullSafe(F.col("least")).alias("earliest"))
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(c, T.LongType() if i < 6 else T.StringType()) for i, c in enumerate(_FIELDS)]])
    found = ordered.mapInArrow(_repaired, schema)
    every = rows.select("conv_id").distinct()
    got = every.join(found.withColumnRenamed("conv_id", "c"), every["conv_id"].eqNullSafe(F.col("c")), "left").drop("c")
    empty = {**dict.fromkeys(_FIELDS[:6], 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return got.fillna(empty).select("conv_id", *_FIELDS)


def _repair_sql() -> str:
    crc = "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({k}, ''), lambda c: ascii(c)::ubigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: i::ubigint)), lambda x, i: if(x & 1 = 1, xor(x >> 1, 3988292384::ubigint), x >> 1))), 4294967295::ubigint)"
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"

    def way(state: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{state}.t" if line is None else f"if({state}.t is null, '', {state}.t || chr(10)) || {line}"
        return f"if({state} is not null, {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}}, null)"

    def reach(state: str, target: str) -> list[str]:
        rerole = f"if(fault not in ('blank', 'duplicate'), {way(state, '1 + extra', 'R', f"'{NAMES[U] if target == 'u' else NAMES[A]}:' || text")}, null)"
        return [rerole, f"if(fault not in ('blank', 'duplicate') and left(role, 1) = '{target}', {way(state, 'extra', 'K', "role || ':' || text")}, null)"]

    def least(ways: list[str]) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda x: x is not null))"

    u = least([way("z.u", "2", "D"), *reach("z.n", "u"), *reach("z.s", "u"), *reach("z.a", "u")])
    a = least([way("z.a", "2", "D"), *reach("z.u", "a")])
    s = least([way("z.s", "2", "D"), f"if(fault not in ('blank', 'duplicate') and left(role, 1) = 's', {way('z.n', 'extra', 'K', "role || ':' || text")}, null)"])
    closed_u = least(["y.u", *[way(f"y.{x}", "5", "I", "'user:'") for x in "nsa"]])
    closed_a = least(["x.a", way("x.u", "5", "I", "'assistant:'")])
    kind = "struct(c bigint, a varchar, t varchar)"
    return f"""with recursive source as (
  select *, coalesce(role, ' ') as r, coalesce(text, ' ') as b, {crc.format(k=key)} % 20 as hit from conversations),
damaged as (
  select conv_id, turn, if(hit = 4, 'user', r) as role, case hit when 1 then '' when 2 then regexp_replace(b, '[.!?]', '', 'g') else b end as text, unnest(if(hit = 3, [1, 2], [1])) as copy from source where hit <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n from damaged),
judged as materialized (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault,
    left(lag(role) over (partition by conv_id order by n), 1) || left(role, 1) as pair from placed),
facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, max(n) as size from judged group by conv_id),
steps as (
  select conv_id, 0 as n, {{'n': {{'c': 0, 'a': '', 't': null}}::{kind}, 's': null::{kind}, 'u': {{'c': 5, 'a': 'I', 't': 'user:'}}::{kind}, 'a': {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}}::{kind}}} as z from facts
  union all
  select conv_id, n, {{'n': x.n, 's': x.s, 'u': x.u, 'a': {closed_a}}} from (
    select conv_id, n, {{'n': y.n, 's': y.s, 'u': {closed_u}, 'a': y.a}} as x from (
      select w.conv_id, j.n, {{'n': {way("z.n", "2", "D")}, 's': {s}, 'u': {u}, 'a': {a}}} as y from (select conv_id, n + 1 as n, z from steps) as w join (select *, if(fault = 'truncated', 5, 0) as extra from judged) j on j.n = w.n and j.conv_id is not distinct from w.conv_id))),
ends as (
  select f.*, {least(["z.n", "z.a"])} as best from facts f join steps on f.conv_id is not distinct from steps.conv_id and f.size = steps.n)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(best.t, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join ends on o.conv_id is not distinct from ends.conv_id"""


REPAIR_SQL = _repair_sql()
