"""Cheapest repairs of conversations by a weighted automaton that is determinised as it is used."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import cut_lineage, owned

#: ASCII blanks; a text of these alone is blank.
BLANK = " \t\n\x0b\x0c\r"
#: Costs of the edits.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: States of the form ``(s?(ua)+)?``: at its start, after s, after u, after a.  The first and last may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
#: Where a turn of the initial leads from each state, None if it may not stand there.
NEXT = {
    "s": (AFTER_S, None, None, None),
    "u": (AFTER_U, AFTER_U, None, AFTER_U),
    "a": (None, None, AFTER_A, None),
}
#: The turn that an insertion or a new role makes in each state.
MADE = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
#: Symbol of a row: initial (s, u, a, other) * 2 + truncated, or 8 where the row has to go.
GONE = 8

Costs = tuple[int, ...]


class Automaton:
    """Costs to go as states of a deterministic automaton, read from the last row to the first.

    A state is the vector of the least costs to repair all rows that follow, from each state of the form, less
    its least element; what was taken off is the weight of the transition.  Vectors and transitions
    are made when first met and kept in a table, so that a row costs one lookup.
    """

    def __init__(self) -> None:
        self.vectors: list[Costs] = []
        self.numbers: dict[Costs, int] = {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, self.base = self._number(self._closed([0 if s in ENDS else 1 << 30 for s in range(4)]))

    def _number(self, costs: Costs) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    @staticmethod
    def _closed(costs: list[int]) -> Costs:
        """With insertions wherever they are cheaper."""
        for _ in range(4):
            costs = [min(c, INSERT + costs[NEXT[MADE[s]][s]]) for s, c in enumerate(costs)]
        return tuple(costs)

    @staticmethod
    def arcs(symbol: int, state: int) -> list[tuple[str, int, int]]:
        """(edit, cost, next state) of the edits of a row, by edit in ASCII order."""
        found = [("D", DELETE, state)]
        if symbol != GONE:
            left = LEFT_TRUNCATED if symbol % 2 else 0
            initial = "sua-"[symbol // 2]
            to = NEXT[initial][state] if initial in NEXT else None
            if to is not None:
                found.append(("K", left, to))
            found.append(("R", REROLE + left, NEXT[MADE[state]][state]))
        return found

    def _step(self, after: int, symbol: int) -> Costs:
        to_go = self.vectors[after]
        return self._closed([min(cost + to_go[to] for _, cost, to in self.arcs(symbol, s)) for s in range(4)])

    def scan(self, symbols: bytes) -> tuple[int, list[int]]:
        """The least cost, and the number of the vector before each row and at the end."""
        at, total, table = self.end, self.base, self.table
        path = [at] * (len(symbols) + 1)
        for i in range(len(symbols) - 1, -1, -1):
            key = (at, symbols[i])
            if key not in table:
                table[key] = self._number(self._step(*key))
            at, weight = table[key]
            total += weight
            path[i] = at
        return total + self.vectors[at][START], path

    def _tight(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """The ASCII-least edits along tight arcs up to and with that of a row, and the state after them."""
        to_go, here, edits = self.vectors[after], self._step(after, symbol), ""
        while True:
            cost = {edit: (c + to_go[to], to) for edit, c, to in self.arcs(symbol, state)}
            inserted = NEXT[MADE[state]][state]
            cost["I"] = (INSERT + here[inserted], inserted)
            edit = min(e for e, (c, _) in cost.items() if c == here[state])
            edits, state = edits + edit, cost[edit][1]
            if edit != "I":
                return edits, state

    def trace(self, symbols: bytes, path: list[int]) -> str:
        """The ASCII-least audit of the least cost: back along the scan, from the first row on, by arcs that are tight.

        Edits of one letter lead from a state to one state, so that the least letter is right at every place.
        """
        state, out, traced = START, [], self.traced
        for i, symbol in enumerate(symbols):
            key = (path[i + 1], symbol, state)
            if key not in traced:
                traced[key] = self._tight(*key)
            edits, state = traced[key]
            out.append(edits)
        while state not in ENDS:
            out.append("I")
            state = NEXT[MADE[state]][state]
        return "".join(out)


class Repaired:
    """The state of the form while an audit is applied, letter by letter."""

    def __init__(self) -> None:
        self.state = START

    def role(self, edit: str, role: str | None) -> str:
        """The role that K, R or I leaves; ``role`` is that of the row."""
        initial = role[0] if edit == "K" else MADE[self.state]
        self.state = NEXT[initial][self.state]
        return role if edit == "K" else ROLE[initial]


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id long, place long, edit string, turn long, role string, text string"


def _rows(turns: DataFrame) -> DataFrame:
    """Rows with what faults and order depend on.  Nulls of role and text are one space."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    end = F.rtrim("text", F.lit(BLANK))
    return rows.withColumns(
        {
            "digest": F.unhex(F.sha2("text", 256)),
            "blank": end == "",
            "cut": ~F.right(end, F.lit(1)).isin(".", "!", "?"),
        }
    )


def _by_conversation(
    rows: DataFrame, order: list, begin: Callable, schema: str
) -> DataFrame:
    """Rows of each conversation, one after the other in ``order``, given to an object of ``begin(conv_id)``.

    Its ``add(row)`` and ``end()`` yield output rows; rows are streamed, so that the object decides what is held.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, held = None, [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

        for part in batches:
            columns = [part.column(i).to_pylist() for i in range(part.num_columns)]
            for conv, *row in zip(*columns):
                if now is None or now.conv != conv:
                    if now is not None:
                        out += now.end()
                    now = begin(conv)
                for made in now.add(*row):
                    out.append(made)
                    held += sum(len(v) for v in made if isinstance(v, str))
                if len(out) >= 10_000 or held >= 4 << 20:
                    yield batch()
                    out, held = [], 0
        if now is not None:
            out += now.end()
        if out:
            yield batch()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


class _Report:
    """Counts, symbols and the audit of one conversation: a byte a row, and the hashes of its texts."""

    machine: Automaton | None = None

    def __init__(self, conv: int | None):
        self.conv, self.symbols, self.seen = conv, bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.last = self.initial = None

    def add(self, kept: bool, turn: int | None, role: str, digest: bytes, blank: bool, cut: bool) -> tuple:
        if not kept:
            return ()
        if turn is not None and turn != self.last:  # rows come by turn
            self.least = turn if self.least is None else self.least
            self.most = self.last = turn
            self.turns += 1
        again = (role, digest) in self.seen
        self.seen.add((role, digest))
        self.blank += blank
        self.duplicate += again and not blank
        truncated = cut and not blank and not again
        self.truncated += truncated
        initial = role[:1]
        if self.symbols:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        kind = "sua".find(initial) if initial else 3
        self.symbols.append(GONE if blank or again else 2 * (kind if kind >= 0 else 3) + truncated)
        return ()

    def end(self) -> list[tuple]:
        if _Report.machine is None:
            _Report.machine = Automaton()
        symbols = bytes(self.symbols)
        cost, path = _Report.machine.scan(symbols)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        audit = _Report.machine.trace(symbols, path)
        return [(self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)]


def reports(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """What is wrong with each conversation of ``turns`` (conv_id, turn, role, text), and its cheapest repair.

    Rows come by turn, nulls first, those of one turn by role and then by the hash of the text.  A row's first fault counts:
    ``blank``, ``duplicate`` (role and text of an earlier row), ``truncated`` (the last character
    that is no blank is none of ``.!?``).  ``illegal`` counts neighbours whose role initials are not
    su, ua or au, ``gaps`` the turns missing between the least and the greatest.

    Edits: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty text) 5, and a
    truncated row that stays 5 more; blank and duplicate rows have to go.  ``cost`` is the least
    with which the role initials become ``(s?(ua)+)?``, ``audit`` the initials of such edits in
    order, of equally cheap ones the ASCII-least (see :class:`Automaton`).

    Conversations of ``every`` (conv_id) that have no rows get zeros and an empty audit.  Nulls of
    role and text count as a space, a null conv_id as a conversation; repeated rows are duplicates;
    extra columns are ignored; empty tables give no rows.  Texts are not shuffled, only their
    hashes; a conversation's rows go through one task, which holds a byte a row and those hashes.
    """
    rows = _rows(turns).select("conv_id", F.lit(True).alias("kept"), "turn", "role", "digest", "blank", "cut")
    if every is not None:
        more = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        none = [F.lit(False).alias("kept"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                F.lit(None).cast("binary").alias("digest"), F.lit(False).alias("blank"), F.lit(False).alias("cut")]
        rows = rows.unionByName(more.select("conv_id", *none))
    return _by_conversation(rows, [F.col("turn").asc_nulls_first(), "role", "digest"], _Report, REPORT)


class _Apply:
    """Applies an audit, which comes before the rows, to the rows as they pass."""

    def __init__(self, conv: int | None):
        self.conv, self.audit, self.at, self.place, self.form = conv, "", 0, 0, Repaired()

    def _made(self, edit: str, turn: int | None, role: str | None, text: str) -> tuple:
        self.place += 1
        return (self.conv, self.place - 1, edit, turn, self.form.role(edit, role), text)

    def _inserted(self) -> list[tuple]:
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            out.append(self._made("I", None, None, ""))
        return out

    def add(self, audit: str | None, turn: int | None, role: str, text: str, _digest: bytes | None) -> list[tuple]:
        if audit is not None:
            self.audit = audit
            return []
        out = self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            out.append(self._made(edit, turn, role, text))
        return out

    def end(self) -> list[tuple]:
        return self._inserted()


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns that the audits of ``found`` (of :func:`reports` on the same ``turns``) leave.

    conv_id, place from 0, edit (K, R or I), turn (null if inserted), role, text.  The rows of a
    conversation come one after the other, in order, from one task, through which they are streamed.
    """
    rows = _rows(turns).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "digest")
    none = F.lit(None)
    audits = found.filter("audit <> ''").select(
        "conv_id", "audit", none.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), none.cast("binary").alias("digest")
    )
    order = [F.col("audit").desc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "digest"]
    both = audits.unionByName(rows)
    return _by_conversation(both, order, _Apply, TURNS)


def hashes(rows: DataFrame) -> DataFrame:
    """conv_id and sha256 of the ``role:text`` of its rows, joined by line breaks, for rows in the order of :func:`repaired`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, sha = None, False, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not begun or conv != now:
                    if begun:
                        done.append((now, sha.hexdigest()))
                    now, begun, sha = conv, True, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield _pairs(done)
        if begun:
            yield _pairs([(now, sha.hexdigest())])

    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, sha256 string")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["conv_id", "sha256"])


@owned
def repair_digests(turns: DataFrame, every: DataFrame) -> DataFrame:
    """:func:`reports` with ``repaired_sha256``, the hash of the repaired turns (that of nothing where none is left)."""
    found = cut_lineage(reports(turns, every))
    sums = hashes(repaired(turns, found)).withColumnRenamed("conv_id", "of")
    nothing = hashlib.sha256(b"").hexdigest()
    joined = found.join(sums, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("repaired_sha256", F.coalesce("sha256", F.lit(nothing))).drop("sha256")


def _oracle() -> str:
    """DuckDB SQL for the query: costs and audits to go as strings, whose order is by cost, then by audit."""

    def add(key: str, cost: str, edit: str) -> str:
        return f"(lpad(CAST(CAST(substr({key}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{edit}' || substr({key}, 10))"

    def row(state: int) -> str:
        options = [add(f"k{state}", str(DELETE), "D")]
        for initial, to in NEXT.items():
            if to[state] is not None:
                options.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(f'k{to[state]}', f'{LEFT_TRUNCATED} * cut', 'K')} END")
        to = NEXT[MADE[state]][state]
        options.append(f"CASE WHEN NOT gone THEN {add(f'k{to}', f'{REROLE} + {LEFT_TRUNCATED} * cut', 'R')} END")
        return f"least({', '.join(options)}) AS b{state}"

    def closed(state: int) -> str:
        one = NEXT[MADE[state]][state]
        two = NEXT[MADE[one]][one]
        return f"least(b{state}, {add(f'b{one}', str(INSERT), 'I')}, {add(add(f'b{two}', str(INSERT), 'I'), str(INSERT), 'I')}) AS k{state}"

    edits, closes = ", ".join(row(s) for s in range(4)), ", ".join(closed(s) for s in range(4))
    return rf"""
WITH RECURSIVE bits AS (
  SELECT n, 0 AS k, n AS v FROM range(256) r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), bytes AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), hashed AS (
  SELECT given.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, CAST(i AS INTEGER), 1)) AS BIGINT))),
                                  lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295) % 20 AS damage
  FROM given, bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) copies(c) WHERE damage <> 0 AND (c = 0 OR damage = 3)
), placed AS (
  SELECT *, left(role, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM damaged
), faults AS (
  SELECT *, final = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
), marked AS (
  SELECT *, blank OR again AS gone, CAST(NOT blank AND NOT again AND final NOT IN ('.', '!', '?') AS INTEGER) AS cut FROM faults
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), togo AS (
  SELECT conv_id, n AS i, '000000000' AS k0, '000000010II' AS k1, '000000005I' AS k2, '000000000' AS k3 FROM counted
  UNION ALL
  SELECT conv_id, i, {closes} FROM (
    SELECT m.conv_id, m.i - 1 AS i, {edits} FROM togo g JOIN marked m ON m.conv_id IS NOT DISTINCT FROM g.conv_id AND m.i = g.i
  )
), audits AS (SELECT conv_id, CAST(substr(k0, 1, 9) AS BIGINT) AS cost, substr(k0, 10) AS audit FROM togo WHERE i = 0
), letters AS (
  SELECT conv_id, j, substr(audit, CAST(j AS INTEGER), 1) AS edit FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS j FROM audits)
), aimed AS (
  SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM letters
), left_ AS (
  SELECT a.*, m.role, CASE WHEN edit = 'I' THEN '' ELSE m.text END AS text, edit = 'K' AND m.initial = 's' AS system,
         row_number() OVER (PARTITION BY a.conv_id ORDER BY j) AS e
  FROM aimed a LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM a.conv_id AND m.i = a.i WHERE edit <> 'D'
), roled AS (
  SELECT *, CASE WHEN edit = 'K' THEN role WHEN (e - 1 - max(CAST(system AS INTEGER)) OVER (PARTITION BY conv_id)) % 2 = 0 THEN 'user' ELSE 'assistant' END AS made
  FROM left_
), hashes AS (SELECT conv_id, sha256(string_agg(made || ':' || text, chr(10) ORDER BY j)) AS sha FROM roled GROUP BY conv_id
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM every e
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
