"""Conversations of any layout as canonical turns, and turns as one text with a loss mask."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import free_names

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How records of one schema become turns.

    ``turns`` lists where turns come from: ("each", path, role field, text field) for an array with
    an object a turn, or ("one", role, paths) for a turn whose text is that of the paths, joined by an
    empty line, left out where none has a value.  Fields in ``optional`` may be missing.  ``roles``
    renames roles.
    """

    name: str
    turns: tuple[tuple, ...]
    optional: frozenset[str] = frozenset()
    roles: tuple[tuple[str, str], ...] = ()

    def fields(self) -> set[str]:
        """Paths of the fields that the layout reads."""
        found: set[str] = set()
        for kind, first, *rest in self.turns:
            found |= {f"{first}[].{field}" for field in rest} if kind == "each" else set(rest[0])
        return found

    def path_sets(self) -> list[frozenset[str]]:
        """Every set of paths that a record of the layout can have."""
        needed = self.fields() - self.optional
        spare = sorted(self.optional & self.fields())
        found = [frozenset(needed | set(some)) for n in range(len(spare) + 1) for some in combinations(spare, n)]
        lists = {f"{path}[]" for kind, path, *_ in self.turns if kind == "each"}
        if lists:  # an array without turns has no fields
            outer = {f for f in needed if "[]" not in f}
            found += [frozenset(outer | lists | set(some)) for n in range(len(spare) + 1) for some in combinations(spare, n) if not any("[]" in f for f in some)]
        return found


PEOPLE = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Layouts in common use.  A caller may give more or others.
LAYOUTS = (
    Layout("messages", (("one", "system", ("system",)), ("each", "messages", "role", "content")), frozenset({"system", "messages[].content"})),
    Layout("nested messages", (("each", "data.messages", "role", "content"),), frozenset({"data.messages[].content"})),
    Layout("conversations", (("one", "system", ("system",)), ("each", "conversations", "from", "value")), frozenset({"system", "conversations[].value"}), PEOPLE),
    Layout("dialogue", (("each", "dialogue", "speaker", "text"),), frozenset({"dialogue[].text"}), PEOPLE),
    Layout("turns", (("each", "turns", "role", "text"),), frozenset({"turns[].text"}), PEOPLE),
    Layout("prompt and completion", (("one", "system", ("system",)), ("one", "user", ("prompt",)), ("one", "assistant", ("completion",))), frozenset({"system"})),
    Layout("prompt and response", (("one", "system", ("system",)), ("one", "user", ("prompt",)), ("one", "assistant", ("response",))), frozenset({"system"})),
    Layout("question and answer", (("one", "user", ("context", "question")), ("one", "assistant", ("answer",))), frozenset({"context"})),
    Layout("instruction", (("one", "system", ("system",)), ("one", "user", ("instruction", "input")), ("one", "assistant", ("output",))), frozenset({"input", "system"})),
    Layout("instruction and response", (("one", "user", ("instruction", "context")), ("one", "assistant", ("response",))), frozenset({"context"})),
)


def fingerprint_of(paths: Iterable[str]) -> str:
    """The hash of a set of field paths."""
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: Column) -> Column:
    """Paths of the scalar fields that a variant's schema names, as ``a.b`` and ``list[].c``, and of arrays without elements.

    Tokens of the schema are folded with a stack of the paths of the open objects and arrays.
    """
    tokens = F.regexp_extract_all(schema, F.lit("(`(?:[^`]|``)*`: |[A-Za-z0-9_]+: |OBJECT<|ARRAY<VOID>|ARRAY<|>)"), F.lit(1))
    strings = "array<string>"
    start = F.struct(
        F.array().cast(strings).alias("open"), F.lit("").alias("now"), F.array().cast(strings).alias("found")
    )

    def step(at: Column, token: Column) -> Column:
        top = F.coalesce(F.try_element_at(at["open"], F.lit(-1)), F.lit(""))
        name = F.regexp_replace(F.regexp_replace(token, ": $", ""), "^`|`$", "")
        named = F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))
        listed = F.concat(at["now"], F.lit("[]"))
        outer = F.array_remove(at["found"], at["now"])

        def state(open_: Column, now: Column, found: Column) -> Column:
            return F.struct(open_.alias("open"), now.alias("now"), found.alias("found"))

        return (
            F.when(token == "OBJECT<", state(F.array_append(at["open"], at["now"]), at["now"], outer))
            .when(token == "ARRAY<VOID>", state(at["open"], at["now"], F.array_append(outer, listed)))
            .when(token == "ARRAY<", state(F.array_append(at["open"], listed), listed, outer))
            .when(token == ">", state(F.slice(at["open"], 1, F.greatest(F.size(at["open"]) - 1, F.lit(0))), top, at["found"]))
            .otherwise(state(at["open"], named, F.array_append(at["found"], named)))
        )

    return F.aggregate(tokens, start, step, lambda at: F.array_distinct(at["found"]))


def _texts(record: Column, layout: Layout) -> Column:
    parts = []
    for kind, first, *rest in layout.turns:
        if kind == "each":
            role, text = rest
            rows = F.try_variant_get(record, f"$.{first}", f"array<struct<`{role}`:string,`{text}`:string>>")
            renamed = lambda r: F.coalesce(*(F.when(r == old, new) for old, new in layout.roles), r, F.lit("")) if layout.roles else F.coalesce(r, F.lit(""))
            parts.append(
                F.transform(rows, lambda t: F.struct(renamed(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
            )
        else:
            values = F.array(*(F.try_variant_get(record, f"$.{path}", "string") for path in rest[0]))
            given = F.filter(values, lambda v: v.isNotNull())
            if len(rest[0]) > 1:
                given = F.filter(given, lambda v: v != "")
            turn = F.struct(F.lit(first).alias("role"), F.array_join(given, "\n\n").alias("text"))
            needed = not set(rest[0]) <= layout.optional
            parts.append(F.array(turn) if needed else F.when(F.size(given) > 0, F.array(turn)).otherwise(F.array().cast(TURNS)))
    return F.concat(*(p.cast(TURNS) for p in parts))


def canonical_turns(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns`` (role, text) of the JSON text in ``column``.

    The fingerprint is the hash of those nested field paths of the record that any layout reads, in
    order; other fields do not matter.  It selects the layout by a lookup.  A record whose
    fingerprint belongs to no layout, or that is null or no JSON object, has null layout and turns:
    nothing is guessed.  Null texts and roles become empty.  Repeated rows count each; an empty
    table gives no rows.  Columns of those names are replaced, others are kept.
    """
    known = F.array(*(F.lit(p) for p in sorted({p for layout in layouts for some in layout.path_sets() for p in some})))
    variant, paths = free_names(records, "variant", "paths")
    names: dict[str, str] = {}
    for layout in layouts:
        for some in layout.path_sets():
            if names.setdefault(fingerprint_of(some), layout.name) != layout.name:
                raise ValueError(f"layouts {names[fingerprint_of(some)]} and {layout.name} have the same fields")
    choice = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    out = records.withColumn(variant, F.try_parse_json(F.col(f"`{column}`")))
    out = out.withColumn(paths, field_paths(F.schema_of_variant(F.col(variant))))
    found = F.md5(F.array_join(F.array_sort(F.array_intersect(paths, known)), "\n").cast("binary"))
    out = out.withColumn("fingerprint", found).withColumn("layout", F.try_element_at(choice, F.col("fingerprint")))
    turns = F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        turns = F.when(F.col("layout") == layout.name, _texts(F.col(variant), layout)).otherwise(turns)
    return out.withColumn("turns", turns).drop(variant, paths)


@dataclass(frozen=True)
class Template:
    """Marks around a turn: ``start`` role ``middle`` text ``stop``.

    Control strings (those marks, and those of other common templates, so that texts cannot be
    taken for marks of either) begin with < or [; ``controls`` matches what follows.
    """

    start: str = "<|im_start|>"
    middle: str = "\n"
    stop: str = "<|im_end|>\n"
    #: Control strings without their first character.
    controls: str = r"/?s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>"

    def escape(self, text: Column) -> Column:
        """A backslash more after the first character of each control string, whatever number it has."""
        return F.regexp_replace(text, rf"([<\[])(\\*)({self.controls})", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self.controls})", r"$1$2$3")

    def escape_role(self, role: Column) -> Column:
        """Roles hold no line break, which ends them."""
        return F.replace(F.replace(self.escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


#: Lengths that are summed up in one run; sums of runs are added after, so that long arrays are not copied over and over.
RUN = 512


def before_each(lengths: Column) -> Column:
    """The sum of the elements before each element of an array of longs."""
    none = F.array().cast("array<bigint>")

    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), none.alias("all"))
        return F.aggregate(
            values, start, lambda at, v: F.struct((at["sum"] + v).alias("sum"), F.array_append(at["all"], at["sum"]).alias("all")), lambda at: at["all"]
        )

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda r: F.slice(lengths, r * RUN + 1, RUN))
    totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda at, v: at + v))
    shifted = F.zip_with(runs, sums(totals), lambda run, base: F.transform(sums(run), lambda v: v + base))
    return F.when(F.size(lengths) == 0, none).otherwise(F.flatten(shifted))


def format_turns(rows: DataFrame, template: Template = Template(), learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``rows`` (turns) with ``formatted`` and ``mask``: start, length and loss of the text of each turn, in code points.

    A loss is taken on the texts of the roles ``learnt``, without marks.  Null turns give a null
    text and mask; no turns an empty text.  Columns of those names are replaced.
    """
    pieces, heads = free_names(rows, "pieces", "heads")
    head = lambda t: F.concat(F.lit(template.start), template.escape_role(t["role"]), F.lit(template.middle))
    out = rows.withColumn(heads, F.transform("turns", head))
    out = out.withColumn(pieces, F.zip_with(heads, "turns", lambda h, t: F.concat(h, template.escape(t["text"]), F.lit(template.stop))))
    out = out.withColumn("formatted", F.array_join(pieces, ""))
    starts = before_each(F.transform(pieces, lambda p: F.length(p).cast("long")))
    sizes = F.arrays_zip(starts.alias("at"), F.col(pieces).alias("piece"), F.col(heads).alias("head"), F.col("turns").alias("turn"))
    mask = F.transform(
        sizes,
        lambda s: F.struct(
            (s["at"] + F.length(s["head"])).alias("start"),
            (F.length(s["piece"]) - F.length(s["head"]) - len(template.stop)).cast("long").alias("length"),
            s["turn"]["role"].isin(*learnt).alias("loss"),
        ),
    )
    return out.withColumn("mask", mask).drop(pieces, heads)


def read_back(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """``rows`` (formatted, mask) with ``turns`` and ``loss_text``, the unescaped texts under the mask.

    Both come from the formatted text alone; the mask's places are looked up in it.
    """
    pieces, = free_names(rows, "pieces")
    mark = "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in template.start)
    out = rows.withColumn(pieces, F.slice(F.split("formatted", mark, -1), 2, 2**31 - 1))
    middle, stop = len(template.middle), len(template.stop)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.middle, 1)
        text = piece.substr(F.length(role) + middle + 1, F.length(piece) - F.length(role) - middle - stop)
        return F.struct(template.unescape_role(role).alias("role"), template.unescape(text).alias("text"))

    out = out.withColumn("turns", F.transform(pieces, turn))
    starts = before_each(F.transform(pieces, lambda p: F.length(p).cast("long") + len(template.start)))
    # A text of the mask lies in one piece: its place there is that in the whole less the piece's.
    zipped = F.arrays_zip(starts.alias("at"), F.col(pieces).alias("piece"), F.col("mask").alias("mask"))
    learnt = F.filter(zipped, lambda z: z["mask"]["loss"])
    text = lambda z: z["piece"].substr((z["mask"]["start"] - z["at"] - len(template.start) + 1).cast("int"), z["mask"]["length"].cast("int"))
    return out.withColumn("loss_text", F.array_join(F.transform(learnt, lambda z: template.unescape(text(z))), "")).drop(pieces)


def records_of(conversations: DataFrame) -> DataFrame:
    """conv_id and record of rows (conv_id, turn, role, text): a JSON object with the messages by turn.

    Nulls sort first, rows of one turn by role and text; a null role or text is empty, a null
    conv_id a conversation.  A conversation becomes one row, as its text does.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def digests(rows: DataFrame) -> DataFrame:
    """What :func:`read_back` found, as counts and hashes."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL for the query: the same from the rows themselves, and the formatted length by the escapes that texts need.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>)')) AS escapes FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + escapes + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
