"""Chat formatting from heterogeneous layouts, with DataFrame functions only.

A record's *schema fingerprint* is a hash of its sorted nested field paths.  It
selects a declarative ``Mapping`` (expressions over the record) that yields
canonical turns; no data is looked at to guess a layout.  Records may be columns of
a DataFrame (one fingerprint for all rows) or JSON strings (one for each row); a record may
also be spread over rows, one for each turn.

Formatted text marks each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside
texts and roles ``<``, any backslashes, ``|`` gets one more backslash, so no control
string can be formed there and taking one backslash away restores the text; in
roles, which end at a line feed, backslash and line feed are escaped as well.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    Either ``listed`` names an array and the role and text fields of its elements,
    or ``single`` lists (role, fields) pairs in order: the fields that are not empty
    are joined by a blank line, and a system turn without text is left out.  ``spread``
    names the fields of a record's key, of the place, the role and the text of a turn, in a
    table that has a row for each turn.
    """

    name: str
    listed: tuple[str, str, str] | None = None
    single: tuple[tuple[str, tuple[str, ...]], ...] = ()
    spread: tuple[str, str, str, str] | None = None

    @property
    def paths(self) -> list[str]:
        if self.spread:
            return sorted(self.spread)
        if self.listed:
            return sorted(f"{self.listed[0]}[].{x}" for x in self.listed[1:])
        return sorted(f for _, fields in self.single for f in fields)

    @property
    def renamed(self) -> bool:
        """Whether roles of a table of turns go by other names."""
        return bool(self.spread) and self.spread[2] != "role"

    @property
    def kind(self) -> str:
        """The layout as a type."""
        if self.listed:
            return f"struct<`{self.listed[0]}`: array<struct<{', '.join(f'`{x}`: string' for x in self.listed[1:])}>>>"
        return f"struct<{', '.join(f'`{x}`: string' for x in self.paths)}>"

    @property
    def shape(self) -> str:
        """What ``json_fingerprint`` hashes for this layout."""
        if self.listed:
            return f"OBJECT<{self.listed[0]}: ARRAY<OBJECT<{', '.join(sorted(self.listed[1:]))}>>>"
        return f"OBJECT<{', '.join(self.paths)}>"

    def turns(self, record: Column) -> Column:
        if self.listed:
            array, role, text = self.listed
            return F.transform(record[array], lambda m: F.struct(_known(m[role]).alias("role"), m[text].alias("text")))
        made = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[record[f] for f in fields]), lambda x: x != ""), "\n\n").alias("text")) for role, fields in self.single]
        return F.filter(F.array(*made), lambda t: (t["role"] != "system") | (t["text"] != ""))


def _known(role: Column) -> Column:
    low = F.lower(role)
    return F.when(low.isin("human", "prompter"), F.lit("user")).when(low.isin("gpt", "model", "bot"), F.lit("assistant")).otherwise(role)


def _said(name: str, user: tuple[str, ...], answer: str, *system: str) -> Mapping:
    return Mapping(name, single=(*(("system", (s,)) for s in system), ("user", user), ("assistant", (answer,))))


#: Layouts of whole records; more can be given to the functions below.
MAPPINGS = (
    Mapping("messages", ("messages", "role", "content")),
    Mapping("shared", ("conversations", "from", "value")),
    _said("prompt", ("prompt",), "completion"),
    _said("prompt_response", ("prompt",), "response"),
    _said("prompt_system", ("prompt",), "completion", "system"),
    _said("question", ("question",), "answer"),
    _said("instruction", ("instruction",), "output"),
    _said("instruction_input", ("instruction", "input"), "output"),
)
#: Layouts of tables that have a row for each turn.
SPREAD = (
    Mapping("turn_rows", spread=("conv_id", "turn", "role", "text")),
    Mapping("message_rows", spread=("conversation_id", "position", "role", "content")),
    Mapping("shared_rows", spread=("id", "index", "from", "value")),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    """Undo ``escape_role``: what stands between pairs of backslashes holds no other escape than a line feed's."""
    parts = F.split(unescape(c), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(_head(role), escape(text), F.lit(f"{END}\n"))


def json_fingerprint(record: Column) -> Column:
    """The nested field paths of a JSON record as a canonical string, types taken out.

    ``schema_of_variant`` lists fields in sorted order, so equal layouts give equal
    strings whatever the order of their fields; its hash is the fingerprint.
    """
    shape = F.schema_of_variant(F.try_parse_json(record))
    shape = F.regexp_replace(shape, r": (?:STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\([0-9,]+\)|DATE|TIMESTAMP|FLOAT)\b", "")
    return F.substring(F.sha2(shape, 256), 1, 16)


def canonical_json(records: DataFrame, column: str, mappings=MAPPINGS) -> DataFrame:
    """Canonical turns of JSON records whose layouts differ from row to row.

    Adds ``fingerprint``, ``layout`` and ``turns``; the latter two are null where no
    mapping has the record's fingerprint, as for malformed and null records and for
    empty arrays of messages.  Repeated rows and all other columns pass through.
    """
    out = records.withColumn("fingerprint", json_fingerprint(F.col(column)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        hit = F.col("fingerprint") == hashlib.sha256(m.shape.encode()).hexdigest()[:16]
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, m.turns(F.from_json(F.col(column), m.kind)).cast(TURNS)).otherwise(turns)
    return out.withColumns({"layout": layout, "turns": turns})


def selected(schema: T.StructType, mappings=MAPPINGS + SPREAD) -> Mapping:
    """The mapping whose fingerprint the table has among those of its field paths.

    Columns outside a layout do not count; the layout with most fields that the table has
    all of wins.  Raises ``ValueError`` if none fits.
    """
    have = field_paths(schema)
    by_print = {fingerprint(m.paths): m for m in mappings}
    prints = {fingerprint(p for p in have if p in m.paths) for m in mappings}
    fits = [by_print[x] for x in prints if x in by_print]
    if not fits:
        raise ValueError(f"no mapping for a schema with the fields {sorted(have)}")
    return max(fits, key=lambda m: (len(m.paths), m.name))


def canonical(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """Canonical ``turns`` of a typed table, by the mapping that its schema's fingerprint selects.

    Columns outside the layout are passed through, repeated rows too.  A null record, as one
    whose array of messages is null, has null turns; null fields of a message stay null,
    and a null field of a prompt counts as empty.  Raises ``ValueError`` if no mapping fits.
    """
    m = selected(records.schema, mappings)
    top = [m.listed[0]] if m.listed else m.paths
    return records.withColumn("turns", m.turns(F.struct(*[records[c] for c in top])).cast(TURNS))


def format_turns(records: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``mask`` to records with an array of turns; null turns give an empty text."""
    kept = F.coalesce(F.col(turns), F.array().cast(TURNS))
    role, text = (lambda t: F.coalesce(t["role"], F.lit(""))), (lambda t: F.coalesce(t["text"], F.lit("")))
    mask = F.filter(F.transform(kept, lambda t, i: F.struct((i + 1).alias("turn"), (F.length(_head(role(t))) + 1).alias("start"), F.length(escape(text(t))).alias("chars"), (role(t) == "assistant").alias("loss"))), lambda m: m["loss"])
    return records.withColumns({"formatted": F.array_join(F.transform(kept, lambda t: _turn(role(t), text(t))), ""), "mask": F.transform(mask, lambda m: m.dropFields("loss"))})


def format_rows(rows: DataFrame, mappings=SPREAD) -> DataFrame:
    """One formatted text for each conversation of a table with a row for each turn.

    The table's fingerprint selects the mapping that says which of its columns are the
    conversation, the turn, the role and the text; other columns are not read, and
    ``ValueError`` is raised if no mapping fits.  Turns go by their place, null first, ties by role,
    then text; repeated rows are repeated turns; null roles and texts are empty, and rows
    without a conversation are one conversation of their own.  Returns ``conv_id``,
    ``formatted`` and ``mask``: for each assistant turn its place among the turns (from
    1), where its text starts inside the turn (from 1) and its length, all in code
    points.  Each turn is formatted before the shuffle, and partial lists are merged.
    """
    m = selected(rows.schema, mappings)
    key, place, role, text = map(F.col, m.spread)
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (_known(role) if m.renamed else role, text))
    # the head's length comes from the role, the text's from the whole turn: texts are escaped once
    turns = rows.select(key.alias("conv_id"), place.alias("turn"), role.alias("role"), _turn(role, text).alias("piece"), F.length(_head(role)).alias("head"))
    said = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "piece", "head"))).alias("said"))
    places = F.transform("said", lambda t, i: F.struct((i + 1).alias("turn"), (t["head"] + 1).alias("start"), (F.length(t["piece"]) - t["head"] - len(END) - 1).alias("chars"), (t["role"] == "assistant").alias("loss")))
    mask = F.transform(F.filter(places, lambda m: m["loss"]), lambda m: m.dropFields("loss"))
    return said.select("conv_id", F.array_join(F.col("said.piece"), "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns, and the text under the loss mask, parsed from ``formatted`` and ``mask`` alone.

    Adds ``turns`` (role and text as they were) and ``loss_texts``.  Every start mark
    opens a turn, as texts and roles cannot hold one.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**31 - 1)

    def turn(p: Column) -> Column:
        line = F.instr(p, "\n")
        body = F.substring(p, line + 1, F.length(p) - line - len(END) - 1)
        return F.struct(unescape_role(F.substring(p, F.lit(1), line - 1)).alias("role"), unescape(body).alias("text"))

    out = formatted.withColumn("_pieces", pieces)
    loss = F.transform("mask", lambda m: unescape(F.substring(F.get(F.col("_pieces"), m["turn"] - 1), m["start"] - len(START), m["chars"])))
    return out.withColumns({"turns": F.transform("_pieces", turn), "loss_texts": loss}).drop("_pieces")
