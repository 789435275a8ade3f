"""Chat formatting: schema fingerprints select mappings that turn any known layout into canonical turns.

A layout's fingerprint hashes its sorted nested field paths. MAPPINGS holds, under such hashes, declarative mappings
to turns. ``to_turns`` takes the fingerprint of each row, over its fields that aren't null, so one table may mix layouts
row by row; where no mapping has it, the mapping with the fewest fields of which the row's are a part is taken, and the
others of its fields are empty. ``rows_to_records`` puts tables with a row for each turn together first. ``render`` writes
turns with a template; control strings inside of texts are escaped reversibly, and the loss mask holds the spans
of assistant texts. ``read_back`` takes turns and loss text from this output alone.

Null text and null role are empty; null turn numbers come first; rows with equal turn numbers go by role,
then text, and repeated rows are turns of their own. The rows with a null id are one conversation. Columns that no layout
knows pass through ``to_turns`` and ``render`` (those named turns, formatted or loss are replaced); with a row for each turn
they can't belong to a conversation and go. A table without the columns of any layout raises ValueError; a row without any
known field has turns null and renders as an empty conversation. An empty table gives no rows. A conversation is one string.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, TURN, HEAD, END, FINISH = "<s>", "<|turn:", "|>\n", "<|end|>\n", "</s>"
#: Strings that the template, or one that it may be converted to, gives a meaning.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|", "|>", "<<SYS>>", "<</SYS>>")
#: The first character of each control string, and the backslash.
_ESCAPE = re.compile("|".join([re.escape("\\"), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]))
_UNESCAPE = re.compile(r"\\(.)", re.S)

TURNS = "array<struct<role:string,text:string>>"


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths; [] stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(found: list[str]) -> str:
    """A hash of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


@dataclass(frozen=True)
class Said:
    """Turns from columns: (role, columns); texts of several columns are parted by an empty line. A system turn is left out where it is empty."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def layout(self) -> list[str]:
        return [c for _, columns in self.turns for c in columns]

    def column(self, there: set[str]) -> Column:
        def text(columns):
            parts = [F.col(f"`{c}`").cast("string") for c in columns if c in there]
            return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n\n") if len(parts) > 1 else F.coalesce(*parts, F.lit(""))

        each = F.array(*(F.struct(F.lit(r).alias("role"), text(c).alias("text")) for r, c in self.turns))
        return F.filter(each, lambda t: (t["role"] != "system") | (t["text"] != ""))


@dataclass(frozen=True)
class Listed:
    """Turns from an array of structs, with names of roles as they are called elsewhere."""

    array: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()

    @property
    def layout(self) -> list[str]:
        return [f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"]

    def column(self, there: set[str]) -> Column:
        def one(m):
            r = m[self.role].cast("string")
            for a, b in self.names:
                r = F.when(m[self.role] == a, F.lit(b)).otherwise(r)
            return F.struct(F.coalesce(r, F.lit("")).alias("role"), F.coalesce(m[self.text].cast("string"), F.lit("")).alias("text"))

        return F.coalesce(F.transform(F.col(f"`{self.array}`"), one), F.array().cast(TURNS))


_SPOKEN = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: By fingerprint: the mapping of a layout to turns.
MAPPINGS = {
    fingerprint(m.layout): m
    for m in (
        *(Said((("user", (a,)), ("assistant", (b,)))) for a, b in (("prompt", "response"), ("prompt", "completion"), ("question", "answer"), ("instruction", "output"))),
        Said((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
        Said((("user", ("instruction", "input")), ("assistant", ("output",)))),
        Said((("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
        Listed("messages", "role", "content", _SPOKEN),
        Listed("conversations", "from", "value", _SPOKEN),
        Listed("conversations", "role", "content", _SPOKEN),
    )
}
#: The layout with a row for each turn.
BY_ROW = ("turn", "role", "text")


def row_fingerprint(fields: list[T.StructField]) -> Column:
    """The fingerprint of each row: of the paths below its top fields that aren't null."""
    each = sorted((p, f.name) for f in fields for p in paths(f.dataType, f.name))
    there = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"`{name}`").isNotNull(), F.lit(p)) for p, name in each))), "\n")
    return F.sha2(there, 256)


def to_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """df's key as conv_id, turns, and the columns that no layout knows."""
    named = {f.name for f in df.schema.fields}
    if set(BY_ROW) <= named:
        df, key = rows_to_records(df, key), "conv_id"
    top = {p.split("[")[0] for m in MAPPINGS.values() for p in m.layout}
    known = [f for f in df.schema.fields if f.name != key and f.name in top]
    other = [f.name for f in df.schema.fields if f.name not in (key, "conv_id", "turns", *(k.name for k in known))]
    whole = set(p for f in known for p in paths(f.dataType, f.name))
    able = sorted(((h, m) for h, m in MAPPINGS.items() if set(m.layout) <= whole), key=lambda x: (len(x[1].layout), x[0]))
    if not able:
        raise ValueError(f"no mapping for the layout {sorted(paths(df.schema))}")
    mine, turns = row_fingerprint(known), F.lit(None).cast(TURNS)
    there = [F.col(f"`{f.name}`").isNotNull() for f in known]
    some = F.greatest(*(t.cast("int") for t in there), F.lit(0)) > 0
    for _, m in reversed(able):
        part = [~t for t, f in zip(there, known, strict=True) if not set(paths(f.dataType, f.name)) <= set(m.layout)]
        fits = some
        for p in part:
            fits = fits & p
        turns = F.when(fits, m.column(whole)).otherwise(turns)
    for h, m in able:
        turns = F.when(mine == F.lit(h), m.column(whole)).otherwise(turns)
    return df.select(F.col(f"`{key}`").alias("conv_id"), turns.alias("turns"), *(F.col(f"`{c}`") for c in other))


def _conversations(batches):
    """(id, messages) of sorted rows, across batches."""
    held, turns, any_ = None, [], False
    for b in batches:
        for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if any_ and i != held:
                yield held, turns
                turns = []
            held, any_ = i, True
            turns.append({"role": r, "content": t})
    if any_:
        yield held, turns


def rows_to_records(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, messages array<struct<role, content>>) of a row for each turn: one shuffle by conversation, sorted on the disk where need be."""

    def gather(batches):
        out, size = [], 0
        for i, turns in _conversations(batches):
            out.append({"conv_id": i, "messages": turns})
            size += sum(len(t["content"] or "") for t in turns)
            if size > 1 << 20 or len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("messages", pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())])))])
    dealt = rows.select(F.col(f"`{key}`").cast("long").alias("conv_id"), "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(gather, "conv_id long, messages array<struct<role:string,content:string>>")


def escape(text: str) -> str:
    """No control string is left, and unescape gives the text back: a backslash goes after the first character of each, and each backslash is doubled."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def write_chat(turns) -> tuple[str, list[tuple[int, int]]]:
    """(formatted, spans of the loss mask): the spans hold assistant texts as they stand in formatted."""
    out, spans, at = [BEGIN], [], len(BEGIN)
    for t in turns:
        head, body = f"{TURN}{escape(t['role'])}{HEAD}", escape(t["text"])
        out += [head, body, END]
        if t["role"] == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join([*out, FINISH]), spans


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn, from the formatted text alone."""
    body = formatted[len(BEGIN) : -len(FINISH)]
    out = []
    for part in body.split(END)[:-1]:
        role, _, text = part.removeprefix(TURN).partition(HEAD)
        out.append((unescape(role), unescape(text)))
    return out


def render(turns: DataFrame) -> DataFrame:
    """turns' columns, with formatted and loss array<struct<start, end>> in place of turns."""
    others = [f for f in turns.schema.fields if f.name not in ("turns", "formatted", "loss")]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*others, T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(span))])

    def write(batches):
        for b in batches:
            done = [write_chat(t or []) for t in b.column(b.num_columns - 1).to_pylist()]
            loss = pa.array([[{"start": a, "end": z} for a, z in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f for f, _ in done], pa.string()), loss], names=schema.names)

    return turns.select(*(F.col(f"`{f.name}`") for f in others), "turns").mapInArrow(write, schema)


def read_back(chats: DataFrame) -> DataFrame:
    """What the output says: number and digest of turns, length and digest of the text under the loss mask."""

    def read(batches):
        for b in batches:
            rows = []
            for i, f, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns = parse_chat(f)
                lost = "".join(unescape(f[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((i, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(f)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return chats.select(F.col("conv_id").cast("long"), "formatted", "loss").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
