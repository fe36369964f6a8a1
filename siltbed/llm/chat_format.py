"""Chat formatting by schema fingerprints. DataFrame operations only.

A record is a VARIANT in any of several layouts. The nested field paths of a record (its schema without the types of the
leaves) are hashed; the hash selects a declarative mapping from paths to turns. Turns are laid out by one template:

    [INST] text [/INST]</s>    user        [ANS] text [/ANS]</s>    assistant        [ROLE:hex] text [/ROLE]</s>    others

where hex is the role in hexadecimal UTF-8. In a text a backslash is doubled, and one is put after the first character of
anything that looks like a control string, so that none is left and the text can be had back. The loss mask covers the
escaped texts of assistant turns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.common import free_name

TURNS = "array<struct<role:string,text:string>>"
CONTROL = r"/?(?:s>|INST\]|ANS\]|ROLE)"
#: Turns that one task puts together first; a long conversation is assembled from such parts.
PART = 256


@dataclass(frozen=True)
class Mapping:
    """paths: the canonical nested paths of the layout. turns: (role, paths of texts, joined by newlines); a role that
    starts with $ is a path. each: path of an array of turns, with the names of its role and text fields. roles: renames."""

    name: str
    paths: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str = ""
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)


SHARED_ROLES = {"human": "user", "gpt": "assistant"}
MAPPINGS = (
    Mapping("turn", "OBJECT<role,text>", ((("$.role"), ("$.text",)),)),
    Mapping("prompt", "OBJECT<completion,prompt>", (("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Mapping("prompt_response", "OBJECT<prompt,response>", (("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Mapping("question", "OBJECT<answer,question>", (("user", ("$.question",)), ("assistant", ("$.answer",)))),
    Mapping("instruction", "OBJECT<instruction,output>", (("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Mapping("instruction_input", "OBJECT<input,instruction,output>", (("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Mapping("messages", "OBJECT<messages:ARRAY<OBJECT<content,role>>>", each="$.messages"),
    Mapping("system_messages", "OBJECT<messages:ARRAY<OBJECT<content,role>>,system>", (("system", ("$.system",)),), each="$.messages"),
    Mapping("from_value", "OBJECT<conversations:ARRAY<OBJECT<from,value>>>", each="$.conversations", role="from", text="value", roles=SHARED_ROLES),
)


def paths(record: Column) -> Column:
    """Nested field paths of a VARIANT: its schema, keys in order, without the types of its leaves."""
    return F.regexp_replace(F.regexp_replace(F.schema_of_variant(record), r":\s*(?!ARRAY<|OBJECT<)[A-Z][A-Z0-9_ ]*(?:\(\d+,\s*\d+\))?", ""), r"([:,])\s+", "$1")


def fingerprint(path_text: Column) -> Column:
    return F.xxhash64(path_text)


def _renamed(role: str, text: str, roles: dict[str, str]) -> Callable[[Column], Column]:
    def turn(x: Column) -> Column:
        name = x[role]
        for old, new in roles.items():
            name = F.when(x[role] == old, new).otherwise(name)
        return F.struct(name.alias("role"), x[text].alias("text"))

    return turn


def turns_of(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS, unknown: str = "reject") -> Column:
    """array<struct<role, text>> of a record; empty for a null record and, unless unknown is "raise", for a layout that no
    mapping has."""
    got = lambda path: F.try_variant_get(record, path, "string")
    none, out, shape = F.array().cast(TURNS), None, fingerprint(paths(record))
    for m in mappings:
        single = [F.struct((got(r) if r.startswith("$") else F.lit(r)).alias("role"), (got(t[0]) if len(t) == 1 else F.concat_ws("\n", *map(got, t))).alias("text")) for r, t in m.turns]
        turns = F.array(*single) if single else none
        if m.each:
            listed = F.try_variant_get(record, m.each, f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
            turns = F.concat(turns, F.coalesce(F.transform(listed, _renamed(m.role, m.text, {})), none))
        if m.roles:
            turns = F.transform(turns, _renamed("role", "text", m.roles))
        test = shape == fingerprint(F.lit(m.paths))
        out = F.when(test, turns) if out is None else out.when(test, turns)
    if unknown == "raise":
        out = out.when(record.isNotNull(), F.raise_error(F.concat(F.lit("no mapping for the layout "), paths(record))).cast(TURNS))
    return F.coalesce(out, none)


def rejected(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The rows of records, with all their columns, that format_chats leaves out because no mapping has their layout, and
    `layout`, the nested paths (with underscores in front on a clash). Null records are not among them."""
    known = [fingerprint(F.lit(m.paths)) for m in mappings]
    return records.where(F.col(record).isNotNull() & ~fingerprint(paths(F.col(record))).isin(*known)).withColumn(free_name(records, "layout"), paths(F.col(record)))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])({CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"([<\[])\\({CONTROL})", "$1$2"), F.lit("\\\\"), F.lit("\\"))


def _head(role: Column) -> Column:
    return F.when(role == "user", "[INST] ").when(role == "assistant", "[ANS] ").otherwise(F.concat(F.lit("[ROLE:"), F.hex(F.encode(role, "UTF-8")), F.lit("] ")))


def _tail(role: Column) -> Column:
    return F.when(role == "user", " [/INST]</s>").when(role == "assistant", " [/ANS]</s>").otherwise(" [/ROLE]</s>")


def format_chats(records: DataFrame, key: str = "conv_id", order: str = "turn", record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS, unknown: str = "reject") -> DataFrame:
    """(key, formatted, loss_spans): one row a conversation, the records of a key in the order of `order`.

    loss_spans are [start, end) in code points of formatted. Null roles and texts count as empty. Records of one order
    (nulls first) are sorted by role and text; repeated ones come back each. A null key is a conversation of its own.
    Null records have no turns. Records in a layout that no mapping has give no turns here and are what `rejected`
    returns, or with unknown="raise" an error that names the layout; a key with no turn at all gives no row. Other columns
    of records are left out. An empty table gives an empty result.

    A conversation is one value, so its text ends up in one task; escaping runs before the shuffle, and parts of PART
    turns are assembled first, so that the last task of a huge conversation reads one row for each such part.
    """
    turns = records.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.posexplode(turns_of(F.col(record), mappings, unknown)).alias("p", "t"))
    turns = turns.select("k", "o", "p", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))
    head, body = _head(F.col("role")), escape(F.col("text"))
    turns = turns.select("k", "o", "p", F.floor(F.coalesce("o", F.lit(-1)) / PART).alias("part"), "role", body.alias("body"), head.alias("head"), _tail(F.col("role")).alias("tail"))
    turns = turns.select("k", "o", "p", "part", "role", F.concat("head", "body", "tail").alias("seg"), F.length("head").cast("long").alias("from"), F.length("body").cast("long").alias("size"))
    w = Window.partitionBy("k", "part").orderBy(F.col("o").asc_nulls_first(), "p", "role", "seg").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("seg").cast("long")).over(w), F.lit(0).cast("long")))
    loss = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.col("from")).alias("start"), (F.col("at") + F.col("from") + F.col("size")).alias("end")))
    parts = turns.groupBy("k", "part").agg(
        F.sort_array(F.collect_list(F.struct("at", "seg"))).alias("segs"), F.sort_array(F.collect_list(loss)).alias("loss"), F.sum(F.length("seg").cast("long")).alias("size")
    ).select("k", "part", F.array_join("segs.seg", "").alias("piece"), "loss", "size")
    w = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("off", F.coalesce(F.sum("size").over(w), F.lit(0).cast("long")))
    moved = F.transform("loss", lambda s: F.struct((s["start"] + F.col("off")).alias("start"), (s["end"] + F.col("off")).alias("end")))
    whole = parts.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("part", "piece", moved.alias("loss")))).alias("ps"))
    return whole.select(F.col("k").alias(key), F.array_join("ps.piece", "").alias("formatted"), F.flatten("ps.loss").alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    lines = F.split(formatted, "</s>", -1)

    def turn(x: Column) -> Column:
        tag = F.substring_index(x, "] ", 1)  # without the bracket that closes it
        user, answer = tag == "[INST", tag == "[ANS"
        role = F.when(user, "user").when(answer, "assistant").otherwise(F.decode(F.unhex(F.substring(tag, 7, 1 << 30)), "UTF-8"))
        tail = F.when(user, 8).when(answer, 7).otherwise(8)
        body = F.substr(x, F.length(tag) + 3, F.length(x) - F.length(tag) - 2 - tail)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1), turn)


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped: cut out of `formatted` at the spans, each unescaped by itself, and joined.

    Code points have four bytes each in UTF-32, so a span is cut out by its byte offsets, and the work is one copy of the
    text, however many spans there are. A conversation of over half a billion code points does not fit."""
    first = F.lit("x".encode("utf-32-be"))  # keeps a decoder from taking a byte order mark at the start of a text away

    def cut_out(wide: Column) -> Column:
        piece = lambda s: F.decode(F.concat(first, F.substring(wide, (4 * s["start"] + 1).cast("int"), (4 * (s["end"] - s["start"])).cast("int"))), "UTF-32")
        return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(piece(s), F.lit(2)))), "")

    return F.element_at(F.transform(F.array(F.encode(formatted, "UTF-32")), cut_out), 1)
