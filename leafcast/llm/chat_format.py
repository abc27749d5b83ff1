"""Chat formatting: schema fingerprints choose the mapping that makes records canonical turns.

A record's fingerprint is the hash of its sorted nested field paths (lists marked ``[]``),
restricted to the paths that some mapping names, so further fields do not matter. Each
mapping declares the paths it reads; the fingerprint of its paths selects it. Records that no
mapping fits are returned with their fingerprint, never guessed at. The canonical turns (conversation,
position, role, text) are then written in one template with a loss mask.

Template, per turn: ``<turn role="ROLE">\\n`` + text + ``</turn>\\n``. The role is percent-encoded. In a
text, ``<turn`` and ``</turn`` get a backslash after ``<``, and one more if they have some
already, so no control string is left inside a text and ``unescape`` takes one away again.

Cases: a null text or role is empty; a null order comes first; rows equal in conversation and order
are taken by role, then text, and all kept; records that are not JSON have a null fingerprint; a
conversation is one training example and so one row, however long; an empty table gives no rows;
a null conversation id is one conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcast.functions import arrays

END = "</turn>\n"
HEAD_OPEN, HEAD_CLOSE = '<turn role="', '">\n'
#: Names of the roles in the layouts, and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns``: (role, path) pairs, a fixed turn each in this order; or ``each``: the path of a
    list with ``role`` and ``text`` inside its elements; or, without either, the record is one turn
    with ``role``, ``text``, and the conversation's ``conversation`` and ``order``.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    conversation: str = ""
    order: str = ""


MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), role="role", text="text", conversation="conv_id", order="turn"),
    Mapping("messages", ("messages[].role", "messages[].content"), each="messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value"),
    Mapping("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping(
        "instruction_input", ("instruction", "input", "output"),
        turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Mapping("prompt", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(
        "system_prompt", ("system", "prompt", "response"),
        turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
    Mapping("question", ("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint_of(paths) -> str:
    """Fingerprint of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a VARIANT: ``a.b`` for fields, ``a[].b`` through lists; leaves only.

    Read from the variant's schema with a stack of prefixes.
    """
    tokens = F.regexp_extract_all(
        F.schema_of_variant(record), F.lit(r"`(?:[^`]|``)*`: |[^`<>:, ]+: |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9,]+\))?"), F.lit(0)
    )
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, token: Column) -> Column:
        stack, at, paths = acc["stack"], acc["at"], acc["paths"]
        top = F.element_at(stack, -1)
        name = F.replace(F.regexp_replace(token, "^`|`?: $", ""), F.lit("``"), F.lit("`"))
        joined = F.when(F.endswith(top, F.lit("[]")) | (top != ""), F.concat(top, F.lit("."), name)).otherwise(name)
        state = lambda s, a, p: F.struct(s.alias("stack"), a.alias("at"), p.alias("paths"))
        inside = F.concat(at, F.lit("[]"))
        return (
            F.when(F.endswith(token, F.lit(": ")), state(stack, joined, paths))
            .when(token == "OBJECT<", state(F.array_append(stack, at), at, paths))
            .when(token == "ARRAY<", state(F.array_append(stack, at), inside, paths))
            .when(token == ">", state(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(1))), at, paths))
            .otherwise(state(stack, at, F.array_append(paths, at)))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda acc: acc["paths"])))


def fingerprint(paths: Column, mappings=MAPPINGS) -> Column:
    """Hash of those of the sorted paths that some mapping names."""
    known = F.array(*(F.lit(p) for p in sorted({p for m in mappings for p in m.paths})))
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, known)), "\n"), 256)


def _get(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))


def _turns(m: Mapping, record: Column) -> Column:
    """Array of (order, role, text) of a record under a mapping; order is null where the position decides."""

    def turn(order: Column, role: Column, text: Column) -> Column:
        names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
        named = F.coalesce(F.try_element_at(names, role), role) if m.each else role
        return F.struct(order.alias("order"), named.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    none = F.lit(None).cast("bigint")
    if m.each:
        kind = f"array<struct<{m.role}:string,{m.text}:string>>"
        return F.transform(F.try_variant_get(record, f"$.{m.each}", kind), lambda x: turn(none, F.coalesce(x[m.role], F.lit("")), x[m.text]))
    if m.turns:
        return F.array(*(turn(none, F.lit(role), _get(record, path)) for role, path in m.turns))
    return F.array(turn(F.try_variant_get(record, f"$.{m.order}", "bigint"), _get(record, m.role), _get(record, m.text)))


def canonical_turns(records: DataFrame, record_col: str, id_col: str | None = None, mappings=MAPPINGS) -> DataFrame:
    """Rows (conv_id, order, pos, role, text, layout, fingerprint), one per turn.

    ``records``: a VARIANT (or JSON string) column and an id. ``layout`` is null, with an empty role and
    text, for a record that no mapping fits; leave those out before formatting.
    """
    json = dict(records.dtypes)[record_col] == "string"
    record = F.try_parse_json(records[record_col]) if json else records[record_col]
    conv = records[id_col].cast("bigint") if id_col else F.lit(None).cast("bigint")
    rows = records.select(conv.alias("id"), record.alias("record")).withColumn("paths", field_paths(F.col("record")))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("paths"), mappings)).drop("paths")
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("order"), F.lit("").alias("role"), F.lit("").alias("text")))
    layout, turns, conversation = F.lit(None).cast("string"), none, F.col("id")
    for m in mappings:
        hit = F.col("fingerprint") == fingerprint_of(m.paths)
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, F.coalesce(_turns(m, F.col("record")), none)).otherwise(turns)
        if m.conversation:
            conversation = F.when(hit, F.try_variant_get(F.col("record"), f"$.{m.conversation}", "bigint")).otherwise(conversation)
    return rows.select(
        conversation.alias("conv_id"), layout.alias("layout"), "fingerprint", F.posexplode(turns).alias("pos", "t")
    ).select("conv_id", "t.order", "pos", "t.role", "t.text", "layout", "fingerprint")


def escape(text: Column) -> Column:
    """One more backslash between ``<`` and ``turn`` or ``/turn``."""
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def format_chats(turns: DataFrame, loss_roles=("assistant",)) -> DataFrame:
    """Rows (conv_id, formatted, turns) of canonical turns.

    ``turns``: per turn its first code point (``at``), the span of its escaped text
    (``start``, ``end``) in ``formatted``, and whether the loss mask covers it (``loss``).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD_OPEN), F.url_encode(role), F.lit(HEAD_CLOSE))
    rows = turns.select(
        "conv_id",
        F.struct(
            "order", "pos", role.alias("role"), text.alias("raw"), head.alias("head"), escape(text).alias("text"),
            role.isin(*loss_roles).alias("loss"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def span(t: Column, at: Column) -> Column:
        start = at.cast("int") + F.length(t["head"])
        return F.struct(at.cast("int").alias("at"), start.alias("start"), (start + F.length(t["text"])).alias("end"), t["loss"].alias("loss"))

    sizes = F.transform("ts", lambda t: F.length(t["head"]) + F.length(t["text"]) + len(END))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "").alias("formatted"),
        F.zip_with("ts", arrays.running_sums(sizes), span).alias("turns"),
    )


def read_back(formatted: Column, turns: Column) -> Column:
    """Array of (role, text, loss) read from the formatted string by its marks and spans."""
    pieces = F.split(formatted, END, -1)
    role = lambda p: F.url_decode(F.substring_index(F.substring(p, len(HEAD_OPEN) + 1, F.length(p)), HEAD_CLOSE, 1))
    return F.zip_with(
        F.slice(pieces, 1, F.size(turns)), turns,
        lambda p, t: F.struct(
            role(p).alias("role"), unescape(F.substring(p, t["start"] - t["at"] + 1, t["end"] - t["start"])).alias("text"), t["loss"].alias("loss")
        ),
    )
