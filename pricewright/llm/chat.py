"""Chat formatting: schema fingerprints select the mapping that turns any known layout into canonical turns.

A record is one JSON object. Its fingerprint hashes its shape: the paths of all fields at any depth, those of all elements of
a list taken together, with every scalar alike. A registry maps fingerprints to declarative mappings, each a list of (role,
path) pairs or a path to a list of messages. Canonical turns are then written in one template, with a mask of the assistant's
texts, and can be read back from it.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts every backslash is doubled and
every control string gets a backslash after its first character, so no control string of the template or of the other
listed templates stays in a text; reading back removes one backslash before any character.

Defined cases: null text or role counts as empty; turns with the same number are ordered by role, then text, and
repeated rows are repeated turns; a null turn number sorts first; a record of unknown layout, such as one with a further
field in any message, has null turns and keeps its fingerprint; text that is no JSON, repeats a key in an object or is longer
than the parser takes (128 MB) has a null fingerprint; a message of a known layout that lacks a field has it empty; a number
where text is expected is its digits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings that texts must not hold as they are.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping of one layout: single fields with the role each one speaks, or a list of messages."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    messages: str = ""
    role_key: str = "role"
    text_key: str = "content"
    roles: tuple[tuple[str, str], ...] = ()

    def shapes(self) -> tuple[str, ...]:
        """The shapes of the records in this layout: of a list of messages also the empty one."""
        if not self.messages:
            return (shape_of({path: SCALAR for _, path in self.fields}),)
        message = shape_of({self.role_key: SCALAR, self.text_key: SCALAR})
        return tuple(shape_of({self.messages: f"ARRAY<{inner}>"}) for inner in (message, SCALAR))


#: Stands for every scalar in a shape.
SCALAR = "VALUE"


def shape_of(paths: dict[str, str]) -> str:
    """The shape of an object from dotted paths and the shapes at their ends."""
    heads: dict[str, dict[str, str]] = {}
    for path, end in paths.items():
        head, _, rest = path.partition(".")
        heads.setdefault(head, {})[rest] = end
    inner = {h: below[""] if "" in below else shape_of(below) for h, below in heads.items()}
    return "OBJECT<" + ", ".join(f"{h}: {inner[h]}" for h in sorted(inner)) + ">"


#: The layouts in use, with the role names that each of them has for the canonical ones.
LAYOUTS = (
    Layout("messages", messages="messages"),
    Layout("sharegpt", messages="conversations", role_key="from", text_key="value",
           roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("instruction_output", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input_output", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system_prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
    Layout("nested_messages", messages="conversation.messages", role_key="speaker", text_key="text"),
    Layout("nested_prompt_response", fields=(("user", "data.prompt"), ("assistant", "data.response"))),
)


def fingerprint_of(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()[:16]


def schema_fingerprint(record: Column) -> Column:
    """The fingerprint of a JSON record's shape."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    kinds = r"(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID|DECIMAL\([0-9]+,[0-9]+\))"
    shape = F.regexp_replace(schema, rf"(^|: |<){kinds}(?=[,>]|$)", f"$1{SCALAR}")
    return F.substring(F.sha2(shape.cast("binary"), 256), 1, 16)


def _turns(record: Column, layout: Layout) -> Column:
    if layout.messages:
        schema = f"array<struct<`{layout.role_key}`:string,`{layout.text_key}`:string>>"
        listed = F.from_json(F.get_json_object(record, f"$.{layout.messages}"), schema)

        def turn(message: Column) -> Column:
            role = F.coalesce(message[layout.role_key], F.lit(""))
            named = role
            for theirs, ours in layout.roles:
                named = F.when(role == theirs, F.lit(ours)).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(message[layout.text_key], F.lit("")).alias("text"))

        return F.coalesce(F.transform(listed, turn), F.array().cast(TURNS))
    each = [
        F.struct(F.lit(role).alias("role"), F.coalesce(F.get_json_object(record, f"$.{path}"), F.lit("")).alias("text"))
        for role, path in layout.fields
    ]
    return F.array(*each)


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add the fingerprint of each JSON record and its canonical turns, chosen by that fingerprint."""
    rows = records.withColumn("fingerprint", schema_fingerprint(F.col(record)))
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        known = [fingerprint_of(shape) for shape in layout.shapes()]
        turns = F.when(F.col("fingerprint").isin(known), _turns(F.col(record), layout)).otherwise(turns)
    return rows.withColumn("turns", turns)


def escaped(text: Column) -> Column:
    """Double backslashes and put one after the first character of each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(rows: DataFrame, turns: str = "turns", trained_role: str = "assistant") -> DataFrame:
    """Add the formatted text and its loss mask: (start, end) code points of the trained role's escaped texts."""
    parts = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), escaped(t["role"]), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            (t["role"] == trained_role).alias("trained"),
        ),
    )
    rows = rows.withColumn("_parts", parts)
    whole = F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    rows = rows.withColumn("formatted", F.array_join(whole, ""))
    lengths = F.transform(
        "_parts",
        lambda p: F.struct(
            F.length(p["head"]).cast("long").alias("head"),
            F.length(p["body"]).cast("long").alias("body"),
            p["trained"].alias("trained"),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["head"]
        end = start + part["body"]
        spans = F.when(
            part["trained"], F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        ).otherwise(state["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    first = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    rows = rows.withColumn("loss_mask", F.aggregate(lengths, first, step, lambda state: state["spans"]))
    return rows.drop("_parts")


def read_back(rows: DataFrame) -> DataFrame:
    """Add what the formatted text and its mask say: the turns read, and the unescaped text under the mask."""
    bodies = F.slice(F.split("formatted", r"<\|im_end\|>\n"), 1, F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1)

    def turn(part: Column) -> Column:
        inner = F.substr(part, F.lit(len(START) + 1))
        at = F.instr(inner, "\n")
        return F.struct(
            unescaped(F.substr(inner, F.lit(1), at - 1)).alias("role"), unescaped(F.substr(inner, at + 1)).alias("text")
        )

    rows = rows.withColumn("read_turns", F.transform(bodies, turn))
    masked = F.transform(
        "loss_mask",
        lambda m: unescaped(
            F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
        ),
    )
    return rows.withColumn("loss_text", F.array_join(masked, ""))


def _rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, rows): the turns of each conversation in order."""
    row = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("content"),
    )
    grouped = conversations.select("conv_id", row.alias("row")).groupBy("conv_id")
    return grouped.agg(F.sort_array(F.collect_list("row")).alias("rows"))


def _messages(role_key: str = "role", text_key: str = "content", roles: tuple[tuple[str, str], ...] = ()) -> Column:
    def message(r: Column) -> Column:
        role = r["role"]
        for theirs, ours in roles:
            role = F.when(r["role"] == ours, F.lit(theirs)).otherwise(role)
        return F.struct(role.alias(role_key), r["content"].alias(text_key))

    return F.transform("rows", message)


def records_from_rows(conversations: DataFrame) -> DataFrame:
    """One JSON record of messages for each conv_id from rows of (conv_id, turn, role, text)."""
    rows = _rows_of(conversations)
    return rows.select("conv_id", F.to_json(F.struct(_messages().alias("messages"))).alias("record"))


def mixed_records(conversations: DataFrame) -> DataFrame:
    """The same in layouts of several kinds, as a corpus from many places has them.

    A question with its answer, two turns of user and assistant, is one of two layouts with single fields, by whether conv_id is
    even; after a system turn it is the one with three. All others are lists of messages of three kinds by conv_id modulo 3,
    but for those in which a role has the name that the second kind has for another: they stay with the first.
    """
    text = lambda i: F.get("rows", F.lit(i))["content"]
    said = F.transform("rows", lambda r: r["role"])
    are = lambda *roles: said == F.array(*map(F.lit, roles))
    theirs = LAYOUTS[1].roles
    clash = F.arrays_overlap(said, F.array(*[F.lit(t) for t, _ in theirs]))
    kind = F.when(clash, 0).otherwise(F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3)))
    pair = lambda a, b: F.struct(text(0).alias(a), text(1).alias(b))
    three = F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))
    nested = F.struct(F.struct(_messages("speaker", "text").alias("messages")).alias("conversation"))
    record = (
        F.when(are("user", "assistant") & (F.pmod("conv_id", F.lit(2)) == 0), F.to_json(pair("prompt", "completion")))
        .when(are("user", "assistant"), F.to_json(F.struct(pair("prompt", "response").alias("data"))))
        .when(are("system", "user", "assistant"), F.to_json(three))
        .when(kind == 1, F.to_json(F.struct(_messages("from", "value", theirs).alias("conversations"))))
        .when(kind == 2, F.to_json(nested))
        .otherwise(F.to_json(F.struct(_messages().alias("messages"))))
    )
    return _rows_of(conversations).select("conv_id", record.alias("record"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', '{planted}'), (-1L, 1L, 'assistant', '{planted}') t(conv_id, turn, role, text)"
    )
    done = read_back(formatted(canonical(mixed_records(rows.unionByName(extra)))))
    said = F.array_join(
        F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return done.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "fingerprint",
    )


def _sql_escaped(column: str) -> str:
    text = f"replace({column}, chr(92), chr(92) || chr(92))"
    for mark in CONTROL:
        text = f"replace({text}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    return text


def _sql_fingerprint() -> str:
    """The rule of ``mixed_records`` over the list of roles."""
    named = {layout.name: fingerprint_of(layout.shapes()[0]) for layout in LAYOUTS}
    clash = ", ".join(f"'{theirs}'" for theirs, _ in LAYOUTS[1].roles)
    return f"""CASE WHEN roles = ['user', 'assistant'] AND conv_id % 2 = 0 THEN '{named["prompt_completion"]}'
            WHEN roles = ['user', 'assistant'] THEN '{named["nested_prompt_response"]}'
            WHEN roles = ['system', 'user', 'assistant'] THEN '{named["system_prompt_response"]}'
            WHEN list_has_any(roles, [{clash}]) THEN '{named["messages"]}'
            WHEN (coalesce(conv_id, 0) % 3 + 3) % 3 = 1 THEN '{named["sharegpt"]}'
            WHEN (coalesce(conv_id, 0) % 3 + 3) % 3 = 2 THEN '{named["nested_messages"]}'
            ELSE '{named["messages"]}' END"""


OP8_SQL = f"""
WITH spoken AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
done AS (
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum({len(START) + 1 + len(END)} + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars,
       list(role ORDER BY turn NULLS FIRST, role, text) AS roles
FROM spoken GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, {_sql_fingerprint()} AS fingerprint
FROM done
"""
