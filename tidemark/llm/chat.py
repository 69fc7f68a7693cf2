"""5. Chat formatting: schema fingerprints select declarative mappings to canonical turns; a reversible template.

DataFrame functions only. A record is a JSON text of some layout. Its tree of nested field paths, without types, is
hashed; the hash selects one of the declared ``LAYOUTS``, whose SQL expression gives the canonical turns (role, text).
The tree is read from the record with its texts emptied, whatever their length: a variant holds no long texts.
The template writes each turn as ``<|im_start|>role``, a line feed, the text and ``<|im_end|>``; control strings
inside texts and roles are escaped, reversibly. The loss mask has an entry for each turn: the span of the text inside
the formatted turn for an assistant's, null for others. So reading back cuts each turn once, in linear time.

Cases: null texts and roles count as empty; turns with equal numbers are ordered by role and text; a record of an
undeclared layout, or no JSON, has null layout and turns and gives no formatted text; in ``chat_report``, which makes
its records, a record without layout is an error, so no conversation is lost; a record without turns formats to an
empty text; repeated records give repeated results; an empty table gives an empty result. A conversation is one text,
so its turns are gathered in one row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

START, END = "<|im_start|>", "<|im_end|>\n"
#: Texts under the loss mask are those of this role.
TARGET = "assistant"
#: Options of reading a record: texts of any length.
READ = "map('maxStringLen', '2147483647')"


@dataclass(frozen=True)
class Layout:
    name: str
    shape: str  # tree of field paths
    schema: str  # how the record is read
    turns: str  # SQL over the read record ``r``


def _pairs(*fields: str) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{role}', 'text', coalesce(r.{field}, ''))" for role, field in (f.split("=") for f in fields)) + ")"


def _list(field: str, role: str, text: str) -> str:
    return f"transform(r.{field}, t -> named_struct('role', coalesce(t.{role}, ''), 'text', coalesce(t.{text}, '')))"


LAYOUTS = (
    Layout("messages", "{messages:[{content,role}]}", "messages array<struct<role: string, content: string>>", _list("messages", "role", "content")),
    Layout("conversations", "{conversations:[{from,value}]}", "conversations array<struct<`from`: string, value: string>>", _list("conversations", "`from`", "value")),
    Layout("prompt", "{completion,prompt}", "prompt string, completion string", _pairs("user=prompt", "assistant=completion")),
    Layout("instruction", "{instruction,response}", "instruction string, response string", _pairs("user=instruction", "assistant=response")),
    Layout("system_prompt", "{completion,prompt,system}", "system string, prompt string, completion string", _pairs("system=system", "user=prompt", "assistant=completion")),
    Layout(
        "instruction_input", "{input,instruction,output}", "instruction string, input string, output string",
        "array(named_struct('role', 'user', 'text', concat(coalesce(r.instruction, ''), if(coalesce(r.input, '') = '', '', concat('\\n\\n', r.input)))), named_struct('role', 'assistant', 'text', coalesce(r.output, '')))",
    ),
    Layout("empty", "{messages:[]}", "messages array<string>", "cast(array() as array<struct<role: string, text: string>>)"),
)


def emptied(record: str) -> Column:
    """A JSON text with empty texts for its values, names left: without escapes, quotes enclose names and values only."""
    plain = F.replace(F.replace(record, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    return F.regexp_replace(plain, r'("[^"]*+"\s*+:)|(")[^"]*+(")', "$1$2$3")


def shape(record: str) -> Column:
    """The tree of nested field paths of a JSON text, as ``{a:[{b,c}]}``; null where the text is no JSON."""
    tree = F.schema_of_variant(F.try_parse_json(emptied(record)))
    for pattern, text in ((r"OBJECT<", "{"), (r"ARRAY<(VOID|STRING|BIGINT|DOUBLE|BOOLEAN|DECIMAL\([0-9,]+\))>", "[]"), (r"ARRAY<", "["), (r": (VOID|STRING|BIGINT|DOUBLE|BOOLEAN|DECIMAL\([0-9,]+\))", "")):
        tree = F.regexp_replace(tree, pattern, text)
    # what an opening bracket has become says how it closes
    tree = F.regexp_replace(F.regexp_replace(tree, ", ", ","), ": ", ":")
    for _ in range(6):
        tree = F.regexp_replace(F.regexp_replace(tree, r"\{([^{}\[\]<>]*(?:[\[{][^<>]*[\]}][^{}\[\]<>]*)*)>", r"{$1}"), r"\[([^{}\[\]<>]*(?:[\[{][^<>]*[\]}][^{}\[\]<>]*)*)>", r"[$1]")
    return tree


def fingerprint(record: str) -> Column:
    return F.sha2(shape(record), 256)


def canonical(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """``id_col, fingerprint, layout, turns`` with turns of (role, text)."""
    marked = records.select(id_col, F.col(record_col).alias("_record")).withColumn("fingerprint", fingerprint("_record"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for x in reversed(LAYOUTS):
        same = F.col("fingerprint") == F.sha2(F.lit(x.shape), 256)
        name = F.when(same, F.lit(x.name)).otherwise(name)
        turns = F.when(same, F.expr(x.turns.replace("r.", f"from_json(_record, '{x.schema}', {READ})."))).otherwise(turns)
    return marked.select(id_col, "fingerprint", name.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    """Control strings, and what looks like an escape, made harmless."""
    text = F.regexp_replace(text, "&(amp|lt|lsqb|lf);", "&amp;$1;")
    text = F.regexp_replace(text, r"<(\|im_start\|>|\|im_end\|>|/?s>)", "&lt;$1")
    return F.regexp_replace(text, r"\[(/?INST\])", "&lsqb;$1")


def unescaped(text: Column) -> Column:
    for code, char in (("&lsqb;", "["), ("&lt;", "<"), ("&lf;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def formatted(turns: DataFrame, id_col: str) -> DataFrame:
    """``id_col, formatted, loss_mask`` of conversations (``id_col, turns``).

    The mask has, for each turn, null or the (start, length) in characters of its text inside the formatted turn.
    """
    role = lambda t: F.regexp_replace(escaped(F.coalesce(t["role"], F.lit(""))), "\n", "&lf;")
    text = lambda t: escaped(F.coalesce(t["text"], F.lit("")))
    part = lambda t: F.struct(F.concat(F.lit(START), role(t), F.lit("\n")).alias("head"), text(t).alias("text"), (t["role"] == TARGET).alias("target"))
    parts = turns.select(id_col, F.transform("turns", part).alias("parts"))
    span = lambda p: F.when(p["target"], F.struct(F.char_length(p["head"]).cast("bigint").alias("start"), F.char_length(p["text"]).cast("bigint").alias("length")))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    return parts.select(id_col, whole.alias("formatted"), F.transform("parts", span).alias("loss_mask"))


def _cut(texts: DataFrame, id_col: str) -> DataFrame:
    """``id_col, pieces, loss_mask, formatted_chars``: formatted texts cut into their turns, which stay escaped."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    return texts.select(id_col, pieces.alias("pieces"), "loss_mask", F.char_length("formatted").cast("bigint").alias("formatted_chars"))


def _role(piece: Column) -> Column:
    return unescaped(F.substring(piece, F.lit(len(START) + 1), F.instr(piece, "\n") - len(START) - 1))


def _text(piece: Column) -> Column:
    return unescaped(F.substring(piece, F.instr(piece, "\n") + 1, F.char_length(piece)))


def _loss_text() -> Column:
    under = lambda p, m: F.when(m.isNotNull(), unescaped(F.substring(p, (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return F.array_join(F.zip_with("pieces", "loss_mask", under), "")


def read_back(texts: DataFrame, id_col: str) -> DataFrame:
    """``id_col, turns, loss_text, formatted_chars`` from formatted texts and their loss masks."""
    turn = lambda p: F.struct(_role(p).alias("role"), _text(p).alias("text"))
    return _cut(texts, id_col).select(id_col, F.transform("pieces", turn).alias("turns"), _loss_text().alias("loss_text"), "formatted_chars")


def digests(texts: DataFrame, id_col: str) -> DataFrame:
    """The digest columns of formatted texts, read back turn by turn."""
    told = F.array_join(F.transform("pieces", lambda p: F.concat(_role(p), F.lit("\n"), _text(p), F.lit("\n"))), "")
    back = _cut(texts, id_col).select(id_col, F.size("pieces").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), _loss_text().alias("loss_text"), "formatted_chars")
    return back.select(id_col, "n_turns", "turns_sha256", F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def whole_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, m``: the turns of each conversation in order, as rows of (turn, role, text)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("m"))


def records_of(whole: DataFrame) -> DataFrame:
    """``conv_id, record``: whole conversations as JSON records, whose layouts differ by shape and id.

    A user and an assistant turn alone become a prompt record or an instruction record, all others lists of messages.
    """
    single = (F.size("m") == 2) & (F.col("m")[0]["role"] == "user") & (F.col("m")[1]["role"] == "assistant")
    first, second = F.get("m", F.lit(0))["text"], F.get("m", F.lit(1))["text"]
    odd = F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 1
    messages = F.to_json(F.struct(F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    others = F.to_json(F.struct(F.transform("m", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value"))).alias("conversations")))
    prompt, instruction = F.to_json(F.struct(first.alias("prompt"), second.alias("completion"))), F.to_json(F.struct(first.alias("instruction"), second.alias("response")))
    return whole.select("conv_id", F.when(single & odd, prompt).when(single, instruction).when(odd, messages).otherwise(others).alias("record"))


def chat_report(conversations: DataFrame) -> DataFrame:
    """One row of digests for each conversation, read back from the table of formatted texts that is written first."""
    mapped = canonical(records_of(whole_conversations(conversations)), "conv_id", "record")
    lost = F.raise_error(F.concat(F.lit("a record without a declared layout: conversation "), F.col("conv_id").cast("string"))).cast("array<struct<role: string, text: string>>")
    turns = mapped.select("conv_id", F.when(F.col("layout").isNull(), lost).otherwise(F.col("turns")).alias("turns"))
    return digests(written(formatted(turns, "conv_id"), "formatted"), "conv_id")
